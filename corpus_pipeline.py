"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import materialize, table
from skyframe.llm.decontaminate import find_contamination
from skyframe.llm.language_id import UNKNOWN, identify_languages, train
from skyframe.llm.mixing import op1_mix
from skyframe.llm.near_dedup import near_duplicates
from skyframe.llm.secrets import redact

#: Of a text's letters, the part that must be in one language.
MIN_SHARE = 0.5


def _unused(name: str, docs: DataFrame) -> str:
    """``name``, with underscores before it where docs have such a column."""
    while name in docs.columns:
        name = "_" + name
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is mostly in one known language; texts that are null, without letters or mixed go.

    The languages are learned from the stage's own rows with a text and a lang;
    without such rows nothing is known and nothing stays. Repeated rows stay or
    go together. No rows give no rows. Further columns stay.
    """
    name = _unused("language", docs)
    found = identify_languages(docs, train(docs), found=name)
    return found.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= MIN_SHARE)).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five words, similarity 0.8).

    Documents are told apart by doc_id: rows without one stay, since nothing
    tells which of them would go, and repeated rows stay or go together. A text
    without words, or null, is in no group and stays. Further columns stay. No
    rows give no rows.
    """
    name = _unused("gone", docs)
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of ten benchmark words occurs (of an item of fewer words, the item).

    A null or word-free text holds no window and stays, as do all rows where
    the benchmark has none. Repeated rows stay or go together. Further columns
    stay.
    """
    name = _unused("contamination", docs)
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), found=name)
    return found.where(F.size(f"{name}.spans") == 0).drop(name)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; n_chars follows the text where it changed. All rows and columns stay; a null text stays null."""
    before = _unused("before", docs)
    masked = redact(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return masked.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, source.

    One row for each row; a null source is a source of its own, a null text has
    no words. Which of rows with equal ids is cut makes no difference.
    """
    return op1_mix(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
]

#: Language ID is learned, which SQL can't express; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
