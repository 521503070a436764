"""Substring dedup by paragraphs: MinHash banding, exact verification, components.

Paragraphs are lines of a text. Those with equal shingle sets are one class;
classes that meet in a band are verified on their full shingle sets, and all
but the first paragraph of a component are removed. Small sets meet by their
least hashes instead of bands, which misses no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, materialize, maybe_in, with_keys_maybe_in
from .near_dedup import band_keys, fingerprints, linked_components, registers
from .passages import repeated_passages
from .textbytes import NOT_SPACE, shingles, slices, words

BITS, ROWS = 6, 3
#: Sets of so many shingles at most meet by prefixes.
SMALL = 15


def tuned_bands(similarity: float, rows: int = ROWS, miss: float = 1e-4, most: int = (1 << BITS) // ROWS) -> int:
    """The fewest bands of ``rows`` registers that miss a pair of that similarity with probability ``miss`` at most."""
    return min(most, math.ceil(math.log(miss) / math.log(1 - similarity**rows)))


def meeting_keys(sets: list[np.ndarray], bands: int, percent: int) -> pa.Array:
    """The keys by which sorted sets meet: a list for each.

    Two sets of the wanted similarity share one of the least floor(s (100 -
    percent) / 100) + 1 hashes of each, s being its size. A set that only its
    equal can match has no keys, as equal sets are one class.
    """
    size = np.array([len(s) for s in sets], np.int64)
    prefix = size - -(-percent * size // 100) + 1
    alone = 100 * size < percent * (size + 1)  # no set of another size, nor one of this size with another member
    large = np.flatnonzero(size > SMALL)
    banded = band_keys(registers([sets[i] for i in large], BITS)[1], bands, ROWS)
    place = np.zeros(len(sets), np.int64)
    place[large] = np.arange(len(large))
    out = []
    for i, s in enumerate(sets):
        mine = [np.zeros(0, np.uint64)]
        if size[i] > SMALL:
            mine.append(banded[place[i]])
        if not alone[i] and percent * size[i] <= 100 * SMALL:
            mine.append(s[: prefix[i]])
        out.append(np.concatenate(mine))
    ends = np.cumsum([0, *map(len, out)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)))


def repeated_paragraphs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, min_words: int = 20
) -> DataFrame:
    """One row for each row of docs: doc_id, n_paragraphs, n_removed, removed (numbers of the paragraphs, from 0), firsts.

    Paragraphs are the lines that hold a word. Those of ``min_words`` words or
    more are compared: n-word shingles, A-Z lower-cased, similarity at least
    percent / 100. In each component the first paragraph stays (smallest
    doc_id, then place; null ids come last), the others go; ``firsts`` are the
    doc_ids of the paragraphs that stay in their stead. Paragraphs of repeated
    rows are copies like any others. A null or empty text has no paragraphs.
    """
    return _by_rows(sketched_texts(docs, doc_id, text, n, percent, min_words), n, percent).withColumnRenamed("doc_id", doc_id).drop("row")


def sketched_texts(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, min_words: int) -> DataFrame:
    """(doc_id, row, text, lines, keys), written: of each text, the lines that hold a word and the (id, key) by which those that are compared meet.

    ``id`` names a line's shingle set; it is null where the line isn't compared.
    """
    bands = tuned_bands(percent / 100)
    line = pa.struct([("place", pa.int32()), ("id", pa.int64()), ("n", pa.int64())])
    pair = pa.struct([("id", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, _ in slices(batch.column("text")):
                part = batch.slice(begin, end - begin)
                split = pc.split_pattern(part.column("text").fill_null(""), "\n")
                owner, lines = pc.list_parent_indices(split).to_numpy(), split.flatten()
                first = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
                found: list[list[np.ndarray]] = []
                for low, _, data, offsets in slices(lines):
                    hashed, start = words(data, offsets, NOT_SPACE)
                    count = np.diff(start)
                    runs, start = shingles(hashed, start, n)
                    full = np.flatnonzero(count > 0)
                    compared = count[full] >= min_words
                    sets = [np.unique(runs[start[i] : start[i + 1]]) for i in full[compared]]
                    met = meeting_keys(sets, bands, percent)
                    name, size, keys = np.zeros(len(full), np.int64), np.zeros(len(full), np.int64), np.zeros(len(full), np.int64)
                    name[compared] = fingerprints(sets)[0]
                    size[compared] = [len(s) for s in sets]
                    keys[compared] = met.value_lengths().to_numpy()
                    found.append([owner[low + full], low + full - first[owner[low + full]], compared, name, size, keys, met.flatten().to_numpy()])
                of, place, compared, name, size, keys, met = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 7
                compared = compared.astype(bool)
                texts = np.arange(end - begin + 1)
                each = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(name, mask=~compared), pa.array(size, mask=~compared)], fields=list(line))
                pairs = pa.StructArray.from_arrays([pa.array(np.repeat(name, keys)), pa.array(met, pa.int64())], fields=list(pair))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row"),
                        part.column("text"),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(of, texts), pa.int32()), each),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(np.repeat(of, keys), texts), pa.int32()), pairs),
                    ],
                    names=["doc_id", "row", "text", "lines", "keys"],
                )

    numbered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    spec = "doc_id long, row long, text string, lines array<struct<place: int, id: long, n: long>>, keys array<struct<id: long, key: long>>"
    return materialize(numbered.mapInArrow(run, spec), "lines")


def _texts(sketched: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the lines whose id may be among ids."""
    held = sketched.sparkSession.sparkContext.broadcast(key_bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, _ in slices(batch.column("text")):
                split = pc.split_pattern(batch.column("text").slice(begin, end - begin).fill_null(""), "\n")
                first = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
                mine = batch.column("lines").slice(begin, end - begin)
                each, of = mine.flatten(), pc.list_parent_indices(mine).to_numpy()
                known = each.field("id").is_valid().to_numpy(zero_copy_only=False)
                ids = each.field("id").fill_null(0).to_numpy()
                some = np.flatnonzero(known & maybe_in(held.value, ids.view(np.uint64)))
                at = first[of[some]] + each.field("place").to_numpy()[some]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), split.flatten().take(pa.array(at))], names=["id", "text"])

    return sketched.select("text", F.col("lines")).mapInArrow(run, "id long, text string")


def _by_rows(sketched: DataFrame, n: int, percent: int) -> DataFrame:
    """repeated_paragraphs of what sketched_texts gives, with the row."""
    compared = sketched.select("doc_id", "row", F.explode("lines").alias("line")).select("doc_id", "row", "line.place", "line.id", "line.n").where("id is not null")
    banded = sketched.select(F.explode("keys").alias("pair")).select("pair.id", "pair.key")
    found = linked_components(compared.select("id", "n", F.col("id").alias("f1")), banded, lambda ids: _texts(sketched, ids), n, percent, copies=True)

    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row", "place")
    classes = materialize(compared.groupBy("id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")), "lines")
    named = classes.join(found, F.col("id") == F.col("node"), "left").where("size > 1 or node is not null").select("id", "first", "size", F.coalesce("component", "id").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("top"), F.sum("size").alias("all")).where("all > 1").select("component", "top")
    several = materialize(named.select("id", "component").join(firsts, "component").select("id", F.col("top.doc_id").alias("first_doc"), F.col("top.row").alias("first_row"), F.col("top.place").alias("first_place")), "several")
    again = with_keys_maybe_in(compared.select("row", "place", "id"), "id", several.select("id")).join(several, "id")
    gone = again.where("row <> first_row or place <> first_place").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_removed"), F.array_sort(F.collect_list("place")).alias("removed"), F.array_sort(F.collect_set("first_doc")).alias("firsts")
    )
    zero, none = F.lit(0).cast("long"), F.array()
    return (
        sketched.select("row", "doc_id", F.size("lines").cast("long").alias("n_paragraphs")).join(gone, "row", "left")
        .select(
            "row", "doc_id", "n_paragraphs", F.coalesce("n_removed", zero).alias("n_removed"),
            F.coalesce("removed", none.cast("array<int>")).alias("removed"), F.coalesce("firsts", none.cast("array<long>")).alias("firsts"),
        )
    )


def op5_paragraph_dedup(docs: DataFrame) -> DataFrame:
    """repeated_paragraphs of every line that holds a word, and the passages of 50 words that repeat inside or across lines.

    Lines of less than five words are one shingle. n_shared_words, n_cut_words
    and cuts are those of repeated_passages; words are counted over the text.
    One row for each row; a null text has no lines and no words, repeated rows
    are copies like any others, of ties the first place stays (smallest doc_id,
    null last, then row). No rows give no rows.
    """
    sketched = sketched_texts(docs, "doc_id", "text", 5, 80, 1)
    passages = repeated_passages(sketched.select("doc_id", "row", "text"))
    none = F.array().cast(passages.schema["cuts"].dataType)
    return (
        _by_rows(sketched, 5, 80).join(passages, "row", "left").drop("row")
        .withColumns({"n_shared_words": F.coalesce("n_shared_words", F.lit(0)), "n_cut_words": F.coalesce("n_cut_words", F.lit(0)), "cuts": F.coalesce("cuts", none)})
    )
