"""Queries of the training-data operators for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_repair import op3_chat_formatting
from .common import table
from .decontaminate import OP9_SQL, op9_decontaminate
from .embedding_dedup import OP6_SQL, op6_embedding_dedup
from .language_id import op10_language_id
from .mixing import OP1_SQL, op1_mix
from .near_dedup import OP2_SQL, op2_near_dedup
from .paragraph_dedup import op5_paragraph_dedup
from .quality import op7_quality_classifier
from .secrets import OP4_SQL, op4_secrets
from .suffix_dedup import op8_with_passages

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": lambda s, d: op1_mix(table(s, d, "documents")),
        "op2_minhash_near_dedup": lambda s, d: op2_near_dedup(table(s, d, "documents")),
        "op3_chat_formatting": lambda s, d: op3_chat_formatting(table(s, d, "conversations")),
        "op4_secret_scans": lambda s, d: op4_secrets(table(s, d, "documents")),
        "op5_paragraph_dedup": lambda s, d: op5_paragraph_dedup(table(s, d, "documents")),
        "op6_embedding_near_dedup": lambda s, d: op6_embedding_dedup(table(s, d, "embeddings")),
        "op7_quality_classifier": lambda s, d: op7_quality_classifier(table(s, d, "documents"), table(s, d, "labels")),
        "op8_suffix_array_dedup": lambda s, d: op8_with_passages(table(s, d, "documents")),
        "op9_benchmark_decontamination": lambda s, d: op9_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_language_id": lambda s, d: op10_language_id(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_minhash_near_dedup": OP2_SQL, "op4_secret_scans": OP4_SQL, "op6_embedding_near_dedup": OP6_SQL, "op9_benchmark_decontamination": OP9_SQL}
