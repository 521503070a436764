"""What the training-data operators share: the shared folder, a bounded key
filter, and connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the key filter: 256 bitmaps of 4 KiB, whatever the number of keys.
FILTER_BITS = 1 << 23
#: Bits of the filter of hashes that Python tasks hold.
HASH_BITS = 27
_PAGE = 32768


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the session names none, one machine gets a temporary folder, which is
    set for the session; on a cluster, whose executors couldn't see that, this
    is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skyframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scopes = threading.local()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    Within ``scratch`` the table goes at the scope's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if stack := getattr(_scopes, "stack", None):
        stack[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope at whose end the tables materialized within it are deleted, but for those given to the function that it yields."""
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    mine: list[DataFrame] = []
    _scopes.stack.append(mine)

    def keep(table: DataFrame) -> DataFrame:
        mine[:] = [t for t in mine if t is not table]
        if len(_scopes.stack) > 1:  # the scope around decides
            _scopes.stack[-2].append(table)
        return table

    try:
        yield keep
    finally:
        _scopes.stack.pop()
        discard(*mine)


def hashable(df: DataFrame) -> list[F.Column]:
    """The columns that Spark can hash: all but maps and variants."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slot(key, bits: int = FILTER_BITS) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def with_keys_maybe_in(df: DataFrame, key: str, keys: DataFrame, mark: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys`` (one column); never drops one that is.

    The keys are folded into a bitmap of fixed size (1 MiB), which is what is
    broadcast. It spares the shuffle most wide rows before an exact join; with
    far more keys than bits it lets everything pass and the join still decides.
    With ``mark``, all rows stay and a boolean column ``_maybe`` tells.
    """
    bitmaps = (
        keys.select(_slot(keys.columns[0]).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    )
    slot = _slot(key)
    probed = df.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_at": F.bitmap_bit_position(slot)})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
    joined = probed.join(F.broadcast(bitmaps), "_bucket", "left" if mark else "inner")
    columns = [F.col(f"`{c}`") for c in df.columns]
    if mark:
        return joined.select(*columns, F.coalesce(hit, F.lit(False)).alias("_maybe"))
    return joined.where(hit).select(*columns)


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of 64-bit keys by their lowest HASH_BITS bits: 16 MiB on the driver, whatever their number."""
    slot = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << HASH_BITS) - 1)) + 1
    pages = (
        keys.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    bitmap = np.zeros((1 << HASH_BITS) // 8, np.uint8)
    for page, bits in pages.toLocalIterator():
        bitmap[(page - 1) * _PAGE // 8 : page * _PAGE // 8] = np.frombuffer(bits, np.uint8)
    return bitmap


def maybe_in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the bitmap; true for all that are."""
    at = (keys.astype(np.uint64) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b); component is the smallest node reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    every step is one aggregation and one join, each round is written to the
    shared folder, and only one number a round comes to the driver. Nodes
    without an edge aren't returned. Loops and repeated edges do no harm.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # (u, v): v a neighbour of u; large: all neighbours, else those smaller than u
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        joined = pairs.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).union(
                low.select(F.col("u").alias("a"), F.col("low").alias("b"))
            )
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def settled(pairs: DataFrame) -> bool:
        # only stars are left: no node has two smaller neighbours, or a smaller and a larger one
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end"))
        mixed = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count(F.lit(1)).alias("all")).where("up > 1 or up = 1 and all > 1")
        return mixed.agg(F.count(F.lit(1))).first()[0] == 0

    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if settled(current):
            break
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        wide = star(both, True)
        current = materialize(star(wide.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "edges")
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    # settled: every edge joins a node to the smallest node of its component
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
