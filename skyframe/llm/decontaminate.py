"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``n`` consecutive benchmark words (a shorter item is
one pattern). Symbols are words, as 64-bit hashes. A shift table over blocks
of two words says how far the window may move without missing a pattern; where
the shift is 0, the bucket of that block (a pattern's last two words) gives
the test strings, and comparing all their words confirms an occurrence. The
scan runs in many lanes at once, as numpy operations.

The tables come from the benchmark, which is split into shards of at most
``max_shard_words`` words; only one shard is broadcast at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textbytes import ALPHANUMERIC, mix, slices, words

LANE = 256
_LEFT, _RIGHT = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def _blocks(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block of ``width`` (1 or 2) words that ends at each word."""
    if width == 1:
        return hashed
    out = hashed * _RIGHT
    out[1:] += hashed[:-1] * _LEFT
    return mix(out)


class ShiftTable:
    """Patterns of one length: distinct word windows, the items that have them, and the shift table."""

    def __init__(self, windows: np.ndarray, owners: np.ndarray) -> None:
        self.m = windows.shape[1]
        self.width = min(2, self.m)
        distinct, which = np.unique(windows, axis=0, return_inverse=True)
        suffix = _blocks(distinct.ravel(), self.width).reshape(distinct.shape)[:, -1]
        order = np.argsort(suffix, kind="stable")
        self.windows, self.suffix = distinct[order], suffix[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[which.ravel()], owners], axis=1), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        self.items = pairs[:, 1]
        blocks = _blocks(self.windows.ravel(), self.width).reshape(self.windows.shape)
        bits = min(22, max(12, math.ceil(math.log2(8 * blocks.size + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.m - self.width + 1, np.uint8 if self.m < 256 else np.int64)
        for j in range(self.width - 1, self.m):  # later blocks give smaller shifts, so they come last
            self.shift[(blocks[:, j] & self.mask).astype(np.int64)] = self.m - 1 - j

    def search(self, hashed: np.ndarray, text_of: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, pattern) of all occurrences within texts."""
        n, m = len(hashed), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = _blocks(hashed, self.width)
        slot = (blocks & self.mask).astype(np.int32)
        lane = np.arange(0, n, LANE)
        at, end = np.maximum(lane, m - 1), np.minimum(lane + LANE, n)
        found = []
        while True:
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
            if not len(at):
                break
            step = self.shift[slot[at]].astype(np.int64)
            stop = step == 0
            if stop.any():
                found.append(at[stop])
                step[stop] = 1
            at = at + step
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.concatenate(found)
        ends = ends[ends - m + 1 >= first[text_of[ends]]]
        low = np.searchsorted(self.suffix, blocks[ends], "left")
        high = np.searchsorted(self.suffix, blocks[ends], "right")
        starts, patterns = [], []
        k = 0
        while len(ends):
            live = low + k < high
            ends, low, high = ends[live], low[live], high[live]
            if not len(ends):
                break
            same = np.ones(len(ends), bool)
            for j in range(m):
                same &= hashed[ends - m + 1 + j] == self.windows[low + k, j]
            starts.append(ends[same] - m + 1)
            patterns.append((low + k)[same])
            k += 1
        return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *patterns])


def build_tables(texts: list[str | None], n: int) -> list[ShiftTable]:
    """One shift table for each pattern length; items are numbered by place."""
    by_length: dict[int, tuple[list, list]] = {}
    base = 0
    for _, end, data, offsets in slices(pa.array(texts, pa.string())):
        hashed, first = words(data, offsets, ALPHANUMERIC)
        for i in range(len(first) - 1):
            count = int(first[i + 1] - first[i])
            if not count:
                continue
            m = min(n, count)
            view = np.lib.stride_tricks.sliding_window_view(hashed[first[i] : first[i + 1]], m)
            rows, owners = by_length.setdefault(m, ([], []))
            rows.append(view)
            owners.append(np.full(len(view), base + i))
        base = end
    return [ShiftTable(np.concatenate(r), np.concatenate(o)) for r, o in by_length.values()]


def _scan(batch_texts: pa.Array, tables: list[ShiftTable], ids: np.ndarray, known: list, spans: list) -> Iterator[tuple]:
    """For each text: number of words, word spans hit, ids of the items found."""
    for begin, end, data, offsets in slices(batch_texts):
        hashed, first = words(data, offsets, ALPHANUMERIC)
        text_of = np.repeat(np.arange(end - begin), np.diff(first))
        got: dict[int, tuple[list, set]] = {}
        for table in tables:
            starts, patterns = table.search(hashed, text_of, first)
            for s, p in zip(starts.tolist(), patterns.tolist(), strict=True):
                t = int(text_of[s])
                here = got.setdefault(t, ([], set()))
                here[0].append((s - int(first[t]), s - int(first[t]) + table.m))
                here[1].update(x for x in ids[table.items[table.first[p] : table.first[p + 1]]].tolist() if x is not None)
        counts = np.diff(first)
        for i in range(end - begin):
            old_spans, old_items = spans[begin + i] or (), known[begin + i] or ()
            if i in got:
                merged: list[list[int]] = []
                for s, e in sorted([*got[i][0], *((x["s"], x["e"]) for x in old_spans)]):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                yield int(counts[i]), [{"s": s, "e": e} for s, e in merged], sorted({*old_items, *got[i][1]})
            else:
                yield int(counts[i]), list(old_spans), list(old_items)


_FOUND = "n_words long, spans array<struct<s:int,e:int>>, items array<string>"
_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    found: str = "contamination",
    max_shard_words: int = 4_000_000,
) -> DataFrame:
    """``docs`` with a struct column ``found``: n_words, spans (maximal word ranges inside occurrences), items.

    ``items`` are the ids of the benchmark items with an occurring window, as
    strings in string order. A null or word-free text has no words and no
    spans; a null or word-free item has no windows; an item without id marks
    words but isn't listed; items that share an id are listed once. Every row of
    ``docs`` stays, with its columns; a column of docs that is already called
    ``found`` is refused, since it would be lost.
    """
    if found in docs.columns:
        raise ValueError(f"documents already have a column {found!r}")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    sized = items.withColumn("n", F.coalesce(F.char_length("text"), F.lit(0)))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / (6 * max_shard_words)))
    empty = "named_struct('n_words', 0L, 'spans', cast(array() as array<struct<s:int,e:int>>), 'items', cast(array() as array<string>))"
    current = docs.withColumn(found, F.expr(empty))
    for shard in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard)
        rows = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
        held = spark.sparkContext.broadcast((build_tables([r[1] for r in rows], n), np.array([r[0] for r in rows], object)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tables, ids = held.value
            for batch in batches:
                at = batch.schema.get_field_index(found)
                old = batch.column(at)
                rows = [
                    {"n_words": a, "spans": b, "items": c}
                    for a, b, c in _scan(
                        batch.column(batch.schema.get_field_index(text)), tables, ids,
                        old.field("items").to_pylist(), old.field("spans").to_pylist(),
                    )
                ]
                columns = [*batch.columns]
                columns[at] = pa.array(rows, _TYPE)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        if shard:
            current = materialize(current, "decontaminate")
        current = current.mapInArrow(run, current.schema)
    return current


def op9_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, with windows of 10 words."""
    hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda n, s: n + (s["e"] - s["s"]))
    return find_contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(ws, i, i + least(10, len(ws)) - 1) AS p FROM b, unnest(generate_series(1, greatest(len(ws) - 9, 1))) t(i) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), []) AS ws FROM documents),
lens AS (SELECT DISTINCT len(p) AS m FROM win),
pos AS (SELECT r, m, i, list_slice(ws, i, i + m - 1) AS p FROM d, lens, unnest(generate_series(1, len(ws) - m + 1)) t(i) WHERE len(ws) >= m),
occ AS (SELECT pos.r, pos.i, pos.m, win.item_id FROM pos JOIN win ON pos.p = win.p),
hit AS (SELECT r, count(DISTINCT k) AS n FROM occ, unnest(generate_series(i, i + m - 1)) t(k) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.ws)::bigint AS n_words, coalesce(hit.n, 0)::bigint AS n_hit, coalesce(it.n, 0)::bigint AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
