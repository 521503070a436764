"""Passages that repeat anywhere in the texts, whatever the lines.

A passage is a run of ``window`` words (A-Z lower-cased, any spaces between).
Every window holds a smallest hash among its runs of half the length, its
anchor; equal windows have equal anchors. A first pass counts anchors, about
one for every 13 words; a second makes one row of each run of windows with a
repeated anchor. Runs with equal windows are one variant, and copies of a
passage are mostly one: its first place is that of all its windows. Only where
an anchor has several variants, the windows of one run of each are told apart.
Names are pairs of 64-bit hashes, a window's and its anchor's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, materialize, maybe_in, scratch, with_keys_maybe_in
from .textbytes import NOT_SPACE, mix, powers, slices, words

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _least(x: np.ndarray, width: int, fold: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or, by ``fold``, largest) of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x, span = fold(x[:-span], x[span:]), span * 2
    return fold(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


class Windows:
    """The windows of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        hashed, self.first = words(data, offsets, NOT_SPACE)
        half, n = window // 2, len(hashed)
        self.width = window - half + 1
        if n < window:
            hashed, n = np.zeros(window, np.uint64), window
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first)) if self.first[-1] >= window else np.arange(n)
        with np.errstate(over="ignore"):
            up, down = powers(n + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[:n], dtype=np.uint64)])
            self.halves, self.hash = (mix((total[k:] - total[:-k]) * down[: n - k + 1]) for k in (half, window))
        self.anchor = _least(self.halves, self.width)
        self.of = of[: n - window + 1]
        self.whole = self.of == of[window - 1 :]  # within one text

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of places) of the runs that are a window's anchor."""
        edge = np.zeros(self.width - 1, np.uint64)
        largest = _least(np.concatenate([edge, np.where(self.whole, self.anchor, np.uint64(0)), edge]), self.width, np.maximum)
        return np.unique(self.halves[(largest == self.halves) & (largest > 0)], return_counts=True)


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans from spans sorted by start."""
    if not len(low):
        return low, high
    reach = np.maximum.accumulate(high)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    return low[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(low) - 1]])]


def _again(keys: np.ndarray, run: np.ndarray, runs: int) -> np.ndarray:
    """For each run, whether a key stands in it twice."""
    out = np.zeros(runs, bool)
    with np.errstate(over="ignore"):
        own = np.sort(keys ^ mix(run.astype(np.uint64) * _ODD))
    if (own[1:] == own[:-1]).any():
        order = np.lexsort((keys, run))
        twice = (keys[order][1:] == keys[order][:-1]) & (run[order][1:] == run[order][:-1])
        out[run[order][1:][twice]] = True
    return out


def _runs(numbered: DataFrame, window: int, repeated: np.ndarray) -> DataFrame:
    """The runs of successive windows that have an anchor which may be repeated; windows: their hashes, 8 bytes each."""
    held = numbered.sparkSession.sparkContext.broadcast(repeated)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in slices(batch.column("text")):
                w = Windows(data, offsets, window)
                hit = np.flatnonzero(w.whole & maybe_in(held.value, w.anchor))
                if not len(hit):
                    continue
                new = np.concatenate([[True], (np.diff(hit) > 1) | (w.anchor[hit][1:] != w.anchor[hit][:-1]) | (w.of[hit][1:] != w.of[hit][:-1])])
                heads = np.flatnonzero(new)
                ends = np.append(heads[1:], len(hit))
                start, size, keys = hit[heads], ends - heads, w.hash[hit]
                with np.errstate(over="ignore"):
                    up, down = powers(len(keys) + 1)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * up[: len(keys)], dtype=np.uint64)])
                    variant = mix((total[ends] - total[heads]) * down[heads] + size.astype(np.uint64) * _ODD)
                text = pa.array(w.of[start] + begin)
                blobs = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer((np.append(heads, len(hit)) * 8).astype(np.int32)), pa.py_buffer(keys)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.anchor[start].view(np.int64)),
                        pa.array(variant.view(np.int64)),
                        pa.array(_again(keys, np.repeat(np.arange(len(heads)), size), len(heads))),
                        batch.column("doc_id").take(text),
                        batch.column("row").take(text),
                        pa.array((start - w.first[w.of[start]]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        blobs,
                    ],
                    names=["anchor", "variant", "inner", "doc_id", "row", "at", "size", "windows"],
                )

    return numbered.mapInArrow(emit, "anchor long, variant long, inner boolean, doc_id long, row long, at int, size int, windows binary")


def _exploded(variants: DataFrame) -> DataFrame:
    """(anchor, variant, k, window, doc_id, row, at, n): every window of the variants' first runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("windows").to_pylist()
            size = np.array([len(b) // 8 for b in blobs], np.int64)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of = pa.array(np.repeat(np.arange(len(blobs)), size))
            taken = {c: batch.column(c).take(of) for c in ("anchor", "variant", "doc_id", "row", "n")}
            at = batch.column("at").to_numpy()[of.to_numpy()] + k
            yield pa.RecordBatch.from_arrays(
                [taken["anchor"], taken["variant"], pa.array(k, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int64)), taken["doc_id"], taken["row"], pa.array(at, pa.int32()), taken["n"]],
                names=["anchor", "variant", "k", "window", "doc_id", "row", "at", "n"],
            )

    return variants.mapInArrow(run, "anchor long, variant long, k int, window long, doc_id long, row long, at int, n long")


_SEGMENTS = "array<struct<low: int, high: int, row: long, at: int>>"


def _joined(firsts: DataFrame) -> DataFrame:
    """(anchor, variant, segments) of (anchor, variant, firsts): windows k in order with the row and place of their first; neighbours join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column("firsts")
            of = pc.list_parent_indices(each).to_numpy()
            flat = each.flatten()
            k, row, at = (flat.field(c).to_numpy().astype(np.int64) for c in ("k", "row", "at"))
            new = np.ones(len(k), bool)
            new[1:] = (of[1:] != of[:-1]) | (k[1:] != k[:-1] + 1) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            heads = np.flatnonzero(new)
            last = np.append(heads[1:], len(k)) - 1 if len(k) else heads
            parts = pa.StructArray.from_arrays(
                [pa.array(k[heads], pa.int32()), pa.array(k[last], pa.int32()), pa.array(row[heads]), pa.array(at[heads], pa.int32())], names=["low", "high", "row", "at"]
            )
            ends = np.searchsorted(of[heads], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor"), batch.column("variant"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)], names=["anchor", "variant", "segments"]
            )

    return firsts.mapInArrow(run, f"anchor long, variant long, segments {_SEGMENTS}")


def repeated_passages(numbered: DataFrame, window: int = 50) -> DataFrame:
    """One row for each row of numbered (doc_id, row, text) that shares a passage, written: row, n_shared_words, n_cut_words, cuts.

    Windows of ``window`` words that occur at several places, in one text or
    in several, are shared. The first place (smallest doc_id, then row, then
    word; null ids come last) stays, the words of the others are cut, except
    those that belong to an overlapping first place in the same text. ``cuts``
    are the spans of words to remove: first word, word after. Null texts and
    texts of fewer words share nothing; repeated rows share all they hold.
    """
    with scratch() as keep:
        return keep(materialize(_repeated_passages(numbered, window), "passages"))


def _repeated_passages(numbered: DataFrame, window: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                found, places = Windows(data, offsets, window).anchors()
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(places)], names=["anchor", "places"])

    counted = numbered.select("text").mapInArrow(count, "anchor long, places long").groupBy("anchor").agg(F.sum("places").alias("places"))
    runs = materialize(_runs(numbered, window, key_bitmap(counted.where("places > 1").select("anchor"))), "runs")

    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row", "at")
    variants = materialize(
        runs.groupBy("anchor", "variant", "size").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), F.min(place).alias("first")), "variants"
    )
    shape = variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.max("inner").alias("again"))
    judged = materialize(variants.join(shape, "anchor").where("n > 1 or variants > 1 or again"), "judged")
    whole = judged.where("variants = 1 and not again").select(
        "anchor", "variant", F.array(F.struct(F.lit(0).alias("low"), (F.col("size") - 1).alias("high"), "first.row", "first.at")).cast(_SEGMENTS).alias("segments")
    )
    mixed = judged.where("variants > 1 or again").select("anchor", "variant", "first.row", "first.at", "n")
    some = with_keys_maybe_in(runs.select("anchor", "variant", "row", "at", "doc_id", "windows"), "anchor", mixed.select("anchor"))
    each = materialize(_exploded(some.join(mixed, ["anchor", "variant", "row", "at"])), "windows")
    firsts = each.groupBy("anchor", "window").agg(F.sum("n").alias("places"), F.min(place).alias("first")).where("places > 1").select("anchor", "window", "first.row", "first.at")
    named = each.select("anchor", "variant", "k", "window").join(firsts, ["anchor", "window"])
    parts = _joined(named.groupBy("anchor", "variant").agg(F.array_sort(F.collect_list(F.struct("k", "row", "at"))).alias("firsts")))

    segments = whole.union(parts)
    spans = runs.select("anchor", "variant", "row", F.col("at").alias("start")).join(segments, ["anchor", "variant"]).select("row", "start", F.explode("segments").alias("s"))
    low, behind = F.col("start") + F.col("s.low"), F.col("start") + F.col("s.low") - F.col("s.at")  # behind: words after the first place
    begin = F.when(F.col("s.row") != F.col("row"), low).when(behind > 0, low + F.greatest(F.lit(0), F.lit(window) - behind)).otherwise(-1)
    each_row = spans.select("row", low.alias("low"), (F.col("start") + F.col("s.high") + window).alias("high"), begin.alias("begin"))
    by_row = each_row.groupBy("row").agg(F.collect_list(F.struct("low", "high", "begin")).alias("spans"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for x in batch.column("spans"):
                low, high, begin = (x.values.field(c).to_numpy().astype(np.int64) for c in ("low", "high", "begin"))
                gone = begin >= 0
                by, cut = np.argsort(low, kind="stable"), np.argsort(begin[gone], kind="stable")
                all_low, all_high = merged(low[by], high[by])
                cut_low, cut_high = merged(begin[gone][cut], high[gone][cut])
                out.append((int((all_high - all_low).sum()), int((cut_high - cut_low).sum()), [{"begin": a, "end": b} for a, b in zip(cut_low.tolist(), cut_high.tolist(), strict=True)]))
            shared, cut, cuts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(shared, pa.int64()), pa.array(cut, pa.int64()), pa.array(cuts, kind)], names=["row", "n_shared_words", "n_cut_words", "cuts"]
            )

    return by_row.mapInArrow(join, "row long, n_shared_words long, n_cut_words long, cuts array<struct<begin: int, end: int>>")
