"""Substring dedup: bytes covered by a ``length``-byte string that starts elsewhere too.

Prefix doubling ranks positions by ever longer strings and drops those that
have become unique. Over every byte position that takes nine sorts of some 24
bytes for each byte of input, so here the positions are thinned first, without
losing a match:

1. Every string of ``length`` bytes is anchored at the smallest k-gram hash
   among its first SPAN k-grams; equal strings have the same anchor at the same
   place. Only anchors are ranked, and all strings of an anchor contain the
   ``length - SPAN`` bytes from it.
2. The first rank names the first 2 GRAM bytes from the anchor. In each round
   Spark groups the (rank, position) rows, drops ranks that have become unique,
   and names the pair of a rank and the string that follows it, which doubles
   the length, until ``length - SPAN`` bytes are ranked.
3. What is left is ranked once more by the union of the anchor's strings, which
   is longer than ``length``. Where all anchors of a rank agree in it, all their
   strings repeat. Only where they don't, single strings are ranked, one anchor
   standing for all that agree in both.

Ranks are names, 64-bit hashes; two independent ones decide.

Passages of many words can be shorter than ``length`` bytes. They are found by
the same steps over the texts' words, a word in a byte's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, materialize, maybe_in, scratch, with_keys_maybe_in
from .textbytes import NOT_SPACE, mix, powers, slices, stream, words

LENGTH, SPAN, GRAM = 400, 160, 24
#: Words of a passage.
PASSAGE = 50
#: A power of two: places within a segment and the k-grams' hashes share 64 bits.
SEGMENT = 1 << 19
#: Bytes of strings that one task call compares; a rank with more than eight times as many is compared as Spark rows.
GROUP_BYTES = 1 << 19
_LEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Unit:
    """What strings are made of, bytes or words (A-Z lower-cased, any spaces between), their length and how anchors are chosen."""

    length: int
    span: int = SPAN
    gram: int = GRAM
    size: int = 1  # bytes of a unit: a word is its 64-bit hash

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of a slice of texts, and each text's first."""
        return (data, offsets) if self.size == 1 else words(data, offsets, NOT_SPACE)

    def least_bytes(self) -> int:
        """Shorter texts hold no string."""
        return self.length if self.size == 1 else 2 * self.length - 1

    def ranks(self) -> list[int]:
        return rank_lengths(self.length, self.span, self.gram)


def words_unit(length: int) -> Unit:
    gram = max(1, length // 4)  # words are rare enough for a single rank
    return Unit(length, span=max(1, length - 2 * gram), gram=gram, size=8)


class Hasher:
    """Hashes of substrings of 8 bytes and more, or of runs of words, in constant time.

    Prefix sums of a polynomial modulo 2**64 whose coefficients are random
    functions of 8 neighbouring bytes, so that no structure of the bytes (as of
    Thue-Morse strings) makes the polynomial vanish.
    """

    WIDTH = 8

    def __init__(self, data: np.ndarray, seed: int) -> None:
        self.width = self.WIDTH if data.dtype == np.uint8 else 1  # words are hashes already
        n = max(0, len(data) - self.width + 1)
        wide = np.zeros(n, np.uint64) if self.width > 1 else data
        if n and self.width > 1:
            body = np.ascontiguousarray(data)
            for k in range(min(self.WIDTH, n)):
                count = (n - k + self.WIDTH - 1) // self.WIDTH
                wide[k :: self.WIDTH] = np.frombuffer(body, "<u8", count, k)
        with np.errstate(over="ignore"):
            up, self.down = powers(n + 1)
            wide = mix(wide ^ stream(seed, 1)[0])
            wide *= up[:n]
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum(wide, out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            size = (np.asarray(end) - start).astype(np.uint64)
            return mix((self.total[np.asarray(end) - self.width + 1] - self.total[start]) * self.down[start] + size * _LEN)


def rank_lengths(length: int, span: int = SPAN, gram: int = GRAM) -> list[int]:
    """Units that each round ranks: 2 gram, doubling, up to length - span."""
    out = [min(2 * gram, length - span)]
    while out[-1] < length - span:
        out.append(min(2 * out[-1], length - span))
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> Iterator[tuple]:
    """Of each segment: (text, first start, last start, places of the anchors within the segment, hasher, second rank on demand).

    Starts are places within the data. A text of several segments is cut so
    that every start is in one of them.
    """
    length, span = unit.length, unit.span
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for low in range(0, len(data), SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        n = min(len(part) - length + 1, SEGMENT)
        if n <= 0:
            continue
        hashed = Hasher(part, 3)
        grams = len(part) - unit.gram + 1
        at = np.arange(grams)
        # The leftmost minimum of span k-grams, by doubling: the upper bits are the hash, the lower ones the place.
        bits = np.uint64((2 * SEGMENT) - 1)
        least = (hashed(at, at + unit.gram) & ~bits) | at.astype(np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[step:], least[:-step])
            width += step
        place = (least[:n] & bits).astype(np.int64)
        del least, at
        start = np.flatnonzero(np.arange(low + length, low + length + n) <= ends[low : low + n])
        if not len(start):
            continue
        mine = place[start]
        new = np.ones(len(start), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(new)
        first, last = start[heads], start[np.concatenate([heads[1:], [len(start)]]) - 1]
        text = np.searchsorted(offsets, first + low, "right") - 1
        yield text, first + low, last + low, mine[heads], hashed, part, low


def _keyed(texts: DataFrame) -> DataFrame:
    """Texts with two 64-bit keys; what is equal in both is the same text."""
    return texts.select(F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit("#")).alias("k2"), "text")


def _first_ranks(texts: DataFrame, unit: Unit) -> DataFrame:
    """The first rank of every anchor."""
    size = unit.ranks()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                for *_, x, hashed, _, _ in anchors(*unit.of(data, offsets), unit):
                    yield pa.RecordBatch.from_arrays([pa.array(hashed(x, x + size).view(np.int64))], names=["rank"])

    return texts.mapInArrow(run, "rank long")


def _positions(keyed: DataFrame, unit: Unit, repeated: np.ndarray) -> DataFrame:
    """(rank, k1, k2, start, starts, following, context) of the anchors whose first rank may be repeated.

    ``following``: names of the strings by which each round makes ranks longer;
    ``context``: name of the union of the anchor's strings.
    """
    held = keyed.sparkSession.sparkContext.broadcast(repeated)
    sizes, length = unit.ranks(), unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in slices(batch.column("text")):
                data, offsets = unit.of(data, offsets)
                for text, first, last, x, hashed, part, low in anchors(data, offsets, unit):
                    rank = hashed(x, x + sizes[0])
                    some = np.flatnonzero(maybe_in(held.value, rank))
                    if not len(some):
                        continue
                    text, first, last, x, rank = (a[some] for a in (text, first, last, x, rank))
                    follow = np.stack([hashed(x + a, x + b) for a, b in zip(sizes, sizes[1:], strict=False)] or [rank], axis=1)
                    del hashed
                    with np.errstate(over="ignore"):
                        context = mix(Hasher(part, 4)(first - low, last - low + length) + (x + low - first).astype(np.uint64) * _LEN)
                    flat = pa.array(np.ascontiguousarray(follow).view(np.int64).ravel())
                    rows = pa.array(text + begin)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rank.view(np.int64)),
                            batch.column("k1").take(rows),
                            batch.column("k2").take(rows),
                            pa.array(first - offsets[text]),
                            pa.array(last - first + 1),
                            pa.FixedSizeListArray.from_arrays(flat, follow.shape[1]).cast(pa.list_(pa.int64())),
                            pa.array(context.view(np.int64)),
                        ],
                        names=["rank", "k1", "k2", "start", "starts", "following", "context"],
                    )

    return keyed.mapInArrow(run, "rank long, k1 long, k2 long, start long, starts long, following array<long>, context long")


def _contexts(rows: DataFrame, unit: Unit) -> DataFrame:
    """(r1, r2, context): the bytes of an anchor's strings, or their words' hashes, cut from its text."""
    length, size = unit.length, unit.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                body = np.frombuffer(texts[i].as_py(), np.uint8)
                view = memoryview(unit.of(body, np.array([0, len(body)]))[0]).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["r1"] for w in wanted], pa.int64()),
                        pa.array([w["r2"] for w in wanted], pa.int64()),
                        pa.array([bytes(view[w["start"] * size : (w["start"] + w["starts"] + length - 1) * size]) for w in wanted], pa.binary()),
                    ],
                    names=["r1", "r2", "context"],
                )

    return rows.mapInArrow(run, "r1 long, r2 long, context binary")


def _strings(contexts: pa.Array, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place within its context, two names) of every string of the wanted length."""
    length = unit.length
    flat = contexts.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64, flat.offset + len(flat) + 1)[flat.offset :]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]) // unit.size
    if unit.size > 1:
        data = np.frombuffer(data.tobytes(), np.uint64)
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] + place
    return row, place, Hasher(data, 5)(at, at + length), Hasher(data, 6)(at, at + length)


def _runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of successive places within rows: (row, first, last)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    return row[head], place[head], place[np.concatenate([head[1:], [len(row)]]).astype(np.int64) - 1]


_REPEATS = "r1 long, r2 long, low long, high long"


def _compared_in_tasks(contexts: DataFrame, groups: int, unit: Unit) -> DataFrame:
    """Runs of repeated strings of each (r1, r2), for ranks with few bytes of strings."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        row, place, one, two = _strings(rows.column("context").chunk(0), unit)
        r1 = rows.column("r1").to_numpy()
        with np.errstate(over="ignore"):
            one = mix(one ^ r1[row].view(np.uint64))
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        i, low, high = _runs(row[again], place[again])
        return pa.table({"r1": r1[i], "r2": rows.column("r2").to_numpy()[i], "low": low, "high": high})

    return contexts.groupBy(F.pmod("r1", F.lit(groups)).alias("g")).applyInArrow(run, _REPEATS)


def _compared_as_rows(contexts: DataFrame, unit: Unit) -> DataFrame:
    """The same for ranks with many bytes of strings: every string is a row, and its name the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, place, one, two = _strings(part.column("context"), unit)
                columns = [part.column(c).to_numpy()[row] for c in ("r1", "r2")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*columns, place, one.view(np.int64), two.view(np.int64))],
                    names=["r1", "r2", "place", "one", "two"],
                )

    strings = materialize(contexts.mapInArrow(run, "r1 long, r2 long, place long, one long, two long"), "strings")
    again = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    return strings.join(again, ["one", "two"]).select("r1", "r2", F.col("place").alias("low"), F.col("place").alias("high"))


def _surviving(positions: DataFrame, unit: Unit) -> DataFrame:
    """(r1, r2, k1, k2, start, starts, agree) of anchors whose ``length - span`` units repeat, by rounds of doubling."""
    alive = positions
    rounds = len(unit.ranks()) - 1
    for k in range(rounds + 1):
        last = k == rounds
        counts = alive.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), *([F.min("context").alias("low"), F.max("context").alias("high")] if last else []))
        kept = counts.where("n > 1").select("rank", *([(F.col("low") == F.col("high")).alias("agree")] if last else []))
        left = alive.join(materialize(kept, "kept"), "rank")  # read anew, so that a rank with very many positions can be split
        if not last:
            left = left.withColumn("rank", F.xxhash64("rank", F.get("following", F.lit(k))))
        alive = materialize(left, f"ranks{k}")
    return alive.select(F.col("rank").alias("r1"), F.col("context").alias("r2"), "k1", "k2", "start", "starts", "agree")


def repeated_starts(texts: DataFrame, unit: Unit = Unit(LENGTH)) -> DataFrame:
    """(k1, k2, starts array of (low, high)): where strings that occur elsewhere start, in units, for each text that has any."""
    length = unit.length
    texts = texts.where(f"octet_length(text) >= {unit.least_bytes()}")
    keyed = _keyed(texts)
    ranks = _first_ranks(texts.select("text"), unit).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    repeated = key_bitmap(ranks.where("n > 1").select("rank"))
    found = _surviving(materialize(_positions(keyed, unit, repeated), "positions"), unit)
    whole = found.where("agree").select("k1", "k2", F.col("start").alias("low"), F.expr("start + starts - 1").alias("high"))

    mixed = found.where("not agree")
    place = F.struct("k1", "k2", "start", "starts")
    covers = materialize(
        mixed.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "covers"
    )
    size = covers.groupBy("r1").agg(F.sum((F.col("at.starts") + (length - 1)) * unit.size).alias("bytes"))
    many = size.where(F.col("bytes") > 8 * GROUP_BYTES).select("r1", F.lit(True).alias("many"))
    asked = covers.select("r1", "r2", "at.k1", "at.k2", "at.start", "at.starts")
    wanted = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("r1", "r2", "start", "starts")).alias("wanted"))
    once = with_keys_maybe_in(keyed, "k1", asked.select("k1")).dropDuplicates(["k1", "k2"])
    cut = _contexts(once.join(wanted, ["k1", "k2"]), unit)
    contexts = materialize(cut.join(many, "r1", "left"), "contexts")
    total = size.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    repeats = _compared_in_tasks(contexts.where("many is null"), max(1, total // GROUP_BYTES), unit).union(
        _compared_as_rows(contexts.where("many").drop("many"), unit)
    )
    twice = covers.where("n > 1").select("r1", "r2").join(
        mixed.select("r1", "r2", "k1", "k2", "start", "starts"), ["r1", "r2"]
    )
    parts = mixed.join(repeats, ["r1", "r2"]).select(
        "k1", "k2", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")
    )
    every = whole.union(twice.select("k1", "k2", F.col("start").alias("low"), F.expr("start + starts - 1").alias("high"))).union(parts)
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("starts"))


def _merged(starts: list[dict] | None, length: int) -> list[list[int]]:
    """Maximal spans covered by the strings of these starts."""
    merged: list[list[int]] = []
    for low, high in sorted((x["low"], x["high"] + length) for x in starts or ()):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return merged


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, found: str = "repeats", passage: int = PASSAGE) -> DataFrame:
    """``docs`` with a struct column ``found``: n_bytes, n_removed, n_spans, spans (byte ranges), kept (the rest, as bytes), n_shared_words, passages (word ranges).

    A byte goes if a string of ``length`` bytes that covers it starts at another
    place too, in the same or another row; strings are judged on the input. A
    null or short text is kept as it is (null: empty); repeated rows repeat each
    other's strings. ``passages`` are the words covered by a run of ``passage``
    words that starts at another place too, be it shorter than ``length`` bytes
    (A-Z lower-cased, any spaces between); they are told, and nothing but what
    strings of bytes cover is removed. All rows and columns stay, whatever the columns' names; a
    column already called ``found`` is refused. No rows give no rows.
    """
    if found in docs.columns:
        raise ValueError(f"documents already have a column {found!r}")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bodies = docs.select(body.alias("text"))
    with scratch() as keep:
        in_words = keep(materialize(repeated_starts(bodies, words_unit(passage)).withColumnRenamed("starts", "words"), "words"))
    with scratch() as keep:
        in_bytes = repeated_starts(bodies, Unit(length))
        starts = keep(materialize(in_bytes.join(in_words, ["k1", "k2"], "full"), "starts"))
    spans = "array<struct<s:long,e:long>>"
    kind = f"struct<n_bytes:long,n_removed:long,n_spans:long,spans:{spans},kept:binary,n_shared_words:long,passages:{spans}>"
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(body).alias("k1"), F.xxhash64(body, F.lit("#")).alias("k2"))
    some = with_keys_maybe_in(held, "k1", starts.select("k1")).join(starts, ["k1", "k2"]).select("row", "starts", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_bytes", "n_removed", "n_spans", "spans", "kept", "n_shared_words", "passages")
        ranges = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), ranges, pa.binary(), pa.int64(), ranges)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                columns = (part.column("row").field(text).cast(pa.binary()), part.column("starts"), part.column("words"))
                for body, at_bytes, at_words in zip(*(c.to_pylist() for c in columns), strict=True):
                    gone, shared = _merged(at_bytes, length), _merged(at_words, passage)
                    edges = [0, *(x for m in gone for x in m), len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    n_shared = sum(e - s for s, e in shared)
                    gone, shared = ([{"s": s, "e": e} for s, e in x] for x in (gone, shared))
                    rows.append((len(body), len(body) - len(kept), len(gone), gone, kept, n_shared, shared))
                struct = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))
                yield pa.RecordBatch.from_arrays([part.column("row"), struct], names=["row", "found"])

    cut = some.mapInArrow(run, some.select("row", F.lit(None).cast(kind).alias("found")).schema)
    passed = with_keys_maybe_in(held, "k1", starts.select("k1"), True)  # only what the key filter lets pass needs the anti join
    unsure = passed.where("_maybe").join(starts.select("k1", "k2"), ["k1", "k2"], "left_anti")
    whole = F.coalesce(F.col("row").getField(text), F.lit(""))
    rest = passed.where("not _maybe").select("row").union(unsure.select("row")).select(
        "row",
        F.struct(
            F.octet_length(whole).cast("long").alias("n_bytes"),
            F.lit(0).cast("long").alias("n_removed"),
            F.lit(0).cast("long").alias("n_spans"),
            F.array().cast(spans).alias("spans"),
            whole.cast("binary").alias("kept"),
            F.lit(0).cast("long").alias("n_shared_words"),
            F.array().cast(spans).alias("passages"),
        ).alias("found"),
    )
    return cut.union(rest).select("row.*", F.col("found").alias(found))


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, for strings of 400 bytes.

    One row for each row; a null text has 0 bytes, repeated rows lose what they
    share, every copy of it. No rows give no rows.
    """
    return op8_with_passages(docs).drop("n_shared_words")


def op8_with_passages(docs: DataFrame) -> DataFrame:
    """op8_suffix_dedup, and n_shared_words: words in passages of 50 words or more that stand elsewhere too, whatever their bytes."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"), "repeats.n_shared_words"
    )
