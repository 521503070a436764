"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is sketched in 128 buckets; a bucket keeps
its smallest hash in 16 bits, as a leading-zero count and 10 mantissa bits (an
empty bucket borrows a register that is filled). Bands of registers propose
candidates, a collision-corrected Jaccard estimate thins them out, and the
full sets of the texts confirm each link.

Documents with equal sets are one class from the start, so exact copies never
pair up. In each band bucket the classes are first compared with one hub; only
classes still in different components are then compared with each other, in
blocks of bounded size, so that no row is made for a pair of a large group and
no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, scratch, with_keys_maybe_in
from .textbytes import NOT_SPACE, mix, shingles, slices, stream, words

BUCKETS, BUCKET_BITS, MANTISSA = 128, 7, 10
#: 32 bands of 4 registers: a pair of similarity 0.8 meets in none with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
#: The estimate may fall so many standard deviations short of the threshold.
SIGMAS = 6.0
EMPTY = 65535
#: Classes that a task compares with as many others at a time.
CHUNK = 512
#: Members of their sets, so that long texts make smaller chunks.
CHUNK_SHINGLES = 1 << 20
#: Pairs whose registers are compared in one step.
PAIRS = 32768


@lru_cache(maxsize=4)
def _borrow_order(buckets: int) -> np.ndarray:
    """For each bucket, the others in a fixed pseudo-random order."""
    return np.stack([np.argsort(stream(1000 + j, buckets), kind="stable") for j in range(buckets)])


def plain_registers(sorted_sets: list[np.ndarray], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(registers, whether filled) of sets of 64-bit hashes, each sorted; EMPTY where nothing fell in."""
    low = np.zeros((len(sorted_sets), 1 << bits), np.uint64)
    filled = np.zeros((len(sorted_sets), 1 << bits), bool)
    bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    numbers = np.arange(1 << bits, dtype=np.uint64)
    for i, s in enumerate(sorted_sets):
        if len(s):
            at = np.searchsorted(s, bounds)
            low[i] = s[np.minimum(at, len(s) - 1)]
            filled[i] = (at < len(s)) & (low[i] >> np.uint64(64 - bits) == numbers)
    rest = low << np.uint64(bits)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)  # leading zeros, 53 at most
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(filled, (zeros << np.uint64(MANTISSA)) + mantissa, EMPTY).astype(np.uint16), filled


def registers(sorted_sets: list[np.ndarray], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(registers, borrowed registers) of sets of 64-bit hashes, each sorted.

    In the second array, empty buckets take the register of another bucket
    (optimal densification), so that bands work for small sets as well.
    """
    reg, filled = plain_registers(sorted_sets, bits)
    dense = reg.copy()
    holes = np.flatnonzero(~filled.all(1) & filled.any(1))
    for j, order in enumerate(_borrow_order(1 << bits)):
        short = holes[~filled[holes, j]]
        dense[short, j] = reg[short, order[filled[short][:, order].argmax(1)]]
    return reg, dense


def band_keys(dense: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band: its registers (four at most) and its number, mixed."""
    each = dense[:, : bands * rows].reshape(len(dense), bands, rows).astype(np.uint64)
    packed = np.zeros((len(dense), bands), np.uint64)
    for k in range(rows):
        packed |= each[:, :, k] << np.uint64(16 * k)
    with np.errstate(over="ignore"):
        return mix(packed ^ stream(5, bands)[None, :])


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a bucket's registers of two disjoint sets of n and m elements agree.

    The minimum of n elements over b buckets has density n/b exp(-nx/b); within
    an octave of leading zeros, cells are 2**-(zeros + 1 + MANTISSA) wide.
    """
    n, m = n.astype(np.float64) / BUCKETS, m.astype(np.float64) / BUCKETS
    total = np.zeros(len(n))
    for z in range(40):
        total += 2.0 ** -(z + 1 + MANTISSA) * (np.exp(-(n + m) * 2.0 ** -(z + 1)) - np.exp(-(n + m) * 2.0**-z))
    return total * n * m / np.maximum(n + m, 1e-9)


def plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the corrected estimate leaves a similarity of ``threshold`` possible."""
    any_ = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(1), 1)
    ratio = ((a == b) & (a != EMPTY)).sum(1) / any_
    least = threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / any_)
    keep = np.flatnonzero(ratio >= least)  # the correction only lowers the estimate
    if not len(keep):
        return np.zeros(len(ratio), bool)
    chance = expected_collisions(n[keep], m[keep])
    out = np.zeros(len(ratio), bool)
    out[keep] = (ratio[keep] - chance) / (1 - chance) >= least[keep]
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    runs, start = shingles(*words(data, offsets, NOT_SPACE), n)
    return [np.unique(runs[start[i] : start[i + 1]]) for i in range(len(start) - 1)]


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: two sums of mixed members."""
    members = np.concatenate([np.zeros(0, np.uint64), *sets])
    ends = np.cumsum([0, *map(len, sets)])
    with np.errstate(over="ignore"):
        one, two = (
            np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)])[ends])
            for x in (members + np.uint64(1), members ^ np.uint64(0xD6E8FEB86659FD93))
        )
    return one.view(np.int64), two.view(np.int64)


def sketch(texts: DataFrame, n: int) -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint), registers, bands of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, end, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                f1, f2 = fingerprints(sets)
                reg, dense = registers(sets)
                keys = band_keys(dense).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(f1),
                        pa.array(f2),
                        pa.array([r.tobytes() for r in reg], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "f1", "f2", "registers", "bands"],
                )

    return texts.mapInArrow(run, "id long, n long, f1 long, f2 long, registers binary, bands array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids whose sizes and registers (if any) leave a link possible, with fingerprints f_a, f_b."""
    sketched = "registers" in classes.columns
    side = lambda x: classes.select(
        F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("f1").alias(f"f_{x}"), *([F.col("registers").alias(f"r_{x}")] if sketched else [])
    )
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    if not sketched:
        return joined.select("a", "b", "f_a", "f_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                reg = [
                    np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in ("r_a", "r_b")
                ]
                n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                keep = pa.array(plausible(reg[0], reg[1], n, m, percent / 100))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).filter(keep) for c in ("a", "b", "f_a", "f_b")], names=["a", "b", "f_a", "f_b"]
                )

    return joined.mapInArrow(run, "a long, b long, f_a long, f_b long")


#: Texts (id, text), or what gives those of some ids.
Texts = DataFrame | Callable[[DataFrame], DataFrame]


def _texts_of(texts: Texts, ids: DataFrame, copies: bool) -> DataFrame:
    """The texts that may be of ids; with ``copies``, one text for each id."""
    used = with_keys_maybe_in(texts, "id", ids) if isinstance(texts, DataFrame) else texts(ids)
    return materialize(used.dropDuplicates(["id"]), "texts") if copies else used


def _verified(pairs: DataFrame, texts: Texts, n: int, percent: int, copies: bool) -> DataFrame:
    """The pairs whose full sets have 100 * |A and B| >= percent * |A or B|."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    used = _texts_of(texts, ids, copies)
    side = lambda x: used.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            f_a, f_b = batch.column("f_a").to_numpy(), batch.column("f_b").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for begin, end, data, offsets in slices(batch.column("t_a")):
                left = shingle_sets(data, offsets, n)
                for low, high, data2, offsets2 in slices(batch.column("t_b").slice(begin, end - begin)):
                    right = shingle_sets(data2, offsets2, n)
                    mine = left[low:high]
                    ok = (fingerprints(mine)[0] == f_a[begin + low : begin + high]) & (
                        fingerprints(right)[0] == f_b[begin + low : begin + high]
                    )  # an id that several texts share: only the class's own text counts
                    for k, (x, y) in enumerate(zip(mine, right, strict=True)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[begin + low + k] = ok[k] and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _units(open_: DataFrame) -> DataFrame:
    """(unit, id, c): the classes of open_ (key, id, size, c, n) that are to be compared together.

    Every class goes to a chunk of about CHUNK classes and CHUNK_SHINGLES set
    members at most, with those that reach the same largest bucket over a
    bucket of theirs; a unit is a pair of
    chunks, with the classes of either that share a bucket. The buckets of a
    large group lie in the same chunks, so a class meets each set of chunks
    once, not once for each bucket.
    """
    largest = open_.groupBy("id").agg(F.max(F.struct("size", "key")).alias("home"))
    label = open_.join(largest, "id").groupBy("key").agg(F.max("home").alias("home"))
    home = open_.join(label, "key").groupBy("id").agg(F.max("home").alias("home"), F.max("n").alias("n")).select("id", "home.key", "n")
    crowd = home.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES))
    chunks = home.join(crowd, "key").select("id", F.xxhash64("key", F.pmod(F.xxhash64("id"), parts)).alias("chunk"))
    placed = open_.select("key", "id", "c").join(chunks, "id")
    met = placed.select("key", F.col("chunk").alias("other")).distinct()
    names = ["s1", "s2", "n_chunks"]  # name a bucket's set of chunks
    named = met.groupBy("key").agg(
        F.bit_xor(F.xxhash64("other")).alias("s1"), F.bit_xor(F.xxhash64("other", F.lit("#"))).alias("s2"), F.count(F.lit(1)).alias("n_chunks")
    )
    others = met.join(named, "key").select(*names, "other").distinct()
    return (
        placed.join(named, "key")
        .select(*names, "chunk", "id", "c")
        .distinct()
        .join(others, names)
        .select(F.xxhash64(F.least("chunk", "other"), F.greatest("chunk", "other")).alias("unit"), "id", "c")
        .distinct()
    )


def _compared(open_: DataFrame, nodes: DataFrame, texts: Texts, n: int, percent: int, copies: bool) -> DataFrame:
    """Links (a, b) that join different components within the buckets of open_ (key, id, size, c).

    Units compare their classes in memory and return a spanning set of links,
    so pairs are never rows.
    """
    units = materialize(_units(open_).join(nodes.select("id", "n", "f1"), "id"), "units")
    used = _texts_of(texts, open_.select("id").distinct(), copies)

    def compare(rows: pa.Table) -> pa.Table:
        unit, ids, comp, f1 = (rows.column(c).to_numpy() for c in ("unit", "id", "c", "f1"))
        sets: list[np.ndarray] = []
        for _, _, data, offsets in slices(rows.column("text").combine_chunks()):
            sets += shingle_sets(data, offsets, n)
        own = np.flatnonzero(fingerprints(sets)[0] == f1)  # an id may stand for several texts
        own = own[np.lexsort((ids[own], unit[own]))]
        own = own[np.concatenate([[True], (np.diff(unit[own]) != 0) | (np.diff(ids[own]) != 0)])[: len(own)]]
        unit, ids, comp, sets = unit[own], ids[own], comp[own], [sets[i] for i in own]
        reg, size = plain_registers(sets)[0], np.array([len(s) for s in sets], np.int64)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(unit) != 0])[: len(unit)])
        met = [np.zeros((0, 2), np.int64)]
        for first, last in zip(heads, np.append(heads[1:], len(unit)), strict=True):
            mine, big = comp[first:last], size[first:last]
            rows_at_once = max(1, PAIRS // (last - first))
            for low in range(0, last - first, rows_at_once):
                i, j = np.nonzero(mine[low : low + rows_at_once, None] != mine[None, :])
                i += low
                fit = (j > i) & (100 * np.minimum(big[j], big[i]) >= percent * np.maximum(big[j], big[i]))
                met.append(np.stack([i[fit], j[fit]], axis=1) + first)
        pair = np.concatenate(met)
        fit = [plausible(reg[p[:, 0]], reg[p[:, 1]], size[p[:, 0]], size[p[:, 1]], percent / 100) for p in (pair[k : k + PAIRS] for k in range(0, len(pair), PAIRS))]
        pair = pair[np.concatenate([np.zeros(0, bool), *fit])]
        out = []
        root = {c: c for c in comp.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for p in np.split(pair, np.flatnonzero(np.diff(unit[pair[:, 0]])) + 1) if len(pair) else []:  # by units
            both = _overlaps(sets, p) if len(p) > 16 else np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in p.tolist()])
            union = size[p[:, 0]] + size[p[:, 1]] - both
            for i, j in p[100 * both >= percent * union].tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[x] = y
                    out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    tasks = max(1, min(100_000, open_.count() // 2048))  # by the work, which a small shuffle hides
    packed = _packed(units)
    return packed.join(used, "id").repartition(tasks, "pack").groupBy("pack").applyInArrow(compare, "a long, b long")


def _packed(units: DataFrame) -> DataFrame:
    """``units`` with a column pack: small units share one call, in packs of about CHUNK classes, a quarter of CHUNK_SHINGLES members; others have their own."""
    weight = units.groupBy("unit").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles"))
    small = F.expr(f"classes <= {CHUNK // 8} and shingles <= {CHUNK_SHINGLES // 64}")
    classes, members = weight.where(small).agg(F.coalesce(F.sum("classes"), F.lit(0)), F.coalesce(F.sum("shingles"), F.lit(0))).first()
    packs = max(1, classes // CHUNK, members // (CHUNK_SHINGLES // 4))
    pack = F.when(small, F.pmod(F.xxhash64("unit"), F.lit(packs))).otherwise(F.col("unit"))
    return units.join(weight.select("unit", pack.alias("pack")), "unit")


def _overlaps(sets: list[np.ndarray], pair: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    used = np.unique(pair)
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, value, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # only hashes that several sets have
    several = count[value] > 1
    owner, value = owner[several], column[value[several]]
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    for low in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(value, (low, low + 4096))
        block = np.zeros((len(used), min(4096, int(column[-1]) + 1 - low)), np.float32)
        block[owner[a:b], value[a:b] - low] = 1
        total += block @ block.T
    return total[place[pair[:, 0]], place[pair[:, 1]]].astype(np.int64)


def linked_components(nodes: DataFrame, banded: DataFrame, texts: Texts, n: int, percent: int, copies: bool = False) -> DataFrame:
    """(node, component) of all linked classes, written: ``nodes`` (id, n, f1, perhaps registers), ``banded`` (id, key), texts (id, text).

    With ``copies``, an id may have many nodes and texts, all of the same set.
    """
    with scratch() as keep:
        return keep(materialize(_linked_components(nodes, banded, texts, n, percent, copies), "components"))


def _linked_components(nodes: DataFrame, banded: DataFrame, texts: Texts, n: int, percent: int, copies: bool) -> DataFrame:
    if copies:  # sizes count classes, not copies
        keys = materialize(banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"), "buckets")
        met = materialize(with_keys_maybe_in(banded, "key", keys).join(keys, "key").select("key", "id").distinct(), "bands")
        sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        shared = materialize(met.join(sizes, "key"), "bands")
        nodes = materialize(with_keys_maybe_in(nodes, "id", shared.select("id")).dropDuplicates(["id"]), "nodes")
    else:
        sizes = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
        shared = materialize(with_keys_maybe_in(banded, "key", sizes.select("key")).join(sizes, "key"), "bands")

    # The hub of a bucket is its member with the most company over all buckets: the least altered copy.
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", -F.col("id"))).alias("top"))
    hubs = hubs.select("key", (-F.col("top.col2")).alias("hub"))
    stars = shared.join(hubs, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialize(_verified(materialize(_estimated(stars, nodes, percent), "stars"), texts, n, percent, copies), "links")
    found = connected_components(links)

    # What is left: classes that share a bucket but no component yet.
    placed = shared.join(found, shared["id"] == found["node"], "left").select(
        "key", "id", "size", F.coalesce("component", "id").alias("c")
    )
    apart = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    open_ = materialize(placed.join(apart.select("key"), "key").join(nodes.select("id", "n"), "id"), "open")
    more = materialize(_compared(open_, nodes, texts, n, percent, copies), "links")
    stars_found = found.select(F.col("node").alias("a"), F.col("component").alias("b"))  # fewer and shorter than the links themselves
    return found if more.isEmpty() else connected_components(stars_found.union(more))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    A set holds the distinct n-word shingles of the text (A-Z lower-cased, a
    shorter text as one); a text without words, or null, has the empty set and
    links with nothing. Rows link where 100 * |A and B| >= percent * |A or B|;
    component_id is the smallest id reachable, kept says whether it is the
    row's own (null-safe). Repeated rows share their result. Rows with a null
    id join the class of their equal sets but no further link.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialize(sketch(texts, n), "sketches")
    classes = materialize(  # one row for each distinct non-empty set
        rows.where("n > 0")
        .groupBy("f1", "f2", "n")
        .agg(F.min("id").alias("id"), F.first("registers").alias("registers"), F.first("bands").alias("bands")),
        "classes",
    )
    named = classes.where("id is not null")
    contracted = linked_components(named, named.select("id", F.explode("bands").alias("key")), texts, n, percent)
    named = classes.select("f1", "f2", F.col("n").alias("k"), F.col("id").alias("rep")).join(
        contracted, F.col("rep") == F.col("node"), "left"
    ).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "k", F.coalesce("component", "rep").alias("component"))
    joined = rows.select("id", "n", "f1", "f2").join(named, F.expr("f1 = g1 and f2 = g2 and n = k"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op2_near_dedup(docs: DataFrame) -> DataFrame:
    """The contract's query: four-word shingles, similarity 0.8."""
    return near_duplicates(docs, n=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 3) AS s FROM d, unnest(generate_series(1, greatest(len(ws) - 3, 1))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""
