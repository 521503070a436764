"""Repeated substrings: texts over several segments, and bytes made to defeat polynomial hashes."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from skyframe.llm import suffix_dedup
from skyframe.llm.queries import queries
from skyframe.llm.suffix_dedup import Hasher, op8_suffix_dedup, rank_lengths, remove_repeats


def _thue_morse(order, swap=False):
    return "".join("ab"[(i.bit_count() & 1) ^ swap] for i in range(1 << order))


def test_lengths_double():
    assert rank_lengths(400) == [48, 96, 192, 240]


def test_hashes_tell_thue_morse_strings_apart():
    for order in range(5, 15):
        both = np.frombuffer((_thue_morse(order) + _thue_morse(order, True)).encode(), np.uint8)
        n = 1 << order
        for seed in (3, 4, 5, 6):
            one, two = Hasher(both, seed)(np.array([0, n]), np.array([n, 2 * n]))
            assert one != two


def test_hashes_of_equal_strings_agree():
    data = np.frombuffer(b"xyz" + b"some bytes that repeat" * 2, np.uint8)
    one, two, other = Hasher(data, 3)(np.array([3, 25, 4]), np.array([25, 47, 26]))
    assert one == two != other


def test_texts_longer_than_a_segment(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    shared, seam = noise(700), noise(450)
    size = suffix_dedup.SEGMENT
    long = noise(size - 225) + seam + noise(size - 1000) + shared + noise(5000)  # one string lies over the edge of a segment
    rows = [(1, long), (2, noise(900) + seam + "\u00e9" * 10), (3, shared), (4, shared[:399]), (5, _thue_morse(10)), (6, _thue_morse(10, True))]
    got = {r.doc_id: r for r in op8_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (1150, 2) and got[1].n_bytes == len(long)
    assert (got[2].n_removed, got[2].n_bytes) == (450, 1370)
    assert (got[3].n_removed, got[4].n_removed) == (700, 0)
    # strings of 400 that both hold: by brute force
    a, b = rows[4][1], rows[5][1]
    seen = {}
    for doc, t in ((5, a), (6, b)):
        for i in range(len(t) - 399):
            seen.setdefault(t[i : i + 400], set()).add((doc, i))
    for doc, t in ((5, a), (6, b)):
        gone = set()
        for places in seen.values():
            if len(places) > 1:
                gone |= {k for d, i in places if d == doc for k in range(i, i + 400)}
        assert got[doc].n_removed == len(gone)


def test_clashing_columns_and_nulls(spark):
    names = "doc_id long, text string, row int, k1 int, k2 int, starts int, found int, rank int"
    rows = [(1, "q" * 500, 1, 2, 3, 4, 5, 6), (2, None, None, None, None, None, None, None), (None, "q" * 450, 7, 7, 7, 7, 7, 7)]
    docs = spark.createDataFrame(rows, names)
    out = remove_repeats(docs)
    assert out.columns == [*docs.columns, "repeats"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].repeats.n_removed, got[None].repeats.n_removed, got[2].repeats.n_bytes, got[1].starts) == (500, 450, 0, 4)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP_BYTES, 64])
def test_passages_of_less_than_400_bytes(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    names = lambda a, n: [f"{a}{i}" for i in range(n)]
    shared = names("w", 55)
    assert len(" ".join(shared)) < 250
    extra = [
        (10**6, " ".join(names("p", 60) + shared + names("q", 80))),
        (10**6 + 1, "\n".join(names("r", 13) + shared[:52]) + "  " + " ".join(names("s", 70) + shared[3:])),
        (10**6 + 2, "ab " * 200),
        (10**6 + 3, " ".join(names("p", 49))),
        (10**6 + 4, None),
        (None, " ".join(shared).upper()),
    ]
    docs.union(spark.createDataFrame(extra, docs.schema)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    found, places, want = {}, defaultdict(list), defaultdict(set)
    for doc, text in texts.items():
        found[doc] = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for at in range(len(found[doc]) - 49):
            places[tuple(found[doc][at : at + 50])].append((doc, at))
    for several in places.values():
        for doc, at in several if len(several) > 1 else ():
            want[doc] |= set(range(at, at + 50))
    assert want[10**6] == set(range(60, 115)) and len(want[10**6 + 1]) == 104 and len(want[10**6 + 2]) == 200
    got = queries()["op8_suffix_array_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_shared_words for r in got} == {doc: len(want[doc]) for doc in texts} and len(got) == len(texts)
    assert all(r.n_removed == 0 for r in got if r.doc_id in (10**6, 10**6 + 1, None))
    passages = remove_repeats(spark.createDataFrame(extra, "doc_id long, text string")).where("doc_id = 1000000").first().repeats.passages
    assert [tuple(x) for x in passages] == [(60, 115)]
