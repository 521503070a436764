"""Passages of 50 words against brute force, and what is left of them."""

import re
from collections import defaultdict

from skyframe.llm.paragraph_dedup import op5_paragraph_dedup

FOLDER = "/root/testdata/sf0.001"
K = 50


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    names = lambda a, n: [f"{a}{i}" for i in range(n)]
    shared = names("same", 55)
    extra = [
        (10**6, " ".join(names("p", 60) + shared + names("q", 80))),  # within a longer line
        (10**6 + 1, "\n".join(" ".join((names("r", 13) + shared + names("s", 70))[i : i + 9]) for i in range(0, 138, 9))),  # over short lines
        (10**6 + 2, "ab " * 200),
        (10**6 + 3, " ".join(names("p", 49))),
        (None, " ".join(shared).upper()),
    ]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).repartition(3)
    rows = sorted(((r.doc_id, _words(r.text)) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    places = defaultdict(list)
    for doc, w in rows:
        for at in range(len(w) - K + 1):
            places[tuple(w[at : at + K])].append((doc, at))
    want, cut = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for doc, at in found:
                want[doc] |= set(range(at, at + K))
                if (doc, at) != found[0]:
                    low = max(at, found[0][1] + K) if doc == found[0][0] else at
                    cut[doc] |= set(range(low, at + K))
    assert cut[10**6 + 1] == set(range(13, 68)) and cut[10**6 + 2] == set(range(50, 200)) and cut[None] == set(range(55)) and not cut[10**6]
    got = op5_paragraph_dedup(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        spans = {i for s in r.cuts for i in range(s.begin, s.end)}
        assert (r.n_shared_words, r.n_cut_words, spans) == (len(want[r.doc_id]), len(cut[r.doc_id]), cut[r.doc_id])
    cuts, left = {r.doc_id: r.cuts for r in got}, set()
    for doc, w in rows:  # no window stands in two places any more
        ends = [0, *(x for s in cuts[doc] for x in (s.begin, s.end)), len(w)]
        for low, high in zip(ends[::2], ends[1::2]):
            for at in range(low, high - K + 1):
                assert tuple(w[at : at + K]) not in left
                left.add(tuple(w[at : at + K]))
