"""Repeated paragraphs against brute force over every pair of paragraphs that share a shingle."""

import re
from collections import Counter, defaultdict

from skyframe.llm.paragraph_dedup import op5_paragraph_dedup, repeated_paragraphs

FOLDER = "/root/testdata/sf0.001"


def brute(docs, n=5, percent=80, min_words=20):
    lower = {c: c + 32 for c in range(65, 91)}
    number, seen = {}, []
    for doc, text in sorted(docs):
        for place, line in enumerate((text or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line.translate(lower))
            if len(w) >= min_words:
                s = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
                seen.append((doc, place, number.setdefault(s, len(number))))
    sets, parent, holders, both = list(number), list(range(len(number))), defaultdict(list), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            both.update((j, i) for j in holders[x])
            holders[x].append(i)
    for (i, j), k in both.items():
        if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
            parent[root(i)] = root(j)
    first, gone = {}, defaultdict(list)
    for doc, place, i in seen:
        if first.setdefault(root(i), (doc, place)) != (doc, place):
            gone[doc].append(place)
    return gone


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = repeated_paragraphs(docs).collect()
    assert len(got) == docs.count() and any(want.values())
    assert all(r.removed == want.get(r.doc_id, []) and r.n_removed == len(r.removed) for r in got)


def test_copies_that_differ_in_case_and_spaces(spark):
    line = " ".join(f"word{i}" for i in range(30))
    rows = [(1, line), (2, line.upper().replace(" ", "\t ")), (3, "short\n\n" + line + "\n" + line), (None, line), (4, None), (5, ""), (6, "\n\n")]
    got = {r.doc_id: r for r in repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].removed for i in (1, 2, 3, None, 4, 5, 6)] == [[], [0], [2, 3], [0], [], [], []]
    assert [got[i].n_paragraphs for i in (1, 2, 3, None, 4, 5, 6)] == [1, 1, 3, 1, 0, 0, 0]


def test_short_lines_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    seven = "one two three four five six seven eight nine"  # five shingles, six with one word more: similarity 5/6
    extra = [(10**6, f"{seven}\nagain\nten small words stand here"), (10**6 + 1, f"AGAIN\n{seven} ten\n\nten small words  stand here")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    seen, holders, both = [], defaultdict(list), Counter()
    for r in sorted(docs.collect()):
        for place, line in enumerate((r.text or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
            if w:
                seen.append((r.doc_id, place, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))))
    sets = list(dict.fromkeys(s for _, _, s in seen))
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, s in enumerate(sets):
        for x in s:
            both.update((j, i) for j in holders[x])
            holders[x].append(i)
    for (i, j), k in both.items():
        if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
            root[find(sets[i])] = find(sets[j])
    first, want = {}, defaultdict(list)
    for doc, place, s in seen:
        if first.setdefault(find(s), (doc, place)) != (doc, place):
            want[doc].append(place)
    assert want[10**6 + 1] == [0, 1, 3]
    got = op5_paragraph_dedup(docs).collect()
    assert len(got) == docs.count() and all(r.removed == want.get(r.doc_id, []) for r in got)
