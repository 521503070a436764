"""Each stage of the corpus pipeline against plain Python, on nulls, repeated rows, clashing columns and no rows."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P

EXTRA = ("row", "group", "language", "contamination", "before", "key", "gone", "rank", "_language")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)
COMMON = {
    "en": "the of and to in that with for this from have which they their there been would about when where".split(),
    "de": "der die und das ist nicht mit sich auf dem eine auch nach wird bei aber noch wurde haben oder".split(),
}


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randint(3, 9)))
    vocabulary = [word() for _ in range(900)]

    def prose(lang, n):
        return [rng.choice(COMMON[lang]) if k % 2 else rng.choice(vocabulary) for k in range(n)]

    out = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        out.append([i, " ".join(prose(lang, 60)), lang, f"s{i % 3}"])
    base = out[0][1].split()
    for i, edits in enumerate((0, 1, 2, 4, 9)):  # copies of document 0, ever less near
        copy = list(base)
        for k in range(edits):
            copy[5 + 6 * k] = "changed"
        out.append([100 + i, " ".join(copy).upper() if edits == 1 else " ".join(copy), "en", "s0"])
    out.append([200, "token=abcdef123456 and the " + " ".join(prose("en", 30)) + " AKIA" + "Q7" * 9, "en", None])
    out.append([201, " ".join(prose("en", 40)), None, "s9"])
    out += [[None, out[0][1], "en", "s0"], [300, None, "en", "s1"], [301, "", "en", "s1"], [302, "12 34 !!", None, None], [None, None, None, None]]
    out += [list(out[3]), list(out[3])]
    return [(d, t, lang, s, None if t is None else len(t), *range(len(EXTRA))) for d, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    words = rows[4][1].split()
    items = [("a", " ".join(words[10:24])), ("b", rows[7][1].split()[3] + " nowhere"), ("c", None), ("d", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def test_language_id(spark, docs, rows):
    got = P.language_id(spark, docs, "")
    assert got.columns == docs.columns
    want = Counter(r for r in rows if re.search("[a-z]", _lower(r[1])))
    assert Counter(map(tuple, got.collect())) == want


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup(spark, docs, rows):
    sets = [_sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = Counter(r for i, r in enumerate(rows) if r[0] is None or r[0] == least[find(i)])
    got = P.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == want
    assert 100 not in {r[0] for r in want} and sum(n for r, n in want.items() if r[0] == 3) == 3  # repeated rows stay together


def test_decontaminate(spark, docs, rows, folder):
    at, items = folder
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    windows = set()
    for _, t in items:
        w = split(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def hit(text):
        w = split(text)
        return any(tuple(w[i : i + len(p)]) == p for p in windows for i in range(len(w) - len(p) + 1))

    want = Counter(r for r in rows if not hit(r[1]))
    got = P.decontaminate(spark, docs, at)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == want
    assert 0 < len(rows) - sum(want.values()) < 5


def test_secret_scan(spark, docs, rows):
    got = P.secret_scan(spark, docs, "")
    assert got.columns == docs.columns
    left, right = Counter(map(tuple, got.collect())), Counter(rows)
    (new,) = (left - right).elements()
    (old,) = (right - left).elements()
    want = re.sub(r"token=abcdef123456|AKIA[A-Z0-9]+", "[secret]", old[1])
    assert new[:5] == (200, want, "en", None, len(want)) and new[5:] == old[5:]


def test_mix(spark, docs, rows):
    got = P.mix(spark, docs, "").collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    for s in size:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]} and abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(size.values())) < 1e-6


def test_no_rows(spark, docs, folder):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_all_stages(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "source"] and out.count() > 100
