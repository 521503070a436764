"""Language ID: Viterbi against a plain version, four languages of several scripts, held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyframe.llm.language_id import SWITCH_PENALTY, Model, Words, identify_languages, op10_language_id, train
from skyframe.llm.textbytes import slices

COMMON = {
    "en": "the of and to in that with for this from have which they their there been would about when where",
    "de": "der die und das ist nicht mit sich auf dem eine auch nach wird bei aber noch wurde haben oder",
    "el": "και το να του της με που την από για είναι στο των τον τα δεν θα τη μας ένα",
    "ru": "и в не на что он как это она по но они мы все так его только было от меня",
}


def _plain(scores):
    """Best labels by the textbook recursion."""
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        step = best[:, None] - SWITCH_PENALTY * (1 - np.eye(len(best)))
        back.append(step.argmax(0))
        best = step.max(0) + row
    state, value = int(best.argmax()), best.max()
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1], value


def _value(scores, labels):
    return sum(s[k] for s, k in zip(scores, labels, strict=True)) - SWITCH_PENALTY * sum(a != b for a, b in zip(labels, labels[1:]))


def test_fast_labels_are_as_good_as_plain_viterbi():
    rng = np.random.default_rng(3)
    model = Model(["a", "b", "c"], rng.integers(0, 40, (3, 1 << 16)).astype(float), np.ones((3, 19)))
    letters = random.Random(1)
    texts = [" ".join("".join(letters.choice("abcdefgh") for _ in range(letters.randint(1, 8))) for _ in range(n)) for n in (1, 2, 7, 40, 200, 3, 60)]
    for _, _, data, offsets in slices(pa.array([*texts, "", None, "12 !"])):
        w = Words(data, offsets)
        labels, scores = model.label(w), model.scores(w).astype(np.float64)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b > a:
                assert abs(_value(scores[a:b], labels[a:b].tolist()) - _plain(scores[a:b])[1]) < 1e-6


def test_four_languages(spark):
    rng = random.Random(2)
    words = {k: v.split() for k, v in COMMON.items()}
    some = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, some(lang, 12), lang) for i, lang in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op10_language_id(docs).collect()
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got) and {r.held_out for r in got} == {True, False}
    mixed = " ".join(some(lang, 15) for lang in ("en", "ru", "de", "el")) + " " + some("en", 20)
    found = identify_languages(spark.createDataFrame([(mixed,), ("",), (mixed * 40,)], "text string"), train(docs)).collect()
    spans = found[0].language.spans
    assert [x.lang for x in spans] == ["en", "ru", "de", "el", "en"] and spans[0].s == 0 and spans[-1].e == len(mixed)
    assert found[0].language.lang == "en" and 0.2 < found[0].language.score < 0.6 and len(found[2].language.spans) > 100


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = op10_language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and text rlike '[a-zA-Z]{20}|([a-z]+ ){5}'")
    n, right = joined.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right / n > 0.98
