"""The quality classifier: metadata told apart by whole names, separate views, exchange over all documents, held-out accuracy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyframe.llm.quality import META_BINS, CoTrained, _taught, features, score_quality, tag_hash, train


def test_names_with_a_common_start():
    names = ["common_crawl", "common_voice", "common_corpus", "common", "common\0", "", None, "None"]
    assert len({tag_hash(k, x) for k in (0, 1) for x in names}) == 2 * len(names)
    sources = [f"https://example.org/dump/{i}" for i in range(300)]
    batch = pa.record_batch([["a b"] * 300, sources, ["en"] * 300, [3] * 300], names=["text", "source", "lang", "n_chars"])
    assert features(batch)[1][:, :META_BINS].any(0).sum() > META_BINS // 2
    one = pa.record_batch([pa.array(["a", "a"]), pa.array(["None", None]), pa.array(["en", "en"]), pa.array([1, 1])], names=["text", "source", "lang", "n_chars"])
    meta = features(one)[1][:, :META_BINS]
    assert (meta[0] != meta[1]).any()


def _batch(texts, sources, lengths):
    n = len(texts)
    return pa.record_batch([pa.array(texts, pa.string()), pa.array(sources, pa.string()), pa.array(["en"] * n), pa.array(lengths, pa.int64())], names=["text", "source", "lang", "n_chars"])


def test_views_are_separate():
    text, meta = features(_batch(["some words", "some words", "other, longer words", None], ["a", "b", "a", "a"], [10, 500, 10, None]))
    assert (text[0] == text[1]).all() and (meta[0] != meta[1]).any() and (meta[0] == meta[2]).all() and (text[0] != text[2]).any()


def test_what_is_taught_is_summed_over_all_documents(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 20))
    bad = lambda: " ".join(rng.choice(["spam", "buy", "now", "click"], 20))
    texts = [good() if k % 2 else bad() for k in range(80)]
    views = features(_batch(texts, ["s1" if k % 2 else "s0" for k in range(80)], [9] * 80))
    model = CoTrained(list(views), np.arange(80) % 2.0)
    rows = [(good(), "s1", "en", 9)] * 30 + [(bad(), "s0", "en", 9)] * 50
    docs = spark.createDataFrame(rows, "text string, source string, lang string, n_chars long").repartition(5)
    text, meta = _taught(docs, model, 0.6)
    x = features(_batch([r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows]))
    assert text[:, 0, 0].tolist() == [50, 30] and meta[:, 0, 0].tolist() == [50, 30]
    assert np.allclose(text[1, 1], x[0][:30].sum(0), atol=1e-3) and np.allclose(meta[0, 2], (x[1][30:80] ** 2).sum(0), atol=1e-3)


def test_accuracy_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    got = score_quality(docs, labels.where(~aside)).join(labels.where(aside).select("doc_id", "quality"), "doc_id").toPandas()
    n, right = len(got), lambda c: ((got[c] >= 0.5) == (got.quality == 1)).mean()
    majority = max((got.quality == 1).mean(), (got.quality == 0).mean())
    assert n >= 80 and right("score") >= 0.93 and right("score") > majority and right("text_score") > majority and right("meta_score") >= majority - 0.05


def test_sampling_keeps_its_bound_and_its_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id % 7, ' x') AS text", "'s' AS source", "'en' AS lang", "3L AS n_chars")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 7 < 3 AS int) AS quality")
    model = train(docs, labels, max_rows=400, rounds=1)
    assert 300 < len(model._target) + len(model._aside_target) < 500
