"""Quality classifier by co-training.

Two views of a page are learned apart: its text (hashed word counts, size and
character-class shares) and its metadata (source, language, recorded length).
In each round either classifier names, among all documents (their own labels
unread), those that it is sure of. What they look like in the other view is summed over
the whole corpus in Spark, by class; the other classifier is then fitted to the
labelled rows, drawn towards the direction that separates these sums. Both are
calibrated on labelled rows kept aside, and the mean of the calibrated logits
scores every document.

Only the labelled rows that are fitted to are a sample, of ``max_rows`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import NOT_SPACE, mix, slices, words

TEXT_BINS, META_BINS = 512, 64
#: Bytes by class: upper and lower case, digits, four ranges of marks, beyond ASCII, spaces, line ends.
CLASSES = ((65, 90), (97, 122), (48, 57), (33, 47), (58, 64), (91, 96), (123, 126), (128, 255), (32, 32), (10, 10))
TEXT_WIDTH, META_WIDTH = TEXT_BINS + 3 + len(CLASSES), META_BINS + 1


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text view, metadata view) of a batch with text, source, lang and n_chars."""
    texts = [np.zeros((0, TEXT_WIDTH), np.float32)]
    for begin, end, data, offsets in slices(batch.column("text")):
        n = end - begin
        hashed, first = words(data, offsets, NOT_SPACE)
        count = np.diff(first)
        of = np.repeat(np.arange(n), count)
        view = np.zeros((n, TEXT_WIDTH), np.float32)
        bins = np.bincount(of * TEXT_BINS + (hashed % np.uint64(TEXT_BINS)).astype(np.int64), minlength=n * TEXT_BINS)
        bins = np.log1p(bins.reshape(n, TEXT_BINS).astype(np.float32))
        view[:, :TEXT_BINS] = bins * (4 / np.maximum(np.linalg.norm(bins, axis=1, keepdims=True), 1e-6))
        distinct = np.array([len(np.unique(hashed[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
        size = np.diff(offsets)
        view[:, TEXT_BINS] = distinct / np.maximum(count, 1)
        view[:, TEXT_BINS + 1] = np.log1p(size) * 0.4
        view[:, TEXT_BINS + 2] = size / np.maximum(count, 1) * 0.4
        for k, (low, high) in enumerate(CLASSES):
            inside = np.concatenate([[0], np.cumsum((data >= low) & (data <= high), dtype=np.int32)])
            view[:, TEXT_BINS + 3 + k] = (inside[offsets[1:]] - inside[offsets[:-1]]) / np.maximum(size, 1) * 4
        texts.append(view)
    meta = np.zeros((batch.num_rows, META_WIDTH), np.float32)
    for k, name in enumerate(("source", "lang")):
        coded = batch.column(name).dictionary_encode()
        bins = np.array([*(hash_bin(k, x) for x in coded.dictionary.to_pylist()), hash_bin(k, None)], np.int64)
        at = coded.indices.fill_null(len(bins) - 1).to_numpy()
        meta[np.arange(len(meta)), bins[at]] = 1
    meta[:, META_BINS] = np.log1p(np.maximum(batch.column("n_chars").cast(pa.float64()).fill_null(0).to_numpy(), 0)) * 0.4
    return np.concatenate(texts), meta


def tag_hash(kind: int, x: str | None) -> int:
    """64 bits of all bytes of a name and its length; a null is no text's equal."""
    raw = b"" if x is None else x.encode()
    parts = np.frombuffer(raw.ljust(-(-len(raw) // 8) * 8, b"\0"), "<u8").astype(np.uint64)
    value = np.array([2 * kind + (x is None), len(raw)], np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(1, np.uint64)
        for part in (*value, *parts):
            total = mix((total ^ part) + np.uint64(0x9E3779B97F4A7C15))
    return int(total[0])


def hash_bin(kind: int, x: str | None) -> int:
    return tag_hash(kind, x) % META_BINS


class Linear:
    """Logistic regression, fitted by Adam on the full batch; drawn to ``prior`` (coefficients of standardised features) where there is one."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, steps: int = 250) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        aim, pull = (np.zeros(x.shape[1], np.float32), 1e-4) if prior is None else (prior.astype(np.float32), 1e-2)
        self.coef, self.bias = aim.copy(), 0.0
        m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ self.coef + self.bias, -30, 30)))
            g = ((p - y) / len(y)).astype(np.float32)
            step = np.concatenate([g @ z + pull * (self.coef - aim), [g.sum()]])
            m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
            move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.coef = (self.coef - move[:-1]).astype(np.float32)
            self.bias = float(self.bias - move[-1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.coef + self.bias, -30, 30)


def direction(x: np.ndarray, y: np.ndarray, sums: np.ndarray) -> np.ndarray | None:
    """The prior from the sums of taught documents, by class: (count, sum, sum of squares) of each feature.

    The diagonal discriminant of the two classes, scaled by what suits the
    labelled rows; None where a class was never taught.
    """
    n = sums[:, 0, 0]
    if (n < 1).any():
        return None
    mean = sums[:, 1] / n[:, None]
    spread = (sums[:, 2] / n[:, None] - mean**2).clip(0).mean(0)
    scale = x.std(0) + 1e-3
    coef = (mean[1] - mean[0]) * scale / (spread + scale**2 * 0.1)
    a, _ = calibrate(((x - x.mean(0)) / scale) @ coef, y)
    return a * coef


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope (at least 0) and offset by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * logit).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * logit * logit).sum() + 1e-2, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 0.0), b


class CoTrained:
    """The two classifiers, their calibration, and the rows they are fitted to."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray) -> None:
        aside = np.arange(len(y)) % 4 == 0  # rows come in hash order
        self._own, self._target = [v[~aside] for v in views], y[~aside]
        self._aside, self._aside_target = [v[aside] for v in views], y[aside]
        self.models = [Linear(v, self._target) for v in self._own]
        self._calibrate()

    def _calibrate(self) -> None:
        self.scales = [calibrate(m.logit(v), self._aside_target) for m, v in zip(self.models, self._aside, strict=True)]

    def learn(self, sums: list[np.ndarray | None]) -> None:
        """Refit each view with what the other one taught."""
        priors = [None if s is None else direction(x, self._target, s) for x, s in zip(self._own, sums, strict=True)]
        self.models = [m if p is None else Linear(x, self._target, p) for m, x, p in zip(self.models, self._own, priors, strict=True)]
        self._calibrate()

    def scorer(self) -> CoTrained:
        """Without the rows, to be broadcast."""
        out = object.__new__(CoTrained)
        out.models, out.scales = self.models, self.scales
        return out

    def logits(self, views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Calibrated, of each view."""
        return [a * m.logit(v) + b for m, v, (a, b) in zip(self.models, views, self.scales, strict=True)]

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Calibrated probabilities: of the text view, of the metadata view, combined."""
        logits = self.logits(views)
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits, sum(logits) / 2)]


def _sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, by a hash of the id."""
    part = min(1.0, max_rows / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 62)) <= F.lit(part) * float(1 << 62))


def _taught(docs: DataFrame, model: CoTrained, sure: float) -> list[np.ndarray | None]:
    """For each view, (count, sum, sum of squares) by class of the features of all documents that the other view is sure of."""
    held = docs.sparkSession.sparkContext.broadcast(model.scorer())
    bound = float(np.log(sure / (1 - sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, 3, w)) for w in (TEXT_WIDTH, META_WIDTH)]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                views = features(batch.slice(at, 1000))
                logits = held.value.logits(views)
                for k, x in enumerate(views):
                    for c, mine in enumerate((logits[1 - k] < -bound, logits[1 - k] > bound)):
                        some = x[mine].astype(np.float64)
                        sums[k][c, 0] += len(some)
                        sums[k][c, 1] += some.sum(0)
                        sums[k][c, 2] += (some**2).sum(0)
        flat = np.concatenate([s.ravel() for s in sums])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["at", "sum"])

    flat = np.zeros(6 * (TEXT_WIDTH + META_WIDTH))
    for row in docs.mapInArrow(run, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():  # some 3,500 numbers
        flat[row["at"]] = row["sum"]
    return [flat[: 6 * TEXT_WIDTH].reshape(2, 3, TEXT_WIDTH), flat[6 * TEXT_WIDTH :].reshape(2, 3, META_WIDTH)]


_COLUMNS = ("text", "source", "lang", "n_chars")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 8000, rounds: int = 2, sure: float = 0.95) -> CoTrained | None:
    """Fit on a bounded sample of the labelled documents, exchange over all documents; None where the labels hold fewer than two classes.

    Repeated and null ids among the labels: the largest label of an id counts,
    a null id or label doesn't.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y"))
    wanted = _sample(known, max_rows)
    rows = docs.select("doc_id", *_COLUMNS).join(F.broadcast(wanted), "doc_id")  # bounded by max_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = features(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_y"), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (text, meta))],
                names=["id", "y", "text", "meta"],
            )

    key = dict(docs.dtypes)["doc_id"]
    got = rows.withColumn("_y", F.col("_y").cast("int")).mapInArrow(run, f"id {key}, y int, text binary, meta binary").orderBy(F.xxhash64("id"), "id").toPandas()
    views = [np.stack([np.frombuffer(b, np.float32) for b in got[c]]) if len(got) else None for c in ("text", "meta")]
    y = got["y"].to_numpy(np.float64)
    if len(np.unique(y)) < 2 or len(y) < 8:
        return None
    model = CoTrained(views, y)
    for _ in range(rounds):
        model.learn(_taught(docs.select(*_COLUMNS), model, sure))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 8000) -> DataFrame:
    """One row for each row of docs: doc_id, text_score, meta_score, score, good (score of 0.5 or more).

    A null text is empty, a null source or language is a value of its own, a
    null length is 0. Repeated rows get the same scores, as do equal texts of
    the same metadata. With fewer than two classes among the labels there is
    nothing to learn: scores are null and good is null. Other columns play no
    part. No rows give no rows.
    """
    model = train(docs, labels, target, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_COLUMNS)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(None).cast("boolean").alias("good"))
    held = docs.sparkSession.sparkContext.broadcast(model.scorer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                text, meta, both = (s.astype(np.float64) for s in held.value.scores(features(part)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= 0.5)],
                    names=["doc_id", "text_score", "meta_score", "score", "good"],
                )

    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, good boolean")


def op7_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_quality of every document by the labels of quality; nulls, ties, repeated rows and empty tables as there."""
    return score_quality(docs, labels)
