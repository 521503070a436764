"""Language identification with spans.

Words are runs of letters of one script. The script leaves only the languages
seen with it in training as candidates; character trigrams score a word in each
of them; Viterbi with a penalty for every switch labels the words of a text.
Training counts come from a bounded sample of labelled rows, scoring covers
every word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashable
from .textbytes import slices

BINS = 1 << 16
SWITCH_PENALTY = 12.0
OFF_SCRIPT = -30.0
UNKNOWN = "und"
#: Unicode block ranges of scripts (first, last, script number); other letters are script 0.
SCRIPTS = (
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xFF21, 0xFF5A, 1),  # Latin
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x0400, 0x052F, 3), (0x1C80, 0x1C8F, 3), (0x2DE0, 0x2DFF, 3),  # Cyrillic
    (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5), (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6),  # Armenian, Hebrew, Arabic
    (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0A00, 0x0A7F, 9), (0x0A80, 0x0AFF, 10),  # Devanagari to Gujarati
    (0x0B80, 0x0BFF, 11), (0x0C00, 0x0C7F, 12), (0x0E00, 0x0E7F, 13), (0x10A0, 0x10FF, 14),  # Tamil, Telugu, Thai, Georgian
    (0x1200, 0x137F, 15), (0x3040, 0x30FF, 16), (0x1100, 0x11FF, 17), (0xAC00, 0xD7AF, 17),  # Ethiopic, Kana, Hangul
    (0x3400, 0x4DBF, 18), (0x4E00, 0x9FFF, 18), (0x20000, 0x3134F, 18),  # Han
)
N_SCRIPTS = 19


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: script number plus 1 for letters, 0 for others; lower case (where it is one code point)."""
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    numbers = np.ones(0x110000, np.uint8)
    for first, last, n in SCRIPTS:
        numbers[first : last + 1] = n + 1
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            script[i] = numbers[i]
            if len(x := c.lower()) == 1:
                lower[i] = ord(x)
    return script, lower


class Words:
    """The words of a run of texts: starts, ends (code points within the run), script, first word of each text, trigram bins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        script_of, lower = _tables()
        lead = (data & 0xC0) != 0x80  # the bytes that begin a code point
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
        self.text_at = place[offsets]
        script = script_of[points]
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[self.text_at] = True
        edge[1:n] |= script[1:] != script[:-1]
        edge[0] = edge[n] = True
        bounds = np.flatnonzero(edge)
        inside = script[bounds[:-1]] > 0 if n else np.zeros(0, bool)
        self.starts, self.ends = bounds[:-1][inside], bounds[1:][inside]
        self.script = script[self.starts] - 1 if n else np.zeros(0, np.uint8)
        self.first = np.searchsorted(self.starts, self.text_at)
        self.letters = self.ends - self.starts
        c0 = lower[points]
        c1 = np.concatenate([[0], c0[:-1]]).astype(np.uint32)[:n]
        c1[self.starts] = 0
        c2 = np.concatenate([[0], c1[:-1]]).astype(np.uint32)[:n]
        c2[self.starts] = 0
        letter = script > 0
        self.bins = self._bin(c2[letter], c1[letter], c0[letter])
        self.at = np.cumsum(self.letters) - self.letters  # first bin of each word
        last = self.ends - 1
        self.end_bins = self._bin(c1[last], c0[last], np.uint32(0x10FFFF))

    @staticmethod
    def _bin(a, b, c) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
            return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


class Model:
    """Log-probability of each bin in each language, and which languages a script leaves."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        smooth = counts + 0.5
        logs = np.log(smooth / smooth.sum(1, keepdims=True))
        self.logs = np.ascontiguousarray((logs - logs.max(0, initial=-np.inf)).astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        seen = share >= 0.001
        seen[:, ~seen.any(0)] = True  # a script nobody has leaves all
        self.off = np.where(seen, 0.0, OFF_SCRIPT).astype(np.float32)

    def scores(self, words: Words) -> np.ndarray:
        out = np.empty((len(words.starts), len(self.langs)), np.float32)
        for i, logs in enumerate(self.logs):
            if len(out):
                out[:, i] = np.add.reduceat(logs[words.bins], words.at) + logs[words.end_bins] + self.off[i][words.script]
        return out

    def label(self, words: Words) -> np.ndarray:
        """The language number of every word, by Viterbi within each text."""
        scores, first = self.scores(words).astype(np.float64), words.first
        count = np.diff(first)
        text = np.repeat(np.arange(len(count)), count)
        total = np.stack([np.bincount(text, scores[:, k], len(count)) for k in range(scores.shape[1])], axis=1)
        best = total.argmax(1)
        labels = best[text]
        # One language is the best path where no run of words gains half a penalty under another.
        mixed = np.zeros(len(count), bool)
        if len(text):
            own = scores[np.arange(len(text)), labels]
            for k in range(scores.shape[1]):
                gain = np.cumsum(scores[:, k] - own)
                before = np.concatenate([[0.0], gain[:-1]])
                far = (gain.max() - gain.min()) + abs(gain).max() + 1.0
                low = np.minimum.accumulate(before - text * far) + text * far
                mixed[text[gain - low > SWITCH_PENALTY / 2]] = True
        if mixed.any():
            self._viterbi(scores, first, np.flatnonzero(mixed), labels)
        return labels

    def _viterbi(self, scores: np.ndarray, first: np.ndarray, texts: np.ndarray, labels: np.ndarray) -> None:
        """All given texts in step, longest first; step t handles word t of each that has one."""
        count = first[texts + 1] - first[texts]
        order = np.argsort(-count, kind="stable")
        texts, count = texts[order], count[order]
        live = np.searchsorted(-count, -np.arange(count[0]), "left")  # texts with more than t words
        begin = np.concatenate([[0], np.cumsum(live)])
        t = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rank = np.repeat(np.arange(len(texts)), count)
        word = np.repeat(first[texts], count) + t
        slot = begin[t] + rank
        at = np.empty(len(word), np.int64)
        at[slot] = word
        stepped = scores[at]
        came = np.empty(stepped.shape, bool)
        source = np.empty(len(at), np.int16)
        value = np.zeros((len(texts), scores.shape[1]))
        for k in range(len(live)):
            a, b = begin[k], begin[k + 1]
            v = value[: live[k]]
            top = v.argmax(1)
            jump = v[np.arange(len(v)), top] - (SWITCH_PENALTY if k else 0.0)
            source[a:b] = top
            came[a:b] = v < jump[:, None]
            np.maximum(v, jump[:, None], out=v)
            v += stepped[a:b]
        state = value.argmax(1)
        out = np.empty(len(at), np.int64)
        for k in range(len(live) - 1, -1, -1):
            a, b = begin[k], begin[k + 1]
            s = state[: live[k]]
            out[a:b] = s
            if k:
                switch = came[a:b][np.arange(len(s)), s]
                state[: live[k]] = np.where(switch, source[a:b], s)
        labels[at] = out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 4000, max_langs: int = 256) -> Model:
    """Fit on at most about ``per_lang`` rows of each language, chosen by a hash of the whole row, so that copies of a text are chosen apart.

    Rows with a null text or language are left out. Without any row the model
    knows no language.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(*hashable(labelled)).alias("at")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than max_langs={max_langs} languages")
    langs = sorted(sizes)
    number = {x: i for i, x in enumerate(langs)}
    counts, scripts = np.zeros((len(langs), BINS)), np.zeros((len(langs), N_SCRIPTS))
    if not langs:
        return Model([], np.zeros((0, BINS)), np.zeros((0, N_SCRIPTS)))
    keep = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / sizes[k])))])
    chosen = rows.where(F.pmod("at", F.lit(1 << 62)) <= F.element_at(keep, F.col("lang")) * float(1 << 62)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, seen = np.zeros((len(langs), BINS), np.int64), np.zeros((len(langs), N_SCRIPTS), np.int64)
        for batch in batches:
            of = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for begin, end, data, offsets in slices(batch.column(0)):
                w = Words(data, offsets)
                lang_of = np.repeat(of[begin:end], np.diff(w.first))
                for i in range(len(langs)):
                    mine = lang_of == i
                    bins[i] += np.bincount(w.bins[np.repeat(mine, w.letters)], minlength=BINS)
                    bins[i] += np.bincount(w.end_bins[mine], minlength=BINS)
                    seen[i] += np.bincount(w.script[mine], w.letters[mine], minlength=N_SCRIPTS).astype(np.int64)
        both = np.concatenate([bins, seen], axis=1)
        i, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(both[i, b])], names=["i", "b", "n"])

    summed = chosen.mapInArrow(count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # at most (BINS + N_SCRIPTS) rows a language
        if r["b"] < BINS:
            counts[r["i"], r["b"]] = r["n"]
        else:
            scripts[r["i"], r["b"] - BINS] = r["n"]
    return Model(langs, counts, scripts)


def identify_languages(docs: DataFrame, model: Model, text: str = "text", found: str = "language") -> DataFrame:
    """``docs`` with a struct column ``found``: lang, score, spans (s, e, lang in code points, end exclusive).

    ``lang`` is the language with the most letters, ties going to the first in
    order; ``score`` its share of the letters. A null text, or one without a
    letter, is ``und`` with score 0 and no spans, as is any text if the model
    knows no language. All rows and columns stay; a column already called
    ``found`` is refused.
    """
    if found in docs.columns:
        raise ValueError(f"documents already have a column {found!r}")
    held = docs.sparkSession.sparkContext.broadcast(model)
    spec = "struct<lang:string,score:double,spans:array<struct<s:int,e:int,lang:string>>>"
    kind = pa.struct(
        [
            ("lang", pa.string()),
            ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("lang", pa.string())]))),
        ]
    )

    def label(m: Model, texts: pa.Array) -> Iterator[pa.Array]:
        """The structs of the texts, a slice at a time."""
        names = pa.array([*m.langs, UNKNOWN], pa.string())
        for begin, end, data, offsets in slices(texts):
            n = end - begin
            if not m.langs:
                none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind.field("spans").type.value_type))
                yield pa.StructArray.from_arrays([pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), none], fields=list(kind))
                continue
            w = Words(data, offsets)
            labels = m.label(w)
            text_of = np.repeat(np.arange(n), np.diff(w.first))
            share = np.bincount(text_of * len(m.langs) + labels, w.letters, n * len(m.langs)).reshape(n, len(m.langs))
            letters, top = share.sum(1), share.argmax(1)
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(labels)) - 1 if len(labels) else heads
            base = w.text_at[text_of[heads]]
            each = [pa.array((w.starts[heads] - base).astype(np.int32)), pa.array((w.ends[tails] - base).astype(np.int32)), names.take(pa.array(labels[heads]))]
            spans = pa.StructArray.from_arrays(each, fields=list(kind.field("spans").type.value_type))
            bounds = pa.array(np.searchsorted(text_of[heads], np.arange(n + 1)).astype(np.int32))
            some = letters > 0
            score = np.divide(share[np.arange(n), top], letters, out=np.zeros(n), where=some)
            yield pa.StructArray.from_arrays(
                [names.take(pa.array(np.where(some, top, len(m.langs)))), pa.array(score), pa.ListArray.from_arrays(bounds, spans)], fields=list(kind)
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows in label(held.value, batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*batch.schema.names, found])
                at += len(rows)

    schema = docs.limit(0).withColumn(found, F.lit(None).cast(spec)).schema
    return docs.mapInArrow(run, schema)


def _bucket(doc_id):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op10_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out.

    A row without id is neither held out nor learned from.
    """
    model = train(docs.where(_bucket("doc_id") != 0))
    named = docs.select("doc_id", "text")
    return identify_languages(named, model).select(
        "doc_id",
        F.coalesce(_bucket("doc_id") == 0, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
