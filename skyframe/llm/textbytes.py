"""Words and shingles of Arrow string batches as numpy arrays.

Works on UTF-8 bytes, in slices of bounded size, so that what a task adds to
its Arrow batch does not depend on the batch size. Word classes are sets of bytes: the separators
used here are ASCII, hence splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, offsets) of runs of rows holding about ``limit`` bytes; null texts are empty.

    Only the offsets of the batch are read ahead; of the bytes, one run at a
    time is looked at, and copied only where it holds nulls.
    """
    if not len(texts):
        return
    ends = _offsets(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
        part = texts.slice(at, end - at)
        if part.null_count:
            part = part.fill_null("")
        offsets = _offsets(part).astype(np.int64)
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        yield at, end, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        at = end


def _offsets(texts: pa.Array) -> np.ndarray:
    """The offsets of a string array's rows within its bytes, and the end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind, texts.offset + len(texts) + 1)[texts.offset :]


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    return _powers(1 << max(16, int(size).bit_length()))


class ByteClass:
    """A set of word bytes and a code for each byte (A-Z as a-z where ``fold``)."""

    def __init__(self, word: np.ndarray, fold: bool = True, seed: int = 7) -> None:
        self.word = word
        code = stream(seed, 256)
        if fold:
            code[65:91] = code[97:123]
        self.code = code


def _not_space() -> np.ndarray:
    word = np.ones(256, bool)
    word[[9, 10, 11, 12, 13, 32]] = False
    return word


def _alphanumeric() -> np.ndarray:
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    return word


#: ``[^\x20\x09-\x0D]+`` and, after A-Z became a-z, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_SPACE = ByteClass(_not_space())
ALPHANUMERIC = ByteClass(_alphanumeric())


def words(data: np.ndarray, offsets: np.ndarray, kind: ByteClass) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = kind.word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(kind.code[data] * up[: len(data)], out=total[1:])
        hashed = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    return hashed, np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within a text (a shorter text is one run), and each text's first run.

    Runs of a text stand together, in order, repeats included.
    """
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(first[:-1] - start[:-1], runs) + np.arange(start[-1])
    factors = stream(99, n + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashed, np.zeros(n, np.uint64)])
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total += padded[at + k] * factors[k]
        short = np.flatnonzero((count > 0) & (count < n))
        for i in short:  # few: texts of less than n words
            k = int(count[i])
            total[start[i]] = (hashed[first[i] : first[i + 1]] * factors[:k]).sum(dtype=np.uint64) + np.uint64(k) * factors[n]
        return mix(total), start
