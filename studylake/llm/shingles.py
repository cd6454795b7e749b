"""Words and word shingles of whole Arrow batches as 64-bit hashes, without a Python step per word.

Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased. A word's hash is a polynomial
over random 64-bit values of its bytes, taken from running sums; a shingle's hash combines the hashes of
its words in order. A text with fewer than ``k`` words is one shingle: its whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

K = 5
CHUNK = 1 << 18  # bytes hashed at once: bounds temporary arrays for texts of any length

_RANDOM = np.random.default_rng(20).integers(1 << 62, dtype=np.uint64, size=260) * np.uint64(4) + np.uint64(3)
_LETTER = _RANDOM[:256].copy()
_LETTER[65:91] = _LETTER[97:123]
_BASE, _STEP, _MIX1, _MIX2 = (x | np.uint64(1) for x in _RANDOM[256:260])
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, CHUNK + 1)
_INVERSE = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), CHUNK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole hash."""
    h = (h ^ (h >> np.uint64(32))) * _MIX1
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text: its first word; one more at the end


def words(texts: pa.Array) -> Words:
    """Words of all texts; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = int(offsets[0]) if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base : int(offsets[-1]) if len(texts) else 0]
    offsets = offsets - base
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)  # a word ends before a text begins
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(data, start, end, _hashes(data, start, end), np.searchsorted(start, offsets))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > CHUNK:  # one word beyond the chunk
            out[i] = _long_hash(data[lo:hi])
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_LETTER[data[lo:hi]] * _POWERS[: hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * _INVERSE[s]
        i = j
    return mix(out + (end - start).astype(np.uint64))


def _long_hash(word: np.ndarray) -> np.uint64:
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(0, len(word), CHUNK):
            part = word[i : i + CHUNK]
            total += np.sum(_LETTER[part] * _POWERS[: len(part)], dtype=np.uint64) * scale
            scale *= _POWERS[len(part)]
    return total


def shingle_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all windows of ``k`` words of one or more texts, given the words' hashes."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _STEP + h[j : n + j]
    return mix(out)


def text_shingles(w: Words, k: int = K) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    every = shingle_hashes(w.hash, k)
    first = w.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix(shingle_hashes(w.hash[a:b], b - a) + np.uint64(b - a))
        else:
            yield every[:0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in row ranges of about ``limit`` bytes of ``text`` (a longer text alone), so that the arrays over
    a range stay small."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
