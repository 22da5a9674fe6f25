"""Words of whole texts as 64-bit hashes, found with array operations on UTF-8 bytes.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D; those are
single bytes in UTF-8, and so are the letters A-Z that are lower-cased, so bytes suffice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from noteloom.llm.shared import mix, text_buffers

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C55 | 1
_INV = pow(_R, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK = 1 << 20


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _INV)):
            steps = np.full(max(n, CHUNK + 1), np.uint64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words; no word crosses from one text to the next."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = True
    after[cuts - 1] = True
    return np.flatnonzero(before & ~blank), np.flatnonzero(after & ~blank) + 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte range; a polynomial's prefix sums give them all at once."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    values = (LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    values *= power[: len(data)]
    np.cumsum(values, out=sums[1:])
    h = (sums[e] - sums[s]) * inverse[s]
    return mix(h ^ ((e - s).astype(np.uint64) << np.uint64(56)))


def chunks(offsets: np.ndarray, size: int):
    """Ranges of whole texts of about ``size`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield i, j
        i = j


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end): words of text i are h[w[i]:w[i+1]]."""
    data, offsets = text_buffers(column)
    hashes, firsts, base = [], [np.zeros(1, np.int64)], 0
    for i, j in chunks(offsets, CHUNK):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e = spans(part, at)
        hashes.append(span_hashes(part, s, e, lower))
        firsts.append(np.searchsorted(s, at[1:]) + base)
        base += len(s)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(firsts)


def distinct_shingles(h: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (hash, text index), sorted by hash then text.

    A text of 1 to k-1 words has its whole sequence as its only shingle, a text without words none.
    """
    lengths = np.diff(w)
    text = np.repeat(np.arange(len(lengths)), lengths)
    m = len(h) - k + 1
    if m > 0:
        s = h[:m].copy()
        for i in range(1, k):
            s *= np.uint64(0x9DDFEA08EB382D69)
            s ^= s >> np.uint64(32)
            s += h[i : m + i]
        whole = text[:m] == text[k - 1 :]
        s, t = mix(s[whole]), text[:m][whole]
    else:
        s, t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        z = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = lengths[short] > i
            z[has] = mix(z[has] * np.uint64(0x9DDFEA08EB382D69) + h[w[short[has]] + i] + np.uint64(i + 1))
        s, t = np.concatenate([s, mix(z + np.uint64(77))]), np.concatenate([t, short])
    order = np.lexsort((t, s)) if len(s) < 2 else np.argsort(s, kind="stable")
    s, t = s[order], t[order]
    if len(s) > 1:  # within one hash the texts still ascend, since the sort is stable and texts came in order
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        s, t = s[keep], t[keep]
    return s, t
