"""Numbers that describe whole texts, from array operations on their bytes and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from noteloom.llm.shared import text_buffers
from noteloom.llm.textscan import SPACE, chunks, distinct_shingles, span_hashes, spans

NAMES = (
    "log_words", "mean_word", "long_word", "upper", "digit", "symbol", "stop_mark", "punct", "wide", "blank",
    "log_lines", "words_a_line", "dup_lines", "distinct_words", "top_word", "dup_trigrams", "short_words", "shouted", "numbers", "marks_in_words",
)
_CLASS = np.zeros((7, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in "#*$%&|<>@^~=+_/\\{}[]"]] = True
_CLASS[3, [ord(c) for c in "!?"]] = True
_CLASS[4, [ord(c) for c in ".,;:'\"()-"]] = True
_CLASS[5, 128:] = True
_CLASS[6] = SPACE


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values in each range at[i]:at[i+1]."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: how many distinct keys, and the count of its most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
    top = np.zeros(n)
    np.maximum.at(top, o[new], np.diff(np.append(new, len(k))))
    return np.bincount(o[new], minlength=n).astype(float), top


def _block(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    upper, digit, symbol, stop, punct, wide, blank = (_sums(c[data], at) / size for c in _CLASS)
    s, e = spans(data, at)
    w = np.searchsorted(s, at)
    words = np.diff(w).astype(float)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(w))
    length = (e - s).astype(float)
    h = span_hashes(data, s, e, True)
    distinct, top = _repeats(h, owner, n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    _, trigram_text = distinct_shingles(h, w, 3)
    windows = np.maximum(words - 2, 1)
    dup3 = np.where(words >= 3, 1 - np.bincount(trigram_text, minlength=n) / windows, 0.0)
    caps = np.zeros(len(data) + 1)
    np.cumsum(_CLASS[0][data], out=caps[1:])
    marks = np.zeros(len(data) + 1)
    np.cumsum(_CLASS[2][data] | _CLASS[3][data], out=marks[1:])
    digits = np.zeros(len(data) + 1)
    np.cumsum(_CLASS[1][data], out=digits[1:])
    shout = ((caps[e] - caps[s]) > 0.5 * length) & (length > 1)
    # Lines: cut after each line end and at each text's end; blank ones don't count.
    ends = np.union1d(np.flatnonzero(data == 10) + 1, at[1:])
    ends = ends[ends > 0]
    begins = np.append(0, ends[:-1])
    filled = np.searchsorted(s, ends) > np.searchsorted(s, begins)
    begins, ends = begins[filled], ends[filled]
    line_owner = np.searchsorted(at, begins, "right") - 1
    stop_at = ends - (data[ends - 1] == 10) if len(ends) else ends
    line_hash = span_hashes(data, begins, np.maximum(stop_at, begins), False)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    distinct_lines, _ = _repeats(line_hash, line_owner, n)
    per = lambda x: np.bincount(owner, x, minlength=n) / some
    out = np.stack([
        np.log1p(words), np.bincount(owner, length, minlength=n) / some, longest, upper, digit, symbol, stop, punct, wide, blank,
        np.log1p(lines), words / np.maximum(lines, 1), 1 - distinct_lines / np.maximum(lines, 1) * (lines > 0) - (lines == 0), distinct / some, top / some,
        dup3, per(length <= 2), per(shout), per((digits[e] - digits[s]) > 0), per((marks[e] - marks[s]) > 0),
    ], axis=1)
    return out.astype(np.float32)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for every text; all are 0 or near it for an empty or null one."""
    data, offsets = text_buffers(column)
    blocks = [_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 1 << 20)]
    return np.concatenate(blocks) if blocks else np.zeros((0, len(NAMES)), np.float32)
