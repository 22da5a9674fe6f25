"""Maximal runs of wanted bytes in whole texts, counted exactly by dictionary encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every maximal run of ``inside``; no run crosses from one text to the next."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(offsets, start, "right") - 1


def encoded(packed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(which distinct word each word is, the distinct words) of words that stand end to end."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or the sum of its weights."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[edge], np.diff(np.append(edge, len(keys))) if weights is None else np.add.reduceat(weights, edge)
