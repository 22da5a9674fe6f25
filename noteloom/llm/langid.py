"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's words (lower-cased A-Z) give byte n-grams with word ends marked, each hashed to a row
of an embedding table; the mean of all rows goes through one linear layer and a softmax. Both
are trained by stochastic gradient descent in numpy, on whole texts and on short runs of their
words, over at most ``MAX_FIT_ROWS`` labelled documents in the order of a hash of doc_id.

Afterwards a temperature and a rejection threshold are calibrated on documents kept out of the
descent: the temperature minimises their log loss, the threshold is the largest that rejects
at most ``max_reject`` of the rightly labelled ones, but never above ``ceiling``: a language
likelier than all others together is not rejected.

Since the layer is linear, a word's part in the sum is a sum of table rows already multiplied
by the layer, so scoring handles each distinct word of a batch once and adds up whole texts.

Nulls and edge cases: a text that is null or has no letter gets ``und`` with score 0 and counts
as rejected; rows with a null language aren't learned from; without any label every text is
``und``; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.quality_gam import held_out
from noteloom.llm.shared import mix, only, slices, text_buffers
from noteloom.llm.textscan import LOWER, chunks, span_hashes, spans

MAX_FIT_ROWS = 4_000
GRAMS = (2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def word_grams(data: np.ndarray, s: np.ndarray, e: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(table row of each n-gram, first n-gram of each word and the end) for words data[s:e]."""
    size = e - s + 2  # with a mark at either end
    begin = np.cumsum(size) - size
    marked = np.empty(int(size.sum()), np.uint64)
    inside = np.ones(len(marked), bool)
    inside[begin] = inside[begin + size - 1] = False
    marked[begin], marked[begin + size - 1] = 1, 2
    source = np.repeat(s - begin - 1, size) + np.arange(len(marked))
    marked[inside] = LOWER[data[source[inside]]].astype(np.uint64) + np.uint64(3)
    owner = np.repeat(np.arange(len(s)), size)
    rows, owners = [], []
    for n in GRAMS:
        m = len(marked) - n + 1
        if m <= 0:
            continue
        key = np.full(m, np.uint64(n))
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + marked[i : m + i]
        whole = owner[:m] == owner[n - 1 :]
        rows.append((mix(key[whole]) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(owner[:m][whole])
    rows_, owners_ = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return rows_[order], np.searchsorted(owners_[order], np.arange(len(s) + 1))


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray  # rows x languages: embeddings times the layer
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        out = [self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 2 << 20)]
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))

    def _block(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n, k = len(at) - 1, len(self.names)
        s, e = spans(data, at)
        if not len(s):
            return np.tile(self.bias, (n, 1))
        _, first, which = np.unique(span_hashes(data, s, e, True), return_index=True, return_inverse=True)
        rows, begin = word_grams(data, s[first], e[first], self.bits)
        grams = np.diff(begin).astype(float)
        owner = np.repeat(np.arange(n), np.diff(np.searchsorted(s, at)))
        count = np.bincount(owner, grams[which], n)
        out = np.empty((n, k))
        for j in range(k):
            word = np.add.reduceat(self.table[rows, j], begin[:-1])
            out[:, j] = np.bincount(owner, word[which], n)
        return out / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, at = text_buffers(column)
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=plain[1:])
    out = plain[at[1:]] > plain[at[:-1]]
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])).tolist():
        out[i] = any(map(str.isalpha, data[at[i] : at[i + 1]].tobytes().decode()))
    return out


def fit(texts: pa.Array, langs: list[str], bits: int = 16, width: int = 16, epochs: int = 1, rate: float = 0.5, max_reject: float = 0.001, ceiling: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on nine tenths of the rows, calibrate on the rest."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], int)
    rng = np.random.default_rng(seed)
    k, size = len(names), 1 << bits
    table, layer, bias = rng.normal(0, 1 / width, (size, width)), np.zeros((width, k)), np.zeros(k)
    data, at = text_buffers(texts)
    s, e = spans(data, at)
    w = np.searchsorted(s, at)
    calibrating = np.arange(len(y)) % 10 == 9 if len(y) >= 50 else np.zeros(len(y), bool)
    layer += rng.normal(0, 0.1, layer.shape)
    steps = [(i, kind) for _ in range(epochs) for i in rng.permutation(np.flatnonzero(~calibrating)) for kind in (0, 1)]
    for t, (i, kind) in enumerate(steps):
        a, b = w[i], w[i + 1]
        if a == b:
            continue
        if kind:  # a short run of the text's words
            n = int(min(b - a, rng.integers(3, 30)))
            a = int(rng.integers(a, b - n + 1))
            b = a + n
        rows, times = np.unique(word_grams(data, s[a:b], e[a:b], bits)[0], return_counts=True)
        share = times / times.sum()
        mean = share @ table[rows]
        z = mean @ layer + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[i]] -= 1
        step = rate * (1 - t / len(steps)) + 0.01
        back = layer @ p
        layer -= step * np.outer(mean, p)
        bias -= 0.1 * step * p
        table[rows] -= np.outer(share, 8 * step * back)
    model = LanguageModel(names, (table @ layer).astype(np.float64), bias, bits)
    if calibrating.any():
        keep = np.flatnonzero(calibrating)
        z = model.logits(texts.take(pa.array(keep)))
        truth = y[keep]

        def loss(temperature: float) -> float:
            model.temperature = temperature
            return -float(np.log(np.maximum(model.probabilities(z)[np.arange(len(z)), truth], 1e-12)).mean())

        model.temperature = min(np.geomspace(0.02, 10, 55), key=loss)
        p = model.probabilities(z)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        if len(right):
            model.threshold = float(min(right[int(max_reject * len(right))], ceiling))
    return model


def fit_languages(documents: DataFrame, max_rows: int = MAX_FIT_ROWS) -> LanguageModel | None:
    """Learn from labelled documents outside the held-out fold (crc32 modulo 4 is 2).

    The rows are the first ``max_rows`` in the order of a hash. Their number is counted first, so
    that only hashes up to a bound which about twice as many rows stay below are ordered at all;
    should fewer lie below it than wanted, all are.
    """
    known = only(documents, "doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out(F.col("doc_id"), 4, 2))
    hashed = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"), "doc_id")
    total = known.count()
    bound = min(1.0, (2 * max_rows + 1000) / max(total, 1))
    for share in (bound, 1.0):
        some = hashed if share >= 1 else hashed.where(F.col("h") < int((share - 0.5) * 2.0**64))
        rows = some.orderBy("h", "doc_id", F.xxhash64("text", F.lit(1))).limit(max_rows).select("text", "lang").toArrow()
        if rows.num_rows >= min(max_rows, total):
            break
    return fit(rows.column("text").combine_chunks(), rows.column("lang").to_pylist()) if rows.num_rows else None


def predict(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in slices(batches, 4000):
            letters = has_letter(batch.column(1))
            if m is None:
                best, name = np.zeros(len(letters)), np.full(len(letters), "und", object)
                letters[:] = False
            else:
                p = m.probabilities(m.logits(batch.column(1)))
                best, name = np.where(letters, p.max(axis=1), 0.0), np.where(letters, np.array(m.names, object)[p.argmax(axis=1)], "und")
            rejected = ~letters | (best < (m.threshold if m else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(best), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return only(documents, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Learn, then label every document: (doc_id, held_out, lang_pred, score, rejected)."""
    got = predict(documents, fit_languages(documents, max_rows))
    return got.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
