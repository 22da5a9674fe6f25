"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from mapped arrays.

Tokens are lower-cased (A-Z) words, then one end per text; a text's first token follows a start
mark. Counting is two packed shuffles: distinct pairs of a few million tokens at a time, with
counts, go by ranges of the pair's hash; each range adds them up and writes them as one sorted
array to the shared folder. What a range knows of its words (pair counts and kinds, as first and
as second word) goes on by ranges of the word's hash, and each of those becomes a sorted array
too. Ranges, not words or pairs, are the unit of a task, and counts are added up before every
shuffle, so a word or pair that is everywhere costs one entry a batch.

Workers map those arrays and look up sorted queries by binary search. With c pairs and
continuation counts cc, discounts D from counts of counts (Chen and Goodman):

    p(w | v) = (c(vw) - D(c(vw))) / c(v.) + gamma(v) p(w)
    p(w)     = (cc(w) - D'(cc(w))) / CC  + gamma' / (V + 1)

Order 2 rather than 3: distinct triples would take about twice the disk for counting (README).

A pair's entry is one 64-bit integer: 48 bits of hash above 16 bits of count. Counts of 65535
and more read 65535 there and stand exactly in a second, short array of the range (``common``).

Nulls and edge cases: a null text is empty and scores its end token; a null doc_id is in the
training part; repeated rows count and score each; without training text V and N are 0 and
every token gets the uniform share of one unknown token; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.quality_gam import held_out
from noteloom.llm.shared import map_file, mix, new_folder, only, parts_for, put_file, slices, written
from noteloom.llm.textscan import word_hashes

FLUSH_TOKENS = 3_000_000
START, END = np.uint64(1), np.uint64(2)  # no word hashes to them (words keep their top bit set)
_TOP = np.uint64(1 << 55)
_LOW56 = np.uint64((1 << 56) - 1)
FULL = 65535  # from here on an entry's 16 bits don't hold the count
COMMON = np.dtype([("key", "<u8"), ("count", "<u8")])
WORD = np.dtype([("word", "<u8"), ("count", "<u8"), ("first", "<u8"), ("kinds", "<u4"), ("one", "<u4"), ("two", "<u4"), ("more", "<u4")])
_PACKED = "part int, kind int, a binary, b binary, c binary"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the token before it, first token of each text and the end); 56-bit word hashes."""
    h, w = word_hashes(column)
    h = (h & _LOW56) | _TOP
    n = len(w) - 1
    ends = w[1:] + np.arange(n)
    out = np.empty(len(h) + n, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = h, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    begins = np.append(0, ends + 1)
    before[begins[:-1]] = START
    return out, before, begins


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(token)) >> np.uint64(16)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["part", "kind", "a", "b", "c"])


def _range(key: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of ``bits``-bit keys each key is in."""
    return ((key >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _count_pairs(documents: DataFrame, parts: int) -> DataFrame:
    """Distinct pairs with counts, by range of the pair's hash; within a row sorted by first word."""

    def flush(before: list[np.ndarray], token: list[np.ndarray]) -> pa.RecordBatch:
        v, w = np.concatenate(before), np.concatenate(token)
        key = pair_keys(v, w)
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(edge, len(key)))
        key, v, w = key[edge], v[order[edge]], w[order[edge]]
        ends = np.searchsorted(_range(key, 48, parts), np.arange(parts + 1))
        rows = []
        for p in range(parts):
            if ends[p + 1] > ends[p]:
                own = np.arange(ends[p], ends[p + 1])
                own = own[np.argsort(v[own], kind="stable")]
                gaps = np.diff(v[own], prepend=np.uint64(0))
                rows.append((p, 0, gaps.tobytes(), w[own].view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), times[own].astype(np.uint32).tobytes()))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, token, n = [], [], 0
        for batch in slices(batches, 4000):
            t, b, _ = tokens(batch.column(0))
            token.append(t)
            before.append(b)
            n += len(t)
            if n >= FLUSH_TOKENS:
                yield flush(before, token)
                before, token, n = [], [], 0
        if n:
            yield flush(before, token)

    return only(documents, "text").mapInArrow(run, _PACKED)


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _held(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    held: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns)):
            held[row[0]].append(row[1:])
    return held


def _histogram(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]


def _write_pairs(packed: DataFrame, folder: str, words: int) -> DataFrame:
    """Add up each range, write its array, pass on what it knows of words and counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        for part in list(held):
            rows = held.pop(part)
            v = np.concatenate([np.cumsum(np.frombuffer(a, np.uint64), dtype=np.uint64) for _, a, _, _ in rows])
            w = np.concatenate([_wide(b) for _, _, b, _ in rows])
            c = np.concatenate([np.frombuffer(c, np.uint32) for _, _, _, c in rows]).astype(np.int64)
            del rows
            key = pair_keys(v, w)
            order = np.argsort(key, kind="stable")
            key = key[order]
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            c = np.add.reduceat(c[order], edge)
            key, v, w = key[edge], v[order[edge]], w[order[edge]]
            put_file(f"{folder}/pairs/{part:06d}.u64", ((key << np.uint64(16)) | np.minimum(c, FULL).astype(np.uint64)).tobytes())
            large = np.flatnonzero(c >= FULL)
            if len(large):
                common = np.zeros(len(large), COMMON)
                common["key"], common["count"] = key[large], c[large]
                put_file(f"{folder}/common/{part:06d}.bin", common.tobytes())
            out = []
            for kind, word in ((1, v), (2, w)):
                order = np.argsort(word, kind="stable")
                word, count = word[order], c[order]
                edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                stats = np.zeros(len(edge), WORD)
                stats["word"] = word[edge]
                total = np.add.reduceat(count, edge)
                if kind == 1:
                    stats["first"] = total
                    for name, some in (("one", count == 1), ("two", count == 2), ("more", count > 2)):
                        stats[name] = np.add.reduceat(some.astype(np.int64), edge)
                else:
                    stats["count"] = total
                    stats["kinds"] = np.diff(np.append(edge, len(word)))
                at = np.searchsorted(_range(stats["word"], 56, words), np.arange(words + 1))
                out += [(p, kind, stats[at[p] : at[p + 1]].tobytes(), None, None) for p in range(words) if at[p + 1] > at[p]]
            out.append((0, 3, np.append(_histogram(c), part).astype(np.int64).tobytes(), None, None))
            yield _rows(out)

    return packed.mapInArrow(run, _PACKED)


def _write_words(packed: DataFrame, folder: str) -> DataFrame:
    """Merge the words of each range, write its array; a summary row a range."""
    names = ["part", "n_words", "n_tokens", "pair_kinds", "histogram", "pair_histogram", "pair_parts", "n_kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        rows = []
        for part in list(held):
            mine = held.pop(part)
            told = np.array([np.frombuffer(a, np.int64) for kind, a, _, _ in mine if kind == 3], np.int64).reshape(-1, 5)
            pairs, parts = told[:, :4].sum(axis=0), told[:, 4].tolist()
            found = [np.frombuffer(a, WORD) for kind, a, _, _ in mine if kind != 3]
            if found:
                all_ = np.concatenate(found)
                del found, mine
                all_ = all_[np.argsort(all_["word"], kind="stable")]
                edge = np.flatnonzero(np.append(True, all_["word"][1:] != all_["word"][:-1]))
                merged = np.zeros(len(edge), WORD)
                merged["word"] = all_["word"][edge]
                for name in WORD.names[1:]:
                    merged[name] = np.add.reduceat(all_[name].astype(np.uint64), edge)
                put_file(f"{folder}/words/{part:06d}.bin", merged.tobytes())
                kinds = merged["kinds"][merged["count"] > 0]
                rows.append((part, int((merged["count"] > 0).sum()), int(merged["count"].sum()), int(kinds.sum(dtype=np.int64)), _histogram(kinds).tolist(), pairs.tolist(), parts, len(merged)))
            else:
                rows.append((part, 0, 0, 0, [0] * 4, pairs.tolist(), parts, 0))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names)

    return packed.mapInArrow(run, "part int, n_words long, n_tokens long, pair_kinds long, histogram array<long>, pair_histogram array<long>, pair_parts array<long>, n_kept long")


def discounts(histogram: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and more, from how many kinds occur once to four times."""
    n = [float(max(x, 0)) for x in histogram]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    out = [0.0]
    for i in range(3):
        d = (i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 * (i + 1)
        out.append(min(max(d, 0.05), i + 0.95))
    return np.array(out)


@dataclass
class Model:
    folder: str
    pair_parts: int
    word_parts: int
    present: dict[str, np.ndarray]  # by kind, whether a range has an array
    n_words: int
    n_tokens: int
    pair_kinds: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_gamma: float


def train(documents: DataFrame) -> Model:
    """Count all of ``documents`` into arrays in the shared folder."""
    folder = new_folder(documents.sparkSession, "kneser-ney")
    pairs = parts_for(documents, 8 << 20)
    words = parts_for(documents, 16 << 20)
    counted = _write_pairs(_count_pairs(documents, pairs).repartition(pairs, "part"), folder, words)
    summary = written(_write_words(counted.repartition(words, "part"), folder), "kneser-ney-summary").collect()
    add = lambda name: np.sum([r[name] for r in summary], axis=0) if summary else np.zeros(4)
    n_words, n_tokens, kinds = (int(sum(r[k] for r in summary)) for k in ("n_words", "n_tokens", "pair_kinds"))
    word_discounts = discounts(list(add("histogram")))
    ones, twos = (int(x) for x in add("histogram")[:2])
    gamma = (word_discounts[1] * ones + word_discounts[2] * twos + word_discounts[3] * (n_words - ones - twos)) / kinds if kinds else 1.0
    present = {"pairs": np.zeros(pairs, bool), "words": np.zeros(words, bool)}
    present["words"][[r["part"] for r in summary if r["n_kept"]]] = True
    present["pairs"][[x for r in summary for x in r["pair_parts"]]] = True
    return Model(folder, pairs, words, present, n_words, n_tokens, kinds, discounts(list(add("pair_histogram"))), word_discounts, float(gamma))


_open: dict[tuple[str, str, int], np.ndarray] = {}


def _array(model: Model, kind: str, part: int) -> np.ndarray:
    """A range's array, mapped once per worker; empty where no text fell into the range. One that was
    written and is gone raises."""
    key = (model.folder, kind, part)
    if key not in _open:
        if any(k[0] != model.folder for k in _open):
            _open.clear()
        name, dtype = {"pairs": ("u64", np.dtype("<u8")), "common": ("bin", COMMON), "words": ("bin", WORD)}[kind]
        there = kind == "common" or model.present[kind][part]
        _open[key] = map_file(f"{model.folder}/{kind}/{part:06d}.{name}").view(dtype) if there else np.zeros(0, dtype)
    return _open[key]


def _find(model: Model, kind: str, keys: np.ndarray) -> np.ndarray:
    """Entries of sorted distinct keys: WORD records, or counts of pairs (zero where unknown)."""
    bits, parts = (48, model.pair_parts) if kind == "pairs" else (56, model.word_parts)
    out = np.zeros(len(keys), np.int64 if kind == "pairs" else WORD)
    ends = np.searchsorted(_range(keys, bits, parts), np.arange(parts + 1))
    for p in range(parts):
        if ends[p + 1] == ends[p]:
            continue
        table, own = _array(model, kind, p), keys[ends[p] : ends[p + 1]]
        if not len(table):
            continue
        if kind == "pairs":
            at = np.minimum(np.searchsorted(table, own << np.uint64(16)), len(table) - 1)
            got = table[at]
            hit = (got >> np.uint64(16)) == own
            count = np.where(hit, got & np.uint64(0xFFFF), np.uint64(0)).astype(np.int64)
            large = np.flatnonzero(count == FULL)
            if len(large):
                common = _array(model, "common", p)
                count[large] = common["count"][np.searchsorted(common["key"], own[large])]
            out[ends[p] : ends[p + 1]] = count
        else:
            at = np.minimum(np.searchsorted(table["word"], own), len(table) - 1)
            hit = table["word"][at] == own
            out[ends[p] : ends[p + 1]][hit] = table[at[hit]]
    return out


def log_probabilities(model: Model, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Per text: (tokens, known tokens, base score, model's score), scores in log10."""
    t, b, at = tokens(column)
    words, where = np.unique(np.concatenate([t, b]), return_inverse=True)
    stats = _find(model, "words", words)
    token, before = where[: len(t)], where[len(t) :]
    count = stats["count"].astype(np.float64)
    base = np.log10((count + 1) / (model.n_tokens + (model.n_words + 1)))
    kinds = stats["kinds"].astype(np.float64)
    D, E = model.word_discounts, model.pair_discounts
    low = np.maximum(kinds - D[np.minimum(stats["kinds"], 3)], 0) / max(model.pair_kinds, 1) + model.word_gamma / (model.n_words + 1)
    first = stats["first"].astype(np.float64)
    gamma = np.where(first > 0, (E[1] * stats["one"] + E[2] * stats["two"] + E[3] * stats["more"]) / np.maximum(first, 1), 1.0)
    keys, which = np.unique(pair_keys(b, t), return_inverse=True)
    c = _find(model, "pairs", keys)[which]
    p = np.maximum(c - E[np.minimum(c, 3)], 0) / np.maximum(first[before], 1) + gamma[before] * low[token]
    total = lambda x: np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(len(at) - 1)
    return np.diff(at), total((count > 0)[token].astype(np.int64)), total(base[token]), total(np.log10(p))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3000):
            n, known, base, own = log_probabilities(shipped.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), pa.array(own.astype(float))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return only(documents, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_corpus(documents: DataFrame) -> DataFrame:
    """Train outside the held-out fold (crc32 modulo 7 is 2), score all; perplexity per token besides."""
    model = train(documents.where(~held_out(F.col("doc_id"), 7, 2)))
    got = score(documents, model)
    return got.select(
        "doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
