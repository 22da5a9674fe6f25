"""Spelling variants: near words grouped under their far more frequent form, without pairs of words.

A run of letters A-Z and U+00C0 to U+00FF is lower-cased in A-Z. To lay misspellings into the corpus, a
run whose h = crc32("<doc_id>:<run>") divides by 31 loses its code point h mod length. Words are the
results of seven code points or more that occur at least twice. Two words are near if one inserted,
deleted or replaced code point leads from one to the other; a word's form is its most frequent
near word (ties: the first in code-point order) if that is at least ten times as frequent.

Every word emits one record for each of its positions: the hash of the word without that code
point, with the position. Records that share hash and position are a wildcard group (position,
prefix, suffix): its members replace one code point of each other, so the group's size and its
two most frequent words give each member all it needs. A group has a member a letter at most, so no
group is large. A word itself is a record too: those of the same hash are one code point
longer, which gives both sides of every insertion and deletion. Records go packed by ranges
of the hash (96 bits of two polynomial hashes); what a word learns from its groups is added up.

All letters are at most U+00FF, so words are kept in Latin-1, a byte a code point, in whose byte order
code points ascend. A word's number ascends with it, so ties compare numbers.

Nulls and edge cases: a null text has no runs; a null doc_id stands as nothing before the colon;
repeated rows count each; an empty table gives no rows; a run of any length is hashed in time and
memory proportional to it; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.shared import discard, mix, only, parts_for, slices, text_buffers, written
from noteloom.llm.textscan import LOWER
from noteloom.llm.wordruns import encoded, runs, tally

LEAST_LENGTH, LEAST_COUNT, RATIO, LOSE_EVERY = 7, 2, 10, 31
FLUSH_BYTES = 5 << 20
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LATIN = LOWER.copy()
LATIN[0x80:0xC0] += 0x40  # second byte of U+00C0 to U+00FF, whose first is 0xC3
SHORT = 64  # longer runs are hashed one by one
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the table of the CRC-32 polynomial
    _STEP = (_STEP >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (_STEP & np.uint32(1)))


def run_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the checksum before it; all runs' k-th bytes at a time."""
    length = end - start
    order = np.argsort(-np.minimum(length, SHORT + 1), kind="stable")
    at, sizes = start[order], length[order]
    crc = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-sizes, -SHORT, "left"))
    for i in np.flatnonzero(sizes[:long] > SHORT):
        crc[i] = np.uint32(zlib.crc32(data[at[i] : at[i] + sizes[i]], int(before[order[i]]))) ^ np.uint32(0xFFFFFFFF)
    short, at, sizes = crc[long:], at[long:], sizes[long:]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k
        short[:m] = _STEP[(short[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (short[:m] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def slice_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each slice of about 5 MB of text."""
    for batch in slices(batches, 20_000, FLUSH_BYTES):
        data, offsets = text_buffers(batch.column(1))
        data = LOWER[data]
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        own = LETTER[data] | second
        start, end, text = runs(own | (data == 0xC3), offsets)
        if not len(start):
            continue
        keys = [zlib.crc32(b":" if k is None else f"{k}:".encode()) for k in batch.column(0).to_pylist()]
        h = run_crcs(data, start, end, np.array(keys, np.uint32)[text]).astype(np.int64)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum(own, out=points[1:])
        at, length = points[start], points[end] - points[start]
        packed = LATIN[data[own]]
        lose = np.flatnonzero(h % LOSE_EVERY == 0)
        there = np.ones(len(packed), bool)
        there[at[lose] + h[lose] % length[lose]] = False
        short = length - np.bincount(lose, minlength=len(length))
        there &= np.repeat(short >= LEAST_LENGTH, length)
        word, words = encoded(packed[there], short[short >= LEAST_LENGTH])
        if len(word):
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(word, minlength=len(words)))], ["word", "n"])


def vocabulary(documents: DataFrame) -> DataFrame:
    """(id, word, n): all words, Latin-1, with numbers that ascend as they do."""
    counted = only(documents, "doc_id", "text").mapInArrow(slice_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    counted = written(counted, "spelling-counts")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), *batch.columns], ["id", "word", "n"])
            at += batch.num_rows

    ranged = counted.repartitionByRange(parts_for(counted, 16 << 20), "word").sortWithinPartitions("word")
    words = written(ranged.mapInArrow(numbered, "id long, word binary, n long"), "spelling-words")
    discard(counted)
    return words


_BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)


def _without_each(data: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without each of its bytes, hash of each word) by prefix sums of a polynomial."""
    n = len(data)
    power = np.full(n + 2, np.uint64(base))
    inverse = np.full(n + 2, np.uint64(pow(base, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(base)) * power[:n], out=sums[1:])
    first, last = offsets[:-1], offsets[1:]
    whole = (sums[last] - sums[first]) * inverse[first]
    s, e = np.repeat(first, last - first), np.repeat(last, last - first)
    at = np.arange(n)
    return mix((sums[at] - sums[s]) * inverse[s] + (sums[e] - sums[at + 1]) * inverse[s + 1]), mix(whole)


_PACKED = "part int, high binary, low binary, place binary, id binary, n binary"
_NAMES = ["part", "high", "low", "place", "id", "n"]


def _records(words: DataFrame, parts: int) -> DataFrame:
    """Records of all words, packed by range of the hash: (hash, position or -1 for the word itself, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 25_000, 1 << 20):
            data, offsets = text_buffers(batch.column(1))
            length = np.diff(offsets)
            owner = np.append(np.repeat(np.arange(len(length)), length), np.arange(len(length)))
            place = np.append(np.arange(len(data)) - np.repeat(offsets[:-1], length), np.full(len(length), -1)).astype(np.int32)
            high, low = (np.concatenate(_without_each(data, offsets, base)) for base in _BASES)
            part = ((high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            ids, n = batch.column(0).to_numpy()[owner[order]], batch.column(2).to_numpy()[owner[order]]
            high, low, place = high[order], (low[order] >> np.uint64(32)).astype(np.uint32), place[order]
            rows = []
            for p in np.flatnonzero(np.diff(ends)):
                own = slice(ends[p], ends[p + 1])
                rows.append((int(p), *(x.tobytes() for x in (high[own], low[own], place[own], np.diff(ids[own], prepend=0), n[own]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], _NAMES)

    return words.mapInArrow(run, _PACKED)


def _best_others(group: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, number of others, n and id of the best other) for all members of groups of two and more."""
    order = np.lexsort((ids, -n, group))
    group, ids, n = group[order], ids[order], n[order]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(group)))
    top = np.repeat(edge, size)
    other = np.where(np.arange(len(group)) == top, np.minimum(top + 1, len(group) - 1), top)
    keep = np.repeat(size, size) > 1
    return ids[keep], np.repeat(size - 1, size)[keep], n[other][keep], ids[other][keep]


def group_answers(high: np.ndarray, low: np.ndarray, place: np.ndarray, ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """(id, near words, n and id of the best of them), several rows a word, from the records of whole hashes."""
    order = np.lexsort((place, low, high))
    high, low, place, ids, n = (x[order] for x in (high, low, place, ids, n))
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
    key = np.cumsum(new) - 1
    keep = np.bincount(key)[key] > 1
    key, place, ids, n = key[keep], place[keep], ids[keep], n[keep]
    cut = place >= 0
    wild = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]))[: len(key)]) - 1
    out = [_best_others(wild[cut], ids[cut], n[cut])]
    # The word whose record has this very hash, and the words that are one code point longer, each once.
    word = np.full(int(key[-1]) + 1 if len(key) else 0, -1)
    word[key[~cut]] = np.flatnonzero(~cut)
    longer = np.flatnonzero(cut & (word[key] >= 0)) if len(key) else np.zeros(0, np.int64)
    longer = longer[np.lexsort((ids[longer], -n[longer], key[longer]))]
    k, own = key[longer], ids[longer]
    once = np.append(True, (k[1:] != k[:-1]) | (own[1:] != own[:-1]))[: len(k)]
    longer = longer[once]
    if len(longer):
        k, at = key[longer], word[key[longer]]
        out.append((ids[longer], np.ones(len(longer), np.int64), n[at], ids[at]))
        edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        out.append((ids[at[edge]], np.diff(np.append(edge, len(k))), n[longer[edge]], ids[longer[edge]]))
    return [np.concatenate(x) for x in zip(*out)]


def near_words(words: DataFrame, parts: int) -> DataFrame:
    """(id, n_near, best): how many near words a word has, and the best of them as (n, -id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for part, *columns in zip(*(x.to_pylist() for x in batch.columns)):
                held[part].append(tuple(np.frombuffer(x, t) for x, t in zip(columns, (np.uint64, np.uint32, np.int32, np.int64, np.int64))))
        for part in list(held):
            rows = held.pop(part)
            high, low, place, _, n = (np.concatenate(x) for x in zip(*rows))
            found = group_answers(high, low, place, np.concatenate([np.cumsum(r[3]) for r in rows]), n)
            del rows
            for i in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in found], ["id", "near", "best_n", "best_id"])

    found = _records(words, parts).repartition(parts, "part").mapInArrow(run, "id long, near long, best_n long, best_id long")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("minus_id"))).alias("best"))


def with_roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(id, form, root) from (id, form): each round jumps as far again as all before it."""
    now = written(forms.withColumn("root", F.col("form")), "spelling-roots")
    for _ in range(rounds):
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = written(now.join(further, "root", "left").select("id", "form", F.coalesce("next", "root").alias("root")), "spelling-roots")
        discard(now)
        now = jumped
    return now


def spelling_variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = vocabulary(documents)
    # A word has some twelve records; about 20 bytes each travel.
    near = written(words.join(near_words(words, parts_for(words, 256 << 10)), "id", "left"), "spelling-near")
    has_form = F.coalesce(F.col("best.best_n") >= RATIO * F.col("n"), F.lit(False))
    forms = near.where(has_form).select("id", (-F.col("best.minus_id")).alias("form"))
    most, hops = near.agg(F.max("n")).first()[0] or 0, 0
    while most >= RATIO * LEAST_COUNT:  # a form is ten times as frequent as its word
        most, hops = most // RATIO, hops + 1
    chains = with_roots(forms, max(hops - 1, 0).bit_length())
    text = lambda name: F.decode(name, "ISO-8859-1")
    named = words.select(F.col("id").alias("form"), text("word").alias("form_word"), F.col("n").alias("form_n"))
    rooted = words.select(F.col("id").alias("root"), text("word").alias("root_word"))
    chains = chains.join(named, "form").join(rooted, "root").select("id", "form_word", "form_n", "root_word")
    own = near.select("id", text("word").alias("word"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")).join(chains, "id", "left")
    return own.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
