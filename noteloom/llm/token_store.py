"""Token ids in binary shards, each with a minimal perfect hash index over its document keys.

File format (little-endian), one pair of files a shard:

* ``NNNNNN.ids``: the raw ids of the shard's documents, in ascending key order, as unsigned
  16-bit integers (32-bit if the vocabulary or the end id needs them), without any separators.
* ``NNNNNN.mph``: a header (keys, levels, bytes of an id, rows), the hash's levels of bits, then
  by hash value: fingerprint (uint32), offset of the first id (uint64), number of the first row
  (uint64), number of rows (uint32); last the number of ids of every row in turn (uint64).

The hash is a cascade: a level has twice as many bits as it gets keys; keys alone on their bit
stay there, the others go on to the next level with another seed. A key's number is the rank
of its bit among all set bits, so numbers are 0..n-1 without gaps and a look-up takes constant
expected time. A stored fingerprint rejects keys that aren't there.

Shards are ranges of (key, hash of the text): documents are dealt by range, so that every task
writes its own shards in key order; a retried task overwrites its files whole. A document may be
of any length, and a key with very many rows may go on in the next shard.

The manifest has a row a shard: some 64 bytes for 32 million ids. It is the only thing that is
collected and broadcast, about a millionth of the store.

Nulls and edge cases: a null text is the empty one; rows with a null key are kept in the first
shard under a reserved key; rows that share a key are stored one after another, in the order of
their texts' hashes, and a look-up of the key returns each of them; an empty table has no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.shared import map_file, mix, new_folder, only, parts_for, put_file, slices, written
from noteloom.llm.tokenids import encoder, vocabulary_size

SHARD_IDS = 32 << 20
NULL_KEY = -(1 << 63)
_MAGIC = b"NLMPH002"
MANIFEST = "shard long, first_key long, last_key long, n_rows long, n_keys long, n_ids long"


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys, built and read with array operations."""

    def __init__(self, levels: list[np.ndarray], n: int):
        self.levels, self.n = levels, n
        self.ranks, before = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.uint64)
            self.ranks.append(np.cumsum(ones) - ones + np.uint64(before))
            before += int(ones.sum())

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, levels, n = keys.astype(np.int64).view(np.uint64), [], len(keys)
        while len(keys):
            size = -(-max(64, 2 * len(keys)) // 64) * 64
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels, n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where no level holds it."""
        keys = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(todo):
                break
            at = self._at(keys[todo], level, len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = ((words[word] >> bit) & np.uint64(1)).astype(bool)
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.ranks[level][word] + np.bitwise_count(below))[hit].astype(np.int64)
            todo = todo[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def shard_index(keys: np.ndarray, begins: np.ndarray, firsts: np.ndarray, rows: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """The .mph file's bytes: distinct ascending keys, where their ids and rows begin, how many rows; ids of every row."""
    mph = PerfectHash.build(keys)
    order = np.argsort(mph.find(keys), kind="stable")
    parts = [_MAGIC, struct.pack("<QQQQ", len(keys), len(mph.levels), width, len(sizes)), struct.pack(f"<{len(mph.levels)}Q", *map(len, mph.levels)), *(w.astype("<u8").tobytes() for w in mph.levels)]
    parts += [fingerprints(keys)[order].astype("<u4").tobytes(), begins[order].astype("<u8").tobytes(), firsts[order].astype("<u8").tobytes(), rows[order].astype("<u4").tobytes(), sizes.astype("<u8").tobytes()]
    return b"".join(parts)


class Shard:
    """A shard's files, memory-mapped; ``locate`` is the keyed access."""

    def __init__(self, folder: str, shard: int):
        raw = map_file(f"{folder}/{shard:06d}.mph")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"not an index: {folder}/{shard:06d}.mph")
        n, depth, width, stored = struct.unpack("<QQQQ", raw[8:40].tobytes())
        words = struct.unpack(f"<{depth}Q", raw[40 : 40 + 8 * depth].tobytes())
        at, levels = 40 + 8 * depth, []
        for size in words:
            levels.append(np.frombuffer(raw[at : at + 8 * size].tobytes(), "<u8"))
            at += 8 * size
        self.mph = PerfectHash(levels, n)
        fields = []
        for kind, count in (("<u4", n), ("<u8", n), ("<u8", n), ("<u4", n), ("<u8", stored)):
            size = np.dtype(kind).itemsize * count
            fields.append(np.frombuffer(raw[at : at + size].tobytes(), kind))
            at += size
        self.marks, self.begins, self.firsts, self.rows, self.sizes = fields
        self.ids = map_file(f"{folder}/{shard:06d}.ids").view(f"<u{width}")

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the key, offset, number of ids) of every row stored under the keys."""
        at = self.mph.find(keys)
        found = at >= 0
        if self.mph.n:
            found &= self.marks[at] == fingerprints(keys)
        which = np.flatnonzero(found)
        at = at[which]
        rows = self.rows[at].astype(np.int64)
        nth = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        size = self.sizes[np.repeat(self.firsts[at].astype(np.int64), rows) + nth].astype(np.int64)
        before = np.cumsum(size) - size
        heads = np.repeat(before[nth == 0], rows) if len(nth) else before
        return np.repeat(which, rows), np.repeat(self.begins[at].astype(np.int64), rows) + before - heads, size


class _Writer:
    def __init__(self, folder: str, first: int, dtype: str):
        self.folder, self.shard, self.dtype = folder, first, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.ids, self.n = [], [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.ids.append(ids.astype(self.dtype))
        self.n += len(ids)

    def close(self) -> list[tuple]:
        if not self.keys:
            return []
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
        begins = (np.cumsum(counts) - counts)[first]
        put_file(f"{self.folder}/{self.shard:06d}.ids", *(x.tobytes() for x in self.ids))
        put_file(f"{self.folder}/{self.shard:06d}.mph", shard_index(distinct, begins, first, rows, counts, np.dtype(self.dtype).itemsize))
        row = (self.shard, int(keys[0]), int(keys[-1]), len(keys), len(distinct), int(counts.sum()))
        self.shard += 1
        self.clear()
        return [row]


def write_store(documents: DataFrame, tokenizer: str, end_id: int, spaces_matter: bool = False, folder: str | None = None, shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Encode every whole text, append ``end_id``, write the shards; (folder, manifest).

    Documents are dealt by ranges of (doc_id, hash of the text) and sorted within each; shard
    numbers ascend with keys. Ids take two bytes where the vocabulary and the end id allow it.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "token-store")
    dtype = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    parts = parts_for(documents, 16 << 20)
    keyed = only(documents, "doc_id", "text").withColumn("doc_id", F.coalesce(F.col("doc_id"), F.lit(NULL_KEY))).withColumn("hash", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, out, rows = encoder(tokenizer, spaces_matter), None, []
        for batch in slices(batches, 4000):
            out = out or _Writer(folder, int(batch.column(2)[0].as_py()) << 20, dtype)
            if out.n >= shard_ids:
                rows += out.close()
            ids, at = codes.encode(batch.column(1))
            out.add(batch.column(0).to_numpy(), np.diff(at) + 1, np.insert(ids, at[1:], end_id))
        rows += out.close() if out else []
        names = ["shard", "first_key", "last_key", "n_rows", "n_keys", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], names)

    return folder, written(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_store(keys: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """Keyed access: (doc_id, start, n_tokens, ids_crc32, shard, shard_offset) of every row stored
    under a key in ``keys`` (however often the key stands there).

    ``start`` counts the ids of all rows before it, over all shards. A key finds its shards in the
    manifest by binary search, then its place by the shard's perfect hash.
    """
    shards = sorted(map(tuple, manifest.collect()))
    columns = np.array(shards, np.int64).reshape(-1, 6).T
    numbers, firsts, lasts, totals = columns[0], columns[1], columns[2], columns[5]
    lists = keys.sparkSession.sparkContext.broadcast((numbers, firsts, lasts, np.cumsum(totals) - totals))
    wanted = keys.select(F.coalesce(F.col("doc_id"), F.lit(NULL_KEY)).alias("doc_id")).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, firsts, lasts, _ = lists.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            low = np.searchsorted(lasts, own)
            n = np.maximum(np.searchsorted(firsts, own, "right") - low, 0)
            nth = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(nth, pa.int32())], ["doc_id", "nth"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, _, _, starts = lists.value
        opened: dict[int, Shard] = {}
        for batch in batches:
            keys, nth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(nth):
                if k not in opened:
                    opened = {k: Shard(folder, int(numbers[k]))}
                shard, own = opened[k], keys[nth == k]
                which, begin, size = shard.locate(own)
                crc = [zlib.crc32(shard.ids[b : b + n].astype("<u4").tobytes()) for b, n in zip(begin.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[which]), pa.array(begin + starts[k]), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(which), numbers[k])), pa.array(begin)],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_offset"],
                )

    routed = wanted.mapInArrow(route, "doc_id long, nth int").repartition(max(1, len(shards)), "nth").sortWithinPartitions("nth", "doc_id")
    got = routed.mapInArrow(look_up, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, shard_offset long")
    return got.withColumn("doc_id", F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")))
