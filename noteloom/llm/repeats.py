"""Passages that repeat, found by a distributed difference-cover suffix sort over content-cut phrases.

Wanted are all bytes covered by a string of ``length`` (400) bytes that starts anywhere else too.

1. Phrases. A place whose 12 bytes hash below a bound (one in 48) is an anchor; the phrase of an anchor
   runs to the end of the next anchor's 12 bytes. Anchors depend on those bytes only, so equal strings
   hold the same ones. Phrases are counted (packed, by ranges of a 96-bit hash); those of one occurrence
   can lie in no repeated string and end the sequences there. What is left are strings of names.
2. Suffix sort. Triples at positions 1 and 2 modulo 3 are sorted and named; the strings of names recurse
   until a name that occurs twice spans ``length`` bytes or an end (six levels at most, two or three as a
   rule); suffixes at 0 modulo 3 are merged by (name, rank of the next suffix) against position 1 and
   (name, name, rank) against position 2. Work is on distinct tuples, added up before each
   shuffle and dealt by ranges of their first triple, so copies cost one tuple a task.
3. Adjacent prefixes. Neighbours in that order are compared by their names up to ``length`` bytes:
   equal ones are one class, and each class learns the longest prefix it shares with another.
4. Bytes between anchors. Windows whose phrases, the one before included, occur twice with the same class
   repeat as they stand. A window that begins or ends within a phrase that differs, and may equal another
   by the classes' shared prefixes, is hashed (80 bits) and counted, as is one with an anchor at most;
   of windows that are known to repeat one occurrence takes part where it can meet such a one.

Strings are judged on the input. The table is written once to the shared folder with a row number that
holds its partition; tasks read what was found for their partition from files there.

Nulls and edge cases: a null text is empty; texts below ``length`` bytes keep everything; repeated rows and
null keys count as rows of their own, so each copy of a text of ``length`` bytes loses all of it;
overlapping repeats within one text count; an empty table gives no rows; memory follows the
longest text; further columns are ignored. Equality is that of hashes of 80 bits and more.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.shared import discard, let_go, map_file, mix, new_folder, only, parts_for, put_file, slices, text_buffers, written

LENGTH, GRAM, EVERY = 400, 12, 48
SLICE = 2 << 20
#: Bytes whose hashes are found together; their arrays stay in the processor's cache.
CHUNK = 1 << 16
_BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)


# --- bytes ---------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every anchor."""
    found = [np.zeros(0, np.int64)]
    for begin in range(0, len(data) - GRAM + 1, CHUNK):
        n = min(CHUNK, len(data) - GRAM + 1 - begin)
        eight, four = (np.ndarray(n, kind, data[begin + k : begin + n + GRAM - 1], strides=(1,)).astype(np.uint64) for k, kind in ((0, "<u8"), (8, "<u4")))
        h = mix(eight * np.uint64(_BASES[0]) + four)
        found.append(begin + np.flatnonzero(h < np.uint64((1 << 64) // EVERY)))
    at = np.concatenate(found)
    text = np.searchsorted(offsets, at, "right") - 1
    whole = at + GRAM <= offsets[text + 1]
    return at[whole], text[whole]


class Powers:
    """Powers of the bases and of their inverses, kept from slice to slice of a task."""

    def __init__(self):
        self.kept: list[list[np.ndarray]] = []

    def of(self, n: int) -> list[list[np.ndarray]]:
        """(powers of the base, of its inverse), ``n`` or more of each, for every base."""
        if self.kept and len(self.kept[0][0]) >= n:
            return self.kept
        self.kept, made = [], []
        for base in _BASES:
            made.append([])
            for factor in (base, pow(base, -1, 1 << 64)):
                power = np.full(n, np.uint64(factor))
                power[0] = 1
                made[-1].append(np.cumprod(power, out=power))
        if n <= 2 * SLICE:  # those of a longer text go with it
            self.kept = made
        return made


class Sums:
    """Hashes of any byte ranges of a buffer, from prefix sums of two polynomials."""

    def __init__(self, data: np.ndarray, powers: Powers | None = None):
        self.sums, self.inverse = [], []
        for base, (power, inverse) in zip(_BASES, (powers or Powers()).of(len(data) + 1)):
            values = mix(np.arange(256, dtype=np.uint64) + np.uint64(base))[data]
            values *= power[: len(data)]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = (mix((s[end] - s[start]) * i[start]) for s, i in zip(self.sums, self.inverse))
        return high, (low >> np.uint64(32)).astype(np.uint32)


def _part(high: np.ndarray, parts: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_PACKED = "part int, high binary, low binary, row binary, at binary, size binary"


def _packed(parts: int, high: np.ndarray, low: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Records by range of their hash, one row a range, column by column; places go as low and high halves,
    which compress better apart."""
    part = _part(high, parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    high, low, row, at, size = (x[order] for x in (high, low, row, at.astype(np.uint32), size))
    rows = []
    for p in np.flatnonzero(np.diff(ends)):
        own = slice(ends[p], ends[p + 1])
        halves = at[own].view(np.uint16).reshape(-1, 2).T
        rows.append((int(p), high[own].tobytes(), low[own].tobytes(), np.diff(row[own], prepend=0).tobytes(), np.ascontiguousarray(halves).tobytes(), size[own].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int32(), *[pa.binary()] * 5))], ["part", "high", "low", "row", "at", "size"])


def _unpacked(batches: Iterator[pa.RecordBatch], low: type, size: type) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(part, its records) of all ranges of a task, one after another."""
    held: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        for part, *columns in zip(*(x.to_pylist() for x in batch.columns)):
            held[part].append(columns)
    kinds = (np.uint64, low, np.int64, np.uint16, size)
    for part in list(held):
        found = [[np.frombuffer(x, t) for x, t in zip(r, kinds)] for r in held.pop(part)]
        place = [np.ascontiguousarray(r[3].reshape(2, -1).T).view(np.uint32).ravel() for r in found]
        yield part, [np.concatenate(x) for x in ([r[0] for r in found], [r[1] for r in found], [np.cumsum(r[2]) for r in found], place, [r[4] for r in found])]


def _more_than_once(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of records whose hash occurs again, which distinct hash each is), hashes ascending."""
    order = np.argsort(high, kind="stable")
    same = high[order][1:] == high[order][:-1]
    again = np.append(same, False) | np.append(False, same) if len(order) else np.zeros(0, bool)
    order = order[again]
    order = order[np.lexsort((low[order], high[order]))]
    h, lo = high[order], low[order]
    new = np.append(True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]))[: len(h)]
    key = np.cumsum(new) - 1
    keep = np.bincount(key)[key] > 1 if len(key) else np.zeros(0, bool)
    return order[keep], key[keep]


def repeated_phrases(texts: DataFrame, parts: int) -> DataFrame:
    """(row, at, size, name) of every phrase that occurs twice; names ascend with the hash."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        powers = Powers()
        for batch in slices(batches, 10_000, SLICE):
            data, offsets = text_buffers(batch.column(1))
            at, text = anchors(data, offsets)
            k = np.flatnonzero(text[1:] == text[:-1])
            if len(k):
                start, end = at[k], at[k + 1] + GRAM
                yield _packed(parts, *Sums(data, powers).of(start, end), batch.column(0).to_numpy()[text[k]], start - offsets[text[k]], (end - start - GRAM).astype(np.uint32))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part, (high, low, row, at, size) in _unpacked(batches, np.uint32, np.uint32):
            order, key = _more_than_once(high, low)
            columns = (row[order], at[order].astype(np.int32), size[order].astype(np.int32), (part << 38) + key + 1)
            for i in range(0, len(order), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in columns], ["row", "at", "size", "name"])

    return only(texts, "row", "text").mapInArrow(send, _PACKED).repartition(parts, "part").mapInArrow(name, "row long, at int, size int, name long")


# --- the suffix sort ---------------------------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, list of each value, place in its list)."""
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    return column.flatten(), owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


def _list(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _ahead(values: np.ndarray, owner: np.ndarray, k: int, beyond: int = 0) -> np.ndarray:
    """The value k places on in the same list."""
    out = np.full(len(values), beyond, values.dtype)
    if len(values) > k:
        same = owner[k:] == owner[:-k]
        out[:-k][same] = values[k:][same]
    return out


def _strings(phrases: DataFrame, length: int) -> DataFrame:
    """(row, at, c, v): names of a row's phrases in order with a 0 where they break off, and their bytes; the 0 ends all."""
    rows = phrases.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "size", "name"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5_000, 8 << 20):
            flat, owner, _ = _lists(batch.column(1))
            at, size, name = (flat.field(k).to_numpy() for k in range(3))
            last = np.append(owner[1:] != owner[:-1], True)
            gap = last | (np.append(at[1:], 0) != at + size)
            place = np.arange(len(at)) + np.cumsum(gap) - gap
            n = len(at) + int(gap.sum())
            a, c, v = np.full(n, -1, np.int32), np.zeros(n, np.int64), np.full(n, length, np.int32)
            a[place], c[place], v[place] = at, name, size
            sizes = np.bincount(owner, minlength=batch.num_rows) + np.bincount(owner[gap], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), _list(a, sizes), _list(c, sizes), _list(v, sizes)], ["row", "at", "c", "v"])

    return rows.mapInArrow(run, "row long, at array<int>, c array<long>, v array<int>")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the number of the range (the last column) by the rank: the range, then the place in it; the
    empty triple is 0."""
    place = 1
    for batch in batches:
        rank = (batch.column(batch.num_columns - 1).to_numpy().astype(np.int64) << 38) + np.arange(place, place + batch.num_rows)
        rank[batch.column(0).to_numpy() == 0] = 0
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rank)], [*batch.schema.names[:-1], "name"])
        place += batch.num_rows


def _triples(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5_000, 4 << 20):
            c, owner, i = _lists(batch.column(1))
            c, v = c.to_numpy(), batch.column(2).flatten().to_numpy()
            one, two = _ahead(c, owner, 1), _ahead(c, owner, 2)
            two[one == 0] = 0
            one[c == 0] = two[c == 0] = 0
            cover = v.astype(np.int64) + np.where(one == 0, length, _ahead(v, owner, 1) + np.where(two == 0, length, _ahead(v, owner, 2)))
            k = np.flatnonzero(i % 3 != 0)
            row = batch.column(0).to_numpy()[owner[k]]
            columns = (row, i[k].astype(np.int32), c[k], one[k], two[k], np.minimum(cover[k], length).astype(np.int32))
            for j in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[j : j + 50_000]) for x in columns], ["row", "i", "c0", "c1", "c2", "v"])

    return run


KEY = ("x", "y", "z", "sample")  # what suffixes of one rank share
_POSITION = ["row", "i", "c0", "c1", "c2", "k", "r0", "r1", "r2"]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every position with what places it: ranks of the sampled suffixes from it on, and its first names."""
    for batch in slices(batches, 5_000, 4 << 20):
        c, owner, i = _lists(batch.column(1))
        c = c.to_numpy()
        n = batch.num_rows
        size = np.bincount(owner, minlength=n)
        rank = np.zeros(len(c), np.int64)
        for k in (1, 2):
            values, of, place = _lists(batch.column(1 + k))
            first = np.cumsum(size) - size
            rank[first[of] + 3 * place + k] = values.to_numpy()
        one, two = _ahead(c, owner, 1), _ahead(c, owner, 2)
        two[one == 0] = 0
        r1, r2 = _ahead(rank, owner, 1), _ahead(rank, owner, 2)
        keep = np.flatnonzero(c != 0)
        c, one, two, rank, r1, r2, i, row = c[keep], one[keep], two[keep], rank[keep], r1[keep], r2[keep], i[keep], batch.column(0).to_numpy()[owner[keep]]
        kind = i % 3
        r0 = np.where(kind == 0, 0, rank)
        r1[kind == 2] = r2[kind == 1] = r2[one == 0] = 0
        columns = (row, i.astype(np.int32), c, one, two, kind.astype(np.int32), r0, r1, r2)
        for j in range(0, len(keep), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[j : j + 50_000]) for x in columns], _POSITION)


def _keyed(positions: DataFrame) -> DataFrame:
    """Positions with ``KEY``, which their other columns give: it is found on reading, not stored."""
    sample = F.col("k") != 0
    key = (F.when(sample, F.col("r0")).otherwise(F.col("c0")), F.when(sample, 0).otherwise(F.col("r1")), F.when(sample, 0).otherwise(F.col("r2")), sample)
    out = positions.select("*", *(x.alias(name) for x, name in zip(key, KEY)))
    out.written_at = positions.written_at
    return out


def _done_with(*tables: DataFrame) -> None:
    """Delete tables that have served; the shuffle files of the jobs that ended go when the driver collects its garbage."""
    discard(*tables)
    tables[0].sparkSession._jvm.System.gc()


def _after(keys: list[np.ndarray], wanted: list[np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """For each wanted tuple, the largest rank among key tuples that aren't above it (0 if none)."""
    n = len(ranks)
    kind = np.append(np.zeros(n, np.int8), np.ones(len(wanted[0]), np.int8))
    order = np.lexsort((kind, *(np.append(k, w) for k, w in zip(keys[::-1], wanted[::-1]))))
    highest = np.maximum.accumulate(np.append(ranks, np.zeros(len(wanted[0]), np.int64))[order])
    out = np.empty(len(order), np.int64)
    out[order] = highest
    return out[n:]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge suffixes at 0 modulo 3 into the sampled ones of a range of first triples."""
    let_go()
    all_ = [b for b in batches if b.num_rows]
    if not all_:
        return
    whole = pa.Table.from_batches(all_)
    x, y, z, c0, c1, c2, kind, r0, r1, r2, row, i = (whole.column(k).to_numpy() for k in ("x", "y", "z", "c0", "c1", "c2", "k", "r0", "r1", "r2", "row", "i"))
    zero, first, second = kind == 0, kind == 1, kind == 2
    below = r0.copy()
    below[zero] = np.maximum(
        _after([c0[first], r1[first]], [c0[zero], r1[zero]], r0[first]),
        _after([c0[second], c1[second], r2[second]], [c0[zero], c1[zero], r2[zero]], r0[second]),
    )
    order = np.lexsort((r2, r1, c2, c1, c0, zero, below))
    # Several samples of one rank stand together, for they have one tuple (x = their rank).
    rank = (int(whole.column("range")[0].as_py()) << 38) + 1 + np.arange(len(order))
    columns = (x[order], y[order], z[order], ~zero[order], rank, row[order], i[order])
    for j in range(0, len(order), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[j : j + 50_000]) for v in columns], ["x", "y", "z", "sample", "rank", "row", "i"])


def suffix_ranks(strings: DataFrame, length: int, parts: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(positions: row, i, x, y, z, sample and more; distinct suffixes: x, y, z, sample, rank and a row and i of one)
    of strings (row, c, v) of ``size`` names together; equal suffixes of one kind, as far as ``length`` bytes,
    have one rank."""
    triples = strings.select("row", "c", "v").mapInArrow(_triples(length), "row long, i int, c0 long, c1 long, c2 long, v int")
    distinct = triples.groupBy("c0", "c1", "c2").agg(F.count("*").alias("n"), F.first("v").alias("v"))
    # Ranks hold the number of the range, whatever tasks the ranges are then written by.
    ranged = distinct.repartitionByRange(parts, "c0", "c1", "c2").sortWithinPartitions("c0", "c1", "c2").withColumn("range", F.spark_partition_id())
    names = written(ranged.mapInArrow(_numbered, "c0 long, c1 long, c2 long, n long, v int, name long"), "repeats-names", size)
    named = triples.join(names.select("c0", "c1", "c2", "name"), ["c0", "c1", "c2"])
    string = (2 * F.col("row") + F.col("i") % 3 - 1).alias("row")
    shorter = written(named.groupBy(string).agg(F.sort_array(F.collect_list(F.struct("i", "name", "v"))).alias("all")).select("row", F.col("all.name").alias("c"), F.col("all.v").alias("v")), "repeats-strings", size)
    lower = ()
    if names.where(f"n > 1 and v < {length}").isEmpty():
        ranks = shorter.select("row", F.col("c").alias("r"))
    else:
        lower = suffix_ranks(shorter, length, parts, 2 * size // 3)
        found = lower[0].select("row", "i", *KEY).join(lower[1].select(*KEY, "rank"), list(KEY)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "rank"))).alias("all"))
        # Ends have rank 0 and no position of their own.
        ranks = shorter.select("row", "c").join(found, "row", "left").mapInArrow(_filled, "row long, r array<long>")
    pair = ranks.groupBy(F.shiftright("row", 1).alias("row")).agg(F.max(F.when(F.col("row") % 2 == 0, F.col("r"))).alias("one"), F.max(F.when(F.col("row") % 2 == 1, F.col("r"))).alias("two"))
    schema = "row long, i int, c0 long, c1 long, c2 long, k int, r0 long, r1 long, r2 long"
    positions = _keyed(written(strings.select("row", "c").join(pair, "row", "left").select("row", "c", "one", "two").mapInArrow(_positions, schema), "repeats-positions", size))
    _done_with(names, shorter, *lower)
    firsts = [F.first(k).alias(k) for k in ("c0", "c1", "c2", "k", "r0", "r1", "r2", "row", "i")]
    distinct = positions.groupBy(*KEY).agg(*firsts).repartitionByRange(parts, "c0", "c1", "c2").withColumn("range", F.spark_partition_id())
    suffixes = written(distinct.mapInArrow(_merged, "x long, y long, z long, sample boolean, rank long, row long, i int"), "repeats-suffixes", size)
    return positions, suffixes


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c, owner, _ = _lists(batch.column(1))
        size = np.bincount(owner, minlength=batch.num_rows)
        flat, of, _ = _lists(batch.column(2))
        rank = np.zeros(len(c), np.int64)
        if len(of):
            rank[(np.cumsum(size) - size)[of] + flat.field(0).to_numpy()] = flat.field(1).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), _list(rank, size)], ["row", "r"])


# --- classes and contexts ------------------------------------------------------------------------


def _prefixes(length: int):
    """(rank, names, covers): a suffix's names as far as ``length`` bytes or its end, and the bytes up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5_000, 4 << 20):
            c, owner, _ = _lists(batch.column(0))
            c, v = c.to_numpy(), batch.column(1).flatten().to_numpy()
            size = np.bincount(owner, minlength=batch.num_rows)
            flat, of, _ = _lists(batch.column(2))
            at = (np.cumsum(size) - size)[of] + flat.field(0).to_numpy()
            total = np.cumsum(v, dtype=np.int64)
            last = np.searchsorted(total, total[at] - v[at] + length)
            n = last + (c[last] != 0) - at
            for j in range(0, len(at), 20_000):
                own, m = at[j : j + 20_000], n[j : j + 20_000]
                place = np.repeat(own, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                covers = total[place] - np.repeat(total[own] - v[own], m)
                yield pa.RecordBatch.from_arrays([flat.field(1)[j : j + 20_000], _list(c[place], m), _list(covers.astype(np.int32), m)], ["rank", "names", "covers"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, class, shared, cover) by comparing the names of neighbours in the order of ranks."""
    let_go()
    all_ = [b for b in batches if b.num_rows]
    if not all_:
        return
    whole = pa.Table.from_batches(all_).combine_chunks()
    rank = whole.column("rank").to_numpy()
    names, _, _ = _lists(whole.column("names").chunk(0))
    names, covers = names.to_numpy(), whole.column("covers").chunk(0).flatten().to_numpy()
    size = np.asarray(whole.column("names").chunk(0).value_lengths()).astype(np.int64)
    first = np.cumsum(size) - size
    least = np.minimum(size[1:], size[:-1])
    alike, going, k = np.zeros(len(least), np.int64), np.arange(len(least)), 0
    while len(going):
        going = going[least[going] > k]
        going = going[names[first[going] + k] == names[first[going + 1] + k]]
        k += 1
        alike[going] = k
    same = (alike == size[1:]) & (alike == size[:-1])
    bytes_ = np.where(alike > 0, covers[first[:-1] + np.maximum(alike, 1) - 1], 0)
    # Ranges of different tasks differ in their first three names; what they share is two at most.
    edge = rank[1:] >> 38 != rank[:-1] >> 38
    two = covers[first + np.minimum(size, 2) - 1]
    same &= ~edge
    before, after = np.append(two[0], np.where(edge, two[1:], bytes_)), np.append(np.where(edge, two[:-1], bytes_), two[-1])
    begins = np.flatnonzero(np.append(True, ~same))
    of = np.cumsum(np.append(True, ~same)) - 1
    shared = np.maximum(before[begins], after[np.append(begins[1:], len(rank)) - 1])
    columns = (rank, rank[begins][of], shared[of], covers[first + size - 1])
    for j in range(0, len(rank), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[j : j + 50_000]) for x in columns], ["rank", "class", "shared", "cover"])


def _contexts(length: int):
    """(row, at, left, before, class, shared, cover) of every phrase; ``before`` names the phrase before it
    where that and the class settle all windows between, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5_000, 4 << 20):
            at, owner, _ = _lists(batch.column(1))
            at, c, v = at.to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            size = np.bincount(owner, minlength=batch.num_rows)
            flat, of, _ = _lists(batch.column(4))
            place = (np.cumsum(size) - size)[of] + flat.field(0).to_numpy()
            of_class, shared, cover = (flat.field(k).to_numpy() for k in (1, 2, 3))
            known = (place > 0) & (owner[place - 1] == owner[place]) & (c[place - 1] != 0)
            before = np.where(known & (cover >= length), c[place - 1], 0)
            columns = (batch.column(0).to_numpy()[owner[place]], at[place], np.where(known, v[place - 1], 0).astype(np.int32), before, of_class, shared, cover)
            for j in range(0, len(place), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[j : j + 50_000]) for x in columns], ["row", "at", "left", "before", "class", "shared", "cover"])

    return run


def contexts(strings: DataFrame, length: int, parts: int, size: int) -> DataFrame:
    """(row, at, left, sure, bound) of every phrase that repeats: windows whose first anchor it is, of the
    ``left`` bytes before it, repeat where ``sure``; those whose last anchor is within ``bound`` bytes
    (-1: none) may."""
    positions, suffixes = suffix_ranks(strings, length, parts, size)
    some = suffixes.groupBy("row").agg(F.collect_list(F.struct("i", "rank")).alias("all"))
    prefixes = strings.select("row", "c", "v").join(some, "row").select("c", "v", "all").mapInArrow(_prefixes(length), "rank long, names array<long>, covers array<int>")
    ordered = prefixes.repartition(parts, F.shiftright("rank", 38)).sortWithinPartitions("rank")
    classes = written(ordered.mapInArrow(_compared, "rank long, class long, shared int, cover int"), "repeats-classes", size)
    told = suffixes.select(*KEY, "rank").join(classes, "rank")
    found = positions.select("row", "i", *KEY).join(told, list(KEY)).groupBy("row").agg(F.collect_list(F.struct("i", "class", "shared", "cover")).alias("all"))
    rows = written(strings.select("row", "at", "c", "v").join(found, "row").mapInArrow(_contexts(length), "row long, at int, left int, before long, class long, shared int, cover int"), "repeats-contexts", size)
    _done_with(positions, suffixes, classes)
    groups = rows.groupBy("class", "before").agg(F.count("*").alias("n"), F.first("row").alias("one_row"), F.first("at").alias("one_at"))
    groups = written(groups, "repeats-groups", size)
    several = groups.groupBy("class").agg(F.sum("n").alias("members"), ((F.count("*") > 1) | F.max((F.col("before") == 0) & (F.col("n") > 1))).alias("several"))
    all_ = rows.join(groups.join(several, "class"), ["class", "before"])
    settled = F.col("before") != 0
    met = F.when(F.col("several"), F.col("cover")).otherwise(F.col("shared"))
    other = settled & (F.col("n") > 1) & ~((F.col("row") == F.col("one_row")) & (F.col("at") == F.col("one_at")))
    out = written(all_.select("row", "at", "left", (settled & (F.col("n") > 1)).alias("sure"), F.when(other, -1).otherwise(met).cast("int").alias("bound")), "repeats-marks", size)
    _done_with(rows, groups)
    return out


# --- windows -------------------------------------------------------------------------------------

MARK = np.dtype([("row", "<i8"), ("at", "<i4"), ("left", "<i4"), ("bound", "<i4"), ("sure", "<i4")])
RUN = np.dtype([("row", "<i8"), ("low", "<i4"), ("high", "<i4")])


def _filed(rows: DataFrame, dtype: np.dtype, folder: str, parts: int) -> set[int]:
    """Write rows into one sorted file for each partition of the table (its number is above bit 33 of a row's);
    returns those that have a file, a number a partition of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            own = np.zeros(batch.num_rows, dtype)
            for name in dtype.names:
                own[name] = batch.column(name).cast(pa.int64()).to_numpy()
            held.append(own)
        own = np.concatenate(held) if held else np.zeros(0, dtype)
        del held
        own = own[np.lexsort((own["at"], own["row"]))]
        of = own["row"] >> 33
        files = np.unique(of)
        for k in files:
            put_file(f"{folder}/{k:010d}.bin", own[np.searchsorted(of, k) : np.searchsorted(of, k, "right")].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(files)], ["file"])

    placed = rows.select(*dtype.names).repartition(parts, F.shiftright("row", 33))
    return {r[0] for r in written(placed.mapInArrow(run, "file long"), "repeats-files").toLocalIterator()}


def runs_of(keys: np.ndarray, file: int) -> np.ndarray:
    """Runs of starts that follow one another in a row, from all starts of a partition (see ``repeated_windows``)."""
    keys = np.sort(keys)
    new = np.append(True, keys[1:] != keys[:-1] + np.uint64(1))[: len(keys)]
    first, last = keys[new], keys[np.append(new[1:], True)[: len(keys)]]
    out = np.zeros(len(first), RUN)
    out["row"], out["low"], out["high"] = (first >> np.uint64(31)).astype(np.int64) + (file << 33), first & np.uint64((1 << 31) - 1), last & np.uint64((1 << 31) - 1)
    return out


def _runs_filed(starts: DataFrame, folder: str, parts: int) -> set[int]:
    """Write the packed starts of ``repeated_windows`` as runs into one sorted file for each partition of the table,
    and return those, as ``_filed`` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        for batch in batches:
            for file, keys in zip(*(x.to_pylist() for x in batch.columns)):
                held[file].append(np.cumsum(np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()))
        files = sorted(held)
        for k in files:
            put_file(f"{folder}/{k:010d}.bin", runs_of(np.concatenate(held.pop(k)), k).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64())], ["file"])

    return {r[0] for r in written(starts.repartition(parts, "file").mapInArrow(run, "file long"), "repeats-files").toLocalIterator()}


def _looked_up(rows: np.ndarray, folder: str, files: set[int], dtype: np.dtype) -> np.ndarray:
    """What the files hold for ascending rows of a batch, ``row`` replaced by its place in the batch."""
    out = [np.zeros(0, dtype)]
    for k in np.unique(rows >> 33):
        if int(k) in files:
            table = map_file(f"{folder}/{k:010d}.bin").view(dtype)
            own = np.array(table[np.searchsorted(table["row"], rows[0]) : np.searchsorted(table["row"], rows[-1], "right")])
            own["row"] = np.searchsorted(rows, own["row"])
            out.append(own)
    return np.concatenate(out)


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, value) of all values of inclusive intervals."""
    n = np.maximum(high - low + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def open_windows(offsets: np.ndarray, at: np.ndarray, text: np.ndarray, marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows that have to be compared by their bytes, whether they aren't known to repeat)."""
    begin, end = offsets[:-1], offsets[1:]
    reach = length - GRAM
    far = np.int64(1) << 60
    # Windows by their first anchor; each text has one more turn for what follows its last anchor.
    turn = np.concatenate([text, np.arange(len(begin))])
    first = np.concatenate([at, end])
    order = np.lexsort((first, turn))
    turn, first = turn[order], first[order]
    low = np.append(0, first[:-1] + 1) if len(first) else first
    fresh = np.append(True, turn[1:] != turn[:-1])[: len(turn)]
    low[fresh] = begin[turn[fresh]]
    nxt = np.append(first[1:], far)[: len(first)]
    last = np.append(turn[1:] != turn[:-1], True)[: len(turn)]
    # ``first`` of a text's last turn is its end: no anchor there, nor after the last anchor.
    nxt[last] = far
    before_last = np.append(last[1:], False)[: len(last)]
    nxt[before_last] = far
    top = np.minimum(first, end[turn] - length)
    few = np.minimum(top, nxt - reach - 1)
    starts = _expanded(low, few)[1]
    marks = marks[marks["bound"] >= 0]
    turn_of = np.empty(len(order), np.int64)
    turn_of[order] = np.arange(len(order))
    k, bound = turn_of[np.searchsorted(at, begin[marks["row"]] + marks["at"])], marks["bound"]
    stop = np.searchsorted(at, first[k] + bound, "right")
    beyond = np.where((stop < len(at)) & (np.append(text, -1)[stop] == turn[k]), np.append(at, far)[stop], far)
    which, more = _expanded(np.maximum(low[k], few[k] + 1), np.minimum(top[k], beyond - reach - 1))
    starts = np.append(starts, more)
    order = np.argsort(starts, kind="stable")
    return starts[order], np.append(np.ones(len(starts) - len(more), bool), marks["sure"][which] == 0)[order]


def repeated_windows(texts: DataFrame, folder: str, files: set[int], length: int, parts: int) -> DataFrame:
    """(file, keys) of the compared windows whose hash occurs again, without those known to repeat: the partition
    and, packed, each window's row there and its start (the low 31 bits), as ascending differences byte by byte."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        powers = Powers()
        for batch in slices(batches, 10_000, SLICE):
            rows = batch.column(0).to_numpy()
            data, offsets = text_buffers(batch.column(1))
            at, text = anchors(data, offsets)
            start, unknown = open_windows(offsets, at, text, _looked_up(rows, folder, files, MARK), length)
            if len(start):
                text = np.searchsorted(offsets, start, "right") - 1
                high, low = Sums(data, powers).of(start, start + length)
                yield _packed(parts, high, (low >> np.uint32(16)).astype(np.uint16), rows[text], start - offsets[text], unknown)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for _, (high, low, row, at, unknown) in _unpacked(batches, np.uint16, np.bool_):
            order, _ = _more_than_once(high, low)
            order = order[unknown[order]]
            row, at = row[order], at[order].astype(np.uint64)
            file, keys = row >> 33, (row & (1 << 33) - 1).astype(np.uint64) << np.uint64(31) | at
            order = np.lexsort((keys, file))
            file, keys = file[order], keys[order]
            for k in np.unique(file):
                own = np.diff(keys[np.searchsorted(file, k) : np.searchsorted(file, k, "right")], prepend=np.uint64(0))
                packed = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8).T).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed], pa.binary())], ["file", "keys"])

    return only(texts, "row", "text").mapInArrow(send, _PACKED).repartition(parts, "part").mapInArrow(found, "file long, keys binary")


def removed_spans(size: int, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs covered by windows that start within the intervals."""
    keep = low <= high
    low, high = low[keep], high[keep] + length
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(order) else high
    new = np.append(True, low[1:] > high[:-1])[: len(low)]
    return low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1] if len(low) else high


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; ``kept`` is the text left (binary)."""
    parts = parts_for(documents, 8 << 20)
    numbered = only(documents, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    texts = written(numbered, "repeats-texts")
    phrases = repeated_phrases(texts, parts)
    strings = written(_strings(phrases, length), "repeats-strings", texts.count())
    size = strings.agg(F.coalesce(F.sum(F.size("c")), F.lit(0))).first()[0]
    marks = contexts(strings, length, parts, size)
    folder = new_folder(documents.sparkSession, "repeats")
    files = _filed(marks, MARK, f"{folder}/marks", parts)
    starts = repeated_windows(texts, f"{folder}/marks", files, length, parts)
    more = _runs_filed(starts, f"{folder}/starts", parts)
    discard(strings, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, 10_000, SLICE):
            rows = batch.column(0).to_numpy()
            data, offsets = text_buffers(batch.column(2))
            own, compared = _looked_up(rows, f"{folder}/marks", files, MARK), _looked_up(rows, f"{folder}/starts", more, RUN)
            own = own[own["sure"] == 1]
            size = np.diff(offsets)
            of = np.append(own["row"], compared["row"])
            low = np.append(own["at"] - own["left"] + 1, compared["low"]).astype(np.int64)
            high = np.minimum(np.append(own["at"], compared["high"]), size[of] - length)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(rows) + 1))
            out = []
            for k in range(len(rows)):
                mine = order[ends[k] : ends[k + 1]]
                start, end = removed_spans(size[k], low[mine], high[mine], length)
                text = data[offsets[k] : offsets[k + 1]]
                if len(start):
                    text = np.concatenate([text[a:b] for a, b in zip(np.append(0, end), np.append(start, size[k]))])
                text = text.tobytes()
                out.append((int(size[k]), int((end - start).sum()), len(start), hashlib.sha256(text).hexdigest(), text))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("row", "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
