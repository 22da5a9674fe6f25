"""Best-fit packing of tokenised documents into sequences of a fixed length.

1. Tokenise every whole text (``token_pieces``), append the end id and cut only what exceeds
   the capacity: the first piece takes the remainder, the others are full.
2. Count pieces by length: at most ``capacity`` numbers, whatever the corpus, so the packing
   problem itself fits the driver as a bin-packing instance with multiplicities.
3. Reduce it by Martello-Toth dominance (``reduce_instance``): from the largest length down,
   where some small set holding it provably dominates every other way to fill its sequence from
   all that is left, fix it as often as the counts allow. The rest is packed best-fit decreasing.
4. Hand the plan back: pieces of one length are interchangeable, so a piece's rank among its
   length decides its place. Ranks come from windows over (length, salt), where the number of
   salts follows a length's count, so that no task gets an unbounded group.

Nulls and edge cases: a null text is the empty one and still gets its end id; repeated rows are
packed once each; a null doc_id is carried as null; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.shared import only, slices, trim, written
from noteloom.llm.tokenids import encoder

ROWS_PER_RANK_TASK = 200_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, spaces_matter: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        codes = encoder(tokenizer, spaces_matter)
        for batch in slices(batches, 2000, 8 << 20):
            ids, at = codes.encode(batch.column(1))
            whole = memoryview(np.insert(ids, at[1:], end_id).astype("<u4", copy=False)).cast("B")
            size = np.diff(at) + 1
            begin = np.cumsum(size) - size
            times = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), times)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
            first = (size - (times - 1) * capacity)[owner]  # the first piece takes the remainder
            start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first)
            low = (begin[owner] + start) * 4
            crc = [zlib.crc32(whole[a:b]) for a, b in zip(low.tolist(), (low + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(documents, "doc_id", "text").mapInArrow(cut, PIECES)


def _dominating(item: int, lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The set of at most three lengths, holding ``item``, that provably dominates all others, or None.

    ``lengths`` ascends and holds all lengths still to pack, shorter or longer (``item`` itself
    once fewer). A set dominates another if the other's items can be dealt onto its own items
    so that each takes no more than its own length; swapping then never costs a sequence.
    """
    room = capacity - item
    if not lengths or lengths[0] > room:
        return (item,)
    best = lengths[bisect_left(lengths, room + 1) - 1]
    if best == room:
        return (item, best)
    small = [x for x in lengths[:3] for _ in range(min(3, counts[x]))][:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return (item, best)  # no two fit beside it: the longest single one is best
    if len(small) == 3 and sum(small) <= room:
        return None
    # Pairs at most: a single item as long as any pair's sum dominates, else perhaps one pair.
    pairs = []
    for i, a in enumerate(lengths):
        if 2 * a > room:
            break
        j = bisect_left(lengths, room - a + 1) - 1
        if j > i or (j == i and counts[a] > 1):
            pairs.append((a, lengths[j]))
        elif j > 0:  # a meets itself only once: the next shorter one, seen from the other side
            pairs.append((lengths[j - 1], a))
    if best >= max(a + b for a, b in pairs):
        return (item, best)
    a, b = max(pairs, key=lambda p: (p[1], p[0]))
    if b >= best and all(a >= x and b >= y for x, y in pairs):
        return (item, a, b)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix dominating sets, from the largest length down: ([(set, how often)], lengths left over).

    A length without a dominating set is put by, but stays among what later lengths may be
    packed with, so a set that is fixed dominates within all that is left: the least number of
    sequences is that of the sets fixed plus the least number for the rest.
    """
    left = {k: v for k, v in counts.items() if v}
    fixed: list[tuple[tuple[int, ...], int]] = []
    order = sorted(left)
    for item in reversed(order.copy()):
        while left.get(item):
            left[item] -= 1
            chosen = _dominating(item, order if left[item] else [x for x in order if x != item], left, capacity)
            left[item] += 1
            if chosen is None:
                break
            need: dict[int, int] = defaultdict(int)
            for x in chosen:
                need[x] += 1
            # While the set's own items last it stays the best: what it is compared with only gets less.
            times = min(left[x] // n for x, n in need.items())
            fixed.append((chosen, times))
            for x, n in need.items():
                left[x] -= n * times
                if not left[x]:
                    del left[x]
                    order.remove(x)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing with multiplicities: [(lengths in a sequence, how often)]."""
    rooms: dict[int, list[list]] = defaultdict(list)
    free: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in rooms or not rooms[room]:
            insort(free, room)
        rooms[room].append([pattern, times])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(free, length)
            if i == len(free):
                each = min(n, capacity // length)
                times = n // each
                put(capacity - each * length, (length,) * each, times)
                n -= each * times
                continue
            room = free[i]
            pattern, times = rooms[room][-1]
            if n >= times:
                each = min(room // length, n // times)
                rooms[room].pop()
            else:
                each, rooms[room][-1][1] = 1, times - n
                times = n
            if not rooms[room]:
                free.pop(i)
                del rooms[room]
            put(room - each * length, pattern + (length,) * each, times)
            n -= each * times
    return [(p, t) for room in rooms.values() for p, t in room]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Every length as often as counted, in patterns that fit the capacity.

    Best fit takes the whole of what the reduction leaves. Where best fit alone happens to need
    fewer sequences (the reduction keeps the optimum, best fit of the rest may still miss it),
    that plan is returned: never more sequences than plain best fit decreasing.
    """
    full = [((k,), v) for k, v in counts.items() if k == capacity]
    rest = {k: v for k, v in counts.items() if 0 < k < capacity}
    fixed, left = reduce_instance(rest, capacity)
    plans = [fixed + best_fit(left, capacity), best_fit(rest, capacity)]
    return full + min(plans, key=lambda plan: sum(times for _, times in plan))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with length, doc_id, piece) plus sequence_id and offset; best call it on a written table."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    salts = {k: -(-n // ROWS_PER_RANK_TASK) for k, n in counts.items()}
    many = spark.createDataFrame([(k, s) for k, s in salts.items() if s > 1], "length int, salts int")
    salted = pieces.join(F.broadcast(many), "length", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")

    base: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = defaultdict(int)
    for length, salt, n in sorted(map(tuple, salted.groupBy("length", "salt").count().collect())):
        base[length, salt] = seen[length]
        seen[length] += n

    rows, used, sequence = [], defaultdict(int), 0
    for pattern, times in plan_sequences(counts, capacity):
        place = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, used[length], used[length] + each * times, each, sequence, place))
            used[length] += each * times
            place += each * length
        sequence += times
    plan = spark.createDataFrame(rows, "length int, low long, high long, each long, sequence long, place long")
    bases = spark.createDataFrame([(k, s, b) for (k, s), b in base.items()], "length int, salt int, base long")

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(F.broadcast(bases), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "salt")
    # The plan has a few rows a length (its size follows the capacity, not the corpus).
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(plan["length"])
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *pieces.columns,
        (F.col("sequence") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("place") + (nth % F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """All documents packed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = written(token_pieces(documents, tokenizer, end_id, capacity), "pieces")
    packed = pack(pieces, capacity)
    return packed.withColumn("length", F.col("length").cast("long"))
