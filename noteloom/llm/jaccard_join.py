"""Exact Jaccard join of documents' word-shingle sets, by prefix filtering with set relations.

Documents link when their sets' Jaccard similarity is at least 3/4. The steps, all linear in
what they shuffle (sets travel as packed arrays of 48-bit shingle hashes, cut by hash range):

1. ``set_table``: per document the hash of its set and the set's size; equal sets are one later.
   Shingles that a large share of a batch's sets hold are counted aside: those held by at least
   ``HEAVY`` of all sets are few (the mean set size / HEAVY), whatever the corpus.
2. Count in how many sets each other shingle occurs. A set's shingles that occur elsewhere go
   back to its batch with their counts; the rest can't be shared and only count.
3. In the order of (count, hash), two linked sets share one of their first n - ceil(3n/4) + 1
   shingles. The index lists of these prefix shingles are sorted by set size, and skipped by
   position: a set whose shingle stands at position i can only link to sets of at most
   7(n - i)/3 - n shingles, so a list falls apart where no earlier set reaches the next size.
4. The parts of lists chain sets into candidate groups (``connected``), and every set goes to
   its group once. There (``link_group``) a leader's answers come from the group's index lists,
   skipped by position; a set linked to it takes them over and changes them by the lists of the
   difference only.
5. Components of sets become components of documents; the smallest doc_id names them.

A group of more than ``GROUP_SHINGLES`` shingles is cut into chunks, and each pair of chunks is
linked by a task of its own, so memory stays bounded and no link is lost.

The exchange of shingles has a row a batch and bucket. Both follow the input; from some
10 TB on, more rows a batch (up to 65,535) keep these rows long.

Nulls and edge cases: a null text and one without words have the empty set: no links, itself as
component; sets of fewer than five words are the whole sequence as one shingle; rows with equal
text are linked through their common set; rows that repeat a doc_id count each; null doc_ids
name a component only where it has no other; an empty table gives no rows; further columns are
ignored, and the result's own columns don't clash with them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.components import connected, join_hot
from noteloom.llm.shared import discard, input_bytes, let_go, mix, only, parts_for, slices, written
from noteloom.llm.textscan import distinct_shingles, word_hashes

WORDS = 5
HEAVY = 0.01
GROUP_SHINGLES = 4_000_000
_BITS = np.uint64(16)  # 64-bit hashes are cut to 48 bits


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit shingle, text) sorted by shingle, then set size and set hash of every text."""
    h, w = word_hashes(column)
    s, t = distinct_shingles(h, w, WORDS)
    n = len(w) - 1
    size = np.bincount(t, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, t, mix(s ^ np.uint64(0xA0761D6478BD642F)))
    ident = (mix(total + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return s >> _BITS, t, size, ident


def _unique_rows(ident: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mask of the first text of each distinct nonempty set."""
    keep = np.zeros(len(ident), bool)
    keep[np.unique(ident, return_index=True)[1]] = True
    return keep & (size > 0)


def _count(size: int) -> int:
    return max(8, int(size * HEAVY / 2))


def set_table(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Written rows: (doc_id, set_id, n, the columns to carry) of every document, and (token, df) of frequent shingles in a batch."""
    kept = documents.select(*(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(carry)), F.col("`doc_id`"), F.col("`text`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, 1500, 8 << 20):
            s, t, size, ident = _sets(batch.column(len(carry) + 1))
            none = pa.nulls(batch.num_rows, pa.int64())
            names = [*batch.schema.names[:-1], "set_id", "n", "token", "df"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ident), pa.array(size.astype(np.int64)), none, none], names)
            keep = _unique_rows(ident, size)
            token, df = np.unique(s[keep[t]], return_counts=True)
            many = df >= _count(int(keep.sum()))
            none = pa.nulls(int(many.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(none), c.type) for c in batch.columns[:-1]), none, none, pa.array(token[many].astype(np.int64)), pa.array(df[many])], names)

    schema = "".join(f"{c} {kind}, " for c, kind in kept.dtypes[:-1]) + "set_id long, n long, token long, df long"
    table = written(kept.mapInArrow(run, schema), "jaccard-sets")
    return table.withColumnsRenamed({f"kept{i}": c for i, c in enumerate(carry)})


def _pack(part: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, bytes of each column) for rows dealt to parts."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        own = order[ends[p] : ends[p + 1]]
        yield (p, *(c[own].tobytes() for c in columns))


_PACKED = "part int, kind int, a binary, b binary, c binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["part", "kind", "a", "b", "c"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], list[tuple[bytes, bytes, bytes]]]:
    held: dict[tuple[int, int], list] = defaultdict(list)
    for batch in batches:
        for part, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            held[part, kind].append((a, b, c))
    return held


def _home(ref: int, homes: int) -> int:
    """Where a batch's sets meet again what is known of their shingles (dealt in turn)."""
    return ((ref >> 20) * 3 + (ref & 0xFFFFF)) % homes


def _tokens_out(documents: DataFrame, heavy: tuple[np.ndarray, np.ndarray], buckets: int, homes: int) -> DataFrame:
    """kind 0: shingles by bucket (sorted, as differences where those fit 32 bits), each with its
    set's number in the batch; kind 1: by home of the batch, its sets and their sizes; kind 2: their
    heavy shingles. The batch's own number (task and batch) stands once a row, so a shingle
    costs about six bytes at any number of buckets."""
    shipped = documents.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        common = shipped.value[0]
        task = TaskContext.get().partitionId() << 20
        for nth, batch in enumerate(slices(batches, 2000, 8 << 20)):
            ref, mark = task + nth, np.int64(task + nth).tobytes()
            s, t, size, ident = _sets(batch.column(0))
            keep = _unique_rows(ident, size)
            own = keep[t]
            s, t = s[own], t[own]
            at = np.searchsorted(common, s)
            hot = common[np.minimum(at, len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
            who = np.flatnonzero(keep)
            local = np.zeros(len(keep), np.uint16)
            local[who] = np.arange(len(who))
            home = _home(ref, homes)
            rows = [(home, 1, ident[who].tobytes(), size[who].astype(np.int64).tobytes(), mark)]
            if hot.any():
                rows.append((home, 2, local[t[hot]].tobytes(), s[hot].tobytes(), mark))
            s, holder = s[~hot], local[t[~hot]]
            ends = np.searchsorted(s, (np.arange(buckets + 1, dtype=np.float64) * 2.0**48 / buckets).astype(np.uint64))
            ends[-1] = len(s)
            for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                token = s[ends[p] : ends[p + 1]]
                gaps = np.diff(token, prepend=np.uint64(0))
                # a: first shingle and the gaps, or all shingles if a gap is too wide
                narrow = len(gaps) < 2 or gaps[1:].max() < 1 << 32
                a = b"\1" + token[:1].tobytes() + gaps[1:].astype(np.uint32).tobytes() if narrow else b"\0" + token.tobytes()
                rows.append((p, 0, a, holder[ends[p] : ends[p + 1]].tobytes(), mark))
            yield _batch(rows)

    return only(documents, "text").mapInArrow(run, _PACKED)


def _open(a: bytes) -> np.ndarray:
    if a[:1] == b"\0":
        return np.frombuffer(a, np.uint64, offset=1)
    first = np.frombuffer(a, np.uint64, 1, 1)
    return np.append(first, first + np.cumsum(np.frombuffer(a, np.uint32, offset=9), dtype=np.uint64))


def _six(token: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _count_shared(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """Shingles that two sets or more hold, back to their batches' homes with the counts (kind 0).

    Equal sets of several batches count once each: the counts only order the shingles, and any
    order that all sets share will do."""
    held = _by_part(batches)
    for key in list(held):
        rows = held.pop(key)
        token = np.concatenate([_open(a) for a, _, _ in rows])
        nth = np.repeat(np.arange(len(rows), dtype=np.int32), [len(b) // 2 for _, b, _ in rows])
        holder = np.concatenate([np.frombuffer(b, np.uint16) for _, b, _ in rows])
        marks = [c for _, _, c in rows]
        del rows
        order = np.argsort(token, kind="stable")
        token = token[order]
        edge = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        times = np.diff(np.append(edge, len(token)))
        df = np.repeat(times, times)
        some = df > 1
        token, order, df = token[some], order[some], df[some].astype(np.uint32)
        nth, holder = nth[order], holder[order]
        back = np.argsort(nth, kind="stable")
        ends = np.searchsorted(nth[back], np.arange(len(marks) + 1))
        out = []
        for i in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            own = back[ends[i] : ends[i + 1]]
            ref = int.from_bytes(marks[i], "little")
            out.append((_home(ref, homes), 0, holder[own].tobytes(), _six(token[own]), marks[i] + df[own].tobytes()))
        yield _batch(out)


def _candidates(packed: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(set_id, n, first, tokens): sets whose prefix holds shared shingles. tokens: all shared
    ones in the order (count, hash), of which ``first`` belong to the prefix; n - all others come
    before. A set that several batches hold may stand more than once, with the same tokens."""
    shipped = packed.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shipped.value
        held: dict[bytes, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for batch in batches:
            for kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns[1:])):
                held[c[:8]][kind].append((a, b, c[8:]))
        for ref in list(held):
            kinds = held.pop(ref)
            ident, n = (np.frombuffer(x, np.int64) for x in kinds[1][0][:2])
            hot = [np.frombuffer(b, np.uint64) for _, b, _ in kinds[2]]
            owner = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(a, np.uint16) for a, _, _ in kinds[2] + kinds[0])])
            token = np.concatenate([np.zeros(0, np.uint64), *hot, *(_from_six(b) for _, b, _ in kinds[0])])
            df = np.concatenate([np.zeros(0, np.int64), *(counts[np.searchsorted(common, x)] for x in hot), *(np.frombuffer(c, np.uint32).astype(np.int64) for _, _, c in kinds[0])])
            order = np.lexsort((token, df, owner))
            owner, token = owner[order], token[order]
            begin = np.searchsorted(owner, np.arange(len(ident) + 1))
            shared, begin = np.diff(begin), begin[:-1]
            prefix = n - -(-3 * n // 4) + 1
            inside = np.minimum(prefix - (n - shared), shared)
            keep = np.flatnonzero(inside > 0)
            lists = [token[begin[k] : begin[k] + shared[k]].tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([pa.array(ident[keep]), pa.array(n[keep]), pa.array(inside[keep]), pa.array(lists, pa.binary())], ["set_id", "n", "first", "tokens"])

    return packed.mapInArrow(run, "set_id long, n long, first long, tokens binary")


def _list_edges(table: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) that chain each part of each prefix shingle's index list."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            ident, n, first = (batch.column(i).to_numpy() for i in range(3))
            token = np.concatenate([np.frombuffer(x, np.uint64, int(k)) for x, k in zip(batch.column(3).to_pylist(), first)] or [np.zeros(0, np.uint64)])
            shared = np.array([len(x) // 8 for x in batch.column(3).to_pylist()], np.int64)
            who = np.repeat(np.arange(len(ident)), first)
            position = np.arange(len(who)) - np.repeat(np.cumsum(first) - first, first) + (n - shared)[who]
            reach = 7 * (n[who] - position) // 3 - n[who]
            size_reach = np.stack([n[who], reach], axis=1).astype(np.int64)
            yield _batch([(p, 0, a, b, c) for p, a, b, c in _pack((token % np.uint64(buckets)).astype(np.int64), buckets, token, ident[who], size_reach)])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _by_part(batches)
        for key in list(held):
            rows = held.pop(key)
            token = np.concatenate([np.frombuffer(a, np.uint64) for a, _, _ in rows])
            owner = np.concatenate([np.frombuffer(b, np.int64) for _, b, _ in rows])
            size, reach = np.concatenate([np.frombuffer(c, np.int64).reshape(-1, 2) for _, _, c in rows]).T
            order = np.lexsort((owner, size, token))
            token, owner, size, reach = token[order], owner[order], size[order], reach[order]
            new = np.append(True, token[1:] != token[:-1])[: len(token)]
            # The farthest any earlier set of the list reaches: a running maximum that restarts with each list.
            lists = np.cumsum(new)
            span = int(max(reach.max(initial=0), size.max(initial=0))) + 1
            farthest = np.maximum.accumulate(reach + lists * span) - lists * span
            new[1:] |= size[1:] > farthest[:-1]
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(token)))
            a, b = np.repeat(owner[start], count), owner
            pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return table.mapInArrow(out, _PACKED).repartition(buckets, "part").mapInArrow(chain, "a long, b long")


def link_group(sets: list[np.ndarray], sizes: np.ndarray, weights: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Component number of each set under links of Jaccard 3/4 or more, and the weight of all
    sets it links to. ``sets`` hold sorted shared shingles, ``sizes`` also count the others;
    with ``side`` only links between sets of different sides are weighed.

    Sets are numbered by size, so each shingle's index list ascends by size, and a set's possible
    partners are a range of numbers: lists are entered and left at that range's ends, what lies
    outside is skipped by position. Only a leader ``a`` goes through the lists of all its
    shingles; a set y linked to it takes its answers from a's, by the lists of the difference:
    |y & z| = |a & z| - |(a - y) & z| + |(y - a) & z|. For that a's answers cover the sizes that
    any such y may link to.
    """
    k = len(sets)
    by_size = np.argsort(sizes, kind="stable")
    size = np.asarray(sizes, np.int64)[by_size]
    weight = np.ones(k, np.int64) if weights is None else np.asarray(weights, np.int64)[by_size]
    apart = None if side is None else np.asarray(side)[by_size]
    each = np.array([len(sets[i]) for i in by_size], np.int64)
    begin = np.append(0, np.cumsum(each))
    flat = np.concatenate([sets[i] for i in by_size]) if k else np.zeros(0, np.uint64)
    token = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    keys = np.sort(token * k + np.repeat(np.arange(k), each)) if k else token
    listed = keys % max(k, 1)
    label, links, done = np.arange(k), np.zeros(k, np.int64), np.zeros(k, bool)

    def reach(low: int, high: int) -> tuple[int, int]:
        return int(np.searchsorted(size, low)), int(np.searchsorted(size, high, "right"))

    def holders(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of the shingles each set from number lo to hi holds."""
        a, b = np.searchsorted(keys, tokens * k + lo), np.searchsorted(keys, tokens * k + hi)
        n = b - a
        return np.bincount(listed[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())] - lo, minlength=hi - lo)

    def answer(i: int, row: np.ndarray, lo: int) -> np.ndarray:
        linked = np.flatnonzero(7 * row >= 3 * (size[i] + size[lo : lo + len(row)])) + lo
        linked = linked[linked != i]
        links[i] = weight[linked if apart is None else linked[apart[linked] != apart[i]]].sum()
        own = np.unique(label[np.append(linked, i)])
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
        return linked

    for a in range(k):
        if done[a]:
            continue
        done[a] = True
        mine = token[begin[a] : begin[a + 1]]
        lo, hi = reach(-(-9 * size[a] // 16), 16 * size[a] // 9)
        row = holders(mine, lo, hi)
        linked = answer(a, row, lo)
        for y in linked[~done[linked]].tolist():
            done[y] = True
            other = token[begin[y] : begin[y + 1]]
            low, high = reach(-(-3 * size[y] // 4), 4 * size[y] // 3)
            gone, come = (np.setdiff1d(x, z, assume_unique=True) for x, z in ((mine, other), (other, mine)))
            derived = row[low - lo : high - lo] - holders(gone, low, high) + holders(come, low, high)
            answer(y, derived, low)
    component, back = np.empty(k, np.int64), np.empty(k, np.int64)
    component[by_size], back[by_size] = by_size[label] if k else label, links
    return component, back


def _link(grouped: DataFrame) -> DataFrame:
    """(a, b, links): each set with a representative of its component within its (sorted) group,
    and the documents of the sets there that it links to."""

    def emit(held: list[tuple]) -> pa.RecordBatch:
        ident = np.array([x[0] for x in held], np.int64)
        side = np.array([x[4] for x in held], np.int64)
        sets = [np.sort(np.frombuffer(x[3], np.uint64)) for x in held]
        found, links = link_group(sets, np.array([x[2] for x in held], np.int64), np.array([x[1] for x in held], np.int64), side if side.any() else None)
        return pa.RecordBatch.from_arrays([pa.array(ident), pa.array(ident[found]), pa.array(links)], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for group, chunk, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, chunk) != now and held:
                    yield emit(held)
                    held = []
                now = group, chunk
                if not held or held[-1][0] != row[0]:  # equal sets of several batches stand side by side
                    held.append(row)
        if held:
            yield emit(held)

    return grouped.select("root", "chunk", "set_id", "weight", "n", "tokens", "side").mapInArrow(run, "a long, b long, links long")


def set_components(documents: DataFrame, table: DataFrame, weights: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Written (set_id, component, links): of distinct sets linked to another one, their component
    and the documents (``weights``) of all sets linked to them."""
    sets = table.where("doc_id is not null or set_id is not null").agg(F.approx_count_distinct("set_id")).first()[0]
    frequent = table.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= max(8, HEAVY / 2 * sets)).toArrow()
    order = np.argsort(frequent.column(0).to_numpy())
    heavy = (frequent.column(0).to_numpy()[order].astype(np.uint64), frequent.column(1).to_numpy()[order] + (1 << 32))
    buckets = parts_for(documents, 8 << 20)
    homes = parts_for(documents, 24 << 20)
    sent = _tokens_out(documents, heavy, buckets, homes).withColumn("home", F.col("kind") > 0)
    sent = sent.repartition(buckets, "part", "home")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket rows are counted; rows for homes pass on."""
        counted = []
        for batch in batches:
            here, home = batch.select(["part", "kind", "a", "b", "c"]), batch.column(1).to_numpy() > 0
            if home.any():
                yield here.filter(pa.array(home))
            counted.append(here.filter(pa.array(~home)))
        yield from _count_shared(iter(counted), homes)

    back = sent.mapInArrow(split, _PACKED).repartition(homes, "part")
    candidates = written(_candidates(back, heavy), "jaccard-candidates")
    lists = max(1, -(-input_bytes(candidates) // (32 << 20)))
    some_rows = candidates.count()
    chained = connected(_list_edges(candidates, lists), some_rows)
    groups = chained.withColumnRenamed("node", "set_id")
    rows = candidates.join(groups.join(weights, "set_id"), "set_id")
    sizes = groups.join(candidates.select("set_id", F.octet_length("tokens").alias("bytes")), "set_id").groupBy("root").agg(F.sum("bytes").alias("bytes"))
    large = written(sizes.where(F.col("bytes") > 8 * group_shingles).withColumn("chunks", F.ceil(F.col("bytes") / (4 * group_shingles)).cast("int")).select("root", "chunks"), "jaccard-large", some_rows)
    # Groups beyond the limit hold at least that much each, so their list is the input's size over
    # it; the hint is given up to a million of them.
    some = large.count()
    marked = rows.join(F.broadcast(large) if some <= 1 << 20 else large, "root", "left")
    mine = F.pmod("set_id", F.col("chunks")).cast("long")
    whole = marked.where("chunks is null").withColumn("chunk", F.lit(0).cast("long")).withColumn("side", F.lit(0).cast("long"))
    # Side 0: all pairs of the task count; else only those of two chunks, which are the sides.
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct((F.least(mine, j.cast("long")) * F.col("chunks") + F.greatest(mine, j.cast("long"))).alias("chunk"), F.when(mine == j, 0).otherwise(mine + 1).alias("side")))
    parted = marked.where("chunks is not null").withColumn("met", F.explode(met)).select("*", "met.chunk", "met.side")
    tasks = max(1, -(-input_bytes(candidates) // (8 << 20)))
    names = ["root", "chunk", "set_id", "weight", "n", "tokens", "side"]
    linked = written(_link(whole.select(names).unionByName(parted.select(names)).repartition(tasks, "root", "chunk").sortWithinPartitions("root", "chunk", "set_id")), "jaccard-links")
    discard(candidates, chained.made_from, large)
    pairs = linked.where("a <> b").select("a", "b")
    if not some:  # each set in one task: its pair names the component already
        done = linked.select(F.col("a").alias("set_id"), F.col("b").alias("component"), "links")
        done.written_at = linked.written_at
        return done
    whole_parts = connected(pairs, some_rows)
    found = whole_parts.select(F.col("node").alias("set_id"), F.col("root").alias("component"))
    links = linked.groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    done = written(links.join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "jaccard-components")
    discard(linked, whole_parts.made_from)
    return done


def near_duplicates(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns to ``carry``, n_shingles, component_id, n_links, class_id) of every document.

    n_links counts the other documents it is linked to; class_id is the set that stands for its
    component (null without words), the same for all its documents whatever their doc_ids.
    """
    table = set_table(documents, carry)
    rows = table.where("token is null").select("doc_id", *carry, "set_id", F.col("n").alias("n_shingles"))
    filled = rows.where("n_shingles > 0")
    n_rows = table.count()
    first = written(filled.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight")), "jaccard-weights", n_rows)
    parts = set_components(documents, table, first.select("set_id", "weight"))
    named = first.join(parts, "set_id", "left").select("set_id", "first", F.coalesce("component", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    smallest = named.groupBy("class_id").agg(F.min("first").alias("component_id"))
    classes = written(join_hot(named, smallest, "class_id").select("set_id", "class_id", "component_id", "n_links"), "jaccard-classes", n_rows)
    discard(first, parts)
    names = ["doc_id", *carry, "n_shingles", "component_id", "n_links", "class_id"]
    full = join_hot(filled, classes, "set_id").select(names)
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long")).withColumn("class_id", F.lit(None).cast("long"))
    return full.unionByName(empty.select(names))
