"""Exact similarity of unit vectors with pruning: clusters with a radius, compared only where the triangle
inequality leaves a chance.

A bounded number of the table's own vectors, the first by hash, are centres; each vector joins the nearest and a
cluster's radius is its largest angle. The angle between two vectors is at least that between the one and
the other's centre less the radius, so a vector is sent only to clusters where that leaves room
for the angle it looks for. Vectors travel packed, some thousand a row: a cluster's rows once for
every row of vectors sent to it. Zero vectors have cosine 0 with all others and no angle; they are
a cluster of their own that is never ruled out.

Where many clusters are left open to a vector, sending it to each costs more than it spares. Such
vectors stay together in bands, one task each, and all vectors pass by every band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.operators.common import materialised, top_per

#: Vectors a centre stands for, centres at most (they and their radii go to every task), vectors packed in a row.
PER_CENTRE, MOST_CENTRES, PACKED = 512, 2048, 2048
#: Clusters a vector is sent to at most; vectors of a band; of them compared at once; pairs that wait to be ranked.
SENT, BAND, SLICE, WAITING = 16, 32_768, 1024, 4_000_000
#: Scores are rounded to six places, so one that looks equal may lie this much lower.
ROUNDING = 1e-6


def rows_of(column: pa.Array) -> np.ndarray:
    size = len(column.flatten()) // max(len(column), 1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)


def angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))


@dataclass
class Reach:
    """Centres and radii; the last radius is that of the zero vectors' cluster."""

    centres: np.ndarray
    radii: np.ndarray

    def of(self, v: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Whether each cluster may hold a vector within that angle of each vector."""
        away = angle(v @ self.centres.T) - self.radii[:-1] <= within[:, None] + 1e-6
        away[~v.any(axis=1)] = True
        return np.append(away, np.ones((len(v), 1), bool), axis=1)


@dataclass
class Clusters:
    """Vectors (id, v, c) by cluster, packed rows (c, lists of id and v) of them, and what rules clusters out."""

    rows: DataFrame
    packed: DataFrame
    reach: Reach
    kind: str
    vector: str
    parts: int


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by cluster, up to ``PACKED`` of one cluster in a row."""
    for batch in batches:
        c = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist() + [len(c)] if len(c) else []
        for a, b in zip(cuts, cuts[1:]):
            for i in range(a, b, PACKED):
                part = batch.slice(i, min(PACKED, b - i))
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *(pa.ListArray.from_arrays(ends, x) for x in part.columns[1:])], batch.schema.names)


def _pack(rows: DataFrame, parts: int) -> DataFrame:
    """(c, lists of the other columns) of up to ``PACKED`` rows; a large cluster is dealt over several tasks."""
    schema = "c int, " + ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema if f.name != "c")
    dealt = rows.repartition(parts, "c", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("c")
    return dealt.select("c", *(f.name for f in rows.schema if f.name != "c")).mapInArrow(_packed, schema)


def clustered(vectors: DataFrame, key: str, vec: str) -> Clusters:
    spark = vectors.sparkSession
    own = materialised(vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(key).alias("id"), F.col(vec).alias("v")), "vectors")
    (kind, vector), n = (dict(own.dtypes)[c] for c in ("id", "v")), own.count()
    wanted = min(MOST_CENTRES, max(1, -(-n // PER_CENTRE)))
    chosen = own.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toPandas()["v"]
    dims = len(chosen.iloc[0]) if len(chosen) else 1
    centres = unit(np.stack(chosen.to_numpy())) if len(chosen) else np.zeros((1, dims))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unit(rows_of(batch.column(1))) if batch.num_rows else np.zeros((0, shared.value.shape[1]))
            near = v @ shared.value.T
            c = np.where(v.any(axis=1), near.argmax(axis=1), len(shared.value))
            far = angle(near.max(axis=1)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c.astype(np.int32)), pa.array(far)], ["id", "v", "c", "far"])

    rows = materialised(own.mapInArrow(assign, f"id {kind}, v {vector}, c int, far double"), "clustered")
    radii = np.zeros(len(centres) + 1)
    for c, far in rows.groupBy("c").agg(F.max("far")).collect():  # a row a centre
        radii[c] = far
    parts = max(spark.sparkContext.defaultParallelism, -(-n // (8 * PACKED)))
    return Clusters(rows.drop("far"), materialised(_pack(rows.select("c", "id", "v"), parts), "cluster-blocks"), Reach(centres, radii), kind, vector, parts)


def probes(clusters: Clusters, asking: DataFrame, once: bool) -> DataFrame:
    """(id, v, c, own) of ``asking`` (id, v, c, within) with every cluster ``c`` they have to be compared with;
    ``once``: of two clusters only the lower one's vectors are sent."""
    shared = asking.sparkSession.sparkContext.broadcast(clusters.reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = shared.value
        step = max(1, 200_000 // len(reach.radii))  # rows that leave at once
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                own = batch.column(2).to_numpy()
                to = reach.of(unit(rows_of(batch.column(1))), batch.column(3).to_numpy())
                numbers = np.arange(to.shape[1])[None, :]
                to &= numbers > own[:, None] if once else numbers != own[:, None]
                to[np.arange(len(own)), own] |= once
                i, c = np.nonzero(to)
                taken = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*taken.columns[:2], pa.array(c.astype(np.int32)), pa.array(own[i])], ["id", "v", "c", "own"])

    return asking.select("id", "v", "c", "within").mapInArrow(run, f"id {clusters.kind}, v {clusters.vector}, c int, own int")


def _compared(clusters: Clusters, sent: DataFrame) -> DataFrame:
    """Packed rows of probes beside each packed row of the cluster they go to."""
    asked = _pack(sent.select("c", "id", "v", "own"), clusters.parts).select("c", F.col("id").alias("ids"), F.col("v").alias("vs"), "own")
    return asked.join(clusters.packed.select("c", F.col("id").alias("its"), F.col("v").alias("ws")), "c").select("ids", "vs", "own", "its", "ws", "c")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        cell = lambda k: batch.column(k)[i].values  # noqa: E731, B023
        yield cell(0), rows_of(cell(1)), cell(2).to_numpy(), cell(3), rows_of(cell(4)), batch.column(5)[i].as_py()


def similar_pairs(vectors: DataFrame, key: str, vec: str, threshold: float) -> DataFrame:
    """(a, b, cosine) of all pairs a < b at the threshold or above (inclusive), exact."""
    clusters = clustered(vectors, key, vec)
    limit = float(angle(np.array(threshold - ROUNDING)))
    sent = probes(clusters, clusters.rows.withColumn("within", F.lit(limit)), once=True)
    if threshold > 0:  # a zero vector's cosines are 0
        sent = sent.where(F.col("c") < len(clusters.reach.centres))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, own, its, y, c in _blocks(batch):
                cosines = unit(x) @ unit(y).T
                i, j = np.nonzero(cosines >= threshold - 1e-12)
                a, b = ids.to_numpy(zero_copy_only=False)[i], its.to_numpy(zero_copy_only=False)[j]
                keep = (own[i] != c) | (a < b)
                a, b, near = a[keep], b[keep], np.round(cosines[i, j], 6)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), ids.type), pa.array(np.maximum(a, b), ids.type), pa.array(near)], ["a", "b", "cosine"])

    return _compared(clusters, sent).mapInArrow(compare, f"a {clusters.kind}, b {clusters.kind}, cosine double")


def _best(ids: np.ndarray, x: np.ndarray, its: np.ndarray, y: np.ndarray, k: int, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the ``k`` best others of each row of unit vectors ``x`` among ``y``, which stands in order of its keys."""
    score = np.round(x @ y.T, 6)
    _, code = np.unique(np.append(ids, its), return_inverse=True)
    score[code[: len(ids), None] == code[None, len(ids) :]] = -np.inf
    if barred is not None:
        score[barred] = -np.inf
    m = min(k, score.shape[1])
    least = -np.partition(-score, m - 1, axis=1)[:, m - 1]
    i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    by = np.lexsort((j, -score[i, j], i))
    i, j = i[by], j[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[place < k], j[place < k]
    return i, j, score[i, j]


def _nearest(compared: DataFrame, kind: str, k: int) -> DataFrame:
    """(path, neighbour, score): the ``k`` best of each pair of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, _, its, y, _ in _blocks(batch):
                ids, its_ = ids.to_numpy(zero_copy_only=False), its.to_numpy(zero_copy_only=False)
                order = np.argsort(its_, kind="stable")  # equal scores then stand in order of the key
                its_ = its_[order]
                i, j, score = _best(ids, unit(x), its_, unit(y[order]), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], its.type), pa.array(its_[j], its.type), pa.array(score)], ["path", "neighbour", "score"])

    return compared.mapInArrow(run, f"path {kind}, neighbour {kind}, score double")


def opened(clusters: Clusters, asking: DataFrame) -> DataFrame:
    """``asking`` (id, v, c, within) with ``many``: whether more than ``SENT`` clusters besides its own are left open to a vector."""
    shared = asking.sparkSession.sparkContext.broadcast(clusters.reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = shared.value
        step = max(1, 2_000_000 // len(reach.radii))
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                to = reach.of(unit(rows_of(batch.column(1))), batch.column(3).to_numpy())
                to[np.arange(len(to)), batch.column(2).to_numpy()] = False
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to.sum(axis=1) > SENT)], ["id", "v", "c", "within", "many"])

    return asking.select("id", "v", "c", "within").mapInArrow(run, f"id {clusters.kind}, v {clusters.vector}, c int, within double, many boolean")


class _Band:
    """Vectors whose best others are looked for, and those found so far outside of their own clusters.

    Cosines are first compared as floats against the k-th best known, with room for their error; what comes
    near is computed again.
    """

    def __init__(self, asked: pa.Table, k: int):
        self.k, self.ids, self.own = k, asked.column(0).combine_chunks(), asked.column(2).to_numpy()
        self.keys = self.ids.to_numpy(zero_copy_only=False)
        self.x = unit(rows_of(asked.column(1).combine_chunks()))
        self.narrow, self.room = self.x.astype(np.float32), 1e-6 + 1.2e-7 * self.x.shape[1]
        within = asked.column(3).to_numpy()
        self.least = np.where(within > np.pi, -2.0, np.cos(np.minimum(within, np.pi)))
        self.found, self.waiting = pa.table({"i": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "neighbour": pa.array([], self.ids.type)}), 0

    def see(self, batch: pa.RecordBatch) -> None:
        batch = batch.take(pc.sort_indices(batch.column(0)))  # equal scores then stand in order of the key
        its, y, c = batch.column(0), unit(rows_of(batch.column(1))), batch.column(2).to_numpy()
        keys, narrow = its.to_numpy(zero_copy_only=False), y.astype(np.float32).T
        for a in range(0, len(self.x), SLICE):
            part = slice(a, a + SLICE)
            near = self.narrow[part] @ narrow >= (self.least[part] - self.room).astype(np.float32)[:, None]
            if np.count_nonzero(near) > 4 * self.k * len(near):
                i, j, score = _best(self.keys[part], self.x[part], keys, y, self.k, self.own[part][:, None] == c[None, :])
                i = i + a
            else:
                i, j = np.nonzero(near)
                i = i + a
                keep = (self.own[i] != c[j]) & (self.keys[i] != keys[j])
                i, j = i[keep], j[keep]
                score = np.round(np.einsum("nd,nd->n", self.x[i], y[j]), 6)
            keep = score >= self.least[i]
            self.add(i[keep], score[keep], its.take(pa.array(j[keep])))

    def add(self, i: np.ndarray, score: np.ndarray, neighbour: pa.Array) -> None:
        self.found = pa.concat_tables([self.found, pa.table({"i": pa.array(i, pa.int64()), "score": pa.array(score), "neighbour": neighbour})])
        self.waiting += len(i)
        if self.waiting > WAITING:
            self.rank()

    def rank(self) -> None:
        """Of each vector only the ``k`` best stay."""
        self.found = self.found.combine_chunks().sort_by([("i", "ascending"), ("score", "descending"), ("neighbour", "ascending")])
        i = self.found.column("i").to_numpy()
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.k - 1
        self.least[i[last]] = np.maximum(self.least[i[last]], self.found.column("score").to_numpy()[last])
        self.found, self.waiting = self.found.filter(pa.array(place < self.k)), 0


def _passed(clusters: Clusters, asking: DataFrame, k: int) -> DataFrame:
    """(path, neighbour, score): the ``k`` best outside of its own cluster of every vector of ``asking`` (id, v, c, within)."""
    cores, n = asking.sparkSession.sparkContext.defaultParallelism, asking.count()
    if not n:
        return asking.select(F.col("id").alias("path"), F.col("id").alias("neighbour"), F.lit(0.0).alias("score"))
    bands = cores * -(-n // (cores * BAND))
    asked = asking.select(F.pmod(F.xxhash64("id"), F.lit(bands)).cast("int").alias("band"), "id", "v", "c", "within")
    passing = clusters.rows.select(F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "id", "v", "c", F.lit(None).cast("double").alias("within"))
    rows = asked.unionByName(passing).repartitionById(bands, F.col("band")).sortWithinPartitions(F.col("within").isNull()).drop("band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, band = [], None
        for batch in batches:
            first = batch.num_rows - batch.column(3).null_count
            asked += [batch.slice(0, first)] if first else []
            if first == batch.num_rows or not asked:
                continue
            band = band or _Band(pa.Table.from_batches(asked), k)
            band.see(batch.slice(first))
        if band:
            band.rank()
            path = band.ids.take(band.found.column("i").combine_chunks())
            yield from pa.table({"path": path, "neighbour": band.found.column("neighbour"), "score": band.found.column("score")}).to_batches()

    return rows.mapInArrow(run, f"path {clusters.kind}, neighbour {clusters.kind}, score double")


def neighbours(vectors: DataFrame, key: str, vec: str, k: int = 12) -> DataFrame:
    """(path, neighbour, score, rank): the k most similar others of every row, no threshold, exact.

    A vector's own cluster gives its k-th best so far; it then goes to those clusters only that may
    hold a better one, or, where they are many, to a band.
    """
    clusters = clustered(vectors, key, vec)
    near = materialised(_nearest(_compared(clusters, clusters.rows.select("id", "v", "c", F.col("c").alias("own"))), clusters.kind, k), "own-cluster")
    best = [F.desc("score"), F.asc("neighbour")]
    kth = top_per(near, ["path"], best, k).where(F.col("rank") == k).select(F.col("path").alias("id"), F.acos(F.greatest(F.col("score") - ROUNDING, F.lit(-1.0))).alias("within"))
    asking = materialised(opened(clusters, clusters.rows.join(kth, "id", "left").na.fill(4.0, ["within"])), "asking")
    more = _nearest(_compared(clusters, probes(clusters, asking.where("not many"), once=False)), clusters.kind, k)
    found = near.unionByName(more).unionByName(_passed(clusters, asking.where("many"), k))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(*best))).where(F.col("rank") <= k)
