"""Fusing ranked lanes and diversifying the result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.operators.common import top_per

#: The rank constant and the bit of every lane.
RRF_K = 60
LANES = {"semantic": 1, "path": 2, "graph": 4, "passport": 8, "spotlight": 16, "bm25": 32, "lexicalIos": 64, "simhash": 128}


def lane(rows: DataFrame, name: str, width: int, bit: str | None = None) -> DataFrame:
    """(query_id, path, rank, lane, mask) of one ranked list, cut to ``width``."""
    return rows.where(F.col("rank") <= width).select("query_id", "path", F.col("rank").cast("int").alias("rank"), F.lit(name).alias("lane"), F.lit(LANES[bit or name]).alias("mask"))


def lane_names(mask: Column) -> Column:
    """Names of a mask's lanes in bit order."""
    table = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(name).alias("name")) for name, bit in LANES.items()))
    return F.transform(F.filter(table, lambda x: mask.bitwiseAND(x["bit"]) != 0), lambda x: x["name"])


def fuse(lanes: list[DataFrame]) -> DataFrame:
    """Reciprocal-rank sum per (query, path) over all rows of all lanes, with the lanes' bits."""
    both = reduce(DataFrame.unionByName, lanes)
    summed = both.groupBy("query_id", "path").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.bit_or("mask").alias("source_mask"))
    return summed.withColumn("sources", lane_names(F.col("source_mask")))


def cut(fused: DataFrame, top: int) -> DataFrame:
    return top_per(fused, ["query_id"], [F.desc("score"), F.asc("path")], top)


def mask_jaccard(a: Column, b: Column) -> Column:
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union > 0, F.bit_count(a.bitwiseAND(b)) / union).otherwise(0.0)


def diversify(fused: DataFrame, top: int, weight: float = 0.5) -> DataFrame:
    """Greedy maximal marginal relevance per query: (query_id, path, score, source_mask, rank).

    A query's list is bounded by its lanes' widths, so it is one small group; the greedy choice
    is sequential by nature. First in (score, path) order wins ties.
    """
    weight = min(max(weight, 0.0), 1.0)

    def picked(score: list[float], mask: list[int]) -> list[int]:
        best = max(score[0], 0) or 1.0
        gain = [weight * x / best for x in score]
        closest, left, chosen = [0.0] * len(score), list(range(len(score))), []
        while left and len(chosen) < top:
            at = max(left, key=lambda i: (gain[i] - (1 - weight) * closest[i], -i))
            left.remove(at)
            chosen.append(at)
            for i in left:
                union = (mask[i] | mask[at]).bit_count()
                closest[i] = max(closest[i], (mask[i] & mask[at]).bit_count() / union if union else 0.0)
        return chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, size = lists.flatten(), lists.value_lengths().to_pylist()
            score, mask = (flat.field(k).to_pylist() for k in (0, 2))
            rows, owner, rank, first = [], [], [], 0
            for i, n in enumerate(size):
                chosen = picked([-x for x in score[first : first + n]], mask[first : first + n])
                rows += [first + k for k in chosen]
                owner += [i] * len(chosen)
                rank += range(1, len(chosen) + 1)
                first += n
            kept = flat.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), kept.field(1), pc.negate(kept.field(0)), kept.field(2), pa.array(rank, pa.int32())],
                ["query_id", "path", "score", "source_mask", "rank"],
            )

    kind = dict(fused.dtypes)["query_id"]
    ordered = fused.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "path", F.col("source_mask").cast("int").alias("mask")))).alias("rows"))
    return ordered.mapInArrow(run, f"query_id {kind}, path string, score double, source_mask int, rank int")


def hybrid(lanes: dict[str, Callable[[], DataFrame]], top: int = 30, weight: float | None = None) -> DataFrame:
    """Run the lanes that can run (a missing table makes a lane empty), fuse, diversify or cut."""
    ready = [lane(make(), name.split(":")[-1], 2 * top, name.split(":")[0]) for name, make in lanes.items() if make is not None]
    fused = fuse(ready)
    return cut(fused, top) if weight is None else diversify(fused, top, weight)
