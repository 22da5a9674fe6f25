"""Connected components of an edge table, and joins on keys that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.shared import discard, written


def connected(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Large-star and small-star steps alternate (every node hands its neighbours its smallest
    one) until no edge changes; each round is written to the shared folder and then replaces the
    one before, whose files are deleted. Rounds grow with the
    logarithm of the longest path. Minima are aggregated before any shuffle, so a node
    with very many edges costs no task more than another. ``rows``: about how many edges, if known.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())

    before, again = None, state(now)
    while again != before:
        before = again
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: each larger neighbour of u gets u's smallest neighbour (both u > v and v < u hold u's in `now`).
        large = now.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        kept = large.where("u <> v").distinct()
        small = kept.groupBy("u").agg(F.min("v").alias("m"))
        nxt = kept.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        last, now = now, written(nxt.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", before[0])
        again = state(now)
        discard(last)
    # At rest every edge points at its component's smallest node.
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    found.made_from = now
    return found


def join_hot(rows: DataFrame, unique: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join rows to a table with one row per key; keys held by more than a thousandth of the
    rows (so a thousand at most) go by broadcast, the others by shuffle."""
    total = rows.count()
    common = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(1000, total // 1000)).where(F.col(key).isNotNull()).select(key)
    hot = F.broadcast(common)
    some = rows.join(hot, key, "left_semi").join(F.broadcast(unique.join(hot, key, "left_semi")), key, how)
    return rows.join(hot, key, "left_anti").join(unique, key, how).unionByName(some)
