"""Sharding by extendible hashing: a directory over hash-prefix bits, split only where needed.

A key's address is the first 60 bits of its MD5. All rows begin in one bucket (prefix of no
bits); a bucket whose bytes exceed the limit is split on its next bit, and only that one, until
every bucket fits. Since a bucket's bytes are the sum of its halves', sizes at a fine prefix
depth suffice to grow the whole directory, its branches by tasks of their own; where a bucket at
that depth is still too large, only its rows are counted again, deeper. What shares all 60 bits (rows of one key) can't be split by
address: such a bucket is cut into runs of rows in the order of (key, bytes, text hash), each
within the limit, numbered by ``part``. A row longer than the limit has a shard of its own.

The rows are moved whole: each goes with its placing, never by a join on the key, into the
Parquet folder of its shard (depth, prefix, part), all its columns in the struct ``row``. What a
query returns is read back from those files.

The directory has a leaf a shard, so it grows as the corpus divided by the limit; it stays a table.
A row's salt within one address comes from its place in the input, which must be read the same way
again if a task is repeated (as files are).

Nulls and edge cases: a null text has no bytes; a null key has the address of the empty string;
repeated rows share their address; an empty table has no shards; further columns stay in the row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.shared import discard, new_folder, written

BITS, GROUP_BITS = 60, 14
#: Rows of small tables (16 to 32 bytes each) that may go to all tasks.
SENT = 1 << 20
LEAF = "prefix long, depth int, n_bytes long"


def addresses(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, address, text_hash, row) of every row."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return documents.select(
        F.col(f"`{key}`"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("address"), F.xxhash64(text).alias("text_hash"),
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"),
    )


def _split(sizes: dict[int, int], depth: int, finer: int, limit: int) -> list[tuple[int, int, int]]:
    """(prefix, depth, bytes) of the buckets that the cells ``sizes`` at depth ``finer`` form below those
    at ``depth``: one is split on its next bit while it exceeds the limit and cells tell its halves apart."""
    at: dict[int, dict[int, int]] = {finer: sizes}
    for d in range(finer, depth, -1):
        at[d - 1] = defaultdict(int)
        for prefix, n in at[d].items():
            at[d - 1][prefix >> 1] += n
    out, stack = [], [(prefix, depth) for prefix in at[depth]]
    while stack:
        prefix, d = stack.pop()
        if prefix not in at[d]:
            continue  # nothing there: no shard
        if at[d][prefix] <= limit or d == finer:
            out.append((prefix, d, at[d][prefix]))
        else:
            stack += [(2 * prefix, d + 1), (2 * prefix + 1, d + 1)]
    return out


def _split_groups(cells: DataFrame, depth: int, finer: int, limit: int) -> DataFrame:
    """``_split`` for every prefix at ``depth`` by a task of its own; cells: (cell, n_bytes) at ``finer``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = _split(dict(zip(group["cell"].tolist(), group["n_bytes"].tolist())), depth, finer, limit)
        return pd.DataFrame(found, columns=["prefix", "depth", "n_bytes"])

    return cells.groupBy(F.shiftright("cell", finer - depth).alias("top")).applyInPandas(run, LEAF)


def grow_directory(rows: DataFrame, limit: int) -> DataFrame:
    """Written leaves (prefix, depth, n_bytes); each fits the limit or has all 60 bits.

    Bytes are added up in cells so fine that an even spread leaves 1/16 of the limit in one. The
    driver sees their sums at a depth ``GROUP_BITS`` higher only (a number for a thousand shards), and
    grows the directory's top from them; below, each prefix of that depth grows in a task of
    its own, from 2 ** GROUP_BITS cells at most. Cells still too large are counted again, deeper.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return written(spark.createDataFrame([], LEAF), "leaves", 0)
    depth = min(BITS, max(1, int(np.ceil(np.log2(max(1, total / limit)))) + 4))
    top = max(0, depth - GROUP_BITS)
    cells = written(rows.groupBy(F.shiftright("address", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "cells", 1 << min(depth, 40))
    sums = {r[0]: r[1] for r in cells.groupBy(F.shiftright("cell", depth - top)).agg(F.sum("n_bytes")).collect()}
    known = _split(sums, 0, top, limit)
    open_ = [(p,) for p, d, n in known if d == top and n > limit]
    done = spark.createDataFrame([x for x in known if x[1] < top or x[2] <= limit], LEAF)
    below = cells.join(few(spark.createDataFrame(open_, "p long"), len(open_)), F.shiftright("cell", depth - top) == F.col("p"), "left_semi")
    leaves = written(done.unionByName(_split_groups(below, top, depth, limit)), "leaves", total // limit)
    discard(cells)
    while depth < BITS:
        too_large = (F.col("depth") == depth) & (F.col("n_bytes") > limit)
        large = leaves.where(too_large).select(F.col("prefix").alias("p"))
        n = large.count()
        if not n:
            break
        finer = min(BITS, depth + 6)
        again = rows.join(few(large, n), F.shiftright("address", BITS - depth) == F.col("p"), "left_semi")
        cells = again.groupBy(F.shiftright("address", BITS - finer).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        last, leaves = leaves, written(leaves.where(~too_large).unionByName(_split_groups(cells, depth, finer, limit)), "leaves", total // limit)
        discard(last)
        depth = finer
    return leaves


def few(table: DataFrame, n: int) -> DataFrame:
    """With a broadcast hint while its ``n`` rows are few."""
    return F.broadcast(table) if n <= SENT else table


def assign(rows: DataFrame, leaves: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Every row with its leaf: (row, depth, prefix, part).

    Up to ``SENT`` leaves are sent to all tasks as arrays; beyond that rows and leaves meet by a
    leading part of the address, and by the leaf's range within it."""
    n = leaves.count()
    start = F.expr(f"shiftleft(prefix, {BITS} - depth)")
    if n <= SENT:
        sent = leaves.select(start.alias("start"), "prefix", "depth", "n_bytes").orderBy("start").toArrow()
        table = rows.sparkSession.sparkContext.broadcast([sent.column(i).to_numpy() for i in range(4)])
        schema = T.StructType([*rows.schema, *(T.StructField(c, t) for c, t in (("depth", T.IntegerType()), ("prefix", T.LongType()), ("shard_bytes", T.LongType())))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, prefixes, depths, sizes = table.value
            for batch in batches:
                at = np.searchsorted(starts, batch.column(2).to_numpy(), "right") - 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(depths[at], pa.int32()), pa.array(prefixes[at]), pa.array(sizes[at])], [*batch.schema.names, "depth", "prefix", "shard_bytes"])

        placed = rows.mapInArrow(run, schema)
    else:
        lead = max(0, int(np.ceil(np.log2(n))) - 6)
        spans = leaves.select("depth", "prefix", F.col("n_bytes").alias("shard_bytes"), start.alias("start"), F.expr(f"shiftleft(prefix + 1, {BITS} - depth)").alias("end"))
        spans = spans.withColumn("lead", F.explode(F.sequence(F.shiftright("start", BITS - lead), F.shiftright(F.col("end") - 1, BITS - lead))))
        within = (F.shiftright("address", BITS - lead) == F.col("lead")) & (F.col("address") >= F.col("start")) & (F.col("address") < F.col("end"))
        placed = rows.join(spans, within).select(*rows.columns, "depth", "prefix", "shard_bytes")
    if leaves.where((F.col("depth") == BITS) & (F.col("n_bytes") > limit)).isEmpty():
        return placed.select("row", "depth", "prefix", F.lit(0).cast("long").alias("part"))
    # Only rows of one address beyond the limit are numbered, in windows of that address and a salt.
    heavy = placed.where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit))
    salted = heavy.withColumn("salt", F.pmod(F.xxhash64("text_hash", F.monotonically_increasing_id()), F.ceil(F.col("shard_bytes") / F.lit(64 * limit))))
    run_window = Window.partitionBy("prefix", "salt").orderBy(key, "n_bytes", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    # Runs of at most half the limit's start positions: a row belongs to the run its first byte falls in.
    cut = salted.withColumn("end", F.sum("n_bytes").over(run_window)).withColumn("run", F.expr(f"(end - n_bytes) div {limit}"))
    per = Window.partitionBy("prefix", "salt", "run").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("over", (F.sum("n_bytes").over(per) > limit).cast("long"))
    cut = cut.withColumn("part", F.col("salt") + F.expr(f"(2 * run + over) * (ceil(shard_bytes / (64D * {limit})))").cast("long"))
    light = placed.where((F.col("depth") != BITS) | (F.col("shard_bytes") <= limit)).select("row", "depth", "prefix", F.lit(0).cast("long").alias("part"))
    return light.unionByName(cut.select("row", "depth", "prefix", "part"))


def write_shards(documents: DataFrame, limit: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Grow the directory over all rows, write them whole, a Parquet folder a shard; (row, depth, prefix, part) as read back."""
    rows = addresses(documents, key, text)
    leaves = grow_directory(written(rows.drop("row"), "addresses"), limit)
    placed = assign(rows, leaves, limit, key)
    placed.repartition("depth", "prefix", "part").write.partitionBy("depth", "prefix", "part").parquet(folder)
    return documents.sparkSession.read.schema(placed.schema).parquet(folder)


def shard_documents(documents: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards; (key, n_bytes, depth, prefix, part, shard_bytes) of every row found in them."""
    back = write_shards(documents, limit, new_folder(documents.sparkSession, "shards"), key, text)
    rows = back.select(F.col("row").getField(key).alias(key), F.coalesce(F.octet_length(F.col("row").getField(text)), F.lit(0)).cast("long").alias("n_bytes"), "depth", "prefix", "part")
    shard = ["depth", "prefix", "part"]
    sizes = rows.groupBy(*shard).agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(sizes, shard).select(key, "n_bytes", *shard, "shard_bytes")
