"""Look-up of words by prefix in a sorted dictionary that is kept in ranges."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators.common import materialised, small

#: Words of a range; it grows so that no more than so many ranges have their ends sent to every task.
RANGE_WORDS, MOST_RANGES = 1024, 500_000
_LAST = "\U0010ffff"


def _key(domain: Column, word: Column) -> Column:
    """Words of one domain stand together; no folded word holds the separator."""
    return F.concat(domain, F.lit("\x00"), word)


def word_rows(items: DataFrame) -> DataFrame:
    """(path, key): the distinct folded words of title, summary and keywords, below the item's domain."""
    text = F.concat_ws(" ", "title", "summary", F.array_join("keywords", " "))
    words = F.array_distinct(F.split(T.fold(text), r"[^\p{L}\p{N}]+"))
    return items.where("domain is not null").select("path", "domain", F.explode(words).alias("word")).where("word <> ''").select("path", _key(F.col("domain"), F.col("word")).alias("key"))


def ranges(rows: DataFrame) -> DataFrame:
    """(number, first, last, keys): the distinct keys in order, some thousand a range."""
    distinct = materialised(rows.select("key").distinct(), "words")
    n = distinct.count()
    each = max(RANGE_WORDS, -(-n // MOST_RANGES))
    parts = max(1, -(-n // (64 * each)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def packed(keys: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array(keys[:1]), pa.array(keys[-1:]), pa.array([keys], pa.list_(pa.string()))], ["number", "first", "last", "keys"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= each:
                yield packed(held[:each])
                number, held = number + 1, held[each:]
        if held:
            yield packed(held)

    ordered = distinct.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return materialised(ordered.mapInArrow(run, "number long, first string, last string, keys array<string>"), "word-ranges")


def prefix_keys(dictionary: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, key) of all dictionary keys that begin with a query's ``prefix``: binary search of both
    ends among the ranges' ends, then within the ranges between."""
    ends = sorted(dictionary.select("first", "last", "number").collect())  # MOST_RANGES rows at most
    shared = asked.sparkSession.sparkContext.broadcast(([e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]))
    kind = dict(asked.dtypes)["query_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, number = shared.value
        for batch in batches:
            out = []
            for i, prefix in enumerate(batch.column(1).to_pylist()):
                for at in range(bisect_left(last, prefix), bisect_left(first, prefix + _LAST)):
                    out.append((i, number[at]))
            some = batch.take(pa.array([i for i, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([n for _, n in out], pa.int64())], ["query_id", "prefix", "number"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, prefix, keys in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = keys[bisect_left(keys, prefix) : bisect_left(keys, prefix + _LAST)]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([query.as_py()] * len(own), query.type), pa.array(own)], ["query_id", "key"])

    placed = asked.select("query_id", "prefix").mapInArrow(find, f"query_id {kind}, prefix string, number long")
    return placed.join(dictionary.select("number", "keys"), "number").select("query_id", "prefix", "keys").mapInArrow(within, f"query_id {kind}, key string")


def keyword_prefix(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path): items of a query's domain with a folded word that begins with the folded query."""
    # Keys begin with the domain, so words of domains that no query names can't be found.
    named = small(queries.where("query is not null").select("domain").distinct())
    rows = materialised(word_rows(items.join(named, "domain", "left_semi")), "item-words")
    asked = queries.where("domain is not null and query is not null").select("query_id", _key(F.col("domain"), T.fold(F.col("query"))).alias("prefix"))
    return rows.join(prefix_keys(ranges(rows), asked), "key").select("query_id", "path").distinct()
