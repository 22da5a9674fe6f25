from pyspark.sql import functions as F

from noteloom.functions import misc
from noteloom.operators import enrich


def test_cache_and_parsing(spark):
    notes = spark.createDataFrame([("a", "s1", "x"), ("b", "s2", "y" * 20), ("c", "s3", "z")], "path string, sha string, content string")
    cache = spark.createDataFrame([("a", "s1", "old"), ("c", "other", "stale"), ("b", "s9", None)], "path string, sha string, answer string")
    got = {r["path"]: (r["answer"], r["fresh"]) for r in enrich.cached(notes, cache, lambda c: F.concat(F.lit("short "), c), lambda c: F.lit("long"), 10).collect()}
    assert got == {"a": ("old", False), "b": ("long", True), "c": ("short z", True)}
    answers = spark.createDataFrame([("a", 'so: {"edges": [{"source": "x", "target": "y", "label": "l"}]} ok'), ("b", '{"relations": [{"source": "p", "target": "q", "type": "t"}]}'), ("c", "nothing")], "path string, answer string")
    assert {tuple(r) for r in enrich.entity_edges(answers).collect()} == {("a", "x", "y", "l"), ("b", "p", "q", "t")}


def test_versions_and_stats(spark):
    row = spark.createDataFrame([("v1.9", "1.10.0", 2.9)], "a string, b string, s double").select(misc.next_version(F.col("a")), misc.version_at_least(F.col("b"), "1.9"), misc.version_at_least(F.col("a"), "1.10"), misc.long_enough(F.col("s"))).first()
    assert list(row) == ["v1.10", True, False, False]
    swept = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "note_path string, granted boolean")
    assert list(enrich.sweep_stats(swept, spark.createDataFrame([("a",)], "path string")).first()) == [2, 1, 1, 1]
    parts = spark.createDataFrame([("a", 0.5), ("a", 0.1), ("b", -0.2)], "path string, score double")
    assert {r["path"]: r["label"] for r in enrich.mean_sentiment(parts).collect()} == {"a": "positive", "b": "neutral"}
