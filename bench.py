"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from noteloom.plans import catalog

HEADLINE = (
    "tokenize_stats", "term_df", "bm25_topk", "lexical_search", "cosine_neighbors", "cosine_search_boost", "hamming_filter", "rrf_fuse", "mmr_diversify", "passport_local_find",
    "proper_nouns", "one_line_summary", "link_edges", "cocitation_edges", "multiplex_union", "neighbors_by_dst", "modularity", "incremental_changed", "debounce_sessions", "fewshot_topk",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("noteloom-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="noteloom-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
