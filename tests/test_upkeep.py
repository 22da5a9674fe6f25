"""Leases and watcher with timers, prefix look-up, edges and communities after changes."""

import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import community, dictionary, edgeupkeep, fusion, graph, profile
from noteloom.streaming.leases import STATE_STORE, lease_stream
from noteloom.streaming.watcher import watched


@pytest.fixture
def drained(spark, tmp_path):
    """Runs a stream over tables that come one after another, and returns all its rows."""

    def run(turns, schema, make):
        for i, rows in enumerate(turns):
            df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        before = spark.conf.get(STATE_STORE[0])
        spark.conf.set(*STATE_STORE)
        try:
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(300)
        finally:
            spark.conf.set(STATE_STORE[0], before)
        return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())

    return run


def test_leases_end_without_a_request(drained):
    first = [("n", "a", "claim", 1000), ("n", "b", "claim", 30_000), ("n", "a", "claim", 50_000), ("m", "b", "release", 2000), ("m", "b", "claim", 40_000), ("m", "a", "release", 41_000)]
    second = [("x", "a", "claim", 500_000)]
    third = [("n", "b", "claim", 510_000), ("n", "b", "release", 511_000)]
    got = drained([first, second, third], "note_path string, device_id string, action string, ms long", lambda s: lease_stream(s, 60_000, "10 seconds"))
    assert got == sorted([
        ("n", "a", 1000, "granted", "a"), ("n", "b", 30_000, "refused", "a"), ("n", "a", 50_000, "renewed", "a"), ("n", "a", 110_000, "expired", None),
        ("m", "b", 2000, "no lease", None), ("m", "b", 40_000, "granted", "b"), ("m", "a", 41_000, "not owner", "b"), ("m", "b", 100_000, "expired", None),
        ("x", "a", 500_000, "granted", "a"), ("n", "b", 510_000, "granted", "b"), ("n", "b", 511_000, "released", None),
    ], key=lambda r: tuple(r))


def test_watcher_waits_for_quiet_and_bounds_what_it_tracks(drained):
    first = [("r", "a", 10, False), ("r", "a", 1000, False), ("r", "b", 1200, False), ("r", "c", 1300, False), ("r", "a", 3000, True)]
    second = [("r", "z", 60_000, False), ("q", "a", 60_000, True)]
    got = drained([first, second], "root string, path string, ms long, own boolean", lambda s: watched(s, 1500, 5000, 2, "10 seconds"))
    # a is evicted when c comes third, so its own event finds nothing; b and c fall quiet and are missed.
    assert got == sorted([("r", "a", 1300, "evicted"), ("r", "b", 2700, "stable"), ("r", "c", 2800, "stable"), ("r", "b", 7700, "missed"), ("r", "c", 7800, "missed")])


def test_watcher_sees_the_apps_event_in_time(drained):
    first = [("r", "a", 10, False), ("r", "a", 2000, True), ("r", "b", 5000, False), ("r", "b", 20_000, True)]
    got = drained([first, [("r", "y", 90_000, False)]], "root string, path string, ms long, own boolean", lambda s: watched(s, 1500, 5000, 500, "10 seconds"))
    assert got == sorted([("r", "a", 1510, "stable"), ("r", "a", 2000, "seen"), ("r", "b", 6500, "stable"), ("r", "b", 11_500, "missed")])


def test_prefix_look_up_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "RANGE_WORDS", 4)
    rng = random.Random(6)
    words = ["".join(rng.choice("abÉ") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    items = [(f"p{i}", rng.choice(["d1", "d2"]), words[i], " ".join(rng.choices(words, k=4)), ["k" + words[-i]]) for i in range(60)] + [("none", None, "a", "a", ["a"]), ("bare", "d1", None, None, None)]
    df = spark.createDataFrame(items, "path string, domain string, title string, summary string, keywords array<string>")
    asked = [(1, "d1", "a"), (2, "d2", "É"), (3, "d1", ""), (4, "d3", "a"), (5, "d1", "abab"), (6, None, "a"), (7, "d1", None), (8, "d2", "zz")]
    got = {tuple(r) for r in dictionary.keyword_prefix(df, spark.createDataFrame(asked, "query_id int, domain string, query string")).collect()}
    fold = lambda s: s.lower().replace("é", "e")
    want = {(q, i[0]) for q, d, p in asked for i in items if d and d == i[1] and p is not None and any(w.startswith(fold(p)) for w in fold(" ".join(filter(None, [i[2], i[3], *(i[4] or [])]))).split())}
    assert got == want


def test_concepts_that_hold_or_are_held_are_found_by_substrings(spark):
    cards = [(f"n{i}", "s", ["Ana", "Banana", "x"][: i % 4], ["c"]) for i in range(12)]
    df = spark.createDataFrame(cards, "path string, one_line_summary string, concepts array<string>, cornell_cue array<string>")
    q = spark.createDataFrame([(1, "bananas an"), (2, "zz"), (3, "")], "query_id int, query string")
    got = profile.find_local(df, q, 5).collect()
    overlap = {(r["query_id"], r["path"]): r["overlap"] for r in got}
    # "an" is in both names, "bananas" holds both; n1, n5 and n9 have one of them.
    assert {p: n for (k, p), n in overlap.items() if k == 1} == {"n10": 2, "n11": 2, "n2": 2, "n3": 2, "n6": 2}
    assert [r["path"] for r in got if r["query_id"] == 2] == sorted(r["path"] for r in got if r["query_id"] == 2) and sum(r["query_id"] == 2 for r in got) == 5
    assert not any(r["query_id"] == 3 for r in got)


def test_diversity_prefers_other_lanes(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 1), (1, "c", 0.5, 2), (2, "d", 0.0, 1)], "query_id int, path string, score double, source_mask int")
    got = [(r["query_id"], r["rank"], r["path"], r["score"]) for r in fusion.diversify(rows, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "a", 1.0), (1, 2, "c", 0.5), (2, 1, "d", 0.0)]


def edges(df):
    return sorted((r["src"], r["dst"], r["type"], r["weight"], tuple(r["why"])) for r in df.collect())


def test_edges_after_changes_equal_a_rebuild(spark):
    rng = random.Random(9)
    day = lambda: f"2024-03-{rng.randint(1, 9):02d} 10:00:00"
    files = [(f"f{rng.randrange(6)}/n{i}.md" if i % 9 else f"n{i}.md", day()) for i in range(70)]
    concepts = [(p, rng.sample("abcdefghijk", rng.randint(0, 5))) for p, _ in files]
    links = [(f"s{s}", f"t{t}", rng.randint(1, 3)) for s in range(40) for t in rng.sample(range(30), rng.randint(1, 6))]
    tables = {
        "files": spark.createDataFrame(files, "path string, m string").select("path", F.col("m").cast("timestamp").alias("mtime")),
        "passports": spark.createDataFrame(concepts, "path string, concepts array<string>"), "links": spark.createDataFrame(links, "src string, dst string, cnt int"),
    }
    moved = [(p, day(), "modify") for p, _ in rng.sample(files, 8)]
    moved += [(p, None, "delete") for p, _ in rng.sample(files, 6) if p not in {m[0] for m in moved}] + [("f1/new.md", day(), "create")]
    profiled = [(p, rng.sample("abcdefghijk", 4), "modify") for p, _ in rng.sample(concepts, 6)]
    profiled += [(p, None, "delete") for p, _ in rng.sample(concepts, 4) if p not in {m[0] for m in profiled}] + [("f1/new.md", ["a", "b"], "create")]
    sources = rng.sample(range(40), 5)
    linked = [(f"s{s}", f"t{t}", 1, "modify") for s in sources[:3] for t in rng.sample(range(35), 3)] + [(f"s{s}", None, None, "delete") for s in sources[3:]]
    changes = {
        "files": spark.createDataFrame(moved, "path string, m string, kind string").select("path", F.col("m").cast("timestamp").alias("mtime"), "kind"),
        "passports": spark.createDataFrame(profiled, "path string, concepts array<string>, kind string"), "links": spark.createDataFrame(linked, "src string, dst string, cnt int, kind string"),
    }

    def made(t):
        return {"folder": graph.folder_edges(t["files"]), "date": graph.date_edges(t["files"]), "concept": graph.concept_edges(t["passports"]), "link": graph.link_edges(t["links"]), "cocited": graph.cocitation_pairs(t["links"])}

    got = edges(edgeupkeep.edges_after(made(tables), tables, changes))
    after = {name: edgeupkeep.changed_rows(tables[name], changes[name], "src" if name == "links" else "path")[1] for name in tables}
    again = made(after)
    again["cocited"] = graph.cocited_edges(again["cocited"])
    assert got == edges(graph.merge(again.values()))


def test_cocited_pairs_follow_the_most_cited(spark):
    links = [("s1", "a"), ("s1", "b"), ("s1", "c"), ("s2", "a"), ("s2", "b"), ("s3", "a"), ("s3", "c")]
    before = spark.createDataFrame(links, "src string, dst string")
    now = before.where("src <> 's2'")
    got = edgeupkeep.cocitation_upkeep(graph.cocitation_pairs(before, 2), before, now, spark.createDataFrame([("s2",)], "src string"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.cocitation_pairs(now, 2).collect())) == [("a", "c", 2)]


def test_communities_after_a_small_change(spark):
    groups = [[f"g{k}n{i}" for i in range(6)] for k in range(4)]
    pairs = [(a, b, 1.0) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]] + [(groups[k][0], groups[k + 1][1], 1.0) for k in range(3)]
    stored = community.communities(spark.createDataFrame(pairs, "a string, b string, weight double")).select("path", "community_id").cache()
    old = {r["path"]: r["community_id"] for r in stored.collect()}
    assert len(set(old.values())) == 4
    # One note of the first group moves over to the second; the third falls in two; a new note joins the fourth.
    mover, (left, right) = groups[0][5], (groups[2][:3], groups[2][3:])
    now = [p for p in pairs if mover not in p and not ({p[0], p[1]} & set(left) and {p[0], p[1]} & set(right))]
    now += [(mover, x, 1.0) for x in groups[1]] + [("new", x, 1.0) for x in groups[3][:3]]
    ends = [(x,) for x in {mover, *groups[0], *groups[1], *groups[2], "new", *groups[3][:3]}]
    df = spark.createDataFrame(now, "a string, b string, weight double")
    rows, looked = community.refreshed(df, stored, spark.createDataFrame(ends, "path string"))
    got = {r["path"]: r["community_id"] for r in rows.collect()}
    assert got[mover] == old[groups[1][0]] and got["new"] == old[groups[3][0]]
    assert all(got[n] == old[n] for g in (groups[0][:5], groups[1], groups[3]) for n in g)
    assert {got[n] for n in left} != {got[n] for n in right} and old[groups[2][0]] in {got[n] for n in groups[2]}
    assert len({got[n] for n in left}) == len({got[n] for n in right}) == 1
    fresh = community.communities(df).first()["modularity"]
    assert rows.first()["modularity"] >= fresh - 0.005 and looked[0] == len(ends)


def test_edges_by_type_travel_once(spark, sf_dir):
    """Merging, summing and ranking by source need one exchange of the edges, besides that of the folders' first notes."""
    from noteloom.plans import archive

    plan = archive.neighbours_of_type(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(src#" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(src#" in x and "ENSURE_REQUIREMENTS" in x]


def test_edge_stats_deal_edges_before_grouping(spark, sf_dir):
    from noteloom.plans import knowledge

    plan = knowledge.edge_stats(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_kept_up_folder_edges_are_dealt_once_and_without_reasons(spark):
    """Dropping and merging share one exchange, by folder, of one way of each pair; also where broadcasts are too large."""
    files = spark.createDataFrame([(f"f{i % 5}/n{i}.md", 1) for i in range(40)] + [("f1/n1.md", 1)], "path string, mtime int")
    changes = spark.createDataFrame([("f0/n0.md", 2, "delete"), ("f2/n90.md", 2, "create")], "path string, mtime int, kind string")
    gone, now, keys = edgeupkeep.changed_rows(files, changes)
    stored = graph.folder_edges(files)
    got = edgeupkeep.merged_folder_upkeep(stored, gone, now, keys)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(src" not in plan and "hashpartitioning(a" not in plan
    assert sorted(map(str, got.collect())) == sorted(map(str, graph.merge([graph.folder_edges(now)]).select(*got.columns).collect()))


def test_profiles_that_lose_one_of_three_common_concepts_stay_paired(spark):
    before = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "y", "z"]), ("c", ["x", "q"])], "path string, concepts array<string>")
    changes = spark.createDataFrame([("b", ["y", "z"], "modify"), ("c", ["y", "z"], "modify")], "path string, concepts array<string>, kind string")
    gone, now, keys = edgeupkeep.changed_rows(before, changes)
    got = edgeupkeep.concept_upkeep(graph.concept_edges(before), gone, before, now, keys)
    assert sorted(map(str, got.collect())) == sorted(map(str, graph.concept_edges(now).select(*got.columns).collect()))
