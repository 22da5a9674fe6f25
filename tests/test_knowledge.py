"""Profiles, graph, communities, upkeep and streams on small fixtures."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from noteloom.functions import hashing
from noteloom.functions import text as T
from noteloom.operators import chunking, community, enrich, graph, profile, upkeep
from noteloom.sources import store, vault
from noteloom.streaming import events as S

NOTE = """---
tags: [direito, Penal]
aliases:
  - Apelido
kb_domain: leis, normas
title: "Nota"
---
# Teoria Geral

Prisão é medida. Segundo ponto de Beccaria aqui. Terceiro.
#tema veja [[Outra nota|apelido]] e [[Mais#parte]].

## Como funciona
""" + "texto longo " * 30 + """

## Conceito central
curto
"""


def extracted(spark, content, path="inbox/n.md"):
    rows = spark.createDataFrame([(path, content, dt.datetime(2024, 5, 6, 7, 8))], "path string, content string, mtime timestamp")
    return profile.extract(rows).first()


def test_profile(spark):
    p = extracted(spark, NOTE)
    assert p["concepts"][:9] == ["direito", "Penal", "Apelido", "tema", "parte", "Teoria Geral", "Como funciona", "Conceito central", "Outra nota"]
    assert p["domain"] == ["leis", "normas"] and p["zettel_id"] == "202405060708" and p["difficulty"] == 1
    assert p["one_line_summary"] == "Prisão é medida. Segundo ponto de Beccaria aqui."
    assert p["cornell_cue"] == ["Como funciona?", "O que é conceito central?"]
    assert p["atomic_splits"] == ["Como funciona"]


@pytest.mark.parametrize("content", ["", None, "---\n---\n", "---\ntags:\n---\n", "#", "x" * 20000])
def test_profile_of_odd_notes(spark, content):
    p = extracted(spark, content)
    assert p is not None and (content is None or p["char_count"] == len(content))


@pytest.mark.parametrize(("body", "path", "n", "want"), [
    ("short", "a/b.md", 0, "fleeting"), ("x" * 200, "inbox/b.md", 0, "fleeting"), ("x" * 200, "a/b.md", 0, None),
    ("> q\n> r\nx" + "y" * 300, "a/b.md", 0, "literature"), ("[[a]] [[b]] " + "x" * 700, "a/b.md", 3, "permanent"), ("[[a]] [[b]] " + "x" * 700, "a/b.md", 2, None),
])
def test_note_type(spark, body, path, n, want):
    row = spark.createDataFrame([(body, path, len(body), n)], "b string, p string, c int, n int")
    assert row.select(T.note_type(F.col("b"), F.col("p"), F.col("c"), F.col("n"))).first()[0] == want


def test_hashes(spark):
    def fnv(s):
        h = 0x811C9DC5
        for c in s[:120]:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    def djb(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + b) & (2**64 - 1)
        return f"{h:x}"

    words = ["", "a", "habeas corpus", "é" * 200, "x" * 500]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a(F.col("w")).alias("f"), hashing.djb2(F.col("w")).alias("d")).collect()
    assert [(r["w"], r["f"], r["d"]) for r in rows] == [(w, fnv(w), djb(w)) for w in words]


TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]


def test_modularity_and_the_two_readings_of_loops(spark):
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in TRIANGLES], "a string, b string, weight double")
    part = spark.createDataFrame([(n, 0 if n in "abc" else 1) for n in "abcdef"], "node string, community int")
    q = lambda *a: community.modularity(*a).first()["q"]
    assert q(pairs, part) == pytest.approx(0.357143, abs=1e-6)
    merged = community.super_graph(pairs, part)
    own = spark.createDataFrame([(0, 0), (1, 1)], "node int, community int")
    assert q(merged, own) == pytest.approx(0.357143, abs=1e-6)
    assert community.modularity(merged, own, self_loop="compat").first()["q"] == pytest.approx(-0.071429, abs=1e-6)


@pytest.mark.parametrize("find", [community.sequential, community.communities])
def test_communities_cover_all_nodes_and_are_connected(spark, find):
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in TRIANGLES], "a string, b string, weight double")
    got = find(pairs).collect()
    assert {r["path"] for r in got} == set("abcdef")
    groups = {}
    for r in got:
        groups.setdefault(r["community_id"], set()).add(r["path"])
    assert sorted(groups) == list(range(len(groups)))
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"]]
    assert got[0]["modularity"] == pytest.approx(0.357143, abs=1e-6)


def test_split_of_a_community_in_two_parts(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)], "a string, b string, weight double")
    part = spark.createDataFrame([(n, 7) for n in "abcde"], "node string, community int")
    assert {r["node"]: r["part"] for r in community.split_components(pairs, part).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}


def orders(spark, folder, rows):
    """A table of (order, customer, day of January)."""
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d int").selectExpr("o_orderkey", "o_custkey", "timestamp(date_add(date'2024-01-01', d)) o_orderdate", "'O' o_orderstatus").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    import duckdb

    from noteloom.plans import catalog

    con = duckdb.connect()
    for table in os.listdir(folder):
        con.sql(f"create view {table[:-8]} as select * from '{folder}/{table}/*.parquet'")
    got, want = catalog.QUERIES[name](spark, folder), con.sql(catalog.ORACLES[name])
    order = sorted(want.columns)
    return sorted(map(tuple, got.select(*order).collect())), sorted(want.project(", ".join(order)).fetchall())


def test_neighbours_of_type_sees_all_of_a_folder(spark, tmp_path):
    got, want = against_sql(spark, orders(spark, tmp_path, [(k, 1, k) for k in range(60)] + [(100, 2, 0)]), "neighbours_of_type")
    assert got == want and len(got) == 60 * 5


def test_split_communities_has_all_notes_of_a_folder(spark, tmp_path):
    got, want = against_sql(spark, orders(spark, tmp_path, [(k, 1, k) for k in range(60)] + [(100, 2, 0), (101, 3, 0), (102, 3, 0)]), "split_communities")
    assert got == want and len(got) == 62


def crowded(spark, folder):
    """A folder of 60 orders, a day of 45, some of both, an order alone."""
    return orders(spark, folder, [(k, 1, k % 50) for k in range(60)] + [(100 + k, 2 + k % 9, 200) for k in range(45)] + [(200, 50, 300), (201, 1, 200), (202, 2, 3)])


def test_modularity_counts_large_folders_and_days(spark, tmp_path):
    got, want = against_sql(spark, crowded(spark, tmp_path), "modularity")
    assert got == want


def test_super_graph_joins_large_folders_and_days(spark, tmp_path):
    got, want = against_sql(spark, crowded(spark, tmp_path), "super_graph")
    assert got == want and len(got) > 45


def crowd(spark, folder):
    """Folders, days, concepts, sources and vectors beyond every limit of the single builders."""
    crowded(spark, folder)
    spark.range(1100).selectExpr("id % 200 l_orderkey", "id l_partkey").unionByName(spark.range(60).selectExpr("1L l_orderkey", "id * 7 l_partkey")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(1100).selectExpr("id p_partkey").write.parquet(f"{folder}/part.parquet")
    texts = [(k, f"Common Shared word Own{k} and more" if k < 130 else f"Rare Pair{k // 2} here Again{k // 2}", "en", "s") for k in range(160)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    near = "transform(sequence(1, 8), k -> float(sin((id + 1) * 37 * k) + if(id >= 1990, 3, 0)))"
    spark.range(2060).selectExpr("id vec_id", f"{near} embedding", "0 label").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_edge_stats_count_all_partners(spark, tmp_path):
    got, want = against_sql(spark, crowd(spark, tmp_path), "edge_stats")
    assert got == want and dict((kind, n) for n, kind in got)["entity_overlap"] >= 130 * 129


def test_multiplex_union_has_all_partners(spark, tmp_path):
    got, want = against_sql(spark, crowd(spark, tmp_path), "multiplex_union")
    assert got == want


def test_buckets_of_many_chunks_have_all_pairs(spark):
    rows = spark.createDataFrame([(f"n{k:02d}", k % 2) for k in range(41)] + [("n00", 0), (None, 0)], "path string, day int")
    got = sorted(tuple(r) for r in graph.all_bucket_pairs(rows, "day", most=6).collect())
    assert got == sorted((d, f"n{a:02d}", f"n{b:02d}") for d in (0, 1) for a in range(d, 41, 2) for b in range(a + 2, 41, 2))


def test_edges(spark):
    files = spark.createDataFrame([(f"f/{i:02d}.md",) for i in range(60)] + [("root.md",), ("other.md",)], "path string")
    assert graph.folder_edges(files).count() == 50 * 49
    links = spark.createDataFrame([("gone", "x", 1), ("gone", "y", 1), ("s", "x", 2), ("s", "y", 1), ("s", "s", 1)], "src string, dst string, cnt long")
    kept = graph.existing(links, spark.createDataFrame([("x",), ("y",), ("s",)], "path string"))
    assert {(r["src"], r["dst"]) for r in kept.collect()} == {("s", "x"), ("s", "y")}
    assert graph.cocitation_edges(kept).where("src = 'x'").first()["why"] == ["cited together 1"]
    e = graph.merge([graph.link_edges(kept), graph.link_edges(kept).withColumn("weight", F.lit(0.1)).withColumn("why", F.array(F.lit("again")))])
    assert e.where("src = 's' and dst = 'x'").first()["weight"] == 1.0 and len(e.where("src = 's' and dst = 'x'").first()["why"]) == 2
    assert {r["type"]: r["n"] for r in graph.edge_stats(e).collect()}["spotlight_token_bm25"] == 0


def test_days_and_concepts(spark):
    day = dt.datetime(2024, 1, 1, 23, 59)
    files = spark.createDataFrame([(f"p{i}", day) for i in range(31)] + [("q1", dt.datetime(2024, 1, 2)), ("q2", dt.datetime(2024, 1, 2)), ("r", dt.datetime(2024, 1, 3))], "path string, mtime timestamp")
    assert {(r["src"], r["dst"]) for r in graph.date_edges(files).collect()} == {("q1", "q2"), ("q2", "q1")}
    p = spark.createDataFrame([("a", ["X", "y", "z"]), ("b", ["x", "Y"]), ("c", ["x"])], "path string, concepts array<string>")
    assert [(r["a"], r["b"], r["shared"]) for r in graph.concept_pairs(p).collect()] == [("a", "b", ["x", "y"])]


def test_chunks():
    assert chunking.chunk(None) == [] and chunking.chunk("fits") == ["fits"]
    text = "Um parágrafo.\n\n" + "Frase longa aqui. " * 20 + "\n\n" + "x" * 130
    got = chunking.chunk(text, 50, 10)
    assert all(len(c) <= 50 + 12 for c in got) and got[1].startswith(got[0][-10:] + "\n\n")
    assert chunking.chunk("a" * 100, 40, 0) == ["a" * 40, "a" * 40, "a" * 20]


def test_examples_leases_and_queue(spark):
    rows = [("t", f"in{i}", "out", 0.4 + (i % 7) / 10, i) for i in range(80)] + [("t", "in3", "better", 1.0, 99), ("t", "in4", "worse", 0.39, 99), ("u", "", "o", 1.0, 1)]
    ring = upkeep.example_ring(spark.createDataFrame(rows, "task string, input string, output string, quality double, ts long"))
    assert ring.count() == 50 and ring.where("input = 'in3'").first()["output"] == "better"
    assert [r["quality"] for r in upkeep.examples(ring).orderBy("rank").collect()] == sorted([r["quality"] for r in ring.collect()], reverse=True)[:3]
    leases = spark.createDataFrame([("n", "other", 0, 100), ("m", "other", 0, 101), ("k", "me", 0, 500)], "note_path string, device_id string, claimed_at long, expires_at long")
    got = {r["note_path"]: r["granted"] for r in upkeep.claim(leases, spark.createDataFrame([("n",), ("m",), ("k",), ("new",)], "note_path string"), "me", 100).collect()}
    assert got == {"n": True, "m": False, "k": True, "new": True}
    assert upkeep.lease_stats(leases, F.lit(100)).where("device_id = 'other'").first()["expired"] == 0
    tasks = spark.createDataFrame([("a", "embed", "s", 2, "d"), ("a", "embed", "s", 1, "e"), ("a", "odd", "s", 1, "d"), ("Clientes/x", "embed", "s", 1, "d"), (None, "embed", "s", 1, "d")], "path string, type string, sha string, enqueued_at long, enqueued_by string")
    good, bad = upkeep.enqueue(tasks)
    assert [(r["path"], r["enqueued_by"]) for r in good.collect()] == [("a", "e")] and bad.count() == 3


def stream(spark, folder, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_debounce_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "ts timestamp, path string"
    parts = [[(t(0), "a"), (t(3), "a"), (t(20), "a")], [(t(40), "b")], [(t(4000), "z")], [(t(9000), "z")]]
    got = drained(spark, S.debounced(stream(spark, tmp_path / "e", parts, schema), {"graph": 6}), "bursts")
    assert {(r["path"], r["n"]) for r in got if r["path"] != "z"} == {("a", 2), ("a", 1), ("b", 1)}


def test_counted_triggers_and_leases_keep_state(spark, tmp_path):
    parts = [[("v", i) for i in range(7)], [("v", i) for i in range(7, 25)]]
    got = drained(spark, S.threshold_triggers(stream(spark, tmp_path / "m", parts, "domain string, n int")), "triggers")
    assert sorted(r["trigger"] for r in got) == [1, 2]
    claims = [[("n", "d1", "claim", 0)], [("n", "d2", "claim", 59_999)], [("n", "d2", "claim", 60_000)], [("n", "d1", "release", 60_001)], [("n", "d2", "release", 60_002), ("n", "d1", "claim", 60_003)]]
    rows = sorted((r["at_ms"], r["granted"]) for r in drained(spark, S.lease_events(stream(spark, tmp_path / "l", claims, "note_path string, device_id string, action string, at_ms long")), "leases"))
    assert rows == [(0, True), (59_999, False), (60_000, True), (60_001, False), (60_002, True), (60_003, True)]


def test_maintenance_and_task_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    seen = []
    ev = stream(spark, tmp_path / "ev", [[(t(0), "modify", "a", None), (t(1), "rename", "b", "a")]], "ts timestamp, kind string, path string, old_path string")
    S.maintain(ev, lambda batch, n: seen.extend((r["path"], r["kind"]) for r in batch.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [("a", "delete"), ("b", "create")]
    tasks = stream(spark, tmp_path / "t", [[("embed", "a", "s", t(0))], [("embed", "a", "s", t(1)), ("embed", "a", "z", t(1))]], "type string, path string, sha string, enqueued_at timestamp")
    assert len(drained(spark, S.deduplicated_tasks(tasks), "tasks")) == 2


def test_sources(spark, tmp_path):
    root = tmp_path / "vault"
    for name, text in {"a/n.md": NOTE, ".hidden/x.md": "x", "skip/y.md": "y", "b.md": "plain", "p.png": "png"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert {r["path"] for r in vault.files(spark, str(root), skip=("skip",)).collect()} == {"a/n.md", "b.md", "p.png"}
    notes = vault.notes(spark, str(root), skip=("skip",))
    assert {r["path"]: r["body"][:14] for r in notes.collect()} == {"a/n.md": "# Teoria Geral", "b.md": "plain"}
    (tmp_path / "x.jsonl").write_text('{"path": "a", "v": 1}\nbroken\n{"path": "a", "v": 2}\n{"path": "b", "v": 3}\n')
    assert {(r["path"], r["v"]) for r in vault.json_lines(spark, str(tmp_path / "x.jsonl"), "path string, v int", "path").collect()} == {("a", 2), ("b", 3)}
    items = spark.createDataFrame([("d1", "p", "t"), ("d2", "q", "u")], "domain string, path string, title string")
    store.write_keywords(items, str(tmp_path / "kw"))
    store.write_keywords(items.where("domain = 'd1'").withColumn("path", F.lit("new")), str(tmp_path / "kw"))
    assert {(r["domain"], r["path"]) for r in spark.read.parquet(str(tmp_path / "kw")).collect()} == {("d1", "new"), ("d2", "q")}
    assert store.purge_keywords(spark, str(tmp_path / "kw"), "d1").count() == 1


def test_sequential_communities_are_for_small_graphs(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "a string, b string, weight double")
    with pytest.raises(ValueError):
        community.sequential(pairs, most=2)
    assert community.sequential(pairs, most=3).count() == 4


def test_super_graph_keeps_isolated_communities(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "a string, b string, weight double")
    part = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("x", 3)], "node string, community int")
    assert {tuple(r) for r in community.super_graph(pairs, part).collect()} == {(1, 1, 1.0), (1, 2, 2.0), (3, 3, 0.0)}


def test_parts_of_a_long_path_come_to_rest(spark):
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(300)], "a long, b long, weight double")
    part = spark.range(301).select(F.col("id").alias("node"), F.lit(0).alias("community"))
    assert {r["part"] for r in community.split_components(pairs, part).collect()} == {0}
    found = community.communities(pairs)
    assert found.count() == 301 and found.first()["modularity"] > 0.8


def test_a_schedule_drops_what_comes_while_a_job_runs(spark, tmp_path):
    rows = spark.createDataFrame([("k", 0, 100), ("k", 50, 100), ("k", 100, 10), ("k", 105, 10), ("j", 60, 5)], "key string, at_ms long, took_ms long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = S.scheduled(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("runs").collect()} == {("k", 0, 100, True), ("k", 50, 100, False), ("k", 100, 110, True), ("k", 105, 110, False), ("j", 60, 65, True)}


def test_a_refined_profile_or_the_extracted_one(spark):
    own = spark.createDataFrame([("a", "s", "rule", "local"), (None, "s", "rule", "local")], "path string, sha string, summary string, source string")
    model = spark.createDataFrame([("a", "s", "better"), ("b", "s", "none")], "path string, sha string, summary string")
    assert {tuple(r) for r in enrich.profiles(own, model).select("path", "summary", "source").collect()} == {("a", "better", "model"), (None, "rule", "local")}


def test_seeded_communities_beyond_the_sequential_bound(spark):
    """More edges than the sequential form takes: it raised, the seeded one goes on."""
    pairs = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 1.0) for g in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0", 1.0), ("y1", "z1", 1.0)], "a string, b string, weight double")
    rows = community.seeded(pairs, most=10).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["community_id"], set()).add(r["path"][0])
    assert len(rows) == 15 and sorted(map(sorted, groups.values())) == [["x"], ["y"], ["z"]]


@pytest.mark.parametrize("most", [0, 12, 1000])
def test_components_in_tasks_and_in_tables(spark, most):
    """Cliques joined by a bridge, two large components and two small ones: by tables, mixed and in tasks alike."""
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcdpq" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("c0", "d0", 1.0)]
    pairs = spark.createDataFrame(rows, "a string, b string, weight double")
    found = community.communities(pairs, most=most).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["community_id"], set()).add(r["path"][0])
    assert sorted(map(sorted, groups.values())) == [[g] for g in "abcdpq"] and sorted(groups) == list(range(6))
    part = spark.createDataFrame([(r["path"], r["community_id"]) for r in found], "node string, community int")
    assert {r["modularity"] for r in found} == {community.modularity(pairs, part).first()["q"]}


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    for i in range(640):
        (tmp_path / f"n{i}.md").write_text(f"text {i}")
    rows = vault.notes(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 12 and {r["content"] for r in rows.select("content").collect()} == {f"text {i}" for i in range(640)}
    assert vault.files(spark, str(tmp_path)).rdd.getNumPartitions() == 12
