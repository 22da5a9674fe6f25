"""Pruned vector comparison and banded signatures against all pairs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from noteloom.functions.vectors import signature
from noteloom.operators import clusters, vector


def clustered_rows(n=600, dims=8, groups=12, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % groups]]) for i in range(n)]
    return rows + [(n, [0.0] * dims), (n + 1, [0.0] * dims), (n + 2, None), (n + 3, list(rows[0][1]))]


def cosines(rows):
    unit = {}
    for i, v in rows:
        if v is not None:
            size = math.sqrt(sum(x * x for x in v))
            unit[i] = [x / size if size else 0.0 for x in v]
    return {(a, b): round(sum(x * y for x, y in zip(unit[a], unit[b])), 6) for a, b in itertools.permutations(unit, 2)}, unit


@pytest.fixture
def small_clusters(monkeypatch):
    monkeypatch.setattr(clusters, "PER_CENTRE", 20)
    monkeypatch.setattr(clusters, "PACKED", 16)


@pytest.mark.parametrize("threshold", [0.97, 0.3, -0.2])
def test_pairs_are_exact(spark, small_clusters, threshold):
    rows = clustered_rows(150)
    cos, _ = cosines(rows)
    got = clusters.similar_pairs(spark.createDataFrame(rows, "path long, vec array<double>"), "path", "vec", threshold).collect()
    want = {(a, b) for (a, b), c in cos.items() if a < b and c >= threshold}
    near_edge = {(a, b) for (a, b), c in cos.items() if abs(c - threshold) < 2e-6}
    assert {(r["a"], r["b"]) for r in got} ^ want <= near_edge and len({(r["a"], r["b"]) for r in got}) == len(got)


def test_neighbours_are_exact(spark, small_clusters):
    rows = clustered_rows(150)
    cos, unit = cosines(rows)
    got = clusters.neighbours(spark.createDataFrame(rows, "path long, vec array<double>"), "path", "vec", 7).collect()
    for i in unit:
        own = sorted((r for r in got if r["path"] == i), key=lambda r: r["rank"])
        best = sorted(((-cos[i, j], j) for j in unit if j != i))[:7]
        assert [r["score"] for r in own] == pytest.approx([-c for c, _ in best], abs=2e-6)
        assert len({r["neighbour"] for r in own}) == 7


def test_few_clusters_are_reached_on_clustered_vectors(spark, small_clusters):
    made = clusters.clustered(spark.createDataFrame(clustered_rows(), "path long, vec array<double>"), "path", "vec")
    every = len(made.reach.radii)
    sent = clusters.probes(made, made.rows.withColumn("within", F.lit(math.acos(0.95))), once=True)
    n, total = sent.count(), made.rows.count()
    assert every > 20 and n < total * every / 4
    assert not any("Cartesian" in x or "NestedLoop" in x for x in clusters._compared(made, sent)._jdf.queryExecution().toString().splitlines())


def test_string_keys_and_an_empty_table(spark):
    rows = [(f"k{i}", v) for i, v in clustered_rows(30)]
    df = spark.createDataFrame(rows, "path string, vec array<double>")
    assert {r["a"] < r["b"] for r in clusters.similar_pairs(df, "path", "vec", 0.5).collect()} == {True}
    assert clusters.neighbours(df.where("false"), "path", "vec", 3).count() == 0


def flipped(sh, bits):
    return f"{int(sh, 16) ^ sum(1 << b for b in bits):032x}"


@pytest.mark.parametrize("radius", [0, 5, 20, 31])
def test_signatures_within_the_radius_are_all_found(spark, radius):
    rng = random.Random(radius)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(12)], "path int, vec array<double>")
    base = [r["sh"] for r in vectors.select(signature(F.col("vec"), "mixed", 16).alias("sh")).collect()]
    rows = [(f"{i}-{d}", flipped(sh, rng.sample(range(128), d))) for i, sh in enumerate(base) for d in (0, 1, radius, radius + 1, 40)] + [("none", None)]
    asked = [(i, sh) for i, sh in enumerate(base)] + [(99, None)]
    df, q = spark.createDataFrame(rows, "path string, sh string"), spark.createDataFrame(asked, "query_id int, sh string")
    got = vector.signature_search(df, q, radius, 1000)
    want = {(i, p, bin(int(s, 16) ^ int(sh, 16)).count("1")) for i, sh in asked if sh for p, s in rows if s and bin(int(s, 16) ^ int(sh, 16)).count("1") <= radius}
    assert {(r["query_id"], r["path"], r["distance"]) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_rows_without_a_signature_come_last_if_kept(spark):
    df = spark.createDataFrame([("a", "0" * 32), ("b", None), ("c", "f" * 32)], "path string, sh string")
    q = spark.createDataFrame([(1, "0" * 32), (2, None)], "query_id int, sh string")
    got = [(r["query_id"], r["path"], r["distance"]) for r in vector.signature_search(df, q, 20, 10, keep_unsigned=True).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 0), (1, "b", None), (2, "a", None), (2, "b", None), (2, "c", None)]


def test_every_band_is_asked_with_its_own_value(spark):
    """Signatures that agree in one band only, whichever that is (the band's number was once taken for the mask's)."""
    q = "0" * 32
    rows = [(k, "".join("0000" if i == k else "f000" for i in range(8))) for k in range(8)]
    found = vector.near_signatures(spark.createDataFrame(rows, "path int, sh string").select("sh"), spark.createDataFrame([(q,)], "q_sh string"), 28)
    assert {r["sh"]: r["distance"] for r in found.collect()} == {sh: 28 for _, sh in rows}


@pytest.mark.parametrize("key", ["long", "string"])
def test_vectors_that_reach_many_clusters_pass_by_in_bands(spark, small_clusters, monkeypatch, key):
    """Vectors without clusters, with copies and zero vectors: none is sent to every cluster, and the neighbours stay exact."""
    monkeypatch.setattr(clusters, "SENT", 2)
    monkeypatch.setattr(clusters, "SLICE", 32)
    monkeypatch.setattr(clusters, "WAITING", 100)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 430)] + [(430, [0.0] * 8), (431, [0.0] * 8)]
    cos, unit = cosines(rows)
    df = spark.createDataFrame(rows, "path long, vec array<double>").select(F.col("path").cast(key).alias("path"), "vec")
    sent, make = [], clusters.probes
    monkeypatch.setattr(clusters, "probes", lambda *a, **b: sent.append(make(*a, **b)) or sent[-1])
    got = clusters.neighbours(df, "path", "vec", 5).collect()
    assert sum(x.count() for x in sent) <= 2 * len(rows)
    order = int if key == "long" else str
    for i in unit:
        own = sorted((r for r in got if r["path"] == order(i)), key=lambda r: r["rank"])
        best = sorted((-cos[i, j], order(j)) for j in unit if j != i)[:5]
        assert [r["score"] for r in own] == pytest.approx([-c for c, _ in best], abs=2e-6) and len({r["neighbour"] for r in own}) == 5
        if i == 0 or i >= 400 and i < 430:  # ties among copies end in order of the key
            assert [r["neighbour"] for r in own] == [j for _, j in best]


def test_bodies_are_read_only_for_queries_without_vector(spark):
    notes = spark.range(2).selectExpr("cast(id as string) path", "'t' title", "concat('some body', id) body", "array(1.0D, id + 0.5D) vec")
    asked = spark.createDataFrame([(1, "body1", [1.0, 0.0])], "query_id int, query string, vec array<double>")
    read = lambda df: "some body" in df._jdf.queryExecution().optimizedPlan().toString()
    assert not read(vector.search(notes, asked))
    both = vector.search(notes, asked.union(asked.selectExpr("2", "query", "cast(null as array<double>)")))
    assert read(both) and [(r["path"], r["score"]) for r in both.where("query_id = 2").collect()] == [("1", 0.5)]


@pytest.mark.parametrize("blocks", [(65_536, 65_536, 256, 8192), (7, 40, 3, 16)])
def test_wide_radii_count_all_pairs_and_keep_the_nearest(spark, monkeypatch, blocks):
    for name, size in zip(("ASKED", "HELD", "ASKED_AT_ONCE", "HELD_AT_ONCE"), blocks):
        monkeypatch.setattr(vector, name, size)
    monkeypatch.setattr(vector, "near_signatures", None)  # its probes, some 5,600 a signature, aren't made
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(4)]
    signs = [base[k % 4] ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 24))) for k in range(150)]
    signs[20:40] = [signs[20]] * 20  # equal ones, more than are listed
    rows = spark.createDataFrame([(k, f"{x:032x}") for k, x in enumerate(signs)] + [(900, None)], "path long, sh string")
    asked = rows.where("path % 5 = 0 and sh is not null").select(F.col("path").alias("query_id"), "sh")
    got = sorted(tuple(r) for r in vector.signature_search(rows, asked, 31, 6).select("query_id", "rank", "distance", "path").collect())
    near = lambda q: sorted((bin(signs[q] ^ x).count("1"), k) for k, x in enumerate(signs) if bin(signs[q] ^ x).count("1") <= 31)[:6]
    assert got == [(q, n + 1, d, k) for q in range(0, 150, 5) for n, (d, k) in enumerate(near(q))]


def test_signatures_by_batch_equal_the_column_function(spark):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(24)]) for k in range(60)] + [(60, [0.0] * 24), (61, None), (62, []), (63, [1.5, -2.0]), (64, [1.0] * 40), (65, [float("nan"), 1.0]), (66, [None, 1.0])]
    df = spark.createDataFrame(rows, "path long, vec array<float>").repartition(3)
    want = {r["path"]: r["sh"] for r in df.select("path", signature(F.col("vec"), "mixed", 32).alias("sh")).collect()}
    assert {r["path"]: r["sh"] for r in vector.signed(df, "path", "vec", 32).collect()} == want
