"""Figures that are printed or counted as the SQL does."""

import re

from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators import graph, lexical


def test_counts_are_shown_by_their_exact_value(spark):
    """2.25 is a tie and goes to the even digit; 1.45 lies just below the tie, 2.35 just above it."""
    df = spark.createDataFrame([(2_250_000,), (1_450_000,), (2_350_000,), (1250,), (999_999,), (999,)], "n int")
    assert [r[0] for r in df.select(T.compact_count(F.col("n"))).collect()] == ["2.2M", "1.4M", "2.4M", "1.2k", "1000.0k", "999"]


def test_capitals_beside_accented_letters_are_technical(spark):
    """Letters outside ASCII end a word here, as in the SQL's patterns."""
    df = spark.createDataFrame([("x" * 500 + " ÉABC" * 6,), ("x" * 500 + " ABCé" * 6,), ("x" * 500 + " aABC" * 6,)], "body string")
    assert [r[0] for r in df.select(T.graded_difficulty(F.col("body"))).collect()] == [2, 2, 1]


def test_cosines_are_shown_rounded_as_doubles(spark):
    """0.53175 times 10,000 lies below the tie."""
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.53175, (1 - 0.53175**2) ** 0.5])], "path string, vec array<double>")
    assert {r["why"][0] for r in graph.cosine_edges(df, 0.3).collect()} == {"cosine 0.5317"}


def test_stems_equal_the_patterns(spark):
    """Every ending on short and long words, and two endings after each other, beside the patterns themselves."""
    endings = [x for s in T.SUFFIXES for x in s.strip("(?:)").split("|")] + [p for p, _ in T.PLURALS] + ["", "x", "ões", "ção"]
    words = sorted({b + x + y for b in ("", "a", "ab", "abc", "coes", "amente", "casa") for x in endings for y in endings})

    def stem(word):
        t = word.translate(str.maketrans(T.ACCENTED, T.PLAIN))
        if len(t) < 2:
            return None
        if len(t) >= 4:
            for ending, single in T.PLURALS:
                t = re.sub(ending + "$", single, t)
        cuts = (re.sub(suffix + "$", "", t) for suffix in T.SUFFIXES)
        return next((s for s in cuts if 3 <= len(s) < len(t)), t)

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in got.collect()} == {w: stem(w) for w in words}
    assert "regexp_replace" not in got._jdf.queryExecution().analyzed().toString()


def test_the_index_reads_the_texts_once(spark):
    """Its figures come from the stored postings: the texts' column is not in their plan."""
    notes = spark.createDataFrame([("a", "um dois dois"), ("b", "tres"), ("c", "")], "path string, body string")
    stats = lexical.lexical_index(notes)[2]
    assert list(stats.first()) == [2, 2.0]
    assert "body" not in stats._jdf.queryExecution().analyzed().toString()


def test_edges_travel_once_to_their_source(spark):
    rows = spark.createDataFrame([("a", "b", "wikilink", 1.0, ["x"]), ("a", "b", "wikilink", 0.5, ["y"]), ("a", "b", "backlink", 1.0, ["z"]), ("a", "c", "backlink", 1.0, ["z"])], "src string, dst string, type string, weight double, why array<string>")
    found = [graph.neighbours_by_dst(graph.merge([rows], by)) for by in (False, True)]
    got = [[(r["src"], r["dst"], r["weight"], r["n_edges"], r["rank"]) for r in df.orderBy("rank").collect()] for df in found]
    assert got[0] == got[1] == [("a", "b", 2.0, 2, 1), ("a", "c", 1.0, 1, 2)]
    assert found[1]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
