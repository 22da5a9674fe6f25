"""BM25 ranking of many queries at once, postings and their incremental upkeep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators.common import materialised, small, top_per
from noteloom.operators.dictionary import keyword_prefix  # noqa: F401  part of this module's operators

K1, B = 1.5, 0.75
#: Up to so many openings of asked stems stand in one pattern.
FEW = 1000


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def contribution(tf: Column, dl: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    length = F.when(avgdl > 0, k1 * (1.0 - b + b * dl / avgdl)).otherwise(0.0)
    return weight * tf * (k1 + 1.0) / (tf + length)


def tokenised(notes: DataFrame, stemmed: bool = False, tokeniser=T.tokens) -> DataFrame:
    """(path, tokens, dl)."""
    tok = tokeniser(F.coalesce(F.col("body"), F.lit("")))
    if stemmed:
        tok = F.filter(F.transform(tok, T.stem), lambda t: t.isNotNull())
    return notes.select("path", tok.alias("tokens")).withColumn("dl", F.size("tokens"))


def corpus_stats(tok: DataFrame, skip_empty: bool = False) -> DataFrame:
    """One row: N, avgdl (all notes count, unless ``skip_empty``)."""
    rows = tok.where("dl > 0") if skip_empty else tok
    return rows.agg(F.count("*").alias("N"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def _placed(tok: DataFrame) -> DataFrame:
    """(path, token, tf, dl, pos): pos is where the token first stands."""
    at = tok.select("path", "dl", F.posexplode("tokens").alias("pos", "token"))
    return at.groupBy("path", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.min("pos").alias("pos"))


def _cut(placed: DataFrame, keep: int) -> DataFrame:
    return top_per(placed, ["path"], [F.desc("tf"), F.asc("pos")], keep).drop("rank", "pos")


def postings(tok: DataFrame, keep: int | None = None) -> DataFrame:
    """(path, token, tf, dl); ``keep`` leaves the most frequent tokens of a note, first seen first."""
    return _cut(_placed(tok), keep) if keep else _placed(tok).drop("pos")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, stemmed: bool = False, dedup: bool = True, tokeniser=T.tokens) -> DataFrame:
    """(query_id, token[, times])."""
    tok = tokeniser(F.col("query"))
    if stemmed:
        tok = F.filter(F.transform(tok, T.stem), lambda t: t.isNotNull())
    terms = queries.select("query_id", F.explode(tok).alias("token"))
    counted = terms.groupBy("query_id", "token").agg(F.count("*").alias("times"))
    return counted.withColumn("times", F.lit(1).cast("long")) if dedup else counted


#: Marks a note's own row beside those of its tokens; no token is empty.
NOTE_ROW = ""


def asked_rows(notes: DataFrame, terms: DataFrame, stemmed: bool = False, tokeniser=T.tokens) -> DataFrame:
    """Written (path, token, tf, dl): the notes' rows of all tokens asked for, and one of every note
    itself (``NOTE_ROW``) for the corpus figures, in one pass over the texts.

    Stems are found for every distinct token once; the forms of the asked ones then pick the rows.
    """
    spark, tok = notes.sparkSession, tokenised(notes, tokeniser=tokeniser)
    wanted = terms.select("token").distinct()
    if stemmed:
        words = tok.select(F.explode("tokens").alias("form"))
        openings = wanted.select(T.stem_opening(F.col("token")).alias("o")).distinct().limit(FEW + 1).collect()
        if len(openings) <= FEW:  # only spares work: most tokens can't have an asked stem
            words = words.where(T.fold(F.col("form")).rlike("^(?:" + "|".join(re.escape(r["o"]) for r in openings) + ")"))
        words = words.distinct()
        forms = materialised(words.withColumn("token", T.stem(F.col("form"))).join(small(wanted), "token", "left_semi"), "forms")
    else:
        forms = wanted.withColumn("form", F.col("token"))
    forms = forms.select("form", "token").unionByName(spark.createDataFrame([(NOTE_ROW, NOTE_ROW)], "form string, token string"))
    at = tok.select("path", "dl", F.explode(F.concat(F.array(F.lit(NOTE_ROW)), "tokens")).alias("form")).join(small(forms), "form")
    return materialised(at.groupBy("path", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "hits")


def _scored(hits: DataFrame, weighted: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, path, score, matched) above 0 from postings and weighted query terms."""
    parts = hits.join(small(weighted), "token").withColumn("part", contribution(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("w"), k1, b))
    return parts.groupBy("query_id", "path").agg(F.round(F.sum("part"), 6).alias("score"), F.sort_array(F.collect_set("token")).alias("matched")).where("score > 0")


def bm25_scores(notes: DataFrame, queries: DataFrame, dedup: bool = True, stemmed: bool = False, skip_empty: bool = False, k1: float = K1, b: float = B, tokeniser=T.tokens) -> DataFrame:
    """(query_id, path, score, matched) of all notes above 0.

    Only tokens that occur in some query leave the note's row, so the shuffle is small; the
    frequencies of those tokens come from the same rows.
    """
    terms = query_terms(queries, stemmed, dedup, tokeniser)
    rows = asked_rows(notes, terms, stemmed, tokeniser)
    stats = corpus_stats(rows.where(F.col("token") == NOTE_ROW), skip_empty)
    hits = rows.where(F.col("token") != NOTE_ROW)
    weighted = terms.join(document_frequency(hits), "token").crossJoin(F.broadcast(stats)).withColumn("w", idf(F.col("N"), F.col("df")) * F.col("times"))
    return _scored(hits, weighted, k1, b)


def bm25(notes: DataFrame, queries: DataFrame, top: int = 30, **options) -> DataFrame:
    """Ranked notes per query: (query_id, path, score, matched, rank); options as of ``bm25_scores``."""
    return top_per(bm25_scores(notes, queries, **options), ["query_id"], [F.desc("score"), F.asc("path")], top)


def lane_corpus(notes: DataFrame, most: int = 2000, chars: int = 30_000) -> DataFrame:
    """What the in-memory lexical lane reads: the first ``most`` Markdown notes in path order, each body's first ``chars``."""
    return notes.where(F.col("path").endswith(".md")).select("path", F.substring("body", 1, chars).alias("body")).orderBy("path").limit(most)


def plain_bm25(notes: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """Variant with the plain word tokeniser; repeated query words count each time."""
    return bm25(notes, queries, top, dedup=False, tokeniser=T.plain_words)


def lexical_index(notes: DataFrame, keep: int | None = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stemmed index to be stored: (postings, idf per token, stats); df counts all tokens, postings are cut
    to the ``keep`` most frequent of a note, if given."""
    tok = tokenised(notes, stemmed=True).where("dl > 0")
    whole = materialised(_placed(tok), "postings")
    stats = corpus_stats(whole.where("pos = 0"))  # one row a note, without another pass over the texts
    df = document_frequency(whole)
    return _cut(whole, keep) if keep else whole.drop("pos"), df.crossJoin(F.broadcast(stats)).select("token", "df", F.round(idf(F.col("N"), F.col("df")), 6).alias("idf")), stats


def search_index(stored: DataFrame, weights: DataFrame, stats: DataFrame, queries: DataFrame, top: int = 30, k1: float = K1, b: float = B) -> DataFrame:
    """Ranked notes per query from a stored index (postings, idf per token, stats); no text is read."""
    weighted = query_terms(queries, stemmed=True).join(weights.select("token", "idf"), "token").crossJoin(F.broadcast(stats)).withColumn("w", F.col("idf") * F.col("times"))
    return top_per(_scored(stored, weighted, k1, b), ["query_id"], [F.desc("score"), F.asc("path")], top)


def upsert_postings(stored: DataFrame, changed: DataFrame, removed: DataFrame, keep: int = 200) -> DataFrame:
    """Postings after notes changed or went: theirs are replaced, all others stay."""
    gone = changed.select("path").unionByName(removed.select("path")).distinct()
    fresh = postings(tokenised(changed, stemmed=True).where("dl > 0"), keep)
    return stored.join(gone, "path", "left_anti").unionByName(fresh.select(*stored.columns))


def path_match(notes: DataFrame, queries: DataFrame, top: int = 30) -> DataFrame:
    """Notes whose path holds the query, case-insensitive, in path order."""
    hits = notes.select("path").join(small(queries), F.lower("path").contains(F.lower("query")))
    return top_per(hits.select("query_id", "path"), ["query_id"], [F.asc("path")], 2 * top)


def first_seen(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
