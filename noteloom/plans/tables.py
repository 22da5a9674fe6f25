"""How the driver's tables stand in for notes, profiles, links and events; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.functions.text import NOT_NOUNS

#: A fixed batch of queries (texts of the corpus's own words, one without a hit, one with a repeated word).
QUERY_TEXTS = ((1, "the erblest of inenan"), (2, "ciónllcita que de"), (3, "étion dans le"), (4, "nicht ich auch sch"), (5, "habeas corpus"), (6, "thand thinha the thand"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERY_TEXTS), "query_id int, query string")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select("doc_id", path.alias("path"), F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), F.col("text").alias("content"))


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    rows = n.select("path", "body", F.length("body").cast("long").alias("char_count"), T.unique_folded(T.proper_nouns(F.col("body")), 2, 12).alias("concepts"))
    return rows.select(
        "path", "char_count", "concepts", T.domain_of(F.col("path")).alias("domain"), T.difficulty(F.col("char_count")).alias("difficulty"),
        T.one_line_summary(F.col("body")).alias("one_line_summary"), T.cues(F.col("body"), F.col("concepts")).alias("cornell_cue"),
        T.note_type(F.col("body"), F.col("path"), F.col("char_count"), F.size("concepts")).alias("note_type"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("cnt"))
    return rows.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), "cnt")


def link_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, but only orders of open status: the others are deleted sources."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("path"))
    return orders.unionByName(read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("path")))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: folder by customer, changed on the order's date."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.col("o_orderdate").alias("mtime"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.col("embedding").alias("vec"), "label")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's next: (task, input, output, quality, ts)."""
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("input"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("output"))
    task = F.concat(F.lit("task"), (F.col("conv_id") % 7).cast("string"))
    return u.join(a, ["conv_id", "t"]).select(task.alias("task"), "input", "output", ((F.length("output") % 11) / 10.0).alias("quality"), (F.col("conv_id") * 1000 + F.col("t")).alias("ts"))


def values_sql(rows, names: str) -> str:
    cells = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return f"(VALUES {cells}) v({names})"


QUERIES_SQL = f"queries AS (SELECT CAST(query_id AS INTEGER) AS query_id, query FROM {values_sql(QUERY_TEXTS, 'query_id, query')})"
NOTES_SQL = "notes AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, lang || ' ' || CAST(doc_id AS VARCHAR) AS title, text AS body FROM documents)"
LINKS_SQL = "links AS (SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, count(*) AS cnt FROM lineitem GROUP BY ALL)"
LINK_FILES_SQL = "files AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR) FROM part)"
DATED_SQL = "dated AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) || '/o' || CAST(o_orderkey AS VARCHAR) || '.md' AS path, 'c' || CAST(o_custkey AS VARCHAR) AS folder, CAST(o_orderdate AS DATE) AS day FROM orders)"
VECTORS_SQL = "vectors AS (SELECT vec_id AS path, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_STOP = "[" + ", ".join(f"'{w}'" for w in NOT_NOUNS) + "]"
PASSPORTS_SQL = rf"""raw_nouns AS (
  SELECT path, body, list_filter(regexp_extract_all(body, '\b[A-ZÀ-Ý][0-9A-Za-z_À-ÿ\-]{{1,23}}\b'), lambda w: NOT list_contains({_STOP}, lower(w)) AND (w <> upper(w) OR regexp_matches(w, '[0-9]'))) AS found FROM notes
), folded_nouns AS (
  SELECT path, body, found, list_transform(found, lambda w: lower(w)) AS low FROM raw_nouns
), nouns AS (
  SELECT path, body, list_filter(found, lambda w, i: list_position(low, lower(w)) = i)[1:15] AS nouns FROM folded_nouns
), prose AS (
  SELECT path, list_filter(list_transform(string_split(trim(body), chr(10)), lambda t: trim(t)), lambda t: t <> '' AND NOT regexp_matches(t, '^(?:#|- |\* |\d+\.\s|>|\|)')) AS lines FROM notes
), taken AS (
  SELECT path, CASE WHEN len(lines) = 0 THEN '' ELSE list_reduce(lines, lambda a, t: CASE WHEN length(a) > 375 THEN a ELSE a || ' ' || t END) END AS line FROM prose
), summaries AS (
  SELECT path, substring(trim(array_to_string(string_split(regexp_replace(line, '([.!?])\s+([A-ZÀ-Ý])', '\1' || chr(1) || '\2', 'g'), chr(1))[1:2], ' ')), 1, 250) AS one_line_summary FROM taken
), passports AS (
  SELECT n.path, n.body, CAST(length(n.body) AS BIGINT) AS char_count, n.nouns[1:12] AS concepts, split_part(n.path, '/', 1) AS domain,
    CASE WHEN length(n.body) > 10240 THEN 4 WHEN length(n.body) > 5120 THEN 3 WHEN length(n.body) > 2048 THEN 2 ELSE 1 END AS difficulty, s.one_line_summary,
    list_transform(n.nouns[1:3], lambda c: 'O que é ' || lower(c) || '?') AS cornell_cue,
    CASE WHEN length(n.body) < 150 THEN 'fleeting' END AS note_type
  FROM nouns n JOIN summaries s USING (path)
)"""
