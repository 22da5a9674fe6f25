"""Queries on lexical, vector and fused retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.functions.text import ACCENTED, PLAIN, PLURALS, STOP_WORDS, SUFFIXES
from noteloom.functions.vectors import MIX, signature
from noteloom.operators import fusion, graph, lexical, profile, vector
from noteloom.operators.common import materialised, top_per
from noteloom.plans import tables as D

TOKENS_SQL = "regexp_extract_all(lower({0}), '[0-9a-zà-ÿ_\\-]{{2,}}')"
PLAIN_SQL = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*'), lambda w: length(w) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "], w))"


def stem_sql(t: str) -> str:
    """The light stemmer, over an expression."""
    folded = f"translate(lower({t}), '{ACCENTED}', '{PLAIN}')"
    plural = folded
    for ending, single in PLURALS:
        plural = f"regexp_replace({plural}, '{ending}$', '{single}')"
    base = f"(CASE WHEN length({folded}) >= 4 THEN {plural} ELSE {folded} END)"
    out = base
    for suffix in reversed(SUFFIXES):
        short = f"regexp_replace(b, '{suffix}$', '')"
        out = f"CASE WHEN length({short}) >= 3 AND length({short}) < length(b) THEN {short} ELSE {out if out != base else 'b'} END"
    return base, out


def bm25_sql(name: str, tokens: str = TOKENS_SQL, dedup: bool = True, stemmed: bool = False, top: int = 30, docs: str = "notes", skip_empty: bool = False) -> str:
    """CTEs ending in ``name`` (query_id, path, score, rank)."""
    p = name + "_"
    base, out = stem_sql("t")
    stem = lambda sel, frm: f"SELECT {sel}, {out} AS token FROM (SELECT {sel}, {base} AS b FROM ({frm}))" if stemmed else f"SELECT {sel}, t AS token FROM ({frm})"
    return f"""
{p}tok AS ({stem("path", f"SELECT path, unnest({tokens.format('body')}) AS t FROM {docs}")}),
{p}kept AS (SELECT * FROM {p}tok WHERE token IS NOT NULL AND length(token) >= 2),
{p}dl AS (SELECT d.path, count(k.token) AS dl FROM {docs} d LEFT JOIN {p}kept k USING (path) GROUP BY d.path),
{p}stats AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM {p}dl {"WHERE dl > 0" if skip_empty else ""}),
{p}tf AS (SELECT path, token, count(*) AS tf FROM {p}kept GROUP BY ALL),
{p}df AS (SELECT token, count(*) AS df FROM {p}tf GROUP BY token),
{p}raw AS ({stem("query_id", f"SELECT query_id, unnest({tokens.format('query')}) AS t FROM queries")}),
{p}terms AS (SELECT query_id, token, {"1" if dedup else "count(*)"} AS times FROM {p}raw WHERE length(token) >= 2 GROUP BY query_id, token),
{p}sum AS (
  SELECT query_id, path, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, list_sort(list_distinct(list(token))) AS matched
  FROM {p}terms JOIN {p}tf USING (token) JOIN {p}df USING (token) JOIN {p}dl USING (path), {p}stats GROUP BY query_id, path
),
{name} AS (
  SELECT query_id, path, score, matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM {p}sum WHERE score > 0
  QUALIFY rank <= {top}
)"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "path", "score", "rank")


def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.tokenised(D.notes(spark, sf)).select("path", F.col("dl").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(lexical.tokenised(D.notes(spark, sf)))).select("token", "df")


def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.lexical_index(D.notes(spark, sf))[1]


def stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = lexical.lexical_index(D.notes(spark, sf), keep=None)[0]
    return rows.groupBy("path").agg(F.count("*").alias("kept"), F.sum("tf").alias("sum_tf"), F.first("dl").cast("long").alias("dl"))


def postings_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth note changed to its title, every seventh removed; postings counted after that."""
    n = D.notes(spark, sf)
    stored = lexical.lexical_index(n)[0]
    changed = n.where("doc_id % 10 = 0").select("path", F.col("title").alias("body"))
    removed = n.where("doc_id % 7 = 0 and doc_id % 10 <> 0")
    rows = lexical.upsert_postings(stored, changed, removed)
    return rows.groupBy("path").agg(F.count("*").alias("kept"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(lexical.bm25(D.notes(spark, sf), D.queries(spark)))


def bm25_no_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(lexical.bm25(D.notes(spark, sf), D.queries(spark), dedup=False))


def bm25_plain_words(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(lexical.plain_bm25(D.notes(spark, sf), D.queries(spark)))


def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = lexical.bm25(D.notes(spark, sf), D.queries(spark), stemmed=True, skip_empty=True)
    return rows.select("query_id", "path", "score", "rank", F.array_join("matched", ",").alias("matched"))


PATH_QUERIES = ((1, "SRC1/EN"), (2, "/fr/9"), (3, "nothing"))


def path_match(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame(list(PATH_QUERIES), "query_id int, query string")
    return lexical.path_match(D.notes(spark, sf), q).select("query_id", "path", "rank")


def cosine_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return vector.neighbours(D.vectors(spark, sf), "path", "vec", 12).select("path", "neighbour", "score", "rank")


SEARCHES = ((1, "en", 0), (2, "fr 7", 7), (3, "de", 21), (4, "x", 3))


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame(list(SEARCHES), "query_id int, query string, vec_id long")
    return q.join(D.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id")


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    return D.notes(spark, sf).join(D.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id")


def cosine_search_boost(spark: SparkSession, sf: str) -> DataFrame:
    return vector.search(_embedded(spark, sf), _vector_queries(spark, sf))


def title_body_search(spark: SparkSession, sf: str) -> DataFrame:
    q = D.queries(spark).withColumn("vec", F.lit(None).cast("array<float>")).withColumn("query", F.substring_index("query", " ", 1))
    return vector.search(D.notes(spark, sf).withColumn("vec", F.lit(None).cast("array<float>")), q)


def multi_vector_max(spark: SparkSession, sf: str) -> DataFrame:
    e = D.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    shifted = lambda k, name: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(name))
    rows = e.select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.col("v")).alias("title_vec")).join(shifted(1, "body_vec"), "vec_id", "left").join(shifted(2, "summary_vec"), "vec_id", "left")
    q = e.where("vec_id = 5").select(F.lit(1).alias("query_id"), F.col("v").alias("vec"))
    return vector.multi_vector(rows.withColumnRenamed("vec_id", "path"), q)


def image_similar_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "embeddings").select(F.col("vec_id").alias("rel"), F.when(F.col("vec_id") % 5 == 4, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("vector"))
    return vector.similar_images(rows, rows.where("rel < 5"))


def simhash_compat(spark: SparkSession, sf: str) -> DataFrame:
    return D.vectors(spark, sf).select("path", signature(F.col("vec"), "compat").alias("sh"))


def simhash_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return D.vectors(spark, sf).select("path", signature(F.col("vec"), "mixed", 64).alias("sh"))


def hamming_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = simhash_compat(spark, sf)
    q = rows.where("path < 3").select(F.col("path").alias("query_id"), "sh")
    return vector.signature_search(rows, q, 20, 50)


def signature_radius(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth embedding's mixed signature against all, within 31 bits."""
    rows = materialised(vector.signed(D.vectors(spark, sf), "path", "vec", 64), "signatures")
    return vector.signature_search(rows, rows.where("path % 10 = 0").select(F.col("path").alias("query_id"), "sh"), 31, 50)


def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "embeddings").select(F.col("label").alias("path"), F.col("embedding").alias("vec"))
    return vector.mean_pooled(rows).select("path", F.size("vec").cast("long").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _event_lanes(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = D.read(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.concat_ws("/", "event_type", (F.col("event_id") % 13).cast("string")).alias("path"), "value", "event_id")
    a = e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "event_id")))
    b = e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("event_id")))
    return fusion.fuse([fusion.lane(a, "semantic", 40), fusion.lane(b, "bm25", 40)])


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _event_lanes(spark, sf).select("query_id", "path", "score", F.col("source_mask").cast("int").alias("source_mask"), F.array_join("sources", ",").alias("sources"))


def mmr_diversify(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.diversify(_event_lanes(spark, sf), 10)


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every text query with the embedding of the note of its number."""
    return D.queries(spark).join(D.read(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("vec")), "query_id")


def hybrid_query(spark: SparkSession, sf: str) -> DataFrame:
    """Seven lanes: vectors, signatures, paths, profiles, keyword index, BM25, stemmed BM25."""
    n, q, asked = D.notes(spark, sf), D.queries(spark), _query_vectors(spark, sf)
    words = q.withColumn("query", F.substring_index("query", " ", -1))
    signed = lambda rows, key: rows.select(key, signature(F.col("vec"), "compat").alias("sh"))
    items = n.select("path", F.substring_index("path", "/", 1).alias("domain"), "title", F.col("body").alias("summary"), F.array(F.lit("note")).alias("keywords"))
    lanes = {
        "semantic": lambda: vector.search(_embedded(spark, sf), asked, 20),
        "simhash": lambda: vector.signature_search(signed(_embedded(spark, sf), "path"), signed(asked, "query_id"), 20, 20).select("query_id", "path", "rank"),
        "path": lambda: lexical.path_match(n, words, 10),
        "passport": lambda: profile.find_local(D.passports(spark, sf), q, 20),
        "spotlight": lambda: top_per(lexical.keyword_prefix(items, words.withColumn("domain", F.lit("src1"))), ["query_id"], [F.asc("path")], 20),
        "bm25": lambda: lexical.bm25(n, q, 20), "lexicalIos": lambda: lexical.bm25(n, q, 20, stemmed=True, skip_empty=True),
    }
    return fusion.hybrid(lanes, 10).select("query_id", "path", "score", F.col("source_mask").cast("int").alias("source_mask"), "rank")


def sister_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Four lanes per note: nearest vectors, links the note's header lists (to notes that have a
    vector), profiles found by the note's name, and its strongest neighbours in the graph."""
    e = _embedded(spark, sf).select("path", "vec", "doc_id")
    near = vector.neighbours(e, "path", "vec", 24).select(F.col("path").alias("query_id"), F.col("neighbour").alias("path"), "rank")
    names = e.select(F.col("path").alias("query_id"), T.stem_name(F.col("path")).alias("query"))
    # Listed links: the next notes by number, resolved by name.
    listed = e.select(F.col("path").alias("query_id"), F.posexplode(F.array(*(F.format_string("[[%d|x]]", F.col("doc_id") + k) for k in (1, 2, 3)))).alias("n", "link"))
    named = listed.withColumn("label", T.wikilinks(F.col("link"))[0])
    to = graph.resolve_labels(named.select("label").distinct(), e)
    linked = named.join(to, "label").where("path is not null and path <> query_id").select("query_id", "path", (F.col("n") + 1).alias("rank"))
    cards = materialised(D.passports(spark, sf).select("path", "concepts", "one_line_summary", "cornell_cue"), "passports")  # the texts are read once
    found = profile.find_by_name(cards, names, 25).where("path <> query_id")
    found = top_per(found.withColumnRenamed("rank", "found"), ["query_id"], [F.asc("found")], 24)
    edges = graph.merge([graph.concept_edges(cards)])
    tied = graph.neighbours_by_dst(edges, top=24).select(F.col("src").alias("query_id"), F.col("dst").alias("path"), "rank")
    lanes = {"semantic": lambda: near, "graph:header": lambda: linked, "passport": lambda: found, "graph:multiplex": lambda: tied}
    return fusion.hybrid(lanes, 12).select("query_id", "path", "score", F.col("source_mask").cast("int").alias("source_mask"), "rank")


def passport_local_find(spark: SparkSession, sf: str) -> DataFrame:
    return profile.find_local(D.passports(spark, sf), D.queries(spark))


def passport_daemon_find(spark: SparkSession, sf: str) -> DataFrame:
    e = _embedded(spark, sf)
    q = _vector_queries(spark, sf).withColumn("query", F.lit("the en thand"))
    return profile.find_by_vector(e.select("path", "vec"), D.passports(spark, sf), q, 10, 0.05).select("query_id", "path", "score", "rank")


def savings_ratio(spark: SparkSession, sf: str) -> DataFrame:
    p = D.passports(spark, sf).select("path", "char_count", F.lit(1).alias("query_id")).withColumn("query_id", F.length("path") % 5)
    return profile.savings(p)


def stems(spark: SparkSession, sf: str) -> DataFrame:
    words = D.notes(spark, sf).select(F.explode(T.tokens(F.col("body"))).alias("token")).distinct()
    return words.select("token", T.stem(F.col("token")).alias("stem")).where("stem is not null")


_COS = "coalesce(list_cosine_similarity({0}, {1}), 0)"
_TOP = "CAST(row_number() OVER (PARTITION BY {0} ORDER BY {1}) AS INTEGER) AS rank"
_HEAD = f"WITH {D.NOTES_SQL}, {D.QUERIES_SQL}"
_SEARCHES = f"searches AS (SELECT CAST(query_id AS INTEGER) AS query_id, query, CAST(embedding AS DOUBLE[]) AS q FROM {D.values_sql(SEARCHES, 'query_id, query, vec_id')} JOIN embeddings USING (vec_id))"
_base, _out = stem_sql("t")
_stem_kept = f"stemmed AS (SELECT path, b, {_out} AS token FROM (SELECT path, {_base} AS b FROM (SELECT path, unnest({TOKENS_SQL.format('body')}) AS t FROM notes)))"
_EVENT_LANES = """lanes AS (
  SELECT user_id AS query_id, event_type || '/' || CAST(event_id % 13 AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, 1 AS mask FROM events
  UNION ALL
  SELECT user_id, event_type || '/' || CAST(event_id % 13 AS VARCHAR), row_number() OVER (PARTITION BY user_id ORDER BY event_id), 32 FROM events
)"""
_SIGN = "list_sum(list_transform(range(0, len(vec)), lambda d: vec[d + 1] * (CASE WHEN xor(d & 1, (d >> 8) & 1) = 0 THEN 1 ELSE -1 END)))"
_SH = f"CASE WHEN {_SIGN} > 0 THEN repeat('5', 32) WHEN {_SIGN} < 0 THEN repeat('a', 32) ELSE repeat('0', 32) END"

_CARDS = r"SELECT path, concat_ws(' ', one_line_summary, array_to_string(cornell_cue, ' '), regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')) AS body FROM passports"
_LOCAL = f"""cards AS ({_CARDS}), {bm25_sql('lr', docs='cards', top=1 << 30)},
      lasked AS (SELECT query_id, list_distinct({TOKENS_SQL.format('query')}) AS q FROM queries),
      lo AS (SELECT query_id, path, CAST(len(list_filter(concepts, lambda c: len(list_filter(q, lambda t: contains(lower(c), t) OR contains(t, lower(c)))) > 0)) AS INTEGER) AS overlap FROM passports, lasked),
      ls AS (SELECT lo.query_id, lo.path, overlap, round(overlap + 0.5 * coalesce(score, 0), 6) AS score FROM lo LEFT JOIN lr ON lo.query_id = lr.query_id AND lo.path = lr.path),
      local_ranked AS (SELECT *, {_TOP.format('query_id', 'score DESC, path')} FROM ls)"""
_CONCEPT_PAIRS = """cc AS (SELECT path, unnest(list_distinct(list_transform(concepts, lambda x: lower(x)))) AS concept FROM passports), cfit AS (SELECT concept FROM cc GROUP BY concept HAVING count(*) BETWEEN 2 AND 100),
      cu AS (SELECT * FROM cc WHERE concept IN (SELECT concept FROM cfit)), cpairs AS (SELECT a.path AS src, b.path AS dst FROM cu a JOIN cu b ON a.concept = b.concept AND a.path <> b.path GROUP BY 1, 2 HAVING count(*) >= 2)"""
_MIXED = "((b * 512 + d + 1) * 1103515245)"
for _shift, _factor in MIX:
    _MIXED = f"(xor(({_MIXED} & 2147483647), (({_MIXED} & 2147483647) >> {_shift})) * {_factor})"

_SIGNED = f"b AS (SELECT path, list_transform(range(0, 128), lambda b: list_sum(list_transform(range(0, len(vec)), lambda d: vec[d + 1] * CASE WHEN ({_MIXED} >> 16) & 1 = 1 THEN 1 ELSE -1 END)) > 0) AS bits FROM vectors), mixed AS (SELECT path, " + " || ".join(f"lpad(lower(to_hex(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN bits[{32 * k} + i + 1] THEN (1::BIGINT << i) ELSE 0 END))::BIGINT)), 8, '0')" for k in range(4)) + " AS sh FROM b)"

QUERIES = {f.__name__: f for f in (
    tokenize_stats, term_df, idf_table, stored_postings, postings_upsert, bm25_topk, bm25_no_dedup, bm25_plain_words, lexical_search, path_match, cosine_neighbors, cosine_search_boost,
    title_body_search, multi_vector_max, image_similar_strict, simhash_compat, simhash_mixed, hamming_filter, signature_radius, mean_pool, rrf_fuse, mmr_diversify, hybrid_query, sister_notes,
    passport_local_find, passport_daemon_find, savings_ratio, stems,
)}

ORACLES = {
    "tokenize_stats": f"WITH {D.NOTES_SQL} SELECT path, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT path, {TOKENS_SQL.format('body')} AS t FROM notes)",
    "term_df": f"WITH {D.NOTES_SQL} SELECT token, count(DISTINCT path) AS df FROM (SELECT path, unnest({TOKENS_SQL.format('body')}) AS token FROM notes) GROUP BY token",
    "idf_table": f"WITH {D.NOTES_SQL}, {_stem_kept}, kept AS (SELECT path, token FROM stemmed WHERE length(token) >= 2), n AS (SELECT count(DISTINCT path) AS n FROM kept) SELECT token, count(DISTINCT path) AS df, round(ln(1 + (n - count(DISTINCT path) + 0.5) / (count(DISTINCT path) + 0.5)), 6) AS idf FROM kept, n GROUP BY token, n",
    "stored_postings": f"WITH {D.NOTES_SQL}, {_stem_kept}, tf AS (SELECT path, token, count(*) AS tf FROM stemmed WHERE length(token) >= 2 GROUP BY ALL), cut AS (SELECT *, sum(tf) OVER (PARTITION BY path) AS dl FROM tf) SELECT path, count(*) AS kept, CAST(sum(tf) AS BIGINT) AS sum_tf, CAST(max(dl) AS BIGINT) AS dl FROM cut GROUP BY path",
    "postings_upsert": f"WITH base AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CASE WHEN doc_id % 10 = 0 THEN lang || ' ' || CAST(doc_id AS VARCHAR) ELSE text END AS body FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 <> 0), notes AS (SELECT * FROM base), {_stem_kept} SELECT path, least(200, count(DISTINCT token)) AS kept FROM stemmed WHERE length(token) >= 2 GROUP BY path",
    "bm25_topk": f"{_HEAD}, {bm25_sql('r')} SELECT query_id, path, score, rank FROM r",
    "bm25_no_dedup": f"{_HEAD}, {bm25_sql('r', dedup=False)} SELECT query_id, path, score, rank FROM r",
    "bm25_plain_words": f"{_HEAD}, {bm25_sql('r', PLAIN_SQL, dedup=False, top=20)} SELECT query_id, path, score, rank FROM r",
    "lexical_search": f"{_HEAD}, {bm25_sql('r', stemmed=True, skip_empty=True)} SELECT query_id, path, score, rank, array_to_string(matched, ',') AS matched FROM r",
    "path_match": f"WITH {D.NOTES_SQL} SELECT * FROM (SELECT CAST(query_id AS INTEGER) AS query_id, path, {_TOP.format('query_id', 'path')} FROM notes JOIN {D.values_sql(PATH_QUERIES, 'query_id, query')} ON contains(lower(path), lower(query))) WHERE rank <= 60",
    "cosine_neighbors": f"WITH {D.VECTORS_SQL}, p AS (SELECT a.path, b.path AS neighbour, round({_COS.format('a.vec', 'b.vec')}, 6) AS score FROM vectors a JOIN vectors b ON a.path <> b.path) SELECT * FROM (SELECT *, {_TOP.format('path', 'score DESC, neighbour')} FROM p) WHERE rank <= 12",
    "cosine_search_boost": f"WITH {D.NOTES_SQL}, {_SEARCHES}, s AS (SELECT query_id, path, round({_COS.format('CAST(embedding AS DOUBLE[])', 'q')} * (1 + 0.5 * CASE WHEN contains(lower(title), lower(query)) THEN 1 ELSE 0 END), 6) AS score FROM notes JOIN embeddings ON doc_id = vec_id, searches WHERE length(query) >= 2) SELECT * FROM (SELECT *, {_TOP.format('query_id', 'score DESC, path')} FROM s WHERE score > 0) WHERE rank <= 30",
    "title_body_search": f"{_HEAD}, w AS (SELECT query_id, translate(lower(split_part(query, ' ', 1)), '{ACCENTED}', '{PLAIN}') AS q FROM queries), s AS (SELECT query_id, path, CASE WHEN contains(lower(title), q) THEN CAST(1 AS DOUBLE) WHEN contains(translate(lower(substring(body, 1, 30000)), '{ACCENTED}', '{PLAIN}'), q) THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM notes, w) SELECT * FROM (SELECT *, {_TOP.format('query_id', 'score DESC, path')} FROM s WHERE score > 0) WHERE rank <= 30",
    "multi_vector_max": f"""WITH {D.VECTORS_SQL}, c AS (
      SELECT CAST(1 AS INTEGER) AS query_id, t.path, CASE WHEN t.path % 4 <> 0 THEN round({_COS.format('t.vec', 'q.vec')}, 6) END AS a, CASE WHEN b.vec IS NOT NULL THEN round({_COS.format('b.vec', 'q.vec')}, 6) END AS b, CASE WHEN s.vec IS NOT NULL THEN round({_COS.format('s.vec', 'q.vec')}, 6) END AS s
      FROM vectors t LEFT JOIN vectors b ON b.path = t.path + 1 LEFT JOIN vectors s ON s.path = t.path + 2, (SELECT vec FROM vectors WHERE path = 5) q)
      SELECT query_id, path, coalesce(greatest(a, b, s), 0) AS score, CASE WHEN a = greatest(a, b, s) THEN 'title' WHEN b = greatest(a, b, s) THEN 'body' WHEN s = greatest(a, b, s) THEN 'summary' END AS source FROM c""",
    "image_similar_strict": f"WITH e AS (SELECT vec_id AS rel, CASE WHEN vec_id % 5 = 4 THEN CAST(embedding AS DOUBLE[])[1:32] ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings), s AS (SELECT a.rel AS probe, b.rel, CASE WHEN len(a.v) = len(b.v) THEN round({_COS.format('a.v', 'b.v')}, 6) ELSE 0 END AS score FROM e a JOIN e b ON a.rel <> b.rel WHERE a.rel < 5) SELECT * FROM (SELECT *, {_TOP.format('probe', 'score DESC, rel')} FROM s) WHERE rank <= 10",
    "simhash_compat": f"WITH {D.VECTORS_SQL} SELECT path, {_SH} AS sh FROM vectors",
    "hamming_filter": f"WITH {D.VECTORS_SQL}, s AS (SELECT path, {_SH} AS sh FROM vectors) SELECT * FROM (SELECT q.path AS query_id, s.path, CAST(0 AS INTEGER) AS distance, {_TOP.format('q.path', 's.path')} FROM s JOIN s q ON s.sh = q.sh WHERE q.path < 3) WHERE rank <= 50",
    "mean_pool": "WITH x AS (SELECT label AS path, unnest(range(1, 65)) AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT path, i, avg(v[i]) AS x FROM x GROUP BY ALL) SELECT path, CAST(count(*) AS BIGINT) AS dims, round(sum(x), 6) AS total FROM m GROUP BY path",
    "rrf_fuse": f"WITH {_EVENT_LANES} SELECT query_id, path, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(bit_or(mask) AS INTEGER) AS source_mask, CASE bit_or(mask) WHEN 1 THEN 'semantic' WHEN 32 THEN 'bm25' ELSE 'semantic,bm25' END AS sources FROM lanes WHERE rank <= 40 GROUP BY query_id, path",
    "hybrid_query": f"""{_HEAD}, {D.PASSPORTS_SQL}, {bm25_sql('b', top=20)}, {bm25_sql('l', stemmed=True, skip_empty=True, top=20)}, {_LOCAL},
      p AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS rank FROM notes JOIN queries ON contains(lower(path), lower(split_part(query, ' ', -1)))),
      e AS (SELECT path, title, CAST(embedding AS DOUBLE[]) AS vec FROM notes JOIN embeddings ON doc_id = vec_id), asked AS (SELECT query_id, query, CAST(embedding AS DOUBLE[]) AS vec FROM queries JOIN embeddings ON vec_id = query_id),
      v AS (SELECT query_id, path, round({_COS.format('e.vec', 'asked.vec')} * (1 + 0.5 * CASE WHEN contains(lower(title), lower(query)) THEN 1 ELSE 0 END), 6) AS s FROM e, asked),
      h AS (SELECT query_id, path FROM (SELECT path, {_SH} AS sh FROM e) JOIN (SELECT query_id, {_SH} AS sh FROM asked) USING (sh)),
      w AS (SELECT path, unnest(regexp_split_to_array(translate(lower(concat_ws(' ', title, body, 'note')), '{ACCENTED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM notes WHERE path LIKE 'src1/%'),
      k AS (SELECT DISTINCT query_id, path FROM w JOIN queries ON starts_with(word, translate(lower(split_part(query, ' ', -1)), '{ACCENTED}', '{PLAIN}'))),
      lanes AS (SELECT query_id, path, rank, 32 AS mask FROM b UNION ALL SELECT query_id, path, rank, 64 FROM l UNION ALL SELECT query_id, path, rank, 2 FROM p UNION ALL SELECT query_id, path, rank, 8 FROM local_ranked
        UNION ALL SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path), 1 FROM v WHERE s > 0 UNION ALL SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path), 128 FROM h
        UNION ALL SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path), 16 FROM k),
      f AS (SELECT query_id, path, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(bit_or(mask) AS INTEGER) AS source_mask FROM lanes WHERE rank <= 20 GROUP BY query_id, path)
      SELECT * FROM (SELECT *, {_TOP.format('query_id', 'score DESC, path')} FROM f) WHERE rank <= 10""",
    "sister_notes": f"""WITH {D.NOTES_SQL}, {D.PASSPORTS_SQL}, e AS (SELECT doc_id, path, CAST(embedding AS DOUBLE[]) AS vec FROM notes JOIN embeddings ON doc_id = vec_id),
      queries AS (SELECT path AS query_id, CAST(doc_id AS VARCHAR) AS query FROM e), cards AS ({_CARDS}), {bm25_sql('r', docs='cards', top=1 << 30)},
      pairs AS (SELECT a.path AS query_id, b.path, round({_COS.format('a.vec', 'b.vec')}, 6) AS s FROM e a JOIN e b ON a.path <> b.path),
      k AS (SELECT CAST(doc_id AS VARCHAR) AS label, min(path) AS path FROM e GROUP BY 1), linked AS (SELECT e.path AS query_id, k.path, n AS rank FROM e, (SELECT unnest([1, 2, 3]) AS n) JOIN k ON k.label = CAST(e.doc_id + n AS VARCHAR)),
      found AS (SELECT query_id, path, round(sum(part), 6) AS s FROM (SELECT query_id, path, 0.5 * score AS part FROM r UNION ALL SELECT query_id, path, 1.0 FROM (SELECT path, unnest(list_distinct(list_transform(concepts, lambda c: lower(c)))) AS token FROM passports) JOIN (SELECT query_id, unnest(list_distinct({TOKENS_SQL.format('query')})) AS token FROM queries) USING (token)) GROUP BY query_id, path),
      f25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path) AS r FROM found QUALIFY r <= 25), {_CONCEPT_PAIRS},
      lanes AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path) AS rank, 1 AS mask FROM pairs UNION ALL SELECT query_id, path, rank, 4 FROM linked
        UNION ALL SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY r), 8 FROM f25 WHERE path <> query_id UNION ALL SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst), 4 FROM cpairs),
      f AS (SELECT query_id, path, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(bit_or(mask) AS INTEGER) AS source_mask FROM lanes WHERE rank <= 24 GROUP BY query_id, path)
      SELECT * FROM (SELECT *, {_TOP.format('query_id', 'score DESC, path')} FROM f) WHERE rank <= 12""",
    "simhash_mixed": f"WITH {D.VECTORS_SQL}, {_SIGNED} SELECT path, sh FROM mixed",
    "signature_radius": f"WITH {D.VECTORS_SQL}, {_SIGNED}, w AS (SELECT path, list_transform(range(0, 4), lambda k: CAST('0x' || substring(sh, CAST(8 * k + 1 AS INTEGER), 8) AS BIGINT)) AS w FROM mixed), s AS (SELECT q.path AS query_id, w.path, CAST(list_sum(list_transform(range(1, 5), lambda k: bit_count(xor(q.w[k], w.w[k])))) AS INTEGER) AS distance FROM w, w q WHERE q.path % 10 = 0) SELECT * FROM (SELECT *, {_TOP.format('query_id', 'distance, path')} FROM s WHERE distance <= 31) WHERE rank <= 50",
    "mmr_diversify": f"""WITH RECURSIVE {_EVENT_LANES},
      f AS (SELECT query_id, path, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(bit_or(mask) AS INTEGER) AS source_mask FROM lanes WHERE rank <= 40 GROUP BY query_id, path),
      best AS (SELECT query_id, max(score) AS top FROM f GROUP BY query_id),
      picks(query_id, rank, c, paths, masks) AS (
        SELECT query_id, 0, NULL::STRUCT(path VARCHAR, score DOUBLE, mask INTEGER), []::VARCHAR[], []::INTEGER[] FROM best
        UNION ALL
        SELECT query_id, rank + 1, c, list_append(paths, c.path), list_append(masks, c.mask) FROM (
          SELECT query_id, rank, paths, masks, first(struct_pack(path := path, score := score, mask := mask) ORDER BY gain DESC, score DESC, path) AS c FROM (
            SELECT k.query_id, k.rank, k.paths, k.masks, f.path, f.score, f.source_mask AS mask,
              0.5 * (f.score / top) - 0.5 * coalesce(list_max(list_transform(k.masks, lambda m: bit_count(m & f.source_mask)::DOUBLE / bit_count(m | f.source_mask))), 0) AS gain
            FROM picks k JOIN f ON f.query_id = k.query_id JOIN best ON best.query_id = k.query_id WHERE k.rank < 10 AND NOT list_contains(k.paths, f.path))
          GROUP BY query_id, rank, paths, masks))
      SELECT query_id, c.path AS path, c.score AS score, c.mask AS source_mask, CAST(rank AS INTEGER) AS rank FROM picks WHERE rank > 0""",
    "passport_local_find": f"""{_HEAD}, {D.PASSPORTS_SQL}, {_LOCAL} SELECT query_id, path, overlap, score, rank FROM local_ranked WHERE rank <= 10""",
    "passport_daemon_find": f"""WITH {D.NOTES_SQL}, {D.PASSPORTS_SQL}, {_SEARCHES},
      n AS (SELECT query_id, path, round({_COS.format('CAST(embedding AS DOUBLE[])', 'q')}, 6) AS cos FROM notes JOIN embeddings ON doc_id = vec_id, searches),
      pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, path) AS r FROM n WHERE cos >= 0.05),
      s AS (SELECT query_id, path, round(cos * (1 + 0.2 * len(list_intersect(list_transform(concepts, lambda c: lower(c)), ['the', 'en', 'thand']))), 6) AS score FROM pool JOIN passports USING (path) WHERE r <= 10)
      SELECT query_id, path, score, {_TOP.format('query_id', 'score DESC, path')} FROM s""",
    "savings_ratio": f"WITH {D.NOTES_SQL}, s AS (SELECT CAST(length(path) % 5 AS INTEGER) AS query_id, CAST(sum(length(body)) AS BIGINT) AS \"full\", count(*) * 500 AS returned FROM notes GROUP BY 1) SELECT query_id, \"full\", returned, round((\"full\" - returned) / CAST(\"full\" AS DOUBLE), 6) AS ratio FROM s",
    "stems": f"WITH w AS (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS t FROM documents) SELECT t AS token, {_out} AS stem FROM (SELECT t, {_base} AS b FROM w)",
}
