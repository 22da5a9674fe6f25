"""The queries of this subpackage: one a operator, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noteloom.llm import risk_rules
from noteloom.llm.divergence import audit
from noteloom.llm.extendible import shard_documents
from noteloom.llm.jaccard_join import near_duplicates
from noteloom.llm.kn_lm import score_corpus
from noteloom.llm.langid import identify
from noteloom.llm.media import media_documents
from noteloom.llm.packing import pack_documents
from noteloom.llm.piece_sampling import sample_digests
from noteloom.llm.quality_gam import classify
from noteloom.llm.repeats import remove_repeats
from noteloom.llm.spelling import spelling_variants
from noteloom.llm.token_store import read_store, write_store

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    folder, manifest = write_store(documents, WORD_BPE, end_id=1)
    return read_store(documents.select("doc_id"), folder, manifest)


def op3_media_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_documents(table(spark, sf_dir, "documents"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SHARD_LIMIT = 4 << 20


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARD_LIMIT)


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all whole texts of documents, the samples decoded again."""
    return sample_digests(table(spark, sf_dir, "documents"), ["doc_id"], "text", PIECES, k=3)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0, capacity=2048)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_store": op2_token_store,
    "op3_media_documents": op3_media_documents,
    "op4_quality_gam": op4_quality_gam,
    "op5_extendible_sharding": op5_extendible_sharding,
    "op6_risk_controlled_rules": op6_risk_controlled_rules,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_repeats": op13_suffix_repeats,
}


def rules_sql() -> str:
    """The rules, their binomial bounds and the verdicts in DuckDB."""
    share = risk_rules.RISK / len(risk_rules.RULES)
    tests = [(rule, c) for rule, (*_, grid) in risk_rules.RULES.items() for c in grid]

    def rejects(rule: str, cutoff: str) -> str:
        left, factor, right, more, _ = risk_rules.RULES[rule]
        return f"{factor} * {left} {'>' if more else '<'} {cutoff} * {right}"

    def tail(k: str) -> str:
        term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r}))"
        return f"CASE WHEN {k} < n * {share!r} THEN list_sum(list_transform(range(0, {k} + 1), lambda i: {term})) ELSE 1 END"

    seen = ", ".join(f"CAST(count_if({rejects(rule, str(c))}) AS BIGINT) AS {rule}_{c}" for rule, c in tests)
    cutoffs = ", ".join(f"coalesce({', '.join(f'CASE WHEN {tail(f"{rule}_{c}")} <= {risk_rules.DELTA} / (strata * {len(tests)}) THEN {c} END' for c in grid)}) AS {rule}" for rule, (*_, grid) in risk_rules.RULES.items())
    fires = " OR ".join(f"coalesce({rejects(rule, f'cutoffs.{rule}')}, false)" for rule in risk_rules.RULES)
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), placed AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM texts WHERE len(words) > 2
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM placed
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), good AS (
  SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1
), seen AS (
  SELECT lang, count(*) AS n, {seen} FROM based JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang
), cutoffs AS (
  SELECT lang, {cutoffs} FROM seen, (SELECT count(*) AS strata FROM seen)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fires}) AS kept
FROM based LEFT JOIN cutoffs USING (lang)"""


def sharding_sql() -> str:
    """A row's bucket is its shortest address prefix whose rows fit the limit (keys are single rows here)."""
    return f"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS address FROM documents
), prefixes AS (
  SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, address >> (60 - depth) AS prefix FROM sized, range(0, 61) d(depth)
), buckets AS (
  SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY depth, prefix) AS BIGINT) AS shard_bytes FROM prefixes
)
SELECT doc_id, n_bytes, depth, prefix, CAST(0 AS BIGINT) AS part, shard_bytes FROM buckets
WHERE shard_bytes <= {SHARD_LIMIT} OR depth = 60
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""


def divergence_sql() -> str:
    """Every kept term by every source of its language, in plain sums."""

    def p(n: str, total: str) -> str:
        return f"1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + kept)"

    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), found AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), terms AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM found GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), sources AS (SELECT DISTINCT lang, source FROM docs),
languages AS (SELECT lang, count(*)::HUGEINT AS kept, sum(n)::HUGEINT AS lang_total FROM terms GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM found SEMI JOIN terms USING (lang, term) GROUP BY lang, source, term
), totals AS (SELECT lang, source, sum(c)::HUGEINT AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, {p("coalesce(c, 0)", "coalesce(total, 0)")} AS p, {p("n", "lang_total")} AS q
  FROM sources JOIN terms USING (lang) JOIN languages USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200"""


def spelling_sql() -> str:
    """The checksum bit by bit; near words by joins on wildcard strings and deletions; roots by recursion."""
    return r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM runs GROUP BY doc_id, run
), bytes AS (
  SELECT run, times, list_transform(range(1, len(code), 2), lambda i: CAST('0x' || substring(code, CAST(i AS INTEGER), 2) AS BIGINT)) AS bytes FROM counted
), bits AS (
  SELECT run, times, flatten(list_transform(bytes, lambda v: [v & 1, (v >> 1) & 1, (v >> 2) & 1, (v >> 3) & 1, (v >> 4) & 1, (v >> 5) & 1, (v >> 6) & 1, (v >> 7) & 1])) AS bits FROM bytes
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bits), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS h FROM bits
), kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), places AS (
  SELECT word, n, CAST(unnest(range(0, length(word))) AS INTEGER) AS i FROM words
), wild AS (
  SELECT word, n, i, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM places
), cut AS (
  SELECT DISTINCT word, n, a || b AS less FROM wild
), near AS (
  SELECT x.word, y.word AS other, y.n FROM wild x JOIN wild y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.less = words.word
  UNION ALL SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.less = words.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * words.n THEN top END AS form_n,
    CASE WHEN top >= 10 * words.n THEN (SELECT min(other) FROM near WHERE near.word = words.word AND near.n = best.top) END AS form
  FROM words LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT chains.word, formed.word, formed.form FROM chains JOIN formed ON chains.next = formed.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chains WHERE next IS NULL) USING (word)"""


def repeats_sql() -> str:
    """Every window of 400 bytes by itself, in hexadecimal."""
    return """
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT k, i, md5(substring(x, CAST(2 * i + 1 AS INTEGER), 800)) AS h FROM (SELECT k, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM docs)
), repeated AS (
  SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), marked AS (
  SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + 400, true) AS first FROM repeated
), spans AS (
  SELECT k, min(i) AS s, max(i) + 400 AS e FROM (SELECT k, i, count_if(first) OVER (PARTITION BY k ORDER BY i) AS span FROM marked) GROUP BY k, span
), gaps AS (
  SELECT k, s, e, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS kept_from FROM spans
), found AS (
  SELECT k, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substring(x, CAST(2 * kept_from + 1 AS INTEGER), CAST(2 * (s - kept_from) AS INTEGER)), '' ORDER BY s) AS head, max(e) AS tail
  FROM gaps JOIN docs USING (k) GROUP BY k
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(x, CAST(2 * coalesce(tail, 0) + 1 AS INTEGER)))) AS kept_sha256
FROM docs LEFT JOIN found USING (k)"""


ORACLES: dict[str, str] = {"op11_source_divergence": divergence_sql(), "op12_spelling_variants": spelling_sql(), "op13_suffix_repeats": repeats_sql(), "op5_extendible_sharding": sharding_sql(), "op6_risk_controlled_rules": rules_sql()}
