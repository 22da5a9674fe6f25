"""Note profiles: extraction in one projection, and the two profile searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.functions.vectors import cosine
from noteloom.operators.common import materialised, small, top_per
from noteloom.operators.lexical import bm25_scores


def extract(notes: DataFrame, links: DataFrame | None = None, prefix: str = "kb") -> DataFrame:
    """Profiles of notes (path, content, mtime[, extracted_at]).

    ``prefix`` names the header keys that override what is extracted: ``<prefix>_domain``,
    ``<prefix>_summary``, ``<prefix>_cue``, ``<prefix>_cue_summary``, ``<prefix>_note_type``, ``<prefix>_id``.
    Concepts come from tags, aliases, inline tags (30), headings of levels 1 to 3, link targets
    and proper nouns (15): first of each lower-cased form, twelve at most.
    """
    rows = notes.select("path", "content", "mtime", T.body_of(F.col("content")).alias("body"), T.header(F.col("content")).alias("fm"))
    if links is not None:
        out = links.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set(T.stem_name(F.col("dst")))).alias("targets"))
        rows = rows.join(out, "path", "left")
    else:
        rows = rows.withColumn("targets", T.wikilinks(F.col("body")))
    field = lambda key: F.col("fm")[F.lit(key)]
    one = lambda *keys: F.coalesce(*(F.get(field(k), F.lit(0)) for k in keys))
    none = F.array().cast("array<string>")
    top = F.filter(T.headings(F.col("body")), lambda h: h["level"] <= 3)
    bag = F.concat(
        F.transform(T.as_list(field("tags")), lambda t: F.regexp_replace(t, "^#", "")), T.as_list(field("aliases")), F.slice(T.inline_tags(F.col("body")), 1, 30),
        F.transform(top, lambda h: h["heading"]), F.coalesce("targets", none), T.proper_nouns(F.col("body")),
    )
    rows = rows.withColumn("char_count", F.length("content").cast("long")).withColumn("concepts", T.unique_folded(bag, 2, 12))
    given = T.as_list(field(f"{prefix}_domain"))
    rows = rows.withColumn("one_line_summary", T.one_line_summary(F.col("body"), one(f"{prefix}_summary")))
    return rows.select(
        "path", "char_count", "concepts",
        F.when(F.size(given) > 0, given).otherwise(T.domain_of(F.col("path"))).alias("domain"),
        T.difficulty(F.col("char_count")).alias("difficulty"), "one_line_summary",
        T.cues(F.col("body"), F.col("concepts"), F.coalesce(field(f"{prefix}_cue"), field("cornell_cue"))).alias("cornell_cue"),
        T.cue_summary(F.col("body"), F.col("one_line_summary"), one(f"{prefix}_cue_summary", "cornell_summary")).alias("cornell_summary"),
        T.note_type(F.col("body"), F.col("path"), F.col("char_count"), F.size("concepts"), F.col("fm"), one(f"{prefix}_note_type", "note_type", "zettel_type")).alias("note_type"),
        T.note_id(F.col("mtime"), one(f"{prefix}_id", "zettel_id")).alias("zettel_id"),
        T.atomic_splits(F.col("body")).alias("atomic_splits"),
        F.sha2(F.col("content"), 256).alias("sha"), F.lit("local").alias("source"),
    )


def with_concepts(passports: DataFrame, concepts: list[str] | None) -> DataFrame:
    """Profiles with at least one of the concepts, whatever their case; all where none are asked for."""
    if not concepts:
        return passports
    asked = F.array(*(F.lit(c.lower()) for c in concepts))
    return passports.where(F.arrays_overlap(F.transform("concepts", F.lower), asked))


def _parts(text: Column, lengths: list[int] | None = None) -> Column:
    """Distinct substrings of a text, of the given lengths or all."""
    n = F.length(text)
    starts = lambda size: F.when(size <= n, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(text, i, size)))
    sizes = F.sequence(F.lit(1), n) if lengths is None else F.array(*map(F.lit, lengths)).cast("array<int>")
    return F.array_distinct(F.flatten(F.filter(F.transform(sizes, starts), lambda x: x.isNotNull())))


def held_either_way(concepts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(concept, token) of all distinct ones of which one holds the other: an equal substring joins them, the
    concepts' only of lengths that tokens have."""
    lengths = sorted(r[0] for r in tokens.select(F.length("token")).distinct().collect())
    if not lengths:
        return concepts.select("concept", F.lit("").alias("token")).where("false")
    within = concepts.select("concept", F.explode(_parts(F.col("concept"), lengths)).alias("token")).join(small(tokens), "token")
    around = tokens.select("token", F.explode(_parts(F.col("token"))).alias("concept")).join(concepts, "concept")
    return within.select("concept", "token").unionByName(around.select("concept", "token")).distinct()


def find_local(passports: DataFrame, queries: DataFrame, top: int = 10, min_score: float = 0.0, concepts: list[str] | None = None) -> DataFrame:
    """(query_id, path, overlap, score, rank): concept overlap + half the BM25 of summary, cues and name.

    A concept counts once if it equals, holds or is held by some query token; both parts come from
    inverted indexes. Rows at ``min_score`` stay: where it is 0 and fewer than ``top`` profiles score,
    the first others by path fill the list. BM25 statistics are those of all profiles, ``concepts`` only
    filters what is ranked.
    """
    card = F.concat_ws(" ", "one_line_summary", F.array_join("cornell_cue", " "), T.stem_name(F.col("path")))
    cards = materialised(passports.select("path", card.alias("body"), "concepts"), "cards")
    fit = with_concepts(cards, concepts)
    asked = materialised(queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token")), "asked")
    index = materialised(fit.select("path", F.explode(F.transform("concepts", F.lower)).alias("concept")), "concept-index")
    met = held_either_way(index.select("concept").distinct(), asked.select("token").distinct())
    wanted = asked.join(met, "token").select("query_id", "concept").distinct()
    overlap = index.join(small(wanted), "concept").groupBy("query_id", "path").agg(F.count("*").cast("int").alias("overlap")).select("query_id", "path", "overlap", F.lit(0.0).alias("part"))
    ranked = bm25_scores(cards, queries).select("query_id", "path", F.lit(0).alias("overlap"), (0.5 * F.col("score")).alias("part"))
    ranked = ranked.join(fit.select("path"), "path", "left_semi").select(*overlap.columns) if concepts else ranked
    scored = overlap.unionByName(ranked).groupBy("query_id", "path").agg(F.sum("overlap").cast("int").alias("overlap"), F.sum("part").alias("part"))
    scored = scored.select("query_id", "path", "overlap", F.round(F.col("overlap") + F.col("part"), 6).alias("score")).where(F.col("score") >= min_score)
    best = [F.desc("score"), F.asc("path")]
    if min_score > 0:
        return top_per(scored, ["query_id"], best, top)
    scored = materialised(top_per(scored, ["query_id"], best, top).drop("rank"), "scored")
    # Of the first 2 top - 1 paths at least ``top`` don't score for a query whose list is short.
    lead = fit.select("path").orderBy("path").limit(2 * top)
    short = asked.select("query_id").distinct().join(scored.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < top).select("query_id")
    zero = short.crossJoin(F.broadcast(lead)).join(scored.select("query_id", "path"), ["query_id", "path"], "left_anti").select("query_id", "path", F.lit(0).alias("overlap"), F.lit(0.0).alias("score"))
    return top_per(scored.unionByName(zero), ["query_id"], best, top)


def find_by_name(passports: DataFrame, names: DataFrame, top: int = 10) -> DataFrame:
    """Profiles for very many short queries (query_id, query), by inverted indexes only: concepts
    equal to a token of the query + half the BM25 of the card, positive scores only."""
    card = F.concat_ws(" ", "one_line_summary", F.array_join("cornell_cue", " "), T.stem_name(F.col("path")))
    cards = materialised(passports.select("path", card.alias("body"), "concepts"), "cards")
    ranked = bm25_scores(cards, names).select("query_id", "path", F.lit(0).alias("overlap"), (0.5 * F.col("score")).alias("part"))
    tokens = names.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token"))
    held = cards.select("path", F.explode(F.array_distinct(F.transform("concepts", F.lower))).alias("token"))
    equal = held.join(small(tokens), "token").select("query_id", "path", F.lit(1).alias("overlap"), F.lit(0.0).alias("part"))
    scored = ranked.unionByName(equal).groupBy("query_id", "path").agg(F.round(F.sum("overlap") + F.sum("part"), 6).alias("score"))
    return top_per(scored, ["query_id"], [F.desc("score"), F.asc("path")], top)


def find_by_vector(vectors: DataFrame, passports: DataFrame, queries: DataFrame, top: int = 10, min_score: float = 0.3) -> DataFrame:
    """Cosine at ``min_score`` or above, best 2 top of them, profiles joined, first ``top`` in cosine
    order, then re-ordered by cos * (1 + 0.2 * concepts equal to a query word)."""
    asked = small(queries.select("query_id", "query", F.col("vec").alias("q_vec")))
    near = vectors.crossJoin(asked).select("query_id", "path", F.round(cosine(F.col("vec"), F.col("q_vec")), 6).alias("cos"), F.split(F.lower("query"), r"\s+").alias("q")).where(F.col("cos") >= min_score)
    pool = top_per(near, ["query_id"], [F.desc("cos"), F.asc("path")], 2 * top, "pool_rank")
    cards = top_per(pool.join(passports.select("path", "concepts", "char_count"), "path"), ["query_id"], [F.asc("pool_rank")], top, "card")
    overlap = F.size(F.array_intersect(F.transform("concepts", F.lower), "q"))
    scored = cards.select("query_id", "path", "char_count", F.round(F.col("cos") * (1.0 + 0.2 * overlap), 6).alias("score"))
    return top_per(scored, ["query_id"], [F.desc("score"), F.asc("path")], top)


def savings(found: DataFrame, card_chars: int = 500) -> DataFrame:
    """(query_id, full, returned, ratio): characters of the notes against those of their cards."""
    got = found.groupBy("query_id").agg(F.sum("char_count").alias("full"), (F.count("*") * card_chars).alias("returned"))
    return got.withColumn("ratio", F.round(F.when(F.col("full") > 0, (F.col("full") - F.col("returned")) / F.col("full")).otherwise(0.0), 6))


def by_domain(passports: DataFrame) -> DataFrame:
    return passports.select(F.explode_outer("domain").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def by_difficulty(passports: DataFrame) -> DataFrame:
    return passports.groupBy(F.coalesce(F.col("difficulty").cast("string"), F.lit("?")).alias("difficulty")).agg(F.count("*").alias("n"))


def keyword_items(files: DataFrame, passports: DataFrame, most: int = 25) -> DataFrame:
    """(path, title, summary, keywords, modality): files with or without a profile."""
    both = files.select("path").join(passports.select("path", "concepts", "domain", "one_line_summary"), "path", "left")
    none = F.array().cast("array<string>")
    return both.select("path", T.stem_name(F.col("path")).alias("title"), F.coalesce("one_line_summary", F.lit("")).alias("summary"), T.unique_folded(F.concat(F.coalesce("concepts", none), F.coalesce("domain", none)), 2, most).alias("keywords"), F.lit("md").alias("modality"))


def keyword_average(items: DataFrame) -> DataFrame:
    """One row: items, and their keywords on average (0 without items)."""
    return items.agg(F.count("*").alias("items"), F.round(F.coalesce(F.avg(F.size("keywords")), F.lit(0.0)), 1).alias("average"))
