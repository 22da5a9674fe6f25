"""Seams for models: any column function can stand in, results are kept by path and content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.misc import long_enough
from noteloom.functions.text import json_object

ENRICHED = "links array<string>, tags array<string>, connections array<string>"
#: Both shapes that extraction models answer with.
GRAPH = "nodes array<struct<id:string,label:string>>, edges array<struct<source:string,target:string,label:string>>, entities array<string>, relations array<struct<source:string,target:string,type:string>>"


def cached(notes: DataFrame, cache: DataFrame, model: Callable[[Column], Column], long_model: Callable[[Column], Column] | None = None, large: int = 10_000) -> DataFrame:
    """(path, sha, answer, fresh): the stored answer of the same content, failures (null) included,
    else the model's; contents over ``large`` bytes go to ``long_model``."""
    both = notes.join(cache.select("path", "sha", F.col("answer").alias("stored"), F.lit(True).alias("known")), ["path", "sha"], "left")
    new = model(F.col("content")) if long_model is None else F.when(F.octet_length("content") > large, long_model(F.col("content"))).otherwise(model(F.col("content")))
    known = F.coalesce("known", F.lit(False))
    return both.select("path", "sha", F.when(known, F.col("stored")).otherwise(new).alias("answer"), (~known).alias("fresh"))


def parsed(answers: DataFrame, schema: str = ENRICHED) -> DataFrame:
    """(path, result): model answers as structs, null where they hold no valid object."""
    return answers.select("path", json_object(F.col("answer"), schema).alias("result"))


def entity_edges(answers: DataFrame) -> DataFrame:
    """(path, src, dst, kind) from either shape of an extracted entity graph."""
    rows = parsed(answers, GRAPH)
    none = F.array().cast("array<struct<source:string,target:string,label:string>>")
    own = F.coalesce(F.col("result.edges"), none)
    other = F.transform(F.coalesce(F.col("result.relations"), F.array().cast("array<struct<source:string,target:string,type:string>>")), lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["type"].alias("label")))
    return rows.select("path", F.explode(F.concat(own, other)).alias("e")).select("path", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.label").alias("kind"))


def sweep_stats(swept: DataFrame, done: DataFrame) -> DataFrame:
    """One row: leases claimed and skipped, profiles extracted, errors (claimed but not done)."""
    got = swept.join(done.select(F.col("path").alias("note_path")).distinct().withColumn("ok", F.lit(True)), "note_path", "left")
    return got.agg(F.count_if("granted").alias("claimed"), F.count_if(~F.col("granted")).alias("skipped"), F.count_if(F.col("granted") & F.col("ok").isNotNull()).alias("extracted"), F.count_if(F.col("granted") & F.col("ok").isNull()).alias("errors"))


def mean_sentiment(parts: DataFrame) -> DataFrame:
    """(path, score, label): mean of a note's parts; beyond 0.2 either way it has a label."""
    from noteloom.operators.upkeep import sentiment_label

    mean = parts.groupBy("path").agg(F.round(F.avg("score"), 6).alias("score"))
    return mean.withColumn("label", sentiment_label(F.col("score")))


def expanded(queries: DataFrame, cache: DataFrame, expand: Callable[[Column], Column]) -> DataFrame:
    """(query_id, query, text, fresh): what is embedded for a query: a hypothetical answer, kept by the
    query's text; the query itself where the model gives nothing."""
    known = queries.join(cache.select("query", F.col("text").alias("stored")), "query", "left")
    made = F.trim(F.coalesce(F.col("stored"), expand(F.col("query"))))
    return known.select("query_id", "query", F.when(F.coalesce(made, F.lit("")) != "", made).otherwise(F.col("query")).alias("text"), F.col("stored").isNull().alias("fresh"))


def prompted(rows: DataFrame, instruction: str, model: Callable[[Column], Column], text: str = "content") -> DataFrame:
    """(path, answer): a model's trimmed answer to ``instruction`` followed by the text; null if blank.
    Summaries, free prompts and an agent's single steps are this with another instruction."""
    return rows.select("path", F.nullif(F.trim(model(F.concat(F.lit(instruction + "\n\n"), F.col(text)))), F.lit("")).alias("answer"))


def classified(rows: DataFrame, labels: list[str], model: Callable[[Column], Column], text: str = "content") -> DataFrame:
    """(path, label): the first of ``labels`` that the model's answer holds, whatever its case; null if none."""
    answer = F.lower(model(F.col(text)))
    return rows.select("path", F.coalesce(*(F.when(answer.contains(name.lower()), F.lit(name)) for name in labels)).alias("label"))


def refined(rows: DataFrame, drafts: DataFrame, model: Callable[[Column, Column], Column], rounds: int = 1) -> DataFrame:
    """(path, answer): drafts revised against their texts, ``rounds`` times; a blank revision keeps the draft."""
    out = rows.join(drafts.select("path", F.col("answer").alias("draft")), "path", "left")
    for _ in range(rounds):
        better = F.trim(model(F.col("content"), F.col("draft")))
        out = out.withColumn("draft", F.when(F.coalesce(better, F.lit("")) != "", better).otherwise(F.col("draft")))
    return out.select("path", F.col("draft").alias("answer"))


def transcribed(recordings: DataFrame, transcripts: DataFrame, least: float = 3.0) -> DataFrame:
    """(path, seconds, text): the transcripts (an input table) of recordings long enough to hold speech."""
    return recordings.where(long_enough(F.col("seconds"), least)).join(transcripts.select("path", "text"), "path", "left").select("path", "seconds", "text")


def annotated(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Notes with a model's annotations (translation, tags, sentiment, language: an input table) of the
    same content; the sentiment also as a label. Stale ones are left out."""
    from noteloom.operators.upkeep import sentiment_label

    got = notes.select("path", "sha").join(annotations, ["path", "sha"], "left")
    return got.withColumn("sentiment_label", F.when(F.col("sentiment").isNotNull(), sentiment_label(F.col("sentiment"))))


def profiles(extracted: DataFrame, answered: DataFrame) -> DataFrame:
    """Profiles a model answered for where there are any of the same content, else those extracted
    by rule; ``source`` tells which."""
    names = [c for c in extracted.columns if c != "source"]
    own = extracted.alias("l").join(answered.select(*names).alias("m"), F.col("l.path").eqNullSafe(F.col("m.path")) & F.col("l.sha").eqNullSafe(F.col("m.sha")), "left")
    have = F.col("m.path").isNotNull()
    return own.select(*(F.when(have, F.col(f"m.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in names), F.when(have, "model").otherwise("local").alias("source"))
