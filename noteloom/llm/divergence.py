"""Source divergence audit: how far the word shares of a language's sources lie from each other.

Terms are runs of letters A-Z and of characters from U+0080 on, lower-cased in A-Z only. A language
keeps the terms of at least three of its documents. A group (language, source) gives a kept term
the share p = 1 + floor(10^9 (count + 1) / (N + V)), with N its occurrences of kept terms and V their
number; f(p, q) = floor((p - q)^2 / q). Audited are every pair of sources (f summed over all
kept terms) and every source's terms against the language's own shares.

Pairs: a kept term is a sparse vector of its counts by source. Terms with the same vector are one
vector with a multiplicity, and pairs are evaluated once a distinct vector. Only the sources that
a vector holds are paired there: with z the share of a count of 0,

    sum f(p, q) = V f(z, z') + sum over terms the first holds of f(p, z') - f(z, z')
                             + sum over terms the second holds of f(z, q) - f(z, z')
                             + sum over terms both hold of f(p, q) - f(p, z') - f(z, q) + f(z, z')

The middle two sums depend on a source's count only and are evaluated once a distinct share.
Counts are added up before the only shuffle of terms, so a frequent term or a large source
costs one row a slice of 16 MB of text.

Nulls and edge cases: a null text, language or source is the empty one; a repeated row is a document
of its own; a language without kept terms (V = 0) has pair values of 0 and no term rows; ties rank by
the item's bytes; a source alone in its language has no pair rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.shared import only, parts_for, slices, text_buffers, written
from noteloom.llm.textscan import LOWER
from noteloom.llm.wordruns import encoded, runs, tally

LEAST_DOCUMENTS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
FLUSH_BYTES = 16 << 20
LETTER = np.ones(256, bool)
LETTER[:0x80] = False
LETTER[65:91] = LETTER[97:123] = True
_COUNTED = "lang string, source string, term string, n long, documents long"
#: Sources of all languages up to which their table is sent to every task.
FEW_GROUPS = 100_000


def slice_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, documents) of each slice of about 16 MB of text."""
    for batch in slices(batches, 20_000, FLUSH_BYTES):
        data, offsets = text_buffers(batch.column(2))
        inside = LETTER[data]
        start, end, text = runs(inside, offsets)
        if not len(start):
            continue
        term, words = encoded(LOWER[data[inside]], end - start)
        pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        lang, source = (pairs.field(k).dictionary_encode() for k in (0, 1))
        code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        group, of_text = np.unique(code, return_inverse=True)
        held, n = tally(text * len(words) + term)
        key = of_text[held // len(words)] * len(words) + held % len(words)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        of_group, of_word = np.divmod(key[edge], len(words))
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(group[of_group] // len(source.dictionary))), source.dictionary.take(pa.array(group[of_group] % len(source.dictionary))),
                words.take(pa.array(of_word)).cast(pa.binary()).cast(pa.string()), pa.array(np.add.reduceat(n, edge)), pa.array(np.diff(np.append(edge, len(key)))),
            ],
            ["lang", "source", "term", "n", "documents"],
        )


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n, vector): kept terms with their counts by source, sources ascending."""
    rows = only(documents, "lang", "source", "text").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = parts_for(documents, 8 << 20, rows.sparkSession.sparkContext.defaultParallelism)
    counted = rows.mapInArrow(slice_counts, _COUNTED).repartition(parts, "lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.where(F.col("documents") >= least).select("lang", "term", "n", "vector")


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, in exact decimals; null where nothing is kept."""
    wide = lambda x: x.cast("decimal(20,0)")
    part = F.floor(F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept)))
    return F.when(kept > 0, 1 + part.cast("long"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms that both sources hold add to each pair; a batch's sums by (lang, source, item)."""
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in slices(batches, 20_000, 4 << 20):
        lang = batch.column(0).dictionary_encode()
        of_lang, times = lang.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy()
        lists = batch.column(2)
        flat = lists.flatten()
        source = flat.field(0).dictionary_encode()
        code, p, z = source.indices.to_numpy().astype(np.int64), flat.field(1).to_numpy(), flat.field(2).to_numpy()
        size = np.asarray(lists.value_lengths()).astype(np.int64)
        first, n = np.cumsum(size) - size, len(source.dictionary)
        done, (keys, sums) = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        while done < len(size):  # some vectors at a time, of about a million pairs together
            upto = max(done + 1, done + int(np.searchsorted(np.cumsum(size[done:] ** 2), 1 << 20, "right")))
            own = np.arange(done, upto)
            vector = np.repeat(own, size[own] ** 2)
            place = np.arange(len(vector)) - np.repeat(np.cumsum(size[own] ** 2) - size[own] ** 2, size[own] ** 2)
            a, b = first[vector] + place // size[vector], first[vector] + place % size[vector]
            other = a != b
            vector, a, b = vector[other], a[other], b[other]
            value = times[vector] * (f(p[a], p[b]) - f(p[a], z[b]) - f(z[a], p[b]) + f(z[a], z[b]))
            keys, sums = tally(np.append(keys, (of_lang[vector] * n + code[a]) * n + code[b]), np.append(sums, value))
            done = upto
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(keys // n // n)), source.dictionary.take(pa.array(keys // n % n)), source.dictionary.take(pa.array(keys % n)), pa.array(sums)],
            ["lang", "source", "item", "value"],
        )


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for all pairs, ``term`` for each source's top terms."""
    terms = written(kept_terms(documents, least), "divergence-terms")
    held = terms.select("lang", "term", F.col("n").alias("all_n"), F.inline("vector"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    there = only(documents, "lang", "source").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = there.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = written(groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("kept"))), "divergence-groups", 0)
    few = groups.count() <= FEW_GROUPS
    sent = lambda df: F.broadcast(df) if few else df

    # Terms against the language.
    of_term = held.join(sent(groups), ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    of_term = of_term.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranking = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_term = of_term.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top)

    # Pairs: distinct vectors with their multiplicity, shares filled in.
    distinct = terms.groupBy("lang", "vector").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id())
    distinct = written(distinct, "divergence-vectors")
    entries = distinct.select("id", "lang", "times", F.inline("vector")).join(sent(groups.select("lang", "source", "total", "kept", "none")), ["lang", "source"])
    entries = entries.select("id", "lang", "times", "source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), F.col("none").alias("z"))
    vectors = entries.groupBy("id", "lang", "times").agg(F.collect_list(F.struct("source", "p", "z")).alias("vector")).where(F.size("vector") > 1)
    wide = lambda x: x.cast("decimal(38,0)").alias("value")
    both = vectors.select("lang", "times", "vector").mapInArrow(_pairs, "lang string, source string, item string, value long").select("lang", "source", "item", wide(F.col("value")))
    shares = entries.groupBy("lang", "source", "p", "z").agg(F.sum("times").alias("times"))
    other = groups.where("kept > 0").select("lang", F.col("source").alias("item"), F.col("none").alias("y"))
    one = shares.join(sent(other), "lang").where("source <> item")
    forth = one.select("lang", "source", "item", wide(F.col("times") * (apart(F.col("p"), F.col("y")) - apart(F.col("z"), F.col("y")))))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), wide(F.col("times") * (apart(F.col("y"), F.col("p")) - apart(F.col("y"), F.col("z")))))
    base = groups.join(sent(groups.select("lang", F.col("source").alias("item"), F.col("none").alias("y"))), "lang").where("source <> item")
    base = base.select("lang", "source", "item", wide(F.when(F.col("kept") > 0, F.col("kept") * apart(F.col("none"), F.col("y"))).otherwise(0)))
    pairs = base.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranking))
    return pairs.unionByName(of_term)
