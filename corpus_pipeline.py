"""Corpus pipeline (part of noteloom.llm): stages applied in turn to ``documents``.

Quality classifier, language identification, near duplicates, packing. Every stage works on all
rows that the one before kept, and rows it rejects are gone afterwards. Nulls, empty texts,
repeated rows and empty tables are handled as the operators' own modules say; the
near-duplicate stage judges rows, not keys: rows with a null or repeated doc_id count each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.jaccard_join import near_duplicates
from noteloom.llm.langid import fit_languages, has_letter
from noteloom.llm.packing import pack_documents
from noteloom.llm.quality_gam import MAX_FIT_ROWS, feature_table, fit_quality, held_out
from noteloom.llm.shared import let_go, slices, written
from noteloom.llm.text_features import features

THRESHOLD = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text ``keep`` accepts, in one pass and without a shuffle."""
    docs = docs.select(*COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, 1000, 8 << 20):
            yield batch.filter(pa.array(keep(batch.column(1)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier scores at the threshold or above (fit on a bounded labelled sample)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id").distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_ROWS)
    labelled = docs.join(F.broadcast(some), "doc_id", "left_semi")  # MAX_FIT_ROWS keys at most
    model = spark.sparkContext.broadcast(fit_quality(feature_table(labelled), labels))
    return filtered(docs, lambda texts: model.value.scores(features(texts)) >= THRESHOLD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language the model accepts; a missing lang isn't invented."""
    model = spark.sparkContext.broadcast(fit_languages(docs))

    def keep(texts: pa.Array) -> np.ndarray:
        m = model.value
        if m is None:
            return np.zeros(len(texts), bool)
        return has_letter(texts) & (m.probabilities(m.logits(texts)).max(axis=1, initial=0) >= m.threshold)

    return filtered(docs, keep)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked ones: the smallest (doc_id, nulls last, text hash).

    Rows are told apart by doc_id and text hash, and go to their group by what their text holds,
    whatever their doc_id. Texts without words are linked to nothing; of such rows only exact
    repeats of a doc_id and a text are one, so those with a null doc_id all stay.
    """
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    found = near_duplicates(rows.select("doc_id", "text", "text_hash"), ("text_hash",))
    kinds = found.groupBy("doc_id", "text_hash", "class_id").agg(F.count("*").alias("copies"))
    empty = F.col("class_id").isNull()
    group = (F.col("class_id"), F.when(empty, F.col("doc_id")), F.when(empty, F.col("text_hash")))
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies"))
    first = kinds.groupBy(*(x.alias(f"g{i}") for i, x in enumerate(group))).agg(chosen.alias("c"))
    # Non-null join keys; every row of a null doc_id without words is its own.
    once = (F.col("c.copies") == 1) | (F.col("g0").isNull() & F.col("c.none"))
    first = written(first.select(F.col("c.none").alias("k0"), F.coalesce("c.doc_id", F.lit(0)).alias("k1"), F.col("c.text_hash").alias("k2"), once.alias("once")), "chosen", docs.count())
    keyed = rows.withColumns({"k0": F.col("doc_id").isNull(), "k1": F.coalesce("doc_id", F.lit(0)), "k2": F.col("text_hash")})
    keys = ["k0", "k1", "k2"]
    kept = keyed.join(first.where("once"), keys, "left_semi").select(*COLUMNS)
    if first.where("not once").isEmpty():
        return kept
    repeated = keyed.join(first.where("not once"), keys, "left_semi").dropDuplicates(keys)
    return kept.unionByName(repeated.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their sequence and offset."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("quality", quality), ("language", language), ("duplicates", duplicates), ("packing", packing)]
#: The fitted models have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
