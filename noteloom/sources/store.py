"""Artefact tables: atomic rewrites, manifests, the keyword index by domain, captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions.hashing import djb2


def rewrite(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace an artefact whole; the commit protocol publishes it at the end."""
    df.write.mode("overwrite").format(form).save(path)


def merged_manifest(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Manifest rows by path: those of ``changes`` replace the stored ones."""
    return stored.join(changes.select("path"), "path", "left_anti").unionByName(changes)


def domain_key(namespace: str, root: str, spark: SparkSession) -> str:
    return namespace + "." + spark.range(1).select(djb2(F.lit(root)).alias("k")).first()["k"].lstrip("0")


def write_keywords(items: DataFrame, path: str) -> None:
    """Replace the partitions of the domains in ``items`` (they carry a ``domain`` column)."""
    items.repartition("domain").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)


def purge_keywords(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """The index without a domain, to be written to a new place."""
    return spark.read.parquet(path).where(F.col("domain") != domain)


def append_captures(captures: DataFrame, path: str, enabled: bool, provider: str | None = None) -> None:
    """Append-only and opt-in; with ``provider`` only its rows."""
    if enabled:
        (captures.where(F.col("provider") == provider) if provider else captures).write.mode("append").json(path)


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def append_vectors(rows: DataFrame, path: str) -> None:
    """Add embeddings (path, sha, vec, at) to an index; an earlier row of a path stays until ``compacted``."""
    rows.write.mode("append").parquet(path)


def compacted(spark: SparkSession, path: str, target: str) -> DataFrame:
    """The latest row of every path, written to a new place (published whole) and read back."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "at").alias("r")).select("r.*")
    rewrite(last, target)
    return spark.read.parquet(target)


def queue_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, size) of the JSON files of a queue folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(root)
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))
