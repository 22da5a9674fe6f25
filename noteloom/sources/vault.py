"""Reading a folder of notes, JSON-lines artefacts and example packs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.functions import text as T

#: Extensions by modality.
TEXT, IMAGE, AUDIO = ("md",), ("png", "jpg", "jpeg", "heic", "webp", "gif", "tiff"), ("m4a", "mp3", "wav", "aac", "flac", "ogg")

#: Partitions of small files to one task.
SCANNED = 16


def excluded(path: Column, names: tuple[str, ...] = ()) -> Column:
    """Whether some segment of a path is hidden or named in ``names``."""
    skip = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return F.exists(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: s.startswith(".") | F.array_contains(skip, s))


def _relative(root: str) -> Column:
    plain = root.removeprefix("file:").rstrip("/")
    plain = "/" + plain.lstrip("/") if root.startswith(("file:", "/")) else plain
    return F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:/+", "/"), "^" + plain.replace(".", r"\.") + "/", "")


def _fewer(rows: DataFrame) -> DataFrame:
    """A scan puts some 32 small files in a partition; a task takes up to ``SCANNED`` of those one after another."""
    n, least = rows.rdd.getNumPartitions(), 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(least, -(-n // SCANNED))) if n > least else rows


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT + IMAGE + AUDIO + ("pdf",), skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, ext, mtime, size) of all enabled files below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_relative(root).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return _fewer(found.withColumn("ext", T.extension(F.col("path"))).where(F.col("ext").isin(*extensions) & ~excluded(F.col("path"), skip)).select("path", "ext", "mtime", "size"))


def notes(spark: SparkSession, root: str, skip: tuple[str, ...] = (), most_bytes: int = 200_000, most_body: int = 50_000) -> DataFrame:
    """(path, title, content, body, mtime, sha) of the Markdown notes; larger ones are skipped, bytes
    that aren't UTF-8 become replacement characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).where(F.col("length") <= most_bytes)
    rows = rows.select(_relative(root).alias("path"), F.col("modificationTime").alias("mtime"), F.try_validate_utf8(F.col("content").cast("string")).alias("ok"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    rows = rows.where(~excluded(F.col("path"), skip))
    return _fewer(rows.select("path", T.stem_name(F.col("path")).alias("title"), "content", F.substring(T.body_of(F.col("content")), 1, most_body).alias("body"), "mtime", F.sha2("content", 256).alias("sha")))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """Rows of a JSON-lines artefact: malformed lines are skipped, the last line of a key wins."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    placed = rows.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    last = placed.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_at").alias("_r"))
    return last.where(F.col(key).isNotNull()).select("_r.*")


def example_packs(spark: SparkSession, path: str) -> DataFrame:
    """(task, captured_from, input, output) of pretty-printed example packs."""
    schema = "task string, captured_from string, captured_at string, examples array<struct<input:string,output:string,instructions:string,style:string>>"
    packs = spark.read.schema(schema).option("multiLine", True).json(path)
    return packs.select("task", "captured_from", F.explode("examples").alias("e")).select("task", "captured_from", "e.input", "e.output")


def content(notes: DataFrame, paths: DataFrame, most: int = 50_000) -> DataFrame:
    """(path, content, full_chars, truncated, header) of the asked notes."""
    got = notes.join(paths.select("path").distinct(), "path", "left_semi")
    return got.select("path", F.substring("content", 1, most).alias("content"), F.length("content").alias("full_chars"), (F.length("content") > most).alias("truncated"), T.header(F.col("content")).alias("header"))


def valid_result(path: Column) -> Column:
    """Whether a path from outside is a note of this folder."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & path.endswith(".md")


def metadata(probe: Column, names: list[str]) -> Column:
    """Selected ``name = value`` lines of a metadata dump as a map."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.nullif(F.trim(F.regexp_extract(probe, rf"(?m)^{n}\s*=\s*\"?([^\"\n]*)\"?$", 1)), F.lit("")) for n in names)))


def write_notes(rows: DataFrame, root: str) -> int:
    """Write (path, content) as files below a folder that all machines share; the number written.
    Each file is written under another name and then renamed, so a repeated task replaces it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, name = f"{base}/{path}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write((content or "").encode())
                store.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def modality(ext: Column) -> Column:
    """Which reader a file needs: text, image, audio or pdf; null for others."""
    return F.when(ext.isin(*TEXT), "text").when(ext.isin(*IMAGE), "image").when(ext.isin(*AUDIO), "audio").when(ext == "pdf", "pdf")


def read_key(path: Column, mtime: Column) -> Column:
    """Key of a cached reading: a file that changed is read again."""
    return F.sha2(F.concat(path, F.lit(":"), mtime.cast("string")), 256)


def readings(files: DataFrame, notes: DataFrame, observed: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, modality, text, fresh): notes by their body; images and PDFs by a cached reading of the
    same path and time, else by what was ``observed`` (path, ocr, labels, faces: an input table from
    any reader); audio by the observed text. Files that nobody read have a null text."""
    rows = files.select("path", modality(F.col("ext")).alias("modality"), read_key(F.col("path"), F.col("mtime")).alias("read_key"))
    rows = rows.join(notes.select("path", "body"), "path", "left").join(observed, "path", "left").join(cache.select("read_key", F.col("text").alias("known")), "read_key", "left")
    shown = F.when(F.col("ocr").isNotNull() | (F.size("labels") > 0), T.image_text(T.base_name(F.col("path")), F.col("ocr"), F.col("labels"), F.coalesce("faces", F.lit(0))))
    new = F.when(F.col("modality") == "text", F.col("body")).when(F.col("modality") == "image", shown).otherwise(F.col("ocr"))
    cached = F.col("known").isNotNull() & F.col("modality").isin("image", "pdf")
    return rows.select("path", "modality", F.when(cached, F.col("known")).otherwise(new).alias("text"), (~cached).alias("fresh"))
