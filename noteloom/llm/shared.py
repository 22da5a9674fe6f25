"""Places and small helpers that the operators of this subpackage share.

Whatever outlives one job goes below the folder that the cluster names in
``spark.checkpoint.dir``; driver and executors all see it, so a lost executor costs a
recomputation and never a file.
"""

from __future__ import annotations

import ctypes
import gc
import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local session (tests) may leave it
    unset and gets a temporary one; on a cluster other machines could not see that, so it raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_noteloom_root", None)
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = sc._noteloom_root = "file://" + tempfile.mkdtemp(prefix="noteloom-shared-")
    return root.rstrip("/")


#: What operators keep in a worker between tasks (encoders, mapped arrays, lattices).
KEPT: list[dict] = []


def trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def let_go() -> None:
    """Drop what earlier operators kept in this worker; for tasks that need none of it."""
    for kept in KEPT:
        kept.clear()
    gc.collect()
    trim()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/noteloom/{name}-{uuid.uuid4().hex}"


#: Rows of a narrow table (a few numbers a row) for one file.
FILE_ROWS = 250_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage
    with files that survive the loss of executors. ``discard`` deletes them once they have served.
    Where about how many ``rows`` a narrow table has is known, small ones get few files."""
    path = new_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written``; for those that nothing reads any more, neither a plan still to run."""
    for table in tables:
        jvm, sc = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, *parts: bytes) -> None:
    """Write under a name of this attempt, then rename: a retried task replaces its own file whole."""
    store, path = open_fs(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    store.move(attempt, path)


def map_file(uri: str) -> np.ndarray:
    """The file's bytes: memory-mapped where the folder is mounted, else read once."""
    store, path = open_fs(uri)
    if isinstance(store, pafs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return np.zeros(0, np.uint8)
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def input_bytes(df: DataFrame) -> int:
    """Size of what ``df`` is made from: its leaves' sizes as Catalyst knows them from files or local
    rows (no job runs). Where a leaf's size is unknown (an RDD, a cache not yet filled), ``df`` is measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(known, default=0) < 1 << 60:
        return sum(known)
    wide = [F.octet_length(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema]
    return df.agg(F.sum(sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(16)))).first()[0] or 0


def parts_for(df: DataFrame, bytes_each: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many parts keep each near ``bytes_each`` of the input; grows with the input."""
    return int(min(most, max(least, -(-input_bytes(df) // bytes_each))))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever further ones the table has."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying its text; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 48 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches to ``rows`` rows and about ``size`` bytes each; a longer row stands alone."""
    for batch in batches:
        todo = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift rounds) so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
