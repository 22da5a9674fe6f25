"""Vector search: one query or many against all rows; signatures; embeddings."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.functions.vectors import BITS, MIX, cosine, hamming
from noteloom.operators.clusters import neighbours, similar_pairs, unit  # noqa: F401  part of this module's operators
from noteloom.operators.common import materialised, small, top_per

def search(notes: DataFrame, queries: DataFrame, top: int = 30) -> DataFrame:
    """cos * (1 + half if the folded title holds the folded query), positive scores only; queries
    below two characters find nothing. Without a query vector the title counts 1, the body half."""
    asked = small(queries.where(F.length("query") >= 2).select("query_id", "query", F.col("vec").alias("q_vec")))
    q = T.fold(F.col("query"))
    in_title = T.fold(F.col("title")).contains(q)
    plain = F.when(in_title, 1.0)
    if not asked.where("q_vec is null").isEmpty():  # else no body is read
        plain = plain.when(T.fold(F.substring("body", 1, 30_000)).contains(q), 0.5)
    exact = F.when(in_title, 1.0).otherwise(0.0)
    score = F.when(F.col("q_vec").isNotNull(), cosine(F.col("vec"), F.col("q_vec")) * (1.0 + 0.5 * exact)).otherwise(plain.otherwise(0.0))
    hits = notes.crossJoin(asked).select("query_id", "path", F.round(score, 6).alias("score")).where("score > 0")
    return top_per(hits, ["query_id"], [F.desc("score"), F.asc("path")], top)


def multi_vector(rows: DataFrame, query: DataFrame) -> DataFrame:
    """Best of title, body and summary cosine per row and which it was; the first maximum wins,
    (0, null) without any vector."""
    asked = small(query.select("query_id", F.col("vec").alias("q")))
    names = ("title", "body", "summary")
    both = rows.crossJoin(asked)
    for name in names:
        both = both.withColumn(f"c_{name}", F.when(F.col(f"{name}_vec").isNotNull(), F.round(cosine(F.col(f"{name}_vec"), F.col("q")), 6)))
    best = F.greatest(*(F.col(f"c_{n}") for n in names))
    source = F.coalesce(*(F.when(F.col(f"c_{n}") == best, F.lit(n)) for n in names))
    return both.select("query_id", "path", F.coalesce(best, F.lit(0.0)).alias("score"), source.alias("source"))


def similar_images(images: DataFrame, probe: DataFrame, k: int = 10) -> DataFrame:
    """The k images most like each probe (strict dimensions, itself left out)."""
    asked = small(probe.select(F.col("rel").alias("probe"), F.col("vector").alias("q")))
    hits = images.crossJoin(asked).where("rel <> probe").select("probe", "rel", F.round(cosine(F.col("vector"), F.col("q"), "strict"), 6).alias("score"))
    return top_per(hits, ["probe"], [F.desc("score"), F.asc("rel")], k)


def signed(vectors: DataFrame, key: str, vec: str, dims: int = 512) -> DataFrame:
    """(path, sh): ``signature`` of the mixed projection, a batch at a time; the sums add up in the same order."""
    kind = dict(vectors.dtypes)[key]
    number = np.arange(BITS, dtype=np.int64)[:, None] * 512 + np.arange(dims) + 1
    mixed = number * 1103515245
    for shift, factor in MIX:
        mixed &= 0x7FFFFFFF
        mixed = (mixed ^ (mixed >> shift)) * factor
    signs = np.where((mixed >> 16) & 1 == 1, 1.0, -1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten()
            x, blank = np.zeros((len(sizes), dims)), np.zeros((len(sizes), dims), bool)
            there = np.arange(dims) < sizes[:, None]
            x[there], blank[there] = pc.fill_null(flat, 0.0).to_numpy(), flat.is_null().to_numpy(zero_copy_only=False)
            total = np.zeros((len(x), BITS))
            for d in range(dims):
                total += x[:, d, None] * signs[None, :, d]
            on = ((total > 0) | np.isnan(total)) & ~blank.any(axis=1)[:, None]
            digits = np.packbits(on, axis=1, bitorder="little").view("<u4").astype(">u4").tobytes().hex()
            held = lists.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digits[32 * i : 32 * i + 32] if h else None for i, h in enumerate(held)], pa.string())], ["path", "sh"])

    return vectors.select(key, F.slice(F.col(vec).cast("array<double>"), 1, dims)).mapInArrow(run, f"path {kind}, sh string")


#: A signature's bands of 16 bits, and of how many bits varied in a band looking up is no longer cheaper than counting.
BANDS, VARIED = 8, 3
#: Signatures of a block: asking and held, and of each those compared at once.
ASKED, HELD, ASKED_AT_ONCE, HELD_AT_ONCE = 65_536, 65_536, 256, 8192


def band_reach(radius: int) -> list[int]:
    """How many bits of each band to vary: if every band differed in more, the sum would exceed the radius."""
    return [(radius + 1 + k) // BANDS - 1 for k in range(BANDS)]


def _band(sh: Column, k: int) -> Column:
    return F.conv(F.substring(sh, 4 * k + 1, 4), 16, 10).cast("int")


def near_signatures(rows: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """(q_sh, sh, distance) of all pairs of distinct signatures (q_sh of ``asked``, sh of ``rows``) within the radius,
    found where a band is equal up to the few bits that it may vary in."""
    varied = lambda bits: [sum(1 << b for b in some) for n in range(bits + 1) for some in itertools.combinations(range(16), n)]
    bands = [(k, reach) for k, reach in enumerate(band_reach(radius)) if reach >= 0]
    # ``transform`` passes an index to a second parameter, so the band must not be one.
    asking = lambda k: lambda m: F.struct(F.lit(k).alias("band"), _band(F.col("q_sh"), k).bitwiseXOR(m).alias("value"))
    probes = F.concat(*(F.transform(F.array(*map(F.lit, varied(reach))), asking(k)) for k, reach in bands))
    held = F.array(*(F.struct(F.lit(k).alias("band"), _band(F.col("sh"), k).alias("value")) for k, _ in bands))
    sent = asked.select("q_sh", F.inline(probes))
    there = rows.select("sh", F.inline(held))
    return there.join(sent, ["band", "value"]).select("q_sh", "sh").where(hamming(F.col("sh"), F.col("q_sh")) <= radius).distinct().withColumn("distance", hamming(F.col("sh"), F.col("q_sh")))


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint64).reshape(-1, 2)


def ranked_signatures(rows: DataFrame, asked: DataFrame, radius: int, top: int) -> DataFrame:
    """(q_sh, sh, distance): as ``near_signatures``, of each q_sh the ``top`` nearest signatures, then by path;
    rows (sh, path), a signature's first path. No path of another can be among the ``top`` nearest, for
    each of these has one before it.

    For radii whose bands leave nearly everything open: all pairs are counted, a block of each side a task, and
    only the ``top`` of each block go on.
    """
    kind = dict(rows.dtypes)["path"]
    cores, n, m = rows.sparkSession.sparkContext.defaultParallelism, rows.count(), asked.count()
    bands, parts = max(1, -(-m // ASKED)), max(1, -(-n // HELD), min(2 * cores, n // 1000))
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda column, k: F.pmod(F.xxhash64(column), F.lit(k)).cast("int")
    asking = asked.select(F.col("q_sh").alias("sh"), F.lit(None).cast(kind).alias("path"), F.lit(True).alias("asks"), dealt("q_sh", bands).alias("i"), all_of(parts).alias("j"))
    held = rows.select("sh", "path", F.lit(False).alias("asks"), all_of(bands).alias("i"), dealt("sh", parts).alias("j"))
    both = asking.unionByName(held).repartitionById(bands * parts, F.col("i") * parts + F.col("j")).select("sh", "path", "asks")

    def best(found: np.ndarray) -> np.ndarray:
        """Of (asking, distance, held) rows the first ``top`` of each."""
        found = found[np.lexsort(found.T[::-1])]
        return found[np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0]) < top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        ask, hold = whole.filter(whole.column(2)), whole.filter(pc.invert(whole.column(2)))
        hold = hold.take(pc.sort_indices(hold.column(1)))  # equally far ones then stand in order of the path
        x, y = _bits(ask.column(0)), _bits(hold.column(0))
        for a in range(0, len(x), ASKED_AT_ONCE):
            q, found = x[a : a + ASKED_AT_ONCE], np.zeros((0, 3), np.int64)
            for b in range(0, len(y), HELD_AT_ONCE):
                r = y[b : b + HELD_AT_ONCE]
                far = np.bitwise_count(q[:, None, 0] ^ r[None, :, 0]) + np.bitwise_count(q[:, None, 1] ^ r[None, :, 1])
                i, j = np.nonzero(far <= radius)
                found = best(np.concatenate([found, np.stack([i, far[i, j], j + b], axis=1).astype(np.int64)])) if len(i) else found
            yield pa.RecordBatch.from_arrays([ask.column(0).combine_chunks().take(pa.array(found[:, 0] + a)), *(hold.column(c).combine_chunks().take(pa.array(found[:, 2])) for c in (0, 1)), pa.array(found[:, 1].astype(np.int32))], ["q_sh", "sh", "path", "distance"])

    made = both.mapInArrow(run, f"q_sh string, sh string, path {kind}, distance int")
    return top_per(made, ["q_sh"], [F.asc("distance"), F.asc("path")], top).select("q_sh", "sh", "distance")


def signature_search(rows: DataFrame, queries: DataFrame, radius: int = 20, top: int = 30, keep_unsigned: bool = False) -> DataFrame:
    """(query_id, path, distance, rank): rows within a Hamming radius of a query's signature, nearest first.

    Rows of one signature are equally far, so its first ``top`` paths are all that can rank. Without a
    signature on either side the distance is null; such rows come last, if ``keep_unsigned``.
    """
    if radius >= 4 * BANDS:
        raise ValueError("bands of 16 bits serve radii below 32")
    first = top_per(rows.select("sh", "path"), ["sh"], [F.asc("path")], top).drop("rank")
    signed = first.where("sh is not null")
    asked = queries.where("sh is not null").select(F.col("sh").alias("q_sh")).distinct()
    if max(band_reach(radius)) < VARIED:
        pairs = near_signatures(signed.select("sh").distinct(), asked, radius)
    else:
        signed = materialised(signed, "signatures")
        pairs = ranked_signatures(signed.groupBy("sh").agg(F.min("path").alias("path")), materialised(asked, "asked-signatures"), radius, top)
    hits = queries.select("query_id", F.col("sh").alias("q_sh")).join(pairs, "q_sh").join(signed, "sh").select("query_id", "path", "distance")
    if keep_unsigned:
        ids, none = queries.select("query_id", "sh"), F.lit(None).cast("int").alias("distance")
        bare = first.where("sh is null").select("path")
        lead = rows.select("path").orderBy("path").limit(top)
        # At most ``top`` rows on one side.
        hits = hits.unionByName(ids.where("sh is not null").crossJoin(F.broadcast(bare)).select("query_id", "path", none)).unionByName(ids.where("sh is null").crossJoin(F.broadcast(lead)).select("query_id", "path", none))
    return top_per(hits, ["query_id"], [F.asc_nulls_last("distance"), F.asc("path")], top)


def mean_pooled(token_vectors: DataFrame) -> DataFrame:
    """(path, vec): mean of a note's token vectors, by position."""
    at = token_vectors.select("path", F.posexplode("vec").alias("pos", "x")).groupBy("path", "pos").agg(F.avg("x").alias("x"))
    return at.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))


def embed(notes: DataFrame, dims: int = 64, most: int = 4000) -> DataFrame:
    """(path, vec): default text embedding, a hashed bag of tokens of title and body; a model's
    own function can take its place (same columns)."""
    text = F.substring(F.concat_ws("\n", "title", "body"), 1, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, dims), np.float32)
            for i, slots in enumerate(batch.column(1).to_pylist()):
                np.add.at(out[i], [s % dims for s in slots or []], 1.0)
            out = unit(out).astype(np.float32)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["path", "vec"])

    hashed = F.transform(T.tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"))
    return notes.select("path", hashed.alias("slots")).mapInArrow(run, "path string, vec array<float>")


def embed_parts(notes: DataFrame, summaries: DataFrame, make=embed) -> DataFrame:
    """(path, title_vec, body_vec, summary_vec): three embeddings of a note; a blank part has none.

    ``make`` embeds (path, title, body) rows; parts go through it one at a time, blank titles empty.
    """
    rows = notes.select("path", "title", "body").join(summaries.select("path", "summary"), "path", "left")
    out = rows.select("path")
    for name in ("title", "body", "summary"):
        part = rows.where(F.trim(name) != "").select("path", F.lit("").alias("title"), F.col(name).alias("body"))
        out = out.join(make(part).select("path", F.col("vec").alias(f"{name}_vec")), "path", "left")
    return out
