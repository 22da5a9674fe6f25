"""Incremental upkeep, queues, example caches, leases as tables, and usage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.hashing import fnv1a
from noteloom.operators.common import top_per

#: Task kinds of the queue; quality gates and sizes of the example cache.
TASK_KINDS = ("passport", "embed", "spotlight")
INSERT_QUALITY, SERVE_QUALITY, RING = 0.4, 0.7, 50
TOKENS_PER_REQUEST = 1250


def classify_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): new, changed, same or removed, by content hash."""
    both = current.select("path", "sha").join(stored.select("path", F.col("sha").alias("old")), "path", "full")
    return both.select("path", F.when(F.col("old").isNull(), "new").when(F.col("sha").isNull(), "removed").when(F.col("sha") == F.col("old"), "same").otherwise("changed").alias("change"))


def changed_notes(current: DataFrame, stored: DataFrame, least_chars: int = 30) -> DataFrame:
    """Notes to index again: long enough, and not stored with the same hash."""
    return current.where(F.length("body") >= least_chars).join(stored.select("path", "sha"), ["path", "sha"], "left_anti")


def private(path: Column, privacy: Column | None = None, patterns: tuple[str, ...] = (r"(?i)(^|/)clientes/",), words: tuple[str, ...] = ("sigiloso",)) -> Column:
    """Whether a path, or a payload's privacy field, forbids sending the row away."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    for w in words if privacy is not None else ():
        out = out | F.lower(F.coalesce(privacy, F.lit(""))).contains(w)
    return out


def enqueue(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): valid public tasks once per task key, the earliest of each."""
    named = tasks.withColumn("task_sha", F.sha2(F.concat_ws("\n", "type", "path", "sha"), 256))
    good = F.col("path").isNotNull() & (F.col("path") != "") & F.col("type").isin(*TASK_KINDS) & ~private(F.col("path"))
    ok = F.coalesce(good, F.lit(False))
    first = named.where(ok).withColumn("_n", F.row_number().over(Window.partitionBy("task_sha").orderBy("enqueued_at", "enqueued_by"))).where("_n = 1").drop("_n")
    return first, named.where(~ok)


def already_done(tasks: DataFrame, passports: DataFrame) -> DataFrame:
    """Tasks with ``done``: a profile of the same content exists and isn't a local stand-in."""
    have = passports.where("source <> 'local'").select("path", "sha").distinct().withColumn("done", F.lit(True))
    return tasks.join(have, ["path", "sha"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def queue_status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("type").agg(F.count("*").alias("n"), F.min("enqueued_at").alias("oldest"))


def lease_stats(leases: DataFrame, now: Column) -> DataFrame:
    """(device_id, total, expired); on a sweep a lease is over once ``expires_at`` lies before now."""
    return leases.groupBy("device_id").agg(F.count("*").alias("total"), F.count_if(F.col("expires_at") < now).alias("expired"))


def claim(leases: DataFrame, wanted: DataFrame, device: str, now: int, ttl_ms: int = 60_000) -> DataFrame:
    """(note_path, device_id, claimed_at, expires_at, granted): free, own and expired (at or before
    now) leases are granted and renewed, others stay with their holder."""
    both = wanted.select("note_path").distinct().join(leases, "note_path", "left")
    free = F.col("device_id").isNull() | (F.col("device_id") == device) | (F.col("expires_at") <= now)
    return both.select("note_path", F.when(free, device).otherwise(F.col("device_id")).alias("device_id"), F.when(free, F.lit(now)).otherwise(F.col("claimed_at")).alias("claimed_at"), F.when(free, F.lit(now + ttl_ms)).otherwise(F.col("expires_at")).alias("expires_at"), free.alias("granted"))


def sweep(notes: DataFrame, passports: DataFrame, leases: DataFrame, device: str, now: int) -> DataFrame:
    """Stale notes (no profile of their content) and whether this device may rebuild them."""
    stale = notes.join(passports.select("path", "sha"), ["path", "sha"], "left_anti").select(F.col("path").alias("note_path"))
    return claim(leases, stale, device, now)


def example_ring(rows: DataFrame, tasks: tuple[str, ...] | None = None, most: int = RING) -> DataFrame:
    """Examples kept per task: known tasks, quality gate, per input key the best and then latest
    row, then the ``most`` best by quality and time."""
    fit = rows.where((F.col("quality") >= INSERT_QUALITY) & (F.col("input") != "") & (F.col("output") != ""))
    if tasks:
        fit = fit.where(F.col("task").isin(*tasks))
    keyed = fit.withColumn("key", fnv1a(F.col("input")))
    # Later rows replace those of no higher quality, so the best quality's latest row is left.
    kept = keyed.groupBy("task", "key").agg(F.max_by(F.struct("input", "output", "quality", "ts"), F.struct("quality", "ts", "output")).alias("r")).select("task", "key", "r.*")
    return top_per(kept, ["task"], [F.desc("quality"), F.desc("ts"), F.asc("key")], most)


def examples(ring: DataFrame, k: int = 3) -> DataFrame:
    return top_per(ring.where(F.col("quality") >= SERVE_QUALITY).drop("rank"), ["task"], [F.desc("quality"), F.desc("ts"), F.asc("key")], k)


def example_stats(ring: DataFrame, tasks: list[str]) -> DataFrame:
    known = ring.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    return known.join(ring.groupBy("task").agg(F.count("*").alias("n")), "task", "left").select("task", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def prompt(chosen: DataFrame, most: int = 5) -> DataFrame:
    """(task, prompt): examples as a chat transcript."""
    part = F.concat(F.lit("User: "), F.col("input"), F.lit("\nAssistant: "), F.col("output"))
    return chosen.where(F.col("rank") <= most).groupBy("task").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("prompt"))


def training_pairs(captures: DataFrame, provider: str, since: Column, enough: int = 1000, days: int = 7) -> DataFrame:
    """Chat lines of a teacher's captures after a time, with ``ready``: enough pairs or days."""
    rows = captures.where((F.col("provider") == provider) & (F.col("captured_at") > since))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    lines = rows.select("captured_at", F.to_json(F.struct(F.array(message("user", "input"), message("assistant", "output")).alias("messages"))).alias("line"))
    gate = lines.agg(((F.count("*") >= enough) | (F.datediff(F.max("captured_at"), since) >= days)).alias("ready"))
    return lines.crossJoin(F.broadcast(gate))


def usage(requests: DataFrame) -> DataFrame:
    """Per endpoint: requests, bytes, tokens (a quarter of the bytes) and tokens saved."""
    total = requests.groupBy("endpoint").agg(F.count("*").alias("requests"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
    tokens = F.round((F.col("bytes_in") + F.col("bytes_out")) / 4).cast("long")
    return total.withColumn("tokens", tokens).withColumn("saved", F.greatest(F.lit(0).cast("long"), TOKENS_PER_REQUEST * F.col("requests") - tokens))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")
