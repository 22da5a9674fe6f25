"""File events to index work: debounced layers, counters, leases, queues, late events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Seconds of quiet before each layer runs for a path.
QUIET = {"embed": 0.5, "audio": 2, "graph": 6, "passport": 8, "base": 10, "spotlight": 15, "lexical": 30, "leiden": 30, "multiplex": 60}
MULTIPLEX_AFTER = 10


def expand_renames(events: DataFrame) -> DataFrame:
    """A rename is a deletion of the old path and a creation of the new one."""
    parts = F.when(F.col("kind") == "rename", F.array(F.struct(F.lit("delete").alias("kind"), F.col("old_path").alias("path")), F.struct(F.lit("create").alias("kind"), F.col("path").alias("path")))).otherwise(F.array(F.struct(F.col("kind"), F.col("path"))))
    return events.select("ts", F.explode(parts).alias("e")).select("ts", "e.kind", "e.path").where("path is not null")


def debounced(events: DataFrame, quiet: dict[str, float] | None = None, watermark: str = "2 minutes") -> DataFrame:
    """One row per layer, path and burst: (layer, path, started, fires, n). A burst ends after the
    layer's quiet time; works on a stream (append mode) and on a table."""
    quiet = quiet or QUIET
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(f"{int(s * 1000)} milliseconds").alias("gap")) for n, s in quiet.items()))
    rows = events.withWatermark("ts", watermark).select("ts", "path", F.explode(layers).alias("l")).select("ts", "path", "l.layer", "l.gap")
    grouped = rows.groupBy("layer", "path", F.session_window("ts", F.col("gap")).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("layer", "path", F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n")


def threshold_triggers(events: DataFrame, after: int = MULTIPLEX_AFTER, group: str = "domain") -> DataFrame:
    """(key, trigger): a trigger for every ``after`` modifications of a key, counted across batches."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        seen, fired = state.get if state.exists else (0, 0)
        total = seen + sum(len(f) for f in frames)
        now = fired + total // after
        state.update((total % after, now))
        if now > fired:
            yield pd.DataFrame({"key": [str(key[0])] * (now - fired), "trigger": range(fired + 1, now + 1)})

    return events.groupBy(group).applyInPandasWithState(count, "key string, trigger long", "seen long, fired long", "append", GroupStateTimeout.NoTimeout)


def lease_events(requests: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """Stream of (note_path, device_id, action, at_ms) to (note_path, device_id, at_ms, granted, holder).

    A claim succeeds if no lease is held, it is the claimant's own, or it expires at or before
    now; a release by its holder frees it. The holder is the state of each note.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        holder, until = state.get if state.exists else ("", 0)
        out = []
        for row in pd.concat(list(frames)).sort_values(["at_ms", "device_id"]).itertuples():
            if row.action == "release":
                granted = holder == row.device_id
                holder, until = ("", 0) if granted else (holder, until)
            else:
                granted = holder in ("", row.device_id) or until <= row.at_ms
                holder, until = (row.device_id, row.at_ms + ttl_ms) if granted else (holder, until)
            out.append((key[0], row.device_id, row.at_ms, bool(granted), holder))
        state.update((holder, int(until)))
        yield pd.DataFrame(out, columns=["note_path", "device_id", "at_ms", "granted", "holder"])

    return requests.groupBy("note_path").applyInPandasWithState(step, "note_path string, device_id string, at_ms long, granted boolean, holder string", "holder string, until long", "append", GroupStateTimeout.NoTimeout)


def deduplicated_tasks(tasks: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each task key once within the watermark (needs ``enqueued_at`` as event time)."""
    named = tasks.withColumn("task_sha", F.sha2(F.concat_ws("\n", "type", "path", "sha"), 256))
    return named.withWatermark("enqueued_at", watermark).dropDuplicatesWithinWatermark(["task_sha"])


def missed_events(external: DataFrame, adapter: DataFrame, deadline: str = "5 seconds", watermark: str = "10 seconds") -> DataFrame:
    """(path, ts, seen): events of a system watcher, and whether the app's own came within the deadline."""
    left = external.withWatermark("ts", watermark).select("path", "ts")
    right = adapter.withWatermark("own_ts", watermark).select(F.col("path").alias("own_path"), "own_ts")
    near = (F.col("path") == F.col("own_path")) & (F.col("own_ts") >= F.col("ts") - F.expr(f"INTERVAL {deadline}")) & (F.col("own_ts") <= F.col("ts") + F.expr(f"INTERVAL {deadline}"))
    return left.join(right, near, "leftOuter").select("path", "ts", F.col("own_ts").isNotNull().alias("seen"))


def watcher_stats(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("events"), F.count_if(~F.col("seen")).alias("missed"), F.round(F.avg(F.col("seen").cast("double")), 6).alias("hit_rate"))


def missed_paths(matched: DataFrame, keep: int = 50, show: int = 10) -> DataFrame:
    """(path, ts): of the last ``keep`` missed events the last ``show``."""
    last = matched.where(~F.col("seen")).orderBy(F.desc("ts"), F.desc("path")).limit(keep)
    return last.orderBy(F.desc("ts"), F.desc("path")).limit(show).select("path", "ts")


def scheduled(triggers: DataFrame) -> DataFrame:
    """Stream of (key, at_ms, took_ms) to (key, at_ms, ends_ms, started): a trigger starts its key's job
    unless that job still runs; then it is dropped, and the next trigger has its chance."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        out = []
        for row in pd.concat(list(frames)).sort_values(["at_ms", "took_ms"]).itertuples():
            free = row.at_ms >= until
            until = row.at_ms + row.took_ms if free else until
            out.append((key[0], row.at_ms, int(until), bool(free)))
        state.update((int(until),))
        yield pd.DataFrame(out, columns=["key", "at_ms", "ends_ms", "started"])

    return triggers.groupBy("key").applyInPandasWithState(step, "key string, at_ms long, ends_ms long, started boolean", "until long", "append", GroupStateTimeout.NoTimeout)


def last_runs(log: DataFrame, now_ms: int) -> DataFrame:
    """(key, ago_s, took_ms, error): the last run of each job."""
    last = log.groupBy("key").agg(F.max_by(F.struct("at_ms", "took_ms", "error"), F.struct("at_ms", "took_ms")).alias("r"))
    return last.select("key", F.round((now_ms - F.col("r.at_ms")) / 1000).cast("long").alias("ago_s"), "r.took_ms", "r.error")


def last_events(batch: DataFrame) -> DataFrame:
    """A batch's last event of each path, renames expanded: what maintenance applies."""
    rows = expand_renames(batch)
    return rows.groupBy("path").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.max("ts").alias("ts"))


def maintain(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch's last events to ``apply`` (batch, number); runs what is
    there and stops. ``apply`` must be idempotent by number, as a batch may come again."""
    return events.writeStream.foreachBatch(lambda batch, n: apply(last_events(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling or sliding windows, late ones bounded by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", watermark).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")
