"""Leases on a stream: claims and releases of notes by devices, with leases that end by themselves.

The state of a note is its holder and the end of the lease, with a timer at that end: when the
watermark has passed it, the lease expires without any further request. Requests of a note
apply in order of time, at one time by device; one older than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What ``transformWithStateInPandas`` needs of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_HELD = StructType([StructField("holder", StringType()), StructField("until", LongType())])
_TOLD = "note_path string, device_id string, at_ms long, outcome string, holder string"


class _Leases(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        holder, until = self.held.get() if self.held.exists() else (None, 0)
        timer = until if holder is not None else None
        asked = pd.concat(list(rows)).sort_values(["ms", "device_id"])
        told = []
        for device, action, now in zip(asked["device_id"], asked["action"], asked["ms"]):
            if holder is not None and until <= now:
                told.append((holder, until, "expired", None))
                holder = None
            if action == "release":
                outcome = "released" if holder == device else "not owner" if holder else "no lease"
                holder = None if holder == device else holder
            elif holder is None or holder == device:
                outcome = "granted" if holder is None else "renewed"
                holder, until = device, int(now) + self.ttl_ms
            else:
                outcome = "refused"
            told.append((device, now, outcome, holder))
        if timer is not None and (holder is None or timer != until):
            self.handle.deleteTimer(timer)
        if holder is None:
            self.held.clear()
        else:
            self.held.update((holder, until))
            if timer != until:
                self.handle.registerTimer(until)
        yield _rows(key[0], told)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        holder, until = self.held.get()
        self.held.clear()
        yield _rows(key[0], [(holder, until, "expired", None)])

    def close(self) -> None:
        pass


def _rows(note: str, told: list[tuple]) -> pd.DataFrame:
    device, at, outcome, holder = zip(*told) if told else ((), (), (), ())
    return pd.DataFrame({"note_path": [note] * len(told), "device_id": list(device), "at_ms": pd.Series(list(at), dtype="int64"), "outcome": list(outcome), "holder": list(holder)})


def lease_stream(requests: DataFrame, ttl_ms: int = 60_000, watermark: str = "10 seconds") -> DataFrame:
    """Stream of (note_path, device_id, action, ts) to (note_path, device_id, at_ms, outcome, holder).

    ``claim`` is granted where no lease is held, renewed for its holder, else refused; ``release``
    is released for the holder, else not owner or no lease; expired tells of a lease's end by time.
    ``holder`` is who holds the lease afterwards.
    """
    timed = requests.select("note_path", "device_id", "action", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", watermark)
    return timed.groupBy("note_path").transformWithStateInPandas(_Leases(ttl_ms), _TOLD, "append", "EventTime")
