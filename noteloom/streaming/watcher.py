"""The file watcher on a stream, with a bounded set of tracked paths.

A path is pending from its first event until it has been quiet for a while; it is then stable, an
external event. From there on the app's own event for it has to come before a deadline, or it counts as
missed. Both sets hold a bounded number of paths a root: beyond it the pending path that was
touched longest ago, or the waiting one whose deadline comes first, is let go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

#: Milliseconds of quiet, of grace for the app's event, and the bound of tracked paths.
QUIET_MS, DEADLINE_MS, MOST_TRACKED = 1500, 5200, 500
_PATHS, _TIME = "path string", StructType([StructField("at", LongType())])
_TOLD = "root string, path string, at_ms long, outcome string"


class _Watcher(StatefulProcessor):
    def __init__(self, quiet_ms: int, deadline_ms: int, most: int):
        self.quiet_ms, self.deadline_ms, self.most = quiet_ms, deadline_ms, most

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", _PATHS, _TIME)
        self.waiting = handle.getMapState("waiting", _PATHS, _TIME)
        self.timer = handle.getValueState("timer", _TIME)

    def _load(self) -> tuple[dict[str, int], dict[str, int]]:
        return tuple({k[0]: v[0] for k, v in state.iterator()} if state.exists() else {} for state in (self.pending, self.waiting))

    def _run(self, now: int, pending: dict[str, int], waiting: dict[str, int], told: list[tuple]) -> None:
        """What happens by itself up to ``now``: paths fall quiet, deadlines pass; in order of time."""
        due = [(at + self.quiet_ms, 0, path) for path, at in pending.items() if at + self.quiet_ms <= now] + [(at, 1, path) for path, at in waiting.items() if at <= now]
        heapq.heapify(due)
        while due:
            at, kind, path = heapq.heappop(due)
            if kind == 0:
                del pending[path]
                told.append((path, at, "stable"))
                waiting[path] = at + self.deadline_ms
                if len(waiting) > self.most:
                    oldest = min(waiting, key=lambda p: (waiting[p], p))
                    del waiting[oldest]
                    told.append((oldest, at, "let go"))
                if path in waiting and waiting[path] <= now:
                    heapq.heappush(due, (waiting[path], 1, path))
            elif waiting.get(path) == at:
                del waiting[path]
                told.append((path, at, "missed"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        was = self._load()
        pending, waiting = (dict(x) for x in was)
        told: list[tuple] = []
        events = pd.concat(list(rows)).sort_values(["ms", "own", "path"])
        for path, own, now in zip(events["path"], events["own"], events["ms"]):
            self._run(int(now), pending, waiting, told)
            if own:
                if path in waiting:
                    del waiting[path]
                    told.append((path, int(now), "seen"))
                continue
            pending[path] = int(now)
            if len(pending) > self.most:
                oldest = min(pending, key=lambda p: (pending[p], p))
                del pending[oldest]
                told.append((oldest, int(now), "evicted"))
        self._store(was, pending, waiting)
        if told:
            yield self._rows(key[0], told)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        was = self._load()
        pending, waiting = (dict(x) for x in was)
        told: list[tuple] = []
        self._run(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), pending, waiting, told)
        self._store(was, pending, waiting, fired=True)
        if told:
            yield self._rows(key[0], told)

    def _store(self, was: tuple[dict, dict], pending: dict[str, int], waiting: dict[str, int], fired: bool = False) -> None:
        for state, old, new in ((self.pending, was[0], pending), (self.waiting, was[1], waiting)):
            for path in old.keys() - new.keys():
                state.removeKey((path,))
            for path, at in new.items():
                if old.get(path) != at:
                    state.updateValue((path,), (at,))
        # One timer a root, at whatever comes next.
        at = self.timer.get()[0] if self.timer.exists() else None
        then = min([*(x + self.quiet_ms for x in pending.values()), *waiting.values()], default=None)
        if at is not None and at != then and not fired:
            self.handle.deleteTimer(at)
        if then is None:
            self.timer.clear()
        elif fired or at != then:
            self.handle.registerTimer(then)
            self.timer.update((then,))

    def _rows(self, root: str, told: list[tuple]) -> pd.DataFrame:
        path, at, outcome = zip(*told)
        return pd.DataFrame({"root": [root] * len(told), "path": list(path), "at_ms": pd.Series(list(at), dtype="int64"), "outcome": list(outcome)})

    def close(self) -> None:
        pass


def watched(events: DataFrame, quiet_ms: int = QUIET_MS, deadline_ms: int = DEADLINE_MS, most: int = MOST_TRACKED, watermark: str = "10 seconds") -> DataFrame:
    """Stream of (root, path, ts, own) to (root, path, at_ms, outcome): stable, seen, missed, evicted or let go.

    ``own`` marks the app's events, the others are the system's. Times are whole milliseconds; events older
    than the watermark are dropped.
    """
    timed = events.select("root", "path", "ts", "own", F.unix_millis("ts").alias("ms")).withWatermark("ts", watermark)
    return timed.groupBy("root").transformWithStateInPandas(_Watcher(quiet_ms, deadline_ms, most), _TOLD, "append", "EventTime")
