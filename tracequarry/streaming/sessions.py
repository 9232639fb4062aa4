"""Logon sessions of a stream: open logons are state, and a timer lets go of those that never end."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timeparse import UNIX_EPOCH
from ..model import EventSet
from ..operators.sessions import logon_rows

#: The state store that stateful processors need; a session that runs them sets it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_OPEN = "id bigint, start_ft bigint, type string, name string, domain string"
SESSIONS = "id bigint, host string, logon_id string, type string, name string, domain string, start_ft bigint, end_ft bigint, end_id bigint, boot bigint, privileged boolean"


def _ms(ft: int) -> int:
    return (ft - UNIX_EPOCH) // 10_000


class Sessions(StatefulProcessor):
    """State of a (host, boot, logon): its open logons in order, and whether it had special privileges."""

    def __init__(self, most_open_ms: int) -> None:
        self.most_open_ms = most_open_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)
        self.special = handle.getValueState("special", "yes boolean")

    def _row(self, key: Any, start: tuple, end_ft: int | None, end_id: int | None) -> tuple:
        host, boot, logon = key
        return (start[0], host, logon, *start[2:], start[1], end_ft, end_id, boot, self.special.exists())

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in SESSIONS.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"end_ft": "Int64", "end_id": "Int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # an end at the time of a start ends it
        batch = pd.concat(rows).sort_values(["ts_ft", "rank", "id"])
        waiting, done = deque(tuple(r) for r in self.open.get()), []
        for r in batch.itertuples(index=False):
            if r.kind == "p":
                self.special.update((True,))
            elif r.kind == "s":
                waiting.append((int(r.id), int(r.ts_ft), r.type, r.name, r.domain))
                self.handle.registerTimer(max(_ms(int(r.ts_ft)) + self.most_open_ms, timerValues.getCurrentWatermarkInMs() + 1))
            elif waiting:
                done.append(self._row(key, waiting.popleft(), int(r.ts_ft), int(r.id)))
        self._keep(waiting)
        if done:
            yield self._frame(done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Logons open for too long are given out without an end."""
        least = expiredTimerInfo.getExpiryTimeInMs() - self.most_open_ms
        waiting, done = deque(tuple(r) for r in self.open.get()), []
        while waiting and _ms(waiting[0][1]) <= least:
            done.append(self._row(key, waiting.popleft(), None, None))
        self._keep(waiting)
        if done:
            yield self._frame(done)

    def _keep(self, waiting: deque) -> None:
        if waiting:
            self.open.put(list(waiting))
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def logons(events: EventSet, boots: DataFrame, late: str = "1 hour", most_open_days: int = 30) -> DataFrame:
    """Sessions of a streaming EventSet as they end; those open for ``most_open_days`` are given out with a null end.

    Events come in order of time for each host, as a log is written; ``boots`` is the stored table of boots. Equal to the batch's
    closed sessions, but for privileges that come after the end. The session has STORE set.
    """
    rows = logon_rows(events, boots).withColumns({"at": F.timestamp_micros(F.floor((F.col("ts_ft") - UNIX_EPOCH) / 10)), "rank": F.when(F.col("kind") == "s", 0).otherwise(1), "boot": F.col("boot").cast("bigint")})
    keyed = rows.select("host", "boot", "logon", "id", "ts_ft", "kind", "rank", "type", "name", "domain", "at").withWatermark("at", late).groupBy("host", "boot", "logon")
    return keyed.transformWithStateInPandas(Sessions(most_open_days * 86_400_000), outputStructType=SESSIONS, outputMode="Append", timeMode="EventTime")


def once(stream: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = ("record_id", "computer", "channel", "ts_ft")) -> DataFrame:
    """A stream of event records without copies: a record that comes again within the watermark counts once.

    State is bounded by the watermark; the columns are what tells records apart.
    """
    own = stream.withColumn("_at", F.timestamp_micros(F.floor((F.col("ts_ft") - UNIX_EPOCH) / 10))).withWatermark("_at", late)
    return own.dropDuplicatesWithinWatermark(list(keys)).drop("_at")
