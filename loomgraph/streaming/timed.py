"""The circuit breaker as a stream in event time: calls are read in their order, and the state of quiet tools goes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from loomgraph.streaming.spans import ERRORS, MICROS

#: The state store that keeps lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = StructType([StructField("tool", StringType()), StructField("span_id", StringType()), StructField("timestamp", TimestampType()), StructField("failed", BooleanType()), StructField("blocked", BooleanType()), StructField("errors", IntegerType())])
WAITING = StructType([StructField("at", LongType()), StructField("span_id", StringType()), StructField("failed", BooleanType())])
BREAKER = StructType([StructField("errors", IntegerType()), StructField("first", LongType())])


def advanced(errors: int, first: int, at: int, failed: bool) -> tuple[int, int, bool]:
    """One call on a breaker, in microseconds: errors and time of the first of them after it, and whether it was blocked."""
    if errors and at - first >= MICROS:
        errors = 0
    if errors >= ERRORS:
        return errors, first, True
    if not failed:
        return 0, 0, False
    return errors + 1, first if errors else at, False


class Breaker(StatefulProcessor):
    """State of a tool: calls that the watermark has not passed, and the errors counted with the time of the first. A timer is
    set to the earliest of the waiting calls and to the end of a count; when it goes off, calls up to the watermark are read in
    their order, and a count a minute old is forgotten. With neither left the tool has no state at all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.count = handle.getValueState("count", BREAKER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = [(int(at), name, bool(failed)) for pdf in rows for at, name, failed in zip(pdf["at"], pdf["span_id"], pdf["failed"])]
        if come:
            self.waiting.appendList(come)
            self.handle.registerTimer(min(at for at, _, _ in come) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((int(at), name, bool(failed)) for at, name, failed in self.waiting.get()), key=lambda c: (c[0], c[1] or ""))
        errors, first = map(int, self.count.get()) if self.count.exists() else (0, 0)
        out, left = [], []
        for at, name, failed in waiting:
            if at > passed:
                left.append((at, name, failed))
                continue
            errors, first, blocked = advanced(errors, first, at, failed)
            out.append((key[0], name, pd.Timestamp(at, unit="us", tz="UTC"), failed, blocked, errors))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000)
        else:
            self.waiting.clear()
        if errors and passed < first + MICROS:
            self.count.update((errors, first))
            self.handle.registerTimer((first + MICROS) // 1000 + 1)
        elif self.count.exists():
            self.count.clear()
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in OUT])

    def close(self) -> None:
        pass


def timed_breaker(spans: DataFrame, late: str = "30 seconds") -> DataFrame:
    """For a stream of spans: tool, span_id, timestamp, failed, blocked, errors of each call, when the watermark, `late` behind the
    latest call, has passed it. Calls that come in another order than they were made are read in the order of their times (ties by
    span_id), so the rows are those of `spans.breaker` over the same calls; calls that come after the watermark are dropped.
    A null tool or time is left out. Needs the RocksDB state store (`STORE`); it goes on from its checkpoint."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = spans.where("tool is not null and timestamp is not null").withWatermark("timestamp", late)
    rows = rows.select("tool", "span_id", "timestamp", at.alias("at"), F.coalesce(F.col("error") != "", F.lit(False)).alias("failed"))
    return rows.groupBy("tool").transformWithStateInPandas(Breaker(), OUT, "Append", "EventTime")
