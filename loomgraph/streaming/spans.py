"""Spans as a stream: the circuit breaker of each tool, and latency by window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.store import settled

#: Errors that open a breaker, and the seconds after the first of them at which it closes again.
ERRORS, SECONDS = 5, 60.0
#: Seconds of a slice, the calls of a tool that one task works on; calls of a slice are fewer than PLACES.
SLICE, PLACES = 6 * 3600, 1 << 28
MICROS = int(SECONDS * 1_000_000)
COLUMNS = "tool string, span_id string, timestamp timestamp, failed boolean, blocked boolean, errors int"


def advance(state: tuple[int, float], at: float, failed: bool) -> tuple[tuple[int, float], bool, int]:
    """One call on a breaker (errors, time of the first): the new breaker, whether the call was blocked, the errors after
    it. A blocked call does not run, so it neither fails nor clears."""
    errors, first = state
    if errors and at - first >= SECONDS:
        errors, first = 0, 0.0
    if errors >= ERRORS:
        return (errors, first), True, errors
    if not failed:
        return (0, 0.0), False, 0
    return (errors + 1, first if errors else at), False, errors + 1


def calls(spans: DataFrame) -> DataFrame:
    """The calls, with the seconds of their time as `at`."""
    at = F.col("timestamp").cast("timestamp")
    return spans.select("tool", "span_id", at.alias("timestamp"), (F.unix_micros(at) / 1e6).alias("at"), F.coalesce(F.col("error") != "", F.lit(False)).alias("failed"))


def run_breaker(rows: pd.DataFrame, state: tuple[int, float]) -> tuple[pd.DataFrame, tuple[int, float]]:
    rows = rows.sort_values(["at", "span_id"], kind="stable")
    blocked, errors = [], []
    for at, failed in zip(rows["at"], rows.failed):
        state, b, e = advance(state, at, bool(failed))
        blocked.append(b)
        errors.append(e)
    return rows.assign(blocked=blocked, errors=errors)[["tool", "span_id", "timestamp", "failed", "blocked", "errors"]], state


def breaker_stream(spans: DataFrame) -> DataFrame:
    """For a stream of spans: each call with whether its tool's breaker blocked it. A tool's state is two numbers; a
    batch's calls of a tool come in time order."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames))
        out, held = run_breaker(rows, (int(held[0]), float(held[1])))
        state.update(held)
        yield out

    return calls(spans).groupBy("tool").applyInPandasWithState(step, COLUMNS, "errors int, first double", "append", GroupStateTimeout.NoTimeout)


def breaker(spans: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """The same for a table: tool, span_id, timestamp, failed, blocked, errors of each call.

    A run is what begins with the first of the errors in a count. Where the next run begins hangs on nothing but where
    this one began: if one of the next 4 calls comes within 60 seconds and succeeds, at the first failed call after that; else at the
    first failed call 60 seconds later or more, the breaker being open or forgotten by then. So every failed call
    points to one later failed call, and the runs are those that the tool's first failed call leads to.

    A tool's calls are cut into slices of time, at least a minute long, and a slice sees the first minute of the next one. In
    a slice the pointers are followed to the first that leaves it, for every failed call at once: that is the
    slice's map from each call where a run may come in to where it goes on. These maps are composed by doubling, so rounds grow
    with the logarithm of the slices; only calls where runs may come in take part. Then each slice marks the runs that
    really begin in it and reads every call from the run that it falls into. Numpy works on whole slices, no call is a step of its own.

    Calls without a time are left out; a null tool is a tool. Calls of a tool at one time are ordered by span_id. A slice's calls
    are one task's work.
    """
    wide = max(MICROS, int(slice_seconds * 1_000_000))
    rows = calls(spans).where("timestamp is not null").withColumn("at", F.unix_micros("timestamp"))
    rows = rows.withColumn("slice", F.floor(F.col("at") / wide).cast("long")).withColumn("key", F.when(F.col("tool").isNull(), "").otherwise(F.concat(F.lit("="), "tool")))
    order = Window.partitionBy("key", "slice").orderBy("at", "span_id")
    rows = settled(rows.withColumn("pos", F.row_number().over(order) - 1), "calls")
    place = F.col("slice") * PLACES + F.col("pos")  # rises with the order of a tool's calls
    early = F.col("at") < F.col("slice") * wide + MICROS
    failed = F.when(F.col("failed"), place)
    slices = rows.groupBy("key", "slice").agg(F.count(F.lit(1)).alias("n"), F.min(failed).alias("first"), F.min(F.when(~early, failed)).alias("later"))
    # where a run goes on that neither this slice nor the first minute of the next one has a place for
    backward = Window.partitionBy("key").orderBy((-F.col("slice")).alias("back"))  # a row a slice
    rest = F.coalesce(F.min("later").over(backward.rangeBetween(-1, -1)), F.min("first").over(backward.rangeBetween(Window.unboundedPreceding, -2)))
    slices = slices.withColumn("rest", rest)
    slices = settled(slices, "slices")

    own = rows.select("key", "slice", "pos", "at", "failed", F.lit(False).alias("ahead"))
    ahead = rows.where(early).select("key", (F.col("slice") - 1).alias("slice"), "pos", "at", "failed", F.lit(True).alias("ahead"))
    seen = own.unionAll(ahead).join(slices.where("first is not null").select("key", "slice", "rest"), ["key", "slice"])
    fails = settled(seen.groupBy("key", "slice").applyInPandas(pointers, "key string, slice long, pos long, at long, good int, next long, leaves long"), "pointers")

    # the calls where a run may come in, and where the slice that it comes into lets it go on
    starts = slices.groupBy("key").agg(F.min("first").alias("place")).where("place is not null")
    entries = fails.select("key", F.col("leaves").alias("place")).where("place is not null").unionAll(starts).distinct()
    maps = fails.select("key", (F.col("slice") * PLACES + F.col("pos")).alias("place"), "leaves")
    jump = settled(entries.join(maps, ["key", "place"]), "maps")
    reached = settled(starts, "reached")
    while True:
        new = reached.join(jump, ["key", "place"]).where("leaves is not null").select("key", F.col("leaves").alias("place")).join(reached, ["key", "place"], "left_anti").distinct()
        new = settled(new, "reached")
        if new.isEmpty():
            break
        reached = reached.unionAll(new)
        there = jump.select("key", F.col("place").alias("leaves"), F.col("leaves").alias("far"))
        jump = settled(jump.join(there, ["key", "leaves"], "left").select("key", "place", F.col("far").alias("leaves")), "maps")
    entered = reached.select("key", F.floor(F.col("place") / PLACES).cast("long").alias("slice"), F.pmod("place", F.lit(PLACES)).alias("enter"))
    begun = fails.select("key", "slice", "pos", "at", "good", "next").join(entered, ["key", "slice"])
    runs = settled(begun.groupBy("key", "slice").applyInPandas(runs_of, "key string, slice long, pos long, at long, good int"), "runs")

    # a run is still on in the first minute of the slice after its own
    last = runs.groupBy("key", "slice").agg(F.max_by(F.struct("pos", "at", "good"), "pos").alias("run")).join(slices.select("key", "slice", "n"), ["key", "slice"])
    carried = last.select("key", (F.col("slice") + 1).alias("slice"), (F.col("run.pos") - F.col("n")).alias("pos"), F.col("run.at").alias("at"), F.col("run.good").alias("good"))
    runs = runs.unionAll(carried)
    # each call is read from the last run that begins at it or before; blank is the run's mark
    blank = F.lit(None)
    marks = runs.select("key", "slice", "pos", F.struct(F.col("pos").alias("begin"), F.col("at").alias("since"), "good").alias("run"), *(blank.cast(t).alias(c) for c, t in (("tool", "string"), ("span_id", "string"), ("timestamp", "timestamp"), ("at", "long"), ("failed", "boolean"))))
    both = rows.withColumn("run", F.lit(None).cast(marks.schema["run"].dataType)).select(*marks.columns).unionAll(marks)
    upto = Window.partitionBy("key", "slice").orderBy("pos", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = both.withColumn("in", F.last("run", ignorenulls=True).over(upto)).where("run is null")
    nth = F.col("pos") - F.col("in.begin")
    on = F.coalesce((F.col("at") < F.col("in.since") + MICROS) & ((F.col("in.good") == 0) | (nth < F.col("in.good"))), F.lit(False))
    errors = F.when(on, F.least(nth + 1, F.lit(ERRORS))).otherwise(F.lit(0)).cast("int")
    return read.select("tool", "span_id", "timestamp", "failed", (on & (nth >= ERRORS)).alias("blocked"), errors.alias("errors"))


def pointers(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each failed call of a slice: how many calls later a success ends the count (0: none), where the next run would
    begin, and where the first one beyond the slice would (null: nowhere)."""
    rows = rows.sort_values(["ahead", "pos"], kind="stable")
    at, failed, ahead = rows["at"].to_numpy(), rows["failed"].to_numpy(bool), rows["ahead"].to_numpy(bool)
    place = (rows["slice"].to_numpy(np.int64) + ahead) * PLACES + rows["pos"].to_numpy(np.int64)
    size, own = len(at), int((~ahead).sum())
    here = np.flatnonzero(failed[:own])
    good = np.zeros(len(here), np.int64)
    for k in range(ERRORS - 1, 0, -1):
        at_k = np.minimum(here + k, size - 1)
        good = np.where((here + k < size) & ~failed[at_k] & (at[at_k] < at[here] + MICROS), k, good)
    fails = np.flatnonzero(failed)
    first = np.where(good > 0, here + good, np.searchsorted(at, at[here] + MICROS, "left"))
    k = np.searchsorted(fails, first, "left")
    rest = rows["rest"].iloc[0]
    rest = -1 if pd.isna(rest) else int(rest)
    next_ = np.where(k < len(fails), place[fails[np.minimum(k, len(fails) - 1)]], rest)
    # which of the slice's failed calls comes next; one beyond the slice points to itself
    inside = (k < len(fails)) & (k < len(here))
    to = np.where(inside, k, np.arange(len(here)))
    leaves = next_.copy()
    for _ in range(max(1, len(here)).bit_length()):
        leaves, to = leaves[to], to[to]
    out = pd.DataFrame({"key": rows["key"].iloc[0], "slice": rows["slice"].iloc[0], "pos": rows["pos"].to_numpy()[here], "at": at[here], "good": good, "next": next_, "leaves": leaves})
    out[["next", "leaves"]] = out[["next", "leaves"]].astype("Int64").where(lambda c: c >= 0)
    return out


def runs_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The failed calls of a slice at which runs begin, by pointers from where a run comes in: what is reached doubles in
    each step."""
    rows = rows.sort_values("pos", kind="stable").reset_index(drop=True)
    pos = rows["pos"].to_numpy(np.int64)
    next_ = rows["next"].astype("Int64").fillna(-1).to_numpy(np.int64) - int(rows["slice"].iloc[0]) * PLACES
    to = np.searchsorted(pos, next_)
    to = np.where((next_ > pos) & (to < len(pos)), to, np.arange(len(pos)))  # what leaves the slice stays where it is
    on = np.zeros(len(pos), bool)
    on[np.searchsorted(pos, int(rows["enter"].iloc[0]))] = True
    for _ in range(max(1, len(pos)).bit_length()):
        on[to[on]] = True
        to = to[to]
    return rows.loc[on, ["key", "slice", "pos", "at", "good"]]


def breaker_states(spans: DataFrame, as_of: dt.datetime, slice_seconds: int = SLICE) -> DataFrame:
    """tool, errors, open: the state of each tool's breaker at as_of; open: calls are blocked."""
    done = breaker(spans.where(F.col("timestamp") <= F.lit(as_of)), slice_seconds)
    last = done.groupBy("tool").agg(F.max_by(F.struct("errors", "timestamp"), F.struct("timestamp", "span_id")).alias("last"))
    # the first of the errors in the count is the latest call that made it 1
    begun = done.where("failed and not blocked and errors = 1").groupBy("tool").agg(F.max("timestamp").alias("begun"))
    since = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("begun")
    errors = F.when((F.col("last.errors") > 0) & (since < int(SECONDS * 1e6)), F.col("last.errors")).otherwise(F.lit(0))
    joined = last.join(begun, last["tool"].eqNullSafe(begun["tool"]), "left").select(last["tool"], errors.alias("errors"))
    return joined.withColumn("open", F.col("errors") >= ERRORS)


def latency_stream(spans: DataFrame, window: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """start, tool, n, avg_ms, max_ms, errors of tumbling windows, closed when the watermark has passed them."""
    by = spans.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "tool")
    out = by.agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.count("error").alias("errors"))
    return out.select(F.col("window.start").alias("start"), "tool", "n", "avg_ms", "max_ms", "errors")
