"""Spans: latency, errors, health, replay."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import redact_text, safe_error
from loomgraph.operators.lookup import limited
from loomgraph.operators.ordering import running_sum
from loomgraph.store import settled
from loomgraph.streaming.spans import breaker_states

T = TypeVar("T")


def recent(spans: DataFrame, as_of: dt.datetime, minutes: float, closed: bool = True) -> DataFrame:
    """Spans of the minutes before as_of; closed: also one right at the beginning."""
    since = F.lit(as_of - dt.timedelta(minutes=minutes))
    return spans.where((F.col("timestamp") >= since) if closed else (F.col("timestamp") > since)).where(F.col("timestamp") <= F.lit(as_of))


def latest(spans: DataFrame) -> dt.datetime:
    return spans.agg(F.max("timestamp")).first()[0]


def picks(spans: DataFrame, *shares: float) -> DataFrame:
    """One row: n and, for each share, the duration at index floor(n * share) in order; 0 without spans. Counts of each
    distinct duration are summed up, so that equal durations need one row."""
    counts = spans.where("duration_ms is not null").groupBy("duration_ms").agg(F.count(F.lit(1)).alias("c"))
    counts = settled(counts, "durations")
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    upto = running_sum(counts, F.col("c"), "upto", "duration_ms")
    at = [F.coalesce(F.min(F.when(F.col("upto") > int(n * s), F.col("duration_ms"))), F.lit(0.0)).alias(f"p{round(s * 100)}") for s in shares]
    return upto.agg(F.lit(n).cast("long").alias("n"), *at)


def latency(spans: DataFrame, as_of: dt.datetime, minutes: int = 60) -> DataFrame:
    """One row: n, min, p50, p90, max of the window's durations, by index, 0 without any."""
    if not 1 <= minutes <= 10_080:
        raise ValueError("the window is 1 to 10080 minutes")
    now = settled(recent(spans, as_of, minutes).select("duration_ms"), "window")
    ends = now.agg(F.coalesce(F.min("duration_ms"), F.lit(0.0)).alias("min"), F.coalesce(F.max("duration_ms"), F.lit(0.0)).alias("max"))
    return picks(now, 0.5, 0.9).join(ends).select("n", "min", "p50", "p90", "max")


def top_tools(spans: DataFrame, as_of: dt.datetime, minutes: int = 60, limit: int = 20) -> DataFrame:
    by = recent(spans, as_of, minutes).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return by.orderBy(F.desc("n"), "tool").limit(limited(limit, 100))


def errors(spans: DataFrame, as_of: dt.datetime, minutes: int = 60) -> DataFrame:
    return recent(spans, as_of, minutes).where("error is not null").groupBy("tool", "error").agg(F.count(F.lit(1)).alias("n"))


def health(spans: DataFrame, as_of: dt.datetime, seconds: int = 60, intact: bool = True) -> DataFrame:
    """One row: n, p50, error_percent, status of the last seconds."""
    now = settled(recent(spans, as_of, seconds / 60, closed=False).select("duration_ms", "error"), "window")
    bad = now.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("error") != "").alias("bad"))
    joined = picks(now, 0.5).drop("n").join(bad)
    percent = F.round(F.when(F.col("all") > 0, 100.0 * F.col("bad") / F.col("all")).otherwise(F.lit(0.0)), 1)
    status = F.when((percent > 50) | F.lit(not intact), "critical").when((percent > 10) | (F.col("p50") > 1000), "degraded").otherwise("healthy")
    return joined.select(F.col("all").alias("n"), "p50", percent.alias("error_percent"), status.alias("status"))


def health_with_breakers(spans: DataFrame, as_of: dt.datetime, seconds: int = 60, intact: bool = True) -> DataFrame:
    """health with the open breakers' tools (sorted); with any of them open a healthy status is degraded."""
    open_ = breaker_states(spans, as_of).where("open").agg(F.array_sort(F.collect_set("tool")).alias("open_breakers"))  # tools are few
    joined = health(spans, as_of, seconds, intact).join(open_)
    return joined.withColumn("status", F.when((F.col("status") == "healthy") & (F.size("open_breakers") > 0), "degraded").otherwise(F.col("status")))


def emitted(spans: DataFrame | None, spark: SparkSession, tool: str, call: Callable[[], T], trace_id: str, args: str = "", parent_id: str | None = None, agent_id: str | None = None, cost_usd: float | None = None) -> tuple[T | None, DataFrame]:
    """Calls an operator and gives its result with the spans and one more: how long it took, what went wrong (None is
    the result then; errors of every kind leave a span), personal values and paths taken out. A DataFrame is computed inside the span and comes back
    as a stored table, so the time is of the work and not of its plan; result_size is its rows."""
    began, error, result, size = dt.datetime.now(dt.UTC), None, None, None
    try:
        result = call()
        if isinstance(result, DataFrame):
            result = settled(result, "result")
            size = result.count()
    except Exception as e:
        error, result = str(e) or type(e).__name__, None
    took = (dt.datetime.now(dt.UTC) - began).total_seconds() * 1000
    row = spark.createDataFrame(
        [(trace_id, uuid.uuid4().hex, parent_id, tool, took, error, args, size, began, agent_id, cost_usd)],
        "trace_id string, span_id string, parent_id string, tool string, duration_ms double, error string, args_summary string, result_size long, timestamp timestamp, agent_id string, cost_usd double",
    )
    row = row.withColumn("error", F.when(F.col("error").isNotNull(), safe_error(redact_text(F.col("error"))))).withColumn("args_summary", redact_text(F.col("args_summary")))
    return result, row if spans is None else spans.unionByName(row, allowMissingColumns=True)


def replay(spans: DataFrame, trace_id: str, limit: int | None = 100) -> DataFrame:
    """The trace's spans in time, with a running number."""
    found = spans.where(F.col("trace_id") == trace_id)
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("trace_id").orderBy("timestamp", "id")))
    found = found.select("nth", "span_id", "parent_id", "tool", "duration_ms", "error")
    return found if limit is None else found.where(F.col("nth") <= limited(limit, 500))


def replay_summary(spans: DataFrame, trace_id: str) -> DataFrame:
    """One row: spans, total_ms (2 places), errors of the trace."""
    return spans.where(F.col("trace_id") == trace_id).agg(F.count(F.lit(1)).alias("spans"), F.round(F.sum("duration_ms"), 2).alias("total_ms"), F.count_if(F.col("error") != "").alias("errors"))


def replay_tree(spans: DataFrame, trace_id: str) -> DataFrame:
    """span_id, root, depth: a span whose parent is not in the trace is a root. Of spans that repeat an id the earliest
    holds. Spans that are each other's parents form a ring: its smallest span_id is its root, as if that had no
    parent. Pointers double their reach each round, so a chain of n spans takes log n joins."""
    mine = spans.where((F.col("trace_id") == trace_id) & F.col("span_id").isNotNull())
    mine = mine.groupBy("span_id").agg(F.min_by("parent_id", F.struct("timestamp", "id")).alias("parent_id"))
    ids = mine.select(F.col("span_id").alias("known"))
    up = mine.join(ids, mine["parent_id"] == ids["known"], "left").select("span_id", F.coalesce("known", "span_id").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    up = settled(up, "tree")
    up, rest = climbed(up, max(1, up.count()).bit_length() + 1)
    if not rest.isEmpty():
        # after more steps than there are spans, what is pointed to lies on a ring, and the least seen is the ring's
        ring = rest.select(F.col("up").alias("span_id")).distinct()
        ends = settled(rest.join(ring, "span_id").select(F.col("least").alias("end")).distinct(), "ring-ends")
        first = mine.join(ids, mine["parent_id"] == ids["known"], "left").join(ends, mine["span_id"] == ends["end"], "left")
        above = F.when(F.col("end").isNull(), F.coalesce("known", "span_id")).otherwise(F.col("span_id"))
        cut = first.select("span_id", above.alias("up"), F.when(above == F.col("span_id"), 0).otherwise(1).cast("long").alias("depth"))
        up, _ = climbed(settled(cut, "tree"), max(1, mine.count()).bit_length() + 1)
    return up.select("span_id", F.col("up").alias("root"), F.col("depth").cast("int").alias("depth"))


def replay_nested(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    """trace_id, span_id, root, depth, path, tree of every span of the trace, or of all traces: path leads from the root to the span; tree, of
    roots only, is JSON of the root with its children in `children`, theirs in theirs, each by time and then id. Fields: span_id,
    tool, duration_ms, error (where there is one), children. Roots, rings and repeated ids are as in replay_tree. A
    tree is one value, so a trace is one task's work."""
    found = spans if trace_id is None else spans.where(F.col("trace_id") == trace_id)
    found = found.where(F.col("span_id").isNotNull()).groupBy("trace_id", "span_id")
    columns = ("parent_id", "tool", "duration_ms", "error", "timestamp", "id")
    first = found.agg(F.min_by(F.struct(*columns), F.struct("timestamp", "id")).alias("s")).select("trace_id", "span_id", *(f"s.{c}" for c in columns))
    rows = first.select("trace_id", "span_id", "parent_id", "tool", "duration_ms", "error", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), "id")
    return rows.groupBy("trace_id").applyInPandas(nested, "trace_id string, span_id string, root string, depth int, path array<string>, tree string")


def nested(rows: pd.DataFrame) -> pd.DataFrame:
    """One trace's spans, each with its way from the root; roots with their trees. Loops over stacks: chains may be long."""
    rows = rows.sort_values(["at", "id", "span_id"], kind="stable", na_position="first")
    up = {s: p for s, p in zip(rows["span_id"], rows["parent_id"])}
    parent = {s: p if p in up else None for s, p in up.items()}
    state: dict[str, int] = {}  # 1: on the way that is being walked, 2: done
    for s in parent:
        way = []
        while s is not None and s not in state:
            state[s] = 1
            way.append(s)
            s = parent[s]
        if s is not None and state[s] == 1:
            parent[min(way[way.index(s) :])] = None  # a ring begins at its smallest span
        state.update(dict.fromkeys(way, 2))
    children: dict[str | None, list[str]] = {}
    for s in rows["span_id"]:
        children.setdefault(parent[s], []).append(s)
    about = {
        r.span_id: json.dumps({"span_id": r.span_id, "tool": r.tool, "duration_ms": None if pd.isna(r.duration_ms) else r.duration_ms} | ({"error": r.error} if r.error else {}), ensure_ascii=False)[:-1]
        for r in rows.itertuples()
    }
    out, path = [], []
    for root in children.get(None, []):
        text, at = [], len(out)
        todo: list[tuple[str, int, bool]] = [(root, 0, True)]
        while todo:
            s, depth, enter = todo.pop()
            if not enter:
                text.append("]}")
                continue
            if depth and text[-1] != "[":
                text.append(", ")
            text += [about[s], ', "children": ', "["]
            path = [*path[:depth], s]
            out.append([rows["trace_id"].iloc[0], s, root, depth, list(path), None])
            todo.append((s, depth, False))
            todo += [(c, depth + 1, True) for c in reversed(children.get(s, []))]
        out[at][-1] = "".join(text)
    return pd.DataFrame(out, columns=["trace_id", "span_id", "root", "depth", "path", "tree"])


def climbed(up: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """span_id, up, depth, least after the pointers doubled their reach until none moved, for so many rounds at most; and
    the rows that still moved. least: the smallest span on the way up, the span itself not counted."""
    up = up.withColumn("least", F.col("up"))
    for _ in range(rounds):
        above = up.select(F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("least").alias("least2"))
        # depths on a ring mean nothing and are kept from growing
        depth = F.least(F.col("depth") + F.col("depth2"), F.lit(1 << 40))
        new = up.join(above, "up").select("span_id", F.col("up2").alias("up"), depth.alias("depth"), F.least("least", "least2").alias("least"), (F.col("depth2") > 0).alias("moved"))
        up = settled(new, "tree")
        moving = up.where("moved")
        up = up.drop("moved")
        if moving.isEmpty():
            break
    return up, moving
