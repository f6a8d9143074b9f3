"""Streams in event time, the span sink, and the breaker's slices."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import telemetry
from loomgraph.streaming import spans as streams
from loomgraph.streaming import timed
from loomgraph.streaming.sink import SpanSink

NOW = dt.datetime(2024, 3, 1, 12, tzinfo=dt.UTC)
COLUMNS = "tool string, span_id string, timestamp timestamp, error string"


def walked(rows):
    """span_id: (blocked, errors), by one walk over each tool's calls."""
    state, out = {}, {}
    for tool, name, at, error in sorted(rows, key=lambda x: (x[0] or "", x[2], x[1])):
        state[tool], blocked, errors = streams.advance(state.get(tool, (0, 0.0)), at.timestamp(), bool(error))
        out[name] = (blocked, errors)
    return out


def test_breaker_in_a_long_outage(spark, monkeypatch):
    """A tool that always fails, a call each 7 seconds, over 300 slices: rounds grow with the logarithm of the slices."""
    rows = [("t", f"{k:05}", NOW + dt.timedelta(seconds=7 * k), "bad") for k in range(300 * 60 // 7)] + [(None, "x", NOW, "bad"), ("u", "y", NOW, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    names = []
    monkeypatch.setattr(streams, "settled", lambda d, name="round", keep=streams.settled: names.append(name) or keep(d, name))
    got = {r["span_id"]: (r["blocked"], r["errors"]) for r in streams.breaker(df, 60).collect()}
    assert got == walked(rows)
    assert names.count("reached") <= 12


@pytest.mark.parametrize("seed, share, gap", [(1, 0.97, 9), (3, 0.99, 61)])
def test_breaker_slices_of_all_kinds(spark, seed, share, gap):
    """Quiet spells, calls at one time, exact minutes, empty slices."""
    r, rows, at = random.Random(seed), [], 0
    for k in range(700):
        at += r.choice([0, gap, gap, 15, 60]) if r.random() < 0.97 else r.choice([600, 5000])
        rows.append((r.choice("ab"), f"{r.randrange(10**6):06}-{k}", NOW + dt.timedelta(seconds=at, microseconds=r.choice([0, 0, 1])), "bad" if r.random() < share else r.choice([None, ""])))
    df = spark.createDataFrame(rows, COLUMNS)
    for seconds in (60, 777):
        assert {x["span_id"]: (x["blocked"], x["errors"]) for x in streams.breaker(df, seconds).collect()} == walked(rows)


def feed(spark, folder, rows, k):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def run_timed(spark, folder, out, check):
    stream = spark.readStream.schema(COLUMNS).parquet(f"{folder}/*")
    q = timed.timed_breaker(stream, "10 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, timed.STORE)
    yield
    spark.conf.set(key, before)


def test_timed_breaker(spark, tmp_path, rocks):
    """Batches out of order, a restart from the checkpoint, a late call, and a tool that falls quiet."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    at = lambda s: NOW + dt.timedelta(seconds=s)
    first = [("t", f"a{k}", at(k), "bad") for k in (3, 1, 2)] + [("q", "q0", at(0), "bad")]
    feed(spark, folder, first, 0)
    run_timed(spark, folder, out, check)
    second = [("t", "a0", at(0), "bad"), ("t", "a4", at(4), "bad"), ("t", "a5", at(5), "bad"), ("u", "z1", at(30), None)]
    feed(spark, folder, second, 1)
    run_timed(spark, folder, out, check)
    third = [("t", "late", at(1), None), ("t", "a6", at(25), None), ("t", "a7", at(61), None), ("u", "z2", at(300), None)]
    feed(spark, folder, third, 2)
    run_timed(spark, folder, out, check)
    feed(spark, folder, [("u", "z3", at(400), "bad")], 3)
    run_timed(spark, folder, out, check)
    got = {r["span_id"]: (r["blocked"], r["errors"]) for r in spark.read.parquet(out).collect()}
    rows = [r for r in first + second + third if r[1] != "late"]
    assert got == {k: v for k, v in walked(rows).items() if k in got} and {"q0", "a0", "a5", "a6", "a7", "z1", "z2"} <= got.keys() and "late" not in got
    assert got["a5"] == (True, 5) and got["a6"] == (True, 5) and got["a7"] == (False, 0)
    # the state of t and q, quiet for over a minute, is gone
    kept = spark.read.format("statestore").option("path", check).option("stateVarName", "count").load()
    assert {r["key"]["tool"] for r in kept.select("key").collect()} <= {"u"}


def test_span_sink(spark, tmp_path):
    sink = SpanSink(spark, str(tmp_path / "spans"))
    assert sink.spans().count() == 0
    batch = spark.createDataFrame([("t", "1", NOW, "e"), ("t", "2", NOW, None)], COLUMNS).withColumn("extra", F.lit(1))
    sink.add(batch, "w", 0)
    sink.add(batch, "w", 0)  # a replay
    sink.add(batch.limit(1), "w", 1)
    assert sorted(r["span_id"] for r in sink.spans().collect()) == sorted(["1", "2", sink.spans().where("span_id is not null").orderBy("span_id").first()["span_id"]])
    broken = tmp_path / "spans" / "w" / "2"
    batch.write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert sink.spans().count() == 3  # what is not whole is not read


def test_span_stream_is_replayed(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [("t", str(k), NOW + dt.timedelta(seconds=k), None) for k in range(5)], 0)
    sink = SpanSink(spark, str(tmp_path / "spans"))
    stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in" / "*"))
    for check in ("a", "b"):  # a lost checkpoint: the same batch comes again
        q = sink.stream(stream, "one").option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["span_id"] for r in sink.spans().collect()) == ["0", "1", "2", "3", "4"]


def test_spans_of_work_and_of_all_errors(spark, tmp_path):
    sink = SpanSink(spark, str(tmp_path / "spans"))
    slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
    done = sink.call("slow", lambda: spark.range(2).coalesce(1).select(slow("id").alias("id")), "t", agent_id="me", cost_usd=0.5)
    assert sorted(r["id"] for r in done.collect()) == [0, 1]
    assert sink.call("analysis", lambda: spark.range(1).select("nothing"), "t") is None
    assert sink.call("work", lambda: spark.range(1).select(F.raise_error(F.lit("at /root/x for a@b.co")).alias("x")), "t") is None
    assert sink.call("key", lambda: {}["x"], "t") is None
    rows = {r["tool"]: r for r in sink.spans().collect()}
    assert rows["slow"]["duration_ms"] >= 1000 and rows["slow"]["error"] is None and rows["slow"]["result_size"] == 2 and rows["slow"]["agent_id"] == "me"
    assert all(rows[t]["error"] for t in ("analysis", "work", "key")) and "a@b.co" not in rows["work"]["error"]
    assert telemetry.replay_summary(sink.spans(), "t").first()["errors"] == 3


def test_latency_stream(spark, tmp_path):
    rows = [("t", "1", NOW, 10.0, None), ("t", "2", NOW + dt.timedelta(minutes=5), 30.0, "e"), ("u", "3", NOW + dt.timedelta(minutes=70), 5.0, None), ("u", "4", NOW + dt.timedelta(hours=9), 5.0, None)]
    schema = "tool string, span_id string, timestamp timestamp, duration_ms double, error string"
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        q = streams.latency_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if not k:
            spark.createDataFrame(rows[3:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    got = {(r["start"].astimezone(dt.UTC).hour, r["tool"]): (r["n"], r["avg_ms"], r["max_ms"], r["errors"]) for r in spark.read.parquet(out).collect()}
    assert got == {(12, "t"): (2, 20.0, 30.0, 1), (13, "u"): (1, 5.0, 5.0, 0)}
