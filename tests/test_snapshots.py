"""Versions of a graph on disk."""

import datetime as dt
from pathlib import Path

import pytest

from loomgraph.operators import mutate
from loomgraph.snapshots import Snapshots
from loomgraph.store import GraphStore

NOW = dt.datetime(2024, 1, 1)
ITEM = "nth long, label string, name string"


def rows(df):
    return sorted(map(repr, df.collect()))


def same(a: GraphStore, b: GraphStore):
    for name, df in a.views().items():
        assert rows(df) == rows(b.views()[name]), name


@pytest.fixture
def store(spark):
    nodes = spark.createDataFrame([(k, "Tag", f"n{k}", f"tag:n{k}", "{}", "EXTRACTED", "s") for k in range(500)], "id long, label string, name string, qualified_name string, properties string, provenance string, source string")
    edges = spark.createDataFrame([(k, k, (k * 7) % 500, "about", 1.0) for k in range(500)], "id long, source_id long, target_id long, type string, weight double")
    members = spark.createDataFrame([(k, k % 3, "manual") for k in range(50)], "node_id long, community_id long, algorithm string")
    return GraphStore.of(spark, nodes=nodes, edges=edges, communities=members)


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_rows_are_made_once(spark, tmp_path, store):
    made = spark.sparkContext.accumulator(0)

    def counted(df):
        def work(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return df.mapInArrow(work, df.schema)

    snaps = Snapshots(spark, str(tmp_path / "s"), buckets=8)
    one = snaps.save(store.with_(edges=counted(store.edges)))
    assert made.value == 500
    same(snaps.load(one), store)
    gone = counted(spark.range(40, 50))
    two = snaps.merge(one, gone={"nodes": gone})
    assert made.value == 510
    assert sorted(r["id"] for r in snaps.load(two).nodes.collect()) == [k for k in range(500) if not 40 <= k < 50]


def test_changes_rewrite_what_they_touch(spark, tmp_path, store):
    path = str(tmp_path / "s")
    snaps = Snapshots(spark, path, buckets=32)
    one = snaps.save(store)
    same(snaps.load(), store)
    before = files(path)
    up = spark.createDataFrame([(k, "Tag", f"n{k * 3}") for k in range(3)] + [(9, "Tag", "fresh")], ITEM)
    new, result = mutate.upsert_nodes(store, up, NOW)
    two = snaps.merge_nodes(one, new, result)
    same(snaps.load(two), new)
    written = {f for f in files(path) - before if "/nodes/" in f}
    assert 1 <= len(written) <= 4 and not [f for f in files(path) - before if "/edges/" in f]
    new2, result = mutate.add_edges(new, spark.createDataFrame([(0, "1", "2", "about"), (1, "3", "tag:n21", "about")], "nth long, source string, target string, type string"), NOW)
    three = snaps.merge_edges(two, new2, result)
    same(snaps.load(three), new2)
    new3, result = mutate.delete_nodes(new2, spark.range(0, 3), NOW)
    four = snaps.merge_deleted(three, new3, result)
    same(snaps.load(four), new3)
    same(snaps.load(one), store)  # what was read is still there
    assert snaps.versions() == [1, 2, 3, 4]
    snaps.sweep()
    same(snaps.load(two), new)
    snaps.sweep(keep=[3, 4])
    same(snaps.load(3), new2)
    same(snaps.load(4), new3)
    assert snaps.versions() == [3, 4]
    with pytest.raises(ValueError):
        snaps.load(1)
    with pytest.raises(ValueError):
        snaps.sweep(keep=[3])


def test_stopped_writes(spark, tmp_path, store, monkeypatch):
    snaps = Snapshots(spark, str(tmp_path / "s"), buckets=4)
    put = Snapshots.put

    def stopped(self, name, *a):
        if name == "edges":
            raise KeyboardInterrupt
        return put(self, name, *a)

    monkeypatch.setattr(Snapshots, "put", stopped)
    with pytest.raises(KeyboardInterrupt):
        snaps.save(store)
    assert snaps.versions() == []
    with pytest.raises(ValueError):
        snaps.load()
    monkeypatch.undo()
    one = snaps.save(store)
    same(snaps.load(), store)
    assert len(snaps.sweep()) >= 1
    same(snaps.load(), store)
    snaps.merge(one, {"nodes": store.nodes.limit(1)})
    with pytest.raises(ValueError):  # somebody was faster
        snaps.merge(one, {"nodes": store.nodes.limit(1)})


def test_empty_and_null_keys(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path / "s"))
    one = snaps.save(GraphStore.of(spark))
    same(snaps.load(), GraphStore.of(spark))
    meta = spark.createDataFrame([("a", "1"), (None, "2")], "key string, value string")
    two = snaps.merge(one, {"metadata": GraphStore.of(spark, metadata=meta).metadata})
    assert sorted(r["value"] for r in snaps.load(two).metadata.collect()) == ["1", "2"]
    three = snaps.merge(two, gone={"metadata": meta.where("key = 'a'")})
    assert [r["value"] for r in snaps.load(three).metadata.collect()] == ["2"]
