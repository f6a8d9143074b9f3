"""Snapshots of a graph that appear whole or not at all, and changes that rewrite only the files they touch."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.commits import Commits
from loomgraph.schema import TABLES
from loomgraph.store import GraphStore, settled

#: Tables that are dealt into buckets by a key; the others only grow, each change adds a folder.
KEYS = {"nodes": "id", "edges": "id", "communities": "node_id", "metadata": "key"}
BUCKETS = 64


class Snapshots:
    """A folder with the versions of a graph. Rows of a table lie by buckets of their key's hash; a version's manifest names
    the folder of each bucket, so versions share what has not changed, and a reader of one is not disturbed by the
    next. A stopped write leaves files that no version names: `sweep` removes them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.commits, self.buckets = spark, path.rstrip("/"), Commits(spark, path), buckets

    def versions(self) -> list[int]:
        return self.commits.versions()

    def bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def put(self, name: str, rows: DataFrame, buckets: int, only: Iterable[int] | None = None) -> dict[str, str]:
        """Writes rows of a table; bucket and folder of what was written. only: the buckets that rows may be of, the empty among them
        too."""
        folder = f"data/{uuid.uuid4().hex}/{name}"
        rows = rows.select(*(f.name for f in TABLES[name]))
        key = KEYS[name]
        dealt = rows.withColumn("bucket", self.bucket(key, buckets))
        # by buckets, of which adaptive execution makes more files where they are large; ranges would take a sample, and so make the rows twice
        dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = {n.removeprefix("bucket=") for n in self.commits.listed(f"{self.path}/{folder}") if n.startswith("bucket=")}
        return {str(b): f"{folder}/bucket={b}" if str(b) in there else "" for b in (range(buckets) if only is None else only)}

    def add(self, name: str, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}/{name}"
        rows.select(*(f.name for f in TABLES[name])).write.parquet(f"{self.path}/{folder}")
        return folder

    def save(self, store: GraphStore) -> int:
        """All of the store as the next version."""
        number = self.commits.claim(self.commits.latest())
        try:
            tables = {n: self.put(n, df, self.buckets) if n in KEYS else [self.add(n, df)] for n, df in store.views().items()}
            self.commits.commit(number, {"buckets": self.buckets, "tables": tables})
        except BaseException:
            self.commits.abandon(number)
            raise
        return number

    def load(self, version: int | None = None) -> GraphStore:
        manifest = self.commits.read(version)
        return GraphStore.of(self.spark, **{n: self.read(n, manifest) for n in TABLES})

    def read(self, name: str, manifest: dict, only: Iterable[int] | None = None) -> DataFrame:
        """A table of a version, or some of its buckets."""
        places = manifest["tables"][name]
        if isinstance(places, dict):
            places = [places[str(b)] for b in (sorted(map(int, places)) if only is None else only)]
        folders = [f"{self.path}/{p}" for p in places if p]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def merge(self, version: int, changed: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> int:
        """The next version after `version`: changed, rows by table, take the place of those of their keys; gone, keys by table,
        go. Rows of tables without a key are added. Only buckets with such keys are read and written."""
        changed, gone = changed or {}, gone or {}
        manifest = self.commits.read(version)
        number = self.commits.claim(version)
        try:
            tables = dict(manifest["tables"])
            for name in {*changed, *gone}:
                if name not in KEYS:
                    tables[name] = [*tables[name], self.add(name, changed[name])]
                    continue
                key, n = KEYS[name], manifest["buckets"]
                keys = [df.select(F.col(key).alias("__key")) for df in (changed.get(name), gone.get(name)) if df is not None]
                keys = settled(reduce(DataFrame.unionAll, keys).distinct(), "keys")
                touched = sorted(r["b"] for r in keys.select(self.bucket("__key", n).alias("b")).distinct().collect())  # numbers below the buckets
                old = self.read(name, manifest, touched)
                rows = old.join(keys, old[key] == keys["__key"], "left_anti")
                if name in changed:
                    rows = rows.unionByName(changed[name].select(*(f.name for f in TABLES[name])))
                tables[name] = {**tables[name], **self.put(name, rows, n, touched)}
            self.commits.commit(number, {"buckets": manifest["buckets"], "tables": tables})
        except BaseException:
            self.commits.abandon(number)
            raise
        return number

    def merge_nodes(self, version: int, store: GraphStore, result: DataFrame) -> int:
        """After add_nodes or upsert_nodes: store is the new one, result the table beside it. Created and updated nodes are merged, audit entries
        of these nodes that the version lacks are added."""
        ids = result.where(F.col("status").isin("created", "updated")).select("id").distinct()
        return self.merge(version, {"nodes": store.nodes.join(ids, "id", "left_semi"), **self.audit(version, store)})

    def merge_edges(self, version: int, store: GraphStore, result: DataFrame) -> int:
        ids = result.where(F.col("status").isin("created", "updated")).select("id").distinct()
        return self.merge(version, {"edges": store.edges.join(ids, "id", "left_semi"), **self.audit(version, store)})

    def merge_deleted(self, version: int, store: GraphStore, result: DataFrame) -> int:
        """After delete_nodes. The edges that went with the nodes are found in the version."""
        ids = result.where("deleted = 1").select("id")
        before = self.load(version)
        end = ids.select(F.col("id").alias("end"))
        lost = [before.edges.join(end, F.col(c) == F.col("end"), "left_semi").select("id") for c in ("source_id", "target_id")]
        return self.merge(version, self.audit(version, store), {"nodes": ids, "edges": lost[0].unionAll(lost[1]), "communities": ids.select(F.col("id").alias("node_id"))})

    def audit(self, version: int, store: GraphStore) -> dict[str, DataFrame]:
        """The log's entries that the version lacks, as often as it lacks them."""
        return {"audit_log": store.audit_log.exceptAll(self.load(version).audit_log)}

    def sweep(self, keep: Iterable[int] | None = None) -> list[str]:
        """Removes data folders that no version to keep (all, if not given) names, and manifests of the others; not while a writer is at work.
        Returns the folders."""
        there = set(self.versions())
        keep = there if keep is None else there & set(keep)
        if there and max(there) not in keep:
            raise ValueError("the last version stays")
        named = set()
        for v in keep:
            for places in self.commits.read(v)["tables"].values():
                named |= {p.split("/")[1] for p in (places.values() if isinstance(places, dict) else places) if p}
        for v in there - keep:
            self.commits.remove(f"{self.commits.folder}/{v:010d}.json")
        gone = [n for n in self.commits.listed(f"{self.path}/data") if n not in named]
        for n in gone:
            self.commits.remove(f"{self.path}/data/{n}")
        return gone
