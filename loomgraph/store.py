"""A graph as a set of tables, kept as versioned Parquet snapshots."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import TABLES

#: Spark's setting that a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class GraphStore:
    """The tables of a graph. Operators read them; changes give a new store."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    metadata: DataFrame
    audit_log: DataFrame
    telemetry_spans: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> GraphStore:
        """Missing tables are empty, missing columns null."""
        full = {}
        for name, schema in TABLES.items():
            df = tables.get(name)
            if df is None:
                df = spark.createDataFrame([], schema)
            full[name] = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        return cls(**full)

    def with_(self, **tables: DataFrame) -> GraphStore:
        return replace(self, **tables)

    def views(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def save(self, path: str, version: str) -> None:
        for name, df in self.views().items():
            df.write.mode("errorifexists").parquet(f"{path}/version={version}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str) -> GraphStore:
        return cls.of(spark, **{name: spark.read.schema(schema).parquet(f"{path}/version={version}/{name}") for name, schema in TABLES.items()})


def shared_place(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names. Where the setting is unset, one machine uses its temporary
    folder; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def until_the_end(spark: SparkSession, path: str) -> str:
    """Marks a folder that is there to go when the session ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new empty folder that all machines share, until the session ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_place(spark, name))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return until_the_end(spark, place.toString())


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, what is shuffled for a write or a count goes as soon as that ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settled(df: DataFrame, name: str = "round", path: str | None = None) -> DataFrame:
    """df as a table in a shared folder of its own (path, if given), read back: the lineage of a loop's rounds ends there, and no executor's loss undoes them.
    What was shuffled to make it goes as soon as it is written, the table when the session ends or it is dropped."""
    spark, schema = df.sparkSession, df.schema
    path = path or shared_place(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(until_the_end(spark, path))


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes the folder of a settled table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
