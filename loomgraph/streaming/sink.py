"""Spans that are kept: a table in a folder, to which batches of a stream and single calls are added once each."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomgraph.commits import Commits
from loomgraph.operators.telemetry import emitted
from loomgraph.schema import SPANS

T = TypeVar("T")


class SpanSink:
    """A folder of batches, each in a folder of its own that bears the name of who wrote it and its number. A batch that is
    written again, as a stream does that starts anew after a failure, takes the place of its first try, whether that was
    whole or not; readers see batches that are whole. Columns are those of the spans' table; others are left out, missing ones null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Commits(spark, path)

    def add(self, spans: DataFrame, writer: str, number: int | str) -> None:
        rows = spans.select(*((F.col(f.name) if f.name in spans.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SPANS))
        rows.write.mode("overwrite").parquet(f"{self.path}/{writer}/{number}")

    def stream(self, spans: DataFrame, writer: str) -> DataStreamWriter:
        """A stream's writer that adds each batch; give it a checkpointLocation and start it. writer names the stream, for all its
        restarts, and no other stream."""
        return spans.writeStream.foreachBatch(lambda batch, number: self.add(batch, writer, number))

    def spans(self) -> DataFrame:
        whole = [
            f"{self.path}/{writer}/{number}"
            for writer in self.files.listed(self.path)
            for number in self.files.listed(f"{self.path}/{writer}")
            if "_SUCCESS" in self.files.listed(f"{self.path}/{writer}/{number}")
        ]
        return self.spark.read.schema(SPANS).parquet(*whole) if whole else self.spark.createDataFrame([], SPANS)

    def call(self, tool: str, call: Callable[[], T], trace_id: str, args: str = "", **more) -> T | None:
        """Calls an operator and keeps its span: see `emitted`."""
        result, row = emitted(None, self.spark, tool, call, trace_id, args, **more)
        self.add(row, "calls", uuid.uuid4().hex)
        return result
