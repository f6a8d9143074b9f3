"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

#: Pivots of each dimension: the vectors whose ids hash lowest, a bounded sample.
PIVOTS = 64
#: Bytes of an annulus of the index, and queries that meet one at a time (in expectation).
ANNULUS_BYTES, QUERIES = 1 << 20, 512
#: Annuli that a query visits before it has a bound.
FIRST = 2


def grid(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null if the vector is null, or a component is null or not finite. An
    error if a finite component leaves the 64-bit range."""

    def whole(v: Column) -> Column:
        x = F.lit(float(scale)) * v.cast("double")
        return F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(F.raise_error(F.lit("a component leaves the 64-bit range")).cast("long"))

    finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(F.col(vector), whole))


class Lifted:
    """Vectors of one dimension with one more component that gives all the same length: nearer then is the same as
    of higher inner product. A query's is 0."""

    def __init__(self, most: int):
        self.most = most

    def rows(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.hstack([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(axis=1)))[:, None]])

    @staticmethod
    def query(v: np.ndarray) -> np.ndarray:
        return np.hstack([v.astype(np.float64), np.zeros((len(v), 1))])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def stored_kind(most: int) -> type:
    """What holds every component of vectors of a squared length of at most most."""
    return np.int32 if most < 2**62 else np.int64


def stacked(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The lists of those rows of a column, all of dim numbers, as a matrix."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def pivot_index(vectors: DataFrame, pivots: dict[int, np.ndarray], most: dict[int, int]) -> DataFrame:
    """annulus, dim, pivot, low, high, ids, matrix: the vectors (id, v) keyed by their nearest pivot and their distance
    to it, sorted, and cut to annuli of up to ANNULUS_BYTES. A vector that many rows share fills several."""

    def keyed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            nearest, distance = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                lifted = Lifted(most[dim])
                d = lifted.distances(lifted.rows(stacked(batch.column("v"), rows, dim)), lifted.rows(pivots[dim]))
                nearest[rows], distance[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(distance)], ["id", "v", "dim", "pivot", "distance"])

    def cut(batches):
        held: list[tuple] = []

        def annulus():
            dim, pivot = held[0][0], held[0][1]
            part = sorted(held, key=lambda r: r[3])
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "dim": dim,
                        "pivot": pivot,
                        "low": min(r[2] for r in held),
                        "high": max(r[2] for r in held),
                        "ids": np.array([r[3] for r in part], np.int64).tobytes(),
                        "matrix": np.array([r[4] for r in part], stored_kind(most[dim])).tobytes(),
                    }
                ],
                pa.schema([("dim", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("matrix", pa.binary())]),
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "pivot", "distance", "id", "v"))):
                if held and (held[0][:2] != row[:2] or len(held) * max(1, row[0]) * np.dtype(stored_kind(most[row[0]])).itemsize >= ANNULUS_BYTES):
                    yield annulus()
                    held = []
                held.append(row)
        if held:
            yield annulus()

    rows = vectors.mapInArrow(keyed, "id long, v array<bigint>, dim int, pivot int, distance double")
    rows = rows.repartitionByRange("dim", "pivot", "distance", "id").sortWithinPartitions("dim", "pivot", "distance", "id")
    annuli = rows.mapInArrow(cut, "dim int, pivot int, low double, high double, ids binary, matrix binary")
    return stored(annuli.withColumn("annulus", F.monotonically_increasing_id()), "annuli")


def best_of(pairs: DataFrame, annuli: DataFrame, queries: DataFrame, n_queries: int, most: dict[int, int], k: int) -> DataFrame:
    """query_id, id, score: the k best of each annulus for each query that pairs (query_id, annulus) sends there."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, ids = row["dim"], np.frombuffer(row["ids"], np.int64)
                kind = np.float64 if most[dim] < 2**52 else np.int64 if most[dim] < 2**62 else object  # sums stay exact
                matrix = np.frombuffer(row["matrix"], stored_kind(most[dim])).reshape(len(ids), dim).astype(kind)
                asked = np.array([q["query_id"] for q in row["asked"]])
                vectors = np.array([q["v"] for q in row["asked"]], kind).reshape(len(asked), dim)
                scores = vectors @ matrix.T
                out = [], [], []
                for q, row_scores in zip(asked.tolist(), scores):
                    order = np.argsort(-row_scores, kind="stable")[: k + 1 + int((ids == q).sum())]  # ids rise
                    order = order[ids[order] != q][:k]
                    out[0].append(np.full(len(order), q))
                    out[1].append(ids[order])
                    out[2].append(row_scores[order].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "id", "score"])

    groups = max(1, -(-n_queries // QUERIES))
    asked = pairs.join(queries.select("query_id", "v"), "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    asked = asked.groupBy("annulus", "part").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    rows = asked.join(annuli.select("annulus", "dim", "ids", "matrix"), "annulus").select("dim", "ids", "matrix", "asked")
    return rows.mapInArrow(work, "query_id long, id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row of vectors where is_query holds, the k rows of other ids with the
    highest inner product of floor(1024 * x), ties to the smaller id; all rows, if there are fewer.

    Each query first visits the FIRST annuli nearest to it around its nearest pivot. The k-th score found
    there bounds the distance of anything better; by the triangle inequality such a vector lies, for
    every pivot, in annuli whose distance differs from the query's by no more. Those are visited, no others.

    Null vectors, ones with null or non-finite components and null ids take no part; an empty table gives
    an empty one. Numbers or scores beyond 64 bits are an error. Vectors of different dimensions are not compared. Rows that repeat
    an id and its vector are one; of an id with several vectors each is searched and found. Other columns
    play no part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), grid(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and v is not null").distinct().withColumn("dim", F.size("v"))
    rows = stored(rows, "vectors")
    length = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda n, x: (n + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    most = {r["dim"]: int(r["most"]) for r in rows.groupBy("dim").agg(F.max(length).alias("most")).collect()}
    result = "query_id long, rank int, vec_id long, score long"
    if not most:
        return spark.createDataFrame([], result)
    pivots = {}
    for dim in most:  # one or a few
        chosen = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS)
        pivots[dim] = np.array([r["v"] for r in chosen.collect()], np.int64).reshape(-1, dim)
    plain = rows.select("id", "v", "dim")
    annuli = pivot_index(plain, pivots, most)
    queries = stored(rows.where("asks").select(F.col("id").alias("query_id"), "v", "dim"), "queries")
    n_queries = queries.count()

    def to_pivots(batches):
        for batch in batches:
            for q, v, dim in zip(*(batch.column(c).to_pylist() for c in ("query_id", "v", "dim"))):
                d = Lifted.distances(Lifted.query(np.array([v], np.int64)), Lifted(most[dim]).rows(pivots[dim]))[0]
                reach = float(sum(x * x for x in v) + most[dim])  # squared lengths of both
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n), pa.array([dim] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(d), pa.array([reach] * n), pa.array(d == d.min())], ["query_id", "dim", "pivot", "d", "reach", "nearest"])

    sides = queries.mapInArrow(to_pivots, "query_id long, dim int, pivot int, d double, reach double, nearest boolean")
    sides = stored(sides, "pivot-distances")
    keys = annuli.select("annulus", "dim", "pivot", "low", "high")
    gap = F.greatest(F.lit(0.0), F.col("d") - F.col("high"), F.col("low") - F.col("d"))
    near = sides.where("nearest").join(keys, ["dim", "pivot"]).withColumn("gap", gap)
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "annulus"))).where(F.col("nth") <= FIRST)
    near = stored(near.select("query_id", "annulus").distinct(), "first-annuli")
    found = stored(best_of(near, annuli, queries, n_queries, most, k), "first-found")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    bound = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    # a vector at this distance or more scores (reach - gap**2) / 2 at most; half a point for rounding, and what the
    # distances' own rounding can make of it: up to the root of their squares' where they are near 0
    slack = 0.5 + 10 * F.col("reach") * F.sqrt((F.col("dim") + 4) * 2.0**-53)
    reached = sides.join(bound, "query_id", "left").join(keys, ["dim", "pivot"]).where(F.col("bound").isNull() | ((F.col("reach") - gap * gap) / 2 + slack >= F.col("bound")))
    rest = reached.select("query_id", "annulus").distinct().join(near, ["query_id", "annulus"], "left_anti")
    found = found.unionAll(best_of(rest, annuli, queries, n_queries, most, k)).distinct()
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
