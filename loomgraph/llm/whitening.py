"""Whitening of embeddings: principal components by the singular values of centred, distributed rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored
from loomgraph.llm.topk import grid

#: Singular values under this share of the largest are rounding, and their directions no components.
SMALLEST = 1e-7


class Whitening:
    """A fit: n vectors, their sums S per dimension, the mean as doubles, directions (a row a component), variance of each, and the trace of
    the covariance."""

    def __init__(self, n: int, sums: list[int], directions: np.ndarray, variances: np.ndarray, trace: float):
        self.n, self.sums, self.directions, self.variances, self.trace = n, sums, directions, variances, trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, centred, on each component over its deviation. n * x - S is exact, so only it is rounded."""
        centred = exact_deviations(x, self.n, self.sums).astype(np.float64) / self.n
        return centred @ self.directions.T / np.sqrt(self.variances)


def exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers: in 64 bits where these hold all of it, else of any size."""
    most = max((abs(s) for s in sums), default=0) + n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most >= 2**63:
        x = x.astype(object)
    return x * n - np.array(sums, dtype=x.dtype)


def squares(deviations: np.ndarray) -> list[int]:
    """Of each row the exact sum of squares; ValueError where one leaves the 64-bit range."""
    most = max(abs(int(deviations.max(initial=0))), abs(int(deviations.min(initial=0)))) if deviations.size else 0
    if most * most * max(1, deviations.shape[1]) >= 2**63:
        deviations = deviations.astype(object)
    sums = [int(s) for s in (deviations * deviations).sum(axis=1)]
    if max(sums, default=0) >= 2**63:
        raise ValueError("a deviation leaves the 64-bit range")
    return sums


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def fit_whitening(distinct: DataFrame, dim: int, k: int = 4) -> Whitening | None:
    """The first k components of the vectors x (whole numbers, each once, all of dim entries); None without any.

    Sums and deviations are exact. The rows, centred, are a RowMatrix whose Gramian is summed up where the rows are; only
    dim x dim numbers reach the driver. A singular value s of n rows is the variance s * s / n. The trace is
    no sum of variances found, but of all rows' exact deviations: sum of (n * x - S)**2 over n**3.
    """
    n = distinct.count()
    if not n or not dim:
        return None
    sums = distinct.agg(*(F.sum(F.col("x")[j].cast("decimal(38,0)")).alias(str(j)) for j in range(dim))).first()
    sums = [int(s) for s in sums]

    def deviations(batches):
        for batch in batches:
            d = exact_deviations(matrix(batch.column(0), dim), n, sums)
            yield pa.RecordBatch.from_arrays([pa.array([str(s) for s in squares(d)]), pa.array(list(d.astype(np.float64) / n), pa.list_(pa.float64()))], ["deviation", "centred"])

    rows = stored(distinct.select("x").mapInArrow(deviations, "deviation string, centred array<double>"), "centred")
    total = int(rows.agg(F.coalesce(F.sum(F.col("deviation").cast("decimal(38,0)")), F.lit(0))).first()[0])
    if not total:
        return Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), 0.0)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("centred").alias("v")), "v")
    found = RowMatrix(vectors, n, dim).computeSVD(min(k, dim), computeU=False, rCond=SMALLEST)
    s, directions = np.array(found.s.toArray()), np.array(found.V.toArray()).T
    largest = np.abs(directions).argmax(axis=1)
    directions = directions * np.sign(directions[np.arange(len(directions)), largest])[:, None]  # one of two signs
    return Whitening(n, sums, directions, s * s / n, total / n**3)


def identity_error(distinct: DataFrame, dim: int, fit: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; means first, then the products of
    what is centred on them."""
    k = len(fit.variances)

    def work(batches):
        for batch in batches:
            w = fit.whitened(matrix(batch.column(0), dim))
            yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.list_(pa.float64()))], ["w"])

    rows = stored(distinct.select("x").mapInArrow(work, "w array<double>"), "whitened")
    means = rows.agg(*(F.avg(F.col("w")[i]).alias(str(i)) for i in range(k))).first()
    centred = [F.col("w")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = rows.agg(*(F.avg(centred[i] * centred[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(p - (i == j)) for p, (i, j) in zip(products, pairs))


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    A component c becomes x = floor(scale * c). Vectors that are null, or hold null or non-finite numbers, take no part; nor do
    those of another length than most have (of two lengths as frequent, the longer). The fit is of each distinct x
    once, so copies weigh nothing; every row gets its coordinates, also of a null or repeated id. Components are
    numbered from 1 by falling variance, their largest entry positive; there are fewer than k where the vectors lie in
    fewer dimensions (singular values under a ten-millionth of the largest are none): none for a single vector or an empty table. Other
    columns of any name play no part. Numbers beyond 64 bits are an error.
    """
    rows = embeddings.select(F.col(id_col).alias("vec_id"), grid(vector_col, scale).alias("x")).where("x is not null")
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if size is None or not size["dim"]:
        return spark.createDataFrame([], schema)
    dim = size["dim"]
    rows = stored(rows.where(F.size("x") == dim), "vectors")
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    fit = fit_whitening(distinct, dim, k)
    if not len(fit.variances):
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, dim, fit)
    shares = fit.variances / fit.trace

    def work(batches):
        m = len(shares)
        for batch in batches:
            x = matrix(batch.column(1), dim)
            d = exact_deviations(x, fit.n, fit.sums)
            size = len(x) * m
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m))).cast(pa.int64()),
                pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()),
                pa.array(np.full(size, fit.n), pa.int64()),
                pa.array(np.repeat(np.array(squares(d), np.int64), m)),
                pa.array(fit.whitened(x).ravel()),
                pa.array(np.tile(shares, len(x))),
                pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(work, schema)
