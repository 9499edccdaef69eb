"""Principal components: moments by one pass of partial sums, a small eigenproblem on the driver, projection over Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.ship import ship

@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    axes: np.ndarray
    kept: float


def _means(rows: DataFrame, vector: str) -> np.ndarray:
    found = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    return np.array([r.m for r in found])


def covariances(rows: DataFrame, vector: str = "v") -> DataFrame:
    """(i, j, mean, covariance): the mean of component i and its population covariance with j, over all rows, for all i and j.

    Each task adds up the outer products of its centred blocks and emits the square of sums once; these are added by (i, j), so a
    task sends dimensions^2 numbers whatever its rows. Vectors have one length and no nulls.
    """
    ship(rows.sparkSession)
    mean = _means(rows, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(mean), len(mean))), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(mean)) - mean
            total += x.T @ x
            n += len(x)
        if n:
            i, j = np.divmod(np.arange(total.size), len(mean))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel()), pa.array(np.full(total.size, n))], ["i", "j", "s", "n"])

    sums = rows.select(vector).mapInArrow(run, "i int, j int, s double, n long").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("covariance"))
    means = F.array(*(F.lit(float(m)) for m in mean))
    return sums.select("i", "j", F.get(means, F.col("i")).alias("mean"), "covariance")


def fit(rows: DataFrame, dimensions: int, vector: str = "v", key: str = "passage_id") -> Model:
    """The leading axes of all rows' covariance; the driver holds dimensions^2 numbers."""
    mean = _means(rows, vector)
    cov = np.zeros((len(mean), len(mean)))
    for r in covariances(rows, vector).collect():
        cov[r.i, r.j] = r.covariance
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(-values)[:dimensions]
    return Model(mean, axes[:, top], float(values[top].sum() / max(values.sum(), 1e-12)))


def project(rows: DataFrame, model: Model, vector: str = "v", key: str = "passage_id") -> DataFrame:
    """(key, v): centred, projected, divided by the length plus 1e-9."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(model.mean))
            y = (x - model.mean) @ model.axes
            y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], [key, "v"])

    return rows.select(key, F.col(vector)).mapInArrow(run, f"{key} long, v array<double>")
