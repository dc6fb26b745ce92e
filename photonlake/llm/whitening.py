"""Whitening of embeddings by merged moments.

Each task keeps the count, the mean and the centred scatter of its vectors; pairs of such states merge by Chan's formula
in a tree of tasks, so the driver gets a few matrices of d * d. It takes their eigenvectors, and a second pass finds the
covariance of what comes out in the same way.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Batches, Workspace, mapped
from .vectors import extent, matrix, quantised

SCALE, COMPONENTS = 64, 32
#: States that one task, and at last the driver, merges.
FAN_IN = 8
#: Rows of a batch that comes out.
ROWS = 1 << 16


@dataclass
class Moments:
    """Count, mean and centred scatter of vectors, and their sums as exact integers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0, dtype=np.float64)
        centred = x - mean
        return cls(len(x), mean, centred.T @ centred, x.sum(axis=0).tolist())

    def merged(self, other: Moments) -> Moments:
        n, delta = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + delta * (other.n / n), self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n), [a + b for a, b in zip(self.sums, other.sums, strict=True)])


def moments(points: DataFrame, length: int, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments:
    """The moments of change(x) over all rows, of which there has to be one."""

    def local(batches: Batches) -> Batches:
        state = None
        for batch in batches:
            if len(batch):
                own = Moments.of(change(matrix(batch.column("x"), length)))
                state = state.merged(own) if state else own
        if state:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]})

    states = mapped(points.select("x"), local, "state binary").rdd.map(lambda r: pickle.loads(bytes(r.state)))
    depth = max(2, math.ceil(math.log(max(states.getNumPartitions(), 2), FAN_IN)))
    return states.treeReduce(Moments.merged, depth)


@dataclass(frozen=True)
class Whitener:
    """Means as a count and integer sums, and unit eigenvectors of the covariance by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, m: Moments, components: int = COMPONENTS) -> Whitener:
        covariance = m.scatter / m.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        if len(values):
            vectors = vectors * np.sign(vectors[abs(vectors).argmax(axis=0), np.arange(len(values))])
        # below the precision of the covariance there is no direction to tell
        real = int((values > max(values[:1].sum(), 0) * len(values) * np.finfo(np.float64).eps).sum())
        values = np.where(np.arange(len(values)) < real, values, 0.0)
        return cls(m.n, m.sums, values[:components], vectors[:, :components], float(np.trace(covariance)))

    @property
    def rank(self) -> int:
        return int((self.values > 0).sum())

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in longs."""
        return x * self.n - np.array(self.sums, np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The whitened components that have a variance."""
        k = self.rank
        return (self.scaled(x) / self.n) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def whitened(points: DataFrame, length: int, by: Whitener, identity_error: float, wide: bool = False) -> DataFrame:
    """A row for each row of points and component; deviations are decimals if wide."""
    k, k_all = by.rank, len(by.values)
    explained = [v / by.trace if by.trace else None for v in by.values.tolist()]
    kind = dict(points.dtypes)["vec_id"]

    def rows(batches: Batches) -> Batches:
        for whole in batches:
            for start in range(0, len(whole), max(1, ROWS // k_all)):
                batch = whole.slice(start, max(1, ROWS // k_all))
                x = matrix(batch.column("x"), length)
                scaled, out = by.scaled(x), np.full((len(x), k_all), np.nan)
                out[:, :k] = by(x)
                squares = ((scaled.astype(object) if wide else scaled) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k_all))),
                    "component": pa.array(np.tile(np.arange(1, k_all + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(x) * k_all, by.n)),
                    "deviation": pa.array(np.repeat(squares, k_all).tolist(), pa.decimal128(38) if wide else pa.int64()),
                    "whitened": pa.array(out.ravel(), from_pandas=True),
                    "explained": pa.array(explained * len(x), pa.float64()),
                    "identity_error": pa.array(np.full(len(x) * k_all, identity_error)),
                })

    return mapped(points, rows, f"vec_id {kind}, component int, n long, deviation {'decimal(38,0)' if wide else 'long'}, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable vector and component.

    Vectors that are null or hold null or non-finite components go. Repeated rows count as often as they are there; a
    null vec_id is kept; equal eigenvalues have any basis of their plane, the same for all rows. A component without
    variance (constant dimensions, fewer vectors than dimensions) has a null whitened and is no part of identity_error;
    where all vectors are equal, explained is null too. Fewer dimensions give fewer components. An empty table gives no
    rows; further columns are ignored. Vectors of different lengths raise. Integers are taken 1,000,000 lower than the
    contract has them, which changes none of these columns; deviation is a decimal where so many vectors are there that
    no long need hold it.
    """
    work = Workspace(embeddings.sparkSession, "whitening")
    points = work.stage(quantised(embeddings, SCALE, "vec_id"), "points")
    n, length, largest = extent(points)
    if not n or not length:
        return points.selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").where("false")
    by = Whitener.of(moments(points, length), components)
    error = 0.0
    if by.rank:
        check = moments(points, length, by)
        error = float(abs(check.scatter / check.n - np.eye(by.rank)).max())
    return whitened(points, length, by, error, wide=length * (2 * n * largest) ** 2 >= 1 << 63)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
