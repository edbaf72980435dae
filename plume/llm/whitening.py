"""Whitening of embeddings by a blockwise QR and a bidiagonal qd solver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm.bidiagonal import EPS, leading_directions
from plume.llm.common import discard, stored
from plume.llm.vectors import commonest_length, finite, folded

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows that are reduced to a triangle at once.
BLOCK_ROWS = 4096
#: Greatest 64 c that is told apart; beyond, entries count as this.
GREATEST = 2.0**62
SCHEMA = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Fitted statistics: rows n, sums (as whole and rest of sums / n), directions over singular values, shares of the variance."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    projection: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part is subtracted in integers."""
        return (x - self.whole).astype(float) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None beyond 64 bits."""
        y = x - self.whole
        most = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))) + 1
        if (self.n * most) ** 2 * x.shape[1] < 2**63:
            return ((self.n * y - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest.tolist())) for row in y.tolist()]
        return [v if v < 2**63 else None for v in exact]


def arrays(frames: Iterator[pd.DataFrame], column: str = "x", most: int = BLOCK_ROWS) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of at most ``most`` rows with their vectors as one matrix of integers."""
    for frame in frames:
        for at in range(0, len(frame), most):
            part = frame.iloc[at : at + most]
            yield part, np.array(part[column].tolist(), dtype=np.int64)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors x and the exact sums of their entries, summed in halves of 32 bits."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, d), np.int64)
        for _, x in arrays(frames):
            total += [(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(d, len(x))]
        yield pd.DataFrame({"place": np.arange(d), "high": total[0], "low": total[1], "n": total[2]})

    whole = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")}
    found = rows.mapInPandas(add, "place int, high long, low long, n long").groupBy("place").agg(*whole.values()).orderBy("place").collect()  # d rows
    return int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def triangle(rows: DataFrame, d: int, start: Whitening) -> np.ndarray:
    """R of a QR factorisation of all centred rows: block by block in a task, then of the tasks' triangles."""

    def square(x: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(x, mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((d, d))
        for _, x in arrays(frames):
            r = square(np.vstack([r, start.centred(x)]))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [np.ascontiguousarray(r).tobytes()]})

    return folded(rows.mapInPandas(reduce, "part long, data binary"), lambda a, b: square(np.vstack([a, b])), (d, d))


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    k = model.projection.shape[1]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k))
        for _, x in arrays(frames):
            w = model.whitened(x)
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [total.tobytes()]})

    total = folded(rows.mapInPandas(add, "part long, data binary"), np.add, (k + 1, k)) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(rows: DataFrame, d: int, components: int) -> Whitening | None:
    """The whitening of distinct vectors (column x); None if they don't vary."""
    n, total = sums(rows, d)
    whole, rest = zip(*(divmod(s, n) for s in total))
    start = Whitening(n, np.array(whole, dtype=np.int64), np.array(rest, dtype=np.int64), np.zeros((d, 0)), np.zeros(0))
    r = triangle(rows, d, start)
    values, leading, directions = leading_directions(r, components)
    keep = leading > d * EPS * values.max(initial=0.0)
    if not keep.any():
        return None
    start.projection = directions[:, keep] * (np.sqrt(n) / leading[keep])
    start.explained = leading[keep] ** 2 / (values**2).sum()
    return start


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and leading component.

    ``vectors`` has vec_id and embedding. Each entry c becomes the integer
    floor(64 c) + 1,000,000; each distinct vector x of these is a row of the
    fit. A blockwise QR factorisation reduces the centred rows to a triangle
    in each task, triangles are stacked and reduced again, ``FAN_IN`` at a
    time. The last one, of d x d, is bidiagonalised by Householder
    reflections on the driver; dqds finds its singular values, of which all
    are summed for ``explained``, and twisted factorisations the directions
    of the first ``components``. Directions of one cluster of values are made
    orthogonal within it. identity_error is measured in one more pass over
    the rows of the fit.

    Rows whose vector is null or holds null or non-finite entries, or is of
    another length than most (the smaller of two), have no result; the
    others have one row each, also if they are equal or repeat a vec_id, and
    a null vec_id stays null. Components without variance (singular values
    below d times the rounding unit of the largest) have no rows, so that
    one vector alone, or equal ones, give an empty result, as an empty table
    does. deviation is null beyond 64 bits; entries beyond 2^56 count as
    2^56. Other columns aren't looked at.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-GREATEST)), F.lit(GREATEST))).cast("long") + OFFSET)
    rows = vectors.filter(finite(F.col("embedding"))).select(F.col("vec_id").cast("string").alias("vec_id"), x.alias("x"))
    d = commonest_length(rows)
    rows = rows.filter(F.size("x") == d)
    model = None
    if d:
        distinct = stored(rows.select("x").distinct(), "distinct")
        model = fit(distinct, d, components)
        error = identity_error(distinct, d, model) if model else 0.0
        discard(distinct)
    if not model:
        return vectors.sparkSession.createDataFrame([], SCHEMA.replace("vec_id string", "vec_id long"))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(model.explained)
        for part, x in arrays(frames):
            each = lambda v: np.repeat(np.array(v, dtype=object), k)
            yield pd.DataFrame({"vec_id": each(part["vec_id"].tolist()), "component": np.tile(np.arange(1, k + 1), len(part)), "n": model.n, "deviation": each(model.deviations(x)), "whitened": model.whitened(x).ravel(), "explained": np.tile(model.explained, len(part)), "identity_error": error})

    return rows.mapInPandas(project, SCHEMA).withColumn("vec_id", F.col("vec_id").cast("long"))
