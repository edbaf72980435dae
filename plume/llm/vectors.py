"""Helpers of the operators on vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm.common import discard, stored

#: Parts that are folded into one at a time.
FAN_IN = 16


def finite(x: Column) -> Column:
    """Whether an array of numbers is there and all of its entries are finite numbers."""
    v = x.cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def commonest_length(vectors: DataFrame) -> int:
    """The most frequent length of column x, the smaller of two; 0 without rows."""
    found = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def folded(parts: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray | None:
    """All matrices of ``parts`` (part, data as bytes of doubles) combined, ``FAN_IN`` at a time; None without any.

    Each round is written, so that neither a task nor the driver has more
    than ``FAN_IN`` of them.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out = None
        for data in group.sort_values("part")["data"]:
            x = np.frombuffer(data, dtype=float).reshape(shape)
            out = x if out is None else combine(out, x)
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "data": [np.ascontiguousarray(out).tobytes()]})

    now = stored(parts, "parts")
    while now.count() > FAN_IN:
        step = stored(now.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(fold, "part long, data binary"), "parts")
        discard(now)
        now = step
    out = None
    for row in now.orderBy("part").collect():  # at most FAN_IN
        x = np.frombuffer(row["data"], dtype=float).reshape(shape)
        out = x if out is None else combine(out, x)
    discard(now)
    return out
