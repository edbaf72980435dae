"""Tidal harmonics by least squares: sums of products that any partition can add, solved as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speeds of tidal constituents in degrees an hour (fixed values).
SPEEDS = {"M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K1": 15.0410686, "O1": 13.9430356, "M4": 57.9682084}


def basis(hours: Column, names: list[str]) -> list[Column]:
    """1, and the cosine and sine of each constituent."""
    angles = [hours * math.radians(SPEEDS[n]) for n in names]
    return [F.lit(1.0), *[f(a) for a in angles for f in (F.cos, F.sin)]]


def normal_sums(series: DataFrame, key: str, hours: Column, value: Column, names: list[str]) -> DataFrame:
    """key, n, s{i}_{j} (i <= j) and b{i}: the normal equations of each key.

    They are plain sums, so parts are added before the shuffle and again when
    new observations come; a key with very many rows is one row of each task.
    """
    b = basis(hours, names)
    products = [F.sum(b[i] * b[j]).alias(f"s{i}_{j}") for i in range(len(b)) for j in range(i, len(b))]
    return series.filter(value.isNotNull() & hours.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *products, *[F.sum(b[i] * value).alias(f"b{i}") for i in range(len(b))])


def solved(sums: DataFrame, size: int, least: float = 1e-6) -> DataFrame:
    """``sums`` with x0, x1, ...: the solution by L D L' factors, one column at a time; null where the observations don't tell it.

    A pivot below ``least`` times its own sum of squares is none.
    """
    pivot = lambda k, v: F.when(v > least * F.col(f"s{k}_{k}"), v)
    for k in range(size):
        d = F.col(f"s{k}_{k}")
        for m in range(k):
            d = d - F.col(f"l{k}_{m}") * F.col(f"l{k}_{m}") * F.col(f"d{m}")
        sums = sums.withColumn(f"d{k}", pivot(k, d))
        below = {}
        for i in range(k + 1, size):
            v = F.col(f"s{k}_{i}")
            for m in range(k):
                v = v - F.col(f"l{i}_{m}") * F.col(f"l{k}_{m}") * F.col(f"d{m}")
            below[f"l{i}_{k}"] = v / F.col(f"d{k}")
        y = F.col(f"b{k}")
        for m in range(k):
            y = y - F.col(f"l{k}_{m}") * F.col(f"y{m}")
        sums = sums.withColumns({**below, f"y{k}": y})
    for k in range(size - 1, -1, -1):
        x = F.col(f"y{k}") / F.col(f"d{k}")
        for i in range(k + 1, size):
            x = x - F.col(f"l{i}_{k}") * F.col(f"x{i}")
        sums = sums.withColumn(f"x{k}", x)
    return sums


def constituents(series: DataFrame, key: str, hours: Column, value: Column, names: list[str]) -> DataFrame:
    """key, n, x0 (the mean level) and x1, x2, ... (cosine and sine of each constituent) by least squares."""
    size = 2 * len(names) + 1
    return solved(normal_sums(series, key, hours, value, names), size).select(key, "n", *[f"x{k}" for k in range(size)])


def amplitude(k: int) -> Column:
    """Of constituent k (from 0)."""
    return F.hypot(f"x{2 * k + 1}", f"x{2 * k + 2}")


def phase(k: int) -> Column:
    """Degrees (0 to 360) by which constituent k lags behind time 0."""
    return F.pmod(F.degrees(F.atan2(f"x{2 * k + 2}", f"x{2 * k + 1}")), F.lit(360.0))


def predicted(hours: Column, names: list[str]) -> Column:
    """The level at a time, from the columns of :func:`constituents`."""
    terms = [F.col(f"x{k}") * b for k, b in enumerate(basis(hours, names))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def filled(series: DataFrame, wanted: DataFrame, key: str, hours: str, value: str, names: list[str]) -> DataFrame:
    """key, hours, value, filled for ``wanted`` (key, hours): what was observed, else what the constituents predict.

    Observations of one key and time are averaged. A key whose observations
    don't tell its constituents is left with nulls.
    """
    observed = series.groupBy(key, hours).agg(F.avg(value).alias("seen"))
    fit = constituents(series, key, F.col(hours), F.col(value), names)
    out = wanted.join(observed, [key, hours], "left").join(fit, key, "left")
    return out.select(key, hours, F.coalesce("seen", predicted(F.col(hours), names)).alias(value), F.col("seen").isNull().alias("filled"))
