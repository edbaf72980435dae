"""Rules on single rows: filters, corrections and checks as columns or filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(particles: DataFrame) -> DataFrame:
    return particles.filter((F.col("status") == 0) & F.col("z").isNotNull())


def retired(age_seconds: Column, most: float) -> Column:
    """Whether a particle has reached its greatest age."""
    return age_seconds >= most


def only(df: DataFrame, keys: tuple[str, ...], variables: tuple[str, ...]) -> DataFrame:
    """``keys`` and those of ``variables`` that ``df`` has; the scan reads no others."""
    return df.select(*keys, *[v for v in variables if v in df.columns and v not in keys])


def covered(lon: Column, lat: Column, t: Column, box: tuple[float, float, float, float], times: tuple[float, float]) -> Column:
    """Whether a source with these bounds has a place and time."""
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north) & t.between(*times)


def clipped(df: DataFrame, pixels: int) -> DataFrame:
    """Without ``pixels`` rows and columns at each edge of the grid (ix, iy)."""
    edge = df.agg(*[f(c).alias(f"{c}_{n}") for c in ("ix", "iy") for f, n in ((F.min, "low"), (F.max, "high"))])
    inside = [(F.col(c) - F.col(f"{c}_low") >= pixels) & (F.col(f"{c}_high") - F.col(c) >= pixels) for c in ("ix", "iy")]
    return df.crossJoin(F.broadcast(edge)).filter(inside[0] & inside[1]).select(df.columns)  # one row


def reindexed(df: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """The part of a grid in ``box`` (first and last ix, first and last iy), counted from 0 again."""
    x0, x1, y0, y1 = box
    return df.filter(F.col("ix").between(x0, x1) & F.col("iy").between(y0, y1)).withColumns({"ix": F.col("ix") - x0, "iy": F.col("iy") - y0})


def celsius(t: Column) -> Column:
    return F.when(t > 100, t - 273.15).otherwise(t)


def not_below(z: Column, depth: float) -> Column:
    return F.greatest(z, F.lit(-depth))


def sea_only(bathymetry: Column) -> Column:
    """Heights above the sea are 0."""
    return F.least(bathymetry, F.lit(0.0))


def deepest_if_missing(z: Column, deepest: float) -> Column:
    return F.coalesce(F.nanvl(z, F.lit(None).cast("double")), F.lit(-deepest))
