"""Vertical profiles as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_at(values: Column, z: Column) -> Column:
    """The value at fractional level ``z`` (0 is the first), held at both ends."""
    top = F.size(values) - 1
    at = F.least(F.greatest(z, F.lit(0.0)), top.cast("double"))
    low = F.least(F.floor(at), top - 1).cast("int")
    w = at - low
    return F.get(values, low) * (1 - w) + F.get(values, low + 1) * w


def nearest_at(values: Column, z: Column) -> Column:
    """The value of the nearest level; halves go to the even level."""
    return F.get(values, F.least(F.greatest(F.bround(z, 0).cast("int"), F.lit(0)), F.size(values) - 1))


def gradient(values: Column, dz: float = 1.0) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(values)

    def at(v: Column, i: Column) -> Column:
        low, high = F.greatest(i - 1, F.lit(0)), F.least(i + 1, n - 1)
        return (F.get(values, high) - F.get(values, low)) / ((high - low) * dz)

    return F.transform(values, at)


def z_average(values: Column, z0: Column, z1: Column) -> Column:
    """Trapezoid mean between two fractional levels, the ends interpolated."""
    inner = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda k: (k > z0) & (k < z1))
    nodes = F.concat(F.array(z0.cast("double")), F.transform(inner, lambda k: k.cast("double")), F.array(z1.cast("double")))
    heights = F.transform(nodes, lambda z: linear_at(values, z))
    parts = F.transform(nodes, lambda z, i: F.when(i > 0, (z - F.get(nodes, i - 1)) * (F.get(heights, i) + F.get(heights, i - 1)) / 2).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / (z1 - z0)


def fill_down(values: Column) -> Column:
    """Missing levels take the last value above them."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))
    step = lambda a, v: F.struct(F.coalesce(v, a["last"]).alias("last"), F.concat(a["out"], F.array(F.coalesce(v, a["last"]))).alias("out"))
    return F.aggregate(values, start, step)["out"]


def stretch(s: Column, theta_s: float, theta_b: float) -> Column:
    """Song and Haidvogel's stretching of s in [-1, 0]."""
    half = F.tanh(theta_s * (s + 0.5)) / F.tanh(F.lit(0.5 * theta_s))
    return (1 - theta_b) * F.sinh(theta_s * s) / F.sinh(F.lit(theta_s)) + theta_b * (half - 1) / 2


def s_depth(h: Column, s: Column, c: Column, critical: float, transform: int = 1) -> Column:
    """Depth (negative) of an s level over bottom depth ``h``."""
    if transform == 1:
        return critical * (s - c) + c * h
    return h * (critical * s + h * c) / (critical + h)


def at_depth(values: Column, depths: Column, z: Column) -> Column:
    """The value at depth ``z`` (positive, of falling order from the surface), linear between levels and held at both ends."""
    k = F.least(F.greatest(F.size(F.filter(depths, lambda d: d < z)), F.lit(1)), F.size(depths) - 1)
    low, high = F.get(depths, k - 1), F.get(depths, k)
    w = F.least(F.greatest((z - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.get(values, k - 1) * (1 - w) + F.get(values, k) * w


def bracket(depths: Column, z: Column) -> Column:
    """struct(low, w): the level above ``z`` and the weight of the next one, for tables of interpolation weights."""
    k = F.least(F.greatest(F.size(F.filter(depths, lambda d: d < z)), F.lit(1)), F.size(depths) - 1)
    low, high = F.get(depths, k - 1), F.get(depths, k)
    return F.struct((k - 1).alias("low"), F.least(F.greatest((z - low) / (high - low), F.lit(0.0)), F.lit(1.0)).alias("w"))


def nearest_level(depths: Column, z: Column) -> Column:
    """Index of the level nearest to ``z``, the upper one of two equally near."""
    gaps = F.transform(depths, lambda d: F.abs(d - z))
    return F.array_position(gaps, F.array_min(gaps)).cast("int") - 1


def stretch_2(s: Column, theta_s: float, theta_b: float) -> Column:
    """Shchepetkin's stretching of 2005, weighted between surface and bottom."""
    surface = (1 - F.cosh(theta_s * s)) / (F.cosh(F.lit(theta_s)) - 1)
    bottom = F.sinh(theta_b * (s + 1)) / F.sinh(F.lit(theta_b)) - 1
    w = (s + 1) * (1 + (1 - (s + 1)))
    return w * surface + (1 - w) * bottom


def stretch_4(s: Column, theta_s: float, theta_b: float) -> Column:
    """Shchepetkin's double stretching of 2010."""
    c = (1 - F.cosh(theta_s * s)) / (F.cosh(F.lit(theta_s)) - 1)
    return (F.exp(theta_b * c) - 1) / (1 - F.exp(F.lit(-theta_b)))


def sigma_tanh(levels: int, lower: Column, upper: Column) -> Column:
    """Levels from 0 to -1 that are denser at the bottom by ``lower`` and at the surface by ``upper``."""
    x = lambda k: F.tanh((lower + upper) * (levels - 2 - k) / (levels - 1) - lower)
    rest = F.transform(F.sequence(F.lit(0), F.lit(levels - 2)), lambda k: (x(k) + F.tanh(lower)) / (F.tanh(lower) + F.tanh(upper)) - 1.0)
    return F.concat(F.array(F.lit(0.0)), rest)
