"""Adaptive kernel maps: autocorrelation, window statistics on a reflected edge, and one stencil for each class of bandwidth."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def autocorrelation(grid: DataFrame, keys: tuple[str, ...], value: str, lags: int) -> DataFrame:
    """keys, lag, ac: the mean of the autocorrelations along rows and columns, each 1 at lag 0.

    A cell is told to the places of its partners, along both axes at once, so
    that one join by equality gives all lags. Cells without a row are zero.
    """
    ahead = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lags).cast("bigint"))).alias("lag")
    told = grid.select(*keys, "ix", "iy", F.col(value).alias("other"), ahead)
    axes = F.explode(F.array(F.struct(F.lit("rows").alias("axis"), (F.col("ix") + F.col("lag")).alias("ix"), F.col("iy").alias("iy")), F.struct(F.lit("columns").alias("axis"), F.col("ix").alias("ix"), (F.col("iy") + F.col("lag")).alias("iy"))))
    told = told.select(*keys, "lag", "other", axes.alias("to")).select(*keys, "lag", "other", "to.*")
    sums = told.join(grid.select(*keys, "ix", "iy", value), [*keys, "ix", "iy"]).groupBy(*keys, "lag").agg(F.sum(F.col("other") * F.col(value)).alias("p"))
    # both axes have the same product at lag 0, so the mean of their ratios is the ratio of the sums
    whole = sums.filter("lag = 0").select(*keys, F.col("p").alias("p0"))
    return sums.join(whole, list(keys)).select(*keys, "lag", (F.col("p") / F.col("p0")).alias("ac"))


def images(at: str, cells: int) -> Column:
    """Places of a cell and of its mirror images in the edges of a row of ``cells``; the edge cells themselves aren't repeated."""
    return F.array_distinct(F.array(F.col(at), -F.col(at), F.lit(2 * (cells - 1)) - F.col(at)))


def window_statistics(grid: DataFrame, keys: tuple[str, ...], count: str, shape: tuple[int, int], radius: int) -> DataFrame:
    """keys, ix, iy, s, ss, d2 for each cell of ``grid``: sums over the square window around it, reflected at the edges.

    s sums ``count``, ss its square, d2 its squared distance times the count.
    A cell sends itself and its mirror images to the windows that hold them.
    """
    offset = lambda: F.sequence(F.lit(-radius).cast("bigint"), F.lit(radius).cast("bigint"))
    nx, ny = shape
    sent = grid.select(*keys, F.col(count).alias("n"), F.explode(images("ix", nx)).alias("x"), "iy").select(*keys, "n", "x", F.explode(images("iy", ny)).alias("y"))
    sent = sent.filter(F.col("x").between(-radius, nx - 1 + radius) & F.col("y").between(-radius, ny - 1 + radius))
    sent = sent.withColumn("dx", F.explode(offset())).withColumn("dy", F.explode(offset()))
    sent = sent.select(*keys, "n", (F.col("x") + F.col("dx")).alias("ix"), (F.col("y") + F.col("dy")).alias("iy"), (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"))
    sums = sent.groupBy(*keys, "ix", "iy").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.sum(F.col("n") * F.col("d2")).alias("d2"))
    return sums.join(grid.select(*keys, "ix", "iy"), [*keys, "ix", "iy"], "left_semi")


def bandwidth() -> Column:
    """Silverman's rule in two dimensions from the columns of :func:`window_statistics`, in cells."""
    return F.sqrt(F.col("d2") / F.col("s") / 2) * F.pow(F.col("s") * F.col("s") / F.col("ss"), F.lit(-1 / 6))


def stencil_of(h: float) -> list[tuple[int, int, float]]:
    """dx, dy and weight of a Gaussian of bandwidth ``h`` cells, out to three of them; the cell alone for none."""
    reach = math.ceil(3 * h) if h > 0 else 0
    return [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * h * h)) if h > 0 else 1.0) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]


def class_of(h: Column, bandwidths: list[float]) -> Column:
    """Index of the first of the rising ``bandwidths`` that isn't below ``h``, of the last at most."""
    out = F.lit(len(bandwidths) - 1)
    for k in range(len(bandwidths) - 2, -1, -1):
        out = F.when(F.coalesce(h, F.lit(0.0)) <= bandwidths[k], k).otherwise(out)
    return out


def adaptive_kernel(grid: DataFrame, keys: tuple[str, ...], value: str, h: str, allowed: DataFrame, bandwidths: list[float]) -> DataFrame:
    """keys, ix, iy and ``value``: every cell spread by the Gaussian of its own bandwidth over the allowed cells around it.

    Each class of bandwidth has a stencil of its own, made once. The shares of
    a cell over ``allowed`` (ix, iy) are scaled to a sum of one, so mass is
    kept and none is on other cells. What no allowed cell is near to is one
    row of each key with null ix and iy. The shares of one cell are a bounded
    list, scaled where they are gathered.
    """
    entry = lambda dx, dy, w: F.struct(F.lit(dx).cast("bigint").alias("dx"), F.lit(dy).cast("bigint").alias("dy"), F.lit(w).alias("w"))
    stencils = F.array(*[F.array(*[entry(*e) for e in stencil_of(b)]) for b in bandwidths])
    own = [*keys, "cx", "cy"]
    sent = grid.select(*keys, F.col("ix").alias("cx"), F.col("iy").alias("cy"), value, F.explode(F.get(stencils, class_of(F.col(h), bandwidths))).alias("e"))
    sent = sent.select(*own, value, (F.col("cx") + F.col("e.dx")).alias("ix"), (F.col("cy") + F.col("e.dy")).alias("iy"), F.col("e.w").alias("w"))
    sent = sent.join(allowed.select("ix", "iy").withColumn("free", F.lit(True)), ["ix", "iy"], "left")
    place = F.when(F.col("free"), F.struct("ix", "iy", "w"))
    shares = sent.groupBy(*own).agg(F.first(value).alias(value), F.collect_list(place).alias("shares"), F.sum(F.when(F.col("free"), F.col("w"))).alias("all"))
    nowhere = F.array(F.struct(F.lit(None).cast("bigint").alias("ix"), F.lit(None).cast("bigint").alias("iy"), F.lit(1.0).alias("w")))
    scaled = shares.select(*keys, value, F.coalesce("all", F.lit(1.0)).alias("all"), F.explode(F.when(F.size("shares") > 0, F.col("shares")).otherwise(nowhere)).alias("e"))
    return scaled.groupBy(*keys, "e.ix", "e.iy").agg(F.sum(F.col(value) * F.col("e.w") / F.col("all")).alias(value))


def classes_for(most: float, step: float) -> list[float]:
    """Bandwidths from 0 to the first that isn't below ``most``, ``step`` apart."""
    steps = [k * step for k in range(math.ceil(most / step) + 1)]
    return steps[: bisect_left(steps, most) + 1]
