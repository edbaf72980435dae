"""Neighbourhood operators on sparse grids (ix, iy, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.operators.joins import shuffled


def offsets(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dx, dy) for dx in span for dy in span]


def spread(grid: DataFrame, value: str, weights: dict[tuple[int, int], float]) -> DataFrame:
    """Every cell sends weight times value to its neighbours; contributions are summed per cell.

    One explode and one grouping instead of a self-join per offset.
    """
    stencil = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in weights.items()])
    sent = grid.select("ix", "iy", value, F.explode(stencil).alias("s"))
    sent = sent.select((F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), (F.col(value) * F.col("s.w")).alias("part"))
    return sent.groupBy("ix", "iy").agg(F.sum("part").alias(value))


def box_smooth(grid: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Mean over the box around each cell, cells without a row counting as zero."""
    n = (2 * radius + 1) ** 2
    return spread(grid, value, {o: 1 / n for o in offsets(radius)}).join(grid.select("ix", "iy"), ["ix", "iy"], "left_semi")


def dilate(grid: DataFrame, value: str) -> DataFrame:
    """Missing cells take the largest value of their eight neighbours."""
    reach = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets(1) if (dx, dy) != (0, 0)])
    sent = grid.filter(F.col(value).isNotNull()).select("ix", "iy", value, F.explode(reach).alias("s"))
    around = sent.groupBy((F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy")).agg(F.max(value).alias("around"))
    return grid.join(around, ["ix", "iy"], "left").select("ix", "iy", F.coalesce(value, "around").alias(value))


def conserving_kernel(grid: DataFrame, value: str, allowed: DataFrame, radius: int = 2) -> DataFrame:
    """Spreads each cell by a Gaussian over the allowed cells around it, without loss of mass.

    The bandwidth is half the radius; the kernel of a cell is scaled so that
    its shares over ``allowed`` (ix, iy) sum to one. As the kernel is
    symmetric, that sum is what the allowed cells send to it; so only cells,
    never their contributions, are joined.
    """
    h = radius / 2
    kernel = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * h * h)) for dx, dy in offsets(radius)}
    open_cells = allowed.select("ix", "iy").distinct()
    total = spread(open_cells.withColumn("all", F.lit(1.0)), "all", kernel)
    scaled = grid.select("ix", "iy", value).join(shuffled(total), ["ix", "iy"]).select("ix", "iy", (F.col(value) / F.col("all")).alias(value))
    return spread(scaled, value, kernel).join(shuffled(open_cells), ["ix", "iy"], "left_semi")


def contour_edges(grid: DataFrame, inside: str) -> DataFrame:
    """ix, iy, side of the cell edges where ``inside`` differs from the cell to the right or above."""
    parts = []
    for side, dx, dy in (("right", 1, 0), ("above", 0, 1)):
        other = grid.select((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.col(inside).alias("other"))
        parts.append(grid.join(other, ["ix", "iy"]).filter(F.col(inside) != F.col("other")).select("ix", "iy", F.lit(side).alias("side")))
    return parts[0].union(parts[1])


def bilinear(points: DataFrame, grid: DataFrame, value: str, key: str = "point_id") -> DataFrame:
    """``value`` at (x, y) in cell units from the four corners, over those that have one.

    Corners are exploded with their weights and joined by equality.
    """
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corners = F.array(*[F.struct((F.floor("x") + i).alias("ix"), (F.floor("y") + j).alias("iy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)])
    c = points.select(key, F.explode(corners).alias("c")).select(key, "c.*").filter("w > 0")
    met = c.join(grid.filter(F.col(value).isNotNull()), ["ix", "iy"])
    return met.groupBy(key).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def diffuse(grid: DataFrame, value: str, number: float, steps: int = 1) -> DataFrame:
    """Explicit diffusion on the cells of ``grid`` with closed edges; ``number`` is D dt / dx^2, at most 1/4.

    Each step is one explode and grouping: a cell gives number times its
    value to each neighbour that exists. Steps are few; a long run should be
    written to a table every few steps.
    """
    assert number <= 0.25, "unstable"
    cells = grid.select("ix", "iy")
    four = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    for _ in range(steps):
        sent = grid.select(F.col("ix").alias("cx"), F.col("iy").alias("cy"), value, F.explode(four).alias("s"))
        sent = sent.withColumns({"ix": F.col("cx") + F.col("s.dx"), "iy": F.col("cy") + F.col("s.dy")}).join(cells, ["ix", "iy"], "left_semi")
        part = F.col(value) * number
        gain, loss = sent.select("ix", "iy", part.alias("d")), sent.select(F.col("cx").alias("ix"), F.col("cy").alias("iy"), (-part).alias("d"))
        change = gain.union(loss).groupBy("ix", "iy").agg(F.sum("d").alias("d"))
        grid = grid.join(change, ["ix", "iy"], "left").select("ix", "iy", (F.col(value) + F.coalesce("d", F.lit(0.0))).alias(value))
    return grid


def clamped_mean(field: DataFrame, value: str) -> DataFrame:
    """Mean of the 3 by 3 cells around each, cells beyond the edge being those at the edge."""
    edge = field.agg(*[f(c).alias(n) for c, names in (("ix", ("x0", "x1")), ("iy", ("y0", "y1"))) for f, n in zip((F.min, F.max), names)])
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    t = field.select("ix", "iy").crossJoin(F.broadcast(edge))  # one row
    t = t.withColumn("sx", F.explode(F.transform(near, lambda d: F.least(F.greatest(F.col("ix") + d, F.col("x0")), F.col("x1")))))
    t = t.withColumn("sy", F.explode(F.transform(near, lambda d: F.least(F.greatest(F.col("iy") + d, F.col("y0")), F.col("y1")))))
    source = field.select(F.col("ix").alias("sx"), F.col("iy").alias("sy"), value)
    return t.join(source, ["sx", "sy"]).groupBy("ix", "iy").agg((F.sum(value) / 9).alias(value))


def quad_weights(quad: Column, x: Column, y: Column) -> Column:
    """Weights of a turned rectangle's corners (array of struct x, y, counter-clockwise) for a place in it.

    The place is taken along the two sides from the first corner; each
    corner's weight is the area opposite to it, over the sum of all.
    """
    p, q, s = F.get(quad, F.lit(0)), F.get(quad, F.lit(1)), F.get(quad, F.lit(3))
    share = lambda end: ((x - p["x"]) * (end["x"] - p["x"]) + (y - p["y"]) * (end["y"] - p["y"])) / ((end["x"] - p["x"]) * (end["x"] - p["x"]) + (end["y"] - p["y"]) * (end["y"] - p["y"]))
    a, b = share(q), share(s)
    return F.array((1 - a) * (1 - b), a * (1 - b), a * b, (1 - a) * b)
