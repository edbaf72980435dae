"""Curvilinear and terrain-following grids: positions to indices, weights of any quadrilateral, cubic and four-way interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.operators import vertical
from plume.operators.joins import shuffled
from plume.sources.stores import kept

NEWTON_STEPS = 8

#: Columns of water that are sent to every executor, at most.
FEW_COLUMNS = 16_384


def quads(grid: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """ix, iy, x0..x3, y0..y3 and corners' ``values`` of each cell of ``grid`` (ix, iy, x, y) whose four corners exist, counter-clockwise.

    Each place is sent to the cells that it is a corner of: one grouping in
    place of a join for each corner.
    """
    places = ((0, 0), (1, 0), (1, 1), (0, 1))
    known = grid.filter("x is not null and y is not null")
    sent = known.select(F.col("ix").alias("px"), F.col("iy").alias("py"), "x", "y", *values, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(places)])).alias("c"))
    sent = sent.select((F.col("px") - F.col("c.dx")).alias("ix"), (F.col("py") - F.col("c.dy")).alias("iy"), F.col("c.k").alias("k"), "x", "y", *values)
    pick = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for c in ("x", "y", *values) for k in range(4)]
    return sent.groupBy("ix", "iy").agg(F.count("*").alias("n"), *pick).filter("n = 4").drop("n")


def inverse_bilinear(px: Column, py: Column) -> Column:
    """struct(s, t): where (px, py) lies in the quadrilateral of columns x0..y3, by Newton's steps on the bilinear map."""
    x, y = ([F.col(f"{c}{k}") for k in range(4)] for c in "xy")
    along = [v[1] - v[0] for v in (x, y)]
    across = [v[3] - v[0] for v in (x, y)]
    twist = [v[0] - v[1] + v[2] - v[3] for v in (x, y)]

    def step(at: Column, _: Column) -> Column:
        s, t = at["s"], at["t"]
        gap = [p - v[0] - a * s - b * t - c * s * t for p, v, a, b, c in zip((px, py), (x, y), along, across, twist)]
        ds, dt = [a + c * t for a, c in zip(along, twist)], [b + c * s for b, c in zip(across, twist)]
        det = ds[0] * dt[1] - ds[1] * dt[0]
        det = F.when(F.abs(det) > 1e-300, det)
        return F.struct((s + (gap[0] * dt[1] - gap[1] * dt[0]) / det).alias("s"), (t + (gap[1] * ds[0] - gap[0] * ds[1]) / det).alias("t"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.struct(F.lit(0.5).alias("s"), F.lit(0.5).alias("t")), step)


def corner_weights(s: Column, t: Column) -> list[Column]:
    """Bilinear weights of corners 0 to 3."""
    return [(1 - s) * (1 - t), s * (1 - t), s * t, (1 - s) * t]


def located(points: DataFrame, grid: DataFrame, key: str, size: float, values: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (key, px, py) with the cell (ix, iy) that holds them, s and t in it and the corners' ``values``.

    The cells of any quadrilaterals are copied to the square buckets of
    ``size`` that they touch and meet the points of their bucket; Newton's
    steps on the bilinear map then say where in the cell the point lies. On a
    shared side the least cell (iy, ix) has it. Points outside are left out.
    """
    bucket = lambda v: F.floor(v / size)
    ends = lambda a: F.sequence(bucket(F.least(*[f"{a}{k}" for k in range(4)])), bucket(F.greatest(*[f"{a}{k}" for k in range(4)])))
    q = quads(grid, values).withColumn("bx", F.explode(ends("x"))).withColumn("by", F.explode(ends("y")))
    met = points.withColumns({"bx": bucket(F.col("px")), "by": bucket(F.col("py"))}).join(q, ["bx", "by"])
    slack = 1e-9
    inside = [F.col(f"p{a}").between(F.least(*[f"{a}{k}" for k in range(4)]) - slack, F.greatest(*[f"{a}{k}" for k in range(4)]) + slack) for a in "xy"]
    met = met.filter(inside[0] & inside[1]).withColumn("at", inverse_bilinear(F.col("px"), F.col("py")))
    met = met.filter(F.col("at.s").between(-slack, 1 + slack) & F.col("at.t").between(-slack, 1 + slack))
    kept = F.struct("iy", "ix", F.col("at.s").alias("s"), F.col("at.t").alias("t"), *[f"{v}{k}" for v in values for k in range(4)])
    return met.groupBy(key).agg(F.min(kept).alias("c")).select(key, "c.*")


def position_to_index(points: DataFrame, grid: DataFrame, key: str, size: float) -> DataFrame:
    """key, x, y: places in cell units of a curvilinear grid, whole at its corners."""
    at = located(points, grid, key, size)
    return at.select(key, (F.col("ix") + F.col("s")).alias("x"), (F.col("iy") + F.col("t")).alias("y"))


def cubic_weights(w: Column) -> list[Column]:
    """Weights of the cells at -1, 0, 1 and 2 for a place ``w`` between 0 and 1: the cubic through the four."""
    return [-w * (w - 1) * (w - 2) / 6, (w + 1) * (w - 1) * (w - 2) / 2, -(w + 1) * w * (w - 2) / 2, (w + 1) * w * (w - 1) / 6]


def cubic(points: DataFrame, field: DataFrame, value: str, key: str, least: float = 0.5) -> DataFrame:
    """key and ``value`` at ``points`` (key, x, y in cell units), exact where the field is cubic in x and y.

    Each point's sixteen weights are exploded and meet the cells by equality.
    Where cells have no value, the others' weights are scaled up to one;
    points of which less than ``least`` of the weight is there get null.
    """
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    near = F.array(*[F.struct((F.floor("x") + i - 1).alias("ix"), (F.floor("y") + j - 1).alias("iy"), (a * b).alias("w")) for i, a in enumerate(cubic_weights(fx)) for j, b in enumerate(cubic_weights(fy))])
    sent = points.select(key, F.explode(near).alias("c")).select(key, "c.*").filter("w <> 0")
    met = sent.join(field.select("ix", "iy", value), ["ix", "iy"], "left")
    there = F.when(F.col(value).isNotNull(), F.col("w")).otherwise(0.0)
    out = met.groupBy(key).agg(F.sum(there).alias("there"), F.sum(F.col("w") * F.col(value)).alias("total"))
    return out.select(key, F.when(F.col("there") >= least, F.col("total") / F.col("there")).alias(value))


def four_way(points: DataFrame, columns: DataFrame, key: str, values: tuple[str, ...], period: float) -> DataFrame:
    """key and ``values`` at ``points`` (key, x, y, z, t), from columns of water on terrain-following levels.

    ``columns`` has ix, iy, slot (t over ``period``), depths (of the levels,
    positive, from the surface) and an array for each of ``values``. Every
    point goes to four columns at two times; in each, the levels around its
    depth are bracketed there, as the same level lies at another depth in the
    next column; the results are weighted bilinearly and linearly in time.
    Columns that are missing (land, or no such time) leave their weight to the others.
    The columns that any point asks for are written and counted first: if they
    are few they go to the points, else both are dealt by their place.
    """
    fx, fy, ft = F.col("x") - F.floor("x"), F.col("y") - F.floor("y"), F.col("t") / period - F.floor(F.col("t") / period)
    corners = [(i, j, m) for i in (0, 1) for j in (0, 1) for m in (0, 1)]
    share = lambda f, k: f if k else 1 - f
    near = F.array(*[F.struct((F.floor("x") + i).alias("ix"), (F.floor("y") + j).alias("iy"), (F.floor(F.col("t") / period) + m).alias("slot"), (share(fx, i) * share(fy, j) * share(ft, m)).alias("w")) for i, j, m in corners])
    sent = points.select(key, "z", F.explode(near).alias("c")).select(key, "z", "c.*").filter("w > 0")
    place = ["ix", "iy", "slot"]
    boxes = points.select(F.floor("x").alias("bx"), F.floor("y").alias("by"), F.floor(F.col("t") / period).alias("bt")).distinct()
    ends = F.array(*[F.struct((F.col("bx") + i).alias("ix"), (F.col("by") + j).alias("iy"), (F.col("bt") + m).alias("slot")) for i, j, m in corners])
    asked = kept(boxes.select(F.explode(ends).alias("e")).select("e.*").distinct(), "columns-asked")
    dealt = F.broadcast if asked.count() <= FEW_COLUMNS else shuffled
    met = sent.join(dealt(columns.join(dealt(asked), place, "left_semi")), place)
    level = [vertical.at_depth(F.col(v), F.col("depths"), F.col("z")).alias(v) for v in values]
    each = met.select(key, "w", *level)
    return each.groupBy(key).agg(*[(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v) for v in values])


def turned(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """East and north parts of vectors along the axes of a grid whose x axis is turned by ``angle`` (radians) from east."""
    return u * F.cos(angle) - v * F.sin(angle), u * F.sin(angle) + v * F.cos(angle)
