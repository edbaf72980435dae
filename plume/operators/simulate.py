"""Step operators on particle tables: motion, loss, transitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plume.operators.seeding import hash_uniform


def double_gyre(x: Column, y: Column, t: Column, epsilon: float = 0.25, omega: float = 0.628, strength: float = 0.1) -> tuple[Column, Column]:
    """Velocity of the analytic double gyre on [0, 2] x [0, 1]."""
    a = epsilon * F.sin(omega * t)
    b = 1 - 2 * a
    f, df = a * x * x + b * x, 2 * a * x + b
    u = -math.pi * strength * F.sin(math.pi * f) * F.cos(math.pi * y)
    v = math.pi * strength * F.cos(math.pi * f) * F.sin(math.pi * y) * df
    return u, v


def eddy(x: Column, y: Column) -> tuple[Column, Column]:
    """Unit speed around the origin."""
    r = F.nullif(F.sqrt(x * x + y * y), F.lit(0.0))
    return -y / r, x / r


def advect(df: DataFrame, field, dt: float, scheme: str = "euler") -> DataFrame:
    """x, y after one step in ``field(x, y, t) -> (u, v)``, by Euler, second- or fourth-order Runge-Kutta.

    Each stage is a projection, so a field given by columns adds no shuffle.
    """
    x, y, t = F.col("x"), F.col("y"), F.col("t")
    df = df.withColumn("k1", F.struct(*[c.alias(n) for c, n in zip(field(x, y, t), "uv")]))
    move = lambda k, h: (x + F.col(f"{k}.u") * h, y + F.col(f"{k}.v") * h)
    if scheme == "euler":
        u, v = F.col("k1.u"), F.col("k1.v")
    else:
        df = df.withColumn("k2", F.struct(*[c.alias(n) for c, n in zip(field(*move("k1", dt / 2), t + dt / 2), "uv")]))
        u, v = F.col("k2.u"), F.col("k2.v")
    if scheme == "rk4":
        df = df.withColumn("k3", F.struct(*[c.alias(n) for c, n in zip(field(*move("k2", dt / 2), t + dt / 2), "uv")]))
        df = df.withColumn("k4", F.struct(*[c.alias(n) for c, n in zip(field(*move("k3", dt), t + dt), "uv")]))
        u, v = ((F.col(f"k1.{c}") + 2 * F.col(f"k2.{c}") + 2 * F.col(f"k3.{c}") + F.col(f"k4.{c}")) / 6 for c in "uv")
    out = df.withColumns({"x": x + u * dt, "y": y + v * dt, "t": t + dt})
    return out.drop("k1", "k2", "k3", "k4")


def normal(*columns: Column) -> Column:
    """A standard normal number by Box and Muller that depends on the columns alone."""
    return F.sqrt(-2 * F.log(hash_uniform(*columns, F.lit("r")))) * F.cos(2 * math.pi * hash_uniform(*columns, F.lit("a")))


def random_walk(df: DataFrame, diffusivity: float, dt: float, key: str = "event_id") -> DataFrame:
    """Adds dx, dy in m: a horizontal random walk of the given diffusivity."""
    scale = math.sqrt(2 * diffusivity * dt)
    return df.withColumns({"dx": scale * normal(F.col(key), F.col("step"), F.lit("x")), "dy": scale * normal(F.col(key), F.col("step"), F.lit("y"))})


def aged_weights(track: DataFrame, rate: float, transfer: Column, depth: float, surface: float = 1.0) -> DataFrame:
    """Weights after decay and loss through the surface, step by step along each trajectory.

    With one binning for concentration and flux, a surface particle loses
    transfer * 0.01 / depth of its weight per hour, whatever the others do,
    and every particle rate * 3600. So the weight is the first one times a
    running product of factors, a window sum of logarithms; a factor of 0
    ends it.
    """
    order = Window.partitionBy("traj_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at_surface = (F.col("z") >= -surface).cast("double")
    factor = F.greatest(1 - 3600 * rate - at_surface * transfer * 0.01 / depth, F.lit(0.0))
    df = track.withColumn("factor", factor).withColumn("first_weight", F.first("weight").over(order))
    gone = F.max((F.col("factor") <= 0).cast("int")).over(order) == 1
    product = F.exp(F.sum(F.when(F.col("factor") > 0, F.log(F.nullif(F.col("factor"), F.lit(0.0)))).otherwise(0.0)).over(order))
    return df.withColumn("aged", F.when(gone, 0.0).otherwise(F.col("first_weight") * product))


def markov_jump(df: DataFrame, rates: dict[int, dict[int, float]], dt: float, key: str = "event_id") -> DataFrame:
    """Adds next_specie: a jump with probability 1 - exp(-rate dt) per destination, by cumulated search.

    ``rates`` is a small table of species; probabilities are literals, the
    draw a hash of the row.
    """
    u = hash_uniform(F.col(key), F.lit("jump"))
    out = F.col("specie")
    for origin, to in rates.items():
        total, choice = 0.0, F.col("specie")
        steps = []
        for target, rate in sorted(to.items()):
            total += 1 - math.exp(-rate * dt)
            steps.append((total, target))
        for bound, target in reversed(steps):
            choice = F.when(u < bound, target).otherwise(choice)
        out = F.when(F.col("specie") == origin, choice).otherwise(out)
    return df.withColumn("next_specie", out)


def ftle(df: DataFrame, field, delta: float, dt: float, steps: int) -> DataFrame:
    """Finite-time Lyapunov exponents of a lattice (ix, iy, x, y, t) moved ``steps`` times.

    The gradients are differences with the lattice neighbours, found by
    windows along rows and columns; the largest eigenvalue of the 2 by 2
    Cauchy-Green tensor is closed-form.
    """
    moved = df
    for _ in range(steps):
        moved = advect(moved, field, dt, "rk4")
    along_x, along_y = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    slope = lambda c, w: (F.lead(c).over(w) - F.lag(c).over(w)) / (2 * delta)
    j = moved.withColumns({"xx": slope("x", along_x), "xy": slope("x", along_y), "yx": slope("y", along_x), "yy": slope("y", along_y)}).dropna(subset=["xx", "xy"])
    a, b, d = F.col("xx") ** 2 + F.col("yx") ** 2, F.col("xx") * F.col("xy") + F.col("yx") * F.col("yy"), F.col("xy") ** 2 + F.col("yy") ** 2
    top = (a + d) / 2 + F.sqrt(((a - d) / 2) ** 2 + b * b)
    return j.select("ix", "iy", (F.log(F.sqrt(F.greatest(top, F.lit(1e-300)))) / abs(dt * steps)).alias("ftle"))
