"""Seeds as rows made by sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plume.functions.geo import geodesic_forward, geodesic_inverse, inside_ring

GOLDEN = math.pi * (3 - math.sqrt(5))


def hash_uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone, the same in every partitioning."""
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def sunflower(sites: DataFrame, number: Column, radius: float) -> DataFrame:
    """``number`` points around each site, the k-th at the golden angle and radius sqrt((k + 0.5) / n)."""
    out = sites.withColumn("n", number).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    r, a = radius * F.sqrt((F.col("k") + 0.5) / F.col("n")), F.col("k") * GOLDEN
    return out.withColumns({"seed_lon": F.col("lon") + r * F.cos(a) / 40000.0, "seed_lat": F.col("lat") + r * F.sin(a) / 111000.0})


def cone(sites: DataFrame, ends: Column, number: int, r0: float, r1: float) -> DataFrame:
    """``number`` points from a site to ``ends`` (struct lon, lat), scattered by a radius that grows along the way."""
    out = sites.withColumn("end", ends).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    w = F.col("k") / float(max(number - 1, 1))
    r = (r0 + (r1 - r0) * w) * F.sqrt(hash_uniform(F.col("site_id"), F.col("k"), F.lit("r")))
    a = 2 * math.pi * hash_uniform(F.col("site_id"), F.col("k"), F.lit("a"))
    return out.withColumns({"seed_lon": F.col("lon") + (F.col("end.lon") - F.col("lon")) * w + r * F.cos(a) / 40000.0, "seed_lat": F.col("lat") + (F.col("end.lat") - F.col("lat")) * w + r * F.sin(a) / 111000.0})


def inside(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    return points.filter(inside_ring(F.col("lon"), F.col("lat"), ring))


def schedule(seeds: DataFrame, hours: int) -> DataFrame:
    """Each seed once for every hour, with its release second and a number."""
    out = seeds.withColumn("release", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return out.withColumn("release_sec", F.col("release") * 3600)


def hash_normal(*columns: Column) -> Column:
    """A normal deviate that depends on the columns alone."""
    return F.sqrt(-2 * F.log(hash_uniform(*columns, F.lit("r")))) * F.cos(2 * math.pi * hash_uniform(*columns, F.lit("a")))


def evenly(k: Column, number: int, seconds: int) -> Column:
    """Second of the k-th of ``number`` releases that are spread over ``seconds``."""
    return F.floor(seconds * k / float(max(number - 1, 1)))


def gaussian(sites: DataFrame, number: int, radius: float, seconds: int) -> DataFrame:
    """``number`` places around each site whose distances to the east and north are normal, released over ``seconds``."""
    out = sites.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    x, y = (radius * hash_normal(F.col("site_id"), F.col("k"), F.lit(n)) for n in ("x", "y"))
    out = out.withColumns({"x": x, "y": y, "release_sec": evenly(F.col("k"), number, seconds)})
    out = out.withColumn("at", geodesic_forward(F.col("lon"), F.col("lat"), F.degrees(F.atan2("x", "y")), F.hypot("x", "y")))
    return out.withColumns({"seed_lon": F.col("at.lon"), "seed_lat": F.col("at.lat")}).drop("at", "x", "y")


def repeated_segment(sites: DataFrame, lon2: Column, lat2: Column, number: int, times: int, interval: int) -> DataFrame:
    """``number`` places from a site to (lon2, lat2) along the geodesic, each released ``times`` times."""
    out = sites.withColumn("leg", geodesic_inverse(F.col("lon"), F.col("lat"), lon2, lat2))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    out = out.withColumn("at", geodesic_forward(F.col("lon"), F.col("lat"), F.col("leg.azimuth"), F.col("leg.distance") * F.col("k") / float(max(number - 1, 1))))
    out = out.withColumns({"seed_lon": F.col("at.lon"), "seed_lat": F.col("at.lat")}).drop("at", "leg")
    return out.withColumn("release_sec", F.explode(F.sequence(F.lit(0), F.lit((times - 1) * interval), F.lit(interval))))


def lattice_in_ring(wanted: DataFrame, key: str, ring: list[tuple[float, float]]) -> DataFrame:
    """id (from 0), x and y: ``number`` places of a regular lattice within ``ring`` for each row of ``wanted`` (key, number).

    The lattice's step is that of ``number`` squares of the ring's area. Of
    too many places the first stay; of too few the first are taken again.
    """
    area = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))) / 2
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*ring))
    g = wanted.withColumn("d", F.sqrt(area / F.col("number")))
    g = g.withColumns({"nx": F.floor((x1 - x0) / F.col("d")), "ny": F.floor((y1 - y0) / F.col("d"))})
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1)))
    at = lambda low, high, k, n: low + F.col("d") / 2 + F.col(k) * (high - low - F.col("d")) / F.greatest(F.col(n) - 1, F.lit(1))
    p = g.withColumns({"x": at(x0, x1, "i", "nx"), "y": at(y0, y1, "j", "ny")}).filter(inside_ring(F.col("x"), F.col("y"), ring))
    own = Window.partitionBy(key)
    p = p.withColumns({"k": F.row_number().over(own.orderBy("j", "i")).cast("bigint") - 1, "inside": F.count("*").over(own)}).filter(F.col("k") < F.col("number"))
    return p.withColumn("id", F.explode(F.sequence(F.col("k"), F.col("number") - 1, F.col("inside"))))


def by_shares(u: Column, shares: tuple[float, ...]) -> Column:
    """The class of a uniform number among classes of these shares."""
    passed, sum_ = F.lit(0), 0.0
    for share in shares[:-1]:
        sum_ = round(sum_ + share, 12)
        passed = passed + F.when(u >= sum_, 1).otherwise(0)
    return passed


def numbered(seeds: DataFrame, release: str, order: str) -> DataFrame:
    """``seeds`` with id, from 1 on by release and order; only the table of releases is ordered as a whole."""
    counts = seeds.groupBy(F.col(release).alias("of")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    out = seeds.join(counts.select("of", before.alias("before")), F.col(release) == F.col("of"))
    return out.withColumn("id", F.col("before") + F.row_number().over(Window.partitionBy(release).orderBy(order))).drop("of", "before")
