"""Window analytics along trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plume.functions.geo import geodesic_forward, geodesic_inverse


def along(order: str = "step") -> Window:
    return Window.partitionBy("traj_id").orderBy(order)


def previous(*columns: str, order: str = "step") -> dict[str, Column]:
    """prev_<column>: the value one row before on the trajectory."""
    return {f"prev_{c}": F.lag(c).over(along(order)) for c in columns}


def classify(track: DataFrame) -> DataFrame:
    """event of each row: activated on the first one, deactivated on the last, else continuing."""
    first, last = F.lag("step").over(along()).isNull(), F.lead("step").over(along()).isNull()
    return track.withColumn("phase", F.when(first, "activated").when(last, "deactivated").otherwise("continuing"))


def lengths(track: DataFrame, limit: float = 100.0) -> DataFrame:
    """Distance and speed from the row before, speeds over ``limit`` m/s set to 0, and the running length."""
    df = track.withColumns(previous("lon", "lat", "sec"))
    d = geodesic_inverse(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))["distance"]
    df = df.withColumn("distance", F.coalesce(d, F.lit(0.0)))
    df = df.withColumn("speed", F.coalesce(F.col("distance") / F.nullif(F.col("sec") - F.col("prev_sec"), F.lit(0)), F.lit(0.0)))
    df = df.withColumn("speed", F.when(F.col("speed") > limit, 0.0).otherwise(F.col("speed")))
    return df.withColumn("length", F.sum("distance").over(along().rowsBetween(Window.unboundedPreceding, 0)))


def ever(condition: Column, order: str = "step") -> Column:
    """Whether the condition held on this row or any before it: what left once never returns."""
    return F.max(condition.cast("int")).over(along(order).rowsBetween(Window.unboundedPreceding, 0)) == 1


def liu_weisberg(pairs: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """traj_id, skill from separations and the observed track's cumulative lengths.

    ``pairs`` has traj_id, step, lon, lat (observed) and lon2, lat2 (modelled).
    """
    gap = geodesic_inverse(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))["distance"]
    df = pairs.withColumns({**previous("lon", "lat"), "gap": gap})
    leg = geodesic_inverse(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))["distance"]
    df = df.withColumn("leg", F.coalesce(leg, F.lit(0.0)))
    df = df.withColumn("so_far", F.sum("leg").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    total = df.groupBy("traj_id").agg(F.sum("gap").alias("gap"), F.sum("so_far").alias("way"))
    skill = F.greatest(1 - F.col("gap") / F.nullif(F.col("way"), F.lit(0.0)) / tolerance, F.lit(0.0))
    return total.select("traj_id", F.round(skill, 6).alias("skill"))


#: Points for separations below these km, and the factors of the five positions, fixed values.
DARPA_POINTS = ((4, 5.0), (8, 2.0), (16, 1.0), (32, 0.25))
DARPA_FACTORS = (1, 2, 5, 10, 20)


def darpa(pairs: DataFrame) -> DataFrame:
    """traj_id, points of the first five positions after the start; the first one 32 km off ends the count."""
    gap = geodesic_inverse(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))["distance"] / 1000
    df = pairs.withColumns({"gap": gap, "n": F.row_number().over(along()) - 1}).filter(F.col("n").between(1, 5))
    lost = F.max((F.col("gap") >= 32).cast("int")).over(along().rowsBetween(Window.unboundedPreceding, 0)) == 1
    points = F.lit(0.0)
    for km, value in reversed(DARPA_POINTS):
        points = F.when(F.col("gap") < km, value).otherwise(points)
    factor = F.element_at(F.array(*[F.lit(f) for f in DARPA_FACTORS]), F.col("n").cast("int"))
    df = df.withColumn("points", F.when(lost, 0).otherwise(F.floor(points * factor)))
    return df.groupBy("traj_id").agg(F.sum("points").cast("long").alias("points"))


def wind_drift(track: DataFrame, u: str = "x_current", v: str = "y_current") -> DataFrame:
    """traj_id, step, factor, offset: the wind share and turn that explain the way to the next row.

    The current carries the particle first; what is left to the next
    position is laid to the wind.
    """
    df = track.withColumns({f"next_{c}": F.lead(c).over(along()) for c in ("lon", "lat", "sec")}).filter("next_lon is not null")
    seconds = F.col("next_sec") - F.col("sec")
    speed = F.sqrt(F.col(u) ** 2 + F.col(v) ** 2)
    df = df.withColumn("carried", geodesic_forward(F.col("lon"), F.col("lat"), F.degrees(F.atan2(F.col(u), F.col(v))), speed * seconds))
    df = df.withColumn("rest", geodesic_inverse(F.col("carried.lon"), F.col("carried.lat"), F.col("next_lon"), F.col("next_lat")))
    wind = F.sqrt(F.col("x_wind") ** 2 + F.col("y_wind") ** 2)
    factor = F.col("rest.distance") / F.nullif(seconds * wind, F.lit(0.0))
    turn = F.pmod(F.col("rest.azimuth") - F.degrees(F.atan2(F.col("x_wind"), F.col("y_wind"))), F.lit(360.0))
    return df.select("traj_id", "step", factor.alias("factor"), F.when(turn > 180, turn - 360).otherwise(turn).alias("offset"))
