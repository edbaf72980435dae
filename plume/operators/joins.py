"""Lookups: as-of, nearest, radius, range, weights and priority joins.

Each has an equality key, so that none becomes a nested loop.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plume.sources.stores import dropped, kept


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides are both dealt by the key, never sent whole through the driver.

    The planner knows the bytes of compressed files, and nothing of the rows
    that an explode makes of one: by its estimate a table of millions of rows
    can be small enough to broadcast.
    """
    return df.hint("merge")


def asof_bracket(left: DataFrame, right: DataFrame, time: str, values: list[str], slots: int = 3600) -> DataFrame:
    """``left`` with the last row of ``right`` at or before its time and the first at or after it.

    ``right`` has one row per time. With its successor each row makes an
    interval, which is copied to the time slots that it touches; rows of
    ``left`` meet the intervals of their slot by an equality join and a range
    condition. So ``left`` isn't sorted, and isn't shuffled either while the
    planner finds the intervals small enough to broadcast. Times before the first or
    after the last row get these two, one row for all.

    Adds ``<time>_before``, ``<v>_before``, ``<time>_after``, ``<v>_after``.
    """
    slot = lambda t: F.floor(t / slots)
    row = F.struct(F.col(time), *values)
    rows = right.select(F.col(time).alias("t"), row.alias("r")).withColumn("own", slot(F.col("t")))
    # successors within a slot, and the first row of the next slot that has any: one row per slot is all that is ordered as a whole
    firsts = rows.groupBy("own").agg(F.min_by("r", "t").alias("first")).select("own", F.lead("first").over(Window.orderBy("own")).alias("later"))
    rows = rows.withColumn("next", F.lead("r").over(Window.partitionBy("own").orderBy("t"))).join(firsts, "own")
    spans = rows.select("t", "r", F.coalesce("next", "later").alias("next")).filter("next is not null")
    spans = spans.withColumn("slot", F.explode(F.sequence(slot(F.col("t")), slot(F.col(f"next.{time}")))))
    ends = right.agg(F.min_by(row, F.col(time)).alias("first"), F.max_by(row, F.col(time)).alias("last"))
    within = (F.col("l.slot") == F.col("s.slot")) & (F.col(f"l.{time}") >= F.col("s.t")) & (F.col(f"l.{time}") < F.col(f"s.next.{time}"))
    met = left.withColumn("slot", slot(F.col(time))).alias("l").join(spans.alias("s"), within, "left").crossJoin(F.broadcast(ends))  # one row
    t = F.col(f"l.{time}")
    before = F.when(F.col("s.t").isNotNull(), F.col("s.r")).when(t >= F.col(f"last.{time}"), F.col("last"))
    after = F.when(F.col("s.t") == t, F.col("s.r")).when(F.col("s.t").isNotNull(), F.col("s.next")).when(t <= F.col(f"first.{time}"), F.col("first")).when(t == F.col(f"last.{time}"), F.col("last"))
    out = met.select(*[F.col(f"l.{c}").alias(c) for c in left.columns], before.alias("before"), after.alias("after"))
    named = [F.col(f"{side}.{v}").alias(f"{v}_{side}") for side in ("before", "after") for v in (time, *values)]
    return out.select(*left.columns, *named)


def asof_nearest(left: DataFrame, right: DataFrame, time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the row of ``right`` nearest in time, the later one of two equally near."""
    b = asof_bracket(left, right, time, values)
    gap_before, gap_after = F.col(time) - F.col(f"{time}_before"), F.col(f"{time}_after") - F.col(time)
    after = F.coalesce(gap_after <= gap_before, gap_before.isNull())
    return b.select(*left.columns, *[F.when(after, F.col(f"{v}_after")).otherwise(F.col(f"{v}_before")).alias(v) for v in (f"{time}", *values) if v != time])


def time_lerp(left: DataFrame, right: DataFrame, time: str, values: list[str]) -> DataFrame:
    """``left`` with values interpolated linearly between the bracketing rows of ``right``."""
    b = asof_bracket(left, right, time, values)
    t0, t1 = F.col(f"{time}_before"), F.col(f"{time}_after")
    w = F.coalesce((F.col(time) - t0) / F.nullif(t1 - t0, F.lit(0)), F.lit(0.0))
    return b.select(*left.columns, *[F.coalesce(F.col(f"{v}_before") * (1 - w) + F.col(f"{v}_after") * w, F.col(f"{v}_before"), F.col(f"{v}_after")).alias(v) for v in values])


#: Metres in a degree of a great circle of the mean earth.
DEGREE = 111194.92664455873


def metres(lon: str, lat: str, lon2: str, lat2: str) -> Column:
    """Distance on a plane that is true to scale at the mean latitude of the two points, the short way around.

    Within 5 degrees of a pole, where no plane is, it is that of the great circle.
    """
    gap = F.col(lon) - F.col(lon2)
    gap = F.when(F.abs(gap) > 180, gap - 360 * F.round(gap / 360)).otherwise(gap)
    dx, dy = gap * F.cos(F.radians((F.col(lat) + F.col(lat2)) / 2)), F.col(lat) - F.col(lat2)
    up, across = F.sin(F.radians(dy / 2)), F.sin(F.radians(gap / 2))
    h = up * up + F.cos(F.radians(F.col(lat))) * F.cos(F.radians(F.col(lat2))) * across * across
    circle = F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))
    return F.when(F.abs(F.col(lat) + F.col(lat2)) > 170, circle).otherwise(F.sqrt(dx * dx + dy * dy)) * DEGREE


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within ``radius`` m and of equal ``on`` columns, with their distance.

    ``right`` has lon2, lat2. Buckets are bands of latitude of the height of
    ``radius``, each cut into equal parts of the circle that hold ``radius``
    at its poleward end (one part near a pole), so that the last part meets
    the first. Right rows are copied to the 3 by 3 buckets around their own,
    which makes an equality join on the bucket; the distance then decides.
    """
    l, r = bucketed(left, right, radius)  # noqa: E741
    return l.join(r, [*on, "bx", "by"]).withColumn("distance", metres("lon", "lat", "lon2", "lat2")).filter(F.col("distance") <= radius).drop("bx", "by")


def bucketed(left: DataFrame, right: DataFrame, radius: float, at: tuple[str, str] = ("lon", "lat"), at2: tuple[str, str] = ("lon2", "lat2")) -> tuple[DataFrame, DataFrame]:
    """Both with the buckets bx, by of :func:`radius_join`, ``right`` copied to those around its own."""
    height = radius / DEGREE
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    band = lambda lat: F.floor(F.col(lat) / height)
    poleward = (F.abs(F.col("by")) + 2) * height
    parts = F.when(poleward < 88, F.greatest(F.floor(360 * F.cos(F.radians(poleward)) / height), F.lit(1))).otherwise(1)
    place = lambda lon: F.least(F.floor(F.pmod(F.col(lon).cast("double"), F.lit(360.0)) / 360 * parts), parts - 1)
    around = lambda at: F.array_distinct(F.transform(near, lambda d: F.pmod(at + d, parts)))
    r = right.withColumn("by", F.explode(F.transform(near, lambda d: band(at2[1]) + d))).withColumn("bx", F.explode(around(place(at2[0]))))
    return left.withColumn("by", band(at[1])).withColumn("bx", place(at[0])), r


def radius_join_by_place(left: DataFrame, right: DataFrame, key: str, radius: float, together: int = 1024) -> DataFrame:
    """:func:`radius_join` with one row for up to ``together`` rows of ``left`` at an equal place, their ``key`` in the array ids.

    To be exploded last: the pairs of a group then follow one another, and
    files hold their repeated values as runs.
    """
    number = F.row_number().over(Window.partitionBy("lon", "lat").orderBy(key))
    groups = left.select("lon", "lat", key, F.floor((number - 1) / together).alias("part")).groupBy("lon", "lat", "part").agg(F.collect_list(key).alias("ids"))
    return radius_join(groups.drop("part"), shuffled(right), radius)


def nearest_k(left: DataFrame, right: DataFrame, key: str, tie: str, k: int, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Of the pairs within ``radius``, the ``k`` nearest of each ``key``, ties by ``tie``, with their rank; ``key`` is unique.

    The first round looks no farther than the density of ``right`` (counted
    once) asks for; rows that find fewer than ``k`` look again within twice
    of it, and so on to ``radius``. The first round copies ``right`` and
    deals both sides by bucket once: ranks and lists of ``k`` are made where
    the pairs meet. Later ones, of few rows, copy these instead. Rounds that
    have another after them are written.
    """
    per = right.groupBy(*on).agg(F.count("lon2").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lon2", "lat2") for n, f in (("low", F.min), ("high", F.max))])
    seen = per.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("lon2", "lat2") for n, f in (("low", F.min), ("high", F.max))]).first()
    reach = radius
    if seen["n"]:
        middle = math.radians((seen["low_lat2"] + seen["high_lat2"]) / 2)
        area = (seen["high_lon2"] - seen["low_lon2"]) * max(math.cos(middle), 0.02) * (seen["high_lat2"] - seen["low_lat2"]) * DEGREE * DEGREE
        reach = min(radius, max(math.sqrt(area * 3 * k / (math.pi * seen["n"])), radius / 64))
    own = [c for c in right.columns if c not in (tie, *on)]
    rest, rounds = left, []
    while True:
        places, pair = [*on, "bx", "by"], F.struct("distance", tie, *own)
        apart = metres("lon", "lat", "lon2", "lat2")
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by, key).orderBy("distance", tie))
        if not rounds:
            l, r = bucketed(rest, right, reach)  # noqa: E741
            r = r.withColumnsRenamed({c: f"_{c}" for c in places})
            same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in places])
            met = l.join(shuffled(r), same & (apart <= reach), "left").withColumn("distance", apart)
            best = met.withColumn("rank", rank(*places)).filter(F.col("rank") <= k).groupBy("bx", "by", *left.columns).agg(F.sort_array(F.collect_list(F.when(F.col("distance").isNotNull(), pair))).alias("pairs")).drop("bx", "by")
        else:
            r, l = bucketed(right, rest, reach, ("lon2", "lat2"), ("lon", "lat"))  # noqa: E741
            met = l.join(shuffled(r), places).withColumn("distance", apart).filter(F.col("distance") <= reach)
            got = met.withColumn("rank", rank()).filter(F.col("rank") <= k).groupBy(key).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
            best = rest.join(shuffled(got), key, "left").select(*left.columns, F.coalesce("pairs", F.array().cast(got.schema["pairs"].dataType)).alias("pairs"))
        if reach >= radius:
            rounds.append(best)
            break
        rounds.append(kept(best, "nearest"))
        rest = rounds[-1].filter(F.size("pairs") < k).select(*left.columns)
        rounds[-1] = rounds[-1].filter(F.size("pairs") == k)
        reach = min(2 * reach, radius)
    found = reduce(DataFrame.unionByName, rounds)
    return found.select(*left.columns, F.posexplode("pairs").alias("rank", "pair")).select(*left.columns, "pair.*", (F.col("rank") + 1).alias("rank"))


def nearest(left: DataFrame, right: DataFrame, key: str, tie: str, radius: float) -> DataFrame:
    """The nearest row of ``right`` for every row of ``left``, however far, ties by ``tie``.

    The first round looks within ``radius``, or less where ``right`` is so
    dense (by its number and extent, counted once) that less will do; rows
    that find none look again within three times of it, and so on. A round
    keeps the least pair of each row before anything is shuffled, and writes
    rows found and not found as one table; tables of more than one round are
    deleted when their result is written. An empty ``right`` gives an empty
    result; rows without a place have none.
    """
    extent = right.agg(F.count("lon2").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lon2", "lat2") for n, f in (("low", F.min), ("high", F.max))]).first()
    if extent["n"]:
        middle = math.radians((extent["low_lat2"] + extent["high_lat2"]) / 2)
        area = (extent["high_lon2"] - extent["low_lon2"]) * max(math.cos(middle), 0.02) * (extent["high_lat2"] - extent["low_lat2"]) * DEGREE * DEGREE
        radius = min(radius, max(math.sqrt(4 * area / extent["n"]), radius / 64))
    own = [c for c in right.columns if c not in (tie, *left.columns)]
    pair = F.struct("distance", tie, *own)
    empty = F.lit(None).cast(radius_join(left, right, radius).select(pair.alias("p")).schema["p"].dataType)
    rest, rounds = left.filter("lon is not null and lat is not null"), []
    while True:
        met = radius_join(rest, right, radius).select(*left.columns, pair.alias("pair"))
        best = met.unionByName(rest.select(*left.columns, empty.alias("pair"))).groupBy(*left.columns).agg(F.min("pair").alias("pair"))
        rounds.append(kept(best, "nearest"))
        rest = rounds[-1].filter("pair is null").select(*left.columns)
        if not extent["n"] or radius > 2.1e7 or not rest.limit(1).count():
            break
        radius *= 3
    found = reduce(DataFrame.unionByName, rounds).filter("pair is not null").select(*left.columns, "pair.*", F.lit(1).alias("rank"))
    if len(rounds) == 1:
        return found
    out = kept(found, "nearest")
    dropped(*rounds)
    return out


def inverse_distance_shares(pairs: DataFrame, key: str) -> DataFrame:
    """``pairs`` with share: inverse distance, normalised per ``key``."""
    w = 1 / (F.col("distance") + 1e-10)
    return pairs.withColumn("w", w).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(key))).drop("w")


def priority_coalesce(base: DataFrame, sources: list[DataFrame], keys: list[str], values: list[str], fallback: dict[str, float]) -> DataFrame:
    """Each value from the first of ``sources`` that has it, else the fallback: a chain of left joins."""
    out = base
    for n, s in enumerate(sources):
        out = out.join(s.select(*keys, *[F.col(v).alias(f"{v}_{n}") for v in values]), keys, "left")
    return out.select(*base.columns, *[F.coalesce(*[F.col(f"{v}_{n}") for n in range(len(sources))], F.lit(fallback[v])).alias(v) for v in values])


def weights_join(weights: DataFrame, field: DataFrame, target: str, source: str, value: str) -> DataFrame:
    """Sum of weight times field value over each target's sources."""
    return weights.join(field, source).groupBy(target).agg(F.sum(F.col("w") * F.col(value)).alias(value))
