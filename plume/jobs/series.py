"""Queries on series, places, rules and names, each with the same result in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.functions import geo
from plume.jobs.fields import CELLS, GRID
from plume.jobs.tracks import BRACKET, METRES, joined, vincenty_sql
from plume.operators import joins, rules
from plume.sources.fixtures import bathymetry, forcing, particles, sites, table, track, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r(c: Column | str, digits: int, name: str) -> Column:
    return F.round(c, digits).alias(name)


def by_traj(order: str = "step") -> Window:
    return Window.partitionBy("traj_id").orderBy(order)


# places


def utm_sql(lon: str, lat: str) -> tuple[str, str]:
    n = geo.FLAT / (2 - geo.FLAT)
    radius = 0.9996 * geo.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e, a = 2 * math.sqrt(n) / (1 + n), (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos(radians({lon} - 15)))", f"atanh(sin(radians({lon} - 15)) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta, *[f"{b!r}::DOUBLE * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, b in enumerate(a, 1)]])
    north = " + ".join([xi, *[f"{b!r}::DOUBLE * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, b in enumerate(a, 1)]])
    return f"(500000 + {radius!r}::DOUBLE * ({east}))", f"({radius!r}::DOUBLE * ({north}))"


@query(with_views("particles", "SELECT event_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM particles"))
def utm_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = particles(spark, sf_dir)
    east, north = geo.utm_forward(F.col("lon"), F.col("lat"))
    p = p.select("event_id", east.alias("east"), north.alias("north"))
    lon, lat = geo.utm_inverse(F.col("east"), F.col("north"))
    return p.select("event_id", r(lon, 7, "lon"), r(lat, 7, "lat"))


ECC = math.sqrt(geo.FLAT * (2 - geo.FLAT))


def polar_sql(lat: str) -> str:
    return f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {ECC!r}::DOUBLE * sin(radians({lat}))) / (1 + {ECC!r}::DOUBLE * sin(radians({lat}))), {ECC / 2!r}::DOUBLE))"


SCALE = f"(6378137e0 * cos(radians(75e0)) / sqrt(1 - {ECC * ECC!r}::DOUBLE * pow(sin(radians(75e0)), 2)) / {polar_sql('75e0')})"


@query(with_views("particles", f"SELECT event_id, round({SCALE} * {polar_sql('lat')} * sin(radians(lon + 45)), 3) AS x, round(-{SCALE} * {polar_sql('lat')} * cos(radians(lon + 45)), 3) AS y FROM particles"))
def polar_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.polar_stereographic(F.col("lon"), F.col("lat"))
    return particles(spark, sf_dir).select("event_id", r(x, 3, "x"), r(y, 3, "y"))


@query(with_views("particles", "SELECT event_id, 1000e0 + event_id % 50 * 100 AS distance, event_id % 180 + 0.5e0 AS azimuth FROM particles"))
def geodesic_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and azimuth, measured, of places that lie at given ones."""
    p = particles(spark, sf_dir).select("event_id", "lon", "lat", (1000.0 + F.col("event_id") % 50 * 100).alias("d"), (F.col("event_id") % 180 + 0.5).alias("a"))
    p = p.withColumn("to", geo.geodesic_forward(F.col("lon"), F.col("lat"), F.col("a"), F.col("d")))
    p = p.withColumn("back", geo.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("to.lon"), F.col("to.lat")))
    return p.select("event_id", r("back.distance", 4, "distance"), r("back.azimuth", 5, "azimuth"))


ENDS = "SELECT site_id, lon, lat, lon + 0.4e0 AS lon2, lat + 0.2e0 AS lat2 FROM sites"


@query(joined("sites", f", d AS ({vincenty_sql(ENDS, 'lon', 'lat', 'lon2', 'lat2', 'site_id')}), k AS (SELECT *, unnest(range(1, 8)) AS k FROM d) SELECT site_id, k, round(distance * k / 8, 2) AS distance FROM k"))
def geodesic_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven places between two ends of a geodesic, as measured from the first."""
    s = sites(spark, sf_dir).withColumn("leg", geo.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("lon") + 0.4, F.col("lat") + 0.2))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    s = s.withColumn("at", geo.geodesic_forward(F.col("lon"), F.col("lat"), F.col("leg.azimuth"), F.col("leg.distance") * F.col("k") / 8))
    d = geo.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("at.lon"), F.col("at.lat"))["distance"]
    return s.select("site_id", F.col("k").cast("bigint").alias("k"), r(d, 2, "distance"))


E0, N0 = utm_sql("lon", "lat")
E1, N1 = utm_sql("lon", "(lat + 0.001e0)")


@query(joined("particles", f", a AS (SELECT event_id, weight, lat, atan2({E1} - {E0}, {N1} - {N0}) AS a FROM particles) SELECT event_id, round(a, 6) AS angle, round(weight * cos(a) - 5 * sin(a), 4) AS u, round(weight * sin(a) + 5 * cos(a), 4) AS v, round(1e4 * sin(radians(lat)) * 4 * pi() / 86400, 8) AS coriolis FROM a"))
def grid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors turned from the projected grid's axes to true ones, and the Coriolis parameter."""
    p = particles(spark, sf_dir).withColumn("angle", geo.grid_angle(F.col("lon"), F.col("lat")))
    u, v = geo.rotate(F.col("weight"), F.lit(5.0), F.col("angle"))
    return p.select("event_id", r("angle", 6, "angle"), r(u, 4, "u"), r(v, 4, "v"), r(1e4 * geo.coriolis(F.col("lat")), 8, "coriolis"))


@query(joined("particles sites", ", n AS (SELECT event_id, count(site_id) AS polygons FROM particles p LEFT JOIN sites s ON p.lon >= s.lon AND p.lon < s.lon + 0.3e0 AND p.lat >= s.lat AND p.lat < s.lat + 0.2e0 GROUP BY event_id) SELECT event_id, polygons, polygons = 0 AS sea FROM n"))
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of a table's polygons each particle lies, and the mask outside of all.

    Polygons are copied to the buckets that they touch, places meet those of
    their bucket, and the ring decides. Equal polygons and equal places count
    once each and meet once.
    """
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    s = sites(spark, sf_dir).withColumn("ring", F.array(corner(0.0, 0.0), corner(0.3, 0.0), corner(0.3, 0.2), corner(0.0, 0.2)))
    bucket = lambda c, size: F.floor(c / size)
    span = lambda c, width, size: F.explode(F.sequence(bucket(F.col(c), size), bucket(F.col(c) + width, size)))
    s = s.groupBy("lon", "lat", "ring").agg(F.count("*").alias("equal"))
    s = s.withColumn("bx", span("lon", 0.3, 0.1)).withColumn("by", span("lat", 0.2, 0.1)).select("ring", "equal", "bx", "by", *[end(f"ring.{c}").alias(f"{n}_{c}") for c in "xy" for n, end in (("low", F.array_min), ("high", F.array_max))])
    p = particles(spark, sf_dir).select("event_id", "lon", "lat")
    met = p.select("lon", "lat").distinct().withColumns({"bx": bucket(F.col("lon"), 0.1), "by": bucket(F.col("lat"), 0.1)}).join(joins.shuffled(s), ["bx", "by"])
    met = met.filter(F.col("lon").between(F.col("low_x"), F.col("high_x")) & F.col("lat").between(F.col("low_y"), F.col("high_y")))
    n = met.filter(geo.within_ring(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("lon", "lat").agg(F.sum("equal").alias("n"))
    out = p.join(n, ["lon", "lat"], "left").select("event_id", F.coalesce("n", F.lit(0)).alias("polygons"))
    return out.withColumn("sea", F.col("polygons") == 0)


# rules


@query(with_views("particles", "SELECT event_id, round(CASE WHEN weight > 100 THEN weight - 273.15e0 ELSE weight END, 6) AS celsius, round(greatest(z, -150e0), 6) AS z, round(CASE WHEN event_id % 5 = 0 THEN -225e0 ELSE z END, 6) AS filled, step >= 500 AS retired, lon BETWEEN 14 AND 19 AND lat BETWEEN 69 AND 71 AND step BETWEEN 24 AND 600 AS covered FROM particles WHERE status = 0"))
def particle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active particles with corrected temperatures and depths, and whether they retire and a source covers them."""
    p = rules.active(rules.only(particles(spark, sf_dir), ("event_id", "status"), ("lon", "lat", "z", "weight", "step")))
    holes = F.when(F.col("event_id") % 5 != 0, F.col("z"))
    return p.select(
        "event_id", r(rules.celsius(F.col("weight")), 6, "celsius"), r(rules.not_below(F.col("z"), 150.0), 6, "z"), r(rules.deepest_if_missing(holes, 225.0), 6, "filled"),
        rules.retired(F.col("step") * 3600, 500 * 3600).alias("retired"), rules.covered(F.col("lon"), F.col("lat"), F.col("step"), (14, 69, 19, 71), (24, 600)).alias("covered"),
    )


@query(with_views("bathymetry", ", e AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM bathymetry) SELECT ix - 5 AS ix, iy - 3 AS iy, round(least(100 - depth, 0), 6) AS height FROM bathymetry, e WHERE ix - x0 >= 2 AND x1 - ix >= 2 AND iy - y0 >= 2 AND y1 - iy >= 2 AND ix BETWEEN 5 AND 40 AND iy BETWEEN 3 AND 1000000").replace(") ,", "),", 1))
def grid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid without its two outer rings, cut to a box and counted anew, land set to 0."""
    b = rules.reindexed(rules.clipped(bathymetry(spark, sf_dir), 2), (5, 40, 3, 1_000_000))
    return b.select("ix", "iy", r(rules.sea_only(100 - F.col("depth")), 6, "height"))


# aggregates


VARIABLES = ("lon", "lat", "z", "weight")


@query(with_views("particles", " UNION ALL ".join(f"SELECT '{v}' AS variable, round(min({v}), 6) AS least, round(max({v}), 6) AS most FROM particles" for v in VARIABLES)))
def variable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = particles(spark, sf_dir).agg(*[f(v).alias(f"{v}_{n}") for v in VARIABLES for f, n in ((F.min, "least"), (F.max, "most"))])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.round(f"{v}_least", 6).alias("least"), F.round(f"{v}_most", 6).alias("most")) for v in VARIABLES]))
    return p.select(rows.alias("x")).select("x.*")


@query(with_views("bathymetry", "SELECT round(min(depth), 6) AS least, round(max(depth), 6) AS most, round(avg(depth), 6) AS mean, count(*) * 0.64e0 AS km2, round(sum(depth) * 0.64e0 / 1000, 6) AS km3 FROM bathymetry WHERE ix BETWEEN 5 AND 30 AND depth > 60"))
def depth_area_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bathymetry(spark, sf_dir).filter("ix between 5 and 30 and depth > 60")
    return b.agg(r(F.min("depth"), 6, "least"), r(F.max("depth"), 6, "most"), r(F.avg("depth"), 6, "mean"), (F.count("*") * 0.64).alias("km2"), r(F.sum("depth") * 0.64 / 1000, 6, "km3"))


@query(with_views("forcing", "SELECT CAST(floor(sec / 604800e0) AS BIGINT) AS week, round(avg(sqrt(x_wind * x_wind + y_wind * y_wind)), 6) AS wind, count(*) AS n FROM forcing GROUP BY 1"))
def wind_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forcing(spark, sf_dir)
    return f.groupBy(F.floor(F.col("sec") / 604800).alias("week")).agg(r(F.avg(F.hypot("x_wind", "y_wind")), 6, "wind"), F.count("*").alias("n"))


@query("WITH s AS (SELECT l_suppkey % 40 AS node, date_trunc('month', l_shipdate)::DATE AS month, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), m AS (SELECT node, month, sum(q) AS flow, count(*) AS rivers FROM s GROUP BY ALL) SELECT node, month, round(flow, 4) AS flow, rivers, round(flow / sum(flow) OVER (PARTITION BY month), 8) AS share FROM m")
def river_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rivers that end at one node put together, with their share of the month's runoff."""
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("node"), F.trunc("l_shipdate", "month").alias("month"), "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    m = s.groupBy("node", "month").agg(F.sum("q").alias("flow"), F.count("*").alias("rivers"))
    return m.select("node", "month", r("flow", 4, "flow"), "rivers", r(F.col("flow") / F.sum("flow").over(Window.partitionBy("month")), 8, "share"))


COUNTS = f", g AS (SELECT CAST(floor(step / 24e0) AS BIGINT) AS day, ix, iy, count(*) AS n FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.cells(particles(spark, sf_dir)).groupBy(F.floor(F.col("step") / 24).alias("day"), "ix", "iy").agg(F.count("*").alias("n"))


@query(joined("particles", COUNTS + ", p AS (SELECT a.day, b.ix - a.ix AS lag, sum(a.n * b.n) AS ac FROM g a JOIN g b ON a.day = b.day AND a.iy = b.iy AND b.ix - a.ix BETWEEN 0 AND 5 GROUP BY ALL) SELECT day, round(sum(ac) / max(ac) FILTER (lag = 0), 6) AS length, CAST(least(greatest(2 * floor(sum(ac) / max(ac) FILTER (lag = 0) / 2) + 1, 3), 11) AS BIGINT) AS window_size FROM p GROUP BY day"))
def length_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integral length of each day's counts along rows, from the products of cells up to five apart, and the odd window it asks for.

    Each cell is told to the places of its partners, so that one join on the
    cell gives all lags.
    """
    g = counts(spark, sf_dir)
    told = g.select("day", "iy", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lag"), "ix", F.col("n").alias("m")).withColumn("ix", F.col("ix") + F.col("lag"))
    p = told.join(g, ["day", "ix", "iy"]).groupBy("day", "lag").agg(F.sum(F.col("m") * F.col("n")).alias("ac"))
    length = F.sum("ac") / F.max(F.when(F.col("lag") == 0, F.col("ac")))
    out = p.groupBy("day").agg(length.alias("length"))
    size = F.least(F.greatest(2 * F.floor(F.col("length") / 2) + 1, F.lit(3)), F.lit(11))
    return out.select("day", r("length", 6, "length"), size.cast("bigint").alias("window_size"))


NEIGHBOURHOOD = COUNTS + ", w AS (SELECT a.day, a.ix, a.iy, sum(b.n) AS s, sum(b.n * b.n) AS ss, sum(b.n * (pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2))) AS d FROM g a JOIN g b ON a.day = b.day AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY ALL), h AS (SELECT day, ix, iy, sqrt(d / s / 2) * pow(s * s / ss, -1 / 6e0) AS h FROM w)"


@query(joined("particles", NEIGHBOURHOOD + " SELECT day, round(avg(h) FILTER (h > 0), 8) AS mean, round(stddev_pop(h) FILTER (h > 0), 6) AS std, CAST(ceil(coalesce(max(h), 0) / 0.1e0) AS BIGINT) AS kernels FROM h GROUP BY day"))
def adaptive_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the bandwidths of each day's cells, and how many kernels of 0.1 cells apart they need.

    A cell's bandwidth is the spread of the particles in the 3 by 3 cells
    around it, reduced by their effective number; this is the library's own definition.
    """
    g, near = counts(spark, sf_dir), F.array(F.lit(-1), F.lit(0), F.lit(1))
    told = g.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("day", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"), "n", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"))
    w = told.groupBy("day", "ix", "iy").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.sum(F.col("n") * F.col("d2")).alias("d"))
    w = w.join(g.select("day", "ix", "iy"), ["day", "ix", "iy"], "left_semi")
    h = w.select("day", (F.sqrt(F.col("d") / F.col("s") / 2) * F.pow(F.col("s") * F.col("s") / F.col("ss"), F.lit(-1 / 6))).alias("h"))
    some = F.when(F.col("h") > 0, F.col("h"))
    return h.groupBy("day").agg(r(F.avg(some), 8, "mean"), r(F.stddev_pop(some), 6, "std"), F.ceil(F.coalesce(F.max("h"), F.lit(0.0)) / 0.1).alias("kernels"))


# along tracks


LEGS_TO_NEXT = "SELECT traj_id, step, sec, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(sec) OVER w AS sec2 FROM track WINDOW w AS (PARTITION BY traj_id ORDER BY step)"


@query(with_views("track", f"SELECT traj_id, step, round(distance / (sec2 - sec) * sin(radians(azimuth)), 6) AS u, round(distance / (sec2 - sec) * cos(radians(azimuth)), 6) AS v FROM ({vincenty_sql(LEGS_TO_NEXT, 'lon', 'lat', 'lon2', 'lat2', 'traj_id, step, sec, sec2, lon2')}) WHERE lon2 IS NOT NULL"))
def drifter_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current that takes a drifter to its next position."""
    w = by_traj()
    t = track(spark, sf_dir).select("traj_id", "step", "sec", "lon", "lat", *[F.lead(c).over(w).alias(f"{c}2") for c in ("lon", "lat", "sec")]).filter("lon2 is not null")
    t = t.withColumn("leg", geo.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))
    speed, azimuth = F.col("leg.distance") / (F.col("sec2") - F.col("sec")), F.radians("leg.azimuth")
    return t.select("traj_id", "step", r(speed * F.sin(azimuth), 6, "u"), r(speed * F.cos(azimuth), 6, "v"))


WHOLE = "SELECT traj_id, min_by(lon, step) AS lon, min_by(lat, step) AS lat, max_by(lon, step) AS lon2, max_by(lat, step) AS lat2, max(sec) - min(sec) AS dt FROM track GROUP BY traj_id HAVING count(*) > 1"


@query(with_views("track", f"SELECT traj_id, round(distance / dt * sin(radians(azimuth)), 8) AS u, round(distance / dt * cos(radians(azimuth)), 8) AS v FROM ({vincenty_sql(WHOLE, 'lon', 'lat', 'lon2', 'lat2', 'traj_id, dt', 6)})"))
def track_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean current between a track's first and last positions."""
    place = F.struct("lon", "lat")
    t = track(spark, sf_dir).groupBy("traj_id").agg(F.min_by(place, F.col("step")).alias("a"), F.max_by(place, F.col("step")).alias("b"), (F.max("sec") - F.min("sec")).alias("dt"), F.count("*").alias("n")).filter("n > 1")
    t = t.withColumn("leg", geo.geodesic_inverse(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"), 6))
    speed, azimuth = F.col("leg.distance") / F.col("dt"), F.radians("leg.azimuth")
    return t.select("traj_id", r(speed * F.sin(azimuth), 8, "u"), r(speed * F.cos(azimuth), 8, "v"))


@query(joined("particles forcing", ", a AS (SELECT event_id, 2.5e0 * sin((sec - 3600) / 44712e0 * pi()) AS tide, 0.3e0 AS constant FROM particles) SELECT event_id, round(tide, 6) AS tide, constant, round(tide + constant, 6) AS both FROM a"))
def oscillating_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that swings in time, a constant one, and their sum at the same positions."""
    p = particles(spark, sf_dir)
    swinging = p.select("event_id", (2.5 * F.sin((F.col("sec") - 3600) / 44712.0 * math.pi)).alias("tide"))
    constant = p.select("event_id", F.lit(0.3).alias("constant"))
    both = swinging.join(constant, "event_id")  # two sources are added where both have the position
    return both.select("event_id", r("tide", 6, "tide"), "constant", r(F.col("tide") + F.col("constant"), 6, "both"))


@query(with_views("track", ", d AS (SELECT traj_id, step, weight AS v, abs(weight - lag(weight) OVER w) AS gap, row_number() OVER w AS k FROM track WINDOW w AS (PARTITION BY traj_id ORDER BY step)), s AS (SELECT traj_id, 0.8e0 * stddev_samp(dv) AS t FROM (SELECT traj_id, weight - lag(weight) OVER (PARTITION BY traj_id ORDER BY step) AS dv FROM track) GROUP BY 1), b AS (SELECT d.*, coalesce(gap > t, false) AS big FROM d JOIN s USING (traj_id)), n AS (SELECT *, (k - coalesce(max(CASE WHEN NOT big THEN k END) OVER (PARTITION BY traj_id ORDER BY k), 0)) % 2 = 1 AS bad FROM b), c AS (SELECT *, CASE WHEN NOT bad THEN v END AS clean FROM n), f AS (SELECT *, last_value(CASE WHEN clean IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY k) AS k0, first_value(CASE WHEN clean IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k1, last_value(clean IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY k) AS v0, first_value(clean IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM c) SELECT traj_id, step, bad, round(coalesce(clean, CASE WHEN k1 > k0 THEN v0 + (v1 - v0) * (k - k0) / (k1 - k0) END, v0, v1), 6) AS filled FROM f").replace(") ,", "),", 1))
def despiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that jump from the one before are taken out, and gaps filled linearly.

    A value beside one that was taken out isn't judged, so of a run of jumps
    every second goes.
    """
    w = by_traj()
    t = track(spark, sf_dir).select("traj_id", "step", F.col("weight").alias("v"), (F.col("weight") - F.lag("weight").over(w)).alias("dv"), F.row_number().over(w).alias("k"))
    t = t.withColumn("big", F.coalesce(F.abs("dv") > 0.8 * F.stddev_samp("dv").over(Window.partitionBy("traj_id")), F.lit(False)))
    upto, on = by_traj("k").rowsBetween(Window.unboundedPreceding, 0), by_traj("k").rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("bad", (F.col("k") - F.coalesce(F.max(F.when(~F.col("big"), F.col("k"))).over(upto), F.lit(0))) % 2 == 1)
    t = t.withColumn("clean", F.when(~F.col("bad"), F.struct("k", "v")))
    t = t.withColumns({"a": F.last("clean", ignorenulls=True).over(upto), "b": F.first("clean", ignorenulls=True).over(on)})
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("k") - F.col("a.k")) / F.nullif(F.col("b.k") - F.col("a.k"), F.lit(0))
    return t.select("traj_id", "step", "bad", r(F.coalesce("clean.v", between, "a.v", "b.v"), 6, "filled"))


@query(joined("track forcing", ", e AS (SELECT t.*, f.sst FROM track t ASOF LEFT JOIN forcing f ON t.sec >= f.sec) SELECT traj_id, step, round(sum(coalesce(sst, 0) * coalesce(sec - psec, 0) / 86400) OVER (PARTITION BY traj_id ORDER BY step), 8) AS degree_days FROM (SELECT *, lag(sec) OVER (PARTITION BY traj_id ORDER BY step) AS psec FROM e)"))
def degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.asof_bracket(track(spark, sf_dir), forcing(spark, sf_dir), "sec", ["sst"])
    gained = F.coalesce("sst_before", F.lit(0.0)) * F.coalesce(F.col("sec") - F.lag("sec").over(by_traj()), F.lit(0)) / 86400
    t = t.withColumn("gained", gained)
    return t.select("traj_id", "step", r(F.sum("gained").over(by_traj().rowsBetween(Window.unboundedPreceding, 0)), 8, "degree_days"))


@query(joined("track forcing bathymetry", BRACKET.replace("particles", "track") + ", e AS (SELECT traj_id, step, coalesce(t0 * (1 - coalesce((sec - s0) / nullif(s1 - s0, 0)::DOUBLE, 0)) + t1 * coalesce((sec - s0) / nullif(s1 - s0, 0)::DOUBLE, 0), t0, t1) AS sst, CAST(floor((lon - 12.5e0) * 5) AS BIGINT) AS ix, CAST(floor((lat - 68.5e0) * 10) AS BIGINT) AS iy FROM ba) SELECT traj_id, step, round(sst, 6) AS sst, round(coalesce(depth, 10000), 6) AS depth FROM e LEFT JOIN bathymetry USING (ix, iy)"))
def track_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature, interpolated in time, and depth of the cell along each track; 10 km where there is no cell."""
    t = joins.time_lerp(track(spark, sf_dir), forcing(spark, sf_dir), "sec", ["sst"])
    t = t.withColumns({"ix": F.floor((F.col("lon") - 12.5) * 5), "iy": F.floor((F.col("lat") - 68.5) * 10)}).join(bathymetry(spark, sf_dir), ["ix", "iy"], "left")
    return t.select("traj_id", "step", r("sst", 6, "sst"), r(F.coalesce("depth", F.lit(10000.0)), 6, "depth"))


@query(with_views("particles", f"SELECT step, round(sum(weight), 6) AS mass, round(sum(sum(weight)) OVER (ORDER BY step), 4) AS so_far FROM (SELECT *, {CELLS} FROM particles) WHERE ix BETWEEN 7 AND 8 AND iy BETWEEN 5 AND 7 GROUP BY step"))
def position_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of the mass around one position; rows are those of few cells, one for each step."""
    p = GRID.cells(particles(spark, sf_dir)).filter("ix between 7 and 8 and iy between 5 and 7")
    s = p.groupBy("step").agg(F.sum("weight").alias("m"))
    return s.select("step", r("m", 6, "mass"), r(F.sum("m").over(Window.orderBy("step")), 4, "so_far"))


@query(joined("particles forcing", ", m AS (SELECT min(sec) a, max(sec) b FROM forcing), s AS (SELECT unnest(range(a, b, 7200)) AS sec, 0 AS event_id FROM m), " + BRACKET.lstrip(", ").replace("FROM particles p", "FROM s p") + " SELECT sec, round(coalesce(t0 * (1 - coalesce((sec - s0) / nullif(s1 - s0, 0)::DOUBLE, 0)) + t1 * coalesce((sec - s0) / nullif(s1 - s0, 0)::DOUBLE, 0), t0, t1), 6) AS sst FROM ba"))
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forcing at every second hour between its first and last times."""
    f = forcing(spark, sf_dir)
    spine = f.agg(F.min("sec").alias("a"), F.max("sec").alias("b")).select(F.explode(F.sequence("a", F.col("b") - 1, F.lit(7200).cast("bigint"))).alias("sec"))
    return joins.time_lerp(spine, f, "sec", ["sst"]).select("sec", r("sst", 6, "sst"))


@query(with_views("track", ", n AS (SELECT *, step - min(step) OVER (PARTITION BY traj_id) AS rel, min(step) OVER (PARTITION BY traj_id) AS s0 FROM track), g AS (SELECT a.traj_id, a.step, " + METRES.format(a="a", b="b") + " AS gap FROM n a JOIN n b ON b.traj_id = a.traj_id + 1 AND b.rel = a.rel AND abs(a.s0 - b.s0) <= 24) SELECT traj_id, count(*) AS n, round(avg(gap), 3) AS gap FROM g GROUP BY traj_id").replace(") ,", "),", 1))
def aligned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean separation of each track from the next one at equal steps since their starts, which are a day apart at most."""
    first = F.min("step").over(Window.partitionBy("traj_id"))
    t = track(spark, sf_dir).select("traj_id", "lon", "lat", (F.col("step") - first).alias("rel"), first.alias("s0"))
    other = t.select((F.col("traj_id") - 1).alias("traj_id"), "rel", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("s0").alias("other"))
    g = t.join(other, ["traj_id", "rel"]).filter(F.abs(F.col("s0") - F.col("other")) <= 24)
    return g.groupBy("traj_id").agg(F.count("*").alias("n"), r(F.avg(joins.metres("lon", "lat", "lon2", "lat2")), 3, "gap"))


@query(joined("track forcing", ", e AS (SELECT t.*, f.x_wind, f.y_wind, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(t.sec) OVER w - t.sec AS dt FROM track t ASOF JOIN forcing f ON t.sec >= f.sec WINDOW w AS (PARTITION BY traj_id ORDER BY step)), k AS (SELECT *, unnest(range(0, 11)) AS k FROM e WHERE lon2 IS NOT NULL), s AS (SELECT traj_id, k, sum(sqrt(pow((lon2 - lon) * cos(radians(lat)) * 111194.92664455873e0 - k * 0.005e0 * x_wind * dt, 2) + pow((lat2 - lat) * 111194.92664455873e0 - k * 0.005e0 * y_wind * dt, 2))) AS miss FROM k GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY round(miss, 3), k) AS rn FROM s) SELECT traj_id, k * 0.005e0 AS factor, round(miss, 2) AS miss FROM b WHERE rn = 1"))
def drift_factor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eleven wind factors the one that misses a track's positions least; sums by factor come first."""
    t = joins.asof_bracket(track(spark, sf_dir), forcing(spark, sf_dir), "sec", ["x_wind", "y_wind"]).filter("sec_before is not null")
    w = by_traj()
    t = t.withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w), "dt": F.lead("sec").over(w) - F.col("sec")}).filter("lon2 is not null")
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    east = (F.col("lon2") - F.col("lon")) * F.cos(F.radians("lat")) * joins.DEGREE - F.col("k") * 0.005 * F.col("x_wind_before") * F.col("dt")
    north = (F.col("lat2") - F.col("lat")) * joins.DEGREE - F.col("k") * 0.005 * F.col("y_wind_before") * F.col("dt")
    s = t.groupBy("traj_id", "k").agg(F.sum(F.sqrt(east * east + north * north)).alias("miss"))
    best = s.groupBy("traj_id").agg(F.min(F.struct(F.round("miss", 3).alias("rounded"), "k", "miss")).alias("b"))
    return best.select("traj_id", (F.col("b.k") * 0.005).alias("factor"), r("b.miss", 2, "miss"))


# names and times


@query("SELECT event_id, CAST(epoch_us(ts) // 86400000000 + 40587 AS BIGINT) AS itime, CAST(epoch_us(ts) % 86400000000 // 1000 AS BIGINT) AS itime2, round(epoch_us(ts) / 86400000000e0 + 40587, 6) AS mjd, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S') AS shifted FROM events")
def model_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and milliseconds since 17 November 1858, and the time a day and a half on, as text and back."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    day = F.floor(us / 86400000000)
    shifted = F.date_format(F.col("ts") + F.expr("interval 36 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    e = e.select("event_id", (day + 40587).alias("itime"), F.floor((us - day * 86400000000) / 1000).alias("itime2"), r(us / 86400000000.0 + 40587, 6, "mjd"), shifted.alias("shifted"))
    return e.filter(F.to_timestamp("shifted", "yyyy-MM-dd'T'HH:mm:ss").isNotNull())


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), d AS (SELECT name, levenshtein(lower(name), 'smal gizm') AS d, contains(lower(name), 'giz') AS inside FROM n) SELECT name, d, inside FROM (SELECT *, row_number() OVER (ORDER BY d, name) AS rn FROM d) WHERE rn <= 20 OR inside")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty names nearest to a wrong one by edits, and all that contain a part of it."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    n = n.select("name", F.levenshtein(F.lower("name"), F.lit("smal gizm")).cast("bigint").alias("d"), F.lower("name").contains("giz").alias("inside"))
    near = n.orderBy("d", "name").limit(20)
    return near.unionByName(n.filter("inside")).distinct()


@query("WITH f AS (SELECT p_partkey, 'run_' || (p_partkey % 97) || '_grid' || (p_partkey % 1000) || '.nc' AS file, (p_partkey % 90) || '.' || (p_partkey % 60) || '.' || (p_partkey % 59) AS dms, p_type FROM part) SELECT p_partkey, CAST(regexp_extract(file, 'grid(\\d+)', 1) AS INT) AS key, round(CAST(split_part(dms, '.', 1) AS INT) + CAST(split_part(dms, '.', 2) AS INT) / 60e0 + CAST(split_part(dms, '.', 3) AS INT) / 3600e0, 8) AS degrees FROM f WHERE regexp_matches(p_type, '^(SMALL|ECO.*)$')".replace("\\\\", "\\"))
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in file names, by which they are listed, degrees from texts like 70.11.19, for types that a pattern picks."""
    k = F.col("p_partkey")
    f = table(spark, sf_dir, "part").filter(F.col("p_type").rlike("^(SMALL|ECO.*)$"))
    f = f.select("p_partkey", F.concat(F.lit("run_"), k % 97, F.lit("_grid"), k % 1000, F.lit(".nc")).alias("file"), F.concat_ws(".", k % 90, k % 60, k % 59).alias("dms"))
    part = lambda n: F.split_part("dms", F.lit("."), F.lit(n)).cast("int")
    f = f.select("p_partkey", F.regexp_extract("file", r"grid(\d+)", 1).cast("int").alias("key"), r(part(1) + part(2) / 60.0 + part(3) / 3600.0, 8, "degrees"))
    return f.orderBy("key", "p_partkey")


@query(with_views("profiles", "SELECT profile_id, round(values[profile_id % 5 + 1], 6) AS picked FROM profiles"))
def ensemble_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of five that each element takes by its number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("profile_id"), r(F.element_at(F.slice("embedding", 1, 5), (F.col("vec_id") % 5 + 1).cast("int")).cast("double"), 6, "picked"))
