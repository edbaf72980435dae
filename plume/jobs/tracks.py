"""Queries on trajectories, lookups and profiles, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.functions import geo, physics
from plume.operators import joins, trajectory, vertical
from plume.operators.grid import GridSpec
from plume.sources.fixtures import bathymetry, forcing, particles, profiles, sites, table, track, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(with_views("track", "SELECT traj_id, min(step) AS first_step, max(step) AS last_step, count(*) AS n FROM track GROUP BY traj_id"))
def first_last_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).groupBy("traj_id").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("n"))


@query(with_views("track", "SELECT traj_id, step, round(z - lag(z) OVER w, 6) AS dz, CASE WHEN lag(step) OVER w IS NULL THEN 'activated' WHEN lead(step) OVER w IS NULL THEN 'deactivated' ELSE 'continuing' END AS phase FROM track WINDOW w AS (PARTITION BY traj_id ORDER BY step)"))
def vertical_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trajectory.classify(track(spark, sf_dir).withColumns(trajectory.previous("z")))
    return t.select("traj_id", "step", F.round(F.col("z") - F.col("prev_z"), 6).alias("dz"), "phase")




def vincenty_sql(source: str, lon1: str, lat1: str, lon2: str, lat2: str, keep: str, rounds: int = 4) -> str:
    """Nested selects that unroll Vincenty's inverse formula; result columns: ``keep``, distance (m), azimuth."""
    a, f = "6378137e0", "(1e0 / 298.257223563e0)"
    b = f"({a} * (1 - {f}))"
    q = f"SELECT {keep}, radians({lon2} - {lon1}) AS l, radians({lon2} - {lon1}) AS lam, atan((1 - {f}) * tan(radians({lat1}))) AS u1, atan((1 - {f}) * tan(radians({lat2}))) AS u2 FROM ({source})"
    for _ in range(rounds):
        q = f"SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM ({q})"
        q = f"SELECT *, atan2(ss, cs) AS s, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM ({q})"
        q = f"SELECT *, 1 - sa * sa AS c2a, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS c2m FROM ({q})"
        q = f"SELECT *, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS cc FROM ({q})"
        q = f"SELECT {keep}, l, u1, u2, l + (1 - cc) * {f} * sa * (s + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))) AS lam, ss AS pss, cs AS pcs, s AS ps, c2a AS pc2a, c2m AS pc2m FROM ({q})"
        inner, q = q, f"SELECT {keep}, l, u1, u2, lam FROM ({q})"
    q = f"SELECT *, pc2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS uu FROM ({inner})"
    q = f"SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ba, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM ({q})"
    q = f"SELECT *, bb * pss * (pc2m + bb / 4 * (pcs * (2 * pc2m * pc2m - 1) - bb / 6 * pc2m * (4 * pss * pss - 3) * (4 * pc2m * pc2m - 3))) AS ds FROM ({q})"
    return f"SELECT {keep}, {b} * ba * (ps - ds) AS distance, degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) AS azimuth FROM ({q})"


LEGS = "SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(sec) OVER w AS psec FROM track WINDOW w AS (PARTITION BY traj_id ORDER BY step)"


@query(with_views("track", f"SELECT traj_id, step, round(coalesce(distance, 0), 2) AS distance, round(CASE WHEN coalesce(distance / nullif(sec - psec, 0), 0) > 100 THEN 0 ELSE coalesce(distance / nullif(sec - psec, 0), 0) END, 5) AS speed, round(sum(coalesce(distance, 0)) OVER (PARTITION BY traj_id ORDER BY step), 1) AS length FROM ({vincenty_sql(LEGS, 'plon', 'plat', 'lon', 'lat', 'traj_id, step, sec, psec')})"))
def trajectory_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trajectory.lengths(track(spark, sf_dir))
    return t.select("traj_id", "step", F.round("distance", 2).alias("distance"), F.round("speed", 5).alias("speed"), F.round("length", 1).alias("length"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track as observed, and with small shifts as modelled."""
    return track(spark, sf_dir).withColumns({"lon2": F.col("lon") + (F.col("event_id") % 7 - 3) * 0.03, "lat2": F.col("lat") + (F.col("event_id") % 5 - 2) * 0.03})


SHIFTED = "SELECT *, lon + (event_id % 7 - 3) * 0.03e0 AS lon2, lat + (event_id % 5 - 2) * 0.03e0 AS lat2, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, row_number() OVER w - 1 AS n FROM track WINDOW w AS (PARTITION BY traj_id ORDER BY step)"
GAPS = vincenty_sql(SHIFTED, "lon", "lat", "lon2", "lat2", "traj_id, step, lon, lat, plon, plat, n")


@query(with_views("track", f", gaps AS ({GAPS}), legs AS ({vincenty_sql('SELECT *, distance AS gap FROM gaps', 'plon', 'plat', 'lon', 'lat', 'traj_id, step, gap')}), sums AS (SELECT *, sum(coalesce(distance, 0)) OVER (PARTITION BY traj_id ORDER BY step) AS way FROM legs) SELECT traj_id, round(greatest(1 - sum(gap) / nullif(sum(way), 0), 0), 6) AS skill FROM sums GROUP BY traj_id").replace(") , gaps", "), gaps", 1))
def skill_liu_weisberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.liu_weisberg(pairs(spark, sf_dir))


@query(with_views("track", f", gaps AS (SELECT *, max(CAST(distance >= 32000 AS INT)) OVER (PARTITION BY traj_id ORDER BY step) AS lost FROM ({GAPS}) WHERE n BETWEEN 1 AND 5) SELECT traj_id, CAST(sum(CASE WHEN lost = 1 THEN 0 ELSE floor([1, 2, 5, 10, 20][n] * CASE WHEN distance < 4000 THEN 5 WHEN distance < 8000 THEN 2 WHEN distance < 16000 THEN 1 WHEN distance < 32000 THEN 0.25e0 ELSE 0 END) END) AS BIGINT) AS points FROM gaps GROUP BY traj_id").replace(") , gaps", "), gaps", 1))
def skill_darpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.darpa(pairs(spark, sf_dir))


K0 = "(2 * sqrt(n) / (1 + n))"


@query(with_views("particles", """, k AS (SELECT event_id, radians(lat) AS phi, radians(lon - 15) AS lam, (1 / 298.257223563e0) / (2 - 1 / 298.257223563e0) AS n FROM particles),
t AS (SELECT *, sinh(atanh(sin(phi)) - """ + K0 + " * atanh(" + K0 + """ * sin(phi))) AS t FROM k), e AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 0.9996e0 * 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r FROM t)
SELECT event_id, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS east, round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS north FROM e""").replace(") , k", "), k", 1))
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.utm_forward(F.col("lon"), F.col("lat"))
    return particles(spark, sf_dir).select("event_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(with_views("particles", "SELECT event_id, round(((lon * 20 + 180) % 360 + 360) % 360 - 180, 6) AS lon180, round(((lon * 20) % 360 + 360) % 360, 6) AS lon360 FROM particles"))
def lon_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = F.col("lon") * 20
    return particles(spark, sf_dir).select("event_id", F.round(geo.wrap_longitude(lon), 6).alias("lon180"), F.round(geo.wrap_longitude(lon, 0.0), 6).alias("lon360"))


@query(with_views("particles forcing", "SELECT event_id, round(x_wind * cos(radians(lon)) - y_wind * sin(radians(lon)), 6) AS u, round(x_wind * sin(radians(lon)) + y_wind * cos(radians(lon)), 6) AS v FROM particles p ASOF JOIN forcing f ON p.sec >= f.sec"))
def vector_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = joins.asof_bracket(particles(spark, sf_dir), forcing(spark, sf_dir), "sec", ["x_wind", "y_wind"]).filter("sec_before is not null")
    u, v = geo.rotate(F.col("x_wind_before"), F.col("y_wind_before"), F.radians("lon"))
    return p.select("event_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


BRACKET = """, b AS (SELECT p.*, f.sec AS s0, f.x_wind AS x0, f.y_wind AS y0, f.sst AS t0 FROM particles p ASOF LEFT JOIN forcing f ON p.sec >= f.sec),
ba AS (SELECT b.*, f.sec AS s1, f.x_wind AS x1, f.y_wind AS y1, f.sst AS t1 FROM b ASOF LEFT JOIN forcing f ON b.sec <= f.sec)"""
NEAREST = BRACKET + ", near AS (SELECT *, CASE WHEN coalesce(s1 - sec <= sec - s0, s0 IS NULL) THEN x1 ELSE x0 END AS x_wind, CASE WHEN coalesce(s1 - sec <= sec - s0, s0 IS NULL) THEN y1 ELSE y0 END AS y_wind, CASE WHEN coalesce(s1 - sec <= sec - s0, s0 IS NULL) THEN t1 ELSE t0 END AS sst FROM ba)"


def joined(names: str, body: str) -> str:
    return with_views(names, body).replace(") ,", "),", 1)


def forward_sql(source: str, keep: str, rounds: int = 4) -> str:
    """Nested selects that unroll Vincenty's direct formula for lon, lat, az (degrees) and dist (m): ``keep``, lon1, lat1."""
    a, f = "6378137e0", "(1e0 / 298.257223563e0)"
    b = f"({a} * (1 - {f}))"
    q = f"SELECT {keep}, lon, radians(az) AS a1, (1 - {f}) * tan(radians(lat)) AS tu, dist FROM ({source})"
    q = f"SELECT *, 1 / sqrt(1 + tu * tu) AS cu, atan2(tu, cos(a1)) AS s1 FROM ({q})"
    q = f"SELECT *, tu * cu AS su, cu * sin(a1) AS sa FROM ({q})"
    q = f"SELECT *, (1 - sa * sa) * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS uu FROM ({q})"
    q = f"SELECT *, dist / ({b} * (1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))))) AS s0, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM ({q})"
    q = f"SELECT *, s0 AS s FROM ({q})"
    for _ in range(rounds):
        q = f"SELECT *, cos(2 * s1 + s) AS m2 FROM ({q})"
        q = f"SELECT * EXCLUDE (s, m2), s0 + bb * sin(s) * (m2 + bb / 4 * (cos(s) * (2 * m2 * m2 - 1) - bb / 6 * m2 * (4 * sin(s) * sin(s) - 3) * (4 * m2 * m2 - 3))) AS s FROM ({q})"
    q = f"SELECT *, su * sin(s) - cu * cos(s) * cos(a1) AS t, cos(2 * s1 + s) AS m2, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS c FROM ({q})"
    return f"SELECT {keep}, lon + degrees(atan2(sin(s) * sin(a1), cu * cos(s) - su * sin(s) * cos(a1)) - (1 - c) * {f} * sa * (s + c * sin(s) * (m2 + c * cos(s) * (2 * m2 * m2 - 1)))) AS lon1, degrees(atan2(su * cos(s) + cu * sin(s) * cos(a1), (1 - {f}) * sqrt(sa * sa + t * t))) AS lat1 FROM ({q})"


DRIFT = "traj_id, step, x_wind, y_wind, dt, lon2, lat2"
CARRIED = forward_sql(f"SELECT traj_id, step, x_wind, y_wind, lead(sec) OVER w - sec AS dt, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lon, lat, degrees(atan2(x_wind * 0.01e0, y_wind * 0.01e0)) AS az, sqrt(pow(x_wind * 0.01e0, 2) + pow(y_wind * 0.01e0, 2)) * (lead(sec) OVER w - sec) AS dist FROM near WINDOW w AS (PARTITION BY traj_id ORDER BY step)", DRIFT)
RESIDUAL = vincenty_sql(f"SELECT * FROM ({CARRIED}) WHERE lon2 IS NOT NULL", "lon1", "lat1", "lon2", "lat2", DRIFT)


@query(joined("track forcing", NEAREST.replace("FROM particles p", "FROM track p") + f", r AS (SELECT traj_id, step, distance / nullif(dt * sqrt(x_wind * x_wind + y_wind * y_wind), 0) AS factor, ((azimuth - degrees(atan2(x_wind, y_wind))) % 360 + 360) % 360 AS turn FROM ({RESIDUAL})) SELECT traj_id, step, round(factor, 6) AS factor, round(CASE WHEN turn > 180 THEN turn - 360 ELSE turn END, 3) AS offset FROM r"))
def wind_drift_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.asof_nearest(track(spark, sf_dir), forcing(spark, sf_dir), "sec", ["x_wind", "y_wind"])
    t = t.withColumns({"x_current": F.col("x_wind") * 0.01, "y_current": F.col("y_wind") * 0.01})
    return trajectory.wind_drift(t).select("traj_id", "step", F.round("factor", 6).alias("factor"), F.round("offset", 3).alias("offset"))


@query(joined("particles forcing", NEAREST + " SELECT event_id, round(x_wind, 6) AS x_wind, round(y_wind, 6) AS y_wind, round(sst, 6) AS sst FROM near"))
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = joins.asof_nearest(particles(spark, sf_dir), forcing(spark, sf_dir), "sec", ["x_wind", "y_wind", "sst"])
    return p.select("event_id", *[F.round(c, 6).alias(c) for c in ("x_wind", "y_wind", "sst")])


@query(joined("particles forcing", BRACKET + " SELECT event_id, round(coalesce(t0 * (1 - coalesce((sec - s0) / nullif(s1 - s0, 0)::DOUBLE, 0)) + t1 * coalesce((sec - s0) / nullif(s1 - s0, 0)::DOUBLE, 0), t0, t1), 9) AS sst FROM ba"))
def time_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.time_lerp(particles(spark, sf_dir), forcing(spark, sf_dir), "sec", ["sst"]).select("event_id", F.round("sst", 9).alias("sst"))


SPEED = "sqrt(x_wind * x_wind + y_wind * y_wind)"
SC = "(2101.2e0 + sst * (-131.54e0 + sst * (4.4931e0 + sst * (-0.08676e0 + sst * 0.00070663e0))))"
TRANSFER = f"(0.251e0 * (x_wind * x_wind + y_wind * y_wind) * pow({SC} / 660, -0.5e0))"


def with_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = joins.asof_nearest(particles(spark, sf_dir), forcing(spark, sf_dir), "sec", ["x_wind", "y_wind", "sst"])
    return p.withColumn("wind", F.sqrt(F.col("x_wind") ** 2 + F.col("y_wind") ** 2))


@query(joined("particles forcing", NEAREST + f" SELECT event_id, round({SC}, 6) AS schmidt, round({TRANSFER}, 6) AS velocity, round({TRANSFER} * weight / (800e0 * 800 * 25) * 800 * 800 * 0.01e0, 8) AS flux FROM near"))
def air_sea_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, sst = GridSpec(), F.col("sst")
    k = physics.gas_transfer_velocity(F.col("wind"), sst)
    flux = physics.air_sea_flux(k, F.col("weight") / grid.volume, grid.side)
    return with_wind(spark, sf_dir).select("event_id", F.round(physics.schmidt_number(sst), 6).alias("schmidt"), F.round(k, 6).alias("velocity"), F.round(flux, 8).alias("flux"))


@query(joined("particles forcing", NEAREST + f" SELECT step, round(sum({TRANSFER} * weight / 25 * 0.01e0) FILTER (z >= -25), 6) AS flux, count(*) FILTER (z >= -25) AS n FROM near GROUP BY step"))
def flux_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_wind(spark, sf_dir)
    top = F.col("z") >= -25
    flux = physics.gas_transfer_velocity(F.col("wind"), F.col("sst")) * F.col("weight") / 25 * 0.01
    return p.groupBy("step").agg(F.round(F.sum(F.when(top, flux)), 6).alias("flux"), F.count(F.when(top, 1)).alias("n"))


SAL = "(30 + event_id % 60 / 10e0)"
R1 = "(((((6.536332e-9 * sst - 1.120083e-6) * sst + 1.001685e-4) * sst - 9.09529e-3) * sst + 6.793952e-2) * sst - 28.263737e0)"
R2 = "((((5.3875e-9 * sst - 8.2467e-7) * sst + 7.6438e-5) * sst - 4.0899e-3) * sst + 8.24493e-1)"
R3 = "((-1.6546e-6 * sst + 1.0227e-4) * sst - 5.72466e-3)"


@query(joined("particles forcing", NEAREST + f" SELECT event_id, round({R1} + (4.8314e-4 * {SAL} + {R3} * sqrt({SAL}) + {R2}) * {SAL} + 1028.106331e0, 6) AS density FROM near"))
def seawater_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    salinity = 30 + F.col("event_id") % 60 / 10.0
    return with_wind(spark, sf_dir).select("event_id", F.round(physics.seawater_density(F.col("sst"), salinity), 6).alias("density"))


PERIOD = "(2 * pi() / CASE WHEN w > 0 THEN 0.877e0 * 9.81e0 / (1.17e0 * w) ELSE 5 END)"
KM = f"(0.02e0 * w / (2 * (2 * pi() / {PERIOD} * pow(0.0246e0 * w * w, 2) / 16)))"


@query(joined("particles forcing", NEAREST + f", s AS (SELECT *, {SPEED} AS w FROM near) SELECT event_id, round(0.0246e0 * w * w, 6) AS height, round({PERIOD}, 6) AS period, round(greatest(0.032e0 * (w - 5) / {PERIOD}, 0), 8) AS breaking, round(9.81e0 * 1028 * pow(0.0246e0 * w * w, 2) / 16, 4) AS energy, round(CASE WHEN w > 11 THEN 0.001e0 * (0.49e0 + 0.065e0 * w) ELSE 0.0012e0 END, 8) AS drag FROM s"))
def wave_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("wind")
    h = physics.wave_height(w)
    return with_wind(spark, sf_dir).select("event_id", F.round(h, 6).alias("height"), F.round(physics.wave_period(w), 6).alias("period"), F.round(physics.breaking_fraction(w), 8).alias("breaking"), F.round(physics.wave_energy(h), 4).alias("energy"), F.round(physics.drag_coefficient(w), 8).alias("drag"))


@query(joined("particles forcing", NEAREST + f", s AS (SELECT *, {SPEED} AS w FROM near), k AS (SELECT *, {KM} AS km, greatest(z, -20) AS zz FROM s WHERE w > 1) SELECT event_id, round(0.02e0 * w * exp(2 * km * zz), 8) AS monochromatic, round(0.02e0 * w * exp(2 * km / 3 * zz) / (1 - 8 * km / 3 * zz), 8) AS exponential FROM k"))
def stokes_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("wind")
    args = (0.02 * w, physics.wave_height(w), physics.wave_period(w), F.greatest("z", F.lit(-20.0)))
    return with_wind(spark, sf_dir).filter("wind > 1").select("event_id", F.round(physics.stokes_monochromatic(*args), 8).alias("monochromatic"), F.round(physics.stokes_exponential(*args), 8).alias("exponential"))


@query(joined("particles forcing", NEAREST + f", s AS (SELECT *, {SPEED} AS w, -z AS d FROM near) SELECT event_id, round(CASE WHEN d >= 50 THEN 0 WHEN d > 49 THEN (76.1e-4 + 2.26e-4 * w * w) / 2 ELSE 76.1e-4 + 2.26e-4 * w * w END, 8) AS sundby, round(CASE WHEN d >= 50 THEN 0 ELSE 50 * 0.2e0 * 0.4e0 * (d / 50 - 2 * pow(d / 50, 2) + pow(d / 50, 3)) * w * w * 1.25e-3 * 1.22e0 END, 8) AS large FROM s"))
def diffusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, d = F.col("wind"), -F.col("z")
    return with_wind(spark, sf_dir).select("event_id", F.round(physics.diffusivity_sundby(w, d), 8).alias("sundby"), F.round(physics.diffusivity_large(w, d), 8).alias("large"))


DROP = "(4 * sqrt(0.02e0 / ((1028 - 900) * 9.81e0)))"


@query(joined("particles forcing", NEAREST + f", s AS (SELECT *, {SPEED} AS w FROM near) SELECT event_id, round(CASE WHEN w > 0 THEN 1e6 * 4.604e-10 * pow(1028 * 9.81e0 * 0.0246e0 * w * w * {DROP} / 0.02e0, 1.805e0) * pow(0.005e0 / sqrt(900 * 0.02e0 * {DROP}), -1.023e0) * greatest(0.032e0 * (w - 5) / {PERIOD}, 0) ELSE 0 END, 4) AS per_million FROM s"))
def oil_entrainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = physics.entrainment_rate(F.lit(0.005), F.lit(900.0), 0.02, F.col("wind"))
    return with_wind(spark, sf_dir).select("event_id", F.round(1e6 * rate, 4).alias("per_million"))


DAY = "dayofyear(ts)"
DECL = f"degrees(asin(radians(-23.44e0) * cos(radians(360e0 / 365.24e0 * ({DAY} + 10) + 360e0 / pi() * 0.0167e0 * sin(radians(360e0 / 365.24e0 * ({DAY} - 2)))))))"
GAM = f"(2 * pi() / 365e0 * ({DAY} - 1 + (hour(ts) - 12) / 24e0))"
EQT = f"229.18e0 * (0.000075e0 + 0.001868e0 * cos({GAM}) - 0.032077e0 * sin({GAM}) - 0.014615e0 * cos(2 * {GAM}) - 0.040849e0 * sin(2 * {GAM}))"


@query(with_views("particles", f", s AS (SELECT *, {DECL} AS d, (hour(ts) * 60 + minute(ts) + second(ts) / 60e0 + {EQT} + 4 * lon) / 4 - 180 AS h FROM particles) SELECT event_id, round(d, 6) AS declination, round(h, 5) AS hour_angle, round(degrees(asin(sin(radians(lat)) * sin(radians(d)) + cos(radians(lat)) * cos(radians(d)) * cos(radians(h)))), 5) AS elevation FROM s").replace(") ,", "),", 1))
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, lon = F.col("ts"), F.col("lon")
    return particles(spark, sf_dir).select("event_id", F.round(physics.declination(F.dayofyear(ts)), 6).alias("declination"), F.round(physics.hour_angle(ts, lon), 5).alias("hour_angle"), F.round(physics.solar_elevation(ts, lon, F.col("lat")), 5).alias("elevation"))


@query(with_views("particles", ", a AS (SELECT event_id, weight AS v FROM particles WHERE event_id % 3 = 0), b AS (SELECT event_id, weight * 2 AS v FROM particles WHERE event_id % 2 = 0) SELECT event_id, round(coalesce(a.v, b.v, -1), 6) AS v FROM particles LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)").replace(") ,", "),", 1))
def priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = particles(spark, sf_dir).select("event_id", "weight")
    a = p.filter("event_id % 3 = 0").select("event_id", F.col("weight").alias("v"))
    b = p.filter("event_id % 2 = 0").select("event_id", (F.col("weight") * 2).alias("v"))
    return joins.priority_coalesce(p.select("event_id"), [a, b], ["event_id"], ["v"], {"v": -1.0}).select("event_id", F.round("v", 6).alias("v"))


@query(joined("particles forcing", NEAREST + f" SELECT event_id, CASE WHEN x_wind BETWEEN -15 AND 15 THEN round(x_wind, 6) END AS x_wind, round({SPEED}, 6) AS speed, round(((degrees(atan2(0 - x_wind, 0 - y_wind)) % 360) + 360) % 360, 4) AS from_direction, round(CASE WHEN sst > 20 THEN sst - 5 ELSE sst END, 6) AS sst FROM near"))
def derived_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, sst = F.col("x_wind"), F.col("y_wind"), F.col("sst")
    return with_wind(spark, sf_dir).select(
        "event_id",
        F.when(u.between(-15, 15), F.round(u, 6)).alias("x_wind"),
        F.round("wind", 6).alias("speed"),
        F.round(F.pmod(F.degrees(F.atan2(0 - u, 0 - v)), F.lit(360.0)), 4).alias("from_direction"),
        F.round(F.when(sst > 20, sst - 5).otherwise(sst), 6).alias("sst"),
    )


METRES = "(sqrt(pow(({a}.lon - {b}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + pow({a}.lat - {b}.lat, 2)) * 111194.92664455873e0)"
NEAR_SITES = f", s AS (SELECT event_id, site_id, {METRES.format(a='p', b='s')} AS d FROM particles p, sites s)"


def site_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return particles(spark, sf_dir).select("event_id", "lon", "lat", "weight"), sites(spark, sf_dir).select("site_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))


@query(with_views("particles sites", NEAR_SITES + " SELECT event_id, site_id, round(d, 3) AS distance FROM s WHERE d <= 20000").replace(") ,", "),", 1))
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = site_pairs(spark, sf_dir)
    near = joins.radius_join_by_place(p, s, "event_id", 20000.0).select("ids", "site_id", F.round("distance", 3).alias("distance"))
    return near.select(F.explode("ids").alias("event_id"), "site_id", "distance")


@query(with_views("particles sites", NEAR_SITES + ", r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, site_id) AS rn FROM s) SELECT event_id, site_id, round(d, 3) AS distance FROM r WHERE rn = 1").replace(") ,", "),", 1))
def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = site_pairs(spark, sf_dir)
    return joins.nearest(p, s, "event_id", "site_id", 40000.0).select("event_id", "site_id", F.round("distance", 3).alias("distance"))


DEAD = f", live AS (SELECT * FROM particles WHERE specie <> 3), pr AS (SELECT a.event_id AS dead, a.weight, b.event_id AS live, {METRES.format(a='a', b='b')} AS d FROM particles a JOIN live b ON a.step = b.step WHERE a.specie = 3), r AS (SELECT *, row_number() OVER (PARTITION BY dead ORDER BY d, live) AS rn FROM pr WHERE d <= 60000), w AS (SELECT *, (1 / (d + 1e-10)) / sum(1 / (d + 1e-10)) OVER (PARTITION BY dead) AS share FROM r WHERE rn <= 10)"


@query(with_views("particles", DEAD + " SELECT live AS event_id, round(sum(weight * share), 6) AS received FROM w GROUP BY live UNION ALL SELECT -1, round(coalesce(sum(weight), 0), 4) FROM particles WHERE specie = 3 AND event_id NOT IN (SELECT dead FROM w)").replace(") ,", "),", 1))
def knn_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of dead particles shared by inverse distance among the ten nearest live ones of the step.

    The radius suits the density of the particles at hand. What has no live
    particle in reach is the row of event_id -1.
    """
    p = particles(spark, sf_dir)
    dead = p.filter("specie = 3").select(F.col("event_id").alias("dead"), "step", "lon", "lat", "weight")
    live = p.filter("specie <> 3").select(F.col("event_id").alias("live"), "step", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    near = joins.inverse_distance_shares(joins.nearest_k(dead, live, "dead", "live", 10, 60000.0, on=("step",)), "dead")
    placed = near.groupBy(F.col("live").alias("event_id")).agg(F.round(F.sum(F.col("weight") * F.col("share")), 6).alias("received"))
    left = dead.join(near.select("dead"), "dead", "left_anti").agg(F.lit(-1).cast("bigint").alias("event_id"), F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 4).alias("received"))
    return placed.union(left)


@query(with_views("track", "SELECT traj_id, step FROM (SELECT *, max(CAST(NOT (lon BETWEEN 12.6 AND 20.9 AND lat BETWEEN 68.6 AND 71.9) AS INT)) OVER (PARTITION BY traj_id ORDER BY step) AS gone FROM track) WHERE gone = 0"))
def never_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = ~(F.col("lon").between(12.6, 20.9) & F.col("lat").between(68.6, 71.9))
    return track(spark, sf_dir).withColumn("gone", trajectory.ever(outside)).filter(~F.col("gone")).select("traj_id", "step")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.filter("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("(SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') EXCEPT SELECT user_id FROM events WHERE value > 480")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda c: e.filter(c).select("user_id")
    return of("event_type = 'click'").intersect(of("event_type = 'purchase'")).subtract(of("value > 480"))


LEVEL = "(profile_id % 620 / 10e0)"


def lerp_sql(z: str) -> str:
    low = f"least(CAST(floor(least(greatest({z}, 0), len(values) - 1)) AS BIGINT), len(values) - 2)"
    return f"(values[{low} + 1] * (1 - (least(greatest({z}, 0), len(values) - 1) - {low})) + values[{low} + 2] * (least(greatest({z}, 0), len(values) - 1) - {low}))"


@query(with_views("profiles", f"SELECT profile_id, round({lerp_sql(LEVEL)}, 6) AS linear, round(values[CAST(round_even({LEVEL}, 0) AS BIGINT) + 1], 6) AS nearest FROM profiles"))
def profile_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("profile_id") % 620 / 10.0
    return profiles(spark, sf_dir).select("profile_id", F.round(vertical.linear_at(F.col("values"), z), 6).alias("linear"), F.round(vertical.nearest_at(F.col("values"), z), 6).alias("nearest"))


@query(with_views("profiles", "SELECT profile_id, unnest(range(0, len(values))) AS level, round(unnest(list_transform(range(1, len(values) + 1), lambda i: (values[least(i + 1, len(values))] - values[greatest(i - 1, 1)]) / (least(i + 1, len(values)) - greatest(i - 1, 1)))), 6) AS gradient FROM profiles"))
def profile_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(spark, sf_dir).select("profile_id", F.posexplode(vertical.gradient(F.col("values"))).alias("level", "gradient"))
    return p.select("profile_id", F.col("level").cast("bigint").alias("level"), F.round("gradient", 6).alias("gradient"))


@query(with_views("profiles", f", n AS (SELECT profile_id, values, 0.5e0 + profile_id % 20 AS z0, 30.25e0 + profile_id % 20 AS z1 FROM profiles), k AS (SELECT profile_id, values, z0, z1, unnest(list_sort(list_concat([z0, z1], list_transform(list_filter(range(0, len(values)), lambda i: i > z0 AND i < z1), lambda i: CAST(i AS DOUBLE))))) AS z FROM n), v AS (SELECT profile_id, z0, z1, z, {lerp_sql('z')} AS h FROM k), t AS (SELECT *, (z - lag(z) OVER w) * (h + lag(h) OVER w) / 2 AS part FROM v WINDOW w AS (PARTITION BY profile_id ORDER BY z)) SELECT profile_id, round(sum(part) / any_value(z1 - z0), 6) AS mean FROM t GROUP BY profile_id").replace(") ,", "),", 1))
def z_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.col("profile_id") % 20
    return profiles(spark, sf_dir).select("profile_id", F.round(vertical.z_average(F.col("values"), 0.5 + shift, 30.25 + shift), 6).alias("mean"))


@query(with_views("profiles", ", e AS (SELECT profile_id, unnest(range(0, len(values))) AS level, unnest(values) AS v FROM profiles) SELECT profile_id, level, round(last_value(CASE WHEN (profile_id + level) % 3 = 0 THEN NULL ELSE v END IGNORE NULLS) OVER (PARTITION BY profile_id ORDER BY level), 6) AS value FROM e").replace(") ,", "),", 1))
def fill_to_seafloor(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = F.transform("values", lambda v, i: F.when((F.col("profile_id") + i) % 3 != 0, v))
    p = profiles(spark, sf_dir).select("profile_id", F.posexplode(vertical.fill_down(holes)).alias("level", "value"))
    return p.select("profile_id", F.col("level").cast("bigint").alias("level"), F.round("value", 6).alias("value"))


STR = "((1 - 0.4e0) * sinh(6 * s) / sinh(6e0) + 0.4e0 * (tanh(6 * (s + 0.5e0)) / tanh(3e0) - 1) / 2)"


@query(with_views("bathymetry", f", l AS (SELECT *, unnest(range(0, 10)) AS k FROM bathymetry), s AS (SELECT *, -1 + (k + 0.5e0) / 10 AS s FROM l) SELECT ix, iy, k, round(5 * (s - {STR}) + {STR} * depth, 6) AS z1, round(depth * (5 * s + depth * {STR}) / (5 + depth), 6) AS z2 FROM s").replace(") ,", "),", 1))
def s_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bathymetry(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    s = -1 + (F.col("k") + 0.5) / 10
    c = vertical.stretch(s, 6.0, 0.4)
    h = F.col("depth")
    return b.select("ix", "iy", "k", F.round(vertical.s_depth(h, s, c, 5.0), 6).alias("z1"), F.round(vertical.s_depth(h, s, c, 5.0, 2), 6).alias("z2"))


@query(with_views("track", "SELECT traj_id, step, CAST(step - lag(step) OVER (PARTITION BY traj_id ORDER BY step) AS BIGINT) AS gap FROM track QUALIFY gap > 24"))
def missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("step") - F.lag("step").over(Window.partitionBy("traj_id").orderBy("step"))
    return track(spark, sf_dir).select("traj_id", "step", gap.alias("gap")).filter("gap > 24")
