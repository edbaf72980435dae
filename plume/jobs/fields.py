"""Queries on grids, budgets and sources, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.functions import physics
from plume.operators import grid as g
from plume.sources.fixtures import bathymetry, particles, table, track, with_views

GRID = g.GridSpec()
#: Steps of the averaging period.
STEPS = 719
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CELLS = "CAST(floor((lon - 12.5e0) / 0.5e0) AS BIGINT) AS ix, CAST(floor((lat - 68.5e0) / 0.25e0) AS BIGINT) AS iy, CAST(floor(-z / 25e0) AS BIGINT) AS kz"
VOLUME = "(800e0 * 800e0 * 25e0)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(with_views("particles", f"SELECT step, kz, ix, iy, round(sum(weight), 6) AS mass, count(*) AS n, round(sum(weight) / {VOLUME}, 12) AS conc FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL"))
def conc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.concentration(particles(spark, sf_dir), GRID)


@query(with_views("particles", f"SELECT kz, ix, iy, round(sum(weight) / {VOLUME} / 719, 14) AS mean_conc FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL"))
def layer_time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.layer_time_mean(particles(spark, sf_dir), GRID, STEPS)


@query(with_views("particles", f"SELECT coalesce(day, -1) AS day, coalesce(kz, -1) AS kz, mass, n FROM (SELECT day, kz, round(sum(weight), 4) AS mass, count(*) AS n FROM (SELECT *, CAST(floor(step / 24e0) AS BIGINT) AS day, {CELLS} FROM particles) GROUP BY ROLLUP (day, kz))"))
def rollup_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = GRID.cells(particles(spark, sf_dir)).withColumn("day", F.floor(F.col("step") / 24))
    sums = p.rollup("day", "kz").agg(F.round(F.sum("weight"), 4).alias("mass"), F.count("*").alias("n"))
    return sums.na.fill(-1, ["day", "kz"])  # -1: all


@query(with_views("particles", f"SELECT step, ix, iy, CAST(count(*) FILTER (status = 0 AND z >= -1) AS BIGINT) AS surface, CAST(count(*) FILTER (status = 0 AND z < -1) AS BIGINT) AS submerged, CAST(count(*) FILTER (status = 1) AS BIGINT) AS stranded FROM (SELECT *, {CELLS} FROM particles) GROUP BY step, ix, iy"))
def density_surface_submerged_stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.layered_density(particles(spark, sf_dir), GRID)


@query(with_views("particles", f"SELECT step, origin_marker, ix, iy, count(*) AS n, round(sum(weight), 6) AS mass FROM (SELECT *, {CELLS} FROM particles) GROUP BY step, origin_marker, ix, iy"))
def density_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = GRID.cells(particles(spark, sf_dir))
    return p.groupBy("step", "origin_marker", "ix", "iy").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("mass"))


@query(with_views("particles", f"SELECT ix, iy, count(*) AS visits, count(DISTINCT traj_id) AS trajectories FROM (SELECT *, {CELLS} FROM particles) GROUP BY ix, iy"))
def residence_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.cells(particles(spark, sf_dir)).groupBy("ix", "iy").agg(F.count("*").alias("visits"), F.countDistinct("traj_id").alias("trajectories"))


DEPTHS = (0.0, 10.0, 50.0, 100.0, 300.0)


@query(with_views("particles", f"SELECT CAST(floor(step / 24e0) AS BIGINT) AS day, specie, CAST(CASE WHEN -z <= 10 THEN 0 WHEN -z <= 50 THEN 1 WHEN -z <= 100 THEN 2 ELSE 3 END AS INT) AS layer, ix, iy, round(sum(weight), 6) AS mass FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL"))
def species_depth_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.lit(len(DEPTHS) - 2)
    for k in range(len(DEPTHS) - 3, -1, -1):
        layer = F.when(-F.col("z") <= DEPTHS[k + 1], k).otherwise(layer)
    p = GRID.cells(particles(spark, sf_dir)).withColumns({"day": F.floor(F.col("step") / 24), "layer": layer})
    return p.groupBy("day", "specie", "layer", "ix", "iy").agg(F.round(F.sum("weight"), 6).alias("mass"))


@query(with_views("particles", f"SELECT CAST(floor(step / 6e0) AS BIGINT) AS block, ix, iy, round(sum(weight) / 6, 6) AS mean_mass FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL"))
def block_time_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.block_average(particles(spark, sf_dir), GRID, 6)


@query(with_views("particles", f"SELECT CAST(floor(step / 24e0) AS BIGINT) AS day, kz, count(*) AS n FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL"))
def vertical_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.cells(particles(spark, sf_dir)).groupBy(F.floor(F.col("step") / 24).alias("day"), "kz").agg(F.count("*").alias("n"))


@query(with_views("particles", "SELECT step, round(avg(lon), 8) AS lon, round(avg(lat), 8) AS lat, round(var_pop(lon) * 1600 + var_pop(lat) * 12365.44e0, 3) AS spread FROM particles GROUP BY step"))
def center_of_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.round(F.var_pop("lon") * 1600 + F.var_pop("lat") * 12365.44, 3).alias("spread")  # km2 at 70 degrees north
    return particles(spark, sf_dir).groupBy("step").agg(F.round(F.avg("lon"), 8).alias("lon"), F.round(F.avg("lat"), 8).alias("lat"), spread)


@query(with_views("particles", "SELECT CAST(floor(step / 24e0) AS BIGINT) AS day, " + ", ".join(f"round(sum(weight) FILTER (specie = {k}), 4) AS specie_{k}" for k in range(5)) + " FROM particles GROUP BY 1"))
def species_mass_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = particles(spark, sf_dir).withColumn("day", F.floor(F.col("step") / 24)).groupBy("day").pivot("specie", list(range(5))).agg(F.round(F.sum("weight"), 4))
    return p.select("day", *[F.col(str(k)).alias(f"specie_{k}") for k in range(5)])


@query(with_views("track", "SELECT before AS specie_in, specie AS specie_out, count(*) AS n FROM (SELECT specie, lag(specie) OVER (PARTITION BY traj_id ORDER BY step) AS before FROM track) WHERE before IS NOT NULL GROUP BY ALL"))
def species_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("specie").over(Window.partitionBy("traj_id").orderBy("step"))
    t = track(spark, sf_dir).select(before.alias("specie_in"), F.col("specie").alias("specie_out")).filter("specie_in is not null")
    return t.groupBy("specie_in", "specie_out").agg(F.count("*").alias("n"))


@query(with_views("particles", "SELECT step, round(coalesce(sum(weight) FILTER (status = 0 AND z >= -1), 0), 4) AS surface, round(coalesce(sum(weight) FILTER (status = 0 AND z < -1), 0), 4) AS submerged, round(coalesce(sum(weight) FILTER (status = 1), 0), 4) AS stranded, round(sum(weight), 4) AS total FROM particles GROUP BY step"))
def oil_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, n: F.round(F.sum(F.when(c, F.col("weight")).otherwise(0.0)), 4).alias(n)
    at_surface, afloat = F.col("z") >= -1, F.col("status") == 0
    return particles(spark, sf_dir).groupBy("step").agg(part(afloat & at_surface, "surface"), part(afloat & ~at_surface, "submerged"), part(~afloat, "stranded"), F.round(F.sum("weight"), 4).alias("total"))


@query(with_views("particles", """, e AS (SELECT step, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 FROM particles GROUP BY step),
b AS (SELECT p.*, x0, x1, y0, y1, coalesce(least(CAST(floor((lon - x0) / nullif(x1 - x0, 0) * 100) AS BIGINT), 99), 0) AS bx, coalesce(least(CAST(floor((lat - y0) / nullif(y1 - y0, 0) * 100) AS BIGINT), 99), 0) AS by_ FROM particles p JOIN e USING (step))
SELECT event_id, round(least(greatest(sum(weight) OVER (PARTITION BY step, bx, by_) / 900e0 / (greatest((x1 - x0) * 40000e0 / 100, 1e0) * greatest((y1 - y0) * 111000e0 / 100, 1e0)), 1e-9), 1e-2), 9) AS thickness FROM b""").replace(") ,", "),", 1))
def film_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.film_thickness(particles(spark, sf_dir), 100, 900.0)


AGED = """, first_step AS (SELECT traj_id, min(step) AS s0 FROM track GROUP BY traj_id), aged AS (SELECT t.*, t.step - s0 AS age FROM track t JOIN first_step USING (traj_id))"""


@query(with_views("track", AGED + " SELECT age, CAST(floor(-z / 50e0) AS BIGINT) AS depth, count(*) AS n, round(sum(weight), 4) AS mass, round(sum(weight * 0.18e-6 * 3600), 8) AS oxidised FROM aged GROUP BY ALL"))
def lifespan_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Window.partitionBy("traj_id")
    t = track(spark, sf_dir).withColumn("age", F.col("step") - F.min("step").over(first)).withColumn("depth", F.floor(-F.col("z") / 50))
    return t.groupBy("age", "depth").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("mass"), F.round(F.sum(F.col("weight") * 0.18e-6 * 3600), 8).alias("oxidised"))


@query(with_views("track", AGED + ", m AS (SELECT CAST(floor(age / 24e0) AS BIGINT) AS age_day, sum(weight) AS mass, coalesce(sum(weight) FILTER (z >= -25), 0) AS up FROM aged GROUP BY 1) SELECT age_day, round(sum(mass) OVER (ORDER BY age_day) / (SELECT sum(mass) FROM m), 8) AS share, round(sum(up) OVER (ORDER BY age_day) / (SELECT sum(mass) FROM m), 8) AS surface_share FROM m"))
def fate_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir).withColumn("age", F.col("step") - F.min("step").over(Window.partitionBy("traj_id")))
    m = t.groupBy(F.floor(F.col("age") / 24).alias("age_day")).agg(F.sum("weight").alias("mass"), F.sum(F.when(F.col("z") >= -25, F.col("weight")).otherwise(0.0)).alias("up"))
    so_far, every = Window.orderBy("age_day"), Window.orderBy("age_day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("mass").over(every)  # one row per day of age
    return m.select("age_day", F.round(F.sum("mass").over(so_far) / total, 8).alias("share"), F.round(F.sum("up").over(so_far) / total, 8).alias("surface_share"))


@query(with_views("track", ", p AS (SELECT *, lag(step) OVER w IS NULL AS born, lead(step) OVER w IS NULL AS died FROM track WINDOW w AS (PARTITION BY traj_id ORDER BY step)) SELECT step, round(sum(weight * 0.18e-6 * 3600), 8) AS oxidised, round(coalesce(sum(weight) FILTER (NOT (lon BETWEEN 13 AND 20 AND lat BETWEEN 69 AND 71.5)), 0), 4) AS outside, round(coalesce(sum(weight) FILTER (died), 0), 4) AS died, round(coalesce(sum(weight) FILTER (born), 0), 4) AS born, count(*) AS n FROM p GROUP BY step"))
def budget_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("traj_id").orderBy("step")
    t = track(spark, sf_dir).withColumns({"first": F.lag("step").over(w).isNull(), "last": F.lead("step").over(w).isNull()})
    outside = ~(F.col("lon").between(13, 20) & F.col("lat").between(69, 71.5))
    part = lambda c, n: F.round(F.sum(F.when(c, F.col("weight")).otherwise(0.0)), 4).alias(n)
    lost = F.round(F.sum(F.col("weight") - physics.decay(F.col("weight"), 0.18e-6)), 8).alias("oxidised")
    return t.groupBy("step").agg(lost, part(outside, "outside"), part(F.col("last"), "died"), part(F.col("first"), "born"), F.count("*").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(floor(value * 100), 0.5) / 100 AS median, round(stddev_samp(value), 6) AS std, round(-ln(0.5e0) / (avg(value) * 1e-6) / 86400, 4) AS half_days FROM events GROUP BY event_type")
def rate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median (to hundredths), deviation and turnover time by category.

    The median is found by counting: rates are counted by hundredths first,
    so that no group's values are gathered.
    """
    e = table(spark, sf_dir, "events").select("event_type", "value")
    stats = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.round(F.stddev_samp("value"), 6).alias("std"))
    counted = e.groupBy("event_type", F.floor(F.col("value") * 100).alias("cents")).agg(F.count("*").alias("n"))
    by_value = Window.partitionBy("event_type").orderBy("cents")
    every = Window.partitionBy("event_type")
    counted = counted.withColumns({"upto": F.sum("n").over(by_value), "all": F.sum("n").over(every)})
    median = counted.filter(F.col("upto") * 2 >= F.col("all")).groupBy("event_type").agg((F.min("cents") / 100).alias("median"))
    out = stats.join(median, "event_type")
    return out.select("event_type", F.round("m", 6).alias("mean"), "median", "std", F.round(physics.turnover_days(F.col("m") * 1e-6, 0.5), 4).alias("half_days"))


@query("WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT coalesce(origin, -1) AS origin, coalesce(event_type, 'all') AS event_type, n FROM (SELECT CAST(user_id % 4 AS INT) AS origin, event_type, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY CUBE (1, 2))")
def cube_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("origin", (F.col("user_id") % 4).cast("int"))
    return e.cube("origin", "event_type").agg(F.count("*").alias("n")).na.fill({"origin": -1, "event_type": "all"})


LAYERS = ", layers AS (SELECT unnest(range(1, 7)) AS k)"


@query(with_views("bathymetry", LAYERS + " SELECT ix, iy, k AS layer FROM bathymetry, layers WHERE greatest(k * 25e0, 1e0) > depth"))
def impermissible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bathymetry(spark, sf_dir)
    layers = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(6).cast("bigint")))
    return b.withColumn("layer", layers).filter(F.greatest(F.col("layer") * 25.0, F.lit(1.0)) > F.col("depth")).select("ix", "iy", "layer")


@query("SELECT CAST(p_size AS BIGINT) AS size, p_brand AS brand, CAST(sum(floor(p_retailprice / 100)) AS BIGINT) AS elements, round(sum(p_retailprice - 100 * floor(p_retailprice / 100)), 4) AS residual FROM part GROUP BY ALL")
def emission_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    whole = F.floor(F.col("p_retailprice") / 100)
    return p.groupBy(F.col("p_size").cast("bigint").alias("size"), F.col("p_brand").alias("brand")).agg(F.sum(whole).alias("elements"), F.round(F.sum(F.col("p_retailprice") - 100 * whole), 4).alias("residual"))


@query("WITH s AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey AS station, CAST(m AS DATE) AS month, round(q, 4) AS production, round(q / sum(q) OVER (PARTITION BY m), 8) AS share FROM s")
def station_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.sum("l_quantity").alias("q"))
    total = s.groupBy("month").agg(F.sum("q").alias("all"))
    return s.join(total, "month").select(F.col("l_suppkey").alias("station"), "month", F.round("q", 4).alias("production"), F.round(F.col("q") / F.col("all"), 8).alias("share"))


@query("WITH o AS (SELECT o_orderkey, dayofyear(o_orderdate) AS doy, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS value FROM orders), d AS (SELECT doy, avg(value) AS clim FROM o GROUP BY 1) SELECT o_orderkey, round(coalesce(value, clim), 7) AS filled FROM o JOIN d USING (doy)")
def climatology_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values filled with the mean of the known ones of the same day of the year."""
    value = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("doy"), value.alias("value"))
    clim = o.groupBy("doy").agg(F.avg("value").alias("clim"))
    return o.join(F.broadcast(clim), "doy").select("o_orderkey", F.round(F.coalesce("value", "clim"), 7).alias("filled"))  # 366 rows at most
