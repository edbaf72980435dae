"""Queries that write files and read them back, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.functions import geo
from plume.jobs.fields import CELLS, GRID
from plume.jobs.grids import MESH, lattice
from plume.jobs.tracks import joined
from plume.operators import grid as g
from plume.sources import stores
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


def day() -> F.Column:
    return F.floor(F.col("step") / 24)


@query(with_views("particles", f"SELECT CAST(floor(step / 24e0) AS BIGINT) AS day, step, ix, iy, CAST(count(*) FILTER (status = 0 AND z >= -1) AS BIGINT) AS surface, CAST(count(*) FILTER (status = 0 AND z < -1) AS BIGINT) AS submerged, CAST(count(*) FILTER (status = 1) AS BIGINT) AS stranded FROM (SELECT *, {CELLS} FROM particles) WHERE step >= 240 GROUP BY step, ix, iy"))
def density_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface, submerged and stranded counts by step and cell, as Parquet by day; read from the tenth day on."""
    path = stores.written(g.layered_density(particles(spark, sf_dir), GRID).withColumn("day", day()), "density", ("day",))
    return spark.read.parquet(path).filter("day >= 10").select(F.col("day").cast("bigint").alias("day"), "step", "ix", "iy", "surface", "submerged", "stranded")


K0 = "(2 * sqrt(n) / (1 + n))"
UTM = """, k AS (SELECT event_id, step, status, z, weight, radians(lat) AS phi, radians(lon - 15) AS lam, (1 / 298.257223563e0) / (2 - 1 / 298.257223563e0) AS n FROM particles),
t AS (SELECT *, sinh(atanh(sin(phi)) - """ + K0 + " * atanh(" + K0 + """ * sin(phi))) AS t FROM k), e AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 0.9996e0 * 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r FROM t),
utm AS (SELECT *, 500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x, r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y FROM e)"""


@query(joined("particles", UTM + " SELECT CAST(floor(x / 20000) AS BIGINT) AS px, CAST(floor(y / 20000) AS BIGINT) AS py, CAST(count(*) FILTER (z >= -1) AS BIGINT) AS surface, CAST(count(*) FILTER (z < -1) AS BIGINT) AS submerged, round(sum(weight), 4) AS mass FROM utm WHERE status = 0 GROUP BY 1, 2"))
def density_projected_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mass on a projected grid of 20 km, by bands of northing."""
    east, north = geo.utm_forward(F.col("lon"), F.col("lat"))
    p = particles(spark, sf_dir).filter("status = 0").withColumns({"px": F.floor(east / 20000), "py": F.floor(north / 20000)})
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cells = p.groupBy("px", "py").agg(count(F.col("z") >= -1).alias("surface"), count(F.col("z") < -1).alias("submerged"), F.round(F.sum("weight"), 4).alias("mass"))
    path = stores.written(cells.withColumn("band", F.floor(F.col("py") / 5)), "projected", ("band",))
    return spark.read.parquet(path).drop("band")


LAYER = "CAST(CASE WHEN -z <= 10 THEN 0 WHEN -z <= 50 THEN 1 WHEN -z <= 100 THEN 2 ELSE 3 END AS INT)"
BLOCKS = f"b AS (SELECT specie, CAST(floor(step / 48e0) AS BIGINT) AS block, {LAYER} AS layer, ix, iy, sum(weight) / 48 AS mass, count(*) AS n FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean mass and number of particles by species, block of 48 steps, depth layer and cell."""
    depth = -F.col("z")
    layer = F.when(depth <= 10, 0).when(depth <= 50, 1).when(depth <= 100, 2).otherwise(3)
    p = GRID.cells(particles(spark, sf_dir)).withColumns({"block": F.floor(F.col("step") / 48), "layer": layer})
    return p.groupBy("specie", "block", "layer", "ix", "iy").agg((F.sum("weight") / 48).alias("mass"), F.count("*").alias("n"))


@query(joined("particles bathymetry", f", {BLOCKS} SELECT specie, block, layer, b.ix, b.iy, round(CASE WHEN depth > [0, 10, 50, 100][layer + 1] THEN mass / {GRID.volume}e0 * 1e9 END, 4) AS nano FROM b LEFT JOIN bathymetry d ON d.ix = b.ix AND d.iy = b.iy WHERE specie = 2"))
def chemical_density_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration by species, block, layer and cell, null where the layer is below the sea floor; one species is read."""
    b, top = blocks(spark, sf_dir), F.element_at(F.array(*[F.lit(x) for x in (0, 10, 50, 100)]), F.col("layer") + 1)
    b = b.join(bathymetry(spark, sf_dir), ["ix", "iy"], "left")
    b = b.select("specie", "block", "layer", "ix", "iy", F.round(F.when(F.col("depth") > top, F.col("mass") / GRID.volume * 1e9), 4).alias("nano"))
    path = stores.written(b, "chemical", ("specie",))
    return spark.read.parquet(path).filter("specie = 2")


@query(with_views("particles", f", {BLOCKS} SELECT block, specie, layer, ix, iy, round(n * 1e6 / 48 / {GRID.volume}e0, 12) AS activity FROM b WHERE block BETWEEN 3 AND 7").replace(") ,", "),", 1))
def activity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity (1e6 Bq an element) per volume by block; five blocks are read."""
    b = blocks(spark, sf_dir).select("block", "specie", "layer", "ix", "iy", F.round(F.col("n") * 1e6 / 48 / GRID.volume, 12).alias("activity"))
    path = stores.written(b, "activity", ("block",))
    return spark.read.parquet(path).filter("block between 3 and 7").withColumn("block", F.col("block").cast("bigint"))


@query(with_views("track", "SELECT traj_id, step, round(lon, 6) AS lon, round(lat, 6) AS lat, status FROM track WHERE step BETWEEN 100 AND 299 AND traj_id % 3 = 1"))
def history_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output appended in two parts, by day, then imported with a slice of times and of elements.

    The slice of times prunes folders, the other and the columns are pushed
    into the scan.
    """
    t = track(spark, sf_dir).select("traj_id", "step", "lon", "lat", "status", day().alias("day"))
    path = stores.written(t.filter("step < 200"), "history", ("day",))
    stores.written(t.filter("step >= 200"), "history", ("day",), path)
    part = spark.read.parquet(path).filter("day between 4 and 12 and step between 100 and 299 and traj_id % 3 = 1")
    return part.select("traj_id", "step", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "status")


@query(with_views("track", "SELECT step, traj_id, lon, lat, status FROM track"))
def ragged_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one row per step and arrays of its particles, read as one row per particle."""
    t = track(spark, sf_dir)
    row = F.sort_array(F.collect_list(F.struct("traj_id", "lon", "lat", "status")))
    ragged = t.groupBy("step").agg(row.alias("r")).select("step", *[F.col("r")[c].alias(c) for c in ("traj_id", "lon", "lat", "status")])
    path = stores.written(ragged, "ragged")
    return stores.long_form(spark.read.parquet(path), ["traj_id", "lon", "lat", "status"])


@query(with_views("track", "SELECT step, printf('%d\t%.3f\t%.3f\t%d\t%d', traj_id, lon, lat, CASE WHEN status = 0 THEN 11 ELSE 41 END, (step - min(step) OVER (PARTITION BY traj_id)) * 60) AS line FROM track"))
def drift_text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of number, position, state and age in minutes, by step and in order of number."""
    age = (F.col("step") - F.min("step").over(Window.partitionBy("traj_id"))) * 60
    t = track(spark, sf_dir).withColumn("age", age)
    line = F.format_string("%d\t%.3f\t%.3f\t%d\t%d", F.col("traj_id"), F.col("lon"), F.col("lat"), F.when(F.col("status") == 0, 11).otherwise(41), F.col("age"))
    path = stores.text_lines(t, line, "drift", ("step",), ("traj_id",))
    return spark.read.text(path).select(F.col("step").cast("bigint").alias("step"), F.col("value").alias("line"))


@query(joined("bathymetry", MESH + " SELECT cell, round(n.x, 6) AS x, round(n.y, 6) AS y, round(n.value, 6) AS depth FROM cells JOIN nodes n ON n.node = cells.a"))
def mesh_text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh written as text and read again: each cell with its first node."""
    path = stores.new_path(spark, "mesh")
    stores.mesh_lines(*lattice(spark, sf_dir)).write.text(path)
    nodes, cells = stores.read_mesh(spark, path)
    c = cells.select("cell", F.col("a").alias("node")).join(nodes, "node")
    return c.select("cell", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("value", 6).alias("depth"))


@query(joined("forcing bathymetry", ", n AS (SELECT iy * 50 + ix AS node, depth FROM bathymetry WHERE ix % 10 = 0) SELECT node, f.sec, round(x_wind * (1 + node % 7 / 100e0), 6) AS x_wind, round(y_wind * (1 + node % 7 / 100e0), 6) AS y_wind FROM forcing f, n WHERE f.sec < 86400 * 3"))
def forcing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind at mesh nodes by time, a table keyed by time and node, by day; three days are read.

    Every node has every time, which is what such a table is; the nodes are those of a coarse boundary.
    """
    nodes = bathymetry(spark, sf_dir).filter("ix % 10 = 0").select((F.col("iy") * 50 + F.col("ix")).alias("node"))
    at = forcing(spark, sf_dir).withColumn("day", F.floor(F.col("sec") / 86400))
    factor = 1 + F.col("node") % 7 / 100.0
    both = at.crossJoin(nodes).select("day", "node", "sec", F.round(F.col("x_wind") * factor, 6).alias("x_wind"), F.round(F.col("y_wind") * factor, 6).alias("y_wind"))
    return spark.read.parquet(stores.written(both, "forcing", ("day",))).filter("day < 3").select("node", "sec", "x_wind", "y_wind")


@query(with_views("profiles", "SELECT profile_id, level, round(value, 6) AS value FROM (SELECT profile_id, unnest(range(0, len(values))) AS level, unnest(values) AS value FROM profiles) WHERE level IN (0, 5, 20)"))
def layer_subset_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of all profiles, exported and read again."""
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("profile_id"), F.posexplode("embedding").alias("level", "value"))
    p = p.filter("level in (0, 5, 20)").select("profile_id", F.col("level").cast("bigint").alias("level"), F.round(F.col("value").cast("double"), 6).alias("value"))
    return spark.read.parquet(stores.written(p, "layers"))


@query(with_views("sites", "SELECT site_id, CAST(10 + site_id % 40 * 5 AS DOUBLE) AS depth, round(1 + site_id % 9 / 4e0, 4) AS flux, round(lon, 4) AS lon, round(lat, 4) AS lat FROM sites"))
def release_profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release profiles in tab-separated files of two clusters, read with a schema and put together."""
    s = sites(spark, sf_dir).select("site_id", (10 + F.col("site_id") % 40 * 5).cast("double").alias("depth"), (1 + F.col("site_id") % 9 / 4.0).alias("flux"), F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))
    schema, parts = "site_id bigint, depth double, flux double, lon double, lat double", []
    for part in (0, 1):
        path = stores.new_path(spark, "release")
        s.filter(F.col("site_id") % 2 == part).write.option("sep", "\t").option("header", True).csv(path)
        parts.append(spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path))
    return parts[0].unionByName(parts[1]).withColumn("flux", F.round("flux", 4))


@query("WITH f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), i AS (SELECT *, 'out_' || strftime(day, '%Y%m') AS file, row_number() OVER (PARTITION BY strftime(day, '%Y%m') ORDER BY day) - 1 AS index FROM f) SELECT event_id, file, index FROM events ASOF JOIN i ON CAST(ts AS DATE) - INTERVAL 10000 DAY >= day")
def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each time the file and the index in it of the last output before."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    month = F.date_format("d", "yyyyMM")
    i = days.withColumn("file", F.concat(F.lit("out_"), month)).withColumn("index", F.row_number().over(Window.partitionBy("file").orderBy("d")) - 1)
    i = i.select(F.datediff("d", F.lit("1990-01-01").cast("date")).alias("t"), "file", "index")
    from plume.operators import joins

    e = table(spark, sf_dir, "events").select("event_id", (F.datediff(F.col("ts").cast("date"), F.lit("1990-01-01").cast("date")) - 10000).alias("t"))
    out = joins.asof_bracket(e, i, "t", ["file", "index"], slots=30).filter("t_before is not null")
    return out.select("event_id", F.col("file_before").alias("file"), F.col("index_before").cast("bigint").alias("index"))


@query("SELECT date_trunc('month', l_shipdate)::DATE AS month, " + ", ".join(f"round(coalesce(sum(l_quantity) FILTER (l_suppkey = {k}), 0), 4) AS station_{k}" for k in range(1, 6)) + " FROM lineitem WHERE l_suppkey <= 5 GROUP BY 1")
def station_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of five stations in text files, put together, sorted and one column for each."""
    li = table(spark, sf_dir, "lineitem").filter("l_suppkey <= 5").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), "l_quantity")
    path = stores.new_path(spark, "stations")
    li.write.partitionBy("l_suppkey").option("header", True).csv(path)
    back = spark.read.schema("date date, l_quantity double, l_suppkey int").option("header", True).csv(path)
    months = back.groupBy(F.trunc("date", "month").alias("month")).pivot("l_suppkey", list(range(1, 6))).agg(F.sum("l_quantity"))
    return months.select("month", *[F.round(F.coalesce(F.col(str(k)), F.lit(0.0)), 4).alias(f"station_{k}") for k in range(1, 6)]).orderBy("month")


SQUARE = "concat('{\"type\":\"Feature\",\"properties\":{\"name\":\"site ', site_id, '\",\"number\":', 5 + site_id % 7, '},\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[[', lon, ',', lat, '],[', lon + 0.5, ',', lat, '],[', lon + 0.5, ',', lat + 0.25, '],[', lon, ',', lat + 0.25, '],[', lon, ',', lat, ']]]}}')"


@query(with_views("sites", "SELECT 'site ' || site_id AS name, 5 + site_id % 7 AS number, 5 AS points, round(lon + 0.2e0, 6) AS lon, round(lat + 0.1e0, 6) AS lat FROM sites").replace("5 + site_id % 7 AS number", "CAST(5 + site_id % 7 AS BIGINT) AS number").replace("5 AS points", "CAST(5 AS INT) AS points"))
def geojson_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as lines of GeoJSON and read as seeds: name, number and mean of the ring."""
    path = stores.new_path(spark, "seeds")
    sites(spark, sf_dir).selectExpr(f"{SQUARE} AS value").write.text(path)
    s = stores.rings_of_geojson(spark.read.text(path), "value")
    mean = lambda k: F.aggregate(F.transform("ring", lambda p: p[k]), F.lit(0.0), lambda a, x: a + x) / F.size("ring")
    return s.select("name", "number", F.size("ring").alias("points"), F.round(mean(0), 6).alias("lon"), F.round(mean(1), 6).alias("lat"))


@query(with_views("sites", ", p AS (SELECT site_id, unnest([0, 1, 2]) AS part FROM sites), a AS (SELECT site_id, part, (1 + part) * (1 + site_id % 3) * 1e0 AS area FROM p), n AS (SELECT *, CAST(floor(100 * area / sum(area) OVER (PARTITION BY site_id)) AS BIGINT) AS n FROM a) SELECT site_id, part, round(area, 6) AS area, CASE WHEN part = 2 THEN 100 - coalesce(sum(n) OVER (PARTITION BY site_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE n END AS number FROM n").replace(") ,", "),", 1).replace("CASE WHEN part = 2", "CAST(CASE WHEN part = 2").replace("ELSE n END AS number", "ELSE n END AS BIGINT) AS number"))
def wkt_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipolygons as text: 100 elements of each are shared by area, the last part takes the rest."""
    box = lambda k: f"'((', {k * 10}, ' 0,', {k * 10} + 1 + {k}, ' 0,', {k * 10} + 1 + {k}, ' ', 1 + site_id % 3, ',', {k * 10}, ' ', 1 + site_id % 3, ',', {k * 10}, ' 0))'"
    s = sites(spark, sf_dir).selectExpr("site_id", f"concat('MULTIPOLYGON (', {box(0)}, ', ', {box(1)}, ', ', {box(2)}, ')') AS wkt")
    p = stores.polygons_of_wkt(s, "wkt").withColumn("area", geo.shoelace(F.col("ring")))
    every, before = Window.partitionBy("site_id"), Window.partitionBy("site_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("n", F.floor(100 * F.col("area") / F.sum("area").over(every)))
    last = F.col("part") == F.max("part").over(every)
    number = F.when(last, 100 - F.coalesce(F.sum("n").over(before), F.lit(0))).otherwise(F.col("n"))
    return p.select("site_id", "part", F.round("area", 6).alias("area"), number.cast("bigint").alias("number"))
