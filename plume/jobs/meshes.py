"""Queries on meshes, columns of water and grids of weights, each with the same result in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.jobs.grids import CELL, HOLES, MESH, holed, lattice
from plume.jobs.tracks import METRES, joined
from plume.operators import joins, mesh, stencil, vertical
from plume.sources.fixtures import bathymetry, particles, profiles, sites, table, with_views

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


CENTRE = CELL + ", m AS (SELECT cell, (x0 + x1 + x2) / 3 AS cx, (y0 + y1 + y2) / 3 AS cy, (v0 + v1 + v2) / 3 AS mean, ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS area FROM t)"
BESIDE = ", nb AS (SELECT s.cell, q.cell AS other FROM sides s JOIN sides q USING (u, v) WHERE s.cell <> q.cell)"


@query(joined("bathymetry", MESH + CENTRE + BESIDE + ", s AS (SELECT nb.cell, sum(pow(o.cx - c.cx, 2)) xx, sum((o.cx - c.cx) * (o.cy - c.cy)) xy, sum(pow(o.cy - c.cy, 2)) yy, sum((o.cx - c.cx) * (o.mean - c.mean)) xv, sum((o.cy - c.cy) * (o.mean - c.mean)) yv FROM nb JOIN m c ON c.cell = nb.cell JOIN m o ON o.cell = nb.other GROUP BY nb.cell) SELECT cell, round((yy * xv - xy * yv) / CASE WHEN abs(xx * yy - xy * xy) > 1e-9 THEN xx * yy - xy * xy END, 5) AS gx, round((xx * yv - xy * xv) / CASE WHEN abs(xx * yy - xy * xy) > 1e-9 THEN xx * yy - xy * xy END, 5) AS gy FROM s"))
def cell_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cells = lattice(spark, sf_dir)
    return mesh.cell_gradient(cells, nodes).select("cell", r("gx", 5, "gx"), r("gy", 5, "gy"))


FLOW = ", f AS (SELECT cell, sin(cx * 0.3e0) * mean / 100 AS u, cos(cy * 0.2e0) * mean / 100 AS v FROM m)"
WALLS = FLOW + """, w AS (SELECT a AS p, b AS q, u * (cx - (x0 + x1) / 2) + v * (cy - (y0 + y1) / 2) AS c, area / 3 AS ar FROM t JOIN m USING (cell) JOIN f USING (cell) JOIN cells USING (cell) UNION ALL SELECT b, c, u * (cx - (x1 + x2) / 2) + v * (cy - (y1 + y2) / 2), area / 3 FROM t JOIN m USING (cell) JOIN f USING (cell) JOIN cells USING (cell)
UNION ALL SELECT c, a, u * (cx - (x2 + x0) / 2) + v * (cy - (y2 + y0) / 2), area / 3 FROM t JOIN m USING (cell) JOIN f USING (cell) JOIN cells USING (cell)), nc AS (SELECT p AS node, c, ar FROM w UNION ALL SELECT q, -c, 0 FROM w),
bn AS (SELECT DISTINCT unnest([u, v]) AS node FROM edges WHERE cells = 1), inn AS (SELECT node, sum(c) / sum(ar) AS z FROM nc WHERE node NOT IN (SELECT node FROM bn) GROUP BY node),
b1 AS (SELECT bn.node, avg(z) AS z FROM bn JOIN links l ON l.node = bn.node JOIN inn ON inn.node = l.other GROUP BY bn.node), k AS (SELECT * FROM inn UNION ALL SELECT * FROM b1),
b2 AS (SELECT bn.node, avg(z) AS z FROM bn JOIN links l ON l.node = bn.node JOIN k ON k.node = l.other WHERE bn.node NOT IN (SELECT node FROM b1) GROUP BY bn.node)"""


@query(joined("bathymetry", MESH + CENTRE + WALLS + " SELECT node, round(z, 5) AS vorticity FROM k UNION ALL SELECT node, round(z, 5) FROM b2"))
def edge_vorticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cells = lattice(spark, sf_dir)
    flow = mesh.centres(cells, nodes).select("cell", (F.sin(F.col("cx") * 0.3) * F.col("mean") / 100).alias("u"), (F.cos(F.col("cy") * 0.2) * F.col("mean") / 100).alias("v"))
    return mesh.vorticity(cells, nodes, flow).select("node", r("vorticity", 5, "vorticity"))


@query(joined("bathymetry", MESH + " SELECT node, count(*) AS open FROM (SELECT unnest([u, v]) AS node FROM edges WHERE cells = 1) GROUP BY node"))
def coast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boundary_nodes(lattice(spark, sf_dir)[1])


POINT = ", p AS (SELECT event_id, (event_id * 37 % 4800) / 100e0 + 0.0031e0 AS px, (event_id * 53 % 3700) / 100e0 + 0.0017e0 AS py FROM events)"
HIT = ", h AS (SELECT p.*, t.cell, v0, v1, v2, ((x1 - px) * (y2 - py) - (x2 - px) * (y1 - py)) / (2 * area) AS w0, ((x2 - px) * (y0 - py) - (x0 - px) * (y2 - py)) / (2 * area) AS w1, ((x0 - px) * (y1 - py) - (x1 - px) * (y0 - py)) / (2 * area) AS w2 FROM p JOIN t ON px BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND py BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2) JOIN m ON m.cell = t.cell)"


@query(joined("bathymetry", MESH + CENTRE + POINT + HIT + " SELECT event_id, cell, round(w0 * v0 + w1 * v1 + w2 * v2, 6) AS depth FROM h WHERE least(w0, w1, w2) >= -1e-12"))
def element_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle that holds each particle, and the depth there."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 4800 / 100.0 + 0.0031).alias("px"), (F.col("event_id") * 53 % 3700 / 100.0 + 0.0017).alias("py"))
    nodes, cells = lattice(spark, sf_dir)
    return mesh.containing_cell(e, cells, nodes, "event_id").select("event_id", "cell", r(mesh.interpolated(), 6, "depth"))


SECTION = ", p AS (SELECT site_id, k, 0.0031e0 + site_id % 20 + k * 0.613e0 AS px, 0.0017e0 + site_id % 15 + k * 0.427e0 AS py FROM sites, (SELECT unnest(range(0, 30)) AS k))"


@query(joined("bathymetry sites", MESH + CENTRE + SECTION + HIT + " SELECT site_id, k, round(k * sqrt(0.613e0 * 0.613e0 + 0.427e0 * 0.427e0), 6) AS along, round(w0 * v0 + w1 * v1 + w2 * v2, 6) AS depth FROM h WHERE least(w0, w1, w2) >= -1e-12"))
def mesh_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths at thirty even places along a section from each site."""
    s = sites(spark, sf_dir).select("site_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))).alias("k"))
    s = s.withColumns({"px": 0.0031 + F.col("site_id") % 20 + F.col("k") * 0.613, "py": 0.0017 + F.col("site_id") % 15 + F.col("k") * 0.427})
    nodes, cells = lattice(spark, sf_dir)
    out = mesh.containing_cell(s, cells, nodes, "site_id")
    return out.select("site_id", "k", r(F.col("k") * math.hypot(0.613, 0.427), 6, "along"), r(mesh.interpolated(), 6, "depth"))


def angle_sql(i: int, j: int, k: int) -> str:
    u, v = (f"(x{j} - x{i})", f"(y{j} - y{i})"), (f"(x{k} - x{i})", f"(y{k} - y{i})")
    return f"degrees(acos(least(greatest(({u[0]} * {v[0]} + {u[1]} * {v[1]}) / (sqrt({u[0]} * {u[0]} + {u[1]} * {u[1]}) * sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]})), -1), 1)))"


SHAKEN = ", nodes AS (SELECT node, x + sin(node * 1.7e0) * 0.3e0 AS x, y + cos(node * 2.3e0) * 0.3e0 AS y, value FROM flat)"
LOOSE = MESH.replace(", nodes AS (", ", flat AS (", 1).replace("FROM bathymetry),", "FROM bathymetry)" + SHAKEN + ",", 1)


@query(joined("bathymetry", LOOSE + CENTRE + f", q AS (SELECT cell, area, {angle_sql(0, 1, 2)} AS a, {angle_sql(1, 2, 0)} AS b, {angle_sql(2, 0, 1)} AS c FROM t JOIN m USING (cell)) SELECT cell, round(least(a, b, c), 5) AS least, round(greatest(a, b, c), 5) AS most, area > 0 AS turns_left FROM q WHERE least(a, b, c) < 20 OR greatest(a, b, c) > 120 OR area <= 0"))
def poor_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of a shaken mesh with too small or large angles or the wrong turn."""
    nodes, cells = lattice(spark, sf_dir)
    nodes = nodes.withColumns({"x": F.col("x") + F.sin(F.col("node") * 1.7) * 0.3, "y": F.col("y") + F.cos(F.col("node") * 2.3) * 0.3})
    c = mesh.triangle_area(mesh.corners(cells, nodes))
    a = mesh.angles()
    c = c.withColumns({"least": F.least(*a), "most": F.greatest(*a)}).filter("least < 20 or most > 120 or area <= 0")
    return c.select("cell", r("least", 5, "least"), r("most", 5, "most"), (F.col("area") > 0).alias("turns_left"))


@query(joined("bathymetry", MESH + CENTRE + ", a AS (SELECT sum(area) AS total, sum(area * mean) / sum(area) AS avg_, count(*) AS n FROM m) SELECT round(any_value(avg_), 6) AS mean, round(sqrt(any_value(n) * sum(area / total * pow(mean - avg_, 2)) / (any_value(n) - 1)), 6) AS std FROM m, a"))
def weighted_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and standard deviation of cell values, weighted by area."""
    nodes, cells = lattice(spark, sf_dir)
    c = mesh.centres(cells, nodes).agg(F.sum("area").alias("w"), F.sum(F.col("area") * F.col("mean")).alias("wx"), F.sum(F.col("area") * F.col("mean") * F.col("mean")).alias("wxx"), F.count("*").alias("n"))
    mean = F.col("wx") / F.col("w")
    return c.select(r(mean, 6, "mean"), r(F.sqrt(F.col("n") * (F.col("wxx") / F.col("w") - mean * mean) / (F.col("n") - 1)), 6, "std"))


@query(joined("bathymetry", ", z AS (SELECT ix, iy, CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y FROM bathymetry), o AS (SELECT * FROM z WHERE iy = 1 OR ix = 0), d AS (SELECT z.ix, z.iy, min(sqrt(pow(z.x - o.x, 2) + pow(z.y - o.y, 2))) AS d FROM z, o GROUP BY ALL) SELECT ix, iy, round(1e5 * CASE WHEN d = 0 THEN 1 ELSE 2.5e-4 + (2.5e-5 - 2.5e-4) * d / 5 END, 6) AS weight FROM d WHERE d <= 5"))
def nest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that fall linearly within five units of the open boundary, 1 on it (in units of 1e-5)."""
    z = bathymetry(spark, sf_dir).select("ix", "iy", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    o = z.filter("iy = 1 or ix = 0").select(F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = mesh.plane_radius_join(z, o, 5.0).groupBy("ix", "iy").agg(F.min("distance").alias("d"))
    return d.select("ix", "iy", r(1e5 * F.when(F.col("d") == 0, 1.0).otherwise(2.5e-4 + (2.5e-5 - 2.5e-4) * F.col("d") / 5), 6, "weight"))


CAGE = ", c AS (SELECT site_id, site_id * 7 % 4800 / 100e0 AS x, site_id * 13 % 3700 / 100e0 AS y, 10 + site_id % 9 AS flux FROM sites), z AS (SELECT iy * 50 + ix AS node, ix, iy, depth FROM bathymetry), j AS (SELECT site_id, node, depth, flux, count(*) OVER (PARTITION BY site_id) AS n FROM c JOIN z ON sqrt(pow(x - ix, 2) + pow(y - iy, 2)) <= 1.5e0)"


@query(joined("bathymetry sites", CAGE + " SELECT node, CAST(least(floor(5 / depth * 10), 9) AS BIGINT) AS level, round(sum(flux / n::DOUBLE / 5), 6) AS flux FROM j GROUP BY 1, 2"))
def cage_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cages release, shared among the nodes within reach and five layers, by node and the level of 5 m depth."""
    k = F.col("site_id")
    c = sites(spark, sf_dir).select("site_id", (k * 7 % 4800 / 100.0).alias("x"), (k * 13 % 3700 / 100.0).alias("y"), (10 + k % 9).alias("flux"))
    z = bathymetry(spark, sf_dir).select((F.col("iy") * 50 + F.col("ix")).alias("node"), F.col("ix").cast("double").alias("x2"), F.col("iy").cast("double").alias("y2"), "depth")
    j = mesh.plane_radius_join(c, z, 1.5).withColumn("n", F.count("*").over(Window.partitionBy("site_id")))
    level = F.least(F.floor(5 / F.col("depth") * 10), F.lit(9)).cast("bigint")
    return j.groupBy("node", level.alias("level")).agg(r(F.sum(F.col("flux") / F.col("n") / 5), 6, "flux"))


@query(joined("bathymetry sites", ", a AS (SELECT ix * 1e0 AS x, iy * 1e0 AS y, depth FROM bathymetry WHERE ix % 3 = 0), b AS (SELECT site_id * 7 % 4800 / 100e0 AS x, site_id * 13 % 3700 / 100e0 AS y, 50e0 + site_id AS depth FROM sites) SELECT round(x, 6) AS x, round(y, 6) AS y, round(depth, 6) AS depth, 'grid' AS source FROM a UNION ALL SELECT round(x, 6), round(y, 6), round(depth, 6), 'survey' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.7e0)"))
def merged_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of a grid, and of a survey where the grid has none within reach."""
    a = bathymetry(spark, sf_dir).filter("ix % 3 = 0").select(F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "depth")
    k = F.col("site_id")
    b = sites(spark, sf_dir).select("site_id", (k * 7 % 4800 / 100.0).alias("x"), (k * 13 % 3700 / 100.0).alias("y"), (50.0 + k).alias("depth"))
    near = mesh.plane_radius_join(b, a.select(F.col("x").alias("x2"), F.col("y").alias("y2")), 0.7).select("site_id")
    out = a.withColumn("source", F.lit("grid")).unionByName(b.join(near, "site_id", "left_anti").drop("site_id").withColumn("source", F.lit("survey")))
    return out.select(r("x", 6, "x"), r("y", 6, "y"), r("depth", 6, "depth"), "source")


GRID_PLACES = HOLES + ", w AS (SELECT ix, iy, 12 + ix * 0.02e0 AS lon, 68 + iy * 0.01e0 AS lat, depth, iy * 50 + ix AS node FROM h), n AS (SELECT l.ix, l.iy, o.depth, row_number() OVER (PARTITION BY l.ix, l.iy ORDER BY " + METRES.format(a="l", b="o") + ", o.node) AS rn FROM w l, w o WHERE l.depth IS NULL AND o.depth IS NOT NULL)"


@query(joined("bathymetry", GRID_PLACES + " SELECT ix, iy, round(depth, 6) AS depth FROM h WHERE depth IS NOT NULL UNION ALL SELECT ix, iy, round(depth, 6) FROM n WHERE rn = 1"))
def nearest_sea_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of a field filled with the nearest value there is."""
    w = holed(spark, sf_dir).select("ix", "iy", (12 + F.col("ix") * 0.02).alias("lon"), (68 + F.col("iy") * 0.01).alias("lat"), "depth", (F.col("iy") * 50 + F.col("ix")).alias("node"))
    known = w.filter("depth is not null")
    got = joins.nearest(w.filter("depth is null").select("ix", "iy", "lon", "lat", F.col("node").alias("hole")), known.select("node", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "depth"), "hole", "node", 1500.0)
    return known.select("ix", "iy", r("depth", 6, "depth")).unionByName(got.select("ix", "iy", r("depth", 6, "depth")))


@query(joined("bathymetry", ", e AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM bathymetry), o AS (SELECT unnest([-1, 0, 1]) AS dx), q AS (SELECT unnest([-1, 0, 1]) AS dy), t AS (SELECT ix, iy, least(greatest(ix + dx, x0), x1) AS sx, least(greatest(iy + dy, y0), y1) AS sy FROM bathymetry, e, o, q) SELECT t.ix, t.iy, round(sum(b.depth) / 9, 6) AS mean FROM t JOIN bathymetry b ON b.ix = sx AND b.iy = sy GROUP BY ALL"))
def edge_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of 3 by 3 cells in which cells beyond the edge are those at the edge."""
    b = bathymetry(spark, sf_dir)
    return stencil.clamped_mean(b, "depth").select("ix", "iy", r("depth", 6, "mean"))


QUAD = ", q AS (SELECT event_id, event_id % 7 * 0.1e0 AS a, (event_id * 37 % 100) / 100e0 AS s, (event_id * 53 % 100) / 100e0 AS t FROM events)"


@query("WITH q AS (SELECT event_id, (event_id * 37 % 100) / 100e0 AS s, (event_id * 53 % 100) / 100e0 AS t FROM events) SELECT event_id, round((1 - s) * (1 - t), 8) AS w0, round(s * (1 - t), 8) AS w1, round(s * t, 8) AS w2, round((1 - s) * t, 8) AS w3 FROM q")
def quad_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear weights of the corners of turned rectangles for places in them."""
    e = F.col("event_id")
    q = table(spark, sf_dir, "events").select("event_id", (e % 7 * 0.1).alias("a"), (e * 37 % 100 / 100.0).alias("s"), (e * 53 % 100 / 100.0).alias("t"))
    turn = lambda x, y: F.struct((5 + x * F.cos("a") - y * F.sin("a")).alias("x"), (7 + x * F.sin("a") + y * F.cos("a")).alias("y"))
    corner = [turn(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (3, 0), (3, 2), (0, 2))]
    q = q.withColumn("quad", F.array(*corner)).withColumn("at", turn(F.col("s") * 3, F.col("t") * 2))
    w = stencil.quad_weights(F.col("quad"), F.col("at.x"), F.col("at.y"))
    return q.withColumn("w", w).select("event_id", *[r(F.get("w", F.lit(k)), 8, f"w{k}") for k in range(4)])


DEPTHS = [0.0, 1.0, 3.0, 7.0, 15.0, 30.0, 60.0]
AT = "(profile_id % 70 * 1e0)"
FIRST = "least(greatest(len(list_filter(ds, lambda d: d < z)), 1), len(ds) - 1)"


@query(with_views("profiles", f", p AS (SELECT profile_id, values, {DEPTHS} AS ds, {AT} AS z FROM profiles), k AS (SELECT *, {FIRST} AS k FROM p), w AS (SELECT *, least(greatest((z - ds[k]) / (ds[k + 1] - ds[k]), 0), 1) AS w FROM k) SELECT profile_id, CAST(k - 1 AS INT) AS low, round(w, 8) AS w, round(values[k] * (1 - w) + values[k + 1] * w, 6) AS sliced, CAST(list_position(list_transform(ds, lambda d: abs(d - z)), list_min(list_transform(ds, lambda d: abs(d - z)))) - 1 AS INT) AS nearest FROM w").replace(") ,", "),", 1).replace(f"{DEPTHS} AS ds", "[" + ", ".join(f"{d}e0" for d in DEPTHS) + "] AS ds"))
def depth_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at a depth between uneven levels, the weights that give them, and the nearest level."""
    p = profiles(spark, sf_dir).withColumns({"ds": F.array(*[F.lit(d) for d in DEPTHS]), "z": F.col("profile_id") % 70 * 1.0})
    p = p.withColumn("own", F.slice("values", 1, len(DEPTHS))).withColumn("b", vertical.bracket(F.col("ds"), F.col("z")))
    return p.select("profile_id", "b.low", r("b.w", 8, "w"), r(vertical.at_depth(F.col("own"), F.col("ds"), F.col("z")), 6, "sliced"), vertical.nearest_level(F.col("ds"), F.col("z")).alias("nearest"))


S2 = "((s + 1) * (1 + (1 - (s + 1))) * ((1 - cosh(6 * s)) / (cosh(6e0) - 1)) + (1 - (s + 1) * (1 + (1 - (s + 1)))) * (sinh(0.4e0 * (s + 1)) / sinh(0.4e0) - 1))"
S4 = "((exp(0.4e0 * ((1 - cosh(6 * s)) / (cosh(6e0) - 1))) - 1) / (1 - exp(-0.4e0)))"


@query(with_views("bathymetry", f", l AS (SELECT *, unnest(range(0, 10)) AS k FROM bathymetry), s AS (SELECT *, -1 + (k + 0.5e0) / 10 AS s FROM l), z AS (SELECT ix, iy, k, depth, 10e0 * s + (depth - 10) * {S2} AS z2, depth * (10 * s + depth * {S4}) / (10 + depth) AS z4 FROM s) SELECT ix, iy, k, round(z2, 6) AS z2, round(z4, 6) AS z4 FROM z").replace(") ,", "),", 1))
def stretched_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of levels by two more stretching curves."""
    b = bathymetry(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    s, h = -1 + (F.col("k") + 0.5) / 10, F.col("depth")
    c2, c4 = vertical.stretch_2(s, 6.0, 0.4), vertical.stretch_4(s, 6.0, 0.4)
    return b.select("ix", "iy", "k", r(10.0 * s + (h - 10) * c2, 6, "z2"), r(vertical.s_depth(h, s, c4, 10.0, 2), 6, "z4"))


TANH = "CASE WHEN k = 0 THEN 0 ELSE (tanh((dl + du) * (8 - (k - 1)) / 9 - dl) + tanh(dl)) / (tanh(dl) + tanh(du)) - 1 END"


@query(f"WITH p AS (SELECT p_partkey, 1 + p_size % 5 / 2e0 AS dl, 1 + p_size % 3 / 2e0 AS du FROM part), k AS (SELECT *, unnest(range(0, 10)) AS k FROM p) SELECT p_partkey, k, round({TANH}, 8) AS sigma, round(({TANH}) * 150, 5) AS z FROM k")
def tanh_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigma levels that are denser at the ends, and their depths over a floor of 150 m."""
    p = table(spark, sf_dir, "part").select("p_partkey", vertical.sigma_tanh(10, 1 + F.col("p_size") % 5 / 2.0, 1 + F.col("p_size") % 3 / 2.0).alias("s"))
    p = p.select("p_partkey", F.posexplode("s").alias("k", "sigma"))
    return p.select("p_partkey", F.col("k").cast("bigint").alias("k"), r("sigma", 8, "sigma"), r(F.col("sigma") * 150, 5, "z"))


@query(joined("particles bathymetry", ", p AS (SELECT event_id, z, CAST(floor((lon - 12.5e0) * 5) AS BIGINT) AS ix, CAST(floor((lat - 68.5e0) * 10) AS BIGINT) AS iy FROM particles), d AS (SELECT event_id, z, depth FROM p JOIN bathymetry USING (ix, iy)), l AS (SELECT *, unnest(range(0, 10)) AS layer FROM d) SELECT event_id, CAST(min_by(layer, (abs((layer + 0.5e0) / 10 * depth + z), layer)) AS INT) AS layer FROM l GROUP BY event_id"))
def nearest_sigma_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of ten between surface and floor whose middle is nearest to each particle."""
    p = particles(spark, sf_dir).select("event_id", "z", F.floor((F.col("lon") - 12.5) * 5).alias("ix"), F.floor((F.col("lat") - 68.5) * 10).alias("iy")).join(bathymetry(spark, sf_dir), ["ix", "iy"])
    middles = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k + 0.5) / 10 * F.col("depth"))
    return p.select("event_id", vertical.nearest_level(middles, -F.col("z")).alias("layer"))


SOURCE = ", s AS (SELECT profile_id, values, 12.5e0 + profile_id * 7919 % 8500 / 1000e0 AS lon, 68.5e0 + profile_id * 104729 % 3500 / 1000e0 AS lat FROM profiles), n AS (SELECT site_id, values, row_number() OVER (PARTITION BY site_id ORDER BY " + METRES.format(a="t", b="s") + ", profile_id) AS rn FROM sites t, s), z AS (SELECT site_id, values, unnest([0.25e0, 3.5e0, 20e0]) AS z FROM n WHERE rn = 1)"


@query(joined("profiles sites", SOURCE + " SELECT site_id, z, round(values[CAST(floor(z) AS INT) + 1] * (1 - (z - floor(z))) + values[CAST(floor(z) AS INT) + 2] * (z - floor(z)), 6) AS value FROM z"))
def restart_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start values at new places and levels: the nearest source column, linear in the vertical."""
    k = F.col("profile_id")
    s = profiles(spark, sf_dir).select("profile_id", "values", (12.5 + k * 7919 % 8500 / 1000.0).alias("lon2"), (68.5 + k * 104729 % 3500 / 1000.0).alias("lat2"))
    n = joins.nearest(sites(spark, sf_dir), s, "site_id", "profile_id", 30000.0)
    n = n.withColumn("z", F.explode(F.array(F.lit(0.25), F.lit(3.5), F.lit(20.0))))
    return n.select("site_id", "z", r(vertical.linear_at(F.col("values"), F.col("z")), 6, "value"))
