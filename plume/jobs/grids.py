"""Queries on lattices, meshes, seeds and steps, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plume.operators import mesh, seeding, simulate, stencil
from plume.sources.fixtures import bathymetry, particles, sites, table, track, with_views
from plume.streaming import windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def joined(names: str, body: str) -> str:
    return with_views(names, body).replace(") ,", "),", 1)


OFFSETS = "(SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)"


@query(with_views("bathymetry", "SELECT b.ix, b.iy, round(sum(n.depth) / 9, 6) AS smooth FROM bathymetry b JOIN bathymetry n ON abs(b.ix - n.ix) <= 1 AND abs(b.iy - n.iy) <= 1 GROUP BY ALL"))
def box_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.box_smooth(bathymetry(spark, sf_dir), "depth").select("ix", "iy", F.round("depth", 6).alias("smooth"))


HOLES = ", h AS (SELECT ix, iy, CASE WHEN (ix * 7 + iy * 3) % 11 > 1 THEN depth END AS depth FROM bathymetry)"


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (F.col("ix") * 7 + F.col("iy") * 3) % 11 > 1
    return bathymetry(spark, sf_dir).select("ix", "iy", F.when(keep, F.col("depth")).alias("depth"))


@query(joined("bathymetry", HOLES + " SELECT a.ix, a.iy, round(coalesce(any_value(a.depth), max(n.depth)), 6) AS depth FROM h a LEFT JOIN h n ON abs(a.ix - n.ix) <= 1 AND abs(a.iy - n.iy) <= 1 AND (a.ix, a.iy) <> (n.ix, n.iy) GROUP BY a.ix, a.iy"))
def nan_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.dilate(holed(spark, sf_dir), "depth").select("ix", "iy", F.round("depth", 6).alias("depth"))


KERNEL = ", c AS (SELECT a.ix AS cx, a.iy AS cy, a.depth, b.ix, b.iy, exp(-(pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2)) / 2e0) AS w FROM bathymetry a JOIN bathymetry b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 WHERE b.depth > 70), s AS (SELECT *, sum(w) OVER (PARTITION BY cx, cy) AS t FROM c)"


@query(joined("bathymetry", KERNEL + " SELECT ix, iy, round(sum(depth * w / t), 5) AS mass FROM s GROUP BY ix, iy"))
def kernel_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bathymetry(spark, sf_dir)
    return stencil.conserving_kernel(b, "depth", b.filter("depth > 70").select("ix", "iy")).select("ix", "iy", F.round("depth", 5).alias("mass"))


@query(with_views("bathymetry", "SELECT a.ix, a.iy, CASE WHEN b.ix > a.ix THEN 'right' ELSE 'above' END AS side FROM bathymetry a JOIN bathymetry b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1) WHERE (a.depth > 100) <> (b.depth > 100)"))
def isoline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.contour_edges(bathymetry(spark, sf_dir).withColumn("deep", F.col("depth") > 100), "deep")


POINTS = ", p AS (SELECT event_id AS point_id, (event_id * 37 % 4800) / 100e0 AS x, (event_id * 53 % 3700) / 100e0 AS y FROM events)"
CORNERS = ", c AS (SELECT point_id, CAST(floor(x) AS BIGINT) + i AS ix, CAST(floor(y) AS BIGINT) + j AS iy, (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))"


@query(joined("bathymetry", HOLES + POINTS + CORNERS + " SELECT point_id, round(sum(w * depth) / sum(w), 5) AS depth FROM c JOIN h USING (ix, iy) WHERE w > 0 AND depth IS NOT NULL GROUP BY point_id"))
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = e.select(F.col("event_id").alias("point_id"), (F.col("event_id") * 37 % 4800 / 100.0).alias("x"), (F.col("event_id") * 53 % 3700 / 100.0).alias("y"))
    return stencil.bilinear(p, holed(spark, sf_dir), "depth").select("point_id", F.round("depth", 5).alias("depth"))


@query(joined("bathymetry", POINTS + " SELECT point_id, round(depth, 6) AS depth FROM p JOIN bathymetry ON ix = CAST(floor(x + 0.5e0) AS BIGINT) AND iy = CAST(floor(y + 0.5e0) AS BIGINT)"))
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda a, n: F.floor(F.col("event_id") * a % n / 100.0 + 0.5)
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), at(37, 4800).alias("ix"), at(53, 3700).alias("iy"))
    return p.join(bathymetry(spark, sf_dir), ["ix", "iy"]).select("point_id", F.round("depth", 6).alias("depth"))


def diffusion_sql(steps: int) -> str:
    out = "bathymetry"
    for _ in range(steps):
        out = f"(SELECT a.ix, a.iy, any_value(a.depth) + 0.2e0 * coalesce(sum(b.depth - a.depth), 0) AS depth FROM {out} a LEFT JOIN {out} b ON (abs(a.ix - b.ix) = 1 AND a.iy = b.iy) OR (a.ix = b.ix AND abs(a.iy - b.iy) = 1) GROUP BY a.ix, a.iy)"
    return f"SELECT ix, iy, round(depth, 6) AS depth FROM {out}"


@query(with_views("bathymetry", diffusion_sql(2)))
def diffusion_grid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.diffuse(bathymetry(spark, sf_dir), "depth", 0.2, 2).select("ix", "iy", F.round("depth", 6).alias("depth"))


MESH = """, nodes AS (SELECT iy * 50 + ix AS node, CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y, depth AS value FROM bathymetry),
sq AS (SELECT a.ix, a.iy, a.iy * 50 + a.ix AS n0 FROM bathymetry a JOIN bathymetry b ON b.ix = a.ix + 1 AND b.iy = a.iy JOIN bathymetry c ON c.ix = a.ix AND c.iy = a.iy + 1 JOIN bathymetry d ON d.ix = a.ix + 1 AND d.iy = a.iy + 1),
cells AS (SELECT n0 * 2 AS cell, n0 AS a, n0 + 1 AS b, n0 + 51 AS c FROM sq UNION ALL SELECT n0 * 2 + 1, n0, n0 + 51, n0 + 50 FROM sq),
sides AS (SELECT cell, least(a, b) AS u, greatest(a, b) AS v FROM cells UNION ALL SELECT cell, least(b, c), greatest(b, c) FROM cells UNION ALL SELECT cell, least(a, c), greatest(a, c) FROM cells),
edges AS (SELECT u, v, count(*) AS cells FROM sides GROUP BY u, v), links AS (SELECT u AS node, v AS other FROM edges UNION ALL SELECT v, u FROM edges)"""


def lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mesh.lattice_mesh(bathymetry(spark, sf_dir))


@query(joined("bathymetry", MESH + " SELECT u, v, cells FROM edges"))
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.edges(lattice(spark, sf_dir)[1])


@query(joined("bathymetry", MESH + " SELECT s.cell, t.cell AS other FROM sides s JOIN sides t USING (u, v) WHERE s.cell <> t.cell"))
def cell_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.cell_neighbours(lattice(spark, sf_dir)[1])


@query(joined("bathymetry", MESH + ", s AS (SELECT l.node, sum(pow(o.x - n.x, 2)) xx, sum((o.x - n.x) * (o.y - n.y)) xy, sum(pow(o.y - n.y, 2)) yy, sum((o.x - n.x) * (o.value - n.value)) xv, sum((o.y - n.y) * (o.value - n.value)) yv FROM links l JOIN nodes n ON n.node = l.node JOIN nodes o ON o.node = l.other GROUP BY l.node) SELECT node, round((yy * xv - xy * yv) / (xx * yy - xy * xy), 6) AS gx, round((xx * yv - xy * xv) / (xx * yy - xy * xy), 6) AS gy FROM s"))
def node_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.node_gradient(*lattice(spark, sf_dir)).select("node", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"))


CELL = ", t AS (SELECT cell, p.x x0, q.x x1, r.x x2, p.y y0, q.y y1, r.y y2, p.value v0, q.value v1, r.value v2 FROM cells JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b JOIN nodes r ON r.node = c)"


@query(joined("bathymetry", MESH + CELL + " SELECT cell, round(((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2, 6) AS area, round((v0 + v1 + v2) / 3, 6) AS mean FROM t"))
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cells = lattice(spark, sf_dir)
    c = mesh.triangle_area(mesh.corners(cells, nodes))
    return c.select("cell", F.round("area", 6).alias("area"), F.round((F.col("value0") + F.col("value1") + F.col("value2")) / 3, 6).alias("mean"))


@query(joined("bathymetry", MESH + CELL + ", m AS (SELECT cell, (v0 + v1 + v2) / 3 AS value FROM t), n AS (SELECT a AS node, cell FROM cells UNION ALL SELECT b, cell FROM cells UNION ALL SELECT c, cell FROM cells) SELECT node, round(avg(value), 7) AS value FROM n JOIN m USING (cell) GROUP BY node"))
def cell_to_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, cells = lattice(spark, sf_dir)
    c = mesh.corners(cells, nodes).select("cell", ((F.col("value0") + F.col("value1") + F.col("value2")) / 3).alias("value"))
    return mesh.node_means(cells, c).select("node", F.round("value", 7).alias("value"))


FLOW = ", f AS (SELECT ix, iy, sin(ix * 0.3e0) * cos(iy * 0.2e0) * depth / 100 AS u, cos(ix * 0.2e0) * sin(iy * 0.3e0) * depth / 100 AS v FROM bathymetry), d AS (SELECT c.ix, c.iy, (e.u - w.u) / 2 AS ux, (n.u - s.u) / 2 AS uy, (e.v - w.v) / 2 AS vx, (n.v - s.v) / 2 AS vy FROM f c JOIN f e ON e.ix = c.ix + 1 AND e.iy = c.iy JOIN f w ON w.ix = c.ix - 1 AND w.iy = c.iy JOIN f n ON n.ix = c.ix AND n.iy = c.iy + 1 JOIN f s ON s.ix = c.ix AND s.iy = c.iy - 1), o AS (SELECT *, vx - uy AS vorticity, pow(ux - vy, 2) + pow(vx + uy, 2) - pow(vx - uy, 2) AS ow FROM d)"


@query(joined("bathymetry", FLOW + " SELECT ix, iy, round(vorticity, 8) AS vorticity, round(ow, 8) AS ow, ow < -0.2e0 * (SELECT stddev_pop(ow) FROM o) AS eddy FROM o"))
def okubo_weiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vorticity, Okubo-Weiss parameter and eddy mask by central differences on the lattice."""
    f = bathymetry(spark, sf_dir).withColumns({"u": F.sin(F.col("ix") * 0.3) * F.cos(F.col("iy") * 0.2) * F.col("depth") / 100, "v": F.cos(F.col("ix") * 0.2) * F.sin(F.col("iy") * 0.3) * F.col("depth") / 100})
    four = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    # each cell tells its neighbours its velocity: one grouping instead of four joins
    told = f.select("ix", "iy", "u", "v", F.explode(four).alias("s")).select((F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), "u", "v", (-F.col("s.dx")).alias("dx"), (-F.col("s.dy")).alias("dy"))
    side = lambda c, dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(c)))
    half = lambda c, dx, dy: (side(c, dx, dy) - side(c, -dx, -dy)) / 2
    d = told.groupBy("ix", "iy").agg(half("u", 1, 0).alias("ux"), half("u", 0, 1).alias("uy"), half("v", 1, 0).alias("vx"), half("v", 0, 1).alias("vy")).dropna()
    d = d.join(f.select("ix", "iy"), ["ix", "iy"], "left_semi")
    o = d.select("ix", "iy", (F.col("vx") - F.col("uy")).alias("w"), ((F.col("ux") - F.col("vy")) ** 2 + (F.col("vx") + F.col("uy")) ** 2 - (F.col("vx") - F.col("uy")) ** 2).alias("o"))
    spread = o.agg(F.stddev_pop("o")).scalar()
    return o.select("ix", "iy", F.round("w", 8).alias("vorticity"), F.round("o", 8).alias("ow"), (F.col("o") < -0.2 * spread).alias("eddy"))


@query(joined("bathymetry", MESH + ", m AS (SELECT l.node, avg(o.value) AS mean FROM links l JOIN nodes o ON o.node = l.other GROUP BY l.node), n1 AS (SELECT node, value * 0.8e0 + coalesce(mean, value) * 0.2e0 AS value FROM nodes LEFT JOIN m USING (node)), m1 AS (SELECT l.node, avg(o.value) AS mean FROM links l JOIN n1 o ON o.node = l.other GROUP BY l.node) SELECT node, round(value * 0.8e0 + coalesce(mean, value) * 0.2e0, 6) AS value FROM n1 LEFT JOIN m1 USING (node)"))
def laplacian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.laplacian(*lattice(spark, sf_dir), passes=2).select("node", F.round("value", 6).alias("value"))


GOLDEN = f"{seeding.GOLDEN!r}e0".replace("e0e0", "e0")


@query(joined("sites", f", k AS (SELECT *, 20 + site_id % 10 AS n FROM sites), s AS (SELECT *, unnest(range(0, n)) AS k FROM k) SELECT site_id, k, round(lon + 500e0 * sqrt((k + 0.5e0) / n) * cos(k * {GOLDEN}) / 40000, 8) AS lon, round(lat + 500e0 * sqrt((k + 0.5e0) / n) * sin(k * {GOLDEN}) / 111000, 8) AS lat FROM s"))
def seed_sunflower(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seeding.sunflower(sites(spark, sf_dir), 20 + F.col("site_id") % 10, 500.0)
    return s.select("site_id", F.col("k").cast("bigint").alias("k"), F.round("seed_lon", 8).alias("lon"), F.round("seed_lat", 8).alias("lat"))


def uniform_sql(*parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0"


@query(joined("sites", f", s AS (SELECT *, unnest(range(0, 30)) AS k FROM sites), r AS (SELECT *, k / 29e0 AS w, (200 + 800 * (k / 29e0)) * sqrt({uniform_sql('site_id', 'k', chr(39) + 'r' + chr(39))}) AS r, 2 * pi() * {uniform_sql('site_id', 'k', chr(39) + 'a' + chr(39))} AS a FROM s) SELECT site_id, k, round(lon + 0.5e0 * w + r * cos(a) / 40000, 8) AS lon, round(lat + 0.1e0 * w + r * sin(a) / 111000, 8) AS lat FROM r"))
def seed_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.struct((F.col("lon") + 0.5).alias("lon"), (F.col("lat") + 0.1).alias("lat"))
    s = seeding.cone(sites(spark, sf_dir), end, 30, 200.0, 1000.0)
    return s.select("site_id", F.col("k").cast("bigint").alias("k"), F.round("seed_lon", 8).alias("lon"), F.round("seed_lat", 8).alias("lat"))


RING = [(13.0, 68.7), (20.0, 69.2), (18.5, 71.8), (15.0, 70.0), (13.5, 71.5)]


def ring_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]):
        parts.append(f"CASE WHEN ({y1}e0 > lat) <> ({y2}e0 > lat) AND lon < (lat - {y1}e0) * ({x2}e0 - {x1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query(with_views("particles", f"SELECT event_id FROM particles WHERE ({ring_sql()}) % 2 = 1"))
def seed_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.inside(particles(spark, sf_dir), RING).select("event_id")


@query(joined("sites", ", s AS (SELECT site_id, unnest(range(0, 24)) AS release FROM sites) SELECT site_id, release, release * 3600 AS release_sec FROM s WHERE release * 3600 >= 7200 AND release * 3600 < 7200 + 6 * 3600"))
def release_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seeding.schedule(sites(spark, sf_dir), 24).select("site_id", F.col("release").cast("bigint").alias("release"), F.col("release_sec").cast("bigint").alias("release_sec"))
    return s.filter((F.col("release_sec") >= 7200) & (F.col("release_sec") < 7200 + 6 * 3600))


GYRE_START = "SELECT event_id, (event_id * 37 % 2000) / 1000e0 AS x, (event_id * 53 % 1000) / 1000e0 AS y, (event_id % 10) * 1e0 AS t FROM events"


def gyre_sql(x: str, y: str, t: str) -> tuple[str, str]:
    a = f"(0.25e0 * sin(0.628e0 * ({t})))"
    f, df = f"({a} * ({x}) * ({x}) + (1 - 2 * {a}) * ({x}))", f"(2 * {a} * ({x}) + 1 - 2 * {a})"
    return f"(-pi() * 0.1e0 * sin(pi() * {f}) * cos(pi() * ({y})))", f"(pi() * 0.1e0 * cos(pi() * {f}) * sin(pi() * ({y})) * {df})"


def rk4_sql() -> str:
    q = GYRE_START
    before = None
    for k, h in ((1, 0), (2, 0.05), (3, 0.05), (4, 0.1)):
        x, y = (f"x + u{before} * {h}e0", f"y + v{before} * {h}e0") if before else ("x", "y")
        u, v = gyre_sql(x, y, f"t + {h}e0")
        q, before = f"SELECT *, {u} AS u{k}, {v} AS v{k} FROM ({q})", k
    return f"SELECT event_id, round(x + 0.1e0 * (u1 + 2 * u2 + 2 * u3 + u4) / 6, 8) AS x, round(y + 0.1e0 * (v1 + 2 * v2 + 2 * v3 + v4) / 6, 8) AS y FROM ({q})"


def gyre_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (e * 37 % 2000 / 1000.0).alias("x"), (e * 53 % 1000 / 1000.0).alias("y"), (e % 10 * 1.0).alias("t"))


def placed(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query(f"SELECT event_id, round(x + 0.1e0 * u, 8) AS x, round(y + 0.1e0 * v, 8) AS y FROM (SELECT *, {gyre_sql('x', 'y', 't')[0]} AS u, {gyre_sql('x', 'y', 't')[1]} AS v FROM ({GYRE_START}))")
def euler_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(simulate.advect(gyre_points(spark, sf_dir), simulate.double_gyre, 0.1))


@query(rk4_sql())
def rk4_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(simulate.advect(gyre_points(spark, sf_dir), simulate.double_gyre, 0.1, "rk4"))


def normal_sql(*parts: str) -> str:
    return f"sqrt(-2 * ln({uniform_sql(*parts, chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {uniform_sql(*parts, chr(39) + 'a' + chr(39))})"


WALK = repr(math.sqrt(2 * 10.0 * 3600.0)) + "e0"


@query(with_views("particles", f"SELECT event_id, round({WALK} * {normal_sql('event_id', 'step', chr(39) + 'x' + chr(39))}, 5) AS dx, round({WALK} * {normal_sql('event_id', 'step', chr(39) + 'y' + chr(39))}, 5) AS dy FROM particles"))
def random_walk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.random_walk(particles(spark, sf_dir), 10.0, 3600.0).select("event_id", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"))


FACTOR = "greatest(1 - 3600 * 0.18e-6 - CASE WHEN z >= -5 THEN 1 ELSE 0 END * (event_id % 30) * 0.01e0 / 25, 0)"


@query(joined("track", f""", n AS (SELECT traj_id, step, {FACTOR} AS f, weight, row_number() OVER (PARTITION BY traj_id ORDER BY step) AS k FROM track)
SELECT traj_id, step, round(first_value(weight) OVER w * product(f) OVER w, 6) AS aged FROM n WINDOW w AS (PARTITION BY traj_id ORDER BY step ROWS UNBOUNDED PRECEDING)"""))
def mass_feedback_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = simulate.aged_weights(track(spark, sf_dir), 0.18e-6, (F.col("event_id") % 30).cast("double"), 25.0, 5.0)
    return t.select("traj_id", "step", F.round("aged", 6).alias("aged"))


RATES = {0: {1: 1e-4, 2: 2e-5}, 1: {0: 5e-5}, 2: {3: 1e-4, 4: 1e-4}, 4: {0: 1e-5}}


def jump_sql() -> str:
    u, out = uniform_sql("event_id", "'jump'"), "CASE specie"
    for origin, to in RATES.items():
        total, inner = 0.0, "CASE"
        for target, rate in sorted(to.items()):
            total += 1 - math.exp(-rate * 3600.0)
            inner += f" WHEN u < {total!r}e0 THEN {target}"
        out += f" WHEN {origin} THEN {inner} ELSE specie END"
    return f"SELECT specie, {out} ELSE specie END AS next_specie, count(*) AS n FROM (SELECT *, {u} AS u FROM particles) GROUP BY ALL"


@query(with_views("particles", jump_sql()))
def markov_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.markov_jump(particles(spark, sf_dir), RATES, 3600.0).groupBy("specie", "next_specie").agg(F.count("*").alias("n"))


@query()
def ftle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyapunov exponents of the lattice of the bathymetry in the double gyre."""
    b = bathymetry(spark, sf_dir).select("ix", "iy", (F.col("ix") * 0.04).alias("x"), (F.col("iy") * 0.02).alias("y"), F.lit(0.0).alias("t"))
    return simulate.ftle(b, simulate.double_gyre, 0.02, 0.5, 4).select("ix", "iy", F.round("ftle", 6).alias("ftle"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


SECONDS = "CAST(epoch_us(ts) // 1000000 AS BIGINT)"


def seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.unix_timestamp("start"))


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000e0) AS BIGINT) * 3600 AS start, event_type, round(sum(value), 4) AS mass, count(*) AS n FROM events GROUP BY ALL")
def tumbling_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds(windows.tumbling_mass(stamped(spark, sf_dir)))


@query("WITH w AS (SELECT (CAST(floor(epoch_us(ts) / 10800000000e0) AS BIGINT) - k) * 10800 AS start, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, round(sum(value), 4) AS mass, count(*) AS n FROM w GROUP BY start")
def sliding_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds(windows.sliding_mass(stamped(spark, sf_dir)))


@query("WITH g AS (SELECT *, CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000, true) AS INT) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(epoch_us(ts)) // 1000000 AS start, count(*) AS n, round(sum(value), 4) AS mass FROM s GROUP BY user_id, k")
def session_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds(windows.sessions(stamped(spark, sf_dir)))
