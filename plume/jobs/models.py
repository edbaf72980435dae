"""Queries on meshes, curvilinear and terrain-following grids, series and kernels, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.jobs.grids import HOLES, MESH, holed, lattice
from plume.jobs.meshes import CENTRE
from plume.jobs.series import CELLS, GRID
from plume.jobs.tracks import joined
from plume.operators import coast, curvilinear, harmonics, kernels, mesh, potential, vertical
from plume.sources.drift_text import Run, read_drift, write_drift
from plume.sources.fixtures import bathymetry, particles, sites, table, track, with_views
from plume.sources.stores import kept
from plume.streaming import steps

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


def stirred(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, vx, vy: velocities that turn about the mesh, stronger over shallow cells."""
    c = mesh.centres(cells, nodes)
    return c.select("cell", (F.sin(F.col("cx") * 0.3) * F.col("mean") / 100).alias("vx"), (F.cos(F.col("cy") * 0.2) * F.col("mean") / 100).alias("vy"))


CROSSINGS = """, f AS (SELECT cell, sin(cx * 0.3e0) * mean / 100 AS vx, cos(cy * 0.2e0) * mean / 100 AS vy FROM m),
d AS (SELECT u, v, any_value(vx) * (any_value(q.y) - any_value(p.y)) - any_value(vy) * (any_value(q.x) - any_value(p.x)) AS d FROM (SELECT u, v, avg(vx) AS vx, avg(vy) AS vy FROM sides JOIN f USING (cell) GROUP BY u, v) JOIN nodes p ON p.node = u JOIN nodes q ON q.node = v GROUP BY u, v)"""
#: Trees of least neighbours, walked down from their roots; then the roots hook on once, which is enough on the lattice.
WALK = """, o AS (SELECT v AS node, u AS other, d FROM d UNION ALL SELECT u, v, -d FROM d), b AS (SELECT node, min(other) AS parent, arg_min(d, other) AS d FROM o GROUP BY node),
w AS (SELECT node, node AS root, 0e0 AS p FROM b WHERE parent > node UNION ALL SELECT b.node, w.root, w.p + b.d FROM w JOIN b ON b.parent = w.node AND b.parent < b.node),
x AS (SELECT greatest(p.root, q.root) AS root, least(p.root, q.root) AS top, CASE WHEN p.root < q.root THEN p.p + d - q.p ELSE q.p - d - p.p END AS gap, u, v FROM d JOIN w p ON p.node = u JOIN w q ON q.node = v WHERE p.root <> q.root),
h AS (SELECT root, arg_min(top, (v, u)) AS top, arg_min(gap, (v, u)) AS gap FROM x GROUP BY root)"""


@query(joined("bathymetry", MESH + CENTRE + CROSSINGS + WALK + " SELECT node, coalesce(top, w.root) AS root, round(p + coalesce(gap, 0), 5) AS psi FROM w LEFT JOIN h ON h.root = w.root").replace("WITH ", "WITH RECURSIVE ", 1))
def stream_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream function of a flow on the mesh, along a spanning tree."""
    nodes, cells = lattice(spark, sf_dir)
    return potential.stream_function(nodes, cells, stirred(nodes, cells)).select("node", "root", r("p", 5, "psi"))


@query(joined("bathymetry", MESH + CENTRE + CROSSINGS + ", s AS (SELECT cell, a AS i, b AS j FROM cells UNION ALL SELECT cell, b, c FROM cells UNION ALL SELECT cell, c, a FROM cells) SELECT cell, round(sum(CASE WHEN i < j THEN d ELSE -d END), 5) AS residual FROM s JOIN d ON u = least(i, j) AND v = greatest(i, j) GROUP BY cell"))
def stream_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the flow from having an exact stream function: its differences around each cell."""
    nodes, cells = lattice(spark, sf_dir)
    return potential.loop_residuals(nodes, cells, stirred(nodes, cells)).select("cell", r("residual", 5, "residual"))


STEEPEST = 0.15
SLOPES = f""", z AS (SELECT 0 AS k, node, value FROM nodes UNION ALL (
  WITH s AS (SELECT u, v, CASE WHEN p.value >= q.value THEN u ELSE v END AS up, CASE WHEN p.value >= q.value THEN v ELSE u END AS down, abs(p.value - q.value) / (p.value + q.value) AS r, 0.5e0 * (abs(p.value - q.value) - {STEEPEST}e0 * (p.value + q.value)) AS x
    FROM edges JOIN z p ON p.node = u JOIN z q ON q.node = v WHERE abs(p.value - q.value) / (p.value + q.value) > {STEEPEST}e0 + 1e-9),
  e AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r DESC, u, v) AS rn FROM (SELECT u, v, r, up AS node, -x AS x FROM s UNION ALL SELECT u, v, r, down, x FROM s)),
  c AS (SELECT node, x FROM (SELECT *, count(*) OVER (PARTITION BY u, v) AS n FROM e WHERE rn = 1) WHERE n = 2)
  SELECT k + 1, z.node, value + coalesce(x, 0) FROM z LEFT JOIN c ON c.node = z.node WHERE EXISTS (SELECT 1 FROM s)))
SELECT node, round(arg_max(value, k), 6) AS depth FROM z GROUP BY node"""


@query(joined("bathymetry", MESH + SLOPES).replace("WITH ", "WITH RECURSIVE ", 1))
def limited_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of the mesh after the slope limiter."""
    nodes, cells = lattice(spark, sf_dir)
    return potential.limited_slopes(nodes, cells, STEEPEST).select("node", r("value", 6, "depth"))


TIDES = ["M2", "K1", "M4"]
#: Levels at places with two tides, and what particles add to them.
LEVELS = ", l AS (SELECT traj_id % 20 AS place, sec / 3600e0 AS hour, 2 + weight / 100 + 1.3e0 * cos(sec / 3600e0 * radians(28.9841042e0) - traj_id % 20 / 3e0) + 0.4e0 * cos(sec / 3600e0 * radians(15.0410686e0) - 1) AS level FROM particles)"


def tide_sql(hours: str) -> list[str]:
    """The basis in SQL."""
    return ["1e0", *[f"{f}({hours} * radians({harmonics.SPEEDS[n]}e0))" for n in TIDES for f in ("cos", "sin")]]


def elimination_sql() -> str:
    """Gauss-Jordan elimination of the normal equations, one step a table; the last one is ``fit``."""
    size = 2 * len(TIDES) + 1
    b = tide_sql("hour")
    a = lambda i, j: f"a{i}_{j}"
    sums = [f"sum({b[i]} * {b[j]}) AS {a(i, j)}" for i in range(size) for j in range(size)] + [f"sum({b[i]} * level) AS {a(i, size)}" for i in range(size)]
    out = f", g0 AS (SELECT place, count(*) AS n, {', '.join(sums)} FROM l GROUP BY place)"
    for k in range(size):
        rest = [f"{a(i, j)} / {a(k, k)} AS {a(i, j)}" if i == k else f"{a(i, j)} - {a(i, k)} * {a(k, j)} / {a(k, k)} AS {a(i, j)}" for i in range(size) for j in range(k + 1, size + 1)]
        out += f", g{k + 1} AS (SELECT place, n, {', '.join(rest)} FROM g{k})"
    return out + f", fit AS (SELECT place, n, {', '.join(f'{a(i, size)} AS x{i}' for i in range(size))} FROM g{size})"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, place = F.col("sec") / 3600.0, F.col("traj_id") % 20
    level = 2 + F.col("weight") / 100 + 1.3 * F.cos(hour * F.radians(F.lit(28.9841042)) - place / 3.0) + 0.4 * F.cos(hour * F.radians(F.lit(15.0410686)) - 1)
    return particles(spark, sf_dir).select(place.alias("place"), hour.alias("hour"), level.alias("level"))


AMPLITUDES = ", ".join(f"round(sqrt(x{2 * k + 1} * x{2 * k + 1} + x{2 * k + 2} * x{2 * k + 2}), 6) AS amplitude_{n}, round((degrees(atan2(x{2 * k + 2}, x{2 * k + 1})) + 360) % 360, 4) AS phase_{n}" for k, n in enumerate(TIDES))


@query(joined("particles", LEVELS + elimination_sql() + f" SELECT place, n, round(x0, 6) AS mean, {AMPLITUDES} FROM fit"))
def tidal_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes and phases of three tides at each place, by least squares."""
    fit = harmonics.constituents(levels(spark, sf_dir), "place", F.col("hour"), F.col("level"), TIDES)
    parts = [c for k, n in enumerate(TIDES) for c in (r(harmonics.amplitude(k), 6, f"amplitude_{n}"), r(harmonics.phase(k), 4, f"phase_{n}"))]
    return fit.select("place", "n", r("x0", 6, "mean"), *parts)


@query(joined("particles", LEVELS + elimination_sql() + f", h AS (SELECT place, floor(hour) AS hour, avg(level) AS level FROM l GROUP BY 1, 2), w AS (SELECT place, unnest(range(0, 48)) AS hour FROM fit) SELECT w.place, w.hour, round(coalesce(level, {' + '.join(f'x{k} * {b}' for k, b in enumerate(tide_sql('w.hour')))}), 6) AS level, level IS NULL AS filled FROM w JOIN fit USING (place) LEFT JOIN h ON h.place = w.place AND h.hour = w.hour").replace("FROM l GROUP BY place)", "FROM (SELECT place, floor(hour) AS hour, level FROM l) l GROUP BY place)", 1))
def tidal_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of hourly levels at each place: observed, or else predicted by the tides of all observations."""
    seen = levels(spark, sf_dir).withColumn("hour", F.floor("hour"))
    wanted = seen.select("place").distinct().select("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(47).cast("bigint"))).alias("hour"))
    out = harmonics.filled(seen, wanted, "place", "hour", "level", TIDES)
    return out.select("place", "hour", r("level", 6, "level"), "filled")


#: The lattice bent to a curvilinear grid of quadrilaterals without a right angle.
BENT = ", g AS (SELECT ix, iy, 12 + 0.1e0 * ix + 0.03e0 * sin(iy * 0.7e0) AS x, 68 + 0.05e0 * iy + 0.02e0 * cos(ix * 0.9e0) AS y, depth FROM bathymetry)"
SPOTS = ", p AS (SELECT event_id, 12 + 0.1e0 * ((event_id * 37 % 4800) / 100e0 + 0.0031e0) AS px, 68 + 0.05e0 * ((event_id * 53 % 3700) / 100e0 + 0.0017e0) AS py FROM events)"
#: The bilinear map inverted in closed form.
INVERTED = """, q AS (SELECT a.ix, a.iy, a.x AS x0, a.y AS y0, b.x - a.x AS ex, b.y - a.y AS ey, d.x - a.x AS fx, d.y - a.y AS fy, a.x - b.x + c.x - d.x AS gx, a.y - b.y + c.y - d.y AS gy, a.depth AS h0, b.depth AS h1, c.depth AS h2, d.depth AS h3,
  least(a.x, b.x, c.x, d.x) AS x_, greatest(a.x, b.x, c.x, d.x) AS _x, least(a.y, b.y, c.y, d.y) AS y_, greatest(a.y, b.y, c.y, d.y) AS _y
  FROM g a JOIN g b ON b.ix = a.ix + 1 AND b.iy = a.iy JOIN g c ON c.ix = a.ix + 1 AND c.iy = a.iy + 1 JOIN g d ON d.ix = a.ix AND d.iy = a.iy + 1),
k AS (SELECT *, px - x0 AS hx, py - y0 AS hy FROM p JOIN q ON px BETWEEN x_ AND _x AND py BETWEEN y_ AND _y),
k2 AS (SELECT *, gx * fy - gy * fx AS c2, ex * fy - ey * fx + hx * gy - hy * gx AS c1, hx * ey - hy * ex AS c0 FROM k),
roots AS (SELECT *, unnest(CASE WHEN abs(c2) < 1e-12 THEN [-c0 / c1] ELSE [(-c1 + sqrt(greatest(c1 * c1 - 4 * c0 * c2, 0))) / (2 * c2), (-c1 - sqrt(greatest(c1 * c1 - 4 * c0 * c2, 0))) / (2 * c2)] END) AS t FROM k2),
st AS (SELECT *, CASE WHEN abs(ex + gx * t) > abs(ey + gy * t) THEN (hx - fx * t) / (ex + gx * t) ELSE (hy - fy * t) / (ey + gy * t) END AS s FROM roots),
found AS (SELECT * FROM st WHERE s BETWEEN -1e-9 AND 1 + 1e-9 AND t BETWEEN -1e-9 AND 1 + 1e-9 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY iy, ix) = 1)"""


def bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bathymetry(spark, sf_dir).select("ix", "iy", (12 + 0.1 * F.col("ix") + 0.03 * F.sin(F.col("iy") * 0.7)).alias("x"), (68 + 0.05 * F.col("iy") + 0.02 * F.cos(F.col("ix") * 0.9)).alias("y"), "depth")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (12 + 0.1 * (e * 37 % 4800 / 100.0 + 0.0031)).alias("px"), (68 + 0.05 * (e * 53 % 3700 / 100.0 + 0.0017)).alias("py"))


@query(joined("bathymetry", BENT + SPOTS + INVERTED + " SELECT event_id, round(ix + s, 6) AS x, round(iy + t, 6) AS y FROM found"))
def curvilinear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where particles are on a curvilinear grid, in cell units."""
    return curvilinear.position_to_index(spots(spark, sf_dir), bent(spark, sf_dir), "event_id", 0.1).select("event_id", r("x", 6, "x"), r("y", 6, "y"))


@query(joined("bathymetry", BENT + SPOTS + INVERTED + " SELECT event_id, round((1 - s) * (1 - t), 6) AS w0, round(s * (1 - t), 6) AS w1, round(s * t, 6) AS w2, round((1 - s) * t, 6) AS w3, round((1 - s) * (1 - t) * h0 + s * (1 - t) * h1 + s * t * h2 + (1 - s) * t * h3, 5) AS depth FROM found"))
def quadrilateral_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the corners of the quadrilateral around each particle, and the depth that they give."""
    at = curvilinear.located(spots(spark, sf_dir), bent(spark, sf_dir), "event_id", 0.1, ("depth",))
    w = curvilinear.corner_weights(F.col("s"), F.col("t"))
    depth = sum((c * F.col(f"depth{k}") for k, c in enumerate(w)), F.lit(0.0))
    return at.select("event_id", *[r(c, 6, f"w{k}") for k, c in enumerate(w)], r(depth, 5, "depth"))


CUBIC = ", p AS (SELECT event_id, (event_id * 37 % 4800) / 100e0 + 0.0031e0 AS x, (event_id * 53 % 3700) / 100e0 + 0.0017e0 AS y FROM events), f AS (SELECT *, x - floor(x) AS a, y - floor(y) AS b FROM p), k AS (SELECT unnest([-1, 0, 1, 2]) AS k)"
LAGRANGE = "CASE {k} WHEN -1 THEN -{a} * ({a} - 1) * ({a} - 2) / 6 WHEN 0 THEN ({a} + 1) * ({a} - 1) * ({a} - 2) / 2 WHEN 1 THEN -({a} + 1) * {a} * ({a} - 2) / 2 ELSE ({a} + 1) * {a} * ({a} - 1) / 6 END"


@query(joined("bathymetry", HOLES + CUBIC + f", w AS (SELECT event_id, h.depth, ({LAGRANGE.format(k='i.k', a='a')}) * ({LAGRANGE.format(k='j.k', a='b')}) AS w FROM f, k i, k j LEFT JOIN h ON h.ix = CAST(floor(x) AS BIGINT) + i.k AND h.iy = CAST(floor(y) AS BIGINT) + j.k), s AS (SELECT event_id, coalesce(sum(w) FILTER (depth IS NOT NULL), 0) AS there, sum(w * depth) AS total FROM w GROUP BY event_id) SELECT event_id, round(CASE WHEN there >= 0.5e0 THEN total / there END, 5) AS depth FROM s"))
def cubic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths at particles by cubics in both directions, around holes."""
    e = F.col("event_id")
    p = table(spark, sf_dir, "events").select("event_id", (e * 37 % 4800 / 100.0 + 0.0031).alias("x"), (e * 53 % 3700 / 100.0 + 0.0017).alias("y"))
    return curvilinear.cubic(p, holed(spark, sf_dir), "depth", "event_id").select("event_id", r("depth", 5, "depth"))


#: A day of currents every six hours on ten levels over the lattice, turned with the grid.
CRITICAL, SURFACE, BOTTOM = 10.0, 6.0, 0.4
S4_SQL = "((exp(0.4e0 * ((1 - cosh(6 * s)) / (cosh(6e0) - 1))) - 1) / (1 - exp(-0.4e0)))"
WATER = f""", lv AS (SELECT ix, iy, depth AS h, slot, k, -(k + 0.5e0) / 10 AS s FROM bathymetry, (SELECT unnest(range(0, 5)) AS slot), (SELECT unnest(range(0, 10)) AS k)),
c AS (SELECT ix, iy, slot, k, -(h * (10 * s + h * {S4_SQL}) / (10 + h)) AS d, sin(ix * 0.3e0 + k * 0.2e0) * (1 + slot) AS u, cos(iy * 0.2e0 - k * 0.1e0) * (2 - slot * 0.3e0) AS v, (ix - iy) * 0.01e0 AS a FROM lv),
e AS (SELECT ix, iy, slot, k, d, u * cos(a) - v * sin(a) AS u, u * sin(a) + v * cos(a) AS v FROM c),
p AS (SELECT event_id, (event_id * 37 % 4800) / 100e0 + 0.0031e0 AS x, (event_id * 53 % 3700) / 100e0 + 0.0017e0 AS y, -z AS z, (sec % 86400) / 3600e0 AS t FROM particles),
n AS (SELECT event_id, z, CAST(floor(x) AS BIGINT) + i AS ix, CAST(floor(y) AS BIGINT) + j AS iy, CAST(floor(t / 6) AS BIGINT) + m AS slot, (CASE i WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE j WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE m WHEN 1 THEN t / 6 - floor(t / 6) ELSE 1 - t / 6 + floor(t / 6) END) AS w
  FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS m)),
b AS (SELECT event_id, any_value(w) AS w, max(e.d) FILTER (e.d < n.z) AS up, min(e.d) FILTER (e.d >= n.z) AS down, any_value(n.z) AS z, arg_max(u, e.d) FILTER (e.d < n.z) AS u0, arg_min(u, e.d) FILTER (e.d >= n.z) AS u1, arg_max(v, e.d) FILTER (e.d < n.z) AS v0, arg_min(v, e.d) FILTER (e.d >= n.z) AS v1 FROM n JOIN e USING (ix, iy, slot) GROUP BY event_id, ix, iy, slot),
l AS (SELECT event_id, w, CASE WHEN up IS NULL THEN u1 WHEN down IS NULL THEN u0 ELSE u0 + (u1 - u0) * (z - up) / (down - up) END AS u, CASE WHEN up IS NULL THEN v1 WHEN down IS NULL THEN v0 ELSE v0 + (v1 - v0) * (z - up) / (down - up) END AS v FROM b WHERE w > 0)"""


@query(joined("particles bathymetry", WATER + " SELECT event_id, round(sum(w * u) / sum(w), 6) AS u, round(sum(w * v) / sum(w), 6) AS v FROM l GROUP BY event_id"))
def terrain_following_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current at particles: between four columns, the levels around their depth in each, and two times."""
    levels_ = F.sequence(F.lit(0), F.lit(9))
    s = lambda k: -(k + 0.5) / 10
    c = bathymetry(spark, sf_dir).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    depths = F.transform(levels_, lambda k: -vertical.s_depth(F.col("depth"), s(k), vertical.stretch_4(s(k), SURFACE, BOTTOM), CRITICAL, 2))

    def east_and_north(k: Column) -> tuple[Column, Column]:
        u, v = F.sin(F.col("ix") * 0.3 + k * 0.2) * (1 + F.col("slot")), F.cos(F.col("iy") * 0.2 - k * 0.1) * (2 - F.col("slot") * 0.3)
        return curvilinear.turned(u, v, (F.col("ix") - F.col("iy")) * 0.01)

    east, north = F.transform(levels_, lambda k: east_and_north(k)[0]), F.transform(levels_, lambda k: east_and_north(k)[1])
    columns = c.select("ix", "iy", "slot", depths.alias("depths"), east.alias("u"), north.alias("v"))
    e = F.col("event_id")
    p = particles(spark, sf_dir).select("event_id", (e * 37 % 4800 / 100.0 + 0.0031).alias("x"), (e * 53 % 3700 / 100.0 + 0.0017).alias("y"), (-F.col("z")).alias("z"), (F.col("sec") % 86400 / 3600.0).alias("t"))
    return curvilinear.four_way(p, columns, "event_id", ("u", "v"), 6.0).select("event_id", r("u", 6, "u"), r("v", 6, "v"))


#: Hours without a row after which a particle is lost.
GAP = 48
#: Step 0 in seconds (2024-01-01).
ORIGIN = 1_704_067_200


@query(with_views("track", f", w AS (SELECT traj_id, step, z, lag(step) OVER o AS p, lag(z) OVER o AS pz, lead(step) OVER o AS n FROM track WINDOW o AS (PARTITION BY traj_id ORDER BY step)) SELECT traj_id, step, round(CASE WHEN step - p < {GAP} THEN z - pz END, 6) AS dz, CASE WHEN step - p < {GAP} THEN 'continuing' ELSE 'activated' END AS phase FROM w UNION ALL SELECT traj_id, step + {GAP}, NULL, 'lost' FROM w WHERE n - step >= {GAP} OR n IS NULL AND step + {GAP} <= (SELECT max(step) FROM track)").replace(") , w", "), w", 1))
def two_step_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical displacements from a stream that keeps one row for each particle and forgets those that are silent."""
    rows = track(spark, sf_dir).select("traj_id", "step", "z", F.timestamp_seconds(F.col("step") * 3600 + ORIGIN).alias("at"))
    stream = steps.in_batches(rows, "track-stream", "step", 4)
    out = steps.run_to_table(steps.displacements(stream, GAP, ORIGIN * 1000), "displacements")
    return out.select("traj_id", "step", r("dz", 6, "dz"), "phase")


#: Cells of the particles' grid, bandwidths of the kernels in cells, and windows of the statistics.
SHAPE, BANDWIDTHS, WINDOW = (17, 14), [0.0, 0.5, 0.8, 1.2, 1.6], 2
MASS = f", g AS (SELECT CAST(floor(step / 24e0) AS BIGINT) AS day, ix, iy, count(*) AS n, sum(weight) AS mass FROM (SELECT *, {CELLS} FROM particles) GROUP BY ALL)"
REFLECTED = f""", i AS (SELECT day, n, unnest(list_distinct([ix, -ix, {2 * (SHAPE[0] - 1)} - ix])) AS x, iy FROM g), j AS (SELECT day, n, x, unnest(list_distinct([iy, -iy, {2 * (SHAPE[1] - 1)} - iy])) AS y FROM i),
w AS (SELECT g.day, g.ix, g.iy, any_value(g.mass) AS mass, sum(j.n) AS s, sum(j.n * j.n) AS ss, sum(j.n * (pow(x - g.ix, 2) + pow(y - g.iy, 2))) AS d2 FROM g JOIN j ON j.day = g.day AND abs(x - g.ix) <= {WINDOW} AND abs(y - g.iy) <= {WINDOW} GROUP BY g.day, g.ix, g.iy),
h AS (SELECT *, sqrt(d2 / s / 2) * pow(s * s / ss, -1 / 6e0) AS h FROM w)"""
#: Cells that are open water.
OPEN = ", o AS (SELECT ix, iy FROM (SELECT unnest(range(0, 17)) AS ix), (SELECT unnest(range(0, 14)) AS iy) WHERE (ix * 7 + iy * 3) % 11 > 1)"
SPREAD = f""", b AS (SELECT *, coalesce([{', '.join(f'{b}e0' for b in BANDWIDTHS)}][len(list_filter([{', '.join(f'{b}e0' for b in BANDWIDTHS)}], lambda c: c < h)) + 1], {BANDWIDTHS[-1]}e0) AS bw FROM h),
k AS (SELECT b.day, b.ix AS cx, b.iy AS cy, mass, o.ix, o.iy, CASE WHEN bw > 0 THEN exp(-(pow(o.ix - b.ix, 2) + pow(o.iy - b.iy, 2)) / (2 * bw * bw)) ELSE 1 END AS w FROM b LEFT JOIN o ON greatest(abs(o.ix - b.ix), abs(o.iy - b.iy)) <= ceil(3 * bw)),
t AS (SELECT *, sum(w) OVER (PARTITION BY day, cx, cy) AS total FROM k)"""


def daily_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.cells(particles(spark, sf_dir)).groupBy(F.floor(F.col("step") / 24).alias("day"), "ix", "iy").agg(F.count("*").alias("n"), F.sum("weight").alias("mass"))


def with_bandwidth(g: DataFrame) -> DataFrame:
    w = kernels.window_statistics(g, ("day",), "n", SHAPE, WINDOW)
    return g.join(w.select("day", "ix", "iy", kernels.bandwidth().alias("h")), ["day", "ix", "iy"])


@query(joined("particles", MASS + REFLECTED + " SELECT day, ix, iy, round(h, 8) AS h FROM h"))
def reflected_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bandwidth of each day's cells from the window around them, mirrored at the edges."""
    return with_bandwidth(daily_mass(spark, sf_dir)).select("day", "ix", "iy", r("h", 8, "h"))


@query(joined("particles", MASS + REFLECTED + OPEN + SPREAD + " SELECT day, coalesce(ix, -1) AS ix, coalesce(iy, -1) AS iy, round(sum(CASE WHEN ix IS NULL THEN mass ELSE mass * w / total END), 6) AS mass FROM t GROUP BY day, ix, iy"))
def adaptive_kernel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's mass spread by kernels of each cell's own bandwidth over open water; what is near to none is in cell -1, -1."""
    row = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    cells = spark.range(1).select(row(SHAPE[0]).alias("ix")).withColumn("iy", row(SHAPE[1]))
    free = cells.filter((F.col("ix") * 7 + F.col("iy") * 3) % 11 > 1)
    out = kernels.adaptive_kernel(with_bandwidth(daily_mass(spark, sf_dir)), ("day",), "mass", "h", free, BANDWIDTHS)
    cell = lambda c: F.coalesce(c, F.lit(-1).cast("bigint")).alias(c)
    return out.select("day", cell("ix"), cell("iy"), r("mass", 6, "mass"))


@query(joined("particles", MASS + ", l AS (SELECT unnest(range(0, 6)) AS lag), p AS (SELECT a.day, lag, sum(a.n * b.n) AS p FROM g a JOIN l ON true JOIN g b ON b.day = a.day AND b.ix = a.ix + lag AND b.iy = a.iy GROUP BY ALL), q AS (SELECT a.day, lag, sum(a.n * b.n) AS q FROM g a JOIN l ON true JOIN g b ON b.day = a.day AND b.ix = a.ix AND b.iy = a.iy + lag GROUP BY ALL), z AS (SELECT day, sum(n * n) AS z FROM g GROUP BY day) SELECT day, lag, round((coalesce(p, 0) / z + coalesce(q, 0) / z) / 2, 8) AS ac FROM p FULL JOIN q USING (day, lag) JOIN z USING (day)"))
def count_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of each day's counts up to five cells, the mean along rows and columns."""
    return kernels.autocorrelation(daily_mass(spark, sf_dir), ("day",), "n", 5).select("day", "lag", r("ac", 8, "ac"))


#: Shore nodes take this share of their depth, from rivers within reach.
SHARE, REACH = 0.05, 12.0
SHORE = f""", lim AS (SELECT node, x, y, {SHARE}e0 * value AS room FROM nodes WHERE node IN (SELECT unnest([u, v]) FROM edges WHERE cells = 1)),
rv AS (SELECT site_id AS river, site_id * 7 % 4800 / 100e0 AS x, site_id * 13 % 3700 / 100e0 AS y, 1e0 + site_id % 9 AS flow, 4e0 + site_id % 7 AS t FROM sites),
pr AS (SELECT river, node, sqrt(pow(rv.x - lim.x, 2) + pow(rv.y - lim.y, 2)) AS d, t FROM rv JOIN lim ON sqrt(pow(rv.x - lim.x, 2) + pow(rv.y - lim.y, 2)) <= {REACH}e0),
z AS (SELECT 0 AS k, 'r' AS kind, river AS id, flow, flow * t AS heat, 0e0 AS room FROM rv UNION ALL SELECT 0, 'n', node, 0, 0, room FROM lim UNION ALL (
  WITH a AS (SELECT river, node, d, t, r.flow AS rest, n.room FROM pr JOIN z r ON r.kind = 'r' AND r.id = river JOIN z n ON n.kind = 'n' AND n.id = node WHERE r.flow > 1e-9 AND n.room > 1e-9),
  o AS (SELECT *, least(rest - coalesce(sum(room) OVER (PARTITION BY river ORDER BY d, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), room) AS offer FROM a),
  s AS (SELECT river, node, t, offer * least(1, room / sum(offer) OVER (PARTITION BY node)) AS taken FROM o WHERE offer > 0),
  c AS (SELECT 'r' AS kind, river AS id, -sum(taken) AS flow, -sum(taken * t) AS heat, 0e0 AS room FROM s GROUP BY river UNION ALL SELECT 'n', node, sum(taken), sum(taken * t), -sum(taken) FROM s GROUP BY node)
  SELECT k + 1, z.kind, z.id, z.flow + coalesce(c.flow, 0), z.heat + coalesce(c.heat, 0), z.room + coalesce(c.room, 0) FROM z LEFT JOIN c ON c.kind = z.kind AND c.id = z.id WHERE EXISTS (SELECT 1 FROM s))),
e AS (SELECT kind, id, arg_max(flow, k) AS flow, arg_max(heat, k) AS heat FROM z GROUP BY kind, id)"""


@query(joined("bathymetry sites", MESH + SHORE + " SELECT id AS node, round(flow, 6) AS flow, round(heat / flow, 5) AS temperature FROM e WHERE kind = 'n' AND flow > 0 UNION ALL SELECT -1, round(sum(flow), 6), round(sum(heat) / sum(flow), 5) FROM e WHERE kind = 'r' AND flow > 1e-9 HAVING sum(flow) IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1))
def rivers_to_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rivers on the shore nodes of the mesh, none with more than its depth allows."""
    nodes, cells = lattice(spark, sf_dir)
    shore = nodes.join(mesh.boundary_nodes(cells).select("node"), "node", "left_semi").select("node", "x", "y", (SHARE * F.col("value")).alias("limit"))
    k = F.col("site_id")
    rivers = sites(spark, sf_dir).select(k.alias("river"), (k * 7 % 4800 / 100.0).alias("x"), (k * 13 % 3700 / 100.0).alias("y"), (1.0 + k % 9).alias("flow"), (4.0 + k % 7).alias("temperature"))
    return coast.rivers_to_nodes(rivers, kept(shore, "shore"), REACH).select("node", r("flow", 6, "flow"), r("temperature", 5, "temperature"))


@query(joined("bathymetry", MESH + """, ob AS (SELECT x AS x2, y AS y2 FROM nodes WHERE y = 1 OR x = 0), d AS (SELECT node, min(sqrt(pow(x - x2, 2) + pow(y - y2, 2))) AS d FROM nodes, ob GROUP BY node), n AS (SELECT * FROM d WHERE d <= 9),
e AS (SELECT max(d) FILTER (d <= 3) AS one, max(d) FILTER (d > 3) AS nil FROM n), w AS (SELECT node, CASE WHEN d <= 3 THEN 1e0 ELSE (d - nil) / (one - nil) END AS w FROM n, e),
c AS (SELECT CAST(ix / 3 AS BIGINT) AS cx, CAST(iy / 3 AS BIGINT) AS cy, depth * 2 AS coarse FROM bathymetry WHERE ix % 3 = 0 AND iy % 3 = 0), o AS (SELECT unnest([0, 1]) AS i), o2 AS (SELECT unnest([0, 1]) AS j),
p AS (SELECT node, CAST(floor(x / 3) AS BIGINT) + i AS cx, CAST(floor(y / 3) AS BIGINT) + j AS cy, (CASE i WHEN 1 THEN x / 3 - floor(x / 3) ELSE 1 - (x / 3 - floor(x / 3)) END) * (CASE j WHEN 1 THEN y / 3 - floor(y / 3) ELSE 1 - (y / 3 - floor(y / 3)) END) AS s FROM nodes, o, o2),
h AS (SELECT node, sum(s * coarse) / sum(s) AS coarse FROM p JOIN c USING (cx, cy) WHERE s > 0 GROUP BY node)
SELECT node, round(CASE WHEN coarse IS NULL OR w IS NULL THEN value ELSE coarse * w + value * (1 - w) END, 6) AS depth FROM nodes LEFT JOIN w USING (node) LEFT JOIN h USING (node)"""))
def blended_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of the mesh with those of a coarse grid along the open boundary."""
    nodes, _ = lattice(spark, sf_dir)
    open_ = nodes.filter("y = 1 or x = 0").select(F.col("x").alias("x2"), F.col("y").alias("y2"))
    coarse = bathymetry(spark, sf_dir).filter("ix % 3 = 0 and iy % 3 = 0").select((F.col("ix") / 3).cast("bigint").alias("ix"), (F.col("iy") / 3).cast("bigint").alias("iy"), (F.col("depth") * 2).alias("value"))
    return coast.blended_depths(nodes, open_, coarse, 3.0, 1.5).select("node", r("value", 6, "depth"))


RUN = Run("2024-01-01 00:00:00", 60, 26, "LIFE-RAFT-DB-10", (("2024-01-01 00:00:00", 12.5, 68.5, 1.0),) * 2)


@query(with_views("particles", "SELECT step, event_id AS id, round(CAST(lon AS FLOAT)::DOUBLE, 4) AS lon, round(CAST(lat AS FLOAT)::DOUBLE, 4) AS lat, CASE status WHEN 0 THEN 11 ELSE 41 END AS state, (step - min(step) OVER (PARTITION BY traj_id)) * 60 AS age, CAST(event_id % 2 AS INT) AS orientation FROM particles"))
def drift_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles written to the text form of drift runs and read back."""
    first = Window.partitionBy("traj_id")
    p = particles(spark, sf_dir).select("step", F.col("event_id").alias("id"), "lon", "lat", "status", ((F.col("step") - F.min("step").over(first)) * 60).alias("age"), (F.col("event_id") % 2).cast("int").alias("orientation"))
    return read_drift(spark, write_drift(p, RUN)).select("step", "id", r("lon", 4, "lon"), r("lat", 4, "lat"), "state", "age", "orientation")
