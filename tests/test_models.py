"""Potentials, slope limiter and other operators of models against plain Python."""

import datetime
import math
import pathlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plume.operators import coast, curvilinear, harmonics, joins, kernels, potential
from plume.sources import drift_text
from plume.streaming import steps


def graph(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, d double")


def test_potentials_of_a_long_chain_and_of_many_roots(spark):
    """Differences of known values come back, whatever the tree; a component has its least node as root."""
    r = random.Random(3)
    value = [r.uniform(-5, 5) for _ in range(400)]
    chain = list(range(120))
    r.shuffle(chain)
    pairs = {tuple(sorted(p)) for p in zip(chain, chain[1:])}
    pairs |= {tuple(sorted(r.sample(range(150, 300), 2))) for _ in range(260)}  # loops and local minima
    pairs |= {(390, 399), (391, 399)}
    got = {x.node: x for x in potential.potentials(graph(spark, [(u, v, value[v] - value[u]) for u, v in sorted(pairs)])).collect()}
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    assert set(got) == set(near)
    for node in near:
        todo, reached = [node], {node}
        while todo:
            new = near[todo.pop()] - reached
            reached |= new
            todo.extend(new)
        assert got[node].root == min(reached)
        assert got[node].p == pytest.approx(value[node] - value[min(reached)], abs=1e-9)
    assert potential.potentials(graph(spark, [])).count() == 0


def square_mesh(spark, n, depth):
    nodes = spark.createDataFrame([(i * n + j, float(j), float(i), float(depth(i, j))) for i in range(n) for j in range(n)], "node long, x double, y double, value double")
    cells = [(2 * (i * n + j) + k, i * n + j, *((i * n + j + 1, i * n + j + n + 1) if k == 0 else (i * n + j + n + 1, i * n + j + n))) for i in range(n - 1) for j in range(n - 1) for k in (0, 1)]
    return nodes, spark.createDataFrame(cells, "cell long, a long, b long, c long")


def test_stream_function_of_even_flow(spark):
    """psi = vx y - vy x, and no residual around any cell."""
    nodes, cells = square_mesh(spark, 9, lambda i, j: 10)
    flow = cells.select("cell", F.lit(0.3).alias("vx"), F.lit(-0.2).alias("vy"))
    at = {x.node: (x.x, x.y) for x in nodes.collect()}
    for x in potential.stream_function(nodes, cells, flow).collect():
        assert x.root == 0 and x.p == pytest.approx(0.3 * at[x.node][1] + 0.2 * at[x.node][0], abs=1e-12)
    assert max(abs(x.residual) for x in potential.loop_residuals(nodes, cells, flow).collect()) < 1e-12


def test_slopes_end_below_the_bound_with_the_volume_kept(spark):
    r = random.Random(5)
    nodes, cells = square_mesh(spark, 7, lambda i, j: r.choice([10, 10, 40, 90, 200]))
    out = {x.node: x.value for x in potential.limited_slopes(nodes, cells, 0.3).collect()}
    steep = [abs(out[p] - out[q]) / (out[p] + out[q]) for x in cells.collect() for p, q in ((x.a, x.b), (x.b, x.c), (x.c, x.a))]
    assert max(steep) <= 0.3 + 1e-8 and min(out.values()) > 0
    assert sum(out.values()) == pytest.approx(sum(x.value for x in nodes.collect()), rel=1e-12)
    gentle, same = square_mesh(spark, 4, lambda i, j: 50 + i + j)
    assert sorted(potential.limited_slopes(gentle, same, 0.3).collect()) == sorted(gentle.collect())


def test_tides_come_back_and_gaps_are_filled(spark):
    names = ["M2", "S2", "K1"]
    r = random.Random(1)
    true = {"M2": (1.5, 40.0), "S2": (0.4, 300.0), "K1": (0.2, 123.0)}
    level = lambda t: 3 + sum(a * math.cos(math.radians(harmonics.SPEEDS[n] * t - p)) for n, (a, p) in true.items())
    hours = sorted({r.randrange(0, 24 * 40) for _ in range(500)})
    rows = [(1, float(t), level(t)) for t in hours] + [(2, 1.0, 5.0), (2, 2.0, None), (3, None, 1.0)]
    series = spark.createDataFrame(rows, "place long, hour double, level double")
    fit = harmonics.constituents(series, "place", F.col("hour"), F.col("level"), names)
    got = fit.select("place", "n", "x0", *[c for k in range(3) for c in (harmonics.amplitude(k).alias(f"a{k}"), harmonics.phase(k).alias(f"p{k}"))]).collect()
    one, two = (next(x for x in got if x.place == k) for k in (1, 2))
    assert one.n == len(hours) and one.x0 == pytest.approx(3, abs=1e-9)
    for k, n in enumerate(names):
        assert (one[f"a{k}"], one[f"p{k}"]) == pytest.approx(true[n], abs=1e-6)
    assert two.n == 1 and two.a1 is None and len(got) == 2
    wanted = spark.createDataFrame([(1, float(t)) for t in range(0, 100)] + [(2, 1.0), (2, 7.0)], "place long, hour double")
    out = {(x.place, x.hour): x for x in harmonics.filled(series, wanted, "place", "hour", "level", names).collect()}
    assert all(out[1, t].level == pytest.approx(level(t), abs=1e-7) and out[1, t].filled == (t not in hours) for t in range(100))
    assert out[2, 1.0].level == 5.0 and out[2, 7.0].level is None


def test_normal_sums_of_parts_add_up(spark):
    series = spark.createDataFrame([(1, float(t), math.sin(t)) for t in range(60)], "place long, hour double, level double")
    both = lambda f: harmonics.normal_sums(series.filter(f), "place", F.col("hour"), F.col("level"), ["M2"]).drop("place")
    whole, parts = both("true").first(), [both("hour < 20").first(), both("hour >= 20").first()]
    assert all(whole[c] == pytest.approx(parts[0][c] + parts[1][c], abs=1e-9) for c in whole.asDict())


def curved(i, j):
    return 10 + i + 0.3 * math.sin(0.6 * j), 5 + 0.7 * j + 0.2 * math.cos(0.5 * i) + 0.1 * i


def test_places_on_a_curvilinear_grid_are_found_again(spark):
    r = random.Random(2)
    grid = spark.createDataFrame([(i, j, *curved(i, j), 2.0 * i - 3.0 * j) for i in range(12) for j in range(9) if (i, j) != (5, 5)], "ix long, iy long, x double, y double, depth double")
    points, want = [], {}
    for k in range(500):
        i, j, s, t = r.randrange(11), r.randrange(8), r.random(), r.random()
        corners = [curved(i, j), curved(i + 1, j), curved(i + 1, j + 1), curved(i, j + 1)]
        w = [(1 - s) * (1 - t), s * (1 - t), s * t, (1 - s) * t]
        points.append((k, *[sum(a * c[m] for a, c in zip(w, corners)) for m in (0, 1)]))
        if not (4 <= i <= 5 and 4 <= j <= 5):
            want[k] = (i + s, j + t)
    points += [(900, *curved(3, 3)), (901, -50.0, 0.0), (902, None, 1.0)]
    df = spark.createDataFrame(points, "k long, px double, py double")
    got = {x.k: (x.x, x.y) for x in curvilinear.position_to_index(df, grid, "k", 1.0).collect()}
    assert got.pop(900) == pytest.approx((3, 3), abs=1e-6)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    at = curvilinear.located(df, grid, "k", 1.0, ("depth",))
    weights = curvilinear.corner_weights(F.col("s"), F.col("t"))
    for x in at.select("k", sum((c * F.col(f"depth{k}") for k, c in enumerate(weights)), F.lit(0.0)).alias("depth"), sum(weights, F.lit(0.0)).alias("one")).collect():
        assert x.one == pytest.approx(1)
        if x.k in want:
            assert x.depth == pytest.approx(2 * want[x.k][0] - 3 * want[x.k][1], abs=1e-5)


def test_cubics_are_exact_and_holes_leave_their_weight(spark):
    value = lambda x, y: 1 + 2 * x - y + 0.3 * x**3 - 0.1 * x * x * y**3
    field = spark.createDataFrame([(i, j, value(i, j)) for i in range(9) for j in range(9)], "ix long, iy long, v double")
    r = random.Random(4)
    rows = [(k, r.uniform(1, 7), r.uniform(1, 7)) for k in range(200)] + [(300, 3.0, 4.0)]
    points = spark.createDataFrame(rows, "k long, x double, y double")
    got = {x.k: x.v for x in curvilinear.cubic(points, field, "v", "k").collect()}
    assert all(got[k] == pytest.approx(value(x, y), rel=1e-9) for k, x, y in rows)
    even = field.withColumn("v", F.when((F.col("ix") + F.col("iy") * 3) % 7 > 0, 5.0))
    assert {x.k: x.v for x in curvilinear.cubic(points, even, "v", "k").collect()}[0] == pytest.approx(5)
    assert all(x.v is None for x in curvilinear.cubic(points, field.filter("ix > 100"), "v", "k").collect())


def test_four_way_interpolation_is_exact_where_the_field_is_linear(spark):
    """Levels follow the ground, so the same level is at another depth in each column."""
    value = lambda x, y, z, t: 1 + 0.5 * x - 0.25 * y + 0.1 * z + 2 * t
    ground = lambda i, j: 40 + 7 * i + 3 * j
    columns = []
    for i in range(5):
        for j in range(5):
            for slot in range(4):
                depths = [ground(i, j) * (k + 0.5) / 8 for k in range(8)]
                columns.append((i, j, slot, depths, [value(i, j, z, slot * 6.0) for z in depths]))
    c = spark.createDataFrame(columns, "ix long, iy long, slot long, depths array<double>, v array<double>")
    r = random.Random(6)
    rows = [(k, r.uniform(0, 4), r.uniform(0, 4), r.uniform(5, 35), r.uniform(0, 18)) for k in range(100)]
    p = spark.createDataFrame([*rows, (200, 50.0, 1.0, 5.0, 1.0)], "k long, x double, y double, z double, t double")
    got = {x.k: x.v for x in curvilinear.four_way(p, c, "k", ("v",), 6.0).collect()}
    assert set(got) == {k for k, *_ in rows}
    assert all(got[k] == pytest.approx(value(*place), rel=1e-9) for k, *place in rows)
    held = spark.createDataFrame([(1, 0.0, 0.0, 1e4, 0.0), (2, 0.0, 0.0, 0.0, 0.0)], "k long, x double, y double, z double, t double")
    assert {x.k: x.v for x in curvilinear.four_way(held, c, "k", ("v",), 6.0).collect()} == {1: pytest.approx(value(0, 0, 37.5, 0)), 2: pytest.approx(value(0, 0, 2.5, 0))}


class Handle:
    """State and timers of one particle, in plain Python."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_state_of_a_particle_goes_after_the_gap():
    handle, own = Handle(), steps.Displacement(gap=10, origin=0)
    own.init(handle)
    give = lambda *rows: [tuple(None if v != v else v for v in r) for f in own.handleInputRows((7,), iter([pd.DataFrame([r], columns=["step", "z"]) for r in rows]), None) for r in f.itertuples(index=False)]
    assert give((3, 1.0), (1, 5.0)) == [(7, 1, None, "activated"), (7, 3, -4.0, "continuing")]
    assert handle.timers == {13 * 3_600_000} and handle.value == (3, 1.0)
    assert give((2, 9.0), (4, 2.0)) == [(7, 4, 1.0, "continuing")]  # step 2 is late
    expired = type("Info", (), {"getExpiryTimeInMs": lambda self: 14 * 3_600_000})()
    assert [r for f in own.handleExpiredTimer((7,), None, expired) for r in f.itertuples(index=False, name=None)][0][1] == 14
    assert handle.value is None
    assert give((20, 1.0), (40, 3.0)) == [(7, 20, None, "activated"), (7, 30, None, "lost"), (7, 40, None, "activated")]


def places(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} double, {names[2]} double")


def great_circle(a, b):
    (lon, lat), (lon2, lat2) = a, b
    h = math.sin(math.radians(lat - lat2) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon - lon2) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_pairs_across_the_antimeridian_and_the_pole(spark):
    left = places(spark, [(1, 179.99, 10.0), (2, -179.995, -60.0), (3, 0.0, 89.97), (4, 179.999, 0.0), (5, 359.995, 45.0)], ("a", "lon", "lat"))
    right = places(spark, [(1, -179.99, 10.0), (2, 179.99, -60.0), (3, 180.0, 89.96), (4, -179.95, 0.0), (5, 0.01, 45.0), (6, 170.0, 10.0)], ("b", "lon2", "lat2"))
    got = {(r.a, r.b): r.distance for r in joins.radius_join(left, right, 10_000.0).collect()}
    assert set(got) == {(k, k) for k in range(1, 6)}
    for k, (p, q) in enumerate([((179.99, 10), (-179.99, 10)), ((-179.995, -60), (179.99, -60)), ((0, 89.97), (180, 89.96)), ((179.999, 0), (-179.95, 0)), ((-0.005, 45), (0.01, 45))], 1):
        assert got[k, k] == pytest.approx(great_circle(p, q), rel=1e-3)
    near = {r.a: (r.b, r.distance) for r in joins.nearest(left, right, "a", "b", 500.0).collect()}
    assert {a: b for a, (b, _) in near.items()} == {k: k for k in range(1, 6)}


def test_pairs_on_the_whole_sphere_against_all_pairs(spark):
    r = random.Random(12)
    spot = lambda: (r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1))))
    a, b = [(k, *spot()) for k in range(300)], [(k, *spot()) for k in range(300)]
    left, right = places(spark, a, ("a", "lon", "lat")), places(spark, b, ("b", "lon2", "lat2"))
    got = {(x.a, x.b): x.distance for x in joins.radius_join(left, right, 400_000.0).collect()}
    near = lambda p, q: great_circle(p[1:], q[1:])
    # the plane and the great circle differ a little, so pairs near the radius are left open
    assert {(p[0], q[0]) for p in a for q in b if near(p, q) < 390_000 and max(abs(p[2]), abs(q[2])) < 80} <= set(got)
    assert all(near(a[i], b[j]) < 440_000 for i, j in got)
    best = {x.a: x.distance for x in joins.nearest(left, right, "a", "b", 100_000.0).collect()}
    assert set(best) == set(range(300))
    assert all(near(p, min(b, key=lambda q: near(p, q))) == pytest.approx(best[p[0]], rel=0.1) for p in a if abs(p[2]) < 75)
    assert joins.nearest(left, right.limit(0), "a", "b", 1000.0).count() == 0


def test_brackets_of_times_in_many_slots(spark):
    """Rows at, between, before and after times that are dense in some slots and missing in others."""
    r = random.Random(7)
    times = sorted({r.randrange(0, 200) for _ in range(60)} | {5000, 90_000})
    asked = list(range(-5, 210)) + [4999, 5000, 5001, 89_999, 90_000, 100_000]
    right = spark.createDataFrame([(t, t * 2.0) for t in times], "t long, v double")
    out = joins.asof_bracket(spark.createDataFrame([(t,) for t in asked], "t long"), right, "t", ["v"], slots=50).collect()
    assert sorted(x.t for x in out) == sorted(asked)
    for x in out:
        before, after = [t for t in times if t <= x.t], [t for t in times if t >= x.t]
        assert (x.t_before, x.t_after) == (before[-1] if before else None, after[0] if after else None)
        assert x.v_before == (None if not before else before[-1] * 2.0)


def test_rivers_keep_their_flow_and_no_node_takes_too_much(spark):
    r = random.Random(9)
    nodes = [(k, float(k), r.uniform(-0.2, 0.2), r.uniform(0.5, 2.0)) for k in range(60)]
    rivers = [(k, r.uniform(20, 26), r.uniform(-2, 2), r.uniform(1, 6), r.uniform(2, 12)) for k in range(12)] + [(50, 500.0, 0.0, 7.0, 4.0)]
    got = coast.rivers_to_nodes(spark.createDataFrame(rivers, "river long, x double, y double, flow double, temperature double"), spark.createDataFrame(nodes, "node long, x double, y double, limit double"), 30.0).collect()
    limit = {k: m for k, _, _, m in nodes} | {-1: 7.0}
    assert all(x.flow <= limit[x.node] + 1e-9 for x in got)
    assert next(x for x in got if x.node == -1).flow == pytest.approx(7)  # out of reach
    assert sum(x.flow for x in got) == pytest.approx(sum(f for *_, f, _ in rivers))
    assert sum(x.flow * x.temperature for x in got) == pytest.approx(sum(f * t for *_, f, t in rivers))
    full = [x.node for x in got if x.node >= 0 and x.flow > limit[x.node] - 1e-6]
    assert full and set(range(min(full), max(full) + 1)) <= {x.node for x in got}  # nearest nodes first, no gaps
    one = coast.rivers_to_nodes(spark.createDataFrame([(1, 0.4, 0.0, 0.1, 5.0)], "river long, x double, y double, flow double, temperature double"), spark.createDataFrame(nodes, "node long, x double, y double, limit double"), 5.0).collect()
    assert [(x.node, x.flow, x.temperature) for x in one] == [(0, pytest.approx(0.1), pytest.approx(5))]


def test_depths_are_the_coarse_ones_at_the_boundary_and_their_own_far_away(spark):
    nodes = spark.createDataFrame([(k, float(k), 0.0, 10.0) for k in range(20)], "node long, x double, y double, value double")
    coarse = spark.createDataFrame([(k, 0, 40.0) for k in range(6)], "ix long, iy long, value double")
    boundary = spark.createDataFrame([(0.0, 0.0)], "x2 double, y2 double")
    got = {x.node: x.value for x in coast.blended_depths(nodes, boundary, coarse, 4.0, 1.5).collect()}
    assert [got[k] for k in range(4)] == [40.0] * 4 and all(got[k] == 10 for k in range(9, 20))
    assert all(got[k] == pytest.approx(10 + 30 * (9 - k) / 6) for k in range(3, 10))


def test_adaptive_kernels_keep_mass_on_allowed_cells(spark):
    r = random.Random(4)
    rows = [(k % 2, x, y, r.uniform(1, 5), r.choice([0.0, 0.3, 1.0, 2.0, 9.0])) for k, (x, y) in enumerate((x, y) for x in range(8) for y in range(8))]
    grid = spark.createDataFrame([*rows, (0, 100, 100, 3.0, 1.0)], "day long, ix long, iy long, mass double, h double")
    allowed = spark.createDataFrame([(x, y) for x in range(8) for y in range(8) if (x + y) % 3], "ix long, iy long")
    out = kernels.adaptive_kernel(grid, ("day",), "mass", "h", allowed, [0.0, 0.5, 1.0, 2.0]).collect()
    assert all((x.ix + x.iy) % 3 for x in out if x.ix is not None)
    for day in (0, 1):
        assert sum(x.mass for x in out if x.day == day) == pytest.approx(sum(m for d, _, _, m, _ in rows if d == day) + 3 * (day == 0), rel=1e-12)
    # cells that aren't allowed and have no bandwidth are near to none
    alone = sum(m for d, x, y, m, h in rows if d == 0 and h == 0 and (x + y) % 3 == 0) + 3
    assert next(x.mass for x in out if x.day == 0 and x.ix is None) == pytest.approx(alone)


def test_window_statistics_on_a_reflected_edge(spark):
    r = random.Random(2)
    n = [[r.randrange(1, 9) for _ in range(6)] for _ in range(7)]
    grid = spark.createDataFrame([(1, x, y, n[x][y]) for x in range(7) for y in range(6)], "day long, ix long, iy long, n long")
    fold = lambda k, size: -k if k < 0 else 2 * (size - 1) - k if k >= size else k
    for x in kernels.window_statistics(grid, ("day",), "n", (7, 6), 2).collect():
        window = [(n[fold(x.ix + dx, 7)][fold(x.iy + dy, 6)], dx * dx + dy * dy) for dx in range(-2, 3) for dy in range(-2, 3)]
        assert (x.s, x.ss, x.d2) == (sum(a for a, _ in window), sum(a * a for a, _ in window), sum(a * d for a, d in window))
    ac = {x.lag: x.ac for x in kernels.autocorrelation(grid, ("day",), "n", 2).collect()}
    whole = sum(v * v for row in n for v in row)
    assert ac[0] == 1 and ac[1] == pytest.approx((sum(n[x][y] * n[x + 1][y] for x in range(6) for y in range(6)) + sum(n[x][y] * n[x][y + 1] for x in range(7) for y in range(5))) / 2 / whole)


def drift_lines(rows, run, steps):
    """The whole text, line by line in plain Python."""
    out = [drift_text.header(run, steps, len({i for _, i, *_ in rows}))]
    before = 0
    for step in range(steps):
        own = sorted((r for r in rows if r[0] == step), key=lambda r: r[1])
        active = [r for r in own if r[4] == 0 and r[2] is not None]
        mean = lambda k: f"{sum(r[k] for r in active) / len(active):.6f}" if active else "nan"  # noqa: E731, B023
        at = datetime.datetime(2016, 2, 2, 12) + datetime.timedelta(minutes=30 * step)
        out += ["", "# Date [UTC]:", "nowDate   nowTime", at.strftime("%Y-%m-%d\t%H:%M:%S"), "# Time passed [min] & [timesteps], now seeded, seeded so far:", "timePassed  nStep   nowSeeded   nSeeded", f"  {30 * step}\t{step + 1}\t{len(own) - before}\t{len(own)}"]
        out += ["# Mean position:", "meanLon meanLat", f"{mean(2)}\t{mean(3)}", "# Particle data:", "id  lon lat state   age orientation"]
        out += [f"{i}\t{lon if lon is not None else 0.0}\t{lat if lon is not None else 0.0}\t{41 if lon is None or status else 11}\t{age}\t{turn if lon is not None else 0}" for _, i, lon, lat, status, age, turn in own]
        before = len(own)
    return "\n".join(out) + "\n"


def test_drift_text_byte_for_byte_and_back(spark):
    r = random.Random(8)
    number = lambda low: low + r.randrange(192) / 64  # noqa: E731  sums of these are exact in any order
    short = lambda v: float(str(np.float32(v)))
    rows = [(step, i, short(number(4)), short(number(60)), int(r.random() < 0.2), 30 * step, i % 2) for step in range(12) if step != 5 for i in range(1, 40) if i <= 10 + 4 * step]
    rows += [(7, 500, None, None, 0, 210, 1)]
    run = drift_text.Run("2016-02-02 12:00:00", 30, 26, "LIFE-RAFT-DB-10", (("2016-02-02 12:00:00", 4.5, 60.0, 1.0), ("2016-02-02 14:00:00", 4.5, 60.0, 2.0)), 120)
    df = spark.createDataFrame(rows, "step long, id long, lon double, lat double, status int, age long, orientation int")
    text = lambda path: b"".join(f.read_bytes() for f in sorted(pathlib.Path(path.removeprefix("file:")).glob("part-*")))
    path = drift_text.write_drift(df.repartition(5), run, files=6)
    assert text(path).decode() == drift_lines(rows, run, 12)
    assert len(list(pathlib.Path(path.removeprefix("file:")).glob("part-*"))) > 1
    back = drift_text.read_drift(spark, path)
    assert sorted(tuple(x) for x in back.collect()) == sorted((s, i, lon or 0.0, lat or 0.0, 41 if lon is None or status else 11, age, turn if lon else 0) for s, i, lon, lat, status, age, turn in rows)
    again = back.filter("id < 500").withColumn("status", (F.col("state") == 41).cast("int")).unionByName(df.filter("id = 500").withColumn("state", F.lit(0)))
    assert text(drift_text.write_drift(again, run)) == text(path)
    assert drift_text.read_drift(spark, drift_text.write_drift(df.limit(0), run)).count() == 0
