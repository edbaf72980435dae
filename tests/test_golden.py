"""Published values of the parameterisations and geodesics."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from plume.functions import biology, geo, physics, weathering
from plume.operators import joins, mesh, rules, seeding, stencil, trajectory, vertical
from plume.sources import stores
from plume.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_a_degree_of_the_equator(spark):
    d = geo.geodesic_inverse(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    assert one(spark, d)["distance"] == pytest.approx(111319.5, abs=0.1)
    assert one(spark, d)["azimuth"] == pytest.approx(90.0)


def test_equal_points_are_apart_by_nothing(spark):
    p = [F.lit(14.3), F.lit(68.9)]
    assert one(spark, geo.geodesic_inverse(*p, *p))["distance"] == pytest.approx(0.0, abs=1e-6)


def test_forward_returns_what_inverse_measures(spark):
    there = one(spark, geo.geodesic_forward(F.lit(14.0), F.lit(68.0), F.lit(37.0), F.lit(25000.0)))
    back = one(spark, geo.geodesic_inverse(F.lit(14.0), F.lit(68.0), F.lit(there["lon"]), F.lit(there["lat"])))
    assert back["distance"] == pytest.approx(25000.0, abs=1e-3)
    assert back["azimuth"] == pytest.approx(37.0, abs=1e-6)


def test_utm_on_the_central_meridian(spark):
    east, north = geo.utm_forward(F.lit(15.0), F.lit(45.0))
    assert one(spark, east) == pytest.approx(500000.0, abs=1e-3)
    assert one(spark, north) == pytest.approx(4982950.400, abs=1e-2)


def test_track_scores(spark):
    rows = [(1, k, float(k), 0.0, float(k), lat / 111) for k, lat in enumerate((0, 1.2, -3.4, 6.3, 4.2, 0))]
    pairs = spark.createDataFrame(rows, "traj_id int, step int, lon double, lat double, lon2 double, lat2 double")
    assert trajectory.darpa(pairs).first()["points"] == 145
    assert trajectory.liu_weisberg(pairs).first()["skill"] == pytest.approx(0.99099, abs=1e-5)


def test_diffusivities_over_wind_and_depth(spark):
    df = spark.range(4).select((F.col("id") * 5.0).alias("w")).crossJoin(spark.range(16).select((F.col("id") * 5.0).alias("d")))
    out = df.select(physics.diffusivity_sundby(F.col("w"), F.col("d")).alias("s"), physics.diffusivity_large(F.col("w"), F.col("d")).alias("l"))
    s0, s1, l0, l1 = out.agg(F.min("s"), F.max("s"), F.min("l"), F.max("l")).first()
    assert (s1, l1) == (pytest.approx(0.0585, abs=1e-4), pytest.approx(0.2017, abs=1e-4))
    assert s0 == l0 == 0


def test_rates_between_rates():
    assert len(physics.rate_ladder((2e-8, 0.18e-6, 3.6e-7, 0.98e-6, 1.8e-6))) == 9


def test_profiles(spark):
    values = F.array(*[F.lit(float(k)) for k in range(4)])
    assert [one(spark, vertical.nearest_at(values, F.lit(z))) for z in (0.5, 1.5, 2.6)] == [0, 2, 3]
    assert one(spark, vertical.linear_at(values, F.lit(9.0))) == 3
    assert one(spark, vertical.z_average(values, F.lit(0.0), F.lit(3.0))) == pytest.approx(1.5)


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), batch.schema)
    q = windows.tumbling_mass(stream, late="40 days").writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = windows.tumbling_mass(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(spark.table("tumbling").collect()) == sorted(want.collect())


def streamed(spark, tmp_path, parts, window, name, mode, late):
    """The result of ``window`` over files that arrive one after another."""
    spark.createDataFrame(parts[0], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    q = window(stream, late=late).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    for part in parts[1:]:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(hour, user=1, value=1.0, day=1):
    return (0, datetime.datetime(2024, 1, day) + datetime.timedelta(hours=hour), user, "click", value)


def test_sliding_stream_equals_batch(spark, tmp_path):
    rows = [at(h * 0.7, h % 3, float(h)) for h in range(60)]
    got = streamed(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], windows.sliding_mass, "sliding", "complete", "6 hours")
    assert sorted(got.collect()) == sorted(windows.sliding_mass(spark.createDataFrame(rows, SCHEMA)).collect())


def test_sessions_end_after_their_gap(spark, tmp_path):
    rows = [at(h, u) for u in (1, 2) for h in (0, 1, 5, 12, 13)] + [at(0, 3, day=9)]
    got = streamed(spark, tmp_path, [rows, [at(1, 3, day=9)]], windows.sessions, "sessions", "append", "1 hour")
    ended = [r for r in windows.sessions(spark.createDataFrame(rows, SCHEMA)).collect() if r.user_id < 3]
    assert sorted(got.collect()) == sorted(ended) and len(ended) == 4


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    parts = [[at(0.5)], [at(20)], [at(0.6, value=100.0), at(19.5, value=5.0)], [at(40)]]
    got = streamed(spark, tmp_path, parts, windows.tumbling_mass, "late", "append", "2 hours")
    assert {r.start.hour: r.mass for r in got.collect()} == {0: 1.0, 19: 5.0, 20: 1.0}


def test_as_of_joins_at_ends_and_on_times(spark):
    right = spark.createDataFrame([(10, 1.0), (20, 2.0), (50_000, 3.0)], "sec long, v double")
    left = spark.createDataFrame([(k, t) for k, t in enumerate((5, 10, 14, 15, 20, 25_010, 50_000, 60_000))], "id int, sec long")
    got = {r.id: (r.sec_before, r.sec_after) for r in joins.asof_bracket(left, right, "sec", ["v"]).collect()}
    assert got == {0: (None, 10), 1: (10, 10), 2: (10, 20), 3: (10, 20), 4: (20, 20), 5: (20, 50_000), 6: (50_000, 50_000), 7: (50_000, None)}
    near = {r.id: r.v for r in joins.asof_nearest(left, right, "sec", ["v"]).collect()}
    assert near == {0: 1.0, 1: 1.0, 2: 1.0, 3: 2.0, 4: 2.0, 5: 3.0, 6: 3.0, 7: 3.0}
    assert joins.asof_bracket(left, right.limit(0), "sec", ["v"]).filter("sec_before is null and sec_after is null").count() == 8
    assert joins.asof_bracket(left.limit(0), right, "sec", ["v"]).count() == 0


def test_nearest_has_no_limit(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 80.0), (3, -10.0, 5.0)], "id int, lon double, lat double")
    right = spark.createDataFrame([(7, 0.1, 0.1), (8, 1.0, 0.0)], "site int, lon2 double, lat2 double")
    assert {r.id: r.site for r in joins.nearest(left, right, "id", "site", 10_000.0).collect()} == {1: 7, 2: 8, 3: 7}
    assert joins.nearest(left, right.limit(0), "id", "site", 10_000.0).count() == 0


def test_a_radius_is_true_at_any_latitude(spark):
    for lat in (0.0, 45.0, 69.0, -69.0, 85.0):
        a = spark.createDataFrame([(1, 10.0, lat)], "id int, lon double, lat double")
        step = 9_000 / geo.A
        b = spark.createDataFrame([(k, 10.0 + k * math.degrees(step) / math.cos(math.radians(lat)), lat) for k in range(-3, 4)], "site int, lon2 double, lat2 double")
        assert sorted(r.site for r in joins.radius_join(a, b, 10_000.0).collect()) == [-1, 0, 1]


def test_utm_and_back(spark):
    east, north = geo.utm_forward(F.lit(14.3), F.lit(68.9))
    lon, lat = geo.utm_inverse(east, north)
    assert one(spark, lon) == pytest.approx(14.3, abs=1e-8) and one(spark, lat) == pytest.approx(68.9, abs=1e-8)


def test_corrections(spark):
    assert one(spark, weathering.arrhenius(F.lit(25.0), 25, 5e4)) == pytest.approx(1.0)
    assert one(spark, weathering.doubling_per_ten_degrees(F.lit(30.0), 20)) == pytest.approx(2.0)
    assert one(spark, weathering.neutral_share(F.lit(4.5), 4.5)) == pytest.approx(0.5)
    assert one(spark, weathering.degraded(F.lit(8.0), 1.0, F.lit(1.0), 3600)) == pytest.approx(4.0)
    assert [one(spark, weathering.ice_share(F.lit(a))) for a in (0.1, 0.3, 0.55, 0.9)] == pytest.approx([0, 0, 0.5, 1])
    assert one(spark, weathering.vapour_pressure(F.lit(400.0), 400.0)) == pytest.approx(101325.0)
    assert one(spark, biology.development_days(F.lit(3.65 / 0.145))) == pytest.approx(1.0)


def test_mass_transport_by_wind(spark):
    assert one(spark, weathering.mass_transport(F.lit(10.0))) == pytest.approx(0.06 * 0.0025 * 100)
    assert one(spark, weathering.mass_transport(F.lit(1.0))) == pytest.approx(0.0025)


def test_emulsions_reach_their_most(spark):
    area = weathering.emulsion_area(F.lit(0.0), F.lit(30.0), F.lit(0.0), F.lit(0.0), 1e-3, 0.9, 1e9)
    assert one(spark, weathering.water_fraction(area, 0.9)) == pytest.approx(0.9)


def test_levels_by_hyperbolic_tangents(spark):
    levels = one(spark, vertical.sigma_tanh(11, F.lit(2.0), F.lit(1.0)))
    assert levels[0] == 0 and levels[-1] == pytest.approx(-1.0) and all(b < a for a, b in zip(levels, levels[1:]))
    assert one(spark, vertical.stretch_2(F.lit(-1.0), 6.0, 0.4)) == pytest.approx(-1.0)
    assert one(spark, vertical.stretch_4(F.lit(-1.0), 6.0, 0.4)) == pytest.approx(-1.0)


def test_a_uniform_shear_has_its_vorticity(spark):
    b = spark.range(6).select(F.col("id").alias("ix")).crossJoin(spark.range(6).select(F.col("id").alias("iy"))).withColumn("depth", F.lit(1.0))
    nodes, cells = mesh.lattice_mesh(b, 6)
    flow = mesh.centres(cells, nodes).select("cell", (-2 * F.col("cy")).alias("u"), F.col("cx").alias("v"))
    got = mesh.vorticity(cells, nodes, flow).collect()
    assert len(got) == 36 and all(r.vorticity == pytest.approx(3.0) for r in got)


def test_a_plane_has_its_gradient(spark):
    b = spark.range(5).select(F.col("id").alias("ix")).crossJoin(spark.range(5).select(F.col("id").alias("iy"))).withColumn("depth", 2.0 * F.col("ix") - F.col("iy"))
    nodes, cells = mesh.lattice_mesh(b, 5)
    got = [r for r in mesh.cell_gradient(cells, nodes).collect() if r.gx is not None]
    assert got and all(r.gx == pytest.approx(2.0) and r.gy == pytest.approx(-1.0) for r in got)


def test_weights_of_a_rectangle(spark):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    quad = F.array(corner(0, 0), corner(4, 0), corner(4, 2), corner(0, 2))
    assert one(spark, stencil.quad_weights(quad, F.lit(1.0), F.lit(1.0))) == pytest.approx([0.375, 0.125, 0.125, 0.375])


def test_seeds_of_a_polygon_have_their_number(spark):
    wanted = spark.createDataFrame([(1, 7), (2, 40), (3, 1000)], "site_id int, number long")
    got = seeding.lattice_in_ring(wanted, "site_id", [(0.0, 0.0), (4.0, 0.0), (2.0, 3.0)])
    assert {r.site_id: r["count"] for r in got.groupBy("site_id").count().collect()} == {1: 7, 2: 40, 3: 1000}
    assert got.groupBy("site_id", "id").count().filter("count > 1").count() == 0


def test_rules_on_missing_and_outer_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (-300.0,)], "z double")
    got = df.select(rules.deepest_if_missing(F.col("z"), 225.0).alias("z")).select("z", rules.not_below(F.col("z"), 100.0).alias("w")).collect()
    assert [tuple(r) for r in got] == [(-225.0, -100.0), (-225.0, -100.0), (-5.0, -5.0), (-300.0, -100.0)]


def test_ragged_and_text_forms(spark):
    ragged = spark.createDataFrame([(1, [5, 6], [0.1, 0.2]), (2, [], []), (3, None, None)], "step int, id array<int>, lon array<double>")
    assert [tuple(r) for r in stores.long_form(ragged, ["id", "lon"]).collect()] == [(1, 5, 0.1), (1, 6, 0.2)]
    shapes = spark.createDataFrame([("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",)], "wkt string")
    got = stores.polygons_of_wkt(shapes, "wkt").select("part", geo.shoelace(F.col("ring")).alias("a")).collect()
    assert [tuple(r) for r in got] == [(0, 4.0), (1, 0.5)]
