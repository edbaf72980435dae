"""Plans and results that matter where tables are large."""

import re

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from plume import jobs
from plume.operators import curvilinear, joins, potential, stencil


def plan(df):
    """The plan as it is before any of it has run."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cell_metrics", "poor_triangles", "weighted_deviation", "cell_gradient", "edge_vorticity", "element_in_cell", "mesh_section", "stream_residuals"])
def test_meshes_are_not_sent_through_the_driver(spark, name):
    assert "Broadcast" not in plan(jobs.QUERIES[name](spark, SF))


def test_rounds_of_trees_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, write = [], potential.kept
    monkeypatch.setattr(potential, "kept", lambda df, label: plans.append(plan(df)) or write(df, label))
    # two chains that meet at their upper ends, so that one root hooks on to the other
    chains = [(k, k + 1, 1.0) for k in range(8)] + [(k, k + 1, 1.0) for k in range(20, 25)] + [(8, 25, 1.0)]
    got = potential.potentials(spark.createDataFrame(chains, "u bigint, v bigint, d double")).collect()
    assert {x.root for x in got} == {0} and {x.node: x.p for x in got}[20] == 4.0
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_kernel_joins_cells_and_not_their_shares(spark):
    grid = spark.range(40).select((F.col("id") % 8).alias("ix"), F.floor(F.col("id") / 8).alias("iy"), (F.col("id") + 1.0).alias("v"))
    allowed = grid.filter("(ix + iy) % 3 = 0").select("ix", "iy")
    got = stencil.conserving_kernel(grid, "v", allowed)
    assert got.agg(F.sum("v")).first()[0] == pytest.approx(820.0) and got.join(allowed, ["ix", "iy"], "left_anti").count() == 0
    joins_, explodes = (lambda p: p.count("Join [")), (lambda p: p.count("Generate explode"))
    assert "Broadcast" not in (p := plan(got)) and joins_(p) == 2 and explodes(p) == 2


def test_many_columns_of_water_are_not_sent_through_the_driver(spark, monkeypatch):
    c = spark.range(60).select((F.col("id") % 6).alias("ix"), (F.floor("id") % 30 / 6).cast("bigint").alias("iy"), F.floor(F.col("id") / 30).alias("slot"))
    c = c.withColumns({"depths": F.array(F.lit(0.0), F.lit(10.0)), "v": F.array((F.col("ix") + F.col("slot")).cast("double"), F.col("iy").cast("double"))})
    p = spark.range(40).select("id", (F.col("id") % 5 + 0.25).alias("x"), (F.col("id") % 4 + 0.5).alias("y"), (F.col("id") % 12.0).alias("z"), (F.col("id") % 6.0).alias("t"))
    few = {x.id: x.v for x in curvilinear.four_way(p, c, "id", ("v",), 6.0).collect()}
    monkeypatch.setattr(curvilinear, "FEW_COLUMNS", 3)
    got = curvilinear.four_way(p, c, "id", ("v",), 6.0)
    assert "Broadcast" not in plan(got) and {x.id: x.v for x in got.collect()} == pytest.approx(few) and len(few) == 40


def test_equal_places_and_polygons_count_once_each(spark, tmp_path):
    # 59,500 ids on, a particle or site is at the same place again
    for name, key in (("events", "event_id"), ("supplier", "s_suppkey")):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.unionByName(t.withColumn(key, F.col(key) + 59_500)).write.parquet(f"{tmp_path}/{name}.parquet")
    mask = lambda d: jobs.QUERIES["polygon_mask"](spark, d)
    once = {x.event_id: x.polygons for x in mask(SF).collect()}
    twice = {x.event_id: x.polygons for x in mask(str(tmp_path)).collect()}
    assert twice == {k + shift: 2 * n for k, n in once.items() for shift in (0, 59_500)}
    assert re.search(r"HashAggregate\(keys=\[lon#\d+, lat#\d+\], functions=\[\]", plan(mask(SF)))


def test_pairs_by_place_are_all_pairs(spark):
    left = spark.range(90).select("id", (F.col("id") % 7 * 0.1).alias("lon"), (60 + F.col("id") % 3 * 0.1).alias("lat"))
    right = spark.range(20).select(F.col("id").alias("site"), (F.col("id") % 5 * 0.12).alias("lon2"), (60 + F.col("id") % 4 * 0.05).alias("lat2"))
    want = {(x.id, x.site): x.distance for x in joins.radius_join(left, right, 8000.0).collect()}
    groups = joins.radius_join_by_place(left, right, "id", 8000.0, together=3).collect()
    got = [((i, x.site), x.distance) for x in groups for i in x.ids]
    assert dict(got) == want and len(got) == len(want) > len(groups) and max(len(x.ids) for x in groups) == 3


def test_nearest_k_looks_no_farther_than_it_must(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # dense in one place, thin elsewhere; a step without right rows, and rows without a place
    dense, thin = rng.normal(0, 0.02, (1200, 2)), rng.uniform(-0.6, 0.6, (150, 2))
    at = [(float(x), float(60 + y)) for x, y in np.concatenate([dense, thin])]
    right = spark.createDataFrame([(k, k % 2, *p) for k, p in enumerate(at)], "live bigint, step bigint, lon2 double, lat2 double")
    rows = [(k, k % 3, *(float(v) for v in (rng.uniform(-0.7, 0.7), 60 + rng.uniform(-0.7, 0.7)))) for k in range(120)] + [(900, 0, None, 60.0)]
    left = spark.createDataFrame(rows, "dead bigint, step bigint, lon double, lat double")
    radii, bucketed = [], joins.bucketed
    monkeypatch.setattr(joins, "bucketed", lambda l, r, radius, *a: radii.append(radius) or bucketed(l, r, radius, *a))
    got = joins.nearest_k(left, right, "dead", "live", 5, 30_000.0, on=("step",))
    got = {(x.dead, x["rank"]): (x.live, pytest.approx(x.distance)) for x in got.collect()}
    assert radii[0] < 10_000 and radii[-1] == 30_000.0 and len(radii) > 2
    apart = joins.metres("lon", "lat", "lon2", "lat2")
    rank = F.row_number().over(Window.partitionBy("dead").orderBy("distance", "live"))
    want = left.join(right, "step").withColumn("distance", apart).filter("distance <= 30000").withColumn("rank", rank).filter("rank <= 5").collect()
    assert got == {(x.dead, x["rank"]): (x.live, x.distance) for x in want} and {x.dead for x in want if x["rank"] < 5}
