"""Rivers onto a mesh under a limit for each node, and the blending of two bathymetries along an open boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plume.operators import mesh, stencil
from plume.sources.stores import dropped, kept


def rivers_to_nodes(rivers: DataFrame, nodes: DataFrame, reach: float, tolerance: float = 1e-9) -> DataFrame:
    """node, flow, temperature: the rivers' flow on the nodes of the shore, none with more than its limit.

    ``rivers`` has river, x, y, flow, temperature; ``nodes`` node, x, y,
    limit. In each round a river offers what is left of its flow to its
    nearest nodes, each as much as it has room for (ring after ring, until
    all is offered); a node that is offered more than its room takes the same
    share of every offer. So in each round a river is done or a node is full,
    and flow and heat are kept. What finds no room within ``reach`` is the
    row of node -1.
    """
    pairs = mesh.plane_radius_join(rivers.select("river", "x", "y"), nodes.select("node", F.col("x").alias("x2"), F.col("y").alias("y2")), reach)
    pairs = kept(pairs.select("river", "node", "distance"), "river-pairs")
    zero = F.lit(0.0)
    left = kept(rivers.select("river", "flow", "temperature"), "rivers")
    room = kept(nodes.select("node", F.col("limit").alias("room"), zero.alias("flow"), zero.alias("heat")), "room")
    nearer = Window.partitionBy("river").orderBy("distance", "node").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        asked = pairs.join(left.filter(F.col("flow") > tolerance).withColumnRenamed("flow", "rest"), "river").join(room.filter(F.col("room") > tolerance).select("node", "room"), "node")
        offer = F.least(F.col("rest") - F.coalesce(F.sum("room").over(nearer), zero), F.col("room"))
        offers = asked.withColumn("offer", offer).filter("offer > 0")
        share = F.least(F.lit(1.0), F.col("room") / F.sum("offer").over(Window.partitionBy("node")))
        taken = kept(offers.select("river", "node", (F.col("offer") * share).alias("taken"), "temperature"), "taken")
        if not taken.limit(1).count():
            dropped(taken, pairs)
            break
        gone = taken.groupBy("river").agg(F.sum("taken").alias("taken"))
        filled = taken.groupBy("node").agg(F.sum("taken").alias("taken"), F.sum(F.col("taken") * F.col("temperature")).alias("warm"))
        got = F.coalesce("taken", zero)
        less = kept(left.join(gone, "river", "left").select("river", (F.col("flow") - got).alias("flow"), "temperature"), "rivers")
        fuller = kept(room.join(filled, "node", "left").select("node", (F.col("room") - got).alias("room"), (F.col("flow") + got).alias("flow"), (F.col("heat") + F.coalesce("warm", zero)).alias("heat")), "room")
        dropped(left, room, taken)
        left, room = less, fuller
    over = left.filter(F.col("flow") > tolerance).agg(F.lit(-1).cast("long").alias("node"), F.sum("flow").alias("flow"), F.sum(F.col("flow") * F.col("temperature")).alias("heat")).filter("flow is not null")
    return room.select("node", "flow", "heat").filter("flow > 0").unionByName(over).select("node", "flow", (F.col("heat") / F.col("flow")).alias("temperature"))


def blended_depths(nodes: DataFrame, boundary: DataFrame, coarse: DataFrame, spacing: float, zone: float) -> DataFrame:
    """``nodes`` (node, x, y, value) with the depths of a coarse grid along the open boundary and a smooth transition to their own.

    ``boundary`` has x2, y2; ``coarse`` ix, iy, value, ``spacing`` apart.
    Within twice of ``zone`` from the boundary the coarse depth counts alone;
    from there to the last node within six times its weight falls linearly
    with the distance. Where the coarse grid has no value, nodes keep their own.
    """
    near = mesh.plane_radius_join(nodes.select("node", "x", "y"), boundary, 6 * zone).groupBy("node").agg(F.min("distance").alias("distance"))
    inner = F.col("distance") <= 2 * zone
    ends = near.agg(F.max(F.when(inner, F.col("distance"))).alias("one"), F.max(F.when(~inner, F.col("distance"))).alias("none"))
    weighed = near.crossJoin(F.broadcast(ends))  # one row
    w = F.when(inner, 1.0).otherwise((F.col("distance") - F.col("none")) / (F.col("one") - F.col("none")))
    weighed = weighed.select("node", w.alias("w"))
    points = nodes.join(weighed.select("node"), "node", "left_semi").select("node", (F.col("x") / spacing).alias("x"), (F.col("y") / spacing).alias("y"))
    other = stencil.bilinear(points, coarse, "value", "node").withColumnRenamed("value", "coarse")
    out = nodes.join(weighed, "node", "left").join(other, "node", "left")
    w = F.when(F.col("coarse").isNotNull(), F.coalesce("w", F.lit(0.0))).otherwise(0.0)
    return out.select("node", "x", "y", (F.coalesce("coarse", F.lit(0.0)) * w + F.col("value") * (1 - w)).alias("value"))
