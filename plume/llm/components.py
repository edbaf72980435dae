"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm.common import discard, stored


def large_star(edges: DataFrame) -> DataFrame:
    """Joins the larger neighbours of each node to the least of its neighbours and itself."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "of")
    return both.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Joins the smaller neighbours of each node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
    return down.join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("of", "m")).filter("u <> v")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (u, v).

    Alternating large and small stars end after about the logarithm of the
    longest path. Each round is written to the shared folder, and only a
    count and a checksum reach the driver.
    """
    now = stored(edges.toDF("u", "v").filter("u <> v").distinct(), "edges")
    last = None
    while True:
        step = stored(small_star(large_star(now).distinct()).distinct(), "edges")
        discard(now)
        now = step
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        last = state
