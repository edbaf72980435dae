"""Potentials on graphs and the slope limiter: rounds of joins, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.operators.joins import shuffled
from plume.operators.mesh import edges
from plume.sources.stores import dropped, kept


def to_roots(tree: DataFrame) -> DataFrame:
    """node, root, p for ``tree`` (node, parent, p): p is added along the way to the root, whose parent is itself.

    Pointer doubling: in each round a node takes over its parent's parent,
    so that the rounds are the logarithm of the depth. Nodes that have
    arrived are joined no more, so that a root is never a hot key.
    """
    now = kept(tree.withColumn("done", F.col("node") == F.col("parent")), "tree")
    while now.filter("not done").limit(1).count():
        above = now.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("p").alias("q"), F.col("done").alias("there"))
        stepped = now.filter("not done").join(shuffled(above), "parent").select("node", F.col("next").alias("parent"), (F.col("p") + F.col("q")).alias("p"), F.col("there").alias("done"))
        step = kept(now.filter("done").unionByName(stepped), "tree")
        dropped(now)
        now = step
    return now.select("node", F.col("parent").alias("root"), "p")


def potentials(steps: DataFrame) -> DataFrame:
    """node, root, p: for each node the sum of the differences along a spanning tree from its root.

    ``steps`` has u < v, once each, and d, the difference from u to v. A
    node's parent is its least neighbour if that is less than itself. Trees
    are then joined: each root but the least of its surroundings hooks on
    along its tree's least edge (by v, then u) to a tree of a smaller root,
    until no edge joins two trees; the trees that are left are at most half
    of those before.
    Where the differences around every loop sum to zero, p doesn't depend on
    the tree. The root is the least node of its component.
    """
    ends = steps.select(F.col("v").alias("node"), F.col("u").alias("other"), "d").unionByName(steps.select(F.col("u").alias("node"), F.col("v").alias("other"), (-F.col("d")).alias("d")))
    least = ends.groupBy("node").agg(F.min(F.struct("other", "d")).alias("m"))
    hooked = F.col("m.other") < F.col("node")
    tree = least.select("node", F.when(hooked, F.col("m.other")).otherwise(F.col("node")).alias("parent"), F.when(hooked, F.col("m.d")).otherwise(0.0).alias("p"))
    known = kept(to_roots(tree), "potentials")
    while True:
        of = lambda end, k: known.select(F.col("node").alias(end), F.col("root").alias(f"root_{k}"), F.col("p").alias(f"p_{k}"))
        across = steps.join(shuffled(of("u", 0)), "u").join(shuffled(of("v", 1)), "v").filter("root_0 <> root_1")
        gap = F.col("p_0") + F.col("d") - F.col("p_1")
        side = F.struct(F.greatest("root_0", "root_1").alias("node"), F.least("root_0", "root_1").alias("parent"), F.when(F.col("root_0") < F.col("root_1"), gap).otherwise(-gap).alias("p"))
        hooks = across.select("u", "v", side.alias("s")).groupBy("s.node").agg(F.min(F.struct("v", "u", "s.parent", "s.p")).alias("m"))
        hooks = kept(hooks.select("node", "m.parent", "m.p"), "hooks")
        if not hooks.limit(1).count():
            dropped(hooks)
            return known
        tops = hooks.select("parent").distinct().join(shuffled(hooks.select(F.col("node").alias("parent"))), "parent", "left_anti")
        roots = to_roots(hooks.unionByName(tops.select(F.col("parent").alias("node"), "parent", F.lit(0.0).alias("p"))))
        moved = known.withColumnRenamed("p", "own").join(shuffled(roots.select(F.col("node").alias("root"), F.col("root").alias("top"), "p")), "root", "left")
        step = kept(moved.select("node", F.coalesce("top", "root").alias("root"), (F.col("own") + F.coalesce("p", F.lit(0.0))).alias("p")), "potentials")
        dropped(known, hooks)
        known = step


def crossing_flow(nodes: DataFrame, cells: DataFrame, flow: DataFrame) -> DataFrame:
    """u, v, d: what flows across each edge (mean velocity of its cells, turned by its extent); ``flow`` has cell, vx, vy."""
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    mean = cells.join(shuffled(flow), "cell").select(F.explode(sides).alias("e"), "vx", "vy").groupBy("e.u", "e.v").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))
    at = lambda end, k: nodes.select(F.col("node").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    both = mean.join(shuffled(at("u", 0)), "u").join(shuffled(at("v", 1)), "v")
    return both.select("u", "v", (F.col("vx") * (F.col("y1") - F.col("y0")) - F.col("vy") * (F.col("x1") - F.col("x0"))).alias("d"))


def stream_function(nodes: DataFrame, cells: DataFrame, flow: DataFrame) -> DataFrame:
    """node, root, p: the stream function of cell velocities, zero at the least node of each component."""
    return potentials(kept(crossing_flow(nodes, cells, flow), "crossings"))


def loop_residuals(nodes: DataFrame, cells: DataFrame, flow: DataFrame) -> DataFrame:
    """cell, residual: the differences summed around each cell; zero where a stream function exists exactly."""
    d = crossing_flow(nodes, cells, flow)
    side = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.when(F.col(p) < F.col(q), 1).otherwise(-1).alias("sign"))
    around = cells.select("cell", F.explode(F.array(side("a", "b"), side("b", "c"), side("c", "a"))).alias("e")).select("cell", "e.*")
    return around.join(shuffled(d), ["u", "v"]).groupBy("cell").agg(F.sum(F.col("sign") * F.col("d")).alias("residual"))


def steepness(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """u, v, up (the deeper end), down, h0, h1 (their depths), r: the difference of the depths over their sum."""
    at = lambda end, k: nodes.select(F.col("node").alias(end), F.col("value").alias(f"h{k}"))
    both = pairs.join(at("u", 0), "u").join(at("v", 1), "v")
    deep = F.col("h0") >= F.col("h1")
    swap = lambda a, b: F.when(deep, F.col(a)).otherwise(F.col(b))
    both = both.select("u", "v", swap("u", "v").alias("up"), swap("v", "u").alias("down"), swap("h0", "h1").alias("h0"), swap("h1", "h0").alias("h1"))
    return both.withColumn("r", (F.col("h0") - F.col("h1")) / (F.col("h0") + F.col("h1")))


def limited_slopes(nodes: DataFrame, cells: DataFrame, most: float, tolerance: float = 1e-9, rounds: int | None = None) -> DataFrame:
    """``nodes`` with depths changed until no edge is steeper than ``most`` (but for ``tolerance``), the sum of depths kept.

    In each round the edges that are too steep and the steepest of both of
    their ends (ties to the least nodes) move half of the excess from the
    deeper end to the other. No two of these edges share a node, so that they
    all change at once: a colouring of the edges, made anew by what is
    steepest now. ``rounds`` ends it early.
    """
    pairs = kept(edges(cells).select("u", "v"), "pairs")
    now, done = kept(nodes.select("node", "x", "y", "value"), "depths"), 0
    while rounds is None or done < rounds:
        steep = steepness(now, pairs).filter(F.col("r") > most + tolerance)
        rank = F.struct((-F.col("r")).alias("r"), "u", "v")
        steep = kept(steep.withColumn("rank", rank), "steep")
        first = steep.select(F.explode(F.array("u", "v")).alias("node"), "rank").groupBy("node").agg(F.min("rank").alias("best"))
        best = lambda end, k: first.select(F.col("node").alias(end), F.col("best").alias(f"best_{k}"))
        chosen = steep.join(best("u", 0), "u").join(best("v", 1), "v").filter("rank = best_0 and rank = best_1")
        excess = 0.5 * (F.col("h0") - F.col("h1") - most * (F.col("h0") + F.col("h1")))
        change = F.array(F.struct(F.col("up").alias("node"), (-excess).alias("change")), F.struct(F.col("down").alias("node"), excess.alias("change")))
        changes = chosen.select(F.explode(change).alias("c")).select("c.*")
        if not steep.limit(1).count():
            dropped(steep)
            break
        step = kept(now.join(changes, "node", "left").select("node", "x", "y", (F.col("value") + F.coalesce("change", F.lit(0.0))).alias("value")), "depths")
        dropped(now, steep)
        now, done = step, done + 1
    dropped(pairs)
    return now
