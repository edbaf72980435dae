"""Triangle meshes as tables: nodes (node, x, y, value) and cells (cell, a, b, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.operators.joins import shuffled


def lattice_mesh(lattice: DataFrame, columns: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes and two triangles for each square of a lattice (ix, iy, depth) whose four corners exist."""
    node = lambda dx, dy: (F.col("iy") + dy) * columns + F.col("ix") + dx
    nodes = lattice.select(node(0, 0).alias("node"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col("depth").alias("value"))
    at = lambda dx, dy: lattice.select((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"))
    squares = lattice.select("ix", "iy").filter(F.col("ix") < columns - 1)
    for dx, dy in ((1, 0), (0, 1), (1, 1)):
        squares = squares.join(shuffled(at(dx, dy)), ["ix", "iy"], "left_semi")
    lower = F.struct((node(0, 0) * 2).alias("cell"), node(0, 0).alias("a"), node(1, 0).alias("b"), node(1, 1).alias("c"))
    upper = F.struct((node(0, 0) * 2 + 1).alias("cell"), node(0, 0).alias("a"), node(1, 1).alias("b"), node(0, 1).alias("c"))
    return nodes, squares.select(F.explode(F.array(lower, upper)).alias("t")).select("t.*")


def edges(cells: DataFrame) -> DataFrame:
    """u < v, number of cells on each edge; one cell means boundary."""
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return cells.select(F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("cells"))


def cell_neighbours(cells: DataFrame) -> DataFrame:
    """cell, other for cells that share an edge: a join on the edge, which has two cells at most."""
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    by_edge = cells.select("cell", F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.min("cell").alias("p"), F.max("cell").alias("q")).filter("p <> q")
    return by_edge.select(F.explode(F.array(F.struct(F.col("p").alias("cell"), F.col("q").alias("other")), F.struct(F.col("q").alias("cell"), F.col("p").alias("other")))).alias("n")).select("n.*")


def links(cells: DataFrame) -> DataFrame:
    """Both directions of every edge: node, other."""
    e = edges(cells)
    return e.select(F.col("u").alias("node"), F.col("v").alias("other")).union(e.select("v", "u"))


def node_gradient(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """node, gx, gy: least-squares plane through a node's neighbours, as sums of the normal equations."""
    n = links(cells).join(nodes.select("node", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("value").alias("v0")), "node")
    n = n.join(nodes.select(F.col("node").alias("other"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("value").alias("v1")), "other")
    dx, dy, dv = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("v1") - F.col("v0")
    s = n.groupBy("node").agg(*[F.sum(e).alias(a) for a, e in (("xx", dx * dx), ("xy", dx * dy), ("yy", dy * dy), ("xv", dx * dv), ("yv", dy * dv))])
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    gx = (F.col("yy") * F.col("xv") - F.col("xy") * F.col("yv")) / det
    gy = (F.col("xx") * F.col("yv") - F.col("xy") * F.col("xv")) / det
    return s.select("node", gx.alias("gx"), gy.alias("gy"))


def corners(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell with the coordinates and values of its corners, by one explode, join and regrouping."""
    c = cells.select("cell", F.posexplode(F.array("a", "b", "c")).alias("k", "node")).join(shuffled(nodes), "node")
    pick = lambda col, k: F.max(F.when(F.col("k") == k, F.col(col))).alias(f"{col}{k}")
    return c.groupBy("cell").agg(*[pick(col, k) for col in ("x", "y", "value") for k in range(3)])


def triangle_area(c: DataFrame) -> DataFrame:
    cross = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return c.withColumn("area", cross / 2)


def node_means(cells: DataFrame, values: DataFrame) -> DataFrame:
    """node, value: mean of the values of the cells around a node."""
    return cells.select("cell", F.explode(F.array("a", "b", "c")).alias("node")).join(values, "cell").groupBy("node").agg(F.avg("value").alias("value"))


def laplacian(nodes: DataFrame, cells: DataFrame, share: float = 0.2, passes: int = 1) -> DataFrame:
    """Each pass moves the values by ``share`` to the mean of the neighbours, all nodes at once."""
    pairs = links(cells)
    for _ in range(passes):
        mean = pairs.join(nodes.select(F.col("node").alias("other"), "value"), "other").groupBy("node").agg(F.avg("value").alias("mean"))
        nodes = nodes.join(mean, "node", "left").select("node", "x", "y", (F.col("value") * (1 - share) + F.coalesce("mean", "value") * share).alias("value"))
    return nodes


def centres(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell with its corners, area, centre (cx, cy) and mean value."""
    c = triangle_area(corners(cells, nodes))
    mean = lambda a: (F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3
    return c.withColumns({"cx": mean("x"), "cy": mean("y"), "mean": mean("value")})


def cell_gradient(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell, gx, gy: least-squares plane through the means of the cells that share an edge; null with one such cell."""
    c = centres(cells, nodes).select("cell", "cx", "cy", "mean")
    n = cell_neighbours(cells).join(shuffled(c), "cell").join(shuffled(c.toDF("other", "ox", "oy", "om")), "other")
    dx, dy, dv = F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy"), F.col("om") - F.col("mean")
    s = n.groupBy("cell").agg(*[F.sum(e).alias(a) for a, e in (("xx", dx * dx), ("xy", dx * dy), ("yy", dy * dy), ("xv", dx * dv), ("yv", dy * dv))])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    det = F.when(F.abs(det) > 1e-9, det)
    return s.select("cell", ((F.col("yy") * F.col("xv") - F.col("xy") * F.col("yv")) / det).alias("gx"), ((F.col("xx") * F.col("yv") - F.col("xy") * F.col("xv")) / det).alias("gy"))


def boundary_nodes(cells: DataFrame) -> DataFrame:
    """node and its number of edges that have one cell only."""
    e = edges(cells).filter("cells = 1")
    return e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("open"))


def vorticity(cells: DataFrame, nodes: DataFrame, flow: DataFrame) -> DataFrame:
    """node, vorticity: circulation of the cells' velocities (cell, u, v) around a node's control volume over its area.

    The volume's walls go from the middles of edges to the centres of cells,
    and each wall lies between two nodes, with opposite signs. Nodes of the
    boundary take the mean of their inner neighbours, or, without any, of the neighbours that have one.
    """
    c = centres(cells, nodes).join(shuffled(flow), "cell").join(shuffled(cells), "cell")
    wall = lambda p, q: F.struct(F.col("abc"[p]).alias("p"), F.col("abc"[q]).alias("q"), (F.col("cx") - (F.col(f"x{p}") + F.col(f"x{q}")) / 2).alias("dx"), (F.col("cy") - (F.col(f"y{p}") + F.col(f"y{q}")) / 2).alias("dy"))
    w = c.select("u", "v", "area", F.explode(F.array(wall(0, 1), wall(1, 2), wall(2, 0))).alias("w"))
    along = F.col("u") * F.col("w.dx") + F.col("v") * F.col("w.dy")
    # each node is p of one wall in each of its cells
    told = F.explode(F.array(F.struct(F.col("w.p").alias("node"), along.alias("c"), (F.col("area") / 3).alias("a")), F.struct(F.col("w.q").alias("node"), (-along).alias("c"), F.lit(0.0).alias("a"))))
    inner = w.select(told.alias("t")).groupBy("t.node").agg((F.sum("t.c") / F.sum("t.a")).alias("vorticity")).join(shuffled(boundary_nodes(cells)), "node", "left_anti")
    outer, pairs = boundary_nodes(cells).select("node"), links(cells)

    def mean_of(known: DataFrame, wanted: DataFrame) -> DataFrame:
        near = wanted.join(shuffled(pairs), "node").join(shuffled(known.select(F.col("node").alias("other"), "vorticity")), "other")
        return near.groupBy("node").agg(F.avg("vorticity").alias("vorticity"))

    first = mean_of(inner, outer)
    known = inner.unionByName(first)
    return known.unionByName(mean_of(known, outer.join(shuffled(first), "node", "left_anti")))


def containing_cell(points: DataFrame, cells: DataFrame, nodes: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """``points`` (key, px, py) with the cell that holds them, the least on a shared edge, and its weights w0, w1, w2.

    Cells are copied to the square buckets that they touch; points meet
    those of their bucket, and the weights decide. Points outside of the mesh are left out.
    """
    c = triangle_area(corners(cells, nodes))
    bucket = lambda v: F.floor(v / size)
    ends = lambda a: F.sequence(bucket(F.least(*[f"{a}{k}" for k in range(3)])), bucket(F.greatest(*[f"{a}{k}" for k in range(3)])))
    c = c.withColumn("bx", F.explode(ends("x"))).withColumn("by", F.explode(ends("y")))
    met = points.withColumns({"bx": bucket(F.col("px")), "by": bucket(F.col("py"))}).join(shuffled(c), ["bx", "by"])
    part = lambda i, j: ((F.col(f"x{i}") - F.col("px")) * (F.col(f"y{j}") - F.col("py")) - (F.col(f"x{j}") - F.col("px")) * (F.col(f"y{i}") - F.col("py"))) / (2 * F.col("area"))
    met = met.withColumns({"w0": part(1, 2), "w1": part(2, 0), "w2": part(0, 1)}).filter("least(w0, w1, w2) >= -1e-12")
    row = F.struct("cell", *[f"{a}{k}" for a in ("w", "value") for k in range(3)])
    return met.groupBy(*points.columns).agg(F.min(row).alias("c")).select(*points.columns, "c.*")


def interpolated() -> Column:
    return F.col("w0") * F.col("value0") + F.col("w1") * F.col("value1") + F.col("w2") * F.col("value2")


def angles() -> list[Column]:
    """The three angles (degrees) of a row of corners."""

    def at(i: int, j: int, k: int) -> Column:
        ux, uy, vx, vy = (F.col(f"{a}{p}") - F.col(f"{a}{i}") for p in (j, k) for a in ("x", "y"))
        return F.degrees(F.acos(F.least(F.greatest((ux * vx + uy * vy) / (F.hypot(ux, uy) * F.hypot(vx, vy)), F.lit(-1.0)), F.lit(1.0))))

    return [at(0, 1, 2), at(1, 2, 0), at(2, 0, 1)]


def plane_radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of ``left`` (x, y) and ``right`` (x2, y2) within ``radius`` on a plane, with their distance; right rows are copied to nine buckets."""
    near, bucket = F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda c: F.floor(F.col(c) / radius)
    r = right.withColumn("bx", F.explode(F.transform(near, lambda d: bucket("x2") + d))).withColumn("by", F.explode(F.transform(near, lambda d: bucket("y2") + d)))
    l = left.withColumns({"bx": bucket("x"), "by": bucket("y")})  # noqa: E741
    return l.join(r, ["bx", "by"]).withColumn("distance", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).filter(F.col("distance") <= radius).drop("bx", "by")
