"""Near-duplicate vectors of one label by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm.common import discard, stored
from plume.llm.components import connected_components
from plume.llm.vectors import commonest_length, finite, folded

#: Numbers of the vectors of a block; a task compares two blocks.
BLOCK_NUMBERS = 1 << 21
#: Vectors of a tile, and leading dimensions whose ranges a tile knows.
TILE = 512
BOX_DIMENSIONS = 16
#: Leading dimensions that are accumulated at each step before the bound is looked at.
STEPS = (8, 16, 32, 64, 128, 256)
#: Blocks of a label that its quantiles tell apart.
MOST_SLABS = 1024
#: Margins of bounds in single and double precision; cosines within the second of the threshold are computed anew.
SINGLE, DOUBLE = 1e-5, 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled first, so that squares don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of x with rows of y, one by one, from the vectors as they are."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def tiles(y: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` in parts of at most ``TILE``, halved at the middle of the leading dimension of the widest range."""
    if len(rows) <= TILE:
        return [rows] if len(rows) else []
    lead = y[rows, :BOX_DIMENSIONS]
    order = rows[np.argsort(lead[:, np.argmax(lead.max(0) - lead.min(0))], kind="stable")]
    half = len(order) // 2
    return tiles(y, order[:half]) + tiles(y, order[half:])


def roots_of(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The roots of ``rows``; what was followed points to them afterwards."""
    root = parent[rows]
    while (parent[root] != root).any():
        root = parent[root]
    parent[rows] = root
    return root


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of all i and j; the least row is the root."""
    while len(i):
        a, b = roots_of(parent, i), roots_of(parent, j)
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class Tiled:
    """Vectors of two blocks (or of one twice) in PCA order, compared tile by tile."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray | None, threshold: float) -> None:
        self.x, self.threshold = x, threshold
        self.y = units(x) if rotation is None else units(x) @ rotation
        d = x.shape[1]
        self.steps = [*[s for s in STEPS if s < d], d]
        tails = np.cumsum((self.y**2)[:, ::-1], axis=1)[:, ::-1]
        # norms of what follows each step
        self.rest = np.sqrt(np.column_stack([tails[:, s] if s < d else np.zeros(len(x)) for s in self.steps]))
        first = self.steps[0]
        self.head = np.column_stack([self.y[:, :first], self.rest[:, 0]]).astype(np.float32)

    def links(self, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows of tiles a and b, each pair once.

        A product over the first dimensions and the norms of the rest bounds
        all cosines of the two tiles at once; pairs that can reach the
        threshold go on, step by step, until none is left or all dimensions
        are in.
        """
        bound = self.head[a] @ self.head[b].T
        near = bound >= self.threshold - SINGLE
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        i, j = a[i], b[j]
        cosine, start = np.zeros(len(i)), 0
        for k, end in enumerate(self.steps):
            if not len(i):
                break
            for at in range(0, len(i), 65_536):  # bounds what is gathered at once
                part = slice(at, at + 65_536)
                cosine[part] += np.einsum("ij,ij->i", self.y[i[part], start:end], self.y[j[part], start:end])
            able = cosine + self.rest[i, k] * self.rest[j, k] >= self.threshold - DOUBLE
            i, j, cosine, start = i[able], j[able], cosine[able], end
        close = np.flatnonzero(np.abs(cosine - self.threshold) <= DOUBLE)
        cosine[close] = cosines(self.x[i[close]], self.x[j[close]])
        linked = cosine >= self.threshold
        return i[linked], j[linked]

    def compared(self, weights: np.ndarray, first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """For each row the weight of its links and the least row it is connected to; ``second`` is None within one block."""
        own = tiles(self.y, first)
        others = own if second is None else tiles(self.y, second)
        lead = self.y[:, :BOX_DIMENSIONS]
        low, high = (np.array([f(lead[t], axis=0) for t in others]) for f in (np.min, np.max))
        linked, parent = np.zeros(len(self.x), np.int64), np.arange(len(self.x))
        reach = 2 - 2 * self.threshold + SINGLE
        for k, a in enumerate(own):
            gap = np.maximum(np.maximum(low - lead[a].max(0), lead[a].min(0) - high), 0)
            for m in np.flatnonzero((gap**2).sum(1) <= reach):
                if second is None and m < k:
                    continue
                i, j = self.links(a, others[m], second is None and m == k)
                if len(i):
                    np.add.at(linked, i, weights[j])
                    np.add.at(linked, j, weights[i])
                    unite(parent, i, j)
        return linked, roots_of(parent, np.arange(len(self.x)))


def second_moments(classes: DataFrame, d: int) -> np.ndarray | None:
    """The sum of the products of all unit vectors of length d with themselves."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for frame in frames:
            if len(frame):
                u = units(np.array(frame["x"].tolist(), dtype=float))
                total += u.T @ u
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [total.tobytes()]})

    return folded(classes.filter(F.size("x") == d).select("x").mapInPandas(add, "part long, data binary"), np.add, (d, d))


def leading_coordinate(x: Column, direction: np.ndarray) -> Column:
    """The unit vector's coordinate along ``direction``; the first one of vectors of another length."""
    v = x.cast("array<double>")
    v = F.transform(v, lambda c: c / F.array_max(F.transform(x.cast("array<double>"), F.abs)))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c))
    along = F.aggregate(F.zip_with(v, F.array(*[F.lit(float(c)) for c in direction]), lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    return F.when(F.size(x) == len(direction), along).otherwise(F.element_at(v, 1)) / norm


def in_blocks(classes: DataFrame, reach: float, numbers: int = BLOCK_NUMBERS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``classes`` (class, label, lead, x) with their block, the pairs of blocks of a label that may hold links, and the tables they read.

    A label with more vectors than a block is cut by quantiles of the
    leading coordinate; a slab that ties make too large is dealt by hash.
    Blocks that are further apart along it than ``reach`` aren't paired.
    """
    kinds = ["label", "d"]
    keyed = classes.withColumn("d", F.size("x"))
    most = F.greatest(F.floor(F.lit(numbers) / F.col("d")), F.lit(1))
    large = keyed.groupBy(kinds).count().filter(F.col("count") > most).select(*kinds, F.least(F.ceil(F.col("count") / most), F.lit(MOST_SLABS)).cast("int").alias("slabs"))
    steps = [k / MOST_SLABS for k in range(1, MOST_SLABS)]
    cuts = keyed.join(large, kinds).groupBy(kinds).agg(F.first("slabs").alias("slabs"), F.percentile_approx("lead", steps, 10_000).alias("cuts"))
    cuts = cuts.withColumn("cuts", F.transform(F.sequence(F.lit(1), F.col("slabs") - 1), lambda k: F.element_at("cuts", F.greatest(F.floor(k * MOST_SLABS / F.col("slabs")).cast("int"), F.lit(1)))))
    cuts = stored(cuts.select(*kinds, "cuts"), "cuts")
    slabbed = keyed.join(cuts, kinds, "left").withColumn("slab", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("lead"))), F.lit(0))).drop("cuts")
    slabs = slabbed.groupBy(*kinds, "slab").agg(F.min("lead").alias("low"), F.max("lead").alias("high"), F.ceil(F.count("*") / (2 * most)).cast("int").alias("parts"))
    slabs = stored(slabs, "slabs")
    each = slabs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.struct("slab", "part"))
    other = each.select(*kinds, F.col("block").alias("second"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    pairs = each.join(other, kinds).filter((F.col("block") <= F.col("second")) & (F.col("low_2") - F.col("high") <= reach) & (F.col("low") - F.col("high_2") <= reach))
    pairs = stored(pairs.select(*kinds, F.col("block").alias("first"), "second"), "block-pairs")
    dealt = slabbed.join(slabs.select(*kinds, "slab", "parts"), [*kinds, "slab"])
    dealt = dealt.withColumn("block", F.struct("slab", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part")))
    return dealt.drop("parts", "slab", "lead"), pairs, [cuts, slabs, pairs]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, label, embedding).

    Vectors of one label are linked if their cosine, in double precision, is
    ``threshold`` or more. n_links counts the other rows linked directly,
    component_id is the least vec_id reachable over links, kept marks it.

    Equal vectors of a label are one class, compared once. The principal
    axes of all unit vectors (uncentred, as cosines are) give the order of
    the dimensions. A label's classes are cut into blocks of bounded size by
    the leading coordinate, and only blocks that are near enough along it
    are paired. A task compares two blocks in tiles of ``TILE`` vectors:
    tiles whose ranges in the leading dimensions are too far apart are
    skipped; else the products of the first dimensions are accumulated,
    what the rest can add is bounded by the product of the two suffix norms,
    and a pair stops as soon as its cosine can't reach the threshold. A task
    returns one row for each class with links, its number of links and the
    least class it is connected to, so that a group of near copies never
    becomes a table of pairs. No pair is missed.

    Rows with a null label, and vectors that are null, empty, zero or hold
    null or non-finite entries, are linked with nothing; neither are vectors
    of different lengths. Equal rows and rows that repeat a vec_id are rows
    of their own, linked with each other if their vectors are; a null vec_id
    is never a component_id unless its component has no other. An empty
    table gives an empty result. Other columns aren't looked at.
    """
    emb = F.col("embedding")
    takes_part = finite(emb) & F.exists(emb, lambda c: c != 0) & F.col("label").isNotNull()
    label = F.col("label").cast("string")
    keys = ["label", "h1", "h2"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), emb.alias("x"), F.coalesce(takes_part, F.lit(False)).alias("used"))
    used = rows.filter("used").withColumn("h1", F.xxhash64("label", "x")).withColumn("h2", F.xxhash64(F.lit(11), "x", "label"))
    classes = used.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    d = commonest_length(classes)
    rotation = None
    if d:
        rotation = np.linalg.eigh(second_moments(classes, d))[1][:, ::-1].copy()
    lead = leading_coordinate(F.col("x"), rotation[:, 0] if d else np.ones(1))
    dealt, pairs, made = in_blocks(classes.select("class", "label", "n", "x", lead.alias("lead")), float(np.sqrt(2 - 2 * threshold)) + SINGLE, numbers)
    places = pairs.select("label", "d", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"), "first", "second")
    met = dealt.join(places, ["label", "d", "block"]).withColumn("one", F.col("block") == F.col("first")).select("class", "n", "x", "label", "d", "first", "second", "one")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class", ignore_index=True)
        x = np.array(frame["x"].tolist(), dtype=float)
        one, alone = frame["one"].to_numpy(), bool(frame["one"].all())
        tiled = Tiled(x, rotation if x.shape[1] == d else None, threshold)
        linked, root = tiled.compared(frame["n"].to_numpy(), np.flatnonzero(one), None if alone else np.flatnonzero(~one))
        at = np.flatnonzero(linked)
        ids = frame["class"].to_numpy()
        return pd.DataFrame({"class": ids[at], "linked": linked[at], "root": ids[root[at]]})

    links = stored(met.groupBy("label", "d", "first", "second").applyInPandas(compare, "class long, linked long, root long"), "vector-links")
    roots = stored(connected_components(links.select(F.col("class").alias("u"), F.col("root").alias("v"))), "vector-components")
    counts = links.groupBy(F.col("class").alias("of")).agg(F.sum("linked").alias("linked"))
    known = classes.select("class", *keys, "n", "least").join(counts, F.col("class") == F.col("of"), "left").drop("of")
    known = known.join(roots.withColumnRenamed("node", "of"), F.col("class") == F.col("of"), "left").select("class", *keys, "n", "least", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "class").alias("root"))
    groups = stored(known, "vector-groups")
    least = groups.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    known = stored(groups.join(least, F.col("root") == F.col("of")).select(*keys, (F.col("n") - 1 + F.col("linked")).alias("n_links"), "component_id"), "vector-results")
    found = used.select("vec_id", *keys).join(known, keys).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.col("used")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    out = stored(out, "near-vectors")
    discard(classes, *made, links, roots, known, groups)
    return out
