"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plume.llm.common import discard, stored, to_driver, unit_hash

#: Rows that the centroids and the visited share are fitted on, the least by a hash of vec_id.
FIT_ROWS = 16_000
CENTROIDS = 64
#: Recall within the sample that sets the share of vectors a query visits.
AIM = 0.95
#: Vectors of a block, about, and queries of a part of it.
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 4096


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of ``x`` by Lloyd's rounds."""
    different = np.unique(x, axis=0)
    centroids = different[np.random.default_rng(seed).permutation(len(different))[:k]].copy()
    for _ in range(rounds):
        nearest = squares(x, centroids).argmin(1)
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


@dataclass
class MultiIndex:
    """Centroids of the two vector halves; a cell is a pair of them."""

    half: int
    first: np.ndarray
    second: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        a = squares(x[:, : self.half], self.first).argmin(1)
        b = squares(x[:, self.half :], self.second).argmin(1)
        return a * len(self.second) + b

    def visit(self, x: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
        """Cells in order of their summed distance until they hold ``least`` vectors.

        The pairs are taken from a heap: (i, j) follows (i - 1, j) and
        (i, j - 1) in the two lists of centroids sorted by distance.
        """
        da, db = squares(x[None, : self.half], self.first)[0], squares(x[None, self.half :], self.second)[0]
        oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        da, db, held, width = da.tolist(), db.tolist(), counts.tolist(), len(ob)
        heap, found, total = [(da[oa[0]] + db[ob[0]], 0, 0)], [], 0
        while heap and total < least:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * width + ob[j]
            if held[cell]:
                found.append(cell)
                total += held[cell]
            if j + 1 < width:
                heapq.heappush(heap, (da[oa[i]] + db[ob[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (da[oa[i + 1]] + db[ob[0]], i + 1, 0))
        return found


def fit(sample: np.ndarray, centroids: int = CENTROIDS, aim: float = AIM, k: int = 10, queries: int = 200) -> tuple[MultiIndex, float]:
    """The index and the share of all vectors to visit for a recall of ``aim`` within the sample."""
    half = max(1, sample.shape[1] // 2)
    k_each = max(1, min(centroids, len(sample) // 30))
    index = MultiIndex(half, k_means(sample[:, :half], k_each), k_means(sample[:, half:], k_each))
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    places = []
    for q in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
        near = ((sample - sample[q]) ** 2).sum(1)
        near[q] = np.inf
        order = index.visit(sample[q], counts, len(sample))
        reached = np.zeros(len(counts))
        reached[order] = np.cumsum(counts[order])
        places.extend(reached[cells[np.argsort(near, kind="stable")[: min(k, len(sample) - 1)]]])
    return index, float(np.quantile(places, aim)) / len(sample) if places else 1.0


def block_table(counts: np.ndarray, most: int = BLOCK_VECTORS) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and over how many it is spread.

    Cells are taken in order; a block is closed before it would pass
    ``most`` vectors, and a cell with more has blocks of its own.
    """
    first, spread = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    block = held = 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > most:
            block, held = block + 1, 0
        first[cell], spread[cell] = block, max(1, -(-n // most))
        held += n
        if n > most:
            block, held = block + int(spread[cell]), 0
    return first, spread


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fit_for_use = F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    return vectors.filter(fit_for_use).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, rows: int = FIT_ROWS, aim: float = AIM) -> DataFrame:
    """The k nearest rows found of each row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding; the result query_id, rank, vec_id,
    score (Euclidean distance of the original vectors in double precision),
    nearest first, ties to the smaller vec_id.

    Each half of the vectors is quantised by its own centroids; a query
    visits the pairs of centroids by summed distance, taken from a heap,
    until they hold the share of all vectors that gave ``aim`` recall within
    the sample, and the entries of these cells are ranked by their distance.
    Only the centroids and that share are fitted, on at most ``rows`` rows;
    every row is in the index.

    Cells are dealt to blocks of bounded size, neighbouring cells together; a
    cell with more vectors is spread over several blocks by hash. A vector is
    in one block. A query goes to those blocks alone that hold cells it
    visits, with the list of these; where too many queries meet in a block,
    they are dealt to parts of it. A block returns k rows for each query.

    Vectors that are null, zero or hold null or non-finite components, have
    no vec_id, or another length than most of the sample take no part. Rows
    with the query's vec_id aren't its neighbours; of several rows with one
    vec_id the least vector asks. With fewer candidates than k all are
    returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors)
    sample = to_driver(good.orderBy(unit_hash(F.col("vec_id")), "vec_id", "embedding").limit(rows))
    if sample.empty:
        return spark.createDataFrame([], schema)
    size = int(sample["embedding"].map(len).mode()[0])
    x = np.array([v for v in sample["embedding"] if len(v) == size], dtype=float)
    index, share = fit(x, aim=aim, k=k)
    model = spark.sparkContext.broadcast(index)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=model.value.cells(np.array(frame["embedding"].tolist(), dtype=float)))

    good = good.filter(F.size("embedding") == size)
    indexed = stored(good.mapInPandas(assign, "vec_id long, embedding array<double>, cell int"), "multi-index")
    n_cells = len(index.first) * len(index.second)
    counts = np.zeros(n_cells, dtype=np.int64)
    for cell, n in indexed.groupBy("cell").count().collect():  # at most CENTROIDS squared rows
        counts[cell] = n
    total = int(counts.sum())
    least = max(int(np.ceil(share * total)), 4 * k + 1)
    first, spread = block_table(counts)
    plan = spark.sparkContext.broadcast((counts, first, spread))
    per_cell = spark.createDataFrame(pd.DataFrame({"cell": np.arange(n_cells, dtype=np.int32), "first": first, "spread": spread}))
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("spread"))).cast("int")
    held = indexed.join(F.broadcast(per_cell), "cell").select("vec_id", "embedding", "cell", block.alias("block"))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, first, spread = plan.value
        for frame in frames:
            rows = []
            for query, vector in zip(frame["vec_id"], frame["embedding"]):
                cells = np.sort(np.array(model.value.visit(np.asarray(vector, dtype=float), counts, least), dtype=np.int32))
                cut = np.flatnonzero(np.diff(first[cells], prepend=-1))
                for own in np.split(cells, cut[1:]):
                    rows.extend((query, vector, own, int(first[own[0]]) + s) for s in range(spread[own[0]]))
            yield pd.DataFrame(rows, columns=["vec_id", "embedding", "cells", "block"])

    queries = indexed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(queries.mapInPandas(visit, "vec_id long, embedding array<double>, cells array<int>, block int"), "visits")
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    dealt = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    pieces = parts.select(F.col("block").alias("of"), F.col("parts").alias("pieces"))
    held = held.join(pieces, F.col("block") == F.col("of")).select("vec_id", "embedding", "cell", F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("of_part"))

    def rank(ask: pd.DataFrame, hold: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ask) and len(hold):
            hold = hold.sort_values("vec_id", kind="stable")
            ids, cells = hold["vec_id"].to_numpy(), hold["cell"].to_numpy()
            vectors = np.array(hold["embedding"].tolist(), dtype=float)
            flags = np.zeros(n_cells, dtype=bool)
            for query, vector, own in zip(ask["vec_id"], ask["embedding"], ask["cells"]):
                flags[own] = True
                at = np.flatnonzero(flags[cells] & (ids != query))
                flags[own] = False
                score = np.sqrt(((vectors[at] - np.asarray(vector, dtype=float)) ** 2).sum(1))
                best = np.argsort(score, kind="stable")[:k]
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = dealt.groupBy("block", "part").cogroup(held.groupBy("of_block", "of_part")).applyInPandas(rank, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = stored(out, "nearest")
    discard(indexed, asked)
    return out
