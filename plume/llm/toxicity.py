"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm.common import discard, for_python, remembered, slices, stored, to_driver, unit_hash, whole_ids

LETTERS = re.compile(r"[^\W\d_]+")
#: Hashed terms; each word gives itself and its first four and six letters.
BUCKETS = 1 << 18
PREFIXES = (4, 6)
#: Terms of the greatest association with the label that the machine keeps.
TERMS = 4096
FACTORS = 8
#: Most labelled documents that a model is fitted on, the least by a hash of doc_id.
FIT_ROWS = 12_000
REMEMBERED_WORDS = 200_000


class Terms(dict):
    """The hashed terms of a word as bytes, remembered."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        parts = [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n), *(f"{n}:{word}" for n in PREFIXES if len(word) == n)]
        found = np.array([zlib.crc32(p.encode()) % BUCKETS for p in parts], dtype=np.uint32).tobytes()
        self[word] = found
        return found


def terms_of(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a whole text; none for a null or empty one."""
    words, known = set(LETTERS.findall((text or "").lower())), remembered("terms", Terms)
    return np.unique(np.frombuffer(b"".join([known[w] for w in words]), dtype=np.uint32))


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>)."""

    place: np.ndarray  # of each hashed term among the kept ones, or -1
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        at = self.place[ids]
        at = at[at >= 0]
        v = self.factor[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        margin = self.bias + float(self.weight[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def associated(seen: np.ndarray, seen_positive: np.ndarray, n: int, positive: float) -> np.ndarray:
    """The ``TERMS`` hashed terms with the greatest chi-squared statistic against the label, in order.

    ``seen`` has how many of the n rows hold each term, ``seen_positive``
    how many of the positive ones.
    """
    expected = seen * positive / n
    chi = np.where((seen >= 3) & (seen < n), (seen_positive - expected) ** 2 / np.maximum(expected * (1 - seen / n) * (1 - positive / n), 1e-9), 0)
    kept = np.sort(np.argsort(-chi, kind="stable")[:TERMS])
    return kept[chi[kept] > 0]


def fit(rows: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """A factorization machine fitted by mini-batch AdaGrad on the logistic loss.

    ``rows`` has the places of each row's terms among ``kept``. With labels of one kind only, the
    score is their share.
    """
    place = np.full(BUCKETS, -1, dtype=np.int32)
    n, positive = len(labels), float(labels.sum())
    share = (positive + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if not 0 < positive < n:
        return Machine(place, bias, np.zeros(0), np.zeros((0, FACTORS)))
    place[kept] = np.arange(len(kept))
    at = np.concatenate(rows).astype(np.int64)
    starts = np.cumsum([0, *(len(r) for r in rows)])

    random = np.random.default_rng(seed)
    weight, factor = np.zeros(len(kept)), random.normal(0, 0.01, (len(kept), FACTORS))
    sum_w, sum_v, sum_b = np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(n)
        for part in np.array_split(order, max(1, n // batch)):
            lengths = starts[part + 1] - starts[part]
            row = np.repeat(np.arange(len(part)), lengths)
            ids = np.concatenate([at[starts[i] : starts[i + 1]] for i in part])
            v = factor[ids]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, row, v)
            squares = np.bincount(row, weights=(v**2).sum(axis=1), minlength=len(part))
            margin = bias + np.bincount(row, weights=weight[ids], minlength=len(part)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]
            used, inverse = np.unique(ids, return_inverse=True)
            grad_w = np.bincount(inverse, weights=slope[row], minlength=len(used)) / len(part) + decay * weight[used]
            grad_v = np.zeros((len(used), FACTORS))
            np.add.at(grad_v, inverse, slope[row, None] * (sums[row] - v))
            grad_v = grad_v / len(part) + decay * factor[used]
            grad_b = slope.mean()
            sum_w[used] += grad_w**2
            sum_v[used] += grad_v**2
            sum_b += grad_b**2
            weight[used] -= rate * grad_w / np.sqrt(sum_w[used])
            factor[used] -= 0.3 * rate * grad_v / np.sqrt(sum_v[used])
            bias -= rate * grad_b / np.sqrt(sum_b)
    return Machine(place, float(bias), weight, factor)


def labelled_terms(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """label and hashed terms of at most ``rows`` labelled documents outside the held-out fifth."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(unit_hash(F.lit("toxic"), F.col("doc_id")), "doc_id").limit(rows)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["toxic"].astype("int32"), "terms": [terms_of(t).astype(np.int32) for t in frame["text"]]})

    # picked has at most ``rows`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInPandas(read, "label int, terms array<int>")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """A score for every row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    The machine is fitted on at most ``rows`` of the labelled documents
    whose crc32(doc_id as text) mod 5 isn't 0; scores depend on the text
    alone. A null or empty text has no terms and gets the score of the bias.
    A null doc_id isn't held out. Repeated rows get equal scores; with no
    usable label every score is 0.5 or the labels' share. Columns besides
    doc_id, text and (in ``labels``) doc_id, toxic aren't read.
    """
    spark = docs.sparkSession
    sample = stored(labelled_terms(docs, labels, rows), "labelled")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    # one row per hashed term, BUCKETS at most
    counts = to_driver(sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("positive")))
    seen, seen_positive = (np.bincount(counts["term"], weights=counts[c], minlength=BUCKETS) for c in ("n", "positive"))
    kept = associated(seen, seen_positive, max(n, 1), float(positive))
    places = spark.sparkContext.broadcast(kept)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [np.flatnonzero(np.isin(places.value, t, assume_unique=True)).astype(np.int32) for t in frame["terms"]]
            yield pd.DataFrame({"label": frame["label"].astype("int32"), "at": held})

    # at most ``rows`` rows, of the kept terms only
    chosen = to_driver(sample.mapInPandas(reduce, "label int, at array<int>"))
    discard(sample)
    # the order in which rows arrive must not change the model
    chosen = chosen.assign(key=[(len(t), zlib.crc32(np.asarray(t, dtype=np.int32).tobytes())) for t in chosen["at"]]).sort_values(["key", "label"])
    machine = fit([np.asarray(t, dtype=np.int64) for t in chosen["at"]], chosen["label"].to_numpy(dtype=float), kept)
    model = spark.sparkContext.broadcast(machine)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            scores = np.array([model.value.score(terms_of(t)) for t in frame["text"]], dtype=float)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": scores})

    scored = whole_ids(for_python(docs).mapInPandas(score, "doc_id string, score double"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return stored(scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")), "toxicity")
