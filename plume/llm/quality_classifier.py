"""Quality by importance resampling with hashed n-gram models."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm.common import KEYS, for_python, remembered, slices, stored, to_driver, unit_hash, whole_ids, with_keys

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 15
#: Most labelled documents that the target model is fitted on.
FIT_ROWS = 20_000
#: Most n-grams that a text counts for, about.
EVIDENCE = 50.0
#: 1 samples in proportion to the weights; towards 0 the best are taken.
TEMPERATURE = 1.0
REMEMBERED_WORDS = 200_000


class Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        self[token] = value = zlib.crc32(token.encode())
        return value


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of a text's tokens and pairs of neighbours.

    Tokens are lower-case words and runs of other marks. A token that
    repeats the one before it gives one bucket, whichever it is.
    """
    tokens = TOKEN.findall((text or "").lower())
    known = remembered("tokens", Hashes)
    one = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) % np.uint64(0xFFFFFFFB)
    buckets = np.concatenate([one % np.uint64(BUCKETS - 1) + np.uint64(1), two % np.uint64(BUCKETS - 1) + np.uint64(1)])
    buckets[len(one) :][one[:-1] == one[1:]] = 0
    return buckets.astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; each task sends its sums only."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for frame in slices(frames):
            total += np.bincount(np.concatenate([ngrams(t) for t in frame["text"]]), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": total[used]})

    rows = to_driver(docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
    return out


def top_threshold(df: DataFrame, key: str, most: int) -> float:
    """The key of the ``most``-th row from above, found by counting in ever smaller ranges."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    need = most
    while low is not None and low < high:
        width = (high - low) / 512
        if width == 0 or low + width == low:
            break
        part = F.least(F.floor((F.col(key) - low) / width), F.lit(511)).cast("int")
        inside = df.filter(F.col(key).between(low, high)).groupBy(part.alias("part"))
        rows = sorted(inside.agg(F.count("*"), F.min(key), F.max(key)).collect(), reverse=True)
        for _, n, least, largest in rows:
            if need <= n:
                low, high = least, largest
                break
            need -= n
        if need == n:  # all of this range
            return low
    return low


def gumbel_key(log_weight: Column, seed: Column, *row: Column) -> Column:
    """log_weight plus standard Gumbel noise that depends on the seed and the row: the greatest k are a sample by weight."""
    return log_weight - F.log(-F.log(unit_hash(seed, *row)))


def importance_resample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, share: float | None = None, temperature: float = TEMPERATURE, seed: str = "gumbel") -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with doc_id, its keys, n_ngrams, log_weight, key, kept.

    The target model counts hashed n-grams in labelled documents of quality
    1 (at most ``rows`` labelled ones are read, the least by a hash of
    doc_id), the raw model in all documents. With r the mean logarithm of
    target over raw probability of a document's n n-grams, log_weight is
    r * n * E / (n + E) / ``temperature`` with E = ``EVIDENCE``: n-grams of one text depend
    on each other, so that no text counts for more than E of them. The
    sample has ``share`` of all rows, and that of quality 1 among the labels
    read if none is given; Gumbel top-k draws it without replacement in
    proportion to the weights: those of the largest log_weight + noise from
    a hash of seed, doc_id and text.

    Null and empty texts have no n-grams and log_weight 0, the raw average:
    they are drawn like any. Equal rows have one key; rows that tie at the last place
    are all kept. With labels of one kind only, or none, every row is kept, unless ``share`` is
    given. Columns besides doc_id, text and (in ``labels``) doc_id, quality
    aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = usable.orderBy(unit_hash(F.lit("quality"), F.col("doc_id")), "doc_id").limit(rows)
    good, all_ = picked.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("*")).first()
    if share is None:
        share = good / all_ if good else 1.0

    raw = bucket_counts(docs) + 0.5
    # picked has at most ``rows`` rows of two numbers
    target = bucket_counts(docs.join(F.broadcast(picked.filter("quality = 1")), "doc_id", "left_semi"))
    target = target + 0.5 * (target.sum() + 1) / raw.sum() * raw / raw.mean()
    ratio = spark.sparkContext.broadcast(np.log(target / target.sum()) - np.log(raw / raw.sum()))

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            found = [ratio.value[ngrams(t)] for t in frame["text"]]
            yield frame.drop(columns="text").assign(n_ngrams=[len(x) for x in found], total=[float(x.sum()) for x in found])

    scored = whole_ids(for_python(with_keys(docs), *KEYS).mapInPandas(rate, "doc_id string, id_key long, text_key long, n_ngrams long, total double"))
    weight = F.col("total") * EVIDENCE / (F.col("n_ngrams") + EVIDENCE) / temperature
    scored = scored.withColumn("log_weight", weight).withColumn("key", gumbel_key(F.col("log_weight"), F.lit(seed), F.col("doc_id"), F.col("text_key")))
    scored = stored(scored.select("doc_id", *KEYS, "n_ngrams", "log_weight", "key"), "resample")
    most = round(share * scored.count())
    least = top_threshold(scored, "key", most) if most else np.inf
    return scored.withColumn("kept", F.col("key") >= F.lit(least))
