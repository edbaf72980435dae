"""A corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Between stages the result is
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.llm.common import KEYS, by_keys, discard, scratch, stored, table, with_keys
from plume.llm.mixing import mix_sources
from plume.llm.near_duplicates import one_of_each_group
from plume.llm.packing import pack_documents
from plume.llm.personal import redact
from plume.llm.quality_classifier import importance_resample


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that importance resampling rejects.

    Null and empty texts are drawn at the average weight; equal rows stay or go together; an
    empty table stays empty, and without labels of quality 1 all rows stay.
    """
    judged = importance_resample(docs, table(spark, sf_dir, "labels"))
    return by_keys(with_keys(docs), stored(judged.filter(~F.col("kept")).select(KEYS).distinct(), "rejected"), "left_anti").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), that of the smallest doc_id.

    Nulls, repeated rows and empty tables: see :func:`one_of_each_group`.
    """
    return one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind; n_chars follows.

    All rows stay, repeated ones too; null and empty texts as they are.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Rows without words are left out, as they add none. Equal rows of a
    source get the copies of all of them; a null source is a source. An
    empty table stays empty.
    """
    keys = [*KEYS, "of_source"]
    copies = mix_sources(docs).withColumn("of_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    copies = copies.groupBy(keys).agg(F.count("*").alias("n"), *[F.sum((F.col("copies") >= k).cast("int")).alias(f"of_{k}") for k in (1, 2)])
    copies = stored(copies.filter("of_1 > 0"), "copies")
    rows = with_keys(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", *KEYS)
    rows = rows.withColumn("of_source", F.coalesce(F.concat(F.lit("s"), "row.source"), F.lit("")))
    single = by_keys(rows, copies.filter("n = 1"), "inner", keys).select("row", (F.col("of_1") + F.col("of_2")).alias("taken"))
    # of n equal rows the first take what all of them take
    equal = Window.partitionBy(keys).orderBy(F.monotonically_increasing_id())
    several = by_keys(rows, copies.filter("n > 1"), "inner", keys).withColumn("turn", F.row_number().over(equal))
    taken = (F.col("turn") <= F.col("of_1")).cast("int") + (F.col("turn") <= F.col("of_2")).cast("int")
    rows = single.union(several.select("row", taken))
    return rows.filter("taken > 0").select("row", F.explode(F.sequence(F.lit(1), "taken"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near duplicates", deduplicate), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]

#: SQL can't express the fitted models, the sketches or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage has written on its way is deleted once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as made:
            out = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*[t for t in made if t.stored_path != out.stored_path], *[docs] * hasattr(docs, "stored_path"))
        docs = out
    return docs
