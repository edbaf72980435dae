"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``, or the checkpoint folder
    of the context. Only a local session, where there is one machine, may do
    without both; its folder is beside its warehouse.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return context.getCheckpointDir()


#: Rows of a batch that goes to Python at once.
BATCH_ROWS = 500
#: While a step runs: small batches of long texts; its shuffle files go when it is written.
STEP_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Runs an action under ``STEP_SETTINGS``; the caller's settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in STEP_SETTINGS}
    for k, v in STEP_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage: a lost executor costs its running tasks, not the
    steps before the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with step(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    for made in _scratch:
        made.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Lists the tables that :func:`stored` makes meanwhile, so that they can be discarded once their result is written."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.remove(made)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing will read again, if they are still there."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def to_driver(df: DataFrame) -> pd.DataFrame:
    """A small result of a Python step."""
    with step(df.sparkSession):
        return df.toPandas()


#: Characters of texts that a worker holds in arrays at once; a longer text is alone.
SLICE_CHARS = 2_000_000


def slices(frames: Iterator[pd.DataFrame], most: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` (text and others) in parts of at most ``most`` characters, or of one row."""
    for frame in frames:
        start = held = 0
        for at, size in enumerate(len(t) if t else 0 for t in frame["text"]):
            if at > start and held + size > most:
                yield frame.iloc[start:at]
                start, held = at, 0
            held += size
        if start < len(frame):
            yield frame.iloc[start:]


def for_python(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as text, text and ``more``: pandas would round large ids next to missing ones."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *more)


def whole_ids(df: DataFrame) -> DataFrame:
    """``df`` with doc_id as a number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


_held: list = [None, None]


def remembered(owner: str, make: Callable):
    """What ``owner`` remembers in this worker; what another operator remembered is dropped.

    A worker serves one operator after another, so that their memories
    would add up.
    """
    if _held[0] != owner:
        _held[:] = [owner, None]
        _held[1] = make()
    return _held[1]


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def unit_hash(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone (52 bits of MD5)."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with id_key and text_key, which tell rows apart by doc_id and text, nulls too.

    Rows of equal keys are equal in both.
    """
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull(), F.col("text").isNull())
    return docs.withColumn("id_key", id_key.cast("long")).withColumn("text_key", text_key)


KEYS = ["id_key", "text_key"]
#: Up to so many keys (a few tens of MB with their numbers) are broadcast; beyond, they are joined by shuffle.
BROADCAST_KEYS = 250_000


def by_keys(docs: DataFrame, marks: DataFrame, how: str, keys: list[str] = KEYS) -> DataFrame:
    """``docs`` (with keys) joined with ``marks`` (keys and a few numbers, one row each); the size of ``marks`` is counted first."""
    return docs.join(F.broadcast(marks) if marks.count() <= BROADCAST_KEYS else marks, keys, how)
