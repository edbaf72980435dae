"""State of two steps per particle in a stream: the row before, until the particle is silent for too long."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plume.sources.stores import new_path

SCHEMA = "traj_id long, step long, dz double, phase string"
#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Displacement(StatefulProcessor):
    """Each row's change of z since the row before of its particle.

    The state is one step and z for each particle that is alive. A timer of
    ``gap`` hours after the last row ends it: the particle is told as lost
    and its state goes, so that state is bounded by the live particles.
    """

    def __init__(self, gap: int, origin: int) -> None:
        self.gap, self.origin = gap, origin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "step long, z double")

    def end_of(self, step: int) -> int:
        """Milliseconds of the time at which a particle last seen at ``step`` is lost."""
        return self.origin + (step + self.gap) * 3_600_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("step")
        step, z = self.last.get() if self.last.exists() else (None, None)
        if step is not None:
            self.handle.deleteTimer(self.end_of(step))
        out = []
        for new_step, new_z in zip(frame["step"].tolist(), frame["z"].tolist()):
            if step is not None and new_step <= step:
                continue  # late: later steps have been told already
            if step is not None and new_step - step >= self.gap:
                out.append((key[0], step + self.gap, None, "lost"))
                step = None
            out.append((key[0], new_step, None if step is None else new_z - z, "activated" if step is None else "continuing"))
            step, z = new_step, new_z
        self.last.update((step, z))
        self.handle.registerTimer(self.end_of(step))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lost = []
        if self.last.exists():
            step, _ = self.last.get()
            if self.end_of(step) <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                lost = [(key[0], step + self.gap, None, "lost")]
        yield self.frame(lost)

    def close(self) -> None:
        pass

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["traj_id", "step", "dz", "phase"]).astype({"traj_id": "int64", "step": "int64", "dz": "float64", "phase": "object"})


def displacements(steps: DataFrame, gap: int, origin: int, late: str = "0 seconds") -> DataFrame:
    """traj_id, step (hours), dz, phase of a stream of ``steps`` (traj_id, step, z, at: the step as a time, ``origin`` milliseconds at step 0).

    phase is activated (no row within ``gap`` hours before; dz is null),
    continuing, or lost, once, ``gap`` hours after a particle's last row.
    Rows of one particle are taken in order within a batch; rows that come
    after later steps of their particle were told are dropped.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stream's own Python process need not find this module
    grouped = steps.withWatermark("at", late).groupBy("traj_id")
    return grouped.transformWithStateInPandas(statefulProcessor=Displacement(gap, origin), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Everything that ``stream`` gives for what is there now, written to the shared folder; offsets and state go beside it, so that a lost run goes on."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(stream.schema).parquet(path)


def in_batches(rows: DataFrame, label: str, order: str, files: int) -> DataFrame:
    """A stream of ``rows`` in about ``files`` batches, in ascending ranges of ``order``, as time would bring them.

    Each range is appended after the one before, since a file stream takes
    files by the time of their writing.
    """
    path = new_path(rows.sparkSession, label)
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, width = ends["low"] or 0, ((ends["high"] or 0) - (ends["low"] or 0)) // files + 1
    for k in range(files):
        part = rows.filter((F.col(order) >= low + k * width) & (F.col(order) < low + (k + 1) * width))
        part.hint("rebalance").write.mode("append").parquet(path)
    n = max(1, rows.sparkSession.read.parquet(path).select(F.input_file_name()).distinct().count() // files)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).parquet(path)
