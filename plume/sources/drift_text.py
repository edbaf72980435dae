"""The text form of drift runs: a header, and for each output step a block of times, mean position and particles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.sources.stores import new_path

#: States in the file of statuses 0 (active) and 1 (stranded), and of particles without a place (fixed values).
ACTIVE, STRANDED = 11, 41


@dataclass(frozen=True)
class Run:
    """What the header tells: start (yyyy-mm-dd hh:mm:ss), minutes of a step, object class, seeding (time, lon, lat, radius in km) at both ends."""

    start: str
    minutes: int
    object_id: int
    object_name: str
    seeded: tuple[tuple[str, float, float, float], tuple[str, float, float, float]]
    seed_minutes: int = 0


def header(run: Run, steps: int, particles: int) -> str:
    """The lines before the first block."""
    seed_steps = max(1.0, run.seed_minutes / run.minutes)
    date, time = run.start.split(" ")
    lines = [
        "# Drift simulation initiated [UTC]:", "simDate simTime", f"{date}\t{time}\t#", "# Model version:", "modelVersion", " 3.00", "# Object class id & name:", "objectClassId  objectClassName", f" {run.object_id}\t{run.object_name}",
        "# Seeding start time, position & radius:", "startDate\tstartTime\tstartLon\tstartLat\tstartRad", "\t".join(str(v) for v in run.seeded[0]), "# Seeding end time, position & radius:", "endDate\tendTime\tendLon\tendLat\tendRad", "\t".join(str(v) for v in run.seeded[1]),
        "# Duration of seeding [min] & [timesteps]:", "seedDuration   seedSteps", f"    {run.seed_minutes}      {int(seed_steps)}", "# Length of timestep [min]:", "timeStep", f"{run.minutes}", "# Length of model simulation [min] & [timesteps]:", "simLength  simSteps", f"{run.minutes * (steps - 1)}\t{steps}",
        "# Total no of seeded particles:", "seedTotal", f" {particles}", "# Particles seeded per timestep:", "seedRate", f" {int(particles / seed_steps)}",
    ]
    return "\n".join(lines)


def blocks(rows: DataFrame, run: Run) -> DataFrame:
    """step, id (0), value: the lines at the head of each step's block, from step 0 to the last one that has rows."""
    active = F.col("status") == 0
    sums = rows.groupBy("step").agg(F.count("*").alias("n"), F.avg(F.when(active, F.col("lon"))).alias("lon"), F.avg(F.when(active, F.col("lat"))).alias("lat"))
    every = rows.agg(F.max("step").alias("last")).filter("last is not null").select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("step"))
    sums = every.join(sums, "step", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seeded = F.col("n") - F.coalesce(F.lag("n").over(Window.orderBy("step")), F.lit(0))  # one row per step
    now = F.date_format(F.expr(f"timestampadd(MINUTE, step * {run.minutes}, timestamp_ntz'{run.start}')"), "yyyy-MM-dd'\t'HH:mm:ss")
    mean = lambda c: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.6f", F.col(c)))
    lines = [
        F.lit("\n# Date [UTC]:\nnowDate   nowTime"), now, F.lit("# Time passed [min] & [timesteps], now seeded, seeded so far:\ntimePassed  nStep   nowSeeded   nSeeded"),
        F.format_string("  %d\t%d\t%d\t%d", F.col("step") * run.minutes, F.col("step") + 1, seeded, F.col("n")), F.lit("# Mean position:\nmeanLon meanLat"), F.concat(mean("lon"), F.lit("\t"), mean("lat")), F.lit("# Particle data:\nid  lon lat state   age orientation"),
    ]
    return sums.select("step", F.lit(0).cast("bigint").alias("id"), F.concat_ws("\n", *lines).alias("value"))


def particle_line() -> Column:
    """A particle: id, place (shortest form of 32-bit numbers, 0 for none), state, age in minutes, orientation."""
    lost = F.col("lon").isNull() | F.col("lat").isNull()
    place = lambda c: F.when(lost, F.lit("0.0")).otherwise(F.col(c).cast("float").cast("string"))
    state = F.when(lost, STRANDED).when(F.col("status") == 0, ACTIVE).when(F.col("status") == 1, STRANDED).otherwise(F.col("status"))
    return F.concat_ws("\t", F.col("id").cast("string"), place("lon"), place("lat"), state.cast("string"), F.col("age").cast("bigint").cast("string"), F.when(lost, 0).otherwise(F.col("orientation")).cast("string"))


def write_drift(rows: DataFrame, run: Run, files: int = 8) -> str:
    """The folder that ``rows`` (step, id, lon, lat, status, age, orientation) are written to; its files, by name, are the text.

    Lines are dealt to files by ranges of step and id and sorted within
    them, so that no task writes the whole and a large step is many tasks.
    """
    size = rows.agg(F.coalesce(F.max("step") + 1, F.lit(0)).alias("steps"), F.countDistinct("id").alias("particles")).first()
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("step"), F.lit(0).cast("bigint").alias("id"), F.lit(header(run, size["steps"], size["particles"])).alias("value"))
    lines = head.unionByName(blocks(rows, run)).unionByName(rows.select(F.col("step").cast("bigint"), F.col("id").cast("bigint"), particle_line().alias("value")))
    path = new_path(spark, "drift")
    lines.repartitionByRange(files, "step", "id").sortWithinPartitions("step", "id").select("value").write.text(path)
    return path


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    """step, id, lon, lat, state, age, orientation of every particle line of drift files.

    A particle's step is that of the last head of a block before it. Within a
    split of a file that is found by a window; what a split begins with
    comes from the splits before, of which one row each is ordered as a whole.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("split"), F.monotonically_increasing_id().alias("at"))
    told = F.regexp_extract("value", r"^  [0-9]+\t([0-9]+)\t-?[0-9]+\t[0-9]+$", 1)
    lines = lines.withColumn("head", F.when(told != "", told.cast("bigint") - 1))
    ends = lines.filter("head is not null").groupBy("split").agg(F.max_by("head", "at").alias("last"))
    splits = lines.select("split").distinct().join(ends, "split", "left")
    carried = splits.select("split", F.last("last", ignorenulls=True).over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = F.last("head", ignorenulls=True).over(Window.partitionBy("split").orderBy("at"))
    parts = F.split("value", "\t")
    rows = lines.withColumn("step", within).filter(F.col("value").rlike(r"^[0-9]+\t[^\t]+\t[^\t]+\t[0-9]+\t-?[0-9]+\t-?[0-9]+$")).join(carried, "split")
    field = lambda k, kind: F.get(parts, F.lit(k)).cast(kind)
    return rows.select(F.coalesce("step", "carried").alias("step"), field(0, "bigint").alias("id"), field(1, "double").alias("lon"), field(2, "double").alias("lat"), field(3, "int").alias("state"), field(4, "bigint").alias("age"), field(5, "int").alias("orientation"))
