"""Domain views over the given tables, and the same views as SQL.

Particles come from ``events``, forcing from ``orders``, bathymetry and its
mesh from ``part``, sites from ``supplier`` and profiles from ``embeddings``.
All derived values are integer arithmetic, so that two engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
SPECIES = ("view", "signup", "purchase", "error", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, traj_id, ts, sec, step, lon, lat, z, weight, status, origin_marker, specie."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    specie = F.array_position(F.array(*[F.lit(s) for s in SPECIES]), F.col("event_type")).cast("int") - 1
    return e.withColumn("sec", F.expr(f"timestampdiff(SECOND, timestamp_ntz'{EPOCH}', ts)")).select(
        "event_id",
        F.col("user_id").alias("traj_id"),
        "ts",
        "sec",
        F.floor(F.col("sec") / 3600).alias("step"),
        (12.5 + ((F.col("event_id") * 7919) % 8500) / 1000.0).alias("lon"),
        (68.5 + ((F.col("event_id") * 104729) % 3500) / 1000.0).alias("lat"),
        (-F.least("value", F.lit(299.0))).alias("z"),
        F.col("value").alias("weight"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("status"),
        (F.col("user_id") % 4).cast("int").alias("origin_marker"),
        specie.alias("specie"),
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of ``particles`` per trajectory and step: that of the least event_id."""
    p = particles(spark, sf_dir)
    row = F.min_by(F.struct(*[c for c in p.columns if c not in ("traj_id", "step")]), F.col("event_id"))
    return p.groupBy("traj_id", "step").agg(row.alias("r")).select("traj_id", "step", "r.*")


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per time: sec, x_wind, y_wind, sst."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    key = F.col("o_orderkey")
    o = o.select(
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) * 1080).cast("bigint").alias("sec"),
        key,
        ((key * 31) % 400 / 10.0 - 20.0).alias("x_wind"),
        ((key * 17) % 400 / 10.0 - 20.0).alias("y_wind"),
        ((key * 13) % 250 / 10.0 - 1.0).alias("sst"),
    )
    return o.groupBy("sec").agg(F.min_by(F.struct("x_wind", "y_wind", "sst"), key).alias("f")).select("sec", "f.*")


def bathymetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ix, iy, depth on a lattice of 50 columns."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return p.select((F.col("p_partkey") % 50).alias("ix"), F.floor(F.col("p_partkey") / 50).alias("iy"), (F.col("p_retailprice") - 850).alias("depth"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"))
    return s.select("site_id", (12.5 + (F.col("site_id") * 7919 % 8500) / 1000.0).alias("lon"), (68.5 + (F.col("site_id") * 104729 % 3500) / 1000.0).alias("lat"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile_id, grp, level, value: an embedding as values by level."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("profile_id"), F.col("label").alias("grp"), F.transform("embedding", lambda v: v.cast("double")).alias("values"))


#: The same views in SQL, for the WITH clause of a query.
SQL = {
    "particles": """particles AS (SELECT event_id, user_id AS traj_id, ts,
  CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000e0) AS BIGINT) AS sec,
  CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000e0) AS BIGINT) AS step,
  12.5e0 + ((event_id * 7919) % 8500) / 1000e0 AS lon, 68.5e0 + ((event_id * 104729) % 3500) / 1000e0 AS lat,
  -least(value, 299e0) AS z, value AS weight, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS status,
  CAST(user_id % 4 AS INT) AS origin_marker,
  CAST(list_position(['view', 'signup', 'purchase', 'error', 'click'], event_type) AS INT) - 1 AS specie FROM events)""",
    "track": """track AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, step ORDER BY event_id) AS rn FROM particles) WHERE rn = 1)""",
    "forcing": """forcing AS (SELECT sec, x_wind, y_wind, sst FROM (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY o_orderkey) AS rn FROM (
  SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1080 AS BIGINT) AS sec, o_orderkey,
  (o_orderkey * 31) % 400 / 10e0 - 20e0 AS x_wind, (o_orderkey * 17) % 400 / 10e0 - 20e0 AS y_wind, (o_orderkey * 13) % 250 / 10e0 - 1e0 AS sst FROM orders)) WHERE rn = 1)""",
    "bathymetry": """bathymetry AS (SELECT p_partkey % 50 AS ix, CAST(floor(p_partkey / 50e0) AS BIGINT) AS iy, p_retailprice - 850 AS depth FROM part)""",
    "sites": """sites AS (SELECT s_suppkey AS site_id, 12.5e0 + (s_suppkey * 7919 % 8500) / 1000e0 AS lon, 68.5e0 + (s_suppkey * 104729 % 3500) / 1000e0 AS lat FROM supplier)""",
    "profiles": """profiles AS (SELECT vec_id AS profile_id, label AS grp, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS values FROM embeddings)""",
}


def with_views(names: str, body: str) -> str:
    """``body`` after a WITH clause of the named views and those that they need."""
    wanted = names.split()
    if "track" in wanted and "particles" not in wanted:
        wanted.insert(0, "particles")
    return "WITH " + ", ".join(SQL[n] for n in wanted) + " " + body
