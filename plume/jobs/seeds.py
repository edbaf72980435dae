"""Queries on seeds, each with the same result in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.functions import geo
from plume.jobs.grids import RING, uniform_sql
from plume.jobs.tracks import METRES, joined, vincenty_sql
from plume.operators import joins, seeding
from plume.operators.seeding import hash_uniform
from plume.sources.fixtures import bathymetry, sites, table, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r(c: Column | str, digits: int, name: str) -> Column:
    return F.round(c, digits).alias(name)


def text(*names: str) -> list[str]:
    return [f"'{n}'" for n in names]


def normal_sql(*parts: str) -> str:
    return f"sqrt(-2 * ln({uniform_sql(*parts, *text('r'))})) * cos(2 * pi() * {uniform_sql(*parts, *text('a'))})"


@query(joined("sites", f", k AS (SELECT site_id, unnest(range(0, 25)) AS k FROM sites), x AS (SELECT *, 500 * {normal_sql('site_id', 'k', *text('x'))} AS x, 500 * {normal_sql('site_id', 'k', *text('y'))} AS y FROM k) SELECT site_id, k, round(sqrt(x * x + y * y), 2) AS distance, CAST(floor(3600 * k * 10 / 24e0) AS BIGINT) AS release_sec FROM x"))
def seed_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 places around each site at normal distances, released evenly over ten hours; the distance is measured on the ellipsoid."""
    s = seeding.gaussian(sites(spark, sf_dir), 25, 500.0, 10 * 3600)
    d = geo.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("seed_lon"), F.col("seed_lat"))["distance"]
    return s.select("site_id", F.col("k").cast("bigint").alias("k"), r(d, 2, "distance"), "release_sec")


SEGMENT = "SELECT site_id, lon, lat, lon + 0.3e0 AS lon2, lat + 0.1e0 AS lat2 FROM sites"


@query(joined("sites", f", d AS ({vincenty_sql(SEGMENT, 'lon', 'lat', 'lon2', 'lat2', 'site_id')}), k AS (SELECT *, unnest(range(0, 6)) AS k FROM d), t AS (SELECT *, unnest(range(0, 4)) AS n FROM k) SELECT site_id, k, n * 10800 AS release_sec, round(distance * k / 5, 2) AS distance FROM t"))
def seed_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six places along a segment from each site, released every three hours."""
    s = seeding.repeated_segment(sites(spark, sf_dir), F.col("lon") + 0.3, F.col("lat") + 0.1, 6, 4, 10800)
    d = geo.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("seed_lon"), F.col("seed_lat"))["distance"]
    return s.select("site_id", F.col("k").cast("bigint").alias("k"), F.col("release_sec").cast("bigint").alias("release_sec"), r(d, 2, "distance"))


AREA = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]))) / 2
X0, X1, Y0, Y1 = min(x for x, _ in RING), max(x for x, _ in RING), min(y for _, y in RING), max(y for _, y in RING)


def within_sql(x: str, y: str) -> str:
    parts = [f"CASE WHEN ({y1}e0 > {y}) <> ({y2}e0 > {y}) AND {x} < ({y} - {y1}e0) * ({x2}e0 - {x1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1])]
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query(joined("sites", f""", n AS (SELECT site_id, 20 + site_id % 30 AS number, sqrt({AREA!r}::DOUBLE / (20 + site_id % 30)) AS d FROM sites),
g AS (SELECT *, CAST(floor({X1 - X0!r}::DOUBLE / d) AS BIGINT) AS nx, CAST(floor({Y1 - Y0!r}::DOUBLE / d) AS BIGINT) AS ny FROM n), i AS (SELECT *, unnest(range(0, ny)) AS j FROM g), k AS (SELECT *, unnest(range(0, nx)) AS i FROM i),
p AS (SELECT *, {X0}e0 + d / 2 + i * ({X1 - X0!r}::DOUBLE - d) / greatest(nx - 1, 1) AS x, {Y0}e0 + d / 2 + j * ({Y1 - Y0!r}::DOUBLE - d) / greatest(ny - 1, 1) AS y FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY j, i) - 1 AS k, count(*) OVER (PARTITION BY site_id) AS inside FROM p WHERE {within_sql('x', 'y')}),
c AS (SELECT *, unnest(range(k, number, inside)) AS id FROM q WHERE k < number)
SELECT site_id, id, round(x, 6) AS x, round(y, 6) AS y FROM c"""))
def seed_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted number of places on a regular lattice within a polygon: too many are cut off, too few start again from the first."""
    s = sites(spark, sf_dir).select("site_id", (20 + F.col("site_id") % 30).alias("number"))
    out = seeding.lattice_in_ring(s, "site_id", RING)
    return out.select("site_id", "id", r("x", 6, "x"), r("y", 6, "y"))


@query(joined("sites bathymetry", ", s AS (SELECT site_id, CAST(floor((lon - 12.5e0) * 5) AS BIGINT) AS ix, CAST(floor((lat - 68.5e0) * 10) AS BIGINT) AS iy FROM sites) SELECT site_id, round(2.5e0 - coalesce(depth, 100), 6) AS z FROM s LEFT JOIN bathymetry USING (ix, iy)"))
def seed_seafloor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds 2.5 m above the sea floor, or that of 100 m where there is no bathymetry."""
    s = sites(spark, sf_dir).select("site_id", F.floor((F.col("lon") - 12.5) * 5).alias("ix"), F.floor((F.col("lat") - 68.5) * 10).alias("iy"))
    s = s.join(bathymetry(spark, sf_dir), ["ix", "iy"], "left")
    return s.select("site_id", r(2.5 - F.coalesce("depth", F.lit(100.0)), 6, "z"))


SPECIES = f"CASE WHEN u < 0.35e0 THEN 0 WHEN u < 0.725e0 THEN 1 WHEN u < 0.9e0 THEN 2 ELSE 3 END"


@query(f"WITH u AS (SELECT event_id, user_id, value, {uniform_sql('event_id', *text('specie'))} AS u FROM events) SELECT CAST(user_id % 4 AS INT) AS origin, CAST({SPECIES} AS INT) AS specie, count(*) AS n, round(sum(value * 870 / 3600), 7) AS mass FROM u GROUP BY ALL")
def seed_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements dealt to species by shares, with the oil's mass of a release in m3 an hour over a second."""
    u = hash_uniform(F.col("event_id"), F.lit("specie"))
    specie = seeding.by_shares(F.col("u"), (0.35, 0.375, 0.175, 0.1))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("origin"), "value", u.alias("u"))
    return e.groupBy("origin", specie.alias("specie")).agg(F.count("*").alias("n"), r(F.sum(F.col("value") * 870 / 3600), 7, "mass"))


DRAWS = "[" + ", ".join(normal_sql("event_id", str(k), *text("lee")) for k in range(6)) + "]"


@query(f"WITH d AS (SELECT event_id, list_filter({DRAWS}, lambda x: abs(x) <= 1.5) AS ok FROM events) SELECT event_id, round(1.1e0 + 0.2e0 * coalesce(ok[1], 0), 6) AS slope, len(ok) AS fit FROM d")
def seed_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coefficient from a normal law, drawn again while it is too far off, up to six times."""
    e = table(spark, sf_dir, "events").select("event_id")
    ok = F.filter(F.array(*[seeding.hash_normal(F.col("event_id"), F.lit(k), F.lit("lee")) for k in range(6)]), lambda x: F.abs(x) <= 1.5)
    e = e.withColumn("ok", ok)
    return e.select("event_id", r(1.1 + 0.2 * F.coalesce(F.get("ok", F.lit(0)), F.lit(0.0)), 6, "slope"), F.size("ok").cast("bigint").alias("fit"))


PLACED = ", w AS (SELECT ix, iy, 12 + ix * 0.02e0 AS lon, 68 + iy * 0.01e0 AS lat, depth FROM bathymetry), l AS (SELECT * FROM w WHERE depth <= 80), o AS (SELECT * FROM w WHERE depth > 80), n AS (SELECT l.ix, l.iy, o.ix AS to_ix, o.iy AS to_iy, " + METRES.format(a="l", b="o") + " AS d, o.iy * 50 + o.ix AS node FROM l, o), q AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, node) AS rn FROM n)"


@query(joined("bathymetry", PLACED + " SELECT ix, iy, node, round(d, 3) AS distance FROM q WHERE rn = 1"))
def seeds_off_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on land moved to the closest cell of the sea, however far."""
    w = bathymetry(spark, sf_dir).select("ix", "iy", (12 + F.col("ix") * 0.02).alias("lon"), (68 + F.col("iy") * 0.01).alias("lat"), "depth", (F.col("iy") * 50 + F.col("ix")).alias("node"))
    land = w.filter("depth <= 80").select("ix", "iy", "lon", "lat", F.col("node").alias("seed"))
    sea = w.filter("depth > 80").select("node", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return joins.nearest(land, sea, "seed", "node", 1500.0).select("ix", "iy", "node", r("distance", 3, "distance"))


@query(joined("sites", ", s AS (SELECT site_id, unnest(range(0, 3 + site_id % 5)) AS k FROM sites) SELECT site_id, k, row_number() OVER (ORDER BY site_id, k) AS id FROM s"))
def seed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 1 on over all releases: each release's offset from one row per release, and its own count."""
    s = sites(spark, sf_dir).select("site_id", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 + F.col("site_id") % 5)).alias("k"))
    return seeding.numbered(s, "site_id", "k").select("site_id", "k", "id")
