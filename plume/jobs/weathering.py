"""Queries on chemical fates, oil weathering and living particles, each with the same result in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plume.functions import biology, physics, weathering
from plume.jobs.tracks import NEAREST, PERIOD, R1, R2, R3, SAL, SPEED, joined, with_wind
from plume.operators.seeding import hash_uniform
from plume.sources.fixtures import particles, track, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOUR = 3600.0
#: The environment of each particle: wind w, temperature sst, salinity sal, density of water rho, acidity ph.
ENV = NEAREST + f", env AS (SELECT *, {SPEED} AS w, {SAL} AS sal, {R1} + (4.8314e-4 * {SAL} + {R3} * sqrt({SAL}) + {R2}) * {SAL} + 1028.106331e0 AS rho, 6 + event_id % 30 / 10e0 AS ph FROM near)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_wind(spark, sf_dir).withColumn("sal", 30 + F.col("event_id") % 60 / 10.0).withColumn("ph", 6 + F.col("event_id") % 30 / 10.0)
    return p.withColumn("rho", physics.seawater_density(F.col("sst"), F.col("sal")))


def rounded(digits: int = 8, **columns: Column) -> list[Column]:
    return [F.round(c, digits).alias(name) for name, c in columns.items()]


def arrhenius_sql(t: str, reference: float, enthalpy: float) -> str:
    return f"exp(-({enthalpy}e0 / 8.3145e0) * (1 / ({t} + 273.15e0) - 1 / ({reference} + 273.15e0)))"


@query(joined("particles forcing", ENV + f" SELECT event_id, round({arrhenius_sql('sst', 25, 50000)}, 8) AS arrhenius, round(pow(2e0, (sst - 20) / 10), 8) AS doubling, round(pow(10e0, 0.3e0 * (sal / 68.35e0) * rho * 1e-3), 8) AS salting FROM env"))
def chem_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("sst")
    return environment(spark, sf_dir).select("event_id", *rounded(arrhenius=weathering.arrhenius(t, 25, 50000), doubling=weathering.doubling_per_ten_degrees(t, 20), salting=weathering.salting_out(0.3, F.col("sal"), F.col("rho"))))


KOW, ACID, BASE, NEUTRAL, INITIAL = 3162.0, 4.5, 3.0, 5000.0, 4000.0
ANION, CATION = weathering.ionised_sorption(KOW, ACID)
SHARE = f"(1 / (1 + pow(10e0, ph - {ACID}e0)))"
AMPHOTER = f"(1 / (1 + pow(10e0, ph - {ACID}e0) + {10**BASE!r}e0))".replace("e0e0", "e0")


@query(joined("particles forcing", ENV + f" SELECT event_id, round(({NEUTRAL}e0 * {SHARE} + (1 - {SHARE}) * {ANION!r}e0) / {INITIAL}e0, 8) AS acid, round(({NEUTRAL}e0 * {AMPHOTER} + {AMPHOTER} * pow(10e0, ph - {ACID}e0) * {ANION!r}e0 + {AMPHOTER} * pow(10e0, {BASE}e0 - ph) * {CATION!r}e0) / {INITIAL}e0, 8) AS amphoter, round(0.08e0 * ({SHARE} * {NEUTRAL}e0 + {SHARE} * {KOW}e0 * {10**-3.5!r}e0) / 0.526e0 / {INITIAL}e0, 8) AS dissolved FROM env"))
def koc_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ph = F.col("ph")
    return environment(spark, sf_dir).select(
        "event_id",
        *rounded(
            acid=weathering.sorption_of_acid(ph, ACID, NEUTRAL, INITIAL, KOW),
            amphoter=weathering.sorption_of_amphoter(ph, ACID, BASE, NEUTRAL, INITIAL, KOW),
            dissolved=weathering.sorption_to_dissolved_matter(ph, ACID, NEUTRAL, INITIAL, KOW),
        ),
    )


#: Water species are 0 and 1, sediment species 2 and 3, the rest don't decay; half-lives in hours.
DEGRADED = f"CASE WHEN specie IN (0, 1) THEN weight * (1 - exp({arrhenius_sql('sst', 25, 50000)} * (ln(0.5e0) / (220 * 3600e0) * 3600))) WHEN specie IN (2, 3) THEN weight * (1 - exp({arrhenius_sql('sst', 25, 50000)} * (ln(0.5e0) / (5500 * 3600e0) * 3600))) ELSE 0 END"
HENRY = f"((1.1e-2 * {arrhenius_sql('sst', 25, 55925)}) / (3.1e1 * {arrhenius_sql('sst', 25, 25300)}) * 128.17e0 / 101325e0)"
WATER_FILM = "((9e-4 + 7.2e-6 * w * w * w) * pow(44 / 128.17e0, 0.25e0))"
AIR_FILM = "((0.1e0 + w * sqrt(6.1e0 + 0.63e0 * w) / (13.3e0 * sqrt(0.62e0) + pow(6.1e-4 + 6.3e-5 * w, -0.5e0) - 5 + 1.25e0 * ln(0.62e0))) * pow(18 / 128.17e0, 1 / 3e0))"
RATE = f"(0.01e0 / (1 / {WATER_FILM} + 1 / ({AIR_FILM} * ({HENRY} * (1 + 0.01143e0 * sal) / (8.206e-05 * (sst + 273.15e0))))) / 50)"
FATES = ENV + f", fates AS (SELECT *, {DEGRADED} AS degraded, CASE WHEN specie = 0 AND z >= -50 THEN weight * (1 - exp(-{RATE} * 3600)) ELSE 0 END AS volatilised FROM env)"


def chemical_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles with degraded and volatilised: what one hour takes of their mass."""
    p, t = environment(spark, sf_dir), F.col("sst")
    warm = weathering.arrhenius(t, 25, 50000)
    gone = F.when(F.col("specie").isin(0, 1), weathering.degraded(F.col("weight"), 220, warm, HOUR)).when(F.col("specie").isin(2, 3), weathering.degraded(F.col("weight"), 5500, warm, HOUR)).otherwise(0.0)
    rate = weathering.volatilisation_rate(F.col("wind"), t, F.col("sal"), F.lit(50.0), 128.17, 1.1e-2 * weathering.arrhenius(t, 25, 55925), 3.1e1 * weathering.arrhenius(t, 25, 25300))
    up = F.when((F.col("specie") == 0) & (F.col("z") >= -50), F.col("weight") * (1 - F.exp(-rate * HOUR))).otherwise(0.0)
    return p.withColumns({"degraded": gone, "volatilised": up})


@query(joined("particles forcing", FATES + " SELECT event_id, round(degraded, 8) AS degraded, round(volatilised, 8) AS volatilised FROM fates"))
def chem_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chemical_fates(spark, sf_dir).select("event_id", *rounded(degraded=F.col("degraded"), volatilised=F.col("volatilised")))


@query(joined("particles forcing", FATES + ", bal AS (SELECT CAST(floor(step / 24e0) AS BIGINT) AS day, sum(weight - degraded - volatilised) AS preserved, coalesce(sum(degraded) FILTER (specie IN (0, 1)), 0) AS water, coalesce(sum(degraded) FILTER (specie IN (2, 3)), 0) AS sediment, sum(volatilised) AS air FROM fates GROUP BY 1) SELECT day, round(100 * preserved / (preserved + water + sediment + air), 6) AS preserved, round(100 * water / (preserved + water + sediment + air), 6) AS degraded_water, round(100 * sediment / (preserved + water + sediment + air), 6) AS degraded_sediment, round(100 * air / (preserved + water + sediment + air), 6) AS volatilised FROM bal"))
def chem_mass_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each day's mass that stays, degrades in water or sediment, and goes to the air."""
    p, water = chemical_fates(spark, sf_dir), F.col("specie").isin(0, 1)
    some = lambda c: F.sum(F.when(c, F.col("degraded")).otherwise(0.0))
    b = p.groupBy(F.floor(F.col("step") / 24).alias("day")).agg(F.sum(F.col("weight") - F.col("degraded") - F.col("volatilised")).alias("kept"), some(water).alias("water"), some(F.col("specie").isin(2, 3)).alias("sediment"), F.sum("volatilised").alias("air"))
    share = lambda c: 100 * F.col(c) / (F.col("kept") + F.col("water") + F.col("sediment") + F.col("air"))
    return b.select("day", *rounded(6, preserved=share("kept"), degraded_water=share("water"), degraded_sediment=share("sediment"), volatilised=share("air")))


#: Boiling point (K), molar mass (kg/mol) and mass share of an oil's components: made-up values of a light crude.
COMPONENTS = ((350.0, 0.09, 0.2), (420.0, 0.13, 0.3), (520.0, 0.2, 0.3), (700.0, 0.35, 0.2))
MOLES = "(" + " + ".join(f"{share}e0 / {mass}e0" for _, mass, share in COMPONENTS) + ")"


def left_sql() -> str:
    """Share of the mass that is left after an hour: film of 1 mm."""
    k, parts = "(sst + 273.15e0)", []
    for boiling, _, share in COMPONENTS:
        entropy, c = 8.75 + 1.987 * math.log(boiling), 0.19 * boiling - 18
        scale = entropy * (boiling - c) ** 2 / (0.97 * 1.987 * boiling)
        pressure = f"(exp({scale!r}e0 * (1 / ({boiling}e0 - {c!r}e0) - 1 / ({k} - {c!r}e0))) * 101325e0)"
        transport = "(CASE WHEN w >= 10 THEN 0.06e0 * 0.0025e0 * w * w ELSE 0.0025e0 * pow(w, 0.78e0) END)"
        parts.append(f"{share}e0 * exp(-((1 / 900e0 / 1e-3) * {transport} / (8.314e0 * {k} * {MOLES}) * {pressure}) * 3600)")
    return "(" + " + ".join(parts) + ")"


def left_after_evaporation(wind: Column, t: Column) -> Column:
    """Share of the mass that an hour's evaporation leaves, components each at its rate; a film of 1 mm."""
    moles = F.lit(sum(share / mass for _, mass, share in COMPONENTS))
    area = F.lit(1 / 900.0 / 1e-3)  # of a kilogram
    parts = [share * F.exp(-weathering.evaporation_rate(wind, t + weathering.ZERO, area, moles, boiling) * HOUR) for boiling, _, share in COMPONENTS]
    return sum(parts[1:], parts[0])


@query(joined("particles forcing", ENV + f" SELECT event_id, round(weight * (1 - {left_sql()}), 8) AS evaporated FROM env WHERE z >= -5"))
def oil_evaporation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = environment(spark, sf_dir).filter("z >= -5")
    return p.select("event_id", *rounded(evaporated=F.col("weight") * (1 - left_after_evaporation(F.col("wind"), F.col("sst")))))


YMAX, UPTAKE = 0.9, 2.02e-6
AREA_MOST = f"(6 / 1e-6 * ({YMAX}e0 / (1 - {YMAX}e0)))"
EMULSION = f"least(event_id % 100 * 1e3 + 6 * {UPTAKE} * w * w / 1e-5 * 3600 * exp(-(6 * {UPTAKE} * w * w / 1e-5) / {AREA_MOST} * (event_id % 48 * 3600 - 3600)), {AREA_MOST})"
WET = f"(CASE WHEN area >= 6 / 1e-5 * ({YMAX}e0 / (1 - {YMAX}e0)) THEN {YMAX}e0 ELSE area * 1e-5 / (6 + area * 1e-5) END)"
THICK = "(5e-5 * exp(least(greatest(sqrt(5e-5) * 1.5e3, 1), 10) * (event_id % 40 / 100e0)) * pow(1 + (wet / 0.84e0) / (1.187e0 - wet / 0.84e0), 2.49e0))"
DISSIPATION = "(0.0034e0 * rho * 9.81e0 * pow(0.0246e0 * w * w, 2))"
BREAKING = f"greatest(0.032e0 * (w - 5) / {PERIOD}, 0)"
DISPERSED = f"(2400 * exp(-73.682e0 * sqrt(thick / 900)) * pow({DISSIPATION}, 0.57e0) * {BREAKING} * 3.9e-8 * 3600)"
BIO = "(1 - exp(-(3600 / 86400e0) / (12 * pow(3e0, (20 - sst) / 10))))"
WEATHERED = ENV + f", e AS (SELECT *, {EMULSION} AS area FROM env), y AS (SELECT *, {WET} AS wet FROM e), v AS (SELECT *, {THICK} AS thick FROM y), oil AS (SELECT *, CASE WHEN {DISPERSED} >= 1 THEN 0.99e0 ELSE {DISPERSED} END AS dispersed, {BIO} AS bio FROM v)"


def weathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles with the water fraction, viscosity, and dispersed and biodegraded shares of an hour."""
    p, w, e = environment(spark, sf_dir), F.col("wind"), F.col("event_id")
    p = p.withColumn("area", weathering.emulsion_area(e % 100 * 1e3, w, (e % 48 * 3600).cast("double"), F.lit(3600.0), UPTAKE, YMAX, HOUR))
    p = p.withColumn("wet", weathering.water_fraction(F.col("area"), YMAX))
    p = p.withColumn("thick", weathering.emulsion_viscosity(F.lit(5e-5), e % 40 / 100.0, F.col("wet")))
    dissipation = 0.0034 * F.col("rho") * 9.81 * F.pow(physics.wave_height(w), F.lit(2.0))
    return p.withColumn("dispersed", weathering.dispersed_fraction(dissipation, physics.breaking_fraction(w), F.col("thick"), F.lit(900.0), HOUR)).withColumn("bio", weathering.biodegraded_fraction(F.col("sst"), HOUR))


@query(joined("particles forcing", WEATHERED + " SELECT event_id, round(wet, 8) AS water, round(thick, 8) AS viscosity, round(1e6 * dispersed, 4) AS dispersed_ppm, round(1e6 * bio, 4) AS biodegraded_ppm FROM oil"))
def oil_weathering(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weathered(spark, sf_dir)
    return p.select("event_id", *rounded(water=F.col("wet"), viscosity=F.col("thick")), *rounded(4, dispersed_ppm=1e6 * F.col("dispersed"), biodegraded_ppm=1e6 * F.col("bio")))


#: Mass budget columns of the hour: evaporated first, then dispersed, then biodegraded of what is left.
LOSSES = WEATHERED + f", loss AS (SELECT *, CASE WHEN z >= -5 THEN weight * (1 - {left_sql()}) ELSE 0 END AS evaporated FROM oil), m AS (SELECT *, (weight - evaporated) * dispersed AS out, (weight - evaporated) * (1 - dispersed) * bio AS eaten FROM loss)"


@query(joined("particles forcing", LOSSES + """, r AS (SELECT traj_id, event_id, step, coalesce(lead(step) OVER (PARTITION BY traj_id ORDER BY step, event_id), 1 + (SELECT max(step) FROM particles)) AS until_, status, z,
weight - evaporated - out - eaten AS oil, evaporated, out, eaten FROM m), s AS (SELECT *, unnest(range(CAST(ceil(step / 24e0) AS BIGINT), CAST(ceil(until_ / 24e0) AS BIGINT))) AS day FROM r)
SELECT day, round(coalesce(sum(oil) FILTER (status = 0 AND z >= -5), 0), 4) AS surface, round(coalesce(sum(oil) FILTER (status = 0 AND z < -5), 0), 4) AS submerged, round(coalesce(sum(oil) FILTER (status = 1), 0), 4) AS stranded,
round(sum(evaporated), 5) AS evaporated, round(sum(out), 6) AS dispersed, round(sum(eaten), 6) AS biodegraded, round(sum(oil + evaporated + out + eaten), 4) AS total FROM s GROUP BY day"""))
def oil_budget_weathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oil by where it is, or how it went, at the start of each day; a particle counts as last seen.

    A row holds until the trajectory's next one, so rows are repeated for the days that they cover, and the sum is one
    grouping; a particle that isn't seen again stays in the budget.
    """
    p = weathered(spark, sf_dir)
    up = F.when(F.col("z") >= -5, F.col("weight") * (1 - left_after_evaporation(F.col("wind"), F.col("sst")))).otherwise(0.0)
    p = p.withColumn("evaporated", up).withColumn("out", (F.col("weight") - F.col("evaporated")) * F.col("dispersed"))
    p = p.withColumn("eaten", (F.col("weight") - F.col("evaporated")) * (1 - F.col("dispersed")) * F.col("bio"))
    last = particles(spark, sf_dir).agg(F.max("step") + 1).scalar()
    until = F.coalesce(F.lead("step").over(Window.partitionBy("traj_id").orderBy("step", "event_id")), last)
    p = p.withColumn("oil", F.col("weight") - F.col("evaporated") - F.col("out") - F.col("eaten")).withColumn("until", until)
    first_day, end_day = F.ceil(F.col("step") / 24), F.ceil(F.col("until") / 24)
    p = p.filter(first_day < end_day).withColumn("day", F.explode(F.sequence(first_day, end_day - 1)))
    part = lambda c, n: F.round(F.sum(F.when(c, F.col("oil")).otherwise(0.0)), 4).alias(n)
    afloat, top = F.col("status") == 0, F.col("z") >= -5
    lost = [F.round(F.sum(c), d).alias(n) for c, d, n in (("evaporated", 5, "evaporated"), ("out", 6, "dispersed"), ("eaten", 6, "biodegraded"))]
    total = F.round(F.sum(F.col("oil") + F.col("evaporated") + F.col("out") + F.col("eaten")), 4).alias("total")
    return p.groupBy("day").agg(part(afloat & top, "surface"), part(afloat & ~top, "submerged"), part(~afloat, "stranded"), *lost, total)


NU = "(0.001e0 * (1.7915e0 - 0.0538e0 * sst + 0.007e0 * sst * sst - 0.0023e0 * sal) / rho)"
SIZE = "((1 + event_id % 300) * 1e-5)"
SLOW = f"(2 * 9.81e0 * (1 - 900 / rho) / (9 * {NU}) * ({SIZE} / 2) * ({SIZE} / 2))"


@query(joined("particles forcing", ENV + f" SELECT event_id, round(CASE WHEN {SIZE} * {SLOW} / {NU} > 50 THEN sqrt(16 * 9.81e0 * (1 - 900 / rho) / 3) * sqrt({SIZE} / 2) ELSE {SLOW} END, 8) AS rise FROM env"))
def droplet_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (1 + F.col("event_id") % 300) * 1e-5
    return environment(spark, sf_dir).select("event_id", *rounded(rise=weathering.rise_of_droplets(size, F.col("sst"), F.col("sal"), F.lit(900.0), F.col("rho"))))


LARGEST = "(4 * sqrt(0.03e0 / ((rho - 900) * 9.81e0)))"
D50 = f"({LARGEST} * 1.791e0 * pow(1 + 10 * (1e-5 * 900 / sqrt(900 * 0.03e0 * {LARGEST})), 0.460e0) * pow(rho * 9.81e0 * (0.0246e0 * w * w) * {LARGEST} / 0.03e0, -0.518e0))"
CLASSES = (1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 3e-3)
SD = 0.4 * math.log(10)


def density_sql(d: float) -> str:
    return f"(exp(-pow(ln({d}) - ln({D50}), 2) / (2 * {SD * SD!r}e0)) / ({d} * {SD!r}e0 * sqrt(2 * pi())))"


def picked_sql() -> str:
    all_ = "(" + " + ".join(density_sql(d) for d in CLASSES) + ")"
    out, sum_ = "CASE", []
    for k, d in enumerate(CLASSES[:-1]):
        sum_.append(density_sql(d))
        out += f" WHEN u < ({' + '.join(sum_)}) / {all_} THEN {k}"
    return out + f" ELSE {len(CLASSES) - 1} END"


UNIFORM = "(CAST(('0x' || substr(md5(concat_ws(':', event_id, 'droplet')), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0"


@query(joined("particles forcing", ENV + f", u AS (SELECT *, {UNIFORM} AS u FROM env WHERE w > 1) SELECT event_id, round(1e3 * {D50}, 6) AS median_mm, CAST({picked_sql()} AS INT) AS class FROM u"))
def droplet_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median diameter of droplets from breaking waves, and a size class drawn from the log-normal spectrum around it."""
    p, w = environment(spark, sf_dir).filter("wind > 1"), F.col("wind")
    p = p.withColumn("d50", weathering.median_droplet(F.lit(900.0), F.lit(1e-5), F.col("rho"), physics.wave_height(w), 0.03))
    part = lambda d: F.exp(-F.pow(math.log(d) - F.log("d50"), F.lit(2.0)) / (2 * SD * SD)) / (d * SD * math.sqrt(2 * math.pi))
    p = p.withColumn("parts", F.array(*[part(d) for d in CLASSES])).withColumn("all", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x))
    u = hash_uniform(F.col("event_id"), F.lit("droplet"))
    below = [F.aggregate(F.slice("parts", 1, k), F.lit(0.0), lambda a, x: a + x) / F.col("all") <= F.col("u") for k in range(1, len(CLASSES))]
    passed = sum((c.cast("int") for c in below[1:]), below[0].cast("int"))
    return p.withColumn("u", u).select("event_id", F.round(1e3 * F.col("d50"), 6).alias("median_mm"), passed.alias("class"))


LOGW = "ln(mg)"
GROWTH = f"(mg * (exp(ln((1.08e0 + sst * (1.79e0 + {LOGW} * (-0.074e0 + {LOGW} * (-0.0965e0 + {LOGW} * 0.0112e0)))) / 100 + 1) * (3600 / 86400e0)) - 1))"
LENGTH = "exp(2.296e0 + 0.277e0 * ln(mg) - 0.005128e0 * pow(log10(mg), 2))"


@query(joined("particles forcing", ENV + f", l AS (SELECT *, 0.05e0 + event_id % 200 / 100e0 AS mg FROM env), k AS (SELECT *, {LENGTH} AS mm FROM l) SELECT event_id, round(exp(3.65e0 - 0.145e0 * sst), 6) AS hatching_days, round({GROWTH}, 8) AS growth, round(mm, 6) AS length, round((0.261e0 * pow(mm, 1.552e0 * pow(mm, -0.08e0)) - 5.289e0 / mm) / 1000, 8) AS swim FROM k"))
def larval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = environment(spark, sf_dir).withColumn("mg", 0.05 + F.col("event_id") % 200 / 100.0)
    mg, length = F.col("mg"), biology.larval_length(F.col("mg"))
    return p.select("event_id", *rounded(6, hatching_days=biology.development_days(F.col("sst"))), *rounded(growth=biology.larval_growth(mg, F.col("sst"), HOUR)), *rounded(6, length=length), *rounded(swim=biology.swim_speed(length)))


def density_of_sql(s: str) -> str:
    return f"({R1} + (4.8314e-4 * {s} + {R3} * sqrt({s}) + {R2}) * {s} + 1028.106331e0)"


EGG = "(31 + event_id % 20 / 10e0)"


@query(joined("particles forcing", ENV + f""", d AS (SELECT *, rho - {density_of_sql(EGG)} AS dr, 0.001e0 * (1.7915e0 - 0.0538e0 * sst + 0.007e0 * sst * sst - 0.0023e0 * sal) AS mu, 0.01854e0 * exp(-0.02783e0 * sst) AS nu FROM env),
s AS (SELECT *, 9.81e0 * 0.0014e0 * 0.0014e0 / 18 * dr / mu AS slow, 0.0014e0 * 100 - 0.4e0 * pow(9 * nu * nu / (100 * 9.81e0) * rho / greatest(dr, 1e-12), 1 / 3e0) AS size FROM d)
SELECT event_id, round(CASE WHEN slow * 1000 * 0.0014e0 / mu > 0.5e0 THEN 0.19e0 * size * pow(0.001e0 * greatest(dr, 0), 2 / 3e0) * pow(nu * 0.001e0 * rho, -1 / 3e0) ELSE slow END, 8) AS rise FROM s"""))
def egg_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return environment(spark, sf_dir).select("event_id", *rounded(rise=biology.rise_of_eggs(0.0014, 31 + F.col("event_id") % 20 / 10.0, F.col("sst"), F.col("sal"))))


@query(joined("particles forcing", ENV + ", e AS (SELECT *, (event_id % 21 - 10) / 5e0 AS eps, atan2(x_wind, y_wind) AS th FROM env), d AS (SELECT *, ((1.1e0 + eps / 20) * w + 2.5e0 + eps / 2) * 0.01e0 AS down, ((0.3e0 + eps / 20) * w + 0.5e0 + eps / 2) * 0.01e0 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM e) SELECT event_id, round(down * sin(th) - side * cos(th), 8) AS x, round(down * cos(th) + side * sin(th), 8) AS y FROM d"))
def leeway_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity of an object along and across the wind, half of the objects to each side."""
    p = with_wind(spark, sf_dir)
    eps, side = (F.col("event_id") % 21 - 10) / 5.0, F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    p = p.withColumns({"down": weathering.leeway(F.col("wind"), 1.1, 2.5, eps), "side": weathering.leeway(F.col("wind"), 0.3, 0.5, eps) * side, "th": F.atan2("x_wind", "y_wind")})
    return p.select("event_id", *rounded(x=F.col("down") * F.sin("th") - F.col("side") * F.cos("th"), y=F.col("down") * F.cos("th") + F.col("side") * F.sin("th")))


@query(joined("particles forcing", ENV + ", a AS (SELECT event_id, event_id % 101 / 100e0 AS a, sst, w FROM env) SELECT event_id, round(least(greatest((a - 0.3e0) / (0.8e0 - 0.3e0), 0), 1), 8) AS with_ice, round(greatest((0.7e0 - a) / 0.7e0, 0), 8) AS stokes, round(100 * 101000e0 * 0.005e0 / (0.622e0 * 611.2e0 * exp(17.67e0 * sst / (243.5e0 + sst))), 6) AS humidity FROM a"))
def ice_and_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the drift that follow the ice and the waves in it, and the relative humidity above."""
    p, a = with_wind(spark, sf_dir), F.col("event_id") % 101 / 100.0
    return p.select("event_id", *rounded(with_ice=weathering.ice_share(a), stokes=weathering.stokes_share_in_ice(a)), *rounded(6, humidity=weathering.relative_humidity(F.col("sst"), F.lit(0.005), F.lit(101000.0))))


def lottery_sql(name: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', event_id, step, '{name}')), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0"


@query(with_views("particles", f", u AS (SELECT step, weight, {lottery_sql('up')} AS a, {lottery_sql('down')} AS b, {lottery_sql('depth')} AS c FROM particles) SELECT step, round(coalesce(sum(weight) FILTER (a > 0.9e0), 0), 4) AS evaporated, round(coalesce(sum(weight) FILTER (a <= 0.9e0 AND b > 0.7e0), 0), 4) AS dissolved, round(avg(0.01e0 / 0.002e0 * ln(c)), 6) AS mean_depth FROM u GROUP BY step").replace(") ,", "),", 1))
def hns_lottery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass that evaporates or dissolves by lot, and the mean of exponentially mixed depths, by step; draws are hashes."""
    draw = lambda name: hash_uniform(F.col("event_id"), F.col("step"), F.lit(name))
    p = particles(spark, sf_dir).withColumns({"a": draw("up") > 0.9, "b": draw("down") > 0.7, "depth": 0.01 / 0.002 * F.log(draw("depth"))})
    some = lambda c, n: F.round(F.sum(F.when(c, F.col("weight")).otherwise(0.0)), 4).alias(n)
    return p.groupBy("step").agg(some(F.col("a"), "evaporated"), some(~F.col("a") & F.col("b"), "dissolved"), F.round(F.avg("depth"), 6).alias("mean_depth"))


# fixed values: slope and offset of the area of each 10 m of a keel against the length at the water line (Barker et al. 2004)
KEEL = (
    (9.5173, -25.94), (11.1717, -107.50), (12.4798, -232.01), (13.6010, -344.60), (14.3249, -456.57), (13.7432, -433.33), (13.4527, -519.56), (15.7579, -1111.57), (14.7259, -1125.00), (11.8195, -852.90),
    (11.3610, -931.48), (10.9202, -1007.02), (10.4966, -1079.62), (10.0893, -1149.41), (9.6979, -1216.49), (9.3216, -1280.97), (8.9600, -1342.95), (8.6124, -1402.52), (8.2783, -1459.78), (7.9571, -1514.82),
)


@query("WITH k AS (SELECT unnest(range(0, 20)) AS k, unnest([" + ", ".join(f"{a}e0" for a, _ in KEEL) + "]) AS a, unnest([" + ", ".join(f"{b}e0" for _, b in KEEL) + "]) AS b), p AS (SELECT p_partkey, 150e0 + p_size * 2 AS len, 1 + p_partkey % 20 AS n FROM part), s AS (SELECT p_partkey, k, (a * len + b) / sum(a * len + b) OVER (PARTITION BY p_partkey) AS share FROM p JOIN k ON k < n) SELECT p_partkey AS iceberg, k AS level, round(share, 8) AS share FROM s")
def iceberg_keel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each 10 m of depth in an iceberg's keel, by its length at the water line."""
    from plume.sources.fixtures import table

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("iceberg"), (150.0 + F.col("p_size") * 2).alias("len"), (1 + F.col("p_partkey") % 20).cast("int").alias("n"))
    keel = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in KEEL])
    areas = F.transform(F.slice(keel, F.lit(1), F.col("n")), lambda s: s["a"] * F.col("len") + s["b"])
    p = p.withColumn("areas", areas).withColumn("all", F.aggregate("areas", F.lit(0.0), lambda a, x: a + x))
    p = p.select("iceberg", "all", F.posexplode("areas").alias("level", "area"))
    return p.select("iceberg", F.col("level").cast("bigint").alias("level"), F.round(F.col("area") / F.col("all"), 8).alias("share"))


LADDER = (0.02e-6, 0.18e-6, 0.5e-6, 1.1e-6, 2.3e-6)


@query(with_views("track", ", r AS (SELECT unnest(range(0, 9)) AS k, unnest([0.02e-6, (0.02e-6 + 0.18e-6) / 2, 0.18e-6, (0.18e-6 + 0.5e-6) / 2, 0.5e-6, (0.5e-6 + 1.1e-6) / 2, 1.1e-6, (1.1e-6 + 2.3e-6) / 2, 2.3e-6]) AS rate), a AS (SELECT t.weight, t.step - min(t.step) OVER (PARTITION BY traj_id) AS age FROM track t) SELECT k, round(sum(weight * exp(-rate * age * 3600)), 4) AS left_, round(sum(weight * (1 - rate * 3600)), 4) AS next_hour FROM a, r GROUP BY k").replace(") ,", "),", 1))
def decay_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass that is left at the age of each row, and an hour later, for five rates and the midpoints between them."""
    rates = [x for a, b in zip(LADDER, LADDER[1:]) for x in (a, (a + b) / 2)] + [LADDER[-1]]
    t = track(spark, sf_dir).withColumn("age", F.col("step") - F.min("step").over(Window.partitionBy("traj_id")))
    t = t.select("weight", "age", F.posexplode(F.array(*[F.lit(r) for r in rates])).alias("k", "rate"))
    left = F.round(F.sum(F.col("weight") * F.exp(-F.col("rate") * F.col("age") * 3600)), 4).alias("left_")
    return t.groupBy(F.col("k").cast("bigint").alias("k")).agg(left, F.round(F.sum(F.col("weight") * (1 - F.col("rate") * 3600)), 4).alias("next_hour"))
