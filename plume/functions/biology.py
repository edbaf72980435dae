"""Eggs and larvae as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plume.functions.physics import seawater_density


def development_days(t: Column) -> Column:
    """Days from spawning to hatching of cod eggs."""
    return F.exp(3.65 - 0.145 * t)


def larval_growth(weight: Column, t: Column, seconds: float) -> Column:
    """Weight gained (mg) in a step by a cod larva of ``weight`` mg (Folkvord 2005)."""
    w = F.log(weight)
    percent = 1.08 + t * (1.79 + w * (-0.074 + w * (-0.0965 + w * 0.0112)))
    return weight * (F.exp(F.log(percent / 100.0 + 1) * (seconds / 86400)) - 1.0)


def larval_length(weight: Column) -> Column:
    """Length (mm) of a larva of ``weight`` mg."""
    return F.exp(2.296 + 0.277 * F.log(weight) - 0.005128 * F.pow(F.log10(weight), F.lit(2.0)))


def swim_speed(length: Column) -> Column:
    """m/s, for a larva of ``length`` mm (Peck et al. 2006)."""
    return (0.261 * F.pow(length, 1.552 * F.pow(length, F.lit(-0.08))) - 5.289 / length) / 1000


def rise_of_eggs(diameter: float, egg_salinity: Column, t: Column, salinity: Column) -> Column:
    """Terminal velocity (m/s) of an egg whose density is that of water of ``egg_salinity`` (Sundby 1983).

    Where the Reynolds number is over 0.5 an empirical law replaces Stokes'.
    """
    water = seawater_density(t, salinity)
    lighter = water - seawater_density(t, egg_salinity)
    viscosity = 0.001 * (1.7915 - 0.0538 * t + 0.007 * t * t - 0.0023 * salinity)
    slow = 9.81 * diameter * diameter / 18.0 * lighter / viscosity
    kinematic = 0.01854 * F.exp(-0.02783 * t)  # cm2/s
    core = F.pow(9.0 * kinematic * kinematic / (100 * 9.81) * water / F.greatest(lighter, F.lit(1e-12)), F.lit(1 / 3))
    size = diameter * 100 - 0.4 * core
    fast = 0.19 * size * F.pow(0.001 * F.greatest(lighter, F.lit(0.0)), F.lit(2 / 3)) * F.pow(kinematic * 0.001 * water, F.lit(-1 / 3))
    return F.when(slow * 1000 * diameter / viscosity > 0.5, fast).otherwise(slow)
