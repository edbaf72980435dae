"""Chemical fates and oil weathering as column expressions.

Temperatures are in degrees Celsius unless a name ends in kelvin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: gas constants (J/mol/K, atm m3/mol/K, and cal/mol/K), zero Celsius, standard pressure (Pa), mean molar mass of sea salt (g/mol)
GAS, GAS_ATM, GAS_CALORIES = 8.3145, 8.206e-05, 1.987
ZERO, ATMOSPHERE, SALT_MASS = 273.15, 101325.0, 68.35


def arrhenius(t: Column, reference: float, enthalpy: float) -> Column:
    """Factor of a rate or solubility at ``t`` against that at ``reference``."""
    return F.exp(-(enthalpy / GAS) * (1 / (t + ZERO) - 1 / (reference + ZERO)))


def doubling_per_ten_degrees(t: Column, reference: float) -> Column:
    return F.pow(F.lit(2.0), (t - reference) / 10)


def salting_out(setschenow: float, salinity: Column, density: Column) -> Column:
    """Factor of a partition coefficient by the salt of sea water of ``density`` kg/m3."""
    return F.pow(F.lit(10.0), setschenow * (salinity / SALT_MASS) * density * 1e-3)


def ionised_sorption(kow: float, pka_acid: float) -> tuple[float, float]:
    """Organic-carbon coefficients of the anion and of the cation, estimated from octanol-water partition."""
    import math

    return 10 ** (0.11 * math.log10(kow) + 1.54), 10 ** (pka_acid ** (0.65 * (kow / (kow + 1)) ** 0.14))


def neutral_share(ph: Column, pka: float) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), ph - pka))


def sorption_of_acid(ph: Column, pka: float, neutral: float, initial: float, kow: float) -> Column:
    """Correction of the organic-carbon coefficient of an acid; that of a base takes its own pKa."""
    share = neutral_share(ph, pka)
    return (neutral * share + (1 - share) * ionised_sorption(kow, pka)[0]) / initial


def sorption_of_amphoter(ph: Column, acid: float, base: float, neutral: float, initial: float, kow: float) -> Column:
    anion, cation = ionised_sorption(kow, acid)
    share = 1 / (1 + F.pow(F.lit(10.0), ph - acid) + 10.0**base)
    return (neutral * share + share * F.pow(F.lit(10.0), ph - acid) * anion + share * F.pow(F.lit(10.0), base - ph) * cation) / initial


def sorption_to_dissolved_matter(ph: Column, pka: float, neutral: float, initial: float, kow: float) -> Column:
    share = neutral_share(ph, pka)
    return 0.08 * (share * neutral + share * kow * 10**-3.5) / 0.526 / initial


def degraded(mass: Column, half_life_hours: float, correction: Column, seconds: float) -> Column:
    """What an Arrhenius-corrected first-order decay takes of ``mass``."""
    import math

    return mass * (1 - F.exp(correction * (math.log(0.5) / (half_life_hours * 3600) * seconds)))


def volatilisation_rate(wind: Column, t: Column, salinity: Column, depth: Column, molar_mass: float, pressure: Column, solubility: Column) -> Column:
    """Rate (1/s) at which a dissolved substance leaves a mixed layer of ``depth`` m: two films, Schwarzenbach et al."""
    import math

    water = (9e-4 + 7.2e-6 * wind * wind * wind) * (44 / molar_mass) ** 0.25
    drag = 13.3 * 0.62**0.5 + F.pow(6.1e-4 + 6.3e-5 * wind, F.lit(-0.5)) - 5 + 1.25 * math.log(0.62)
    air = (0.1 + wind * F.sqrt(6.1 + 0.63 * wind) / drag) * (18 / molar_mass) ** (1 / 3)
    henry = pressure / solubility * molar_mass / ATMOSPHERE
    law = henry * (1 + 0.01143 * salinity) / (GAS_ATM * (t + ZERO))
    return 0.01 / (1 / water + 1 / (air * law)) / depth


def mass_transport(wind: Column) -> Column:
    return F.when(wind >= 10, 0.06 * 0.0025 * wind * wind).otherwise(0.0025 * F.pow(wind, F.lit(0.78)))


def vapour_pressure(kelvin: Column, boiling: float) -> Column:
    """Pa, for a component that boils at ``boiling`` K."""
    import math

    entropy, c = 8.75 + GAS_CALORIES * math.log(boiling), 0.19 * boiling - 18
    scale = entropy * (boiling - c) ** 2 / (0.97 * GAS_CALORIES * boiling)
    return F.exp(scale * (1 / (boiling - c) - 1 / (kelvin - c))) * ATMOSPHERE


def evaporation_rate(wind: Column, kelvin: Column, area: Column, moles: Column, boiling: float) -> Column:
    """Rate (1/s) at which a component leaves a slick of ``area`` m2 that holds ``moles`` in all."""
    return area * mass_transport(wind) / (8.314 * kelvin * moles) * vapour_pressure(kelvin, boiling)


def emulsion_area(old: Column, wind: Column, age: Column, start: Column, uptake: float, water_max: float, seconds: float) -> Column:
    """Interfacial area (1/m) of the water droplets after a step, up to that of droplets of 1e-6 m."""
    most = 6 / 1e-6 * (water_max / (1 - water_max))
    k = 6.0 * uptake * wind * wind / 1e-5
    return F.least(old + k * seconds * F.exp(-k / most * (age - start)), F.lit(most))


def water_fraction(area: Column, water_max: float) -> Column:
    full = 6 / 1e-5 * (water_max / (1 - water_max))
    return F.when(area >= full, F.lit(water_max)).otherwise(area * 1e-5 / (6 + area * 1e-5))


def emulsion_viscosity(viscosity: Column, evaporated: Column, water: Column) -> Column:
    steep = F.least(F.greatest(F.sqrt(viscosity) * 1.5e3, F.lit(1.0)), F.lit(10.0))
    share = water / 0.84
    return viscosity * F.exp(steep * evaporated) * F.pow(1 + share / (1.187 - share), F.lit(2.49))


def dispersed_fraction(dissipation: Column, breaking: Column, viscosity: Column, density: Column, seconds: float) -> Column:
    rate = 2400.0 * F.exp(-73.682 * F.sqrt(viscosity / density)) * F.pow(dissipation, F.lit(0.57)) * breaking * 3.9e-8
    share = rate * seconds
    return F.when(share >= 1, F.lit(0.99)).otherwise(share)


def biodegraded_fraction(t: Column, seconds: float) -> Column:
    days = 12 * F.pow(F.lit(3.0), (20 - t) / 10)
    return 1 - F.exp(-(seconds / 86400) / days)


def rise_of_droplets(diameter: Column, t: Column, salinity: Column, density: Column, water_density: Column) -> Column:
    """Terminal velocity (m/s) by Stokes' law, or by drag where the Reynolds number is over 50."""
    viscosity = 0.001 * (1.7915 - 0.0538 * t + 0.007 * t * t - 0.0023 * salinity) / water_density
    lift = 1 - density / water_density
    slow = 2 * 9.81 * lift / (9 * viscosity) * (diameter / 2) * (diameter / 2)
    fast = F.sqrt(F.greatest(16 * 9.81 * lift / 3, F.lit(0.0))) * F.sqrt(diameter / 2)
    return F.when(diameter * slow / viscosity > 50, fast).otherwise(slow)


def median_droplet(density: Column, viscosity: Column, water_density: Column, wave_height: Column, tension: float) -> Column:
    """Median diameter (m) by volume of droplets that breaking waves make (Li et al. 2017)."""
    largest = 4 * F.sqrt(tension / ((water_density - density) * 9.81))
    weber = water_density * 9.81 * wave_height * largest / tension
    ohnesorge = viscosity * density / F.sqrt(density * tension * largest)
    return largest * 1.791 * F.pow(1 + 10 * ohnesorge, F.lit(0.460)) * F.pow(weber, F.lit(-0.518))


def ice_share(concentration: Column) -> Column:
    """Share of a drift that follows the ice."""
    return F.least(F.greatest((concentration - 0.3) / (0.8 - 0.3), F.lit(0.0)), F.lit(1.0))


def stokes_share_in_ice(concentration: Column) -> Column:
    return F.greatest((0.7 - concentration) / 0.7, F.lit(0.0))


def leeway(wind: Column, slope: Column | float, offset: Column | float, deviation: Column) -> Column:
    """Velocity (m/s) of an object along or across the wind, of a slope in percent and an offset in cm/s."""
    return ((slope + deviation / 20.0) * wind + offset + deviation / 2.0) * 0.01


def relative_humidity(t: Column, specific: Column, pressure: Column) -> Column:
    return 100 * pressure * specific / (0.622 * 611.2 * F.exp(17.67 * t / (243.5 + t)))
