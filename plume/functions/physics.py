"""Physical parameterisations as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

G = 9.81

#: Schmidt number polynomials in degrees Celsius (Wanninkhof 2014, table 1), fixed values.
SCHMIDT = {
    "methane": (2101.2, -131.54, 4.4931, -0.08676, 0.00070663),
    "carbon dioxide": (2116.8, -136.25, 4.7353, -0.092307, 0.0007555),
    "oxygen": (1920.4, -135.6, 5.2122, -0.10939, 0.00093713),
    "nitrogen": (2304.8, -162.75, 6.2557, -0.13129, 0.0011255),
}
#: UNESCO 1983 one-atmosphere equation of state, highest power first, fixed values.
PURE_WATER = (6.536332e-09, -1.120083e-06, 1.001685e-04, -9.095290e-03, 6.793952e-02, -28.263737)
SALT_1 = (5.3875e-09, -8.2467e-07, 7.6438e-05, -4.0899e-03, 8.24493e-01)
SALT_15 = (-1.6546e-06, 1.0227e-04, -5.72466e-03)
SALT_2 = 4.8314e-04
DENSITY_OFFSET = 28.106331


def horner(x: Column, highest_first: tuple[float, ...]) -> Column:
    out = F.lit(highest_first[0])
    for c in highest_first[1:]:
        out = out * x + c
    return out


def schmidt_number(temperature: Column, gas: str = "methane") -> Column:
    return horner(temperature, SCHMIDT[gas][::-1])


def gas_transfer_velocity(wind: Column, temperature: Column, gas: str = "methane") -> Column:
    """cm/h (Wanninkhof 2014)."""
    return 0.251 * wind * wind * F.pow(schmidt_number(temperature, gas) / 660.0, F.lit(-0.5))


def air_sea_flux(velocity: Column, concentration: Column, cell: float) -> Column:
    """mol/h through a cell of ``cell`` m by ``cell`` m, the velocity in cm/h."""
    return velocity * concentration * cell * cell * 0.01


def decay(weight: Column, rate: float, seconds: float = 3600.0) -> Column:
    """First-order loss over one step."""
    return weight * (1 - rate * seconds)


def turnover_days(rate: Column, left: float) -> Column:
    """Days until the share ``left`` remains under a rate per second."""
    return -math.log(left) / rate / 86400.0


def rate_ladder(rates: tuple[float, ...]) -> list[float]:
    """The rates with the midpoints of neighbours between them."""
    return sorted({*rates, *((a + b) / 2 for a, b in zip(rates, rates[1:]))}, key=lambda r: r)


def seawater_density(temperature: Column, salinity: Column) -> Column:
    """kg/m3 at one atmosphere (UNESCO 1983)."""
    salt = SALT_2 * salinity + horner(temperature, SALT_15) * F.sqrt(salinity) + horner(temperature, SALT_1)
    return horner(temperature, PURE_WATER) + salt * salinity + DENSITY_OFFSET + 1000.0


def wave_height(wind: Column) -> Column:
    return 0.0246 * wind * wind


def wave_frequency(wind: Column) -> Column:
    """Angular peak frequency; 5 without wind."""
    return F.when(wind > 0, 0.877 * G / (1.17 * F.nullif(wind, F.lit(0.0)))).otherwise(5.0)


def wave_period(wind: Column) -> Column:
    return 2 * math.pi / wave_frequency(wind)


def breaking_fraction(wind: Column) -> Column:
    return F.greatest(0.032 * (wind - 5) / wave_period(wind), F.lit(0.0))


def wave_energy(height: Column) -> Column:
    return G * 1028 * height * height / 16


def stokes_transport(period: Column, height: Column) -> Column:
    return 2 * math.pi / period * height * height / 16


def stokes_monochromatic(speed: Column, height: Column, period: Column, z: Column) -> Column:
    """Stokes speed at depth z (negative down) of one wave."""
    k = speed / (2 * stokes_transport(period, height))
    return speed * F.exp(2 * k * z)


def stokes_exponential(speed: Column, height: Column, period: Column, z: Column) -> Column:
    k = speed / (2 * stokes_transport(period, height)) / 3
    return speed * F.exp(2 * k * z) / (1 - 8 * k * z)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def stokes_phillips(speed: Column, height: Column, period: Column, z: Column) -> Column:
    """Stokes speed under the Phillips spectrum (Breivik and others 2016, beta 1)."""
    k = speed * (1 - 2 / 3) / (2 * stokes_transport(period, height))
    depth = F.abs(z)
    return speed * (F.exp(2 * k * z) - F.sqrt(2 * math.pi * k * depth) * erfc(F.sqrt(2 * k * depth)))


def diffusivity_sundby(wind: Column, depth: Column, mixed: float = 50.0, background: float = 0.0) -> Column:
    k = 76.1e-4 + 2.26e-4 * wind * wind
    return F.when(depth >= mixed, F.lit(background)).when(depth > mixed - 1, (k + background) / 2).otherwise(k)


def diffusivity_large(wind: Column, depth: Column, mixed: float = 50.0, background: float = 0.0) -> Column:
    s = F.abs(depth) / mixed
    stress = wind * wind * 1.25e-3 * 1.22
    shape = s - 2 * s * s + s * s * s
    return F.when(F.abs(depth) >= mixed, F.lit(background)).otherwise(mixed * 0.2 * 0.4 * shape * stress + s * background)


def drag_coefficient(wind: Column) -> Column:
    return F.when(wind > 11, 0.001 * (0.49 + 0.065 * wind)).otherwise(0.0012)


def entrainment_rate(viscosity: Column, oil_density: Column, tension: float, wind: Column, water_density: float = 1028.0) -> Column:
    """Oil entrainment per second under breaking waves (Li and others 2017)."""
    drop = 4 * F.sqrt(tension / ((water_density - oil_density) * G))
    weber = water_density * G * wave_height(wind) * drop / tension
    ohnesorge = viscosity / F.sqrt(oil_density * tension * drop)
    return F.when(wind > 0, 4.604e-10 * F.pow(weber, F.lit(1.805)) * F.pow(ohnesorge, F.lit(-1.023)) * breaking_fraction(wind)).otherwise(0.0)


def ice_factor(cover: Column) -> Column:
    """Share of ice drift in the motion: 0 up to 30 % cover, 1 from 80 %."""
    return F.least(F.greatest((cover - 0.3) / 0.5, F.lit(0.0)), F.lit(1.0))


def declination(day: Column) -> Column:
    """Solar declination in degrees from the day of the year."""
    inner = 360.0 / 365.24 * (day + 10) + 360.0 / math.pi * 0.0167 * F.sin(F.radians(360.0 / 365.24 * (day - 2)))
    return F.degrees(F.asin(math.radians(-23.44) * F.cos(F.radians(inner))))


def equation_of_time(day: Column, hour: Column) -> Column:
    """Minutes by which the sun is ahead of the clock."""
    g = 2 * math.pi / 365.0 * (day - 1.0 + (hour - 12.0) / 24.0)
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def hour_angle(ts: Column, lon: Column) -> Column:
    minutes = F.hour(ts) * 60.0 + F.minute(ts) + F.floor(F.second(ts)) / 60.0
    return (minutes + equation_of_time(F.dayofyear(ts), F.hour(ts)) + 4 * lon) / 4.0 - 180.0


def solar_elevation(ts: Column, lon: Column, lat: Column) -> Column:
    """Degrees above the horizon."""
    d, phi = F.radians(declination(F.dayofyear(ts))), F.radians(lat)
    return F.degrees(F.asin(F.sin(phi) * F.sin(d) + F.cos(phi) * F.cos(d) * F.cos(F.radians(hour_angle(ts, lon)))))
