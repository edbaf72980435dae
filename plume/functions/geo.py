"""Geodesy and projections as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
INV_F = 298.257223563
FLAT = 1 / INV_F
B = A * (1 - FLAT)


def wrap_longitude(lon: Column, low: float = -180.0) -> Column:
    """Longitude in [low, low + 360)."""
    return F.pmod(lon - low, F.lit(360.0)) + low


def rotate(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """A vector turned by ``angle`` radians counter-clockwise."""
    return u * F.cos(angle) - v * F.sin(angle), u * F.sin(angle) + v * F.cos(angle)


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each computed once however often it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), F.lit(0))


def geodesic_inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 4) -> Column:
    """struct(distance m, azimuth degrees) on WGS84 by Vincenty's formula with a fixed number of rounds.

    Four rounds are exact to the millimetre for the distances between
    neighbouring positions of a track. Each round is one step of an array
    fold, so that the expression stays small. Equal points are 0 m apart.
    """
    u1, u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat1))), F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    way = F.radians(lon2) - F.radians(lon1)

    def measure(p: Column, lam: Column) -> Column:
        """The sphere's arc at longitude difference ``lam``, and the next difference."""
        turned = let(
            lambda q: let(
                lambda r: let(
                    lambda t: let(
                        lambda w: F.struct(
                            (p["l"] + (1 - w["c"]) * FLAT * t["sin_a"] * (t["s"] + w["c"] * t["sin_s"] * (t["c2m"] + w["c"] * t["cos_s"] * (2 * t["c2m"] * t["c2m"] - 1)))).alias("lam"),
                            t["sin_s"].alias("sin_s"), t["cos_s"].alias("cos_s"), t["s"].alias("s"), t["cos2a"].alias("cos2a"), t["c2m"].alias("c2m"),
                        ),
                        c=FLAT / 16 * t["cos2a"] * (4 + FLAT * (4 - 3 * t["cos2a"])),
                    ),
                    sin_s=r["sin_s"], cos_s=r["cos_s"], s=r["s"], sin_a=r["sin_a"], cos2a=1 - r["sin_a"] * r["sin_a"],
                    c2m=F.when(1 - r["sin_a"] * r["sin_a"] > 1e-15, r["cos_s"] - 2 * p["s1"] * p["s2"] / F.nullif(1 - r["sin_a"] * r["sin_a"], F.lit(0.0))).otherwise(0.0),
                ),
                sin_s=q["sin_s"], cos_s=q["cos_s"], s=F.atan2(q["sin_s"], q["cos_s"]),
                sin_a=F.when(q["sin_s"] > 0, p["c1"] * p["c2"] * F.sin(lam) / F.nullif(q["sin_s"], F.lit(0.0))).otherwise(0.0),
            ),
            sin_s=F.hypot(p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)), cos_s=p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam),
        )
        return turned

    def finish(p: Column, m: Column) -> Column:
        def correct(k: Column) -> Column:
            c2m, cos_s, sin_s = m["c2m"], m["cos_s"], m["sin_s"]
            ds = k["b"] * sin_s * (c2m + k["b"] / 4 * (cos_s * (2 * c2m * c2m - 1) - k["b"] / 6 * c2m * (4 * sin_s * sin_s - 3) * (4 * c2m * c2m - 3)))
            azimuth = F.atan2(p["c2"] * F.sin(m["lam"]), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(m["lam"]))
            return F.struct((B * k["a"] * (m["s"] - ds)).alias("distance"), F.degrees(azimuth).alias("azimuth"))

        return let(
            lambda q: let(correct, a=1 + q["q"] / 16384 * (4096 + q["q"] * (-768 + q["q"] * (320 - 175 * q["q"]))), b=q["q"] / 1024 * (256 + q["q"] * (-128 + q["q"] * (74 - 47 * q["q"])))),
            q=m["cos2a"] * ((A * A - B * B) / (B * B)),
        )

    def solve(p: Column) -> Column:
        start = F.struct(p["l"].alias("lam"), *[F.lit(0.0).alias(n) for n in ("sin_s", "cos_s", "s", "cos2a", "c2m")])
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda m, _: measure(p, m["lam"]), lambda m: finish(p, m))

    known = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.when(known, let(lambda u: let(solve, l=u["l"], s1=F.sin(u["u1"]), c1=F.cos(u["u1"]), s2=F.sin(u["u2"]), c2=F.cos(u["u2"])), l=way, u1=u1, u2=u2))


def geodesic_forward(lon: Column, lat: Column, azimuth: Column, distance: Column, rounds: int = 4) -> Column:
    """struct(lon, lat) at ``distance`` m along ``azimuth`` degrees, by Vincenty's direct formula."""
    a1 = F.radians(azimuth)
    tan_u = (1 - FLAT) * F.tan(F.radians(lat))
    cos_u = 1 / F.sqrt(1 + tan_u * tan_u)
    sin_u = tan_u * cos_u
    s1 = F.atan2(tan_u, F.cos(a1))
    sin_a = cos_u * F.sin(a1)
    q = (1 - sin_a * sin_a) * (A * A - B * B) / (B * B)
    big_a = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
    big_b = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    first = distance / (B * big_a)
    start = F.struct(first.alias("s"), first.alias("s0"), s1.alias("s1"), big_b.alias("b"), cos_u.alias("cu"), sin_u.alias("su"), sin_a.alias("sa"), a1.alias("a1"))

    def step(p: Column, _: Column) -> Column:
        m2 = F.cos(2 * p["s1"] + p["s"])
        sin_s, cos_s, b = F.sin(p["s"]), F.cos(p["s"]), p["b"]
        ds = b * sin_s * (m2 + b / 4 * (cos_s * (2 * m2 * m2 - 1) - b / 6 * m2 * (4 * sin_s * sin_s - 3) * (4 * m2 * m2 - 3)))
        return F.struct((p["s0"] + ds).alias("s"), p["s0"].alias("s0"), p["s1"].alias("s1"), b.alias("b"), p["cu"].alias("cu"), p["su"].alias("su"), p["sa"].alias("sa"), p["a1"].alias("a1"))

    def finish(p: Column) -> Column:
        sin_s, cos_s, cu, su, sa, ca1 = F.sin(p["s"]), F.cos(p["s"]), p["cu"], p["su"], p["sa"], F.cos(p["a1"])
        t = su * sin_s - cu * cos_s * ca1
        lat2 = F.atan2(su * cos_s + cu * sin_s * ca1, (1 - FLAT) * F.sqrt(sa * sa + t * t))
        lam = F.atan2(sin_s * F.sin(p["a1"]), cu * cos_s - su * sin_s * ca1)
        cos2a = 1 - sa * sa
        c = FLAT / 16 * cos2a * (4 + FLAT * (4 - 3 * cos2a))
        m2 = F.cos(2 * p["s1"] + p["s"])
        dl = lam - (1 - c) * FLAT * sa * (p["s"] + c * sin_s * (m2 + c * cos_s * (2 * m2 * m2 - 1)))
        return F.struct((lon + F.degrees(dl)).alias("lon"), F.degrees(lat2).alias("lat"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, finish)


def utm_forward(lon: Column, lat: Column, zone: int = 33) -> tuple[Column, Column]:
    """Easting and northing (northern half) in a fixed UTM zone by Krueger's series to third order in n."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500000.0 + 0.9996 * radius * east, 0.9996 * radius * north


def utm_inverse(east: Column, north: Column, zone: int = 33) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a fixed UTM zone, the series of :func:`utm_forward` turned round."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = north / (0.9996 * radius), (east - 500000.0) / (0.9996 * radius)
    x, e = xi, eta
    for k, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        e = e - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)

    def finish(p: Column) -> Column:
        chi = F.asin(F.sin(p["x"]) / F.cosh(p["e"]))
        lat = let(lambda q: q["chi"] + sum((d * F.sin(2 * k * q["chi"]) for k, d in enumerate(delta[1:], 2)), delta[0] * F.sin(2 * q["chi"])), chi=chi)
        return F.struct((F.degrees(F.atan2(F.sinh(p["e"]), F.cos(p["x"]))) + (6 * zone - 183)).alias("lon"), F.degrees(lat).alias("lat"))

    out = let(finish, x=x, e=e)
    return out["lon"], out["lat"]


def polar_stereographic(lon: Column, lat: Column, true_lat: float = 75.0, down: float = -45.0) -> tuple[Column, Column]:
    """x and y (m) on the northern polar plane that is true to scale at ``true_lat``."""
    e = math.sqrt(FLAT * (2 - FLAT))
    phi = math.radians(true_lat)
    fixed = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    scale = A * math.cos(phi) / math.sqrt(1 - e * e * math.sin(phi) ** 2) / fixed
    s = F.sin(F.radians(lat))
    rho = scale * F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    turn = F.radians(lon - down)
    return rho * F.sin(turn), -rho * F.cos(turn)


def grid_angle(lon: Column, lat: Column, step: float = 0.001) -> Column:
    """Radians by which the projected grid's north is turned from true north, from a small step to the north."""
    e0, n0 = utm_forward(lon, lat)
    e1, n1 = utm_forward(lon, lat + step)
    return F.atan2(e1 - e0, n1 - n0)


def coriolis(lat: Column) -> Column:
    return F.sin(F.radians(lat)) * (4 * math.pi / 86400)


def within_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring given as an array of struct(x, y): a ray to the right crosses an odd number of edges."""
    following = lambda i: F.get(ring, (i + 1) % F.size(ring))

    def crossed(p: Column, i: Column) -> Column:
        q = following(i)
        return ((p["y"] > y) != (q["y"] > y)) & (x < (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    return F.size(F.filter(F.transform(ring, crossed), lambda c: c)) % 2 == 1


def shoelace(ring: Column) -> Column:
    """Area of a ring given as an array of struct(x, y), closed by itself."""
    following = lambda i: F.get(ring, (i + 1) % F.size(ring))
    parts = F.transform(ring, lambda p, i: p["x"] * following(i)["y"] - following(i)["x"] * p["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) / 2


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is within a ring: a ray to the right crosses an odd number of edges."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            spans = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * (x2 - x1) / (y2 - y1) + x1)
            crossings = crossings + F.when(spans, 1).otherwise(0)
    return crossings % 2 == 1
