"""Binning of particles into space-time cells, and sums over the cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A regular grid: lower corner, cell sizes in degrees, layer thickness, cell side in m."""

    x0: float = 12.5
    y0: float = 68.5
    dx: float = 0.5
    dy: float = 0.25
    dz: float = 25.0
    side: float = 800.0

    @property
    def volume(self) -> float:
        return self.side * self.side * self.dz

    def ix(self, x: str = "lon") -> Column:
        return F.floor((F.col(x) - self.x0) / self.dx)

    def iy(self, y: str = "lat") -> Column:
        return F.floor((F.col(y) - self.y0) / self.dy)

    def kz(self, z: str = "z") -> Column:
        return F.floor(-F.col(z) / self.dz)

    def cells(self, df: DataFrame) -> DataFrame:
        """``df`` with ix, iy, kz. Bins are arithmetic, so this is a projection."""
        return df.withColumns({"ix": self.ix(), "iy": self.iy(), "kz": self.kz()})


def concentration(particles: DataFrame, grid: GridSpec, keys: tuple[str, ...] = ("step", "kz", "ix", "iy")) -> DataFrame:
    """Sum of weights, count and concentration of each occupied cell (empty cells have no row)."""
    cells = grid.cells(particles).groupBy(*keys).agg(F.sum("weight").alias("mass"), F.count("*").alias("n"))
    return cells.select(*keys, F.round("mass", 6).alias("mass"), "n", F.round(F.col("mass") / grid.volume, 12).alias("conc"))


def layer_time_mean(particles: DataFrame, grid: GridSpec, steps: int) -> DataFrame:
    """Mean concentration over ``steps`` steps, those without particles included."""
    cells = grid.cells(particles).groupBy("kz", "ix", "iy").agg(F.sum("weight").alias("mass"))
    return cells.select("kz", "ix", "iy", F.round(F.col("mass") / grid.volume / steps, 14).alias("mean_conc"))


def layered_density(particles: DataFrame, grid: GridSpec) -> DataFrame:
    """Counts of surface, submerged and stranded particles of each step and cell, in one pass."""
    surface = (F.col("status") == 0) & (F.col("z") >= -1)
    submerged = (F.col("status") == 0) & (F.col("z") < -1)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return grid.cells(particles).groupBy("step", "ix", "iy").agg(count(surface).alias("surface"), count(submerged).alias("submerged"), count(F.col("status") == 1).alias("stranded"))


def block_average(particles: DataFrame, grid: GridSpec, block: int) -> DataFrame:
    """Mean mass per cell over blocks of ``block`` steps, empty steps counting as zero."""
    cells = grid.cells(particles).withColumn("block", F.floor(F.col("step") / block))
    return cells.groupBy("block", "ix", "iy").agg(F.round(F.sum("weight") / block, 6).alias("mean_mass"))


def film_thickness(particles: DataFrame, cells: int, density: float) -> DataFrame:
    """event_id, thickness: mass over area of the particle's cell in the surface extent of its step.

    The extent is the step's bounding box in ``cells`` by ``cells`` parts;
    the thickness is held between 1e-9 and 1e-2 m. Extents are one row per
    step and are joined to the particles; masses are summed per cell and
    joined back, so no step is gathered in one task.
    """
    extent = particles.groupBy("step").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    place = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)) * cells), F.lit(cells - 1))
    binned = particles.join(extent, "step").withColumns({"bx": F.coalesce(place("lon", "x0", "x1"), F.lit(0)), "by": F.coalesce(place("lat", "y0", "y1"), F.lit(0))})
    area = F.greatest((F.col("x1") - F.col("x0")) * 40000.0 / cells, F.lit(1.0)) * F.greatest((F.col("y1") - F.col("y0")) * 111000.0 / cells, F.lit(1.0))
    mass = binned.groupBy("step", "bx", "by").agg(F.sum("weight").alias("mass"))
    out = binned.join(mass, ["step", "bx", "by"])
    return out.select("event_id", F.round(F.least(F.greatest(F.col("mass") / density / area, F.lit(1e-9)), F.lit(1e-2)), 9).alias("thickness"))
