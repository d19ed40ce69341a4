"""Model grids and the reduced Gaussian grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    first: float
    step: float
    count: int

    @property
    def last(self) -> float:
        return self.first + self.step * (self.count - 1)


@dataclass(frozen=True)
class Grid:
    """Node axes; node ids count along x first, then y, then z."""

    x: Axis
    y: Axis
    z: Axis | None = None

    @property
    def size(self) -> int:
        return self.x.count * self.y.count * (self.z.count if self.z else 1)


# The standard axes.
WAVE = Axis(0.0, 0.25, 49)
STANDARD = {"u10": Grid(WAVE, Axis(0.0, 0.25, 84)), "sig0": Grid(Axis(0.0, 0.25, 61), Axis(10.0, 0.25, 41)), "u10_mwp": Grid(WAVE, Axis(0.0, 0.25, 84), Axis(1.0, 0.25, 57))}


def nodes(spark: SparkSession, grid: Grid) -> DataFrame:
    """(node, ix, iy, iz, x, y, z): a generated table of a known size."""
    nx, ny = grid.x.count, grid.y.count
    n = F.col("id")
    ix, iy, iz = n % nx, F.floor(n / nx) % ny, F.floor(n / (nx * ny))
    out = spark.range(grid.size).select(n.cast("int").alias("node"), ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), iz.cast("int").alias("iz"))
    z = grid.z or Axis(0.0, 0.0, 1)
    return out.select("*", *[(F.lit(a.first) + F.col(i) * F.lit(a.step)).alias(c) for a, i, c in ((grid.x, "ix", "x"), (grid.y, "iy", "y"), (z, "iz", "z"))])


def on_grid(solved: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """Every node with its value, NULL where none was solved."""
    return nodes(solved.sparkSession, grid).join(F.broadcast(solved.select("node", value)), "node", "left") if grid.size <= 50_000 else nodes(solved.sparkSession, grid).join(solved.select("node", value), "node", "left")


def gauss_rows(size: int) -> int:
    return 180 // size + 1


def _cells_in_row(lat: Column, size: int) -> Column:
    return F.when(F.abs(lat) == 90, F.lit(1)).otherwise(F.floor(F.lit(360.0 / size) * F.cos(F.radians(lat)))).cast("int")


def gauss_grid(spark: SparkSession, size: int = 3) -> DataFrame:
    """Cells of the reduced Gaussian grid (geo_cell, lat, lon, dlat, dlon, area), area in steradians."""
    row = spark.range(gauss_rows(size)).select(F.col("id").cast("int").alias("row"), (F.col("id") * size - 90).cast("double").alias("lat"))
    row = row.withColumn("cells", _cells_in_row(F.col("lat"), size)).withColumn("dlon", F.lit(360.0) / F.col("cells"))
    pole = F.lit(2 * math.pi * (1 - math.cos(math.radians(size / 2))))
    area = F.when(F.abs("lat") == 90, pole).otherwise(F.col("dlon") * size * F.cos(F.radians("lat")) * F.lit(math.radians(1.0) ** 2))
    cell = row.select("*", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("k"))
    return cell.select((F.col("row") * 1000 + F.col("k")).alias("geo_cell"), "lat", F.pmod(F.col("k") * F.col("dlon"), F.lit(360.0)).alias("lon"), F.lit(float(size)).alias("dlat"), "dlon", area.alias("area"))


def gauss_cell(lat: Column, lon: Column, size: int = 3) -> Column:
    """The cell that a position is in: half-open around cell centres, longitudes modulo 360, poles included."""
    row = F.floor((lat + 90.0 + size / 2.0) / size).cast("int")
    cells = _cells_in_row(row * size - 90, size)
    dlon = F.lit(360.0) / cells
    k = F.pmod(F.floor((F.pmod(lon, F.lit(360.0)) + dlon / 2.0) / dlon).cast("int"), cells)
    return F.when(lat.isNotNull() & lon.isNotNull(), row * 1000 + k)
