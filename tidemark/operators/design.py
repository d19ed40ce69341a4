"""Interpolation weights of observations on grid nodes: the design matrix as an array in each row."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Axis, Grid

NODES = "array<struct<node:int,w:double>>"


def _cell(v: Column, axis: Axis) -> tuple[Column, Column]:
    """Index of the cell (left open, right closed) and the place in it, in (0, 1]."""
    at = (v - F.lit(axis.first)) / F.lit(axis.step)
    i = F.ceil(at).cast("int") - 1
    return i, at - i


def weights(grid: Grid, x: Column, y: Column, z: Column | None = None) -> Column:
    """Bilinear or trilinear weights; NULL outside the grid or where an input is."""
    axes = [(grid.x, x), (grid.y, y)] + ([(grid.z, z)] if grid.z is not None else [])
    cells = [_cell(v, a) for a, v in axes]
    inside = reduce(lambda p, q: p & q, [(i >= 0) & (i <= a.count - 2) for (i, _), (a, _) in zip(cells, axes, strict=True)])
    strides = [1, grid.x.count, grid.x.count * grid.y.count]
    out = []
    for corner in product((0, 1), repeat=len(axes)):
        corner = corner[::-1]  # x runs fastest
        node = reduce(lambda p, q: p + q, [(i + c) * s for (i, _), c, s in zip(cells, corner, strides, strict=False)])
        w = reduce(lambda p, q: p * q, [f if c else 1.0 - f for (_, f), c in zip(cells, corner, strict=True)])
        out.append(F.struct(node.cast("int").alias("node"), w.alias("w")))
    return F.when(F.coalesce(inside, F.lit(False)), F.array(*out))


#: Differences of weights below this are rounding.
NOTHING = 1e-12


def difference(a: Column, b: Column) -> Column:
    """Weights of a pair, side a less side b, a node at most once; they add to 0."""
    both = F.concat(a, F.transform(b, lambda e: F.struct(e["node"].alias("node"), (-e["w"]).alias("w"))))
    ids = F.array_distinct(F.transform(both, lambda e: e["node"]))
    of = lambda n: F.aggregate(F.filter(both, lambda e: e["node"] == n), F.lit(0.0), lambda s, e: s + e["w"])
    each = F.transform(ids, lambda n: F.struct(n.alias("node"), of(n).alias("w")))
    return F.transform(each, lambda e: F.struct(e["node"].alias("node"), F.when(F.abs(e["w"]) > NOTHING, e["w"]).otherwise(0.0).alias("w")))


def exploded(df: DataFrame, *keep: str, nodes: str = "nodes") -> DataFrame:
    """One row for each weight that is not zero: (keep..., node, w)."""
    return df.select(*keep, F.explode(nodes).alias("e")).select(*keep, "e.node", "e.w").where(F.col("w") != 0)


def two_band_rows(df: DataFrame, size: int, k: float) -> DataFrame:
    """Rows for the joint solution of both bands: unknowns of the second band follow those of the first.

    df: (obs_id, nodes, z_range, z_tec); k is the squared frequency ratio's factor of the first band.
    """
    scaled = lambda f, shift: F.transform("nodes", lambda e: F.struct((e["node"] + shift).alias("node"), (e["w"] * f).alias("w")))
    first = df.select("obs_id", F.lit(0).alias("part"), F.concat(scaled(1 + k, 0), scaled(-k, size)).alias("nodes"), F.col("z_range").alias("z"))
    second = df.select("obs_id", F.lit(1).alias("part"), F.concat(scaled(1.0, 0), scaled(-1.0, size)).alias("nodes"), F.col("z_tec").alias("z"))
    return first.unionByName(second)
