"""Levelled grids: cubic fill and kernel smoothing by formal error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid, nodes

#: Grid steps beyond which a kernel weight is under 2.4e-16.
REACH = 6


def cubic_terms(x: Column, y: Column, z: Column | None = None) -> list[Column]:
    terms = [x, x * x, x * x * x, y, y * y, y * y * y, x * y]
    return terms + ([z, z * z, z * z * z] if z is not None else [])


def cubic_fit(model: DataFrame, *, with_z: bool = False) -> list[float]:
    """Coefficients of the cubic through the known nodes (no constant), from moment sums."""
    t = cubic_terms(F.col("x"), F.col("y"), F.col("z") if with_z else None)
    n = len(t)
    row = model.where(F.col("value").isNotNull()).agg(*[F.sum(t[i] * t[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(t[i] * F.col("value")).alias(f"b{i}") for i in range(n)]).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    size = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))  # terms of equal length, as their powers differ by far
    return (np.linalg.lstsq(a / np.outer(size, size), np.array([row[f"b{i}"] or 0.0 for i in range(n)]) / size, rcond=None)[0] / size).tolist()


def kernel_means(known: DataFrame, grid: Grid) -> DataFrame:
    """(node, se, sv): error and value of known nodes (node, ix, iy, iz, value, error) averaged with exp(-r^2) / error^2.

    Neighbours meet by an equi-join on node ids within the kernel's reach.
    """
    side = F.sequence(F.lit(-REACH), F.lit(REACH))
    reach = known.select("node", "ix", "iy", "iz").select("*", F.explode(side).alias("dx")).select("*", F.explode(side).alias("dy"))
    reach = reach.select("*", F.explode(side if grid.z is not None else F.array(F.lit(0))).alias("dz"))
    ok = (F.col("ix") + F.col("dx")).between(0, grid.x.count - 1) & (F.col("iy") + F.col("dy")).between(0, grid.y.count - 1)
    other = (F.col("node") + F.col("dx") + F.col("dy") * grid.x.count + F.col("dz") * (grid.x.count * grid.y.count)).alias("other")
    r2 = (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).cast("double")
    near = reach.where(ok).select("node", other, F.exp(-r2).alias("k")).join(known.select(F.col("node").alias("other"), "value", "error"), "other")
    near = near.withColumn("w", F.col("k") / (F.col("error") * F.col("error")))
    return near.groupBy("node").agg((F.sum(F.col("w") * F.col("error")) / F.sum("w")).alias("se"), (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("sv"))


def smooth(solved: DataFrame, grid: Grid) -> tuple[DataFrame, list[float]]:
    """(node, ix, iy, iz, x, y, z, raw, value) on every node and the cubic's coefficients; solved: (node, value, error).

    Known nodes blend their neighbours' mean with the cubic by their share of the largest smoothed error; unknown nodes
    take the cubic. A known node without a formal error is an error.
    """
    if not solved.where(F.col("value").isNotNull() & (F.col("error").isNull() | F.isnan("error"))).isEmpty():
        raise ValueError("a known node has no formal error")
    all_nodes = nodes(solved.sparkSession, grid)
    known = all_nodes.join(solved.select("node", "value", "error"), "node").where(F.col("value").isNotNull())
    c = cubic_fit(known, with_z=grid.z is not None)
    t = cubic_terms(F.col("x"), F.col("y"), F.col("z") if grid.z is not None else None)
    cubic = sum((F.lit(k) * v for k, v in zip(c, t, strict=True)), F.lit(0.0))
    means = kernel_means(known, grid)
    top = means.agg(F.max("se").alias("top"))
    share = F.col("se") / F.col("top")
    done = all_nodes.withColumn("cubic", cubic).join(means, "node", "left").join(F.broadcast(top), F.lit(True), "left").join(solved.select("node", F.col("value").alias("raw")), "node", "left")
    value = F.when(F.col("sv").isNotNull(), (1 - share) * F.col("sv") + share * F.col("cubic")).otherwise(F.col("cubic"))
    return done.select("node", "ix", "iy", "iz", "x", "y", "z", "raw", value.alias("value")), c


def set_level(model: DataFrame, ix: int = 7, iy: int = 22, target: float = -0.088) -> DataFrame:
    """Shift a grid so that one node has a given value (-0.088 m in Ku band, -0.077 m in C band)."""
    at = model.where((F.col("ix") == ix) & (F.col("iy") == iy)).agg(F.first("value").alias("__at"))
    return model.join(F.broadcast(at), F.lit(True)).withColumn("value", F.col("value") - F.col("__at") + target).drop("__at")
