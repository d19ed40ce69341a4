"""Histograms and zero-significance levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Histogram ranges, and widths derived from a tenth of a millimetre of Ku-band delay.
TEC_STEP = round(0.0001 * 10 / 0.002187, 4)
HISTOGRAMS = {"ssb": (-0.5, 0.5, 0.001), "iono": (-0.2, 0.2, TEC_STEP * 0.01216), "tec": (-100.0, 100.0, TEC_STEP)}
CUTOFF, DEGREE = (0.1, 2.0), 3


def bins(kind: str) -> tuple[float, float, int]:
    """First edge, width, and number of bins."""
    lo, hi, step = HISTOGRAMS[kind]
    return lo, step, len(np.arange(lo, hi, step)) - 1


def histogram(df: DataFrame, value: Column, kind: str, *by: str) -> DataFrame:
    """(by..., bin, mid, n, cdf) of every bin, empty ones included; the last bin is closed."""
    lo, step, n = bins(kind)
    at = F.floor((value - F.lit(lo)) / F.lit(step))
    top = value == F.lit(lo + step * n)
    index = F.when(top, F.lit(n - 1)).otherwise(at).cast("int")
    found = df.select(*by, index.alias("bin")).where(F.col("bin").between(0, n - 1)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    out = every.join(found, [*by, "bin"], "left").select(*by, "bin", (F.lit(lo) + F.lit(step) * (F.col("bin") + 0.5)).alias("mid"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("cdf", F.sum("n").over(Window.partitionBy(*by).orderBy("bin")))


def polyfit(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """Least-squares coefficients, constant first."""
    h = np.vander(x, degree + 1, increasing=True)
    return np.linalg.lstsq(h, y, rcond=None)[0]


def moment_fit(df: DataFrame, x: Column, y: Column, degree: int, *by: str) -> DataFrame:
    """(by..., c array): polynomial fits of any number of rows from power sums; the small systems are solved on the driver."""
    powers = [F.sum(F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)]
    mixed = [F.sum(F.pow(x, F.lit(float(k))) * y).alias(f"t{k}") for k in range(degree + 1)]
    rows = []
    for r in df.groupBy(*by).agg(*powers, *mixed).collect():
        a = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
        b = np.array([r[f"t{i}"] for i in range(degree + 1)])
        rows.append((*[r[k] for k in by], np.linalg.lstsq(a, b, rcond=None)[0].tolist()))
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame(rows, ", ".join([*(f"{k} {kinds[k]}" for k in by), "c array<double>"]))


def zero_significance(counts: np.ndarray, mid: np.ndarray, *, cutoff: tuple[float, float] = CUTOFF, degree: int = DEGREE, kind: str = "ssb", linear: bool = False, midpoint: bool = False, flip: bool = True) -> tuple[float, float]:
    """Value at which a histogram's tail reaches zero percent, and the mean squared residual of the fit.

    The tail is the part of the cumulative share (from above; from below for TEC) within the cutoff where it changes from bin
    to bin. Bin centres are fitted by the share, bins beyond 4 deviations dropped and fitted again until none is. With
    `flip` off the share is fitted by the bin centres, and the level is that curve's root.
    """
    degree = 1 if linear else degree
    share = 100.0 * counts.cumsum() / max(counts.sum(), 1)
    tail = share if kind == "tec" else 100.0 - share
    at = np.flatnonzero((tail >= cutoff[0]) & (tail <= cutoff[1]))
    step = np.flatnonzero(np.abs(np.diff(tail[at])) > 0)
    at = at[step + 1] if kind == "tec" else at[step]
    while True:
        if len(at) < degree + 1:
            return float("nan"), float("nan")
        x, y = (tail[at], mid[at]) if flip else (mid[at], tail[at])
        c = polyfit(x, y, degree)
        res = y - np.polynomial.polynomial.polyval(x, c)
        kept = np.abs(res - res.mean()) < 4 * res.std() if res.std() > 0 else np.ones(len(at), bool)
        if kept.all():
            break
        at = at[kept]
    where = sum(cutoff) / 2 if linear and midpoint else 0.0
    level = float(np.polynomial.polynomial.polyval(where, c)) if flip else crossing(c, where, mid[at][0 if kind == "tec" else -1])
    return level, float((res**2).mean())


def crossing(c: np.ndarray, value: float, near: float, close: float = 0.01) -> float:
    """Where a polynomial takes a value: its one real root if that is close to `near`, else the root whose real part is nearest."""
    roots = np.roots((c - np.eye(1, len(c))[0] * value)[::-1])
    if not len(roots):
        return float("nan")
    real = roots[np.imag(roots) == 0].real
    if len(real) == 1 and abs(real[0] - near) <= close:
        return float(real[0])
    return float(roots.real[np.abs(roots.real - near).argmin()])


def levels_by(hist: DataFrame, by: str = "cycle", **how) -> list[tuple]:
    """(key, level, mse) of each key's histogram; a histogram has a fixed number of bins."""
    rows = hist.select(by, "bin", "mid", "n").collect()
    out = []
    for key in sorted({r[by] for r in rows}):
        own = sorted((r for r in rows if r[by] == key), key=lambda r: r["bin"])
        out.append((key, *zero_significance(np.array([r["n"] for r in own]), np.array([r["mid"] for r in own]), **how)))
    return out


def mean_within(values: list[float], z: float = 4.0) -> float:
    """Mean of the values left after iterative removal beyond z deviations."""
    v = np.array([x for x in values if not np.isnan(x)])
    while len(v):
        kept = np.abs(v - v.mean()) <= z * v.std()
        if kept.all():
            return float(v.mean())
        v = v[kept]
    return float("nan")


def reference_mean(df: DataFrame, x: Column, y: Column, z: Column, weight: Column, by: str = "cycle") -> DataFrame:
    """(by, level): weighted mean of the rows in the reference bin of wave height and wind."""
    inside = (x >= 1.625) & (x < 1.875) & (y >= 5.375) & (y < 5.625)
    return df.where(inside).groupBy(by).agg((F.sum(z * weight) / F.sum(weight)).alias("level"))


def binned_envelope(df: DataFrame, value: Column, swh: Column, *, width: float = 0.25, least: int = 50, z: float = 3.0) -> DataFrame:
    """(bin, centre, mean, sd, envelope) of wave-height bins centred on multiples of the width with over `least` rows."""
    b = F.floor(swh / width + 0.5).cast("int")
    g = df.select(b.alias("bin"), value.alias("v")).where(F.col("v").isNotNull() & F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return g.where(F.col("n") > least).select("bin", (F.col("bin") * width).alias("centre"), "mean", "sd", (F.col("mean") + z * F.col("sd")).alias("envelope"))
