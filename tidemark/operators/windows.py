"""Operators along the track."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Records of a part of a track, about: a longer track is cut, so that no task holds it whole.
PART_ROWS = 50_000


def track(*by: str, time: str = "time"):
    return Window.partitionBy(*by).orderBy(time)


def parted(df: DataFrame, half: int, *by: str, time: str = "time") -> DataFrame:
    """Rows with the part of their track that they are in (`__part`) and whether it is their own (`__own`).

    A track is counted in narrow bins of time; runs of bins with about PART_ROWS records are its parts, and bins that hold any of the `half`
    records before or after a part come along as rows that are not its own. Records of one time stay together.
    """
    at = F.col(time).cast("double")
    known = F.when(at.isNotNull() & ~F.isnan(at), at)
    n, low, high = df.agg(F.count(F.lit(1)), F.min(known), F.max(known)).first()
    width = (high - low) * PART_ROWS / (8 * n) if n and low is not None else 0.0
    if n <= PART_ROWS or not 0 < width < math.inf:
        return df.withColumns({"__part": F.lit(1), "__own": F.lit(True)})
    # in the order of the window: no time first, no number last
    bin_ = F.when(at.isNull(), -1).when(F.isnan(at), F.lit(2**62)).otherwise(F.floor((at - low) / width)).cast("long")
    keys = [f"__by{i}" for i in range(len(by))]
    counts = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], bin_.alias("__of")).count()
    track_ = Window.partitionBy(*keys)
    bins = counts.withColumn("__from", F.sum("count").over(track_.orderBy("__of").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count"))
    bins = bins.withColumn("__part", F.dense_rank().over(track_.orderBy(F.floor(F.col("__from") / PART_ROWS))))
    # the part of the bin that holds the record `half` before the bin's first, and `half` after its last
    reach = lambda k: F.max("__part").over(track_.orderBy("__from").rangeBetween(Window.unboundedPreceding, k))
    bins = bins.withColumns({"__lo": F.coalesce(reach(-half), F.lit(1)), "__next": reach(half - 1)})
    bins = bins.withColumn("__hi", F.coalesce(F.lead("__next").over(track_.orderBy("__from")), F.col("__part")))
    found = materialize(bins.select(*keys, "__of", F.col("__part").alias("__home"), "__lo", "__hi"), "track-bins")
    same = F.col("__bin") == F.col("__of")
    for c, k in zip(by, keys, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    rows = df.withColumn("__bin", bin_).join(found, same).drop("__bin", "__of", *keys)
    rows = rows.withColumn("__part", F.explode(F.sequence("__lo", "__hi"))).withColumn("__own", F.col("__part") == F.col("__home"))
    return rows.drop("__lo", "__hi", "__home")


def moving_means(df: DataFrame, columns: dict[str, str], size: int, *by: str, time: str = "time", cut: bool = False, max_step: float | None = 1.2, coarse: bool = False) -> DataFrame:
    """Centred means (value -> name) of an odd number of records along each track; NULL where the window is not full.

    Tracks whose median time step is over `max_step` get none, or with `coarse` their values as they are. With `cut` only
    windows whose span is within half a second of (size - 1) median steps are returned. All columns share one pass; a
    long track is cut into parts (`parted`), so a task's memory does not grow with it. df is read several times.
    """
    half = size // 2
    part = track(*by, "__part", time=time)
    w = part.rowsBetween(-half, half)
    rows = parted(df, half, *by, time=time).withColumns({f"__mean_{out}": F.avg(v).over(w) for v, out in columns.items()})
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__span", F.last(time).over(w) - F.first(time).over(w))
    median = cut or max_step is not None
    if median:
        rows = rows.withColumn("__step", F.col(time) - F.lag(time).over(part))
    rows = rows.where("__own").drop("__part", "__own")
    if median:
        steps = rows.groupBy(*by).agg(F.median("__step").alias("__median"))
        rows = rows.join(steps, list(by))
    full = F.col("__n") == size
    fine = F.lit(True) if max_step is None else F.col("__median") <= max_step
    if cut:
        full &= F.abs(F.col("__span") - (size - 1) * F.col("__median")) <= 0.5
    for v, out in columns.items():
        mean = F.when(fine & full, F.col(f"__mean_{out}"))
        rows = rows.withColumn(out, mean.when(~fine, F.col(v)) if coarse else mean)
    rows = rows.drop("__step", "__n", "__span", "__median", *[f"__mean_{out}" for out in columns.values()])
    return rows.where(F.coalesce(*columns.values()).isNotNull()) if cut else rows


def moving_mean(df: DataFrame, value: str, size: int, *by: str, out: str = "smooth", **how) -> DataFrame:
    """The centred mean of one column."""
    return moving_means(df, {value: out}, size, *by, **how)


def smooth_columns(df: DataFrame, columns: list[str], size: int, *by: str, time: str = "time", max_step: float | None = 1.2) -> DataFrame:
    """Several columns (or the sides of a pair) smoothed along their tracks, as <column>_smooth."""
    return moving_means(df, {c: f"{c}_smooth" for c in columns}, size, *by, time=time, max_step=max_step)


def neighbours(df: DataFrame, columns: list[str], *by: str, time: str = "time") -> DataFrame:
    """Previous and next record of each track, as <column>_prev and <column>_next."""
    w = track(*by, time=time)
    return df.select("*", *[f(c).over(w).alias(f"{c}_{n}") for c in columns for f, n in ((F.lag, "prev"), (F.lead, "next"))])


def nearest_per_key(df: DataFrame, key: str, distance: str, tie: str) -> DataFrame:
    """The row with the least distance of each key, ties to the smaller `tie`; partial minima before the shuffle."""
    best = F.min(F.struct(distance, tie, F.struct(*[F.col(c) for c in df.columns]).alias("row"))).alias("best")
    return df.groupBy(key).agg(best).select("best.row.*")


def cumulative(df: DataFrame, count: str, *by: str, order: str = "bin") -> DataFrame:
    return df.withColumn("cdf", F.sum(count).over(Window.partitionBy(*by).orderBy(order)))


def changing(df: DataFrame, value: str, *by: str, order: str = "bin") -> DataFrame:
    """Rows whose value differs from the next one's."""
    return df.withColumn("__next", F.lead(value).over(Window.partitionBy(*by).orderBy(order))).where(F.col("__next") != F.col(value)).drop("__next")


def sample_summary(samples: Column, used: Column) -> Column:
    """Skewness, median, mean and deviation (population) of the used samples (flag 0) of an array, as a struct.

    Each step is bound by a lambda, so that a row computes it once and not once for each sample. Select the struct first and
    its fields from it, so that all four share it.
    """
    kept = F.transform(F.filter(F.arrays_zip(samples.alias("v"), used.alias("u")), lambda e: (e["u"] == 0) & e["v"].isNotNull()), lambda e: e["v"].cast("double"))

    def centred(k: Column) -> Column:
        n = F.size(k)
        mean = F.when(n > 0, F.aggregate(k, F.lit(0.0), lambda s, x: s + x) / n)
        return F.struct(k.alias("k"), F.sort_array(k).alias("order"), n.alias("n"), mean.alias("mean"))

    def moments(c: Column) -> Column:
        powers = F.transform(c["k"], lambda x: x - c["mean"])
        sums = F.aggregate(powers, F.struct(F.lit(0.0).alias("s2"), F.lit(0.0).alias("s3")), lambda s, d: F.struct((s["s2"] + d * d).alias("s2"), (s["s3"] + d * d * d).alias("s3")))
        n, order = c["n"], c["order"]
        median = F.when(n > 0, (F.element_at(order, F.floor((n + 1) / 2).cast("int")) + F.element_at(order, F.floor(n / 2).cast("int") + 1)) / 2)
        return F.struct(n.alias("n"), c["mean"].alias("mean"), median.alias("median"), sums.alias("s"))

    def named(c: Column) -> Column:
        m2, m3 = (F.when(c["n"] > 0, c["s"][f"s{p}"] / c["n"]) for p in (2, 3))
        return F.struct(F.try_divide(m3, F.pow(m2, F.lit(1.5))).alias("skew"), c["median"].alias("median"), c["mean"].alias("mean"), F.sqrt(m2).alias("std"))

    bound = F.array(kept)
    for step in (centred, moments, named):
        bound = F.transform(bound, step)
    return bound[0]


def sample_statistics(samples: Column, used: Column, name: str) -> list[Column]:
    """The fields of `sample_summary` as columns."""
    found = sample_summary(samples, used)
    return [found[f].alias(f"{name}_{f}") for f in ("skew", "median", "mean", "std")]
