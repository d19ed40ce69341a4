"""Iterative outlier removal.

Each round aggregates mean and deviation of the survivors (partial sums, no sort). Bounds only ever narrow, so a round
keeps no copy of the data: the survivors are the rows within the last bounds of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 100
#: Groups up to which their limits are broadcast.
BROADCAST_GROUPS = 20_000


def bounds(df: DataFrame, value: Column, z: float, *by: str, rounds: int = ROUNDS) -> DataFrame:
    """(by..., lo, hi, n): limits of each group once no survivor is further than z deviations from the mean.

    rounds: how often survivors may become more before this is an error; while they become fewer it goes on.
    """
    rows = df.select(*by, value.alias("__v")).where(F.col("__v").isNotNull())
    # the values are read in every round
    rows = rows.persist()
    try:
        state, before = None, None
        while True:
            inner = rows if state is None else (rows.join(state, list(by)) if by else rows.join(F.broadcast(state), F.lit(True))).where(F.col("__v").between(F.col("lo"), F.col("hi")))
            stats = inner.groupBy(*by).agg(F.avg("__v").alias("m"), F.stddev_pop("__v").alias("s"), F.count(F.lit(1)).alias("n")).select(*by, (F.col("m") - z * F.col("s")).alias("lo"), (F.col("m") + z * F.col("s")).alias("hi"), "n")
            found = stats.collect()  # a row for each cycle
            total = sum(r["n"] for r in found)
            if total == before:
                break
            rounds -= before is not None and total > before
            if rounds < 0:
                raise RuntimeError("outliers did not settle")
            before = total
            state = df.sparkSession.createDataFrame(found, stats.schema) if found else stats
        return state
    finally:
        rows.unpersist()


def _with_bounds(df: DataFrame, limits: DataFrame, *by: str) -> DataFrame:
    """df next to the limits of its groups; a row without groups, or few groups, are broadcast."""
    if not by:
        return df.join(F.broadcast(limits), F.lit(True))
    return df.join(F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits, list(by))


def without_outliers(df: DataFrame, value: Column, z: float, *by: str) -> DataFrame:
    """Rows that survive; rows without a value go."""
    joined = _with_bounds(df, bounds(df, value, z, *by), *by)
    return joined.where(value.between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "n")


def marked_pairs(df: DataFrame, a: Column, b: Column, z: float, *by: str) -> DataFrame:
    """Pairs with both values, and whether side a and side b survive on their own in their group, as `ok_a` and `ok_b`."""
    out = df.where(a.isNotNull() & b.isNotNull())
    limits = [bounds(out, v, z, *by).select(*by, F.col("lo").alias(f"__lo{k}"), F.col("hi").alias(f"__hi{k}")) for k, v in enumerate((a, b))]
    for x in limits:
        out = _with_bounds(out, x, *by)
    return out.withColumns({f"ok_{s}": v.between(F.col(f"__lo{k}"), F.col(f"__hi{k}")) for k, (s, v) in enumerate((("a", a), ("b", b)))}).drop("__lo0", "__hi0", "__lo1", "__hi1")


def without_pair_outliers(df: DataFrame, a: Column, b: Column, z: float) -> DataFrame:
    """Pairs of which side a, side b and the difference all survive on their own."""
    out, conditions = df, []
    for k, v in enumerate((a, b, a - b)):
        limits = bounds(df, v, z).select(F.col("lo").alias(f"__lo{k}"), F.col("hi").alias(f"__hi{k}"))
        out = out.join(F.broadcast(limits), F.lit(True))
        conditions.append(v.between(F.col(f"__lo{k}"), F.col(f"__hi{k}")))
    return out.where(conditions[0] & conditions[1] & conditions[2]).drop(*[f"__{e}{k}" for k in range(3) for e in ("lo", "hi")])
