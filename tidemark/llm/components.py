"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which something must be wrong; the rounds needed grow with the logarithm of a component's diameter.
MOST_ROUNDS = 100


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(row)


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, but for the roots themselves; root is the smallest node reachable.

    edges: (u, v) long, in any direction, repeats and loops allowed.  Minima are aggregated before the shuffle, so a
    hub with very many neighbours is no more than a skewed join side, which AQE splits.  Every round is written to the
    shared folder.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(MOST_ROUNDS):
        if mark[0] == 0:
            break
        # Large star: larger neighbours of u link to the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = small.select("u", F.col("m").alias("v"))
        moved = large.join(small.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(kept.union(moved).distinct(), "edges")
        before, mark = mark, _mark(e)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
