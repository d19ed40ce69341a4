"""Incremental models (an extension): normal equations are sums, so cycles add to them as they arrive, and are replaced when
they are processed anew."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import design, lsq
from ..operators.grid import Grid

#: What a kept sum is of, besides entries of the normal matrix: its right-hand side, weights and rows of a node, and z and rows of a cycle.
RIGHT, WEIGHT, ROWS, WHOLE = -1, -2, -3, -1
#: Files of one cycle's rows that a batch writes.
FILES = 8


def normal_equations_stream(stream: DataFrame, grid: Grid, path: str, checkpoint: str, *, x: str, y: str, z: str):
    """Start a stream that appends each batch's partial sums; a batch that is repeated replaces its own."""

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("nodes", design.weights(grid, F.col(x), F.col(y))).withColumn("z", F.col(z)).where(F.col("nodes").isNotNull() & F.col("z").isNotNull())
        matrix = lsq.normal_matrix(rows).select("i", "j", "v")
        vector = lsq.normal_vector(rows).select("i", F.lit(-1).alias("j"), "v")
        matrix.unionByName(vector).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) over all batches; j = -1 is the right-hand side."""
    return spark.read.parquet(path).groupBy("i", "j").agg(F.sum("v").alias("v"))


def windowed_quality(stream: DataFrame, *, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and means by event-time window, for watching arrivals."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


# --- sums that can be taken back ---


def cycle_sums(rows: DataFrame) -> DataFrame:
    """(cycle, i, j, v) of rows (cycle, z, nodes): everything that a fit and the cycles' levels need, as sums by cycle.

    j >= 0: an entry of the normal matrix, i <= j; RIGHT: of its right-hand side; WEIGHT, ROWS: a node's weights and rows;
    i = WHOLE: sum of z (RIGHT) and number of rows (ROWS). Their size is bounded by the grid.
    """
    named = lambda d, j: d.select("cycle", "i", F.lit(j).alias("j"), "v")
    nodes = design.exploded(rows, "cycle").groupBy("cycle", F.col("node").alias("i")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    whole = rows.groupBy("cycle").agg(F.sum("z").alias("z"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("i", F.lit(WHOLE))
    out = lsq.normal_matrix(rows, "cycle").select("cycle", "i", "j", "v").unionByName(named(lsq.normal_vector(rows, "cycle"), RIGHT))
    for d, c, j in ((nodes, "w", WEIGHT), (nodes, "n", ROWS), (whole, "z", RIGHT), (whole, "n", ROWS)):
        out = out.unionByName(named(d.withColumnRenamed(c, "v"), j))
    return out


def latest(rows: DataFrame) -> DataFrame:
    """Of rows (cycle, id, batch, ...) with one id in a cycle that of the last batch; rows without an id all stay."""
    rest = [c for c in rows.columns if c not in ("cycle", "id")]
    order = F.max(F.struct("batch", *[c for c in rest if c != "batch"])).alias("r")
    kept = rows.where(F.col("id").isNotNull()).groupBy("cycle", "id").agg(order).select("cycle", "id", *[F.col(f"r.{c}").alias(c) for c in rest])
    return kept.unionByName(rows.where(F.col("id").isNull()).select(*kept.columns))


def take_batch(rows: DataFrame, batch: int, path: str) -> list[int]:
    """Keep a batch of rows (cycle, id, z, nodes) and make the sums of its cycles anew; returns those cycles.

    Rows are kept by cycle and batch, and a record that comes again replaces its older version.  Only the batch's cycles are
    read again.  A batch that is repeated replaces what it wrote before, so any step may be lost and run again.
    """
    spark = rows.sparkSession
    cycles = sorted(r["cycle"] for r in rows.select("cycle").distinct().collect())  # a row for each cycle of the batch
    if not cycles:
        return []
    files = F.pmod(F.xxhash64("id"), F.lit(FILES))  # a crowded cycle is not one task's
    kept = rows.select("id", "z", "nodes", F.col("cycle").cast("int").alias("cycle"), F.lit(batch).cast("long").alias("batch")).repartition("cycle", files)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle", "batch").parquet(f"{path}/rows")
    schema = "id long, z double, nodes " + design.NODES + ", cycle int, batch long"
    known = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("cycle").isin(cycles))
    sums = cycle_sums(latest(known)).repartition("cycle")  # bounded by the grid
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle").parquet(f"{path}/sums")
    return cycles


def solve_sums(sums: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(node, value, error, n) of the grid that all cycles' sums (cycle, i, j, v) give, and (cycle, level, n): mean residuals.

    The same as a fit of all rows, from sums alone.
    """
    spark = sums.sparkSession
    counts = sums.where(f"j = {ROWS} and i >= 0").groupBy("i").agg(F.sum("v").alias("n")).where(F.col("n") >= least).toArrow()  # bounded by the grid
    order = np.argsort(counts.column("i").to_numpy())
    ids, n = (counts.column(c).to_numpy()[order].astype(np.int64) for c in ("i", "n"))
    if not len(ids):
        raise ValueError("no node has enough rows")
    if len(ids) > lsq.DENSE_NODES:
        raise ValueError(f"{len(ids)} nodes are too many to be solved densely")
    known = F.broadcast(spark.createDataFrame(pa.table({"i": pa.array(ids, pa.int32())})))  # bounded by the grid
    inside = sums.join(known, "i").join(known.withColumnRenamed("i", "j"), "j").groupBy("i", "j").agg(F.sum("v").alias("v"))
    right = sums.where(F.col("j") == RIGHT).join(known, "i").groupBy("i").agg(F.sum("v").alias("v"))
    x, error, _ = lsq.solve(*lsq.dense(inside, right, ids.tolist()))
    nodes = spark.createDataFrame(pa.table({"node": pa.array(ids, pa.int32()), "value": x, "error": error, "n": pa.array(n)}))
    fitted = sums.where(F.col("j") == WEIGHT).join(F.broadcast(nodes.select(F.col("node").alias("i"), "value")), "i").groupBy("cycle").agg(F.sum(F.col("v") * F.col("value")).alias("fitted"))
    one = lambda j, name: F.max(F.when((F.col("i") == WHOLE) & (F.col("j") == j), F.col("v"))).alias(name)
    level = (F.col("z") - F.coalesce("fitted", F.lit(0.0))) / F.col("n")
    cycles = sums.groupBy("cycle").agg(one(RIGHT, "z"), one(ROWS, "n")).join(fitted, "cycle", "left").select("cycle", level.alias("level"), F.col("n").cast("long").alias("n"))
    return nodes, cycles
