"""Job 2: a sea state bias model that follows the archive as cycles arrive or are processed anew.

    python -m jobs.job2_cycle_model EVENTS OUT [--config FILE]

A file stream takes the files that are new since the last run (its checkpoint is `OUT/checkpoint`).  Their records are kept
by cycle in `OUT/rows`, and the normal equations of their cycles are made anew from those cycles' records alone, in
`OUT/sums`; a record that comes again replaces its older version.  Then the grid is solved from the sums of all cycles, which
the grid bounds, and `OUT/model` is written: nodes (value, formal error, observations) and cycles (mean residual,
observations), partitioned by kind.

A run that fails is repeated from its checkpoint: a batch replaces what it wrote before, so nothing counts twice.  A run without
new files gives the same model.  Records without a time, outside the grid or without a height are left out.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tidemark.operators import design
from tidemark.operators.grid import Axis, Grid
from tidemark.plans.fixture import observed
from tidemark.streaming import incremental

NAME = "job2_cycle_model"
log = logging.getLogger(NAME)


def weighed(events: DataFrame, settings: dict) -> DataFrame:
    """Observation rows (id, cycle, z, nodes) inside the grid."""
    x, y = settings["x"], settings["y"]
    grid = Grid(*[Axis(a["first"], a["step"], a["count"]) for a in (x, y)])
    rows = observed(events).select("id", "cycle", F.col(settings["z"]).alias("z"), design.weights(grid, F.col(x["column"]), F.col(y["column"])).alias("nodes"))
    return rows.where(F.col("cycle").isNotNull() & F.col("z").isNotNull() & F.col("nodes").isNotNull())


def run(spark: SparkSession, events: str, out: str, settings: dict) -> DataFrame:
    """Take what is new, solve, write the model; returns it read back (kind, key, value, error, n)."""

    def take(batch: DataFrame, number: int) -> None:
        cycles = incremental.take_batch(weighed(batch, settings), number, out)
        log.info("batch %s: cycles %s", number, cycles)

    schema = spark.read.parquet(events).schema
    events = events.rstrip("/")
    table = f"{events[:-1]}[{events[-1]}]"  # as a pattern, a stream takes a table that is one file, too
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(table)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s new records from %s", sum(p["numInputRows"] for p in query.recentProgress), events)
    try:
        sums = spark.read.parquet(f"{out}/sums")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"no observation of {events} lies inside the grid so far") from e
        raise
    nodes, cycles = incremental.solve_sums(sums, settings["least"])
    model = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("key"), "value", "error", "n")
    model = model.unionByName(cycles.select(F.lit("cycle").alias("kind"), F.col("cycle").alias("key"), F.col("level").alias("value"), F.lit(None).cast("double").alias("error"), "n"))
    model.repartition("kind").write.mode("overwrite").partitionBy("kind").parquet(f"{out}/model")
    written = spark.read.parquet(f"{out}/model").select("kind", "key", "value", "error", "n")
    log.info("wrote %s rows to %s/model", written.count(), out)
    return written


if __name__ == "__main__":
    common.command(NAME, __doc__, run)
