"""Job 1: from product records to an archive of cycle tables.

    python -m jobs.job1_cycle_archive EVENTS OUT [--config FILE]

The first step of every analysis: records of a mission's valid passes within the product limits (level 0), with sea level
anomalies free of frequency-dependent corrections in both bands, below the turning latitude (level 1); records whose
Ku-band height is an outlier of its cycle are marked.  Writes `OUT/cycles`, partitioned by mission and cycle, and `OUT/passes`,
a report for each pass: records read, kept at level 0 and at level 1, and outliers.

A cycle is rewritten as a whole (dynamic partition overwrite), so a run may be repeated, after a failure too, and gives the
same tables; cycles that the input no longer has stay.  Records without a time have no cycle and are left out; a cycle's
records are spread over several files, whatever its share of all.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tidemark.operators import filters, outliers
from tidemark.plans import steps
from tidemark.plans.fixture import observed
from tidemark.sources import tables

NAME = "job1_cycle_archive"
log = logging.getLogger(NAME)
COLUMNS = ["id", "pass_number", "time", "lat", "lon", "swh_ku", "wind_speed_alt", "sig0_ku", "ssha", "usla_ku", "usla_c", "outlier"]


def archived(records: DataFrame, mission: str, version: int, deviations: float) -> DataFrame:
    """Level-1 records with their heights; outliers of their cycle are marked."""
    level0 = tables.stack_passes(records.drop("usla_ku", "usla_c"), mission, version)
    level1 = filters.level1(steps.with_uncorrected(level0.withColumn("ssha", tables.height_anomaly(F.col)), mission), mission)
    limits = outliers.bounds(level1, F.col("usla_ku"), deviations, "cycle").select("cycle", "lo", "hi")
    marked = level1.join(F.broadcast(limits), "cycle")  # a row for each cycle
    return marked.withColumn("outlier", ~F.col("usla_ku").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def report(records: DataFrame, kept: DataFrame, mission: str, version: int) -> DataFrame:
    """(cycle, pass_number, n_read, n_level0, n_level1, n_outliers) of every pass of the input."""
    count = lambda df, name: df.groupBy("cycle", "pass_number").agg(F.count(F.lit(1)).alias(name))
    out = count(records, "n_read").join(count(tables.stack_passes(records, mission, version), "n_level0"), ["cycle", "pass_number"], "left")
    of = kept.groupBy("cycle", "pass_number").agg(F.count(F.lit(1)).alias("n_level1"), F.count_if("outlier").alias("n_outliers"))
    return out.join(of, ["cycle", "pass_number"], "left").na.fill(0, ["n_level0", "n_level1", "n_outliers"])


def run(spark: SparkSession, events: str, out: str, settings: dict) -> DataFrame:
    """Write the archive and its report; returns the archive read back, each record with its pass's report."""
    mission, version = settings["mission"], settings["version"]
    source = spark.read.parquet(events)
    records = observed(source).where(F.col("cycle").isNotNull())
    log.info("reading %s", events)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("mission", F.lit(mission))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mission", "cycle").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}").where(F.col("mission") == mission)

    kept = archived(records, mission, version, settings["deviations"]).select("cycle", *COLUMNS)
    spread = F.pmod(F.col("pass_number"), F.lit(settings["files_per_cycle"]))
    written = stored(tables.with_units(kept).repartition("cycle", spread), "cycles")
    passes = stored(report(records, written, mission, version).repartition("cycle"), "passes")  # a row for each pass
    total = passes.agg(*[F.sum(c).alias(c) for c in ("n_read", "n_level0", "n_level1", "n_outliers")], F.countDistinct("cycle").alias("cycles")).first()
    log.info("read %s records of %s cycles from %s", total["n_read"], total["cycles"], events)
    log.info("wrote %s records (%s at level 0, %s outliers) to %s/cycles, their passes to %s/passes", total["n_level1"], total["n_level0"], total["n_outliers"], out, out)
    return written.join(passes, ["mission", "cycle", "pass_number"])


if __name__ == "__main__":
    common.command(NAME, __doc__, run)
