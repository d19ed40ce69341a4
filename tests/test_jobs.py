"""Both jobs: against their SQL, repeated runs, growing input, corrections, command lines."""

import json
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import common, job1_cycle_archive, job2_cycle_model, registered
from tidemark.operators import lsq
from tidemark.storage import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def rounded(df):
    return rows(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]))


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    got, want = registered.QUERIES[name](spark, sf_dir).toPandas(), con.execute(registered.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        assert got[c].dtype == want[c].dtype, c
        assert got[c].tolist() == want[c].tolist() if got[c].dtype == object else np.array_equal(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_archive_is_partitioned_and_keeps_other_cycles(spark, sf_dir):
    out, part = shared_dir(spark, "archive"), shared_dir(spark, "part")
    settings = common.config(job1_cycle_archive.NAME)
    whole = rows(job1_cycle_archive.run(spark, f"{sf_dir}/events.parquet", out, settings))
    spark.read.parquet(f"{sf_dir}/events.parquet").where("ts >= '2024-01-11' and ts < '2024-01-21'").write.parquet(part)
    assert rows(job1_cycle_archive.run(spark, part, out, settings)) == whole  # cycle 2 again, the others as they were
    read = spark.read.parquet(f"{out}/cycles")
    assert {"mission", "cycle"} <= set(read.columns) and read.where("cycle = 2").count() > 0
    report = spark.read.parquet(f"{out}/passes")
    assert report.agg(F.sum("n_read")).first()[0] == 1000 and report.where("n_level1 > n_level0 or n_outliers > n_level1").isEmpty()


def test_odd_and_empty_records(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    timeless, empty, nameless = (shared_dir(spark, n) for n in ("timeless", "empty", "nameless"))
    e.limit(3).withColumn("ts", F.lit(None).cast("timestamp")).write.parquet(timeless)
    e.limit(0).write.parquet(empty)
    e.withColumn("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id"))).withColumn("extra", F.lit(1)).write.parquet(nameless)
    for p in (timeless, empty):
        assert job1_cycle_archive.run(spark, p, shared_dir(spark, "out"), common.config(job1_cycle_archive.NAME)).count() == 0
        with pytest.raises(ValueError, match="no observation"):
            job2_cycle_model.run(spark, p, shared_dir(spark, "out"), common.config(job2_cycle_model.NAME))
    settings = common.config(job1_cycle_archive.NAME)
    assert job1_cycle_archive.run(spark, nameless, shared_dir(spark, "out"), settings).where("id is null").isEmpty()  # they lack all that is derived from it
    assert job2_cycle_model.run(spark, nameless, shared_dir(spark, "out"), common.config(job2_cycle_model.NAME)).where("kind = 'node'").count() > 0


def test_model_follows_growing_input(spark, sf_dir):
    """Cycles that arrive, late records of a known cycle, and corrected ones: always the fit of the records as they then stand."""
    source, out = shared_dir(spark, "arrivals"), shared_dir(spark, "model")
    settings = common.config(job2_cycle_model.NAME)
    e = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/events.parquet")
    first = e.where("ts < '2024-01-16' and event_id % 5 <> 0")
    late = e.where("ts < '2024-01-16' and event_id % 5 = 0")
    new = e.where("ts >= '2024-01-16'")
    fixed = e.where("ts < '2024-01-11' and event_id % 3 = 0").withColumn("value", F.col("value") + 500)

    def fit(events):
        w = job2_cycle_model.weighed(events, settings)
        return rows(lsq.fit(w, least=settings["least"])[0].select("node", F.round("value", 8), F.round("error", 8), "n"))

    def nodes(model):
        return rows(model.where("kind = 'node'").select(F.col("key").alias("node"), F.round("value", 8), F.round("error", 8), "n"))

    first.coalesce(2).write.mode("append").parquet(source)
    one = job2_cycle_model.run(spark, source, out, settings)
    assert nodes(one) == fit(first)
    before = rounded(one)
    assert rounded(job2_cycle_model.run(spark, source, out, settings)) == before  # nothing new
    sums = {r["cycle"]: r["v"] for r in spark.read.parquet(f"{out}/sums").groupBy("cycle").agg(F.sum("v").alias("v")).collect()}
    late.unionByName(new).coalesce(1).write.mode("append").parquet(source)
    assert nodes(job2_cycle_model.run(spark, source, out, settings)) == fit(e)
    fixed.coalesce(1).write.mode("append").parquet(source)
    assert nodes(job2_cycle_model.run(spark, source, out, settings)) == fit(e.join(fixed.select("event_id"), "event_id", "left_anti").unionByName(fixed))
    batches = {r["batch"]: r["n"] for r in spark.read.parquet(f"{out}/rows").groupBy("batch").agg(F.countDistinct("cycle").alias("n")).collect()}
    assert len(batches) == 3 and batches[2] == 1 and sums  # the corrections touched their cycle only


def test_a_batch_that_is_repeated_counts_once(spark, sf_dir):
    from tidemark.streaming import incremental

    settings, path = common.config(job2_cycle_model.NAME), shared_dir(spark, "repeated")
    w = job2_cycle_model.weighed(spark.read.parquet(f"{sf_dir}/events.parquet"), settings)
    odd = w.limit(4).withColumn("id", F.lit(None).cast("long"))
    for _ in range(2):
        assert incremental.take_batch(w.unionByName(odd), 0, path) == [1, 2, 3]
    assert incremental.take_batch(w.limit(0), 1, path) == []
    total = spark.read.parquet(f"{path}/sums").where("i = -1 and j = -3").agg(F.sum("v")).first()[0]
    assert total == w.count() + 4


@pytest.mark.parametrize("job", [job1_cycle_archive, job2_cycle_model])
def test_command_line(tmp_path, sf_dir, job):
    (tmp_path / "own.json").write_text(json.dumps({k: v for k, v in list(common.config(job.NAME).items())[-1:]}))
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job.NAME}", f"{sf_dir}/events.parquet", f"file://{tmp_path}/out", "--config", f"{tmp_path}/own.json"], env=env, cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read" in done.stderr and "wrote" in done.stderr
    with pytest.raises(ValueError, match="unknown"):
        (tmp_path / "bad.json").write_text('{"no_such": 1}')
        common.config(job.NAME, f"{tmp_path}/bad.json")
