"""The jobs as queries: each runs twice into one new folder, and its output is read back; next to DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common, job1_cycle_archive, job2_cycle_model
from tidemark.plans.fixture import oracle
from tidemark.plans.registered import _LIMITS, _USLA_K, SMALL, _r, r6
from tidemark.plans.registered_fits import cells_sql, normal_sql, with_sql, within_sql
from tidemark.storage import shared_dir


def _twice(spark: SparkSession, sf_dir: str, job) -> DataFrame:
    out = shared_dir(spark, job.NAME)
    for _ in range(2):
        result = job.run(spark, f"{sf_dir}/events.parquet", out, common.config(job.NAME))
    return result


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _twice(spark, sf_dir, job1_cycle_archive)
    return got.select("mission", "cycle", "pass_number", "id", *[r6(c).alias(c) for c in ("ssha", "usla_ku", "usla_c")], F.col("outlier").cast("int").alias("outlier"), "n_read", "n_level0", "n_level1", "n_outliers")


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _twice(spark, sf_dir, job2_cycle_model)
    return got.select("kind", F.col("key").cast("int").alias("key"), r6("value").alias("value"), r6("error").alias("error"), "n")


_SSHA = "alt - range_ku - model_dry_tropo_corr - rad_wet_tropo_corr - iono_corr_alt_ku - dac - solid_earth_tide - ocean_tide_fes - load_tide_fes - pole_tide - sea_state_bias_ku - mean_sea_surface"
_ARCHIVE = [
    f"l0 AS (SELECT *, {_SSHA} AS ssha FROM obs WHERE pass_number BETWEEN 1 AND 254 AND {_LIMITS} AND alt - range_ku BETWEEN -130e0 AND 100e0)",
    f"l1 AS (SELECT id, cycle, pass_number, ssha, ssha + sea_state_bias_ku + iono_corr_alt_ku - iono_corr_gim_ku AS u, ssha + sea_state_bias_ku + iono_corr_alt_ku + range_ku - range_c - {_USLA_K} * iono_corr_gim_ku AS c FROM l0 WHERE abs(lat) < 66.16e0)",
    *within_sql("sound", "l1", "u", "2e0", "cycle", 20),
    "marked AS (SELECT *, CASE WHEN id IN (SELECT id FROM sound) THEN 0 ELSE 1 END AS outlier FROM l1)",
    "n0 AS (SELECT cycle, pass_number, count(*) AS n FROM obs GROUP BY 1, 2)",
    "n1 AS (SELECT cycle, pass_number, count(*) AS n FROM l0 GROUP BY 1, 2)",
    "n2 AS (SELECT cycle, pass_number, count(*) AS n, count(*) FILTER (WHERE outlier = 1) AS bad FROM marked GROUP BY 1, 2)",
]
_W = [*cells_sql("w", "obs", SMALL, "swh_ku", "wind_speed_alt", "id, cycle, usla_ku AS z"), *normal_sql("solved", "w", 5)]
_MODEL = [
    *_W,
    "whole AS (SELECT cycle, sum(usla_ku) AS z, count(*) AS n FROM w_1 GROUP BY cycle)",
    "fitted AS (SELECT w.cycle, sum(w.w * s.value) AS f FROM w JOIN solved s ON s.node = w.node GROUP BY w.cycle)",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {job1_cycle_archive.NAME: _archive, job2_cycle_model.NAME: _model}
ORACLES = {
    job1_cycle_archive.NAME: oracle(with_sql(_ARCHIVE, f"SELECT 'j2' AS mission, m.cycle, m.pass_number, m.id, {_r('m.ssha', 'ssha')}, {_r('m.u', 'usla_ku')}, {_r('m.c', 'usla_c')}, m.outlier, n0.n AS n_read, n1.n AS n_level0, n2.n AS n_level1, n2.bad AS n_outliers FROM marked m JOIN n0 USING (cycle, pass_number) JOIN n1 USING (cycle, pass_number) JOIN n2 USING (cycle, pass_number)")),
    job2_cycle_model.NAME: oracle(with_sql(_MODEL, f"SELECT 'node' AS kind, node AS key, {_r('value', 'value')}, {_r('error', 'error')}, n FROM solved UNION ALL SELECT 'cycle', cycle, {_r('(z - coalesce(f, 0e0)) / n', 'value')}, NULL, n FROM whole LEFT JOIN fitted USING (cycle)")),
}
