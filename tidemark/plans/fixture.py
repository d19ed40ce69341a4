"""Observation views over the generic driver tables, in SQL that Spark and DuckDB read alike.

Numbers with an exponent are doubles in both; `%` only meets operands that are not negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COLUMNS = {
    "id": "event_id",
    "cycle": "CAST(floor(t / 864000.0e0) AS INT) + 1",
    "pass_number": "CAST(user_id + 1 AS INT)",
    "time": "t",
    "lat": "((event_id * 7919) % 13200) / 100.0e0 - 66.0e0",
    "lon": "((event_id * 104729) % 36000) / 100.0e0",
    "swh_ku": "((event_id * 37) % 1250) / 100.0e0",
    "swh_c": "((event_id * 37) % 1250) / 100.0e0 + ((event_id * 13) % 100 - 50) / 1000.0e0",
    "wind_speed_alt": "((event_id * 53) % 2100) / 100.0e0",
    "sig0_ku": "10.0e0 + ((event_id * 31) % 1000) / 100.0e0",
    "usla_ku": "((event_id * 37) % 1250) / 100.0e0 * (0.0036e0 - 0.0045e0 * (((event_id * 53) % 2100) / 100.0e0) + 0.00019e0 * (((event_id * 53) % 2100) / 100.0e0) * (((event_id * 53) % 2100) / 100.0e0)) + (value - 50.0e0) / 10000.0e0",
    "usla_c": "((event_id * 37) % 1250) / 100.0e0 * (0.004e0 - 0.0045e0 * (((event_id * 53) % 2100) / 100.0e0) + 0.00019e0 * (((event_id * 53) % 2100) / 100.0e0) * (((event_id * 53) % 2100) / 100.0e0)) + (value - 50.0e0) / 9000.0e0",
    "range_ku": "1336000.0e0 + ((event_id * 17) % 1000) / 1000.0e0",
    "range_c": "1336000.0e0 + ((event_id * 17) % 1000) / 1000.0e0 + ((event_id * 19) % 200 - 100) / 1000.0e0",
    "alt": "1336000.0e0 + ((event_id * 17) % 1000) / 1000.0e0 + ((event_id * 23) % 2000) / 10.0e0 - 80.0e0",
    "iono_corr_gim_ku": "-(((event_id * 29) % 450) / 1000.0e0) + 0.04e0",
    "iono_corr_alt_ku": "-(((event_id * 29) % 450) / 1000.0e0) + 0.04e0 + ((event_id * 41) % 100 - 50) / 10000.0e0",
    "sea_state_bias_ku": "-0.03e0 * (((event_id * 37) % 1250) / 100.0e0)",
    "sea_state_bias_c": "-0.035e0 * (((event_id * 37) % 1250) / 100.0e0)",
    "model_dry_tropo_corr": "-2.6e0 + ((event_id * 43) % 100) / 125.0e0",
    "rad_wet_tropo_corr": "-(((event_id * 47) % 550) / 1000.0e0)",
    "model_wet_tropo_corr": "-(((event_id * 47) % 550) / 1000.0e0) + ((event_id * 59) % 200 - 100) / 1000.0e0",
    "dac": "((event_id * 61) % 4400 - 2200) / 1000.0e0",
    "solid_earth_tide": "((event_id * 67) % 400 - 200) / 1000.0e0",
    "ocean_tide_fes": "((event_id * 71) % 2000 - 1000) / 1000.0e0",
    "ocean_tide_got": "((event_id * 71) % 2000 - 1000) / 1000.0e0 + 0.01e0",
    "load_tide_fes": "((event_id * 73) % 100 - 50) / 1000.0e0",
    "pole_tide": "((event_id * 79) % 20 - 10) / 1000.0e0",
    "mean_sea_surface": "((event_id * 83) % 6000) / 100.0e0 - 30.0e0",
    "mean_sea_surface_dtu": "((event_id * 83) % 6000) / 100.0e0 - 30.0e0 + ((event_id * 5) % 40 - 20) / 1000.0e0",
    "inv_bar_corr": "((event_id * 11) % 1200 - 500) / 1000.0e0",
    "hf_fluctuations_corr": "((event_id * 7) % 100 - 50) / 1000.0e0",
    "swh_rms_ku": "0.3e0 + 0.02e0 * (((event_id * 37) % 1250) / 100.0e0) + (value % 1.0e0) / 2.0e0",
    "swh_rms_c": "1.5e0 + 0.05e0 * (((event_id * 37) % 1250) / 100.0e0) + (value % 1.0e0)",
    "sig0_rms_ku": "0.1e0 + ((event_id * 97) % 100) / 125.0e0",
    "range_rms_ku": "0.05e0 + 0.01e0 * (((event_id * 37) % 1250) / 100.0e0) + ((event_id * 89) % 100) / 2000.0e0",
    "off_nadir_angle_wf_ku": "((event_id * 101) % 200 - 100) / 1000.0e0",
    "range_numval_ku": "9.0e0 + ((event_id * 3) % 130) / 10.0e0",
    "rad_distance_to_land": "((event_id * 103) % 8000) * 1000.0e0",
    "bathymetry": "100.0e0 - (event_id * 107) % 6000",
    "rad_surf_type": "CASE WHEN (event_id * 109) % 10 = 0 THEN 1 ELSE 0 END",
}
OBSERVATIONS = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _COLUMNS.items()) + " FROM (SELECT *, {t} AS t FROM {events}) e"
#: Straight tracks of 50 records; odd passes ascend.
TRACKS = (
    "SELECT event_id AS id, CAST(floor(event_id / 50.0e0) AS INT) AS pass_number, CAST(floor(event_id / 3300.0e0) AS INT) + 1 AS cycle, floor(event_id / 50.0e0) * 6000.0e0 + (event_id % 50) * 60.0e0 AS time, "
    "CASE WHEN CAST(floor(event_id / 50.0e0) AS INT) % 2 = 1 THEN -60.0e0 + 2.4e0 * (event_id % 50) ELSE 60.0e0 - 2.4e0 * (event_id % 50) END AS lat, "
    "(CAST(floor(event_id / 50.0e0) AS INT) * 37) % 240 - 170.0e0 + 1.3e0 * (event_id % 50) AS lon, ((event_id * 37) % 1250) / 100.0e0 AS swh_ku FROM {events} e"
)
_SPARK_TIME = "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000.0e0 - 1704067200.0e0"
_DUCK_TIME = "epoch_us(ts) / 1000000.0e0 - 1704067200.0e0"


def observed(events: DataFrame) -> DataFrame:
    """The observation columns of any table of events."""
    return events.sparkSession.sql(OBSERVATIONS.replace("{t}", _SPARK_TIME).replace("{events}", "{source}"), source=events)


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("{t}", _SPARK_TIME).replace("{events}", "{source}"), source=spark.read.parquet(f"{sf_dir}/events.parquet"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, OBSERVATIONS)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TRACKS)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views `obs` and `tracks` in front."""
    o = OBSERVATIONS.replace("{t}", _DUCK_TIME).replace("{events}", "events")
    return f"WITH RECURSIVE obs AS ({o}), tracks AS ({TRACKS.replace('{events}', 'events')})" + (f", {sql.strip()[5:]}" if sql.strip().lower().startswith("with ") else f" {sql.strip()}")
