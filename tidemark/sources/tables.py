"""Readers and writers of cycle tables, tracks, orbits, rasters, and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters
from .missions import MISSING_PASSES, SPECS

# Units of canonical columns.
UNITS = {"time": "s", "lat": "degrees_north", "lon": "degrees_east", "swh_ku": "m", "wind_speed_alt": "m/s", "sig0_ku": "dB", "range_ku": "m", "range_c": "m", "alt": "m", "usla_ku": "m", "usla_c": "m"}

# Track file names and the canonical ones they become.
TRACK_NAMES = {
    "inv_bar_static": "inv_bar", "inv_bar_mog2d": "dac", "range_numval": "range_numval_ku", "off_nadir_angle2_wf_ku": "off_nadir_angle_wf_ku", "wet_tropo_rad": "rad_wet_tropo_corr",
    "wet_tropo_ecmwf": "model_wet_tropo_corr", "dry_tropo_ecmwf": "model_dry_tropo_corr", "iono_alt": "iono_corr_alt_ku", "iono_gim": "iono_corr_gim_ku", "tide_pole": "pole_tide",
    "tide_non_equil": "ocean_tide_non_eq", "tide_internal": "internal_tide_hret", "tide_ocean_fes14": "ocean_tide_fes", "tide_ocean_got410": "ocean_tide_got", "tide_load_fes14": "load_tide_fes",
    "tide_load_got410": "load_tide_got", "tide_solid": "solid_earth_tide", "ssb_cls": "sea_state_bias_ku", "ssb_cls_c": "sea_state_bias_c", "mss_dtu21": "mean_sea_surface",
    "mss_cnescls15": "mean_sea_surface_cnes15", "rad_dist_coast": "rad_distance_to_land", "topo_srtm30plus": "bathymetry", "surface_type_rad": "rad_surf_type", "alt_gdrf": "alt",
}
# Single-frequency track names; each becomes the Ku and the C column.
KA_NAMES = ("range", "swh", "swh_rms", "sig0", "sig0_rms", "range_rms")


def with_units(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata={"units": UNITS[c]}) if c in UNITS else F.col(c) for c in df.columns])


def write_cycles(df: DataFrame, path: str) -> None:
    """Cycle table partitioned by mission and cycle, so that cycles prune and rewriting a cycle replaces it; a large cycle is dealt to several tasks and files."""
    with_units(df).hint("rebalance", "mission", "cycle").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mission", "cycle").parquet(path)


def read_cycles(spark: SparkSession, path: str, mission: str, cycles: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("mission") == mission)
    df = df if cycles is None else df.where(F.col("cycle").isin(cycles))
    return filters.without_bad_cycles(df, mission)


def stack_passes(df: DataFrame, mission: str, version: int = 0) -> DataFrame:
    """Pass records of a mission's valid passes within the level-0 limits."""
    last = SPECS[mission]["passes"]
    return filters.level0(df.where(F.col("pass_number").between(1, last) & ~F.col("pass_number").isin(list(MISSING_PASSES.get(mission, (0,))))), mission, version)


def new_cycles(available: DataFrame, produced: DataFrame) -> DataFrame:
    """Cycles on one side only, as the incremental run's work list."""
    a, b = available.select("cycle").distinct(), produced.select("cycle").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def existing_cycles(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Rows of cycles that have a table."""
    return wanted.join(available.select("cycle").distinct(), "cycle", "left_semi")


def height_anomaly(r) -> Column:
    """Sea surface height anomaly from canonical columns."""
    out = r("alt") - r("range_ku")
    for c in ("model_dry_tropo_corr", "rad_wet_tropo_corr", "iono_corr_alt_ku", "dac", "solid_earth_tide", "ocean_tide_fes", "load_tide_fes", "pole_tide", "sea_state_bias_ku", "mean_sea_surface"):
        out = out - r(c)
    return out


def pull_tracks(df: DataFrame, mission: str, least_rows: int = 3) -> DataFrame:
    """Track records of files with enough rows, within limits and with good flags, under canonical names and units."""
    if "file" in df.columns:
        df = df.join(df.groupBy("file").count().where(F.col("count") >= least_rows).select("file"), "file", "left_semi")
    kept = df.where(filters.within(filters.track_limits(mission), df.columns) & filters.flags_are(filters.track_flags(mission), df.columns))
    out = []
    for c in df.columns:
        v = F.col(c)
        if "off_nadir_angle2" in c:
            v = F.when(v >= 0, F.sqrt(v))
        elif "dist_" in c:
            v = v * 1000.0
        out.append(v.alias(TRACK_NAMES.get(c, c)))
    named = kept.select(*out)
    need = {"alt", "range_ku", "model_dry_tropo_corr", "rad_wet_tropo_corr", "iono_corr_alt_ku", "dac", "solid_earth_tide", "ocean_tide_fes", "load_tide_fes", "pole_tide", "sea_state_bias_ku", "mean_sea_surface"}
    return named.withColumn("ssha", height_anomaly(F.col)) if need <= set(named.columns) else named


def pull_ka_tracks(df: DataFrame) -> DataFrame:
    """Single-frequency records within limits; each measurement serves as Ku and as C."""
    from .limits import TRACK_KA

    kept = df.where(filters.within(TRACK_KA, df.columns))
    doubled = [F.col(f"{n}_ka").alias(f"{n}_{b}") for n in KA_NAMES for b in ("ku", "c") if f"{n}_ka" in df.columns]
    return kept.select(*[c for c in df.columns if c.removesuffix("_ka") not in KA_NAMES], *doubled)


def read_orbit(spark: SparkSession, path: str) -> DataFrame:
    """Ten white-space separated fields a line; the first is the record's index in its pass. Partition columns come along."""
    names = ["idx", "lat_new", "lon_new", "alt_new", "lat_old", "lon_old", "alt_old", "dlat", "dlon", "dalt"]
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path)
    return lines.where(F.length(F.trim("value")) > 0).select(*[c for c in lines.columns if c != "value"], *[f[i].cast("int" if i == 0 else "double").alias(n) for i, n in enumerate(names)])


def attach_orbit(passes: DataFrame, orbit: DataFrame, *by: str) -> DataFrame:
    """Orbit rows next to pass rows by index, within the keys `by` (cycle and pass) in which the index counts anew.

    The plan fails when it runs unless every row has exactly one partner, so a pass that is short on either side is an error.
    """
    keys = [*by, "idx"]
    alone = Window.partitionBy(*keys)
    left = passes.withColumn("__p", F.count(F.lit(1)).over(alone))
    right = orbit.withColumn("__o", F.count(F.lit(1)).over(alone))
    one = F.coalesce((F.col("__p") == 1) & (F.col("__o") == 1), F.lit(False))
    place = F.concat_ws(", ", *[F.concat_ws(" ", F.lit("index" if k == "idx" else k), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in ("idx", *by)])
    fault = F.raise_error(F.concat(F.lit("pass and orbit do not match at "), place)).cast("int")
    return left.join(right, keys, "full_outer").withColumn("idx", F.when(one, F.col("idx").cast("int")).otherwise(fault)).drop("__p", "__o")


def write_model(nodes: DataFrame, cycles: DataFrame, meta: DataFrame, path: str) -> None:
    for name, df in (("model_node", nodes), ("model_cycle", cycles), ("model_meta", meta)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("model_node", "model_cycle", "model_meta")}


def write_observations(obs: DataFrame, path: str) -> None:
    """Observation rows with their weights, partitioned by cycle, a large one by several tasks; node counts beside them."""
    obs.hint("rebalance", "cycle").write.mode("overwrite").partitionBy("cycle").parquet(f"{path}/obs")
    counts = obs.select("cycle", F.explode("nodes").alias("e")).where("e.w <> 0").groupBy("cycle", F.col("e.node").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/node_count")


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/obs"), spark.read.parquet(f"{path}/node_count")


def write_geo_model(levels: DataFrame, path: str) -> None:
    """Levels of (cycle, geo_cell) beside a model's tables."""
    levels.write.mode("overwrite").parquet(f"{path}/model_geo")


def model_bands(ku: dict[str, DataFrame], c: dict[str, DataFrame]) -> tuple[DataFrame, float]:
    """Both bands' node values side by side, and the ionosphere calibration in metres."""
    k = ku["model_node"].select("node", F.col("value").alias("ku"))
    joined = k.join(c["model_node"].select("node", F.col("value").alias("c")), "node", "full_outer")
    bias = ku["model_meta"].first()["iono_calib_bias"]
    return joined, bias * -0.01216


def error_bands(ku: DataFrame, c: DataFrame) -> DataFrame:
    """Deviations of both bands' node values from their variances (node, value); what has none is NULL."""
    root = lambda v: F.when(F.col(v) >= 0, F.sqrt(v))
    k = ku.select("node", root("value").alias("error_ku"))
    return k.join(c.select("node", root("value").alias("error_c")), "node", "full_outer")


def packed(column: Column, scale: float) -> Column:
    """A value as a scaled 16-bit integer."""
    return F.round(column / scale).cast(T.ShortType())
