"""Registered queries of whole filters, drivers and writers on fixtures where every branch has rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics, variables
from ..operators import filters, windows
from ..operators import grid as grids
from ..sources import catalog
from ..storage import shared_dir
from . import applying, steps
from .fixture import observations, tracks
from .registered import _DIST, _LEVEL2, _USLA_K, GRID, MISSION, _ecef_sql, _noise_sql, _one_to_one_sql, _r, _wind_sql, query, r6
from .registered_fits import _AGAIN, _FULL, _X_CTES, _again, _bm3_sql, _full, difference_sql, with_sql

_FREE = "ssha + sea_state_bias_ku + iono_corr_alt_ku + range_ku"


@query("P4_uncorrected_subset", f"SELECT id, {_r(f'{_FREE} - 1336000e0', 'free')}, {_r(f'{_FREE} - range_ku - iono_corr_gim_ku', 'ku')}, {_r(f'{_FREE} - range_c - {_USLA_K} * iono_corr_gim_ku', 'c')} FROM (SELECT * EXCLUDE (usla_ku, usla_c), usla_ku - 0.0123456789e0 * swh_ku AS ssha FROM obs) WHERE abs(lat) < 66.16::DOUBLE AND id % 3 <> 0")
def _subset(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("ssha", F.col("usla_ku") - 0.0123456789 * F.col("swh_ku")).drop("usla_ku", "usla_c").where(F.pmod("id", F.lit(3)) != 0)
    out = filters.level1(steps.with_uncorrected(o, MISSION), MISSION)
    return out.select("id", r6(F.col("ssha_free") - 1336000.0).alias("free"), r6("usla_ku").alias("ku"), r6("usla_c").alias("c"))


@query("P14_other_retracker", f"SELECT id, {_r('usla_ku + range_ku - (range_ku - 0.01e0 * swh_ku)', 'mle3')}, {_r('usla_c', 'mle3_c')}, {_r('usla_ku / 2 + sea_state_bias_c', 'plrm')}, {_r('swh_c', 'x')}, {_r('wind_speed_alt + 1e0', 'y')}, {_r('sig0_ku - 2e0', 's')} FROM obs")
def _retracker(spark, sf_dir):
    o = observations(spark, sf_dir).withColumns({"range_ku_mle3": F.col("range_ku") - 0.01 * F.col("swh_ku"), "ssha_plrm": F.col("usla_ku") / 2, "ssb_plrm": F.col("sea_state_bias_c"), "swh_ku_mle3": F.col("swh_c"), "wind_speed_alt_mle3": F.col("wind_speed_alt") + 1.0, "swh_ku_plrm": F.col("swh_ku"), "sig0_ku_plrm": F.col("sig0_ku") - 2.0})
    x, y = variables.independent(MISSION, err="mle3")
    _, s = variables.independent(MISSION, err="plrm", second="sig0")
    z = {"mle3": variables.dependent("usla", err="mle3"), "mle3_c": variables.dependent("usla", "c", err="mle3"), "plrm": variables.dependent("usla", err="plrm"), "x": x, "y": y, "s": s}
    return o.select("id", *[r6(v).alias(n) for n, v in z.items()])


_H = "(alt - range_ku - model_dry_tropo_corr - rad_wet_tropo_corr - solid_earth_tide - ocean_tide_fes - pole_tide - inv_bar_corr - hf_fluctuations_corr)"
#: Columns that a model and other products would add, and the variables that need them.
_ADDED = {
    "alt_cnes": "alt + 0.01e0 * swh_ku", "alt_jpl": "alt - 0.02e0 * swh_ku", "iono_corr_alt_ku_smooth": "iono_corr_alt_ku + 0.001e0 * swh_ku", "mean_sea_surface_cnes15": "mean_sea_surface + 0.003e0 * swh_ku",
    "iono_model": "-0.01e0 * swh_ku", "iono_model_uc": "-0.02e0 * swh_ku", "ssb_model": "-0.03e0 * swh_ku",
}
_WITH_MODEL = {
    "alt_cnes": "usla_c + alt - alt_cnes", "alt_jpl": "usla_c + alt - alt_jpl", "iono_tran_smooth": f"usla_c + {_USLA_K} * (iono_corr_gim_ku - iono_corr_alt_ku_smooth)",
    "iono_corr_alt": f"usla_c + {_USLA_K} * iono_corr_gim_ku - iono_model", "mss_cnes15": "usla_c + mean_sea_surface - mean_sea_surface_cnes15", "I_tdm": "iono_model", "I_tdm_uc": "iono_model_uc", "SSB_tdm": "ssb_model",
    "SLA": f"{_H} - ssb_model - iono_model - mean_sea_surface", "SLA_tdm": f"{_H} - ssb_model - iono_model - mean_sea_surface", "SLA_uc": f"{_H} - ssb_model - iono_model_uc - mean_sea_surface",
    "SLA_tdm_uc": f"{_H} - ssb_model - iono_model_uc - mean_sea_surface", "USLA_tdm": f"{_H} - iono_model - mean_sea_surface", "USLA_tdm_uc": f"{_H} - iono_model_uc - mean_sea_surface",
    "SSH_tdm": f"{_H} - ssb_model - iono_model", "SSH_tdm_uc": f"{_H} - ssb_model - iono_model_uc", "SLAin": f"{_H} - sea_state_bias_ku - iono_corr_alt_ku_smooth - mean_sea_surface",
    "ORB_tdm": "alt - range_ku - ssb_model", "ORMin_tdm": "alt - range_ku - mean_sea_surface", "ORMB_tdm": "alt - range_ku - mean_sea_surface - ssb_model",
}


@query("P7_variables_of_models", "SELECT id, " + ", ".join(_r(e, f"v_{n.lower()}") for n, e in _WITH_MODEL.items()) + f" FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _ADDED.items())} FROM obs)")
def _of_models(spark, sf_dir):
    swh = F.col("swh_ku")
    o = observations(spark, sf_dir).withColumns({"alt_cnes": F.col("alt") + 0.01 * swh, "alt_jpl": F.col("alt") - 0.02 * swh, "iono_corr_alt_ku_smooth": F.col("iono_corr_alt_ku") + 0.001 * swh, "mean_sea_surface_cnes15": F.col("mean_sea_surface") + 0.003 * swh, "iono_model": -0.01 * swh, "iono_model_uc": -0.02 * swh, "ssb_model": -0.03 * swh})
    return o.select("id", *[r6(variables.dependent(n, "c", MISSION)).alias(f"v_{n.lower()}") for n in _WITH_MODEL])


_W, _S = f"(swh_ku + {_noise_sql('swh_rms_ku', 3)})", f"(sig0_ku + {_noise_sql('sig0_rms_ku', 5)})"
_PERTURBED = {"x_ws": _W, "y_ws": _wind_sql(_S, swh=_W), "y_w": _wind_sql("sig0_ku", swh=_W), "x_smth": "swh_c", "y_smth": _wind_sql("sig0_ku", swh="swh_c"), "s_rs": _S, "z_rws": f"usla_ku + {_noise_sql('range_rms_ku', 11)}", "z_wr_c": f"usla_c + {_noise_sql('swh_rms_c', 11)}", "y_j1": "wind_speed_alt"}


@query("P8_perturbations", "SELECT id, " + ", ".join(_r(e, n) for n, e in _PERTURBED.items()) + " FROM obs")
def _perturbations(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("swh_ku_smooth", F.col("swh_c")).withColumn("range_rms_c", F.col("swh_rms_c"))
    at = lambda err, k, **how: variables.independent(MISSION, err=err, **how)[k]
    found = {"x_ws": at("rms_ws", 0), "y_ws": at("rms_ws", 1), "y_w": at("rms_w", 1), "x_smth": at("smth_swh", 0), "y_smth": at("smth_swh", 1), "s_rs": at("rms_rs", 1, second="sig0"), "z_rws": variables.dependent("usla", err="rms_rws"), "z_wr_c": variables.dependent("usla", "c", err="rms_wr"), "y_j1": at("j1j2", 1)}
    return o.select("id", *[r6(v).alias(n) for n, v in found.items()])


@query("F3_level1", "SELECT id FROM obs WHERE abs(lat * 1.2e0) < 66.16::DOUBLE AND id % 11 <> 0 AND id % 7 <> 0")
def _level1(spark, sf_dir):
    o = observations(spark, sf_dir).withColumns({"lat": F.col("lat") * 1.2, "usla_c": F.when(F.pmod("id", F.lit(11)) != 0, F.col("usla_c")), "usla_ku": F.when(F.pmod("id", F.lit(7)) != 0, F.col("usla_ku"))})
    return filters.level1(o, MISSION).select("id")


@query("F4_near_in_time", "SELECT a.id AS a, b.id AS b FROM obs a JOIN obs b ON b.id = 2 * a.id WHERE abs(a.time - b.time) / 86400e0 < 10e0 AND abs(a.lat * 1.1e0) < 66.16::DOUBLE")
def _near_time(spark, sf_dir):
    o = observations(spark, sf_dir).select("id", "time", (F.col("lat") * 1.1).alias("lat"), "usla_ku", "usla_c")
    b = o.select(F.col("id").alias("b"), F.col("time").alias("time_b"))
    return steps.observed_pairs(o.withColumnRenamed("time", "time_a").join(b, F.col("id") * 2 == F.col("b")), MISSION).select(F.col("id").alias("a"), "b")


_COAST = _LEVEL2.replace("rad_distance_to_land >= 50000.0e0 AND rad_distance_to_land < 6000000.0e0 AND bathymetry BETWEEN -400000.0e0 AND -300.0e0", "rad_distance_to_land >= 0 AND rad_distance_to_land < 30000.0e0 AND bathymetry BETWEEN -400000.0e0 AND 0.0e0")


@query("F5_level2_coast", f"SELECT id FROM (SELECT * REPLACE (rad_distance_to_land / 200e0 AS rad_distance_to_land) FROM obs) WHERE {_COAST}")
def _level2_coast(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("rad_distance_to_land", F.col("rad_distance_to_land") / 200.0)
    return o.where(filters.level2(o.columns, MISSION, open_ocean=False)).select("id")


@query("F17_bad_cycles", "SELECT cycle, count(*) AS n FROM (SELECT CAST(105 + id % 12 AS INT) AS cycle FROM obs) WHERE cycle NOT IN (112, 213, 111, 212) GROUP BY cycle")
def _bad_cycles(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("cycle", (105 + F.pmod("id", F.lit(12))).cast("int"))
    return filters.without_bad_cycles(o, "j3", collinear=True).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))


_GAPPED = "t AS (SELECT id, cycle, pass_number, swh_ku, time + CASE WHEN id % 50 > 30 THEN 600e0 ELSE 0e0 END AS time FROM tracks), v AS (SELECT id, avg(swh_ku) OVER w AS m, count(*) OVER w AS n, last(time) OVER w - first(time) OVER w AS span FROM t WINDOW w AS (PARTITION BY cycle, pass_number ORDER BY time ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"


@query("W1_moving_mean_cut", f"WITH {_GAPPED} SELECT id, {_r('m', 'smooth')} FROM v WHERE n = 11 AND abs(span - 600e0) <= 0.5e0")
def _moving_cut(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("time", F.col("time") + F.when(F.pmod("id", F.lit(50)) > 30, 600.0).otherwise(0.0))
    return windows.moving_mean(t, "swh_ku", 11, "cycle", "pass_number", cut=True, max_step=100.0).select("id", r6("smooth").alias("smooth"))


def _points_sql(name: str, rows: str) -> str:
    return f"{name} AS (SELECT *, {_ecef_sql('lat', 'lon', '')} FROM {rows})"


_PHASE = [
    _FULL,
    _AGAIN,
    _points_sql("pa", "(SELECT * REPLACE (cycle + 280 AS cycle) FROM full_)"),
    _points_sql("pb", "(SELECT * REPLACE (cycle - 1 AS cycle) FROM again WHERE id >= 10000000)"),
    f"d AS (SELECT a.id AS a, b.id AS b, a.cycle, a.pass_number, a.swh_ku AS s, b.swh_ku AS s2, {_DIST} AS dist FROM pa a JOIN pb b ON b.cycle = a.cycle - 280 AND a.cycle BETWEEN 281 AND 303 AND a.pass_number = b.pass_number AND {_DIST} <= 950)",
    _one_to_one_sql(950, "cycle, pass_number"),
]


@query("J14_tandem_driver", with_sql(_PHASE, f"SELECT a AS id, b AS id_j3, {_r('s', 'swh_ku')}, {_r('s2', 'swh_ku_j3')} FROM m"))
def _tandem_driver(spark, sf_dir):
    a = _full(spark, sf_dir).withColumn("cycle", F.col("cycle") + 280)
    b = _again(spark, sf_dir).where("id >= 10000000").withColumn("cycle", F.col("cycle") - 1)
    return steps.tandem_tables(a, b, "j2j3").select("id", "id_j3", r6("swh_ku").alias("swh_ku"), r6("swh_ku_j3").alias("swh_ku_j3"))


#: Every record in every third cycle, which has no next one; and its copy some metres off in the cycle before, with other waves and wind.
_PAIRED = "paired AS (SELECT *, ((id * 61 + 7) % 1250) / 100e0 AS s, ((id * 71 + 3) % 2100) / 100e0 AS w FROM full_)"
_COPIES = f"cz AS (SELECT 3 * cycle - 1 AS cycle, {_bm3_sql('s', 'w')} + ((id * 19) % 100) / 10000e0 - usla_ku AS z FROM paired WHERE swh_ku > 0 AND s > 0 AND wind_speed_alt > 0 AND w > 0)"
_OWN = [_X_CTES[0], _X_CTES[1].replace("abs(b.cycle - a.cycle) <= 1", "b.cycle = a.cycle"), *_X_CTES[2:], *difference_sql("xw", "xq", GRID, "a0, z")]


@query("J11_difference_driver", with_sql([*_OWN, _PAIRED, _COPIES], f"SELECT cycle, 'collinear' AS kind, count(*) AS n, {_r('sum(z)', 'z')} FROM cz GROUP BY cycle UNION ALL SELECT CAST(3 * f.cycle AS INT), 'crossover', count(*), {_r('sum(z)', 'z')} FROM (SELECT DISTINCT id, a0, z FROM xw) x JOIN full_ f ON f.id = x.a0 GROUP BY f.cycle"))
def _difference_driver(spark, sf_dir):
    """Copies meet the next cycle, whose own records then have crossovers among themselves."""
    points = _again(spark, sf_dir)
    points = points.withColumn("cycle", F.when(F.col("id") < 10000000, F.col("cycle") * 3).otherwise(F.col("cycle") * 3 - 4))
    d = steps.differences(points, GRID, MISSION, radius=1000.0, crossing_radius=400000.0, max_days=3.0)
    return d.groupBy("cycle", "kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("z")).alias("z"))


# --- the model applied --------------------------------------------------------------------------------------------

_SIGMA = {"ku": "(0.01e0 + 0.001e0 * swh_ku)", "c": "(0.02e0 + 0.001e0 * swh_ku)"}
_I = f"({physics.C_HZ**2 / (physics.KU_HZ**2 - physics.C_HZ**2)!r}::DOUBLE)"


def _smooth_sql(c: str, by: str) -> str:
    window = f"(PARTITION BY {by} ORDER BY time ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
    return f"CASE WHEN count({c}) OVER (PARTITION BY {by}) > 100 THEN CASE WHEN count(*) OVER {window} = 21 THEN avg({c}) OVER {window} END ELSE {c} END"


_APPLIED = [
    f"a AS (SELECT *, -0.03e0 * swh_ku - 0.001e0 * wind_speed_alt AS sk, -0.035e0 * swh_ku AS sc, {_noise_sql(_SIGMA['ku'], 21)} AS ek, {_noise_sql(_SIGMA['c'], 22)} AS ec, {_noise_sql('range_rms_ku', 23)} AS rk, CAST(NULL AS DOUBLE) AS rc FROM (SELECT * REPLACE (range_ku - 1336000e0 AS range_ku, range_c - 1336000e0 AS range_c) FROM obs) WHERE swh_ku <= 13 AND wind_speed_alt <= 21)",
    f"b AS (SELECT *, {_I} * (range_ku + sk - (range_c + sc) + 0.02e0) AS im, {_I} * (range_ku + sk + ek - (range_c + sc + ec) + 0.02e0) AS ime, {_I} * (range_ku + sea_state_bias_ku - (range_c + sea_state_bias_c)) AS ic FROM a)",
    f"c AS (SELECT *, {_smooth_sql('im', 'cycle')} AS ims, {_smooth_sql('ic', 'cycle')} AS ics FROM b)",
]


def _applied(spark, o, **how):
    x, y = F.col("x"), F.col("y")
    n = grids.nodes(spark, GRID)
    values = {"ku": F.lit(-0.03) * x - F.lit(0.001) * y, "c": F.lit(-0.035) * x, "error_ku": F.lit(0.01) + F.lit(0.001) * x, "error_c": F.lit(0.02) + F.lit(0.001) * x}
    return applying.applied(o, {k: n.select("node", v.alias("value")) for k, v in values.items()}, GRID, calibration=0.02, by=("cycle",), max_step=None, **how)


@query("S12_apply_model", with_sql(_APPLIED, f"SELECT id, {_r('sk', 'ssb')}, {_r('sc', 'ssb_c')}, {_r('sk + ek', 'ssb_err')}, {_r('sea_state_bias_ku + ek', 'cls_err')}, {_r('im', 'iono')}, {_r('ime', 'iono_err')}, {_r('ims', 'iono_smooth')}, {_r('ics', 'iono_cls_smooth')}, {_r('rk', 'err_range')}, rc AS err_range_c FROM c"))
def _apply(spark, sf_dir):
    o = observations(spark, sf_dir).withColumnsRenamed({"sea_state_bias_ku": "ssb_cls", "sea_state_bias_c": "ssb_cls_c"})
    o = o.withColumns({c: F.col(c) - 1336000.0 for c in ("range_ku", "range_c")})  # short of rounding
    path = shared_dir(spark, "applied")
    _applied(spark, o).where("ssb_model is not null").withColumn("mission", F.lit(MISSION)).write.partitionBy("mission", "cycle").parquet(path)
    out = spark.read.parquet(path)
    names = {"ssb_model": "ssb", "ssb_model_c": "ssb_c", "ssb_model_err": "ssb_err", "ssb_cls_err": "cls_err", "iono_model": "iono", "iono_model_err": "iono_err", "iono_model_smooth": "iono_smooth", "iono_cls_smooth": "iono_cls_smooth", "err_range_ku": "err_range", "err_range_c": "err_range_c"}
    return out.select("id", *[r6(c).alias(n) for c, n in names.items()])


@query("S12_direct_copy", f"SELECT id, {_r('usla_ku', 'usla')} FROM obs")
def _copy(spark, sf_dir):
    o = observations(spark, sf_dir).select("id", "usla_ku")
    return _applied(spark, o).select("id", r6("usla_ku").alias("usla"))


_ERRS = ("rms_rws", "rms_rw", "rms_wx", "rms_Ewr", "rms_rs", "rms_r", "rng_corr", "smth_swh", None)


@query("S20_file_keys", "SELECT t.err, t.stored, count(*) AS n FROM (VALUES (0, 'rms_rws', 'rms_ws'), (1, 'rms_rw', 'rms_w'), (2, 'rms_wx', 'rms_w'), (3, 'rms_Ewr', 'rms_Ew'), (4, 'rms_rs', 'rms_s'), (5, 'rms_r', NULL), (6, 'rng_corr', NULL), (7, 'smth_swh', 'smth_swh'), (8, NULL, NULL)) t(k, err, stored) JOIN obs ON obs.id % 9 = t.k GROUP BY ALL")
def _keys(spark, sf_dir):
    """Records of each perturbation, written under the key that it is stored by and read from there."""
    stored = spark.createDataFrame([(k, e, catalog.partition_keys("j2", "dir", "usla", err=e)["err"]) for k, e in enumerate(_ERRS)], "k long, err string, stored string")
    path = shared_dir(spark, "keys")
    o = observations(spark, sf_dir).select(F.pmod("id", F.lit(9)).cast("long").alias("k"), "id")
    o.join(F.broadcast(stored), "k").select("id", "err", "stored").write.partitionBy("stored").parquet(path)
    return spark.read.schema("id long, err string, stored string").parquet(path).groupBy("err", "stored").agg(F.count(F.lit(1)).alias("n"))


_CATALOG = """
<var name="swh" field="1"><limits>0 8</limits><data>swh_ku</data></var>
<var name="above" field="2"><data>alt range_ku SUB</data><default>5</default></var>
<var name="tide" sat="j1 j2"><data>dac 2 MUL</data><quality_flag>rad_surf_type</quality_flag></var>
<var name="tide" sat="!j1 j2"><data>pole_tide</data></var>
"""


@query("S14_xml_catalog", f"SELECT id, {_r('CASE WHEN swh_ku BETWEEN 0 AND 8 THEN swh_ku END', 'swh')}, {_r('alt - range_ku', 'above')}, {_r('CASE WHEN rad_surf_type = 0 THEN dac * 2 END', 'tide')} FROM obs")
def _xml(spark, sf_dir):
    o = observations(spark, sf_dir)
    found = {v.name: v.column(o.columns, "j2") for v in catalog.read_catalog(_CATALOG)}
    return o.select("id", *[r6(c).alias(n) for n, c in found.items()])


_GRAPH = """
<var name="height" field="0"><data>alt range_ku SUB dry SUB wet SUB
    corrections SUB</data><quality_flag>swh_ku sig0_ku usla_c rad_surf_type</quality_flag></var>
<var name="swh_ku"><limits>0 8</limits><data>swh_ku</data></var>
<var name="sig0_ku"><limits>11 18</limits><data>sig0_ku</data><default>0</default></var>
<var name="corrections"><data>tide dac ADD</data></var>
<alias name="tide" field="12"> ocean_tide_none ocean_tide_got ocean_tide_fes </alias>
<alias name="wet" field="8" sat="!c2 g1 gs">rad_wet_tropo_corr</alias>
<alias name="wet" field="8" sat="c2 g1 gs">model_wet_tropo_corr</alias>
<alias name="dry" sat="g1 tx">dry_tropo_none</alias>
<alias name="dry" sat="!g1 tx">model_dry_tropo_corr</alias>
"""


@query("S14_catalog_graph", f"SELECT id, {_r('CASE WHEN swh_ku BETWEEN 0 AND 8 AND sig0_ku BETWEEN 11 AND 18 AND usla_c IS NOT NULL AND rad_surf_type = 0 THEN alt - range_ku - model_dry_tropo_corr - rad_wet_tropo_corr - (ocean_tide_got + dac) END', 'height')}, {_r('CASE WHEN sig0_ku BETWEEN 11 AND 18 THEN sig0_ku ELSE 0e0 END', 'sig0')}, {_r('model_wet_tropo_corr', 'wet_c2')}, CAST(NULL AS DOUBLE) AS height_tx FROM obs")
def _graph(spark, sf_dir):
    """Variables that read and gate one another, aliases by satellite and with fallbacks, a quality list of measured variables and a flag."""
    cat = catalog.read_catalog(_GRAPH) + [catalog.Variable("id", expression="id")]
    o = observations(spark, sf_dir)
    of = lambda sat: catalog.select_catalog(o, cat, sat)
    got = of("j2").select("id", "height", F.col("sig0_ku").alias("sig0")).join(of("c2").select("id", F.col("wet").alias("wet_c2")), "id").join(of("tx").select("id", F.col("height").alias("height_tx")), "id")
    return got.select(F.col("id").cast("long").alias("id"), *[r6(c).alias(c) for c in ("height", "sig0", "wet_c2")], "height_tx")


@query("Q4_event_windows", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n, round(avg(value), 6) + 0.0e0 AS mean FROM events GROUP BY 1 HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR", plain=True)
def _event_windows(spark, sf_dir):
    """Arrivals by day of their own time, each day once it is closed: an hour after its end, by the latest record seen."""
    from ..streaming.incremental import windowed_quality

    path = shared_dir(spark, "windows")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "value").write.parquet(f"{path}/arrivals")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{path}/arrivals")
    found = windowed_quality(stream).select(F.col("window.start").cast("long").alias("day"), "n", "mean")
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/days").awaitTermination()
    return spark.read.schema("day long, n long, mean double").parquet(f"{path}/days").select("day", "n", r6("mean").alias("mean"))
