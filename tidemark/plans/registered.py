"""Registered queries by operator, each next to DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, physics, variables
from ..operators import design, evaluate, filters, levels, lsq, match, outliers, smooth, windows
from ..operators import grid as grids
from ..operators.grid import Axis, Grid
from ..sources import catalog, limits, missions, tables
from ..storage import shared_dir as _shared
from . import steps
from .fixture import observations, oracle, tracks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A coarse grid that the generic tables fill.
GRID = Grid(Axis(0.0, 1.0, 14), Axis(0.0, 1.5, 15))
SMALL = Grid(Axis(0.0, 2.5, 6), Axis(0.0, 3.5, 7))
CUBE = Grid(Axis(0.0, 2.5, 6), Axis(0.0, 3.5, 7), Axis(10.0, 2.5, 5))
MISSION = "j2"


def query(name: str, sql: str | None = None, *, plain: bool = False):
    """Register a query; sql reads the views obs and tracks, or with `plain` only the tables."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql if plain else oracle(sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _r(sql: str, name: str) -> str:
    return f"round({sql}, 6) + 0.0e0 AS {name}"


def bins_sql(grid: Grid) -> str:
    """CTE bins (node, value, c, error, n): means of the heights of both bands over the records nearest to a node."""
    ix, iy = (f"CAST(floor({c} / {a.step!r}::DOUBLE + 0.5e0) AS INT)" for c, a in (("swh_ku", grid.x), ("wind_speed_alt", grid.y)))
    return f"bins AS (SELECT CAST(ix + iy * {grid.x.count} AS INT) AS node, avg(usla_ku) AS value, avg(usla_c) AS c, 1 / sqrt(count(*)) AS error, count(*) AS n FROM (SELECT *, {ix} AS ix, {iy} AS iy FROM obs) WHERE ix < {grid.x.count} AND iy < {grid.y.count} GROUP BY 1)"


def bins(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """A model without a fit, whose values come from the records: (node, ix, iy, iz, x, y, z, value, c, error, n)."""
    near = lambda c, a: F.floor(F.col(c) / F.lit(a.step) + 0.5).cast("int")
    o = observations(spark, sf_dir).withColumn("ix", near("swh_ku", grid.x)).withColumn("iy", near("wind_speed_alt", grid.y)).where((F.col("ix") < grid.x.count) & (F.col("iy") < grid.y.count))
    found = o.groupBy((F.col("ix") + F.col("iy") * grid.x.count).alias("node")).agg(F.avg("usla_ku").alias("value"), F.avg("usla_c").alias("c"), (1 / F.sqrt(F.count(F.lit(1)))).alias("error"), F.count(F.lit(1)).alias("n"))
    return grids.nodes(spark, grid).join(F.broadcast(found), "node", "left")  # bounded by the grid


# --- sources ------------------------------------------------------------------------------------------------------

_LIMITS = " AND ".join(f"{c} BETWEEN {lo!r}::DOUBLE AND {hi!r}::DOUBLE" for c, (lo, hi) in {
    "swh_ku": (0, 20), "sig0_ku": (0, 40), "wind_speed_alt": (0, 30), "off_nadir_angle_wf_ku": (-0.2, 0.64), "rad_wet_tropo_corr": (-0.5, -0.001), "model_dry_tropo_corr": (-2.5, -1.9),
    "iono_corr_gim_ku": (-0.4, 0.04), "pole_tide": (-0.15, 0.15), "solid_earth_tide": (-1, 1), "ocean_tide_fes": (-5, 5), "ocean_tide_got": (-5, 5), "load_tide_fes": (-0.5, 0.5), "dac": (-2, 2),
    "inv_bar_corr": (-0.4, 0.6), "range_numval_ku": (10, 21.5), "range_rms_ku": (0, 0.25), "sig0_rms_ku": (0, 1), "swh_rms_ku": (0, 1.5), "swh_rms_c": (0, 3)}.items())


@query("S1_stack_passes", f"SELECT id, cycle, pass_number FROM obs WHERE pass_number BETWEEN 1 AND 254 AND pass_number <> 0 AND {_LIMITS} AND alt - range_ku BETWEEN -130.0e0 AND 100.0e0")
def _stack(spark, sf_dir):
    return tables.stack_passes(observations(spark, sf_dir), MISSION).select("id", "cycle", "pass_number")


@query("S3_cycle_tables", f"SELECT cycle, count(*) AS n, {_r('sum(swh_ku)', 'swh')} FROM obs WHERE cycle IN (1, 3) GROUP BY cycle")
def _cycle_tables(spark, sf_dir):
    path = _shared(spark, "cycles")
    tables.write_cycles(observations(spark, sf_dir).withColumn("mission", F.lit(MISSION)), path)
    return tables.read_cycles(spark, path, MISSION, [1, 3]).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("swh_ku")).alias("swh"))


@query("S5_model_tables", f"SELECT cycle, {_r('avg(usla_ku)', 'level')} FROM obs GROUP BY cycle")
def _model_tables(spark, sf_dir):
    o = observations(spark, sf_dir)
    path = _shared(spark, "model")
    per = o.groupBy("cycle").agg(r6(F.avg("usla_ku")).alias("level"))
    tables.write_model(grids.nodes(spark, SMALL), per, spark.createDataFrame([(0.0,)], "model_bias double"), path)
    return tables.read_model(spark, path)["model_cycle"].select("cycle", "level")


def _as_track(o: DataFrame) -> DataFrame:
    back = {v: k for k, v in tables.TRACK_NAMES.items()} | {"lon": "lon"}
    keep = ["id", "lat", "lon", "swh_ku", "swh_rms_ku", "sig0_ku", "sig0_rms_ku", "range_ku", "range_c", "range_rms_ku", "wind_speed_alt", "rad_wet_tropo_corr", "model_dry_tropo_corr", "iono_corr_gim_ku", "pole_tide", "solid_earth_tide", "bathymetry", "off_nadir_angle_wf_ku"]
    out = o.select(*[F.col(c).alias(back.get(c, c)) for c in keep], (F.col("rad_distance_to_land") / 1000).alias("rad_dist_coast"))
    return out.withColumn("lon", F.col("lon") - 180).withColumn("surface_class", F.pmod("id", F.lit(7)).cast("int")).withColumn("file", F.pmod("id", F.lit(997)))


_TRACK_LIMITS = "lat BETWEEN -90.0e0 AND 90.0e0 AND lon - 180 BETWEEN -180.0e0 AND 180.0e0 AND swh_ku BETWEEN 0.0e0 AND 20.0e0 AND swh_rms_ku BETWEEN 0.0e0 AND 2.0e0 AND sig0_ku BETWEEN 0.0e0 AND 40.0e0 AND sig0_rms_ku BETWEEN 0.0e0 AND 1.5e0 AND range_ku BETWEEN 1300000.0e0 AND 1400000.0e0 AND range_c BETWEEN 1300000.0e0 AND 1400000.0e0 AND range_rms_ku BETWEEN 0.0e0 AND 0.25e0 AND wind_speed_alt BETWEEN -1.0e0 AND 30.0e0 AND rad_wet_tropo_corr BETWEEN -0.6e0 AND 0.0e0 AND model_dry_tropo_corr BETWEEN -2.5e0 AND -1.9e0 AND iono_corr_gim_ku BETWEEN -0.4e0 AND 0.04e0 AND pole_tide BETWEEN -0.15e0 AND 0.15e0 AND solid_earth_tide BETWEEN -1.0e0 AND 1.0e0 AND bathymetry BETWEEN -200000.0e0 AND -300.0e0 AND off_nadir_angle_wf_ku BETWEEN -0.2e0 AND 0.64e0"


@query("S9_pull_tracks", f"WITH big AS (SELECT id % 997 AS file FROM obs GROUP BY 1 HAVING count(*) >= 3) SELECT id, {_r('CASE WHEN off_nadir_angle_wf_ku >= 0 THEN sqrt(off_nadir_angle_wf_ku) END', 'off_nadir')}, {_r('rad_distance_to_land', 'land')} FROM obs WHERE {_TRACK_LIMITS} AND id % 7 = 0 AND id % 997 IN (SELECT file FROM big)")
def _pull_tracks(spark, sf_dir):
    t = tables.pull_tracks(_as_track(observations(spark, sf_dir)), MISSION)
    return t.select("id", r6("off_nadir_angle_wf_ku").alias("off_nadir"), r6("rad_distance_to_land").alias("land"))


@query("S10_ka_tracks", f"SELECT id, {_r('swh_ku', 'swh_ku')}, {_r('swh_ku', 'swh_c')}, {_r('range_ku', 'range_ku')} FROM obs WHERE swh_ku BETWEEN -1.0e0 AND 20.0e0 AND usla_ku * 10 BETWEEN -2.0e0 AND 2.0e0 AND abs(rad_distance_to_land / 10000.0e0) <= 50.0e0")
def _ka(spark, sf_dir):
    o = observations(spark, sf_dir).select("id", F.col("swh_ku").alias("swh_ka"), F.col("range_ku").alias("range_ka"), (F.col("usla_ku") * 10).alias("ssha_ka"), (F.col("rad_distance_to_land") / 10000).alias("dist_coast"))
    return tables.pull_ka_tracks(o).select("id", r6("swh_ku").alias("swh_ku"), r6("swh_c").alias("swh_c"), r6("range_ku").alias("range_ku"))


@query("S14_rpn_catalog", f"SELECT id, {_r('alt - range_ku', 'above')}, {_r('CASE WHEN usla_ku BETWEEN -0.1e0 AND 0.1e0 THEN usla_ku ELSE 0.0e0 END', 'usla')}, {_r('CASE WHEN off_nadir_angle_wf_ku >= 0 THEN sqrt(off_nadir_angle_wf_ku) END', 'angle')}, {_r('swh_ku * 2.0e0 + 1.0e0', 'scaled')}, {_r('dac', 'tide')} FROM obs")
def _rpn(spark, sf_dir):
    cat = [
        catalog.Variable("above", "alt range_ku SUB"),
        catalog.Variable("usla", "usla_ku", limits=(-0.1, 0.1), default=0.0),
        catalog.Variable("angle", "off_nadir_angle_wf_ku SQRT"),
        catalog.Variable("scaled", "swh_ku", by_satellite={"!c2 g1": "swh_ku 2 MUL 1 ADD"}),
        catalog.Variable("tide", aliases=("tide_none", "dac", "pole_tide")),
    ]
    o = observations(spark, sf_dir)
    return o.select("id", *[r6(v.column(o.columns, "j2")).alias(v.name) for v in cat])


@query("S15_orbit_join", f"SELECT id, {_r('alt + 0.5e0', 'alt_new')} FROM obs")
def _orbit(spark, sf_dir):
    o = observations(spark, sf_dir)
    path = _shared(spark, "orbit")
    o.select(F.format_string("%d 0 0 %.3f 0 0 0 0 0 0", F.col("id"), F.col("alt") + 0.5)).write.text(path)
    return tables.attach_orbit(o.withColumnRenamed("id", "idx"), tables.read_orbit(spark, path)).select(F.col("idx").cast("long").alias("id"), r6("alt_new").alias("alt_new"))


@query("S23_new_cycles", "SELECT DISTINCT cycle FROM obs WHERE cycle <> 2 UNION ALL SELECT 9")
def _new_cycles(spark, sf_dir):
    produced = spark.createDataFrame([(2,), (9,)], "cycle int")
    return tables.new_cycles(observations(spark, sf_dir), produced)


@query("S24_tandem_cycles", "WITH phases AS (SELECT 'txj1' AS phase, c AS cycle_a, c - 343 AS cycle_b FROM (SELECT unnest(range(344, 365))::INT AS c) WHERE c <> 361 UNION ALL SELECT 'j1j2', c, c - 239 FROM (SELECT unnest(range(240, 260))::INT AS c) WHERE c <> 243 UNION ALL SELECT 'j2j3', c, c - 280 FROM (SELECT unnest(range(281, 304))::INT AS c) UNION ALL SELECT 'j3s6A', c, c - 175 FROM (SELECT unnest(range(180, 228))::INT AS c)) SELECT phase, cycle_a, cycle_b, count(o.id) AS n FROM phases LEFT JOIN (SELECT id, CAST(180 + id % 190 AS INT) AS cycle FROM obs) o ON o.cycle = cycle_a GROUP BY ALL")
def _tandem_cycles(spark, sf_dir):
    """Records of the first mission in each pair of cycles of a tandem phase."""
    o = observations(spark, sf_dir).select((180 + F.pmod("id", F.lit(190))).cast("int").alias("cycle")).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    t = missions.tandem_table(spark)
    return t.join(o, t.cycle_a == o.cycle, "left").select("phase", "cycle_a", "cycle_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# --- projections --------------------------------------------------------------------------------------------------


_USLA_K = repr(physics.KU_TO_C) + "::DOUBLE"


@query("P5_usla", f"SELECT id, {_r('ssha + sea_state_bias_ku + iono_corr_alt_ku - iono_corr_gim_ku', 'ku')}, {_r(f'ssha + sea_state_bias_ku + iono_corr_alt_ku + range_ku - range_c - {_USLA_K} * iono_corr_gim_ku', 'c')} FROM (SELECT *, usla_ku - 0.0123456789e0 * swh_ku AS ssha FROM obs)")
def _usla(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("ssha", F.col("usla_ku") - 0.0123456789 * F.col("swh_ku"))
    iono = physics.iono_for_usla(F.col("iono_corr_gim_ku"), F.col("iono_corr_alt_ku"), MISSION, F.col("cycle"))
    ku, c = physics.uncorrected_heights(F.col("ssha"), F.col("sea_state_bias_ku"), F.col("iono_corr_alt_ku"), F.col("range_ku"), F.col("range_c"), iono, MISSION)
    return o.select("id", r6(ku).alias("ku"), r6(c).alias("c"))


_SSHA = "alt - range_ku - model_dry_tropo_corr - rad_wet_tropo_corr - iono_corr_alt_ku - dac - solid_earth_tide - ocean_tide_fes - load_tide_fes - pole_tide - sea_state_bias_ku - mean_sea_surface"


@query("P6_ssha", f"SELECT id, {_r(_SSHA, 'ssha')} FROM obs")
def _ssha(spark, sf_dir):
    return observations(spark, sf_dir).select("id", r6(tables.height_anomaly(F.col)).alias("ssha"))


_BM3 = "swh_ku * (0.0036e0 - 0.0045e0 * wind_speed_alt + 0.00019e0 * wind_speed_alt * wind_speed_alt)"
_VARS = {
    "usla": "usla_c", "bm3": _BM3, "ib_corr": "usla_c + hf_fluctuations_corr", "wet_tropo_model": "usla_c + rad_wet_tropo_corr - model_wet_tropo_corr",
    "iono_tran": f"usla_c + {_USLA_K} * (iono_corr_gim_ku - iono_corr_alt_ku)", "ocean_fes": "usla_c + ocean_tide_got - ocean_tide_fes", "mss_dtu": "usla_c + mean_sea_surface - mean_sea_surface_dtu",
    "mss": "mean_sea_surface", "ssb": "sea_state_bias_c", "iono": "iono_corr_alt_ku", "gim": "iono_corr_gim_ku", "SO": "CASE WHEN lat <= -40 THEN usla_c END", "hemi_south": "CASE WHEN lat <= 0 THEN usla_c END",
    "hemi_north": "CASE WHEN lat >= 0 THEN usla_c END", "ORMBin_tdm": "alt - range_ku - mean_sea_surface - sea_state_bias_ku", "ORM_tdm": "alt - range_ku - mean_sea_surface", "ORBin_tdm": "alt - range_ku - sea_state_bias_ku",
    "SLAin_tdm": "alt - range_ku - model_dry_tropo_corr - rad_wet_tropo_corr - solid_earth_tide - ocean_tide_fes - pole_tide - inv_bar_corr - hf_fluctuations_corr - sea_state_bias_ku - iono_corr_alt_ku - mean_sea_surface",
    "USLAin_tdm": "alt - range_ku - model_dry_tropo_corr - rad_wet_tropo_corr - solid_earth_tide - ocean_tide_fes - pole_tide - inv_bar_corr - hf_fluctuations_corr - iono_corr_alt_ku - mean_sea_surface",
}


@query("P7_dependent_variables", "SELECT id, " + ", ".join(_r(e, f"v_{n.lower()}") for n, e in _VARS.items()) + " FROM obs")
def _dependent(spark, sf_dir):
    return observations(spark, sf_dir).select("id", *[r6(variables.dependent(n, "c", MISSION)).alias(f"v_{n.lower()}") for n in _VARS])


def _wind_sql(sig0: str, bias: str = "0.32e0", swh: str = "swh_ku") -> str:
    p1, p2 = f"(0.0806452e0 * ({sig0} + {bias}) - 0.6322581e0)", f"(0.0683395e0 * {swh} + 0.0991799e0)"
    x1 = f"(1.0e0 / (1.0e0 + exp(-(58.76821e0 * {p1} + 22.08226e0 * {p2} - 33.61161e0))))"
    x2 = f"(1.0e0 / (1.0e0 + exp(-(3.05118e0 * {p1} + 0.18608e0 * {p2} + 1.06796e0))))"
    return f"((1.0e0 / (1.0e0 + exp(-(-0.20367e0 * {x1} - 22.35999e0 * {x2} + 20.10259e0))) - 0.0869731e0) / 0.0321528e0)"


def _noise_sql(rms: str, seed: int) -> str:
    m = 2147483647
    u = [f"((((id + {seed * 7919 + k}) % {m}) * {a}) % {m} + 0.5e0) / {m}e0" for k, a in ((1, 742938285), (2, 950706376))]
    return f"(CASE WHEN {rms} > 0 THEN {rms} * (sqrt(-2.0e0 * ln({u[0]})) * cos(6.283185307179586e0 * ({u[1]}))) ELSE 0.0e0 END)"


@query("P8_independent_variables", f"SELECT id, {_r('swh_ku', 'x0')}, {_r('wind_speed_alt', 'y0')}, {_r('swh_ku + ' + _noise_sql('swh_rms_ku', 3), 'x1')}, {_r(_wind_sql('(sig0_ku + ' + _noise_sql('sig0_rms_ku', 5) + ')'), 'y2')}, {_r('sig0_ku', 'y3')} FROM obs")
def _independent(spark, sf_dir):
    o = observations(spark, sf_dir)
    plain, wave, back, sig = variables.independent(MISSION), variables.independent(MISSION, err="rms_w"), variables.independent(MISSION, err="rms_s"), variables.independent(MISSION, second="sig0")
    return o.select("id", r6(plain[0]).alias("x0"), r6(plain[1]).alias("y0"), r6(wave[0]).alias("x1"), r6(back[1]).alias("y2"), r6(sig[1]).alias("y3"))


_ENV_SQL = {
    "swh_rms_ku": ("CASE WHEN swh_ku <= 2 THEN 0.75064e0 - 0.23178e0 * swh_ku + 1.06577e0 * pow(swh_ku, 2) - 0.87798e0 * pow(swh_ku, 3) + 0.205e0 * pow(swh_ku, 4) ELSE 0.79364e0 - 0.03835e0 * swh_ku + 0.01915e0 * pow(swh_ku, 2) - 0.00094e0 * pow(swh_ku, 3) END"),
    "sig0_rms_ku": ("CASE WHEN swh_ku <= 2 THEN 0.81588e0 - 0.07736e0 * swh_ku - 0.03154e0 * pow(swh_ku, 2) + 0.01029e0 * pow(swh_ku, 3) ELSE 0.59713e0 + 0.00701e0 * swh_ku - 0.00043e0 * pow(swh_ku, 2) END"),
    "range_rms_ku": ("CASE WHEN swh_ku <= 2 THEN 0.10381e0 - 0.01169e0 * swh_ku + 0.01916e0 * pow(swh_ku, 2) - 0.00464e0 * pow(swh_ku, 3) ELSE 0.07817e0 + 0.02154e0 * swh_ku - 0.00039e0 * pow(swh_ku, 2) END"),
    "swh_rms_c": ("CASE WHEN swh_c <= 2 THEN 2.26537e0 + 0.08134e0 * swh_c - 0.25133e0 * pow(swh_c, 2) + 0.09481e0 * pow(swh_c, 3) ELSE 1.92622e0 + 0.09019e0 * swh_c + 0.01353e0 * pow(swh_c, 2) - 0.00094e0 * pow(swh_c, 3) END"),
}
_LEVEL2 = "rad_distance_to_land >= 50000.0e0 AND rad_distance_to_land < 6000000.0e0 AND bathymetry BETWEEN -400000.0e0 AND -300.0e0 AND usla_ku > -1.5e0 AND usla_ku < 1.5e0 AND swh_ku > 0 AND swh_ku < 12.5e0 AND swh_c > 0 AND swh_c < 12.5e0 AND rad_surf_type = 0 AND rad_wet_tropo_corr - model_wet_tropo_corr > -0.075e0 AND rad_wet_tropo_corr - model_wet_tropo_corr < 0.065e0 AND " + " AND ".join(f"{e} - {v} >= 0" + (f" AND {v} >= 0.05e0" if "swh" in v else "") for v, e in _ENV_SQL.items())


@query("P9_observables", f"SELECT id, {_r('usla_ku', 'z')} FROM obs WHERE abs(lat) < 66.16::DOUBLE AND {_LEVEL2}")
def _observables(spark, sf_dir):
    o = observations(spark, sf_dir)
    return filters.level1(o, MISSION).where(filters.level2(o.columns, MISSION)).select("id", r6(variables.dependent("usla", "ku", MISSION)).alias("z"))


@query("P10_dual_frequency_iono", f"SELECT id, {_r('(5300000000.0e0::DOUBLE * 5300000000.0e0) / (13575000000.0e0::DOUBLE * 13575000000.0e0 - 5300000000.0e0::DOUBLE * 5300000000.0e0) * ((range_ku + sea_state_bias_ku) - (range_c + sea_state_bias_c) + 0.01e0)', 'ku')}, {_r('(13575000000.0e0::DOUBLE * 13575000000.0e0) / (13575000000.0e0::DOUBLE * 13575000000.0e0 - 5300000000.0e0::DOUBLE * 5300000000.0e0) * ((range_ku + sea_state_bias_ku) - (range_c + sea_state_bias_c))', 'c')} FROM obs")
def _dual(spark, sf_dir):
    args = [F.col(c) for c in ("range_ku", "range_c", "sea_state_bias_ku", "sea_state_bias_c")]
    return observations(spark, sf_dir).select("id", r6(physics.dual_frequency_iono(*args, offset=0.01)).alias("ku"), r6(physics.dual_frequency_iono(*args, band="c")).alias("c"))


# --- filters ------------------------------------------------------------------------------------------------------


@query("F2_level0", f"SELECT id FROM obs WHERE {_LIMITS} AND alt - range_ku BETWEEN -130.0e0 AND 100.0e0 AND rad_surf_type = 0")
def _level0(spark, sf_dir):
    return filters.level0(observations(spark, sf_dir), MISSION, quality={"rad_surf_type": 0}).select("id")


@query("F5_level2", f"SELECT id FROM obs WHERE {_LEVEL2}")
def _level2(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.where(filters.level2(o.columns, MISSION)).select("id")


def _envelope_sql(form: dict) -> str:
    def poly(c):
        if form["exponential"]:
            return f"{c[0]!r}::DOUBLE + {c[1]!r}::DOUBLE * exp(-swh_ku / {c[2]!r}::DOUBLE)"
        return " + ".join(f"{x!r}::DOUBLE * pow(swh_ku, {k})" for k, x in enumerate(c))

    return f"CASE WHEN swh_ku <= {form['limit']!r}::DOUBLE THEN {poly(form['low'])} ELSE {poly(form['high'])} END" if form["high"] else poly(form["low"])


_ENVELOPES = [(m, v) for m in sorted(limits.ENVELOPES) for v in sorted(limits.ENVELOPES[m])]


@query("F6_envelopes", " UNION ALL ".join(f"SELECT '{m}' AS mission, '{v}' AS variable, {_r(f'sum({_envelope_sql(limits.ENVELOPES[m][v])}) / count(*)', 'mean')}, count(*) FILTER (WHERE {_envelope_sql(limits.ENVELOPES[m][v])} >= swh_rms_ku) AS kept FROM obs" for m, v in _ENVELOPES))
def _envelopes(spark, sf_dir):
    o = observations(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(m).alias("mission"), F.lit(v).alias("variable"), filters.envelope(F.col("swh_ku"), limits.ENVELOPES[m][v]).alias("e")) for m, v in _ENVELOPES])
    rows = o.select("swh_rms_ku", F.explode(each).alias("x")).select("swh_rms_ku", "x.*")
    return rows.groupBy("mission", "variable").agg(r6(F.sum("e") / F.count(F.lit(1))).alias("mean"), F.count(F.when(F.col("e") >= F.col("swh_rms_ku"), 1)).alias("kept"))


_OFF = f"{_envelope_sql(limits.ENVELOPES['j2']['off_nadir_angle_wf_ku'])} >= off_nadir_angle_wf_ku AND {_envelope_sql(limits.LOWER['j2'])} <= off_nadir_angle_wf_ku"


@query("F6_off_nadir", f"SELECT id FROM obs WHERE {_OFF}")
def _off_nadir(spark, sf_dir):
    return observations(spark, sf_dir).where(filters.within_envelope(F.col("off_nadir_angle_wf_ku"), F.col("swh_ku"), "off_nadir_angle_wf_ku", MISSION)).select("id")


@query("F9_derive_envelope", f"WITH g AS (SELECT CAST(floor(swh_ku / 0.25e0 + 0.5e0) AS INT) AS bin, count(*) AS n, avg(swh_rms_ku) AS m, stddev_pop(swh_rms_ku) AS s FROM obs GROUP BY 1) SELECT bin, {_r('m', 'mean')}, {_r('s', 'sd')}, {_r('m + 3.0e0 * s', 'envelope')} FROM g WHERE n > 50")
def _derive(spark, sf_dir):
    e = levels.binned_envelope(observations(spark, sf_dir), F.col("swh_rms_ku"), F.col("swh_ku"))
    return e.select("bin", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("envelope").alias("envelope"))


@query("F10_track_limits", f"SELECT id FROM obs WHERE {_TRACK_LIMITS}")
def _track_limits(spark, sf_dir):
    t = _as_track(observations(spark, sf_dir))
    return t.where(filters.within(filters.track_limits(MISSION), t.columns)).select("id")


@query("F12_kept_nodes", "WITH w AS (SELECT id, CAST(ceil(swh_ku) AS INT) - 1 AS ix, CAST(ceil(wind_speed_alt / 1.5e0) AS INT) - 1 AS iy FROM obs), n AS (SELECT id, unnest([ix + iy * 14, ix + 1 + iy * 14, ix + (iy + 1) * 14, ix + 1 + (iy + 1) * 14]) AS node, unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS w FROM (SELECT w.*, o.swh_ku - ix AS fx, o.wind_speed_alt / 1.5e0 - iy AS fy FROM w JOIN obs o ON o.id = w.id) WHERE ix BETWEEN 0 AND 12 AND iy BETWEEN 0 AND 13) SELECT node, count(*) AS n FROM n WHERE w <> 0 GROUP BY node HAVING count(*) >= 150")
def _kept_nodes(spark, sf_dir):
    return lsq.kept_nodes(_direct(spark, sf_dir), 150)


def _direct(spark: SparkSession, sf_dir: str, grid: Grid = GRID, z: str = "usla_ku") -> DataFrame:
    o = observations(spark, sf_dir).withColumn("x", F.col("swh_ku")).withColumn("y", F.col("wind_speed_alt")).withColumn("z", F.col(z))
    return o.withColumn("nodes", design.weights(grid, F.col("x"), F.col("y"))).where(F.col("nodes").isNotNull())


#: DuckDB: weights (id, cycle, lat, lon, z, node, w) of the direct design on the coarse grid.
_W = """w0 AS (SELECT *, CAST(ceil(swh_ku) AS INT) - 1 AS ix, CAST(ceil(wind_speed_alt / 1.5e0) AS INT) - 1 AS iy FROM obs),
w1 AS (SELECT *, swh_ku - ix AS fx, wind_speed_alt / 1.5e0 - iy AS fy FROM w0 WHERE ix BETWEEN 0 AND 12 AND iy BETWEEN 0 AND 13),
w AS (SELECT * FROM (SELECT id, cycle, lat, lon, swh_ku, wind_speed_alt, usla_ku AS z, unnest([ix + iy * 14, ix + 1 + iy * 14, ix + (iy + 1) * 14, ix + 1 + (iy + 1) * 14]) AS node,
  unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS w FROM w1) WHERE w <> 0)"""


@query("F13_rows_on_kept_nodes", f"WITH {_W}, k AS (SELECT node FROM w GROUP BY node HAVING count(*) >= 220) SELECT DISTINCT id FROM w WHERE node IN (SELECT node FROM k)")
def _touching(spark, sf_dir):
    rows = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0))
    ids = [r["node"] for r in lsq.kept_nodes(rows, 220).collect()]
    return lsq.touching(rows, ids).select("id")


def _consistent_sql(least: int, rounds: int) -> str:
    ctes = [_W, f"k0 AS (SELECT node FROM w GROUP BY node HAVING count(*) >= {least})", "r0 AS (SELECT * FROM w WHERE id NOT IN (SELECT id FROM w WHERE node NOT IN (SELECT node FROM k0)))"]
    for i in range(1, rounds):
        ctes += [f"k{i} AS (SELECT node FROM r{i - 1} GROUP BY node HAVING count(*) >= {least})", f"r{i} AS (SELECT * FROM r{i - 1} WHERE id NOT IN (SELECT id FROM r{i - 1} WHERE node NOT IN (SELECT node FROM k{i})))"]
    return f"WITH {', '.join(ctes)} SELECT node, count(*) AS n FROM r{rounds - 1} GROUP BY node"


@query("F14_consistent_nodes", _consistent_sql(20, 12))
def _consistent(spark, sf_dir):
    rows = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0))
    rows, _ = lsq.consistent(rows, 20)
    return lsq.node_counts(rows)


def _by_cycle_sql(least: int, rounds: int) -> str:
    """CTEs up to r{rounds}: the weights of rows that are consistent in their cycle, whose minimum is least / cycles."""
    ctes = [_W, f"lim AS (SELECT {least}::DOUBLE / count(DISTINCT cycle) AS n FROM w)", "r0 AS (SELECT * FROM w)"]
    for i in range(1, rounds + 1):
        ctes += [f"t{i} AS (SELECT cycle, node FROM r{i - 1} GROUP BY 1, 2 HAVING count(*) < (SELECT n FROM lim))", f"r{i} AS (SELECT * FROM r{i - 1} WHERE id NOT IN (SELECT a.id FROM r{i - 1} a JOIN t{i} t ON t.cycle = a.cycle AND t.node = a.node))"]
    return f"WITH {', '.join(ctes)}"


@query("F14_consistent_by_cycle", f"{_by_cycle_sql(30, 12)} SELECT cycle, node, count(*) AS n FROM r12 GROUP BY 1, 2")
def _consistent_by_cycle(spark, sf_dir):
    rows = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0))
    cycles = rows.select("cycle").distinct().count()
    return lsq.node_counts(lsq.consistent_by(rows, 30 / max(cycles, 1), "cycle"), "cycle")


@query("A11_consistent_bins", f"{_by_cycle_sql(30, 12)}, c AS (SELECT cycle, node, count(*) AS n FROM r12 GROUP BY 1, 2) SELECT node, sum(n)::BIGINT AS n, count(*) AS cycles FROM c GROUP BY 1 HAVING sum(n) >= 30")
def _consistent_bins(spark, sf_dir):
    return lsq.cycle_bins(_direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0)), 30)


@query("F15_regions", f"SELECT id, {_r('CASE WHEN lat <= -40 THEN usla_ku END', 'so')}, {_r('CASE WHEN lat <= 0 THEN usla_ku END', 'south')}, {_r('CASE WHEN lat >= 0 THEN usla_ku END', 'north')} FROM obs")
def _regions(spark, sf_dir):
    f = lambda n: r6(filters.region(F.col("usla_ku"), F.col("lat"), n))
    return observations(spark, sf_dir).select("id", f("SO").alias("so"), f("hemi_south").alias("south"), f("hemi_north").alias("north"))


@query("F16_aligned", f"SELECT id, {_r('CASE WHEN abs(time - floor(time / 600) * 600) <= 90 THEN usla_ku END', 'z')} FROM obs")
def _aligned(spark, sf_dir):
    return observations(spark, sf_dir).select("id", r6(filters.aligned(F.col("usla_ku"), F.col("time"), F.floor(F.col("time") / 600) * 600)).alias("z"))


# --- joins --------------------------------------------------------------------------------------------------------


def _ecef_sql(lat: str, lon: str, s: str) -> str:
    n = f"(6378137.0e0 / sqrt(1.0e0 - 0.00669437999014e0 * sin(radians({lat})) * sin(radians({lat}))))"
    return f"{n} * cos(radians({lat})) * cos(radians({lon})) AS x{s}, {n} * cos(radians({lat})) * sin(radians({lon})) AS y{s}, {n} * {repr(1 - geodesy.ECCENTRICITY_SQUARED)}::DOUBLE * sin(radians({lat})) AS z{s}"


_POINTS = f"p AS (SELECT id, cycle, pass_number, time, lat, lon, swh_ku, {_ecef_sql('lat', 'lon', '')} FROM obs)"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("id", "cycle", "pass_number", "time", "lat", "lon", "swh_ku", "wind_speed_alt", "usla_ku")


@query("J1_radius_join", f"WITH {_POINTS} SELECT a.id AS a, b.id AS b, {_r(_DIST + ' / 1000', 'km')} FROM p a JOIN p b ON {_DIST} <= 100000 WHERE a.pass_number % 2 = 1 AND b.pass_number % 2 = 0")
def _radius(spark, sf_dir):
    p = _points(spark, sf_dir)
    pairs = match.radius_join(p.where(match.ascending(p)), p.where(~match.ascending(p)), 100000.0)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), r6(F.col("dist") / 1000).alias("km"))


@query("J2_nearest_match", f"WITH {_POINTS}, d AS (SELECT a.id AS a, b.id AS b, {_DIST} AS dist FROM p a JOIN p b ON {_DIST} <= 200000 WHERE a.pass_number % 2 = 1 AND b.pass_number % 2 = 0) SELECT a, b, {_r('dist / 1000', 'km')} FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM d) WHERE k = 1")
def _nearest(spark, sf_dir):
    p = _points(spark, sf_dir)
    pairs = match.nearest_within(p.where(match.ascending(p)), p.where(~match.ascending(p)), 200000.0)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), r6(F.col("dist") / 1000).alias("km"))


def _one_to_one_sql(radius: int, by: str) -> str:
    """CTEs n (nearest) and m (matches) from d (a, b, dist, by...), each group with its own radius."""
    on = " AND ".join(f"shared.{c} = n.{c}" for c in by.split(", "))
    return f"""n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM d) WHERE k = 1),
shared AS (SELECT {by}, min(dist) AS least FROM (SELECT {by}, dist, row_number() OVER (PARTITION BY {by}, b ORDER BY dist, a) AS k FROM n) WHERE k = 2 GROUP BY {by}),
r AS (SELECT {by}, max({radius} - 100 * i) AS r FROM (SELECT unnest(range(0, {radius // 100 + 1})) AS i), shared WHERE {radius} - 100 * i < least GROUP BY {by}),
m AS (SELECT n.* FROM n LEFT JOIN shared ON {on} LEFT JOIN r ON {on.replace("shared.", "r.")} WHERE shared.least IS NULL OR dist <= r.r)"""


_COLLINEAR = f"""WITH {_POINTS},
d AS (SELECT a.id AS a, b.id AS b, a.cycle, a.pass_number % 2 AS up, a.swh_ku - b.swh_ku AS dx, {_DIST} AS dist FROM p a JOIN p b ON b.cycle = a.cycle + 1 AND a.pass_number % 2 = b.pass_number % 2 AND {_DIST} <= 90000),
{_one_to_one_sql(90000, "cycle, up")}"""


@query("J10_collinear", f"{_COLLINEAR} SELECT a, b, {_r('dx', 'dx')} FROM m")
def _collinear(spark, sf_dir):
    pairs = match.collinear(_points(spark, sf_dir), 90000.0)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), r6(F.col("swh_ku_a") - F.col("swh_ku_b")).alias("dx"))


_TANDEM = f"""WITH {_POINTS},
d AS (SELECT a.id AS a, b.id AS b, a.cycle, a.pass_number, a.swh_ku AS s, b.swh_ku AS s2, {_DIST} AS dist FROM p a JOIN p b ON b.cycle = a.cycle + 1 AND a.pass_number = b.pass_number AND {_DIST} <= 300000),
{_one_to_one_sql(300000, "cycle, pass_number")}"""


@query("J12_tandem_match", f"{_TANDEM} SELECT a AS id, b AS id_j3, {_r('s', 'swh_ku')}, {_r('s2', 'swh_ku_j3')} FROM m")
def _tandem(spark, sf_dir):
    p = _points(spark, sf_dir)
    t = match.tandem_table(match.tandem(p, p, [(c, c + 1) for c in range(1, 10)], 300000.0), "j3")
    return t.select("id", "id_j3", r6("swh_ku").alias("swh_ku"), r6("swh_ku_j3").alias("swh_ku_j3"))


def _chord_sql(a: tuple[str, str], b: tuple[str, str]) -> str:
    e = []
    for lon, lat in (a, b):
        n = f"(6378137.0e0 / sqrt(1.0e0 - 0.00669437999014e0 * sin(radians({lat})) * sin(radians({lat}))))"
        e.append((f"{n} * cos(radians({lat})) * cos(radians({lon}))", f"{n} * cos(radians({lat})) * sin(radians({lon}))", f"{n} * {repr(1 - geodesy.ECCENTRICITY_SQUARED)}::DOUBLE * sin(radians({lat}))"))
    return "sqrt(" + " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(*e, strict=True)) + ")"


def _weights_sql(s: str) -> str:
    """Weights of both ends of a segment at (lon, lat), by chords."""
    whole = f"nullif({_chord_sql((f'{s}x0', f'{s}y0'), (f'{s}x1', f'{s}y1'))}, 0)"
    return f"{_chord_sql(('lon', 'lat'), (f'{s}x1', f'{s}y1'))} / {whole} AS p{s}0, {_chord_sql((f'{s}x0', f'{s}y0'), ('lon', 'lat'))} / {whole} AS p{s}1"


#: DuckDB: crossings (a0, a1, d0, d1, weights, lat, lon, times, days) of the view tracks.
_CROSS = f"""WITH t AS (SELECT id, cycle, pass_number, time, lat, ((lon + 180) - floor((lon + 180) / 360) * 360) - 180 AS lon FROM tracks),
q AS (SELECT *, {_ecef_sql('lat', 'lon', '')} FROM t),
up AS (SELECT *, lag(id) OVER s AS pid, lag(time) OVER s AS ptime, lag(lat) OVER s AS plat, lag(lon) OVER s AS plon, lead(id) OVER s AS nid, lead(time) OVER s AS ntime, lead(lat) OVER s AS nlat, lead(lon) OVER s AS nlon
  FROM q WHERE pass_number % 2 = 1 WINDOW s AS (PARTITION BY cycle, pass_number ORDER BY time, id)),
c AS (SELECT a.*, b.id AS did, b.cycle AS dcycle, b.time AS dtime, b.lat AS dlat, b.lon AS dlon, {_DIST} AS dist, floor(b.time / 86400e0) AS day FROM up a JOIN (SELECT * FROM q WHERE pass_number % 2 = 0) b ON abs(b.cycle - a.cycle) <= 1 AND {_DIST} <= 400000),
g AS (SELECT id, dcycle, day, count(*) AS found FROM c GROUP BY id, dcycle, day, lat HAVING count(*) >= 2 AND min(dlat) < lat AND max(dlat) >= lat),
k AS (SELECT c.*, g.found, row_number() OVER (PARTITION BY c.id, c.dcycle, c.day ORDER BY dist, did) AS place FROM c JOIN g ON c.id = g.id AND c.dcycle = g.dcycle AND c.day = g.day),
d2 AS (SELECT u.*, v.did AS eid, v.dtime AS etime, v.dlat AS elat, v.dlon AS elon FROM k u JOIN k v ON u.id = v.id AND u.dcycle = v.dcycle AND u.day = v.day AND u.place = 1 AND v.place = 2),
s AS (SELECT *, 0 AS after, pid AS sid, ptime AS stime, plat AS slat, plon AS slon FROM d2 WHERE pid IS NOT NULL UNION ALL SELECT *, 1, nid, ntime, nlat, nlon FROM d2 WHERE nid IS NOT NULL),
o AS (SELECT id, did, eid, after, CASE WHEN found > 2 THEN dtime ELSE least(dtime, etime) END AS nearest, least({_chord_sql(('slon', 'slat'), ('dlon', 'dlat'))}, {_chord_sql(('slon', 'slat'), ('elon', 'elat'))}) AS reach,
  CASE WHEN after = 0 THEN sid ELSE id END AS a0, CASE WHEN after = 0 THEN slon ELSE lon END AS ax0, CASE WHEN after = 0 THEN slat ELSE lat END AS ay0, CASE WHEN after = 0 THEN stime ELSE time END AS at0,
  CASE WHEN after = 0 THEN id ELSE sid END AS a1, CASE WHEN after = 0 THEN lon ELSE slon END AS ax1, CASE WHEN after = 0 THEN lat ELSE slat END AS ay1, CASE WHEN after = 0 THEN time ELSE stime END AS at1,
  CASE WHEN dtime <= etime THEN did ELSE eid END AS d0, CASE WHEN dtime <= etime THEN dlon ELSE elon END AS dx0, CASE WHEN dtime <= etime THEN dlat ELSE elat END AS dy0, least(dtime, etime) AS dt0,
  CASE WHEN dtime <= etime THEN eid ELSE did END AS d1, CASE WHEN dtime <= etime THEN elon ELSE dlon END AS dx1, CASE WHEN dtime <= etime THEN elat ELSE dlat END AS dy1, greatest(dtime, etime) AS dt1 FROM s),
l AS (SELECT *, (ay1 - ay0) / nullif(ax1 - ax0, 0) AS ma, (dy1 - dy0) / nullif(dx1 - dx0, 0) AS md FROM o),
x AS (SELECT *, ((dy0 - md * dx0) - (ay0 - ma * ax0)) / nullif(ma - md, 0) AS lon FROM l),
y AS (SELECT *, ay0 + ma * (lon - ax0) AS lat FROM x),
w AS (SELECT *, {_weights_sql('a')}, {_weights_sql('d')} FROM y),
z AS (SELECT *, row_number() OVER (PARTITION BY id, did, eid ORDER BY reach, after) AS side, abs(at0 - nearest) / 86400e0 AS days FROM w WHERE round(pa0 + pa1, 2) = 1 AND round(pd0 + pd1, 2) = 1),
crossings AS (SELECT a0, a1, d0, d1, any_value(pa0) AS pa0, any_value(pa1) AS pa1, any_value(pd0) AS pd0, any_value(pd1) AS pd1, any_value(lat) AS lat, any_value(lon) AS lon, any_value(at0 * pa0 + at1 * pa1) AS time_a, any_value(dt0 * pd0 + dt1 * pd1) AS time_d, min(days) AS days
  FROM z WHERE side = 1 AND reach <= 400000 AND days > 0 AND days < 3 GROUP BY a0, a1, d0, d1)"""


@query("J3_crossovers", f"{_CROSS} SELECT a0, a1, d0, d1, {_r('lat', 'lat')}, {_r('lon', 'lon')}, {_r('days', 'days')}, {_r('(time_a - time_d) / 86400e0', 'apart')} FROM crossings")
def _crossovers(spark, sf_dir):
    x = match.crossovers(tracks(spark, sf_dir), radius=400000.0, max_days=3.0)
    return x.select("a0", "a1", "d0", "d1", r6("lat").alias("lat"), r6("lon").alias("lon"), r6("dt_days").alias("days"), r6((F.col("time_a") - F.col("time_d")) / 86400.0).alias("apart"))


@query("J8_crossover_values", f"{_CROSS} SELECT x.a0, x.d0, {_r('ta.swh_ku * pa0 + tb.swh_ku * pa1', 'swh_a')}, {_r('tc.swh_ku * pd0 + td.swh_ku * pd1', 'swh_d')}, {_r('ta.lat * pa0 + tb.lat * pa1', 'lat_a')}, {_r('x.lat', 'lat')} FROM crossings x JOIN tracks ta ON ta.id = a0 JOIN tracks tb ON tb.id = a1 JOIN tracks tc ON tc.id = d0 JOIN tracks td ON td.id = d1")
def _crossover_values(spark, sf_dir):
    t = tracks(spark, sf_dir)
    v = match.crossover_values(match.crossovers(t, radius=400000.0, max_days=3.0), t, ["swh_ku", "lat"])
    return v.select("a0", "d0", r6("a.swh_ku").alias("swh_a"), r6("d.swh_ku").alias("swh_d"), r6("a.lat").alias("lat_a"), r6("lat").alias("lat"))


@query("J7_directions", "SELECT cycle, count(*) FILTER (WHERE pass_number % 2 = 1) AS up, count(*) FILTER (WHERE pass_number % 2 = 0) AS down FROM obs GROUP BY cycle")
def _directions(spark, sf_dir):
    o = observations(spark, sf_dir)
    up = match.ascending(o)
    return o.groupBy("cycle").agg(F.count(F.when(up, 1)).alias("up"), F.count(F.when(~up, 1)).alias("down"))


@query("J9_geodesy", f"SELECT id, round(x / 1000, 6) + 0.0e0 AS x, round(y / 1000, 6) + 0.0e0 AS y, round(z / 1000, 6) + 0.0e0 AS z, {_r('((lon + 180) - floor((lon + 180) / 360) * 360) - 180', 'lon180')} FROM (SELECT id, lon, {_ecef_sql('lat', 'lon', '')} FROM obs)")
def _geodesy(spark, sf_dir):
    x, y, z = geodesy.ecef(F.col("lat"), F.col("lon"))
    return observations(spark, sf_dir).select("id", r6(x / 1000).alias("x"), r6(y / 1000).alias("y"), r6(z / 1000).alias("z"), r6(geodesy.lon180(F.col("lon"))).alias("lon180"))


@query("J16_existing_cycles", "SELECT cycle, count(*) AS n FROM obs WHERE cycle IN (2, 3) GROUP BY cycle")
def _existing(spark, sf_dir):
    have = spark.createDataFrame([(2,), (3,), (7,)], "cycle int")
    return tables.existing_cycles(observations(spark, sf_dir), have).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))


@query("J18_raster_lookup", f"SELECT id, {_r('sin(radians(lat0 * 2.0e0)) * (1 - fy) * (1 - fx) * (1 + lon0) + sin(radians(lat0 * 2.0e0)) * (1 - fy) * fx * (1 + lon1) + sin(radians(lat1 * 2.0e0)) * fy * (1 - fx) * (1 + lon0) + sin(radians(lat1 * 2.0e0)) * fy * fx * (1 + lon1)', 'mss')} FROM (SELECT id, floor((lat + 90) / 2) * 2 - 90 AS lat0, floor((lat + 90) / 2) * 2 - 88 AS lat1, floor(lon / 2) AS lon0, (floor(lon / 2) + 1) % 180 AS lon1, (lat + 90) / 2 - floor((lat + 90) / 2) AS fy, lon / 2 - floor(lon / 2) AS fx FROM obs)")
def _raster(spark, sf_dir):
    r = spark.range(91 * 180).select(F.floor(F.col("id") / 180).cast("int").alias("ilat"), (F.col("id") % 180).cast("int").alias("ilon"))
    r = r.withColumn("z", F.sin(F.radians((F.col("ilat") * 2.0 - 90.0) * 2.0)) * (1 + F.col("ilon")))
    return evaluate.raster_lookup(observations(spark, sf_dir), r, 2.0, out="mss").select("id", r6("mss").alias("mss"))


@query("J19_unique_rows", "SELECT cycle, pass_number, count(*) AS n FROM obs GROUP BY cycle, pass_number")
def _unique(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("cycle", "pass_number").agg(F.count(F.lit(1)).alias("n"))


# --- design -------------------------------------------------------------------------------------------------------


@query("M1_bilinear_weights", f"WITH {_W} SELECT id, node, {_r('w', 'w')} FROM w")
def _bilinear_weights(spark, sf_dir):
    return design.exploded(_direct(spark, sf_dir), "id").select("id", "node", r6("w").alias("w"))


@query("M1_pair_weights", f"WITH {_W}, ok AS (SELECT id FROM w GROUP BY id), pr AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON b.id = a.id + 1), u AS (SELECT a, node, w FROM pr JOIN w ON w.id = a UNION ALL SELECT a, node, -w FROM pr JOIN w ON w.id = b) SELECT a AS id, node, {_r('sum(w)', 'w')} FROM u GROUP BY a, node HAVING sum(w) <> 0")
def _pair_weights(spark, sf_dir):
    d = _direct(spark, sf_dir).select("id", F.filter("nodes", lambda e: e["w"] != 0).alias("nodes"))
    b = d.select((F.col("id") - 1).alias("k"), F.col("nodes").alias("other"))
    pairs = d.join(b, F.col("id") == F.col("k")).select("id", design.difference(F.col("nodes"), F.col("other")).alias("nodes"))
    return design.exploded(pairs, "id").select("id", "node", r6("w").alias("w"))


@query("M3_trilinear_weights", f"""WITH c AS (SELECT id, swh_ku / 2.5e0 AS u, wind_speed_alt / 3.5e0 AS v, (sig0_ku - 10.0e0) / 2.5e0 AS t FROM obs), i AS (SELECT *, CAST(ceil(u) AS INT) - 1 AS i, CAST(ceil(v) AS INT) - 1 AS j, CAST(ceil(t) AS INT) - 1 AS k FROM c),
f AS (SELECT id, i, j, k, u - i AS a, v - j AS b, t - k AS c FROM i WHERE i BETWEEN 0 AND 4 AND j BETWEEN 0 AND 5 AND k BETWEEN 0 AND 3),
n AS (SELECT id, i + di + (j + dj) * 6 + (k + dk) * 42 AS node, (CASE WHEN di = 1 THEN a ELSE 1 - a END) * (CASE WHEN dj = 1 THEN b ELSE 1 - b END) * (CASE WHEN dk = 1 THEN c ELSE 1 - c END) AS w FROM f, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj), (SELECT unnest([0, 1]) AS dk))
SELECT node, count(*) AS n, {_r('sum(w)', 'w')} FROM n WHERE w <> 0 GROUP BY node""")
def _trilinear_weights(spark, sf_dir):
    o = observations(spark, sf_dir)
    n = o.withColumn("nodes", design.weights(CUBE, F.col("swh_ku"), F.col("wind_speed_alt"), F.col("sig0_ku"))).where(F.col("nodes").isNotNull())
    return design.exploded(n, "id").groupBy("node").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("w")).alias("w"))


_GAUSS = "g AS (SELECT CAST(row AS INT) AS row, row * 3.0e0 - 90.0e0 AS lat, CASE WHEN row IN (0, 60) THEN 1 ELSE CAST(floor(120.0e0 * cos(radians(row * 3.0e0 - 90.0e0))) AS INT) END AS cells FROM (SELECT unnest(range(0, 61)) AS row))"


_CELL = "r AS (SELECT o.*, CAST(floor((lat + 91.5e0) / 3) AS INT) AS row FROM obs o), h AS (SELECT r.*, g.cells, 360.0e0 / g.cells AS dlon FROM r JOIN g ON r.row = g.row), cell AS (SELECT *, row * 1000 + CAST(floor((lon + dlon / 2) / dlon) AS INT) % cells AS geo_cell FROM h)"


@query("M7_gauss_grid", f"WITH {_GAUSS}, {_CELL}, every AS (SELECT CAST(row * 1000 + k AS INT) AS geo_cell, lat, {_r('k * 360.0e0 / cells', 'lon')}, {_r('CASE WHEN row IN (0, 60) THEN 6.283185307179586e0 * (1 - cos(radians(1.5e0))) ELSE 360.0e0 / cells * 3 * cos(radians(lat)) * radians(1.0e0) * radians(1.0e0) END', 'area')} FROM (SELECT *, unnest(range(0, cells)) AS k FROM g)) SELECT e.*, count(c.id) AS n FROM every e LEFT JOIN cell c ON c.geo_cell = e.geo_cell GROUP BY ALL")
def _gauss(spark, sf_dir):
    """Every cell and the records in it."""
    n = observations(spark, sf_dir).groupBy(grids.gauss_cell(F.col("lat"), F.col("lon")).alias("geo_cell")).agg(F.count(F.lit(1)).alias("n"))
    g = grids.gauss_grid(spark, 3).withColumn("geo_cell", F.col("geo_cell").cast("int"))
    return g.join(n, "geo_cell", "left").select("geo_cell", "lat", r6("lon").alias("lon"), r6("area").alias("area"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("M6_geo_cells", f"WITH {_GAUSS}, {_CELL} SELECT geo_cell, count(*) AS n FROM cell GROUP BY geo_cell")
def _geo_cells(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(grids.gauss_cell(F.col("lat"), F.col("lon")).alias("geo_cell")).agg(F.count(F.lit(1)).alias("n"))


@query("M8_grid_nodes", f"WITH {bins_sql(GRID)} SELECT CAST(g.n AS INT) AS node, CAST(g.n % 14 AS INT) AS ix, CAST(g.n // 14 AS INT) AS iy, {_r('(g.n % 14) * 1.0e0', 'x')}, {_r('(g.n // 14) * 1.5e0', 'y')}, coalesce(bins.n, 0) AS n FROM (SELECT unnest(range(0, 210)) AS n) g LEFT JOIN bins ON bins.node = g.n")
def _grid_nodes(spark, sf_dir):
    """Every node and the records nearest to it."""
    return bins(spark, sf_dir, GRID).select("node", "ix", "iy", r6("x").alias("x"), r6("y").alias("y"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("M9_two_band_rows", f"WITH {_W}, t AS (SELECT id, 0 AS part, node, 1.2e0 * w AS w FROM w UNION ALL SELECT id, 0, node + 210, -0.2e0 * w FROM w UNION ALL SELECT id, 1, node, w FROM w UNION ALL SELECT id, 1, node + 210, -w FROM w) SELECT part, node, count(*) AS n, {_r('sum(w)', 'w')} FROM t GROUP BY part, node")
def _two_band(spark, sf_dir):
    d = _direct(spark, sf_dir).select(F.col("id").alias("obs_id"), "nodes", F.col("z").alias("z_range"), F.col("usla_c").alias("z_tec"))
    return design.exploded(design.two_band_rows(d, 210, 0.2), "part").groupBy("part", "node").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("w")).alias("w"))


@query("M10_on_grid", f"WITH {_W}, m AS (SELECT node, avg(z) AS v FROM w GROUP BY node HAVING count(*) >= 200) SELECT CAST(n AS INT) AS node, {_r('v', 'value')} FROM (SELECT unnest(range(0, 210)) AS n) LEFT JOIN m ON m.node = n")
def _on_grid(spark, sf_dir):
    m = design.exploded(_direct(spark, sf_dir), "z").groupBy("node").agg(F.avg("z").alias("value"), F.count(F.lit(1)).alias("n")).where("n >= 200")
    return grids.on_grid(m, GRID).select("node", r6("value").alias("value"))


# --- aggregation and least squares -----------------------------------------------------------------------------------


@query("A1_node_counts", f"WITH {_W} SELECT node, count(*) AS n FROM w GROUP BY node")
def _node_counts(spark, sf_dir):
    return lsq.node_counts(_direct(spark, sf_dir))


@query("A3_normal_matrix", f"WITH {_W} SELECT a.node AS i, b.node AS j, {_r('sum(a.w * b.w)', 'v')} FROM w a JOIN w b ON a.id = b.id AND a.node <= b.node GROUP BY 1, 2")
def _normal_matrix(spark, sf_dir):
    d = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0))
    return lsq.normal_matrix(d).select("i", "j", r6("v").alias("v"))


_BETA = "(pi() / 2 - atan(abs((5.8e0 * sin(asin(abs(cos(radians(66.16e0)) / cos(radians({lat}))))) - 0.46e0 * cos(radians({lat}))) / (5.8e0 * cos(asin(abs(cos(radians(66.16e0)) / cos(radians({lat})))))))))"
_LATW = f"sin({_BETA.format(lat='lat')}) / sin({_BETA.format(lat='0.0e0')})"


@query("A3_weighted_vector", f"WITH {_W} SELECT node AS i, {_r(f'sum(w * z * {_LATW})', 'v')} FROM w GROUP BY node")
def _weighted_vector(spark, sf_dir):
    d = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0))
    return lsq.normal_vector(d, weight=physics.latitude_weight(F.col("lat"), MISSION)).select("i", r6("v").alias("v"))


@query("A5_cycle_sums", f"WITH {_W} SELECT cycle, node AS i, {_r('sum(w * z)', 'v')} FROM w GROUP BY cycle, node")
def _cycle_sums(spark, sf_dir):
    d = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0))
    return lsq.normal_vector(d, "cycle").select("cycle", "i", r6("v").alias("v"))


_GEO_W = f"{_GAUSS}, {_CELL}, {_W}, e AS (SELECT w.*, c.geo_cell FROM w JOIN cell c ON c.id = w.id)"


@query("A8_eliminated_levels", f"WITH {_GEO_W}, n AS (SELECT cycle, geo_cell, count(DISTINCT id) AS n FROM e GROUP BY 1, 2), s AS (SELECT cycle, geo_cell, node, sum(w) AS s FROM e GROUP BY 1, 2, 3), m AS (SELECT a.node AS i, b.node AS j, a.w * b.w AS v FROM e a JOIN e b ON a.id = b.id AND a.node <= b.node UNION ALL SELECT a.node, b.node, -a.s * b.s / n.n FROM s a JOIN s b ON a.cycle = b.cycle AND a.geo_cell = b.geo_cell AND a.node <= b.node JOIN n ON n.cycle = a.cycle AND n.geo_cell = a.geo_cell) SELECT i, j, {_r('sum(v)', 'v')} FROM m GROUP BY i, j")
def _eliminated(spark, sf_dir):
    d = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0)).withColumn("geo_cell", grids.gauss_cell(F.col("lat"), F.col("lon")))
    return lsq.demeaned(d, "cycle", "geo_cell")[0].select("i", "j", r6("v").alias("v"))


@query("A8_group_levels", f"WITH {_GEO_W}, f AS (SELECT id, cycle, geo_cell, z, sum(w * (node * 0.0001e0)) AS m FROM e GROUP BY 1, 2, 3, 4) SELECT cycle, geo_cell, {_r('avg(z - m)', 'level')}, count(*) AS n FROM f GROUP BY 1, 2")
def _group_levels(spark, sf_dir):
    d = _direct(spark, sf_dir).withColumn("geo_cell", grids.gauss_cell(F.col("lat"), F.col("lon")))
    solved = grids.nodes(spark, GRID).select("node", (F.col("node") * 0.0001).alias("value"))
    return lsq.group_levels(d, solved, "cycle", "geo_cell").select("cycle", "geo_cell", r6("level").alias("level"), "n")


@query("A9_latitude_weight", f"SELECT id, {_r(_LATW, 'w')} FROM obs")
def _latitude(spark, sf_dir):
    return observations(spark, sf_dir).select("id", r6(physics.latitude_weight(F.col("lat"), MISSION)).alias("w"))


@query("A10_pair_weight", f"SELECT id, {_r('230.0e0 * exp(-abs(time / 86400.0e0 - 15.0e0) / 3.0e0) + 120.0e0', 'w')} FROM obs")
def _pair_weight(spark, sf_dir):
    return observations(spark, sf_dir).select("id", r6(physics.pair_weight(F.col("time") / 86400.0 - 15.0)).alias("w"))


@query("A11_cycle_bins", f"WITH {_W}, c AS (SELECT cycle, node, count(*) AS n FROM w GROUP BY 1, 2) SELECT node, sum(n)::BIGINT AS n, count(*) AS cycles FROM c GROUP BY node HAVING sum(n) >= 100")
def _cycle_bins(spark, sf_dir):
    return lsq.node_counts(_direct(spark, sf_dir), "cycle").groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cycles")).where("n >= 100")


@query("A12_reference_mean", f"SELECT cycle, {_r(f'sum(usla_ku * {_LATW}) / sum({_LATW})', 'level')} FROM obs WHERE swh_ku >= 1.625e0 AND swh_ku < 1.875e0 AND wind_speed_alt >= 5.375e0 AND wind_speed_alt < 5.625e0 GROUP BY cycle")
def _reference(spark, sf_dir):
    m = levels.reference_mean(observations(spark, sf_dir), F.col("swh_ku"), F.col("wind_speed_alt"), F.col("usla_ku"), physics.latitude_weight(F.col("lat"), MISSION))
    return m.select("cycle", r6("level").alias("level"))


@query("A13_sample_statistics", f"""WITH s AS (SELECT id, unnest(range(0, 20)) AS k, swh_ku FROM obs), v AS (SELECT id, swh_ku + ((id * 7 + k * k * 31) % 100) / 100.0e0 AS v FROM s WHERE (id + k) % 3 <> 0), m AS (SELECT id, avg(v) AS m, stddev_pop(v) AS s, median(v) AS d FROM v GROUP BY id), t AS (SELECT v.id, avg((v - m) * (v - m) * (v - m)) AS m3 FROM v JOIN m ON v.id = m.id GROUP BY v.id)
SELECT m.id, {_r('CASE WHEN s > 0 THEN m3 / (s * s * s) END', 'skew')}, {_r('d', 'median')}, {_r('m', 'mean')}, {_r('s', 'std')} FROM m JOIN t ON m.id = t.id""")
def _samples(spark, sf_dir):
    k = F.sequence(F.lit(0), F.lit(19))
    o = observations(spark, sf_dir).select("id", F.transform(k, lambda i: F.col("swh_ku") + F.pmod(F.col("id") * 7 + i * i * 31, F.lit(100)) / 100.0).alias("v"), F.transform(k, lambda i: F.when(F.pmod(F.col("id") + i, F.lit(3)) != 0, 0).otherwise(1)).alias("u"))
    found = o.select("id", windows.sample_summary(F.col("v"), F.col("u")).alias("s"))
    return found.select("id", *[r6(f"s.{f}").alias(f) for f in ("skew", "median", "mean", "std")])


@query("A14_residual_mse", f"WITH {_W}, f AS (SELECT id, cycle, z, sum(w * (node * 0.0001e0)) AS m FROM w GROUP BY 1, 2, 3) SELECT cycle, {_r('avg((z - m) * (z - m))', 'mse')} FROM f GROUP BY cycle")
def _mse(spark, sf_dir):
    values = evaluate.node_array(grids.nodes(spark, GRID).select("node", (F.col("node") * 0.0001).alias("value")), GRID)
    res = F.col("z") - evaluate.apply_weights(F.col("nodes"), values)
    return _direct(spark, sf_dir).groupBy("cycle").agg(r6(F.avg(res * res)).alias("mse"))


# --- outliers ---------------------------------------------------------------------------------------------------------


def _outlier_sql(value: str, z: str, rounds: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    ctes = [f"o0 AS (SELECT id, {by + ', ' if by else ''}{value} AS v FROM obs)"]
    for i in range(rounds):
        ctes.append(f"o{i + 1} AS (SELECT id, {by + ', ' if by else ''}v FROM (SELECT *, avg(v) OVER ({part}) AS m, stddev_pop(v) OVER ({part}) AS s FROM o{i}) WHERE v BETWEEN m - {z} * s AND m + {z} * s)")
    return f"WITH {', '.join(ctes)} SELECT id FROM o{rounds}"


@query("O1_outliers", _outlier_sql("usla_c", "2.5e0", 20))
def _outliers(spark, sf_dir):
    return outliers.without_outliers(observations(spark, sf_dir), F.col("usla_c"), 2.5).select("id")


@query("O1_outliers_by_cycle", _outlier_sql("usla_ku", "3.0e0", 14, "cycle"))
def _outliers_by_cycle(spark, sf_dir):
    return outliers.without_outliers(observations(spark, sf_dir), F.col("usla_ku"), 3.0, "cycle").select("id")


@query("O2_pair_outliers", "WITH " + ", ".join(f"{n}0 AS (SELECT id, {e} AS v FROM obs), " + ", ".join(f"{n}{i + 1} AS (SELECT id, v FROM (SELECT *, avg(v) OVER () AS m, stddev_pop(v) OVER () AS s FROM {n}{i}) WHERE v BETWEEN m - 2.5e0 * s AND m + 2.5e0 * s)" for i in range(14)) for n, e in (("a", "usla_ku"), ("b", "usla_c"), ("d", "usla_ku - usla_c"))) + " SELECT id FROM a14 WHERE id IN (SELECT id FROM b14) AND id IN (SELECT id FROM d14)")
def _pair_outliers(spark, sf_dir):
    return outliers.without_pair_outliers(observations(spark, sf_dir), F.col("usla_ku"), F.col("usla_c"), 2.5).select("id")


# --- windows ----------------------------------------------------------------------------------------------------------

_STEP = "d AS (SELECT *, time - lag(time) OVER (PARTITION BY cycle ORDER BY time) AS step FROM obs), md AS (SELECT cycle, median(step) AS med FROM d GROUP BY cycle)"
_WIN = "v AS (SELECT id, cycle, avg(iono_corr_alt_ku) OVER w AS m, count(*) OVER w AS n, last(time) OVER w - first(time) OVER w AS span FROM obs WINDOW w AS (PARTITION BY cycle ORDER BY time ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))"


@query("W1_moving_mean", f"WITH {_STEP}, {_WIN} SELECT v.id, {_r('CASE WHEN n = 21 AND med <= 200.0e0 THEN m END', 'smooth')} FROM v JOIN md ON v.cycle = md.cycle")
def _moving(spark, sf_dir):
    return windows.moving_mean(observations(spark, sf_dir), "iono_corr_alt_ku", 21, "cycle", max_step=200.0).select("id", r6("smooth").alias("smooth"))


@query("W3_neighbours", f"SELECT id, {_r('lag(swh_ku) OVER w', 'before')}, {_r('lead(swh_ku) OVER w', 'after')} FROM tracks WINDOW w AS (PARTITION BY cycle, pass_number ORDER BY time)")
def _neighbours(spark, sf_dir):
    return windows.neighbours(tracks(spark, sf_dir), ["swh_ku"], "cycle", "pass_number").select("id", r6("swh_ku_prev").alias("before"), r6("swh_ku_next").alias("after"))


_HIST = "b AS (SELECT cycle, CAST(floor((usla_ku + 0.5e0) / 0.001e0) AS INT) AS bin, count(*) AS n FROM obs GROUP BY 1, 2), every AS (SELECT cycle, CAST(k AS INT) AS bin FROM (SELECT DISTINCT cycle FROM obs), (SELECT unnest(range(0, 999)) AS k)), h AS (SELECT e.cycle, e.bin, coalesce(b.n, 0) AS n FROM every e LEFT JOIN b ON b.cycle = e.cycle AND b.bin = e.bin)"


@query("L1_histogram", f"WITH {_HIST} SELECT cycle, bin, n, CAST(sum(n) OVER (PARTITION BY cycle ORDER BY bin) AS BIGINT) AS cdf FROM h")
def _histogram(spark, sf_dir):
    return levels.histogram(observations(spark, sf_dir), F.col("usla_ku"), "ssb", "cycle").select("cycle", "bin", "n", "cdf")


@query("W4_cumulative", "SELECT cycle, bin, CAST(sum(n) OVER (PARTITION BY cycle ORDER BY bin) AS BIGINT) AS cdf FROM (SELECT cycle, CAST(floor(swh_ku) AS INT) AS bin, count(*) AS n FROM obs GROUP BY 1, 2)")
def _cumulative(spark, sf_dir):
    g = observations(spark, sf_dir).groupBy("cycle", F.floor("swh_ku").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return windows.cumulative(g, "n", "cycle").select("cycle", "bin", "cdf")


@query("W5_changing_bins", f"WITH {_HIST}, c AS (SELECT cycle, bin, sum(n) OVER (PARTITION BY cycle ORDER BY bin) AS cdf FROM h), x AS (SELECT *, lead(cdf) OVER (PARTITION BY cycle ORDER BY bin) AS nxt FROM c) SELECT cycle, bin FROM x WHERE nxt <> cdf")
def _changing(spark, sf_dir):
    return windows.changing(levels.histogram(observations(spark, sf_dir), F.col("usla_ku"), "ssb", "cycle"), "cdf", "cycle").select("cycle", "bin")


@query("W6_nearest_per_key", "SELECT pass_number, id FROM (SELECT *, row_number() OVER (PARTITION BY pass_number ORDER BY abs(lat), id) AS k FROM obs) WHERE k = 1")
def _nearest_per_key(spark, sf_dir):
    o = observations(spark, sf_dir).select("pass_number", "id", F.abs("lat").alias("far"))
    return windows.nearest_per_key(o, "pass_number", "far", "id").select("pass_number", "id")


# --- evaluation, levels, smoothing --------------------------------------------------------------------------------------

_MODEL = "(CASE WHEN {n} % 11 = 3 THEN NULL ELSE sin({n} * 1.0e0) END)"


def _model(spark: SparkSession, grid: Grid) -> DataFrame:
    n = F.col("node")
    return grids.nodes(spark, grid).select("*", F.when(n % 11 != 3, F.sin(n.cast("double"))).alias("value"), (F.lit(0.1) + F.pmod(n * 7, F.lit(10)) / 100.0).alias("error"))


@query("E1_bilinear_model", f"""WITH c AS (SELECT id, least(CAST(floor(swh_ku) AS INT), 12) AS i, least(CAST(floor(wind_speed_alt / 1.5e0) AS INT), 13) AS j, swh_ku, wind_speed_alt FROM obs WHERE swh_ku <= 13 AND wind_speed_alt <= 21),
f AS (SELECT id, swh_ku - i AS x, wind_speed_alt / 1.5e0 - j AS y, {_MODEL.format(n='(i + j * 14)')} AS a, {_MODEL.format(n='(i + 1 + j * 14)')} AS b, {_MODEL.format(n='(i + (j + 1) * 14)')} AS c, {_MODEL.format(n='(i + 1 + (j + 1) * 14)')} AS d FROM c),
v AS (SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL THEN a * (1 - x) * (1 - y) + b * x * (1 - y) + c * (1 - x) * y + d * x * y
  WHEN a IS NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AND x + y >= 1 THEN d + (c - d) * (1 - x) + (b - d) * (1 - y)
  WHEN b IS NULL AND a IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AND x <= y THEN c + (d - c) * x + (a - c) * (1 - y)
  WHEN c IS NULL AND a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND x >= y THEN b + (a - b) * (1 - x) + (d - b) * y
  WHEN d IS NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND x + y <= 1 THEN a + (b - a) * x + (c - a) * y END AS v FROM f)
SELECT o.id, {_r('v', 'v')} FROM obs o LEFT JOIN v ON v.id = o.id""")
def _bilinear(spark, sf_dir):
    v = evaluate.bilinear(evaluate.node_array(_model(spark, GRID), GRID), GRID, F.col("swh_ku"), F.col("wind_speed_alt"))
    return observations(spark, sf_dir).select("id", r6(v).alias("v"))


@query("E2_trilinear_model", f"""WITH c AS (SELECT id, least(CAST(floor(swh_ku / 2.5e0) AS INT), 4) AS i, least(CAST(floor(wind_speed_alt / 3.5e0) AS INT), 5) AS j, least(CAST(floor((sig0_ku - 10.0e0) / 2.5e0) AS INT), 3) AS k, swh_ku / 2.5e0 AS u, wind_speed_alt / 3.5e0 AS v, (sig0_ku - 10.0e0) / 2.5e0 AS t FROM obs WHERE swh_ku <= 12.5e0 AND wind_speed_alt <= 21 AND sig0_ku BETWEEN 10 AND 20),
f AS (SELECT id, {_MODEL.format(n='(i + di + (j + dj) * 6 + (k + dk) * 42)')} AS m, (CASE WHEN di = 1 THEN u - i ELSE 1 - u + i END) * (CASE WHEN dj = 1 THEN v - j ELSE 1 - v + j END) * (CASE WHEN dk = 1 THEN t - k ELSE 1 - t + k END) AS w FROM c, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj), (SELECT unnest([0, 1]) AS dk))
SELECT id, {_r('CASE WHEN count(m) = 8 THEN sum(m * w) END', 'v')} FROM f GROUP BY id""")
def _trilinear(spark, sf_dir):
    o = observations(spark, sf_dir)
    v = evaluate.trilinear(evaluate.node_array(_model(spark, CUBE), CUBE), CUBE, F.col("swh_ku"), F.col("wind_speed_alt"), F.col("sig0_ku"))
    return o.where("swh_ku <= 12.5 and wind_speed_alt <= 21 and sig0_ku between 10 and 20").select("id", r6(v).alias("v"))


@query("L4_moment_fit", f"SELECT cycle, {_r('regr_intercept(usla_ku, swh_ku)', 'c0')}, {_r('regr_slope(usla_ku, swh_ku)', 'c1')} FROM obs GROUP BY cycle")
def _moment(spark, sf_dir):
    c = levels.moment_fit(observations(spark, sf_dir), F.col("swh_ku"), F.col("usla_ku"), 1, "cycle")
    return c.select("cycle", r6(F.col("c")[0]).alias("c0"), r6(F.col("c")[1]).alias("c1"))


@query("L8_kernel_means", f"WITH {bins_sql(GRID)}, n AS (SELECT node, node % 14 AS ix, node // 14 AS iy, value AS v, error AS e FROM bins WHERE node % 11 <> 3), p AS (SELECT a.node, b.v, b.e, exp(-((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy))::DOUBLE) / (b.e * b.e) AS w FROM n a JOIN n b ON abs(a.ix - b.ix) <= 6 AND abs(a.iy - b.iy) <= 6) SELECT CAST(node AS INT) AS node, {_r('sum(w * e) / sum(w)', 'se')}, {_r('sum(w * v) / sum(w)', 'sv')} FROM p GROUP BY node")
def _kernel(spark, sf_dir):
    return smooth.kernel_means(bins(spark, sf_dir, GRID).where("value is not null and node % 11 <> 3"), GRID).select("node", r6("se").alias("se"), r6("sv").alias("sv"))


@query("L9_set_level", f"WITH {bins_sql(GRID)} SELECT CAST(g.n AS INT) AS node, {_r('bins.value - (SELECT value FROM bins WHERE node = 7 + 3 * 14) - 0.088e0', 'value')} FROM (SELECT unnest(range(0, 210)) AS n) g LEFT JOIN bins ON bins.node = g.n")
def _set_level(spark, sf_dir):
    return smooth.set_level(bins(spark, sf_dir, GRID), 7, 3).select("node", r6("value").alias("value"))


@query("I1_tec_histogram", f"WITH t AS (SELECT cycle, iono_corr_gim_ku * ({repr(physics.KU_HZ**2 / -40.3 / 10000000000000000.0e0)}::DOUBLE) AS v FROM obs), b AS (SELECT cycle, CAST(floor((v + 100.0e0) / {levels.TEC_STEP}::DOUBLE) AS INT) AS bin FROM t) SELECT cycle, bin, count(*) AS n FROM b WHERE bin BETWEEN 0 AND {levels.bins('tec')[2] - 1} GROUP BY 1, 2")
def _tec(spark, sf_dir):
    h = levels.histogram(observations(spark, sf_dir), physics.tec_units(F.col("iono_corr_gim_ku")), "tec", "cycle")
    return h.where("n > 0").select("cycle", "bin", "n")


# --- scalars ----------------------------------------------------------------------------------------------------------


@query("X1_wind_speed", f"SELECT id, {_r(_wind_sql('sig0_ku'), 'j2')}, {_r(_wind_sql('sig0_ku', '2.69e0'), 'tx')} FROM obs")
def _wind(spark, sf_dir):
    return observations(spark, sf_dir).select("id", *[r6(physics.wind_speed(F.col("sig0_ku"), F.col("swh_ku"), m)).alias(m) for m in ("j2", "tx")])


@query("X2_aligned_sig0", f"SELECT id, {_r('sig0_ku + 2.4e0 + 11.34e0 * off_nadir_angle_wf_ku', 'ku')}, {_r('sig0_ku + 0.73e0 + 2.01e0 * off_nadir_angle_wf_ku', 'c')} FROM obs")
def _sig0(spark, sf_dir):
    return observations(spark, sf_dir).select("id", *[r6(physics.aligned_sig0(F.col("sig0_ku"), F.col("off_nadir_angle_wf_ku"), "j2", b)).alias(b) for b in ("ku", "c")])


@query("X3_noise", f"SELECT id, {_r(_noise_sql('(swh_rms_ku - 0.6e0)', 1), 'noise')} FROM obs")
def _noise(spark, sf_dir):
    return observations(spark, sf_dir).select("id", r6(physics.noise(F.col("id"), F.col("swh_rms_ku") - 0.6)).alias("noise"))


@query("X5_rounding", "SELECT id, round_even(swh_ku * 0.5e0, 1) + 0.0e0 AS even, CAST(floor(time / 86400.0e0) AS INT) AS day FROM obs")
def _rounding(spark, sf_dir):
    return observations(spark, sf_dir).select("id", (F.bround(F.col("swh_ku") * 0.5, 1) + F.lit(0.0)).alias("even"), F.floor(F.col("time") / 86400.0).cast("int").alias("day"))


@query("X8_labels", "SELECT DISTINCT 'c' || lpad(CAST(cycle AS VARCHAR), 3, '0') || 'p' || lpad(CAST(pass_number AS VARCHAR), 4, '0') AS label FROM obs")
def _labels(spark, sf_dir):
    return observations(spark, sf_dir).select(F.concat(F.lit("c"), F.lpad(F.col("cycle").cast("string"), 3, "0"), F.lit("p"), F.lpad(F.col("pass_number").cast("string"), 4, "0")).alias("label")).distinct()


# --- whole steps ------------------------------------------------------------------------------------------------------


@query("Q2_direct_rows", f"WITH {_W}, k AS (SELECT id FROM obs WHERE abs(lat) < 66.16::DOUBLE AND {_LEVEL2}) SELECT w.id, node, {_r('w', 'w')}, {_r('z', 'z')} FROM w JOIN k ON k.id = w.id")
def _direct_rows(spark, sf_dir):
    d = steps.direct(observations(spark, sf_dir), GRID, MISSION)
    return design.exploded(d, "id", "z").select("id", "node", r6("w").alias("w"), r6("z").alias("z"))


@query("Q4_streamed_normal_matrix", f"WITH {_W} SELECT a.node AS i, b.node AS j, {_r('sum(a.w * b.w)', 'v')} FROM w a JOIN w b ON a.id = b.id AND a.node <= b.node GROUP BY 1, 2")
def _streamed(spark, sf_dir):
    from ..streaming.incremental import accumulated, normal_equations_stream

    path, source = _shared(spark, "stream"), _shared(spark, "arrivals")
    o = observations(spark, sf_dir).select("cycle", "swh_ku", "wind_speed_alt", "usla_ku")
    o.write.partitionBy("cycle").parquet(source)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 2).parquet(source)
    normal_equations_stream(stream, GRID, f"{path}/sums", f"{path}/checkpoint", x="swh_ku", y="wind_speed_alt", z="usla_ku").awaitTermination()
    return accumulated(spark, f"{path}/sums").where("j >= 0 and v <> 0").select("i", "j", r6("v").alias("v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["A7_solved_grid"](spark, sf_dir)


