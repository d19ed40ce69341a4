"""Registered queries of product names: every canonical column of every format version, by what it is called in the product.

The texts below are the expected names, a pair a line, written out; the engine finds them by its own tables and rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog
from .fixture import observations
from .registered import _r, query, r6

# Canonical names and names in the product ("group.name" in nested files), by format version.
EXPECTED = {
    "version_1": (1, "j1", """
        ocean_tide_got ocean_tide_sol1
        ocean_tide_fes ocean_tide_sol2
        load_tide_got ocean_tide_sol1
        load_tide_fes ocean_tide_sol2
        ocean_tide_non_eq ocean_tide_non_equil
        surface_classification_flag surface_type
        mean_dynamic_topography mean_topography
        swh_ku swh_ku
        rad_surf_type rad_surf_type"""),
    "version_2": (2, "j2", """
        lat latitude
        lon longitude
        alt altitude
        rad_surf_type rad_surface_type_flag
        rad_wet_tropo_corr rad_wet_tropo_cor
        model_dry_tropo_corr model_dry_tropo_cor_zero_altitude
        wind_speed_rad rad_wind_speed
        model_wet_tropo_corr model_wet_tropo_cor_zero_altitude
        iono_corr_alt_ku iono_cor_alt_ku
        iono_corr_alt_ku_mle3 iono_cor_alt_ku_mle3
        iono_corr_gim_ku iono_cor_gim_ku
        mean_sea_surface mean_sea_surface_cnescls
        bathymetry depth_or_elevation
        ocean_tide_fes ocean_tide_fes"""),
    "version_3_j3": (3, "j3", """
        swh_ku ku.swh_ocean
        sig0_ku ku.sig0_ocean
        range_ku ku.range_ocean
        off_nadir_angle_wf_ku ku.off_nadir_angle_wf_ocean
        off_nadir_angle_wf_rms_ku ku.off_nadir_angle_wf_ocean_rms
        iono_corr_gim_ku ku.iono_cor_gim
        range_numval_ku ku.range_ocean_numval
        range_rms_ku ku.range_ocean_rms
        sig0_rms_ku ku.sig0_ocean_rms
        swh_rms_ku ku.swh_ocean_rms
        sea_state_bias_3d_mp2 ku.sea_state_bias_3d_mp2
        sea_state_bias_adaptive_3d_mp2 ku.sea_state_bias_adaptive_3d_mp2
        wvf_main_class ku.wvf_main_class
        ssha ku.ssha
        lat latitude
        lon longitude
        alt altitude
        rad_wet_tropo_corr rad_wet_tropo_cor
        model_dry_tropo_corr model_dry_tropo_cor_zero_altitude
        solid_earth_tide solid_earth_tide
        internal_tide_hret internal_tide
        mean_sea_surface mean_sea_surface_cnescls
        wind_speed_rad rad_wind_speed
        wind_speed_alt wind_speed_alt
        model_wet_tropo_corr model_wet_tropo_cor_zero_altitude
        mean_sea_surface_dtu mean_sea_surface_dt
        bathymetry depth_or_elevation
        rad_surf_type rad_surface_type_flag
        inv_bar_corr inv_bar_cor
        sst sst
        mean_wave_period_t02 mean_wave_period_t02
        mean_wave_direction mean_wave_direction
        sea_ice_concentration sea_ice_concentration
        angle_of_approach_to_coast angle_of_approach_to_coast
        wave_model_map_availability_flag wave_model_map_availability_flag
        altitude_rate altitude_rate
        surface_slope_cor surface_slope_cor
        ocean_tide_non_eq ocean_tide_non_eq
        ocean_tide_got ocean_tide_got
        dac dac
        sea_state_bias_ku ku.sea_state_bias
        sea_state_bias_c c.sea_state_bias
        iono_corr_alt_ku ku.iono_cor_alt_filtered
        iono_corr_alt_ku_mle3 ku.iono_cor_alt_filtered_mle3
        range_c c.range_ocean
        range_rms_c c.range_ocean_rms
        range_numval_c c.range_ocean_numval
        range_ku_mle3 ku.range_ocean_mle3
        range_rms_ku_mle3 ku.range_ocean_mle3_rms
        range_numval_ku_mle3 ku.range_ocean_mle3_numval
        sig0_c c.sig0_ocean
        sig0_rms_c c.sig0_ocean_rms
        sig0_ku_mle3 ku.sig0_ocean_mle3
        sig0_rms_ku_mle3 ku.sig0_ocean_mle3_rms
        swh_c c.swh_ocean
        swh_rms_c c.swh_ocean_rms
        swh_ku_mle3 ku.swh_ocean_mle3
        swh_rms_ku_mle3 ku.swh_ocean_mle3_rms"""),
    "version_3_s6A": (3, "s6A", """
        swh_ku ku.swh_ocean
        range_ku ku.range_ocean
        off_nadir_angle_wf_ku ku.off_nadir_angle_wf_ocean
        iono_corr_gim_ku ku.iono_cor_gim
        iono_corr_gim_c c.iono_cor_gim
        range_numval_ku ku.range_ocean_numval
        range_rms_ku ku.range_ocean_rms
        ocean_geo_corrections ku.ocean_geo_corrections
        mean_sea_surface mean_sea_surface_sol1
        mean_sea_surface_dtu mean_sea_surface_sol2
        ocean_tide_got ocean_tide_sol1
        ocean_tide_fes ocean_tide_sol2
        load_tide_got ocean_tide_sol1
        load_tide_fes ocean_tide_sol2
        iono_corr_alt_ku iono_cor_alt_filtered
        iono_corr_alt_ku_mle3 iono_cor_alt_filtered_mle3
        sea_state_bias_ku ku.sea_state_bias
        sea_state_bias_c c.sea_state_bias
        range_c c.range_ocean
        range_numval_c c.range_ocean_numval
        sig0_c c.sig0_ocean
        swh_rms_c c.swh_ocean_rms
        swh_ku_mle3 ku.swh_ocean_mle3
        lat latitude
        bathymetry depth_or_elevation
        internal_tide_hret internal_tide
        dac dac"""),
    "version_3_s6Ah": (3, "s6Ah", """
        swh_ku ku.swh_ocean
        sig0_ku ku.sig0_ocean
        range_ku ku.range_ocean
        range_rms_ku ku.range_ocean_rms
        range_numval_ku ku.range_ocean_numval
        sea_state_bias_ku ku.sea_state_bias
        iono_corr_gim_ku ku.iono_cor_gim
        iono_corr_alt_ku iono_cor_alt_filtered
        iono_corr_alt_ku_notsmooth iono_cor_alt
        off_nadir_pitch_angle_pf off_nadir_pitch_angle_pf
        off_nadir_roll_angle_pf off_nadir_roll_angle_pf
        ocean_tide_fes ocean_tide_sol2
        mean_sea_surface mean_sea_surface_sol1
        rad_distance_to_land rad_distance_to_land
        lon longitude"""),
    "version_4": (4, "s3", """
        time time_01
        lat lat_01
        lon lon_01
        swh_ku swh_ocean_01_ku
        swh_c swh_ocean_01_c
        sig0_ku sig0_ocean_01_ku
        sig0_c sig0_ocean_01_c
        wind_speed_alt wind_speed_alt_01_ku
        alt alt_01
        range_ku range_ocean_01_ku
        range_c range_ocean_01_c
        off_nadir_angle_wf_ku corrected_off_nadir_angle_wf_ocean_01_plrm_ku
        sea_state_bias_ku sea_state_bias_01_ku
        sea_state_bias_c sea_state_bias_01_c
        ssha ssha_01_ku
        rad_wet_tropo_corr rad_wet_tropo_cor_01_ku
        model_dry_tropo_corr mod_dry_tropo_cor_zero_altitude_01
        iono_corr_gim_ku iono_cor_gim_01_ku
        pole_tide pole_tide_01
        solid_earth_tide solid_earth_tide_01
        ocean_tide_got ocean_tide_sol1_01
        ocean_tide_non_eq ocean_tide_non_eq_01
        ocean_tide_fes ocean_tide_sol2_01
        mean_sea_surface mean_sea_surf_sol1_01
        mean_sea_surface_dtu mean_sea_surf_sol2_01
        range_numval_ku range_ocean_numval_01_ku
        range_numval_c range_ocean_numval_01_c
        range_rms_ku range_ocean_rms_01_ku
        range_rms_c range_ocean_rms_01_c
        sig0_rms_ku sig0_ocean_rms_01_ku
        sig0_rms_c sig0_ocean_rms_01_c
        swh_rms_ku swh_ocean_rms_01_ku
        swh_rms_c swh_ocean_rms_01_c
        surface_classification_flag surf_type_01
        ice_flag open_sea_ice_flag_01_ku
        rain_flag rain_flag_01_ku
        rad_surf_type rad_surf_type_01
        inv_bar_corr inv_bar_cor_01
        hf_fluctuations_corr hf_fluct_cor_01
        instr_op_mode instr_op_mode_01
        surf_class surf_class_01
        rad_along_track_avg_flag rad_along_track_avg_flag_01
        iono_corr_alt_ku iono_cor_alt_01_ku
        model_wet_tropo_corr mod_wet_tropo_cor_zero_altitude_01
        load_tide_got load_tide_sol1_01
        load_tide_fes load_tide_sol2_01
        mean_dynamic_topography geoid_01
        geoid geoid_01
        bathymetry odle_01
        off_nadir_angle_wf_rms_ku off_nadir_angle_rms_01_ku
        UTC_day UTC_day_01
        off_nadir_roll_angle_pf off_nadir_roll_angle_pf_01
        off_nadir_pitch_angle_pf off_nadir_pitch_angle_pf_01
        off_nadir_yaw_angle_pf off_nadir_yaw_angle_pf_01
        climato_use_flag_ku climato_use_flag_01_ku
        rad_distance_to_land dist_coast_01
        swh_ku_plrm swh_ocean_01_plrm_ku
        sig0_ku_plrm sig0_ocean_01_plrm_ku
        wind_speed_alt_plrm wind_speed_alt_01_plrm_ku
        range_ku_plrm range_ocean_01_plrm_ku
        off_nadir_angle_wf_ku_sar corrected_off_nadir_angle_wf_ocean_01_ku
        sea_state_bias_ku_plrm sea_state_bias_01_plrm_ku
        ssha_plrm ssha_01_plrm_ku
        rad_wet_tropo_corr_plrm rad_wet_tropo_cor_01_plrm_ku
        range_numval_ku_plrm range_ocean_numval_01_plrm_ku
        range_rms_ku_plrm range_ocean_rms_01_plrm_ku
        sig0_rms_ku_plrm sig0_ocean_rms_01_plrm_ku
        swh_rms_ku_plrm swh_ocean_rms_01_plrm_ku
        ice_flag_plrm open_sea_ice_flag_01_plrm_ku
        rain_flag_plrm rain_flag_01_plrm_ku
        iono_corr_alt_ku_plrm iono_cor_alt_01_plrm_ku
        off_nadir_angle_wf_rms_ku_plrm off_nadir_angle_rms_01_plrm_ku"""),
    "version_5": (5, "sw", """
        alt alt_gdrf
        off_nadir_angle_wf_ku off_nadir_angle2_wf_ku
        sea_state_bias_ku ssb_cls
        sea_state_bias_c ssb_cls_c
        rad_wet_tropo_corr wet_tropo_rad
        model_dry_tropo_corr dry_tropo_ecmwf
        pole_tide tide_pole
        solid_earth_tide tide_solid
        ocean_tide_got tide_ocean_got410
        ocean_tide_fes tide_ocean_fes14
        load_tide_got tide_load_got410
        load_tide_fes tide_load_fes14
        ocean_tide_non_eq tide_non_equil
        mean_sea_surface mss_cnescls15
        mean_sea_surface_dtu mss_dtu18
        range_numval_ku range_numval
        surface_classification_flag surface_class
        ice_flag qual_alt_rain_ice
        rain_flag qual_rad1_rain_ice
        rad_surf_type surface_type_rad1
        dac inv_bar_mog2d
        inv_bar_corr inv_bar_mog2d
        iono_corr_alt_ku iono_alt
        model_wet_tropo_corr wet_tropo_ecmwf
        mean_dynamic_topography geoid_egm2008
        geoid geoid_egm2008
        bathymetry topo_dtu10
        off_nadir_angle_wf_rms_ku off_nadir_angle2_wf_rms_ku
        rad_distance_to_land dist_coast
        iono_corr_alt_ku_mle3 iono_alt_mle3
        wind_speed_alt_mle3 wind_speed_alt_mle3
        ssb_cls_mle3 ssb_cls_mle3"""),
}


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split()) for line in text.strip().splitlines()]


def _product(spark, sf_dir, paths: list[str]):
    """The records as a product: nested by group, the k-th column holding the record's number times k."""
    one = {p: (F.col("id") * (k + 1)) for k, p in enumerate(paths)}
    nested = [F.struct(*[v.alias(p[len(g) + 1 :]) for p, v in one.items() if p.startswith(f"{g}.")]).alias(g) for g in ("ku", "c") if any(p.startswith(f"{g}.") for p in one)]
    return observations(spark, sf_dir).select(*[v.alias(p) for p, v in one.items() if "." not in p], *nested)


def _names(version: int, mission: str, text: str):
    def run(spark, sf_dir):
        """Sums of the canonical columns, each of which tells the product column that it was read from."""
        pairs = _pairs(text)
        paths = sorted({p for _, p in pairs})
        found = catalog.canonical(_product(spark, sf_dir, paths), [n for n, _ in pairs], version, mission)
        return found.agg(*[F.sum(c).alias(c) for c in found.columns]).unpivot([], found.columns, "name", "total")

    return run


def _names_sql(text: str) -> str:
    pairs = _pairs(text)
    paths = sorted({p for _, p in pairs})
    return "SELECT name, CAST(sum(id * k) AS BIGINT) AS total FROM obs, (VALUES " + ", ".join(f"('{n}', {paths.index(p) + 1})" for n, p in pairs) + ") t(name, k) GROUP BY name"


for _label, (_version, _mission, _text) in EXPECTED.items():
    query(f"P1_{_label}", _names_sql(_text))(_names(_version, _mission, _text))


_NESTED = [(m, n, p.split(".")[0] if "." in p else "") for _, (v, m, t) in EXPECTED.items() if v == 3 for n, p in _pairs(t)]


@query("P2_bands", "SELECT mission, name, band, count(*) AS n FROM obs JOIN (VALUES " + ", ".join(f"({k}, '{m}', '{n}', '{b}')" for k, (m, n, b) in enumerate(_NESTED)) + f") t(k, mission, name, band) ON obs.id % {len(_NESTED)} = t.k GROUP BY ALL")
def _bands(spark, sf_dir):
    """Records dealt to canonical names, by the group that the name is in."""
    of = {(m, n): b for v, m, t in EXPECTED.values() if v == 3 for b, found in catalog.bands([n for n, _ in _pairs(t)], 3, m).items() for n in found}
    groups = spark.createDataFrame([(k, m, n, of[m, n]) for k, (m, n, _) in enumerate(_NESTED)], "k long, mission string, name string, band string")
    o = observations(spark, sf_dir).groupBy(F.pmod("id", F.lit(len(_NESTED))).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return o.join(groups, "k").select("mission", "name", "band", "n")


@query("P3_adaptive_anomaly", f"SELECT id, {_r('usla_ku + (range_ku - (range_ku - 0.1e0 * swh_ku)) + (iono_corr_alt_ku - iono_corr_gim_ku) + (sea_state_bias_ku - sea_state_bias_c)', 'ssha')} FROM obs")
def _adaptive(spark, sf_dir):
    fields = {"ssha": F.col("usla_ku"), "range_ocean": F.col("range_ku"), "range_adaptive": F.col("range_ku") - 0.1 * F.col("swh_ku"), "iono_cor_alt_filtered": F.col("iono_corr_alt_ku"), "iono_cor_alt_filtered_adaptive": F.col("iono_corr_gim_ku"), "sea_state_bias": F.col("sea_state_bias_ku"), "sea_state_bias_adaptive": F.col("sea_state_bias_c")}
    o = observations(spark, sf_dir).select("id", F.struct(*[v.alias(n) for n, v in fields.items()]).alias("ku"))
    return o.select("id", r6(catalog.adaptive_anomaly()).alias("ssha"))
