"""Names of canonical columns in the products, by format version, mission and retracker."""

from __future__ import annotations

VERSIONS = (0, 1, 2, 3, 4, 5)
RETRACKERS = ("ocean", "adaptive")

# Names in flat files of versions 0 to 2, where they differ from the canonical ones.
VERSION_1 = {
    "ocean_tide_got": "ocean_tide_sol1", "ocean_tide_fes": "ocean_tide_sol2", "load_tide_got": "ocean_tide_sol1", "load_tide_fes": "ocean_tide_sol2",
    "ocean_tide_non_eq": "ocean_tide_non_equil", "surface_classification_flag": "surface_type", "mean_dynamic_topography": "mean_topography",
}
VERSION_2 = {
    "lat": "latitude", "lon": "longitude", "alt": "altitude", "rad_surf_type": "rad_surface_type_flag", "rad_wet_tropo_corr": "rad_wet_tropo_cor",
    "model_dry_tropo_corr": "model_dry_tropo_cor_zero_altitude", "wind_speed_rad": "rad_wind_speed", "model_wet_tropo_corr": "model_wet_tropo_cor_zero_altitude",
    "iono_corr_alt_ku": "iono_cor_alt_ku", "iono_corr_alt_ku_mle3": "iono_cor_alt_ku_mle3", "iono_corr_gim_ku": "iono_cor_gim_ku", "mean_sea_surface": "mean_sea_surface_cnescls",
    "bathymetry": "depth_or_elevation",
}

# Version 3, names that no band, mission or retracker changes.
VERSION_3 = {
    "lat": "latitude", "lon": "longitude", "alt": "altitude", "rad_wet_tropo_corr": "rad_wet_tropo_cor", "model_dry_tropo_corr": "model_dry_tropo_cor_zero_altitude",
    "internal_tide_hret": "internal_tide", "wind_speed_rad": "rad_wind_speed", "model_wet_tropo_corr": "model_wet_tropo_cor_zero_altitude", "bathymetry": "depth_or_elevation",
    "rad_surf_type": "rad_surface_type_flag", "inv_bar_corr": "inv_bar_cor", "iono_corr_gim_ku": "iono_cor_gim",
}
# Version 3, names by mission.
VERSION_3_MISSION = {
    "j3": {"mean_sea_surface": "mean_sea_surface_cnescls", "mean_sea_surface_dtu": "mean_sea_surface_dt"},
    "s6A": {
        "iono_corr_gim_c": "iono_cor_gim", "mean_sea_surface": "mean_sea_surface_sol1", "mean_sea_surface_dtu": "mean_sea_surface_sol2", "ocean_tide_got": "ocean_tide_sol1",
        "ocean_tide_fes": "ocean_tide_sol2", "load_tide_got": "ocean_tide_sol1", "load_tide_fes": "ocean_tide_sol2",
    },
}
VERSION_3_MISSION["s6Ah"] = {c: n for c, n in VERSION_3_MISSION["s6A"].items() if c != "iono_corr_gim_c"}
#: Version 3, beginnings of names in the Ku-band group, by mission; names of the C-band group end in _c as canonical ones.
KU_GROUP = {
    "j3": ("range_", "swh_", "sig0_", "iono_cor_", "sea_state_bias", "off_nadir_angle_wf_", "wvf_main_class", "ssha"),
    "s6A": ("range_", "swh_", "sig0_", "iono_cor_gim", "sea_state_bias", "off_nadir_angle_wf_", "ocean_geo_corrections", "ssha"),
}
KU_GROUP["s6Ah"] = KU_GROUP["s6A"]

# Version 4, names that do not follow its rule.
VERSION_4 = {
    "swh_ku": "swh_ocean_01_ku", "swh_c": "swh_ocean_01_c", "sig0_ku": "sig0_ocean_01_ku", "sig0_c": "sig0_ocean_01_c", "range_ku": "range_ocean_01_ku", "range_c": "range_ocean_01_c",
    "wind_speed_alt": "wind_speed_alt_01_ku", "off_nadir_angle_wf_ku": "corrected_off_nadir_angle_wf_ocean_01_plrm_ku", "off_nadir_angle_wf_ku_sar": "corrected_off_nadir_angle_wf_ocean_01_ku",
    "off_nadir_angle_wf_rms_ku": "off_nadir_angle_rms_01_ku", "sea_state_bias_ku": "sea_state_bias_01_ku", "sea_state_bias_c": "sea_state_bias_01_c", "ssha": "ssha_01_ku",
    "rad_wet_tropo_corr": "rad_wet_tropo_cor_01_ku", "model_dry_tropo_corr": "mod_dry_tropo_cor_zero_altitude_01", "model_wet_tropo_corr": "mod_wet_tropo_cor_zero_altitude_01",
    "iono_corr_gim_ku": "iono_cor_gim_01_ku", "iono_corr_alt_ku": "iono_cor_alt_01_ku", "ocean_tide_got": "ocean_tide_sol1_01", "ocean_tide_fes": "ocean_tide_sol2_01",
    "load_tide_got": "load_tide_sol1_01", "load_tide_fes": "load_tide_sol2_01", "mean_sea_surface": "mean_sea_surf_sol1_01", "mean_sea_surface_dtu": "mean_sea_surf_sol2_01",
    "range_numval_ku": "range_ocean_numval_01_ku", "range_numval_c": "range_ocean_numval_01_c", "range_rms_ku": "range_ocean_rms_01_ku", "range_rms_c": "range_ocean_rms_01_c",
    "sig0_rms_ku": "sig0_ocean_rms_01_ku", "sig0_rms_c": "sig0_ocean_rms_01_c", "swh_rms_ku": "swh_ocean_rms_01_ku", "swh_rms_c": "swh_ocean_rms_01_c",
    "surface_classification_flag": "surf_type_01", "ice_flag": "open_sea_ice_flag_01_ku", "rain_flag": "rain_flag_01_ku", "inv_bar_corr": "inv_bar_cor_01", "hf_fluctuations_corr": "hf_fluct_cor_01",
    "mean_dynamic_topography": "geoid_01", "bathymetry": "odle_01", "climato_use_flag_ku": "climato_use_flag_01_ku", "rad_distance_to_land": "dist_coast_01",
}
# Version 4, canonical names that only take _01 behind them.
VERSION_4_SAME = (
    "time", "lat", "lon", "alt", "pole_tide", "solid_earth_tide", "ocean_tide_non_eq", "rad_surf_type", "instr_op_mode", "surf_class", "rad_along_track_avg_flag", "geoid",
    "UTC_day", "off_nadir_roll_angle_pf", "off_nadir_pitch_angle_pf", "off_nadir_yaw_angle_pf",
)
# Version 4, columns that also come from the low-resolution mode; their names have _plrm before _ku.
VERSION_4_PLRM = (
    "swh_ku", "sig0_ku", "wind_speed_alt", "range_ku", "sea_state_bias_ku", "ssha", "rad_wet_tropo_corr", "range_numval_ku", "range_rms_ku", "sig0_rms_ku", "swh_rms_ku", "ice_flag", "rain_flag",
    "iono_corr_alt_ku", "off_nadir_angle_wf_rms_ku",
)

# Names of version 5.
VERSION_5 = {
    "alt": "alt_gdrf", "off_nadir_angle_wf_ku": "off_nadir_angle2_wf_ku", "sea_state_bias_ku": "ssb_cls", "sea_state_bias_c": "ssb_cls_c", "rad_wet_tropo_corr": "wet_tropo_rad",
    "model_dry_tropo_corr": "dry_tropo_ecmwf", "pole_tide": "tide_pole", "solid_earth_tide": "tide_solid", "ocean_tide_got": "tide_ocean_got410", "ocean_tide_fes": "tide_ocean_fes14",
    "load_tide_got": "tide_load_got410", "load_tide_fes": "tide_load_fes14", "ocean_tide_non_eq": "tide_non_equil", "mean_sea_surface": "mss_cnescls15", "mean_sea_surface_dtu": "mss_dtu18",
    "range_numval_ku": "range_numval", "surface_classification_flag": "surface_class", "ice_flag": "qual_alt_rain_ice", "rain_flag": "qual_rad1_rain_ice", "rad_surf_type": "surface_type_rad1",
    "dac": "inv_bar_mog2d", "inv_bar_corr": "inv_bar_mog2d", "iono_corr_alt_ku": "iono_alt", "model_wet_tropo_corr": "wet_tropo_ecmwf", "mean_dynamic_topography": "geoid_egm2008", "geoid": "geoid_egm2008",
    "bathymetry": "topo_dtu10", "off_nadir_angle_wf_rms_ku": "off_nadir_angle2_wf_rms_ku", "rad_distance_to_land": "dist_coast", "iono_corr_alt_ku_mle3": "iono_alt_mle3",
}


def _measures(mission: str, retracker: str) -> dict[str, str]:
    """Version 3: what the retracker measures, and what follows from it."""
    out = {}
    first = ["ku"] + (["c"] if retracker == "ocean" and mission != "s6Ah" else [])
    for band in first:
        out |= {f"{m}_{band}": f"{m}_{retracker}" for m in ("swh", "sig0", "range")}
        out |= {f"{m}_rms_{band}": f"{m}_{retracker}_rms" for m in ("swh", "sig0", "range")} | {f"range_numval_{band}": f"range_{retracker}_numval"}
    if mission != "s6Ah":
        out |= {"off_nadir_angle_wf_ku": f"off_nadir_angle_wf_{retracker}", "off_nadir_angle_wf_rms_ku": f"off_nadir_angle_wf_{retracker}_rms"}
    if retracker == "ocean":
        out |= {f"sea_state_bias_{band}": "sea_state_bias" for band in first} | {"iono_corr_alt_ku": "iono_cor_alt_filtered"}
        if mission == "s6Ah":
            out["iono_corr_alt_ku_notsmooth"] = "iono_cor_alt"
        else:
            out |= {f"{m}_ku_mle3": f"{m}_ocean_mle3" for m in ("swh", "sig0", "range")} | {f"{m}_rms_ku_mle3": f"{m}_ocean_mle3_rms" for m in ("swh", "sig0", "range")}
            out |= {"range_numval_ku_mle3": "range_ocean_mle3_numval", "iono_corr_alt_ku_mle3": "iono_cor_alt_filtered_mle3"}
    elif mission == "j3":
        out |= {"wind_speed_alt": "wind_speed_alt_adaptive", "sea_state_bias_ku": "sea_state_bias_adaptive", "sea_state_bias_c": "sea_state_bias_adaptive", "iono_corr_alt_ku": "iono_cor_alt_filtered_adaptive"}
    if retracker == "adaptive" and mission != "j3":  # these come with the ocean retracker only
        for c in ("range_rms_ku", "range_numval_ku"):
            out.pop(c)
    return out


def names(version: int, mission: str = "j2", retracker: str = "ocean") -> dict[str, str]:
    """Canonical names and those of the product, where they differ."""
    if version not in VERSIONS:
        raise ValueError(f"no product of format version {version}")
    if retracker not in RETRACKERS:
        raise ValueError(f"no retracker {retracker!r}")
    if version == 1:
        return dict(VERSION_1)
    if version in (0, 2):
        return dict(VERSION_2)
    if version == 5:
        return dict(VERSION_5)
    if version == 4:
        plain = VERSION_4 | {c: f"{c}_01" for c in VERSION_4_SAME}
        return plain | {f"{c}_plrm": plain[c].replace("_01_ku", "_01_plrm_ku") for c in VERSION_4_PLRM}
    if mission not in VERSION_3_MISSION:
        raise ValueError(f"no product of format version 3 for mission {mission!r}")
    return VERSION_3 | VERSION_3_MISSION[mission] | _measures(mission, retracker)


def group(name: str, leaf: str, mission: str) -> str | None:
    """Version 3: the group of a column, by its canonical name and its name in the product; None for the band-independent one."""
    if not leaf.startswith(KU_GROUP[mission]) or leaf.endswith("_source"):
        return None
    return "c" if name.endswith("_c") else "ku"
