"""Static limits, flags, and envelopes that depend on wave height."""

from __future__ import annotations

# Inclusive limits of product columns.
PRODUCT = {
    "swh_ku": (0.0, 20.0), "sig0_ku": (0.0, 40.0), "wind_speed_alt": (0.0, 30.0), "off_nadir_angle_wf_ku": (-0.20, 0.64),
    "rad_wet_tropo_corr": (-0.5, -0.001), "model_dry_tropo_corr": (-2.5, -1.9), "iono_corr_gim_ku": (-0.4, 0.04), "pole_tide": (-0.15, 0.15),
    "solid_earth_tide": (-1.0, 1.0), "ocean_tide_fes": (-5.0, 5.0), "ocean_tide_got": (-5.0, 5.0), "load_tide_fes": (-0.5, 0.5), "load_tide_got": (-0.5, 0.5),
    "dac": (-2.0, 2.0), "inv_bar_corr": (-0.4, 0.6), "range_numval_ku": (10.0, 21.5), "range_rms_ku": (0.0, 0.25), "range_rms_c": (0.0, 0.5),
    "sig0_rms_ku": (0.0, 1.0), "swh_rms_ku": (0.0, 1.5), "swh_rms_c": (0.0, 3.0),
}
#: Changes by format version and mission.
PRODUCT_BY = {("version", 4): {"sig0_rms_ku": (0.0, 5.0)}, ("mission", "s6A"): {"swh_rms_c": (0.0, 5.0), "range_rms_c": (0.0, 0.7)}}
#: Height of the satellite above the measured surface.
ORBIT_MINUS_RANGE = (-130.0, 100.0)
FLAGS = {
    "default": {},
    "s6A": {"surface_classification_flag": 0, "rad_surf_type": 0, "rad_sea_ice_flag": 0, "rad_rain_flag": 0, "rain_flag": 0},
    "s3": {"instr_op_mode": 1, "surf_class": 0, "rad_along_track_avg_flag": 0},
}
#: What a quality flag must be, by the first of its meanings that is known, or by its name.
FLAG_MEANINGS = (("bad", 0), ("four_points", 4), ("Bad", 0), ("Invalid", 0))
FLAG_NAMES = {"iono_cor_alt_filtered_qual": 0, "orb_state_flag_rest": 3, "manoeuvre_flag": 0}

# Inclusive limits of track files.
TRACK = {
    "lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "wind_speed_alt": (-1.0, 30.0), "wind_speed_rad": (0.0, 30.0), "swh_ku": (0.0, 20.0), "swh_rms_ku": (0.0, 2.0),
    "sig0_ku": (0.0, 40.0), "sig0_rms_ku": (0.0, 1.5), "range_numval": (10.0, 21.5), "range_numval_c": (10.0, 21.5), "range_rms_ku": (0.0, 0.25), "range_rms_c": (0.0, 0.5),
    "wet_tropo_rad": (-0.6, 0.0), "dry_tropo_ecmwf": (-2.5, -1.9), "iono_gim": (-0.4, 0.04), "tide_pole": (-0.15, 0.15), "tide_internal": (-0.2, 0.2),
    "tide_ocean_fes14": (-5.0, 5.0), "tide_ocean_got410": (-5.0, 5.0), "tide_load_fes14": (-0.5, 0.5), "tide_load_got410": (-0.5, 0.5), "tide_solid": (-1.0, 1.0),
    "inv_bar_static": (-2.0, 2.0), "inv_bar_mog2d": (-2.0, 2.0), "topo_srtm30plus": (-200000.0, -300.0),
}
TRACK_SWOT = {"range_ku": (800e3, 900e3), "range_c": (800e3, 900e3), "off_nadir_angle2_wf_ku": (-0.15, 0.15)}
TRACK_OTHER = {"range_ku": (1300e3, 1400e3), "range_c": (1300e3, 1400e3), "off_nadir_angle2_wf_ku": (-0.20, 0.64)}
TRACK_FLAGS = ("surface_class", "surface_type_rad", "flag_manoeuvre", "qual_alt_rain_ice", "qual_attitude")
TRACK_FLAGS_SWOT = ("surface_class", "surface_type_rad1", "surface_type_rad2", "flag_manoeuvre", "qual_alt_rain_ice", "qual_rad1_rain_ice", "qual_rad2_rain_ice", "qual_attitude")
#: Ka-band track files.
TRACK_KA = {"swh_ka": (-1.0, 20.0), "ssha_ka": (-2.0, 2.0), "dist_coast": (-50.0, 50.0)}

# Level-2 limits; open ocean or coast as distance to land in [low, high) and depth, then open intervals.
OCEAN = {"distance": (50e3, 6000e3), "depth": (-400000.0, -300.0)}
COAST = {"distance": (0.0, 30e3), "depth": (-400000.0, 0.0)}
USLA, SWH, WET_DIFFERENCE = (-1.5, 1.5), (0.0, 12.5), (-0.075, 0.065)
#: Inclusive limits that the three-parameter retracker's columns need on top.
MLE3 = {"range_numval_ku_mle3": (10.0, 21.5), "sig0_ku_mle3": (0.0, 40.0), "wind_speed_alt": (0.0, 30.0), "orbit_minus_range": (-130.0, 100.0)}


def _poly(low: tuple, high: tuple = (), limit: float | None = None) -> dict:
    return {"low": low, "high": high, "limit": limit, "exponential": False}


def _expo(c0: float, c1: float, c2: float) -> dict:
    return {"low": (c0, c1, c2), "high": (), "limit": None, "exponential": True}


# Upper envelopes by mission and variable; polynomials in wave height, one up to `limit` and one above it, or
# c0 + c1 * exp(-swh / c2).
ENVELOPES: dict[str, dict[str, dict]] = {
    "tx": {
        "swh_rms_ku": _poly((5.3088e-01, -1.1410e-02, 7.2900e-03, -5.2000e-04, 4.0000e-05)),
        "swh_rms_c": _poly((8.8760e-01, -2.0056e-01, 6.8700e-02, -8.4500e-03, 3.9000e-04)),
        "swh_rms_ku_mle3": _poly((5.7088e-01, -1.1410e-02, 7.2900e-03, -5.2000e-04, 4.0000e-05)),
        "range_rms_ku": _poly((8.097e-02, -1.799e-02, 6.350e-03, -5.700e-04, 2.000e-05)),
        "range_rms_c": _poly((1.7882e-01, -3.6930e-02, 1.3100e-02, -1.1400e-03, 3.0000e-05)),
        "range_rms_ku_mle3": _poly((0.08453, -0.01543, 0.00382, -0.00019)),
        "sig0_rms_ku": _expo(0.24, 0.40, 1.20),
        "sig0_rms_c": _expo(0.15, 0.24, 1.20),
        "sig0_rms_ku_mle3": _poly((0.30962, -0.0697, 0.00995, -0.00046)),
        "off_nadir_angle_wf_ku": _expo(0.032, 0.055, 1.20),
    },
    "j2": {
        "swh_rms_ku": _poly((0.75064, -0.23178, 1.06577, -0.87798, 0.205), (0.79364, -0.03835, 0.01915, -0.00094), 2.0),
        "swh_rms_c": _poly((2.26537, 0.08134, -0.25133, 0.09481), (1.92622, 9.01900e-02, 1.35300e-02, -9.40000e-04), 2.0),
        "swh_rms_ku_mle3": _poly((0.75064, -0.23178, 1.06577, -0.87798, 0.205), (0.8764, -0.04835, 0.01915, -0.00094), 1.6),
        "range_rms_ku": _poly((0.10381, -0.01169, 0.01916, -0.00464), (0.07817, 0.02154, -0.00039), 2.0),
        "range_rms_c": _poly((0.25451, -0.03105, 0.02586, -0.00258), (2.1012e-01, 3.0080e-02, 2.1800e-03, -1.9000e-04), 2.0),
        "range_rms_ku_mle3": _poly((0.10048, 0.01003)),
        "sig0_rms_ku": _poly((0.81588, -0.07736, -0.03154, 0.01029), (0.59713, 7.0100e-03, -4.3000e-04), 2.0),
        "sig0_rms_c": _poly((0.38314, -0.11539, 0.02197), (0.25751, -0.01255, 0.00091), 2.0),
        "sig0_rms_ku_mle3": _poly((0.32225, -0.08348), (0.27623, -0.06426, 0.00861, -0.00039), 1.5),
        "off_nadir_angle_wf_ku": _poly((0.1354, -0.00828, -0.02823, 0.007), (0.06069, -0.00047, 0.0001), 2.0),
    },
    "s3": {
        "swh_rms_ku": _poly((0.32144, 1.11207, -0.77325, 0.15379), (1.00385, -0.31216, 0.08247, -0.00477), 2.5),
        "swh_rms_c": _poly((2.26109, 1.26050e-01, -2.15300e-02, 9.60000e-04)),
        "range_rms_ku": _poly((0.07881, -0.00261, 0.00391, -0.0002)),
        "range_rms_c": _poly((3.6659e-01, -1.7370e-02, 1.5170e-02, -1.9200e-03, 6.0000e-05)),
        "sig0_rms_ku": _expo(0.2, 0.67, 1.3),
        "sig0_rms_c": _expo(0.3, 0.35, 0.8),
        "off_nadir_angle_wf_ku": _expo(0.03, 0.08, 1.1),
    },
    "s6A": {
        "swh_rms_ku": _poly((0.9671, 0.29698, -0.61399, 0.20052), (6.9235e-01, 3.7000e-03, 1.7400e-03, 2.1000e-04), 2.0),
        "swh_rms_c": _poly((4.56473832, -1.37666413, 0.29649385, 0.05553079), (2.73989977, 3.35650485e-01, 3.48903840e-04, -8.12514739e-04), 2.0),
        "range_rms_ku": _poly((0.08213806, 0.01275537, -0.00015146)),
        "range_rms_c": _poly((0.51401327, -0.23079258, 0.14166817, -0.02424609), (3.03583512e-01, 6.18299699e-02, 5.69544505e-04, -1.87019304e-04), 2.0),
        "sig0_rms_ku": _expo(0.45, 0.5, 1.1),
        "sig0_rms_c": _expo(0.235, 0.22, 0.5),
        "off_nadir_angle_wf_ku": _poly((0.21421493, -0.1200238, 0.03750654, -0.00457986), (0.0797591, -0.00027225), 2.0),
    },
    "s6Ah": {
        "swh_rms_ku": _poly((0.34926939, 0.65375903, -0.62462621, 0.16648158), (0.29143505, 0.0829824, 0.00285974), 2.0),
        "range_rms_ku": _poly((0.05087238, 0.00930197, 0.00087736)),
        "sig0_rms_ku": _expo(0.18, 0.75, 1.2),
    },
    "sw": {
        "swh_rms_ku": _poly((0.63, 0.356, -0.132), (0.777, 0.003, 0.007), 1.75),
        "swh_rms_c": _poly((1.957, 0.617, -0.266), (2.161, 0.043, 0.009), 1.5),
        "range_rms_ku": _poly((0.083, 0.018, 0.0)),
        "range_rms_c": _poly((0.2027, 0.0426, -0.0009)),
        "sig0_rms_ku": _expo(0.32, 0.5, 1.7),
        "sig0_rms_c": _expo(0.21, 0.3, 1.65),
        "off_nadir_angle_wf_ku": _expo(0.24, 0.12, 1.0),
    },
    "sa": {"swh_rms_ku": _poly((0.4203, 0.0483, 0.0024)), "range_rms_ku": _poly((0.0445, 0.0217, -0.0001))},
}
ENVELOPES["j1"] = ENVELOPES["j2"] | {"sig0_rms_c": _expo(0.245, 0.22, 0.7)}
ENVELOPES["j3"] = ENVELOPES["j2"] | {"swh_rms_c": _poly((2.29537, 0.08134, -0.25133, 0.09481), (1.97622, 9.01900e-02, 1.35300e-02, -9.40000e-04), 2.0)}
#: Low-resolution mode of s3.
ENVELOPES["s3/plrm"] = ENVELOPES["s3"] | {"swh_rms_ku": _poly((0.92804, 0.21314, -0.02314, -0.01067), (1.07305, 0.02612), 2.5), "range_rms_ku": _poly((0.14424, 0.01546)), "sig0_rms_ku": _expo(0.3, 0.55, 1.6)}
#: Lower envelopes of the off-nadir angle.
LOWER: dict[str, dict] = {
    "tx": _expo(-0.027, -0.055, 1.20),
    "j2": _poly((-0.1354, 0.00828, 0.02823, -0.007), (-0.06069, 0.00047, -0.0001), 2.0),
    "s3": _expo(-0.044, -0.08, 1.1),
    "s6A": _poly((-0.12843386, 0.06553327, -0.03882656, 0.01120318), (-0.05439435, 0.00018005), 2.0),
    "sw": _expo(0.045, -0.08, 1.0),
}
LOWER |= {"j1": LOWER["j2"], "j3": LOWER["j2"], "s3/plrm": LOWER["s3"]}
#: Least wave-height RMS that counts as measured.
LEAST_SWH_RMS = 0.05
