"""Dependent variables, independent variables, and perturbations by name.

A registry maps each name to columns; new ones are added with `register`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.missions import TANDEM
from .physics import KU_TO_C, aligned_sig0, bm3, noise, wind_speed

__all__ = ["VARIABLES", "Row", "aligned_sig0", "dependent", "independent", "register"]

#: What a row's side is called: a function from a column name to the column.
Row = Callable[[str], Column]

CORRECTIONS = ("model_dry_tropo_corr", "rad_wet_tropo_corr", "solid_earth_tide", "ocean_tide_fes", "pole_tide")
TANDEM_LIMIT = 90.0


def _usla(r: Row, band: str) -> Column:
    return r(f"usla_{band}")


def _scale(band: str) -> Column:
    return F.lit(1.0 if band == "ku" else KU_TO_C)


def _height(r: Row, mission: str) -> Column:
    """Height less range and corrections, without bias, ionosphere and mean surface."""
    out = r("alt") - r("range_ku")
    for c in CORRECTIONS:
        out = out - r(c)
    extra = ("inv_bar_corr", "hf_fluctuations_corr") if mission in ("j1", "j2") else ("internal_tide", "dac", "ocean_tide_non_eq")
    for c in extra:
        out = out - r(c)
    return out


VARIABLES: dict[str, Callable[[Row, str, str], Column]] = {
    "usla": lambda r, b, m: _usla(r, b),
    "bm3": lambda r, b, m: bm3(r("swh_ku"), r("wind_speed_alt")),
    "ib_corr": lambda r, b, m: _usla(r, b) + r("hf_fluctuations_corr"),
    "alt_cnes": lambda r, b, m: _usla(r, b) + r("alt") - r("alt_cnes"),
    "alt_jpl": lambda r, b, m: _usla(r, b) + r("alt") - r("alt_jpl"),
    "wet_tropo_model": lambda r, b, m: _usla(r, b) + r("rad_wet_tropo_corr") - r("model_wet_tropo_corr"),
    "iono_tran": lambda r, b, m: _usla(r, b) + _scale(b) * (r("iono_corr_gim_ku") - r("iono_corr_alt_ku")),
    "iono_tran_smooth": lambda r, b, m: _usla(r, b) + _scale(b) * (r("iono_corr_gim_ku") - r("iono_corr_alt_ku_smooth")),
    "iono_corr_alt": lambda r, b, m: _usla(r, b) + _scale(b) * r("iono_corr_gim_ku") - r("iono_model"),
    "ocean_fes": lambda r, b, m: _usla(r, b) + r("ocean_tide_got") - r("ocean_tide_fes"),
    "mss_dtu": lambda r, b, m: _usla(r, b) + r("mean_sea_surface") - r("mean_sea_surface_dtu"),
    "mss_cnes15": lambda r, b, m: _usla(r, b) + r("mean_sea_surface") - r("mean_sea_surface_cnes15"),
    "mss": lambda r, b, m: r("mean_sea_surface"),
    "ssb": lambda r, b, m: r(f"sea_state_bias_{b}"),
    "iono": lambda r, b, m: r("iono_corr_alt_ku"),
    "gim": lambda r, b, m: r("iono_corr_gim_ku"),
    "SO": lambda r, b, m: F.when(r("lat") <= -40, _usla(r, b)),
    "hemi_south": lambda r, b, m: F.when(r("lat") <= 0, _usla(r, b)),
    "hemi_north": lambda r, b, m: F.when(r("lat") >= 0, _usla(r, b)),
    # heights with a model's bias and ionosphere (columns ssb_model, iono_model, iono_model_uc)
    "I_tdm": lambda r, b, m: r("iono_model"),
    "I_tdm_uc": lambda r, b, m: r("iono_model_uc"),
    "SSB_tdm": lambda r, b, m: r("ssb_model"),
    "SLA": lambda r, b, m: _height(r, m) - r("ssb_model") - r("iono_model") - r("mean_sea_surface"),
    "SLA_uc": lambda r, b, m: _height(r, m) - r("ssb_model") - r("iono_model_uc") - r("mean_sea_surface"),
    "USLA_tdm": lambda r, b, m: _height(r, m) - r("iono_model") - r("mean_sea_surface"),
    "USLA_tdm_uc": lambda r, b, m: _height(r, m) - r("iono_model_uc") - r("mean_sea_surface"),
    "SSH_tdm": lambda r, b, m: _height(r, m) - r("ssb_model") - r("iono_model"),
    "SSH_tdm_uc": lambda r, b, m: _height(r, m) - r("ssb_model") - r("iono_model_uc"),
    "SLAin": lambda r, b, m: _height(r, m) - r("sea_state_bias_ku") - r("iono_corr_alt_ku_smooth") - r("mean_sea_surface"),
    "SLAin_tdm": lambda r, b, m: _height(r, m) - r("sea_state_bias_ku") - r("iono_corr_alt_ku") - r("mean_sea_surface"),
    "USLAin_tdm": lambda r, b, m: _height(r, m) - r("iono_corr_alt_ku") - r("mean_sea_surface"),
    "ORB_tdm": lambda r, b, m: r("alt") - r("range_ku") - r("ssb_model"),
    "ORBin_tdm": lambda r, b, m: r("alt") - r("range_ku") - r("sea_state_bias_ku"),
    "ORM_tdm": lambda r, b, m: r("alt") - r("range_ku") - r("mean_sea_surface"),
    "ORMB_tdm": lambda r, b, m: r("alt") - r("range_ku") - r("mean_sea_surface") - r("ssb_model"),
    "ORMBin_tdm": lambda r, b, m: r("alt") - r("range_ku") - r("mean_sea_surface") - r("sea_state_bias_ku"),
}
VARIABLES |= {"SLA_tdm": VARIABLES["SLA"], "SLA_tdm_uc": VARIABLES["SLA_uc"], "ORMin_tdm": VARIABLES["ORM_tdm"]}

#: Partner less own, in a tandem table whose partner columns end in _<mission>.
DIFFERENCES: dict[str, Callable[[Row], Column]] = {
    "dSWH_tdm": lambda r: r("swh_ku"),
    "dWTC_tdm": lambda r: r("rad_wet_tropo_corr"),
    "dORM_tdm": lambda r: r("alt") - r("range_ku") - r("mean_sea_surface"),
    "dISSB_tdm": lambda r: r("iono_corr_alt_ku") + r("sea_state_bias_ku"),
}


# Perturbations by name.
PERTURBATIONS = ("mle3", "plrm", "rms_r", "rms_w", "rms_s", "rms_wr", "rms_rw", "rms_rs", "rms_ws", "rms_rws", "rms_wx", "rms_Ew", "rms_Ewr", "smth_swh", "rng_corr", "sum_err")


def _known(err: str | None) -> None:
    """Refuse perturbations that are neither in the table nor a tandem phase."""
    if err is not None and err not in PERTURBATIONS and err not in TANDEM:
        raise ValueError(f"no perturbation {err!r}")


def partner(mission: str, phase: str) -> str:
    """The other mission of a tandem phase."""
    first, second = TANDEM[phase][:2]
    if mission not in (first, second):
        raise ValueError(f"{mission} has no part in {phase}")
    return second if mission == first else first


def register(name: str, formula: Callable[[Row, str, str], Column]) -> None:
    """Add a dependent variable."""
    VARIABLES[name] = formula


def dependent(name: str, band: str = "ku", mission: str = "j2", *, err: str | None = None, prefix: str = "", partner: str | None = None) -> Column:
    """The dependent variable `name` of a row, or of one side of a pair (prefix "a." or "b."), perturbed by `err`."""
    _known(err)
    row: Row = lambda c: F.col(f"{prefix}{c}")
    if name in DIFFERENCES:
        other: Row = lambda c: F.col(f"{prefix}{c}_{partner}")
        out = DIFFERENCES[name](other) - DIFFERENCES[name](row)
    elif name == "usla" and err == "mle3":
        out = row("usla_ku") + row("range_ku") - row("range_ku_mle3") if band == "ku" else row("usla_c")
    elif name == "usla" and err == "plrm":
        out = row("ssha_plrm") + row("ssb_plrm") if band == "ku" else row("usla_c")
    elif name == "usla" and err in TANDEM and mission == "tx":
        out = row(f"usla_{band}") + row("ocean_tide_sol2") - row("ocean_tide_sol1")
    elif name == "usla" and err in ("rms_r", "rms_wr", "rms_rw", "rms_rs", "rms_rws"):
        out = row(f"usla_{band}") + noise(row("id"), row(f"range_rms_{band}"), 11)
    else:
        out = VARIABLES[name](row, band, mission)
    if partner and name.endswith(("_tdm", "_tdm_uc")):
        out = F.when(F.abs(row("time") - row(f"time_{partner}")) <= TANDEM_LIMIT, out)
    return out


def independent(mission: str = "j2", *, err: str | None = None, second: str = "u10", prefix: str = "") -> tuple[Column, Column]:
    """(wave height, wind speed or backscatter) of a row under a perturbation."""
    _known(err)
    row: Row = lambda c: F.col(f"{prefix}{c}")
    if err in ("mle3", "plrm"):
        return row(f"swh_ku_{err}"), row(f"sig0_ku_{err}" if second == "sig0" else f"wind_speed_alt_{err}")
    swh, sig0 = row("swh_ku"), row("sig0_ku")
    if err in ("rms_w", "rms_rw", "rms_wr", "rms_ws", "rms_rws"):
        swh = swh + noise(row("id"), row("swh_rms_ku"), 3)
    if err in ("rms_s", "rms_rs", "rms_ws", "rms_rws"):
        sig0 = sig0 + noise(row("id"), row("sig0_rms_ku"), 5)
    if err == "smth_swh":
        swh = row("swh_ku_smooth")
    if second == "sig0":
        return swh, sig0
    return swh, row("wind_speed_alt") if err is None or err in TANDEM else wind_speed(sig0, swh, mission)
