"""Scalar formulas of the altimeter: wind speed, backscatter, ionosphere, weights, noise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.missions import SPECS

# Radar frequencies in hertz.
KU_HZ, C_HZ = 13.575e9, 5.3e9
KU_TO_C = (KU_HZ / C_HZ) ** 2
#: Metres of Ku-band delay of one TEC unit.
TEC_TO_METRES = -0.01216

# The published two-neuron wind speed network and the backscatter offsets that align missions with it.
WIND_SIG0 = (0.0806452, -0.6322581)
WIND_SWH = (0.0683395, 0.0991799)
WIND_FIRST = ((58.76821, 22.08226, -33.61161), (3.05118, 0.18608, 1.06796))
WIND_SECOND = (-0.20367, -22.35999, 20.10259)
WIND_OUT = (0.0321528, 0.0869731)
SIG0_BIAS = {"j1": 0.0, "j2": 0.32, "j3": 0.14, "tx": 2.69}

# Backscatter alignment with product data, (scale of squared off-nadir angle, bias) by mission and band.
SIG0_ALIGN = {("j1", "ku"): (0.0, 0.0), ("j1", "c"): (0.0, 0.0), ("j2", "ku"): (11.34, -2.40), ("j2", "c"): (2.01, -0.73), ("j3", "ku"): (11.34, -2.40), ("j3", "c"): (2.01, -0.73)}


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def wind_speed(sig0: Column, swh: Column, mission: str) -> Column:
    """Wind speed in m/s from backscatter and wave height; NULL where an input is."""
    if mission not in SIG0_BIAS:
        raise ValueError(f"no backscatter bias for mission {mission!r}")
    p1 = F.lit(WIND_SIG0[0]) * (sig0 + F.lit(SIG0_BIAS[mission])) + F.lit(WIND_SIG0[1])
    p2 = F.lit(WIND_SWH[0]) * swh + F.lit(WIND_SWH[1])
    hidden = [_logistic(F.lit(a) * p1 + F.lit(b) * p2 + F.lit(c)) for a, b, c in WIND_FIRST]
    out = _logistic(F.lit(WIND_SECOND[0]) * hidden[0] + F.lit(WIND_SECOND[1]) * hidden[1] + F.lit(WIND_SECOND[2]))
    return (out - F.lit(WIND_OUT[1])) / F.lit(WIND_OUT[0])


def aligned_sig0(sig0: Column, psi2: Column, mission: str, band: str) -> Column:
    scale, bias = SIG0_ALIGN[mission, band]
    return sig0 - F.lit(bias) + F.lit(scale) * psi2


def dual_frequency_iono(range_ku: Column, range_c: Column, ssb_ku: Column, ssb_c: Column, offset: float = 0.0, band: str = "ku") -> Column:
    """Ionospheric delay from the two bands' ranges, each with its sea state bias."""
    k = (C_HZ**2 if band == "ku" else KU_HZ**2) / (KU_HZ**2 - C_HZ**2)
    return F.lit(k) * ((range_ku + ssb_ku) - (range_c + ssb_c) + F.lit(offset))


def tec_units(iono_ku: Column) -> Column:
    """TEC units of a Ku-band delay in metres."""
    return iono_ku * F.lit(KU_HZ**2 / -40.3 / 1e16)


def iono_for_usla(gim: Column, dual: Column, mission: str, cycle: Column) -> Column:
    """The Ku-band delay that uncorrected heights take: the map's, but two-frequency for early cycles of tx."""
    return F.when(cycle < 48, dual).otherwise(gim) if mission == "tx" else gim


def uncorrected_heights(ssha: Column, ssb: Column, iono_alt: Column, range_ku: Column, range_c: Column, iono: Column, mission: str) -> tuple[Column, Column]:
    """Sea level anomalies of both bands without sea state bias."""
    free = ssha + ssb + iono_alt + range_ku
    second = range_ku if mission == "s6Ah" else range_c
    return free - range_ku - iono, free - second - F.lit(KU_TO_C) * iono


def _crossing_angle(lat: Column, mission: str) -> Column:
    spec = SPECS[mission]
    inclination, turn, speed = math.radians(spec["inclination"]), spec["earth_speed"], spec["ground_speed"]
    ratio = F.abs(F.lit(math.cos(inclination)) / F.cos(F.radians(lat)))
    alpha = F.asin(F.when(ratio <= 1, ratio))  # NULL beyond the turning latitude
    sign = 1.0 if spec["inclination"] > 90 else -1.0
    gamma = F.abs((F.lit(speed) * F.sin(alpha) + F.lit(sign * turn) * F.cos(F.radians(lat))) / (F.lit(speed) * F.cos(alpha)))
    return F.lit(math.pi / 2) - F.atan(gamma)


def latitude_weight(lat: Column, mission: str) -> Column:
    """Density of ground tracks by latitude, 1 at the equator; NULL beyond the inclination."""
    return F.sin(_crossing_angle(lat, mission)) / F.sin(_crossing_angle(F.lit(0.0), mission))


def time_weight(days: Column) -> Column:
    return F.exp(-F.abs(days) / 3.0)


def pair_weight(days: Column) -> Column:
    """Weight of a crossover difference by the days between its sides."""
    return F.lit(230.0) * time_weight(days) + F.lit(120.0)


def bm3(swh: Column, wind: Column) -> Column:
    """A known three-parameter bias, to check that a fit recovers it."""
    return swh * (F.lit(0.0036) - F.lit(0.0045) * wind + F.lit(0.00019) * wind * wind)


def hash_normal(row_id: Column, seed: int = 1) -> Column:
    """A standard normal number that depends on the row's id alone, so any partitioning gives the same noise."""
    m = 2147483647
    u = [F.pmod(F.pmod(row_id + F.lit(seed * 7919 + k), F.lit(m)) * F.lit(a), F.lit(m)) for k, a in ((1, 742938285), (2, 950706376))]
    u1, u2 = ((x + F.lit(0.5)) / F.lit(float(m)) for x in u)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def noise(row_id: Column, rms: Column, seed: int = 1) -> Column:
    """Noise of the given RMS; none where the RMS is not positive."""
    return F.when(rms > 0, rms * hash_normal(row_id, seed)).otherwise(F.when(rms.isNotNull(), F.lit(0.0)))
