"""Row filters as predicates that the scan can take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import limits
from ..sources.missions import BAD_CYCLES, SPECS


def measured(df: DataFrame) -> DataFrame:
    """NaN as NULL in all floating columns, once, at the edge."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def every(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def within(bounds: dict[str, tuple[float, float]], columns: list[str]) -> Column:
    """All columns that have bounds lie in them, ends included (NULL does not)."""
    return every([F.col(c).between(F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items() if c in columns])


def flags_are(wanted: dict[str, int], columns: list[str] | None = None) -> Column:
    return every([F.col(c) == v for c, v in wanted.items() if columns is None or c in columns])


def flag_value(name: str, meanings: str = "") -> int | None:
    """The value that a quality flag must have."""
    return next((v for word, v in limits.FLAG_MEANINGS if word in meanings.split()), limits.FLAG_NAMES.get(name))


def product_limits(mission: str, version: int = 0) -> dict[str, tuple[float, float]]:
    return limits.PRODUCT | limits.PRODUCT_BY.get(("version", version), {}) | limits.PRODUCT_BY.get(("mission", mission), {})


def level0(df: DataFrame, mission: str, version: int = 0, quality: dict[str, int] | None = None) -> DataFrame:
    """Product records within all limits, with good flags, at a plausible height."""
    lo, hi = limits.ORBIT_MINUS_RANGE
    flags = limits.FLAGS.get(mission, {}) | (quality or {})
    return df.where(within(product_limits(mission, version), df.columns) & flags_are(flags, df.columns) & (F.col("alt") - F.col("range_ku")).between(lo, hi))


def level1(df: DataFrame, mission: str) -> DataFrame:
    """Records with heights in both bands, below the turning latitude."""
    bands = [F.col(c).isNotNull() for c in ("usla_ku", "usla_c") if c in df.columns]
    return df.where(every(bands) & (F.abs("lat") < SPECS[mission]["inclination"]))


def near_in_time(seconds_a: str, seconds_b: str, days: float = 10.0) -> Column:
    return F.abs(F.col(seconds_a) - F.col(seconds_b)) / 86400.0 < days


def envelope(swh: Column, form: dict) -> Column:
    """An envelope's value at a wave height."""

    def value(c: tuple) -> Column:
        if form["exponential"]:
            return F.lit(c[0]) + F.lit(c[1]) * F.exp(-swh / F.lit(c[2]))
        return reduce(lambda acc, x: acc * swh + F.lit(x), reversed(c[:-1]), F.lit(c[-1]))  # Horner

    low = value(form["low"])
    return F.when(swh <= form["limit"], low).otherwise(value(form["high"])) if form["high"] else low


def within_envelope(value: Column, swh: Column, variable: str, mission: str, mode: str = "") -> Column:
    """value is at most its envelope; wave-height RMS also at least 0.05, off-nadir also above the lower envelope.

    A mission without the variable's envelope keeps everything.
    """
    key = f"{mission}/{mode}" if f"{mission}/{mode}" in limits.ENVELOPES else mission
    form = limits.ENVELOPES[key].get(variable)
    if form is None:
        return F.lit(True)
    sound = value.isNotNull() & ~F.isnan(value)
    kept = sound & (envelope(swh, form) - value >= 0)
    if "swh" in variable:
        kept &= value >= limits.LEAST_SWH_RMS
    if variable.startswith("off_nadir") and key in limits.LOWER:
        kept &= envelope(swh, limits.LOWER[key]) - value <= 0
    return kept


def level2(columns: list[str], mission: str, *, open_ocean: bool = True, prefix: str = "", mode: str = "", mle3: bool = False) -> Column:
    """Geophysical limits and envelopes; with `prefix` ("a.", "b.") on one side of a pair. Columns that are absent are not asked."""
    has = set(columns)
    col = lambda c: F.col(f"{prefix}{c}")
    area = limits.OCEAN if open_ocean else limits.COAST
    ku = "_mle3" if mle3 else ""
    out = []
    if "rad_distance_to_land" in has and mission != "sw":
        lo, hi = area["distance"]
        out.append((col("rad_distance_to_land") >= lo) & (col("rad_distance_to_land") < hi))
    if "bathymetry" in has:
        out.append(col("bathymetry").between(*area["depth"]))
    if "usla_ku" in has:
        out.append((col("usla_ku") > limits.USLA[0]) & (col("usla_ku") < limits.USLA[1]))
    out += [(col(c) > limits.SWH[0]) & (col(c) < limits.SWH[1]) for c in (f"swh_ku{ku}", "swh_c") if c in has]
    if "rad_surf_type" in has:
        out.append(col("rad_surf_type") == 0)
    if {"rad_wet_tropo_corr", "model_wet_tropo_corr"} <= has:
        d = col("rad_wet_tropo_corr") - col("model_wet_tropo_corr")
        out.append((d > limits.WET_DIFFERENCE[0]) & (d < limits.WET_DIFFERENCE[1]))
    for v in ("swh_rms", "sig0_rms", "range_rms"):
        out += [within_envelope(col(c), col(s), c, mission, mode) for c, s in ((f"{v}_ku{ku}", f"swh_ku{ku}"), (f"{v}_c", "swh_c")) if {c, s} <= has]
    if mission == "sw" and "off_nadir_angle_wf_ku" in has:
        out.append(within_envelope(col("off_nadir_angle_wf_ku"), col("swh_ku"), "off_nadir_angle_wf_ku", mission))
    if mle3:
        bounds = {c: b for c, b in limits.MLE3.items() if c in has}
        out += [col(c).between(*b) for c, b in bounds.items()]
        if {"alt", "range_ku"} <= has:
            out.append((col("alt") - col("range_ku")).between(*limits.MLE3["orbit_minus_range"]))
    return every(out)


def track_limits(mission: str) -> dict[str, tuple[float, float]]:
    return limits.TRACK | (limits.TRACK_SWOT if mission == "sw" else limits.TRACK_OTHER)


def track_flags(mission: str) -> dict[str, int]:
    return dict.fromkeys(limits.TRACK_FLAGS_SWOT if mission == "sw" else limits.TRACK_FLAGS, 0)


def without_bad_cycles(df: DataFrame, mission: str, *, collinear: bool = False) -> DataFrame:
    """Rows of cycles that the product provides; collinear pairs also need the cycle after."""
    bad = set(BAD_CYCLES.get(mission, ()))
    if collinear:
        bad |= {c - 1 for c in bad}
    return df.where(~F.col("cycle").isin(sorted(bad))) if bad else df


def region(value: Column, lat: Column, name: str) -> Column:
    """value in a region, NULL elsewhere."""
    inside = {"SO": lat <= -40, "hemi_south": lat <= 0, "hemi_north": lat >= 0}[name]
    return F.when(inside, value)


def aligned(value: Column, seconds_a: Column, seconds_b: Column, most: float = 90.0) -> Column:
    """value where both sides of a tandem pair are close in time, NULL elsewhere."""
    return F.when(F.abs(seconds_a - seconds_b) <= most, value)
