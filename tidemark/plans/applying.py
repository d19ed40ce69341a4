"""Models applied to track records: bias, ionosphere and their errors as new columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import evaluate, triangles, windows
from ..operators.grid import Grid
from ..sources import tables
from ..storage import materialize

#: Records along a track beyond which its ionosphere is smoothed, and records of the mean.
LEAST, SIZE = 100, 21


def applied(df: DataFrame, models: dict[str, DataFrame], grid: Grid, *, calibration: float = 0.0, by: tuple[str, ...] = ("cycle", "pass_number"), max_step: float | None = 1.2, gaps: bool = False) -> DataFrame:
    """Track records with the columns that the models give.

    models: nodes (node, value) of `ku` and `c`, and of the deviations `error_ku` and `error_c`. New columns, for b of ku
    (no suffix) and c (_c): ssb_model, with a random error ssb_model_err, the error itself err_ssb_ku and err_ssb_c;
    ssb_cls_err where the product has ssb_cls; iono_model and iono_cls with errors and smoothed (_err, _smooth,
    _smooth_err), iono_cls_total_err with those of the ranges too; err_range_ku and err_range_c. What the product does not
    allow is NULL; with `gaps` models reach across their unknown nodes; without a C-band bias the product's own ionosphere stands for iono_cls. Records without wave heights
    come back as they are.
    """
    if "swh_ku" not in df.columns:
        return df
    own = [F.col(c) for c in df.columns]
    none = F.lit(None).cast("double")
    has = lambda c: F.col(c) if c in df.columns else none
    x, y = F.col("swh_ku"), F.col("wind_speed_alt")
    model = (lambda m: triangles.across_gaps(m, grid, x, y)) if gaps else (lambda m: evaluate.bilinear(evaluate.node_array(m, grid), grid, x, y))
    at = {k: model(m) for k, m in models.items()}
    out = df.select(*own, at["ku"].alias("ssb_model"), at["c"].alias("ssb_model_c"), at["error_ku"].alias("__ku"), at["error_c"].alias("__c"))
    seeds = {"err_ssb_ku": ("__ku", 21), "err_ssb_c": ("__c", 22), "err_range_ku": ("range_rms_ku", 23), "err_range_c": ("range_rms_c", 24)}
    out = out.withColumns({name: physics.noise(F.col("id"), F.col(sigma), seed) if sigma in out.columns else none for name, (sigma, seed) in seeds.items()})
    out = out.withColumns({
        "ssb_model_err": F.col("ssb_model") + F.col("err_ssb_ku"), "ssb_model_c_err": F.col("ssb_model_c") + F.col("err_ssb_c"),
        "ssb_cls_err": has("ssb_cls") + F.col("err_ssb_ku"), "ssb_cls_c_err": has("ssb_cls_c") + F.col("err_ssb_c"),
    }).drop("__ku", "__c")
    rk, rc = F.col("range_ku"), F.col("range_c")
    iono = lambda ku, c, offset=0.0, dk=None, dc=None: physics.dual_frequency_iono(rk if dk is None else rk + F.col(dk), rc if dc is None else rc + F.col(dc), F.col(ku), F.col(c), offset)
    found: dict[str, Column] = {"iono_model": iono("ssb_model", "ssb_model_c", calibration), "iono_model_err": iono("ssb_model_err", "ssb_model_c_err", calibration)}
    if "ssb_cls_c" in df.columns:
        found |= {"iono_cls": iono("ssb_cls", "ssb_cls_c"), "iono_cls_err": iono("ssb_cls_err", "ssb_cls_c_err"), "iono_cls_total_err": iono("ssb_cls_err", "ssb_cls_c_err", 0.0, "err_range_ku", "err_range_c")}
    else:
        product = F.coalesce(has("iono_doris"), has("iono_alt"))
        found |= dict.fromkeys(("iono_cls", "iono_cls_err", "iono_cls_total_err"), product)
    out = out.withColumns(found)
    names = {c: c.replace("_cls_total_err", "_cls_smooth_total_err") if "total" in c else f"{c.removesuffix('_err')}_smooth{'_err' if c.endswith('_err') else ''}" for c in found}
    many = {f"__many_{c}": F.count(c) > LEAST for c in found}
    keys = {c: f"__track{i}" for i, c in enumerate(by)}
    tracks = materialize(out.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(*[n.alias(k) for k, n in many.items()]), "track-counts")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    out = windows.moving_means(out, names, SIZE, *by, max_step=max_step, coarse=True).join(tracks, same).drop(*keys.values())
    smooth_cls = "ssb_cls_c" in df.columns
    out = out.withColumns({n: F.when(F.col(f"__many_{c}") if smooth_cls or "model" in c else F.lit(False), F.col(n)).otherwise(F.col(c)) for c, n in names.items()})
    return out.drop(*many)


def write_applied(df: DataFrame, models: dict[str, DataFrame], grid: Grid, path: str, **how) -> None:
    """Track records with the models' columns as cycle tables; records without wave heights are copied."""
    tables.write_cycles(applied(df, models, grid, **how), path)
