"""The three steps as plans: products to cycles, cycles to observations with weights, observations to a model."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics, variables
from ..operators import design, evaluate, filters, levels, lsq, match, outliers, smooth, windows
from ..operators.grid import STANDARD, Grid, gauss_cell
from ..sources import missions
from ..storage import materialize

#: Least observations of a node, and of a geographic cell of a cycle.
LEAST, LEAST_GEO = 50, 4
#: Rounds of post-fit outlier removal at most; more are an error. They end without one, as each but the last takes a row; how
#: many it takes grows with the rows, so that a number (6 in the studied system) is a limit on the table. Set one to be told.
ROUNDS = math.inf
#: What a fit that can be resumed notes of each round: where its rows are, and how many.
ROUND_MARKS = "round int, path string, n long"
#: Variables whose outliers are removed after the fit, and perturbations without.
OUTLIER_VARIABLES = ("usla", "ssha_dfI", "rng_mle", "iono_corr_alt", "mss_dtu", "mss_cnes15", "ocean_got", "wet_tropo_model", "sum_err", "ib_corr", "alt_jpl", "alt_cnes", "iono_tran", "iono_tran_smooth", "SO")
NO_OUTLIERS = ("rms_r", "sum_err")
#: Variables whose model takes its level from zero significance; others take that of the reference bin.
LEVEL_VARIABLES = tuple(v for v in OUTLIER_VARIABLES if v != "SO")
#: Columns of a pair's sides: wave height, wind speed, uncorrected height.
SIDE = ("swh_ku", "wind_speed_alt", "usla_ku")


def direct(cycles: DataFrame, grid: Grid, mission: str, *, variable: str = "usla", band: str = "ku", err: str | None = None, second: str = "u10", geo: bool = False) -> DataFrame:
    """Observation rows with dependent value and weights: (all columns, x, y, z, nodes[, geo_cell])."""
    x, y = variables.independent(mission, err=err, second=second)
    out = filters.level1(filters.without_bad_cycles(cycles, mission), mission).withColumn("x", x).withColumn("y", y).withColumn("z", variables.dependent(variable, band, mission, err=err))
    out = out.where(F.col("z").isNotNull() & filters.level2(cycles.columns, mission))
    depth = []
    if grid.z is not None:
        out = out.withColumn("depth", F.col("mean_wave_period_t02"))
        depth = [F.col("depth")]
    out = out.withColumn("nodes", design.weights(grid, F.col("x"), F.col("y"), *depth)).where(F.col("nodes").isNotNull())
    return out.withColumn("geo_cell", gauss_cell(F.col("lat"), F.col("lon"))) if geo else out


def with_uncorrected(df: DataFrame, mission: str) -> DataFrame:
    """Records with the height that depends on no frequency, and uncorrected heights of both bands (ssha_free, usla_ku, usla_c)."""
    iono = physics.iono_for_usla(F.col("iono_corr_gim_ku"), F.col("iono_corr_alt_ku"), mission, F.col("cycle"))
    ku, c = physics.uncorrected_heights(F.col("ssha"), F.col("sea_state_bias_ku"), F.col("iono_corr_alt_ku"), F.col("range_ku"), F.col("range_c"), iono, mission)
    free = F.col("ssha") + F.col("sea_state_bias_ku") + F.col("iono_corr_alt_ku") + F.col("range_ku")
    return df.withColumns({"ssha_free": free, "usla_ku": ku, "usla_c": c})


def observed_pairs(pairs: DataFrame, mission: str, days: float = 10.0) -> DataFrame:
    """Pairs whose first side passes level 1 and whose sides (time_a, time_b) are near in time."""
    return filters.level1(pairs, mission).where(filters.near_in_time("time_a", "time_b", days))


def pair_rows(pairs: DataFrame, grid: Grid, *, x: str = "swh_ku", y: str = "wind_speed_alt", z: str = "usla_ku", a: str = "_a", b: str = "_b") -> DataFrame:
    """Difference rows (first less second side) of matched pairs: z and weights that add to 0."""
    side = lambda s: design.weights(grid, F.col(f"{x}{s}"), F.col(f"{y}{s}"))
    out = pairs.withColumn("__a", side(a)).withColumn("__b", side(b)).where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return out.withColumn("z", F.col(f"{z}{a}") - F.col(f"{z}{b}")).withColumn("nodes", design.difference(F.col("__a"), F.col("__b"))).drop("__a", "__b").where(F.col("z").isNotNull())


def collinear(cycles: DataFrame, grid: Grid, mission: str, radius: float | None = None) -> DataFrame:
    rows = filters.without_bad_cycles(filters.level1(cycles, mission), mission, collinear=True)
    return pair_rows(match.collinear(rows, radius or match.collinear_radius(mission)), grid)


def perturbed(cycles: DataFrame, grid: Grid, mission: str, err: str, *, variable: str = "usla", second: str = "u10", max_step: float | None = 1.2) -> DataFrame:
    """Direct rows with independent and dependent values under a perturbation, stored as columns named by it.

    Adds swh_<err>, <second>_<err>, <variable>_<err>_ku and _c, the smoothed ionosphere, and the weights.
    """
    rows = windows.smooth_columns(filters.level1(cycles, mission), ["iono_corr_alt_ku"], 21, "cycle", max_step=max_step)
    if err == "smth_swh":
        rows = windows.smooth_columns(rows, ["swh_ku", "swh_rms_ku"], 11, "cycle", max_step=max_step).where(F.col("swh_ku_smooth").isNotNull())
        rows = rows.withColumn(f"swh_rms_{err}_ku", F.col("swh_rms_ku_smooth"))
    x, y = variables.independent(mission, err=err, second=second)
    rows = rows.withColumn(f"swh_{err}", x).withColumn(f"{second}_{err}", y)
    for b in ("ku", "c"):
        rows = rows.withColumn(f"{variable}_{err}_{b}", variables.dependent(variable, b, mission, err=err))
    return rows.withColumn("nodes", design.weights(grid, F.col(f"swh_{err}"), F.col(f"{second}_{err}"))).where(F.col("nodes").isNotNull())


def error_analysis(cycles: DataFrame, grid: Grid, mission: str, *, variable: str = "usla", err: str | None = None, band: str = "ku", least: int = LEAST, max_step: float | None = 1.2) -> Model:
    """The third step with another dependent variable, or on perturbed rows."""
    if err is None:
        rows = direct(cycles, grid, mission, variable=variable, band=band)
    else:
        p = perturbed(cycles, grid, mission, err, variable=variable, max_step=max_step)
        rows = p.withColumn("x", F.col(f"swh_{err}")).withColumn("y", F.col(f"u10_{err}")).withColumn("z", F.col(f"{variable}_{err}_{band}"))
    return fit_model(rows.select("id", "cycle", "lat", "x", "y", "z", "nodes"), grid, least=least, variable=variable, err=err)


def two_band_fit(rows: DataFrame, grid: Grid, *, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Both bands' grids solved together from ranges and the map's ionosphere; rows need ranges, iono and uncorrected heights.

    The two bands' levels are tied by differences only, so the system may lack rank; then the solution is the one of least
    norm.
    """
    k = physics.C_HZ**2 / (physics.KU_HZ**2 - physics.C_HZ**2)
    free = F.col("usla_ku") + F.col("iono_corr_gim_ku") + F.col("range_ku")
    z_range = free - (1 + k) * F.col("range_ku") + k * F.col("range_c")
    z_tec = F.col("iono_corr_gim_ku") / k - F.col("range_ku") + F.col("range_c")
    stacked = design.two_band_rows(rows.select(F.col("id").alias("obs_id"), "nodes", z_range.alias("z_range"), z_tec.alias("z_tec")), grid.size, k)
    solved, _ = lsq.fit(stacked.withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0)), least=least)  # both bands' nodes
    ku = solved.where(F.col("node") < grid.size)
    c = solved.where(F.col("node") >= grid.size).withColumn("node", (F.col("node") - grid.size).cast("int"))
    return ku, c


def collinear_rows(points: DataFrame, grid: Grid, radius: float = 1000.0, *, timed: bool = False) -> DataFrame:
    """Difference rows of collinear matches; the cycle is that of the first side.

    timed: rows weigh by the time between the sides, as beside crossovers; otherwise all weigh alike.
    """
    rows = pair_rows(match.collinear(points, radius), grid).withColumn("cycle", F.col("cycle_a"))
    return rows.withColumn("weight", physics.pair_weight((F.col("time_a") - F.col("time_b")) / 86400.0) if timed else F.lit(1.0))


def tandem_rows(a: DataFrame, b: DataFrame, cycles: list[tuple[int, int]], grid: Grid, radius: float = 950.0) -> DataFrame:
    """Difference rows of tandem matches of two missions."""
    return pair_rows(match.tandem(a, b, cycles, radius), grid).withColumn("cycle", F.col("cycle_a")).withColumn("weight", F.lit(1.0))


def crossover_rows(points: DataFrame, grid: Grid, *, radius: float = 7000.0, max_days: float = 2.0, columns: tuple[str, ...] = SIDE) -> DataFrame:
    """Difference rows (ascending less descending) at crossings, with their weights by time; the cycle is the ascending one."""
    values = match.crossover_values(match.crossovers(points, radius=radius, max_days=max_days), points, [*columns, "cycle"])
    flat = values.select("a0", "a1", "d0", "d1", F.col("a_m0.cycle").alias("cycle"), "lat", "lon", ((F.col("time_a") - F.col("time_d")) / 86400.0).alias("days"), *[F.col(f"{s}.{c}").alias(f"{c}_{t}") for s, t in (("a", "a"), ("d", "b")) for c in columns])
    return pair_rows(flat, grid).withColumn("weight", physics.pair_weight(F.col("days")))


def differences(points: DataFrame, grid: Grid, mission: str, *, radius: float | None = None, crossing_radius: float = 7000.0, max_days: float = 2.0) -> DataFrame:
    """(cycle, kind, z, nodes, weight): collinear differences of each cycle with the next one; of cycles without a next one, their own crossovers."""
    cycles = {r["cycle"] for r in points.select("cycle").distinct().collect()}  # a row for each cycle
    last = [c for c in cycles if c + 1 not in cycles]
    keep = lambda d, kind: d.select("cycle", F.lit(kind).alias("kind"), "z", "nodes", "weight")
    out = keep(collinear_rows(points, grid, radius or match.collinear_radius(mission)), "collinear")
    return out.unionByName(keep(crossover_rows(points.where(F.col("cycle").isin(last)), grid, radius=crossing_radius, max_days=max_days), "crossover"))


def tandem_tables(a: DataFrame, b: DataFrame, phase: str, radius: float = 950.0) -> DataFrame:
    """Matches of a whole tandem phase, the second mission's columns with its name as suffix."""
    return match.tandem_table(match.tandem(a, b, missions.tandem_cycles(phase), radius), missions.TANDEM[phase][1])


def joint(*designs: DataFrame) -> DataFrame:
    """Several methods' rows (z, nodes, weight) as one system."""
    out = designs[0].select("z", "nodes", "weight")
    for d in designs[1:]:
        out = out.unionByName(d.select("z", "nodes", "weight"))
    return out


@dataclass
class Model:
    grid: Grid
    nodes: DataFrame
    bias: float
    cycle_levels: list[tuple] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)
    rounds: int = 0
    rank_deficient: bool = False


def post_fit(rows: DataFrame, solved: DataFrame, grid: Grid, z: float = 5.0) -> DataFrame:
    """Rows whose residual survives outlier removal in its cycle; rows that the model does not reach go."""
    values = evaluate.node_array(solved, grid)
    res = rows.withColumn("residual", F.col("z") - evaluate.apply_weights(F.col("nodes"), values)).where(F.col("residual").isNotNull())
    return outliers.without_outliers(res, F.col("residual"), z, "cycle").drop("residual")


def post_fit_pairs(rows: DataFrame, solved: DataFrame, grid: Grid, z: float = 5.0) -> DataFrame:
    """Pairs that the model reaches on both sides, and whether each side's own residual survives in its cycle (ok_a, ok_b)."""
    values = evaluate.node_array(solved, grid)
    residual = [F.col(f"{SIDE[2]}_{s}") - evaluate.bilinear(values, grid, F.col(f"{SIDE[0]}_{s}"), F.col(f"{SIDE[1]}_{s}")) for s in "ab"]
    res = rows.withColumn("__ra", residual[0]).withColumn("__rb", residual[1])
    return outliers.marked_pairs(res, F.col("__ra"), F.col("__rb"), z, "cycle").drop("__ra", "__rb")


def rounds_of(variable: str, err: str | None) -> float:
    """Rounds of outlier removal at most."""
    return 0 if err in NO_OUTLIERS or variable not in OUTLIER_VARIABLES else ROUNDS


def finished(rows: DataFrame, solved: DataFrame, grid: Grid, variable: str, used: int, lacking: bool) -> Model:
    """A raw grid levelled on direct rows (x, y, cycle) and smoothed."""
    by_cycle, bias = level(rows, solved, grid, variable)
    levelled = solved.withColumn("value", F.col("value") - F.lit(0.0 if bias != bias else bias))
    smoothed, c = smooth.smooth(levelled, grid)
    return Model(grid, smoothed.join(solved.select("node", "error", "n"), "node", "left"), bias, by_cycle, c, used, lacking)


def fit_model(rows: DataFrame, grid: Grid, *, least: int = LEAST, weight: Column | None = None, variable: str = "usla", err: str | None = None, complete_rows: bool = False, by_cycle: bool = False, state: str | None = None) -> Model:
    """Fit direct rows, remove post-fit outliers until none is left, level by cycle, and smooth.

    by_cycle: nodes are chosen by counts that are consistent in each cycle.
    state: a folder of this fit alone, where the rows kept by each round stay; a fit that was lost goes on after its last
    whole round, and one that had ended only solves its last rows again. It must be given the same rows and settings.
    """
    if by_cycle and complete_rows:
        raise ValueError("nodes are chosen by cycle or with complete rows, not both")
    spark, done = rows.sparkSession, {}
    if state is not None:
        mark = f"{state.rstrip('/')}/rounds"
        spark.createDataFrame([], ROUND_MARKS).write.mode("append").parquet(mark)
        done = {r["round"]: (r["path"], r["n"]) for r in spark.read.schema(ROUND_MARKS).parquet(mark).collect()}  # a row a round

    def keep(found: DataFrame, k: int) -> tuple[DataFrame, int]:
        """The rows left by a round, 0 being all, and their number; written, unless an earlier run has."""
        if k in done:
            path, n = done[k]
            return spark.read.schema(rows.schema).parquet(path), n
        if state is None:
            kept = materialize(found, "kept-rows")
            return kept, kept.count()
        path = f"{state.rstrip('/')}/kept-{k}-{uuid.uuid4().hex}"
        found.select(*rows.columns).write.parquet(path)
        kept = spark.read.schema(rows.schema).parquet(path)
        n = kept.count()
        spark.createDataFrame([(k, path, n)], ROUND_MARKS).coalesce(1).write.mode("append").parquet(mark)
        return kept, n

    solve = lambda r: lsq.fit(r, least=least, weight=weight, complete_rows=complete_rows, grid=grid, by_cycle=by_cycle)
    held, n = keep(rows, 0)
    used, most = max(done, default=0), rounds_of(variable, err)
    kept, n = keep(held, used) if used else (held, n)
    solved, lacking = solve(kept)
    ended = used > 0 and n == done[used - 1][1]
    while most and not ended:
        used += 1
        if used > most:
            raise RuntimeError(f"outliers are left after {most} rounds")
        kept, after = keep(post_fit(kept, solved, grid), used)
        if after == n:
            break
        n = after
        solved, lacking = solve(kept)
    return finished(held, solved, grid, variable, used, lacking)


def fit_pairs(designs: list[DataFrame], direct_rows: DataFrame, grid: Grid, *, least: int = LEAST, variable: str = "usla", err: str | None = None) -> Model:
    """Fit difference rows of one method, or of several as one system (z, nodes, weight, cycle, both sides' columns).

    Each method's outliers are removed by cycle and by side after the fit: a pair stays if both sides do, and rounds go on
    until no pair is an outlier on both. The grid is levelled on direct rows (x, y, cycle, ...).
    """
    solve = lambda ds: lsq.fit(joint(*ds), least=least, weight=F.col("weight"), grid=grid)
    kept = [materialize(d, "pair-rows") for d in designs]
    solved, lacking = solve(kept)
    used, most = 0, rounds_of(variable, err)
    while most:
        used += 1
        if used > most:
            raise RuntimeError(f"outliers are left after {most} rounds")
        marked = [materialize(post_fit_pairs(d, solved, grid), "marked-pairs") for d in kept]
        gone = sum(m.where("not ok_a and not ok_b").count() for m in marked)
        kept = [m.where("ok_a and ok_b").drop("ok_a", "ok_b") for m in marked]
        if not gone:
            break
        solved, lacking = solve(kept)
    return finished(materialize(direct_rows, "direct-rows"), solved, grid, variable, used, lacking)


def level(rows: DataFrame, solved: DataFrame, grid: Grid, variable: str = "usla") -> tuple[list[tuple], float]:
    """Zero-significance level of every cycle's model values, and their mean beyond outliers.

    Variables without zero significance take the mean over cycles of the reference bin (rows then need z and lat).
    """
    if variable not in LEVEL_VARIABLES:
        weight = physics.latitude_weight(F.col("lat"), "j2") if "lat" in rows.columns else F.lit(1.0)
        found = levels.reference_mean(rows, F.col("x"), F.col("y"), F.col("z"), weight).collect()  # a row for each cycle
        by_cycle = sorted((r["cycle"], r["level"], float("nan")) for r in found)
        return by_cycle, float(np.mean([v for _, v, _ in by_cycle])) if by_cycle else float("nan")
    values = evaluate.node_array(solved, grid)
    depth = [F.col("depth")] if grid.z is not None else []
    model = evaluate.trilinear if depth else evaluate.bilinear
    at = rows.withColumn("ssb", model(values, grid, F.col("x"), F.col("y"), *depth)).where(F.col("ssb").isNotNull())
    at = outliers.without_outliers(at, F.col("ssb"), 4.0, "cycle")
    by_cycle = levels.levels_by(levels.histogram(at, F.col("ssb"), "ssb", "cycle"))
    return by_cycle, levels.mean_within([v for _, v, _ in by_cycle])


def _eliminated(rows: DataFrame, ids: list[int], least_geo: int) -> tuple[DataFrame, DataFrame]:
    """The rows that count beside free levels of (cycle, geo_cell), and the grid (node, value, error, n) that they give."""
    dense_cells = rows.groupBy("cycle", "geo_cell").count().where(F.col("count") >= least_geo).select("cycle", "geo_cell")
    used = materialize(lsq.select_columns(rows.join(dense_cells, ["cycle", "geo_cell"], "left_semi"), ids).select("cycle", "geo_cell", "z", "nodes"), "used-rows")
    matrix, vector, counts = lsq.demeaned_counted(used, "cycle", "geo_cell")
    x, error, _ = lsq.solve(*lsq.dense(matrix, vector, ids))
    solved = rows.sparkSession.createDataFrame([(n, float(v), float(e)) for n, v, e in zip(ids, x, error, strict=True)], "node int, value double, error double")  # bounded by the dense system
    return used, solved.join(F.broadcast(counts), "node", "left").na.fill(0, ["n"])


def _dense_nodes(rows: DataFrame, least: int) -> list[int]:
    ids = sorted(r["node"] for r in lsq.kept_nodes(rows, least).select("node").collect())
    if len(ids) > lsq.DENSE_NODES:
        raise ValueError(f"{len(ids)} nodes are too many beside free levels")
    return ids


def common_bias(rows: DataFrame, grid: Grid, *, least: int = LEAST, least_geo: int = LEAST_GEO) -> tuple[DataFrame, DataFrame]:
    """Grid with a free level for each (cycle, geographic cell), and those levels; one pass, without a look at residuals."""
    used, solved = _eliminated(rows, _dense_nodes(rows, least), least_geo)
    return solved.select("node", "value", "error"), lsq.group_levels(used, solved, "cycle", "geo_cell")


def fit_common_bias(rows: DataFrame, grid: Grid, *, least: int = LEAST, least_geo: int = LEAST_GEO, variable: str = "usla", err: str | None = None, z: float = 5.0) -> tuple[Model, DataFrame]:
    """Grid and free levels of every (cycle, geographic cell) estimated together, to the end.

    Cells are eliminated, the grid is solved, rows whose residual from the grid is an outlier of its cycle go, and so on until
    none does; the grid's nodes are those of the first round, cells are counted anew in each. Then the cells' levels follow from
    the grid (cycle, geo_cell, value, error, n), the error from the block that was eliminated, which is their count of rows.
    The grid is levelled by the rows of the first round and smoothed. rows: (cycle, geo_cell, x, y, z, nodes[, lat]).
    """
    held = materialize(rows, "common-rows")
    ids = _dense_nodes(held, least)
    if not ids:
        raise ValueError("no node has enough rows")
    kept, n, rounds, most = held, held.count(), 0, rounds_of(variable, err)
    used, solved = _eliminated(kept, ids, least_geo)
    while most:
        rounds += 1
        if rounds > most:
            raise RuntimeError(f"outliers are left after {most} rounds")
        kept = materialize(post_fit(kept, solved, grid, z), "kept-rows")
        before, n = n, kept.count()
        if n == before:
            break
        used, solved = _eliminated(kept, ids, least_geo)
    cells = lsq.group_levels(used, solved, "cycle", "geo_cell").select("cycle", "geo_cell", F.col("level").alias("value"), (1 / F.sqrt("n")).alias("error"), "n")
    return finished(held, solved, grid, variable, rounds, False), materialize(cells, "cells")


def calibration_ranges(variable: str = "usla", err: str | None = None) -> tuple[Column, Column]:
    """The ranges of both bands that a calibration reads: plain, with random or signed errors, or as stored with a perturbation."""
    ku, c = F.col("range_ku"), F.col("range_c")
    if err in (None, "plrm", "rng_corr"):
        return ku, c
    if err.startswith("rms_r"):
        return ku + physics.noise(F.col("id"), F.col("range_rms_ku"), 11), c + physics.noise(F.col("id"), F.col("range_rms_c"), 12)
    if err == "rms_Ewr":
        sign = F.when(F.col("swh_rms_Ew") < 0, -1.0).when(F.col("swh_rms_Ew") >= 0, 1.0)
        return ku + sign * F.col("range_rms_ku"), c + sign * F.col("range_rms_c")
    return (ku, c) if variable == "sum_err" else (F.col(f"{variable}_{err}_ku"), F.col(f"{variable}_{err}_c"))


def iono_calibration(rows: DataFrame, ku: DataFrame, c: DataFrame, grid: Grid, *, ranges: tuple[Column, Column] | None = None, depth: Column | None = None, midpoint: bool = False, max_step: float | None = 1.2) -> tuple[list[tuple], float]:
    """TEC levels of the two-frequency ionosphere and of the map by cycle (cycle, alt, gim), and the bias between them.

    Both are smoothed alike along the track, over the records that have both. ranges: of both bands, `calibration_ranges` for
    perturbed ones. depth: the third axis, if the grid has one. midpoint: levels at the middle of the cutoff instead of at zero.
    """
    values = {b: evaluate.node_array(m, grid) for b, m in (("ku", ku), ("c", c))}
    at = (F.col("swh_ku"), F.col("wind_speed_alt"))
    ssb = {b: evaluate.bilinear(v, grid, *at) if grid.z is None else evaluate.trilinear(v, grid, *at, depth) for b, v in values.items()}
    seen = rows.withColumn("iono", physics.dual_frequency_iono(*(ranges or calibration_ranges()), ssb["ku"], ssb["c"])).where(F.col("iono").isNotNull() & F.col("iono_corr_gim_ku").isNotNull())
    means = {"iono": "__alt", "iono_corr_gim_ku": "__gim"}
    seen = windows.moving_means(seen, means, 21, "cycle", cut=max_step is not None, max_step=max_step).where(F.col("__alt").isNotNull())
    seen = materialize(seen.select("cycle", *means.values()), "iono-means")  # both histograms read it
    out = {}
    for name in ("__alt", "__gim"):
        h = levels.histogram(seen, physics.tec_units(F.col(name)), "tec", "cycle")
        out[name] = dict((k, v) for k, v, _ in levels.levels_by(h, kind="tec", cutoff=(1.0, 10.0), linear=True, midpoint=midpoint))
    by_cycle = [(k, out["__alt"][k], out["__gim"].get(k, float("nan"))) for k in sorted(out["__alt"])]
    return by_cycle, levels.mean_within([a - g for _, a, g in by_cycle])


STANDARD_GRID = STANDARD["u10"]
