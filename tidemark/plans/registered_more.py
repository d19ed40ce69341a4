"""More registered queries: sinks, pairs, set algebra, reducers, and whole analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics, variables
from ..functions.geodesy import intersection
from ..operators import evaluate, filters, levels, lsq, match, triangles, windows
from ..operators import grid as grids
from ..sources import tables
from ..storage import shared_dir as _shared
from . import steps
from .fixture import observations, tracks
from .registered import _BETA, _LATW, _STEP, _W, CUBE, GRID, MISSION, SMALL, _direct, _noise_sql, _r, bins, bins_sql, query, r6


@query("S4_observation_tables", f"WITH {_W} SELECT cycle, node, count(*) AS n FROM w GROUP BY cycle, node")
def _observation_tables(spark, sf_dir):
    path = _shared(spark, "observations")
    tables.write_observations(_direct(spark, sf_dir), path)
    return tables.read_observations(spark, path)[1].select("cycle", "node", "n")


@query("S6_geo_model", f"SELECT cycle, CAST(floor((lat + 90) / 30) AS INT) AS geo_cell, {_r('avg(usla_ku)', 'level')} FROM obs GROUP BY 1, 2")
def _geo_model(spark, sf_dir):
    path = _shared(spark, "geo")
    o = observations(spark, sf_dir)
    tables.write_geo_model(o.groupBy("cycle", F.floor((F.col("lat") + 90) / 30).cast("int").alias("geo_cell")).agg(r6(F.avg("usla_ku")).alias("level")), path)
    return spark.read.parquet(f"{path}/model_geo").select("cycle", "geo_cell", "level")


@query("S22_model_bands", f"WITH {bins_sql(SMALL)} SELECT CAST(g.n AS INT) AS node, {_r('value', 'ku')}, {_r('c', 'c')}, {_r('(SELECT avg(iono_corr_gim_ku) FROM obs) * -0.01216e0', 'calibration')} FROM (SELECT unnest(range(0, 42)) AS n) g LEFT JOIN bins ON bins.node = g.n")
def _bands(spark, sf_dir):
    b = bins(spark, sf_dir, SMALL)
    meta = observations(spark, sf_dir).agg(F.avg("iono_corr_gim_ku").alias("iono_calib_bias"))
    both, bias = tables.model_bands({"model_node": b.select("node", "value"), "model_meta": meta}, {"model_node": b.select("node", F.col("c").alias("value"))})
    return both.select("node", r6("ku").alias("ku"), r6("c").alias("c"), r6(F.lit(bias)).alias("calibration"))


@query("S22_error_bands", f"WITH {bins_sql(SMALL)} SELECT CAST(g.n AS INT) AS node, {_r('CASE WHEN value >= 0 THEN sqrt(value) END', 'ku')}, {_r('CASE WHEN c >= 0 THEN sqrt(c) END', 'c')} FROM (SELECT unnest(range(0, 42)) AS n) g LEFT JOIN bins ON bins.node = g.n")
def _error_bands(spark, sf_dir):
    """Means of either sign stand for the variances, so that some have no deviation."""
    b = bins(spark, sf_dir, SMALL)
    both = tables.error_bands(b.select("node", "value"), b.select("node", F.col("c").alias("value")))
    return both.select("node", r6("error_ku").alias("ku"), r6("error_c").alias("c"))


@query("P12_tandem_partner", "SELECT t.mission, t.phase, t.partner, count(*) AS n FROM (VALUES (0, 'tx', 'txj1', 'j1'), (1, 'j1', 'txj1', 'tx'), (2, 'j1', 'j1j2', 'j2'), (3, 'j2', 'j1j2', 'j1'), (4, 'j2', 'j2j3', 'j3'), (5, 'j3', 'j2j3', 'j2'), (6, 'j3', 'j3s6A', 's6A'), (7, 's6A', 'j3s6A', 'j3')) t(k, mission, phase, partner) JOIN obs ON obs.id % 8 = t.k GROUP BY ALL")
def _partner(spark, sf_dir):
    """Records, dealt to the missions of every phase, by the mission they meet."""
    sides = [(m, p) for p, ms in {"txj1": ("tx", "j1"), "j1j2": ("j1", "j2"), "j2j3": ("j2", "j3"), "j3s6A": ("j3", "s6A")}.items() for m in ms]
    met = spark.createDataFrame([(k, m, p, variables.partner(m, p)) for k, (m, p) in enumerate(sides)], "k long, mission string, phase string, partner string")
    o = observations(spark, sf_dir).groupBy(F.pmod("id", F.lit(8)).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return o.join(met, "k").select("mission", "phase", "partner", "n")


@query("P13_bracketed_values", f"SELECT a.id, {_r('a.swh_ku * 0.25e0 + b.swh_ku * 0.75e0', 'swh')}, {_r('b.swh_ku * 0.4e0 + c.swh_ku * 0.6e0', 'swh_d')}, {_r('b.lat * 0.4e0 + c.lat * 0.6e0', 'lat_d')} FROM tracks a JOIN tracks b ON b.id = a.id + 1 JOIN tracks c ON c.id = a.id + 2")
def _bracketed(spark, sf_dir):
    t = tracks(spark, sf_dir).select("id", "swh_ku", "lat")
    at = {"a0": 0, "a1": 1, "d0": 1, "d1": 2}
    ids = t.select(*[(F.col("id") + k).alias(n) for n, k in at.items()], *[F.lit(w).alias(n) for n, w in (("pa0", 0.25), ("pa1", 0.75), ("pd0", 0.4), ("pd1", 0.6))])
    found = match.crossover_values(ids, t, ["swh_ku", "lat"]).where("d.swh_ku is not null")
    return found.select(F.col("a0").alias("id"), r6("a.swh_ku").alias("swh"), r6("d.swh_ku").alias("swh_d"), r6("d.lat").alias("lat_d"))


@query("P14_tandem_difference", f"SELECT a.id, {_r('b.swh_ku - a.swh_ku', 'dswh')}, {_r('CASE WHEN abs(a.time - b.time) <= 90 THEN b.swh_ku - a.swh_ku END', 'masked')} FROM obs a JOIN obs b ON b.id = a.id + 1")
def _tandem_difference(spark, sf_dir):
    o = observations(spark, sf_dir).select("id", "swh_ku", "time")
    b = o.select((F.col("id") - 1).alias("id"), F.col("swh_ku").alias("swh_ku_j3"), F.col("time").alias("time_j3"))
    j = o.join(b, "id")
    plain = F.col("swh_ku_j3") - F.col("swh_ku")
    return j.select("id", r6(plain).alias("dswh"), r6(variables.dependent("dSWH_tdm", partner="j3")).alias("masked"))


@query("F11_flags", "SELECT id FROM obs WHERE rad_surf_type = 0 AND id % 3 = 0")
def _flags(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("flag", F.pmod("id", F.lit(3)))
    return o.where(filters.flags_are({"rad_surf_type": 0, "flag": 0, "absent": 0}, o.columns)).select("id")


@query("J5_intersections", f"WITH s AS (SELECT id, lon AS a, lat AS b, lon + 1 + swh_ku AS c, lat + 2 AS d, lon + wind_speed_alt - 10 AS e, lat + 1.5e0 AS f, lon + 5 AS g, lat - 1 - swh_ku AS h FROM obs), m AS (SELECT *, (d - b) / (c - a) AS p, (h - f) / nullif(g - e, 0) AS q FROM s), x AS (SELECT *, ((f - q * e) - (b - p * a)) / nullif(p - q, 0) AS x FROM m) SELECT id, {_r('x', 'x')}, {_r('b + p * (x - a)', 'y')} FROM x WHERE abs(p - q) > 0.01e0")
def _intersections(spark, sf_dir):
    o = observations(spark, sf_dir)
    p = (F.col("lon"), F.col("lat"), F.col("lon") + 1 + F.col("swh_ku"), F.col("lat") + 2)
    q = (F.col("lon") + F.col("wind_speed_alt") - 10, F.col("lat") + 1.5, F.col("lon") + 5, F.col("lat") - 1 - F.col("swh_ku"))
    x, y = intersection(p, q)
    slopes = F.try_divide(p[3] - p[1], p[2] - p[0]) - F.try_divide(q[3] - q[1], q[2] - q[0])
    return o.where(F.abs(slopes) > 0.01).select("id", r6(x).alias("x"), r6(y).alias("y"))


@query("NEAREST_values")  # all pairs in SQL: compared by a test on a small table
def _nearest_values(spark, sf_dir):
    return match.nearest_values(observations(spark, sf_dir), "swh_ku", "wind_speed_alt", 2).select("a", "b", "k")


@query("A2_cooccurrence_diagonal", f"WITH {_W} SELECT node, count(DISTINCT id) AS n FROM w GROUP BY node")
def _diagonal(spark, sf_dir):
    return lsq.node_counts(_direct(spark, sf_dir))


@query("A4_selected_columns", f"WITH {_W}, k AS (SELECT node FROM w GROUP BY node HAVING count(*) >= 200) SELECT id, count(*) AS kept, {_r('sum(w)', 'w')} FROM w WHERE node IN (SELECT node FROM k) GROUP BY id")
def _selected(spark, sf_dir):
    d = _direct(spark, sf_dir).withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0))
    ids = [r["node"] for r in lsq.kept_nodes(d, 200).collect()]
    s = lsq.select_columns(d, ids)
    return s.select("id", F.size("nodes").cast("long").alias("kept"), r6(F.aggregate("nodes", F.lit(0.0), lambda a, e: a + e["w"])).alias("w"))


@query("A10_weighting_matrix", f"SELECT id, {_r(f'(230.0e0 * exp(-abs(time / 86400.0e0 - 15.0e0) / 3.0e0) + 120.0e0) * {_LATW}', 'w')} FROM obs")
def _weighting(spark, sf_dir):
    w = physics.pair_weight(F.col("time") / 86400.0 - 15.0) * physics.latitude_weight(F.col("lat"), MISSION)
    return observations(spark, sf_dir).select("id", r6(w).alias("w"))


@query("A9_retrograde_weight", f"SELECT id, {_r('sin(b) / sin(b0)', 'w')} FROM (SELECT id, " + ", ".join(_BETA.format(lat=v).replace("66.16e0", "98.65e0").replace("- 0.46e0", "+ 0.46e0") + f" AS {n}" for v, n in (("lat", "b"), ("0.0e0", "b0"))) + " FROM obs)")
def _retrograde(spark, sf_dir):
    return observations(spark, sf_dir).select("id", r6(physics.latitude_weight(F.col("lat"), "s3")).alias("w"))


_N = "sin({n} * 1.0e0)"


def _across_sql(known: str, grid: grids.Grid) -> str:
    """CTE across (id, p, v): known nodes (p, node, v) of each plane evaluated at the records, by brute force over edges and points.

    A triangle is one that each of its edges chooses, of all points on the edge's left.
    """
    nx, sx, sy = grid.x.count, grid.x.step, grid.y.step
    cross = lambda a, b, c: f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"
    fold = f"(c.l - a.l - (b.l - a.l) * ((b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y)) / ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) / {cross('a', 'b', 'c')}"
    return f"""k0 AS (SELECT p, node, v, (node % {nx}) * {sx!r}::DOUBLE AS x, (node // {nx}) * {sy!r}::DOUBLE AS y FROM {known}),
k AS (SELECT *, x * x + y * y + {sx * sy * 1e-6!r}::DOUBLE * ((node * node) % 1009) / 1009 AS l FROM k0),
third AS (SELECT a.p, a.node AS a, b.node AS b, arg_min(c.node, {fold}) AS c FROM k a JOIN k b ON a.p = b.p AND a.node <> b.node JOIN k c ON c.p = a.p AND {cross('a', 'b', 'c')} > 1e-6 GROUP BY ALL),
tri AS (SELECT e.* FROM third e JOIN third f ON f.p = e.p AND f.a = e.b AND f.b = e.c AND f.c = e.a JOIN third g ON g.p = e.p AND g.a = e.c AND g.b = e.a AND g.c = e.b WHERE e.a < e.b AND e.a < e.c),
o AS (SELECT id, swh_ku AS x, wind_speed_alt AS y FROM obs),
part AS (SELECT t.p, o.id, {cross('o', 'b', 'c')} / {cross('a', 'b', 'c')} AS wa, {cross('o', 'c', 'a')} / {cross('a', 'b', 'c')} AS wb, {cross('o', 'a', 'b')} / {cross('a', 'b', 'c')} AS wc, a.v AS va, b.v AS vb, c.v AS vc FROM tri t JOIN k a ON a.p = t.p AND a.node = t.a JOIN k b ON b.p = t.p AND b.node = t.b JOIN k c ON c.p = t.p AND c.node = t.c JOIN o ON o.x BETWEEN least(a.x, b.x, c.x) AND greatest(a.x, b.x, c.x) AND o.y BETWEEN least(a.y, b.y, c.y) AND greatest(a.y, b.y, c.y)),
flat AS (SELECT p, id, max(wa * va + wb * vb + wc * vc) AS v FROM part WHERE least(wa, wb, wc) >= -1e-9 GROUP BY p, id),
cell AS (SELECT *, least(CAST(floor(x / {sx!r}::DOUBLE) AS INT), {nx - 2}) AS i, least(CAST(floor(y / {sy!r}::DOUBLE) AS INT), {grid.y.count - 2}) AS j FROM o),
full4 AS (SELECT c.id, k.p, sum(k.v * (1 - abs(c.x - k.x) / {sx!r}::DOUBLE) * (1 - abs(c.y - k.y) / {sy!r}::DOUBLE)) AS v FROM cell c JOIN k ON k.node IN (c.i + c.j * {nx}, c.i + 1 + c.j * {nx}, c.i + (c.j + 1) * {nx}, c.i + 1 + (c.j + 1) * {nx}) GROUP BY c.id, k.p HAVING count(*) = 4),
across AS (SELECT coalesce(b.id, f.id) AS id, coalesce(b.p, f.p) AS p, coalesce(b.v, f.v) AS v FROM full4 b FULL JOIN flat f ON f.id = b.id AND f.p = b.p)"""


_HOLES = "ix BETWEEN 4 AND 7 AND iy BETWEEN 5 AND 9 OR (ix * ix + 3 * iy) % 5 = 0 OR ix + iy > 22"


@query("E1_across_gaps", f"WITH {bins_sql(GRID)}, known AS (SELECT 0 AS p, node, value AS v FROM (SELECT *, node % 14 AS ix, node // 14 AS iy FROM bins) WHERE NOT ({_HOLES})), {_across_sql('known', GRID)} SELECT obs.id, {_r('v', 'v')} FROM obs LEFT JOIN across ON across.id = obs.id")
def _across(spark, sf_dir):
    """A model with single unknown nodes, a hole of twenty, and a corner beyond its hull, at every record."""
    m = bins(spark, sf_dir, GRID).withColumn("value", F.when(~F.expr(_HOLES), F.col("value")))
    return observations(spark, sf_dir).select("id", r6(triangles.across_gaps(m, GRID, F.col("swh_ku"), F.col("wind_speed_alt"))).alias("v"))


_HOLES_3 = "ix IN (2, 3) AND iy IN (2, 3, 4) OR (ix * ix + 3 * iy + iz) % 7 = 0"
_PLANES = f"known AS (SELECT p, node, v FROM (SELECT q.p, node, node % 6 AS ix, node // 6 AS iy, q.p AS iz, value * (1 + q.p) AS v FROM bins, (SELECT unnest(range(0, 5)) AS p) q) WHERE NOT ({_HOLES_3}))"
_DEPTH = "d AS (SELECT id, least(CAST(floor((sig0_ku - 10e0) / 2.5e0) AS INT), 3) AS k, (sig0_ku - 10e0) / 2.5e0 - least(CAST(floor((sig0_ku - 10e0) / 2.5e0) AS INT), 3) AS f FROM obs)"


@query("E2_across_gaps", f"WITH {bins_sql(SMALL)}, {_PLANES}, {_across_sql('known', SMALL)}, {_DEPTH} SELECT d.id, {_r('CASE WHEN f = 0 THEN a.v WHEN f = 1 THEN b.v ELSE a.v * (1 - f) + b.v * f END', 'v')} FROM d LEFT JOIN across a ON a.id = d.id AND a.p = d.k LEFT JOIN across b ON b.id = d.id AND b.p = d.k + 1")
def _across_planes(spark, sf_dir):
    flat = bins(spark, sf_dir, SMALL).select(F.col("node").alias("__flat"), F.col("value").alias("__v"))
    m = grids.nodes(spark, CUBE).join(F.broadcast(flat), F.col("node") % 42 == F.col("__flat"))  # bounded by the grid
    m = m.withColumn("value", F.when(~F.expr(_HOLES_3), F.col("__v") * (1 + F.col("iz"))))
    v = triangles.across_gaps(m, CUBE, F.col("swh_ku"), F.col("wind_speed_alt"), F.col("sig0_ku"))
    return observations(spark, sf_dir).select("id", r6(v).alias("v"))


@query("E3_half_open_bilinear", f"""WITH c AS (SELECT id, CAST(floor(swh_ku) AS INT) AS i, CAST(floor(wind_speed_alt / 1.5e0) AS INT) AS j, swh_ku, wind_speed_alt FROM obs WHERE swh_ku < 13 AND wind_speed_alt < 21),
f AS (SELECT id, swh_ku - i AS x, wind_speed_alt / 1.5e0 - j AS y, {_N.format(n='(i + j * 14)')} AS a, {_N.format(n='(i + 1 + j * 14)')} AS b, {_N.format(n='(i + (j + 1) * 14)')} AS c, {_N.format(n='(i + 1 + (j + 1) * 14)')} AS d FROM c)
SELECT id, {_r('a * (1 - x) * (1 - y) + b * x * (1 - y) + c * (1 - x) * y + d * x * y', 'v')} FROM f""")
def _half_open(spark, sf_dir):
    m = grids.nodes(spark, GRID).withColumn("value", F.sin(F.col("node").cast("double")))
    v = evaluate.bilinear(evaluate.node_array(m, GRID), GRID, F.col("swh_ku"), F.col("wind_speed_alt"), planes=False, half_open=True)
    return observations(spark, sf_dir).select("id", r6(v).alias("v")).where("v is not null")


@query("W2_smoothed_columns", f"WITH {_STEP}, v AS (SELECT id, cycle, avg(swh_ku) OVER w AS a, avg(swh_rms_ku) OVER w AS b, count(*) OVER w AS n FROM obs WINDOW w AS (PARTITION BY cycle ORDER BY time ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT v.id, {_r('CASE WHEN n = 11 AND med <= 10000.0e0 THEN a END', 'swh')}, {_r('CASE WHEN n = 11 AND med <= 10000.0e0 THEN b END', 'rms')} FROM v JOIN md ON v.cycle = md.cycle")
def _smoothed_columns(spark, sf_dir):
    s = windows.smooth_columns(observations(spark, sf_dir), ["swh_ku", "swh_rms_ku"], 11, "cycle", max_step=10000.0)
    return s.select("id", r6("swh_ku_smooth").alias("swh"), r6("swh_rms_ku_smooth").alias("rms"))


@query("M12_perturbed_rows", f"SELECT id, {_r('swh_ku + ' + _noise_sql('swh_rms_ku', 3), 'swh')}, {_r('usla_ku', 'ku')} FROM obs WHERE swh_ku + {_noise_sql('swh_rms_ku', 3)} > 0 AND swh_ku + {_noise_sql('swh_rms_ku', 3)} <= 13 AND abs(lat) < 66.16::DOUBLE")
def _perturbed(spark, sf_dir):
    p = steps.perturbed(observations(spark, sf_dir), grids.Grid(GRID.x, grids.Axis(-100.0, 50.0, 10)), MISSION, "rms_w", max_step=None)
    return p.select("id", r6("swh_rms_w").alias("swh"), r6("usla_rms_w_ku").alias("ku"))


@query("Q3e_error_analysis")
def _error(spark, sf_dir):
    m = steps.error_analysis(observations(spark, sf_dir), SMALL, MISSION, err="rms_w", least=5, max_step=None)
    return m.nodes.select("node", r6("raw").alias("raw"), r6("value").alias("value"))


@query("Q3e_known_bias")
def _known(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("rad_distance_to_land", F.lit(1000000.0)).withColumn("bathymetry", F.lit(-4000.0))
    m = steps.error_analysis(o, SMALL, MISSION, variable="bm3", least=5)
    return m.nodes.select("node", r6("raw").alias("raw"), r6("value").alias("value"))


@query("X4_elementary_functions", f"SELECT id, {_r('sin(lat) + cos(lat) + asin(lat / 90.0e0) + atan(lat)', 'trig')}, {_r('exp(swh_ku / 10) + sqrt(swh_ku) + power(swh_ku, 1.5e0)', 'power')} FROM obs")
def _elementary(spark, sf_dir):
    x, s = F.col("lat"), F.col("swh_ku")
    return observations(spark, sf_dir).select("id", r6(F.sin(x) + F.cos(x) + F.asin(x / 90.0) + F.atan(x)).alias("trig"), r6(F.exp(s / 10.0) + F.sqrt(s) + F.pow(s, F.lit(1.5))).alias("power"))


@query("X6_reducers", f"SELECT cycle, {_r('min(v)', 'lo')}, {_r('max(v)', 'hi')}, {_r('avg(v)', 'mean')}, {_r('stddev_pop(v)', 'sd')}, {_r('sum(v)', 'total')}, count(v) AS n FROM (SELECT cycle, CASE WHEN id % 5 <> 0 THEN abs(lat) END AS v FROM obs) GROUP BY cycle")
def _reducers(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("v", F.when(F.pmod("id", F.lit(5)) != 0, F.abs("lat")).otherwise(float("nan")))
    o = filters.measured(o.select("cycle", "v"))
    return o.groupBy("cycle").agg(r6(F.min("v")).alias("lo"), r6(F.max("v")).alias("hi"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("sd"), r6(F.sum("v")).alias("total"), F.count("v").alias("n"))


@query("X9_arrays", f"WITH t AS (SELECT pass_number, time, swh_ku, lag(swh_ku) OVER w AS b, lag(swh_ku, 2) OVER w AS c FROM tracks WINDOW w AS (PARTITION BY pass_number ORDER BY time)) SELECT pass_number, {_r('max(abs(swh_ku - b))', 'step')}, {_r('max((swh_ku + b + c) / 3)', 'mean3')}, count(DISTINCT swh_ku) AS n FROM t GROUP BY pass_number")
def _arrays(spark, sf_dir):
    a = tracks(spark, sf_dir).groupBy("pass_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("time", "swh_ku"))), lambda e: e["swh_ku"]).alias("v"))  # a pass has a bounded number of records
    n = F.size("v")
    diff = F.zip_with(F.slice("v", 2, n), F.slice("v", 1, n - 1), lambda p, q: F.abs(p - q))
    triple = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.when(n >= 3, (F.try_element_at("v", i) + F.try_element_at("v", i + 1) + F.try_element_at("v", i + 2)) / 3))
    return a.select("pass_number", r6(F.array_max(diff)).alias("step"), r6(F.array_max(triple)).alias("mean3"), F.size(F.array_distinct("v")).cast("long").alias("n"))


@query("SET_operations", "WITH a AS (SELECT id FROM obs WHERE swh_ku < 4), b AS (SELECT id FROM obs WHERE wind_speed_alt < 7) SELECT 'and' AS op, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'minus', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'xor', count(*) FROM ((SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a))")
def _sets(spark, sf_dir):
    o = observations(spark, sf_dir)
    p, q = F.col("swh_ku") < 4, F.col("wind_speed_alt") < 7
    counts = {"and": p & q, "or": p | q, "minus": p & ~q, "xor": (p & ~q) | (q & ~p)}  # index sets of one table are predicates: one scan
    one = o.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in counts])).alias("e")).select("e.op", "e.n")


@query("ROLLUP_quality", f"SELECT coalesce(cycle, -1) AS cycle, coalesce(pass_number, -1) AS pass_number, n, mean FROM (SELECT cycle, pass_number, count(*) AS n, {_r('avg(usla_ku)', 'mean')} FROM obs GROUP BY ROLLUP (cycle, pass_number))")
def _rollup(spark, sf_dir):
    g = observations(spark, sf_dir).rollup("cycle", "pass_number").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("usla_ku")).alias("mean"))
    return g.select(F.coalesce("cycle", F.lit(-1)).alias("cycle"), F.coalesce("pass_number", F.lit(-1)).alias("pass_number"), "n", "mean")
