"""Registered queries of fits, levels and smoothing, next to DuckDB SQL that solves the same systems by elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import design, levels, lsq, match, smooth
from ..operators import grid as grids
from ..operators.grid import Axis, Grid
from . import steps
from .fixture import observations, tracks
from .registered import _COLLINEAR, _CROSS, _GAUSS, _STEP, _noise_sql, CUBE, GRID, MISSION, SMALL, _direct, _points, _r, bins, bins_sql, query, r6

#: A grid that a few hundred pairs fill.
TINY = Grid(Axis(0.0, 6.5, 3), Axis(0.0, 10.5, 3))


# --- SQL ----------------------------------------------------------------------------------------------------------


def cells_sql(name: str, rows: str, grid: Grid, x: str, y: str, keep: str, scale: str = "1e0") -> list[str]:
    """CTE `name` (keep, node, w): weights of rows on the nodes of a grid, and <name>_1 with a row for each row inside it."""
    nx, ny = grid.x.count, grid.y.count
    node = "[ix + iy * {n}, ix + 1 + iy * {n}, ix + (iy + 1) * {n}, ix + 1 + (iy + 1) * {n}]".format(n=nx)
    return [
        f"{name}_0 AS (SELECT *, CAST(ceil({x} / {grid.x.step}e0) AS INT) - 1 AS ix, CAST(ceil({y} / {grid.y.step}e0) AS INT) - 1 AS iy FROM {rows})",
        f"{name}_1 AS (SELECT *, {x} / {grid.x.step}e0 - ix AS fx, {y} / {grid.y.step}e0 - iy AS fy FROM {name}_0 WHERE ix BETWEEN 0 AND {nx - 2} AND iy BETWEEN 0 AND {ny - 2})",
        f"{name} AS (SELECT * FROM (SELECT {keep}, unnest({node}) AS node, {scale} * unnest([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]) AS w FROM {name}_1) WHERE w <> 0)",
    ]


def solved_sql(system: str, right: str, name: str, key: str = "", singular: bool = False) -> list[str]:
    """CTE `name` (key, i, value, error) from system (key, i, j, v), all entries, and right (key, i, v), by Gauss-Jordan elimination.

    singular: of a system that knows no level the solution of least norm, by adding one to every entry.
    """
    k, on, part = (f"{key}, ", f"q.{key} = t.{key} AND ", f"PARTITION BY {key} ") if key else ("", "", "")
    n = "(len(r) - 1) // 2"
    add = " + 1e0" if singular else ""
    rows = f"(SELECT a.{key} AS {key}, a.i, b.j FROM (SELECT DISTINCT {key}, i FROM {right}) a JOIN (SELECT DISTINCT {key}, i AS j FROM {right}) b ON a.{key} = b.{key})" if key else f"(SELECT a.i, b.j FROM (SELECT DISTINCT i FROM {right}) a, (SELECT DISTINCT i AS j FROM {right}) b)"
    same = f"f.{key} = s.{key} AND " if key else ""
    full = f"SELECT {f'f.{key}, ' if key else ''}f.i, f.j, coalesce(s.v, 0e0){add} AS v FROM {rows} f LEFT JOIN {system} s ON {same}f.i = s.i AND f.j = s.j"
    error = f"sqrt(r[{n} + 1 + p]{f' - 1e0 / ({n} * {n})' if singular else ''})"
    return [
        f"{name}_e AS (SELECT {k}i, list(v ORDER BY j) AS r, row_number() OVER ({part}ORDER BY i) AS p FROM ({full}) GROUP BY {k}i)",
        f"{name}_s AS MATERIALIZED (SELECT {f'e.{key}, ' if key else ''}e.i, CAST(p AS INT) AS p, e.r || [b.v] || list_transform(range(len(e.r)), lambda x: CASE WHEN x + 1 = p THEN 1e0 ELSE 0e0 END) AS r FROM {name}_e e JOIN {right} b ON {f'b.{key} = e.{key} AND ' if key else ''}b.i = e.i)",
        f"{name}_g AS (SELECT 0 AS k, * FROM {name}_s UNION ALL SELECT t.k + 1, {f't.{key}, ' if key else ''}t.i, t.p, CASE WHEN t.p = t.k + 1 THEN list_transform(t.r, lambda x: x / t.r[t.k + 1]) ELSE list_transform(list_zip(t.r, q.r), lambda z: z[1] - t.r[t.k + 1] * z[2] / q.r[t.k + 1]) END FROM {name}_g t JOIN {name}_g q ON {on}q.p = t.k + 1 AND q.k = t.k WHERE t.k < (len(t.r) - 1) // 2)",
        f"{name} AS (SELECT {k}i, r[{n} + 1] AS value, {error} AS error FROM {name}_g WHERE k = {n})",
    ]


def normal_sql(name: str, weights: str, least: int, z: str = "z", weight: str = "1e0", singular: bool = False) -> list[str]:
    """CTE `name` (node, value, error, n) fitted to weights (id, node, w, z, weight)."""
    return [
        f"{name}_k AS (SELECT node, count(*) AS n FROM {weights} GROUP BY node HAVING count(*) >= {least})",
        f"{name}_w AS MATERIALIZED (SELECT a.* FROM {weights} a JOIN {name}_k k ON a.node = k.node)",
        f"{name}_m AS (SELECT a.node AS i, b.node AS j, sum({weight.replace('weight', 'a.weight')} * a.w * b.w) AS v FROM {name}_w a JOIN {name}_w b ON a.id = b.id GROUP BY 1, 2)",
        f"{name}_b AS (SELECT node AS i, sum({weight} * w * {z}) AS v FROM {name}_w GROUP BY node)",
        *solved_sql(f"{name}_m", f"{name}_b", f"{name}_x", singular=singular),
        f"{name} AS (SELECT x.i AS node, x.value, x.error, k.n FROM {name}_x x JOIN {name}_k k ON k.node = x.i)",
    ]


def within_sql(name: str, rows: str, value: str, z: str, key: str, rounds: int) -> list[str]:
    """CTE `name`: rows whose value survives outlier removal in its group."""
    out = [f"{name}_0 AS (SELECT *, {value} AS v FROM {rows} WHERE {value} IS NOT NULL)"]
    for i in range(rounds):
        out.append(f"{name}_{i + 1} AS (SELECT * EXCLUDE (m, s) FROM (SELECT *, avg(v) OVER (PARTITION BY {key}) AS m, stddev_pop(v) OVER (PARTITION BY {key}) AS s FROM {name}_{i}) WHERE v BETWEEN m - {z} * s AND m + {z} * s)")
    return [*out, f"{name} AS (SELECT * FROM {name}_{rounds})"]


def tail_sql(name: str, values: str, kind: str, cutoff: tuple[float, float], x: str, y: str, degree: int, rounds: int = 3) -> list[str]:
    """CTE `name` (cycle, i, value): polynomial of the tail of each cycle's histogram of values (cycle, v); <name>_mse; <name>_t are the bins used."""
    lo, step, n = levels.bins(kind)
    top = f"v = {lo!r}::DOUBLE + {step!r}::DOUBLE * {n}"
    tail = "share" if kind == "tec" else "100e0 - share"
    beside = "lag" if kind == "tec" else "lead"
    out = [
        f"{name}_b AS (SELECT cycle, CASE WHEN {top} THEN {n - 1} ELSE CAST(floor((v - {lo!r}::DOUBLE) / {step!r}::DOUBLE) AS INT) END AS bin, count(*) AS n FROM {values} GROUP BY 1, 2)",
        f"{name}_h AS (SELECT c.cycle, k.bin, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT cycle FROM {values}) c, (SELECT unnest(range(0, {n}))::INT AS bin) k LEFT JOIN {name}_b b ON b.cycle = c.cycle AND b.bin = k.bin)",
        f"{name}_c AS (SELECT cycle, bin, {lo!r}::DOUBLE + {step!r}::DOUBLE * (bin + 0.5e0) AS mid, 100e0 * sum(n) OVER (PARTITION BY cycle ORDER BY bin) / sum(n) OVER (PARTITION BY cycle) AS share FROM {name}_h)",
        f"{name}_a AS (SELECT *, {beside}(tail) OVER (PARTITION BY cycle ORDER BY bin) AS other FROM (SELECT *, {tail} AS tail FROM {name}_c) WHERE tail BETWEEN {cutoff[0]}e0 AND {cutoff[1]}e0)",
        f"{name}_t0 AS (SELECT cycle, bin, {x} AS x, {y} AS y FROM {name}_a WHERE other <> tail QUALIFY count(*) OVER (PARTITION BY cycle) > {degree})",
    ]
    fit = lambda c: " + ".join(f"coalesce(max(value) FILTER (WHERE i = {k}), 0e0) * pow(x, {k})" for k in range(degree + 1))  # noqa: E731, ARG005
    for r in range(rounds):
        t, s = f"{name}_t{r}", f"{name}_f{r}"
        out += [
            f"{s}_m AS (SELECT cycle, a.k AS i, b.k AS j, sum(pow(x, a.k + b.k)) AS v FROM {t}, (SELECT unnest(range(0, {degree + 1}))::INT AS k) a, (SELECT unnest(range(0, {degree + 1}))::INT AS k) b GROUP BY 1, 2, 3)",
            f"{s}_b AS (SELECT cycle, a.k AS i, sum(pow(x, a.k) * y) AS v FROM {t}, (SELECT unnest(range(0, {degree + 1}))::INT AS k) a GROUP BY 1, 2)",
            *solved_sql(f"{s}_m", f"{s}_b", s, "cycle"),
            f"{s}_r AS (SELECT t.cycle, t.bin, t.x, t.y, t.y - ({fit(s)}) AS res FROM {t} t JOIN {s} c ON c.cycle = t.cycle GROUP BY t.cycle, t.bin, t.x, t.y)",
            f"{name}_t{r + 1} AS (SELECT cycle, bin, x, y FROM (SELECT *, avg(res) OVER (PARTITION BY cycle) AS m, stddev_pop(res) OVER (PARTITION BY cycle) AS s FROM {s}_r) WHERE s = 0 OR abs(res - m) < 4 * s QUALIFY count(*) OVER (PARTITION BY cycle) > {degree})",
        ]
    last = f"{name}_f{rounds - 1}"
    return [*out, f"{name}_mse AS (SELECT cycle, avg(res * res) AS mse FROM {last}_r GROUP BY cycle)", f"{name} AS (SELECT cycle, i, value FROM {last})"]


def with_sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _nodes_sql(grid: Grid) -> str:
    nx = grid.x.count
    return f"(SELECT CAST(n AS INT) AS node, n % {nx} AS ix, n // {nx} AS iy, (n % {nx}) * {grid.x.step}e0 AS x, (n // {nx}) * {grid.y.step}e0 AS y FROM (SELECT unnest(range(0, {grid.size})) AS n))"


def smoothed_sql(name: str, known: str, grid: Grid) -> list[str]:
    """CTE `name` (node, x, y, raw, value): known nodes (node, value, error) blended with the cubic, others the cubic; <name>_c its terms."""
    terms = ["x", "x * x", "x * x * x", "y", "y * y", "y * y * y", "x * y"]
    listed = ", ".join(terms)
    return [
        f"{name}_n AS MATERIALIZED (SELECT g.*, k.value, k.error FROM {_nodes_sql(grid)} g LEFT JOIN {known} k ON k.node = g.node)",
        f"{name}_t AS (SELECT node, value, unnest(range(0, 7))::INT AS i, unnest([{listed}]) AS t FROM {name}_n WHERE value IS NOT NULL)",
        f"{name}_m AS (SELECT a.i, b.i AS j, sum(a.t * b.t) AS v FROM {name}_t a JOIN {name}_t b ON a.node = b.node GROUP BY 1, 2)",
        f"{name}_b AS (SELECT i, sum(t * value) AS v FROM {name}_t GROUP BY i)",
        *solved_sql(f"{name}_m", f"{name}_b", f"{name}_c"),
        f"{name}_q AS (SELECT n.node, sum(c.value * [{listed}][c.i + 1]) AS cubic FROM {name}_n n, {name}_c c GROUP BY n.node)",
        f"{name}_p AS (SELECT a.node, b.value AS v, b.error AS e, exp(-((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy))::DOUBLE) / (b.error * b.error) AS w FROM {name}_n a JOIN {name}_n b ON abs(a.ix - b.ix) <= 6 AND abs(a.iy - b.iy) <= 6 AND a.value IS NOT NULL AND b.value IS NOT NULL)",
        f"{name}_s AS (SELECT node, sum(w * e) / sum(w) AS se, sum(w * v) / sum(w) AS sv FROM {name}_p GROUP BY node)",
        f"{name} AS (SELECT n.node, n.x, n.y, n.value AS raw, CASE WHEN s.node IS NULL THEN q.cubic ELSE (1 - s.se / (SELECT max(se) FROM {name}_s)) * s.sv + s.se / (SELECT max(se) FROM {name}_s) * q.cubic END AS value FROM {name}_n n JOIN {name}_q q ON q.node = n.node LEFT JOIN {name}_s s ON s.node = n.node)",
    ]


def evaluated_sql(name: str, rows: str, known: str, grid: Grid, x: str, y: str) -> list[str]:
    """CTE `name`: rows with ssb, the bilinear value of a grid whose nodes are all known."""
    nx, ny = grid.x.count, grid.y.count
    at = ", ".join(f"max(value) FILTER (WHERE node = i + {di} + (j + {dj}) * {nx}) AS v{di}{dj}" for dj in (0, 1) for di in (0, 1))
    return [
        f"{name}_c AS (SELECT node % {nx} AS i, node // {nx} AS j FROM {known})",
        f"{name}_v AS (SELECT i, j, {at} FROM {name}_c, {known} WHERE node - i - j * {nx} IN (0, 1, {nx}, {nx + 1}) GROUP BY i, j)",
        f"{name}_p AS (SELECT *, least(CAST(floor({x} / {grid.x.step}e0) AS INT), {nx - 2}) AS ci, least(CAST(floor({y} / {grid.y.step}e0) AS INT), {ny - 2}) AS cj FROM {rows} WHERE {x} <= {grid.x.last}e0 AND {y} <= {grid.y.last}e0)",
        f"{name} AS (SELECT p.*, v00 * (1 - fx) * (1 - fy) + v10 * fx * (1 - fy) + v01 * (1 - fx) * fy + v11 * fx * fy AS ssb FROM (SELECT *, {x} / {grid.x.step}e0 - ci AS fx, {y} / {grid.y.step}e0 - cj AS fy FROM {name}_p) p JOIN {name}_v v ON v.i = ci AND v.j = cj)",
    ]


# --- direct -------------------------------------------------------------------------------------------------------

_SMALL_W = cells_sql("w", "obs", SMALL, "swh_ku", "wind_speed_alt", "id, cycle, usla_ku AS z")
_SOLVED = [*_SMALL_W, *normal_sql("solved", "w", 5)]


@query("A7_solved_grid", with_sql(_SOLVED, f"SELECT g.node, g.x, g.y, {_r('s.value', 'value')}, {_r('s.error', 'error')}, s.n FROM {_nodes_sql(SMALL)} g LEFT JOIN solved s ON s.node = g.node"))
def _solved(spark, sf_dir):
    solved, _ = lsq.fit(_direct(spark, sf_dir, SMALL), least=5)
    return grids.nodes(spark, SMALL).join(solved, "node", "left").select("node", "x", "y", r6("value").alias("value"), r6("error").alias("error"), "n")


_RESIDUALS = [*_SOLVED, "res AS (SELECT w.id, w.cycle, w.z - sum(w.w * s.value) AS r FROM w JOIN solved s ON s.node = w.node GROUP BY w.id, w.cycle, w.z)"]


@query("O3_post_fit_outliers", with_sql([*_RESIDUALS, *within_sql("kept", "res", "r", "2.2e0", "cycle", 30)], "SELECT id, cycle FROM kept"))
def _post_fit(spark, sf_dir):
    rows = _direct(spark, sf_dir, SMALL)
    solved, _ = lsq.fit(rows, least=5)
    return steps.post_fit(rows, solved, SMALL, 2.2).select("id", "cycle")


_GEO30 = "geo AS (SELECT *, CAST(floor((lat + 105) / 30) AS INT) AS row FROM obs), cell AS (SELECT *, row * 1000 + CAST(floor((lon + 180e0 / cells) / (360e0 / cells)) AS INT) % cells AS geo_cell FROM (SELECT *, CAST(floor(12e0 * cos(radians(row * 30e0 - 90e0))) AS INT) AS cells FROM geo))"
_COMMON = [
    _GEO30,
    "thick AS (SELECT cycle, geo_cell FROM cell GROUP BY 1, 2 HAVING count(*) >= 4)",
    *_SMALL_W,
    "kept AS (SELECT node FROM w GROUP BY node HAVING count(*) >= 5)",
    "e AS MATERIALIZED (SELECT w.*, c.geo_cell FROM w JOIN kept k ON k.node = w.node JOIN cell c ON c.id = w.id JOIN thick t ON t.cycle = c.cycle AND t.geo_cell = c.geo_cell)",
    "groups AS (SELECT cycle, geo_cell, count(*) AS n, sum(z) AS sz FROM (SELECT DISTINCT id, cycle, geo_cell, z FROM e) GROUP BY 1, 2)",
    "sums AS (SELECT cycle, geo_cell, node, sum(w) AS s FROM e GROUP BY 1, 2, 3)",
    "m AS (SELECT i, j, sum(v) AS v FROM (SELECT a.node AS i, b.node AS j, a.w * b.w AS v FROM e a JOIN e b ON a.id = b.id UNION ALL SELECT a.node, b.node, -a.s * b.s / g.n FROM sums a JOIN sums b ON a.cycle = b.cycle AND a.geo_cell = b.geo_cell JOIN groups g ON g.cycle = a.cycle AND g.geo_cell = a.geo_cell) GROUP BY 1, 2)",
    "b AS (SELECT i, sum(v) AS v FROM (SELECT node AS i, w * z AS v FROM e UNION ALL SELECT s.node, -s.s * g.sz / g.n FROM sums s JOIN groups g ON g.cycle = s.cycle AND g.geo_cell = s.geo_cell) GROUP BY i)",
    *solved_sql("m", "b", "x", singular=True),
]


@query("Q3_common_bias", with_sql(_COMMON, f"SELECT i AS node, {_r('value', 'value')}, {_r('error', 'error')} FROM x"))
def _common(spark, sf_dir):
    rows = _direct(spark, sf_dir, SMALL).withColumn("geo_cell", grids.gauss_cell(F.col("lat"), F.col("lon"), 30)).select("id", "cycle", "geo_cell", "z", "nodes")
    solved, _ = steps.common_bias(rows, SMALL, least=5)
    return solved.select("node", r6("value").alias("value"), r6("error").alias("error"))


def _common_rounds(z: str, rounds: int) -> list[str]:
    """CTEs of the same with outliers removed after each solution: x_<k>, and the rows with weights e_<k> that it came from."""
    out = [
        _GEO30,
        *_SMALL_W,
        "kept AS (SELECT node FROM w GROUP BY node HAVING count(*) >= 5)",
        "placed AS MATERIALIZED (SELECT w.*, c.geo_cell FROM w JOIN cell c ON c.id = w.id)",
        "ids_0 AS (SELECT DISTINCT id, cycle, geo_cell FROM placed)",
    ]
    for k in range(rounds + 1):
        out += [
            f"thick_{k} AS (SELECT cycle, geo_cell FROM ids_{k} GROUP BY 1, 2 HAVING count(*) >= 4)",
            f"e_{k} AS MATERIALIZED (SELECT p.* FROM placed p JOIN kept USING (node) JOIN ids_{k} i ON i.id = p.id JOIN thick_{k} t ON t.cycle = p.cycle AND t.geo_cell = p.geo_cell)",
            f"groups_{k} AS (SELECT cycle, geo_cell, count(*) AS n, sum(z) AS sz FROM (SELECT DISTINCT id, cycle, geo_cell, z FROM e_{k}) GROUP BY 1, 2)",
            f"sums_{k} AS (SELECT cycle, geo_cell, node, sum(w) AS s FROM e_{k} GROUP BY 1, 2, 3)",
            f"m_{k} AS (SELECT i, j, sum(v) AS v FROM (SELECT a.node AS i, b.node AS j, a.w * b.w AS v FROM e_{k} a JOIN e_{k} b ON a.id = b.id UNION ALL SELECT a.node, b.node, -a.s * b.s / g.n FROM sums_{k} a JOIN sums_{k} b ON a.cycle = b.cycle AND a.geo_cell = b.geo_cell JOIN groups_{k} g ON g.cycle = a.cycle AND g.geo_cell = a.geo_cell) GROUP BY 1, 2)",
            f"b_{k} AS (SELECT i, sum(v) AS v FROM (SELECT node AS i, w * z AS v FROM e_{k} UNION ALL SELECT s.node, -s.s * g.sz / g.n FROM sums_{k} s JOIN groups_{k} g ON g.cycle = s.cycle AND g.geo_cell = s.geo_cell) GROUP BY i)",
            *solved_sql(f"m_{k}", f"b_{k}", f"x_{k}", singular=True),
        ]
        if k < rounds:
            out += [
                f"res_{k} AS (SELECT p.id, p.cycle, p.z - sum(p.w * x.value) AS r FROM placed p JOIN ids_{k} USING (id) LEFT JOIN x_{k} x ON x.i = p.node GROUP BY p.id, p.cycle, p.z HAVING count(x.value) = count(*))",
                *within_sql(f"sound_{k}", f"res_{k}", "r", z, "cycle", 20),
                f"ids_{k + 1} AS MATERIALIZED (SELECT * FROM ids_{k} WHERE id IN (SELECT id FROM sound_{k}))",
            ]
    return out


@query("Q3_common_bias_rounds", with_sql(_common_rounds("2.8e0", 4), f"SELECT 0 AS cycle, x.i AS key, {_r('x.value', 'value')}, {_r('x.error', 'error')}, count(*) AS n FROM x_4 x JOIN e_4 e ON e.node = x.i GROUP BY x.i, x.value, x.error UNION ALL SELECT cycle, geo_cell, {_r('avg(z - f)', 'value')}, {_r('1 / sqrt(count(*))', 'error')}, count(*) FROM (SELECT e.id, e.cycle, e.geo_cell, e.z, sum(e.w * x.value) AS f FROM e_4 e JOIN x_4 x ON x.i = e.node GROUP BY 1, 2, 3, 4) GROUP BY cycle, geo_cell"))
def _common_bias_rounds(spark, sf_dir):
    """Nodes (as cycle 0) and the cells of each cycle."""
    rows = _direct(spark, sf_dir, SMALL).withColumn("geo_cell", grids.gauss_cell(F.col("lat"), F.col("lon"), 30)).select("id", "cycle", "geo_cell", "lat", "x", "y", "z", "nodes")
    m, cells = steps.fit_common_bias(rows, SMALL, least=5, z=2.8)
    of = lambda d, cycle, key, value: d.select(cycle.alias("cycle"), F.col(key).alias("key"), r6(value).alias("value"), r6("error").alias("error"), "n")
    nodes = of(m.nodes.where("n > 0").withColumn("unlevelled", F.col("raw") + m.bias), F.lit(0), "node", "unlevelled")
    return nodes.unionByName(of(cells, F.col("cycle"), "geo_cell", "value"))


_K = repr(physics.C_HZ**2 / (physics.KU_HZ**2 - physics.C_HZ**2)) + "::DOUBLE"
_TWO = [
    *cells_sql("w", "obs", TINY, "swh_ku", "wind_speed_alt", f"id, usla_ku + iono_corr_gim_ku + range_ku - (1 + {_K}) * range_ku + {_K} * range_c AS zr, iono_corr_gim_ku / {_K} - range_ku + range_c AS zt"),
    f"both_ AS (SELECT 2 * id AS id, node, (1 + {_K}) * w AS w, zr AS z FROM w UNION ALL SELECT 2 * id, node + 9, -{_K} * w, zr FROM w UNION ALL SELECT 2 * id + 1, node, w, zt FROM w UNION ALL SELECT 2 * id + 1, node + 9, -w, zt FROM w)",
    *normal_sql("solved", "both_", 5),
]


@query("M9_two_band_solution", with_sql(_TWO, f"SELECT a.node, {_r('a.value', 'ku')}, {_r('b.value', 'c')}, {_r('a.error', 'error')} FROM solved a JOIN solved b ON b.node = a.node + 9"))
def _two_bands(spark, sf_dir):
    ku, c = steps.two_band_fit(_direct(spark, sf_dir, TINY), TINY, least=5)
    return ku.select("node", F.col("value").alias("ku"), "error").join(c.select("node", F.col("value").alias("c")), "node").select("node", r6("ku").alias("ku"), r6("c").alias("c"), r6("error").alias("error"))


# --- levels -------------------------------------------------------------------------------------------------------

_USLA = "vals AS (SELECT cycle, usla_ku AS v FROM obs)"


@query("L2_zero_significance", with_sql([_USLA, *tail_sql("fit", "vals", "ssb", levels.CUTOFF, "tail", "mid", 3)], f"SELECT f.cycle, {_r('f.value', 'level')}, {_r('m.mse', 'mse')} FROM fit f JOIN fit_mse m ON m.cycle = f.cycle WHERE f.i = 0"))
def _zero(spark, sf_dir):
    rows = levels.levels_by(levels.histogram(observations(spark, sf_dir), F.col("usla_ku"), "ssb", "cycle"))
    return spark.createDataFrame([(int(k), float(v), float(m)) for k, v, m in rows], "cycle int, level double, mse double").select("cycle", r6("level").alias("level"), r6("mse").alias("mse"))


def _cbrt(x: str) -> str:
    return f"sign({x}) * pow(abs({x}), 1e0 / 3e0)"


#: The cubic's roots in closed form; of them the one real root if it is close to the last bin, else that of the nearest real part.
_CUBIC_ROOT = [
    "curve AS (SELECT cycle, " + ", ".join(f"max(value) FILTER (WHERE i = {k}) AS c{k}" for k in range(4)) + " FROM fit GROUP BY cycle)",
    "depressed AS (SELECT *, (3 * c3 * c1 - c2 * c2) / (3 * c3 * c3) AS p, (2 * c2 * c2 * c2 - 9 * c3 * c2 * c1 + 27 * c3 * c3 * c0) / (27 * c3 * c3 * c3) AS q, -c2 / (3 * c3) AS shift FROM curve)",
    "placed AS (SELECT d.*, q * q / 4 + p * p * p / 27 AS disc, t.near FROM depressed d JOIN (SELECT cycle, arg_max(x, bin) AS near FROM fit_t2 GROUP BY cycle) t ON t.cycle = d.cycle)",
    f"one AS (SELECT *, {_cbrt('(-q / 2 + sqrt(greatest(disc, 0)))')} + {_cbrt('(-q / 2 - sqrt(greatest(disc, 0)))')} AS u FROM placed)",
    "roots AS (SELECT cycle, near, disc, unnest(CASE WHEN disc > 0 THEN [shift + u, shift - u / 2] ELSE list_transform([0, 1, 2], lambda k: shift + 2 * sqrt(-p / 3) * cos((acos(greatest(-1e0, least(1e0, 3 * q / (2 * p) * sqrt(-3 / p)))) - 2 * pi() * k) / 3)) END) AS x, unnest(CASE WHEN disc > 0 THEN [1, 0] ELSE [0, 0, 0] END) AS alone FROM one)",
    "chosen AS (SELECT cycle, x, row_number() OVER (PARTITION BY cycle ORDER BY CASE WHEN alone = 1 AND abs(x - near) <= 0.01e0 THEN 0 ELSE 1 END, abs(x - near)) AS place FROM roots)",
]


@query("L3_root_levels", with_sql([_USLA, *tail_sql("fit", "vals", "ssb", levels.CUTOFF, "mid", "tail", 3), *_CUBIC_ROOT], f"SELECT n.cycle, {_r('x', 'level')}, {_r('mse', 'mse')} FROM chosen n JOIN fit_mse m ON m.cycle = n.cycle WHERE place = 1"))
def _roots(spark, sf_dir):
    rows = levels.levels_by(levels.histogram(observations(spark, sf_dir), F.col("usla_ku"), "ssb", "cycle"), flip=False)
    return spark.createDataFrame([(int(k), float(v), float(m)) for k, v, m in rows], "cycle int, level double, mse double").select("cycle", r6("level").alias("level"), r6("mse").alias("mse"))


_LEVEL = [*evaluated_sql("ev", "(SELECT * FROM obs WHERE swh_ku > 0 AND wind_speed_alt > 0)", "solved", SMALL, "swh_ku", "wind_speed_alt"), *within_sql("near", "ev", "ssb", "4e0", "cycle", 10), "vals AS (SELECT cycle, v FROM near)", *tail_sql("fit", "vals", "ssb", levels.CUTOFF, "tail", "mid", 3, 6), "lev AS (SELECT cycle, value AS level FROM fit WHERE i = 0)"]
_LEVELS = [*_SOLVED, *_LEVEL]


@query("L6_model_levels", with_sql(_LEVELS, f"SELECT cycle, {_r('level', 'level')}, {_r('avg(level) OVER ()', 'bias')} FROM lev"))
def _levels(spark, sf_dir):
    rows = _direct(spark, sf_dir, SMALL)
    solved, _ = lsq.fit(rows, least=5)
    by_cycle, bias = steps.level(rows, solved, SMALL)
    return spark.createDataFrame([(int(k), float(v), float(bias)) for k, v, _ in by_cycle if v == v], "cycle int, level double, bias double").select("cycle", r6("level").alias("level"), r6("bias").alias("bias"))


def _iono_sql(seen: str, prefix: str = "") -> list[str]:
    """CTEs <prefix>alt_f and <prefix>gim_f: straight lines through the tails of both TEC histograms of rows (cycle, time, gim, iono)."""
    return [
        f"{prefix}sm AS (SELECT cycle, CASE WHEN n = 21 THEN g END AS gim, CASE WHEN n = 21 THEN m END AS alt FROM (SELECT cycle, avg(iono) OVER w AS m, avg(gim) OVER w AS g, count(*) OVER w AS n FROM {seen} WINDOW w AS (PARTITION BY cycle ORDER BY time ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)))",
        *[f"{prefix}{c}_v AS (SELECT cycle, {c} * ({physics.KU_HZ**2 / -40.3 / 1e16!r}::DOUBLE) AS v FROM {prefix}sm WHERE alt IS NOT NULL)" for c in ("alt", "gim")],
        *[x for c in ("alt", "gim") for x in tail_sql(f"{prefix}{c}_f", f"{prefix}{c}_v", "tec", (1.0, 10.0), "tail", "mid", 1)],
    ]


_WAVE = "-0.2e0 + 0.15e0 * sin(time / 200000e0)"
_SEEN = f"({_WAVE} - 0.03e0 + ((id * 13) % 100) / 2000e0)"
_IONO = [f"io AS (SELECT id, cycle, time, {_WAVE} AS gim, {_SEEN} AS iono FROM obs WHERE swh_ku <= 13 AND wind_speed_alt <= 21)", *_iono_sql("io")]


def _calibrated(spark, found: tuple[list[tuple], float]) -> DataFrame:
    by_cycle, bias = found
    rows = [(int(k), float(a), float(g), float(bias) * physics.TEC_TO_METRES) for k, a, g in by_cycle if a == a and g == g]
    return spark.createDataFrame(rows, "cycle int, alt double, gim double, bias double").select("cycle", *[r6(c).alias(c) for c in ("alt", "gim", "bias")])


def _seen(spark, sf_dir) -> DataFrame:
    """Records with an ionosphere that changes slowly, and a C-band range that shows it with noise and a bias."""
    gim = F.lit(-0.2) + F.lit(0.15) * F.sin(F.col("time") / 200000.0)
    seen = gim - 0.03 + F.pmod(F.col("id") * 13, F.lit(100)) / 2000.0
    return observations(spark, sf_dir).withColumn("iono_corr_gim_ku", gim).withColumn("range_ku", F.lit(0.0)).withColumn("range_c", -seen * (physics.KU_HZ**2 - physics.C_HZ**2) / physics.C_HZ**2)


@query("I2_iono_calibration", with_sql(_IONO, f"SELECT a.cycle, {_r('a.value', 'alt')}, {_r('g.value', 'gim')}, {_r(f'avg(a.value - g.value) OVER () * ({physics.TEC_TO_METRES!r}::DOUBLE)', 'bias')} FROM alt_f a JOIN gim_f g ON g.cycle = a.cycle WHERE a.i = 0 AND g.i = 0"))
def _calibration(spark, sf_dir):
    flat = grids.nodes(spark, GRID).select("node", (F.lit(-0.03) * F.col("x")).alias("value"))
    return _calibrated(spark, steps.iono_calibration(_seen(spark, sf_dir), flat, flat, GRID, max_step=None))


_TO_IONO = f"({physics.C_HZ**2 / (physics.KU_HZ**2 - physics.C_HZ**2)!r}::DOUBLE)"
_IONO_3 = [
    f"io AS (SELECT id, cycle, time, {_WAVE} AS gim, {_SEEN} + {_TO_IONO} * ({_noise_sql('range_rms_ku', 11)} - {_noise_sql('range_rms_ku / 2', 12)} - 0.001e0 * sig0_ku) AS iono FROM obs WHERE swh_ku <= 12.5e0 AND wind_speed_alt <= 21 AND sig0_ku BETWEEN 10 AND 20)",
    *_iono_sql("io"),
    "mid_ AS (SELECT a0.cycle, a0.value + 5.5e0 * a1.value AS alt, g0.value + 5.5e0 * g1.value AS gim FROM alt_f a0 JOIN alt_f a1 ON a1.cycle = a0.cycle AND a1.i = 1 JOIN gim_f g0 ON g0.cycle = a0.cycle AND g0.i = 0 JOIN gim_f g1 ON g1.cycle = a0.cycle AND g1.i = 1 WHERE a0.i = 0)",
]


@query("I2_calibration_3d", with_sql(_IONO_3, f"SELECT cycle, {_r('alt', 'alt')}, {_r('gim', 'gim')}, {_r(f'avg(alt - gim) OVER () * ({physics.TEC_TO_METRES!r}::DOUBLE)', 'bias')} FROM mid_"))
def _calibration_3d(spark, sf_dir):
    """Models of three axes, ranges with random errors, levels at the middle of the cutoff."""
    o = _seen(spark, sf_dir).withColumn("range_rms_c", F.col("range_rms_ku") / 2)
    n = grids.nodes(spark, CUBE)
    ku, c = (n.select("node", v.alias("value")) for v in (F.lit(-0.03) * F.col("x"), F.lit(-0.03) * F.col("x") + F.lit(0.001) * F.col("z")))
    return _calibrated(spark, steps.iono_calibration(o, ku, c, CUBE, ranges=steps.calibration_ranges(err="rms_rws"), depth=F.col("sig0_ku"), midpoint=True, max_step=None))


# --- smoothing ----------------------------------------------------------------------------------------------------

_KNOWN = f"{bins_sql(GRID)}, known AS (SELECT node, value, error FROM bins WHERE node % 11 <> 3)"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of record means, of which some nodes are unknown."""
    return bins(spark, sf_dir, GRID).withColumn("value", F.when(F.col("node") % 11 != 3, F.col("value")))


@query("L7_cubic_fit", with_sql([_KNOWN, *smoothed_sql("sm", "known", GRID)], f"SELECT i AS term, {_r('value', 'c')} FROM sm_c"))
def _cubic(spark, sf_dir):
    c = smooth.cubic_fit(_known(spark, sf_dir))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "term int, c double").select("term", r6("c").alias("c"))


@query("L8_smoothed_grid", with_sql([_KNOWN, *smoothed_sql("sm", "known", GRID)], f"SELECT node, {_r('raw', 'raw')}, {_r('value', 'value')} FROM sm"))
def _smoothed(spark, sf_dir):
    return smooth.smooth(_known(spark, sf_dir), GRID)[0].select("node", r6("raw").alias("raw"), r6("value").alias("value"))




def fitted_sql(name: str, weights: str, least: int, rounds: int) -> list[str]:
    """CTE `name` fitted to weights (id, cycle, node, w, z), rows beyond 5 deviations of their cycle's residuals left out, as often as `rounds`."""
    out, rows = [], weights
    for r in range(rounds):
        out += [
            *normal_sql(f"{name}{r}", rows, least),
            f"{name}{r}_res AS (SELECT w.id, w.cycle, w.z - sum(w.w * s.value) AS res FROM {rows} w LEFT JOIN {name}{r} s ON s.node = w.node GROUP BY w.id, w.cycle, w.z HAVING count(s.value) = count(*))",
            *within_sql(f"{name}{r}_in", f"{name}{r}_res", "res", "5e0", "cycle", 6),
            f"{name}{r}_rows AS MATERIALIZED (SELECT * FROM {weights} WHERE id IN (SELECT id FROM {name}{r}_in))",
        ]
        rows = f"{name}{r}_rows"
    return [*out, *normal_sql(name, rows, least)]


_FITTED = [*_SMALL_W, *fitted_sql("solved", "w", 5, 3), *_LEVEL, "shifted AS (SELECT node, value - (SELECT avg(level) FROM lev) AS value, error, n FROM solved)", *smoothed_sql("sm", "shifted", SMALL)]


@query("Q3_fitted_model", with_sql(_FITTED, f"SELECT m.node, m.x, m.y, {_r('m.raw', 'raw')}, {_r('m.value', 'value')}, {_r('s.error', 'error')}, s.n FROM sm m LEFT JOIN shifted s ON s.node = m.node"))
def _fitted(spark, sf_dir):
    rows = _direct(spark, sf_dir, SMALL).select("id", "cycle", "lat", "lon", "x", "y", "z", "nodes")
    m = steps.fit_model(rows, SMALL, least=5)
    return m.nodes.select("node", "x", "y", r6("raw").alias("raw"), r6("value").alias("value"), r6("error").alias("error"), "n")


# --- pairs --------------------------------------------------------------------------------------------------------


def _bm3_sql(x: str, y: str) -> str:
    return f"{x} * (0.0036e0 - 0.0045e0 * {y} + 0.00019e0 * {y} * {y})"


_T_WIND = "((id * 53) % 2100) / 100e0"
#: DuckDB: tracks with wind and uncorrected height; and each record again one cycle later, some metres off, with other waves and wind.
_FULL = f"full_ AS (SELECT id, cycle, pass_number, time, lat, lon, swh_ku, {_T_WIND} AS wind_speed_alt, {_bm3_sql('swh_ku', '(' + _T_WIND + ')')} + ((id * 17) % 100) / 10000e0 AS usla_ku FROM tracks)"
_AGAIN = "again AS (SELECT * FROM full_ UNION ALL SELECT id + 10000000, cycle + 1, pass_number, time + 864000e0, lat + ((id % 7) - 3) / 1000e0, lon, s, w, " + _bm3_sql("s", "w") + " + ((id * 19) % 100) / 10000e0 FROM (SELECT *, ((id * 61 + 7) % 1250) / 100e0 AS s, ((id * 71 + 3) % 2100) / 100e0 AS w FROM full_))"


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("wind_speed_alt", F.pmod(F.col("id") * 53, F.lit(2100)) / 100.0)
    return t.withColumn("usla_ku", physics.bm3(F.col("swh_ku"), F.col("wind_speed_alt")) + F.pmod(F.col("id") * 17, F.lit(100)) / 10000.0)


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _full(spark, sf_dir)
    later = t.select((F.col("id") + 10000000).alias("id"), (F.col("cycle") + 1).alias("cycle"), "pass_number", (F.col("time") + 864000.0).alias("time"), (F.col("lat") + (F.pmod("id", F.lit(7)) - 3) / 1000.0).alias("lat"), "lon", (F.pmod(F.col("id") * 61 + 7, F.lit(1250)) / 100.0).alias("swh_ku"), (F.pmod(F.col("id") * 71 + 3, F.lit(2100)) / 100.0).alias("wind_speed_alt"), (F.pmod(F.col("id") * 19, F.lit(100)) / 10000.0).alias("noise"))
    later = later.withColumn("usla_ku", physics.bm3(F.col("swh_ku"), F.col("wind_speed_alt")) + F.col("noise")).drop("noise")
    columns = ["id", "cycle", "pass_number", "time", "lat", "lon", "swh_ku", "wind_speed_alt", "usla_ku"]
    return t.select(*columns).unionByName(later.select(*columns))


def difference_sql(name: str, pairs: str, grid: Grid, keep: str) -> list[str]:
    """CTE `name` (id, node, w, keep): weights of pairs (id, sa, wa, sb, wb, ...) that lie in the grid on both sides, a node once."""
    return [
        *cells_sql(f"{name}_a", pairs, grid, "sa", "wa", f"id, {keep}"),
        *cells_sql(f"{name}_b", pairs, grid, "sb", "wb", f"id, {keep}", "-1e0"),
        f"{name}_u AS (SELECT * FROM {name}_a WHERE id IN (SELECT id FROM {name}_b_1) UNION ALL SELECT * FROM {name}_b WHERE id IN (SELECT id FROM {name}_a_1))",
        f"{name} AS (SELECT id, node, {keep}, sum(w) AS w FROM {name}_u GROUP BY id, node, {keep} HAVING abs(sum(w)) > 1e-12)",
    ]


_COL_CTES = [_FULL, _AGAIN, _COLLINEAR.replace("90000", "1000").replace("FROM obs)", "FROM again)").removeprefix("WITH ").strip()]
_COL_PAIRS = "cp AS (SELECT m.a AS id, p.cycle, p.swh_ku AS sa, p.wind_speed_alt AS wa, q.swh_ku AS sb, q.wind_speed_alt AS wb, p.usla_ku - q.usla_ku AS z, 1e0 AS weight, 230e0 * exp(-abs((p.time - q.time) / 86400e0) / 3e0) + 120e0 AS timed FROM m JOIN again p ON p.id = m.a JOIN again q ON q.id = m.b)"
_X_CTES = [
    _FULL,
    _CROSS.removeprefix("WITH ").strip(),
    "xp AS (SELECT row_number() OVER (ORDER BY x.a0, x.a1, x.d0, x.d1) AS id, x.a0, x.a1, x.d0, x.d1, " + ", ".join(f"{c}0.{v} * p{s}0 + {c}1.{v} * p{s}1 AS {o}{t}" for s, c, t in (("a", "ta", "a"), ("d", "td", "b")) for v, o in (("swh_ku", "s"), ("wind_speed_alt", "w"), ("usla_ku", "u"))) + ", 230e0 * exp(-abs((time_a - time_d) / 86400e0) / 3e0) + 120e0 AS weight FROM crossings x JOIN full_ ta0 ON ta0.id = a0 JOIN full_ ta1 ON ta1.id = a1 JOIN full_ td0 ON td0.id = d0 JOIN full_ td1 ON td1.id = d1)",
    "xq AS (SELECT *, ua - ub AS z FROM xp)",
]


def _moment():
    """Weights times node numbers, summed over a row."""
    return F.aggregate("nodes", F.lit(0.0), lambda s, e: s + e["w"] * (e["node"] + 1))


@query("Q2_collinear_rows", with_sql([*_COL_CTES, _COL_PAIRS, *difference_sql("cw", "cp", GRID, "z")], f"SELECT id, {_r('z', 'z')}, {_r('sum(w * (node + 1))', 'moment')}, count(*) AS nodes FROM cw GROUP BY id, z"))
def _collinear_rows(spark, sf_dir):
    p = steps.collinear_rows(_again(spark, sf_dir), GRID)
    return p.select(F.col("id_a").alias("id"), r6("z").alias("z"), r6(_moment()).alias("moment"), F.size(F.filter("nodes", lambda e: F.abs(e["w"]) > 1e-12)).cast("long").alias("nodes")).where("nodes > 0")


@query("Q2_crossover_rows", with_sql([*_X_CTES, *difference_sql("xw", "xq", GRID, "a0, a1, d0, d1, z, weight")], f"SELECT a0, a1, d0, d1, {_r('z', 'z')}, {_r('weight', 'weight')}, {_r('sum(w * (node + 1))', 'moment')}, count(*) AS nodes FROM xw GROUP BY a0, a1, d0, d1, z, weight"))
def _crossover_rows(spark, sf_dir):
    r = steps.crossover_rows(_full(spark, sf_dir), GRID, radius=400000.0, max_days=3.0)
    return r.select("a0", "a1", "d0", "d1", r6("z").alias("z"), r6("weight").alias("weight"), r6(_moment()).alias("moment"), F.size(F.filter("nodes", lambda e: F.abs(e["w"]) > 1e-12)).cast("long").alias("nodes"))


_JOINT = [
    *_X_CTES,
    *_COL_CTES[1:],
    _COL_PAIRS,
    *difference_sql("xw", "xq", TINY, "z, weight"),
    *difference_sql("cw", "cp", TINY, "z, timed"),
    "jw AS (SELECT id, node, z, weight, w FROM xw UNION ALL SELECT -1 - id, node, z, timed, w FROM cw)",
]


def _both(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [steps.crossover_rows(_full(spark, sf_dir), TINY, radius=400000.0, max_days=3.0), steps.collinear_rows(_again(spark, sf_dir), TINY, timed=True)]


@query("J15_joint_system", with_sql(_JOINT, f"SELECT node AS i, {_r('sum(w * z * weight)', 'v')} FROM jw GROUP BY node"))
def _joint(spark, sf_dir):
    return lsq.normal_vector(steps.joint(*_both(spark, sf_dir)), weight=F.col("weight")).select("i", r6("v").alias("v"))


def _raw(m: steps.Model) -> DataFrame:
    """A model's raw grid about its own mean, as differences know no level."""
    mean = m.nodes.agg(F.avg("raw").alias("mean"))
    return m.nodes.join(F.broadcast(mean), F.lit(True)).where("raw is not null").select("node", r6(F.col("raw") - F.col("mean")).alias("value"), r6("error").alias("error"), "n")


def _levelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _direct(spark, sf_dir, TINY).select("id", "cycle", "lat", "x", "y", "z", "nodes")


_SELECT = f"SELECT node, {_r('value', 'value')}, {_r('error', 'error')}, n FROM solved"


@query("Q3_collinear", with_sql([*_COL_CTES, _COL_PAIRS, *difference_sql("cw", "cp", TINY, "z, weight"), *normal_sql("solved", "cw", 3, weight="weight", singular=True)], _SELECT))
def _fit_collinear(spark, sf_dir):
    return _raw(steps.fit_pairs([steps.collinear_rows(_again(spark, sf_dir), TINY)], _levelling(spark, sf_dir), TINY, least=3))


@query("Q3_crossover", with_sql([*_X_CTES, *difference_sql("xw", "xq", TINY, "z, weight"), *normal_sql("solved", "xw", 3, weight="weight", singular=True)], _SELECT))
def _fit_crossover(spark, sf_dir):
    return _raw(steps.fit_pairs([steps.crossover_rows(_full(spark, sf_dir), TINY, radius=400000.0, max_days=3.0)], _levelling(spark, sf_dir), TINY, least=3))


@query("Q3_joint", with_sql([*_JOINT, *normal_sql("solved", "jw", 3, weight="weight", singular=True)], _SELECT))
def _fit_joint(spark, sf_dir):
    return _raw(steps.fit_pairs(_both(spark, sf_dir), _levelling(spark, sf_dir), TINY, least=3))
