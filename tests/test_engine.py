"""Operators of the bias engine on hand-made frames: edges, missing values, algebra, and dense references."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import geodesy, physics, variables
from tidemark.operators import design, evaluate, filters, levels, lsq, match, outliers, smooth, triangles, windows
from tidemark.operators import grid as grids
from tidemark.operators.grid import Axis, Grid
from tidemark.plans import registered, steps
from tidemark.plans.fixture import observations
from tidemark.sources import catalog, limits, missions, tables

G = Grid(Axis(0.0, 1.0, 5), Axis(0.0, 2.0, 4))


def _dense(rows, size):
    h = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        for e in r.nodes:
            h[i, e["node"]] += e["w"]
    return h


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1 + i % 3, float(x), float(y), float(math.sin(x) + y)) for i, (x, y) in enumerate(zip(rng.uniform(0, 4, 200), rng.uniform(0, 6, 200), strict=True))]
    df = spark.createDataFrame(rows, "id long, cycle int, x double, y double, z double")
    return df.withColumn("nodes", design.weights(G, F.col("x"), F.col("y"))).where("nodes is not null").cache()


def test_weights_at_edges(spark):
    rows = [(1.0, 2.0), (0.0, 1.0), (4.0, 6.0), (4.5, 1.0), (None, 1.0), (float("nan"), 1.0), (0.5, 1.0)]
    df = filters.measured(spark.createDataFrame(rows, "x double, y double"))
    got = [r.n for r in df.select(design.weights(G, F.col("x"), F.col("y")).alias("n")).collect()]
    assert got[1] is None and got[3] is None and got[4] is None and got[5] is None
    assert {e["node"]: e["w"] for e in got[0] if e["w"]} == {6: 1.0}  # on a node: right-closed cell
    assert {e["node"]: e["w"] for e in got[2] if e["w"]} == {19: 1.0}
    assert {e["node"]: e["w"] for e in got[6]} == {0: 0.25, 1: 0.25, 5: 0.25, 6: 0.25}


def test_weights_add_up(small):
    total = F.aggregate("nodes", F.lit(0.0), lambda s, e: s + e["w"])
    assert small.where(F.abs(total - 1) > 1e-12).count() == 0
    a = small.select("id", F.col("nodes").alias("a"))
    b = small.select((F.col("id") - 1).alias("id"), F.col("nodes").alias("b"))
    pair = a.join(b, "id").select(design.difference(F.col("a"), F.col("b")).alias("nodes"))
    assert pair.where(F.abs(total) > 1e-12).count() == 0
    assert pair.where(F.size("nodes") != F.size(F.array_distinct(F.transform("nodes", lambda e: e["node"])))).count() == 0


def test_normal_equations_against_dense(small):
    rows = small.collect()
    h, z = _dense(rows, G.size), np.array([r.z for r in rows])
    w = np.array([1.0 + r.id % 4 for r in rows])
    weight = (F.lit(1.0) + F.pmod("id", F.lit(4))).cast("double")
    for df in (small, small.repartition(7)):
        m = {(r.i, r.j): r.v for r in lsq.normal_matrix(df, weight=weight).collect()}
        a = h.T @ (w[:, None] * h)
        assert all(abs(a[i, j] - m.get((i, j), 0.0)) < 1e-9 for i in range(G.size) for j in range(i, G.size))
        v = {r.i: r.v for r in lsq.normal_vector(df, weight=weight).collect()}
        assert np.allclose([v.get(i, 0.0) for i in range(G.size)], h.T @ (w * z))
    assert np.linalg.eigvalsh(a).min() > -1e-9


def test_fit_recovers_known_bias(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("x", F.col("swh_ku")).withColumn("y", F.col("wind_speed_alt")).withColumn("z", physics.bm3(F.col("swh_ku"), F.col("wind_speed_alt")))
    grid = Grid(Axis(0.0, 2.5, 6), Axis(0.0, 3.5, 7))
    rows = o.withColumn("nodes", design.weights(grid, F.col("x"), F.col("y"))).where("nodes is not null")
    solved, lacking = lsq.fit(rows, least=5)
    got = grids.nodes(spark, grid).join(solved, "node").withColumn("known", physics.bm3(F.col("x"), F.col("y"))).collect()
    assert not lacking and len(got) == grid.size
    assert max(abs(r.value - r.known) for r in got) < 2e-2


def test_thin_nodes_and_rank(spark, small):
    solved, _ = lsq.fit(small, least=30)
    kept = {r.node for r in lsq.kept_nodes(small, 30).collect()}
    assert {r.node for r in solved.collect()} == kept
    rows, ids = lsq.consistent(small.withColumn("nodes", F.filter("nodes", lambda e: e["w"] != 0)), 25)
    assert rows.where(~F.forall("nodes", lambda e: e["node"].isin(ids))).count() == 0
    none, lacking = lsq.fit(small.limit(0), least=1)
    assert lacking and none.count() == 0
    x, _, lacking = lsq.solve(np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([2.0, 2.0]))
    assert lacking and np.allclose(x, [1, 1])
    assert lsq.touching(small, None).count() == small.count()


def test_consistent_goes_on_to_the_end(spark):
    rows = [(i, [(i, 1.0), (i + 1, 1.0)]) for i in range(34)] + [(100, [(34, 1.0), (35, 1.0)]), (101, [(34, 1.0), (35, 1.0)])]
    df = spark.createDataFrame(rows, "id int, nodes array<struct<node int, w double>>").coalesce(1)
    left, ids = lsq.consistent(df, 2)  # the chain loses one row a round
    assert ids == [34, 35] and sorted(r.id for r in left.collect()) == [100, 101]


def test_consistent_in_every_cycle_at_once(spark, monkeypatch):
    """Each cycle as if alone, also the one without a number; a cycle at rest is not counted again."""
    chain = [(i, [(i, 1.0), (i + 1, 1.0)]) for i in range(9)] + [(100, [(9, 1.0), (10, 1.0)]), (101, [(9, 1.0), (10, 1.0)])]
    full = [(200 + i, [(0, 0.5), (1, 0.5)]) for i in range(4)]
    rows = [(7, *r) for r in chain] + [(8, *r) for r in full] + [(None, *r) for r in chain[:3] + chain[-2:]] + [(7, 300, None), (8, 301, [])]
    df = spark.createDataFrame(rows, "cycle int, id int, nodes array<struct<node int, w double>>").withColumn("n", F.lit("x"))
    plain, counted = lsq.node_counts, []

    def watched(part, *by):
        counted.append(sorted((r[0] is None, r[0]) for r in part.select("cycle").distinct().collect()))
        return plain(part, *by)

    monkeypatch.setattr(lsq, "node_counts", watched)
    got = lsq.consistent_by(df, 2, "cycle")
    monkeypatch.undo()
    assert len(counted) > 4 and (False, 8) in counted[0] and all((False, 8) not in c for c in counted[1:])
    assert got.columns == df.columns
    for cycle, alone in ((7, chain), (8, full), (None, chain[:3] + chain[-2:])):
        want, _ = lsq.consistent(spark.createDataFrame(alone, "id int, nodes array<struct<node int, w double>>"), 2)
        here = got.where(F.col("cycle").eqNullSafe(F.lit(cycle).cast("int")) & (F.size("nodes") > 0))
        assert sorted(r.id for r in here.collect()) == sorted(r.id for r in want.collect())
    assert [r.id for r in got.where("size(nodes) = 0").collect()] == [301]
    bins = {r.node: (r.n, r.cycles) for r in lsq.cycle_bins(df, 4).collect()}  # a minimum of 4 / 3 in each cycle
    assert bins[9] == (4, 2) and bins[0] == (4, 1) and 5 not in bins
    assert lsq.consistent_by(df.limit(0), 2, "cycle").count() == 0 and lsq.cycle_bins(df.limit(0), 5).count() == 0


def test_lost_fit_goes_on(spark, sf_dir, monkeypatch, tmp_path):
    """A fit stopped after its first round ends with the same grid, and a fit that had ended removes nothing again."""
    rows = registered._direct(spark, sf_dir, registered.SMALL).select("id", "cycle", "lat", "lon", "x", "y", "z", "nodes")
    rows = rows.withColumn("z", F.col("z") + F.when(F.col("id") % 97 == 5, 40.0 * (1 + F.col("id") % 3)).otherwise(0.0))
    fit = lambda state: steps.fit_model(rows, registered.SMALL, least=5, by_cycle=True, state=state)
    whole, state, plain, calls = fit(None), f"file://{tmp_path}/fit", steps.post_fit, []

    def stops(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return plain(*a)

    monkeypatch.setattr(steps, "post_fit", stops)
    with pytest.raises(RuntimeError, match="lost"):
        fit(state)
    resumed = fit(state)
    assert whole.rounds > 2 and len(calls) == whole.rounds + 1
    again = fit(state)
    assert len(calls) == whole.rounds + 1
    want = {r.node: r for r in whole.nodes.collect()}
    for m in (resumed, again):
        assert m.rounds == whole.rounds
        for r in m.nodes.collect():
            assert r.n == want[r.node].n and (r.value is None) == (want[r.node].value is None) and (r.value is None or abs(r.value - want[r.node].value) < 1e-9)
    with pytest.raises(ValueError, match="not both"):
        steps.fit_model(rows, registered.SMALL, by_cycle=True, complete_rows=True)


def test_outlier_rounds_go_on_to_the_end(spark):
    v = np.r_[10.0 ** np.arange(24)]  # the largest goes in each round
    got = outliers.bounds(spark.createDataFrame([(float(x),) for x in v], "v double").coalesce(1), F.col("v"), 3.0, rounds=3).first()
    while (kept := v[np.abs(v - v.mean()) <= 3 * v.std()]).size < v.size:
        v = kept
    assert got.n == v.size and abs(got.hi - (v.mean() + 3 * v.std())) < 1e-6 * got.hi


def test_planes_against_dense(spark):
    """Solution and formal errors plane by plane are those of the dense system; distant planes, and missing rank, are refused."""
    rng = np.random.default_rng(3)
    cube = Grid(Axis(0.0, 1.0, 4), Axis(0.0, 1.0, 3), Axis(0.0, 1.0, 5))
    rows = [(i, *map(float, p), float(rng.normal())) for i, p in enumerate(rng.uniform([0, 0, 0], [3, 2, 4], (900, 3)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, d double, z double")
    df = df.withColumn("nodes", design.weights(cube, F.col("x"), F.col("y"), F.col("d"))).where("nodes is not null")
    solved, _ = lsq.fit(df, least=3, grid=cube)
    want = {r.node: (r.value, r.error, r.n) for r in solved.collect()}
    most = lsq.DENSE_NODES
    try:
        lsq.DENSE_NODES = 20
        got, lacking = lsq.fit(df, least=3, grid=cube)
        got = {r.node: (r.value, r.error, r.n) for r in got.collect()}
        assert not lacking and got.keys() == want.keys() and len(got) > 50
        assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
        with pytest.raises(ValueError, match="grid must be given"):
            lsq.fit(df, least=3)
        pairs = df.alias("p").join(df.select((F.col("id") - 1).alias("k"), F.col("nodes").alias("o")).alias("q"), F.col("id") == F.col("k")).select("z", design.difference(F.col("nodes"), F.col("o")).alias("nodes"))
        with pytest.raises(ValueError, match="distant planes"):
            lsq.fit(pairs, least=3, grid=cube)
        smoothed, _ = smooth.smooth(lsq.fit(df, least=3, grid=cube)[0], cube)
        c = smooth.cubic_fit(grids.nodes(spark, cube).join(solved.select("node", "value"), "node"), with_z=True)
        cubic = sum(k * t for k, t in zip(c, smooth.cubic_terms(F.col("x"), F.col("y"), F.col("z")), strict=True))
        assert smoothed.where(F.abs(F.col("value") - cubic) > 0.01).count() > 20
    finally:
        lsq.DENSE_NODES = most
    with pytest.raises(ValueError, match="no formal error"):
        smooth.smooth(solved.withColumn("error", F.lit(None).cast("double")), cube)


def test_systems_without_a_level():
    """Differences know no level: the solution of least norm, whatever rounding makes of the last pivot."""
    h = np.array([[1.0, -1.0, 0.0], [0.0, 1.0, -1.0], [1.0, 0.0, -1.0]]) / 3
    a, b = h.T @ h, h.T @ np.array([1.0, 2.0, 3.0])
    for shake in (0.0, 1e-15, -1e-15):
        x, error, lacking = lsq.solve(a + shake * np.eye(3), b)
        assert lacking and np.allclose(x, np.linalg.pinv(a) @ b, atol=1e-6) and np.allclose(error, np.sqrt(np.diag(np.linalg.pinv(a))), atol=1e-6)


def test_group_levels_are_eliminated(small):
    rows = small.collect()
    h, z = _dense(rows, G.size), np.array([r.z for r in rows])
    d = np.eye(3)[[r.cycle - 1 for r in rows]]
    project = np.eye(len(rows)) - d @ np.linalg.inv(d.T @ d) @ d.T
    matrix, vector = lsq.demeaned(small, "cycle")
    a, b = lsq.dense(matrix, vector, list(range(G.size)))
    assert np.allclose(a, h.T @ project @ h) and np.allclose(b, h.T @ project @ z)


def test_outliers(spark):
    rows = [(i, float(i % 10)) for i in range(100)] + [(100, 1e6), (101, 500.0), (102, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    assert {r.id for r in outliers.without_outliers(df, F.col("v"), 3.0).collect()} == set(range(100))
    flat = spark.createDataFrame([(i, 5.0) for i in range(5)], "id long, v double")
    assert outliers.without_outliers(flat, F.col("v"), 3.0).count() == 5
    pair = df.where("id < 102").withColumn("w", F.when(F.col("id") == 7, 1e6).otherwise(F.col("v")))
    kept = {r.id for r in outliers.without_pair_outliers(pair, F.col("v"), F.col("w"), 3.0).collect()}
    assert kept == set(range(100)) - {7}


def test_moving_mean(spark):
    rows = [(1, float(t), float(t * t)) for t in range(20)] + [(2, float(5 * t), 1.0) for t in range(9)]
    df = spark.createDataFrame(rows, "cycle int, time double, v double")
    got = windows.moving_mean(df, "v", 5, "cycle").where("cycle = 1").orderBy("time").collect()
    want = np.convolve(np.arange(20.0) ** 2, np.ones(5) / 5, "valid")
    assert [r.smooth for r in got[2:-2]] == pytest.approx(want) and got[1].smooth is None and got[-2].smooth is None
    assert windows.moving_mean(df, "v", 5, "cycle").where("cycle = 2 and smooth is not null").count() == 0  # steps too long
    assert windows.moving_mean(df, "v", 5, "cycle", cut=True).count() == 16


def test_radius_join_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(0, 360, 300), strict=True))]
    pts += [(900, 0.0, 359.99), (901, 0.0, 0.01), (902, 89.99, 10.0), (903, 89.99, 190.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.id_a, r.id_b) for r in match.radius_join(df, df, 700e3).collect()}
    phi, lam = np.radians([p[1] for p in pts]), np.radians([p[2] for p in pts])
    n = geodesy.SEMI_MAJOR / np.sqrt(1 - geodesy.ECCENTRICITY_SQUARED * np.sin(phi) ** 2)
    x = np.stack([n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - geodesy.ECCENTRICITY_SQUARED) * np.sin(phi)], 1)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 700e3
    assert got == {(pts[i][0], pts[j][0]) for i, j in zip(*np.nonzero(near), strict=True)}


@pytest.mark.parametrize("name, km", [("J1_radius_join", 100), ("J2_nearest_match", 200)])
def test_pairs_of_all_cycles_against_brute_force(spark, sf_dir, name, km):
    p = observations(spark, sf_dir).select("id", "cycle", "pass_number", "lat", "lon").toPandas()
    xyz = np.stack(match.with_position(observations(spark, sf_dir)).select("px", "py", "pz").toPandas().to_numpy().T, 1)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    up = p.pass_number.to_numpy() % 2 == 1
    near = (d <= km * 1000) & up[:, None] & ~up[None]
    want = {(int(p.id[i]), int(p.id[j])): d[i, j] for i, j in zip(*np.nonzero(near), strict=True)}
    if name.startswith("J2"):
        best = {}
        for (a, b), x in want.items():
            best[a] = min(best.get(a, (x, b)), (x, b))
        want = {(a, b): x for a, (x, b) in best.items()}
    got = {(r.a, r.b): r.km for r in registry.queries()[name](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k] / 1000) < 1e-5 for k in got)
    cycle = dict(zip(p.id, p.cycle, strict=True))
    assert {cycle[a] for a, _ in got} == set(p.cycle) and len(set(p.cycle)) > 1


def test_orbit_of_all_cycles(spark, sf_dir):
    got = {r.id for r in registry.queries()["S15_orbit_join"](spark, sf_dir).collect()}
    assert got == {r.id for r in observations(spark, sf_dir).select("id").collect()}


def _slow_nearest(rows, k=2):
    return {(a, b, i + 1) for a, x, y in rows for i, (_, b) in enumerate(sorted((abs(x - v) + abs(y - w), b) for b, v, w in rows if b != a)[:k])}


def test_nearest_values_against_brute_force(spark, sf_dir):
    rng = np.random.default_rng(2)
    crowded = [(i, 0.01 * float(rng.integers(0, 5)), float(rng.integers(0, 3))) for i in range(150)]  # many equal rows
    far = [(200 + i, 2.0**i, -(3.0**i)) for i in range(12)]
    tight = [(300 + i, *map(float, rng.normal(5, 1e-6, 2))) for i in range(150)]
    for rows in (crowded + far + tight, crowded, far[:3], far[:2], far[:1], [(1, 4.0, 4.0), (2, 4.0, 4.0)], []):
        df = spark.createDataFrame([*rows, (999, None, 1.0)], "id long, u double, v double").repartition(3)
        got = [(r.a, r.b, r.k) for r in match.nearest_values(df, "u", "v", crowd=8).collect()]
        assert len(got) == len(set(got)) and set(got) == _slow_nearest(rows)


def test_two_nearest_and_rollup_read_everything(spark, sf_dir):
    o = [(r.id, r.swh_ku, r.wind_speed_alt) for r in observations(spark, sf_dir).collect()]
    got = {(r.a, r.b, r.k) for r in registry.queries()["NEAREST_values"](spark, sf_dir).collect()}
    assert got == _slow_nearest(o) and len(got) == 2 * len(o)
    totals = [r.n for r in registry.queries()["ROLLUP_quality"](spark, sf_dir).where("pass_number <> -1").collect()]
    assert sum(totals) == len(o)


def test_one_to_one(spark):
    rows = [(1, 10, 50.0), (2, 10, 850.0), (3, 11, 300.0), (3, 12, 310.0), (4, 13, 930.0)]
    df = spark.createDataFrame(rows, "id_a long, id_b long, dist double")
    got = {(r.id_a, r.id_b) for r in match.one_to_one(df, 1000.0).collect()}
    assert got == {(1, 10), (3, 11)}  # 10 is shared from 850 m on, so the radius shrinks to 800 m
    assert match.one_to_one(df.where("id_a <> 2"), 1000.0).count() == 3


def test_shared_partners_shrink_their_own_group_only(spark):
    """Two records of cycle 1 share a partner; a pair of cycles 3 and 4, and one of another direction, stay."""
    rows = [(1, 1, 1, 0.0, 0.0), (2, 1, 1, 0.0, 0.004), (3, 2, 1, 0.0, 0.002), (4, 1, 2, 10.0, 0.0), (5, 2, 2, 10.0, 0.008), (6, 3, 1, 20.0, 0.0), (7, 4, 1, 20.0, 0.008), (8, 3, 3, 30.0, 0.0), (9, 4, 3, 30.0, 0.0)]
    pts = spark.createDataFrame([(i, c, p, 1000.0 * i, a, o) for i, c, p, a, o in rows], "id long, cycle int, pass_number int, time double, lat double, lon double")
    got = {(r.id_a, r.id_b) for r in match.collinear(pts, 1000.0).collect()}
    assert got == {(4, 5), (6, 7), (8, 9)}
    assert {(r.id_a, r.id_b) for r in match.tandem(pts, pts, [(1, 2), (3, 4)], 950.0).collect()} == {(4, 5), (6, 7), (8, 9)}
    pair = lambda i, c, a, o, a2, o2: (i, c, 1, 0.0, a, o, 3, 0.0, a2, o2)
    schema = "id long, cycle int, pass_number_1 int, time_1 double, lat_1 double, lon_1 double, pass_number_2 int, time_2 double, lat_2 double, lon_2 double"
    a = spark.createDataFrame([pair(1, 1, 0.0, 0.0, 5.0, 5.0), pair(2, 1, 1.0, 1.0, 6.0, 6.0)], schema)
    b = spark.createDataFrame([pair(11, 2, 0.0, 0.001, 5.0, 5.001), pair(12, 2, 1.0, 1.001, 9.0, 9.0), pair(13, 2, 3.0, 3.0, 6.0, 6.001)], schema)
    assert [(r.id_a, r.id_b) for r in match.tandem_pairs(a, b, [(1, 2)]).collect()] == [(1, 11)]


def test_crossing_of_two_segments(spark):
    up = [(i, 1, 1, 1000.0 + i, -0.15 + 0.1 * i, 10.0 + 0.05 * i) for i in range(4)]
    down = [(10 + i, 1, 2, 50_000.0 + i, 0.15 - 0.1 * i, 10.0 + 0.05 * i) for i in range(4)]
    pts = spark.createDataFrame(up + down, "id long, cycle int, pass_number int, time double, lat double, lon double")
    got = match.crossovers(pts, radius=15_000.0).collect()
    assert [(r.a0, r.a1, r.d0, r.d1) for r in got] == [(1, 2, 11, 12)]
    assert got[0].lat == pytest.approx(0.0, abs=1e-9) and got[0].lon == pytest.approx(10.075) and got[0].pa0 == pytest.approx(0.5, abs=1e-6)
    v = match.crossover_values(match.crossovers(pts, radius=15_000.0), pts, ["lat", "time"]).first()
    assert v.a.time == pytest.approx(1001.5) and v.d.time == pytest.approx(50_001.5)
    assert match.crossovers(pts, radius=15_000.0, max_days=0.5).count() == 0
    assert match.crossovers(pts.withColumn("lat", F.when(F.col("pass_number") == 2, F.abs("lat") + 1.0).otherwise(F.col("lat"))), radius=300_000.0).count() == 0  # all above
    again = match.crossovers(pts.union(pts.where("false")), radius=15_000.0)
    assert again.count() == again.dropDuplicates(["a0", "a1", "d0", "d1"]).count()


def test_gauss_grid_covers_the_sphere(spark):
    cells = grids.gauss_grid(spark, 3).collect()
    assert len(cells) == 4558 and abs(sum(c.area for c in cells) / (4 * math.pi) - 1) < 2e-3
    pts = [(90.0, 5.0), (-90.0, 300.0), (0.0, 359.9), (0.0, 0.1), (0.0, -0.1), (None, 1.0)]
    got = [r.c for r in spark.createDataFrame(pts, "lat double, lon double").select(grids.gauss_cell(F.col("lat"), F.col("lon")).alias("c")).collect()]
    assert got[2] == got[3] == got[4] and got[0] // 1000 == 60 and got[1] == 0 and got[5] is None


def test_evaluation(spark):
    full = grids.nodes(spark, G).select("node", (F.col("x") * 2 + F.col("y")).alias("value"))
    at = [(0.0, 0.0), (4.0, 6.0), (1.5, 3.3), (4.1, 1.0), (2.0, 2.0), (None, 1.0)]
    df = spark.createDataFrame(at, "x double, y double")
    got = [r.v for r in df.select(evaluate.bilinear(evaluate.node_array(full, G), G, F.col("x"), F.col("y")).alias("v")).collect()]
    assert got[:3] == pytest.approx([0.0, 14.0, 6.3]) and got[3] is None and got[4] == pytest.approx(6.0) and got[5] is None
    holed = evaluate.node_array(full.where("node <> 6"), G)  # node 6 is (1, 2)
    pts = spark.createDataFrame([(0.2, 0.3), (0.9, 1.9), (3.5, 5.0)], "x double, y double")
    got = [r.v for r in pts.select(evaluate.bilinear(holed, G, F.col("x"), F.col("y")).alias("v")).collect()]
    assert got[0] == pytest.approx(0.7) and got[1] is None and got[2] == pytest.approx(12.0)


def test_kernel_smoothing_against_dense(spark):
    rng = np.random.default_rng(2)
    values = [None if i % 7 == 3 else float(v) for i, v in enumerate(rng.normal(size=G.size))]
    errors = rng.uniform(0.1, 0.5, G.size)
    solved = spark.createDataFrame([(i, v, float(e)) for i, (v, e) in enumerate(zip(values, errors, strict=True))], "node int, value double, error double")
    out, c = smooth.smooth(solved, G)
    got = np.array([r.value for r in out.orderBy("node").collect()])
    ix, iy = np.arange(G.size) % 5, np.arange(G.size) // 5
    x, y = ix * 1.0, iy * 2.0
    known = np.array([v is not None for v in values])
    b = np.array([0.0 if v is None else v for v in values])
    h = np.stack([x, x**2, x**3, y, y**2, y**3, x * y], 1)
    fit = np.linalg.lstsq(h[known].T @ h[known], h[known].T @ b[known], rcond=None)[0]
    assert np.allclose(c, fit, atol=1e-8)
    cubic = h @ fit
    k = np.exp(-((ix[:, None] - ix) ** 2 + (iy[:, None] - iy) ** 2).astype(float)) / errors**2
    k = k[np.ix_(known, known)]
    se, sv = (k * errors[known]).sum(1) / k.sum(1), (k * b[known]).sum(1) / k.sum(1)
    share = se / se.max()
    want = cubic.copy()
    want[known] = (1 - share) * sv + share * cubic[known]
    assert np.allclose(got, want, atol=1e-8)


def test_zero_significance():
    lo, step, n = levels.bins("ssb")
    mid = lo + step * (np.arange(n) + 0.5)
    counts = np.round(1e5 * np.exp(-(((mid + 0.1) / 0.05) ** 2)))
    level, mse = levels.zero_significance(counts, mid)
    assert -0.05 < level < 0.1 and mse < 1e-4
    assert math.isnan(levels.zero_significance(np.zeros(n), mid)[0])
    assert levels.mean_within([1.0, 1.1, 0.9, float("nan")]) == pytest.approx(1.0)


def test_histogram_last_bin_is_closed(spark):
    lo, step, n = levels.bins("ssb")
    df = spark.createDataFrame([(lo,), (lo + step * n,), (lo - 1.0,), (None,)], "v double")
    h = {r.bin: r.n for r in levels.histogram(df, F.col("v"), "ssb").where("n > 0").collect()}
    assert h == {0: 1, n - 1: 1}


def test_envelopes(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 0.01), (1.0, 5.0), (1.0, None), (1.0, float("nan"))], "swh double, rms double")
    kept = [r.k for r in df.select(filters.within_envelope(F.col("rms"), F.col("swh"), "swh_rms_ku", "j2").alias("k")).collect()]
    assert kept[:3] == [True, False, False] and not kept[3] and not kept[4]
    assert df.where(filters.within_envelope(F.col("rms"), F.col("swh"), "swh_rms_c", "s6Ah")).count() == 5  # no C band
    for m in ("tx", "j1", "j2", "j3", "s3", "s6A", "s6Ah", "sw", "sa"):
        assert "swh_rms_ku" in limits.ENVELOPES[m]


def test_flags():
    assert filters.flag_value("range_qual", "good bad") == 0 and filters.flag_value("interp", "four_points other") == 4
    assert filters.flag_value("orb_state_flag_rest") == 3 and filters.flag_value("strange") is None
    assert filters.product_limits("s6A")["swh_rms_c"] == (0.0, 5.0) and filters.product_limits("j2", 4)["sig0_rms_ku"] == (0.0, 5.0)


def test_reverse_polish(spark):
    df = spark.createDataFrame([(9.0, 2.0, -1.0)], "a double, b double, c double")
    one = lambda e: df.select(catalog.compile_rpn(e).alias("v")).first().v
    assert one("a b SUB 3 MUL") == 21.0 and one("a SQRT b ADD") == 5.0 and one("c SQRT") is None and one(":a") == 9.0
    for bad in ("a b", "ADD", "a SUB", "SQRT"):
        with pytest.raises(ValueError):
            catalog.compile_rpn(bad)
    assert catalog.selected("!c2 g1", "j1") and not catalog.selected("!c2 g1", "c2") and catalog.selected("j1 j2", "j2")


def test_names(spark):
    assert catalog.resolve("range_ku", 3) == "ku.range_ocean" and catalog.resolve("range_ku_mle3", 3) == "ku.range_ocean_mle3"
    assert catalog.resolve("ocean_tide_fes", 1) == "ocean_tide_sol2" and catalog.resolve("lat", 2) == "latitude" and catalog.resolve("wind_speed_alt", 5) == "wind_speed_alt"
    assert catalog.resolve("sea_state_bias_ku", 3, "j3", "adaptive") == "ku.sea_state_bias_adaptive"
    assert catalog.bands(["swh_ku", "swh_c", "dac"]) == {"ku": ["swh_ku"], "c": ["swh_c"], "": ["dac"]}
    assert catalog.partition_keys("j2", "dir", "usla", err="rms_rws")["err"] == "rms_ws"
    for wrong in ((7, "j3", "ocean"), (3, "tx", "ocean"), (3, "j3", "none")):
        with pytest.raises(ValueError):
            catalog.resolve("lat", *wrong)
    with pytest.raises(ValueError, match="adaptive"):
        catalog.canonical(spark.range(1), ["id"], 3, "j3", "adaptive")


def test_xml_catalog():
    found = {v.name: v for v in catalog.read_catalog('<?xml version="1.0"?>\n<!-- note --><var name="p"><data>:pass_number</data></var><var name="s" sat="j1"><limits>0 1</limits><data>a b ADD</data></var><var name="s" sat="!j1"><data>c</data><default>2</default></var>')}
    assert found["p"].aliases == ("pass_number",) and found["s"].by_satellite == {"j1": "a b ADD", "!j1": "c"} and found["s"].limits == (0.0, 1.0) and found["s"].default == 2.0


def test_missions():
    assert missions.tandem_cycles("txj1")[0] == (344, 1) and (361, 18) not in missions.tandem_cycles("txj1")
    assert len(missions.tandem_cycles("j2j3", collinear=True)) == 22
    assert 243 not in missions.mission_cycles("j1", "all") and missions.mission_cycles("j1", "txj1")[0] == 1


def test_orbit_rows_must_match(spark, tmp_path):
    (tmp_path / "orbit.txt").write_text(" 0 1 2 3 4 5 6 7 8 9\n\n1 1 2 3 4 5 6 7 8 9\n")
    orbit = tables.read_orbit(spark, str(tmp_path / "orbit.txt"))
    assert orbit.count() == 2
    assert tables.attach_orbit(spark.range(2).withColumnRenamed("id", "idx"), orbit).count() == 2
    for passes in (spark.range(3), spark.range(1), spark.range(2).union(spark.range(1))):
        with pytest.raises(Exception, match="do not match"):
            tables.attach_orbit(passes.withColumnRenamed("id", "idx"), orbit).collect()


def test_orbit_rows_match_within_passes(spark, tmp_path):
    """The index counts anew in every pass; one short pass is an error that names it."""
    for p, n in ((1, 3), (2, 2)):
        (tmp_path / f"orbit/cycle=4/pass_number={p}").mkdir(parents=True)
        (tmp_path / f"orbit/cycle=4/pass_number={p}/a.txt").write_text("".join(f"{i} 1 2 {10 * p + i} 4 5 6 7 8 9\n" for i in range(n)))
    orbit = tables.read_orbit(spark, f"file://{tmp_path}/orbit")
    rows = [(4, p, i) for p, n in ((1, 3), (2, 2)) for i in range(n)]
    passes = spark.createDataFrame(rows, "cycle int, pass_number int, idx int")
    got = {(r.cycle, r.pass_number, r.idx): r.alt_new for r in tables.attach_orbit(passes, orbit, "cycle", "pass_number").collect()}
    assert got == {(c, p, i): 10.0 * p + i for c, p, i in rows}
    with pytest.raises(Exception, match="do not match at index 2, cycle 4, pass_number 1"):
        tables.attach_orbit(passes.where("idx < 2"), orbit, "cycle", "pass_number").collect()


def test_catalog_graph(spark):
    v = catalog.Variable
    df = spark.createDataFrame([(2.5, 0, 1.0), (9.0, 0, 2.0), (2.5, 1, 3.0), (None, 0, 4.0)], "swh double, flag int, h double")
    cat = [v("ssha", "h twice ADD", flags=("swh", "flag")), v("twice", "h 2 MUL"), v("swh", "swh", limits=(0.0, 8.0), default=7.0), v("none", "no_such 1 ADD"), v("mine", fallbacks=[("j1", ("h",)), ("!j1", ("no_such", "swh"))])]
    got = [tuple(r) for r in catalog.select_catalog(df, cat, "j2").collect()]
    assert got == [(3.0, 2.0, 2.5, None, 2.5), (None, 4.0, 7.0, None, 7.0), (None, 6.0, 2.5, None, 2.5), (None, 8.0, 7.0, None, 7.0)]
    assert [r.mine for r in catalog.select_catalog(df, cat, "j1").collect()] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError, match="each other"):
        catalog.select_catalog(df, [v("a", "b"), v("b", "a 1 ADD")])


def test_unknown_perturbations_are_refused(spark):
    from tidemark.functions import variables

    for f in (lambda: variables.independent("j2", err="nonsense"), lambda: variables.dependent("usla", err="xj1"), lambda: variables.independent("j2", err="foo_j2")):
        with pytest.raises(ValueError, match="no perturbation"):
            f()
    row = spark.createDataFrame([(1.0, 0.5, 0.25)], "usla_ku double, ocean_tide_sol2 double, ocean_tide_sol1 double")
    assert row.select(variables.dependent("usla", mission="tx", err="txj1").alias("v")).first().v == 1.25
    assert row.select(variables.dependent("usla", mission="j1", err="txj1").alias("v")).first().v == 1.0


def test_late_rows_are_left_out_of_closed_windows(spark):
    """A row that comes within the delay counts, one for a window that was closed before does not; no window comes twice."""
    import datetime as dt

    from tidemark.storage import shared_dir
    from tidemark.streaming.incremental import windowed_quality

    path = shared_dir(spark, "late")
    at = lambda d, h: dt.datetime(2024, 1, d, h)

    def arrive(*times):
        spark.createDataFrame([(t, 1.0) for t in times], "ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{path}/in")
        found = windowed_quality(stream).select(F.dayofmonth("window.start").alias("day"), "n")
        found.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
        return sorted((r.day, r.n) for r in spark.read.schema("day int, n long").parquet(f"{path}/out").collect())

    assert arrive(at(1, 5), at(1, 23)) == []
    assert arrive(at(2, 0), at(1, 22)) == []  # within the hour the day is open
    assert arrive(at(2, 3)) == [(1, 3)]
    assert arrive(at(1, 4), at(3, 2)) == [(1, 3), (2, 2)]  # the first day was closed


def test_common_bias_to_the_end(spark):
    """Levels of cells and the grid against a dense system with one unknown for every cell, after outliers are removed by hand."""
    grid = Grid(Axis(0.0, 1.0, 3), Axis(0.0, 1.0, 3))
    rng = np.random.default_rng(2)
    raw = [(i, int(1 + i % 2), int(i % 5), float(rng.uniform(0.01, 2)), float(rng.uniform(0.01, 2)), float(rng.normal(0, 0.01))) for i in range(600)]
    level = {(c, g): 0.1 * c + 0.02 * g for c in (1, 2) for g in range(5)}
    rows = [(i, c, g, x, y, 0.05 * x - 0.02 * x * y + level[c, g] + e + (5.0 if i in (7, 100) else 0.0)) for i, c, g, x, y, e in raw]
    df = spark.createDataFrame(rows, "id long, cycle int, geo_cell int, x double, y double, z double").withColumn("nodes", design.weights(grid, F.col("x"), F.col("y")))
    m, cells = steps.fit_common_bias(df, grid, least=5, z=5.0)
    kept = [r for r in rows if r[0] not in (7, 100)]
    weights = {r.id: r.nodes for r in df.collect()}
    h = np.zeros((len(kept), 9 + 10))
    for k, r in enumerate(kept):
        for e in weights[r[0]]:
            h[k, e.node] += e.w
        h[k, 9 + 5 * (r[1] - 1) + r[2]] = 1
    x = np.linalg.pinv(h) @ np.array([r[5] for r in kept])
    got = {r.node: r.raw for r in m.nodes.collect()}
    off = np.array([got[n] - x[n] for n in range(9)])
    assert np.ptp(off) < 1e-9 and m.rounds == 2  # the grid's own level is free
    found = {(r.cycle, r.geo_cell): r for r in cells.collect()}
    want = {(c, g): x[9 + 5 * (c - 1) + g] for c, g in level}
    shift = np.array([found[k].value - want[k] for k in want])
    assert np.ptp(shift) < 1e-9 and all(f.error == pytest.approx(f.n**-0.5) for f in found.values()) and sum(f.n for f in found.values()) == 598


def test_common_bias_takes_as_many_rounds_as_outliers_do(spark):
    """Noise with a long tail needs eight rounds, more than the studied system's six; the rows left, the grid and the levels are those of the same rounds on a dense system."""
    n, z, grid = 200, 2.0, Grid(Axis(0.0, 1.0, 3), Axis(0.0, 1.0, 3))
    rng = np.random.default_rng(27)
    cycle, cell, x, y = 1 + np.arange(n) % 2, np.arange(n) % 3, rng.uniform(0.01, 2, n), rng.uniform(0.01, 2, n)
    v = 0.05 * x - 0.02 * x * y + 0.1 * cycle + 0.02 * cell + rng.exponential(1.0, n)
    rows = [(i, int(cycle[i]), int(cell[i]), float(x[i]), float(y[i]), float(v[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, cycle int, geo_cell int, x double, y double, z double").withColumn("nodes", design.weights(grid, F.col("x"), F.col("y")))
    h = np.zeros((n, 9 + 6))
    for r in df.collect():
        for e in r.nodes:
            h[r.id, e.node] += e.w
        h[r.id, 9 + 3 * (r.cycle - 1) + r.geo_cell] = 1
    kept, rounds, before = np.arange(n), 0, None
    while before is None or len(kept) < len(before):
        s = np.linalg.pinv(h[kept]) @ v[kept]
        res, before, rounds = v - h[:, :9] @ s[:9], kept, rounds + 1
        own = [kept[cycle[kept] == c] for c in (1, 2)]
        for k in range(2):
            while (inner := own[k][np.abs(res[own[k]] - res[own[k]].mean()) <= z * res[own[k]].std()]).size < own[k].size:
                own[k] = inner
        kept = np.concatenate(own)
    m, cells = steps.fit_common_bias(df, grid, least=5, z=z)
    assert m.rounds == rounds == 8
    off = np.array([r.raw - s[r.node] for r in sorted(m.nodes.collect(), key=lambda r: r.node)])
    assert len(off) == 9 and np.ptp(off) < 1e-9
    found = {(r.cycle, r.geo_cell): r for r in cells.collect()}
    assert {k: f.n for k, f in found.items()} == {(c, g): int(((cycle[kept] == c) & (cell[kept] == g)).sum()) for c in (1, 2) for g in range(3)}
    assert np.ptp([f.value - s[9 + 3 * (c - 1) + g] for (c, g), f in found.items()]) < 1e-9


def test_cycle_tables_replace_cycles(spark, tmp_path):
    path = str(tmp_path / "cycles")
    df = spark.range(10).select(F.col("id").cast("double").alias("time"), F.lit("j2").alias("mission"), (F.col("id") % 2 + 1).cast("int").alias("cycle"))
    tables.write_cycles(df, path)
    tables.write_cycles(df.where("cycle = 1").limit(2), path)
    got = tables.read_cycles(spark, path, "j2")
    assert got.where("cycle = 1").count() == 2 and got.where("cycle = 2").count() == 5
    assert tables.with_units(df).schema["time"].metadata == {"units": "s"}


def test_geometry_of_longitudes(spark):
    df = spark.createDataFrame([(0.0,), (180.0,), (359.5,), (-0.5,), (540.0,)], "lon double")
    got = df.select(geodesy.lon180(F.col("lon")).alias("a"), geodesy.lon360(F.col("lon")).alias("b")).collect()
    assert [r.a for r in got] == [0.0, -180.0, -0.5, -0.5, -180.0] and [r.b for r in got] == [0.0, 180.0, 359.5, 359.5, 180.0]


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumn("n", physics.noise(F.col("id"), F.lit(2.0), 3))
    a = [r.n for r in df.orderBy("id").collect()]
    assert a == [r.n for r in df.repartition(7).orderBy("id").collect()]
    assert abs(np.mean(a)) < 0.2 and abs(np.std(a) - 2) < 0.2
    assert spark.range(1).select(physics.noise(F.col("id"), F.lit(-1.0)).alias("n")).first().n == 0.0


def test_latitude_weight(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (-50.0,), (70.0,)], "lat double")
    for m in ("j2", "s3"):
        w = [r.w for r in df.select(physics.latitude_weight(F.col("lat"), m).alias("w")).collect()]
        assert w[0] == pytest.approx(1.0) and w[1] == pytest.approx(w[2]) and w[1] != 1.0 and (m == "s3" or w[3] is None)


def test_variables(spark):
    with pytest.raises(KeyError):
        variables.dependent("nothing")
    variables.register("twice", lambda r, b, m: r(f"usla_{b}") * 2)
    df = spark.createDataFrame([(1.5, 10.0, 13.0, 0.0, 95.0)], "usla_ku double, swh_ku double, swh_ku_j3 double, time double, time_j3 double")
    assert df.select(variables.dependent("twice").alias("v")).first().v == 3.0
    assert df.select(variables.dependent("dSWH_tdm", partner="j3").alias("v")).first().v is None  # more than 90 s apart
    assert df.withColumn("time_j3", F.lit(20.0)).select(variables.dependent("dSWH_tdm", partner="j3").alias("v")).first().v == 3.0


def test_rounds_that_do_not_end_fail(spark, sf_dir, monkeypatch):
    grid = Grid(Axis(0.0, 6.5, 3), Axis(0.0, 10.5, 3))
    o = observations(spark, sf_dir).withColumn("x", F.col("swh_ku")).withColumn("y", F.col("wind_speed_alt")).withColumn("z", F.col("usla_ku") + F.when(F.pmod("id", F.lit(40)) == 0, F.col("id") / 10.0).otherwise(0.0))
    rows = o.withColumn("nodes", design.weights(grid, F.col("x"), F.col("y"))).where("nodes is not null").select("id", "cycle", "lat", "x", "y", "z", "nodes")
    monkeypatch.setattr(steps, "rounds_of", lambda variable, err: 1)
    with pytest.raises(RuntimeError, match="outliers are left"):
        steps.fit_model(rows, grid, least=5)


def test_outliers_of_pairs(spark):
    """A pair stays if both sides do; rounds end when none is an outlier on both sides."""
    rows = [(i, 1, float(i % 5), float(i % 7)) for i in range(200)] + [(900, 1, 1e5, 1.0), (901, 1, 1.0, 1e5), (902, 1, 1e5, 1e5), (903, 2, 1e5, 1e5), (904, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, cycle int, a double, b double")
    got = {r.id: (r.ok_a, r.ok_b) for r in outliers.marked_pairs(df, F.col("a"), F.col("b"), 3.0, "cycle").collect()}
    assert got[900] == (False, True) and got[901] == (True, False) and got[902] == (False, False) and got[903] == (True, True) and 904 not in got
    assert all(got[i] == (True, True) for i in range(200))


def test_levels_without_zero_significance(spark):
    rows = [(1, 1.7, 5.5, -0.1), (1, 1.8, 5.6, -0.3), (2, 1.7, 5.4, -0.2), (2, 9.0, 5.4, 7.0)]
    df = spark.createDataFrame(rows, "cycle int, x double, y double, z double")
    by_cycle, bias = steps.level(df, df.sparkSession.createDataFrame([(0, 0.0)], "node int, value double"), G, "SO")
    assert [(c, round(v, 9)) for c, v, _ in by_cycle] == [(1, -0.2), (2, -0.2)] and bias == pytest.approx(-0.2)


def test_model_with_a_third_axis(spark):
    """Fit, levels, errors and smoothing on a three-dimensional grid."""
    cube = Grid(Axis(0.0, 2.0, 3), Axis(0.0, 5.0, 3), Axis(0.0, 3.0, 3))
    rng = np.random.default_rng(6)
    rows = [(i, 1 + i % 2, *map(float, p)) for i, p in enumerate(rng.uniform([0, 0, 0], [4, 10, 6], (1500, 3)))]
    df = spark.createDataFrame(rows, "id long, cycle int, x double, y double, depth double").withColumn("lat", F.lit(1.0))
    df = df.withColumn("z", F.lit(-0.02) * F.col("x") - 0.005 * F.col("y") - 0.01 * F.col("depth") + (F.pmod("id", F.lit(7)) - 3) / 1000.0)
    df = df.withColumn("nodes", design.weights(cube, F.col("x"), F.col("y"), F.col("depth"))).where("nodes is not null")
    m = steps.fit_model(df, cube, least=5)
    got = m.nodes.collect()
    known = np.array([-0.02 * r.x - 0.005 * r.y - 0.01 * r.z for r in got])
    raw = np.array([r.raw for r in got])
    assert len(got) == cube.size and all(r.error > 0 for r in got) and np.allclose(raw - raw.mean(), known - known.mean(), atol=2e-3)
    assert len(m.cycle_levels) == 2 and m.bias == m.bias and abs((raw - known).mean() + m.bias) < 2e-3


def test_command_line_says_how(capsys):
    from tidemark.__main__ import main

    assert main([]) == 2 and "python -m tidemark" in capsys.readouterr().out


def test_commands_in_a_row(spark, sf_dir, tmp_path):
    """Products to cycles, cycles to observations, a model of each method and an error analysis, and the models applied."""
    from tidemark.__main__ import parser, run

    at = lambda name: str(tmp_path / name)
    go = lambda *args: run(spark, parser().parse_args([*args, "--x", "0", "2.5", "6", "--y", "0", "3.5", "7", "--least", "3", "--step", "0"]))
    o = observations(spark, sf_dir.replace("sf0.001", "sf0.01"))
    later = o.withColumns({"id": F.col("id") + 1000000, "cycle": F.col("cycle") + 1, "lat": F.col("lat") + 0.001, "swh_ku": F.pmod(F.col("id") * 61, F.lit(1200)) / 100.0})
    o.unionByName(later).drop("usla_ku", "usla_c").write.parquet(at("products"))
    go("cycles", at("products"), at("cycles"), "j2")
    go("observations", at("cycles"), at("obs"), "j2")
    go("model", at("obs"), at("ku"))
    go("errors", at("cycles"), at("c"), "j2", "usla", "--band", "c")
    go("pairs", at("cycles"), at("pairs"), "j2", "collinear")
    go("calibrate", at("cycles"), at("ku"), at("c"), at("bias"), "j2")
    go("apply", at("cycles"), at("ku"), at("c"), at("applied"), "--gaps")
    assert all(tables.read_model(spark, at(m))["model_node"].where("value is not null").count() == 42 for m in ("ku", "c", "pairs"))
    applied = spark.read.parquet(at("applied"))
    assert applied.count() == spark.read.parquet(at("cycles")).count() > 0 and applied.where("ssb_model is not null and iono_model is not null").count() > 0
    assert spark.read.parquet(at("bias")).count() > 0


def test_whole_model(spark, sf_dir):
    grid = Grid(Axis(0.0, 2.5, 6), Axis(0.0, 3.5, 7))
    o = observations(spark, sf_dir).withColumn("x", F.col("swh_ku")).withColumn("y", F.col("wind_speed_alt")).withColumn("z", physics.bm3(F.col("swh_ku"), F.col("wind_speed_alt")))
    rows = o.withColumn("nodes", design.weights(grid, F.col("x"), F.col("y"))).where("nodes is not null").select("id", "cycle", "x", "y", "z", "nodes")
    m = steps.fit_model(rows, grid, least=5)
    assert m.nodes.count() == grid.size and m.rounds <= 6 and len(m.cycle_levels) == 3 and m.nodes.where("value is null").count() == 0


def test_library_archive(tmp_path):
    from tidemark import storage

    path = storage.archive(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), f"file://{tmp_path}/shared").removeprefix("file://")
    code = f"import sys; sys.path.insert(0, {path!r}); import tidemark.operators.lsq as m; assert {path!r} in m.__file__"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_optional_parts_can_be_missing(tmp_path):
    """The library and the entry point work without the training-data operators."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in ("tidemark", "jobs", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{p}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/tidemark/llm"], check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all")
    broken = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert broken.returncode != 0 and "no_such_module_at_all" in broken.stderr  # what an optional part needs is no option
    (tmp_path / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_triangles_have_empty_circles():
    rng = np.random.default_rng(4)
    at = np.flatnonzero(rng.random(20 * 15) < 0.5)
    x, y = at % 20 * 1.0, at // 20 * 1.5
    found = triangles.triangulate(x, y, 1e-6 * (at * at % 1009) / 1009)
    area = lambda t: ((x[t[1]] - x[t[0]]) * (y[t[2]] - y[t[0]]) - (x[t[2]] - x[t[0]]) * (y[t[1]] - y[t[0]])) / 2
    for t in found:
        m = np.array([[x[t[k]] - x[t[0]], y[t[k]] - y[t[0]]] for k in (1, 2)])
        centre = np.linalg.solve(2 * m, (m * m).sum(axis=1)) + [x[t[0]], y[t[0]]]
        assert np.hypot(x - centre[0], y - centre[1]).min() > np.hypot(x[t[0]] - centre[0], y[t[0]] - centre[1]) - 1e-6
    # they cover the hull of the nodes once: as many as Euler's formula says, and no edge twice in one direction
    edges = {(t[k], t[(k + 1) % 3]) for t in found for k in range(3)}
    rim = [e for e in edges if e[::-1] not in edges]
    assert len(edges) == 3 * len(found) and len(found) == 2 * len(at) - 2 - len(rim) and all(area(t) > 0 for t in found)


@pytest.mark.parametrize("known, inside", [(lambda i, j: (i + j) % 3 != 1, True), (lambda i, j: i == 2, False), (lambda i, j: False, False), (lambda i, j: (i, j) in ((0, 0), (4, 0), (0, 3)), None)])
def test_planes_across_gaps(spark, known, inside):
    """A plane comes back wherever the hull of the known nodes is; nodes in line, or none, give nothing."""
    model = spark.createDataFrame([(i + 5 * j, 2.0 * i - 3.0 * (2 * j) + 1 if known(i, j) else None) for i in range(5) for j in range(4)], "node int, value double")
    places = [(0.5 * a, 0.75 * b) for a in range(9) for b in range(9)] + [(4.5, 1.0), (-0.1, 1.0), (None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(places, "x double, y double")
    got = df.select("x", "y", triangles.across_gaps(model, G, F.col("x"), F.col("y")).alias("v")).collect()
    for r in got:
        beyond = r.x is None or not (0 <= r.x <= 4 and 0 <= r.y <= 6)
        if inside is None:
            beyond = beyond or r.x / 4 + r.y / 6 > 1 + 1e-9
        if inside is not False and not beyond:
            if r.v is not None or inside is None:
                assert r.v == pytest.approx(2 * r.x - 3 * r.y + 1, abs=1e-9)
        elif beyond or (inside is False and not (known(2, 0) and r.x == 2)):
            assert r.v is None
    if inside:
        assert sum(r.v is not None for r in got) > 60


def test_radius_join_copies_a_row_eight_times_at_most(spark):
    """A row goes only to the cubes that its neighbourhood reaches, whatever side of a cube's wall it is on."""
    rows = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(np.random.default_rng(5).uniform(-6.4e6, 6.4e6, (400, 3)))]
    rows += [(400, 0.0, 0.0, 0.0), (401, -2020.0, 2020.0, 4040.0)]
    got = match._cells(spark.createDataFrame(rows, "id long, x double, y double, z double"), ("x", "y", "z"), 1000.0, 2020.0)
    n = [r["count"] for r in got.groupBy("id").count().collect()]
    assert len(n) == len(rows) and max(n) <= 8
    own = match._cell(tuple(F.col(c) for c in "xyz"), 2020.0)
    assert got.where(F.col("cell") == own).select("id").distinct().count() == len(rows)
    assert got.select("id", "cell").distinct().count() == got.count()


def test_nearest_within_does_not_compare_every_copy(spark):
    """Records at one place are one partner, and far fewer pairs are made than lie within the radius; the result is the exact one."""
    rng = np.random.default_rng(6)
    a = [(i, float(v), float(w), int(i % 2)) for i, (v, w) in enumerate(zip(rng.uniform(-60, 60, 300), rng.uniform(0, 360, 300), strict=True))]
    b = [(1000 + i, float(v), float(w), int(i % 2)) for i, (v, w) in enumerate(zip(rng.uniform(-60, 60, 300), rng.uniform(0, 360, 300), strict=True))]
    b += [(2000 + i, 10.0, 20.0, 0) for i in range(400)] + [(5000, None, 3.0, 0)]
    left, right = (spark.createDataFrame(r, "id long, lat double, lon double, k int") for r in (a, b))
    keys = (("k", F.col("k_b")),)
    want = {r.id_a: (r.id_b, r.dist) for r in match.nearest(match.radius_join(left, right, 2.5e6, keys=keys)).select("id_a", "id_b", "dist").collect()}
    got = match.nearest_within(left, right, 2.5e6, keys=keys, carry=("k",))
    rows = got.collect()
    assert len(rows) == len(want) and {r.id_a: (r.id_b, r.dist) for r in rows} == want
    assert all(r.k_a == r.id_a % 2 for r in rows)


def test_large_cycles_are_written_by_several_tasks(spark, tmp_path):
    """A cycle beyond the advisory partition size is no single task's, and reads back whole."""
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100000")
    try:
        obs = spark.range(0, 80000, 1, 8).select("id", F.lit(7).alias("cycle"), F.rand(1).alias("z"), F.array(F.struct(F.lit(1).alias("node"), F.rand(2).alias("w"))).alias("nodes"))
        tables.write_observations(obs, f"file://{tmp_path}/o")
        tables.write_cycles(obs.select("id", "cycle", "z", F.lit("j2").alias("mission")), f"file://{tmp_path}/c")
        for back, at in ((tables.read_observations(spark, f"file://{tmp_path}/o")[0], "o/obs/cycle=7"), (tables.read_cycles(spark, f"file://{tmp_path}/c", "j2"), "c/mission=j2/cycle=7")):
            assert back.select("id").distinct().count() == back.count() == 80000
            assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / at)) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)


def test_sample_statistics_are_computed_once(spark):
    """A row's samples are filtered and its mean taken once, not once for each sample."""
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0, None, 9.0], [0, 0, 0, 0, 1]), (2, [3.0], [1])], "id int, v array<double>, u array<int>")
    found = df.select("id", windows.sample_summary(F.col("v"), F.col("u")).alias("s")).select("id", "s.*").orderBy("id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("arrays_zip") == 1
    one, none = found.collect()
    assert np.allclose([one.skew, one.median, one.mean, one.std], [20 / 27 / (14 / 9) ** 1.5, 2.0, 7 / 3, (14 / 9) ** 0.5]) and none[1:] == (None, None, None, None)
    assert df.select(*windows.sample_statistics(F.col("v"), F.col("u"), "s")).columns == ["s_skew", "s_median", "s_mean", "s_std"]


def test_rounding_of_long_sums_is_no_level():
    """A last pivot that rounding has made larger than its limit does not give differences a level of their own."""
    h = np.array([[1.0, -1.0, 0.0], [0.0, 1.0, -1.0], [1.0, 0.0, -1.0]]) / 3
    a, b = h.T @ h, h.T @ np.array([1.0, 2.0, 3.0])
    x, error, lacking = lsq.solve(a + 3e-11 * np.eye(3), b + 1e-9)
    assert lacking and np.allclose(x, np.linalg.pinv(a) @ b, atol=1e-6) and np.allclose(error, np.sqrt(np.diag(np.linalg.pinv(a))), atol=1e-6)


def test_fit_reads_its_rows_once(small):
    """One aggregate gives the matrix, the right-hand side and the counts of all three tables."""
    found = {(r.i, r.j): r for r in lsq.moments(small, weight=F.col("id") + 1.0).collect()}
    matrix = {(r.i, r.j): r.v for r in lsq.normal_matrix(small, weight=F.col("id") + 1.0).collect()}
    assert found.keys() == matrix.keys() and all(np.isclose(found[k].v, v) for k, v in matrix.items())
    assert all(np.isclose(found[r.i, r.i].b, r.v) for r in lsq.normal_vector(small, weight=F.col("id") + 1.0).collect())
    assert {i: r.n for (i, j), r in found.items() if i == j and r.n} == {r.node: r.n for r in lsq.node_counts(small).collect()}


def test_long_tracks_are_cut_with_the_records_around(spark, monkeypatch):
    """Parts of a track give the means of the whole, over gaps, crowded times and a time or track that is missing."""
    rng = np.random.default_rng(5)
    times = np.concatenate([rng.uniform(0, 1000, 700), rng.uniform(500_000, 500_010, 300), [2000.0]])
    rows = [(i, None if i % 7 == 0 else i % 3, float(t), float(rng.normal())) for i, t in enumerate(times)]
    rows += [(5000, 1, None, 1.0), (5001, 1, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "id int, cycle int, time double, v double").cache()
    mean = lambda **how: {r.id: r.m for r in windows.moving_means(df, {"v": "m"}, 21, "cycle", max_step=None, **how).collect()}
    whole = mean()
    for most in (8, 40, 130):
        monkeypatch.setattr(windows, "PART_ROWS", most)
        assert mean() == whole and len(whole) == len(rows) and sum(m is not None for m in whole.values()) == len(rows) - 4 * 20
        cut = windows.parted(df, 10, "cycle")
        assert cut.where("__own").count() == len(rows) and cut.where("__own").groupBy("cycle", "__part").count().count() >= 8
    monkeypatch.undo()
    crowd = spark.range(400).select(F.col("id"), F.lit(1).alias("cycle"), F.when(F.col("id") < 300, 5.0).otherwise(F.col("id") * 1.0).alias("time"))
    monkeypatch.setattr(windows, "PART_ROWS", 20)
    assert windows.parted(crowd, 10, "cycle").count() < 400 + 20 * 20 + 3 * 300  # one time's records go to the parts beside it only


def test_crossings_are_shuffled_before_the_join_only(spark, sf_dir):
    """Neither groups of near records nor the sides of a crossing are shuffled again, and values come by one join with the records."""
    points = registered.tracks(spark, sf_dir)
    found = match.crossovers(points, radius=400000.0, max_days=3.0)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(found).count("Exchange hashpartitioning") <= 4
    assert plan(match.crossover_values(found, points, ["swh_ku"])).count("events.parquet") == 1
