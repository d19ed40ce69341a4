"""Counts, node selection, normal equations and their solution.

Everything per observation is an aggregation with partial sums before the shuffle; what reaches the driver are the
normal equations of the kept nodes, which the grid bounds, not the number of observations. They come as Arrow columns. Up to
DENSE_NODES nodes they are solved densely; beyond that only systems that couple neighbouring planes of a three-dimensional
grid are, plane by plane, with the same solution and formal errors. Other systems of that size are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import doubles, longs
from ..storage import materialize
from .design import exploded
from .grid import Grid

#: Nodes up to which the normal equations are solved densely on the driver, and nodes of one plane at most.
DENSE_NODES = 6000


def node_counts(df: DataFrame, *by: str) -> DataFrame:
    """(by..., node, n): rows with weight on a node."""
    return exploded(df, *by).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("n"))


def kept_nodes(df: DataFrame, least: int = 50) -> DataFrame:
    return node_counts(df).where(F.col("n") >= least)


def touching(df: DataFrame, nodes: list[int] | None) -> DataFrame:
    """Rows with a weight on a kept node; no list keeps every row."""
    if nodes is None:
        return df
    return df.where(F.exists("nodes", _member(nodes))) if nodes else df.limit(0)


def select_columns(df: DataFrame, nodes: list[int]) -> DataFrame:
    """Weights on kept nodes only, rows without any dropped. The list is bounded by the grid."""
    return df.withColumn("nodes", F.filter("nodes", _member(nodes))).where(F.size("nodes") > 0)


def _member(nodes: list[int]):
    """Whether a weight's node is one of the nodes, by a bitmap."""
    words = longs(_bitmap(nodes))

    def test(e: Column) -> Column:
        word = F.try_element_at(words, F.shiftright(e["node"], 6) + 1)
        return F.coalesce(F.getbit(word, e["node"] % 64) == 1, F.lit(False))

    return test


def _bitmap(nodes: list[int]) -> list[int]:
    """Signed 64-bit words with a bit for each node."""
    words = np.zeros(max(nodes, default=0) // 64 + 1, np.uint64)
    for n in nodes:
        words[n // 64] |= np.uint64(1) << np.uint64(n % 64)
    return words.view(np.int64).tolist()


def consistent(df: DataFrame, least: int) -> tuple[DataFrame, list[int]]:
    """Drop sparse nodes, then rows that lost a node, until nothing changes. Returns rows and node ids."""
    rows, before = df, None
    while True:  # ends, as the list can only shrink; the last one stands for all before it
        ids = sorted(r["node"] for r in kept_nodes(rows, least).select("node").collect())
        if not ids or ids == before:
            return rows, ids
        rows = df.where(F.forall("nodes", _member(ids)))
        before = ids


def consistent_by(df: DataFrame, least: float, *by: str) -> DataFrame:
    """As `consistent`, in every group of the columns `by` at once: the rows that stay.

    What is kept from round to round are the nodes that each group has lost, written as a small table; a row goes if it
    has a weight on one of them. A round counts nodes only in groups that lost one in the round before, so groups at rest
    are not read again (where `by` are partition columns, their files are not either). The planner sees the size of the
    written table and broadcasts it only while it is small. Groups may be NULL; rows without a design (NULL) go; rows with no
    weight stay; the rows are evaluated in each round, so an expensive plan should be written first.
    """
    rows, keys = df.where(F.col("nodes").isNotNull()), [f"__by{i}" for i in range(len(by))]
    lost, changing = None, None
    while True:  # ends, as each round but the last takes a node from some group
        some = rows if changing is None else rows.join(changing, _same(by, keys), "left_semi")
        thin = node_counts(_without(some, lost, by, keys), *by).where(F.col("n") < least)
        found = materialize(thin.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "node"), "thin-nodes")
        if found.isEmpty():
            return _without(rows, lost, by, keys)
        every = found if lost is None else found.unionByName(lost.select(*keys, F.explode("__lost").alias("node")))
        lost = materialize(every.groupBy(*keys).agg(F.collect_set("node").alias("__lost")), "lost-nodes")
        changing = found.select(*keys).distinct()


def _same(by: tuple[str, ...], keys: list[str]) -> Column:
    on = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        on &= F.col(c).eqNullSafe(F.col(k))
    return on


def _without(rows: DataFrame, lost: DataFrame | None, by: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Rows with no weight on a node that their group has lost."""
    if lost is None:
        return rows
    touched = F.arrays_overlap(F.transform("nodes", lambda e: e["node"]), F.col("__lost"))
    return rows.join(lost, _same(by, keys), "left").where(F.col("__lost").isNull() | ~touched).select(*rows.columns)


def cycle_bins(df: DataFrame, least: int = 50, cycle: str = "cycle", cycles: int | None = None) -> DataFrame:
    """(node, n, cycles) of nodes with `least` rows in all cycles together, counted on rows that are consistent in their cycle.

    A cycle's own minimum is `least` over the number of cycles (those of the rows, if not given).
    """
    n = cycles or df.select(F.coalesce(F.col(cycle).cast("string"), F.lit("")).alias("c")).distinct().count()
    counts = node_counts(consistent_by(df, least / max(n, 1), cycle), cycle)
    return counts.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cycles")).where(F.col("n") >= least)


def normal_matrix(df: DataFrame, *by: str, weight: Column | None = None) -> DataFrame:
    """(by..., i, j, v) with i <= j: entries of the weighted normal matrix."""
    w = F.lit(1.0) if weight is None else weight
    pairs = F.flatten(F.transform("nodes", lambda p: F.transform(F.filter("nodes", lambda q: q["node"] >= p["node"]), lambda q: F.struct(p["node"].alias("i"), q["node"].alias("j"), (p["w"] * q["w"]).alias("v")))))
    return df.select(*by, w.alias("__w"), F.explode(pairs).alias("e")).groupBy(*by, F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum(F.col("e.v") * F.col("__w")).alias("v"))


def normal_vector(df: DataFrame, *by: str, weight: Column | None = None, z: str = "z") -> DataFrame:
    """(by..., i, v): the weighted right-hand side."""
    w = F.lit(1.0) if weight is None else weight
    return df.select(*by, (w * F.col(z)).alias("__wz"), F.explode("nodes").alias("e")).groupBy(*by, F.col("e.node").alias("i")).agg(F.sum(F.col("e.w") * F.col("__wz")).alias("v"))


def moments(df: DataFrame, *by: str, weight: Column | None = None, z: str = "z") -> DataFrame:
    """(by..., i, j, v, b, n) with i <= j: entries of the weighted normal matrix and, where i = j, of the right-hand side and the rows with weight on the node.

    All that a fit needs of its rows in one aggregate; what is kept of a node's rows does not change the entries of other nodes.
    """
    w = F.lit(1.0) if weight is None else weight
    one = df.select(*by, w.alias("__w"), F.col(z).alias("__z"), "nodes", F.posexplode("nodes").alias("__p", "p"))
    two = one.select(*by, "__w", "__z", "__p", F.col("p.node").alias("i"), F.col("p.w").alias("__wi"), F.posexplode("nodes").alias("__q", "q"))
    own = F.col("__p") == F.col("__q")
    return two.where(F.col("q.node") >= F.col("i")).groupBy(*by, "i", F.col("q.node").alias("j")).agg(
        F.sum(F.col("__wi") * F.col("q.w") * F.col("__w")).alias("v"),
        F.sum(F.when(own, F.col("__w") * F.col("__z") * F.col("__wi"))).alias("b"),
        F.count(F.when(own & (F.col("__wi") != 0), 1)).alias("n"),
    )


def entries(matrix: DataFrame, vector: DataFrame, ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the matrix's upper half, and the right-hand side, by places among the ids (ascending)."""
    known = np.array(ids, np.int64)
    column = lambda t, c: t.column(c).to_numpy()
    m, v = matrix.select("i", "j", "v").toArrow(), vector.select("i", "v").toArrow()
    i, j = (np.searchsorted(known, column(m, c)) for c in ("i", "j"))
    b = np.zeros(len(ids))
    b[np.searchsorted(known, column(v, "i"))] = column(v, "v")
    return i, j, column(m, "v"), b


def dense(matrix: DataFrame, vector: DataFrame, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    i, j, v, b = entries(matrix, vector, ids)
    a = np.zeros((len(ids), len(ids)))
    a[i, j] = a[j, i] = v
    return a, b


#: Sums of a matrix's rows, of its largest entry, below which they are the rounding of long sums.
LEVEL_ROUNDING = 1e-9


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Solution, formal error and whether the system lacks rank (then it is the one of least norm).

    A system that knows no level common to all nodes (differences, free levels) is told by the sums of its rows, which are
    0 but for rounding, not by a last pivot, which grows with the rounding of long sums. A level is added to it and taken out again.
    """
    n, largest = len(b), np.abs(a).max(initial=0.0)
    level = np.trace(a) / n**2 if n and np.abs(a.sum(1)).max() <= LEVEL_ROUNDING * largest else 0.0
    try:
        low = np.linalg.cholesky(a + level)
        pivots = np.diag(low)
        if pivots.min() <= 1e-6 * pivots.max():
            raise np.linalg.LinAlgError("rank is lacking but for rounding")
        inverse = np.linalg.inv(low)
        square = (inverse**2).sum(0)
        if level:
            x = inverse.T @ (inverse @ (b - b.mean()))
            return x - x.mean(), np.sqrt(np.clip(square - 1 / (level * n**2), 0, None)), True
        return inverse.T @ (inverse @ b), np.sqrt(square), False
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(a, rcond=1e-11, hermitian=True)
        return inverse @ b, np.sqrt(np.clip(np.diag(inverse), 0, None)), True


def planes(ids: list[int], grid: Grid) -> np.ndarray:
    """The plane of each node along the grid's longest axis."""
    n = np.array(ids)
    counts = (grid.x.count, grid.y.count, grid.z.count if grid.z else 1)
    place = (n % counts[0], n // counts[0] % counts[1], n // (counts[0] * counts[1]))
    return place[int(np.argmax(counts))]


def solve_planes(i: np.ndarray, j: np.ndarray, v: np.ndarray, b: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solution and formal error of a system that couples nodes of one plane or of neighbouring ones.

    Block elimination forwards; backwards the solution and, of the inverse, the blocks on the diagonal. Memory is that of
    two dense blocks a plane.
    """
    of = [np.flatnonzero(plane == p) for p in np.unique(plane)]
    step, local = np.zeros(len(plane), np.int64), np.zeros(len(plane), np.int64)
    for k, rows in enumerate(of):
        step[rows], local[rows] = k, np.arange(len(rows))
    if (np.abs(plane[i] - plane[j]) > 1).any():
        raise ValueError(f"a system of {len(plane)} nodes that couples distant planes is too large to be solved densely")
    if max(map(len, of)) > DENSE_NODES:
        raise ValueError(f"planes of {max(map(len, of))} nodes are too large")

    def block(p: int, q: int) -> np.ndarray:
        out = np.zeros((len(of[p]), len(of[q])))
        for r, c in ((i, j), (j, i)):
            here = (step[r] == p) & (step[c] == q)
            out[local[r[here]], local[c[here]]] = v[here]
        return out

    inverse, beside, rest = [], [], []
    for k, rows in enumerate(of):
        a, y = block(k, k), b[rows]
        if k:
            back = beside[-1].T @ inverse[-1]
            a, y = a - back @ beside[-1], y - back @ rest[-1]
        try:
            low = np.linalg.inv(np.linalg.cholesky(a))
        except np.linalg.LinAlgError as e:
            raise ValueError("a system too large to be solved densely lacks rank") from e
        inverse.append(low.T @ low)
        rest.append(y)
        beside.append(block(k, k + 1) if k + 1 < len(of) else np.zeros((len(rows), 0)))
    x, error = np.zeros(len(plane)), np.zeros(len(plane))
    after, whole = np.zeros(0), np.zeros((0, 0))
    for k in range(len(of) - 1, -1, -1):
        after_b = inverse[k] @ beside[k]
        after = inverse[k] @ (rest[k] - beside[k] @ after)
        whole = inverse[k] + after_b @ whole @ after_b.T
        x[of[k]], error[of[k]] = after, np.sqrt(np.diag(whole))
        inverse[k] = beside[k] = np.zeros((0, 0))
    return x, error


def fit(df: DataFrame, *, least: int = 50, weight: Column | None = None, complete_rows: bool = False, least_diagonal: int = 4, grid: Grid | None = None, by_cycle: bool = False) -> tuple[DataFrame, bool]:
    """(node, value, error, n) fitted to rows (z, nodes), and whether the system lacks rank.

    grid: tells planes apart where there are more than DENSE_NODES nodes.
    by_cycle: nodes are chosen by `cycle_bins`; rows that touch a chosen one are used, as without it.
    """
    rows = df.where(F.col("z").isNotNull() & F.col("nodes").isNotNull())
    if weight is not None:
        rows = rows.where(weight > 0)
    ids = None
    if complete_rows:
        rows, ids = consistent(rows, least)
    elif by_cycle:
        ids = [r["node"] for r in cycle_bins(rows, least).select("node").collect()]
    sums = materialize(moments(rows, weight=weight), "moments")  # the grid bounds them
    counts = {r["i"]: r["n"] for r in sums.where("i = j").select("i", "n").collect()}
    ids = sorted(n for n in (counts if ids is None else ids) if counts.get(n, 0) >= (max(least, least_diagonal) if ids is None else least_diagonal))
    if not ids:
        return df.sparkSession.createDataFrame([], "node int, value double, error double, n bigint"), True
    if len(ids) > DENSE_NODES and grid is None:
        raise ValueError(f"{len(ids)} nodes are too many to be solved densely; the grid must be given")
    matrix = sums.where(_member(ids)({"node": F.col("i")}) & _member(ids)({"node": F.col("j")}))
    vector = matrix.where("i = j").select("i", F.col("b").alias("v"))
    if len(ids) <= DENSE_NODES:
        x, error, lacking = solve(*dense(matrix, vector, ids))
    else:
        (x, error), lacking = solve_planes(*entries(matrix, vector, ids), planes(ids, grid)), False
    table = pa.table({"node": pa.array(ids, pa.int32()), "value": x, "error": error, "n": pa.array([counts[n] for n in ids], pa.int64())})
    return df.sparkSession.createDataFrame(table), lacking


def demeaned(df: DataFrame, *group: str) -> tuple[DataFrame, DataFrame]:
    """Normal equations with a free level for every group (cycle and geographic cell) taken out: matrix and vector.

    The block of group levels is diagonal (a count), so eliminating it subtracts, for every group, the outer product of
    its weight sums over its count.
    """
    sums = _group_sums(df, *group)
    return _less_groups(normal_matrix(df), normal_vector(df), sums, *group)


def _group_sums(df: DataFrame, *group: str) -> DataFrame:
    """(group..., node, s, n, sz): weight sums of a group's nodes beside its count of rows and their sum; written, as both systems read it twice."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sz")).select(*[F.col(c).alias(f"__{c}") for c in group], "n", "sz")
    s = exploded(df, *group).groupBy(*group, "node").agg(F.sum("w").alias("s"))
    return materialize(s.join(n, _same(group, [f"__{c}" for c in group])).select(*group, "node", "s", "n", "sz"), "group-sums")


def _less_groups(matrix: DataFrame, vector: DataFrame, sums: DataFrame, *group: str) -> tuple[DataFrame, DataFrame]:
    other = sums.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("node").alias("j"), F.col("s").alias("t"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group] + [F.col("node") <= F.col("j")]
    cut = sums.join(other, same).select(F.col("node").alias("i"), "j", (-F.col("s") * F.col("t") / F.col("n")).alias("v"))
    cut_v = sums.select(F.col("node").alias("i"), (-F.col("s") * F.col("sz") / F.col("n")).alias("v"))
    total = lambda d, *by: d.groupBy(*by).agg(F.sum("v").alias("v"))
    return total(matrix.unionByName(cut), "i", "j"), total(vector.unionByName(cut_v), "i")


def demeaned_counted(df: DataFrame, *group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `demeaned`, from one aggregate over the rows and one over groups, with (node, n) as third table."""
    own = materialize(moments(df), "moments")
    nodes = own.where("i = j")
    matrix, vector = _less_groups(own.select("i", "j", "v"), nodes.select("i", F.col("b").alias("v")), _group_sums(df, *group), *group)
    return matrix, vector, nodes.where("n > 0").select(F.col("i").alias("node"), "n")


def group_levels(df: DataFrame, solved: DataFrame, *group: str) -> DataFrame:
    """(group..., level, n): mean residual of each group after the grid is solved."""
    known = solved.where(F.col("value").isNotNull()).select("node", "value").toArrow()  # bounded by the grid
    values = np.zeros(max(known.column("node").to_pylist(), default=-1) + 1)
    values[known.column("node").to_numpy()] = known.column("value").to_numpy()
    at = doubles(values.tolist())
    fitted = F.aggregate("nodes", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at(at, e["node"] + 1), F.lit(0.0)))
    return df.groupBy(*group).agg(F.avg(F.col("z") - fitted).alias("level"), F.count(F.lit(1)).alias("n"))
