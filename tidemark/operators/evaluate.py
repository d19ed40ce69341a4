"""Evaluation of gridded models at observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import doubles
from .design import NODES
from .grid import Axis, Grid


def node_array(model: DataFrame, grid: Grid, value: str = "value") -> Column:
    """A model as a literal array over all nodes (NULL where unknown); the grid bounds it."""
    values: list[float | None] = [None] * grid.size
    for r in model.select("node", value).collect():
        values[r["node"]] = r[value]
    return doubles(values)


def closed(v: Column, axis: Axis) -> tuple[Column, Column]:
    """Cell and place for a lookup: [low, high), the last cell closed."""
    at = (v - F.lit(axis.first)) / F.lit(axis.step)
    i = F.least(F.floor(at).cast("int"), F.lit(axis.count - 2))
    return i, at - i


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def bilinear(values: Column, grid: Grid, x: Column, y: Column, *, planes: bool = True, half_open: bool = False, plane: Column | None = None) -> Column:
    """Bilinear where the cell's four nodes are known, with `planes` the plane through three that are, else NULL.

    half_open: positions on the last node of an axis are outside. plane: which plane of nodes of a third axis. Cell, corners and value are each bound by a lambda, so
    that a filter on the value does not multiply them.
    """
    i, fx = closed(x, grid.x)
    j, fy = closed(y, grid.y)
    inside = x.between(grid.x.first, grid.x.last) & y.between(grid.y.first, grid.y.last)
    if half_open:
        inside &= (x < grid.x.last) & (y < grid.y.last)

    def corners(c: Column) -> Column:
        at = [F.try_element_at(values, c["i"] + di + (c["j"] + dj) * grid.x.count + 1).alias(f"v{k}") for k, (dj, di) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))]
        return F.struct(c["fx"].alias("fx"), c["fy"].alias("fy"), *at)

    def value(c: Column) -> Column:
        fx, fy = c["fx"], c["fy"]
        v = [c[f"v{k}"] for k in range(4)]
        ok = [_known(e) for e in v]
        full = v[0] * (1 - fx) * (1 - fy) + v[1] * fx * (1 - fy) + v[2] * (1 - fx) * fy + v[3] * fx * fy
        # a plane is defined within its triangle only
        missing = [
            F.when((fx + fy >= 1), v[3] + (v[2] - v[3]) * (1 - fx) + (v[1] - v[3]) * (1 - fy)),
            F.when((fx <= fy), v[2] + (v[3] - v[2]) * fx + (v[0] - v[2]) * (1 - fy)),
            F.when((fx >= fy), v[1] + (v[0] - v[1]) * (1 - fx) + (v[3] - v[1]) * fy),
            F.when((fx + fy <= 1), v[0] + (v[1] - v[0]) * fx + (v[2] - v[0]) * fy),
        ]
        out = F.when(ok[0] & ok[1] & ok[2] & ok[3], full)
        for k in range(4) if planes else ():
            out = out.when(~ok[k] & ok[(k + 1) % 4] & ok[(k + 2) % 4] & ok[(k + 3) % 4], missing[k])
        return out

    if plane is not None:
        j = j + plane * grid.y.count
    cell = F.struct(i.alias("i"), fx.alias("fx"), j.alias("j"), fy.alias("fy"))
    return F.when(inside, F.transform(F.transform(F.array(cell), corners), value)[0])


def trilinear(values: Column, grid: Grid, x: Column, y: Column, z: Column) -> Column:
    """Trilinear where the cell's eight nodes are known, else NULL."""
    inside = x.between(grid.x.first, grid.x.last) & y.between(grid.y.first, grid.y.last) & z.between(grid.z.first, grid.z.last)
    cell = F.struct(*[c.alias(n + str(k)) for k, (v, a) in enumerate(((x, grid.x), (y, grid.y), (z, grid.z))) for n, c in zip("if", closed(v, a), strict=True)])

    def value(c: Column) -> Column:
        out = F.lit(0.0)
        for dk in (0, 1):
            for dj in (0, 1):
                for di in (0, 1):
                    v = F.try_element_at(values, c["i0"] + di + (c["i1"] + dj) * grid.x.count + (c["i2"] + dk) * grid.x.count * grid.y.count + 1)
                    out = out + v * (c["f0"] if di else 1 - c["f0"]) * (c["f1"] if dj else 1 - c["f1"]) * (c["f2"] if dk else 1 - c["f2"])
        return out

    out = F.transform(F.array(cell), value)[0]
    return F.when(inside & _known(out), out)


def apply_weights(nodes: Column, values: Column) -> Column:
    """Model value from a row's own weights; NULL if a node with weight is unknown."""
    total = F.aggregate(nodes.cast(NODES), F.lit(0.0), lambda s, e: s + F.when(e["w"] == 0, F.lit(0.0)).otherwise(e["w"] * F.try_element_at(values, e["node"] + 1)))
    return F.when(_known(total), total)


def raster_lookup(df: DataFrame, raster: DataFrame, step: float, lat: str = "lat", lon: str = "lon", out: str = "raster") -> DataFrame:
    """Bilinear value of a raster (ilat, ilon, z) at a position: one equi-join with each cell's four corners.

    The raster is turned into cells with corner values first, so observations are joined once.
    """
    n = int(round(360 / step))
    r = raster.select("ilat", "ilon", "z")
    corner = lambda di, dj: r.select((F.col("ilat") - di).alias("ci"), F.pmod(F.col("ilon") - dj, F.lit(n)).alias("cj"), F.struct(F.lit(2 * di + dj).alias("k"), "z").alias("e"))
    cells = corner(0, 0).unionByName(corner(0, 1)).unionByName(corner(1, 0)).unionByName(corner(1, 1)).groupBy("ci", "cj").agg(F.map_from_entries(F.collect_list("e")).alias("c"))
    y, x = (F.col(lat) + 90.0) / step, F.pmod(F.col(lon), F.lit(360.0)) / step
    rows = df.withColumn("__i", F.floor(y).cast("int")).withColumn("__j", F.floor(x).cast("int")).withColumn("__fy", y - F.floor(y)).withColumn("__fx", x - F.floor(x))
    rows = rows.join(cells, (F.col("__i") == F.col("ci")) & (F.col("__j") == F.col("cj")), "left")
    c = lambda k: F.try_element_at("c", F.lit(k))
    value = c(0) * (1 - F.col("__fy")) * (1 - F.col("__fx")) + c(1) * (1 - F.col("__fy")) * F.col("__fx") + c(2) * F.col("__fy") * (1 - F.col("__fx")) + c(3) * F.col("__fy") * F.col("__fx")
    return rows.withColumn(out, value).drop("__i", "__j", "__fy", "__fx", "ci", "cj", "c")
