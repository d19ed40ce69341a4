"""Models evaluated across unknown nodes, by planes over a triangulation of the known ones."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import bilinear, closed, node_array
from .grid import Grid

#: How far outside a triangle, in parts of it, a position may lie by rounding.
SLACK = 1e-9


def triangulate(x: np.ndarray, y: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Delaunay triangles of points as rows of three indices, counter-clockwise; none if all points are in line.

    The front starts at an edge of the hull. An edge takes the point on its left that makes the flattest fold with it on the
    paraboloid x² + y² + tie; `tie`, small against squared distances, chooses among points on one circle. The work is edges
    times points, both bounded by the grid (a second or two for the 4,116 nodes of the standard axes).
    """
    if len(x) < 3:
        return np.empty((0, 3), int)
    lift = x * x + y * y + tie
    first = int(np.lexsort((y, x))[0])
    angle, far = np.arctan2(y - y[first], x - x[first]), np.hypot(x - x[first], y - y[first])
    angle[first] = np.inf
    lowest = np.flatnonzero(angle <= angle.min() + 1e-12)
    front, done, out = [(first, int(lowest[np.argmin(far[lowest])]))], set(), []
    while front:
        a, b = front.pop()
        if (a, b) in done:
            continue
        ex, ey = x[b] - x[a], y[b] - y[a]
        side = ex * (y - y[a]) - ey * (x - x[a])
        left = np.flatnonzero(side > 1e-9 * (ex * ex + ey * ey))
        if not left.size:
            continue
        along = (ex * (x[left] - x[a]) + ey * (y[left] - y[a])) / (ex * ex + ey * ey)
        c = int(left[np.argmin((lift[left] - lift[a] - along * (lift[b] - lift[a])) / side[left])])
        out.append((a, b, c))
        done |= {(a, b), (b, c), (c, a)}
        front += [(b, a), (c, b), (a, c)]
    return np.array(out, int).reshape(-1, 3)


def _gaps_of_plane(values: np.ndarray, grid: Grid) -> list[list[list[float]]]:
    """For each cell of one plane of nodes, along x first, the triangles that meet it; none where four nodes are known.

    A triangle is three affine functions of the position in steps (u, v), each as (constant, by u, by v): the parts of its first
    two corners, and its plane.
    """
    nx, ny = grid.x.count, grid.y.count
    known = np.flatnonzero(~np.isnan(values))
    u, v = known % nx, known // nx
    sx, sy = grid.x.step, grid.y.step
    found = triangulate(u * sx, v * sy, 1e-6 * sx * sy * (known * known % 1009) / 1009)
    there = ~np.isnan(values.reshape(ny, nx))
    gap = ~(there[:-1, :-1] & there[:-1, 1:] & there[1:, :-1] & there[1:, 1:])
    out: list[list[list[float]]] = [[] for _ in range((nx - 1) * (ny - 1))]
    for t in found:
        tu, tv = u[t], v[t]
        parts = np.linalg.inv(np.array([[1, 1, 1], tu, tv], float))  # a row for each corner
        plane = values[known[t]] @ parts
        i, j = np.meshgrid(np.arange(tu.min(), min(tu.max() + 1, nx - 1)), np.arange(tv.min(), min(tv.max() + 1, ny - 1)))  # a cell holds its lower sides
        at = gap[j, i]
        i, j = i[at], j[at]
        # a cell is met unless one side of the triangle has all the cell's corners outside
        corners = np.stack([parts[:, :1] + parts[:, 1:2] * (i + di) + parts[:, 2:] * (j + dj) for di in (0, 1) for dj in (0, 1)])
        for cell in (i + j * (nx - 1))[(corners.max(axis=0) >= -SLACK).all(axis=0)]:
            out[cell].append([float(n) for n in (*parts[0], *parts[1], *plane)])
    return out


def gap_table(model: DataFrame, grid: Grid, value: str = "value") -> Column:
    """The triangles of every cell of every plane that has unknown nodes, as a literal; the grid bounds it."""
    nodes = np.full(grid.size, np.nan)
    for r in model.select("node", value).collect():  # a row for each node of the grid
        nodes[r["node"]] = np.nan if r[value] is None else r[value]
    planes = nodes.reshape(-1, grid.x.count * grid.y.count)
    return F.from_json(F.lit(json.dumps([c for p in planes for c in _gaps_of_plane(p, grid)])), "array<array<array<double>>>")


def _gap_value(table: Column, grid: Grid, x: Column, y: Column, plane: Column | None) -> Column:
    (i, _), (j, _) = closed(x, grid.x), closed(y, grid.y)
    cell = i + j * (grid.x.count - 1)
    if plane is not None:
        cell = cell + plane * (grid.x.count - 1) * (grid.y.count - 1)
    place = F.struct(cell.alias("cell"), ((x - F.lit(grid.x.first)) / F.lit(grid.x.step)).alias("u"), ((y - F.lit(grid.y.first)) / F.lit(grid.y.step)).alias("v"))

    def value(p: Column) -> Column:
        of = lambda t, k: t[k] + t[k + 1] * p["u"] + t[k + 2] * p["v"]
        holds = lambda t: (of(t, 0) >= -SLACK) & (of(t, 3) >= -SLACK) & (of(t, 0) + of(t, 3) <= 1 + SLACK)
        return F.get(F.transform(F.filter(F.try_element_at(table, p["cell"] + 1), holds), lambda t: of(t, 6)), F.lit(0))

    inside = x.between(grid.x.first, grid.x.last) & y.between(grid.y.first, grid.y.last)
    return F.when(inside, F.transform(F.array(place), value)[0])


def across_gaps(model: DataFrame, grid: Grid, x: Column, y: Column, z: Column | None = None, *, value: str = "value") -> Column:
    """A model (node, value) at a position: bilinear where the cell's four nodes are known, else a plane through three known nodes.

    The three are the triangle around the position in a Delaunay triangulation of the known nodes, so that values reach over holes
    of any size; outside the hull of the known nodes, outside the grid and at a NULL position the value is NULL. With a third axis
    the planes of nodes above and below are taken each by itself, and a plane without weight may be unknown.
    """
    values, table = node_array(model, grid, value), gap_table(model, grid, value)
    on = lambda k: F.coalesce(bilinear(values, grid, x, y, plane=k), _gap_value(table, grid, x, y, k))
    if grid.z is None:
        return on(None)
    k, f = closed(z, grid.z)
    low, high = on(k), on(k + 1)
    return F.when(z.between(grid.z.first, grid.z.last), F.when(f == 0, low).when(f == 1, high).otherwise(low * (1 - f) + high * f))
