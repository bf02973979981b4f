"""Adaptive quadtree covers of shapes, for point tests with a bounded number of edges.

A cell holds the edges that meet it and whether its lower right corner is inside. A cell
with more than ``max_edges`` of them is cut into 4 x 4 cells, so a coast of many edges gets
fine cells along it while the land behind stays in coarse ones; cells without edges are wholly
inside and need no test, or outside and are not listed. A point is compared with its
cell's own edges only: inside-ness changes once per edge crossed on the way from the corner up
the cell's right side and then left to the point. Both parts of the way use the position
of an edge at a height, as the even-odd rule does, so points and corners on an edge or in a
vertex fall to the same side as they do when all edges are tested.

Points of a raster share few heights, so the edges of a cell are met once per height, which
gives the intervals of x that are inside; a point then only compares its x with them.

Cells have sides 4^level and lie on a fixed grid, so the cells of one level are an equi join
key, and points meet the cover level by level. A shape is one row; its cover is built
with array operations inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans import materialise

#: Edges a cell may hold, and levels below the first one until a cell is left as it is.
MAX_EDGES, DEPTH = 4, 12

_DOUBLES, _FLAGS = ("x1", "y1", "dx", "dy", "lo", "hi"), ("above", "below", "left")
_EDGE = "struct<" + ",".join([*[f"{n}:double" for n in _DOUBLES], *[f"{n}:boolean" for n in _FLAGS]]) + ">"


def _meeting(edges: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Edges (x1, y1, x2, y2) that may meet a closed box; none that does is left out."""
    x0, y0, x1, y1 = box
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:4]), np.maximum(edges[:, :2], edges[:, 2:4])
    near = (lo[:, 0] <= x1) & (hi[:, 0] >= x0) & (lo[:, 1] <= y1) & (hi[:, 1] >= y0)
    some = np.flatnonzero(near)
    ax, ay, bx, by = edges[some, :4].T
    side = np.stack([(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (x0, x1) for cy in (y0, y1)])
    slack = 1e-9 * (np.abs(bx - ax) + np.abs(by - ay)) * (x1 - x0 + y1 - y0)
    return some[~((side > slack).all(0) | (side < -slack).all(0))]


def _ray(edges: np.ndarray, x: float, y: float) -> bool:
    """Even-odd rule for one point against all edges."""
    x1, y1, x2, y2 = edges[:, :4].T
    spans = (y1 > y) != (y2 > y)
    e = edges[spans]
    return bool((x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]).sum() & 1)


def _position(edges: np.ndarray, y: float) -> tuple[np.ndarray, np.ndarray]:
    """(x of each edge at a height, whether it spans the height); beyond its ends an edge is at its nearer end."""
    x1, y1, x2, y2 = edges[:, :4].T
    spans = (y1 > y) != (y2 > y)
    at = np.where((y >= y1) & (y >= y2), np.where(y1 > y2, x1, x2), np.where(y1 > y2, x2, x1))
    e = edges[spans]
    at[spans] = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
    return at, spans


def _inside(edges: np.ndarray, corner: tuple[float, float], known: bool, x: float, y: float) -> bool:
    """Inside-ness of a point of a cell from that of the cell's lower right corner."""
    below, _ = _position(edges, corner[1])
    at, spans = _position(edges, y)
    up = (corner[0] < below) != (corner[0] < at)
    across = spans & ((x < at) != (corner[0] < at))
    return known ^ bool((up.sum() + across.sum()) & 1)


def cells_of(edges: np.ndarray, max_edges: int = MAX_EDGES, depth: int = DEPTH) -> list[tuple[int, int, int, bool, np.ndarray]]:
    """(level, cx, cy, corner inside, edges) of the cells that hold a part of a shape."""
    if not len(edges):
        return []
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    extent = max(xs.max() - xs.min(), ys.max() - ys.min(), 1e-9)
    level = int(np.ceil(np.log2(extent) / 2))
    side = 4.0 ** level
    open_cells = []
    for cx in range(int(np.floor(xs.min() / side)), int(np.floor(xs.max() / side)) + 1):
        for cy in range(int(np.floor(ys.min() / side)), int(np.floor(ys.max() / side)) + 1):
            corner = ((cx + 1) * side, cy * side)
            own = edges[_meeting(edges, (cx * side, cy * side, corner[0], (cy + 1) * side))]
            open_cells.append((level, cx, cy, _ray(edges, *corner), own))
    out = []
    while open_cells:
        level_now, cx, cy, known, own = open_cells.pop()
        if len(own) <= max_edges or level - level_now >= depth:
            if len(own) or known:
                out.append((level_now, cx, cy, known, own))
            continue
        side = 4.0 ** level_now
        small, corner = side / 4, ((cx + 1) * side, cy * side)
        for i in range(4):
            for j in range(4):
                x, y = 4 * cx + i, 4 * cy + j
                part = own[_meeting(own, (x * small, y * small, (x + 1) * small, (y + 1) * small))]
                open_cells.append((level_now - 1, x, y, _inside(own, corner, known, (x + 1) * small, y * small), part))
    return out


def _facts(edges: np.ndarray, xr: float, yr: float) -> list[tuple]:
    """What a point test needs of each edge, seen from the corner of its cell.

    An edge that spans the point's height changes inside-ness where ``left`` (the corner is
    left of it) differs from the point's side; one below or above the point changes it by
    ``above`` or ``below``, which the point does not alter.
    """
    x1, y1, x2, y2 = edges[:, :4].T
    start, _ = _position(edges, yr)
    left, up = xr < start, y1 > y2
    high, low = np.where(up, x1, x2), np.where(up, x2, x1)
    return list(zip(x1.tolist(), y1.tolist(), (x2 - x1).tolist(), (y2 - y1).tolist(), np.minimum(y1, y2).tolist(),
                    np.maximum(y1, y2).tolist(), (left != (xr < high)).tolist(), (left != (xr < low)).tolist(), left.tolist()))


def cover(shapes: DataFrame, keep: Sequence[str] = (), max_edges: int = MAX_EDGES, depth: int = DEPTH) -> DataFrame:
    """Cells of shapes with ``rings``: columns ``keep``, _level, _cx, _cy, _known, _edges.

    Rings close themselves; a shape without geometry gives no cells. ``_known`` is the
    inside-ness of the lower right corner; ``_edges`` is NULL in cells wholly inside.
    """
    keep = list(dict.fromkeys(keep))
    rows = shapes.filter(F.col("rings").isNotNull()).select(*keep, F.transform("rings", lambda r: F.transform(
        r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))).alias("rings"))
    fields = (*_DOUBLES, *_FLAGS)
    kind = pa.struct([(n, pa.float64()) for n in _DOUBLES] + [(n, pa.bool_()) for n in _FLAGS])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
                       + [f"_level int, _cx long, _cy long, _known boolean, _edges array<{_EDGE}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rings in enumerate(batch.column("rings").to_pylist()):
                parts = [np.array([(p["x"], p["y"]) for p in r]) for r in rings if r]
                edges = np.concatenate([np.hstack([p, np.roll(p, -1, 0)]) for p in parts]) if parts else np.empty((0, 4))
                found = cells_of(edges, max_edges, depth)
                for k in range(0, len(found), 4096):
                    level, cx, cy, known, own = zip(*found[k:k + 4096])
                    facts = [[dict(zip(fields, e)) for e in _facts(o, (x + 1) * 4.0 ** v, y * 4.0 ** v)] or None
                             for o, x, y, v in zip(own, cx, cy, level)]
                    at = pa.array([i] * len(level))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(at) for c in keep], pa.array(level, pa.int32()), pa.array(cx), pa.array(cy),
                         pa.array(known), pa.array(facts, pa.list_(kind))], [*keep, "_level", "_cx", "_cy", "_known", "_edges"])
    return rows.mapInArrow(run, schema)


def levels_of(cells: DataFrame) -> list[int]:
    """Levels that a cover has: a row per level."""
    return sorted(r["_level"] for r in cells.select("_level").distinct().collect())


def _intervals(y: Column, xr: Column) -> Column:
    """Inside intervals [a, b) of a cell at a height, from right to left."""
    infinity = F.lit(float("inf"))
    edges = F.coalesce("_edges", F.array().cast(f"array<{_EDGE}>"))

    def at(e: Column) -> Column:
        return F.when((y >= e["lo"]) & (y < e["hi"]), e["dx"] * (y - e["y1"]) / e["dy"] + e["x1"])

    def flips(e: Column) -> Column:
        return F.when(y >= e["hi"], e["above"]).when(y < e["lo"], e["below"]).otherwise(e["left"] != (xr < at(e)))

    right = F.aggregate(edges, F.col("_known"), lambda inside, e: inside != flips(e))
    crossed = F.filter(F.transform(edges, at), lambda v: v <= xr)
    cuts = F.concat(F.array(infinity), F.reverse(F.array_sort(crossed)), F.array(-infinity))
    # starting at the right side, every second interval has the right side's answer
    pieces = F.transform(F.slice(cuts, 2, F.size(cuts)), lambda v, i: F.struct(
        v.alias("a"), F.get(cuts, i).alias("b"), (right == (i % 2 == 0)).alias("in")))
    return F.filter(pieces, lambda p: p["in"] & (p["a"] < p["b"]))


def row_spans(points: DataFrame, x: Column, y: Column, cells: DataFrame, levels: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Inside intervals per cell and height: (keep, _level, _cx, _y, _a, _b), for the heights at which points lie.

    A cell's edges are met once per height instead of once per point: a raster has as many
    heights as rows. Points with the same (_cx, _y) and _a <= x < _b are inside.
    """
    if not levels:
        return cells.select(*keep, "_level", "_cx", F.lit(0.0).alias("_y"), F.lit(0.0).alias("_a"), F.lit(0.0).alias("_b")).limit(0)
    finest = F.floor(x / F.lit(4.0 ** levels[0]))
    keys = points.select(finest.alias("_fx"), y.cast("double").alias("_y")).distinct()
    if len(levels) > 1:
        keys = materialise(keys, "point_rows")
    found = None
    for level in levels:
        side = 4.0 ** level
        cx = F.floor(F.col("_fx") / F.lit(4.0 ** (level - levels[0])))
        rows = keys.select(cx.alias("_cx"), "_y").distinct().withColumn("_cy", F.floor(F.col("_y") / F.lit(side)))
        near = rows.join(cells.filter(F.col("_level") == level), ["_cx", "_cy"]).select(
            *keep, "_level", "_cx", "_y", F.explode(_intervals(F.col("_y"), (F.col("_cx") + 1) * F.lit(side))).alias("_p"))
        found = near if found is None else found.union(near)
    return materialise(found.select(*keep, "_level", "_cx", "_y", F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b")), "row_spans")


def column_at(level: int, x: Column) -> Column:
    return F.floor(x / F.lit(4.0 ** level))
