"""Quadtree covers against the even-odd rule over all edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import cover, spatial

SHAPE = "shape_order int, value double, rings array<array<struct<x:double,y:double>>>"


def inside(edges, x, y):
    hit = False
    for x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def edges_of(rings):
    return [(*p, *q) for r in rings for p, q in zip(r, r[1:] + r[:1])]


def coast(n, seed=3, radius=100.0):
    r = random.Random(seed)
    return [(radius * (1 + .2 * r.random()) * math.cos(2 * math.pi * i / n), radius * (1 + .2 * r.random()) * math.sin(2 * math.pi * i / n))
            for i in range(n)]


SHAPES = {
    "coast": [coast(800)], "holes": [[(0, 0), (64, 0), (64, 64), (0, 64)], [(10, 10), (20.5, 10), (20.5, 30), (10, 30)], [(40, 40), (50, 40), (45, 60)]],
    "star": [[(0, 0) if i % 2 else (30 * math.cos(i), 30 * math.sin(i)) for i in range(40)]],
    "tiny": [[(1e-3, 2e-3), (2e-3, 2e-3), (1e-3, 3e-3)]], "far": [[(-1e7 + 5, 4e6), (-1e7 + 300, 4e6 + 7), (-1e7 + 90, 4e6 + 800)]],
}


@pytest.mark.parametrize("name", list(SHAPES))
@pytest.mark.parametrize("max_edges", [2, 50])
def test_cells_tell_inside_from_outside(name, max_edges):
    rings = SHAPES[name]
    edges = np.array(edges_of(rings), float)
    found = cover.cells_of(edges, max_edges)
    r = random.Random(5)
    lo, hi = edges.min(0), edges.max(0)
    x0, x1, y0, y1 = min(lo[0], lo[2]), max(hi[0], hi[2]), min(lo[1], lo[3]), max(hi[1], hi[3])
    points = [(r.uniform(x0 - 1e-3, x1 + 1e-3), r.uniform(y0 - 1e-3, y1 + 1e-3)) for _ in range(400)]
    points += [(round(x), round(y) + .5) for x, y in points[:50]]
    at = {c[:3]: c[3:] for c in found}
    for x, y in points:
        hits = 0
        for level in {c[0] for c in found}:
            side = 4.0 ** level
            cx, cy = math.floor(x / side), math.floor(y / side)
            if (level, cx, cy) in at:
                known, own = at[level, cx, cy]
                hits += cover._inside(own, ((cx + 1) * side, cy * side), known, x, y) if len(own) else known
        assert hits == inside(edges.tolist(), x, y), (x, y)


def test_a_coast_gets_cells_with_few_edges():
    edges = np.array(edges_of([coast(5000)]), float)
    found = cover.cells_of(edges)
    assert max(len(c[4]) for c in found) <= 8
    whole = [4.0 ** (2 * c[0]) for c in found if not len(c[4])]
    assert sum(whole) > .7 * math.pi * 100 ** 2


def test_burn_and_clip_use_every_level(spark):
    rings = [SHAPES["coast"], SHAPES["holes"], [[(x + 150, y) for x, y in SHAPES["star"][0]]]]
    s = spark.createDataFrame([(i, float(i), [[(float(x), float(y)) for x, y in r] for r in rs]) for i, rs in enumerate(rings)] + [(9, 9.0, None)], SHAPE)
    pts = spark.range(160 * 120).select((F.col("id") % 160 * 2 - 130).cast("double").alias("x"), (F.floor(F.col("id") / 160) * 2 - 121.5).alias("y"))
    levels = cover.levels_of(cover.cover(s))
    assert len(levels) > 2
    got = {(r.x, r.y): r.value for r in spatial.burn(pts, s, "value", ["x", "y"]).collect()}
    edges = [edges_of(r) for r in rings]
    want = {}
    for p in pts.collect():
        own = [i for i, e in enumerate(edges) if inside(e, p.x, p.y)]
        if own:
            want[p.x, p.y] = float(own[-1])
    assert got == want
    assert {(r.x, r.y) for r in spatial.clip_to_region(pts, s, F.col("x"), F.col("y")).collect()} == set(want)
    assert spatial.clip_to_region(pts, s.limit(0), F.col("x"), F.col("y")).count() == 0
    assert spatial.burn(pts, s.limit(0), "value", ["x", "y"]).count() == 0
