"""Bridges of merged cities against a flood over a raster."""

import numpy as np
import pytest

from cubitgrid.functions import kernels as K
from cubitgrid.operators.bridges import bridges

ROWS = "scenario_id bigint, root bigint, cluster bigint, building_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint"
NOTHING = np.zeros((1, 2), "int64")


def square(r):
    return np.array([[-r, -r], [r, -r], [r, r], [-r, r]], "int64")


def moved(grid, r, f):
    """Each pixel with the most (or least) of the pixels at most r away on both axes."""
    for axis in (0, 1):
        grid = f([np.roll(grid, k, axis) for k in range(-r, r + 1)], axis=0)
    return grid


def flood(rows, r, n=140, at=30):
    """{(x, y): (area, parts)} of the pieces of one city that touch two parts, with pixels as units."""
    owner = np.zeros((n, n), int)
    for _, _, part, _, x0, y0, x1, y1 in rows:
        owner[x0 + at : x1 + at, y0 + at : y1 + at] = part
    fill = moved(moved(owner > 0, r, np.max), r, np.min) & (owner == 0)
    out, todo = {}, {tuple(p) for p in np.argwhere(fill)}
    while todo:
        stack = [todo.pop()]
        piece, parts = set(stack), set()
        while stack:
            x, y = stack.pop()
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if owner[q]:
                    parts.add(owner[q])
                elif q in todo:
                    todo.remove(q)
                    piece.add(q)
                    stack.append(q)
        if len(parts) > 1:
            x, y = min(piece)
            out[x - at, y - at] = (len(piece), len(parts))
    return out


def parted(root, seed, n, size, wide):
    """Boxes of which those that meet have the same part."""
    g = np.random.default_rng(seed)
    boxes = []
    for _ in range(n):
        x, y = (int(v) for v in g.integers(0, size, 2))
        boxes.append((x, y, x + int(g.integers(2, wide)), y + int(g.integers(2, wide))))
    part = list(range(n))
    for _ in range(n):
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
                    part[i] = part[j] = min(part[i], part[j])
    return [(1, root, root * 1_000 + p, root * 1_000 + k, *b) for k, (p, b) in enumerate(zip(part, boxes, strict=True))]


def test_pieces_are_those_of_a_flood(spark):
    """Scattered cities, one whose part lies in the middle of a piece, and one of a single part."""
    frame = [(0, 0, 60, 4), (0, 56, 60, 60), (0, 4, 4, 56), (56, 4, 60, 56)]
    cities = {k: parted(k, k, 22, 70, 12) for k in (1, 2, 3)}
    cities[4] = [(1, 4, 4_001, 4_000 + k, *b) for k, b in enumerate(frame)] + [(1, 4, 4_002, 4_010, 28, 28, 32, 33)]
    cities[5] = [(1, 5, 5_001, 5_000 + k, 12 * k, 0, 12 * k + 5, 9) for k in range(4)]
    seen = []
    for r in (4, 14):
        got = bridges(spark.createDataFrame([row for v in cities.values() for row in v], ROWS), NOTHING, square(r)).collect()
        for root, rows in cities.items():
            mine = sorted((p for p in got if p.root == root), key=lambda p: p.piece)
            want = flood(rows, r) if root != 5 else {}
            assert {(p.x, p.y): (p.area, p.n_parts) for p in mine} == want
            assert [p.piece for p in mine] == list(range(len(want))) and {p.n_pieces for p in mine} <= {len(want)}
            assert [(p.x, p.y) for p in mine] == sorted(want)
            seen += [(root, r, p.n_parts) for p in mine]
    assert (4, 14, 2) in seen and len(seen) > 6


@pytest.mark.parametrize("gap", [20_000, 60_000])
def test_bridge_between_rounded_parts(spark, gap):
    """Parts that face each other within twice the brush are joined by one piece, parts farther apart by none."""
    grown, close = K.snapped(K.grown(np.zeros((1, 2)), 10_000), 1.0), K.snapped(K.rounded(np.zeros((1, 2)), 15_000), 1.0)
    wide = int(2 * grown[:, 0].max()) + gap
    rows = [(1, 1, 1, 1, 0, 0, 50_000, 90_000), (1, 1, 2, 2, 50_000 + wide, 10_000, 100_000 + wide, 80_000)]
    got = bridges(spark.createDataFrame(rows, ROWS), grown, close).collect()
    assert [(p.n_parts, p.n_pieces) for p in got] == ([(2, 1)] if gap < 30_000 else [])
    if got:
        assert 70_000 * gap < got[0].area < 110_000 * gap


def test_nothing_to_bridge(spark):
    assert bridges(spark.createDataFrame([], ROWS), NOTHING, square(5)).collect() == []
