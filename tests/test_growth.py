"""Work and tables grow with footprints, not with pairs, and results are those of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubitgrid.functions import kernels as K
from cubitgrid.operators import cluster as C
from cubitgrid.operators import merge as M
from cubitgrid.operators import outline as L
from cubitgrid.plans import spatial_queries as Q

GAP = 33_920
BOX = "scenario_id long, building_id long, x0 long, y0 long, x1 long, y1 long"


def boxes(n: int, wide: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = rng.integers(-wide, wide, (n, 2))
    size = np.where(rng.random((n, 1)) < 0.02, rng.integers(200_000, 600_000, (n, 2)), rng.integers(1, 20_000, (n, 2)))
    return np.concatenate([at, at + size], 1)


def brute(near: np.ndarray) -> list[int]:
    root = np.arange(len(near))
    while True:
        least = np.where(near, root[None], len(near)).min(1)
        if (least == root).all():
            return root.tolist()
        root = least


def octagon(x: np.ndarray) -> np.ndarray:
    dx, dy = (np.maximum(0, np.maximum(x[None, :, k] - x[:, None, k + 2], x[:, None, k] - x[None, :, k + 2])) for k in (0, 1))
    return np.maximum(dx * K.COS_OCTAGON + dy * K.SIN_OCTAGON, dx * K.SIN_OCTAGON + dy * K.COS_OCTAGON) <= GAP


@pytest.mark.parametrize("wide", [100_000, 700_000, 3_000_000])
def test_clusters_are_those_of_all_pairs(spark, wide):
    x = boxes(400, wide, wide)
    rows = spark.createDataFrame([(i % 2, i, *map(int, b)) for i, b in enumerate(x)], BOX)
    got = {r.building_id: r.cluster for r in C.clusters(rows, GAP).collect()}
    same = np.arange(400)[:, None] % 2 == np.arange(400)[None] % 2
    assert [got[i] for i in range(400)] == brute(octagon(x) & same)


@pytest.mark.parametrize("wide", [150_000, 500_000])
def test_clusters_of_hulls_are_those_of_all_pairs(spark, wide):
    rng = np.random.default_rng(wide)
    at = rng.integers(-wide, wide, (120, 1, 2)) + rng.integers(0, 25_000, (120, 5, 2))
    rings = spark.createDataFrame([(0, i, [{"x": int(x), "y": int(y)} for x, y in ring]) for i, ring in enumerate(at)], "scenario_id long, building_id long, ring array<struct<x:long,y:long>>")
    hulls = C.with_hulls(rings)
    near = np.eye(120, dtype=bool)
    for r in C.linked_pairs(hulls, GAP).collect():
        near[r.a, r.b] = near[r.b, r.a] = True
    got = {r.building_id: r.cluster for r in C.clusters(hulls, GAP).collect()}
    assert [got[i] for i in range(120)] == brute(near)


def test_clusters_keep_rows_without_id_or_place(spark):
    rows = spark.createDataFrame([(0, 5, 0, 0, 9, 9), (0, None, 0, 0, 9, 9), (0, 7, None, 0, 9, 9), (None, 3, 0, 0, 9, 9), (0, 4, 1, 1, 9, 9)], BOX)
    assert sorted(((r.building_id, r.cluster) for r in C.clusters(rows, GAP).collect()), key=str) == [(3, 3), (4, 4), (5, 4), (7, 7), (None, None)]


def test_clusters_write_no_pairs(spark, monkeypatch):
    """600 footprints within reach of each other are 179,700 pairs."""
    seen = []
    monkeypatch.setattr(C, "components", lambda edges, *a, _of=C.components, **k: (seen.append(edges.count()), _of(edges, *a, **k))[1])
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(0, i, int(x), int(y), int(x) + 9_000, int(y) + 8_000) for i, (x, y) in enumerate(rng.integers(0, 20_000, (600, 2)))], BOX)
    assert C.clusters(rows, GAP).select("cluster").distinct().count() == 1
    assert seen[0] <= 600


def test_groups_are_tried_in_chunks():
    x = boxes(300, 200_000, 3)
    of = np.arange(300) // 7
    whole, parts = (K.linked_groups(of, x, GAP, most=n) for n in (1_000_000, 50))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_fit_angle_of_a_city_with_a_million_corners(spark, sf_dir, monkeypatch):
    """Six digits were too few for the number of its corners."""
    i = F.col("id")
    one = spark.range(260_000).select(F.lit(0).cast("long").alias("scenario_id"), F.lit(0).cast("long").alias("cluster"), (i % 650 * 100).alias("x0"), F.floor(i / 650).alias("y0"))
    rows = one.withColumns({"y0": F.col("y0") * 100, "x1": F.col("x0") + 10, "y1": F.col("y0") * 100 + 10})
    monkeypatch.setattr(Q, "_cities", lambda *_: (rows, None))
    assert [r.angle_millideg for r in Q.fit_angle(spark, sf_dir).collect()] == [0]


def test_pairs_broadcast_no_exploded_table(spark, sf_dir):
    """A small file becomes many rows by cells and hulls: Spark took it for small and sent it through the driver."""
    for name in ("hull_pairs", "pair_gap_join"):
        assert "Broadcast" not in Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_hulls_in_arrays_are_tested_as_in_columns(spark):
    from cubitgrid.functions import geometry as G

    rng = np.random.default_rng(5)
    rings = rng.integers(0, 120_000, (60, 1, 2)) + rng.integers(0, 25_000, (60, 5, 2))
    rows = spark.createDataFrame([(i, [{"x": int(x), "y": int(y)} for x, y in ring]) for i, ring in enumerate(rings)], "id long, ring array<struct<x:long,y:long>>")
    hulls = C.with_hulls(rows.selectExpr("0L as scenario_id", "id as building_id", "ring")).cache()
    pairs = hulls.alias("a").join(hulls.alias("b"), F.col("a.building_id") < F.col("b.building_id"))
    told = {(r.a, r.b) for r in pairs.where(G.hulls_near(F.col("a.hull"), F.col("b.hull"), GAP)).select(F.col("a.building_id").alias("a"), F.col("b.building_id").alias("b")).collect()}
    assert told == {(r.a, r.b) for r in C.linked_pairs(hulls, GAP).collect()} and told


@pytest.mark.parametrize("wide", [60_000, 400_000])
@pytest.mark.parametrize("size", [1, 8, 4])
def test_open_parts_are_those_of_all_neighbours(spark, monkeypatch, wide, size):
    """By a point, the octagon and a square; all but the wide footprints meet in tiles and not in a join of pairs."""
    from cubitgrid.operators import outline as L

    by = {1: np.zeros((1, 2), "int64"), 8: L.brush(GAP / 2), 4: np.array([[-9_000, -9_000], [9_000, -9_000], [9_000, 9_000], [-9_000, 9_000]], "int64")}[size]
    joined = []
    monkeypatch.setattr(C, "cell_pairs", lambda left, *a, _of=C.cell_pairs, **k: (joined.append(left.count()), _of(left, *a, **k))[1])
    x = np.unique(boxes(250, wide, wide), axis=0)
    rows = spark.createDataFrame([(0, 0, i, *map(int, b)) for i, b in enumerate(x)], "scenario_id long, cluster long, building_id long, x0 long, y0 long, x1 long, y1 long")
    got = {(r.ax, r.ay, r.bx, r.by) for r in L.open_parts(rows, by).collect()}
    assert joined == [int((np.maximum(x[:, 2] - x[:, 0], x[:, 3] - x[:, 1]) > 32_000).sum())]
    rings = [K.hull((np.array([[a, b], [c, b], [c, d], [a, d]])[:, None] + by[None]).reshape(-1, 2)).astype("int64") for a, b, c, d in x]
    n, of = np.array([len(r) for r in rings]), np.arange(len(x))
    near = [[j for j in of if j != i] for i in of]
    _, ends = K.open_parts(np.concatenate(rings), n, np.concatenate([rings[j] for js in near for j in js]), np.array([len(rings[j]) for js in near for j in js]), np.full(len(x), len(x) - 1), np.array([j < i for i, js in enumerate(near) for j in js]))
    assert got == set(map(tuple, ends.tolist()))


@pytest.mark.parametrize("wide", [60_000, 400_000])
def test_nearest_boxes_are_those_of_all_pairs(spark, monkeypatch, wide):
    """And a point that finds one close by meets none farther away."""
    from cubitgrid.operators import points as P

    rng = np.random.default_rng(wide)
    x, at = boxes(300, wide, wide), rng.integers(-wide - 150_000, wide + 150_000, (200, 2))
    looked = []
    monkeypatch.setattr(P, "cell_pairs", lambda left, *a, _of=P.cell_pairs, **k: (looked.append(left.count()), _of(left, *a, **k))[1])
    rows = spark.createDataFrame([(0, i, *map(int, b)) for i, b in enumerate(x)], BOX)
    asked = spark.createDataFrame([(0, i, *map(int, p)) for i, p in enumerate(at)], "scenario_id long, point_id long, x long, y long")
    got = {r.point_id: (r.square, r.building_id) for r in P.nearest(asked, rows, "building_id", 100_000).collect()}
    away = [np.maximum(0, np.maximum(x[None, :, k] - at[:, k, None], at[:, k, None] - x[None, :, k + 2])) for k in (0, 1)]
    square = away[0] ** 2 + away[1] ** 2
    assert got == {i: (int(q.min()), int(q.argmin())) for i, q in enumerate(square) if q.min() <= 100_000**2}
    assert looked == [200, *[int((square.min(1) > r * r).sum()) for r in (0, 6_250, 25_000)]]


@pytest.mark.parametrize("size", [1, 8, 4])
def test_buried_footprints_have_no_open_part(size):
    """Among many, most; what the rest has open needs all of them as neighbours, but none of them as its own."""
    from cubitgrid.operators import outline as L

    by = {1: np.zeros((1, 2), "int64"), 8: L.brush(GAP / 2), 4: np.array([[-9_000, -9_000], [9_000, -9_000], [9_000, 9_000], [-9_000, 9_000]], "int64")}[size]
    x = np.unique(boxes(700, 90_000, size), axis=0)
    x = x[np.maximum(x[:, 2] - x[:, 0], x[:, 3] - x[:, 1]) < 32_000]
    own = np.arange(0, len(x), 2)
    inner = K.inner_square(by)
    got = K.buried(x, own, inner, int(np.abs(by).max()) + 1, 2_000)
    rings = [K.hull((np.array([[a, b], [c, b], [c, d], [a, d]])[:, None] + by[None]).reshape(-1, 2)).astype("int64") for a, b, c, d in x]
    n = np.array([len(r) for r in rings])
    near = [[j for j in range(len(x)) if j != i] for i in own]
    of, _ = K.open_parts(np.concatenate([rings[i] for i in own]), n[own], np.concatenate([rings[j] for js in near for j in js]), np.concatenate([n[js] for js in near]), np.array([len(js) for js in near]), np.concatenate([np.array(js) < i for i, js in zip(own, near, strict=True)]))
    assert not got[np.unique(of)].any()
    assert size == 1 or got.sum() > len(own) / 3


def test_no_footprint_buries_itself():
    """One that stands alone, two that touch, and one inside another, whose sides are all held."""
    x = np.array([[0, 0, 90_000, 90_000], [90_000, 0, 120_000, 90_000], [500_000, 0, 590_000, 90_000], [20_000, 20_000, 40_000, 40_000]])
    assert K.buried(x, np.arange(4), 0, 1, 2_000).tolist() == [False, False, False, True]


@pytest.mark.parametrize("whole", [True, False])
def test_hulls_shuffle_no_points_from_inside(spark, whole):
    rng = np.random.default_rng(3)
    at = rng.integers(-9_000, 9_000, (20_000, 2)) if whole else rng.normal(0, 9_000, (20_000, 2)).round(3)
    at[:4_000, 0] = at[:4_000, 0] // 3_000 * 3_000  # many on one line
    kind = "long" if whole else "double"
    rows = spark.createDataFrame([(0, i % 7, *p) for i, p in enumerate(at.tolist())] + [(1, 8, *at[0].tolist()), (1, 9, *at[1].tolist()), (1, 9, *at[2].tolist())], f"scenario_id long, cluster long, x {kind}, y {kind}")
    got: dict = {}
    for r in C.hulls(rows, ["scenario_id", "cluster"]).orderBy("i").collect():
        got.setdefault(r.cluster, []).append([r.x, r.y])
    want = {c: at[c::7] for c in range(7)} | {8: at[:1], 9: at[1:3]}
    assert {c: sorted(p) for c, p in got.items()} == {c: sorted(slow_hull(p)) for c, p in want.items()}
    assert C._outermost(rows, ["scenario_id", "cluster"]).count() < 2_000


def slow_hull(points: np.ndarray) -> list[list[float]]:
    p, half = sorted({tuple(q) for q in points.tolist()}), []
    for order in (p, p[::-1]):
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        half += out[:-1] if len(p) > 2 else []
    return [[float(k) for k in q] for q in (half or p)]


def test_gap_lines_meet_no_footprints_of_far_sides(spark, monkeypatch):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.integers(0, 600_000, (400, 2)) // 4_000 * 4_000 + [640_000 * k, 90_000 * k] for k in range(4)])
    x = np.concatenate([at, at + rng.integers(1, 4, (1600, 2)) * 4_000], 1)
    rows = spark.createDataFrame([(0, i // 400 * 400, i, *map(int, b)) for i, b in enumerate(x)], BOX.replace("building_id", "cluster long, building_id"))
    met = []
    monkeypatch.setattr(M, "_shortest", lambda m, f=M._shortest: met.append(m) or f(m))
    got = {(r.a, r.c): (r.square, r.a_building, r.c_building) for r in M.gap_lines(rows, 200_000).collect()}
    dx, dy = (np.maximum(0, np.maximum(x[None, :, k] - x[:, None, k + 2], x[:, None, k] - x[None, :, k + 2])) for k in (0, 1))
    want = {}
    for a in range(4):
        for c in range(a + 1, 4):
            square, p, q = min((int(dx[i, j] ** 2 + dy[i, j] ** 2), i, j) for i in range(400 * a, 400 * a + 400) for j in range(400 * c, 400 * c + 400))
            if square <= 200_000**2:
                want[400 * a, 400 * c] = square, p, q
    near = int(((np.maximum(dx, dy) <= 200_000) & (np.arange(1600)[:, None] // 400 < np.arange(1600)[None] // 400)).sum())
    assert got == want and len(want) >= 3
    assert met[0].count() < near / 3


def test_union_area_writes_nothing_of_how_boxes_cut_each_other(spark):
    x = boxes(300, 150_000, 11)
    rows = spark.createDataFrame([(0, i % 2, i, *map(int, b)) for i, b in enumerate(x)], BOX.replace("building_id", "cluster long, building_id"))
    got = M.union_area(rows, ["scenario_id", "cluster"])
    want = {}
    for c in (0, 1):
        xs, ys = (np.unique(x[c::2][:, [k, k + 2]]) for k in (0, 1))
        covered = np.zeros((len(xs), len(ys)), bool)
        for b in x[c::2]:
            covered[(xs >= b[0]) & (xs < b[2])] |= (ys >= b[1]) & (ys < b[3])
        want[c] = int((np.diff(xs) * (covered[:-1, :-1] @ np.diff(ys))).sum())
        assert K.boxes_area(x[c::2], most=1_000) == want[c]
    assert {r.cluster: r.area for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().toString()


def test_boxes_are_grown_by_squares_as_column_expressions(spark, monkeypatch):
    monkeypatch.setattr(L, "grown_hull", None)
    octagon = L.brush(5_000)
    for by in (L.brush(700), np.array([[-9, -9], [9, -9], [9, 9], [-9, 9]]), K.hull((octagon[:, None] + [[-9, -9], [9, -9], [9, 9], [-9, 9]]).reshape(-1, 2)).astype("int64")):
        rows = spark.createDataFrame([(0, 0, 1, 10, 20, 400, 90)], BOX.replace("building_id", "cluster long, building_id"))
        ring = rows.select(L.grown_box(by).alias("r")).first().r
        box = np.array([[10, 20], [400, 20], [400, 90], [10, 90]])
        want = K.hull((box[:, None] + by[None]).reshape(-1, 2)).tolist()
        k = want.index(list(map(float, ring[0])))
        assert [list(map(float, p)) for p in ring] == want[k:] + want[:k]
        L.open_parts(rows, by)


def test_sides_that_others_bury_are_not_asked():
    """Sides that meet no bare cell have no open part, and the others have the same ones when they alone are asked."""
    rng = np.random.default_rng(5)
    by = L.brush(17_000.0, 17_500.0)
    x = rng.integers(0, 200_000, (120, 2))
    boxes = np.concatenate([x, x + rng.integers(7_000, 20_000, (120, 2))], 1)
    corner = [(k, c) for k, c in L._rim(by)]
    rings = np.stack([np.stack([boxes[:, 2 * i] + int(by[k, 0]), boxes[:, 1 + 2 * j] + int(by[k, 1])], 1) for k, (i, j) in corner], 1)
    n, sides = len(boxes), rings.shape[1]
    others = np.stack([np.delete(np.arange(n), k) for k in range(n)])
    given = rings.reshape(-1, 2), np.full(n, sides), rings[others.ravel()].reshape(-1, 2), np.full(n * (n - 1), sides), np.full(n, n - 1), (others < np.arange(n)[:, None]).ravel()
    side, ends = K.open_of_sides(*given)
    end = K.following(given[0], given[1])
    bare = K.meets_bare(boxes, np.minimum(given[0], end), np.maximum(given[0], end), K.inner_square(by), 2_000)
    assert set(side) <= set(np.flatnonzero(bare)) and bare.sum() < 0.4 * len(bare)
    again, parts = K.open_of_sides(*given, bare)
    assert np.array_equal(side, again) and np.array_equal(ends, parts)
    assert np.array_equal(K.open_parts(*given)[1], ends)
