"""Nearest lines, overlays and stored layouts against plain versions."""

import random
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from cubitgrid.functions import kernels as K
from cubitgrid.operators import nearest as N
from cubitgrid.operators import outline as L
from cubitgrid.operators import overlay as V
from cubitgrid.operators import scan
from cubitgrid.plans.tables import Tables

SIDE = "scenario_id bigint, cluster bigint, ax double, ay double, bx double, by double"
NOTHING = np.zeros((1, 2), "int64")


def sides(spark, rings):
    """rings: (cluster, list of corners)."""
    rows = [(1, c, *map(float, p), *map(float, q)) for c, ring in rings for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return spark.createDataFrame(rows, SIDE)


def blob(seed, x, y, size, corners=9):
    """A star-shaped ring of whole corners, counter-clockwise."""
    r = random.Random(seed)
    at = sorted(r.uniform(0, 2 * np.pi) for _ in range(corners))
    return [(round(x + np.cos(a) * size * r.uniform(0.4, 1)), round(y + np.sin(a) * size * r.uniform(0.4, 1))) for a in at]


def segments_gap(p, q):
    """Least distance of all pairs of sides, by corners; 0 where two cross."""
    def edges(rings):
        return [(np.array(a, float), np.array(b, float)) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]

    def foot(c, a, b):
        d = b - a
        t = 0 if not d.any() else min(1, max(0, (c - a) @ d / (d @ d)))
        return float(np.hypot(*(c - a - t * d)))

    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    best = np.inf
    for (a, b), (c, d) in product(edges(p), edges(q)):
        if cross(b - a, c - a) * cross(b - a, d - a) < 0 and cross(d - c, a - c) * cross(d - c, b - c) < 0:
            return 0.0
        best = min(best, foot(a, c, d), foot(b, c, d), foot(c, a, b), foot(d, a, b))
    return best


def test_ring_lines_near_and_far(spark):
    """Side by side, 300 km apart, in a hole, crossing, touching in a corner, one city without rings."""
    hole = [(0, 0), (0, 100_000), (100_000, 100_000), (100_000, 0)]
    rings = {1: [[(-50_000, -50_000), (150_000, -50_000), (150_000, 150_000), (-50_000, 150_000)], hole], 2: [blob(1, 40_000, 50_000, 20_000)], 3: [blob(2, 260_000, 60_000, 90_000, 25)], 4: [blob(3, 300_000_000, -5_000, 60_000)]}
    rings |= {5: [[(150_000, 150_000), (190_000, 160_000), (180_000, 210_000)]], 6: [blob(7, -900_000, 400_000, 400_000, 60)], 7: [blob(8, -880_000, 1_300_000, 400_000, 60)]}
    df = sides(spark, [(c, r) for c, some in rings.items() for r in some])
    pairs = [(1, a, c) for a in rings for c in rings if a < c] + [(1, 1, 99)]
    got = {(r.a, r.c): r for r in N.ring_lines(spark.createDataFrame(pairs, "scenario_id bigint, a bigint, c bigint"), df).collect()}
    assert set(got) == {p[1:] for p in pairs[:-1]}
    for (a, c), r in got.items():
        assert r.far == pytest.approx(segments_gap(rings[a], rings[c]), abs=1e-6), (a, c)
        assert np.hypot(r.qx - r.px, r.qy - r.py) == pytest.approx(r.far, abs=1e-6)
        point = lambda x, y: [[(x, y), (x, y), (x, y)]]
        assert segments_gap(point(r.px, r.py), rings[a]) < 1e-3 and segments_gap(point(r.qx, r.qy), rings[c]) < 1e-3
    assert got[1, 5].far == 0 and got[1, 2].far > 1_000


def test_facing_leaves_out_what_cannot_be_nearest(spark):
    """Two long rows of boxes, far apart: only those around the facing ends are compared."""
    rows = [(1, c, k, x + k * 20_000, 0, x + k * 20_000 + 9_000, 9_000) for c, x in ((1, 0), (2, 50_000_000)) for k in range(1_000)]
    items = spark.createDataFrame(rows, "scenario_id bigint, cluster bigint, building_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    met = N.facing(spark.createDataFrame([(1, 1, 2)], "scenario_id bigint, a bigint, c bigint"), items)
    got = met.select("a_building_id", "b_building_id").collect()
    assert (999, 0) in {tuple(r) for r in got} and len(got) < 200


def lattice_area(one, two, keep, xs, ys):
    """Area of the squares between whole coordinates, whose middles a predicate keeps."""
    at = np.array([(x + 0.5, y + 0.5) for x in xs for y in ys])
    held = lambda rings: K.inside_and_distance(at, [np.array(r, float) for r in rings])[0]
    return int(keep(held(one), held(two)).sum())


def test_overlay_of_stepped_rings_with_holes(spark):
    """Rings along a lattice, whose sides run along one another in both directions: exact areas."""
    r = random.Random(4)
    ones, twos, want = [], [], {}
    for cluster in range(12):
        sets = []
        for _ in range(2):
            cells = {(x, y) for x in range(8) for y in range(8) if r.random() < 0.6}
            sets.append(cells)
        want[cluster] = (len(sets[0] & sets[1]), len(sets[0] - sets[1]), len(sets[1] - sets[0]), len(sets[0] | sets[1]))
        for cells, out in zip(sets, (ones, twos), strict=True):
            out += [(1, cluster, 100 * len(out) + k, 40_000 * x, 40_000 * y, 40_000 * (x + 1), 40_000 * (y + 1)) for k, (x, y) in enumerate(sorted(cells))]
    member = "scenario_id bigint, cluster bigint, building_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint"
    ring = [Tables(spark, "test").cut(L.sides(L.rings(L.open_parts(spark.createDataFrame(x, member), NOTHING), Tables(spark, "test")))) for x in (ones, twos)]
    got = {r.cluster: tuple(round(v / 1.6e9, 6) for v in (r.both, r.one_alone, r.two_alone, r.either)) for r in V.areas(*ring).collect()}
    assert got == want


def test_overlay_of_general_rings(spark):
    """Star-shaped rings: a + b = union + both, both by points, symmetric, and with a set that is empty."""
    ones = [(c, blob(c, 0, 0, 60_000, 14)) for c in range(6)] + [(7, blob(70, 0, 0, 9_000))]
    twos = [(c, blob(100 + c, 20_000, -10_000, 50_000, 11)) for c in range(6)] + [(8, blob(71, 0, 0, 9_000))]
    twos += [(c, [(60_000, 60_000), (61_000, 60_000), (60_500, 61_000)]) for c in range(6)]
    a, b = sides(spark, ones), sides(spark, twos)
    got = {r.cluster: r for r in V.areas(a, b).collect()}
    back = {r.cluster: r for r in V.areas(b, a).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 7, 8}
    at = np.random.default_rng(0).uniform(-70_000, 75_000, (40_000, 2))
    for c, r in got.items():
        mine = [sum(K.area(np.array(ring, float)) for k, ring in some if k == c) for some in (ones, twos)]
        assert (r.area_one, r.area_two) == pytest.approx(mine, rel=1e-9) and r.either + r.both == pytest.approx(sum(mine), rel=1e-9)
        assert r.one_alone == pytest.approx(mine[0] - r.both, abs=1) and back[c].both == pytest.approx(r.both, rel=1e-9, abs=1)
        if c < 6:
            held = [K.inside_and_distance(at, [np.array(ring, float) for k, ring in some if k == c])[0] for some in (ones, twos)]
            assert r.both == pytest.approx((held[0] & held[1]).mean() * 145_000**2, rel=0.05)
    assert got[7].both == got[8].both == 0 and V.areas(a.where("false"), b.where("false")).count() == 0


# layouts


def test_ranges_cover_an_area(spark):
    def interleave(x, y):
        return sum(((x >> k) & 1) << 2 * k | ((y >> k) & 1) << (2 * k + 1) for k in range(6))

    r = random.Random(1)
    for _ in range(60):
        x0, y0 = r.randrange(-5, 64), r.randrange(-5, 64)
        x1, y1 = x0 + r.randrange(0, 30), y0 + r.randrange(0, 30)
        for most in (1, 8, 1_000):
            ranges = scan.code_ranges(x0, y0, x1, y1, most, 6)
            codes = {interleave(x, y) for x in range(64) for y in range(64) if x0 <= x <= x1 and y0 <= y <= y1}
            held = {c for lo, hi in ranges for c in range(lo, hi + 1)}
            assert codes <= held and (most < 1_000 or codes == held)
    assert scan.code_ranges(-9, -9, -1, -1) == []


def test_a_layout_is_read_in_parts(spark, tmp_path):
    r = random.Random(2)
    rows = [(s, k, x, y, x + r.randrange(1, 90_000), y + 9_000) for k in range(20_000) for s, x, y in [(k % 3, r.randrange(-6_000_000, 6_000_000), r.randrange(-6_000_000, 6_000_000))]]
    df = spark.createDataFrame(rows, "scenario_id bigint, building_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    path = f"file://{tmp_path}/layout"
    spark.conf.set("parquet.block.size", "1")
    scan.write_layout(df.repartition(16), path)
    area = [(0, -500_000, -500_000, 900_000, 400_000), (2, 3_000_000, 3_000_000, 3_400_000, 3_300_000)]
    extents = spark.createDataFrame(area, "scenario_id bigint, minx bigint, miny bigint, maxx bigint, maxy bigint")
    got = scan.scan_layout(spark, path, extents)
    key = lambda rows: sorted(map(tuple, rows))
    assert got.columns == df.columns and key(got.collect()) == key(scan.scan(df, extents).collect()) != []
    assert "Or(" in got._jdf.queryExecution().executedPlan().toString() and "code" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:600]
    # what the files' statistics let a reader skip
    ends = spark.read.parquet(f"{path}/_layout").first()
    place = lambda v, lo, hi: int((v - lo) / (hi - lo) * 65535 // 1)
    ranges = [g for _, x0, y0, x1, y1 in area for g in scan.code_ranges(place(2 * x0 - ends.width, ends.minx, ends.maxx), place(2 * y0 - ends.height, ends.miny, ends.maxy), place(2 * x1 + ends.width, ends.minx, ends.maxx), place(2 * y1 + ends.height, ends.miny, ends.maxy))]
    groups = [f.row_group(k) for p in (tmp_path / "layout").glob("*.parquet") for f in [pq.ParquetFile(p).metadata] for k in range(f.num_row_groups)]
    stats = [next(g.column(k).statistics for k in range(g.num_columns) if g.column(k).path_in_schema == "code") for g in groups]
    read = sum(g.num_rows for g, s in zip(groups, stats, strict=True) if any(lo <= s.max and s.min <= hi for lo, hi in ranges))
    assert read < 0.4 * len(rows)
    assert scan.scan_layout(spark, path, extents.where("false")).count() == 0
    scan.write_layout(df.where("false"), f"{path}2")
    assert scan.scan_layout(spark, f"{path}2", extents).count() == 0


def test_many_areas_share_one_box(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "MOST_AREAS", 2)
    rows = [(1, k, k * 1_000, 0, k * 1_000 + 500, 500) for k in range(500)]
    df = spark.createDataFrame(rows, "scenario_id bigint, building_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    extents = spark.createDataFrame([(s, s * 10_000, 0, s * 10_000 + 5_000, 10) for s in (1, 2, 3, 4)], "scenario_id bigint, minx bigint, miny bigint, maxx bigint, maxy bigint")
    scan.write_layout(df, f"file://{tmp_path}/l")
    assert {r.building_id for r in scan.scan_layout(spark, f"file://{tmp_path}/l", extents).collect()} == {r.building_id for r in scan.scan(df, extents).collect()} != set()
