from math import cos, pi, sin

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubitgrid.functions import bays as Y
from cubitgrid.functions import kernels as K


def box(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], "float64")


def grid_area(boxes):
    xs, ys = (sorted({v for b in boxes for v in (b[k], b[k + 2])}) for k in (0, 1))
    return sum((x1 - x0) * (y1 - y0) for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:]) if any(b[0] <= x0 and b[2] >= x1 and b[1] <= y0 and b[3] >= y1 for b in boxes))


def test_hull_drops_collinear_points():
    h = K.hull(np.array([[0, 0], [2, 0], [1, 0], [2, 2], [0, 2], [1, 1], [0, 0]]))
    assert h.tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]] and K.area(h) == 4


@pytest.mark.parametrize(("second", "area"), [((0, 0, 10, 10), 100), ((10, 0, 20, 10), 200), ((5, 0, 15, 10), 150), ((20, 20, 30, 30), 200), ((2, 2, 8, 8), 100)])
def test_union_with_coincident_edges(second, area):
    assert K.union_area([box(0, 0, 10, 10), box(*second)]) == pytest.approx(area)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 40)] * 2, *[st.integers(5, 30)] * 2), min_size=1, max_size=7))
def test_union_of_boxes(given_boxes):
    """Outer outlines hold at least the union and are equal to it where no hole is enclosed."""
    boxes = [(x, y, x + w, y + h) for x, y, w, h in given_boxes]
    got, want = K.union_area([box(*b) for b in boxes]), grid_area(boxes)
    around = (max(b[2] for b in boxes) - min(b[0] for b in boxes)) * (max(b[3] for b in boxes) - min(b[1] for b in boxes))
    assert want - 1e-6 <= got <= around + 1e-6
    if len(boxes) < 4:  # fewer boxes can't enclose a hole
        assert got == pytest.approx(want)


def test_union_fills_holes():
    frame = [box(0, 0, 10, 2), box(0, 8, 10, 10), box(0, 0, 2, 10), box(8, 0, 10, 10)]
    assert K.union_area(frame) == pytest.approx(100)


def test_grown_square():
    g = K.grown(box(0, 0, 10, 10), 1.0)
    assert len(g) == 12 or len(g) == 8
    assert g[:, 0].max() == pytest.approx(10 + 1 / cos(pi / 8))


def test_minimal_rectangle_turns_with_its_points():
    for a in (0.0, 0.3, 1.2):
        p = Y.turn(box(0, 0, 30, 10), a)
        angle, w, h, area = K.min_area_rectangle(K.hull(p))
        assert area == pytest.approx(300) and sorted((w, h)) == pytest.approx([10, 30])
        assert sin(2 * (angle - a)) == pytest.approx(0, abs=1e-9)


def test_sum_with_rectangle_of_a_square():
    pieces = K.plus_rectangle(box(0, 0, 10, 10), 5, 5, 2, 2)
    assert K.union_area([*pieces, box(0, 0, 10, 10)]) == pytest.approx(20 * 14)


def test_simplify():
    ring = np.array([[0, 0], [5, 0.001], [10, 0], [10, 10], [0, 10]])
    assert len(K.simplify(ring)) == 4 and len(K.simplify(ring * 100)) == 5


U = np.array([[0, 0], [100, 0], [100, 90], [80, 90], [80, 30], [20, 30], [20, 90], [0, 90]], "float64") * 1000


def test_bay_of_a_u():
    found = [b for b in Y.bays([U], 0, 0, 100_000, 90_000) if b.area > 1]
    assert len(found) == 1 and found[0].area == pytest.approx(60_000 * 60_000) and found[0].runs == 1
    k = Y.keshet(found[0], [U], 50_000, 50_000, 10_000)
    assert k["mouth"] == pytest.approx(60_000) and k["depth"] == pytest.approx(60_000) and k["area"] == pytest.approx(found[0].area)


@pytest.mark.parametrize(("mouth", "depth", "condition", "is_bow"), [(60_000, 59_999, "mouthAndDepth", True), (60_001, 0, "mouthAndDepth", False), (50_000, 60_000, "mouthAndDepth", False), (50_000, 60_000, "mouthOnly", True)])
def test_bow_thresholds(mouth, depth, condition, is_bow):
    """The mouth may equal its limit, the depth has to exceed it."""
    bay = next(b for b in Y.bays([U], 0, 0, 100_000, 90_000) if b.area > 1)
    assert (Y.keshet(bay, [U], mouth, depth, 10_000, condition) is not None) == is_bow


def test_cut_past_the_wide_part():
    v = np.array([[0, 0], [100, 0], [100, 100], [90, 100], [50, 20], [10, 100], [0, 100]], "float64") * 1000
    bay = next(b for b in Y.bays([v], 0, 0, 100_000, 100_000) if b.runs == 1 and b.area > 1e9)
    k = Y.keshet(bay, [v], 50_000, 50_000, 40_000, exclusion="past4000")
    assert k["depth"] == pytest.approx(80_000) and 38_000 < k["cut_depth"] <= 40_000 and k["area"] < bay.area
    assert Y.keshet(bay, [v], 50_000, 50_000, 90_000, exclusion="past4000") is None


def test_bay_with_two_mouths_is_no_bow():
    wall = [box(0, 40_000, 100_000, 60_000)]
    assert all(b.runs == 1 for b in Y.bays(wall, 0, 0, 100_000, 100_000) if b.area > 1)
    street = [box(0, 0, 40_000, 100_000), box(60_000, 0, 100_000, 100_000)]
    street_bay = [b for b in Y.bays(street, 0, 0, 100_000, 100_000) if b.area > 1]
    assert len(street_bay) == 1 and street_bay[0].runs == 2 and Y.keshet(street_bay[0], street, 0, 0, 0) is None


def test_nearly_square_and_straight_side():
    notched = np.array([[0, 0], [200, 0], [200, 100], [101, 100], [100, 98], [99, 100], [0, 100]], "float64") * 1000
    assert Y.nearly_square([notched], 0.0) is True and Y.nearly_square([U], 0.0) is False
    assert Y.nearly_square([box(0, 0, 200_000, 5_000)], 0.0) is None
    triangle = np.array([[0, 0], [300, 0], [150, 200]], "float64") * 1000
    assert Y.straight_side(Y.turn(triangle, 0.2)) == pytest.approx(0.2, abs=1e-6)


def test_hulls_against_each_other():
    """Distances, overlap and slices of random hulls against dense points on their sides."""
    rng = np.random.default_rng(3)
    dense = lambda h: np.concatenate([h + t * (np.roll(h, -1, 0) - h) for t in np.linspace(0, 1, 400)])
    for _ in range(40):
        a = K.hull(rng.uniform(0, 10, (12, 2)))
        c = K.hull(rng.uniform(0, 10, (9, 2)) + rng.uniform(-14, 14, 2))
        pa, pc = dense(a), dense(c)
        least = np.sqrt(((pa[:, None] - pc) ** 2).sum(-1)).min()
        p, q = K.hull_line(a, c)
        inside = any(K._inside(pc, a, 0.0)) or any(K._inside(pa, c, 0.0))
        assert inside == K.hulls_overlap(a, c)
        if inside:
            assert K.corridor(a, c) is None and K.hulls_within(a, c, 0.0)
            continue
        assert abs(np.hypot(*(q - p)) - least) < 0.05
        assert K.hulls_within(a, c, least + 0.05) and not K.hulls_within(a, c, least - 0.05)
        u, start, end = K.corridor(a, c)
        v = np.array([-u[1], u[0]])
        lo, hi = max((pa @ v).min(), (pc @ v).min()), min((pa @ v).max(), (pc @ v).max())

        def met(h, at):  # side by side
            out = []
            for p, q in zip(h.tolist(), np.roll(h, -1, 0).tolist(), strict=True):
                s, t = np.dot(p, v) - at, np.dot(q, v) - at
                if s * t <= 0 and s != t:
                    out.append(np.dot(p, u) + s / (s - t) * (np.dot(q, u) - np.dot(p, u)))
            return out

        at = np.linspace(lo, hi, 60)[1:-1]
        assert start <= min(max(met(a, x)) for x in at) + 1e-9 and end >= max(min(met(c, x)) for x in at) - 1e-9
        near = lo + (hi - lo) * 1e-7, hi - (hi - lo) * 1e-7
        assert abs(start - min(max(met(a, x)) for x in near)) < 1e-3 and abs(end - max(min(met(c, x)) for x in near)) < 1e-3


def test_corridor_reaches_into_recesses():
    """b stands beyond the ends of the shortest line, where the facing sides draw back."""
    a = np.array([[0.0, 0], [10, 50], [0, 100]])
    c = np.array([[30.0, 0], [30, 100], [20, 50]])[[0, 1, 2]]
    u, start, end = K.corridor(a, K.hull(c))
    assert np.allclose(u, [1, 0]) and (start, end) == (0.0, 30.0)
    assert K.slice_range(a, u, np.array([0.0, 1.0]), 50.0) == (0.0, 10.0)
    assert K.hulls_overlap(a, a + [10, 0]) and not K.hulls_overlap(a, a + [10.1, 0])


def test_bays_of_many_holes():
    """A wall with 900 yards, turned a little: each yard is a bay by itself, and the time does not grow with their square."""
    import time

    yard = box(0, 0, 10_000, 10_000)[::-1]
    wall = [Y.turn(r, 0.01) for r in (box(-20_000, -20_000, 920_000, 920_000), *(yard + [30_000 * i, 30_000 * j] for i in range(30) for j in range(30)))]
    began = time.process_time()
    found = Y.bays(wall, -50_000, -50_000, 950_000, 950_000)
    took = time.process_time() - began
    yards = [b for b in found if b.runs == 0]
    assert len(yards) == 900 and all(b.area == pytest.approx(1e8) and b.holes == 0 and b.mouth is None for b in yards)
    outside = [b for b in found if b.runs]
    assert sum(b.area for b in outside) == pytest.approx(1e6**2 - 940_000.0**2)
    assert took < 6, took


def test_width_of_a_bay_at_a_depth():
    """A bay of many trapezoids: a triangle 100 m deep under a straight mouth, cut at every metre."""
    x = np.arange(0, 200_001, 1_000.0)
    ring = np.array([*zip(x, 100_000 - np.abs(x - 100_000) * 0.9, strict=True), (200_000, 150_000), (0, 150_000)])
    bay = max(Y.bays([ring], 0, 0, 200_000, 150_000), key=lambda b: b.area)
    width = Y.width_at(bay, np.array([0.0, 0.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0]))
    for d in (20_000.0, 55_500.0, 99_000.0):
        left = (100_000 - (100_000 - d) / 0.9) if d > 10_000 else 0
        assert width(d) in (pytest.approx(left), pytest.approx(200_000 - 2 * left), pytest.approx(2 * left)), d
    assert width(200_000.0) == 0
