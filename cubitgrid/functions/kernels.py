"""Geometry kernels over arrays: hulls, unions of convex pieces, sums with rectangles."""

from __future__ import annotations

from math import cos, pi, sin

import numpy as np


def cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise and open, without points on its sides; by sorted sweeps."""
    p = np.unique(np.asarray(points, "float64").reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p
    if len(p) > 64:  # most of many lie inside
        p = p[outermost(p, np.zeros(len(p), "int64"))]

    def sweep(order) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(sweep(p) + sweep(p[::-1]))


def outermost(points: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which points can be corners of their group's hull; groups are numbers, equal ones beside each other.

    A point to the left of all sides between the group's farthest points in 16 directions lies inside these points' hull.
    """
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    number = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(group)]))
    far = []
    for turn in np.arange(16) * pi / 8:
        reach = points[:, 0] * np.cos(turn) + points[:, 1] * np.sin(turn)
        hit = np.flatnonzero(reach == np.maximum.reduceat(reach, start)[number])
        far.append(points[hit[np.searchsorted(number[hit], np.arange(len(start)))]])
    slack = 1e-14 * float(np.abs(points).max()) ** 2
    inside, sides = np.ones(len(points), bool), np.zeros(len(start), "int64")
    for p, q in zip(far, far[1:] + far[:1], strict=True):
        side = (p != q).any(1)
        sides += side
        inside &= (cross(p[number], q[number], points) > slack) | ~side[number]
    return ~inside | (sides < 3)[number]


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def grown(convex: np.ndarray, r: float) -> np.ndarray:
    """Hull of the points grown by the octagon around radius r."""
    turn = np.arange(8) * pi / 4
    corners = np.stack([np.cos(turn), np.sin(turn)], 1) * r / np.cos(pi / 8)
    return hull((np.asarray(convex)[:, None] + corners[None]).reshape(-1, 2))


def rounded(convex: np.ndarray, r: float, sides: int = 32) -> np.ndarray:
    """Hull of the points grown by a regular polygon around radius r, which a circle of that radius lies in."""
    turn = np.arange(sides) * 2 * pi / sides
    corners = np.stack([np.cos(turn), np.sin(turn)], 1) * r / np.cos(pi / sides)
    return hull((np.asarray(convex)[:, None] + corners[None]).reshape(-1, 2))


def plus_rectangle(ring: np.ndarray, west: float, east: float, south: float, north: float) -> list[np.ndarray]:
    """Convex pieces whose union is the ring's outline moved over [-west, east] x [-south, north]: one for each edge."""
    box = np.array([[-west, -south], [east, -south], [east, north], [-west, north]])
    return [hull((e[:, None] + box[None]).reshape(-1, 2)) for e in np.stack([ring, np.roll(ring, -1, 0)], 1)]


def min_area_rectangle(convex: np.ndarray) -> tuple[float, float, float, float]:
    """(angle, width, height, area) of the smallest rectangle with a side along a hull edge; the first one wins."""
    h = np.asarray(convex, "float64")
    if len(h) < 3:
        size = np.ptp(h, axis=0)
        return 0.0, float(size[0]), float(size[1]), float(size[0] * size[1])
    best = None
    for edge in np.roll(h, -1, 0) - h:
        a = np.arctan2(edge[1], edge[0])
        turned = h @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        w, t = np.ptp(turned, axis=0)
        if best is None or w * t < best[3]:
            best = float(a), float(w), float(t), float(w * t)
    return best


def snapped(piece: np.ndarray, snap: float) -> np.ndarray:
    """A convex piece on a grid; fewer than three points if it has no area there."""
    return hull(np.floor(piece / snap + 0.5) * snap)


def open_sides(piece: np.ndarray, others: list[np.ndarray], snap: float) -> list[tuple[int, int, int, int]]:
    """The parts of a snapped piece's sides whose middle is strictly inside none of the others, in steps of the grid."""
    out = []
    corners = np.concatenate(others) if others else np.zeros((0, 2))
    following = np.concatenate([np.roll(q, -1, 0) for q in others]) if others else corners
    for a, b in zip(piece, np.roll(piece, -1, 0), strict=True):
        cuts = [0.0, 1.0, *(_cuts(a, b, corners, following) if others else [])]
        t = np.unique(np.clip(cuts, 0, 1))
        ends = a + t[:, None] * (b - a)
        start, end = ends[:-1], ends[1:]
        long = np.hypot(*(end - start).T) >= snap / 2
        middle = (start + end) / 2
        covered = np.zeros(len(middle), bool)
        for q in others:
            if covered.all():
                break
            covered |= _inside(middle, q, snap / 10)
        free = long & ~covered
        out += [tuple(x) for x in np.c_[np.round(start[free] / snap), np.round(end[free] / snap)].astype("int64").tolist()]
    return out


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of, at) for counts of items: which owner each item has, and its number among the owner's."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def following(points: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The next corner of each corner of rings that stand one after another."""
    of, at = spread(counts)
    start = np.cumsum(counts) - counts
    return points[start[of] + (at + 1) % counts[of]]


def open_parts(own: np.ndarray, own_n: np.ndarray, near: np.ndarray, near_n: np.ndarray, neighbours: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of, ends): the parts of rings' sides that no neighbour covers, all rings of a batch at once.

    own, near: corners of convex rings in whole numbers, one ring after another, own_n and near_n their corners, neighbours
    how many rings of `near` each own ring has. A side along a neighbour's own is covered if that runs the other way or
    the neighbour goes `first`. A side and a neighbour's half planes give one covered interval; its ends are kept as
    fractions num / den of the side, and rounded to whole numbers from these.
    """
    side, ends = open_of_sides(own, own_n, near, near_n, neighbours, first)
    return spread(own_n)[0][side], ends


def open_of_sides(own: np.ndarray, own_n: np.ndarray, near: np.ndarray, near_n: np.ndarray, neighbours: np.ndarray, first: np.ndarray, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(side, ends): what open_parts returns, with the side's number in place of its ring's; of the sides `asked` alone, if given."""
    of_side, _ = spread(own_n)
    d = following(own, own_n) - own
    e = following(near, near_n) - near if len(near) else near
    ring_start, edge_start = np.cumsum(neighbours) - neighbours, np.cumsum(near_n) - near_n
    pair_side, at = spread(neighbours[of_side] if asked is None else np.where(asked, neighbours[of_side], 0))
    pair_ring = ring_start[of_side[pair_side]] + at
    if len(pair_side):  # only neighbours whose box a side's box meets can cover it
        lo, hi = np.minimum(own, own + d), np.maximum(own, own + d)
        ring_lo, ring_hi = np.minimum.reduceat(near, edge_start), np.maximum.reduceat(near, edge_start)
        meet = ((lo[pair_side] <= ring_hi[pair_ring]) & (hi[pair_side] >= ring_lo[pair_ring])).all(1)
        pair_side, pair_ring = pair_side[meet], pair_ring[meet]
    side, lo_t, hi_t, lo_f, hi_f = _covered(own, d, near, e, pair_side, pair_ring, near_n, edge_start, first)
    # one interval of no length at either end of each side, then sort and look for what lies between
    each = np.arange(len(own)) if asked is None else np.flatnonzero(asked)
    n = len(each)
    one = np.ones(n, "int64")
    side = np.r_[each, side, each]
    lo_t, hi_t = np.r_[np.zeros(n), lo_t, np.ones(n)], np.r_[np.zeros(n), hi_t, np.ones(n)]
    lo_f = np.concatenate([np.c_[0 * one, one], lo_f, np.c_[one, one]])
    hi_f = np.concatenate([np.c_[0 * one, one], hi_f, np.c_[one, one]])
    order = np.lexsort((hi_t, lo_t, side))
    side, lo_t, hi_t, lo_f, hi_f = (x[order] for x in (side, lo_t, hi_t, lo_f, hi_f))
    reach = np.maximum.accumulate(hi_t + 2.0 * side)  # a side's values lie above those of the sides before it
    who = np.maximum.accumulate(np.where(hi_t + 2.0 * side >= reach, np.arange(len(side)), 0))
    free = np.flatnonzero((side[1:] == side[:-1]) & (lo_t[1:] + 2.0 * side[1:] > reach[:-1]))
    s = side[free]
    start, end = _at(own[s], d[s], hi_f[who[free]]), _at(own[s], d[s], lo_f[free + 1])
    long = (start != end).any(1)
    return s[long], np.c_[start, end][long]


def inner_square(ring: np.ndarray) -> int:
    """Half the width of the largest square around the origin that lies in a convex ring, counter-clockwise, down to a whole number."""
    if len(ring) < 3:
        return 0
    q = np.roll(ring, -1, 0)
    nx, ny = q[:, 1] - ring[:, 1], ring[:, 0] - q[:, 0]
    return max(0, int(np.floor(((nx * ring[:, 0] + ny * ring[:, 1]) / (abs(nx) + abs(ny))).min())))


def buried(boxes: np.ndarray, own: np.ndarray, inner: int, outer: int, cell: int) -> np.ndarray:
    """Which of the boxes `own` (numbers) have no open part of a side once all are grown.

    boxes: different ones (x0, y0, x1, y1) in whole numbers. A grown ring holds its box grown by `inner` and lies in its box
    grown by `outer`. A cell inside a ring meets none of that ring's sides, so where every cell that a ring may meet is
    inside some ring, others hold all of its sides.
    """
    return ~meets_bare(boxes, boxes[own, :2] - outer, boxes[own, 2:] + outer, inner, cell)


def meets_bare(boxes: np.ndarray, lo: np.ndarray, hi: np.ndarray, inner: int, cell: int) -> np.ndarray:
    """Which of the rectangles from lo to hi meet a cell that lies inside none of the boxes grown by `inner`."""
    base = lo.min(0) // cell
    size = hi.max(0) // cell - base + 1
    # cells that lie inside with their borders
    a = np.clip(-(-(boxes[:, :2] - inner + 1) // cell) - base, 0, size)
    b = np.clip((boxes[:, 2:] + inner - 1) // cell - base, 0, size)
    a, b = (x[(a < b).all(1)] for x in (a, b))
    change = np.zeros(size + 1, "int64")
    for x, y, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
        np.add.at(change, (x[:, 0], y[:, 1]), sign)
    bare = np.zeros(size + 1, "int64")
    bare[1:, 1:] = (change.cumsum(0).cumsum(1)[:-1, :-1] == 0).cumsum(0).cumsum(1)
    c, d = lo // cell - base, hi // cell - base + 1
    return bare[d[:, 0], d[:, 1]] - bare[c[:, 0], d[:, 1]] - bare[d[:, 0], c[:, 1]] + bare[c[:, 0], c[:, 1]] > 0


def _covered(own, d, near, e, pair_side, pair_ring, near_n, edge_start, first) -> tuple[np.ndarray, ...]:
    """(side, lo_t, hi_t, lo, hi): where each side runs inside each ring that it is paired with, ends as (num, den)."""
    of, at = spread(near_n[pair_ring])
    edge, s = edge_start[pair_ring[of]] + at, pair_side[of]
    w = own[s] - near[edge] if len(near) else np.zeros((0, 2), "int64")
    ex, ey = (e[edge, k] for k in (0, 1))
    c0, c1 = ex * w[:, 1] - ey * w[:, 0], ex * d[s, 1] - ey * d[s, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -c0 / c1
    along = (c1 == 0) & (c0 == 0)
    same_way = ex * d[s, 0] + ey * d[s, 1] > 0
    out = (c1 == 0) & (c0 < 0) | along & same_way & ~first[pair_ring[of]]
    low, high = np.where(c1 > 0, t, 0.0), np.where(c1 < 0, t, 1.0)
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, "int64")
    if not len(cut):
        none = np.zeros((0, 2), "int64")
        return np.zeros(0, "int64"), np.zeros(0), np.zeros(0), none, none
    lo_t, hi_t = np.maximum(np.maximum.reduceat(low, cut), 0.0), np.minimum(np.minimum.reduceat(high, cut), 1.0)
    good = ~np.logical_or.reduceat(out, cut) & (lo_t < hi_t)
    fraction = np.c_[-c0 * np.sign(c1), np.abs(c1)]

    def ends(each: np.ndarray, best: np.ndarray, edge_of: np.ndarray, plain: int) -> np.ndarray:
        """The fraction of an edge that gives the bound; 0 or 1 where none does."""
        got = np.tile(np.array([plain, 1]), (len(cut), 1))
        hit = np.flatnonzero((each == best[of]) & edge_of)
        got[of[hit[::-1]]] = fraction[hit[::-1]]
        return got

    lo_f, hi_f = ends(low, lo_t, (c1 > 0) & (low > 0), 0), ends(high, hi_t, (c1 < 0) & (high < 1), 1)
    return pair_side[good], lo_t[good], hi_t[good], lo_f[good], hi_f[good]


def _at(start: np.ndarray, d: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    """start + d * num / den, rounded half up from the exact value."""
    num, den = fraction[:, :1], fraction[:, 1:]
    return start + (2 * d * num + den) // (2 * den)


def joined(sides: list[tuple[int, int, int, int]], snap: float) -> list[np.ndarray]:
    """Outer rings (open, counter-clockwise) of directed sides. Of sides that coincide in the same direction one stays,
    in opposite directions none; rings that run clockwise are holes and left out."""
    found = dict.fromkeys(sides)
    return [r for r in _rings([k for k in found if (k[2], k[3], k[0], k[1]) not in found], snap) if area(r) > 0]


def union_outline(pieces: list[np.ndarray], snap: float = 1e-3) -> list[np.ndarray]:
    """Outer rings of a union of convex pieces, holes filled: what is open of each piece's sides, joined to rings.

    Pieces that may meet a piece are looked for among those that begin at most the widest piece's width before it.
    """
    pieces = [h for p in pieces if len(h := snapped(p, snap)) > 2]
    if not pieces:
        return []
    boxes = np.array([[*p.min(0), *p.max(0)] for p in pieces])
    order = np.argsort(boxes[:, 0], kind="stable")
    begin, widest = boxes[order, 0], (boxes[:, 2] - boxes[:, 0]).max()
    sides: list[tuple] = []
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        near = order[np.searchsorted(begin, x0 - widest) : np.searchsorted(begin, x1, side="right")]
        b = boxes[near]
        near = near[(b[:, 2] >= x0) & (b[:, 1] <= y1) & (b[:, 3] >= y0) & (near != i)]
        sides += open_sides(pieces[i], [pieces[j] for j in near], snap)
    return joined(sides, snap)


def _cuts(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[float]:
    """Where along ab it meets the segments pq."""
    d, e = b - a, q - p
    den = d[0] * e[:, 1] - d[1] * e[:, 0]
    w = p - a
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den
        u = (w[:, 0] * d[1] - w[:, 1] * d[0]) / den
    hit = (np.abs(den) > 1e-12) & (t > 0) & (t < 1) & (u >= -1e-9) & (u <= 1 + 1e-9)
    out = t[hit].tolist()
    length = float(d @ d)
    along = np.concatenate([p, q])
    off = np.abs((along[:, 0] - a[0]) * d[1] - (along[:, 1] - a[1]) * d[0]) / np.sqrt(length)
    return out + (((along - a) @ d) / length)[off < 1e-6].tolist()


def _inside(points: np.ndarray, convex: np.ndarray, margin: float) -> np.ndarray:
    """Which points lie strictly inside."""
    nxt = np.roll(convex, -1, 0)
    size = np.hypot(*(nxt - convex).T)
    return (cross(convex[None], nxt[None], points[:, None]) / size > margin).all(1)


def _rings(fragments: list[tuple], snap: float) -> list[np.ndarray]:
    """Join directed fragments; at a point where several go on, the sharpest right turn keeps outer rings apart."""
    out: dict[tuple, list[tuple]] = {}
    for k in fragments:
        out.setdefault(k[:2], []).append(k[2:])
    rings = []
    while out:
        start = next(iter(out))
        ring, at, before = [start], start, None
        while True:
            choice = out[at]
            if len(choice) > 1 and before is not None:
                back = np.arctan2(before[1] - at[1], before[0] - at[0])
                choice.sort(key=lambda c: (np.arctan2(c[1] - at[1], c[0] - at[0]) - back) % (2 * pi))
            to = choice.pop(-1 if before is None or len(choice) == 1 else 0)
            if not choice:
                del out[at]
            before, at = at, to
            if at == start or at not in out:
                break
            ring.append(at)
        if len(ring) > 2 and at == start:
            rings.append(np.array(ring, "float64") * snap)
    return rings


def union_area(pieces: list[np.ndarray]) -> float:
    return sum(area(r) for r in union_outline(pieces))


def boxes_area(boxes: np.ndarray, most: int = 4_000_000) -> int:
    """Area of the union of boxes (x0, y0, x1, y1) in whole numbers: strips between all x, in parts of `most` fields."""
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    x, y = np.searchsorted(xs, boxes[:, [0, 2]]), np.searchsorted(ys, boxes[:, [1, 3]])
    wide, high, total = np.diff(xs), np.diff(ys), 0
    rows = max(1, most // len(ys))
    for s in range(0, len(wide), rows):
        e = min(s + rows, len(wide))
        met = (x[:, 0] < e) & (x[:, 1] > s)
        a, b, c, d = np.maximum(x[met, 0] - s, 0), np.minimum(x[met, 1], e) - s, y[met, 0], y[met, 1]
        change = np.zeros((e - s + 1, len(ys)), "int32")
        for i, j, sign in ((a, c, 1), (b, d, 1), (a, d, -1), (b, c, -1)):
            np.add.at(change, (i, j), sign)
        covered = change.cumsum(0).cumsum(1)[:-1, :-1] > 0
        total += int((wide[s:e] * (covered @ high)).sum())
    return total


def simplify(ring: np.ndarray, tolerance: float = 0.02) -> np.ndarray:
    """Drop points that lie within the tolerance of the line between their kept neighbours, until none does."""
    pts = list(ring)
    changed = True
    while changed and len(pts) > 3:
        changed, i = False, 0
        while i < len(pts) and len(pts) > 3:
            a, m, b = pts[i - 1], pts[i], pts[(i + 1) % len(pts)]
            size = np.hypot(*(b - a))
            off = abs(cross(a, b, m)) / size if size > 0 else np.hypot(*(m - a))
            if off < tolerance:
                pts.pop(i)
                changed = True
            else:
                i += 1
    return np.array(pts)


def inside_and_distance(points: np.ndarray, rings: list[np.ndarray], rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of each point, whether it is inside the rings (even-odd) and how far it is from their sides."""
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, 0) for r in rings])
    d, size = b - a, ((b - a) ** 2).sum(1)
    inside, far = np.zeros(len(points), bool), np.zeros(len(points))
    for at in range(0, len(points), rows):
        p = points[at : at + rows, None]
        up = (a[:, 1] > p[..., 1]) != (b[:, 1] > p[..., 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (p[..., 1] - a[:, 1]) * d[:, 0] / d[:, 1]
            t = np.clip(np.nan_to_num(((p - a) * d).sum(-1) / size), 0, 1)
        inside[at : at + rows] = (up & (p[..., 0] < x)).sum(1) % 2 == 1
        far[at : at + rows] = np.sqrt(((p - a - t[..., None] * d) ** 2).sum(-1)).min(1)
    return inside, far


def box_sum(convex: np.ndarray, west: float, east: float, south: float, north: float) -> np.ndarray:
    """A convex ring moved over [-west, east] x [-south, north]."""
    box = np.array([[-west, -south], [east, -south], [east, north], [-west, north]])
    return hull((np.asarray(convex)[:, None] + box[None]).reshape(-1, 2))


# convex hulls against each other (open rings, counter-clockwise)


def hulls_overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two hulls have a point in common: no side's normal separates them; touching is overlap."""
    for one, two in ((a, b), (b, a)):
        side = np.roll(one, -1, 0) - one
        normal = np.stack([side[:, 1], -side[:, 0]], 1)
        if ((one @ normal.T).max(0) < (two @ normal.T).min(0)).any():
            return False
    return True


def hull_line(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends on a and on b of the shortest line between the sides of two hulls: one of them is a corner."""
    def from_corners(p: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = np.roll(q, -1, 0) - q
        size = (d**2).sum(1)
        t = np.clip(((p[:, None] - q) * d).sum(-1) / np.where(size > 0, size, 1), 0, 1)
        at = q + t[..., None] * d
        far = ((p[:, None] - at) ** 2).sum(-1)
        i, j = np.unravel_index(far.argmin(), far.shape)
        return float(far[i, j]), p[i], at[i, j]

    one, two = from_corners(a, b), from_corners(b, a)
    return (one[1], one[2]) if one[0] <= two[0] else (two[2], two[1])


def hulls_within(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    """Whether two hulls overlap, or their sides come within a distance."""
    if len(a) > 2 and len(b) > 2 and hulls_overlap(a, b):
        return True
    p, q = hull_line(a, b)
    return bool(np.hypot(*(q - p)) <= limit)


def slice_range(h: np.ndarray, u: np.ndarray, v: np.ndarray, at: float) -> tuple[float, float]:
    """Where along u a hull is met by the line v = at; the corner nearest to the line, if it misses by rounding."""
    s, along = h @ v - at, h @ u
    nxt, ahead = np.roll(s, -1), np.roll(along, -1)
    cross = (s < 0) != (nxt < 0)
    met = np.r_[along[s == 0], along[cross] + s[cross] / (s[cross] - nxt[cross]) * (ahead[cross] - along[cross])]
    if not len(met):
        met = along[[np.abs(s).argmin()]]
    return float(met.min()), float(met.max())


def corridor(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(u, start, end): the direction of the shortest line from a to c, and from where to where along it the gap between
    their facing sides reaches, over all of their lateral overlap; None if they have no gap.

    a's facing side bulges towards c and c's towards a, so their ends over the overlap are the farthest.
    """
    if hulls_overlap(a, c):
        return None
    p, q = hull_line(a, c)
    length = np.hypot(*(q - p))
    if length < 1e-9:
        return None
    u = (q - p) / length
    v = np.array([-u[1], u[0]])
    ends = max((a @ v).min(), (c @ v).min()), min((a @ v).max(), (c @ v).max())
    return u, min(slice_range(a, u, v, e)[1] for e in ends), max(slice_range(c, u, v, e)[0] for e in ends)


# links between groups of footprints

COS_OCTAGON, SIN_OCTAGON = cos(pi / 8), sin(pi / 8)


def _near(boxes: np.ndarray, other: np.ndarray, gap: float) -> np.ndarray:
    """Whether boxes touch once each is grown by the octagon around half a gap."""
    dx, dy = (np.maximum(0, np.maximum(other[..., k] - boxes[..., k + 2], boxes[..., k] - other[..., k + 2])) for k in (0, 1))
    return np.maximum(dx * COS_OCTAGON + dy * SIN_OCTAGON, dx * SIN_OCTAGON + dy * COS_OCTAGON) <= gap


def hulls_near(a: np.ndarray, b: np.ndarray, gap: float) -> np.ndarray:
    """The same for convex hulls (pairs, corners, 2); the last corner may be repeated, since a normal of no length separates
    nothing."""
    octagon = np.array([(COS_OCTAGON, SIN_OCTAGON), (SIN_OCTAGON, COS_OCTAGON), (COS_OCTAGON, -SIN_OCTAGON), (SIN_OCTAGON, -COS_OCTAGON)])
    normals = []
    for hull in (a, b):
        turned = np.roll(hull, -1, 1)
        normals.append(np.stack([turned[..., 1] - hull[..., 1], hull[..., 0] - turned[..., 0]], -1))
    n = np.concatenate([*normals, np.broadcast_to(octagon, (len(a), 4, 2))], 1)
    along = [hull[:, None, :, 0] * n[:, :, None, 0] + hull[:, None, :, 1] * n[:, :, None, 1] for hull in (a, b)]
    (lo, hi), (lo2, hi2) = ((v.min(2), v.max(2)) for v in along)
    x, y = np.abs(n[..., 0]), np.abs(n[..., 1])
    reach = np.maximum(np.maximum(x, y), (x + y) * np.sqrt(0.5)) * (gap / COS_OCTAGON)
    return ~(np.maximum(lo2 - hi, lo - hi2) > reach).any(1)


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each one's set) once i and j are joined."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        least = np.minimum(a, b)
        label = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != label[label]).any():
            label = label[label]


def linked_groups(of: np.ndarray, boxes: np.ndarray, gap: float, hulls: np.ndarray | None = None, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), b < a: groups connected with a smaller one over links of their boxes, or of hulls (boxes, corners, 2) in them.

    A pair of groups is tried with the farthest boxes of both first, then with all, unless others connect it already; at
    most about `most` pairs of boxes are held at a time.
    """
    order = np.argsort(of, kind="stable")
    names, start, count = np.unique(of[order], return_index=True, return_counts=True)
    box, k = boxes[order], len(names)
    corners = None
    if hulls is not None:
        corners = hulls[order]
        most = max(1, most // corners.shape[1] ** 2 // 4)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = _near(box[i], box[j], gap)
        if corners is not None:
            where = np.flatnonzero(ok)
            for s in range(0, len(where), most):
                w = where[s : s + most]
                ok[w] = hulls_near(corners[i[w]], corners[j[w]], gap)
        return ok

    around = np.stack([f.reduceat(box[:, c], start) for c, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum))], 1)
    rows = max(1, most // k)
    pairs = []
    for s in range(0, k, rows):
        i, j = np.nonzero(_near(around[s : s + rows, None], around[None], gap))
        pairs.append(np.stack([i + s, j], 1)[i + s < j])
    pairs = np.concatenate(pairs)
    group = np.repeat(np.arange(k), count)
    far = np.stack([np.lexsort((box[:, c], group))[start if c < 2 else start + count - 1] for c in range(4)], 1)
    label = np.arange(k)
    for s in range(0, len(pairs), most // 16 + 1):
        p = pairs[s : s + most // 16 + 1]
        hit = near(np.repeat(far[p[:, 0]], 4, 1).ravel(), np.tile(far[p[:, 1]], (1, 4)).ravel()).reshape(len(p), 16).any(1)
        label = _joined(label, p[hit, 0], p[hit, 1])
    left = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    # a row for each box of the first group, which meets all boxes of the second one
    one, two = np.repeat(left[:, 0], count[left[:, 0]]), np.repeat(left[:, 1], count[left[:, 0]])
    n = count[left[:, 0]]
    row = start[one] + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
    while len(one):
        cut = max(1, int(np.searchsorted(np.cumsum(count[two]), most)))
        m = count[two[:cut]]
        j = np.repeat(start[two[:cut]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        hit = near(np.repeat(row[:cut], m), j)
        label = _joined(label, np.repeat(one[:cut], m)[hit], np.repeat(two[:cut], m)[hit])
        one, two, row = one[cut:], two[cut:], row[cut:]
        open_ = label[one] != label[two]
        one, two, row = one[open_], two[open_], row[open_]
    moved = np.flatnonzero(label != np.arange(k))
    return names[moved], names[label[moved]]
