"""Registered queries on points, merging, measuring areas, rays and the boundary, each with its equivalent SQL."""

from __future__ import annotations

from dataclasses import replace
from math import cos, floor, pi, sin

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubitgrid.functions import geometry as G
from cubitgrid.operators import cluster as C
from cubitgrid.operators import merge as M
from cubitgrid.operators import outline as L
from cubitgrid.operators import points as P
from cubitgrid.operators import rings as R
from cubitgrid.operators import techum as T
from cubitgrid.plans import settings as S
from cubitgrid.plans.spatial_queries import B, CLUSTERS, GAP, HULLS, KEYS, PT, SC, SUMMARY, _cities, _clustered, _hull, m, milli
from cubitgrid.plans.tables import Tables
from cubitgrid.sources import fixtures as X

NOW = S.Settings()
MERGE = NOW.mm(S.MERGE_GAP) - GAP
SIDE = NOW.mm(S.TRIANGLE_SIDE)
SPAN = NOW.mm(S.TRIANGLE_SPAN)
TECHUM, STEP = NOW.mm(S.TECHUM), NOW.mm(S.TECHUM) // 40
AMOT4, REMA, DESCENT = NOW.mm(S.FOUR_AMOT), NOW.mm(S.REMA_EXTRA), NOW.mm(S.DESCENT_LIMIT)
NEAR_MM = 200_000
#: The synthetic cities lie far apart: six times the span lets the triangle rule find some.
WIDE_SPAN = 6 * SPAN

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# points


@query(f"with {B}, {PT} select point_id, min(building_id) building_id from pt join b using (scenario_id) where x between x0 and x1 and y between y0 and y1 group by point_id")
def pip_first_match(spark, sf_dir):
    return P.first_match(X.points(spark, sf_dir), X.buildings(spark, sf_dir), "building_id")


@query(f"""with {B}, {PT}, d as (select point_id, building_id, greatest(0, x0 - x, x - x1) dx, greatest(0, y0 - y, y - y1) dy from pt join b using (scenario_id)
where x between x0 - 100000 and x1 + 100000 and y between y0 - 100000 and y1 + 100000),
r as (select *, dx * dx + dy * dy square, row_number() over (partition by point_id order by dx * dx + dy * dy, building_id) n from d where dx * dx + dy * dy <= 10000000000)
select point_id, building_id, cast(square as bigint) square from r where n = 1""")
def point_boundary_gap(spark, sf_dir):
    return P.nearest(X.points(spark, sf_dir), X.buildings(spark, sf_dir), "building_id", 100_000).select("point_id", "building_id", F.col("square").cast("bigint").alias("square"))


#: Corners of the octagon that footprints are grown by, in whole millimetres.
_OCT = [(floor(x + 0.5), floor(y + 0.5)) for x, y in G.octagon_points(GAP / 2)]
_FAR = _OCT[0][0]
#: Corners of a grown rectangle, counter-clockwise: the octagon's vertex and the rectangle's corner that it stands at.
_RIM = [(0, 1, 0), (0, 1, 1), (1, 1, 1), (2, 1, 1), (2, 0, 1), (3, 0, 1), (4, 0, 1), (4, 0, 0), (5, 0, 0), (6, 0, 0), (6, 1, 0), (7, 1, 0)]
_RIM_X = ", ".join(f"x{i} + {_OCT[k][0]}::double" for k, i, _ in _RIM)
_RIM_Y = ", ".join(f"y{j} + {_OCT[k][1]}::double" for k, _, j in _RIM)
#: Outward normals of the octagon's sides and of the axes, with how far the octagon reaches along them.
_NORMALS = [(q[1] - p[1], p[0] - q[0], (q[1] - p[1]) * p[0] + (p[0] - q[0]) * p[1]) for p, q in zip(_OCT, _OCT[1:] + _OCT[:1], strict=True)] + [(1, 0, _FAR), (-1, 0, _FAR), (0, 1, _FAR), (0, -1, _FAR)]
#: Sides as half planes nx * x + ny * y < ox * x0 + px * x1 + oy * y0 + py * y1 + c.
_PLANES = ", ".join(f"({nx}::double, {ny}::double, {min(nx, 0)}::double, {max(nx, 0)}::double, {min(ny, 0)}::double, {max(ny, 0)}::double, {c}::double)" for nx, ny, c in _NORMALS)
_REACH = 2 * round(_FAR) + 2


_RINGS = f"""cb as (select c.*, number from c join ci using (scenario_id, cluster)),
vt as (select cluster, building_id, unnest(range(12)) i, unnest([{_RIM_X}]) x, unnest([{_RIM_Y}]) y from cb),
sg as (select a.cluster, a.building_id, a.i, a.x ax, a.y ay, b.x - a.x ex, b.y - a.y ey from vt a join vt b on a.building_id = b.building_id and b.i = (a.i + 1) % 12),
nb as (select a.building_id a, b.* from cb a join cb b on a.cluster = b.cluster and a.building_id <> b.building_id and b.x0 <= a.x1 + {_REACH} and a.x0 <= b.x1 + {_REACH} and b.y0 <= a.y1 + {_REACH} and a.y0 <= b.y1 + {_REACH}),
pl(nx, ny, ox, px, oy, py, c) as (values {_PLANES}),
hp as (select sg.building_id, i, nb.building_id other, nx * ex + ny * ey dn, ox * x0 + px * x1 + oy * y0 + py * y1 + c - nx * ax - ny * ay rest from sg join nb on nb.a = sg.building_id, pl),
iv as (select building_id, i, greatest(0, coalesce(max(case when dn < 0 then rest / dn end), 0)) lo, least(1, coalesce(min(case when dn > 0 then rest / dn end), 1)) hi from hp group by building_id, i, other having count(*) filter (dn = 0 and rest <= 0) = 0),
cv as (select * from iv where lo < hi union all select building_id, i, 1, 1 from sg),
gp as (select building_id, i, greatest(0, coalesce(max(hi) over (partition by building_id, i order by lo, hi rows between unbounded preceding and 1 preceding), 0)) lo, lo hi from cv),
r0 as (select building_id, i, lo, sg.cluster, floor(ax + lo * ex + 0.5) ax, floor(ay + lo * ey + 0.5) ay, floor(ax + hi * ex + 0.5) bx, floor(ay + hi * ey + 0.5) bz from gp join sg using (building_id, i) where hi - lo > 1e-9),
f0 as (select row_number() over (order by building_id, i, lo) id, cluster, ax, ay, bx - ax ex, bz - ay ey from r0 where ax <> bx or ay <> bz),
tn as (select a.id a, b.id b, atan2(-a.ey, -a.ex) - atan2(b.ey, b.ex) turn from f0 a join f0 b on a.cluster = b.cluster and a.ax + a.ex = b.ax and a.ay + a.ey = b.ay),
nx as (select a, arg_min(b, case when abs(turn) < 1e-12 then 7 when turn < 0 then turn + 2 * pi() else turn end) b from tn group by a),
rr(id, root) as (select id, id from f0 union select nx.b, rr.root from rr join nx on nx.a = rr.id),
rt as (select id, min(root) root from rr group by id), oc as (select root from rt join f0 using (id) group by root having sum(ax * ey - ay * ex) > 0),
fr as (select f0.* from f0 join rt using (id) join oc using (root))"""


def _shvita_sql(strip: bool) -> str:
    """The rule itself: sides of grown footprints, less what lies inside other ones, are outlines, which run clockwise
    around holes; a point is in the city if it is inside the outer ones and half a gap from them."""
    grow = REMA if strip else 0
    return f"""{_RINGS},
cd as (select point_id, x, y, ci.cluster, number from pt join ci on ci.scenario_id = pt.scenario_id and x between minx - {2 * _FAR} and maxx + {2 * _FAR} and y between miny - {2 * _FAR} and maxy + {2 * _FAR}),
ds as (select point_id, cd.x, cd.y, cd.cluster, number, min(sqrt(pow(x - ax - greatest(0, least(1, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey))) * ex, 2) + pow(y - ay - greatest(0, least(1, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey))) * ey, 2))) far, count(*) filter ((ay > y) <> (ay + ey > y) and x < ax + (y - ay) / ey * ex) % 2 = 1 inside from cd join fr using (cluster) group by all),
gr as (select point_id, min(number) number from ds where {f"inside or far <= {GAP // 2}" if strip else f"inside and far >= {GAP // 2}"} group by point_id),
sq as (select scenario_id, cluster, number, minx - {grow} minx, miny - {grow} miny, maxx + {grow} maxx, maxy + {grow} maxy from ci),
ri as (select distinct point_id from pt join sq using (scenario_id) where x between minx and maxx and y between miny and maxy),
bu as (select point_id, min(building_id) building_id from pt join b using (scenario_id) where x between x0 and x1 and y between y0 and y1 group by point_id),
sh as (select pt.point_id, case when gr.number is not null then 'city' when bu.building_id is not null then 'building' else 'point' end source, gr.number is null and ri.point_id is not null ribua,
  cast(case when gr.number is not null then sq.minx when bu.building_id is not null then b.x0 else x - {AMOT4} end as bigint) minx, cast(case when gr.number is not null then sq.miny when bu.building_id is not null then b.y0 else y - {AMOT4} end as bigint) miny,
  cast(case when gr.number is not null then sq.maxx when bu.building_id is not null then b.x1 else x + {AMOT4} end as bigint) maxx, cast(case when gr.number is not null then sq.maxy when bu.building_id is not null then b.y1 else y + {AMOT4} end as bigint) maxy
  from pt left join gr using (point_id) left join sq on sq.scenario_id = pt.scenario_id and sq.number = gr.number left join bu on bu.point_id = pt.point_id left join b on b.building_id = bu.building_id left join ri on ri.point_id = pt.point_id)"""


def _areas(spark, sf_dir, strip: bool = False) -> DataFrame:
    """The areas of all points, cities squared to the world's axes."""
    from cubitgrid.operators import square as Q

    buildings, cities = _cities(spark, sf_dir)
    squared = cities.select("scenario_id", "cluster", "number", F.lit(0.0).alias("angle"), *[F.col(c).cast("double").alias(n) for n, c in (("minu", "minx"), ("minv", "miny"), ("maxu", "maxx"), ("maxv", "maxy"))], F.lit(None).cast(f"array<{Q.RING}>").alias("pieces"))
    points = X.points(spark, sf_dir)
    asked = P.worth_outlining(points, cities, 2 * _FAR)
    outlines = Tables(spark, "outlines").cut(L.outlines(buildings.join(asked, "cluster", "left_semi"), GAP / 2))
    got = P.shvita(points, Q.with_extra(squared, REMA if strip else 0), outlines, X.buildings(spark, sf_dir), GAP // 2, AMOT4, strip)
    return got.select("point_id", "source", "ribua", *[F.col(c).cast("bigint").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


_WALK = """sa as (select root, cluster, scenario_id, id, ax, ay from (select rt.root, f0.*, ci.scenario_id, row_number() over (partition by rt.root order by ax, ay, id) r from rt join f0 using (id) join oc using (root) join ci using (cluster)) where r = 1),
sr as (select *, row_number() over (partition by cluster order by ax, ay) - 1 ring from sa),
wk(root, id, i) as (select root, id, 0 from sr union all select wk.root, nx.b, i + 1 from wk join nx on nx.a = wk.id join sr on sr.root = wk.root where nx.b <> sr.id)"""


@query(f"with recursive {SUMMARY}, {_RINGS}, {_WALK} select sr.scenario_id, sr.cluster, cast(ring as bigint) ring, cast(i as bigint) i, cast(f0.ax as bigint) x, cast(f0.ay as bigint) y from wk join sr using (root) join f0 on f0.id = wk.id")
def city_rings(spark, sf_dir):
    """Corners of all cities' outlines in their order, from each ring's smallest one on."""
    rings = L.outlines(_cities(spark, sf_dir)[0], GAP / 2)
    return rings.select(*KEYS, "ring", "i", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))


def _to_segment(x: str, y: str, s: str) -> str:
    t = f"greatest(0, least(1, (({x} - {s}.ax) * {s}.ex + ({y} - {s}.ay) * {s}.ey) / ({s}.ex * {s}.ex + {s}.ey * {s}.ey)))"
    return f"sqrt(pow({x} - {s}.ax - {t} * {s}.ex, 2) + pow({y} - {s}.ay - {t} * {s}.ey, 2))"


@query(f"""with recursive {SUMMARY}, {_RINGS}, pp as (select a.scenario_id, a.cluster a, b.cluster c from ci a join ci b on a.scenario_id = b.scenario_id and b.number = a.number + 1)
select pp.scenario_id, a, c, {m(f"min(least({_to_segment('p.ax', 'p.ay', 'q')}, {_to_segment('p.ax + p.ex', 'p.ay + p.ey', 'q')}, {_to_segment('q.ax', 'q.ay', 'p')}, {_to_segment('q.ax + q.ex', 'q.ay + q.ey', 'p')}))")} far_um
from pp join f0 p on p.cluster = pp.a join f0 q on q.cluster = pp.c group by all""")
def ring_gap_lines(spark, sf_dir):
    """The shortest line between the outlines, holes too, of each city and the next one, however far apart they are."""
    from cubitgrid.operators.nearest import ring_lines

    buildings, cities = _cities(spark, sf_dir)
    rings = Tables(spark, "outlines").cut(L.outlines(buildings, GAP / 2, holes=True))
    pairs = cities.select("scenario_id", F.col("cluster").alias("a"), (F.col("number") + 1).alias("number")).join(cities.select("scenario_id", F.col("cluster").alias("c"), "number"), ["scenario_id", "number"])
    return ring_lines(pairs, L.sides(rings)).select("scenario_id", "a", "c", milli(F.col("far")).alias("far_um"))


#: How far a city's second copy lies from the first one.
_MOVED = (7_000, 5_000)


def _overlaid(spark, sf_dir) -> DataFrame:
    """The ground of each city's footprints and the same ground moved, overlaid."""
    from cubitgrid.operators import overlay as V

    buildings, _ = _cities(spark, sf_dir)
    sides = Tables(spark, "outlines").cut(L.sides(L.rings(L.open_parts(buildings, np.zeros((1, 2), "int64")), Tables(spark, "outlines"))))
    x, y = _MOVED
    moved = sides.select(*KEYS, *[(F.col(c) + d).alias(c) for c, d in (("ax", x), ("ay", y), ("bx", x), ("by", y))])
    return V.areas(sides, moved)


def _union_sql(boxes: str) -> str:
    """Exact areas of unions of boxes: strips between all x, covered by spans that windows merge."""
    return f"""bx as (select distinct cluster, x0, y0, x1, y1 from ({boxes})), xs as (select distinct cluster, unnest([x0, x1]) x from bx),
st as (select cluster, x xa, lead(x) over (partition by cluster order by x) xb from xs), cv as (select st.cluster, xa, xb, y0, y1, max(y1) over (partition by st.cluster, xa order by y0, y1 rows between unbounded preceding and 1 preceding) top
  from st join bx on bx.cluster = st.cluster and x0 <= xa and x1 >= xb where xb is not null),
ua as (select cluster, sum((xb - xa) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) area from cv group by cluster)"""


_OVERLAID = f"""with recursive {SUMMARY}, cm as (select c.* from c join ci using (scenario_id, cluster)), one as (with {_union_sql('select cluster, x0, y0, x1, y1 from cm')} select * from ua),
two as (with {_union_sql(f'select cluster, x0, y0, x1, y1 from cm union all select cluster, x0 + {_MOVED[0]}, y0 + {_MOVED[1]}, x1 + {_MOVED[0]}, y1 + {_MOVED[1]} from cm')} select * from ua)
select ci.scenario_id, ci.cluster, """


@query(f"{_OVERLAID} cast(2 * one.area - two.area as bigint) area from ci join one using (cluster) join two using (cluster)")
def ring_intersection_area(spark, sf_dir):
    """Square millimetres that a city's footprints and their moved copy have in common."""
    return _overlaid(spark, sf_dir).select(*KEYS, F.floor(F.col("both") + 0.5).cast("bigint").alias("area"))


@query(f"{_OVERLAID} cast(two.area - one.area as bigint) area from ci join one using (cluster) join two using (cluster)")
def ring_difference_area(spark, sf_dir):
    """Square millimetres that a city's footprints have alone, without their moved copy."""
    return _overlaid(spark, sf_dir).select(*KEYS, F.floor(F.col("one_alone") + 0.5).cast("bigint").alias("area"))


_CLOSE = MERGE // 2 + 500


def _closing_sql(boxes: str, close: int) -> str:
    """Windows `wd` around clusters' grown boxes, and `gf`: what a square brush covers in them where no box is in its way."""
    return f"""cm as (select cluster, x0 - {close} x0, y0 - {close} y0, x1 + {close} x1, y1 + {close} y1 from ({boxes})),
wd as (select cluster, min(x0) lx, min(y0) ly, max(x1) hx, max(y1) hy from cm group by cluster),
xw as (select distinct cluster, unnest([x0, x1]) x from cm), sw as (select * from (select cluster, x xa, lead(x) over (partition by cluster order by x) xb from xw) where xb is not null),
vw as (select cluster, xa, xb, y0, y1 from sw join cm using (cluster) where x0 <= xa and x1 >= xb union all select cluster, xa, xb, hy, hy from sw join wd using (cluster)),
gw as (select cluster, xa, xb, coalesce(max(y1) over (partition by cluster, xa order by y0, y1 rows between unbounded preceding and 1 preceding), ly) g0, y0 g1 from vw join wd using (cluster)),
fw as (select cluster, xa x0, g0 y0, xb x1, g1 y1 from gw where g1 > g0 union all
  select cluster, unnest([lx - 1, hx, lx - 1, lx - 1]), unnest([ly - 1, ly - 1, ly - 1, hy]), unnest([lx, hx + 1, hx + 1, hx + 1]), unnest([hy + 1, hy + 1, ly, hy + 1]) from wd),
gf as (select fw.cluster, greatest(x0 - {close}, lx) x0, greatest(y0 - {close}, ly) y0, least(x1 + {close}, hx) x1, least(y1 + {close}, hy) y1 from fw join wd using (cluster))"""


_CLOSED = f"""with recursive {SUMMARY}, {_closing_sql('select cluster, x0, y0, x1, y1 from c join ci using (scenario_id, cluster)', _CLOSE)},
{_union_sql('select cluster, x0, y0, x1, y1 from gf')} select ci.scenario_id, ci.cluster, cast((hx - lx) * (hy - ly) - area as bigint) area from ci join wd using (cluster) join ua using (cluster)"""


def _square(half: int) -> np.ndarray:
    return np.array([[-half, -half], [half, -half], [half, half], [-half, half]], "int64")


@query(_CLOSED)
def closed_area(spark, sf_dir):
    """Square millimetres of each city's footprints after closing by a square of half the merging distance and half a metre."""
    rings = L.closed(_cities(spark, sf_dir)[0], np.zeros((1, 2), "int64"), _square(_CLOSE))
    return rings.where("i = 0").groupBy(*KEYS).agg(F.sum("area").cast("bigint").alias("area"))


@query(f"with recursive {SUMMARY}, {PT}, {_shvita_sql(False)} select point_id, cluster, inside, case when far <= {GAP // 2} then {m('far')} end far_um from ds where inside or far <= {GAP // 2}")
def point_in_outline(spark, sf_dir):
    """Points inside a city's outline, or within half a gap of it, with how far they are from it if within half a gap."""
    points = X.points(spark, sf_dir)
    buildings, cities = _cities(spark, sf_dir)
    rings = Tables(spark, "outlines").cut(L.outlines(buildings.join(P.worth_outlining(points, cities, 2 * _FAR), "cluster", "left_semi"), GAP / 2))
    box = cities.select(*KEYS, *[(F.col(c) + d).alias(n) for n, c, d in (("x0", "minx", -2 * _FAR), ("y0", "miny", -2 * _FAR), ("x1", "maxx", 2 * _FAR), ("y1", "maxy", 2 * _FAR))])
    met = P.against_outlines(P.candidates(points, box), rings, GAP // 2)
    return met.where("inside or far is not null").select("point_id", "cluster", "inside", milli(F.col("far")).alias("far_um"))


@query(f"with recursive {SUMMARY}, {PT}, {_shvita_sql(False)} select point_id, source, ribua, minx, miny, maxx, maxy from sh")
def shvita_priority(spark, sf_dir):
    return _areas(spark, sf_dir)


@query(f"with recursive {SUMMARY}, {PT}, {_shvita_sql(True)} select point_id, source, ribua, minx, miny, maxx, maxy from sh")
def shvita_rema(spark, sf_dir):
    """With the Rema's strip around each city and its squaring."""
    return _areas(spark, sf_dir, strip=True)


# merging

_CITY_PAIRS = f"""bb as (select c.* from c join ci using (scenario_id, cluster)),
cpair as (select a.scenario_id, a.cluster a, b.cluster c, a.building_id ab, b.building_id cb, greatest(0, b.x0 - a.x1, a.x0 - b.x1) dx, greatest(0, b.y0 - a.y1, a.y0 - b.y1) dy,
  a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, b.x0 bx0, b.y0 by0, b.x1 bx1, b.y1 by1 from bb a join bb b on a.scenario_id = b.scenario_id and a.cluster < b.cluster
  and b.x0 <= a.x1 + {NEAR_MM} and a.x0 <= b.x1 + {NEAR_MM} and b.y0 <= a.y1 + {NEAR_MM} and a.y0 <= b.y1 + {NEAR_MM}),
gl as (select * from (select *, dx * dx + dy * dy square, row_number() over (partition by a, c order by dx * dx + dy * dy, ab, cb) n from cpair) where n = 1 and square <= {NEAR_MM**2})"""


@query(f"with recursive {SUMMARY}, {_CITY_PAIRS} select scenario_id, a, c, cast(square as bigint) square from gl")
def city_gap_matrix(spark, sf_dir):
    return M.gap_lines(_cities(spark, sf_dir)[0], NEAR_MM).select("scenario_id", "a", "c", F.col("square").cast("bigint").alias("square"))


_LINES = """li as (select scenario_id, a, c, ab, cb, cast(square as bigint) square,
  cast(case when ax1 < bx0 then ax1 when bx1 < ax0 then ax0 else floor((greatest(ax0, bx0) + least(ax1, bx1)) / 2) end as bigint) px, cast(case when ay1 < by0 then ay1 when by1 < ay0 then ay0 else floor((greatest(ay0, by0) + least(ay1, by1)) / 2) end as bigint) py,
  cast(case when ax1 < bx0 then bx0 when bx1 < ax0 then bx1 else floor((greatest(ax0, bx0) + least(ax1, bx1)) / 2) end as bigint) qx, cast(case when ay1 < by0 then by0 when by1 < ay0 then by1 else floor((greatest(ay0, by0) + least(ay1, by1)) / 2) end as bigint) qy from gl)"""


@query(f"with recursive {SUMMARY}, {_CITY_PAIRS}, {_LINES} select scenario_id, a, c, ab a_building, cb c_building, px, py, qx, qy from li")
def gap_line(spark, sf_dir):
    return M.gap_lines(_cities(spark, sf_dir)[0], NEAR_MM).select("scenario_id", "a", "c", "a_building", "c_building", "px", "py", "qx", "qy")


_SIDE_OF = "(qx - px) * ({y} - py) - (qy - py) * ({x} - px)"
_CORNERS = ", ".join(_SIDE_OF.format(x=x, y=y) for x in ("x0", "x1") for y in ("y0", "y1"))


@query(f"""with recursive {SUMMARY}, {_CITY_PAIRS}, {_LINES} select scenario_id, a, c from li where not exists (select 1 from bb d where d.scenario_id = li.scenario_id and d.cluster <> a and d.cluster <> c
and not (greatest(px, qx) < x0 or x1 < least(px, qx) or greatest(py, qy) < y0 or y1 < least(py, qy)) and not (least(px, qx) > x0 and greatest(px, qx) < x1 and least(py, qy) > y0 and greatest(py, qy) < y1)
and least({_CORNERS}) <= 0 and greatest({_CORNERS}) >= 0)""")
def blockers_anti(spark, sf_dir):
    buildings, _ = _cities(spark, sf_dir)
    return M.unblocked(M.gap_lines(buildings, NEAR_MM), buildings).where("blocked_by is null").select("scenario_id", "a", "c")


_R = GAP / G.COS_OCTAGON
_D = _R * 0.7071067811865476


def _seg_sql(x1, y1, x2, y2) -> str:
    dx, dy = x2 - x1, y2 - y1
    t = f"least(greatest(((dx - {x1!r}::double) * {dx!r}::double + (dy - {y1!r}::double) * {dy!r}::double) / {dx * dx + dy * dy!r}::double, 0), 1)"
    return f"sqrt(pow(dx - {x1!r}::double - {t} * {dx!r}::double, 2) + pow(dy - {y1!r}::double - {t} * {dy!r}::double, 2))"


_OUTLINE = f"case when greatest(dx * {G.COS_OCTAGON!r}::double + dy * {G.SIN_OCTAGON!r}::double, dx * {G.SIN_OCTAGON!r}::double + dy * {G.COS_OCTAGON!r}::double) <= {GAP} then 0 else least({_seg_sql(_R, 0.0, _D, _D)}, {_seg_sql(_D, _D, 0.0, _R)}) end"
_MERGED = f"""ml as (select distinct scenario_id, a, c b from cpair where {_OUTLINE} <= {MERGE}), m2 as (select a, b from ml union all select b, a from ml),
mreach(id, root) as (select cluster, cluster from ci union select m2.b, mreach.root from mreach join m2 on m2.a = mreach.id),
mg as (select ci.*, r.root from ci join (select id, min(root) root from mreach group by id) r on r.id = ci.cluster)"""


@query(f"with recursive {SUMMARY}, {_CITY_PAIRS}, {_MERGED} select scenario_id, number, cluster, root from mg")
def merge_plain(spark, sf_dir):
    buildings, cities = _cities(spark, sf_dir)
    return M.merged(cities, M.plain_links(buildings, GAP, MERGE)).select("scenario_id", "number", "cluster", "root")


@query(f"with recursive {SUMMARY}, {_CITY_PAIRS}, {_MERGED} select scenario_id, root, string_agg(cast(number as varchar), '+' order by number) as label, count(*) n_cities, cast(sum(building_count) as bigint) building_count from mg group by scenario_id, root")
def label_concat(spark, sf_dir):
    buildings, cities = _cities(spark, sf_dir)
    return M.labels(M.merged(cities, M.plain_links(buildings, GAP, MERGE)))


@query(f"""with recursive {SUMMARY}, nr as (select a.scenario_id, a.cluster a, b.cluster b, greatest(0, b.minx - a.maxx, a.minx - b.maxx) dx, greatest(0, b.miny - a.maxy, a.miny - b.maxy) dy,
  a.minx ax0, a.miny ay0, a.maxx ax1, a.maxy ay1, b.minx bx0, b.miny by0, b.maxx bx1, b.maxy by1 from ci a join ci b on a.scenario_id = b.scenario_id and a.cluster <> b.cluster),
ok as (select * from nr where dx * dx + dy * dy <= {SIDE}::bigint * {SIDE}),
g0 as (select *, case when dx * dy = 0 or ay1 < by0 then 1 else -1 end sg, sqrt((dx * dx + dy * dy)::double) len from ok where (dx > 0 and ax1 < bx0) or (dx = 0 and dy > 0 and ay1 < by0)),
g1 as (select scenario_id, a, b c, dx, dy, sg, ax0, ax1, bx0, bx1, dx / len ux, dy / len uy, case when sg > 0 then ay0 else -ay1 end ay0, case when sg > 0 then ay1 else -ay0 end ay1, case when sg > 0 then by0 else -by1 end by0, case when sg > 0 then by1 else -by0 end by1 from g0),
g2 as (select *, greatest(-ax1 * uy + ay0 * ux, -bx1 * uy + by0 * ux) v0, least(-ax0 * uy + ay1 * ux, -bx0 * uy + by1 * ux) v1 from g1),
g3 as (select *, case when dy = 0 then ax1::double when dx = 0 then ay1::double else least((ax1 + v0 * uy) / ux, (ay1 - v0 * ux) / uy, (ax1 + v1 * uy) / ux, (ay1 - v1 * ux) / uy) end lo,
  case when dy = 0 then bx0::double when dx = 0 then by0::double else greatest((bx0 + v0 * uy) / ux, (by0 - v0 * ux) / uy, (bx0 + v1 * uy) / ux, (by0 - v1 * ux) / uy) end hi from g2)
select g.scenario_id, g.a, g.c, ab.b from g3 g join ok ab on ab.a = g.a join ok cb on cb.a = g.c and cb.b = ab.b
where ab.bx1 * ux + case when sg > 0 then ab.by1 else -ab.by0 end * uy >= lo and ab.bx0 * ux + case when sg > 0 then ab.by0 else -ab.by1 end * uy <= hi""")
def corridor_filter(spark, sf_dir):
    return M.corridors(_cities(spark, sf_dir)[1], SIDE)


#: The largest square in the octagon by which footprints are grown, so that parts don't meet, and a brush that fills what the
#: octagons leave open between them.
_GROWN = floor(GAP / 2 / (G.COS_OCTAGON + G.SIN_OCTAGON))
_SEAL = _CLOSE + GAP // 2 - _GROWN


@query(f"""with recursive {SUMMARY}, {_CITY_PAIRS}, {_MERGED}, mr as (select root from mg group by root having count(*) > 1),
gb as (select mg.root, c.cluster, x0 - {_GROWN} x0, y0 - {_GROWN} y0, x1 + {_GROWN} x1, y1 + {_GROWN} y1 from c join mg using (scenario_id, cluster) join mr using (root)),
{_closing_sql('select root as cluster, x0, y0, x1, y1 from gb', _SEAL)}, cb as (select * from gf union select root, x0, y0, x1, y1 from gb),
xf as (select distinct cluster, unnest([x0, x1]) x from cb), sf as (select cluster, x xa, lead(x) over (partition by cluster order by x) xb from xf),
cf as (select sf.cluster, xa, xb, y0, max(y1) over (partition by sf.cluster, xa order by y0, y1 rows between unbounded preceding and 1 preceding) top from sf join cb on cb.cluster = sf.cluster and x0 <= xa and x1 >= xb),
fr as (select row_number() over (order by cluster, xa, y0) id, cluster, xa, xb, top g0, y0 g1 from cf where y0 > top),
ad as (select a.id a, b.id b from fr a join fr b on a.cluster = b.cluster and a.xb = b.xa and a.g0 < b.g1 and b.g0 < a.g1), a2 as (select a, b from ad union all select b, a from ad),
fp(id, p) as (select id, id from fr union select a2.b, fp.p from fp join a2 on a2.a = fp.id), pc as (select id, min(p) p from fp group by id),
tp as (select p, count(distinct gb.cluster) n_parts from fr join pc using (id) join gb on gb.root = fr.cluster
  and ((x0 <= xa and x1 >= xb and (y1 = g0 or y0 = g1)) or ((x1 = xa or x0 = xb) and y0 < g1 and y1 > g0)) group by p),
ar as (select cluster root, p, min({{'x': xa, 'y': g0}}) l, sum((xb - xa) * (g1 - g0)) area from fr join pc using (id) group by all)
select ci.scenario_id, root, row_number() over (partition by root order by l) - 1 piece, cast(l.x as bigint) x, cast(l.y as bigint) y, cast(area as bigint) area, n_parts, count(*) over (partition by root) n_pieces
from ar join tp using (p) join ci on ci.cluster = root where n_parts > 1""")
def bridge_pieces(spark, sf_dir):
    """Pieces that closing adds between the parts of merged cities, of those that join at least two parts."""
    from cubitgrid.operators.bridges import bridges

    buildings, cities = _cities(spark, sf_dir)
    roots = M.merged(cities, M.plain_links(buildings, GAP, MERGE)).select("cluster", "root")
    return bridges(buildings.join(roots, "cluster"), _square(_GROWN), _square(_SEAL))


def _merged_shapes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Merged cities as boxes, and their buildings under the merged city."""
    buildings, cities = _cities(spark, sf_dir)
    roots = M.merged(cities, M.plain_links(buildings, GAP, MERGE)).select("cluster", "root")
    shapes = buildings.join(roots, "cluster").drop("cluster").withColumnRenamed("root", "cluster")
    return C.summary(shapes), shapes


def _triangles_sql(span: int, wide: bool) -> str:
    """Links of the triangle rule between the clusters of footprints `mb`."""
    narrow = "" if wide else f" and hi - lo <= greatest(dist - {GAP}, 0) + {GAP}"
    return f"""ms as (select scenario_id, cluster, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from mb group by all),
sd0 as (select a.scenario_id, a.cluster a, b.cluster b, greatest(0, b.x0 - a.x1, a.x0 - b.x1) dx, greatest(0, b.y0 - a.y1, a.y0 - b.y1) dy from ms a join ms b on a.scenario_id = b.scenario_id and a.cluster <> b.cluster),
sd as (select scenario_id, a, b from sd0 where {_OUTLINE} <= {SIDE - GAP}),
ap as (select a.scenario_id, a.cluster a, b.cluster c, a.building_id ab, b.building_id cb, greatest(0, b.x0 - a.x1, a.x0 - b.x1) dx, greatest(0, b.y0 - a.y1, a.y0 - b.y1) dy,
  a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, b.x0 bx0, b.y0 by0, b.x1 bx1, b.y1 by1 from mb a join mb b on a.scenario_id = b.scenario_id and a.cluster < b.cluster),
gl2 as (select * from (select *, dx * dx + dy * dy square, row_number() over (partition by a, c order by dx * dx + dy * dy, ab, cb) n from ap) where n = 1),
{_LINES.replace("from gl)", "from gl2)").replace("li as", "li2 as")},
bk as (select li2.a, li2.c, d.cluster d from li2 join mb d on d.scenario_id = li2.scenario_id and d.cluster <> a and d.cluster <> c
  where not (greatest(px, qx) < x0 or x1 < least(px, qx) or greatest(py, qy) < y0 or y1 < least(py, qy)) and not (least(px, qx) > x0 and greatest(px, qx) < x1 and least(py, qy) > y0 and greatest(py, qy) < y1)
  and least({_CORNERS}) <= 0 and greatest({_CORNERS}) >= 0),
t3 as (select li2.scenario_id, li2.a, li2.c, s1.b, px, py, qx, qy, sqrt(square::double) dist, x0, y0, x1, y1 from li2 join sd s1 on s1.a = li2.a join sd s2 on s2.a = li2.c and s2.b = s1.b join ms on ms.cluster = s1.b),
t4 as (select *, (qx - px) / dist ux, (qy - py) / dist uy from t3),
t5 as (select *, least(x0 * ux + y0 * uy, x0 * ux + y1 * uy, x1 * ux + y0 * uy, x1 * ux + y1 * uy) lo, greatest(x0 * ux + y0 * uy, x0 * ux + y1 * uy, x1 * ux + y0 * uy, x1 * ux + y1 * uy) hi, px * ux + py * uy us, qx * ux + qy * uy ue from t4),
t6 as (select scenario_id, a, b, c from t5 where (dist = 0 or (hi >= us and lo <= ue and greatest(dist - {GAP}, 0) <= {span - GAP} + hi - lo{narrow}))
  and not exists (select 1 from bk where bk.a = t5.a and bk.c = t5.c and bk.d <> t5.b))
select distinct scenario_id, a, c b from t6 union select distinct scenario_id, least(a, b) a, greatest(a, b) b from t6"""


@query(f"""with recursive {SUMMARY}, {_CITY_PAIRS}, {_MERGED}, mb as (select bb.scenario_id, mg.root as cluster, bb.building_id, x0, y0, x1, y1 from bb join mg using (scenario_id, cluster)), {_triangles_sql(WIDE_SPAN, True)}""")
def merge_triangles(spark, sf_dir):
    """Links that the triangle rule adds where a wide middle city counts, boxes standing for hulls of merged cities."""
    cities, buildings = _merged_shapes(spark, sf_dir)
    return M.triangle_links(cities, buildings, GAP, SIDE, WIDE_SPAN, wide=True)


@query(f"""with recursive {CLUSTERS}, mb as (select scenario_id, cluster, building_id, x0, y0, x1, y1 from c), {_triangles_sql(SPAN, False)}""")
def merge_triangles_narrow(spark, sf_dir):
    """Links by the rule's own span, with no wide middle, between all clusters of footprints, however few they have."""
    buildings = _clustered(spark, sf_dir)
    return M.triangle_links(C.summary(buildings), buildings, GAP, SIDE, SPAN)


@query(f"""with recursive {SUMMARY}, bb as (select c.scenario_id, c.cluster, x0, y0, x1, y1 from c join ci using (scenario_id, cluster)), xc as (select distinct scenario_id, cluster, unnest([x0, x1]) xa from bb),
xs as (select *, lead(xa) over (partition by scenario_id, cluster order by xa) xb from xc), yc as (select distinct scenario_id, cluster, unnest([y0, y1]) ya from bb),
ys as (select *, lead(ya) over (partition by scenario_id, cluster order by ya) yb from yc)
select xs.scenario_id, xs.cluster, cast(sum((xb - xa) * (yb - ya)) as bigint) area from xs join ys using (scenario_id, cluster) where xb is not null and yb is not null
and exists (select 1 from bb where bb.cluster = xs.cluster and x0 <= xa and x1 >= xb and y0 <= ya and y1 >= yb) group by all""")
def union_area_rects(spark, sf_dir):
    return M.union_area(_cities(spark, sf_dir)[0], KEYS).select(*KEYS, F.col("area").cast("bigint").alias("area"))


# rays and the boundary

_RAYS = f"""{X.RAY_SQL},
r1 as (select *, first_value(elev) over (partition by ray_id order by k) st, last_value(elev ignore nulls) over (partition by ray_id order by k rows between unbounded preceding and 1 preceding) pv from rs),
r2 as (select *, case when elev is null or pv is null then {STEP}::double when abs(elev - pv)::double / {STEP} < {S.GRADIENT!r}::double or (elev < pv and st - elev > {DESCENT})
  then sqrt({STEP}::double * {STEP} + (elev - pv)::double * (elev - pv)) else {STEP}::double end cost from r1 where k > 0),
r3 as (select *, sum(cost) over (partition by ray_id order by k rows unbounded preceding) used from r2),
r4 as (select ray_id, first(st) st, min(k) filter (used >= {TECHUM}) hit from r3 group by ray_id),
wk as (select r4.ray_id, case when r4.st is null or hit is null then {TECHUM}::double else (r3.k - 1) * {STEP} + ({TECHUM} - (used - cost)) / cost * {STEP} end distance from r4 left join r3 on r3.ray_id = r4.ray_id and r3.k = r4.hit)"""


@query(f"with {_RAYS} select ray_id, {m('distance')} distance_um from wk")
def ray_walk(spark, sf_dir):
    return T.ray_walk(X.ray_samples(spark, sf_dir), STEP, TECHUM, DESCENT).select("ray_id", milli(F.col("distance")).alias("distance_um"))


def _with_rays(spark, sf_dir) -> DataFrame:
    rays = T.pivot_rays(T.ray_walk(X.ray_samples(spark, sf_dir), STEP, TECHUM, DESCENT))
    a = F.col("area_id")
    return rays.select("*", (a * 1000).alias("minx"), (a * 700).alias("miny"), (a * 1000 + 50000 + a % 7 * 9000).alias("maxx"), (a * 700 + 40000 + a % 5 * 8000).alias("maxy"))


_AREAS = f"""{_RAYS}, pv as (select cast(ray_id // 8 as bigint) area_id, {", ".join(f"max(case when ray_id % 8 = {i} then distance end) {r}" for i, r in enumerate(T.RAYS))} from wk group by 1),
ra as (select *, area_id * 1000 minx, area_id * 700 miny, area_id * 1000 + 50000 + area_id % 7 * 9000 maxx, area_id * 700 + 40000 + area_id % 5 * 8000 maxy from pv where {" and ".join(f"{r} is not null" for r in T.RAYS)})"""


@query(f"with {_AREAS} select area_id, {m('minx - greatest(sw_w, nw_w)')} minx, {m('miny - greatest(sw_s, se_s)')} miny, {m('maxx + greatest(se_e, ne_e)')} maxx, {m('maxy + greatest(nw_n, ne_n)')} maxy from ra")
def techum_rect(spark, sf_dir):
    return T.extended(_with_rays(spark, sf_dir)).select("area_id", *[milli(F.col(c)).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query(f"""with {_AREAS}, ring as (select area_id, unnest(range(12)) i,
unnest([minx, maxx, maxx + ne_e, maxx + ne_e, maxx + se_e, maxx + se_e, maxx, minx, minx - sw_w, minx - sw_w, minx - nw_w, minx - nw_w]) x,
unnest([maxy + nw_n, maxy + ne_n, maxy + ne_n, maxy, miny, miny - se_s, miny - se_s, miny - sw_s, miny - sw_s, miny, maxy, maxy + nw_n]) y from ra),
nx as (select a.area_id, a.x, a.y, b.x x2, b.y y2 from ring a join ring b on a.area_id = b.area_id and b.i = (a.i + 1) % 12)
select area_id, cast(floor(-sum(x * y2 - x2 * y) / 2 / 1000000 + 0.5) as bigint) area_m2 from nx group by area_id""")
def techum_diagonal(spark, sf_dir):
    return T.diagonal(_with_rays(spark, sf_dir)).select("area_id", F.floor(-G.ring_area(F.col("ring")) / 1e6 + 0.5).cast("bigint").alias("area_m2"))


@query(f"""with {_AREAS}, bx as (select area_id, (area_id % 7 - 3) * 0.2::double g, minx - greatest(sw_w, nw_w) x0, miny - greatest(sw_s, se_s) y0, maxx + greatest(se_e, ne_e) x1, maxy + greatest(nw_n, ne_n) y1 from ra),
co as (select area_id, g, unnest(range(4)) i, unnest([x0, x1, x1, x0]) x, unnest([y0, y0, y1, y1]) y from bx)
select area_id, i corner, {m('x * cos(g) - y * sin(g)')} x_um, {m('x * sin(g) + y * cos(g)')} y_um from co""")
def boundary_rotated(spark, sf_dir):
    """Corners of the boundaries of rectangles that are turned, in the world's frame."""
    areas = _with_rays(spark, sf_dir).withColumns({"angle": (F.col("area_id") % 7 - 3) * 0.2, "pieces": F.lit(None).cast("array<array<struct<x:double,y:double>>>")})
    sides = {"n": ("nw_n", "ne_n"), "s": ("sw_s", "se_s"), "e": ("se_e", "ne_e"), "w": ("sw_w", "nw_w")}
    areas = areas.withColumns({f"reach_{k}": F.greatest(*v) for k, v in sides.items()})
    got = T.boundary_pieces(areas).select("area_id", F.explode(T.to_world(F.col("boundary"), F.col("angle"))).alias("p"))
    each = got.select("area_id", F.posexplode("p").alias("corner", "q"))
    return each.select("area_id", F.col("corner").cast("bigint").alias("corner"), milli(F.col("q.x")).alias("x_um"), milli(F.col("q.y")).alias("y_um"))


def _side_sql(k: int, edge: str, near: str, far: str, c: str) -> str:
    """One side's row for each area and city; no join with a table of sides, which the engine's dictionaries break on."""
    return f"select ar.area_id, ci.cluster, {k} sd, {1 - 2 * (k % 2)} sg, {edge} edge, {near} near, {far} far, min{c} c0, max{c} c1, s_min{c} s0, s_max{c} s1 from ar join ci using (scenario_id) where not (minx < s_maxx and s_minx < maxx and miny < s_maxy and s_miny < maxy)"


_HAVLAAH = f"""ar as (select scenario_id, cluster as area_id, minx s_minx, miny s_miny, maxx s_maxx, maxy s_maxy from ci),
sw as ({" union all ".join([_side_sql(0, "s_maxy", "miny", "maxy", "x"), _side_sql(1, "s_miny", "maxy", "miny", "x"), _side_sql(2, "s_maxx", "minx", "maxx", "y"), _side_sql(3, "s_minx", "maxx", "minx", "y")])}),
ok as (select *, greatest(0, abs(far - near) - {AMOT4}) delta, edge + sg * {TECHUM} o, greatest(c0, s0 - {TECHUM}) e0, least(c1, s1 + {TECHUM}) e1 from sw where sg * (near - edge) > 0 and c0 < s1 and s0 < c1 and sg * (far - edge) <= {TECHUM}),
pa as (select area_id, cluster, sd, 1 part, c0 lo, c1 hi, least(near, far) d0, greatest(near, far) d1 from ok union all select area_id, cluster, sd, 2, e0, e1, least(o, o + sg * delta), greatest(o, o + sg * delta) from ok)"""


@query(f"""with recursive {SUMMARY}, {_HAVLAAH} select area_id, cluster, cast(sd as bigint) side, part, cast(case when sd < 2 then lo else d0 end as bigint) minx, cast(case when sd < 2 then d0 else lo end as bigint) miny,
cast(case when sd < 2 then hi else d1 end as bigint) maxx, cast(case when sd < 2 then d1 else hi end as bigint) maxy from pa where lo < hi and d0 < d1""")
def havlaah_rects(spark, sf_dir):
    """Around every city, over flat ground."""
    _, cities = _cities(spark, sf_dir)
    areas = cities.select(F.col("cluster").alias("area_id"), "scenario_id", "minx", "miny", "maxx", "maxy", *[F.lit(TECHUM).alias(f"reach_{s}") for s in T.SIDES])
    side = F.array_position(F.array(*map(F.lit, T.SIDES)), F.col("side")) - 1
    return T.swallowed(areas, cities, AMOT4, NOW.mm(S.TECHUM)).withColumn("side", side.cast("bigint"))


# rings, settings, text

_FACING = """vx as (select scenario_id, cluster, x1 x, y1 y from he), ce as (select scenario_id, cluster, avg(x)::double mx, avg(y)::double my, max(y) top from vx group by all),
rg as (select vx.scenario_id, vx.cluster, y >= top - 30000 near, row_number() over (partition by vx.scenario_id, vx.cluster order by atan2(y - my, x - mx)) i from vx join ce using (scenario_id, cluster)),
ch as (select *, near <> coalesce(lag(near) over (partition by scenario_id, cluster order by i), last_value(near) over (partition by scenario_id, cluster order by i rows between unbounded preceding and unbounded following)) turn from rg)"""


@query(f"with recursive {HULLS}, {_FACING} select scenario_id, cluster, greatest(count(*) filter (turn), 1) runs from ch group by all")
def mouth_runs(spark, sf_dir):
    """Runs of equal flag around each hull: the strokes that a ring is drawn in."""
    hull = _hull(spark, sf_dir)
    near = hull.withColumn("near", F.col("y") >= F.max("y").over(Window.partitionBy(*KEYS)) - 30000)
    return R.split_stroke(near, KEYS, "i", "near").groupBy(*KEYS).agg(F.countDistinct("run").alias("runs"))


_NAMES = list(S.FIRST_STAGE)
_CHANGES = "ch as (select cast(o_orderkey % 997 as bigint) change_id, o_custkey % 16 k, o_orderkey % 3 old, o_custkey % 3 new from orders)"


@query(f"with {_CHANGES} select change_id, min(case when old <> new then case k {' '.join(f'when {i} then {S.FIRST_STAGE[n]}' for i, n in enumerate(_NAMES))} end else {S.NEVER} end) stage from ch group by change_id")
def settings_first_stage(spark, sf_dir):
    names = F.array(*map(F.lit, _NAMES))
    rows = X.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 997).cast("bigint").alias("change_id"), F.element_at(names, (F.col("o_custkey") % 16 + 1).cast("int")).alias("setting"), (F.col("o_orderkey") % 3).cast("string").alias("old"), (F.col("o_custkey") % 3).cast("string").alias("new"))
    return S.first_stage_rows(rows)


@query("""with pl as (select c_custkey place_id, replace(c_name, 'Customer', 'Place') || ', ' || n_name || ', Israel' as full_name, c_acctbal from customer join nation on n_nationkey = c_nationkey),
rk as (select n_name q, place_id, replace(full_name, ', Israel', '') display_name, row_number() over (partition by n_name order by c_acctbal desc, place_id) r from nation join pl on contains(lower(full_name), lower(n_name)))
select q, place_id, display_name, r from rk where r <= 5""")
def geocode_top5(spark, sf_dir):
    """For each nation's name as a query: the five places of the highest rank whose name holds it."""
    from cubitgrid.operators.text import geocode

    n = X.table(spark, sf_dir, "nation")
    places = X.table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("place_id"), F.concat(F.replace("c_name", F.lit("Customer"), F.lit("Place")), F.lit(", "), "n_name", F.lit(", Israel")).alias("full_name"), F.col("c_acctbal").alias("rank"))
    return geocode(places, n.select(F.col("n_name").alias("q")), 5).select("q", "place_id", "display_name", F.col("r"))


@query(f"""with {SC}, {PT} select point_id, printf('https://example.org/?lat=%.6f&lon=%.6f', lat0 + floor(y / 1000.0::double) / 100003.0::double, lon0 + floor(x / 1000.0::double) / 100003.0::double) url from pt join sc using (scenario_id)""")
def scenario_url(spark, sf_dir):
    from cubitgrid.operators.text import scenario_url as url

    p = X.points(spark, sf_dir).join(X.scenarios(spark, sf_dir), "scenario_id")
    lat, lon = F.col("lat0") + F.floor(F.col("y") / 1000) / 100003.0, F.col("lon0") + F.floor(F.col("x") / 1000) / 100003.0
    return p.select("point_id", url(lat, lon).alias("url"))


@query(f"with {SC}, {PT} select point_id, printf('https://www.openstreetmap.org/edit#map=%d/%.5f/%.5f', cast(floor(12 + point_id % 40 / 8.0::double + 0.5) as bigint), lat0 + floor(y / 1000.0::double) / 100003.0::double, lon0 + floor(x / 1000.0::double) / 100003.0::double) url from pt join sc using (scenario_id)")
def edit_url(spark, sf_dir):
    from cubitgrid.operators.text import edit_url as url

    p = X.points(spark, sf_dir).join(X.scenarios(spark, sf_dir), "scenario_id")
    lat, lon = F.col("lat0") + F.floor(F.col("y") / 1000) / 100003.0, F.col("lon0") + F.floor(F.col("x") / 1000) / 100003.0
    return p.select("point_id", url(12 + F.col("point_id") % 40 / 8.0, lat, lon).alias("url"))


@query(f"""with recursive {HULLS}, sd as (select scenario_id, cluster, x1, y1, case when abs(y2 - y1) > abs(x2 - x1) then case when y2 > y1 then 'e' else 'w' end else case when x1 > x2 then 'n' else 's' end end side from he)
select scenario_id, cluster, cast(x1 as bigint) x1, cast(y1 as bigint) y1, side from sd""")
def outward_sides(spark, sf_dir):
    """Which side of the world each side of a city's hull faces."""
    edges = R.outward_sides(C.hull_edges(_hull(spark, sf_dir), KEYS), KEYS)
    return edges.select(*KEYS, F.col("x1").cast("bigint").alias("x1"), F.col("y1").cast("bigint").alias("y1"), "side")


_SET = "st as (select cast(o_orderkey as bigint) id, case o_orderkey % 4 when 0 then 'naeh' when 1 then 'moshe' when 2 then 'chazonIsh' else 'custom' end preset, o_custkey % 2 = 0 rema, cast(1000 + o_custkey % 51 * 100 as double) radius from orders)"


def _settings(spark, sf_dir) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, S.PRESET_CM), F.lit("custom"))
    given = {"amahPreset": F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")), "remaExtra": F.col("o_custkey") % 2 == 0, "fetchRadiusM": (1000 + F.col("o_custkey") % 51 * 100).cast("double")}
    rest = {k: F.lit(v) for k, v in NOW.__dict__.items() if k not in given}
    return o.select(F.col("o_orderkey").cast("bigint").alias("id"), *[c.alias(k) for k, c in (given | rest).items()])


@query(f"""with {_SET} select id, 'amahPreset' setting, preset as "value" from st union all select id, 'remaExtra', case when rema then 'Yes' else 'No' end from st
union all select id, 'fetchRadiusM', printf('%.1f km', radius / 1000) from st union all select id, 'customAmahCm', '48.0 cm' from st""")
def settings_report(spark, sf_dir):
    """Four settings of each row as a report shows them."""
    return S.report_rows(_settings(spark, sf_dir), ["id"]).where(F.col("setting").isin("amahPreset", "remaExtra", "fetchRadiusM", "customAmahCm"))


@query(f"with {_SET} select id, preset, rema, radius from st")
def settings_saved(spark, sf_dir):
    """Settings written as JSON and read again."""
    got = S.from_json(S.to_json(_settings(spark, sf_dir), "saved"), "saved")
    return got.select("id", F.col("amahPreset").alias("preset"), F.col("remaExtra").cast("boolean").alias("rema"), F.col("fetchRadiusM").cast("double").alias("radius"))


# whole runs and kernels that SQL can't express


def _run(spark, sf_dir):
    from cubitgrid.plans.run import Run

    homes = X.points(spark, sf_dir)
    # a second point for each first one, whose id no first one has
    eruvs = homes.select("scenario_id", (-1 - F.col("point_id")).alias("point_id"), (F.col("x") + 300_000).alias("x"), (F.col("y") - 200_000).alias("y"), F.col("point_id").alias("home_id"))
    return Run(spark, X.buildings(spark, sf_dir), homes, eruvs, S.Settings())


@query(f"with recursive {SUMMARY}, {_RINGS}, ra as (select scenario_id, root, sum(ax * ey - ay * ex) / 2 area from f0 join rt using (id) join oc using (root) join ci using (cluster) group by all) select scenario_id, cast(floor(area / 100000000 + 0.5) as bigint) ares from ra")
def city_outline_union(spark, sf_dir):
    """Areas of the outer rings of all cities in hundreds of square metres."""
    rings = L.outlines(_cities(spark, sf_dir)[0], GAP / 2).groupBy(*KEYS, "ring").agg(F.max("area").alias("area"))
    return rings.select("scenario_id", F.floor(F.col("area") / 1e8 + 0.5).cast("bigint").alias("ares"))


@query()
def squarings(spark, sf_dir):
    return _run(spark, sf_dir).stage(4)["squarings"]


@query()
def keshet_cut(spark, sf_dir):
    """Bays of all cities with a mouth over 120 amot: 3 % of the rule, for cities of a few hundred metres."""
    from cubitgrid.operators import square as Q

    outlines = L.outlines(_cities(spark, sf_dir)[0], GAP / 2)
    squared = Q.squarings(outlines, _hull(spark, sf_dir), NOW)
    return Q.keshet_cuts(Q.bows(outlines, squared, replace(NOW, keshetExclusion="entire"), scale=0.03))


@query()
def minkowski_notch(spark, sf_dir):
    from cubitgrid.operators import square as Q

    return Q.minkowski_areas(L.outlines(_cities(spark, sf_dir)[0], GAP / 2), 10_000, 10_000, 5_000, 5_000)


@query()
def boundary_run(spark, sf_dir):
    return _run(spark, sf_dir).result()


@query()
def run_diagnostics(spark, sf_dir):
    return _run(spark, sf_dir).diagnostics()
