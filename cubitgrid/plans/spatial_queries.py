"""Registered queries on scans, frames, clustering and city shapes, each with its equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubitgrid.functions import geometry as G
from cubitgrid.operators import cluster as C
from cubitgrid.plans import settings as S
from cubitgrid.sources import fixtures as X

GAP = S.Settings().mm(S.CITY_GAP)
HALF = 1_500_000
STRIP = 1_500_000
COS, SIN = G.COS_OCTAGON, G.SIN_OCTAGON

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def milli(c: Column) -> Column:
    """Thousandths as a whole number, halves up: the same in both engines."""
    return F.floor(c * 1000 + 0.5).cast("bigint")


def m(sql: str) -> str:
    return f"cast(floor(({sql}) * 1000 + 0.5) as bigint)"


B, SC, PT = X.BUILDINGS_SQL, X.SCENARIOS_SQL, X.POINTS_SQL
NEAR = f"greatest(dx * {COS!r}::double + dy * {SIN!r}::double, dx * {SIN!r}::double + dy * {COS!r}::double) <= {GAP}"
PAIRS = f"""pr as (select scenario_id, a, b from (select a.scenario_id, a.building_id a, b.building_id b,
  greatest(0, b.x0 - a.x1, a.x0 - b.x1) dx, greatest(0, b.y0 - a.y1, a.y0 - b.y1) dy from b a join b b on a.scenario_id = b.scenario_id
  and a.building_id < b.building_id and b.x0 <= a.x1 + 40000 and a.x0 <= b.x1 + 40000 and b.y0 <= a.y1 + 40000 and a.y0 <= b.y1 + 40000) where {NEAR})"""
CLUSTERS = f"""{B}, {PAIRS}, e2 as (select a, b from pr union all select b, a from pr),
reach(id, root) as (select building_id, building_id from b union select e2.b, reach.root from reach join e2 on e2.a = reach.id),
c as (select b.*, r.root as cluster from b join (select id, min(root) root from reach group by id) r on r.id = b.building_id)"""
SUMMARY = f"""{CLUSTERS}, su as (select scenario_id, cluster, count(*) building_count, min(x0) minx, min(y0) miny, max(x1) maxx, max(y1) maxy,
  count(*) >= 6 is_city from c group by scenario_id, cluster),
ci as (select *, row_number() over (partition by scenario_id order by cluster) number from su where is_city)"""
HULLS = f"""{SUMMARY}, co as (select distinct c.scenario_id, c.cluster, x, y from c join ci using (scenario_id, cluster),
  lateral (select unnest([x0, x1, x1, x0]) x, unnest([y0, y0, y1, y1]) y)),
ex as (select scenario_id, cluster, y, min(x) lo, max(x) hi from co group by all),
cp as (select distinct scenario_id, cluster, unnest([lo, hi]) x, y from ex),
ab as (select a.scenario_id, a.cluster, a.x x1, a.y y1, b.x x2, b.y y2 from cp a join cp b on a.scenario_id = b.scenario_id and a.cluster = b.cluster and (a.x <> b.x or a.y <> b.y)),
he as (select ab.scenario_id, ab.cluster, x1, y1, x2, y2 from ab join cp p on p.scenario_id = ab.scenario_id and p.cluster = ab.cluster
  group by ab.scenario_id, ab.cluster, x1, y1, x2, y2
  having bool_and((x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) > 0
    or ((x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) = 0 and p.x between least(x1, x2) and greatest(x1, x2) and p.y between least(y1, y2) and greatest(y1, y2))))"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clusters(X.buildings(spark, sf_dir), GAP)


def _cities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Buildings of cities with their cluster, and the cities with their numbers."""
    clustered = _clustered(spark, sf_dir)
    cities = C.city_numbers(C.summary(clustered).where("is_city"))
    return clustered.join(cities.select("scenario_id", "cluster", "number"), ["scenario_id", "cluster"]), cities


KEYS = ["scenario_id", "cluster"]


def _hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    buildings, _ = _cities(spark, sf_dir)
    return C.hulls(C.corners(buildings, *KEYS), KEYS)


# frames


@query(f"""with {SC}, {PT}, q as (select point_id, lat0, lon0, lat0 + ((point_id * 7919) % 4801 - 2400) * 0.00001::double lat, lon0 + ((point_id * 104729) % 4801 - 2400) * 0.00001::double lon from pt join sc using (scenario_id))
select point_id, {m("(lon - lon0) * 111320.0::double * cos(radians(lat0))")} x_mm, {m("(lat - lat0) * 111320.0::double")} y_mm from q""")
def frame_project(spark, sf_dir):
    p = X.points(spark, sf_dir).join(X.scenarios(spark, sf_dir), "scenario_id")
    lat, lon = F.col("lat0") + ((F.col("point_id") * 7919) % 4801 - 2400) * 0.00001, F.col("lon0") + ((F.col("point_id") * 104729) % 4801 - 2400) * 0.00001
    x, y = G.to_local(lat, lon, F.col("lat0"), F.col("lon0"))
    return p.select("point_id", milli(x).alias("x_mm"), milli(y).alias("y_mm"))


@query(f"with {PT} select point_id, x as x_mm, y as y_mm from pt")
def frame_roundtrip(spark, sf_dir):
    p = X.points(spark, sf_dir).join(X.scenarios(spark, sf_dir), "scenario_id")
    lat, lon = G.from_local(F.col("x") / 1000, F.col("y") / 1000, F.col("lat0"), F.col("lon0"))
    x, y = G.to_local(lat, lon, F.col("lat0"), F.col("lon0"))
    return p.select("point_id", milli(x).alias("x_mm"), milli(y).alias("y_mm"))


@query(f"""with {SC}, {PT}, q as (select point_id, radians(lat0 + y / 1000.0::double / 111320.0::double) lat, lon0 + x / 1000.0::double / (111320.0::double * cos(radians(lat0))) lon from pt join sc using (scenario_id)),
t as (select point_id, (lon + 180) / 360 * 8192 fx, (1 - ln(tan(lat) + 1 / cos(lat)) / pi()) / 2 * 8192 fy from q)
select point_id, cast(floor(fx) as int) tile_x, cast(floor(fy) as int) tile_y, cast(least(floor((fx - floor(fx)) * 256), 255) as int) px, cast(least(floor((fy - floor(fy)) * 256), 255) as int) py from t""")
def slippy_tile(spark, sf_dir):
    p = X.points(spark, sf_dir).join(X.scenarios(spark, sf_dir), "scenario_id")
    lat, lon = G.from_local(F.col("x") / 1000, F.col("y") / 1000, F.col("lat0"), F.col("lon0"))
    tx, ty, px, py = G.tile(lat, lon)
    return p.select("point_id", tx.alias("tile_x"), ty.alias("tile_y"), px.alias("px"), py.alias("py"))


@query(f"""with {SC}, {PT}, q as (select point_id, radians(lat0) a, radians(lat0 + y / 1000.0::double / 111320.0::double) b, radians(x / 1000.0::double / (111320.0::double * cos(radians(lat0)))) dl from pt join sc using (scenario_id)),
d as (select point_id, 2 * 6371000.0::double * asin(sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(dl / 2), 2))) d from q)
select point_id, cast(floor(d * 100 + 0.5) as bigint) cm, cast(floor(d / 0.48::double + 0.5) as bigint) amot from d""")
def haversine_measure(spark, sf_dir):
    p = X.points(spark, sf_dir).join(X.scenarios(spark, sf_dir), "scenario_id")
    lat, lon = G.from_local(F.col("x") / 1000, F.col("y") / 1000, F.col("lat0"), F.col("lon0"))
    d = p.select("point_id", G.haversine_m(F.col("lat0"), F.col("lon0"), lat, lon).alias("d"))
    return d.select("point_id", F.floor(F.col("d") * 100 + 0.5).cast("bigint").alias("cm"), F.floor(F.col("d") / S.Settings().amah_m + 0.5).cast("bigint").alias("amot"))


# scans


@query(f"with {B} select scenario_id, building_id from b where x1 >= -{HALF} and x0 <= {HALF} and y1 >= -{HALF} and y0 <= {HALF}")
def bbox_scan(spark, sf_dir):
    from cubitgrid.operators.scan import scan

    return scan(X.buildings(spark, sf_dir), X.extents(spark, sf_dir, HALF), prune=True).select("scenario_id", "building_id")


@query(f"with {B} select scenario_id, building_id from b where x1 >= -{HALF} and x0 <= {HALF} and y1 >= -{HALF} and y0 <= {HALF}")
def morton_range_scan(spark, sf_dir):
    """The same rows from a stored layout, by ranges of its codes."""
    from cubitgrid.operators.scan import scan_layout, write_layout
    from cubitgrid.plans.tables import Tables

    path = f"{Tables(spark, 'layout').base}/footprints"
    write_layout(X.buildings(spark, sf_dir), path)
    return scan_layout(spark, path, X.extents(spark, sf_dir, HALF)).select("scenario_id", "building_id")


@query(f"""with {B} select scenario_id, building_id from b where x1 >= -{HALF} and x0 <= {HALF} and y1 >= -{HALF} and y0 <= {HALF + STRIP}
union select scenario_id, building_id from b where x1 >= {HALF} and x0 <= {HALF + STRIP} and y1 >= -{HALF} and y0 <= {HALF + STRIP}""")
def strip_dedupe(spark, sf_dir):
    """The loaded square extended by a strip to the north, then by one to the east as high as the result."""
    from cubitgrid.operators.scan import extend

    e = X.extents(spark, sf_dir, HALF)
    return extend(X.buildings(spark, sf_dir), e, ["n", "e"], STRIP)[0].select("scenario_id", "building_id")


@query(f"""with {B} select scenario_id, cx, cy, count(*) n from (select scenario_id, unnest(range(cast(floor((x0 - {GAP / 2}) / {GAP}) as bigint), cast(floor((x1 + {GAP / 2}) / {GAP}) as bigint) + 1)) cx, y0, y1 from b),
lateral (select unnest(range(cast(floor((y0 - {GAP / 2}) / {GAP}) as bigint), cast(floor((y1 + {GAP / 2}) / {GAP}) as bigint) + 1)) cy) group by all""")
def grid_cells(spark, sf_dir):
    return C.with_cells(X.buildings(spark, sf_dir), GAP, GAP / 2).groupBy("scenario_id", "cx", "cy").agg(F.count("*").alias("n"))




@query(f"""with {B}, n0 as (select building_id, cast(floor((x0 + x1 + 6000000)::double / 12000000 * 65535) as bigint) x, cast(floor((y0 + y1 + 6000000)::double / 12000000 * 65535) as bigint) y from b),
n1 as (select building_id, (x | (x << 8)) & {0x00FF00FF} x, (y | (y << 8)) & {0x00FF00FF} y from n0), n2 as (select building_id, (x | (x << 4)) & {0x0F0F0F0F} x, (y | (y << 4)) & {0x0F0F0F0F} y from n1),
n3 as (select building_id, (x | (x << 2)) & {0x33333333} x, (y | (y << 2)) & {0x33333333} y from n2), n4 as (select building_id, (x | (x << 1)) & {0x55555555} x, (y | (y << 1)) & {0x55555555} y from n3)
select building_id, x | (y << 1) code from n4""")
def morton_order(spark, sf_dir):
    lo, hi = F.lit(-6_000_000), F.lit(6_000_000)
    code = G.morton(F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1"), lo, lo, hi, hi)
    return X.buildings(spark, sf_dir).select("building_id", code.alias("code"))


# clustering


@query(f"with {B}, {PAIRS} select scenario_id, a, b from pr")
def pair_gap_join(spark, sf_dir):
    return C.linked_pairs(X.buildings(spark, sf_dir), GAP).select("scenario_id", "a", "b")


@query(f"with recursive {CLUSTERS} select scenario_id, building_id, cluster from c")
def city_components(spark, sf_dir):
    return _clustered(spark, sf_dir).select("scenario_id", "building_id", "cluster")


#: Pairs of shaped footprints: no normal of a side of either hull, and none of the octagon's, separates them once both are grown.
HULL_PAIRS = f"""{B}, {X.HULLS_SQL},
hs as (select p.building_id, (q.y - p.y)::double nx, (p.x - q.x)::double ny from hc p join hb using (building_id) join hc q on q.building_id = p.building_id and q.i = (p.i + 1) % n),
cd as (select a.scenario_id, a.building_id a, b.building_id b from hb a join hb b on a.scenario_id = b.scenario_id and a.building_id < b.building_id and b.x0 <= a.x1 + 40000 and a.x0 <= b.x1 + 40000 and b.y0 <= a.y1 + 40000 and a.y0 <= b.y1 + 40000),
xs as (select a, b, nx, ny from cd join hs on hs.building_id = a union all select a, b, nx, ny from cd join hs on hs.building_id = b
  union all select a, b, nx, ny from cd, (values ({COS!r}::double, {SIN!r}::double), ({SIN!r}::double, {COS!r}::double), ({COS!r}::double, -{SIN!r}::double), ({SIN!r}::double, -{COS!r}::double)) o(nx, ny)),
nm as (select row_number() over () n, * from xs),
p1 as (select n, min(x * nx + y * ny) lo, max(x * nx + y * ny) hi from nm join hc on building_id = a group by n),
p2 as (select n, min(x * nx + y * ny) lo, max(x * nx + y * ny) hi from nm join hc on building_id = b group by n),
ap as (select distinct a, b from nm join p1 using (n) join p2 using (n) where greatest(p2.lo - p1.hi, p1.lo - p2.hi) > greatest(abs(nx), abs(ny), (abs(nx) + abs(ny)) * {0.5**0.5!r}::double) * {GAP / COS!r}::double),
hp as (select cd.* from cd anti join ap on ap.a = cd.a and ap.b = cd.b)"""
HULL_CLUSTERS = f"""{HULL_PAIRS}, h2 as (select a, b from hp union all select b, a from hp),
hr(id, root) as (select building_id, building_id from b union select h2.b, hr.root from hr join h2 on h2.a = hr.id)"""


@query(f"with {HULL_PAIRS} select scenario_id, a, b from hp")
def hull_pairs(spark, sf_dir):
    """Turned and L-shaped footprints within the gap, by their convex hulls."""
    return C.linked_pairs(C.with_hulls(X.footprints(spark, sf_dir)), GAP).select("scenario_id", "a", "b")


@query(f"with recursive {HULL_CLUSTERS} select scenario_id, building_id, cluster from b join (select id, min(root) as cluster from hr group by id) on id = building_id")
def hull_components(spark, sf_dir):
    """Clusters of turned and L-shaped footprints."""
    return C.clusters(C.with_hulls(X.footprints(spark, sf_dir)), GAP).select("scenario_id", "building_id", "cluster")


@query(f"with recursive {SUMMARY} select scenario_id, cluster, building_count, is_city, minx, miny, maxx, maxy from su")
def city_summary(spark, sf_dir):
    return C.summary(_clustered(spark, sf_dir))


@query(f"with recursive {SUMMARY} select scenario_id, cluster, maxy > {HALF - 150000} n, maxx > {HALF - 150000} e, miny < {-HALF + 150000} s, minx < {-HALF + 150000} w from su")
def data_edges(spark, sf_dir):
    return C.data_edges(C.summary(_clustered(spark, sf_dir)), X.extents(spark, sf_dir, HALF))


# shapes of cities


@query(f"with recursive {HULLS} select scenario_id, cluster, x1, y1, x2, y2 from he")
def hull_edges(spark, sf_dir):
    e = C.hull_edges(_hull(spark, sf_dir), KEYS)
    return e.select(*KEYS, *[F.col(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"with recursive {HULLS} select scenario_id, cluster, cast(sum(x1 * y2 - x2 * y1) as bigint) twice_area, count(*) sides from he group by all")
def ring_area(spark, sf_dir):
    e = C.hull_edges(_hull(spark, sf_dir), KEYS)
    return e.groupBy(*KEYS).agg(F.sum(F.col("x1").cast("bigint") * F.col("y2").cast("bigint") - F.col("x2").cast("bigint") * F.col("y1").cast("bigint")).alias("twice_area"), F.count("*").alias("sides"))


_RECT = """tu as (select a.scenario_id, a.cluster, a.x1, a.y1, a.x2, a.y2, p.x1 * cos(g) - p.y1 * sin(g) u, p.x1 * sin(g) + p.y1 * cos(g) v from (select *, -atan2(y2 - y1, x2 - x1) g from he) a join he p using (scenario_id, cluster)),
sd as (select scenario_id, cluster, x1, y1, x2, y2, (max(u) - min(u)) * (max(v) - min(v)) area from tu group by all), mr as (select scenario_id, cluster, min(area) area from sd group by all),
ar as (select scenario_id, cluster, sum(x1 * y2 - x2 * y1)::double / 2 hull_area from he group by all)"""


@query(f"with recursive {HULLS}, {_RECT} select scenario_id, cluster, cast(floor(area / 1000000 + 0.5) as bigint) area_m2 from mr")
def min_area_rect(spark, sf_dir):
    return C.min_area_rectangles(_hull(spark, sf_dir), KEYS).select(*KEYS, F.floor(F.col("area") / 1e6 + 0.5).cast("bigint").alias("area_m2"))


@query(f"with recursive {HULLS}, {_RECT} select scenario_id, cluster, hull_area / area >= 0.8 oblong from mr join ar using (scenario_id, cluster)")
def oblong_flag(spark, sf_dir):
    """Hull against its smallest rectangle, at a share of 0.8 that random cities reach now and then."""
    hull = _hull(spark, sf_dir)
    own = C.hull_edges(hull, KEYS).groupBy(*KEYS).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("hull_area"))
    return C.min_area_rectangles(hull, KEYS).join(own, KEYS).select(*KEYS, (F.col("hull_area") / F.col("area") >= 0.8).alias("oblong"))


@query(f"""with recursive {HULLS}, t as (select scenario_id, cluster, x * cos(0.3::double) - y * sin(0.3::double) u, x * sin(0.3::double) + y * cos(0.3::double) v from co)
select scenario_id, cluster, {m("min(u)")} u0, {m("max(u)")} u1, {m("min(v)")} v0, {m("max(v)")} v1 from t group by all""")
def bounding_rotated(spark, sf_dir):
    buildings, _ = _cities(spark, sf_dir)
    u, v = G.rotate(F.col("x"), F.col("y"), F.lit(0.3))
    t = C.corners(buildings, *KEYS).select(*KEYS, u.alias("u"), v.alias("v"))
    return t.groupBy(*KEYS).agg(milli(F.min("u")).alias("u0"), milli(F.max("u")).alias("u1"), milli(F.min("v")).alias("v0"), milli(F.max("v")).alias("v1"))


@query(f"""with recursive {HULLS}, sums as (select scenario_id, cluster, count(*) n, sum(x) sx, sum(y) sy, sum(x::hugeint * x) xx, sum(y::hugeint * y) yy, sum(x::hugeint * y) xy from co group by all)
select scenario_id, cluster, {m("degrees(0.5 * atan2(2 * (n * xy - sx * sy)::double, ((n * xx - sx * sx) - (n * yy - sy * sy))::double))")} angle_millideg from sums""")
def fit_angle(spark, sf_dir):
    """Principal axis of the distinct corners; sums are exact decimals, so no order of rows can change it."""
    buildings, _ = _cities(spark, sf_dir)
    big = lambda e: F.sum(e.cast("decimal(20,0)"))
    x, y = F.col("x"), F.col("y")
    s = C.corners(buildings, *KEYS).distinct().groupBy(*KEYS).agg(F.count("*").cast("decimal(10,0)").alias("n"), big(x).alias("sx"), big(y).alias("sy"), big(x * x).alias("xx"), big(y * y).alias("yy"), big(x * y).alias("xy"))
    up = lambda c: c.cast("decimal(28,0)")
    d = lambda n, p, q, r: (n * up(p)).cast("decimal(38,0)") - (q.cast("decimal(18,0)") * r.cast("decimal(18,0)")).cast("decimal(38,0)")
    n = F.col("n")
    xy, xx, yy = d(n, F.col("xy"), F.col("sx"), F.col("sy")), d(n, F.col("xx"), F.col("sx"), F.col("sx")), d(n, F.col("yy"), F.col("sy"), F.col("sy"))
    return s.select(*KEYS, milli(F.degrees(0.5 * F.atan2(2 * xy.cast("double"), (xx - yy).cast("double")))).alias("angle_millideg"))


_RING = """vx as (select scenario_id, cluster, x1 x, y1 y from he), ce as (select scenario_id, cluster, avg(x)::double mx, avg(y)::double my, max(y) top, min(x) lo, max(x) hi, count(*) n from vx group by all),
rg as (select vx.scenario_id, vx.cluster, x, y, y >= top - 20000 near, n, row_number() over (partition by vx.scenario_id, vx.cluster order by atan2(y - my, x - mx)) i from vx join ce using (scenario_id, cluster)),
st as (select *, near and not coalesce(lag(near) over w, last_value(near) over (w rows between unbounded preceding and unbounded following)) starts from rg window w as (partition by scenario_id, cluster order by i))"""


@query(f"with recursive {HULLS}, {_RING} select scenario_id, cluster, count(*) filter (near) points, case when bool_and(near) then 1 else count(*) filter (starts) end runs from st group by scenario_id, cluster")
def straight_side_runs(spark, sf_dir):
    """Circular runs of hull corners that lie within 20 m of a city's northern side."""
    from cubitgrid.operators.rings import circular_runs

    hull = _hull(spark, sf_dir)
    near = hull.withColumn("near", F.col("y") >= F.max("y").over(Window.partitionBy(*KEYS)) - 20000)
    return circular_runs(near, KEYS, "i", "near").select(*KEYS, "points", "runs")


@query(f"""with recursive {HULLS}, mid as (select scenario_id, cluster, floor((max(y1) + min(y1)) / 2) + 0.5::double d from he group by all),
cr as (select scenario_id, cluster, x1 + (d - y1) * (x2 - x1)::double / (y2 - y1) x from he join mid using (scenario_id, cluster) where (y1 > d) <> (y2 > d)),
o as (select *, row_number() over (partition by scenario_id, cluster order by x) r from cr)
select scenario_id, cluster, {m("sum(case when r % 2 = 0 then x else -x end)")} width_um from o group by all""")
def cross_section_width(spark, sf_dir):
    from cubitgrid.operators.rings import cross_section

    edges = C.hull_edges(_hull(spark, sf_dir), KEYS)
    mid = edges.groupBy(*KEYS).agg((F.floor((F.max("y1") + F.min("y1")) / 2) + 0.5).alias("d"))
    return cross_section(edges, mid, KEYS).select(*KEYS, milli(F.col("width")).alias("width_um"))
