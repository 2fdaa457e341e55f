"""Spatial inputs derived from the given tables: lengths are whole millimetres in a scenario's local frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scenarios are the 25 nations.
SCENARIOS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, building_id, x0, y0, x1, y1): an axis-aligned footprint for each order."""
    k = F.expr("o_orderkey div 25").alias("k")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("building_id"), (F.col("o_orderkey") % SCENARIOS).cast("bigint").alias("scenario_id"), k)
    rows = rows.selectExpr("*", "k div 12 as t", "(k * 37) % 101 as u", "(k * 53) % 97 as v")
    rows = rows.selectExpr(
        "scenario_id", "building_id", "k",
        "-2400000 + (t * 9176 + scenario_id * 31) % 4801 * 1000 + (u * u) % 101 * (1200 + t % 4 * 700) - 100000 as x0",
        "-2400000 + (t * 6151 + scenario_id * 57) % 4801 * 1000 + (v * v) % 97 * (1300 + t % 5 * 600) - 100000 as y0",
    )
    return rows.selectExpr("scenario_id", "building_id", "cast(x0 as bigint) x0", "cast(y0 as bigint) y0", "cast(x0 + 8000 + (k * 29) % 13 * 1000 as bigint) x1", "cast(y0 + 7000 + (k * 31) % 11 * 1000 as bigint) y1")


#: The same table as a common table expression of the comparing engine.
BUILDINGS_SQL = """
k as (select o_orderkey as id, o_orderkey % 25 as sid, o_orderkey // 25 as k from orders),
s as (select id, sid, k, k // 12 as t, (k * 37) % 101 as u, (k * 53) % 97 as v from k),
p as (select id, sid, k,
  -2400000 + (t * 9176 + sid * 31) % 4801 * 1000 + (u * u) % 101 * (1200 + t % 4 * 700) - 100000 as x0,
  -2400000 + (t * 6151 + sid * 57) % 4801 * 1000 + (v * v) % 97 * (1300 + t % 5 * 600) - 100000 as y0,
  8000 + (k * 29) % 13 * 1000 as w, 7000 + (k * 31) % 11 * 1000 as h from s),
b as (select cast(sid as bigint) scenario_id, cast(id as bigint) building_id, cast(x0 as bigint) x0, cast(y0 as bigint) y0,
  cast(x0 + w as bigint) x1, cast(y0 + h as bigint) y1 from p)"""


#: Corners of shaped footprints from a box's lower left corner: shares of its width and height that add up to x, then to y.
#: Plain, turned by a right-angled triangle of 3, 4 and 5, like an L (whose inner corner isn't on the hull), turned the other
#: way by 5, 12 and 13.
SHAPES = [
    ["0 0 0 0", "1 0 0 0", "1 0 0 1", "0 0 0 1"],
    ["0 0 0 0", "4/5 0 3/5 0", "4/5 -3/5 3/5 4/5", "0 -3/5 0 4/5"],
    ["0 0 0 0", "1 0 0 0", "1 0 0 1/2", "1/2 0 0 1/2 inner", "1/2 0 0 1", "0 0 0 1"],
    ["0 0 0 0", "12/13 0 -5/13 0", "12/13 5/13 -5/13 12/13", "0 5/13 0 12/13"],
]


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, building_id, ring): a shaped footprint for each order, at the corner and with the width and height of its
    box; ids modulo 4 say which shape."""
    share = lambda s: f"named_struct('n', {s.partition('/')[0]}, 'd', {s.partition('/')[2] or 1})"
    shapes = ", ".join(f"array({', '.join(f'array({chr(44).join(share(s) for s in corner.split()[:4])})' for corner in shape)})" for shape in SHAPES)
    part = lambda k, length: f"sign(c[{k}].n) * ({length} * abs(c[{k}].n) div c[{k}].d)"
    axis = lambda o, k: f"cast({o} + {part(k, 'w')} + {part(k + 1, 'h')} as double)"
    ring = f"transform(element_at(array({shapes}), cast(building_id % 4 as int) + 1), c -> struct({axis('x0', 0)} as x, {axis('y0', 2)} as y)) as ring"
    return buildings(spark, sf_dir).selectExpr("*", "x1 - x0 as w", "y1 - y0 as h").selectExpr("scenario_id", "building_id", ring)


def _lists(k: int) -> str:
    term = lambda s, length: f"{'-' if s[0] == '-' else '+'} {length} * {s.lstrip('-').partition('/')[0]} // {s.partition('/')[2] or 1}"
    corner = lambda c: f"{'xy'[k]}0 {term(c[2 * k], 'w')} {term(c[2 * k + 1], 'h')}"
    cases = [f"when {i} then [{', '.join(corner(c.split()) for c in shape if 'inner' not in c)}]" for i, shape in enumerate(SHAPES)]
    return f"unnest(case building_id % 4 {' '.join(cases)} end)"


#: Corners of hulls: the order in which they follow each other is i.
HULLS_SQL = f"""wh as (select *, x1 - x0 w, y1 - y0 h from b),
hc as (select scenario_id, building_id, unnest(case building_id % 4 when 2 then range(5) else range(4) end) i, {_lists(0)} x, {_lists(1)} y from wh),
hb as (select scenario_id, building_id, min(x) x0, min(y) y0, max(x) x1, max(y) y1, count(*) n from hc group by all)"""


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, lat0, lon0, name): a frame's origin for each nation."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("scenario_id"), (F.lit(28.0) + F.col("n_nationkey") * 1.25).alias("lat0"), (F.lit(-60.0) + F.col("n_nationkey") * 7.5).alias("lon0"), F.col("n_name").alias("name"))


SCENARIOS_SQL = "sc as (select cast(n_nationkey as bigint) scenario_id, 28.0::double + n_nationkey * 1.25::double lat0, -60.0::double + n_nationkey * 7.5::double lon0, n_name as name from nation)"


#: Footprint of an order's key in millimetres: its lower left corner.
_CORNER = (
    "-2400000 + ({id} div 25 div 12 * 9176 + {id} % 25 * 31) % 4801 * 1000 + ({id} div 25 * 37 % 101) * ({id} div 25 * 37 % 101) % 101 * (1200 + {id} div 25 div 12 % 4 * 700) - 100000",
    "-2400000 + ({id} div 25 div 12 * 6151 + {id} % 25 * 57) % 4801 * 1000 + ({id} div 25 * 53 % 97) * ({id} div 25 * 53 % 97) % 97 * (1300 + {id} div 25 div 12 % 5 * 600) - 100000",
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, point_id, x, y): a point for each event; those of even numbers are spread over their scenario's square,
    the others lie within 100 m of where the order of the same number has its footprint."""
    near = [f"cast({c.format(id='event_id')} + (event_id * {p}) % 121 * 1000 - 50000 + {d} as bigint)" for c, p, d in zip(_CORNER, (7919, 104729), (137, 211), strict=True)]
    wide = [f"cast(-2400000 + (event_id * {p}) % 4801 * 1000 + {d} as bigint)" for p, d in ((7919, 137), (104729, 211))]
    both = [f"case when event_id % 2 = 0 then {w} else {n} end as {c}" for w, n, c in zip(wide, near, "xy", strict=True)]
    return table(spark, sf_dir, "events").selectExpr("cast(event_id % 25 as bigint) scenario_id", "cast(event_id as bigint) point_id", *both)


_NEAR_X, _NEAR_Y = (c.format(id="event_id").replace(" div ", " // ") for c in _CORNER)
POINTS_SQL = f"""pt as (select cast(event_id % 25 as bigint) scenario_id, cast(event_id as bigint) point_id,
  cast(case when event_id % 2 = 0 then -2400000 + (event_id * 7919) % 4801 * 1000 + 137 else {_NEAR_X} + (event_id * 7919) % 121 * 1000 - 50000 + 137 end as bigint) x,
  cast(case when event_id % 2 = 0 then -2400000 + (event_id * 104729) % 4801 * 1000 + 211 else {_NEAR_Y} + (event_id * 104729) % 121 * 1000 - 50000 + 211 end as bigint) y from events)"""


def extents(spark: SparkSession, sf_dir: str, half_mm: int = 1_500_000) -> DataFrame:
    """(scenario_id, minx, miny, maxx, maxy): the loaded square of each scenario."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("scenario_id"), F.lit(-half_mm).cast("bigint").alias("minx"), F.lit(-half_mm).cast("bigint").alias("miny"), F.lit(half_mm).cast("bigint").alias("maxx"), F.lit(half_mm).cast("bigint").alias("maxy"))


def ray_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ray_id, k, elev): 41 steps of a ray for each customer, in millimetres; some samples and starts are missing."""
    rays = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("ray_id"))
    steps = rays.select("ray_id", F.explode(F.sequence(F.lit(0), F.lit(41))).alias("k"))
    elev = F.expr("200000 + (ray_id * 7919) % 50000 + ((ray_id * 31 + k * k * 17) % 23 - 11) * (ray_id % 9) * 900 - k * (ray_id % 5) * 2500")
    gone = F.expr("(ray_id * 13 + k * 7) % 29 = 0 or (k = 0 and ray_id % 17 = 0)")
    return steps.select("ray_id", F.col("k").cast("bigint").alias("k"), F.when(~gone, elev).cast("bigint").alias("elev"))


RAY_SQL = """rs as (select cast(c_custkey as bigint) ray_id, cast(k as bigint) k,
  case when not ((c_custkey * 13 + k * 7) % 29 = 0 or (k = 0 and c_custkey % 17 = 0)) then cast(200000 + (c_custkey * 7919) % 50000
  + ((c_custkey * 31 + k * k * 17) % 23 - 11) * (c_custkey % 9) * 900 - k * (c_custkey % 5) * 2500 as bigint) end elev
  from customer, range(42) r(k))"""
