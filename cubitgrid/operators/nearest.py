"""Shortest lines between sets of things that lie any distance apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubitgrid.functions import geometry as G
from cubitgrid.plans.tables import Tables

#: Width of the finest cells, how many of them make one of the next size, and how often.
FINEST_MM, RATIO, LEVELS = 64_000, 4, 6
BOX = ("x0", "y0", "x1", "y1")


def _square(x: Column, y: Column) -> Column:
    return x * x + y * y


def facing(pairs: DataFrame, items: DataFrame, finest: int = FINEST_MM, levels: int = LEVELS) -> DataFrame:
    """Items of a and of c (columns a_*, b_*) that can be nearest to each other, for each pair (scenario_id, a, c).

    items: (scenario_id, cluster, x0, y0, x1, y1 and more columns). Items are boxed by cells, cells by larger cells. From
    the largest down, a pair of cells whose boxes are farther apart than two other boxes of the same pair can be at most
    is left out; what is left is looked at in cells a quarter as wide. So a pair costs what faces each other, and no task
    takes a whole set. Every nearest pair of items is among the rows.
    """
    tables = Tables(items.sparkSession, "nearest")
    keys = ["scenario_id", "cluster"]
    named = pairs.select("scenario_id", F.col("a").alias("cluster")).union(pairs.select("scenario_id", "c")).distinct()
    at = lambda c, size: F.floor(F.col(c) / size).cast("bigint")
    placed = tables.cut(items.join(named, keys, "left_semi").withColumns({"cx": at("x0", finest), "cy": at("y0", finest)}))
    ends = [f(n).cast("bigint").alias(n) for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    cells = [tables.cut(placed.groupBy(*keys, "cx", "cy").agg(*ends))]
    for _ in range(levels - 1):
        up = cells[-1].withColumns({"cx": at("cx", RATIO), "cy": at("cy", RATIO)})
        cells.append(tables.cut(up.groupBy(*keys, "cx", "cy").agg(*ends)))

    def of(rows: DataFrame, city: str, p: str, more: dict[str, Column] | None = None) -> DataFrame:
        got = rows.withColumns(more or {})
        return got.select("scenario_id", F.col("cluster").alias(city), *[F.col(c).alias(f"{p}_{c}") for c in got.columns if c not in keys])

    def pruned(met: DataFrame) -> DataFrame:
        near, far = ({k: f(F.col(f"a_{k}0"), F.col(f"a_{k}1"), F.col(f"b_{k}0"), F.col(f"b_{k}1")) for k in "xy"} for f in (G.span_gap, lambda lo, hi, lo2, hi2: F.greatest(hi2 - lo, hi - lo2)))
        met = met.withColumns({"near": _square(near["x"], near["y"]), "far": _square(far["x"], far["y"])})
        most = met.groupBy("scenario_id", "a", "c").agg(F.min("far").alias("most"))
        kept = met.join(most, ["scenario_id", "a", "c"]).where("near <= most")
        return kept.select("scenario_id", "a", "c", "a_cx", "a_cy", "b_cx", "b_cy")

    top = cells.pop()
    found = tables.cut(pruned(pairs.select("scenario_id", "a", "c").join(of(top, "a", "a"), ["scenario_id", "a"]).join(of(top, "c", "b"), ["scenario_id", "c"])))
    while cells:
        level = cells.pop()
        up = {"px": at("cx", RATIO), "py": at("cy", RATIO)}
        old = found.withColumnsRenamed({f"{p}_c{k}": f"{p}_p{k}" for p in "ab" for k in "xy"})
        new = tables.cut(pruned(old.join(of(level, "a", "a", up), ["scenario_id", "a", "a_px", "a_py"]).join(of(level, "c", "b", up), ["scenario_id", "c", "b_px", "b_py"])))
        tables.drop(found, level)
        found = new
    return found.join(of(placed, "a", "a"), ["scenario_id", "a", "a_cx", "a_cy"]).join(of(placed, "c", "b"), ["scenario_id", "c", "b_cx", "b_cy"]).drop("a_cx", "a_cy", "b_cx", "b_cy")


def boxed(side: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Sides (scenario_id, cluster, ax, ay, bx, by and the columns `more`) with their boxes, in whole millimetres."""
    ends = {f"{k}{e}": r(f(f"a{k}", f"b{k}")).cast("bigint") for k in "xy" for e, f, r in ((0, F.least, F.floor), (1, F.greatest, F.ceil))}
    return side.select("scenario_id", "cluster", *more, "ax", "ay", "bx", "by", *[c.alias(n) for n, c in ends.items()])


def ring_lines(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """(scenario_id, a, c, far, px, py, qx, qy): the shortest line between the rings of each pair (scenario_id, a, c), from
    p on a's to q on c's; 0 where they meet.

    side: the rings' sides (scenario_id, cluster, ax, ay, bx, by), those of holes too. Of equal lines the one that starts
    farthest west, then south. A pair with a cluster that has no side is left out.
    """
    met = facing(pairs, boxed(side))
    a, b, c, d = (tuple(F.col(f"{p}_{e}{k}") for k in "xy") for p in "ab" for e in "ab")

    def foot(p: tuple, s: tuple, e: tuple, from_a: bool) -> Column:
        """The line from a corner p to the side s-e."""
        dx, dy = e[0] - s[0], e[1] - s[1]
        t = F.coalesce(F.least(F.greatest(((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / F.nullif(_square(dx, dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        q = (s[0] + t * dx, s[1] + t * dy)
        return line(p, q) if from_a else line(q, p)

    def line(p: tuple, q: tuple) -> Column:
        return F.struct(F.hypot(q[0] - p[0], q[1] - p[1]).alias("far"), p[0].cast("double").alias("px"), p[1].cast("double").alias("py"), q[0].cast("double").alias("qx"), q[1].cast("double").alias("qy"))

    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    s, e = cross(c, d, a), cross(c, d, b)
    crossing = (s * e < 0) & (cross(a, b, c) * cross(a, b, d) < 0)
    t = s / F.nullif(s - e, F.lit(0.0))
    at = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    least = F.least(foot(a, c, d, True), foot(b, c, d, True), foot(c, a, b, False), foot(d, a, b, False))
    best = F.when(crossing, line(at, at)).otherwise(least)
    return met.groupBy("scenario_id", "a", "c").agg(F.min(best).alias("m")).select("scenario_id", "a", "c", "m.*")
