"""Overlay of two sets of rings: areas of what both cover, of what one has alone, and of both together.

No task holds a ring: sides are cut where they meet the other set's sides in shared cells, a part is kept or left out by
whether the ground at its middle belongs to the other set, and areas are sums over parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubitgrid.operators.cluster import cell_pairs
from cubitgrid.operators.nearest import boxed
from cubitgrid.operators.points import against_outlines
from cubitgrid.plans.tables import Tables

CELL_MM = 64_000


def parts_of(own: DataFrame, other: DataFrame, tables: Tables, more: Sequence[str] = ()) -> DataFrame:
    """(scenario_id, cluster, ax, ay, bx, by, place): own sides in parts that meet no side of `other` but at their ends, with
    the columns `more` of the sides.

    place: `inside` or `outside` the other's rings, or along one of their sides, `same` way or `against`.
    """
    rows = boxed(own, more).withColumn("id", F.monotonically_increasing_id())
    rows = tables.cut(rows)
    met = cell_pairs(rows, boxed(other), CELL_MM, 0, same="cluster").where("a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    p, q, r, s = (tuple(F.col(f"{w}_{e}{k}").cast("double") for k in "xy") for w in "ab" for e in "ab")
    d, e = (q[0] - p[0], q[1] - p[1]), (s[0] - r[0], s[1] - r[1])
    cross = lambda a, b: a[0] * b[1] - a[1] * b[0]
    w = (r[0] - p[0], r[1] - p[1])
    turn = cross(d, e)
    t, u = cross(w, e) / F.nullif(turn, F.lit(0.0)), cross(w, d) / F.nullif(turn, F.lit(0.0))
    # rings have whole corners, so sides that run along one another do so exactly
    along = (turn == 0) & (cross(w, d) == 0)
    length = d[0] * d[0] + d[1] * d[1]
    place = lambda c: ((c[0] - p[0]) * d[0] + (c[1] - p[1]) * d[1]) / length
    lo, hi = F.greatest(F.least(place(r), place(s)), F.lit(0.0)), F.least(F.greatest(place(r), place(s)), F.lit(1.0))
    run = F.when(along & (lo < hi), F.struct(lo.alias("lo"), hi.alias("hi"), (d[0] * e[0] + d[1] * e[1] > 0).alias("same")))
    slack = 1e-12
    cut = F.when((turn != 0) & u.between(-slack, 1 + slack) & (t > 0) & (t < 1), t)
    found = met.select(F.col("a_id").alias("id"), run.alias("run"), cut.alias("cut"))
    sums = found.groupBy("id").agg(F.collect_list("run").alias("runs"), F.collect_list("cut").alias("cuts"))
    places = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.col("cuts"), F.col("runs.lo"), F.col("runs.hi"))))
    none = F.array().cast(sums.schema["runs"].dataType), F.array().cast("array<double>")
    each = rows.join(sums, "id", "left").withColumns({"runs": F.coalesce("runs", none[0]), "cuts": F.coalesce("cuts", none[1])}).withColumn("places", places)
    spans = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places") - 1), lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))
    each = each.select("scenario_id", "cluster", *more, "ax", "ay", "bx", "by", "runs", F.explode(spans).alias("s"))
    middle = (F.col("s.t0") + F.col("s.t1")) / 2
    way = F.get(F.filter("runs", lambda r: (r["lo"] <= middle) & (r["hi"] >= middle)), F.lit(0))["same"]
    at = lambda k, t: F.col(f"a{k}") + t * (F.col(f"b{k}") - F.col(f"a{k}"))
    ends = [at(k, F.col(f"s.t{e}")).alias(f"{n}{k}") for n, e in (("a", 0), ("b", 1)) for k in "xy"]
    each = each.select("scenario_id", "cluster", *more, *ends, at("x", middle).alias("x"), at("y", middle).alias("y"), way.alias("same"))
    each = tables.cut(each.withColumn("point_id", F.monotonically_increasing_id()))
    tables.drop(rows)
    ring = other.select("scenario_id", "cluster", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("x2"), F.col("by").alias("y2"))
    ask = each.where("same is null").select("scenario_id", "cluster", "point_id", "x", "y")
    held = against_outlines(ask, ring, 1.0).select("point_id", "inside")
    told = F.when(F.col("same"), "same").when(~F.col("same"), "against").when(F.coalesce("inside", F.lit(False)), "inside").otherwise("outside")
    return each.join(held, "point_id", "left").select("scenario_id", "cluster", *more, "ax", "ay", "bx", "by", told.alias("place"))


def areas(one: DataFrame, two: DataFrame) -> DataFrame:
    """(scenario_id, cluster, area_one, area_two, both, one_alone, two_alone, either), for clusters that either set has.

    one, two: sides (scenario_id, cluster, ax, ay, bx, by) of rings with whole corners, ground on their left, so holes run
    clockwise; the rings of a set don't cross each other. A set without a ring covers nothing.
    """
    tables = Tables(one.sparkSession, "overlay")
    own = tables.cut(parts_of(one, two, tables).withColumn("set", F.lit(1)).unionByName(parts_of(two, one, tables).withColumn("set", F.lit(2))))
    under = (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2

    def total(*cases: tuple[int, str, int]) -> Column:
        """Sum over the parts of a set in a place, with a sign."""
        value = F.lit(0.0)
        for which, place, sign in cases:
            value = F.when((F.col("set") == which) & (F.col("place") == place), under * sign).otherwise(value)
        return F.sum(value)

    whole = lambda k: total(*[(k, place, 1) for place in ("inside", "outside", "same", "against")])
    both = total((1, "inside", 1), (1, "same", 1), (2, "inside", 1))
    alone = lambda k, o: total((k, "outside", 1), (k, "against", 1), (o, "inside", -1))
    got = own.groupBy("scenario_id", "cluster").agg(whole(1).alias("area_one"), whole(2).alias("area_two"), both.alias("both"), alone(1, 2).alias("one_alone"), alone(2, 1).alias("two_alone"))
    return got.withColumn("either", F.col("both") + F.col("one_alone") + F.col("two_alone"))
