"""Ordered operations on rings: circular runs and cross sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def circular_runs(ring: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, points, runs): how many points are flagged, and in how many runs around the ring.

    A run starts where the point before isn't flagged; the last point comes before the first. A ring that is
    flagged all round is one run.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(flag).over(w), F.last(flag).over(whole))
    marked = ring.withColumn("starts_", F.col(flag) & ~before)
    each = marked.groupBy(*keys).agg(F.count_if(flag).alias("points"), F.count_if("starts_").alias("starts"), F.bool_and(flag).alias("all"))
    return each.select(*keys, "points", F.when(F.col("all"), F.lit(1).cast("bigint")).otherwise(F.col("starts")).alias("runs"))


def split_stroke(ring: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """ring with `run`: consecutive edges of equal flag share a number; a last run goes on in an equal first one."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    new = F.coalesce((F.lag(flag).over(w) != F.col(flag)).cast("int"), F.lit(0))
    runs = ring.withColumn("new_", new).withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wraps = (F.first(flag).over(whole) == F.last(flag).over(whole)) & (F.col("run") == F.max("run").over(Window.partitionBy(*keys)))
    return runs.withColumn("run", F.when(wraps, 0).otherwise(F.col("run")).cast("bigint")).drop("new_")


def cross_section(edges: DataFrame, depths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d, width): total width at depth d of the ring with edges (x1, y1, x2, y2): its crossings, in pairs."""
    at = edges.join(depths, keys).where((F.col("y1") > F.col("d")) != (F.col("y2") > F.col("d")))
    x = F.col("x1") + (F.col("d") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    r = F.row_number().over(Window.partitionBy(*keys, "d").orderBy("x"))
    return at.select(*keys, "d", x.alias("x")).withColumn("r", r).groupBy(*keys, "d").agg(F.sum(F.when(F.col("r") % 2 == 0, F.col("x")).otherwise(-F.col("x"))).alias("width"))


def outward_sides(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edges (keys, i, x1, y1, x2, y2) of closed rings with `side`: n, e, s or w, which a side's outward normal is
    nearest to; of equals north or south. Rings run either way round."""
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).over(Window.partitionBy(*keys))
    sign = F.when(area >= 0, 1).otherwise(-1)
    nx, ny = sign * (F.col("y2") - F.col("y1")), -sign * (F.col("x2") - F.col("x1"))
    side = F.when(F.abs(nx) > F.abs(ny), F.when(nx > 0, "e").otherwise("w")).otherwise(F.when(ny > 0, "n").otherwise("s"))
    return edges.withColumn("side", side)


def strokes(edges: DataFrame, cut_off: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run, dotted, points): the strokes that rings are drawn in: dotted where the side that a stretch faces is one
    on which the loaded data ends. cut_off: (keys, n, e, s, w)."""
    faced = outward_sides(edges, keys).join(cut_off, keys)
    faced = faced.withColumn("dotted", F.when(F.col("side") == "n", F.col("n")).when(F.col("side") == "e", F.col("e")).when(F.col("side") == "s", F.col("s")).otherwise(F.col("w")))
    return split_stroke(faced, keys, "i", "dotted").groupBy(*keys, "run").agg(F.first("dotted").alias("dotted"), F.count("*").alias("points"))
