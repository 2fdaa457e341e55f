"""Bridges of merged cities: the ground that closing adds between their parts, piece by piece."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubitgrid.operators import outline as L
from cubitgrid.operators.overlay import parts_of
from cubitgrid.operators.points import against_outlines, candidates
from cubitgrid.plans.tables import Tables

KEYS = ["scenario_id", "cluster"]
ENDS = ["ax", "ay", "bx", "by"]


def bridges(members: DataFrame, by: np.ndarray, close: np.ndarray) -> DataFrame:
    """(scenario_id, root, piece, x, y, area, n_parts, n_pieces): pieces of a merged city's closing, less its parts, that
    touch at least two parts along a side. Pieces count from 0 by their smallest corner (x, y); n_pieces counts a city's.

    members: footprints (scenario_id, building_id, x0, y0, x1, y1, or with a hull) of parts `cluster` of cities `root`.
    Parts are grown by the brush `by`, which must be small enough that two parts don't meet, as the brush by which they
    were clustered is; the city is closed by `close`. Cities of one part have no bridge. Corners are whole millimetres:
    where sides of the closing cross a part's elsewhere, they are rounded, which is exact for boxes and square brushes.

    No task holds a city: the closing's sides outside the parts and the parts' sides inside it, turned around, bound
    the fill, and its rings come from their list ranking.
    """
    tables = Tables(members.sparkSession, "bridges")
    several = members.groupBy("root").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most")).where("least < most").select("root")
    rows = tables.cut(members.join(several, "root", "left_semi"))
    roots = rows.select("cluster", "root").distinct()
    own = L.open_parts(rows.drop("root"), by).withColumnRenamed("cluster", "part")
    own = tables.cut(own.join(roots.withColumnRenamed("cluster", "part"), "part").withColumnRenamed("root", "cluster").select(*KEYS, *ENDS, "part"))
    whole = tables.cut(L.sides(L.closed(rows.drop("cluster").withColumnRenamed("root", "cluster"), by, close)))

    outer = parts_of(whole, own, tables).where("place in ('outside', 'against')").select(*KEYS, *ENDS, F.lit(None).cast("bigint").alias("part"))
    inner = parts_of(own, whole, tables, ["part"]).where("place = 'inside'").select(*KEYS, F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"), "part")
    snapped = [F.floor(F.col(c) + 0.5).cast("bigint").alias(c) for c in ENDS]
    around = tables.cut(outer.unionByName(inner).select(*KEYS, *snapped, "part").where("ax <> bx or ay <> by"))
    rings = tables.cut(L.rings(around.drop("part").distinct(), tables))

    whose = around.where("part is not null").select("cluster", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("x2"), F.col("by").alias("y2"), "part")
    touched = rings.join(whose, ["cluster", "x", "y", "x2", "y2"]).groupBy("cluster", "ring").agg(F.collect_set("part").alias("parts"))
    told = rings.groupBy(*KEYS, "ring").agg(F.first("area").alias("area"), F.min(F.struct("x", "y")).alias("least"), *[f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))])
    told = tables.cut(told.join(touched, ["cluster", "ring"], "left").withColumn("id", F.monotonically_increasing_id()))

    held = _holes(told, rings, tables)
    each = told.join(held.select(F.col("hole").alias("id"), "piece_id"), "id", "left").withColumn("piece_id", F.when(F.col("area") > 0, F.col("id")).otherwise(F.col("piece_id")))
    none = F.array().cast("array<bigint>")
    parts = F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("parts", none)))))
    pieces = each.groupBy("scenario_id", F.col("cluster").alias("root"), "piece_id").agg(F.min("least").alias("least"), F.sum("area").alias("area"), parts.cast("bigint").alias("n_parts")).where("n_parts > 1")
    by_corner, city = Window.partitionBy("root").orderBy("least", "piece_id"), Window.partitionBy("root")
    return pieces.select("scenario_id", "root", (F.row_number().over(by_corner) - 1).cast("bigint").alias("piece"), F.col("least.x").cast("bigint").alias("x"), F.col("least.y").cast("bigint").alias("y"), F.floor(F.col("area") + 0.5).cast("bigint").alias("area"), "n_parts", F.count("*").over(city).alias("n_pieces"))


def _holes(told: DataFrame, rings: DataFrame, tables: Tables) -> DataFrame:
    """(hole, piece_id): the smallest outer ring around each hole. A point beside the middle of the hole's first side, a
    quarter of a millimetre into the ground, is clearly inside it."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    far = F.hypot(dx, dy)
    beside = {"px": (F.col("x") + F.col("x2")) / 2 - dy / far / 4, "py": (F.col("y") + F.col("y2")) / 2 + dx / far / 4}
    first = rings.where("i = 0 and area < 0").withColumns(beside).join(told.select("cluster", "ring", "id"), ["cluster", "ring"])
    points = tables.cut(first.select("scenario_id", F.col("id").alias("point_id"), F.col("px").alias("x"), F.col("py").alias("y"), "cluster"))
    outer = told.where("area > 0").select("scenario_id", F.col("id").alias("piece_id"), "cluster", "area", "x0", "y0", "x1", "y1")
    # outer rings are asked for one by one, each as a cluster of its own
    met = candidates(points.drop("cluster"), outer.select("scenario_id", F.col("piece_id").alias("cluster"), "x0", "y0", "x1", "y1"))
    named = rings.join(told.where("area > 0").select("cluster", "ring", "id"), ["cluster", "ring"])
    inside = against_outlines(met, named.select("scenario_id", F.col("id").alias("cluster"), "ring", "i", "x", "y", "x2", "y2"), 0.0).where("inside")
    same = inside.select(F.col("point_id").alias("hole"), F.col("cluster").alias("piece_id")).join(outer.select("piece_id", "cluster", "area"), "piece_id").join(points.select(F.col("point_id").alias("hole"), "cluster"), ["hole", "cluster"])
    return same.groupBy("hole").agg(F.min_by("piece_id", "area").alias("piece_id"))
