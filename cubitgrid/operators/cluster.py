"""Clustering of buildings: pairs within the gap, connected components, city summaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from cubitgrid.functions import geometry as G
from cubitgrid.functions import kernels as K
from cubitgrid.operators.components import CHUNK, components
from cubitgrid.plans.shipping import ship
from cubitgrid.plans.tables import Tables


def with_cells(rows: DataFrame, size: int, reach: float) -> DataFrame:
    """rows with (cx, cy): a row for each cell of this size that its box, grown by `reach`, covers."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - reach) / size), F.floor((F.col(hi) + reach) / size))
    return rows.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def cell_pairs(left: DataFrame, right: DataFrame, size: int, reach: float, same: str = "scenario_id") -> DataFrame:
    """Pairs of boxes (a_*, b_*) of a scenario that share a cell, each once: in the first cell that both cover.

    The equality on the cell makes this a sort-merge join; no pair far apart is ever formed. Spark takes a side for as
    small as the table that it was exploded from, so it is told not to broadcast it.
    """
    a, b = (with_cells(d, size, reach).select(*[F.col(c).alias(f"{p}_{c}") for c in [*d.columns, "cx", "cy"]]) for d, p in ((left, "a"), (right, "b")))
    first = lambda axis: F.floor((F.greatest(f"a_{axis}0", f"b_{axis}0") - reach) / size)
    return a.join(b.hint("merge"), (F.col(f"a_{same}") == F.col(f"b_{same}")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy"))).where((F.col("a_cx") == first("x")) & (F.col("a_cy") == first("y"))).drop("a_cx", "a_cy", "b_cx", "b_cy")


def gaps() -> tuple[Column, Column]:
    return G.span_gap(F.col("a_x0"), F.col("a_x1"), F.col("b_x0"), F.col("b_x1")), G.span_gap(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1"))


def _corners(hulls: pa.Array) -> np.ndarray:
    """Corners (hulls, corners, 2) of hulls; the last one is repeated where a hull has fewer than others."""
    points, sizes = hulls.flatten(), hulls.value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    at = np.minimum((ends - sizes)[:, None] + np.arange(sizes.max()), (ends - 1)[:, None])
    return np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1)[at]


def _near_hulls(pairs: DataFrame, gap_mm: int) -> DataFrame:
    """The pairs whose hulls touch once grown, as by geometry.hulls_near."""
    names = ["a_scenario_id", "a_building_id", "b_building_id", "a_x0", "a_y0"]

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                b = whole.slice(start, 2_000)
                near = K.hulls_near(_corners(b.column("a_hull")), _corners(b.column("b_hull")), gap_mm)
                yield b.select(names).filter(pa.array(near))

    ship(pairs.sparkSession)
    return pairs.select(*names, "a_hull", "b_hull").mapInArrow(kept, ", ".join(f"{n} bigint" for n in names))


def linked_pairs(buildings: DataFrame, gap_mm: int) -> DataFrame:
    """(scenario_id, a, b, at_x, at_y) with a < b: footprints whose outlines, grown by the octagon around half the gap, touch.

    Footprints are boxes, or the column `hull` says what is in the box: then boxes choose the pairs whose hulls are tried.
    """
    shape = ["hull"] if "hull" in buildings.columns else []
    rows = buildings.select("scenario_id", "building_id", "x0", "y0", "x1", "y1", *shape)
    dx, dy = gaps()
    met = cell_pairs(rows, rows, 2 * gap_mm, gap_mm / 2 / G.COS_OCTAGON)
    near = met.where((F.col("a_building_id") < F.col("b_building_id")) & G.octagon_near(dx, dy, gap_mm))
    if shape:
        near = _near_hulls(near, gap_mm)
    return near.select(F.col("a_scenario_id").alias("scenario_id"), F.col("a_building_id").alias("a"), F.col("b_building_id").alias("b"), F.col("a_x0").alias("at_x"), F.col("a_y0").alias("at_y"))


#: Footprints meet in tiles so many gaps wide; any two whose first corners share a spot, this share of the gap wide, are linked.
TILE, SPOT = 8, 0.76


def _spot_links(rows: DataFrame, gap_mm: int) -> DataFrame:
    """(a, b): edges that connect the spots (column `first`) of footprints which are linked, a forest of each tile.

    A tile is in one task, and its pairs are tried only while they can connect spots that nothing connects yet, so edges
    and tables grow with footprints and not with pairs.
    """
    shape = ["hull"] if "hull" in rows.columns else []
    reach = gap_mm / 2 / G.COS_OCTAGON
    dealt = with_cells(rows.select("scenario_id", "first", "x0", "y0", "x1", "y1", *shape), TILE * gap_mm, reach)

    def forest(tile: pa.Table) -> pa.Table:
        boxes = np.stack([tile.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], 1)
        hulls = None
        if shape:
            hulls = _corners(tile.column("hull").combine_chunks())
        a, b = K.linked_groups(tile.column("first").to_numpy(), boxes, gap_mm, hulls)
        same = lambda c: pa.array(np.full(len(a), tile.column(c)[0].as_py() // (4 if c != "scenario_id" else 1), "int64"))
        return pa.table([same("scenario_id"), same("cx"), same("cy"), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["scenario_id", "cx", "cy", "a", "b"])

    ship(rows.sparkSession)
    found = dealt.groupBy("scenario_id", "cx", "cy").applyInArrow(forest, "scenario_id bigint, cx bigint, cy bigint, a bigint, b bigint")
    return found.repartition("scenario_id", "cx", "cy")  # neighbouring tiles meet in a task


def clusters(buildings: DataFrame, gap_mm: int) -> DataFrame:
    """buildings with `cluster`, the smallest building_id that is reached over links; ids are unique over scenarios.

    Footprints that start in a spot are one from the beginning, so what is connected in rounds are spots, of which an area
    has no more than fit in it.
    """
    tables = Tables(buildings.sparkSession, "clusters")
    if "hull" in buildings.columns:  # which take long to make
        buildings = tables.cut(buildings)
    corner = (F.col("hull")[0]["x"], F.col("hull")[0]["y"]) if "hull" in buildings.columns else (F.col("x0"), F.col("y0"))
    spot = {n: F.floor(c / (SPOT * gap_mm)).cast("bigint") for n, c in zip(("spot_x", "spot_y"), corner, strict=True)}
    keys = ["scenario_id", *spot]
    placed = buildings.withColumns(spot)
    named = placed.where("building_id is not null")
    firsts = tables.cut(named.groupBy(*keys).agg(F.min("building_id").alias("first")))
    reached = components(_spot_links(named.join(firsts, keys), gap_mm), tables, in_task=CHUNK)
    roots = firsts.join(reached.select(F.col("node").alias("first"), "root"), "first", "left").select(*keys, F.coalesce("root", "first").alias("root"))
    found = F.when(F.col("building_id").isNotNull(), F.coalesce("root", "building_id"))
    return placed.join(roots, keys, "left").withColumn("cluster", found).drop("root", *spot)


def summary(clustered: DataFrame, min_buildings: int = 6) -> DataFrame:
    """(scenario_id, cluster, building_count, is_city, minx, miny, maxx, maxy)."""
    each = clustered.groupBy("scenario_id", "cluster").agg(F.count("*").alias("building_count"), F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))
    return each.withColumn("is_city", F.col("building_count") >= min_buildings)


def data_edges(cities: DataFrame, extents: DataFrame, margin_mm: int = 150_000) -> DataFrame:
    """(scenario_id, cluster, n, e, s, w): whether a cluster comes within the margin of each side of what is loaded.

    extents has a row for each scenario: Spark broadcasts it while its statistics allow.
    """
    e = extents.select("scenario_id", *[F.col(c).alias(f"e_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    return cities.join(e, "scenario_id").select("scenario_id", "cluster", (F.col("maxy") > F.col("e_maxy") - margin_mm).alias("n"), (F.col("maxx") > F.col("e_maxx") - margin_mm).alias("e"), (F.col("miny") < F.col("e_miny") + margin_mm).alias("s"), (F.col("minx") < F.col("e_minx") + margin_mm).alias("w"))


def city_numbers(cities: DataFrame) -> DataFrame:
    """cities with `number`: 1, 2, ... within a scenario in the order of their first building."""
    return cities.withColumn("number", F.row_number().over(Window.partitionBy("scenario_id").orderBy("cluster")).cast("bigint"))


def corners(rows: DataFrame, *keys: str) -> DataFrame:
    """The corners (x, y) of each footprint: of its column `hull`, or of its box."""
    if "hull" in rows.columns:
        return rows.select(*keys, F.explode("hull").alias("c")).select(*keys, "c.x", "c.y")
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return rows.select(*keys, F.explode(F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))).alias("c")).select(*keys, "c.x", "c.y")


#: Built without a session, which modules don't need to be imported.
POINTS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


@F.pandas_udf(POINTS)
def _hull(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([[{"x": x, "y": y} for x, y in K.hull(np.stack([a, b], 1)).tolist()] for a, b in zip(xs, ys, strict=True)])


def with_hulls(rings: DataFrame) -> DataFrame:
    """Footprints of any shape (scenario_id, building_id, ring: array of points (x, y), open or closed) with the box
    around them (x0, y0, x1, y1) and `hull`, their convex hull, which is what counts between buildings.

    Rings of fewer than three corners that span ground are left out, as lines and points are no footprints.
    """
    ship(rings.sparkSession)
    of = lambda k: F.col(f"ring.{k}").cast("array<double>")
    # few bytes, much work: by number, so that they aren't gathered in few tasks
    spread = rings.where("ring is not null and size(ring) > 2").repartition(int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.withColumn("hull", _hull(of("x"), of("y"))).where("size(hull) > 2")
    box = {f"{k}{e}": f(F.col(f"hull.{k}")).cast("bigint") for k in "xy" for e, f in ((0, F.array_min), (1, F.array_max))}
    return rows.withColumns(box)


def _outermost(points: DataFrame, keys: list[str]) -> DataFrame:
    """The points (keys, x, y) less those inside the hull of others that a task holds beside them."""

    def kept(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        groups = t.select(keys).append_column("at", pa.array(np.arange(t.num_rows))).sort_by([(k, "ascending") for k in keys])
        order = groups.column("at").to_numpy()
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            codes = groups.column(k).combine_chunks().dictionary_encode("encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        at = np.stack([t.column(c).to_numpy()[order] for c in ("x", "y")], 1)
        return t.take(pa.array(order[K.outermost(at, new.cumsum())])).combine_chunks().to_batches()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield kept(held)
                held, n = [], 0
        if n:
            yield kept(held)

    rows = points.where("x is not null and y is not null").select(*keys, *[F.col(c).cast("double").alias(c) for c in "xy"])
    return rows.mapInArrow(run, rows.schema)


def hulls(points: DataFrame, keys: list[str], cell: int = 512_000) -> DataFrame:
    """(keys, i, x, y): corners of each group's convex hull, counter-clockwise from i = 0.

    A hull of hulls is the hull: points inside what a task holds of their group are not shuffled, the rest of a group are
    reduced cell by cell, so what a task takes of a group depends on how dense its points are, and what is left is a few
    corners a cell.
    """
    ship(points.sparkSession)
    points = _outermost(points, keys)
    at = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def reduced(rows: DataFrame, by: list[str]) -> DataFrame:
        lists = rows.groupBy(*by).agg(F.array_sort(F.collect_set("at")).alias("p"))
        return lists.select(*by, _hull(F.transform("p", lambda p: p["x"]), F.transform("p", lambda p: p["y"])).alias("h"))

    some = reduced(points.select(*keys, at.alias("at"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")), [*keys, "cx", "cy"])
    whole = reduced(some.select(*keys, F.explode("h").alias("at")), keys)
    return whole.select(*keys, F.posexplode("h").alias("i", "p")).select(*keys, F.col("i").cast("bigint").alias("i"), "p.x", "p.y")


def hull_edges(hull: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, x1, y1, x2, y2): sides of each hull; the last point is followed by the first."""
    w = Window.partitionBy(*keys).orderBy("i")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w)).alias(f"{c}2")
    return hull.select(*keys, "i", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x"), nxt("y"))


def min_area_rectangles(hull: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, angle, width, height, area): the smallest rectangle along a hull side, the first one of equals."""
    edges = hull_edges(hull, keys).withColumn("angle", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    u, v = G.rotate(F.col("x"), F.col("y"), -F.col("angle"))
    turned = edges.select(*keys, F.col("i").alias("side"), "angle").join(hull.select(*keys, "x", "y"), keys).select(*keys, "side", "angle", u.alias("u"), v.alias("v"))
    each = turned.groupBy(*keys, "side", "angle").agg((F.max("u") - F.min("u")).alias("width"), (F.max("v") - F.min("v")).alias("height"))
    best = each.groupBy(*keys).agg(F.min_by(F.struct("angle", "width", "height"), F.struct((F.col("width") * F.col("height")).alias("area"), "side")).alias("r"), F.min(F.col("width") * F.col("height")).alias("area"))
    return best.select(*keys, "r.angle", "r.width", "r.height", "area")
