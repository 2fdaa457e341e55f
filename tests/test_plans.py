import json

import pytest
from pyspark.sql import functions as F

from cubitgrid.functions import geometry as G
from cubitgrid.operators import cluster as C
from cubitgrid.operators import scan as N
from cubitgrid.operators import techum as T
from cubitgrid.operators import text as X
from cubitgrid.plans import settings as S
from cubitgrid.plans.run import Run
from cubitgrid.sources import osm

GAP = S.Settings().mm(S.CITY_GAP)
BOX = "scenario_id bigint, building_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint"


def row_of_houses(n, start=1, x=0, y=0, step=20_000, scenario=1):
    return [(scenario, start + k, x + k * step, y, x + k * step + 10_000, y + 10_000) for k in range(n)]


# settings


def test_lengths_are_exact_for_presets():
    assert [S.Settings(amahPreset=p).mm(S.CITY_GAP) for p in S.PRESET_CM] == [33_920, 38_160, 40_704]
    assert S.Settings().mm(S.MERGE_GAP) == 67_840 and S.Settings().mm(S.TECHUM) == 960_000
    assert S.Settings(amahPreset="custom", customAmahCm=50.0).mm(2000) == 1_000_000


def test_defaults():
    """The sixteen settings as the survey lists them."""
    want = {"amahPreset": "naeh", "customAmahCm": 48.0, "triangleAbsorbsThird": True, "triangleWideMiddle": "noMerge", "chazonIshStraightSide": False, "keshetCondition": "mouthAndDepth", "keshetExclusion": "past4000", "remaExtra": False}
    want |= {"fourAmotMode": "each", "unequalLines": "extend", "havlaahWidth": "magenAvraham", "havlaahLength": "parallel", "havlaahEruvStartCity": True, "eruvCityTechum": True, "fetchRadiusM": 3000.0, "language": "en"}
    assert S.Settings().__dict__ == want


@pytest.mark.parametrize(("key", "value", "stage"), [(k, v, S.FIRST_STAGE[k]) for k, v in {"amahPreset": "moshe", "customAmahCm": 50.0, "triangleAbsorbsThird": False, "triangleWideMiddle": "merge", "chazonIshStraightSide": True, "keshetCondition": "mouthOnly", "keshetExclusion": "entire", "remaExtra": True, "fourAmotMode": "total", "unequalLines": "diagonal", "havlaahWidth": "rema", "havlaahLength": "fullWidth", "havlaahEruvStartCity": False, "eruvCityTechum": False, "fetchRadiusM": 2000.0, "language": "he"}.items()])
def test_first_stage_of_each_setting(key, value, stage):
    old = S.Settings()
    assert old.first_stage(S.Settings.load({key: value})) == stage and old.first_stage(old) == S.NEVER


def test_invalid_settings_are_left_out_one_by_one():
    got = S.Settings.load({"amahPreset": "other", "customAmahCm": 200, "remaExtra": "yes", "language": "he", "unknown": 1, "fetchRadiusM": True})
    assert got == S.Settings(language="he")


def test_settings_from_json(spark):
    df = spark.createDataFrame([('{"amahPreset": "moshe", "customAmahCm": 99, "remaExtra": true}',), ("broken",), (None,)], "j string")
    a, b, c = S.from_json(df, "j").collect()
    assert (a.amahPreset, a.customAmahCm, a.remaExtra) == ("moshe", "48.0", "true")
    assert (b.amahPreset, c.language) == ("naeh", "en")


# clustering


@pytest.mark.parametrize(("dx", "dy", "linked"), [(1.0, 0, True), (1.08, 0, True), (1.09, 0, False), (0.9239 * 0.99, 0.3827 * 0.99, True), (0.9239 * 1.02, 0.3827 * 1.02, False)])
def test_octagon_gap(spark, dx, dy, linked):
    """Along an axis the octagon reaches 8 % farther than the circle, towards its sides not at all."""
    a = (1, 1, 0, 0, 10_000, 10_000)
    b = (1, 2, 10_000 + int(dx * GAP), 10_000 + int(dy * GAP) if dy else 0, 20_000 + int(dx * GAP), 20_000 + int(dy * GAP) if dy else 10_000)
    assert C.linked_pairs(spark.createDataFrame([a, b], BOX), GAP).count() == int(linked)


def test_five_houses_are_no_city(spark):
    rows = row_of_houses(5) + row_of_houses(6, 100, y=900_000)
    got = {r.cluster: (r.building_count, r.is_city) for r in C.summary(C.clusters(spark.createDataFrame(rows, BOX), GAP)).collect()}
    assert got == {1: (5, False), 100: (6, True)}


def test_components_of_chains_and_stars(spark, tmp_path):
    from cubitgrid.operators.components import components
    from cubitgrid.plans.tables import Tables

    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Tables(spark, "t")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 560)} | {8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Tables(spark, "t")).count() == 0


# rays


def walk(spark, heights, step=24_000, budget=960_000):
    rows = [(1, k, h) for k, h in enumerate(heights)]
    return T.ray_walk(spark.createDataFrame(rows, "ray_id bigint, k bigint, elev bigint"), step, budget, 960_000).first().distance


def brute(heights, step=24_000, budget=960_000, limit=960_000):
    if heights[0] is None:
        return float(budget)
    used, before, dist = 0.0, heights[0], 0.0
    for h in heights[1:]:
        cost = float(step)
        if h is not None:
            dh = h - before
            if abs(dh) / step < 1 / 3.6 or (dh < 0 and heights[0] - h > limit):
                cost = (step * step + dh * dh) ** 0.5
            before = h
        if used + cost >= budget:
            return dist + (budget - used) / cost * step
        used, dist = used + cost, dist + step
    return float(budget)


@pytest.mark.parametrize("heights", [[0] * 42, [k * 5_000 for k in range(42)], [k * 20_000 for k in range(42)], [-k * 60_000 for k in range(42)], [0, None, 9_000, None, None, 3_000] * 7, [None] * 42, [None] + [0] * 41])
def test_rays(spark, heights):
    assert walk(spark, heights) == pytest.approx(brute(heights), abs=1e-3)


def test_start_city_is_taken_without_gain(spark):
    areas = spark.createDataFrame([(1, 1, 0, 0, 1_000, 1_000, 500, 3_000)], "area_id bigint, scenario_id bigint, minx bigint, miny bigint, maxx bigint, maxy bigint, start_x bigint, start_y bigint")
    areas = areas.select("*", *[F.lit(5_000).alias(f"reach_{s}") for s in T.SIDES])
    cities = spark.createDataFrame([(1, 7, 200, 2_000, 800, 9_000), (1, 8, -400, -3_000, 300, -2_000), (1, 9, 900, 500, 2_000, 700)], "scenario_id bigint, cluster bigint, minx bigint, miny bigint, maxx bigint, maxy bigint")
    got = {(r.cluster, r.side, r.part): (r.minx, r.miny, r.maxx, r.maxy) for r in T.swallowed(areas, cities, 100, 500, start_city=True).collect()}
    assert got == {(7, "n", 1): (200, 2_000, 800, 9_000), (8, "s", 1): (-400, -3_000, 300, -2_000), (8, "s", 2): (-400, -5_900, 300, -5_000)}
    assert {r.cluster for r in T.swallowed(areas, cities, 100, 500).collect()} == {8}
    rema = {(r.cluster, r.part): (r.minx, r.maxx) for r in T.swallowed(areas, cities, 100, 500, width="rema", length="fullWidth").collect()}
    assert rema == {(8, 1): (-900, 800), (8, 2): (-5_000, 6_000)}


# areas, text, sources


def test_extension_stops_and_keeps_rows_without_id(spark):
    rows = row_of_houses(3) + row_of_houses(2, 10, y=2_000_000) + [(1, None, 0, 1_400_000, 10, 1_600_000)]
    extents = spark.createDataFrame([(1, -1_500_000, -1_500_000, 1_500_000, 1_500_000)], "scenario_id bigint, minx bigint, miny bigint, maxx bigint, maxy bigint")
    got, wider = N.extend(spark.createDataFrame(rows, BOX), extents, ["n"], 1_500_000)
    assert got.where("building_id is not null").count() == 5 and got.where("building_id is null").count() == 2
    assert wider.first().maxy == 3_000_000
    _, most = N.extend(spark.createDataFrame(rows, BOX), wider, ["n"], 1_500_000, most=3_500_000)
    assert most.first().maxy == 3_500_000


def test_rounding_and_angles(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.4,)], "v double")
    assert [r[0] for r in df.select(G.snap(F.col("v"), 1.0)).collect()] == [-2.0, 3.0, 0.0]
    import math

    a = spark.createDataFrame([(math.radians(d),) for d in (-45.0, 44.0, 46.0, 100.0, -100.0)], "a double").select(F.round(F.degrees(G.normal_angle(F.col("a"))), 6)).collect()
    assert [r[0] for r in a] == [-45.0, 44.0, -44.0, 10.0, -10.0]


def test_rings_and_predicates(spark):
    d = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (2.0, 2.0)], "x double, y double")
    ring = G.rectangle(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    hole = G.rectangle(F.lit(1), F.lit(1), F.lit(3), F.lit(3))
    got = d.select(G.in_ring(F.col("x"), F.col("y"), ring).alias("r"), G.in_rings(F.col("x"), F.col("y"), F.array(ring, hole)).alias("h"), G.ring_area(ring).alias("a"), G.ring_distance(F.col("x"), F.col("y"), ring).alias("d"), G.in_convex(F.col("x"), F.col("y"), F.slice(ring, 1, 4)).alias("c")).collect()
    assert [(r.r, r.h, r.a, r.d, r.c) for r in got] == [(True, True, 100.0, 5.0, True), (False, False, 100.0, 5.0, False), (True, False, 100.0, 2.0, True)]
    lit = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    s = d.limit(1).select(G.segments_distance(lit(0, 0), lit(10, 10), lit(0, 10), lit(10, 0)).alias("a"), G.segments_distance(lit(0, 0), lit(10, 0), lit(0, 3), lit(10, 5)).alias("b")).first()
    assert (s.a, s.b) == (0.0, 3.0)


def test_nested_polygons(spark):
    poly = F.array(F.array(G.rectangle(F.lit(34.0), F.lit(31.0), F.lit(35.0), F.lit(32.0))))
    back = G.poly_from_local(G.poly_to_local(poly, F.lit(31.5), F.lit(34.5)), F.lit(31.5), F.lit(34.5))
    turned = G.poly_rotate(G.poly_rotate(poly, F.lit(0.7)), F.lit(-0.7))
    r = spark.range(1).select(G.all_points(back).alias("b"), G.all_points(turned).alias("t"), G.all_points(poly).alias("p")).first()
    for p, q, t in zip(r.p, r.b, r.t, strict=True):
        assert (q.x, q.y) == pytest.approx((p.x, p.y)) and (t.x, t.y) == pytest.approx((p.x, p.y))


def test_texts(spark):
    d = spark.range(1).select(X.distance_text(F.lit(960.0), 0.48).alias("d"), X.sides_text(*[F.lit(v) for v in (True, True, True, False)]).alias("s"), X.sides_text(*[F.lit(v) for v in (False, True, False, False)]).alias("e"), X.sides_text(*[F.lit(False)] * 4).alias("n"), *[c.alias(n) for c, n in zip(X.from_url(F.lit("https://example.org/?lat=31.5&lon=x")), ("lat", "lon"), strict=True)]).first()
    assert tuple(d) == ("2,000 amot (960 m)", "north, east and south", "east", "", 31.5, None)


def test_osm_assembly_and_elevation(spark):
    nodes = spark.createDataFrame([(1, 31.0, 34.0), (2, 31.0, 34.001), (3, 31.001, 34.001), (4, 31.001, 34.0)], "node_id bigint, lat double, lon double")
    ways = spark.createDataFrame([(10, [1, 2, 3, 4, 1]), (11, [1, 2, 3]), (12, [3, 4, 1]), (13, [1, 99])], "way_id bigint, nodes array<bigint>")
    rings = osm.ways_to_rings(ways, nodes)
    assert {r.way_id: r.closed for r in rings.collect()} == {10: True, 11: False, 12: False}
    members = spark.createDataFrame([(5, 0, 11, "outer"), (5, 1, 12, "outer"), (5, 2, 10, "inner"), (6, 0, 11, "outer")], "relation_id bigint, pos int, way_id bigint, role string")
    got = osm.relations_to_polygons(members, rings).collect()
    assert [(r.relation_id, len(r.outer), len(r.outer[0]), len(r.inner)) for r in got] == [(5, 1, 5, 1)]
    box = osm.boxes(rings.withColumn("scenario_id", F.lit(1).cast("bigint")), spark.createDataFrame([(1, 31.0, 34.0)], "scenario_id bigint, lat0 double, lon0 double")).first()
    assert (box.x0, box.y0, box.y1) == (0, 0, 111_320)
    pts = spark.createDataFrame([(31.7, 35.2), (0.0, 0.0)], "lat double, lon double")
    tile = pts.limit(1).select(*[c.alias(n) for c, n in zip(G.tile(F.col("lat"), F.col("lon")), ("tile_x", "tile_y", "px", "py"), strict=True)], F.lit(131).alias("red"), F.lit(32).alias("green"), F.lit(128).alias("blue"))
    assert sorted(osm.elevations(pts, tile).select("elev").collect(), key=str) == sorted([(131 * 256 + 32 + 0.5 - 32768,), (None,)], key=str)
    assert '"Polygon"' in osm.layers({"a": spark.createDataFrame([(0, 0, 1, 1)], "minx int, miny int, maxx int, maxy int")}).first().feature


# whole runs


@pytest.fixture(scope="module")
def town(spark):
    """A town with the first point in it, a small city in reach, a hamlet, and a town that goes on beyond the data."""
    rows = row_of_houses(12, 1, x=-100_000) + row_of_houses(8, 100, x=400_000, y=0) + row_of_houses(3, 200, y=700_000)
    rows += row_of_houses(300, 1000, x=0, step=30_000, scenario=2)
    homes = spark.createDataFrame([(1, 1, 5_000, 5_000), (2, 2, 5_000, 5_000)], "scenario_id bigint, point_id bigint, x bigint, y bigint")
    return spark.createDataFrame(rows, BOX), homes


def test_run(spark, town):
    run = Run(spark, *town, settings=S.Settings(fetchRadiusM=1000.0))
    got = {r.scenario_id: r for r in run.result().collect()}
    assert got[1].source == "city" and got[1].minx == -100_000 - 960_000 and got[1].maxy == 10_000 + 960_000
    assert {a.cluster for a in got[1].added} == {100} and {a.part for a in got[1].added} == {1, 2}
    # the long town is loaded to its end, strip by strip
    assert got[2].maxx == 299 * 30_000 + 10_000 + 960_000
    extent = {r.scenario_id: (r.minx, r.maxx) for r in run.stage(2)["extents"].collect()}
    assert extent[1] == (-995_000, 1_005_000) and extent[2][1] == 10_005_000
    assert {r.step for r in run.diagnostics().where("scenario_id = 1").collect()} >= {3, 6}


def test_changed_settings_keep_earlier_stages(spark, town):
    source, homes = town
    run = Run(spark, source, homes.where("scenario_id = 1"))
    run.result()
    before = list(run.made)
    assert run.change(language="he") == S.NEVER and run.result() is not None and run.made == before
    assert run.change(unequalLines="diagonal") == 6
    run.result()
    assert run.made[len(before) :] == ["techum"]
    assert run.change(unequalLines="extend", fourAmotMode="total") == 5
    run.result()
    assert "clusters" not in run.made[len(before) :] and "shvita" in run.made[len(before) :]
    assert run.change(amahPreset="nothing") == S.NEVER


def test_updates_and_logs_by_step(spark, town):
    """Each stage that is made is told once, with its rows; logs of steps that a setting doesn't reach stay."""
    source, homes = town
    told = []
    run = Run(spark, source, homes.where("scenario_id = 1"), settings=S.Settings(fetchRadiusM=1000.0), updates=lambda stage, rows: told.append((stage, rows)))
    first = sorted(map(tuple, run.diagnostics().collect()), key=str)
    assert [stage for stage, _ in told] == ["buildings", "clusters", "cities", "squarings", "shvita", "techum"]
    assert told[0][1] == {"buildings": run.stage(1)["buildings"].count(), "extents": 1} and told[2][1]["cities"] == 2
    kept = dict(run.logs)
    assert run.change(unequalLines="diagonal") == 6
    assert len(sorted(map(tuple, run.diagnostics().collect()), key=str)) == len(first)
    assert [stage for stage, _ in told[6:]] == ["techum"] and {k for k in run.logs if k not in kept} == {(6, run.settings.read_by(6))}


def test_a_newer_run_takes_over(spark, town, monkeypatch):
    """The first run ends interrupted in the middle of a stage and leaves nothing; the second one is right."""
    import os
    from threading import Thread

    from cubitgrid.plans.run import Newest, Superseded

    source, homes = town
    one, two = (Run(spark, source, homes.where("scenario_id = 1"), settings=S.Settings(fetchRadiusM=1000.0)) for _ in range(2))
    newest, got = Newest(), []

    def slow(self=one):
        newest.start(two)  # while the first run's stage is under way
        return {"clustered": spark.range(100).repartition(4).mapInArrow(lambda batches: batches, "id bigint")}

    monkeypatch.setattr(one, "_clusters", slow)

    def go():
        try:
            got.append(newest.start(one).result().collect())
        except Exception as e:
            got.append(e)

    t = Thread(target=go)
    t.start()
    t.join(120)
    assert isinstance(got[0], Superseded) and not one.kept and not one.logs
    assert not os.path.exists(one.tables.base.removeprefix("file://"))
    with pytest.raises(Superseded):
        one.stage(1)
    assert [r.source for r in two.result().collect()] == ["city"]


def test_ends_of_the_data_reach_the_boundary(spark):
    """A city that goes on to the east beyond 10 km, measured from its western end."""
    source = spark.createDataFrame(row_of_houses(600, step=20_000), BOX)
    homes = spark.createDataFrame([(1, 1, 5_000, 5_000), (1, 2, 5_000, 900_000)], "scenario_id bigint, point_id bigint, x bigint, y bigint")
    run = Run(spark, source, homes)
    assert {r.area_id: (r.n, r.e, r.s, r.w) for r in run.result().collect()} == {1: (False, True, False, False), 2: (False, False, False, False)}
    assert [r.point_id for r in run.diagnostics().where("step = 5 and text like '%beyond%'").collect()] == [1]


def test_second_point(spark, town):
    source, homes = town
    one = homes.where("scenario_id = 1")
    place = lambda x, y: spark.createDataFrame([(1, 77, x, y)], "scenario_id bigint, point_id bigint, x bigint, y bigint")
    run = Run(spark, source, one, place(900_000, 300_000))
    r = run.result().first()
    assert r.source == "point" and r.minx == 900_000 - 1_920 - 960_000
    run.place_eruv(place(5_000_000, 0))
    assert run.stage(7)["eruv_shvita"].first().valid is False and run.result().first().source == "city"
    run.place_eruv(None)
    assert run.made.count("techum") == 1 and run.result().first().source == "city"
    with pytest.raises(ValueError, match="second points"):
        run.stage(7)


def test_every_point_of_a_scenario_is_measured(spark, town):
    source, homes = town
    several = spark.createDataFrame([(1, 1, 5_000, 5_000), (1, 3, 900_000, 900_000), (1, 4, 405_000, 5_000)], homes.schema)
    eruvs = spark.createDataFrame([(1, -4, 1_200_000, 700_000, 3), (1, -5, 9_000_000, 0, 4)], "scenario_id bigint, point_id bigint, x bigint, y bigint, home_id bigint")
    run = Run(spark, source, several, eruvs, S.Settings(fetchRadiusM=1000.0))
    got = {r.area_id: r for r in run.result().collect()}
    assert {k: r.source for k, r in got.items()} == {1: "city", -4: "point", 4: "city"}
    assert got[-4].minx == 1_200_000 - 1_920 - 960_000 and got[4].minx == 400_000 - 960_000
    assert {a.cluster for a in got[1].added} == {100} and {a.cluster for a in got[4].added} == {1}
    said = {(r.point_id, r.step) for r in run.diagnostics().collect()}
    assert {(3, 5), (1, 6), (4, 6), (None, 3)} <= said and not {(1, 5), (4, 5)} & said


def test_registered_runs_measure_all_points(spark, sf_dir):
    from cubitgrid.plans import boundary_queries as Q

    run, points = Q._run(spark, sf_dir), Q.X.points(spark, sf_dir)
    assert run.homes.count() == run.eruvs.count() == points.count() and run.settings == S.Settings()


def measure(spark, rows, points, **settings):
    """What is measured from each of some points of one scenario, and the run."""
    homes = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(points)], "scenario_id bigint, point_id bigint, x bigint, y bigint")
    run = Run(spark, spark.createDataFrame(rows, BOX), homes, settings=S.Settings(fetchRadiusM=2000.0, **settings))
    return {r.area_id: r for r in run.result().collect()}, run


def test_city_bounds(spark):
    """A point 15 m outside the last house is beyond the built-up city, though within half a gap of it; the Rema's strip
    reaches half a gap beyond the outline; open space that the city encloses is the city."""
    square = [(1, 100 + k, x, y, x + 10_000, y + 10_000) for k, (x, y) in enumerate([(a, b) for a in range(300_000, 480_000, 25_000) for b in range(0, 180_000, 25_000) if a in (300_000, 475_000) or b in (0, 175_000)])]
    rows = row_of_houses(8) + square
    outside, enclosed, far, strip = (-15_000, 5_000), (390_000, 90_000), (-60_000, 5_000), (-30_000, 5_000)
    points = [(5_000, 5_000), outside, enclosed, far, strip]
    got, _ = measure(spark, rows, points)
    assert [got[k].source for k in range(5)] == ["city", "point", "city", "point", "point"] and not any(r.ribua for r in got.values())
    assert (got[0].minx, got[0].maxx) == (-960_000, 150_000 + 960_000)
    grown, _ = measure(spark, rows, points, remaExtra=True)
    assert [grown[k].source for k in range(5)] == ["city", "city", "city", "point", "city"]
    # each side has moved by 70 2/3 amot
    extra = 33_920
    assert [grown[0][c] - got[0][c] for c in ("minx", "miny", "maxx", "maxy")] == [-extra, -extra, extra, extra]


def test_ground_between_merged_parts_is_the_city(spark):
    """Two towns of 200 m that face each other over 60 m: what lies between them is sealed, but not beside it."""
    block = lambda x0, first: [(1, first + k, x0 + a * 25_000, b * 25_000, x0 + a * 25_000 + 10_000, b * 25_000 + 10_000) for k, (a, b) in enumerate((a, b) for a in range(6) for b in range(8))]
    rows = block(0, 1) + block(135_000 + 60_000, 1000)
    got, run = measure(spark, rows, [(5_000, 5_000), (165_000, 92_000), (165_000, -30_000), (165_000, 400_000)])
    assert [got[k].source for k in range(4)] == ["city", "city", "point", "point"]
    assert run.stage(3)["cities"].first().n_cities == 2 and got[0].minx == got[1].minx == -960_000


def test_boundary_of_a_city_with_a_bow(spark):
    """A U of 1.5 km, measured in amot of 30 cm: the bow is cut from the squaring, and the boundary is indented past it."""
    at = [(x, 0) for x in range(-750_000, 750_001, 25_000)] + [(s, y) for s in (-750_000, 750_000) for y in range(25_000, 900_001, 25_000)]
    rows = [(1, k + 1, x, y, x + 10_000, y + 10_000) for k, (x, y) in enumerate(at)]
    middle, arm = (5_000, 850_000), (-740_000, 850_000)
    inside = lambda r, p: spark.createDataFrame([(r.pieces,)], "pieces array<array<struct<x:double,y:double>>>").select(T.in_pieces(F.lit(p[0]), F.lit(p[1]), F.col("pieces"))).first()[0]
    small = {"amahPreset": "custom", "customAmahCm": 30.0}
    got, run = measure(spark, rows, [(0, 5_000), (5_000, 500_000)], keshetExclusion="entire", **small)
    assert got[0].source == "city" and got[0].indented and (got[0].minx, got[0].maxy) == (-750_000 - 600_000, 910_000 + 600_000)
    assert inside(got[0], arm) and not inside(got[0], middle) and inside(got[0], (5_000, 500_000))
    assert got[1].source == "point" and not got[1].ribua  # the bow is no part of the squaring
    assert {(r.step, r.kind) for r in run.diagnostics().collect()} >= {(4, "log"), (6, "warning")}
    area = {r.area_id: r.area_m2 for r in T.outlines_of(run.result(), ["area_id"]).groupBy("area_id").agg(F.sum("area_m2").alias("area_m2")).collect()}
    full = (1.51 + 1.2) * (0.91 + 1.2) * 1e6
    assert full * 0.9 < area[0] < full - 1e4 and area[1] == pytest.approx((1.2024) ** 2 * 1e6, rel=1e-3)
    run.change(unequalLines="diagonal")
    assert not inside(run.result().where("area_id = 0").first(), middle)
    # wider than 4000 amot only near its mouth: the arms close in below
    run.change(unequalLines="extend", keshetExclusion="past4000")
    assert run.result().where("area_id = 0").first().indented
    run.change(keshetCondition="mouthAndDepth", customAmahCm=60.0)
    whole = run.result().where("area_id = 0").first()
    assert not whole.indented and inside(whole, middle)


def test_boundary_of_a_turned_city(spark):
    import math

    turn = math.radians(30)
    rows = [(1, k + 1, *[round(v) for v in (x - 6_000, y - 6_000, x + 6_000, y + 6_000)]) for k, (x, y) in enumerate([(t * math.cos(turn) - s * math.sin(turn), t * math.sin(turn) + s * math.cos(turn)) for t in range(0, 300_000, 15_000) for s in range(0, 90_000, 15_000)])]
    got, run = measure(spark, rows, [(0, 0)])
    r = got[0]
    assert r.source == "city" and abs(math.degrees(r.angle) - 30) < 1.5
    assert r.maxx - r.minx == pytest.approx(285_000 + 2 * 960_000 + 16_000, abs=8_000)
    far = [max(p.x for q in r.pieces for p in q), max(p.y for q in r.pieces for p in q)]
    assert far[0] == pytest.approx(r.maxx * math.cos(r.angle) - r.miny * math.sin(r.angle), rel=1e-9) and far[1] == pytest.approx(r.maxx * math.sin(r.angle) + r.maxy * math.cos(r.angle), rel=1e-9)


def test_rays_read_elevation_tiles(spark):
    """A slope to the east, known on two tiles: eastward rays pay for it, and heights are missing to the north."""
    homes = spark.createDataFrame([(1, 1, 0, 0)], "scenario_id bigint, point_id bigint, x bigint, y bigint")
    frames = spark.createDataFrame([(1, 31.7, 35.2)], "scenario_id bigint, lat0 double, lon0 double")
    from cubitgrid.operators import techum

    flat = Run(spark, spark.createDataFrame([], BOX), homes)
    areas = flat.stage(5)["shvita"].withColumnRenamed("point_id", "area_id")
    at = techum.ray_points(areas, 24_000).join(frames, "scenario_id")
    lat, lon = G.from_local(F.col("x") / 1000, F.col("y") / 1000, F.col("lat0"), F.col("lon0"))
    keys = ["tile_x", "tile_y", "px", "py"]
    seen = at.select("y", *[c.alias(n) for n, c in zip(keys, G.tile(lat, lon), strict=True)]).where("y < 100000").select(*keys).distinct()
    raster = seen.select("*", (F.lit(128) + F.floor((F.col("tile_x") * 256 + F.col("px")) % 1000 / 20)).alias("red"), F.lit(0).alias("green"), F.lit(0).alias("blue")).selectExpr(*keys, "cast(128 as int) red", "cast((tile_x * 256 + px) % 100 * 2 as int) green", "cast(0 as int) blue")
    run = Run(spark, flat.source, homes, raster=raster, frames=frames)
    got, level = run.result().first(), flat.result().first()
    assert got.no_heights and not level.no_heights
    assert got.maxx < level.maxx and got.maxy == level.maxy


def test_no_buildings(spark, town):
    _, homes = town
    run = Run(spark, spark.createDataFrame([], BOX), homes)
    assert {r.source for r in run.result().collect()} == {"point"}
    assert {r.step for r in run.diagnostics().collect()} == {1, 2, 5}


def test_stream_of_points(spark, town, tmp_path):
    from cubitgrid.streaming.points import POINT, measure_stream

    source, homes = town
    homes.where("scenario_id = 1").coalesce(1).write.json(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema(POINT).json(str(tmp_path / "in"))
    q = measure_stream(stream, source, str(tmp_path / "checkpoint"), lambda df, i: seen.update({i: df.collect()}), once=True)
    q.awaitTermination(240)
    assert q.exception() is None and [r.scenario_id for r in seen[0]] == [1]


def test_a_point_off_the_origin_is_measured_alike_alone_and_in_any_batch(spark, tmp_path):
    """A city 20 km from the origin, whole in what each point loads: the data around a point doesn't hang on the origin."""
    from cubitgrid.streaming.points import POINT, measure_stream

    at = 20_000_000
    source = spark.createDataFrame(row_of_houses(8, x=at, y=at), BOX)
    points = [(1, 10, at + 45_000, at + 5_000), (1, 11, at + 45_001, at + 5_001), (1, 12, at - 900_000, at)]
    fields = lambda df: {r.area_id: (r.source, r.minx, r.miny, r.maxx, r.maxy, r.pieces) for r in df.collect()}
    whole = fields(Run(spark, source, spark.createDataFrame(points, POINT)).result())
    assert {k: v[0] for k, v in whole.items()} == {10: "city", 11: "city", 12: "point"}
    for p in points:
        assert fields(Run(spark, source, spark.createDataFrame([p], POINT)).result()) == {p[1]: whole[p[1]]}
    (tmp_path / "in").mkdir()
    for k, p in enumerate(points):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(dict(zip(("scenario_id", "point_id", "x", "y"), p, strict=True))))
    seen = {}
    stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = measure_stream(stream, source, str(tmp_path / "checkpoint"), lambda df, i: seen.update(fields(df)), once=True)
    q.awaitTermination(300)
    assert q.exception() is None and seen == whole


def test_extension_ends_at_a_distance_from_the_points(spark):
    """A row of houses that goes on for 40 km: what is loaded ends 10 km from the point, wherever the origin is."""
    source = spark.createDataFrame(row_of_houses(2_000, step=20_000), BOX)
    run = Run(spark, source, spark.createDataFrame([(1, 1, 20_000_000, 0)], "scenario_id bigint, point_id bigint, x bigint, y bigint"))
    e = run.stage(2)["extents"].first()
    assert (e.minx, e.maxx) == (10_000_000, 30_000_000) and (e.miny, e.maxy) == (-3_000_000, 3_000_000)


# merging


def test_triangle_around_a_wide_middle(spark):
    """1 km of b, 500 m beside a gap of 1.1 km: a and c are farther apart than a side may be."""
    from cubitgrid.operators import merge as M

    middle = [(1, 30 + i, 30, 50_000 + i * 100_000, 600_000, 150_000 + i * 100_000, 620_000) for i in range(10)]
    buildings = spark.createDataFrame([(1, 10, 10, -20_000, 0, 0, 100_000), (1, 11, 10, -90_000, 0, -70_000, 100_000), (1, 20, 20, 1_100_000, 0, 1_120_000, 100_000), *middle], "scenario_id bigint, building_id bigint, cluster bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    now = S.Settings()
    links = lambda rows: {(r.a, r.b) for r in M.triangle_links(C.summary(rows, 0), rows, GAP, now.mm(S.TRIANGLE_SIDE), now.mm(S.TRIANGLE_SPAN)).collect()}
    assert links(buildings) == {(10, 20), (10, 30)}
    other = spark.createDataFrame([(1, 40, 40, 500_000, 40_000, 520_000, 60_000)], buildings.schema)
    assert links(buildings.unionByName(other)) & {(10, 20), (10, 30)} == set()


def test_corridors_in_every_direction(spark):
    """a and c beside, above and oblique to each other, with b in a recess beyond the ends of the shortest line."""
    from cubitgrid.operators import merge as M

    box = lambda k, *xy: (k // 10, k, *xy)
    rows = [box(10, 0, 0, 10, 10), box(11, 0, 50, 10, 60), box(12, 30, 20, 40, 30), box(13, 30, 70, 40, 80)]
    rows += [box(20, 0, 0, 10, 10), box(21, 50, 50, 60, 60), box(22, 40, 10, 50, 20), box(23, -30, -30, -20, -20), box(24, 8, -10, 12, 1)]
    rows += [box(30, 0, 50, 10, 60), box(31, 50, 0, 60, 10), box(32, 40, 40, 50, 50)]
    cities = spark.createDataFrame(rows, "scenario_id bigint, cluster bigint, minx bigint, miny bigint, maxx bigint, maxy bigint")
    got = {(r.a, r.c, r.b) for r in M.corridors(cities, 200).collect()}
    assert (10, 11, 12) in got and (10, 11, 13) not in got
    assert {(20, 21, 22), (20, 21, 24)} <= got and (20, 21, 23) not in got
    assert (30, 31, 32) in got


def test_swallowed_cities_around_every_city(spark, tmp_path):
    """Equal to the query's SQL without its limit to three cities, where a scenario has more than three."""
    import duckdb

    from cubitgrid.plans import boundary_queries as Q

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("orders", "nation", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, other = Q.havlaah_rects(spark, d), con.execute(Q.ORACLE_SQL["havlaah_rects"].replace("where number <= 3", ""))
    names = [c[0] for c in other.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(other.fetchall())


def test_neighbours_of_a_hub_meet_in_parts(spark):
    """A middle of 700 neighbours, one of them as wide as all, beside a small one: all pairs near enough, each once."""
    import numpy as np

    from cubitgrid.operators import merge as M

    g = np.random.default_rng(5)
    at = [(int(x), int(y)) for x, y in g.integers(-2_000_000, 2_000_000, (700, 2))]
    rows = [(1, 1, 90_000.0, 100 + k, x, y, x + 9_000, y + 7_000) for k, (x, y) in enumerate(at)] + [(1, 1, 90_000.0, 50, -2_000_000, 0, 2_000_000, 60_000)]
    rows += [(1, 2, 5_000.0, 100 + k, x, y, x + 9_000, y + 7_000) for k, (x, y) in enumerate(at[:9])]
    ab = spark.createDataFrame(rows, "scenario_id bigint, b bigint, diagonal double, cluster bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    gap = lambda p, q: np.hypot(max(0, q[4] - p[6], p[4] - q[6]), max(0, q[5] - p[7], p[5] - q[7]))
    want = sorted((p[1], p[3], q[3]) for p in rows for q in rows if p[1] == q[1] and p[3] < q[3] and gap(p, q) <= 100_000 + p[2] + 1)
    for dealt in (M.DEALT, 64):
        assert sorted((r.b, r.a, r.c) for r in M.around_middles(ab, 100_000, dealt).collect()) == want
    assert len(want) > 1_000 and any(a == 50 for _, a, _ in want)
