"""Rings, covers, places along lines, walking, structures, sweeps, generations, time and fits on small cases."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.functions import clock
from penumbra.operators import covers, generations, linear, preference, rings, signatures, structure, suntimes, sweep, walkability

RING = "id string, ring array<struct<x:double,y:double>>"


def test_rings_are_cleaned_or_refused(spark):
    nan = float("nan")
    square = [(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01)]
    cases = {
        "open": (square, None, 5, True), "closed": ([*square, square[0]], None, 5, False), "twice": ([p for p in square for _ in "ab"], None, 5, True),
        "off the globe": ([*square, (200.0, 0.0), (nan, 1.0), (0.0, float("inf"))], None, 5, True), "bow-tie": ([square[0], square[2], square[1], (0.0, 0.02)], "crossing", None, True),
        "spike": ([(0.0, 0.0), (0.02, 0.0), (0.02, 0.02), (0.01, 0.0), (0.0, 0.02)], "crossing", None, True), "line": ([(0.0, 0.0), (0.01, 0.0)], "too_few", None, False),
        "empty": ([], "too_few", None, False), "sliver": ([(0.0, 0.0), (1e-6, 0.0), (1e-6, 1e-6)], "sliver", None, True), "triangle": (square[:3], None, 4, True),
    }
    frame = spark.createDataFrame([(k, c[0]) for k, c in cases.items()], RING)
    found = {r.id: (r.refused, r.ring and len(r.ring), r.repaired) for r in rings.repair(frame, "id").collect()}
    assert found == {k: (c[1], c[2], c[3]) for k, c in cases.items()}
    assert rings.repair(frame.limit(0), "id").count() == 0
    assert rings.repair(spark.createDataFrame([("none", None)], RING), "id").collect()[0].ring is None


def test_crossings_of_a_large_ring(spark):
    n = 3000
    circle = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    knot = list(circle)
    knot[10], knot[11] = knot[11], knot[10]
    frame = spark.createDataFrame([("fine", [*circle, circle[0]]), ("knot", [*knot, knot[0]])], RING)
    assert [r.id for r in rings.crossings(frame, "id").collect()] == ["knot"]


def test_short_and_long_rings_are_tested_alike(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(60):
        n = rng.randint(3, 9)
        turn = sorted(rng.random() for _ in range(n)) if i % 3 else [rng.random() for _ in range(n)]
        ring = [(math.cos(2 * math.pi * t), math.sin(2 * math.pi * t)) for t in turn]
        rows.append((f"r{i}", [*ring, ring[0]]))
    frame = spark.createDataFrame(rows, RING)
    found = []
    for few in (rings.FEW_SIDES, 5, 0):  # in their row, both ways, by cells
        monkeypatch.setattr(rings, "FEW_SIDES", few)
        found.append(sorted(r.id for r in rings.crossings(frame, "id").collect()))
    assert found[0] == found[1] == found[2] and 10 < len(found[0]) < 30
    assert all(int(i[1:]) % 3 == 0 for i in found[0])


def test_assembly_in_any_order_and_direction(spark):
    rng, rows, area = random.Random(3), [], {}
    for relation, n in enumerate([1, 2, 3, 4, 17, 40]):
        turn = [2 * math.pi * i / (3 * n) for i in range(3 * n)]
        points = [(relation * 10 + math.cos(t), math.sin(t)) for t in turn]
        area[relation] = 3 * n / 2 * math.sin(2 * math.pi / (3 * n))
        ways = [[points[(3 * i + j) % (3 * n)] for j in range(4)] for i in range(n)]
        names = rng.sample(range(100), n)
        rows += [(relation, w, p if rng.random() < 0.5 else p[::-1]) for w, p in zip(names, ways, strict=True)]
    rows += [(90, 1, [(0.0, 0.0), (1.0, 0.0)]), (90, 2, [(1.0, 0.0), (1.0, 1.0)]), (91, 1, [(5.0, 5.0)])]
    rows += [(92, i, p) for i, p in enumerate([[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (0.0, 1.0)], [(0.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (9.0, 9.0)]])]
    frame = spark.createDataFrame(rows, "relation_id int, way_id int, points array<struct<x:double,y:double>>").repartition(4)
    found = {r.relation_id: r for r in rings.assemble(frame).collect()}
    assert {k: r.status for k, r in found.items()} == {**{k: "closed" for k in area}, 90: "open", 92: "branching"}
    for k, a in area.items():
        ring = [(p.x, p.y) for p in found[k].ring]
        assert ring[0] == ring[-1] and len(ring) == 3 * found[k].ways + 1 and len(set(ring)) == len(ring) - 1
        assert abs(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) / 2) - a) < 1e-9
    assert found[90].ring is None


def test_small_and_large_relations_are_put_together_alike(spark, monkeypatch):
    rng, rows, point = random.Random(7), [], lambda i: (float(i), 0.5)
    for relation in range(40):
        # Several rings and chains a relation, with loops of one way, spurs and, in some, a way named twice.
        at, ways = 0, []
        for n in rng.choices(range(1, 6), k=rng.randint(1, 4)):
            ways += [[point(at + i), point(at + i + 0.5), point(at + (i + 1) % n)] for i in range(n)]
            at += n
        del ways[rng.randint(1, 9) :: 9]
        if relation % 4 == 1:
            ways.append([point(0), point(-1)])
        named = [(relation, w, q if rng.random() < 0.5 else q[::-1]) for w, q in zip(rng.sample(range(99), len(ways)), ways, strict=True)]
        rows += named + (named[:1] if relation % 9 == 8 else [])
    rows += [(50, 1, [None, point(1)]), (50, 2, [point(1), point(2)]), (51, None, [point(1), point(2)]), (51, 1, [point(2), point(1)]), (None, 1, [point(1), point(1)])]
    nan = float("nan")
    rows += [(52, 1, [(nan, 0.0), point(1)]), (52, 2, [point(1), (nan, -0.0)])]
    frame = spark.createDataFrame(rows, "relation_id int, way_id int, points array<struct<x:double,y:double>>").repartition(4)
    found = []
    for few in (rings.FEW_WAYS, 3, 0):  # in a row each, both ways, by joins
        monkeypatch.setattr(rings, "FEW_WAYS", few)
        found.append(sorted(repr(r) for r in rings.assemble(frame).collect()))
    assert found[0] == found[1] == found[2]
    assert all(sum(f"'{status}'" in r for r in found[0]) > 5 for status in ("closed", "open", "branching"))


def test_tiles_of_a_polygon_with_a_hole(spark):
    zoom = 10
    deg = 360 / 2**zoom
    x0, x1 = 512.2, 517.8
    box = lambda a, b: [(v * deg - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * w / 2**zoom))))) for v, w in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    shapes = [(1, [box(x0, x1), box(513.5, 516.5)]), (2, [box(600.0, 600.4)]), (3, [])]
    frame = spark.createDataFrame(shapes, "polygon_id int, rings array<array<struct<x:double,y:double>>>")
    found = [(r.polygon_id, r.x, r.y) for r in covers.polygon_tiles(frame, zoom).collect()]
    ring = range(512, 518)
    hole = {(x, y) for x in (514, 515) for y in (514, 515)}
    assert len(found) == len(set(found))
    assert {(x, y) for k, x, y in found if k == 1} == {(x, y) for x in ring for y in ring} - hole
    assert {(x, y) for k, x, y in found if k == 2} <= {(x, y) for x in (599, 600) for y in (599, 600)}


def test_coarsest_level_that_is_fine_enough(spark):
    levels = spark.createDataFrame([("a", 0, 0.5, 2.0), ("a", 1, 1.9, 2.0), ("a", 2, 3.0, 2.0), ("b", 0, 4.0, 2.0), ("b", 1, 8.0, 2.0)], "k string, level int, res double, target double")
    assert sorted((r.k, r.level) for r in covers.coarsest(levels, ["k"], "res", "target").collect()) == [("a", 1), ("b", 0)]


def test_slices_forward_only_and_points_along(spark):
    line = [(0.0, 0.0), (0.01, 0.0), (0.02, 0.0), (0.03, 0.0), (0.02, 0.0005)]
    shapes = spark.createDataFrame([("s", line), ("point", line[:1]), ("empty", [])], "shape_id string, points array<struct<lon:double,lat:double>>")
    rides = [("on", "s", 0.005, 0.0, 0.025, 0.0), ("back", "s", 0.025, 0.0, 0.005, 0.0), ("same", "s", 0.012, 0.0, 0.018, 0.0), ("spot", "s", 0.012, 0.0, 0.012, 0.0), ("no shape", "x", 0.0, 0.0, 0.01, 0.0), ("short", "point", 0.0, 0.0, 0.01, 0.0)]
    frame = spark.createDataFrame(rides, "edge_id string, shape_id string, from_lon double, from_lat double, to_lon double, to_lat double")
    found = {r.edge_id: (r.interior and [p.lon for p in r.interior], r.metres and round(r.metres)) for r in linear.slices(frame, shapes).collect()}
    assert found["on"] == ([0.01, 0.02], 2224) and found["same"] == ([], 667)
    assert found["back"] == found["spot"] == found["no shape"] == found["short"] == (None, None)
    at = shapes.select("shape_id", linear.with_distances(F.col("points")).alias("l")).select("shape_id", *(linear.point_at(F.col("l"), F.lit(m)).alias(n) for n, m in (("a", -5.0), ("b", 1111.9492664), ("c", 1e6))))
    rows = {r.shape_id: r for r in at.collect()}
    assert rows["s"].a.lon == 0.0 and abs(rows["s"].b.lon - 0.01) < 1e-9 and rows["s"].c.lat == 0.0005
    assert rows["point"].c.lon == rows["point"].a.lon == 0.0 and rows["empty"].a is None


def test_readings_of_zones_against_another_calendar(spark):
    rng, rows = random.Random(1), []
    zones = ["America/New_York", "Europe/Madrid", "Australia/Lord_Howe", "Asia/Kolkata", "UTC"]
    for zone in zones:
        for day in [8, 9, 67, 68, 304, 305, 306, 90, 300, 95, 277, *rng.sample(range(365), 10)]:
            rows.append((zone, 2026, rng.choice([0, 0, 12, -2]), day, rng.randrange(0, 26), rng.randrange(60)))
    frame = spark.createDataFrame(rows, "zone string, y int, m int, d int, h int, i int")
    got = frame.select("*", F.unix_seconds(clock.instant_of(*map(F.col, ("zone", "y", "m", "d", "h", "i")))).alias("t")).collect()
    for r in got:
        year, month = r.y + r.m // 12, r.m % 12 + 1
        plain = datetime(year, month, 1, tzinfo=timezone.utc) + timedelta(days=r.d - 1, hours=r.h, minutes=r.i)
        offset = lambda t, r=r: t.astimezone(ZoneInfo(r.zone)).utcoffset()
        guess = plain - offset(plain)
        assert r.t == int((plain - offset(guess)).timestamp())
    # A reading that the clock shows comes back as that reading.
    t = datetime(2026, 7, 1, 13, 30, tzinfo=ZoneInfo("America/New_York"))
    one = spark.range(1).select(F.unix_seconds(clock.instant_of(F.lit("America/New_York"), F.lit(2026), F.lit(6), F.lit(1), F.lit(13), F.lit(30))).alias("t")).first().t
    assert one == int(t.timestamp())


def test_sun_times_of_known_days(spark):
    rows = [("equator", 0.0, 0.0, datetime(2026, 3, 20, 15)), ("pole", 0.0, 85.0, datetime(2026, 6, 21, 12)), ("dark", 20.0, 80.0, datetime(2026, 12, 21, 12)), ("ny", -74.0, 40.7, datetime(2026, 6, 21, 3))]
    frame = spark.createDataFrame([(k, a, b, t.replace(tzinfo=timezone.utc)) for k, a, b, t in rows], "id string, lon double, lat double, instant timestamp")
    found = {r.id: r for r in suntimes.rise_and_set(frame, "id").collect()}
    assert found["pole"].sunrise is None and found["dark"].sunset is None
    day = (found["equator"].sunset - found["equator"].sunrise).total_seconds()
    assert abs(day - 12 * 3600 - 400) < 120
    # New York on the solar day of June 20: up at 05:25, down at 20:30 by the clock there, four hours behind.
    ny = found["ny"]
    assert abs((ny.sunset - ny.sunrise).total_seconds() - (15 * 3600 + 5.5 * 60)) < 180


def test_verifier_finds_nothing_in_a_sound_generation(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1.0, 0.5), ("b", 2, 1.0, 0.5), ("b", 3, 2.0, 2.0)], "shard string, id long, lon double, lat double")
    edges = spark.createDataFrame([("a", 1, 2), ("b", 2, 3)], "shard string, from long, to long")
    generations.write_shards(generations.shard_lines(nodes, edges), f"file://{tmp_path}/g")
    files = generations.read_files(spark, f"file://{tmp_path}/g")
    claimed = generations.manifest(files)
    assert generations.verify(files, claimed).count() == 0
    assert {tuple(r) for r in generations.verify(files, claimed.limit(0)).collect()} == {("a", "unclaimed"), ("b", "unclaimed")}
    assert {tuple(r) for r in generations.verify(files.limit(0), claimed).collect()} == {("a", "missing"), ("b", "missing")}


def test_signatures_against_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 12)) * 4
    x = base[rng.integers(0, 3, 600)] + rng.normal(size=(600, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [1.0]), (702, [float("nan")] * 12), (703, [])]
    frame = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
    model = signatures.fit(frame, "v", 4, 3, "id")
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(model.explained, values[::-1][:4] / values.sum(), atol=1e-6)
    for part, true in zip(model.components, vectors[:, ::-1].T, strict=False):
        assert abs(abs(part @ true) - 1) < 1e-6 and part[np.abs(part).argmax()] > 0
    z = (x - x.mean(0)) @ model.components.T
    near = ((z[:, None] - model.centres[None]) ** 2).sum(2).argmin(1)
    assert np.bincount(near).tolist() == model.sizes.tolist() and sorted(model.sizes.tolist(), reverse=True) == model.sizes.tolist()
    assert np.allclose([z[near == k].mean(0) for k in range(3)], model.centres, atol=1e-6)
    again = signatures.fit(frame.repartition(2), "v", 4, 3, "id")
    assert np.allclose(model.centres, again.centres, atol=1e-9)
    unit = rng.random((50, 12))
    small = signatures.SignatureModel(unit.mean(0), model.components, model.explained, model.centres, model.sizes, 0.0)
    assert (np.abs((unit - unit.mean(0)) @ small.components.T) <= 127 * small.scales + 1e-9).all()
    cells = signatures.stratified(spark.createDataFrame([(i % 3 if i < 90 else 9, i) for i in range(93)], "cell int, id int"), "cell", 5, "id")
    assert {r.cell: r["count"] for r in cells.groupBy("cell").count().collect()} == {0: 5, 1: 5, 2: 5, 9: 3}


def test_an_unresolved_cell_ends_the_job(spark):
    edges = spark.createDataFrame([(1, "a", 0.0, 0.0, 50.0, 0.0), (2, "b", 0.0, 0.0, 50.0, 0.0)], "edge_id int, cell string, ax double, ay double, bx double, by double")
    wall = [(15.0, -30.0), (30.0, -30.0), (30.0, -20.0), (15.0, -20.0)]
    prisms = spark.createDataFrame([(1, wall, 60.0, None)], "prism_id int, ring array<struct<x:double,y:double>>, height double, opacity double")
    suns = spark.createDataFrame([(c, 0, 180.0, 45.0) for c in "ab"] + [(c, 1, 0.0, 45.0) for c in "ab"] + [(c, 2, 0.0, -3.0) for c in "ab"], "cell string, slot int, azimuth double, altitude double")
    known = spark.createDataFrame([("a",)], "cell string")
    with pytest.raises(Exception, match="unresolved: cell b, segment 2"):
        sweep.shade_cells(edges, prisms, suns, known).collect()
    rows = {(r.side, r.slot): r.shade_byte for r in sweep.shade_cells(edges.where("cell = 'a'"), prisms, suns, known).collect()}
    assert rows["left", 2] == rows["right", 2] == 255 and rows["left", 1] == rows["right", 1] == 0 and rows["left", 0] == rows["right", 0] == 64
    table = sweep.shade_cells(edges.where("cell = 'a'"), prisms, suns, known)
    pack = sweep.packed(table)
    assert [bytes(r.payload) for r in pack.collect()] == [bytes([64, 64, 0, 0, 255, 255])]
    assert sorted(map(tuple, sweep.unpacked(pack).collect())) == sorted(map(tuple, table.collect()))


def test_a_point_inside_a_wall_s_ring_is_not_shaded_by_it(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    prisms = spark.createDataFrame([(1, ring, 100.0, None), (2, [(20.0, 0.0), (22.0, 0.0), (22.0, 10.0), (20.0, 10.0)], 100.0, 0.6)], "prism_id int, ring array<struct<x:double,y:double>>, height double, opacity double")
    points = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, -5.0, 5.0), (3, 0, 15.0, 5.0), (4, 0, 500.0, 5.0)], "id int, cell int, x double, y double")
    east = spark.createDataFrame([(0, 0, 90.0, 30.0)], "cell int, slot int, azimuth double, altitude double")
    assert {r.id: r.opacity for r in sweep.sweep(points, prisms, east, ["id"]).collect()} == {1: 0.6, 2: 1.0, 3: 0.6}


def test_structures_by_tags_and_relations(spark):
    tags = lambda **t: t
    line = lambda y: [(0.0, y), (0.01, y)]
    ways = [(1, tags(tunnel="yes"), line(0.0)), (2, tags(bridge="no"), line(0.0005)), (3, tags(railway="platform"), line(0.0)), (4, tags(bridge="yes"), line(0.0001)), (5, tags(), [(0.0, 0.0)])]
    relations = [(tags(ref="A"), [("way", 1), ("way", 3), ("way", 5), ("node", 2)]), (tags(ref="B", operator="The Port AUTHORITY"), [("way", 4)]), (tags(ref="C"), [("way", 2), ("way", 1)]), (tags(), [("way", 4)])]
    w = spark.createDataFrame(ways, "way_id long, tags map<string,string>, points array<struct<lon:double,lat:double>>")
    r = spark.createDataFrame(relations, "tags map<string,string>, members array<struct<type:string,ref:long>>")
    laid = structure.service_ways(r, w, "port authority")
    assert sorted((x.ref, x.way_id, x.structure) for x in laid.collect()) == [("A", 1, "underground"), ("C", 1, "underground"), ("C", 2, "at_grade")]
    rides = spark.createDataFrame([(1, "A", 0.0, 0.0, 0.01, 0.0), (2, "AX", 0.0, 0.0, 0.02, 0.0), (3, "B", 0.0, 0.0, 0.01, 0.0), (4, "C", 0.0, 0.0004, 0.01, 0.0004)], "edge_id int, ref string, from_lon double, from_lat double, to_lon double, to_lat double")
    found = {}
    for x in structure.shares(rides, laid, {"AX": "A"}).collect():
        found.setdefault(x.edge_id, {})[x.structure] = (round(x.share, 2), x.determined)
    assert found[1] == {"underground": (1.0, True)} and found[3] == {"unknown": (1.0, False)} and found[4] == {"at_grade": (1.0, True)}
    assert set(found[2]) == {"underground", "unknown"} and abs(sum(s for s, _ in found[2].values()) - 1) < 0.011 and found[2]["unknown"][1]


def test_walks_between_doors_and_stops(spark):
    segments = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.002, 0.0), (2, 3, 0.002, 0.0, 0.002, 0.002), (8, 9, 0.0, 0.01, 0.002, 0.01)], "from_id long, to_id long, from_lon double, from_lat double, to_lon double, to_lat double")
    doors = [("in", "s", 0.0005, 0.00005, False), ("out", "s", 0.0019, 0.00005, True), ("far", "t", 0.001, 0.005, False), ("isle", "u", 0.001, 0.01, False)]
    rooms = spark.createDataFrame(doors, "door_id string, station_id string, lon double, lat double, exit_only boolean")
    rows = [
        ("leave", "s", 0.0005, 0.0, "p", 0.00205, 0.001, True), ("enter", "s", 0.0005, 0.0, "p", 0.00205, 0.001, False), ("none", "x", 0.0, 0.0, "p", 0.00205, 0.001, True),
        ("off", "s", 0.0005, 0.0, "q", 0.0021, 0.006, True), ("doors", "t", 0.0, 0.0, "p", 0.00205, 0.001, True), ("round", "u", 0.0, 0.0, "p", 0.00205, 0.001, True),
    ]
    frame = spark.createDataFrame(rows, "transfer_id string, station_id string, station_lon double, station_lat double, stop_id string, stop_lon double, stop_lat double, leaving boolean")
    found = {r.transfer_id: (r.walk_m, r.refused) for r in walkability.walks(frame, rooms, segments).collect()}
    m = 111_195
    # From the station's point to the door, onto the path, along it, and off to the stop.
    assert found["leave"][0] == pytest.approx((0.0014 + 0.00005 + 0.0001 + 0.001 + 0.00005) * m, abs=3)
    assert found["enter"][0] == pytest.approx((0.00005 + 0.00005 + 0.0015 + 0.001 + 0.00005) * m, abs=3)
    assert {k: v[1] for k, v in found.items()} == {"leave": None, "enter": None, "none": "no_door", "off": "stop_off_network", "doors": "doors_off_network", "round": "detour"}


def test_planted_parameters_of_choices_are_found_again(spark):
    """Choices of 200 people drawn from known parameters; the integral against a fine sum, and the fit within its own errors."""
    rng = np.random.default_rng(12)
    true, rows = preference.Hyper(4.0, 3.0, 0.4, 0.25), []
    for person in range(200):
        beta = rng.gamma(true.shape, 1 / true.rate)
        for _ in range(12):
            sun, tree, shade = rng.normal(size=3) * [1.0, 0.8, 1.0]
            z = -(beta * (sun + true.rho * tree) + shade + (1 - true.rho) * tree) / true.tau
            rows.append((person, float(sun), float(tree), float(shade), int(rng.random() < 1 / (1 + math.exp(-z)))))
    frame = spark.createDataFrame([*rows, (1, None, 0.0, 0.0, 1)], "person int, sun_gap double, tree_gap double, shade_gap double, picked int")
    own = [r for r in rows if r[0] == 7]
    fine = np.linspace(*preference.WEIGHTS, 200_001)
    lp = true.shape * math.log(true.rate) - math.lgamma(true.shape) + (true.shape - 1) * np.log(fine) - true.rate * fine
    for _, sun, tree, shade, y in own:
        z = -(fine * (sun + true.rho * tree) + shade + (1 - true.rho) * tree) / true.tau
        lp -= np.logaddexp(0, -z if y else z)
    log_m = float(np.log(np.trapezoid(np.exp(lp - lp.max()), fine)) + lp.max())
    got = preference.marginals(frame.where("person = 7"), "person", [true], 80).first()
    assert abs(got.log_m - log_m) < 1e-4
    fit = preference.fit_hierarchical(frame, "person", nodes=16, rounds=30, tolerance=1e-2)
    gaps = (preference._free(fit.at) - preference._free(true)) / np.array(fit.errors)
    assert np.abs(gaps).max() < 3.5 and 0 < max(fit.errors) < 1.5
    assert fit.log_posterior >= preference.log_posterior(frame.where("sun_gap is not null"), "person", [true], 16)[0] - 0.5


def test_sun_that_grazes_the_horizon_rises_and_sets(spark):
    """Short nights, some of which lie between two samples of the coarse trace; all minutes of the day as the measure."""
    rows = [(i, 9.0, 69.8 + i * 0.005, datetime(2026, 7, 26, 12, tzinfo=timezone.utc)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, lon double, lat double, instant timestamp")

    def passes(step):
        found = {}
        for r in suntimes.traces(frame, "id", step).collect():
            pairs = [(a.at, a.altitude < suntimes.RISE_DEG, b.altitude < suntimes.RISE_DEG) for a, b in zip(r.trace, r.trace[1:])]
            found[r.id] = any(at < 0 and a and not b for at, a, b in pairs) and any(at >= 0 and b and not a for at, a, b in pairs)
        return found

    minutes, quarters = passes(1), passes(15)
    assert any(minutes[i] and not quarters[i] for i in minutes) and not all(minutes.values())
    assert {r.id: r.sunrise is not None for r in suntimes.rise_and_set(frame, "id").collect()} == minutes
