"""Steps that meet many pairs: no sort of the pairs, few rows shuffled."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F
from support import DATA

from penumbra.functions import geo
from penumbra.operators import generations, preference, sequences, snap, suntimes, walkability
from penumbra.plans import catalogue

EDGE = "edge_id long, from_id long, to_id long, from_lon double, from_lat double, to_lon double, to_lat double"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_snapping_doesnt_sort_its_pairs_and_keeps_ties_and_repeats(spark):
    edges = spark.createDataFrame([(9, 1, 2, 0.0, 0.0, 0.001, 0.0), (3, 1, 4, 0.0, 0.0, 0.0, 0.001), (5, 2, 1, 0.001, 0.0, 0.0, 0.0)], EDGE)
    points = spark.createDataFrame([(1, 0.0002, 0.0002), (2, 0.0005, 0.0001), (3, 0.0009, 0.0003), (3, 0.0008, 0.0001), (4, 1.0, 1.0), (5, None, 0.0)], "p long, lon double, lat double")
    found = snap.nearest_edge(points, edges, "p", 100.0)
    assert {r.p: (r.edge_id, round(r.t, 6)) for r in found.collect()} == {1: (3, 0.2), 2: (5, 0.5), 3: (5, 0.2)}
    assert "HashAggregate" in plan(found)  # a least struct a pair is a sort of all pairs


def test_islands_hold_no_table_of_rows(spark):
    rows = [(1, x) for x in (5, 3, 4, 4, 9, 9, 11, 12, 12, 3)] + [(2, 7), (2, 7), (None, 1), (None, 2), (1, None)]
    made = sequences.encode_islands(spark.createDataFrame(rows, "k long, x long"), ["k"], "x")
    assert sorted(map(tuple, made.collect()), key=str) == sorted([(1, 3, 5), (1, 9, 9), (1, 11, 12), (2, 7, 7), (None, 1, 2)], key=str)
    assert "Aggregate" not in plan(made)


def test_marginals_shuffle_a_short_row_a_person_and_block_of_nodes(spark):
    rows = spark.createDataFrame([(u, 0.3 * u, 0.1, -0.2, u % 2) for u in (1, 1, 2, 3)], "u long, sun_gap double, tree_gap double, shade_gap double, picked int")
    points = [preference.Hyper(2.5, 2.0, 0.4, 0.6), preference.Hyper(2.0, 1.7, 0.5, 0.5)]
    made = preference.marginals(rows, "u", points, 20)  # the second block isn't full
    told = {(r.u, r.point): r for r in made.collect()}
    for (u, i), r in told.items():
        p, sums = points[i], []
        for x, w in preference.quadrature(20):
            lp = 0.0
            for v in rows.where(f"u = {u}").collect():
                z = -(x * (v.sun_gap + p.rho * v.tree_gap) + v.shade_gap + (1 - p.rho) * v.tree_gap) / p.tau
                lp -= math.log1p(math.exp(-z if v.picked == 1 else z))
            sums.append((lp + p.shape * math.log(p.rate) - math.lgamma(p.shape) + (p.shape - 1) * math.log(x) - p.rate * x + w, x))
        total = sum(math.exp(v) for v, _ in sums)
        assert abs(r.log_m - math.log(total)) < 1e-9 and abs(r.weight - sum(math.exp(v) * x for v, x in sums) / total) < 1e-9
    assert len(told) == 6 and re.search(r"hashpartitioning\(u#\d+L, i#\d+, j#\d+", plan(made))


def test_altitudes_need_no_trace(spark):
    rows = [(i, float(i * 37 % 360 - 180), float(i * 29 % 170 - 85), 1767225600 + i * 86000) for i in range(40)]
    places = spark.createDataFrame(rows, "i long, lon double, lat double, s long").select("i", "lon", "lat", F.timestamp_seconds("s").alias("instant"))
    want = F.col("i") * 41 - 760  # beyond both ends, at samples and between
    made = suntimes.altitudes_at(places, "i", want)
    traced = suntimes.traces(places, "i").select("i", suntimes.value_at(F.col("trace"), want).alias("v"))
    expected = {r.i: r.v for r in traced.collect()}
    assert all(abs(r.altitude - expected[r.i]) < 1e-9 for r in made.collect()) and len(expected) == 40
    assert not re.search("Exchange|Generate", plan(made))


def test_files_of_a_generation_are_parsed_once(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 2, 1.0, 1.0)], "shard string, id long, lon double, lat double")
    edges = spark.createDataFrame([("a", 1, 2), ("b", 2, 7)], "shard string, from long, to long")
    generations.write_shards(generations.shard_lines(nodes, edges), f"{tmp_path}/g")
    files = generations.read_files(spark, f"{tmp_path}/g")
    found = generations.verify(files, generations.manifest(files))
    assert [tuple(r) for r in found.collect()] == [("b", "dangling")]
    assert plan(found).count("from_json") <= 1 + plan(generations.manifest(files)).count("from_json")


def test_rides_are_not_sent_to_all(spark):
    """Rides are made of stations, eighty of each: what a plan takes their size to be is far too small to send them through the driver."""
    text = catalogue.QUERIES["best_train_pair"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[from_id", text) and not re.search(r"BroadcastHashJoin \[from_id", text), text


def test_spans_of_rides_lose_no_pair(spark):
    rng = random.Random(4)
    spots = [(i, rng.random() * 0.02, rng.random() * 0.02) for i in range(40)]
    stations = spark.createDataFrame(spots, "station_id long, lon double, lat double")
    rides = spark.createDataFrame([(a, rng.randrange(40), rng.randrange(60, 900), rng.randrange(2, 6)) for a in range(38) for _ in range(4)], "from_id long, to_id long, seconds int, stations int")
    points = spark.createDataFrame([(i, rng.random() * 0.02, rng.random() * 0.02) for i in range(60)], "point_id long, lon double, lat double")
    trips = spark.createDataFrame([(i, i, (i * 7 + 3) % 60) for i in range(60)], "trip_id long, origin_id long, target_id long")
    plain = walkability.nearest_stations(points, stations, 3, 900.0)
    spans = walkability.nearest_stations(points, walkability.ride_spans(stations, rides), 3, 900.0, None, ["to_low", "to_high"])
    assert sorted(map(tuple, spans.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    expected = sorted(map(tuple, walkability.best_pair(trips, plain, plain, rides).collect()))
    assert expected and sorted(map(tuple, walkability.best_pair(trips, spans, spans, rides).collect())) == expected


def _shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_edges_by_a_pole_meet_few_cells(spark):
    """A degree of longitude is short there: cells of one width in degrees would repeat an edge for hundreds of them."""
    edges = [(i, i, i + 1, i * 0.01, 89.9 + i % 7 * 0.01, i * 0.01 + 0.01, 89.9 + i % 7 * 0.01) for i in range(300)]
    points = [(i, i * 0.011, 89.9 + i % 5 * 0.011) for i in range(200)] + [(900, 1.0, 120.0)]
    rows = spark.createDataFrame(edges, EDGE)
    before = _shuffled(spark)
    found = {r.p: (r.edge_id, round(r.distance, 4)) for r in snap.nearest_edge(spark.createDataFrame(points, "p long, lon double, lat double"), rows, "p", 150.0).collect()}
    assert _shuffled(spark) - before < 20 * (len(edges) + len(points))

    def metres(lon, lat, x, y):
        a, b = math.radians(lat), math.radians(y)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x - lon) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    expected = {}
    for p, lon, lat in points:
        for e, _, _, ax, ay, bx, by in edges:
            t = max(0.0, min(1.0, ((lon - ax) * (bx - ax) + (lat - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            d = metres(lon, lat, ax + t * (bx - ax), ay + t * (by - ay))
            if d <= 150:
                expected[p] = min(expected.get(p, (math.inf, 0)), (round(d, 6), e))
    assert found == {p: (e, round(d, 4)) for p, (d, e) in expected.items()} and len(found) > 50
