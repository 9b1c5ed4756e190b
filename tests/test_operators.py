"""Small hand-made cases: boundaries, nulls, ties, empty tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from penumbra.functions import clock, exposure, geo
from penumbra.operators import clean, graph, preference, sequences, shade, snap, spatial, stats, temporal, topk, transit
from penumbra.sources import exports, gtfs
from penumbra.streaming import stateful


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_headway_of_four_departures(spark):
    rows = spark.createDataFrame([("A", 28800 + 600 * i, "WD") for i in range(4)] + [("B", 100, "WD")], "route string, dep int, service string")
    assert [tuple(r) for r in transit.headways(rows, ["route"], "dep", "service").collect()] == [("A", 8, 600.0, 4, 1)]


def test_headway_counts_a_second_once(spark):
    rows = spark.createDataFrame([("A", t, s) for t in (0, 60, 120, 180) for s in ("x", "y")], "route string, dep int, service string")
    got = transit.headways(rows, ["route"], "dep", "service").first()
    assert (got.headway_sec, got.departures, got.services) == (60.0, 4, 2)


def test_edge_median(spark):
    rows = [(f"t{i}", s, stop, at) for i, d in enumerate((300, 320, 310)) for s, stop, at in ((1, "A", 0), (2, "B", d))]
    got = transit.edge_medians(spark.createDataFrame(rows, "trip string, seq int, stop string, t int"), "trip", "seq", "stop", "t", [])
    assert [tuple(r) for r in got.collect()] == [("A", "B", 310, 3)]


def test_nearest_rank_and_floor(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "v double")
    assert stats.percentile_nearest_rank(rows, "v", [], {"p": 50}).first().p == 3.0
    assert stats.percentile_floor(rows, "v", [], {"p": 0.5}).first().p == 3.0
    assert stats.percentile_linear(rows, "v", [], {"p": 50}).first().p == 2.5


def test_unknown_breaks_runs_and_transitions(spark):
    rows = spark.createDataFrame([(1, i, s, 1.0) for i, s in enumerate([True, True, None, True, False])], "k int, i int, s boolean, w double")
    got = sequences.continuity(rows, ["k"], ["i"], F.col("s"), F.col("w")).first()
    assert (got.longest_protected, got.longest_exposed, got.unknown, got.transitions) == (2.0, 1.0, 1.0, 1)


def test_islands_round_trip(spark):
    rows = spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 9, 10, 2)] + [(1, None)], "k int, x long")
    islands = sequences.encode_islands(rows, ["k"], "x")
    assert sorted((r.x0, r.x1) for r in islands.collect()) == [(1, 3), (7, 7), (9, 10)]
    assert sequences.decode_islands(islands, ["k"], "x").count() == 6


def test_reject_takes_the_first_rule(spark):
    rows = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    good, counts = clean.reject(rows, [("low", F.col("v") < 2), ("small", F.col("v") < 9)])
    assert {r.reason: r.n for r in counts.collect()} == {"low": 1, "small": 1}
    assert good.count() == 1


def test_impute_falls_back(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    got = {(r.g, r.v_source): r.v for r in clean.impute_median(rows, "v", "g", 9.0).collect()}
    assert got == {("a", "measured"): 1.0, ("a", "group_median"): 1.0, ("b", "overall_median"): 1.0}
    none = clean.impute_median(rows.where("v is null"), "v", "g", 9.0)
    assert {r.v for r in none.collect()} == {9.0}


def test_skyline_ties_and_empty(spark):
    rows = spark.createDataFrame([(1, 1.0, 5), (2, 1.0, 5), (3, 1.0, 4), (4, 2.0, 5), (5, 2.0, 6), (6, None, 9)], "id int, low double, high int")
    assert sorted(r.id for r in topk.skyline(rows, "id", "low", "high").collect()) == [1, 2, 5]
    assert topk.skyline(rows.where("id > 9"), "id", "low", "high").count() == 0


def test_nearest_in_time_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 100.0), (2, 9999.0)], "id int, t double")
    right = spark.createDataFrame([(90.0, "x"), (110.0, "y"), (100.0, None)], "t double, v string")
    got = {r.id: (r.right_time, r.v) for r in temporal.nearest_in_time(left, right, "id", F.col("t"), F.col("t"), ["v"], 50.0, required="v").collect()}
    assert got == {1: (90.0, "x"), 2: (None, None)}


def test_geometry(spark):
    r = one(
        spark,
        geo.haversine(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("d"),
        geo.bearing(*map(F.lit, (0.0, 0.0, 1.0, 0.0))).alias("b"),
        geo.tile_west(geo.tile_x(F.lit(-73.98), 10), 10).alias("w"),
        geo.tile_north(geo.tile_y(F.lit(40.75), 10), 10).alias("n"),
    )
    assert math.isclose(r.d, 111194.9266, rel_tol=1e-6) and math.isclose(r.b, 90.0)
    assert r.w <= -73.98 < r.w + 360 / 1024 and r.n >= 40.75
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    r = one(spark, geo.ring_area(ring).alias("a"), geo.point_in_ring(F.lit(0.0), F.lit(1.0), ring).alias("i"), geo.point_in_ring(F.lit(2.0), F.lit(1.0), ring).alias("o"))
    assert (r.a, r.i, r.o) == (4.0, True, False)
    t0, t1 = geo.clip_segment(*map(F.lit, (-1.0, 1.0, 3.0, 1.0)), tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))))
    assert tuple(one(spark, t0.alias("a"), t1.alias("b"))) == (0.25, 0.75)
    t0, _ = geo.clip_segment(*map(F.lit, (-1.0, 5.0, 3.0, 5.0)), tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))))
    assert one(spark, t0.alias("a")).a is None
    inside = geo.point_in_triangle(F.lit(0.2), F.lit(0.2), (F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0)))
    assert one(spark, inside.alias("i")).i


def test_nearest_segment(spark):
    points = spark.createDataFrame([(1, 5.0, 1.0), (2, 50.0, 50.0)], "p int, x double, y double")
    segments = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 0.0), (8, 0.0, 3.0, 10.0, 3.0)], "s int, ax double, ay double, bx double, by double")
    assert [tuple(r) for r in spatial.nearest_segment(points, segments, "p", "s", 5.0).collect()] == [(1, 7, 0.5, 1.0)]


def test_clock(spark):
    r = one(spark, *[clock.service_seconds(F.lit(t)).alias(n) for n, t in (("a", "25:10:05"), ("b", "bad"), ("c", "100:00:00"))])
    assert (r.a, r.b, r.c) == (90605, None, 360000)
    assert one(spark, clock.slot_of_minute(F.lit(299)).alias("s"), clock.fraction_byte(F.lit(0.5)).alias("b")) == (0, 128)


def test_exposure_rules(spark):
    r = one(spark, exposure.felt_score(F.lit(29.0)).alias("s"), exposure.rain_angle(F.lit(9.0)).alias("r"), exposure.compass(F.lit(350.0)).alias("c"))
    assert r.s == 50.0 and math.isclose(r.r, 45.0) and r.c == "N"
    azimuth, altitude = exposure.sun_position(F.lit("2024-06-20 17:00:00").cast("timestamp"), F.lit(-74.0), F.lit(40.7))
    r = one(spark, azimuth.alias("az"), altitude.alias("al"))
    assert 70 < r.al < 74 and 160 < r.az < 200


def test_graph_components_and_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5)], "from_id long, to_id long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    reach = graph.reach(edges, spark.createDataFrame([(1,)], "source long"), 1)
    assert {(r.node, r.hops) for r in reach.collect()} == {(1, 0), (2, 1)}


def test_prism_shade_and_night(spark):
    ring = [(x, y) for x, y in ((10.0, -1.0), (12.0, -1.0), (12.0, 1.0), (10.0, 1.0))]
    prisms = spark.createDataFrame([(ring, 20.0, None)], "ring array<struct<x:double,y:double>>, height double, opacity double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 11.0, 0.0), (3, 30.0, 0.0), (4, 0.0, 5.0)], "id int, x double, y double")
    got = {r.id: r.shade for r in shade.prism_shade(points, prisms, 90.0, 45.0, ["id"]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.shade for r in shade.prism_shade(points, prisms, 90.0, -1.0, ["id"]).collect()} == {1.0}


def test_preference_recovers_a_weight(spark):
    rows = [("u", float(s), float(h)) for s in range(-300, 301, 60) for h in range(-300, 301, 60) if 2.0 * s + h < 0]
    fit = preference.fit_alpha(spark.createDataFrame(rows, "user string, sun_gap double, shade_gap double"), "user", prior_sd=2.0).first()
    assert 1.5 < fit.alpha < 6


def test_timetable_files(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name,stop_lat,stop_lon\n1,"A ""x"", B",40.5,-74\n2,C,bad,-74\n3,D,,1\n')
    good, bad = gtfs.read(spark, f"file://{tmp_path}", "stops")
    assert [(r.stop_id, r.stop_name) for r in good.collect()] == [("1", 'A "x", B')]
    assert {r.stop_id: r.problem for r in bad.collect()} == {"2": "stop_lat", "3": "stop_lat"}
    (tmp_path / "trips.txt").write_text("trip_id,route_id\n1,2\n")
    with pytest.raises(ValueError, match="service_id"):
        gtfs.read(spark, f"file://{tmp_path}", "trips")


def test_generations_tell_repeated_rows_apart_and_roll_back(spark, tmp_path):
    root, rows = f"file://{tmp_path}/r", lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    first, second = exports.publish(rows(1, 1), root), exports.publish(rows(2, 2), root)
    assert first != second and sorted(r.id for r in exports.current(spark, root, check=True).collect()) == [2, 2]
    assert exports.roll_back(spark, root) == first
    assert sorted(r.id for r in exports.current(spark, root).collect()) == [1, 1]
    rows(9).write.mode("append").parquet(f"{root}/generations/{first}")
    with pytest.raises(ValueError, match="content"):
        exports.current(spark, root, check=True)


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    first = exports.publish(spark.range(3), root)
    assert exports.publish(spark.range(3).repartition(2), root) == first
    exports.publish(spark.range(4), root)
    assert exports.current(spark, root).count() == 4


def test_track_text(spark):
    points = F.array(F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")))
    r = one(spark, exports.gpx(F.lit("a<b"), points).alias("g"), exports.geojson(points, F.struct(F.lit(1).alias("n"))).alias("j"))
    assert "a&lt;b" in r.g and 'lat="2.0000000"' in r.g and '"coordinates":[[1.0,2.0]]' in r.j


def test_limit_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("u", float(t)) for t in (0, 1, 2, 3, 70)], "user string, t double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user string, t double").parquet(f"{tmp_path}/in")
    query = stateful.rate_limited_stream(stream, "user", "t", 2, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r.accepted for r in spark.table("limited").orderBy("t").collect()] == [True, True, False, False, True]


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, 1.0D AS v FROM range(30)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/in")
    out = stateful.event_windows(stream, "ts", F.col("v"), [], "10 minutes", "10 minutes", "5 minutes")
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [r.n for r in spark.table("windows").orderBy("start").collect()] == [10, 10, 10]


def test_lines(spark):
    from penumbra.functions import lines

    frame = spark.createDataFrame([([[-120.2, 38.5], [-120.95, 40.7], [-126.453, 43.252]],), (None,)], "p array<array<double>>")
    texts = [r.t for r in frame.select(lines.encode_polyline("p").alias("t")).collect()]
    assert texts == ["_p~iF~ps|U_ulLnnqC_mqNvxq`@", None]  # the encoding's published example
    bad = spark.createDataFrame([("_p~iF",), ("\n",), ("",)], "t string").select(lines.decode_polyline("t").alias("p")).collect()
    assert [r.p for r in bad] == [None, None, []]
    walk = spark.createDataFrame([([[0.0, 0.0], [5.0, 0.1], [10.0, 0.0], [10.0, 9.0]],)], "p array<array<double>>")
    assert walk.select(lines.simplified(F.col("p"), 1.0).alias("k")).first().k == [0, 2, 3]


def test_chains_meet_at_plain_nodes_only(spark):
    edges = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 12, 14), (5, 20, 21)], "edge_id long, from_id long, to_id long")
    assert {r.edge_id: r.chain for r in graph.chains(edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_sun_consistent_instants(spark):
    from penumbra.operators import series

    at = F.lit("2023-06-21 15:00:00").cast("timestamp")
    azimuth, altitude = exposure.sun_position(at, F.lit(-74.0), F.lit(40.7))
    marks = spark.range(1).select(
        F.col("id").alias("mark_id"), F.lit(-74.0).alias("lon"), F.lit(40.7).alias("lat"), azimuth.alias("azimuth"), altitude.alias("altitude"), F.lit(2023).alias("year")
    )
    found = {(r.day, r.minute) for r in series.sun_consistent(marks).collect()}
    assert (171, 900) in found and all(abs(m - 900) <= 20 for _, m in found)


def test_feeds_and_parents(spark):
    a = spark.createDataFrame([("1", "A")], "stop_id string, name string")
    b = spark.createDataFrame([("1", "B"), ("2", "C")], "stop_id string, name string")
    assert {r.stop_id: r["name"] for r in transit.merge_feeds([a, b], "stop_id").collect()} == {"1": "A", "2": "C"}
    stops = spark.createDataFrame([("p", "P", None), ("c", "C", "p"), ("o", "O", "gone")], "stop_id string, stop_name string, parent_station string")
    got = {r.stop_id: (r.station_id, r.promoted) for r in transit.parent_stops(stops).collect()}
    assert got == {"p": ("p", False), "c": ("p", False), "o": ("o", True)}


def test_calendar_and_representative(spark):
    cal = spark.sql("SELECT 'WD' AS service_id, array(true,true,true,true,true,false,false) AS days, date'2024-01-01' AS start, date'2024-01-07' AS end")
    exc = spark.sql("SELECT 'WD' AS service_id, date'2024-01-06' AS day, 1 AS kind UNION ALL SELECT 'WD', date'2024-01-02', 2")
    days = sorted(str(r.day)[-2:] for r in transit.active_dates(cal, exc).collect())
    assert days == ["01", "03", "04", "05", "06"]


def test_cross_tile_box_pairs_once(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 3.0)], "q int, south double, west double, north double, east double")
    s = spark.createDataFrame([(7, 1.0, 1.0, 5.0, 5.0), (8, 4.0, 4.0, 5.0, 5.0)], "s int, south double, west double, north double, east double")
    assert [(r.q, r.s) for r in spatial.box_join(q, s, 1.0).collect()] == [(1, 7)]


def test_later_label_that_meets_shade_is_kept(spark):
    """The first way to node 1 is faster and less sunny, but ends the next edge in the sunny bucket."""
    edges = spark.createDataFrame(
        [(0, 1, 50.0, 0.0, [0.8, 0.8]), (0, 1, 60.0, 0.0, [0.75, 0.75]), (1, 2, 45.0, 0.0, [0.0, 1.0]), (2, 3, 50.0, 0.0, [1.0, 1.0])],
        "from_id long, to_id long, seconds double, shade double, series array<double>",
    )
    start = spark.createDataFrame([(0,)], "source long")
    labels = graph.label_search(edges, start, 200.0, sun_budget=30.0, bucket_seconds=100.0)
    assert {(r.node, r.seconds, round(r.sun, 6)) for r in labels.collect()} == {(0, 0.0, 0.0), (1, 50.0, 10.0), (1, 60.0, 15.0), (2, 105.0, 15.0), (3, 155.0, 15.0)}
    found = graph.reachable_edges(labels, edges, 200.0, 30.0, bucket_seconds=100.0)
    assert {(r.from_id, r.to_id) for r in found.collect()} == {(0, 1), (1, 2), (2, 3)}


def test_label_search_against_all_walks_with_buckets(spark):
    """On small random graphs: every edge that some walk within both budgets can take, each priced at its arrival."""
    import random

    rng = random.Random(7)
    rows = []
    for g in range(20):
        for _ in range(14):
            a, b = rng.sample(range(6), 2)
            series = [rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]) for _ in range(rng.randrange(4))] or None
            rows.append((g * 10 + a, g * 10 + b, float(rng.randrange(20, 60)), rng.choice([0.0, 0.5, 1.0]), series))
    expected = set()
    for g in range(20):
        walks = {(g * 10, 0.0, 0.0)}
        while walks:
            after = set()
            for node, t, sun in walks:
                for a, b, s, static, series in rows:
                    if a == node and t + s <= 220:
                        shade = series[min(int((t + s) // 70), len(series) - 1)] if series else static
                        if sun + s * (1 - shade) <= 60:
                            expected.add((g * 10, a, b))
                            after.add((b, t + s, sun + s * (1 - shade)))
            walks = after
    edges = spark.createDataFrame(rows, "from_id long, to_id long, seconds double, shade double, series array<double>")
    starts = spark.createDataFrame([(g * 10,) for g in range(20)], "source long")
    labels = graph.label_search(edges, starts, 220.0, sun_budget=60.0, bucket_seconds=70.0)
    found = graph.reachable_edges(labels, edges, 220.0, 60.0, bucket_seconds=70.0)
    assert {(r.source, r.from_id, r.to_id) for r in found.collect()} == expected


def test_percentiles_of_null_keys_and_null_values(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("b", 5.0)], "g string, v double")
    got = {r.g: r.m for r in stats.percentile_linear(rows, "v", ["g"], {"m": 50}).collect()}
    assert got == {None: 1.5, "a": None, "b": 5.0}
    assert {r.g: r.p for r in stats.percentile_nearest_rank(rows, "v", ["g"], {"p": 100}).collect()} == {None: 2.0, "b": 5.0}
    assert stats.summary(rows.where("v < 0"), "v", []).collect()[0].asDict() == {"n": 0, "mean": None, "p50": None, "p90": None, "worst": None}


def test_places_in_a_hot_and_a_null_key(spark):
    rows = spark.range(1000).selectExpr("case when id % 10 = 0 then null when id < 900 then 'hot' else 'b' end as k", "1000 - id as v")
    found = stats.number_rows(rows, ["k"], ["v"], "place", "size").collect()
    for key in (None, "hot", "b"):
        mine = sorted((r.v, r.place, r["size"]) for r in found if r.k == key)
        assert [m[1] for m in mine] == list(range(len(mine))) and {m[2] for m in mine} == {len(mine)}


def test_stops_move_to_the_largest_component(spark):
    lat = lambda metres: metres / 111320.0
    # Components {1, 2, 3}, 60 m north {4, 5}, and 900 m north {6, 7}; all edges run east along about 85 m.
    rows = [(1, 1, 2, 0.0, 0.0), (2, 2, 3, 0.001, 0.0), (3, 4, 5, 0.0, lat(60)), (4, 6, 7, 0.0, lat(900))]
    edges = spark.createDataFrame([(e, a, b, x, y, x + 0.001, y) for e, a, b, x, y in rows], "edge_id long, from_id long, to_id long, from_lon double, from_lat double, to_lon double, to_lat double")
    stops = [(1, 1, 0.0015, lat(5)), (1, 2, 0.0005, lat(50)), (1, 3, 0.0005, lat(890)), (1, 4, 0.5, 0.5), (2, 1, 0.0005, lat(50)), (2, 2, 0.0, lat(900)), (3, 1, None, 0.0)]
    found = snap.snap_stops(spark.createDataFrame(stops, "route long, at long, lon double, lat double"), edges, "route", "at").collect()
    got = {(r.route, r.at): (r.edge_id, r.status) for r in found}
    assert got == {
        (1, 1): (2, "kept"), (1, 2): (1, "moved"), (1, 3): (None, "too_far"), (1, 4): (None, "no_street"),
        (2, 1): (None, "too_far"), (2, 2): (4, "kept"), (3, 1): (None, "no_street"),
    }
    empty = snap.snap_stops(spark.createDataFrame([], "route long, at long, lon double, lat double"), edges, "route", "at")
    assert empty.count() == 0


def test_split_edges_share_the_length(spark):
    edges = spark.createDataFrame([(7, 1, 2, 0.0, 0.0, 0.001, 0.0, "brick")], "edge_id long, from_id long, to_id long, from_lon double, from_lat double, to_lon double, to_lat double, surface string")
    points = spark.createDataFrame([(0, 0.00025, 0.0001), (1, -0.0001, 0.0)], "p long, lon double, lat double")
    snaps = snap.nearest_edge(points, edges, "p", 100.0)
    assert {r.p: r.node for r in snaps.select("p", snap.snapped_node("p").alias("node")).collect()} == {0: -1, 1: 1}
    made = {(r.from_id, r.to_id): r for r in snap.split_edges(snaps, edges, "p").collect()}
    assert set(made) == {(-1, 1), (-1, 2), (1, -1), (2, -1)} and made[-1, 1].surface == "brick"
    assert abs(made[-1, 2].metres / made[-1, 1].metres - 3) < 1e-6


def test_radius_join_at_poles_and_date_line(spark):
    a = spark.createDataFrame([(1, 179.9999, 0.0), (2, 10.0, 89.9999), (3, None, 0.0), (4, 0.0, 80.0)], "a long, lon double, lat double")
    b = spark.createDataFrame([(1, -179.9999, 0.0), (2, -170.0, 89.9999), (4, 0.004, 80.0), (5, 1.0, 80.0)], "b long, lon double, lat double")
    assert {(r.a, r.b) for r in spatial.radius_join(a, b, 100.0).collect()} == {(1, 1), (2, 2), (4, 4)}
    far = snap.nearest_any(a, b.where("b = 5"), "a", "b", 100.0).collect()
    assert {(r.a, r.b) for r in far} == {(1, 5), (2, 5), (4, 5)}


def test_graph_keeps_steps_between_nodes_of_one_place_where_asked(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3], False)], "way_id long, refs array<long>, is_area boolean")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.1)], "id long, lon double, lat double")
    steps = lambda least: {(r.from_id, r.to_id) for r in graph.build_graph(ways, nodes, least).collect()}
    assert steps(None) == {(2, 3), (3, 2)}
    assert steps(0.0) == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_nearest_vectors_of_many_blocks_against_brute_force(spark):
    import random

    draw = random.Random(5)
    vectors = [[draw.choice([-1.0, 0.0, 0.1, 0.2, 1e6]) for _ in range(4)] for _ in range(300)]
    vectors += [vectors[7]] * 40 + [None, [1.0, None, 0.0, 0.0], [1.0], [0.1, 0.2, 0.3, 1e200]]
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    queries = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = {(r.query_id, r.rank): (r.id, r.distance) for r in topk.nearest_vectors(queries, frame, 6, block=64).collect()}

    def away(a, b):
        if a is None or b is None or len(b) != 4 or None in a or None in b:
            return math.inf, None
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += (x - y) * (x - y)
        return total, total

    expected = {}
    for i, q in rows[::20]:
        best = sorted((*away(q, v)[:1], j, away(q, v)[1]) for j, v in rows if j != i)[:6]
        expected |= {(i, n + 1): (j, d) for n, (_, j, d) in enumerate(best)}
    assert found == expected


def test_nearest_in_time_pairs_no_rows_of_a_window(spark):
    # Twenty thousand instants within one window, three rows each: a join on cells would pair 1.2 billion rows.
    left = spark.range(20000).select("id", (F.col("id") * 0.25).alias("t"))
    right = spark.range(60000).select((F.floor(F.col("id") / 3) * 0.25 + F.when(F.col("id") % 2 == 0, 0.0625).otherwise(-0.0625)).alias("t"), F.col("id").alias("v"))
    got = temporal.nearest_in_time(left, right, "id", F.col("t"), F.col("t"), ["v"], 5400.0, required="v")
    assert got.where("away = 0.0625").count() == 20000
    # The earlier of two as near, and of one instant the smallest value.
    assert [tuple(r) for r in got.where("id in (0, 1, 2)").orderBy("id").collect()] == [(0, -0.0625, 0.0625, 1), (1, 0.1875, 0.0625, 3), (2, 0.4375, 0.0625, 7)]
    edge = spark.createDataFrame([(1, 5400.0), (2, -1.0), (3, None)], "id int, t double")
    some = spark.createDataFrame([(0.0, 1), (10800.0, 2), (-5401.0, 3), (None, 4)], "t double, v int")
    assert sorted(tuple(r) for r in temporal.nearest_in_time(edge, some, "id", F.col("t"), F.col("t"), ["v"], 5400.0).collect()) == [(1, 0.0, 5400.0, 1), (2, 0.0, 1.0, 1), (3, None, None, None)]


def test_pairs_of_copies_share_one_meeting(spark):
    """Forty thousand pairs from two places: the distance is worked out once, and every copy has its pair."""
    a = spark.range(200).select(F.col("id").alias("a"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    b = spark.range(200).select(F.col("id").alias("b"), F.lit(0.0).alias("lon"), F.lit(0.0005).alias("lat"))
    pairs = spatial.radius_join(a, b, 100.0)
    assert pairs.columns == ["a", "lon", "lat", "b", "right_lon", "right_lat", "metres"]
    assert pairs.select("a", "b").distinct().count() == pairs.count() == 40000
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_rows" in text  # the pairs come from lists of a place's points
    box = lambda n, at: spark.range(50).select(F.col("id").alias(n), *(F.lit(at + d).alias(c) for c, d in (("south", 0.0), ("west", 0.0), ("north", 1.0), ("east", 1.0))))
    assert spatial.box_join(box("a", 0.0), box("b", 0.5), 0.4).select("a", "b").distinct().count() == 2500
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))
    held = spatial.within_rings(spark.range(30).select("id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y")), spark.range(30).select(F.col("id").alias("s"), ring.alias("ring")), 1.0)
    assert sorted(held.columns) == ["id", "ring", "s", "x", "y"] and held.select("id", "s").distinct().count() == held.count() == 900
