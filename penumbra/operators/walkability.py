"""Transfers between stations and stops that people can walk: doors and stops on a network of paths, and why not."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators import overlay
from penumbra.session import cut

_ENDS = ["from_lon", "from_lat", "to_lon", "to_lat"]
#: Metres in a degree of latitude of the plane that points are projected in; a fixed value.
PLANE_DEGREE_M = 111195.0
#: Width of the smallest cells of a street network in which distances are found together; a fixed value.
CELL_DEG = 0.008


class WalkLimits(NamedTuple):
    """How far a point may lie from a path, and how long a walk may be: ``ratio`` times the straight line plus ``slack`` metres."""

    snap: float = 20.0
    ratio: float = 1.5
    slack: float = 100.0


def steps_onto(points: DataFrame, segments: DataFrame, point_id: str, reach: float) -> DataFrame:
    """``(point_id, node, cost)``: every node that a point can step onto, with the least metres of the step and the way along.

    Both ends of every segment that passes within ``reach`` metres count, not only those of the nearest, since paths beside each
    other needn't meet. ``points`` has ``lon, lat``, ``segments`` has ``from_id, to_id`` and its ends' coordinates. A segment is repeated
    for the cells that its box, grown by the reach, meets; a point lies in one cell.
    """
    dlat = reach / PLANE_DEGREE_M * 1.01
    widest = F.least(F.greatest(F.abs("from_lat"), F.abs("to_lat")) + dlat, F.lit(89.9))
    dlon = F.lit(dlat) / F.greatest(F.cos(F.radians(widest)), F.lit(1e-3))
    size = max(dlat * 4, 1e-6)
    low = [F.least("from_lon", "to_lon") - dlon, F.least("from_lat", "to_lat") - dlat]
    high = [F.greatest("from_lon", "to_lon") + dlon, F.greatest("from_lat", "to_lat") + dlat]
    laid = segments.select("from_id", "to_id", *_ENDS)
    for cell, a, b in zip(("_cx", "_cy"), low, high, strict=True):
        laid = laid.withColumn(cell, F.explode(F.sequence(geo.grid_cell(a, size), geo.grid_cell(b, size))))
    probes = points.select(point_id, "lon", "lat").where("lon is not null and lat is not null")
    probes = probes.withColumn("_cx", geo.grid_cell(F.col("lon"), size)).withColumn("_cy", geo.grid_cell(F.col("lat"), size))
    k = F.cos(F.radians("lat"))
    flat = lambda lon, lat: ((F.col(lon) - F.col("lon")) * k, F.col(lat) - F.col("lat"))
    t, away = geo.project_on_segment(F.lit(0.0), F.lit(0.0), *flat("from_lon", "from_lat"), *flat("to_lon", "to_lat"))
    # Arrays of one element, exploded, keep what is computed once from being computed in every place of its use.
    near = probes.join(laid, ["_cx", "_cy"]).withColumn("_p", F.explode(F.array(F.struct(t.alias("t"), (away * PLANE_DEGREE_M).alias("step")))))
    near = near.where(F.col("_p.step") <= reach).withColumn("_m", F.explode(F.array(geo.haversine(*map(F.col, _ENDS)))))
    ends = F.explode(F.array(F.struct(F.col("from_id").alias("node"), (F.col("_p.t") * F.col("_m")).alias("along")), F.struct(F.col("to_id").alias("node"), ((1 - F.col("_p.t")) * F.col("_m")).alias("along"))))
    found = near.select(point_id, F.col("_p.step").alias("step"), ends.alias("e"))
    return found.groupBy(point_id, F.col("e.node").alias("node")).agg(F.min(F.col("step") + F.col("e.along")).alias("cost"))


def walks(transfers: DataFrame, doors: DataFrame, segments: DataFrame, limits: WalkLimits = WalkLimits()) -> DataFrame:  # noqa: B008
    """The walk of every transfer, or why there is none: ``transfer_id, walk_m, refused``.

    ``transfers`` has ``transfer_id, station_id, station_lon, station_lat, stop_id, stop_lon, stop_lat, leaving``; ``doors`` has
    ``door_id, station_id, lon, lat, exit_only``; ``segments`` are walked both ways. Riders who don't leave can't use a door that is an exit
    only. Distances between stops and doors, from all the nodes they can step onto and up to the allowance, come from cells of the
    network (``overlay.distances``), so a far stop costs no search of all that lies between. Of the doors within their own allowance the one with the least whole way counts, from the
    station's point on; metres are rounded, halves up.

    Refusals: ``no_door``, ``stop_off_network``, ``doors_off_network`` (no usable door is near a path), ``detour`` (too far round, or no way).
    """
    straight = lambda a, b: geo.haversine(*map(F.col, (f"{a}_lon", f"{a}_lat", f"{b}_lon", f"{b}_lat")))
    rooms = doors.select("door_id", "station_id", F.col("lon").alias("door_lon"), F.col("lat").alias("door_lat"), "exit_only")
    usable = transfers.join(rooms, "station_id").where(F.col("leaving") | ~F.coalesce("exit_only", F.lit(False)))
    usable = cut(usable.select("transfer_id", "stop_id", "door_id", (limits.ratio * straight("door", "stop") + limits.slack).alias("allowed"), straight("station", "door").alias("inside")))
    stops = transfers.groupBy("stop_id").agg(F.min(F.struct(F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))).alias("p")).select("stop_id", "p.lon", "p.lat")
    stop_steps = cut(steps_onto(stops, segments, "stop_id", limits.snap))
    door_steps = cut(steps_onto(doors.select("door_id", "lon", "lat"), segments, "door_id", limits.snap))
    paths = segments.select("from_id", "to_id", *_ENDS, geo.haversine(*map(F.col, _ENDS)).alias("cost"))
    begun, ended = stop_steps.withColumnRenamed("stop_id", "source"), door_steps.withColumnRenamed("door_id", "target")
    pairs = usable.select(F.col("stop_id").alias("source"), F.col("door_id").alias("target"), F.col("allowed").alias("limit")).distinct()
    found = overlay.distances(paths, begun, ended, pairs, CELL_DEG).select(F.col("source").alias("stop_id"), F.col("target").alias("door_id"), F.col("cost").alias("routed"))
    routed = usable.join(found, ["stop_id", "door_id"])
    best = routed.where("routed <= allowed").groupBy("transfer_id").agg(F.min(F.col("inside") + F.col("routed")).alias("metres"))
    on_path = usable.join(door_steps.select("door_id").distinct(), "door_id", "left_semi").select("transfer_id").distinct().withColumn("near", F.lit(True))
    has_door = usable.select("transfer_id").distinct().withColumn("door", F.lit(True))
    stop_near = stop_steps.select("stop_id").distinct().withColumn("stop", F.lit(True))
    told = transfers.select("transfer_id", "stop_id").join(has_door, "transfer_id", "left").join(stop_near, "stop_id", "left").join(on_path, "transfer_id", "left").join(best, "transfer_id", "left")
    why = F.when(F.col("door").isNull(), "no_door").when(F.col("stop").isNull(), "stop_off_network").when(F.col("near").isNull(), "doors_off_network").when(F.col("metres").isNull(), "detour")
    # A way may be found only where nothing refuses it before.
    return told.select("transfer_id", F.when(why.isNull(), F.floor(F.col("metres") + 0.5).cast("long")).alias("walk_m"), why.alias("refused"))


def promote(transfers: DataFrame, doors: DataFrame, segments: DataFrame, limits: WalkLimits = WalkLimits(), speed: float = 1.3, least_seconds: int = 60) -> DataFrame:  # noqa: B008
    """All transfers: those of kind ``spatial`` that the network can walk become ``walked`` with ``walk_m`` and ``min_seconds``, the time at
    ``speed`` metres a second, rounded up, ``least_seconds`` at least; the others stay as they are, refused ones with ``refused``."""
    found = walks(transfers.where("kind = 'spatial'"), doors, segments, limits)
    walked = F.col("walk_m").isNotNull()
    seconds = F.when(walked, F.greatest(F.lit(least_seconds), F.ceil(F.col("walk_m") / speed).cast("int"))).otherwise(F.col("min_seconds"))
    return transfers.join(found, "transfer_id", "left").withColumn("kind", F.when(walked, "walked").otherwise(F.col("kind"))).withColumn("min_seconds", seconds.cast("int"))


def tally(promoted: DataFrame) -> DataFrame:
    """``outcome, transfers, stations`` over promoted transfers: ``walked_out`` and ``walked_in`` (by direction), and each refusal."""
    outcome = F.when(F.col("kind") == "walked", F.when(F.col("leaving"), "walked_out").otherwise("walked_in")).otherwise(F.col("refused"))
    return promoted.withColumn("outcome", outcome).where("outcome is not null").groupBy("outcome").agg(F.count("*").alias("transfers"), F.count_distinct("station_id").alias("stations"))


def match_entrances(entrances: DataFrame, stations: DataFrame, named: float = 400.0, any_: float = 300.0) -> DataFrame:
    """``(entrance_id, station_id, by)``: the nearest station, closer than ``named`` metres, whose name (any case) or local name the entrance's
    name holds, else the nearest one closer than ``any_``; ties to the smaller id. Entrances without a station are left out.

    ``entrances`` has ``entrance_id, name, lon, lat``, ``stations`` has ``station_id, station_name, local_name, lon, lat``.
    """
    from penumbra.operators.spatial import radius_join

    pairs = radius_join(entrances, stations, max(named, any_))
    name: Column = F.coalesce("name", F.lit(""))
    holds = F.contains(F.lower(name), F.lower("station_name")) | ((F.coalesce("local_name", F.lit("")) != "") & F.contains(name, F.col("local_name")))
    by_name = F.coalesce((name != "") & holds, F.lit(False)) & (F.col("metres") < named)
    near = pairs.where(by_name | (F.col("metres") < any_)).groupBy("entrance_id").agg(
        F.min(F.struct(F.when(by_name, 0).otherwise(1).alias("rank"), F.col("metres"), F.col("station_id"))).alias("best")
    )
    return near.select("entrance_id", "best.station_id", F.when(F.col("best.rank") == 0, "name").otherwise("distance").alias("by"))


def nearest_stations(points: DataFrame, stations: DataFrame, count: int, metres: float, accept: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``count`` nearest stations within ``metres`` of every point, only those that ``accept`` holds for: ``(point_id, rank, station_id, metres)`` and the
    stations' columns in ``keep``."""
    from penumbra.operators.spatial import nearest_few

    chosen = stations if accept is None else stations.where(accept)
    few = nearest_few(points, chosen, "point_id", "station_id", count, metres, keep)
    return few.select("point_id", F.posexplode("near").alias("_place", "_n")).select("point_id", (F.col("_place") + 1).alias("rank"), "_n.station_id", "_n.metres", *(f"_n.{c}" for c in keep or []))


def ride_spans(stations: DataFrame, rides: DataFrame, least_stations: int = 3) -> DataFrame:
    """``stations`` with ``to_low, to_high``, the smallest and largest station that a ride of at least ``least_stations`` stations leads to, null without any."""
    ends = rides.where(F.col("stations") >= least_stations).groupBy(F.col("from_id").alias("station_id")).agg(F.min("to_id").alias("to_low"), F.max("to_id").alias("to_high"))
    return stations.join(ends.hint("merge"), "station_id", "left")


def best_pair(trips: DataFrame, entries: DataFrame, exits: DataFrame, rides: DataFrame, walk_speed: float = 1.3, least_stations: int = 3) -> DataFrame:
    """The entry and exit station of every trip with the least walk, ride and walk: ``(trip_id, entry_id, exit_id, seconds)``.

    ``trips`` has ``trip_id, origin_id, target_id``; ``entries`` and ``exits`` are ``nearest_stations`` of the origins and targets; ``rides`` has
    ``from_id, to_id, seconds, stations``. A ride of fewer than ``least_stations`` stations is no use. Ties go to nearer entries, then exits.

    Rides are met by a sort-merge join: they may be many more than their plan's size tells, and to send them to all would take the driver's memory. If
    entries have ``to_low, to_high`` (of ``ride_spans``), pairs whose exit lies outside have no ride and aren't shuffled.
    """
    span = ["to_low", "to_high"] if "to_low" in entries.columns else []
    a = entries.select(F.col("point_id").alias("origin_id"), F.col("rank").alias("a"), F.col("station_id").alias("from_id"), F.col("metres").alias("walk_in"), *span)
    if span:
        a = a.where("to_low is not null")
    b = exits.select(F.col("point_id").alias("target_id"), F.col("rank").alias("b"), F.col("station_id").alias("to_id"), F.col("metres").alias("walk_out"))
    pairs = trips.join(a, "origin_id").join(b, "target_id").where("from_id <> to_id")
    if span:
        pairs = pairs.where("to_id between to_low and to_high").drop(*span)
    pairs = pairs.join(rides.where(F.col("stations") >= least_stations).hint("merge"), ["from_id", "to_id"])
    total = F.col("seconds") + (F.col("walk_in") + F.col("walk_out")) / walk_speed
    best = pairs.groupBy("trip_id").agg(F.min(F.struct(total.alias("total"), "a", "b", "from_id", "to_id")).alias("best"))
    return best.select("trip_id", F.col("best.from_id").alias("entry_id"), F.col("best.to_id").alias("exit_id"), F.col("best.total").alias("seconds"))
