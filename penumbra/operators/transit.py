"""Timetable operators: headways, edge times, calendars, transfers and feed checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions.clock import half_up
from penumbra.operators.search import least
from penumbra.operators.spatial import nearest_join, radius_join
from penumbra.operators.stats import join_keys, percentile_linear
from penumbra.session import cut


def headways(first_departures: DataFrame, keys: list[str], departure: str, service: str, least: int = 4) -> DataFrame:
    """Median gap of the distinct departures of every key and hour with at least ``least`` of them.

    ``first_departures`` has a row a trip. Equal seconds count once; the services are counted apart.
    """
    hourly = first_departures.withColumn("hour", F.floor(F.col(departure) / 3600).cast("int"))
    services = hourly.groupBy(*keys, "hour").agg(F.countDistinct(service).alias("services"))
    distinct = hourly.select(*keys, "hour", departure).distinct()
    w = Window.partitionBy(*keys, "hour").orderBy(departure)
    gaps = distinct.withColumn("_gap", F.col(departure) - F.lag(departure).over(w))
    return (
        gaps.groupBy(*keys, "hour")
        .agg(F.median("_gap").alias("headway_sec"), F.count("*").alias("departures"))
        .where(F.col("departures") >= least)
        .join(services, [*keys, "hour"])
    )


def first_departures(stop_times: DataFrame, trip: str, departure: str) -> DataFrame:
    return stop_times.groupBy(trip).agg(F.min(departure).alias(departure))


def edge_medians(
    stop_times: DataFrame, trip: str, sequence: str, stop: str, time: str, keys: list[str], least: int = 3, most_seconds: float | None = None
) -> DataFrame:
    """Rounded median seconds between consecutive stops of trips, for pairs with at least ``least`` samples.

    Pairs of one stop with itself and times that don't advance (or exceed ``most_seconds``) are dropped.
    """
    w = Window.partitionBy(trip).orderBy(sequence)
    steps = stop_times.select(
        *keys, F.lag(stop).over(w).alias("from_stop"), F.col(stop).alias("to_stop"), (F.col(time) - F.lag(time).over(w)).alias("seconds")
    ).where("from_stop is not null and from_stop <> to_stop and seconds > 0")
    if most_seconds is not None:
        steps = steps.where(F.col("seconds") <= most_seconds)
    pair = [*keys, "from_stop", "to_stop"]
    often = steps.groupBy(*pair).agg(F.count("*").alias("samples")).where(F.col("samples") >= least)
    medians = percentile_linear(steps, "seconds", pair, {"_median": 50})
    return join_keys(often, medians, pair).select(*pair, half_up(F.col("_median")).alias("median_sec"), "samples")


def active_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``(service_id, day)`` of every active date.

    ``calendar`` has ``service_id``, ``days`` (seven booleans from Monday), ``start`` and ``end``;
    ``exceptions`` has ``service_id``, ``day`` and ``kind`` (1 adds the day, 2 removes it).
    """
    weekly = calendar.select("service_id", "days", F.explode(F.sequence("start", "end")).alias("day")).where(
        F.element_at("days", F.weekday("day") + 1)
    )
    added = exceptions.where("kind = 1").select("service_id", "day")
    removed = exceptions.where("kind = 2").select("service_id", "day")
    return weekly.select("service_id", "day").union(added).distinct().join(removed, ["service_id", "day"], "left_anti")


def representative_dates(active: DataFrame, kind: Column) -> DataFrame:
    """For each kind of day, the first date of the largest group of dates with the same active services
    (of equal groups the one that starts first)."""
    prints = active.groupBy("day").agg(F.array_join(F.sort_array(F.collect_set("service_id")), "|").alias("services"))
    groups = prints.groupBy(kind.alias("kind"), "services").agg(F.count("*").alias("dates"), F.min("day").alias("day"))
    order = Window.partitionBy("kind").orderBy(F.desc("dates"), "day")
    return groups.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("kind", "day", "dates", "services")


def dangling(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has; null keys don't count."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def parent_stops(stops: DataFrame) -> DataFrame:
    """Stops with the station they belong to; a stop whose parent is missing stands for itself."""
    stations = stops.select(F.col("stop_id").alias("station_id"), F.col("stop_name").alias("station_name"))
    own = stops.join(stations, stops["parent_station"] == stations["station_id"], "left")
    return own.select(
        "stop_id",
        F.coalesce("station_id", "stop_id").alias("station_id"),
        F.coalesce("station_name", "stop_name").alias("station_name"),
        (F.col("station_id").isNull() & F.col("parent_station").isNotNull()).alias("promoted"),
    )


def merge_feeds(feeds: list[DataFrame], key: str) -> DataFrame:
    """Union of feeds; of rows with one key the row of the first feed stays."""
    union = None
    for i, feed in enumerate(feeds):
        part = feed.withColumn("_feed", F.lit(i))
        union = part if union is None else union.unionByName(part)
    order = Window.partitionBy(key).orderBy("_feed")
    return union.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_feed")


def transit_gate(transit: Column, walk: Column) -> Column:
    """A ride stays unless it takes more than twice the walk and more than a quarter hour longer."""
    return transit <= F.greatest(walk * 2, walk + 900)


def boarding_wait(headway: Column, has_service: Column) -> Column:
    """Half the headway; null (not boardable) without service, none where the timetable can't be read."""
    return F.when(~has_service, F.lit(None).cast("double")).otherwise(F.coalesce(headway / 2.0, F.lit(0.0)))


def walk_transfers(stations: DataFrame, stops: DataFrame, metres: float = 200.0, digits: int | None = None) -> DataFrame:
    """Transfers in both directions between stations and stops (``stop_id, lon, lat``) at most ``metres`` apart, rounded to ``digits`` if given."""
    a = stations.select(F.col("stop_id").alias("from_id"), "lon", "lat")
    b = stops.select(F.col("stop_id").alias("to_id"), "lon", "lat")
    way = lambda x, y: F.struct(F.col(x).alias("from_id"), F.col(y).alias("to_id"), "metres")
    return radius_join(a, b, metres, digits).select(F.inline(F.array(way("from_id", "to_id"), way("to_id", "from_id"))))


def within_reach(starts: DataFrame, rides: DataFrame, transfers: DataFrame, seconds: float) -> DataFrame:
    """``(stop)``: the stops that rides and walks alone, without waits, lead to from any of the ``starts(stop)`` within the time. No search over
    the same rides and walks with a budget of so many seconds comes to another one."""
    moves = rides.select("from_stop", "to_stop", "seconds").union(transfers.select("from_stop", "to_stop", "seconds"))
    begun = starts.select(F.lit(0).alias("source"), F.col("stop").alias("node"))
    found = least(moves.select(F.col("from_stop").alias("from_id"), F.col("to_stop").alias("to_id"), F.col("seconds").cast("double").alias("cost")), begun, seconds)
    return cut(found.select(F.col("node").alias("stop")))


def boarding_graph(rides: DataFrame, headway: DataFrame, transfers: DataFrame, changes: DataFrame, boardings: int = 5) -> DataFrame:
    """Edges between states for the label search over a transit network, with at most ``boardings`` of them.

    A state is a text: ``stop#n`` on foot after n boardings, ``stop|line#n`` on board, ``stop!n`` just off a vehicle.
    ``rides`` has ``line, from_stop, to_stop, seconds``; ``headway`` has ``line, headway_sec`` (null: unreadable; absent: no
    service, and the line can't be boarded); ``transfers`` has ``from_stop, to_stop, seconds``; ``changes`` has ``stop,
    change_sec`` (null or absent: unpriced). Boarding costs half the headway, and the stop's change time too if one has just left
    another vehicle there; who came on foot has paid by walking. Leaving costs a tenth of a second, because steps must take time.
    """
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    n, line = F.col("n").cast("string"), F.col("line").cast("string")
    foot = lambda stop, n=n: text(F.col(stop).cast("string"), "#", n)
    on = lambda stop, n=n: text(F.col(stop).cast("string"), "|", line, "#", n)
    off = lambda stop: text(F.col(stop).cast("string"), "!", n)
    counts = lambda df, least, most: df.withColumn("n", F.explode(F.sequence(F.lit(least), F.lit(most))))
    stops = rides.select("line", F.col("from_stop").alias("stop")).union(rides.select("line", "to_stop")).distinct()
    served = stops.join(headway, "line").join(changes.select("stop", "change_sec"), "stop", "left")
    wait = F.greatest(F.lit(0.1), F.coalesce(F.col("headway_sec") / 2.0, F.lit(0.0)))
    change = wait + F.coalesce(F.col("change_sec").cast("double"), F.lit(0.0))
    more = (F.col("n") + 1).cast("string")
    seconds = F.col("seconds").cast("double")
    parts = [
        counts(rides, 1, boardings).select(on("from_stop").alias("from_id"), on("to_stop").alias("to_id"), seconds.alias("seconds")),
        counts(stops, 1, boardings).select(on("stop"), off("stop"), F.lit(0.1)),
        counts(served, 0, boardings - 1).select(foot("stop"), on("stop", more), wait),
        counts(transfers, 0, boardings).select(foot("from_stop"), foot("to_stop"), seconds),
        counts(transfers, 1, boardings).select(off("from_stop"), foot("to_stop"), seconds),
    ]
    if boardings > 1:
        parts.append(counts(served, 1, boardings - 1).select(off("stop"), on("stop", more), change))
    return reduce(DataFrame.union, parts)


def tag_or_nearest(doors: DataFrame, stations: DataFrame, cap: float) -> DataFrame:
    """The station of each door: by a station id in its ``tag`` (a list parted by semicolons), else the nearest within ``cap``."""
    tags = doors.select("door_id", F.explode(F.split("tag", ";")).alias("t")).select("door_id", F.trim("t").alias("station_id"))
    tagged = tags.join(stations.select("station_id"), "station_id").groupBy("door_id").agg(F.min("station_id").alias("by_tag"))
    near = nearest_join(doors.select("door_id", "lon", "lat"), stations.select("station_id", "lon", "lat"), "door_id", "station_id", cap)
    joined = doors.select("door_id").join(tagged, "door_id", "left").join(near.withColumnRenamed("station_id", "by_place"), "door_id", "left")
    how = F.when(F.col("by_tag").isNotNull(), "tag").when(F.col("by_place").isNotNull(), "place")
    return joined.select("door_id", F.coalesce("by_tag", "by_place").alias("station_id"), how.alias("how"))
