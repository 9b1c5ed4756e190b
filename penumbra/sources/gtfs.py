"""Timetable files: explicit schemas, header checks, and rows that don't parse set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions.clock import service_seconds

#: Columns and types by file, in the public specification's names; fixed values.
FILES = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string",
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int, route_color string, route_text_color string",
    "trips": "route_id string, trip_id string, service_id string, trip_headsign string, direction_id int, shape_id string",
    "stop_times": "trip_id string, stop_id string, arrival_time string, departure_time string, stop_sequence int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int",
    "feed_info": "feed_publisher_name string, feed_version string, feed_start_date string, feed_end_date string",
}
#: Columns that a usable row must have; fixed values.
NEEDED = {
    "stops": ["stop_id", "stop_lat", "stop_lon"],
    "routes": ["route_id"],
    "trips": ["route_id", "trip_id", "service_id"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence"],
    "calendar": ["service_id", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
    "transfers": ["from_stop_id", "to_stop_id"],
    "feed_info": [],
}


def read(spark: SparkSession, folder: str, file: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows of a file, and the others with the first column that is missing or doesn't parse.

    Columns are found by name; absent optional ones are null; a needed column absent from the header is an error.
    """
    raw = spark.read.csv(f"{folder}/{file}.txt", header=True, quote='"', escape='"', multiLine=True)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if missing := [c for c in NEEDED[file] if c not in raw.columns]:
        raise ValueError(f"{file}: the header lacks {', '.join(missing)}")
    columns = [c.split() for c in FILES[file].split(", ")]
    cells = {name: F.nullif(F.trim(F.col(name)), F.lit("")) if name in raw.columns else F.lit(None).cast("string") for name, _ in columns}
    typed = raw.select(*[cells[name].try_cast(kind).alias(name) for name, kind in columns], *[cells[n].alias(f"_{n}") for n, _ in columns])
    broken = None
    for name, _ in columns:
        bad = F.col(name).isNull() & (F.col(f"_{name}").isNotNull() if name not in NEEDED[file] else F.lit(True))
        broken = F.when(bad, name) if broken is None else broken.when(bad, name)
    judged = typed.withColumn("problem", broken)
    names = [n for n, _ in columns]
    good = judged.where("problem is null").select(*names)
    if file == "stop_times":
        good = good.withColumn("arrival_sec", service_seconds(F.col("arrival_time"))).withColumn("departure_sec", service_seconds(F.col("departure_time")))
    return good, judged.where("problem is not null").select("problem", *[F.col(f"_{n}").alias(n) for n in names])


def unexpected_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Columns that an exact header has too many or too few of, in order."""
    return sorted(set(df.columns) ^ set(expected))


def shape_points(shapes: DataFrame) -> DataFrame:
    """Each shape's points in sequence."""
    point = F.struct("shape_pt_sequence", F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat"))
    return shapes.groupBy("shape_id").agg(F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def weekly_calendar(calendar: DataFrame) -> DataFrame:
    """``service_id, days, start, end`` for the calendar operator."""
    days = F.array(*[F.col(d) == 1 for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    return calendar.select(
        "service_id", days.alias("days"), F.to_date("start_date", "yyyyMMdd").alias("start"), F.to_date("end_date", "yyyyMMdd").alias("end")
    )
