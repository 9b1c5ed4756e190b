"""Service clocks, slots and time zones as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def service_seconds(text: Column) -> Column:
    """Seconds of ``H:MM:SS`` with up to three hour digits (a service day runs past midnight); null if malformed."""
    part = [F.try_to_number(F.regexp_extract(text, r"^\s*(\d{1,3}):([0-5]\d):([0-5]\d)\s*$", i), F.lit("999")) for i in (1, 2, 3)]
    return (part[0] * 3600 + part[1] * 60 + part[2]).cast("int")


def day_type(day: Column) -> Column:
    """Weekday, saturday or sunday; ``weekday()`` counts from Monday as 0."""
    d = F.weekday(day)
    return F.when(d < 5, "weekday").when(d == 5, "saturday").otherwise("sunday")


def service_hour(hour: Column, today: Column, yesterday: Column) -> Column:
    """Hour of the service day: before 04:00 it belongs to yesterday as hour + 24 where the day types agree."""
    return F.when((hour < 4) & (today == yesterday), hour + 24).otherwise(hour)


def half_up(x: Column) -> Column:
    """Rounding with halves towards positive infinity."""
    return F.floor(x + 0.5).cast("long")


def slot_of_minute(minutes: Column) -> Column:
    """Quarter-hour slot 0 to 63 of the day's minutes; slots start at 05:00."""
    return F.greatest(F.lit(0), F.least(F.lit(63), half_up((minutes - 300) / 15.0))).cast("int")


def slot_index(month: Column, minutes: Column) -> Column:
    """Slot among 12 x 64: the month from 0 times 64 plus the quarter hour."""
    return (month * 64 + slot_of_minute(minutes)).cast("int")


def fraction_byte(fraction: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), half_up(fraction * 255.0))).cast("int")


def byte_fraction(byte: Column) -> Column:
    return byte / 255.0


def segment_key(a: Column, b: Column) -> Column:
    """Text key of an undirected pair."""
    return F.concat_ws(",", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def longitude_offset(lon: Column) -> Column:
    """Minutes of solar time east of Greenwich, by whole hours."""
    return half_up(lon / 15.0) * 60


def zone_offset(instant: Column, zone: Column) -> Column:
    """Minutes that a zone's wall clock is ahead of UTC at an instant."""
    return ((F.unix_timestamp(F.from_utc_timestamp(instant, zone)) - F.unix_timestamp(instant)) / 60).cast("int")


def snap_window(start: Column, end: Column, low: int = 300, high: int = 1260) -> tuple[Column, Column]:
    """A window of minutes, snapped outwards to quarter hours and clipped to the table's day."""
    return (
        F.greatest(F.lit(low), F.floor(start / 15.0) * 15).cast("int"),
        F.least(F.lit(high), F.ceil(end / 15.0) * 15).cast("int"),
    )


def instant_of(zone: Column, year: Column, month: Column, day: Column, hours: Column, minutes: Column) -> Column:
    """The instant at which a zone's clock shows these parts; ``month`` counts from 0, and months, days, hours and minutes may overflow.

    The parts are read as UTC, moved by the offset there, and moved anew by the offset at the result if that is another. So an hour that a
    clock change skips is read by the offset after it, and of an hour that it repeats the first is meant where the first guess lies before
    the change; there is no second correction.
    """
    date = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month), day - 1)
    utc = F.unix_date(date).cast("long") * 86400 + hours * 3600 + minutes * 60
    before = zone_offset(F.timestamp_seconds(utc), zone)
    after = zone_offset(F.timestamp_seconds(utc - before * 60), zone)
    return F.timestamp_seconds(utc - after * 60)
