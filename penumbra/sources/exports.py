"""Sinks: GeoJSON and GPX text, and immutable generations behind one pointer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def xml_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def geojson(points: Column, properties: Column) -> Column:
    """A LineString feature of an array of {lon, lat} structs."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), properties.alias("properties")))


def gpx(name: Column, points: Column) -> Column:
    """A GPX track with seven decimals."""
    row = F.transform(points, lambda p: F.format_string('<trkpt lat="%.7f" lon="%.7f"/>', p["lat"], p["lon"]))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'),
        xml_escape(name),
        F.lit("</name><trkseg>"),
        F.array_join(row, ""),
        F.lit("</trkseg></trk></gpx>"),
    )


def generation_id(df: DataFrame) -> str:
    """Name of a table's content: sums of its rows' digests, so order doesn't matter and repeated rows do."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(4)]
    got = df.agg(F.count("*").alias("n"), *parts).first()
    return f"{got['n']}-" + "".join(f"{int(got[f'p{i}'] or 0) % (1 << 60):015x}" for i in range(4))


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """The generations pointed to, the first one first: a row a publication."""
    try:
        rows = spark.read.schema("number long, generation string").json(f"{root}/pointers").collect()
    except AnalysisException:  # nothing published yet
        return []
    return [r["generation"] for r in sorted(rows, key=lambda r: r["number"])]


def _point(spark: SparkSession, root: str, name: str) -> None:
    """One more pointer: a new file beside the old ones, so there is no moment without any."""
    row = [(len(_pointers(spark, root)) + 1, name)]
    spark.createDataFrame(row, "number long, generation string").coalesce(1).write.mode("append").json(f"{root}/pointers")


def publish(df: DataFrame, root: str) -> str:
    """Write a generation once and point to it; readers of the old one are not disturbed."""
    name = generation_id(df)
    df.write.mode("ignore").parquet(f"{root}/generations/{name}")
    _point(df.sparkSession, root, name)
    return name


def current(spark: SparkSession, root: str, check: bool = False) -> DataFrame:
    """The generation that the last pointer names; with ``check`` its content must have the digest that names it."""
    name = _pointers(spark, root)[-1]
    df = spark.read.parquet(f"{root}/generations/{name}")
    if check and generation_id(df) != name:
        raise ValueError(f"generation {name} has another content than its name says")
    return df


def roll_back(spark: SparkSession, root: str) -> str:
    """Point again to the last generation that differs from the current one."""
    names = _pointers(spark, root)
    before = [n for n in names if n != names[-1]]
    if not before:
        raise ValueError("no earlier generation")
    _point(spark, root, before[-1])
    return before[-1]
