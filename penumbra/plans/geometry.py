"""Queries on coordinates, tiles, grids, nearness and shade.

Coordinates are whole-number functions of the tables' keys, equal in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators import sequences, shade, spatial
from penumbra.plans.registry import register
from penumbra.session import table


def lon_of(key: Column) -> Column:
    return F.lit(-74.25) + (key * 7919 % 10000) / F.lit(18000.0)


def lat_of(key: Column) -> Column:
    return F.lit(40.5) + (key * 104729 % 10000) / F.lit(25000.0)


def _lon(k: str) -> str:
    return f"(-74.25 + ({k} * 7919 % 10000) / 18000.0::DOUBLE)"


def _lat(k: str) -> str:
    return f"(40.5 + ({k} * 104729 % 10000) / 25000.0::DOUBLE)"


def _haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(key, lon_of(F.col(key)).alias("lon"), lat_of(F.col(key)).alias("lat"))


_C = f"SELECT c_custkey, {_lon('c_custkey')} AS lon, {_lat('c_custkey')} AS lat FROM customer"
_S = f"SELECT s_suppkey, {_lon('s_suppkey')} AS slon, {_lat('s_suppkey')} AS slat FROM supplier"


@register(f"""
SELECT c_custkey, s_suppkey, round({_haversine('lon', 'lat', 'slon', 'slat')}, 4) AS metres FROM ({_C}), ({_S}) WHERE {_haversine('lon', 'lat', 'slon', 'slat')} <= 2000
""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers at most two kilometres apart."""
    pairs = spatial.radius_join(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), 2000.0, 4)
    return pairs.select("c_custkey", "s_suppkey", "metres")


@register(f"""
WITH p AS (SELECT c_custkey, s_suppkey, {_haversine('lon', 'lat', 'slon', 'slat')} AS m FROM ({_C}), ({_S}))
SELECT c_custkey, s_suppkey, round(m, 4) AS metres FROM p WHERE m <= 5000 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY m, s_suppkey) = 1
""")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest supplier of every customer within five kilometres."""
    out = spatial.nearest_join(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), "c_custkey", "s_suppkey", 5000.0)
    return out.withColumn("metres", F.round("metres", 4))


@register(f"""
WITH t AS (SELECT floor((lon + 180) / 360 * 16384)::BIGINT AS tile_x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)::BIGINT AS tile_y FROM ({_C}))
SELECT tile_x, tile_y, count(*) AS n FROM t GROUP BY 1, 2
""")
def tile_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by tile of zoom 14."""
    points = _points(spark, sf_dir, "customer", "c_custkey")
    return points.groupBy(geo.tile_x(F.col("lon"), 14).alias("tile_x"), geo.tile_y(F.col("lat"), 14).alias("tile_y")).agg(F.count("*").alias("n"))


def _tx(x: str) -> str:
    return f"floor(({x} + 180) / 360 * 4096)::BIGINT"


def _ty(y: str) -> str:
    return f"floor((1 - ln(tan(radians({y})) + 1 / cos(radians({y}))) / pi()) / 2 * 4096)::BIGINT"


@register(f"""
WITH e AS (SELECT o_orderkey, {_lon('o_orderkey')} AS ax, {_lat('o_orderkey')} AS ay, {_lon('o_custkey')} AS bx, {_lat('o_custkey')} AS bz FROM orders)
SELECT o_orderkey, {_tx('((ax + bx) / 2)')} AS tile_x, {_ty('((ay + bz) / 2)')} AS tile_y,
  {_tx('ax')} <> {_tx('((ax + bx) / 2)')} OR {_tx('bx')} <> {_tx('((ax + bx) / 2)')} OR {_ty('ay')} <> {_ty('((ay + bz) / 2)')} OR {_ty('bz')} <> {_ty('((ay + bz) / 2)')} AS seam FROM e
""")
def seam_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the tile of their midpoint, and those that leave it."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    edges = table(spark, sf_dir, "orders").select(
        "o_orderkey", lon_of(o).alias("from_lon"), lat_of(o).alias("from_lat"), lon_of(c).alias("to_lon"), lat_of(c).alias("to_lat")
    )
    return spatial.tile_shards(edges, 12).select("o_orderkey", "tile_x", "tile_y", "seam")


_LEAF = "SELECT c_custkey % 64 AS x, (c_custkey // 64) % 64 AS y, min(c_acctbal) AS low, max(c_acctbal) AS high, max(c_nationkey % 2)::INTEGER AS coverage FROM customer GROUP BY 1, 2"


@register(f"""
WITH l AS ({_LEAF}), d AS (SELECT *, unnest(range(7)) AS depth FROM l)
SELECT (17 - depth)::INTEGER AS zoom, x >> depth AS x, y >> depth AS y, min(low) AS low, max(high) AS high,
  CASE WHEN count(*) = pow(4, depth) THEN max(coverage) ELSE 2 END::INTEGER AS coverage FROM d GROUP BY depth, 2, 3
""")
def quadtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds pyramid of customer balances from zoom 17 up to 11."""
    k = F.col("c_custkey")
    leaves = (
        table(spark, sf_dir, "customer")
        .groupBy((k % 64).alias("x"), (F.floor(k / 64) % 64).alias("y"))
        .agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.max(F.col("c_nationkey") % 2).alias("coverage"))
    )
    return spatial.quadtree_levels(leaves, 17, 11)


@register(f"""
WITH p AS (SELECT c_custkey, c_custkey % 40 AS trip, {_lon('c_custkey')} AS lon, {_lat('c_custkey')} AS lat FROM customer),
s AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM p WINDOW w AS (PARTITION BY trip ORDER BY c_custkey)),
m AS (SELECT trip, c_custkey, {_haversine('plon', 'plat', 'lon', 'lat')} AS metres,
  ((degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) % 360) + 360) % 360 AS b
  FROM s WHERE plon IS NOT NULL),
t AS (SELECT *, ((b - lag(b) OVER (PARTITION BY trip ORDER BY c_custkey)) % 360 + 360) % 360 AS d FROM m)
SELECT trip, count(*) FILTER (abs(CASE WHEN d > 180 THEN d - 360 ELSE d END) > 30) AS turns, round(sum(metres), 3) AS metres FROM t GROUP BY trip
""")
def turn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of over 30 degrees and length of forty paths of customers."""
    points = _points(spark, sf_dir, "customer", "c_custkey").withColumn("trip", F.col("c_custkey") % 40)
    return sequences.turn_counts(points, ["trip"], ["c_custkey"], "lon", "lat").withColumn("metres", F.round("metres", 3))


@register(f"""
SELECT c_custkey, s_suppkey, round({_haversine('lon', 'lat', 'slon', 'slat')}, 4) AS metres,
  round(((degrees(atan2(sin(radians(slon - lon)) * cos(radians(slat)), cos(radians(lat)) * sin(radians(slat)) - sin(radians(lat)) * cos(radians(slat)) * cos(radians(slon - lon)))) % 360) + 360) % 360, 6) AS bearing
FROM ({_C}) JOIN ({_S}) ON s_suppkey = c_custkey % 10 + 1
""")
def haversine_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing from each customer to one supplier."""
    c = _points(spark, sf_dir, "customer", "c_custkey").withColumn("s_suppkey", F.col("c_custkey") % 10 + 1)
    s = _points(spark, sf_dir, "supplier", "s_suppkey").withColumnsRenamed({"lon": "slon", "lat": "slat"})
    args = [F.col(n) for n in ("lon", "lat", "slon", "slat")]
    return c.join(s, "s_suppkey").select(
        "c_custkey", "s_suppkey", F.round(geo.haversine(*args), 4).alias("metres"), F.round(geo.bearing(*args), 6).alias("bearing")
    )


@register("""
WITH RECURSIVE t AS (SELECT p_partkey, p_partkey * 7919 % 4096 AS x, p_partkey * 104729 % 4096 AS y FROM part)
SELECT p_partkey, array_to_string(list_transform(list_reverse(range(12)), lambda z: (((x >> z) & 1) + ((y >> z) & 1) * 2)::VARCHAR), '') AS key, x AS back_x, y AS back_y FROM t
""")
def quadkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadkeys of tiles, and the tiles read back from them."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", geo.quadkey(k * 7919 % 4096, k * 104729 % 4096, 12).alias("key"))
    back = geo.quadkey_tile(F.col("key"))
    return rows.select("p_partkey", "key", back["x"].alias("back_x"), back["y"].alias("back_y"))


def _box(name: str, key: str, size: float) -> str:
    return f"SELECT {key}, {_lat(key)} AS south, {_lon(key)} AS west, {_lat(key)} + {size} AS north, {_lon(key)} + {size} AS east FROM {name}"


@register(f"""
SELECT s_suppkey, c_custkey FROM ({_box('supplier', 's_suppkey', 0.02)}) q JOIN ({_box('customer', 'c_custkey', 0.01)}) s
ON q.south <= s.north AND s.south <= q.north AND q.west <= s.east AND s.west <= q.east
""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of suppliers and customers that meet."""

    def boxes(name: str, key: str, size: float) -> DataFrame:
        k = F.col(key)
        south, west = lat_of(k), lon_of(k)
        return table(spark, sf_dir, name).select(
            key, south.alias("south"), west.alias("west"), (south + size).alias("north"), (west + size).alias("east")
        )

    return spatial.box_join(boxes("supplier", "s_suppkey", 0.02), boxes("customer", "c_custkey", 0.01), 0.02).select("s_suppkey", "c_custkey")


@register("""
WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 10000) / 10.0::DOUBLE AS x, (c_custkey * 104729 % 10000) / 10.0::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey, (s_suppkey * 7919 % 10000) / 10.0::DOUBLE AS cx, (s_suppkey * 104729 % 10000) / 10.0::DOUBLE AS cy, 5.0 + s_suppkey % 20 AS r FROM supplier)
SELECT c_custkey, s_suppkey FROM p, s WHERE x >= cx - r AND x < cx + r AND y >= cy - r AND y < cy + r
""")
def ring_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in square footprints, a lower and left edge inside, an upper and right edge outside."""
    return spatial.within_rings(_plane(spark, sf_dir, "customer", "c_custkey"), _squares(spark, sf_dir), 20.0).select("c_custkey", "s_suppkey")


def _plane(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(key, (k * 7919 % 10000 / 10.0).alias("x"), (k * 104729 % 10000 / 10.0).alias("y"))


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.lit(5.0) + F.col("s_suppkey") % 20
    corner = lambda a, b: F.struct((F.col("x") + r * a).alias("x"), (F.col("y") + r * b).alias("y"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    return _plane(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", ring.alias("ring"), (F.lit(10.0) + F.col("s_suppkey") % 30).alias("height"))


@register("""
WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 10000) / 10.0::DOUBLE AS x, (c_custkey * 104729 % 10000) / 10.0::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey, (s_suppkey * 7919 % 10000) / 10.0::DOUBLE AS cx, (s_suppkey * 104729 % 10000) / 10.0::DOUBLE AS cy, 5.0 + s_suppkey % 20 AS r,
  (10.0 + s_suppkey % 30) / tan(radians(45)) AS l FROM supplier),
h AS (SELECT c_custkey FROM p, s WHERE y > cy - r AND y < cy + r AND x < cx - r AND x + l > cx - r)
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM h) THEN 1.0 ELSE 0.0 END::DOUBLE AS shade FROM p
""")
def prism_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points shaded by square prisms with the sun in the east at 45 degrees."""
    points = _plane(spark, sf_dir, "customer", "c_custkey")
    prisms = _squares(spark, sf_dir).select("ring", "height", F.lit(1.0).alias("opacity"))
    return shade.prism_shade(points, prisms, 90.0, 45.0, ["c_custkey"])


@register()
def edge_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shade of both sidewalks of edges between customers, with the sun in the southwest."""
    a, b = _plane(spark, sf_dir, "customer", "c_custkey"), F.col("c_custkey") % 90
    edges = a.select(F.col("c_custkey").alias("edge_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + b - 45).alias("bx"), (F.col("y") + 30).alias("by"))
    prisms = _squares(spark, sf_dir).select("ring", "height", F.lit(1.0).alias("opacity"))
    return shade.edge_shade(edges, prisms, 225.0, 35.0)


@register("""
WITH t AS (SELECT l_suppkey % 8 AS cell, l_orderkey AS lo, l_orderkey + l_linenumber AS hi, CASE WHEN l_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS side,
  l_partkey % 768 AS slot, l_suppkey % 256 AS shade_byte FROM lineitem)
SELECT cell, lo, hi, side, round(avg(shade_byte) / 255.0, 9) AS shade, count(*) AS slots FROM t WHERE slot IN (100, 101, 102, 103, 360, 361, 362, 363) GROUP BY 1, 2, 3, 4
""")
def shade_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shade of segment sides over eight slots of a long shade table."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("cell"),
        F.col("l_orderkey").alias("lo"),
        (F.col("l_orderkey") + F.col("l_linenumber")).alias("hi"),
        F.when(F.col("l_partkey") % 2 == 0, "left").otherwise("right").alias("side"),
        (F.col("l_partkey") % 768).alias("slot"),
        (F.col("l_suppkey") % 256).alias("shade_byte"),
    )
    return shade.window_means(rows, [100, 101, 102, 103, 360, 361, 362, 363]).withColumn("shade", F.round("shade", 9))


@register("""
WITH t AS (SELECT event_id, (epoch_us(ts) / 86400e6 - 10957.5) AS d FROM events),
a AS (SELECT event_id, d, radians(((d * 0.98560028 + 357.528) % 360 + 360) % 360) AS g FROM t),
b AS (SELECT event_id, d, radians(((d * 0.9856474 + 280.460) % 360 + 360) % 360 + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l, radians(23.439 - d * 4e-7) AS e FROM a),
c AS (SELECT event_id, asin(sin(e) * sin(l)) AS dec, radians(((d * 360.98564736629 + 280.46061837 - 73.98) % 360 + 360) % 360) - atan2(cos(e) * sin(l), cos(l)) AS h FROM b)
SELECT event_id, round(degrees(asin(sin(radians(40.75)) * sin(dec) + cos(radians(40.75)) * cos(dec) * cos(h))), 6) AS altitude FROM c
""")
def sun_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altitude of the sun at the events' instants."""
    from penumbra.functions.exposure import sun_position

    altitude = sun_position(F.col("ts"), F.lit(-73.98), F.lit(40.75))[1]
    return table(spark, sf_dir, "events").select("event_id", F.round(altitude, 6).alias("altitude"))
