"""Queries on rings, tile covers, shards of streets and places along shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import covers, linear, rings
from penumbra.operators.spatial import spread
from penumbra.plans.geometry import _haversine, _lat, _lon, lat_of, lon_of
from penumbra.plans.networks import ROW
from penumbra.plans.registry import register
from penumbra.plans.snapping import _GRID, _ONE, _edges
from penumbra.session import table

_N = "(5 + k % 4)"
#: Parts as rough circles; by their keys bow-ties (two points swapped), repeated points, a point that isn't one, slivers, and two points only.
_RINGS = f"""part_ring AS (SELECT p_partkey AS k, {_lon('p_partkey')} AS x0, {_lat('p_partkey')} AS y0, CASE WHEN p_partkey % 13 = 0 THEN 1e-6 ELSE 0.001::DOUBLE + p_partkey % 5 * 0.0003::DOUBLE END AS r FROM part),
seq AS (SELECT k, x0, y0, r, unnest(range({_N})) AS i FROM part_ring),
pt AS (SELECT k, i, x0 + r * cos(2 * pi() * CASE WHEN k % 7 = 0 THEN CASE i WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE i END ELSE i END / {_N}) AS x,
  y0 + r * sin(2 * pi() * CASE WHEN k % 7 = 0 THEN CASE i WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE i END ELSE i END / {_N}) AS y FROM seq WHERE NOT (k % 17 = 0 AND i > 1))"""


def _ring_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, points``: the distinct corners of every part's ring in order."""
    k = F.col("p_partkey")
    n = (k % 4 + 5).cast("int")
    r = F.when(k % 13 == 0, F.lit(1e-6)).otherwise(F.lit(0.001) + k % 5 * F.lit(0.0003))
    last = F.when(k % 17 == 0, 1).otherwise(n - 1)

    def corner(i: Column) -> Column:
        at = F.when(k % 7 == 0, F.when(i == 1, 2).when(i == 2, 1).otherwise(i)).otherwise(i)
        turn = F.lit(2.0) * F.lit(3.141592653589793) * at / n
        return F.struct((lon_of(k) + r * F.cos(turn)).alias("x"), (lat_of(k) + r * F.sin(turn)).alias("y"))

    # The keys of the table are few bytes, so they are spread before the work on their rings.
    return spread(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"]).select(k.alias("k"), F.transform(F.sequence(F.lit(0), last), corner).alias("points"))


@register(f"""
WITH {_RINGS},
ring AS (SELECT k, list({{'x': x, 'y': y}} ORDER BY i) AS p FROM pt GROUP BY 1),
seg AS (SELECT k, len(p) AS n, unnest(range(1, len(p) + 1)) AS i, p FROM ring WHERE len(p) >= 3),
s AS (SELECT k, n, i, p[i].x AS ax, p[i].y AS ay, p[i % n + 1].x AS bx, p[i % n + 1].y AS bz FROM seg),
area AS (SELECT k, abs(sum(ax * bz - bx * ay)) / 2 * 111320.0 * 111320.0 * greatest(cos(radians(avg(ay))), 0.05) AS m2 FROM s GROUP BY 1),
c AS (SELECT DISTINCT a.k FROM s a JOIN s b ON a.k = b.k AND b.i > a.i + 1 AND NOT (a.i = 1 AND b.i = a.n)
  WHERE sign((a.bx - a.ax) * (b.ay - a.ay) - (a.bz - a.ay) * (b.ax - a.ax)) <> sign((a.bx - a.ax) * (b.bz - a.ay) - (a.bz - a.ay) * (b.bx - a.ax))
    AND sign((b.bx - b.ax) * (a.ay - b.ay) - (b.bz - b.ay) * (a.ax - b.ax)) <> sign((b.bx - b.ax) * (a.bz - b.ay) - (b.bz - b.ay) * (a.bx - b.ax))),
told AS (SELECT k, len(p) AS n, (len(p) + (k % 5 = 1)::INTEGER) * CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END + (k % 11 = 0)::INTEGER AS given, len(p) + (len(p) >= 3 OR k % 5 = 1)::INTEGER AS clean,
  CASE WHEN len(p) < 3 THEN 'too_few' WHEN m2 < 1 THEN 'sliver' WHEN k IN (SELECT k FROM c) THEN 'crossing' END AS refused FROM ring LEFT JOIN area USING (k))
SELECT k AS p_partkey, refused, given <> clean AS repaired, CASE WHEN refused IS NULL THEN n + 1 END::INTEGER AS points FROM told
""")
def ring_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of all parts, given with repeats, gaps and points that aren't any, cleaned, closed and checked."""
    k, p = F.col("k"), F.col("points")
    twice = F.flatten(F.transform(p, lambda q: F.array(q, q)))
    none = F.array(F.struct(F.lit(float("nan")).alias("x"), F.lit(1.0).alias("y")))
    raw = F.when(k % 5 == 1, F.concat(p, F.slice(p, 1, 1))).otherwise(p)  # some come closed
    raw = F.when(k % 3 == 0, twice).otherwise(raw)
    raw = F.when(k % 11 == 0, F.concat(F.slice(raw, 1, 1), none, F.slice(raw, 2, F.size(raw)))).otherwise(raw)
    shapes = _ring_points(spark, sf_dir).select(k.alias("p_partkey"), raw.alias("ring"))
    return rings.repair(shapes, "p_partkey").select("p_partkey", "refused", "repaired", F.size("ring").alias("points")).withColumn("points", F.when(F.col("points") >= 0, F.col("points")))


@register(f"""
WITH {_RINGS}, n AS (SELECT k, count(*) AS n, k % 6 = 0 AS cutting FROM pt WHERE k % 17 <> 0 GROUP BY 1),
a AS (SELECT a.k, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM pt a JOIN n USING (k) JOIN pt b ON b.k = a.k AND b.i = (a.i + 1) % n.n GROUP BY 1)
SELECT k AS p_partkey, CASE WHEN cutting THEN 'open' WHEN k % 10 = 5 THEN 'branching' ELSE 'closed' END AS status, n - CASE WHEN cutting THEN 1 ELSE 0 END + CASE WHEN k % 10 = 5 AND NOT cutting THEN 1 ELSE 0 END AS ways,
  CASE WHEN NOT cutting AND k % 10 <> 5 THEN n + 1 END::INTEGER AS points, CASE WHEN NOT cutting AND k % 10 <> 5 THEN round(area * 1e9, 3) END AS area FROM n JOIN a USING (k)
""")
def ring_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of the parts' rings as ways in any order and direction, put together again; of every sixth ring one way is missing, some have
    a way too many."""
    k = F.col("k")
    corners = _ring_points(spark, sf_dir).where(k % 17 != 0)
    n = F.size("points")
    sides = corners.select("k", n.alias("n"), "points", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).where(~((k % 6 == 0) & (F.col("i") == 2)))
    a, b = F.get("points", F.col("i")), F.get("points", (F.col("i") + 1) % F.col("n"))
    line = F.when((k + F.col("i")) % 2 == 0, F.array(a, b)).otherwise(F.array(b, a))
    ways = sides.select(F.col("k").alias("relation_id"), (F.col("i") * 7 % 97).alias("way_id"), line.alias("points"))
    far = F.struct((F.get("points", F.lit(0))["x"] + 1).alias("x"), F.get("points", F.lit(0))["y"].alias("y"))
    spur = corners.where((k % 10 == 5) & (k % 6 != 0)).select(F.col("k").alias("relation_id"), F.lit(1000).alias("way_id"), F.array(F.get("points", F.lit(0)), far).alias("points"))
    found = rings.assemble(ways.union(spur))
    from penumbra.functions import geo

    return found.select(
        F.col("relation_id").alias("p_partkey"), "status", "ways", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"), F.round(F.abs(geo.ring_area(F.col("ring"))) * 1e9, 3).alias("area")
    )


_POLY = f"""poly AS (SELECT s_suppkey AS g, {_lon('s_suppkey')} AS x0, {_lat('s_suppkey')} AS y0, 0.01::DOUBLE + s_suppkey % 7 * 0.004::DOUBLE AS r FROM supplier),
corner AS (SELECT g, h, i, x0 + r * (CASE WHEN h = 1 THEN 0.4 ELSE 1 END) * [-1, 1, 1, -1][i] + CASE WHEN i = 3 THEN r * 0.37 ELSE 0 END AS x,
  y0 + r * (CASE WHEN h = 1 THEN 0.4 ELSE 1 END) * [-1, -1, 1, 1][i] AS y FROM poly, (SELECT unnest([0, 1]) AS h), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE h = 0 OR g % 3 = 0)"""


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted squares at the suppliers, every third with a hole."""
    s = F.col("s_suppkey")
    r = F.lit(0.01) + s % 7 * F.lit(0.004)

    def ring(size: float) -> Column:
        corner = lambda a, b, lean: F.struct((lon_of(s) + r * size * a + (r * 0.37 if lean else 0)).alias("x"), (lat_of(s) + r * size * b).alias("y"))
        return F.array(corner(-1, -1, False), corner(1, -1, False), corner(1, 1, True), corner(-1, 1, False), corner(-1, -1, False))

    holes = F.when(s % 3 == 0, F.array(ring(0.4))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    return table(spark, sf_dir, "supplier").select(s.alias("s_suppkey"), ring(1.0).alias("ring"), holes.alias("holes"))


_ZOOM = 15
_N15 = float(1 << _ZOOM)


@register(f"""
WITH {_POLY},
m AS (SELECT g, h, i, (x + 180) / 360 * {_N15} AS tx, (1 - asinh(tan(radians(y))) / pi()) / 2 * {_N15} AS ty FROM corner),
side AS (SELECT a.g, a.tx AS ax, a.ty AS ay, b.tx AS bx, b.ty AS bz FROM m a JOIN m b ON a.g = b.g AND a.h = b.h AND b.i = a.i % 4 + 1),
st AS (SELECT *, greatest(1, ceil(greatest(abs(bx - ax), abs(bz - ay))))::INTEGER AS n FROM side),
walked AS (SELECT g, floor(ax + (bx - ax) * i / n)::BIGINT AS x, floor(ay + (bz - ay) * i / n)::BIGINT AS y FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM st)),
ro AS (SELECT *, unnest(range(floor(least(ay, bz))::BIGINT, floor(greatest(ay, bz))::BIGINT + 1)) AS y FROM side),
cr AS (SELECT g, y, ax + (y + 0.5 - ay) * (bx - ax) / (bz - ay) AS xc FROM ro WHERE (ay > y + 0.5) <> (bz > y + 0.5)),
sp AS (SELECT g, y, min(xc) AS a, max(xc) AS b FROM (SELECT *, (row_number() OVER (PARTITION BY g, y ORDER BY xc) - 1) // 2 AS k FROM cr) GROUP BY g, y, k HAVING count(*) = 2),
inside AS (SELECT g, unnest(range(floor(a)::BIGINT, floor(b)::BIGINT + 1)) AS x, y FROM sp)
SELECT DISTINCT g AS s_suppkey, x, y FROM (SELECT * FROM walked UNION ALL SELECT * FROM inside)
""")
def polygon_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that slanted squares at the suppliers cover, without their holes."""
    shapes = _polygons(spark, sf_dir).select("s_suppkey", F.concat(F.array("ring"), "holes").alias("rings"))
    return covers.polygon_tiles(shapes, _ZOOM, "s_suppkey")


@register(f"""
WITH b AS (SELECT o_custkey, min({_lon('o_orderkey')}) AS w, min({_lat('o_orderkey')}) AS s, max({_lon('o_orderkey')}) AS e, max({_lat('o_orderkey')}) AS n FROM orders GROUP BY 1),
t AS (SELECT o_custkey, floor((w + 180) / 360 * 1024)::BIGINT AS x0, floor((e + 180) / 360 * 1024)::BIGINT AS x1,
  floor((1 - ln(tan(radians(n)) + 1 / cos(radians(n))) / pi()) / 2 * 1024)::BIGINT AS y0, floor((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2 * 1024)::BIGINT AS y1 FROM b),
u AS (SELECT o_custkey, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t))
SELECT o_custkey, x, y, array_to_string(list_transform(range(9, -1, -1), lambda z: ((x >> z) & 1) + 2 * ((y >> z) & 1)), '') AS quadkey FROM u
""")
def box_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles and quadkeys that the box around every customer's orders meets."""
    k = F.col("o_orderkey")
    boxes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(lon_of(k)).alias("west"), F.min(lat_of(k)).alias("south"), F.max(lon_of(k)).alias("east"), F.max(lat_of(k)).alias("north"))
    return covers.box_tiles(boxes, 10, "o_custkey")


_T = "floor((1 - ln(tan(radians({v})) + 1 / cos(radians({v}))) / pi()) / 2 * 65536)::BIGINT"
_GRID_ONLY = _GRID[: _GRID.index("p AS (")].rstrip().rstrip(",")


@register(f"""
WITH {_ONE}{_GRID_ONLY},
o AS (SELECT *, floor(((ax + bx) / 2 + 180) / 360 * 65536)::BIGINT AS tx, {_T.format(v="((ay + bz) / 2)")} AS ty FROM g WHERE from_id % 50 <> 7 AND to_id % 50 <> 7),
e AS (SELECT tx, ty, unnest([from_id, to_id]) AS node, unnest([ax, bx]) AS x, unnest([ay, bz]) AS y FROM o),
d AS (SELECT DISTINCT tx, ty, node, floor((x + 180) / 360 * 65536)::BIGINT <> tx OR {_T.format(v="y")} <> ty AS ghost FROM e),
s AS (SELECT tx, ty, count(*) AS edges, count(*) FILTER (floor((ax + 180) / 360 * 65536)::BIGINT <> tx OR {_T.format(v="ay")} <> ty OR floor((bx + 180) / 360 * 65536)::BIGINT <> tx OR {_T.format(v="bz")} <> ty) AS seams FROM o GROUP BY 1, 2)
SELECT tx AS tile_x, ty AS tile_y, edges, seams, count(*) AS nodes, count(*) FILTER (ghost) AS ghosts FROM d JOIN s USING (tx, ty) GROUP BY 1, 2, 3, 4
""")
def ghost_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets dealt to tiles, with the seams and the nodes outside of each tile; streets of missing crossings are left out."""
    edges = _edges(spark, sf_dir)
    c = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").where(c % 50 != 7).select(c.alias("node_id"), (F.lit(-74.0) + c % ROW * 0.0008).alias("lon"), (F.lit(40.5) + F.floor(c / ROW) * 0.0006).alias("lat"))
    owned, ships = covers.street_shards(edges, nodes, 16)
    one = owned.groupBy("tile_x", "tile_y").agg(F.count("*").alias("edges"), F.count_if("seam").alias("seams"))
    two = ships.groupBy("tile_x", "tile_y").agg(F.count("*").alias("nodes"), F.count_if("ghost").alias("ghosts"))
    return one.join(two, ["tile_x", "tile_y"])


@register(f"""
WITH {_POLY},
side AS (SELECT a.g, a.h, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM corner a JOIN corner b ON a.g = b.g AND a.h = b.h AND b.i = a.i % 4 + 1),
area AS (SELECT g, abs(sum(ax * bz - bx * ay)) / 2 AS area FROM side WHERE h = 0 GROUP BY 1),
q AS (SELECT c_custkey, {_lon('c_custkey')} AS x, {_lat('c_custkey')} AS y FROM customer),
hit AS (SELECT c_custkey, g, h, sum(((ay > y) <> (bz > y) AND x < (bx - ax) * (y - ay) / (bz - ay) + ax)::INTEGER) % 2 = 1 AS within FROM q JOIN poly ON abs(x - x0) < 0.1 AND abs(y - y0) < 0.1 JOIN side USING (g) GROUP BY 1, 2, 3),
own AS (SELECT c_custkey, g FROM hit GROUP BY 1, 2 HAVING bool_or(within AND h = 0) AND NOT bool_or(within AND h = 1))
SELECT c_custkey, g AS s_suppkey FROM own JOIN area USING (g) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY area, g) = 1
""")
def polygon_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest slanted square, holes left out, that holds each customer's place."""
    c = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", lon_of(c).alias("x"), lat_of(c).alias("y"))
    return rings.polygon_owner(points, _polygons(spark, sf_dir), "c_custkey", "s_suppkey", 0.02)


_SHAPES = f"""shp AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
pt AS (SELECT c, i, -74.0::DOUBLE + CASE WHEN c % 5 = 0 THEN abs(i - 4) ELSE i END * 0.002::DOUBLE AS x, 40.5::DOUBLE + o % 13 * 0.0003::DOUBLE AS y FROM shp),
seg AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS bz FROM pt WINDOW w AS (PARTITION BY c ORDER BY i)),
leg AS (SELECT *, {_haversine('x', 'y', 'bx', 'bz')} AS m FROM seg WHERE bx IS NOT NULL),
cum AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM leg)"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of every customer in the order of their keys as points of a line going east; every fifth line turns back."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("os"))
    step = lambda i: F.when(c % 5 == 0, F.abs(i - 3)).otherwise(i + 1)
    points = F.transform("os", lambda o, i: F.struct((F.lit(-74.0) + step(i) * F.lit(0.002)).alias("lon"), (F.lit(40.5) + o % 13 * F.lit(0.0003)).alias("lat")))
    return keys.select(c.alias("shape_id"), points.alias("points"))


@register(f"""
WITH {_SHAPES},
ride AS (SELECT c_custkey AS e, c_custkey - c_custkey % 3 AS c, CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 1 END AS f, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 3 + c_custkey % 4 END AS t FROM customer),
stop AS (SELECT e, c, k, -74.0::DOUBLE + (CASE k WHEN 0 THEN f ELSE t END + 0.3::DOUBLE) * 0.002::DOUBLE AS lon, 40.5::DOUBLE + (e % 11) * 0.0002::DOUBLE AS lat FROM ride, (SELECT unnest([0, 1]) AS k)),
flat AS (SELECT stop.*, i, start, m, (x - lon) * cos(radians(lat)) * 111320 AS px, (y - lat) * 111320 AS py, (bx - x) * cos(radians(lat)) * 111320 AS dx, (bz - y) * 111320 AS dy FROM stop JOIN cum USING (c)),
proj AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0.0, least(1.0, -(px * dx + py * dy) / (dx * dx + dy * dy))) END AS u FROM flat),
near AS (SELECT *, sqrt(pow(px + u * dx, 2) + pow(py + u * dy, 2)) AS d FROM proj QUALIFY row_number() OVER (PARTITION BY e, k ORDER BY round(sqrt(pow(px + u * dx, 2) + pow(py + u * dy, 2)), 6), i) = 1),
pair AS (SELECT a.e, a.i AS i, b.i AS j, a.start + a.u * a.m AS a, b.start + b.u * b.m AS b, greatest(a.d, b.d) AS snap FROM near a JOIN near b ON a.e = b.e AND a.k = 0 AND b.k = 1)
SELECT ride.e AS c_custkey, CASE WHEN j >= i AND b > a THEN j - i END::INTEGER AS interior, CASE WHEN j >= i AND b > a THEN round(b - a, 4) END AS metres, CASE WHEN j >= i AND b > a THEN round(snap, 4) END AS snap
FROM ride LEFT JOIN pair USING (e)
""")
def shape_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a customer's line between two stops of every customer; null where the line turns back or runs the other way."""
    c = F.col("c_custkey")
    lon = lambda i: F.lit(-74.0) + (i + F.lit(0.3)) * F.lit(0.002)
    lat = F.lit(40.5) + c % 11 * F.lit(0.0002)
    rides = table(spark, sf_dir, "customer").select(
        c.alias("edge_id"), (c - c % 3).alias("shape_id"), lon(F.when(c % 7 == 0, 5).otherwise(1)).alias("from_lon"), lat.alias("from_lat"), lon(F.when(c % 7 == 0, 2).otherwise(3 + c % 4)).alias("to_lon"), lat.alias("to_lat")
    )
    found = linear.slices(rides, _shapes(spark, sf_dir))
    return found.select(F.col("edge_id").alias("c_custkey"), F.when(F.col("interior").isNotNull(), F.size("interior")).alias("interior"), F.round("metres", 4).alias("metres"), F.round("snap", 4).alias("snap"))


@register(f"""
WITH {_SHAPES},
want AS (SELECT DISTINCT c, (c % 9) * 150.0 - 75 AS dist FROM pt),
ends AS (SELECT c, arg_min(x, i) AS x0, arg_min(y, i) AS y0, arg_max(x, i) AS x1, arg_max(y, i) AS y1 FROM pt GROUP BY 1),
tot AS (SELECT c, max(start + m) AS total FROM cum GROUP BY 1),
hit AS (SELECT want.c, x + (bx - x) * (dist - start) / m AS x, y + (bz - y) * (dist - start) / m AS y FROM want JOIN cum ON want.c = cum.c AND dist > start AND dist <= start + m)
SELECT c AS o_custkey, round(CASE WHEN dist <= 0 THEN x0 WHEN dist > coalesce(total, 0) THEN x1 ELSE hit.x END, 9) AS lon, round(CASE WHEN dist <= 0 THEN y0 WHEN dist > coalesce(total, 0) THEN y1 ELSE hit.y END, 9) AS lat
FROM want JOIN ends USING (c) LEFT JOIN tot USING (c) LEFT JOIN hit USING (c)
""")
def points_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point at a distance along every customer's line, its ends before and beyond."""
    at = (F.col("shape_id") % 9) * 150.0 - 75
    found = _shapes(spark, sf_dir).select("shape_id", linear.with_distances(F.col("points")).alias("line"), at.alias("at")).select("shape_id", linear.point_at(F.col("line"), F.col("at")).alias("p"))
    return found.select(F.col("shape_id").alias("o_custkey"), F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))
