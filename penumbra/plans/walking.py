"""Queries on transfers on foot, structure shares and entrances, over the street grid of all customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import routing, structure, walkability
from penumbra.plans.geometry import _haversine
from penumbra.plans.networks import _STREETS, ROW, starts, streets
from penumbra.plans.registry import register
from penumbra.plans.snapping import _GRID, _ONE, _edges
from penumbra.session import cut, table

#: Suppliers as stations, each at the crossing of a customer; up to three doors, two stops, and transfers both ways.
_AT = "(s_suppkey * 15 - s_suppkey % 7)"
_STATIONS_SQL = f"""st AS (SELECT s_suppkey AS s, {_AT} AS k FROM supplier),
sta AS (SELECT s, -74.0::DOUBLE + k % {ROW} * 0.0008::DOUBLE AS slon, 40.5::DOUBLE + k // {ROW} * 0.0006::DOUBLE AS slat FROM st),
door AS (SELECT s, j, slon + CASE WHEN s % 11 = 0 THEN 0.0004::DOUBLE ELSE (j - 1) * 0.0006::DOUBLE END AS dlon,
  slat + CASE WHEN s % 11 = 0 THEN 0.0003::DOUBLE ELSE ((s + j) % 3 - 1) * 0.0001::DOUBLE END AS dlat, (s + j) % 5 = 0 AS exit_only
  FROM sta, (SELECT unnest(range(3)) AS j) WHERE j < s % 4),
tr AS (SELECT s * 4 + d * 2 + w AS id, s, d = 0 AS leaving, s * 2 + w AS stop, slon + CASE WHEN w = 0 THEN 0.0011::DOUBLE ELSE -0.0013::DOUBLE END AS plon,
  slat + CASE WHEN w = 0 THEN 0.0001::DOUBLE ELSE 0.0007::DOUBLE END + CASE WHEN s % 13 = 0 THEN 2 ELSE 0 END AS plat
  FROM sta, (SELECT unnest(range(2)) AS d), (SELECT unnest(range(2)) AS w))"""


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    k = s * 15 - s % 7
    return table(spark, sf_dir, "supplier").select(
        s.alias("station_id"), (F.lit(-74.0) + k % ROW * 0.0008).alias("station_lon"), (F.lit(40.5) + F.floor(k / ROW) * 0.0006).alias("station_lat")
    )


def _doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, j = F.col("station_id"), F.col("j")
    spread = _stations(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(j < s % 4)
    # Every eleventh station's doors lie in the middle of a block, too far from any street.
    lon = F.col("station_lon") + F.when(s % 11 == 0, F.lit(0.0004)).otherwise((j - 1) * F.lit(0.0006))
    lat = F.col("station_lat") + F.when(s % 11 == 0, F.lit(0.0003)).otherwise(((s + j) % 3 - 1) * F.lit(0.0001))
    return spread.select((s * 4 + j).alias("door_id"), "station_id", lon.alias("lon"), lat.alias("lat"), ((s + j) % 5 == 0).alias("exit_only"))


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d, w = F.col("station_id"), F.col("d"), F.col("w")
    two = F.array(F.lit(0), F.lit(1))
    spread = _stations(spark, sf_dir).withColumn("d", F.explode(two)).withColumn("w", F.explode(two))
    lon = F.col("station_lon") + F.when(w == 0, 0.0011).otherwise(-0.0013)
    lat = F.col("station_lat") + F.when(w == 0, 0.0001).otherwise(0.0007) + F.when(s % 13 == 0, 2).otherwise(0)
    return spread.select(
        (s * 4 + d * 2 + w).alias("transfer_id"), "station_id", "station_lon", "station_lat", (s * 2 + w).alias("stop_id"), lon.alias("stop_lon"), lat.alias("stop_lat"),
        (d == 0).alias("leaving"), F.lit("spatial").alias("kind"), F.lit(180).alias("min_seconds"),
    )


def _steps_sql(points: str, key: str, lon: str, lat: str, reach: float) -> str:
    """The nodes that points can step onto, as ``operators.walkability.steps_onto`` finds them."""
    k = f"cos(radians({lat}))"
    dx, dy, px, py = f"((bx - ax) * {k})", "(bz - ay)", f"((ax - {lon}) * {k})", f"(ay - {lat})"
    t = f"greatest(0.0, least(1.0, -({px} * {dx} + {py} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"""SELECT {key}, node, min(step + along) AS cost FROM (
  SELECT *, unnest([from_id, to_id]) AS node, unnest([t * m, (1 - t) * m]) AS along FROM (
    SELECT *, sqrt(pow({px} + t * {dx}, 2) + pow({py} + t * {dy}, 2)) * 111195 AS step, {_haversine('ax', 'ay', 'bx', 'bz')} AS m FROM (
      SELECT *, {t} AS t FROM {points} JOIN g ON abs({lat} - ay) < 0.002 AND abs({lon} - ax) < 0.002)) WHERE step <= {reach}) GROUP BY 1, 2"""


_GRID_ONLY = _GRID[: _GRID.index("p AS (")]

_WALKS_SQL = f"""WITH RECURSIVE {_ONE}{_GRID_ONLY}{_STATIONS_SQL},
usable AS (SELECT id, stop, s * 4 + j AS door_id, dlon, dlat, 1.5 * {_haversine('dlon', 'dlat', 'plon', 'plat')} + 60 AS allowed, {_haversine('slon', 'slat', 'dlon', 'dlat')} AS inside
  FROM tr JOIN sta USING (s) JOIN door USING (s) WHERE leaving OR NOT exit_only),
stops AS (SELECT DISTINCT stop, plon, plat FROM tr),
ss AS ({_steps_sql('stops', 'stop', 'plon', 'plat', 25.0)}),
ds AS ({_steps_sql('(SELECT s * 4 + j AS door_id, dlon, dlat FROM door)', 'door_id', 'dlon', 'dlat', 25.0)}),
ways AS (SELECT from_id AS a, to_id AS b, {_haversine('ax', 'ay', 'bx', 'bz')} AS m FROM g UNION ALL SELECT to_id, from_id, {_haversine('ax', 'ay', 'bx', 'bz')} FROM g),
most AS (SELECT stop, max(allowed) AS most FROM usable GROUP BY 1),
r AS (SELECT stop, node, round(cost, 6) AS walked, most FROM ss JOIN most USING (stop) WHERE cost <= most
  UNION SELECT r.stop, w.b, round(r.walked + w.m, 6), r.most FROM r JOIN ways w ON w.a = r.node WHERE r.walked + w.m <= r.most),
far AS (SELECT stop, node, min(walked) AS walked FROM r GROUP BY 1, 2),
best AS (SELECT id, min(inside + routed) AS metres FROM (
  SELECT id, door_id, inside, allowed, min(walked + cost) AS routed FROM usable JOIN ds USING (door_id) JOIN far USING (stop, node) GROUP BY 1, 2, 3, 4) WHERE routed <= allowed GROUP BY 1),
told AS (SELECT id, s, leaving, metres, CASE WHEN id NOT IN (SELECT id FROM usable) THEN 'no_door' WHEN stop NOT IN (SELECT stop FROM ss) THEN 'stop_off_network'
  WHEN id NOT IN (SELECT id FROM usable JOIN ds USING (door_id)) THEN 'doors_off_network' WHEN metres IS NULL THEN 'detour' END AS refused FROM tr LEFT JOIN best USING (id))"""


@register(f"""{_WALKS_SQL}
SELECT id AS transfer_id, CASE WHEN refused IS NULL THEN 'walked' ELSE 'spatial' END AS kind, CASE WHEN refused IS NULL THEN floor(metres + 0.5)::BIGINT END AS walk_m,
  CASE WHEN refused IS NULL THEN greatest(60, ceil(floor(metres + 0.5) / 1.3))::INTEGER ELSE 180 END AS min_seconds, refused FROM told
""")
def walkable_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers between suppliers as stations and two stops each, over the streets between all customers; all four refusals occur."""
    limits = walkability.WalkLimits(snap=25.0, ratio=1.5, slack=60.0)
    done = walkability.promote(_transfers(spark, sf_dir), _doors(spark, sf_dir), _edges(spark, sf_dir), limits)
    return done.select("transfer_id", "kind", "walk_m", "min_seconds", "refused")


@register(f"""{_WALKS_SQL}
SELECT coalesce(refused, CASE WHEN leaving THEN 'walked_out' ELSE 'walked_in' END) AS outcome, count(*) AS transfers, count(DISTINCT s) AS stations FROM told GROUP BY 1
""")
def walkable_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of these transfers are walked each way or refused, and why."""
    limits = walkability.WalkLimits(snap=25.0, ratio=1.5, slack=60.0)
    return walkability.tally(walkability.promote(_transfers(spark, sf_dir), _doors(spark, sf_dir), _edges(spark, sf_dir), limits))


@register(f"""
WITH {_ONE}{_GRID_ONLY}
ride AS (SELECT id AS edge_id, 'R' || (id // {ROW} % 5) AS ref, -74.0::DOUBLE + id % {ROW} * 0.0008::DOUBLE AS x, 40.5::DOUBLE + id // {ROW} * 0.0006::DOUBLE + (id % 3) * 0.0004::DOUBLE AS y,
  -74.0::DOUBLE + (id % {ROW} + 2 + id % 3) * 0.0008::DOUBLE AS x1 FROM n),
way AS (SELECT *, from_id // {ROW} % 5 AS line, CASE edge_id % 7 WHEN 0 THEN 'underground' WHEN 1 THEN 'elevated' WHEN 2 THEN 'open_cut' WHEN 3 THEN 'embankment' ELSE 'at_grade' END AS structure
  FROM g WHERE edge_id % 7 <> 6 AND from_id // {ROW} % 5 <> 4 AND edge_id % 2 = 0),
num AS (SELECT *, greatest(8, least(60, floor({_haversine('x', 'y', 'x1', 'y')} / 50 + 0.5)))::INTEGER AS n FROM ride),
pt AS (SELECT edge_id AS ride, ref, n, i, x + (x1 - x) * (i / n::DOUBLE) AS lon, y AS lat FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM num)),
c AS (SELECT *, greatest(0.0, least(1.0, ((lon - ax) * (bx - ax) + (lat - ay) * (bz - ay)) / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)))) AS t
  FROM pt JOIN way ON ref = 'R' || line AND abs(lat - ay) < 0.003 AND abs(lon - ax) < 0.004),
d AS (SELECT *, {_haversine('lon', 'lat', '(ax + t * (bx - ax))', '(ay + t * (bz - ay))')} AS distance FROM c),
hit AS (SELECT * FROM d WHERE distance < 120 QUALIFY row_number() OVER (PARTITION BY ride, i ORDER BY round(distance, 6), edge_id) = 1),
k AS (SELECT ride, structure, count(*) AS k FROM hit GROUP BY 1, 2),
known AS (SELECT edge_id AS ride, coalesce(sum(k), 0) / (n + 1)::DOUBLE AS known, n FROM num LEFT JOIN k ON ride = edge_id GROUP BY edge_id, n)
SELECT ride AS edge_id, structure, round(k / (n + 1)::DOUBLE, 6) AS share, known >= 0.5 AS determined FROM k JOIN known USING (ride)
UNION ALL SELECT ride, 'unknown', round(1 - known, 6), known >= 0.5 FROM known WHERE known < 1
""")
def structure_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides from every customer along its row of streets, whose streets are ways of five services with structures; one has an excluded operator."""
    edges = _edges(spark, sf_dir)
    e, line = F.col("edge_id"), F.floor(F.col("from_id") / ROW) % 5
    kind = {0: ("tunnel", "yes"), 1: ("bridge", "viaduct"), 2: ("cutting", "yes"), 3: ("embankment", "yes"), 4: ("bridge", "no"), 6: ("railway", "platform")}
    tags = F.create_map(F.lit("railway"), F.lit("subway"))
    for rest, (tag, value) in kind.items():
        tags = F.when(e % 7 == rest, F.create_map(F.lit(tag), F.lit(value))).otherwise(tags)
    points = F.array(*(F.struct(F.col(f"{end}_lon").alias("lon"), F.col(f"{end}_lat").alias("lat")) for end in ("from", "to")))
    ways = edges.select(e.alias("way_id"), tags.alias("tags"), points.alias("points"))
    # A relation holds the streets along one row of its line; those across are members of another type.
    member = F.struct(F.when(e % 2 == 0, "way").otherwise("node").alias("type"), e.alias("ref"))
    relations = edges.groupBy(F.floor(F.col("from_id") / ROW).alias("row"), line.alias("line")).agg(F.collect_list(member).alias("members"))
    operator = F.when(F.col("line") == 4, "Some Port Authority").otherwise("City")
    relations = relations.select(F.create_map(F.lit("ref"), F.concat(F.lit("R"), "line"), F.lit("operator"), operator).alias("tags"), "members")
    c = F.col("c_custkey")
    lat = F.lit(40.5) + F.floor(c / ROW) * 0.0006 + c % 3 * F.lit(0.0004)
    rides = table(spark, sf_dir, "customer").select(
        c.alias("edge_id"), F.concat(F.lit("R"), F.floor(c / ROW) % 5).alias("ref"), (F.lit(-74.0) + c % ROW * 0.0008).alias("from_lon"), lat.alias("from_lat"),
        (F.lit(-74.0) + (c % ROW + 2 + c % 3) * 0.0008).alias("to_lon"), lat.alias("to_lat"),
    )
    found = structure.shares(rides, structure.service_ways(relations, ways, "port authority"))
    return found.select("edge_id", "structure", F.round("share", 6).alias("share"), "determined")


_NAMED = f"""en AS (SELECT o_orderkey AS e, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Exit of Line ' || (o_custkey * 7 // 20 % 9) || ' Hall' END AS name, -74.0::DOUBLE + o_orderkey * 7919 % 1000 * 0.000032::DOUBLE AS lon,
  40.5::DOUBLE + o_custkey // {ROW} * 0.0006::DOUBLE + o_orderkey % 60 * 0.00001::DOUBLE AS lat FROM orders)"""


@register(f"""
WITH {_STATIONS_SQL}, {_NAMED},
p AS (SELECT e, s, {_haversine('lon', 'lat', 'slon', 'slat')} AS m, coalesce(contains(lower(name), lower('line ' || (s % 9))) OR (s % 4 = 0 AND contains(name, 'Hall')), false) AS named
  FROM en JOIN sta ON abs(lat - slat) < 0.01 AND abs(lon - slon) < 0.01)
SELECT e AS o_orderkey, s AS s_suppkey, CASE WHEN named AND m < 400 THEN 'name' ELSE 'distance' END AS by FROM p WHERE (named AND m < 400) OR m < 300
QUALIFY row_number() OVER (PARTITION BY e ORDER BY NOT (named AND m < 400), m, s) = 1
""")
def entrance_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entrances, given to the station that their name holds, else to the nearest."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(o % 3 != 0, F.concat(F.lit("Exit of Line "), F.floor(c * 7 / 20) % 9, F.lit(" Hall")))
    lat = F.lit(40.5) + F.floor(c / ROW) * 0.0006 + o % 60 * 0.00001
    entrances = table(spark, sf_dir, "orders").select(o.alias("entrance_id"), name.alias("name"), (F.lit(-74.0) + o * 7919 % 1000 * 0.000032).alias("lon"), lat.alias("lat"))
    s = F.col("station_id")
    stations = _stations(spark, sf_dir).select(
        s, F.concat(F.lit("LINE "), s % 9).alias("station_name"), F.when(s % 4 == 0, "Hall").alias("local_name"), F.col("station_lon").alias("lon"), F.col("station_lat").alias("lat")
    )
    return walkability.match_entrances(entrances, stations).select(F.col("entrance_id").alias("o_orderkey"), F.col("station_id").alias("s_suppkey"), "by")


@register(f"""
WITH {_STATIONS_SQL}, {_NAMED},
near AS (SELECT e, s, {_haversine('lon', 'lat', 'slon', 'slat')} AS m, row_number() OVER (PARTITION BY e ORDER BY {_haversine('lon', 'lat', 'slon', 'slat')}, s) AS k
  FROM en JOIN sta ON abs(lat - slat) < 0.02 AND abs(lon - slon) < 0.02 WHERE s % 3 <> 0 AND {_haversine('lon', 'lat', 'slon', 'slat')} <= 900 QUALIFY k <= 3),
pair AS (SELECT a.e, a.k AS ka, b.k AS kb, a.s AS f, b.s AS t, (60 + abs(a.s - b.s) * 45) + (a.m + b.m) / 1.3 AS total
  FROM near a JOIN near b ON b.e = a.e + 32 WHERE a.s <> b.s AND abs(a.s - b.s) + 1 >= 3 AND abs(a.s - b.s) <= 40)
SELECT e AS o_orderkey, f AS entry_id, t AS exit_id, round(total, 4) AS seconds FROM pair QUALIFY row_number() OVER (PARTITION BY e ORDER BY total, ka, kb) = 1
""")
def best_train_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips from every order to the one 32 keys on: of the three nearest open stations at both ends the pair with the least walk, ride and walk."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    lat = F.lit(40.5) + F.floor(c / ROW) * 0.0006 + o % 60 * 0.00001
    points = table(spark, sf_dir, "orders").select(o.alias("point_id"), (F.lit(-74.0) + o * 7919 % 1000 * 0.000032).alias("lon"), lat.alias("lat"))
    stations = _stations(spark, sf_dir).select("station_id", F.col("station_lon").alias("lon"), F.col("station_lat").alias("lat"))
    trips = points.select(F.col("point_id").alias("trip_id"), F.col("point_id").alias("origin_id"), (F.col("point_id") + 32).alias("target_id"))
    s = F.col("station_id")
    spread = stations.select(s.alias("from_id"), F.explode(F.sequence(F.lit(-40), F.lit(40))).alias("d"))
    rides = spread.select("from_id", (F.col("from_id") + F.col("d")).alias("to_id"), (F.abs("d") * 45 + 60).alias("seconds"), (F.abs("d") + 1).alias("stations"))
    spans = walkability.ride_spans(stations, rides)
    near = cut(walkability.nearest_stations(points, spans, 3, 900.0, s % 3 != 0, ["to_low", "to_high"]))  # both ends are found once
    return walkability.best_pair(trips, near, near, rides).select(F.col("trip_id").alias("o_orderkey"), "entry_id", "exit_id", F.round("seconds", 4).alias("seconds"))


#: Streets with tags for bicycles; trips from the searches' starts over three more stops, the last of some out of reach.
_BIKE = f"""{_STREETS},
w AS (SELECT a, b, (40 + k % 7)::DOUBLE AS m, CASE WHEN k % 9 <> 0 THEN (k % 11) / 10.0::DOUBLE END AS shade, CASE WHEN k % 10 = 0 THEN 'steps' ELSE 'residential' END AS hw, k % 8 = 0 AS rough, k % 6 = 0 AS cyc, b % 3 = 0 AS cr
  FROM e WHERE NOT (k % 13 = 0 OR (k % 17 = 0 AND k % 2 = 0))),
p AS (SELECT a, b, m, shade, CASE WHEN cr THEN 6 * 4.5 / 1.4 ELSE 0 END AS sur, (m + CASE WHEN hw = 'steps' THEN 500 ELSE 0 END) / 4.5 AS sec,
  greatest(1.0, m + CASE WHEN hw = 'steps' THEN 500 ELSE 0 END + CASE WHEN rough THEN 75 ELSE 0 END - CASE WHEN cyc THEN least(40, m * 0.5) ELSE 0 END) * (1 - 0.8 * coalesce(shade, 0) * 0.7 * 0.9) AS c FROM w),
leg AS (SELECT s.source AS trip, leg, s.source + [0, 2, 41, 84][leg + 1] AS o, s.source + CASE WHEN leg = 2 AND s.source % 3 = 1 THEN -100000 ELSE [2, 41, 84][leg + 1] END AS t FROM s, (SELECT unnest(range(3)) AS leg)),
r AS (SELECT DISTINCT o AS source, o AS node, 0.0::DOUBLE AS cost FROM leg UNION SELECT r.source, p.b, round(r.cost + p.c + p.sur, 6) FROM r JOIN p ON p.a = r.node WHERE r.cost + p.c + p.sur <= 260),
far AS (SELECT source, node, min(cost) AS cost FROM r GROUP BY 1, 2),
told AS (SELECT trip, leg, cost IS NOT NULL AS found, cost - CASE WHEN t % 3 = 0 AND t <> o THEN 6 * 4.5 / 1.4 ELSE 0 END AS cost FROM leg LEFT JOIN far ON source = o AND node = t)"""


def _bike_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    a, b = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    both = streets(spark, sf_dir).join(n.toDF("_a", "_na"), a == F.col("_a")).join(n.toDF("_b", "_nb"), b == F.col("_b"))
    k = a * 31 + b * 17 + F.col("_na") + F.col("_nb")
    return both.select(
        "from_id", "to_id", F.col("seconds").alias("metres"), F.when(k % 9 != 0, F.col("shade")).alias("shade"), F.lit(None).cast("double").alias("shelter"),
        F.when(k % 10 == 0, "steps").otherwise("residential").alias("highway"), F.when(k % 17 == 0, "no").alias("access"),
        F.when(k % 13 == 0, "no").when((k % 17 == 0) & (k % 2 == 1), "designated").alias("bicycle"), F.lit(None).cast("string").alias("foot"), (k % 8 == 0).alias("rough"),
        F.lit(None).cast("string").alias("smoothness"), (k % 6 == 0).alias("is_cycleway"), (F.col("to_id") % 3 == 0).alias("to_crossing"),
    )


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    last = s + F.when(s % 3 == 1, -100000).otherwise(84)
    dwells = F.array(F.lit(9.0), F.lit(5.0), F.when(s % 3 == 0, F.lit(-2.0)), F.lit(7.0))
    return starts(spark, sf_dir).select(s.alias("trip_id"), F.array(s, s + 2, s + 41, last).alias("stops"), (s * 60.0).alias("depart"), dwells.alias("dwells"))


@register(f"WITH RECURSIVE {_BIKE} SELECT trip AS trip_id, leg::INTEGER AS leg, found, round(cost, 4) AS cost FROM told")
def trip_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips by bicycle over four stops: each leg's cheapest way after the shade discount; crossings at the legs' ends are free, banned streets aren't used."""
    edges = routing.priced(_bike_edges(spark, sf_dir), "bike", 0.8, 6.0, "sun", 0.9)
    told, _ = routing.routes(routing.legs_of(_trips(spark, sf_dir)), edges, 260.0)
    return told.withColumn("cost", F.round("cost", 4))


@register(f"""
WITH RECURSIVE {_BIKE},
walk AS (SELECT trip, leg, o, o AS node, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS m, 0.0::DOUBLE AS sec FROM leg
  UNION SELECT walk.trip, walk.leg, walk.o, p.b, round(walk.cost + p.c + p.sur, 6), round(walk.m + p.m, 6), round(walk.sec + p.sec, 6) FROM walk JOIN p ON p.a = walk.node WHERE walk.cost + p.c + p.sur <= 260),
best AS (SELECT trip, leg, arg_min(m, w.cost) AS m, arg_min(sec, w.cost) AS sec FROM walk w JOIN leg USING (trip, leg) WHERE node = t GROUP BY 1, 2),
st AS (SELECT told.trip, told.leg, found, best.m, best.sec FROM told LEFT JOIN best USING (trip, leg)),
k AS (SELECT *, trip * 60.0 + coalesce(sum(sec) OVER (PARTITION BY trip ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE leg WHEN 0 THEN 0 WHEN 1 THEN 300 ELSE 300 END AS dep,
  coalesce(bool_or(NOT found) OVER (PARTITION BY trip ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broken FROM st)
SELECT trip AS trip_id, leg::INTEGER AS leg, round(m, 4) AS metres, round(sec, 4) AS seconds, CASE WHEN NOT broken THEN round(dep, 4) END AS departs FROM k
""")
def trip_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres, seconds and departure of every leg of these trips, with stays at the stops between."""
    trips, edges = _trips(spark, sf_dir), routing.priced(_bike_edges(spark, sf_dir), "bike", 0.8, 6.0, "sun", 0.9)
    told, steps = routing.routes(routing.legs_of(trips), edges, 260.0)
    rows = routing.departures(routing.leg_stats(told, steps, edges), trips)
    return rows.select("trip_id", "leg", F.round("metres", 4).alias("metres"), F.round("seconds", 4).alias("seconds"), F.round("departs", 4).alias("departs"))


@register("""
WITH s AS (SELECT l_orderkey, l_linenumber AS i, l_suppkey AS f, l_partkey AS t, l_quantity::DOUBLE AS sec, CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END AS line, l_extendedprice AS x FROM lineitem),
m AS (SELECT *, CASE WHEN line IS NULL OR lag(line) OVER w IS NULL OR lag(line) OVER w <> line THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY i, t, f, x)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY i, t, f, x) - 1 AS ride FROM m)
SELECT l_orderkey, ride::BIGINT AS ride, max(line) AS line, arg_min(f, {'i': i, 't': t, 'f': f, 'x': x}) AS first, arg_max(t, {'i': i, 't': t, 'f': f, 'x': x}) AS last, sum(sec) AS seconds, count(*) AS stops FROM g GROUP BY 1, 2
""")
def collapsed_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as rides, those on one line after another put together."""
    line = F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag"))
    rides = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"), F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_quantity").cast("double").alias("seconds"), line.alias("line")
    )
    return routing.collapsed_rides(rides, ["l_orderkey"], "place", "line")
