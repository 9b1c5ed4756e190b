"""Routes by travel mode, discounted for shade or shelter, over several legs, and what a trip adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions import exposure, ways
from penumbra.operators import search
from penumbra.session import cut, cut_counted

#: Largest discount of an edge in full shade or shelter; a fixed value.
MOST_SAVED = 0.7


def priced(edges: DataFrame, mode: str, strength: float, crossing: float = 0.0, objective: str = "sun", solar: float = 1.0) -> DataFrame:
    """Edges that the mode may use, with ``cost`` in metres, ``surcharge`` (what of it is the crossing at the edge's end) and ``seconds``.

    ``edges`` has ``from_id, to_id, metres, shade, shelter, highway, access, bicycle, foot, rough, smoothness, is_cycleway, to_crossing``. The mode's metres
    are discounted by ``strength`` times the shade (under a sun of ``solar``) or, with the objective ``rain``, the shelter, at most by 70 percent;
    a crossing costs ``crossing`` walked metres, as many more as the mode is faster.
    """
    if objective not in ("sun", "rain"):
        raise ValueError(f"no objective {objective}")
    allowed = edges.where(~ways.prohibited(mode, F.col("highway"), F.col("access"), F.col("bicycle"), F.col("foot")))
    metres = exposure.mode_metres(mode, F.col("metres"), F.col("highway"), F.col("rough"), F.col("smoothness"), F.col("is_cycleway"))
    saved = F.coalesce("shelter", F.lit(0.0)) * MOST_SAVED if objective == "rain" else F.coalesce("shade", F.lit(0.0)) * (MOST_SAVED * solar)
    extra = crossing * exposure.MODES[mode][0] / exposure.MODES["walk"][0]
    surcharge = F.when(F.coalesce("to_crossing", F.lit(False)), F.lit(extra)).otherwise(0.0)
    return allowed.select(
        "from_id", "to_id", "metres", "shade", "shelter", surcharge.alias("surcharge"), (metres * (1 - strength * saved) + surcharge).alias("cost"),
        exposure.mode_seconds(mode, F.col("metres"), F.col("highway")).alias("seconds"),
    )


def legs_of(trips: DataFrame) -> DataFrame:
    """``trip_id, leg, origin, target`` of every two stops after one another of ``trips(trip_id, stops)``."""
    pairs = F.zip_with(F.slice("stops", 1, F.size("stops") - 1), F.slice("stops", 2, F.size("stops") - 1), lambda a, b: F.struct(a.alias("origin"), b.alias("target")))
    return trips.where("size(stops) >= 2").select("trip_id", F.posexplode(pairs).alias("leg", "p")).select("trip_id", "leg", "p.origin", "p.target")


def routes(legs: DataFrame, edges: DataFrame, limit: float, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The cheapest way of every leg over ``priced`` edges: ``trip_id, leg, found, cost`` and its steps ``trip_id, leg, place, from_id, to_id``.

    One search serves all legs from a node. The crossing at a leg's target costs nothing. Ways of over ``limit`` aren't found. Of parallel edges
    the cheapest counts (then the shortest); steps are rebuilt from predecessors, place 0 ends at the target.
    """
    best = edges.groupBy("from_id", "to_id").agg(F.min(F.struct("cost", "metres", "surcharge")).alias("b")).select("from_id", "to_id", "b.cost", "b.surcharge")
    best = cut(best)
    found = cut(search.least(best.select("from_id", "to_id", "cost"), legs.select(F.col("origin").alias("source")).distinct(), limit))
    # An end's crossing is the same over every edge into it.
    ends = best.groupBy(F.col("to_id").alias("target")).agg(F.max("surcharge").alias("surcharge"))
    reached = found.select(F.col("source").alias("origin"), F.col("node").alias("target"), F.col("cost").alias("raw"))
    told = legs.join(reached, ["origin", "target"], "left").join(ends, "target", "left")
    cost = F.when(F.col("origin") == F.col("target"), 0.0).otherwise(F.col("raw") - F.coalesce("surcharge", F.lit(0.0)))
    told = told.select("trip_id", "leg", F.col("raw").isNotNull().alias("found"), F.when(F.col("raw").isNotNull(), cost).alias("cost"))
    back = found.where("before is not null").select(F.col("source").alias("origin"), F.col("node").alias("to_id"), F.col("before").alias("from_id"))
    at, steps = cut(legs.select("trip_id", "leg", "origin", F.col("target").alias("to_id"))), None
    for place in range(rounds):
        here, n = cut_counted(at.join(back, ["origin", "to_id"]).select("trip_id", "leg", F.lit(place).alias("place"), "origin", "from_id", "to_id"), F.lit(True))
        steps = here if steps is None else steps.union(here)
        if not n:
            return told, steps.drop("origin")
        at = here.select("trip_id", "leg", "origin", F.col("from_id").alias("to_id"))
    raise RuntimeError(f"a way has over {rounds} steps")


def leg_stats(told: DataFrame, steps: DataFrame, edges: DataFrame, field: str = "shade") -> DataFrame:
    """``trip_id, leg, found, cost, metres, seconds, covered`` of every leg: ``covered`` is the metre-weighted ``field``, null for a leg without metres or
    with an edge whose value isn't known."""
    edge = edges.groupBy("from_id", "to_id").agg(F.min(F.struct("cost", "metres", "seconds", field)).alias("b")).select("from_id", "to_id", "b.metres", "b.seconds", F.col(f"b.{field}").alias("_f"))
    known = F.count("_f") == F.count("*")
    sums = steps.join(edge, ["from_id", "to_id"]).groupBy("trip_id", "leg").agg(
        F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"), F.when(known & (F.sum("metres") > 0), F.sum(F.col("_f") * F.col("metres")) / F.sum("metres")).alias("covered")
    )
    zero = lambda c: F.when(F.col("found"), F.coalesce(c, F.lit(0.0))).alias(c)
    return told.join(sums, ["trip_id", "leg"], "left").select("trip_id", "leg", "found", "cost", zero("metres"), zero("seconds"), "covered")


def departures(stats: DataFrame, trips: DataFrame) -> DataFrame:
    """The legs' stats with ``departs``: seconds from ``trips(trip_id, depart, dwells)``' start, after the legs before and the stays at the stops between;
    null after a leg that wasn't found. ``dwells`` holds minutes of every stop; those of the ends delay nothing; missing and negative ones are 0."""
    order = Window.partitionBy("trip_id").orderBy("leg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stay = F.when(F.col("leg") > 0, F.greatest(F.lit(0.0), F.coalesce(F.get("dwells", F.col("leg")).cast("double"), F.lit(0.0))) * 60).otherwise(0.0)
    rows = stats.join(trips.select("trip_id", "depart", "dwells"), "trip_id").withColumn("_stay", stay)
    spent = F.coalesce(F.sum("seconds").over(before), F.lit(0.0)) + F.sum("_stay").over(order)
    broken = F.coalesce(F.max((~F.col("found")).cast("int")).over(before), F.lit(0)) == 1
    return rows.withColumn("departs", F.when(~broken, F.col("depart") + spent)).drop("_stay", "depart", "dwells")


def totals(stats: DataFrame, trips: DataFrame) -> DataFrame:
    """``trip_id, found, metres, seconds, covered`` of every trip: seconds with the stays at the stops between, ``covered`` by metres over the legs that know theirs.
    A trip with a leg that wasn't found has no totals."""
    known = F.col("covered").isNotNull()
    sums = stats.groupBy("trip_id").agg(
        F.min("found").alias("found"), F.sum("metres").alias("metres"), F.sum("seconds").alias("walked"), F.sum(F.when(known, F.col("covered") * F.col("metres"))).alias("_a"), F.sum(F.when(known, F.col("metres"))).alias("_b")
    )
    between = F.slice("dwells", 2, F.greatest(F.size("dwells") - 2, F.lit(0)))
    stay = F.aggregate(between, F.lit(0.0), lambda s, d: s + F.greatest(F.lit(0.0), F.coalesce(d.cast("double"), F.lit(0.0)))) * 60
    rows = sums.join(trips.select("trip_id", F.coalesce(stay, F.lit(0.0)).alias("_stay")), "trip_id")
    when = lambda c: F.when(F.col("found"), c)
    return rows.select("trip_id", "found", when(F.col("metres")).alias("metres"), when(F.col("walked") + F.col("_stay")).alias("seconds"), when(F.col("_a") / F.nullif("_b", F.lit(0.0))).alias("covered"))


def collapsed_rides(rides: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """Rides one after another on the same line as one: ``keys, ride, line, first, last, seconds, stops`` of ``rides`` with ``from_id, to_id, seconds``.

    A walk, or a ride without a line, stands alone and parts those before and after.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.col(line).isNull() | F.lag(line).over(w).isNull() | (F.lag(line).over(w) != F.col(line))
    marked = rides.withColumn("ride", F.sum(new.cast("int")).over(w) - 1)
    return marked.groupBy(*keys, "ride").agg(
        F.max(line).alias(line), F.min_by("from_id", order).alias("first"), F.max_by("to_id", order).alias("last"), F.sum("seconds").alias("seconds"), F.count("*").alias("stops")
    )


def outside(points: DataFrame, nodes: DataFrame, point_id: str, metres: float = 200.0) -> DataFrame:
    """The sketch's points ``(point_id), lon, lat`` that lie farther than ``metres`` from every node of the graph."""
    from penumbra.operators.spatial import radius_join

    near = radius_join(points.select(point_id, "lon", "lat"), nodes.select(F.col("node_id"), "lon", "lat"), metres).select(point_id).distinct()
    return points.join(near, point_id, "left_anti")

