"""Rings of polygons: cleaned and checked, put together from ways, and points held against polygons with holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators.graph import components
from penumbra.session import cut, cut_counted

#: Points closer than this in both degrees are one; the least area of a ring in square metres; fixed values.
SAME_DEG, LEAST_M2 = 1e-9, 1.0
#: Sides of a turn smaller than this count as straight; a fixed value.
STRAIGHT = 1e-12
#: Rings of up to so many sides, and relations of up to so many ways, are worked out in their row; fixed values.
FEW_SIDES, FEW_WAYS = 32, 64


def _same(p: Column, q: Column) -> Column:
    return (F.abs(p["x"] - q["x"]) < SAME_DEG) & (F.abs(p["y"] - q["y"]) < SAME_DEG)


def clean_ring(ring: Column) -> Column:
    """Points that are finite and on the globe, without repeats one after another, closed if there are three at least."""
    on_globe = lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)  # noqa: E731  false for NaN and infinities
    kept = F.filter(ring, lambda p: F.coalesce(on_globe(p) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]), F.lit(False)))
    single = F.transform(F.array(kept), lambda r: F.filter(r, lambda p, i: (i == 0) | ~_same(p, F.get(r, i - 1))))[0]
    close = lambda r: F.when((F.size(r) >= 3) & ~_same(F.get(r, F.lit(0)), F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    return F.transform(F.array(single), close)[0]


def ring_metres2(ring: Column) -> Column:
    """Area of a closed ring of degrees in square metres, on the plane of its mean latitude."""
    points = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    mid = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"]) / F.nullif(F.size(points), F.lit(0))
    return F.abs(geo.ring_area(ring)) * geo.METRES_PER_DEGREE * geo.METRES_PER_DEGREE * F.greatest(F.cos(F.radians(mid)), F.lit(0.05))


def _meeting(pairs: DataFrame) -> DataFrame:
    """Those ``pairs`` of sides ``s`` and ``t`` (``ax, ay, bx, by``) that have a point in common."""
    a, b, c, d = ((F.col(f"{s}.{p}x"), F.col(f"{s}.{p}y")) for s, p in (("s", "a"), ("s", "b"), ("t", "a"), ("t", "b")))
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    sign = lambda v: F.when(F.abs(v) < STRAIGHT, 0).otherwise(F.signum(v).cast("int"))
    # Arrays of one element, exploded, keep each turn from being written out in every place of its use: such code is too long to be compiled.
    turns = F.struct(*(turn(*of).alias(f"v{i}") for i, of in enumerate(((a, b, c), (a, b, d), (c, d, a), (c, d, b)))))
    known = pairs.withColumn("_v", F.explode(F.array(turns)))
    known = known.withColumn("_o", F.explode(F.array(F.struct(*(sign(F.col(f"_v.v{i}")).alias(f"o{i}") for i in range(4))))))
    o = [F.col(f"_o.o{i}") for i in range(4)]

    def on(p, q, r):
        return r[0].between(F.least(p[0], q[0]) - STRAIGHT, F.greatest(p[0], q[0]) + STRAIGHT) & r[1].between(F.least(p[1], q[1]) - STRAIGHT, F.greatest(p[1], q[1]) + STRAIGHT)

    met = ((o[0] != o[1]) & (o[2] != o[3])) | ((o[0] == 0) & on(a, b, c)) | ((o[1] == 0) & on(a, b, d)) | ((o[2] == 0) & on(c, d, a)) | ((o[3] == 0) & on(c, d, b))
    return known.where(met).drop("_v", "_o")


def crossings(rings: DataFrame, id_col: str) -> DataFrame:
    """``(id_col)`` of the closed rings two of whose sides meet though they are no neighbours.

    Of rings of up to ``FEW_SIDES`` sides every pair is tested where the ring lies, and only ids that crossed are shuffled. The box of a longer
    one is cut into about as many cells as it has sides, a side is repeated for those that its own box meets, and only sides of
    one cell are held against each other.
    """
    n = F.size("ring") - 1
    xs, ys = F.col("ring.x"), F.col("ring.y")
    across = F.ceil(F.sqrt(n.cast("double")))
    box = rings.where(n > FEW_SIDES).select(
        F.col(id_col).alias("_id"), "ring", n.alias("_n"), F.array_min(xs).alias("_x"), F.array_min(ys).alias("_y"),
        F.greatest((F.array_max(xs) - F.array_min(xs)) / across, F.lit(1e-9)).alias("_w"), F.greatest((F.array_max(ys) - F.array_min(ys)) / across, F.lit(1e-9)).alias("_h"),
    )
    count = F.greatest("_n", F.lit(0))  # filters may be tried in another order
    pairs = F.zip_with(F.slice("ring", 1, count), F.slice("ring", 2, count), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    few = rings.where(n.between(4, FEW_SIDES)).select(F.col(id_col).alias("_id"), "ring", n.alias("_n")).select("_id", "_n", pairs.alias("_all"))
    few = few.select("_id", "_n", "_all", F.posexplode("_all").alias("i", "s"))
    # Sides from the second after this one on; the last is a neighbour of the first.
    later = F.slice("_all", F.col("i") + 3, F.greatest(F.col("_n") - F.col("i") - 2 - F.when(F.col("i") == 0, 1).otherwise(0), F.lit(0)))
    crossed = _meeting(few.select("_id", "s", F.explode(later).alias("t"))).select("_id")
    sides = box.select("_id", "_n", "_x", "_y", "_w", "_h", F.posexplode(pairs).alias("i", "s"))
    for cell, low, size, a, b in (("_cx", "_x", "_w", "ax", "bx"), ("_cy", "_y", "_h", "ay", "by")):
        at = lambda v, low=low, size=size: F.floor((v - F.col(low)) / F.col(size))
        # A little wider, so that sides that touch on a cell's border share a cell.
        sides = sides.withColumn(cell, F.explode(F.sequence(at(F.least(f"s.{a}", f"s.{b}") - STRAIGHT), at(F.greatest(f"s.{a}", f"s.{b}") + STRAIGHT))))
    one = sides.select("_id", "_n", "_cx", "_cy", "i", F.col("s").alias("s"))
    two = sides.select("_id", "_cx", "_cy", F.col("i").alias("j"), F.col("s").alias("t"))
    apart = (F.col("j") > F.col("i") + 1) & ~((F.col("i") == 0) & (F.col("j") == F.col("_n") - 1))
    met = _meeting(one.join(two, ["_id", "_cx", "_cy"]).where(apart)).select("_id")
    return met.union(crossed).select(F.col("_id").alias(id_col)).distinct()


def repair(shapes: DataFrame, id_col: str) -> DataFrame:
    """``(id_col), ring, repaired, refused`` of every shape with a ``ring`` of ``x, y`` degrees: the cleaned ring to seven places, or null and why.

    Refusals in order: ``too_few`` (fewer than four points when closed), ``sliver`` (under a square metre), ``crossing``. ``repaired`` tells
    that the number of points changed.
    """
    rows = cut(shapes.select(id_col, F.size("ring").alias("_before"), clean_ring(F.col("ring")).alias("ring")))
    refused = F.when(F.size("ring") < 4, "too_few").when(ring_metres2(F.col("ring")) < LEAST_M2, "sliver")
    told = rows.withColumn("refused", refused)
    crossed = crossings(told.where("refused is null"), id_col).withColumn("_crossed", F.lit(True))
    told = told.join(crossed, id_col, "left").withColumn("refused", F.coalesce("refused", F.when(F.col("_crossed"), "crossing")))
    rounded = F.transform("ring", lambda p: F.struct(F.round(p["x"], 7).alias("x"), F.round(p["y"], 7).alias("y")))
    return told.select(id_col, F.when(F.col("refused").isNull(), rounded).alias("ring"), (F.size("ring") != F.col("_before")).alias("repaired"), "refused")


def assemble(members: DataFrame, relation: str = "relation_id", way: str = "way_id", rounds: int = 64) -> DataFrame:
    """Unordered ways joined end to end: ``(relation), ring_id, status, ways, ring``, a row a connected set of ways.

    ``members`` has the relation, the way and its ``points`` (x, y), in either direction. Where every end meets exactly one other the set is
    ``closed`` and ``ring`` starts with its smallest way, forwards; otherwise it is ``open`` (an end meets none) or ``branching``, without a
    ring. Relations of up to ``FEW_WAYS`` ways are put together in a row each. In larger ones ways go from one to the next by joins on their
    ends; places along a ring follow from doubling steps, so a ring of n ways takes log n rounds. Ways of fewer than two points are
    left out; ``ring_id`` is the smallest way.
    """
    ways = cut(members.where("size(points) >= 2").select(F.col(relation).alias("r"), F.col(way).alias("w"), "points"))
    # Ways without an id or an end are for the joins, which no null meets; so are relations that name a way twice.
    odd = F.col("w").isNull() | F.element_at("points", 1).isNull() | F.element_at("points", -1).isNull()
    named = ways.groupBy("r").agg(F.count("*").alias("n"), F.count_if(odd).alias("odd"), F.count_distinct("w").alias("different"))
    large, some = cut_counted(named.where(f"r is not null and (n > {FEW_WAYS} or odd > 0 or different < n)").select("r"), F.lit(True))
    names = {"r": relation}
    small = _in_rows(ways.where("r is not null").join(large, "r", "left_anti"))
    if not some:
        return small.withColumnsRenamed(names)
    return small.unionByName(_by_joins(ways.join(large, "r", "left_semi"), rounds)).withColumnsRenamed(names)


def _in_rows(ways: DataFrame) -> DataFrame:
    """``r, ring_id, status, ways, ring`` of ``ways(r, w, points)``, all ways of a relation in one row."""
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))  # noqa: E731  as a column it would be computed wherever it is used
    rows = ways.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("w", "points"))).alias("parts"))
    ends = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.array(F.element_at(p["points"], 1), F.element_at(p["points"], -1)))))
    rows = once(rows, "ends", ends)
    # Ways with the numbers of the points where they begin and end.
    number = lambda p, i: F.array_position("ends", F.element_at(p["points"], i)).cast("int")
    rows = once(rows, "links", F.transform("parts", lambda p, i: F.struct((i + 1).alias("i"), number(p, 1).alias("a"), number(p, -1).alias("b"))))

    def joined(label: Column, q: Column) -> Column:
        """Labels of the points after a way made those of its two ends one."""
        a, b = F.get(label, q["a"] - 1), F.get(label, q["b"] - 1)
        return F.transform(label, lambda v: F.when((v == a) | (v == b), F.least(a, b)).otherwise(v))

    rows = once(rows, "label", F.aggregate("links", F.sequence(F.lit(1), F.size("ends")), joined))
    rows = rows.withColumn("set", F.explode(F.array_distinct("label")))
    # Ways are sorted, so the first of a set is its smallest.
    rows = once(rows, "own", F.filter("links", lambda q: F.get("label", q["a"] - 1) == F.col("set")))
    all_ = F.flatten(F.transform("own", lambda q: F.array(q["a"], q["b"])))
    rows = once(rows, "met", F.transform(F.array(all_), lambda e: F.transform(e, lambda x: F.size(F.filter(e, lambda y: y == x))))[0])
    rows = rows.withColumn("status", F.when(F.array_max("met") > 2, "branching").when(F.array_min("met") < 2, "open").otherwise("closed"))

    def on(walked: Column, _: Column) -> Column:
        """The walk with the other way that meets the point where it has come to."""
        last = F.element_at(walked, -1)
        ahead = F.filter("own", lambda q: (q["i"] != last["i"]) & ((q["a"] == last["at"]) | (q["b"] == last["at"])))
        step = lambda q: F.struct(q["i"].alias("i"), F.when(q["a"] == last["at"], q["b"]).otherwise(q["a"]).alias("at"), (q["a"] == last["at"]).alias("forward"))
        return F.concat(walked, F.slice(F.transform(ahead, step), 1, 1))

    first = F.element_at("own", 1)
    begun = F.array(F.struct(first["i"].alias("i"), first["b"].alias("at"), F.lit(True).alias("forward")))
    walk = F.when(F.col("status") == "closed", F.aggregate(F.slice("own", 2, F.size("own")), begun, on))
    rows = once(rows, "walk", walk)
    laid = F.transform("walk", lambda h: F.when(h["forward"], F.get("parts", h["i"] - 1)["points"]).otherwise(F.reverse(F.get("parts", h["i"] - 1)["points"])))
    rows = once(rows, "body", F.flatten(F.transform(laid, lambda p: F.slice(p, 1, F.size(p) - 1))))
    return rows.select("r", F.get("parts", F.element_at("own", 1)["i"] - 1)["w"].alias("ring_id"), "status", F.size("own").cast("long").alias("ways"), F.concat("body", F.slice("body", 1, 1)).alias("ring"))


def _by_joins(ways: DataFrame, rounds: int) -> DataFrame:
    """As ``_in_rows``, for relations of any number of ways."""
    ways = cut(ways.select("r", "w", "points", F.element_at("points", 1).alias("a"), F.element_at("points", -1).alias("b")))
    # A way in each direction; the next one begins where it ends and is another way.
    halves = ways.select("r", "w", F.lit(True).alias("forward"), F.col("a").alias("begin"), F.col("b").alias("end")).union(
        ways.select("r", "w", F.lit(False).alias("forward"), F.col("b").alias("begin"), F.col("a").alias("end"))
    )
    # Both directions of a way begin at one of its ends each, so the beginnings at a point are the ends that meet there.
    degree = halves.groupBy("r", F.col("begin").alias("end")).agg(F.count("*").alias("met"))
    halves = cut(halves.join(degree, ["r", "end"]))
    start = halves.select("r", F.col("begin").alias("end"), F.struct("w", "forward").alias("next"))
    # At the point where it ends a way meets itself too, in the opposite direction; a loop of one way is its own next.
    loop = F.col("begin") == F.col("end")
    steps = halves.where("met = 2").join(start, ["r", "end"])
    turned = (F.col("next.w") == F.col("w")) & (F.col("next.forward") != F.col("forward"))
    itself = (F.col("next.w") == F.col("w")) & (F.col("next.forward") == F.col("forward"))
    steps = cut(steps.where(F.when(loop, itself).otherwise(~turned)).select("r", F.struct("w", "forward").alias("half"), "next"))
    key = lambda h: F.struct("r", h)
    met = steps.select(key(F.col("half.w").alias("w")).alias("from_id"), key(F.col("next.w").alias("w")).alias("to_id"))
    # Ends that several ways share join them as well, as one set.
    first = halves.groupBy("r", "end").agg(F.min("w").alias("first"))
    spread = halves.join(first, ["r", "end"]).select(key(F.col("w")).alias("from_id"), key(F.col("first").alias("w")).alias("to_id"))
    sets = components(met.union(spread))
    own = ways.select(key(F.col("w")).alias("node"), "r", "w").join(sets, "node", "left").select("r", "w", F.coalesce("component.w", "w").alias("ring_id"))
    ends = halves.groupBy("r", "w").agg(F.min("met").alias("low"), F.max("met").alias("high"))
    known = cut(own.join(ends, ["r", "w"]))
    status = F.when(F.max("high") > 2, "branching").when(F.min("low") < 2, "open").otherwise("closed")
    told = cut(known.groupBy("r", "ring_id").agg(status.alias("status"), F.count("*").alias("ways")))
    # Places: how many steps to the smallest way, forwards, at which the chain is cut.
    round_ = known.join(told.where("status = 'closed'"), ["r", "ring_id"]).select("r", F.col("w").alias("_w"), "ring_id")
    chain = steps.join(round_, (steps["r"] == round_["r"]) & (F.col("half.w") == F.col("_w"))).select(steps["r"], "half", "next", "ring_id")
    home = (F.col("next.w") == F.col("ring_id")) & F.col("next.forward")
    chain = cut(chain.select("r", "ring_id", "half", F.when(~home, F.col("next")).alias("next"), F.lit(1).alias("far"), home.alias("done")))
    settled = chain.where("done").count()
    for _ in range(rounds):
        before = settled
        ahead = chain.select("r", F.col("half").alias("next"), F.col("next").alias("then"), F.col("far").alias("more"), F.col("done").alias("there"))
        moved = chain.join(ahead, ["r", "next"], "left").select(
            "r", "ring_id", "half", F.when(F.col("done"), None).otherwise(F.col("then")).alias("next"), F.when(F.col("done"), F.col("far")).otherwise(F.col("far") + F.col("more")).alias("far"), (F.col("done") | F.col("there")).alias("done")
        )
        # The other direction of a ring never comes to the cut; it goes round until the first has settled.
        chain, settled = cut_counted(moved, F.col("done"))
        if settled == before:
            break
    laid = chain.where("done").join(ways, (chain["r"] == ways["r"]) & (F.col("half.w") == F.col("w"))).select(
        chain["r"], "ring_id", (-F.col("far")).alias("place"), F.when(F.col("half.forward"), F.col("points")).otherwise(F.reverse("points")).alias("points")
    )
    rings = laid.groupBy("r", "ring_id").agg(F.sort_array(F.collect_list(F.struct("place", "points"))).alias("parts"))
    body = F.flatten(F.transform("parts", lambda p: F.slice(p["points"], 1, F.size(p["points"]) - 1)))
    rings = rings.select("r", "ring_id", F.concat(body, F.slice(body, 1, 1)).alias("ring"))
    return told.join(rings, ["r", "ring_id"], "left").select("r", "ring_id", "status", "ways", "ring")


def point_in_polygon(x: Column, y: Column, outer: Column, holes: Column) -> Column:
    """Whether a point lies in the outer ring and in none of the holes."""
    return geo.point_in_ring(x, y, outer) & ~F.coalesce(F.exists(holes, lambda h: geo.point_in_ring(x, y, h)), F.lit(False))


def polygon_owner(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, size: float) -> DataFrame:
    """``(point_id, polygon_id)``: the smallest polygon (by area, then id) whose ``ring`` without its ``holes`` holds the point ``x, y``.

    Points of one place are looked up once, and of polygons with the same rings the smallest id stands for all.
    """
    xs, ys = F.col("ring.x"), F.col("ring.y")
    merged = polygons.groupBy("ring", "holes").agg(F.min(F.struct(polygon_id)).alias("_of")).select(F.col(f"_of.{polygon_id}").alias(polygon_id), "ring", "holes")
    laid = merged.select(polygon_id, "ring", "holes", F.abs(geo.ring_area(F.col("ring"))).alias("_area"))
    for cell, v in (("_cx", xs), ("_cy", ys)):
        laid = laid.withColumn(cell, F.explode(F.sequence(geo.grid_cell(F.array_min(v), size), geo.grid_cell(F.array_max(v), size))))
    probes = points.select("x", "y").distinct().withColumn("_cx", geo.grid_cell(F.col("x"), size)).withColumn("_cy", geo.grid_cell(F.col("y"), size))
    held = probes.join(laid, ["_cx", "_cy"]).where(point_in_polygon(F.col("x"), F.col("y"), F.col("ring"), F.col("holes")))
    owner = held.groupBy("x", "y").agg(F.min(F.struct("_area", polygon_id)).alias("b"))
    best = points.select(point_id, "x", "y").join(owner, ["x", "y"]).groupBy(point_id).agg(F.min("b").alias("b"))
    return best.select(point_id, F.col(f"b.{polygon_id}").alias(polygon_id))
