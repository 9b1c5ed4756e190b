"""Searches under a budget of time and of sun: one way, with waits, and there and back.

A search runs in rounds of joins. Only the labels found last meet the edges, and what they lead to is held
against the labels settled before; a label names the one that it came from instead of carrying its walk, and
walks are rebuilt for those asked for. Every round is a written table, so a lost executor repeats a round at most.

Edges are ``from_id, to_id, seconds, shade`` and, with buckets, ``series``: the shade by bucket of the time at
which the edge's end is reached, the last one going on after the series' end. An edge costs its seconds and, of sun,
``seconds * (1 - shade)``. The sun of a label is held to a microsecond after every edge, so equal sums in another order are
equal, and a budget allows for the rounding of the last price.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.session import cut, cut_counted

#: Labels' ids leave so many bits for the place within a round.
_ROUND_BITS = 50
#: What rounding alone may put on top of a budget of sun, and on a price between labels of different times; fixed values.
_EXCESS, _ROUNDING = 1e-9, 1e-5


def shade_at(seconds: Column, series: Column, static: Column, bucket_seconds: float) -> Column:
    """Shade on arrival: of the bucket the time falls into, the last one after the series' end; without a series the static value."""
    place = F.least(F.floor(seconds / bucket_seconds), F.size(series) - 1).cast("int") + 1
    return F.when(series.isNotNull() & (F.size(series) > 0), F.element_at(series, F.greatest(place, F.lit(1)))).otherwise(static)


def least(edges: DataFrame, starts: DataFrame, limit: float | None, rounds: int = 10_000, hops: int | None = None) -> DataFrame:
    """``(source, node, cost, before)``: the least sum of ``cost`` over ``edges(from_id, to_id, cost)`` from each start, up to
    ``limit``, and the node before (null at the start; of equal costs the smallest). Costs may be 0 but not negative.

    ``starts`` has ``source`` and may have ``node`` and ``cost``, several a source: what it takes to step onto the graph there.
    Without a ``limit`` it has a ``limit`` of each source. With ``hops`` only walks of at most so many edges count.
    """
    out = cut(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"), F.col("cost").alias("step")))
    none = F.lit(None).cast(out.schema["node"].dataType)
    node = F.col("node") if "node" in starts.columns else F.col("source")
    cost = F.col("cost").cast("double") if "cost" in starts.columns else F.lit(0.0)
    most = F.lit(float(limit)) if limit is not None else F.col("limit").cast("double")
    key = ["source", "limit", "node"]
    # The smallest struct wins: the cost, then what was there before, then the smallest node before.
    first = starts.select("source", most.alias("limit"), node.alias("node"), F.struct(cost.alias("cost"), F.lit(False).alias("fresh"), none.alias("before")).alias("best"))
    state = cut(first.where("best.cost <= limit").groupBy(key).agg(F.min("best").alias("best")).withColumn("fresh", F.lit(True)))
    for turn in range(rounds):
        if turn == hops:
            return state.select("source", "node", "best.cost", "best.before")
        cost = F.col("best.cost") + F.col("step")
        moved = state.where("fresh").join(out, "node").where(cost <= F.col("limit"))
        moved = moved.select("source", "limit", F.col("next").alias("node"), F.struct(cost.alias("cost"), F.lit(True).alias("fresh"), F.col("node").alias("before")).alias("best"))
        settled = state.select(*key, F.col("best").withField("fresh", F.lit(False)).alias("best"))
        merged = settled.union(moved).groupBy(key).agg(F.min("best").alias("best"))
        state, found = cut_counted(merged.withColumn("fresh", F.col("best.fresh")), F.col("fresh"))
        if not found:
            return state.select("source", "node", "best.cost", "best.before")
    raise RuntimeError(f"the search did not end in {rounds} rounds")


class Budget(NamedTuple):
    """What a search may spend, how shade changes with time, and what else a walker may do."""

    seconds: float
    sun: float | None = None
    #: Length of a shade bucket; None where shade doesn't change.
    bucket_seconds: float | None = None
    #: A walker may stand at a node, on its shadiest edge, until the next bucket begins.
    waits: bool = False
    #: Labels kept a node and bucket, and labels a source after which its search stops; None: no cap, and the result is exact.
    slot_labels: int | None = None
    max_labels: int | None = None


class Found(NamedTuple):
    """The labels of a search and how it ended."""

    #: ``source, node, seconds, sun, label, parent, waited``: all labels, also those that later ones dominate, so that every walk can be rebuilt.
    labels: DataFrame
    #: ``source, outcome, labels, dropped``: ``exact``, ``approximate`` (a slot's cap dropped labels) or ``budget-exhausted``.
    outcomes: DataFrame


def bucket_count(edges: DataFrame, bucket_seconds: float | None) -> int:
    """How many buckets the series tell apart, 1 at least."""
    return max((edges.agg(F.max(F.size("series"))).first()[0] or 1) if bucket_seconds else 1, 1)


def _bucket(seconds: Column, bucket_seconds: float | None, buckets: int) -> Column:
    return F.least(F.floor(seconds / bucket_seconds), F.lit(buckets - 1)).cast("int") if bucket_seconds else F.lit(0)


def _slack(edges: DataFrame, budget: Budget, buckets: int) -> list[tuple[float, float]]:
    """``(jump, rate)`` of every bucket: a label ``d`` seconds earlier than another of its bucket pays at most ``jump + d * rate``
    more on the same way on.

    It may end edges before a bucket's boundary that the later one ends after it: one that began before, at the
    edges' largest extra price, and others within ``d`` seconds, at the largest extra share of time. Boundaries add up. Where
    waits are allowed the earlier label stands ``d`` seconds longer before the next boundary.
    """
    crossed = min(buckets - 1, int(budget.seconds // budget.bucket_seconds)) if budget.bucket_seconds else 0
    jump, rate = [0.0] * buckets, [0.0] * buckets
    if crossed:
        k = F.explode(F.sequence(F.lit(1), F.lit(crossed))).alias("k")
        shade = lambda b: shade_at((b + 0.5) * budget.bucket_seconds, F.col("series"), F.col("shade"), budget.bucket_seconds)
        extra = edges.select("seconds", "shade", "series", k).select("k", "seconds", (shade(F.col("k") - 1) - shade(F.col("k"))).alias("shade"))
        for r in extra.where("shade < 0").groupBy("k").agg(F.max(-F.col("shade") * F.col("seconds")).alias("jump"), F.max(-F.col("shade")).alias("rate")).collect():
            jump[r["k"]], rate[r["k"]] = r["jump"], r["rate"]
    # The small amount keeps labels that rounding alone would drop; in the last bucket equal ways on have equal prices.
    return [
        (sum(jump[b + 1 :]) + (_ROUNDING if b < buckets - 1 else 0.0), sum(rate[b + 1 :]) + (1.0 if budget.waits and b < buckets - 1 else 0.0)) for b in range(buckets)
    ]


def stays(edges: DataFrame, bucket_seconds: float | None, buckets: int) -> DataFrame:
    """``(node, stay)``: by bucket the sun of a second at the node, on the shadiest of the edges that leave it."""
    middle = lambda b: F.lit((b + 0.5) * (bucket_seconds or 1.0))
    shade = lambda b: F.max(shade_at(middle(b), F.col("series"), F.col("shade"), bucket_seconds or 1.0))
    return edges.groupBy(F.col("from_id").alias("node")).agg(F.array(*(1 - F.greatest(shade(b), F.lit(0.0)) for b in range(buckets))).alias("stay"))


def stay_sun(start: Column, seconds: Column, stay: Column, bucket_seconds: float | None, buckets: int) -> Column:
    """Sun of a stay, bucket by bucket; the last bucket has no end."""
    if not bucket_seconds:
        return seconds * stay[0]
    end, total = start + seconds, F.lit(0.0)
    for b in range(buckets):
        until = end if b == buckets - 1 else F.least(end, F.lit((b + 1) * bucket_seconds))
        total = total + F.greatest(until - F.greatest(start, F.lit(b * bucket_seconds)), F.lit(0.0)) * stay[b]
    return total


def _priced(edges: DataFrame, bucket_seconds: float | None) -> DataFrame:
    series = F.col("series") if bucket_seconds else F.lit(None).cast("array<double>")
    return edges.where("seconds > 0").select("from_id", "to_id", "seconds", "shade", series.alias("series"))


def search(edges: DataFrame, starts: DataFrame, budget: Budget, rounds: int = 10_000) -> Found:
    """All labels ``(seconds, sun)`` within the budget that no other makes needless, from every ``source``.

    A label is needless if one of its node and bucket is no later and less sunny by what it may pay more on the way on
    (``_slack``); of the same time, if no sunnier. Without caps nothing else is dropped, so every street that some walk
    within the budget takes is the next edge of a label (``reached``). With ``slot_labels`` those of a slot with the least
    seconds plus sun go on; the others are kept as walks, but go no further, and the source's outcome is ``approximate``.
    """
    plain = cut(_priced(edges, budget.bucket_seconds))
    out = plain.withColumnsRenamed({"from_id": "node", "to_id": "next", "seconds": "step"})
    buckets = bucket_count(plain, budget.bucket_seconds)
    slack = _slack(plain, budget, buckets)
    jump, rate = (F.element_at(F.array(*(F.lit(s[i]) for s in slack)), F.col("bucket") + 1) for i in (0, 1))
    shade_of = cut(stays(plain, budget.bucket_seconds, buckets)) if budget.waits and buckets > 1 else None
    slot = ["source", "node", "bucket"]
    same_time = Window.partitionBy(*slot, "seconds").orderBy("sun", "waited", "parent")
    earlier = Window.partitionBy(*slot).orderBy("seconds").rowsBetween(Window.unboundedPreceding, -1)
    fields = [*slot, "seconds", "sun", "label", "parent", "waited", "dropped"]

    def numbered(frame: DataFrame, turn: int) -> DataFrame:
        return frame.withColumn("label", F.lit(turn << _ROUND_BITS) + F.monotonically_increasing_id())

    zero, null = F.lit(0.0), F.lit(None).cast("long")
    first = starts.select("source", F.col("source").alias("node"), F.lit(0).alias("bucket"), zero.alias("seconds"), zero.alias("sun"), null.alias("parent"), F.lit(False).alias("waited"), F.lit(False).alias("dropped"))
    fresh = cut(numbered(first.distinct(), 0).select(fields))
    settled, stopped = fresh, None
    for turn in range(1, rounds + 1):
        going = fresh.where("not dropped")
        if budget.max_labels is not None:
            over = settled.groupBy("source").count().where(F.col("count") >= budget.max_labels).select("source")
            ended = going.join(over, "source", "left_semi").select("source").distinct()
            stopped = ended if stopped is None else stopped.union(ended)
            going = going.join(over, "source", "left_anti")
        arrival = F.col("seconds") + F.col("step")
        shade = shade_at(arrival, F.col("series"), F.col("shade"), budget.bucket_seconds or 1.0)
        moved = going.join(out, "node").select(
            "source", F.col("next").alias("node"), arrival.alias("seconds"), (F.col("sun") + F.col("step") * (1 - shade)).alias("sun"), F.col("label").alias("parent"), F.lit(False).alias("waited")
        )
        if shade_of is not None:
            until = (F.floor(F.col("seconds") / budget.bucket_seconds) + 1) * budget.bucket_seconds
            stood = going.where(F.col("bucket") < buckets - 1).join(shade_of, "node")
            sun = F.col("sun") + (until - F.col("seconds")) * F.element_at("stay", F.col("bucket") + 1)
            moved = moved.union(stood.select("source", "node", until.alias("seconds"), sun.alias("sun"), F.col("label").alias("parent"), F.lit(True).alias("waited")))
        moved = moved.where(F.col("seconds") <= budget.seconds)
        if budget.sun is not None:
            moved = moved.where(F.col("sun") <= budget.sun + _EXCESS)
        moved = moved.withColumn("sun", F.round("sun", 6)).withColumn("bucket", _bucket(F.col("seconds"), budget.bucket_seconds, buckets))
        # Among themselves by a window, against what is settled by a join on the slot.
        one = moved.withColumn("_n", F.row_number().over(same_time)).where("_n = 1")
        best = F.min(F.col("sun") - rate * F.col("seconds")).over(earlier)
        open_ = one.withColumn("_best", best).where(F.col("_best").isNull() | (F.col("sun") < F.col("_best") + jump + rate * F.col("seconds"))).drop("_n", "_best")
        old = settled.where("not dropped").select(*(F.col(c).alias(f"old_{c}") for c in [*slot, "seconds", "sun"]))
        gap = F.col("seconds") - F.col("old_seconds")
        covered = (gap == 0) & (F.col("old_sun") <= F.col("sun")) | (gap > 0) & (F.col("old_sun") + jump + gap * rate <= F.col("sun"))
        left = open_.join(old, [F.col(c) == F.col(f"old_{c}") for c in slot] + [covered], "left_anti")
        if budget.slot_labels is None:
            kept = left.withColumn("dropped", F.lit(False))
        else:
            olds = settled.where("not dropped").select(*slot, "seconds", "sun", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("boolean").alias("waited"))
            place = F.row_number().over(Window.partitionBy(*slot).orderBy(F.col("seconds") + F.col("sun"), "seconds", "parent"))
            both = left.select(olds.columns).union(olds).withColumn("dropped", place > budget.slot_labels)
            kept = both.where(F.col("waited").isNotNull())
        fresh, found = cut_counted(numbered(kept, turn).select(fields), F.lit(True))
        settled = settled.union(fresh)
        if turn % 16 == 0:
            settled = cut(settled)  # one table again
        if not found:
            break
    else:
        raise RuntimeError(f"the search did not end in {rounds} rounds")
    counts = settled.groupBy("source").agg(F.count("*").alias("labels"), F.sum(F.col("dropped").cast("long")).alias("dropped"))
    outcome = F.when(F.col("dropped") > 0, "approximate").otherwise("exact")
    if stopped is not None:
        counts = counts.join(stopped.distinct().withColumn("stopped", F.lit(True)), "source", "left")
        outcome = F.when(F.col("stopped"), "budget-exhausted").otherwise(outcome)
    return Found(settled.drop("bucket", "dropped"), counts.select("source", outcome.alias("outcome"), "labels", "dropped"))


def efficient(found: Found) -> DataFrame:
    """The labels that no other of their node beats in time and sun at once; of equal ones the one with the smallest id."""
    same = Window.partitionBy("source", "node", "seconds").orderBy("sun", "label")
    earlier = Window.partitionBy("source", "node").orderBy("seconds").rowsBetween(Window.unboundedPreceding, -1)
    one = found.labels.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return one.withColumn("_best", F.min("sun").over(earlier)).where("_best is null or sun < _best").drop("_n", "_best")


def reached(labels: DataFrame, edges: DataFrame, budget: Budget) -> DataFrame:
    """Edges that some label walks: ``source, from_id, to_id, share, sun, seconds, label``.

    ``share`` is 1 where the whole edge fits into the budget; of others it is the largest part of it that does, priced
    like the whole edge. ``sun`` and ``seconds`` are those at the end of the walk, of the label with the least sun (then time),
    or for a part of the label that gets farthest.
    """
    ends = _priced(edges, budget.bucket_seconds).withColumnsRenamed({"from_id": "node", "seconds": "step"})
    arrival = F.col("seconds") + F.col("step")
    cost = F.col("step") * (1 - shade_at(arrival, F.col("series"), F.col("shade"), budget.bucket_seconds or 1.0))
    fits = F.least(F.lit(1.0), (budget.seconds - F.col("seconds")) / F.col("step"))
    if budget.sun is not None:
        fits = F.least(fits, F.when(cost > 0, (budget.sun - F.col("sun")) / cost).otherwise(1.0))
    whole = (arrival <= budget.seconds) & (F.lit(True) if budget.sun is None else F.col("sun") + cost <= budget.sun + _EXCESS)
    walked = labels.join(ends, "node").withColumn("share", F.when(whole, 1.0).otherwise(F.least(fits, F.lit(1 - 1e-12)))).where("share > 0")
    end = F.struct((-F.col("share")).alias("short"), (F.col("sun") + F.col("share") * cost).alias("sun"), (F.col("seconds") + F.col("share") * F.col("step")).alias("seconds"), "label")
    best = walked.select("source", F.col("node").alias("from_id"), "to_id", end.alias("end")).groupBy("source", "from_id", "to_id").agg(F.min("end").alias("end"))
    return best.select("source", "from_id", "to_id", (-F.col("end.short")).alias("share"), "end.sun", "end.seconds", "end.label")


def undecided(walked: DataFrame, outcomes: DataFrame, edges: DataFrame, starts: DataFrame, budget: Budget) -> DataFrame:
    """``source, from_id, to_id``: edges that a search which was not exact neither walked whole nor can rule out: the least time and,
    apart from it, the least sun at the shadiest hours fit into the budget."""
    buckets = bucket_count(edges, budget.bucket_seconds)
    middle = [F.lit((b + 0.5) * (budget.bucket_seconds or 1.0)) for b in range(buckets)]
    priced = _priced(edges, budget.bucket_seconds)
    shades = [shade_at(m, F.col("series"), F.col("shade"), budget.bucket_seconds or 1.0) for m in middle]
    priced = cut(priced.select("from_id", "to_id", "seconds", (F.col("seconds") * (1 - (F.greatest(*shades) if buckets > 1 else shades[0]))).alias("least_sun")))
    unsure = outcomes.where("outcome <> 'exact'").select("source")
    open_ = starts.join(unsure, "source", "left_semi")
    bound = least(priced.select("from_id", "to_id", F.col("seconds").alias("cost")), open_, budget.seconds).select("source", F.col("node").alias("from_id"), F.col("cost").alias("t"))
    outer = priced.join(bound, "from_id").where(F.col("t") + F.col("seconds") <= budget.seconds)
    if budget.sun is not None:
        shady = least(priced.select("from_id", "to_id", F.col("least_sun").alias("cost")), open_, budget.sun).select("source", F.col("node").alias("from_id"), F.col("cost").alias("s"))
        outer = outer.join(shady, ["source", "from_id"]).where(F.col("s") + F.col("least_sun") <= budget.sun)
    return outer.select("source", "from_id", "to_id").distinct().join(walked.where("share = 1"), ["source", "from_id", "to_id"], "left_anti")


def walks(labels: DataFrame, wanted: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``source, label, place, node, seconds, sun, waited``: the walk to every ``wanted(source, label)``, the end at place 0 and
    the start at the highest place; ``waited`` marks a stand at the node before."""
    steps = labels.select("label", "node", "seconds", "sun", "parent", "waited")
    at = cut(wanted.select("source", F.col("label").alias("of"), "label").distinct())
    found: DataFrame | None = None
    for place in range(rounds):
        here, n = cut_counted(at.join(steps, "label").withColumn("place", F.lit(place)), F.lit(True))
        if not n:
            break
        found = here if found is None else found.union(here)
        at = here.where("parent is not null").select("source", "of", F.col("parent").alias("label"))
    if found is None:
        return at.join(steps, "label").select("source", F.col("of").alias("label"), F.lit(0).alias("place"), "node", "seconds", "sun", "waited")
    return found.select("source", F.col("of").alias("label"), "place", "node", "seconds", "sun", "waited")


def round_trips(edges: DataFrame, starts: DataFrame, budget: Budget, dwell_seconds: float, rounds: int = 10_000) -> DataFrame:
    """Edges of outings: out from the start, one stay of ``dwell_seconds`` at some node on its shadiest edge, and home, within both
    budgets. Returns ``source, from_id, to_id, sun, seconds``: the least sun of an outing over the edge, and when it is home (the
    soonest of equal ones).

    The states of a walker are node, time, and whether the stay is over. Outward the least sun to every state is found, and
    homeward the least sun from every state; an edge between two states counts if both and its own price fit into the
    budget. So a price of every bucket is the real one and the answer is exact. States that no walk home fits are left out
    beforehand, by the least time and the least sun (at the shadiest hours) from each node home. Times are held to a
    microsecond; the states of a node are the different times at which walks reach it.
    """
    width, sun_budget = budget.bucket_seconds, float("inf") if budget.sun is None else budget.sun
    plain = cut(_priced(edges, width))
    buckets = bucket_count(plain, width)
    shades = [shade_at(F.lit((b + 0.5) * (width or 1.0)), F.col("series"), F.col("shade"), width or 1.0) for b in range(buckets)]
    shadiest = F.col("seconds") * (1 - (F.greatest(*shades) if buckets > 1 else shades[0]))
    back = plain.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "seconds", shadiest.alias("least_sun"))
    fast = least(back.select("from_id", "to_id", F.col("seconds").alias("cost")), starts, budget.seconds - dwell_seconds)
    # No walk home within the time has more edges than of the shortest fit into it; shade without end would lead far beyond.
    shortest = plain.agg(F.min("seconds")).first()[0]
    hops = int((budget.seconds - dwell_seconds) / shortest + 1e-9) + 1 if shortest else 0
    shady = least(back.select("from_id", "to_id", F.col("least_sun").alias("cost")), starts, sun_budget, hops=max(hops, 0))
    home = cut(
        fast.select("source", "node", F.col("cost").alias("home_seconds"))
        .join(shady.select("source", "node", F.col("cost").alias("home_sun")), ["source", "node"])
        .join(stays(plain, width, buckets), "node", "left")
        .select("source", "node", "home_seconds", "home_sun", F.coalesce("stay", F.array(*[F.lit(1.0)] * buckets)).alias("stay"))
    )
    out = plain.withColumnsRenamed({"from_id": "node", "to_id": "next", "seconds": "step"})
    state = ["source", "node", "back", "seconds"]

    def arcs(states: DataFrame) -> DataFrame:
        """Every move from the states: where it leads and its price; ``kind`` walk, wait or stay."""
        arrival = F.round(F.col("seconds") + F.col("step"), 6)
        price = F.col("step") * (1 - shade_at(arrival, F.col("series"), F.col("shade"), width or 1.0))
        walk = states.join(out, "node").select(*state, F.col("next").alias("to_node"), F.col("back").alias("to_back"), arrival.alias("to_seconds"), price.alias("price"), F.lit("walk").alias("kind"))
        there = states.join(home, ["source", "node"])
        lasts = F.lit(float(dwell_seconds))
        stay = there.where("not back").select(
            *state, F.col("node").alias("to_node"), F.lit(True).alias("to_back"), F.round(F.col("seconds") + lasts, 6).alias("to_seconds"), stay_sun(F.col("seconds"), lasts, F.col("stay"), width, buckets).alias("price"), F.lit("stay").alias("kind")
        )
        both = walk.union(stay)
        if budget.waits and width and buckets > 1:
            until = (F.floor(F.col("seconds") / width) + 1) * width
            stood = there.where(_bucket(F.col("seconds"), width, buckets) < buckets - 1)
            wait = (until - F.col("seconds")) * F.element_at("stay", _bucket(F.col("seconds"), width, buckets) + 1)
            both = both.union(stood.select(*state, F.col("node").alias("to_node"), F.col("back").alias("to_back"), until.alias("to_seconds"), wait.alias("price"), F.lit("wait").alias("kind")))
        # Only moves after which some walk home fits.
        limit = home.select("source", F.col("node").alias("to_node"), "home_seconds", "home_sun")
        left = F.col("to_seconds") + F.col("home_seconds") + F.when(F.col("to_back"), 0.0).otherwise(F.lit(float(dwell_seconds)))
        return both.join(limit, ["source", "to_node"]).where(left <= budget.seconds)

    states = cut(starts.distinct().select("source", F.col("source").alias("node"), F.lit(False).alias("back"), F.lit(0.0).alias("seconds"), F.lit(0.0).alias("sun"), F.lit(True).alias("fresh")))
    for _ in range(rounds):
        sun = F.col("sun") + F.col("price")
        fresh = states.where("fresh")
        moved = arcs(fresh.drop("sun", "fresh")).join(fresh.select(*state, "sun"), state).where(sun + F.col("home_sun") <= sun_budget)
        moved = moved.select("source", F.col("to_node").alias("node"), F.col("to_back").alias("back"), F.col("to_seconds").alias("seconds"), F.struct(sun.alias("sun"), F.lit(True).alias("fresh")).alias("best"))
        settled = states.select(*state, F.struct("sun", F.lit(False).alias("fresh")).alias("best"))
        merged = settled.union(moved).groupBy(state).agg(F.min("best").alias("best")).select(*state, "best.sun", "best.fresh")
        states, found = cut_counted(merged, F.col("fresh"))
        if not found:
            break
    else:
        raise RuntimeError(f"the search did not end in {rounds} rounds")
    states = states.drop("fresh")
    ahead = states.select("source", F.col("node").alias("to_node"), F.col("back").alias("to_back"), F.col("seconds").alias("to_seconds"))
    links = cut(arcs(states.drop("sun")).drop("home_seconds", "home_sun").join(ahead, ["source", "to_node", "to_back", "to_seconds"]))
    # Homeward: the least sun still to come, and when the walker is home.
    done = states.where(F.col("back") & (F.col("node") == F.col("source"))).select(*state, F.struct(F.lit(0.0).alias("sun"), F.lit(False).alias("fresh"), F.col("seconds").alias("home")).alias("best"))
    rest = cut(done.withColumn("fresh", F.lit(True)))
    for _ in range(rounds):
        to = rest.where("fresh").select("source", F.col("node").alias("to_node"), F.col("back").alias("to_back"), F.col("seconds").alias("to_seconds"), "best")
        sun = F.col("price") + F.col("best.sun")
        moved = links.join(to, ["source", "to_node", "to_back", "to_seconds"]).select(*state, F.struct(sun.alias("sun"), F.lit(True).alias("fresh"), F.col("best.home").alias("home")).alias("best"))
        settled = rest.select(*state, F.col("best").withField("fresh", F.lit(False)).alias("best"))
        merged = settled.union(moved).groupBy(state).agg(F.min("best").alias("best")).withColumn("fresh", F.col("best.fresh"))
        rest, found = cut_counted(merged, F.col("fresh"))
        if not found:
            break
    else:
        raise RuntimeError(f"the search did not end in {rounds} rounds")
    to = rest.select("source", F.col("node").alias("to_node"), F.col("back").alias("to_back"), F.col("seconds").alias("to_seconds"), F.col("best.sun").alias("to_come"), F.col("best.home").alias("home"))
    over = links.where("kind = 'walk'").join(states, state).join(to, ["source", "to_node", "to_back", "to_seconds"])
    over = over.select("source", F.col("node").alias("from_id"), F.col("to_node").alias("to_id"), (F.col("sun") + F.col("price") + F.col("to_come")).alias("total"), "home")
    best = over.where(F.col("total") <= sun_budget).groupBy("source", "from_id", "to_id").agg(F.min(F.struct("total", "home")).alias("best"))
    return best.select("source", "from_id", "to_id", F.col("best.total").alias("sun"), F.col("best.home").alias("seconds"))


def merge_regions(results: DataFrame, seconds: float, sun: float) -> DataFrame:
    """``source, from_id, to_id, status``: what is proven under the budgets ``seconds`` and ``sun``, given ``results(seconds_budget, sun_budget,
    source, from_id, to_id, status)`` of several searches. A proof under smaller budgets stays one under larger ones;
    undecided edges are those of the given budgets' own result without a proof."""
    within = results.where((F.col("status") == "reachable") & (F.col("seconds_budget") <= seconds) & (F.col("sun_budget") <= sun))
    own = results.where((F.col("status") == "undecided") & (F.col("seconds_budget") == seconds) & (F.col("sun_budget") == sun))
    key = ["source", "from_id", "to_id"]
    both = within.select(*key, "status").union(own.select(*key, "status"))
    return both.groupBy(key).agg(F.min("status").alias("status"))  # "reachable" comes before "undecided"
