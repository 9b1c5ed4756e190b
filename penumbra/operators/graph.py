"""Street graphs: build, components, reach, and the plain forms of the searches, as joins in rounds.

Nothing gathers the graph in one task: each round joins what was found last with the edges that leave its
nodes, and goes on until nothing is new. Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.operators import search
from penumbra.session import cut


def build_graph(ways: DataFrame, nodes: DataFrame, least_metres: float | None = None) -> DataFrame:
    """Directed edges, both ways, between neighbouring nodes of ``ways(way_id, refs)``.

    ``nodes`` has ``id, lon, lat``. Steps with a missing node or no length are left out, and so are
    closed ways of an area (``is_area``). With ``least_metres`` steps of at least that length stay, with 0 also those
    between different nodes of one place.
    """
    kept = ways.where(~(F.col("is_area") & (F.element_at("refs", 1) == F.element_at("refs", -1))))
    refs = kept.select("way_id", F.posexplode("refs").alias("seq", "from_id"))
    w = Window.partitionBy("way_id").orderBy("seq")
    steps = refs.withColumn("to_id", F.lead("from_id").over(w)).where("to_id is not null and from_id <> to_id")
    start = nodes.select(F.col("id").alias("from_id"), F.col("lon").alias("from_lon"), F.col("lat").alias("from_lat"))
    end = nodes.select(F.col("id").alias("to_id"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    one = steps.join(start, "from_id").join(end, "to_id")
    one = one.withColumn("metres", geo.haversine(*map(F.col, ("from_lon", "from_lat", "to_lon", "to_lat")))).where(F.col("metres") > 0 if least_metres is None else F.col("metres") >= least_metres)
    back = one.select(
        "way_id", "seq", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.col("to_lon").alias("from_lon"),
        F.col("to_lat").alias("from_lat"), F.col("from_lon").alias("to_lon"), F.col("from_lat").alias("to_lat"), "metres",
    )
    return one.select(back.columns).union(back)


def intersections(ways: DataFrame) -> DataFrame:
    """Nodes of at least two different ways."""
    refs = ways.select("way_id", F.explode("refs").alias("id")).distinct()
    return refs.groupBy("id").agg(F.count("*").alias("ways")).where("ways >= 2")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, component)``: the smallest node that undirected ``edges(from_id, to_id)`` reach.

    Each round takes the smallest label among the neighbours and then the label of that label.
    """
    both = edges.select("from_id", "to_id").union(edges.select("to_id", "from_id")).where("from_id <> to_id").distinct()
    both = cut(both.toDF("node", "other"))
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other")
        lowest = around.groupBy("node").agg(F.min("c").alias("c"))
        lower = labels.join(lowest, "node").select("node", "component", F.least("component", "c").alias("next"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("after"))
        moved = cut(lower.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("after", "next")).alias("next")))
        changed = moved.where("component <> next").limit(1).count()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reach(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """``(source, node, hops)``: the fewest edges from each start, up to ``steps``."""
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).distinct()
    seen = cut(starts.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")))
    front = seen
    for hop in range(1, steps + 1):
        found = front.join(out, "node").select("source", F.col("next").alias("node")).distinct().join(seen, ["source", "node"], "left_anti")
        front = cut(found.withColumn("hops", F.lit(hop)))
        seen = seen.union(front)
    return seen


def label_search(
    edges: DataFrame, starts: DataFrame, time_budget: float, sun_budget: float | None = None, bucket_seconds: float | None = None, rounds: int = 10_000
) -> DataFrame:
    """Labels ``source, node, seconds, sun, label, parent`` within the budgets: without buckets those that no other of their node
    beats in time and sun, with ``bucket_seconds`` all that some way on may need (``search.search``)."""
    found = search.search(edges, starts, search.Budget(time_budget, sun_budget, bucket_seconds), rounds)
    return (found.labels if bucket_seconds else search.efficient(found)).drop("waited")


def shortest(edges: DataFrame, starts: DataFrame, budget: float) -> DataFrame:
    """Least seconds from each start to each node within the budget, with the node before."""
    found = search.least(edges.select("from_id", "to_id", F.col("seconds").alias("cost")), starts, budget)
    return found.withColumnRenamed("cost", "seconds")


def discounted(metres: Column, strength: Column, factor: Column, solar: Column, crossing: Column) -> Column:
    """Cost of an edge in metres after the shade discount (at most 70 percent), plus the crossing."""
    return metres * (1 - strength * factor * 0.7 * solar) + crossing


def reachable_edges(
    labels: DataFrame, edges: DataFrame, time_budget: float, sun_budget: float, bucket_seconds: float | None = None
) -> DataFrame:
    """Edges that some label can still walk whole within both budgets, by source; with ``bucket_seconds`` the ``series`` prices
    an edge at the time of its end, as in the search."""
    walked = search.reached(labels, edges, search.Budget(time_budget, sun_budget, bucket_seconds))
    return walked.where("share = 1").select("source", "from_id", "to_id")


def chains(edges: DataFrame) -> DataFrame:
    """Block faces: undirected edges ``edge_id, from_id, to_id`` that meet at nodes of exactly two edges form one chain,
    named by its smallest edge."""
    ends = edges.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("node"))
    middle = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("n = 2 and a <> b")
    linked = components(middle.select(F.col("a").alias("from_id"), F.col("b").alias("to_id")))
    return edges.select("edge_id").join(linked.withColumnRenamed("node", "edge_id"), "edge_id", "left").select(
        "edge_id", F.coalesce("component", "edge_id").alias("chain")
    )


def detour_gate(routes: DataFrame, keys: list[str], metres: str, factor: float = 2.0, extra: float = 250.0) -> DataFrame:
    """Routes within the shortest one's length times ``factor`` plus ``extra`` metres."""
    best = routes.groupBy(*keys).agg(F.min(metres).alias("_best"))
    return routes.join(best, keys).where(F.col(metres) <= F.col("_best") * factor + extra).drop("_best")
