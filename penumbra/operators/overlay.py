"""Least distances between pairs of places however far apart, over cells of a street network inside larger cells.

A search in rounds settles every node within its limit, far more than a pair needs. Here the network is cut into square cells, four of
which make one of the next level. Inside a cell all distances between the nodes on its border are found once, from those of its parts. A place
carries its distances to the border of its cell up from level to level; on the way it notes the distance to one end of every edge that
joins two parts of a cell. Every walk either stays in one smallest cell or uses such an edge, so the least sum over the ends that two places have
both noted is their distance. Costs are whole micrometres, so sums don't depend on their order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.session import cut, cut_counted

#: Farther than any distance; twice as much still fits 64 bits.
_FAR = 1 << 60
#: Places of a cell that one task takes at a time.
_BLOCK = 4096
_MICRO = 1e6

_CELL = ["cx", "cy"]
_STEP = "cx long, cy long, a long, b long, w long, ta int, tb int, reach long, hub boolean"
_WALK = "cx long, cy long, a long, b long, w long, tb int, reach long, hub boolean"


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _out(table: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
    n = len(columns["a"])
    cell = {c: np.full(n, table.column(c)[0].as_py() if table.num_rows else 0, dtype=np.int64) for c in _CELL}
    return pa.table(cell | columns)


def _closed(level: int, most: int):
    """All distances inside one cell: from every node to the border and to the ends of edges between its parts, on the lowest level from the
    border to itself and from places to what they reach."""

    def run(table: pa.Table) -> pa.Table:
        a, b, w, ta, tb, reach, edge = _columns(table, "a", "b", "w", "ta", "tb", "reach", "hub")
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        ia, ib = at[: len(a)], at[len(a) :]
        d = np.full((len(nodes), len(nodes)), _FAR, dtype=np.int64)
        np.minimum.at(d, (ia, ib), w)
        np.fill_diagonal(d, 0)
        for k in range(len(nodes)):
            np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
        top, far, hub = np.zeros(len(nodes), dtype=np.int32), np.full(len(nodes), -1, dtype=np.int64), np.zeros(len(nodes), dtype=bool)
        top[ia], top[ib] = ta, tb
        np.maximum.at(far, ia, reach)
        hub[np.minimum(ia, ib)[edge]] = True  # nodes ascend, so the smaller place is the smaller id
        border = top > level
        if level:
            kept = (d <= most) & (hub | border)[None, :]
        else:
            kept = ((d <= most) & border[:, None] & border[None, :]) | (d <= far[:, None])
        x, y = np.nonzero(kept)
        return _out(table, {"a": nodes[x], "b": nodes[y], "w": d[x, y], "ta": top[x], "tb": top[y], "reach": far[x], "hub": hub[y]})

    return run


def _carried(here: pa.Table, inside: pa.Table) -> pa.Table:
    """Distances of a block of places to their cell's border and hubs, from those to the borders of its parts."""
    a, c, w, reach = _columns(here, "a", "b", "w", "reach")
    c1, b, w1, tb, hub = _columns(inside, "a", "b", "w", "tb", "hub")
    places, ia = np.unique(a, return_inverse=True)
    middle, ic = np.unique(np.concatenate([c, c1]), return_inverse=True)
    ends, first, ib = np.unique(b, return_index=True, return_inverse=True)
    to, on = np.full((len(places), len(middle)), _FAR, dtype=np.int64), np.full((len(middle), len(ends)), _FAR, dtype=np.int64)
    to[ia, ic[: len(c)]] = w
    on[ic[len(c) :], ib] = w1
    far = np.zeros(len(places), dtype=np.int64)
    far[ia] = reach
    found = np.full((len(places), len(ends)), _FAR, dtype=np.int64)
    for k in range(len(middle)):
        met = np.nonzero(to[:, k] < _FAR)[0]
        if len(met):
            found[met] = np.minimum(found[met], to[met, k, None] + on[None, k, :])
    x, y = np.nonzero(found <= far[:, None])
    return _out(here, {"a": places[x], "b": ends[y], "w": found[x, y], "tb": tb[first][y], "reach": far[x], "hub": hub[first][y]})


def _up(column: str, by: int = 1) -> Column:
    return F.shiftright(column, by).alias(column)


def distances(segments: DataFrame, begun: DataFrame, ended: DataFrame, pairs: DataFrame, cell: float) -> DataFrame:
    """``(source, target, cost)``: the least metres between the two places of each of ``pairs(source, target, limit)``, up to the limit.

    ``segments`` has ``from_id, to_id, cost`` (walked both ways) and its ends' coordinates; ``begun(source, node, cost)`` and ``ended(target, node, cost)``
    tell what it takes to step onto the network. ``cell`` is the width of the smallest cells in degrees; one should hold a hundred nodes or
    two, since a task takes one with all its nodes, of larger ones only the nodes on their parts' borders. A place rises only while its
    limit reaches its cell's border, so near pairs end on the lowest levels.
    """
    at = lambda c: (F.floor(F.col(c) / cell) + (1 << 30)).cast("long")
    one = segments.select(
        F.col("from_id").cast("long").alias("a"), F.col("to_id").cast("long").alias("b"), F.round(F.col("cost") * _MICRO).cast("long").alias("w"),
        at("from_lon").alias("cx"), at("from_lat").alias("cy"), at("to_lon").alias("dx"), at("to_lat").alias("dy"),
    )
    both = one.union(one.select("b", "a", "w", "dx", "dy", "cx", "cy"))
    # The level of the smallest cell that holds both ends.
    differ = F.greatest(F.col("cx").bitwiseXOR(F.col("dx")), F.col("cy").bitwiseXOR(F.col("dy")))
    both = both.select("a", "b", "w", *_CELL, F.when(differ == 0, 0).otherwise(F.length(F.bin(differ))).alias("level"))
    # A node lies on the border of its cells below this level.
    tops = cut(both.groupBy("a", *_CELL).agg(F.max("level").alias("ta")))
    both = cut(both.join(tops.select("a", "ta"), "a").join(tops.select(F.col("a").alias("b"), F.col("ta").alias("tb")), "b"))
    none = F.lit(-1).cast("long").alias("reach")

    limits = F.max(F.col("limit") * _MICRO + 1).cast("long").alias("reach")
    ways = [("source", begun), ("target", ended)]
    reach = reduce(DataFrame.union, (steps.join(pairs.groupBy(key).agg(limits), key).select(F.col("node").cast("long").alias("a"), (F.col("reach") - F.col("cost") * _MICRO).cast("long").alias("reach")) for key, steps in ways))
    reach = cut(reach.groupBy("a").agg(F.max("reach").alias("reach")).where("reach >= 0"))
    most = reach.agg(F.max("reach")).first()[0] or 0

    own = tops.join(reach, "a", "left").select(*_CELL, "a", F.col("a").alias("b"), F.lit(0).cast("long").alias("w"), "ta", F.col("ta").alias("tb"), F.coalesce("reach", none).alias("reach"), F.lit(False).alias("hub"))
    inner = both.where("level = 0").select(*_CELL, "a", "b", "w", "ta", "tb", none, F.lit(False).alias("hub"))
    inside = cut(own.union(inner).groupBy(*_CELL).applyInArrow(_closed(0, most), _STEP))
    noted = ["a", F.col("b").alias("hub"), "w"]
    near = inside.where("w <= reach").select(*noted)
    high = None
    carry = inside.where("w <= reach and tb > 0").select(*map(_up, _CELL), "a", "b", "w", "reach")
    links = inside.where("ta > 0 and tb > 0")
    level, left = 1, carry.limit(1).count()
    while left:
        joining = both.where(F.col("level") == level).select(*(_up(c, level) for c in _CELL), "a", "b", "w", "ta", "tb", none, F.lit(True).alias("hub"))
        rows = links.select(*map(_up, _CELL), "a", "b", "w", "ta", "tb", none, F.lit(False).alias("hub")).union(joining)
        inside = cut(rows.groupBy(*_CELL).applyInArrow(_closed(level, most), _STEP))
        blocks = carry.groupBy(*_CELL).agg((F.floor(F.count_distinct("a") / _BLOCK) + 1).cast("int").alias("blocks"))
        dealt = carry.join(blocks, _CELL).withColumn("block", F.pmod(F.hash("a"), "blocks")).select(*_CELL, "block", "a", "b", "w", "reach")
        shared = inside.join(blocks, _CELL).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*_CELL, "block", "a", "b", "w", "tb", "hub")
        key = [*_CELL, "block"]
        walked = dealt.groupBy(*key).cogroup(shared.groupBy(*key)).applyInArrow(_carried, _WALK)
        walked, left = cut_counted(walked, F.col("tb") > level)
        met = walked.where("hub").select(*noted)
        high = met if high is None else high.union(met)
        carry = walked.where(F.col("tb") > level).select(*map(_up, _CELL), "a", "b", "w", "reach")
        links = inside.where((F.col("ta") > level) & (F.col("tb") > level))
        level += 1

    itself = reach.select("a", F.col("a").alias("hub"), F.lit(0).cast("long").alias("w"))
    of_source, of_target = (near, itself) if high is None else (near.union(high), itself.union(high))
    to_hub = lambda key, steps, noted: steps.select(key, F.col("node").cast("long").alias("a"), (F.col("cost") * _MICRO).alias("_c")).join(noted, "a").groupBy(key, "hub").agg(F.min(F.col("_c") + F.col("w")).alias(f"_{key}"))
    # What it takes to step on is rounded at the start only, as the edges are.
    here, there = to_hub("source", begun.withColumn("cost", F.round("cost", 6)), of_source), to_hub("target", ended, of_target)
    sums = ((F.col("_source") + F.col("_target")) / _MICRO).alias("cost")
    asked = pairs.join(here, "source").where(F.col("_source") <= F.col("limit") * _MICRO + 1)
    return asked.join(there, ["target", "hub"]).select("source", "target", "limit", sums).where("cost <= limit").groupBy("source", "target").agg(F.min("cost").alias("cost"))
