"""Shade of points and street edges from building prisms at an instant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import geo


def sample_point(i: Column, n: Column, offset: Column) -> tuple[Column, Column]:
    """Place of sample ``i`` of ``n + 1`` along the edge ``ax, ay, bx, by``, ``offset`` metres to its left."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    return F.col("ax") + dx * i / n - dy / length * offset, F.col("ay") + dy * i / n + dx / length * offset


def sample_count(spacing: float = 25.0) -> tuple[Column, Column]:
    """Length of the edge ``ax, ay, bx, by`` and the number of its steps, ``max(3, ceil(d / spacing))``."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    return length, F.greatest(F.lit(3), F.ceil(length / spacing)).cast("int")


def edge_samples(edges: DataFrame, spacing: float = 25.0, offset: float = 4.0) -> DataFrame:
    """Sample points on both sidewalks of plane edges ``edge_id, ax, ay, bx, by``: ``max(3, ceil(d / spacing)) + 1`` a side."""
    length, n = sample_count(spacing)
    sides = F.array(F.struct(F.lit("left").alias("side"), F.lit(offset).alias("o")), F.struct(F.lit("right").alias("side"), F.lit(-offset).alias("o")))
    x, y = sample_point(F.col("_i"), F.col("_n"), F.col("_s.o"))
    return (
        edges.where(length > 0)
        .withColumn("_n", n)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        .withColumn("_s", F.explode(sides))
        .select("edge_id", F.col("_s.side").alias("side"), F.col("_i").alias("sample"), x.alias("x"), y.alias("y"))
    )


def _meets(px: Column, py: Column, qx: Column, qy: Column, ring: Column) -> Column:
    """Whether the segment p-q crosses an edge of the ring."""

    def side(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        d1, d2 = side(a["x"], a["y"], b["x"], b["y"], px, py), side(a["x"], a["y"], b["x"], b["y"], qx, qy)
        d3, d4 = side(px, py, qx, qy, a["x"], a["y"]), side(px, py, qx, qy, b["x"], b["y"])
        return (d1 * d2 < 0) & (d3 * d4 < 0)

    return F.exists(pairs, crosses)


def prism_shade(points: DataFrame, prisms: DataFrame, azimuth: float, altitude: float, point_keys: list[str], cell: float = 100.0) -> DataFrame:
    """Opacity of the shade on each point ``x, y`` (metres east and north) from ``prisms(ring, height, opacity)``.

    A point is shaded by a prism if the way towards the sun, as long as the prism's shadow, crosses
    its footprint, unless the point lies inside it. The footprint's box is stretched by the shadow,
    hashed to cells, and joined by equality. A sun at or below the horizon shades everything. Points of one
    place are one point, and of prisms of one outline and opacity the tallest throws the shadow of all.
    """

    if altitude <= 0:
        return points.select(*point_keys, F.lit(1.0).alias("shade"))
    reach = F.col("height") / math.tan(math.radians(altitude))
    ux, uy = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
    xs, ys = F.col("ring.x"), F.col("ring.y")
    along = F.transform("ring", lambda p: p["x"] * ux + p["y"] * uy)
    beside = F.transform("ring", lambda p: p["x"] * uy - p["y"] * ux)
    merged = prisms.groupBy("ring", F.coalesce("opacity", F.lit(1.0)).alias("opacity")).agg(F.max("height").alias("height"))
    boxed = merged.select(
        "ring",
        (F.array_min(along) - 1e-6).alias("ahead0"),
        (F.array_max(along) + 1e-6).alias("ahead1"),
        (F.array_min(beside) - 1e-6).alias("aside0"),
        (F.array_max(beside) + 1e-6).alias("aside1"),
        "opacity",
        reach.alias("reach"),
        *[
            f(g(v), g(v) - reach * u).alias(name)
            for v, u, names in ((xs, ux, ("x0", "x1")), (ys, uy, ("y0", "y1")))
            for f, g, name in ((F.least, F.array_min, names[0]), (F.greatest, F.array_max, names[1]))
        ],
    )
    boxed = boxed.withColumn("_cx", F.explode(F.sequence(geo.grid_cell(F.col("x0"), cell), geo.grid_cell(F.col("x1"), cell))))
    boxed = boxed.withColumn("_cy", F.explode(F.sequence(geo.grid_cell(F.col("y0"), cell), geo.grid_cell(F.col("y1"), cell))))
    places = points.select("x", "y").distinct()
    probes = places.withColumn("_cx", geo.grid_cell(F.col("x"), cell)).withColumn("_cy", geo.grid_cell(F.col("y"), cell))
    px, py, ring = F.col("x"), F.col("y"), F.col("ring")
    ahead, aside = px * ux + py * uy, px * uy - py * ux
    # The strip's own box first: cheap, and false for most pairs of a cell.
    near = (aside >= F.col("aside0")) & (aside <= F.col("aside1")) & (ahead <= F.col("ahead1")) & (ahead + F.col("reach") >= F.col("ahead0"))
    hit = ~geo.point_in_ring(px, py, ring) & _meets(px, py, px + F.col("reach") * ux, py + F.col("reach") * uy, ring)
    shaded = probes.join(boxed, ["_cx", "_cy"]).where(near & hit).groupBy("x", "y").agg(F.max("opacity").alias("shade"))
    return points.select(*point_keys, "x", "y").join(shaded, ["x", "y"], "left").select(*point_keys, F.coalesce("shade", F.lit(0.0)).alias("shade"))


def edge_shade(edges: DataFrame, prisms: DataFrame, azimuth: float, altitude: float) -> DataFrame:
    """Mean shade of each side of each edge."""
    samples = edge_samples(edges)
    shaded = prism_shade(samples, prisms, azimuth, altitude, ["edge_id", "side", "sample"])
    return shaded.groupBy("edge_id", "side").agg(F.avg("shade").alias("shade"))


def window_means(table: DataFrame, slots: list[int]) -> DataFrame:
    """Mean shade fraction of each segment side over some slots of the long shade table ``cell, lo, hi, side, slot, shade_byte``."""
    return (
        table.where(F.col("slot").isin(slots))
        .groupBy("cell", "lo", "hi", "side")
        .agg((F.avg("shade_byte") / 255.0).alias("shade"), F.count("*").alias("slots"))
    )


def annual_profiles(table: DataFrame) -> DataFrame:
    """The slots of every segment side in order, as one array; a side has at most 768."""
    packed = F.sort_array(F.collect_list(F.struct("slot", "shade_byte")))
    return table.groupBy("cell", "lo", "hi", "side").agg(F.transform(packed, lambda s: s["shade_byte"]).alias("profile"))
