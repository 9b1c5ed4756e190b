"""Tiles that polygons and boxes cover, and streets dealt to tiles with the nodes that lie outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions import geo

#: The latitude at which the square map ends; a fixed value.
EDGE_LAT = 85.05112878


def _tile_place(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """A point's place in tiles of the zoom, not rounded."""
    n = float(1 << zoom)
    r = F.radians(F.greatest(F.lit(-EDGE_LAT), F.least(F.lit(EDGE_LAT), lat)))
    return (lon + 180.0) / 360.0 * n, (F.lit(1.0) - F.asinh(F.tan(r)) / F.lit(3.141592653589793)) / 2.0 * n


def polygon_tiles(polygons: DataFrame, zoom: int, id_col: str = "polygon_id") -> DataFrame:
    """``(id_col), x, y``: the tiles of polygons with ``rings`` (arrays of ``x, y`` degrees, closed; later rings are holes), each once.

    Boundary tiles are walked along every side, in as many steps as the side spans tiles; inside, every row of tiles is filled
    between the crossings of its middle line with the sides, so holes stay out but for their own boundary.
    """
    limit = (1 << zoom) - 1
    sides = polygons.select(id_col, F.explode("rings").alias("ring")).where("size(ring) >= 2")
    pairs = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides = sides.select(id_col, F.explode(pairs).alias("s"))
    places = [*_tile_place(F.col("s.a.x"), F.col("s.a.y"), zoom), *_tile_place(F.col("s.b.x"), F.col("s.b.y"), zoom)]
    sides = sides.select(id_col, F.inline(F.array(F.struct(*(v.alias(n) for v, n in zip(places, ("ax", "ay", "bx", "by"), strict=True))))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)))).cast("int")
    walked = sides.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    edge = walked.select(id_col, F.floor(F.col("ax") + dx * F.col("i") / F.col("n")).alias("x"), F.floor(F.col("ay") + dy * F.col("i") / F.col("n")).alias("y"))
    edge = edge.where(F.col("x").between(0, limit) & F.col("y").between(0, limit))
    low, high = F.greatest(F.ceil(F.least("ay", "by") - 0.5), F.lit(0)), F.least(F.floor(F.greatest("ay", "by") - 0.5), F.lit(limit))
    rows = sides.where(high >= low).withColumn("y", F.explode(F.sequence(low, high)))
    line = F.col("y") + 0.5
    rows = rows.where((F.col("ay") > line) != (F.col("by") > line)).select(id_col, "y", (F.col("ax") + (line - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("at"))
    # A row's crossings in order, two and two, are where it enters and leaves.
    order = Window.partitionBy(id_col, "y").orderBy("at")
    spans = rows.withColumn("pair", F.floor((F.row_number().over(order) - 1) / 2)).groupBy(id_col, "y", "pair").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("k"))
    box = sides.groupBy(id_col).agg(F.floor(F.min(F.least("ax", "bx"))).alias("west"), F.floor(F.max(F.greatest("ax", "bx"))).alias("east"))
    spans = spans.where("k = 2").join(box, id_col)
    first, last = F.greatest(F.floor("a"), F.col("west"), F.lit(0)), F.least(F.floor("b"), F.col("east"), F.lit(limit))
    inside = spans.where(last >= first).select(id_col, F.explode(F.sequence(first, last)).alias("x"), "y")
    return edge.union(inside.select(id_col, "x", "y")).distinct()


def box_tiles(boxes: DataFrame, zoom: int, id_col: str = "box_id") -> DataFrame:
    """``(id_col), x, y, quadkey``: every tile that a box ``west, south, east, north`` meets, rows from the north; also the cells of a grid."""
    x = F.sequence(geo.tile_x(F.col("west"), zoom), geo.tile_x(F.col("east"), zoom))
    y = F.sequence(geo.tile_y(F.col("north"), zoom), geo.tile_y(F.col("south"), zoom))
    spread = boxes.select(id_col, x.alias("xs"), F.explode(y).alias("y")).select(id_col, F.explode("xs").alias("x"), "y")
    return spread.withColumn("quadkey", geo.quadkey(F.col("x"), F.col("y"), zoom))


def street_shards(edges: DataFrame, nodes: DataFrame, zoom: int, bounds: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Streets by the tile of their middle, and the nodes that each tile ships.

    Edges: ``edge_id, tile_x, tile_y, seam`` (an end lies in another tile). Nodes: ``tile_x, tile_y, node_id, ghost`` (it lies outside the tile but an edge
    of the tile ends there). Edges with an end that ``nodes(node_id, lon, lat)`` lacks, or whose middle's tile isn't one of those that ``bounds`` (south,
    west, north, east) meets, are left out.
    """
    end = lambda name: nodes.select(F.col("node_id").alias(f"{name}_id"), F.col("lon").alias(f"{name}_lon"), F.col("lat").alias(f"{name}_lat"))
    both = edges.select("edge_id", "from_id", "to_id").join(end("from"), "from_id").join(end("to"), "to_id")
    x = geo.tile_x((F.col("from_lon") + F.col("to_lon")) / 2, zoom)
    y = geo.tile_y((F.col("from_lat") + F.col("to_lat")) / 2, zoom)
    both = both.withColumn("tile_x", x).withColumn("tile_y", y)
    if bounds:
        south, west, north, east = map(F.lit, bounds)
        both = both.where(F.col("tile_x").between(geo.tile_x(west, zoom), geo.tile_x(east, zoom)) & F.col("tile_y").between(geo.tile_y(north, zoom), geo.tile_y(south, zoom)))
    out = lambda name: (geo.tile_x(F.col(f"{name}_lon"), zoom) != F.col("tile_x")) | (geo.tile_y(F.col(f"{name}_lat"), zoom) != F.col("tile_y"))
    owned = both.select("edge_id", "tile_x", "tile_y", (out("from") | out("to")).alias("seam"))
    ships = F.explode(F.array(F.struct(F.col("from_id").alias("node_id"), out("from").alias("ghost")), F.struct(F.col("to_id").alias("node_id"), out("to").alias("ghost")))).alias("n")
    return owned, both.select("tile_x", "tile_y", ships).select("tile_x", "tile_y", "n.node_id", "n.ghost").distinct()


def coarsest(levels: DataFrame, keys: list[str], resolution: str, target: str) -> DataFrame:
    """Of every key's levels the coarsest whose resolution is no coarser than the target, else the finest; ties to the larger resolution's
    smallest ``level``."""
    fits = F.col(resolution) <= F.col(target)
    rank = F.struct(F.when(fits, 0).otherwise(1).alias("a"), F.when(fits, -F.col(resolution)).otherwise(F.col(resolution)).alias("b"), F.col("level").alias("c"))
    best = levels.groupBy(*keys).agg(F.min(rank).alias("best"))
    return best.select(*keys, F.col("best.c").alias("level"), F.abs("best.b").alias(resolution))
