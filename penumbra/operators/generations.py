"""Published generations of shards: their manifest, and a verifier that names every fault of files, bounds and links between shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.session import cut

_BOUNDS = ["west", "south", "east", "north"]
_NODE = "struct<kind:string,id:bigint,lon:double,lat:double,from:bigint,to:bigint>"


def shard_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``shard, line``: a JSON line for every ``nodes(shard, id, lon, lat)`` and ``edges(shard, from, to)``, nodes in order of their ids first."""
    one = nodes.select("shard", F.lit(0).alias("_part"), F.col("id").alias("_key"), F.to_json(F.struct(F.lit("node").alias("kind"), "id", "lon", "lat")).alias("line"))
    two = edges.select("shard", F.lit(1).alias("_part"), F.col("from").alias("_key"), F.to_json(F.struct(F.lit("edge").alias("kind"), "from", "to")).alias("line"))
    return one.union(two)


def write_shards(lines: DataFrame, folder: str) -> None:
    """One text file a shard, below ``folder/shard=...``; rows of a shard meet in one task, sorted."""
    lines.repartition("shard").sortWithinPartitions("shard", "_part", "_key", "line").select("shard", "line").write.partitionBy("shard").text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, content`` of every file below the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "shard=([^/]+)/", 1).alias("shard"), "content")


def _parsed(files: DataFrame) -> DataFrame:
    """The lines of the files, with their places."""
    spread = files.select("shard", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("place", "line")).where("line <> ''")
    return spread.select("shard", "place", F.from_json("line", _NODE).alias("row"))


def manifest(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """``shard, bytes, sha256, nodes, edges`` and bounds of every file; ``parsed`` are its lines where they are known."""
    rows = (_parsed(files) if parsed is None else parsed).groupBy("shard").agg(
        F.count_if(F.col("row.kind") == "node").alias("nodes"), F.count_if(F.col("row.kind") == "edge").alias("edges"),
        F.min("row.lon").alias("west"), F.min("row.lat").alias("south"), F.max("row.lon").alias("east"), F.max("row.lat").alias("north"),
    )
    sums = files.select("shard", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return sums.join(rows, "shard", "left").select("shard", "bytes", "sha256", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), *_BOUNDS)


def verify(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """``shard, fault``: every fault of the files of a generation against its manifest.

    ``missing`` and ``unclaimed`` files; ``length``, ``digest``, ``nodes``, ``edges`` and ``bounds`` other than claimed (bounds must equal what is computed
    anew exactly); ``unreadable`` lines; ``unsorted`` node ids; ``conflict``: a node has another place in another shard; ``dangling``: an
    edge ends at a node that no shard holds. A generation without faults gives no rows.
    """
    rows = cut(_parsed(files))  # every check reads the lines; they are parsed once
    made = cut(manifest(files, rows))
    other = lambda c: ~F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}"))
    held = made.alias("m").join(claimed.alias("c"), "shard")
    wrong = F.array_compact(F.array(
        F.when(other("bytes"), "length"), F.when(other("sha256"), "digest"), F.when(other("nodes"), "nodes"), F.when(other("edges"), "edges"),
        F.when(reduce(lambda a, b: a | b, map(other, _BOUNDS)), "bounds"),
    ))
    nodes = rows.where("row.kind = 'node'").select("shard", "place", F.col("row.id").alias("id"), F.col("row.lon").alias("lon"), F.col("row.lat").alias("lat"))
    # Neighbours in the file: the ids in order of their places must ascend.
    order = nodes.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda p: p["id"]).alias("ids"))
    # Of a node with several places only those shards are named that differ from the smallest one's.
    first = nodes.groupBy("id").agg(F.min(F.struct("shard", "lon", "lat")).alias("f"), F.count("*").alias("n")).where("n > 1")
    conflict = nodes.join(first, "id").where("lon <> f.lon or lat <> f.lat").select("shard")
    ends = rows.where("row.kind = 'edge'").select("shard", F.explode(F.array("row.from", "row.to")).alias("id"))
    named = [
        (claimed.join(made, "shard", "left_anti").select("shard"), "missing"), (made.join(claimed, "shard", "left_anti").select("shard"), "unclaimed"),
        (rows.where("row is null or row.kind is null or row.kind not in ('node', 'edge')").select("shard"), "unreadable"),
        (order.where(F.array_sort("ids") != F.col("ids")).select("shard"), "unsorted"), (conflict, "conflict"), (ends.join(nodes.select("id"), "id", "left_anti").select("shard"), "dangling"),
    ]
    faults = [held.select("shard", F.explode(wrong).alias("fault")), *(df.distinct().withColumn("fault", F.lit(name)) for df, name in named)]
    return reduce(DataFrame.union, faults)
