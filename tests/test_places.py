"""Many rows of one place or outline: the joins on places must not meet every pair of them, which here would be ten thousand million."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from penumbra.operators import rings, shade, snap, spatial, sweep

MANY = 100_000
SQUARE = "array(struct(-1D + {x} AS x, -1D AS y), struct(1D + {x} AS x, -1D AS y), struct(1D + {x} AS x, 1D AS y), struct(-1D + {x} AS x, 1D AS y))"


def _at(spark, name, lon):
    return spark.range(MANY).select(F.col("id").alias(name), F.lit(lon).alias("lon"), F.lit(40.0).alias("lat"))


def _prisms(spark):
    """Equal outlines ten metres east, the tallest of 30 metres."""
    height = F.when(F.col("id") == 77, 30.0).otherwise(5.0)
    return spark.range(MANY).select(F.col("id").alias("prism_id"), F.expr(SQUARE.format(x="10D")).alias("ring"), height.alias("height"), F.lit(1.0).alias("opacity"))


def _points(spark):
    return spark.range(MANY).select(F.col("id").alias("k"), F.lit(0).alias("cell"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


def test_nearest_of_one_place(spark):
    found = spatial.nearest_join(_at(spark, "a", 10.0), _at(spark, "b", 10.001), "a", "b", 500.0)
    assert found.agg(F.count("*"), F.min("b"), F.max("b")).first() == (MANY, 0, 0)


def test_nearest_however_far_of_one_place(spark):
    found = snap.nearest_any(_at(spark, "a", 10.0), _at(spark, "b", 50.0), "a", "b", 5000.0)
    assert found.agg(F.count("*"), F.min("b"), F.max("b")).first() == (MANY, 0, 0)


def test_owner_of_one_place(spark):
    polygons = spark.range(MANY).select(F.col("id").alias("p"), F.expr(SQUARE.format(x="0D")).alias("ring"), F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("holes"))
    found = rings.polygon_owner(_points(spark), polygons, "k", "p", 1.0)
    assert found.agg(F.count("*"), F.min("p"), F.max("p")).first() == (MANY, 0, 0)


def test_shade_of_one_place(spark):
    found = shade.prism_shade(_points(spark), _prisms(spark).drop("prism_id"), 90.0, 60.0, ["k"])
    assert found.agg(F.count("*"), F.min("shade"), F.max("shade")).first() == (MANY, 1.0, 1.0)


def test_sweep_of_one_place(spark):
    """Only the tallest prism reaches above the ray of the first slot; none that of the second."""
    slots = spark.createDataFrame([(0, 1, 90.0, 60.0), (0, 2, 90.0, 80.0), (0, 3, 90.0, -1.0)], "cell int, slot int, azimuth double, altitude double")
    found = sweep.sweep(_points(spark), _prisms(spark), slots, ["k"])
    assert {tuple(r) for r in found.groupBy("slot").agg(F.count("*"), F.min("opacity")).collect()} == {(1, MANY, 1.0)}


def test_far_walls_count_where_near_ones_do_not_settle(spark):
    """A crown at 10 metres, a wall at 200 metres: seen low the wall is the denser one, seen high only the crown is in the way."""
    prisms = spark.sql(f"SELECT 1L AS prism_id, {SQUARE.format(x='10D')} AS ring, 40D AS height, 0.6D AS opacity UNION ALL SELECT 2L, {SQUARE.format(x='200D')}, 40D, CAST(NULL AS DOUBLE)")
    slots = spark.createDataFrame([(0, 1, 90.0, 5.0), (0, 2, 90.0, 45.0), (0, 3, 270.0, 5.0)], "cell int, slot int, azimuth double, altitude double")
    assert {tuple(r) for r in sweep.sweep(_points(spark).limit(1), prisms, slots, ["k"]).select("slot", "opacity").collect()} == {(1, 1.0), (2, 0.6)}


def test_nearest_few_of_many_in_one_place_and_over_the_date_line(spark, monkeypatch):
    from penumbra.operators import spatial

    rng = random.Random(2)
    at = lambda: (rng.choice([180.0, -180.0]) + rng.uniform(-0.01, 0.01), rng.choice([0.0, 60.0, 89.99]) + rng.uniform(-0.005, 0.005))
    left, right = [(i, *at()) for i in range(60)], [(i, *at()) for i in range(150)]
    right += [(i, *right[i % 3][1:]) for i in range(150, 180)]  # ties
    one = spark.createDataFrame(left, "a long, lon double, lat double")
    two = spark.createDataFrame(right, "b long, lon double, lat double")
    pairs = sorted((r.a, r.metres, r.b) for r in spatial.radius_join(one, two, 700.0).collect())
    expected = {a: [(m, b) for x, m, b in pairs if x == a][:4] for a in {x for x, _, _ in pairs}}
    for pack in (4096, 2):  # with several arrays a cube
        monkeypatch.setattr(spatial, "_PACK", pack)
        found = {r.a: [(n.metres, n.b) for n in r.near] for r in spatial.nearest_few(one, two, "a", "b", 4, 700.0).collect()}
        assert found == expected and len(found) > 20
