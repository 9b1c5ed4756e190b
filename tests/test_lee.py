"""Rays against walls in arrays, and the shade of edges made of them, against every ray held against every wall."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from penumbra.operators import lee, sweep


def squares(rng, count, size):
    """Square rings over a plane, as corners of each, heights and opacities."""
    cx, cy, r = rng.integers(0, size, count), rng.integers(0, size, count), rng.integers(3, 24, count)
    rings = [[(float(x - a), float(y - a)), (float(x + a), float(y - a)), (float(x + a), float(y + a)), (float(x - a), float(y + a))] for x, y, a in zip(cx, cy, r, strict=True)]
    return rings, rng.integers(5, 50, count) * 1.0, rng.choice([1.0, 0.6, 0.3], count)


def held(x, y, ring):
    return ring[0][0] <= x < ring[2][0] and ring[0][1] <= y < ring[2][1]


def every_ray(x, y, rings, heights, opacities, azimuths, altitudes, pad):
    best = np.zeros((len(x), len(azimuths)))
    for p in range(len(x)):
        for k, (azimuth, altitude) in enumerate(zip(azimuths, altitudes, strict=True)):
            ux, uy, slope = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth)), math.tan(math.radians(altitude))
            for ring, h, o in zip(rings, heights, opacities, strict=True):
                if o <= best[p, k] or held(x[p], y[p], ring):
                    continue
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                    c = ux * (by - ay) - uy * (bx - ax)
                    if c and 0 <= ((ax - x[p]) * uy - (ay - y[p]) * ux) / c < 1 and 0 < (d := ((ax - x[p]) * (by - ay) - (ay - y[p]) * (bx - ax)) / c) <= pad and h > d * slope:
                        best[p, k] = max(best[p, k], o)
    return best


@pytest.mark.parametrize(("seed", "count", "size"), [(0, 4, 100), (1, 40, 200), (2, 60, 900)])
def test_every_ray_against_every_wall(seed, count, size):
    rng = np.random.default_rng(seed)
    rings, heights, opacities = squares(rng, count, size)
    corners = np.array(rings)
    walls = lee.Walls(corners[..., 0].ravel(), corners[..., 1].ravel(), np.full(count, 4), heights, opacities)
    # Points anywhere, on walls and on corners.
    x = np.concatenate([rng.random(20) * size, corners[:4, 0, 0], corners[:4, 0, 0]])
    y = np.concatenate([rng.random(20) * size, corners[:4, 0, 1], corners[:4, 0, 1] + 1.0])
    azimuths, altitudes = np.concatenate([rng.random(40) * 360, [0.0, 90.0, 180.0, 270.0]]), np.concatenate([rng.random(40) * 80 + 0.1, [5.0, 20.0, 40.0, 1.0]])
    a = np.radians(azimuths)
    found = lee.densest(x, y, walls, np.sin(a), np.cos(a), np.tan(np.radians(altitudes)), 150.0)
    expected = every_ray(x, y, rings, heights, opacities, azimuths, altitudes, 150.0)
    assert 0 < (expected > 0).mean() < 1 and (found == expected).all()


def test_long_edges_and_edges_of_one_place(spark):
    """Samples of a long edge lie in several tiles; nothing of the shade table is shuffled once its rows are made."""
    rng = np.random.default_rng(5)
    rings, heights, opacities = squares(rng, 80, 900)
    ends = {1: (0.0, 0.0, 900.0, 500.0), 2: (100.0, 100.0, 140.0, 130.0), 3: (100.0, 100.0, 140.0, 130.0), 4: (300.0, 20.0, 300.0, 420.0), 5: (7.0, 7.0, 7.0, 7.0)}
    edges = spark.createDataFrame([(i, "a", *e) for i, e in ends.items()], "edge_id int, cell string, ax double, ay double, bx double, by double")
    rows = list(zip(range(80), rings, map(float, heights), map(float, opacities), strict=True))
    prisms = spark.createDataFrame(rows, "prism_id int, ring array<struct<x:double,y:double>>, height double, opacity double")
    azimuths, altitudes = [10.0, 95.0, 200.0, 300.0, 0.0], [30.0, 8.0, 2.0, 50.0, -1.0]
    suns = spark.createDataFrame([("a", k, *v) for k, v in enumerate(zip(azimuths, altitudes, strict=True))] + [("b", 0, 90.0, 30.0)], "cell string, slot int, azimuth double, altitude double")
    known = spark.createDataFrame([("a",)], "cell string")
    expected = {}
    for i, (ax, ay, bx, by) in ends.items():
        length = math.hypot(bx - ax, by - ay)
        n = max(3, math.ceil(length / 25))
        for side, o in (("left", 4.0), ("right", -4.0)) if length else ():
            x = [ax + (bx - ax) * k / n - (by - ay) / length * o for k in range(n + 1)]
            y = [ay + (by - ay) * k / n + (bx - ax) / length * o for k in range(n + 1)]
            sums = every_ray(x, y, rings, heights, opacities, azimuths[:4], altitudes[:4], 400.0).sum(axis=0)
            expected |= {(i, side, k): math.floor(s / (n + 1) * 255 + 0.5) for k, s in enumerate([*sums, n + 1])}
    frame = sweep.shade_cells(edges, prisms, suns, known)
    assert {(r.edge_id, r.side, r.slot): r.shade_byte for r in frame.collect()} == expected
    made = frame._jdf.queryExecution().executedPlan().toString().split("posexplode")
    assert len(made) > 1 and "Exchange" not in made[0]
    packed = {r.edge_id: (r.slots, bytes(r.payload)) for r in sweep.shade_payloads(edges, prisms, suns, known).collect()}
    assert packed == {i: (5, bytes(expected[i, s, k] for k in range(5) for s in ("left", "right"))) for i in (1, 2, 3, 4)}
    rows = sweep.packed(sweep.shade_cells(edges, prisms, suns, known)).collect()
    assert {r.edge_id: hashlib.sha256(r.payload).hexdigest() for r in rows} == {i: hashlib.sha256(p).hexdigest() for i, (_, p) in packed.items()}
