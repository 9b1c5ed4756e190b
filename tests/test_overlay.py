"""Distances over cells of a network against brute force."""

from __future__ import annotations

import heapq
import random

from penumbra.operators import overlay

SEGMENT = "from_id long, to_id long, cost double, from_lon double, from_lat double, to_lon double, to_lat double"


def by_hand(ways, begun, ended):
    out = {}
    for source in {s for s, _, _ in begun}:
        best, heap = {}, [(c, n) for s, n, c in begun if s == source]
        heapq.heapify(heap)
        while heap:
            c, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = c
            for m, w in ways.get(n, ()):
                if m not in best:
                    heapq.heappush(heap, (c + w, m))
        for target, n, c in ended:
            if n in best:
                out[source, target] = min(out.get((source, target), 1e18), best[n] + c)
    return out


def test_distances_of_near_and_far_pairs(spark):
    pick = random.Random(5)
    rows, ways, across = [], {}, 9
    for a in range(across * 31):
        for b in ([a + 1] if a % across < across - 1 else []) + ([a + across] if a + across < across * 31 else []):
            if pick.random() < 0.68:
                cost = round(pick.uniform(40, 90), 6)
                x, y = (a % across, a // across), (b % across, b // across)
                rows.append((a, b, cost, float(x[0]), float(x[1]), float(y[0]), float(y[1])))
                ways.setdefault(a, []).append((b, cost))
                ways.setdefault(b, []).append((a, cost))
    begun = [(s, pick.randrange(across * 31), round(pick.uniform(0, 20), 6)) for s in range(12) for _ in range(2)]
    ended = [(t, pick.randrange(across * 31), round(pick.uniform(0, 20), 6)) for t in range(15) for _ in range(2)]
    limits = {(s, t): pick.choice([150.0, 600.0, 5000.0]) for s in range(12) for t in range(15)}
    limits = {p: v for i, (p, v) in enumerate(limits.items()) if i % 3}
    expected = {p: c for p, c in by_hand(ways, begun, ended).items() if c <= limits.get(p, -1)}
    assert {limits[p] for p in expected} == {150.0, 600.0, 5000.0} and len(expected) < len(limits)
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    found = overlay.distances(
        frame(rows, SEGMENT), frame(begun, "source long, node long, cost double"), frame(ended, "target long, node long, cost double"),
        frame([(*p, v) for p, v in limits.items()], "source long, target long, limit double"), 2.5,
    )
    found = {(r.source, r.target): r.cost for r in found.collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[p] - expected[p]) < 1e-5 for p in expected)


def test_a_far_pair_takes_few_written_tables(spark, monkeypatch):
    """A search in rounds writes its labels once an edge; a street of 900 edges took 900 tables."""
    from penumbra.operators import search, walkability

    written = []
    for module in (overlay, search, walkability):
        for name in ("cut", "cut_counted"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name): (written.append(1), _f(*a))[1])
    step, count = 0.0006, 900
    rows = [(i, i + 1, -74.0, 40.5 + i * step, -74.0, 40.5 + (i + 1) * step) for i in range(count)]
    segments = spark.createDataFrame(rows, "from_id long, to_id long, from_lon double, from_lat double, to_lon double, to_lat double")
    transfers = [(1, 1, -74.0, 40.5, 1, -74.0, 40.5 + count * step, True)]
    frame = spark.createDataFrame(transfers, "transfer_id long, station_id long, station_lon double, station_lat double, stop_id long, stop_lon double, stop_lat double, leaving boolean")
    doors = spark.createDataFrame([(1, 1, -74.0, 40.5, False)], "door_id long, station_id long, lon double, lat double, exit_only boolean")
    found = walkability.walks(frame, doors, segments, walkability.WalkLimits(25.0, 1.5, 60.0)).collect()
    assert [(r.walk_m, r.refused) for r in found] == [(round(count * step * 111194.9266), None)]
    assert len(written) < 60
