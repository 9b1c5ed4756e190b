"""Every catalogue query against its SQL statement, and those without one against plain Python."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pytest
from support import DATA, same_rows

from penumbra.operators import graph, transit
from penumbra.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, DATA), duck, catalogue.ORACLE_SQL[name])


def test_every_query_has_a_docstring_or_oracle():
    assert all(n in catalogue.ORACLE_SQL or q.__doc__ for n, q in catalogue.QUERIES.items())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_rate_limit(spark, duck):
    rows = duck.execute("SELECT user_id, epoch_us(ts) / 1e6, event_id FROM events ORDER BY 1, 2, 3").fetchall()
    recent, expected = defaultdict(deque), {}
    for user, t, event in rows:
        q = recent[user]
        while q and q[0] <= t - 3600:
            q.popleft()
        expected[event] = len(q) < 3
        if expected[event]:
            q.append(t)
    found = {r.event_id: r.accepted for r in catalogue.QUERIES["rate_limit_accepts"](spark, DATA).collect()}
    assert found == expected


def test_two_stage_recall_is_high(spark):
    recalls = [r.recall for r in catalogue.QUERIES["knn_two_stage_recall"](spark, DATA).collect()]
    assert recalls and min(recalls) >= 0.9


def _lattice():
    side, edges = 12, []
    for i in range(side * side):
        x, y = i % side, i // side
        for j in ([i + 1] if x < side - 1 else []) + ([i + side] if y < side - 1 else []):
            k = i * 31 + j * 17
            series = [((k + s * 29) % 11) / 10 for s in range(4)]
            edges += [(i, j, 40 + k % 7, series), (j, i, 40 + k % 7, series)]
    return edges


def _reached_on_lattice(spark):
    rows = [(a, b, float(s), series[0], series) for a, b, s, series in _lattice()]
    edges = spark.createDataFrame(rows, "from_id long, to_id long, seconds double, shade double, series array<double>")
    labels = graph.label_search(edges, spark.range(1).toDF("source"), 360.0, sun_budget=150.0, bucket_seconds=120.0)
    return {(r.from_id, r.to_id) for r in graph.reachable_edges(labels, edges, 360.0, 150.0, bucket_seconds=120.0).collect()}


def test_sun_reach_prices_every_edge_at_its_arrival(spark):
    """Every walk within the budgets, state by state; the last edge too has the shade of the time at which its end is reached."""
    out = defaultdict(list)
    for a, b, s, series in _lattice():
        out[a].append((b, s, series))
    seen, queue, reached = {(0, 0, 0.0)}, deque([(0, 0, 0.0)]), set()
    while queue:
        node, t, sun = queue.popleft()
        for b, s, series in out[node]:
            at = t + s
            total = round(sun + s * (1 - series[min(int(at // 120), 3)]), 9)
            if at > 360 or total > 150:
                continue
            reached.add((node, b))
            if (b, at, total) not in seen:
                seen.add((b, at, total))
                queue.append((b, at, total))
    assert _reached_on_lattice(spark) == reached


def test_edge_shade_between_zero_and_one(spark):
    rows = catalogue.QUERIES["edge_shade"](spark, DATA).collect()
    assert rows and all(0 <= r.shade <= 1 for r in rows)


def _streets(duck):
    nation = dict(duck.execute("SELECT c_custkey, c_nationkey FROM customer").fetchall())
    out = defaultdict(list)
    for a in nation:
        for b in ([a + 1] if a % 40 != 39 else []) + [a + 40]:
            if b in nation:
                k = a * 31 + b * 17 + nation[a] + nation[b]
                series = [((k + s * 29) % 11) / 10 for s in range(4)]
                out[a].append((b, 40 + k % 7, series))
                out[b].append((a, 40 + k % 7, series))
    return out, [a for a in nation if a % 500 == 1]


def test_sun_reach_on_streets_against_all_walks(spark, duck):
    out, starts = _streets(duck)
    reached = set()
    for start in starts:
        seen, queue = {(start, 0, 0.0)}, deque([(start, 0, 0.0)])
        while queue:
            node, t, sun = queue.popleft()
            for b, s, series in out[node]:
                at = t + s
                total = round(sun + s * (1 - series[min(int(at // 120), 3)]), 9)
                if at <= 360 and total <= 150:
                    reached.add((start, node, b))
                    if (b, at, total) not in seen:
                        seen.add((b, at, total))
                        queue.append((b, at, total))
    found = {(r.source, r.from_id, r.to_id) for r in catalogue.QUERIES["sun_reach"](spark, DATA).collect()}
    assert found == reached


def _dijkstra(out, start, budget):
    best, queue = {}, [(0.0, start)]
    while queue:
        t, node = heapq.heappop(queue)
        if node in best or t > budget:
            continue
        best[node] = t
        for to, s in out(node):
            heapq.heappush(queue, (t + s, to))
    return best


def test_discounted_path_against_dijkstra(spark, duck):
    out, starts = _streets(duck)
    steps = lambda node: [(b, s * (1 - 0.8 * series[0] * 0.7) + 5) for b, s, series in out[node]]
    expected = {(s, n): round(c, 6) for s in starts for n, c in _dijkstra(steps, s, 150.0).items()}
    found = {(r.source, r.node): r.cost for r in catalogue.QUERIES["discounted_path"](spark, DATA).collect()}
    assert found == pytest.approx(expected) and len(expected) > 10


def test_transit_search_against_dijkstra(spark, duck):
    """States (stop, arrived on, boardings), as a rider would expand them."""
    nation = dict(duck.execute("SELECT c_custkey, c_nationkey FROM customer").fetchall())
    line_of = lambda a: a % 4 + 4 * (a // 40 % 3)
    rides, lines_at = defaultdict(list), defaultdict(set)
    for a in nation:
        if a + 4 in nation:
            rides[a, line_of(a)].append((a + 4, 90 + nation[a] % 5 * 10))
            lines_at[a].add(line_of(a))
            lines_at[a + 4].add(line_of(a))

    def steps(state):
        stop, by, n = state
        if by >= 0:
            for to, s in rides[stop, by]:
                yield (to, by, n), s
            yield (stop, -2, n), 0.1
            return
        for line in lines_at[stop]:
            if line % 4 != 3 and n < 5:
                wait = 0.1 if line % 4 == 2 else (240 + line * 20) / 2
                yield (stop, line, n + 1), wait + (45 if by == -2 and stop % 5 == 0 else 0)
        if stop + 1 in nation:
            yield (stop + 1, -1, n), 120

    expected = {}
    for start in (a for a in nation if a % 500 == 1):
        for (stop, by, _), t in _dijkstra(steps, (start, -1, 0), 1500.0).items():
            if by < 0:
                expected[start, stop] = min(t, expected.get((start, stop), t))
    found = {(r.source, r.node): r.seconds for r in catalogue.QUERIES["transit_search"](spark, DATA).collect()}
    assert found == pytest.approx({k: round(t, 1) for k, t in expected.items()}) and len(found) > 10


def test_stops_within_reach_of_any_start(spark):
    rides = spark.createDataFrame([("a", 1, 2, 60), ("a", 2, 3, 60), ("b", 3, 4, 61), ("b", 9, 1, 1), ("c", 20, 21, 180)], "line string, from_stop int, to_stop int, seconds int")
    walks = spark.createDataFrame([(1, 5, 180), (5, 6, 1), (2, 20, 120), (30, 31, 1)], "from_stop int, to_stop int, seconds int")
    starts = spark.createDataFrame([(1,), (30,), (30,)], "stop int")
    assert sorted(r.stop for r in transit.within_reach(starts, rides, walks, 180.0).collect()) == [1, 2, 3, 5, 20, 30, 31]


def test_boardings_are_limited_and_changes_priced(spark):
    rides = spark.createDataFrame([("a", 1, 2, 60), ("b", 2, 3, 60), ("c", 3, 4, 60)], "line string, from_stop int, to_stop int, seconds int")
    headway = spark.createDataFrame([("a", 100), ("b", None), ("c", 60)], "line string, headway_sec int")
    none = spark.createDataFrame([], "from_stop int, to_stop int, seconds int")
    changes = spark.createDataFrame([(2, 30), (3, None)], "stop int, change_sec int")
    start = spark.createDataFrame([("1#0",)], "source string")

    def found(boardings):
        edges = transit.boarding_graph(rides, headway, none, changes, boardings)
        best = {}
        for r in graph.shortest(edges, start, 1000.0).where("node like '%!%'").collect():
            stop = int(r.node.split("!")[0])
            best[stop] = min(round(r.seconds, 1), best.get(stop, 1000.0))
        return best

    assert found(2) == {1: 50.1, 2: 110.1, 3: 200.3}
    assert found(3) == {1: 50.1, 2: 110.1, 3: 200.3, 4: 290.4}
