"""Searches under a sun budget against all walks, state by state, on small random streets."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from penumbra.operators import graph, search

SCHEMA = "from_id long, to_id long, seconds double, shade double, series array<double>"
#: Seconds and shade of edges: two ways of one price, and a walk, which doubles add up to slightly different sums.
ROUNDED = [(10.0, 0.0), (10.0, 0.4)], [(10.0, 0.0), (30.0, 0.8)]
WHOLE = [(10.0, 0.4), (10.0, 1.0), (30.0, 0.7)]


def lattice(seed, rows=3, columns=4, buckets=3):
    rng, edges = random.Random(seed), []
    for a in range(rows * columns):
        for b in ([a + 1] if a % columns < columns - 1 else []) + ([a + columns] if a + columns < rows * columns else []):
            seconds = float(rng.choice([20, 30, 45, 60]))
            for x, y in ((a, b), (b, a)):
                edges.append((x, y, seconds, rng.randrange(11) / 10, [rng.randrange(11) / 10 for _ in range(buckets)] if rng.random() < 0.9 else None))
    return edges


class World:
    """Every state that a walker can be in, one move at a time."""

    def __init__(self, edges, seconds, sun, width=None, waits=False):
        self.out, self.seconds, self.sun, self.width, self.waits = defaultdict(list), seconds, sun, width, waits
        self.buckets = max([len(e[4]) for e in edges if e[4]], default=1) if width else 1
        for a, b, s, shade, series in edges:
            self.out[a].append((b, s, shade, series))

    def bucket(self, t):
        return min(int(t // self.width), self.buckets - 1) if self.width else 0

    def shade(self, t, shade, series):
        return series[min(int(t // self.width), len(series) - 1)] if self.width and series else shade

    def stay(self, node, t, lasts):
        total, end = 0.0, t + lasts
        while t < end - 1e-9:
            b = self.bucket(t)
            until = min(end, (b + 1) * self.width) if self.width and b < self.buckets - 1 else end
            best = max([0.0, *(self.shade((b + 0.5) * (self.width or 1), s, r) for _, _, s, r in self.out[node])])
            total += (until - t) * (1 - best)
            t = until
        return total

    def moves(self, node, t, sun):
        for b, s, shade, series in self.out[node]:
            yield (node, b), b, t + s, sun + s * (1 - self.shade(t + s, shade, series))
        if self.waits and self.width and self.bucket(t) < self.buckets - 1:
            until = (t // self.width + 1) * self.width
            yield None, node, until, sun + self.stay(node, t, until - t)

    def fits(self, t, sun):
        return t <= self.seconds and sun <= self.sun + 1e-9

    def reached(self, start):
        seen, todo, best = {(start, 0.0, 0.0)}, [(start, 0.0, 0.0)], {}
        while todo:
            node, t, sun = todo.pop()
            for edge, to, at, cost in self.moves(node, t, sun):
                if self.fits(at, cost):
                    if edge:
                        best[edge] = min(best.get(edge, 1e9), cost)
                    if (state := (to, at, round(cost, 9))) not in seen:
                        seen.add(state)
                        todo.append((to, at, cost))
        return best

    def outings(self, start, dwell):
        """Edges of walks that come home, by trying all of them."""
        best = {}

        def go(node, t, sun, back, way):
            if back and node == start:
                for e in way:
                    best[e] = min(best.get(e, 1e9), sun)
            if not back and self.fits(t + dwell, s := sun + self.stay(node, t, dwell)):
                go(node, t + dwell, s, True, way)
            for edge, to, at, cost in self.moves(node, t, sun):
                if self.fits(at, cost):
                    go(to, at, cost, back, way | {edge} if edge else way)

        go(start, 0.0, 0.0, False, frozenset())
        return best


def run(spark, edges, budget, start=0):
    frame = spark.createDataFrame(edges, SCHEMA)
    starts = spark.createDataFrame([(start,)], "source long")
    return frame, starts, search.search(frame, starts, budget)


@pytest.mark.parametrize(("seed", "width", "waits"), [(2, 60.0, False), (3, 50.0, True)])
def test_reach_equals_all_walks_and_walks_can_be_replayed(spark, seed, width, waits):
    edges = lattice(seed)
    budget = search.Budget(150.0, 45.0, width, waits)
    frame, _, found = run(spark, edges, budget)
    whole = {(r.from_id, r.to_id): r for r in search.reached(found.labels, frame, budget).collect()}
    world = World(edges, 150.0, 45.0, width, waits)
    truth = world.reached(0)
    reached = {e: r for e, r in whole.items() if r.share == 1}
    assert set(reached) == set(truth) and all(abs(reached[e].sun - s) < 1e-6 for e, s in truth.items())
    assert [r.outcome for r in found.outcomes.collect()] == ["exact"]
    # Every edge's walk costs what it says.
    wanted = spark.createDataFrame([(0, r.label) for r in reached.values()], "source long, label long")
    steps = defaultdict(dict)
    for r in search.walks(found.labels, wanted).collect():
        steps[r.label][r.place] = r
    price = {(a, b): (s, shade, series) for a, b, s, shade, series in edges}
    for edge, row in reached.items():
        way = [steps[row.label][p] for p in sorted(steps[row.label], reverse=True)]
        assert way[0].node == 0 and way[-1].node == edge[0]
        t = sun = 0.0
        for before, after in zip(way, way[1:], strict=False):
            if after.waited:
                sun += world.stay(before.node, t, after.seconds - t)
                t = after.seconds
            else:
                s, shade, series = price[before.node, after.node]
                t += s
                sun += s * (1 - world.shade(t, shade, series))
        s, shade, series = price[edge]
        assert abs(t + s - row.seconds) < 1e-6 and abs(sun + s * (1 - world.shade(t + s, shade, series)) - row.sun) < 1e-6
    # Parts of edges end where a budget does.
    for r in whole.values():
        assert 0 < r.share <= 1 and r.seconds <= 150 + 1e-6 and r.sun <= 45 + 1e-6
        assert r.share == 1 or r.seconds > 150 - 1e-6 or r.sun > 45 - 1e-6


@pytest.mark.parametrize("caps", [{"slot_labels": 1}, {"max_labels": 6}])
def test_capped_searches_say_what_they_don_t_know(spark, caps):
    edges = lattice(5, 3, 5)
    budget = search.Budget(180.0, 50.0, 60.0, **caps)
    frame, starts, found = run(spark, edges, budget)
    walked = search.reached(found.labels, frame, budget)
    reached = {(r.from_id, r.to_id) for r in walked.where("share = 1").collect()}
    unsure = {(r.from_id, r.to_id) for r in search.undecided(walked, found.outcomes, frame, starts, budget).collect()}
    truth = set(World(edges, 180.0, 50.0, 60.0).reached(0))
    assert reached <= truth <= reached | unsure and not reached & unsure
    outcome = found.outcomes.collect()[0].outcome
    assert outcome == ("approximate" if "slot_labels" in caps else "budget-exhausted") or not unsure


@pytest.mark.parametrize(("seed", "width", "waits"), [(8, 55.0, True)])
def test_round_trips_equal_all_outings(spark, seed, width, waits):
    edges = lattice(seed, 3, 3)
    frame = spark.createDataFrame(edges, SCHEMA)
    found = search.round_trips(frame, spark.createDataFrame([(4,)], "source long"), search.Budget(180.0, 70.0, width, waits), 40.0)
    truth = World(edges, 180.0, 70.0, width, waits).outings(4, 40.0)
    assert {(r.from_id, r.to_id): round(r.sun, 6) for r in found.collect()} == {e: round(s, 6) for e, s in truth.items()}
    assert truth


def test_a_street_without_a_way_back_is_out(spark):
    edges = [(0, 1, 60.0, 1.0, None), (1, 0, 60.0, 1.0, None), (1, 2, 30.0, 1.0, None), (2, 3, 30.0, 1.0, None), (3, 2, 300.0, 1.0, None)]
    found = search.round_trips(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame([(0,)], "source long"), search.Budget(300.0), 30.0)
    assert {(r.from_id, r.to_id) for r in found.collect()} == {(0, 1), (1, 0)}


def test_waiting_in_the_shade_beats_rushing_into_the_sun(spark):
    edges = [(0, 1, 30.0, 0.0, [1.0, 1.0]), (1, 2, 30.0, 0.0, [0.0, 1.0])]
    for waits, reaches in ((False, False), (True, True)):
        budget = search.Budget(300.0, 5.0, 100.0, waits)
        frame, _, found = run(spark, edges, budget)
        assert ((1, 2) in {(r.from_id, r.to_id) for r in search.reached(found.labels, frame, budget).where("share = 1").collect()}) == reaches


def test_least_costs_from_several_nodes_with_limits_of_their_own(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 4, 0.0), (5, 4, 1.0), (4, 6, 2.0)], "from_id long, to_id long, cost double")
    starts = spark.createDataFrame([("a", 1, 0.0, 10.0), ("a", 5, 4.0, 10.0), ("b", 1, 0.0, 9.9), ("c", 9, 0.0, 5.0), ("d", 1, 8.0, 5.0)], "source string, node long, cost double, limit double")
    found = {(r.source, r.node): (r.cost, r.before) for r in search.least(edges, starts, None).collect()}
    assert found == {("a", 1): (0.0, None), ("a", 5): (4.0, None), ("a", 2): (5.0, 1), ("a", 3): (10.0, 2), ("a", 4): (5.0, 5), ("a", 6): (7.0, 4), ("b", 1): (0.0, None), ("b", 2): (5.0, 1), ("c", 9): (0.0, None)}
    assert search.least(edges.limit(0), starts.limit(0), None).count() == 0


def test_regions_keep_what_is_proven(spark):
    rows = [(100.0, 10.0, 0, 1, 2, "reachable"), (200.0, 20.0, 0, 1, 2, "undecided"), (200.0, 20.0, 0, 2, 3, "undecided"), (300.0, 30.0, 0, 3, 4, "reachable"), (200.0, 20.0, 0, 5, 6, "reachable")]
    frame = spark.createDataFrame(rows, "seconds_budget double, sun_budget double, source long, from_id long, to_id long, status string")
    assert sorted((r.from_id, r.status) for r in search.merge_regions(frame, 200.0, 20.0).collect()) == [(1, "reachable"), (2, "undecided"), (5, "reachable")]


def test_empty_streets_and_starts_without_streets(spark):
    none = spark.createDataFrame([], SCHEMA)
    budget = search.Budget(100.0, 10.0, 60.0, waits=True)
    found = search.search(none, spark.createDataFrame([(7,)], "source long"), budget)
    assert [(r.source, r.node) for r in found.labels.collect()] == [(7, 7)]
    assert search.reached(found.labels, none, budget).count() == 0
    assert search.round_trips(none, spark.createDataFrame([(7,)], "source long"), budget, 10.0).count() == 0


def test_sums_that_differ_by_rounding_alone_are_equal(spark):
    """Both ways to node 3 cost the same sun, which doubles add up to a little less on the slower one."""
    fast, slow = ROUNDED
    edges = [(0, 1, *fast[0], None), (1, 3, *fast[1], None), (0, 2, *slow[0], None), (2, 3, *slow[1], None)]
    price = lambda way: sum(seconds * (1 - shade) for seconds, shade in way)
    assert 0 < price(fast) - price(slow) < 1e-9
    labels = graph.label_search(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame([(0,)], "source long"), 300.0)
    assert [r.seconds for r in labels.where("node = 3").collect()] == [sum(seconds for seconds, _ in fast)]


@pytest.mark.parametrize("waits", [False, True])
def test_a_walk_that_takes_the_whole_sun_budget_fits(spark, waits):
    """The three prices add up to the budget, and in doubles to a little more."""
    edges = [(i, i + 1, seconds, shade, [shade, shade]) for i, (seconds, shade) in enumerate(WHOLE)]
    price = sum(seconds * (1 - shade) for seconds, shade in WHOLE)
    budget = search.Budget(300.0, round(price, 6), 100.0, waits)
    assert budget.sun < price < budget.sun + 1e-9
    frame = spark.createDataFrame(edges, SCHEMA)
    found = search.search(frame, spark.createDataFrame([(0,)], "source long"), budget)
    assert found.labels.where("node = 3").count() >= 1
    assert {r.from_id for r in search.reached(found.labels, frame, budget).where("share = 1").collect()} == {0, 1, 2}


def test_round_trip_on_a_long_shaded_way_takes_rounds_by_time_not_by_length(spark, monkeypatch):
    ways = [(a, b, 50.0, 1.0, [1.0]) for i in range(40) for a, b in ((i, i + 1), (i + 1, i))]
    edges = spark.createDataFrame(ways, "from_id long, to_id long, seconds double, shade double, series array<double>")
    turns, counted = [], search.cut_counted
    monkeypatch.setattr(search, "cut_counted", lambda *a: turns.append(1) or counted(*a))
    found = search.round_trips(edges, spark.createDataFrame([(0,)], "source long"), search.Budget(160.0, 10.0, 120.0), 60.0)
    assert sorted((r.from_id, r.to_id, r.sun) for r in found.collect()) == [(0, 1, 0.0), (1, 0, 0.0)]
    assert len(turns) < 20  # one for each of the 40 streets in full shade before
