"""Ways and currents by levels of nodes that are taken out, against each source on its own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viastrata.operators import elimination, evaluation, graph

from .test_graph import floyd, frame, nodes_of, rows


def made(seed, n, m, most=3):
    rng = random.Random(seed)
    return [(*rng.sample(range(n), 2), rng.randint(1, most)) for _ in range(m)]


@pytest.mark.parametrize(("n", "m"), [(12, 8), (30, 34), (30, 120)])
def test_distances_from_many_sources_at_once(n, m):
    edges = made(n + m, n, m)
    ways = elimination.Ways.of(*(np.array(x) for x in zip(*edges, strict=True)))
    want = floyd(n, edges)
    for batch in ways.batches(ways.ids, cells=5 * n):
        assert np.allclose(ways.distances(batch), want[np.ix_(ways.named, ways.named[batch])])
    assert np.isinf(ways.distances(np.array([-1]))).all()


@pytest.mark.parametrize(("n", "m"), [(12, 8), (30, 34), (30, 120)])
def test_betweenness_by_levels_and_by_source(spark, monkeypatch, n, m):
    """Parts that do not hang together, parallel roads, many ways of one length."""
    nodes, edges = nodes_of(spark, n + 2), frame(spark, made(n + m, n, m))
    found = rows(graph.betweenness(nodes, edges), "node_id", "betweenness")
    monkeypatch.setattr(graph, "task_ways", lambda _: None)
    assert np.allclose(found, rows(graph.betweenness(nodes, edges), "node_id", "betweenness"))


def test_betweenness_of_a_city_takes_no_source_on_its_own(spark, monkeypatch):
    """2,000 nodes in two columns: on each source's own heap this was the city's nodes times its roads in Python."""

    def never(*_):
        raise AssertionError("a source on its own")

    monkeypatch.setattr(graph, "_per_source", never)
    monkeypatch.setattr(evaluation, "_one_way_in_tasks", never)
    side = 1000
    roads = [(k, k + 1, 30) for k in range(side - 1)] + [(side + k, side + k + 1, 30) for k in range(side - 1)] + [(k, side + k, 30) for k in range(side)]
    nodes, edges = nodes_of(spark, 2 * side), frame(spark, roads)
    found = dict(rows(graph.betweenness(nodes, edges), "node_id", "betweenness"))
    assert found[499] == pytest.approx(found[1500]) and found[499] == pytest.approx(max(found.values()))
    # Each pair's ways have dx + dy - 1 nodes between their ends.
    k = np.arange(side)
    apart = np.abs(k[:, None] - k).astype(float)
    between = 2 * np.maximum(apart - 1, 0).sum() + 2 * apart.sum()
    assert sum(found.values()) * (2 * side - 1) * (2 * side - 2) == pytest.approx(between)
    other = edges.withColumn("length", F.col("length") * 1.25)
    same = nodes.select("node_id", F.col("node_id").alias("match"))
    score = evaluation.apls_one_way(nodes, edges, other, same).first()
    assert score["n"] == side * (2 * side - 1) and score["score"] == pytest.approx(0.75)


@pytest.mark.parametrize("seed", range(3))
def test_agreement_by_levels_and_by_source(spark, monkeypatch, seed):
    """Nodes without a match, two with the same one, matches off all roads."""
    nodes, edges, other = nodes_of(spark, 30), frame(spark, made(seed, 30, 40)), frame(spark, made(seed + 9, 25, 30, 5))
    match = nodes.where("node_id % 7 <> 3").select("node_id", F.when(F.col("node_id") == 5, 4).when(F.col("node_id") == 6, 99).otherwise(F.col("node_id") % 27).alias("match"))
    found = evaluation.apls_one_way(nodes, edges, other, match).first()
    monkeypatch.setattr(graph, "task_ways", lambda _: None)
    want = evaluation.apls_one_way(nodes, edges, other, match).first()
    assert found["n"] == want["n"] and found["score"] == pytest.approx(want["score"])


def test_graphs_that_do_not_fit_levels():
    u, v = np.array([0, 1]), np.array([1, 2])
    assert elimination.Ways.of(u, v, np.array([1.0, 0.0])) is None
    assert elimination.Ways.of(u, v, np.array([1.0, 1.0]), most_steps=1) is None
    none = np.zeros(0, np.int64)
    assert elimination.Ways.of(none, none, np.zeros(0)).levels.n == 0


def test_agreement_without_roads(spark):
    nodes, edges, none = nodes_of(spark, 5), frame(spark, [(0, 1, 2), (1, 2, 2)]), frame(spark, [])
    match = nodes.select("node_id", F.col("node_id").alias("match"))
    assert tuple(evaluation.apls_one_way(nodes, edges, none, match).first()) == (0.0, 3)
    assert tuple(evaluation.apls_one_way(nodes, none, edges, match).first()) == (1.0, 0)
    assert {r["betweenness"] for r in graph.betweenness(nodes, none).collect()} == {0.0}


def test_potentials_of_many_roads_at_once():
    """Of the roads of a large component each task solved one node after the other, in Python."""
    n, edges = 25, [(k, k + 1, 1) for k in range(24)] + made(4, 25, 30, 9)
    u, v, g = (np.array(x) for x in zip(*((a, b, 1 / w) for a, b, w in edges), strict=True))
    network = elimination.Network(n, u, v, g)
    lap = np.zeros((n, n))
    for a, b, w in zip(u, v, g, strict=True):
        lap[[a, b], [b, a]] -= w
        lap[[a, b], [a, b]] += w
    place = network.levels.place
    made_ = network.potentials(place[u], place[v])[place]
    put = np.zeros((n, len(u)))
    put[u, np.arange(len(u))] += 1
    put[v, np.arange(len(u))] -= 1
    assert np.allclose(lap @ made_, put)


@pytest.mark.parametrize("measure", [evaluation.apls, evaluation.report])
def test_both_ways_take_each_graph_once(spark, monkeypatch, measure):
    place = lambda shift: nodes_of(spark, 30).select("node_id", (F.col("node_id") * 40.0 + shift).alias("x"), F.lit(0.0).alias("y"))
    graphs = place(0), frame(spark, made(3, 30, 45)), place(3), frame(spark, made(8, 30, 45))
    whole, calls = graph.task_ways, []
    monkeypatch.setattr(graph, "task_ways", lambda edges: calls.append(0) or whole(edges))
    found = measure(*graphs, most=None).first()
    assert len(calls) == 2
    monkeypatch.setattr(graph, "task_ways", lambda _: None)
    assert tuple(found) == pytest.approx(tuple(measure(*graphs, most=None).first()))


def test_currents_are_solved_for_next_to_a_road(monkeypatch):
    """A city of 4 x 1,000: the potentials of all nodes were solved for and sorted for each road."""
    n = 4000
    roads = [(k, k + 1, 1 + k % 3) for k in range(n - 1) if k % 4 < 3] + [(k, k + 4, 1 + k % 2) for k in range(n - 4)]
    _, network, (a, b, g) = elimination.Network.of(*(np.array(x) for x in zip(*roads, strict=True)))
    some = slice(3000, 3064)
    met, whole = [], elimination.Levels.next_below
    monkeypatch.setattr(elimination.Levels, "next_below", lambda *x: met.append(whole(*x)) or met[-1])
    found = network.flows(a[some], b[some], g[some])
    assert sum(map(len, met)) < n / 4
    x = np.sort(network.potentials(a[some], b[some]), axis=0)
    total, want = g[some] * ((2 * np.arange(n) - n + 1) @ x), np.zeros(n)
    np.add.at(want, a[some], total)
    np.add.at(want, b[some], total)
    assert np.allclose(found, want[network.levels.place], rtol=1e-12)


def test_current_flow_of_held_and_of_dealt_roads(spark):
    nodes, edges = nodes_of(spark, 30), frame(spark, made(4, 30, 45) + [(28, 29, 2)])
    want = rows(graph.current_flow(nodes, edges), "node_id", "current_flow")
    members = graph.components(nodes, edges)
    members = members.join(members.groupBy("component").agg(F.count("*").alias("n")), "component").where("n > 1")
    for task_edges in (graph.TASK_EDGES, 0):
        found = dict(rows(graph._large_current_flow(members, edges, task_edges, 3), "node_id", "current_flow"))
        assert found == pytest.approx({k: x for k, x in want if k in found})


def test_betweenness_takes_each_pair_once(spark, monkeypatch):
    """Ways go from the end of the later turn, for both ways; to nodes that are not asked for, from the one that is."""
    nodes, edges = nodes_of(spark, 20), frame(spark, made(7, 30, 45))
    taken, batch = [], elimination.Ways._batch
    monkeypatch.setattr(elimination.Ways, "_batch", lambda self, sources, until, *rest: taken.append((len(sources), until)) or batch(self, sources, until, *rest))
    ways = elimination.Ways.of(*graph.task_ways(edges))
    everything = np.ones(len(ways.ids), bool)
    whole = ways.betweenness(0, 1, everything)
    assert np.allclose(whole, sum(ways.betweenness(k, 3, everything) for k in range(3)))
    assert taken[:2] == [(len(ways.ids) // 2, len(ways.ids)), (len(ways.ids) - len(ways.ids) // 2, len(ways.ids) - len(ways.ids) // 2)]
    found = rows(graph.betweenness(nodes, edges), "node_id", "betweenness")
    monkeypatch.setattr(graph, "task_ways", lambda _: None)
    assert np.allclose(found, rows(graph.betweenness(nodes, edges), "node_id", "betweenness"))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("whole", [True, False])
def test_agreement_both_ways_against_all_pairs(seed, whole):
    """Matches that are not matched back, or shared, or off the other graph's roads; nodes that are not asked for."""
    rng = random.Random(seed)
    roads = [made(seed, 24, 30, 5), made(seed + 50, 20, 26, 5)]
    arrays = [tuple(np.array(x) for x in zip(*r, strict=True)) for r in roads]
    at = lambda most: rng.randrange(most) if seed % 2 else 23 - rng.randrange(2)
    twins = [{k: k if rng.random() < 0.7 else at(most) for k in range(n) if rng.random() < 0.9} for n, most in ((24, 22), (20, 26))]
    asked = [np.array([k for k in range(n) if whole or rng.random() < 0.6]) for n in (24, 20)]
    dist = [floyd(30, r) for r in roads]
    want = np.zeros((2, 2))
    for g in range(2):
        for s in range(30):
            for t in range(s + 1, 30):
                if s in asked[g] and dist[g][s, t] < np.inf:
                    a, b = twins[g].get(s), twins[g].get(t)
                    on = {x for r in roads[1 - g] for x in r[:2]}
                    other = dist[1 - g][a, b] if a in on and b in on else np.inf
                    want[g] += min(1, abs(dist[g][s, t] - other) / dist[g][s, t]), 1
    matches = [(np.array(list(t)), np.array(list(t.values()))) for t in twins]
    both = elimination.Agreement.of(arrays, asked, matches)
    for parts in (1, 3):
        assert np.allclose(sum(both.sums(k, parts) for k in range(parts)), want)
    one = elimination.Agreement.of(arrays, asked, [matches[0], (np.zeros(0, int), np.zeros(0, int))])
    assert np.allclose(one.sums(0, 1, 1), want[:1])


@pytest.mark.parametrize("measure", [evaluation.apls, evaluation.report])
def test_both_ways_are_one_sweep(spark, monkeypatch, measure):
    """Nodes of both graphs were taken out twice, and each pair's way was made from both ends, for each way."""
    place = lambda shift: nodes_of(spark, 40).select("node_id", (F.col("node_id") * 40.0 + shift).alias("x"), F.lit(0.0).alias("y"))
    graphs = place(0), frame(spark, made(3, 40, 55)), place(3), frame(spark, made(8, 40, 55))
    taken, whole = [], elimination.eliminate
    monkeypatch.setattr(elimination, "eliminate", lambda *x: taken.append(0) or whole(*x))
    found = measure(*graphs, most=None).first()
    assert len(taken) == 1
    monkeypatch.setattr(graph, "task_ways", lambda _: None)
    assert tuple(found) == pytest.approx(tuple(measure(*graphs, most=None).first()))


@pytest.mark.parametrize("seed", range(6))
def test_agreement_of_components_that_are_alike(monkeypatch, seed):
    """Components of the same roads were taken out and swept as those that differ. One that a node of another is matched with, one
    of a node that is not asked for, and one with a length that differs are still swept."""
    rng = random.Random(seed)
    block = lambda k, m: [(10 * k + a, 10 * k + b, x) for a, b, x in made(seed + k, 10, m)]
    here = [*block(0, 14), *block(1, 14), *block(2, 14), *block(3, 9), *block(4, 14)]
    there = [r for r in here if r[0] < 30 or rng.random() < 0.8] + [(0, 1, 0.5)] * (seed % 2)
    twins = [{k: k for k in range(50)}, {k: k for k in range(50)}]
    twins[0] |= {30: 10, 31: 11}
    asked = [np.arange(50), np.array([k for k in range(50) if k != 41])]
    dist, on = [floyd(50, r) for r in (here, there)], [{x for y in r for x in y[:2]} for r in (here, there)]
    want = np.zeros((2, 2))
    for g in range(2):
        for s, t in ((s, t) for s in asked[g] for t in range(s + 1, 50) if dist[g][s, t] < np.inf):
            a, b = twins[g][s], twins[g][t]
            other = dist[1 - g][a, b] if a in on[1 - g] and b in on[1 - g] else np.inf
            want[g] += min(1, abs(dist[g][s, t] - other) / dist[g][s, t]), 1
    taken, whole = [], elimination.eliminate
    monkeypatch.setattr(elimination, "eliminate", lambda n, *x: taken.append(n) or whole(n, *x))
    arrays = [tuple(np.array(x) for x in zip(*r, strict=True)) for r in (here, there)]
    both = elimination.Agreement.of(arrays, asked, [(np.array(list(t)), np.array(list(t.values()))) for t in twins])
    # Nodes 30 and 31 of the two graphs are places of their own each.
    assert taken[0] <= len(on[0] | on[1]) + 2 - len([k for k in on[0] if 20 <= k < 30])
    for parts in (1, 3):
        assert np.allclose(sum(both.sums(k, parts) for k in range(parts)), want)
    same = elimination.Agreement.of([arrays[0]] * 2, [asked[0]] * 2, [(asked[0], asked[0])] * 2)
    assert taken[1] == 0
    assert (same.sums(0, 1) == [0, np.triu(dist[0] < np.inf, 1).sum()]).all()
