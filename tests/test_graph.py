import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viastrata.operators import evaluation, graph, healing, resilience, spatial, synthetic, tracing

EDGES = "src long, dst long, length double"


def frame(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], EDGES)


def nodes_of(spark, n):
    return spark.range(n).select(F.col("id").alias("node_id"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}
    return [(a, b, rng.randint(1, 9)) for a, b in sorted(pairs)]


def test_components_by_rounds_and_in_a_task(spark, some):
    nodes, edges = nodes_of(spark, 40), frame(spark, some)
    whole = rows(graph.components(nodes, edges), "node_id", "component")
    assert whole == rows(graph.components(nodes, edges, task_edges=0), "node_id", "component")
    root = {n: n for n in range(40)}
    for _ in range(40):
        for a, b, _w in some:
            root[a] = root[b] = min(root[a], root[b])
    assert whole == sorted(root.items())
    shuffled = frame(spark, some[::-1])
    assert whole == rows(graph.components(nodes, shuffled), "node_id", "component")


def floyd(n, edges):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def test_distances_by_rounds_and_in_tasks(spark, some):
    edges, want = frame(spark, some), floyd(40, some)
    sources = spark.range(6).select(F.col("id").alias("source"))
    expected = sorted((s, n, want[s, n]) for s in range(6) for n in range(40) if np.isfinite(want[s, n]))
    for limit in (10**6, 0):
        assert rows(graph.distances(edges, sources, task_edges=limit), "source", "node_id", "dist") == expected


def test_route_is_a_shortest_way(spark, some):
    edges, want = frame(spark, some), floyd(40, some)
    dest = max(n for n in range(40) if np.isfinite(want[0, n]) and n)
    way = sorted(graph.route(edges, 0, dest).collect())
    assert (way[0]["node_id"], way[-1]["node_id"], way[-1]["dist"]) == (0, dest, want[0, dest])
    assert sorted(graph.route(edges, 0, dest, task_edges=0).collect())[-1] == way[-1]
    assert graph.route(frame(spark, [(0, 1, 1), (2, 3, 1)]), 0, 3).count() == 0


@pytest.mark.parametrize("steps", [0, 1, 2, 3, 4, 7, 8, 11])
def test_route_by_doubled_pointers_has_each_step(spark, steps):
    line = frame(spark, [(k, k + 1, 1 + k % 3) for k in range(steps + 1)])
    here, rounds = (sorted(map(tuple, graph.route(line, 0, steps, task_edges=limit).collect())) for limit in (10**6, 0))
    assert here == rounds and [r[:2] for r in here] == [(k, k) for k in range(steps + 1)]


def test_spanning_forest_by_rounds_and_in_a_task(spark, some):
    nodes = nodes_of(spark, 40)
    parts = graph.components(nodes, frame(spark, some[:20]))
    rest = spark.createDataFrame([(a, b, float(w)) for a, b, w in some[20:]], "u long, v long, weight double")
    assert rows(graph.spanning_forest(rest, parts), "u", "v") == rows(graph.spanning_forest(rest, parts, task_edges=-1), "u", "v")


def test_k_core_by_rounds_and_in_a_task(spark, some):
    nodes, edges = nodes_of(spark, 40), frame(spark, some)
    assert rows(graph.k_core(nodes, edges), "node_id", "core") == rows(graph.k_core(nodes, edges, task_edges=-1), "node_id", "core")


def test_betweenness_against_all_ways(spark, some):
    n = 40
    want, near = floyd(n, some), {}
    for a, b, w in some:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w

    def ways(s, t):
        if s == t:
            return [[s]]
        return [[*p, t] for u, w in near.get(t, {}).items() if np.isclose(want[s, u] + w, want[s, t]) for p in ways(s, u)]

    total = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        if np.isfinite(want[s, t]):
            found = ways(s, t)
            for p in found:
                for m in p[1:-1]:
                    total[m] += 1 / len(found)
    got = dict(rows(graph.betweenness(nodes_of(spark, n), frame(spark, some)), "node_id", "betweenness"))
    assert np.allclose([got[k] for k in range(n)], total / ((n - 1) * (n - 2)))


def test_current_flow_of_a_line_is_its_betweenness(spark):
    line = [(k, k + 1, 1) for k in range(4)]
    flow = dict(rows(graph.current_flow(nodes_of(spark, 6), frame(spark, line)), "node_id", "current_flow"))
    assert np.allclose([flow[k] for k in range(6)], [0, 0.5, 2 / 3, 0.5, 0, 0])


def test_canonical_keeps_the_shorter_road(spark):
    both = frame(spark, [(2, 1, 5), (1, 2, 3), (3, 1, 1)])
    assert rows(graph.canonical(both), "src", "dst", "length") == [(1, 2, 3.0), (1, 3, 1.0)]


def test_occluded_city(spark):
    nodes, edges = synthetic.city(spark, 6, 6, 30.0)
    inside = spark.createDataFrame([(n,) for n in (28, 33, 34, 35)], "node_id long")
    gaps = graph.boundary_edges(edges, inside)
    assert rows(gaps, "src", "dst") == [(21, 28), (22, 28), (27, 28), (27, 33), (28, 29), (29, 35), (32, 33)]
    left = graph.without_edges(edges, gaps.select("src", "dst"))
    sizes = graph.components(nodes, left).groupBy("component").count()
    assert sorted(r["count"] for r in sizes.collect()) == [4, 32]
    flat = spark.range(4).select((F.col("id") % 2).cast("int").alias("row"), F.expr("cast(id div 2 as int)").alias("col"), F.lit(1.0).alias("conf"))
    bridges, considered = healing.heal(nodes, left, raster=flat, height=2, width=2)
    found = rows(bridges, "src", "dst")
    assert len(found) == 1
    assert rows(healing.tally(considered), "reason")[0][0] == "redundant_after_earlier_bridge"
    again, _ = healing.heal(nodes, left.select("src", "dst", "length").unionByName(bridges.select("src", "dst", "length")), raster=flat, height=2, width=2)
    assert again.count() == 0
    score = healing.against_truth(bridges, gaps).first()
    assert score["tp"] + score["fp"] == 1 and score["recall"] in (0.0, pytest.approx(1 / 7))


@pytest.mark.parametrize(("d", "a", "occ", "passes"), [(15, 1.0, 0.0, True), (20, 0.5, 0.0, True), (25, 0.375, 0.125, False), (25, 0.375, 0.25, True), (30, 0.25, 0.875, True), (30, 0.25, 0.75, False), (42.426, 0.0, 1.0, False)])
def test_gate(spark, d, a, occ, passes):
    reason = spark.range(1).select(healing.gate(F.lit(float(d)), F.lit(a), F.lit(occ)).alias("r")).first()["r"]
    assert (reason is None) == passes


def test_look_ahead_walks_along_the_road(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 60.0, 0.0), (2, 0.0, 9.0)], "node_id long, x double, y double")
    line = [{"x": 60.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]
    edges = spark.createDataFrame([(0, 1, 60.0, line)], EDGES + ", geometry array<struct<x:double,y:double>>")
    assert rows(healing.look_ahead(nodes, edges), "node_id", "px", "py") == [(0, 40.0, 0.0), (1, 20.0, 0.0), (2, 0.0, 9.0)]
    assert rows(healing.look_ahead(nodes, edges, extrapolate=True), "node_id", "px", "py")[0] == (0, -40.0, 0.0)


def test_resilience_index_branches(spark):
    pairs = spark.createDataFrame([(None, None), (10.0, None), (10.0, 10.0), (10.0, 8.0), (10.0, 20.0)], "base double, perturbed double")
    got = resilience.resilience_index(pairs).first()
    assert (got["index"], got["cut_off"], got["degraded"], got["unaffected"], got["n"]) == (pytest.approx(0.7), 1, 1, 3, 5)
    assert resilience.resilience_index(pairs.limit(0)).first()["index"] is None


def test_a_graph_agrees_with_itself(spark):
    nodes, edges = synthetic.city(spark, 4, 4, 30.0)
    one = evaluation.report(nodes, edges, nodes, edges, most=None).first()
    assert (one["apls"], one["breaks"], one["ratio"], one["completeness"], one["quality"]) == (1.0, 0, 1.0, 1.0, 1.0)
    assert evaluation.node_pairs(nodes.select("node_id"), 20).distinct().count() == 20
    assert evaluation.apls(nodes, edges, nodes, edges, most=30).first()["n_there"] == 30
    empty = evaluation.apls(nodes, edges, nodes.limit(0), edges.limit(0), most=None).first()
    assert (empty["apls"], empty["n_back"]) == (0.0, 0)


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(1)
    at = [(k, rng.uniform(-100, 100), rng.uniform(-100, 100)) for k in range(150)]
    points = spark.createDataFrame(at, "node_id long, x double, y double")
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(at, 2) if np.hypot(a[1] - b[1], a[2] - b[2]) <= 17)
    assert rows(spatial.radius_pairs(points, 17.0), "u", "v") == want
    with pytest.raises(ValueError, match="radius"):
        spatial.radius_pairs(points, 0)


def test_default_scenarios_and_pairs(spark):
    nodes, edges = synthetic.city(spark, 6, 6, 30.0)
    scores = nodes.select("node_id", F.col("node_id").cast("double").alias("composite"))
    sizes = {r["scenario"]: r["count"] for r in resilience.default_scenarios(nodes, scores).groupBy("scenario").count().collect()}
    assert sizes == {"top_1": 1, "top_5": 5, "random_10pct": 4}
    assert resilience.sample_pairs(nodes, edges).count() == 18
    assert resilience.sample_pairs_exact(spark, [5, 3, 9, 7, 1]).count() == 2


def test_criticality_is_scaled(spark):
    nodes, edges = synthetic.city(spark, 4, 4, 30.0)
    found = graph.criticality(nodes, edges).collect()
    assert len(found) == 16 and all(0 <= r[m] <= 1 for r in found for m in (*graph.MEASURES, "composite"))
    # Against each measure by itself, scaled here.
    scaled = {}
    for name, df in zip(graph.MEASURES, (graph.betweenness(nodes, edges), graph.k_core(nodes, edges), graph.current_flow(nodes, edges), graph.alpha_centrality(nodes, edges)), strict=True):
        got = dict(rows(df, "node_id", name))
        low, high = min(got.values()), max(got.values())
        scaled[name] = {n: (x - low) / (high - low) if high > low else 0.0 for n, x in got.items()}
    for r in found:
        want = [scaled[m][r["node_id"]] for m in graph.MEASURES]
        assert np.allclose([r[m] for m in graph.MEASURES], want) and abs(r["composite"] - sum(want) / 4) < 1e-9


def test_alpha_in_a_task_and_by_rounds(spark, some):
    nodes, edges = nodes_of(spark, 40), frame(spark, [*some, (3, 3, 1), (2, 77, 1)])
    x = np.ones(40)
    a = np.zeros((40, 40))
    for u, v, _ in [*some, (3, 3, 1)]:
        a[u, v] += 1
        a[v, u] += 1
    for _ in range(6):
        x = 1 + 0.1 * a @ x
    for task_edges in (graph.TASK_EDGES, 0):
        got = rows(graph.alpha_centrality(nodes, edges, rounds=6, task_edges=task_edges), "node_id", "alpha")
        assert np.allclose(got, list(enumerate(x)))


def test_pairs_in_tasks_and_by_rounds(spark, some):
    edges = frame(spark, some)
    pairs = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(40, 0, -4)] + [(1, None), (0, 1), (0, 1)], "origin long, dest long")
    key = lambda df: sorted((tuple(r) for r in df.select("origin", "dest", "dist").collect()), key=str)
    found = key(graph.pair_distances(edges, pairs))
    assert len(found) == pairs.count() and found == key(graph.pair_distances(edges, pairs, task_edges=0))


def test_agreement_in_tasks_and_from_written_ways(spark, some):
    nodes, edges = nodes_of(spark, 40), frame(spark, some)
    other = frame(spark, some[::2])
    match = spark.createDataFrame([(n, n) for n in range(0, 40) if n % 7], "node_id long, match long")
    whole = evaluation.apls_one_way(nodes, edges, other, match).first()
    written = evaluation.apls_one_way(nodes, edges, other, match, ways=evaluation.all_ways(nodes, edges), other_ways=evaluation.all_ways(nodes, other)).first()
    assert whole["n"] == written["n"] and abs(whole["score"] - written["score"]) < 1e-9
    none = evaluation.apls_one_way(nodes, edges.limit(0), other, match).first()
    assert tuple(none) == (1.0, 0)


def test_rasters_of_several_tiles_are_told_apart(spark):
    raster = spark.createDataFrame([(t, r, c, float(t)) for t in (1, 2) for r in range(8) for c in range(8)], "tile_id long, row int, col int, prob double")
    points = spark.createDataFrame([(t, 2.5, 3.5) for t in (1, 2)], "tile_id long, row double, col double")
    lines = spark.createDataFrame([(t, 1.0, 1.0, 5.0, 6.0) for t in (1, 2)], "tile_id long, x0 double, y0 double, x1 double, y1 double")
    assert np.allclose(rows(healing.bilinear(points, raster, "prob", 8, 8, ["tile_id"]), "tile_id", "prob"), [(1, 1), (2, 2)])
    seen = healing.corridor(lines, raster, "prob", 8, 8, keys=["tile_id"])
    assert np.allclose(rows(seen, "tile_id", "prob"), [(1, 1)] * 8 + [(2, 2)] * 8)
    low = raster.withColumn("prob", F.col("prob") - 1)
    assert rows(healing.evidence(lines, low, "prob", 8, 8, keys=["tile_id"]), "tile_id", "occlusion") == [(1, 0.0), (2, 1.0)]
    edges = spark.sql("SELECT t AS tile_id, 0L AS src, 1L AS dst, array(struct(1D AS x, 1D AS y), struct(3D AS x, 1D AS y)) AS geometry FROM VALUES (1L), (2L) v(t)")
    assert rows(tracing.edges_by_mean_prob(edges, raster, 1.5, ["tile_id"]), "tile_id", "src", "dst") == [(2, 0, 1)]


def test_betweenness_by_rounds_and_in_tasks(spark, some, monkeypatch):
    nodes, edges = nodes_of(spark, 40), frame(spark, some)
    want = rows(graph.betweenness(nodes, edges), "node_id", "betweenness")
    monkeypatch.setattr(graph, "ROUND_ROWS", 25 * 40)
    assert np.allclose(rows(graph.betweenness(nodes, edges, task_edges=0), "node_id", "betweenness"), want)


def test_current_flow_of_large_and_small_components(spark, some):
    nodes, edges = nodes_of(spark, 40), frame(spark, some)
    want = rows(graph.current_flow(nodes, edges), "node_id", "current_flow")
    for most in (0, 5):
        assert np.allclose(rows(graph.current_flow(nodes, edges, most_nodes=most), "node_id", "current_flow"), want)
