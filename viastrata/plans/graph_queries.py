"""Queries of road graphs: joins, parts, ways, repair, outages, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation, graph, healing, rasters, resilience, spatial
from . import fixtures as X
from .registry import query


def _pair(spark, d):
    return X.city_nodes(spark, d), X.city_edges(spark, d)


def _found(spark, d):
    return X.pred_nodes(spark, d), X.pred_edges(spark, d)


def _square_lines(spark, d):
    """Broken edges with their straight geometry."""
    e = rasters.with_ends(X.broken_edges(spark, d), X.city_nodes(spark, d))
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return e.withColumn("geometry", F.array(point("x0", "y0"), point("x1", "y1"))).drop("x0", "y0", "x1", "y1")


@query("SELECT a.node_id AS u, b.node_id AS v, round(sqrt((a.x - b.x)^2 + (a.y - b.y)^2), 6) AS distance FROM city_nodes a JOIN city_nodes b ON a.node_id < b.node_id AND (a.x - b.x)^2 + (a.y - b.y)^2 <= 2500")
def j01_radius_join(spark, d):
    return spatial.radius_pairs(X.city_nodes(spark, d), 50.0).withColumn("distance", F.round("distance", 6))


@query("SELECT node_id, match FROM snap_true")
def j02_nearest_join(spark, d):
    return spatial.nearest_within(X.city_nodes(spark, d), X.pred_nodes(spark, d), 15.0).select("node_id", "match")


@query("SELECT u, v, round(distance, 6) AS distance FROM near_broken")
def j03_across_components(spark, d):
    n, e = X.city_nodes(spark, d), X.broken_edges(spark, d)
    return healing.candidates(n, e).select("u", "v", F.round("distance", 6).alias("distance"))


@query("SELECT src, dst, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst")
def j04_edges_with_ends(spark, d):
    n, e = _pair(spark, d)
    return rasters.with_ends(e, n).select("src", "dst", "x0", "y0", "x1", "y1")


_SCORE = "(node_id * 37 % 101) / 100.0::DOUBLE"


@query(f"SELECT node_id, CASE WHEN node_id % 4 = 0 THEN 0.0 ELSE {_SCORE} END AS score FROM city_nodes")
def j05_left_default(spark, d):
    n = X.city_nodes(spark, d)
    known = _scores(n).where("node_id % 4 <> 0")
    return n.join(known, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _scores(nodes):
    return nodes.select("node_id", ((F.col("node_id") * 37 % 101) / 100.0).alias("score"))


@query("SELECT src, dst FROM city_edges WHERE src NOT IN (SELECT node_id FROM scenarios WHERE scenario = 'south') AND dst NOT IN (SELECT node_id FROM scenarios WHERE scenario = 'south')")
def j06_disable_nodes(spark, d):
    n, e = _pair(spark, d)
    return graph.without_nodes(n, e, X.scenarios(spark, d).where("scenario = 'south'"))[1].select("src", "dst")


@query("SELECT src, dst FROM city_edges WHERE (src, dst) NOT IN (SELECT src, dst FROM gaps) AND src % 10 <> 4 AND dst % 10 <> 4")
def j07_remove_edges_and_nodes(spark, d):
    n, e = _pair(spark, d)
    gone = X.gaps(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.without_nodes(n, graph.without_edges(e, gone), n.where("node_id % 10 = 4"))[1].select("src", "dst")


@query("SELECT src, dst FROM city_edges WHERE src % 10 >= 7 AND dst % 10 >= 7")
def j08_inner_edges(spark, d):
    n, e = _pair(spark, d)
    return graph.inner_edges(e, n.where("node_id % 10 >= 7")).select("src", "dst")


@query("SELECT src, dst FROM gaps")
def j09_boundary_edges(spark, d):
    n, e = _pair(spark, d)
    return graph.boundary_edges(e, n.where("node_id % 10 >= 7")).select("src", "dst")


#: An area with a notch, and a square.
RINGS = [[(35.0, 35.0), (185.0, 35.0), (185.0, 185.0), (110.0, 95.0), (35.0, 185.0)], [(205.0, 205.0), (265.0, 205.0), (265.0, 265.0), (205.0, 265.0)]]


def _ring_sql(rings) -> str:
    tests = []
    for ring in rings:
        crossings = []
        for (xi, yi), (xj, yj) in zip(ring, ring[1:] + ring[:1], strict=True):
            if yi != yj:
                crossings.append(f"CASE WHEN ({yi} > y) <> ({yj} > y) AND x < ({xj} - {xi})::DOUBLE * (y - {yi}) / ({yj} - {yi}) + {xi} THEN 1 ELSE 0 END")
        tests.append(f"({' + '.join(crossings)}) % 2 = 1")
    return " OR ".join(tests)


@query(f"SELECT node_id FROM city_nodes WHERE {_ring_sql(RINGS)}")
def j11_points_in_rings(spark, d):
    return spatial.points_in_rings(X.city_nodes(spark, d), RINGS).select("node_id")


@query("SELECT a.node_id AS origin, b.node_id AS dest FROM city_nodes a JOIN city_nodes b ON a.node_id < b.node_id")
def j12_all_pairs(spark, d):
    return evaluation.node_pairs(X.city_nodes(spark, d).select("node_id"))


@query(f"SELECT src, dst, greatest({_SCORE.replace('node_id', 'src')}, {_SCORE.replace('node_id', 'dst')}) AS score FROM city_edges")
def p18_edge_scores(spark, d):
    n, e = _pair(spark, d)
    return graph.edge_scores(e, _scores(n), "score").select("src", "dst", "score")


@query(f"SELECT src, dst, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.5 THEN 'high' WHEN s >= 0.25 THEN 'moderate' ELSE 'low' END AS tier FROM (SELECT src, dst, greatest({_SCORE.replace('node_id', 'src')}, {_SCORE.replace('node_id', 'dst')}) AS s FROM city_edges)")
def p19_edge_tiers(spark, d):
    return p18_edge_scores(spark, d).select("src", "dst", S.tier(F.col("score")).alias("tier"))


@query(f"SELECT node_id, round(score, 4) AS score, x, y FROM (SELECT node_id, {_SCORE} AS score, x, y FROM city_nodes) ORDER BY score DESC, node_id LIMIT 10")
def p22_report_top(spark, d):
    n = X.city_nodes(spark, d)
    return resilience.top_nodes(_scores(n).join(n, "node_id"), "score", 10).select("node_id", F.round("score", 4).alias("score"), "x", "y")


@query("SELECT src, dst, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst")
def v10_midpoints(spark, d):
    n, e = _pair(spark, d)
    return spatial.midpoints(e, n)


@query("SELECT node_id, component FROM parts_broken")
def g01_components(spark, d):
    return graph.components(X.city_nodes(spark, d), X.broken_edges(spark, d))


@query("SELECT origin, dest, round(dist, 6) AS dist FROM od_pairs LEFT JOIN sp_true ON source = origin AND node_id = dest")
def g02_pair_distances(spark, d):
    return graph.pair_distances(X.city_edges(spark, d), X.od_pairs(spark, d)).withColumn("dist", F.round("dist", 6))


@query("SELECT node_id, round(dist, 6) AS dist FROM sp_true WHERE source = 0")
def g03_single_source(spark, d):
    return graph.distances(X.city_edges(spark, d), spark.range(1).select(F.col("id").alias("source"))).select("node_id", F.round("dist", 6).alias("dist"))


@query("SELECT round(dist, 6) AS dist FROM sp_true, city_size WHERE source = 0 AND node_id = n - 1")
def g04_route_length(spark, d):
    way = graph.route(X.city_edges(spark, d), 0, X.node_count(spark, d) - 1)
    return way.agg(F.round(F.max("dist"), 6).alias("dist"))


@query()
def g04_route_nodes(spark, d):
    return graph.route(X.city_edges(spark, d), 0, X.node_count(spark, d) - 1)


@query("SELECT origin, dest, ca.component = cb.component AS connected FROM od_pairs JOIN parts_broken ca ON ca.node_id = origin JOIN parts_broken cb ON cb.node_id = dest")
def g05_reachable(spark, d):
    return graph.reachable(X.city_nodes(spark, d), X.broken_edges(spark, d), X.od_pairs(spark, d))


@query("SELECT node_id, degree FROM deg_broken")
def g06_degrees(spark, d):
    return graph.degrees(X.city_nodes(spark, d), X.broken_edges(spark, d))


@query("SELECT node_id FROM stub_broken")
def g07_stubs(spark, d):
    return graph.stubs(X.city_nodes(spark, d), X.broken_edges(spark, d))


@query("""WITH RECURSIVE c AS (SELECT u, v, distance, row_number() OVER (ORDER BY distance, u, v) AS k FROM told_broken WHERE reason IS NULL),
  step(k, label, added) AS (SELECT 0::BIGINT, (SELECT map(list(node_id ORDER BY node_id), list(component ORDER BY node_id)) FROM parts_broken), false
    UNION ALL SELECT c.k, CASE WHEN label[c.u] <> label[c.v] THEN map(map_keys(label), list_transform(map_values(label), lambda z: CASE WHEN z = greatest(label[c.u], label[c.v]) THEN least(label[c.u], label[c.v]) ELSE z END)) ELSE label END,
      label[c.u] <> label[c.v] FROM step JOIN c ON c.k = step.k + 1)
  SELECT u AS src, v AS dst, round(distance, 6) AS length FROM c JOIN step USING (k) WHERE added""")
def g09_heal(spark, d):
    bridges, _ = healing.heal(X.city_nodes(spark, d), X.broken_edges(spark, d), **_full_evidence(spark, d))
    return bridges.select("src", "dst", F.round("length", 6).alias("length"))


def _full_evidence(spark, d) -> dict:
    """A raster that supports every gap."""
    flat = spark.range(64).select(F.expr("cast(id div 8 as int)").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.lit(1.0).alias("conf"))
    return {"raster": flat, "height": 8, "width": 8}


@query("SELECT u, v, round(distance, 6) AS distance, round(180 * (1 - aligned), 6) AS angle_deviation, 1.0::DOUBLE AS occlusion, reason IS NULL AS passed, reason FROM told_broken")
def h09_heal_gate(spark, d):
    told = healing.candidates(X.city_nodes(spark, d), X.broken_edges(spark, d), **_full_evidence(spark, d))
    return told.select("u", "v", F.round("distance", 6).alias("distance"), F.round("angle_deviation", 6).alias("angle_deviation"), F.round("occlusion", 6).alias("occlusion"), "passed", "reason")


@query()
def h09_heal_gate_geometry(spark, d):
    return healing.candidates(X.city_nodes(spark, d), _square_lines(spark, d))


@query("SELECT u, v, round(CASE WHEN distance <= 15 THEN 1 ELSE greatest(0, 1 - distance / 40) END, 6) AS aligned FROM near_broken")
def h02_alignment(spark, d):
    near = healing.candidates(X.city_nodes(spark, d), X.broken_edges(spark, d))
    return near.select("u", "v", F.round(healing.alignment(F.col("distance")), 6).alias("aligned"))


@query("""WITH s AS (SELECT u AS node_id, v, length FROM sym WHERE (least(u, v), greatest(u, v)) IN (SELECT src, dst FROM broken_edges)),
  b AS (SELECT node_id, v, row_number() OVER (PARTITION BY node_id ORDER BY length DESC, v) AS k FROM s)
  SELECT n.node_id, round(coalesce(n.x + least(1, 40 / sqrt((m.x - n.x)^2 + (m.y - n.y)^2)) * (m.x - n.x), n.x), 5) AS px, round(coalesce(n.y + least(1, 40 / sqrt((m.x - n.x)^2 + (m.y - n.y)^2)) * (m.y - n.y), n.y), 5) AS py
  FROM city_nodes n LEFT JOIN b ON b.node_id = n.node_id AND k = 1 LEFT JOIN city_nodes m ON m.node_id = b.v""")
def h01_look_ahead(spark, d):
    found = healing.look_ahead(X.city_nodes(spark, d), _square_lines(spark, d))
    return found.select("node_id", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


# Samples of rasters, on every tile.


def _tiles(spark, d):
    return X.pixels(spark, d).select("tile_id").distinct()


_TILES = "(SELECT DISTINCT tile_id FROM pixels)"


def _tile_sql(points: str) -> str:
    """Values at points (tile_id, line's columns, k, m, r, c)."""
    return f"""SELECT v.tile_id, k, m, sum((CASE WHEN p.row = floor(r) THEN 1 - (r - floor(r)) ELSE r - floor(r) END) * (CASE WHEN p.col = floor(c) THEN 1 - (c - floor(c)) ELSE c - floor(c) END) * p.conf) AS conf
      FROM ({points}) v JOIN pixels p ON p.tile_id = v.tile_id AND p.row BETWEEN floor(r) AND floor(r) + 1 AND p.col BETWEEN floor(c) AND floor(c) + 1 GROUP BY 1, 2, 3"""


@query(f"SELECT tile_id, k, round(conf, 5) AS conf FROM ({_tile_sql(f'SELECT tile_id, i AS k, 0 AS m, 0.3::DOUBLE + i * 0.9::DOUBLE AS r, 6.6::DOUBLE - i * 0.7::DOUBLE AS c FROM {_TILES}, range(8) t(i)')})")
def h04_bilinear(spark, d):
    points = _tiles(spark, d).join(spark.range(8).select(F.col("id").alias("k"), (0.3 + F.col("id") * 0.9).alias("row"), (6.6 - F.col("id") * 0.7).alias("col")), how="cross")
    return healing.bilinear(points, X.pixels(spark, d), "conf", 8, 8, ["tile_id"]).select("tile_id", "k", F.round("conf", 5).alias("conf"))


#: A line of each tile, that no two neighbouring tiles share.
_TILE_LINE = f"SELECT tile_id, 0.6::DOUBLE + tile_id % 3 * 0.25 AS x0, 1.2::DOUBLE AS y0, 5.9::DOUBLE AS x1, 6.1::DOUBLE - tile_id % 5 * 0.25 AS y1 FROM {_TILES}"


def _tile_lines(spark, d):
    t = F.col("tile_id")
    return _tiles(spark, d).select("tile_id", (0.6 + t % 3 * 0.25).alias("x0"), F.lit(1.2).alias("y0"), F.lit(5.9).alias("x1"), (6.1 - t % 5 * 0.25).alias("y1"))


def _tile_corridor_sql(n: int, across: int, half_width: float) -> str:
    side = f"(j * 2.0::DOUBLE / {max(across - 1, 1)} - {int(across > 1)}) * {half_width} / sqrt((x1 - x0)^2 + (y1 - y0)^2)"
    points = f"""SELECT tile_id, i AS k, j AS m, greatest(0, least(7, y0 + (y1 - y0) * i / {n - 1} + {side} * (x1 - x0))) AS r,
      greatest(0, least(7, x0 + (x1 - x0) * i / {n - 1} - {side} * (y1 - y0))) AS c FROM ({_TILE_LINE}), range({n}) t(i), range({across}) u(j)"""
    return _tile_sql(points)


@query(f"SELECT tile_id, k, round(conf, 5) AS conf FROM ({_tile_corridor_sql(10, 1, 0.0)})")
def h05_line_samples(spark, d):
    at = healing.line_samples(_tile_lines(spark, d), 10).withColumn("row", F.col("wy")).withColumn("col", F.col("wx"))
    return healing.bilinear(at, X.pixels(spark, d), "conf", 8, 8, ["tile_id"]).select("tile_id", F.col("k").cast("long").alias("k"), F.round("conf", 5).alias("conf"))


def _corridor_tiles(spark, d, reduce):
    found = healing.corridor(_tile_lines(spark, d), X.pixels(spark, d), "conf", 8, 8, n=8, across=3, half_width=1.0, reduce=reduce, keys=["tile_id"])
    return found.select("tile_id", F.col("k").cast("long").alias("k"), F.round("conf", 5).alias("conf"))


@query(f"SELECT tile_id, k, round(max(conf), 5) AS conf FROM ({_tile_corridor_sql(8, 3, 1.0)}) GROUP BY 1, 2")
def h06_corridor_max(spark, d):
    return _corridor_tiles(spark, d, "max")


@query(f"SELECT tile_id, k, round(median(conf), 5) AS conf FROM ({_tile_corridor_sql(8, 3, 1.0)}) GROUP BY 1, 2")
def h07_corridor_median(spark, d):
    return _corridor_tiles(spark, d, "median")


@query(f"SELECT tile_id, round(avg((conf >= 0.3)::INTEGER), 6) AS occlusion FROM (SELECT tile_id, k, median(conf) AS conf FROM ({_tile_corridor_sql(8, 3, 2.0)}) GROUP BY 1, 2) GROUP BY 1")
def h08_evidence(spark, d):
    return healing.evidence(_tile_lines(spark, d), X.pixels(spark, d), "conf", 8, 8, keys=["tile_id"]).select("tile_id", F.round("occlusion", 6).alias("occlusion"))


@query("SELECT coalesce(reason, 'unknown') AS reason, count(*) AS n FROM told_broken WHERE reason IS NOT NULL GROUP BY 1")
def a01_reasons(spark, d):
    considered = healing.candidates(X.city_nodes(spark, d), X.broken_edges(spark, d), **_full_evidence(spark, d)).withColumn("added", F.col("passed"))
    return healing.tally(considered)


@query("""WITH b AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM pred_edges), t AS (SELECT src AS a, dst AS b FROM city_edges WHERE bridge OR src % 3 = 0)
  SELECT (SELECT count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM t)) AS tp, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM t)) AS fp, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM b)) AS fn""")
def u05_against_truth(spark, d):
    truth = X.city_edges(spark, d).where("bridge or src % 3 = 0")
    return healing.against_truth(X.pred_edges(spark, d), truth).select("tp", "fp", "fn")


@query("""WITH RECURSIVE k0 AS (SELECT node_id FROM city_nodes), a(r, gone) AS (SELECT 0, []::BIGINT[] UNION ALL
    SELECT r + 1, list_distinct(gone || (SELECT coalesce(list(node_id), []) FROM (SELECT node_id, count(s.v) AS d FROM city_nodes LEFT JOIN sym s ON s.u = node_id AND NOT list_contains(gone, s.v) WHERE NOT list_contains(gone, node_id) GROUP BY 1) WHERE d < 2)) FROM a WHERE r < 60),
  b(r, gone) AS (SELECT 0, (SELECT gone FROM a WHERE r = 60) UNION ALL
    SELECT r + 1, list_distinct(gone || (SELECT coalesce(list(node_id), []) FROM (SELECT node_id, count(s.v) AS d FROM city_nodes LEFT JOIN sym s ON s.u = node_id AND NOT list_contains(gone, s.v) WHERE NOT list_contains(gone, node_id) GROUP BY 1) WHERE d < 3)) FROM b WHERE r < 60)
  SELECT node_id, (CASE WHEN list_contains((SELECT gone FROM a WHERE r = 60), node_id) THEN CASE WHEN EXISTS (SELECT 1 FROM sym WHERE u = node_id) THEN 1 ELSE 0 END
                        WHEN list_contains((SELECT gone FROM b WHERE r = 60), node_id) THEN 2 ELSE 3 END)::BIGINT AS core FROM city_nodes""")
def g11_k_core(spark, d):
    return graph.k_core(*_pair(spark, d))


_ALPHA = ["x0 AS (SELECT node_id, 1.0::DOUBLE AS x FROM city_nodes)"] + [
    f"x{k + 1} AS (SELECT n.node_id, 1 + 0.1::DOUBLE * coalesce(sum(p.x), 0) AS x FROM city_nodes n LEFT JOIN sym s ON s.u = n.node_id LEFT JOIN x{k} p ON p.node_id = s.v GROUP BY 1)" for k in range(30)
]


@query(f"WITH {', '.join(_ALPHA)} SELECT node_id, round(x, 6) AS alpha FROM x30")
def g13_alpha(spark, d):
    return graph.alpha_centrality(*_pair(spark, d)).select("node_id", F.round("alpha", 6).alias("alpha"))


@query()
def g10_betweenness(spark, d):
    return graph.betweenness(*_pair(spark, d))


@query()
def g12_current_flow(spark, d):
    return graph.current_flow(*_pair(spark, d))


@query("""WITH m AS (SELECT node_id, (node_id * 7 % 11)::DOUBLE AS a, (node_id % 3)::DOUBLE AS b, (node_id * 13 % 29)::DOUBLE AS c, 1.0::DOUBLE AS e FROM city_nodes),
  r AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM m)
  SELECT node_id, round((CASE WHEN a1 > a0 THEN (a - a0) / (a1 - a0) ELSE 0 END + CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END + CASE WHEN c1 > c0 THEN (c - c0) / (c1 - c0) ELSE 0 END + 0) / 4, 6) AS composite FROM m, r""")
def g14_composite(spark, d):
    n = F.col("node_id")
    m = X.city_nodes(spark, d).select("node_id", (n * 7 % 11).cast("double").alias("betweenness"), (n % 3).cast("double").alias("core"), (n * 13 % 29).cast("double").alias("current_flow"), F.lit(1.0).alias("alpha"))
    return graph.composite(graph.min_max(m, list(graph.MEASURES))).select("node_id", F.round("composite", 6).alias("composite"))


@query()
def g14_criticality(spark, d):
    return graph.criticality(*_pair(spark, d))


@query("SELECT src, dst, min(length) AS length FROM (SELECT least(u, v) AS src, greatest(u, v) AS dst, length + (u % 7) AS length FROM sym) GROUP BY 1, 2")
def g17_parallel_edges(spark, d):
    both = graph.symmetric(X.city_edges(spark, d), "length").select(F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("length") + F.col("u") % 7).alias("length"))
    return graph.canonical(both).select("src", "dst", "length")


@query("WITH RECURSIVE h AS (SELECT 0::BIGINT AS node_id, 0 AS hops UNION SELECT s.v, hops + 1 FROM h JOIN sym s ON s.u = h.node_id WHERE hops < 4) SELECT node_id FROM (SELECT node_id, min(hops) AS hops FROM h GROUP BY 1) ORDER BY hops, node_id LIMIT 4")
def g18_cluster(spark, d):
    return graph.cluster(*_pair(spark, d), 0, 4)


@query("SELECT count(*) AS n_edges, round(sum(length), 6) AS total FROM city_edges")
def g20_fingerprint(spark, d):
    return graph.fingerprint(X.city_edges(spark, d)).select("n_edges", "total")


@query("SELECT src AS old_src, dst AS old_dst, src AS src, dst AS dst FROM city_edges")
def w04_relabel(spark, d):
    n, e = _pair(spark, d)
    gap = lambda c: F.col(c) * 3 + 5
    moved = graph.relabel(n.withColumn("node_id", gap("node_id")), e.select(F.col("src").alias("old_src"), F.col("dst").alias("old_dst"), gap("src").alias("src"), gap("dst").alias("dst")))[1]
    return moved.select("old_src", "old_dst", "src", "dst")


@query(f"SELECT row_number() OVER (ORDER BY {_SCORE} DESC, node_id) AS rank, node_id, {_SCORE} AS score FROM city_nodes")
def w01_rank(spark, d):
    return resilience.ranked_nodes(_scores(X.city_nodes(spark, d)), "score")


@query(f"SELECT node_id, {_SCORE} AS score FROM city_nodes ORDER BY 2 DESC, 1 LIMIT 5")
def w02_top_k(spark, d):
    return resilience.top_nodes(_scores(X.city_nodes(spark, d)), "score", 5)


@query("SELECT u, v, round(distance, 6) AS distance FROM told_broken WHERE reason IS NULL ORDER BY distance, u, v")
def w05_sorted_candidates(spark, d):
    told = healing.candidates(X.city_nodes(spark, d), X.broken_edges(spark, d), **_full_evidence(spark, d))
    return told.where("passed").orderBy("distance", "u", "v").select("u", "v", F.round("distance", 6).alias("distance"))


@query("WITH r AS (SELECT node_id, dist, max(dist) OVER () AS m FROM sp_true WHERE source = 0) SELECT s AS step, count(*) AS n FROM r, range(1, 9) t(s) WHERE dist <= m * s / 8 GROUP BY 1")
def w06_flood_steps(spark, d):
    return resilience.flood_steps(X.city_edges(spark, d), 0, 8).groupBy(F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"))


_LCC = "SELECT scenario, max(n) AS lcc_size FROM (SELECT scenario, component, count(*) AS n FROM parts_left GROUP BY 1, 2) GROUP BY 1"


@query(f"SELECT scenario, lcc_size, round(lcc_size / n, 6) AS lcc_fraction FROM ({_LCC}), city_size")
def a11_largest_part(spark, d):
    n, e = _pair(spark, d)
    left, roads = resilience.surviving(n, e, X.scenarios(spark, d))
    return resilience.largest_part(graph.components(left, roads, ["scenario"]), n.count(), ["scenario"]).withColumn("lcc_fraction", F.round("lcc_fraction", 6))


_PEOPLE = """SELECT scenario, (SELECT sum(population) FROM city_nodes)::BIGINT AS total, coalesce(main, 0)::BIGINT AS main, ((SELECT sum(population) FROM city_nodes) - coalesce(main, 0))::BIGINT AS isolated
  FROM (SELECT DISTINCT scenario FROM scenarios) LEFT JOIN (SELECT scenario, main, k FROM (
  SELECT scenario, people AS main, row_number() OVER (PARTITION BY scenario ORDER BY n DESC, component) AS k FROM (SELECT scenario, component, count(*) AS n, sum(population) AS people FROM parts_left JOIN left_nodes USING (scenario, node_id) GROUP BY 1, 2)) WHERE k = 1) USING (scenario)"""


@query(_PEOPLE)
def a12_population_impact(spark, d):
    n, e = _pair(spark, d)
    s = X.scenarios(spark, d)
    left, roads = resilience.surviving(n, e, s)
    return resilience.population_impact(n, graph.components(left, roads, ["scenario"]), s)


_INDEX = """SELECT scenario, round(avg(CASE WHEN base IS NULL THEN 1 WHEN perturbed IS NULL THEN 0 WHEN perturbed <= base THEN 1 ELSE base / perturbed END), 6) AS index,
  count(*) FILTER (base IS NOT NULL AND perturbed IS NULL) AS cut_off, count(*) FILTER (base IS NOT NULL AND perturbed > base) AS degraded,
  count(*) FILTER (base IS NULL OR perturbed <= base) AS unaffected FROM deltas GROUP BY 1"""


@query(_INDEX)
def d03_resilience_index(spark, d):
    n, e = _pair(spark, d)
    s = X.scenarios(spark, d)
    _, roads = resilience.surviving(n, e, s)
    deltas = resilience.path_deltas(e, roads, X.od_pairs(spark, d), s, s)
    return resilience.resilience_index(deltas, ["scenario"]).select("scenario", F.round("index", 6).alias("index"), "cut_off", "degraded", "unaffected")


_SIMULATED = f"""SELECT scenario, coalesce(lcc_size, 0) AS lcc_size, round(coalesce(lcc_size, 0) / n, 6) AS lcc_fraction, total, main, isolated, unreachable, index, cut_off, degraded, unaffected
  FROM ({_PEOPLE}) LEFT JOIN ({_LCC}) USING (scenario) JOIN ({_INDEX}) USING (scenario)
  JOIN (SELECT scenario, count(*) FILTER (perturbed IS NULL) AS unreachable FROM deltas GROUP BY 1) USING (scenario), city_size"""


def _simulated(spark, d):
    n, e = _pair(spark, d)
    return resilience.simulate(n, e, X.scenarios(spark, d), X.od_pairs(spark, d))


@query(_SIMULATED)
def d02_run_scenarios(spark, d):
    return _simulated(spark, d).withColumn("lcc_fraction", F.round("lcc_fraction", 6)).withColumn("index", F.round("index", 6))


@query(f"SELECT scenario, index FROM ({_INDEX}) ORDER BY 2, 1")
def w03_rank_scenarios(spark, d):
    return resilience.ranked(d03_resilience_index(spark, d).select("scenario", "index"))


@query(f"SELECT scenario, round(index, 4) AS index FROM ({_INDEX.replace(', 6) AS index', ', 12) AS index')}) UNION ALL SELECT 'nothing', NULL")
def d04_scenario_records(spark, d):
    n, e = _pair(spark, d)
    s = X.scenarios(spark, d)
    _, roads = resilience.surviving(n, e, s)
    index = resilience.resilience_index(resilience.path_deltas(e, roads, X.od_pairs(spark, d), s, s), ["scenario"])
    empty = spark.createDataFrame([("nothing",)], "scenario string")
    return resilience.record(index.select("scenario", "index"), empty)


@query(f"""WITH s AS (SELECT node_id, {_SCORE} AS score FROM city_nodes) SELECT scenario, node_id FROM (
  SELECT 'top_1' AS scenario, node_id FROM (SELECT node_id FROM s ORDER BY score DESC, node_id LIMIT 1) UNION ALL SELECT 'top_5', node_id FROM (SELECT node_id FROM s ORDER BY score DESC, node_id LIMIT 5)
  UNION ALL SELECT 'random_10pct', node_id FROM (SELECT node_id, row_number() OVER (ORDER BY md5('0' || node_id::VARCHAR), node_id) AS k FROM city_nodes), city_size WHERE k <= greatest(1, round_even(0.1 * n, 0))
  UNION ALL SELECT 'flood', node_id FROM city_nodes WHERE {_ring_sql(RINGS)})""")
def d05_default_scenarios(spark, d):
    n = X.city_nodes(spark, d)
    return resilience.default_scenarios(n, _scores(n), "score", flood=RINGS)


@query(f"""WITH f AS (SELECT node_id FROM city_nodes WHERE {_ring_sql(RINGS)}), n1 AS (SELECT node_id FROM city_nodes WHERE node_id NOT IN (SELECT node_id FROM f)),
  s1 AS (SELECT u, v FROM sym WHERE u IN (SELECT node_id FROM n1) AND v IN (SELECT node_id FROM n1)),
  q AS (SELECT node_id AS a, node_id AS b FROM n1 UNION SELECT q.a, s1.v FROM q JOIN s1 ON s1.u = q.b), c AS (SELECT a, min(b) AS c FROM q GROUP BY 1)
  SELECT 'flood' AS scenario, max(n) AS lcc_size FROM (SELECT c, count(*) AS n FROM c GROUP BY 1) HAVING (SELECT count(*) FROM f) > 0""")
def d06_flood_scenario(spark, d):
    n, e = _pair(spark, d)
    flooded = spatial.points_in_rings(n, RINGS).select(F.lit("flood").alias("scenario"), "node_id")
    return resilience.simulate(n, e, flooded, X.od_pairs(spark, d)).select("scenario", "lcc_size")


@query("""SELECT p.scenario, total, main, isolated, n_parts FROM (SELECT scenario, main * 2 AS main, total * 2 AS total, isolated * 2 AS isolated FROM (""" + _PEOPLE.replace("population", "(node_id % 5 + 1)").replace("sum((node_id % 5 + 1)) FROM city_nodes", "sum(node_id % 5 + 1) FROM city_nodes") + """)) p
  LEFT JOIN (SELECT scenario, count(DISTINCT component) AS n_parts FROM parts_left GROUP BY 1) USING (scenario)""")
def d07_service_impact(spark, d):
    n, e = _pair(spark, d)
    homes = n.select(F.explode(F.array(F.lit(-4.0), F.lit(6.0))).alias("dx"), "*").select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + 3).alias("y"), (F.col("node_id") % 5 + 1).alias("people"))
    found = resilience.service_impact(homes, n, e, X.scenarios(spark, d), 12.0)
    return found.select("scenario", "total", "main", "isolated", "n_parts")


@query(f"SELECT scenario, lcc_size, index FROM ({_SIMULATED}) WHERE scenario IN ('column', 'south')")
def d08_scenario_set(spark, d):
    n, e = _pair(spark, d)
    chosen = X.scenarios(spark, d).where("scenario in ('column', 'south')")
    return resilience.simulate(n, e, chosen, X.od_pairs(spark, d)).select("scenario", "lcc_size", F.round("index", 6).alias("index"))


@query("""SELECT round(lcc_size / n, 6) AS lcc_fraction, unreachable, round(b.dist, 6) AS before, round(a.dist, 6) AS after, round((a.dist - b.dist) / b.dist * 100, 6) AS delta_percent
  FROM (SELECT * FROM (""" + _LCC + """) WHERE scenario = 'single'), city_size, (SELECT count(*) FILTER (perturbed IS NULL) AS unreachable FROM deltas WHERE scenario = 'single')
  JOIN (SELECT dist FROM sp_true, city_size WHERE source = 0 AND node_id = n - 1) b ON true LEFT JOIN (SELECT dist FROM sp_left, city_size WHERE scenario = 'single' AND source = 0 AND node_id = n - 1) a ON true""")
def d09_disruption(spark, d):
    n, e = _pair(spark, d)
    broken = X.scenarios(spark, d).where("scenario = 'single'").select("node_id")
    none = X.gaps(spark, d).where("false")
    found = resilience.disruption(n, e, broken, none, 0, X.node_count(spark, d) - 1, X.od_pairs(spark, d))
    return found.select(F.round("lcc_fraction", 6).alias("lcc_fraction"), "unreachable", *(F.round(c, 6).alias(c) for c in ("before", "after", "delta_percent")))


@query("SELECT scenario, origin, dest, round((perturbed - base) / base * 100, 6) AS delta FROM deltas")
def d10_route_delta(spark, d):
    n, e = _pair(spark, d)
    s = X.scenarios(spark, d)
    _, roads = resilience.surviving(n, e, s)
    deltas = resilience.path_deltas(e, roads, X.od_pairs(spark, d), s, s)
    return deltas.select("scenario", "origin", "dest", F.round(resilience.delta_percent(F.col("base"), F.col("perturbed")), 6).alias("delta"))


@query("SELECT scenario, count(*) FILTER (perturbed IS NULL) AS unreachable FROM deltas GROUP BY 1")
def d11_unreachable(spark, d):
    n, e = _pair(spark, d)
    s = X.scenarios(spark, d)
    left, roads = resilience.surviving(n, e, s)
    asked = s.select("scenario").distinct().join(X.od_pairs(spark, d), how="cross")
    return graph.reachable(left, roads, asked, ["scenario"]).groupBy("scenario").agg(F.count_if(~F.col("connected")).alias("unreachable"))


_DENSITY = f"""WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, sqrt((max(x) - min(x))^2 + (max(y) - min(y))^2) AS dg FROM city_nodes),
  g AS (SELECT i, j, x0 - dg * 0.12::DOUBLE + j * ((x1 - x0 + 2 * dg * 0.12::DOUBLE) / 29) AS gx, y0 - dg * 0.12::DOUBLE + i * ((y1 - y0 + 2 * dg * 0.12::DOUBLE) / 29) AS gy, dg FROM b, range(30) t(i), range(30) u(j)),
  v AS (SELECT i, j, sum(WEIGHT * exp(-((gx - x)^2 + (gy - y)^2) / (2 * (dg * SIGMA::DOUBLE)^2))) AS v FROM g, city_nodes GROUP BY 1, 2)
  SELECT i::INTEGER AS i, j::INTEGER AS j, round(v / max(v) OVER (), 5) AS intensity FROM v"""


@query(_DENSITY.replace("WEIGHT", _SCORE).replace("SIGMA", "0.05"))
def d12_density(spark, d):
    n = X.city_nodes(spark, d)
    return spatial.density(n.join(_scores(n), "node_id"), "score", steps=30).withColumn("intensity", F.round("intensity", 5))


@query(_DENSITY.replace("WEIGHT", "(y < 90)::INTEGER").replace("SIGMA", "0.075"))
def d12_flood_density(spark, d):
    n = X.city_nodes(spark, d).withColumn("wet", (F.col("y") < 90).cast("double"))
    return spatial.density(n, "wet", steps=30, sigma=0.075).withColumn("intensity", F.round("intensity", 5))


@query("""WITH e AS (SELECT node_id, row_number() OVER (ORDER BY md5('0' || node_id::VARCHAR), node_id) - 1 AS k FROM
   (SELECT node_id, degree, count(*) FILTER (degree = 1) OVER () AS ends FROM deg_broken) WHERE degree = 1 OR ends < 4)
  SELECT a.node_id AS origin, b.node_id AS dest FROM e a JOIN e b ON b.k = a.k + 1 WHERE a.k % 2 = 0 AND a.k < 80""")
def d01_sample_pairs(spark, d):
    return resilience.sample_pairs(X.city_nodes(spark, d), X.broken_edges(spark, d))


@query("SELECT round(score, 6) AS score, n FROM apls_there_t")
def m01_apls_one_way(spark, d):
    n, e = _pair(spark, d)
    pn, pe = _found(spark, d)
    return evaluation.apls_one_way(n, e, pe, evaluation.snapped(n, pn)).select(F.round("score", 6).alias("score"), "n")


@query("SELECT round((a.score * a.n + b.score * b.n) / (a.n + b.n), 6) AS apls, round(a.score, 6) AS there, round(b.score, 6) AS back FROM apls_there_t a, apls_back_t b")
def m02_apls(spark, d):
    found = evaluation.apls(*_pair(spark, d), *_found(spark, d), most=None)
    return found.select(F.round("apls", 6).alias("apls"), F.round("apls_there", 6).alias("there"), F.round("apls_back", 6).alias("back"))


@query("SELECT count(*) FILTER (NOT joined) AS breaks, round(sum(length) / 1000, 6) AS km, round(count(*) FILTER (NOT joined) / (sum(length) / 1000), 6) AS breaks_per_km FROM joined_true")
def m03_breaks(spark, d):
    f = evaluation.breaks_per_km(*_pair(spark, d), *_found(spark, d))
    return f.select("breaks", F.round("km", 6).alias("km"), F.round("breaks_per_km", 6).alias("breaks_per_km"))


_CONNECT = """WITH p AS (SELECT a.node_id AS o, b.node_id AS t, ta.component = tb.component AS here, coalesce(ca.component = cb.component, false) AS there FROM city_nodes a JOIN city_nodes b ON a.node_id < b.node_id
    JOIN parts_true ta ON ta.node_id = a.node_id JOIN parts_true tb ON tb.node_id = b.node_id LEFT JOIN snap_true ma ON ma.node_id = a.node_id LEFT JOIN snap_true mb ON mb.node_id = b.node_id
    LEFT JOIN parts_pred ca ON ca.node_id = ma.match LEFT JOIN parts_pred cb ON cb.node_id = mb.match)
  SELECT count(*) AS n_pairs, count(*) FILTER (here AND there) AS n_reachable, round(count(*) FILTER (here AND there) / count(*), 6) AS ratio FROM p"""


@query(_CONNECT)
def m04_connectivity(spark, d):
    return evaluation.connectivity(*_pair(spark, d), *_found(spark, d), most=None).withColumn("ratio", F.round("ratio", 6))


_CCQ = """SELECT a.m / a.t AS completeness, b.m / b.t AS correctness, a.m / (a.t + b.t - a.m) AS quality FROM (SELECT coalesce(sum(length) FILTER (joined), 0) AS m, sum(length) AS t FROM joined_true) a,
  (SELECT coalesce(sum(length) FILTER (joined), 0) AS m, sum(length) AS t FROM joined_pred) b"""


@query(f"SELECT round(completeness, 6) AS completeness, round(correctness, 6) AS correctness, round(quality, 6) AS quality FROM ({_CCQ})")
def m05_ccq(spark, d):
    return evaluation.ccq(*_pair(spark, d), *_found(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("completeness", "correctness", "quality")))


@query(f"""SELECT round((a.score * a.n + b.score * b.n) / (a.n + b.n), 4) AS apls, round(a.score, 4) AS apls_there, round(b.score, 4) AS apls_back, j.breaks, round(j.km, 3) AS km, round(j.breaks / j.km, 4) AS breaks_per_km,
   round(c.ratio, 4) AS ratio, c.n_pairs, round(q.completeness, 4) AS completeness, round(q.correctness, 4) AS correctness, round(q.quality, 4) AS quality
  FROM apls_there_t a, apls_back_t b, (SELECT count(*) FILTER (NOT joined) AS breaks, sum(length) / 1000 AS km FROM joined_true) j, ({_CONNECT.replace(', 6) AS ratio', ', 12) AS ratio')}) c, ({_CCQ}) q""")
def m06_report(spark, d):
    return evaluation.report(*_pair(spark, d), *_found(spark, d), most=None)
