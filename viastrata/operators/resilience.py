"""What a road graph does when nodes or edges fail: parts, people, ways; all scenarios in one job."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cluster import checkpoint, few, rank_within
from . import graph, spatial


def surviving(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each scenario's graph (scenario, …), from (scenario, node_id) of what fails; names: the scenarios, if
    known."""
    names = few(checkpoint(scenarios.select("scenario").distinct()) if names is None else names)
    # Other names, as the frames come from one.
    gone = scenarios.select(F.col("scenario").alias("_s"), F.col("node_id").alias("_gone")).distinct()
    fails = lambda frame, end: frame.join(gone, (F.col("_gone") == F.col(end)) & (F.col("_s") == F.col("scenario")), "left_anti")
    e = fails(fails(edges.join(names, how="cross"), "src"), "dst")
    return fails(nodes.join(names, how="cross"), "node_id"), e


def largest_part(parts: DataFrame, whole: int, keys: list[str]) -> DataFrame:
    """(keys, lcc_size, lcc_fraction) of (keys, node_id, component), as a share of the `whole` number of nodes."""
    sizes = parts.groupBy(*keys, "component").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("lcc_size"))
    return sizes.withColumn("lcc_fraction", F.col("lcc_size") / whole if whole else F.lit(0.0))


def population_impact(nodes: DataFrame, parts: DataFrame, names: DataFrame, population: str = "population") -> DataFrame:
    """(scenario, total, main, isolated): people in all nodes, in the largest surviving part (of equals the one of least id),
    and in all other nodes, failed ones among them."""
    total = nodes.agg(F.sum(population).alias("total"))
    held = parts.join(nodes.select("node_id", population), "node_id").groupBy("scenario", "component").agg(F.count("*").alias("n"), F.sum(population).alias("people"))
    main = held.groupBy("scenario").agg(F.max_by("people", F.struct("n", -F.col("component"))).alias("main"))
    every = names.select("scenario").distinct().join(F.broadcast(total), how="cross").join(main, "scenario", "left")
    every = every.withColumn("main", F.coalesce("main", F.lit(0)).cast("long"))
    return every.select("scenario", F.col("total").cast("long").alias("total"), "main", (F.col("total") - F.col("main")).cast("long").alias("isolated"))


def path_deltas(edges: DataFrame, after: DataFrame, od: DataFrame, names: DataFrame, failed: DataFrame) -> DataFrame:
    """(scenario, origin, dest, base, perturbed): lengths before and after; null where there is no way or an end has failed."""
    base = checkpoint(graph.pair_distances(edges, od).withColumnRenamed("dist", "base"))
    asked = names.select("scenario").distinct().join(base, how="cross")
    for end in ("origin", "dest"):
        f = failed.select(F.col("scenario").alias("_s"), F.col("node_id").alias("_n"), F.lit(True).alias(f"_{end}")).distinct()
        asked = asked.join(f, (F.col("_s") == F.col("scenario")) & (F.col("_n") == F.col(end)), "left").drop("_s", "_n")
    asked = checkpoint(asked)
    whole = asked.where("_origin is null and _dest is null").select("scenario", "origin", "dest")
    found = graph.pair_distances(after, whole, ["scenario"]).withColumnRenamed("dist", "perturbed")
    return asked.drop("_origin", "_dest").join(found, ["scenario", "origin", "dest"], "left")


def pair_score(base, perturbed):
    """1 where there was no way before, 0 where there is none any more, else how much of the way's shortness is left."""
    return F.when(base.isNull(), F.lit(1.0)).when(perturbed.isNull(), F.lit(0.0)).when(perturbed <= base, F.lit(1.0)).otherwise(base / perturbed)


def resilience_index(deltas: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, index, cut_off, degraded, unaffected, n) of (keys, base, perturbed); index is null without pairs."""
    score = pair_score(F.col("base"), F.col("perturbed"))
    scored = deltas.withColumn("score", score)
    cut = F.col("base").isNotNull() & F.col("perturbed").isNull()
    worse = F.col("base").isNotNull() & (F.col("perturbed") > F.col("base"))
    return scored.groupBy(*(keys or [])).agg(
        F.avg("score").alias("index"), F.count_if(cut).alias("cut_off"), F.count_if(worse).alias("degraded"), F.count_if(~cut & ~F.coalesce(worse, F.lit(False))).alias("unaffected"), F.count("*").alias("n")
    )


def simulate(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, od: DataFrame, population: str = "population") -> DataFrame:
    """One row for each scenario: largest part, people, ways lost, resilience index."""
    whole = nodes.count()
    scenarios, od = checkpoint(scenarios.select("scenario", "node_id")), checkpoint(od)
    names = checkpoint(scenarios.select("scenario").distinct())
    left, roads = surviving(nodes, edges, scenarios, names)
    left, roads = checkpoint(left), checkpoint(roads)
    parts = checkpoint(graph.components(left, roads, ["scenario"]))
    people = population_impact(nodes, parts, names, population)
    index = resilience_index(path_deltas(edges, roads, od, names, scenarios), ["scenario"])
    lcc = largest_part(parts, whole, ["scenario"])
    unreachable = graph.reachable(left, roads, names.join(od, how="cross"), ["scenario"]).groupBy("scenario").agg(F.count_if(~F.col("connected")).alias("unreachable"))
    out = names.join(lcc, "scenario", "left").join(people, "scenario").join(index, "scenario", "left").join(unreachable, "scenario", "left")
    return out.select(
        "scenario", F.coalesce("lcc_size", F.lit(0)).cast("long").alias("lcc_size"), F.coalesce("lcc_fraction", F.lit(0.0)).alias("lcc_fraction"), "total", "main", "isolated",
        F.coalesce("unreachable", F.lit(0)).alias("unreachable"), "index", "cut_off", "degraded", "unaffected",
    )


def ranked(results: DataFrame) -> DataFrame:
    return results.orderBy("index", "scenario")


def ranked_nodes(scores: DataFrame, score: str) -> DataFrame:
    """(rank, node_id, score) from the greatest on; ids settle ties."""
    return rank_within(scores.select(F.lit(0).alias("_all"), "node_id", score), ["_all"], [F.desc(score), F.asc("node_id")], "rank").select("rank", "node_id", score)


def top_nodes(scores: DataFrame, score: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(score), "node_id").limit(k)


def default_scenarios(nodes: DataFrame, scores: DataFrame, score: str = "composite", share: float = 0.1, seed: str = "0", flood: list[list[tuple[float, float]]] | None = None) -> DataFrame:
    """(scenario, node_id): the most critical node, the five most critical, a seeded share of all, and what a flood covers."""
    n = nodes.count()
    parts = [top_nodes(scores, score, k).select(F.lit(f"top_{k}").alias("scenario"), "node_id") for k in (1, 5)]
    order = F.md5(F.concat(F.lit(seed), F.col("node_id").cast("string")).cast("binary"))
    some = nodes.select("node_id").orderBy(order, "node_id").limit(max(1, round(share * n)))
    parts.append(some.select(F.lit(f"random_{round(share * 100)}pct").alias("scenario"), "node_id"))
    if flood:
        parts.append(spatial.points_in_rings(nodes, flood).select(F.lit("flood").alias("scenario"), "node_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_pairs(nodes: DataFrame, edges: DataFrame, most: int = 40, seed: str = "0") -> DataFrame:
    """(origin, dest): of four dead ends or more, neighbours in a seeded order of these; else of all nodes, likewise, as often
    as needed. At most `most` pairs, so at most twice as many ids are ordered last."""
    degree = checkpoint(graph.degrees(nodes, edges))
    ends = degree.where("degree = 1")
    pool = ends if ends.limit(4).count() == 4 else degree
    order = F.md5(F.concat(F.lit(seed), F.col("node_id").cast("string")).cast("binary"))
    first = pool.select("node_id", order.alias("h")).orderBy("h", "node_id").limit(2 * most)
    k = F.row_number().over(Window.orderBy("h", "node_id")) - 1
    placed = first.select("node_id", k.alias("k"))
    a, b = placed.where("k % 2 = 0").select(F.col("node_id").alias("origin"), F.expr("k div 2").alias("pair")), placed.where("k % 2 = 1").select(F.col("node_id").alias("dest"), F.expr("k div 2").alias("pair"))
    return a.join(b, "pair").select("origin", "dest")


def sample_pairs_exact(spark: SparkSession, endpoints: list[int], most: int = 40, seed: int = 0) -> DataFrame:
    """Pairs of a short list of dead ends in the order that Python's generator shuffles them."""
    ids = sorted(endpoints)
    random.Random(seed).shuffle(ids)
    return spark.createDataFrame(list(zip(ids[0::2], ids[1::2], strict=False))[:most], "origin long, dest long")


def flood_steps(edges: DataFrame, origin: int, steps: int = 8) -> DataFrame:
    """(step, node_id) from 1 on: nodes whose way from the origin is at most step/steps of the longest; each step holds the ones before."""
    one = edges.sparkSession.createDataFrame([(origin,)], "source long")
    known = edges.where((F.col("src") == origin) | (F.col("dst") == origin))
    reach = checkpoint(graph.distances(edges, one).join(known.limit(1).select(F.lit(1).alias("_there")), how="cross").select("node_id", "dist"))
    longest = reach.agg(F.max("dist").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(1.0)).alias("m"))
    each = reach.join(F.broadcast(longest), how="cross").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return each.where(F.col("dist") <= F.col("m") * F.col("step") / steps).select("step", "node_id")


def service_impact(people: DataFrame, nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, radius: float) -> DataFrame:
    """population_impact of people (x, y, people) who use the nearest node within the radius; those farther off use none."""
    placed = people.select(F.monotonically_increasing_id().alias("node_id"), "x", "y", "people")
    placed = checkpoint(placed)
    near = spatial.nearest_within(placed.select("node_id", "x", "y"), nodes.select("node_id", "x", "y"), radius)
    served = near.join(placed.select("node_id", "people"), "node_id").groupBy(F.col("match").alias("node_id")).agg(F.sum("people").alias("people"))
    loaded = checkpoint(nodes.select("node_id", "x", "y").join(served, "node_id", "left").withColumn("people", F.coalesce("people", F.lit(0))))
    left, roads = surviving(loaded, edges, scenarios)
    parts = checkpoint(graph.components(left, roads, ["scenario"]))
    n_parts = parts.groupBy("scenario").agg(F.countDistinct("component").alias("n_parts"))
    off = loaded.join(scenarios, "node_id").groupBy("scenario").agg(F.sum("people").alias("disabled_area"))
    impact = population_impact(loaded, parts, scenarios, "people")
    return impact.join(n_parts, "scenario", "left").join(off, "scenario", "left").withColumn("isolated_fraction", F.try_divide("isolated", "total"))


def disruption(nodes: DataFrame, edges: DataFrame, broken_nodes: DataFrame, broken_edges: DataFrame, origin: int, dest: int, od: DataFrame) -> DataFrame:
    """One row: largest part after, as a share of that before, unreachable pairs, and the way's length before and after."""
    left, roads = graph.without_nodes(nodes, graph.without_edges(edges, broken_edges), broken_nodes)
    left, roads = checkpoint(left), checkpoint(roads)
    one = edges.sparkSession.createDataFrame([(origin, dest)], "origin long, dest long")
    sizes = lambda n, e: graph.components(n, e).groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    before, after = sizes(nodes, edges).withColumnRenamed("n", "n0"), sizes(left, roads).withColumnRenamed("n", "n1")
    lost = graph.reachable(left, roads, od).agg(F.count_if(~F.col("connected")).alias("unreachable"))
    way0 = graph.pair_distances(edges, one).select(F.col("dist").alias("before"))
    there = one
    for end in ("origin", "dest"):
        there = there.join(left.select(F.col("node_id").alias(end)), end, "left_semi")
    way1 = graph.pair_distances(roads, there.select("origin", "dest")).agg(F.max("dist").alias("after"))
    row = before.crossJoin(after).crossJoin(lost).crossJoin(way0).crossJoin(way1)
    return row.select(F.when(F.col("n0") > 0, F.coalesce("n1", F.lit(0)) / F.col("n0")).otherwise(F.lit(1.0)).alias("lcc_fraction"), "unreachable", "before", "after", delta_percent(F.col("before"), F.col("after")).alias("delta_percent"))


def delta_percent(before, after):
    """How much longer the way is, in percent; null where one is unknown or the first is 0."""
    return F.when(before > 0, (after - before) / before * 100)


def record(results: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """Results as reported: the index to 4 places; scenarios in which nothing fails (`empty`: scenario) have no values."""
    out = results.withColumn("index", F.round("index", 4))
    if empty is None:
        return out
    keep = out.join(empty, "scenario", "left_anti")
    names = empty.select("scenario").distinct()
    return keep.unionByName(names, allowMissingColumns=True)
