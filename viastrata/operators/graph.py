"""Road graphs as nodes (node_id, …) and edges (src < dst, length, …), one or many told apart by key columns.

Each graph whose size is checked to fit a task is worked on whole, all graphs side by side; a larger one goes through rounds of
joins whose rows are written between rounds. Both give the same rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import checkpoint, largest_group, rank_within
from .elimination import Network, Ways, least_labels

#: Edges of the largest graph that one task takes whole.
TASK_EDGES = 300_000
#: Rows (source, node) that a batch of rounds works on.
ROUND_ROWS = 20_000_000
#: Rounds after which a loop that has not settled is an error.
MOST_ROUNDS = 10_000


def canonical(edges: DataFrame) -> DataFrame:
    """src <= dst, one row for a pair: the shortest, as parallel roads go."""
    flipped = edges.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    others = [c for c in edges.columns if c not in ("src", "dst")]
    row = F.min_by(F.struct(*others), F.struct("length", *[c for c in others if c != "length" and dict(edges.dtypes)[c] in ("bigint", "int", "double", "boolean", "string")]))
    return flipped.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(row.alias("r")).select("src", "dst", "r.*")


def symmetric(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge from both ends: u, v and the columns."""
    there = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), *columns)
    return there.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), *columns))


def degrees(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node_id, degree); a loop counts twice."""
    keys = keys or []
    ends = symmetric(edges, *keys).groupBy(*keys, F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select(*keys, "node_id").join(ends, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph less nodes and their edges."""
    g = gone.select(F.col("node_id").alias("_gone"))
    left = edges.join(g, F.col("src") == F.col("_gone"), "left_anti").join(g, F.col("dst") == F.col("_gone"), "left_anti")
    return nodes.join(g, F.col("node_id") == F.col("_gone"), "left_anti"), left


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges less those of the pairs, whichever way round these are."""
    pairs = gone.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
    return edges.join(pairs, (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b")), "left_anti")


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select(F.col("node_id").alias("_in"))
    return edges.join(n, F.col("src") == F.col("_in"), "left_semi").join(n, F.col("dst") == F.col("_in"), "left_semi")


def boundary_edges(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Edges with just one end in the cluster."""
    a = cluster.select(F.col("node_id").alias("_a")).distinct()
    b = cluster.select(F.col("node_id").alias("_b")).distinct()
    both = edges.join(a, F.col("src") == F.col("_a"), "left").join(b, F.col("dst") == F.col("_b"), "left")
    return both.where(F.col("_a").isNull() != F.col("_b").isNull()).drop("_a", "_b")


def stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of degree 4 or less, or next to a dead end."""
    d = checkpoint(degrees(nodes, edges))
    ends = d.where("degree <= 1").select(F.col("node_id").alias("u"))
    beside = symmetric(edges).join(ends, "u", "left_semi").select(F.col("v").alias("node_id"))
    return d.where("degree <= 4").select("node_id").unionByName(beside).distinct()


def relabel(nodes: DataFrame, edges: DataFrame, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Ids without gaps, in the order of the old ones."""
    ranked = checkpoint(rank_within(nodes.select(F.lit(0).alias("_all"), "node_id"), ["_all"], [F.col("node_id")]))
    new = ranked.select(F.col("node_id").alias("old"), (F.col("k") - 1 + first).cast("long").alias("new"))
    a, b = new.select(F.col("old").alias("src"), F.col("new").alias("_a")), new.select(F.col("old").alias("dst"), F.col("new").alias("_b"))
    moved = edges.join(a, "src").join(b, "dst").drop("src", "dst").withColumnsRenamed({"_a": "src", "_b": "dst"})
    return nodes.join(new, F.col("node_id") == F.col("old")).drop("old", "node_id").withColumnRenamed("new", "node_id"), moved


def fingerprint(edges: DataFrame) -> DataFrame:
    """(n_edges, total, fingerprint) that do not hang on the order of rows."""
    mixed = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.round("length", 6))
    return edges.agg(F.count("*").alias("n_edges"), F.round(F.sum("length"), 6).alias("total"), F.hex(F.bit_xor(mixed)).alias("fingerprint"))


def grouped(rows: DataFrame, keys: list[str]):
    """Rows by the keys; without keys as one group, for what is checked to fit a task."""
    return rows.groupBy(*keys) if keys else rows.withColumn("_all", F.lit(0)).groupBy("_all")


# Components.


def components(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(keys, node_id, component): the least node that each node can reach."""
    keys = keys or []
    both = edges.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(nodes.select(*keys, F.col("node_id").alias("u"), F.col("node_id").alias("v")))
    both = checkpoint(both)
    if largest_group(both, keys) > task_edges:
        return components_by_rounds(both, keys)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(pdf[["u", "v"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        out = pd.DataFrame({"node_id": names, "component": names[least_labels(ends[:, 0], ends[:, 1], len(names))]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    schema = ", ".join([*(f"{k} {t}" for k, t in both.dtypes if k in keys), "node_id long, component long"])
    return grouped(both, keys).applyInPandas(kernel, schema)


def components_by_rounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, component) from links (keys, u, v) and a link u = v for each node. Stars: the larger neighbours of each
    node are hung on the least, then its smaller ones, until nothing moves. No task holds more than a share of the links."""
    loops = pairs.where("u = v").select(*keys, F.col("u").alias("node_id"))
    hung = checkpoint(pairs.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        both = hung.unionByName(hung.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        hung = checkpoint(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = hung.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*hung.columns)).alias("h")).first()
        if seen == (now["n"], now["h"]):
            found = hung.withColumnsRenamed({"u": "node_id", "v": "component"})
            return loops.distinct().join(found, [*keys, "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))
        seen = (now["n"], now["h"])
    raise RuntimeError("components did not settle")


# Shortest paths.


def _adjacency(pdf: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for u, v, w in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["length"].tolist(), strict=True):
        out[u].append((v, w))
        out[v].append((u, w))
    return out


def _reach(near: dict[int, list[tuple[int, float]]], source: int) -> dict[int, tuple[float, int]]:
    """Distance and node before, of each node in reach; of equal ways the one over the least node."""
    best: dict[int, tuple[float, int]] = {source: (0.0, source)}
    queue = [(0.0, source)]
    done = set()
    while queue:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        for v, w in near.get(u, ()):
            if v not in done and (v not in best or (d + w, u) < best[v]):
                best[v] = (d + w, u)
                heapq.heappush(queue, (d + w, v))
    return best


def spread_of(asked: DataFrame, least: int = 8) -> int:
    """Tasks that sources are dealt to, each with a copy of the graph: as many as the cluster works on at a time, for some sources each."""
    return spread_for(asked.sparkSession, asked.count(), least)


def spread_for(spark: SparkSession, n: int, least: int = 8) -> int:
    return max(least, min(2 * spark.sparkContext.defaultParallelism, n // 16))


def distances(edges: DataFrame, sources: DataFrame, keys: list[str] | None = None, task_edges: int = TASK_EDGES, spread: int | None = None) -> DataFrame:
    """(keys, source, node_id, dist, before) of all nodes that each source reaches. Sources of a graph are dealt to `spread`
    tasks, each with the graph. Sources that are no node of an edge reach themselves."""
    keys = keys or []
    asked = checkpoint(sources.select(*keys, "source").distinct())
    roads = checkpoint(edges.select(*keys, "src", "dst", "length"))
    if largest_group(roads, keys) > task_edges:
        return _distances_by_rounds(roads, asked, keys)

    def rows(near: dict[int, list[tuple[int, float]]], pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(s, n, d, b) for s in pdf["source"].tolist() for n, (d, b) in _reach(near, s).items()]
        return pd.DataFrame(found, columns=["source", "node_id", "dist", "before"])

    return _dealt_sources(roads, asked, keys, rows, "source long, node_id long, dist double, before long", spread)


def _dealt_sources(roads: DataFrame, asked: DataFrame, keys: list[str], rows: Callable[[dict, pd.DataFrame], pd.DataFrame], columns: str, spread: int | None) -> DataFrame:
    """What rows(adjacency, asked rows) gives for the rows (keys, source, …) that are dealt to each task."""
    spread = spread or spread_of(asked)
    dealt = asked.withColumn("_part", F.pmod(F.xxhash64("source"), F.lit(spread)))
    parts = dealt.select(*keys, F.col("_part").alias("_deal")).distinct()
    held = roads.join(parts, keys) if keys else roads.join(F.broadcast(parts), how="cross")
    # Other names, as both sides may come from one frame.
    held = held.select(*(F.col(k).alias(f"_{k}") for k in keys), "src", "dst", "length", "_deal")
    schema = ", ".join([*(f"{k} {t}" for k, t in roads.dtypes if k in keys), columns])

    def kernel(sources_: pd.DataFrame, roads_: pd.DataFrame) -> pd.DataFrame:
        out = rows(_adjacency(roads_), sources_)
        for k in keys:
            out[k] = sources_[k].iloc[0] if len(sources_) else None
        return out

    return dealt.groupBy(*keys, "_part").cogroup(held.groupBy(*(f"_{k}" for k in keys), "_deal")).applyInPandas(kernel, schema)


def _distances_by_rounds(roads: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Each round goes on from the nodes that the last one reached on a shorter way."""
    both = checkpoint(symmetric(roads, "length", *keys))
    state = checkpoint(asked.select(*keys, "source", F.col("source").alias("node_id"), F.lit(0.0).alias("dist"), F.col("source").alias("before"), F.lit(True).alias("new")))
    group = [*keys, "source", "node_id"]
    for _ in range(MOST_ROUNDS):
        ahead = state.where("new").withColumnRenamed("node_id", "u").join(both, [*keys, "u"])
        offers = ahead.select(*keys, "source", F.col("v").alias("node_id"), (F.col("dist") + F.col("length")).alias("dist"), F.col("u").alias("before"), F.lit(True).alias("new"))
        best = state.withColumn("new", F.lit(False)).unionByName(offers).groupBy(*group).agg(F.min(F.struct("dist", "before", "new")).alias("b"))
        state = checkpoint(best.select(*group, "b.dist", "b.before", "b.new"))
        if state.where("new").isEmpty():
            return state.drop("new")
    raise RuntimeError("distances did not settle")


def pair_distances(edges: DataFrame, pairs: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """pairs (keys, origin, dest) with dist, null where there is no way. Of what an origin reaches no more than the asked is kept."""
    keys = keys or []
    task_edges, spread = options.get("task_edges", TASK_EDGES), options.get("spread")
    roads = checkpoint(edges.select(*keys, "src", "dst", "length"))
    if largest_group(roads, keys) <= task_edges:
        asked = pairs.where("origin is not null and dest is not null").select(*keys, F.col("origin").alias("source"), "dest").distinct()

        def rows(near: dict[int, list[tuple[int, float]]], pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for s, part in pdf.groupby("source"):
                reach = _reach(near, s)
                out += [(s, n, reach[n][0]) for n in part["dest"].tolist() if n in reach]
            return pd.DataFrame(out, columns=["origin", "dest", "dist"])

        found = _dealt_sources(roads, checkpoint(asked), keys, rows, "origin long, dest long, dist double", spread)
        return pairs.join(found, [*keys, "origin", "dest"], "left")
    found = distances(roads, pairs.select(*keys, F.col("origin").alias("source")), keys, task_edges, spread)
    return pairs.join(found.select(*keys, F.col("source").alias("origin"), F.col("node_id").alias("dest"), "dist"), [*keys, "origin", "dest"], "left")


def route(edges: DataFrame, origin: int, dest: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """(step, node_id, dist) from the origin on; no rows where there is no way. Only nodes whose distances to both ends add up to
    the way's length are looked at; these are walked back on the driver where they fit a task, else by doubled pointers."""
    one = lambda node: edges.sparkSession.createDataFrame([(node,)], "source long")
    schema = "step int, node_id long, dist double"
    state = checkpoint(distances(edges, one(origin), task_edges=task_edges))
    if (end := state.where(F.col("node_id") == dest).select("dist").first()) is None:
        return edges.sparkSession.createDataFrame([], schema)
    total = end["dist"]
    back = distances(edges, one(dest), task_edges=task_edges).select("node_id", F.col("dist").alias("back"))
    near = checkpoint(state.join(back, "node_id").where(F.abs(F.col("dist") + F.col("back") - total) <= 1e-9 * (1 + total)).select("node_id", "before", "dist"))
    if near.count() > task_edges:
        return _route_by_rounds(near, origin, dest)
    before = {r["node_id"]: (r["before"], r["dist"]) for r in near.collect()}
    steps = [dest]
    while steps[-1] != origin:
        steps.append(before[steps[-1]][0])
    return edges.sparkSession.createDataFrame([(k, n, before[n][1]) for k, n in enumerate(reversed(steps))], schema)


def _route_by_rounds(near: DataFrame, origin: int, dest: int) -> DataFrame:
    """The route from (node_id, before, dist). Each round knows as many nodes again, from the destination back: what is so many
    nodes before each of those that are known."""
    jump = near.select(F.col("node_id").alias("_from"), F.when(F.col("node_id") == origin, F.lit(origin)).otherwise(F.col("before")).alias("_to"))
    way = near.where(F.col("node_id") == dest).select("node_id", F.lit(0).alias("back"))
    hop = 1
    while (end := way.where(F.col("node_id") == origin).first()) is None:
        ahead = way.join(jump, F.col("node_id") == F.col("_from")).select(F.col("_to").alias("node_id"), F.col("back") + hop)
        way = checkpoint(way.unionByName(ahead.toDF("node_id", "back")).groupBy("node_id").agg(F.min("back").alias("back")))
        middle = jump.select(F.col("_from").alias("_middle"), F.col("_to").alias("_end"))
        jump = checkpoint(jump.join(middle, F.col("_to") == F.col("_middle")).select("_from", F.col("_end").alias("_to")))
        hop *= 2
    return way.join(near, "node_id").select((F.lit(end["back"]) - F.col("back")).cast("int").alias("step"), "node_id", "dist")


def reachable(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """pairs (keys, origin, dest) with `connected`: both are nodes, of one component."""
    keys = keys or []
    c = checkpoint(components(nodes, edges, keys))
    a = c.select(*keys, F.col("node_id").alias("origin"), F.col("component").alias("_a"))
    b = c.select(*keys, F.col("node_id").alias("dest"), F.col("component").alias("_b"))
    both = pairs.join(a, [*keys, "origin"], "left").join(b, [*keys, "dest"], "left")
    return both.withColumn("connected", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


# Measures of importance.


def k_core(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, core): the largest k of a part in which the node and all others have k neighbours."""
    if edges.count() <= task_edges:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            near: dict[int, set[int]] = defaultdict(set)
            for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                near[u]
                if u != v:
                    near[u].add(v)
                    near[v].add(u)
            left = {u: len(vs) for u, vs in near.items()}
            core, k = {}, 0
            heap = [(d, u) for u, d in left.items()]
            heapq.heapify(heap)
            while heap:
                d, u = heapq.heappop(heap)
                if u in core or d != left[u]:
                    continue
                k = max(k, d)
                core[u] = k
                for v in near[u]:
                    if v not in core:
                        left[v] -= 1
                        heapq.heappush(heap, (left[v], v))
            return pd.DataFrame({"node_id": list(core), "core": list(core.values())})

        rows = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(nodes.select(F.col("node_id").alias("u"), F.col("node_id").alias("v")))
        return grouped(rows, []).applyInPandas(kernel, "node_id long, core long")
    left, done = checkpoint(edges.where("src <> dst").select("src", "dst").distinct()), None
    k = 0
    out = checkpoint(nodes.select("node_id", F.lit(0).cast("long").alias("core")))
    while not left.isEmpty():
        k += 1
        while True:
            weak = symmetric(left).groupBy(F.col("u").alias("node_id")).count().where(F.col("count") < k).select("node_id")
            if weak.isEmpty():
                break
            left = checkpoint(without_nodes(nodes, left, weak)[1])
        strong = symmetric(left).select(F.col("u").alias("node_id")).distinct().withColumn("in_", F.lit(k))
        out = checkpoint(out.join(strong, "node_id", "left").select("node_id", F.coalesce("in_", "core").cast("long").alias("core")))
    return out


def alpha_centrality(nodes: DataFrame, edges: DataFrame, alpha: float = 0.1, rounds: int = 30, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, alpha): x = alpha A x + 1 after fixed rounds from x = 1. A graph that fits a task is gone through there; of larger
    ones, plans are cut every few rounds."""
    if edges.count() <= task_edges:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.unique(pdf.loc[pdf["v"].isna(), "u"].to_numpy(np.int64))
            roads = pdf[pdf["v"].notna() & pdf["u"].isin(ids) & pdf["v"].isin(ids)]
            u, v = np.searchsorted(ids, roads["u"].to_numpy(np.int64)), np.searchsorted(ids, roads["v"].to_numpy(np.int64))
            x = np.ones(len(ids))
            for _ in range(rounds):
                x = 1 + alpha * (np.bincount(u, x[v], len(ids)) + np.bincount(v, x[u], len(ids)))
            return pd.DataFrame({"node_id": ids, "alpha": x})

        rows = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(nodes.select(F.col("node_id").alias("u"), F.lit(None).cast("long").alias("v")))
        return nodes.select("node_id").join(grouped(rows, []).applyInPandas(kernel, "node_id long, alpha double"), "node_id")
    both = checkpoint(symmetric(edges))
    x = nodes.select("node_id", F.lit(1.0).alias("x"))
    for k in range(rounds):
        sums = both.join(x.select(F.col("node_id").alias("v"), "x"), "v").groupBy(F.col("u").alias("node_id")).agg(F.sum("x").alias("s"))
        x = nodes.select("node_id").join(sums, "node_id", "left").select("node_id", (1 + alpha * F.coalesce("s", F.lit(0.0))).alias("x"))
        if k % 5 == 4:
            x = checkpoint(x)
    return x.withColumnRenamed("x", "alpha")


def _per_source(nodes: DataFrame, edges: DataFrame, kernel: Callable[[pd.DataFrame, list[int]], pd.DataFrame], schema: str, spread: int) -> DataFrame:
    part = F.pmod(F.xxhash64("node_id"), F.lit(spread)).alias("_part")
    asked = nodes.select("node_id", part)
    held = edges.select("src", "dst", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("_deal"))
    run = lambda a, b: kernel(b, sorted(a["node_id"].tolist()))
    return asked.groupBy("_part").cogroup(held.groupBy("_deal")).applyInPandas(run, schema)


def task_ways(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(src, dst, length) of a graph that was counted to fit a task, for ways by levels; None if some length is not above 0."""
    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("length").cast("double")).toArrow()
    u, v, length = (rows.column(k).to_numpy() for k in range(3))
    return (u, v, length) if (length > 0).all() else None


def by_parts(spark: SparkSession, kernel: Callable[[int], pd.DataFrame], schema: str, parts: int) -> DataFrame:
    """What kernel(part) gives for each part from 0, a task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from (kernel(part) for part in b["id"].tolist())

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def betweenness(nodes: DataFrame, edges: DataFrame, spread: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, betweenness): share of the shortest ways between other nodes that lead over each, by length (Brandes 2001).
    Sources are dealt to tasks, each with the graph: as levels of nodes that are taken out, or, where it is dense or has roads of
    no length, as it is. Of a larger graph, batches of sources go through rounds."""
    n = nodes.count()
    scale = 1.0 / max((n - 1) * (n - 2), 1)
    if edges.count() > task_edges:
        found = _betweenness_by_rounds(nodes, edges, max(1, ROUND_ROWS // max(n, 1)))
        return nodes.select("node_id").join(found, "node_id", "left").select("node_id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))

    def by_levels(part: int) -> pd.DataFrame:
        return pd.DataFrame({"node_id": ways.ids, "b": ways.betweenness(part, spread, asked)})

    def kernel(pdf: pd.DataFrame, sources: list[int]) -> pd.DataFrame:
        near = _adjacency(pdf)
        total: dict[int, float] = defaultdict(float)
        for s in sources:
            dist, ways, before, order = {}, defaultdict(float, {s: 1.0}), defaultdict(list), []
            best = {s: 0.0}
            queue = [(0.0, s, s)]
            while queue:
                d, u, via = heapq.heappop(queue)
                if u in dist:
                    if via != u and abs(d - dist[u]) <= 1e-9 * (1 + d) and via not in before[u]:
                        before[u].append(via)
                        ways[u] += ways[via]
                    continue
                dist[u] = d
                order.append(u)
                if via != u:
                    before[u].append(via)
                    ways[u] += ways[via]
                for v, w in near.get(u, ()):
                    if v not in dist and d + w <= best.get(v, np.inf) * (1 + 1e-9) + 1e-9:
                        best[v] = min(best.get(v, np.inf), d + w)
                        heapq.heappush(queue, (d + w, v, u))
            owed: dict[int, float] = defaultdict(float)
            for u in reversed(order):
                for p in before[u]:
                    owed[p] += ways[p] / ways[u] * (1 + owed[u])
                if u != s:
                    total[u] += owed[u]
        return pd.DataFrame({"node_id": list(total), "b": list(total.values())})

    spread, columns = spread or spread_of(nodes), "node_id long, b double"
    roads = task_ways(edges)
    ways = None if roads is None else Ways.of(*roads)
    if ways is None:
        parts = _per_source(nodes, edges, kernel, columns, spread)
    else:
        ends = symmetric(edges).select(F.col("u").alias("node_id")).distinct()
        asked = np.isin(ways.ids, nodes.select(F.col("node_id").cast("long").alias("node_id")).join(ends, "node_id", "left_semi").toArrow().column(0).to_numpy())
        parts = by_parts(nodes.sparkSession, by_levels, columns, spread)
    found = parts.groupBy("node_id").agg(F.sum("b").alias("b"))
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _betweenness_by_rounds(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(node_id, b) of `size` sources at a time. Lengths must be above 0, as shortest ways over roads of no length cannot be counted."""
    a, b = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    roads = checkpoint(edges.where("src <> dst").select(a, b, "length").groupBy("src", "dst").agg(F.min("length").alias("length")))
    if not roads.where("length <= 0").isEmpty():
        raise ValueError("roads of no length: shortest ways cannot be counted")
    both = checkpoint(symmetric(roads, "length"))
    ranked = checkpoint(rank_within(nodes.select(F.lit(0).alias("_all"), "node_id"), ["_all"], [F.col("node_id")]))
    found = None
    for start in range(0, nodes.count(), size):
        sources = ranked.where((F.col("k") > start) & (F.col("k") <= start + size)).select(F.col("node_id").alias("source"))
        dist = checkpoint(_distances_by_rounds(roads, checkpoint(sources), []).select("source", "node_id", "dist"))
        du, dv = dist.select("source", F.col("node_id").alias("u"), F.col("dist").alias("_du")), dist.select("source", F.col("node_id").alias("v"), F.col("dist").alias("_dv"))
        near = du.join(both, "u").join(dv, ["source", "v"])
        steps = checkpoint(near.where((F.col("_dv") > F.col("_du")) & (F.abs(F.col("_du") + F.col("length") - F.col("_dv")) <= 1e-9 * (1 + F.col("_dv")))).select("source", "u", "v"))
        one = dist.where("source = node_id").select("source", "node_id", F.lit(1.0).alias("x"))
        ways = checkpoint(one.unionByName(_sums_along(one, steps)).withColumnRenamed("x", "ways"))
        # Of each node the sum, over the ways that lead on from it, of 1 / the ways to their ends.
        owed = _sums_along(ways.select("source", "node_id", (1 / F.col("ways")).alias("x")), steps.select("source", F.col("v").alias("u"), F.col("u").alias("v")))
        part = ways.join(owed, ["source", "node_id"]).where("source <> node_id").groupBy("node_id").agg(F.sum(F.col("ways") * F.col("x")).alias("b"))
        found = checkpoint(part if found is None else found.unionByName(part).groupBy("node_id").agg(F.sum("b").alias("b")))
    return found if found is not None else nodes.select("node_id", F.lit(0.0).alias("b"))


def _sums_along(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(source, node_id, x): what the start's x add up to at each node, over all ways of one step (source, u, v) or more."""
    ahead, sums = start, None
    for k in range(MOST_ROUNDS):
        moved = ahead.withColumnRenamed("node_id", "u").join(steps, ["source", "u"])
        ahead = checkpoint(moved.groupBy("source", F.col("v").alias("node_id")).agg(F.sum("x").alias("x")))
        if ahead.isEmpty():
            return ahead if sums is None else checkpoint(sums.groupBy("source", "node_id").agg(F.sum("x").alias("x")))
        sums = ahead if sums is None else sums.unionByName(ahead)
        if k % 10 == 9:
            sums = checkpoint(sums.groupBy("source", "node_id").agg(F.sum("x").alias("x")))
    raise RuntimeError("ways did not end")


def current_flow(nodes: DataFrame, edges: DataFrame, most_nodes: int = 3000) -> DataFrame:
    """(node_id, current_flow): share of unit currents between other nodes of its component that pass each node; lengths are
    resistances. A component of up to most_nodes is solved whole by one task; the roads of a larger one are dealt to tasks, each of
    which eliminates the component's nodes and solves for its roads."""
    c = checkpoint(components(nodes, edges))
    sizes = checkpoint(c.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most_nodes))
    if not sizes.isEmpty():
        large, c = c.join(sizes, "component"), checkpoint(c.join(sizes, "component", "left_anti"))
        return _small_current_flow(c, edges).unionByName(_large_current_flow(checkpoint(large), edges))
    return _small_current_flow(c, edges)


def _large_current_flow(members: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES, spread: int = 32) -> DataFrame:
    """Of components (component, node_id, n): the same as _small_current_flow, without a matrix of all nodes by all nodes."""
    roads = edges.where("src <> dst").join(members.select(F.col("node_id").alias("src"), "component"), "src").select("component", "src", "dst", "length")
    roads = checkpoint(roads)
    if roads.count() <= task_edges:
        found = _currents_of_held(roads, spread_of(members))
    else:
        found = _currents_by_tasks(roads, spread)
    found = found.groupBy("node_id").agg(F.sum("f").alias("f"))
    n = F.col("n")
    share = F.greatest(F.col("f") / 2 - (n - 1) / 2, F.lit(0.0)) / ((n - 1) * (n - 2) / 2)
    return members.join(found, "node_id", "left").select("node_id", F.when((n > 2) & F.col("f").isNotNull(), share).otherwise(F.lit(0.0)).alias("current_flow"))


def _currents_of_held(roads: DataFrame, spread: int) -> DataFrame:
    """(node_id, f): nodes are taken out once, here; the roads are dealt in runs that lie together."""
    rows = roads.select("component", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("length").cast("double")).toArrow()
    component, *rest = (rows.column(k).to_numpy() for k in range(4))
    made = [Network.of(*(x[component == c] for x in rest)) for c in np.unique(component)]

    def kernel(part: int) -> pd.DataFrame:
        found = [(ids, network.flows(*(np.array_split(x, spread)[part] for x in held))) for ids, network, held in made]
        return pd.DataFrame({"node_id": np.concatenate([ids for ids, _ in found]), "f": np.concatenate([f for _, f in found])})

    return by_parts(roads.sparkSession, kernel, "node_id long, f double", spread)


def _currents_by_tasks(roads: DataFrame, spread: int) -> DataFrame:
    """(node_id, f): each task takes out the nodes of a component, and deals itself a run of its roads."""
    deal = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))
    held = roads.select("component", "src", "dst", "length", deal.alias("_deal"))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["_deal"].iloc[0])
        ids, network, mine = Network.of(*(rows[c].to_numpy() for c in ("src", "dst", "length")))
        return pd.DataFrame({"node_id": ids, "f": network.flows(*(np.array_split(x, spread)[part] for x in mine))})

    return held.groupBy("component", "_deal").applyInPandas(kernel, "node_id long, f double")


def _small_current_flow(c: DataFrame, edges: DataFrame) -> DataFrame:
    roads = edges.join(c.select(F.col("node_id").alias("src"), F.col("component").alias("_part")), "src").select("_part", "src", "dst", "length")

    def kernel(members: pd.DataFrame, roads_: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(members["node_id"].to_numpy())
        n = len(ids)
        flow = np.zeros(n)
        if n > 2 and len(roads_):
            u, v = np.searchsorted(ids, roads_["src"].to_numpy()), np.searchsorted(ids, roads_["dst"].to_numpy())
            g = 1 / np.maximum(roads_["length"].to_numpy(), 1e-9)
            lap = np.zeros((n, n))
            np.add.at(lap, (u, v), -g)
            np.add.at(lap, (v, u), -g)
            np.fill_diagonal(lap, -lap.sum(axis=1))
            pot = np.linalg.pinv(lap)
            order = np.arange(n)
            for a, b, w in zip(u, v, g, strict=True):
                # Current of the edge is w (row_s - row_t); its sum over all pairs comes from the sorted row.
                row = np.sort(w * (pot[a] - pot[b]))
                total = ((2 * order - n + 1) * row).sum()
                flow[a] += total
                flow[b] += total
            # A pair's ends see half of its current on their own roads.
            flow = np.maximum(flow / 2 - (n - 1) / 2, 0) / ((n - 1) * (n - 2) / 2)
        return pd.DataFrame({"node_id": ids, "current_flow": flow})

    return c.groupBy("component").cogroup(roads.groupBy("_part")).applyInPandas(kernel, "node_id long, current_flow double")


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns moved to 0..1; 0 where all are equal."""
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    both = rows.crossJoin(F.broadcast(ends))
    scaled = {c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(F.lit(0.0)) for c in columns}
    return both.withColumns(scaled).select(*rows.columns)


MEASURES = ("betweenness", "core", "current_flow", "alpha")


def criticality(nodes: DataFrame, edges: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(node_id, betweenness, core, current_flow, alpha, composite), each 0..1; composite is the mean of the four."""
    parts = [betweenness(nodes, edges), k_core(nodes, edges), current_flow(nodes, edges), alpha_centrality(nodes, edges, alpha)]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "node_id")
    joined = checkpoint(joined.select("node_id", *(F.col(m).cast("double").alias(m) for m in MEASURES)))
    return composite(min_max(joined, list(MEASURES)))


def composite(measures: DataFrame) -> DataFrame:
    mean = sum((F.col(m) for m in MEASURES[1:]), F.col(MEASURES[0])) / len(MEASURES)
    return measures.withColumn("composite", mean)


def edge_scores(edges: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """Edges with the greater score of their ends; unknown ends count 0."""
    a = scores.select(F.col("node_id").alias("src"), F.col(score).alias("_a"))
    b = scores.select(F.col("node_id").alias("dst"), F.col(score).alias("_b"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    return both.withColumn("score", F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0)))).drop("_a", "_b")


# Bridging.


class Sets:
    """Disjoint sets; a root is the least member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning_forest(candidates: DataFrame, of: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Of candidates (u, v, weight) those of the least spanning forest over the components that `of` (node_id, component)
    gives; equal weights go by u, then v, so the forest is one. Large sets go by rounds: each component takes its least candidate."""
    a, b = of.select(F.col("node_id").alias("u"), F.col("component").alias("ca")), of.select(F.col("node_id").alias("v"), F.col("component").alias("cb"))
    named = checkpoint(candidates.select("u", "v", "weight").join(a, "u").join(b, "v").where("ca <> cb"))
    if named.count() <= task_edges:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["weight", "u", "v"])
            sets = Sets()
            return pdf[[sets.join(x, y) for x, y in zip(pdf["ca"].tolist(), pdf["cb"].tolist(), strict=True)]][["u", "v", "weight"]]

        return grouped(named, []).applyInPandas(kernel, "u long, v long, weight double")
    taken = None
    left = named
    while not left.isEmpty():
        ends = left.select(F.col("ca").alias("c"), "weight", "u", "v").unionByName(left.select(F.col("cb").alias("c"), "weight", "u", "v"))
        least = ends.groupBy("c").agg(F.min(F.struct("weight", "u", "v")).alias("m")).select("m.u", "m.v", "m.weight").distinct()
        chosen = checkpoint(least.join(left, ["u", "v", "weight"]))
        taken = chosen.select("u", "v", "weight") if taken is None else checkpoint(taken.unionByName(chosen.select("u", "v", "weight")))
        every = left.select(F.col("ca").alias("node_id")).unionByName(left.select(F.col("cb").alias("node_id"))).distinct()
        merged = checkpoint(components(every, chosen.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))))
        x, y = merged.select(F.col("node_id").alias("ca"), F.col("component").alias("na")), merged.select(F.col("node_id").alias("cb"), F.col("component").alias("nb"))
        left = checkpoint(left.join(x, "ca").join(y, "cb").where("na <> nb").select("u", "v", "weight", F.col("na").alias("ca"), F.col("nb").alias("cb")))
    return taken if taken is not None else named.select("u", "v", "weight")


def cluster(nodes: DataFrame, edges: DataFrame, start: int, size: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id) of the first `size` nodes met going out from a node, neighbours by their ids; size is a small number."""
    found, ring, seen = [start], deque([start]), {start}
    while ring and len(found) < size:
        near: dict[int, list[int]] = defaultdict(list)
        for r in symmetric(edges).where(F.col("u").isin(list(ring))).collect():
            near[r["u"]].append(r["v"])
        ahead: deque[int] = deque()
        for u in ring:
            for v in sorted(near[u]):
                if v not in seen and len(found) < size:
                    seen.add(v)
                    found.append(v)
                    ahead.append(v)
        ring = ahead
    return nodes.sparkSession.createDataFrame([(n,) for n in found], "node_id long")
