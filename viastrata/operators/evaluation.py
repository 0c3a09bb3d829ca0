"""How well a found road graph agrees with the true one."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import checkpoint
from . import graph, spatial
from .elimination import Agreement

#: (src, dst, length) of a graph.
Held = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Metres within which nodes of two graphs are the same place.
SNAP = 15.0


def node_pairs(nodes: DataFrame, most: int | None = None, seed: str = "0") -> DataFrame:
    """(origin, dest), origin < dest: all pairs, or, if they are more than `most`, that many by a seeded order of pairs of
    seeded places: each place is drawn by a hash, so pairs are not all made to choose some."""
    n = nodes.count()
    if most is None or n * (n - 1) // 2 <= most:
        a, b = nodes.select(F.col("node_id").alias("origin")), nodes.select(F.col("node_id").alias("dest"))
        return a.join(b, F.col("origin") < F.col("dest"))
    spark = nodes.sparkSession
    _, ranks = _ranked(nodes)
    draw = lambda name: F.pmod(F.xxhash64(F.lit(f"{seed}{name}"), F.col("id")), F.lit(n))
    drawn = spark.range(4 * most).select("id", draw("a").alias("i"), draw("b").alias("j")).where("i <> j")
    pairs = drawn.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("id").alias("id")).orderBy("id").limit(most)
    a, b = ranks.select(F.col("k").alias("i"), F.col("node_id").alias("_a")), ranks.select(F.col("k").alias("j"), F.col("node_id").alias("_b"))
    return pairs.join(a, "i").join(b, "j").select(F.least("_a", "_b").alias("origin"), F.greatest("_a", "_b").alias("dest"))


def _ranked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    moved, _ = graph.relabel(nodes.select("node_id", F.col("node_id").alias("old_id")), nodes.limit(0).select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    return moved, checkpoint(moved.select(F.col("node_id").alias("k"), F.col("old_id").alias("node_id")))


def snapped(a: DataFrame, b: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """(node_id, match)."""
    return checkpoint(spatial.nearest_within(a, b, tolerance).select("node_id", "match"))


def _matched(pairs: DataFrame, match: DataFrame, a: str, b: str) -> DataFrame:
    x, y = match.select(F.col("node_id").alias(a), F.col("match").alias("_ma")), match.select(F.col("node_id").alias(b), F.col("match").alias("_mb"))
    return pairs.join(x, a, "left").join(y, b, "left")


class Pairing:
    """A true and a found graph with what the measures share, made once: matches both ways, parts, and ways between all nodes."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame, tolerance: float = SNAP):
        self.nodes, self.edges, self.found_nodes, self.found_edges, self.tolerance = nodes, edges, found_nodes, found_edges, tolerance

    @cached_property
    def there(self) -> DataFrame:
        return snapped(self.nodes, self.found_nodes, self.tolerance)

    @cached_property
    def back(self) -> DataFrame:
        return snapped(self.found_nodes, self.nodes, self.tolerance)

    @cached_property
    def _both_parts(self) -> DataFrame:
        """Components of both graphs, side by side."""
        two = lambda a, b, *columns: a.select(F.lit(0).alias("graph"), *columns).unionByName(b.select(F.lit(1).alias("graph"), *columns))
        return checkpoint(graph.components(two(self.nodes, self.found_nodes, "node_id"), two(self.edges, self.found_edges, "src", "dst"), ["graph"]))

    @cached_property
    def parts(self) -> DataFrame:
        return self._both_parts.where("graph = 0").drop("graph")

    @cached_property
    def found_parts(self) -> DataFrame:
        return self._both_parts.where("graph = 1").drop("graph")

    @cached_property
    def held(self) -> tuple[Held | None, Held | None]:
        """Both graphs for tasks, if they are counted to fit."""
        return graph.task_ways(self.edges), graph.task_ways(self.found_edges)

    @cached_property
    def ways(self) -> DataFrame:
        return all_ways(self.nodes, self.edges)

    @cached_property
    def found_ways(self) -> DataFrame:
        return all_ways(self.found_nodes, self.found_edges)


def all_ways(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node_id, dist) between all nodes that have roads."""
    joined = graph.degrees(nodes, edges).where("degree > 0").select(F.col("node_id").alias("source"))
    return checkpoint(graph.distances(edges, joined).select("source", "node_id", "dist"))


def apls_one_way(nodes: DataFrame, edges: DataFrame, other_edges: DataFrame, match: DataFrame, most: int | None = None, seed: str = "0", ways: DataFrame | None = None, other_ways: DataFrame | None = None) -> DataFrame:
    """(score, n): 1 less the mean difference of shortest ways, as a share of the way here, at most 1; 1 where the other graph
    lacks an end or a way. Pairs without a way here are not counted; without any the score is 1 and n 0. ways, other_ways: all_ways of the graphs,
    if known."""
    if most is None and ways is None and other_ways is None and edges.count() <= graph.TASK_EDGES and other_edges.count() <= graph.TASK_EDGES:
        found = _by_levels([(nodes, edges, match)], (graph.task_ways(edges), graph.task_ways(other_edges)))
        return found[0] if found else _one_way_in_tasks(nodes, edges, other_edges, match)
    if most is None:
        # All pairs: what the distances of all nodes give already.
        ways = all_ways(nodes, edges) if ways is None else ways
        here = ways.where("source < node_id and dist > 0").select(F.col("source").alias("origin"), F.col("node_id").alias("dest"), "dist")
    else:
        joined = graph.degrees(nodes, edges).where("degree > 0").select("node_id")
        here = graph.pair_distances(edges, checkpoint(node_pairs(joined, most, seed))).where("dist > 0")
    both = checkpoint(_matched(here, match, "origin", "dest"))
    if other_ways is None:
        asked = both.where("_ma is not null and _mb is not null").select(F.col("_ma").alias("origin"), F.col("_mb").alias("dest")).distinct()
        there = graph.pair_distances(other_edges, asked).select(F.col("origin").alias("_ma"), F.col("dest").alias("_mb"), F.col("dist").alias("other"))
    else:
        there = other_ways.select(F.col("source").alias("_ma"), F.col("node_id").alias("_mb"), F.col("dist").alias("other"))
    told = both.join(there, ["_ma", "_mb"], "left")
    penalty = F.when(F.col("other").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.abs(F.col("dist") - F.col("other")) / F.col("dist")))
    return told.agg(F.coalesce(1 - F.avg(penalty), F.lit(1.0)).alias("score"), F.count("*").alias("n"))


def _by_levels(sides: list[tuple[DataFrame, DataFrame, DataFrame]], held: tuple[Held | None, Held | None]) -> list[DataFrame] | None:
    """As _one_way_in_tasks, of (nodes, edges, match) of one graph or of both, many sources at a time, in one go over both graphs.
    None for graphs that do not go by levels."""
    if held[0] is None or held[1] is None:
        return None
    none = np.zeros(0, np.int64)
    asked, matches = [none, none], [(none, none), (none, none)]
    for k, (nodes, edges, match) in enumerate(sides):
        ends = graph.symmetric(edges).select(F.col("u").alias("node_id"))
        sources = nodes.select("node_id").join(ends, "node_id", "left_semi").join(match.select("node_id", "match"), "node_id", "left")
        known = sources.select(F.col("node_id").cast("long"), F.col("match").cast("long")).toArrow()
        some = known.filter(known.column(1).is_valid())
        asked[k], matches[k] = known.column(0).to_numpy(), (some.column(0).to_numpy(), some.column(1).to_numpy())
    both = Agreement.of(list(held), asked, matches)
    if both is None:
        return None
    spark, ways = nodes.sparkSession, len(sides)
    spread = graph.spread_for(spark, both.levels.n)

    def kernel(part: int) -> pd.DataFrame:
        found = both.sums(part, spread, ways)
        return pd.DataFrame({"way": range(ways), "total": found[:, 0], "n": found[:, 1].astype(np.int64)})

    schema = "way long, total double, n long"
    # Graphs that are alike have nothing to sweep, for which no task need start.
    sums = checkpoint(graph.by_parts(spark, kernel, schema, spread)) if both.levels.n else spark.createDataFrame([*kernel(0).itertuples(index=False, name=None)], schema)
    return [_score(sums.where(F.col("way") == k)) for k in range(ways)]


def _score(sums: DataFrame) -> DataFrame:
    whole = sums.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return whole.select(F.when(F.col("n") > 0, 1 - F.col("total") / F.col("n")).otherwise(F.lit(1.0)).alias("score"), "n")


def _one_way_in_tasks(nodes: DataFrame, edges: DataFrame, other_edges: DataFrame, match: DataFrame) -> DataFrame:
    """Over all pairs of two graphs that fit a task: each task has both and the matches, and sums over the sources dealt to it, so
    that no pair is ever a row."""
    sources = checkpoint(graph.degrees(nodes, edges).where("degree > 0").select("node_id"))
    spread = graph.spread_of(sources)
    part = F.pmod(F.xxhash64("node_id"), F.lit(spread))
    one = lambda frame, kind, a, b, w: frame.select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), w.cast("double").alias("length"))
    every = one(edges, 0, "src", "dst", F.col("length")).unionByName(one(other_edges, 1, "src", "dst", F.col("length"))).unionByName(one(match, 2, "node_id", "match", F.lit(0)))
    held = every.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))

    def kernel(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        here, there, known = (rows[rows["kind"] == k] for k in (0, 1, 2))
        near, far = graph._adjacency(here), graph._adjacency(there)
        twin = dict(zip(known["src"].tolist(), known["dst"].tolist(), strict=True))
        total, n = 0.0, 0
        for s in asked["node_id"].tolist():
            other = graph._reach(far, twin[s]) if s in twin else {}
            for t, (d, _) in graph._reach(near, s).items():
                if s < t and d > 0:
                    at = other.get(twin.get(t))
                    total += 1.0 if at is None else min(1.0, abs(d - at[0]) / d)
                    n += 1
        return pd.DataFrame({"total": [total], "n": [n]})

    return _score(sources.withColumn("_part", part).groupBy("_part").cogroup(held.groupBy("_deal")).applyInPandas(kernel, "total double, n long"))


def apls(nodes: DataFrame, edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame, tolerance: float = SNAP, most: int | None = 500, seed: str = "0", known: Pairing | None = None) -> DataFrame:
    """One row: apls (the two ways' mean by their pairs), apls_there, apls_back, n_there, n_back, matched nodes."""
    known = known or Pairing(nodes, edges, found_nodes, found_edges, tolerance)
    there, back = known.there, known.back
    small = edges.count() <= graph.TASK_EDGES and found_edges.count() <= graph.TASK_EDGES
    ways, found_ways = (known.ways, known.found_ways) if most is None and not small else (None, None)
    if most is None and small:
        found = _by_levels([(nodes, edges, there), (found_nodes, found_edges, back)], known.held)
        a, b = found or (_one_way_in_tasks(nodes, edges, found_edges, there), _one_way_in_tasks(found_nodes, found_edges, edges, back))
    else:
        a = apls_one_way(nodes, edges, found_edges, there, most, seed, ways, found_ways)
        b = apls_one_way(found_nodes, found_edges, edges, back, most, seed, found_ways, ways)
    a, b = a.select(F.col("score").alias("apls_there"), F.col("n").alias("n_there")), b.select(F.col("score").alias("apls_back"), F.col("n").alias("n_back"))
    total = F.col("n_there") + F.col("n_back")
    mean = F.when(total > 0, (F.col("apls_there") * F.col("n_there") + F.col("apls_back") * F.col("n_back")) / total).otherwise(F.lit(1.0))
    counts = there.agg(F.count("*").alias("matched")).crossJoin(back.agg(F.count("*").alias("matched_found")))
    return a.crossJoin(b).crossJoin(counts).select(mean.alias("apls"), "apls_there", "apls_back", "n_there", "n_back", "matched", "matched_found")


def _joined(pairs: DataFrame, match: DataFrame, parts: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `joined`: both ends are matched, and the matches hang together."""
    c = parts.select("node_id", "component")
    x, y = c.select(F.col("node_id").alias("_ma"), F.col("component").alias("_ca")), c.select(F.col("node_id").alias("_mb"), F.col("component").alias("_cb"))
    both = _matched(pairs, match, a, b).join(x, "_ma", "left").join(y, "_mb", "left")
    return both.withColumn("joined", F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).drop("_ma", "_mb", "_ca", "_cb")


def breaks_per_km(nodes: DataFrame, edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame, tolerance: float = SNAP, known: Pairing | None = None) -> DataFrame:
    """One row: true edges whose ends do not hang together in the found graph, true kilometres, breaks for each."""
    known = known or Pairing(nodes, edges, found_nodes, found_edges, tolerance)
    told = _joined(edges.select("src", "dst", "length"), known.there, known.found_parts, "src", "dst")
    sums = told.agg(F.count_if(~F.col("joined")).alias("breaks"), (F.coalesce(F.sum("length"), F.lit(0.0)) / 1000).alias("km"))
    return sums.withColumn("breaks_per_km", F.when(F.col("km") > 0, F.col("breaks") / F.col("km")).otherwise(F.lit(0.0)))


def connectivity(nodes: DataFrame, edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame, tolerance: float = SNAP, most: int | None = 1000, seed: str = "0", conditional: bool = False, known: Pairing | None = None) -> DataFrame:
    """One row: ratio of pairs that hang together in both graphs to all pairs, or (conditional) to those that do in the true one."""
    n = nodes.count()
    known = known or Pairing(nodes, edges, found_nodes, found_edges, tolerance)
    if most is None or n * (n - 1) // 2 <= most:
        return _connectivity_of_all(known, conditional, n)
    pairs = checkpoint(node_pairs(nodes.select("node_id"), most, seed))
    true = graph.reachable(nodes, edges, pairs)
    told = _joined(true, known.there, known.found_parts, "origin", "dest")
    whole = F.count_if("connected") if conditional else F.count("*")
    sums = told.agg(whole.alias("n_pairs"), F.count_if(F.col("connected") & F.col("joined")).alias("n_reachable"))
    return sums.withColumn("ratio", F.when(F.col("n_pairs") > 0, F.col("n_reachable") / F.col("n_pairs")).otherwise(F.lit(1.0)))


def _connectivity_of_all(known: Pairing, conditional: bool, n: int) -> DataFrame:
    """Connectivity over all pairs, from the sizes of parts: nodes that share a true and a found part hang together in both."""
    true = known.parts
    found = known.found_parts.select(F.col("node_id").alias("match"), F.col("component").alias("there"))
    placed = true.join(known.there.join(found, "match"), "node_id").groupBy("component", "there").agg(F.count("*").alias("k"))
    half = (F.col("k") * (F.col("k") - 1) / 2).cast("long")
    both = placed.agg(F.coalesce(F.sum(half), F.lit(0)).alias("n_reachable"))
    within = true.groupBy("component").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(half), F.lit(0)).alias("n_pairs"))
    whole = within if conditional else within.select(F.lit(n * (n - 1) // 2).cast("long").alias("n_pairs"))
    return whole.crossJoin(both).withColumn("ratio", F.when(F.col("n_pairs") > 0, F.col("n_reachable") / F.col("n_pairs")).otherwise(F.lit(1.0)))


def matched_length(edges: DataFrame, match: DataFrame, other_parts: DataFrame) -> DataFrame:
    """(matched, total): length of edges whose matched ends hang together in the other graph, and of all."""
    told = _joined(edges.select("src", "dst", "length"), match, other_parts, "src", "dst")
    return told.agg(F.coalesce(F.sum(F.when(F.col("joined"), F.col("length"))), F.lit(0.0)).alias("matched"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("total"))


def ccq(nodes: DataFrame, edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame, tolerance: float = SNAP, known: Pairing | None = None) -> DataFrame:
    """One row: completeness, correctness, quality by length."""
    known = known or Pairing(nodes, edges, found_nodes, found_edges, tolerance)
    a = matched_length(edges, known.there, known.found_parts).withColumnsRenamed({"matched": "mt", "total": "tt"})
    b = matched_length(found_edges, known.back, known.parts).withColumnsRenamed({"matched": "mp", "total": "tp"})
    share = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    return a.crossJoin(b).select(
        share(F.col("mt"), F.col("tt")).alias("completeness"), share(F.col("mp"), F.col("tp")).alias("correctness"), share(F.col("mt"), F.col("tt") + F.col("tp") - F.col("mt")).alias("quality")
    )


def report(nodes: DataFrame, edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame, tolerance: float = SNAP, most: int | None = 500, seed: str = "0") -> DataFrame:
    """All measures in one row, rounded as reported; connectivity takes twice as many pairs."""
    known = Pairing(nodes, edges, found_nodes, found_edges, tolerance)
    a = apls(nodes, edges, found_nodes, found_edges, tolerance, most, seed, known)
    b = breaks_per_km(nodes, edges, found_nodes, found_edges, tolerance, known)
    c = connectivity(nodes, edges, found_nodes, found_edges, tolerance, None if most is None else 2 * most, seed, known=known)
    d = ccq(nodes, edges, found_nodes, found_edges, tolerance, known)
    r = lambda n, k: F.round(n, k).alias(n)
    return a.crossJoin(b).crossJoin(c).crossJoin(d).select(
        r("apls", 4), r("apls_there", 4), r("apls_back", 4), "breaks", r("km", 3), r("breaks_per_km", 4), r("ratio", 4), "n_pairs", r("completeness", 4), r("correctness", 4), r("quality", 4)
    )
