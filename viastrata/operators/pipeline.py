"""The whole way from a broken graph, or a raster, to a report on what it withstands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.cluster import checkpoint
from ..sources import files
from . import graph, healing, resilience, tracing


@dataclass
class Assessment:
    """Frames: nodes, edges (healed, with z_level), bridges, considered candidates, criticality, scenarios, results."""

    nodes: DataFrame
    edges: DataFrame
    bridges: DataFrame
    considered: DataFrame
    criticality: DataFrame
    scenarios: DataFrame
    results: DataFrame

    def report(self, evaluation: DataFrame | None = None) -> DataFrame:
        """One row of JSON."""
        parts = graph.components(self.nodes, self.edges).agg(F.countDistinct("component").alias("n_components"))
        figures = self.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(self.edges.agg(F.count("*").alias("n_edges"))).crossJoin(parts).crossJoin(self.bridges.agg(F.count("*").alias("n_bridges")))
        top = resilience.top_nodes(self.criticality.join(self.nodes, "node_id"), "composite", 10).select("node_id", F.round("composite", 4).alias("score"), "x", "y")
        return files.report(figures, healing.tally(self.considered), top, resilience.record(self.results), evaluation)

    def summary(self) -> DataFrame:
        """Lines of text, one for each scenario."""
        sizes = self.scenarios.groupBy("scenario").agg(F.count("*").cast("int").alias("n_disabled"))
        return files.summary_lines(self.results.join(sizes, "scenario"))


def assess(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame | None = None, od: DataFrame | None = None, population: str = "population", flood: list | None = None, alpha: float = 0.1, **heal_options) -> Assessment:
    """z-levels, healing, criticality, scenarios (default: the most critical nodes, some others, a flood), simulation. edges:
    src, dst, length, bridge, layer; tunnel and geometry if known. Nodes without people count none."""
    if population not in nodes.columns:
        nodes = nodes.withColumn(population, F.lit(0).cast("long"))
    tunnel = F.col("tunnel") if "tunnel" in edges.columns else F.lit(False)
    level = S.z_level(F.col("bridge"), tunnel, F.col("layer"))
    nodes, edges = checkpoint(nodes), checkpoint(edges.withColumn("z_level", level).withColumn("synthetic", F.lit(False)))
    bridges, considered = healing.heal(nodes, edges, **heal_options)
    healed = checkpoint(edges.unionByName(bridges, allowMissingColumns=True))
    scores = checkpoint(graph.criticality(nodes, healed.select("src", "dst", "length"), alpha))
    cases = checkpoint(scenarios if scenarios is not None else resilience.default_scenarios(nodes, scores, flood=flood))
    pairs = checkpoint(od if od is not None else resilience.sample_pairs(nodes, healed))
    results = checkpoint(resilience.simulate(nodes, healed.select("src", "dst", "length"), cases, pairs, population))
    return Assessment(nodes, healed, bridges, considered, scores, cases, results)


def of_tile(pixels: DataFrame, height: int, width: int, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (node_id, x, y; src, dst, length, bridge, layer, geometry) traced from one tile's raster."""
    roads = checkpoint(tracing.graphs(pixels, **options))
    ends = roads.select(F.col("src").alias("node_id"), F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(roads.select(F.col("dst").alias("node_id"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    edges = roads.where("src <> dst").select("src", "dst", "length", F.lit(False).alias("bridge"), F.lit(0).alias("layer"), "n_px", "geometry")
    return ends.distinct(), edges


def batch_summary(results: DataFrame, by: str = "tile_id") -> DataFrame:
    """One row for each tile of a batch: scenarios, least and mean index."""
    return results.groupBy(by).agg(F.count("*").alias("n_scenarios"), F.round(F.min("index"), 4).alias("least_index"), F.round(F.avg("index"), 4).alias("mean_index"))
