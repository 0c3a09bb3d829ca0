"""Made-up cities and rasters with known gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph, rasters, spatial


def city(spark: SparkSession, rows: int = 6, cols: int = 6, cell: float = 90.0, diagonal: bool = True) -> tuple[DataFrame, DataFrame]:
    """A grid of streets with fewer people away from the middle, and an elevated road across. No chance in it."""
    r, c = F.expr(f"id div {cols}"), F.col("id") % cols
    away = F.hypot(r - (rows - 1) / 2, c - (cols - 1) / 2)
    nodes = spark.range(rows * cols).select(F.col("id").alias("node_id"), (c * cell).cast("double").alias("x"), (r * cell).cast("double").alias("y"), F.greatest(F.lit(50), F.floor(800 - away * 120)).cast("long").alias("population"))
    at = spark.range(rows * cols).select("id", r.alias("r"), c.alias("c"))
    edge = lambda by, flag, ok: at.where(ok).select(F.col("id").alias("src"), (F.col("id") + by).alias("dst"), F.lit(flag).alias("bridge"))
    edges = edge(1, False, F.col("c") < cols - 1).unionByName(edge(cols, False, F.col("r") < rows - 1))
    if diagonal and cols > 1:
        edges = edges.unionByName(edge(cols + 1, True, (F.col("r") == F.col("c")) & (F.col("r") < min(rows, cols) - 1)))
    length = F.when(F.col("bridge"), float((2 * cell * cell) ** 0.5)).otherwise(float(cell))
    return nodes, edges.withColumn("length", length).withColumn("layer", F.col("bridge").cast("int"))


def occlude(nodes: DataFrame, edges: DataFrame, start: int, size: int = 4) -> tuple[DataFrame, DataFrame]:
    """(edges left, gaps): the roads into a cluster around a node go; gaps have ends, length and bearing."""
    inside = graph.cluster(nodes, edges, start, size)
    cut = graph.boundary_edges(edges, inside)
    if cut.isEmpty():
        raise ValueError("the cluster has no roads to the rest")
    ends = rasters.with_ends(cut, nodes)
    gaps = ends.select("src", "dst", "x0", "y0", "x1", "y1", "length", S.bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bearing"))
    return graph.without_edges(edges, cut.select("src", "dst")), gaps


def predicted(nodes: DataFrame, left: DataFrame, gaps: DataFrame, size: float = 2.0, brush: int = 2, background: float = 0.03, road: float = 0.92, gap_conf: float = 0.55, noise: float = 0.0, seed: int = 11) -> DataFrame:
    """(row, col, prob, conf) of a raster on which roads are likely, gaps are dim but plausible, the rest is background; noise
    is the spread of a seeded hash. The raster's frame is 20 cells wider than the nodes on each side."""
    spark = nodes.sparkSession
    x0, x1, y0, y1 = (float(v) for v in nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    pad = 20 * size
    w, h = (-(-(b - a + 2 * pad) // size) for a, b in ((x0, x1), (y0, y1)))
    h, w = int(h), int(w)
    place = lambda x, y: S.world_to_pixel(F.col(x), F.col(y), F.lit(x0 - pad), F.lit(y0 - pad), F.lit(size), F.lit(h))

    def lines(ends: DataFrame, value: float) -> DataFrame:
        (ra, ca), (rb, cb) = place("x0", "y0"), place("x1", "y1")
        return ends.select(ra.alias("r0"), ca.alias("c0"), rb.alias("r1"), cb.alias("c1"), F.lit(value).alias("value"))

    roads = rasters.with_ends(left, nodes)
    drawn = lambda parts: spatial_max([spatial.paint_lines(lines(e, v), b, "value", h, w) for e, v, b in parts])
    prob = drawn([(roads, road, brush), (gaps, background + 0.1, brush)]).withColumnRenamed("value", "p")
    conf = drawn([(roads, 0.15, brush), (gaps, gap_conf, brush + 1)]).withColumnRenamed("value", "c")
    grid = spark.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    rough = lambda k, mean: S.clipped(mean + noise * (F.pmod(F.xxhash64(F.lit(seed + k), "row", "col"), F.lit(2001)) / 1000 - 1), 0.0, 1.0)
    both = grid.join(prob, ["row", "col"], "left").join(conf, ["row", "col"], "left")
    return both.select("row", "col", F.greatest(rough(0, background), F.coalesce("p", F.lit(0.0))).alias("prob"), F.greatest(rough(1, 0.05), F.coalesce("c", F.lit(0.0))).alias("conf"))


def spatial_max(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("row", "col").agg(F.max("value").alias("value"))
