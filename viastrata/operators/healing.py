"""Repair of road graphs: which gaps between parts are bridged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.cluster import checkpoint
from . import graph, spatial

#: Metres up to which gaps are bridged at all, without question, or if aligned; look-ahead and how near two look-aheads
#: must come; weights and the score to reach; support that a sample must show; samples along and across; half the corridor.
GAP, SHORT, MEDIUM = 50.0, 15.0, 30.0
LOOKAHEAD, MEET = 40.0, 15.0
TOPOLOGY, EVIDENCE, LEAST_SCORE = 0.85, 0.15, 0.40
SUPPORT, ALONG, ACROSS, HALF_WIDTH = 0.3, 8, 3, 2.0


def look_ahead(nodes: DataFrame, edges: DataFrame, metres: float = LOOKAHEAD, extrapolate: bool = False) -> DataFrame:
    """(node_id, px, py): some metres along the node's road whose ends are farthest apart; the node itself where its roads
    have no geometry. extrapolate: as far on the other side of the node, where the road would go on."""
    here = nodes.select(F.col("node_id").alias("u"), "x", "y")
    lines = graph.symmetric(edges, "geometry").where(F.size("geometry") >= 2).join(here, "u")
    lines = lines.withColumn("line", spatial.oriented(F.col("geometry"), F.col("x"), F.col("y")))
    first, last = F.get("line", 0), F.get("line", F.size("line") - 1)
    chord = F.hypot(last["x"] - first["x"], last["y"] - first["y"])
    best = lines.groupBy("u").agg(F.max_by(F.col("line"), F.struct(chord, -F.col("v"))).alias("line"))
    ahead = best.select(F.col("u").alias("node_id"), spatial.point_along(F.col("line"), metres).alias("p"))
    found = nodes.join(ahead, "node_id", "left")
    place = lambda c: F.when(F.col("p").isNull(), F.col(c)).otherwise(2 * F.col(c) - F.col(f"p.{c}") if extrapolate else F.col(f"p.{c}"))
    return found.select("node_id", place("x").alias("px"), place("y").alias("py"))


def alignment(distance: Column, metres: float = LOOKAHEAD, meet: float = MEET) -> Column:
    return F.when(distance <= meet, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance / metres))


def bilinear(points: DataFrame, raster: DataFrame, value: str, height: int, width: int, keys: list[str] | None = None) -> DataFrame:
    """Points (keys, row, col as real numbers, …) with the value there of the raster of their keys, between four cells; places
    outside count as the border. Without keys the raster is one."""
    keys = keys or []
    r, c = S.clipped(F.col("row"), 0.0, height - 1.0), S.clipped(F.col("col"), 0.0, width - 1.0)
    at = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_r", r).withColumn("_c", c)
    at = checkpoint(at.withColumn("_r0", F.floor("_r").cast("int")).withColumn("_c0", F.floor("_c").cast("int")))
    fr, fc = F.col("_r") - F.col("_r0"), F.col("_c") - F.col("_c0")
    corners = F.array(
        *(
            F.struct(F.least(F.col("_r0") + i, F.lit(height - 1)).alias("i"), F.least(F.col("_c0") + j, F.lit(width - 1)).alias("j"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w"))
            for i in (0, 1)
            for j in (0, 1)
        )
    )
    cells = at.select(*keys, "_id", F.explode(corners).alias("_k")).select(*keys, "_id", F.col("_k.i").alias("_i"), F.col("_k.j").alias("_j"), F.col("_k.w").alias("w"))
    held = raster.select(*keys, F.col("row").alias("_i"), F.col("col").alias("_j"), F.col(value).cast("double").alias("_v"))
    sums = cells.join(held, [*keys, "_i", "_j"]).groupBy("_id").agg(F.sum(F.col("w") * F.col("_v")).alias(value))
    return at.join(sums, "_id").drop("_id", "_r", "_c", "_r0", "_c0")


def line_samples(lines: DataFrame, n: int = ALONG, across: int = 1, half_width: float = 0.0) -> DataFrame:
    """Lines (x0, y0, x1, y1, …) with places k = 0..n-1 along each, and m across it: wx, wy. A line of no length has one place across."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.hypot(dx, dy)
    spread = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    spread = spread.where((size > 0) | (F.col("m") == 0))
    share = F.col("k") / max(n - 1, 1)
    side = (F.col("m") * (2 / (across - 1)) - 1) * half_width if across > 1 else F.lit(0.0)
    off = F.when(size > 0, side / size).otherwise(F.lit(0.0))
    return spread.withColumn("wx", F.col("x0") + dx * share - dy * off).withColumn("wy", F.col("y0") + dy * share + dx * off)


def corridor(lines: DataFrame, raster: DataFrame, value: str, height: int, width: int, grid: tuple[float, float, float] | None = None, n: int = ALONG, across: int = ACROSS, half_width: float = HALF_WIDTH, reduce: str = "median", keys: list[str] | None = None) -> DataFrame:
    """(…line columns, k, value): at each place along the line the median or max across it. grid: origin x, y and cell size of a
    north-up raster; None: places are cells already. keys: columns of lines and raster that tell rasters apart."""
    at = line_samples(lines, n, across, half_width)
    if grid is None:
        at = at.withColumn("row", F.col("wy")).withColumn("col", F.col("wx"))
    else:
        row, col = S.world_to_pixel(F.col("wx"), F.col("wy"), *(F.lit(v) for v in grid), F.lit(height))
        at = at.withColumn("row", row).withColumn("col", col)
    found = bilinear(at, raster, value, height, width, keys)
    f = F.median if reduce == "median" else F.max
    return found.groupBy(*lines.columns, "k").agg(f(value).alias(value))


def evidence(lines: DataFrame, raster: DataFrame, value: str, height: int, width: int, grid: tuple[float, float, float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Lines with `occlusion`: the share of places along that a corridor's median supports."""
    seen = corridor(lines, raster, value, height, width, grid, keys=keys)
    return seen.groupBy(*lines.columns).agg(F.avg((F.col(value) >= SUPPORT).cast("double")).alias("occlusion"))


def gate(distance: Column, aligned: Column, occlusion: Column, gap: float = GAP) -> Column:
    """Why a bridge is not built; null: it may be."""
    score = TOPOLOGY * (0.5 * F.greatest(F.lit(0.0), 1 - distance / gap) + 0.5 * aligned) + EVIDENCE * occlusion
    short = (distance <= SHORT) | ((distance <= MEDIUM) & (aligned >= 0.5))
    return F.when(distance > gap, "gap_distance").when(short | (score >= LEAST_SCORE), F.lit(None).cast("string")).otherwise("soft_score")


def candidates(
    nodes: DataFrame, edges: DataFrame, raster: DataFrame | None = None, height: int = 0, width: int = 0, grid: tuple[float, float, float] | None = None, radius: float = GAP,
    gap: float = GAP, extrapolate: bool = False, least_occlusion: float | None = None, most_angle: float | None = None, value: str = "conf",
) -> DataFrame:
    """(u, v, distance, angle_deviation, occlusion, passed, reason) of stubs in different parts that are near. edges may have
    `geometry`. Without a raster there is no evidence: occlusion 0. least_occlusion, most_angle: further conditions, off by default."""
    parts = checkpoint(graph.components(nodes, edges))
    some = checkpoint(graph.stubs(nodes, edges).join(nodes, "node_id"))
    pairs = spatial.radius_pairs(some.select("node_id", "x", "y"), radius)
    a, b = parts.select(F.col("node_id").alias("u"), F.col("component").alias("_a")), parts.select(F.col("node_id").alias("v"), F.col("component").alias("_b"))
    apart = pairs.join(a, "u").join(b, "v").where("_a <> _b").drop("_a", "_b")
    with_lines = edges if "geometry" in edges.columns else edges.withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))
    ahead = look_ahead(nodes, with_lines, extrapolate=extrapolate)
    pu, pv = ahead.select(F.col("node_id").alias("u"), F.col("px").alias("_x0"), F.col("py").alias("_y0")), ahead.select(F.col("node_id").alias("v"), F.col("px").alias("_x1"), F.col("py").alias("_y1"))
    told = apart.join(pu, "u").join(pv, "v").withColumn("aligned", alignment(F.hypot(F.col("_x0") - F.col("_x1"), F.col("_y0") - F.col("_y1"))))
    told = checkpoint(told.select("u", "v", "distance", "aligned"))
    if raster is None:
        told = told.withColumn("occlusion", F.lit(0.0))
    else:
        xu, xv = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0")), nodes.select(F.col("node_id").alias("v"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        lines = told.select("u", "v").join(xu, "u").join(xv, "v")
        told = told.join(evidence(lines, raster, value, height, width, grid).select("u", "v", "occlusion"), ["u", "v"])
    told = told.withColumn("angle_deviation", 180 * (1 - F.col("aligned"))).withColumn("reason", gate(F.col("distance"), F.col("aligned"), F.col("occlusion"), gap))
    if least_occlusion is not None:
        told = told.withColumn("reason", F.coalesce("reason", F.when(F.col("occlusion") < least_occlusion, "occlusion")))
    if most_angle is not None:
        told = told.withColumn("reason", F.coalesce("reason", F.when(F.col("angle_deviation") > most_angle, "angle")))
    return told.select("u", "v", "distance", "angle_deviation", "occlusion", F.col("reason").isNull().alias("passed"), "reason")


def heal(nodes: DataFrame, edges: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(bridges, considered): the edges to add, and all candidates with `reason` also for those that earlier bridges make
    redundant. One pass is enough: bridges change no candidate's score and bring no new candidate."""
    considered = checkpoint(candidates(nodes, edges, **options))
    parts = checkpoint(graph.components(nodes, edges))
    chosen = checkpoint(graph.spanning_forest(considered.where("passed").select("u", "v", F.col("distance").alias("weight")), parts))
    bridges = chosen.join(considered, ["u", "v"]).select(
        F.col("u").alias("src"), F.col("v").alias("dst"), F.col("distance").alias("length"), F.lit(False).alias("bridge"), F.lit(0).alias("layer"),
        F.lit(True).alias("synthetic"), F.col("occlusion").alias("healing_confidence"),
    )
    told = considered.join(chosen.select("u", "v", F.lit(True).alias("added")), ["u", "v"], "left")
    reason = F.when(F.col("passed") & F.col("added").isNull(), "redundant_after_earlier_bridge").otherwise(F.col("reason"))
    return bridges, told.withColumn("reason", reason).withColumn("added", F.coalesce("added", F.lit(False)))


def tally(considered: DataFrame) -> DataFrame:
    """(reason, n) of rejected candidates."""
    return considered.where("not added").groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def against_truth(bridges: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: tp, fp, fn of bridges as unordered pairs, precision and recall (null where nothing is counted)."""
    pair = lambda df: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = pair(bridges).withColumn("p", F.lit(1)).join(pair(gaps).withColumn("t", F.lit(1)), ["a", "b"], "full")
    sums = both.agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count_if(F.expr("t is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    return sums.withColumn("precision", F.try_divide("tp", F.expr("tp + fp"))).withColumn("recall", F.try_divide("tp", F.expr("tp + fn")))
