"""Points, lines and areas: joins by distance over grid cells, polylines as arrays of points, buffers as raster cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import checkpoint
from . import rasters

#: Points of a grid cell above which a radius join deals the cell's points to several tasks.
CELL_POINTS = 4096


def _cell(x: str, y: str, size: float) -> list[Column]:
    return [F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")]


def _around(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Points in their own cell and the eight around it."""
    step = F.sequence(F.lit(-1), F.lit(1))
    near = points.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    return near.withColumn("cx", F.floor(F.col(x) / size) + F.col("_dx")).withColumn("cy", F.floor(F.col(y) / size) + F.col("_dy")).drop("_dx", "_dy")


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(u, v, distance) of points (node_id, x, y) at most a radius apart, u < v."""
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    a = points.select(F.col("node_id").alias("u"), F.col("x").alias("xu"), F.col("y").alias("yu"))
    b = points.select(F.col("node_id").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    near = a.select("*", *_cell("xu", "yu", radius)).join(_around(b, "xv", "yv", radius), ["cx", "cy"]).where("u < v")
    return near.withColumn("distance", F.hypot(F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv"))).where(F.col("distance") <= radius).select("u", "v", "distance")


def nearest_within(points: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """(node_id, match, distance): of each point the nearest other within the tolerance, the least id of equals; unmatched points go."""
    a = points.select("node_id", "x", "y", *_cell("x", "y", tolerance))
    b = _around(others.select(F.col("node_id").alias("match"), F.col("x").alias("xo"), F.col("y").alias("yo")), "xo", "yo", tolerance)
    near = a.join(b, ["cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("xo"), F.col("y") - F.col("yo"))).where(F.col("distance") <= tolerance)
    return near.groupBy("node_id").agg(F.min(F.struct("distance", "match")).alias("m")).select("node_id", "m.match", "m.distance")


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is in one of the rings (array<array<struct<x,y>>>), by the crossings of a ray to the right."""

    def crossed(ring: Column) -> Column:
        ahead = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
        hits = F.zip_with(ring, ahead, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
        return F.size(F.filter(hits, lambda h: h)) % 2 == 1

    return F.exists(rings, crossed)


def points_in_rings(points: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Points in one of the rings; those outside the rings' box are passed over first."""
    xs, ys = ([p[k] for ring in rings for p in ring] for k in (0, 1))
    if not xs:
        return points.limit(0)
    boxed = points.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    literal = F.array(*(F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring)) for ring in rings))
    return boxed.where(in_rings(F.col("x"), F.col("y"), literal))


# Polylines: array<struct<x: double, y: double>>.


def segments(points: Column) -> Column:
    """Array of (x0, y0, x1, y1) of neighbouring points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))


def length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda s, e: s + F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]))


def oriented(points: Column, x: Column, y: Column) -> Column:
    """The line turned to start at the end nearer to a place."""
    first, last = F.get(points, 0), F.get(points, F.size(points) - 1)
    return F.when(F.hypot(last["x"] - x, last["y"] - y) < F.hypot(first["x"] - x, first["y"] - y), F.reverse(points)).otherwise(points)


def point_along(points: Column, metres: float) -> Column:
    """struct<x, y>: the place so far along the line, its end if it is shorter."""
    start = F.struct(F.lit(0.0).alias("run"), F.get(points, 0)["x"].alias("x"), F.get(points, 0)["y"].alias("y"), F.lit(False).alias("there"))

    def walk(s: Column, e: Column) -> Column:
        step = F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"])
        share = F.when(step > 0, (metres - s["run"]) / step).otherwise(F.lit(1.0))
        stop = ~s["there"] & (s["run"] + step >= metres)
        x = F.when(s["there"], s["x"]).when(stop, e["x0"] + (e["x1"] - e["x0"]) * share).otherwise(e["x1"])
        y = F.when(s["there"], s["y"]).when(stop, e["y0"] + (e["y1"] - e["y0"]) * share).otherwise(e["y1"])
        return F.struct((s["run"] + step).alias("run"), x.alias("x"), y.alias("y"), (s["there"] | stop).alias("there"))

    return F.aggregate(segments(points), start, walk, lambda s: F.struct(s["x"], s["y"]))


def tangent(points: Column, x: Column, y: Column, metres: float = 15.0) -> Column:
    """Degrees (0 up to 180) at which the line leaves a place at one of its ends, over some metres; null for lines of one point."""
    line = oriented(points, x, y)
    ahead, first = point_along(line, metres), F.get(line, 0)
    angle = F.pmod(F.degrees(F.atan2(ahead["y"] - first["y"], ahead["x"] - first["x"])), F.lit(180.0))
    return F.when(F.size(points) >= 2, angle)


def local_tangents(nodes: DataFrame, edges: DataFrame, metres: float = 15.0) -> DataFrame:
    """(node_id, neighbour, bearing) of each edge at each of its ends; edges without geometry go straight."""
    from .graph import symmetric

    ends = symmetric(edges, "geometry")
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("xu"), F.col("y").alias("yu"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    both = ends.join(a, "u").join(b, "v")
    chord = F.array(F.struct(F.col("xu").alias("x"), F.col("yu").alias("y")), F.struct(F.col("xv").alias("x"), F.col("yv").alias("y")))
    line = F.when(F.size(F.coalesce("geometry", F.array().cast("array<struct<x:double,y:double>>"))) >= 2, F.col("geometry")).otherwise(chord)
    return both.select(F.col("u").alias("node_id"), F.col("v").alias("neighbour"), tangent(line, F.col("xu"), F.col("yu"), metres).alias("bearing"))


def _gaps_to(points: np.ndarray, a: np.ndarray, b: np.ndarray, to_segment: bool) -> np.ndarray:
    d = b - a
    square = float(d @ d)
    if square == 0:
        return np.hypot(*(points - a).T)
    along = (points - a) @ d / square
    if to_segment:
        along = np.clip(along, 0, 1)
        return np.hypot(*(points - a - along[:, None] * d).T)
    return np.abs((points - a) @ np.array([-d[1], d[0]])) / np.sqrt(square)


def _kept(points: np.ndarray, tolerance: float, to_segment: bool) -> np.ndarray:
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        far = _gaps_to(points[a + 1 : b], points[a], points[b], to_segment)
        k = int(far.argmax())
        if far[k] >= tolerance if to_segment else far[k] > tolerance:
            k += a + 1
            keep[k] = True
            spans += [(a, k), (k, b)]
    return keep


def simplified(points: Column, tolerance: float, to_segment: bool = False) -> Column:
    """Line with the points that deviate (Douglas and Peucker 1973). By the distance to the endless chord, over the tolerance; or
    to_segment: to the chord itself, at the tolerance or over."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def simplify(batch: pd.Series) -> pd.Series:
        out = []
        for line in batch:
            xy = np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)
            kept = xy[_kept(xy, tolerance, to_segment)]
            out.append([{"x": x, "y": y} for x, y in kept.tolist()])
        return pd.Series(out, dtype=object)

    return simplify(points)


def midpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return rasters.with_ends(edges, nodes).select("src", "dst", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))


# Lines to cells.


def buffer_cells(lines: DataFrame, size: float, flat: bool = False) -> DataFrame:
    """(row, col) of the cells whose middles are at most half_width from a line's segment (x0, y0, x1, y1, half_width). Ends
    are round, or flat: cells beside an end are left out. Each segment looks at the cells of its own box only."""
    reach = F.col("half_width")
    box = lambda a, b, s: F.sequence(F.floor((F.least(a, b) - reach) / s).cast("long"), F.ceil((F.greatest(a, b) + reach) / s).cast("long"))
    cells = lines.withColumn("row", F.explode(box(F.col("y0"), F.col("y1"), size))).withColumn("col", F.explode(box(F.col("x0"), F.col("x1"), size)))
    px, py = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    share = F.when(square > 0, ((px - F.col("x0")) * dx + (py - F.col("y0")) * dy) / square).otherwise(F.lit(0.0))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    gap = F.hypot(px - F.col("x0") - held * dx, py - F.col("y0") - held * dy)
    inside = gap <= reach
    if flat:
        inside = inside & share.between(0, 1)
    return cells.where(inside).select("row", "col").distinct()


def paint_lines(lines: DataFrame, half: int, value: str = "value", height: int | None = None, width: int | None = None) -> DataFrame:
    """(row, col, value): lines (r0, c0, r1, c1, value) drawn with a square brush of 2 half + 1 cells; of values that meet the
    greatest stays; cells off the raster are left out."""
    n = F.floor(F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))).cast("int")
    steps = lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    share = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(0.0))
    at = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * share).cast("int")
    reach = F.sequence(F.lit(-half), F.lit(half))
    dots = steps.select(at("r0", "r1").alias("row"), at("c0", "c1").alias("col"), value).groupBy("row", "col").agg(F.max(value).alias(value))
    dots = dots.withColumn("dr", F.explode(reach)).withColumn("dc", F.explode(reach)).select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), value)
    if height is not None:
        dots = dots.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return dots.groupBy("row", "col").agg(F.max(value).alias(value))


def filled_cells(rings: DataFrame, size: float) -> DataFrame:
    """(row, col) of the cells whose middles are in an area (rings: array<array<struct<x,y>>>), each area in its own box."""
    every = F.flatten("rings")
    low = lambda c: F.floor(F.array_min(F.transform(every, lambda p: p[c])) / size).cast("long")
    high = lambda c: F.ceil(F.array_max(F.transform(every, lambda p: p[c])) / size).cast("long")
    some = rings.where(F.size(F.flatten("rings")) > 2)
    cells = some.withColumn("row", F.explode(F.sequence(low("y"), high("y")))).withColumn("col", F.explode(F.sequence(low("x"), high("x"))))
    return cells.where(in_rings((F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size, F.col("rings"))).select("row", "col").distinct()


def density(nodes: DataFrame, weight: str, steps: int = 90, sigma: float = 0.05, pad: float = 0.12) -> DataFrame:
    """(i, j, intensity): weights spread as Gaussians on a steps x steps grid over the points' box, the peak 1. sigma and pad
    are shares of the box's diagonal. All 0 if no weight is above 0. As a Gaussian is a product of one in x and one in y, a
    batch of points is one matrix product, and each task sends one grid."""
    ends = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.max(weight)).first()
    spark = nodes.sparkSession
    if ends[4] is None or ends[4] <= 0:
        cells = spark.range(steps * steps)
        return cells.select(F.expr(f"cast(id div {steps} as int)").alias("i"), (F.col("id") % steps).cast("int").alias("j"), F.lit(0.0).alias("intensity"))
    x0, x1, y0, y1 = (float(v) for v in ends[:4])
    diagonal = float(np.hypot(x1 - x0, y1 - y0)) or 1.0
    s, p = max(diagonal * sigma, 1e-6), diagonal * pad
    gx, gy = np.linspace(x0 - p, x1 + p, steps), np.linspace(y0 - p, y1 + p, steps)

    def spread(batches):
        grid = np.zeros((steps, steps))
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                bump = [np.exp(-((g[None, :] - part[c].to_numpy(float)[:, None]) ** 2) / (2 * s * s)) for g, c in ((gx, "x"), (gy, "y"))]
                grid += bump[1].T @ (bump[0] * part["w"].to_numpy(float)[:, None])
        i, j = np.indices(grid.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": grid.ravel()})

    grids = nodes.where(F.col(weight) != 0).select("x", "y", F.col(weight).cast("double").alias("w")).mapInPandas(spread, "i int, j int, v double")
    summed = checkpoint(grids.groupBy("i", "j").agg(F.sum("v").alias("v")))
    peak = summed.agg(F.max("v").alias("peak")).first()["peak"]
    return summed.select("i", "j", (F.col("v") / peak if peak and peak > 0 else F.lit(0.0)).alias("intensity"))
