"""Rasters as rows (tile_id, row, col, values): thresholds, metrics, texture, tiling, and kernels on whole tiles.

Statistics of tiles are aggregations; neighbourhoods within a bound are offsets exploded and summed by cell, so tiles of any size
spread over tasks. Only what follows a shape across a tile (thinning, tracing, hysteresis) runs on a whole tile at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.cluster import by_tasks, exact_quantile, few

TILE = ["tile_id"]
CELL = ["tile_id", "row", "col"]


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with x0, y0 of src and x1, y1 of dst."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.join(a, "src").join(b, "dst")


def window(pixels: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    return pixels.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def binarize(pixels: DataFrame, threshold: float) -> DataFrame:
    return pixels.where(F.col("prob") >= threshold)


def prediction(logits: DataFrame) -> DataFrame:
    """Road probabilities of logits; confidences are probabilities already."""
    return logits.withColumn("prob", S.sigmoid(F.col("logit"))).drop("logit")


def complete_tiles(pixels: DataFrame, bands: list[str], most: float = 0.01) -> DataFrame:
    """Tiles of which at most a share `most` of pixels is 0 in all bands."""
    empty = reduce(lambda a, b: a & b, [F.col(b) == 0 for b in bands])
    return pixels.groupBy(*TILE).agg(F.avg(empty.cast("double")).alias("share")).where(F.col("share") <= most).select(*TILE)


def nonempty(tiles: DataFrame, masks: DataFrame, above: int = 127) -> DataFrame:
    """Tiles with a mask value above the bound."""
    return tiles.join(masks.where(F.col("value") > above).select(*TILE).distinct(), TILE, "left_semi")


def band_stats(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(band, mean, std) over all pixels, of the population."""
    stack = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands))).alias("s")
    return pixels.select(stack).groupBy("s.band").agg(F.avg("s.v").alias("mean"), F.stddev_pop("s.v").alias("std"))


def contrast(pixels: DataFrame, band: str, factor: float) -> DataFrame:
    mean = F.avg(band).over(Window.partitionBy(*TILE))
    return pixels.withColumn(band, S.clipped((F.col(band) - mean) * factor + mean, 0.0, 255.0))


def norm_constant(raw: DataFrame, value: str, quantile: float = 0.99, stride: int = 4) -> DataFrame:
    """(norm): the quantile over every stride-th row and column; 1 if nothing there is above 0."""
    seen = exact_quantile(raw.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0)), value, quantile)
    return seen.select(F.when(F.col("most") > 0, F.col("q")).otherwise(F.lit(1.0)).alias("norm"))


def stretch(pixels: DataFrame, band: str, by: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """`stretched`: the band between two percentiles of its group as 0..255; 0 where these are equal."""
    ends = pixels.groupBy(*by).agg(F.percentile(band, F.array(F.lit(low), F.lit(high))).alias("ends")).select(*by, F.get("ends", 0).alias("lo"), F.get("ends", 1).alias("hi"))
    share = S.clipped((F.col(band) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), 0.0, 1.0)
    byte = F.when(F.col("hi") - F.col("lo") < 1e-6, 0).otherwise(F.floor(F.round(share * 255, 9)).cast("int"))
    return pixels.join(ends, by).withColumn("stretched", byte).drop("lo", "hi")


def confusion(pixels: DataFrame, by: list[str], threshold: float = 0.5, where: Column | None = None) -> DataFrame:
    """tp, fp, fn of prob >= threshold against gt, of the pixels that `where` lets in."""
    on = F.col("prob") >= threshold
    inside = F.lit(True) if where is None else where
    return pixels.groupBy(*by).agg(
        F.count_if(on & F.col("gt") & inside).alias("tp"), F.count_if(on & ~F.col("gt") & inside).alias("fp"), F.count_if(~on & F.col("gt") & inside).alias("fn")
    )


def rates(tp: Column, fp: Column, fn: Column, eps: float = 0.0) -> dict[str, Column]:
    """iou, dice, precision, recall; 0 where nothing is counted, or smoothed by eps on both sides."""
    if eps:
        return {"iou": (tp + eps) / (tp + fp + fn + eps), "dice": (2 * tp + eps) / (2 * tp + fp + fn + eps), "precision": (tp + eps) / (tp + fp + eps), "recall": (tp + eps) / (tp + fn + eps)}
    return {"iou": S.ratio(tp, tp + fp + fn), "dice": S.ratio(2 * tp, 2 * tp + fp + fn), "precision": S.ratio(tp, tp + fp), "recall": S.ratio(tp, tp + fn)}


def overlap(counts: DataFrame, eps: float = 0.0) -> DataFrame:
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), eps))


def pixel_metrics(pixels: DataFrame, threshold: float = 0.5, by: list[str] = TILE) -> DataFrame:
    """Overlap of whole tiles, and of their occluded pixels (null where a tile has none), in one pass."""
    on, gt, occ = F.col("prob") >= threshold, F.col("gt"), F.col("occ")
    sums = pixels.groupBy(*by).agg(
        F.count_if(on & gt).alias("tp"), F.count_if(on & ~gt).alias("fp"), F.count_if(~on & gt).alias("fn"), F.count_if(on & gt & occ).alias("otp"),
        F.count_if(on & ~gt & occ).alias("ofp"), F.count_if(~on & gt & occ).alias("ofn"), F.count_if(occ).alias("n_occluded"), F.count("*").alias("n"),
        F.count_if(gt & occ).alias("ogt"), F.count_if(gt).alias("n_gt"), F.count_if(on).alias("n_pred"),
    )
    some = F.col("n_occluded") > 0
    inside = {f"occluded_{k}": F.when(some, v) for k, v in rates(F.col("otp"), F.col("ofp"), F.col("ofn")).items()}
    shares = {"occluded_share": F.col("n_occluded") / F.col("n"), "occluded_share_of_gt": F.when(some, S.ratio(F.col("ogt"), F.col("n_gt"))).otherwise(F.lit(0.0))}
    return overlap(sums).withColumns(inside | shares)


def validation_summary(pixels: DataFrame, least_occluded: int = 20, eps: float = 1e-6) -> DataFrame:
    """One row over tiles: mean and median overlap, and recall on occluded roads of tiles that have enough of them."""
    both = F.col("gt") & F.col("occ")
    on = F.col("prob") >= 0.5
    tiles = pixels.groupBy(*TILE).agg(
        F.count_if(on & F.col("gt")).alias("tp"), F.count_if(on & ~F.col("gt")).alias("fp"), F.count_if(~on & F.col("gt")).alias("fn"), F.count_if(both).alias("n_occ"), F.count_if(both & on).alias("n_hit")
    )
    tiles = overlap(tiles, eps)
    return tiles.agg(F.count("*").alias("n_tiles"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.avg(F.when(F.col("n_occ") >= least_occluded, F.col("n_hit") / F.col("n_occ"))).alias("occlusion_recall"))


def occluded_ranking(pixels: DataFrame, least: int = 50, k: int = 20) -> DataFrame:
    """The k tiles with most of their road pixels occluded, of those with enough road."""
    share = F.round(F.count_if(F.col("occ") & F.col("gt")) / F.count_if("gt"), 6)
    return pixels.groupBy(*TILE).agg(share.alias("share"), F.count_if("gt").alias("n")).where(F.col("n") >= least).orderBy(F.desc("share"), *TILE).limit(k).select(*TILE, "share")


def losses(pixels: DataFrame, alpha: float = 0.7, beta: float = 0.3, smooth: float = 1.0) -> DataFrame:
    """Of each tile: Tversky loss of prob, and cross-entropy of conf weighted towards occluded pixels."""
    p, t = F.col("prob"), F.col("gt").cast("double")
    c = S.clipped(F.col("conf"), 1e-6, 1 - 1e-6)
    weight = 0.1 + 0.9 * F.col("occ").cast("double")
    tp, fp, fn = F.sum(p * t), F.sum(p * (1 - t)), F.sum((1 - p) * t)
    bce = -(t * F.log(c) + (1 - t) * F.log(1 - c))
    return pixels.groupBy(*TILE).agg((1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)).alias("tversky"), (F.sum(bce * weight) / (F.sum(weight) + 1e-6)).alias("weighted_bce"))


def neighbours(pixels: DataFrame, radius: int, values: list[Column], far: int | None = None) -> DataFrame:
    """Each pixel's values at all cells up to radius away (rows and columns apart): one explode, for sums by cell."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    spread = pixels.select("tile_id", "row", "col", *values).withColumn("dr", F.explode(reach)).withColumn("dc", F.explode(reach))
    return spread.withColumn("row", F.col("row") + F.col("dr")).withColumn("col", F.col("col") + F.col("dc"))


def dilated_max(pixels: DataFrame, radius: int, columns: list[str]) -> DataFrame:
    """The greatest value within a square around each cell, over the cells there are."""
    spread = neighbours(pixels, radius, [F.col(c) for c in columns])
    best = spread.groupBy(*CELL).agg(*(F.max(c).alias(c) for c in columns))
    return best.join(pixels.select(*CELL), CELL, "left_semi")


def buffered_overlap(pixels: DataFrame, radius: int = 4, eps: float = 1e-6) -> DataFrame:
    """loss: 1 less the overlap of prob and gt after both are spread by a radius."""
    wide = dilated_max(pixels.select(*CELL, "prob", F.col("gt").cast("double").alias("g")), radius, ["prob", "g"])
    both, either = F.sum(F.col("prob") * F.col("g")), F.sum("prob") + F.sum("g") - F.sum(F.col("prob") * F.col("g"))
    return wide.groupBy(*TILE).agg((1 - (both + eps) / (either + eps)).alias("loss"))


def boundary_loss(pixels: DataFrame, scale: float) -> DataFrame:
    """loss: cross-entropy of prob weighted by the distance to the nearest road, up to `scale`; 0.5 on tiles without one."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        gt, prob = to_array(pdf, "gt").astype(bool), to_array(pdf, "prob").astype(float)
        far = np.clip(distance(~gt) / scale, 0, 1) if gt.any() else np.full(gt.shape, 0.5)
        p = np.clip(prob, 1e-12, 1 - 1e-12)
        ce = -np.where(gt, np.log(p), np.log(1 - p))
        return pd.DataFrame({"tile_id": [pdf["tile_id"].iloc[0]], "loss": [float((far * ce).mean())]})

    return by_tasks(pixels, TILE, kernel, "tile_id long, loss double")


def diagnostics(pixels: DataFrame, by: list[str] = TILE) -> DataFrame:
    """p95 and share of pixels over 0.5, a word for how clear the roads are, and advice where they are not."""
    found = pixels.groupBy(*by).agg(F.percentile("prob", F.lit(0.95)).alias("p95"), F.avg((F.col("prob") > 0.5).cast("double")).alias("share"))
    found = found.withColumn("signal", S.signal(F.col("p95"), F.col("share")))
    advice = F.when(F.col("signal").isin("WEAK", "NEAR_ZERO"), "lower the threshold or check the model's input").when(F.col("share") > 0.5, "raise the threshold")
    return found.withColumn("advice", advice)


def occlusion_crop(pixels: DataFrame, side: int, size: int, least: int = 20) -> DataFrame:
    """(tile_id, top, left) of the crop around the occluded road, else the road, else the middle, held inside the tile."""
    both = F.col("gt") & F.col("occ")
    mean = lambda c, w: F.floor(F.avg(F.when(w, F.col(c)))).cast("int")
    seen = pixels.groupBy(*TILE).agg(F.count_if(both).alias("n"), mean("row", both).alias("r1"), mean("col", both).alias("c1"), mean("row", F.col("gt")).alias("r2"), mean("col", F.col("gt")).alias("c2"))
    place = lambda a, b: F.greatest(F.lit(0), F.least(F.lit(side - size), F.when(F.col("n") >= least, F.col(a)).otherwise(F.coalesce(F.col(b), F.lit(side // 2))) - size // 2))
    return seen.select(*TILE, place("r1", "r2").alias("top"), place("c1", "c2").alias("left"))


def blend_patch(pixels: DataFrame, band: str, patch: Column, alpha: float | Column) -> DataFrame:
    """The band with a patch laid over it, alpha from 0 to 1, as bytes. An alpha that is a number is taken as the decimal that it is
    written as: with binary shares, bytes that blend to a whole number would come out one less."""
    a = F.lit(Decimal(str(alpha))) if isinstance(alpha, float) else alpha
    return pixels.withColumn(band, S.clipped(F.floor((1 - a) * F.col(band) + a * patch), 0, 255).cast("int"))


def canopy_alpha(row: Column, col: Column, height: int, width: int, most: float = 0.75) -> Column:
    """How much of a patch shows at a cell of it: most in the middle, none outside its ellipse."""
    r = ((row - height / 2) / (height / 2)) ** 2 + ((col - width / 2) / (width / 2)) ** 2
    return S.clipped(1 - r, 0.0, 1.0) * most


# Tiling.


def tile_plan(sizes: DataFrame, tile: int = 512, band: int = 128) -> DataFrame:
    """(…, n_rows, n_cols, row0, col0) of overlapping tiles that cover (h, w) with `band` to spare on each side."""
    if tile <= 2 * band or band < 0:
        raise ValueError("a tile must be wider than its two bands")
    stride = tile - 2 * band
    count = lambda c: F.greatest(F.lit(1), F.ceil((F.col(c) + 2 * band - tile) / stride).cast("int") + 1)
    plan = sizes.withColumn("n_rows", count("h")).withColumn("n_cols", count("w"))
    plan = plan.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return plan.withColumn("row0", F.col("i") * stride).withColumn("col0", F.col("j") * stride).drop("i", "j")


def patch_plan(sizes: DataFrame, tile: int = 256, overlap_percent: float = 25.0) -> DataFrame:
    """(…, row0, col0, name) of patches that overlap by a share; the last of a row or column ends at the border."""
    if not 0 <= overlap_percent < 100 or tile < 1:
        raise ValueError("overlap must be from 0 up to 100, tile at least 1")
    over = int(tile * overlap_percent / 100)
    stride = tile - over
    starts = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil((F.col(c) - over) / stride).cast("int")) - 1), lambda k: F.least(k * stride, F.greatest(F.col(c) - tile, F.lit(0)))))
    plan = sizes.withColumn("row0", F.explode(starts("h"))).withColumn("col0", F.explode(starts("w")))
    return plan.withColumn("name", F.format_string("tile_r%04d_c%04d", "row0", "col0"))


def padded(pixels: DataFrame, side: int, pad: int, values: list[str]) -> DataFrame:
    """Square tiles with a border of mirrored cells: each cell goes to all places that mirror it, so no tile is joined with a grid."""
    places = lambda c: F.explode(S.mirrors(F.col(c), side, -pad, side + pad - 1))
    rows = pixels.where(F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1)).select("tile_id", places("row").alias("row"), "col", *values)
    return rows.select("tile_id", "row", places("col").alias("col"), *values)


def blend(patches: DataFrame, tile: int, floor: float = 1e-8, values: tuple[str, ...] = ("prob",)) -> DataFrame:
    """One raster of overlapping patches (tile_id, row, col, i, j: place in the patch): means weighted by a Hann window."""
    w = S.hann(F.col("i"), tile) * S.hann(F.col("j"), tile)
    return patches.withColumn("w", w).groupBy(*CELL).agg(*((F.sum(F.col("w") * F.col(v)) / F.greatest(F.sum("w"), F.lit(floor))).alias(v) for v in values))


def apply_model(blocks: DataFrame, model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], channels: int, tile: int, batch: int = 4, logits: bool = True) -> DataFrame:
    """(tile_id, row0, col0, prob, conf array<double>) of blocks (…, data array<double>: channel by channel): the model sees
    (n, channels, tile, tile) batches and is shipped once to each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                x = np.stack(part["data"].to_numpy()).reshape(-1, channels, tile, tile)
                road, conf = model(x)
                prob = 1 / (1 + np.exp(-road)) if logits else road
                yield pd.DataFrame({"tile_id": part["tile_id"], "row0": part["row0"], "col0": part["col0"], "prob": list(prob.reshape(len(part), -1)), "conf": list(conf.reshape(len(part), -1))})

    return blocks.select("tile_id", "row0", "col0", "data").mapInPandas(run, "tile_id long, row0 int, col0 int, prob array<double>, conf array<double>")


# Texture.


def local_variance(pixels: DataFrame, band: str, radius: int) -> DataFrame:
    """`texture`: variance within a square around each cell, over the cells there are."""
    spread = neighbours(pixels, radius, [F.col(band).cast("double").alias("v")])
    found = spread.groupBy(*CELL).agg(F.greatest(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), F.lit(0.0)).alias("texture"), F.count("*").alias("n"))
    return found.join(pixels.select(*CELL), CELL, "left_semi")


#: The neighbours that co-occurrences are counted with, and gray levels.
OFFSETS = ((0, 1), (-1, 1), (-1, 0), (-1, -1))
LEVELS = 32


def cooccurrence_texture(pixels: DataFrame, band: str, radius: int, side: int | None = None) -> DataFrame:
    """`texture`: contrast times lack of homogeneity of co-occurring gray levels, as means of squared differences within a
    square; four neighbour directions that wrap at the border; squares count the cells there are. A tile a group; sums over
    squares are differences of running sums, so a radius costs nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = to_array(pdf, band).astype(float) / 256 * LEVELS
        if side is not None:
            q = np.pad(q, ((0, side - q.shape[0]), (0, side - q.shape[1])))
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        contrast = same = 0.0
        for dr, dc in OFFSETS:
            d = (q - np.roll(q, (dr, dc), (0, 1))) ** 2
            contrast, same = contrast + _square_means(d, radius), same + _square_means(1 / (1 + d), radius)
        found = contrast / len(OFFSETS) * (1 - same / len(OFFSETS))
        return pd.DataFrame({"tile_id": pdf["tile_id"], "row": r, "col": c, "texture": found[r, c]})

    return by_tasks(pixels.select(*CELL, band), TILE, run, "tile_id long, row int, col int, texture double")


def _square_means(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the cells within a square around each."""
    run = np.pad(a, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    low, high = ([np.clip(np.arange(n) + by, 0, n) for n in a.shape] for by in (-radius, radius + 1))
    at = lambda r, c: run[r][:, c]
    sums = at(high[0], high[1]) - at(low[0], high[1]) - at(high[0], low[1]) + at(low[0], low[1])
    return sums / np.outer(high[0] - low[0], high[1] - low[1])


def normalized(texture: DataFrame, norm: float) -> DataFrame:
    return texture.withColumn("texture", S.clipped(F.col("texture") / norm, 0.0, 1.0))


# Shapes.


def to_array(pdf: pd.DataFrame, value: str) -> np.ndarray:
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    out = np.zeros((r.max() + 1, c.max() + 1), pdf[value].dtype)
    out[r, c] = pdf[value].to_numpy()
    return out


def from_mask(tile: int, mask: np.ndarray) -> pd.DataFrame:
    r, c = np.nonzero(mask)
    return pd.DataFrame({"tile_id": np.full(len(r), tile), "row": r.astype(np.int32), "col": c.astype(np.int32)})


def per_tile(pixels: DataFrame, value: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(tile_id, row, col) where a kernel on each whole tile gives true."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return from_mask(pdf["tile_id"].iloc[0], kernel(to_array(pdf, value)))

    return by_tasks(pixels.select(*CELL, value), TILE, run, "tile_id long, row int, col int")


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected parts, from 1; 0 outside. Each cell takes the least of its part's, halving the way each round."""
    index = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        wide = np.pad(np.where(mask, index, big), 1, constant_values=big)
        h, w = mask.shape
        low = np.minimum.reduce([wide[r : r + h, c : c + w] for r in range(3) for c in range(3)])
        new = np.where(mask, low, 0)
        flat = np.r_[0, new.ravel()]
        new = np.where(mask, flat[new], 0)
        if (new == index).all():
            return index
        index = new


def hysteresis(prob: np.ndarray, low: float, high: float) -> np.ndarray:
    """The 8-connected parts over the low threshold that reach the high one."""
    parts = label(prob >= low)
    return np.isin(parts, np.unique(parts[prob >= high])) & (parts > 0)


def dilate(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def erode(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def close(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Dilated, then eroded, by a cross; cells outside count as empty."""
    for step in (dilate, erode):
        for _ in range(times):
            mask = step(mask)
    return mask


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    parts = label(mask)
    size = np.bincount(parts.ravel())
    size[0] = 0
    return size[parts] >= least


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel lines (Zhang and Suen 1984): two passes alternate until neither removes a pixel."""
    mask = mask.astype(bool)
    while True:
        removed = False
        for first in (True, False):
            p = np.pad(mask, 1)
            n, e, s, w = p[:-2, 1:-1], p[1:-1, 2:], p[2:, 1:-1], p[1:-1, :-2]
            ring = [n, p[:-2, 2:], e, p[2:, 2:], s, p[2:, :-2], w, p[:-2, :-2]]
            around = sum(x.astype(np.int8) for x in ring)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            sides = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
            gone = mask & (around >= 2) & (around <= 6) & (turns == 1) & sides
            if gone.any():
                mask, removed = mask & ~gone, True
        if not removed:
            return mask


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact distance of each true cell to the nearest false one, 0 at false ones; infinite if there is none."""
    h, w = mask.shape
    big = float(h + w) ** 2 * 4
    rows = np.where(mask, np.inf, 0.0)
    for r in range(1, h):
        rows[r] = np.minimum(rows[r], rows[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        rows[r] = np.minimum(rows[r], rows[r + 1] + 1)
    squared = np.minimum(rows**2, big)
    best = np.stack([_lowest_parabolas(line) for line in squared]) if h and w else squared
    return np.where(best >= big, np.inf, np.sqrt(best))


def _lowest_parabolas(heights: np.ndarray) -> np.ndarray:
    """At each place x the least of heights[k] + (x - k)**2, in time that grows with the row: only parabolas that are lowest
    somewhere are kept, with the place from which each is."""
    kept, start = [0], [-np.inf]
    f = heights.tolist()
    for k in range(1, len(f)):
        while True:
            j = kept[-1]
            meet = (f[k] - f[j] + k * k - j * j) / (2 * (k - j))
            if meet > start[-1] or len(kept) == 1:
                break
            kept.pop()
            start.pop()
        if meet <= start[-1]:
            kept[-1], start[-1] = k, -np.inf
        else:
            kept.append(k)
            start.append(meet)
    x = np.arange(len(f))
    at = np.array(kept)[np.searchsorted(np.array(start[1:]), x, side="right")]
    return heights[at] + (x - at) ** 2


def narrow_cells(pixels: DataFrame, within: int) -> DataFrame:
    """Cells of roads (gt) at most `within` from the outside."""
    return per_tile(pixels, "gt", lambda m: (lambda d: (d > 0) & (d <= within))(distance(m.astype(bool))))


def priority(pixels: DataFrame, within: int = 3) -> DataFrame:
    """(tile_id, score): 0.05, half the share of narrow road, half the share of occluded cells."""
    sizes = pixels.groupBy(*TILE).agg(F.count("*").alias("n"), F.count_if("gt").alias("n_gt"), F.count_if("occ").alias("n_occ"))
    narrow = narrow_cells(pixels, within).groupBy(*TILE).agg(F.count("*").alias("n_narrow"))
    share = F.when(F.col("n_gt") < 10, F.lit(0.0)).otherwise(F.coalesce("n_narrow", F.lit(0)) / F.col("n"))
    return sizes.join(narrow, TILE, "left").select(*TILE, (0.05 + 0.5 * share + 0.5 * F.col("n_occ") / F.col("n")).alias("score"))


def neighbour_degree(cells: DataFrame) -> DataFrame:
    """(…, degree): cells among the eight around each cell."""
    spread = neighbours(cells, 1, []).where("dr <> 0 or dc <> 0").groupBy(*CELL).agg(F.count("*").alias("degree"))
    return cells.join(spread, CELL, "left").select(*CELL, F.coalesce("degree", F.lit(0)).alias("degree"))


def soft_dice(pixels: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(tile_id, cldice): agreement of each mask with the other's centre line."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pred, gt = to_array(pdf, "prob") >= 0.5, to_array(pdf, "gt").astype(bool)
        a, b = thin(pred), thin(gt)
        precision, sense = (a & gt).sum() / (a.sum() + eps), (b & pred).sum() / (b.sum() + eps)
        return pd.DataFrame({"tile_id": [pdf["tile_id"].iloc[0]], "cldice": [float(2 * precision * sense / (precision + sense + eps))]})

    return by_tasks(pixels, TILE, kernel, "tile_id long, cldice double")


# Augmentation: where things go is given, so a seed decides it once.


def textured_tiles(texture: DataFrame, above: float, k: int, seed: str, scale: float = 1.0) -> DataFrame:
    """k tiles at most whose mean texture, as a share of scale, is above a bound, by a seeded order. Whole numbers with a scale are
    summed without rounding, so a mean that equals the bound is not above it in any order of cells."""
    order = F.md5(F.concat(F.lit(seed), F.col("tile_id").cast("string")).cast("binary"))
    return texture.groupBy(*TILE).agg((F.avg("texture") / scale).alias("m")).where(F.col("m") > above).orderBy(order, "tile_id").limit(k).select(*TILE)


def cutout(pixels: DataFrame, band: str, top: int, left: int, height: int, width: int, where: Column) -> DataFrame:
    inside = F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1)
    return pixels.withColumn(band, F.when(inside & where, F.lit(0.0)).otherwise(F.col(band)))


def shade(pixels: DataFrame, band: str, row: float, col: float, radius: float, strength: float, towards: int) -> DataFrame:
    """The band moved towards dark (0) or white (255) around a place, less and less up to the radius."""
    soft = F.greatest(F.lit(0.0), 1 - F.hypot(F.col("row") - row, F.col("col") - col) / radius) * strength
    value = F.col(band) * (1 - soft) if towards == 0 else F.col(band) + (towards - F.col(band)) * soft
    return pixels.withColumn(band, F.least(F.lit(255), F.floor(value)).cast("int"))


def paste_max(pixels: DataFrame, snippet: DataFrame, value: str, top: int, left: int) -> DataFrame:
    """Tiles with a small raster pasted in, the greater value staying."""
    moved = snippet.select((F.col("row") + top).alias("row"), (F.col("col") + left).alias("col"), F.col(value).alias("_new"))
    both = pixels.join(few(moved), ["row", "col"], "left")
    return both.withColumn(value, F.greatest(F.col(value), F.coalesce("_new", F.col(value)))).drop("_new")


def single(batch: Column) -> Column:
    """The only member of a batch of one; an error for others."""
    return F.when(F.size(batch) == 1, F.get(batch, 0)).otherwise(F.raise_error(F.lit("a batch of one is needed")))


def windowed_cooccurrence(gray: np.ndarray, window: int = 11, levels: int = LEVELS, stride: int = 4) -> np.ndarray:
    """Contrast times lack of homogeneity of whole gray levels, of the pairs inside a window around every stride-th cell, between
    these by straight lines. Means over a window come from running sums, so a window's size costs nothing."""
    h, w = gray.shape
    pad = window // 2
    q = np.pad(np.clip(np.floor(gray / 256 * levels), 0, levels - 1), pad, mode="reflect")
    rows, cols = np.arange(0, h, stride), np.arange(0, w, stride)
    contrast, same = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)))
    for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1)):
        a = q[: q.shape[0] - dr, max(0, -dc) : q.shape[1] - max(0, dc)]
        b = q[dr:, max(0, dc) : q.shape[1] + min(0, dc)]
        d = (a - b) ** 2
        tall, wide = window - dr, window - abs(dc)
        for out, v in ((contrast, d), (same, 1 / (1 + d))):
            run = np.pad(v, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
            part = run[rows + tall][:, cols + wide] - run[rows][:, cols + wide] - run[rows + tall][:, cols] + run[rows][:, cols]
            out += part / (tall * wide) / 4
    return _stretched(contrast * (1 - same), h, w)


def _stretched(grid: np.ndarray, h: int, w: int) -> np.ndarray:
    """The grid at h x w places, its corners on theirs, between its cells by straight lines."""
    at = [np.linspace(0, n - 1, m) for n, m in zip(grid.shape, (h, w), strict=True)]
    low = [np.minimum(x.astype(int), max(n - 2, 0)) for x, n in zip(at, grid.shape, strict=True)]
    for axis in (0, 1):
        share = np.expand_dims(at[axis] - low[axis], 1 - axis)
        high = np.minimum(low[axis] + 1, grid.shape[axis] - 1)
        grid = np.take(grid, low[axis], axis) * (1 - share) + np.take(grid, high, axis) * share
    return grid


def windowed_texture(pixels: DataFrame, band: str, window: int = 11, levels: int = LEVELS, stride: int = 4) -> DataFrame:
    """`texture` of each whole tile by windowed_cooccurrence; tiles must be larger than half a window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = windowed_cooccurrence(to_array(pdf, band).astype(float), window, levels, stride)
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        return pd.DataFrame({"tile_id": pdf["tile_id"], "row": r, "col": c, "texture": found[r, c]})

    return by_tasks(pixels.select(*CELL, band), TILE, run, "tile_id long, row int, col int, texture double")
