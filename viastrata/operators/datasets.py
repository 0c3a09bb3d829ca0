"""Listings, pairs of images and masks, splits, samples, caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.cluster import rank_within

#: Parts that a group is sorted in.
SALTS = 64


def scan(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    return files.where(S.extension(F.col("path")).isin(*extensions)).orderBy("path")


def ways_in_box(ways: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Ways inside the box; of several classes the first counts."""
    return ways.where(F.col("lon").between(west, east) & F.col("lat").between(south, north)).withColumn("highway", S.first_class(F.col("highway")))


def of_classes(ways: DataFrame, classes: tuple[str, ...] = S.LABEL_CLASSES) -> DataFrame:
    return ways.where(F.col("highway").isin(*classes))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows


def pair_by_suffix(images: DataFrame, masks: DataFrame, image_suffix: str, mask_suffix: str) -> DataFrame:
    """(img, mask) where the image's path with the suffix changed exists as a mask."""
    swapped = images.where(F.col("path").endswith(image_suffix)).select(
        F.col("path").alias("img"), F.concat(F.expr(f"left(path, length(path) - {len(image_suffix)})"), F.lit(mask_suffix)).alias("mask")
    )
    return swapped.join(masks.select(F.col("path").alias("mask")), "mask", "left_semi").select("img", "mask")


def pair_by_position(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(dataset, img, mask): the k-th image of each dataset with the k-th mask, as far as both go."""
    a = rank_within(images.select("dataset", F.col("path").alias("img")), ["dataset"], [F.col("img")])
    b = rank_within(masks.select("dataset", F.col("path").alias("mask")), ["dataset"], [F.col("mask")])
    return a.join(b, ["dataset", "k"]).select("dataset", "img", "mask")


def pair_by_stem(files: DataFrame, layouts: list[tuple[str, str]]) -> DataFrame:
    """(dataset, stem, img, mask) of equal stems in an image and a mask folder; of the layouts (image folder, mask folder) each
    dataset uses the first in which it has pairs."""
    named = files.select("dataset", "path", S.stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
    rank = {name: k for k, pair in enumerate(layouts) for name in pair}
    layout = F.create_map(*(F.lit(v) for kv in rank.items() for v in kv))
    placed = named.withColumn("layout", F.try_element_at(layout, F.col("folder"))).where("layout is not null")
    images, masks = ([pair[side] for pair in layouts] for side in (0, 1))
    a = placed.where(F.col("folder").isin(*images)).select("dataset", "stem", "layout", F.col("path").alias("img"))
    b = placed.where(F.col("folder").isin(*masks)).select("dataset", "stem", "layout", F.col("path").alias("mask"))
    pairs = a.join(b, ["dataset", "stem", "layout"])
    if len(layouts) == 1:
        return pairs.drop("layout")
    first = pairs.groupBy("dataset").agg(F.min("layout").alias("layout"))
    return pairs.join(first, ["dataset", "layout"], "left_semi").drop("layout")


def no_pairs(spark: SparkSession) -> DataFrame:
    """A source that holds nothing on purpose."""
    return spark.createDataFrame([], "dataset string, stem string, img string, mask string")


def unsupported_source(name: str) -> DataFrame:
    raise NotImplementedError(f"{name} has no agreed layout")


def audit(pairs: DataFrame, needed: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, n); an error if all the needed datasets are empty."""
    counts = pairs.groupBy("dataset").agg(F.count("*").alias("n"))
    if needed and counts.where(F.col("dataset").isin(*needed)).isEmpty():
        raise ValueError(f"none of {', '.join(needed)} has pairs")
    return counts


def seeded_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), key).cast("binary"))


def held_out(rows: DataFrame, by: str, key: Column, n: int, seed: str) -> DataFrame:
    """`held_out`: whether a row is among the first n of its group in a seeded order."""
    place = F.struct(seeded_order(key, seed), key)
    # The first n of each part of a group, then of the group, so that no task sorts a whole group.
    parts = rows.select(by, place.alias("_at"), F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("_salt"))
    few = parts.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_salt").orderBy("_at"))).where(F.col("_k") <= n)
    first = few.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_at"))).where(F.col("_k") <= n)
    limits = first.groupBy(by).agg(F.max("_at").alias("_limit"))
    return rows.join(limits, by).withColumn("held_out", place <= F.col("_limit")).drop("_limit")


def head_split(rows: DataFrame, by: str, order: str, share: float) -> DataFrame:
    """`head`: whether a row is in the first share of its group, one row at least."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_size"))
    ranked = rank_within(rows, [by], [F.col(order)], "_k").join(sizes, by)
    return ranked.withColumn("head", F.col("_k") <= F.greatest(F.lit(1), F.floor(share * F.col("_size")))).drop("_k", "_size")


def seeded_sample(rows: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """n rows without repetition, by a seeded order."""
    return rows.orderBy(seeded_order(key, seed), key).limit(n)


def weighted_draws(weights: DataFrame, key: str, weight: str, draws: DataFrame, buckets: int | None = None) -> DataFrame:
    """(draw, key): draws u in 0..1, with repetition, each of the row whose share of the summed weights holds u. Sums are
    taken in buckets of hashes, of a million rows or so, and then over these; draws meet rows by equal steps of the range, not by comparing all."""
    total = weights.agg(F.sum(weight).alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return draws.limit(0).select("draw").join(weights.select(key).limit(0), how="cross")
    order, buckets = Window.orderBy(key), buckets or max(SALTS, total["n"] // 1_000_000)
    low = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if total["n"] <= 1_000_000 else _bucketed_low(weights, key, weight, buckets)
    steps = max(1, min(total["n"], 100_000))
    spans = weights.withColumn("low", F.round(low, 9)) if total["n"] <= 1_000_000 else low
    spans = spans.withColumn("high", F.round(F.col("low") + F.col(weight), 9))
    step = lambda x: F.floor(x * steps / total["t"])
    spread = spans.select(key, "low", "high", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))).alias("step"))
    asked = draws.select("draw", F.round(F.col("u") * total["t"], 9).alias("at")).withColumn("step", step(F.col("at")))
    return asked.join(spread, "step").where("at >= low and at < high").select("draw", key)


def _bucketed_low(weights: DataFrame, key: str, weight: str, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    sums = weights.groupBy(bucket.alias("b")).agg(F.sum(weight).alias("s"))
    starts = sums.withColumn("start", F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s"))
    inner = F.sum(weight).over(Window.partitionBy("b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    return weights.withColumn("b", bucket).withColumn("inner", inner).join(F.broadcast(starts), "b").withColumn("low", F.round(F.col("start") + F.col("inner"), 9)).drop("b", "inner", "s", "start")


def uncached(wanted: DataFrame, cache: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """What is still to compute."""
    return wanted if force else wanted.join(cache.select(*keys), keys, "left_anti")


def cached_or_computed(wanted: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows of what is wanted, and computed ones for the rest."""
    return cache.join(wanted, keys, "left_semi").unionByName(compute(uncached(wanted, cache, keys)))


def with_stats(rows: DataFrame, stats: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """A table of statistics with new rows put in: known keys stay, unless forced."""
    return stats.join(rows.select(*keys), keys, "left_anti").unionByName(rows) if force else stats.unionByName(uncached(rows, stats, keys))


def check_bank(patches: DataFrame, data: str, height: str, width: str, channels: int = 3) -> DataFrame:
    """Patches of a bank; an error if one has not `channels` values for each of its cells."""
    fits = F.size(data) == F.col(height) * F.col(width) * channels
    return patches.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("a patch has another number of channels")).cast("boolean")))
