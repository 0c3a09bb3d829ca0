"""Borders, blends and means that come out right on every value."""

import pytest
from pyspark.sql import functions as F

from viastrata.operators import rasters


def mirrored(x, n):
    while not 0 <= x < n:
        x = -x if x < 0 else 2 * (n - 1) - x
    return x


@pytest.mark.parametrize(("side", "pad"), [(2, 1), (5, 2), (5, 4), (3, 7), (1, 0)])
def test_padded_joins_nothing(spark, side, pad):
    cells = [(t, r, c, float(100 * t + 10 * r + c)) for t in (1, 2) for r in range(side) for c in range(side) if (t, r, c) != (2, 0, 0)]
    made = rasters.padded(spark.createDataFrame(cells, "tile_id long, row int, col int, prob double"), side, pad, ["prob"])
    known = {x[:3]: x[3] for x in cells}
    places = range(-pad, side + pad)
    at = {(t, r, c): (t, mirrored(r, side), mirrored(c, side)) for t in (1, 2) for r in places for c in places}
    assert sorted(map(tuple, made.select("tile_id", "row", "col", "prob").collect())) == sorted((*k, known[v]) for k, v in at.items() if v in known)
    # Tiles exploded to a grid of places, whose size no estimate sees, were broadcast.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_blend_of_all_bytes(spark):
    every = spark.range(256 * 256).select(F.expr("cast(id div 256 as int)").alias("red"), (F.col("id") % 256).cast("int").alias("green"))
    made = rasters.blend_patch(every.withColumn("old", F.col("red")), "red", F.col("green"), 0.4)
    assert made.where(F.col("red") != F.expr("(6 * old + 4 * green) div 10")).count() == 0


def test_mean_texture_at_the_bound_is_not_above_it(spark):
    cells = spark.range(200 * 64).select(F.expr("id div 64").alias("tile_id"), F.expr("cast(id % 64 as int)").alias("k"))
    apart = F.expr("cast((tile_id * 7 + (k div 2) * 13) % 90 as int)")
    texture = cells.select("tile_id", F.when(F.col("k") % 2 == 0, 130 - apart).otherwise(130 + apart).alias("texture"))
    assert rasters.textured_tiles(texture, 0.65, 1000, "5", 200.0).count() == 0
    assert rasters.textured_tiles(texture, 0.649, 1000, "5", 200.0).count() == 200
    # As it was called before.
    assert texture.groupBy("tile_id").agg(F.avg(F.col("texture") / 200.0).alias("m")).where("m > 0.65D").count() > 0
