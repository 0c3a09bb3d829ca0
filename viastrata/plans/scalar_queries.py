"""Queries of projections, predicates and plain aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import datasets, rasters
from . import fixtures as X
from .registry import query

_WIDTH_SQL = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.ROAD_WIDTHS.items()) + f" ELSE {S.OTHER_WIDTH} END"


@query("SELECT tile_id, row, col, floor(0.299::DOUBLE * red + 0.587::DOUBLE * green + 0.114::DOUBLE * blue)::INTEGER AS lum FROM gray")
def s02_luminance(spark, d):
    return X.gray(spark, d).select("tile_id", "row", "col", S.luminance(F.col("red"), F.col("green"), F.col("blue")).alias("lum"))


@query("SELECT tile_id, row, col, prob FROM (SELECT tile_id, row, col, round(prob, 6) AS prob FROM pixels) WHERE row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 4")
def s03_window_read(spark, d):
    return rasters.window(X.pixels(spark, d), 2, 1, 4, 4).select("tile_id", "row", "col", F.round("prob", 6).alias("prob"))


@query("SELECT way_id, highway AS class, coalesce(lanes, 0) AS lanes FROM ways WHERE lon BETWEEN -100 AND 100 AND lat BETWEEN -45 AND 45")
def s05_ways_in_box(spark, d):
    w = X.ways(spark, d).withColumn("highway", F.array("highway", F.lit("other")))
    return datasets.ways_in_box(w, -100, -45, 100, 45).select("way_id", F.col("highway").alias("class"), F.coalesce("lanes", F.lit(0)).alias("lanes"))


@query("SELECT path FROM listing WHERE path LIKE '%.tiff' ORDER BY path")
def s11_directory_scan(spark, d):
    return datasets.scan(X.listing(spark, d), (".tif", ".tiff"))


_PAIR = """SELECT a.path AS img, b.path AS mask FROM listing a JOIN listing b
  ON replace(replace(a.path, '/images/', '/masks/'), '.tiff', '.png') = b.path WHERE a.path LIKE '%.tiff'"""


@query(_PAIR)
def s12_pairs_by_suffix(spark, d):
    files = X.listing(spark, d)
    images = files.where(F.col("path").endswith(".tiff"))
    masks = files.where(F.col("path").endswith(".png"))
    return datasets.pair_by_suffix(images.withColumn("path", F.replace("path", F.lit("/images/"), F.lit("/masks/"))), masks, ".tiff", ".png").select(
        F.replace("img", F.lit("/masks/"), F.lit("/images/")).alias("img"), "mask"
    )


@query("""WITH a AS (SELECT split_part(path, '/', 1) AS dataset, path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS k FROM listing WHERE path LIKE '%.tiff'),
  b AS (SELECT split_part(path, '/', 1) AS dataset, path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS k FROM listing WHERE path LIKE '%.png')
  SELECT dataset, a.path AS img, b.path AS mask FROM a JOIN b USING (dataset, k)""")
def s13_pairs_by_position(spark, d):
    files = X.listing(spark, d).withColumn("dataset", F.split_part("path", F.lit("/"), F.lit(1)))
    return datasets.pair_by_position(files.where(F.col("path").endswith(".tiff")), files.where(F.col("path").endswith(".png")))


@query("""WITH s AS (SELECT split_part(path, '/', 1) AS dataset, regexp_extract(path, '([^/]*)[.][a-z]+$', 1) AS stem, path FROM listing)
  SELECT a.dataset, a.stem, a.path AS img, b.path AS mask FROM s a JOIN s b USING (dataset, stem) WHERE a.path LIKE '%.tiff' AND b.path LIKE '%.png'""")
def s14_pairs_by_stem(spark, d):
    return datasets.pair_by_stem(X.listing(spark, d).withColumn("dataset", F.split_part("path", F.lit("/"), F.lit(1))), [("images", "masks"), ("sat", "map")])


@query("""WITH s AS (SELECT split_part(path, '/', 1) AS dataset, regexp_extract(path, '([^/]*)[.][a-z]+$', 1) AS stem, path FROM listing)
  SELECT a.dataset, a.stem, a.path AS img, b.path AS mask FROM s a JOIN s b USING (dataset, stem) WHERE a.path LIKE '%.tiff' AND b.path LIKE '%.png'""")
def s15_pairs_images_only(spark, d):
    files = X.listing(spark, d)
    noise = files.select(F.concat("path", F.lit(".txt")).alias("path")).unionByName(files.select(F.regexp_replace("path", "/d", "/.d").alias("path")))
    everything = files.unionByName(noise).where(S.is_image(F.col("path"))).withColumn("dataset", F.split_part("path", F.lit("/"), F.lit(1)))
    return datasets.pair_by_stem(everything, [("images", "masks")])


@query("""WITH s AS (SELECT split_part(path, '/', 1) AS dataset, regexp_extract(path, '([^/]*)[.][a-z]+$', 1) AS stem, path FROM listing)
  SELECT a.dataset, a.stem, a.path AS img, b.path AS mask FROM s a JOIN s b USING (dataset, stem) WHERE a.path LIKE '%.tiff' AND b.path LIKE '%.png'""")
def s16_pairs_alternative_folders(spark, d):
    files = X.listing(spark, d).withColumn("dataset", F.split_part("path", F.lit("/"), F.lit(1)))
    return datasets.pair_by_stem(files, [("img", "mask"), ("images", "masks")])


@query(f"SELECT split_part(img, '/', 1) AS dataset, count(*) AS n FROM ({_PAIR}) GROUP BY 1")
def s19_data_audit(spark, d):
    pairs = s14_pairs_by_stem(spark, d)
    return datasets.audit(pairs)


@query("SELECT node_id, round(300 - (y - 5) / 0.5, 6) AS row, round((x + 3) / 0.5, 6) AS col FROM city_nodes")
def p01_world_to_pixel(spark, d):
    row, col = S.world_to_pixel(F.col("x"), F.col("y"), F.lit(-3.0), F.lit(5.0), F.lit(0.5), F.lit(300))
    return X.city_nodes(spark, d).select("node_id", F.round(row, 6).alias("row"), F.round(col, 6).alias("col"))


@query("""SELECT tile_id, row, col, round((0.4 * (2.0 * col + 0.1 * row - 0) - 0.1 * (0.2 * col + 0.4 * row)) / (2.0 * 0.4 - 0.1 * 0.2), 6) AS c,
          round((2.0 * (0.2 * col + 0.4 * row) - 0.2 * (2.0 * col + 0.1 * row)) / (2.0 * 0.4 - 0.1 * 0.2), 6) AS r FROM pixels""")
def p02_affine_inverse(spark, d):
    p = X.pixels(spark, d)
    x, y = 2.0 * F.col("col") + 0.1 * F.col("row") + 7, 0.2 * F.col("col") + 0.4 * F.col("row") - 2
    col, row = S.affine_inverse(x, y, *(F.lit(v) for v in (2.0, 0.1, 7.0, 0.2, 0.4, -2.0)))
    return p.select("tile_id", "row", "col", F.round(col, 6).alias("c"), F.round(row, 6).alias("r"))


@query("SELECT tile_id, i, round(1 / (1 + exp(-v * 30)), 6) AS p FROM cells")
def p03_sigmoid(spark, d):
    return X._cells(spark, d).select("tile_id", F.col("i").cast("long").alias("i"), F.round(S.sigmoid(F.col("v") * 30), 6).alias("p"))


@query("SELECT tile_id, row, col, round(1 / (1 + exp(-ln(prob / (1 - prob)))), 5) AS prob, round(conf, 5) AS conf FROM pixels")
def p05_prediction_from_logits(spark, d):
    logits = X.pixels(spark, d).select("tile_id", "row", "col", F.log(F.col("prob") / (1 - F.col("prob"))).alias("logit"), "conf")
    return rasters.prediction(logits).select("tile_id", "row", "col", F.round("prob", 5).alias("prob"), F.round("conf", 5).alias("conf"))


_Z = "CASE WHEN src % 13 = 0 THEN -1 WHEN bridge THEN greatest(1, coalesce(nullif(layer, 0), 1)) ELSE layer END"


@query(f"SELECT src, dst, ({_Z})::INTEGER AS z_level FROM city_edges")
def p06_z_level(spark, d):
    e = X.city_edges(spark, d)
    return e.select("src", "dst", S.z_level(F.col("bridge"), F.col("src") % 13 == 0, F.col("layer")).alias("z_level"))


@query(f"SELECT z_level, count(*) AS n FROM (SELECT ({_Z})::INTEGER AS z_level FROM city_edges) GROUP BY 1 ORDER BY 1")
def a02_z_histogram(spark, d):
    return p06_z_level(spark, d).groupBy("z_level").agg(F.count("*").alias("n")).orderBy("z_level")


@query("SELECT tile_id, row, col FROM pixels WHERE prob >= 0.5")
def p07_binarize(spark, d):
    return rasters.binarize(X.pixels(spark, d), 0.5).select("tile_id", "row", "col")


@query(f"SELECT way_id, round((CASE WHEN lanes > 0 THEN lanes * 3.5 ELSE {_WIDTH_SQL} END)::DOUBLE * (CASE WHEN oneway THEN 0.5 ELSE 1 END) / 2, 6) AS half_width FROM ways")
def p08_half_width(spark, d):
    return X.ways(spark, d).select("way_id", F.round(S.half_width(F.col("highway"), F.col("oneway"), F.col("lanes")), 6).alias("half_width"))


@query("SELECT way_id, ((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + greatest(1, least(60, floor((lon + 180) / 6)::INTEGER + 1)))::INTEGER AS epsg FROM ways")
def p09_utm_zone(spark, d):
    return X.ways(spark, d).select("way_id", S.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"SELECT way_id, highway FROM ways WHERE highway IN ({', '.join(map(repr, S.LABEL_CLASSES))})")
def p10_class_filter(spark, d):
    return datasets.of_classes(X.ways(spark, d)).select("way_id", "highway")


@query("SELECT src, dst, round(((degrees(atan2(b.y - a.y, b.x - a.x)) % 180.0) + 180.0) % 180.0, 6) AS bearing FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst")
def p11_bearing(spark, d):
    return rasters.with_ends(X.city_edges(spark, d), X.city_nodes(spark, d)).select("src", "dst", F.round(S.bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6).alias("bearing"))


@query("SELECT src, dst, round(sqrt((b.x - a.x)^2 + (b.y - a.y)^2), 6) AS metres FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst")
def p12_length(spark, d):
    return rasters.with_ends(X.city_edges(spark, d), X.city_nodes(spark, d)).select("src", "dst", F.round(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6).alias("metres"))


@query("""SELECT tile_id FROM gray GROUP BY 1 HAVING avg((red <= 40 AND green <= 140)::INTEGER) <= 0.01""")
def p13_complete_tiles(spark, d):
    g = X.gray(spark, d)
    dark = g.select("tile_id", F.when(F.col("red") <= 40, 0).otherwise(F.col("red")).alias("a"), F.when(F.col("green") <= 140, 0).otherwise(F.col("green")).alias("b"))
    return rasters.complete_tiles(dark, ["a", "b"])


@query("SELECT tile_id, row, col, red AS r4, green AS g4, blue AS b4, green AS r3, blue AS g3, floor((green + blue) / 2 * 0.7::DOUBLE)::INTEGER AS b3 FROM gray")
def p14_band_mapping(spark, d):
    four = S.bands_to_rgb("nir_r_g_b", [F.col(c) for c in ("nir", "red", "green", "blue")])
    three = S.bands_to_rgb("nir_r_g", [F.col(c) for c in ("nir", "green", "blue")])
    return X.gray(spark, d).select("tile_id", "row", "col", *(c.alias(n) for c, n in zip(four + three, ("r4", "g4", "b4", "r3", "g3", "b3"), strict=True)))


@query("SELECT tile_id FROM gray GROUP BY 1 HAVING max(red) > 180")
def p15_nonempty_masks(spark, d):
    g = X.gray(spark, d).select("tile_id", "row", "col", F.col("red").alias("value"))
    return rasters.nonempty(g.select("tile_id").distinct(), g, 180)


@query("""WITH s AS (SELECT avg(red) AS m, stddev_pop(red) AS sd FROM gray), t AS (SELECT tile_id, avg(red) AS m, stddev_pop(red) AS sd FROM gray GROUP BY 1)
  SELECT tile_id, row, col, round((red - s.m) / s.sd, 6) AS by_corpus, round((red - 127.5) / 127.5, 6) AS by_default, round((red - t.m) / (t.sd + 1e-6), 5) AS by_image FROM gray JOIN t USING (tile_id), s""")
def p16_standardize(spark, d):
    g = X.gray(spark, d)
    corpus = rasters.band_stats(g, ["red"]).select(F.col("mean").alias("m"), F.col("std").alias("sd"))
    image = Window.partitionBy("tile_id")
    by_image = (F.col("red") - F.avg("red").over(image)) / (F.stddev_pop("red").over(image) + 1e-6)
    return g.withColumn("i", by_image).crossJoin(F.broadcast(corpus)).select(
        "tile_id", "row", "col", F.round(S.standardized(F.col("red"), F.col("m"), F.col("sd")), 6).alias("by_corpus"),
        F.round(S.standardized(F.col("red")), 6).alias("by_default"), F.round("i", 5).alias("by_image"),
    )


@query("SELECT tile_id, row, col, round(greatest(0, least(255, (red - m) * 1.2 + m)), 6) AS red FROM gray JOIN (SELECT tile_id, avg(red) AS m FROM gray GROUP BY 1) USING (tile_id)")
def p17_contrast(spark, d):
    return rasters.contrast(X.gray(spark, d), "red", 1.2).select("tile_id", "row", "col", F.round("red", 6).alias("red"))


@query("SELECT path, regexp_extract(path, '([^/]*)[.][a-z]+$', 1) AS stem, regexp_extract(path, '([.][a-z]+)$', 1) AS ext, true AS image FROM listing")
def p25_path_parts(spark, d):
    p = F.col("path")
    return X.listing(spark, d).select("path", S.stem(p).alias("stem"), S.extension(p).alias("ext"), S.is_image(p).alias("image"))


@query("SELECT tile_id, count(*) FILTER (prob >= 0.5 AND gt) AS tp, count(*) FILTER (prob >= 0.5 AND NOT gt) AS fp, count(*) FILTER (prob < 0.5 AND gt) AS fn FROM pixels GROUP BY 1")
def a03_confusion(spark, d):
    return rasters.confusion(X.pixels(spark, d), ["tile_id"]).select("tile_id", "tp", "fp", "fn")


_RATES = "CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS iou, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS dice, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec"
_COUNTS = "sum((prob >= 0.5 AND gt)::INTEGER)::DOUBLE AS tp, sum((prob >= 0.5 AND NOT gt)::INTEGER)::DOUBLE AS fp, sum((prob < 0.5 AND gt)::INTEGER)::DOUBLE AS fn"


@query(f"SELECT tile_id, round(iou, 6) AS iou, round(dice, 6) AS dice, round(prec, 6) AS prec, round(rec, 6) AS rec FROM (SELECT *, {_RATES} FROM (SELECT tile_id, {_COUNTS} FROM pixels GROUP BY 1))")
def a04_overlap(spark, d):
    found = rasters.overlap(rasters.confusion(X.pixels(spark, d), ["tile_id"]))
    return found.select("tile_id", *(F.round(c, 6).alias(n) for c, n in (("iou", "iou"), ("dice", "dice"), ("precision", "prec"), ("recall", "rec"))))


@query(f"""WITH o AS (SELECT tile_id, {_COUNTS}, avg(occ::INTEGER) AS share FROM pixels GROUP BY 1), c AS (SELECT tile_id, {_COUNTS} FROM pixels WHERE occ GROUP BY 1),
  a AS (SELECT *, {_RATES} FROM o), b AS (SELECT *, {_RATES} FROM c)
  SELECT tile_id, round(a.iou, 6) AS iou, round(a.dice, 6) AS dice, round(a.prec, 6) AS prec, round(a.rec, 6) AS rec, round(b.iou, 6) AS occ_iou, round(b.rec, 6) AS occ_rec,
         round(share, 6) AS occ_share FROM a LEFT JOIN b USING (tile_id)""")
def a05_pixel_metrics(spark, d):
    found = rasters.pixel_metrics(X.pixels(spark, d))
    names = (("iou", "iou"), ("dice", "dice"), ("precision", "prec"), ("recall", "rec"), ("occluded_iou", "occ_iou"), ("occluded_recall", "occ_rec"), ("occluded_share", "occ_share"))
    return found.select("tile_id", *(F.round(c, 6).alias(n) for c, n in names))


@query(f"SELECT tile_id, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou, round((tp + 1e-6) / (tp + fp + 1e-6), 6) AS prec, round((tp + 1e-6) / (tp + fn + 1e-6), 6) AS rec FROM (SELECT tile_id, {_COUNTS} FROM pixels GROUP BY 1)")
def a06_smoothed_overlap(spark, d):
    found = rasters.overlap(rasters.confusion(X.pixels(spark, d), ["tile_id"]), eps=1e-6)
    return found.select("tile_id", *(F.round(c, 6).alias(n) for c, n in (("iou", "iou"), ("precision", "prec"), ("recall", "rec"))))


@query(f"""WITH t AS (SELECT *, (tp + 1e-6) / (tp + fp + fn + 1e-6) AS iou FROM (SELECT tile_id, {_COUNTS}, count(*) FILTER (gt AND occ) AS n_occ, count(*) FILTER (gt AND occ AND prob >= 0.5) AS n_hit FROM pixels GROUP BY 1))
  SELECT count(*) AS n_tiles, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, round(avg(n_hit / n_occ) FILTER (n_occ >= 20), 6) AS occlusion_recall FROM t""")
def a07_validation_summary(spark, d):
    f = rasters.validation_summary(X.pixels(spark, d), least_occluded=20)
    return f.select("n_tiles", F.round("mean_iou", 6).alias("mean_iou"), F.round("median_iou", 6).alias("median_iou"), F.round("occlusion_recall", 6).alias("occlusion_recall"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS band, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM gray" for c in ("red", "green", "blue")))
def a08_band_stats(spark, d):
    return rasters.band_stats(X.gray(spark, d), ["red", "green", "blue"]).select("band", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT round(CASE WHEN max(red) <= 0 THEN 1.0 ELSE quantile_cont(red::DOUBLE, 0.99) END, 6) AS norm FROM gray WHERE row % 4 = 0 AND col % 4 = 0")
def a09_norm_constant(spark, d):
    return rasters.norm_constant(X.gray(spark, d).withColumnRenamed("red", "raw"), "raw").select(F.round("norm", 6).alias("norm"))


@query("""WITH p AS (SELECT tile_id, quantile_cont(red::DOUBLE, 0.02) AS lo, quantile_cont(red::DOUBLE, 0.98) AS hi FROM gray GROUP BY 1)
  SELECT tile_id, row, col, CASE WHEN hi - lo < 1e-6 THEN 0 ELSE floor(round(greatest(0, least(1, (red - lo) / (hi - lo))) * 255, 9))::INTEGER END AS byte FROM gray JOIN p USING (tile_id)""")
def a10_percentile_stretch(spark, d):
    return rasters.stretch(X.gray(spark, d), "red", ["tile_id"]).select("tile_id", "row", "col", F.col("stretched").alias("byte"))


@query("""SELECT tile_id, round(avg((occ AND gt)::INTEGER) / avg(gt::INTEGER), 6) AS share FROM pixels GROUP BY 1 HAVING sum(gt::INTEGER) >= 30
  ORDER BY 2 DESC, 1 LIMIT 20""")
def a15_occluded_ranking(spark, d):
    return rasters.occluded_ranking(X.pixels(spark, d), least=30, k=20)


@query("""SELECT tile_id, round(sum(-(gt::INTEGER * ln(conf) + (1 - gt::INTEGER) * ln(1 - conf)) * (0.1::DOUBLE + 0.9::DOUBLE * occ::INTEGER)) / (sum(0.1::DOUBLE + 0.9::DOUBLE * occ::INTEGER) + 1e-6), 5) AS weighted_bce,
    round(1 - (sum(prob * gt::INTEGER) + 1) / (sum(prob * gt::INTEGER) + 0.7::DOUBLE * sum(prob * (1 - gt::INTEGER)) + 0.3::DOUBLE * sum((1 - prob) * gt::INTEGER) + 1), 5) AS tversky FROM pixels GROUP BY 1""")
def m09_losses(spark, d):
    return rasters.losses(X.pixels(spark, d)).select("tile_id", F.round("weighted_bce", 5).alias("weighted_bce"), F.round("tversky", 5).alias("tversky"))


@query("""WITH b AS (SELECT p.tile_id, p.row, p.col, max(q.prob) AS p, max(q.gt::INTEGER) AS g FROM pixels p JOIN pixels q
    ON p.tile_id = q.tile_id AND abs(p.row - q.row) <= 2 AND abs(p.col - q.col) <= 2 GROUP BY 1, 2, 3)
  SELECT tile_id, round(1 - (sum(p * g) + 1e-6) / (sum(p) + sum(g) - sum(p * g) + 1e-6), 5) AS buffered FROM b GROUP BY 1""")
def m09_buffered_overlap(spark, d):
    return rasters.buffered_overlap(X.pixels(spark, d), 2).select("tile_id", F.round("loss", 5).alias("buffered"))


@query("""SELECT tile_id, round(quantile_cont(prob, 0.95), 6) AS p95, round(avg((prob > 0.5)::INTEGER), 6) AS share,
    CASE WHEN quantile_cont(prob, 0.95) >= 0.8 AND avg((prob > 0.5)::INTEGER) >= 0.02 THEN 'STRONG' WHEN quantile_cont(prob, 0.95) >= 0.5 AND avg((prob > 0.5)::INTEGER) >= 0.005 THEN 'MODERATE'
         WHEN quantile_cont(prob, 0.95) >= 0.2 THEN 'WEAK' ELSE 'NEAR_ZERO' END AS signal FROM pixels GROUP BY 1""")
def m07_diagnostics(spark, d):
    return rasters.diagnostics(X.pixels(spark, d)).select("tile_id", F.round("p95", 6).alias("p95"), F.round("share", 6).alias("share"), "signal")


@query("SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 40")
def l01_held_out(spark, d):
    docs = X.read(spark, d, "documents").select("doc_id", "source")
    return datasets.held_out(docs, "source", F.col("doc_id").cast("string"), 40, "42").where("held_out").select("doc_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= greatest(1, floor(0.1 * count(*) OVER (PARTITION BY source))) AS val FROM documents")
def l02_head_split(spark, d):
    docs = X.read(spark, d, "documents").select("doc_id", "source")
    return datasets.head_split(docs, "source", "doc_id", 0.1).select("doc_id", F.col("head").alias("val"))


@query("""WITH w AS (SELECT tile_id, 0.05 + avg(gt::INTEGER) AS w FROM pixels GROUP BY 1), c AS (SELECT tile_id, sum(w) OVER (ORDER BY tile_id) AS high, sum(w) OVER (ORDER BY tile_id) - w AS low, sum(w) OVER () AS total FROM w),
  u AS (SELECT i, ((i * 7919 + 13) % 10007)::DOUBLE / 10007 AS u FROM range(500) t(i))
  SELECT i AS draw, tile_id FROM u JOIN c ON round(u * total, 9) >= round(low, 9) AND round(u * total, 9) < round(high, 9)""")
def l03_weighted_draws(spark, d):
    w = X.pixels(spark, d).groupBy("tile_id").agg((0.05 + F.avg(F.col("gt").cast("int"))).alias("w"))
    draws = spark.range(500).select(F.col("id").alias("draw"), (((F.col("id") * 7919 + 13) % 10007).cast("double") / 10007).alias("u"))
    return datasets.weighted_draws(w, "tile_id", "w", draws).select("draw", "tile_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7' || doc_id::VARCHAR), doc_id LIMIT 25")
def l04_sample(spark, d):
    return datasets.seeded_sample(X.read(spark, d, "documents").select("doc_id"), F.col("doc_id").cast("string"), 25, "7")


@query("""WITH o AS (SELECT tile_id, floor(avg(row))::INTEGER AS r, floor(avg(col))::INTEGER AS c, count(*) AS n FROM pixels WHERE gt AND occ GROUP BY 1),
  m AS (SELECT tile_id, floor(avg(row))::INTEGER AS r, floor(avg(col))::INTEGER AS c FROM pixels WHERE gt GROUP BY 1), t AS (SELECT DISTINCT tile_id FROM pixels)
  SELECT tile_id, greatest(0, least(4, CASE WHEN o.n >= 10 THEN o.r ELSE coalesce(m.r, 4) END - 2))::INTEGER AS top, greatest(0, least(4, CASE WHEN o.n >= 10 THEN o.c ELSE coalesce(m.c, 4) END - 2))::INTEGER AS lft
  FROM t LEFT JOIN o USING (tile_id) LEFT JOIN m USING (tile_id)""")
def l07_occlusion_crop(spark, d):
    return rasters.occlusion_crop(X.pixels(spark, d), side=X.SIDE, size=4, least=10).select("tile_id", F.col("top").alias("top"), F.col("left").alias("lft"))


@query("""SELECT tile_id, row, col, greatest(0, least(255, floor(0.6 * red + 0.4 * green)))::INTEGER AS red FROM gray""")
def l05_canopy_blend(spark, d):
    return rasters.blend_patch(X.gray(spark, d), "red", F.col("green"), 0.4).select("tile_id", "row", "col", "red")


@query("SELECT dataset, img FROM (SELECT 'a' AS dataset, path AS img FROM listing WHERE path LIKE '%.tiff' UNION ALL SELECT 'b', path FROM listing WHERE path LIKE '%.png')")
def u01_union(spark, d):
    files = X.listing(spark, d)
    a = files.where(F.col("path").endswith(".tiff")).select(F.lit("a").alias("dataset"), F.col("path").alias("img"))
    b = files.where(F.col("path").endswith(".png")).select(F.lit("b").alias("dataset"), F.col("path").alias("img"))
    return a.unionByName(b)


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def u02_intersect(spark, d):
    docs = X.read(spark, d, "documents").select("doc_id")
    return docs.where("doc_id % 5 <> 0").intersect(docs.where("doc_id % 3 <> 0"))


@query("SELECT node_id FROM city_nodes EXCEPT SELECT node_id FROM scenarios WHERE scenario = 'south'")
def u03_difference(spark, d):
    return X.city_nodes(spark, d).select("node_id").subtract(X.scenarios(spark, d).where("scenario = 'south'").select("node_id"))


@query("SELECT DISTINCT least(origin, dest) AS u, greatest(origin, dest) AS v FROM (SELECT origin, dest FROM od_pairs UNION ALL SELECT dest, origin FROM od_pairs)")
def u04_distinct_pairs(spark, d):
    od = X.od_pairs(spark, d)
    return od.union(od.select("dest", "origin")).select(F.least("origin", "dest").alias("u"), F.greatest("origin", "dest").alias("v")).distinct()


@query("""SELECT tile_id FROM (SELECT DISTINCT tile_id FROM pixels) WHERE tile_id % 4 <> 0""")
def k10_cache_missing(spark, d):
    tiles = X.pixels(spark, d).select("tile_id").distinct()
    return datasets.uncached(tiles, tiles.where("tile_id % 4 = 0"), ["tile_id"])


@query("""SELECT tile_id, CASE WHEN tile_id % 4 = 0 THEN -1.0 ELSE round(avg(prob), 6) END AS value FROM pixels GROUP BY 1""")
def k11_cache_or_compute(spark, d):
    p = X.pixels(spark, d)
    cache = p.select("tile_id").distinct().where("tile_id % 4 = 0").withColumn("value", F.lit(-1.0))
    return datasets.cached_or_computed(p.select("tile_id").distinct(), cache, ["tile_id"], lambda todo: p.join(todo, "tile_id").groupBy("tile_id").agg(F.round(F.avg("prob"), 6).alias("value")))
