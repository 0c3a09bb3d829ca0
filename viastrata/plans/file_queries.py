"""Queries of files written and read back, of guards, and of graph surgery on traced roads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.cluster import checkpoint, shared_folder
from ..operators import datasets, graph, healing, pipeline, rasters, tracing
from ..operators.graph import Sets
from ..sources import files
from . import fixtures as X
from .graph_queries import _full_evidence, _scores
from .registry import query

# Rasters.


def _named(blobs):
    """Files as Spark's binaryFile source gives them."""
    return blobs.select(F.col("tile_id").cast("string").alias("path"), F.col("data").alias("content"))


def _values(found, *columns):
    return found.select(F.col("path").cast("long").alias("tile_id"), "row", "col", *columns)


@query("SELECT tile_id, row, col, round(red / 255.0::DOUBLE, 6) AS prob FROM gray")
def s01_gray_masks(spark, d):
    masks = files.decoded(_named(files.encoded(X.gray(spark, d), ["red"])))
    return _values(files.as_prob(masks), F.round("prob", 6).alias("prob"))


@query("SELECT tile_id, row, col, red::DOUBLE AS red, green::DOUBLE AS green, blue::DOUBLE AS blue, nir::DOUBLE AS nir FROM gray WHERE row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 4")
def s03_tiff_window(spark, d):
    """A window of four-band 16-bit TIFFs."""
    blobs = files.encoded(X.gray(spark, d), ["red", "green", "blue", "nir"], "tiff", "uint16", tile=16, predictor=2)
    return _values(files.decoded(_named(blobs), 2, 1, 4, 4), *(F.col(f"v{k}").alias(name) for k, name in enumerate(("red", "green", "blue", "nir"))))


@query("SELECT tile_id, row, col, round(prob, 6) AS prob FROM pixels")
def s08_npy_masks(spark, d):
    found = files.decoded(_named(files.encoded(X.pixels(spark, d), ["prob"], "npy", "float64")))
    return _values(found, F.round("v0", 6).alias("prob"))


@query("SELECT (SELECT sum(population) FROM city_nodes)::BIGINT AS people, true AS missing_is_none")
def s20_population_if_there(spark, d):
    path = shared_folder(spark, "population")
    none = files.population_if_there(spark, path) is None and files.population_if_there(spark, None) is None
    X.city_nodes(spark, d).select("node_id", "population").write.parquet(path)
    return files.population_if_there(spark, path).agg(F.sum("population").alias("people"), F.lit(none).alias("missing_is_none"))


@query("SELECT tile_id, row, col, round(prob, 6) AS prob, round(conf, 6) AS conf FROM pixels")
def k01_masks_written(spark, d):
    path = shared_folder(spark, "masks")
    files.write_pixels(X.pixels(spark, d).withColumn("part", F.col("tile_id") % 4), path, "part")
    return spark.read.parquet(path).select("tile_id", "row", "col", F.round("prob", 6).alias("prob"), F.round("conf", 6).alias("conf"))


@query("SELECT tile_id, row, col, red::DOUBLE AS red, green::DOUBLE AS green, blue::DOUBLE AS blue, (red > 127)::INTEGER AS mask FROM gray")
def k07_image_and_mask(spark, d):
    """Colour and mask PNGs of each tile."""
    g = X.gray(spark, d).withColumn("mask", F.when(F.col("red") > 127, 255).otherwise(0))
    path = shared_folder(spark, "png")
    files.write_png(g, f"{path}/img", ["red", "green", "blue"])
    files.write_png(g, f"{path}/mask", ["mask"])
    image, mask = (files.decoded(_named(spark.read.parquet(f"{path}/{name}"))) for name in ("img", "mask"))
    image = _values(image, F.col("v0").alias("red"), F.col("v1").alias("green"), F.col("v2").alias("blue"))
    return image.join(_values(mask, (F.col("v0") / 255).cast("int").alias("mask")), ["tile_id", "row", "col"])


@query("SELECT tile_id, row, col, (red > 127)::INTEGER AS label FROM gray")
def k08_label_tiffs(spark, d):
    """Label rasters as LZW TIFFs of bytes, with a value for no data."""
    path = shared_folder(spark, "labels")
    files.write_tiff(X.gray(spark, d).withColumn("label", (F.col("red") > 127).cast("int")), path, ["label"], compression=5, no_data=255)
    return _values(files.decoded(_named(spark.read.parquet(path))), F.col("v0").cast("int").alias("label"))


# Vectors, graphs, reports.

_ENDS = "city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst"


@query(f"SELECT src, dst, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM {_ENDS}")
def s04_vector_read(spark, d):
    """Roads written as GeoJSON lines and read back."""
    path = shared_folder(spark, "geojson")
    e = rasters.with_ends(X.city_edges(spark, d), X.city_nodes(spark, d))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    files.write_geojson(e.select("src", "dst", F.array(point("x0", "y0"), point("x1", "y1")).alias("points")), path, ["src", "dst"])
    found = files.read_geojson(spark, path, whole=False).where("kind = 'LineString'")
    at = lambda k, c: F.get(F.get("lines", 0), k)[c]
    return found.select(*(F.col("properties")[c].cast("long").alias(c) for c in ("src", "dst")), at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(1, "x").alias("x1"), at(1, "y").alias("y1"))


@query(f"SELECT way_id, highway FROM ways WHERE highway IN ({', '.join(map(repr, S.LABEL_CLASSES))})")
def s06_given_ways(spark, d):
    """Ways that the caller has already: no fetch, the same filter."""
    return datasets.of_classes(X.ways(spark, d)).select("way_id", "highway")


@query("SELECT src, dst, round(length, 6) AS length, a.population + b.population AS people FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst")
def s07_graph_read(spark, d):
    path = shared_folder(spark, "graph")
    files.write_graph(X.city_nodes(spark, d), X.city_edges(spark, d), path)
    nodes, edges = files.read_graph(spark, path)
    people = lambda c: nodes.select(F.col("node_id").alias(c), F.col("population").alias(f"_{c}"))
    return edges.join(people("src"), "src").join(people("dst"), "dst").select("src", "dst", F.round("length", 6).alias("length"), (F.col("_src") + F.col("_dst")).alias("people"))


@query("SELECT 'post' AS stage, count(*) AS n FROM city_edges UNION ALL SELECT 'pre', count(*) FROM broken_edges")
def k02_graphs_written(spark, d):
    """The graph before and after healing, side by side."""
    path = shared_folder(spark, "graphs")
    n = X.city_nodes(spark, d)
    for stage, edges in (("pre", X.broken_edges(spark, d)), ("post", X.city_edges(spark, d))):
        files.write_graph(n, edges, f"{path}/{stage}")
    count = lambda stage: files.read_graph(spark, f"{path}/{stage}")[1].agg(F.lit(stage).alias("stage"), F.count("*").alias("n"))
    return count("pre").unionByName(count("post"))


def _report(spark, d):
    n, e = X.city_nodes(spark, d), X.city_edges(spark, d)
    figures = n.agg(F.count("*").alias("n_nodes")).crossJoin(e.agg(F.count("*").alias("n_edges")))
    reasons = e.groupBy(F.when(F.col("bridge"), "bridge").otherwise("road").alias("reason")).agg(F.count("*").alias("n"))
    top = _scores(n).join(n, "node_id").orderBy(F.desc("score"), "node_id").limit(3).select("node_id", "score", "x", "y")
    cases = X.scenarios(spark, d).groupBy("scenario").agg(F.count("*").cast("int").alias("n_disabled"), (F.count("*") / 1000).alias("index")).withColumn("polygon", F.lit("kept out"))
    return files.report(figures, reasons, top, cases), cases


_REPORTED = "SELECT scenario, count(*) AS n_disabled, (SELECT count(*) FROM city_nodes) AS n_nodes, (SELECT count(*) FROM city_edges WHERE bridge) AS n_bridges, false AS has_polygon FROM scenarios GROUP BY 1"


def _parsed(found):
    schema = "graph struct<n_nodes:long,n_edges:long>, rejections map<string,long>, scenarios array<struct<scenario:string,n_disabled:long,polygon:string>>"
    r = found.select(F.from_json("value", schema).alias("r")).select("r.*")
    one = r.select("graph", "rejections", F.explode("scenarios").alias("s"))
    return one.select("s.scenario", "s.n_disabled", "graph.n_nodes", F.coalesce(F.col("rejections")["bridge"], F.lit(0)).alias("n_bridges"), F.col("s.polygon").isNotNull().alias("has_polygon"))


@query(_REPORTED)
def k03_report_written(spark, d):
    path = shared_folder(spark, "report")
    files.write_text(_report(spark, d)[0], path)
    return _parsed(spark.read.text(path))


@query("SELECT rpad(scenario, 20, ' ') || ' disable=' || lpad(n::VARCHAR, 3, ' ') || '  RI=' || printf('%.4f', n / 1000.0) AS value FROM (SELECT scenario, count(*) AS n FROM scenarios GROUP BY 1)")
def k04_summary_written(spark, d):
    path = shared_folder(spark, "summary")
    cases = _report(spark, d)[1]
    hidden = cases.limit(1).withColumn("scenario", F.lit("_hidden")).unionByName(cases.limit(1).withColumn("scenario", F.lit("void")).withColumn("index", F.lit(None).cast("double")))
    files.write_text(files.summary_lines(cases.unionByName(hidden)), path)
    return spark.read.text(path)


@query("SELECT tile_id, count(*) AS n_scenarios, round(min(m), 4) AS least_index, round(avg(m), 4) AS mean_index FROM (SELECT tile_id, row, avg(prob) AS m FROM pixels GROUP BY 1, 2) GROUP BY 1")
def k05_batch_summary(spark, d):
    """Each row of a tile stands for a scenario."""
    return pipeline.batch_summary(X.pixels(spark, d).groupBy("tile_id", F.concat(F.lit("row"), "row").alias("scenario")).agg(F.avg("prob").alias("index")))


def _runs(spark, d) -> str:
    """Two runs below a folder: one beside the other's child, which lies deeper."""
    path = shared_folder(spark, "runs")
    value = _report(spark, d)[0].first()["value"]
    context = spark.sparkContext
    for folder, text in ((f"{path}/b", value), (f"{path}/a/deeper", "{}")):
        place = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/resilience_report.json")
        out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(text.encode()))
        out.close()
    return path


@query(_REPORTED)
def s09_report_found(spark, d):
    """Of several reports the one nearest the top."""
    return _parsed(files.find_reports(spark, _runs(spark, d)).limit(1))


@query("SELECT count(*) AS n_edges, (SELECT count(*) FROM city_nodes) AS n_nodes, (SELECT count(DISTINCT scenario) FROM scenarios) AS n_scenarios, true AS missing_is_none FROM city_edges")
def s10_cached_run(spark, d):
    path = _runs(spark, d)
    files.write_graph(X.city_nodes(spark, d), X.city_edges(spark, d), f"{path}/b/graph")
    nodes, edges, report = files.load_run(spark, path)
    empty = shared_folder(spark, "empty")
    spark.range(1).write.parquet(empty)
    cases = _parsed(report).agg(F.count("*").alias("n_scenarios"))
    return edges.agg(F.count("*").alias("n_edges")).crossJoin(nodes.agg(F.count("*").alias("n_nodes"))).crossJoin(cases).withColumn("missing_is_none", F.lit(files.load_run(spark, empty) is None))


# Sources that hold nothing, guards.


@query("SELECT '' AS dataset, '' AS stem, '' AS img, '' AS mask WHERE false")
def s17_empty_source(spark, d):
    return datasets.no_pairs(spark)


@query("SELECT 'laned' AS name, true AS refused")
def s18_refused_source(spark, d):
    try:
        datasets.unsupported_source("laned")
        refused = False
    except NotImplementedError:
        refused = True
    return spark.range(1).select(F.lit("laned").alias("name"), F.lit(refused).alias("refused"))


@query("SELECT tile_id, row, col, round(prob, 6) AS prob FROM pixels")
def p04_squeezed(spark, d):
    return X.pixels(spark, d).select("tile_id", "row", "col", F.round(rasters.single(F.array("prob")), 6).alias("prob"))


@query("""SELECT tile_id, CASE WHEN p >= 0.8 AND s >= 0.02 THEN 'STRONG' WHEN p >= 0.5 AND s >= 0.005 THEN 'MODERATE' WHEN p >= 0.2 THEN 'WEAK' ELSE 'NEAR_ZERO' END AS signal
  FROM (SELECT tile_id, max(prob) * (tile_id % 10) / 9.0::DOUBLE AS p, avg((prob >= 0.9)::INTEGER) AS s FROM pixels GROUP BY 1)""")
def p20_signal(spark, d):
    told = X.pixels(spark, d).groupBy("tile_id").agg(F.max("prob").alias("m"), F.avg((F.col("prob") >= 0.9).cast("int")).alias("s"))
    return told.select("tile_id", S.signal(F.col("m") * (F.col("tile_id") % 10) / 9.0, F.col("s")).alias("signal"))


@query("SELECT tile_id, 8 AS height, 8 AS width, 192 AS n FROM (SELECT DISTINCT tile_id FROM gray)")
def p21_bank_checked(spark, d):
    one = X.gray(spark, d).groupBy("tile_id").agg(F.flatten(F.collect_list(F.array("red", "green", "blue"))).alias("data"))
    bank = one.select("tile_id", F.lit(8).alias("height"), F.lit(8).alias("width"), "data")
    return datasets.check_bank(bank, "data", "height", "width").select("tile_id", "height", "width", F.size("data").alias("n"))


@query("SELECT way_id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, floor((lon + 180) / 6)::INTEGER + 1)))::INTEGER AS srid FROM ways")
def p24_projected(spark, d):
    w = X.ways(spark, d)
    return w.select("way_id", files.require_projected(S.utm_epsg(F.col("lon"), F.col("lat"))).alias("srid"))


@query("SELECT u, v, round(180 * (1 - aligned), 6) AS angle_deviation FROM told_broken")
def h03_angle_deviation(spark, d):
    told = healing.candidates(X.city_nodes(spark, d), X.broken_edges(spark, d), **_full_evidence(spark, d))
    return told.select("u", "v", F.round("angle_deviation", 6).alias("angle_deviation"))


@query("""WITH s AS (SELECT tile_id, avg(red) AS mean FROM gray GROUP BY 1) SELECT tile_id, round(CASE WHEN tile_id % 2 = 0 THEN -1.0::DOUBLE ELSE mean END, 6) AS mean FROM s""")
def l10_stats_filled_in(spark, d):
    """Statistics that are there stay; missing ones are put in."""
    fresh = X.gray(spark, d).groupBy("tile_id").agg(F.avg("red").alias("mean"))
    known = fresh.where("tile_id % 2 = 0").withColumn("mean", F.lit(-1.0))
    return datasets.with_stats(fresh, known, ["tile_id"]).select("tile_id", F.round("mean", 6).alias("mean"))


# Graphs.


@query("SELECT line_id, (1 + count(*) FILTER (abs(y - py) > 15))::BIGINT AS sets FROM (SELECT line_id, y, lag(y) OVER (PARTITION BY line_id ORDER BY k) AS py FROM line_points) GROUP BY 1")
def g08_disjoint_sets(spark, d):
    """Points of each line, joined to the next where that is no more than 15 metres off."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sets = len(pdf["y"].iloc[0]), Sets()
        y = np.asarray(pdf["y"].iloc[0], float)
        for k in np.flatnonzero(np.abs(np.diff(y)) <= 15).tolist():
            sets.join(k, k + 1)
        return pd.DataFrame({"line_id": [pdf["line_id"].iloc[0]], "sets": [len({sets.find(k) for k in range(n)})]})

    lines = X.polylines(spark, d).select("line_id", F.transform("points", lambda p: p["y"]).alias("y"))

    def each(batches):
        for batch in batches:
            for k in range(len(batch)):
                yield kernel(batch.iloc[k : k + 1])

    return lines.mapInPandas(each, "line_id long, sets long")


@query("SELECT count(*) AS before, count(*) FILTER (src % 10 <> 4 AND dst % 10 <> 4) AS left_over, count(*) AS still_there FROM city_edges")
def g19_snapshot(spark, d):
    """A graph that others are made of stays what it was."""
    n, e = X.city_nodes(spark, d), checkpoint(X.city_edges(spark, d))
    before = e.agg(F.count("*").alias("before"))
    left = graph.without_nodes(n, e, n.where("node_id % 10 = 4"))[1].agg(F.count("*").alias("left_over"))
    return before.crossJoin(left).crossJoin(e.agg(F.count("*").alias("still_there")))


_GT_RINGS = """WITH RECURSIVE m AS (SELECT tile_id, row, col FROM pixels WHERE gt), l AS (SELECT a.tile_id, a.row, a.col, b.row AS r2, b.col AS c2 FROM m a JOIN m b ON b.tile_id = a.tile_id
    AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 AND (a.row, a.col) <> (b.row, b.col)), g AS (SELECT tile_id, row, col, count(*) AS degree FROM l GROUP BY 1, 2, 3),
  r AS (SELECT tile_id, row, col, row AS r2, col AS c2 FROM g UNION SELECT r.tile_id, r.row, r.col, l.r2, l.c2 FROM r JOIN l ON l.tile_id = r.tile_id AND l.row = r.r2 AND l.col = r.c2),
  p AS (SELECT tile_id, row, col, min(r2 * 8 + c2) AS part FROM r GROUP BY 1, 2, 3), q AS (SELECT tile_id, part, sum((degree <> 2)::INTEGER) AS stops FROM p JOIN g USING (tile_id, row, col) GROUP BY 1, 2),
  rings AS (SELECT tile_id, count(*) AS n FROM q WHERE stops = 0 GROUP BY 1), ends AS (SELECT tile_id, sum(CASE WHEN degree <> 2 THEN degree ELSE 0 END) AS n, sum(degree) AS steps FROM g GROUP BY 1)
  SELECT tile_id, (ends.n // 2 + coalesce(rings.n, 0))::BIGINT AS n_lines, (steps // 2)::BIGINT AS n_steps FROM ends LEFT JOIN rings USING (tile_id)"""


@query(_GT_RINGS)
def r05_traced_lines(spark, d):
    """Lines of each tile's mask, and the steps that they take: each step from cell to cell is in one line."""
    found = tracing.lines(X.pixels(spark, d).select("tile_id", "row", "col", F.col("gt").alias("on")))
    return found.groupBy("tile_id").agg(F.count("*").alias("n_lines"), F.sum(F.size("line") - 1).alias("n_steps"))


@query("""SELECT line_id AS tile_id, 1::BIGINT AS src, max(k)::BIGINT AS dst, round(sum(sqrt((x - px)^2 + (y - py)^2)), 6) AS length, (2 * (count(*) - 1))::BIGINT AS n_px, count(*) AS n_points
  FROM (SELECT line_id, k, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY k)) GROUP BY 1 HAVING count(*) > 1""")
def g15_tidied(spark, d):
    """Lines as roads from point to point, with a spur of 4 metres at every other point but the ends: one road is left of each."""
    p = X.polylines(spark, d).select(F.col("line_id").alias("tile_id"), "points", F.size("points").alias("n"))
    steps = F.transform(F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: k < F.col("n")), lambda k: _road(k, k + 1, F.get("points", k - 1), F.get("points", k)))
    spurs = F.transform(F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: (k > 1) & (k < F.col("n")) & (k % 2 == 0)), lambda k: _road(k, k + 1000, F.get("points", k - 1), _off(F.get("points", k - 1), 4.0)))
    roads = p.where("n > 1").select("tile_id", F.explode(F.concat(steps, spurs)).alias("r")).select("tile_id", "r.*")
    found = tracing.tidied(roads, 5.0)
    return found.select("tile_id", "src", "dst", F.round("length", 6).alias("length"), F.col("n_px").cast("long").alias("n_px"), F.size("geometry").cast("long").alias("n_points"))


def _off(p, by):
    return F.struct(p["x"].alias("x"), (p["y"] + by).alias("y"))


def _road(a, b, p, q):
    length = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    at = [c.alias(n) for n, c in (("x0", p["x"]), ("y0", p["y"]), ("x1", q["x"]), ("y1", q["y"]))]
    line = F.array(*(F.struct(z["x"].alias("x"), z["y"].alias("y")) for z in (p, q)))
    return F.struct(a.cast("long").alias("src"), b.cast("long").alias("dst"), *at, length.alias("length"), F.lit(2).alias("n_px"), line.alias("geometry"))


@query("""SELECT node_id AS tile_id, CASE WHEN 1 + node_id % 4 < 2.5 THEN 4 ELSE 5 END::BIGINT AS n_roads, CASE WHEN 1 + node_id % 4 < 2.5 THEN 5 ELSE 6 END::BIGINT AS n_places,
  round(CASE WHEN 1 + node_id % 4 < 2.5 THEN x + (1 + node_id % 4) / 2.0::DOUBLE ELSE x END, 6) AS junction FROM city_nodes""")
def g16_junctions_merged(spark, d):
    """Two junctions at each node of the city, 1 to 4 metres apart, each with two roads of its own: those nearer than 2.5 become one."""
    n = X.city_nodes(spark, d).select(F.col("node_id").alias("tile_id"), "x", "y", (1 + F.col("node_id") % 4).cast("double").alias("gap"))
    a, b = F.struct("x", "y"), F.struct((F.col("x") + F.col("gap")).alias("x"), F.col("y").alias("y"))
    arms = [_road(F.lit(k), F.lit(j), p, F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))) for k, p, ends in ((1, a, ((3, -20.0, 9.0), (4, -20.0, -9.0))), (2, b, ((5, 20.0, 9.0), (6, 20.0, -9.0)))) for j, dx, dy in ends]
    roads = n.select("tile_id", F.explode(F.array(_road(F.lit(1), F.lit(2), a, b), *arms)).alias("r")).select("tile_id", "r.*")
    found = tracing.merged(roads, 2.5)
    places = F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))
    return found.groupBy("tile_id").agg(F.count("*").alias("n_roads"), F.size(places).cast("long").alias("n_places"), F.round(F.max(F.when(F.col("src") == 1, F.col("x0"))), 6).alias("junction"))
