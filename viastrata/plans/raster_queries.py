"""Queries of tiling, texture, shapes, lines and made-up inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, rasters, spatial, synthetic, tracing
from . import fixtures as X
from .registry import query
from .scalar_queries import _WIDTH_SQL as WIDTH_SQL

#: Tile sizes that plans are made for.
SIZES = [(1, 1024, 1000), (2, 512, 300), (3, 2000, 513), (4, 100, 100)]
_SIZES_SQL = "(VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in SIZES) + ") AS t(tile_id, h, w)"


def _sizes(spark):
    return spark.createDataFrame(SIZES, "tile_id int, h int, w int")


@query(f"""WITH s AS (SELECT tile_id, greatest(1, ceil((h + 256 - 512) / 256.0)::INTEGER + 1) AS n_rows, greatest(1, ceil((w + 256 - 512) / 256.0)::INTEGER + 1) AS n_cols FROM {_SIZES_SQL})
  SELECT tile_id, n_rows, n_cols, (i * 256)::INTEGER AS row0, (j * 256)::INTEGER AS col0 FROM s, range(20) a(i), range(20) b(j) WHERE i < n_rows AND j < n_cols""")
def r07_tile_plan(spark, d):
    return rasters.tile_plan(_sizes(spark)).select("tile_id", "n_rows", "n_cols", "row0", "col0")


_PATCHES = f"""WITH s AS (SELECT tile_id, h, w, greatest(1, ceil((h - 64) / 192.0)::INTEGER) AS nr, greatest(1, ceil((w - 64) / 192.0)::INTEGER) AS nc FROM {_SIZES_SQL})
  SELECT DISTINCT tile_id, least(i * 192, greatest(h - 256, 0))::INTEGER AS row0, least(j * 192, greatest(w - 256, 0))::INTEGER AS col0 FROM s, range(20) a(i), range(20) b(j) WHERE i < nr AND j < nc"""


@query(_PATCHES)
def r08_patch_plan(spark, d):
    return rasters.patch_plan(_sizes(spark)).select("tile_id", "row0", "col0")


@query(f"SELECT tile_id, 'tile_r' || lpad(row0::VARCHAR, 4, '0') || '_c' || lpad(col0::VARCHAR, 4, '0') AS name FROM ({_PATCHES})")
def k06_patch_names(spark, d):
    return rasters.patch_plan(_sizes(spark)).select("tile_id", "name")


@query("""WITH g AS (SELECT tile_id, i - 3 AS row, j - 3 AS col FROM (SELECT DISTINCT tile_id FROM pixels), range(14) a(i), range(14) b(j))
  SELECT g.tile_id, g.row::INTEGER AS row, g.col::INTEGER AS col, round(p.prob, 6) AS prob FROM g JOIN pixels p ON p.tile_id = g.tile_id
    AND p.row = CASE WHEN g.row < 0 THEN -g.row WHEN g.row > 7 THEN 14 - g.row ELSE g.row END AND p.col = CASE WHEN g.col < 0 THEN -g.col WHEN g.col > 7 THEN 14 - g.col ELSE g.col END""")
def r09_reflect_pad(spark, d):
    return rasters.padded(X.pixels(spark, d), X.SIDE, 3, ["prob"]).select("tile_id", "row", "col", F.round("prob", 6).alias("prob"))


@query("SELECT i::INTEGER AS i, j::INTEGER AS j, round(greatest(0.5 - 0.5 * cos(2 * pi() * i / 15), 1e-6) * greatest(0.5 - 0.5 * cos(2 * pi() * j / 15), 1e-6), 9) AS w FROM range(16) a(i), range(16) b(j)")
def r10_hann(spark, d):
    i = spark.range(16).select(F.col("id").cast("int").alias("i"))
    return i.crossJoin(i.withColumnRenamed("i", "j")).select("i", "j", F.round(S.hann(F.col("i"), 16) * S.hann(F.col("j"), 16), 9).alias("w"))


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A model that is a weighted sum of its channels."""
    return 4 * (x[:, 0] - 0.5) + 2 * (x[:, 1] - 0.5), x[:, 1]


@query("SELECT tile_id, row, col, round(1 / (1 + exp(-(4 * (red / 255.0 - 0.5) + 2 * (green / 255.0 - 0.5)))), 6) AS prob, round(green / 255.0, 6) AS conf FROM gray")
def r11_model_on_tiles(spark, d):
    g = X.gray(spark, d)
    cells = g.groupBy("tile_id").agg(F.sort_array(F.collect_list(F.struct("row", "col", "red", "green"))).alias("c"))
    data = F.concat(F.transform("c", lambda p: p["red"] / 255.0), F.transform("c", lambda p: p["green"] / 255.0))
    blocks = cells.select("tile_id", F.lit(0).alias("row0"), F.lit(0).alias("col0"), data.alias("data"))
    done = rasters.apply_model(blocks, _linear, 2, X.SIDE)
    at = done.select("tile_id", F.posexplode(F.arrays_zip("prob", "conf")).alias("i", "v"))
    return at.select("tile_id", F.expr("cast(i div 8 as int)").alias("row"), (F.col("i") % 8).alias("col"), F.round("v.prob", 6).alias("prob"), F.round("v.conf", 6).alias("conf"))


@query("""WITH p AS (SELECT tile_id, row, col, a.o AS a, b.o AS b, prob * (1 + a.o * 0.01::DOUBLE + b.o * 0.02::DOUBLE) AS v, row - a.o AS i, col - b.o AS j FROM pixels, (VALUES (0), (4)) a(o), (VALUES (0), (4)) b(o)),
  w AS (SELECT tile_id, row, col, v, greatest(0.5 - 0.5 * cos(2 * pi() * i / 3), 1e-6) * greatest(0.5 - 0.5 * cos(2 * pi() * j / 3), 1e-6) AS w FROM p WHERE i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 3)
  SELECT tile_id, row, col, round(sum(w * v) / greatest(sum(w), 1e-8), 6) AS prob FROM w GROUP BY 1, 2, 3""")
def a18_blend(spark, d):
    p = X.pixels(spark, d)
    offset = F.explode(F.array(F.lit(0), F.lit(4)))
    parts = p.withColumn("a", offset).withColumn("b", offset).withColumn("prob", F.col("prob") * (1 + F.col("a") * 0.01 + F.col("b") * 0.02))
    parts = parts.withColumn("i", F.col("row") - F.col("a")).withColumn("j", F.col("col") - F.col("b")).where("i between 0 and 3 and j between 0 and 3")
    return rasters.blend(parts, 4).withColumn("prob", F.round("prob", 6))


@query("SELECT tile_id, row, col, round(prob, 6) AS prob FROM pixels WHERE row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6")
def r12_tiled_equals_whole(spark, d):
    p = X.pixels(spark, d)
    parts = p.withColumn("a", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4)))).withColumn("b", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))))
    parts = parts.withColumn("i", F.col("row") - F.col("a")).withColumn("j", F.col("col") - F.col("b")).where("i between 0 and 3 and j between 0 and 3")
    # Windows are nothing at the border, which a plan's band keeps out of the raster.
    return rasters.window(rasters.blend(parts, 4), 1, 1, 6, 6).withColumn("prob", F.round("prob", 6))


@query("""SELECT p.tile_id, p.row, p.col, round(greatest(avg(q.red::DOUBLE * q.red) - avg(q.red)^2, 0), 4) AS texture FROM gray p JOIN gray q ON q.tile_id = p.tile_id AND abs(q.row - p.row) <= 2 AND abs(q.col - p.col) <= 2 GROUP BY 1, 2, 3""")
def t01_local_variance(spark, d):
    return rasters.local_variance(X.gray(spark, d), "red", 2).select("tile_id", "row", "col", F.round("texture", 4).alias("texture"))


_TEXTURE = """WITH q AS (SELECT tile_id, row, col, red / 256.0::DOUBLE * 32 AS q FROM gray), o AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) v(k, dr, dc)),
  d AS (SELECT a.tile_id, a.row, a.col, k, (a.q - b.q)^2 AS d FROM q a, o JOIN q b ON b.tile_id = a.tile_id AND b.row = (a.row - dr + 8) % 8 AND b.col = (a.col - dc + 8) % 8),
  n AS (SELECT p.tile_id, p.row, p.col, k, avg(d) AS c, avg(1 / (1 + d)) AS h FROM q p JOIN d ON d.tile_id = p.tile_id AND abs(d.row - p.row) <= 1 AND abs(d.col - p.col) <= 1 GROUP BY 1, 2, 3, 4)
  SELECT tile_id, row, col, avg(c) * (1 - avg(h)) AS texture FROM n GROUP BY 1, 2, 3"""


@query(f"SELECT tile_id, row, col, round(texture, 5) AS texture FROM ({_TEXTURE})")
def t02_cooccurrence(spark, d):
    return rasters.cooccurrence_texture(X.gray(spark, d), "red", 1, X.SIDE).select("tile_id", "row", "col", F.round("texture", 5).alias("texture"))


@query()
def t03_windowed_texture(spark, d):
    return rasters.windowed_texture(X.gray(spark, d), "red", window=5)


@query("SELECT tile_id, row, col, round(greatest(0, least(1, red / 180.0::DOUBLE)), 6) AS texture FROM gray")
def t04_normalized(spark, d):
    raw = X.gray(spark, d).select("tile_id", "row", "col", F.col("red").cast("double").alias("texture"))
    return rasters.normalized(raw, 180.0).withColumn("texture", F.round("texture", 6))


@query("SELECT tile_id, row, col, round(red / 255.0::DOUBLE, 6) AS gray, round(least(1, green / 200.0::DOUBLE), 6) AS texture FROM gray")
def t05_channels(spark, d):
    g = X.gray(spark, d)
    return g.select("tile_id", "row", "col", F.round(F.col("red") / 255.0, 6).alias("gray"), F.round(S.clipped(F.col("green") / 200.0, 0.0, 1.0), 6).alias("texture"))


@query("""SELECT p.tile_id, p.row, p.col FROM pixels p JOIN pixels q ON q.tile_id = p.tile_id AND p.gt AND NOT q.gt AND (q.row - p.row)^2 + (q.col - p.col)^2 <= 1 GROUP BY 1, 2, 3""")
def t06_narrow_cells(spark, d):
    return rasters.narrow_cells(X.pixels(spark, d), 1)


@query("""WITH n AS (SELECT p.tile_id, count(DISTINCT (p.row, p.col)) AS n FROM pixels p JOIN pixels q ON q.tile_id = p.tile_id AND p.gt AND NOT q.gt AND (q.row - p.row)^2 + (q.col - p.col)^2 <= 9 GROUP BY 1)
  SELECT tile_id, round(0.05 + 0.5 * CASE WHEN sum(gt::INTEGER) < 10 THEN 0 ELSE coalesce(max(n.n), 0) / 64.0 END + 0.5 * avg(occ::INTEGER), 6) AS score FROM pixels LEFT JOIN n USING (tile_id) GROUP BY 1""")
def a16_priority(spark, d):
    return rasters.priority(X.pixels(spark, d)).withColumn("score", F.round("score", 6))


_PARTS = """WITH RECURSIVE on_ AS (SELECT tile_id, row, col, prob FROM pixels WHERE prob >= LOW), r AS (SELECT tile_id, row, col, row AS r2, col AS c2 FROM on_
  UNION SELECT r.tile_id, r.row, r.col, o.row, o.col FROM r JOIN on_ o ON o.tile_id = r.tile_id AND abs(o.row - r.r2) <= 1 AND abs(o.col - r.c2) <= 1)"""


@query(_PARTS.replace("LOW", "0.5") + " SELECT DISTINCT r.tile_id, r.row, r.col FROM r JOIN on_ o ON o.tile_id = r.tile_id AND o.row = r.r2 AND o.col = r.c2 WHERE o.prob >= 0.9")
def r01_hysteresis(spark, d):
    return rasters.per_tile(X.pixels(spark, d), "prob", lambda a: rasters.hysteresis(a, 0.5, 0.9))


@query(_PARTS.replace("LOW", "0.6") + " SELECT tile_id, row, col FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 6")
def a17_drop_small(spark, d):
    return rasters.per_tile(X.pixels(spark, d), "prob", lambda a: rasters.drop_small(a >= 0.6, 6))


@query("""WITH m AS (SELECT tile_id, row, col FROM pixels WHERE gt), o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dr, dc)),
  dil AS (SELECT DISTINCT tile_id, row + dr AS row, col + dc AS col FROM m, o WHERE row + dr BETWEEN 0 AND 7 AND col + dc BETWEEN 0 AND 7)
  SELECT a.tile_id, a.row, a.col FROM dil a, o JOIN dil b ON b.tile_id = a.tile_id AND b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2, 3 HAVING count(*) = 5""")
def r02_closing(spark, d):
    return rasters.per_tile(X.pixels(spark, d), "gt", lambda a: rasters.close(a.astype(bool)))


@query("SELECT p.tile_id, p.row, p.col, count(q.row) - 1 AS degree FROM pixels p JOIN pixels q ON q.tile_id = p.tile_id AND abs(q.row - p.row) <= 1 AND abs(q.col - p.col) <= 1 WHERE p.gt AND q.gt GROUP BY 1, 2, 3")
def r04_neighbour_degree(spark, d):
    return rasters.neighbour_degree(X.pixels(spark, d).where("gt").select("tile_id", "row", "col"))


@query()
def r03_thinning(spark, d):
    return rasters.per_tile(X.pixels(spark, d), "gt", rasters.thin)


@query()
def r06_mask_to_graph(spark, d):
    return tracing.graphs(X.pixels(spark, d), least_branch=1.0, closing=0, least_cells=4)


@query()
def m08_centre_line_dice(spark, d):
    return rasters.soft_dice(X.pixels(spark, d))


@query("""SELECT p.tile_id, round(avg(CASE WHEN g.n = 0 THEN 0.5 ELSE least(1, coalesce((SELECT min(sqrt((q.row - p.row)^2 + (q.col - p.col)^2)) FROM pixels q WHERE q.tile_id = p.tile_id AND q.gt), 0) / 4) END
    * -(p.gt::INTEGER * ln(prob) + (1 - p.gt::INTEGER) * ln(1 - prob))), 5) AS loss FROM pixels p JOIN (SELECT tile_id, sum(gt::INTEGER) AS n FROM pixels GROUP BY 1) g USING (tile_id) GROUP BY 1""")
def m09_boundary_loss(spark, d):
    return rasters.boundary_loss(X.pixels(spark, d), 4.0).withColumn("loss", F.round("loss", 5))


# Lines.


@query("SELECT line_id, round(coalesce(sum(sqrt((x - px)^2 + (y - py)^2)), 0), 6) AS metres FROM (SELECT line_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY k)) GROUP BY 1")
def a14_polyline_length(spark, d):
    return X.polylines(spark, d).select("line_id", F.round(spatial.length(F.col("points")), 6).alias("metres"))


@query("SELECT line_id, x0, y0, x1, y1 FROM (SELECT line_id, x AS x1, y AS y1, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY k)) WHERE x0 IS NOT NULL")
def w07_segments(spark, d):
    return X.polylines(spark, d).select("line_id", F.explode(spatial.segments(F.col("points"))).alias("s")).select("line_id", "s.x0", "s.y0", "s.x1", "s.y1")


@query("""WITH RECURSIVE p AS (SELECT line_id, list(x ORDER BY k) AS xs, list(y ORDER BY k) AS ys, count(*)::INTEGER AS n FROM line_points GROUP BY 1),
  s(line_id, a, b) AS (SELECT line_id, 1, n FROM p WHERE n >= 2
    UNION ALL SELECT line_id, u.a, u.b FROM (
      SELECT s.line_id, s.a AS a0, s.b AS b0, (SELECT k FROM (SELECT k, round(abs((xs[k] - xs[s.a]) * (ys[s.b] - ys[s.a]) - (ys[k] - ys[s.a]) * (xs[s.b] - xs[s.a])) / sqrt((xs[s.b] - xs[s.a])^2 + (ys[s.b] - ys[s.a])^2), 9) AS g FROM range(s.a + 1, s.b) t(k)) WHERE g > 5 ORDER BY g DESC, k LIMIT 1)::INTEGER AS m
      FROM s JOIN p USING (line_id)) z, LATERAL (SELECT a0 AS a, m AS b UNION ALL SELECT m, b0) u WHERE m IS NOT NULL),
  kept AS (SELECT DISTINCT line_id, e FROM (SELECT line_id, a AS e FROM s UNION ALL SELECT line_id, b FROM s UNION ALL SELECT line_id, 1 FROM p))
  SELECT line_id, count(*) AS n FROM kept GROUP BY 1""")
def v03_simplify_line(spark, d):
    return X.polylines(spark, d).select("line_id", F.size(spatial.simplified(F.col("points"), 5.0)).cast("long").alias("n"))


@query()
def v04_simplify_segment(spark, d):
    return X.polylines(spark, d).select("line_id", spatial.simplified(F.col("points"), 5.0, to_segment=True).alias("points"))


@query("""SELECT line_id, round(((degrees(atan2(y2 - y1, x2 - x1)) % 180.0) + 180.0) % 180.0, 5) AS bearing FROM (SELECT line_id, max(x) FILTER (k = 1) AS x1, max(y) FILTER (k = 1) AS y1, max(x) FILTER (k = 2) AS x2, max(y) FILTER (k = 2) AS y2 FROM line_points GROUP BY 1)""")
def v05_first_tangent(spark, d):
    p = X.polylines(spark, d)
    first = F.get("points", 0)
    return p.select("line_id", F.round(spatial.tangent(F.col("points"), first["x"], first["y"], 5.0), 5).alias("bearing"))


@query("SELECT u AS node_id, v AS neighbour, round(((degrees(atan2(b.y - a.y, b.x - a.x)) % 180.0) + 180.0) % 180.0, 5) AS bearing FROM sym JOIN city_nodes a ON a.node_id = u JOIN city_nodes b ON b.node_id = v")
def v06_local_tangents(spark, d):
    e = X.city_edges(spark, d).withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))
    return spatial.local_tangents(X.city_nodes(spark, d), e).withColumn("bearing", F.round("bearing", 5))


_BUFFER = """WITH l AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst),
  e AS (SELECT unnest(range(-3, (max(y) / 5)::BIGINT + 4)) AS row FROM city_nodes), f AS (SELECT unnest(range(-3, (max(x) / 5)::BIGINT + 4)) AS col FROM city_nodes),
  c AS (SELECT row, col, (col + 0.5) * 5 AS px, (row + 0.5) * 5 AS py FROM e, f),
  s AS (SELECT row, col, px, py, x0, y0, x1, y1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0)^2 + (y1 - y0)^2) AS t FROM c, l WHERE px BETWEEN least(x0, x1) - 8 AND greatest(x0, x1) + 8 AND py BETWEEN least(y0, y1) - 8 AND greatest(y0, y1) + 8)
  SELECT DISTINCT row, col FROM s WHERE sqrt((px - x0 - greatest(0, least(1, t)) * (x1 - x0))^2 + (py - y0 - greatest(0, least(1, t)) * (y1 - y0))^2) <= 6.1"""


def _lines(spark, d):
    return rasters.with_ends(X.city_edges(spark, d), X.city_nodes(spark, d)).withColumn("half_width", F.lit(6.1))


@query(_BUFFER)
def v01_buffer_cells(spark, d):
    return spatial.buffer_cells(_lines(spark, d), 5.0)


@query(_BUFFER + " AND t BETWEEN 0 AND 1")
def v02_flat_buffer_cells(spark, d):
    return spatial.buffer_cells(_lines(spark, d), 5.0, flat=True)


@query("""SELECT row, col FROM range(0, 8) r(row), range(0, 8) c(col) WHERE ((row + 0.5) * 10 BETWEEN 12 AND 61 AND (col + 0.5) * 10 BETWEEN 3 AND 47)""")
def v07_fill_areas(spark, d):
    square = [[(3.0, 12.0), (47.0, 12.0), (47.0, 61.0), (3.0, 61.0)]]
    rings = spark.createDataFrame([([[{"x": x, "y": y} for x, y in ring] for ring in square],)], "rings array<array<struct<x:double,y:double>>>")
    return spatial.filled_cells(rings, 10.0)


_CLASSES = ", ".join(map(repr, S.LABEL_CLASSES))


@query(f"""WITH w AS (SELECT (lon + 180) * 50 + 0.137::DOUBLE AS x0, (lat + 90) * 50 + 0.271::DOUBLE AS y0, (CASE WHEN lanes > 0 THEN lanes * {S.LANE_WIDTH} ELSE {WIDTH_SQL} END)::DOUBLE * (CASE WHEN oneway THEN 0.5 ELSE 1 END) / 2 AS h FROM ways WHERE highway IN ({_CLASSES})),
  r AS (SELECT x0, y0, h, unnest(range(floor((y0 - h) / 0.5)::BIGINT, ceil((y0 + 30 + h) / 0.5)::BIGINT + 1)) AS row FROM w),
  c AS (SELECT x0, y0, h, row, unnest(range(floor((x0 - h) / 0.5)::BIGINT, ceil((x0 + 40 + h) / 0.5)::BIGINT + 1)) AS col FROM r),
  s AS (SELECT *, (((col + 0.5) * 0.5 - x0) * 40 + ((row + 0.5) * 0.5 - y0) * 30) / 2500.0::DOUBLE AS t FROM c)
  SELECT DISTINCT row, col FROM s WHERE t BETWEEN 0 AND 1 AND sqrt(((col + 0.5) * 0.5 - x0 - t * 40)^2 + ((row + 0.5) * 0.5 - y0 - t * 30)^2) <= h""")
def v08_label_raster(spark, d):
    """Ways to label cells: roads of the label classes as buffers of their widths, on metres east and north."""
    w = X.ways(spark, d).where(F.col("highway").isin(*S.LABEL_CLASSES))
    # Off the grid, so that no cell's middle lies on an edge.
    x, y = (F.col("lon") + 180) * 50 + 0.137, (F.col("lat") + 90) * 50 + 0.271
    lines = w.select(x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 30).alias("y1"), S.half_width(F.col("highway"), F.col("oneway"), F.col("lanes")).alias("half_width"))
    return spatial.buffer_cells(lines, 0.5, flat=True)


@query("""WITH l AS (SELECT a.y / 10 AS r0, a.x / 10 AS c0, b.y / 10 AS r1, b.x / 10 AS c1, 1 + src % 5 AS value FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst),
  s AS (SELECT round_even(r0 + (r1 - r0) * k / n, 0)::INTEGER AS row, round_even(c0 + (c1 - c0) * k / n, 0)::INTEGER AS col, value FROM (SELECT *, floor(greatest(abs(r1 - r0), abs(c1 - c0)))::INTEGER AS n FROM l), range(9) t(k) WHERE k <= n)
  SELECT (row + dr)::INTEGER AS row, (col + dc)::INTEGER AS col, max(value) AS value FROM s, range(-1, 2) a(dr), range(-1, 2) b(dc) GROUP BY 1, 2""")
def v09_paint_lines(spark, d):
    ends = rasters.with_ends(X.city_edges(spark, d), X.city_nodes(spark, d))
    lines = ends.select((F.col("y0") / 10).alias("r0"), (F.col("x0") / 10).alias("c0"), (F.col("y1") / 10).alias("r1"), (F.col("x1") / 10).alias("c1"), (1 + F.col("src") % 5).alias("value"))
    return spatial.paint_lines(lines, 1)


@query("""WITH t AS (SELECT count(DISTINCT tile_id) AS n FROM pixels), g AS (SELECT src, dst, (src * 7 + dst) % n AS tile_id, src % 10 AS c0, src // 10 % 8 AS r0, dst % 10 AS c1, src // 10 % 8 + dst // 10 - src // 10 AS r1 FROM city_edges, t),
  p AS (SELECT tile_id, src, dst, round_even(r, 0)::INTEGER AS row, round_even(c, 0)::INTEGER AS col FROM (SELECT tile_id, src, dst, unnest([r0::DOUBLE, (r0 + r1) / 2.0, r1::DOUBLE]) AS r, unnest([c0::DOUBLE, (c0 + c1) / 2.0, c1::DOUBLE]) AS c FROM g)),
  m AS (SELECT tile_id, src, dst, avg(prob) AS m FROM p JOIN pixels x USING (tile_id, row, col) GROUP BY 1, 2, 3)
  SELECT tile_id, src, dst FROM g WHERE (src, dst) NOT IN (SELECT src, dst FROM m WHERE m < 0.5)""")
def a13_edges_by_mean_prob(spark, d):
    """All roads of the city, dealt to the tiles, each laid onto its tile."""
    pixels = X.pixels(spark, d)
    n = pixels.select("tile_id").distinct().count()
    c, r = (lambda end: (F.col(end) % 10).cast("double")), F.expr("src div 10 % 8").cast("double")
    r1 = r + F.expr("dst div 10 - src div 10")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    lined = X.city_edges(spark, d).select(((F.col("src") * 7 + F.col("dst")) % n).alias("tile_id"), "src", "dst", F.array(point(c("src"), r), point((c("src") + c("dst")) / 2, (r + r1) / 2), point(c("dst"), r1)).alias("geometry"))
    return tracing.edges_by_mean_prob(lined, pixels, 0.5, ["tile_id"]).select("tile_id", "src", "dst")


# Made-up inputs.

_CITY = """WITH n AS (SELECT i AS node_id, i // 6 AS r, i % 6 AS c FROM range(36) t(i))"""


@query(_CITY + """ SELECT node_id, c * 30.0::DOUBLE AS x, r * 30.0::DOUBLE AS y, greatest(50, floor(800 - sqrt((r - 2.5)^2 + (c - 2.5)^2) * 120))::BIGINT AS population FROM n""")
def l08_city_nodes(spark, d):
    return synthetic.city(spark, 6, 6, 30.0)[0]


@query(_CITY + """ SELECT a.node_id AS src, b.node_id AS dst, round(CASE WHEN b.node_id - a.node_id = 7 THEN sqrt(1800.0::DOUBLE) ELSE 30 END, 6) AS length, b.node_id - a.node_id = 7 AS bridge FROM n a JOIN n b
  ON (b.node_id = a.node_id + 1 AND a.c < 5) OR b.node_id = a.node_id + 6 OR (b.node_id = a.node_id + 7 AND a.r = a.c)""")
def l08_city_edges(spark, d):
    return synthetic.city(spark, 6, 6, 30.0)[1].select("src", "dst", F.round("length", 6).alias("length"), "bridge")


@query("SELECT * FROM (VALUES (21, 28), (22, 28), (27, 28), (27, 33), (28, 29), (29, 35), (32, 33)) t(src, dst)")
def g18_occluded_gaps(spark, d):
    nodes, edges = synthetic.city(spark, 6, 6, 30.0)
    inside = spark.createDataFrame([(n,) for n in (28, 33, 34, 35)], "node_id long")
    return graph.boundary_edges(edges, inside).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query()
def l09_made_up_raster(spark, d):
    nodes, edges = synthetic.city(spark, 4, 4, 30.0)
    left, gaps = synthetic.occlude(nodes, edges, 15, 4)
    return synthetic.predicted(nodes, left, gaps)


@query("SELECT src, dst, bridge, CASE WHEN bridge THEN 'bridge' ELSE 'road' END AS layer_name, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM city_edges JOIN city_nodes a ON a.node_id = src JOIN city_nodes b ON b.node_id = dst")
def k09_map_layers(spark, d):
    e = rasters.with_ends(X.city_edges(spark, d), X.city_nodes(spark, d))
    return e.select("src", "dst", "bridge", F.when(F.col("bridge"), "bridge").otherwise("road").alias("layer_name"), "x0", "y0", "x1", "y1")


@query("""WITH w AS (SELECT tile_id, avg(green) / 200.0::DOUBLE AS m FROM gray GROUP BY 1) SELECT tile_id FROM w WHERE m > 0.65 ORDER BY md5('5' || tile_id::VARCHAR), tile_id LIMIT 50""")
def l06_canopy_bank(spark, d):
    texture = X.gray(spark, d).select("tile_id", "row", "col", F.col("green").alias("texture"))
    return rasters.textured_tiles(texture, 0.65, 50, "5", 200.0)


@query("""SELECT tile_id, row, col, floor((1 - a) * red + a * green)::INTEGER AS red FROM (SELECT *, greatest(0, least(1, 1 - ((row - 4) / 4.0::DOUBLE)^2 - ((col - 4) / 4.0::DOUBLE)^2)) * 0.75::DOUBLE AS a FROM gray)""")
def l05_canopy_paste(spark, d):
    alpha = rasters.canopy_alpha(F.col("row"), F.col("col"), X.SIDE, X.SIDE)
    return rasters.blend_patch(X.gray(spark, d), "red", F.col("green"), alpha).select("tile_id", "row", "col", "red")


@query("SELECT tile_id, row, col, CASE WHEN row BETWEEN 2 AND 4 AND col BETWEEN 1 AND 3 AND NOT gt THEN 0 ELSE prob END AS prob FROM (SELECT tile_id, row, col, gt, round(prob, 6) AS prob FROM pixels)")
def l05_cutout(spark, d):
    p = X.pixels(spark, d).withColumn("prob", F.round("prob", 6))
    return rasters.cutout(p, "prob", 2, 1, 3, 3, ~F.col("gt")).select("tile_id", "row", "col", "prob")


@query("SELECT tile_id, row, col, floor(red * (1 - 0.45::DOUBLE * greatest(0, 1 - sqrt((row - 3)^2 + (col - 4)^2) / 3)))::INTEGER AS red FROM gray")
def l05_shadow(spark, d):
    return rasters.shade(X.gray(spark, d), "red", 3.0, 4.0, 3.0, 0.45, 0).select("tile_id", "row", "col", "red")


@query("SELECT tile_id, row, col, least(255, floor(red + (255 - red) * 0.7::DOUBLE * greatest(0, 1 - sqrt((row - 3)^2 + (col - 4)^2) / 3)))::INTEGER AS red FROM gray")
def l05_cloud(spark, d):
    return rasters.shade(X.gray(spark, d), "red", 3.0, 4.0, 3.0, 0.7, 255).select("tile_id", "row", "col", "red")


@query("""WITH s AS MATERIALIZED (SELECT row + 1 AS row, col + 2 AS col, gt AS pasted FROM pixels WHERE tile_id = 0 AND row < 4 AND col < 4)
  SELECT tile_id, row, col, gt OR coalesce(pasted, false) AS gt FROM pixels LEFT JOIN s USING (row, col)""")
def l05_thin_road_paste(spark, d):
    p = X.pixels(spark, d).select("tile_id", "row", "col", F.col("gt").alias("gt"))
    snippet = p.where("tile_id = 0 and row < 4 and col < 4").select("row", "col", "gt")
    return rasters.paste_max(p, snippet, "gt", 1, 2)
