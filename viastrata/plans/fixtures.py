"""Road graphs, rasters, ways and listings derived from the generated tables, as frames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ROAD_WIDTHS

#: Metres between neighbouring nodes of the derived city; its columns; side of the small square rasters.
SPACING, COLUMNS, SIDE = 30.0, 10, 8
#: Road classes of the derived ways, in the order that part sizes pick them.
HIGHWAYS = tuple(ROAD_WIDTHS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def city_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.select(
        F.col("s_suppkey").cast("long").alias("node_id"),
        ((F.col("s_suppkey") % COLUMNS) * SPACING).cast("double").alias("x"),
        (F.expr(f"s_suppkey div {COLUMNS}") * SPACING).cast("double").alias("y"),
        (50 + (F.col("s_suppkey") * 37 + F.col("s_nationkey") * 11) % 750).cast("long").alias("population"),
    )


def city_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src < dst; length, bridge, layer. Neighbours to the right and below, and some diagonals, which are bridges."""
    nodes = city_nodes(spark, sf_dir).select("node_id")
    column = F.col("node_id") % COLUMNS
    step = F.explode(
        F.filter(
            F.array(
                F.when(column < COLUMNS - 1, F.struct(F.lit(1).alias("by"), F.lit(SPACING).alias("length"), F.lit(False).alias("bridge"))),
                F.struct(F.lit(COLUMNS).alias("by"), F.lit(SPACING).alias("length"), F.lit(False).alias("bridge")),
                F.when(
                    (F.col("node_id") % (COLUMNS + 1) == 0) & (column < COLUMNS - 1),
                    F.struct(F.lit(COLUMNS + 1).alias("by"), F.hypot(F.lit(SPACING), F.lit(SPACING)).alias("length"), F.lit(True).alias("bridge")),
                ),
            ),
            lambda x: x.isNotNull(),
        )
    )
    steps = nodes.select(F.col("node_id").alias("src"), step.alias("s")).select("src", (F.col("src") + F.col("s.by")).alias("dst"), "s.length", "s.bridge")
    there = nodes.select(F.col("node_id").alias("dst"))
    return steps.join(there, "dst", "left_semi").select("src", "dst", "length", "bridge", F.when(F.col("bridge"), 1).otherwise(0).alias("layer"))


def in_cluster(node: str) -> F.Column:
    return F.col(node) % COLUMNS >= 7


def broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city_edges(spark, sf_dir).where(in_cluster("src") == in_cluster("dst"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city_edges(spark, sf_dir).where(in_cluster("src") != in_cluster("dst"))


def node_count(spark: SparkSession, sf_dir: str) -> int:
    return city_nodes(spark, sf_dir).count()


def od_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many pairs as a fifth of the nodes, in a small city 20."""
    n = node_count(spark, sf_dir)
    return spark.range(max(min(20, n // 2), n // 5)).select(F.col("id").alias("origin"), (F.lit(n - 1) - F.col("id")).alias("dest"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, node_id) of what fails: one node, a column, the south, a tenth by hash."""
    nodes, n = city_nodes(spark, sf_dir), node_count(spark, sf_dir)
    tenth = nodes.select("node_id", F.md5(F.concat(F.lit("s"), F.col("node_id").cast("string"))).alias("h")).orderBy("h").limit(max(1, round(0.1 * n)))
    parts = [
        nodes.where(F.col("node_id") == n // 2).select(F.lit("single").alias("scenario"), "node_id"),
        nodes.where(F.col("node_id") % COLUMNS == 4).select(F.lit("column").alias("scenario"), "node_id"),
        nodes.where(F.col("y") < 90).select(F.lit("south").alias("scenario"), "node_id"),
        tenth.select(F.lit("tenth").alias("scenario"), "node_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = (F.col("node_id") * 7) % 11 - 5
    return city_nodes(spark, sf_dir).select("node_id", (F.col("x") + shift).alias("x"), "y")


def pred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city_edges(spark, sf_dir).where((F.col("src") * 5 + F.col("dst")) % 9 != 0)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("tile_id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return e.select("tile_id", "e", F.posexplode("e").alias("i", "v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, row, col, prob, gt, occ, conf) of SIDE x SIDE rasters."""
    cell = _cells(spark, sf_dir)
    sig = lambda v: 1 / (1 + F.exp(-8 * v))
    return cell.select(
        "tile_id", F.expr(f"i div {SIDE}").cast("int").alias("row"), (F.col("i") % SIDE).alias("col"), sig(F.col("v")).alias("prob"),
        (F.get("e", 63 - F.col("i")) > 0).alias("gt"), (F.get("e", (F.col("i") * 7) % 64) > 0.1).alias("occ"), sig(F.get("e", (F.col("i") * 5) % 64)).alias("conf"),
    )


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, row, col, red, green, blue, nir), 0 to 255; red is also the gray raster."""
    cell = _cells(spark, sf_dir)
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + v * 200))).cast("int")
    bands = [byte(F.get("e", (F.col("i") + 16 * k) % 64)).alias(name) for k, name in enumerate(("red", "green", "blue", "nir"))]
    return cell.select("tile_id", F.expr(f"i div {SIDE}").cast("int").alias("row"), (F.col("i") % SIDE).alias("col"), *bands)


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return p.select(
        F.col("p_partkey").cast("long").alias("way_id"),
        F.get(F.array(*map(F.lit, HIGHWAYS)), (F.col("p_size") - 1) % len(HIGHWAYS)).alias("highway"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4).cast("int").alias("lanes"),
        (F.col("p_partkey") % 3 == 0).alias("oneway"),
        ((F.col("p_partkey") * 7 % 3600) / 10.0 - 180).cast("double").alias("lon"),
        ((F.col("p_partkey") * 13 % 1800) / 10.0 - 90).cast("double").alias("lat"),
    )


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, points array<struct<x,y>>) of each order's items; all columns order them, as line numbers repeat."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = item.groupBy(F.col("l_orderkey").cast("long").alias("line_id")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))).alias("items")
    )
    points = F.transform("items", lambda it, i: F.struct(((i + 1) * 10.0).cast("double").alias("x"), it["l_quantity"].cast("double").alias("y")))
    return rows.select("line_id", points.alias("points"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) of images and masks that the documents stand for: <source>/images/d<id>.tiff and <source>/masks/d<id>.png."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    image = d.where("doc_id % 5 <> 0").select(F.concat("source", F.lit("/images/d"), F.col("doc_id").cast("string"), F.lit(".tiff")).alias("path"))
    mask = d.where("doc_id % 3 <> 0").select(F.concat("source", F.lit("/masks/d"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return image.unionByName(mask)


#: The same tables in SQL.
SQL = {
    "city_nodes": """
      SELECT s_suppkey::BIGINT AS node_id, ((s_suppkey % 10) * 30.0)::DOUBLE AS x, ((s_suppkey // 10) * 30.0)::DOUBLE AS y,
             (50 + (s_suppkey * 37 + s_nationkey * 11) % 750)::BIGINT AS population FROM supplier""",
    "city_edges": """
      SELECT a.node_id AS src, b.node_id AS dst,
             CASE WHEN b.node_id - a.node_id = 11 THEN sqrt(1800.0::DOUBLE) ELSE 30.0::DOUBLE END AS length,
             b.node_id - a.node_id = 11 AS bridge, CASE WHEN b.node_id - a.node_id = 11 THEN 1 ELSE 0 END AS layer
      FROM city_nodes a JOIN city_nodes b
        ON (b.node_id = a.node_id + 1 AND a.node_id % 10 < 9) OR b.node_id = a.node_id + 10
        OR (b.node_id = a.node_id + 11 AND a.node_id % 11 = 0 AND a.node_id % 10 < 9)""",
    "broken_edges": "SELECT * FROM city_edges WHERE (src % 10 >= 7) = (dst % 10 >= 7)",
    "gaps": "SELECT * FROM city_edges WHERE (src % 10 >= 7) <> (dst % 10 >= 7)",
    "city_size": "SELECT count(*) AS n FROM city_nodes",
    "od_pairs": "SELECT node_id AS origin, n - 1 - node_id AS dest FROM city_nodes, city_size WHERE node_id < greatest(least(20, n // 2), n // 5)",
    "scenarios": """
      SELECT 'single' AS scenario, node_id FROM city_nodes, city_size WHERE node_id = n // 2
      UNION ALL SELECT 'column', node_id FROM city_nodes WHERE node_id % 10 = 4
      UNION ALL SELECT 'south', node_id FROM city_nodes WHERE y < 90
      UNION ALL SELECT 'tenth', node_id FROM (SELECT node_id, row_number() OVER (ORDER BY md5('s' || node_id::VARCHAR)) AS k FROM city_nodes), city_size
                WHERE k <= greatest(1, round_even(0.1 * n, 0))""",
    "pred_nodes": "SELECT node_id, x + (node_id * 7) % 11 - 5 AS x, y FROM city_nodes",
    "pred_edges": "SELECT * FROM city_edges WHERE (src * 5 + dst) % 9 <> 0",
    "cells": """
      SELECT vec_id::BIGINT AS tile_id, e, i, e[i + 1] AS v
      FROM (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings), range(64) t(i)""",
    "pixels": """
      SELECT tile_id, (i // 8)::INTEGER AS row, (i % 8)::INTEGER AS col, 1 / (1 + exp(-8 * v)) AS prob, e[64 - i] > 0 AS gt,
             e[(i * 7) % 64 + 1] > 0.1 AS occ, 1 / (1 + exp(-8 * e[(i * 5) % 64 + 1])) AS conf FROM cells""",
    "gray": """
      SELECT tile_id, (i // 8)::INTEGER AS row, (i % 8)::INTEGER AS col, greatest(0, least(255, floor(128 + v * 200)))::INTEGER AS red,
             greatest(0, least(255, floor(128 + e[(i + 16) % 64 + 1] * 200)))::INTEGER AS green,
             greatest(0, least(255, floor(128 + e[(i + 32) % 64 + 1] * 200)))::INTEGER AS blue,
             greatest(0, least(255, floor(128 + e[(i + 48) % 64 + 1] * 200)))::INTEGER AS nir FROM cells""",
    "ways": f"""
      SELECT p_partkey::BIGINT AS way_id, [{", ".join(repr(h) for h in HIGHWAYS)}][((p_size - 1) % {len(HIGHWAYS)} + 1)::INTEGER] AS highway,
             CASE WHEN p_size % 4 <> 0 THEN (p_size % 4)::INTEGER END AS lanes, p_partkey % 3 = 0 AS oneway,
             (p_partkey * 7 % 3600)::DOUBLE / 10.0 - 180 AS lon, (p_partkey * 13 % 1800)::DOUBLE / 10.0 - 90 AS lat FROM part""",
    "line_points": """
      SELECT l_orderkey::BIGINT AS line_id, k, 10.0::DOUBLE * k AS x, l_quantity::DOUBLE AS y FROM (
        SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem)""",
    "listing": """
      SELECT source || '/images/d' || doc_id::VARCHAR || '.tiff' AS path FROM documents WHERE doc_id % 5 <> 0
      UNION ALL SELECT source || '/masks/d' || doc_id::VARCHAR || '.png' FROM documents WHERE doc_id % 3 <> 0""",
    "sym": "SELECT src AS u, dst AS v, length FROM city_edges UNION ALL SELECT dst, src, length FROM city_edges",
    "sym_pred": "SELECT src AS u, dst AS v, length FROM pred_edges UNION ALL SELECT dst, src, length FROM pred_edges",
    "reach_broken": """SELECT node_id AS a, node_id AS b FROM city_nodes UNION SELECT r.a, CASE WHEN e.src = r.b THEN e.dst ELSE e.src END
      FROM reach_broken r JOIN broken_edges e ON e.src = r.b OR e.dst = r.b""",
    "parts_broken": "SELECT a AS node_id, min(b) AS component FROM reach_broken GROUP BY 1",
    "reach_pred": "SELECT node_id AS a, node_id AS b FROM pred_nodes UNION SELECT r.a, s.v FROM reach_pred r JOIN sym_pred s ON s.u = r.b",
    "parts_pred": "SELECT a AS node_id, min(b) AS component FROM reach_pred GROUP BY 1",
    "reach_true": "SELECT node_id AS a, node_id AS b FROM city_nodes UNION SELECT r.a, s.v FROM reach_true r JOIN sym s ON s.u = r.b",
    "parts_true": "SELECT a AS node_id, min(b) AS component FROM reach_true GROUP BY 1",
    "sp_true": """SELECT node_id, node_id, 0.0::DOUBLE FROM city_nodes UNION
      SELECT f.source, s.v, min(f.dist + s.length) FROM sp_true f JOIN sym s ON s.u = f.node_id LEFT JOIN recurring.sp_true r ON r.source = f.source AND r.node_id = s.v
      WHERE r.dist IS NULL OR f.dist + s.length < r.dist GROUP BY 1, 2""",
    "sp_pred": """SELECT node_id, node_id, 0.0::DOUBLE FROM pred_nodes UNION
      SELECT f.source, s.v, min(f.dist + s.length) FROM sp_pred f JOIN sym_pred s ON s.u = f.node_id LEFT JOIN recurring.sp_pred r ON r.source = f.source AND r.node_id = s.v
      WHERE r.dist IS NULL OR f.dist + s.length < r.dist GROUP BY 1, 2""",
    "left_nodes": """SELECT scenario, node_id, population FROM city_nodes, (SELECT DISTINCT scenario FROM scenarios)
      WHERE (scenario, node_id) NOT IN (SELECT scenario, node_id FROM scenarios)""",
    "left_sym": """SELECT scenario, u, v, length FROM sym, (SELECT DISTINCT scenario FROM scenarios)
      WHERE (scenario, u) NOT IN (SELECT scenario, node_id FROM scenarios) AND (scenario, v) NOT IN (SELECT scenario, node_id FROM scenarios)""",
    "reach_left": "SELECT scenario, node_id AS a, node_id AS b FROM left_nodes UNION SELECT r.scenario, r.a, s.v FROM reach_left r JOIN left_sym s ON s.scenario = r.scenario AND s.u = r.b",
    "parts_left": "SELECT scenario, a AS node_id, min(b) AS component FROM reach_left GROUP BY 1, 2",
    "sp_left": """SELECT scenario, origin, origin, 0.0::DOUBLE FROM od_pairs JOIN left_nodes ON node_id = origin UNION
      SELECT f.scenario, f.source, s.v, min(f.dist + s.length) FROM sp_left f JOIN left_sym s ON s.scenario = f.scenario AND s.u = f.node_id
      LEFT JOIN recurring.sp_left r ON r.scenario = f.scenario AND r.source = f.source AND r.node_id = s.v WHERE r.dist IS NULL OR f.dist + s.length < r.dist GROUP BY 1, 2, 3""",
    "deltas": """SELECT s.scenario, o.origin, o.dest, b.dist AS base, p.dist AS perturbed FROM (SELECT DISTINCT scenario FROM scenarios) s CROSS JOIN od_pairs o
      LEFT JOIN sp_true b ON b.source = o.origin AND b.node_id = o.dest LEFT JOIN sp_left p ON p.scenario = s.scenario AND p.source = o.origin AND p.node_id = o.dest""",
    "snap_true": """SELECT node_id, match FROM (SELECT a.node_id, b.node_id AS match, row_number() OVER (PARTITION BY a.node_id ORDER BY sqrt((a.x - b.x)^2 + (a.y - b.y)^2), b.node_id) AS k
      FROM city_nodes a JOIN pred_nodes b ON (a.x - b.x)^2 + (a.y - b.y)^2 <= 225) WHERE k = 1""",
    "snap_pred": """SELECT node_id, match FROM (SELECT a.node_id, b.node_id AS match, row_number() OVER (PARTITION BY a.node_id ORDER BY sqrt((a.x - b.x)^2 + (a.y - b.y)^2), b.node_id) AS k
      FROM pred_nodes a JOIN city_nodes b ON (a.x - b.x)^2 + (a.y - b.y)^2 <= 225) WHERE k = 1""",
    "apls_there_t": """SELECT coalesce(1 - avg(CASE WHEN q.dist IS NULL THEN 1 ELSE least(1, abs(p.dist - q.dist) / p.dist) END), 1) AS score, count(*) AS n
      FROM sp_true p LEFT JOIN snap_true ma ON ma.node_id = p.source LEFT JOIN snap_true mb ON mb.node_id = p.node_id LEFT JOIN sp_pred q ON q.source = ma.match AND q.node_id = mb.match
      WHERE p.source < p.node_id""",
    "apls_back_t": """SELECT coalesce(1 - avg(CASE WHEN q.dist IS NULL THEN 1 ELSE least(1, abs(p.dist - q.dist) / p.dist) END), 1) AS score, count(*) AS n
      FROM sp_pred p LEFT JOIN snap_pred ma ON ma.node_id = p.source LEFT JOIN snap_pred mb ON mb.node_id = p.node_id LEFT JOIN sp_true q ON q.source = ma.match AND q.node_id = mb.match
      WHERE p.source < p.node_id""",
    "joined_true": """SELECT e.src, e.dst, e.length, coalesce(ca.component = cb.component, false) AS joined FROM city_edges e LEFT JOIN snap_true ma ON ma.node_id = e.src LEFT JOIN snap_true mb ON mb.node_id = e.dst
      LEFT JOIN parts_pred ca ON ca.node_id = ma.match LEFT JOIN parts_pred cb ON cb.node_id = mb.match""",
    "joined_pred": """SELECT e.src, e.dst, e.length, coalesce(ca.component = cb.component, false) AS joined FROM pred_edges e LEFT JOIN snap_pred ma ON ma.node_id = e.src LEFT JOIN snap_pred mb ON mb.node_id = e.dst
      LEFT JOIN parts_true ca ON ca.node_id = ma.match LEFT JOIN parts_true cb ON cb.node_id = mb.match""",
    "deg_broken": "SELECT node_id, count(e.src) AS degree FROM city_nodes LEFT JOIN broken_edges e ON e.src = node_id OR e.dst = node_id GROUP BY 1",
    "stub_broken": """SELECT node_id FROM deg_broken WHERE degree <= 4 UNION SELECT CASE WHEN e.src = d.node_id THEN e.dst ELSE e.src END
      FROM broken_edges e JOIN deg_broken d ON (e.src = d.node_id OR e.dst = d.node_id) WHERE d.degree <= 1""",
    "near_broken": """SELECT a.node_id AS u, b.node_id AS v, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS distance FROM city_nodes a JOIN city_nodes b ON a.node_id < b.node_id
      AND (a.x - b.x)^2 + (a.y - b.y)^2 <= 2500 JOIN stub_broken sa ON sa.node_id = a.node_id JOIN stub_broken sb ON sb.node_id = b.node_id
      JOIN parts_broken pa ON pa.node_id = a.node_id JOIN parts_broken pb ON pb.node_id = b.node_id WHERE pa.component <> pb.component""",
    "gated": """SELECT u, v, distance, CASE WHEN distance <= 15 THEN 1 ELSE greatest(0, 1 - distance / 40) END AS aligned FROM near_broken""",
    "told_broken": """SELECT u, v, distance, aligned, CASE WHEN distance > 50 THEN 'gap_distance' WHEN distance <= 15 OR (distance <= 30 AND aligned >= 0.5)
      OR 0.85::DOUBLE * (0.5 * greatest(0, 1 - distance / 50) + 0.5 * aligned) + 0.15::DOUBLE * 1.0 >= 0.40::DOUBLE THEN NULL ELSE 'soft_score' END AS reason FROM gated""",
}
#: Of recursive tables that keep the best row of a key, their heads.
KEYED = {
    "sp_true": "sp_true(source, node_id, dist) USING KEY (source, node_id)",
    "sp_pred": "sp_pred(source, node_id, dist) USING KEY (source, node_id)",
    "sp_left": "sp_left(scenario, source, node_id, dist) USING KEY (scenario, source, node_id)",
}
