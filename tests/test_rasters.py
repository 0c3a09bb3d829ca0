import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viastrata.functions import scalars as S
from viastrata.operators import datasets, rasters, spatial, synthetic, tracing
from viastrata.sources import files, tiff
from viastrata.streaming import closures


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("highway", "oneway", "lanes", "want"), [("primary", False, None, 4.0), ("primary", True, None, 2.0), ("primary", False, 2, 3.5), ("primary", True, 2, 1.75), ("lane", False, None, 2.0)])
def test_half_width(spark, highway, oneway, lanes, want):
    assert value(spark, S.half_width(F.lit(highway), F.lit(oneway), F.lit(lanes).cast("int"))) == want


@pytest.mark.parametrize(("lon", "lat", "want"), [(77.2, 28.6, 32643), (-0.1, 51.5, 32630), (151.2, -33.9, 32756), (180.0, 1.0, 32660)])
def test_utm(spark, lon, lat, want):
    assert value(spark, S.utm_epsg(F.lit(lon), F.lit(lat))) == want


def test_utm_range(spark):
    with pytest.raises(Exception, match="no such longitude"):
        value(spark, S.utm_epsg(F.lit(200.0), F.lit(0.0)))


@pytest.mark.parametrize(("bridge", "tunnel", "layer", "want"), [(True, True, None, -1), (True, False, None, 1), (True, None, 0, 1), (True, None, 3, 3), (False, None, -1, -1), (None, None, None, 0)])
def test_z_level(spark, bridge, tunnel, layer, want):
    b = lambda v: F.lit(v).cast("boolean")
    assert value(spark, S.z_level(b(bridge), b(tunnel), F.lit(layer).cast("int"))) == want


def test_affine_inverse_needs_one(spark):
    with pytest.raises(Exception, match="no inverse"):
        value(spark, S.affine_inverse(*(F.lit(v) for v in (1.0, 1.0, 1.0, 2.0, 0.0, 2.0, 4.0, 0.0)))[0])


def test_tile_plans(spark):
    size = spark.createDataFrame([(1024, 1000)], "h int, w int")
    plan = rasters.tile_plan(size, 512, 128).collect()
    assert {r["n_rows"] for r in plan} == {4} and max(r["row0"] for r in plan) + 512 == 1280
    columns = sorted({r["col0"] for r in rasters.patch_plan(size, 256, 25).collect()})
    assert (len(columns), columns[-1]) == (5, 744)
    with pytest.raises(ValueError, match="wider"):
        rasters.tile_plan(size, 256, 128)
    with pytest.raises(ValueError, match="overlap"):
        rasters.patch_plan(size, 256, 100)


def test_thinning():
    bar = np.zeros((7, 12), bool)
    bar[2:5, 1:11] = True
    line = rasters.thin(bar)
    assert line.sum() <= 10 and (line <= bar).all() and len(set(np.nonzero(line)[0])) == 1
    assert not rasters.thin(np.zeros((3, 3), bool)).any()


def test_label_hysteresis_and_small_parts():
    a = np.zeros((6, 6))
    a[0, 0], a[1, 1], a[4, 4], a[4, 5], a[5, 0] = 0.6, 0.9, 0.6, 0.6, 0.95
    assert len(set(rasters.label(a > 0).ravel())) == 4
    assert sorted(zip(*np.nonzero(rasters.hysteresis(a, 0.5, 0.9)), strict=True)) == [(0, 0), (1, 1), (5, 0)]
    assert rasters.drop_small(a > 0, 2).sum() == 4
    snake = np.zeros((21, 21), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert len(set(rasters.label(snake).ravel())) == 2


def test_distance_against_all_cells():
    rng = np.random.default_rng(3)
    mask = rng.random((9, 13)) < 0.7
    off = np.argwhere(~mask)
    want = np.array([[0 if not mask[r, c] else np.hypot(*(off - [r, c]).T).min() for c in range(13)] for r in range(9)])
    assert np.allclose(rasters.distance(mask), want)
    assert np.isinf(rasters.distance(np.ones((2, 2), bool))).all()


def cross():
    a = np.zeros((41, 41))
    a[19:22, 2:39] = a[2:39, 19:22] = 0.9
    return a


def test_cross_becomes_four_roads():
    graph = tracing.road_graph(cross(), least_branch=3.0)
    assert len(graph.roads) == 4 and sorted(graph.degree(n) for n in graph.near) == [1, 1, 1, 1, 4]
    assert 60 < sum(r.length for r in graph.roads.values()) < 80


def test_tidy_joins_a_road_and_drops_a_spur():
    g = tracing.RoadGraph()
    for k, p in enumerate([(0.0, 0.0), (10.0, 0.0), (20.0, 0.0), (10.0, 2.0)]):
        g.place[k] = p
    for a, b in ((0, 1), (1, 2), (1, 3)):
        g.add(a, b, tracing.Road(float(np.hypot(*np.subtract(g.place[a], g.place[b]))), [g.place[b], g.place[a]], 5))
    tracing.tidy(g, 5.0)
    assert list(g.roads) == [(0, 2)] and g.roads[0, 2].length == 20 and g.roads[0, 2].cells == 10


def test_ring_is_a_loop():
    a = np.zeros((9, 9), bool)
    a[2, 3:6] = a[6, 3:6] = True
    a[3:6, 2] = a[3:6, 6] = True
    (line,) = tracing.trace(a)
    assert line[0] == line[-1] and len(line) == 13


def test_lines_hold_each_step_once():
    rng = np.random.default_rng(0)
    for k in range(200):
        on = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < rng.random()
        on = rasters.thin(on) if k % 2 and on.any() else on
        cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(on), strict=True)}
        near = {p: [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in cells] for p in cells}
        lines = tracing.trace(on)
        steps = [frozenset(x) for line in lines for x in zip(line, line[1:], strict=False)]
        assert len(steps) == len(set(steps)) and set(steps) == {frozenset((p, q)) for p in cells for q in near[p]}
        inner = [p for line in lines for p in line[1:-1]]
        assert len(inner) == len(set(inner)) and all(len(near[p]) == 2 for p in inner)
        for line in lines:
            ring = line[0] == line[-1] and len(near[line[0]]) == 2
            assert line[0] == min(line) if ring else all(len(near[p]) != 2 for p in (line[0], line[-1]))


def test_tidy_of_any_graph():
    rng = np.random.default_rng(1)
    for k in range(120):
        n, least = int(rng.integers(3, 14)), [0.0, 3.0][k % 2]
        g = tracing.RoadGraph({i: (float(rng.integers(0, 9)), float(i)) for i in range(n)})
        for a, b in rng.integers(0, n, (int(rng.integers(2, 18)), 2)).tolist():
            if a != b:
                g.add(a, b, tracing.Road(float(np.hypot(*np.subtract(g.place[a], g.place[b]))), [g.place[b], g.place[a]], 2))
        junctions = {a for a in g.near if g.degree(a) not in (0, 2)}
        length = sum(r.length for r in g.roads.values())
        tracing.tidy(g, least)
        again = {key: r.length for key, r in g.roads.items()}
        for a, ends in g.near.items():
            assert ends and (len(ends) != 2 or a in ends or max(ends) in g.near[min(ends)])
            assert len(ends) != 1 or g.roads[min(a, *ends), max(a, *ends)].length >= least
        for (a, b), r in g.roads.items():
            assert {r.line[0], r.line[-1]} == {g.place[a], g.place[b]}
            assert abs(sum(float(np.hypot(*np.subtract(p, q))) for p, q in zip(r.line, r.line[1:], strict=False)) - r.length) < 1e-9
        if not least:
            assert abs(sum(again.values()) - length) < 1e-9 and junctions <= set(g.near)
        tracing.tidy(g, least)
        assert {key: r.length for key, r in g.roads.items()} == again


def pixels(spark, array, tile=0):
    r, c = np.indices(array.shape)
    return spark.createDataFrame(pd.DataFrame({"tile_id": tile, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "prob": array.ravel()}))


def test_graphs_of_tiles(spark):
    both = pixels(spark, cross()).unionByName(pixels(spark, np.zeros((5, 5)), 1))
    found = tracing.graphs(both, least_branch=3.0).collect()
    assert {r["tile_id"] for r in found} == {0} and len(found) == 4 and all(len(r["geometry"]) <= 3 for r in found)
    assert tracing.graphs(both, least_branch=3.0, least_prob=0.95).count() == 0


def test_blend_of_a_constant_is_it(spark):
    parts = pixels(spark, np.full((8, 8), 0.25)).withColumn("a", F.explode(F.array(F.lit(0), F.lit(4)))).withColumn("i", F.col("row") - F.col("a")).withColumn("j", F.col("col") % 4).where("i between 0 and 3")
    assert all(abs(r["prob"] - 0.25) < 1e-9 for r in rasters.window(rasters.blend(parts, 4), 1, 1, 2, 2).collect())


def test_model_batches_do_not_matter(spark):
    data = spark.range(5).select(F.col("id").alias("tile_id"), F.lit(0).alias("row0"), F.lit(0).alias("col0"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k + F.col("id")).cast("double")).alias("data"))
    model = lambda x: (x[:, 0] - x[:, 1], x[:, 1])
    one, many = (sorted(map(str, rasters.apply_model(data, model, 2, 2, batch=b).collect())) for b in (1, 4))
    assert one == many


def test_simplified_lines(spark):
    lines = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in p],) for p in ([(0, 0), (1, 0.1), (2, 0)], [(0, 0), (1, 5), (2, 0)], [(0, 0)], [(0, 0), (5, 0), (2, 0)])], "p array<struct<x:double,y:double>>")
    sizes = [tuple(r) for r in lines.select(F.size(spatial.simplified(F.col("p"), 1.0)), F.size(spatial.simplified(F.col("p"), 1.0, True))).collect()]
    assert sizes == [(2, 2), (3, 3), (1, 1), (2, 3)]


def test_made_up_raster(spark):
    nodes, edges = synthetic.city(spark, 3, 3, 30.0)
    left, gaps = synthetic.occlude(nodes, edges, 8, 2)
    raster = synthetic.predicted(nodes, left, gaps, noise=0.01)
    told = raster.agg(F.max("prob").alias("p"), F.max("conf").alias("c"), F.count("*").alias("n")).first()
    assert (told["p"], told["c"], told["n"]) == (0.92, 0.55, 70 * 70)
    with pytest.raises(ValueError, match="no roads"):
        synthetic.occlude(nodes, edges, 0, 9)


@pytest.mark.parametrize("kind", ["png", "npy", "pgm"])
def test_raster_files(spark, tmp_path, kind):
    a = np.arange(35, dtype=np.uint8).reshape(5, 7) * 7
    if kind == "npy":
        np.save(tmp_path / "a.npy", a)
    else:
        (tmp_path / f"a.{kind}").write_bytes(files.encode_png(a) if kind == "png" else b"P5\n7 5\n255\n" + a.tobytes())
    found = files.read_rasters(spark, str(tmp_path))
    got = {(r["row"], r["col"]): r["v0"] for r in found.collect()}
    assert got == {(r, c): float(a[r, c]) for r in range(5) for c in range(7)}
    assert files.as_prob(found).agg(F.max("prob").alias("p")).first()["p"] == a.max() / 255


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize(("kind", "predictor"), [("u1", 1), ("u2", 2), ("i4", 2), ("f4", 1), ("f8", 1)])
def test_tiff_and_its_windows(compression, tile, kind, predictor):
    rng = np.random.default_rng(compression)
    for channels in (1, 4):
        a = (rng.normal(size=(75, 50, channels)) * 40).astype(kind)
        data = tiff.encode(a, compression, tile, (500.0, 900.0), (2.0, 3.0), 32643, 255, predictor)
        assert (files.decode(data) == a).all() and (files.decode(data, 60, 10, 40, 7) == a[60:, 10:17]).all() and files.decode(data, 80, 0, 5, 5).size == 0
        head = tiff.read_head(data)
        assert (head.origin, head.cell, head.epsg, head.no_data, head.samples) == ((500.0, 900.0), (2.0, 3.0), 32643, 255.0, channels)


def test_lzw_by_hand():
    # The example of the format's own text: 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500, 4000, 70_000):
        data = rng.integers(0, 200, n, dtype=np.uint8).tobytes()
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    assert tiff._unpack_bits(bytes([254, 170, 2, 128, 0, 42, 128, 253, 170])) == bytes([170] * 3 + [128, 0, 42] + [170] * 4)


def test_tiff_of_either_order_and_planes(spark, tmp_path):
    from struct import pack

    a = np.arange(24, dtype=">u2").reshape(2, 4, 3)
    planes = a.transpose(2, 0, 1).tobytes()
    tags = [(256, 3, (4,)), (257, 3, (2,)), (258, 3, (16, 16, 16)), (259, 3, (1,)), (273, 4, (8, 24, 40)), (277, 3, (3,)), (278, 3, (2,)), (279, 4, (16, 16, 16)), (284, 3, (2,))]
    body, entries = bytearray(planes), b""
    for tag, kind, values in tags:
        raw = pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            raw, at = pack(">I", 8 + len(body)), body.extend(raw)
        entries += pack(">HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    data = b"MM" + pack(">HI", 42, 8 + len(body)) + bytes(body) + pack(">H", len(tags)) + entries + bytes(4)
    assert (files.decode(data) == a).all() and (files.decode(data, 1, 1, 1, 2) == a[1:, 1:3]).all()
    (tmp_path / "b.tif").write_bytes(data)
    (tmp_path / "c.tiff").write_bytes(tiff.encode(a.astype("u1"), origin=(1.0, 2.0), cell=(0.5, 0.5), epsg=32601))
    heads = {r["bands"]: r for r in files.read_heads(spark, str(tmp_path)).where("epsg is not null or x is null").collect()}
    assert heads[3]["width"] == 4 and files.read_heads(spark, str(tmp_path)).where("epsg = 32601 and x = 1 and cell_y = 0.5").count() == 1
    seen = files.read_rasters(spark, str(tmp_path), "b.tif", row=1, col=2, height=1, width=9).collect()
    assert {(r["row"], r["col"], r["v0"], r["v2"], r["v3"]) for r in seen} == {(1, 2, 18.0, 20.0, None), (1, 3, 21.0, 23.0, None)}
    with pytest.raises(ValueError, match="not a PNG, TIFF"):
        files.decode(b"II nothing")


def test_jpeg_through_the_image_source(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for r in range(8):
        for c in range(16):
            picture.setRGB(c, r, 0xC02040)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    got = files.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 128 and all(abs(r["v0"] - 0xC0) < 4 and abs(r["v1"] - 0x20) < 4 and abs(r["v2"] - 0x40) < 4 and r["v3"] is None for r in got)


def slow_thin(mask):
    """Zhang and Suen's rule, cell by cell."""
    on = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)}
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(on)
        for first in (True, False):
            gone = set()
            for r, c in on:
                p = [(r + a, c + b) in on for a, b in ring]
                turns = sum(not a and b for a, b in zip(p, p[1:] + p[:1], strict=True))
                n, e, s, w = p[0], p[2], p[4], p[6]
                sides = not (n and e and s) and not (e and s and w) if first else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and turns == 1 and sides:
                    gone.add((r, c))
            on -= gone
        if len(on) == before:
            return on


def test_centre_line_agreement_against_slow_thinning(spark):
    rng = np.random.default_rng(2)
    frames = []
    want = {}
    for tile in range(6):
        prob, gt = rng.random((9, 11)) ** (0.2 + 0.1 * tile), rng.random((9, 11)) < 0.75
        pred = prob >= 0.5
        a, b = slow_thin(pred), slow_thin(gt)
        assert a == {(int(r), int(c)) for r, c in zip(*np.nonzero(rasters.thin(pred)), strict=True)}
        p, q = sum(gt[x] for x in a) / (len(a) + 1e-6), sum(pred[x] for x in b) / (len(b) + 1e-6)
        want[tile] = 2 * p * q / (p + q + 1e-6)
        frames.append(pixels(spark, prob, tile).join(pixels(spark, gt.astype(float), tile).withColumnRenamed("prob", "gt"), ["tile_id", "row", "col"]))
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    got = {r["tile_id"]: r["cldice"] for r in rasters.soft_dice(both).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_texture_against_counting(spark):
    gray = np.random.default_rng(1).integers(0, 256, (7, 9)).astype(float)
    q = gray / 256 * 32
    got = {(r["row"], r["col"]): r["texture"] for r in rasters.cooccurrence_texture(pixels(spark, gray), "prob", 2).collect()}
    for r in range(7):
        for c in range(9):
            near = [(i, j) for i in range(max(r - 2, 0), min(r + 3, 7)) for j in range(max(c - 2, 0), min(c + 3, 9))]
            d = [[(q[i, j] - q[(i - dr) % 7, (j - dc) % 9]) ** 2 for i, j in near] for dr, dc in rasters.OFFSETS]
            assert abs(got[r, c] - np.mean(d) * (1 - np.mean(1 / (1 + np.array(d))))) < 1e-9


def test_png_filters():
    import zlib

    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    lines, above = b"", np.zeros(12, int)
    for kind, row in enumerate(a.reshape(5, 12).astype(int)):
        left, corner = np.r_[[0] * 3, row[:-3]], np.r_[[0] * 3, above[:-3]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines += bytes([kind]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    part = lambda k, b: len(b).to_bytes(4, "big") + k + b + b"0000"
    head = (4).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    assert (files.decode(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")) == a).all()


def test_vectors_and_graphs_and_reports(spark, tmp_path):
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"highway": "primary"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}}]}
    (tmp_path / "a.json").write_text(json.dumps(geo))
    kinds = {r["kind"]: r for r in files.read_geojson(spark, str(tmp_path / "a.json")).collect()}
    assert kinds["LineString"]["properties"] == {"highway": "primary"} and kinds["LineString"]["lines"][0][1]["y"] == 2.0 and len(kinds["Polygon"]["lines"][0]) == 4
    nodes, edges = synthetic.city(spark, 2, 2, 30.0)
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g"))[1].count() == edges.count()
    scenarios = spark.createDataFrame([("a", 2, 0.5), ("_meta", 0, 1.0), ("none", 0, None)], "scenario string, n_disabled int, index double")
    reasons = spark.createDataFrame([("soft_score", 3)], "reason string, n long")
    top = nodes.select("node_id", F.lit(0.5).alias("score"), "x", "y")
    told = json.loads(files.report(spark.range(1).select(F.lit(4).alias("nodes")), reasons, top, scenarios).first()["value"])
    assert told["graph"] == {"nodes": 4} and told["rejections"] == {"soft_score": 3} and len(told["scenarios"]) == 3
    assert [r["value"] for r in files.summary_lines(scenarios).collect()] == ["a                    disable=  2  RI=0.5000"]
    (tmp_path / "run" / "x").mkdir(parents=True)
    (tmp_path / "run" / "x" / "resilience_report.json").write_text("{}")
    assert files.find_reports(spark, str(tmp_path / "run")).first()["value"] == "{}"
    assert files.population_if_there(spark, str(tmp_path / "no")) is None and files.population_if_there(spark, None) is None
    files.write_png(pixels(spark, np.full((3, 3), 9.0)), str(tmp_path / "png"), ["prob"])
    assert (files.decode(bytes(spark.read.parquet(str(tmp_path / "png")).first()["data"])) == 9).all()


@pytest.mark.parametrize(("srid", "says"), [(None, "unknown"), (4326, "projected")])
def test_reference_system_guard(spark, srid, says):
    assert value(spark, files.require_projected(F.lit(32643))) == 32643
    with pytest.raises(Exception, match=says):
        value(spark, files.require_projected(F.lit(srid).cast("int")))


def test_sources_that_hold_nothing(spark):
    assert datasets.no_pairs(spark).count() == 0
    with pytest.raises(NotImplementedError):
        datasets.unsupported_source("maps")
    with pytest.raises(ValueError, match="none of"):
        datasets.audit(datasets.no_pairs(spark), ("a", "b"))
    with pytest.raises(ValueError, match="no ways"):
        datasets.require_rows(datasets.no_pairs(spark), "ways")


def test_stats_are_kept_unless_forced(spark):
    stats, new = (spark.createDataFrame(r, "k long, v long") for r in ([(1, 1), (2, 2)], [(2, 9), (3, 3)]))
    got = lambda force: sorted(map(tuple, datasets.with_stats(new, stats, ["k"], force).collect()))
    assert got(False) == [(1, 1), (2, 2), (3, 3)] and got(True) == [(1, 1), (2, 9), (3, 3)]


def test_bank_check(spark):
    bank = spark.createDataFrame([([0] * 12, 2, 2)], "d array<int>, h int, w int")
    assert datasets.check_bank(bank, "d", "h", "w").count() == 1
    with pytest.raises(Exception, match="channels"):
        datasets.check_bank(bank, "d", "h", "w", 4).count()


def test_weighted_draws_of_one_row_and_none(spark):
    w = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 0.0)], "k long, w double")
    draws = spark.range(20).select(F.col("id").alias("draw"), (F.col("id") / 20).alias("u"))
    assert {r["k"] for r in datasets.weighted_draws(w, "k", "w", draws).collect()} == {2}
    assert datasets.weighted_draws(w.limit(0), "k", "w", draws).count() == 0


def test_closure_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 4), ("2024-01-01 00:20:00", 4), ("2024-01-01 01:10:00", 0), ("2024-01-02 00:00:00", 1)], "ts string, node_id long").select(F.to_timestamp("ts").alias("ts"), "node_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    nodes, edges = synthetic.city(spark, 3, 3, 30.0)
    od = spark.createDataFrame([(0, 8)], "origin long, dest long")
    got = []
    run = closures.on_batch(nodes, edges, od, lambda df, k: got.extend(df.collect()))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    closures.closed_nodes(stream).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    told = {r["scenario"]: r for r in got}
    assert told["2024-01-01 00:00:00"]["lcc_size"] == 8 and told["2024-01-01 01:00:00"]["cut_off"] == 1
