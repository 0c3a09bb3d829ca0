"""Files of rasters, vectors, graphs and reports, read by Spark's own readers from wherever these reach.

Rasters are PNG, TIFF (tiff.py), NumPy's .npy, PGM and PPM; JPEG and what else the JVM knows comes through Spark's image source."""

from __future__ import annotations

import io
import zlib
from struct import unpack

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import by_tasks
from . import tiff


def _png(data: bytes) -> np.ndarray:
    """(h, w, channels) of an 8-bit PNG of gray, colours or either with alpha, not interlaced."""
    at, head, packed = 8, b"", []
    while at < len(data):
        size, kind = unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    w, h, depth, colour, _, _, interlaced = unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or not channels:
        raise ValueError("only 8-bit gray or colour PNG without interlacing is read")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for r in range(h):
        kind, line = int(rows[r, 0]), rows[r, 1:]
        if kind == 0:
            out[r] = line
        elif kind == 2:
            out[r] = line + above
        elif kind == 1:
            out[r] = np.cumsum(line.reshape(w, channels), axis=0, dtype=np.uint8).ravel()
        else:
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for c in range(0, w * channels, channels):
                up = above[c : c + channels].astype(np.int64)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
                left = (line[c : c + channels] + guess) % 256
                out[r, c : c + channels] = left
                corner = up
        above = out[r]
    return out.reshape(h, w, channels)


def encode_png(array: np.ndarray) -> bytes:
    """An 8-bit PNG of (h, w) gray or (h, w, 3) colours."""
    array = np.ascontiguousarray(array, np.uint8)
    h, w = array.shape[:2]
    lines = np.hstack([np.zeros((h, 1), np.uint8), array.reshape(h, -1)]).tobytes()
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2 if array.ndim == 3 else 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def decode(data: bytes, row: int = 0, col: int = 0, height: int | None = None, width: int | None = None) -> np.ndarray:
    """(h, w, channels) of a window of a PNG, a TIFF, NumPy's .npy, or of binary PGM or PPM; of a TIFF no more is unpacked."""
    if tiff.is_tiff(data):
        return tiff.read_window(data, row, col, height, width)
    whole = _decode(data)
    return whole[max(row, 0) : whole.shape[0] if height is None else max(row + height, 0), max(col, 0) : whole.shape[1] if width is None else max(col + width, 0)]


def _decode(data: bytes) -> np.ndarray:
    if data[:4] == b"\x89PNG":
        return _png(data)
    if data[:6] == b"\x93NUMPY":
        array = np.load(io.BytesIO(data), allow_pickle=False)
        return array[:, :, None] if array.ndim == 2 else array
    if data[:2] in (b"P5", b"P6"):
        fields = data.split(None, 4)
        w, h = int(fields[1]), int(fields[2])
        start = data.index(fields[3], 2 + len(fields[1]) + len(fields[2])) + len(fields[3]) + 1
        channels = 3 if data[:2] == b"P6" else 1
        return np.frombuffer(data, np.uint8, h * w * channels, start).reshape(h, w, channels)
    raise ValueError("not a PNG, TIFF, .npy, PGM or PPM file")


RASTERS = "*.{png,tif,tiff,npy,pgm,ppm}"
_CELLS = "path string, row int, col int, v0 double, v1 double, v2 double, v3 double"


def _cells(name: str, array: np.ndarray, row: int = 0, col: int = 0) -> pd.DataFrame:
    h, w, channels = array.shape
    r, c = np.divmod(np.arange(h * w), max(w, 1))
    flat = array.reshape(h * w, channels).astype(float)
    values = {f"v{k}": flat[:, k] if k < channels else np.full(h * w, np.nan) for k in range(4)}
    return pd.DataFrame({"path": name, "row": (r + row).astype(np.int32), "col": (c + col).astype(np.int32), **values})


def decoded(files: DataFrame, row: int = 0, col: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """(path, row, col, v0, v1, v2, v3) of a window of each of the files (path, content); channels that a file lacks are null."""

    def cells(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield _cells(name, decode(bytes(data), row, col, height, width), max(row, 0), max(col, 0))

    found = files.select("path", "content").mapInPandas(cells, _CELLS)
    return found.withColumns({f"v{k}": F.nullif(f"v{k}", F.lit(float("nan"))) for k in range(4)})


def read_rasters(spark: SparkSession, path: str, pattern: str = RASTERS, **window: int) -> DataFrame:
    """decoded(), of the image files below a folder. A file is a row of one task."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path), **window)


def read_images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg}") -> DataFrame:
    """The same of files that Spark's image source decodes: JPEG, GIF, BMP, PNG; v0 to v2 are red, green, blue, or v0 gray."""
    images = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("dropInvalid", True).load(path).select("image.*")

    def cells(batches):
        for batch in batches:
            for name, h, w, n, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                array = np.frombuffer(bytes(data), np.uint8).reshape(h, w, n)
                # Blue comes first there.
                yield _cells(name, array[:, :, [2, 1, 0, *range(3, n)]] if n >= 3 else array)

    found = images.select("origin", "height", "width", "nChannels", "data").mapInPandas(cells, _CELLS)
    return found.withColumns({f"v{k}": F.nullif(f"v{k}", F.lit(float("nan"))) for k in range(4)})


def read_heads(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """(path, height, width, bands, x, y, cell_x, cell_y, epsg, no_data) of TIFF files; null where a file does not say."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def heads(batches):
        for batch in batches:
            found = [tiff.read_head(bytes(x)) for x in batch["content"]]
            rows = [(name, h.height, h.width, h.samples, *(h.origin or (None, None)), *(h.cell or (None, None)), h.epsg, h.no_data) for name, h in zip(batch["path"], found, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "height", "width", "bands", "x", "y", "cell_x", "cell_y", "epsg", "no_data"]).astype({"epsg": "Int32"})

    return files.select("path", "content").mapInPandas(heads, "path string, height int, width int, bands int, x double, y double, cell_x double, cell_y double, epsg int, no_data double")


def as_prob(pixels: DataFrame) -> DataFrame:
    """Gray masks as probabilities."""
    return pixels.select("path", "row", "col", (F.col("v0") / 255).alias("prob"))


def read_geojson(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(properties, kind, lines array<array<struct<x,y>>>) of each feature: a line is one of one, an area its rings, and several
    are put one after the other. A file is one collection, or, not whole, holds one on each line, and may then be split."""
    features = spark.read.option("multiLine", whole).schema("features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    one = features.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    line = F.array(F.transform(F.from_json("c", "array<array<double>>"), point))
    rings = F.transform(F.from_json("c", "array<array<array<double>>>"), lambda ring: F.transform(ring, point))
    areas = F.flatten(F.transform(F.from_json("c", "array<array<array<array<double>>>>"), lambda area: F.transform(area, lambda ring: F.transform(ring, point))))
    lines = F.when(F.col("kind") == "LineString", line).when(F.col("kind").isin("Polygon", "MultiLineString"), rings).when(F.col("kind") == "MultiPolygon", areas)
    return one.select("properties", "kind", lines.alias("lines"))


def require_projected(srid: Column) -> Column:
    """The reference system's code, an error where it is unknown or in degrees."""
    unknown = F.raise_error(F.lit("the reference system is unknown")).cast("int")
    degrees = F.raise_error(F.lit("distances need a projected reference system")).cast("int")
    return F.when(srid.isNull(), unknown).when(srid.isin(4326, 4269, 4258), degrees).otherwise(srid.cast("int"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_pixels(pixels: DataFrame, path: str, by: str = "tile_id") -> None:
    pixels.write.mode("overwrite").partitionBy(by).parquet(path)


def encoded(pixels: DataFrame, bands: list[str], kind: str = "png", dtype: str = "uint8", by: str = "tile_id", **options) -> DataFrame:
    """(by, data): each tile as a PNG (8 bits, gray or three colours), a TIFF or an .npy file of the bands."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        array = np.zeros((r.max() + 1, c.max() + 1, len(bands)), dtype)
        array[r, c] = pdf[bands].to_numpy()
        array = array[:, :, 0] if len(bands) == 1 else array
        if kind == "npy":
            held = io.BytesIO()
            np.save(held, array)
            data = held.getvalue()
        else:
            data = encode_png(array) if kind == "png" else tiff.encode(array, **options)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "data": [data]})

    return by_tasks(pixels.select(by, "row", "col", *bands), [by], pack, f"{by} long, data binary")


def write_png(pixels: DataFrame, path: str, bands: list[str]) -> None:
    """(tile_id, data): a PNG of each tile as a row of a Parquet table."""
    encoded(pixels, bands).write.mode("overwrite").parquet(path)


def write_tiff(pixels: DataFrame, path: str, bands: list[str], **options) -> None:
    """(tile_id, data): a TIFF of each tile, with the options of tiff.encode, as a row of a Parquet table."""
    encoded(pixels, bands, "tiff", **options).write.mode("overwrite").parquet(path)


def write_geojson(lines: DataFrame, path: str, properties: list[str]) -> None:
    """Features of lines (points array<struct<x,y>>), one a line of text, each a collection of its own."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*(F.col(c).cast("string").alias(c) for c in properties)).alias("properties"), shape.alias("geometry"))
    lines.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value")).write.mode("overwrite").text(path)


def report(graph: DataFrame, reasons: DataFrame, top: DataFrame, scenarios: DataFrame, evaluation: DataFrame | None = None) -> DataFrame:
    """One row (value: JSON) of a run's report: graph figures, rejections, most critical nodes, scenarios, agreement."""
    parts = {
        "graph": graph.agg(F.first(F.struct(*graph.columns)).alias("graph")),
        "rejections": reasons.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("rejections")),
        "critical": top.agg(F.sort_array(F.collect_list(F.struct(F.col("score"), "node_id", "x", "y")), asc=False).alias("critical")),
        "scenarios": scenarios.agg(F.sort_array(F.collect_list(F.struct("scenario", *[c for c in scenarios.columns if c not in ("scenario", "polygon")]))).alias("scenarios")),
    }
    if evaluation is not None:
        parts["evaluation"] = evaluation.agg(F.first(F.struct(*evaluation.columns)).alias("evaluation"))
    out = None
    for part in parts.values():
        out = part if out is None else out.crossJoin(part)
    return out.select(F.to_json(F.struct(*parts)).alias("value"))


def summary_lines(scenarios: DataFrame) -> DataFrame:
    """(value) a line of text for each scenario that has an index and whose name is not hidden by an underscore."""
    shown = scenarios.where("not startswith(scenario, '_') and index is not null").orderBy("scenario")
    return shown.select(F.format_string("%-20s disable=%3d  RI=%.4f", "scenario", "n_disabled", "index").alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").text(path)


def find_reports(spark: SparkSession, path: str) -> DataFrame:
    """(folder, value): reports of runs below a folder; of a run's reports the one nearest its top comes first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "resilience_report.json").option("recursiveFileLookup", True).load(path)
    at = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.col("content").cast("string").alias("value"))
    return at.orderBy(F.length(F.regexp_replace("folder", "[^/]", "")), "folder")


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(nodes, edges, report) of a cached run: its graph as write_graph wrote it, beside the report nearest the folder's top. None
    if there is no report."""
    found = find_reports(spark, path).limit(1)
    top = found.first()
    if top is None:
        return None
    nodes, edges = read_graph(spark, f"{top['folder']}/graph")
    return nodes, edges, found


def population_if_there(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A population raster, None where no path is given or nothing is there."""
    if not path:
        return None
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place) else None
