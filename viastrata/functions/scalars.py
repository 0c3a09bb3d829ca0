"""Column functions: grids and places, road attributes, raster values, path names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full widths in metres by road class, the width of other classes, and of a lane.
ROAD_WIDTHS = {
    "motorway": 12.0, "motorway_link": 6.0, "trunk": 10.0, "trunk_link": 5.0, "primary": 8.0, "primary_link": 5.0,
    "secondary": 7.0, "secondary_link": 4.5, "tertiary": 6.0, "tertiary_link": 4.0, "unclassified": 5.0, "residential": 5.0,
    "living_street": 4.0, "service": 3.5, "track": 3.0, "path": 1.5, "pedestrian": 3.0, "footway": 1.5,
}
OTHER_WIDTH, LANE_WIDTH = 4.0, 3.5
#: The road classes that labels are made of, unless told otherwise.
LABEL_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service")


def world_to_pixel(x: Column, y: Column, origin_x: Column, origin_y: Column, size: Column, height: Column) -> tuple[Column, Column]:
    """(row, col) on a north-up grid whose origin is its lower left corner."""
    return height - (y - origin_y) / size, (x - origin_x) / size


def pixel_to_world(row: Column, col: Column, origin_x: Column, origin_y: Column, size: Column, height: Column) -> tuple[Column, Column]:
    return col * size + origin_x, (height - row) * size + origin_y


def affine_inverse(x: Column, y: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """(col, row) where x = a col + b row + c and y = d col + e row + f; an error where no inverse exists."""
    det = a * e - b * d
    det = F.when(F.abs(det) < 1e-12, F.raise_error(F.lit("the affine map has no inverse")).cast("double")).otherwise(det)
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def sigmoid(x: Column) -> Column:
    """Without overflow at either end."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def z_level(bridge: Column, tunnel: Column, layer: Column) -> Column:
    """-1 in tunnels, else at least 1 on bridges, else the layer or 0."""
    return (
        F.when(F.coalesce(tunnel, F.lit(False)), F.lit(-1))
        .when(F.coalesce(bridge, F.lit(False)), F.greatest(F.lit(1), F.coalesce(layer, F.lit(1))))
        .otherwise(F.coalesce(layer, F.lit(0)))
        .cast("int")
    )


def half_width(highway: Column, oneway: Column, lanes: Column, widths: dict[str, float] | None = None, lane_width: float = LANE_WIDTH) -> Column:
    """Metres to buffer a way's line by: lanes if known, else the class; half of it on one-way roads; half of that to each side."""
    known = ROAD_WIDTHS if widths is None else widths
    table = F.create_map(*(F.lit(v) for pair in known.items() for v in pair))
    by_class = F.coalesce(F.try_element_at(table, highway), F.lit(OTHER_WIDTH))
    total = F.when(lanes > 0, lanes * lane_width).otherwise(by_class)
    return F.when(F.coalesce(oneway, F.lit(False)), total * 0.5).otherwise(total) / 2


def first_class(highway: Column) -> Column:
    """The class of a way that lists several: the first."""
    return F.get(highway, 0)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; an error outside -180..180 and -90..90."""
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1))
    code = zone + F.when(lat >= 0, 32600).otherwise(32700)
    return F.when((F.abs(lon) > 180) | (F.abs(lat) > 90), F.raise_error(F.lit("no such longitude or latitude")).cast("int")).otherwise(code).cast("int")


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees of a line's direction, 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return F.floor(0.299 * red + 0.587 * green + 0.114 * blue).cast("int")


def bands_to_rgb(order: str, bands: list[Column]) -> list[Column]:
    """Red, green, blue of a raster whose bands come in the given order."""
    if order == "nir_r_g_b" and len(bands) >= 4:
        return bands[1:4]
    if order == "nir_r_g" and len(bands) == 3:
        return [bands[1], bands[2], F.floor((bands[1] + bands[2]) / 2 * 0.7).cast("int")]
    if len(bands) >= 3:
        return bands[:3]
    raise ValueError(f"{len(bands)} bands in order {order} hold no colours")


def standardized(value: Column, mean: Column | None = None, std: Column | None = None, missing: float = 127.5) -> Column:
    """(value - mean) / std, where unknown ones are `missing`."""
    known = lambda x: F.lit(missing) if x is None else F.coalesce(x, F.lit(missing))
    return (value - known(mean)) / known(std)


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def hann(i: Column, n: int, floor: float = 1e-6) -> Column:
    return F.greatest(0.5 - 0.5 * F.cos(2 * 3.141592653589793 * i / (n - 1)), F.lit(floor))


def reflected(i: Column, n: int) -> Column:
    """Index within 0..n-1 of a place outside it, mirrored at the first and last index."""
    period = 2 * (n - 1)
    m = F.pmod(i, F.lit(max(period, 1)))
    return F.when(m < n, m).otherwise(period - m).cast("int")


def mirrors(i: Column, n: int, first: int, last: int) -> Column:
    """All places from first to last that `reflected` takes to an index i within 0..n-1."""
    period = max(2 * (n - 1), 1)
    start = lambda at: F.lit(first) + F.pmod(at - first, F.lit(period))
    run = lambda at: F.when(start(at) <= last, F.sequence(start(at), F.lit(last), F.lit(period))).otherwise(F.array().cast("array<int>"))
    at = i.cast("int")
    return F.array_union(run(at), run(-at))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def is_image(path: Column, extensions: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".tif", ".tiff")) -> Column:
    """Named as an image, and not hidden by a leading dot."""
    return extension(path).isin(*extensions) & ~F.regexp_extract(path, r"([^/]*)$", 1).startswith(".")


def tier(score: Column) -> Column:
    """Of 4, by quarters of 0..1."""
    return F.when(score >= 0.75, "critical").when(score >= 0.5, "high").when(score >= 0.25, "moderate").otherwise("low")


def signal(p95: Column, share: Column) -> Column:
    """How clear a raster's roads are. The bounds are this library's own."""
    return F.when((p95 >= 0.8) & (share >= 0.02), "STRONG").when((p95 >= 0.5) & (share >= 0.005), "MODERATE").when(p95 >= 0.2, "WEAK").otherwise("NEAR_ZERO")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
