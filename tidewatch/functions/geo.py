"""Web-mercator tile arithmetic and coordinates, as column expressions. Tiles are 256 pixels wide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import each

#: Fixed values of the projection.
EARTH_RADIUS, MIN_LAT, MAX_LAT, MIN_LONG, MAX_LONG = 6378137.0, -85.05112878, 85.05112878, -180.0, 180.0
TILE = 256


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def map_size(level: Column) -> Column:
    """Pixels along each side of the map."""
    return F.lit(TILE).cast("long") * F.pow(F.lit(2.0), level).cast("long")


def ground_resolution(lat: Column, level: Column) -> Column:
    """Metres a pixel."""
    return F.cos(F.radians(clipped(lat, MIN_LAT, MAX_LAT))) * (2 * math.pi * EARTH_RADIUS) / map_size(level)


def map_scale(lat: Column, level: Column, dpi: int) -> Column:
    return ground_resolution(lat, level) * dpi / 0.0254


def pixel_xy(lat: Column, long: Column, level: Column) -> tuple[Column, Column]:
    size = map_size(level)
    sin = F.sin(F.radians(clipped(lat, MIN_LAT, MAX_LAT)))
    x = (clipped(long, MIN_LONG, MAX_LONG) + 180) / 360
    y = 0.5 - F.log((1 + sin) / (1 - sin)) / (4 * math.pi)
    bound = lambda v: F.floor(F.least(F.greatest(v * size + 0.5, F.lit(0.0)), (size - 1).cast("double")))
    return bound(x), bound(y)


def lat_long(x: Column, y: Column, level: Column) -> tuple[Column, Column]:
    """The coordinates of a pixel."""
    size = map_size(level).cast("double")
    fx = F.least(F.greatest(x.cast("double"), F.lit(0.0)), size - 1) / size - 0.5
    fy = 0.5 - F.least(F.greatest(y.cast("double"), F.lit(0.0)), size - 1) / size
    return 90 - 360 * F.atan(F.exp(-fy * 2 * math.pi)) / math.pi, 360 * fx


def tile_xy(x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor(x / TILE), F.floor(y / TILE)


def tile_corner(tx: Column, ty: Column, level: Column, dx: float = 0.0, dy: float = 0.0) -> tuple[Column, Column]:
    """Coordinates of a point of a tile: (0, 0) its top left, (1, 1) its bottom right, (0.5, 0.5) its centre."""
    return lat_long((tx + dx) * TILE, (ty + dy) * TILE, level)


def part_corners(lat: Column, long: Column, level: Column, part: Column) -> dict[str, Column]:
    """Coordinates of the centre and two corners of a part (struct with x, y, w and h in pixels) of a picture whose top
    left is at lat and long; half sizes are whole pixels."""
    px, py = pixel_xy(lat, long, level)
    x, y = px + part["x"], py + part["y"]
    at = {"center": (x + F.floor(part["w"] / 2), y + F.floor(part["h"] / 2)), "top_left": (x, y), "bottom_right": (x + part["w"], y + part["h"])}
    return {f"{name}_{axis}": value for name, (a, b) in at.items() for axis, value in zip(("lat", "long"), lat_long(a, b, level), strict=True)}


def maps_from_tiles(maps: DataFrame, tiles: DataFrame, part: int = 1000, tile: int = TILE) -> DataFrame:
    """Maps put together from tiles and split again: maps (map_id, lat, long, z, radius) and tiles (z, tx, ty, px: tile * tile
    pixels, row by row) give (map_id, row, col, x, y, w, h, px, and coordinates of the centre, the top left and the bottom right
    of each part) of the square of tiles around each map's point.

    No picture is ever whole: a tile is cut along the parts that it touches into runs of pixels of one line, and a part is the
    runs of its lines in order, so the largest group is one part. A tile that is missing is black, beyond the map's edge too;
    of tiles that share a place the one with the least pixels' hash counts; maps with one id are one map of each point."""
    px, py = pixel_xy(F.col("lat"), F.col("long"), F.col("z"))
    cx, cy = tile_xy(px, py)
    around = maps.select("map_id", "z", (cx - F.col("radius")).alias("_x0"), (cy - F.col("radius")).alias("_y0"), (2 * F.col("radius") + 1).cast("long").alias("_n")).distinct()
    places = each(each(around, F.col("_x0"), F.col("_x0") + F.col("_n") - 1, "tx", 1), F.col("_y0"), F.col("_y0") + F.col("_n") - 1, "ty", 1)
    once = tiles.groupBy("z", "tx", "ty").agg(F.min_by("px", F.xxhash64("px")).alias("px"))
    black = F.array_repeat(F.lit(0.0), tile * tile)
    cut = places.join(once, ["z", "tx", "ty"], "left").withColumn("px", F.coalesce(F.col("px").cast("array<double>"), black))
    cut = cut.withColumn("_ox", (F.col("tx") - F.col("_x0")) * tile).withColumn("_oy", (F.col("ty") - F.col("_y0")) * tile)
    parts = lambda o: F.sequence(F.floor(F.col(o) / part), F.floor((F.col(o) + (tile - 1)) / part))
    cut = cut.withColumn("col", F.explode(parts("_ox"))).withColumn("row", F.explode(parts("_oy")))
    left, right = F.greatest(F.col("col") * part, F.col("_ox")), F.least((F.col("col") + 1) * part, F.col("_ox") + tile)
    top, bottom = F.greatest(F.col("row") * part, F.col("_oy")), F.least((F.col("row") + 1) * part, F.col("_oy") + tile)
    cut = cut.withColumn("_l", left).withColumn("_w", right - left).withColumn("_line", F.explode(F.sequence(top, bottom - 1)))
    run = F.slice("px", ((F.col("_line") - F.col("_oy")) * tile + F.col("_l") - F.col("_ox") + 1).cast("int"), F.col("_w").cast("int"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("_line").alias("y"), F.col("_l").alias("x"), run.alias("run"))))
    made = cut.groupBy("map_id", "z", "_x0", "_y0", "_n", "row", "col").agg(F.flatten(F.transform(lines, lambda v: v["run"])).alias("px"))
    side = F.col("_n") * tile
    own = F.struct((F.col("col") * part).alias("x"), (F.col("row") * part).alias("y"), F.least(F.lit(part), side - F.col("col") * part).alias("w"), F.least(F.lit(part), side - F.col("row") * part).alias("h"))
    made = made.withColumn("part", own)
    scale = TILE // tile  # coordinates count pixels of the projection
    full = F.struct(*((F.col("part")[k] * scale).alias(k) for k in ("x", "y", "w", "h")))
    lat, long = tile_corner(F.col("_x0"), F.col("_y0"), F.col("z"))
    corners = part_corners(lat, long, F.col("z"), full)
    return made.select("map_id", "row", "col", "part.*", "px", *(c.alias(n) for n, c in corners.items()))


def _spread(x: Column) -> Column:
    """The low 31 bits of x, a zero above each."""
    x = x.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def neighbours(tiles: DataFrame, radius: int = 1) -> DataFrame:
    """tiles (..., tx, ty) with every tile up to `radius` columns and rows away, itself included."""
    around = lambda c: F.explode(F.sequence(F.col(c) - radius, F.col(c) + radius)).alias(c)
    rest = [c for c in tiles.columns if c not in ("tx", "ty")]
    return tiles.select(*rest, around("tx"), "ty").select(*rest, "tx", around("ty"))


def quad_key(tx: Column, ty: Column, level: Column) -> Column:
    """A digit a level, from the most significant bits down: bit of x plus twice the bit of y, which is the number of both
    sets of bits interleaved, to base 4."""
    number = _spread(tx) + 2 * _spread(ty)
    return F.when(level > 0, F.lpad(F.conv(number.cast("string"), 10, 4), level, F.lit("0"))).otherwise("")


def degrees_minutes_seconds(value: Column, is_lat: bool) -> Column:
    """struct<degrees, minutes, seconds in hundredths, ref> of decimal degrees."""
    whole = F.round(F.abs(value) * 360000).cast("long")
    ref = F.when(value < 0, "S" if is_lat else "W").otherwise("N" if is_lat else "E")
    return F.struct(F.floor(whole / 360000).alias("degrees"), (F.floor(whole / 6000) % 60).alias("minutes"), (whole % 6000).alias("centiseconds"), ref.alias("ref"))


def decimal_degrees(dms: Column) -> Column:
    value = dms["degrees"] + dms["minutes"] / 60 + dms["centiseconds"] / 360000
    return F.when(dms["ref"].isin("S", "W"), -value).otherwise(value)


def affine(col: Column, row: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * col + b * row + c, d * col + e * row + f


#: Where map tiles are served, by provider; z, x and y are the tile's, q is its quad key.
TILE_URLS = {
    "arcgis": "https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/{z}/{y}/{x}",
    "google": "https://mt1.google.com/vt/lyrs=s&x={x}&y={y}&z={z}",
    "bing": "http://ecn.t1.tiles.virtualearth.net/tiles/a{q}.png?g=441&mkt=en-us&n=z",
}


def tile_url(provider: str, tx: Column, ty: Column, level: Column) -> Column:
    parts, text = [], TILE_URLS[provider]
    values = {"x": tx.cast("string"), "y": ty.cast("string"), "z": level.cast("string"), "q": quad_key(tx, ty, level)}
    while "{" in text:
        before, _, rest = text.partition("{")
        name, _, text = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(text))
