"""Coordinates in the headers of picture files, read by byte ranges, and pictures written as files by a sink that commits."""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.geo import EARTH_RADIUS

#: Fixed values of the Exif format: the tag that leads to the GPS directory, its tags, and bytes a value of each type.
GPS_DIRECTORY, LAT_REF, LAT, LONG_REF, LONG = 0x8825, 1, 2, 3, 4
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8, 12: 8}
#: Fixed values of GeoTIFF: tags of size, scale, tie points, transformation and keys; keys of the model and the projection.
WIDTH, HEIGHT, PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS = 256, 257, 33550, 33922, 34264, 34735
MODEL_KEY, PROJECTION_KEY, PROJECTED, GEOGRAPHIC, WEB_MERCATOR = 1024, 3072, 1, 2, 3857
#: Bytes that a header scan fetches at once.
RANGE = 4096
POSITION = "lat array<double>, lat_ref string, long array<double>, long_ref string"


class Ranges:
    """A file of which only the ranges that are asked for are fetched, in blocks of RANGE bytes; slices are like those of
    bytes. `fetched` counts bytes."""

    def __init__(self, source) -> None:
        self.source, self.size, self.held, self.fetched = source, source.size(), {}, 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: slice | int):
        if isinstance(key, int):
            return self[key : key + 1][0]
        start, stop, _ = key.indices(self.size)
        if stop <= start:
            return b""
        parts = []
        for block in range(start // RANGE, (stop - 1) // RANGE + 1):
            if block not in self.held:
                self.source.seek(block * RANGE)
                self.held[block] = self.source.read(min(RANGE, self.size - block * RANGE))
                self.fetched += len(self.held[block])
            parts.append(self.held[block])
        first = start // RANGE * RANGE
        return b"".join(parts)[start - first : stop - first]


def exif_block(content: bytes | Ranges) -> bytes | Ranges:
    """The Exif block (a TIFF header and what follows) of a JPEG, PNG or TIFF file; empty if there is none."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            if kind == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += size + 12
    elif content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:  # up to the picture itself
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + size]
            at += 2 + size
    return b""


def _directory(block: bytes | Ranges, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """tag -> (type, count, value) of the directory at an offset."""
    out = {}
    for k in range(struct.unpack(order + "H", block[at : at + 2])[0]):
        tag, kind, count, held = struct.unpack(order + "HHI4s", block[at + 2 + 12 * k : at + 14 + 12 * k])
        size = TYPE_BYTES.get(kind, 0) * count
        place = struct.unpack(order + "I", held)[0]
        out[tag] = (kind, count, held[:size] if size <= 4 else block[place : place + size])
    return out


def _first_directory(block: bytes | Ranges) -> tuple[str, dict[int, tuple[int, int, bytes]]]:
    """The byte order and the first directory of a TIFF header; struct.error where it is broken."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None:
        raise struct.error("no TIFF header")
    return order, _directory(block, order, struct.unpack(order + "I", block[4:8])[0])


@dataclass(frozen=True)
class GeoTiff:
    """affine: x = a * col + b * row + c and y = d * col + e * row + f of a raster of width times height pixels; model as the
    keys have it, projection 0 if they have none."""

    affine: tuple[float, float, float, float, float, float]
    width: int
    height: int
    model: int
    projection: int


def geotiff_tags(content: bytes | Ranges | None) -> GeoTiff | None:
    """The georeference of a TIFF file; None for a file that isn't one, has none, or is broken."""
    try:
        order, tags = _first_directory(content or b"")

        def values(tag: int) -> tuple:
            kind, count, data = tags[tag]
            return struct.unpack(order + str(count) + {3: "H", 4: "I", 12: "d"}[kind], data)

        keys = values(GEO_KEYS)
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}  # values that stand in the directory
        if TRANSFORMATION in tags:
            m = values(TRANSFORMATION)
            affine = (m[0], m[1], m[3], m[4], m[5], m[7])
        else:
            (sx, sy, *_), (col, row, _, x, y, *_) = values(PIXEL_SCALE), values(TIE_POINT)
            affine = (sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy)
        return GeoTiff(affine, values(WIDTH)[0], values(HEIGHT)[0], found.get(MODEL_KEY, 0), found.get(PROJECTION_KEY, 0))
    except (struct.error, KeyError, IndexError, ValueError):
        return None


def geographic(tiff: GeoTiff, col: float, row: float) -> tuple[float, float] | None:
    """(lat, long) of a place of the raster; None for a projection other than web mercator."""
    a, b, c, d, e, f = tiff.affine
    x, y = a * col + b * row + c, d * col + e * row + f
    if tiff.model == GEOGRAPHIC:
        return y, x
    if tiff.model == PROJECTED and tiff.projection == WEB_MERCATOR:
        return math.degrees(2 * math.atan(math.exp(y / EARTH_RADIUS)) - math.pi / 2), math.degrees(x / EARTH_RADIUS)
    return None


_HEADER = f"path string, {POSITION}, affine array<double>, width long, height long, corners array<double>, bytes_read long"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    angle = pa.list_(pa.float64())
    kinds = {"path": pa.string(), "lat": angle, "lat_ref": pa.string(), "long": angle, "long_ref": pa.string(), "affine": angle, "width": pa.int64(), "height": pa.int64(), "corners": angle, "bytes_read": pa.int64()}
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as source:
                content = Ranges(source)
                position, tiff = gps_tags(content), geotiff_tags(content)
                corners = [geographic(tiff, 0, 0), geographic(tiff, tiff.width, tiff.height)] if tiff else [None]
                row = [path, *position, *((None, None, None) if tiff is None else (list(tiff.affine), tiff.width, tiff.height))]
                rows.append([*row, None if None in corners else [v for c in corners for v in c], content.fetched])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def headers(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, lat, lat_ref, long, long_ref: Exif position; affine, width, height, corners: latitude and longitude of the top left
    and the bottom right of a GeoTIFF; bytes_read) of picture files, a row a file. A task fetches header blocks only, so
    the cost of a file doesn't grow with its pixels. Paths are URIs, or absolute, and mean the same to all executors."""
    return paths.select(F.col(path).alias("path")).mapInArrow(_headers, _HEADER)


def gps_tags(content: bytes | Ranges | None) -> tuple[list[float] | None, str | None, list[float] | None, str | None]:
    """Degrees, minutes and seconds of latitude and longitude, each with its hemisphere; what a file lacks is None, as is
    all of a file whose block is cut or broken. A fraction over 0 is NaN."""
    try:
        block = exif_block(content or b"")
        order, first = _first_directory(block)
        if GPS_DIRECTORY not in first:
            return None, None, None, None
        found = _directory(block, order, struct.unpack(order + "I", first[GPS_DIRECTORY][2])[0])
        angles = {}
        for tag in (LAT, LONG):
            if tag in found and found[tag][:2] == (5, 3):
                parts = struct.unpack(order + "6I", found[tag][2])
                angles[tag] = [n / d if d else float("nan") for n, d in zip(parts[::2], parts[1::2], strict=True)]
        refs = {t: found[t][2].split(b"\0")[0].decode("latin-1") for t in (LAT_REF, LONG_REF) if t in found}
    except struct.error:
        return None, None, None, None
    return angles.get(LAT), refs.get(LAT_REF), angles.get(LONG), refs.get(LONG_REF)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, content) -> (path, POSITION)."""
    angle = pa.list_(pa.float64())
    for batch in batches:
        found = list(zip(*(gps_tags(x.as_py()) for x in batch.column(1)), strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), t) for v, t in zip(found, (angle, pa.string(), angle, pa.string()), strict=True))], ["path", "lat", "lat_ref", "long", "long_ref"])


def decimal(angle: Column, ref: Column) -> Column:
    """Decimal degrees of degrees, minutes and seconds; negative in the south and the west."""
    return (angle[0] + angle[1] / 60 + angle[2] / 3600) * F.when(ref.isin("S", "W"), -1).otherwise(1)


def exif_gps(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, gps: latitude and longitude in decimal degrees, empty where a file lacks one) of picture files, as Spark's
    binaryFile source reads them. Null and empty contents have no coordinates."""
    rows = files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(_positions, f"path string, {POSITION}")
    both = F.col("lat").isNotNull() & F.col("lat_ref").isNotNull() & F.col("long").isNotNull() & F.col("long_ref").isNotNull()
    point = F.array(decimal(F.col("lat"), F.col("lat_ref")), decimal(F.col("long"), F.col("long_ref")))
    return rows.select("path", F.when(both, point).otherwise(F.array().cast("array<double>")).alias("gps"))


def png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of 1, 3 or 4 channels of rows of pixels; as in Spark's image source, blue comes first."""
    import numpy as np

    places = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, places]
    lines = np.zeros((height, 1 + width * channels), np.uint8)  # a line begins with its filter, none
    lines[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    parts = ((b"IHDR", head), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


@dataclass
class Written(WriterCommitMessage):
    """What a task left in its own folder."""

    folder: str
    names: list[str]


class PictureSink(DataSource):
    """Rows (name, height, width, channels, data) as PNG files folder/name. Each attempt of a task writes to a folder of its own
    beside the final ones; only when all tasks are done do the files of the attempts that Spark counts get their names, and a
    job that fails leaves nothing. Option path: the folder's URI, or an absolute path."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PictureWriter(self.options["path"])


class PictureWriter(DataSourceWriter):
    #: Files that the driver renames at once.
    THREADS = 16

    def __init__(self, folder: str) -> None:
        self.folder, self.run = folder, f"_pictures-{uuid.uuid4().hex}"

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, base = self._place()
        task = TaskContext.get()
        folder = f"{base}/{self.run}/{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}"
        system.create_dir(folder, recursive=True)
        names = []
        for r in iterator:
            with system.open_output_stream(f"{folder}/{r[0]}") as out:
                out.write(png(bytes(r[4]), r[1], r[2], r[3]))
            names.append(r[0])
        return Written(folder, sorted(set(names)))

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._place()
        moves = {f"{base}/{n}": f"{m.folder}/{n}" for m in messages if m for n in m.names}  # of rows with one name one stays
        with ThreadPoolExecutor(self.THREADS) as pool:
            list(pool.map(lambda move: system.move(move[1], move[0]), moves.items()))
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.run}")


def write_images(df: DataFrame, folder: str, name: str = "name") -> None:
    """A PNG file folder/name for each row (name, height, width, channels, data), all of them or none. The folder's URI, or an
    absolute path, must mean the same to all executors; of rows with one name one stays."""
    df.sparkSession.dataSource.register(PictureSink)
    df.select(name, "height", "width", "channels", "data").write.format("pictures").mode("append").option("path", folder).save()
