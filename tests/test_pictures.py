"""Coordinates of picture files and pictures written as files."""

from __future__ import annotations

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import datasets, pictures


def tiff(order: str, gps: list[tuple[int, int, int, bytes]] | None) -> bytes:
    """A TIFF block with one directory, which leads to a GPS directory of (tag, type, count, value)."""
    start = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    if gps is None:
        return start + struct.pack(order + "HHHI4sI", 1, 0x0112, 3, 1, struct.pack(order + "HH", 1, 0), 0)
    first = struct.pack(order + "HHHIII", 1, 0x8825, 4, 1, 26, 0)
    entries, values, at = b"", b"", 26 + 2 + 12 * len(gps) + 4
    for tag, kind, count, value in gps:
        held = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", at + len(values))
        values += value if len(value) > 4 else b""
        entries += struct.pack(order + "HHI4s", tag, kind, count, held)
    return start + first + struct.pack(order + "H", len(gps)) + entries + bytes(4) + values


def located(order: str, lat_ref: bytes = b"N\0", long_ref: bytes = b"W\0", over: int = 100) -> bytes:
    angle = lambda d, m, s: struct.pack(order + "6I", d, 1, m, 1, s, over)
    return tiff(order, [(1, 2, 2, lat_ref), (2, 5, 3, angle(40, 26, 4614)), (3, 2, 2, long_ref), (4, 5, 3, angle(79, 58, 5600))])


def jpeg(block: bytes) -> bytes:
    app = lambda n, data: struct.pack(">BBH", 0xFF, n, len(data) + 2) + data
    return b"\xff\xd8" + app(0xE0, b"JFIF\0" + bytes(9)) + app(0xE1, b"http://xmp") + app(0xE1, b"Exif\0\0" + block) + b"\xff\xda\0\0"


def test_coordinates_of_files(spark, tmp_path):
    lat, long = 40 + 26 / 60 + 46.14 / 3600, 79 + 58 / 60 + 56 / 3600
    exif = located(">")
    chunked = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sI", 0, b"tEXt", 0) + struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif))
    files = {
        "little.jpg": (jpeg(located("<")), [lat, -long]),
        "big.jpg": (jpeg(located(">", b"S\0", b"E\0")), [-lat, long]),
        "plain.tif": (located("<"), [lat, -long]),
        "chunk.png": (chunked, [lat, -long]),
        "no-gps.jpg": (jpeg(tiff("<", None)), []),
        "half.jpg": (jpeg(tiff(">", [(1, 2, 2, b"N\0"), (2, 5, 3, struct.pack(">6I", 1, 1, 2, 1, 3, 1))])), []),
        "cut.jpg": (jpeg(located("<")[:60]), []),
        "none.jpg": (b"\xff\xd8\xff\xda", []),
        "text.jpg": (b"no picture", []),
    }
    for name, (content, _) in files.items():
        (tmp_path / name).write_bytes(content)
    found = pictures.exif_gps(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r.gps for r in found.collect()}
    assert got.keys() == files.keys()
    for name, (_, want) in files.items():
        assert len(got[name]) == len(want) and all(abs(a - b) < 1e-12 for a, b in zip(got[name], want, strict=True)), name
    bare = spark.createDataFrame([("x", None), ("y", bytearray())], "path string, content binary")  # Spark's source leaves out empty files
    assert [r.gps for r in pictures.exif_gps(bare).collect()] == [[], []] and pictures.exif_gps(bare.limit(0)).count() == 0
    over_zero = spark.createDataFrame([("x", bytearray(located("<", over=0)))], "path string, content binary")
    assert all(math.isnan(x) for x in pictures.exif_gps(over_zero).first().gps)


def test_pictures_round_trip(spark, tmp_path):
    """Files of one, three and four channels hold what was written, and writing again changes nothing."""
    rows = [(f"p{c}.png", 3, 5, c, bytearray((k * 7 + c) % 256 for k in range(15 * c))) for c in (1, 3, 4)]
    df = spark.createDataFrame(rows, "name string, height int, width int, channels int, data binary")
    folder = str(tmp_path / "new" / "out")
    for _ in range(2):
        pictures.write_images(df, folder)
    found = datasets.read_images(spark, folder).withColumn("name", datasets.basename(F.col("path")))
    got = {r.name: (r.height, r.width, r.channels, bytes(r.data)) for r in found.collect()}
    assert got == {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in rows}
    pictures.write_images(df.limit(0), str(tmp_path / "nothing"))


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    """The job fails after other tasks, and this one, have written pictures."""
    pixels = bytes(range(12))
    rows = spark.range(40).repartition(4).withColumn("name", F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".png")))

    @F.udf("binary")
    def data(i):
        if i == 33:
            raise ValueError("a broken picture")
        return pixels

    @F.udf("binary")
    def whole(i):
        return pixels

    shape = {"height": F.lit(2), "width": F.lit(2), "channels": F.lit(3)}
    folder = tmp_path / "out"
    with pytest.raises(Exception, match="a broken picture"):
        pictures.write_images(rows.withColumns({**shape, "data": data("id")}), str(folder))
    assert not folder.exists() or not list(folder.rglob("*"))
    pictures.write_images(rows.withColumns({**shape, "data": whole("id")}), str(folder))
    pictures.write_images(rows.limit(1).withColumns({**shape, "data": whole("id"), "name": F.lit("more.png")}), str(folder))
    assert sorted(p.name for p in folder.rglob("*")) == sorted([*(f"p{k}.png" for k in range(40)), "more.png"])
    assert (folder / "p7.png").read_bytes() == pictures.png(pixels, 2, 2, 3)


def geotiff(order, width, height, model, projection, matrix=None, padding=200_000):
    """A TIFF file with pixels before its directory, and values after it."""
    doubles = {33550: (2.0, 3.0, 0.0), 33922: (10.0, 20.0, 0.0, 500.0, 900.0, 0.0)} if matrix is None else {34264: matrix}
    keys = [1, 1, 0, 1 + bool(projection), 1024, 0, 1, model] + ([3072, 0, 1, projection] if projection else [])
    entries, at = [(256, 3, 1, struct.pack(order + "HH", width, 0)), (257, 3, 1, struct.pack(order + "HH", height, 0))], 8 + padding
    after = at + 2 + 12 * (3 + len(doubles)) + 4
    tail = b""
    for tag, values in doubles.items():
        entries.append((tag, 12, len(values), struct.pack(order + "I", after + len(tail))))
        tail += struct.pack(order + f"{len(values)}d", *values)
    entries.append((34735, 3, len(keys), struct.pack(order + "I", after + len(tail))))
    tail += struct.pack(order + f"{len(keys)}H", *keys)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + b"\7" * padding
    return head + struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries) + struct.pack(order + "I", 0) + tail


@pytest.mark.parametrize("order", ["<", ">"])
def test_corners_of_geotiffs_by_byte_ranges(spark, tmp_path, order):
    matrix = (0.5, 0.25, 0.0, 7.0, 0.125, -0.5, 0.0, 50.0, *(0.0,) * 7, 1.0)
    x, y = 1_000_000.0, 6_000_000.0
    mercator = (2.0, 0.0, 0.0, x, 0.0, -2.0, 0.0, y, *(0.0,) * 7, 1.0)
    files = {"scaled": geotiff(order, 100, 50, 2, 0), "turned": geotiff(order, 40, 20, 2, 0, matrix), "mercator": geotiff(order, 100, 50, 1, 3857, mercator), "other": geotiff(order, 100, 50, 1, 32633), "cut": geotiff(order, 100, 50, 2, 0)[:-40], "none": b"", "text": b"hello" * 3000}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in pictures.headers(paths).collect()}
    assert got["scaled"].affine == [2.0, 0.0, 480.0, 0.0, -3.0, 960.0] and got["scaled"].corners == [960.0, 480.0, 810.0, 680.0] and (got["scaled"].width, got["scaled"].height) == (100, 50)
    assert got["turned"].corners == [50.0, 7.0, 50 + 40 * 0.125 - 20 * 0.5, 7 + 40 * 0.5 + 20 * 0.25]
    lat = lambda v: math.degrees(2 * math.atan(math.exp(v / 6378137.0)) - math.pi / 2)
    assert got["mercator"].corners == pytest.approx([lat(y), math.degrees(x / 6378137), lat(y - 100), math.degrees((x + 200) / 6378137)])
    assert got["other"].affine is not None and got["other"].corners is None
    assert all(got[n].affine is None and got[n].corners is None and got[n].lat is None for n in ("cut", "none", "text"))
    assert all(0 < got[n].bytes_read <= 4 * pictures.RANGE < len(files[n]) for n in ("scaled", "turned", "mercator"))
