"""Image drift on rows of pixels (arrays of values from 0 to 255): array expressions, and NumPy over Arrow batches of pictures
where a pixel depends on many others (blur) or on a table (noise)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the layered haze model: colour of air light, heights of the layers and of the camera in metres.
AIR_LIGHT, FOG_TOP, HAZE_TOP, CAMERA = (225.0, 225.0, 201.0), 70.0, 34.0, 1.8


def fog(pixels: Column, gray: float, blend: float, noise: Column | None = None, noise_level: float = 0.0) -> Column:
    """Blends pixels with a gray plane; noise, an array of values from -1 to 1, is added on top."""

    def mixed(x: Column, n: Column) -> Column:
        value = 255 * gray * blend + x * (1 - blend) + n * (255 * noise_level)
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))

    return F.transform(pixels, lambda x: mixed(x, F.lit(0.0))) if noise is None else F.zip_with(pixels, noise, mixed)


def flood(water: Column, base: Column, heights: Column, threshold: float, transition: float) -> Column:
    """Water below a height, the base picture above, and a linear transition between, truncated to whole values."""
    alphas = F.transform(heights, lambda h: (h - threshold - transition) / (2 * transition))
    pairs = F.zip_with(water, base, lambda w, b: F.struct(w.alias("w"), b.alias("b")))
    return F.zip_with(pairs, alphas, lambda p, a: F.when(a < 0, p["w"]).when(a > 1, p["b"]).otherwise(F.floor(p["w"] + a * (p["b"] - p["w"]))).cast("int"))


def _within(low: float, high: float, bottom: float, top: float) -> float:
    """Length that the ranges low..high and bottom..top share."""
    return max(0.0, min(high, top) - max(low, bottom))


def ray_lengths(fog_top: float, haze_top: float, elevation: float = 100.0, distance: float = 100.0, camera: float = CAMERA) -> tuple[float, float, float]:
    """How much of a ray from the camera to a point at `elevation`, `distance` away, lies in the haze layer, in the fog layer
    and above both. The layer with the lower top begins at the ground and the other on top of it; fog_top 0 is no fog, with
    haze from the ground. A level ray lies in one layer."""
    low, high = sorted((camera, elevation))
    edge, top = sorted((fog_top, haze_top))
    if high == low:
        lower, upper = float(low <= edge), float(edge < low <= top)
    else:
        lower, upper = (_within(low, high, *r) / (high - low) for r in ((0.0, edge), (edge, top)))
    in_haze, in_fog = (lower, upper) if haze_top <= fog_top else (upper, lower)
    return in_haze * distance, in_fog * distance, (1 - lower - upper) * distance


def haze(pixels: Column, channel: int, visibility_aerosol: float = 450.0, visibility_molecule: float = 12.0, fog_top: float = FOG_TOP, haze_top: float = HAZE_TOP, perlin: Column | None = None, elevation: float = 100.0, distance: float = 100.0) -> Column:
    """Attenuation and air light along a ray through the layers. Haze attenuates by 3.912 / visibility_aerosol a metre. Fog
    mixes that and 3.912 / visibility_molecule by the point's height in it - above the fog's top it has the aerosol's where
    the fog reaches over the haze, else the molecules' - times perlin, noise from 0 to 255 a pixel; without it, fog is full.
    Without fog (fog_top 0) what lies above the haze attenuates by the molecules' rate. The ray's lengths are constants of
    the scene, so Catalyst folds them."""
    aerosol, molecule = 3.912 / visibility_aerosol, 3.912 / visibility_molecule
    in_haze, in_fog, free = ray_lengths(fog_top, haze_top, elevation, distance)
    if fog_top == 0:
        steady, noisy = aerosol * in_haze + molecule * free, 0.0
    else:
        height = max(1 - elevation / (fog_top + 0.00001), 0.0)
        inner, outer = (molecule, aerosol) if fog_top > haze_top else (aerosol, molecule)
        steady, noisy = aerosol * in_haze, (inner * height + outer * (1 - height)) * in_fog

    def seen(x: Column, share: Column) -> Column:
        through = F.exp(-(F.lit(steady) + noisy * share))
        return x * through + (1 - through) * AIR_LIGHT[channel]

    return F.transform(pixels, lambda x: seen(x, F.lit(1.0))) if perlin is None or not noisy else F.zip_with(pixels, perlin, lambda x, p: seen(x, p / 255))


#: Scales of the three noise fields, what is added to each, and its weight.
NOISE_FIELDS = ((1 / 130.0, 1.0, 1.0), (1 / 60.0, 0.5, 0.5), (1 / 10.0, 1.2, 0.25))


def permutation(seed: int = 0) -> tuple[int, ...]:
    """A table of 256 numbers in a pseudorandom order, for noise that isn't to equal another program's."""
    return tuple(int(x) for x in np.random.default_rng(seed).permutation(256))


def lattice_noise(x: np.ndarray, y: np.ndarray, z: np.ndarray, table: Sequence[int]) -> np.ndarray:
    """Gradient noise at points, from about -1 to 1 and 0 at lattice points: the slopes of the eight corners around a point,
    blended by a quintic. The table, a permutation of 0..255, gives a corner's number by three look-ups, and its low four
    bits one of sixteen slopes (the twelve edges of a cube, four of them twice). With the table that is printed for this
    noise the values are the known ones; the lattice repeats every 256."""
    if sorted(table) != list(range(256)):
        raise ValueError("the table isn't a permutation of 0 to 255")
    p = np.array(list(table) * 2)
    cells, parts = [], []
    for v in (x, y, z):
        low = np.floor(v)
        cells.append(low.astype(np.int64) & 255)
        parts.append(v - low)
    weight = [t * t * t * (t * (t * 6 - 15) + 10) for t in parts]
    corners = {}
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                number = p[(p[(p[(cells[0] + i) & 255] + cells[1] + j) & 255] + cells[2] + k) & 255] & 15
                a, b, c = parts[0] - i, parts[1] - j, parts[2] - k
                first = np.where(number < 8, a, b)
                second = np.where(number < 4, b, np.where((number == 12) | (number == 14), a, c))
                corners[i, j, k] = np.where(number & 1, -first, first) + np.where(number & 2, -second, second)
    for axis in range(3):
        corners = {key[1:]: low + weight[axis] * (corners[(1, *key[1:])] - low) for key, low in corners.items() if key[0] == 0}
    return corners[()]


def noise_levels(fields: Sequence[np.ndarray]) -> np.ndarray:
    """One noise value from those of the three fields, each brought to whole levels first."""
    parts = [np.trunc((v + add) * 128) * weight for v, (_, add, weight) in zip(fields, NOISE_FIELDS, strict=True)]
    return (parts[0] + parts[1] + parts[2]) / 3


def layered_noise(depths: Column, width: int, height: int, table: Sequence[int] | None = None) -> Column:
    """The noise of pictures, row by row, from the depth of each pixel: three fields of lattice noise, of all pictures of a
    batch at once."""
    numbers = tuple(table or permutation())

    @F.pandas_udf("array<double>")
    def noise(batch: pd.Series) -> pd.Series:
        row, col = np.divmod(np.arange(width * height, dtype=float), width)
        return _pictures(batch, width * height, lambda d: noise_levels([lattice_noise(np.broadcast_to(col * s, d.shape), np.broadcast_to(row * s, d.shape), d * s, numbers) for s, _, _ in NOISE_FIELDS]))

    return noise(depths)


def box_kernel(radius: int, alpha: float) -> list[list[float]]:
    """Normalised weights of a fog blur: alpha all round, 1 in the centre; size 2 (radius - 1) + 1."""
    size = 2 * (radius - 1) + 1
    total = alpha * (size * size - 1) + 1
    return [[(1.0 if i == j == radius - 1 else alpha) / total for j in range(size)] for i in range(size)]


def mirrored(places: np.ndarray, n: int) -> np.ndarray:
    """Places inside 0..n - 1 of places anywhere on the line, which is mirrored at both ends without repeating the edge, as
    often as it takes."""
    if n == 1:
        return np.zeros_like(places)
    inside = np.abs(places) % (2 * n - 2)
    return np.where(inside >= n, 2 * n - 2 - inside, inside)


def box_blurred(pictures: np.ndarray, radius: int, alpha: float) -> np.ndarray:
    """Pictures (number, height, width) convolved with the kernel of `box_kernel`. It is a box plus a centre, so running sums
    over both axes and four look-ups a pixel do, whatever the radius."""
    n, height, width = pictures.shape
    reach, size = radius - 1, 2 * radius - 1
    wide = pictures[:, mirrored(np.arange(-reach, height + reach), height)][:, :, mirrored(np.arange(-reach, width + reach), width)]
    area = np.zeros((n, wide.shape[1] + 1, wide.shape[2] + 1))
    np.cumsum(np.cumsum(wide, axis=1), axis=2, out=area[:, 1:, 1:])
    box = area[:, size:, size:] - area[:, :-size, size:] - area[:, size:, :-size] + area[:, :-size, :-size]
    return (alpha * box + (1 - alpha) * pictures) / (alpha * (size * size - 1) + 1)


def _pictures(batch: pd.Series, size: int, change: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """A change of all pictures of a batch at once; a null stays, and pixels of another number than `size` are an error."""
    there = batch.notna().to_numpy()
    if wrong := {len(x) for x in batch[there]} - {size}:
        raise ValueError(f"a picture has {wrong.pop()} pixels, not {size}")
    out = pd.Series([None] * len(batch), dtype=object)
    if there.any():
        out[there] = pd.Series(list(change(np.array(list(batch[there]), dtype=float))), index=np.flatnonzero(there))
    return out


def blur(pixels: Column, width: int, height: int, radius: int, alpha: float) -> Column:
    """Convolution of a row-major picture with the box kernel; borders mirror without repeating the edge."""
    if radius <= 1:
        return pixels

    @F.pandas_udf("array<double>")
    def blurred(batch: pd.Series) -> pd.Series:
        return _pictures(batch, width * height, lambda x: box_blurred(x.reshape(-1, height, width), radius, alpha).reshape(len(x), -1))

    return blurred(pixels)


#: Forms of the keys that stand for drift parameters in names and caches, and default parameters.
KEY_FORMS = {"fog": "g%03db%03dr%03da%03dn%03d", "flood": "t%da%dr%dg%db%d", "haze": "m%03da%03df%03dh%03d"}
DEFAULTS = {
    "fog": {"gray": 0.3, "blend": 0.5, "radius": 0, "alpha": 1, "noise": 0.0},
    "flood": {"thresh": 4, "trans": 2, "r": 0x4B, "g": 0x36, "b": 0x19},
    "haze": {"vrm": 12.0, "vra": 450.0, "ft": 70.0, "ht": 34.0},
}
_TIMES = {"fog": {"gray": 100, "blend": 100, "noise": 100}, "flood": {}, "haze": {"vrm": 10, "vra": 10, "ft": 10, "ht": 10}}


def encoded(kind: str, **given: float) -> str:
    """Drift parameters as a key, defaults filled in; shares count in hundredths, metres in tenths, all cut to whole."""
    values = {**DEFAULTS[kind], **given}
    if unknown := set(values) - set(DEFAULTS[kind]):
        raise ValueError(f"{kind} has no parameter {sorted(unknown)}")
    if kind == "fog":
        values["radius"] = int(values["radius"])
        values["alpha"] = values["alpha"] if values["radius"] > 1 else 0
    return KEY_FORMS[kind] % tuple(int(float(v) * _TIMES[kind].get(k, 1)) for k, v in values.items())


def _fog(px: Column, channel: int, width: int, height: int, p: dict) -> Column:
    return blur(fog(px, p["gray"], p["blend"]), width, height, int(p["radius"]), p["alpha"])


def _haze(px: Column, channel: int, width: int, height: int, p: dict) -> Column:
    depths = F.array_repeat(F.lit(3.0), width * height)
    return haze(px, channel, p["vra"], p["vrm"], p["ft"], p["ht"], layered_noise(depths, width, height))


#: Image drifts by name: functions of a channel's pixels, the channel, the picture's width and height, and parameters.
DRIFTS = {"fog": _fog, "haze": _haze}


def drift(kind: str, px: Column, channel: int, width: int, height: int, **given: float) -> Column:
    """A registered image drift with its parameters, defaults filled in; an unknown name is an error."""
    if kind not in DRIFTS:
        raise ValueError(f"unknown image drift {kind}; known are {sorted(DRIFTS)}")
    return DRIFTS[kind](px, channel, width, height, {**DEFAULTS.get(kind, {}), **given})


def drifted_name(position: Column, stem: Column) -> Column:
    return F.format_string("img-%d-%s-drifted.png", position, stem)


def average_band(band_1: Column, band_2: Column) -> Column:
    return F.zip_with(band_1, band_2, lambda a, b: (a + b) / 2)


def split_grid(width: int, height: int, part: int, part_height: int | None = None) -> Column:
    """array<struct<row, col, x, y, w, h>> of the parts of a picture, square unless a height is given; the last row and
    column may be smaller."""
    tall = part_height or part
    rows, cols = math.ceil(height / tall), math.ceil(width / part)
    cells = F.sequence(F.lit(0), F.lit(rows * cols - 1))

    def cell(i: Column) -> Column:
        r, c = F.floor(i / cols).cast("int"), (i % cols).cast("int")
        return F.struct(r.alias("row"), c.alias("col"), (c * part).alias("x"), (r * tall).alias("y"), F.least(F.lit(part), width - c * part).alias("w"), F.least(F.lit(tall), height - r * tall).alias("h"))

    return F.transform(cells, cell)


def cut(pixels: Column, width: int, part: Column) -> Column:
    """The pixels of a part (struct with x, y, w and h) of a row-major picture."""
    lines = F.transform(F.sequence(F.lit(0), part["h"] - 1), lambda r: F.slice(pixels, ((part["y"] + r) * width + part["x"] + 1).cast("int"), part["w"]))
    return F.flatten(lines)


def mosaic(tiles: Column, cols: int, width: int, height: int) -> Column:
    """The pixels of one picture, row by row, from row-major tiles of equal size in row-major order."""
    count = (F.size(tiles) * (width * height)).cast("int")
    line = cols * width

    def at(i: Column) -> Column:
        row, col = F.floor(i / line), i % line
        tile = F.floor(row / height) * cols + F.floor(col / width)
        return F.get(F.get(tiles, tile.cast("int")), ((row % height) * width + col % width).cast("int"))

    # a sequence from 0 to -1 would run downwards
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), at)).otherwise(F.slice(F.get(tiles, F.lit(0)), 1, 0))
