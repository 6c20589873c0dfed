"""Scalar functions as column expressions; all stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of formula 7.1.26 of Abramowitz and Stegun, error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), value worked out once: what an array function's lambda or several places use is else worked out at each use."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def hashed(seed: int, *parts: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 that any SQL engine with md5 computes alike."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def permuted(i: Column, n: Column, *key: Column, rounds: int = 20) -> Column:
    """The image of i under a pseudorandom permutation of 0..n-1 (n >= 1) chosen by key: in each round i and its mirror
    image about a keyed point swap places, or not, as a keyed hash of the larger of the two says."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("point"), r, *key), n) - x, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(x, mirror), *key) % 2 == 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, swap)
