"""Distances between two normal densities per interval, over a grid, and errors of single observations.

P has the mean of all aggregated values, Q the forecast mean; both have the forecast standard deviation. Where sums grow with
the data the grid grows with them, so nothing here is as long as the grid: points are exploded in blocks of BLOCK, only in the
blocks around the two means of an interval where a density is above 1e-18 of its height (CORE standard deviations), and the
others, which add nothing, count by formula. Blocks are partial sums of an aggregation, so an interval is dealt over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import normal_cdf, normal_density
from ..tables import each, written


#: Standard deviations that a spanning grid reaches beyond every mean; less than 2e-9 of either density is outside.
REACH = 6
#: Standard deviations around a mean beyond which a density is less than 3e-18 of its height, and points of a block.
CORE, BLOCK = 9, 1024


@dataclass(frozen=True)
class Grid:
    """Points start + k * step for k from low to high, columns of the one-row frame overall (also _mean, of all intervals)."""

    overall: DataFrame
    start: float
    step: float


def fixed_grid(intervals: DataFrame, start: float | None, end: float | None, step: float | None = 1.0, distribution: str = "normal") -> Grid:
    """A range that isn't given whole, a step that isn't above 0 and another distribution are errors."""
    if start is None or end is None or step is None:
        raise ValueError("the range of the grid isn't given whole")
    if step <= 0 or end <= start:
        raise ValueError(f"no grid from {start} to {end} in steps of {step}")
    if distribution != "normal":
        raise ValueError(f"unsupported distribution {distribution}")
    last = math.ceil((end - start) / step) - 1
    return Grid(intervals.agg(F.avg("aggregated").alias("_mean"), F.lit(0).cast("long").alias("_low"), F.lit(last).cast("long").alias("_high")), float(start), float(step))


def spanning(intervals: DataFrame, step: float = 1.0) -> Grid:
    """From REACH standard deviations below the least mean to as many above the greatest, in steps from a multiple of step
    on: one grid for all intervals that holds both densities of each, whatever their size."""
    mean, spread = F.avg("aggregated"), REACH * F.max("std_dev")
    low = F.least(F.min(F.col("mean") - REACH * F.col("std_dev")), mean - spread)
    high = F.greatest(F.max(F.col("mean") + REACH * F.col("std_dev")), mean + spread)
    return Grid(intervals.agg(mean.alias("_mean"), F.floor(low / step).cast("long").alias("_low"), F.ceil(high / step).cast("long").alias("_high")), 0.0, float(step))


def _with(intervals: DataFrame, grid: Grid) -> DataFrame:
    """Intervals with the grid's ends; one row is broadcast."""
    return intervals.select("interval_idx", "mean", "std_dev").crossJoin(F.broadcast(grid.overall))


def _densities(rows: DataFrame, grid: Grid, *keep: str) -> DataFrame:
    rows = rows.withColumn("x", F.col("_k") * F.lit(grid.step) + F.lit(grid.start))
    zp, zq = (F.col("x") - F.col("_mean")) / F.col("std_dev"), (F.col("x") - F.col("mean")) / F.col("std_dev")
    return rows.select(
        "interval_idx", "x", *keep,
        normal_density(F.col("x"), F.col("_mean"), F.col("std_dev")).alias("p"), normal_density(F.col("x"), F.col("mean"), F.col("std_dev")).alias("q"),
        (0.5 * (zq * zq - zp * zp)).alias("log_ratio"),
    )


def points(intervals: DataFrame, grid: Grid) -> DataFrame:
    """intervals (interval_idx, aggregated, mean, std_dev) -> (interval_idx, x, p, q, log_ratio: ln p - ln q), a row for every
    point of the grid and interval."""
    return _densities(each(_with(intervals, grid), F.col("_low"), F.col("_high"), "_k"), grid)


def density_grid(intervals: DataFrame, start: float | None, end: float | None, step: float | None = 1.0, distribution: str = "normal") -> DataFrame:
    """Every point from start to end."""
    return points(intervals, fixed_grid(intervals, start, end, step, distribution))


def spanning_grid(intervals: DataFrame, step: float = 1.0) -> DataFrame:
    """Every point of the spanning grid."""
    return points(intervals, spanning(intervals, step))


def _core(grid: Grid, mean: str) -> tuple[Column, Column]:
    """The first and last place of the grid within CORE standard deviations of a mean."""
    reach = CORE * F.col("std_dev")
    low, high = ((F.col(mean) + sign * reach - F.lit(grid.start)) / F.lit(grid.step) for sign in (-1, 1))
    return F.greatest(F.ceil(low).cast("long"), F.col("_low")), F.least(F.floor(high).cast("long"), F.col("_high"))


def core_points(intervals: DataFrame, grid: Grid) -> DataFrame:
    """(interval_idx, n: points of the grid, x, p, q, log_ratio) in the blocks where either density isn't as good as 0, each
    point once: the blocks around one mean, and those around the other that lie before or behind them."""
    rows = _with(intervals, grid).where("std_dev > 0")
    (pa, pb), (qa, qb) = _core(grid, "_mean"), _core(grid, "mean")
    rows = rows.select("*", (F.col("_high") - F.col("_low") + 1).alias("n"), pa.alias("_pa"), pb.alias("_pb"), qa.alias("_qa"), qb.alias("_qb"))
    block = lambda k: F.floor(F.col(k) / BLOCK)
    some_p, some_q = F.col("_pb") >= F.col("_pa"), F.col("_qb") >= F.col("_qa")
    first, last = F.when(some_p, block("_pa")).otherwise(block("_qb") + 1), F.when(some_p, block("_pb")).otherwise(block("_qb"))
    span = lambda there, a, b: F.when(there, F.struct(a.alias("a"), b.alias("b")))
    spans = F.array(span(some_p, first, last), span(some_q, block("_qa"), F.least(block("_qb"), first - 1)), span(some_q, F.greatest(block("_qa"), last + 1), block("_qb")))
    rows = rows.select("interval_idx", "mean", "std_dev", "_mean", "_low", "_high", "n", F.explode(spans).alias("_span")).where("_span.b >= _span.a")
    blocks = each(rows, F.col("_span.a"), F.col("_span.b"), "_block", 2)
    low, high = F.greatest(F.col("_block") * BLOCK, F.col("_low")), F.least(F.col("_block") * BLOCK + BLOCK - 1, F.col("_high"))
    inside = blocks.withColumn("_k", F.explode(F.sequence(low, high)))  # at most BLOCK numbers, and no fewer than one
    return _densities(inside, grid, "n")


def pointwise(intervals: DataFrame, grid: Grid) -> DataFrame:
    """(interval_idx, kl, hellinger, tvd, wasserstein): bits; root of the halved squared differences of roots; half the
    mean and the mean absolute difference over all points. Points where p underflows don't count towards the first two."""
    some, gap = F.col("p") != 0, F.sum(F.abs(F.col("p") - F.col("q"))) / F.first("n")
    roots = F.sqrt("p") - F.sqrt("q")
    return core_points(intervals, grid).groupBy("interval_idx").agg(
        F.sum(F.when(some, F.col("p") * F.col("log_ratio") / math.log(2)).otherwise(0.0)).alias("kl"),
        (F.sqrt(F.sum(F.when(some, roots * roots).otherwise(0.0))) / math.sqrt(2)).alias("hellinger"),
        (gap / 2).alias("tvd"),
        gap.alias("wasserstein"),
    )


def energy(intervals: DataFrame, grid: Grid) -> DataFrame:
    """(interval_idx, energy) of the density values as two samples: the root of twice the integral, over density values, of the
    squared difference of their distribution functions.

    A density falls with the distance from its mean, and both have one shape, so both samples are ordered by distance. A
    block is a range of distances, BLOCK steps wide, with at most 4 * BLOCK points. How many points of either sample lie
    farther off is a count of grid places, in closed form; so each block integrates its own part, by a running count over its
    points, and the parts are added. Beyond CORE standard deviations values and their gaps are as good as 0."""
    width = grid.step * BLOCK
    rows = _with(intervals, grid).where("std_dev > 0").withColumn("n", F.col("_high") - F.col("_low") + 1)
    rows = each(rows, F.lit(0), F.ceil(CORE * F.col("std_dev") / width).cast("long") - 1, "_block", 2)
    near, far = F.col("_block") * width, (F.col("_block") + 1) * width

    def place(x: Column, up: bool) -> Column:
        at = (x - F.lit(grid.start)) / F.lit(grid.step)
        return (F.ceil(at) if up else F.floor(at)).cast("long")

    def inside(mean: str, distance: Column) -> Column:
        """Points of the grid less than a distance from a mean."""
        above, below = place(F.col(mean) - distance, False) + 1, place(F.col(mean) + distance, True) - 1
        return F.greatest(F.least(below, F.col("_high")) - F.greatest(above, F.col("_low")) + 1, F.lit(0))

    def own(mean: str, sign: int) -> Column:
        """Distances and signs of a sample's points from near to far: a run on each side of the mean, which itself counts once."""
        m = F.col(mean)
        runs = [(F.greatest(place(m + near, True), F.col("_low")), F.least(place(m + far, True) - 1, F.col("_high"))), (F.greatest(place(m - far, False) + 1, F.col("_low")), F.least(place(m - near, False), F.col("_high")))]
        other = F.least(runs[1][1], F.greatest(place(m + near, True), F.col("_low")) - 1)
        runs[1] = (runs[1][0], other)
        none = F.array().cast("array<struct<d:double,s:int>>")
        at = lambda k: F.struct(F.abs(k * F.lit(grid.step) + F.lit(grid.start) - m).alias("d"), F.lit(sign).alias("s"))
        return F.concat(*(F.when(b >= a, F.transform(F.sequence(a, F.greatest(a, b)), at)).otherwise(none) for a, b in runs))

    height = lambda d: normal_density(d, F.lit(0.0), F.col("std_dev"))
    ahead = (F.col("n") - inside("_mean", far)) - (F.col("n") - inside("mean", far))
    # sentinels end the block at both sides and count nothing
    edges = F.array(F.struct(far.cast("double").alias("d"), F.lit(0).alias("s")), F.struct(near.cast("double").alias("d"), F.lit(0).alias("s")))
    rows = rows.select("interval_idx", "std_dev", "n", "_block", ahead.alias("_ahead"), F.explode(F.concat(own("_mean", 1), own("mean", -1), edges)).alias("e"))
    order = Window.partitionBy("interval_idx", "_block").orderBy(F.desc("e.d"), "e.s")
    value = height(F.col("e.d"))
    rows = rows.withColumn("gap", F.coalesce(F.lead(value).over(order) - value, F.lit(0.0))).withColumn("_sum", F.col("_ahead") + F.sum("e.s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    area = F.sum(F.col("_sum") * F.col("_sum") * F.col("gap")) / (F.first("n") * F.first("n"))
    return rows.groupBy("interval_idx").agg((math.sqrt(2) * F.sqrt(area)).alias("energy"))


def z_of() -> Column:
    """The forecast's error in standard deviations; null where it has no spread."""
    return F.try_divide(F.col("aggregated") - F.col("mean"), F.nullif("std_dev", F.lit(0.0)))


def ks_of(z: Column) -> Column:
    """The one-sample Kolmogorov-Smirnov statistic of a single observation."""
    phi = normal_cdf(z)
    return F.greatest(phi, 1 - phi)


def z_error(intervals: DataFrame) -> DataFrame:
    """(interval_idx, z)."""
    return intervals.select("interval_idx", z_of().alias("z"))


def ks_error(intervals: DataFrame) -> DataFrame:
    """(interval_idx, ks)."""
    return z_error(intervals).select("interval_idx", ks_of(F.col("z")).alias("ks"))


def metrics(intervals: DataFrame, start: float | None = None, end: float | None = None, step: float = 1.0) -> DataFrame:
    """All distances and errors, one row an interval; without bounds over the spanning grid. The intervals, a row each, are
    written first, so what they come from is read once, however many metrics there are."""
    intervals = written(intervals, "intervals")
    plain = intervals.withColumn("z", z_of()).withColumn("ks", ks_of(F.col("z"))).select("interval_idx", "interval", "z", "ks")
    grid = spanning(intervals, step) if start is None or end is None else fixed_grid(intervals, start, end, step)
    return plain.join(pointwise(intervals, grid), "interval_idx", "left").join(energy(intervals, grid), "interval_idx", "left")


def long_form(wide: DataFrame, *names: str) -> DataFrame:
    """(interval_idx, metric, value)."""
    return wide.unpivot("interval_idx", list(names), "metric", "value")
