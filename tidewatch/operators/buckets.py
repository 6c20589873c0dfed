"""Dense interval series: sums and counts per fixed span of time or number of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import each, written

#: Microseconds of interval units, by name.
UNITS = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def microseconds(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def indexed(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Adds interval_idx, counted from the earliest row."""
    rows = df.withColumn("_us", microseconds(F.col(ts)))
    first = rows.agg(F.min("_us").alias("_first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("interval_idx", F.floor((F.col("_us") - F.col("_first")) / UNITS[unit])).drop("_us", "_first")


def dense(sums: DataFrame, start_s: int, unit: str, *values: str) -> DataFrame:
    """One row per interval from 0 to the last one: interval (epoch seconds from start_s on) and 0 where nothing fell."""
    last = sums.agg(F.max("interval_idx").alias("last")).where("last is not null")
    grid = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("interval_idx"))
    filled = grid.join(sums, "interval_idx", "left")
    label = (F.lit(start_s) + F.col("interval_idx") * (UNITS[unit] // 10**6)).alias("interval")
    return filled.select("interval_idx", label, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def by_time(df: DataFrame, ts: str, value: str, unit: str, start_s: int) -> DataFrame:
    """(interval_idx, interval, aggregated, num_samples)."""
    rows = indexed(df, ts, unit)
    sums = rows.groupBy("interval_idx").agg(F.sum(F.col(value).cast("double")).alias("aggregated"), F.count("*").alias("num_samples"))
    return dense(sums, start_s, unit, "aggregated", "num_samples")


def by_key(df: DataFrame, ts: str, value: str, unit: str, start_s: int, *keys: str) -> DataFrame:
    """(keys, interval_idx, interval, aggregated, num_samples): a series for each key, all of them from the earliest to the
    latest interval of the whole table."""
    rows = indexed(df, ts, unit)
    sums = written(rows.groupBy(*keys, "interval_idx").agg(F.sum(F.col(value).cast("double")).alias("aggregated"), F.count("*").alias("num_samples")), "key-sums")
    last = sums.agg(F.max("interval_idx").alias("_last"))
    grid = each(sums.select(*keys).distinct().crossJoin(F.broadcast(last)), F.lit(0), F.col("_last"), "interval_idx").drop("_last")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    filled = grid.alias("g").join(sums.alias("s"), [*same, F.col("g.interval_idx") == F.col("s.interval_idx")], "left")
    label = (F.lit(start_s) + F.col("g.interval_idx") * (UNITS[unit] // 10**6)).alias("interval")
    return filled.select("g.*", label, F.coalesce("aggregated", F.lit(0.0)).alias("aggregated"), F.coalesce("num_samples", F.lit(0)).alias("num_samples"))


def by_samples(df: DataFrame, pos: str, value: str, samples: int, unit: str, start_s: int) -> DataFrame:
    """The same over runs of `samples` positions."""
    rows = df.withColumn("interval_idx", F.floor(F.col(pos) / samples))
    sums = rows.groupBy("interval_idx").agg(F.sum(F.col(value).cast("double")).alias("aggregated"), F.count("*").alias("num_samples"))
    return dense(sums, start_s, unit, "aggregated", "num_samples")


def series(df: DataFrame, value: str, unit: str, start_s: int, ts: str | None = None, pos: str | None = None, samples: int | None = None) -> DataFrame:
    """By time if there is a timestamp column, else by number of samples."""
    if ts is not None and ts in df.columns:
        return by_time(df, ts, value, unit, start_s)
    if pos is None or samples is None:
        raise ValueError("without timestamps, positions and a number of samples are needed")
    return by_samples(df, pos, value, samples, unit, start_s)


def interval_at(intervals: DataFrame, index: int) -> DataFrame:
    """The interval of an index, one row; an error, when it is read, if the series has none."""
    row = F.struct(*intervals.columns)
    one = intervals.where(F.col("interval_idx") == index).agg(F.first(row).alias("_row"))
    absent = F.raise_error(F.lit(f"the series has no interval {index}")).cast(one.schema["_row"].dataType)
    return one.select(F.when(F.col("_row").isNull(), absent).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def index_of(intervals: DataFrame, interval: int) -> DataFrame:
    """One row (interval_idx) of an interval's label; an error, when it is read, if there is none."""
    hit = intervals.where(F.col("interval") == interval).agg(F.min("interval_idx").alias("i"))
    return hit.select(F.coalesce("i", F.raise_error(F.lit(f"the series has no interval at {interval}")).cast("long")).alias("interval_idx"))


def lagged_forecast(intervals: DataFrame, back: int = 7) -> DataFrame:
    """Adds mean and std_dev of the `back` intervals before; intervals without that many go. One row an interval, so the
    window is as long as the series, not the data."""
    window = Window.orderBy("interval_idx").rowsBetween(-back, -1)
    out = intervals.withColumn("mean", F.avg("aggregated").over(window)).withColumn("std_dev", F.stddev_samp("aggregated").over(window))
    return out.withColumn("_n", F.count("*").over(window)).where(F.col("_n") == back).drop("_n")


def forecast_parameters(forecasts: DataFrame) -> DataFrame:
    """mean and std_dev of forecasts (mean, upper: end of the 68 % interval)."""
    return forecasts.withColumn("std_dev", F.col("upper") - F.col("mean"))
