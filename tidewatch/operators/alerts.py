"""Thresholds and alert levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(results: DataFrame, keys: tuple[str, ...] = ("metric",), value: str = "value") -> DataFrame:
    """(metric, max, min, num) over runs."""
    return results.groupBy(*keys).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("num"))


def ladder(high: Column, low: Column, steps: int = 4, floor: float = 0.0) -> Column:
    """Ascending thresholds from high down in `steps` whole increments, as long as they reach the floor."""
    step = F.ceil((high - low) / steps)
    down = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: high - k * step)
    return F.reverse(F.transform(F.filter(down, lambda v: v >= floor), lambda v: F.round(v, 2)))


def stddev_thresholds(mean: Column, sd: Column, n: int = 2) -> Column:
    """Ascending thresholds, n down to 1 standard deviations below the mean."""
    return F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda k: mean - k * sd)


def config(thresholds: Column) -> Column:
    """array<struct<ord, less_than, alert_level>>: level1 to levelN of an ascending ladder."""
    return F.transform(thresholds, lambda v, i: F.struct(i.alias("ord"), v.alias("less_than"), F.concat(F.lit("level"), (i + 1).cast("string")).alias("alert_level")))


def cascade(values: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, alert_level): values (key, metric, value) against rules (metric, metric_ord, ord, less_than, alert_level). The
    first metric with a threshold above its value decides, by its first such threshold; else `none`. Metrics without
    rules don't count; two values of one metric for one key are an error. Rules are configuration, so they are broadcast."""
    below = F.col("value") < F.col("less_than")
    twice = F.raise_error(F.concat(F.lit("more than one value of metric "), F.col("metric"))).cast(values.schema["value"].dataType)
    once = values.groupBy(key, "metric").agg(F.first("value").alias("one"), F.count("*").alias("n"))
    values = once.select(key, "metric", F.when(F.col("n") > 1, twice).otherwise(F.col("one")).alias("value"))
    joined = values.join(F.broadcast(rules), "metric", "left")
    level = F.min_by("alert_level", F.when(below, F.struct("metric_ord", "ord")))
    return joined.groupBy(key).agg(F.when(F.count_if(below) > 0, level).otherwise("none").alias("alert_level"))


def with_parameters(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """metrics (metric, ...) with params of the latest run that reports them."""
    latest = results.groupBy("metric").agg(F.max_by("params", "run").alias("params"))
    return metrics.join(F.broadcast(latest), "metric", "left")
