"""Parameter sweeps and the statistics of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sweep(spark: SparkSession, key: str, low: float, high: float, step: float, base: str) -> DataFrame:
    """(n, value, file_name), a row a value from low to high inclusive; values are whole multiples of the step, so no
    rounding adds or drops the last."""
    count = int((high - low) / step + 1e-9) + 1
    rows = spark.range(count).select(F.col("id").alias("n"), (F.lit(float(low)) + F.col("id") * F.lit(float(step))).alias("value"))
    return rows.withColumn("file_name", F.concat(F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(f"-{base}--{key.rpartition('.')[2]}-"), F.col("value").cast("string"), F.lit(".json")))


def run_sweep(base: DataFrame, values: DataFrame, drift: Column) -> DataFrame:
    """One plan for all values: base x sweep, which is a short table of configuration, with drifted computed from both."""
    return base.crossJoin(F.broadcast(values)).withColumn("drifted", drift)


def spread(results: DataFrame, case: str, value: str) -> DataFrame:
    """(case, mean, sd) of each drift case."""
    return results.groupBy(case).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def frame(results: DataFrame, run: str, case: str, value: str, cases: list) -> DataFrame:
    """Runs by row, drift cases by column."""
    return results.groupBy(run).pivot(case, cases).agg(F.first(value))


def average_rank(column: str, *keys: str) -> Column:
    """Rank from 1, ties sharing their mean rank, within keys."""
    part = Window.partitionBy(*keys)
    return F.rank().over(part.orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2


def spearman(results: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Rank correlation per key. Windows hold one key's results: runs of experiments, not samples."""
    rows = results.withColumn("_x", average_rank(x, *keys)).withColumn("_y", average_rank(y, *keys))
    return rows.groupBy(*keys).agg(F.corr("_x", "_y").alias("spearman"))


def field(config: dict, dotted: str):
    """(parent, last key) of a dotted name in nested dicts."""
    *path, last = dotted.split(".")
    for key in path:
        config = config[key]
    if last not in config:
        raise KeyError(dotted)
    return config, last
