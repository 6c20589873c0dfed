"""Average thresholded confidence: a score per vector of class probabilities, a threshold that matches the error count of
a labelled reference, and the share of target scores at or above it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import let
from ..tables import written
from .ordering import nth_smallest, percentiles, sliding


#: Fixed value: the window that is recommended where none is configured.
RECOMMENDED_WINDOW = 7


def entropy_score(probabilities: Column) -> Column:
    """Sum of p ln(p + 1e-20), null and NaN entries left out; null for a vector that is empty or all 0, as it says nothing."""
    total = lambda real: F.aggregate(real, F.lit(0.0), lambda a, p: a + p * F.log(p + F.lit(1e-20)))
    return let(F.filter(probabilities, lambda p: p.isNotNull() & ~F.isnan(p)), lambda real: F.when(F.exists(real, lambda p: p != 0), total(real)))


def max_confidence(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def top_confidences(valid: Column, invalid: Column, n: int = 50) -> Column:
    """The n largest of two JSON lists of numbers, descending."""
    both = F.concat(F.from_json(valid, "array<double>"), F.from_json(invalid, "array<double>"))
    return F.slice(F.sort_array(both, asc=False), 1, n)


def labels_by_error(df: DataFrame, error: str, matched: str, threshold: float | None = None) -> DataFrame:
    """Adds label: 1 up to the threshold (default: the median error of matched rows)."""
    limit = percentiles(df.where(F.col(matched)), error, [0.5]).first()[0] if threshold is None else threshold
    return df.withColumn("label", F.when(F.col(error) <= F.lit(limit).cast("double"), 1).otherwise(0))


def predictions_by_error(df: DataFrame, error: str, share: float = 0.95) -> DataFrame:
    """Adds prediction: 1 below that percentile of all errors."""
    limit = percentiles(df, error, [share]).first()[0]
    return df.withColumn("prediction", F.when(F.col(error) < F.lit(limit).cast("double"), 1).otherwise(0))


def threshold(df: DataFrame, score: str = "score", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row (threshold): with N wrong rows among those whose score isn't 0, the N-th smallest of their scores, or 0.0 if N
    is 0: there false positives and false negatives balance. Scores are made once and written."""
    rows = written(df.select(score, label, prediction).where(F.col(score) != 0), "scores")
    wrong = F.count_if(F.col(label) != F.col(prediction))
    return nth_smallest(rows, score, wrong).select(F.coalesce("value", F.lit(0.0)).alias("threshold"))


def metric(predictions: Sequence[DataFrame], params: Mapping | None = None, score: str = "score") -> DataFrame:
    """One row (accuracy, sliding_window) of one or two sets (score, label, prediction; pos for a window): the threshold
    comes from average_atc_threshold in params or else from the first set, the accuracy from the last set. With
    sliding_window in params it is the accuracy of the latest position; the row recommends a window where none is set.
    Another number of sets is an error."""
    params = params or {}
    if len(predictions) not in (1, 2):
        raise ValueError(f"one or two sets of predictions are needed, but {len(predictions)} were received")
    if "average_atc_threshold" in params:
        limit = predictions[0].sparkSession.createDataFrame([(float(params["average_atc_threshold"]),)], "threshold double")
    else:
        limit = threshold(predictions[0], score)
    target, window = predictions[-1].crossJoin(F.broadcast(limit)), int(params.get("sliding_window", 0))
    if window:
        done = windowed_accuracy(target, F.col("threshold"), window, score=score).agg(F.max_by("accuracy", "pos").alias("accuracy"))
        done = done.select(F.coalesce("accuracy", F.raise_error(F.lit("there are fewer scores than the window needs")).cast("double")).alias("accuracy"))
    else:
        done = accuracy(target, F.col("threshold"), score)
    return done.withColumn("sliding_window", F.lit(window or RECOMMENDED_WINDOW))


def accuracy(df: DataFrame, limit: Column, score: str = "score") -> DataFrame:
    """One row: 100 times the share of scores other than 0 that reach the limit; 0 if all are 0. An input without a score -
    no rows, or vectors that are all empty or all 0 - is an error when the row is read."""
    used = F.col(score) != 0
    share = F.coalesce(F.avg(F.when(used, F.when(F.col(score) >= limit, 100.0).otherwise(0.0))), F.lit(0.0))
    checked = F.when(F.count(score) == 0, F.raise_error(F.lit("there are no probabilities, or all are 0")).cast("double")).otherwise(share)
    return df.agg(checked.alias("accuracy"))


def windowed_accuracy(df: DataFrame, limit: Column, size: int, pos: str = "pos", score: str = "score") -> DataFrame:
    """df with accuracy over the latest `size` scores of each position, zeros taking a place but not counting; positions
    with fewer scores go."""
    rows, own, window = sliding(df, pos, size)
    hit = F.when(F.col(score) != 0, F.when(F.col(score) >= limit, 100.0).otherwise(0.0))
    rows = rows.withColumn("accuracy", F.coalesce(F.avg(hit).over(window), F.lit(0.0))).withColumn("_n", F.count("*").over(window))
    return rows.where(own & (F.col("_n") == size)).drop("_chunk", "_n")
