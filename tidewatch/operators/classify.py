"""Binary predictions: thresholds, outcomes, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import let


def binarize(raw: Column, threshold: float = 0.5) -> Column:
    """1 above the threshold, else 0."""
    return F.when(raw > threshold, 1).otherwise(0)


def outcome(truth: Column, prediction: Column) -> Column:
    """tp, tn, fp or fn of labels 0 and 1."""
    right = F.when(truth == 1, "tp").otherwise("tn")
    wrong = F.when(truth == 1, "fn").otherwise("fp")
    return F.when(truth == prediction, right).otherwise(wrong)


def confusion(df: DataFrame, truth: str, prediction: str, *keys: str) -> DataFrame:
    """tn, fp, fn, tp and accuracy, overall or by keys: one aggregation."""
    kind = outcome(F.col(truth), F.col(prediction))
    counts = [F.count_if(kind == k).alias(k) for k in ("tn", "fp", "fn", "tp")]
    right = F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("accuracy")
    return df.groupBy(*keys).agg(*counts, right)


def align(truth: DataFrame, prediction: DataFrame, pos: str = "pos") -> DataFrame:
    """Positional zip of truths and predictions."""
    return truth.join(prediction, pos)


def softmax(values: Column) -> Column:
    total = lambda exp: F.aggregate(exp, F.lit(0.0), lambda a, x: a + x)
    return let(F.transform(values, lambda x: F.exp(x)), lambda exp: let(total(exp), lambda t: F.transform(exp, lambda x: x / t)))


def arg_max(values: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1
