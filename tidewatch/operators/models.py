"""Splits, folds and model plug-ins. Models run where the rows are; the built-in trainer is Spark's own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import hashed
from . import classify, confidence, distances


class Metric(Protocol):
    """A metric turns the sets of predictions it is given, and parameters, into a frame with a row an interval or one row."""

    def __call__(self, sets: list[DataFrame], **params) -> DataFrame: ...


METRICS: dict[str, Metric] = {}
PREPARATIONS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
MODELS: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}


def registered(registry: dict, name: str):
    """Decorator that adds a plug-in under a name."""

    def add(f):
        registry[name] = f
        return f

    return add


@registered(METRICS, "atc")
def _atc(sets: list[DataFrame], **params) -> DataFrame:
    return confidence.metric(sets, params).select(F.col("accuracy").alias("overall"), F.create_map(F.lit("sliding_window"), F.col("sliding_window").cast("string")).alias("data"))


@registered(METRICS, "accuracy")
def _accuracy(sets: list[DataFrame], truth: str = "label", prediction: str = "prediction") -> DataFrame:
    return classify.confusion(sets[0], truth, prediction).select(F.col("accuracy").alias("overall"))


def _series(name: str):
    """A metric of an interval series (interval_idx, interval, aggregated, mean, std_dev), a row an interval."""

    def run(sets: list[DataFrame], range_start: float | None = None, range_end: float | None = None, range_step: float = 1.0) -> DataFrame:
        out = distances.metrics(sets[0], range_start, range_end, range_step)
        return out.select("interval_idx", F.col(name).alias("value"))

    run.fused = lambda sets, range_start=None, range_end=None, range_step=1.0: distances.metrics(sets[0], range_start, range_end, range_step)
    return run


for _name in ("kl", "hellinger", "tvd", "wasserstein", "energy", "z", "ks"):
    METRICS[_name] = _series(_name)


@registered(PREPARATIONS, "confidences")
def _confidences(df: DataFrame, params: dict) -> DataFrame:
    """Side data with two JSON lists of confidences, a match and an error: the score of the largest ones as they stand, the
    label by the error and the prediction by its percentile."""
    top = confidence.top_confidences(F.col("Confidence"), F.col("Confidence Invalid"), int(params.get("top", 50)))
    df = df.withColumn("score", confidence.entropy_score(top))
    if "Meters_Error" not in df.columns:
        return df
    return confidence.predictions_by_error(confidence.labels_by_error(df, "Meters_Error", "Matched", params.get("distance_error_threshold")), "Meters_Error")


_RESULT = "name string, metric string, results map<string,double>, data map<string,string>"


def _shared(sets: list[DataFrame], params: dict, configs: list[dict]) -> DataFrame:
    """Results of series metrics that have the same parameters: one frame holds all their columns, which are unpivoted."""
    wide = METRICS[configs[0]["metric_class"]].fused(sets, **params)
    asked = sorted({c["metric_class"] for c in configs})
    long = wide.unpivot("interval_idx", asked, "metric", "value")
    pair = F.struct(F.col("interval_idx").cast("string"), F.col("value").cast("double"))
    rows = long.groupBy("metric").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("results"))  # a row an interval: as many as the series is long
    names = wide.sparkSession.createDataFrame([(c["name"], c["metric_class"]) for c in configs], "name string, metric string")
    return rows.join(F.broadcast(names), "metric").select("name", "metric", "results", F.create_map().cast("map<string,string>").alias("data"))


def calculate(sets: list[DataFrame], configs: list[dict] | None) -> DataFrame:
    """(name, metric, results: map of key to value, data: map) of configured metrics (name, metric_class, params with an
    optional prep): overall of a one-row metric, an interval's index for each of a series. Metrics of one family with the
    same parameters share one plan, so their input is read once. An unknown class and a metric without a name are errors; a
    metric whose frame can't be planned is one too. Nothing configured gives no rows."""
    shared: dict[str, tuple[list[DataFrame], dict, list[dict]]] = {}
    frames = []
    for c in configs or []:
        if not c.get("name"):
            raise ValueError("a metric must have a name")
        if c.get("metric_class") not in METRICS:
            raise ValueError(f"unknown metric {c.get('metric_class')}; known are {sorted(METRICS)}")
        params = dict(c.get("params", {}))
        prep = params.pop("prep", None)
        metric, key = METRICS[c["metric_class"]], json.dumps(c.get("params", {}), sort_keys=True, default=str)
        if hasattr(metric, "fused") and key in shared:
            shared[key][2].append(c)
            continue
        given = [PREPARATIONS[prep](df, params) for df in sets] if prep else sets
        if hasattr(metric, "fused"):
            shared[key] = (given, params, [c])
            continue
        frame = metric(given, **params)
        data = F.col("data") if "data" in frame.columns else F.create_map().cast("map<string,string>")
        if "overall" in frame.columns:
            row = frame.select(F.create_map(F.lit("overall"), F.col("overall").cast("double")).alias("results"), data.alias("data"))
        else:
            pair = F.struct(F.col("interval_idx").cast("string"), F.col("value").cast("double"))
            row = frame.agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("results")).withColumn("data", F.create_map().cast("map<string,string>"))
        frames.append(row.select(F.lit(c["name"]).alias("name"), F.lit(c["metric_class"]).alias("metric"), "results", "data"))
    frames += [_shared(*group) for group in shared.values()]
    if not frames:
        return sets[0].sparkSession.createDataFrame([], _RESULT)
    return reduce(DataFrame.unionByName, frames)


def with_time(run: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a frame of configured metrics, calculated now, with total_in_ms: how long that took for all of them."""
    import time

    began = time.perf_counter()
    made = run()
    rows = made.collect()  # a row a configured metric
    taken = 1000 * (time.perf_counter() - began)
    return made.sparkSession.createDataFrame(rows, made.schema).withColumn("total_in_ms", F.lit(taken))


def split(id_col: str, validation_percent: float, seed: int = 42) -> Column:
    """train or validation, by a hash of the id."""
    return F.when(hashed(seed, F.col(id_col)) % 10000 < int(validation_percent * 100), "validation").otherwise("train")


def fold(id_col: str, folds: int = 5, seed: int = 42) -> Column:
    return (hashed(seed, F.col(id_col)) % folds).cast("int")


def predict(df: DataFrame, model: str, schema: str) -> DataFrame:
    """Applies a plug-in to batches of rows."""
    return df.mapInPandas(MODELS[model], schema)


def train_logistic(df: DataFrame, features: list[str], label: str, path: str | None = None):
    """Logistic regression over numeric columns; saved where a path is given."""
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label)]).fit(df)
    if path:
        model.write().overwrite().save(path)
    return model


def cross_validate(df: DataFrame, features: list[str], label: str, id_col: str, folds: int = 5) -> list[float]:
    """Accuracy on each held-out fold; one small number a fold reaches the driver."""
    marked = df.withColumn("_fold", fold(id_col, folds))
    scores = []
    for k in range(folds):
        model = train_logistic(marked.where(F.col("_fold") != k), features, label)
        out = model.transform(marked.where(F.col("_fold") == k))
        scores.append(out.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
    return scores


def load_model(path: str):
    """A model that train_logistic saved."""
    return PipelineModel.load(path)
