"""Operators by hand: series, confidence, resampling, metrics by configuration, models, monitoring, pictures."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, pixels
from tidewatch.functions.math import permuted
from tidewatch.operators import alerts, buckets, classify, confidence, distances, experiments, models, ordering, resample
from tidewatch.plans.queries import QUERIES, START, table
from tidewatch.streaming import monitor

VALUES = [1, 2, 1, 3, 4, 5, 6, 1, 2, 1, 3, 4, 5, 6, 1]


def test_sample_buckets_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "pos long, v long")
    rows = buckets.series(df, "v", "day", 1635724800, pos="pos", samples=4).orderBy("interval_idx")
    assert [(r.aggregated, r.num_samples) for r in rows.collect()] == [(7.0, 4), (16.0, 4), (10.0, 4), (12.0, 3)]
    assert buckets.interval_at(rows, 2).first().aggregated == 10.0 and buckets.index_of(rows, 1635724800 + 86400).first()[0] == 1
    for k in (4, -1):
        with pytest.raises(Exception, match=f"no interval {k}"):
            buckets.interval_at(rows, k).collect()
    with pytest.raises(Exception, match="no interval at 5"):
        buckets.index_of(rows, 5).collect()
    with pytest.raises(ValueError):
        buckets.series(df, "v", "day", START)


def test_series_by_time_where_there_is_one(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 10:00:00' as t, 2 as v union all select timestamp_ntz '2024-01-03 09:00:00', 3")
    assert [(r.interval_idx, r.aggregated) for r in buckets.series(df, "v", "day", START, ts="t").orderBy("interval_idx").collect()] == [(0, 2.0), (1, 3.0)]
    assert buckets.forecast_parameters(spark.sql("select 3.0D as mean, 4.5D as upper")).first().std_dev == 1.5


def test_density_grids_are_checked(spark):
    days = spark.createDataFrame([(7, 5.0, 5.0, 1.0)], "interval_idx long, aggregated double, mean double, std_dev double")
    assert distances.density_grid(days, -1, 2, 0.5).count() == 6
    for bad in ((None, 5, 1.0), (0, None, 1.0), (0, 5, None), (0, 5, 0), (5, 5, 1.0)):
        with pytest.raises(ValueError):
            distances.density_grid(days, *bad)
    with pytest.raises(ValueError, match="unsupported"):
        distances.density_grid(days, 0, 5, 1.0, "uniform")
    wide = distances.metrics(days.withColumn("interval", F.lit(0)))
    assert {r.metric for r in distances.long_form(wide, "kl", "z").collect()} == {"kl", "z"}


# confidence: probability rows -> scores


def scores(spark, probabilities, labels=None):
    rows = [(k, p, *(labels[k] if labels else (0, 0))) for k, p in enumerate(probabilities)]
    df = spark.createDataFrame(rows, "pos long, p array<double>, label int, prediction int")
    return df.withColumn("score", confidence.entropy_score(F.col("p")))


@pytest.mark.parametrize(("probabilities", "limit", "want"), [([[0.5, 0.3], [0.6, 0.4]], -0.7, 50.0), ([[0.04578296, 0.01576773, 0.0, 0.0]], -0.1, 0.0), ([[0.04578296, 0.01576773, 0.0, 0.0]], 0.0, 0.0), ([[0.04578296, 0.01576773, 0.0, 0.0]], 1.0, 0.0)])
def test_accuracy_by_hand(spark, probabilities, limit, want):
    out = confidence.metric([scores(spark, probabilities)], {"average_atc_threshold": limit}).first()
    assert out.accuracy == want and out.sliding_window == 7


def test_sliding_window_by_hand(spark):
    """35 scores and one more: 4 of the latest 7 reach the threshold; with fewer than 7 there is none."""
    rows = [(k, -20.0 if k % 2 == 0 else -10.0) for k in range(35)] + [(35, -0.3)]
    df = spark.createDataFrame(rows, "pos long, score double")
    assert abs(confidence.metric([df], {"average_atc_threshold": -14.7, "sliding_window": 7}).first().accuracy - 400 / 7) < 1e-9
    with pytest.raises(Exception, match="fewer scores"):
        confidence.metric([df.where("pos < 6")], {"average_atc_threshold": -14.7, "sliding_window": 7}).collect()


def test_numbers_of_sets(spark):
    one = scores(spark, [[0.5, 0.5], [0.9, 0.1], [0.6, 0.4]], [(0, 1), (1, 1), (0, 0)])
    low = -2 * 0.5 * np.log(2)
    assert abs(confidence.threshold(one).first()[0] - low) < 1e-9
    two = scores(spark, [[0.25, 0.25, 0.25, 0.25], [0.9, 0.1]])
    assert confidence.metric([one, two]).first().accuracy == 50.0 and confidence.metric([one]).first().accuracy == 100.0
    for sets in ([], [one, one, one]):
        with pytest.raises(ValueError, match="one or two sets"):
            confidence.metric(sets)
    with pytest.raises(Exception, match="no probabilities"):
        confidence.metric([one.where("pos < 0")], {"average_atc_threshold": 0}).collect()


CONFIDENCES = [("[0.87, 0.6]", "[0.0, 0.001]"), ("[0.37, 0.5]", "[0.0, 0.001]"), ("[0.27, 0.7]", "[0.0, 0.001]"), ("[0.88, 0.99]", "[0.0, 0.001]"), ("[0.88, 0.99]", "[0.0, 0.001]")]


def test_metric_with_preparation(spark):
    """Five rows of confidences and a configured threshold: two of five reach it."""
    df = spark.createDataFrame([(a, b, True) for a, b in CONFIDENCES], "Confidence string, `Confidence Invalid` string, Matched boolean")
    config = {"name": "own", "metric_class": "atc", "params": {"prep": "confidences", "average_atc_threshold": -0.4, "distance_error_threshold": 5}}
    rows = models.with_time(lambda: models.calculate([df], [config])).collect()
    assert [(r.name, r.metric, r.results, r.data) for r in rows] == [("own", "atc", {"overall": 40.0}, {"sliding_window": "7"})] and rows[0].total_in_ms > 0
    errors = df.withColumn("Meters_Error", F.monotonically_increasing_id().cast("double"))
    prepared = models.PREPARATIONS["confidences"](errors, {})
    assert {"score", "label", "prediction"} <= set(prepared.columns)


def test_seven_metrics_share_one_scan(spark, sf_dir):
    from tidewatch.plans.queries import forecasts

    days = forecasts(spark, sf_dir)
    configs = [{"name": f"my {k}", "metric_class": k} for k in ("kl", "hellinger", "tvd", "wasserstein", "energy", "z", "ks")] + [{"name": "again", "metric_class": "kl"}]
    out = models.calculate([days], configs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "event_type" not in plan  # the intervals were written; events aren't read again
    got = {r.name: r.results for r in out.collect()}
    wide = {str(r.interval_idx): r for r in distances.metrics(days).collect()}
    assert got["again"] == got["my kl"] and set(got) == {c["name"] for c in configs}
    for c in configs:
        assert got[c["name"]] == pytest.approx({k: r[c["metric_class"]] for k, r in wide.items()})


@pytest.mark.parametrize("probabilities", [[[]], [[0.0, 0.0], [0.0, 0.0]], [[], None]])
def test_no_probabilities_are_an_error(spark, probabilities):
    with pytest.raises(Exception, match="no probabilities"):
        confidence.metric([scores(spark, probabilities)], {"average_atc_threshold": -7}).collect()


def test_one_vector_of_zeros_does_not_count(spark):
    assert confidence.metric([scores(spark, [[0.0, 0.0], [0.5, 0.3], [1.0]])], {"average_atc_threshold": -7}).first().accuracy == 100.0


def test_configurations_are_checked(spark):
    df = spark.range(1)
    assert models.calculate([df], None).count() == 0
    with pytest.raises(ValueError, match="a metric must have a name"):
        models.calculate([df], [{"metric_class": "atc"}])
    with pytest.raises(ValueError, match="unknown metric"):
        models.calculate([df], [{"name": "x", "metric_class": "nothing"}])


# resampling


def test_passes_have_orders_of_their_own(spark):
    base = spark.createDataFrame([(0, k, k) for k in range(30)] + [(1, 0, 99)], "bin_idx int, slot long, id long")
    draws = spark.createDataFrame([(k, k // 10, k % 10, 0) for k in range(90)] + [(90 + k, 9, k, 1 + k % 2) for k in range(4)], "pos long, sample_group_id long, i long, bin_idx int")
    rows = [r.original_id for r in resample.draw(draws, base, "id", seed=3).orderBy("pos").collect()]
    turns = [rows[30 * t : 30 * t + 30] for t in range(3)]
    assert all(sorted(t) == list(range(30)) for t in turns) and turns[0] != turns[1] != turns[2]
    assert rows[90:] == [99, None, 99, None]
    plain = [r.original_id for r in resample.draw(draws, base, "id").orderBy("pos").collect()]
    assert plain[:90] == list(range(30)) * 3


def test_permutations(spark):
    for n in (1, 2, 9, 500):
        assert sorted(r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1))).collect()) == list(range(n))


def test_shuffles(spark):
    df = spark.createDataFrame([(k % 2, k) for k in range(400)], "bin_idx int, id long")
    one, two = ({r.id: r.slot for r in resample.shuffled(df, "id", seed).collect()} for seed in (1, 2))
    for b in (0, 1):
        assert sorted(v for k, v in one.items() if k % 2 == b) == list(range(200))
    assert one != two and one == {r.id: r.slot for r in resample.shuffled(df.repartition(7), "id", 1).collect()}
    drawn = spark.createDataFrame([(k, k // 50, k) for k in range(200)], "pos long, sample_group_id long, original_id long")
    mixed = resample.shuffled_groups(drawn, 5).orderBy("pos").collect()
    assert [r.pos for r in mixed] == list(range(200)) and all(r.original_id // 50 == r.sample_group_id == r.pos // 50 for r in mixed)
    assert [r.original_id for r in mixed] != list(range(200))


def test_schedules_repeat_with_jitter():
    out = resample.repeated([10, 20], 7, (-2, 3), seed=4)
    assert out[:2] == [10, 20] and all(-2 <= v - (10, 20)[k % 2] < 3 for k, v in enumerate(out)) and len(out) == 7
    assert resample.repeated([10, 20, 30], 1) == [10, 20, 30]


def test_drift_by_configuration(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    bins = [("view", "view"), ("click", "click"), ("error", "error")]
    params = {"submodule": "prevalence", "bins": bins, "max_num_samples": 250, "sample_group_size": 100, "targets": {1: [30, 60]}}
    out = resample.apply_drift(events, "event_id", "event_type", "event_id", params)
    rows, kind = out.collect(), {r.event_id: r.event_type for r in events.collect()}
    assert len(rows) == 300
    shares = Counter((r.sample_group_id, kind[r.original_id]) for r in rows)
    assert [shares[g, "click"] for g in range(3)] == [30, 60, 30]
    for bad in ({}, {**params, "submodule": "nothing"}):
        with pytest.raises(ValueError, match="unknown drift policy"):
            resample.apply_drift(events, "event_id", "event_type", "event_id", bad)
    one = resample.apply_drift(events, "event_id", "event_type", "event_id", {"submodule": "none", "bins": [("all", 0)], "bin_value": "all", "max_num_samples": 5})
    assert one.count() == 5
    with pytest.raises(ValueError, match="no bins"):
        resample.apply_drift(events, "event_id", "event_type", "event_id", {"submodule": "none"})
    with pytest.raises(ValueError, match="unknown bin value"):
        resample.apply_drift(events, "event_id", "event_type", "event_id", {**params, "bin_value": "x"})


# order


@pytest.mark.parametrize("values", [[3.0, 1.0, 2.0, 2.0, 9.5], [5.0] * 40, [0.0, 5e-324, 1e-300, 1.0, -1e300, 1e300], [float(k * 7919 % 1000) for k in range(1000)] + [None, None], [1.0, 1.0 + 2**-52, 1.0 + 2**-51]])
def test_nth_smallest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    real = sorted(v for v in values if v is not None)
    for n in {1, 2, len(real) // 2 + 1, len(real)}:
        if n <= len(real):
            assert ordering.nth_smallest(df, "v", n).first()[0] == real[n - 1]
    assert ordering.nth_smallest(df, "v", 0).first()[0] is None and ordering.nth_smallest(df, "v", len(real) + 1).first()[0] is None
    assert ordering.nth_smallest(df, "v", F.count("v")).first()[0] == real[-1]


# alerts, experiments, models


def test_alert_cascade_by_hand(spark):
    levels = lambda *t: spark.createDataFrame([("m", 0, k, float(v), name) for k, (v, name) in enumerate(t)], "metric string, metric_ord int, ord int, less_than double, alert_level string")
    values = spark.createDataFrame([(1, "m", -0.6), (2, "n", 0.0)], "id long, metric string, value double")
    for rules, want in ((levels((-0.1, "critical")), "critical"), (levels((-0.7, "critical"), (-0.5, "warning")), "warning"), (levels((-1, "critical")), "none")):
        assert {r.id: r.alert_level for r in alerts.cascade(values, rules).collect()} == {1: want, 2: "none"}
    with pytest.raises(Exception, match="more than one value of metric m"):
        alerts.cascade(values.unionByName(values.where("id = 1")), levels((0, "critical"))).collect()


def test_dotted_fields():
    config = {"a": {"b": {"c": 1}}}
    parent, last = experiments.field(config, "a.b.c")
    parent[last] = 2
    assert config["a"]["b"]["c"] == 2
    with pytest.raises(KeyError):
        experiments.field(config, "a.b.x")


def test_logistic_model(spark, tmp_path):
    """A separable table is learnt, saved and loaded; folds are held out."""
    rows = [(k, float(k % 20), int(k % 20 >= 10)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    model = models.train_logistic(df, ["x"], "y", f"{tmp_path}/model")
    for m in (model, models.load_model(f"{tmp_path}/model")):
        assert m.transform(df).where("prediction != y").count() == 0
    assert min(models.cross_validate(df, ["x"], "y", "id", 3)) > 0.95
    models.MODELS["plus"] = lambda batches: (b.assign(p=b.x + 1)[["id", "p"]] for b in batches)
    assert {r.id: r.p for r in models.predict(df, "plus", "id long, p double").collect()} == {k: x + 1 for k, x, _ in rows}


def test_logistic_query_predicts_the_validation_part(spark, sf_dir):
    out = QUERIES["logistic_predictions"](spark, sf_dir).collect()
    want = table(spark, sf_dir, "events").where(models.split("event_id", 20) == "validation").collect()
    assert {r.event_id: r.truth for r in out} == {r.event_id: int(r.event_type in ("purchase", "signup")) for r in want}
    share = np.mean([r.truth for r in out])
    assert np.mean([r.prediction == r.truth for r in out]) >= max(share, 1 - share) - 0.05


def test_positional_zip(spark):
    a, b = (spark.createDataFrame([(k, k + d) for k in range(3)], f"pos long, {n} long") for n, d in (("truth", 0), ("prediction", 1)))
    assert sorted(map(tuple, classify.align(a, b).collect())) == [(0, 0, 1), (1, 1, 2), (2, 2, 3)]


# monitoring


def test_stream_against_windows(spark, sf_dir):
    """Every key's accuracy over its latest seven scores, and its level, as a window over the whole table has them."""
    from tidewatch.plans.queries import scored

    rows = scored(spark, sf_dir).selectExpr("vec_id % 10 as key", "vec_id as pos", "score").collect()
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: r.pos):
        seen = last[r.key] = [*last.get(r.key, []), r.score][-7:]
        used = [s for s in seen if s != 0]
        value = None if len(seen) < 7 else 100 * sum(s >= -2.2 for s in used) / len(used) if used else 0.0
        want[r.pos] = (value, "none" if value is None or value >= 60 else "critical" if value < 30 else "warning")
    got = {r.pos: (r.accuracy, r.alert_level) for r in QUERIES["stream_monitor"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and (got[k][0] == want[k][0] or abs(got[k][0] - want[k][0]) < 1e-9) for k in want)


def batches(spark, tmp_path, out, parts):
    """What the stream has written after each part of its input; `out` reads tmp_path/in."""
    got = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with monitor.state_store(spark):
            query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
            query.awaitTermination()
        got.append(spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    return got


def source(spark, tmp_path, schema):
    (tmp_path / "in").mkdir()
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")


def test_stream_keeps_state_between_batches(spark, tmp_path):
    """The same row twice with a window of two: none, then critical."""
    row = spark.createDataFrame([(1, 0, -0.9)], "key long, pos long, score double")
    out = monitor.monitor(source(spark, tmp_path, row.schema), -0.5, 2, [(50.0, "critical")])
    got = batches(spark, tmp_path, out, [row, row])
    assert [sorted(r.alert_level for r in rows) for rows in got] == [["none"], ["critical", "none"]]


SCORES = "key long, pos long, score double, at timestamp"


def test_rows_out_of_order_and_late(spark, tmp_path):
    """Rows of two batches count in the order of their time; one later than the watermark goes; the rest waits."""
    when = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    frame = lambda rows: spark.createDataFrame([(k, s, float(v), when(s)) for k, s, v in rows], "key long, pos long, score double, at string").withColumn("at", F.col("at").cast("timestamp"))
    first = frame([(1, 30, -1), (1, 10, -3), (2, 100, -3)])
    second = frame([(1, 45, -3), (1, 42, -1), (2, 400, -1), (1, 38, -1)])  # the watermark is at 40 s: 42 and 45 s come late but in time, 38 s is too late
    third = frame([(3, 700, -1)])
    out = monitor.monitor(source(spark, tmp_path, first.schema), -2.0, 2, [(40.0, "critical"), (60.0, "warning")], "at", "60 seconds")
    got = batches(spark, tmp_path, out, [first, second, third])
    plain = [sorted((r.key, r.pos, r.accuracy, r.alert_level) for r in rows) for rows in got]
    assert [r[:2] for r in plain[0]] == [(1, 10), (1, 30)]
    assert plain[-1] == [(1, 10, None, "none"), (1, 30, 50.0, "warning"), (1, 42, 100.0, "none"), (1, 45, 50.0, "warning"), (2, 100, None, "none"), (2, 400, 50.0, "warning")]


def test_idle_keys_begin_anew(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "key long, pos long, score double, s long").select("key", "pos", "score", F.timestamp_seconds(F.col("s") + 10**9).alias("at"))
    out = monitor.windowed(source(spark, tmp_path, frame([(1, 0, 0.5, 0)]).schema), 0.0, 2, "at", "0 seconds", idle_s=100)
    got = batches(spark, tmp_path, out, [frame([(1, 1, 0.5, 10), (1, 2, 0.5, 20)]), frame([(2, 3, 0.5, 500)]), frame([(1, 4, 0.5, 600)])])
    assert {r.pos: r.accuracy for r in got[-1]} == {1: None, 2: 100.0, 3: None, 4: None}


def test_dense_stream_equals_the_table(spark, tmp_path, sf_dir):
    """Several batches with rows out of order, and empty intervals: every interval that the watermark has passed."""
    events = table(spark, sf_dir, "events").where("event_id % 17 = 0").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    parts = [events.where(F.col("event_id") % 3 == k).drop("event_id") for k in range(3)]
    out = monitor.dense(source(spark, tmp_path, parts[0].schema), "event_type", "ts", "value", START, buckets.UNITS["hour"], "40 days")
    last = spark.sql("select timestamp '2024-04-01 00:00:00' as ts, 'view' as event_type, 1.0D as value")
    got = {(r.key, r.interval_idx): (r.interval, round(r.aggregated, 6), r.num_samples) for r in batches(spark, tmp_path, out, [*parts, last])[-1]}
    rows: dict = {}
    for r in events.collect():
        rows.setdefault((r.event_type, int((r.ts.timestamp() - START) // 3600)), []).append(r.value)
    kinds, reach = {k for k, _ in rows}, max(k for _, k in got)
    assert reach >= max(k for _, k in rows) - 24 * 10
    want = {(t, k): (START + 3600 * k, round(sum(rows.get((t, k), [])), 6), len(rows.get((t, k), []))) for t in kinds for k in range(reach + 1)}
    assert got == want and any(v[2] == 0 for v in got.values())


def test_stream_series_query(spark, sf_dir):
    got = {(r.event_type, r.interval_idx): (r.aggregated, r.num_samples) for r in QUERIES["stream_series"](spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "events").withColumn("over", F.when(F.col("value") > 35, 1).otherwise(0))
    rows = rows.withColumn("h", F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - START) / 3600)).groupBy("event_type", "h").agg(F.sum("over").alias("s"), F.count("*").alias("n")).collect()
    want, reach = {(r.event_type, r.h): (float(r.s), r.n) for r in rows}, max(k for _, k in got)
    assert len(got) == 5 * (reach + 1) and reach >= max(k for _, k in want) - 1
    assert all(got[k] == want.get(k, (0.0, 0)) for k in got)


def test_stream_buckets(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:10:00' as ts, 2.0D as v union all select timestamp '2024-01-01 00:50:00', 3.0D union all select timestamp '2024-01-02 05:00:00', 1.0D").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/in")
    out = monitor.run_to_end(monitor.bucketed(stream, "ts", "v", "1 hour", "1 hour"), "buckets")
    assert [(r.aggregated, r.num_samples) for r in out.orderBy("interval").collect()][0] == (5.0, 2)


# pictures and tiles


def test_keys_of_drift_parameters():
    assert pixels.encoded("fog") == "g030b050r000a000n000" and pixels.encoded("fog", gray=0.8, radius=3, alpha=0.5) == "g080b050r003a000n000"
    assert pixels.encoded("flood", thresh=20) == "t20a2r75g54b25" and pixels.encoded("haze", vra=45.5) == "m120a455f700h340"
    with pytest.raises(ValueError, match="no parameter"):
        pixels.encoded("haze", speed=1)


def test_drifts_by_name(spark):
    df = spark.createDataFrame([([10.0, 200.0, 30.0, 90.0],)], "px array<double>")
    assert df.select(pixels.drift("fog", df.px, 0, 2, 2, gray=1.0, blend=1.0)).first()[0] == [255.0] * 4
    hazed = df.select(pixels.drift("haze", df.px, 2, 2, 2)).first()[0]
    assert all(min(x, 201) <= y <= max(x, 201) for x, y in zip([10.0, 200.0, 30.0, 90.0], hazed, strict=True))
    with pytest.raises(ValueError, match="unknown image drift"):
        pixels.drift("snow", df.px, 0, 2, 2)


def test_rays(spark):
    assert np.allclose(pixels.ray_lengths(70, 34), (32.2 / 98.2 * 100, 36 / 98.2 * 100, 30 / 98.2 * 100))
    assert np.allclose(pixels.ray_lengths(70, 34, 20, 50), (50, 0, 0)) and np.allclose(pixels.ray_lengths(20, 50), (30 / 98.2 * 100, 18.2 / 98.2 * 100, 50 / 98.2 * 100))
    assert np.allclose(pixels.ray_lengths(0, 34), (32.2 / 98.2 * 100, 0, 66 / 98.2 * 100))


def plain_noise(x, y, z, p):
    """Gradient noise of one point from its definition: twelve directions to the edges of a cube, four of them twice."""
    edges = [(1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1), (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1), (1, 1, 0), (0, -1, 1), (-1, 1, 0), (0, -1, -1)]
    cell = [int(np.floor(v)) for v in (x, y, z)]
    total = 0.0
    for corner in np.ndindex(2, 2, 2):
        at = [(c + d) % 256 for c, d in zip(cell, corner)]
        edge = edges[p[(p[(p[at[0]] + at[1]) % 256] + at[2]) % 256] % 16]
        away = [v - c - d for v, c, d in zip((x, y, z), cell, corner)]
        fade = [6 * t**5 - 15 * t**4 + 10 * t**3 for t in (v - c for v, c in zip((x, y, z), cell))]
        total += sum(e * a for e, a in zip(edge, away)) * np.prod([f if d else 1 - f for f, d in zip(fade, corner)])
    return total


def test_noise_by_definition(spark):
    rng = np.random.default_rng(3)
    table = [int(v) for v in rng.permutation(256)]
    x, y, z = rng.uniform(-300, 600, (3, 200))
    got = pixels.lattice_noise(x, y, z, table)
    assert np.allclose(got, [plain_noise(*at, table) for at in zip(x, y, z)], atol=1e-9) and np.abs(got).max() <= 1.1
    assert np.allclose(pixels.lattice_noise(np.arange(9.0), np.arange(9.0) * 3, np.full(9, 2.0), table), 0)
    with pytest.raises(ValueError, match="permutation"):
        pixels.lattice_noise(x, y, z, [0] * 256)
    depths = [[3.0 + k for k in range(12)], None]
    out = [r[0] for r in spark.createDataFrame([(d,) for d in depths], "d array<double>").coalesce(1).select(pixels.layered_noise(F.col("d"), 4, 3, table)).collect()]
    want = [sum(np.trunc((plain_noise(k % 4 * s, k // 4 * s, depths[0][k] * s, table) + add) * 128) * w for s, add, w in pixels.NOISE_FIELDS) / 3 for k in range(12)]
    assert np.allclose(out[0], want) and out[1] is None


@pytest.mark.parametrize(("radius", "side"), [(2, 64), (5, 64), (20, 64), (9, 5), (4, 1)])
def test_blur_by_convolution(spark, radius, side):
    """Against a plain sum over the kernel; the reach may be larger than the picture."""
    rng, wide = np.random.default_rng(radius), side + (side > 1)
    picture = rng.uniform(0, 255, (side, wide))
    kernel, reach = np.array(pixels.box_kernel(radius, 0.3)), radius - 1

    def place(v, n):
        while not 0 <= v < n:
            v = 0 if n == 1 else -v if v < 0 else 2 * (n - 1) - v
        return v

    padded = np.array([[picture[place(r, side), place(c, wide)] for c in range(-reach, wide + reach)] for r in range(-reach, side + reach)])
    want = np.array([[np.sum(padded[r : r + 2 * reach + 1, c : c + 2 * reach + 1] * kernel) for c in range(wide)] for r in range(side)])
    rows = spark.createDataFrame([(1, picture.ravel().tolist()), (2, None)], "id int, px array<double>").withColumn("px", pixels.blur(F.col("px"), wide, side, radius, 0.3)).collect()
    got = {r.id: r.px for r in rows}
    assert np.allclose(got[1], want.ravel(), atol=1e-9) and got[2] is None


def test_tile_points(spark):
    df = spark.createDataFrame([(3, 5, 3)], "x long, y long, z int")
    assert df.select(geo.quad_key(df.x, df.y, df.z)).first()[0] == "213" and df.select(geo.quad_key(df.x * 0, df.y * 0, df.z * 0)).first()[0] == ""
    top, left = geo.tile_corner(df.x, df.y, df.z)
    middle = geo.tile_corner(df.x, df.y, df.z, 0.5, 0.5)
    bottom, right = geo.tile_corner(df.x, df.y, df.z, 1, 1)
    r = df.select(top.alias("t"), left.alias("l"), middle[0].alias("m"), middle[1].alias("n"), bottom.alias("b"), right.alias("r")).first()
    assert r.t > r.m > r.b and abs((r.l + r.r) / 2 - r.n) < 1e-9


class Held:
    """A state variable and a handle of a processor, counting what is read and registered."""

    def __init__(self):
        self.value, self.read, self.timers, self.made = [], 0, [], {}

    def getListState(self, name, schema):  # noqa: N802
        return self.made.setdefault(name, Held())

    getValueState = getListState  # noqa: N815

    def registerTimer(self, time):  # noqa: N802
        self.timers.append(time)

    def exists(self):
        return bool(self.value)

    def get(self):
        self.read += len(self.value)
        return iter(self.value) if isinstance(self.value, list) else self.value

    def put(self, value):
        self.value = list(value)

    def appendList(self, value):  # noqa: N802
        self.value += value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = []


def test_work_of_waiting_rows_grows_with_their_number():
    """A row a second: one timer a key, at which all that the watermark has passed is read and comes out; one for the rest."""
    from types import SimpleNamespace

    import pandas as pd

    n, handle = 1000, Held()
    key = monitor.Sliding(-2.0, 2, True, None)
    key.init(handle)
    rows = pd.DataFrame({"pos": range(n), "score": -1.0, "at_us": [k * 10**6 for k in reversed(range(n))]})
    assert not list(key.handleInputRows((1,), iter([rows[:600], rows[600:]]), None)) and handle.timers == [0]
    fire = lambda time, mark: list(key.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: time)))
    out = pd.concat(fire(0, 899_500))
    assert out["pos"].tolist() == list(range(n - 1, n - 901, -1)) and handle.made["waiting"].read == n and handle.timers == [0, 900_000]
    assert len(pd.concat(fire(900_000, 10**9))) == 100 and handle.made["waiting"].read == n + 100 and not handle.made["waiting"].exists()
    assert not fire(10**9, 10**9) and len(handle.timers) == 2


def test_scores_work_out_an_embedding_once(spark, sf_dir):
    from tidewatch.operators import confidence
    from tidewatch.plans.queries import probabilities

    made = table(spark, sf_dir, "embeddings").select(confidence.entropy_score(probabilities()).alias("score"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Relation")[0].count("cast(embedding#") == 1
