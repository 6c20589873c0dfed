"""The queries over the supplied tables, each with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, math, pixels
from ..operators import alerts, buckets, classify, confidence, distances, experiments, forecast, models, ordering, references, resample
from ..roles import Roles, sample_at, sample_by_id, samples_between
from ..sources import datasets
from ..streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

START, THRESHOLD = 1704067200, 35.0  # 2024-01-01, near the median of events.value
BINS = [("view", "view"), ("click", "click"), ("purchase", "purchase"), ("signup", "signup"), ("error", "error")]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, raw, truth, prediction) of events."""
    events = table(spark, sf_dir, "events")
    truth = F.col("event_type").isin("purchase", "signup").cast("int")
    return events.select("event_id", "ts", F.col("value").alias("raw"), truth.alias("truth"), classify.binarize(F.col("value"), THRESHOLD).alias("prediction"))


PRED = "p as (select event_id, ts, value as raw, (event_type in ('purchase', 'signup'))::int as truth, (value > 35)::int as prediction from events)"
IDX = "i as (select *, (epoch_us(ts) - min(epoch_us(ts)) over ()) // 86400000000 as interval_idx from p)"
DAYS = f"""{PRED}, {IDX}, s as (select interval_idx, sum(prediction)::double as aggregated, count(*) as num_samples from i group by 1),
g as (select unnest(generate_series(0, (select max(interval_idx) from s))) as interval_idx),
d as (select interval_idx, 1704067200 + interval_idx * 86400 as interval, coalesce(aggregated, 0) as aggregated, coalesce(num_samples, 0) as num_samples from g left join s using (interval_idx)),
f as (select *, avg(aggregated) over w as mean, stddev_samp(aggregated) over w as std_dev, count(*) over w as n from d window w as (order by interval_idx rows between 7 preceding and 1 preceding)),
fc as (select interval_idx, interval, aggregated, num_samples, mean, std_dev from f where n = 7)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.by_time(predictions(spark, sf_dir), "ts", "prediction", "day", START)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.lagged_forecast(daily(spark, sf_dir))


@query(f"with {PRED} select event_id, prediction from p")
def events_binarize(spark, sf_dir):
    return predictions(spark, sf_dir).select("event_id", "prediction")


@query(f"with {PRED} select count(*) filter (truth = 0 and prediction = 0) as tn, count(*) filter (truth = 0 and prediction = 1) as fp, count(*) filter (truth = 1 and prediction = 0) as fn, count(*) filter (truth = 1 and prediction = 1) as tp, round(avg((truth = prediction)::int), 9) as accuracy from p")
def events_confusion(spark, sf_dir):
    return classify.confusion(predictions(spark, sf_dir), "truth", "prediction").withColumn("accuracy", F.round("accuracy", 9))


@query("select count(*) filter (quality = 0 and toxic = 1) as tn, count(*) filter (quality = 0 and toxic = 0) as fp, count(*) filter (quality = 1 and toxic = 1) as fn, count(*) filter (quality = 1 and toxic = 0) as tp, round(avg((quality = 1 - toxic)::int), 9) as accuracy from labels")
def labels_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("prediction", 1 - F.col("toxic"))
    return classify.confusion(rows, "quality", "prediction").withColumn("accuracy", F.round("accuracy", 9))


@query(f"with {PRED} select event_id, case when truth = prediction then case truth when 1 then 'tp' else 'tn' end when truth = 1 then 'fn' else 'fp' end as outcome from p")
def events_outcomes(spark, sf_dir):
    return predictions(spark, sf_dir).select("event_id", classify.outcome(F.col("truth"), F.col("prediction")).alias("outcome"))


@query(f"with {DAYS} select interval_idx, interval, aggregated, num_samples from d")
def events_daily_agg(spark, sf_dir):
    return daily(spark, sf_dir)


@query("with r as (select value, row_number() over (order by event_id) - 1 as pos from events), s as (select pos // 500 as interval_idx, sum(value) as aggregated, count(*) as num_samples from r group by 1), g as (select unnest(generate_series(0, (select max(interval_idx) from s))) as interval_idx) select interval_idx, 1704067200 + interval_idx * 86400 as interval, round(coalesce(aggregated, 0), 4) as aggregated, coalesce(num_samples, 0) as num_samples from g left join s using (interval_idx)")
def events_sample_buckets(spark, sf_dir):
    rows = ordering.with_position(table(spark, sf_dir, "events"), "event_id")
    return buckets.by_samples(rows, "pos", "value", 500, "day", START).withColumn("aggregated", F.round("aggregated", 4))


@query(f"with {DAYS}, a as (select interval_idx, round(avg((truth = prediction)::int), 9) as accuracy from i group by 1) select g.interval_idx, accuracy from g left join a using (interval_idx)")
def events_daily_accuracy(spark, sf_dir):
    rows = buckets.indexed(predictions(spark, sf_dir), "ts", "day")
    found = classify.confusion(rows, "truth", "prediction", "interval_idx").select("interval_idx", F.round("accuracy", 9).alias("accuracy"))
    return daily(spark, sf_dir).select("interval_idx").join(found, "interval_idx", "left")


@query(f"with {DAYS} select interval_idx, interval, aggregated, round(mean, 9) as mean, round(std_dev, 9) as std_dev from fc")
def baseline_forecast(spark, sf_dir):
    return forecasts(spark, sf_dir).select("interval_idx", "interval", "aggregated", F.round("mean", 9).alias("mean"), F.round("std_dev", 9).alias("std_dev"))


@query(f"with {DAYS} select interval_idx, interval, aggregated, round((aggregated - mean) / nullif(std_dev, 0), 6) as z from fc")
def drift_daily_ztest(spark, sf_dir):
    days = forecasts(spark, sf_dir)
    return days.select("interval_idx", "interval", "aggregated").join(distances.z_error(days), "interval_idx").withColumn("z", F.round("z", 6))


GRIDDED = f"""{DAYS}, o as (select avg(aggregated) as m, floor(least(min(mean - 6 * std_dev), avg(aggregated) - 6 * max(std_dev)))::bigint as low, ceil(greatest(max(mean + 6 * std_dev), avg(aggregated) + 6 * max(std_dev)))::bigint as high from fc),
x as (select interval_idx, k::double as x, (k - m) / std_dev as zp, (k - mean) / std_dev as zq, std_dev from fc, o, (select unnest(generate_series((select low from o), (select high from o))) as k)),
y as (select interval_idx, x, exp(-0.5 * zp * zp) / (std_dev * sqrt(2 * pi())) as p, exp(-0.5 * zq * zq) / (std_dev * sqrt(2 * pi())) as q, 0.5 * (zq * zq - zp * zp) as log_ratio from x)"""


@query(f"with {GRIDDED} select interval_idx, x, round(p, 10) as p, round(q, 10) as q from y")
def density_grid(spark, sf_dir):
    grid = distances.spanning_grid(forecasts(spark, sf_dir))
    return grid.select("interval_idx", "x", F.round("p", 10).alias("p"), F.round("q", 10).alias("q"))


POINTWISE = {
    "kl": ("sum(case when p <> 0 then p * log_ratio / ln(2) else 0 end)", 6),
    "hellinger": ("sqrt(sum(case when p <> 0 then (sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q)) else 0 end)) / sqrt(2)", 6),
    "tvd": ("avg(abs(p - q)) / 2", 10),
    "wasserstein": ("avg(abs(p - q))", 10),
}


def _pointwise(name: str, sql: str, digits: int) -> None:
    def run(spark, sf_dir):
        days = forecasts(spark, sf_dir)
        out = distances.pointwise(days, distances.spanning(days))
        return out.select("interval_idx", F.round(name, digits).alias(name))

    run.__name__ = f"{name}_daily"
    query(f"with {GRIDDED} select interval_idx, round({sql}, {digits}) as {name} from y group by 1")(run)


for _name, (_sql, _digits) in POINTWISE.items():
    _pointwise(_name, _sql, _digits)

ENERGY = """b as (select interval_idx, p as v, 1 as s from y union all select interval_idx, q, -1 from y),
c as (select interval_idx, lead(v) over w - v as gap, sum(s) over (w rows between unbounded preceding and current row) as ahead from b window w as (partition by interval_idx order by v, s)),
en as (select interval_idx, round(sqrt(2) * sqrt(sum(ahead * ahead * coalesce(gap, 0)) / ((count(*) / 2.0) * (count(*) / 2.0))), 7) as energy from c group by 1)"""


@query(f"with {GRIDDED}, {ENERGY} select interval_idx, energy from en")
def energy_daily(spark, sf_dir):
    days = forecasts(spark, sf_dir)
    return distances.energy(days, distances.spanning(days)).withColumn("energy", F.round("energy", 7))


PHI = "(1 - ((((1.061405429::double * t - 1.453152027::double) * t + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-x * x))"


@query(f"""with {DAYS}, z as (select interval_idx, (aggregated - mean) / nullif(std_dev, 0) as z from fc), e as (select *, abs(z) / sqrt(2) as x, 1 / (1 + 0.3275911::double * (abs(z) / sqrt(2))) as t from z)
select interval_idx, round(greatest(0.5 * (1 + {PHI}), 1 - 0.5 * (1 + {PHI})), 6) as ks from e""")
def ks_daily(spark, sf_dir):
    return distances.ks_error(forecasts(spark, sf_dir)).withColumn("ks", F.round("ks", 6))


@query(
    f"""with {GRIDDED}, {ENERGY}, pw as (select interval_idx, {", ".join(f"round({e}, {d}) as {n}" for n, (e, d) in POINTWISE.items())} from y group by 1),
z as (select interval_idx, interval, (aggregated - mean) / nullif(std_dev, 0) as z from fc), e as (select *, abs(z) / sqrt(2) as x, 1 / (1 + 0.3275911::double * (abs(z) / sqrt(2))) as t from z),
zk as (select interval_idx, interval, round(z, 6) as z, round(greatest(0.5 * (1 + {PHI}), 1 - 0.5 * (1 + {PHI})), 6) as ks from e),
a as (select interval_idx, round(avg((truth = prediction)::int), 9) as accuracy from i group by 1)
select * from pw join en using (interval_idx) join zk using (interval_idx) left join a using (interval_idx)"""
)
def ts_metrics(spark, sf_dir):
    """Every metric and the accuracy of each interval in one frame."""
    days = distances.metrics(forecasts(spark, sf_dir))
    digits = {**{n: d for n, (_, d) in POINTWISE.items()}, "energy": 7, "z": 6, "ks": 6}
    days = days.withColumns({n: F.round(n, d) for n, d in digits.items()})
    rows = buckets.indexed(predictions(spark, sf_dir), "ts", "day")
    right = classify.confusion(rows, "truth", "prediction", "interval_idx").select("interval_idx", F.round("accuracy", 9).alias("accuracy"))
    return days.join(right, "interval_idx", "left")


HOURS = f"""{PRED}, k as (select event_type, (epoch_us(ts) - min(epoch_us(ts)) over ()) // 3600000000 as interval_idx, value from events),
s as (select event_type, interval_idx, sum((value > 35)::int)::double as aggregated from k group by 1, 2),
g as (select event_type, unnest(generate_series(0, (select max(interval_idx) from s))) as interval_idx from (select distinct event_type from s)),
x as (select event_type, interval_idx, coalesce(aggregated, 0) as x from g left join s using (event_type, interval_idx))"""
#: Two regressions on two terms each, in closed form.
ARIMA = f"""{HOURS}, y as (select *, x - lag(x) over (partition by event_type order by interval_idx) as y from x),
l as (select *, lag(y) over w as y1, lag(y, 2) over w as y2 from y window w as (partition by event_type order by interval_idx)),
f as (select event_type, avg(y) as my, avg(y1) as m1, avg(y2) as m2, var_pop(y1) as v1, var_pop(y2) as v2, covar_pop(y1, y2) as v12, covar_pop(y1, y) as c1, covar_pop(y2, y) as c2 from l where y2 is not null group by 1),
fb as (select *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) as b1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) as b2 from f),
e as (select l.event_type, interval_idx, x, y, y1, y - (my - b1 * m1 - b2 * m2) - b1 * y1 - b2 * y2 as e from l join fb using (event_type) where y2 is not null),
m as (select *, lag(e) over (partition by event_type order by interval_idx) as e1 from e),
h as (select event_type, avg(y) as my, avg(y1) as m1, avg(e1) as m2, var_pop(y1) as v1, var_pop(e1) as v2, covar_pop(y1, e1) as v12, covar_pop(y1, y) as c1, covar_pop(e1, y) as c2, count(*) as n from m where e1 is not null group by 1),
hb as (select *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) as ar, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) as ma from h),
hc as (select event_type, n, ar, ma, my - ar * m1 - ma * m2 as constant from hb),
o as (select m.event_type, interval_idx, x, constant + ar * y1 + ma * e1 + x - y as mean, y - constant - ar * y1 - ma * e1 as wrong from m join hc using (event_type) where e1 is not null),
sg as (select event_type, sqrt(avg(wrong * wrong)) as sigma from o group by 1)"""


def arima(spark: SparkSession, sf_dir: str) -> forecast.Fitted:
    """A model of each event type's hourly series."""
    rows = table(spark, sf_dir, "events").withColumn("over", classify.binarize(F.col("value"), THRESHOLD))
    return forecast.fit(buckets.by_key(rows, "ts", "over", "hour", START, "event_type"), 1, 1, 1, ["event_type"], long=2)


@query(f"with {ARIMA} select event_type, n, round(constant, 6) + 0.0 as constant, round(ar, 6) + 0.0 as ar, round(ma, 6) + 0.0 as ma, round(sigma, 6) as sigma from hc join sg using (event_type)")
def arima_models(spark, sf_dir):
    rows = arima(spark, sf_dir).coefficients
    return rows.select("event_type", "n", *((F.round(c, 6) + F.lit(0.0)).alias(a) for c, a in ((F.col("constant"), "constant"), (F.col("ar")[0], "ar"), (F.col("ma")[0], "ma"), (F.col("sigma"), "sigma"))))


@query(f"with {ARIMA} select event_type, interval_idx, 1704067200 + interval_idx * 3600 as interval, x as aggregated, round(mean, 5) + 0.0 as mean, round(wrong / (0.994457883209753::double * sigma), 5) + 0.0 as z from o join sg using (event_type)")
def arima_ztest(spark, sf_dir):
    """Hours against the forecasts of fitted models."""
    rows = forecast.one_step(arima(spark, sf_dir))
    return rows.select("event_type", "interval_idx", "interval", "aggregated", (F.round("mean", 5) + F.lit(0.0)).alias("mean"), (F.round(distances.z_of(), 5) + F.lit(0.0)).alias("z"))


# confidence


def probabilities() -> Column:
    """Ten class probabilities: the softmax of ten sums of an embedding's components, by their place modulo ten."""
    own = lambda e: lambda k: F.when(k < F.size(e), F.aggregate(F.sequence(k, F.size(e) - 1, F.lit(10)), F.lit(0.0), lambda a, i: a + F.get(e, i))).otherwise(0.0)
    return classify.softmax(math.let(F.col("embedding").cast("array<double>"), lambda e: F.transform(F.sequence(F.lit(0), F.lit(9)), own(e))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, prediction, probs, score) of embeddings."""
    rows = table(spark, sf_dir, "embeddings").withColumn("probs", probabilities())
    return rows.select("vec_id", "label", classify.arg_max(F.col("probs")).alias("prediction"), "probs", confidence.entropy_score(F.col("probs")).alias("score"))


PROBS = """e as (select vec_id, label, list_transform(generate_series(0, 9), lambda k: exp(list_sum(list_transform(generate_series(k + 1, len(embedding), 10), lambda i: embedding[i]::double)))) as e from embeddings),
b as (select vec_id, label, list_transform(e, lambda x: x / list_sum(e)) as probs from e),
s as (select vec_id, label, list_position(probs, list_max(probs)) - 1 as prediction, probs, list_sum(list_transform(probs, lambda x: x * ln(x + 1e-20))) as score from b)"""
THR = "t as (select coalesce((select score from (select score, row_number() over (order by score) as r from s where score <> 0) where r = (select count(*) from s where score <> 0 and label <> prediction)), 0) as thr)"


@query(f"with {PROBS} select vec_id, round(score, 9) as score from s")
def emb_entropy(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", F.round("score", 9).alias("score"))


@query(f"with {PROBS} select vec_id, prediction::bigint as prediction, round(list_max(probs), 9) as confidence from s")
def emb_max_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "prediction", F.round(confidence.max_confidence(F.col("probs")), 9).alias("confidence"))


@query("with t as (select vec_id, list_sort(list_transform(embedding, lambda x: abs(x::double)), 'DESC')[1:5] as v from embeddings) select vec_id, unnest([1, 2, 3, 4, 5]) as place, round(unnest(v), 6) as confidence from t")
def emb_top_confidences(spark, sf_dir):
    size = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x))
    half = lambda k: F.to_json(F.filter(size, lambda x, i: i % 2 == k))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", confidence.top_confidences(half(0), half(1), 5).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("place"), F.round("x", 6).alias("confidence"))


@query(f"with {PROBS}, {THR} select round(thr, 9) as threshold from t")
def atc_threshold(spark, sf_dir):
    return confidence.threshold(scored(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold"))


@query(f"with {PROBS}, {THR} select round(avg(case when score >= thr then 100.0 else 0 end), 6) as accuracy from s, t where score <> 0")
def atc_accuracy(spark, sf_dir):
    return confidence.metric([scored(spark, sf_dir)]).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"""with {PROBS}, r as (select * from s where vec_id % 2 = 0),
t as (select coalesce((select score from (select score, row_number() over (order by score) as n from r where score <> 0) where n = (select count(*) from r where score <> 0 and label <> prediction)), 0) as thr)
select round(avg(case when score >= thr then 100.0 else 0 end), 6) as accuracy from s, t where score <> 0 and vec_id % 2 = 1""")
def atc_ref_target(spark, sf_dir):
    rows = scored(spark, sf_dir)
    sets = [rows.where(F.col("vec_id") % 2 == 0), rows.where(F.col("vec_id") % 2 == 1)]
    return confidence.metric(sets).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"""with {PROBS}, {THR} select 'atc' as name, 'overall' as key, round(avg(case when score >= thr then 100.0 else 0 end), 6) as value from s, t where score <> 0
union all select 'atc-set', 'overall', round(avg(case when score >= -2.2 then 100.0 else 0 end), 6) from s where score <> 0
union all select 'right', 'overall', round(avg((label = prediction)::int), 6) from s""")
def configured_metrics(spark, sf_dir):
    """Metrics by configuration, in one frame."""
    configs = [
        {"name": "atc", "metric_class": "atc"},
        {"name": "atc-set", "metric_class": "atc", "params": {"average_atc_threshold": -2.2}},
        {"name": "right", "metric_class": "accuracy"},
    ]
    out = models.calculate([scored(spark, sf_dir)], configs)
    return out.select("name", F.explode("results").alias("key", "value")).withColumn("value", F.round("value", 6))


@query(f"with {GRIDDED} select interval_idx::varchar as key, round({POINTWISE['kl'][0]}, 6) as value from y group by 1")
def configured_series(spark, sf_dir):
    """A time-series metric by configuration."""
    out = models.calculate([forecasts(spark, sf_dir)], [{"name": "drift", "metric_class": "kl"}])
    return out.select(F.explode("results").alias("key", "value")).withColumn("value", F.round("value", 6))


SERIES = {**{n: d for n, (_, d) in POINTWISE.items()}, "energy": 7, "z": 6, "ks": 6}


@query(
    f"""with {GRIDDED}, {ENERGY}, pw as (select interval_idx, {", ".join(f"{e} as {n}" for n, (e, _) in POINTWISE.items())} from y group by 1),
z as (select interval_idx, (aggregated - mean) / nullif(std_dev, 0) as z from fc), e as (select *, abs(z) / sqrt(2) as x, 1 / (1 + 0.3275911::double * (abs(z) / sqrt(2))) as t from z),
zk as (select interval_idx, z, greatest(0.5 * (1 + {PHI}), 1 - 0.5 * (1 + {PHI})) as ks from e), w as (select * from pw join en using (interval_idx) join zk using (interval_idx))
"""
    + " union all ".join(f"select 'daily {n}' as name, '{n}' as metric, interval_idx::varchar as key, round({n}, {d}) as value from w" for n, d in SERIES.items())
)
def configured_all_series(spark, sf_dir):
    """Every time-series metric by configuration, in one plan."""
    out = models.calculate([forecasts(spark, sf_dir)], [{"name": f"daily {n}", "metric_class": n} for n in SERIES])
    rows = out.select("name", "metric", F.explode("results").alias("key", "value"))
    rounded = F.coalesce(*(F.when(F.col("metric") == n, F.round("value", d)) for n, d in SERIES.items()))
    return rows.select("name", "metric", "key", rounded.alias("value"))


@query(f"""with {PROBS}, w as (select vec_id, avg(case when score <> 0 then case when score >= -2.2 then 100.0 else 0 end end) over o as accuracy, count(*) over o as n from s window o as (order by vec_id rows between 6 preceding and current row))
select vec_id, round(accuracy, 6) as accuracy from w where n = 7""")
def atc_window7(spark, sf_dir):
    rows = ordering.with_position(scored(spark, sf_dir).select("vec_id", "score"), "vec_id")
    rows = confidence.windowed_accuracy(rows, F.lit(-2.2), 7)
    return rows.select("vec_id", F.round("accuracy", 6).alias("accuracy"))


@query("with m as (select quantile_cont(value, 0.5) as a from events where event_type <> 'error'), q as (select quantile_cont(value, 0.95) as b from events) select event_id, (value <= a)::int as label, (value < b)::int as prediction from events, m, q")
def error_percentile_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("matched", F.col("event_type") != "error")
    rows = confidence.predictions_by_error(confidence.labels_by_error(rows, "value", "matched"), "value")
    return rows.select("event_id", "label", "prediction")


# resampling

SIZE = 100  # samples a group; there are as many draws as events, in whole groups
DRAWS = "d as (select k as pos, k // 100 as sample_group_id, k % 100 as i from (select unnest(generate_series(0, (select ceil(count(*) / 100.0)::bigint * 100 - 1 from events))) as k))"
BASE = "b as (select event_id, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 when 'error' then 4 end as bin_idx, row_number() over (partition by event_type order by event_id) - 1 as slot from events where event_type in ('view', 'click', 'purchase', 'signup', 'error'))"
DRAWN = "n as (select bin_idx, count(*) as n from b group by 1), k as (select *, row_number() over (partition by bin_idx order by pos) - 1 as k from a), r as (select pos, sample_group_id, k.bin_idx, event_id as original_id from k left join n on k.bin_idx = n.bin_idx left join b on b.bin_idx = k.bin_idx and b.slot = k.k % n.n)"
HASH = "(('0x' || substr(md5('0:' || pos), 1, 8))::bigint)"


def base_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    binned = resample.assign_bins(events, F.col("event_type"), resample.bins_table(spark, BINS))
    return resample.numbered(binned, "event_id")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.schedule(spark, table(spark, sf_dir, "events").count(), SIZE)


def drawn(spark: SparkSession, sf_dir: str, draws: DataFrame) -> DataFrame:
    return resample.draw(draws, base_bins(spark, sf_dir), "event_id")


@query(f"with {DRAWS}, {BASE}, a as (select *, sample_group_id % 5 as bin_idx from d), {DRAWN} select pos, sample_group_id, bin_idx::int as bin_idx, original_id from r")
def drift_none(spark, sf_dir):
    return drawn(spark, sf_dir, resample.policy_none(schedule(spark, sf_dir), len(BINS)))


@query(f"with {DRAWS}, {BASE}, a as (select *, (sample_group_id + case when floor(sin(i)) = 0 then 0 else 1 end) % 5 as bin_idx from d), {DRAWN} select pos, sample_group_id, bin_idx::int as bin_idx, original_id from r")
def drift_math(spark, sf_dir):
    return drawn(spark, sf_dir, resample.policy_math(schedule(spark, sf_dir), len(BINS)))


@query(f"with {DRAWS}, {BASE}, a as (select *, {HASH} % 5 as bin_idx from d), {DRAWN} select pos, sample_group_id, bin_idx::int as bin_idx, original_id from r")
def drift_random(spark, sf_dir):
    return drawn(spark, sf_dir, resample.policy_random(schedule(spark, sf_dir), len(BINS)))


PREV = {0: [10, 20, 35], 2: [5, 40]}
PREVALENCE = f"a as (select *, case when i < [10, 20, 35][sample_group_id % 3 + 1] then 0 when i < [10, 20, 35][sample_group_id % 3 + 1] + [5, 40][sample_group_id % 2 + 1] then 2 else [1, 3, 4][{HASH} % 3 + 1] end as bin_idx from d)"


def prevalence_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.policy_prevalence(schedule(spark, sf_dir), len(BINS), SIZE, PREV)


@query(f"with {DRAWS}, {BASE}, {PREVALENCE}, {DRAWN} select pos, sample_group_id, bin_idx::int as bin_idx, original_id from r")
def drift_prevalence(spark, sf_dir):
    return drawn(spark, sf_dir, prevalence_draws(spark, sf_dir))


@query(f"with {DRAWS}, {BASE}, {PREVALENCE}, {DRAWN} select sample_group_id, b.event_type, round(100.0 * count(*) / 100, 2)::double as percent from r join events b on b.event_id = r.original_id group by 1, 2")
def prevalence_check(spark, sf_dir):
    """What the drawn samples of each group are, by their own rows' type."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("original_id"), "event_type")
    return resample.prevalence(drift_prevalence(spark, sf_dir).join(events, "original_id"), "pos", SIZE, "event_type")


@query(f"with {DRAWS}, {BASE}, a as (select *, sample_group_id % 5 as bin_idx from d), {DRAWN} select substr(sha256('7:' || pos), 1, 20) as id, 1704067200 + pos * 3600 as timestamp, original_id, sample_group_id from r")
def drift_references(spark, sf_dir):
    out = resample.timestamps(drift_none(spark, sf_dir), START, 3600)
    return resample.reference_rows(out, seed=7).drop("pos")


@query(f"with {DRAWS}, {BASE}, a as (select *, sample_group_id % 5 as bin_idx from d), {DRAWN} select pos, event_id, event_type, value, 1704067200 + pos * 3600 as stamp from r join events e on e.event_id = r.original_id")
def ref_reconstruct(spark, sf_dir):
    refs = resample.reference_rows(resample.timestamps(drift_none(spark, sf_dir), START, 3600))
    base = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.lit(0).cast("long").alias("stamp"))
    return references.reconstruct(refs, base, "event_id", "stamp", order="event_id")


@query(f"with {DRAWS}, {BASE}, {PREVALENCE}, {DRAWN} select pos, sample_group_id, bin_idx::int as bin_idx, original_id from r")
def configured_drift(spark, sf_dir):
    """A drift by configuration, without its shuffles."""
    params = {"submodule": "prevalence", "bins": BINS, "max_num_samples": table(spark, sf_dir, "events").count(), "sample_group_size": SIZE, "targets": PREV, "bin_shuffle": False, "sample_group_shuffle": False}
    return resample.apply_drift(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", "event_id", params)


@query(f"with {DRAWS}, {BASE}, a as (select *, sample_group_id % 5 as bin_idx from d), {DRAWN}, e as (select sample_group_id, r.original_id from r join events on event_id = r.original_id) select count(distinct sample_group_id) as num_groups, count(*) filter (sample_group_id = 0) as group_size from e")
def group_sizes(spark, sf_dir):
    """Groups of the references that meet a base row."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("original_id"))
    return resample.group_sizes(drift_references(spark, sf_dir).join(events, "original_id"))


@query("with o as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as slot from orders) select o_orderkey, case o_orderstatus when 'O' then 0 else 1 end as bin_idx, slot from o where o_orderstatus in ('O', 'F')")
def bin_assignment(spark, sf_dir):
    bins = resample.bins_table(spark, [("open", "O"), ("done", "F"), ("again", "O")])
    rows = resample.assign_bins(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus"), bins)
    return resample.numbered(rows, "o_orderkey").select("o_orderkey", "bin_idx", "slot")


@query("select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier")
def merge_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return references.merge(customers, suppliers)


@query("select event_id, coalesce(case when event_id % 3 = 0 then 'known' end, event_type) as event_type, case when event_id % 3 = 0 then value * 2 end as extra from events")
def existing_data(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    known = events.where(F.col("event_id") % 3 == 0).select("event_id", F.lit("known").alias("event_type"), (F.col("value") * 2).alias("extra"))
    return references.enrich(events.drop("value"), known, "event_id")


@query("select event_id, (value > 35)::int as event_type from events")
def relabelled(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return references.relabel(events, predictions(spark, sf_dir).select("event_id", "prediction"), "event_type", "event_id")


@query("select event_id, event_type, value from events where event_id between 100 and 149")
def samples_slice(spark, sf_dir):
    return samples_between(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), 100, 50, "event_id")


@query("select event_id, value from events where event_id = 7 union all select event_id, value from events where event_id = 11")
def samples_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return sample_by_id(events, Roles(id="event_id"), 7, "event_id").unionByName(sample_at(events, 11, "event_id"))


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders")
def dense_positions(spark, sf_dir):
    return ordering.with_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("select percentile_disc(0.5) within group (order by o_totalprice) as middle from orders")
def order_statistic(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"))
    return ordering.nth_smallest(rows, "v", F.ceil(F.count("v") / 2)).withColumnRenamed("value", "middle")


# experiments and alerts: a run is a day, a drift case an event type


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, metric, case_value, value)."""
    rows = table(spark, sf_dir, "events").withColumn("run", F.dayofyear("ts")).withColumn("case_value", F.length("event_type"))
    return rows.groupBy("run", F.col("event_type").alias("metric"), "case_value").agg(F.round(F.avg("value"), 6).alias("value"))


RESULTS = "e as (select dayofyear(ts) as run, event_type as metric, length(event_type)::int as case_value, round(avg(value), 6) as value from events group by 1, 2, 3)"


@query(f"with {RESULTS} select metric, max(value) as max, min(value) as min, count(*) as num from e group by 1")
def metric_stats(spark, sf_dir):
    return alerts.stats(results(spark, sf_dir))


@query(f"""with {RESULTS}, s as (select metric, max(value) as a, min(value) as b from e group by 1), l as (select metric, list_reverse(list_transform(list_filter(list_transform([0, 1, 2, 3], lambda k: a - k * ceil((a - b) / 4)), lambda v: v >= 0), lambda v: round(v, 2))) as t from s)
select metric, unnest(generate_series(1, len(t))) - 1 as ord, unnest(t) as less_than, 'level' || unnest(generate_series(1, len(t))) as alert_level from l""")
def threshold_ladder(spark, sf_dir):
    steps = alerts.stats(results(spark, sf_dir)).select("metric", F.inline(alerts.config(alerts.ladder(F.col("max"), F.col("min")))))
    return steps.select("metric", F.col("ord").cast("long").alias("ord"), "less_than", "alert_level")


@query(f"with {RESULTS}, s as (select case_value, avg(value) as m, stddev_samp(value) as d from e group by 1) select case_value, round(m - 2 * d, 6) as lower, round(m - d, 6) as upper from s")
def stddev_thresholds(spark, sf_dir):
    rows = experiments.spread(results(spark, sf_dir), "case_value", "value").withColumn("t", alerts.stddev_thresholds(F.col("mean"), F.col("sd")))
    return rows.select("case_value", F.round(F.col("t")[0], 6).alias("lower"), F.round(F.col("t")[1], 6).alias("upper"))


@query(f"with {RESULTS}, r as (select metric, rank() over (partition by metric order by run) + (count(*) over (partition by metric, run) - 1) / 2.0 as x, rank() over (partition by metric order by value) + (count(*) over (partition by metric, value) - 1) / 2.0 as y from e) select metric, round(corr(x, y), 6) as spearman from r group by 1")
def spearman_sweep(spark, sf_dir):
    return experiments.spearman(results(spark, sf_dir), "run", "value", "metric").withColumn("spearman", F.round("spearman", 6))


@query(f"with {RESULTS} select run, max(value) filter (metric = 'view') as \"view\", max(value) filter (metric = 'click') as click, max(value) filter (metric = 'error') as error from e group by 1")
def experiment_frame(spark, sf_dir):
    return experiments.frame(results(spark, sf_dir), "run", "metric", "value", ["view", "click", "error"])


RULES = [("view", 0, 0, 40.0, "critical"), ("view", 0, 1, 46.0, "warning"), ("click", 1, 0, 45.0, "critical"), ("click", 1, 1, 60.0, "notice")]


@query(f"""with {RESULTS}, c(metric, metric_ord, ord, less_than, alert_level) as (values ('view', 0, 0, 40.0, 'critical'), ('view', 0, 1, 46.0, 'warning'), ('click', 1, 0, 45.0, 'critical'), ('click', 1, 1, 60.0, 'notice')),
h as (select run, alert_level, row_number() over (partition by run order by metric_ord, ord) as r from e join c using (metric) where value < less_than)
select distinct e.run as id, coalesce(h.alert_level, 'none') as alert_level from e left join h on e.run = h.run and h.r = 1""")
def alert_cascade(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "metric string, metric_ord int, ord int, less_than double, alert_level string")
    return alerts.cascade(results(spark, sf_dir).select(F.col("run").alias("id"), "metric", "value"), rules)


@query(f"with {RESULTS} select metric, 'run-' || max(run) as params from e group by 1")
def metric_parameters(spark, sf_dir):
    found = results(spark, sf_dir).withColumn("params", F.concat(F.lit("run-"), F.col("run").cast("string")))
    return alerts.with_parameters(found.select("metric").distinct(), found)


@query("select k as n, (100 + k * 100)::double as value, lpad(k::varchar, 3, '0') || '-drift--level-' || (100 + k * 100) || '.0.json' as file_name, count(*) filter (value * 10 >= 100 + k * 100) as reached from (select unnest(generate_series(0, 4)) as k), events group by k")
def param_sweep(spark, sf_dir):
    """Each configuration of a sweep, with how many events reach its level."""
    levels = experiments.sweep(spark, "params.level", 100, 500, 100, "drift")
    events = table(spark, sf_dir, "events").select((F.col("value") * 10).alias("size"))
    return experiments.run_sweep(events, levels, (F.col("size") >= F.col("value")).cast("long")).groupBy("n", "value", "file_name").agg(F.sum("drifted").alias("reached"))


@query("with v as (select unnest([100.0, 200.0, 300.0, 400.0, 500.0]) as level) select level::double as value, round(avg(least(value, level / 5)), 6)::double as metric from events, v group by 1")
def sweep_run(spark, sf_dir):
    drift = F.least(F.col("raw"), F.col("value") / 5)
    rows = experiments.run_sweep(table(spark, sf_dir, "events").select(F.col("value").alias("raw")), experiments.sweep(spark, "level", 100, 500, 100, "drift").select("value"), drift)
    return rows.groupBy("value").agg(F.round(F.avg("drifted"), 6).alias("metric"))


# geography and pictures

GEO = "g as (select event_id, (event_id * 37) % 160 - 80.0::double as lat, (event_id * 53) % 360 - 180.0::double as long, (event_id % 18 + 1)::int as z from events), "
GEO += "s as (select *, 256 * (1::bigint << z) as size, sin(radians(least(greatest(lat, -85.05112878::double), 85.05112878::double))) as sn from g), "
GEO += "p as (select event_id, lat, long, z, size, floor(least(greatest((long + 180) / 360 * size + 0.5, 0), size - 1))::bigint as px, floor(least(greatest((0.5 - ln((1 + sn) / (1 - sn)) / (4 * pi())) * size + 0.5, 0), size - 1))::bigint as py from s), t as (select *, px // 256 as tx, py // 256 as ty from p)"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.pmod(F.col("event_id") * 37, F.lit(160)) - 80.0).alias("lat"), (F.pmod(F.col("event_id") * 53, F.lit(360)) - 180.0).alias("long"), (F.col("event_id") % 18 + 1).cast("int").alias("z"))
    px, py = geo.pixel_xy(F.col("lat"), F.col("long"), F.col("z"))
    rows = rows.withColumn("px", px).withColumn("py", py)
    tx, ty = geo.tile_xy(F.col("px"), F.col("py"))
    return rows.withColumn("tx", tx).withColumn("ty", ty)


@query(f"with {GEO} select event_id, px, py, tx, ty from t")
def tile_xy(spark, sf_dir):
    return located(spark, sf_dir).select("event_id", "px", "py", "tx", "ty")


@query(f"with {GEO} select event_id, array_to_string(list_transform(generate_series(z, 1, -1), lambda i: ((tx >> (i - 1)) & 1) + 2 * ((ty >> (i - 1)) & 1)), '') as quad_key from t")
def tile_quadkey(spark, sf_dir):
    return located(spark, sf_dir).select("event_id", geo.quad_key(F.col("tx"), F.col("ty"), F.col("z")).alias("quad_key"))


@query(f"""with {GEO}, c as (select event_id, size::double as n, least(tx * 256, size - 1)::double as x0, least(ty * 256, size - 1)::double as y0, least((tx + 1) * 256, size - 1)::double as x1, least((ty + 1) * 256, size - 1)::double as y1 from t)
select event_id, round(90 - 360 * atan(exp(-(0.5 - y0 / n) * 2 * pi())) / pi(), 7) as top, round(360 * (x0 / n - 0.5), 7) as "left", round(90 - 360 * atan(exp(-(0.5 - y1 / n) * 2 * pi())) / pi(), 7) as bottom, round(360 * (x1 / n - 0.5), 7) as "right" from c""")
def tile_bounds(spark, sf_dir):
    rows = located(spark, sf_dir)
    top, left = geo.tile_corner(F.col("tx"), F.col("ty"), F.col("z"))
    bottom, right = geo.tile_corner(F.col("tx"), F.col("ty"), F.col("z"), 1, 1)
    return rows.select("event_id", *(F.round(c, 7).alias(n) for c, n in ((top, "top"), (left, "left"), (bottom, "bottom"), (right, "right"))))


@query(f"with {GEO} select event_id, round(cos(radians(lat)) * (2 * pi() * 6378137) / size, 4) as resolution, round(cos(radians(lat)) * (2 * pi() * 6378137) / size * 96 / 0.0254::double, 2) as scale from s")
def map_resolution(spark, sf_dir):
    rows = located(spark, sf_dir)
    return rows.select("event_id", F.round(geo.ground_resolution(F.col("lat"), F.col("z")), 4).alias("resolution"), F.round(geo.map_scale(F.col("lat"), F.col("z"), 96), 2).alias("scale"))


@query(f"with {GEO} select event_id, 'https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/' || z || '/' || ty || '/' || tx as arcgis, 'https://mt1.google.com/vt/lyrs=s&x=' || tx || '&y=' || ty || '&z=' || z as google, 'http://ecn.t1.tiles.virtualearth.net/tiles/a' || array_to_string(list_transform(generate_series(z, 1, -1), lambda i: ((tx >> (i - 1)) & 1) + 2 * ((ty >> (i - 1)) & 1)), '') || '.png?g=441&mkt=en-us&n=z' as bing from t")
def tile_urls(spark, sf_dir):
    return located(spark, sf_dir).select("event_id", *(geo.tile_url(p, F.col("tx"), F.col("ty"), F.col("z")).alias(p) for p in ("arcgis", "google", "bing")))


@query(f"with {GEO}, o as (select unnest([-1, 0, 1]) as d) select event_id, tx + a.d as tx, ty + b.d as ty from t, o a, o b")
def tile_neighbours(spark, sf_dir):
    return geo.neighbours(located(spark, sf_dir).select("event_id", "tx", "ty"))


@query("with g as (select event_id, (event_id * 37) % 160 - 80 + (event_id % 97) / 97.0::double as lat from events), w as (select event_id, lat, round(abs(lat) * 360000)::bigint as w from g) select event_id, w // 360000 as degrees, w // 6000 % 60 as minutes, w % 6000 as centiseconds, case when lat < 0 then 'S' else 'N' end as ref, round(case when lat < 0 then -1 else 1 end * (w / 360000.0::double), 8) as back from w")
def dms_roundtrip(spark, sf_dir):
    lat = F.pmod(F.col("event_id") * 37, F.lit(160)) - 80 + F.pmod("event_id", F.lit(97)) / 97.0
    rows = table(spark, sf_dir, "events").select("event_id", geo.degrees_minutes_seconds(lat, True).alias("d"))
    return rows.select("event_id", "d.*", F.round(geo.decimal_degrees(F.col("d")), 8).alias("back"))


@query("select event_id, round(0.5 * (event_id % 100) + 0.25 * (event_id % 7) + 10, 6)::double as x, round(-0.125 * (event_id % 100) + 2 * (event_id % 7) - 3, 6)::double as y from events")
def affine_pixels(spark, sf_dir):
    x, y = geo.affine(F.col("event_id") % 100, F.col("event_id") % 7, (0.5, 0.25, 10.0, -0.125, 2.0, -3.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


PIXELS = "x as (select vec_id, list_transform(embedding, lambda v: least(greatest(round((v::double + 1) * 127.5), 0), 255)) as px from embeddings)"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, px: 64 pixels) of embeddings."""
    level = lambda v: F.least(F.greatest(F.round((v + 1) * 127.5), F.lit(0.0)), F.lit(255.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), level).alias("px"))


@query(f"""with {PIXELS}, c as (select unnest(generate_series(0, 5)) as i), g as (select (i // 3)::int as row, (i % 3)::int as col, i % 3 * 3 as x, i // 3 * 4 as y, least(3, 8 - i % 3 * 3) as w, least(4, 8 - i // 3 * 4) as h from c)
select vec_id, row, col, w::int as w, h::int as h, round(list_sum(list_transform(generate_series(0, w * h - 1), lambda j: px[(y + j // w) * 8 + x + j % w + 1])), 6) as total from x, g""")
def grid_split(spark, sf_dir):
    """The parts of every picture of 8 x 8 pixels, with the sum of each part's pixels."""
    rows = pictures(spark, sf_dir).select("vec_id", "px", F.explode(pixels.split_grid(8, 8, 3, 4)).alias("part"))
    inside = pixels.cut(F.col("px"), 8, F.col("part"))
    return rows.select("vec_id", "part.row", "part.col", "part.w", "part.h", F.round(F.aggregate(inside, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"""with {GEO}, c as (select unnest(generate_series(0, 5)) as i), r as (select i, i % 3 * 1000 as x, i // 3 * 1000 as y, least(1000, 2300 - i % 3 * 1000) as w, least(1000, 1400 - i // 3 * 1000) as h from c),
q as (select event_id, i, size, unnest([0, 1, 2]) as k, px + x + unnest([0, w // 2, w]) as ax, py + y + unnest([0, h // 2, h]) as ay from t, r),
v as (select event_id, i, k, 90 - 360 * atan(exp(-(0.5 - least(ay, size - 1) / size::double) * 2 * pi())) / pi() as lat, 360 * (least(ax, size - 1) / size::double - 0.5) as long from q)
select event_id, (i // 3)::int as row, (i % 3)::int as col, round(max(lat) filter (k = 1), 7) as center_lat, round(max(long) filter (k = 1), 7) as center_long, round(max(lat) filter (k = 0), 7) as top_left_lat, round(max(long) filter (k = 0), 7) as top_left_long, round(max(lat) filter (k = 2), 7) as bottom_right_lat, round(max(long) filter (k = 2), 7) as bottom_right_long from v group by event_id, i""")
def part_corners(spark, sf_dir):
    rows = located(spark, sf_dir).withColumn("part", F.explode(pixels.split_grid(2300, 1400, 1000)))
    corners = geo.part_corners(F.col("lat"), F.col("long"), F.col("z"), F.col("part"))
    return rows.select("event_id", "part.row", "part.col", *(F.round(c, 7).alias(n) for n, c in corners.items()))


def _whole(rows: DataFrame, digits: int = 6, *keys: str) -> DataFrame:
    """A row a pixel."""
    return rows.select("vec_id", *keys, F.posexplode("px").alias("i", "pixel")).withColumn("pixel", F.round(F.col("pixel").cast("double"), digits))


EACH = "unnest(generate_series(0, 63))::int as i, round(unnest(px)::double, 6) as pixel"


@query(f"with {PIXELS}, y as (select vec_id, list_transform(px, lambda v: least(greatest(255 * 0.8::double * 0.4::double + v * (1 - 0.4::double), 0), 255)) as px from x) select vec_id, {EACH} from y")
def fog_blend(spark, sf_dir):
    return _whole(pictures(spark, sf_dir).withColumn("px", pixels.fog(F.col("px"), 0.8, 0.4)))


@query(f"with {PIXELS}, y as (select vec_id, list_transform(generate_series(1, 64), lambda i: least(greatest(255 * 0.3::double * 0.5::double + px[i] * 0.5::double + (px[65 - i] / 127.5::double - 1) * (255 * 0.2::double), 0), 255)) as px from x) select vec_id, {EACH} from y")
def fog_noise(spark, sf_dir):
    noise = F.transform(F.reverse("px"), lambda v: v / 127.5 - 1)
    return _whole(pictures(spark, sf_dir).withColumn("px", pixels.fog(F.col("px"), 0.3, 0.5, noise, 0.2)))


@query(f"with {PIXELS}, y as (select vec_id, list_transform(px, lambda v: 255 * 0.3::double * 0.5::double + v * 0.5::double) as px from x) select vec_id, {EACH} from y")
def configured_picture_drift(spark, sf_dir):
    """An image drift by name, with default parameters."""
    return _whole(pictures(spark, sf_dir).withColumn("px", pixels.drift("fog", F.col("px"), 0, 8, 8)))


@query(f"""with {PIXELS}, y as (select vec_id, list_transform(generate_series(1, 64), lambda i: case when (i - 20 - 10) / 20.0::double < 0 then 90 when (i - 20 - 10) / 20.0::double > 1 then px[i] else floor(90 + (i - 20 - 10) / 20.0::double * (px[i] - 90)) end) as px from x)
select vec_id, {EACH} from y""")
def flood_blend(spark, sf_dir):
    rows = pictures(spark, sf_dir)
    heights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return _whole(rows.withColumn("px", pixels.flood(F.array_repeat(F.lit(90.0), 64), F.col("px"), heights, 20, 10)))


# 3.912 / visibility is the rate a metre; the ray rises 98.2 m from the camera at 1.8 m, over 100 m
@query(f"""with {PIXELS}, c as (select unnest([0, 1, 2]) as channel, unnest([225, 225, 201]) as air),
y as (select vec_id, channel, list_transform(generate_series(1, 64), lambda i: px[i] * exp(-(3.912::double / 450 * ((34 - 1.8::double) * 100 / 98.2::double) + 3.912::double / 450 * px[65 - i] / 255 * (36.0::double * 100 / 98.2::double)))
  + (1 - exp(-(3.912::double / 450 * ((34 - 1.8::double) * 100 / 98.2::double) + 3.912::double / 450 * px[65 - i] / 255 * (36.0::double * 100 / 98.2::double)))) * air) as px from x, c)
select vec_id, channel, {EACH} from y""")
def haze_layers(spark, sf_dir):
    """Three channels of the default scene, with a noise array: the picture's own pixels in reverse."""
    rows, noise = pictures(spark, sf_dir), F.reverse("px")
    made = F.array(*(F.struct(F.lit(c).alias("channel"), pixels.haze(F.col("px"), c, perlin=noise).alias("px")) for c in range(3)))
    return _whole(rows.select("vec_id", F.inline(made)), 6, "channel")


@query(f"""with {PIXELS}, l as (select 'haze only' as layout, 3.912::double / 450 * (32.2::double * 100 / 98.2::double) + 3.912::double / 12 * (66.0::double * 100 / 98.2::double) as a
  union all select 'fog below haze', 3.912::double / 450 * (30.0::double * 100 / 98.2::double) + 3.912::double / 12 * (18.2::double * 100 / 98.2::double)
  union all select 'point in the fog', 3.912::double / 450 * (32.2::double * 50 / 48.2::double) + (3.912::double / 12 * (1 - 50 / 70.00001::double) + 3.912::double / 450 * (50 / 70.00001::double)) * (16.0::double * 50 / 48.2::double)),
y as (select vec_id, layout, list_transform(px, lambda v: v * exp(-a) + (1 - exp(-a)) * 201) as px from x, l) select vec_id, layout, {EACH} from y""")
def haze_layouts(spark, sf_dir):
    """Scenes without fog, with the fog below the haze, and of a point inside the fog."""
    px = F.col("px")
    scenes = {
        "haze only": pixels.haze(px, 2, fog_top=0.0),
        "fog below haze": pixels.haze(px, 2, fog_top=20.0, haze_top=50.0),
        "point in the fog": pixels.haze(px, 2, elevation=50.0, distance=50.0),
    }
    made = F.array(*(F.struct(F.lit(n).alias("layout"), c.alias("px")) for n, c in scenes.items()))
    return _whole(pictures(spark, sf_dir).select("vec_id", F.inline(made)), 6, "layout")


@query(f"""with {PIXELS}, i as (select unnest(generate_series(0, 63)) as i), d as (select unnest([-1, 0, 1]) as d),
n as (select i, abs(i // 8 + a.d) as r, abs(i % 8 + b.d) as c, case when a.d = 0 and b.d = 0 then 1.0 else 0.5 end / 5.0::double as w from i, d a, d b),
m as (select i, case when r > 7 then 14 - r else r end * 8 + case when c > 7 then 14 - c else c end + 1 as place, w from n)
select vec_id, i::int as i, round(sum(px[place] * w), 6) as pixel from x, m group by vec_id, i""")
def fog_blur(spark, sf_dir):
    return _whole(pictures(spark, sf_dir).withColumn("px", pixels.blur(F.col("px"), 8, 8, 2, 0.5)))


@query(f"""with {PIXELS}, i as (select unnest(generate_series(0, 63)) as i)
select vec_id, i, px[(i // 8 // 4 * 2 + i % 8 // 4) * 16 + i // 8 % 4 * 4 + i % 4 + 1]::double as pixel from x, i""")
def tile_mosaic(spark, sf_dir):
    """Four tiles of 4 x 4 pixels as one picture of 8 x 8."""
    tiles = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("px", k * 16 + 1, 16))
    rows = pictures(spark, sf_dir).select("vec_id", F.posexplode(pixels.mosaic(tiles, 2, 4, 4)).alias("i", "pixel"))
    return rows


SITES = """m as (select s_suppkey as map_id, (s_suppkey * 37) % 160 - 80.0::double as lat, (s_suppkey * 53) % 360 - 180.0::double as long, (s_suppkey % 12 + 6)::int as z from supplier),
ms as (select *, 256 * (1::bigint << z) as size, sin(radians(least(greatest(lat, -85.05112878::double), 85.05112878::double))) as sn from m),
mp as (select map_id, z, size, floor(least(greatest((long + 180) / 360 * size + 0.5, 0), size - 1))::bigint // 256 - 1 as x0, floor(least(greatest((0.5 - ln((1 + sn) / (1 - sn)) / (4 * pi())) * size + 0.5, 0), size - 1))::bigint // 256 - 1 as y0 from ms)"""


@query(f"""with {PIXELS}, {SITES}, n as (select count(*) as n from embeddings), w as (select *, row_number() over (order by vec_id) - 1 as k from x),
g as (select unnest(generate_series(0, 23)) as v), h as (select a.v as gx, b.v as gy, a.v // 10 as col, b.v // 10 as row, (b.v % 10) * least(10, 24 - a.v // 10 * 10) + a.v % 10 as i from g a, g b),
e as (select map_id, z, size, x0, y0, row, col, sum((i + 1) * px[(gy % 8) * 8 + gx % 8 + 1]) as checksum, count(*) as pixels from mp, h, n, w where w.k = ((x0 + gx // 8) * 31 + (y0 + gy // 8) * 17 + z) % n.n group by all),
q as (select *, least(greatest(floor(x0 * 256 + 0.5), 0), size - 1)::bigint + col * 320 as ax, least(greatest(floor(y0 * 256 + 0.5), 0), size - 1)::bigint + row * 320 as ay, least(10, 24 - col * 10) * 32 as pw, least(10, 24 - row * 10) * 32 as ph from e)
select map_id, row, col, round(checksum, 3) as checksum, pixels, round(90 - 360 * atan(exp(-(0.5 - least(ay, size - 1) / size::double) * 2 * pi())) / pi(), 6) as top_left_lat, round(360 * (least(ax, size - 1) / size::double - 0.5), 6) as top_left_long,
round(90 - 360 * atan(exp(-(0.5 - least(ay + ph, size - 1) / size::double) * 2 * pi())) / pi(), 6) as bottom_right_lat, round(360 * (least(ax + pw, size - 1) / size::double - 0.5), 6) as bottom_right_long from q""")
def maps_from_tiles(spark, sf_dir):
    """A map of 3 x 3 tiles around each supplier's place, in parts of 10 x 10 pixels with corners; tiles are pictures."""
    key = F.col("s_suppkey")
    maps = table(spark, sf_dir, "supplier").select(key.alias("map_id"), (F.pmod(key * 37, F.lit(160)) - 80.0).alias("lat"), (F.pmod(key * 53, F.lit(360)) - 180.0).alias("long"), (key % 12 + 6).cast("int").alias("z"), F.lit(1).alias("radius"))
    px, py = geo.pixel_xy(F.col("lat"), F.col("long"), F.col("z"))
    tx, ty = geo.tile_xy(px, py)
    wanted = geo.neighbours(maps.select("z", tx.alias("tx"), ty.alias("ty"))).distinct()
    shown = ordering.with_position(pictures(spark, sf_dir), "vec_id", "k").select("k", "px")
    n = table(spark, sf_dir, "embeddings").count()
    tiles = wanted.withColumn("k", F.pmod(F.col("tx") * 31 + F.col("ty") * 17 + F.col("z"), F.lit(n))).join(shown, "k").drop("k")
    parts = geo.maps_from_tiles(maps, tiles, 10, 8)
    checksum = F.aggregate(F.transform("px", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    corners = [F.round(c, 6).alias(c) for c in ("top_left_lat", "top_left_long", "bottom_right_lat", "bottom_right_long")]
    return parts.select("map_id", "row", "col", F.round(checksum, 3).alias("checksum"), F.size("px").cast("long").alias("pixels"), *corners)


@query("select vec_id, 'img-' || vec_id || '-v' || (vec_id % 10) || '-drifted.png' as name from embeddings")
def drifted_names(spark, sf_dir):
    stem = F.concat(F.lit("v"), (F.col("vec_id") % 10).cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", pixels.drifted_name(F.col("vec_id"), stem).alias("name"))


@query("select vec_id, unnest(generate_series(0, 31))::int as i, round(unnest(list_transform(generate_series(1, 32), lambda i: (embedding[i]::double + embedding[i + 32]::double) / 2)), 6) as pixel from embeddings")
def band_average(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pixels.average_band(F.slice(e, 1, 32), F.slice(e, 33, 32)).alias("px"))
    return _whole(rows)


@query("select page_id as id, url as image_path, 'web' as kind from pages where regexp_matches(url, '(?i)\\.(html)$')")
def image_scan(spark, sf_dir):
    rows = datasets.image_paths(table(spark, sf_dir, "pages").select("page_id", "url"), [".HTML"], {"kind": "web"}, "url", id_col="page_id")
    return rows.select("id", "image_path", "kind")


@query("""with k as (select page_id, url, array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(length(ltrim(p, '0'))::varchar, 10, '0') || ltrim(p, '0') else p end), '') as key from pages)
select page_id, url, row_number() over (order by key, page_id) as place from k""")
def natural_order(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select("page_id", "url", datasets.natural_key(F.col("url")).alias("key"))
    rows = ordering.ranked_in_order(names, ["key", "page_id"])
    return rows.select("page_id", "url", (F.col("rank") + 1).alias("place"))


@query("select event_id, coalesce(try_cast(case when event_id % 4 = 0 then 'na' else cast(event_id % 90 as varchar) end as double), 0) as angle from events")
def mixed_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "na").otherwise((F.col("event_id") % 90).cast("string")).alias("angle"))
    return rows.select("event_id", datasets.number_or_zero("angle").alias("angle"))


# models

FOLD = "(('0x' || substr(md5('42:' || doc_id), 1, 8))::bigint)"


@query(f"select ({FOLD} % 5)::int as fold, count(*) as n, sum(quality)::bigint as good from labels group by 1")
def kfold_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(models.fold("doc_id").alias("fold")).agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query(f"select case when {FOLD} % 10000 < 2000 then 'validation' else 'train' end as part, count(*) as n from labels group by 1")
def train_split(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(models.split("doc_id", 20).alias("part")).agg(F.count("*").alias("n"))


@query()
def logistic_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("truth", F.col("event_type").isin("purchase", "signup").cast("int"))
    rows = rows.withColumn("part", models.split("event_id", 20))
    model = models.train_logistic(rows.where("part = 'train'"), ["value", "user_id"], "truth")
    return model.transform(rows.where("part = 'validation'")).select("event_id", "truth", F.col("prediction").cast("int").alias("prediction"))


@query()
def stream_monitor(spark, sf_dir):
    """Scores of embeddings as a stream of ten keys, in order of their event time: accuracy over the latest seven and alert levels."""
    place = f"{sf_dir}/embeddings.parquet"
    # a pattern, as the source takes a folder or a pattern but no single file
    stream = spark.readStream.schema(spark.read.parquet(place).schema).parquet(place.replace(".parquet", "[.]parquet"))
    scores = stream.select((F.col("vec_id") % 10).alias("key"), F.col("vec_id").alias("pos"), confidence.entropy_score(probabilities()).alias("score"), F.timestamp_seconds(F.col("vec_id") + START).alias("at_time"))
    return monitor.run_to_end(monitor.monitor(scores, -2.2, 7, [(30.0, "critical"), (60.0, "warning")], "at_time"), "monitor")


@query()
def stream_series(spark, sf_dir):
    """Hourly sums of each event type as a stream: dense up to the last whole hour."""
    place = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(place).schema).parquet(place.replace(".parquet", "[.]parquet"))
    rows = stream.select("event_type", F.col("ts").cast("timestamp").alias("at_time"), classify.binarize(F.col("value"), THRESHOLD).alias("over"))
    out = monitor.dense(rows, "event_type", "at_time", "over", START, buckets.UNITS["hour"], "0 seconds")
    return monitor.run_to_end(out, "series").withColumnRenamed("key", "event_type")


@query("select event_id, substr(md5('0:' || event_id), 1, 8) as digits, (('0x' || substr(md5('0:' || event_id), 1, 8))::bigint) as number from events")
def hashed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.substring(F.md5(F.concat(F.lit("0:"), F.col("event_id").cast("string"))), 1, 8).alias("digits"), math.hashed(0, F.col("event_id")).alias("number"))


from . import files  # noqa: E402, F401  adds the queries that go through files
