"""ARIMA by two regressions against plain least squares, simulated series and known weights."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.operators import forecast

SCHEMA = "kind string, interval_idx long, aggregated double"


def simulated(n, ar, ma, d=0, constant=0.0, seed=1, sigma=1.0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(0, sigma, n + 50), np.zeros(n + 50)
    for t in range(5, n + 50):
        y[t] = constant + sum(a * y[t - k] for k, a in enumerate(ar, 1)) + e[t] + sum(b * e[t - k] for k, b in enumerate(ma, 1))
    y = y[50:]
    for _ in range(d):
        y = np.cumsum(y)
    return y


def by_least_squares(x, p, d, q, long):
    y = np.diff(x, d) if d else x
    rows = range(max(long, p), len(y))
    first = np.linalg.lstsq(np.array([[1, *y[t - long : t][::-1]] for t in rows]), y[max(long, p) :], rcond=None)[0]
    e = {t: y[t] - np.array([1, *y[t - long : t][::-1]]) @ first for t in rows}
    kept = [t for t in rows if t - q in e]
    design = np.array([[1, *(y[t - k] for k in range(1, p + 1)), *(e[t - k] for k in range(1, q + 1))] for t in kept])
    found, *_ = np.linalg.lstsq(design, y[kept], rcond=None)
    fitted = design @ found
    return found, np.sqrt(np.mean((y[kept] - fitted) ** 2)), {t + d: fitted[i] + x[t + d] - y[t] for i, t in enumerate(kept)}


@pytest.mark.parametrize(("p", "d", "q", "long"), [(1, 0, 1, 2), (2, 1, 1, 5), (3, 0, 0, 1), (0, 2, 2, 4)])
def test_coefficients_and_predictions(spark, monkeypatch, p, d, q, long):
    from tidewatch.operators import ordering

    monkeypatch.setattr(ordering, "WIDTH", 64)
    series = {k: simulated(200, [0.5], [0.4], d, 3.0, seed) for seed, k in enumerate("abc")}
    series[None] = simulated(90, [0.2], [0.1], d, -1.0, 9)
    df = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)], SCHEMA).repartition(5)
    model = forecast.fit(df, p, d, q, ["kind"], long)
    found = {r.kind: r for r in model.coefficients.collect()}
    rows: dict = {}
    for r in forecast.one_step(model).collect():
        rows.setdefault(r.kind, {})[r.interval_idx] = r
    for k, x in series.items():
        want, sigma, means = by_least_squares(x, p, d, q, long)
        assert np.allclose([found[k].constant, *found[k].ar, *found[k].ma], want, rtol=1e-5, atol=1e-6)
        assert found[k].sigma == pytest.approx(sigma, rel=1e-6)
        assert {t: r.mean for t, r in rows[k].items()} == pytest.approx(means, rel=1e-5, abs=1e-5)
        assert all(r.std_dev == pytest.approx(forecast.UPPER * sigma) and r.upper == pytest.approx(r.mean + r.std_dev) for r in rows[k].values())


def test_a_long_series_gives_its_own_coefficients(spark):
    x = simulated(20000, [0.6], [0.3], 0, 2.0, 4)
    model = forecast.fit(spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], SCHEMA), 1, 0, 1, ["kind"], 12)
    r = model.coefficients.first()
    assert np.allclose([r.constant, *r.ar, *r.ma, r.sigma], [2.0, 0.6, 0.3, 1.0], atol=0.08)


def test_order_by_criterion(spark):
    rows = [(k, t, float(v)) for k, x in {"noise": simulated(3000, [], [], 0, 5.0, 2), "ar2": simulated(3000, [0.5, 0.3], [], 0, 1.0, 3)}.items() for t, v in enumerate(x)]
    found = {r.kind: r for r in forecast.fit(spark.createDataFrame(rows, SCHEMA), 3, 0, 1, ["kind"], 8, choose=True).coefficients.collect()}
    assert found["ar2"].p >= 2 and found["noise"].p + found["noise"].q <= 1


def test_psi_weights():
    assert np.allclose(forecast.psi_weights([0.5], [], 0, 4), [1, 0.5, 0.25, 0.125])
    assert np.allclose(forecast.psi_weights([], [0.4], 0, 4), [1, 0.4, 0, 0])
    assert np.allclose(forecast.psi_weights([], [], 1, 4), 1)
    assert np.allclose(forecast.psi_weights([0.5], [0.4], 0, 3), [1, 0.9, 0.45])


def test_forecasts_after_the_end(spark):
    """A pure autoregression tends to its mean, with the spread of the weights."""
    x = simulated(500, [0.7], [], 0, 3.0, 6)
    model = forecast.fit(spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], SCHEMA), 1, 0, 0, ["kind"], 3)
    r, rows = model.coefficients.first(), forecast.ahead(model, 60).orderBy("step").collect()
    mean, weight, spread = x[-1], 1.0, 0.0
    for k, row in enumerate(rows, 1):
        mean, spread, weight = r.constant + r.ar[0] * mean, spread + weight**2, weight * r.ar[0]
        assert (row.step, row.interval_idx) == (k, 499 + k) and row.mean == pytest.approx(mean) and row.std_dev == pytest.approx(forecast.UPPER * r.sigma * np.sqrt(spread))
    assert rows[-1].mean == pytest.approx(r.constant / (1 - r.ar[0]), rel=1e-3)


def test_one_series_without_keys_and_short_ones(spark):
    df = spark.createDataFrame([(None, t, float(t * t % 17)) for t in range(40)], SCHEMA).drop("kind")
    model = forecast.fit(df, 1, 1, 1)
    assert model.coefficients.count() == 1 and forecast.one_step(model).count() == 40 - 1 - 4 - 1 and forecast.ahead(model, 2).count() == 2
    short = forecast.fit(df.where("interval_idx < 5"), 1, 1, 1, long=4)
    assert forecast.one_step(short).count() == 0 and forecast.ahead(short, 2).count() == 0
    with pytest.raises(ValueError):
        forecast.fit(df, -1)
