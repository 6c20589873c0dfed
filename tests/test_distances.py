"""Distances whose grid must hold the densities, whatever the size of the daily sums."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.operators import distances
from tidewatch.plans.queries import ORACLES, QUERIES, ts_metrics

LARGE = "/root/testdata/sf0.1"
WHOLE = ["kl_daily", "hellinger_daily", "tvd_daily", "wasserstein_daily", "energy_daily"]


@pytest.fixture(scope="module")
def large_duck():
    import duckdb

    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    db.execute(f"create view events as select * from read_parquet('{LARGE}/events.parquet')")
    return db


@pytest.mark.parametrize("name", WHOLE)
def test_large_sums_keep_their_drift(name, spark, large_duck):
    got = {r[0]: r[1] for r in QUERIES[name](spark, LARGE).collect()}
    assert got == pytest.approx(dict(large_duck.execute(ORACLES[name]).fetchall()), abs=2e-6)
    assert max(got.values()) > 0


def test_metrics_of_large_sums(spark):
    rows = ts_metrics(spark, LARGE).collect()
    assert len(rows) == 23 and max(r.kl for r in rows) > 0.1 and max(r.hellinger for r in rows) > 0.1


def test_grid_holds_both_densities(spark):
    """Means far apart, negative and large, against sums and the closed form."""
    days = [(7, 50_000.0, 49_000.0, 90.0), (8, 49_500.0, 50_200.0, 30.0), (9, -300.0, -250.0, 60.0)]
    df = spark.createDataFrame(days, "interval_idx long, aggregated double, mean double, std_dev double")
    sums = distances.spanning_grid(df).groupBy("interval_idx").agg({"p": "sum", "q": "sum"}).collect()
    assert all(abs(r[k] - 1) < 1e-6 for r in sums for k in ("sum(p)", "sum(q)"))
    near = spark.createDataFrame([(k, 1000.0 + k, 1010.0, 40.0) for k in range(5)], SERIES)
    out = distances.pointwise(near, distances.spanning(near)).collect()
    assert all(abs(r.kl - (1002 - 1010) ** 2 / (2 * 40**2) / np.log(2)) < 1e-6 for r in out)


def by_hand(rows, start, low, high, step):
    """Every distance from all grid points."""
    x = start + np.arange(low, high + 1) * step
    m, out = np.mean([r[1] for r in rows]), {}
    for idx, _, mean, sd in rows:
        height = lambda c: np.exp(-0.5 * ((x - c) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))  # noqa: E731, B023
        p, q = height(m), height(mean)
        ratio, some, gap = 0.5 * (((x - mean) / sd) ** 2 - ((x - m) / sd) ** 2), p != 0, np.abs(p - q)
        both = np.concatenate([p, q])
        order = np.argsort(both, kind="stable")
        ahead, v = np.cumsum(np.concatenate([np.ones(len(x)), -np.ones(len(x))])[order]), both[order]
        area = np.sum(ahead[:-1] ** 2 * np.diff(v)) / len(x) ** 2
        out[idx] = (np.sum((p * ratio)[some]) / np.log(2), np.sqrt(np.sum((np.sqrt(p) - np.sqrt(q))[some] ** 2) / 2), gap.mean() / 2, gap.mean(), np.sqrt(2 * area))
    return out


SERIES = "interval_idx long, aggregated double, mean double, std_dev double"
ROWS = {
    "near": [(k, 1000.0 + 7 * k, 1010.0 + k, 40.0 + k) for k in range(5)],
    "far apart": [(0, 90_000.0, 0.0, 300.0), (1, 90_000.0, 60_000.0, 900.5)],
    "wide": [(0, 5e6, 5.01e6, 9e3), (1, 5.02e6, 4.98e6, 1.1e4)],
    "on a point": [(0, 10.0, 10.0, 3.0), (1, 10.0, 12.0, 2.0)],
    "negative": [(0, -2000.0, -2500.0, 500.0), (1, -1800.0, -1900.0, 0.4)],
}


@pytest.mark.parametrize("kind", sorted(ROWS))
def test_blocks_add_up_to_the_whole_grid(spark, kind):
    df = spark.createDataFrame(ROWS[kind], SERIES)
    for grid in (distances.spanning(df), distances.spanning(df, 0.5) if kind == "near" else distances.fixed_grid(df, -30, 4000, 1.0)):
        ends = grid.overall.first()
        want = by_hand(ROWS[kind], grid.start, ends._low, ends._high, grid.step)
        point = {r.interval_idx: (r.kl, r.hellinger, r.tvd, r.wasserstein) for r in distances.pointwise(df, grid).collect()}
        area = {r.interval_idx: r.energy for r in distances.energy(df, grid).collect()}
        for idx, values in want.items():
            assert np.allclose((*point.get(idx, (0, 0, 0, 0)), area.get(idx, 0.0)), values, rtol=1e-7, atol=1e-9), (idx, point.get(idx), area.get(idx), values)


def test_sums_of_thousands_of_millions(spark):
    """The grid has 10**9 points and more; what is exploded is around the means, in arrays of bounded size."""
    rows = [(0, 1e12, 1e12 + 2e3, 5e3), (1, 1.000001e12, 1e12, 4e3), (2, 1e12, 1e10, 1e3)]
    df = spark.createDataFrame(rows, SERIES)
    grid = distances.spanning(df)
    ends = grid.overall.first()
    assert ends._high - ends._low > 10**9
    core = distances.core_points(df, grid)
    assert core.count() < 10**6
    out = {r.interval_idx: r for r in distances.pointwise(df, grid).collect()}
    mean = sum(r[1] for r in rows) / 3
    for idx, _, m, sd in rows[:2]:
        want = ((mean - m) / sd) ** 2 / 2 / np.log(2)
        assert abs(out[idx].kl - want) < 1e-6 * max(want, 1)
    assert distances.energy(df, grid).count() == 3


def test_no_spread_has_no_distance(spark):
    df = spark.createDataFrame([(0, 0, 5.0, 5.0, 0.0), (1, 86400, 6.0, 5.0, None), (2, 2 * 86400, 6.0, 5.0, 2.0)], "interval_idx long, interval long, aggregated double, mean double, std_dev double")
    out = {r.interval_idx: r for r in distances.metrics(df).collect()}
    assert out[0].kl is None and out[1].energy is None and out[2].kl > 0 and len(out) == 3


def test_every_grid_point_is_returned(spark, sf_dir):
    rows = QUERIES["density_grid"](spark, sf_dir).collect()
    points = sorted({r.x for r in rows})
    assert points == [points[0] + k for k in range(len(points))]
    assert len(rows) == len(points) * len({r.interval_idx for r in rows}) and len(points) > 20
