"""Order of whole tables by name, without a window over all rows."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordering
from tidewatch.plans.queries import QUERIES, table


def test_every_page_has_its_place(spark, sf_dir):
    rows = QUERIES["natural_order"](spark, sf_dir).collect()
    assert sorted(r.place for r in rows) == list(range(1, table(spark, sf_dir, "pages").count() + 1))


def test_one_common_name_is_dealt_over_parts(spark):
    rows = [(k, "same" if k % 3 else f"name {k:06d}") for k in range(3000)] + [(3000, None)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(5)
    got = ordering.ranked_in_order(df, ["name", "id"], part_rows=150).orderBy("rank").collect()
    assert [r.id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))] and got[0].asDict().keys() == {"id", "name", "rank"}


def test_no_rows_have_no_place(spark):
    df = spark.createDataFrame([], "id long, name string")
    assert ordering.ranked_in_order(df, ["name", "id"]).count() == 0
    assert ordering.with_position(df, "id").count() == 0


@pytest.mark.parametrize("gap", [1, 1 << 17, 1 << 40])
def test_sparse_keys(spark, monkeypatch, gap):
    """Ids with gaps give a bucket a row each; no window holds more than FAN counts."""
    monkeypatch.setattr(ordering, "FAN", 4)
    ids = [(k * k * gap - 3 * gap, "ab"[k % 2] if k % 7 else None) for k in range(200)]
    df = spark.createDataFrame(ids, "id long, part string").repartition(3)
    got = {r.id: r.pos for r in ordering.with_position(df, "id").collect()}
    assert got == {i: p for p, i in enumerate(sorted(i for i, _ in ids))}
    ranks = {r.id: r["rank"] for r in ordering.ranked(df, ["part"], F.floor(F.col("id") / ordering.WIDTH), ["id"]).collect()}
    for part in ("a", "b", None):
        own = sorted(i for i, p in ids if p == part)
        assert [ranks[i] for i in own] == list(range(len(own)))


def test_windows_of_the_tree_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FAN", 16)
    counts = spark.createDataFrame([(k * 37 % 5000, 1 + k % 3) for k in range(5000)], "_bucket long, _n long")
    rows = sorted(((r._bucket, r._n) for r in counts.collect()))
    want, total = {}, 0
    for b, n in rows:
        want[b], total = total, total + n
    assert {r._bucket: r._before for r in ordering.starts(counts, []).collect()} == want


ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 1 / 3, 2.0**-1074 * 3, 2.0**52, 2.0**53 + 2, math.nextafter(1, 0), math.nextafter(2, 0), math.nextafter(2, 3), math.nextafter(8, 0), 1e-310]


def test_keys_are_the_bits_of_doubles(spark):
    rng = np.random.default_rng(1)
    values = ODD + [float(x) for x in rng.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64)] + [math.nextafter(2.0**k, d) for k in range(-1000, 1000, 37) for d in (0, math.inf)] + [2.0**k for k in range(-1074, 1024, 13)]
    keys = [r.key for r in ordering.order_keys(spark.createDataFrame([(v,) for v in values], "v double").coalesce(1), "v").collect()]
    for v, k in zip(values, keys, strict=True):
        want = 0x7FF8 << 48 if math.isnan(v) else struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
        assert k == want, (v, k, want)
        assert math.isnan(v) or ordering.key_value(k) == v


def test_order_statistics_of_odd_values(spark):
    """NaN, both infinities, equal values and nulls."""
    values = [3.0, 1.0, math.nan, 2.0, None, math.inf, -math.inf, 1.0, 1.0, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    order = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    for n, want in enumerate(order, 1):
        assert str(ordering.nth_smallest(df, "v", n).first()[0]) == str(want)
    for n in (0, 10, -1):
        assert ordering.nth_smallest(df, "v", n).first()[0] is None
    assert ordering.nth_smallest(df, "v", F.count("v")).first()[0] != ordering.nth_smallest(df, "v", F.count("v")).first()[0]
    assert ordering.nth_smallest(df.where("v is null"), "v", 1).first()[0] is None


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(ordering, "FEW", few)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1e3, 4001), np.full(500, 7.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    shares = [0, 0.05, 0.5, 0.95, 0.999, 1]
    got = list(ordering.percentiles(df, "v", shares).first())
    assert np.allclose(got, np.quantile(values, shares), rtol=1e-15, atol=0)
    assert list(ordering.percentiles(df.limit(0), "v", [0.5]).first()) == [None]
    assert list(ordering.percentiles(df.limit(1), "v", [0.0, 0.3]).first()) == [df.first()[0]] * 2
