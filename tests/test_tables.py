"""Ranges through bounded arrays, intermediate tables, and series of many keys."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidewatch import tables
from tidewatch.operators import buckets


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_every_number_of_a_range_once(spark, monkeypatch, levels):
    monkeypatch.setattr(tables, "FAN", 4)
    rows = [(k, a, a + n - 1) for k, (a, n) in enumerate([(0, 1), (-5, 3), (7, 4), (10, 5), (-20, 16), (3, 17), (1, 64), (5, 0), (9, -3)])]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    got = tables.each(df, F.col("a"), F.col("b"), "k", levels)
    assert sorted((r.id, r.k) for r in got.collect()) == sorted((i, k) for i, a, b in rows for k in range(a, b + 1))
    assert got.columns == ["id", "a", "b", "k"]


def test_arrays_stay_short(spark):
    """A range of many millions is exploded through arrays of 4096, so a task holds no more of it at once."""
    df = tables.each(spark.range(1), F.lit(0), F.lit(30_000_000), "k")
    assert df.agg(F.count("*"), F.min("k"), F.max("k")).first()[:] == (30_000_001, 0, 30_000_000)


def test_written_tables_are_in_the_shared_folder(spark):
    out = tables.written(spark.range(5), "five")
    assert out.count() == 5 and re.search(r"/tidewatch/[^/]+/five-[0-9a-f]+/", out.inputFiles()[0])


def test_series_of_keys_have_the_same_intervals(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("b", "2024-01-01 03:20:00", 2.0), (None, "2024-01-01 01:30:00", 4.0), ("a", "2024-01-01 00:50:00", 3.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = sorted(((r.k or "", r.interval_idx, r.interval, r.aggregated, r.num_samples) for r in buckets.by_key(df, "t", "v", "hour", 100, "k").collect()))
    want = {("a", 0): (4.0, 2), ("b", 3): (2.0, 1), ("", 1): (4.0, 1)}
    assert got == sorted((k, i, 100 + 3600 * i, *want.get((k, i), (0.0, 0))) for k in ("a", "b", "") for i in range(4))
