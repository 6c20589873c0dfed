"""Tile arithmetic over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import pixels
from tidewatch.plans.queries import QUERIES, table


def test_every_event_has_its_neighbours(spark, sf_dir):
    out = QUERIES["tile_neighbours"](spark, sf_dir)
    found = out.groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("tx", "ty").alias("tiles")).collect()
    assert len(found) == table(spark, sf_dir, "events").count() and {(r.n, r.tiles) for r in found} == {(9, 9)}


def test_mosaic_of_unequal_sides(spark):
    """Two rows of three tiles, each 2 wide and 1 high."""
    df = spark.createDataFrame([([[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 12]],), ([[1, 2], [3, 4], [5, 6]],), ([],)], "tiles array<array<int>>")
    out = [r[0] for r in df.select(pixels.mosaic(F.col("tiles"), 3, 2, 1)).collect()]
    assert out[:2] == [list(range(1, 13)), [1, 2, 3, 4, 5, 6]] and not out[2]
    tall = spark.createDataFrame([([[1, 3], [2, 4]],)], "tiles array<array<int>>")
    assert tall.select(pixels.mosaic(F.col("tiles"), 2, 1, 2)).first()[0] == [1, 2, 3, 4]


def test_every_part_of_every_picture_is_placed(spark, sf_dir):
    assert QUERIES["part_corners"](spark, sf_dir).count() == 6 * table(spark, sf_dir, "events").count()
