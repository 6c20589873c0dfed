"""Datasets that refer to others: reconstruction, union, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconstruct(refs: DataFrame, base: DataFrame, id_col: str, ts: str | None = None, *, order: str) -> DataFrame:
    """base rows in the order of refs (pos, original_id, timestamp), each with its reference's timestamp. Of base rows
    that share an id the first in `order` counts; a reference to none is an error."""
    first = Window.partitionBy(id_col).orderBy(order)
    once = base.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("_found", F.lit(True))
    kept = refs.select("pos", F.col("original_id").alias("_o"), F.col("timestamp").alias("_t"))
    out = kept.join(once, F.col("_o") == F.col(id_col), "left")
    known = F.when(F.col("_found"), F.col(id_col)).otherwise(F.raise_error(F.concat(F.lit("no base row has id "), F.col("_o").cast("string"))).cast(base.schema[id_col].dataType))
    out = out.withColumn(id_col, known)
    if ts is not None:
        out = out.withColumn(ts, F.col("_t"))
    return out.drop("_o", "_t", "_found")


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both by column name; missing columns are null."""
    return first.unionByName(second, allowMissingColumns=True)


def enrich(df: DataFrame, existing: DataFrame, id_col: str, order: str | None = None) -> DataFrame:
    """df with the fields that existing rows of the same id have; df's stay where existing has none. Of existing rows that
    share an id the first in `order` counts, or without one the one whose fields are least."""
    fields = [c for c in existing.columns if c != id_col]
    row = F.struct(*(F.col(c).alias(f"_new_{c}") for c in fields))
    other = existing.groupBy(id_col).agg(F.min_by(row, F.struct(order, row) if order else row).alias("_row")).select(id_col, "_row.*")
    out = df.join(other, id_col, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c) if c in df.columns else F.col(f"_new_{c}"))
    return out.drop(*(f"_new_{c}" for c in fields))


def relabel(df: DataFrame, predictions: DataFrame, output: str, pos: str = "pos") -> DataFrame:
    """df with its output column overwritten by predictions (pos, prediction); a row without one is an error when it is
    read."""
    made = predictions.select(pos, F.col("prediction").alias("_made"), F.lit(True).alias("_there"))
    kind = predictions.schema["prediction"].dataType
    lack = F.raise_error(F.concat(F.lit("there is no prediction for row "), F.col(pos).cast("string"))).cast(kind)
    out = df.join(made, pos, "left").withColumn(output, F.when(F.col("_there"), F.col("_made")).otherwise(lack))
    return out.drop("_made", "_there")
