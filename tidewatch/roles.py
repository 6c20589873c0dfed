"""Which column plays which part in a dataset. Operators take roles, never fixed names."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    id: str = "id"
    ts: str | None = "timestamp"
    input: str | None = None
    output: str | None = None

    def having(self, **names: str | None) -> Roles:
        return replace(self, **names)

    def column(self, df: DataFrame, part: str) -> str:
        """The column of a part; an error if none is set or df lacks it."""
        name = getattr(self, part)
        if name is None or name not in df.columns:
            raise ValueError(f"the dataset has no {part} column ({name})")
        return name

    def has_timestamps(self, df: DataFrame) -> bool:
        return self.ts is not None and self.ts in df.columns


def ids(df: DataFrame, roles: Roles) -> DataFrame:
    return df.select(roles.column(df, "id"))


def inputs(df: DataFrame, roles: Roles) -> DataFrame:
    return df.select(roles.column(df, "input"))


def outputs(df: DataFrame, roles: Roles) -> DataFrame:
    return df.select(roles.column(df, "output"))


def with_outputs(df: DataFrame, roles: Roles, values: DataFrame, pos: str = "pos") -> DataFrame:
    """df with its output column from values (pos, value); a position without a value is an error."""
    name = roles.column(df, "output")
    new = values.select(pos, F.col("value").alias("_new"), F.lit(True).alias("_there"))
    out = df.join(new, pos, "left")
    kind = df.schema[name].dataType
    absent = F.raise_error(F.lit("there are fewer outputs than samples")).cast(kind)
    return out.withColumn(name, F.when(F.col("_there"), F.col("_new").cast(kind)).otherwise(absent)).select(*df.columns)


def sample_by_id(df: DataFrame, roles: Roles, value, order: str | None = None) -> DataFrame:
    """The first row with an id, in the order given; an error, when the row is read, if there is none."""
    hit = df.where(F.col(roles.column(df, "id")) == F.lit(value))
    row = F.struct(*df.columns)
    one = hit.agg((F.min_by(row, order) if order else F.first(row)).alias("_row"))
    absent = F.raise_error(F.lit(f"no sample has id {value}")).cast(one.schema["_row"].dataType)
    return one.select(F.when(F.col("_row").isNull(), absent).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def sample_at(df: DataFrame, position: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) == position)


def samples_between(df: DataFrame, start: int, size: int, pos: str = "pos") -> DataFrame:
    """A slice of `size` consecutive positions."""
    if size <= 0:
        raise ValueError("a slice has at least one sample")
    return df.where(F.col(pos).between(start, start + size - 1))
