"""Intermediate tables of the drift operators, in the folder that the driver and all executors share.

A written table ends the lineage, survives lost executors, and is read by several scans at the price of one evaluation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []
#: Elements of an array that a range is exploded through, at most.
FAN = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without it gets a folder of its own, once; a cluster
    without it is an error, as executors wouldn't see the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    place = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not place.isDefined():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
        place = spark.sparkContext._jsc.sc().getCheckpointDir()
    return place.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; `clear` deletes what is written there."""
    path = f"{shared_dir(spark)}/tidewatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Deletes the intermediate tables of this process; frames that still read them become invalid."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone, and with it the wish to tidy up
            return


def each(df: DataFrame, first: Column, last: Column, name: str, levels: int = 3) -> DataFrame:
    """df with a row for each whole number of first..last (none if last < first), through arrays of at most FAN elements
    for up to FAN**levels numbers a row."""
    own, start, left = df.columns, F.col("_each"), F.col("_each_left")
    rows = df.select("*", first.cast("long").alias("_each"), (last - first + 1).cast("long").alias("_each_left")).where("_each_left > 0")
    for width in (FAN**k for k in range(levels - 1, -1, -1)):
        rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_each_left - 1) div {width}"))).alias("_each_at"))
        gone = F.col("_each_at") * width
        rows = rows.select(*own, (start + gone).alias("_each"), F.least(left - gone, F.lit(width)).alias("_each_left"))
    return rows.select(*own, start.alias(name))
