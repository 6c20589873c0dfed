"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names the folder on a cluster. Where it is unset a local session (tests) gets a local folder
once; on a cluster that is an error, as executors wouldn't see the driver's folders. Tables are plain Parquet, so a lost
executor costs the running tasks only, readers get size statistics (Catalyst broadcasts a table only if its files are
small), and both sides of a later join have an exchange of their own, which lets adaptive execution split skewed keys.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []
#: Said where row numbers of two reads of a table differ.
REREAD = "the table has other rows when it is read again; write it first"
#: Rows an Arrow batch, where rows hold whole texts or sets.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    context = spark.sparkContext
    place = context._jsc.sc().getCheckpointDir()
    if place.isDefined():
        return place.get().rstrip("/")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``clear`` deletes what was written there."""
    path = f"{shared_dir(spark)}/tidewatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back: the lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch to BATCH_ROWS, which bounds a Python worker's memory; a lower setting
    stays. Plans read the setting when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` made, when no plan needs them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tidewatch/" in f}:
            drop(df.sparkSession, path)


def same_row(seen: Column, *parts: Column) -> Column:
    """True; an error where a row's columns aren't those whose xxhash64 was seen for its row number."""
    return F.when(F.xxhash64(*parts) == seen, F.lit(True)).otherwise(F.raise_error(F.lit(REREAD)).cast("boolean"))


@atexit.register
def clear() -> None:
    """Deletes all intermediate tables of this process; results that still read them become invalid."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and with it the wish to tidy up
            return


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
