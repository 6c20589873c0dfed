"""Reading and writing datasets, predictions, metric results and experiment folders."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import reconstruct
from ..roles import Roles


@dataclass(frozen=True)
class Dataset:
    """A frame and its roles; transformations give new ones."""

    df: DataFrame
    roles: Roles

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Dataset:
        return Dataset(change(self.df), self.roles)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON array of records, or a record a line; an error if the path is missing. An array, which begins with a bracket, is
    one document of its file; records in lines are split over tasks."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    reader = spark.read.option("multiLine", bool(first) and first[0][0].lstrip()[:1] == "[")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A record a line; dates as the nearest milliseconds since 1970, halves away from zero."""
    dated = {c: F.round(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1000).cast("decimal(4,0)")).cast("long") for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")}
    df.withColumns(dated).write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Side files with a header, by base name."""
    return {Path(p).name: spark.read.option("header", True).option("inferSchema", True).csv(p) for p in paths}


def read_headerless_csv(spark: SparkSession, path: str) -> DataFrame:
    """(values: array<double>) of a model's output."""
    df = spark.read.option("header", False).csv(path)
    return df.select(F.array(*(F.col(c).cast("double") for c in df.columns)).alias("values"))


LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {"plain": lambda df: df}


def load(spark: SparkSession, config: dict, to_timestamp: Callable[[Column], Column] | None = None) -> Dataset:
    """A dataset by configuration: dataset_file, the id_key, timestamp_key, input_key and output_key, dataset_class (a
    name in LOADERS, which prepares the frame) and dataset_file_base (then the file holds references to it: id, timestamp,
    original_id and sample_group_id, in the order of the drifted dataset; pos is that order, from the file if it has one)."""
    roles = Roles(config.get("id_key", "id"), config.get("timestamp_key", "timestamp"), config.get("input_key"), config.get("output_key"))
    prepare = LOADERS[config.get("dataset_class", "plain")]
    df = read_json(spark, config["dataset_file"])
    if base_file := config.get("dataset_file_base"):
        place = F.monotonically_increasing_id()  # grows with the place in a file
        base = prepare(read_json(spark, base_file)).withColumn("_place", place)
        df = reconstruct(df if "pos" in df.columns else df.withColumn("pos", place), base, roles.id, roles.ts if roles.has_timestamps(base) else None, order="_place").drop("_place")
    else:
        df = prepare(df)
    if to_timestamp is not None and roles.has_timestamps(df):
        df = df.withColumn(roles.ts, to_timestamp(F.col(roles.ts)))
    return Dataset(df, roles)


def number_or_zero(column: str) -> Column:
    """Text that may hold a number; anything else is 0."""
    return F.coalesce(F.col(column).try_cast("double"), F.lit(0.0))


def natural_key(column: Column) -> Column:
    """Sorts names by the value of the numbers in them, of any length: a run of digits becomes the count of its digits, leading
    zeros aside, in ten places, and then these digits."""
    parts = F.regexp_extract_all(column, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    value = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), value(p)).otherwise(p)), "")


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def parent(path: Column) -> Column:
    """What stands before the last slash; a dot if there is none."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def rewritten(df: DataFrame, folder: str, names: DataFrame, path: str = "image_path", pos: str = "pos") -> DataFrame:
    """df with each path replaced by folder/name, names (pos, name); a row without a name is an error, and so is a name
    without a row."""
    made = F.concat_ws("/", F.lit(folder.rstrip("/")), F.col("_name"))
    lack = F.raise_error(F.lit("numbers of samples and names differ")).cast("string")
    out = df.withColumn("_row", F.lit(True)).join(names.select(pos, F.col("name").alias("_name")), pos, "full")
    return out.withColumn(path, F.when(F.col("_row") & F.col("_name").isNotNull(), made).otherwise(lack)).select(*df.columns)


def renamed(info: DataFrame, changes: DataFrame, name: str = "filename") -> DataFrame:
    """info with file names replaced by changes (old, new); names without a change stay."""
    new = changes.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return info.join(new, F.col(name) == F.col("_old"), "left").withColumn(name, F.coalesce("_new", name)).drop("_old", "_new")


def two_bands(df: DataFrame, band_1: str = "band_1", band_2: str = "band_2", angle: str = "inc_angle") -> DataFrame:
    """df with bands (two bands and their average) and angle, 0 where it isn't a number: a model's inputs."""
    bands = F.array(F.col(band_1), F.col(band_2), F.zip_with(band_1, band_2, lambda a, b: (a + b) / 2))
    return df.withColumn("bands", bands).withColumn("angle", number_or_zero(angle))


def with_side_files(paths: DataFrame, side: list[str], column: str = "path") -> DataFrame:
    """(path, kind: input or side) of a model's input files and the side files that go with all of them."""
    more = paths.sparkSession.createDataFrame([(p, "side") for p in side], f"{column} string, kind string")
    return paths.select(column, F.lit("input").alias("kind")).unionByName(more)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def image_paths(paths: DataFrame, extensions: list[str], fields: dict | None = None, column: str = "path", id_col: str | None = None) -> DataFrame:
    """(id: the path's stem, or id_col; image_path, constant fields, sort_key) of the paths with one of the extensions, whatever their case."""
    pattern = r"(?i)\.(" + "|".join(re.escape(e.lstrip(".")) for e in extensions) + ")$"
    hit = paths.where(F.col(column).rlike(pattern))
    return hit.select((F.col(id_col) if id_col else stem(F.col(column))).alias("id"), F.col(column).alias("image_path"), *(F.lit(v).alias(k) for k, v in (fields or {}).items()), natural_key(F.col(column)).alias("sort_key"))


def scan_images(spark: SparkSession, folder: str, extensions: list[str], fields: dict | None = None) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return image_paths(found, extensions, fields)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data) of the pictures that the JVM can decode."""
    return spark.read.format("image").load(folder).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def save_predictions(df: DataFrame, path: str, roles: Roles, truth: str = "truth", prediction: str = "prediction", raw: str | None = None) -> None:
    columns = [F.col(roles.id).alias("id"), F.col(truth).alias("truth"), F.col(prediction).alias("prediction")]
    write_json(df.select(*columns, *([F.col(raw).alias("raw_prediction")] if raw else [])), path)


def load_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Predictions and, where there is one, the side file of additional data beside them."""
    side = re.sub(r"(\.json)?$", "_add_data.json", path.rstrip("/"), count=1)
    main = spark.read.json(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(side)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return main, spark.read.json(side) if there else None


def save_metrics(metrics: DataFrame, path: str) -> None:
    """metrics (name, results map, data map) as a record a line; nothing is written for none."""
    if not metrics.isEmpty():
        metrics.write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics that save_metrics wrote."""
    return spark.read.json(path)


#: The file of metrics in a run's folder, as save_experiment writes it.
EXPERIMENT_FILE = "file=metrics.json"


def save_experiment(metrics: DataFrame, base: str) -> None:
    """metrics (run, name, results map) of many runs in one job: base/run=.../file=metrics.json of each."""
    metrics.withColumn("file", F.lit("metrics.json")).write.mode("overwrite").partitionBy("run", "file").json(base)


def experiment_results(spark: SparkSession, base: str, name: str = "metrics.json") -> DataFrame:
    """(run, metric, value, params) of all runs below a folder, by the run folder's name."""
    rows = spark.read.json(f"{base}/*/{name}")
    run = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{re.escape(name)}(?:/[^/]*)?$", 1)
    return rows.select(run.alias("run"), F.col("name").alias("metric"), F.col("results.overall").alias("value"), *([F.to_json("data").alias("params")] if "data" in rows.columns else []))


def load_experiment(spark: SparkSession, base: str, config: dict, metrics_file: str = "metrics.json") -> DataFrame:
    """(run, metric, value, case_value, params) of a packaged experiment: the runs below base, in the order of their names,
    and the sweep that made them (config: min, max and step). No runs, no metrics, and another number of runs than the
    sweep has values are errors."""
    from ..operators.experiments import sweep

    found = experiment_results(spark, base, metrics_file)
    runs = [r["run"] for r in found.select("run").distinct().orderBy("run").collect()]  # a row a run of an experiment
    if not runs:
        raise ValueError(f"there are no metrics of runs below {base}")
    values = [r["value"] for r in sweep(spark, "value", config["min"], config["max"], config["step"], "").orderBy("n").collect()]
    if len(runs) != len(values):
        raise ValueError(f"{len(runs)} runs don't cover a sweep of {len(values)} values")
    cases = spark.createDataFrame(list(zip(runs, values, strict=True)), "run string, case_value double")
    return found.join(F.broadcast(cases), "run")


def experiment_path(base: str, experiment: str, run: str) -> str:
    return f"{base}/experiment={experiment}/run={run}"


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text())


def save_config(config: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, indent=4))


# The headers of the flight and map side files.


def flight_metadata(df: DataFrame, name: str, lat: str, long: str, unknown: float = 0) -> DataFrame:
    """The ten columns of a flight's side file; what isn't known is 0, or NaN for photos."""
    zero = ("Altitude", "Gimball_Roll", "Gimball_Yaw", "Gimball_Pitch", "Flight_Roll", "Flight_Yaw", "Flight_Pitch")
    return df.select(F.col(name).alias("Filename"), F.col(lat).alias("Latitude"), F.col(long).alias("Longitude"), *(F.lit(unknown).alias(z) for z in zero))


def map_corners(df: DataFrame, name: str, top_left: tuple[str, str], bottom_right: tuple[str, str]) -> DataFrame:
    names = ("Top_left_lat", "Top_left_lon", "Bottom_right_lat", "Bottom_right_long")
    return df.select(F.col(name).alias("Filename"), *(F.col(c).alias(n) for c, n in zip((*top_left, *bottom_right), names, strict=True)))
