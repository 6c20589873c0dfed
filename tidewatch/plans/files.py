"""Queries whose rows go through files: tables are written as datasets, predictions, metrics, side files and pictures in the
shared folder, and read back by the loaders."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import buckets, classify, resample
from ..roles import Roles, ids, inputs, outputs
from ..sources import datasets, pictures
from ..tables import scratch
from .queries import BASE, DAYS, DRAWN, DRAWS, GEO, PIXELS, PRED, RESULTS, START, base_bins, daily, drift_none, located, predictions, query, results, table
from .queries import pictures as pixels_of

EVENTS = {"id_key": "event_id", "timestamp_key": "ts", "input_key": "value", "output_key": "event_type"}


def event_files(spark: SparkSession, sf_dir: str) -> str:
    place = scratch(spark, "events-json")
    datasets.write_json(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), place)
    return place


@query("select event_id, epoch_ms(ts) as millis, event_type, value from events")
def dataset_files(spark, sf_dir):
    """A dataset as JSON and back, with its roles and times."""
    found = datasets.load(spark, {**EVENTS, "dataset_file": event_files(spark, sf_dir)}, F.timestamp_millis)
    return found.df.select("event_id", F.unix_millis("ts").alias("millis"), "event_type", "value")


@query("select event_id as id, value as input, event_type as output from events")
def dataset_roles(spark, sf_dir):
    """Ids, inputs and outputs of a loaded dataset, each by its role."""
    found = datasets.load(spark, {**EVENTS, "dataset_file": event_files(spark, sf_dir)})
    both = inputs(found.df, found.roles).columns + outputs(found.df, found.roles).columns + ids(found.df, found.roles).columns
    return found.df.select(*both).toDF("input", "output", "id")


@query(f"with {DRAWS}, {BASE}, a as (select *, sample_group_id % 5 as bin_idx from d), {DRAWN} select pos, event_id, event_type, value, 1704067200 + pos * 3600 as ts from r join events e on e.event_id = r.original_id")
def reference_files(spark, sf_dir):
    """A drifted dataset as a file of references, and its base as another."""
    place = scratch(spark, "references-json")
    datasets.write_json(resample.reference_rows(resample.timestamps(drift_none(spark, sf_dir), START, 3600)), place)
    found = datasets.load(spark, {**EVENTS, "dataset_file": place, "dataset_file_base": event_files(spark, sf_dir)})
    return found.df.select("pos", "event_id", "event_type", "value", "ts")


@query(f"with {PRED} select event_id as id, truth::bigint as truth, prediction::bigint as prediction, raw as raw_prediction, event_id % 7 as more from p")
def prediction_files(spark, sf_dir):
    """Predictions and their side file."""
    place, rows = scratch(spark, "predictions") + ".json", predictions(spark, sf_dir)
    datasets.save_predictions(rows, place, Roles(id="event_id"), raw="raw")
    datasets.write_json(rows.select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("more")), place.replace(".json", "_add_data.json"))
    main, side = datasets.load_predictions(spark, place)
    return main.join(side, "id")


@query(f"with {RESULTS}, r as (select run, dense_rank() over (order by run) as k from (select distinct run from e)) select 'run=' || lpad(run::varchar, 3, '0') as run, metric, value, k::double as case_value from e join r using (run)")
def experiment_files(spark, sf_dir):
    """Metrics of a run a day, written as an experiment's folder and read with the sweep that made it."""
    base, found = scratch(spark, "experiment"), results(spark, sf_dir)
    rows = found.select(F.lpad(F.col("run").cast("string"), 3, "0").alias("run"), F.col("metric").alias("name"), F.create_map(F.lit("overall"), "value").alias("results"))
    datasets.save_experiment(rows, base)
    runs = found.select("run").distinct().count()
    return datasets.load_experiment(spark, base, {"min": 1, "max": runs, "step": 1}, datasets.EXPERIMENT_FILE).select("run", "metric", "value", "case_value")


@query(f"with {GEO} select 'img-' || event_id || '.png' as Filename, round(lat, 6) as Latitude, round(long, 6) as Longitude, 0::bigint as Altitude from t")
def flight_files(spark, sf_dir):
    """The flight side file as CSV with its header."""
    place = scratch(spark, "flight")
    rows = located(spark, sf_dir).withColumn("name", F.format_string("img-%d.png", F.col("event_id")))
    datasets.flight_metadata(rows, "name", "lat", "long").write.option("header", True).csv(place)
    found = next(iter(datasets.read_csv(spark, [place]).values()))
    return found.select("Filename", F.round(F.col("Latitude").cast("double"), 6).alias("Latitude"), F.round(F.col("Longitude").cast("double"), 6).alias("Longitude"), F.col("Altitude").cast("long").alias("Altitude"))


@query("select vec_id::double as vec_id, round(list_sum(list_transform(embedding[1:4], lambda x: round(x::double, 6))), 6) as total from embeddings")
def headerless_files(spark, sf_dir):
    """A model's output as CSV without a header."""
    place, e = scratch(spark, "output"), F.col("embedding").cast("array<double>")
    table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(e[k], 6).alias(f"v{k}") for k in range(4))).write.csv(place)
    found = datasets.read_headerless_csv(spark, place)
    return found.select(F.col("values")[0].alias("vec_id"), F.round(F.aggregate(F.slice("values", 2, 4), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {PIXELS} select 'v' || vec_id || '.png' as name, 8 as height, 8 as width, list_sum(px)::bigint as total from x")
def picture_files(spark, sf_dir):
    """Every picture of 8 x 8 gray pixels as a PNG file, written by the sink and decoded by Spark's source."""
    place = scratch(spark, "pictures")
    data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    rows = pixels_of(spark, sf_dir).select(F.format_string("v%d.png", F.col("vec_id")).alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    pictures.write_images(rows, place)
    found = datasets.read_images(spark, place)
    digits = F.regexp_extract_all(F.hex("data"), F.lit("(..)"), F.lit(1))
    total = F.aggregate(F.transform(digits, lambda v: F.conv(v, 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return found.select(datasets.basename(F.col("path")).alias("name"), "height", "width", total.alias("total"))


@query("select page_id, case when page_id % 2 = 0 then 'p' || page_id || '.png' else 'p' || page_id || '.tif' end as filename from pages")
def renamed_files(spark, sf_dir):
    """File names by a table of changes."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.format_string("p%d.tif", F.col("page_id")).alias("filename"))
    changes = pages.where(F.col("page_id") % 2 == 0).select(F.col("filename").alias("old"), F.format_string("p%d.png", F.col("page_id")).alias("new"))
    return datasets.renamed(pages, changes)


@query("select page_id as pos, 'new/place/img-' || page_id || '.png' as image_path from pages")
def rewritten_paths(spark, sf_dir):
    """Each path replaced by a new folder and a name."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("image_path"))
    return datasets.rewritten(pages, "new/place/", pages.select("pos", F.format_string("img-%d.png", F.col("pos")).alias("name")))


@query(r"select page_id, regexp_replace(url, '^.*/', '') as base, regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', '') as stem, regexp_replace(url, '/[^/]*$', '') as parent from pages")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", datasets.basename(url).alias("base"), datasets.stem(url).alias("stem"), datasets.parent(url).alias("parent"))


@query(f"with b as (select vec_id, case when vec_id % 5 = 0 then 0 else vec_id % 90 end::double as angle, [embedding[1:32], embedding[33:64], list_transform(generate_series(1, 32), lambda i: (embedding[i]::double + embedding[i + 32]::double) / 2)] as bands from embeddings) select vec_id, angle, k as band, round(list_sum(list_transform(bands[k + 1], lambda v: v::double)), 5) as total from b, (select unnest([0, 1, 2]) as k)")
def two_band_inputs(spark, sf_dir):
    """A model's two bands, their average, and an angle that may be missing."""
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(e, 1, 32).alias("band_1"), F.slice(e, 33, 32).alias("band_2"), F.when(F.col("vec_id") % 5 == 0, "na").otherwise((F.col("vec_id") % 90).cast("string")).alias("inc_angle"))
    rows = datasets.two_bands(rows).select("vec_id", "angle", F.posexplode("bands").alias("band", "v"))
    return rows.select("vec_id", "angle", "band", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("select url as path, 'input' as kind from pages union all select 'side.csv', 'side'")
def side_inputs(spark, sf_dir):
    """A model's input files with the side file that goes with all of them."""
    return datasets.with_side_files(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), ["side.csv"])


@query(f"with {PRED} select event_id as pos, truth, prediction from p")
def aligned_predictions(spark, sf_dir):
    """Truths and predictions zipped by position."""
    rows = predictions(spark, sf_dir).withColumnRenamed("event_id", "pos")
    return classify.align(rows.select("pos", "truth"), rows.select("pos", "prediction"))


@query(f"with {DAYS} select interval_idx, interval, aggregated, num_samples from d where interval_idx in (3, 5)")
def series_lookup(spark, sf_dir):
    """Intervals of a series by their index, and by their label."""
    days = daily(spark, sf_dir)
    found = buckets.index_of(days, START + 5 * 86400)
    return buckets.interval_at(days, 3).unionByName(days.join(F.broadcast(found), "interval_idx"))


@query(f"with {BASE} select event_id, bin_idx::int as bin_idx, row_number() over (partition by bin_idx order by ('0x' || substr(md5('11:' || event_id), 1, 8))::bigint, event_id) - 1 as slot from b")
def shuffled_bins(spark, sf_dir):
    """Each bin's rows in a reproducible random order."""
    return resample.shuffled(base_bins(spark, sf_dir).drop("slot"), "event_id", 11).select("event_id", "bin_idx", "slot")

