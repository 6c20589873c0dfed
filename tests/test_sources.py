"""Datasets, side files, predictions, metrics and experiments: written, read back, and joined."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.roles import Roles, ids, inputs, outputs, sample_at, sample_by_id, samples_between, with_outputs
from tidewatch.operators import references
from tidewatch.sources import datasets


def write(path, value) -> str:
    path.write_text(json.dumps(value))
    return str(path)


BASE = [{"id": f"s{k}", "timestamp": 100 + k, "x": k * 1.5, "y": k % 2} for k in range(6)]
CONFIG = {"input_key": "x", "output_key": "y"}


def test_dataset_by_configuration(spark, tmp_path):
    config = {**CONFIG, "dataset_file": write(tmp_path / "base.json", BASE)}
    found = datasets.load(spark, config)
    assert found.roles == Roles("id", "timestamp", "x", "y") and found.roles.has_timestamps(found.df)
    assert sorted(r.id for r in ids(found.df, found.roles).collect()) == [f"s{k}" for k in range(6)]
    assert sorted(r.x for r in inputs(found.df, found.roles).collect()) == [k * 1.5 for k in range(6)]
    assert sorted(r.y for r in outputs(found.df, found.roles).collect()) == [0, 0, 0, 1, 1, 1]
    dated = datasets.load(spark, config, to_timestamp=lambda c: F.timestamp_seconds(c))
    assert dict(dated.df.dtypes)["timestamp"] == "timestamp"
    assert found.map(lambda df: df.where("y = 1")).df.count() == 3 and found.df.count() == 6
    with pytest.raises(ValueError, match="no input column"):
        inputs(found.df.drop("x"), found.roles)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        datasets.load(spark, {"dataset_file": str(tmp_path / "none.json")})


def test_a_drifted_dataset_is_loaded_from_its_references(spark, tmp_path):
    """The file holds ids, times, originals and groups only, in the order of the new dataset; ids of the base may repeat."""
    base = [*BASE, {"id": "s2", "timestamp": 0, "x": -1.0, "y": 9}]
    refs = [{"id": f"r{k}", "timestamp": 7000 + k, "original_id": f"s{o}", "sample_group_id": k // 2} for k, o in enumerate([3, 2, 2, 5])]
    config = {**CONFIG, "dataset_file": write(tmp_path / "refs.json", refs), "dataset_file_base": write(tmp_path / "base.json", base)}
    rows = datasets.load(spark, config).df.orderBy("pos").collect()
    assert [(r.id, r.timestamp, r.x, r.y) for r in rows] == [("s3", 7000, 4.5, 1), ("s2", 7001, 3.0, 0), ("s2", 7002, 3.0, 0), ("s5", 7003, 7.5, 1)]
    lost = write(tmp_path / "lost.json", [{**refs[0], "original_id": "nobody"}])
    with pytest.raises(Exception, match="no base row has id nobody"):
        datasets.load(spark, {**config, "dataset_file": lost}).df.collect()


def test_a_dataset_class_prepares_both_branches(spark, tmp_path):
    datasets.LOADERS["doubled"] = lambda df: df.withColumn("x", F.col("x") * 2)
    try:
        config = {**CONFIG, "dataset_class": "doubled", "dataset_file": write(tmp_path / "base.json", BASE)}
        assert sorted(r.x for r in datasets.load(spark, config).df.collect()) == [k * 3.0 for k in range(6)]
        refs = write(tmp_path / "refs.json", [{"id": "r", "timestamp": 1, "original_id": "s4", "sample_group_id": 0}])
        assert datasets.load(spark, {**config, "dataset_file": refs, "dataset_file_base": config["dataset_file"]}).df.first().x == 12.0
    finally:
        del datasets.LOADERS["doubled"]


def test_json_round_trip(spark, tmp_path):
    df = spark.sql("select 1 as id, timestamp '2024-01-01 00:00:01.5' as t, date '1970-01-02' as d, array(1, 2) as v, cast(null as string) as n")
    datasets.write_json(df, f"{tmp_path}/out")
    row = spark.read.json(f"{tmp_path}/out").first()
    assert (row.id, row.t, row.d, row.v) == (1, 1704067201500, 86400000, [1, 2])


def test_csv_side_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\ny,2\n")
    (tmp_path / "b.csv").write_text("1.5,2\n3,4\n")
    found = datasets.read_csv(spark, [str(tmp_path / "a.csv")])
    assert list(found) == ["a.csv"] and sorted(map(tuple, found["a.csv"].collect())) == [("x", 1), ("y", 2)]
    assert sorted(r["values"] for r in datasets.read_headerless_csv(spark, str(tmp_path / "b.csv")).collect()) == [[1.5, 2.0], [3.0, 4.0]]


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, 0.25), ("b", 0, 0, 0.5)], "id string, truth int, prediction int, raw double")
    datasets.save_predictions(df, f"{tmp_path}/p.json", Roles(), raw="raw")
    main, side = datasets.load_predictions(spark, f"{tmp_path}/p.json")
    assert sorted((r.id, r.truth, r.prediction, r.raw_prediction) for r in main.collect()) == [("a", 1, 0, 0.25), ("b", 0, 0, 0.5)] and side is None
    datasets.write_json(spark.range(3), f"{tmp_path}/p_add_data.json")
    assert datasets.load_predictions(spark, f"{tmp_path}/p.json")[1].count() == 3


def test_metrics_and_experiments(spark, tmp_path):
    for k, run in enumerate(("run-a", "run-b", "run-c")):
        df = spark.sql(f"select 'atc' as name, map('overall', {k}.5D) as results, map('w', '7') as data")
        datasets.save_metrics(df, f"{tmp_path}/exp/{run}/metrics.json")
    assert datasets.load_metrics(spark, f"{tmp_path}/exp/run-a/metrics.json").first().results.overall == 0.5
    datasets.save_metrics(df.limit(0), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    rows = datasets.experiment_results(spark, f"{tmp_path}/exp").orderBy("run").collect()
    assert [(r.run, r.metric, r.value, r.params) for r in rows] == [(f"run-{c}", "atc", k + 0.5, '{"w":"7"}') for k, c in enumerate("abc")]
    sweep = {"min": 100, "max": 300, "step": 100}
    loaded = datasets.load_experiment(spark, f"{tmp_path}/exp", sweep).orderBy("run").collect()
    assert [(r.run, r.case_value, r.value) for r in loaded] == [("run-a", 100.0, 0.5), ("run-b", 200.0, 1.5), ("run-c", 300.0, 2.5)]
    with pytest.raises(ValueError, match="3 runs don't cover a sweep of 4"):
        datasets.load_experiment(spark, f"{tmp_path}/exp", {**sweep, "max": 400})
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|no metrics"):
        datasets.load_experiment(spark, f"{tmp_path}/empty", sweep)
    assert datasets.experiment_path("b", "e", "r") == "b/experiment=e/run=r"


def test_config_round_trip(tmp_path):
    datasets.save_config({"a": {"b": [1]}}, f"{tmp_path}/x/y/c.json")
    assert datasets.read_config(f"{tmp_path}/x/y/c.json") == {"a": {"b": [1]}}


def test_pictures_are_found_and_decoded(spark, tmp_path):
    import struct
    import zlib

    def png(width: int, height: int, value: int) -> bytes:
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + bytes([value, 0, 9]) * width for _ in range(height))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    (tmp_path / "sub").mkdir()
    for k in (2, 10, 1):
        (tmp_path / "sub" / f"img{k}.PNG").write_bytes(png(3, 2, k))
    (tmp_path / "sub" / "note.txt").write_text("no picture")
    found = datasets.scan_images(spark, str(tmp_path), ["png"], {"kind": "tile"}).orderBy("sort_key").collect()
    assert [(r.id, r.kind) for r in found] == [("img1", "tile"), ("img2", "tile"), ("img10", "tile")]
    pictures = {r.path.rsplit("/", 1)[1]: r for r in datasets.read_images(spark, str(tmp_path / "sub") + "/*.PNG").collect()}
    assert {(r.height, r.width, r.channels) for r in pictures.values()} == {(2, 3, 3)}
    assert bytes(pictures["img10.PNG"].data[:3]) == bytes([9, 0, 10])  # blue first


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.tar.gz",), ("x.png",), ("/top",)], "p string")
    out = [tuple(r) for r in df.select(datasets.basename(df.p), datasets.stem(df.p), datasets.parent(df.p)).collect()]
    assert out == [("c.tar.gz", "c.tar", "/a/b"), ("x.png", "x", "."), ("top", "top", "")]
    rows = spark.createDataFrame([(0, "/old/a.png", 5), (1, "/old/b.png", 6)], "pos long, image_path string, n int")
    names = spark.createDataFrame([(0, "n0.png"), (1, "n1.png")], "pos long, name string")
    assert [tuple(r) for r in datasets.rewritten(rows, "/new/", names).orderBy("pos").collect()] == [(0, "/new/n0.png", 5), (1, "/new/n1.png", 6)]
    for few, many in ((rows, names.limit(1)), (rows.limit(1), names)):
        with pytest.raises(Exception, match="numbers of samples and names differ"):
            datasets.rewritten(few, "/new", many).collect()
    info = spark.createDataFrame([("a.tif", 1), ("b.png", 2)], "filename string, n int")
    changes = spark.createDataFrame([("a.tif", "a.png")], "old string, new string")
    assert sorted(map(tuple, datasets.renamed(info, changes).collect())) == [("a.png", 1), ("b.png", 2)]


def test_model_inputs(spark):
    df = spark.createDataFrame([("r", [1.0, 2.0], [3.0, 6.0], "na"), ("s", [0.0], [1.0], "35.5")], "id string, band_1 array<double>, band_2 array<double>, inc_angle string")
    assert [(r.bands, r.angle) for r in datasets.two_bands(df).orderBy("id").collect()] == [([[1.0, 2.0], [3.0, 6.0], [2.0, 4.0]], 0.0), ([[0.0], [1.0], [0.5]], 35.5)]
    files = datasets.with_side_files(spark.createDataFrame([("a.png",)], "path string"), ["map.csv"]).collect()
    assert sorted(map(tuple, files)) == [("a.png", "input"), ("map.csv", "side")]


def test_flight_and_map_files(spark):
    df = spark.createDataFrame([("f.jpg", 1.5, -2.5, 3.0, 4.0)], "name string, a double, b double, c double, d double")
    flight = datasets.flight_metadata(df, "name", "a", "b")
    assert flight.columns == ["Filename", "Latitude", "Longitude", "Altitude", "Gimball_Roll", "Gimball_Yaw", "Gimball_Pitch", "Flight_Roll", "Flight_Yaw", "Flight_Pitch"]
    assert tuple(flight.first()) == ("f.jpg", 1.5, -2.5, 0, 0, 0, 0, 0, 0, 0)
    assert all(x != x for x in tuple(datasets.flight_metadata(df, "name", "a", "b", float("nan")).first())[3:])
    corners = datasets.map_corners(df, "name", ("a", "b"), ("c", "d"))
    assert corners.columns == ["Filename", "Top_left_lat", "Top_left_lon", "Bottom_right_lat", "Bottom_right_long"] and tuple(corners.first()) == ("f.jpg", 1.5, -2.5, 3.0, 4.0)


def test_samples(spark):
    df = spark.createDataFrame([(k, f"s{k % 4}", k * 10, 0) for k in range(8)], "pos long, id string, v long, y long")
    roles = Roles(output="y")
    assert sample_by_id(df, roles, "s1", "pos").first().v == 10
    with pytest.raises(Exception, match="no sample has id absent"):
        sample_by_id(df, roles, "absent").collect()
    assert sample_at(df, 5).first().v == 50 and [r.pos for r in samples_between(df, 2, 3).orderBy("pos").collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        samples_between(df, 0, 0)
    values = spark.createDataFrame([(k, k + 100) for k in range(8)], "pos long, value long")
    done = with_outputs(df, roles, values).orderBy("pos")
    assert done.columns == df.columns and [r.y for r in done.collect()] == [k + 100 for k in range(8)]
    with pytest.raises(Exception, match="fewer outputs"):
        with_outputs(df, roles, values.limit(3)).collect()
    assert roles.having(id="k").id == "k"


def test_natural_order_of_long_numbers(spark):
    names = ["a12345678901234567890", "a123456789012345678901234", "a2", "a10", "a010", "a0", "a00b", "a", "b1", "a2b3", "a2b20", "", "9" * 60 + "x", "1" + "0" * 60 + "x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", datasets.natural_key(F.col("n")).alias("k")).collect()
    key = {r.n: r.k for r in rows}
    plain = lambda n: [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", n)]
    for a in names:
        for b in names:
            assert (key[a] < key[b]) == (plain(a) < plain(b)) and (key[a] == key[b]) == (plain(a) == plain(b)), (a, b)


def test_enrichment_and_labels_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, kind string")
    known = spark.createDataFrame([(1, "z", 5.0, 2), (1, "y", 7.0, 1), (3, None, 1.0, 1)], "id long, kind string, extra double, at long")
    got = {r.id: (r.kind, r.extra) for r in references.enrich(df, known, "id", "at").collect()}
    assert got == {1: ("y", 7.0), 2: ("b", None), 3: ("c", 1.0)}
    assert {r.id: r.kind for r in references.enrich(df, known.repartition(3), "id").collect()} == {1: "y", 2: "b", 3: "c"}
    with pytest.raises(Exception, match="no prediction for row 3"):
        references.relabel(df, spark.createDataFrame([(1, 1), (2, 0)], "id long, prediction int"), "kind", "id").collect()


def test_dates_as_the_nearest_milliseconds(spark, duck, sf_dir, tmp_path):
    """Halves away from zero, before 1970 too, as SQL's epoch_ms has them; compared digit by digit."""
    from tidewatch.plans.queries import ORACLES, QUERIES

    micros = [400, 500, 1_704_067_200_000_501, -499, -500, -501, -1499, -1500, -1501, -2000, None]
    datasets.write_json(spark.createDataFrame(list(enumerate(micros)), "n long, us long").select("n", F.timestamp_micros("us").alias("ts")), f"{tmp_path}/dated")
    got = {r.n: r.ts for r in datasets.read_json(spark, f"{tmp_path}/dated", "n long, ts long").collect()}
    assert [got[n] for n in range(len(micros))] == [0, 1, 1_704_067_200_001, 0, -1, -1, -1, -2, -2, -2, None]
    events = {r.event_id: r.millis for r in QUERIES["dataset_files"](spark, sf_dir).collect()}
    assert events == dict(duck.execute(f"select event_id, millis from ({ORACLES['dataset_files']})").fetchall())
