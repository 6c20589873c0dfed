"""Top-k search, WARC archives and URL filters."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import topk, url_filters, warc, workspace
from tidewatch.llm.queries import op1_warc, op3_topk, op4_url_filters

EMB = "vec_id long, embedding array<float>, label int, tile int, ids string"


def brute_topk(rows):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in set(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:5]
            out |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    return out


def test_topk_ties_nulls_and_repeats(spark, folder):
    nan = float("nan")
    rows = [(i, (0.5, -0.25 * (i % 3), 1.0)) for i in range(120)] + [(50, (0.5, -0.5, 1.0)), (7, (0.5, -0.25, 1.0)), (300, None), (350, (nan, 1.0, 1.0)), (400, (None, 1.0, 1.0)), (450, (1.0, 2.0))]
    df = spark.createDataFrame([(i, list(v) if v else None, 1, 2, "x") for i, v in rows], EMB)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in op3_topk(spark, folder(embeddings=df)).collect()}
    assert got == brute_topk(rows)


def test_topk_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "QUERY_TILE", 2)
    rows = [(i, tuple(((i * k * 37) % 101) / 50 - 1 for k in range(1, 9))) for i in range(400)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_topk(rows)


def test_topk_of_nothing(spark, folder):
    assert op3_topk(spark, folder(embeddings=spark.createDataFrame([], EMB))).count() == 0


def check_warc(rows, out):
    payload = {i: (h or "").encode() for i, h in rows}
    keeper = {}
    for i, p in payload.items():
        keeper[p] = max(i, keeper.get(p, i))
    want = {(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if keeper[p] == i else "revisit", None if keeper[p] == i else keeper[p]) for i, p in payload.items()}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out} == want and len(out) == len(rows)


def test_warc(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    check_warc([(r.page_id, r.html) for r in rows], op1_warc(spark, sf_dir).collect())


FAKE = "text\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"


def test_warc_records_inside_payloads(spark, folder):
    rows = [(1, None), (2, ""), (3, FAKE), (4, FAKE * 3), (5, "\r\n\r\n" + FAKE), (6, "é" * 5000), (7, FAKE), (8, "WARC/1.1\r\n"), (9, "\n"), (10, "plain")]
    df = spark.createDataFrame([(i, None if i == 2 else f"http://a.org/{i}\r\n", h, 1, "x") for i, h in rows], "page_id long, url string, html string, id int, size string")
    check_warc(rows, op1_warc(spark, folder(pages=df)).collect())


def test_warc_over_many_byte_ranges(spark, folder):
    """Files cut into ranges smaller than their records, with records inside payloads on either side of cuts."""
    rows = [(k, [FAKE * (k % 5), "é" * (37 * k % 900), "x" * (k * 53 % 700) + FAKE, None, "WARC/1.1\r\n" * (k % 4)][k % 5]) for k in range(150)]
    where = folder(pages=spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in rows], "page_id long, url string, html string").coalesce(2))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        check_warc(rows, op1_warc(spark, where).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_repeated_rows_and_null_ids(spark, folder):
    rows = [(1, "same"), (1, "same"), (2, "same"), (None, "alone"), (None, "same"), (3, None), (3, None), (4, "x" * 300_000)]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op1_warc(spark, folder(pages=df)).collect()), key=str)
    want = [(1, 4, "revisit", 2), (1, 4, "revisit", 2), (2, 4, "response", None), (None, 5, "response", None), (None, 4, "revisit", 2), (3, 0, "response", None), (3, 0, "response", None), (4, 300_000, "response", None)]
    assert got == sorted(want, key=str)


def test_warc_payloads_come_back(spark):
    where = workspace.new_path(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", FAKE), (2, None, "b\r\n")], "page_id long, url string, html string")
    warc.write(df.coalesce(1), where)
    back = {warc_id: bytes(p) for warc_id, p in warc.read(spark, where).select("record_id", "payload").collect()}
    assert back == {"<urn:page:1>": FAKE.encode(), "<urn:page:2>": b"b\r\n"}


def test_warc_of_nothing(spark, folder):
    assert op1_warc(spark, folder(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_url_filters_by_hand(spark):
    day = dt.date.fromisoformat
    changes = spark.createDataFrame([("bad.org", day("2024-01-10"), "block"), ("bad.org", day("2024-02-01"), "remove"), ("ok.bad.org", day("2024-01-01"), "allow"), ("both.net", day("2024-01-01"), "allow"), ("both.net", day("2024-01-01"), "block"), (None, day("2024-01-01"), "block")], "key string, at date, action string")
    asked = [(1, "http://x.bad.org/a", "2024-01-09"), (2, "https://u@X.BAD.org:80/a", "2024-01-10"), (3, "http://bad.org", "2024-02-01"), (4, "http://ok.bad.org/", "2024-01-20"), (5, "http://both.net", "2024-05-05"), (6, None, "2024-01-20"), (7, "nothing", "2024-01-20"), (8, "http://bad.org", None), (1, "http://x.bad.org/a", "2024-01-09")]
    rows = spark.createDataFrame([(i, u, day(d) if d else None, "clash") for i, u, d in asked], "page_id long, url string, fetched_at date, host string")
    got = sorted(((r.id, r.verdict, r["rule"]) for r in url_filters.judge(rows, changes).collect() if r.id not in (1, 6, 7, 8)), key=str)
    assert got == [(2, "block", "bad.org"), (3, "none", None), (4, "allow", "ok.bad.org"), (5, "block", "both.net")]
    assert {r.verdict for r in url_filters.judge(rows, changes).collect() if r.id in (1, 6, 7, 8)} == {"none"}
    assert url_filters.judge(rows, changes).count() == len(asked)
    assert url_filters.judge(rows, changes.limit(0)).where("verdict != 'none'").count() == 0


def test_url_filters_of_a_hot_key_with_a_long_history(spark):
    """One key holds most captures and changes, over many ranges; every verdict as by looking through the history."""
    base = dt.datetime(2024, 1, 1)
    at = lambda m: base + dt.timedelta(minutes=m)
    changes = [("hot.org", at(7 * k), ("block", "remove", "allow")[k % 3]) for k in range(400)] + [("a.hot.org", at(500), "allow"), ("cold.net", at(90), "block")]
    asked = [(k, f"http://{('a', 'b', 'c')[k % 3]}.hot.org/{k}", at((k * 13) % 3000)) for k in range(1500)] + [(2000, "http://cold.net", at(89)), (2001, "http://cold.net", at(90))]
    done = {r.id: (r["rule"], r.verdict) for r in url_filters.judge(spark.createDataFrame(asked, "page_id long, url string, fetched_at timestamp").repartition(6), spark.createDataFrame(changes, "key string, at timestamp, action string")).collect()}

    def slow(url, when):
        host = url.split("/")[2]
        for key in (host, ".".join(host.split(".")[-2:])):
            past = [(t, a) for k, t, a in changes if k == key and t <= when]
            if past and max(past)[1] != "remove":
                return key, max(past)[1]
        return None, "none"

    assert done == {i: slow(u, t) for i, u, t in asked}


def test_url_filters_of_nothing(spark, folder):
    assert op4_url_filters(spark, folder(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
