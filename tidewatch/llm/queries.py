"""The queries of this subpackage: each applies one operator to its whole table and derives the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, frames, jaccard, lexical, mixing, pii, quality_fm, quality_rules, repair, topk, toxicity, url_filters, warc, workspace

MULTI_RANKS, BPE_JSON = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    records, response = warc.read(spark, folder), F.col("type") == "response"
    return records.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, warc.base32_sha1(F.col("payload"))).otherwise(F.col("stated_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        warc.page_id(F.col("refers_to_id")).alias("refers_to"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP3_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as a from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.a, c.a)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.a) = len(c.a) where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored
)
select query_id, r::int as rank, vec_id, score from ranked where r <= 5
"""


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of pages, as the tables hold none: a hash of each host gives its entry's date,
    action and end; three parent domains have entries of their own."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    at = F.conv(F.substring(F.md5("key"), 1, 2), 16, 10).cast("int")
    span = F.conv(F.substring(F.md5("key"), 3, 2), 16, 10).cast("int")
    since = F.date_add(F.lit("2024-01-01").cast("date"), at)
    added = hosts.select("key", since.alias("at"), F.when(span % 2 == 0, "block").otherwise("allow").alias("action"))
    removed = hosts.select("key", F.date_add(since, 30 + span).alias("at"), F.lit("remove").alias("action"))
    fixed = pages.sparkSession.createDataFrame(
        [("example.org", "2024-03-01", "block"), ("example.org", "2024-06-01", "remove"), ("example.net", "2024-02-01", "allow"), ("example.net", "2024-08-01", "block"), ("example.com", "2024-11-01", "block")],
        "key string, at string, action string",
    )
    return added.unionByName(removed).unionByName(fixed.withColumn("at", F.col("at").cast("date")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    out = url_filters.judge(captures, list_changes(pages))
    return out.select(F.col("id").alias("page_id"), "host", F.col("fetched_at").cast("string").alias("fetched_at"), "rule", F.col("since").cast("string").alias("since"), "verdict")


OP4_SQL = """
with p as (
  select page_id, date '2024-01-01' + (page_id % 365)::int as fetched_at,
    nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\\.+$', '')), '') as host
  from pages
), h as (
  select distinct host as k, ('0x' || substr(md5(host), 1, 2))::int as a, ('0x' || substr(md5(host), 3, 2))::int as b from p where host is not null
), c as (
  select k, date '2024-01-01' + a as d, case when b % 2 = 0 then 2 else 1 end as s from h
  union all select k, date '2024-01-01' + a + 30 + b, 0 from h
  union all select * from (values ('example.org', date '2024-03-01', 2), ('example.org', date '2024-06-01', 0),
    ('example.net', date '2024-02-01', 1), ('example.net', date '2024-08-01', 2), ('example.com', date '2024-11-01', 2))
), i as (
  select k, d as since, s, lead(d) over (partition by k order by d) as until from (select k, d, max(s) as s from c group by k, d)
), keys as (
  select page_id, fetched_at, host, unnest(list_transform(generate_series(1, greatest(1, len(string_split(host, '.')) - 1)),
    lambda x: array_to_string(list_slice(string_split(host, '.'), x, len(string_split(host, '.'))), '.'))) as k
  from p where host is not null
), hits as (
  select page_id, i.k, since, s, row_number() over (partition by page_id order by length(i.k) desc) as r
  from keys join i on keys.k = i.k and s > 0 and fetched_at >= since and (until is null or fetched_at < until)
)
select p.page_id, host, cast(fetched_at as varchar) as fetched_at, k as rule, cast(since as varchar) as since,
  case s when 2 then 'block' when 1 then 'allow' else 'none' end as verdict
from p left join (select * from hits where r = 1) t on p.page_id = t.page_id
"""


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"), "p_good",
    )


def op7_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1))
    sources = made.sources.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target")
    out = made.taken().join(sources, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_shard", "last_shard")


def held_out(doc_id: str = "doc_id"):
    """Rows that never train: those with crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality_fm.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", pii.text_key(F.col("text")).alias("key")).join(pii.spans(docs), "key", "left")

    def count(kind: int):
        return F.when(F.col("base").isNull(), 0).otherwise(F.size(F.filter("base", lambda x: x["kind"] == kind))).cast("long")

    number = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS, 1)]
    return rows.select("doc_id", *number, F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.as_text(F.col("all")).alias("spans"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.joined(repair.repair(table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
with words as (
  select doc_id, d, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select doc_id, row_number() over () as d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
), postings as (select doc_id, d, term, count(*) as tf from words group by all),
lengths as (select d, sum(tf)::bigint as n from postings group by d),
totals as (select count(*) as big_n, sum(n)::bigint as big_l from lengths),
weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)))::bigint as w from postings, totals group by term, big_n),
items as (select row_number() over () as i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from (select distinct item_id, text from benchmark)),
asked as (select i, item_id, term, count(*) as often from (select i, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from items) group by all),
scored as (
  select i, item_id, d, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::bigint as score
  from asked join weights using (term) join postings using (term) join lengths using (d), totals group by all
)
select item_id, r::int as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as r from scored where score > 0) where r <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_topk": op3_topk,
    "op4_url_filters": op4_url_filters,
    "op5_jaccard": op5_jaccard,
    "op6_quality_rules": op6_quality_rules,
    "op7_frames": op7_frames,
    "op8_mixing": op8_mixing,
    "op9_quality_fm": op9_quality_fm,
    "op10_pii": op10_pii,
    "op11_repair": op11_repair,
    "op12_toxicity": op12_toxicity,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op4_url_filters": OP4_SQL, "op13_lexical": OP13_SQL}
