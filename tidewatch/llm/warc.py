"""WARC archives: writing with revisit records, and splittable reading by boundary-chain verification.

Reading. Spark's text reader cuts files into byte ranges and rows at every line feed followed by ``WARC/1.``; a prefix
sum of row lengths (within a range, then over a file's ranges) gives each row's byte offset. A row that parses as a
record header is only a candidate: payloads may hold the same bytes. Each candidate points to where its record ends.
Chains of adjacent candidates inside a byte range are contracted to one pointer, and pointer jumping from offset 0
keeps what is reachable: after k rounds everything within 2**k pointers of the file's start. Candidates that no chain
reaches are part of a payload and are joined back into it. The payloads themselves are read in a second scan and don't
take part in any shuffle, unless they hold such bytes.

Joins of records' offsets are merge joins at every size. Joins that carry payloads leave the choice to Spark's threshold
on the written size of the other table - repeated digests, and rows inside payloads that look like records - so payloads
are shuffled only where that table is large.

Defined cases: null and empty payloads are records with an empty body; a null url leaves the header out; line ends in a
url are percent-encoded; repeated rows give repeated records; a null id is written as the empty id and read as null; an
empty table gives an empty folder and an empty result; of repeated ids with one payload, all are the response; a very long
payload is one row of the reader, or as many as hold it; a record cut off by the end of its file is marked incomplete;
bytes after the last whole record are ignored. Only the named columns are read, so others never clash. The rows of the
second scan are compared with those of the first where they are joined; a difference is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import workspace

#: Begins a record when a line feed stands before it. It can't overlap itself, so the reader finds it at any split.
MAGIC = "WARC/1."
DELIMITER = "\n" + MAGIC
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: 5 hex digits make 4 base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (id, url, payload binary) with digest, record_type and refers_to: of equal payloads of at least min_bytes
    the one with the largest id is the response and the others revisit it. Only digests with more than one row are
    joined back; their table is broadcast if it is small, and else a skewed digest is split by adaptive execution."""
    hashed = pages.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    groups = hashed.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    groups = workspace.materialize(groups.where("n > 1").select("digest", "keeper"), "digests")
    revisit = F.col("keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("keeper"))) & (F.col("size") >= min_bytes)
    out = hashed.join(groups, "digest", "left")
    return out.select("id", "url", "payload", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record per row of pages. A revisit keeps the HTTP header only, whose Content-Length is the payload's."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = mark_revisits(rows, min_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.octet_length("body")).cast("string"),
        F.lit("\r\n\r\n"), F.col("http"),
    )
    rows = rows.withColumn("http", http).withColumn("body", body)
    record = F.concat(head.cast("binary"), F.col("body")).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the reader, with the file, the byte range and a number that grows within the range."""
    rows = spark.read.option("lineSep", DELIMITER).text(folder)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _field(head: str, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)\r?\n{name}:[ \t]*([^\r\n]*)", 1)


def _parse(rows: DataFrame) -> DataFrame:
    """Adds head, head_bytes and length of what may be a record; length is null where it is none."""
    head = F.when(F.col("value").rlike(r"\A(WARC/1\.)?[0-9]\r\n") & (F.instr("value", "\r\n\r\n") > 0), F.substring_index("value", "\r\n\r\n", 1))
    rows = rows.withColumn("head", head)
    return rows.withColumn("head_bytes", F.octet_length("head") + 4).withColumn("length", _field("head", "Content-Length").try_cast("long"))


def _record(rows: DataFrame, block: Column) -> DataFrame:
    """The fields of verified records from head and the content block (binary)."""
    rows = rows.withColumn("content", block)
    http = F.substring_index(F.col("content").cast("string"), "\r\n\r\n", 1)
    rows = rows.withColumn("type", F.lower(_field("head", "WARC-Type"))).withColumn("media", _field("head", "Content-Type"))
    is_http = F.col("media").startswith("application/http")
    rows = rows.withColumn("http", F.when(is_http, http))
    payload = F.when(is_http, F.expr("substring(content, octet_length(http) + 5)")).otherwise(F.col("content"))
    rows = rows.withColumn("payload", payload)
    blank = lambda c: F.when(c != "", c)
    return rows.select(
        "file", "type",
        _field("head", "WARC-Record-ID").alias("record_id"),
        blank(_field("head", "WARC-Refers-To")).alias("refers_to_id"),
        blank(_field("head", "WARC-Target-URI")).alias("url"),
        blank(F.regexp_extract("head", r"(?i)\nWARC-Payload-Digest:[ \t]*sha1:([A-Z2-7]+)", 1)).alias("stated_digest"),
        F.regexp_extract(F.concat(F.lit("\n"), F.col("http")), r"(?i)\nContent-Length:[ \t]*([0-9]+)", 1).try_cast("long").alias("stated_bytes"),
        "payload",
        (F.octet_length("content") == F.col("length")).alias("complete"),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """A row per reader row, without its content: file, block, seq, idx (its place in the file), start, next (null: no
    candidate), whole (a record with nothing missing and nothing over), size (the file's bytes), bytes (the row's)."""
    step = len(DELIMITER)
    parsed = _parse(rows).select("file", "block", "seq", F.octet_length("value").cast("long").alias("bytes"), "head_bytes", "length")
    parsed = workspace.materialize(parsed, "warc-rows")
    totals = parsed.groupBy("file", "block").agg(F.sum(F.col("bytes") + step).alias("sum"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    totals = totals.select(
        "file", "block",
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("idx_base"),
        (F.sum("sum").over(whole) - step).alias("size"), F.sum("n").over(whole).alias("rows"),
    )
    within = Window.partitionBy("file", "block").orderBy("seq")
    at = parsed.withColumn("rel", F.sum(F.col("bytes") + step).over(within) - F.col("bytes") - step).withColumn("nth", F.row_number().over(within) - 1)
    at = at.join(totals, ["file", "block"]).withColumn("content_at", F.col("base") + F.col("rel")).withColumn("idx", F.col("idx_base") + F.col("nth"))
    end = F.col("content_at") + F.col("head_bytes") + F.col("length") + 4
    row_end = F.col("content_at") + F.col("bytes") + F.when(F.col("idx") == F.col("rows") - 1, 0).otherwise(1)
    return at.select(
        "file", "block", "seq", "idx", "size", "bytes",
        F.when(F.col("idx") == 0, F.col("content_at")).otherwise(F.col("content_at") - len(MAGIC)).alias("start"),
        end.alias("next"), (end == row_end).alias("whole"),
    )


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches."""
    cand = found.where("next is not null")
    order = Window.partitionBy("file", "block").orderBy("start")
    near = cand.withColumn("before", F.lag("next").over(order)).withColumn("after", F.lead("start").over(order))
    near = workspace.materialize(near, "candidates")
    far = near.where("after is null or next != after").select("file", F.col("next").alias("start")).distinct().withColumn("aimed_at", F.lit(True))
    heads = near.join(far.hint("merge"), ["file", "start"], "left").withColumn("is_head", (F.col("before").isNull() | (F.col("before") != F.col("start")) | F.col("aimed_at").isNotNull()).cast("int"))
    heads = workspace.materialize(heads.withColumn("run", F.sum("is_head").over(order)).drop("before", "after", "aimed_at", "is_head"), "runs")
    runs = heads.groupBy("file", "block", "run").agg(F.min("start").alias("head"), F.max_by("next", "start").alias("jump"))
    nodes = workspace.materialize(runs.withColumn("reached", F.col("head") == 0), "jumps")
    reached = nodes.where("reached").count()
    while True:
        hit = nodes.where("reached").select("file", F.col("jump").alias("head")).distinct().withColumn("hit", F.lit(True))
        on = nodes.select("file", F.col("head").alias("jump"), F.col("jump").alias("twice"))
        last, nodes = nodes, nodes.join(hit.hint("merge"), ["file", "head"], "left").join(on.hint("merge"), ["file", "jump"], "left")
        nodes = nodes.select("file", "block", "run", "head", F.coalesce("twice", "jump").alias("jump"), (F.col("reached") | F.col("hit").isNotNull()).alias("reached"))
        nodes = workspace.materialize(nodes, "jumps")
        workspace.discard(last)
        now = nodes.where("reached").count()
        if now == reached:
            break
        reached = now
    return heads.join(nodes.where("reached").select("file", "block", "run").hint("merge"), ["file", "block", "run"], "left_semi").drop("run")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The verified records of the archives in a folder: file, type, record_id, refers_to_id, url, stated_digest,
    stated_bytes (the payload's, by the HTTP header), payload (binary), complete."""
    rows = _rows(spark, folder)
    found = workspace.materialize(candidates(rows), "warc-offsets")
    kept = workspace.materialize(reachable(found), "warc-records")
    # Rows that aren't one whole record by themselves: parts of payloads, and records that go on over such rows.
    odd = found.join(kept.where("whole").select("seq").hint("merge"), "seq", "left_anti").select("seq")
    odd = workspace.materialize(odd, "warc-odd")
    plain = _parse(rows.join(odd, "seq", "left_anti"))
    plain = _record(plain, F.expr("substring(cast(value as binary), head_bytes + 1, length)"))
    split = kept.where("not whole").select("file", "start", "next", F.col("idx").alias("first"))
    until = kept.select("file", F.col("start").alias("next"), F.col("idx").alias("until"))
    split = split.join(until.hint("merge"), ["file", "next"], "left").withColumn("until", F.col("until") - 1)
    last = found.groupBy("file").agg(F.max("idx").alias("last"))
    split = split.join(last, "file").withColumn("idx", F.explode(F.sequence("first", F.greatest("first", F.coalesce("until", "last")))))
    split = workspace.materialize(split.join(found.select("file", "idx", "seq", "bytes").hint("merge"), ["file", "idx"]).select("seq", "first", "idx", "bytes"), "warc-split")
    same = F.when(F.octet_length("value") == F.col("bytes"), F.lit(True)).otherwise(F.raise_error(F.lit(workspace.REREAD)).cast("boolean"))
    # the rows of one record: as large as the record itself
    joined = rows.join(split, "seq").where(same).groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("parts"))
    joined = joined.select("file", F.array_join(F.col("parts.value"), DELIMITER).alias("value"))
    return plain.unionByName(_record(_parse(joined), F.expr("substring(cast(value as binary), head_bytes + 1, length)")))


def page_id(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:([^>]*)>$", 1).try_cast("long")
