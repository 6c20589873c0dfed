"""URL filters as a temporal list join: every capture is judged by the list entries active at its fetch time.

Dated changes of a list (an entry is added or removed on a date) become validity intervals per key: the changes of one
key in order of time, each lasting until the next. A capture asks for its own keys - the host and every parent domain -
and the as-of join finds, per key, the one interval that holds its fetch time. The most specific active key decides.

The as-of join is a union of questions (key, time), each once, and of the intervals' starts, in one order of key and time:
the last start before a question, by a running window, is its interval. The union is cut into ranges of that order by
Spark's range partitioning, so a hot key's timeline takes many ranges; what a range needs from those before it is one row a
key. No question meets more than one interval, however long a key's history and however many captures it has.

Defined cases: a capture without a url, host or time gets no verdict; of changes of one key at one time the one that
blocks wins over the one that allows, and a removal comes first; an interval holds from its date on and ends before its
end; repeated captures are judged alike; empty lists leave every capture without a verdict; host letters compare in
lower case; ports and user names are no part of a host; a very long url is read to the end of its host, and a host of many
labels asks for each of its parents. Only the named columns are read, so others never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import workspace


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, or null."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.lower(F.regexp_replace(host, r"\.+$", ""))
    return F.when(host != "", host)


def keys_of(host: Column) -> Column:
    """The host and its parent domains down to two labels (one-label hosts: the host)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """changes (key, at, action: block, allow or remove) -> (key, verdict, since, until), until exclusive or null."""
    strength = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    at_once = changes.where("key is not null and at is not null").groupBy("key", "at").agg(F.max(strength).alias("state"))
    lasts = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    ranges = at_once.withColumn("until", lasts).where("state > 0")
    return ranges.select("key", F.when(F.col("state") == 2, "block").otherwise("allow").alias("verdict"), F.col("at").alias("since"), "until")


def as_of(asked: DataFrame, active: DataFrame) -> DataFrame:
    """asked (key, at) once each, active (key, since, until, verdict) -> (key, at, since, verdict) of the questions whose
    latest interval holds them."""
    listed = active.select("key").distinct()
    questions = asked.join(listed, "key", "left_semi").select("key", "at", F.lit(1).alias("asks"), F.lit(None).cast(active.schema["until"].dataType).alias("until"), F.lit(None).cast("string").alias("verdict"))
    starts = active.select("key", F.col("since").alias("at"), F.lit(0).alias("asks"), "until", "verdict")
    both = workspace.materialize(questions.unionByName(starts), "timeline")
    both = workspace.materialize(both.repartitionByRange("key", "at", "asks").withColumn("part", F.spark_partition_id()), "timeline-ranges")
    start = F.when(F.col("asks") == 0, F.struct(F.col("at").alias("since"), "until", "verdict"))
    last = both.groupBy("key", "part").agg(F.max_by(start, F.when(F.col("asks") == 0, F.col("at"))).alias("own"))  # a row a range, but for ends of keys
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "part", F.last("own", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("key", "part").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("own", F.last(start, ignorenulls=True).over(within)).where("asks = 1").join(carried, ["key", "part"])
    hit = hit.select("key", "at", F.coalesce("own", "carried").alias("i")).where("i is not null and (i.until is null or at < i.until)")
    return hit.select("key", "at", "i.since", "i.verdict")


def judge(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, host, fetched_at, rule: the deciding key or null, since: the deciding entry's date, verdict: block, allow or
    none) for every capture."""
    active = workspace.materialize(intervals(changes), "intervals")
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    # repeated captures share their verdict, so a host and time is asked once; hosts deal the work, not captures
    asked = rows.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    asked = workspace.materialize(asked.withColumn("key", F.explode(keys_of(F.col("host")))), "asked")
    hit = workspace.materialize(as_of(asked.select("key", F.col("fetched_at").alias("at")).distinct(), active), "hits")
    best = F.max_by(F.struct(F.col("key").alias("rule"), "since", "verdict"), F.length("key"))
    found = asked.join(hit.withColumnRenamed("at", "fetched_at"), ["key", "fetched_at"])
    found = workspace.materialize(found.groupBy("host", "fetched_at").agg(best.alias("best")), "verdicts")
    out = rows.join(found, ["host", "fetched_at"], "left")
    return out.select("id", "host", "fetched_at", F.col("best.rule").alias("rule"), F.col("best.since").alias("since"), F.coalesce("best.verdict", F.lit("none")).alias("verdict"))
