"""Order without a global window: ranks, positions, sliding frames and order statistics over bounded partitions."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Values of an integer key that share a bucket; children of a node of the tree of counts.
WIDTH, FAN = 1 << 16, 4096
#: Rows of a range partition that `ranked_in_order` aims at.
PART_ROWS = 1 << 20


def starts(counts: DataFrame, keys: Sequence[str], bucket: str = "_bucket", n: str = "_n") -> DataFrame:
    """counts (keys, bucket: a whole number, n) with `_before`, the sum of n over the lower buckets of the same keys.

    Counts are summed up a tree: a node has the FAN buckets, or nodes, whose numbers agree but for the last digit to base
    FAN. A window holds the children of one node, at most FAN rows however many buckets there are and however their
    numbers are spread, and the tree is as deep as the numbers' range needs. A node's own start comes down by a join."""
    spread = counts.agg(F.min(bucket).alias("low"), F.max(bucket).alias("high")).first()
    low, reach = spread["low"], (spread["high"] - spread["low"] if spread["low"] is not None else 0)
    levels = [counts.select(*keys, (F.col(bucket) - F.lit(low or 0)).cast("long").alias("_node"), F.col(n).alias("_sum"))]
    while reach >= FAN:
        reach //= FAN
        levels.append(levels[-1].groupBy(*keys, F.expr(f"_node div {FAN}").alias("_node")).agg(F.sum("_sum").alias("_sum")))
    known = None
    for level in reversed(levels):
        parent = F.expr(f"_node div {FAN}").alias("_parent")
        own = Window.partitionBy(*keys, "_parent").orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
        rows = level.select(*keys, "_node", "_sum", parent).withColumn("_own", F.coalesce(F.sum("_sum").over(own), F.lit(0)))
        if known is not None:
            up = known.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_node").alias("_up"), F.col("_before").alias("_above"))
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            rows = rows.join(up, [*same, F.col("_parent") == F.col("_up")]).withColumn("_own", F.col("_own") + F.col("_above"))
        known = rows.select(*keys, "_node", F.col("_own").alias("_before"))
    return known.select(*keys, (F.col("_node") + F.lit(low or 0)).alias(bucket), "_before")


def ranked(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row within its keys, ordered by (bucket, order). Buckets are whole numbers that ascend
    with the order. One window holds the rows of one bucket; the counts of the buckets are summed up a tree."""
    rows = df.withColumn("_bucket", bucket.cast("long"))
    counts = written(rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")), "bucket-counts")
    before = starts(counts, keys).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), "_before")
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = rows.join(before, [*same, F.col("_bucket") == F.col("_b")]).withColumn(name, (F.col("_before") + within).cast("long"))
    return out.select(*df.columns, name)


def with_position(df: DataFrame, key: str, name: str = "pos", width: int = WIDTH) -> DataFrame:
    """Adds dense positions from 0 by a unique integer key."""
    return ranked(df, [], F.floor(F.col(key) / width), [key], name)


def ranked_in_order(df: DataFrame, order: Sequence[str], name: str = "rank", part_rows: int = PART_ROWS) -> DataFrame:
    """Adds 0-based ranks in the order of any columns: Spark deals the rows by range, in as many parts as their number asks
    for, and the parts are the buckets. They are written once, so that a task that runs again finds them as they were.
    With a unique column last in the order, equal names are dealt over parts too."""
    parts = -(-df.count() // part_rows)
    dealt = df.repartitionByRange(max(parts, 1), *order).withColumn("_part", F.spark_partition_id())
    return ranked(written(dealt, "ordered"), [], F.col("_part"), order, name).drop("_part")


def sliding(df: DataFrame, pos: str, size: int, width: int = WIDTH, keys: Sequence[str] = ()) -> tuple[DataFrame, Column, Window]:
    """Rows with their chunk and copies of each chunk's last size - 1 rows in the next one; own marks the originals.
    Aggregates over the window see the `size` latest rows by dense position; keep `own` rows afterwards."""
    width = max(width, size)
    home = F.floor(F.col(pos) / width)
    chunks = F.when(F.col(pos) % width >= width - (size - 1), F.array(home, home + 1)).otherwise(F.array(home))
    rows = df.withColumn("_chunk", F.explode(chunks))
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-(size - 1), 0)
    return rows, F.col("_chunk") == F.floor(F.col(pos) / width), window


# order statistics

#: Bits of a digit; 4 digits make a key. Keys that the driver may hold.
DIGIT, FEW = 16, 1 << 16
_INFINITE, _NOT = 0x7FF << 52, 0x7FF8 << 48


def order_keys(df: DataFrame, column: str) -> DataFrame:
    """(key): a whole number for each double of a column that isn't null, in the doubles' order (as Spark's: NaN after
    infinity, both zeros alike): its IEEE 754 bits without the sign, negated for negative ones.

    The bits come from exact arithmetic, as powers of two are exact: the exponent by a logarithm, mended by one where that is
    off, and the rest as a fraction of 2**52. Each step is a column of its own, so generated code computes it once."""
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null").select(F.abs("x").alias("size"), (F.col("x") < 0).alias("below"))
    rows = rows.withColumn("guess", F.least(F.greatest(F.coalesce(F.floor(F.log2("size")), F.lit(-1022)), F.lit(-1022)), F.lit(1023)).cast("int"))
    rows = rows.withColumn("half", F.expr("guess div 2"))
    rows = rows.withColumn("scaled", F.col("size") * F.pow(F.lit(2.0), -F.col("half")) * F.pow(F.lit(2.0), F.col("half") - F.col("guess")))
    rows = rows.withColumn("step", F.when(F.col("scaled") >= 2, 1).when((F.col("scaled") < 1) & (F.col("guess") > -1022), -1).otherwise(0))
    rows = rows.withColumn("part", F.col("scaled") * F.when(F.col("step") == 1, 0.5).when(F.col("step") == -1, 2.0).otherwise(1.0))
    whole = F.lit(1 << 52)
    real = F.isnan("size") | (F.col("size") == float("inf")) | (F.col("size") == 0)
    # what isn't a finite number other than 0 never reaches the arithmetic
    bits = F.when(F.isnan("size"), F.lit(_NOT)).when(F.col("size") == 0, F.lit(0).cast("long")).when(real, F.lit(_INFINITE))
    bits = bits.when(F.col("part") < 1, (F.col("part") * float(1 << 52)).cast("long"))
    bits = bits.otherwise((F.col("guess") + F.col("step") + 1023).cast("long") * whole + ((F.col("part") - 1) * float(1 << 52)).cast("long"))
    return rows.withColumn("bits", bits).select(F.when(F.col("below"), -F.col("bits")).otherwise(F.col("bits")).alias("key"))


def key_value(key: int) -> float:
    """The double of an order key."""
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def at_ranks(keys: DataFrame, ranks: Sequence[int], key: str = "key") -> dict[int, int | None]:
    """The key at each rank (from 1) of a written table of keys, None where there are fewer, by radix select: a scan counts
    the values of one digit for all ranks at once, within the prefixes that they have been narrowed to, so any number of
    ranks takes at most 64 / DIGIT scans; once at most FEW keys are left under all prefixes, the next scan takes these. A
    window holds the digits of one prefix; the driver holds a number for each rank, and at most FEW keys."""
    spark = keys.sparkSession
    state = [(r, 0, r, 0) for r in sorted(set(ranks)) if r >= 1]  # (rank, prefix so far, rank within it, keys under it)
    found: dict[int, int] = {}
    for level in range(64 // DIGIT):
        if not state:
            break
        shift = 64 - DIGIT * (level + 1)
        rows = keys.where(F.col(key).isNotNull()).select((F.shiftright(key, shift + DIGIT) if level else F.lit(0).cast("long")).alias("p"), F.shiftright(key, shift).alias("digit"), F.col(key).alias("whole"))
        # a row a rank that is asked for, so a broadcast of a known size
        wanted = F.broadcast(spark.sql("select * from values " + ", ".join(f"({r}L, {p}L, {w}L)" for r, p, w, _ in state) + " as t(rank, prefix, want)"))
        if level:
            rows = rows.join(F.broadcast(wanted.select("prefix").distinct()), F.col("p") == F.col("prefix"), "left_semi")
        if level and sum({p: n for _, p, _, n in state}.values()) <= FEW:
            left: dict[int, list[int]] = {}
            for p, whole in rows.select("p", "whole").collect():
                left.setdefault(p, []).append(whole)
            found |= {r: sorted(left[p])[w - 1] for r, p, w, _ in state}
            state = []
            break
        counts = rows.groupBy("p", "digit").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("digit")))
        hit = counts.join(wanted, (F.col("p") == F.col("prefix")) & (F.col("want") > F.col("upto") - F.col("n")) & (F.col("want") <= F.col("upto")))
        state = [(r["rank"], r["digit"], r["want"] - (r["upto"] - r["n"]), r["n"]) for r in hit.select("rank", "digit", "want", "upto", "n").collect()]
    found |= {r: k for r, k, _, _ in state}
    return {r: found.get(r) for r in ranks}


def _keys(df: DataFrame, column: str) -> DataFrame:
    return written(order_keys(df, column), "order-keys")


def nth_smallest(df: DataFrame, column: str, n: Column | int) -> DataFrame:
    """One row (value): the n-th smallest (from 1) of a column of doubles, or null. n may be an aggregate over df. NaN is the
    greatest value, nulls don't count."""
    want = df.agg(n.cast("long").alias("n")).first()[0] if isinstance(n, Column) else n
    found = at_ranks(_keys(df, column), [want])[want] if want and want > 0 else None
    return df.sparkSession.createDataFrame([(None if found is None else key_value(found),)], "value double")


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row (value_0, value_1, ...): exact percentiles of a column of doubles, at shares from 0 to 1, interpolated between
    the two values next to each; null without values. NaN is the greatest value, nulls don't count."""
    keys = _keys(df, column)
    total = keys.count()
    places = [(total - 1) * s for s in shares] if total else []
    found = at_ranks(keys, sorted({r for p in places for r in (int(p) + 1, min(int(p) + 2, total))}))

    def value(place: float) -> float:
        low, high = (key_value(found[r]) for r in (int(place) + 1, min(int(place) + 2, total)))
        return low if place == int(place) or low == high else low + (place - int(place)) * (high - low)

    values = [value(p) for p in places] if total else [None] * len(shares)
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"value_{i} double" for i in range(len(shares))))
