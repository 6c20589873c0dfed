"""Temporal drift: drawing samples from bins in groups, by policy, without replacement until a bin is used up.

Everything is a function of the sample's place: the policy gives its bin, the number of draws before it in the bin gives
the element, cyclically. Counts per group and bin keep windows to one group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.math import hashed, permuted
from .ordering import WIDTH, ranked


def bins_table(spark: SparkSession, bins: Sequence[tuple[str, object]]) -> DataFrame:
    """(bin_idx, bin_name, value), a row a configured bin."""
    if not bins:
        raise ValueError("no bins are configured")
    rows = [(i, str(n), str(v)) for i, (n, v) in enumerate(bins)]
    return spark.createDataFrame(rows, "bin_idx int, bin_name string, value string")


def assign_bins(df: DataFrame, value: Column, bins: DataFrame) -> DataFrame:
    """df with bin_idx of the first bin of its value; rows of no bin go. Bins are configuration, so they are broadcast."""
    first = bins.groupBy("value").agg(F.min("bin_idx").alias("bin_idx"))
    return df.withColumn("_v", value.cast("string")).join(F.broadcast(first), F.col("_v") == F.col("value")).drop("_v", "value")


def all_or_results(kind: str, output: str) -> Column:
    """What bins are made of: the output column, or one value for everything."""
    if kind not in ("results", "all"):
        raise ValueError(f"unknown bin value {kind}")
    return F.col(output) if kind == "results" else F.lit(0)


def schedule(spark: SparkSession, max_samples: int, size: int) -> DataFrame:
    """(pos, sample_group_id, i) of all draws: whole groups, so the last may pass max_samples."""
    groups = math.ceil(max_samples / size)
    return spark.range(groups * size).select(F.col("id").alias("pos"), F.floor(F.col("id") / size).alias("sample_group_id"), (F.col("id") % size).alias("i"))


def policy_none(draws: DataFrame, bins: int) -> DataFrame:
    return draws.withColumn("bin_idx", (F.col("sample_group_id") % bins).cast("int"))


def policy_random(draws: DataFrame, bins: int, seed: int = 0) -> DataFrame:
    return draws.withColumn("bin_idx", (hashed(seed, F.col("pos")) % bins).cast("int"))


def policy_math(draws: DataFrame, bins: int) -> DataFrame:
    """The group's bin where the floored sine of the place in the group is 0, else the next."""
    step = F.when(F.floor(F.sin("i")) == 0, 0).otherwise(1)
    return draws.withColumn("bin_idx", ((F.col("sample_group_id") + step) % bins).cast("int"))


def quota(percent: float, size: int) -> int:
    """The least count whose share, rounded to two places, reaches the percentage."""
    return next((c for c in range(size + 1) if round(100 * c / size, 2) >= percent), size)


def repeated(percentages: Sequence[float], groups: int, jitter: tuple[int, int] = (0, 1), seed: int = 0) -> list[float]:
    """A schedule of percentages, repeated for `groups` groups; copies move by a whole number from jitter[0] up to, but
    not including, jitter[1]."""
    import hashlib

    span = jitter[1] - jitter[0]
    shift = lambda g: jitter[0] + int(hashlib.md5(f"{seed}:{g}".encode()).hexdigest()[:8], 16) % span
    n = len(percentages)
    return [percentages[g % n] + (shift(g) if g >= n else 0) for g in range(max(groups, n))]


def policy_prevalence(draws: DataFrame, bins: int, size: int, targets: Mapping[int, Sequence[float]], seed: int = 0) -> DataFrame:
    """Targeted bins in configured order up to their share of the group, the rest spread over the other bins. targets:
    percentages by group for each targeted bin; later groups begin them again."""
    if any(not 0 <= b < bins for b in targets):
        raise ValueError("a targeted bin doesn't exist")
    free = [b for b in range(bins) if b not in targets]
    upto, bin_idx = F.lit(0), None
    for b, shares in targets.items():
        counts = F.array(*(F.lit(quota(s, size)) for s in shares))
        upto = upto + F.element_at(counts, (F.col("sample_group_id") % len(shares) + 1).cast("int"))
        bin_idx = F.when(F.col("i") < upto, b) if bin_idx is None else bin_idx.when(F.col("i") < upto, b)
    if free:
        other = F.element_at(F.array(*map(F.lit, free)), (hashed(seed, F.col("pos")) % len(free) + 1).cast("int"))
    else:
        other = F.raise_error(F.lit("every bin is targeted and the targets don't fill the group")).cast("int")
    return draws.withColumn("bin_idx", (bin_idx.otherwise(other) if bin_idx is not None else other).cast("int"))


def numbered(df: DataFrame, pos: str, key: str = "bin_idx", width: int = WIDTH) -> DataFrame:
    """Adds slot, the 0-based place of each row in its bin in order of an integer position."""
    return ranked(df, [key], F.floor(F.col(pos) / width), [pos], "slot")


def shuffled(df: DataFrame, id_col: str, seed: int, key: str = "bin_idx", width: int | None = None) -> DataFrame:
    """Adds slot in a reproducible random order: that of a hash. A bucket is a range of hashes that holds about WIDTH rows."""
    rows = df.withColumn("_h", hashed(seed, F.col(id_col)))
    width = width or max(1, (WIDTH << 32) // max(df.count(), WIDTH))
    return ranked(rows, [key], F.floor(F.col("_h") / width), ["_h", id_col], "slot").drop("_h")


def draw(draws: DataFrame, base: DataFrame, id_col: str, seed: int | None = None) -> DataFrame:
    """draws (pos, sample_group_id, i, bin_idx) with the ids drawn: (pos, sample_group_id, bin_idx, original_id). base
    has (bin_idx, slot, id). The k-th draw of a bin with n rows takes slot k mod n, in the order of the slots; with a seed
    each pass over the bin has an order of its own. An empty bin gives null."""
    taken = ranked(draws, ["bin_idx"], F.col("sample_group_id"), ["i"], "k")
    sizes = base.groupBy("bin_idx").agg(F.count("*").alias("n"))
    taken = taken.join(F.broadcast(sizes), "bin_idx", "left").withColumn("slot", F.expr("try_mod(k, n)"))
    if seed is not None:
        turn = permuted(F.col("slot"), F.col("n"), F.lit(seed), F.col("bin_idx"), F.expr("k div n"))
        taken = taken.withColumn("slot", F.when(F.col("n") > 0, turn))
    out = taken.join(base.select("bin_idx", "slot", F.col(id_col).alias("original_id")), ["bin_idx", "slot"], "left")
    return out.select("pos", "sample_group_id", "bin_idx", "original_id")


def shuffled_groups(drawn: DataFrame, seed: int) -> DataFrame:
    """Deals the ids of each group to its positions in a reproducible random order."""
    order = Window.partitionBy("sample_group_id")
    rows = drawn.withColumn("_to", F.row_number().over(order.orderBy(hashed(seed, F.col("pos")), "pos")) - 1).withColumn("_first", F.min("pos").over(order))
    return rows.withColumn("pos", F.col("_first") + F.col("_to")).drop("_to", "_first")


def timestamps(drawn: DataFrame, start_s: int, unit_s: int) -> DataFrame:
    """Adds timestamp, epoch seconds a unit apart."""
    return drawn.withColumn("timestamp", F.lit(start_s) + F.col("pos") * unit_s)


def reference_rows(drawn: DataFrame, seed: int = 0) -> DataFrame:
    """(id, timestamp, original_id, sample_group_id, pos): rows that refer to a base dataset, with ids from a digest."""
    new = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("pos").cast("string")), 256), 1, 20)
    stamp = F.col("timestamp") if "timestamp" in drawn.columns else F.lit(0).cast("long")
    return drawn.select(new.alias("id"), stamp.alias("timestamp"), "original_id", "sample_group_id", "pos")


def prevalence(df: DataFrame, pos: str, size: int, key: str) -> DataFrame:
    """(sample_group_id, key, percent) of each group of `size` positions: the check of a drift."""
    counts = df.groupBy(F.floor(F.col(pos) / size).alias("sample_group_id"), key).agg(F.count("*").alias("n"))
    return counts.select("sample_group_id", key, F.round(100 * F.col("n") / size, 2).alias("percent"))


def group_sizes(refs: DataFrame) -> DataFrame:
    """One row: num_groups and the size of the first group."""
    counts = refs.groupBy("sample_group_id").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("num_groups"), F.min_by("n", "sample_group_id").alias("group_size"))


#: Drift policies by name: functions of draws, the number of bins, the group size and parameters.
POLICIES = {
    "none": lambda draws, bins, size, p: policy_none(draws, bins),
    "random": lambda draws, bins, size, p: policy_random(draws, bins, p.get("seed", 0)),
    "math": lambda draws, bins, size, p: policy_math(draws, bins),
    "prevalence": lambda draws, bins, size, p: policy_prevalence(draws, bins, size, p["targets"], p.get("seed", 0)),
}


def apply_drift(base: DataFrame, id_col: str, output: str, pos: str, params: Mapping) -> DataFrame:
    """The references of a drifted dataset by configuration: submodule (a name in POLICIES), bins (name, value), bin_value,
    max_num_samples, sample_group_size, seed; bin_shuffle and sample_group_shuffle default to true. Without a submodule,
    or with an unknown one, it is an error."""
    name = params.get("submodule")
    if name not in POLICIES:
        raise ValueError(f"unknown drift policy {name}; known are {sorted(POLICIES)}")
    size, seed, spark = params.get("sample_group_size", 1), params.get("seed", 0), base.sparkSession
    bins = list(params.get("bins", []))
    kind = params.get("bin_value", "results")
    table = bins_table(spark, bins)
    value = all_or_results(kind, output)
    rows = assign_bins(base, value, table)
    mixed = params.get("bin_shuffle", True)
    rows = shuffled(rows, id_col, seed) if mixed else numbered(rows, pos)
    draws = POLICIES[name](schedule(spark, params.get("max_num_samples", 1), size), len(bins), size, params)
    out = draw(draws, rows, id_col, seed if mixed else None)
    return shuffled_groups(out, seed) if params.get("sample_group_shuffle", True) else out
