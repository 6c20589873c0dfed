"""Mixing sources to target weights with DataFrame functions only.

The words of a source, its documents one after another in the order of a hash, are packed into blocks of a fixed number
of words. The mix has slots, dealt to output shards of a fixed number of slots; a slot takes one block.

1. Sources are ranked and their targets found as a table: the weights' common level, up to which every source is filled,
   rises in a few aggregations. However many sources there are, only sums visit the driver.
2. The number of slots of each source in each shard is drawn: every slot of a source goes to a place of the mix by a
   pseudorandom permutation of all places, and places are counted by shard and source. These are multinomial draws per
   shard, conditioned on every source getting its target in total and every shard its slots, so nothing is left to mend.
3. The slots of a shard are made from those counts: prefix sums over shards number a source's slots, and a permutation
   per source and pass maps the numbers to its blocks, so a block comes once in each full pass and never twice in one.
4. Slots and blocks are joined by (source, block index).

Permutations are swap-or-not networks over 0..n-1: exact for every n, a function of (seed, source, pass) alone, so reruns
agree and a lost executor's part is recomputed alike. Positions and numbers come from prefix sums over trees, 64 children
a node: no window, join key or task holds a whole source, however much of the input is one source.

Defined cases: a null text has size 0 and takes no words, as an empty one; a very long text is cut over as many blocks as
it fills and its words stay in order; a null source is a source of its own, last; null and repeated ids are rows like
others, each with its own place; texts whose hashes tie go by row; an empty table gives an empty mix; only the named
columns are read, so others never clash. The table must give the same rows in the same order when it is read again, as
written tables do; a row that is another one then is an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import permuted
from . import workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Words a block, slots an output shard, and slots made by one row of work.
BLOCK, SHARD_SLOTS, CHUNK = 128, 4096, 256
#: Chunks a task, and most tasks, that make slots.
TASK_CHUNKS, MOST_TASKS = 64, 20_000
_FAN_BITS = 6


def word_count(text: Column) -> Column:
    """Number of words, runs of characters that aren't ASCII white space: word ends, plus one if the text ends in one."""
    white = " \t\n\x0b\x0c\r"
    marked = F.translate(text, white, " " * len(white))
    return F.coalesce(F.regexp_count(marked, F.lit("[^ ]+")), F.lit(0)).cast("long")


def _before(rows: DataFrame, bits: int) -> DataFrame:
    """rows (source, node, sum), unique by both, nodes of `bits` bits -> (source, node, before): the sum of all smaller
    nodes of the source."""
    up = max(bits - _FAN_BITS, 0)
    rows = rows.withColumn("parent", F.shiftright("node", bits - up))
    within = Window.partitionBy("source", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("sum").over(within), F.lit(0)))
    if not up:
        return rows.select("source", "node", "before")
    above = rows.groupBy("source", F.col("parent").alias("node")).agg(F.sum("sum").alias("sum"))
    above = _before(above, up).select(F.col("source").alias("s"), F.col("node").alias("parent_node"), F.col("before").alias("above"))
    joined = rows.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("parent") == F.col("parent_node")))
    return joined.select("source", "node", (F.col("before") + F.col("above")).alias("before"))


def positions(rows: DataFrame, count: int) -> DataFrame:
    """Adds `at`, the words of the source before each row of rows (source, row, hash, size, ...), of which there are
    `count`: about 16 rows a leaf, 64 nodes a window."""
    bits = max(1, math.ceil(math.log2(max(count, 1) / 16 + 1)))
    rows = rows.withColumn("node", F.shiftrightunsigned("hash", 64 - bits))
    leaves = _before(rows.groupBy("source", "node").agg(F.sum("size").alias("sum")), bits)
    leaves = leaves.select(F.col("source").alias("s"), F.col("node").alias("leaf"), "before")
    within = Window.partitionBy("source", "node").orderBy("hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(leaves, F.col("source").eqNullSafe(F.col("s")) & (F.col("node") == F.col("leaf")))
    return joined.withColumn("at", F.col("inner") + F.col("before")).drop("node", "inner", "s", "leaf", "before")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, id, source, hash, size) per row of docs, written out; row numbers the rows of docs, a table that is read."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"), word_count(F.col(text_col)).alias("size"))
    return workspace.materialize(rows, "sizes")


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows before, for rows (part, place, ...) in the order of both. A window holds one part,
    another a row a part."""
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum(value).alias("sum"))
    parts = parts.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    return rows.withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0))).join(parts, "part").withColumn(name, F.col("base") + F.col("inner")).drop("base", "inner")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which sources (cap, weight), each filled to level * weight but not above its cap, hold total. It rises
    from where no source is full; those that a level fills share no more."""
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        held, weight = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            return level
        now = (total - held) / weight
        if now <= level:
            return level
        level = now


def quotas(sizes: DataFrame, weights: Sequence[float] | dict[str | None, float], share: float = 1.0, most: float = 3.0, block: int = BLOCK) -> DataFrame:
    """A row per source, written out: (source, number: its rank in code-point order, null last, size, weight, target, blocks,
    n: slots, first: the slots of all before). weights by source, or a sequence to repeat in that order. The targets sum
    to share of all words, as far as `most` times each source allows; the excess is reshared by weight."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    ranked = sums.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    ranked = workspace.materialize(ranked, "source-sums")
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    ranked = _running(ranked.withColumn("place", F.row_number().over(order)).withColumn("one", F.lit(1).cast("long")), "one", "number")
    if isinstance(weights, dict):
        listed = sizes.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, weight double")
        ranked = ranked.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["weight"])  # configuration
    else:
        ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("size") * F.lit(float(most)))
    ranked = workspace.materialize(ranked.drop("one"), "source-ranks")
    total = (ranked.agg(F.sum("size")).first()[0] or 0) * share
    level = F.lit(water_level(ranked.where("size > 0 and weight > 0"), total))
    ranked = ranked.withColumn("target", F.when(F.col("size") > 0, F.least(level * F.col("weight"), F.col("cap"))).otherwise(0.0))
    ranked = ranked.withColumn("blocks", F.expr(f"(size + {block - 1}) div {block}"))
    slots = F.least(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("size"))), F.floor(F.col("blocks") * F.lit(float(most))))
    ranked = ranked.withColumn("n", F.coalesce(slots, F.lit(0)).cast("long"))
    return workspace.materialize(_running(ranked, "n", "first").select("source", "number", "size", "weight", "target", "blocks", "n", "first"), "sources")


def _tasks(slots: int) -> int:
    """A stated number of partitions, where few bytes become many slots; MOST_TASKS bounds what the driver schedules."""
    return min(max(-(-slots // (CHUNK * TASK_CHUNKS)), 1), MOST_TASKS)


def draws(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(number, shard, n: slots of the source in the shard, at: its slots in all shards before), written out; n sums to
    the source's slots and, but in the last shard, to shard_slots."""
    total = sources.agg(F.sum("n")).first()[0] or 0
    chunks = sources.where("n > 0").select("number", "first", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")).alias("chunk")).repartition(_tasks(total), "number", "chunk")
    mine = chunks.withColumn("j", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(n, (chunk + 1) * {CHUNK}) - 1)")))
    place = permuted(F.col("first") + F.col("j"), F.lit(max(total, 1)), F.lit(seed))
    counts = mine.select("number", place.alias("place")).groupBy("number", F.expr(f"place div {shard_slots}").alias("shard")).agg(F.count("*").alias("n"))
    counts = workspace.materialize(counts, "draws")
    bits = max(1, (total // shard_slots).bit_length())
    before = _before(counts.select(F.col("number").alias("source"), F.col("shard").alias("node"), F.col("n").alias("sum")), bits)
    numbered = counts.join(before.select(F.col("source").alias("number"), F.col("node").alias("shard"), F.col("before").alias("at")), ["number", "shard"])
    return workspace.materialize(numbered, "numbered-draws")


def slots(sources: DataFrame, drawn: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, slot, source, pass, block) of the whole mix, from the draws of each shard."""
    in_shard = Window.partitionBy("shard").orderBy("number")  # at most as many rows as a shard has slots
    before = F.sum("n").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    held = F.sum("n").over(Window.partitionBy("shard"))
    rows = drawn.withColumn("start", before).withColumn("held", held).join(sources.select("number", "source", "blocks"), "number")
    rows = rows.repartition(_tasks(sources.agg(F.sum("n")).first()[0] or 0), "number", "shard")
    rows = rows.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("j", F.col("at") + F.col("i")).withColumn("pass", F.expr("j div blocks"))
    index = permuted(F.expr("j % blocks"), F.col("blocks"), F.lit(seed), F.col("source"), F.col("pass"))
    slot = permuted(F.col("start") + F.col("i"), F.col("held"), F.lit(seed), F.lit("slot"), F.col("shard"))
    return rows.select("shard", slot.alias("slot"), "source", "pass", index.alias("block"))


def pieces(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, source, block, from, words): the words [from, from + words) of each row in each of its blocks."""
    placed = positions(sizes, sizes.count()).where("size > 0")
    spread = placed.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    start = F.greatest(F.col("block") * block, F.col("at"))
    end = F.least((F.col("block") + 1) * block, F.col("at") + F.col("size"))
    return spread.select("row", "source", "block", (start - F.col("at")).alias("from"), (end - start).alias("words"))


@dataclass(frozen=True)
class Mix:
    """sizes: a row per row of the input; sources: sizes and targets; drawn: slots by shard and source; slots: the mix;
    pieces: what blocks hold."""

    sizes: DataFrame
    sources: DataFrame
    drawn: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def blocks(self) -> DataFrame:
        """The mix in full: a row per slot and piece of a document, (shard, slot, pass, row, from, words)."""
        left, right = self.slots.alias("a"), self.pieces.hint("merge").alias("b")  # neither side's size is bounded
        same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))
        return left.join(right, same).select("shard", "slot", "pass", "row", "from", "words")

    def taken(self) -> DataFrame:
        """sizes with taken, the words that the mix takes of a row, and the first and last shard they go to. Uses are counted
        by block before the join."""
        uses = self.slots.groupBy("source", "block").agg(F.count("*").alias("uses"), F.min("shard").alias("low"), F.max("shard").alias("high")).alias("a")
        right = self.pieces.hint("merge").alias("b")
        same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))
        used = uses.join(right, same).groupBy("row").agg(F.sum(F.col("uses") * F.col("words")).alias("taken"), F.min("low").alias("first_shard"), F.max("high").alias("last_shard"))
        out = self.sizes.join(used, "row", "left")
        return out.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mix(docs: DataFrame, weights: Sequence[float] | dict[str | None, float], share: float = 1.0, most: float = 3.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> Mix:
    """Plans the mix of docs (doc_id, text, source)."""
    sizes = sized(docs)
    sources = quotas(sizes, weights, share, most, block)
    drawn = draws(sources, shard_slots, seed)
    return Mix(sizes, sources, drawn, slots(sources, drawn, seed), pieces(sizes, block))


def mixed(docs: DataFrame, made: Mix, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mix as documents: for every pass over its source that takes words of a row, the row with the text of those
    words - the whole text where all are taken, else its words in order with the white space after each."""
    row, parts, turn, seen = (workspace.fresh(docs, x) for x in ("mix_row", "mix_parts", "mix_pass", "mix_seen"))
    uses = made.blocks().groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "words"))).alias(parts), F.sum("words").alias("n"))
    uses = uses.join(made.sizes.select("row", "size", "hash"), "row")
    uses = uses.select(F.col("row").alias(row), F.col("pass").alias(turn), F.col("hash").alias(seen), F.when(F.col("n") < F.col("size"), F.col(parts)).alias(parts))
    uses = workspace.materialize(uses, "uses")
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    some = F.array_join(F.flatten(F.transform(parts, lambda x: F.slice(words, (x["from"] + 1).cast("int"), x["words"].cast("int")))), "")
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(uses.hint("merge"), row).where(workspace.same_row(F.col(seen), F.col(id_col), F.col(text_col)))
    return joined.withColumn(text_col, F.when(F.col(parts).isNull(), F.col(text_col)).otherwise(some)).select(*docs.columns)
