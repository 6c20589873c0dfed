"""Ranked lexical search with a two-level quantised index.

Documents are dealt to shards of a bounded size. A shard is one row: an inverted index of its own documents, with every
posting at two levels. Level 1 holds its impact as a byte, rounded upward in steps of UNIT; level 2 holds what the exact
whole-number impact needs, the frequency and the document's length. A search reads the shards twice:

1. Sums of bytes times the terms' weights bound every score from above, and one step less for each posting bounds it from
   below. Each shard gives the k greatest lower bounds of each item; their k-th over all shards is the item's threshold.
2. Every document whose upper bound reaches the threshold gets its exact score, in whole numbers. Each shard gives its k
   best; the k best of those are the result. No document that could be among them is left out, whatever the bounds.

Items come in blocks of a bounded size, so a task holds one shard, one block and a strip of sums. The number of rows that
leave the shards is k for each item and shard; Spark keeps the k best of a task before it sends them.

Defined cases: null texts and texts without a term hold none, so they count neither in N nor in L; very long texts are
split into terms whole; repeated documents are documents of their own, as are those with a null id, which come last among
equal scores; repeated rows of one item id and text are one item, and each different text of an item id has a list of its
own; items without a term have none; fewer than k documents with a score above 0 give shorter lists; empty tables give an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

#: Fixed values of the score: impacts are below 10**6; b, and k1 times 1000 and 8, in hundredths.
SCALE, LENGTH, SATURATION, NORM = 1_000_000_000, 75, 1000, 8
#: The step of a byte: 255 of them hold the greatest impact.
UNIT = -(-(SCALE // SATURATION) // 255)
#: Documents and postings of a shard, and items and entries of a block of items, but for a single text with more.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_ITEMS, BLOCK_ENTRIES, STRIP = 4096, 1 << 21, 1024, 1 << 20, 32
#: Distinct terms of the items up to which shards leave out other terms; beyond, they hold all.
MOST_TERMS = 1 << 20
#: Bytes that belong to terms as they are; capital letters are lowered, all other bytes part terms.
_TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_SHARD = "ids array<long>, lengths binary, terms array<binary>, sizes array<int>, at binary, tf binary, docs long, words long"
_INDEX = _SHARD + ", impact binary"
_BLOCK = "items array<long>, terms array<binary>, item binary, term binary, weight binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def impact(tf: np.ndarray, length: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The exact impact of postings before their term's weight."""
    m = 100 - LENGTH + (LENGTH * length * docs) // words
    return (SCALE * tf) // (SATURATION * tf + NORM * m)


def shards(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Inverted lists of exact postings, a row a shard; of the vocabulary's terms only where one is given."""

    def shard(ids: list, lengths: list[int], lists: dict[bytes, tuple[list, list]]) -> pa.RecordBatch:
        order = sorted(lists)
        at = np.concatenate([np.array(lists[t][0], np.int32) for t in order]) if order else np.zeros(0, np.int32)
        tf = np.concatenate([np.array(lists[t][1], np.int32) for t in order]) if order else np.zeros(0, np.int32)
        row = {
            "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": [np.array(lengths, np.int64).tobytes()], "terms": pa.array([order], pa.list_(pa.binary())), "sizes": pa.array([[len(lists[t][0]) for t in order]], pa.list_(pa.int32())),
            "at": [at.tobytes()], "tf": [tf.tobytes()], "docs": pa.array([len(ids)], pa.int64()), "words": pa.array([sum(lengths)], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(row)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, lists, size = [], [], {}, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                for term in counts.keys() & vocabulary if vocabulary is not None else counts:
                    where, often = lists.setdefault(term, ([], []))
                    where.append(len(ids))
                    often.append(counts[term])
                    size += 1
                ids.append(key)
                lengths.append(len(words))
                if len(ids) == shard_docs or size >= SHARD_POSTINGS:
                    yield shard(ids, lengths, lists)
                    ids, lengths, lists, size = [], [], {}, 0
        if ids:
            yield shard(ids, lengths, lists)

    workspace.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, _SHARD)


@dataclass(frozen=True)
class Index:
    """shards at both levels; frequencies (term, df); the number of documents with a term, and of all their terms."""

    shards: DataFrame
    frequencies: DataFrame
    docs: int
    words: int


def build(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    exact = workspace.materialize(shards(docs, vocabulary, id_col, text_col, shard_docs), "shards")
    total = exact.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    n_docs, n_words = total["docs"], total["words"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = []
            for lengths, at, tf in zip(*(batch.column(c).to_pylist() for c in ("lengths", "at", "tf")), strict=True):
                length = np.frombuffer(lengths, np.int64)[np.frombuffer(at, np.int32)]
                exactly = impact(np.frombuffer(tf, np.int32).astype(np.int64), length, n_docs, n_words)
                level.append((-(-exactly // UNIT)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level, pa.binary())], [*batch.schema.names, "impact"])

    both = workspace.materialize(exact.mapInArrow(task, _INDEX), "index")
    df = both.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.sizes").alias("df"))
    return Index(both, workspace.materialize(df, "frequencies"), n_docs, n_words)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, often) of items; item numbers the different texts of all ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = sorted(Counter(terms_of(text)).items())
                if counts:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([number] * len(counts), pa.int64()), "item_id": pa.array([key] * len(counts), pa.int64()), "term": pa.array([t for t, _ in counts], pa.binary()), "often": pa.array([n for _, n in counts], pa.int64())})

    once = workspace.materialize(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct(), "items")
    numbered = once.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return workspace.materialize(numbered.mapInArrow(task, "item long, item_id long, term binary, often long"), "item-terms")


def _blocks(terms: DataFrame, index: Index) -> DataFrame:
    """Blocks of items: entries (item's place, term's place, weight times the term's repeats)."""
    docs = index.docs
    rows = terms.join(index.frequencies, "term").groupBy("item").agg(F.collect_list("term").alias("term"), F.collect_list("often").alias("often"), F.collect_list("df").alias("df"))

    def block(items: list, held: list) -> pa.RecordBatch:
        order = sorted({t for row in held for t, _ in row})
        place = {t: i for i, t in enumerate(order)}
        flat = [(i, place[t], w) for i, row in enumerate(held) for t, w in row]
        item, term, weight = (np.array([x[k] for x in flat], kind).tobytes() for k, kind in enumerate((np.int32, np.int32, np.int64)))
        return pa.RecordBatch.from_pydict({"items": pa.array([items], pa.list_(pa.int64())), "terms": pa.array([order], pa.list_(pa.binary())), "item": [item], "term": [term], "weight": [weight]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held, size = [], [], 0
        for batch in batches:
            for number, term, often, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [(t, n * int(math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))))) for t, n, d in zip(term, often, df, strict=True)]
                items.append(number)
                held.append(row)
                size += len(row)
                if len(items) == BLOCK_ITEMS or size >= BLOCK_ENTRIES:
                    yield block(items, held)
                    items, held, size = [], [], 0
        if items:
            yield block(items, held)

    return workspace.materialize(rows.mapInArrow(task, _BLOCK), "item-blocks")


def _strips(row: dict) -> Iterator[tuple[np.ndarray, list[list[tuple[slice, int]]], np.ndarray]]:
    """(items, each one's posting lists with weights, upper bounds) of a pair of a shard and a block, strip by strip."""
    at, level = np.frombuffer(row["at"], np.int32), np.frombuffer(row["impact"], np.uint8)
    ends = np.cumsum([0, *row["sizes"]])
    lists = {t: slice(int(ends[i]), int(ends[i + 1])) for i, t in enumerate(row["terms"])}
    found = [lists.get(t) for t in row["q_terms"]]
    item, term, weight = np.frombuffer(row["item"], np.int32), np.frombuffer(row["term"], np.int32), np.frombuffer(row["weight"], np.int64)
    names = np.array(row["items"], np.int64)
    for start in range(0, len(names), STRIP):
        lo, hi = np.searchsorted(item, [start, start + STRIP])
        own = names[start : start + STRIP]
        used: list[list] = [[] for _ in own]
        upper = np.zeros((len(own), row["docs"]), np.int64)
        lower = np.zeros_like(upper)
        for i, t, w in zip((item[lo:hi] - start).tolist(), term[lo:hi].tolist(), weight[lo:hi].tolist(), strict=True):
            if found[t] is not None and w > 0:
                used[i].append((found[t], w))
                where, steps = at[found[t]], level[found[t]].astype(np.int64)
                upper[i, where] += w * UNIT * steps
                lower[i, where] += w * UNIT * np.maximum(steps - 1, 0)
        yield own, used, np.stack([upper, lower])


def _lower(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for own, _, bounds in _strips(row):
                    lower = bounds[1]
                    n = min(k, lower.shape[1])
                    best = np.partition(lower, lower.shape[1] - n, axis=1)[:, lower.shape[1] - n :]
                    rows, columns = np.nonzero(best > 0)
                    yield pa.RecordBatch.from_pydict({"item": pa.array(own[rows]), "bound": pa.array(best[rows, columns])})

    return task


def _exact(k: int, docs: int, words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, tf, length = np.frombuffer(row["at"], np.int32), np.frombuffer(row["tf"], np.int32), np.frombuffer(row["lengths"], np.int64)
                least = dict(zip(row["items"], row["least"], strict=True))
                for own, used, bounds in _strips(row):
                    for i, name in enumerate(own.tolist()):
                        open_ = bounds[0, i] >= max(least[name], 1)
                        if not open_.any():
                            continue
                        score = np.zeros(len(length), np.int64)
                        for part, weight in used[i]:
                            mine = open_[at[part]]
                            where = at[part][mine]
                            score[where] += weight * impact(tf[part][mine].astype(np.int64), length[where], docs, words)
                        hits = np.flatnonzero(open_ & (score > 0)).tolist()
                        hits.sort(key=lambda d: (-score[d], row["ids"][d] is None, row["ids"][d] or 0))
                        hits = hits[:k]
                        yield pa.RecordBatch.from_pydict({"item": pa.array([name] * len(hits), pa.int64()), "doc_id": pa.array([row["ids"][d] for d in hits], pa.int64()), "score": pa.array(score[hits].tolist(), pa.int64())})

    return task


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item_id, rank from 1, doc_id, score) of each item's k best documents."""
    terms = item_terms(items, item_col, text_col)
    known = terms.select("term").distinct()
    # the set goes into the tasks only if its size, checked here, is bounded; otherwise shards hold every term
    vocabulary = frozenset(bytes(r.term) for r in known.collect()) if known.count() <= MOST_TERMS else None
    index = build(docs, vocabulary, id_col, text_col, shard_docs)
    blocks = _blocks(terms, index)
    # all items against all shards, block by block: a row a pair, however many documents a shard holds
    level1 = index.shards.select("sizes", "at", "terms", "impact", "docs").crossJoin(blocks.withColumnRenamed("terms", "q_terms"))
    bounds = level1.mapInArrow(_lower(k), "item long, bound long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))
    least = bounds.withColumn("r", place).where(F.col("r") <= k).groupBy("item").agg(F.min(F.when(F.col("r") == k, F.col("bound"))).alias("least"))
    numbered = blocks.withColumn("block", F.monotonically_increasing_id())
    numbered = workspace.materialize(numbered, "numbered-blocks")
    each = numbered.select("block", F.posexplode("items").alias("p", "item")).join(least, "item", "left")
    ordered = F.array_sort(F.collect_list(F.struct("p", F.coalesce("least", F.lit(0)).cast("long").alias("least"))))
    limits = workspace.materialize(each.groupBy("block").agg(F.transform(ordered, lambda x: x["least"]).alias("least")).join(numbered, "block").drop("block"), "limits")
    both = index.shards.drop("words").crossJoin(limits.withColumnRenamed("terms", "q_terms"))
    found = both.mapInArrow(_exact(k, index.docs, index.words), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(terms.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
