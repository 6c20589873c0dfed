"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tidewatch.llm import components, jaccard
from tidewatch.llm.queries import op5_jaccard


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows):
    """id -> (class id, copy id, links), by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                top[root(i)] = root(j)
    ids = lambda same: min((rows[j][0] for j in range(len(rows)) if same(j) and rows[j][0] is not None), default=None)
    return sorted(
        ((rows[i][0], ids(lambda j, i=i: root(j) == root(i)), ids(lambda j, i=i: j == i or (sets[i] and sets[j] == sets[i])), links[i]) for i in range(len(rows))),
        key=str,
    )


def found(df):
    return sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in df.select("doc_id", "class_id", "copy_id", "n_links").collect()), key=str)


def test_equals_all_pairs(spark, sf_dir, documents):
    assert found(op5_jaccard(spark, sf_dir)) == brute([(i, t) for i, t, _ in documents])


def test_odd_rows(spark, odd_docs, folder):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(op5_jaccard(spark, folder(documents=odd_docs))) == brute(rows)


def test_small_tiles_find_the_same(spark, folder, monkeypatch):
    """Groups larger than a tile lose no link and count none twice."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "PREFIX_TILE", 4)
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(40)] + [(100 + k, " ".join(words)) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(op5_jaccard(spark, folder(documents=df))) == brute(rows)


def test_one_row_a_class_stays(spark, odd_docs, folder):
    docs = spark.read.parquet(folder(documents=odd_docs) + "/documents.parquet")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sum(t is None or not t.strip() for t in texts) == 3
    assert len([t for t in texts if t and t.strip()]) == len({r.class_row for r in jaccard.join(docs).where("node is not null").collect()})


def test_empty_table(spark, odd_docs, folder):
    assert op5_jaccard(spark, folder(documents=odd_docs.limit(0))).count() == 0


def test_every_link_of_a_larger_table(spark, sf_dir):
    """Recall 1 against all pairs, of links and of classes."""
    data = sf_dir.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op5_jaccard(spark, data)) == brute(rows)


def test_floor_reaches_the_target():
    p = jaccard.floor_depth()
    loss = jaccard.sketch_loss(0.8, jaccard.TREES * jaccard.DEPTH)
    assert 0 < loss < 1e-5 and jaccard.meets(0.8, p) - loss >= jaccard.TARGET > jaccard.meets(0.8, p + 1) - loss
    with pytest.raises(ValueError):
        jaccard.floor_depth(threshold=0.01, trees=2)


def test_prefixes_are_shortened_only_where_recall_needs_it(spark):
    """A node among many close copies is closed at full depth; a pair far from all others goes down to the floor."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*words[: 5 * k], f"new{k}", *words[5 * k + 1 :]])) for k in range(60)]
    lone = [f"z{i}" for i in range(60)]
    rows += [(100, " ".join(lone)), (101, " ".join([*lone[:57], "x", "y", "z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    signed = jaccard.workspace.materialize(jaccard.signatures(docs), "signed")
    ids = {r.row: r.id for r in signed.select("row", "id").collect()}
    edges = jaccard.candidate_edges(signed.select("row", "paths", "sketch")).collect()
    deep = {r.depth for r in edges if ids[r.u] < 100}
    assert deep == {jaccard.DEPTH} and {i for r in edges if ids[r.u] < 100 for i in (ids[r.u], ids[r.v])} == set(range(60))
    assert any({ids[r.u], ids[r.v]} == {100, 101} for r in edges)
    every = jaccard.candidate_edges(signed.select("row", "paths", "sketch"), target=0.99)  # one whose floor is the full depth
    assert {r.depth for r in every.collect()} == {jaccard.DEPTH}


def test_recall_estimate(spark):
    df = spark.createDataFrame([(0, 0.0), (5, 5.0), (40, 40.0), (40, 40.1)], "found long, expected double")
    deep, floor = ([r[0] for r in df.select(jaccard.recall(df.found, df.expected, p, 0.8)).collect()] for p in (jaccard.DEPTH, jaccard.floor_depth()))
    assert deep[0] < deep[1] < jaccard.TARGET <= deep[2] and deep[3] < jaccard.TARGET and floor[0] >= jaccard.TARGET


def test_labels_of_large_sets_differ():
    """16 bits of the smallest value itself would be near zero for large sets."""
    import numpy as np

    seeds = jaccard._seeds(256)
    a, b = (np.unique(np.random.default_rng(k).integers(0, 1 << 63, 50_000).astype(np.uint64)) for k in (1, 2))
    same = np.mean(np.frombuffer(jaccard.labels_of(a, *seeds), ">u2") == np.frombuffer(jaccard.labels_of(b, *seeds), ">u2"))
    assert same < 0.05


def test_another_table_on_the_second_read_is_an_error(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(20).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    wrong = docs.withColumn("seen", F.xxhash64(F.lit("other")))
    with pytest.raises(Exception, match="other rows"):
        wrong.where(jaccard.workspace.same_row(F.col("seen"), F.col("text"))).collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 300), (None, 4), (200, 150)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}
    star = spark.createDataFrame([(i, 7) for i in range(8, 30)], "u long, v long")
    assert {r.component for r in components.components(star).collect()} == {7}
    assert components.components(star.limit(0)).count() == 0


def connected(edges, n):
    """The smallest node that each of 0..n-1 is connected to."""
    part = list(range(n))
    for i, j in edges:
        part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    return part


def test_two_tiles_are_joined_by_few_edges():
    """Spanning edges of each tile and those that join the tiles connect what all links connect."""
    rng = np.random.default_rng(3)
    for share in (0.01, 0.03, 0.1, 1.0):
        n, own = 60, rng.integers(4, 6, 60)
        m = np.triu(rng.random((n, n)) < share, 1)
        m |= m.T
        hits = lambda i, rest, m=m: m[i, rest]
        edges = list(jaccard.joining(hits, own))
        assert all(m[i, j] and own[i] != own[j] for i, j in edges)
        alone = [(t[i], t[j]) for t in (np.flatnonzero(own == x) for x in (4, 5)) for i, j in jaccard.spanning(lambda i, rest, t=t: m[t[i], t[rest]], len(t))]
        assert connected(edges + alone, n) == connected(np.argwhere(m), n)
        assert len(edges) + len(alone) == n - len(set(connected(np.argwhere(m), n)))  # no edge too many
        assert share < 1 or len(edges) == 1


def test_rows_of_a_large_group_grow_with_its_size():
    """Four tiles of near copies under one prefix: a row of evidence and an edge a node, and an edge for two tiles."""
    import pyarrow as pa

    tiles, size = 4, 50
    sketch = bytes(jaccard.TREES * jaccard.DEPTH // 2)
    rows = [(0, b"p", a, b, own, 1000 * own + k, sketch) for a in range(tiles) for b in range(a, tiles) for own in {a, b} for k in range(size)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["tree", "prefix", "a", "b", "own", "row", "sketch"])
    made = pa.Table.from_batches(list(jaccard._compare(8, 200, 0.8, jaccard.TREES)(iter([batch]))))
    edges = [(u, v) for u, v in zip(made["u"].to_pylist(), made["v"].to_pylist(), strict=True) if v is not None]
    assert len(edges) == tiles * (size - 1) + tiles * (tiles - 1) // 2 and made.num_rows - len(edges) == tiles * size
    names = sorted({r[5] for r in rows})
    assert set(connected([(names.index(u), names.index(v)) for u, v in edges], len(names))) == {0}
