"""Ranked lexical search against a plain ranking."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from tidewatch.llm import lexical
from tidewatch.llm.queries import op13_lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    df, n, total = Counter(t for _, c in held for t in c), len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, c in held:
            m, score = 25 + (75 * sum(c.values()) * n) // total, 0
            for term in TERM.findall((text or "").translate(LOWER)):
                if c[term]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * ((1000000000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_odd_rows(spark, odd_docs, folder):
    items = [(1, "the quick fox fox"), (1, "the quick fox fox"), (1, "alpha"), (2, None), (3, ""), (4, "ÉTÉ 你好 nowhere"), (5, "one a b c"), (None, "lazy dog"), (6, "0 a.b@ x 1111 " + "alpha beta " * 3000)]
    frame = spark.createDataFrame([(*r, 9, "z") for r in items], "item_id long, text string, item int, term string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(op13_lexical(spark, folder(documents=odd_docs, benchmark=frame))) == plain(docs, items)


def made(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    weight = 1 / np.arange(1, 401)
    return [(i, " ".join(rng.choice(words, int(rng.integers(1, 200)), p=weight / weight.sum()))) for i in range(n)]


def test_small_shards_strips_and_all_terms(spark, monkeypatch):
    docs, items = made(500, 1), made(70, 2)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert got(lexical.search(d, q, shard_docs=16)) == want
    monkeypatch.setattr(lexical, "MOST_TERMS", 5)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    assert got(lexical.search(d, q)) == want


def test_bounds_hold_and_leave_most_documents_out(spark):
    rng = np.random.default_rng(3)
    tf, length = rng.integers(1, 50, 20000), rng.integers(1, 100000, 20000)
    exact = lexical.impact(tf, length, 10**6, 5 * 10**8)
    level = -(-exact // lexical.UNIT)
    assert level.max() <= 255 and (level * lexical.UNIT >= exact).all() and (np.maximum(level - 1, 0) * lexical.UNIT <= exact).all()


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0
