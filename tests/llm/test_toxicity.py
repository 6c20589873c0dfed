"""Toxicity by compression distance: held-out accuracy, windows, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from tidewatch.llm import toxicity
from tidewatch.llm.queries import op12_toxicity, table


def area(score, y):
    """The share of pairs of a toxic and an ordinary text that are in order, ties by half."""
    a, b = score[y == 1], score[y == 0]
    return float(np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])))


def planted(spark, n=600, seed=5):
    """Texts of random syllables; toxic ones hold some of six words, in random places; a copied passage is in both."""
    rng = np.random.default_rng(seed)
    parts, bad = ["an", "er", "th", "in", "on", "re", "sh", "ou", "tion", "ble"], ["gnarf", "blorx", "vizzek", "quolp", "zumbra", "krettig"]
    passage = " ".join("".join(rng.choice(parts, 3)) for _ in range(60))
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(int(rng.integers(30, 300)))]
        toxic = int(i % 5 == 0)
        for _ in range(int(rng.integers(2, 6)) * toxic):
            words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        docs.append((i, " ".join(words) + (" " + passage if i % 7 == 0 else "")))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = planted(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 3 != 0"))
    rows = toxicity.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where("id % 3 = 0").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert area(score, y) > 0.97
    assert np.mean(score[y == 1] >= 0.3) > 0.9 and np.mean(score[y == 0] >= 0.3) < 0.05


def test_query(spark, sf_dir):
    rows = op12_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, sf_dir, "documents").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_windows_cover_a_text():
    for text in (b"  ", b" a ", b" " + b"word " * 1000, b"x" * 1000, b" " + b"y" * 70 + b" z " * 50):
        cut = toxicity.windows(text).astype(int)
        assert cut[0, 0] == 0 and cut[-1].sum() == len(text) and (cut[1:, 0] == cut[:-1].sum(1) - 1).all()
        assert cut[:, 1].max() <= 2 * toxicity.WINDOW + 1


def test_odd_rows(spark, odd_docs, folder):
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, 0), (7, 0, 0), (10, 0, 1), (12, 0, None), (None, 0, 1), (99, 0, 1), (13, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = op12_toxicity(spark, folder(documents=odd_docs, labels=labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


def test_one_class_or_none(spark, odd_docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, empty)).collect()} == {0.0}
    only = spark.createDataFrame([(4, 1), (7, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, only)).collect()} == {1.0}
    assert toxicity.score(odd_docs.limit(0), toxicity.fit(odd_docs, only)).count() == 0
