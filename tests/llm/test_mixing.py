"""Mixing against an independent computation of sizes and targets."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import mixing
from tidewatch.llm.queries import op8_mixing

WORD = r"[^\x20\x09-\x0D]+"


def check(rows, out):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(WORD, text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed, total = {}, set(), sum(size.values())
    while True:
        left, live = total - sum(3 * size[s] for s in fixed), [s for s in order if s not in fixed]
        target = {s: 3 * size[s] if s in fixed else left * weight[s] / sum(weight[x] for x in live) for s in order}
        over = {s for s in live if target[s] > 3 * size[s]}
        if not over or not live:
            break
        fixed |= over
    source_of, taken = {}, Counter()
    for doc_id, _, source in rows:
        source_of[doc_id] = source
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(re.findall(WORD, t or ""))) for i, t, _ in rows)
    for r in out:
        s = source_of[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r.taken <= 3 * r.size
    for s in order:
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK + 0.01 * target[s]


def test_targets(spark, sf_dir, documents):
    first, again = (sorted(op8_mixing(spark, sf_dir).collect()) for _ in range(2))
    assert first == again
    check(documents, first)


def test_odd_rows(spark, odd_docs, folder):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    out = op8_mixing(spark, folder(documents=odd_docs)).collect()
    assert len(out) == len(rows)
    check(rows, out)


def test_empty_table(spark, odd_docs, folder):
    assert op8_mixing(spark, folder(documents=odd_docs.limit(0))).count() == 0


def test_permutations(spark):
    for n in (1, 2, 7, 1000):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in out) == list(range(n))


def test_mixed_texts_hold_the_words_taken(spark, odd_docs, folder):
    docs = spark.read.parquet(folder(documents=odd_docs) + "/documents.parquet").where("doc_id is not null")
    made = mixing.mix(docs, (5, 2, 1), block=16)
    want = Counter()
    for r in made.taken().collect():
        want[r.id] += r.taken
    got = Counter()
    for r in mixing.mixed(docs, made).collect():
        got[r.doc_id] += len(re.findall(WORD, r.text))
    assert +got == +want


def sized(spark, rows):
    return spark.createDataFrame([(i, i, s, i * 7919, n) for i, (s, n) in enumerate(rows)], "row long, id long, source string, hash long, size long")


def test_water_fill_by_hand(spark):
    sources = mixing.quotas(sized(spark, [("a", 10), ("b", 100), (None, 0)]), [5, 2, 1]).orderBy("number").collect()
    assert [(r.source, r.target) for r in sources] == [("a", 30.0), ("b", 80.0), (None, 0.0)]
    named = mixing.quotas(sized(spark, [("a", 100), ("b", 100), (None, 100)]), {"a": 1, None: 3}).orderBy("number").collect()
    assert [(r.source, r.target) for r in named] == [("a", 75.0), ("b", 0.0), (None, 225.0)]


def test_many_sources_are_ranked_and_filled(spark):
    """As one by one in code-point order, without a list of them on the driver."""
    rows = [(f"s{k * 7919 % 5000:04d}", k % 50) for k in range(5000)] + [("\U0001f600", 9), ("\uffff", 9), (None, 40)]
    out = mixing.quotas(sized(spark, rows), [5, 2, 1]).orderBy("number").collect()
    assert [r.source for r in out] == [*sorted(s for s, _ in rows if s is not None), None] and [r.number for r in out] == list(range(5003))
    size, total = dict(rows), sum(n for _, n in rows)
    target, full = {}, set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        weight = {r.source: (5, 2, 1)[r.number % 3] for r in out if r.source not in full and size[r.source]}
        target = {s: 3 * size[s] if s in full else left * weight.get(s, 0) / max(sum(weight.values()), 1) for s in size}
        over = {s for s in weight if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in out)
    assert [r.first for r in out] == [sum(x.n for x in out[:k]) for k in range(len(out))]


def test_draws_per_shard(spark):
    """Counts sum to both totals, and vary about their expectation as draws without replacement do."""
    sources = mixing.quotas(sized(spark, [("a", 300_000), ("b", 200_000), ("c", 100_000)]), [5, 2, 1], block=16)
    drawn = mixing.draws(sources, 256)
    n = {r.number: r.n for r in sources.collect()}
    counts: dict = {}
    for r in drawn.collect():
        counts[r.shard, r.number] = r.n
    total = sum(n.values())
    shards = -(-total // 256)
    assert {k: sum(counts.get((k, s), 0) for s in n) for k in range(shards)} == {k: min(256, total - 256 * k) for k in range(shards)}
    assert {s: sum(counts.get((k, s), 0) for k in range(shards)) for s in n} == n
    at = {(r.shard, r.number): r["at"] for r in drawn.collect()}
    assert all(v == sum(counts.get((x, s), 0) for x in range(k)) for (k, s), v in at.items() if k < 9)
    for s in n:
        p, full = n[s] / total, range(total // 256)
        z = [(counts.get((k, s), 0) - 256 * p) / (256 * p * (1 - p)) ** 0.5 for k in full]
        assert abs(sum(z) / len(z)) < 0.2 and 0.7 < sum(x * x for x in z) / len(z) < 1.3 and max(map(abs, z)) < 5
    places = mixing.slots(sources, drawn).collect()
    assert len(places) == total == len({(r.shard, r.slot) for r in places}) and Counter((r.shard, r.source) for r in places) == Counter({(k, "abc"[s]): c for (k, s), c in counts.items()})
    assert all(0 <= r.slot < 256 for r in places) and max(Counter((r.source, r["pass"], r.block) for r in places).values()) == 1


def test_the_draw_is_part_of_the_plan(spark, odd_docs, folder):
    out = op8_mixing(spark, folder(documents=odd_docs))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "numbered-draws" in str(sorted(out.inputFiles())) and "first_shard" in plan
    rows = out.collect()
    assert all((r.first_shard is None) == (r.taken == 0) and (r.taken == 0 or 0 <= r.first_shard <= r.last_shard) for r in rows)
