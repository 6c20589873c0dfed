"""Quality rules and the classifier."""

from __future__ import annotations

import re
import zlib

import numpy as np

from tidewatch.llm import quality_fm, quality_rules
from tidewatch.llm.queries import op6_quality_rules, op9_quality_fm, table

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    """Base measures from their definitions."""
    text = text or ""
    words = re.findall(WORD, text)
    windows: dict = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def check_op6(rows, out):
    want: dict = {}
    for doc_id, text in rows:
        m = plain(text)
        want.setdefault(doc_id, []).append((*m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    got: dict = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert not (r.base_failed and r.kept)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_measures(spark, sf_dir, documents):
    check_op6([(i, t) for i, t, _ in documents], op6_quality_rules(spark, sf_dir).collect())


def test_measures_of_odd_rows(spark, odd_docs, folder):
    check_op6([(r.doc_id, r.text) for r in odd_docs.collect()], op6_quality_rules(spark, folder(documents=odd_docs)).collect())


def test_good_documents_stay_and_bad_ones_go(spark, sf_dir):
    kept = {r.doc_id: r.kept for r in op6_quality_rules(spark, sf_dir).collect()}
    labels = table(spark, sf_dir, "labels").collect()
    good, bad = ([kept[r.doc_id] for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.6


def test_em_ranks_rules_by_accuracy():
    rng = np.random.default_rng(1)
    truth = np.where(rng.random(20_000) < 0.7, 1, -1)
    votes = np.stack([np.where(rng.random(20_000) < 0.5, 0, np.where(rng.random(20_000) < p, truth, -truth)) for p in (0.95, 0.9, 0.7)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality_rules.estimate(patterns.astype(float), counts.astype(float))
    assert abs(found.prior - 0.7) < 0.1 and found.accuracy()[0] > found.accuracy()[2]


def test_empty_tables(spark, odd_docs, folder, sf_dir):
    where = folder(documents=odd_docs.limit(0), labels=table(spark, sf_dir, "labels"))
    assert op6_quality_rules(spark, where).count() == 0 and op9_quality_fm(spark, where).count() == 0


def test_classifier_on_held_out_rows(spark, sf_dir):
    data = sf_dir.replace("sf0.001", "sf0.01")
    out = {r.doc_id: r for r in op9_quality_fm(spark, data).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [(out[r.doc_id].predicted, r.quality) for r in table(spark, data, "labels").collect() if out[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9
    assert np.mean([p for p, q in held if q == 1]) > 0.95


def test_classifier_on_odd_rows_without_labels(spark, odd_docs, folder):
    labels = spark.createDataFrame([(999, 1, 0)], "doc_id long, quality int, toxic int")
    out = op9_quality_fm(spark, folder(documents=odd_docs, labels=labels)).collect()
    assert len(out) == odd_docs.count() and {r.score for r in out} == {0.5}


def random_model(extra=1, factors=4, seed=3):
    rng = np.random.default_rng(seed)
    dense = len(quality_fm.STRUCTURE) + extra
    size = quality_fm.BUCKETS + dense
    return quality_fm.Model(0.1, rng.normal(0, 0.1, size).astype("f4"), rng.normal(0, 0.2, (size, factors)).astype("f4"), rng.normal(size=dense).astype("f4"), rng.uniform(0.5, 2, dense).astype("f4"))


def slow_score(model, text, numbers):
    """All pairs one by one, from the definition."""
    words: dict = {}
    for w in re.findall(WORD, text or ""):
        words[w.encode()] = words.get(w.encode(), 0) + 1
    weight = {w: 1 + np.log(c) for w, c in words.items()}
    norm = np.sqrt(sum(x * x for x in weight.values()))
    x = [(zlib.crc32(w) % quality_fm.BUCKETS, v / norm) for w, v in weight.items()]
    shape = [*quality_fm.structure(text), *(np.nan if v is None else np.sign(v) * np.log1p(abs(v)) for v in numbers)]
    x += [(quality_fm.BUCKETS + k, 0.0 if np.isnan(v) else float(np.clip((v - model.mean[k]) / model.spread[k], -5, 5))) for k, v in enumerate(shape)]
    raw = model.bias + sum(float(model.linear[i]) * v for i, v in x)
    raw += sum(float(model.factors[i].astype("f8") @ model.factors[j].astype("f8")) * v * w for a, (i, v) in enumerate(x) for j, w in x[:a])
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def test_scores_are_the_sum_over_all_pairs(spark, monkeypatch):
    """Random weights, explicit pairs of features against the linear-time batches; a strip of any size gives the same."""
    texts = ["one two three two", None, "", "#a b\nb b b\n a", "é 你好 x", "word " * 40, " \t"]
    numbers = [[17.0], [None], [0.0], [-4.0], [float("nan")], [1e6], [None]]
    model = random_model()
    want = [slow_score(model, t, [None if v is not None and np.isnan(v) else v for v in n]) for t, n in zip(texts, numbers, strict=True)]
    assert np.allclose(model.scores(texts, numbers), want, atol=2e-5)
    monkeypatch.setattr(quality_fm, "STRIP", 1)
    assert np.allclose(model.scores(texts, numbers), want, atol=2e-5)
    docs = spark.createDataFrame([(k, t, None if n[0] is None else n[0], "x", 1.0) for k, (t, n) in enumerate(zip(texts, numbers, strict=True))], "doc_id long, text string, n_chars double, score string, id double")
    got = {r.id: r.score for r in quality_fm.score(docs, model).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=2e-5)
    column = docs.select("doc_id", quality_fm.score_of(docs, model).alias("s")).collect()
    assert np.allclose([r.s for r in sorted(column)], want, atol=2e-5)
    absent = {r.id: r.score for r in quality_fm.score(docs.drop("n_chars"), model).collect()}
    assert np.allclose([absent[k] for k in range(len(texts))], [slow_score(model, t, [None]) for t in texts], atol=2e-5)


def test_metadata_alone_can_be_learnt(spark):
    """Equal texts that differ in a column only; labels, lang, source and ids aren't among the columns."""
    docs = spark.createDataFrame([(k, "the same words", 10 if k % 2 else 5000) for k in range(200)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    got = {r.id: r.score for r in quality_fm.score(docs, quality_fm.fit(docs, labels)).collect()}
    assert min(v for k, v in got.items() if k % 2) > 0.8 and max(v for k, v in got.items() if not k % 2) < 0.2
    assert not set(quality_fm.METADATA) & {"quality", "toxic", "lang", "source", "doc_id"}


def test_kept_against_a_plain_em(spark, sf_dir):
    """The votes, the estimation and the posterior again, document by document."""
    out = op6_quality_rules(spark, sf_dir).collect()
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"))
    votes = {r.id: tuple(r.votes) for r in judged.select("id", "votes").collect()}
    measured = {r.id: r.asDict() for r in judged.collect()}
    rule = lambda text, m: bool(eval(text.replace("false", "False").replace("<>", "!="), {}, m))  # noqa: E731,S307
    for doc_id, m in measured.items():
        assert votes[doc_id] == tuple(-1 if rule(r.bad, m) else 1 if rule(r.good, m) else 0 for r in quality_rules.RULES)
    docs, start = [r.doc_id for r in out], quality_rules.START
    prior, p = 0.8, [[list(start[0]), list(start[1])] for _ in quality_rules.RULES]
    post = {}
    for _ in range(200):
        for d in docs:
            like = [1 - prior, prior]
            for j, v in enumerate(votes[d]):
                like = [like[y] * p[j][y][v + 1] for y in (0, 1)]
            post[d] = like[1] / sum(like)
        prior = min(max(sum(post.values()) / len(docs), 0.05), 0.95)
        for j in range(len(p)):
            new = [[0.02 * len(docs) * x for x in start[y]] for y in (0, 1)]
            for d in docs:
                new[0][votes[d][j] + 1] += 1 - post[d]
                new[1][votes[d][j] + 1] += post[d]
            new = [[x / sum(row) for x in row] for row in new]
            new[1][0], new[0][2] = min(new[1][0], new[0][0]), min(new[0][2], new[1][2])
            p[j] = [[x / sum(row) for x in row] for row in new]
    close = [r for r in out if abs(r.p_good - 0.5) < 1e-4]
    assert len(close) < 3 and all(r.kept == (not r.base_failed and post[r.doc_id] >= 0.5) for r in out if r not in close)


def test_an_id_of_many_rows_trains_once(spark, monkeypatch):
    """max_rows bounds what goes to the driver, however many rows hold a labelled id."""
    rows = [(1, f"the same words {k % 3}") for k in range(300)] + [(k, f"words of text {k}") for k in range(2, 7)] + [(7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_fm, "train", lambda data: seen.append(data))
    for parts in (1, 7):
        quality_fm.fit(docs.repartition(parts), labels)
    assert [len(x) for x in seen] == [7, 7]
    assert all(np.array_equal(a, b, equal_nan=True) for x, y in zip(*seen, strict=True) for a, b in zip(x[:3], y[:3], strict=True))
