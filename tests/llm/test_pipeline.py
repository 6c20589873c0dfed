"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_jaccard import grams
from test_mixing import check as check_mix
from test_pii import base as plain_spans
from test_quality import slow_score

from tidewatch.llm import mixing, pii, quality_fm
from tidewatch.llm.queries import MULTI_RANKS, held_out, op8_mixing, table


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "tokens":
            assert sorted(docs.columns) == sorted(columns)
    total = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * total < seen["quality"].count() <= total
    assert seen["near_duplicates"].count() < seen["quality"].count()
    assert seen["private_data"].count() == seen["near_duplicates"].count()
    left = pii.spans(seen["private_data"]).select(F.explode("base").alias("s")).where("s.kind = 1").count()
    assert left == 0
    words = lambda df: df.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words(seen["mix"]) - words(seen["private_data"])) < 0.05 * words(seen["private_data"])
    assert seen["tokens"].where("not decodes or n_tokens is null").count() == 0 and seen["tokens"].count() == seen["mix"].count()


def test_odd_rows_pass(spark, sf_dir, odd_docs, folder):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = corpus_pipeline.run(spark, folder(documents=odd_docs, labels=labels))
    assert out.where("not decodes").count() == 0 and out.count() > 0


def test_empty_table(spark, sf_dir, odd_docs, folder):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert corpus_pipeline.run(spark, folder(documents=odd_docs.limit(0), labels=labels)).count() == 0


def test_quality_stage_against_all_pairs_of_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    short = [r for r in docs.collect() if len((r.text or "").split()) < 150]
    want = {r.doc_id: slow_score(model, r.text, [r.n_chars]) for r in short}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    sure = {k: v for k, v in want.items() if abs(v - 0.3) > 1e-3}
    assert len(sure) > 30 and {k for k in sure if k in kept} == {k for k, v in sure.items() if v >= 0.3}


def test_near_duplicates_stage_against_all_pairs(spark, sf_dir):
    """Of each class by all pairs exactly one row stays, and rows without words stay."""
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, grams(r.text)) for r in docs.collect()]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                top[root(i)] = root(j)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    group = {doc_id: root(i) for i, (doc_id, _) in enumerate(rows)}
    assert sorted(group[k] for k in kept) == sorted(set(group.values()))


def plain_redacted(text, spans):
    out, at = "", 0
    while spans:
        first = min(spans, key=lambda s: (s[1], s[2]))
        end, inside = first[2], []
        while more := [s for s in spans if s[1] < end or s is first and s not in inside]:
            inside += more
            spans = [s for s in spans if s not in more]
            end = max(s[2] for s in inside)
        longest = max(inside, key=lambda s: s[2] - s[1])
        out, at = out + text[at : first[1]] + f"<{longest[0].upper()}>", end
    return out + text[at:]


def test_private_data_stage_against_plain_patterns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert pii.bootstrap(pii.graph(pii.occurrences(docs))).count() == 0  # so the format rules are all there is here
    out = corpus_pipeline.private_data(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    changed = 0
    for r in docs.collect():
        want = plain_redacted(r.text, plain_spans(r.text)) if r.text else r.text
        changed += want != r.text
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == (len(want) if want is not None else None)
    assert changed > 3


def test_mix_stage_against_targets(spark, sf_dir, documents):
    """The texts hold the words that op8 takes of each document, in order; targets as computed one by one."""
    docs = table(spark, sf_dir, "documents")
    taken = op8_mixing(spark, sf_dir).collect()
    check_mix(documents, taken)
    text, words = {i: t for i, t, _ in documents}, dict.fromkeys((r.doc_id for r in taken), 0)
    for r in corpus_pipeline.mix(spark, docs, sf_dir).collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        words[r.doc_id] += len(own)
        whole = iter(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id]))
        assert all(w in whole for w in own) and r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in taken}


def test_tokens_stage_against_the_library(spark, sf_dir, documents):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(MULTI_RANKS), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    out = {r.doc_id: r for r in corpus_pipeline.tokens(spark, table(spark, sf_dir, "documents"), sf_dir).collect()}
    assert all(np.frombuffer(out[i].ids, "<u4").tolist() == encode(t or "") and out[i].decodes for i, t, _ in documents)
