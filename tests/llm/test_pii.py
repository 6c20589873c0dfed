"""Personal data against plain regular expressions, and what bootstrapping finds beyond them."""

from __future__ import annotations

import hashlib
import re

from tidewatch.llm import pii
from tidewatch.llm.queries import op10_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    """(kind, start, end) of a text, kinds in their fixed order."""
    needs = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # else plain patterns take quadratic time on long runs
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() if needs[k] in (text or "") for m in re.finditer(p, text or "") if holds(k, m[0])]


def compare(rows, out):
    got: dict = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        spans = base(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for r in got[doc_id]:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in PLAIN], doc_id
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
            order = [(list(PLAIN).index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
            assert order == sorted(order)


def test_base_spans(spark, sf_dir, documents):
    out = op10_pii(spark, sf_dir).collect()
    assert len(out) == len(documents)
    compare([(i, t) for i, t, _ in documents], out)


def test_odd_rows(spark, odd_docs, folder):
    out = op10_pii(spark, folder(documents=odd_docs)).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert len(out) == len(rows)
    compare(rows, out)


def test_nothing_is_found_in_an_empty_table(spark, odd_docs, folder):
    assert op10_pii(spark, folder(documents=odd_docs.limit(0))).count() == 0


def test_context_discovers_unseen_identifiers(spark):
    """Numbers in a form no rule takes, after words that stand before telephone numbers elsewhere."""
    rows = [(i, f"please call me on +1 555 010 {1000 + i} today") for i in range(30)] + [(100, "please call me on 0555/010-42 today"), (200, "the batch of 20240-17 units left")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    new = {r["instance"]: r["kind"] for r in pii.bootstrap(pii.graph(pii.occurrences(docs))).collect()}
    assert new == {"0555/010-42": "phone"}
    tokens = {r.value for r in pii.occurrences(docs).where("kind = 'candidate'").collect()}
    assert tokens == {"0555/010-42", "20240-17"}
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts[100] == "please call me on <PHONE> today" and texts[200] == rows[-1][1] and "<PHONE>" in texts[0]


def test_overlapping_spans_leave_nothing(spark):
    """The rest of an identifier goes with the one that begins before its end."""
    texts = ["mail +14155550100@sms.example.org now", "+14155550100@sms.example.org", "a 4111111111111111@cards.example.org, b 10.0.0.1", "10.0.0.1@host.example.org 10.0.0.2 é c@d.org", "x@y.org +14155550100@sms.example.org"]
    want = ["mail <EMAIL> now", "<EMAIL>", "a <EMAIL>, b <IP>", "<EMAIL> <IP> é <EMAIL>", "<EMAIL> <EMAIL>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert [out[k] for k in range(len(texts))] == want


def test_union_runs_to_the_greatest_end(spark):
    spans = [(4, 0, 6), (3, 2, 4), (1, 5, 14), (2, 14, 16), (4, 18, 20)]  # phone, card inside it, e-mail from its end on
    df = spark.createDataFrame([("0123456789abcdefghijkl", spans)], "text string, found array<struct<kind:int,start:bigint,end:bigint>>")
    assert df.select(pii.redacted(df.text, df.found)).first()[0] == "<EMAIL><IP>gh<PHONE>kl"


def planted(documents):
    """documents with sentences that hold seeds, unseen identifiers in the same contexts, and tokens that are neither."""
    rows, truth, clean = [], {}, set()
    for k, (doc_id, text, _) in enumerate(documents):
        more = ""
        if k % 5 == 0:
            more = f" you can reach our desk at +1 415 555 {1000 + k:04d} during the day"
        elif k % 5 == 1:
            more = f" the server answers at address 10.{k % 250}.{k // 7 % 250}.{k % 99} for now"
        elif k % 20 == 2:
            truth[doc_id] = f"0415/{5550000 + k}", "phone"
            more = f" you can reach our desk at ({truth[doc_id][0]}) during the day"
        elif k % 20 == 3:
            truth[doc_id] = f"fe80:{k:04d}:{k + 1:04d}", "ip"
            more = f" the server answers at address {truth[doc_id][0]} for now"
        elif k % 20 == 7:
            truth[doc_id] = f"{'abcdefgh'[k % 8]}nna@localhost", "email"
            more = f" or write a letter to {truth[doc_id][0]}, please do"
        elif k % 10 in (8, 9):
            more = f" or write a letter to user{k}@mail.example.org, please do"
        elif k % 5 == 4:
            more = f" we ordered part {20000 + k}-B of the {1500 + k} series and/or none"
            clean.add(doc_id)
        rows.append((doc_id, (text or "") + more))
    return rows, truth, clean


def test_planted_identifiers_over_a_whole_table(spark, sf_dir):
    """Precision and recall of what is added to the format rules, over all documents: whole spans, kind by kind."""
    data = sf_dir.replace("sf0.001", "sf0.01")
    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    rows, truth, clean = planted(docs)
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    keyed = df.select("doc_id", pii.text_key(df.text).alias("key")).join(pii.spans(df), "key").collect()
    added = {(r.doc_id, pii.KINDS[s.kind - 1], texts[r.doc_id][s.start : s.end]) for r in keyed for s in r["all"] if s not in r["base"]}
    for kind in ("phone", "ip", "email"):
        want = {(i, k, v) for i, (v, k) in truth.items() if k == kind}
        assert len(want) >= 40 and len(want & added) >= 0.95 * len(want), (kind, len(want), len(want & added))
    assert not {i for i, _, _ in added} & clean
    assert len([1 for i, _, _ in added if i in truth]) >= 0.95 * len(added)


def test_known_instances_make_patterns_known(spark):
    """A second round reaches what shares a context only with the discoveries of the first; nothing stops before that."""
    a = [(k, f"ring me up on +1 555 010 {1000 + k} please") for k in range(8)]
    b = [(20 + k, f"ring me up on 0555/10-{10 + k} please") for k in range(4)]
    c = [(40 + k, f"my old extension 0555/10-{10 + k} moved") for k in range(4)]
    d = [(60, "my old extension 0777/20-99 moved"), (61, "lot 0777/20-98 sold")]
    docs = spark.createDataFrame(a + b + c + d, "doc_id long, text string")
    new = {r.instance: r.kind for r in pii.bootstrap(pii.graph(pii.occurrences(docs))).collect()}
    assert new == {**{f"0555/10-{10 + k}": "phone" for k in range(4)}, "0777/20-99": "phone"}


def test_context_is_whole_words(spark):
    long = "w" * 60
    docs = spark.createDataFrame([(1, f"one {long} two{long}  10.0.0.1\n {long} b c"), (2, "10.0.0.1"), (3, "x:10.0.0.1,y z")], "doc_id long, text string")
    out = sorted((r.left, r.right) for r in pii.occurrences(docs).where("kind = 'ip'").collect())
    assert out == sorted([(f"{long} two{long}", f"{long} b"), ("", ""), ("x:", ",y z")])
