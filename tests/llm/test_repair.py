"""Conversation repair against a search over all edits, and conversations that are cut into many chunks."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import repair
from tidewatch.llm.queries import op11_repair, table

SCHEMA = "conv_id long, turn long, role string, text string, row int, part string, at int, edit string"


def damage(rows):
    """Rows (conv, turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by Dijkstra over (row, written initials' end), least audit first among equal costs."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, end, out = heapq.heappop(heap)
        if i == len(rows) and end in ("", "a"):
            return cost, audit, "\n".join(out)
        if (i, end) in done:
            continue
        done.add((i, end))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[end]
        for name in ("user", "assistant"):
            if name[0] in follows:
                heapq.heappush(heap, (cost + 3, audit + "I", i, name[0], (*out, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            extra = 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, end, out))
            if faults[i] in ("", "truncated"):
                if role[:1] and role[:1] in follows:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if name[0] in follows:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, name[0], (*out, f"{name}:{text}")))
    raise AssertionError


def wanted(rows):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(tuple(r[:4]))
    out = {}
    for conv, own in by_conv.items():
        done = damage(own)
        faults = fault_of(done)
        cost, audit, text = cheapest(done, faults)
        turns = [t for t, _, _ in done if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(done, done[1:]))
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def made(n, seed, convs=1, hot=False):
    """Rows with every fault, gaps, null turns, and texts that come again."""
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]
    texts = ["yes.", "no", "what?", " \t", "", None, "so be it! ", "é", "well\n."]
    out = []
    for i in range(n):
        turn = None if rng.random() < 0.05 else int(rng.integers(0, 2 * n // convs + 1))
        text = texts[rng.integers(len(texts))] if rng.random() < 0.4 else f"{rng.integers(10**9)}."
        out.append((0 if hot and rng.random() < 0.9 else int(rng.integers(convs)), turn, roles[rng.integers(len(roles))], text, 1, "p", 2, "e"))
    return out


def check(spark, rows, folder):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(op11_repair(spark, folder(conversations=df))) == wanted(rows)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_repair(spark, sf_dir)) == wanted(rows)


def test_odd_conversations(spark, folder):
    odd = [(None, 0, "user", "a.", 1, "p", 2, "e"), (None, None, None, None, 1, "p", 2, "e"), (7, None, "s", "x", 1, "p", 2, "e"), (8, 1, "user", "long " * 100_000 + ".", 1, "p", 2, "e")]
    check(spark, made(800, 1, convs=200) + odd, folder)


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_one_conversation_over_many_chunks(spark, folder, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "GROUP", 4)
    check(spark, made(400, chunk, convs=20, hot=True), folder)


def test_edits_as_rows(spark):
    df = spark.createDataFrame(made(300, 3, convs=40), SCHEMA)
    done = repair.repair(df)
    rows = repair.rows_of(done)
    patterns = {r.conv_id: "".join(x[:1] for x in r.roles) for r in rows.orderBy("part", "number", "place").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "place", "role"))), lambda x: x["role"]).alias("roles")).collect()}
    assert patterns and all(re.fullmatch("s?(ua)+", p) for p in patterns.values())


def test_no_conversations(spark, folder):
    check(spark, [], folder)
