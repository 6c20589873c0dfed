"""Conversation structure repair by dynamic programming over tensors whose first axis is time.

A conversation's rows become the cheapest sequence of edits after which its roles read `(s?(ua)+)?`: Keep a row, Rerole it to
user or assistant, Delete it, or Insert an empty one. What has been written so far matters only as one of four states: nothing,
a system row, a user row, an assistant row. One step of the tensor handles one turn of many conversations at once.

1. Rows are sorted over all conversations by range, so that a conversation of any size is dealt over tasks. A task packs runs
   of one conversation into chunks of at most CHUNK rows and CHUNK_CHARS characters; nearly every conversation is one chunk.
2. Chunks of like length form a tensor. Costs to finish are stored for each turn, backward; edits are traced forward, taking
   the least letter among the cheapest at each step, which is the ASCII-least of all cheapest edits.
3. The chunks of longer conversations are 4 x 4 matrices of costs, multiplied by (min, +) from the end in groups of GROUP,
   level by level, which gives each chunk its cost at its end. With these, each chunk maps the state it begins in to the one
   it ends in; these maps are composed from the start in the same way. Then every chunk is traced by itself.

Faults, the first of a row counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (the
last such character is none of . ! ?). Blank and duplicate rows must go; a truncated row that stays costs 3 more.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are ordered by role and then
text, so the result doesn't depend on how a table is read; a null id is a conversation like others; a conversation without
rows has no edits; a very long text is a chunk of its own; an empty table gives an empty result; only the named columns
are read. A digest of a whole conversation is made in order, so `joined` streams a long one through one task, a chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace

#: Rows and characters of a chunk, but for a single row with more; chunks that one product takes.
CHUNK, CHUNK_CHARS, GROUP = 512, 1 << 20, 512
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row. What may follow, by state.
FOLLOW = np.array([2, 2, 3, 2])
#: States in which a conversation may end.
ENDS = np.array([True, False, False, True])
NEVER = 1 << 40
WHITE = " \t\n\x0b\x0c\r"
#: What a row's role makes of it: the state after it is kept (system, user, assistant), or 0.
_ROLE = {"s": 1, "u": 2, "a": 3}


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone) after damage by crc32 of `conv_id:turn` modulo 20: 0 drops the row (gone), 1 empties
    its text, 2 removes its . ! ?, 3 repeats it, 4 makes its role user. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(text_col), "[.!?]", "")).when(kind == 0, "").otherwise(blank(text_col))
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank(role_col)).alias("role"),
        text.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def chunks(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) as chunks (conv_id, part, number, turns, roles, texts), in the order of (part,
    number) within a conversation. Rows that are gone only keep their conversation's place."""
    key = rows.schema["conv_id"].dataType.simpleString()
    # rows alike in all four are interchangeable, however many, so their numbers only deal them over tasks
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "salt"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, current, held, size = 0, None, [], 0

        def chunk() -> pa.RecordBatch:
            turns, roles, texts = zip(*held, strict=True) if held else ((), (), ())
            row = {"conv_id": pa.array([current[0]], kind), "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "turns": pa.array([list(turns)], pa.list_(pa.int64())), "roles": pa.array([list(roles)], pa.list_(pa.string())), "texts": pa.array([list(texts)], pa.list_(pa.string()))}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            kind = batch.column(0).type
            for conv, turn, role, text, gone, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current[0] != conv or len(held) == CHUNK or size >= CHUNK_CHARS:
                    if current is not None:
                        yield chunk()
                        number += 1
                    current, held, size = (conv,), [], 0
                if not gone:
                    held.append((turn, role, text))
                    size += len(text) + len(role)
        if current is not None:
            yield chunk()

    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"conv_id {key}, part int, number long, turns array<long>, roles array<string>, texts array<string>"
    return ordered.select("conv_id", "turn", "role", "text", "gone", "part").mapInArrow(task, schema)


def faults(roles: Sequence[str], texts: Sequence[str], repeated: Sequence[int] | None = None) -> np.ndarray:
    """0 none, 1 blank, 2 duplicate, 3 truncated, for each row; repeated gives the duplicates' places where the rows before
    these matter too."""
    out, seen = np.zeros(len(texts), np.int8), set()
    again = set(repeated) if repeated is not None else None
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        end = text.rstrip(WHITE)[-1:]
        twice = i in again if again is not None else (role, text) in seen
        seen.add((role, text))
        out[i] = 1 if not end else 2 if twice else 0 if end in ".!?" else 3
    return out


class Tensor:
    """Conversations, or chunks, of like length: costs and edits of all of them at once, a turn at a time."""

    def __init__(self, kept: Sequence[np.ndarray], fault: Sequence[np.ndarray]):
        """kept: states that rows give when they are kept (0: they can't be); fault: what `faults` says."""
        self.steps, n = max((len(k) for k in kept), default=0), len(kept)
        self.kept, self.real = np.zeros((self.steps, n), np.int8), np.zeros((self.steps, n), bool)
        self.must, self.extra = np.zeros((self.steps, n), bool), np.zeros((self.steps, n), np.int64)
        for i, (k, f) in enumerate(zip(kept, fault, strict=True)):
            t = len(k)
            self.kept[:t, i], self.real[:t, i] = k, True
            self.must[:t, i], self.extra[:t, i] = (f == 1) | (f == 2), TRUNCATED * (f == 3)

    @staticmethod
    def inserted(cost: np.ndarray) -> np.ndarray:
        """Costs by state (last axis) where rows may be inserted first."""
        out = cost.copy()
        out[..., 2] = np.minimum(cost[..., 2], INSERT + cost[..., 3])
        out[..., 3] = np.minimum(cost[..., 3], INSERT + cost[..., 2])
        for s in (0, 1):
            out[..., s] = np.minimum(cost[..., s], INSERT + out[..., 2])
        return out

    def choices(self, t: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs (conversation, state) of deleting, keeping and reroling row t, where `after` are those of what follows."""
        gone = after + np.where(self.real[t], DELETE, 0)[:, None]
        stay = np.where(self.must[t] | ~self.real[t], NEVER, self.extra[t])
        role = self.kept[t].astype(np.int64)
        target = np.take_along_axis(after, role[:, None], 1)
        fits = (role[:, None] == FOLLOW) | ((role == 1)[:, None] & (np.arange(4) == 0))
        keep = np.where(fits, stay[:, None] + target, NEVER)
        return gone, keep, stay[:, None] + REROLE + after[:, FOLLOW]

    def backward(self, end: np.ndarray) -> np.ndarray:
        """Costs to finish, (turn, conversation, state), from the costs at the end."""
        out = np.empty((self.steps + 1, *end.shape), np.int64)
        out[self.steps] = end
        for t in range(self.steps - 1, -1, -1):
            best = np.minimum.reduce(self.choices(t, out[t + 1]))
            step = np.minimum(self.inserted(best), NEVER)
            out[t] = np.where(self.real[t][:, None], step, out[t + 1])
        return out

    def matrix(self) -> np.ndarray:
        """(conversation, state before, state after): costs of crossing."""
        n = self.kept.shape[1]
        out = np.empty((n, 4, 4), np.int64)
        for state in range(4):
            end = np.full((n, 4), NEVER, np.int64)
            end[:, state] = 0
            out[:, :, state] = self.backward(end)[0]
        return out

    def forward(self, cost: np.ndarray, state: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows inserted before each row and at the end, edit of each row, last state), with the least letter among the
        cheapest at each step. closing: which conversations end here, so rows may be inserted after the last one."""
        n = len(state)
        who, state = np.arange(n), state.copy()
        more, edit = np.zeros((self.steps + 1, n), np.int8), np.full((self.steps, n), b" ", "S1")
        for t in range(self.steps):
            gone, keep, _ = self.choices(t, cost[t + 1])
            open_ = self.real[t].copy()
            while open_.any():
                best = cost[t][who, state]
                drop = open_ & (gone[who, state] == best)
                add = open_ & ~drop & (INSERT + cost[t][who, FOLLOW[state]] == best)
                stay = open_ & ~drop & ~add & (keep[who, state] == best)
                turn = open_ & ~drop & ~add & ~stay
                edit[t, drop], edit[t, stay], edit[t, turn] = b"D", b"K", b"R"
                more[t, add] += 1
                state = np.where(stay, self.kept[t], np.where(turn | add, FOLLOW[state], state))
                open_ = add
        last = closing & (cost[self.steps][who, state] > 0)
        while last.any():
            more[self.steps, last] += 1
            state = np.where(last, FOLLOW[state], state)
            last = closing & (cost[self.steps][who, state] > 0)
        return more, edit, state


def ending(n: int) -> np.ndarray:
    """Costs at the end of n conversations."""
    return np.tile(Tensor.inserted(np.where(ENDS, 0, NEVER)[None].astype(np.int64)), (n, 1))


def kept_states(roles: Sequence[str]) -> np.ndarray:
    return np.fromiter((_ROLE.get(r[:1], 0) for r in roles), np.int8, len(roles))


def repaired_rows(roles: Sequence[str], texts: Sequence[str], more: np.ndarray, edit: np.ndarray, state: int) -> tuple[str, list[str]]:
    """(edits' initials, rows `role:text`) of one chunk that begins in a state."""
    audit, out = [], []
    name = {2: "user", 3: "assistant"}

    def insert(count: int) -> None:
        nonlocal state
        for _ in range(count):
            state = int(FOLLOW[state])
            audit.append("I")
            out.append(f"{name[state]}:")

    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        insert(int(more[i]))
        letter = edit[i].decode()
        audit.append(letter)
        if letter == "K":
            state = _ROLE[role[:1]]
            out.append(f"{role}:{text}")
        elif letter == "R":
            state = int(FOLLOW[state])
            out.append(f"{name[state]}:{text}")
    insert(int(more[-1]))
    return "".join(audit), out


def _tensors(rows: list[dict]) -> Iterator[tuple[list[dict], Tensor]]:
    """Rows (roles, texts, repeated) by the power of two that holds their length, each group as a tensor."""
    by_size: dict[int, list[dict]] = {}
    for row in rows:
        row["fault"] = faults(row["roles"], row["texts"], row.get("repeated"))
        by_size.setdefault(len(row["roles"]).bit_length(), []).append(row)
    for group in by_size.values():
        yield group, Tensor([kept_states(r["roles"]) for r in group], [r["fault"] for r in group])


_DONE = "turn_min long, turn_max long, turns long, turn_first long, turn_last long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, repaired array<string>"
_LEGAL = {"su", "ua", "au"}


def _finished(row: dict, more: np.ndarray, edit: np.ndarray, state: int, cost: int) -> dict:
    """A chunk's part of the result."""
    turns = [t for t in row["turns"] if t is not None]
    initials = [r[:1] for r in row["roles"]]
    audit, out = repaired_rows(row["roles"], row["texts"], more, edit, state)
    counts = np.bincount(row["fault"], minlength=4)
    return {
        "turn_min": min(turns, default=None), "turn_max": max(turns, default=None), "turns": len(set(turns)), "turn_first": turns[0] if turns else None, "turn_last": turns[-1] if turns else None,
        "blank": int(counts[1]), "duplicate": int(counts[2]), "truncated": int(counts[3]), "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None, "cost": cost, "audit": audit, "repaired": out,
    }


def _arrays(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(kind: pa.DataType) -> pa.Schema:
    names = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([("conv_id", kind), ("part", pa.int32()), ("number", pa.int64()), *((n, names[t]) for n, t in (x.split(" ") for x in _DONE.split(", ")))])


def _edited(known: bool):
    """Chunks (conv_id, part, number, turns, roles, texts) with their edits; where known, each has its duplicates
    (repeated), its costs at the end (end_cost, null: it ends its conversation) and the state it begins in (begin)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, out = _schema(batch.schema.field("conv_id").type), []
            for group, tensor in _tensors(batch.to_pylist()):
                n = len(group)
                end, closing, begin = ending(n), np.ones(n, bool), np.zeros(n, np.int64)
                if known:
                    closing = np.array([r["end_cost"] is None for r in group])
                    begin = np.array([r["begin"] for r in group], np.int64)
                    for i in np.flatnonzero(~closing):
                        end[i] = group[i]["end_cost"]
                cost = tensor.backward(end)
                more, edit, _ = tensor.forward(cost, begin, closing)
                for i, row in enumerate(group):
                    t = len(row["roles"])
                    places = np.append(more[:t, i], more[tensor.steps, i])
                    done = _finished(row, places, edit[:t, i], int(begin[i]), int(cost[0, i, begin[i]]))
                    out.append({k: row[k] for k in ("conv_id", "part", "number")} | done)
            if out:
                yield _arrays(out, schema)

    return task


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of matrices of costs."""
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER)


def _scan(parts: DataFrame, kind: str) -> DataFrame:
    """parts (conv_id, at: 0, 1, ..., value: array<long>) with `given`. kind cost: values are matrices, and given is the costs
    at the end of each part, null for the last. kind state: values are maps of states, and given is [the state it begins in].
    Groups of GROUP parts become one part of the next level, until a conversation has one."""
    key = parts.schema["conv_id"].dataType.simpleString()

    def fold(values: Iterator) -> np.ndarray:
        total = None
        for v in values:
            v = np.array(v, np.int64)
            v = v.reshape(4, 4) if kind == "cost" else v
            total = v if total is None else _product(total, v) if kind == "cost" else v[total]
        return total.ravel()

    def up(pdf):
        import pandas as pd

        ordered = pdf.sort_values("at")
        return pd.DataFrame({"conv_id": ordered["conv_id"].iloc[:1], "at": [int(ordered["at"].iloc[0]) // GROUP], "value": [fold(ordered["value"]).tolist()]})

    def down(pdf):
        ordered = pdf.sort_values("at").copy()
        outer, given = ordered["outer"].iloc[0], []
        if kind == "cost":
            cost = None if outer is None else np.array(outer, np.int64)
            for v in reversed(ordered["value"].tolist()):
                given.append(None if cost is None else cost.tolist())
                cost = (np.array(v, np.int64).reshape(4, 4) + (ending(1)[0] if cost is None else cost)[None]).min(1)
            given.reverse()
        else:
            state = 0 if outer is None else int(outer[0])
            for v in ordered["value"]:
                given.append([state])
                state = int(v[state])
        ordered["given"] = given
        return ordered[["conv_id", "at", "value", "given"]]

    levels = [parts]
    while levels[-1].where(F.col("at") > 0).limit(1).count():
        group = levels[-1].withColumn("group", F.expr(f"at div {GROUP}"))
        levels.append(workspace.materialize(group.groupBy("conv_id", "group").applyInPandas(lambda pdf: up(pdf.drop(columns="group")), f"conv_id {key}, at long, value array<long>"), "scan"))
    outer = levels.pop().select("conv_id", F.col("at").alias("group"), F.lit(None).cast("array<long>").alias("outer"))
    while levels:
        level = levels.pop().withColumn("group", F.expr(f"at div {GROUP}")).alias("l").join(outer.alias("o"), F.col("l.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("l.group") == F.col("o.group")))
        level = level.select("l.conv_id", "l.at", "l.value", "l.group", "o.outer").groupBy("conv_id", "group")
        given = workspace.materialize(level.applyInPandas(lambda pdf: down(pdf), f"conv_id {key}, at long, value array<long>, given array<long>"), "scan")
        outer = given.select("conv_id", F.col("at").alias("group"), F.col("given").alias("outer"))
    return outer.select("conv_id", F.col("group").alias("at"), F.col("outer").alias("given"))


def edited(rows: DataFrame) -> DataFrame:
    """Chunks of conversations with their edits: conv_id, (part, number): their order, audit: the edits' initials, repaired: rows
    `role:text`, cost: of the conversation from there on, and counts. rows: (conv_id, turn, role, text, gone)."""
    workspace.small_batches(rows.sparkSession)
    packed = workspace.materialize(chunks(rows), "chunks")
    sizes = packed.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("long_id"))
    sizes = workspace.materialize(sizes, "long-conversations")  # few: those that cross a task's end, or a chunk's
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = packed.join(sizes, same, "left_anti").mapInArrow(_edited(False), _result(packed))
    long_ = workspace.materialize(packed.join(sizes, same, "left_semi"), "long-chunks")
    if not long_.limit(1).count():
        return short
    return short.unionByName(_long(long_))


def _result(packed: DataFrame) -> str:
    return f"conv_id {packed.schema['conv_id'].dataType.simpleString()}, part int, number long, {_DONE}"


def _numbered(packed: DataFrame) -> DataFrame:
    """Adds `at`, 0, 1, ... within a conversation. A conversation's chunks in one part are numbered without a gap, so the
    window has a row for each part that a conversation lies in, at most as many as there are tasks."""
    from pyspark.sql import Window

    parts = packed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("number").alias("low"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    both = packed.alias("c").join(parts.alias("p"), F.col("c.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("c.part") == F.col("p.part")))
    return both.select("c.*", (F.col("p.before") + F.col("c.number") - F.col("p.low")).cast("long").alias("at"))


def _long(packed: DataFrame) -> DataFrame:
    """The same for conversations of several chunks."""
    key = packed.schema["conv_id"].dataType.simpleString()
    rows = packed.select("conv_id", "part", "number", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "r"))
    rows = rows.select("conv_id", "part", "number", "i", F.sha2(F.concat_ws(":", F.length("r.roles").cast("string"), "r.roles", "r.texts"), 256).alias("said"))
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct("part", "number", "i")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # only what is said twice is joined; each task has counted its own before
    again = rows.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.said") == F.col("f.said")))
    again = again.where(F.struct("r.part", "r.number", "r.i") != F.col("f.first")).groupBy("r.part", "r.number").agg(F.sort_array(F.collect_list("r.i")).alias("repeated"))
    numbered = _numbered(packed).join(again, ["part", "number"], "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<int>")))
    numbered = workspace.materialize(numbered, "long-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for group, tensor in _tensors(batch.to_pylist()):
                out += [{"conv_id": r["conv_id"], "at": r["at"], "value": m.ravel().tolist()} for r, m in zip(group, tensor.matrix(), strict=True)]
            yield _arrays(out, pa.schema([("conv_id", kind), ("at", pa.int64()), ("value", pa.list_(pa.int64()))]))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for group, tensor in _tensors(batch.to_pylist()):
                closing = np.array([r["end_cost"] is None for r in group])
                end = np.stack([ending(1)[0] if r["end_cost"] is None else np.array(r["end_cost"], np.int64) for r in group])
                cost = tensor.backward(end)
                last = np.stack([tensor.forward(cost, np.full(len(group), s), closing)[2] for s in range(4)], 1)
                out += [{"conv_id": r["conv_id"], "at": r["at"], "value": x.tolist()} for r, x in zip(group, last, strict=True)]
            yield _arrays(out, pa.schema([("conv_id", kind), ("at", pa.int64()), ("value", pa.list_(pa.int64()))]))

    part = f"conv_id {key}, at long, value array<long>"
    here = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.at") == F.col(f"{b}.at"))
    costs = _scan(workspace.materialize(numbered.mapInArrow(matrices, part), "matrices"), "cost")
    ended = workspace.materialize(numbered.alias("n").join(costs.alias("c"), here("n", "c")).select("n.*", F.col("c.given").alias("end_cost")), "long-chunks")
    begins = _scan(workspace.materialize(ended.mapInArrow(maps, part), "maps"), "state")
    begun = ended.alias("e").join(begins.alias("b"), here("e", "b")).select("e.*", F.element_at("b.given", 1).alias("begin"))
    return begun.mapInArrow(_edited(True), _result(packed))


def joined(done: DataFrame) -> DataFrame:
    """One row a conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Chunks of a
    conversation are read in order, one at a time."""
    workspace.small_batches(done.sparkSession)
    key = done.schema["conv_id"].dataType.simpleString()
    sums = ("blank", "duplicate", "truncated", "illegal")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def row(kind: pa.DataType) -> pa.RecordBatch:
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            found = {"conv_id": state["conv"], "gaps": gaps, **{k: state[k] for k in sums}, "cost": state["cost"], "audit": "".join(state["audit"]), "repaired_sha256": state["sha"].hexdigest()}
            return _arrays([found], pa.schema([("conv_id", kind), *((k, pa.int64()) for k in ("gaps", *sums, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for x in batch.to_pylist():
                if not state or state["conv"] != x["conv_id"]:
                    if state:
                        yield row(kind)
                    state = {"conv": x["conv_id"], "low": None, "high": None, "turns": 0, "turn": None, "last": None, "cost": x["cost"], "audit": [], "sha": hashlib.sha256(), "some": False} | dict.fromkeys(sums, 0)
                if x["turns"]:
                    state["turns"] += x["turns"] - (state["turn"] is not None and state["turn"] == x["turn_first"])
                    state["low"] = x["turn_min"] if state["low"] is None else min(state["low"], x["turn_min"])
                    state["high"] = x["turn_max"] if state["high"] is None else max(state["high"], x["turn_max"])
                    state["turn"] = x["turn_last"]
                for k in sums:
                    state[k] += x[k]
                if x["first"] is not None:
                    state["illegal"] += state["last"] is not None and state["last"] + x["first"] not in _LEGAL
                    state["last"] = x["last"]
                state["audit"].append(x["audit"])
                for line in x["repaired"]:
                    state["sha"].update((("\n" if state["some"] else "") + line).encode("utf-8", "surrogatepass"))
                    state["some"] = True
        if state:
            yield row(kind)

    schema = f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return done.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(task, schema)


def rows_of(done: DataFrame) -> DataFrame:
    """(conv_id, place from 0 within a chunk, part, number, role, text) of repaired conversations."""
    rows = done.select("conv_id", "part", "number", F.posexplode("repaired").alias("place", "line"))
    cut: Column = F.instr("line", ":")
    return rows.select("conv_id", "part", "number", "place", F.col("line").substr(F.lit(1), cut - 1).alias("role"), F.col("line").substr(cut + 1, F.length("line")).alias("text"))


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damaged conversations with their edits, chunk by chunk."""
    return edited(damaged(conversations, id_col, turn_col, role_col, text_col))
