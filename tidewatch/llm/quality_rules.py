"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate each
is, and the posterior probability of good quality replaces an all-must-pass filter.

A task measures whole texts and casts the votes; votes are counted by pattern over all documents. There are at most
3 ** rules patterns however many documents there are, so the EM runs on that small table and its result joins back as a
broadcast of the same bounded size.

Defined cases: a null text counts as empty (all measures 0, every rule abstains but the length rule); a very long text is
measured whole, in memory and time proportional to its length; repeated rows are measured alike; documents of equal votes
tie and share their posterior; an empty table gives an empty result; only id and text are read, so other columns never
clash. At most MAX_RULES rules can be given, as that bounds the number of patterns; more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_stops", "n_distinct", "n_marks", "n_doubled")
_MIX = np.random.default_rng(5).integers(1, 2**63, 5, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more, first occurrences included."""
    if len(words) < 6:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    n = len(ids) - 4
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(5):
        keys += ids[k : n + k] * _MIX[k]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == keys)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + 5, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; words are runs of characters other than the six ASCII white-space characters."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    white = int(counts[list(WHITE)].sum())
    points = len(data) - int(counts[0x80:0xC0].sum())
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    return (
        len(words),
        points - white,
        int(counts[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        lower,
        digits,
        int(counts[33]),
        int(counts[46]),
        len(set(words)),
        int(counts[33:127].sum()) - upper - lower - digits,
        sum(map(bytes.__eq__, words, words[1:])),
    )


@dataclass(frozen=True)
class Rule:
    """Votes -1 where `bad` holds, 1 where `good` holds, and else abstains (0); both are SQL over MEASURES."""

    name: str
    bad: str
    good: str


#: The thresholds are shares of a text's own words, letters or lines, so they mean the same at every length. Most rules
#: know one kind of junk only and abstain elsewhere; each kind is seen by more than one rule, so EM can compare them.
RULES = (
    Rule("symbols", "n_symbols > 0.05 * n_words", "false"),
    Rule("marks", "n_marks > 0.12 * word_chars", "n_marks <= 0.06 * word_chars and n_words >= 10"),
    Rule("capitals", "n_upper > 0.5 * (n_upper + n_lower)", "false"),
    Rule("bangs", "n_bangs > 0.1 * n_words", "false"),
    Rule("repeats", "n_repeat_words > 0.2 * n_words or n_dup_lines > 0.3 * n_lines", "false"),
    Rule("doubled", "n_doubled > 0.2 * n_words", "false"),
    Rule("length", "n_words < 10 or word_chars < 2.5 * n_words or word_chars > 14 * n_words", "false"),
    Rule(
        "clean",
        "false",
        "n_words >= 10 and n_symbols <= 0.03 * n_words and n_bangs <= 0.03 * n_words and n_upper <= 0.25 * (n_upper + n_lower)"
        " and n_doubled <= 0.1 * n_words and n_digits <= 0.25 * word_chars",
    ),
)
MAX_RULES = 8
#: Where EM begins, and what it is drawn to: P(bad vote), P(abstain), P(good vote) for bad and for good documents.
START = np.array([[0.4, 0.5, 0.1], [0.02, 0.58, 0.4]])


@dataclass(frozen=True)
class Accuracies:
    """prior: share of good documents; votes[j, y]: probabilities that rule j votes bad, abstains or votes good on a
    document of class y (0 bad, 1 good)."""

    prior: float
    votes: np.ndarray

    def accuracy(self) -> np.ndarray:
        """Per rule: the probability that a vote it casts is right."""
        right = (1 - self.prior) * self.votes[:, 0, 0] + self.prior * self.votes[:, 1, 2]
        return right / (right + (1 - self.prior) * self.votes[:, 0, 2] + self.prior * self.votes[:, 1, 0])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of votes (-1, 0, 1)."""
        one_hot = np.stack([votes == -1, votes == 0, votes == 1], axis=2)
        log = np.einsum("njv,jyv->ny", one_hot, np.log(self.votes)) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 0.02) -> Accuracies:
    """EM over vote patterns and their counts. The probabilities are drawn to START by a prior of `strength` of the
    documents, and a rule keeps its polarity: a bad vote is never likelier, a good vote never less likely, on good
    documents than on bad ones."""
    model = Accuracies(0.8, np.tile(START, (votes.shape[1], 1, 1)))
    total = counts.sum()
    if not total:
        return model
    one_hot = np.stack([votes == -1, votes == 0, votes == 1], axis=2)
    for _ in range(rounds):
        good = model.posterior(votes) * counts
        weight = np.stack([counts - good, good])
        seen = np.einsum("yn,njv->jyv", weight, one_hot) + strength * total * START
        new = seen / seen.sum(2, keepdims=True)
        new[:, 1, 0] = np.minimum(new[:, 1, 0], new[:, 0, 0])
        new[:, 0, 2] = np.minimum(new[:, 0, 2], new[:, 1, 2])
        new /= new.sum(2, keepdims=True)
        moved = abs(new - model.votes).max()
        model = Accuracies(float(np.clip(good.sum() / total, 0.05, 0.95)), new)
        if moved < 1e-9:
            break
    return model


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES) of every row; one narrow stage."""
    workspace.small_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column(1)]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *MEASURES])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(task, f"id {key}, " + ", ".join(f"{x} long" for x in MEASURES))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Accuracies]:
    """Per row of docs: id, MEASURES, votes (array of -1, 0, 1 by rule), p_good and verdict (p_good >= keep_at); and
    the estimated accuracies. rules: at most MAX_RULES."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"the number of vote patterns is bounded by at most {MAX_RULES} rules")
    vote = [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).cast("int") for r in rules]
    voted = measures(docs, id_col, text_col).withColumn("votes", F.array(*vote))
    voted = workspace.materialize(voted, "votes")
    patterns = voted.groupBy("votes").count().collect()  # at most 3 ** len(rules) rows
    votes = np.array([x["votes"] for x in patterns], dtype=float).reshape(-1, len(rules))
    model = estimate(votes, np.array([x["count"] for x in patterns], dtype=float))
    rows = [(x["votes"], float(p)) for x, p in zip(patterns, model.posterior(votes), strict=True)]
    scored = docs.sparkSession.createDataFrame(rows, "votes array<int>, p_good double")
    out = voted.join(F.broadcast(scored), "votes")
    return out.withColumn("verdict", F.col("p_good") >= keep_at), model
