"""Quality classifier: a factorisation machine over hashed words, structure statistics of the text, and metadata columns.

score = sigmoid(w0 + sum w_i x_i + sum over factors f of ((sum v_if x_i)^2 - sum (v_if x_i)^2) / 2), which is all
pairwise interactions <v_i, v_j> x_i x_j in time linear in a text's distinct words (the sum-of-squares identity).

The model has a fixed size (BUCKETS + structure features, times FACTORS + 1), so it travels with the task. It is fitted
on at most about `max_rows` labelled ids, picked by a hash of the id, one row each; every text is scored, whole. Metadata
are numeric columns of the row itself, such as its stated number of characters; each is a feature, crossed with all words.

Defined cases: a null text is scored as the empty text; a null, NaN or absent metadata column counts as the mean of the
training rows; a very long text costs time in proportion, and a task scores few texts at a time; rows without a label don't train; where rows of a labelled id
differ, the text with the smallest hash trains, as the label is one of the id and not of a row; an id whose repeated labels
tie has none; with no labelled row at all every score is 0.5; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace
from .quality_rules import MEASURES, measure

BUCKETS = 1 << 15
FACTORS = 8
#: Numeric columns of documents that may be read: the contract bars labels, lang, source and doc_id.
METADATA = ("n_chars",)
#: Features scored at once, at most, but for a single text with more.
STRIP = 1 << 18
STRUCTURE = ("length", "word_length", "symbols", "dup_lines", "repeats", "line_length", "capitals", "digits", "bangs", "stops", "variety", "pipes", "marks", "doubled")


def structure(text: str | None) -> np.ndarray:
    """STRUCTURE of one text: logarithms of sizes and shares of its own words, letters or lines."""
    m = dict(zip(MEASURES, measure(text), strict=True))
    words, chars, lines = max(m["n_words"], 1), max(m["word_chars"], 1), max(m["n_lines"], 1)
    return np.array(
        [
            np.log1p(m["n_words"]),
            m["word_chars"] / words,
            m["n_symbols"] / words,
            m["n_dup_lines"] / lines,
            m["n_repeat_words"] / words,
            np.log1p(words / lines),
            m["n_upper"] / max(m["n_upper"] + m["n_lower"], 1),
            m["n_digits"] / chars,
            m["n_bangs"] / words,
            m["n_stops"] / words,
            m["n_distinct"] / words,
            (text or "").count("|") / words,
            m["n_marks"] / chars,
            m["n_doubled"] / words,
        ],
        dtype=np.float32,
    )


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the text's distinct words, weights of unit length in total."""
    counts = Counter((text or "").encode("utf-8", "surrogatepass").split())
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.fromiter((zlib.crc32(w) for w in counts), np.int64, len(counts)) % BUCKETS
    weight = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    return at.astype(np.int32), (weight / np.linalg.norm(weight)).astype(np.float32)


def metadata_of(values: Sequence[float | None]) -> np.ndarray:
    """Logarithms of metadata, with their sign; NaN where there is none."""
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    return (np.sign(x) * np.log1p(np.abs(x))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """mean and spread scale STRUCTURE and then the metadata, if there is any."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def features(self, at: np.ndarray, weight: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.nan_to_num(np.clip((shape - self.mean) / self.spread, -5, 5))
        return np.concatenate([at, np.arange(BUCKETS, BUCKETS + len(scaled), dtype=np.int32)]), np.concatenate([weight, scaled]).astype(np.float32)

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log odds of rows of features, by the sum-of-squares identity; every row has at least its structure."""
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        first = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        vx = self.factors[at] * x[:, None]
        pairs = np.add.reduceat(vx, first, axis=0) ** 2 - np.add.reduceat(vx**2, first, axis=0)
        return self.bias + np.add.reduceat(self.linear[at] * x, first) + 0.5 * pairs.sum(1)

    def scores(self, texts: Sequence[str | None], metadata: Sequence[Sequence[float | None]] | None = None) -> np.ndarray:
        """Probabilities of label 1; metadata has a value a column for each text."""
        out, rows, size = [], [], 0
        for i, text in enumerate(texts):
            shape = structure(text)
            extra = len(self.mean) - len(shape)
            if extra:
                shape = np.concatenate([shape, metadata_of(metadata[i]) if metadata else np.full(extra, np.nan, np.float32)])
            rows.append(self.features(*hashed_words(text), shape))
            size += len(rows[-1][0])
            if size >= STRIP:
                out.append(self.raw(rows))
                rows, size = [], 0
        if rows:
            out.append(self.raw(rows))
        raw = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss over rows of (buckets, weights, structure, label)."""
    rng = np.random.default_rng(seed)
    dense = len(rows[0][2]) if rows else len(STRUCTURE)
    size = BUCKETS + dense
    linear, factors = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    if not rows:
        return Model(0.0, linear, np.zeros_like(factors), np.zeros(dense, np.float32), np.ones(dense, np.float32))
    shapes = np.stack([r[2] for r in rows])
    there = ~np.isnan(shapes)
    count = np.maximum(there.sum(0), 1)
    mean = (np.where(there, shapes, 0).sum(0) / count).astype(np.float32)
    spread = np.sqrt((np.where(there, shapes - mean, 0) ** 2).sum(0) / count).astype(np.float32) + np.float32(1e-3)
    model = Model(0.0, linear, factors, mean, spread)
    data = [(*model.features(*r[:3]), r[3]) for r in rows]
    w, v, bias = model.linear, model.factors, 0.0
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), batch):
            part = [data[i] for i in order[start : start + batch]]
            ends = np.cumsum([len(p[0]) for p in part])
            first = np.concatenate([[0], ends[:-1]])
            row = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            y = np.array([p[2] for p in part], np.float32)
            vx = v[at] * x[:, None]
            total = np.add.reduceat(vx, first, axis=0)
            raw = bias + np.add.reduceat(w[at] * x, first) + 0.5 * (total**2 - np.add.reduceat(vx**2, first, axis=0)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(part)
            used, place = np.unique(at, return_inverse=True)
            e = error[row] * x
            dw = np.bincount(place, e, len(used)) + decay * w[used]
            dv = np.stack([np.bincount(place, e * (total[row, f] - vx[:, f]), len(used)) for f in range(FACTORS)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            gb += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(gb)
    return Model(float(bias), w, v, model.mean, model.spread)


def _numbers(docs: DataFrame, metadata: Sequence[str]) -> Column:
    """An array of metadata columns; one that docs lacks is null."""
    return F.array(*(F.col(c).cast("double") if c in docs.columns else F.lit(None).cast("double") for c in metadata)).cast("array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, metadata: Sequence[str] = METADATA, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on one row of docs for each id that has a label (0 or 1). Where more than max_rows ids have one, a hash of the
    id picks about max_rows of them: the sample is bounded, its features (not its texts) go to the driver."""
    workspace.small_batches(docs.sparkSession)
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    clean = clean.groupBy("id").agg(F.avg("y").alias("y")).where("y != 0.5")
    share = min(1.0, max_rows / max(clean.count(), 1))
    picked = clean.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("id", (F.col("y") > 0.5).cast("int").alias("y"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text, numbers, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, weight = hashed_words(text)
                shape = np.concatenate([structure(text), metadata_of(numbers)])
                for k, x in enumerate((key, at.tobytes(), weight.tobytes(), shape.tobytes(), y)):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["id", "bucket", "weight", "shape", "y"])

    # at most about max_rows ids, so a broadcast of a known size
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _numbers(docs, metadata).alias("numbers")).join(F.broadcast(picked), "id")
    # each task keeps one row of an id, so one with many rows isn't shuffled whole
    sample = sample.groupBy("id", "y").agg(F.min_by(F.struct("text", "numbers"), F.struct(F.xxhash64("text"), "numbers")).alias("one"))
    sample = sample.select(F.col("id").cast("string").alias("id"), "one.text", "one.numbers", "y").mapInArrow(task, "id string, bucket binary, weight binary, shape binary, y int")
    rows = sorted(sample.collect(), key=lambda r: (r["id"], r["bucket"], r["weight"]))  # the same order in every run
    return train([(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["weight"], np.float32), np.frombuffer(r["shape"], np.float32), r["y"]) for r in rows])


def score(docs: DataFrame, model: Model, metadata: Sequence[str] = METADATA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1. One narrow stage. metadata as it was fitted."""
    workspace.small_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _numbers(docs, metadata).alias("numbers")).mapInArrow(task, f"id {key}, score double")


def score_of(docs: DataFrame, model: Model, metadata: Sequence[str] = METADATA, text_col: str = "text") -> Column:
    """The score as a column of docs, to filter rows in place."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts), list(numbers)), dtype=float)

    return scores(F.col(text_col), _numbers(docs, metadata))
