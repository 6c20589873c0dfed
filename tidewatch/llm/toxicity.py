"""Toxicity by compression distance: windows of a text are compressed with a zstandard dictionary of ordinary text and with
one that holds toxic text as well, and the bytes that the second saves are held against calibrated thresholds.

1. Both dictionaries are trained (zstandard's own trainer) on labelled texts: one on pieces of ordinary texts, one on the
   passages of toxic texts that ordinary ones lack. Such passages are words that occur in so many different contexts of
   toxic texts that chance doesn't explain it: copies and shared passages repeat a word in the same context, which counts
   once. The toxic dictionary is these passages followed by the content of the ordinary one, and both are used as plain
   content. So ordinary text compresses alike with both, and what the toxic one saves comes from toxic passages only.
2. A text is cut into windows of whole words, about WINDOW bytes each. A window's advantage is the difference of its two
   compressed lengths.
3. How many windows reach each of THRESHOLDS, how many there are, and the greatest advantage go into a logistic curve. It is
   calibrated on texts that the dictionaries used there weren't trained on (in FOLDS folds), so a score is a probability.

Spark counts contexts, cuts the pieces and scores; the trainer runs on the driver, over at most `max_rows` labelled ids,
MOST_WORDS passages and a piece of PIECE bytes an id. The model has a fixed size and travels with the tasks.

Defined cases: a null text is scored as the empty text, which has one empty window; a very long text is scored whole, and a
window without white space is cut at WINDOW bytes; repeated rows score alike; rows without a label, or whose id has as many
labels 1 as 0, don't train, and of a labelled id's rows the one with the smallest hash does; without a toxic or without an
ordinary labelled text every score is the share of toxic ones among the labelled (0 if there are none); an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace

#: Bytes of a window; advantages that windows are held against; bytes compressed at once, but for a single text.
WINDOW, THRESHOLDS, STRIP = 64, (1, 2, 3, 4, 6), 1 << 21
#: Bytes of the dictionaries' contents, and what they are trained on: passages, repeats of one, and an ordinary text's piece.
TOXIC_BYTES, ORDINARY_BYTES, MOST_WORDS, MOST_REPEATS, PIECE = 3072, 32768, 512, 50, 256
FOLDS = 4
#: Optimal parsing: a greedy parser's chance differences would drown an advantage of a few bytes.
_PARAMETERS = {"window_log": 17, "hash_log": 17, "chain_log": 17, "search_log": 5, "min_match": 4, "strategy": zstandard.STRATEGY_BTOPT, "write_content_size": False, "write_checksum": False, "write_dict_id": False}


def windows(data: bytes) -> np.ndarray:
    """(start, length) of the windows of data: they end at the white space after each WINDOW bytes, or without one within
    as many bytes more right there, and share that byte with the next."""
    last = len(data) - 1
    space = np.flatnonzero(np.frombuffer(data, np.uint8) <= 32)
    want = np.arange(WINDOW, len(data), WINDOW)
    if len(space):
        after = space[np.minimum(np.searchsorted(space, want), len(space) - 1)]
        want = np.where((after >= want) & (after - want <= WINDOW), after, want)
    edges = np.unique(np.concatenate([[0], want, [last]]))
    if len(edges) == 1:
        return np.array([[0, len(data)]], np.uint64)
    return np.stack([edges[:-1], edges[1:] - edges[:-1] + 1], 1).astype(np.uint64)


class Compressors:
    """The two dictionaries, ready for use; made once a task."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.of = [self._made(toxic + ordinary), self._made(ordinary)]

    @staticmethod
    def _made(content: bytes) -> zstandard.ZstdCompressor:
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters)

    def advantages(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Bytes that the toxic dictionary saves, window by window, of each text."""
        held, size = [], 0
        for text in texts:
            held.append(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ")
            size += len(held[-1])
            if size >= STRIP:
                yield from self._strip(held)
                held, size = [], 0
        yield from self._strip(held)

    def _strip(self, held: list[bytes]) -> Iterator[np.ndarray]:
        if not held:
            return
        cuts = [windows(data) for data in held]
        offsets = np.cumsum([0, *map(len, held[:-1])]).astype(np.uint64)
        segments = np.concatenate([cut + np.array([at, 0], np.uint64) for cut, at in zip(cuts, offsets, strict=True)])
        buffer = zstandard.BufferWithSegments(b"".join(held), segments.tobytes())
        toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(buffer)), np.int64, len(segments)) for c in self.of)
        yield from np.split(ordinary - toxic, np.cumsum([len(cut) for cut in cuts])[:-1])


def features(advantage: np.ndarray) -> list[float]:
    """Logarithms of how many windows reach each threshold, of the number of windows, and of the greatest advantage."""
    return [*(float(np.log1p(np.count_nonzero(advantage >= t))) for t in THRESHOLDS), float(np.log1p(len(advantage))), float(np.log1p(max(advantage.max(), 0)))]


@dataclass(frozen=True)
class Model:
    """Contents of the dictionaries and the logistic curve; without a curve every score is `share`."""

    toxic: bytes
    ordinary: bytes
    curve: tuple[float, ...] | None
    share: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        if not len(texts):
            return np.zeros(0)
        found = np.array([features(a) for a in Compressors(self.toxic, self.ordinary).advantages(texts)])
        return _logistic(np.array(self.curve), found)


def _logistic(curve: np.ndarray, found: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + found @ curve[1:], -30, 30)))


def calibrated(found: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """The logistic curve of features and labels, by Newton's method with a ridge."""
    terms = np.concatenate([np.ones((len(found), 1)), found], axis=1)
    curve = np.zeros(terms.shape[1])
    penalty = ridge * np.eye(len(curve))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = _logistic(curve, found)
        step = np.linalg.solve((terms * (p * (1 - p))[:, None]).T @ terms + penalty, terms.T @ (p - y) + penalty @ curve)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        curve = curve - step
        if np.abs(step).max() < 1e-8:
            break
    return curve


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content; samples that are too few to train on are the content themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _dictionaries(words: list[tuple[str, int, int]], pieces: list[bytes], totals: tuple[int, int], tried: int) -> tuple[bytes, bytes]:
    """(toxic, ordinary) contents of words (word, contexts in toxic text, in ordinary text) and pieces of ordinary text;
    totals of toxic and ordinary texts, and how many words there were to choose from."""
    toxic, ordinary = totals
    rate = toxic / max(toxic + ordinary, 1)
    many = np.log(max(tried, 2))
    kept = []
    for word, a, b in words:
        share = a / (a + b)
        if a / max(toxic, 1) < 20 * b / max(ordinary, 1) or share <= rate:
            continue
        # Chernoff's bound on so many of a word's contexts being toxic by chance, over all words that were looked at
        surprise = (a + b) * (share * np.log(share / rate) + ((1 - share) * np.log((1 - share) / (1 - rate)) if b else 0.0))
        if surprise > many:
            kept.append((surprise, word, a))
    kept.sort(reverse=True)
    samples = [b" " + word.encode("utf-8", "surrogatepass") + b" " for _, word, a in kept[:MOST_WORDS] for _ in range(min(a, MOST_REPEATS))]
    order = np.random.default_rng(7).permutation(len(samples))
    return _trained([samples[i] for i in order], TOXIC_BYTES), _trained(pieces, ORDINARY_BYTES)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on one row of docs for each id that has a label (0 or 1). Where more than max_rows ids have one, a hash of the
    id picks about max_rows of them: a bounded sample."""
    workspace.small_batches(docs.sparkSession)
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    clean = clean.groupBy("id").agg(F.avg("y").alias("y")).where("y != 0.5").select("id", (F.col("y") > 0.5).cast("int").alias("y"))
    counts = clean.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    share = min(1.0, max_rows / max(counts["n"], 1))
    picked = clean.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about max_rows ids, so a broadcast of a known size; a task keeps one row of an id before rows are sent
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")
    rows = workspace.materialize(rows.withColumn("fold", fold), "labelled")
    totals = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    if not all(any(totals.get((f, y)) for f in range(FOLDS)) for y in (0, 1)):
        return Model(b"", b"", None, counts["toxic"] / counts["n"] if counts["n"] else 0.0)
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    zipped = F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), "w").alias("left"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("right"))
    placed = rows.select("fold", "y", words.alias("w")).select("fold", "y", F.explode(zipped).alias("c")).where("c.word is not null")
    placed = placed.select("fold", "y", F.col("c.word").alias("word"), F.xxhash64("c.left", "c.right").alias("context")).distinct()
    by_word = placed.groupBy("word").agg(*(F.count_if((F.col("fold") == f) & (F.col("y") == y)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)))
    toxic = sum((F.col(f"n{f}1") for f in range(FOLDS)), F.lit(0))
    by_word = workspace.materialize(by_word.where(toxic >= 2), "toxic-words")
    tried = by_word.count()
    # the most frequent words of toxic text: a bounded list
    common = [tuple(r) for r in by_word.orderBy(F.desc(toxic), "word").limit(32 * MOST_WORDS).collect()]
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - PIECE, F.lit(1)))
    pieces = [(r.fold, r.piece.encode("utf-8", "surrogatepass")) for r in rows.where("y = 0 and length(text) > 0").select("fold", F.col("text").substr((start + 1).cast("int"), F.lit(PIECE)).alias("piece")).orderBy("id").collect()]

    def made(folds: Sequence[int]) -> tuple[bytes, bytes]:
        at = [1 + 2 * f for f in folds]
        held = [(w[0], sum(w[i + 1] for i in at), sum(w[i] for i in at)) for w in common]
        n = tuple(sum(totals.get((f, y), 0) for f in folds) for y in (1, 0))
        return _dictionaries([w for w in held if w[1]], [p for f, p in pieces if f in folds], n, tried)

    apart = [made([g for g in range(FOLDS) if g != f]) for f in range(FOLDS)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Compressors(*both) for both in apart]
        for batch in batches:
            y, folds, texts = (batch.column(c).to_pylist() for c in range(3))
            for f in range(FOLDS):
                own = [i for i, g in enumerate(folds) if g == f]
                found = [features(a) for a in ready[f].advantages([texts[i] for i in own])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([y[i] for i in own], pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])

    held = sorted((r.y, r.x) for r in rows.select("y", "fold", "text").mapInArrow(task, "y int, x array<double>").collect())
    curve = calibrated(np.array([x for _, x in held]), np.array([y for y, _ in held], float))
    return Model(*made(range(FOLDS)), tuple(curve.tolist()), 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1. One narrow stage."""
    workspace.small_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = None if model.curve is None else Compressors(model.toxic, model.ordinary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if ready is None:
                found = np.full(len(texts), model.share)
            else:
                seen = np.array([features(a) for a in ready.advantages(texts)]).reshape(len(texts), -1)
                found = _logistic(np.array(model.curve), seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {key}, score double")
