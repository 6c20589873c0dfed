"""Monitoring as a stream, by Spark's arbitrary state: sliding accuracy per key with alert levels, and dense interval series.

With event time, rows wait in a key's list state until the watermark has passed them, and then count in order of (time, pos),
whatever batch they came in; what comes later than the watermark goes. A key has one timer, for the first row that waits, which
releases all that the watermark has passed, so a key that falls silent is finished all the same and work grows with the rows. Rows reach a processor in chunks; none holds a micro-batch of a key. The state of a key is what waits
(as many rows as come within the delay) and its last size - 1 scores, which an idle time can end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..tables import scratch

_OUT = "key long, pos long, accuracy double"
_SERIES = "key string, interval_idx long, interval long, aggregated double, num_samples long"
#: Milliseconds that rows are released together; rows of an output frame, of a series and of scores.
TICK, ROWS, CHUNK = 1000, 4096, 1 << 16
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def level_of(value: Column, thresholds: Sequence[tuple[float, str]]) -> Column:
    """The level of the first threshold above the value, else none."""
    out = None
    for limit, level in thresholds:
        out = F.when(value < limit, level) if out is None else out.when(value < limit, level)
    return F.coalesce(out, F.lit("none")) if out is not None else F.lit("none")


class Sliding(StatefulProcessor):
    """Accuracy over a key's latest `size` scores. ordered: rows (key, pos, score, at_us: microseconds) wait for their time."""

    def __init__(self, limit: float, size: int, ordered: bool, idle_ms: int | None) -> None:
        self.limit, self.size, self.ordered, self.idle_ms = limit, size, ordered, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "score double")
        self.waiting = handle.getListState("waiting", "at long, pos long, score double")
        self.seen = handle.getValueState("seen", "at long")
        self.due = handle.getValueState("due", "at long")

    def _await(self, at: int) -> None:
        """A timer for the first row that waits, of this many microseconds."""
        time = -(-at // (1000 * TICK)) * TICK
        self.handle.registerTimer(time)
        self.due.update((time,))

    def _through(self, key: tuple, pos: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        """Accuracy of scores in order; the last ones become the state."""
        before = [x[0] for x in self.last.get()] if self.last.exists() else []
        scores = np.concatenate([np.array([np.nan if x is None else x for x in before], float), own])
        counts = ~np.isnan(scores) & (scores != 0)
        used, hits = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts & (scores >= self.limit))])
        ends = np.arange(len(before) + 1, len(scores) + 1)
        starts = np.maximum(ends - self.size, 0)
        share = 100.0 * (hits[ends] - hits[starts]) / np.maximum(used[ends] - used[starts], 1)
        kept = scores[max(len(scores) - self.size + 1, 0) :]
        if len(kept):
            self.last.put([(None if np.isnan(x) else float(x),) for x in kept])
        return pd.DataFrame({"key": np.full(len(own), key[0], np.int64), "pos": pos, "accuracy": np.where(ends >= self.size, share, np.nan)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last = None, None
        for pdf in rows:
            if not self.ordered:
                pdf = pdf.sort_values("pos", kind="stable")
                yield self._through(key, pdf["pos"].to_numpy(np.int64), pdf["score"].to_numpy(float))
                continue
            if not len(pdf):
                continue
            at = pdf["at_us"].to_numpy(np.int64)
            self.waiting.appendList([(int(a), int(p), None if pd.isna(s) else float(s)) for a, p, s in zip(at, pdf["pos"], pdf["score"], strict=True)])
            first, last = int(at.min()) if first is None else min(first, int(at.min())), int(at.max()) if last is None else max(last, int(at.max()))
        if first is None:
            return
        if not self.due.exists() or -(-first // (1000 * TICK)) * TICK < self.due.get()[0]:
            self._await(first)
        if self.idle_ms is not None:
            latest = -(-last // (1000 * TICK)) * TICK
            if not self.seen.exists() or self.seen.get()[0] < latest:
                self.seen.update((latest,))
            self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, done = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        if not (self.due.exists() and self.due.get()[0] > done) and self.waiting.exists():
            rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
            ready = bisect_right(rows, 1000 * done, key=lambda r: r[0])
            if ready < len(rows):
                self.waiting.put(rows[ready:])
                self._await(rows[ready][0])
            else:
                self.waiting.clear()
                self.due.clear()
            for k in range(0, ready, CHUNK):
                part = rows[k : min(k + CHUNK, ready)]
                yield self._through(key, np.array([r[1] for r in part], np.int64), np.array([np.nan if r[2] is None else r[2] for r in part], float))
        if self.idle_ms is not None and self.seen.exists() and now >= self.seen.get()[0] + self.idle_ms:
            self.last.clear()
            self.seen.clear()

    def close(self) -> None:
        pass


class Dense(StatefulProcessor):
    """A key's sums and counts per interval from a start on, one row for each interval that the watermark has passed, empty
    ones too. The state is the next interval to come out, and sums of those that rows have reached."""

    def __init__(self, start_us: int, unit_us: int) -> None:
        self.start_us, self.unit_us = start_us, unit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "idx long")
        self.sums = handle.getMapState("sums", "idx long", "total double, n long")

    def _end_ms(self, idx: int) -> int:
        return -(-(self.start_us + (idx + 1) * self.unit_us) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            idx = (pdf["at_us"].to_numpy(np.int64) - self.start_us) // self.unit_us
            for k, part in pd.DataFrame({"k": idx, "v": pdf["value"].to_numpy(float)}).groupby("k")["v"]:
                if k < 0 or (self.next.exists() and k < self.next.get()[0]):
                    continue
                before = self.sums.getValue((int(k),)) if self.sums.containsKey((int(k),)) else (0.0, 0)
                self.sums.updateValue((int(k),), (before[0] + float(np.nansum(part)), before[1] + len(part)))
        if not self.next.exists():
            self.next.update((0,))
            self.handle.registerTimer(self._end_ms(0))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        k, done = self.next.get()[0], timerValues.getCurrentWatermarkInMs()
        while self._end_ms(k) <= done:
            out = []
            while self._end_ms(k) <= done and len(out) < ROWS:
                total, n = self.sums.getValue((k,)) if self.sums.containsKey((k,)) else (0.0, 0)
                if n:
                    self.sums.removeKey((k,))
                out.append((key[0], k, (self.start_us + k * self.unit_us) // 10**6, total, n))
                k += 1
            yield pd.DataFrame(out, columns=["key", "interval_idx", "interval", "aggregated", "num_samples"])
        self.next.update((k,))
        self.handle.registerTimer(self._end_ms(k))

    def close(self) -> None:
        pass


def windowed(stream: DataFrame, limit: float, size: int, ts: str | None = None, late: str = "0 seconds", idle_s: int | None = None) -> DataFrame:
    """stream (key, pos, score, and a timestamp ts for order) -> (key, pos, accuracy over the latest `size` scores, null until
    there are as many). Without ts rows count as they arrive, those of a chunk by pos. After idle_s seconds without a row a
    key begins anew."""
    rows = stream.select("key", "pos", "score") if ts is None else stream.withWatermark(ts, late).select("key", "pos", "score", F.unix_micros(ts).alias("at_us"), F.col(ts).alias("event_time"))
    made = rows.groupBy("key").transformWithStateInPandas(Sliding(limit, size, ts is not None, None if idle_s is None else 1000 * idle_s), _OUT, "Append", "None" if ts is None else "EventTime")
    return made.withColumn("accuracy", F.when(~F.isnan("accuracy"), F.col("accuracy")))


def monitor(stream: DataFrame, limit: float, size: int, thresholds: Sequence[tuple[float, str]], ts: str | None = None, late: str = "0 seconds", idle_s: int | None = None) -> DataFrame:
    """(key, pos, accuracy, alert_level); too little history gives none."""
    return windowed(stream, limit, size, ts, late, idle_s).withColumn("alert_level", level_of(F.col("accuracy"), thresholds))


def bucketed(stream: DataFrame, ts: str, value: str, span: str, late: str) -> DataFrame:
    """Sums and counts per span of event time; rows later than the watermark go."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, span)).agg(F.sum(value).alias("aggregated"), F.count("*").alias("num_samples"))
    return out.select(F.col("window.start").alias("interval"), "aggregated", "num_samples")


def dense(stream: DataFrame, key: str, ts: str, value: str, start_s: int, unit_us: int, late: str) -> DataFrame:
    """(key, interval_idx, interval, aggregated, num_samples): a series a key, from start_s on, without gaps: what by_key gives
    of a table, for every interval that the watermark has passed. Rows before the start and rows later than the watermark
    go."""
    rows = stream.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at_us"), F.col(value).cast("double").alias("value"), F.col(ts).alias("event_time"))
    return rows.groupBy("key").transformWithStateInPandas(Dense(start_s * 10**6, unit_us), _SERIES, "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep state in RocksDB, which arbitrary state needs; the session's setting comes back."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE[0])
        else:
            spark.conf.set(_STORE[0], before)


def run_to_end(out: DataFrame, name: str) -> DataFrame:
    """Processes all that the stream's sources hold now, and returns what was written."""
    spark, place = out.sparkSession, scratch(out.sparkSession, name)
    with state_store(spark):
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start(f"{place}/out")
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")
