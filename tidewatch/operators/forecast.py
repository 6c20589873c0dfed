"""Forecasts of interval series: ARIMA models of many series at once, by two regressions (Hannan and Rissanen).

A long autoregression gives residuals; a second regression on past values and past residuals gives the model. The sums that
both need are aggregates, so rows never leave the executors; only the small system of a series is solved as one row. One
aggregation serves every order (p, q) up to the largest, as a smaller model's sums are part of a larger one's; the order
with the least information criterion is taken. Lags come from windows over chunks, so a series may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .ordering import sliding

#: Standard deviations from the mean to the end of a 68 % interval: the normal quantile of 0.84.
UPPER = 0.994457883209753
_COEFFICIENTS = "p int, q int, d int, constant double, ar array<double>, ma array<double>, sigma double, n long, aic double"


def _steps(d: int) -> list[int]:
    """Weights of a value and its d predecessors in the d-th difference."""
    out = [1]
    for _ in range(d):
        out = [a - b for a, b in zip([*out, 0], [0, *out], strict=True)]
    return out


def _back(df: DataFrame, pos: str, keys: Sequence[str], lags: int, **columns: Column) -> DataFrame:
    """df with, for each named column, the array of its value here and at `lags` places before, latest first; rows without
    as many predecessors go. Places are dense within keys."""
    rows, own, window = sliding(df.withColumns({f"_v_{n}": c for n, c in columns.items()}), pos, lags + 1, keys=keys)
    rows = rows.withColumns({n: F.reverse(F.collect_list(F.struct(F.col(f"_v_{n}").alias("v"))).over(window)) for n in columns})
    rows = rows.where(own & (F.size(next(iter(columns))) == lags + 1)).drop("_chunk", *(f"_v_{n}" for n in columns))
    return rows.withColumns({n: F.transform(n, lambda x: x["v"]) for n in columns})


def _sums(df: DataFrame, keys: Sequence[str], terms: Sequence[Column]) -> DataFrame:
    """(keys, sums: products of all pairs of terms, added up): the normal equations, with the target as the last term."""
    named = df.withColumns({f"_t{i}": t.cast("double") for i, t in enumerate(terms)})
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    out = named.groupBy(*keys).agg(*(F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"_s{i}_{j}") for i, j in pairs), F.count("*").alias("n"))
    out = out.where("n > 0")  # without keys there is a row of no rows
    return out.select(*keys, "n", F.array(*(f"_s{i}_{j}" for i, j in pairs)).alias("sums"))


def _matrix(sums: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = sums
    return out + np.triu(out, 1).T


def solved(matrix: np.ndarray, used: Sequence[int]) -> tuple[np.ndarray, float]:
    """Least squares of the last term on the used ones: (coefficients, sum of squared errors). Terms that others make up
    get the solution of least length."""
    own = list(used)
    a, b = matrix[np.ix_(own, own)], matrix[own, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    found = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    return found, max(float(matrix[-1, -1] - 2 * found @ b + found @ a @ found), 0.0)


def _solve(df: DataFrame, keys: Sequence[str], schema: str, one: Callable[[int, Sequence[float]], dict]) -> DataFrame:
    """One row a series in, one out."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [one(int(n), s) for n, s in zip(pdf["n"], pdf["sums"], strict=True)]
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(made, index=range(len(pdf)))], axis=1)

    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInPandas(task, f"{own + ', ' if own else ''}{schema}")


@dataclass(frozen=True)
class Fitted:
    """coefficients (keys, p, q, d, constant, ar, ma, sigma, n, aic), a row a series; rows (keys, interval_idx, ..., x: values
    here and before, e: residuals before) that the model can predict."""

    coefficients: DataFrame
    rows: DataFrame
    keys: tuple[str, ...]


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def fit(intervals: DataFrame, p: int = 1, d: int = 0, q: int = 1, keys: Sequence[str] = (), long: int | None = None, value: str = "aggregated", choose: bool = False) -> Fitted:
    """Fits a model of order (p, d, q) to each series of intervals (keys, interval_idx: dense from 0, value); with choose, of
    the order up to (p, q) with the least Akaike criterion. long is the order of the first regression. A series with fewer
    values than the orders ask for has no model."""
    if min(p, d, q) < 0 or (long is not None and long < 1):
        raise ValueError(f"no model of order ({p}, {d}, {q})")
    keys, long = tuple(keys), long or max(p, q) + 3
    change = _steps(d)
    rows = _back(intervals, "interval_idx", keys, d + max(long, p), x=F.col(value).cast("double"))
    y = lambda k: reduce(Column.__add__, (F.lit(float(w)) * F.get("x", F.lit(k + i)) for i, w in enumerate(change)))
    first = _solve(_sums(rows, keys, [F.lit(1.0), *(y(k) for k in range(1, long + 1)), y(0)]), keys, "first array<double>", lambda n, s: {"first": solved(_matrix(s, long + 2), range(long + 1))[0].tolist()})
    rows = rows.alias("r").join(F.broadcast(written(first, "long-models")).alias("f"), _same("r", "f", keys)).select("r.*", "f.first")  # a row a series
    error = y(0) - F.get("first", F.lit(0)) - reduce(Column.__add__, (F.get("first", F.lit(k)) * y(k) for k in range(1, long + 1)))
    rows = rows.withColumn("_pos", F.col("interval_idx") - (d + max(long, p)))
    rows = _back(rows.withColumn("_e", error).drop("first"), "_pos", keys, q, e=F.col("_e")).drop("_e", "_pos")
    rows = written(rows, "lagged")
    terms = [F.lit(1.0), *(y(k) for k in range(1, p + 1)), *(F.get("e", F.lit(k)) for k in range(1, q + 1)), y(0)]
    orders = [(a, b) for a in range(p + 1) for b in range(q + 1)] if choose else [(p, q)]

    def second(n: int, sums: Sequence[float]) -> dict:
        matrix, best = _matrix(sums, p + q + 2), None
        for a, b in orders:
            found, wrong = solved(matrix, [0, *range(1, a + 1), *range(p + 1, p + b + 1)])
            aic = n * np.log(max(wrong / n, 1e-300)) + 2 * (a + b + 2)
            if best is None or aic < best["aic"] - 1e-9:
                best = {"p": a, "q": b, "d": d, "constant": found[0], "ar": found[1 : a + 1].tolist(), "ma": found[a + 1 :].tolist(), "sigma": float(np.sqrt(wrong / n)), "n": n, "aic": aic}
        return best

    made = _solve(_sums(rows, keys, terms), keys, _COEFFICIENTS, second)
    return Fitted(written(made, "models"), rows, keys)


def one_step(model: Fitted) -> DataFrame:
    """Each interval predicted from those before it: the rows' columns with mean, upper (end of the 68 % interval) and std_dev,
    which is upper - mean."""
    rows = model.rows.alias("r").join(F.broadcast(model.coefficients).alias("c"), _same("r", "c", model.keys))
    change = lambda k: F.aggregate(F.transform(F.col("_w"), lambda w, i: w * F.get("r.x", i + k)), F.lit(0.0), lambda a, v: a + v)
    weights = F.when(F.col("c.d") == 0, F.array(F.lit(1.0)))
    for d in range(1, 4):
        weights = weights.when(F.col("c.d") == d, F.array(*(F.lit(float(w)) for w in _steps(d))))
    rows = rows.withColumn("_w", weights)
    lagged = F.aggregate(F.transform("c.ar", lambda w, i: w * change(i + 1)), F.lit(0.0), lambda a, v: a + v)
    shocks = F.aggregate(F.transform("c.ma", lambda w, i: w * F.get("r.e", i + 1)), F.lit(0.0), lambda a, v: a + v)
    mean = F.col("c.constant") + lagged + shocks + F.get("r.x", F.lit(0)) - change(F.lit(0))
    out = rows.select("r.*", mean.alias("mean"), (F.lit(UPPER) * F.col("c.sigma")).alias("std_dev")).drop("x", "e")
    return out.withColumn("upper", F.col("mean") + F.col("std_dev"))


def psi_weights(ar: Sequence[float], ma: Sequence[float], d: int, steps: int) -> np.ndarray:
    """Weights of past shocks in a value, of the model with its differences."""
    full = np.convolve(np.concatenate([[1.0], -np.asarray(ar, float)]), np.asarray(_steps(d), float))
    out = np.zeros(steps)
    for k in range(steps):
        out[k] = (1.0 if k == 0 else ma[k - 1] if k <= len(ma) else 0.0) - sum(full[i] * out[k - i] for i in range(1, min(k, len(full) - 1) + 1))
    return out


def ahead(model: Fitted, steps: int) -> DataFrame:
    """(keys, step from 1, interval_idx, mean, upper, std_dev) after the end of each series: shocks to come count 0, and the
    spread grows by the psi weights."""
    last = model.rows.groupBy(*model.keys).agg(F.max_by(F.struct("x", "e", "interval_idx"), "interval_idx").alias("last"))
    rows = last.alias("l").join(F.broadcast(model.coefficients).alias("c"), _same("l", "c", model.keys))
    rows = rows.select(*(F.col(f"l.{k}").alias(k) for k in model.keys), "l.last.x", "l.last.e", "l.last.interval_idx", "c.constant", "c.ar", "c.ma", "c.sigma", "c.d")

    keys = model.keys

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                ar, ma, d = list(r["ar"]), list(r["ma"]), int(r["d"])
                full = np.convolve(np.concatenate([[1.0], -np.asarray(ar, float)]), np.asarray(_steps(d), float))
                x, e = list(r["x"])[::-1], list(r["e"])[::-1]
                spread = np.sqrt(np.cumsum(psi_weights(ar, ma, d, steps) ** 2)) * r["sigma"] * UPPER
                for h in range(1, steps + 1):
                    x.append(r["constant"] - sum(full[i] * x[-i] for i in range(1, len(full))) + sum(w * e[-k] for k, w in enumerate(ma, 1)))
                    e.append(0.0)
                    out.append({**{k: r[k] for k in keys}, "step": h, "interval_idx": int(r["interval_idx"]) + h, "mean": x[-1], "upper": x[-1] + spread[h - 1], "std_dev": spread[h - 1]})
            yield pd.DataFrame(out, columns=[*keys, "step", "interval_idx", "mean", "upper", "std_dev"])

    own = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in model.keys)
    return rows.mapInPandas(task, f"{own}step int, interval_idx long, mean double, upper double, std_dev double")
