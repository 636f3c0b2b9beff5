"""Forecasts of many short series: methods side by side, and the past forecast anew to see how far to trust them."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

#: What a series needs for a label, in periods and in mean error of its backtest; else it is LOW.
SURE = (("HIGH", 12, 0.15), ("MEDIUM", 6, 0.35))


def _narrow(loss, axes: list[np.ndarray], rounds: int = 4) -> tuple[np.ndarray, float]:
    """Least value of ``loss`` over a grid that is drawn closer around its best point, within the first grid's ends."""
    ends = [(a.min(), a.max()) for a in axes]
    for _ in range(rounds):
        grid = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")])
        values = loss(*grid)
        best = grid[:, int(np.nanargmin(values))]
        axes = [np.clip(np.linspace(b - (a[1] - a[0]), b + (a[1] - a[0]), len(a)), lo, hi) if len(a) > 1 else a for a, b, (lo, hi) in zip(axes, best, ends, strict=True)]
    return best, float(np.nanmin(values))


def damped_trend(y: np.ndarray, horizon: int) -> np.ndarray:
    """Level and damped trend, smoothed by the shares that give the least squared error of a step."""

    def walk(alpha, beta, phi):
        level, trend, error = np.full_like(alpha, y[0]), np.full_like(alpha, y[1] - y[0]), np.zeros_like(alpha)
        for v in y[1:]:
            guess = level + phi * trend
            error += (v - guess) ** 2
            level, before = guess + alpha * (v - guess), level
            trend = beta * (level - before) + (1 - beta) * phi * trend
        return error, level, trend

    best, _ = _narrow(lambda *p: walk(*p)[0], [np.linspace(0.02, 0.98, 9), np.linspace(0.0, 0.98, 9), np.linspace(0.8, 0.98, 5)])
    _, level, trend = walk(*best[:, None])
    return level[0] + trend[0] * np.cumsum(best[2] ** np.arange(1, horizon + 1))


def _arma(y: np.ndarray, horizon: int, order: tuple[int, int, int]) -> tuple[float, np.ndarray]:
    """AIC by the conditional sum of squares over all steps but the first, and the forecast."""
    lags, differences, moving = order
    mean = 0.0 if differences else y.mean()
    z = np.diff(y) if differences else y - mean

    def walk(phi, theta):
        error, total = np.zeros_like(phi), np.zeros_like(phi)
        for i, v in enumerate(z):
            error = v - (phi * z[i - 1] if i else 0.0) - theta * error
            total += error**2 if differences or i else 0.0
        return total, error

    span = np.linspace(-0.95, 0.95, 20)
    best, loss = _narrow(lambda *p: walk(*p)[0], [span if lags else np.zeros(1), span if moving else np.zeros(1)])
    steps = len(y) - 1
    aic = steps * math.log(max(loss, 1e-9) / steps) + 2 * (lags + moving + 1 + (not differences))
    nxt = best[0] * z[-1] + best[1] * walk(*best[:, None])[1][0]
    path = nxt * best[0] ** np.arange(horizon) if best[0] else np.concatenate([[nxt], np.zeros(horizon - 1)])
    return aic, y[-1] + np.cumsum(path) if differences else mean + path


def orders(lags: int = 1, differences: int = 1, moving: int = 1) -> list[tuple[int, int, int]]:
    """Every (lags, differences, moving terms) up to the given ones."""
    return list(product(range(lags + 1), range(differences + 1), range(moving + 1)))


def moving_average(y: np.ndarray, horizon: int, window: int = 3) -> np.ndarray:
    return np.full(horizon, y[-window:].mean())


def straight_line(y: np.ndarray, horizon: int) -> np.ndarray:
    slope, start = np.polyfit(np.arange(len(y)), y, 1)
    return start + slope * np.arange(len(y), len(y) + horizon)


def best_arma(y: np.ndarray, horizon: int, grid: list[tuple[int, int, int]]) -> tuple[np.ndarray, str]:
    """The path of the order of least AIC (ties: the first), and the order."""
    tried = [(*_arma(y, horizon, o), o) for o in grid]
    _, path, order = tried[int(np.argmin([t[0] for t in tried]))]
    return path, "({},{},{})".format(*order)


def paths(y: np.ndarray, horizon: int, grid: list[tuple[int, int, int]]) -> list[tuple[str, str | None, np.ndarray]]:
    """(method, order, values, never below 0) of each method that so many values allow: damped trends from 4 on, autoregressions from 6."""
    found = [("moving_average", None, moving_average(y, horizon)), ("linear_trend", None, straight_line(y, horizon))]
    if len(y) > 3:
        found.append(("damped_trend", None, damped_trend(y, horizon)))
    if len(y) > 5:
        path, order = best_arma(y, horizon, grid)
        found.append(("autoregression", order, path))
    return [(name, order, np.maximum(path, 0)) for name, order, path in found]


def cut_points(df: DataFrame, by: str, period: str, value: str, least: int, tests: int) -> DataFrame:
    """(by, periods, cut, known, next): each series as it was after its last period, and after each of up to ``tests`` periods before it."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    series = rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("y")))), lambda x: x["y"]).alias("ys"))
    n = F.size("ys")
    at = F.sequence(F.greatest(F.lit(least), n - tests), n)
    return series.where(n >= least).select(by, n.cast("long").alias("periods"), F.explode(at).alias("cut"), "ys").select(by, "periods", "cut", F.slice("ys", F.lit(1), F.col("cut")).alias("known"), F.get("ys", F.col("cut")).alias("next"))


def forecast_series(df: DataFrame, by: str, period: str, value: str, horizon: int = 12, least: int = 3, tests: int = 3, grid: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(by, status, periods, methods, model, recent, forecast, total, growth, slope, mape, confidence) of each series.

    The forecast is the mean of the methods' paths. ``mape`` is its mean relative error for the next value at up to ``tests`` earlier cut
    points, each a row of its own with orders chosen anew, so that a series' backtest is spread like any rows; values of 0 tell nothing.
    ``recent`` is the mean of the last ``horizon`` values, ``growth`` the forecast's mean against it. The label comes from ``SURE``; without
    an error it is LOW. ``df`` has one row per series and period; unknown values are left out; shorter series state their periods only."""
    known = df.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    choices = grid or orders()

    def run(batches):
        for b in batches:
            out = []
            for name, n, cut, ys, actual in b.itertuples(index=False):
                steps = horizon if cut == n else 1
                out += [(name, n, cut, actual, method, order, path.tolist()) for method, order, path in paths(np.asarray(ys, "f8"), steps, choices)]
            yield pd.DataFrame(out, columns=[by, "periods", "cut", "next", "method", "model", "path"])

    kind = dict(df.dtypes)[by]
    cuts = cut_points(df, by, period, value, least, tests)
    made = materialize(cuts.repartition(by, "cut").mapInPandas(run, f"{by} {kind}, periods long, cut int, next double, method string, model string, path array<double>"), "paths")
    step = made.select(by, "periods", "cut", "next", F.posexplode("path").alias("step", "v")).groupBy(by, "periods", "cut", "next", "step").agg(F.avg("v").alias("v"))
    past = step.where("cut < periods AND next > 0").groupBy(by).agg(F.avg(F.abs(F.col("v") - F.col("next")) / F.col("next")).alias("mape"))
    ahead = F.transform(F.array_sort(F.collect_list(F.struct("step", "v"))), lambda x: x["v"])
    path = step.where("cut = periods").groupBy(by).agg(ahead.alias("forecast"), F.sum("v").alias("total"), F.avg("v").alias("mean"))
    named = made.where("cut = periods").groupBy(by).agg(F.array_sort(F.collect_list("method")).alias("methods"), F.max("model").alias("model"))
    size = known.groupBy(by).agg(F.count(F.lit(1)).alias("periods"))
    now = cuts.where("cut = periods").select(by, F.slice("known", F.greatest(F.lit(1), F.size("known") - horizon + 1), F.lit(horizon)).alias("last"), "known")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    place = F.transform("known", lambda x, i: i.cast("double"))
    middle = (F.size("known") - 1) / 2
    slope = F.aggregate(F.zip_with(place, "known", lambda i, y: (i - middle) * y), F.lit(0.0), lambda s, x: s + x) / F.aggregate(F.transform(place, lambda i: (i - middle) * (i - middle)), F.lit(0.0), lambda s, x: s + x)
    now = now.select(by, mean("last").alias("recent"), slope.alias("slope"))
    whole = size.join(path, by, "left").join(named, by, "left").join(past, by, "left").join(now, by, "left")
    sure = F.lit("LOW")
    for label, periods, error in reversed(SURE):
        sure = F.when((F.col("periods") >= periods) & (F.col("mape") < error), label).otherwise(sure)
    ok = F.col("forecast").isNotNull()
    return whole.select(
        by, F.when(ok, "ok").otherwise("insufficient_history").alias("status"), "periods", "methods", "model", "recent", "forecast", "total",
        F.when(F.col("recent") > 0, F.col("mean") / F.col("recent") - 1).alias("growth"), "slope", "mape", F.when(ok, sure).alias("confidence"),
    )
