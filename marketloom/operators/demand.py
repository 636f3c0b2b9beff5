"""Demand behind badges: interval-censored regression, conditional means, joint draws, held-out accuracy.

Rows stay in Spark. A step of the fit is one aggregation to the sums of a few columns, which the driver solves."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.anchoring import members_of
from marketloom.session import materialize

#: Steps of expectation maximisation, and the ridge on all coefficients but the intercept.
STEPS, RIDGE = 25, 1e-3
_ERF = np.frompyfunc(math.erf, 1, 1)
inverse = NormalDist().inv_cdf


def cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(np.asarray(z, "f8") / math.sqrt(2)).astype("f8"))


def pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def truncated_moments(mean: np.ndarray, sd: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a normal between two bounds; equal bounds are exact, infinite ones open."""
    a, b = (low - mean) / sd, (high - mean) / sd
    za, zb = np.clip(a, -12, 12), np.clip(b, -12, 12)
    mass = np.maximum(cdf(zb) - cdf(za), 1e-300)
    pa, pb = np.where(np.isfinite(a), pdf(za), 0.0), np.where(np.isfinite(b), pdf(zb), 0.0)
    shift = (pa - pb) / mass
    spread = 1 + (np.where(np.isfinite(a), za, 0) * pa - np.where(np.isfinite(b), zb, 0) * pb) / mass - shift**2
    tiny = mass < 1e-12  # the interval lies far out: its nearer end
    near = np.where(np.abs(za) < np.abs(zb), np.where(np.isfinite(low), low, high), np.where(np.isfinite(high), high, low))
    exact = low == high
    mid = np.where(exact, low, np.where(tiny, near, mean + sd * shift))
    return mid, np.where(exact | tiny, 0.0, sd * sd * np.clip(spread, 0.0, 1.0))


def t_cdf(z: np.ndarray, nu: int | None) -> np.ndarray:
    """Distribution function of Student's t with a whole number of degrees of freedom, by its finite sum; None: normal."""
    z = np.asarray(z, "f8")
    if nu is None:
        return cdf(z)
    angle = np.arctan(z / math.sqrt(nu))
    c, total = np.cos(angle), np.zeros_like(z)
    term = c if nu % 2 else np.ones_like(z)
    for k in range(2 + nu % 2, nu + 1, 2):
        total = total + term
        term = term * c * c * (k - 1) / k
    mass = 2 / math.pi * (angle + np.sin(angle) * total) if nu % 2 else np.sin(angle) * total
    return 0.5 * (1 + mass)


def t_pdf(z: np.ndarray, nu: int | None) -> np.ndarray:
    if nu is None:
        return pdf(np.clip(z, -40, 40))
    scale = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    return scale * (1 + np.square(np.clip(z, -1e12, 1e12)) / nu) ** (-(nu + 1) / 2)


@dataclass
class Fit:
    columns: list[str]
    beta: np.ndarray
    sd: float
    rows: int
    nu: int | None = None
    loglik: float = math.nan

    @property
    def family(self) -> str:
        return "normal" if self.nu is None else f"t{self.nu}"

    @property
    def aic(self) -> float:
        """Two for each coefficient, the spread and, for t, the degrees of freedom, less twice the log likelihood."""
        return 2 * (len(self.beta) + 1 + (self.nu is not None)) - 2 * self.loglik


def design(df: DataFrame, numeric: list[str], category: str | None = None, levels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Adds _x (array of doubles): intercept, numeric columns with 0 for unknown, their missing marks, and a mark per level."""
    parts, names = [F.lit(1.0)], ["intercept"]
    for c in numeric:
        parts += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col(c).isNull().cast("double")]
        names += [c, f"{c}_missing"]
    for level in levels or []:
        parts.append(F.coalesce((F.col(category) == level).cast("double"), F.lit(0.0)))
        names.append(f"{category}={level}")
    return df.withColumn("_x", F.array(*parts)), names


def fit_intervals(df: DataFrame, low: str, high: str, columns: list[str], steps: int = STEPS, ridge: float = RIDGE) -> Fit:
    """Log-normal regression on units known to lie in [low, high) (null ``high``: no upper bound), by expectation maximisation.

    The expectations are per row in Arrow batches; each batch returns its sums, so a step moves a small vector per task."""
    return fit_folds(df, low, high, columns, F.lit(-1), 1, steps, ridge)[0]


def fit_folds(df: DataFrame, low: str, high: str, columns: list[str], fold: Column, folds: int, steps: int = STEPS, ridge: float = RIDGE) -> list[Fit]:
    """``fit_intervals`` without each fold in turn. All fits take their steps together, one pass over the rows a step."""
    k = len(columns)
    rows = df.select("_x", F.log(F.greatest(F.col(low), F.lit(0.0))).alias("lo"), F.log(F.col(high)).alias("hi"), fold.cast("int").alias("fold"))
    rows = materialize(rows, "folds")  # read once a step
    betas, sds, counts, size = np.zeros((folds, k)), np.full(folds, 2.0), np.zeros(folds, int), k * k + k + 2

    def sums_of(betas: np.ndarray, sds: np.ndarray):
        def run(batches):
            for b in batches:
                x = np.stack(b["_x"].to_numpy()) if len(b) else np.zeros((0, k))
                lo, hi, out = b["lo"].to_numpy("f8", na_value=-np.inf), b["hi"].to_numpy("f8", na_value=np.inf), []
                lo, hi = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
                for f, (beta, sd) in enumerate(zip(betas, sds, strict=True)):
                    own = b["fold"].to_numpy() != f
                    z = x[own]
                    mid, var = truncated_moments(z @ beta, sd, lo[own], hi[own])
                    out.append(np.concatenate([(z.T @ z).ravel(), z.T @ mid, [mid @ mid + var.sum(), own.sum()]]))
                yield pd.DataFrame({"s": [np.concatenate(out).tolist()]})

        return run

    for _ in range(steps):
        parts = rows.mapInPandas(sums_of(betas, sds), "s array<double>")
        total = parts.agg(*[F.sum(F.get("s", F.lit(i))).alias(f"c{i}") for i in range(folds * size)]).first()
        done = True
        for f, t in enumerate(np.array([v or 0.0 for v in total]).reshape(folds, size)):
            xx, xy, yy, counts[f] = t[: k * k].reshape(k, k), t[k * k : k * k + k], t[-2], int(t[-1])
            if not counts[f]:
                betas[f], sds[f] = 0.0, 1.0
                continue
            penalty = np.eye(k) * ridge * counts[f]
            penalty[0, 0] = 1e-9
            new = np.linalg.solve(xx + penalty, xy)
            new_sd = math.sqrt(max((yy - 2 * new @ xy + new @ xx @ new) / counts[f], 1e-6))
            done &= bool(np.abs(new - betas[f]).max() < 1e-4 and abs(new_sd - sds[f]) < 1e-4)
            betas[f], sds[f] = new, new_sd
        if done:
            break
    return [Fit(columns, betas[f].copy(), float(sds[f]), int(counts[f])) for f in range(folds)]


#: Error families that are compared, the knots of the price curve as shares of its listings, and the listings that a category needs.
FAMILIES, KNOTS, LEVEL_ROWS = (None, 10, 5, 3), (0.05, 0.35, 0.65, 0.95), 5  # fixed values
#: Categories that get a mark of their own at most: the normal equations grow with its square.
LEVELS = 50


def market_design(df: DataFrame, price: str, numeric: list[str], category: str | None = None, knots: tuple[float, ...] = KNOTS, least: int = LEVEL_ROWS, levels: int = LEVELS) -> tuple[DataFrame, list[str]]:
    """Adds _x (array of doubles): intercept; log price and a restricted cubic spline of it, which is linear beyond the end knots;
    numeric columns; marks of unknown values (null or no number), which take the median; marks of the ``levels`` most common categories
    (ties: by name), the first of them the base and the others, like those with fewer than ``least`` listings, pooled. Columns but the marks have mean 0 and deviation 1. Columns without
    spread go; so does the spline where knots coincide."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    values = {"log_price": F.when(F.col(price) > 0, F.log(number(price)))} | {c: number(c) for c in numeric}
    stats = df.agg(*[f(e).alias(f"{n}{c}") for c, e in values.items() for n, f in (("n_", F.count), ("s_", F.stddev), ("m_", F.median))], F.percentile(values["log_price"], F.array(*[F.lit(q) for q in knots])).alias("knots"), F.count(F.lit(1)).alias("rows")).first()
    parts: dict[str, Column] = {}
    marks: dict[str, Column] = {}
    for c, e in values.items():
        if not stats[f"s_{c}"]:
            continue
        parts[c] = filled = F.coalesce(e, F.lit(stats[f"m_{c}"]))
        if stats[f"n_{c}"] < stats["rows"]:
            marks[f"{c}_missing"] = e.isNull().cast("double")
        at = stats["knots"]
        if c == "log_price" and min(np.diff(at)) > 1e-9:
            up = lambda k: F.pow(F.greatest(filled - k, F.lit(0.0)), F.lit(3.0))  # noqa: B023, E731
            first, last, before = at[0], at[-1], at[-2]
            for i, k in enumerate(at[:-2], 1):
                bend = up(k) - up(before) * ((last - k) / (last - before)) + up(last) * ((before - k) / (last - before))
                parts[f"log_price_bend{i}"] = bend / (last - first) ** 2
    if parts:
        spread = df.agg(*[f(e).alias(f"{n}{c}") for c, e in parts.items() for n, f in (("m_", F.avg), ("s_", F.stddev))]).first()
        parts = {c: (e - spread[f"m_{c}"]) / spread[f"s_{c}"] for c, e in parts.items() if spread[f"s_{c}"]}
    if category:
        own = F.coalesce(F.col(category).cast("string"), F.lit("(unknown)"))
        big = [r[0] for r in df.groupBy(own.alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "c").limit(levels).collect()]
        pooled = F.when(own.isin(big), own).otherwise("(other)") if big else F.lit("(other)")
        rest = df.where(~own.isin(big)).isEmpty() if big else True
        marks |= {f"{category}={level}": (pooled == level).cast("double") for level in [*big[1:], *([] if rest else ["(other)"])]}
    columns = {"intercept": F.lit(1.0)} | parts | marks
    return df.withColumn("_x", F.array(*columns.values())), list(columns)


def interval_sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, beta: np.ndarray, log_sd: float, nu: int | None) -> np.ndarray:
    """Log likelihood, rows, its gradient and the negative of its second derivatives, in beta and the log of the spread."""
    sd, exact = math.exp(log_sd), lo == hi
    mid = x @ beta
    a, b = (lo - mid) / sd, (hi - mid) / sd
    flip = a > 0  # both in the upper tail: by its mirror image, which keeps small chances
    mass = np.maximum(t_cdf(np.where(flip, -a, b), nu) - t_cdf(np.where(flip, -b, a), nu), 1e-300)
    pa, pb = np.where(np.isfinite(a), t_pdf(a, nu), 0.0), np.where(np.isfinite(b), t_pdf(b, nu), 0.0)
    za, zb = np.where(np.isfinite(a), a, 0.0), np.where(np.isfinite(b), b, 0.0)
    pull = lambda z: z if nu is None else (nu + 1) * z / (nu + z * z)
    bend = np.ones_like(za) if nu is None else (nu + 1) * (nu - za * za) / (nu + za * za) ** 2
    da, db = -pull(za) * pa, -pull(zb) * pb  # slopes of the density
    inside = lambda v, most: np.clip(v / mass, -most, most)
    like = np.where(exact, np.log(np.maximum(t_pdf(za, nu), 1e-300)) - log_sd, np.log(mass))
    g1 = np.where(exact, pull(za), inside(pa - pb, 1e3))
    g2 = np.where(exact, pull(za) * za - 1, inside(za * pa - zb * pb, 1e3))
    h11 = np.where(exact, -bend, inside(db - da, 1e6) - g1 * g1)
    h12 = np.where(exact, -(za * bend + pull(za)), inside(zb * db - za * da, 1e6) - g1 * g2 - g1)
    h22 = np.where(exact, -(za * za * bend + za * pull(za)), inside(zb * pb - za * pa + zb * zb * db - za * za * da, 1e6) - g2 * g2)
    side = -(x.T @ h12) / sd
    second = np.block([[-(x.T * h11) @ x / sd**2, side[:, None]], [side[None, :], np.array([[-h22.sum()]])]])
    return np.concatenate([[like.sum(), len(x)], x.T @ g1 / sd, [g2.sum()], second.ravel()])


def fit_families(df: DataFrame, low: str, high: str, columns: list[str], families: tuple[int | None, ...] = FAMILIES, ridge: float = 1.0, steps: int = 60) -> list[Fit]:
    """Most likely regressions of log units known to lie in [low, high), one per error family (normal, or t by its degrees of
    freedom), the least AIC first (ties: the order given). ``ridge`` weighs all coefficients but the intercept.

    Newton's steps, with the second derivatives made definite; a step that loses likelihood is halved. All families step in one pass
    over the rows, which sends a few sums per task."""
    k = len(columns)
    rows = df.select("_x", F.log(F.greatest(F.col(low), F.lit(0.0))).alias("lo"), F.log(F.col(high)).alias("hi"))
    rows = materialize(rows)  # read once a step
    penalty = np.array([0.0] + [ridge] * (k - 1) + [0.0])
    width = 2 + (k + 1) + (k + 1) ** 2

    def sums_of(points: list[np.ndarray]):
        def run(batches):
            for b in batches:
                x = np.stack(b["_x"].to_numpy()) if len(b) else np.zeros((0, k))
                lo, hi = b["lo"].to_numpy("f8", na_value=-np.inf), b["hi"].to_numpy("f8", na_value=np.inf)
                lo, hi = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
                with np.errstate(invalid="ignore", over="ignore"):
                    yield pd.DataFrame({"s": [np.concatenate([interval_sums(x, lo, hi, p[:-1], p[-1], nu) for p, nu in zip(points, families, strict=True)]).tolist()]})

        return run

    start = df.agg(F.avg(F.log(F.when(F.col(low) > 0, F.col(low)))), F.avg(F.log(F.col(high)))).first()
    known = [v for v in start if v is not None]
    here = np.zeros(k + 1)
    here[0], here[-1] = (min(known) if known else 0.0), math.log(1.5)
    trial, best = [here.copy() for _ in families], [None] * len(families)
    move, open_ = [np.zeros(k + 1) for _ in families], set(range(len(families)))
    for _ in range(steps):
        parts = rows.mapInPandas(sums_of(trial), "s array<double>").select(F.posexplode("s").alias("i", "v"))
        total = np.zeros(len(families) * width)
        for i, v in parts.groupBy("i").agg(F.sum("v")).collect():
            total[i] = v
        for f, t in enumerate(total.reshape(len(families), width)):
            if f not in open_:
                continue
            aim = t[0] - 0.5 * penalty @ (trial[f] ** 2)
            if best[f] is not None and aim < best[f]["aim"] - 1e-9:
                move[f] = move[f] / 2
            else:
                gain = math.inf if best[f] is None else aim - best[f]["aim"]
                best[f] = {"aim": aim, "point": trial[f], "loglik": t[0], "rows": int(t[1])}
                g, second = t[2 : k + 3] - penalty * trial[f], t[k + 3 :].reshape(k + 1, k + 1) + np.diag(penalty)
                size, axes = np.linalg.eigh((second + second.T) / 2)
                move[f] = axes @ ((axes.T @ g) / np.maximum(np.abs(size), 1e-9 * max(np.abs(size).max(), 1e-9)))
                move[f] *= min(1.0, 2.0 / max(np.abs(move[f]).max(), 1e-12))
                if gain < 1e-7 * (1 + abs(aim)):
                    open_.discard(f)
            trial[f] = best[f]["point"] + move[f]
            trial[f][-1] = np.clip(trial[f][-1], math.log(0.05), math.log(10))
            if np.abs(move[f]).max() < 1e-6:
                open_.discard(f)
        if not open_:
            break
    fits = [Fit(columns, b["point"][:-1], math.exp(b["point"][-1]), b["rows"], nu, float(b["loglik"])) for b, nu in zip(best, families, strict=True)]
    return sorted(fits, key=lambda fit: fit.aic)


def within_bounds(df: DataFrame, low: str, high: str, fit: Fit, shares: tuple[float, ...] = (0.025, 0.975), nodes: int = 48) -> DataFrame:
    """Adds ``units``, the mean of any family between a row's bounds (both known; equal bounds are the value), and ``q0``, ``q1``, ...:
    quantiles of it there. The mean is an integral of the distribution function, by Gauss and Legendre; quantiles by bisection."""
    beta, sd, nu = fit.beta, fit.sd, fit.nu
    places, weights = np.polynomial.legendre.leggauss(nodes)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m, lo, hi = np.stack(x.to_numpy()) @ beta, lo.to_numpy("f8"), hi.to_numpy("f8")
        with np.errstate(divide="ignore", invalid="ignore"):
            chance = lambda v: t_cdf((np.log(v) - m) / sd, nu)
            pa, pb = chance(lo), chance(hi)
            mass, half = np.maximum(pb - pa, 1e-300), (hi - lo) / 2
            area = sum(w * (chance(lo + half * (1 + p)) - pa) for p, w in zip(places, weights, strict=True)) * half
            out = [np.where(pb > pa, hi - area / mass, (lo + hi) / 2)]
            for share in shares:
                left, right = lo.copy(), hi.copy()
                for _ in range(50):
                    middle = (left + right) / 2
                    below = chance(middle) < pa + share * (pb - pa)
                    left, right = np.where(below, middle, left), np.where(below, right, middle)
                out.append((left + right) / 2)
        return pd.Series(np.clip(np.stack(out, axis=1), lo[:, None], hi[:, None]).tolist())

    d = df.withColumn("_w", run(F.col("_x"), F.col(low).cast("double"), F.col(high).cast("double")))
    return d.withColumns({"units": F.get("_w", F.lit(0))} | {f"q{i}": F.get("_w", F.lit(i + 1)) for i in range(len(shares))}).drop("_w")


def cross_validate(df: DataFrame, key: str, observed: str, low: str, high: str, columns: list[str], ladder: tuple[float, ...], folds: int = 5) -> DataFrame:
    """One row: how well held-out rows are predicted, each by the fit without its fold (a hash of the key).

    auc: of the chance to reach the first rung, rows with an observed rung against the others. Over rows with a rung:
    rung_exact and rung_within_one of the predicted median's rung; coverage_80 and coverage_95 of the rung's geometric middle."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
    fits = fit_folds(df, low, high, columns, fold, folds)
    betas = F.array(*[F.array(*[F.lit(float(b)) for b in fit.beta]) for fit in fits])
    mean = F.aggregate(F.zip_with("_x", F.get(betas, fold), lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    scored = df.select(F.col(observed).alias("x"), F.col(low).alias("lo"), F.col(high).alias("hi"), mean.alias("mu"), F.get(F.array(*[F.lit(f.sd) for f in fits]), fold).alias("sd"))
    scored = scored.withColumn("z", (F.col("mu") - math.log(ladder[0])) / F.col("sd"))
    rung = lambda c: F.size(F.filter(F.array(*[F.lit(r) for r in ladder]), lambda r: r <= c))
    off = F.abs(rung(F.exp("mu")) - rung(F.col("x")))
    middle = F.log(F.sqrt(F.greatest("lo", F.lit(1e-9)) * F.col("hi")))
    within = lambda p: F.coalesce(F.abs(middle - F.col("mu")) <= inverse(0.5 + p / 2) * F.col("sd"), F.lit(False))
    share = lambda c: F.avg(F.when(F.col("x").isNotNull(), c.cast("double")))
    figures = scored.agg(F.count(F.lit(1)).alias("rows"), F.count("x").alias("badged"), share(off == 0).alias("rung_exact"), share(off <= 1).alias("rung_within_one"), share(within(0.8)).alias("coverage_80"), share(within(0.95)).alias("coverage_95"))
    return figures.crossJoin(auc(scored, "z", F.col("x").isNotNull()))


def expected_units(df: DataFrame, low: str, high: str, fit: Fit, out: str = "units") -> DataFrame:
    """Adds the mean of the fitted distribution between the bounds; never outside them."""
    beta, sd = fit.beta, fit.sd

    @F.pandas_udf("double")
    def mean(x: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(dtype="float64")
        m = np.stack(x.to_numpy()) @ beta
        lo, hi = lo.to_numpy("f8"), hi.to_numpy("f8")
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (np.log(lo) - m) / sd, np.where(np.isnan(hi), np.inf, (np.log(hi) - m) / sd)
        mass = np.maximum(cdf(np.clip(b, -12, 12)) - cdf(np.clip(a, -12, 12)), 1e-12)
        up = cdf(np.clip(b - sd, -12, 12)) - cdf(np.clip(a - sd, -12, 12))
        value = np.exp(m + sd * sd / 2) * up / mass
        return pd.Series(np.clip(np.where(lo == hi, lo, value), lo, np.where(np.isnan(hi), np.inf, hi)))

    return df.withColumn(out, mean(F.col("_x"), F.col(low).cast("double"), F.col(high).cast("double")))


def joint_draws(df: DataFrame, key: str, low: str, high: str, fit: Fit, sims: int = 40, seed: int = 11) -> DataFrame:
    """(sim, key, units): draws of the fitted distribution between each row's bounds, by a hash of seed, sim and key, so that a
    run agrees with a rerun whatever the partitions, and sums over any set of keys add up."""
    beta, sd = fit.beta, fit.sd
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("sim"), F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    long = df.select(key, "_x", F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).withColumn("u", uniform)

    @F.pandas_udf("double")
    def draw(x: pd.Series, lo: pd.Series, hi: pd.Series, u: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(dtype="float64")
        m = np.stack(x.to_numpy()) @ beta
        lo, hi = lo.to_numpy("f8"), hi.to_numpy("f8")
        with np.errstate(divide="ignore", invalid="ignore"):
            pa = cdf(np.clip((np.log(lo) - m) / sd, -8, 8))
            pb = np.where(np.isnan(hi), 1.0, cdf(np.clip((np.log(hi) - m) / sd, -8, 8)))
        p = np.clip(pa + u.to_numpy() * (pb - pa), 1e-12, 1 - 1e-12)
        value = np.exp(m + sd * np.array([inverse(q) for q in p.tolist()]))
        return pd.Series(np.clip(np.where(lo == hi, lo, value), lo, np.where(np.isnan(hi), np.inf, hi)))

    return long.select("sim", key, draw("_x", "lo", "hi", "u").alias("units"))


def _uniform(seed: int, sim: Column, key: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), sim, F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _bisected(m: np.ndarray, left: np.ndarray, right: np.ndarray, wanted: np.ndarray, sd: float, nu: int | None) -> np.ndarray:
    left, right = left.copy(), right.copy()
    for _ in range(50):
        middle = (left + right) / 2
        below = t_cdf((np.log(middle) - m) / sd, nu) < wanted
        left, right = np.where(below, middle, left), np.where(below, right, middle)
    return (left + right) / 2


def quantiles_between(m: np.ndarray, lo: np.ndarray, hi: np.ndarray, u: np.ndarray, sd: float, nu: int | None, steps: int = 8) -> np.ndarray:
    """Units at the shares ``u`` (rows by draws) of what the distribution has between each row's bounds; NaN where one is unknown.

    Newton's steps from a table, held between the bounds; the few that haven't settled, far out, are bisected."""
    grid = np.sinh(np.linspace(-14, 14, 4001))
    table = t_cdf(grid, nu)
    with np.errstate(all="ignore"):
        a, b = ((np.log(x) - m) / sd for x in (lo, hi))
        pa_, pb = t_cdf(a, nu), t_cdf(b, nu)
        wanted = pa_[:, None] + u * (pb - pa_)[:, None]
        left, right = (np.broadcast_to(x[:, None], u.shape) for x in (a, b))
        z = np.clip(np.interp(wanted, table, grid), left, right)
        settled = np.zeros(u.shape, bool)
        for _ in range(steps):
            over = t_cdf(z, nu) - wanted
            left, right = np.where(over < 0, z, left), np.where(over < 0, right, z)
            new = z - over / t_pdf(z, nu)
            new = np.where((new >= left) & (new <= right), new, (left + right) / 2)
            settled = np.abs(new - z) <= 1e-13 * (1 + np.abs(z))
            z = new
            if settled.all():
                break
        out = np.clip(np.exp(m[:, None] + sd * z), lo[:, None], hi[:, None])
        out[lo == hi] = lo[lo == hi][:, None]
        row, draw = np.nonzero(~settled & (lo < hi)[:, None])
        if len(row):
            out[row, draw] = _bisected(m[row], lo[row], hi[row], wanted[row, draw], sd, nu)
    return out


def family_draws(df: DataFrame, key: str, low: str, high: str, fit: Fit, sims: int = 200, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sim, key, units, and the columns of ``keep``): like ``joint_draws`` for any family; null where a bound is unknown."""
    beta, sd, nu = fit.beta, fit.sd, fit.nu
    long = df.select(key, *keep, "_x", F.col(low).cast("double").alias("_lo"), F.col(high).cast("double").alias("_hi"), F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).withColumn("_u", _uniform(seed, F.col("sim"), key))

    @F.pandas_udf("double")
    def draw(x: pd.Series, lo: pd.Series, hi: pd.Series, u: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(dtype="float64")
        return pd.Series(quantiles_between(np.stack(x.to_numpy()) @ beta, lo.to_numpy("f8"), hi.to_numpy("f8"), u.to_numpy()[:, None], sd, nu)[:, 0])

    return long.select("sim", key, *keep, draw("_x", "_lo", "_hi", "_u").alias("units"))


#: Rows that are drawn at once, and groups whose sums a task holds.
DRAWN, GROUPS = 500, 4096


def family_totals(df: DataFrame, key: str, low: str, high: str, fit: Fit, levels: dict[str, str | None], sims: int = 200, seed: int = 11) -> DataFrame:
    """(level, member, sim, drawn): the sums of ``family_draws`` over the groups of each level (a column; None: all rows), null where none is known.

    Draws never become rows: a task draws for its rows and adds them up, and hands on a group's sums. Null keys are left out."""
    beta, sd, nu, names = fit.beta, fit.sd, fit.nu, list(levels)
    u = F.transform(F.sequence(F.lit(0), F.lit(sims - 1)), lambda sim: _uniform(seed, sim, key))
    member = [m.alias(f"_m{i}") for i, m in enumerate(members_of(levels))]
    rows = df.where(F.col(key).isNotNull()).select("_x", F.col(low).cast("double").alias("_lo"), F.col(high).cast("double").alias("_hi"), u.alias("_u"), *member)

    def add(batches):
        held: dict[tuple[str, str], list] = {}

        def total():
            ends = pa.array((np.arange(len(held) + 1) * sims).astype("i4"))
            sums, known = (np.concatenate([x[j] for x in held.values()]) for j in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.ListArray.from_arrays(ends, pa.array(sums, mask=~known))], ["level", "member", "sums"])

        for whole in batches:
            for at in range(0, whole.num_rows, DRAWN):
                b = whole.slice(at, DRAWN)
                flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)  # noqa: B023, E731
                lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype("f8") for c in ("_lo", "_hi"))
                units = quantiles_between(flat("_x") @ beta, lo, hi, flat("_u"), sd, nu)
                known = ~np.isnan(units)
                units = np.where(known, units, 0.0)
                for i, level in enumerate(names):
                    coded = b.column(f"_m{i}").dictionary_encode()
                    code = coded.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(code, kind="stable")
                    starts = np.searchsorted(code[order], np.arange(len(coded.dictionary)))
                    for name, s, k in zip(coded.dictionary.to_pylist(), np.add.reduceat(units[order], starts), np.logical_or.reduceat(known[order], starts), strict=True):
                        if (level, name) in held:
                            own = held[level, name]
                            own[0], own[1] = own[0] + s, own[1] | k
                        else:
                            held[level, name] = [s, k]
                if len(held) > GROUPS:
                    yield total()
                    held.clear()
        if held:
            yield total()

    parts = rows.mapInArrow(add, "level string, member string, sums array<double>")
    return parts.select("level", "member", F.posexplode("sums").alias("sim", "v")).groupBy("level", "member", "sim").agg(F.sum("v").alias("drawn"))


def group_intervals(draws: DataFrame, groups: DataFrame, key: str, by: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Quantiles of each group's summed draws."""
    totals = draws.join(groups.select(key, by), key).groupBy("sim", by).agg(F.sum("units").alias("total"))
    q = lambda p, n: F.percentile("total", F.lit(p)).alias(n)
    return totals.groupBy(by).agg(q(low, "low"), F.avg("total").alias("estimate"), q(high, "high"))


def auc(df: DataFrame, score: str, hit: str | Column) -> DataFrame:
    """Chance that a hit scores above a miss (half on equal scores), from counts per score: sums before a bin of scores come from one
    row per bin, those within it from a window of its own."""
    from pyspark.sql import Window as W

    h = F.col(hit) if isinstance(hit, str) else hit
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(h.cast("double")).alias("pos"), F.sum((~h).cast("double")).alias("neg")).withColumn("bin", F.floor(F.col("s") * 1000))
    so_far = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    before = g.groupBy("bin").agg(F.sum("neg").alias("neg")).withColumn("before", so_far(W.orderBy("bin"))).select("bin", "before")
    won = g.withColumn("inside", so_far(W.partitionBy("bin").orderBy("s"))).join(before, "bin")
    won = won.withColumn("won", F.col("pos") * (F.col("before") + F.col("inside") + F.col("neg") / 2))
    return won.agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
