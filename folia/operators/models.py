"""Statistical models on sufficient statistics: Spark sums, a small system is solved on the driver, predictions are column expressions."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.aggregates import percentiles
from folia.operators.agreement import spearman
from folia.operators.windows import prefix_sums
from folia.runtime import cut_lineage


def normal_equations(df: DataFrame, x: Sequence[Column], y: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and n in one aggregate; rows with a null anywhere don't count. The system has as many cells as regressors squared, whatever the rows."""
    k = len(x)
    cols = [c.cast("double").alias(f"x{i}") for i, c in enumerate(x)] + [y.cast("double").alias("y")]
    d = df.select(*cols).dropna()
    aggs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)] + [F.count("*").alias("n")]
    r = d.agg(*aggs).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = r[f"a{i}_{j}"] or 0.0
    return a, np.array([r[f"b{i}"] or 0.0 for i in range(k)]), r["n"]


def ols(df: DataFrame, x: Sequence[Column], y: Column) -> np.ndarray:
    """Least squares; of collinear regressors the smallest solution."""
    a, b, _ = normal_equations(df, x, y)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(df: DataFrame, x: Sequence[str], y: str, lam: float) -> dict[str, float]:
    """Coefficients on the original scale, with ``intercept``, of a ridge on standardised regressors, missing ones at their mean (M3)."""
    m = df.where(F.col(y).isNotNull()).agg(*[e for c in x for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))], F.avg(y).alias("my")).first()
    z = [F.coalesce((F.col(c) - m[f"m_{c}"]) / (m[f"s_{c}"] or 1.0), F.lit(0.0)) if m[f"m_{c}"] is not None else F.lit(0.0) for c in x]
    a, b, _ = normal_equations(df.where(F.col(y).isNotNull()), z, F.col(y) - m["my"])
    w = np.linalg.solve(a + lam * np.eye(len(x)), b)
    coef = {c: float(v / (m[f"s_{c}"] or 1.0)) for c, v in zip(x, w, strict=True)}
    return coef | {"intercept": float(m["my"] - sum(coef[c] * (m[f"m_{c}"] or 0.0) for c in x))}


def predict(coef: dict[str, float], lo: float | None = None, hi: float | None = None) -> Column:
    """A fitted line as an expression, clipped (M6)."""
    e = F.lit(coef["intercept"]) + sum((F.lit(v) * F.col(c) for c, v in coef.items() if c != "intercept"), F.lit(0.0))
    return e if lo is None else F.least(F.greatest(e, F.lit(lo)), F.lit(hi))


def residualise_one(df: DataFrame, cat: str, y: str, out: str) -> DataFrame:
    """``y`` adjusted for one category: the grand mean plus the deviation from the category's mean (M1). Means are aggregated and joined back, not windowed, so hot categories don't matter."""
    means = df.groupBy(cat).agg(F.avg(y).alias("_m"))
    grand = df.agg(F.avg(y).alias("_g"))
    return df.join(means, df[cat].eqNullSafe(means[cat])).drop(means[cat]).crossJoin(F.broadcast(grand)).withColumn(out, F.col("_g") + F.col(y) - F.col("_m")).drop("_m", "_g")


def residualise(df: DataFrame, cats: Sequence[str], nums: Sequence[str], y: str, out: str, max_levels: int = 300, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``y`` adjusted for several categories (one-hot, a null is a level of its own with no column) and standardised numbers with missing indicators (M1).

    Up to ``max_levels`` levels in all the normal equations are solved. Beyond that the same least-squares fit is reached by sweeps: the means of each category and the slopes of the
    numbers are taken out of the rest in turn until nothing of the ``tolerance`` of y's deviation is left to take, so a category may have any number of levels.
    """
    z: list[Column] = []
    if nums:
        m = df.agg(*[e for c in nums for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        for c in nums:
            z += [F.coalesce((F.col(c) - m[f"m_{c}"]) / (m[f"s_{c}"] or 1.0), F.lit(0.0)), F.col(c).isNull().cast("double")]
    grand = df.agg(F.avg(y)).first()[0]
    levels = {c: [r[0] for r in df.select(c).distinct().limit(max_levels + 2).collect()] for c in cats}
    if sum(map(len, levels.values())) <= max_levels:
        x = [F.lit(1.0), *[F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c in cats for v in sorted(v for v in levels[c] if v is not None)], *z]
        beta = ols(df, x, F.col(y))
        fitted = sum((F.lit(float(b)) * e for b, e in zip(beta, x, strict=True)), F.lit(0.0))
        return df.withColumn(out, F.lit(grand) + F.col(y) - fitted)
    d = cut_lineage(df.withColumn("_e", (F.col(y) - F.lit(grand)).cast("double")))
    scale = d.agg(F.stddev_pop("_e")).first()[0] or 1.0
    for _ in range(rounds):
        moved = 0.0
        for c in cats:
            means = d.groupBy(F.col(c).alias("_k")).agg(F.avg("_e").alias("_m"))  # with null as a level: the same fit, as there is an intercept
            d = cut_lineage(d.join(means, F.col(c).eqNullSafe(F.col("_k"))).withColumn("_step", F.coalesce("_m", F.lit(0.0))).drop("_k", "_m"))
            moved = max(moved, d.agg(F.max(F.abs("_step"))).first()[0] or 0.0)
            d = d.withColumn("_e", F.col("_e") - F.col("_step")).drop("_step")
        x = [F.lit(1.0), *z]
        beta = ols(d, x, F.col("_e"))
        step = sum((F.lit(float(b)) * e for b, e in zip(beta, x, strict=True)), F.lit(0.0))
        d = cut_lineage(d.withColumn("_e", F.col("_e") - step))
        if max(moved, float(np.abs(beta).max())) <= tolerance * scale:
            break
    return d.withColumn(out, F.lit(grand) + F.col("_e")).drop("_e")


def percentile_scale(df: DataFrame, features: dict[str, bool], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Adds ``n_<feature>``: 0 to 1 between two percentiles, reversed where asked; 0.5 where they are equal (M2). Percentiles by prefix sums, then expressions."""
    p = percentiles(df, list(features), [lo, hi]).first()
    for c, reverse in features.items():
        if p is None or p[c] is None:
            df = df.withColumn(f"n_{c}", F.lit(None).cast("double"))
            continue
        a, b = p[c]
        x = F.least(F.greatest((F.col(c) - a) / (b - a), F.lit(0.0)), F.lit(1.0)) if b > a else F.when(F.col(c).isNotNull(), 0.5)
        df = df.withColumn(f"n_{c}", 1 - x if reverse else x)
    return df


def simplex_grid(n: int, steps: int = 20) -> list[tuple[float, ...]]:
    """All weights of ``n`` parts in steps that sum to one, in order (M4)."""
    if n == 1:
        return [(1.0,)]

    def go(left: int, k: int):
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in go(left - i, k - 1):
                yield (i, *rest)

    return [tuple(v / steps for v in w) for w in go(steps, n)]


def screen(df: DataFrame, cols: Sequence[str], filled: float = 0.5) -> list[str]:
    """Columns with enough values and more than one distinct value (M5)."""
    r = df.agg(F.count("*").alias("_n"), *[e for c in cols for e in (F.count(c).alias(f"f_{c}"), (F.max(c) != F.min(c)).alias(f"d_{c}"))]).first()
    return [c for c in cols if r["_n"] and r[f"f_{c}"] >= filled * r["_n"] and r[f"d_{c}"]]


def jumps(yearly: DataFrame, key: str, year: str, mean: str, n: str, least: int = 20, by: float = 0.10) -> DataFrame:
    """Years in which a group's mean jumps against the observed year before."""
    prev = F.lag(mean).over(Window.partitionBy(key).orderBy(year))
    return yearly.where(F.col(n) >= least).withColumn("previous", prev).withColumn("jump", F.col(mean) - F.col("previous")).withColumn("flag", F.coalesce((F.abs("jump") >= by), F.lit(False)))


def random_intercept(df: DataFrame, x: Sequence[Column], y: str, group: str, grid: int = 60) -> dict[str, object]:
    """A linear model with a random intercept per group by profile maximum likelihood, with standard errors, normal p-values and 95 % intervals.

    A group enters the likelihood by its size, its sums of x and y and their products. Groups of one size share their weight at any variance ratio, so Spark adds up the products by size: what
    comes back is one row per distinct group size (fewer than the root of twice the rows), however many groups there are. The ratio is searched on a log grid and refined.
    """
    k = len(x)
    names = [f"x{i}" for i in range(k)]
    cols = [c.cast("double").alias(n) for n, c in zip(names, x, strict=True)] + [F.col(y).cast("double").alias("y"), F.col(group).alias("g")]
    d = df.select(*cols).dropna()
    a, b, n = normal_equations(d, [F.col(c) for c in names], F.col("y"))
    yy = d.agg(F.sum(F.col("y") ** 2)).first()[0] or 0.0
    sums = d.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), *[F.sum(c).alias(f"s{c}") for c in names])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per = sums.groupBy("n").agg(
        F.count("*").alias("groups"),
        F.sum(F.col("sy") ** 2).alias("yy"),
        *[F.sum(F.col(f"sx{i}") * F.col("sy")).alias(f"b{i}") for i in range(k)],
        *[F.sum(F.col(f"sx{i}") * F.col(f"sx{j}")).alias(f"a{i}_{j}") for i, j in pairs],
    ).collect()
    ns, m = np.array([r["n"] for r in per], float), np.array([r["groups"] for r in per], float)
    gyy, gxy, gxx = np.array([r["yy"] for r in per], float), np.array([[r[f"b{i}"] for i in range(k)] for r in per], float).reshape(len(per), k), np.zeros((len(per), k, k))
    for i, j in pairs:
        gxx[:, i, j] = gxx[:, j, i] = [r[f"a{i}_{j}"] for r in per]

    def profile(theta: float):
        c = theta / (1 + ns * theta)
        xx, xy, ysq = a - np.tensordot(c, gxx, 1), b - c @ gxy, yy - float(c @ gyy)
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        rss = max(1e-12, ysq - float(beta @ xy))
        ll = -0.5 * (n * np.log(2 * np.pi * rss / max(1, n)) + float(m @ np.log1p(ns * theta)) + n)
        return ll, beta, rss / max(1, n), xx

    thetas = np.concatenate([[0.0], np.exp(np.linspace(-8, 4, grid))])
    best = max(thetas, key=lambda t: profile(t)[0])
    for width in (0.2, 0.05, 0.01):
        best = max([best, *(best * np.exp(np.linspace(-width, width, 21)))], key=lambda t: profile(t)[0])
    ll, beta, s2, xx = profile(best)
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(xx)) * s2, 0, None))
    p = np.array([math.erfc(abs(v / e) / math.sqrt(2)) if e > 0 else float("nan") for v, e in zip(beta, se, strict=True)])
    return {"beta": beta, "se": se, "p": p, "lo": beta - 1.959964 * se, "hi": beta + 1.959964 * se, "sigma2": s2, "tau2": best * s2, "loglik": ll, "aic": 2 * (k + 2) - 2 * ll, "n": n, "groups": int(m.sum())}


def dummies(df: DataFrame, col: str, drop_first: bool = True, least: int = 0, max_levels: int = 300, other: str = "other") -> tuple[DataFrame, dict[str, Column]]:
    """The table with rare levels (fewer than ``least`` rows) and nulls of ``col`` lumped, and one 0/1 column per level in order (F45). More than ``max_levels`` levels are an error: lump them."""
    counts = df.groupBy(col).agg(F.count("*").alias("n")).where((F.col("n") >= least) & F.col(col).isNotNull()).orderBy(F.desc("n"), col).limit(max_levels + 1).collect()
    if len(counts) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    kept = [r[col] for r in counts]
    lumped = df.withColumn(col, F.when(F.col(col).isin(kept), F.col(col)).otherwise(F.lit(other)) if kept else F.lit(other))
    levels = sorted({*kept, *([other] if lumped.where(F.col(col) == other).limit(1).count() else [])}, key=str)
    return lumped, {v: (F.col(col) == v).cast("double") for v in levels[1 if drop_first else 0 :]}


def cubic_basis(c: str, knots: Sequence[float]) -> list[Column]:
    """A natural cubic spline's columns for given knots: linear beyond the outer ones (M7). ``len(knots) - 1`` columns, the first of them ``c`` itself, the others on its scale."""
    wide = float(knots[-1] - knots[0])
    cube = lambda t: F.pow(F.greatest((F.col(c) - F.lit(float(t))) / F.lit(wide), F.lit(0.0)), F.lit(3.0)) * F.lit(wide)
    last, before = knots[-1], knots[-2]
    tail = lambda t: (cube(t) - cube(last)) / F.lit(float(last - t) / wide)
    return [F.col(c).cast("double"), *[tail(t) - tail(before) for t in knots[:-2]]]


def spline_knots(df: DataFrame, c: str, n: int = 5) -> list[float]:
    """Up to ``n`` distinct knots at even quantiles from 5 to 95 % of a column (M7); its least and greatest value if those are fewer than two."""
    q = percentiles(df, [c], [0.05 + 0.9 * i / (n - 1) for i in range(n)]).first()
    knots = sorted(set(q[0] or [])) if q else []
    if len(knots) < 3:
        r = df.agg(F.min(c), F.avg(c), F.max(c)).first()
        knots = sorted({float(v) for v in r if v is not None})
    return knots


def beta_regression(df: DataFrame, x: Sequence[Column], y: str, rounds: int = 60) -> dict[str, object]:
    """Beta regression with logit link by maximum likelihood, with standard errors (M8): Newton steps on the likelihood of the mean's coefficients and the log precision.

    ``y`` in [0, 1] is squeezed by ``(y (N - 1) + 1/2) / N`` with N the rows that take part. Each round is one pass of Arrow batches that give their score and information, summed by Spark.
    """
    k = len(x)
    d = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("y")).dropna()
    n = d.count()
    d = d.withColumn("y", (F.col("y") * (n - 1) + 0.5) / n)
    beta = ols(d, [F.col(f"x{i}") for i in range(k)], F.log(F.col("y") / (1 - F.col("y"))))
    start = d.select(F.avg("y").alias("m"), F.var_pop("y").alias("v")).first()
    phi = max(0.5, start["m"] * (1 - start["m"]) / max(1e-9, start["v"]) - 1) if n else 1.0
    par = np.append(beta, np.log(phi))
    size = 1 + (k + 1) + (k + 1) ** 2

    def one_pass(at: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for b in batches:
                total += beta_terms(b[[f"x{i}" for i in range(k)]].to_numpy(float), b["y"].to_numpy(float), at)
            yield pd.DataFrame([total], columns=[f"t{i}" for i in range(size)])

        r = d.mapInPandas(run, ", ".join(f"t{i} double" for i in range(size))).agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(size)]).first()
        return np.array([r[i] or 0.0 for i in range(size)])

    now = one_pass(par)
    for _ in range(rounds):
        info = now[k + 2 :].reshape(k + 1, k + 1)
        step = np.linalg.lstsq(info, now[1 : k + 2], rcond=None)[0]
        for half in range(20):  # a step that doesn't raise the likelihood is halved
            new = one_pass(par + step / 2**half)
            if new[0] >= now[0] - 1e-9:
                break
        par, now, moved = par + step / 2**half, new, np.abs(step / 2**half).max()
        if moved < 1e-8:
            break
    cov = np.linalg.pinv(now[k + 2 :].reshape(k + 1, k + 1))
    return {"beta": par[:k], "se": np.sqrt(np.clip(np.diag(cov)[:k], 0, None)), "phi": float(np.exp(par[k])), "loglik": float(now[0]), "n": n}


def _digamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log gamma, digamma and trigamma of positive numbers: raised above 8 by the recurrence, then the asymptotic series."""
    x = np.asarray(x, float)
    lift, d, t = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        lift, d, t = lift + np.where(low, np.log(np.where(low, z, 1.0)), 0), d - np.where(low, 1 / z, 0), t + np.where(low, 1 / z**2, 0)
        z = z + low
    i, i2 = 1 / z, 1 / z**2
    lg = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + i / 12 - i * i2 / 360 + i * i2**2 / 1260 - i * i2**3 / 1680
    di = np.log(z) - i / 2 - i2 / 12 + i2**2 / 120 - i2**3 / 252 + i2**4 / 240
    tri = i + i2 / 2 + i * i2 / 6 - i * i2**2 / 30 + i * i2**3 / 42 - i * i2**4 / 30
    return lg - lift, di + d, tri + t


def beta_terms(x: np.ndarray, y: np.ndarray, par: np.ndarray) -> np.ndarray:
    """Log likelihood, score and expected information of a beta regression at ``(coefficients, log precision)``, in one vector."""
    k = x.shape[1]
    mu = np.clip(1 / (1 + np.exp(-np.clip(x @ par[:k], -30, 30))), 1e-9, 1 - 1e-9)
    phi = float(np.exp(np.clip(par[k], -20, 20)))
    a, b = mu * phi, (1 - mu) * phi
    (la, da, ta), (lb, db, tb), (lp, dp, tp) = _digamma(a), _digamma(b), _digamma(np.array([phi]))
    ly, l1y = np.log(y), np.log1p(-y)
    ll = float((lp[0] - la - lb + (a - 1) * ly + (b - 1) * l1y).sum())
    w = mu * (1 - mu)
    star = (ly - l1y) - (da - db)
    g_beta = x.T @ (phi * star * w)
    g_phi = phi * float((mu * star + l1y - db + dp[0]).sum())
    h_bb = (x * (phi**2 * (ta + tb) * w**2)[:, None]).T @ x
    h_bp = x.T @ (phi**2 * (ta * mu - tb * (1 - mu)) * w)
    h_pp = phi**2 * float((ta * mu**2 + tb * (1 - mu) ** 2 - tp[0]).sum())
    info = np.block([[h_bb, h_bp[:, None]], [h_bp[None], np.array([[h_pp]])]])
    return np.concatenate([[ll], g_beta, [g_phi], info.ravel()])


def _score(w: Sequence[float], x: np.ndarray) -> np.ndarray:
    """Weighted sums of the columns, to nine places: beyond 2**53 of them a double has none left to round."""
    with np.errstate(invalid="ignore"):
        s = sum((v * x[:, j] for j, v in enumerate(w)), np.zeros(len(x)))
    small = np.abs(s) < 2**53 / 1e9
    s[small] = np.round(s[small], 9)
    return s


def _ties(s: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct scores in order, those that are no number last, and the sums of ``n`` and ``c`` over each."""
    o = np.argsort(s)
    s = s[o]
    at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))])
    return s[at], np.add.reduceat(n[o], at), np.add.reduceat(c[o], at)


def _rank_sums(n: np.ndarray, c: np.ndarray) -> tuple[float, float, float, float]:
    """Rows, sum of ``c``, and the sums of squares of the scores' ranks and of their products with ``c``, ranks centred on these rows."""
    rank = np.cumsum(n) - n + (n - n.sum()) / 2
    return float(n.sum()), float(c.sum()), float((n * rank * rank).sum()), float((rank * c).sum())


def rank_correlation_grid(df: DataFrame, parts: Sequence[str], target: str, steps: int = 20, held: int = 10_000_000, bucket: int = 500_000) -> DataFrame:
    """``(weights, spearman)`` of weighted sums of ``parts`` with ``target`` for all weights on a simplex grid, best first; the first weights win ties (M4).

    Equal rows are counted once and the target is ranked once, by prefix sums. If that table has at most ``held`` numbers, each task reads all of it and ranks some of the grid points, so that no
    score is moved. Of a larger one the scores of each grid point are sent packed to ranges of about ``bucket`` scores, are ranked there and shifted by the rows below: no task holds a grid point,
    but up to 24 bytes are shuffled for each row and grid point. The ranges come from a few scores, which only balances them.
    """
    spark = df.sparkSession
    grid = simplex_grid(len(parts), steps)
    p = [f"_p{j}" for j in range(len(parts))]
    whole = F.col(target).isNotNull() & sum((F.col(c).isNull().cast("int") for c in parts), F.lit(0)).eqNullSafe(0)
    rows = df.where(whole).select(*[F.col(c).cast("double").alias(a) for a, c in zip(p, parts, strict=True)], F.col(target).alias("_t"))
    rows = cut_lineage(rows.groupBy(*p, "_t").agg(F.count("*").alias("_n")))
    counts = rows.withColumn("_o", F.lit(0)).groupBy("_o", "_t").agg(F.sum("_n").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    ranks = prefix_sums(counts, ["_o"], "_t", "_n", "_before").select("_t", (F.col("_before") + (F.col("_n") - total) / 2.0).alias("_b"))  # centred
    rows = cut_lineage(rows.join(ranks, "_t").select(*p, F.col("_n").cast("double").alias("_n"), (F.col("_n") * F.col("_b")).alias("_c")))
    size, vb = rows.agg(F.count("*"), F.sum((4 * F.col("_c") * F.col("_c") / F.col("_n")).cast("decimal(38,0)"))).first()  # doubled ranks are whole: added up without rounding
    vb = float(vb or 0) / 4

    def ranked(own: list[int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = [b.to_numpy(float) for b in batches if len(b)]
            if x:
                x = np.concatenate(x)
                yield pd.DataFrame([(i, *_rank_sums(*_ties(_score(grid[i], x), x[:, -2], x[:, -1])[1:])) for i in own], columns=["i", "n", "c", "aa", "ab"])

        return run

    sums = "i int, n double, c double, aa double, ab double"
    if size * (len(p) + 2) <= held:
        tasks = min(len(grid), spark.sparkContext.defaultParallelism, 48)
        one = rows.coalesce(1)
        # the exchange of a few rows keeps the branches apart: a union of single partitions would be one task
        x = functools.reduce(DataFrame.unionAll, [one.mapInPandas(ranked(list(range(k, len(grid), tasks))), sums).repartition(1) for k in range(tasks)])
    else:
        ranges = -(-size // bucket)
        some = rows.select(*p).where(F.pmod(F.xxhash64(*p), F.lit(max(1, size // max(20_000, 50 * ranges)))) == 0).toPandas().to_numpy(float)
        cuts = []
        for w in grid:
            s = np.sort(_score(w, some))
            s = np.unique(s[[len(s) * k // ranges for k in range(1, ranges)]]) if len(s) else s
            cuts.append(s[~np.isnan(s)])

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, n = [], 0
            for b in itertools.chain(batches, [None]):
                if b is not None:
                    x.append(b.to_numpy(float))
                    n += len(b)
                if n and (b is None or n >= 200_000):
                    at, x, n = np.concatenate(x), [], 0
                    for i, w in enumerate(grid):
                        got = _ties(_score(w, at), at[:, -2], at[:, -1])
                        ends = np.searchsorted(got[0], cuts[i]).tolist()
                        yield pd.DataFrame([(i, k, *(v[a:z].tobytes() for v in got)) for k, (a, z) in enumerate(zip([0, *ends], [*ends, len(got[0])], strict=True)) if z > a], columns=["i", "k", "s", "n", "c"])

        def merged(g: pd.DataFrame) -> pd.DataFrame:
            s, n, c = (np.frombuffer(b"".join(g[v])) for v in "snc")
            return pd.DataFrame([(g["i"].iloc[0], g["k"].iloc[0], *_rank_sums(*_ties(s, n, c)[1:]))], columns=["i", "k", "n", "c", "aa", "ab"])

        x = rows.mapInPandas(packed, "i int, k int, s binary, n binary, c binary").groupBy("i", "k").applyInPandas(merged, sums.replace("i int,", "i int, k int,"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        x = x.withColumn("_d", below + (F.col("n") - total) / 2.0)  # from the range's centre to that of all rows
        x = x.groupBy("i").agg(F.sum(F.col("aa") + F.col("_d") * F.col("_d") * F.col("n")).alias("aa"), F.sum(F.col("ab") + F.col("_d") * F.col("c")).alias("ab"))
    of = F.broadcast(spark.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(grid)], "i int, weights array<double>"))
    g = x.select("i", F.when((F.col("aa") > 0) & (F.lit(vb) > 0), F.col("ab") / F.sqrt(F.col("aa") * F.lit(vb))).alias("spearman"))
    return g.join(of, "i").orderBy(F.desc("spearman"), "i").select("weights", "spearman")


def fold_of(key: str, k: int, seed: int = 42) -> Column:
    """A row's fold by hash: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


class FoldMoments:
    """Sums of products of ``[1, values, presence]`` and y by (outer, inner) fold: one pass, from which any ridge on any folds follows. A missing value counts as the training mean."""

    def __init__(self, df: DataFrame, key: str, x: Sequence[str], y: str, outer: int, inner: int):
        self.k, self.outer, self.inner = len(x), outer, inner
        q = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in x], *[F.col(c).isNotNull().cast("double") for c in x]]
        n = len(q)
        d = df.where(F.col(y).isNotNull()).select(fold_of(key, outer).alias("o"), fold_of(key, inner, 43).alias("i"), F.col(y).cast("double").alias("y"), *[c.alias(f"q{j}") for j, c in enumerate(q)])
        sums = [F.sum(F.col(f"q{a}") * F.col(f"q{b}")).alias(f"g{a}_{b}") for a in range(n) for b in range(a, n)] + [F.sum(F.col(f"q{a}") * F.col("y")).alias(f"h{a}") for a in range(n)] + [F.sum(F.col("y") ** 2).alias("yy")]
        self.cells: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]] = {}
        for r in d.groupBy("o", "i").agg(*sums).collect():
            g = np.zeros((n, n))
            for a in range(n):
                for b in range(a, n):
                    g[a, b] = g[b, a] = r[f"g{a}_{b}"]
            self.cells[r["o"], r["i"]] = (g, np.array([r[f"h{a}"] for a in range(n)]), r["yy"])

    def of(self, keep) -> tuple[np.ndarray, np.ndarray, float]:
        n = 1 + 2 * self.k
        g, h, yy = np.zeros((n, n)), np.zeros(n), 0.0
        for (o, i), (a, b, c) in self.cells.items():
            if keep(o, i):
                g, h, yy = g + a, h + b, yy + c
        return g, h, yy

    def fit(self, g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
        """Coefficients on ``[1, values, presence]`` of a ridge on standardised regressors."""
        k = self.k
        u, p = slice(1, 1 + k), slice(1 + k, 1 + 2 * k)
        there = np.maximum(g[0, p], 1e-300)
        mean = g[0, u] / there
        sd = np.sqrt(np.maximum(np.diag(g[u, u]) / there - mean**2, 0.0))
        sd = np.where(sd > 1e-12, sd, 1.0)
        z = (g[u, u] - mean[:, None] * g[p, u] - g[u, p] * mean + mean[:, None] * g[p, p] * mean) / np.outer(sd, sd)
        ybar = h[0] / max(g[0, 0], 1e-300)
        zy = (h[u] - mean * h[p]) / sd  # standardised values sum to nothing, so y needs no centring here
        w = np.linalg.solve(z + lam * np.eye(k), zy) / sd
        return np.concatenate([[ybar], w, -w * mean])

    @staticmethod
    def error(c: np.ndarray, part: tuple[np.ndarray, np.ndarray, float]) -> float:
        g, h, yy = part
        return float(yy - 2 * c @ h + c @ g @ c)


def nested_ridge(df: DataFrame, key: str, x: Sequence[str], y: str, lams: Sequence[float] = (0.1, 1.0, 10.0, 100.0), outer: int = 5, inner: int = 3) -> dict[str, object]:
    """Nested cross-validation of a ridge (M3): the penalty of each outer fold is the one of least inner error on its training part, held-out rows never have a say in it.

    ``{"lambdas", "r2", "spearman", "sd", "n"}``: penalties by outer fold, held-out R squared over all rows, mean and deviation over outer folds of Spearman's correlation of prediction and y.
    """
    m = FoldMoments(df, key, x, y, outer, inner)
    chosen, pred, sse, d = [], None, 0.0, df.where(F.col(y).isNotNull()).withColumn("_f", fold_of(key, outer))
    for f in range(outer):
        err = {lam: sum(m.error(m.fit(*m.of(lambda o, i, j=j: o != f and i != j)[:2], lam), m.of(lambda o, i, j=j: o != f and i == j)) for j in range(inner)) for lam in lams}
        lam = min(lams, key=lambda v: err[v])
        c = m.fit(*m.of(lambda o, i: o != f)[:2], lam)
        sse += m.error(c, m.of(lambda o, i: o == f))
        chosen.append(lam)
        k = len(x)
        e = F.lit(float(c[0])) + sum((F.coalesce(F.col(v).cast("double") * float(c[1 + j]) + float(c[1 + k + j]), F.lit(0.0)) for j, v in enumerate(x)), F.lit(0.0))
        pred = F.when(F.col("_f") == f, e) if pred is None else pred.when(F.col("_f") == f, e)
    g, h, yy = m.of(lambda o, i: True)
    n = g[0, 0]
    sst = yy - h[0] ** 2 / n if n else 0.0
    rho = [r["spearman"] for r in spearman(d.select("_f", F.round(pred, 9).alias("_p"), F.col(y).cast("double").alias("_y")), ["_f"], "_p", "_y").collect() if r["spearman"] is not None]
    return {"lambdas": chosen, "r2": 1 - sse / sst if sst > 0 else float("nan"), "spearman": float(np.mean(rho)) if rho else float("nan"), "sd": float(np.std(rho)) if rho else float("nan"), "n": int(n)}


def ablation(df: DataFrame, key: str, families: dict[str, Sequence[str]], y: str, baselines: dict[str, Column] | None = None, **how) -> list[tuple[str, str, int, float, float]]:
    """``(kind, name, features, spearman, sd)``: the nested cross-validation of each family of features, best first, then direct baselines: measures taken as the prediction."""
    got = []
    for n, cols in families.items():
        r = nested_ridge(df, key, cols, y, **how)
        got.append(("ridge", n, len(cols), r["spearman"], r["sd"]))
    got.sort(key=lambda r: (-r[3], r[1]))
    for n, c in (baselines or {}).items():
        r = spearman(df.select(F.lit(0).alias("_o"), F.round(c.cast("double"), 9).alias("_p"), F.col(y).cast("double").alias("_y")), ["_o"], "_p", "_y").first()
        got.append(("baseline", n, 1, float(r["spearman"]) if r and r["spearman"] is not None else float("nan"), 0.0))
    return got


def trend_table(df: DataFrame, key: str, year: str, y: str, least_cell: int = 20, least_group: int = 100) -> DataFrame:
    """Slopes of yearly means per group, over cells and groups that are large enough, steepest first."""
    ok = df.where(F.col(year).isNotNull() & F.col(y).isNotNull())
    cells = ok.groupBy(key, year).agg(F.count("*").alias("n"), F.avg(y).alias("m")).where(F.col("n") >= least_cell)
    g = cells.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("years"), F.covar_pop(year, "m").alias("c"), F.var_pop(year).alias("v")).where((F.col("n") >= least_group) & (F.col("years") >= 3))
    return g.select(key, "n", "years", F.try_divide("c", F.nullif("v", F.lit(0.0))).alias("slope")).orderBy(F.desc(F.abs("slope")), key)


def global_trend(df: DataFrame, year: str, y: str, lo: int, hi: int, least: int = 100) -> DataFrame:
    """Yearly means within a window of years, thin years left out."""
    return df.where(F.col(year).between(lo, hi) & F.col(y).isNotNull()).groupBy(year).agg(F.count("*").alias("n"), F.avg(y).alias("mean")).where(F.col("n") >= least)


def robustness(df: DataFrame, key: str, year: str, y: str, group: str, domain: str, controls: Sequence[str], flagged: DataFrame, holdout: int, permutations: int = 5, tail: float = 0.1) -> list[tuple[str, str, float]]:
    """``(check, measure, value)``: the year's coefficient in a mixed model (domain and controls fixed, random intercept per group) under the variations of M9.

    A the whole; B without the lowest ``tail`` of each control; C the middle band of the first control; D without the groups of ``flagged(group)``; E without controls; F correlations of the
    second control with the year and with y; G ``permutations`` of the years; H years up to ``holdout``, and the later years' means.
    """
    d = df.where(F.col(year).isNotNull() & F.col(y).isNotNull())
    for c in controls:
        d = d.where(F.col(c).isNotNull())
    first = d.agg(F.min(year)).first()[0] or 0
    d, levels = dummies(cut_lineage(d.withColumn("_year", (F.col(year) - first).cast("double"))), domain)
    q = percentiles(d, list(controls), [tail, 1 - tail]).first()

    def fit(part: DataFrame, label: str, with_controls: bool = True) -> list[tuple[str, str, float]]:
        x = [F.lit(1.0), F.col("_year"), *levels.values(), *([F.col(c) for c in controls] if with_controls else [])]
        m = random_intercept(part, x, y, group)
        return [(label, n, float(v)) for n, v in (("n", m["n"]), ("year_coef", m["beta"][1]), ("ci_lo", m["lo"][1]), ("ci_hi", m["hi"][1]), ("p", m["p"][1]))]

    low = d
    for c in controls:
        low = low.where(F.col(c) > q[c][0])
    out = fit(d, "A_whole") + fit(low, "B_lowest_left_out") + fit(d.where(F.col(controls[0]).between(*q[controls[0]])), "C_middle_band")
    out += fit(d.join(flagged.select(group).distinct(), group, "left_anti"), "D_flagged_groups_left_out") + fit(d, "E_no_controls", False)
    r = d.agg(F.corr("_year", controls[-1]), F.corr(controls[-1], y)).first()
    out += [("F_control", "corr_year", float(r[0])), ("F_control", "corr_y", float(r[1]))]
    for p in range(permutations):
        out += [(f"G_permuted_{p}", n, v) for _, n, v in fit(permuted(d, "_year", key, p), "") if n in ("year_coef", "p")]
    out += fit(d.where(F.col(year) <= holdout), "H_up_to_holdout")
    later = d.where(F.col(year) > holdout).groupBy(year).agg(F.avg(y).alias("m")).orderBy(year).collect()
    return out + [("H_later_means", str(int(r[year])), float(r["m"])) for r in later]


def permuted(df: DataFrame, col: str, key: str, seed: int) -> DataFrame:
    """A column's values dealt out anew: rows in hash order get the values in the order of another hash, an exact permutation. Places are distributed prefix sums, so nothing is gathered."""
    rows = df.withColumn("_r", F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id()))
    rows = cut_lineage(rows)
    place = lambda d, o: prefix_sums(d.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)), ["_all"], o, "_one", "_at").drop("_one", "_all")
    to = place(rows.drop(col), "_r").drop("_r")
    values = place(rows.select(F.col(col), F.xxhash64(F.lit(seed + 1_000_003), F.col("_r")).alias("_v")), "_v").select(col, "_at")
    return to.join(values, "_at").drop("_at")
