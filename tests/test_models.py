import math

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folia.operators import models


def _spearman(x, y):
    import pandas as pd

    return pd.Series(x).rank().corr(pd.Series(y).rank())


def test_weight_search_tries_steps_of_a_twentieth(spark, sf):
    import pandas as pd

    rng = np.random.default_rng(3)
    d = pd.DataFrame(rng.integers(0, 9, (150, 3)).astype(float), columns=["a", "b", "c"])
    d["t"] = np.round(0.35 * d.a + 0.40 * d.b + 0.25 * d.c, 2)
    got = {tuple(r["weights"]): r["spearman"] for r in models.rank_correlation_grid(spark.createDataFrame(d), ["a", "b", "c"], "t").collect()}
    want = {w: _spearman((w[0] * d.a + w[1] * d.b + w[2] * d.c).round(9), d.t) for w in models.simplex_grid(3)}
    assert len(got) == 231 and all(abs(got[w] - v) < 1e-9 for w, v in want.items())
    assert max(got, key=got.get) == (0.35, 0.4, 0.25)
    assert entry.queries()["m04_simplex_weights"](spark, sf).count() == 231


def test_weight_search_is_the_same_held_or_by_ranges(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    d = pd.DataFrame({"a": rng.integers(0, 5, 900).astype(float), "b": rng.normal(size=900).round(2), "t": rng.integers(0, 40, 900).astype(float)})
    d = pd.concat([d, d[:200], pd.DataFrame({"a": [1.0, None, float("inf")], "b": [None, 1.0, 3e7], "t": [1.0, 1.0, 50.0]})])
    df = spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), "a double, b double, t double")
    d = d.dropna()
    want = {w: _spearman(sum((v * d[c] for v, c in zip(w, "ab", strict=True)), 0.0 * d.t).round(9).fillna(float("inf")), d.t) for w in models.simplex_grid(2)}
    for held in (10_000_000, 0):
        got = models.rank_correlation_grid(df, ["a", "b"], "t", held=held, bucket=100).collect()
        assert len(got) == 21 and all(abs(r["spearman"] - want[tuple(r["weights"])]) < 1e-12 for r in got)
        assert [r["spearman"] for r in got] == sorted((r["spearman"] for r in got), reverse=True)
        assert models.rank_correlation_grid(df.where("false"), ["a", "b"], "t", held=held).count() == 0
        tied = df.select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), "t")
        assert {r["spearman"] for r in models.rank_correlation_grid(tied, ["a", "b"], "t", held=held, bucket=100).collect()} == {None}


def test_weight_search_keeps_no_row_by_grid_point(spark, monkeypatch):
    from folia.operators import windows
    from folia.runtime import cut_lineage

    kept = []

    def cut(df):
        df = cut_lineage(df)
        kept.append(df.count())
        return df

    monkeypatch.setattr(models, "cut_lineage", cut)
    monkeypatch.setattr(windows, "cut_lineage", cut)
    df = spark.range(3000).select((F.col("id") % 1009 / 1009).alias("a"), (F.col("id") % 1013 / 1013).alias("b"), (F.col("id") % 1019 / 1019).alias("c"), (F.col("id") % 997).cast("double").alias("t"))
    assert models.rank_correlation_grid(df, ["a", "b", "c"], "t").count() == 231 and max(kept) <= 3000


def test_robustness_has_all_checks(spark, sf):
    rows = entry.queries()["m09_robustness"](spark, sf).collect()
    got = {r["check"] for r in rows}
    assert got == {"A_whole", "B_lowest_left_out", "C_middle_band", "D_flagged_groups_left_out", "E_no_controls", "F_control", *(f"G_permuted_{i}" for i in range(5)), "H_up_to_holdout", "H_later_means"}
    assert all(math.isfinite(r["value"]) for r in rows)


def test_random_intercept_equals_the_dense_likelihood(spark):
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(25), rng.integers(1, 9, 25))
    x = rng.normal(size=len(g))
    y = 1 + 0.5 * x + rng.normal(size=25)[g] * 0.8 + rng.normal(size=len(g)) * 0.6
    d = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)] + [(0, None, 1.0), (1, 1.0, None)], "g int, x double, y double")
    m = models.random_intercept(d, [F.lit(1.0), F.col("x")], "y", "g")

    def loglik(tau2, s2):
        v = s2 * np.eye(len(g)) + tau2 * (g[:, None] == g)
        xx = np.stack([np.ones(len(g)), x], 1)
        vi = np.linalg.inv(v)
        b = np.linalg.solve(xx.T @ vi @ xx, xx.T @ vi @ y)
        r = y - xx @ b
        return -0.5 * (len(g) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + r @ vi @ r), b, np.sqrt(np.diag(np.linalg.inv(xx.T @ vi @ xx)))

    ll, b, se = loglik(m["tau2"], m["sigma2"])
    assert abs(ll - m["loglik"]) < 1e-6 and np.allclose(b, m["beta"]) and np.allclose(se, m["se"])
    assert all(loglik(m["tau2"] * a, m["sigma2"] * c)[0] <= ll + 1e-4 for a in (0.9, 1, 1.1) for c in (0.9, 1, 1.1))
    assert m["groups"] == 25 and m["n"] == len(g) and m["p"][1] < 0.01


def test_beta_regression_is_the_maximum_of_its_likelihood(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1500)
    mu = 1 / (1 + np.exp(-(0.3 - 0.8 * x)))
    y = np.clip(rng.beta(mu * 6, (1 - mu) * 6), 0, 1)
    y[:3] = [0.0, 1.0, 0.5]
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 0.3), (0.1, None)], "x double, y double")
    m = models.beta_regression(d, [F.lit(1.0), F.col("x")], "y")
    assert m["n"] == 1500 and np.allclose(m["beta"], [0.3, -0.8], atol=0.08) and 4.5 < m["phi"] < 7
    z = (y * 1499 + 0.5) / 1500

    def ll(b0, b1, phi):
        mu = 1 / (1 + np.exp(-(b0 + b1 * x)))
        return sum(math.lgamma(phi) - math.lgamma(a * phi) - math.lgamma((1 - a) * phi) + (a * phi - 1) * math.log(v) + ((1 - a) * phi - 1) * math.log1p(-v) for a, v in zip(mu, z, strict=True))

    best = ll(*m["beta"], m["phi"])
    assert abs(best - m["loglik"]) < 1e-6
    for i, step in ((0, 0.01), (0, -0.01), (1, 0.01), (1, -0.01), (2, 0.05), (2, -0.05)):
        at = [*m["beta"], m["phi"]]
        at[i] += step
        assert ll(*at) < best


def test_nested_ridge_equals_a_plain_one(spark):
    rng = np.random.default_rng(6)
    n = 240
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [3, 0, 1]
    y = x @ [1.0, 0.2, 3.0] + rng.normal(size=n)
    x[rng.random((n, 3)) < 0.1] = np.nan
    d = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, y double")
    folds = {r["k"]: (r["o"], r["i"]) for r in d.select("k", models.fold_of("k", 5).alias("o"), models.fold_of("k", 3, 43).alias("i")).collect()}
    o, i = np.array([folds[k][0] for k in range(n)]), np.array([folds[k][1] for k in range(n)])

    def fit(rows, lam):
        m, s = np.nanmean(x[rows], 0), np.nanstd(x[rows], 0)
        z = np.nan_to_num((x[rows] - m) / s)
        w = np.linalg.solve(z.T @ z + lam * np.eye(3), z.T @ (y[rows] - y[rows].mean()))
        return lambda at: y[rows].mean() + np.nan_to_num((x[at] - m) / s) @ w

    lams, chosen, pred = (0.1, 1.0, 10.0, 100.0), [], np.zeros(n)
    for f in range(5):
        err = {}
        for lam in lams:
            err[lam] = sum(((y[v] - fit((o != f) & (i != j), lam)(v)) ** 2).sum() for j in range(3) for v in [(o != f) & (i == j)])
        chosen.append(min(lams, key=err.get))
        pred[o == f] = fit(o != f, chosen[-1])(o == f)
    got = models.nested_ridge(d, "k", ["a", "b", "c"], "y")
    assert got["lambdas"] == chosen
    assert abs(got["r2"] - (1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert abs(got["spearman"] - np.mean([_spearman(pred[o == f], y[o == f]) for f in range(5)])) < 1e-6


def test_adjustment_for_many_levels_equals_that_for_few(spark):
    rng = np.random.default_rng(7)
    rows = [(k, f"a{rng.integers(6)}" if rng.random() < 0.95 else None, f"b{rng.integers(5)}", float(rng.normal()) if rng.random() < 0.9 else None, float(rng.normal() * 3)) for k in range(300)]
    d = spark.createDataFrame(rows, "k long, a string, b string, x double, y double")
    few = {r["k"]: r["adj"] for r in models.residualise(d, ["a", "b"], ["x"], "y", "adj").collect()}
    many = {r["k"]: r["adj"] for r in models.residualise(d, ["a", "b"], ["x"], "y", "adj", max_levels=3).collect()}
    assert all(abs(few[k] - many[k]) < 1e-6 for k in few)


def test_a_permutation_keeps_the_values(spark):
    d = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "k long, v double")
    got = models.permuted(d, "v", "k", 1).collect()
    assert sorted(r["v"] for r in got) == sorted(float(i % 7) for i in range(200)) and len({r["k"] for r in got}) == 200
    assert sum(r["v"] == r["k"] % 7 for r in got) < 80


def test_a_natural_spline_is_linear_beyond_its_knots(spark):
    d = spark.createDataFrame([(float(v),) for v in range(-20, 41)], "x double")
    knots = models.spline_knots(d, "x")
    assert np.allclose(knots, [-17.0, -3.5, 10.0, 23.5, 37.0])
    got = d.select("x", *[c.alias(f"b{i}") for i, c in enumerate(models.cubic_basis("x", knots))]).orderBy("x").toPandas()
    b = got.drop(columns="x").to_numpy()
    assert b.shape[1] == 4 and np.linalg.matrix_rank(b) == 4
    assert np.allclose(np.diff(b[got.x >= 37], n=2, axis=0), 0, atol=1e-9) and np.allclose(np.diff(b[got.x <= -17], n=2, axis=0), 0, atol=1e-9)
    bend = np.diff(b[(got.x > -17) & (got.x < 37)], n=2, axis=0)
    assert np.abs(bend).max() > 1e-3
