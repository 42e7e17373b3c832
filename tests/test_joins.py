"""Fuzzy joins, percentiles and agreement against brute force."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from folia.operators import aggregates, agreement, joins


def test_similar_titles_equals_all_pairs(spark):
    rng = random.Random(9)
    words = ["journal", "of", "heat", "mass", "annals", "aa", "aaaa", "letters", "spin", "transport"]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(60)} | {"a" * 20 + " " + "a" * 20, "short", "oneword" * 3})
    values = []
    for t in titles:
        for _ in range(3):
            s = list(t)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(s))
                s[k : k + rng.randint(0, 1)] = rng.choice([[], ["a"], ["x"], [" "]])
            values.append("".join(s))
    values += ["a" * 19 + " " + "a" * 20, ("abc " * 30).strip(), None, ""]
    titles.append(("abc " * 29).strip() + " abd")
    got = {r["value"]: (r["title"], round(r["ratio"], 9)) for r in joins.similar_titles(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    fits = lambda s: s is not None and len(s) >= 8 and " " in s
    want = {}
    for v in set(filter(fits, values)):
        rated = [(-SequenceMatcher(None, v, t).ratio(), t) for t in filter(fits, titles)]
        best = min(rated)
        if -best[0] >= 0.94:
            want[v] = (best[1], round(-best[0], 9))
    assert got == want and len(want) > 60
    low = joins.similar_titles(spark.createDataFrame([("ab cdefgh",)], "value string"), spark.createDataFrame([("ab xyzfgh",)], "title string"), least=0.5)
    assert low.count() == 1  # a bound so loose that strings meet by length


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), None if rng.random() < 0.1 else float(rng.integers(0, 12)), float(rng.normal())) for k in rng.integers(0, 4, 300)] + [(9, None, 1.0), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["k"]: r for r in aggregates.percentiles(df, ["a", "b"], ps, ["k"]).collect()}
    for k in {r[0] for r in rows}:
        for c, i in (("a", 1), ("b", 2)):
            x = [r[i] for r in rows if r[0] == k and r[i] is not None]
            assert (got[k][c] is None) if not x else np.allclose(got[k][c], np.quantile(x, ps))
    whole = aggregates.percentiles(df, ["a"], [0.25]).first()["a"][0]
    assert abs(whole - np.quantile([r[1] for r in rows if r[1] is not None], 0.25)) < 1e-9
    assert aggregates.percentiles(df.where("false"), ["a"], [0.5], ["k"]).count() == 0


def alpha(units, level):
    values = sorted({v for u in units for v in u if len(u) > 1})
    n = {v: sum(u.count(v) for u in units if len(u) > 1) for v in values}
    total = sum(n.values())

    def d(a, b):
        if level == "nominal":
            return float(a != b)
        if level == "interval":
            return (a - b) ** 2
        lo, hi = min(a, b), max(a, b)
        return (sum(n[v] for v in values if lo <= v <= hi) - (n[a] + n[b]) / 2) ** 2

    do = sum(d(a, b) / (len(u) - 1) for u in units if len(u) > 1 for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / total
    de = sum(n[a] * n[b] * d(a, b) for a in values for b in values) / (total * (total - 1))
    return None if de == 0 else 1 - do / de


def test_alpha_equals_its_definition(spark):
    rng = random.Random(3)
    units = [[rng.choice([1, 2, 2, 5, 9]) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    df = spark.createDataFrame([(i, float(v)) for i, u in enumerate(units) for v in u] + [(0, None)], "u int, v double")
    for level in ("nominal", "ordinal", "interval"):
        assert abs(agreement.krippendorff(df, "u", "v", level).first()["alpha"] - alpha(units, level)) < 1e-9
    same = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 2.0), (2, 2.0)], "u int, v double")
    assert agreement.krippendorff(same, "u", "v", "ordinal").first()["alpha"] is None
    assert agreement.krippendorff(df.where("false"), "u", "v", "interval").first()["alpha"] is None


def test_measures_by_type(spark):
    rng = random.Random(4)
    rows = [(u, r, rng.choice(["a", "b", "b", "c"])) for u in range(30) for r in range(3)]
    df = spark.createDataFrame(rows, "u int, r int, v string")
    got = {r["metric"]: r["value"] for r in agreement.field_metrics(df, "u", "r", "v", "nominal").collect()}
    per = [[v for x, _, v in rows if x == u] for u in range(30)]
    pa = np.mean([sum(a == b for a, b in combinations(p, 2)) / 3 for p in per])
    p = [np.mean([x.count(c) / 3 for x in per]) for c in "abc"]
    pe = sum(x * (1 - x) for x in p) / 2
    assert set(got) == {"agreement", "ac1", "alpha_nominal"} and abs(got["agreement"] - pa) < 1e-9 and abs(got["ac1"] - (pa - pe) / (1 - pe)) < 1e-9
    m = spark.createDataFrame([("g", "x", "ac1", 0.4), ("g", "x", "ac2", 0.6), ("g", "y", "agreement", 0.8), ("g", "z", "ac2", None)], "g string, f string, metric string, value double")
    assert [(r["g"], r["n_fields"], round(r["mean"], 9)) for r in agreement.roll_up(m, "g", "f").collect()] == [("g", 2, 0.7)]


def test_readability_summary(spark):
    df = spark.createDataFrame([("a", 1.0, "low"), ("a", 3.0, "high"), (None, 2.0, "medium"), (" ", None, None)], "d string, x double, l string")
    got = {r["d"]: (r["n"], r["mean_x"], r["low_pct"], r["medium_pct"], r["high_pct"]) for r in aggregates.readability_summary(df, "d", ["x"], "l").collect()}
    assert got == {"a": (2, 2.0, 50.0, 0.0, 50.0), "unknown": (2, 2.0, 0.0, 100.0, 0.0)}
