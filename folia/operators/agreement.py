"""Agreement and correlation between raters or measures, from sums that combine partially: no matrix is built in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.operators.windows import average_ranks, prefix_sums
from folia.runtime import cut_lineage


def pearson(x: str, y: str) -> Column:
    """Correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson of average ranks within each group.

    Ranks come from counts of distinct values with distributed prefix sums: equal values are never gathered, and no task sorts a whole group.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    rx, ry = average_ranks(both, keys, x, "_rx").drop("n"), average_ranks(both, keys, y, "_ry").drop("n")
    pairs = both.groupBy(*keys, x, y).agg(F.count("*").alias("_w")).join(rx, [*keys, x]).join(ry, [*keys, y])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    s = pairs.groupBy(*keys).agg(F.sum(w).alias("n"), *[F.sum(w * e).alias(n) for n, e in {"sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}.items()])
    n = F.col("n")
    cov, va, vb = n * F.col("sab") - F.col("sa") * F.col("sb"), n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2
    return s.select(*keys, "n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman"))


def quadratic_kappa(a: Column, b: Column) -> Column:
    """Quadratic-weighted kappa in closed form; null where it is undefined."""
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    x, y = (F.when(a.isNotNull() & b.isNotNull(), c).cast("double") for c in (a, b))
    below = n * F.sum(x * x) + n * F.sum(y * y) - 2 * F.sum(x) * F.sum(y)
    return 1 - F.try_divide(n * F.sum((x - y) * (x - y)), F.nullif(below, F.lit(0.0)))


def percent_agreement(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("double"))


def pair_agreement(long: DataFrame, item: str, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, n_pairs, agreement)``: how often two ratings of an item agree, over all pairs of its ratings.

    From counts of each value per item: an item rated n times has n (n - 1) / 2 pairs, of which those within a value agree. No pair is ever formed.
    """
    c = long.groupBy(*keys, item, value).agg(F.count("*").alias("_n"))
    g = c.groupBy(*keys, item).agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_same"))
    a = g.groupBy(*keys).agg(F.sum(F.col("_m") * (F.col("_m") - 1)).alias("_p"), F.sum("_same").alias("_same"))
    return a.select(*keys, (F.col("_p") / 2).cast("long").alias("n_pairs"), F.try_divide(F.col("_same").cast("double"), F.col("_p")).alias("agreement"))


def icc(long: DataFrame, unit: str, rater: str, x: str) -> DataFrame:
    """ICC(2,1) and ICC(2,k), two-way random, over units rated by every rater."""
    k = long.select(rater).distinct().agg(F.count("*").alias("k"))
    full = long.where(F.col(x).isNotNull()).groupBy(unit).agg(F.count("*").alias("_n"), F.sum(x).alias("_s"), F.sum(F.col(x) ** 2).alias("_q")).crossJoin(F.broadcast(k)).where(F.col("_n") == F.col("k"))
    rows = full.agg(F.count("*").alias("n"), F.first("k").alias("k"), F.sum("_s").alias("t"), F.sum("_q").alias("q"), F.sum(F.col("_s") ** 2 / F.col("k")).alias("r"))
    cols = long.join(full.select(unit), unit).groupBy(rater).agg(F.sum(x).alias("_c"), F.count("*").alias("_m")).agg(F.sum(F.col("_c") ** 2 / F.col("_m")).alias("c"))
    j = rows.crossJoin(F.broadcast(cols))
    n, kk = F.col("n"), F.col("k")
    cf = F.col("t") ** 2 / (n * kk)
    ssr, ssc = F.col("r") - cf, F.col("c") - cf
    sse = F.col("q") - cf - ssr - ssc
    j = j.select("n", "k", (ssr / (n - 1)).alias("msr"), (ssc / (kk - 1)).alias("msc"), (sse / ((n - 1) * (kk - 1))).alias("mse"))
    r, c, e = F.col("msr"), F.col("msc"), F.col("mse")
    return j.select("n", "k", F.try_divide(r - e, r + (kk - 1) * e + kk * (c - e) / n).alias("icc_2_1"), F.try_divide(r - e, r + (c - e) / n).alias("icc_2_k"))


def gwet(long: DataFrame, unit: str, rating: str, categories: int, weighted: bool = False) -> DataFrame:
    """AC1 (nominal) or AC2 (quadratic weights, ratings 0 .. categories-1) for several raters."""
    q = categories
    arr = F.array(*[F.count_if(F.col(rating) == i) for i in range(q)])
    u = long.where(F.col(rating).isNotNull()).groupBy(unit).agg(F.count("*").alias("m"), arr.alias("c"))
    w = [[1.0 - ((i - j) / (q - 1)) ** 2 if weighted else float(i == j) for j in range(q)] for i in range(q)]
    star = [sum((F.col("c")[j] * w[i][j] for j in range(q)), F.lit(0.0)) for i in range(q)]
    agree = sum((F.col("c")[i] * (star[i] - 1) for i in range(q)), F.lit(0.0))
    g = u.agg(F.avg(F.when(F.col("m") >= 2, agree / (F.col("m") * (F.col("m") - 1)))).alias("pa"), F.count("*").alias("n"), *[F.avg(F.col("c")[i] / F.col("m")).alias(f"p{i}") for i in range(q)])
    tw = sum(sum(r) for r in w)
    pe = tw / (q * (q - 1)) * sum((F.col(f"p{i}") * (1 - F.col(f"p{i}")) for i in range(q)), F.lit(0.0))
    return g.select("n", "pa", pe.alias("pe")).select("n", "pa", "pe", F.try_divide(F.col("pa") - F.col("pe"), 1 - F.col("pe")).alias("ac"))


def krippendorff(long: DataFrame, unit: str, rating: str, level: str = "nominal") -> DataFrame:
    """``(alpha)``: Krippendorff's alpha, nominal, ordinal or interval; units with one rating don't count, and without any variation it is null.

    Disagreement within a unit and over all ratings comes from counts and moments, so no table of value pairs is built. The ordinal distance of two values is the difference of their
    mean ranks among the ratings that count, hence the interval form on ranks.
    """
    c = long.where(F.col(rating).isNotNull()).groupBy(unit, F.col(rating).cast("double").alias("v")).agg(F.count("*").alias("n"))
    c = c.join(c.groupBy(unit).agg(F.sum("n").alias("m")).where("m >= 2"), unit)
    if level == "nominal":
        inside = c.groupBy(unit).agg(F.first("m").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same")).agg(F.sum((F.col("m") ** 2 - F.col("same")) / (F.col("m") - 1)).alias("do"))
        across = c.groupBy("v").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("t"), F.sum(F.col("n").cast("double") ** 2).alias("same")).select(((F.col("t") ** 2 - F.col("same")) / (F.col("t") - 1)).alias("de"))
    else:
        if level == "ordinal":
            c = cut_lineage(c)
            ranks = prefix_sums(c.groupBy("v").agg(F.sum("n").alias("_c")).withColumn("_o", F.lit(0)), ["_o"], "v", "_c", "_before")
            c = c.join(ranks.select("v", (F.col("_before") + F.col("_c") / 2.0).alias("x")), "v")
        else:
            c = c.withColumn("x", F.col("v"))
        moments = [F.sum("n").alias("t"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") ** 2).alias("q")]
        spread = 2 * (F.col("t") * F.col("q") - F.col("s") ** 2) / (F.col("t") - 1)  # the sum over ordered pairs of squared differences, over t - 1
        inside = c.groupBy(unit).agg(*moments).agg(F.sum(spread).alias("do"))
        across = c.agg(*moments).select(spread.alias("de"))
    return inside.crossJoin(F.broadcast(across)).select((1 - F.try_divide("do", F.nullif("de", F.lit(0.0)))).alias("alpha"))


#: The measures of each type of field.
METRICS = {"nominal": ("agreement", "ac1", "alpha_nominal"), "boolean": ("agreement", "ac1", "alpha_nominal"), "ordinal": ("agreement", "ac2", "alpha_ordinal", "icc_2_1"), "score": ("agreement", "ac2", "alpha_interval", "icc_2_1")}


def field_metrics(long: DataFrame, item: str, rater: str, value: str, kind: str, categories: int = 2) -> DataFrame:
    """``(metric, value)``: the measures that suit the type of a field (A27). Nominal values may be text; ordinal ones and scores are whole numbers from 0 to ``categories - 1``."""
    ok = long.where(F.col(value).isNotNull())
    if kind in ("nominal", "boolean"):
        levels = ok.select(value).distinct().withColumn("_z", F.xxhash64(value).cast("double"))  # names as numbers: only equality matters
        ok = ok.join(levels, value).drop(value).withColumnRenamed("_z", value)
    out = pair_agreement(ok.withColumn("_all", F.lit(1)), item, ["_all"], value).select(F.lit("agreement").alias("metric"), F.col("agreement").alias("value"))
    for name in METRICS[kind][1:]:
        if name == "ac1":
            one = gwet_nominal(ok, item, value).select(F.col("ac"))
        elif name == "ac2":
            one = gwet(ok, item, value, categories, weighted=True).select("ac")
        elif name == "icc_2_1":
            one = icc(ok, item, rater, value).select("icc_2_1")
        else:
            one = krippendorff(ok, item, value, name.removeprefix("alpha_"))
        out = out.unionByName(one.toDF("value").select(F.lit(name).alias("metric"), "value"))
    return out


def gwet_nominal(long: DataFrame, unit: str, rating: str) -> DataFrame:
    """AC1 for any number of categories, those that occur: from counts, without a column per category."""
    c = long.where(F.col(rating).isNotNull()).groupBy(unit, rating).agg(F.count("*").alias("n"))
    u = c.groupBy(unit).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    pa = u.agg(F.avg(F.when(F.col("m") >= 2, F.col("same") / (F.col("m") * (F.col("m") - 1)))).alias("pa"), F.count("*").alias("units"))
    p = c.join(u.select(unit, "m"), unit).groupBy(rating).agg(F.sum(F.col("n") / F.col("m")).alias("s")).crossJoin(F.broadcast(pa)).select((F.col("s") / F.col("units")).alias("p"), "pa", "units")
    g = p.agg(F.first("units").alias("n"), F.first("pa").alias("pa"), F.sum(F.col("p") * (1 - F.col("p"))).alias("s"), F.count("*").alias("q"))
    g = g.select("n", "pa", F.when(F.col("q") > 1, F.col("s") / (F.col("q") - 1)).otherwise(0.0).alias("pe"))
    return g.select("n", "pa", "pe", F.try_divide(F.col("pa") - F.col("pe"), 1 - F.col("pe")).alias("ac"))


def roll_up(metrics: DataFrame, group: str, field: str) -> DataFrame:
    """``(group, n_fields, mean)`` over fields: of each field AC2 if it has one, else AC1, else its plain agreement (A27). ``metrics(group, field, metric, value)``."""
    best = metrics.where(F.col("metric").isin("ac2", "ac1", "agreement") & F.col("value").isNotNull())
    order = F.when(F.col("metric") == "ac2", 0).when(F.col("metric") == "ac1", 1).otherwise(2)
    per = best.groupBy(group, field).agg(F.min_by("value", order).alias("v"))
    return per.groupBy(group).agg(F.count("*").alias("n_fields"), F.avg("v").alias("mean"))
