"""Grouped measures: coverage and completeness scores, summaries, quantiles, trends, quality gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.windows import prefix_sums

#: What a verdict is worth.
VERDICT_SCORES = {"explicit": 1.0, "implied": 0.5, "absent": 0.0}
RELATION_SCORES = {"traceable": 1.0, "partial": 0.5, "not": 0.0, "not_traceable": 0.0}


def verdict_score(v: Column) -> Column:
    s = F.lower(F.trim(v))
    return F.when(s == "explicit", 1.0).when(s == "implied", 0.5).when(s == "absent", 0.0)


def array_coverage(verdicts: Column) -> Column:
    """The mean score of an array of verdicts; unknown ones are skipped, an empty array counts 0 (A1)."""
    known = F.filter(F.transform(verdicts, verdict_score), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))


def section_coverage(entities: DataFrame, keys: Sequence[str], verdict: str) -> DataFrame:
    """Coverage and verdict counts per section from one row per entity (A1, A5): one partial aggregate."""
    v = F.lower(F.trim(F.col(verdict)))
    return entities.groupBy(*keys).agg(
        F.coalesce(F.avg(verdict_score(F.col(verdict))), F.lit(0.0)).alias("coverage"),
        F.count_if(v == "explicit").alias("n_explicit"),
        F.count_if(v == "implied").alias("n_implied"),
        F.count_if(v == "absent").alias("n_absent"),
    )


def document_scores(coverage: DataFrame, key: str, section: str, relations: DataFrame, relation_score: str, sections: Sequence[str], weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """``(key, s, r, c, level)``: S over all sections (a missing one counts 0), R over known relations, C weighted, level the sections with any coverage (A2)."""
    s = coverage.groupBy(key).agg((F.sum("coverage") / len(sections)).alias("s"), F.count_if(F.col("coverage") > 0).cast("int").alias("level"))
    r = relations.groupBy(key).agg(F.coalesce(F.avg(relation_score), F.lit(0.0)).alias("r"))
    j = s.join(r, key, "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    return j.select(key, "s", "r", (weights[0] * F.col("s") + weights[1] * F.col("r")).alias("c"), "level")


def present_count(*flags: Column) -> Column:
    """The number of components present (A3)."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))


def method_summary(df: DataFrame, keys: Sequence[str], measures: Sequence[str], scored: Column) -> DataFrame:
    """Numbers of rows and of scored rows, and means."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(scored).alias("n_scored"), *[F.avg(m).alias(f"mean_{m}") for m in measures])


def level_comparison(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """How often two levels agree, agree within one, exceed, and by how much."""
    d = F.col(a) - F.col(b)
    pct = lambda c: F.avg(c.cast("double")) * 100
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), pct(d == 0).alias("exact_pct"), pct(F.abs(d) <= 1).alias("within1_pct"), pct(d > 0).alias("higher_pct"), F.avg(d).alias("mean_diff"))


def confusion(df: DataFrame, a: str, b: str, lo: int, hi: int) -> DataFrame:
    """The full matrix of counts, zeros included."""
    spark = df.sparkSession
    grid = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(a)).crossJoin(F.broadcast(spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(b))))
    return grid.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value: Column, lo: int, hi: int) -> DataFrame:
    """Counts of whole values from ``lo`` to ``hi``, zeros included."""
    bins = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(df.groupBy(value.cast("int").alias("bin")).agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def group_key(c: Column, missing: str = "UNKNOWN") -> Column:
    return F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(missing))


def group_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """Several groupings in one pass over the input."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.grouping_id().cast("long").alias("grouping"), *aggs)


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Global measures as ``(metric, value)`` from one aggregate."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in metrics]), F.array(*[F.col(n) for n in metrics]))).alias("metric", "value"))


def frequencies(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, value, n)`` of categorical fields in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def run_summary(df: DataFrame, keys: Sequence[str], status: str, latency: str, tokens: str) -> DataFrame:
    """Status counts, success share, latency, tokens."""
    ok = F.col(status) == "success"
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_success"), F.avg(ok.cast("double")).alias("success_share"), F.avg(latency).alias("mean_latency"), F.sum(tokens).alias("tokens"))
    mid = percentiles(df, [latency], [0.5], keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(latency)[0].alias("median_latency"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return g.join(mid, same, "left").select(*keys, "n", "n_success", "success_share", "mean_latency", "median_latency", "tokens")


def readability_summary(df: DataFrame, key: str, components: Sequence[str], level: str) -> DataFrame:
    """Per group, null as ``unknown``: the number of rows, the mean of each component and the percentages of low, medium and high rows."""
    share = lambda v: (100.0 * F.avg((F.col(level) == v).cast("double"))).alias(f"{v}_pct")
    return df.groupBy(group_key(F.col(key).cast("string"), "unknown").alias(key)).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in components], *[share(v) for v in ("low", "medium", "high")])


def population_sd(xs: Column) -> Column:
    """The population standard deviation of an array; null if it is empty."""
    n = F.size(xs)
    mean = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), n)
    return F.sqrt(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n))


def words(text: Column) -> Column:
    """The number of blank-separated words; 0 for null and blank."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def percentiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated percentiles of each column as arrays, null where a group has no value.

    Values are counted, distinct values placed by distributed prefix sums, and the two ranks on either side of each percentile picked out: no task holds the values of a group.
    """
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(cols)]))
    counts = df.select(*keys, cell.alias("_z")).select(*keys, "_z._c", "_z._x").where(F.col("_x").isNotNull()).groupBy(*keys, "_c", "_x").agg(F.count("*").alias("_n"))
    placed = prefix_sums(counts, [*keys, "_c"], "_x", "_n", "_before")
    sizes = counts.groupBy(*keys, "_c").agg(F.sum("_n").alias("_all"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_c")]
    rows = placed.alias("a").join(sizes.alias("b"), reduce(and_, on)).select("a.*", "b._all")
    at = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))
    lo = [F.max(F.when(holds(F.floor(at(p))), F.col("_x"))) for p in ps]
    hi = [F.max(F.when(holds(F.ceil(at(p))), F.col("_x"))) for p in ps]
    part = [F.max(at(p) - F.floor(at(p))) for p in ps]
    per = rows.groupBy(*keys, "_c").agg(F.array(*[a + (b - a) * w for a, b, w in zip(lo, hi, part, strict=True)]).alias("_q"))
    wide = per.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(c) for i, c in enumerate(cols)])
    if not keys:
        return wide
    groups = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()  # a group without any value keeps its row
    same = reduce(and_, [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)])
    return groups.join(wide, same, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *cols)


def mean_ci(df: DataFrame, keys: Sequence[str], x: str, z: float = 1.96) -> DataFrame:
    """Mean, sample deviation and normal interval; one value has deviation 0."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"))
    half = z * F.col("sd") / F.sqrt("n")
    return g.select(*keys, "n", "mean", "sd", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def slope(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 2) -> DataFrame:
    """The least-squares slope; null for fewer than ``least`` points or one distinct x."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    # from moments: exact for constant x, where a division would fail
    g = df.where(ok).groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"))
    return g.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("vx") > 0), F.try_divide("cxy", "vx")).alias("slope"))


def quadrants(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows by whether two measures reach their medians."""
    mid = percentiles(df, [a, b], [0.5]).select(F.col(a)[0].alias("_ma"), F.col(b)[0].alias("_mb"))
    q = F.concat(F.when(F.col(a) >= F.col("_ma"), "high").otherwise("low"), F.lit("_"), F.when(F.col(b) >= F.col("_mb"), "high").otherwise("low"))
    j = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).crossJoin(F.broadcast(mid)).groupBy(q.alias("quadrant")).agg(F.count("*").alias("n"), F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}"))
    return j.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def shrunk_deviation(df: DataFrame, key: str, x: str, k: float = 25.0, least: int = 20) -> DataFrame:
    """Deviation of group means from the grand mean, drawn to it for small groups."""
    grand = df.agg(F.avg(x).alias("_g"))
    g = df.where(F.col(x).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("mean")).where(F.col("n") >= least)
    return g.crossJoin(F.broadcast(grand)).select(key, "n", "mean", ((F.col("mean") - F.col("_g")) * F.col("n") / (F.col("n") + k)).alias("deviation"))


def entropy(df: DataFrame, keys: Sequence[str], value: str, cells: int | None = None) -> DataFrame:
    """Entropy in bits of a value's counts; of ``cells`` possible ones also normalised."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # sum over p = n/N of -p log p = log N - (sum n log n) / N: no second pass for N
    g = c.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.log2("_n")).alias("_s"))
    h = F.log2("n") - F.col("_s") / F.col("n")
    out = g.select(*keys, "n", h.alias("entropy"))
    return out.withColumn("normalised", F.col("entropy") / F.log2(F.lit(float(cells)))) if cells else out


def pooled(df: DataFrame, key: str, aggs: Sequence[Column], name: str = "POOLED") -> DataFrame:
    """Each group and the pool of all, in one pass."""
    return df.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).alias("_g"), *aggs).withColumn(key, F.when(F.col("_g") == 1, name).otherwise(F.col(key))).drop("_g")


def readiness(metrics: DataFrame, n: str, complete: str, valid: str, corrupted: str) -> DataFrame:
    """``(ready, reason)`` from one row of measures: the first rule that fails."""
    reason = F.when(F.col(n) == 0, "empty").when(F.col(complete) < 0.9, "incomplete").when(F.col(valid) < 0.9, "invalid_images").when(F.col(corrupted) > 0.05, "corrupted")
    return metrics.select(F.when(reason.isNull(), "YES").otherwise("NO").alias("ready"), F.coalesce(reason, F.lit("")).alias("reason"))


def expected_missing(expected: Column, found: Column, unrecovered: Column) -> Column:
    """How many expected items are still missing."""
    return F.greatest(unrecovered, expected - found, F.lit(0))


def zero_filled(cols: Sequence[str], skip_failed: bool = False) -> dict[str, Column]:
    """Failed rows count as zeros in means, or not at all."""
    return {c: F.col(c) if skip_failed else F.coalesce(F.col(c), F.lit(0.0)) for c in cols}


def lump_small(df: DataFrame, key: str, least: int, other: str = "other") -> DataFrame:
    """Categories of fewer than ``least`` rows become one (PRJ17). Counts are aggregated and joined back, so that a hot category isn't gathered in a window."""
    big = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key, F.lit(True).alias("_big"))
    return df.join(big, key, "left").withColumn(key, F.when(F.col("_big"), F.col(key)).otherwise(other)).drop("_big")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most ``k`` rows of each group, in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def dominant(counts: Column) -> Column:
    """The key of greatest count of a map; the first in the alphabet on ties (T4)."""
    return F.try_element_at(F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), F.lit(1))["k"]
