"""Mixing sources to target shares of tokens.

Every document gets a hash-random key in [0, 1); equal slices of keys are the ranges of a sort within each source. Sums of tokens by (source, slice) are a
small table, whose running sums place each slice; only the one slice of a source in which its budget ends is sorted row by row. Passes over a source
that is too small come first, the last, partial one is cut at the exact rest of the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.runtime import cut_lineage, not_blank, per_worker, spread

#: A public byte-level BPE vocabulary; the path is a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def count_tokens(df: DataFrame, columns: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(columns, n_tokens)`` per row with a non-blank text; strings that look like special tokens are ordinary text. Rows are independent: nothing is shuffled."""
    src = spread(df.select(*[df[c].alias(c) for c in columns], df[text].alias("_text")).where(not_blank(F.col("_text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = per_worker("tokenizer " + tokenizer, lambda: Tokenizer.from_file(tokenizer))
        t.encode_special_tokens = True
        for b in batches:
            out = b[columns].copy()
            texts = b["_text"].tolist()
            out["n_tokens"] = [len(e.ids) for k in range(0, len(texts), 256) for e in t.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]
            yield out

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return src.mapInPandas(run, f"{kinds}, n_tokens bigint")


def budgets(have: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take from each source. Shares of absent sources go to the present ones in proportion.

    Without ``total``, the largest total at which every present source reaches its share within its repeats; with it, a source that can't
    reach its share gives all it may, and what it lacks stays lacking.
    """
    present = {s: x for s, x in targets.items() if have.get(s, 0) > 0 and x[0] > 0 and x[1] > 0}
    whole = sum(x[0] for x in present.values())
    if not whole:
        return {}
    cap = {s: have[s] * x[1] for s, x in present.items()}
    if total is None:
        total = min(cap[s] * whole / x[0] for s, x in present.items())
    return {s: min(cap[s], total * x[0] / whole) for s, x in present.items()}


def read_targets(targets: DataFrame, limit: int = 10_000) -> dict[str, tuple[float, int]]:
    """The target list, which is a short list by nature: more than ``limit`` sources are refused. Null shares count as 0, null repeats as 1; of repeated sources the largest share holds."""
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("p"), F.coalesce("max_repeats", F.lit(1)).alias("m"))).alias("x")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} target sources")
    return {r["source"]: (r["x"]["p"], r["x"]["m"]) for r in rows}


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", total: float | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen documents ``(key, source, n_tokens, uses)`` and the report ``(source, target_share, max_repeats, docs_available, tokens_available, docs_used, tokens_used, actual_share)``.

    Null and blank texts, null sources and sources without a target are not chosen; a target source that is absent or that can give nothing has a report row of zeros. Each delivered row is a
    document of its own; identical rows share their key and stand side by side. Keys depend on ``key`` and ``seed`` only, so a lost task draws the same again.
    """
    spark: SparkSession = docs.sparkSession
    want = read_targets(targets)
    listed = docs.where(docs[source].isin(list(want))) if want else docs.where(F.lit(False))
    counted = count_tokens(listed.select(docs[key].alias("_key"), docs[source].alias("_source"), docs[text].alias("_txt")), ["_key", "_source"], "_txt", tokenizer)
    u = F.xxhash64("_key", F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)
    rows = cut_lineage(counted.withColumn("_u", u))
    n = rows.count()
    slices = 1 << max(6, (n // 20_000).bit_length())
    rows = rows.withColumn("_slice", F.least(F.floor(F.col("_u") * slices), F.lit(slices - 1)).cast("int"))
    # at most slices x targets rows, whatever the size of a source: summed before the shuffle
    sums = cut_lineage(rows.groupBy("_source", "_slice").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")))
    per_source = {r["_source"]: (r["t"], r["c"]) for r in sums.groupBy("_source").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}
    plan = budgets({s: t for s, (t, _) in per_source.items()}, want, total)
    cut = []
    for s, b in plan.items():
        have, most = per_source[s][0], want[s][1]
        full = min(most, int(b // have))
        cut.append((s, full, float(b - full * have) if full < most else 0.0))
    cuts = spark.createDataFrame(cut, "_source string, full int, rest double") if cut else spark.createDataFrame([], "_source string, full int, rest double")
    before = F.sum("t").over(Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    placed = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(cuts), "_source").select("_source", "_slice", "before", "t", "full", "rest")
    state = F.when(F.col("before") + F.col("t") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2)
    placed = placed.withColumn("state", state)
    joined = rows.join(F.broadcast(placed) if slices * max(1, len(want)) <= 200_000 else placed, ["_source", "_slice"])
    whole = joined.where("state < 2").select("_key", "_source", "n_tokens", (F.col("full") + F.col("state")).alias("uses"))
    run = F.sum("n_tokens").over(Window.partitionBy("_source", "_slice").orderBy("_u", "_key").rowsBetween(Window.unboundedPreceding, 0))
    edge = joined.where("state = 2").withColumn("upto", F.col("before") + run)
    edge = edge.select("_key", "_source", "n_tokens", (F.col("full") + (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).alias("uses"))
    chosen = whole.unionByName(edge).where("uses > 0").select(F.col("_key").alias(key), F.col("_source").alias(source), "n_tokens", F.col("uses").cast("int").alias("uses"))
    report_rows = chosen.groupBy(source).agg(F.count("*").alias("d"), F.sum(F.col("n_tokens") * F.col("uses")).alias("t"))
    info = spark.createDataFrame([(s, float(p), int(m), int(per_source.get(s, (0, 0))[1]), int(per_source.get(s, (0, 0))[0])) for s, (p, m) in sorted(want.items())] or [], f"`{source}` string, target_share double, max_repeats int, docs_available bigint, tokens_available bigint")
    report = info.join(report_rows, source, "left").withColumn("t", F.coalesce("t", F.lit(0))).withColumn("all_t", F.sum("t").over(Window.partitionBy(F.lit(1))))
    report = report.select(source, "target_share", "max_repeats", "docs_available", "tokens_available", F.coalesce("d", F.lit(0)).alias("docs_used"), F.col("t").alias("tokens_used"), F.when(F.col("all_t") > 0, F.col("t") / F.col("all_t")).otherwise(0.0).alias("actual_share"))
    return chosen, report
