"""Ordered operators within a document: fills, propagation, numbering, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.runtime import cut_lineage


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group that come before in ``order`` (which has no ties within a group).

    Rows are range-partitioned once and cut off reliably; partition sums are a table of partitions, their running sums the offsets; what is left is a running
    sum within (group, partition). A group of any size is spread over as many tasks as its rows need.
    """
    r = cut_lineage(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    sums = r.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    above = sums.withColumn("__off", F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] + [F.col("l.__part") == F.col("r.__part")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    j = r.alias("l").join(above.alias("r"), cond).select("l.*", "r.__off")
    local = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return j.withColumn(out, F.col("__off") + local).drop("__part", "__off")


def average_ranks(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """``(by, x, n, out)``: each distinct value's count and its rank with ties at their mean (W1). Only distinct values are sorted, and those by prefix sums."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("n"))
    return prefix_sums(counts, by, x, "n", "_before").select(*by, x, "n", (F.col("_before") + (F.col("n") + 1) / 2.0).alias(out))


def fill_forward(df: DataFrame, by: str, pos: str, label: str, reset: Column, out: str, chunk: int = 100_000) -> DataFrame:
    """The nearest label above, but not over a reset row.

    Positions are cut into chunks of ``chunk``: the last mark of each chunk is carried over by a window over chunks, so a long group is no single task. Positions are numbers.
    """
    mark = F.when(reset | F.col(label).isNotNull(), F.struct(F.col(label).alias("v")))
    m = df.withColumn("_m", mark).withColumn("_c", F.floor(F.col(pos) / chunk))
    last = m.where(F.col("_m").isNotNull()).groupBy(F.col(by).alias("_by"), F.col("_c").alias("_cc")).agg(F.max_by("_m", pos).alias("_last"))
    chunks = m.groupBy(F.col(by).alias("_by"), F.col("_c").alias("_cc")).agg(F.count("*").alias("_n")).join(last, ["_by", "_cc"], "left")
    carry = chunks.select("_by", "_cc", F.last("_last", ignorenulls=True).over(Window.partitionBy("_by").orderBy("_cc").rowsBetween(Window.unboundedPreceding, -1)).alias("_in"))
    j = m.join(carry, (m[by] == carry["_by"]) & (m["_c"] == carry["_cc"]), "left").drop("_by", "_cc")
    here = F.last("_m", ignorenulls=True).over(Window.partitionBy(by, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn(out, F.coalesce(here, F.col("_in"))["v"]).drop("_m", "_c", "_in")


def propagate_bounded(df: DataFrame, by: str, pos: str, label: str, out: str, most: int = 4, only: tuple[str, ...] = ("methods", "results", "discussion")) -> DataFrame:
    """A label passes to at most ``most`` consecutive unlabelled rows below it; only labels in ``only`` pass."""
    w = Window.partitionBy(by).orderBy(pos)
    g = df.withColumn("_g", F.sum(F.when(F.col(label).isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(by, "_g").orderBy(pos)
    g = g.withColumn("_n", F.row_number().over(island) - 1).withColumn("_l", F.first(label).over(island))
    keep = F.col("_l").isin(*only) & (F.col("_n") <= most) & (F.col("_g") > 0)
    return g.withColumn(out, F.coalesce(F.col(label), F.when(keep, F.col("_l")))).drop("_g", "_n", "_l")


def inherit_parent(df: DataFrame, by: str, pos: str, num: str, label: str, out: str) -> DataFrame:
    """``2.x`` takes the label of the last top-level ``2`` of its document."""
    major = F.regexp_extract(num, r"^(\d+)", 1)
    top = df.where(F.col(num).rlike(r"^\d+$") & F.col(label).isNotNull()).groupBy(F.col(by), F.col(num).alias("_major")).agg(F.max_by(label, pos).alias("_parent"))
    return df.withColumn("_major", major).join(top, [by, "_major"], "left").withColumn(out, F.coalesce(label, F.when(F.col(num).contains("."), F.col("_parent")))).drop("_major", "_parent")


def carry_pending(df: DataFrame, by: str, pos: str, boundary: str, label: str, out: str) -> DataFrame:
    """A boundary announced above an unlabelled row becomes its label."""
    above = F.last(boundary, ignorenulls=True).over(Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, F.coalesce(label, above))


def reindex(by: str, pos: str) -> Column:
    """0, 1, 2 ... over the rows kept."""
    return F.row_number().over(Window.partitionBy(by).orderBy(pos)) - 1


def first_seen(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where("_n = 1").drop("_n")


def suffixed(by: list[str], ident: str, pos: str) -> Column:
    """Repeated ids get ``b``, ``c`` ...; after ``z`` a number."""
    n = F.row_number().over(Window.partitionBy(*by, ident).orderBy(pos))
    return F.when(n == 1, F.col(ident)).when(n <= 26, F.concat(F.col(ident), F.char(n + 96))).otherwise(F.concat(F.col(ident), F.lit("_"), n.cast("string")))


def star_clusters(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``(key, seed)`` of the nodes in ``pairs(a, b)``, a < b: in key order, an unvisited node seeds a cluster and takes all unvisited neighbours (W10). Not transitive.

    The sequential rule has a parallel form: a node is a seed once all its smaller neighbours are known to be none, and is taken by its smallest seed neighbour. Each round decides
    every node whose smaller neighbours are decided, so at least the smallest that is open: it ends, after as many rounds as the longest chain of neighbours in key order needs. Edges and
    states stay distributed.
    """
    e = cut_lineage(pairs.select(F.col("b").alias("_u"), F.col("a").alias("_v")).distinct())
    ids = e.select(F.col("_u").alias(key)).unionByName(e.select(F.col("_v").alias(key))).distinct().join(nodes.select(key).distinct(), key, "left_semi")
    state = cut_lineage(ids.withColumn("_s", F.lit(0)))
    while True:
        below = e.join(state.select(F.col(key).alias("_v"), F.col("_s").alias("_sv")), "_v").groupBy("_u").agg(F.max((F.col("_sv") == 1).cast("int")).alias("_seed"), F.max((F.col("_sv") == 0).cast("int")).alias("_open"))
        j = state.join(below, state[key] == below["_u"], "left")
        new = F.when(F.col("_s") != 0, F.col("_s")).when(F.coalesce("_seed", F.lit(0)) == 1, 2).when(F.coalesce("_open", F.lit(0)) == 0, 1).otherwise(0)
        state = cut_lineage(j.select(key, new.alias("_s")))
        if state.where("_s = 0").limit(1).count() == 0:
            taken = e.join(state.where("_s = 1").select(F.col(key).alias("_v")), "_v").groupBy("_u").agg(F.min("_v").alias("_seed"))
            done = state.join(taken, state[key] == taken["_u"], "left")
            return done.select(key, F.when(F.col("_s") == 1, F.col(key)).otherwise(F.col("_seed")).alias("seed"))


def best_in_range(df: DataFrame, by: str, pos: str, score: str, lo: Column, hi: Column) -> DataFrame:
    """``(by, pos)`` of the highest score within a range of places; the first on ties."""
    return df.where(F.col(pos).between(lo, hi)).groupBy(by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p"))).alias("b")).select(by, (-F.col("b.p")).alias(pos), F.col("b.s").alias(score))


def join_ordered(df: DataFrame, by: list[str], pos: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Texts of a group joined in their order (W12, W13). Groups are the sections of one document."""
    return df.where(F.col(text).isNotNull()).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), sep).alias(text))
