"""Exact and near duplicates of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.operators.windows import star_clusters
from folia.runtime import cut_lineage


def exact_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """``(group_id, first_key, n)``: contents that occur more than once, numbered by their first key.

    One row per group: members stay where they are and join by hash (``exact_members``), so that a group of any size is never collected.
    """
    g = df.select(key, F.sha2(content, 256).alias("hash")).where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min(key).alias("first_key"), F.count("*").alias("n")).where("n > 1")
    return g.select(F.substring("hash", 1, 16).alias("group_id"), "first_key", "n", "hash")


def exact_members(df: DataFrame, key: str, content: Column) -> DataFrame:
    """``(key, first_key, n)`` for each row that has a copy; salted on the row's side against hot contents."""
    rows = df.select(key, F.sha2(content, 256).alias("hash")).where(F.col("hash").isNotNull()).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(16)).cast("int"))
    groups = exact_groups(df, key, content).select("hash", "first_key", "n").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.join(groups, ["hash", "_s"]).select(key, "first_key", "n")


def duplicate_summary(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Numbers of groups, of their members and of surplus rows."""
    return exact_groups(df, key, content).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def simhash(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """``(key, simhash)``: 64 bits of a text's shingles of ``words`` words (F25). Null for a text of fewer words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        for b in batches:
            out = []
            for t in b["_t"]:
                w = t.lower().split() if isinstance(t, str) else []
                hs = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + words])) for i in range(len(w) - words + 1)], dtype=np.uint64)
                if not len(hs):
                    out.append(None)
                    continue
                bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) * 2 > len(hs)
                out.append(int(np.packbits(bits, bitorder="little").view(np.int64)[0]))
            yield pd.DataFrame({key: b["_k"], "simhash": pd.array(out, dtype="Int64")})

    return df.select(df[key].alias("_k"), df[text].alias("_t")).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, simhash bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` by passing on the smallest label until none changes, however many rounds that takes; each round is cut off reliably. Edges stay distributed."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both = cut_lineage(both)
    label = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        seen = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("component").alias("c"))
        new = label.join(seen, label["node"] == seen["u"], "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), (F.coalesce("c", "component") < F.col("component")).alias("changed"))
        # pointer jumping: a component's own label may have shrunk too
        top = new.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = new.join(top, new["component"] == top["_n"], "left").select("node", F.least("component", F.coalesce("_c", "component")).alias("component"), "changed")
        new = cut_lineage(new)
        done = new.where("changed").limit(1).count() == 0
        label = new.select("node", "component")
        if done:
            return label


def shingle_sets(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """``(key, class, s)``: the distinct hashes of a text's shingles of ``words`` words, and a 128-bit hash of that set. A shorter text is one shingle; a text without words has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import numpy as np
        import xxhash

        for b in batches:
            rows = []
            for k, t in zip(b["_k"], b["_t"], strict=True):
                w = t.lower().split() if isinstance(t, str) else []
                if w:
                    s = np.unique(np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))], dtype=np.uint64).view(np.int64))
                    rows.append((k, hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), s))
            yield pd.DataFrame(rows, columns=[key, "class", "s"])

    return df.select(df[key].alias("_k"), df[text].alias("_t")).where(F.col("_k").isNotNull()).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, class string, s array<bigint>")


def jaccard_pairs(sets: DataFrame, key: str, s: str, least: float) -> DataFrame:
    """``(a, b)`` with ``a < b``: all pairs of sets (distinct elements, one row per key) of Jaccard similarity ``least`` or more.

    Two such sets share one of the ``n - ceil(least * n) + 1`` rarest elements of each, so candidates come from an equi-join on those; the exact similarity follows. Elements of one set only come
    first in that order and can't join, so they are only counted.

    Spark takes an array for one element when it guesses sizes, so it would broadcast sets and elements that don't fit the driver: these joins are by shuffle and sort, whatever it guesses.
    """
    x = sets.select(F.col(key).alias("k"), F.size(s).alias("n"), F.explode(s).alias("g"))
    usual = x.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    rare = x.join(usual.hint("merge"), "g").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    left = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - (F.col("n") - F.size("o"))).cast("int")
    side = rare.where(left > 0).select("k", "n", F.explode(F.slice("o", F.lit(1), left)).alias("e")).select("k", "n", F.col("e.g").alias("g"))
    a, b = side.alias("a"), side.alias("b")
    near = (F.col("a.n") >= least * F.col("b.n") - 1e-9) & (F.col("b.n") >= least * F.col("a.n") - 1e-9)
    cand = a.join(b.hint("merge"), (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k")) & near).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    of = lambda c: sets.select(F.col(key).alias(c), F.col(s).alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return cand.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where(both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def near_clusters(df: DataFrame, key: str, text: str, least: float = 0.8, words: int = 5, salts: int = 16) -> DataFrame:
    """``(key, seed)`` of greedy star clusters of texts whose shingles have a Jaccard similarity of ``least`` or more (W10): one row per document of a cluster of two or more.

    Copies are one class, clustered under its smallest key: they have the same neighbours, so the sequential rule takes them together. Members are joined back with a salt.
    """
    rows = cut_lineage(shingle_sets(df, key, text, words))
    classes = cut_lineage(rows.groupBy("class").agg(F.min(key).alias("_rep"), (F.min(key) < F.max(key)).alias("_copies"), F.first("s").alias("s")))
    pairs = cut_lineage(jaccard_pairs(classes, "_rep", "s", least))
    stars = star_clusters(classes, pairs, "_rep")
    seeds = classes.select("class", "_rep", "_copies").join(stars, "_rep", "left").withColumn("seed", F.coalesce("seed", "_rep"))
    kept = seeds.groupBy("seed").agg(F.count("*").alias("_n"), F.max("_copies").alias("_c")).where("_n > 1 OR _c").select("seed")
    seeds = seeds.join(kept, "seed").select("class", "seed").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.select(key, "class", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("_s")).join(seeds, ["class", "_s"]).select(key, "seed")
