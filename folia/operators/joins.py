"""Joins beyond the plain equi-join. Plain ones (J1-J3, J5-J7, J14) are ``DataFrame.join`` and are used as such by the queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.runtime import cut_lineage


def join_and_count(left: DataFrame, right: DataFrame, on: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``value`` was found, and one row ``(n_rows, n_matched, n_dropped)``."""
    joined = left.join(right, on, "left")
    counts = joined.agg(F.count("*").alias("n_rows"), F.count(value).alias("n_matched"), F.count_if(F.col(value).isNull()).alias("n_dropped"))
    return joined.where(F.col(value).isNotNull()), counts


def common_to_all(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that every table has: one shuffle of the union instead of a chain of joins."""
    out = None
    for i, t in enumerate(tables):
        part = t.select(key, F.lit(i).alias("_t"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.count_distinct("_t").alias("n")).where(F.col("n") == len(tables)).select(key)


def tiered_lookup(left: DataFrame, key: str, tiers: Sequence[Column], lookups: Sequence[DataFrame]) -> DataFrame:
    """``(key, tier, pos, value)``: the first hit over tiers of candidate keys.

    ``tiers[i]`` is an array of candidate keys, in order of preference, looked up in ``lookups[i](k, value)``. Each tier is one equi-join of exploded keys; the
    first hit is chosen by a partial aggregate, not by a sort.
    """
    hits = None
    for i, (cand, dim) in enumerate(zip(tiers, lookups, strict=True)):
        part = left.select(key, F.posexplode(cand).alias("pos", "k")).where(F.coalesce("k", F.lit("")) != "").join(dim.select("k", "value"), "k").select(key, F.struct(F.lit(i).alias("tier"), "pos", "value").alias("h"))
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy(key).agg(F.min("h").alias("h"))
    return best.select(key, F.col("h.tier").alias("tier"), F.col("h.pos").alias("pos"), F.col("h.value").alias("value"))


def similar_titles(values: DataFrame, titles: DataFrame, least: float = 0.94, min_length: int = 8) -> DataFrame:
    """``(value, title, ratio)``: for each distinct value the title of greatest gestalt ratio, if at least ``least``; the smaller title on ties.

    The ratio is ``2 M / (n + m)`` for ``M`` matched characters in order. At ``least`` or more, ``e = n + m - 2 M <= (1 - least) (n + m)`` characters stay unmatched. Each one taken out or put in
    destroys at most two bigrams, and the matched text has ``M - 1``; so of the ``k - 1`` bigrams of the shorter string, numbered where they recur, all but ``2 e`` at most are in the
    other. By the prefix principle two such strings share one of the ``2 e + 1`` rarest numbered bigrams of each, and only those are joined, within near lengths. The exact ratio follows.
    Null, short and single-word values have no row; strings so short that the bound says nothing are joined by length.
    """
    norm = lambda df, c: df.select(F.col(c).alias(c)).where(F.col(c).isNotNull()).distinct().where((F.length(c) >= min_length) & F.col(c).contains(" "))
    v, t = cut_lineage(norm(values, "value").withColumn("n", F.length("value"))), cut_lineage(norm(titles, "title").withColumn("n", F.length("title")))

    def numbered(df: DataFrame, c: str) -> DataFrame:
        """The n-th occurrence of a bigram is a token of its own."""
        at = df.select(c, "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))).alias("i", "g"))
        return at.select(c, "n", F.struct("g", F.row_number().over(Window.partitionBy(c, "g").orderBy("i")).alias("nth")).alias("g"))

    tv, tt = numbered(v, "value"), numbered(t, "title")
    rarity = tt.groupBy("g").agg(F.count("*").alias("f"))
    # the greatest number of unmatched characters for a string of length n: its partner is at most n (2 - least) / least long
    missing = F.floor((1 - least) * (F.col("n") + F.floor(F.col("n") * (2 - least) / least + 1e-9)) + 1e-9)

    def prefix(df: DataFrame, c: str) -> DataFrame:
        ranked = df.join(rarity, "g", "left").withColumn("k", F.row_number().over(Window.partitionBy(c).orderBy(F.coalesce("f", F.lit(0)), "g")))
        near = ranked.where(F.col("k") <= 2 * missing + 1).select(c, "n", F.struct(F.lit(False).alias("short"), "g").alias("key"))
        none = F.struct(F.lit("").alias("g"), F.lit(0).alias("nth"))
        # where the bound allows that no bigram is shared, strings meet by their length alone
        short = df.select(c, "n").distinct().where(F.col("n") - 1 <= 2 * missing).select(c, "n", F.struct(F.lit(True).alias("short"), none.alias("g")).alias("key"))
        return near.unionByName(short)

    pv, pt = prefix(tv, "value"), prefix(tt, "title").withColumnRenamed("n", "m")
    n, m = F.col("n"), F.col("m")
    cand = pv.join(pt, "key").where(2 * F.least(n, m) >= least * (n + m) - 1e-9).select("value", "title").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            keep, match, last = [], SequenceMatcher(None, "", ""), None
            for x, y in zip(b["value"], b["title"], strict=True):
                if y != last:  # what is known of the second string is kept
                    match.set_seq2(y)
                    last = y
                match.set_seq1(x)
                if match.real_quick_ratio() >= least and match.quick_ratio() >= least and (r := match.ratio()) >= least:
                    keep.append((x, y, r))
            yield pd.DataFrame(keep, columns=["value", "title", "ratio"])

    got = cand.mapInPandas(score, "value string, title string, ratio double")
    best = got.groupBy("value").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "title")).alias("b"))
    return best.select("value", F.col("b.title").alias("title"), (-F.col("b.r")).alias("ratio"))


def hamming_pairs(df: DataFrame, key: str, h: str, most: int, equal: int = 2) -> DataFrame:
    """``(a, b, distance)`` with ``a < b`` and at most ``most`` differing bits of 64.

    Cut into ``most + equal`` blocks, two such hashes have ``equal`` equal blocks, so candidates come from an equi-join on (which blocks, their bits). More equal blocks mean longer keys, so smaller
    buckets, and more rows. Copies of one hash are one class, joined once under its smallest key; ``hamming_members`` gives the rows of each class.
    """
    n = most + equal
    width = -(-64 // n)
    classes = df.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("_h")).agg(F.min(key).alias("_rep"))
    block = [F.shiftrightunsigned(F.col("_h"), min(i * width, 63)).bitwiseAND(F.lit((1 << min(width, 64 - i * width, 63)) - 1)) if i * width < 64 else F.lit(0) for i in range(n)]
    keys = F.array(*[F.struct(F.lit(c).alias("which"), F.xxhash64(*[block[i] for i in some]).alias("bits")) for c, some in enumerate(combinations(range(n), equal))])
    side = classes.select("_h", "_rep", F.explode(keys).alias("x")).select("_h", "_rep", "x.which", "x.bits")
    a, b = side.alias("a"), side.alias("b")
    d = F.bit_count(F.col("a._h").bitwiseXOR(F.col("b._h")))
    pairs = a.join(b, (F.col("a.which") == F.col("b.which")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a._h") < F.col("b._h"))).where(d <= most)
    return pairs.select(F.least("a._rep", "b._rep").alias("a"), F.greatest("a._rep", "b._rep").alias("b"), d.alias("distance")).distinct()


def hamming_members(df: DataFrame, key: str, h: str, most: int, salts: int = 16) -> DataFrame:
    """``(key, rep, class_size, links)`` for each row with a hash (J10): the smallest key of its hash, the number of rows of that hash, and of other rows at most ``most`` bits away, copies included.

    With ``hamming_pairs`` between the representatives this gives every pair of rows, at distance 0 too, without writing out the pairs of a hot hash. Rows are salted against one.
    """
    rows = df.select(key, F.col(h).alias("_h")).where(F.col("_h").isNotNull())
    classes = rows.groupBy("_h").agg(F.min(key).alias("rep"), F.count("*").alias("class_size"))
    pairs = hamming_pairs(df, key, h, most)
    sides = pairs.select(F.col("a").alias("rep"), F.col("b").alias("_o")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("_o")))
    near = sides.join(classes.select(F.col("rep").alias("_o"), "class_size"), "_o").groupBy("rep").agg(F.sum("class_size").alias("_n"))
    full = classes.join(near, "rep", "left").select("_h", "rep", "class_size", (F.col("class_size") - 1 + F.coalesce("_n", F.lit(0))).alias("links"))
    right = full.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(right, ["_h", "_s"]).select(key, "rep", "class_size", "links")


def _salted_union(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, value: Column, salts: int) -> DataFrame:
    """Left rows spread over ``salts``, right rows (one per group and place) copied to each: a group with a third of all left rows is that many tasks."""
    cols = left.columns
    u = left.select("*", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int").alias("_s"))
    r = right.select(F.col(by), F.col(right_at).cast("double").alias("_at"), value.alias("_v")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return u.unionByName(r.select(*[F.col(by) if c == by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], "_v", "_at", F.lit(0).alias("_side"), "_s"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, value: str, order: str, forward_first: bool = False, salts: int = 8) -> DataFrame:
    """``left`` with ``value`` of the latest right row at or before it; among equals the first by ``order``.

    ``forward_first``: where there is none, the earliest right row of the group (J12). A union and one window: no pairs are built; left rows are salted against hot groups.
    """
    r = right.groupBy(by, right_at).agg(F.min_by(value, order).alias("_x"))
    u = _salted_union(left, r, by, at, right_at, F.col("_x"), salts)
    w = Window.partitionBy(by, "_s").orderBy("_at", "_side")
    out = u.withColumn(value, F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if forward_first:
        out = out.withColumn(value, F.coalesce(value, F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return out.where("_side = 1").select(*left.columns, value)


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, value: str, salts: int = 8) -> DataFrame:
    """``left`` with the value of the right row nearest to it; the later one on ties (J13): the last row before and the first row after are enough."""
    r = right.groupBy(by, right_at).agg(F.min(F.col(value).cast("string")).alias("_x"))
    u = _salted_union(left, r, by, at, right_at, F.struct(F.col(right_at).cast("double").alias("p"), F.col("_x").alias("v")), salts)
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(by, "_s").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(Window.partitionBy(by, "_s").orderBy("_at", F.desc("_side")).rowsBetween(0, Window.unboundedFollowing))
    u = u.withColumn("_b", before).withColumn("_a", after)
    pick = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_a.p") - F.col("_at") <= F.col("_at") - F.col("_b.p"), F.col("_a.v")).otherwise(F.col("_b.v"))
    return u.where("_side = 1").select(*left.columns, pick.alias(value))


def merge_detections(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Two detections of the same things: the left wins, unseen right ones are added, right ones without a key are dropped."""
    u = left.withColumn("_src", F.lit(0)).unionByName(right.withColumn("_src", F.lit(1)))
    last = F.col(keys[-1])
    keyed = u.where(last.isNotNull())
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_src", order))).where("_n = 1").drop("_n")
    return first.unionByName(u.where(last.isNull() & (F.col("_src") == 0)))


def rater_pairs(long: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """``(item, r1, r2, v1, v2)`` for each two raters of an item, in order: built within each item's short array, without a self-join."""
    packed = long.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("r"), F.col(value).alias("v")))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["r"] > a["r"]), lambda b: F.struct(a["r"].alias("r1"), b["r"].alias("r2"), a["v"].alias("v1"), b["v"].alias("v2")))))
    return packed.select(item, F.explode(pairs).alias("p")).select(item, "p.*")


def box_neighbours(df: DataFrame, boxes: str) -> DataFrame:
    """Per row with an array of ``(x, y, w, h)``: nearest centre distance and number of overlapping pairs, within the array."""
    cx, cy = (lambda b: b["x"] + b["w"] / 2), (lambda b: b["y"] + b["h"] / 2)
    dist = lambda a, b: F.sqrt(F.pow(cx(a) - cx(b), 2) + F.pow(cy(a) - cy(b), 2))
    over = lambda a, b: (F.least(a["x"] + a["w"], b["x"] + b["w"]) > F.greatest(a["x"], b["x"])) & (F.least(a["y"] + a["h"], b["y"] + b["h"]) > F.greatest(a["y"], b["y"]))
    x = F.col(boxes)
    near = F.array_min(F.flatten(F.transform(x, lambda a, i: F.filter(F.transform(x, lambda b, j: F.when(i != j, dist(a, b))), lambda d: d.isNotNull()))))
    pairs = F.aggregate(F.flatten(F.transform(x, lambda a, i: F.transform(x, lambda b, j: F.when((i < j) & over(a, b), 1).otherwise(0)))), F.lit(0), lambda s, y: s + y)
    return df.withColumn("nearest_distance", near).withColumn("overlapping_pairs", pairs)


def first_containing(pages: Column, needle: Column) -> Column:
    """The 1-based place of the first page that contains a text, 0 for none."""
    return F.array_position(F.transform(pages, lambda p: p.contains(needle)), True).cast("int")


def locate(texts: DataFrame, pages: DataFrame, doc: str, key: str, text: str, page: str, body: str, windows: Sequence[int] = (12, 9, 7, 5), least: int = 16) -> DataFrame:
    """``(doc, key, page, how)``: the first page that contains a text, else the first that contains a telling stretch of its words (with a digit or mathematical sign), longer stretches first.

    ``how`` is whole, the number of words, or none. Texts meet only the pages of their document, by an equi-join, and a page is searched for the whole and for all stretches of one length at once. Texts of under
    ``least`` characters aren't looked for.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    t = texts.select(doc, key, plain(F.col(text)).alias("_q"))
    w = F.split("_q", " ")

    def stretches(n: int) -> Column:
        all_ = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.filter(all_, lambda x: (F.length(x) >= least) & x.rlike(r"[0-9=+\-*/×÷∑∏√∫∂∇≤≥≈≠±%]"))

    t = t.select("*", *[stretches(n).alias(f"_w{n}") for n in windows])
    p = pages.select(doc, F.col(page).alias("_p"), plain(F.col(body)).alias("_b"))
    j = t.where(F.length("_q") >= least).join(p, doc)
    hit = lambda tier, name: F.when(tier, F.struct(F.lit(name[0]).alias("tier"), F.col("_p").alias("p"), F.lit(name[1]).alias("how")))
    tiers = [hit(F.col("_b").contains(F.col("_q")), (0, "whole"))] + [hit(F.exists(f"_w{n}", lambda x: F.col("_b").contains(x)), (i, str(n))) for i, n in enumerate(windows, 1)]
    best = j.select(doc, key, F.coalesce(*tiers).alias("_h")).groupBy(doc, key).agg(F.min("_h").alias("_h"))
    return t.select(doc, key).join(best, [doc, key], "left").select(doc, key, F.col("_h.p").alias(page), F.coalesce("_h.how", F.lit("none")).alias("how"))
