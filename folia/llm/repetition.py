"""Repetition inside a document, and lines that recur across documents.

``repeated_share`` measures a document against itself: hashed windows of words that occurred earlier in it. ``drop_common_lines`` is the cross-document
method: hash normalised lines, count the documents of a host that hold each, drop lines above a limit, reject documents that lose too much.
The first answers "does this record repeat itself"; counting lines across documents can't (a looping reply is unlike any other document, and its loop needn't end at a line end).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.runtime import cut_lineage, spread

_LETTERS = re.compile(r"[^\W\d_]+")


def repeated_words(text: str, window: int = 8) -> tuple[int, int]:
    """``(words, repeated words)``: a word is repeated if it lies in a stretch of ``window`` words that occurred earlier (it may overlap that occurrence)."""
    words = _LETTERS.findall(text.casefold())
    seen: set[int] = set()
    covered, upto = 0, 0
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    for k in range(len(ids) - window + 1):
        h = tuple(ids[k : k + window])
        if h in seen:
            covered += k + window - max(k, upto)
            upto = k + window
        else:
            seen.add(h)
    return len(words), covered


def repeated_share(df: DataFrame, key: str, text: Column, window: int = 8) -> DataFrame:
    """``(key, n_words, n_repeated, share)`` for each row; the share of a null, blank or wordless text is 0. Rows are independent: nothing is shuffled, repeated rows are each reported."""
    src = spread(df.select(df[key].alias("_key"), text.alias("_text")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [repeated_words(t, window) if isinstance(t, str) else (0, 0) for t in b["_text"]]
            yield pd.DataFrame({key: b["_key"], "n_words": [x for x, _ in got], "n_repeated": [y for _, y in got], "share": [y / x if x else 0.0 for x, y in got]})

    return src.mapInPandas(measure, f"`{key}` {df.schema[key].dataType.simpleString()}, n_words int, n_repeated int, share double")


def lines_of(text: Column, sentences: bool = True) -> Column:
    """A text's lines; with ``sentences``, lines are also cut after sentence ends."""
    return F.split(text, r"(?<=[.!?])\s+|[\r\n]+" if sentences else r"[\r\n]+")


def normal_line(line: Column) -> Column:
    """A line for comparison: lower case, numbers as one sign, everything but letters as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "0"), r"[^\p{L}0]+", " "))


def drop_common_lines(df: DataFrame, key: str, host: str, text: str, max_docs: int = 3, max_share: float = 0.01, keep_share: float = 0.5, sentences: bool = True, most_broadcast: int = 200_000, hot_share: float = 0.001, salts: int = 16) -> DataFrame:
    """``(key, n_lines, n_common, kept_text, rejected)``: texts without the lines that too many documents of their host hold, in the named method's way.

    A line is common on a host if more than ``max_docs`` of its documents, and more than ``max_share`` of them, hold it. A document that keeps less than ``keep_share`` of its
    non-empty lines is rejected. Counts are of distinct keys, by hash of the normalised line, with map-side combining, so that a hot host or line is never gathered in one task. Up to
    ``most_broadcast`` common lines are sent to the texts; more are joined by hash, where a line of at least ``hot_share`` of all lines is spread over ``salts`` tasks. Null hosts form a host of
    their own; null and blank texts have no lines and aren't rejected; a key that is given twice counts as one document; an empty table gives an empty table.
    """
    rows = df.select(df[key].alias("_key"), F.coalesce(df[host].cast("string"), F.lit("")).alias("_host"), df[text].alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)  # row numbers are drawn once: computed again after a shuffle above they could differ
    lines = rows.select("_row", "_key", "_host", F.posexplode(lines_of(F.coalesce("_text", F.lit("")), sentences)).alias("_pos", "_line")).withColumn("_norm", normal_line(F.col("_line"))).where("_norm <> ''").withColumn("_hash", F.xxhash64("_norm"))
    docs = lines.groupBy("_host", "_hash", "_key").agg(F.count("*").alias("_n")).groupBy("_host", "_hash").agg(F.count("*").alias("_docs"), F.sum("_n").alias("_n"))
    hosts = rows.select("_host", "_key").distinct().groupBy("_host").agg(F.count("*").alias("_all"))
    common = cut_lineage(docs.where(F.col("_docs") > max_docs).join(hosts, "_host").where(F.col("_docs") > F.col("_all") * max_share).select("_host", "_hash", "_n"))
    left, right = lines.select("_row", "_pos", "_line", "_host", "_hash"), common.select("_host", "_hash", F.lit(1).alias("_common"))
    if common.limit(most_broadcast + 1).count() <= most_broadcast:
        marked = left.join(F.broadcast(right), ["_host", "_hash"], "left")
    else:
        hot = F.broadcast(common.where(F.col("_n") >= (common.agg(F.sum("_n")).first()[0] or 0) * hot_share).select("_host", "_hash", F.lit(True).alias("_hot")))
        left = left.join(hot, ["_host", "_hash"], "left").withColumn("_s", F.when(F.col("_hot"), F.pmod(F.xxhash64("_row", "_pos"), F.lit(salts)).cast("int")).otherwise(0))
        right = right.join(hot, ["_host", "_hash"], "left").withColumn("_s", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        marked = left.join(right.drop("_hot"), ["_host", "_hash", "_s"], "left")
    per = marked.groupBy("_row").agg(
        F.count("*").alias("n_lines"),
        F.count("_common").alias("n_common"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_common").isNull(), F.struct("_pos", "_line")))), lambda x: x["_line"]), "\n").alias("kept_text"),
    )
    return rows.select("_row", "_key").join(per, "_row", "left").select(
        F.col("_key").alias(key),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_common", F.lit(0)).alias("n_common"),
        F.coalesce("kept_text", F.lit("")).alias("kept_text"),
        F.coalesce((F.col("n_lines") - F.col("n_common")) < F.col("n_lines") * keep_share, F.lit(False)).alias("rejected"),
    )
