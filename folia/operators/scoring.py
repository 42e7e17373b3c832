"""Rows through a model: smaller answers when the context is full, a second question when the schema fails, images as content, recovery in tiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model adapter: prompt and greatest number of tokens to a reply; whatever it raises is that row's status.
Model = Callable[[str, int], str | None]
_FULL = re.compile(r"has (\d+) input tokens")


def room_left(message: str, window: int, asked: int, margin: int = 64, least: int = 256) -> int | None:
    """The answer's size to ask for after an error that names the input's tokens; null if it names none or a smaller answer wouldn't help."""
    m = _FULL.search(message or "")
    if not m:
        return None
    left = max(least, window - int(m[1]) - margin)
    return left if left < asked else None


def with_context_retry(model: Model, window: int) -> Model:
    """A model that is asked once more, for a smaller answer, when the first call doesn't fit its context (X2). Any other failure is passed on."""

    def ask(prompt: str, tokens: int) -> str | None:
        try:
            return model(prompt, tokens)
        except Exception as e:  # noqa: BLE001 - adapters raise what they like
            smaller = room_left(str(e), window, tokens)
            if smaller is None:
                raise
            return model(prompt, smaller)

    return ask


def with_schema_retry(model: Model, error_of: Callable[[str], str | None], again: Callable[[str, str, str], str]) -> Model:
    """A model that is asked once more, with its own reply and what is wrong with it, when the reply fails the schema (F23c). The second reply is kept if it is right, else the first."""

    def ask(prompt: str, tokens: int) -> str | None:
        first = model(prompt, tokens)
        wrong = error_of(first) if first else None
        if not wrong:
            return first
        second = model(again(prompt, first, wrong), tokens)
        return second if second and error_of(second) is None else first

    return ask


def score(df: DataFrame, key: str, prompt: str, model: Model, tokens: int = 4096, at_once: int = 8, progress: Callable[[int], None] | None = None) -> DataFrame:
    """``(key, status, error, raw_output, raw_output_length)`` with up to ``at_once`` calls of a task under way (X1); ``progress`` is told the number of rows done, batch by batch.

    Blank prompts are ``skipped``, empty replies ``empty_response_error``, failed calls ``api_error`` with the message's first 500 characters; every row has exactly one result.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(p: object) -> tuple[str, str | None, str | None]:
        if not isinstance(p, str) or not p.strip():
            return "skipped", None, None
        try:
            r = model(p, tokens)
        except Exception as e:  # noqa: BLE001
            return "api_error", str(e)[:500], None
        return ("success", None, r) if r and r.strip() else ("empty_response_error", None, r)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b[prompt]))
                if progress:
                    progress(len(got))
                yield pd.DataFrame({key: b[key], "status": [g[0] for g in got], "error": [g[1] for g in got], "raw_output": [g[2] for g in got], "raw_output_length": [len(g[2] or "") for g in got]})

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, status string, error string, raw_output string, raw_output_length int")


def counted(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """The table with a counter of the rows that passed so far, kept by Spark's accumulators (X3). A task that is run again counts again."""
    acc = df.sparkSession.sparkContext.accumulator(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            acc.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), lambda: acc.value


def image_type(content: Column) -> Column:
    """The media type by a file's first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")


def image_blocks(images: DataFrame, by: str, order: str, content: str, most: int = 15, most_bytes: int = 20_000_000) -> DataFrame:
    """``(by, blocks array<string>, n_images, n_missing, n_left_out, bytes)``: up to ``most`` images of each item in order as data addresses, while their bytes fit ``most_bytes``.

    Null, empty and unknown contents count as missing. The cap is the feature: a model takes no more. Images are cut to their places before they are gathered.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    d = images.select(by, order, F.col(content).alias("_b"), image_type(F.col(content)).alias("_t")).withColumn("_ok", F.col("_t").isNotNull())
    d = d.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w)).withColumn("_size", F.sum(F.when(F.col("_ok"), F.length("_b")).otherwise(0)).over(w.rowsBetween(-(2**63), 0)))
    d = d.withColumn("_in", F.col("_ok") & (F.col("_n") <= most) & (F.col("_size") <= most_bytes))
    block = F.when(F.col("_in"), F.struct(F.col(order).alias("o"), F.concat(F.lit("data:"), F.col("_t"), F.lit(";base64,"), F.base64("_b")).alias("u")))
    g = d.groupBy(by).agg(F.array_sort(F.collect_list(block)).alias("_x"), F.count_if("_in").alias("n_images"), F.count_if(~F.col("_ok")).alias("n_missing"), F.count_if(F.col("_ok") & ~F.col("_in")).alias("n_left_out"), F.sum(F.when(F.col("_in"), F.length("_b")).otherwise(0)).alias("bytes"))
    return g.select(by, F.transform("_x", lambda x: x["u"]).alias("blocks"), "n_images", "n_missing", "n_left_out", "bytes")


def in_tiers(df: DataFrame, key: str, tiers: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], good: Column) -> DataFrame:
    """Each document's result from the first tier whose result is ``good``, with the tier's name; without one the last tier's result.

    A tier takes rows and gives ``(key, ...)`` of one schema. It only runs over the documents that no tier before it served, so expensive recovery is conditional. Documents for which no tier
    gives a row have none.
    """
    from folia.runtime import cut_lineage

    rest, out, last = df, None, None
    for name, tier in tiers:
        got = cut_lineage(tier(rest).withColumn("tier", F.lit(name)))
        part = got.where(F.coalesce(good, F.lit(False)))
        out = part if out is None else out.unionByName(part)
        bad = got.where(~F.coalesce(good, F.lit(False)))
        last = bad if last is None else last.join(got.select(key), key, "left_anti").unionByName(bad)
        rest = rest.join(part.select(key), key, "left_anti")
    return out.unionByName(last.join(out.select(key), key, "left_anti"))
