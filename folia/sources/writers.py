"""Sinks (SNK1-SNK7)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed columns: extras are ignored, missing ones are blank (SNK1). Spark's committer publishes all files at once (SNK4, SNK6)."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line (SNK3)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def tidy(frames: dict[str, DataFrame], shared: Sequence[str]) -> DataFrame:
    """Tables stacked on shared columns, with their names (SNK2)."""
    parts = [f.select(*[F.col(c) if c in f.columns else F.lit(None).alias(c) for c in shared], F.lit(n).alias("table")) for n, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def master_export(states: dict[str, DataFrame], order: Sequence[str], errors: str = "error", most: int = 500) -> DataFrame:
    """All states as one table with their status; error texts on one line, at most ``most`` characters (SNK5)."""
    parts = [f.withColumn("status", F.lit(n)) for n, f in states.items()]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if errors in u.columns:
        u = u.withColumn(errors, F.substring(F.regexp_replace(errors, r"[\r\n]+", " "), 1, most))
    return u.orderBy(*order)


def publish(df: DataFrame, path: str, form: str = "parquet") -> str:
    """Writes a table beside its place and renames it there, so that readers see the old or the new one whole (SNK4). A table that is already there is kept until the new one is complete."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", f".part-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(conf)
    df.write.format(form).mode("error").save(part.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(part, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{path} can't be published")
    if had:
        fs.delete(old, True)
    return path


def reset(spark: SparkSession, paths: Sequence[str], below: str) -> list[str]:
    """Removes outputs before a run, only such as lie below a given folder (SNK6). Returns those that were there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root, gone = jvm.org.apache.hadoop.fs.Path(below).toUri().getPath().rstrip("/") + "/", []
    for p in paths:
        q = jvm.org.apache.hadoop.fs.Path(p)
        if ".." in p or not q.toUri().getPath().startswith(root):
            raise ValueError(f"{p} isn't below {below}")
        fs = q.getFileSystem(conf)
        if fs.exists(q):
            fs.delete(q, True)
            gone.append(p)
    return gone


def chart_table(df: DataFrame, x: str, series: str, y: str) -> DataFrame:
    """``(x, series, n, mean, lo, hi)``: what a grouped bar or line chart plots, with normal intervals (SNK7). Drawing is left to whoever reads it."""
    g = df.where(F.col(y).isNotNull()).groupBy(x, series).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), (1.96 * F.coalesce(F.stddev_samp(y), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("_h"))
    return g.select(x, series, "n", "mean", (F.col("mean") - F.col("_h")).alias("lo"), (F.col("mean") + F.col("_h")).alias("hi"))
