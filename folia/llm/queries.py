"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import canonical, leakage, mixture, repetition, scans, subjects, truncation
from folia.runtime import broadcast_if_small, table

_SECTIONS = ("introduction", "methods", "results", "discussion")


def _int(c: str):
    return F.col(c).cast("int").alias(c)


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = scans.page_texts(table(spark, sf_dir, "figures"), table(spark, sf_dir, "paper_tables"))
    return scans.repair(texts, ["tbl", "rec_id", "item_pos"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("tbl", "rec_id", _int("item_pos"), F.explode("defects").alias("defect"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir)


def _repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("section_summaries")
    a = repetition.repeated_share(table(spark, sf_dir, "srp"), "srp_id", F.concat_ws("\n", *[s[x] for x in _SECTIONS]))
    b = repetition.repeated_share(table(spark, sf_dir, "results"), "result_id", F.col("raw_output"))
    return a.select(F.lit("srp").alias("tbl"), F.col("srp_id").alias("rec_id"), "n_words", "n_repeated", "share").unionByName(b.select(F.lit("results").alias("tbl"), F.col("result_id").alias("rec_id"), "n_words", "n_repeated", "share"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repetition(spark, sf_dir).where("share >= 0.3").select("tbl", "rec_id")


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated words of each record, with the length that a reply had at run time: where it is greater than the stored text, the share is of what is stored."""
    noted = table(spark, sf_dir, "results").select(F.lit("results").alias("tbl"), F.col("result_id").alias("rec_id"), "raw_output_length")
    return _repetition(spark, sf_dir).join(noted, ["tbl", "rec_id"], "left")


def p4_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur across the replies of one model, and replies depleted without them."""
    return repetition.drop_common_lines(table(spark, sf_dir, "results").where(F.col("raw_output").isNotNull()), "result_id", "model", "raw_output").select("result_id", "n_lines", "n_common", "rejected")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = truncation.cut_captions(table(spark, sf_dir, "figures")).where("truncated").select(F.lit("figures").alias("tbl"), F.col("fig_row_id").alias("rec_id"))
    b = truncation.cut_replies(table(spark, sf_dir, "results")).where("truncated").select(F.lit("results").alias("tbl"), F.col("result_id").alias("rec_id"))
    return a.unionByName(b)


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = truncation.cut_shares(truncation.cut_captions(table(spark, sf_dir, "figures")), "source").select(F.lit("figures").alias("tbl"), F.col("source").alias("origin"), "n_texts", "n_cut", "share")
    b = truncation.cut_shares(truncation.cut_replies(table(spark, sf_dir, "results")), "model").select(F.lit("results").alias("tbl"), F.col("model").alias("origin"), "n_texts", "n_cut", "share")
    return a.unionByName(b)


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def _canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "scimago_journals").select(F.col("sourceid").alias("entry"), F.col("title").alias("name"))
    own = table(spark, sf_dir, "match_statuses").select(F.col("status").alias("entry"), F.col("status").alias("name"))
    described = [(r["status"], r["meaning"]) for r in table(spark, sf_dir, "match_statuses").limit(1001).collect()]
    names = spark.createDataFrame(canonical.described_names(described), "entry string, name string")
    index = table(spark, sf_dir, "stage1_ga_index")
    got = canonical.map_values(index, "row_id", {"journal": titles, "scimago_title": titles, "scimago_match_status": names})
    listed = titles.select(F.lit("t").alias("kind"), F.col("name").alias("value")).union(own.select(F.lit("s"), "name")).distinct().withColumn("listed", F.lit(True))
    listed, _ = broadcast_if_small(listed, 100_000)
    kind = F.when(F.col("field") == "scimago_match_status", "s").otherwise("t")
    return got.withColumn("kind", kind).join(listed, ["kind", "value"], "left").drop("kind")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canon(spark, sf_dir).where("listed IS NULL").select("row_id", "field", F.coalesce("canon", F.lit("none")).alias("canon"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with their number of rows."""
    return _canon(spark, sf_dir).where("canon IS NULL").groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_list"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_areas(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p9_areas(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_repaired, p4_found, p4_share, p4_common_lines, p6_found, p6_shares, p7_found, p7_spans, p8_mix, p8_shares, p9_found, p9_areas, p9_composition)}

def _grams(words: str, key: str, n: int) -> str:
    """Windows of ``n`` words with their place, from a table of ``(key, w)``."""
    return f"SELECT {key}, k, list_slice(w, k, k + {n - 1}) AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS k FROM {words} WHERE len(w) >= {n})"


SQL: dict[str, str] = {
    "p4_found": "WITH t AS (SELECT 'srp' AS tbl, srp_id AS rec_id, concat_ws(chr(10), section_summaries.introduction, section_summaries.methods, section_summaries.results, section_summaries.discussion) AS x FROM srp UNION ALL SELECT 'results', result_id, raw_output FROM results WHERE raw_output IS NOT NULL), "
    "w AS (SELECT {'t': tbl, 'i': rec_id} AS r, regexp_extract_all(lower(x), '\\p{L}+') AS w FROM t WHERE x IS NOT NULL), "
    f"g AS ({_grams('w', 'r', 8)}), late AS (SELECT r, k FROM (SELECT r, k, row_number() OVER (PARTITION BY r, g ORDER BY k) AS nth FROM g) WHERE nth > 1), "
    "c AS (SELECT r, count(DISTINCT k + o) AS n FROM late, (SELECT unnest(range(8)) AS o) GROUP BY r) SELECT w.r.t AS tbl, w.r.i AS rec_id FROM w JOIN c ON w.r = c.r WHERE c.n >= 0.3 * len(w.w)",
    "p4_share": "WITH t AS (SELECT 'srp' AS tbl, srp_id AS rec_id, concat_ws(chr(10), section_summaries.introduction, section_summaries.methods, section_summaries.results, section_summaries.discussion) AS x, CAST(NULL AS INTEGER) AS raw_output_length FROM srp UNION ALL SELECT 'results', result_id, raw_output, raw_output_length FROM results), "
    "w AS (SELECT {'t': tbl, 'i': rec_id} AS r, raw_output_length, regexp_extract_all(lower(coalesce(x, '')), '\\p{L}+') AS w FROM t), "
    f"g AS ({_grams('w', 'r', 8)}), late AS (SELECT r, k FROM (SELECT r, k, row_number() OVER (PARTITION BY r, g ORDER BY k) AS nth FROM g) WHERE nth > 1), "
    "c AS (SELECT r, count(DISTINCT k + o) AS n FROM late, (SELECT unnest(range(8)) AS o) GROUP BY r) SELECT w.r.t AS tbl, w.r.i AS rec_id, CAST(len(w.w) AS INTEGER) AS n_words, CAST(coalesce(c.n, 0) AS INTEGER) AS n_repeated, coalesce(c.n, 0) / greatest(CAST(len(w.w) AS DOUBLE), 1) AS share, raw_output_length FROM w LEFT JOIN c ON w.r = c.r",
    "p7_found": "WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]{0,200}>', ' ', 'g')), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL), "
    f"dg AS ({_grams('d', 'doc_id', 12)}), ig AS ({_grams('i', 'item_id', 12)}) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g",
}
