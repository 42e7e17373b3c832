"""One query per operator family on the driver's tables, each with its SQL where SQL can say it.

Names start with the operator's id: SRC sources, PRJ projections, J joins, A aggregates, M models, W windows, T and U sorting and sets, F functions, Q queues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.functions import geometry, replies, text, values
from folia.operators import aggregates, agreement, duplicates, joins, labelling, models, windows
from folia.runtime import scratch, table
from folia.sources import readers, writers
from folia.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c, name: str | None = None):
    """Rounded for comparison with another engine's order of summation."""
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c), c) if k == "double" else F.col(c) for c, k in df.dtypes])


# ---------------------------------------------------------------- sources and sinks


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def src01_last_row_wins(t):
    return readers.last_per_key(t("events").select("user_id", "event_id", "event_type", "value"), "user_id", F.col("event_id"))


@query(
    "SELECT doi_safe, image_file, tier, n_candidates FROM (SELECT doi_safe, image_file, tier, count(*) OVER (PARTITION BY doi_safe) AS n_candidates, "
    "row_number() OVER (PARTITION BY doi_safe ORDER BY tier, image_file) AS k FROM (SELECT doi_safe, image_file, CASE WHEN regexp_matches(image_file, "
    "'fig_01') THEN 0 WHEN regexp_matches(image_file, 'fig_') THEN 1 WHEN regexp_matches(image_file, 'png$') THEN 2 END AS tier FROM figures) WHERE tier "
    "IS NOT NULL) WHERE k = 1"
)
def src07_pick_file(t):
    return readers.pick_file(t("figures").select("doi_safe", "image_file"), "doi_safe", "image_file", ["fig_01", "fig_", "png$"])


@query("SELECT k, arg_max(sourceid, sourceid) AS value FROM (SELECT sourceid, unnest(string_split(issn, ', ')) AS k FROM scimago_journals) WHERE k <> '' GROUP BY k")
def src09_dimension(t):
    return readers.dimension(t("scimago_journals"), F.split("issn", ", "), "sourceid", "sourceid")


@query(
    "SELECT doc_id, CAST(floor((rn - 1) / ceil(n / 4.0)) + 1 AS INTEGER) AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) "
    "OVER () AS n FROM documents)"
)
def src15_shards(t):
    return readers.shard(t("documents").select("doc_id"), "doc_id", 4)


@query("SELECT 'figures' AS \"table\", doi, source FROM figures UNION ALL SELECT 'documents', doi, source FROM documents UNION ALL SELECT 'srp', doi, NULL FROM srp")
def snk02_tidy_union(t):
    return writers.tidy({"figures": t("figures"), "documents": t("documents"), "srp": t("srp")}, ["doi", "source"])


@query(
    "SELECT result_id, status, error_message FROM (SELECT result_id, 'failed' AS status, substr(regexp_replace(error_message, '[\\r\\n]+', ' ', 'g'), 1, "
    "500) AS error_message FROM results WHERE error_message IS NOT NULL UNION ALL SELECT result_id, 'done', NULL FROM results WHERE error_message IS NULL)"
)
def snk05_master_export(t):
    r = t("results").select("result_id", "error_message")
    return writers.master_export({"failed": r.where("error_message IS NOT NULL"), "done": r.where("error_message IS NULL")}, ["result_id"], "error_message").select("result_id", "status", "error_message")


# ---------------------------------------------------------------- projections


@query(
    "SELECT row_id, CASE WHEN trim(journal, ' ') <> '' THEN trim(journal, ' ') WHEN trim(scimago_title, ' ') <> '' THEN trim(scimago_title, ' ') ELSE NULL "
    "END AS name FROM stage1_ga_index"
)
def prj02_first_value(t):
    return t("stage1_ga_index").select("row_id", values.first_value(F.col("journal"), F.col("scimago_title")).alias("name"))


@query(
    "SELECT row_id, try_cast(regexp_replace(domain_match_score, '[,%]', '', 'g') AS DOUBLE) AS score, CAST(round_even(try_cast(domain_match_score AS "
    "DOUBLE) * 5, 0) AS INTEGER) AS step, has_pdf = 1 AS pdf FROM stage1_ga_index"
)
def prj03_casts(t):
    s = values.number(F.col("domain_match_score"))
    return t("stage1_ga_index").select("row_id", s.alias("score"), values.whole(s * 5).alias("step"), values.flag(F.col("has_pdf")).alias("pdf"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate) AS INTEGER) AS prefix FROM orders")
def prj04_years(t):
    d = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t("orders").select("o_orderkey", values.year_of(d).alias("year"), values.year_prefix(d).alias("prefix"))


_SQ = "regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    f"SELECT row_id, lower({_SQ.format(chr(39).join(['regexp_replace(trim(doi), ', 'https?://doi[.]org/', ', ', '', ', ', 'g', ')']))}) AS doi_key, "
    f"lower({_SQ.format('replace(replace(lower(trim(doi)), ' + chr(39) + 'https://doi.org/' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + 'doi:' + chr(39) + ', ' + chr(39) * 2 + ')')}) "
    f"AS id_key, regexp_replace(doi_folder_name, '^([^_]*)_', '\\1/') AS doi FROM stage1_ga_index"
)
def prj05_keys(t):
    return t("stage1_ga_index").select("row_id", values.doi_key(F.col("doi")).alias("doi_key"), values.id_key(F.col("doi")).alias("id_key"), values.doi_from_folder(F.col("doi_folder_name")).alias("doi"))


@query("SELECT row_id, CASE WHEN trim(string_split(domain, ';')[1]) <> '' THEN trim(string_split(domain, ';')[1]) END AS keep, coalesce(CASE WHEN trim(string_split(domain, ';')[1]) <> '' THEN lower(" + _SQ.format("trim(string_split(domain, ';')[1])") + ") END, 'unknown') AS slug FROM stage1_ga_index")
def prj06_primary_domain(t):
    return t("stage1_ga_index").select("row_id", values.primary(F.col("domain")).alias("keep"), values.primary(F.col("domain"), missing="unknown", slug=True).alias("slug"))


@query(
    "SELECT fig_row_id, concat_ws(';', CASE WHEN bounding_box.w < 120 OR bounding_box.h < 120 THEN 'low_resolution' END, CASE WHEN bounding_box.w / "
    "bounding_box.h > 3 THEN 'very_wide' END, CASE WHEN bounding_box.w / bounding_box.h < 1.0/3 THEN 'very_tall' END) AS notes FROM figures"
)
def prj07_image_flags(t):
    b = F.col("bounding_box")
    f = values.image_flags(b["w"], b["h"], F.lit(None).cast("int"), min_side=120)
    return t("figures").select("fig_row_id", values.notes({k: f[k] for k in ("low_resolution", "very_wide", "very_tall")}).alias("notes"))


@query(
    "SELECT row_id, concat_ws(';', CASE WHEN trim(coalesce(title, '')) = '' THEN 'title' END, CASE WHEN trim(coalesce(publisher, '')) = '' THEN "
    "'publisher' END, CASE WHEN publication_year IS NULL THEN 'publication_year' END) AS missing, CAST(trim(coalesce(title, '')) <> '' AND "
    "trim(coalesce(publisher, '')) <> '' AND publication_year IS NOT NULL AS INTEGER) AS complete FROM stage1_ga_index"
)
def prj09_missing_fields(t):
    m = values.missing_fields(["title", "publisher", "publication_year"])
    return t("stage1_ga_index").select("row_id", m.alias("missing"), (m == "").cast("int").alias("complete"))


@query(
    "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 1.0 WHEN 'p' THEN 0.5 WHEN 'o' THEN 0.0 END AS status_score, (5 - "
    "CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) / 4 AS urgency FROM orders"
)
def prj10_scores(t):
    return t("orders").select("o_orderkey", values.category_score(F.col("o_orderstatus"), {"F": 1.0, "f": 1.0, "p": 0.5, "o": 0.0}).alias("status_score"), values.likert(F.substring("o_orderpriority", 1, 1), reverse=True).alias("urgency"))


@query(
    "SELECT result_id, round(list_avg(list_filter([CAST(input_tokens AS DOUBLE) / 1000, inference_time, avg_visual_proxies_per_entity], lambda x: x IS NOT "
    "NULL)), 6) AS mean, round(coalesce(output_tokens / nullif(CAST(input_tokens AS DOUBLE), 0), 0), 6) AS share FROM results"
)
def prj11_row_mean_ratio(t):
    return t("results").select("result_id", r6(values.row_mean(F.col("input_tokens") / 1000, F.col("inference_time"), F.col("avg_visual_proxies_per_entity")), "mean"), r6(values.ratio(F.col("output_tokens"), F.col("input_tokens")), "share"))


@query(
    "SELECT srp_id, 'introduction' AS section, length(section_summaries.introduction) AS n FROM srp UNION ALL SELECT srp_id, 'methods', "
    "length(section_summaries.methods) FROM srp UNION ALL SELECT srp_id, 'results', length(section_summaries.results) FROM srp UNION ALL SELECT srp_id, "
    "'discussion', length(section_summaries.discussion) FROM srp"
)
def prj14_unpivot(t):
    s = F.col("section_summaries")
    wide = t("srp").select("srp_id", *[F.length(s[x]).alias(x) for x in replies.SECTIONS])
    return wide.unpivot(["srp_id"], list(replies.SECTIONS), "section", "n").withColumn("n", F.col("n").cast("bigint"))


@query(
    "SELECT result_id, CASE WHEN causal_relations_present <= 1 THEN 'low' WHEN causal_relations_present = 2 THEN 'mid' WHEN causal_relations_present >= 3 "
    "THEN 'high' END AS band, coalesce(model, '') || '|' || coalesce(variant, '') AS method FROM results"
)
def prj15_bands_and_keys(t):
    return t("results").select("result_id", values.level_band(F.col("causal_relations_present")).alias("band"), values.method_key(F.col("model"), F.col("variant")).alias("method"))


@query("SELECT CASE WHEN n >= 100 THEN domain ELSE 'other' END AS domain, sum(n)::BIGINT AS n FROM (SELECT domain, count(*) AS n FROM stage1_ga_index GROUP BY domain) GROUP BY 1")
def prj17_lump_small(t):
    return aggregates.lump_small(t("stage1_ga_index").select("domain"), "domain", 100).groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT row_id, round(ln(1 + publication_year), 6) AS log1p, publication_year - (SELECT min(publication_year) FROM stage1_ga_index) AS year_c FROM stage1_ga_index")
def prj18_log_and_center(t):
    x = t("stage1_ga_index").select("row_id", "publication_year")
    return x.crossJoin(F.broadcast(x.agg(F.min("publication_year").alias("m")))).select("row_id", r6(F.log1p("publication_year"), "log1p"), (F.col("publication_year") - F.col("m")).alias("year_c"))


# ---------------------------------------------------------------- joins


@query(
    "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = "
    "n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"
)
def j01_inner_and_left(t):
    c, n, r = t("customer"), t("nation"), t("region")
    o = t("orders").join(c, F.col("o_custkey") == c["c_custkey"])
    return o.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "SELECT count(*) AS n_rows, count(y) AS n_matched, count(*) - count(y) AS n_dropped FROM (SELECT s.srp_id, g.y FROM srp s LEFT JOIN (SELECT "
    "doi_normalized AS doi, max(publication_year) AS y FROM stage1_ga_index GROUP BY 1) g ON s.doi = g.doi)"
)
def j04_drop_and_count(t):
    years = t("stage1_ga_index").groupBy(F.col("doi_normalized").alias("doi")).agg(F.max("publication_year").alias("y"))
    return joins.join_and_count(t("srp").select("srp_id", "doi"), years, "doi", "y")[1]


@query("SELECT doi FROM figures WHERE doi IS NOT NULL INTERSECT SELECT doi FROM srp WHERE doi IS NOT NULL INTERSECT SELECT doi FROM results WHERE doi IS NOT NULL")
def j05_common_to_all(t):
    return joins.common_to_all([t(x).where("doi IS NOT NULL") for x in ("figures", "srp", "results")], "doi")


@query(
    "SELECT result_id FROM results WHERE doi IN (SELECT doi FROM srp WHERE doi IS NOT NULL) AND model NOT IN (SELECT model FROM srp WHERE model IS NOT "
    "NULL AND srp_variant = 'none')"
)
def j06_semi_and_anti(t):
    r, s = t("results"), t("srp")
    return r.join(s.select("doi").distinct(), "doi", "left_semi").join(s.where("srp_variant = 'none'").select("model").distinct(), "model", "left_anti").select("result_id")


@query(
    "WITH k AS (SELECT row_id, 0 AS tier, issn_l AS a FROM stage1_ga_index UNION ALL SELECT row_id, 1, lower(trim(journal, ' ')) FROM stage1_ga_index), d0 "
    "AS (SELECT k, max(sourceid) AS value FROM (SELECT sourceid, substr(x, 1, 4) || '-' || substr(x, 5) AS k FROM (SELECT sourceid, "
    "unnest(string_split(issn, ', ')) AS x FROM scimago_journals)) GROUP BY k), d1 AS (SELECT lower(title) AS k, max(sourceid) AS value FROM "
    "scimago_journals GROUP BY 1), h AS (SELECT row_id, tier, value FROM k JOIN d0 ON tier = 0 AND k.a = d0.k UNION ALL SELECT row_id, tier, value FROM k "
    "JOIN d1 ON tier = 1 AND k.a = d1.k) SELECT row_id, min(tier) AS tier, 0 AS pos, arg_min(value, tier) AS value FROM h GROUP BY row_id"
)
def j08_tiered_lookup(t):
    x, d = t("stage1_ga_index"), t("scimago_journals")
    by_issn = d.select(F.explode(F.split("issn", ", ")).alias("x"), "sourceid").groupBy(F.concat(F.substring("x", 1, 4), F.lit("-"), F.expr("substring(x, 5)")).alias("k")).agg(F.max("sourceid").alias("value"))
    by_title = d.groupBy(F.lower("title").alias("k")).agg(F.max("sourceid").alias("value"))
    return joins.tiered_lookup(x, "row_id", [F.array("issn_l"), F.array(F.lower(F.trim("journal")))], [by_issn, by_title])


@query()
def j09_similar_titles(t):
    v = t("stage1_ga_index").select(F.lower(F.trim("journal")).alias("value"))
    d = t("scimago_journals").select(F.lower("title").alias("title"))
    return joins.similar_titles(v.join(d, v["value"] == d["title"], "left_anti"), d)


@query(
    "WITH h AS (SELECT min(vec_id) AS k, b FROM (SELECT vec_id, list_sum(list_transform(range(16), lambda i: CASE WHEN embedding[i + 1] > 0 THEN "
    "(1::BIGINT << CAST(4 * i AS INTEGER)) ELSE 0 END))::BIGINT AS b FROM embeddings) GROUP BY b) SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, "
    "CAST(bit_count(xor(x.b, y.b)) AS INTEGER) AS distance FROM h x JOIN h y ON x.b < y.b WHERE bit_count(xor(x.b, y.b)) <= 1"
)
def j10_hamming_pairs(t):
    """Pairs between the representatives of equal hashes; ``j10_hamming_members`` has all rows."""
    return joins.hamming_pairs(_signs(t("embeddings")), "vec_id", "h", 1).withColumn("distance", F.col("distance").cast("int"))


def _signs(e: DataFrame) -> DataFrame:
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("bigint"), lambda a, i: a + F.when(F.get(F.col("embedding"), i) > 0, F.pow(F.lit(16.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return e.select("vec_id", bits.alias("h"))


@query(
    "WITH e AS (SELECT vec_id, list_sum(list_transform(range(16), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << CAST(4 * i AS INTEGER)) ELSE "
    "0 END))::BIGINT AS b FROM embeddings), c AS (SELECT b, min(vec_id) AS rep, count(*) AS n FROM e GROUP BY b), l AS (SELECT x.b, sum(y.n) - 1 AS links "
    "FROM c x JOIN c y ON bit_count(xor(x.b, y.b)) <= 1 GROUP BY 1) SELECT vec_id, rep, n AS class_size, CAST(links AS BIGINT) AS links FROM e JOIN c "
    "USING (b) JOIN l USING (b)"
)
def j10_hamming_members(t):
    return joins.hamming_members(_signs(t("embeddings")), "vec_id", "h", 1)


@query(
    "SELECT f.fig_row_id, d.kind FROM (SELECT fig_row_id, doi, page FROM figures WHERE doi IS NOT NULL AND page IS NOT NULL) f ASOF LEFT JOIN (SELECT doi, "
    "page, arg_min(label, fig_row_id) AS kind FROM figures WHERE type = 'table' AND doi IS NOT NULL AND page IS NOT NULL GROUP BY doi, page) d ON f.doi = "
    "d.doi AND f.page >= d.page"
)
def j11_as_of(t):
    f = t("figures").where("doi IS NOT NULL AND page IS NOT NULL").select("fig_row_id", "doi", "page")
    r = t("figures").where("type = 'table' AND doi IS NOT NULL AND page IS NOT NULL").select("doi", F.col("page").alias("p"), F.col("label").alias("kind"), F.col("fig_row_id").alias("o"))
    return joins.as_of(f, r, "doi", "page", "p", "kind", "o").select("fig_row_id", "kind")


@query(
    "WITH f AS (SELECT fig_row_id, doi, page FROM figures WHERE doi IS NOT NULL AND page IS NOT NULL), r AS (SELECT doi, page, arg_min(label, fig_row_id) "
    "AS kind FROM figures WHERE type = 'table' AND doi IS NOT NULL AND page IS NOT NULL GROUP BY doi, page), e AS (SELECT doi, arg_min(kind, page) AS k0 "
    "FROM r GROUP BY doi), a AS (SELECT f.fig_row_id, f.doi, d.kind FROM f ASOF LEFT JOIN r d ON f.doi = d.doi AND f.page >= d.page) SELECT a.fig_row_id, "
    "coalesce(a.kind, e.k0) AS kind FROM a LEFT JOIN e ON a.doi = e.doi"
)
def j12_as_of_or_first(t):
    f = t("figures").where("doi IS NOT NULL AND page IS NOT NULL").select("fig_row_id", "doi", "page")
    r = t("figures").where("type = 'table' AND doi IS NOT NULL AND page IS NOT NULL").select("doi", F.col("page").alias("p"), F.col("label").alias("kind"), F.col("fig_row_id").alias("o"))
    return joins.as_of(f, r, "doi", "page", "p", "kind", "o", forward_first=True).select("fig_row_id", "kind")


@query(
    "WITH f AS (SELECT fig_row_id, doi, page FROM figures WHERE doi IS NOT NULL AND page IS NOT NULL AND type = 'figure'), r AS (SELECT doi, page AS p, "
    "min(label) AS label FROM figures WHERE type = 'table' AND doi IS NOT NULL AND page IS NOT NULL GROUP BY doi, page), b AS (SELECT f.fig_row_id, "
    "f.page, d.p, d.label FROM f ASOF LEFT JOIN r d ON f.doi = d.doi AND f.page >= d.p), a AS (SELECT f.fig_row_id, d.p, d.label FROM f ASOF LEFT JOIN r d "
    "ON f.doi = d.doi AND f.page <= d.p) SELECT b.fig_row_id, CASE WHEN b.p IS NULL THEN a.label WHEN a.p IS NULL THEN b.label WHEN a.p - b.page <= b.page "
    "- b.p THEN a.label ELSE b.label END AS label FROM b JOIN a ON a.fig_row_id = b.fig_row_id"
)
def j13_nearest(t):
    f = t("figures").where("doi IS NOT NULL AND page IS NOT NULL")
    left = f.where("type = 'figure'").select("fig_row_id", "doi", "page")
    return joins.nearest(left, f.where("type = 'table'").select("doi", F.col("page").alias("p"), "label"), "doi", "page", "p", "label").select("fig_row_id", "label")


@query(
    "SELECT doi, figure_id, min(fig_row_id) AS fig_row_id FROM (SELECT doi, figure_id, fig_row_id, min(CASE WHEN source = 'tei_walk' THEN 0 ELSE 1 END) "
    "OVER (PARTITION BY doi, figure_id) AS m, CASE WHEN source = 'tei_walk' THEN 0 ELSE 1 END AS s FROM figures WHERE source IN ('tei_walk', "
    "'vector_clip') AND doi IS NOT NULL) WHERE s = m AND figure_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT doi, NULL, fig_row_id FROM figures WHERE "
    "figure_id IS NULL AND source = 'tei_walk' AND doi IS NOT NULL"
)
def j15_merge_detections(t):
    f = t("figures").where("doi IS NOT NULL").select("doi", "figure_id", "fig_row_id", "source")
    return joins.merge_detections(f.where("source = 'tei_walk'").drop("source"), f.where("source = 'vector_clip'").drop("source"), ["doi", "figure_id"], "fig_row_id").select("doi", "figure_id", "fig_row_id")


_RATERS = "(SELECT vec_id, i AS rater, least(4, greatest(0, CAST(floor((embedding[i] + 0.3) * 8) AS INTEGER))) AS v FROM embeddings, (SELECT unnest([1, 2, 3, 4]) AS i))"


def _raters(t):
    e = t("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("p", "x"))
    v = F.least(F.lit(4), F.greatest(F.lit(0), F.floor((F.col("x") + F.lit(0.3).cast("float")) * F.lit(8).cast("float")).cast("int")))
    return e.select("vec_id", (F.col("p") + 1).alias("rater"), v.alias("v"))


_RATERS = "(SELECT vec_id, i AS rater, least(4, greatest(0, CAST(floor((embedding[i] + CAST(0.3 AS FLOAT)) * CAST(8 AS FLOAT)) AS INTEGER))) AS v FROM embeddings, (SELECT unnest([1, 2, 3, 4]) AS i))"


@query(
    f"SELECT a.rater AS r1, b.rater AS r2, count(*) AS n, CAST(sum(CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS BIGINT) AS same FROM {_RATERS} a JOIN "
    f"{_RATERS} b ON a.vec_id = b.vec_id AND a.rater < b.rater GROUP BY 1, 2"
)
def j16_rater_pairs(t):
    p = joins.rater_pairs(_raters(t), "vec_id", "rater", "v")
    return p.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.count_if(F.col("v1") == F.col("v2")).alias("same"))


@query(
    "WITH b AS (SELECT doi, page, extraction_timestamp AS z, fig_row_id AS k, bounding_box.x AS x, bounding_box.y AS y, bounding_box.w AS w, "
    "bounding_box.h AS h FROM figures WHERE doi IS NOT NULL AND page IS NOT NULL AND bounding_box IS NOT NULL), p AS (SELECT a.doi, a.page, a.z, "
    "sqrt(pow((a.x + a.w / 2) - (c.x + c.w / 2), 2) + pow((a.y + a.h / 2) - (c.y + c.h / 2), 2)) AS d, CASE WHEN least(a.x + a.w, c.x + c.w) > "
    "greatest(a.x, c.x) AND least(a.y + a.h, c.y + c.h) > greatest(a.y, c.y) THEN 1 ELSE 0 END AS o FROM b a JOIN b c ON a.doi = c.doi AND a.page = c.page "
    "AND a.z IS NOT DISTINCT FROM c.z AND a.k < c.k), q AS (SELECT doi, page, z, min(d) AS d, sum(o) AS o FROM p GROUP BY 1, 2, 3) SELECT g.k AS "
    "fig_row_id, round(q.d, 6) AS nearest_distance, CAST(coalesce(q.o, 0) AS INTEGER) AS overlapping_pairs FROM (SELECT doi, page, z, min(k) AS k FROM b "
    "GROUP BY 1, 2, 3) g LEFT JOIN q ON g.doi = q.doi AND g.page = q.page AND g.z IS NOT DISTINCT FROM q.z"
)
def j17_box_neighbours(t):
    f = t("figures").where("doi IS NOT NULL AND page IS NOT NULL AND bounding_box IS NOT NULL")
    g = f.groupBy("doi", "page", "extraction_timestamp").agg(F.collect_list("bounding_box").alias("boxes"), F.min("fig_row_id").alias("fig_row_id"))  # a page as it was delivered
    return joins.box_neighbours(g, "boxes").select("fig_row_id", r6(F.col("nearest_distance"), "nearest_distance"), "overlapping_pairs")


@query(
    "SELECT tab_row_id, CAST(coalesce(list_position(list_transform(tables, lambda x: x.text IS NOT NULL AND contains(x.text, 'n.d.')), true), 0) AS "
    "INTEGER) AS place FROM paper_tables WHERE tables IS NOT NULL"
)
def j18_first_containing(t):
    return t("paper_tables").where("tables IS NOT NULL").select("tab_row_id", F.coalesce(joins.first_containing(F.transform("tables", lambda x: F.coalesce(x["text"], F.lit(""))), F.lit("n.d.")), F.lit(0)).alias("place"))


# ---------------------------------------------------------------- aggregates

_VERDICT = "CASE l_returnflag WHEN 'A' THEN 'explicit' WHEN 'R' THEN 'implied' ELSE 'absent' END"


def _entities(t):
    v = F.when(F.col("l_returnflag") == "A", "explicit").when(F.col("l_returnflag") == "R", "implied").otherwise("absent")
    return t("lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 4).alias("section"), v.alias("verdict"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5).alias("rel"))


@query(
    f"SELECT doc, section, round(avg(CASE verdict WHEN 'explicit' THEN 1.0 WHEN 'implied' THEN 0.5 ELSE 0.0 END), 6) AS coverage, count(*) FILTER (verdict "
    f"= 'explicit') AS n_explicit, count(*) FILTER (verdict = 'implied') AS n_implied, count(*) FILTER (verdict = 'absent') AS n_absent FROM (SELECT "
    f"l_orderkey AS doc, l_linenumber % 4 AS section, {_VERDICT} AS verdict FROM lineitem) GROUP BY 1, 2"
)
def a01_section_coverage(t):
    return _rounded(aggregates.section_coverage(_entities(t), ["doc", "section"], "verdict"))


@query(
    f"WITH e AS (SELECT l_orderkey AS doc, l_linenumber % 4 AS section, {_VERDICT} AS verdict, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.5 END AS rel "
    f"FROM lineitem), c AS (SELECT doc, section, avg(CASE verdict WHEN 'explicit' THEN 1.0 WHEN 'implied' THEN 0.5 ELSE 0.0 END) AS cov FROM e GROUP BY 1, "
    f"2), s AS (SELECT doc, sum(cov) / 4 AS s, CAST(count(*) FILTER (cov > 0) AS INTEGER) AS level FROM c GROUP BY 1), r AS (SELECT doc, avg(rel) AS r FROM "
    f"e GROUP BY 1) SELECT s.doc, round(s, 6) AS s, round(r, 6) AS r, round(0.7 * s + 0.3 * r, 6) AS c, level FROM s JOIN r ON s.doc = r.doc"
)
def a02_document_scores(t):
    e = _entities(t)
    return _rounded(aggregates.document_scores(aggregates.section_coverage(e, ["doc", "section"], "verdict"), "doc", "section", e, "rel", range(4)))


@query(
    "SELECT model, variant, count(*) AS n_total, count(*) FILTER (status = 'success') AS n_scored, round(avg(entity_count), 6) AS mean_entity_count, "
    "round(avg(causal_relations_present), 6) AS mean_causal_relations_present FROM results GROUP BY 1, 2"
)
def a04_method_summary(t):
    return _rounded(aggregates.method_summary(t("results"), ["model", "variant"], ["entity_count", "causal_relations_present"], F.col("status") == "success"))


@query(
    "SELECT variant, count(*) AS n, round(avg(CAST(a = b AS INTEGER)) * 100, 6) AS exact_pct, round(avg(CAST(abs(a - b) <= 1 AS INTEGER)) * 100, 6) AS "
    "within1_pct, round(avg(CAST(a > b AS INTEGER)) * 100, 6) AS higher_pct, round(avg(a - b), 6) AS mean_diff FROM (SELECT variant, "
    "causal_relations_present AS a, least(entity_count, 3) AS b FROM results) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY variant"
)
def a06_level_comparison(t):
    r = t("results").select("variant", F.col("causal_relations_present").alias("a"), F.expr("least(entity_count, if(entity_count is null, null, 3))").alias("b"))
    return _rounded(aggregates.level_comparison(r, "a", "b", ["variant"]))


@query(
    "SELECT i.v AS a, j.v AS b, count(r.a) AS n FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS v) i CROSS JOIN (SELECT CAST(unnest(range(5)) AS "
    "INTEGER) AS v) j LEFT JOIN (SELECT l_linenumber % 5 AS a, CAST(l_quantity AS INTEGER) % 5 AS b FROM lineitem) r ON r.a = i.v AND r.b = j.v GROUP BY "
    "1, 2"
)
def a07_confusion(t):
    return aggregates.confusion(t("lineitem").select((F.col("l_linenumber") % 5).alias("a"), (F.col("l_quantity").cast("int") % 5).alias("b")), "a", "b", 0, 4)


@query(
    "SELECT g.bin, count(d.d) AS n FROM (SELECT CAST(unnest(range(-4, 5)) AS INTEGER) AS bin) g LEFT JOIN (SELECT l_linenumber % 5 - CAST(l_quantity AS "
    "INTEGER) % 5 AS d FROM lineitem) d ON d.d = g.bin GROUP BY 1"
)
def a07_difference_histogram(t):
    return aggregates.histogram(t("lineitem"), F.col("l_linenumber") % 5 - F.col("l_quantity").cast("int") % 5, -4, 4)


@query(
    "SELECT coalesce(nullif(trim(publisher), ''), 'UNKNOWN') AS publisher, count(*) AS n, min(publication_year) AS min_year, max(publication_year) AS "
    "max_year, round(avg(has_ga), 6) AS ga_share FROM stage1_ga_index GROUP BY 1"
)
def a09_group_summary(t):
    x = t("stage1_ga_index")
    return x.groupBy(aggregates.group_key(F.col("publisher")).alias("publisher")).agg(F.count("*").alias("n"), F.min("publication_year").alias("min_year"), F.max("publication_year").alias("max_year"), r6(F.avg("has_ga"), "ga_share"))


@query(
    "SELECT publication_year, domain, article_type, count(*) AS n FROM stage1_ga_index GROUP BY GROUPING SETS ((publication_year), (domain), "
    "(article_type), (publication_year, domain))"
)
def a10_grouping_sets(t):
    return aggregates.group_sets(t("stage1_ga_index"), [["publication_year"], ["domain"], ["article_type"], ["publication_year", "domain"]], [F.count("*").alias("n")]).select("publication_year", "domain", "article_type", "n")


@query(
    "SELECT field, value, count(*) AS n FROM (SELECT 'oa_status' AS field, oa_status AS value FROM stage1_ga_index UNION ALL SELECT 'article_type', "
    "article_type FROM stage1_ga_index UNION ALL SELECT 'has_ga', CAST(has_ga AS VARCHAR) FROM stage1_ga_index) GROUP BY 1, 2"
)
def a14_frequencies(t):
    return aggregates.frequencies(t("stage1_ga_index"), ["oa_status", "article_type", "has_ga"])


@query(
    "SELECT model, count(*) AS n, count(*) FILTER (status = 'success') AS n_success, round(avg(CAST(status = 'success' AS INTEGER)), 6) AS success_share, "
    "round(avg(inference_time), 6) AS mean_latency, round(median(inference_time), 6) AS median_latency, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM "
    "results GROUP BY 1"
)
def a15_run_summary(t):
    return _rounded(aggregates.run_summary(t("results"), ["model"], "status", "inference_time", "output_tokens"))


@query(
    "WITH w AS (SELECT srp_id, list_transform([section_summaries.introduction, section_summaries.methods, section_summaries.results, "
    "section_summaries.discussion], lambda x: CASE WHEN trim(regexp_replace(coalesce(x, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') = '' THEN 0 ELSE "
    "len(string_split(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')) END) AS a FROM srp) SELECT srp_id, CAST(list_sum(a) AS "
    "INTEGER) AS words, round(list_stddev_pop(a), 6) AS sd FROM w"
)
def a16_nested_counts(t):
    s = F.col("section_summaries")
    n = F.array(*[aggregates.words(s[x]).cast("double") for x in replies.SECTIONS])
    return t("srp").select("srp_id", F.aggregate(n, F.lit(0.0), lambda a, x: a + x).cast("int").alias("words"), r6(aggregates.population_sd(n), "sd"))


@query(
    "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.05), 6) AS p5, round(quantile_cont(l_quantity, 0.95), 6) AS p95, "
    "round(quantile_cont(l_extendedprice, 0.3333), 6) AS t1, round(quantile_cont(l_extendedprice, 0.6667), 6) AS t2 FROM lineitem GROUP BY 1"
)
def a17_quantiles(t):
    li = t("lineitem")
    a = aggregates.percentiles(li, ["l_quantity"], [0.05, 0.95], ["l_returnflag"])
    b = aggregates.percentiles(li, ["l_extendedprice"], [0.3333, 0.6667], ["l_returnflag"])
    return a.join(b, "l_returnflag").select("l_returnflag", r6(F.col("l_quantity")[0], "p5"), r6(F.col("l_quantity")[1], "p95"), r6(F.col("l_extendedprice")[0], "t1"), r6(F.col("l_extendedprice")[1], "t2"))


@query(
    "SELECT y, count(*) AS n, round(avg(x), 2) AS mean, round(coalesce(stddev_samp(x), 0), 2) AS sd, round(avg(x) - 1.96 * coalesce(stddev_samp(x), 0) / "
    "sqrt(count(*)), 2) AS lo, round(avg(x) + 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(*)), 2) AS hi FROM (SELECT CAST(year(o_orderdate) AS "
    "INTEGER) AS y, o_totalprice AS x FROM orders) GROUP BY y"
)
def a18_mean_ci(t):
    g = aggregates.mean_ci(t("orders").select(F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("x")), ["y"], "x")
    return g.select("y", "n", *[F.round(c, 2).alias(c) for c in ("mean", "sd", "lo", "hi")])


@query(
    "SELECT o_orderpriority, count(*) AS n, round(regr_slope(x, y), 2) AS slope FROM (SELECT o_orderpriority, CAST(year(o_orderdate) AS DOUBLE) AS y, "
    "o_totalprice AS x FROM orders) GROUP BY 1"
)
def a20_slopes(t):
    g = aggregates.slope(t("orders").select("o_orderpriority", F.year("o_orderdate").cast("double").alias("y"), F.col("o_totalprice").alias("x")), ["o_orderpriority"], "y", "x")
    return g.select("o_orderpriority", "n", F.round("slope", 2).alias("slope"))


@query(
    "WITH d AS (SELECT model, CAST(output_tokens AS DOUBLE) AS x, inference_time AS y FROM results WHERE output_tokens IS NOT NULL AND inference_time IS "
    "NOT NULL), r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY x) + (count(*) OVER (PARTITION BY model, x) - 1) / 2.0 AS a, rank() OVER "
    "(PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0 AS b FROM d) SELECT model, count(*) AS n, round(corr(a, b), 6) AS "
    "spearman FROM r GROUP BY model"
)
def a21_spearman(t):
    return _rounded(agreement.spearman(t("results").select("model", F.col("output_tokens").cast("double").alias("x"), F.col("inference_time").alias("y")), ["model"], "x", "y"))


@query(
    "SELECT model, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson FROM (SELECT model, CAST(output_tokens AS DOUBLE) AS x, "
    "inference_time AS y FROM results WHERE output_tokens IS NOT NULL AND inference_time IS NOT NULL) GROUP BY 1"
)
def a21_pearson(t):
    r = t("results").where("output_tokens IS NOT NULL AND inference_time IS NOT NULL")
    return r.groupBy("model").agg(r6(agreement.pearson("output_tokens", "inference_time"), "pearson"))


@query(
    f"WITH p AS (SELECT a.v AS a, b.v AS b FROM {_RATERS} a JOIN {_RATERS} b ON a.vec_id = b.vec_id AND a.rater = 1 AND b.rater = 2), o AS (SELECT a, b, "
    f"count(*) AS n FROM p GROUP BY 1, 2), ra AS (SELECT a, count(*) AS n FROM p GROUP BY 1), rb AS (SELECT b, count(*) AS n FROM p GROUP BY 1) SELECT "
    f"round(1 - (SELECT sum(n * (a - b) * (a - b)) FROM o) / (SELECT sum(ra.n * rb.n * (ra.a - rb.b) * (ra.a - rb.b)) / (SELECT CAST(count(*) AS DOUBLE) "
    f"FROM p) FROM ra CROSS JOIN rb), 6) AS kappa, round((SELECT avg(CAST(a = b AS INTEGER)) FROM p), 6) AS agreement"
)
def a22_kappa(t):
    w = _raters(t).groupBy("vec_id").agg(F.max(F.when(F.col("rater") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("rater") == 2, F.col("v"))).alias("b"))
    return w.agg(r6(agreement.quadratic_kappa(F.col("a"), F.col("b")), "kappa"), r6(agreement.percent_agreement(F.col("a"), F.col("b")), "agreement"))


@query(
    f"WITH x AS (SELECT * FROM {_RATERS}), g AS (SELECT avg(v) AS m, count(*) AS nk, sum(v * v) AS q FROM x), r AS (SELECT sum(4 * pow(m - (SELECT m FROM "
    f"g), 2)) AS ssr, count(*) AS n FROM (SELECT vec_id, avg(v) AS m FROM x GROUP BY 1)), c AS (SELECT sum((SELECT n FROM r) * pow(m - (SELECT m FROM g), "
    f"2)) AS ssc FROM (SELECT rater, avg(v) AS m FROM x GROUP BY 1)), t AS (SELECT sum(pow(v - (SELECT m FROM g), 2)) AS sst FROM x), ms AS (SELECT n, ssr "
    f"/ (n - 1) AS a, ssc / 3 AS b, (sst - ssr - ssc) / ((n - 1) * 3) AS e FROM r, c, t) SELECT n, CAST(4 AS BIGINT) AS k, round((a - e) / (a + 3 * e + 4 * "
    f"(b - e) / n), 6) AS icc_2_1, round((a - e) / (a + (b - e) / n), 6) AS icc_2_k FROM ms"
)
def a24_icc(t):
    return _rounded(agreement.icc(_raters(t), "vec_id", "rater", "v"))


@query(
    f"WITH x AS (SELECT * FROM {_RATERS}), c AS (SELECT vec_id, v, count(*) AS n FROM x GROUP BY 1, 2), pa AS (SELECT avg(s) AS pa FROM (SELECT vec_id, "
    f"sum(n * (n - 1)) / 12.0 AS s FROM c GROUP BY 1)), pe AS (SELECT sum(p * (1 - p)) / 4 AS pe FROM (SELECT v, sum(n) / (SELECT CAST(count(*) AS DOUBLE) "
    f"FROM x) AS p FROM c GROUP BY 1)) SELECT (SELECT count(DISTINCT vec_id) FROM x) AS n, round(pa, 6) AS pa, round(pe, 6) AS pe, round((pa - pe) / (1 - "
    f"pe), 6) AS ac FROM pa, pe"
)
def a25_gwet(t):
    return _rounded(agreement.gwet(_raters(t), "vec_id", "v", 5))


@query(
    f"WITH x AS (SELECT * FROM {_RATERS}), c AS (SELECT vec_id, v, count(*) AS n FROM x GROUP BY 1, 2), o AS (SELECT a.v AS a, b.v AS b, sum(a.n * (b.n - "
    f"CASE WHEN a.v = b.v THEN 1 ELSE 0 END) / 3.0) AS o FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY 1, 2), m AS (SELECT a AS v, sum(o) AS n FROM o "
    f"GROUP BY 1) SELECT round(1 - (SELECT sum(o) FROM o WHERE a <> b) / ((SELECT sum(p.n * q.n) FROM m p JOIN m q ON p.v <> q.v) / ((SELECT sum(n) FROM m) "
    f"- 1)), 6) AS nominal, round(1 - (SELECT sum(o * (a - b) * (a - b)) FROM o) / ((SELECT sum(p.n * q.n * (p.v - q.v) * (p.v - q.v)) FROM m p CROSS JOIN "
    f"m q) / ((SELECT sum(n) FROM m) - 1)), 6) AS \"interval\""
)
def a26_krippendorff(t):
    x = _raters(t)
    a, b = (agreement.krippendorff(x, "vec_id", "v", k).select(r6(F.col("alpha"), k)) for k in ("nominal", "interval"))
    return a.crossJoin(F.broadcast(b))


@query(
    "WITH x AS (SELECT doi, 'model' AS field, model AS v FROM srp WHERE doi IS NOT NULL AND model IS NOT NULL UNION ALL SELECT doi, 'srp_variant', "
    "srp_variant FROM srp WHERE doi IS NOT NULL AND srp_variant IS NOT NULL), c AS (SELECT doi, field, v, count(*) AS n FROM x GROUP BY 1, 2, 3), g AS "
    "(SELECT doi, field, sum(n) AS n, sum(n * (n - 1)) AS same FROM c GROUP BY 1, 2) SELECT field, CAST(sum(n * (n - 1)) / 2 AS BIGINT) AS n, "
    "round(sum(same) / CAST(sum(n * (n - 1)) AS DOUBLE), 6) AS agreement FROM g GROUP BY 1"
)
def a27_field_agreement(t):
    long = t("srp").select("doi", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("model", "srp_variant")])).alias("x")).select("doi", "x.*").where("doi IS NOT NULL AND v IS NOT NULL")
    return agreement.pair_agreement(long, "doi", ["field"], "v").select("field", F.col("n_pairs").alias("n"), r6(F.col("agreement"), "agreement"))


@query("SELECT substr(sha256(text), 1, 16) AS group_id, min(doc_id) AS first_key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(text), 1 HAVING count(*) > 1")
def a28_exact_groups(t):
    return duplicates.exact_groups(t("documents"), "doc_id", F.col("text")).select("group_id", "first_key", "n")


@query(
    "SELECT doc_id, f AS first_key, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f, count(*) OVER (PARTITION BY text) AS n FROM "
    "documents WHERE text IS NOT NULL) WHERE n > 1"
)
def a28_exact_members(t):
    return duplicates.exact_members(t("documents"), "doc_id", F.col("text")).select("doc_id", "first_key", "n")


@query(
    "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS members, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) "
    "AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)"
)
def a29_duplicate_summary(t):
    return duplicates.duplicate_summary(t("documents"), "doc_id", F.col("text"))


@query(
    "WITH m AS (SELECT median(output_tokens) AS a, median(inference_time) AS b FROM results), q AS (SELECT CASE WHEN output_tokens >= a THEN 'high' ELSE "
    "'low' END || '_' || CASE WHEN inference_time >= b THEN 'high' ELSE 'low' END AS quadrant, output_tokens, inference_time FROM results, m WHERE "
    "output_tokens IS NOT NULL AND inference_time IS NOT NULL) SELECT quadrant, count(*) AS n, round(avg(output_tokens), 6) AS mean_output_tokens, "
    "round(avg(inference_time), 6) AS mean_inference_time, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM q), 6) AS share FROM q GROUP BY 1"
)
def a30_quadrants(t):
    return _rounded(aggregates.quadrants(t("results"), "output_tokens", "inference_time"))


@query(
    "WITH g AS (SELECT avg(l_quantity) AS g FROM lineitem) SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round((avg(l_quantity) - "
    "any_value(g)) * count(*) / (count(*) + 25.0), 6) AS deviation FROM lineitem, g GROUP BY 1 HAVING count(*) >= 20"
)
def a31_shrunk_deviation(t):
    return _rounded(aggregates.shrunk_deviation(t("lineitem"), "l_suppkey", "l_quantity"))


@query(
    "WITH c AS (SELECT source, section, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT source, sum(n) AS t FROM c GROUP BY 1) SELECT c.source, "
    "CAST(any_value(t) AS BIGINT) AS n, round(-sum((c.n / t) * log2(c.n / t)), 6) AS entropy, round(-sum((c.n / t) * log2(c.n / t)) / log2(6), 6) AS "
    "normalised FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source GROUP BY 1"
)
def a32_entropy(t):
    e = aggregates.entropy(t("documents"), ["source"], "section", 6)
    return e.select("source", "n", F.abs(F.round("entropy", 6)).alias("entropy"), F.abs(F.round("normalised", 6)).alias("normalised"))


@query(
    "SELECT result_id, CASE WHEN status = 'api_error' OR parse_mode IS NULL AND status <> 'success' AND entity_count IS NULL THEN 'failed' WHEN "
    "coalesce(stage2_ready, false) THEN 'pass' ELSE 'needs_review' END AS verdict FROM results"
)
def a34_quality_verdict(t):
    failed = F.when((F.col("status") == "api_error") | (F.col("parse_mode").isNull() & (F.col("status") != "success") & F.col("entity_count").isNull()), "failed").otherwise("pass")
    review = F.when(F.coalesce("stage2_ready", F.lit(False)), "pass").otherwise("needs_review")
    return t("results").select("result_id", values.quality_verdict(failed, review).alias("verdict"))


@query(
    "SELECT coalesce(variant, 'POOLED') AS variant, count(*) AS n, round(avg(entity_count), 6) AS mean FROM results WHERE variant IS NOT NULL GROUP BY "
    "GROUPING SETS ((variant), ())"
)
def a35_pooled(t):
    return _rounded(aggregates.pooled(t("results").where("variant IS NOT NULL"), "variant", [F.count("*").alias("n"), F.avg("entity_count").alias("mean")]))


@query(
    "SELECT tab_row_id, greatest(coalesce(len(list_filter(tables, lambda x: NOT coalesce(x.recovered, false))), 0), coalesce(expected_table_count, 0) - "
    "coalesce(len(tables), 0), 0) AS missing FROM paper_tables"
)
def a36_expected_tables(t):
    unrec = F.coalesce(F.when(F.col("tables").isNotNull(), F.size(F.filter("tables", lambda x: ~F.coalesce(x["recovered"], F.lit(False))))), F.lit(0))
    n = F.when(F.col("tables").isNotNull(), F.size("tables")).otherwise(0)
    return t("paper_tables").select("tab_row_id", aggregates.expected_missing(F.coalesce("expected_table_count", F.lit(0)), n, unrec).cast("bigint").alias("missing"))


@query(
    "SELECT CASE WHEN n = 0 OR c < 0.9 OR v < 0.9 OR x > 0.05 THEN 'NO' ELSE 'YES' END AS ready, CASE WHEN n = 0 THEN 'empty' WHEN c < 0.9 THEN "
    "'incomplete' WHEN v < 0.9 THEN 'invalid_images' WHEN x > 0.05 THEN 'corrupted' ELSE '' END AS reason FROM (SELECT count(*) AS n, "
    "avg(is_complete_for_stage1) AS c, avg(has_ga) AS v, 1 - avg(has_metadata) AS x FROM stage1_ga_index)"
)
def a37_readiness(t):
    m = t("stage1_ga_index").agg(F.count("*").alias("n"), F.avg("is_complete_for_stage1").alias("c"), F.avg("has_ga").alias("v"), (1 - F.avg("has_metadata")).alias("x"))
    return aggregates.readiness(m, "n", "c", "v", "x")


@query("SELECT model, round(avg(coalesce(avg_visual_proxies_per_entity, 0)), 6) AS with_failed, round(avg(avg_visual_proxies_per_entity), 6) AS without FROM results GROUP BY 1")
def a38_zero_filled(t):
    c = "avg_visual_proxies_per_entity"
    return t("results").groupBy("model").agg(r6(F.avg(aggregates.zero_filled([c])[c]), "with_failed"), r6(F.avg(aggregates.zero_filled([c], True)[c]), "without"))


# ---------------------------------------------------------------- models


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) + avg(o_totalprice) OVER (), 2) AS adjusted FROM orders")
def m01_residualise(t):
    return models.residualise_one(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "adj").select("o_orderkey", F.round("adj", 2).alias("adjusted"))


@query()
def m01_residualise_many(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_mktsegment", "c_acctbal", "o_totalprice")
    return models.residualise(o, ["o_orderpriority", "c_mktsegment"], ["c_acctbal"], "o_totalprice", "adjusted").select("o_orderkey", F.round("adjusted", 3).alias("adjusted"))


@query(
    "WITH p AS (SELECT quantile_cont(p_retailprice, 0.05) AS a, quantile_cont(p_retailprice, 0.95) AS b, quantile_cont(CAST(p_size AS DOUBLE), 0.05) AS c, "
    "quantile_cont(CAST(p_size AS DOUBLE), 0.95) AS d FROM part) SELECT p_partkey, round(least(greatest((p_retailprice - a) / (b - a), 0), 1), 6) AS "
    "price, round(1 - least(greatest((p_size - c) / (d - c), 0), 1), 6) AS size, round((least(greatest((p_retailprice - a) / (b - a), 0), 1) + 1 - "
    "least(greatest((p_size - c) / (d - c), 0), 1)) / 2, 6) AS score FROM part, p"
)
def m02_composite(t):
    s = models.percentile_scale(t("part").withColumn("p_size", F.col("p_size").cast("double")), {"p_retailprice": False, "p_size": True})
    return s.select("p_partkey", r6(F.col("n_p_retailprice"), "price"), r6(F.col("n_p_size"), "size"), r6(values.row_mean(F.col("n_p_retailprice"), F.col("n_p_size")), "score"))


@query()
def m03_ridge(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    coef = models.ridge(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1.0)
    return li.select("l_orderkey", "l_linenumber", F.round(models.predict(coef, 0.0, 100_000.0), 3).alias("predicted"))


@query(
    "SELECT b.y AS y, b.n_name, b.n, round(b.m - a.m, 2) AS jump FROM (SELECT *, lag(y) OVER (PARTITION BY n_name ORDER BY y) AS py FROM (SELECT n_name, "
    "CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON "
    "c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) >= 20)) b JOIN (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, "
    "avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) >= "
    "20) a ON a.n_name = b.n_name AND a.y = b.py WHERE abs(b.m - a.m) >= 10000"
)
def m12_jumps(t):
    c, n = t("customer"), t("nation")
    o = t("orders").join(c, F.col("o_custkey") == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    y = o.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    return models.jumps(y, "n_name", "y", "m", "n", 20, 10_000.0).where("flag").select("y", "n_name", "n", F.round("jump", 2).alias("jump"))


@query(
    "SELECT n_name, y, n, CASE WHEN n < 30 THEN 'thin' END AS flag, round(m, 2) AS m FROM (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, "
    "count(*) AS n, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
)
def m13_thin_cells(t):
    c, n = t("customer"), t("nation")
    o = t("orders").join(c, F.col("o_custkey") == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return o.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("m")).select("n_name", "y", "n", F.when(F.col("n") < 30, "thin").alias("flag"), "m")


def _terms(spark: SparkSession, names: list[str], m: dict) -> DataFrame:
    """A mixed model's result as rows."""
    rows = [(n, *(float(m[c][i]) for c in ("beta", "se", "p"))) for i, n in enumerate(names)] + [(n, float(m[n]), 0.0, 1.0) for n in ("tau2", "sigma2", "aic")]
    return spark.createDataFrame(rows, "term string, estimate double, se double, p double")


def _trend(t) -> DataFrame:
    """Orders as the measured items of the models: a year, a domain, a group (customer), two controls and a measure."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), (F.year("o_orderdate") - 1995).cast("double").alias("y0"), F.col("c_mktsegment").alias("domain"), F.col("o_custkey").alias("g"), F.log1p(F.abs("c_acctbal")).alias("size"), ((F.col("o_orderkey") % 97) / 97).alias("sharpness"), (F.col("o_totalprice") / 1000).alias("y"))


@query()
def m07_random_intercept(t):
    d, levels = models.dummies(_trend(t), "domain")
    m = models.random_intercept(d, [F.lit(1.0), F.col("y0"), *levels.values(), F.col("size"), F.col("sharpness")], "y", "g")
    return _terms(d.sparkSession, ["intercept", "year", *map(str, levels), "size", "sharpness"], m)


@query()
def m07_spline(t):
    """A natural cubic spline of the year in place of the line; its AIC tells whether it is worth its parameters."""
    d, levels = models.dummies(_trend(t), "domain")
    basis = models.cubic_basis("y0", models.spline_knots(d, "y0"))
    m = models.random_intercept(d, [F.lit(1.0), *basis, *levels.values()], "y", "g")
    return _terms(d.sparkSession, ["intercept", *[f"spline_{i}" for i in range(len(basis))], *map(str, levels)], m)


@query()
def m07_domain_slopes(t):
    """A slope of the year for each domain, beside each domain's level."""
    d, levels = models.dummies(_trend(t), "domain", drop_first=False)
    m = models.random_intercept(d, [*levels.values(), *[c * F.col("y0") for c in levels.values()]], "y", "g")
    return _terms(d.sparkSession, [*map(str, levels), *[f"year:{v}" for v in levels]], m)


@query()
def m08_beta_regression(t):
    spark = t("region").sparkSession
    m = models.beta_regression(t("lineitem").select((F.col("l_quantity") / 50).alias("y"), (F.col("l_tax") * 10).alias("x")), [F.lit(1.0), F.col("x")], "y")
    return spark.createDataFrame([("intercept", float(m["beta"][0]), float(m["se"][0])), ("x", float(m["beta"][1]), float(m["se"][1])), ("phi", float(m["phi"]), 0.0), ("loglik", float(m["loglik"]), 0.0)], "term string, estimate double, se double")


@query()
def m10_completeness_model(t):
    """Completeness of a record (share of its sections) on its readability (words a summary, scaled) and its domain, with an intercept for each model that wrote it."""
    s = F.col("section_summaries")
    n = sum((aggregates.words(s[x]) for x in replies.SECTIONS), F.lit(0))
    domain = t("stage1_ga_index").groupBy(F.col("doi_normalized").alias("doi")).agg(F.min("domain").alias("domain"))
    d = t("srp").join(domain, "doi", "left").select((aggregates.present_count(*[s[x].isNotNull() for x in replies.SECTIONS]) / 4).alias("y"), F.log1p(n).alias("readability"), values.primary(F.col("domain"), missing="unknown", slug=True).alias("domain"), F.coalesce("model", F.lit("unknown")).alias("g"))
    d, levels = models.dummies(d, "domain", least=30)
    m = models.random_intercept(d, [F.lit(1.0), F.col("readability"), *levels.values()], "y", "g")
    return _terms(d.sparkSession, ["intercept", "readability", *map(str, levels)], m)


# ---------------------------------------------------------------- windows


@query("SELECT p_partkey, round(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0, 6) AS r FROM part")
def w01_average_rank(t):
    p = t("part").select("p_partkey", "p_brand", "p_size")
    return p.join(windows.average_ranks(p, ["p_brand"], "p_size", "r"), ["p_brand", "p_size"]).select("p_partkey", r6(F.col("r"), "r"))


_SEQ = "(SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE event_type END AS label, event_type = 'error' AS reset FROM events)"


def _sequence(t):
    return t("events").select("event_id", "user_id", F.when(~F.col("event_type").isin("view", "error"), F.col("event_type")).alias("label"), (F.col("event_type") == "error").alias("reset"))


@query(
    f"SELECT event_id, last_value(label IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT *, "
    f"sum(CAST(reset AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM {_SEQ})"
)
def w02_fill_forward(t):
    return windows.fill_forward(_sequence(t), "user_id", "event_id", "label", F.col("reset"), "filled").select("event_id", "filled")


@query(
    f"SELECT event_id, coalesce(label, CASE WHEN g > 0 AND l IN ('click', 'purchase') AND n <= 2 THEN l END) AS filled FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY user_id, g ORDER BY event_id) - 1 AS n, first_value(label) OVER (PARTITION BY user_id, g ORDER BY event_id) AS l FROM (SELECT *, "
    f"count(label) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM {_SEQ}))"
)
def w03_bounded_propagation(t):
    return windows.propagate_bounded(_sequence(t), "user_id", "event_id", "label", "filled", 2, ("click", "purchase")).select("event_id", "filled")


@query(
    "WITH x AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, CASE WHEN "
    "l_linenumber % 3 = 1 THEN CAST(l_linenumber % 2 + 1 AS VARCHAR) ELSE CAST(l_linenumber % 2 + 1 AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) "
    "END AS num, CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag END AS label FROM lineitem), p AS (SELECT doc, num, arg_max(label, pos) AS parent FROM x "
    "WHERE num NOT LIKE '%.%' AND label IS NOT NULL GROUP BY 1, 2) SELECT x.doc, x.pos, coalesce(x.label, CASE WHEN x.num LIKE '%.%' THEN p.parent END) AS "
    "inherited FROM x LEFT JOIN p ON x.doc = p.doc AND p.num = string_split(x.num, '.')[1]"
)
def w04_inherit_parent(t):
    ln = F.col("l_linenumber")
    head = (ln % 2 + 1).cast("string")
    x = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("pos"), F.when(ln % 3 == 1, head).otherwise(F.concat(head, F.lit("."), ln.cast("string"))).alias("num"), F.when(ln % 3 == 1, F.col("l_returnflag")).alias("label"))
    return windows.inherit_parent(x, "doc", "pos", "num", "label", "inherited").select("doc", F.col("pos").cast("bigint").alias("pos"), "inherited")


@query(
    f"SELECT event_id, coalesce(label, last_value(CASE WHEN label = 'signup' THEN 'results' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS carried FROM {_SEQ}"
)
def w05_carry_pending(t):
    s = _sequence(t).withColumn("b", F.when(F.col("label") == "signup", "results"))
    return windows.carry_pending(s, "user_id", "event_id", "b", "label", "carried").select("event_id", "carried")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place FROM events WHERE event_type <> 'error'")
def w07_reindex(t):
    return t("events").where("event_type <> 'error'").select("event_id", windows.reindex("user_id", "event_id").alias("place"))


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def w08_first_seen(t):
    return windows.first_seen(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query(
    "SELECT fig_row_id, CASE WHEN k = 1 THEN figure_id WHEN k <= 26 THEN figure_id || chr(CAST(k + 96 AS INTEGER)) ELSE figure_id || '_' || CAST(k AS "
    "VARCHAR) END AS asset FROM (SELECT fig_row_id, figure_id, row_number() OVER (PARTITION BY doi, figure_id ORDER BY fig_row_id) AS k FROM figures)"
)
def w09_suffixes(t):
    return t("figures").select("fig_row_id", windows.suffixed(["doi"], "figure_id", "fig_row_id").alias("asset"))


@query()
def w10_star_clusters(t):
    return duplicates.near_clusters(t("documents"), "doc_id", "text")


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5) WHERE k = 1"
)
def w11_best_in_range(t):
    return windows.best_in_range(t("lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", F.lit(2), F.lit(5))


@query(
    "SELECT tab_row_id, string_agg(t.caption, '; ' ORDER BY pos) AS captions FROM (SELECT tab_row_id, unnest(tables) AS t, unnest(range(len(tables))) AS "
    "pos FROM paper_tables) WHERE t.caption IS NOT NULL GROUP BY 1"
)
def w13_join_ordered(t):
    x = t("paper_tables").select("tab_row_id", F.posexplode("tables").alias("pos", "t")).select("tab_row_id", "pos", F.col("t.caption").alias("captions"))
    return windows.join_ordered(x, ["tab_row_id"], "pos", "captions", "; ")


# ---------------------------------------------------------------- sorting and sets


@query(
    "SELECT doi, fig_row_id, k FROM (SELECT doi, fig_row_id, CAST(row_number() OVER (PARTITION BY doi ORDER BY page NULLS FIRST, fig_row_id) AS INTEGER) "
    "AS k FROM figures WHERE doi IS NOT NULL) WHERE k <= 12"
)
def t02_top_per_group(t):
    f = t("figures").where("doi IS NOT NULL").select("doi", "page", "fig_row_id")
    top = aggregates.top_per_group(f, ["doi"], [F.col("page"), F.col("fig_row_id")], 12)
    return top.withColumn("k", F.row_number().over(Window.partitionBy("doi").orderBy("page", "fig_row_id"))).select("doi", "fig_row_id", "k")


@query("SELECT source, n FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) ORDER BY n DESC, source LIMIT 3")
def t03_top_sources(t):
    return t("documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3)


@query(
    "SELECT fig_row_id, arg_min(k, (-v, k)) AS section FROM (SELECT fig_row_id, unnest(map_keys(mentions_by_section)) AS k, "
    "unnest(map_values(mentions_by_section)) AS v FROM figures) GROUP BY 1"
)
def t04_dominant_section(t):
    return t("figures").where(F.size("mentions_by_section") > 0).select("fig_row_id", aggregates.dominant(F.col("mentions_by_section")).alias("section"))


@query("SELECT doi FROM figures WHERE doi IS NOT NULL EXCEPT SELECT doi FROM srp WHERE doi IS NOT NULL")
def u03_except(t):
    return t("figures").where("doi IS NOT NULL").select("doi").distinct().join(t("srp").select("doi"), "doi", "left_anti")


# ---------------------------------------------------------------- functions


@query()
def f01_clean_artifacts(t):
    return t("documents").select("doc_id", F.xxhash64(text.clean_artifacts(F.col("text"), True)).alias("h"), F.length(text.clean_artifacts(F.col("text"))).alias("n"))


@query(
    "SELECT fig_row_id, CASE WHEN w LIKE 'fig%' THEN 'figure' WHEN w LIKE 'tab%' THEN 'table' WHEN w LIKE 'sch%' THEN 'scheme' END AS kind, "
    "try_cast(nullif(n, '') AS INTEGER) AS number FROM (SELECT fig_row_id, lower(regexp_extract(label, "
    "'(?i)\\b(fig(?:ure|s)?|tab(?:le|les)?|sch(?:eme|emes)?)\\b\\s*\\.?\\s*([SAE]?)(\\.?)(\\d{1,3})([a-z]?)(?:[^0-9]|$)', 1)) AS w, regexp_extract(label, "
    "'(?i)\\b(fig(?:ure|s)?|tab(?:le|les)?|sch(?:eme|emes)?)\\b\\s*\\.?\\s*([SAE]?)(\\.?)(\\d{1,3})([a-z]?)(?:[^0-9]|$)', 4) AS n FROM figures)"
)
def f06_parse_labels(t):
    p = text.parse_label(F.col("label"))
    return t("figures").select("fig_row_id", p["kind"].alias("kind"), p["number"].alias("number"))


@query(
    "SELECT doc_id, CASE WHEN section IS NULL THEN '2.1' ELSE lower(section) END AS heading, CASE WHEN section IN ('introduction', 'methods', 'results', "
    "'discussion') THEN section END AS label, CASE WHEN section IN ('introduction', 'methods', 'results', 'discussion') THEN 'exact' ELSE 'none' END AS "
    "source FROM documents"
)
def f11_headings(t):
    h = F.initcap(F.concat_ws(" ", F.lit("2.1"), F.col("section")))
    c = text.classify_heading(h)
    return t("documents").select("doc_id", text.normal_heading(h).alias("heading"), c["label"].alias("label"), c["source"].alias("source"))


_CUE_SQL = " + ".join("len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))" for p in text.CONTENT_CUES["results"])


@query(f"SELECT doc_id, {_CUE_SQL} AS hits, round(({_CUE_SQL}) / greatest(1.0, length(text) / 1500.0), 6) AS score FROM documents WHERE text IS NOT NULL")
def f12_content_hits(t):
    hits = sum((F.regexp_count("text", F.lit(p)) for p in text.CONTENT_CUES["results"]), F.lit(0))
    return t("documents").where("text IS NOT NULL").select("doc_id", hits.cast("bigint").alias("hits"), r6(text.content_scores(F.col("text"))["results"], "score"))


@query(
    "SELECT doc_id, len(w) AS n, round(len(list_filter(w, lambda x: regexp_full_match(regexp_replace(x, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g'), "
    "'[A-Z]{2,}'))) / nullif(CAST(len(w) AS DOUBLE), 0), 6) AS acronym FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ "
    "\\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"
)
def f21_token_densities(t):
    d = text.token_densities(F.col("text"))
    return t("documents").where("text IS NOT NULL").select("doc_id", d["n"].cast("bigint").alias("n"), F.when(d["n"] > 0, r6(d["acronym"])).alias("acronym"))


@query(
    "WITH r AS (SELECT result_id, raw_output AS x, trim(regexp_replace(regexp_replace(raw_output, '(?is)<think>.*?</think>', '', 'g'), '(?i)```(?:json)?', "
    "'', 'g'), ' ') AS s FROM results WHERE raw_output IS NOT NULL), c AS (SELECT *, CASE WHEN contains(s, '{') AND contains(s, '}') AND length(s) - "
    "instr(reverse(s), '}') + 1 >= instr(s, '{') THEN substr(s, instr(s, '{'), length(s) - instr(reverse(s), '}') + 2 - instr(s, '{')) ELSE s END AS v "
    "FROM r) SELECT result_id, CASE WHEN trim(x, ' ') = '' THEN 'empty' WHEN json_valid(x) AND starts_with(trim(x, ' '), '{') THEN 'direct' WHEN "
    "json_valid(v) AND starts_with(v, '{') THEN 'salvaged' WHEN json_valid(regexp_replace(v, ',(\\s*[}\\]])', '\\1', 'g')) AND starts_with(v, '{') THEN "
    "'repaired' ELSE 'failed' END AS mode FROM c"
)
def f22_salvage(t):
    return t("results").where("raw_output IS NOT NULL").select("result_id", replies.parse_reply(F.col("raw_output"))["mode"].alias("mode"))


@query()
def f24_validate(t):
    p = t("results").where("raw_output IS NOT NULL").select("result_id", replies.profile(F.col("raw_output")).alias("p"))
    c = replies.profile_counts(F.col("p"))
    return p.select("result_id", replies.profile_error(F.col("p")).alias("error"), c["entities"].alias("entities"), c["proxies"].alias("proxies"), c["relations"].alias("relations"), c["ready"].alias("ready"))


@query(
    "SELECT sourceid, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(title)), '&', ' and '), '\\([^)]*\\)', ' ', "
    "'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\bthe\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM scimago_journals"
)
def f26_journal_keys(t):
    return t("scimago_journals").select("sourceid", text.journal_key(F.col("title")).alias("key"))


@query(
    "SELECT fig_row_id, concat_ws(';', CASE WHEN b IS NULL THEN 'no_box' END, CASE WHEN least(b.w, b.h) < 50 THEN 'small_side' END, CASE WHEN b.w * b.h < "
    "5000 THEN 'small_area' END, CASE WHEN greatest(b.w, b.h) / least(b.w, b.h) > 10 THEN 'extreme_aspect' END) AS reasons FROM (SELECT fig_row_id, "
    "bounding_box AS b FROM figures)"
)
def f32_suspect_figures(t):
    return t("figures").select("fig_row_id", F.array_join(geometry.suspect_reasons(F.col("bounding_box")), ";").alias("reasons"))


@query(
    "SELECT fig_row_id, CASE WHEN trim(coalesce(caption, '')) = '' THEN 'missing' WHEN regexp_matches(trim(caption), "
    "'(?i)^(?:fig(?:ure)?|table|scheme)\\.?\\s*\\d+[.:|–-]*$') THEN 'label_only' WHEN length(trim(caption)) < 25 THEN 'short' ELSE 'good' END AS quality "
    "FROM figures"
)
def f19_caption_quality(t):
    return t("figures").select("fig_row_id", text.caption_quality(F.col("caption")).alias("quality"))


@query(
    "SELECT min(k) AS fig_row_id, abs(round(max(e), 6)) AS entropy FROM (SELECT doi, page, z, k, -sum(p * log2(p)) OVER (PARTITION BY doi, page, z) / "
    "log2(9) AS e FROM (SELECT doi, page, z, c, min(k) AS k, count(*) / sum(count(*)) OVER (PARTITION BY doi, page, z) AS p FROM (SELECT doi, page, "
    "extraction_timestamp AS z, fig_row_id AS k, least(greatest(floor((bounding_box.y + bounding_box.h / 2) / 1000 * 3), 0), 2) * 3 + "
    "least(greatest(floor((bounding_box.x + bounding_box.w / 2) / 1000 * 3), 0), 2) AS c FROM figures WHERE doi IS NOT NULL AND page IS NOT NULL AND "
    "bounding_box IS NOT NULL) GROUP BY 1, 2, 3, 4)) GROUP BY doi, page, z"
)
def f27_layout_entropy(t):
    g = t("figures").where("doi IS NOT NULL AND page IS NOT NULL AND bounding_box IS NOT NULL").groupBy("doi", "page", "extraction_timestamp").agg(F.collect_list("bounding_box").alias("b"), F.min("fig_row_id").alias("fig_row_id"))
    return g.select("fig_row_id", F.abs(r6(geometry.cells_entropy(F.col("b"), F.lit(1000.0), F.lit(1000.0)))).alias("entropy"))


@query(
    "WITH m AS (SELECT avg(publication_year) AS m, stddev_pop(publication_year) AS s FROM stage1_ga_index) SELECT row_id, round(coalesce((publication_year "
    "- m) / s, 0), 6) AS z, CAST(publication_year IS NULL AS INTEGER) AS missing FROM stage1_ga_index, m"
)
def f45_zscore(t):
    x = t("stage1_ga_index").select("row_id", "publication_year")
    m = x.agg(F.avg("publication_year").alias("m"), F.stddev_pop("publication_year").alias("s"))
    return x.crossJoin(F.broadcast(m)).select("row_id", r6(F.coalesce((F.col("publication_year") - F.col("m")) / F.col("s"), F.lit(0.0)), "z"), F.col("publication_year").isNull().cast("int").alias("missing"))


# ---------------------------------------------------------------- queues and streams

_STATE = "CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END"


def _state():
    s = F.lit("pending")
    for k, v in queue.STATES.items():
        s = F.when(F.col("event_type") == k, v).otherwise(s)
    return s


@query("SELECT DISTINCT doi FROM srp WHERE doi IS NOT NULL AND doi NOT IN (SELECT doi FROM results WHERE doi IS NOT NULL)")
def q01_enqueue(t):
    return queue.enqueue(t("srp").where("doi IS NOT NULL").select("doi"), t("results"), "doi").select("doi")


@query(f"SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS state FROM events GROUP BY 1")
def q03_latest_state(t):
    return queue.latest_state(t("events"), "user_id", "ts", _state(), "event_id").select("user_id", "state")


@query(
    f"WITH l AS (SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY 1) SELECT user_id, CASE WHEN state = "
    f"'in_progress' AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 15 MINUTE THEN 'pending' ELSE state END AS state, state = 'in_progress' AND ts < "
    f"TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 15 MINUTE AS stalled FROM l"
)
def q04_recover(t):
    now = F.to_timestamp(F.lit("2024-01-30 12:00:00")).cast("timestamp")
    return queue.recover(queue.latest_state(t("events"), "user_id", "ts", _state(), "event_id"), now).select("user_id", "state", "stalled")


@query("SELECT srp_id FROM srp WHERE srp_id NOT IN (SELECT result_id FROM results WHERE status = 'success')")
def q07_resume(t):
    return queue.resume(t("srp").select("srp_id"), t("results").where("status = 'success'").select(F.col("result_id").alias("srp_id")), "srp_id")


@query(f"SELECT state, count(*) AS n FROM (SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS state FROM events GROUP BY 1) GROUP BY 1")
def a33_queue_status(t):
    return queue.queue_status(queue.latest_state(t("events"), "user_id", "ts", _state(), "event_id"))


@query(
    "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) "
    "AS total FROM events GROUP BY 1, 2"
)
def ev_tumbling(t):
    w = queue.windowed(t("events"), "ts", ["event_type"], "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM "
    "events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, "
    "strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def ev_sessions(t):
    s = queue.sessions(t("events"), "ts", "user_id", "30 minutes")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# ---------------------------------------------------------------- further families


@query("SELECT row_id FROM stage1_ga_index WHERE has_ga = 1 AND has_pdf = 1 AND doi_normalized IS NOT NULL")
def prj08_valid_rows(t):
    x = t("stage1_ga_index")
    return x.where(values.flag(F.col("has_ga")) & values.flag(F.col("has_pdf")) & F.col("doi_normalized").isNotNull()).select("row_id")


@query("SELECT result_id, CAST(format('{:.2f}', avg_visual_proxies_per_entity) AS DOUBLE) AS rounded FROM results")
def prj13_report_rounding(t):
    return t("results").select("result_id", values.py_round(F.col("avg_visual_proxies_per_entity"), 2).alias("rounded"))


@query(
    "SELECT coalesce(a.doi, b.doi) AS doi, CASE WHEN b.doi IS NULL THEN 'no_result' ELSE 'no_profile' END AS missing FROM (SELECT DISTINCT doi FROM srp "
    "WHERE doi IS NOT NULL) a FULL JOIN (SELECT DISTINCT doi FROM results WHERE doi IS NOT NULL) b ON a.doi = b.doi WHERE a.doi IS NULL OR b.doi IS NULL"
)
def j14_missing_on_either_side(t):
    a = t("srp").where("doi IS NOT NULL").select("doi").distinct()
    b = t("results").where("doi IS NOT NULL").select("doi").distinct()
    return a.join(b, "doi", "left_anti").select("doi", F.lit("no_result").alias("missing")).unionByName(b.join(a, "doi", "left_anti").select("doi", F.lit("no_profile").alias("missing")))


@query(
    "SELECT srp_id, CAST(section_summaries.introduction IS NOT NULL AS INTEGER) + CAST(section_summaries.methods IS NOT NULL AS INTEGER) + "
    "CAST(section_summaries.results IS NOT NULL AS INTEGER) + CAST(section_summaries.discussion IS NOT NULL AS INTEGER) AS level FROM srp"
)
def a03_present_count(t):
    s = F.col("section_summaries")
    return t("srp").select("srp_id", aggregates.present_count(*[s[x].isNotNull() for x in replies.SECTIONS]).alias("level"))


@query(
    f"SELECT section, round(avg(cov), 6) AS mean_coverage, round(100.0 * sum(e) / greatest(sum(e + i + a), 1), 6) AS explicit_pct, round(100.0 * sum(i) / "
    f"greatest(sum(e + i + a), 1), 6) AS implied_pct, count(*) AS n FROM (SELECT doc, section, avg(CASE verdict WHEN 'explicit' THEN 1.0 WHEN 'implied' "
    f"THEN 0.5 ELSE 0.0 END) AS cov, count(*) FILTER (verdict = 'explicit') AS e, count(*) FILTER (verdict = 'implied') AS i, count(*) FILTER (verdict = "
    f"'absent') AS a FROM (SELECT l_orderkey AS doc, l_linenumber % 4 AS section, {_VERDICT} AS verdict FROM lineitem) GROUP BY 1, 2) GROUP BY section"
)
def a05_coverage_breakdown(t):
    c = aggregates.section_coverage(_entities(t), ["doc", "section"], "verdict")
    total = F.greatest(F.sum(F.col("n_explicit") + F.col("n_implied") + F.col("n_absent")), F.lit(1))
    return c.groupBy("section").agg(r6(F.avg("coverage"), "mean_coverage"), r6(100.0 * F.sum("n_explicit") / total, "explicit_pct"), r6(100.0 * F.sum("n_implied") / total, "implied_pct"), F.count("*").alias("n"))


@query(
    "SELECT n_name, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = "
    "n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
)
def a08_largest_domains(t):
    c, n = t("customer"), t("nation")
    o = t("orders").join(c, F.col("o_custkey") == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return o.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")).orderBy(F.desc("n"), "n_name").limit(10)


@query(
    "SELECT coalesce(nullif(trim(source, ' '), ''), 'unknown') AS source, count(*) AS n, round(avg(bounding_box.w), 6) AS width, "
    "round(avg(bounding_box.h), 6) AS height, round(avg(CASE WHEN extraction_quality = 'good' THEN 100.0 ELSE 0 END), 6) AS good_pct FROM figures GROUP BY "
    "1"
)
def a12_visual_summary(t):
    b = F.col("bounding_box")
    return t("figures").groupBy(aggregates.group_key(F.col("source"), "unknown").alias("source")).agg(F.count("*").alias("n"), r6(F.avg(b["w"]), "width"), r6(F.avg(b["h"]), "height"), r6(F.avg(F.when(F.col("extraction_quality") == "good", 100.0).otherwise(0.0)), "good_pct"))


@query(
    "WITH p AS (SELECT quantile_cont(o_totalprice, 0.3333) AS a, quantile_cont(o_totalprice, 0.6667) AS b FROM orders) SELECT CAST(year(o_orderdate) AS "
    "INTEGER) AS y, count(*) AS n, round(100 * avg(CAST(o_totalprice < a AS INTEGER)), 6) AS low_pct, round(100 * avg(CAST(o_totalprice >= b AS INTEGER)), "
    "6) AS high_pct FROM orders, p GROUP BY 1"
)
def a19_yearly_bands(t):
    o = t("orders")
    p = aggregates.percentiles(o, ["o_totalprice"], [0.3333, 0.6667]).withColumnRenamed("o_totalprice", "q")
    x = o.crossJoin(F.broadcast(p))
    return x.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), r6(100 * F.avg((F.col("o_totalprice") < F.col("q")[0]).cast("int")), "low_pct"), r6(100 * F.avg((F.col("o_totalprice") >= F.col("q")[1]).cast("int")), "high_pct"))


@query()
def m04_simplex_weights(t):
    p = t("part").select((F.col("p_retailprice") / 2000).alias("a"), (F.col("p_size") / 50).alias("b"), ((F.col("p_partkey") % 97) / 97).alias("c"), (F.col("p_retailprice") + 5 * F.col("p_size")).alias("t")).where("p_partkey IS NOT NULL")
    return models.rank_correlation_grid(p, ["a", "b", "c"], "t")


@query('SELECT count(input_tokens) AS input_tokens, count(output_tokens) AS output_tokens, count(inference_time) AS inference_time, count(entity_count) AS entity_count, count(total_visual_proxies) AS total_visual_proxies FROM results')
def m05_screened(t):
    r = t("results")
    kept = models.screen(r, ["input_tokens", "output_tokens", "inference_time", "entity_count", "total_visual_proxies"])
    return r.agg(*[F.count(c).alias(c) for c in kept])


@query()
def m09_robustness(t):
    d = _trend(t)
    flagged = d.groupBy("g").agg((F.max("y") - F.min("y")).alias("w")).where("w > 400").select("g")
    return d.sparkSession.createDataFrame(models.robustness(d, "o_orderkey", "year", "y", "g", "domain", ["size", "sharpness"], flagged, 1999), "check string, measure string, value double")


@query()
def m03_nested_ridge(t):
    r = models.nested_ridge(t("lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")), "k", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    spark = t("region").sparkSession
    return spark.createDataFrame([*[(f"lambda_{i}", float(v)) for i, v in enumerate(r["lambdas"])], ("r2", float(r["r2"])), ("spearman", r["spearman"]), ("spearman_sd", r["sd"]), ("n", float(r["n"]))], "measure string, value double")


@query()
def m11_ablation(t):
    li = t("lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    got = models.ablation(li, "k", {"quantity": ["l_quantity"], "rates": ["l_discount", "l_tax"], "all": ["l_quantity", "l_discount", "l_tax"]}, "l_extendedprice", {"mean_of_parts": (F.col("l_quantity") / 50 + F.col("l_discount") * 10 + F.col("l_tax") * 10) / 3, "quantity": F.col("l_quantity")})
    return li.sparkSession.createDataFrame(got, "kind string, name string, n_features int, spearman double, sd double")


@query(
    "WITH c AS (SELECT n_name, CAST(year(o_orderdate) AS DOUBLE) AS y, count(*) AS n, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = "
    "c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) >= 20) SELECT n_name, CAST(sum(n) AS BIGINT) AS n, count(*) AS "
    "years, round(regr_slope(m, y), 2) AS slope FROM c GROUP BY 1 HAVING sum(n) >= 100 AND count(*) >= 3"
)
def m14_trend_table(t):
    c, n = t("customer"), t("nation")
    o = t("orders").join(c, F.col("o_custkey") == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("n_name", F.year("o_orderdate").cast("double").alias("y"), "o_totalprice")
    return models.trend_table(o, "n_name", "y", "o_totalprice").select("n_name", "n", "years", F.round("slope", 2).alias("slope"))


@query(
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders WHERE year(o_orderdate) BETWEEN 1996 "
    "AND 2000 GROUP BY 1 HAVING count(*) >= 100"
)
def m15_global_trend(t):
    return models.global_trend(t("orders").select(F.year("o_orderdate").alias("y"), "o_totalprice"), "y", "o_totalprice", 1996, 2000).select("y", "n", F.round("mean", 2).alias("mean"))


@query(
    "SELECT doi, figure_id, CAST(row_number() OVER (PARTITION BY doi ORDER BY CASE WHEN label ILIKE 'tab%' THEN 1 WHEN label ILIKE 'sch%' THEN 2 ELSE 0 "
    "END, try_cast(regexp_extract(label, '(\\d+)', 1) AS INTEGER) NULLS FIRST, fig_row_id) AS INTEGER) AS place, fig_row_id FROM figures WHERE doi IS NOT "
    "NULL"
)
def t01_natural_order(t):
    lab = F.lower(F.coalesce("label", F.lit("")))
    kind = F.when(lab.startswith("tab"), 1).when(lab.startswith("sch"), 2).otherwise(0)
    num = F.regexp_extract("label", r"(\d+)", 1).try_cast("int")
    return t("figures").where("doi IS NOT NULL").select("doi", "figure_id", F.row_number().over(Window.partitionBy("doi").orderBy(kind, num, "fig_row_id")).alias("place"), "fig_row_id")


@query("SELECT doi FROM srp WHERE doi IS NOT NULL UNION SELECT doi FROM results WHERE doi IS NOT NULL")
def u01_union(t):
    return t("srp").select("doi").unionByName(t("results").select("doi")).where("doi IS NOT NULL").distinct()


@query(
    "SELECT tab_row_id, CAST(len(list_distinct(list_concat(coalesce(list_transform(tables, lambda x: x.section), []), coalesce(list_transform(tables, "
    "lambda x: x.source), [])))) AS INTEGER) AS n FROM paper_tables"
)
def u04_distinct_merge(t):
    names = lambda f: F.coalesce(F.transform("tables", lambda x: x[f]), F.array().cast("array<string>"))
    return t("paper_tables").select("tab_row_id", F.size(F.array_compact(F.array_union(names("section"), names("source")))).alias("n"))


@query()
def f02_glyphs(t):
    return t("documents").select("doc_id", F.size(text.private_use(F.coalesce("text", F.lit("")))).alias("unmapped"), F.length(text.nfkc(F.col("text"))).alias("n"))


@query(
    "SELECT doc_id, coalesce(len(regexp_extract_all(text, '(?i)\\b(?:fig(?:ure|s)?|tab(?:le|les)?|sch(?:eme|emes)?)\\b\\s*\\.?\\s*\\d{1,3}')), 0) AS n "
    "FROM documents WHERE text IS NOT NULL"
)
def f07_anchors(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.size(text.anchors(F.col("text"))).cast("bigint").alias("n"))


@query(
    "SELECT tab_row_id, pos, len(list_filter(regexp_split_to_array(x, '\\r?\\n'), lambda l: trim(l, ' ') <> '')) AS rows FROM (SELECT tab_row_id, "
    "unnest(tables).text AS x, unnest(range(len(tables))) AS pos FROM paper_tables) WHERE x IS NOT NULL AND trim(x, ' ') <> ''"
)
def f18_table_rows(t):
    x = t("paper_tables").select("tab_row_id", F.posexplode("tables").alias("pos", "t")).where("t.text IS NOT NULL AND trim(t.text) <> ''")
    return x.select("tab_row_id", F.col("pos").cast("bigint").alias("pos"), text.table_stats(F.col("t.text"))["rows"].cast("bigint").alias("rows"))


@query()
def f13_label_sections(t):
    d = t("documents").where("doi IS NOT NULL AND text IS NOT NULL").select("doi", "doc_id", F.when(F.col("doc_id") % 3 > 0, F.initcap("section")).alias("heading"), "text")
    return labelling.label_sections(d, "doi", "doc_id", "heading", "text").select("doc_id", "role", "role_source", "role_confidence")


@query()
def f13_label_report(t):
    d = t("documents").where("doi IS NOT NULL AND text IS NOT NULL").select("doi", "doc_id", F.initcap("section").alias("heading"), "text")
    return labelling.label_report(labelling.label_sections(d, "doi", "doc_id", "heading", "text"), "doi")


@query(
    "WITH p AS (SELECT srp_id, title, section_summaries.methods AS m, concat_ws(chr(10) || chr(10), CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN '# "
    "title' || chr(10) || title END, CASE WHEN trim(coalesce(section_summaries.introduction, ''), ' ') <> '' THEN '# introduction' || chr(10) || "
    "section_summaries.introduction END, CASE WHEN trim(coalesce(section_summaries.methods, ''), ' ') <> '' THEN '# methods' || chr(10) || "
    "section_summaries.methods END, CASE WHEN trim(coalesce(section_summaries.results, ''), ' ') <> '' THEN '# results' || chr(10) || "
    "section_summaries.results END, CASE WHEN trim(coalesce(section_summaries.discussion, ''), ' ') <> '' THEN '# discussion' || chr(10) || "
    "section_summaries.discussion END) AS b FROM srp) SELECT srp_id, CAST(CASE WHEN length(b) > 400 THEN 412 ELSE length(b) END AS INTEGER) AS n, "
    "length(b) > 400 AS cut, CASE WHEN trim(coalesce(title, ''), ' ') = '' THEN 'title is missing' WHEN trim(coalesce(m, ''), ' ') = '' THEN 'methods is "
    "missing' END AS error FROM p"
)
def f15_prompts(t):
    s = F.col("section_summaries")
    p = labelling.assemble_prompt({"title": F.col("title"), **{x: s[x] for x in replies.SECTIONS}}, 400, ("title", "methods"))
    return t("srp").select("srp_id", F.length(p["prompt"]).alias("n"), p["prompt"].endswith("[TRUNCATED]").alias("cut"), p["error"].alias("error"))


@query()
def f16_capture_tables(t):
    x = t("paper_tables").select(F.col("tab_row_id").alias("doc"), F.posexplode("tables").alias("page", "t")).select("doc", "page", F.concat_ws("\n", F.lit("Running text stands above the table and ends here."), F.concat(F.lit("Table "), F.col("page") + 1, F.lit(". "), F.col("t.caption")), F.col("t.text")).alias("body"))
    return labelling.capture_tables(x, "doc", "page", "body")


@query(
    "SELECT fig_row_id, CASE WHEN length(caption) <= 200 THEN caption WHEN regexp_extract(substr(caption, 1, 300), '(?s)^(.*[.!?])(?:\\s|$)', 1) <> '' "
    "THEN regexp_extract(substr(caption, 1, 300), '(?s)^(.*[.!?])(?:\\s|$)', 1) ELSE substr(caption, 1, 300) END AS kept FROM figures WHERE caption IS NOT "
    "NULL"
)
def f35_trim_captions(t):
    return t("figures").where("caption IS NOT NULL").select("fig_row_id", text.trim_caption(F.col("caption"), 200, 300).alias("kept"))


@query(
    "SELECT result_id, CASE WHEN replace(lower(trim(status, ' ')), ' ', '_') IN ('success', 'api_error', 'schema_error') THEN replace(lower(trim(status, ' "
    "')), ' ', '_') WHEN status = 'json_parse_error' THEN 'schema_error' END AS kind, CAST(least(greatest(entity_count, 1), 5) AS INTEGER) AS score FROM "
    "results WHERE entity_count IS NOT NULL"
)
def f23_coercion(t):
    r = t("results").where("entity_count IS NOT NULL")
    return r.select("result_id", replies.enum_value(F.col("status"), ["success", "api_error", "schema_error"], {"json_parse_error": "schema_error"}).alias("kind"), replies.score_value(F.col("entity_count"), 1, 5).alias("score"))


@query("SELECT fig_row_id, round((least(bounding_box.w * bounding_box.h / 200000, 1) + least(page / 10.0, 1)) / 2, 3) AS clutter FROM figures")
def f29_clutter(t):
    b = F.col("bounding_box")
    return t("figures").select("fig_row_id", F.round(geometry.clutter(geometry.area(b) / 200000, F.col("page") / 10.0), 3).alias("clutter"))


@query(
    "SELECT fig_row_id, CASE WHEN lower(coalesce(label, '')) LIKE 'scheme%' THEN 'scheme' WHEN lower(coalesce(label, '')) LIKE 'tab%' THEN 'table' WHEN "
    "lower(coalesce(label, '')) LIKE 'fig%' THEN 'figure' ELSE coalesce(lower(type), 'figure') END AS kind FROM figures"
)
def f33_asset_kind(t):
    return t("figures").select("fig_row_id", values.asset_kind(F.col("label"), F.col("type")).alias("kind"))


@query()
def f40_markdown_tables(t):
    x = t("paper_tables").select("tab_row_id", F.posexplode("tables").alias("pos", "t")).where("t.text IS NOT NULL AND trim(t.text) <> ''")
    return x.select("tab_row_id", "pos", F.length(text.markdown_table(F.col("t.text"))).alias("n"))


@query("SELECT fig_row_id FROM figures WHERE assigned_section IN ('introduction', 'methods', 'results', 'discussion') AND coalesce(extraction_quality, '') <> 'bad'")
def f44_main_evidence(t):
    return t("figures").where(labelling.main_evidence(F.coalesce("label", F.lit("")), F.col("assigned_section"), F.col("extraction_quality"))).select("fig_row_id")


@query(
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'skipped' WHEN length(title) % 7 = 0 THEN "
    "'empty_response_error' ELSE 'success' END AS status FROM srp) GROUP BY 1"
)
def x01_score_rows(t):
    return labelling.score_rows(t("srp").select("srp_id", "title"), "srp_id", "title", lambda ps: [None if len(p) % 7 == 0 else '{"title": "' + p[:20] + '"}' for p in ps]).groupBy("status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- files there and back


@query("SELECT sourceid, title, publisher, type FROM scimago_journals")
def src02_csv_there_and_back(t):
    d = t("scimago_journals")
    path = scratch(d.sparkSession)
    writers.write_csv(d, path, ["sourceid", "title", "publisher", "type"])
    return readers.read_csv(d.sparkSession, path, "sourceid string, title string, publisher string, type string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def src03_sniffed_delimiter(t):
    d = t("nation").select("n_nationkey", "n_name")
    path = scratch(d.sparkSession)
    d.coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    return readers.read_sniffed(d.sparkSession, path)


@query("SELECT count(*) AS n, count(doi) AS with_doi, count(*) FILTER (section_summaries IS NOT NULL) AS with_summaries FROM srp")
def src04_json_there_and_back(t):
    d = t("srp").select("doi", "title", "section_summaries", "key_entities", "causal_relations")
    path = scratch(d.sparkSession)
    writers.write_jsonl(d, path)
    p = d.sparkSession.read.text(path).select(replies.profile(F.col("value")).alias("p"))
    return p.agg(F.count("*").alias("n"), F.count("p.doi").alias("with_doi"), F.count_if(F.col("p.section_summaries").isNotNull()).alias("with_summaries"))


@query(
    "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, NULL AS extra FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, "
    "CAST(n_regionkey AS VARCHAR) FROM nation"
)
def src08_union_of_sheets(t):
    a = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    b = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("extra"))
    return readers.union_sheets([a, b])


@query("SELECT DISTINCT doi AS id FROM srp WHERE doi IS NOT NULL")
def src14_id_file(t):
    d = t("srp").where("doi IS NOT NULL").select(F.concat(F.lit(" "), "doi").alias("value"))
    path = scratch(d.sparkSession)
    d.write.text(path)
    return readers.read_ids(d.sparkSession, path)


@query(f"SELECT user_id, arg_max({_STATE}, (ts, {_STATE})) AS state FROM events GROUP BY 1")
def q03_upsert_in_batches(t):
    e = t("events").select("user_id", _state().alias("state"), "ts")
    return queue.upsert(queue.upsert(e.where("state = 'pending'"), e.where("state <> 'pending'"), "user_id"), e, "user_id").select("user_id", "state")


@query(
    f"SELECT user_id FROM (SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY 1) WHERE state = 'in_progress' "
    f"AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 15 MINUTE"
)
def q06_stalled(t):
    now = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    return queue.stalled(queue.latest_state(t("events"), "user_id", "ts", _state(), "event_id"), now).select("user_id")
