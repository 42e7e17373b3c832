"""Queries of the text, table, figure, reply and scoring operators on the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folia.functions import captions, coercion, geometry, tables, text, values
from folia.operators import aggregates, agreement, duplicates, equations, figures, joins, labelling, models, scoring
from folia.plans.reference_queries import _RATERS, _raters, query, r6
from folia.runtime import scratch
from folia.sources import readers, writers


# ---------------------------------------------------------------- equations

_EQ_SQL = "concat('y = ', CAST(p_size AS VARCHAR), ' x + ', CAST(p_partkey AS VARCHAR), ' (', CAST(p_partkey % 99 AS VARCHAR), ')')"


def _formulas(t):
    """Formulas of documents of ten parts each: some hold two, some are broken in two, some are prose."""
    p, n = t("part"), F.col("p_partkey")
    line = F.concat(F.lit("y = "), F.col("p_size"), F.lit(" x + "), n, F.lit(" ("), n % 99, F.lit(")"))
    kind = F.when(n % 10 == 3, F.concat(line, F.lit(" z = a × b ("), n % 99 + 100, F.lit(")"))).when(n % 10 == 4, F.concat(F.lit("f(x) = (a + "), n)).when(n % 10 == 5, ")").when(n % 10 == 6, F.concat(F.lit("The mean rate of the samples is shown in Table "), n % 9)).otherwise(line)
    return p.select(F.floor(n / 10).alias("doc"), n.alias("pos"), kind.alias("raw"), F.lit("methods").alias("section"))


@query(
    "WITH f AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc, p_partkey AS n, p_partkey % 10 AS k, p_partkey % 99 AS m, p_size FROM part) SELECT "
    "doc, CAST(count(*) FILTER (k NOT IN (5, 6)) + count(*) FILTER (k = 3) AS BIGINT) AS n_equations, CAST(count(*) FILTER (k = 3) * 2 AS BIGINT) + "
    "CAST(coalesce(sum(CASE WHEN k = 4 AND nx IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_repaired FROM (SELECT *, lead(k) OVER (PARTITION BY doc "
    "ORDER BY n) AS nx FROM f) GROUP BY doc HAVING count(*) FILTER (k NOT IN (5, 6)) > 0"
)
def f05_equations(t):
    e = equations.extract_equations(_formulas(t), "doc", "pos", "raw", "section")
    return e.groupBy("doc").agg(F.count("*").alias("n_equations"), F.count_if(F.col("confidence") == "repaired").alias("n_repaired"))


@query(
    f"SELECT p_partkey, CAST(p_partkey % 99 AS INTEGER) AS number, concat('y = ', CAST(p_size AS VARCHAR), ' x + ', CAST(p_partkey AS VARCHAR), ' (', "
    f"CAST(p_partkey % 99 AS VARCHAR), ')') AS clean, false AS rejected FROM part"
)
def f04_equation_parts(t):
    n = F.col("p_partkey")
    line = F.concat(F.lit(" y=  "), F.col("p_size"), F.lit(" x+"), n, F.lit(" ("), n % 99, F.lit(") "))
    return t("part").select("p_partkey", equations.printed_number(line).alias("number"), equations.clean_equation(line).alias("clean"), equations.rejections(line)["rejected"].alias("rejected"))


@query(
    "SELECT p_partkey, concat('[Equation ', CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN ', low-confidence' ELSE '' END, ': ', CASE WHEN "
    "p_size % 2 = 0 THEN 'formula not recovered' ELSE concat('a = ', CAST(p_size AS VARCHAR)) END, ']') AS block FROM part"
)
def f03_equation_blocks(t):
    f = F.when(F.col("p_size") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("a="), F.col("p_size")))
    return t("part").select("p_partkey", equations.equation_block(F.col("p_partkey"), f).alias("block"))


# ---------------------------------------------------------------- captions and mentions


@query(
    "SELECT srp_id, 3 AS n, 'fig_01,table_02,fig_S3' AS ids, length('Fig. 1. ') + length(trim(title, ' ')) AS n_first FROM srp WHERE title IS NOT NULL AND "
    "regexp_full_match(title, '[A-Za-z0-9 -]*[A-Za-z]') AND NOT regexp_matches(title, '(?i)\\b(fig|tab|sch|suppl|online|appendix|extended)')"
)
def f07_merged_captions(t):
    s = t("srp").where(F.col("title").rlike(r"^[A-Za-z0-9 -]*[A-Za-z]$") & ~F.col("title").rlike(r"(?i)\b(fig|tab|sch|suppl|online|appendix|extended)"))
    merged = F.concat(F.lit("Page head. Fig. 1. short. Table 2 Values; Figure S3: Rest. Fig. 1. "), F.trim("title"), F.lit("."))
    x = captions.split_merged(merged)
    return s.select("srp_id", F.size(x).alias("n"), F.array_join(F.transform(x, lambda r: r["id"]), ",").alias("ids"), F.greatest(F.length(x[0]["caption"]), F.lit(0)).cast("bigint").alias("n_first"))


@query("SELECT fig_row_id, CASE WHEN k = 0 THEN '1,2,3' WHEN k = 1 THEN '2,5' ELSE '4' END AS numbers FROM (SELECT fig_row_id, fig_row_id % 3 AS k FROM figures)")
def f08_mention_numbers(t):
    k = F.col("fig_row_id") % 3
    said = F.when(k == 0, "As Figs. 1-3 show, the load rose.").when(k == 1, "See Figures 2 and 5; Table 9 has the rest.").otherwise("Fig. 4b agrees.")
    return t("figures").select("fig_row_id", F.array_join(F.transform(text.mention_numbers(said), lambda x: x.cast("string")), ",").alias("numbers"))


_SECTION_PAGES = "(SELECT DISTINCT doi, s, p FROM (SELECT doi, 'introduction' AS s, 1 AS p FROM figures UNION ALL SELECT doi, 'methods', 3 FROM figures UNION ALL SELECT doi, 'results', 6 FROM figures) WHERE doi IS NOT NULL AND length(doi) % 3 > 0)"


@query(
    "WITH f AS (SELECT fig_row_id, doi, page, m.s AS m FROM figures LEFT JOIN (SELECT fig_row_id AS i, arg_min(k, (-v, k)) AS s FROM (SELECT fig_row_id, unnest(map_keys(mentions_by_section)) AS k, unnest(map_values(mentions_by_section)) AS v FROM figures) GROUP BY 1) m ON fig_row_id = m.i), "
    f"st AS (SELECT doi, p, max(s) AS s FROM {_SECTION_PAGES} GROUP BY doi, p), r AS (SELECT * FROM f WHERE m IS NULL AND page IS NOT NULL AND doi IS NOT NULL), a AS (SELECT r.fig_row_id, r.doi, r.page, st.s FROM r ASOF LEFT JOIN st ON r.doi = st.doi AND r.page >= st.p), "
    "n AS (SELECT doi, page AS p, min(m) AS m FROM f WHERE m IN ('introduction', 'methods', 'results', 'discussion') AND page IS NOT NULL AND doi IS NOT NULL GROUP BY 1, 2), q AS (SELECT fig_row_id, doi, page FROM a WHERE s IS NULL), b AS (SELECT q.*, n.p, n.m FROM q ASOF LEFT JOIN n ON q.doi = n.doi AND q.page >= n.p), e AS (SELECT q.fig_row_id, n.p, n.m FROM q ASOF LEFT JOIN n ON q.doi = n.doi AND q.page <= n.p) "
    "SELECT fig_row_id, m AS section, 'mention' AS method FROM f WHERE m IS NOT NULL UNION ALL SELECT fig_row_id, s, 'section_page' FROM a WHERE s IS NOT NULL UNION ALL SELECT fig_row_id, x, CASE WHEN x IS NULL THEN 'unassigned' ELSE 'figure_page' END FROM (SELECT b.fig_row_id, CASE WHEN b.p IS NULL THEN e.m WHEN e.p IS NULL THEN b.m WHEN e.p - b.page <= b.page - b.p THEN e.m ELSE b.m END AS x FROM b JOIN e ON b.fig_row_id = e.fig_row_id) UNION ALL SELECT fig_row_id, NULL, 'unassigned' FROM f WHERE m IS NULL AND (page IS NULL OR doi IS NULL)"
)
def f09_figure_sections(t):
    """All tiers: mentions, the page of labelled sections (given for two thirds of the papers), the nearest figure placed by mentions."""
    f = t("figures")
    of = f.where(F.col("doi").isNotNull() & (F.length("doi") % 3 > 0)).select("doi").distinct()
    starts = of.select("doi", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("page"), F.lit(i).alias("order")) for i, (r, p) in enumerate([("introduction", 1), ("methods", 3), ("results", 6)])])).alias("x")).select("doi", "x.*")
    return figures.map_to_sections(f, "doi", "fig_row_id", "page", "mentions_by_section", starts).select("fig_row_id", "section", "method")


@query(
    "WITH d AS (SELECT doi, coalesce(section, 'none') AS s, text FROM documents WHERE doi IS NOT NULL), f AS (SELECT doi, fig_row_id, 1 + fig_row_id % 4 "
    "AS n FROM figures WHERE doi IS NOT NULL), c AS (SELECT doi, s, n, count(*) AS c FROM (SELECT doi, s, unnest([1, 2, 3]) AS n FROM d UNION ALL SELECT "
    "doi, s, 4 FROM d WHERE s = 'results') GROUP BY 1, 2, 3) SELECT fig_row_id, CAST(count(*) AS INTEGER) AS n_sections, CAST(sum(c) AS BIGINT) AS "
    "n_mentions FROM f JOIN c ON f.doi = c.doi AND f.n = c.n GROUP BY 1"
)
def f09_mentions(t):
    d = t("documents").where("doi IS NOT NULL").select("doi", F.coalesce("section", F.lit("none")).alias("section"), F.concat(F.lit("As shown in Figs. 1-3, it rose. "), F.when(F.col("section") == "results", "Fig. 4 agrees.").otherwise("")).alias("body"))
    f = t("figures").where("doi IS NOT NULL").select("doi", "fig_row_id", F.concat(F.lit("Fig. "), F.col("fig_row_id") % 4 + 1).alias("label"))
    m = figures.mentions(d, f, "doi", "section", "body", "fig_row_id", "label")
    return m.select("fig_row_id", F.size("mentions").alias("n_sections"), F.aggregate(F.map_values("mentions"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_mentions"))


@query(
    "SELECT srp_id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing' WHEN srp_id % 2 = 0 THEN 'suspicious' WHEN len(regexp_extract_all(title, "
    "'[\\p{L}\\p{N}_]+')) < 5 THEN 'suspicious' WHEN regexp_matches(title, '(?i)\\breferences\\b') THEN 'suspicious' ELSE 'good' END AS quality FROM srp "
    "WHERE title IS NULL OR NOT regexp_matches(title, '[^ -~]')"
)
def f19_caption_issues(t):
    c = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "").when(F.col("srp_id") % 2 == 0, F.concat("title", F.lit(". References to others follow"))).otherwise(F.col("title"))
    return t("srp").where(F.col("title").isNull() | ~F.col("title").rlike(r"[^ -~]")).select("srp_id", captions.caption_issues(c)["quality"].alias("quality"))


@query()
def f19_sanitised(t):
    """Captions with back matter and body text run into them come back without; the rest as it is, in clean form."""
    c = F.concat(F.coalesce("caption", F.lit("")), F.when(F.col("fig_row_id") % 3 == 0, "\nCRediT authorship contribution statement").when(F.col("fig_row_id") % 3 == 1, " In the next section more follows.").otherwise(""))
    return t("figures").select("fig_row_id", captions.sanitise(c).alias("caption"))


@query(
    "SELECT fig_row_id, replace(x, cap, '[FIG]') AS body FROM (SELECT fig_row_id, concat('Before. ', cap, chr(10), 'After it all.') AS x, cap FROM (SELECT "
    "fig_row_id, concat('Fig. 1 Values of the quantity ', CAST(fig_row_id AS VARCHAR), ' over time.') AS cap FROM figures))"
)
def f19_leakage_removed(t):
    cap = F.concat(F.lit("Fig. 1 Values of the quantity "), F.col("fig_row_id"), F.lit(" over time."))
    body = F.concat(F.lit("Before. "), F.regexp_replace(cap, "the quantity", "the\nquantity"), F.lit("\nAfter it all."))
    return t("figures").select("fig_row_id", F.regexp_replace(captions.remove_leaked(body, F.array(cap), F.array(F.lit("[FIG]"))), r" (\[FIG\]) ", "$1").alias("body")).withColumn("body", F.regexp_replace("body", r"Before\.(?! )", "Before. "))


@query(
    "SELECT doi, CAST(min(k) AS INTEGER) AS page, 'abstract,contact' AS classes FROM (SELECT DISTINCT doi, 1 + length(doi) % 9 AS k FROM documents WHERE "
    "doi IS NOT NULL) WHERE k <= 8 GROUP BY doi"
)
def f20_front_matter(t):
    d = t("documents").where("doi IS NOT NULL").select("doi").distinct()
    pages = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.when(i == F.length("doi") % 9 + 1, "Abstract. Write to a.b@c.org").otherwise("Plain text"))
    return d.select("doi", F.explode(captions.front_matter_pages(pages)).alias("x")).select("doi", "x.page", F.array_join("x.classes", ",").alias("classes"))


@query(
    "SELECT fig_row_id, CASE WHEN fig_row_id % 3 = 0 THEN 'Fig. 2. Found on its page.' WHEN fig_row_id % 3 = 1 THEN 'Figure 2: Found on the next' || "
    "chr(10) || 'in two lines.' END AS caption FROM figures"
)
def f36_captions_from_pages(t):
    k = F.col("fig_row_id") % 3
    pages = F.array(F.when(k == 0, "Text.\nFig. 2. Found on its page.\n\nMore.").otherwise("Only Fig. 21 is here."), F.when(k == 1, "Figure 2: Found on the next\nin two lines.\n\nMore.").otherwise("None."), F.lit("Fig. 2. Too late."))
    return t("figures").select("fig_row_id", captions.caption_from_pages(F.lit("Fig. 2"), F.lit(1), F.when(k == 2, F.slice(pages, 1, 2)).otherwise(pages)).alias("caption"))


# ---------------------------------------------------------------- tables


def _bodies(t):
    return t("paper_tables").select("tab_row_id", F.posexplode("tables").alias("pos", "t")).select("tab_row_id", "pos", "t.caption", "t.text").where(F.trim(F.coalesce("text", F.lit(""))) != "")


_LINES_SQL = "(SELECT tab_row_id, pos, caption, text, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM (SELECT tab_row_id, t.caption, t.text, pos FROM (SELECT tab_row_id, unnest(tables) AS t, unnest(range(len(tables))) AS pos FROM paper_tables)) WHERE trim(coalesce(text, ''), ' ') <> '')"
_DIGITS_SQL = "length(regexp_replace(x, '[^0-9%.,+\\-−–—/()<>±=×:]', '', 'g')) / greatest(length(x), 1)"


@query(
    f"SELECT tab_row_id, CAST(pos AS INTEGER) AS pos, CAST(len(list_filter(l, lambda x: {_DIGITS_SQL} >= 0.10)) AS INTEGER) AS n_digit_lines, CAST(len(l) "
    f"AS INTEGER) AS n FROM {_LINES_SQL}"
)
def f17_line_kinds(t):
    lines = tables.lines_of(F.col("text"))
    return _bodies(t).select("tab_row_id", "pos", F.size(F.filter(lines, lambda x: tables.digit_share(x) >= 0.10)).alias("n_digit_lines"), F.size(lines).alias("n"))


@query()
def f18_quality(t):
    q = tables.quality(F.col("text"), F.col("caption"))
    return _bodies(t).select("tab_row_id", "pos", q.alias("q")).select("tab_row_id", "pos", "q.score", "q.needs_review", F.array_join("q.reasons", ";").alias("reasons"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '3' WHEN p_size % 4 = 1 THEN 'S2' END AS number, p_size % 4 IN (2, 3) AS mention FROM part")
def f17_caption_lines(t):
    k = F.col("p_size") % 4
    line = F.when(k == 0, "Table 3. Values of the load").when(k == 1, "TABLE S2 Loads").when(k == 2, "Table 4 shows the loads").otherwise("Table 5. is empty")
    return t("part").select("p_partkey", tables.caption_number(line).alias("number"), tables.is_mention(line).alias("mention"))


@query(
    "SELECT tab_row_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (c <> '') AS BIGINT) AS n_captions FROM (SELECT tab_row_id, "
    "coalesce(t.caption, '') AS c, t.text FROM (SELECT tab_row_id, unnest(tables) AS t FROM paper_tables) WHERE trim(coalesce(t.text, ''), ' ') <> '') "
    "GROUP BY 1"
)
def f16_merged_tables(t):
    """Each table cut in two halves as over a page break, captured from page lines and merged again by number."""
    b = _bodies(t).select("tab_row_id", (F.col("pos") + 1).alias("num"), F.coalesce("caption", F.lit("")).alias("caption"), "text")
    halves = b.select("tab_row_id", "num", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("caption").alias("c"), F.split("text", "\n")[0].alias("x")), F.struct(F.lit(1).alias("part"), F.lit("").alias("c"), F.array_join(F.slice(F.split("text", "\n"), 2, 10_000_000), "\n").alias("x")))).alias("h")).select("tab_row_id", "num", "h.*")
    m = labelling.merge_continued(halves, "tab_row_id", "part", "num", "c", "x")
    return m.groupBy("tab_row_id").agg(F.count("*").alias("n"), F.count_if(F.col("c") != "").alias("n_captions"))


# ---------------------------------------------------------------- replies

_JUDGE = coercion.Schema(enums={"status": ("success", "api_error", "schema_error", "json_parse_error", "empty_response_error")}, scores={"relations": (0, 3)}, counts={"entities": 1}, booleans=("ready",), lists=("labels",), strings=("model",))


def _judgements(t):
    r = t("results")
    j = F.to_json(F.struct(F.upper("status").alias("status"), F.col("causal_relations_present").cast("double").alias("relations"), F.col("entity_count").cast("string").alias("entities"), F.when(F.col("stage2_ready"), "yes").otherwise("no").alias("ready"), F.col("model").alias("model")))
    return r.select("result_id", j.alias("j"))


@query(
    "SELECT result_id, lower(status) AS status, CAST(causal_relations_present AS INTEGER) AS relations, CAST(greatest(entity_count, 1) AS INTEGER) AS "
    "entities, coalesce(stage2_ready, false) AS ready, 0 AS n_labels, coalesce(model, '') AS model, 2 + CAST(status IS NOT NULL AS INTEGER) + "
    "CAST(entity_count IS NOT NULL AS INTEGER) + CAST(model IS NULL AS INTEGER) AS n_changed FROM results"
)
def f23_coerced_strict(t):
    c = coercion.coerce(F.col("j"), _JUDGE)
    return _judgements(t).select("result_id", c.alias("c")).select("result_id", "c.status", "c.relations", "c.entities", "c.ready", F.size("c.labels").alias("n_labels"), "c.model", "c.n_changed")


@query(
    "SELECT result_id, CASE WHEN lower(status) IN ('json_parse_error', 'schema_error') THEN 'schema_error' ELSE lower(status) END AS status, "
    "CAST(least(greatest(causal_relations_present, 1), 2) AS INTEGER) AS relations FROM results"
)
def f23_coerced_alias(t):
    schema = coercion.Schema(enums=_JUDGE.enums, scores={"relations": (1, 2)})
    c = coercion.coerce(F.col("j"), schema, coercion.Policy(aliases={"status": {"json_parse_error": "schema_error"}}, clamp=True))
    return _judgements(t).select("result_id", c.alias("c")).select("result_id", "c.status", "c.relations")


@query("SELECT result_id, coalesce(lower(status), 'api_error') AS status, CAST(coalesce(causal_relations_present, 0) AS INTEGER) AS relations FROM results")
def f23_coerced_default(t):
    c = coercion.coerce(F.col("j"), coercion.Schema(enums=_JUDGE.enums, scores=_JUDGE.scores), coercion.Policy(defaults={"status": "api_error", "relations": 0}))
    return _judgements(t).select("result_id", c.alias("c")).select("result_id", "c.status", "c.relations")


@query(
    "SELECT result_id, CASE WHEN entity_count IS NULL THEN 'missing or unreadable entities' WHEN status IS NULL OR lower(status) NOT IN ('success', "
    "'api_error', 'schema_error', 'json_parse_error', 'empty_response_error') THEN 'status invalid value' WHEN causal_relations_present IS NULL OR "
    "causal_relations_present > 3 THEN 'relations not an int in [0,3]' END AS error FROM results"
)
def f24_first_errors(t):
    c = coercion.coerce(F.col("j"), _JUDGE)
    return _judgements(t).select("result_id", c.alias("c")).select("result_id", coercion.first_error(F.col("c"), _JUDGE).alias("error"))


@query(
    "SELECT srp_id, concat_ws('|', section_summaries.introduction, section_summaries.methods, section_summaries.discussion) AS texts FROM srp WHERE "
    "section_summaries IS NOT NULL"
)
def f23_section_keys(t):
    s = F.col("section_summaries")
    j = F.to_json(F.struct(s["introduction"].alias("Background"), s["methods"].alias("Materials and Methods"), s["discussion"].alias("other")))
    m = coercion.section_map(j)
    return t("srp").where("section_summaries IS NOT NULL").select("srp_id", F.concat_ws("|", m["introduction"], m["methods"], m["discussion"]).alias("texts"))


@query(
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(title, ''), ' ') = '' THEN 'skipped' WHEN length(title) % 5 = 0 THEN 'api_error' "
    "ELSE 'success' END AS status FROM srp) GROUP BY 1"
)
def x02_context_retry(t):
    """A model whose context holds 60 tokens: long prompts are asked again for fewer, every fifth length fails for good."""

    def model(prompt: str, tokens: int) -> str:
        if len(prompt) % 5 == 0:
            raise OSError("the service is down")
        if tokens > 3000:
            raise ValueError(f"the request has {len(prompt)} input tokens and asks for {tokens}")
        return "{}"

    got = scoring.score(t("srp").select("srp_id", "title"), "srp_id", "title", scoring.with_context_retry(model, 3000))
    return got.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doi, CAST(least(count(*), 5) AS BIGINT) AS n_images, CAST(greatest(count(*) - 5, 0) AS BIGINT) AS n_left_out FROM figures WHERE doi IS NOT NULL GROUP BY 1")
def x04_image_blocks(t):
    f = t("figures").where("doi IS NOT NULL").select("doi", "fig_row_id", F.unhex(F.lit("89504E470D0A1A0A0000000D")).alias("content"))
    return scoring.image_blocks(f, "doi", "fig_row_id", "content", most=5).select("doi", "n_images", "n_left_out")


@query("SELECT doc_id, CASE WHEN section IS NOT NULL THEN 'given' WHEN n_chars > 400 THEN 'long' ELSE 'rest' END AS tier FROM documents")
def x05_tiers(t):
    d = t("documents").select("doc_id", "section", "n_chars")
    tiers = [("given", lambda x: x.select("doc_id", F.col("section").alias("s"))), ("long", lambda x: x.select("doc_id", F.when(F.col("n_chars") > 400, "long").alias("s"))), ("rest", lambda x: x.select("doc_id", F.lit(None).cast("string").alias("s")))]
    return scoring.in_tiers(d, "doc_id", tiers, F.col("s").isNotNull()).select("doc_id", "tier")


# ---------------------------------------------------------------- boxes and layout

_PAGES = "(SELECT doi, page, extraction_timestamp AS z, fig_row_id AS k, bounding_box AS b FROM figures WHERE doi IS NOT NULL AND page IS NOT NULL AND bounding_box IS NOT NULL)"


def _pages(t):
    f = t("figures").where("doi IS NOT NULL AND page IS NOT NULL AND bounding_box IS NOT NULL")
    return f.groupBy("doi", "page", "extraction_timestamp").agg(F.collect_list("bounding_box").alias("b"), F.min("fig_row_id").alias("fig_row_id"))


@query(
    f"SELECT min(k) AS fig_row_id, round(sum(greatest(least(b.x + b.w, 333.0) - greatest(b.x, 0.0), 0) * greatest(least(b.y + b.h, 333.0) - greatest(b.y, "
    f"0.0), 0)) / nullif(sum(greatest(least(b.x + b.w, 1000.0) - greatest(b.x, 0.0), 0) * greatest(least(b.y + b.h, 1000.0) - greatest(b.y, 0.0), 0)), 0), "
    f"6) AS first_cell FROM {_PAGES} GROUP BY doi, page, z"
)
def f42_grid_weights(t):
    w = figures.grid_weights(F.col("b"), F.lit(1000.0), F.lit(1000.0))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return _pages(t).select("fig_row_id", F.when(total > 0, r6(w[0])).alias("first_cell"))


@query(
    f"WITH p AS (SELECT min(k) AS fig_row_id, list(b) AS bs FROM {_PAGES} GROUP BY doi, page, z), c AS (SELECT fig_row_id, x, y, len(list_filter(bs, lambda "
    f"b: b.x <= x AND x < b.x + b.w AND b.y <= y AND y < b.y + b.h)) > 0 AS hit FROM p, (SELECT (unnest(range(60)) + 0.5) * (1000 / 60.0) AS x), (SELECT "
    f"(unnest(range(60)) + 0.5) * (1000 / 60.0) AS y)) SELECT fig_row_id, round(count(*) FILTER (hit) / 3600.0, 6) AS share FROM c GROUP BY 1"
)
def f27_union_share(t):
    """The share of the page covered by its boxes together, on a grid of 60 by 60 here."""
    return _pages(t).select("fig_row_id", r6(figures.union_share(F.col("b"), F.lit(1000.0), F.lit(1000.0), 60), "share"))


@query(
    "SELECT fig_row_id, concat_ws(';', CASE WHEN b IS NULL THEN 'no_box' END, CASE WHEN least(b.w, b.h) < 50 THEN 'small_side' END, CASE WHEN b.w * b.h < "
    "5000 THEN 'small_area' END, CASE WHEN greatest(b.w, b.h) / least(b.w, b.h) > 10 THEN 'extreme_aspect' END, CASE WHEN b IS NOT NULL AND n > 1 THEN "
    "'repeated_box' END) AS reasons FROM (SELECT fig_row_id, bounding_box AS b, count(*) OVER (PARTITION BY doi, bounding_box) AS n FROM figures)"
)
def f32_suspects_with_repeats(t):
    return figures.suspects(t("figures"), "doi", "fig_row_id", "bounding_box").select("fig_row_id", F.array_join("reasons", ";").alias("reasons"))


@query(
    "SELECT doi, page, max(bounding_box.w * bounding_box.h) AS area FROM figures WHERE doi IS NOT NULL AND page IS NOT NULL AND bounding_box.w * "
    "bounding_box.h >= 0.02 * 1000000 GROUP BY 1, 2"
)
def f37_largest_boxes(t):
    f = t("figures").where("doi IS NOT NULL AND page IS NOT NULL").select(F.struct("doi", "page").alias("p"), "bounding_box")
    b = F.col("bounding_box")
    return figures.recover_box(f, "p", "bounding_box", 1_000_000.0).select("p.doi", "p.page", (b["w"] * b["h"]).alias("area"))


@query(
    "SELECT doc_id, CASE WHEN section IN ('introduction', 'methods', 'results', 'discussion') THEN section WHEN section IS NULL THEN 'unknown' ELSE "
    "trim(regexp_replace(lower(section), '[^a-z0-9]+', '_', 'g'), '_') END AS key FROM documents"
)
def f39_section_keys(t):
    return t("documents").select("doc_id", figures.section_key(figures.guess_role(F.col("section")), F.col("section")).alias("key"))


@query("SELECT fig_row_id, 10.0 AS x, 20.0 AS y, 20.0 AS w, 30.0 AS h FROM figures")
def f41_polygons(t):
    k = F.col("fig_row_id") % 2 == 0
    pts = F.when(k, F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((10.0, 50.0), (30.0, 20.0), (12.0, 25.0))])).otherwise(F.array().cast("array<array<double>>"))
    box = figures.polygon_to_box(pts, F.array(*map(F.lit, (30.0, 50.0, 10.0, 20.0))))
    return t("figures").select("fig_row_id", box.alias("b")).select("fig_row_id", "b.*")


# ---------------------------------------------------------------- agreement, order, sinks


@query(
    f"WITH x AS (SELECT * FROM {_RATERS}), c AS (SELECT vec_id, v, count(*) AS n FROM x GROUP BY 1, 2), o AS (SELECT a.v AS a, b.v AS b, sum(a.n * (b.n - CASE WHEN a.v = b.v THEN 1 ELSE 0 END) / 3.0) AS o FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY 1, 2), m AS (SELECT a AS v, sum(o) AS n FROM o GROUP BY 1), k AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n / 2 AS r FROM m) "
    "SELECT round(1 - (SELECT sum(o.o * (p.r - q.r) * (p.r - q.r)) FROM o JOIN k p ON o.a = p.v JOIN k q ON o.b = q.v) / ((SELECT sum(p.n * q.n * (p.r - q.r) * (p.r - q.r)) FROM k p CROSS JOIN k q) / ((SELECT sum(n) FROM m) - 1)), 6) AS alpha"
)
def a26_krippendorff_ordinal(t):
    return agreement.krippendorff(_raters(t), "vec_id", "v", "ordinal").select(r6(F.col("alpha"), "alpha"))


@query()
def a27_field_metrics(t):
    """The measures that suit each field's type, and their roll-up by group."""
    x = _raters(t)
    a = agreement.field_metrics(x.withColumn("v", F.when(F.col("v") > 1, "high").otherwise("low")), "vec_id", "rater", "v", "nominal").select(F.lit("structure").alias("g"), F.lit("level").alias("field"), "metric", "value")
    b = agreement.field_metrics(x, "vec_id", "rater", "v", "score", 5).select(F.lit("judgement").alias("g"), F.lit("score").alias("field"), "metric", "value")
    m = a.unionByName(b)
    return m.select("g", "field", "metric", r6(F.col("value"), "value")).unionByName(agreement.roll_up(m, "g", "field").select("g", F.lit("*").alias("field"), F.lit("roll_up").alias("metric"), r6(F.col("mean"), "value")))


@query(
    "SELECT coalesce(nullif(trim(domain, ' '), ''), 'unknown') AS domain, count(*) AS n, round(avg(has_ga), 6) AS mean_has_ga, round(avg(has_pdf), 6) AS "
    "mean_has_pdf, round(100.0 * avg(CAST(l = 'low' AS INTEGER)), 6) AS low_pct, round(100.0 * avg(CAST(l = 'medium' AS INTEGER)), 6) AS medium_pct, "
    "round(100.0 * avg(CAST(l = 'high' AS INTEGER)), 6) AS high_pct FROM (SELECT *, CASE row_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END "
    "AS l FROM stage1_ga_index) GROUP BY 1"
)
def a13_readability(t):
    x = t("stage1_ga_index").withColumn("l", F.when(F.col("row_id") % 3 == 0, "low").when(F.col("row_id") % 3 == 1, "medium").otherwise("high"))
    g = aggregates.readability_summary(x, "domain", ["has_ga", "has_pdf"], "l")
    return g.select("domain", "n", *[r6(F.col(c), c) for c in ("mean_has_ga", "mean_has_pdf", "low_pct", "medium_pct", "high_pct")])


@query(
    "SELECT fig_row_id, CAST(row_number() OVER (PARTITION BY doi ORDER BY s, n, fig_row_id) AS BIGINT) AS place FROM (SELECT doi, fig_row_id, CASE "
    "fig_row_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS s, CASE fig_row_id % 4 WHEN 0 THEN fig_row_id % 12 + 1 WHEN 1 THEN fig_row_id "
    "% 7 + 1 WHEN 2 THEN fig_row_id % 5 + 1 ELSE 14 END AS n FROM figures WHERE doi IS NOT NULL)"
)
def t01_label_order(t):
    """Natural order of labels: plain numbers, roman ones among them, then appendix, then supplement."""
    i = F.col("fig_row_id")
    lab = F.when(i % 4 == 0, F.concat(F.lit("Fig. "), i % 12 + 1)).when(i % 4 == 1, F.concat(F.lit("Figure S"), i % 7 + 1)).when(i % 4 == 2, F.concat(F.lit("Fig. A."), i % 5 + 1)).otherwise("Fig. XIV")
    d = t("figures").where("doi IS NOT NULL").select("doi", "fig_row_id", labelling.label_order(lab).alias("o"))
    return d.select("fig_row_id", F.row_number().over(Window.partitionBy("doi").orderBy("o", "fig_row_id")).cast("bigint").alias("place"))


@query("SELECT row_id, CAST(coalesce(oa_status, 'other') = 'gold' AS INTEGER) AS gold, CAST(oa_status IS NULL AS INTEGER) AS other FROM stage1_ga_index")
def f45_one_hot(t):
    d, cols = models.dummies(t("stage1_ga_index").select("row_id", "oa_status"), "oa_status", drop_first=False)
    zero = F.lit(0.0)
    return d.select("row_id", cols.get("gold", zero).cast("int").alias("gold"), cols.get("other", zero).cast("int").alias("other"))


@query(
    "SELECT variant AS x, model AS series, count(*) AS n, round(avg(inference_time), 6) AS mean, round(avg(inference_time) - 1.96 * "
    "coalesce(stddev_samp(inference_time), 0) / sqrt(count(*)), 6) AS lo FROM results WHERE inference_time IS NOT NULL GROUP BY 1, 2"
)
def snk07_chart_table(t):
    return writers.chart_table(t("results").withColumnRenamed("variant", "x").withColumnRenamed("model", "series"), "x", "series", "inference_time").select("x", "series", "n", r6(F.col("mean"), "mean"), r6(F.col("lo"), "lo"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def snk04_published(t):
    """A table replaced whole: what is read is the second version."""
    n = t("nation").select("n_nationkey", "n_name")
    path = scratch(n.sparkSession)
    writers.publish(n, path)
    writers.publish(n.where("n_nationkey < 20"), path)
    return n.sparkSession.read.parquet(path)


@query("SELECT doi AS id, CAST(count(*) AS INTEGER) AS n FROM figures WHERE doi IS NOT NULL AND bounding_box IS NOT NULL GROUP BY 1")
def src12_ocr_boxes(t):
    """Boxes of a recogniser written as one file a paper and read again."""
    f = t("figures").where("doi IS NOT NULL AND bounding_box IS NOT NULL")
    b = F.col("bounding_box")
    rows = f.groupBy("doi").agg(F.to_json(F.struct(F.collect_list(F.struct(F.lit("w").alias("text"), F.lit(0.9).alias("confidence"), F.array(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]).alias("box"))).alias("words"))).alias("value"))
    v = F.col("value")
    listed = F.from_json(v, f"struct<words:{readers.OCR_BOX}>")["words"]
    return rows.select(F.col("doi").alias("id"), F.size(F.filter(listed, lambda x: figures.polygon_to_box(F.coalesce(x["polygon"], F.array().cast("array<array<double>>")), x["box"])["w"].isNotNull())).alias("n"))


@query("SELECT doc_id, md5(lower(text)) AS h FROM documents WHERE text IS NOT NULL")
def f25_content_hash(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.md5(F.lower("text")).alias("h"))


@query()
def f25_simhash(t):
    return duplicates.simhash(t("documents"), "doc_id", "text")


# ---------------------------------------------------------------- documents, records, validation

_ESC = ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, '1' AS number, coalesce(section, 'none') AS heading FROM documents WHERE text IS NOT NULL AND NOT "
    "regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')"
)
def src10_tei_sections(t):
    """Documents written as TEI and walked again."""
    body = F.col("text")
    for a, b in _ESC:
        body = F.replace(body, F.lit(a), F.lit(b))
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head n="1">'), F.coalesce("section", F.lit("none")), F.lit("</head><p>"), body, F.lit("</p></div></body></text></TEI>"))
    d = t("documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), xml.alias("value")).mapInPandas(readers.tei_sections, readers.TEI_SECTION).select("doc_id", "number", "heading")


_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"


@query(
    f"WITH d AS (SELECT doc_id, text, {_NORM.format('substr(text, 401, 60)')} AS q FROM documents WHERE length(text) >= 461), p AS (SELECT doc_id, i AS "
    f"page, {_NORM.format('substr(text, CAST(400 * (i - 1) + 1 AS INTEGER), 480)')} AS b FROM (SELECT doc_id, text, unnest(range(1, 9)) AS i FROM documents "
    f"WHERE length(text) >= 461)) SELECT d.doc_id, CAST(min(page) AS INTEGER) AS page, 'whole' AS how FROM d JOIN p ON d.doc_id = p.doc_id AND "
    f"contains(p.b, d.q) GROUP BY 1"
)
def j18_locate(t):
    """A passage of each document looked for in its pages of 480 characters that overlap."""
    d = t("documents").where(F.length("text") >= 461)
    pages = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr("text", 400 * i + 1, F.lit(480)))).alias("i", "body")).select("doc_id", (F.col("i") + 1).alias("page"), "body")
    return joins.locate(d.select("doc_id", F.lit(1).alias("k"), F.substring("text", 401, 60).alias("q")), pages, "doc_id", "k", "q", "page", "body").select("doc_id", "page", "how")


_HEALTH = {
    "total_doi_folders": ("count(*)", lambda: F.count("*")),
    "total_with_ga": ("sum(has_ga)", lambda: F.sum("has_ga")),
    "total_with_metadata": ("sum(has_metadata)", lambda: F.sum("has_metadata")),
    "total_with_pdf": ("sum(has_pdf)", lambda: F.sum("has_pdf")),
    "total_with_folder": ("sum(has_extracted_folder)", lambda: F.sum("has_extracted_folder")),
    "total_complete_for_stage1": ("sum(is_complete_for_stage1)", lambda: F.sum("is_complete_for_stage1")),
    "total_domain_matched": ("count(*) FILTER (domain_match_source <> 'unmatched')", lambda: F.count_if(F.col("domain_match_source") != "unmatched")),
    "total_domain_unmatched": ("count(*) FILTER (domain_match_source = 'unmatched')", lambda: F.count_if(F.col("domain_match_source") == "unmatched")),
    "total_issn_matches": ("count(*) FILTER (domain_match_source = 'scimago_issn')", lambda: F.count_if(F.col("domain_match_source") == "scimago_issn")),
    "total_exact_name_matches": ("count(*) FILTER (domain_match_source = 'scimago_name_exact')", lambda: F.count_if(F.col("domain_match_source") == "scimago_name_exact")),
    "total_fuzzy_name_matches": ("count(*) FILTER (domain_match_source = 'scimago_name_fuzzy')", lambda: F.count_if(F.col("domain_match_source") == "scimago_name_fuzzy")),
    "total_open_access": ("count(oa_status)", lambda: F.count("oa_status")),
    "total_with_license": ("count(license)", lambda: F.count("license")),
    "total_with_title": ("count(title)", lambda: F.count("title")),
    "total_with_issn": ("count(issn)", lambda: F.count("issn")),
    "num_papers": ("count(DISTINCT paper_id)", lambda: F.count_distinct("paper_id")),
    "num_journals": ("count(DISTINCT journal)", lambda: F.count_distinct("journal")),
    "num_publishers": ("count(DISTINCT publisher)", lambda: F.count_distinct("publisher")),
    "num_domains": ("count(DISTINCT domain) FILTER (domain <> 'unknown/unmatched')", lambda: F.count_distinct(F.when(F.col("domain") != "unknown/unmatched", F.col("domain")))),
    "year_min": ("min(publication_year)", lambda: F.min("publication_year")),
    "year_max": ("max(publication_year)", lambda: F.max("publication_year")),
    "year_mean": ("round(avg(publication_year), 6)", lambda: F.round(F.avg("publication_year"), 6)),
}


@query("SELECT unnest([" + ", ".join(f"'{k}'" for k in _HEALTH) + "]) AS metric, unnest([" + ", ".join(f"CAST({sql} AS DOUBLE)" for sql, _ in _HEALTH.values()) + "]) AS value FROM stage1_ga_index")
def a11_health(t):
    return aggregates.metric_rows(t("stage1_ga_index"), {k: c() for k, (_, c) in _HEALTH.items()})


@query(
    "SELECT coalesce(variant, 'POOLED') AS relation, count(*) AS n, round(avg(CAST(a = b AS DOUBLE)), 6) AS agreement, round(avg(CAST(abs(a - b) <= 1 AS "
    "DOUBLE)), 6) AS within_one, round(corr(a, b), 6) AS r FROM (SELECT variant, CAST(causal_relations_present AS DOUBLE) AS a, CAST(least(entity_count, "
    "3) AS DOUBLE) AS b FROM results WHERE variant IS NOT NULL AND causal_relations_present IS NOT NULL AND entity_count IS NOT NULL) GROUP BY GROUPING "
    "SETS ((variant), ())"
)
def a35_validation(t):
    """Two ratings of each relation, by relation and pooled: agreement, agreement within one, correlation."""
    r = t("results").where("variant IS NOT NULL AND causal_relations_present IS NOT NULL AND entity_count IS NOT NULL").select(F.col("variant").alias("relation"), F.col("causal_relations_present").cast("double").alias("a"), F.least("entity_count", F.lit(3)).cast("double").alias("b"))
    g = aggregates.pooled(r, "relation", [F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")).alias("within_one"), F.corr("a", "b").alias("r")])
    return g.select("relation", "n", *[r6(F.col(c), c) for c in ("agreement", "within_one", "r")])


@query(
    "SELECT row_id, coalesce(nullif(trim(doi_normalized, ' '), ''), nullif(trim(doi, ' '), '')) AS doi, coalesce(nullif(trim(title, ' '), ''), "
    "nullif(trim(journal, ' '), '')) AS title, nullif(trim(publisher, ' '), '') AS publisher FROM stage1_ga_index WHERE "
    "coalesce(regexp_full_match(concat(doi, doi_normalized, title, journal, publisher), '[ -Z^-~]*'), true)"
)
def f43_record_fields(t):
    x = t("stage1_ga_index").where(F.coalesce(F.concat_ws("", "doi", "doi_normalized", "title", "journal", "publisher").rlike(r"^[ -Z^-~]*$"), F.lit(True)))
    doc = F.to_json(F.struct(F.struct(F.col("doi_normalized").alias("doi"), F.col("publisher")).alias("metadata"), F.col("doi").alias("DOI"), F.col("title"), F.col("journal").alias("display_name")))
    c = values.record_fields(doc, {"doi": ["metadata.doi", "DOI"], "title": ["title", "display_name"], "publisher": ["publisher", "metadata.publisher"]})
    return x.select("row_id", c.alias("c")).select("row_id", "c.*")


@query("SELECT p_partkey, p_size % 6 = 0 AS ok FROM part")
def f34_headings(t):
    k = F.col("p_size") % 6
    h = F.when(k == 0, "Sample preparation").when(k == 1, "Figure 3").when(k == 2, "x = y + z").when(k == 3, "(a)").when(k == 4, "").otherwise(F.repeat(F.lit("long "), F.lit(40)))
    return t("part").select("p_partkey", text.admissible_heading(h).alias("ok"))


@query(
    "SELECT p_partkey, CAST(p_size / 100.0 >= 0.15 AS INTEGER) AS high_edge_density, CAST(p_size / 60.0 <= 0.20 AS INTEGER) AS low_whitespace, CAST(p_size "
    "* 20 >= 500 AS INTEGER) AS high_component_count FROM part"
)
def f29_flags(t):
    s = F.col("p_size")
    f = geometry.layout_flags(s / 100.0, s / 60.0, s * 20, s / 100.0, s / 100.0)
    return t("part").select("p_partkey", *[f[c].alias(c) for c in ("high_edge_density", "low_whitespace", "high_component_count")])


@query("SELECT doc_id, round(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / nullif(CAST(len(w) AS DOUBLE), 0), 6) AS numeric_share, round(len(list_filter(w, lambda x: length(x) >= 4 AND (regexp_matches(x, '(?i)" + "|".join(x.strip() for x in text.SCIENCE_PARTS.split(",")) + "') OR regexp_matches(x, '[A-Za-z]+[-_/][A-Za-z0-9]|[A-Za-z][0-9]')))) / nullif(CAST(len(w) AS DOUBLE), 0), 6) AS technical FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)")
def f21_scientific_tokens(t):
    d = text.token_densities(F.col("text"))
    return t("documents").where("text IS NOT NULL").select("doc_id", d.alias("d")).select("doc_id", F.when(F.col("d.n") > 0, r6(F.col("d.numeric"))).alias("numeric_share"), F.when(F.col("d.n") > 0, r6(F.col("d.technical"))).alias("technical"))


@query()
def f14_recovered_roles(t):
    """Every paper's four roles, from the sections that have one or by recovery, with the note of how."""
    d = t("documents").where("doi IS NOT NULL AND text IS NOT NULL").select("doi", "doc_id", F.initcap("section").alias("heading"), "text", F.when(F.col("section") != "abstract", F.col("section")).alias("role"), F.when(F.col("section") == "abstract", F.col("text")).alias("abs"))
    return labelling.recover_roles(d, "doi", "doc_id", "heading", "text", "role", "abs").select("doi", "role", "note", F.length("text").alias("n"))


@query(
    "SELECT tab_row_id, CAST(count(*) AS INTEGER) AS n_rows, CAST(max(n) AS INTEGER) AS widest FROM (SELECT tab_row_id, len(x) AS n FROM (SELECT "
    "tab_row_id, unnest([['a', 'b'], ['1', '2'], ['3']]) AS x FROM paper_tables)) GROUP BY 1"
)
def f30_cells_of_words(t):
    words = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(8.0).alias("w"), F.lit(s).alias("t")) for x, y, s in ((0, 0, "a"), (50, 0.4, "b"), (0, 20, "1"), (50, 20, "2"), (0, 40, "3"), (9, 40, "4"))])
    c = labelling.words_to_cells(t("paper_tables").select("tab_row_id", F.explode(words).alias("v")).select("tab_row_id", "v.*"), "tab_row_id", "x", "y", "w", "t", 3.0, 20.0)
    return c.groupBy("tab_row_id").agg(F.first("n_rows").cast("int").alias("n_rows"), F.max(F.size("cells")).alias("widest"))
