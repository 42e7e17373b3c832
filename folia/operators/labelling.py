"""Section roles of a document, prompts from its parts, tables and captions from its lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import tables, text
from folia.operators import windows

ROLES = ("introduction", "methods", "results", "discussion")


#: How the end of a section's text announces the next section.
BOUNDARY = r"(?i)(?:^|\n)\s*(?:\d+(?:\.\d+)*\.?\s+)?(introduction|materials? and methods?|methods?|results?(?: and discussion)?|discussion|conclusions?)\s*$"


def announced(body: Column) -> Column:
    """The role of the heading with which a section's text ends, null for none."""
    h = F.lower(F.regexp_extract(F.coalesce(body, F.lit("")), BOUNDARY, 1))
    return F.when(h.contains("introduction"), "introduction").when(h.contains("method"), "methods").when(h.contains("result"), "results").when(h.contains("discussion") | h.contains("conclusion"), "discussion")


def label_sections(sections: DataFrame, doc: str, pos: str, heading: str, body: str, number: str | None = None, most: int = 4, least_score: float = 2.0) -> DataFrame:
    """Adds ``role``, ``role_source``, ``role_confidence`` (F13). In this order: excluded headings stay unlabelled and stop propagation; heading rules; a boundary that the text above announces;
    the parent section; bounded propagation; a document without methods gets its best-scoring section between introduction and results; content.

    All passes are windows over one sort of a document's sections, which is the largest group a task holds.
    """
    c = text.classify_heading(F.col(heading))
    d = sections.withColumn("_c", c).withColumn("_own", F.col("_c.label")).withColumn("_excluded", F.col("_c.source") == "excluded")
    d = d.withColumn("_pending", F.coalesce(announced(F.col(body)), F.when(F.col("_own") == "discussion", "discussion"), F.col("_own")))
    d = windows.carry_pending(d.withColumn("_none", F.lit(None).cast("string")), doc, pos, "_pending", "_none", "_carried")
    # only a boundary in the text is news: what a heading above says is for propagation
    said = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_last", F.max(F.when(announced(F.col(body)).isNotNull(), F.col(pos))).over(said)).withColumn("_head", F.max(F.when(F.col("_own").isNotNull() | F.col("_excluded"), F.col(pos))).over(said))
    d = d.withColumn("_boundary", F.when(~F.col("_excluded") & F.col("_own").isNull() & F.col("_last").isNotNull() & (F.coalesce("_head", F.lit(-(2**62))) <= F.col("_last")), F.col("_carried")))
    d = d.withColumn("_known", F.coalesce("_own", "_boundary"))
    if number:
        d = windows.inherit_parent(d, doc, pos, number, "_known", "_parent_role")
    else:
        d = d.withColumn("_parent_role", F.col("_known"))
    # an excluded section interrupts: it counts as a label of its own that never passes on
    d = d.withColumn("_seed", F.coalesce("_parent_role", F.when(F.col("_excluded"), "excluded")))
    d = windows.propagate_bounded(d, doc, pos, "_seed", "_spread", most)
    s = text.content_scores(F.coalesce(F.col(body), F.lit("")))
    ranked = F.array_sort(F.array(*[F.struct((-s[r]).alias("n"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(ROLES)]))
    best = F.when(-ranked[0]["n"] >= least_score, ranked[0]["r"])
    spread = F.when(F.col("_spread") != "excluded", F.col("_spread"))
    d = d.withColumn("_role", F.when(F.col("_excluded"), None).otherwise(F.coalesce("_own", "_boundary", "_parent_role", spread))).withColumn("_m", s["methods"])
    # methods of a document that has none: the section that speaks most for them, after the introduction and before the results
    w = Window.partitionBy(doc)
    d = d.withColumn("_has", F.max((F.col("_role") == "methods").cast("int")).over(w)).withColumn("_lo", F.max(F.when(F.col("_role") == "introduction", F.col(pos))).over(w)).withColumn("_hi", F.min(F.when(F.col("_role") == "results", F.col(pos))).over(w))
    free = ~F.col("_excluded") & F.col("_role").isNull() & (F.coalesce("_has", F.lit(0)) == 0) & (F.col("_m") >= least_score) & (F.col("_lo").isNull() | (F.col(pos) > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(pos) < F.col("_hi")))
    d = d.withColumn("_pick", F.max(F.when(free, F.struct("_m", (-F.col(pos)).alias("p")))).over(w))
    inferred = F.when(free & (F.col("_pick.p") == -F.col(pos)), "methods")
    role = F.when(F.col("_excluded"), None).otherwise(F.coalesce("_role", inferred, best))
    source = (
        F.when(F.col("_excluded"), "excluded").when(F.col("_own").isNotNull(), "heading").when(F.col("_boundary").isNotNull(), "boundary").when(F.col("_parent_role").isNotNull(), "parent")
        .when(spread.isNotNull(), "propagated").when(inferred.isNotNull(), "inferred").when(best.isNotNull(), "content").otherwise("none")
    )
    sure = F.when(source == "heading", F.col("_c.confidence"))
    for name, x in (("parent", 0.78), ("boundary", 0.72), ("propagated", 0.5), ("inferred", 0.45), ("content", 0.4)):
        sure = sure.when(source == name, x)
    return d.select(*sections.columns, role.alias("role"), source.alias("role_source"), sure.otherwise(0.0).alias("role_confidence"))


def label_report(labelled: DataFrame, doc: str) -> DataFrame:
    """``(doc, n_sections, n_labelled, roles, complete)`` per document."""
    g = labelled.groupBy(doc).agg(F.count("*").alias("n_sections"), F.count("role").alias("n_labelled"), F.array_sort(F.collect_set("role")).alias("roles"))
    return g.withColumn("complete", F.size("roles") == len(ROLES))


def override_label(old: Column, old_source: Column, old_confidence: Column, new: Column, excluded: Column) -> Column:
    """Exclusions first; an existing label stays unless it is weak or missing."""
    weak = old.isNull() | old_source.isin("content", "propagated") | (old_confidence < 0.6)
    return F.when(excluded, None).when(weak & new.isNotNull(), new).otherwise(old)


#: Other names of the roles.
ALIASES = {"intro": "introduction", "background": "introduction", "method": "methods", "methodology": "methods", "experimental": "methods", "result": "results", "findings": "results", "conclusion": "discussion", "conclusions": "discussion", "summary": "discussion"}


def group_by_role(sections: DataFrame, doc: str, pos: str, heading: str, body: str, role: str) -> DataFrame:
    """``(doc, role, text)``: the sections of each role as one text with headings, in order; combined headings count for each of their roles."""
    r = F.lower(F.col(role))
    for a, b in ALIASES.items():
        r = F.when(r == a, b).otherwise(r)
    both = F.array_distinct(F.array_compact(F.array(r, F.when((r == "results") & F.lower(F.col(heading)).contains("discussion"), "discussion"))))
    piece = F.concat(F.lit("## "), F.coalesce(F.col(heading), F.lit("")), F.lit("\n\n"), F.col(body))
    return windows.join_ordered(sections.select(doc, pos, F.explode(both).alias("role"), piece.alias("text")), [doc, "role"], pos, "text")


def recover_roles(sections: DataFrame, doc: str, pos: str, heading: str, body: str, role: str, abstract: str | None = None) -> DataFrame:
    """``(doc, role, text, note)`` for every role of every document: the grouped sections, or where a role has none the first recovery that gives a text.

    Recoveries in order: sections whose heading is of the role's kind; for results and discussion the text of a combined section; for the introduction the first section before any labelled
    one; for the discussion the last section after the results that isn't back matter; unlabelled sections whose content speaks for the role; for the introduction the abstract. Null text
    and the note ``missing`` if none does.
    """
    c = text.classify_heading(F.col(heading))
    d = sections.withColumn("_r", F.lower(F.col(role))).withColumn("_c", c)
    for a, b in ALIASES.items():
        d = d.withColumn("_r", F.when(F.col("_r") == a, b).otherwise(F.col("_r")))
    w = Window.partitionBy(doc)
    s = text.content_scores(F.coalesce(F.col(body), F.lit("")))
    d = d.withColumn("_first", F.min(F.when(F.col("_r").isin(*ROLES), F.col(pos))).over(w)).withColumn("_res", F.max(F.when(F.col("_r") == "results", F.col(pos))).over(w)).withColumn("_s", s)
    back = F.col("_c.source") == "excluded"
    d = d.withColumn("_start", F.min(F.when(~back, F.col(pos))).over(w)).withColumn("_end", F.max(F.when(~back, F.col(pos))).over(w))
    combined = F.lower(F.coalesce(F.col(heading), F.lit(""))).rlike(r"results? and discussions?")
    open_ = F.col("_r").isNull() & ~back
    rank = lambda r: (
        F.when(F.col("_r") == r, 0)
        .when(F.col("_r").isNull() & (F.col("_c.label") == r), 1)
        .when(combined & F.lit(r in ("results", "discussion")), 2)
        .when(open_ & F.lit(r == "introduction") & (F.col(pos) == F.col("_start")) & (F.col("_first").isNull() | (F.col(pos) < F.col("_first"))), 3)
        .when(open_ & F.lit(r == "discussion") & (F.col(pos) == F.col("_end")) & (F.col(pos) > F.coalesce("_res", F.lit(2**62))), 4)
        .when(open_ & (F.col("_s")[r] >= 2.0), 5)
    )
    notes = ["labelled", "heading_kind", "combined_section", "first_section", "last_section", "content"]
    piece = F.concat(F.lit("## "), F.coalesce(F.col(heading), F.lit("")), F.lit("\n\n"), F.col(body))
    rows = d.where(F.coalesce(F.trim(F.col(body)), F.lit("")) != "").select(doc, pos, piece.alias("text"), F.explode(F.array(*[F.struct(F.lit(r).alias("role"), rank(r).alias("rank")) for r in ROLES])).alias("x")).select(doc, pos, "text", "x.role", "x.rank").where(F.col("rank").isNotNull())
    rows = rows.withColumn("_best", F.min("rank").over(Window.partitionBy(doc, "role"))).where(F.col("rank") == F.col("_best"))
    got = windows.join_ordered(rows.select(doc, "role", "rank", pos, "text"), [doc, "role", "rank"], pos, "text").withColumn("note", F.element_at(F.array(*map(F.lit, notes)), F.col("rank") + 1)).drop("rank")
    docs = sections.groupBy(doc).agg(F.first(abstract, ignorenulls=True).alias("_abs")) if abstract else sections.select(doc).distinct().withColumn("_abs", F.lit(None).cast("string"))
    full = docs.select(doc, "_abs", F.explode(F.array(*map(F.lit, ROLES))).alias("role")).join(got, [doc, "role"], "left")
    use = F.col("text").isNull() & (F.col("role") == "introduction") & (F.coalesce(F.trim("_abs"), F.lit("")) != "")
    return full.select(doc, "role", F.when(use, F.col("_abs")).otherwise(F.col("text")).alias("text"), F.when(use, "abstract").otherwise(F.coalesce("note", F.lit("missing"))).alias("note"))


def truncated(c: Column, most: int) -> Column:
    """A text cut at ``most`` characters with a mark."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(" [TRUNCATED]"))).otherwise(c)


def assemble_prompt(parts: dict[str, Column], most: int = 12_000, required: Sequence[str] = (), budgets: dict[str, int] | None = None) -> Column:
    """``(prompt, error)``: titled parts joined, each cut at its budget and the whole at ``most`` characters, with marks; the first required part that is blank is the error."""
    cut = lambda n, c: truncated(c, budgets[n]) if budgets and n in budgets else c
    body = F.concat_ws("\n\n", *[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"# {n}\n"), cut(n, c))) for n, c in parts.items()])
    error = F.coalesce(*[F.when(F.coalesce(F.trim(parts[n]), F.lit("")) == "", F.lit(f"{n} is missing")) for n in required]) if required else F.lit(None).cast("string")
    return F.struct(truncated(body, most).alias("prompt"), error.alias("error"))


def items_block(items: Column, title: str, most: int, each: int = 600) -> Column:
    """An array of ``(label, caption)`` as a numbered list under a title: at most ``most`` items, captions cut at ``each`` characters, and how many were left out."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x["label"], F.lit("unlabelled")), F.lit(": "), truncated(F.coalesce(x["caption"], F.lit("no caption")), each))
    rest = F.when(F.size(items) > most, F.concat(F.lit("\n("), (F.size(items) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"# {title}\n"), F.array_join(F.transform(F.slice(items, 1, most), line), "\n"), rest)).otherwise("")


def merge_continued(captured: DataFrame, doc: str, page: str, number: str, caption: str, body: str) -> DataFrame:
    """``(doc, number, page, caption, body)``: tables that go on over pages are one: parts of the same number in page order, the first caption, repeated lines of a part left out."""
    c = F.when(F.trim(F.coalesce(F.col(caption), F.lit(""))) != "", F.col(caption))
    g = captured.groupBy(doc, number).agg(F.min(page).alias(page), F.min(F.when(c.isNotNull(), F.struct(F.col(page).alias("p"), c.alias("c")))).alias("_c"), F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(body), F.lit("")).alias("b")))).alias("_b"))
    whole = F.array_join(F.filter(F.transform("_b", lambda x: x["b"]), lambda x: x != ""), "\n")
    return g.select(doc, number, page, F.coalesce("_c.c", F.lit("")).alias(caption), whole.alias(body))


def label_order(label: Column) -> Column:
    """A sort key of labels: figures, tables, schemes; plain before appendix before extended before supplement; by number, arabic or roman; then the panel."""
    p = text.parse_label(label)
    roman = F.upper(F.regexp_extract(label, r"(?i)\b(?:fig(?:ure)?|table|scheme)s?\.?\s+([IVXLC]+)\b", 1))
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
    digits = F.transform(F.filter(F.split(roman, ""), lambda x: x != ""), lambda x: F.coalesce(*[F.when(x == k, v) for k, v in value.items()], F.lit(0)))
    number = F.aggregate(F.transform(digits, lambda d, i: F.when(F.coalesce(F.get(digits, i + 1), F.lit(0)) > d, -d).otherwise(d)), F.lit(0), lambda a, x: a + x)
    kind = F.lower(F.coalesce(label, F.lit("")))
    rank = F.when(kind.rlike(r"\btab"), 1).when(kind.rlike(r"\bsch"), 2).otherwise(0)
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("", 0, "A", 1, "E", 2, "S", 3)]), p["prefix"]), F.lit(0))
    return F.struct(rank.alias("kind"), prefix.alias("prefix"), F.coalesce(p["number"], F.when(number > 0, number), F.lit(2**31 - 1)).alias("number"), F.coalesce(p["panel"], F.lit("")).alias("panel"))


def capture_tables(pages: DataFrame, doc: str, page: str, body: str) -> DataFrame:
    """``(doc, page, label, caption, table)``: from a table's caption (not from a mention such as ``Table 2 shows``), its lines, then lines of values until running text, another caption, a heading, page
    furniture or back matter begins (F16). A page is scanned line by line within a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        start = re.compile(r"^\s*(table\s+[A-Z]?\d+)\s*[.:|–-]*\s*(.*)$", re.I)

        def values(line: str) -> bool:
            return bool(re.search(r"\t|\s\|\s|\s{2,}", line.strip())) or sum(ch.isdigit() for ch in line) >= 0.2 * max(1, len(line))

        mention = re.compile(r"(?:" + tables.MENTION_WORDS.replace(", ", "|") + r")\b", re.I)
        stop = re.compile(r"^\s*(?:(?:fig(?:ure)?|scheme)\.?\s+[SA]?\d+|(?:" + tables.END_WORDS.replace(", ", "|").replace("*", r"\w*") + r")\b|\d+(?:\.\d+)*\.?\s+[A-Z][a-z]{3,}[A-Za-z ]{0,60}$|.*\bet\s+al\.?\s*$)", re.I)

        def prose(line: str) -> bool:
            w = line.split()
            return (len(w) >= 8 and not values(line) and line.rstrip().endswith((".", ";"))) or bool(stop.match(line) and not values(line))

        for b in batches:
            rows = []
            for d, p, t in zip(b[doc], b[page], b[body], strict=True):
                label, caption, table = None, [], []
                for line in [*(t or "").splitlines(), None]:
                    m = start.match(line) if line is not None else None
                    if m and (mention.match(m[2]) or m[2][:1].islower() or m[2][:1] in ")],;"):
                        m = None
                    if label and (line is None or m or (table and prose(line))):
                        rows.append((d, p, label, " ".join(caption).strip(), "\n".join(table)))
                        label, caption, table = None, [], []
                    if m:
                        label, caption = m[1], [m[2]]
                    elif label and line is not None and line.strip():
                        (table if table or values(line) else caption).append(line)
            yield pd.DataFrame(rows, columns=[doc, page, "label", "caption", "table"])

    kinds = f"`{doc}` {pages.schema[doc].dataType.simpleString()}, `{page}` {pages.schema[page].dataType.simpleString()}"
    return pages.select(doc, page, body).mapInPandas(run, f"{kinds}, label string, caption string, table string")


def words_to_rows(words: DataFrame, by: str, x: str, y: str, text_: str, tolerance: float) -> DataFrame:
    """``(by, row, line)``: words of a region as text lines by their height; a gap of over ``tolerance`` begins a new line."""
    w = Window.partitionBy(by).orderBy(y, x)
    g = words.withColumn("_new", F.coalesce((F.col(y) - F.lag(y).over(w) > tolerance).cast("int"), F.lit(0)))
    g = g.withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text_).alias("t")))), lambda v: v["t"]), " ").alias("line"))


def words_to_cells(words: DataFrame, by: str, x: str, y: str, w: str, text_: str, tolerance: float, gap: float) -> DataFrame:
    """``(by, row, cells array<string>, n_rows, regular)``: words of a region as rows of cells (F30): a horizontal gap of over ``gap`` begins a new cell. ``regular`` is the share of the
    region's rows that have the most frequent number of cells: a measure of how much of a table it is."""
    o = Window.partitionBy(by).orderBy(y, x)
    g = words.withColumn("_new", F.coalesce((F.col(y) - F.lag(y).over(o) > tolerance).cast("int"), F.lit(0))).withColumn("row", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(by, "row").orderBy(x)
    g = g.withColumn("_cut", F.coalesce((F.col(x) - F.lag(F.col(x) + F.col(w)).over(r) > gap).cast("int"), F.lit(0))).withColumn("_cell", F.sum("_cut").over(r.rowsBetween(Window.unboundedPreceding, 0)))
    cell = g.groupBy(by, "row", "_cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text_).alias("t")))), lambda v: v["t"]), " ").alias("_t"))
    rows = cell.groupBy(by, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "_t"))), lambda v: v["_t"]).alias("cells"))
    n = rows.groupBy(by, F.size("cells").alias("_n")).agg(F.count("*").alias("_c")).groupBy(by).agg(F.sum("_c").alias("n_rows"), (F.max("_c") / F.sum("_c")).alias("regular"))
    return rows.join(n, by).select(by, "row", "cells", "n_rows", "regular")


def better_caption(old: Column, found: Column) -> Column:
    """A caption found on the page replaces one that is missing, bare or breaks off, if it is longer and complete."""
    bad = text.caption_quality(old).isin("missing", "label_only", "short") | text.incomplete_caption(F.coalesce(old, F.lit("")))
    return F.when(bad & found.isNotNull() & (F.length(found) > F.length(F.coalesce(old, F.lit("")))) & ~text.incomplete_caption(found), found).otherwise(old)


def main_evidence(label: Column, role: Column, quality: Column) -> Column:
    """Figures and tables that may serve as evidence: not supplementary, in a labelled section, of usable quality."""
    return ~F.coalesce(text.parse_label(label)["prefix"] == "S", F.lit(False)) & role.isin(*ROLES) & (F.coalesce(quality, F.lit("")) != "bad")


def score_rows(df: DataFrame, key: str, prompt: str, scorer: Callable[[list[str]], list[str | None]], blank: str = "skipped") -> DataFrame:
    """``(key, status, raw_output, raw_output_length)`` from a batch scorer: the status says what happened to a row, a failing batch becomes ``api_error`` rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ask = [isinstance(p, str) and bool(p.strip()) for p in b[prompt]]
            try:
                got = iter(scorer([p for p, ok in zip(b[prompt], ask, strict=True) if ok]))
                out = [next(got) if ok else None for ok in ask]
                status = [blank if not ok else "success" if r and r.strip() else "empty_response_error" for ok, r in zip(ask, out, strict=True)]
            except Exception:  # noqa: BLE001 - whatever a model adapter raises is the rows' status
                out, status = [None] * len(b), [blank if not ok else "api_error" for ok in ask]
            yield pd.DataFrame({key: b[key], "status": status, "raw_output": out, "raw_output_length": [len(r or "") for r in out]})

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, status string, raw_output string, raw_output_length int")
