"""Figures and the sections they belong to, their boxes, and what a page's boxes look like together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions import geometry, text
from folia.operators.aggregates import dominant
from folia.operators.joins import as_of, nearest

ROLES = ("introduction", "methods", "results", "discussion")


def mentions(sections: DataFrame, figures: DataFrame, doc: str, section: str, body: str, figure: str, label: str, kind: str = "fig") -> DataFrame:
    """``(doc, figure, mentions map<section, int>)``: how often each section's text mentions a figure, ranges and lists counted (F8, F9). Numbers are an equi-join, texts are read once."""
    said = sections.select(F.col(doc), F.col(section).alias("_s"), F.explode(text.mention_numbers(F.coalesce(body, F.lit("")), kind)).alias("_n"))
    counts = said.groupBy(doc, "_s", "_n").agg(F.count("*").cast("int").alias("_c"))
    figs = figures.select(doc, figure, text.parse_label(F.col(label)).alias("_l")).where((F.col("_l.prefix") == "") & (F.col("_l.kind") == {"fig": "figure", "table": "table", "scheme": "scheme"}[kind])).select(doc, figure, F.col("_l.number").alias("_n"))
    hit = figs.join(counts, [doc, "_n"]).where(F.col("_s").isNotNull())
    return hit.groupBy(doc, figure).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_c"))).alias("mentions"))


def map_to_sections(figures: DataFrame, doc: str, figure: str, page: str, mentioned: str, sections: DataFrame | None = None, section_page: str = "page", role: str = "role", order: str = "order") -> DataFrame:
    """``(doc, figure, section, method)``: the section that mentions a figure most; else the last labelled section that begins on or before its page; else the section of the nearest page
    with a figure placed by mentions; else none (F9). Methods are mention, section_page, figure_page and unassigned. No documents' figures are paired: two as-of joins."""
    f = figures.select(doc, figure, page, F.when(F.size(mentioned) > 0, dominant(F.col(mentioned))).alias("_m"))
    rest = f.where(F.col("_m").isNull() & F.col(page).isNotNull() & F.col(doc).isNotNull()).select(doc, figure, page)
    out = f.where(F.col("_m").isNotNull()).select(doc, figure, F.col("_m").alias("section"), F.lit("mention").alias("method"))
    if sections is not None:
        starts = sections.where(F.col(role).isin(*ROLES) & F.col(section_page).isNotNull()).select(F.col(doc), F.col(section_page).alias("_p"), F.col(role).alias("_role"), F.col(order).alias("_o"))
        placed = as_of(rest, starts.groupBy(doc, "_p").agg(F.max_by("_role", "_o").alias("_role"), F.max("_o").alias("_o")), doc, page, "_p", "_role", "_o")
        out = out.unionByName(placed.where(F.col("_role").isNotNull()).select(doc, figure, F.col("_role").alias("section"), F.lit("section_page").alias("method")))
        rest = placed.where(F.col("_role").isNull()).select(doc, figure, page)
    anchors = f.where(F.col("_m").isin(*ROLES) & F.col(page).isNotNull()).select(doc, F.col(page).alias("_p"), F.col("_m").alias("_a"))
    near = nearest(rest, anchors, doc, page, "_p", "_a")
    out = out.unionByName(near.select(doc, figure, F.col("_a").alias("section"), F.when(F.col("_a").isNotNull(), "figure_page").otherwise("unassigned").alias("method")))
    unplaced = f.where(F.col("_m").isNull() & (F.col(page).isNull() | F.col(doc).isNull()))
    return out.unionByName(unplaced.select(doc, figure, F.lit(None).cast("string").alias("section"), F.lit("unassigned").alias("method")))


def guess_role(heading: Column) -> Column:
    """A role from a heading: the classifier's, else by a telling word."""
    h = F.lower(F.coalesce(heading, F.lit("")))
    by_word = F.when(h.rlike(r"\b(?:methods?|experiment\w*|materials?)\b"), "methods").when(h.rlike(r"\b(?:results?|findings?)\b"), "results").when(h.rlike(r"\bdiscussion\b|\bconclusion"), "discussion").when(h.rlike(r"\b(?:introduction|background)\b"), "introduction")
    return F.coalesce(text.classify_heading(heading)["label"], by_word)


def section_key(role: Column, heading: Column) -> Column:
    """What a section counts as: its role, else its heading as a key, else ``unknown``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.when(role.isin(*ROLES), role), F.when(slug != "", slug), F.lit("unknown"))


def fallback_id(label: Column, kind: Column, nth: Column) -> Column:
    """A figure's id by its label, else by its kind and place: ``fig_unlabeled_03``."""
    short = F.when(kind == "table", "table").when(kind == "scheme", "scheme").otherwise("fig")
    return F.coalesce(text.parse_label(label)["id"], F.concat(short, F.lit("_unlabeled_"), F.lpad(nth.cast("string"), 2, "0")))


def recover_box(boxes: DataFrame, by: str, box: str, page_area: float, caption_box: str | None = None, least: float = 0.02) -> DataFrame:
    """``(by, box)``: of the boxes that cover at least ``least`` of the page the largest, or, where the caption's place is known, the one whose centre is nearest to it."""
    a = geometry.area(F.col(box))
    ok = boxes.where(a >= least * page_area)
    if caption_box is None:
        return ok.groupBy(by).agg(F.max_by(box, a).alias(box))
    centre = lambda b: (b["x"] + b["w"] / 2, b["y"] + b["h"] / 2)
    (ax, ay), (bx, by_) = centre(F.col(box)), centre(F.col(caption_box))
    d = F.pow(ax - bx, 2) + F.pow(ay - by_, 2)
    return ok.groupBy(by).agg(F.min_by(box, F.struct(F.coalesce(d, F.lit(0.0)).alias("d"), (-a).alias("a"))).alias(box))


def union_share(boxes: Column, width: Column, height: Column, n: int = 300) -> Column:
    """The share of a page that its boxes cover together, on a grid of ``n`` by ``n`` cells by their centres (F27). Per row of the grid the covered stretches are added up, so no cell is listed."""
    cell_h, cell_w = height / n, width / n

    def row(i: Column) -> Column:
        y = (i + 0.5) * cell_h
        hit = F.filter(boxes, lambda b: (b["y"] <= y) & (y < b["y"] + b["h"]))
        spans = F.transform(hit, lambda b: F.struct(F.greatest(F.ceil(b["x"] / cell_w - 0.5), F.lit(0)).cast("int").alias("a"), F.least(F.ceil((b["x"] + b["w"]) / cell_w - 0.5), F.lit(n)).cast("int").alias("z")))
        start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
        step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["z"]).alias("upto"), (acc["n"] + F.greatest(s["z"] - F.greatest(acc["upto"], s["a"]), F.lit(0))).alias("n"))
        return F.aggregate(F.array_sort(spans), start, step)["n"]

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row), F.lit(0), lambda a, x: a + x)
    return F.when((width > 0) & (height > 0), total / float(n * n)).otherwise(0.0)


def grid_weights(boxes: Column, width: Column, height: Column, n: int = 3) -> Column:
    """The share of the boxes' area in each of ``n`` by ``n`` cells, by rows, cell bounds rounded to whole units (F42); zeros without area."""
    cut = lambda side, k: F.round(side * k / n)
    part = lambda b, i, j: F.greatest(F.least(b["x"] + b["w"], cut(width, j + 1)) - F.greatest(b["x"], cut(width, j)), F.lit(0.0)) * F.greatest(F.least(b["y"] + b["h"], cut(height, i + 1)) - F.greatest(b["y"], cut(height, i)), F.lit(0.0))

    def cell(i: int, j: int) -> Column:
        return F.aggregate(boxes, F.lit(0.0), lambda a, b: a + part(b, i, j))

    raw = [cell(i, j) for i in range(n) for j in range(n)]
    total = sum(raw, F.lit(0.0))
    return F.array(*[F.coalesce(F.try_divide(x, total), F.lit(0.0)) for x in raw])


def imbalance(weights: Column, n: int = 3) -> Column:
    """How far the weight of a grid lies from even: the greater of the differences between left and right and between top and bottom."""
    at = lambda i, j: F.get(weights, F.lit(i * n + j))
    side = lambda cells: sum(cells, F.lit(0.0))
    left, right = side([at(i, 0) for i in range(n)]), side([at(i, n - 1) for i in range(n)])
    top, bottom = side([at(0, j) for j in range(n)]), side([at(n - 1, j) for j in range(n)])
    return F.greatest(F.abs(left - right), F.abs(top - bottom))


def spread(boxes: Column, width: Column, height: Column) -> Column:
    """The deviation of the boxes' centres from their mean place, as a share of the page's diagonal (F27); 0 for fewer than two."""
    n = F.size(boxes)
    mean = lambda f: F.aggregate(boxes, F.lit(0.0), lambda a, b: a + f(b)) / n
    cx, cy = (lambda b: b["x"] + b["w"] / 2), (lambda b: b["y"] + b["h"] / 2)
    var = (mean(lambda b: cx(b) * cx(b)) - F.pow(mean(cx), 2)) + (mean(lambda b: cy(b) * cy(b)) - F.pow(mean(cy), 2))
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))) / F.sqrt(width * width + height * height)).otherwise(0.0)


def polygon_to_box(points: Column, numbers: Column) -> Column:
    """A box from a list of points or, where there is none, from four numbers ``x0, y0, x1, y1``."""
    four = F.when(F.size(numbers) == 4, F.struct(F.least(numbers[0], numbers[2]).alias("x"), F.least(numbers[1], numbers[3]).alias("y"), F.abs(numbers[2] - numbers[0]).alias("w"), F.abs(numbers[3] - numbers[1]).alias("h")))
    return F.when(F.size(points) > 0, geometry.polygon_box(points)).otherwise(four)


def suspects(figures: DataFrame, doc: str, key: str, box: str, length: str | None = None, least_bytes: int = 3000) -> DataFrame:
    """``(key, reasons)``: why a figure looks wrong: its box, a file of few bytes, or a box that another figure of the document has too (F32). Boxes are counted, not paired."""
    rows = figures.select(F.col(doc).alias("_d"), F.col(key).alias("_k"), F.col(box).alias("_b"), *([F.col(length).alias("_len")] if length else []))
    same = rows.where(F.col("_b").isNotNull()).groupBy(F.col("_d").alias("_d2"), F.col("_b").alias("_b2")).agg(F.count("*").alias("_n")).where("_n > 1")
    d = rows.join(same, F.col("_d").eqNullSafe(F.col("_d2")) & F.col("_b").eqNullSafe(F.col("_b2")), "left")
    extra = [F.when(F.col("_n") > 1, "repeated_box")] + ([F.when(F.col("_len") < least_bytes, "small_file")] if length else [])
    return d.select(F.col("_k").alias(key), F.array_compact(F.concat(geometry.suspect_reasons(F.col("_b")), F.array(*extra))).alias("reasons"))
