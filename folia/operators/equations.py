"""Equations of sections: fragments merged, several on a line taken apart, cleaned, judged, numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.text import clean_artifacts, phrases

#: Signs and functions that make a line mathematics.
MATH_SIGNS = "=+-*/×÷∑∏√∫∂∇≤≥≈≠±∞→←↔⇌ρσμλβθαπΔ%"
FUNCTIONS = "sin, cos, tan, log, ln, exp, min, max"
#: Words of tables, of prose, of sentences and of page furniture.
TABLE_WORDS = "description, parameters?, mean, max, min, sd, cv, standard, samples?, rate, grade, template, primer, amplicon, sequence, genes?, expert, index, weight, level, number, sample codes, conditions, groups, chewing, smoking, alcohol, patient code"
PROSE_WORDS = "compared with, respectively, calculated according, shown in, described by, represents, indicates, where, therefore, because, however, moreover, furthermore, supplementary, figure, table, appendix, references, acknowledgements, declaration, credit"
SENTENCE_VERBS = "is, are, was, were, has, have, had, shows?, showed, represents?, indicates?, calculated, determined"
FURNITURE_WORDS = "et al, journal homepage, sciencedirect, published by, creativecommons"
#: What LaTeX writes for a sign.
LATEX = {
    "×": "times", "÷": "div", "∑": "sum", "∏": "prod", "√": "sqrt{}", "∂": "partial", "∇": "nabla", "ρ": "rho", "σ": "sigma", "μ": "mu", "λ": "lambda", "β": "beta", "θ": "theta", "α": "alpha", "π": "pi", "Δ": "Delta",
    "≤": "le", "≥": "ge", "≈": "approx", "≠": "ne", "±": "pm", "→": "to", "←": "leftarrow", "↔": "leftrightarrow", "⇌": "rightleftharpoons",
}
#: Words that stand as indices after a letter.
INDICES = ("hkl", "tot", "app", "skel", "max", "min", "ij", "ji", "i", "j", "n", "m")
_SIGN_CLASS = "[" + "".join("\\" + c if c in "-/*+[]^" else c for c in MATH_SIGNS) + "]"


def spaced(c: Column) -> Column:
    """An equation's blanks made regular: none before a comma, one around operators."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\s\x{A0}]+([,;:])", "$1"), r"([=+×÷*/])", " $1 ")
    return F.trim(F.regexp_replace(s, r"[\s\x{A0}]+", " "))


def printed_number(c: Column) -> Column:
    """The last number in round brackets, else a bare number at the end; null for none."""
    last = F.regexp_extract(c, r"(?s)^.*\((\d{1,3})\)", 1)
    bare = F.regexp_extract(c, r"(?:^|\s)(\d{1,3})\s*$", 1)
    return F.coalesce(last.try_cast("int"), bare.try_cast("int"))


def n_math(c: Column) -> Column:
    """How many mathematical signs and functions a text holds."""
    return F.regexp_count(c, F.lit(_SIGN_CLASS)) + F.regexp_count(c, F.lit("(?i)" + phrases(FUNCTIONS)))


def split_numbered(c: Column) -> Column:
    """One element for each printed number, as ``a (1) b (2)`` holds two equations; a rest without number stays only if it is mathematics."""
    s = spaced(c)
    parts = F.transform(F.split(F.regexp_replace(s, r"(\(\d{1,3}\))", "$1\x01"), "\x01"), lambda p: F.trim(p))
    many = F.regexp_count(s, F.lit(r"\(\d{1,3}\)")) > 1
    kept = F.filter(parts, lambda p: (p != "") & (p.rlike(r"\(\d{1,3}\)") | (n_math(p) > 0)))
    return F.when(many, kept).when(s == "", F.array().cast("array<string>")).otherwise(F.array(s))


def clean_equation(c: Column) -> Column:
    """The text of a formula: artefacts repaired, signs in one form, operators apart."""
    s = F.translate(clean_artifacts(c), "•−–—ÃðÞ", " ---*()")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "×", " × "), r"\s*([=+\-*/^])\s*", " $1 "), r"\s+", " "))


def latex_like(c: Column) -> Column:
    """A formula with LaTeX's names for signs, and usual indices as subscripts."""
    s = spaced(c)
    for sign, name in LATEX.items():
        s = F.replace(s, F.lit(sign), F.lit("\\" + name))
    return F.regexp_replace(s, r"\b([A-Za-z])\s+(" + "|".join(INDICES) + r")\b", "$1_{$2}")


def rejections(c: Column) -> Column:
    """``(rejected, reasons)``: what in a text speaks for a table row or prose rather than an equation."""
    t = spaced(F.coalesce(c, F.lit("")))
    n = F.length(t)
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{3,}"), F.lit(0)))
    math, digits = n_math(t), F.regexp_count(t, F.lit(r"\d"))
    has = lambda ws: t.rlike("(?i)" + phrases(ws))
    grades = t.rlike(r"(?:\b[A-G]\b\s+){4,}\d+(?:\.\d+)?\s*(?:±|\+/-)\s*\d+")
    rows = (F.regexp_count(t, F.lit("(?i)" + phrases("complex, sample, compound, control, parameter, index, grade"))) > 1) & (math <= 2)
    table = has(TABLE_WORDS)
    tests = {
        "checkmark_table_cells": (t.rlike("[✓✔☑]"), True),
        "grade_letter_table_sequence": (grades, True),
        "repeated_table_row_sequence": (rows, True),
        "table_like_words": (table, (math <= 2) | (words >= 5)),
        "prose_like_words": (has(PROSE_WORDS), False),
        "long_prose_without_math_symbols": ((words >= 8) & (math == 0), True),
        "sentence_like_formula": ((words >= 10) & has(SENTENCE_VERBS) & (math <= 1), True),
        "very_long_prose_like_formula": ((n > 220) & (words > 18) & (math <= 2), True),
        "header_footer_or_publisher_text": (has(FURNITURE_WORDS), True),
        "long_numeric_table_row": ((n > 140) & (digits >= 18) & ~t.rlike(r"[=∑∏√∫∂∇]") & ~has("sin, cos, tan, log, ln, exp"), True),
    }
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, (hit, _) in tests.items()]))
    out = F.lit(False)
    for hit, hard in tests.values():
        out = out | (hit & (F.lit(hard) if isinstance(hard, bool) else hard))
    return F.when(n == 0, F.struct(F.lit(True).alias("rejected"), F.array(F.lit("empty_formula_text")).alias("reasons"))).when(n <= 3, F.struct(F.lit(True).alias("rejected"), F.array(F.lit("too_short")).alias("reasons"))).otherwise(F.struct(out.alias("rejected"), reasons.alias("reasons")))


def confidence(raw: Column, clean: Column, repaired: Column) -> Column:
    """``(level, reasons)``: rejected, needs_review, repaired or clean."""
    t = spaced(F.coalesce(clean, raw, F.lit("")))
    r = rejections(t)
    uneven = lambda a, b: F.regexp_count(t, F.lit(a)) != F.regexp_count(t, F.lit(b))
    doubts = F.array_compact(
        F.array(
            F.when(uneven(r"\(", r"\)"), "unbalanced_parentheses"),
            F.when(uneven(r"\[", r"\]"), "unbalanced_brackets"),
            F.when(F.coalesce(raw, t).rlike("ffiffi|[ðÞÁÃ�]"), "pdf_math_glyph_noise"),
            F.when(F.regexp_count(t, F.lit("[A-Za-z0-9]")) < 3, "few_alphanumeric_symbols"),
            F.when(t.rlike("(?i)" + phrases("rho, sigma, alpha, beta")), "possible_lost_greek_symbol"),
            F.when(t.rlike(r"\b\w+\s+\w+\s+\d+\s*/\s*\d+\b"), "possible_fraction_format_loss"),
        )
    )
    struct = lambda level, reasons: F.struct(level.alias("level"), reasons.alias("reasons"))
    none = F.array().cast("array<string>")
    return (
        F.when(r["rejected"], struct(F.lit("rejected"), r["reasons"]))
        .when(F.size(doubts) > 0, struct(F.lit("needs_review"), doubts))
        .when(repaired, struct(F.lit("repaired"), F.array(F.lit("merged_split_formula_or_repaired_numbering"))))
        .otherwise(struct(F.lit("clean"), none))
    )


def is_fragment(c: Column) -> Column:
    """A broken rest of an equation: only brackets and stops, only a number, or up to three characters without a letter."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return t.rlike(r"^[()\[\]{}\s,.;:]*$") | t.rlike(r"^\(?\s*\d+[A-Za-z]?\s*\)?$") | ((F.length(t) <= 3) & ~t.rlike(r"[\p{L}]"))


def extract_equations(raw: DataFrame, doc: str, pos: str, text: str, section: str | None = None) -> DataFrame:
    """``(doc, equation_id, label, num, section, raw_text, clean_text, latex_like_text, confidence, needs_review, reasons)`` from formulas in document order.

    A fragment that follows an equation with an open bracket, or that is at most four characters long, is joined to it; other fragments go. Several numbered equations in one formula
    become several. Rejected ones go; of equal number and text in a document the first stays. Ids count what is left, from ``eq001``. All steps are windows within a document.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    d = raw.select(doc, pos, (F.col(section) if section else F.lit(None).cast("string")).alias("section"), spaced(clean_artifacts(F.coalesce(F.col(text), F.lit("")))).alias("_raw"))
    d = d.withColumn("_frag", is_fragment(F.col("_raw"))).withColumn("_next", F.lead("_raw").over(w)).withColumn("_nfrag", F.coalesce(F.lead("_frag").over(w), F.lit(False)))
    opened = F.regexp_count("_raw", F.lit(r"\(")) > F.regexp_count("_raw", F.lit(r"\)"))
    d = d.withColumn("_merge", ~F.col("_frag") & F.col("_nfrag") & (opened | (F.length("_next") <= 4)))
    d = d.where(~F.col("_frag")).withColumn("_raw", F.when(F.col("_merge"), spaced(F.concat_ws(" ", "_raw", "_next"))).otherwise(F.col("_raw")))
    d = d.withColumn("_parts", split_numbered(F.col("_raw"))).select("*", F.posexplode("_parts").alias("_k", "_part"))
    d = d.withColumn("clean_text", spaced(clean_equation(F.col("_part")))).withColumn("num", F.coalesce(printed_number(F.col("clean_text")), printed_number(F.col("_part"))))
    d = d.withColumn("_c", confidence(F.col("_part"), F.col("clean_text"), F.col("_merge") | (F.size("_parts") > 1))).where("_c.level <> 'rejected'")
    same = Window.partitionBy(doc, F.coalesce("num", F.lit(-1)), F.lower(F.substring("clean_text", 1, 220))).orderBy(pos, "_k")
    d = d.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    d = d.withColumn("_id", F.row_number().over(Window.partitionBy(doc).orderBy(pos, "_k")))
    return d.select(
        doc,
        F.concat(F.lit("eq"), F.when(F.col("_id") < 1000, F.lpad(F.col("_id").cast("string"), 3, "0")).otherwise(F.col("_id").cast("string"))).alias("equation_id"),
        F.concat(F.lit("Equation "), F.coalesce("num", "_id").cast("string")).alias("label"),
        "num",
        "section",
        F.col("_part").alias("raw_text"),
        "clean_text",
        latex_like(F.col("clean_text")).alias("latex_like_text"),
        F.col("_c.level").alias("confidence"),
        F.col("_c.level").isin("needs_review", "repaired").alias("needs_review"),
        F.col("_c.reasons").alias("reasons"),
    )


def equation_block(number: Column, formula: Column, low: Column | None = None) -> Column:
    """A formula as it stands in running text: ``[Equation 3: ...]``, marked where it is of low confidence or was not recovered."""
    f = clean_equation(F.coalesce(formula, F.lit("")))
    weak = (low if low is not None else F.lit(False)) | (f == "")
    return F.concat(F.lit("[Equation "), number.cast("string"), F.when(weak, ", low-confidence").otherwise(""), F.lit(": "), F.when(f == "", "formula not recovered").otherwise(f), F.lit("]"))


def drop_fragment_blocks(c: Column) -> Column:
    """A text without the equation blocks that hold only a fragment; the first block stays whatever it holds."""
    block = r"\[Equation\s+\d+(?:,\s*low-confidence)?:\s*(?:[()\[{}\s,.;:]*|\(?\s*\d+[A-Za-z]?\s*\)?)\]"
    head = F.regexp_extract(c, r"(?s)^(.*?\[Equation\s+\d+(?:,\s*low-confidence)?:.*?\])", 1)
    rest = F.substr(c, F.length(head) + 1)
    return clean_artifacts(F.when(head == "", c).otherwise(F.concat(head, F.regexp_replace(rest, block, " "))))
