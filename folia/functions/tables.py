"""Table bodies and captions: what each line is, what doesn't belong, and how good the rest is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.text import phrases

#: Signs that count like digits, in the capture of tables and in the judgement of their quality.
CAPTURE_SIGNS = "%±.,/()=<>|:;–-"
QUALITY_SIGNS = "%.,+-−–—/()<>±=×:"
#: Words of page furniture, of data lines, of sentences, of mentions of a table, and of lines that end a table.
FOOTER_WORDS = "sciencedirect, elsevier, journal homepage, contents lists available, creativecommons, published by, accepted, received, available online"
DATA_WORDS = "yes, no, linear fit, control, treated, untreated, mean, max, min, sd, cv, rate, grade"
VERBS = "is, are, was, were, has, have, had, shows?, showed, indicates?, suggests?, observed, found, measured, exhibited, indicated"
MENTION_WORDS = "shows?, presents?, lists?, summari[sz]es?, reports?, provides?, indicates?, illustrates?, demonstrates?, contains?, is, are, was, were, has, have, and, or, for, in, from, with, without, of, to, for more details"
PROSE_STARTS = "as shown, as can be seen, the results, these results, this, these, therefore, moreover, furthermore, in addition, a summary, we, our, it is"
END_WORDS = "references, declaration of competing interest, credit authorship, acknowledg*, data availability"
_CAPTION = r"(?i)^\s*Table\s+((?:S\s*)?\d+[A-Za-z]?|[A-Z]\.\s*\d+|[IVXLC]+)\b\.?\s*(.*)$"


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def digit_share(line: Column, signs: str = QUALITY_SIGNS) -> Column:
    """The share of digits and of the ``signs`` of numbers in a line; 0 for an empty one."""
    s = F.trim(line)
    cls = "".join("\\" + x if x in r"-[]^\/" else x for x in signs)
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(s, f"[^0-9{cls}]", "")), F.length(s)), F.lit(0.0))


def n_words(line: Column, least: int) -> Column:
    return F.regexp_count(line, F.lit(f"[A-Za-z]{{{least},}}"))


def data_like(line: Column) -> Column:
    """A line of values: digits, or two to ten short words without a full stop, or a word of tables."""
    n = F.size(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""))
    return (digit_share(line) >= 0.10) | ((n >= 2) & (n <= 10) & ~F.trim(line).endswith(".")) | line.rlike("(?i)" + phrases(DATA_WORDS))


def prose_like(line: Column) -> Column:
    """A line of running text: long, few digits, eight words or more and a verb."""
    return (F.length(F.trim(line)) >= 45) & (digit_share(line) < 0.18) & (n_words(line, 3) >= 8) & line.rlike("(?i)" + phrases(VERBS))


def footer_line(line: Column) -> Column:
    """Page furniture: a publisher's words, ``Name et al.``, or a journal with volume, year and pages."""
    return line.rlike("(?i)" + phrases(FOOTER_WORDS)) | line.contains("doi.org") | line.rlike(r"^\s*(?:\d+\s*)?[A-Z][A-Za-z .-]+\s+et\s+al\.?\s*$") | line.rlike(r"^\s*[A-Z][A-Za-z &-]+\s+\d+\s*\([^)]*\)\s*\d+[-–]\d+\s*$")


def stop_line(line: Column) -> Column:
    """A line that can't be part of a table: a figure's caption, a numbered heading, furniture or back matter (F17). A bare number is no stop, as it may be a cell."""
    return line.rlike(r"(?i)^\s*(?:fig(?:ure)?|scheme)\.?\s+[SA]?\d+") | line.rlike(r"^\s*\d+(?:\.\d+)*\.?\s+[A-Z][a-z]{3,}(?:\s+[A-Za-z]+){0,7}\s*$") | footer_line(line) | line.rlike(r"(?i)^\s*" + phrases(END_WORDS))


def is_mention(line: Column) -> Column:
    """``Table 1 shows ...``: a reference in prose, not a caption."""
    return F.regexp_extract(line, _CAPTION, 2).rlike("(?i)^" + phrases(MENTION_WORDS))


def caption_number(line: Column) -> Column:
    """The number of a line that begins a table's caption; null for mentions, for a lower-case rest and for a rest that begins with a sign."""
    rest = F.regexp_extract(line, _CAPTION, 2)
    ok = line.rlike(_CAPTION) & ~is_mention(line) & ~rest.rlike(r"^[)\].,;:]") & ~rest.rlike(r"^[a-z]")
    return F.when(ok, F.regexp_extract(line, _CAPTION, 1))


def before_first(lines: Column, stop: Column) -> Column:
    """The lines before the first for which ``stop`` (an array of booleans of equal length) holds."""
    at = F.array_position(stop, True)
    return F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines)


def seen_before(flags: Column, n: int) -> Column:
    """For each element whether ``n`` of those before it are true."""
    places = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda x: x.isNotNull())
    nth = F.get(places, F.lit(n - 1))
    return F.transform(flags, lambda f, i: F.coalesce(nth < i, F.lit(False)))


def trailing_prose(lines: Column) -> Column:
    """The lines up to where running text begins after at least two lines of values (F16, F18): a paragraph's beginning, a sentence, furniture or back matter."""
    data = F.transform(lines, data_like)
    late = seen_before(data, 2)
    starts = F.transform(lines, lambda x: prose_like(x) | (x.rlike(r"(?i)^\s*" + phrases(PROSE_STARTS)) & (n_words(x, 3) >= 4)) | x.rlike(r"(?i)^\s*" + phrases(END_WORDS)))
    stop = F.zip_with(starts, late, lambda a, b: a & b)
    return before_first(lines, stop)


def clean_body(c: Column) -> Column:
    """``(body, reasons)``: a table's lines without furniture, up to the next block or the running text behind it."""
    lines = lines_of(c)
    inner = F.filter(lines, lambda x: ~footer_line(x))
    block = F.transform(inner, lambda x: x.rlike(r"(?i)^(?:fig(?:ure)?\.?\s+\d+|" + phrases(END_WORDS) + ")"))
    cut = before_first(inner, block)
    kept = trailing_prose(cut)
    reasons = F.array_compact(F.array(F.when(F.size(cut) < F.size(inner), "cut_at_non_table_block"), F.when(F.size(inner) < F.size(lines), "removed_header_footer_line"), F.when(F.size(kept) < F.size(cut), "removed_trailing_prose")))
    return F.struct(F.array_join(kept, "\n").alias("body"), reasons.alias("reasons"))


def clean_caption(c: Column, most: int = 500) -> Column:
    """``(caption, reasons)``: a table's caption up to the next block, body text or equation that ran into it."""
    lines = lines_of(c)
    length = lambda i: F.length(F.array_join(F.slice(lines, 1, F.greatest(i, F.lit(1))), " "))
    tests = {
        "caption_cut_at_next_block": lambda x, i: (i > 0) & x.rlike(r"(?i)^(?:fig(?:ure)?\.?\s+\d+|table\s+\d+|\d+(?:\.\d+)*\.?\s+[A-Z])\b"),
        "caption_body_leakage_removed": lambda x, i: (i > 0) & x.rlike(r"^(?:The|This|These|Those|There|In|For|As|We|Our)\b") & (length(i) > 30),
        "caption_equation_or_body_leakage_removed": lambda x, i: x.rlike(r"(?i)\bEqs?\.\s*\(|\bCalculation indexes\b|\bDetermination of the total\b"),
        "caption_truncated_long": lambda x, i: (i > 0) & (length(i) > most),
    }
    at = {k: F.array_position(F.transform(lines, f), True) for k, f in tests.items()}
    first = F.array_min(F.array_compact(F.array(*[F.when(p > 0, p) for p in at.values()])))
    kept = F.when(first.isNotNull(), F.slice(lines, 1, (first - 1).cast("int"))).otherwise(lines)
    why = F.array_compact(F.array(F.when(F.size(lines) == 0, "empty_caption"), *[F.when(p == first, F.lit(k)) for k, p in at.items()]))
    return F.struct(F.array_join(kept, "\n").alias("caption"), F.slice(why, 1, 1).alias("reasons"))


def quality(body: Column, caption: Column) -> Column:
    """``(score, needs_review, reasons)``: 0 to 0.95 after penalties for what a good table wouldn't have."""
    lines = lines_of(body)
    n, data, prose = F.size(lines), F.size(F.filter(lines, data_like)), F.size(F.filter(lines, prose_like))
    b = F.coalesce(body, F.lit(""))
    tests = {
        "missing_caption": (F.trim(F.coalesce(caption, F.lit(""))) == "", 0.10),
        "empty_table_body": (n == 0, 0.95),
        "too_few_table_lines": ((n > 0) & (n < 3), 0.35),
        "very_short_recovered_table": ((n >= 3) & (n <= 6) & (F.length(F.trim(b)) < 140), 0.30),
        "few_data_like_lines": ((n > 0) & (data < 2), 0.25),
        "possible_prose_leakage": ((prose > 0) & (prose >= F.greatest(F.lit(2), data)), 0.25),
        "header_footer_leakage": (b.rlike("(?i)" + phrases(FOOTER_WORDS)) | b.contains("doi.org"), 0.20),
        "equation_or_paragraph_leakage": (b.rlike(r"(?i)\bEquation\b|\bEqs?\.\s*\(|\bCalculation indexes\b"), 0.20),
        "nested_table_caption_in_body": (b.rlike(r"(?i)\bTable\s+\d+\b"), 0.10),
    }
    score = F.lit(0.85) - sum((F.when(hit, F.lit(cost)).otherwise(F.lit(0.0)) for hit, cost in tests.values()), F.lit(0.0))
    score = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(0.95)), 6)
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, (hit, _) in tests.items()])))
    grave = F.arrays_overlap(reasons, F.array(*map(F.lit, ("empty_table_body", "too_few_table_lines", "possible_prose_leakage", "equation_or_paragraph_leakage"))))
    return F.struct(score.alias("score"), ((score < 0.70) | grave).alias("needs_review"), reasons.alias("reasons"))


def same_table(label_a: Column, body_a: Column, label_b: Column, body_b: Column, least: float = 0.6) -> Column:
    """Whether two records are one table: the same number, and most of the shorter one's lines in the other."""
    number = lambda c: F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"([SA]?\.?\d+)", 1))
    a, b = F.array_distinct(lines_of(body_a)), F.array_distinct(lines_of(body_b))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    return (number(label_a) == number(label_b)) & (number(label_a) != "") & (shared >= least)
