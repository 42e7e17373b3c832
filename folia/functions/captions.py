"""Captions: several in one text, references that are none, body text that ran into them, and their traces in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.text import _KIND, clean_artifacts, parse_label, phrases

#: What ends a caption: back matter and program text, and how a paragraph of body text begins.
STOP_WORDS = "credit authorship, declaration of competing interest, acknowledge?ments?, appendix [A-Z], references, usertype"
BODY_STARTS = "In the, For the, The scheme, The first, Then, Next, After executing, As already mentioned, Please note"
BODY_WORDS = "in this paper, in this section, the remainder of this paper, credit authorship, declaration of competing interest, references"


def strip_tagged(c: Column) -> Column:
    """Without the marks of tagged documents such as ``Tagged Figure 2``."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)\bTagged\s+(?:P|H\d|Figure|Table|Caption|Span|Link|Artifact)\b\s*\d*", " "), r"\s+", " "))


def is_cross_reference(c: Column) -> Column:
    """A label with a pointer to other material, not a caption: ``Table 19, available online``."""
    return F.trim(F.coalesce(c, F.lit(""))).rlike(r"(?i)^(?:fig(?:ure)?|table|scheme)\s+[SAE]?\d+\b[^.]{0,40}\b(?:available\s+online|in\s+the\s+(?:supplement|appendix)|supplementary)")


def split_merged(c: Column) -> Column:
    """An array of ``(id, key, kind, number, caption)``: the text from each label up to the next; of one id the longest, in order of first appearance (F7). Empty for no label."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), f"({_KIND})", "\x01$0")
    parts = F.filter(F.slice(F.split(marked, "\x01"), 2, 10_000_000), lambda p: p != "")
    strip = lambda p: F.regexp_replace(F.trim(p), r"^[\s.;:]+|[\s.;:]+$", "")
    recs = F.transform(parts, lambda p: F.struct(parse_label(p)["id"].alias("id"), parse_label(p)["key"].alias("key"), parse_label(p)["kind"].alias("kind"), parse_label(p)["number"].alias("number"), strip(p).alias("caption")))
    recs = F.filter(recs, lambda r: r["id"].isNotNull())
    ids = F.array_distinct(F.transform(recs, lambda r: r["id"]))
    longest = lambda i: F.array_sort(F.transform(F.filter(recs, lambda r: r["id"] == i), lambda r: F.struct((-F.length(r["caption"])).alias("n"), r.alias("r"))))[0]["r"]
    return F.transform(ids, longest)


def caption_issues(c: Column) -> Column:
    """``(quality, reasons)``: missing, suspicious or good."""
    s = clean_artifacts(F.coalesce(c, F.lit("")))
    words = F.size(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    reasons = F.array_compact(F.array(F.when(words < 5, "very_short_caption"), F.when((words > 250) | (F.length(s) > 1400), "suspiciously_long_caption"), F.when(s.rlike("(?i)" + phrases(BODY_WORDS)), "possible_body_text_leakage")))
    quality = F.when(s == "", "missing").when(F.size(reasons) > 0, "suspicious").otherwise("good")
    return F.struct(quality.alias("quality"), F.when(s == "", F.array(F.lit("empty_caption"))).otherwise(reasons).alias("reasons"))


def cut_at(c: Column, soft: int = 400, hard: int = 650, least: int = 80) -> Column:
    """Up to ``hard`` characters: the whole if it is short, else cut after the last sentence, bracket or clause end, if that leaves ``least`` characters."""
    head = F.substring(c, 1, hard)
    end = F.regexp_extract(head, r"(?s)^(.*(?:\.|\);|\])) ", 1)
    return F.when(F.length(c) <= hard, c).otherwise(F.regexp_replace(F.when(F.length(end) >= least, end).otherwise(head), r"[ ,;:]+$", ""))


def earliest_marker(c: Column, markers: str, after: int) -> Column:
    """What stands before the first of some markers, if that is beyond ``after`` characters; else the whole."""
    head = F.regexp_extract(c, rf"(?s)^(.{{{after},}}?)\s*{phrases(markers)}", 1)
    return F.when(head != "", F.regexp_replace(head, r"[ ,;:]+$", "")).otherwise(c)


def sanitise(c: Column) -> Column:
    """A caption without the back matter, program text and body paragraphs that ran into it, of at most 650 characters.

    Lines after the first end it where they begin back matter or, once something of a caption stands, body text; so do markers within a line.
    """
    s = clean_artifacts(F.coalesce(c, F.lit("")))
    lines = F.filter(F.split(s, "\n"), lambda x: F.trim(x) != "")
    stop = lambda x: x.rlike(r"(?i)^\s*" + phrases(STOP_WORDS)) | x.rlike(r"^\s*" + phrases(BODY_STARTS))
    first_stop = F.array_position(F.transform(lines, lambda x, i: (i > 0) & stop(x)), True)
    kept = F.when(first_stop > 0, F.slice(lines, 1, F.greatest(first_stop - 1, F.lit(1)).cast("int"))).otherwise(lines)
    one = F.array_join(kept, "\n")
    return cut_at(earliest_marker(earliest_marker(one, STOP_WORDS.replace("appendix [A-Z]", "appendix"), 25), BODY_STARTS, 60))


def caption_pattern(c: Column, words: int = 12) -> Column:
    """A pattern for a caption's first ``words`` words with any blanks and line breaks between them; null for captions of under five words, which could stand anywhere."""
    w = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")
    quoted = F.transform(F.slice(w, 1, words), lambda x: F.regexp_replace(x, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"))
    return F.when(F.size(w) >= 5, F.array_join(quoted, r"\s+"))


def remove_leaked(text: Column, captions: Column, marks: Column) -> Column:
    """Running text in which each caption that stands in it is replaced by its mark, once (F19). ``captions`` and ``marks`` are arrays of equal length."""
    pairs = F.arrays_zip(captions.alias("c"), marks.alias("m"))

    def one(acc: Column, p: Column) -> Column:
        pattern = caption_pattern(p["c"])
        hit = F.call_function("regexp_extract", acc, F.concat(F.lit("(?s)("), F.coalesce(pattern, F.lit(r"\A\b\B")), F.lit(r"(?:(?<=\.)|[^\n]{0,400}?(?:\.(?=\s|$)|(?=\n)|$)))")), F.lit(1))
        at = F.instr(acc, hit)
        return F.when((hit != "") & (at > 0), F.concat(F.substr(acc, F.lit(1), at - 1), F.lit(" "), p["m"], F.lit(" "), F.substr(acc, at + F.length(hit)))).otherwise(acc)

    return F.aggregate(pairs, text, one)


def front_matter_pages(pages: Column, first: int = 8) -> Column:
    """``(page, classes)`` of the pages among the first ``first`` that show front matter, from 1."""
    tests = {"abstract": r"(?i)\babstract\b", "keywords": r"(?i)\bkey\s?words?\b", "history": r"(?i)\b(?:received|accepted|published online)\b.{0,40}\d{4}", "licence": r"(?i)creative commons|©|all rights reserved", "contact": r"[\w.+-]+@[\w-]+\.\w+"}
    classes = lambda p: F.array_compact(F.array(*[F.when(p.rlike(x), F.lit(k)) for k, x in tests.items()]))
    rows = F.transform(F.slice(pages, 1, first), lambda p, i: F.struct((i + 1).alias("page"), classes(F.coalesce(p, F.lit(""))).alias("classes")))
    return F.filter(rows, lambda r: F.size(r["classes"]) > 0)


def caption_from_pages(label: Column, page: Column, pages: Column, most: int = 1200) -> Column:
    """The text that begins with a figure's label on its page or the next, up to a blank line or ``most`` characters; null if neither has it."""
    key = parse_label(label)
    word = F.when(key["kind"] == "figure", r"fig(?:ure)?\.?").when(key["kind"] == "table", r"table").otherwise("scheme")
    pattern = F.concat(F.lit(r"(?is)(?:^|\n)\s*("), word, F.lit(r"\s*"), key["prefix"], F.lit(r"\.?"), key["number"].cast("string"), F.lit(r"(?!\d)[^\n]*(?:\n(?!\s*\n)[^\n]+)*)"))
    on = lambda p: F.trim(F.call_function("regexp_extract", F.coalesce(F.get(pages, p - 1), F.lit("")), F.coalesce(pattern, F.lit(r"\A\b\B()")), F.lit(1)))
    here, there = on(page), on(page + 1)
    return F.when(key.isNotNull() & (here != ""), F.substring(here, 1, most)).when(key.isNotNull() & (there != ""), F.substring(there, 1, most))
