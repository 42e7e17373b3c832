"""Texts whose end was lost: structural completeness, and how often each source truncates.

A stack automaton reads a text once and says what is still open at its end: typed brackets and quotes, markup, code fences, escapes, broken multibyte sequences. Whether
a missing terminator means anything is judged against the baseline of the source: how its whole texts end. Running text has little structure, so its end is also judged by how
sentences of the corpus end: for the words before the end, and for the frame of the sentence (its usual words, anything else as one place), the share of occurrences at
which a sentence ended, counted over all texts. A field limit shows as a pile-up at a source's greatest length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.scans import fit, repair
from folia.runtime import cut_lineage, not_blank, spread

#: What is written where a text was cut.
_CUT_MARK = re.compile(r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|[<\[(]\s*(?:cut|truncated|snip(?:ped)?|more|continued|abridged)\s*[>\])]|�+)\s*$", re.I)
_STOP = ".!?"
#: A sequence or escape that was not finished: replacement and C1 characters of a cut multibyte character, a lone surrogate, a backslash, half a unicode escape, half an entity.
_HALF = re.compile(r"(?:\ufffd|[\ud800-\udfff]|[\xc2-\xf4][\x80-\x9f]{1,2}|\xe2\u20ac|\\|\\u[0-9A-Fa-f]{0,3}|&(?:#x?[0-9A-Fa-f]*|[a-z]{2,8}))$")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_SIGN = re.compile(r'["()\[\]{}“”«»<]|```')
_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)([^<>]*)(>|$)")
#: Elements that need no end tag.
_NO_END = frozenset(["br", "hr", "img", "input", "meta", "link", "p", "li", "td", "th", "tr", "dt", "dd", "wbr", "col"])


def open_at_end(text: str, prose: bool = False) -> str:
    """What a text leaves open, in the order of opening: brackets ``( [ {``, quotes ``" “ «``, ``<`` for an element or a tag, ``f`` for a code fence, ``\\`` for half an escape or character.

    Empty if the text is complete. A closer belongs to the nearest opener of its own type; openers above that one were never closed and stay open. Closers without an opener are passed
    over (list marks such as ``a)``). In structured text a ``"`` always begins or ends a string, within which only escapes count; in ``prose`` it begins a quotation only after a blank or
    bracket and before a word, so that inch and second signs are none, and round brackets count; in structured text those outside strings are words of the frame and count too.
    """
    stack: list[str] = []
    lost: list[tuple[int, str]] = []  # openers that another closer passed over, with their depth
    names: list[str] = []
    m = _SIGN.search(text)
    while m:
        i, ch, after = m.start(), m[0], m.end()
        if ch == '"':
            if not prose:
                whole = _STRING.match(text, i)
                if not whole:  # the string runs to the end
                    stack.append(ch)
                    break
                after = whole.end()
            else:
                before, behind = text[i - 1 : i], text[i + 1 : i + 2]
                if ch in stack and not before.isspace():
                    _close(stack, lost, ch)
                elif (not before or before.isspace() or before in "([{“«—–/") and (not behind or not behind.isspace()):
                    stack.append(ch)
        elif ch == "```":
            if not text[text.rfind("\n", 0, i) + 1 : i].strip():
                if "f" in stack:
                    _close(stack, lost, "f")
                else:
                    stack.append("f")
        elif ch in _PAIRS:
            _close(stack, lost, _PAIRS[ch])
        elif ch == "<":
            if tag := _TAG.match(text, i):
                name = tag[2].lower()
                if not tag[4]:
                    stack.append("<")
                elif tag[1]:
                    if name in names:
                        while names.pop() != name:
                            _close(stack, lost, "<")
                        _close(stack, lost, "<")
                elif name not in _NO_END and not tag[3].rstrip().endswith("/"):
                    names.append(name)
                    stack.append("<")
                after = tag.end()
        else:
            stack.append(ch)
        m = _SIGN.search(text, after)
    out = "".join(x for _, x in sorted([*lost, *enumerate(stack)], key=lambda x: x[0]))
    return out + ("\\" if _HALF.search(text, max(0, len(text) - 12)) else "")


def _close(stack: list[str], lost: list[tuple[int, str]], opener: str) -> None:
    """Takes the nearest ``opener`` off the stack, and those above it, which no closer of their own can reach any more."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] == opener:
            lost += [(j, stack[j]) for j in range(k + 1, len(stack))]
            del stack[k:]
            return


def is_structured(body: str) -> bool:
    return "{" in body or "```" in body


def ends_with_stop(body: str) -> bool:
    """Whether a text ends with a terminator, closing quotes and brackets set aside."""
    return body.rstrip().rstrip("\"')]}”»*_").endswith(tuple(_STOP))


def reply_is_cut(text: str, noted: int | None, usual_stop: float = 0.95, slack: int = 8, least_stop: float = 0.8) -> bool:
    """A stored reply: structured (it holds a brace or fence) or prose. ``noted`` is its length at run time; a loss of up to ``slack`` blanks is none.

    ``usual_stop`` is the share of its source's whole prose replies that end with a terminator: only from ``least_stop`` on does a missing one tell anything.
    """
    body = text.rstrip()
    if not body:
        return False
    structured = is_structured(body)
    if _CUT_MARK.search(body) or open_at_end(body, not structured):
        return True
    lost = (noted or 0) - len(text)
    return lost > slack or (not structured and usual_stop >= least_stop and not ends_with_stop(body))


# ---------------------------------------------------------------- running text

_TOKEN = re.compile(r"[A-Z][a-z]?-\d+|[^\W\d_]+(?:[-'/][^\W\d_]+)*\d*[^\W_]*|\d+(?:[.,]\d+)*|[^\w\s]")
_LIST_MARK = re.compile(r"(?:(?<=[:.])|^)\s*\(([a-z])\)\s")
_CAPTION_LABEL = re.compile(r"^\s*(?:[A-Za-z]+\.?)\s*[A-Z]?\d+\s*[.:|–-]*\s*")


def sentences(text: str) -> list[tuple[list[str], str]]:
    """Sentences as tokens (numbers ``#``, sample codes ``@``) with the sign that ends each, empty for an end without one."""
    text = _LIST_MARK.sub(" ¦ ", _CAPTION_LABEL.sub("", re.sub(r"\s+", " ", text)))
    out: list[tuple[list[str], str]] = []
    for part in re.split(r"(?<=[.:?!])\s+|\s*¦\s*", text.strip()):
        if not part.strip():
            continue
        end = part[-1] if part[-1] in ".:?!" else ""
        toks = ["#" if t[0].isdigit() else "@" if re.fullmatch(r"[A-Z][a-z]?-\d+", t) else t for t in _TOKEN.findall(part[:-1] if end else part)]
        if toks:
            out.append((toks, end))
    return out


def frame(tokens: list[str], usual: set[str] | frozenset[str]) -> str:
    """The sentence with its usual words; runs of other words are one ``*``."""
    out: list[str] = []
    for t in tokens:
        x = t if t in usual or t in "#@" or not t[0].isalnum() else "*"
        if not (x == "*" and out and out[-1] == "*"):
            out.append(x)
    return " ".join(out)


@dataclass
class EndModel:
    usual: frozenset[str]
    ends: dict[str, tuple[float, float]]  # context to (ends, all)
    known: frozenset[str]
    limits: dict[str, int]
    stops: dict[str | None, float]  # of each source, how much rarer than usual an end without terminator is: a factor of the thresholds

    def end_share(self, tokens: list[str]) -> tuple[float, float]:
        """How often a sentence ends at such a frame, and at such a last word (the pair with the word before it, drawn to the word alone where the pair is rare). A word that never stood inside a text or before a stop is a fragment."""
        last = tokens[-1]
        if last[0].isalpha() and last not in self.known:
            return 0.0, 0.0
        fe, fn = self.ends.get("f " + frame(tokens, self.usual), (0.0, 0.0))
        e1, n1 = self.ends.get("1 " + last, (0.0, 0.0))
        e2, n2 = self.ends.get("2 " + " ".join(tokens[-2:]), (0.0, 0.0))
        by_word = (e1 + 0.1) / (n1 + 1)
        return (fe + 0.2) / (fn + 1), (e2 + 4 * by_word) / (n2 + 4)

    def is_cut(self, raw: str, repaired: str, source: str | None) -> bool:
        body = raw.rstrip()
        if not body:
            return False
        if _CUT_MARK.search(body):
            return True
        text = repaired.rstrip()
        if not text:
            return False
        limit = self.limits.get(source or "")
        near = limit is not None and len(raw) >= limit - 2
        if text[-1] in "-¬‐­(,;[/–|=" or open_at_end(text, prose=True):
            return True
        if re.search(r"[.:]\s*\([a-z]\)$", text):  # a list mark with nothing after it
            return True
        got = sentences(text)
        if not got:
            return near
        tokens, end = got[-1]
        if end and end in _STOP:
            by_frame = self.ends.get("f " + frame(tokens, self.usual), (0.0, 0.0))
            return by_frame[1] >= 30 and by_frame[0] / by_frame[1] < 0.02
        a, b = self.end_share(tokens)
        if near:
            return not (len(raw) < limit and min(a, b) > 0.9)
        r = self.stops.get(source, 1.0)
        return a < 0.05 * r or b < 0.03 * r or end == ":"


def _counts(text: str, usual: frozenset[str], into: dict[str, list[int]]) -> None:
    """Adds the contexts of a text: ``[occurrences, sentence ends, inside or before a stop]``."""
    for tokens, end in sentences(text):
        f, before, final = "f", "", len(tokens) - 1
        for i, t in enumerate(tokens):
            x = t if t in usual or t in "#@" or not t[0].isalnum() else "*"
            if not (x == "*" and f.endswith(" *")):
                f += " " + x
            keys = (f, f"2 {before} {t}" if i else "2 " + t, "1 " + t)
            for key in keys:
                got = into[key]
                got[0] += 1
                got[1] += i == final
            if i < final or end:
                into[t][2] += 1
            before = t


def learn_ends(texts: DataFrame, usual_share: float = 0.002, min_share: float = 2e-6, max_sources: int = 100_000) -> EndModel:
    """Counts sentence ends over *all* of ``texts(source, length, text)``. Contexts of less than ``min_share`` of all counts are left out, so at most ``3 / min_share`` go to the tasks."""
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+(?:-[\p{L}]+)*"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = cut_lineage(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    usual = frozenset(r["w"] for r in words.where(F.col("n") >= total * usual_share).collect())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
            for t in b["text"]:
                _counts(t, usual, got)
            yield pd.DataFrame([(key, *n) for key, n in got.items()], columns=["key", "n", "e", "k"])

    sums = cut_lineage(texts.select("text").mapInPandas(count, "key string, n long, e long, k long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "e", "k")]))
    all_ = sums.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, all_ * min_share)
    kept = sums.where((F.col("n") >= least) | (F.col("k") >= least)).collect()
    ends = {r["key"]: (r["e"], r["n"]) for r in kept if r["n"]}
    known = frozenset(r["key"] for r in kept if r["k"])
    by_len = texts.where(F.col("source").isNotNull()).groupBy("source", "length").agg(F.count("*").alias("n"))
    top = by_len.groupBy("source").agg(F.max("length").alias("most"))
    pile = by_len.join(top, "source").where(F.col("length") >= F.col("most") - 20).groupBy("source", "most").agg(F.sum(F.when(F.col("length") == F.col("most"), F.col("n"))).alias("at"), F.sum(F.when(F.col("length") < F.col("most"), F.col("n"))).alias("below"))
    limited = pile.where((F.col("at") >= 4) & (F.col("at") > 3 * F.coalesce("below", F.lit(0)) / 20)).limit(max_sources + 1).collect()
    if len(limited) > max_sources:
        raise ValueError(f"more than {max_sources} sources with a field limit")
    return EndModel(usual, ends, known, {r["source"]: r["most"] for r in limited}, stop_factors(texts, max_sources))


def stop_factors(texts: DataFrame, max_sources: int, weight: float = 50.0) -> dict[str | None, float]:
    """Of each source, the usual share of ends without terminator over its own, within 1/3 and 3: where such ends are rare, each is more suspicious. Shares are drawn to the overall one by ``weight`` texts."""
    bare = (~F.rtrim("text").rlike(r"[.!?][\"')\]}”»]*$")).cast("double")
    rows = texts.groupBy("source").agg(F.count("*").alias("n"), F.sum(bare).alias("bare")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    n = sum(r["n"] for r in rows)
    usual = (sum(r["bare"] for r in rows) + 1.0) / (n + 2.0)
    return {r["source"]: min(3.0, max(1 / 3, usual / ((r["bare"] + weight * usual) / (r["n"] + weight)))) for r in rows}


def cut_captions(figures: DataFrame, key: str = "fig_row_id", source: str = "source", text: str = "caption") -> DataFrame:
    """``(key, source, truncated)`` for every non-blank caption. Scan noise is repaired first, so that a misread or furniture line at the end isn't taken for a cut.

    Null and blank captions have no row; null sources have no limit; repeated rows give repeated results; texts are read whole; an empty table gives none.
    """
    src = figures.select(figures[key].alias("_key"), figures[source].alias("_source"), figures[text].alias("text")).where(not_blank(F.col("text"))).withColumn("is_table", F.lit(False))
    fixed = cut_lineage(repair(src, ["_key", "_source", "text"], fit(src.select("text", "is_table"))).select("_key", "_source", "text", "repaired"))
    model = learn_ends(fixed.select(F.col("_source").alias("source"), F.length("text").alias("length"), F.col("repaired").alias("text")))
    shared = figures.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shared.value.is_cut(t, r, s if isinstance(s, str) else None) for t, r, s in zip(b["text"], b["repaired"], b["_source"], strict=True)]
            yield pd.DataFrame({key: b["_key"], "source": b["_source"], "truncated": got})

    return fixed.mapInPandas(judge, f"`{key}` {figures.schema[key].dataType.simpleString()}, source string, truncated boolean")


def cut_replies(results: DataFrame, key: str = "result_id", model: str = "model", text: str = "raw_output", noted: str = "raw_output_length", max_sources: int = 100_000) -> DataFrame:
    """``(key, model, truncated)`` for every stored non-blank reply; the noted length counts only where it is known.

    The baseline of terminators is counted per model over all prose replies without another sign of a cut, drawn to the share over all models by five replies. No reply is shuffled.
    Null and blank replies have no row; a null model is a source of its own; more than ``max_sources`` models raise an error.
    """
    src = spread(results.select(results[key].alias("_key"), results[model].alias("_model"), results[text].alias("_text"), results[noted].alias("_noted")).where(not_blank(F.col("_text"))))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(m, int(ends_with_stop(t))) for m, t in zip(b["_model"], b["_text"], strict=True) if not is_structured(t) and not reply_is_cut(t, None, 0.0)]
            yield pd.DataFrame(rows, columns=["m", "stop"])

    got = src.where(~F.col("_text").contains("{") & ~F.col("_text").contains("```")).select("_model", "_text").mapInPandas(ends, "m string, stop int").groupBy("m").agg(F.count("*").alias("n"), F.sum("stop").alias("s")).limit(max_sources + 1).collect()
    if len(got) > max_sources:
        raise ValueError(f"more than {max_sources} models")
    usual = (sum(r["s"] for r in got) + 0.95) / (sum(r["n"] for r in got) + 1.0)
    stops = {r["m"]: (r["s"] + 5 * usual) / (r["n"] + 5) for r in got}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [reply_is_cut(t, None if pd.isna(n) else int(n), stops.get(m if isinstance(m, str) else None, usual)) for t, n, m in zip(b["_text"], b["_noted"], b["_model"], strict=True)]
            yield pd.DataFrame({key: b["_key"], "model": b["_model"], "truncated": cut})

    return src.mapInPandas(judge, f"`{key}` {results.schema[key].dataType.simpleString()}, model string, truncated boolean")


def cut_shares(found: DataFrame, by: str) -> DataFrame:
    """``(by, n_texts, n_cut, share)`` per source or model; null is a group of its own."""
    return found.groupBy(by).agg(F.count("*").alias("n_texts"), F.sum(F.col("truncated").cast("long")).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))
