"""Model replies: salvage of JSON, coercion to a schema, validation, and repair policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def salvage(c: Column) -> Column:
    """A reply without think blocks and code fences, from its first brace to its last."""
    s = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?i)```(?:json)?", "")
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    return F.when((first > 0) & (F.instr(s, "}") > 0) & (last >= first), F.substr(s, first, last - first + 1)).otherwise(F.trim(s))


def without_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",(\s*[}\]])", "$1")


def parse_reply(c: Column) -> Column:
    """``(json, mode)``: direct if the reply is an object as it stands, salvaged, repaired, failed or empty."""
    s = salvage(c)
    r = without_trailing_commas(s)
    ok = lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{")
    blank = c.isNull() | (F.trim(F.coalesce(c, F.lit(""))) == "")
    mode = F.when(blank, "empty").when(ok(c), "direct").when(ok(s), "salvaged").when(ok(r), "repaired").otherwise("failed")
    return F.struct(F.when(blank, F.lit(None)).when(ok(c), c).when(ok(s), s).when(ok(r), r).alias("json"), mode.alias("mode"))


def enum_value(c: Column, allowed: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """An enum's value, spelt regularly, aliases resolved; null for others."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    for a, b in (aliases or {}).items():
        s = F.when(s == a, F.lit(b)).otherwise(s)
    return F.when(s.isin(list(allowed)), s)


def score_value(c: Column, lo: int, hi: int, default: int | None = None) -> Column:
    """A whole score within bounds; ``default`` fills a missing one (F23, F23d; off unless given)."""
    x = F.least(F.greatest(F.bround(c.try_cast("double")).cast("int"), F.lit(lo)), F.lit(hi))
    return x if default is None else F.coalesce(x, F.lit(default))


def changes(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """How many fields coercion changed."""
    return sum((F.when(~a.cast("string").eqNullSafe(b.cast("string")), 1).otherwise(0) for a, b in pairs), F.lit(0))


def first_error(rules: Sequence[tuple[Column, str]]) -> Column:
    """The message of the first rule that fails, null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(msg)) for ok, msg in rules])


#: The nested profile of a paper.
SECTIONS = ("introduction", "methods", "results", "discussion")
RELATIONS = ("intro_to_methods", "methods_to_results", "results_to_discussion")
ENTITY = T.StructType([T.StructField("entity", T.StringType()), T.StructField("type", T.StringType()), T.StructField("visual_proxies", T.ArrayType(T.StringType()))])
PROFILE = T.StructType(
    [
        T.StructField("doi", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("section_summaries", T.StructType([T.StructField(s, T.StringType()) for s in SECTIONS])),
        T.StructField("key_entities", T.StructType([T.StructField(s, T.ArrayType(ENTITY)) for s in SECTIONS])),
        T.StructField("causal_relations", T.StructType([T.StructField(r, T.StringType()) for r in RELATIONS])),
    ]
)


def profile(c: Column) -> Column:
    """A reply as a profile struct, null if it can't be parsed (SRC4, F22)."""
    return F.from_json(parse_reply(c)["json"], PROFILE)


def profile_error(p: Column) -> Column:
    """The first thing wrong with a profile (F24): not parsed, a missing part, a section or entity that isn't there or lacks a field. Missing causal relations count as empty ones."""
    rules = [(p.isNotNull(), "SRP root is not a JSON object")]
    rules += [(p[k].isNotNull(), f"Missing top-level key: {k}") for k in ("doi", "title", "section_summaries", "key_entities")]
    rules += [(p["section_summaries"][s].isNotNull(), f"section_summaries missing section: {s}") for s in SECTIONS]
    for s in SECTIONS:
        es = p["key_entities"][s]
        rules.append((es.isNotNull(), f"key_entities missing section: {s}"))
        whole = F.forall(es, lambda e: e.isNotNull() & e["entity"].isNotNull() & e["type"].isNotNull() & e["visual_proxies"].isNotNull())
        rules.append((whole, f"An entity in {s} is incomplete"))
    return first_error(rules)


def profile_counts(p: Column) -> Column:
    """Entities, proxies, words and relations of a profile, and whether it is ready."""
    ents = F.flatten(F.array(*[F.coalesce(p["key_entities"][s], F.array().cast(T.ArrayType(ENTITY))) for s in SECTIONS]))
    named = F.filter(ents, lambda e: F.coalesce(F.trim(e["entity"]), F.lit("")) != "")
    proxies = F.aggregate(named, F.lit(0), lambda a, e: a + F.size(F.filter(F.coalesce(e["visual_proxies"], F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")))
    rels = sum((F.when(F.coalesce(F.trim(p["causal_relations"][r]), F.lit("")) != "", 1).otherwise(0) for r in RELATIONS), F.lit(0))
    filled = sum((F.when(F.coalesce(F.trim(p["section_summaries"][s]), F.lit("")) != "", 1).otherwise(0) for s in SECTIONS), F.lit(0))
    return F.struct(F.size(named).alias("entities"), proxies.alias("proxies"), F.coalesce(F.try_divide(proxies, F.size(named)), F.lit(0.0)).alias("mean_proxies"), rels.alias("relations"), ((filled == 4) & (F.size(named) > 0)).alias("ready"))
