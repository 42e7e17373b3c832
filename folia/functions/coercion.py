"""A model's judgement brought to its schema by one policy for all fields, with a count of changes, and the first thing that is still wrong."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Schema:
    """The fields of a judgement by kind. ``enums``: allowed values; ``scores``: lowest and highest; ``counts``: the least; others by name."""

    enums: Mapping[str, Sequence[str]] = field(default_factory=dict)
    scores: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    counts: Mapping[str, int] = field(default_factory=dict)
    booleans: Sequence[str] = ()
    lists: Sequence[str] = ()
    strings: Sequence[str] = ()

    @property
    def names(self) -> list[str]:
        return [*self.counts, *self.enums, *self.scores, *self.booleans, *self.lists, *self.strings]


@dataclass(frozen=True)
class Policy:
    """What may be changed. Strict (no ``aliases``, no ``defaults``) only normalises and never invents; ``aliases`` maps spellings to allowed values by field; ``defaults`` fills what is missing (off by default)."""

    aliases: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    key_aliases: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    clamp: bool = False


STRICT = Policy()


def raw_fields(json: Column, schema: Schema, policy: Policy = STRICT) -> dict[str, Column]:
    """Each field as a variant, under its own name or an alias of it; null for a reply that is no object."""
    v = F.try_parse_json(json)
    path = lambda n: F.try_variant_get(v, f"$['{n}']", "variant")
    return {n: F.coalesce(path(n), *[path(a) for a, real in policy.key_aliases.items() if real == n]) for n in schema.names}


def coerce(json: Column, schema: Schema, policy: Policy = STRICT) -> Column:
    """A struct of all fields in their types, and ``n_changed``: how many fields were not as they should be (F23, F23a, F23b, F23d).

    Missing lists and strings become empty. Enums are spelt regularly (lower case, underscores) and, by the policy, recoded. Numbers as text count; scores are rounded, and clamped only if
    the policy says so; counts are raised to their least. ``true``, ``yes``, ``1``, ``y`` and their opposites are booleans. What can't be read stays null, for ``first_error`` to find.
    """
    raw = raw_fields(json, schema, policy)
    out: dict[str, Column] = {}
    changed = F.lit(0)
    for n in schema.names:
        v = raw[n]
        kind = F.schema_of_variant(v)
        present = v.isNotNull() & (kind != "VOID")
        text = F.try_variant_get(v, "$", "string")
        if n in schema.lists:
            ok = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
            new = F.when(ok, F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
            out[n], touched = new, ~ok
        elif n in schema.strings:
            ok = F.coalesce(kind == "STRING", F.lit(False))
            out[n], touched = F.when(present, text).otherwise(F.lit("")), ~ok
        elif n in schema.enums:
            new = F.when(F.coalesce(kind == "STRING", F.lit(False)), F.regexp_replace(F.lower(F.trim(text)), r"[ -]", "_"))
            for a, b in policy.aliases.get(n, {}).items():
                new = F.when(new == a, F.lit(b)).otherwise(new)
            out[n], touched = new, present & ~new.eqNullSafe(text)
        elif n in schema.scores or n in schema.counts:
            new = F.when(F.coalesce(kind != "BOOLEAN", F.lit(False)), F.bround(text.try_cast("double")).cast("int"))
            if n in schema.counts:
                new = F.greatest(new, F.when(new.isNotNull(), F.lit(schema.counts[n])))
            elif policy.clamp:
                lo, hi = schema.scores[n]
                new = F.when(new.isNotNull(), F.least(F.greatest(new, F.lit(lo)), F.lit(hi)))
            out[n], touched = new, new.isNotNull() & (F.coalesce(kind == "STRING", F.lit(True)) | (text.try_cast("double") != new))
        else:
            s = F.lower(F.trim(text))
            new = F.when(s.isin("true", "yes", "1", "y"), True).when(s.isin("false", "no", "0", "n"), False)
            out[n], touched = new, new.isNotNull() & ~F.coalesce(kind == "BOOLEAN", F.lit(False))
        if n in policy.defaults:
            d = policy.defaults[n]
            value = F.array(*map(F.lit, d)).cast("array<string>") if isinstance(d, (list, tuple)) else F.lit(d)
            touched = touched | out[n].isNull()
            out[n] = F.coalesce(out[n], value)
        changed = changed + F.coalesce(touched, F.lit(False)).cast("int")
    whole = F.try_parse_json(json).isNotNull() & F.trim(json).startswith("{")
    return F.when(whole, F.struct(*[c.alias(n) for n, c in out.items()], changed.alias("n_changed")))


def first_error(c: Column, schema: Schema) -> Column:
    """The first thing wrong with a coerced judgement, null if nothing is."""
    rules = [(c.isNotNull(), "root is not a JSON object")]
    rules += [(c[n].isNotNull(), f"missing or unreadable {n}") for n in schema.counts]
    rules += [(c[n].isin(list(allowed)), f"{n} invalid value") for n, allowed in schema.enums.items()]
    rules += [(c[n].between(lo, hi), f"{n} not an int in [{lo},{hi}]") for n, (lo, hi) in schema.scores.items()]
    rules += [(c[n].isNotNull(), f"{n} not a boolean") for n in schema.booleans]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(msg)) for ok, msg in rules])


#: Other names of the sections of a profile; what has no section belongs to the discussion.
SECTION_ALIASES = {"intro": "introduction", "background": "introduction", "method": "methods", "methodology": "methods", "materials_and_methods": "methods", "result": "results", "findings": "results", "conclusion": "discussion", "conclusions": "discussion", "summary": "discussion", "results_and_discussion": "discussion"}


def section_map(json: Column) -> Column:
    """``map<section, text>`` of an object whose keys are sections under any of their names; texts of one section are joined, unknown keys count as discussion."""
    m = F.map_entries(F.from_json(json, T.MapType(T.StringType(), T.StringType()), {"allowUnquotedControlChars": "true"}))
    spelt = lambda k: F.regexp_replace(F.lower(F.trim(k)), r"[\s&-]+", "_")
    known = F.create_map(*[x for kv in {**{s: s for s in ("introduction", "methods", "results", "discussion")}, **SECTION_ALIASES}.items() for x in map(F.lit, kv)])
    named = F.transform(m, lambda e: F.struct(F.coalesce(F.try_element_at(known, spelt(e["key"])), F.lit("discussion")).alias("k"), e["value"].alias("v")))
    keys = F.array_distinct(F.transform(named, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(named, lambda e: e["k"] == k), lambda e: e["v"]), "\n\n").alias("value"))))
