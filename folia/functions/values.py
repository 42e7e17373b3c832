"""Scalar rules: casts, years, keys, categories, scores. Everything is a column expression and stays in generated code."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Spellings of "missing".
MISSING = ["", "nan", "na", "none", "null", "n/a"]


def resolve(df: DataFrame, candidates: Iterable[str], suffix: bool = False) -> str | None:
    """A column's real name: exact, then without case, then (``suffix``) the only column that ends so. Metadata only (PRJ1)."""
    names = df.columns
    lower = {n.lower(): n for n in reversed(names)}
    for c in candidates:
        if c in names:
            return c
        if c.lower() in lower:
            return lower[c.lower()]
    if suffix:
        for c in candidates:
            ends = [n for n in names if n.lower().endswith(c.lower())]
            if len(ends) == 1:
                return ends[0]
    return None


def first_value(*cols: Column) -> Column:
    """The first value that isn't blank (PRJ1, PRJ2, F43)."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string"))) for c in cols])


def number(c: Column) -> Column:
    """A double; null for text that is none, for NaN and infinities. Thousands separators and a percent sign are dropped (PRJ3)."""
    s = F.lower(F.trim(c.cast("string")))
    x = F.when(s.isin(MISSING), None).otherwise(F.regexp_replace(s, "[,%]", "")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def whole(c: Column) -> Column:
    """An int, rounded half to even (PRJ3)."""
    return F.bround(number(c)).cast("int")


def flag(c: Column, yes: Sequence[str] = ("1", "true", "yes", "y", "t"), no: Sequence[str] = ("0", "false", "no", "n", "f")) -> Column:
    """A boolean from its usual spellings, null for others (PRJ3, PRJ8)."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(list(yes)), True).when(s.isin(list(no)), False)


def presence_flag(c: Column) -> Column:
    """As ``flag``, and present, explicit, implied are true, absent is false, any other number is its truth."""
    s = F.lower(F.trim(c.cast("string")))
    return F.coalesce(flag(c), F.when(s.isin("present", "explicit", "implied"), True).when(s == "absent", False), number(c) != 0)


def year_of(c: Column, lo: int = 1900, hi: int = 2100) -> Column:
    """The first four-digit token within the range; tokens are divided by blanks, ``- / .`` (PRJ4)."""
    tokens = F.split(F.translate(c.cast("string"), "-/.", "   "), r"\s+")
    return F.try_element_at(F.filter(tokens, lambda t: t.rlike(r"^\d{4}$") & t.try_cast("int").between(lo, hi)), F.lit(1)).cast("int")


def year_prefix(c: Column) -> Column:
    """The first four characters as a year."""
    return F.substring(F.trim(c.cast("string")), 1, 4).try_cast("int")


def squeeze(c: Column, lower: bool = True) -> Column:
    """Anything but letters and digits as single underscores, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.lower(s) if lower else s


def doi_key(c: Column) -> Column:
    """A DOI as a key: without resolver address, squeezed, lower case (PRJ5)."""
    return squeeze(F.regexp_replace(F.trim(c), r"https?://doi\.org/", ""))


def id_key(c: Column) -> Column:
    """As ``doi_key``, but ``doi:`` is dropped too and case before that (PRJ5)."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "https://doi.org/", ""), "doi:", ""))


def safe_id(c: Column) -> Column:
    """As ``doi_key``, with its case (PRJ5)."""
    return squeeze(F.regexp_replace(F.trim(c), r"https?://doi\.org/", ""), lower=False)


def file_key(c: Column, title: Column | None = None) -> Column:
    """As ``id_key``, for ``dx.`` addresses too; a missing DOI becomes a hash of the title (PRJ5)."""
    s = squeeze(F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", ""))
    other = F.concat(F.lit("missing_doi_"), F.substring(F.sha1(F.coalesce(title, F.lit("")) if title is not None else F.lit("")), 1, 12))
    return F.when(F.coalesce(s, F.lit("")) != "", s).otherwise(other)


def doi_from_folder(c: Column) -> Column:
    """``10.1_abc_d`` to ``10.1/abc_d``: only the first underscore is the slash."""
    return F.regexp_replace(c, "^([^_]*)_", "$1/")


def primary(c: Column, sep: str = ";", missing: str | None = None, slug: bool = False) -> Column:
    """The first of several packed values; ``missing`` stands for none; ``slug`` as a key (PRJ6)."""
    s = F.trim(F.split(c, sep)[0])
    s = F.when(s != "", squeeze(s) if slug else s)
    return s if missing is None else F.coalesce(s, F.lit(missing))


def notes(flags: dict[str, Column], sep: str = ";") -> Column:
    """The names of the flags that hold, joined (PRJ7, PRJ9)."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])), sep)


def missing_fields(cols: Sequence[str]) -> Column:
    """The names of blank columns, joined (PRJ9)."""
    return notes({c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in cols})


def category_score(c: Column, scores: dict[str, float]) -> Column:
    """A category's score, without case; null for unknown ones (PRJ10)."""
    s = F.lower(F.trim(c.cast("string")))
    out = None
    for name, x in scores.items():
        out = F.when(s == name, float(x)) if out is None else out.when(s == name, float(x))
    return out


def likert(c: Column, reverse: bool = False) -> Column:
    """1 to 5 as 0 to 1 (PRJ10)."""
    x = number(c)
    return (5 - x) / 4 if reverse else (x - 1) / 4


def row_mean(*cols: Column) -> Column:
    """The mean of the values that aren't null; null if there are none (PRJ11)."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, total / n)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; 0 where that is undefined (PRJ12)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


@F.pandas_udf(DoubleType())
def _py_round(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(k)) for v, k in zip(x, n, strict=True)], dtype="float64")


def py_round(c: Column, n: int) -> Column:
    """Rounds the binary value half to even, for report columns that must equal a Python report (PRJ13)."""
    return _py_round(c.cast("double"), F.lit(n))


def level_band(c: Column) -> Column:
    """Levels 0-1 low, 2 mid, 3-4 high (PRJ15)."""
    return F.when(c <= 1, "low").when(c == 2, "mid").when(c >= 3, "high")


def method_key(*cols: Column, sep: str = "|") -> Column:
    """Parts that name a method, joined (PRJ16)."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def image_flags(width: Column, height: Column, size: Column, min_side: int = 300, max_side: int = 10_000, wide: float = 3.0, tall: float = 1 / 3, tiny: int = 8_192, huge: int = 20_000_000) -> dict[str, Column]:
    """Flags of an image's size and shape; every threshold is a parameter (PRJ7)."""
    aspect = F.try_divide(width, height)
    return {
        "low_resolution": (width < min_side) | (height < min_side),
        "extreme_resolution": (width > max_side) | (height > max_side),
        "very_wide": aspect > wide,
        "very_tall": aspect < tall,
        "tiny_file": size < tiny,
        "huge_file": size > huge,
    }


def quality_verdict(*parts: Column) -> Column:
    """Failed before needs_review before pass."""
    a = F.array(*parts)
    return F.when(F.array_contains(a, "failed"), "failed").when(F.array_contains(a, "needs_review"), "needs_review").otherwise("pass")


def asset_kind(label: Column, kind: Column) -> Column:
    """Figure, table or scheme, by label first."""
    s = F.lower(F.coalesce(label, F.lit("")))
    return F.when(s.startswith("scheme"), "scheme").when(s.startswith("tab"), "table").when(s.startswith("fig"), "figure").otherwise(F.coalesce(F.lower(kind), F.lit("figure")))


def record_fields(doc: Column, chains: dict[str, list[str]], clean: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """A struct of fields, each the first non-blank value of its chain of paths in a JSON document, in its clean form (F43). An array counts as its first element."""
    out = []
    for name, paths in chains.items():
        found = []
        for p in paths:
            raw = F.trim(F.get_json_object(doc, f"$.{p}"))
            first = F.when(raw.startswith("["), F.get_json_object(doc, f"$.{p}[0]")).otherwise(raw)
            found.append(F.when(F.coalesce(F.trim(first), F.lit("")) != "", F.trim(first)))
        value = F.coalesce(*found)
        out.append((clean or {}).get(name, lambda c: c)(value).alias(name))
    return F.struct(*out)


#: Where a paper's fields may stand; an abstract may have to come from the introduction.
PAPER_FIELDS = {
    "doi": ["doi", "DOI", "metadata.doi", "ids.doi"],
    "title": ["title", "metadata.title", "article_title", "display_name"],
    "abstract": ["abstract", "metadata.abstract", "summary", "sections.introduction"],
    "journal": ["journal", "journal_name", "container_title", "metadata.journal", "host_venue.display_name"],
    "publisher": ["publisher", "metadata.publisher", "host_venue.publisher"],
}
