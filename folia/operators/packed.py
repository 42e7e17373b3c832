"""Several values packed in one field, to one row per value.

A cell is cut into atoms at every possible delimiter; quoted spans stay whole. All runs of atoms form a lattice. A unigram model over values
(how often each value occurs) and over delimiters (how often each one separates) is learned from the whole column by
expectation-maximisation: each distinct cell is a forward-backward pass in an Arrow batch, expected counts are summed by Spark. The model that
goes back to the tasks keeps values of at least ``min_share`` of the mass, so it has at most ``1 / min_share`` entries however large the column.
Viterbi then gives each cell its likeliest split.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.runtime import cut_lineage, not_blank, per_worker, spread

#: Fixed words for "no value here", compared without case.
PLACEHOLDERS = frozenset(["", "-", "--", "–", "?", "n/a", "na", "n.a.", "nan", "none", "null", "nil", "unknown", "unmatched", "unknown/unmatched", "tbd", "todo", "pending", "not available", "not known"])
_QUARTILE = re.compile(r"\s*[\(\[]?\s*Q[1-4]\s*[\)\]]?\s*$")
_ISSN_LABEL = re.compile(r"(?i)\b(?:[epl][\s-]?)?issn(?:-l)?\b\s*[:.=]?|\((?:print|online|linking|electronic|e|p|l)\)")
_DASH = re.compile(r"\s*[-‐‑‒–—−]\s*")
_ISSN = re.compile(r"(\d{4})-?(\d{3}[\dX])")
_OPEN, _CLOSE = "[({", "])}"


@dataclass(frozen=True)
class Field:
    """How one kind of packed field is read.

    ``delimiters``: characters that may separate values. ``clean``: a segment's text as a value (its key in the model and in the list).
    ``shape``: what the model counts instead of the value itself (for codes, whose values hardly repeat). ``listed``: keys known beforehand, to the value to write.
    ``widest``: how many atoms an unquoted value may have; as many as the longest listed value has, and ``least_width`` at least.
    """

    delimiters: str
    clean: Callable[[str], str]
    shape: Callable[[str], str]
    listed: dict[str, str] = field(default_factory=dict)
    least_width: int = 8
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    @cached_property
    def widest(self) -> int:
        return max([self.least_width, *(len(atoms(v or k, self.delimiters)) for k, v in self.listed.items())])


def clean_category(s: str) -> str:
    s = s.strip().strip("•·").strip()
    s = _QUARTILE.sub("", s)
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        s = s[1:-1].replace('""', '"') if s[0] == '"' else s[1:-1]
    return _QUARTILE.sub("", re.sub(r"\s+", " ", s.replace('\\"', '"').replace("\\'", "'"))).strip()


def clean_issn(s: str) -> str:
    s = _DASH.sub("-", _ISSN_LABEL.sub(" ", s)).strip(" \t\r\n\xa0\"'-;,|/()[]").upper()
    m = _ISSN.fullmatch(s)
    return f"{m[1]}-{m[2]}" if m else s


def issn_shape(v: str) -> str:
    return re.sub(r"[0-9]", "9", re.sub(r"(?<=\d{3})X\b", "9", v))


def category_field(categories: list[str]) -> Field:
    return Field(";,|/\t\n\r•", clean_category, str.casefold, {c.casefold(): c for c in categories})


def issn_field() -> Field:
    return Field(";,|/\t\n\r \xa0", clean_issn, issn_shape, {"9999-9999": ""})


def atoms(s: str, delimiters: str) -> list[tuple[int, int, str]]:
    """``(start, end, delimiter that follows)`` of each atom; quotes and list literals are understood, a quote that never closes is an ordinary character."""
    body, shift = s, 0
    if len(s) > 2 and s[0] == "[" and s.rstrip()[-1] == "]" and s.lstrip("[ ")[:1] in "\"'":
        shift, body = 1, s.rstrip()[:-1]
    out, i, n, start = [], shift, len(body), shift
    fresh = True  # nothing but blanks since the last delimiter
    while i < n:
        ch = body[i]
        if fresh and ch in "\"'":
            j = i + 1
            while j < n:
                if body[j] == "\\" and j + 1 < n:
                    j += 2
                elif body[j] == ch and body[j + 1 : j + 2] == ch and ch == '"':
                    j += 2
                elif body[j] == ch and (j + 1 == n or body[j + 1] in delimiters or body[j + 1].isspace()):
                    break
                else:
                    j += 1
            if j < n:
                i, fresh = j + 1, False
                continue
        if ch in delimiters:
            out.append((start, i, ch))
            start, fresh = i + 1, True
        elif not ch.isspace():
            fresh = False
        i += 1
    out.append((start, n, ""))
    return out


@dataclass
class Model:
    """Shares of values and, of each delimiter, the share of its places where it separates."""

    theta: dict[str, float]
    split: dict[str, float]
    listed: frozenset[str]

    @cached_property
    def logs(self) -> dict[str, float]:
        return {k: math.log(x) for k, x in self.theta.items() if x > 0}

    @cached_property
    def cuts(self) -> dict[str, tuple[float, float]]:
        """Of each delimiter the log chances that it separates and that it doesn't."""
        return {d: (math.log(max(1e-6, x)), math.log(max(1e-6, 1 - x))) for d, x in self.split.items()}

    def score(self, key: str, inner: int) -> float:
        """Log weight of a segment: its share; of an unknown one, less the longer it is; an unlisted one that spans delimiters pays for each."""
        if key in PLACEHOLDERS:
            return -5.0 - 6.0 * inner * bool(key == "")
        known = self.logs.get(key)
        return (-12.0 - 0.2 * len(key) if known is None else known) - (4.0 * inner if inner and key not in self.listed else 0.0)


#: Keys of segments seen by this worker, of each field by itself: segments recur far more often than cells.
_KEYS: dict[str, dict[str, str]] = {}


def _key(f: Field, segment: str) -> str:
    own = _KEYS.get(f.uid)
    if own is None:
        if len(_KEYS) >= 8:
            _KEYS.clear()
        own = _KEYS[f.uid] = {}
    k = own.get(segment)
    if k is None:
        if len(own) > 300_000:
            own.clear()
        k = own[segment] = f.shape(f.clean(segment))
    return k


def _lattice(s: str, f: Field, m: Model, widest: int | None = None):
    """Atoms, and for each end the segments ``(start, weight, key)`` that may end there: of the same width in cells of any length, so the work is in proportion to the atoms."""
    a, wide = atoms(s, f.delimiters), widest or f.widest
    usual = (math.log(0.8), math.log(0.2))
    cuts = [m.cuts.get(x[2], usual) for x in a]
    ends, last = [], len(a) - 1
    for j in range(len(a)):
        got, inner, out = [], 0.0, cuts[j][0] if j < last else 0.0
        for i in range(j, max(-1, j - wide), -1):
            if i < j:
                inner += cuts[i][1]
            key = _key(f, s[a[i][0] : a[j][1]])
            got.append((i, m.score(key, j - i) + inner + out, key))
        ends.append(got)
    return a, ends


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x)) if y > -1e300 else x


def expect(s: str, f: Field, m: Model, widest: int | None, times: float, values: dict, seps: dict) -> None:
    """Adds a cell's expected counts of values and of delimiters (``[separating, all]``)."""
    a, ends = _lattice(s, f, m, widest)
    n = len(a)
    fwd, bwd = [0.0] + [-1e308] * n, [-1e308] * n + [0.0]
    for j in range(n):
        for i, w, _ in ends[j]:
            fwd[j + 1] = _add(fwd[j + 1], fwd[i] + w)
    for j in range(n - 1, -1, -1):
        for i, w, _ in ends[j]:
            bwd[i] = _add(bwd[i], w + bwd[j + 1])
    for j in range(n):
        for i, w, key in ends[j]:
            p = math.exp(min(0.0, fwd[i] + w + bwd[j + 1] - fwd[n]))
            if p > 1e-4:
                values[key] += times * p
        if j + 1 < n:
            got = seps[a[j][2]]
            got[0] += times * math.exp(min(0.0, fwd[j + 1] + bwd[j + 1] - fwd[n]))
            got[1] += times


def best_split(s: str, f: Field, m: Model, widest: int | None = None) -> list[str]:
    """The values of the likeliest split, in order, without placeholders and empty places."""
    a, ends = _lattice(s, f, m, widest)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-1e308, 0)] * len(a)
    for j in range(len(a)):
        best[j + 1] = max((best[i][0] + w, i) for i, w, _ in ends[j])
    cuts, j = [], len(a)
    while j:
        i = best[j][1]
        cuts.append(s[a[i][0] : a[j - 1][1]])
        j = i
    vals = [f.clean(x) for x in reversed(cuts)]
    return [f.listed.get(f.shape(v)) or v for v in vals if v.casefold() not in PLACEHOLDERS]


def learn_all(cells: DataFrame, fields: dict[str, Field], rounds: int = 3, min_share: float = 1e-5, widest: int | None = None, prior: float = 0.5) -> dict[str, Model]:
    """EM over ``cells(field string, cell string, n long)``, the distinct cells of some columns with their counts; one job a round for all columns.

    A cell counts ``1 + ln(n)`` times, so that a hot record doesn't turn its whole cell into a value. ``listed`` values share ``prior`` of the mass.
    An empty table gives the prior alone. ``widest`` overrules the width of all fields.
    """
    models = {c: Model({k: prior / max(1, len(f.listed)) for k in f.listed}, {}, frozenset(f.listed)) for c, f in fields.items()}
    for _ in range(rounds):

        def e_step(batches: Iterator[pd.DataFrame], models: dict[str, Model] = models) -> Iterator[pd.DataFrame]:
            for b in batches:
                values: dict = {c: defaultdict(float) for c in fields}
                seps: dict = {c: defaultdict(lambda: [0.0, 0.0]) for c in fields}
                for c, s, n in zip(b["field"], b["cell"], b["n"], strict=True):
                    expect(s, fields[c], models[c], widest, 1.0 + math.log(n), values[c], seps[c])
                rows = [(c, "v", k, x, 0.0) for c, v in values.items() for k, x in v.items()] + [(c, "s", k, *x) for c, v in seps.items() for k, x in v.items()]
                yield pd.DataFrame(rows, columns=["field", "kind", "key", "x", "y"])

        sums = cells.mapInPandas(e_step, "field string, kind string, key string, x double, y double").groupBy("field", "kind", "key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        sums = cut_lineage(sums)
        totals = sums.where("kind = 'v'").groupBy("field").agg(F.sum("x").alias("total"))
        kept = sums.join(totals, "field").where((F.col("kind") == "s") | (F.col("x") >= F.col("total") * min_share)).collect()  # of each column at most 1 / min_share values and the delimiters
        new = {}
        for c, f in fields.items():
            theta = {k: prior / max(1, len(f.listed)) for k in f.listed}
            split = {}
            for r in (r for r in kept if r["field"] == c):
                if r["kind"] == "v" and r["total"]:
                    theta[r["key"]] = theta.get(r["key"], 0.0) + (1 - prior) * r["x"] / r["total"]
                elif r["kind"] == "s":
                    split[r["key"]] = min(0.999, max(0.02, (r["x"] + 0.8) / (r["y"] + 1)))
            new[c] = Model(theta, split, frozenset(f.listed))
        models = new
    return models


def learn(cells: DataFrame, f: Field, **how) -> Model:
    """``learn_all`` for one column of ``cells(cell, n)``."""
    return learn_all(cells.select(F.lit("f").alias("field"), "cell", "n"), {"f": f}, **how)["f"]


def split_packed(df: DataFrame, key: str, fields: dict[str, Field], **how) -> DataFrame:
    """``(key, field, pos, n_values, val)``: one row per value of each packed field, ``pos`` from 1 in the order of the cell.

    Null, blank and placeholder-only cells give no rows; a value given twice has two rows; very long cells are split like others; columns beside ``key`` and the
    fields aren't read; repeated rows give repeated results.
    """
    src = df.select(df[key].alias("_key"), *[df[c].alias(f"_f{i}") for i, c in enumerate(fields)])
    widest = how.get("widest")
    long = src.select("_key", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_f{i}").alias("cell")) for i, c in enumerate(fields)])).alias("x")).select("_key", "x.field", "x.cell").where(not_blank(F.col("cell")))
    cells = cut_lineage(spread(long.groupBy("field", "cell").agg(F.count("*").alias("n"))))  # the rounds that follow run on all cores
    learned = learn_all(cells, fields, **how)
    models = {c: (f, learned[c]) for c, f in fields.items()}

    name = uuid.uuid4().hex

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = per_worker(name, dict)  # hot cells are split once per worker: no join, no shuffle of rows
        for b in batches:
            got = []
            for c, s in zip(b["field"], b["cell"], strict=True):
                if (c, s) not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[c, s] = best_split(s, *models[c], widest)
                got.append(known[c, s])
            yield pd.DataFrame({"_key": b["_key"], "field": b["field"], "vals": got})

    split = spread(long).mapInPandas(decode, f"_key {src.schema['_key'].dataType.simpleString()}, field string, vals array<string>")
    return split.select(F.col("_key").alias(key), "field", F.posexplode("vals").alias("pos", "val"), F.size("vals").alias("n_values")).select(key, "field", (F.col("pos") + 1).alias("pos"), "n_values", "val")


def index_fields(categories: DataFrame, limit: int = 100_000) -> dict[str, Field]:
    """The three packed fields of the paper index. The category list is a fixed reference list; more than ``limit`` entries are refused."""
    rows = categories.select("category").where(not_blank(F.col("category"))).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the category list has more than {limit} entries")
    cat = category_field(sorted(r[0] for r in rows))
    return {"issn": issn_field(), "subject_categories": cat, "scimago_categories": cat}
