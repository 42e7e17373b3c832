"""Free-entered values to entries of a reference list: a prefix-filter set-similarity join, then an exact check.

Values are reduced to distinct ones first. Each has two token sets: the first three letters of its words (finds shortened and reordered names) and the letter
trigrams of its glued text (finds misspelt and glued ones). Tokens are put in order of global rarity; a pair of sets with Jaccard similarity ``t`` must share one of
the first ``n - ceil(t n) + 1`` tokens, so only those are joined, under the length and the positional filter. Jaccard is then verified exactly, and the exact check
aligns words: every word of the entry must be there, whole, shortened or misspelt, and no other word may be left. The best entry is kept; a value without one is reported.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.runtime import cut_lineage, not_blank, per_worker, spread

#: Letters of other scripts that look like Latin ones: fixed values.
HOMOGLYPHS = str.maketrans("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅοαεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSoaeiknptuxABEZHIKMNOPTYX")
#: Words that carry no identity in a name.
STOP_WORDS = frozenset(["the", "of", "in", "on", "and", "for", "a", "an", "to"])
#: What editions add to a name: fixed patterns.
_ADDED = re.compile(r"(?i)\s*(?:[(\[][^()\[\]]*(?:print|online|ed\.|edition|issn|electronic|www|\d{4})[^()\[\]]*[)\]]|[,;:]?\s*\bvol(?:ume)?\b\.?\s*\d+(?:\s*[,;]?\s*(?:no|issue|nr)\b\.?\s*\d+)?|[;,]\s*(?:19|20)\d\d|[-–—,;]\s*(?:online|print|electronic|international)\s+edition)\s*$")
#: Words that are shortened to one letter.
_SHORT = {"j": "journal", "q": "quarterly"}
_LEET = {"0": "o", "1": "l", "5": "s", "3": "e", "6": "b"}


def normal(value: str) -> str:
    """Plain lower-case letters, words apart by single blanks, without additions; glued and reordered words stay so."""
    s = unicodedata.normalize("NFKC", value)
    s = "".join(ch for ch in s if unicodedata.category(ch) != "Cf")
    s = re.sub(r"\s+", " ", s.replace("_", " ")).strip(" \"'“”‘’«».")
    before = None
    while before != s:
        before, s = s, _ADDED.sub("", s).strip(" \"'“”‘’«»,;")
    s = "".join(ch for ch in unicodedata.normalize("NFD", s.translate(HOMOGLYPHS)) if not unicodedata.combining(ch))
    s = re.sub(r"(?<=[^\W\d])[01356]|[01356](?=[^\W\d])", lambda m: _LEET[m[0]], s)
    return " ".join(re.sub(r"[^\w]+", " ", s.casefold().replace("&", " and ")).replace("_", " ").split())


def words(text: str) -> list[str]:
    w = text.split()
    return [x for x in w if x not in STOP_WORDS] or w


def token_sets(text: str) -> dict[str, list[str]]:
    """The two views of a normalised text."""
    glued = "".join(text.split())
    return {"h": sorted({"h" + _SHORT.get(w, w)[:3] for w in words(text)}), "g": sorted({"g" + glued[i : i + 3] for i in range(max(1, len(glued) - 2))})}


def rarity_prefix(tokens: list[str], freq: dict[str, int], t: float) -> list[str]:
    """The rarest tokens of a set that any partner of similarity ``t`` must share at least one of, rarest first."""
    order = sorted(tokens, key=lambda x: (freq.get(x, 0), x))
    return order[: len(order) - math.ceil(t * len(order)) + 1]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbours swapped as one edit; ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


class Check:
    """The exact check. ``vocabulary``: the words of the list's entries; a value's word that is one of them is never taken as a misspelling of another."""

    def __init__(self, vocabulary: frozenset[str], max_edits: int = 3):
        self.vocabulary, self.max_edits = vocabulary, max_edits

    @lru_cache(maxsize=200_000)  # noqa: B019
    def word(self, v: str, t: str) -> float | None:
        """The cost of reading ``v`` as ``t``; None if it can't be."""
        if v == t:
            return 0.0
        if len(v) < len(t) and t.startswith(v) and (len(v) >= 3 or v in ("j", "q")) and v not in self.vocabulary:
            return 0.2
        if v in self.vocabulary:
            return None
        size, ends = max(len(v), len(t)), v[0] == t[0] and v[-1] == t[-1]
        most = (1 if ends and min(len(v), len(t)) > 1 else 0) if size < 4 else (2 if ends and size == 5 else 1) if size < 6 else 3 if v[0] == t[0] else 2
        if size > 3 and sorted(v) == sorted(t):  # the same letters
            most = max(most, 2)
        d = edits(v, t, most)
        return float(d) if d <= most and (v[0] == t[0] or v[-1] == t[-1] or v[1:2] == t[:1] or sorted(v[:2]) == sorted(t[:2])) else None

    def cost(self, value: str, entry: str) -> float | None:
        """The cost of reading a normalised value as a normalised entry; None if they are different names."""
        if value == entry:
            return 0.0
        a, b = words(value), words(entry)
        if len(a) > len(b):  # a misspelt stop word
            odd = [x for x in a if len(x) < 5 and x not in self.vocabulary and any(edits(x, y, 1) <= 1 for y in ("and", "the", "of", "on", "in", "for"))]
            a = [x for x in a if x not in odd[: len(a) - len(b)]]
        if len(a) == len(b):
            total, left = 0.0, list(b)
            for v in sorted(a, key=lambda x: (x not in b, -len(x))):
                fits = [(c, k) for k, t in enumerate(left) if (c := self.word(v, t)) is not None]
                if not fits:
                    break
                c, k = min(fits)
                total += c
                left.pop(k)
            else:
                return total if total <= self.max_edits else None
        if len(value.split()) != len(entry.split()):  # glued or torn words
            x, y = value.replace(" ", ""), entry.replace(" ", "")
            most = 1 if len(y) > 8 else 0
            forms = {y, "".join(b), "the" + y, y.removeprefix("the")}
            best = min(edits(x, z, most) for z in forms)
            joined = len(a) < len(b) and not all(w in self.vocabulary for w in a)
            return best + 0.5 if best <= most and (best == 0 or joined) else None
        return None


def _views(df: DataFrame, id_cols: list[str], freq_of, thresholds: dict[str, float]) -> DataFrame:
    """``(ids, view, n, tokens)``: one row for each text and view of ``df(ids, h, g)``, with the prefix tokens in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq = freq_of()
        for b in batches:
            ids = list(zip(*(b[c] for c in id_cols), strict=True))
            rows = [(*i, view, len(toks), rarity_prefix(toks.tolist(), freq, thresholds[view])) for view in ("h", "g") for i, toks in zip(ids, b[view], strict=True)]
            yield pd.DataFrame(rows, columns=[*id_cols, "view", "n", "tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    return df.select(*id_cols, "h", "g").mapInPandas(run, f"{kinds}, view string, n int, tokens array<string>")


def best_entries(values: DataFrame, reference: DataFrame, thresholds: dict[str, float] | None = None, small: int = 20_000, max_words: int = 1_000_000, values_per_task: int = 10_000) -> DataFrame:
    """``(value, entry, score)`` with the best entry of ``reference(entry, name)`` for each distinct value of ``values(value)``; values that mean no entry have no row.

    An entry may have several names. A reference list of at most ``small`` names is broadcast, a longer one is joined by shuffling on the prefix tokens; the result is the same. The
    distinct words of all names, at most ``max_words``, are sent to the exact check; more raise an error. Of entries at equal cost the more similar one
    is kept, then the smaller id; two entries at the same cost and similarity are an ambiguity, settled the same way.
    """
    thresholds = thresholds or {"h": 0.5, "g": 0.35}
    spark = values.sparkSession

    def normalise(col: str, keep: list[str], kinds: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = b[keep].copy()
                out["norm"] = [normal(x) for x in b[col]]
                out = out[out["norm"] != ""]
                sets = [token_sets(x) for x in out["norm"]]
                yield out.assign(h=[x["h"] for x in sets], g=[x["g"] for x in sets])

        return run, f"{kinds}, norm string, h array<string>, g array<string>"

    entry_kind = reference.schema["entry"].dataType.simpleString()
    run, schema = normalise("value", ["value"], "value string")
    vals = cut_lineage(spread(values.select("value").where(not_blank(F.col("value"))).distinct()).mapInPandas(run, schema))
    run, schema = normalise("name", ["entry", "name"], f"entry {entry_kind}, name string")
    refs = cut_lineage(reference.select("entry", "name").where(not_blank(F.col("name")) & F.col("entry").isNotNull()).mapInPandas(run, schema).dropDuplicates(["entry", "norm"]))
    is_small = refs.limit(small + 1).count() <= small

    # global rarity; only tokens of the list can join, so only those are counted, all others come first in the order
    tokens = F.explode(F.concat("h", "g")).alias("token")
    of_list = refs.select(tokens).groupBy("token").agg(F.count("*").alias("r"))
    of_vals = vals.select(tokens).groupBy("token").agg(F.count("*").alias("v"))
    counts = of_list.join(of_vals, "token", "left").select("token", (F.col("r") + F.coalesce("v", F.lit(0))).alias("n"))
    freq = spark.sparkContext.broadcast({r["token"]: r["n"] for r in counts.toLocalIterator()})
    # values are spread once, with their tokens in one row: candidates then arise, are made distinct and are checked where the value lies
    tasks = max(spark.sparkContext.defaultParallelism, vals.count() // values_per_task)
    left = _views(vals, ["value", "norm"], lambda: freq.value, thresholds).repartition(tasks, "value").select("value", "norm", "view", "n", F.posexplode("tokens").alias("at", "token"))
    right = _views(refs, ["entry", "norm"], lambda: freq.value, thresholds).select("entry", F.col("norm").alias("rnorm"), "view", F.col("n").alias("rn"), F.posexplode("tokens").alias("rat", "token"))
    if is_small:
        right = F.broadcast(right)
    t = F.when(F.col("view") == "h", thresholds["h"]).otherwise(thresholds["g"])
    need = F.ceil(t / (t + 1) * (F.col("n") + F.col("rn")) - 1e-9)
    pairs = (
        left.join(right, ["view", "token"])
        .where((F.col("rn") >= t * F.col("n")) & (F.col("n") >= t * F.col("rn")))
        .where(1 + F.least(F.col("n") - F.col("at"), F.col("rn") - F.col("rat")) - 1 >= need)
        .select("value", "norm", "entry", "rnorm", "view")
        .dropDuplicates(["value", "entry", "rnorm", "view"])
    )
    name = uuid.uuid4().hex
    known = refs.select(F.explode(F.split("norm", " ")).alias("w")).where("w <> ''").distinct().limit(max_words + 1).collect()
    if len(known) > max_words:
        raise ValueError(f"the names of the reference list hold more than {max_words} words")
    vocabulary = spark.sparkContext.broadcast(frozenset(r["w"] for r in known))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check, sets = per_worker(name, lambda: (Check(vocabulary.value), lru_cache(maxsize=100_000)(lambda s: {k: frozenset(v) for k, v in token_sets(s).items()})))
        for b in batches:
            rows = []
            for value, norm, entry, rnorm, view in b[["value", "norm", "entry", "rnorm", "view"]].itertuples(index=False):
                x, y = sets(norm)[view], sets(rnorm)[view]
                j = len(x & y) / len(x | y)
                if j >= thresholds[view] - 1e-9 and (c := check.cost(norm, rnorm)) is not None:
                    rows.append((value, entry, c, j))
            yield pd.DataFrame(rows, columns=["value", "entry", "cost", "jaccard"])

    good = pairs.mapInPandas(verify, f"value string, entry {entry_kind}, cost double, jaccard double")
    best = good.groupBy("value").agg(F.min(F.struct("cost", (-F.col("jaccard")).alias("less"), "entry")).alias("b"))
    return best.select("value", F.col("b.entry").alias("entry"), (1.0 / (1.0 + F.col("b.cost"))).alias("score"))


def map_values(df: DataFrame, key: str, fields: dict[str, DataFrame], salts: int = 16, most_broadcast: int = 200_000, hot_share: float = 0.001, **how) -> DataFrame:
    """``(key, field, value, canon)``: each non-blank value of each field with the entry meant, ``canon`` null for a value that means none.

    ``fields`` gives a column's reference list ``(entry, name)``. Null and blank values have no row; repeated rows give repeated results; an empty reference list leaves all unmatched.
    Matching runs over distinct values. Up to ``most_broadcast`` matched values are sent to the rows; more are joined by value, where a value of at least ``hot_share`` of all rows
    (so at most ``1 / hot_share`` values) is spread over ``salts`` tasks. The result is the same.
    """
    lists: dict[int, tuple[DataFrame, list[str]]] = {}
    for c, reference in fields.items():  # columns with the same list are matched together
        lists.setdefault(id(reference), (reference, []))[1].append(c)
    src = df.select(df[key].alias("_key"), *[df[c].alias(f"_v{i}") for i, c in enumerate(fields)])
    place = {c: i for i, c in enumerate(fields)}
    out = None
    for reference, columns in lists.values():
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_v{place[c]}").alias("value")) for c in columns])
        rows = src.select("_key", F.explode(cells).alias("x")).select("_key", "x.field", "x.value").where(not_blank(F.col("value")))
        best = cut_lineage(best_entries(rows, reference.withColumn("entry", F.col("entry").cast("string")), **how)).select("value", "entry")
        if best.limit(most_broadcast + 1).count() <= most_broadcast:
            joined = rows.join(F.broadcast(best), "value", "left")
        else:
            counts = cut_lineage(rows.groupBy("value").agg(F.count("*").alias("n")))
            least = (counts.agg(F.sum("n")).first()[0] or 0) * hot_share
            hot = F.broadcast(counts.where(F.col("n") >= least).select("value", F.lit(True).alias("_hot")))
            left = rows.join(hot, "value", "left").withColumn("_s", F.when(F.col("_hot"), F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int")).otherwise(0))
            right = best.join(hot, "value", "left").withColumn("_s", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
            joined = left.join(right.select("value", "entry", "_s"), ["value", "_s"], "left")
        got = joined.select(F.col("_key").alias(key), "field", "value", F.col("entry").alias("canon"))
        out = got if out is None else out.unionByName(got)
    return out


#: Words that say the same in reports of a search: fixed values, general English.
SYNONYMS = {"found": ("find", "match", "matches", "matched"), "not": ("no", "none", "nothing", "un"), "similar": ("approx", "approximate", "close", "alike"), "exact": ("exactly", "identical"), "name": ("title",)}


def described_names(entries: list[tuple[str, str | None]], most: int = 1000) -> list[tuple[str, str]]:
    """``(entry, name)`` of a short list whose entries come with a description: names by which people may mean an entry.

    A word of an entry or its description tells it apart if no other entry or description has it. Names are the entry itself, and each telling word (or a synonym) with up to two of the words
    that do not tell apart. A list of over ``most`` entries isn't short and raises an error; null and blank entries have no names; a missing description adds none.
    """
    if len(entries) > most:
        raise ValueError(f"more than {most} described entries")
    own = {e: set(normal(e).split()) | set(normal(d or "").split()) for e, d in entries if e and normal(e)}
    times = Counter(w for ws in own.values() for w in ws)
    split = {e: (normal(e), {w for w in ws if times[w] == 1 and (w in SYNONYMS or w in normal(e).split())}) for e, ws in own.items()}
    shared = {w for ws in own.values() for w in ws if times[w] > 1 and w not in STOP_WORDS and len(w) > 2} | {"name", "found", "by"} & set(times)
    wide = lambda ws: sorted({x for w in ws for x in (w, *SYNONYMS.get(w, ()))})
    plain = wide(shared | ({"by"} if shared else set()))
    out = []
    for e, (name, telling) in split.items():
        out.append((e, name))
        for w in wide(telling):
            for k in range(3):
                out += [(e, " ".join([w, *more])) for more in combinations(plain, k)]
    return list(dict.fromkeys(out))
