"""Subject areas of documents: sentence evidence from terms, then a classifier chain decoded by beam search.

1. Function words are left out: words common in a language, by document counts over all texts, that are spread evenly over the subjects of labelled documents. They are left out of texts of that language only.
2. Term weights start from hand-labelled documents (at most ``max_labelled``), spread over their sentences by expectation-maximisation, and are then re-estimated
   from the sentences of *all* documents (counts summed by Spark).
3. A document's share of each subject is the mean over its sentences of the subject's posterior, under the document's own mixture.
4. A chain of logistic classifiers, one link per subject, sees shares, source, section and length, and the subjects already set (with their co-occurrence);
   its probabilities are calibrated on held-out folds; beam search finds the likeliest combination. An exact check follows: of the decoded subjects only those stay whose measured
   share of the sentences reaches ``min_share``, less half a sentence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.runtime import cut_lineage, not_blank, spread

_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_CODE = re.compile(r"[a-z]{1,2}-\d+|[\d.]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^a-z\s])|\n\s*\n+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>|\*\*|[«»]")
NONE = "none"
UNKNOWN = "??"


def sentences_of(text: str) -> list[str]:
    """Sentences and headings of a text; markup is left out."""
    return [x for x in _SENTENCE.split(_TAG.sub("", text).strip()) if _WORD.search(x)]


@dataclass
class Tokens:
    """The terms of some documents: words, and pairs of neighbouring words of which one is no function word, code or number. Each counts once a sentence."""

    which: list[int]  # the documents that have a sentence
    sizes: np.ndarray  # their sentences
    names: list[str]  # the distinct terms
    sent: np.ndarray  # sentence and
    term: np.ndarray  # number of each term in it, by sentence

    @staticmethod
    def read(texts: list[str], langs: list[str], stop: dict[str, frozenset[str]]) -> Tokens:
        which, sizes, lengths, words, of = [], [], [], [], []
        for d, t in enumerate(texts):
            parts = sentences_of(t)
            if not parts:
                continue
            which.append(d)
            sizes.append(len(parts))
            for x in parts:
                w = _WORD.findall(x.lower())
                lengths.append(len(w))
                words += w
            of += [langs[d]] * len(parts)
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        distinct, n = list(number), len(number)
        sent = np.repeat(np.arange(len(lengths)), lengths)
        spoken = {x: i for i, x in enumerate(dict.fromkeys(of))}
        code = np.array([bool(_CODE.fullmatch(w)) for w in distinct], bool)
        out = np.stack([code | np.fromiter((w in stop[x] for w in distinct), bool, n) if x in stop else code for x in spoken]) if spoken else np.zeros((0, 0), bool)
        keep = ~out[np.repeat(np.array([spoken[x] for x in of], np.int64), lengths), ids] if len(words) else np.zeros(0, bool)
        pair = (sent[1:] == sent[:-1]) & (keep[1:] | keep[:-1])
        span = n + n * n
        keys = np.sort(np.concatenate([sent[keep] * span + ids[keep], sent[:-1][pair] * span + n + ids[:-1][pair] * n + ids[1:][pair]]))
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        code_of = keys % span if span else keys
        order = np.argsort(code_of, kind="stable")
        new = np.append(True, code_of[order][1:] != code_of[order][:-1]) if len(keys) else np.zeros(0, bool)
        codes, term = code_of[order][new], np.empty(len(keys), np.int64)
        term[order] = np.cumsum(new) - 1
        names = [distinct[c] if c < n else f"{distinct[(c - n) // n]} {distinct[(c - n) % n]}" for c in codes.tolist()]
        return Tokens(which, np.array(sizes, np.int64), names, keys // span if span else keys, term)

    def counts(self, post: np.ndarray) -> np.ndarray:
        """Expected counts of each term by subject, sentences weighted by their posteriors."""
        w = post[self.sent]
        return np.stack([np.bincount(self.term, weights=w[:, j], minlength=len(self.names)) for j in range(post.shape[1])], axis=1) if len(self.names) else np.zeros((0, post.shape[1]))


@dataclass
class Terms:
    """Weights of terms: for each, the log of how much more usual it is in a subject's sentences than on average."""

    subjects: list[str]
    stop: dict[str, frozenset[str]]
    index: dict[str, int]
    matrix: np.ndarray

    @staticmethod
    def of(subjects: list[str], stop: dict[str, frozenset[str]], names: list[str], counts: np.ndarray, totals: np.ndarray, least: float = 1.5) -> Terms:
        keep = np.flatnonzero(counts.sum(1) >= least) if len(names) else np.zeros(0, int)
        if not len(keep):
            return Terms(subjects, stop, {}, np.zeros((0, len(subjects))))
        c = counts[keep]
        p = (c + 0.02 * c.sum(1, keepdims=True) * totals / max(1.0, totals.sum()) + 0.02) / (totals + 20.0)
        m = np.clip(np.log(p / p.mean(1, keepdims=True)), -4.0, 4.0)
        return Terms(subjects, stop, {names[t]: i for i, t in enumerate(keep)}, m * np.minimum(1.0, c.sum(1, keepdims=True) / 3.0))

    def read(self, texts: list[str], langs: list[str]) -> Tokens:
        return Tokens.read(texts, langs, self.stop)

    def posteriors(self, t: Tokens, prior: np.ndarray | None = None, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """``(posteriors of all sentences, shares of each document)``. Each document has its own mixture, found by expectation-maximisation from ``prior`` (one row per document, or flat)."""
        k, n = len(self.subjects), len(t.sizes)
        if not n:
            return np.zeros((0, k)), np.zeros((0, k))
        starts = np.concatenate([[0], np.cumsum(t.sizes)[:-1]])
        of = np.repeat(np.arange(n), t.sizes)
        s = np.zeros((int(t.sizes.sum()), k))
        rows = np.fromiter((self.index.get(x, -1) for x in t.names), np.int64, len(t.names))[t.term] if len(t.names) else np.zeros(0, np.int64)
        known = rows >= 0
        if known.any():
            at, first = np.unique(t.sent[known], return_index=True)
            s[at] = np.add.reduceat(self.matrix[rows[known]], first, axis=0)
        base = np.full((n, k), 1.0 / k) if prior is None else prior
        mix, post = base, s
        for _ in range(rounds):
            z = s + np.log(mix)[of]
            z -= z.max(1, keepdims=True)
            post = np.exp(z)
            post /= post.sum(1, keepdims=True)
            mix = (np.add.reduceat(post, starts, axis=0) + 0.3 * base) / (t.sizes + 0.3)[:, None]
        return post, np.add.reduceat(post, starts, axis=0) / t.sizes[:, None]


def fit_terms(labelled: list[tuple[str, str, set[str]]], subjects: list[str], stop: dict[str, frozenset[str]], rounds: int = 4, trust: float = 0.9) -> Terms:
    """Term weights from labelled documents ``(text, language, labels)``. A label is trusted to ``trust``: sentences may turn out to belong elsewhere."""
    k = len(subjects)
    at = {s: i for i, s in enumerate(subjects)}
    rows = [(t, lang, {at[x] for x in ls if x in at}) for t, lang, ls in labelled]
    rows = [r for r in rows if r[2]]
    tokens = Tokens.read([r[0] for r in rows], [r[1] for r in rows], stop)
    if not tokens.which:
        return Terms(subjects, stop, {}, np.zeros((0, k)))
    prior = np.full((len(tokens.which), k), (1 - trust) / k)
    for i, d in enumerate(tokens.which):
        prior[i, list(rows[d][2])] += trust / len(rows[d][2])
    model = None
    for _ in range(rounds):
        post = np.repeat(prior, tokens.sizes, axis=0) if model is None else model.posteriors(tokens, prior)[0]
        model = Terms.of(subjects, stop, tokens.names, tokens.counts(post), post.sum(0))
    return model


def _small(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """Arrow batches in pieces: the terms of all sentences of a piece are held at once."""
    for b in batches:
        for k in range(0, max(1, len(b)), rows):
            yield b.iloc[k : k + rows]


def language_of(lang):
    """A language's first two letters, whatever way it is spelt; null and blank are unknown."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(F.lit(UNKNOWN))


def common_words(docs: DataFrame, max_share: float = 0.1, weight: int = 20) -> dict[str, set[str]]:
    """``{language: words}`` that more than ``max_share`` of the language's documents hold.

    The share of a language is drawn to the share over all languages by ``weight`` documents, so that a language of few documents has the common words of the corpus, and no limit of size is needed. There are at
    most (words of a document / ``max_share``) such words a language.
    """
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    words = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0)))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    words = cut_lineage(words)
    total = docs.count()
    overall = words.groupBy("w").agg(F.sum("n").alias("a"))
    share = (F.col("n") + weight * F.col("a") / max(1, total)) / (F.col("size") + weight)
    out: dict[str, set[str]] = {}
    for r in words.join(overall, "w").join(F.broadcast(sizes), "lang").where(share > max_share).select("lang", "w").collect():
        out.setdefault(r["lang"], set()).add(r["w"])
    return out


def stop_words(common: dict[str, set[str]], labelled: list[tuple[str, str, set[str]]]) -> dict[str, frozenset[str]]:
    """Of the common words of each language those that don't speak for a subject: among the labelled documents of no language are they spread over the subjects otherwise than by chance.

    Tested by the likelihood ratio at one in a thousand, in each language by itself, as its words come with the language and not with a subject. A word that tells subjects apart in one
    language is no function word in another; a common word that no labelled document holds speaks for none. A text of unknown language may be in any, so the words of all are left out of it.
    """
    asked = set().union(*common.values()) if common else set()
    telling: set[str] = set()
    for lang in {x for _, x, _ in labelled}:
        part = [(t, ls) for t, x, ls in labelled if x == lang]
        at = {x: i for i, x in enumerate(sorted({x for _, ls in part for x in ls}))}
        if len(at) < 2:
            continue
        every, held = np.zeros(len(at)), {}
        for text, ls in part:
            row = np.zeros(len(at))
            row[[at[x] for x in ls]] = 1.0 / max(1, len(ls))
            every += row
            for w in asked & set(_WORD.findall(text.lower())):
                held[w] = held.get(w, 0.0) + row
        df = len(at) - 1
        most = df * (1 - 2 / (9 * df) + 3.09 * math.sqrt(2 / (9 * df))) ** 3  # chi-squared at 0.001
        for w, seen in held.items():
            share, g = seen.sum() / every.sum(), 0.0
            for x, q in ((seen, share), (every - seen, 1 - share)):
                ok = x > 1e-9
                g += 2 * float((x[ok] * np.log(x[ok] / (every[ok] * q))).sum())
            if g > most:
                telling.add(w)
    out = {lang: frozenset(ws - telling) for lang, ws in common.items()}
    return out | {UNKNOWN: frozenset().union(*out.values())}


def widen_terms(docs: DataFrame, model: Terms, min_share: float = 2e-6) -> Terms:
    """Term weights from the sentences of all documents, each counted under the posterior of its subject. Terms of at least ``min_share`` of all counts go back to the tasks, so at most ``1 / min_share``."""
    k = len(model.subjects)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        cols = [f"c{i}" for i in range(k)]
        for b in _small(batches):
            t = m.read(b["text"].tolist(), b["lang"].tolist())
            if not t.which:
                continue
            post, _ = m.posteriors(t)
            post = np.where(post > 1e-3, post, 0.0)  # zeros where a subject has next to no part: rows that pack well
            out = pd.DataFrame(np.concatenate([post.sum(0)[None], t.counts(post)]), columns=cols)
            out.insert(0, "term", ["", *t.names])
            yield out[out[cols].sum(axis=1) > 0]

    got = docs.select("text", "lang").mapInPandas(count, "term string, " + ", ".join(f"c{i} double" for i in range(k)))
    sums = got.groupBy("term").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)])
    sums = cut_lineage(sums.withColumn("n", sum(F.col(f"c{i}") for i in range(k))))
    total = sums.where("term <> ''").agg(F.sum("n")).first()[0] or 0.0
    rows = sums.where((F.col("n") >= max(2.5, total * min_share)) & (F.col("term") != "")).collect()
    first = sums.where("term = ''").first()
    if not rows or first is None:
        return model
    return Terms.of(model.subjects, model.stop, [r["term"] for r in rows], np.array([[r[f"c{i}"] for i in range(k)] for r in rows]), np.array([first[f"c{i}"] for i in range(k)]))


# ---------------------------------------------------------------- chain


#: Where the features begin that depend on the subjects already set.
_ON = 11


#: Sources are features by hash: this many places, whatever the number of sources; a null source has none.
SOURCE_PLACES = 32


def source_place(source: str | None) -> int:
    return zlib.crc32(source.encode()) % SOURCE_PLACES if isinstance(source, str) else -1


@dataclass
class Chain:
    """Logistic links in the order of ``subjects``; all links share the weights of their features and have their own intercept and pair weights."""

    subjects: list[str]
    w: np.ndarray
    pairs: np.ndarray
    own: np.ndarray
    scale: tuple[float, float]

    def features(self, shares: np.ndarray, ns: list[int], sources: list, sections: list) -> np.ndarray:
        """``(documents, subjects, features)`` with no subject set yet; the features at ``_ON`` count those set."""
        s, k = shares[:, :-1], len(self.subjects)
        n = np.array(ns, float)[:, None] * np.ones((1, k))
        greater = (s[:, None, :] > s[:, :, None]).sum(2)
        top = np.sort(s, axis=1)[:, ::-1]
        rest = np.where((greater == 0) & ((s == top[:, :1]).sum(1, keepdims=True) == 1), top[:, 1:2] if k > 1 else 0.0, top[:, :1])
        ones, none = np.ones_like(s), np.array([[x is None] for x in sections], float)
        base = [ones, s, np.minimum(s, 0.5), s >= 0.25, s >= 0.2, s >= 0.3, s >= 0.5, s >= rest, greater >= 2, shares[:, -1:] * ones, np.log1p(n), 0 * ones, 0 * ones, s * n, s * n < 1.5, none * ones, np.array([[x == "abstract"] for x in sections], float) * ones]
        places = np.array([source_place(x) for x in sources])
        base += [(places == y)[:, None] * ones for y in range(SOURCE_PLACES)]
        return np.stack([x.astype(float) for x in base], axis=2)

    def decode(self, shares: np.ndarray, ns: list[int], sources: list, sections: list, width: int = 8) -> list[tuple[tuple[int, ...], float]]:
        """The likeliest combination of subjects of each document, with its log probability."""
        if not self.subjects or not len(shares):
            return [((), 0.0)] * len(shares)
        a, b = self.scale
        alone = (self.features(shares, ns, sources, sections) @ self.w + self.own) * a + b
        on1, on2, pairs = float(self.w[_ON]) * a, float(self.w[_ON + 1]) * a, self.pairs * a
        n, k = alone.shape
        lp, chosen = np.zeros((n, 1)), np.zeros((n, 1, k), bool)
        for i in range(k):  # the beams of all documents at once
            on = chosen.sum(2)
            z = np.clip(alone[:, i, None] + on1 * on + on2 * (on >= 2) + chosen @ pairs[i], -50.0, 50.0)
            lp = np.concatenate([lp - np.log1p(np.exp(z)), lp - np.log1p(np.exp(-z))], axis=1)
            taken = chosen.copy()
            taken[:, :, i] = True
            best = np.argsort(-lp, axis=1, kind="stable")[:, :width]
            lp = np.take_along_axis(lp, best, 1)
            chosen = np.take_along_axis(np.concatenate([chosen, taken], axis=1), best[:, :, None], 1)
        return [(tuple(np.flatnonzero(c).tolist()), float(x)) for c, x in zip(chosen[:, 0], lp[:, 0], strict=True)]


def _logistic(x: np.ndarray, y: np.ndarray, l2: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(l2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(examples: list[tuple[np.ndarray, int, str | None, str | None, set[str]]], subjects: list[str], folds: int = 4) -> Chain:
    """Fits the chain on ``(shares, sentences, source, section, labels)``; a Platt scale is fitted on held-out folds."""
    k = len(subjects)
    probe = Chain(subjects, np.zeros(0), np.zeros((k, k)), np.zeros(k), (1.0, 0.0))

    def rows(part):
        x = probe.features(np.stack([e[0] for e in part]), [e[1] for e in part], [e[2] for e in part], [e[3] for e in part])
        own, pair = np.tile(np.eye(k), (len(part), 1, 1)), np.zeros((len(part), k, k, k))
        y = np.zeros((len(part), k))
        for d, e in enumerate(part):
            on: list[int] = []
            for i in range(k):
                x[d, i, _ON], x[d, i, _ON + 1] = len(on), len(on) >= 2
                pair[d, i, i, on] = 1
                if subjects[i] in e[4]:
                    y[d, i] = 1
                    on.append(i)
        full = np.concatenate([x, own, pair.reshape(len(part), k, k * k)], axis=2)
        return full.reshape(len(part) * k, -1), y.ravel()

    def solve(part):
        x, y = rows(part)
        d = x.shape[1] - k - k * k
        l2 = np.concatenate([np.full(d, 0.5), np.full(k, 4.0), np.full(k * k, 8.0)])
        return _logistic(x, y, l2), d

    if len(examples) < 8 or not subjects:  # too few labels for a model: the measured share decides
        w = np.zeros(17 + SOURCE_PLACES)
        w[0], w[3] = -6.0, 12.0
        return Chain(subjects, w, np.zeros((k, k)), np.zeros(k), (1.0, 0.0))
    zs, ys = [], []
    for f in range(folds):
        w, _ = solve([e for i, e in enumerate(examples) if i % folds != f])
        x, y = rows([e for i, e in enumerate(examples) if i % folds == f])
        zs.append(x @ w)
        ys.append(y)
    z, y = np.concatenate(zs), np.concatenate(ys)
    a, b = _logistic(np.stack([z, np.ones_like(z)], 1), y, np.array([1e-3, 1e-3]))
    w, d = solve(examples)
    return Chain(subjects, w[:d], w[d + k :].reshape(k, k), w[d : d + k], (float(max(0.2, a)), float(b)))


def subject_areas(docs: DataFrame, labels: DataFrame, subject_list: DataFrame, key: str = "doc_id", text: str = "text", min_share: float = 0.25, max_labelled: int = 4000, widen: int = 1, stop_share: float = 0.1, max_subjects: int = 1000) -> DataFrame:
    """``(key, subject, share, log_prob)``: the subjects of each document with the measured share of its sentences and the log probability of the combination.

    Null and blank texts, and documents without a subject, have no row; null source, section and language are values of their own; repeated rows give repeated results;
    texts are read whole. The classifier is fitted on at most ``max_labelled`` labelled documents (those of smallest hash); all counts cover all documents. A list of more than
    ``max_subjects`` subjects raises an error.
    """
    spark = docs.sparkSession
    known = [r[0] for r in subject_list.select("subject").where(not_blank(F.col("subject"))).distinct().orderBy("subject").limit(max_subjects + 1).collect()]
    if len(known) > max_subjects:
        raise ValueError(f"more than {max_subjects} subjects")
    subjects = [s for s in known if s != NONE]
    pick = lambda c: docs[c] if c in docs.columns else F.lit(None).cast("string")
    src = docs.select(docs[key].alias("_key"), docs[text].alias("text"), language_of(pick("lang")).alias("lang"), pick("source").alias("source"), pick("section").alias("section")).where(not_blank(F.col("text")))
    src = spread(src)
    # the labels are cut to the sample first: texts aren't shuffled, whatever their number
    lab = labels.select(labels["doc_id"].alias("_key"), labels["subject"].alias("s")).where(F.col("s").isin([*subjects, NONE])).groupBy("_key").agg(F.collect_set("s").alias("ls"))
    lab = lab.join(docs.select(docs[key].alias("_key")).where(not_blank(docs[text])), "_key", "left_semi").orderBy(F.xxhash64("_key"), "_key").limit(max_labelled)
    sample = src.join(F.broadcast(lab), "_key").orderBy(F.xxhash64("_key"), "_key").limit(max_labelled).collect()
    labelled = [(r["text"], r["lang"], set(r["ls"])) for r in sample]
    stop = stop_words(common_words(src, stop_share), labelled)
    classes = [*subjects, NONE]
    model = fit_terms(labelled, classes, stop)
    for _ in range(widen):
        model = widen_terms(src, model)
    tokens = model.read([t for t, _, _ in labelled], [lang for _, lang, _ in labelled])
    shares = model.posteriors(tokens)[1]
    examples = [(x, int(n), sample[d]["source"], sample[d]["section"], labelled[d][2] - {NONE}) for x, n, d in zip(shares, tokens.sizes, tokens.which, strict=True)]
    chain = fit_chain(examples, subjects)
    shared = spark.sparkContext.broadcast((model, chain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, ch = shared.value
        for b in _small(batches):
            t = m.read(b["text"].tolist(), b["lang"].tolist())
            keys, sources, sections = (b[c].tolist() for c in ("_key", "source", "section"))
            shares = m.posteriors(t)[1]
            best = ch.decode(shares, t.sizes.tolist(), [sources[d] for d in t.which], [sections[d] for d in t.which])
            rows = []
            for share, (chosen, lp), n, d in zip(shares.tolist(), best, t.sizes.tolist(), t.which, strict=True):
                rows += [(keys[d], ch.subjects[i], share[i], lp) for i in chosen if share[i] >= min_share - 0.5 / max(4, n)]
            yield pd.DataFrame(rows, columns=[key, "subject", "share", "log_prob"])

    return src.mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, subject string, share double, log_prob double")


def composition(found: DataFrame, subject: str = "subject") -> DataFrame:
    """``(subject, n_docs, mean_share)`` over the documents that have a subject."""
    return found.groupBy(subject).agg(F.count("*").alias("n_docs"), F.avg("share").alias("mean_share"))
