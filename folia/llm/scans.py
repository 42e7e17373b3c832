"""Noise in text from scanned pages: find it, and repair the text into running paragraphs.

Two averaged perceptrons, trained here on the corpus's own clean texts after they have been spoilt artificially:

* ``LineModel`` labels each line ``text``, ``header`` or ``pageno`` from its position on the page, its shape and its neighbours;
* ``CharModel`` labels each character ``K`` (keep), ``D`` (delete), ``R:x`` (replace), ``R:xy`` (replace by ``x`` and insert ``y``) and, at a line end, ``J`` (join the lines).

An exact check follows: an edited word counts only if the word after the edits is in the lexicon of the corpus and far more frequent than the word before.
"""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.runtime import cut_lineage, per_worker, spread

#: What a misread character looks like, clean to misread: fixed values, from the shapes of letters.
CONFUSIONS = [("e", "c"), ("i", "l"), ("o", "0"), ("n", "ri"), ("l", "1"), ("s", "5"), ("u", "ii"), ("g", "q"), ("d", "cl"), ("m", "rn"), ("h", "li"), ("b", "6"), ("w", "vv"), ("i", "1"), ("S", "5"), ("O", "0"), ("B", "8"), ("l", "i"), ("c", "e"), ("rn", "m"), ("cl", "d")]
#: The edits a character can need, from the table above.
_EDITS: dict[str, set[str]] = {}
for _a, _b in CONFUSIONS:
    _EDITS.setdefault(_b[0], set()).add("R:" + (_a if len(_a) > len(_b) else _a[0]))
_BACK: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BACK.setdefault(_b[0], []).append((_a, _b))
#: What clean words are spoilt with in training: the usual confusions, either way.
_SPOIL = [*CONFUSIONS[:14], *CONFUSIONS[19:]]
HYPHENS = "-­¬‐‑"
_EOL = re.compile(r"\r\n|\n|\r")
_WORD = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_PAGE = re.compile(r"[\s·•~*|\-–—\[\]()]*(?:page|p\.|pp\.|seite|s\.)?\s*(?:[A-Z]?\d{1,5}|([ivxlcdm]+))\s*(?:(?:of|/|von)\s*\d+)?[\s·•~*|\-–—\[\]()]*", re.I)
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_MARK = re.compile(r"\s*\([a-z0-9]{1,3}\)\s")
_SEPARATOR = re.compile(r"\t| \| |\|$| {2,}")
_STAMP = re.compile(r"(?:[A-Z] ){3,}")
_ROMAN_LETTERS = re.compile(r"[ivxlcdm]+", re.I)
_APART = re.compile(r"\s{2}|[\t|]")
_ENDS = re.compile(r"(?:\b[a-z]\w*|[\d%)])[.!?:;]$")
_WIDE = re.compile(r"\S {3,}\S")
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def is_page(line: str) -> bool:
    """A line that could be a page number. A roman number stands without hyphen at its end and isn't a list mark."""
    s = line.strip()
    m = _PAGE.fullmatch(s) if s and len(s) < 40 and not _APART.search(s) else None
    return m is not None and (not m[1] or (_ROMAN.fullmatch(m[1]) is not None and (s == m[1] or len(m[1]) > 1) and s[-1] not in HYPHENS and not s.startswith("(")))


class Perceptron:
    """Multi-class averaged perceptron over string features."""

    def __init__(self, labels: list[str], weights: dict[str, dict[str, float]] | None = None):
        self.labels, self.w = labels, weights or {}
        self._total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self._stamp: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.step = 0

    def scores(self, feats: list[str]) -> dict[str, float]:
        out = dict.fromkeys(self.labels, 0.0)
        for f in feats:
            for label, x in self.w.get(f, {}).items():
                out[label] += x
        return out

    def best(self, feats: list[str]) -> str:
        s = self.scores(feats)
        return max(self.labels, key=s.__getitem__)

    def update(self, feats: list[str], truth: str, guess: str) -> None:
        self.step += 1
        if truth == guess:
            return
        for f in feats:
            row = self.w.setdefault(f, {})
            for label, by in ((truth, 1.0), (guess, -1.0)):
                self._total[f][label] += (self.step - self._stamp[f][label]) * row.get(label, 0.0)
                self._stamp[f][label] = self.step
                row[label] = row.get(label, 0.0) + by

    def average(self) -> Perceptron:
        for f, row in self.w.items():
            for label in row:
                self._total[f][label] += (self.step - self._stamp[f][label]) * row[label]
                row[label] = self._total[f][label] / max(1, self.step)
        self.w = {f: {k: v for k, v in row.items() if abs(v) > 1e-4} for f, row in self.w.items()}
        self.w = {f: row for f, row in self.w.items() if row}
        self._total, self._stamp = {}, {}  # fitted: plain data that can travel
        return self


# ---------------------------------------------------------------- lines


def _shape(s: str) -> str:
    s = re.sub(r"\d+", "0", s.strip())
    s = re.sub(r"[A-Z]{2,}", "XX", s)
    return re.sub(r"[a-z]+", "x", s)[:24]


def _tokens_shape(s: str) -> list[str]:
    """A line's tokens by kind: ``0`` number, ``X`` one capital, ``XX`` capitals, ``Xx`` capitalised, ``x`` short, ``xx`` longer word, else the sign itself."""
    out = []
    for t in _TOKENS.findall(s):
        if t[0].isdigit():
            out.append("0")
        elif t[0].isalpha():
            out.append("X" if len(t) == 1 and t.isupper() else "XX" if t.isupper() else "Xx" if t[0].isupper() else "x" if len(t) < 4 else "xx")
        else:
            out.append(t)
    return out


def cells(line: str) -> int:
    return len([x for x in _SEPARATOR.split(line.strip()) if x.strip()])


def line_features(lines: list[str], i: int, table: bool, lexicon: dict[str, int], before: str, pages: list[bool]) -> list[str]:
    """Position on the page, shape, vocabulary and neighbours of a line. ``before`` is the label of the line above, ``pages`` tells which lines may be page numbers."""
    s = lines[i].strip()
    last = i + 1 == len(lines)
    words = _WORD.findall(s)
    alpha = [w for w in words if w[0].isalpha()]
    caps = sum(w[0].isupper() for w in alpha)
    known = sum(lexicon.get(w, 0) > 0 for w in alpha)
    k = i - 1
    while k > 0 and (pages[k] or not lines[k].strip()):
        k -= 1
    above, below = lines[k].rstrip() if i else "", lines[i + 1].strip() if not last else ""
    page = pages[i]
    plain = s.isdecimal()
    kind = "t" if table else "c"
    where = "first" if i == 0 else "last" if last else "mid"
    broken = bool(above) and above[-1] not in ".:;?!" and not _MARK.match(lines[i])
    f = ["b", "at:" + where, f"at:{where}:{kind}:page={page}:{plain}", "before:" + before, f"page={page}"]
    if page:
        roman = bool(_ROMAN_LETTERS.fullmatch(s))
        f += [f"page:{kind}:{'plain' if plain else 'roman' if roman else 'marked'}", f"page:{kind}:{plain}:{before}", f"page:{where}:{'plain' if plain else 'marked'}", "shape:" + _shape(s)]
        if roman:
            f.append(f"roman:known={lexicon.get(s.lower(), 0) > 0}:{len(s) > 1}")
    else:
        f += [
            f"caps={caps * 4 // max(1, len(alpha))}:{min(4, len(alpha))}:{where != 'mid'}",
            f"known={known * 4 // max(1, len(alpha))}:{min(4, len(alpha))}",
            f"caps+known={caps * 4 // max(1, len(alpha))}:{known * 4 // max(1, len(alpha))}",
            f"upper={bool(alpha) and s.upper() == s}:{len(s) > 6}:{where == 'mid'}",
            f"stamp={bool(_STAMP.search(s + ' '))}",
            f"broken={broken}:{below[:1].islower()}",
            f"marker={bool(_MARK.match(lines[i] + ' '))}",
            f"number={bool(alpha)}:{plain}",
            f"hyphen={above[-1:] in HYPHENS and bool(above)}:{s[:1].islower()}:{before}",
        ]
        form = _tokens_shape(s)
        marks = "".join(sorted({ch for ch in s if not ch.isalnum() and not ch.isspace()}))[:6]
        f += [f"form:{'-'.join(form[:3])}", f"tail:{'-'.join(form[-3:])}", f"marks:{marks}:{where == 'mid'}", f"stop:{s[-1] in '.!?'}:{len(form) > 4}", f"gap:{bool(_WIDE.search(s))}:{table}", f"short:{min(3, sum(x == 'Xx' and y == '.' for x, y in zip(form, form[1:], strict=False)))}:{where == 'mid'}", f"digits:{min(4, sum(x == '0' for x in form))}:{where == 'mid'}:{broken}"]
        f += [f"two:{x}-{y}:{broken}" for x, y in dict.fromkeys(zip(form, form[1:], strict=False))]
        f += [f"word:{w}" for w in dict.fromkeys(x.lower() for x in alpha if len(x) < 8)]
        if i and not last:
            f += [f"mid:caps={caps * 4 // max(1, len(alpha))}:known={known * 4 // max(1, len(alpha))}", f"mid:broken={broken}:caps={caps * 2 // max(1, len(alpha))}", f"mid:short={len(s) * 2 < max(len(above), len(below))}:{broken}"]
        if table:
            f.append(f"cells={min(3, cells(s))}:{cells(s) == cells(lines[0])}:{where == 'mid'}")
    return f


class LineModel:
    labels = ("text", "header", "pageno")

    def __init__(self, p: Perceptron):
        self.p = p
        self._rows: dict[str, tuple[float, float, float]] = {}

    def __getstate__(self):
        return {"p": self.p}

    def __setstate__(self, state):
        self.__init__(state["p"])

    def label(self, lines: list[str], table: bool, lexicon: dict[str, int]) -> list[str]:
        """A label for each line. What can't be a page number is none; a row of three or more cells, as many as the first line has, is part of the table."""
        if len(lines) < 2:
            return ["text"] * len(lines)
        if not self._rows:
            self._rows = {f: tuple(row.get(x, 0.0) for x in self.labels) for f, row in self.p.w.items()}
        get = self._rows.get
        pages = [is_page(x) for x in lines]
        width = cells(lines[0]) if table else 0
        out, before = [], "start"
        for i, line in enumerate(lines):
            if not line.strip() or (width > 2 and i and not pages[i] and cells(line) == width):
                before = "text"
            else:
                text = header = page = 0.0
                for f in line_features(lines, i, table, lexicon, before, pages):
                    if row := get(f):
                        text, header, page = text + row[0], header + row[1], page + row[2]
                if not pages[i]:
                    page = -1e300
                before = "text" if text >= header and text >= page else "header" if header >= page else "pageno"
            out.append(before)
        return out


# ---------------------------------------------------------------- characters


def char_features(s: str, i: int, grams: dict[str, int]) -> list[str]:
    """A window of three characters either side, and how usual the letter groups around the character are."""
    t = "^^^" + s + "$$$"
    j = i + 3
    a, b, c, d, e = t[j - 2], t[j - 1], t[j], t[j + 1], t[j + 2]
    n = sum(ch.isalpha() for ch in s)
    g = "".join(str(min(3, len(str(grams.get(t[k : k + 3].lower(), 0))))) for k in (j - 2, j - 1, j))
    return ["c:" + c, "1:" + b + c, "2:" + c + d, "3:" + b + c + d, "4:" + a + b + c, "5:" + c + d + e, "6:" + a + b + c + d + e, f"g:{c}:{g}", f"g2:{c}{d}:{g}", f"m:{c}:{n * 2 >= len(s)}:{c.isdigit()}", f"e:{c}:{i == 0}:{i + 1 == len(s)}"]


def join_features(left: str, right: str, gap: str, lexicon: dict[str, int]) -> list[str]:
    """A line end between two kept lines: what stands before and after it, and whether the halves together are a word."""
    end = left.rstrip()
    hyphen = end[-1:] if end[-1:] and end[-1:] in HYPHENS else ""
    a, b = re.search(r"[^\W\d_]+$", end[: -1 if hyphen else None] or ""), re.match(r"\s*([^\W\d_]+)", right)
    whole = ((a[0] if a else "") + (b[1] if b else "")).lower()
    known, halves = lexicon.get(whole, 0) + lexicon.get(whole.capitalize(), 0) > 0, bool(a) and bool(b) and lexicon.get(a[0].lower(), 0) > 0 and lexicon.get(b[1].lower(), 0) > 0
    return ["b", f"h:{hyphen}", f"h:{bool(hyphen)}:{bool(a)}:{bool(b)}", f"k:{bool(hyphen)}:{known}:{halves}", f"l:{bool(hyphen)}:{right.lstrip()[:1].islower()}", f"g:{bool(hyphen)}:{gap != ''}"]


@dataclass
class CharModel:
    edits: Perceptron
    joins: Perceptron
    grams: dict[str, int]

    def readings(self, word: str, prefixes: set[str], most: int = 3, width: int = 60) -> list[tuple[float, str]]:
        """Readings of a word under at most ``most`` predicted edits that stay on prefixes of the lexicon, best first (a deletion that follows its replacement is the same edit)."""
        beam: list[tuple[float, str, int, int]] = [(0.0, "", 0, 0)]
        for i, ch in enumerate(word):
            s = self.edits.scores(char_features(word, i, self.grams))
            new: dict[tuple[str, int, int], float] = {}
            for x, y, n, open_ in beam:
                for op, sc in s.items():
                    if op == "K":
                        z, k, o = y + ch, n, int(ch in _EDITS)
                    elif op == "D":
                        if not open_:
                            continue
                        z, k, o = y, n + (0 if open_ == 2 else 1), 0
                    else:
                        if op not in _EDITS.get(ch, ()):
                            continue
                        z, k, o = y + op[2:], n + 1, 2
                    if k <= most and z.lower() in prefixes:
                        key = (z, k, o)
                        if x + sc > new.get(key, -1e300):
                            new[key] = x + sc
            beam = [(x, *key) for key, x in sorted(new.items(), key=lambda t: -t[1])[:width]]
        return [(x, y) for x, y, n, _ in beam if n]


def explains(clean: str, seen: str, most: int = 3) -> bool:
    """Whether ``seen`` is ``clean`` with one to ``most`` of the known confusions: the exact check on an edit."""
    front = {(0, 0): 0}
    for i in range(len(clean)):
        for j in [j for a, j in list(front) if a == i]:
            n = front[i, j]
            if j < len(seen) and (clean[i] == seen[j] or (i == 0 and clean[i].lower() == seen[j].lower())):
                front[i + 1, j + 1] = min(n, front.get((i + 1, j + 1), 99))
            for a, b in CONFUSIONS:
                if (clean.startswith(a, i) or (i == 0 and clean.lower().startswith(a.lower()))) and seen.startswith(b, j):
                    front[i + len(a), j + len(b)] = min(n + 1, front.get((i + len(a), j + len(b)), 99))
    return 1 <= front.get((len(clean), len(seen)), 99) <= most


def reachable(word: str, prefixes: set[str], most: int = 3) -> bool:
    """Whether one to ``most`` edits lead from a word to something the lexicon begins with: most words need no scoring."""
    stack = [(0, "", 0)]
    while stack:
        i, y, n = stack.pop()
        if i == len(word):
            if n:
                return True
            continue
        if (z := y + word[i].lower()) in prefixes:
            stack.append((i + 1, z, n))
        if n < most:
            for a, b in _BACK.get(word[i], ()):
                if word.startswith(b, i) and (z := y + a.lower()) in prefixes:
                    stack.append((i + len(b), z, n + 1))
    return False


def word_correction(word: str, m: CharModel, lexicon: dict[str, int], prefixes: set[str], ratio: float = 6.0) -> str | None:
    """The word meant, if ``word`` is a misreading: the best predicted reading that known confusions explain and that the lexicon knows ``ratio`` times better than the word as it is written."""
    own = max(lexicon.get(word, 0), lexicon.get(word.lower(), 0) if word[:1].isupper() else 0)
    if len(word) < 3 or word.isdigit():
        return None
    if not reachable(word, prefixes):
        return None
    best = None
    for score, v in m.readings(word, prefixes):
        if len(v) > 2 and v.isalpha() | any(ch.isdigit() for ch in word):
            n = max(lexicon.get(v, 0), lexicon.get(v.lower(), 0), lexicon.get(v[:1].upper() + v[1:], 0))
            if n >= max(3, ratio * own) and explains(v, word) and (best is None or score > best[0]):
                best = (score, v)
    if best is None:
        return None
    v, big = best[1], word[:1].isupper() or not word[:1].isalpha()
    forms = [v, v.lower(), v[:1].upper() + v[1:].lower()]  # the case in which the corpus knows the word
    return max(forms, key=lambda f: (big or not f[:1].isupper(), lexicon.get(f, 0)))


# ---------------------------------------------------------------- repair


@dataclass
class Repairer:
    lines: LineModel
    chars: CharModel
    lexicon: dict[str, int]

    def __post_init__(self):
        self._cache: dict[str, str | None] = {}
        self._clean: set[str] = set()
        self._prefixes = {w[:k].lower() for w, n in self.lexicon.items() if n > 2 for k in range(len(w) + 1)}

    def correct(self, word: str) -> str | None:
        if word not in self._cache:
            if len(self._cache) > 200_000:
                self._cache.clear()
            self._cache[word] = word_correction(word, self.chars, self.lexicon, self._prefixes)
        return self._cache[word]

    def correct_compound(self, token: str) -> str | None:
        """A word, or words joined by hyphens: of these, a part is corrected only if the whole is then a far more usual compound. Sample codes such as Xk-59 stay."""
        if "-" not in token:
            return self.correct(token)
        parts = token.split("-")
        if any(x.isdigit() for x in parts[1:]):
            return None
        new = "-".join(self.correct(x) or x for x in parts)
        usual = lambda w: max(self.lexicon.get(w, 0), self.lexicon.get(w.lower(), 0), self.lexicon.get(w[:1].upper() + w[1:], 0))
        return new if new != token and usual(new) >= max(3, 6 * usual(token)) else None

    def __call__(self, text: str, table: bool) -> tuple[set[str], str]:
        """The kinds of noise in a text, and the text without them."""
        lines = _EOL.split(text)
        labels = self.lines.label(lines, table, self.lexicon)
        defects = {x for x in labels if x != "text"}
        out, gap = "", ""
        for line, label in zip(lines, labels, strict=True):
            if label != "text":
                gap = label
                continue
            if not out:
                out = line
            elif out.rstrip()[-1:] in HYPHENS and self.chars.joins.best(join_features(out, line, gap, self.lexicon)) == "J":
                out = out.rstrip()[:-1] + line.lstrip()
                defects.add("hyphen")
            elif gap and out.rstrip()[-1:] not in ".:;?!" and not _MARK.match(line) and not (table and cells(out.rsplit("\n", 1)[-1]) >= cells(lines[0])):
                out = out.rstrip(" ") + " " + line.lstrip(" ")
            else:
                out = out + "\n" + line
            gap = ""
        changed, end = False, len(out.rstrip())

        def fix(m: re.Match) -> str:
            nonlocal changed
            # a last word without a stop may be the rest of a longer one: it is left alone if longer words begin like it
            v = self.correct_compound(m[0]) if m.end() < end or len(m[0]) > 5 or m[0].lower() not in self._prefixes else None
            changed |= v is not None
            return v or m[0]

        new = set(_COMPOUND.findall(out)) - self._clean
        fine = {w for w in new if self.correct_compound(w) is None}
        if len(self._clean) > 500_000:
            self._clean.clear()
        self._clean |= fine
        if len(fine) < len(new):  # most texts hold only words known to be fine
            out = _COMPOUND.sub(fix, out)
        if changed:
            defects.add("chars")
        return defects, out


# ---------------------------------------------------------------- training


def _spoil_word(w: str, rng: random.Random) -> tuple[str, list[str]] | None:
    """A misread word and the operation that restores each of its characters."""
    places = [(i, a, b) for a, b in _SPOIL for i in range(len(w)) if w.startswith(a, i)]
    if not places:
        return None
    rng.shuffle(places)
    at: dict[int, tuple[str, str]] = {}
    for i, a, b in places[: 1 if rng.random() < 0.7 else 2]:
        at[i] = (a, b)
    noisy, ops, i = "", [], 0
    while i < len(w):
        a, b = at.get(i, (w[i], w[i]))
        noisy += b
        if a == b:
            ops.append("K")
        elif len(a) <= len(b):
            ops += ["R:" + a[0] if a[0] != b[0] else "K"] + ["D"] * (len(b) - 1)
        else:
            ops.append("R:" + a)
        i += len(a)
    return noisy, ops


def train_chars(lexicon: dict[str, int], seed: int = 7, max_words: int = 3000, rounds: int = 2) -> CharModel:
    """Fits the character editor on at most ``max_words`` of the most frequent words, spoilt artificially; the rest of the lexicon only serves the exact check."""
    rng = random.Random(seed)
    top = sorted(((n, w) for w, n in lexicon.items() if n > 0 and not w.isdigit()), reverse=True)
    grams: Counter[str] = Counter()
    for n, w in top[: 4 * max_words]:
        for k in range(len(w) + 2):
            grams[("^^^" + w + "$$$")[k + 1 : k + 4].lower()] += n
    words = [w for _, w in top[:max_words] if len(w) > 1]
    labels = ["K", "D", *sorted(set().union(*_EDITS.values()))]
    p = Perceptron(labels)
    for _ in range(rounds):
        rng.shuffle(words)
        for w in words:
            pairs = [(w, ["K"] * len(w))] + [x for _ in range(3) if len(w) > 2 and (x := _spoil_word(w, rng))]
            for noisy, ops in pairs:
                for i, op in enumerate(ops):
                    f = char_features(noisy, i, grams)
                    p.update(f, op if op in labels else "K", p.best(f))
    j = Perceptron(["B", "J"])
    long = [w for w in words if len(w) > 4 and w.isalpha()]
    for _ in range(rounds):
        for _ in range(min(3000, 3 * len(long))):
            w, v = rng.choice(long), rng.choice(long)
            k, h, gap = rng.randint(2, len(w) - 2), rng.choice(HYPHENS[:4]), rng.choice(["", "", "header"])
            pad = rng.choice(["", " "])
            for left, right, truth in ((f"the {w[:k]}{h}{pad}", pad + w[k:] + " is", "J"), ("the " + w, v + " is", "B"), (f"the {w} –", v, "B"), (w + ".", v.capitalize(), "B"), (f"the {w} 5{h}", "7 of", "B"), (w + ":", "(a) " + v, "B"), ("| n.d. " + h, v, "B")):
                f = join_features(left, right, gap, lexicon)
                j.update(f, truth, j.best(f))
    return CharModel(p.average(), j.average(), {k: v for k, v in grams.items()})


def _phrase(rng: random.Random, words: list[str], least: int, most: int) -> str:
    """A heading-like phrase of corpus words, with the small words headings have."""
    w = [rng.choice(words).capitalize() for _ in range(rng.randint(least, most))]
    if len(w) > 1 and rng.random() < 0.4:
        w.insert(rng.randint(1, len(w) - 1), rng.choice(["of", "in", "and", "&", "on", "for"]))
    if rng.random() < 0.15:
        w[0] = rng.choice(["The", "A"]) + " " + w[0]
    if len(w) > 3 and rng.random() < 0.15:
        w[1] += ":"
    return " ".join(w)


def _page_number(rng: random.Random, table: bool) -> str:
    """A number, alone or dressed with a word, dashes, dots or brackets; in a table body a bare number is a cell."""
    n = rng.randint(1, 999)
    number = rng.choice([str(n), str(n), f"{n % 50 + 1} of {n % 50 + 9}", f"S{n}", f"{n % 50 + 1}/{n % 50 + 9}"])
    dress = rng.choice(["· {} ·", "~ {} ~", "- {} -", "– {} –", "[{}]", "Page {}", "p. {}", "[p. {}]", "| {}", "{} |"])
    if table or rng.random() < 0.5:
        return number if number[0] == "S" else dress.format(number)
    return str(n) if rng.random() < 0.6 else _roman(rng.randint(1, 120))


def _roman(n: int) -> str:
    out = ""
    for size, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // size)
        n %= size
    return out


def _running_head(rng: random.Random, words: list[str]) -> str:
    """A line as running heads and stamps are made: a phrase as it is, in capitals, spaced out or shortened, alone or joined by a sign with people, numbers, years or ranges."""
    name = "".join(rng.choice(["ba", "ro", "ti", "lun", "vek", "mar", "so", "del", "qui", "nor"]) for _ in range(rng.randint(2, 3))).capitalize()
    n, kind = rng.randint(1, 999), rng.random()
    if kind < 0.2:  # a stamp
        stamp = " ".join(rng.choice(words).upper() for _ in range(rng.randint(1, 3)))
        return "   ".join(" ".join(w) for w in stamp.split()) if rng.random() < 0.5 else stamp
    phrase = _phrase(rng, words, 1, 4)
    if rng.random() < 0.35:
        phrase = " ".join(w[: rng.randint(3, 5)] + "." for w in phrase.replace(":", "").split() if w[0].isupper())
    elif rng.random() < 0.2:
        phrase = phrase.upper()
    other = "".join(rng.choice(["fi", "gra", "hol", "pe", "su", "tor"]) for _ in range(2)).capitalize()
    people = rng.choice([f"{name} et al.", f"{name} et al.", f"{name} and {other}", f"{name[0]}. {name}", f"{name} & {other}"])
    places = rng.choice([f"{n % 99}", f"{n % 99} ({rng.randint(1950, 2030)})", f"Vol. {n % 99}", f"Vol. {n % 99}, No. {n % 12}", f"{n % 99} ({rng.randint(1950, 2030)}) {n}–{n + 20}", f"{rng.randint(1950, 2030)}", f"{n}-{n + 9}"])
    sign = rng.choice([" / ", ", ", " ", "   ", " | ", " · ", ": "])
    lead = rng.choice(["Please cite this {} as", "Cite this {} as", "To cite this {}", "How to cite this {}", "This {} is published in", "This {} is in press in"]).format(rng.choice(["article", "paper", "work"])) + ": "
    if kind < 0.45:
        return phrase + sign + places
    if kind < 0.7:
        return people + sign + phrase
    if kind < 0.85:
        return lead + rng.choice([people + ", " + phrase, phrase])
    return phrase


def _furniture(rng: random.Random, words: list[str], table: bool) -> tuple[str, str]:
    return (_page_number(rng, table), "pageno") if rng.random() < 0.5 else (_running_head(rng, words), "header")


def _belongs(line: str, width: int) -> bool:
    """A line that is plainly part of a text: a sentence's end or continuation, a list item, a row of a table of ``width`` columns. Any other may be furniture already, so its text doesn't serve as clean."""
    return bool(_ENDS.search(line)) or line[0].islower() or bool(_MARK.match(line + " ")) or (width > 1 and cells(line) == width)


def _break(s: str, rng: random.Random) -> tuple[str, str] | None:
    gaps = [m.start() for m in re.finditer(r" ", s)]
    if len(gaps) < 2:
        return None
    k = rng.choice(gaps)
    return s[:k], s[k:] if rng.random() < 0.3 else s[k + 1 :]


def train_lines(texts: list[tuple[str, bool]], lexicon: dict[str, int], seed: int = 11, rounds: int = 5) -> LineModel:
    """Fits the line labeller on clean texts with artificial furniture; furniture never stands first or last, and may break another furniture line."""
    rng = random.Random(seed)
    p = Perceptron(list(LineModel.labels))
    words = [w for w, n in sorted(lexicon.items(), key=lambda x: -x[1])[:2000] if len(w) > 4 and w.isalpha()] or ["sample"]
    for _ in range(rounds):
        rng.shuffle(texts)
        for text, table in texts:
            rows = [(x, "text") for x in _EOL.split(text)]
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.choice([i for i, r in enumerate(rows) if r[1] == "header"] or [0]) if rng.random() < 0.3 else rng.randrange(len(rows))
                got = _break(rows[k][0], rng)
                if rng.random() < 0.25 and k + 1 < len(rows):
                    rows.insert(k + 1, _furniture(rng, words, table))
                elif got:
                    left, right = got
                    if rows[k][1] == "text" and rng.random() < 0.25 and len(left) > 4 and left[-3:].isalpha():
                        right = left[-2:] + right
                        left = left[:-2] + rng.choice(HYPHENS[:4])
                    rows[k : k + 1] = [(left, rows[k][1]), _furniture(rng, words, table), (right, rows[k][1])]
            for _ in range(rng.choice([0, 1, 2])):  # words broken over line ends, without furniture
                k = rng.randrange(len(rows))
                line, truth = rows[k]
                inner = [m for m in re.finditer(r"[^\W\d_]{5,}", line)]
                if truth == "text" and inner:
                    m = rng.choice(inner)
                    at = rng.randint(m.start() + 2, m.end() - 2)
                    rows[k : k + 1] = [(line[:at] + rng.choice(HYPHENS[:4]) + rng.choice(["", "", " "]), "text"), (rng.choice(["", "", "  "]) + line[at:], "text")]
            lines, before = [x for x, _ in rows], "start"
            if len(lines) < 2:
                continue
            pages = [is_page(x) for x in lines]
            for i, (line, truth) in enumerate(rows):
                if line.strip():
                    f = line_features(lines, i, table, lexicon, before, pages)
                    p.update(f, truth, p.best(f))
                before = truth if line.strip() else "text"
    return LineModel(p.average())


def learn_lexicon(texts: DataFrame, min_share: float = 1e-6) -> dict[str, int]:
    """Words (runs of letters or digits, as written, and those joined by hyphens) with their counts over *all* texts; those of at least ``min_share`` of all words, so at most ``1 / min_share``."""
    words, compounds = (F.regexp_extract_all("text", F.lit(x), F.lit(0)) for x in (r"[\p{L}\p{N}]+", r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]*[\p{L}][\p{L}\p{N}]*)+"))
    joined = texts.select(F.regexp_replace("text", r"(?<=\p{L})[-\x{AD}\x{AC}\x{2010}\x{2011}][ \t]*\r?\n[ \t]*(?=\p{Ll})", "").alias("text"))  # halves of broken words are no words
    counts = cut_lineage(joined.select(F.explode(F.concat(words, compounds)).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["w"]: r["n"] for r in counts.where(F.col("n") >= max(2.0, total * min_share)).collect()}


def fit(texts: DataFrame, sample: int = 1500, max_chars: int = 20_000) -> Repairer:
    """Learns the lexicon from all of ``texts(text, is_table)`` and fits both perceptrons on a bounded sample of clean texts.

    The sample has at most ``sample`` texts of each kind, of at most ``max_chars`` characters each (longer ones are repaired like all others, but train nothing): those of smallest hash.
    Rows of a hash that can't be among them are left out before anything is sorted, so that some ``4 * sample`` texts leave the tasks however many there are.
    """
    lexicon = learn_lexicon(texts)
    short = texts.where(F.length("text") <= max_chars)
    sizes = {r["is_table"]: r["n"] for r in short.groupBy("is_table").agg(F.count("*").alias("n")).collect()}
    u = F.xxhash64("text") / F.lit(2.0**64) + F.lit(0.5)
    picked = []
    for kind in (False, True):
        likely = short.where((F.col("is_table") == kind) & (u <= 4.0 * sample / max(1, sizes.get(kind, 0))))
        rows = likely.select("text").orderBy(F.xxhash64("text"), "text").limit(2 * sample).collect()
        picked += [(t, kind) for t in list(dict.fromkeys(r["text"] for r in rows))[:sample]]
    clean = []
    for t, kind in picked:
        words = _WORD.findall(t)
        lines = [x.strip() for x in _EOL.split(t) if x.strip()]
        odd = any(is_page(x) or _STAMP.search(x) or x[-1] in HYPHENS for x in lines) or not all(_belongs(x, cells(lines[0]) if kind else 0) for x in lines[1:])
        if words and not odd:
            clean.append((t, kind))
    return Repairer(train_lines(clean, lexicon), train_chars(lexicon), lexicon)


def repair(texts: DataFrame, keys: list[str], fitted: Repairer | None = None) -> DataFrame:
    """``(keys, defects array<string>, repaired string)`` for each row of ``texts(keys, text, is_table)``.

    Defects are among hyphen, chars, header, pageno, sorted; clean texts have none and come back unchanged. Null texts have no row; empty texts have no defects;
    long texts are processed whole; repeated rows give repeated results. Nothing is shuffled but word counts and the sample that trains.
    """
    src = texts.select(*dict.fromkeys([*keys, "text", "is_table"])).where(F.col("text").isNotNull())
    model = fitted or fit(src.select("text", "is_table"))
    shared = src.sparkSession.sparkContext.broadcast((model.lines, model.chars, model.lexicon))

    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = per_worker(name, lambda: Repairer(*shared.value))
        for b in batches:
            got = [r(t, bool(k)) for t, k in zip(b["text"], b["is_table"], strict=True)]
            out = b[keys].copy()
            out["defects"] = [sorted(d) for d, _ in got]
            out["repaired"] = [x for _, x in got]
            yield out

    kinds = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    return spread(src).mapInPandas(run, f"{kinds}, defects array<string>, repaired string")


def page_texts(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """``(tbl, rec_id, item_pos, text, is_table)`` of the captions and of the bodies in the tables files."""
    a = figures.select(F.lit("figures").alias("tbl"), F.col("fig_row_id").alias("rec_id"), F.lit(0).alias("item_pos"), F.col("caption").alias("text"), F.lit(False).alias("is_table"))
    b = tables.select(F.col("tab_row_id").alias("rec_id"), F.posexplode("tables.text").alias("item_pos", "text")).select(F.lit("paper_tables").alias("tbl"), "rec_id", "item_pos", "text", F.lit(True).alias("is_table"))
    return a.unionByName(b).where(F.col("text").isNotNull())
