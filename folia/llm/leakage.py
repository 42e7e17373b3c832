"""Held-out passages inside training text: one Aho-Corasick automaton over all items, one scan of each text.

The alphabet of the automaton is words, not characters: a word of an item has a number, any other word is 0. Patterns are all windows of ``window`` words of
the items' texts. The corpus is read once, whatever the number of items: a table of more than ``max_windows`` windows makes several automata, which a task runs one after
the other over a chunk of its texts. A match is mapped back to offsets of the original text.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.runtime import not_blank, per_worker, spread

#: Tags are blanked out at equal length, so that offsets stay those of the original text.
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->|&(?:nbsp|shy|amp|lt|gt|quot|#\d{1,7}|#x[0-9A-Fa-f]{1,6});", re.S)
_WORD = re.compile(r"[^\W_]+(?:­[^\W_]+)*")


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """Words (runs of letters or digits, without case and compatibility forms) with their offsets in ``text``; markup is no part of words."""
    blank = _TAG.sub(lambda m: " " * len(m[0]), text)
    return [(unicodedata.normalize("NFKC", m[0].replace("­", "")).casefold(), m.start(), m.end()) for m in _WORD.finditer(blank)]


class Automaton:
    """The windows of a block of items. ``find`` gives maximal matched stretches: ``(item, first char, last char + 1, words)``."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        import ahocorasick

        self.window, self.number, self.items = window, {}, []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        own: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w, _, _ in word_spans(text)]
            for k in range(len(ids) - window + 1):
                own.setdefault(tuple(ids[k : k + window]), set()).add(item)
        for key, of in own.items():
            self.machine.add_word(key, tuple(sorted(of)))
        self.empty = not own
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        return self.find_spans(word_spans(text))

    def find_spans(self, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
        if self.empty or len(spans) < self.window:
            return []
        open_, out = {}, []
        for end, of in self.machine.iter(tuple(self.number.get(w, 0) for w, _, _ in spans)):
            start = end - self.window + 1
            for item in of:
                if item in open_ and start <= open_[item][1] + 1:
                    open_[item][1] = end
                else:
                    if item in open_:
                        out.append((item, *open_[item]))
                    open_[item] = [start, end]
        out += [(item, *x) for item, x in open_.items()]
        return sorted((item, spans[a][1], spans[b][2], b - a + 1) for item, a, b in out)


def item_blocks(items: DataFrame, item_key: str, text: str, window: int, max_windows: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of at most ``max_windows`` windows each (an item is never divided); items of fewer than ``window`` words can't match."""
    blocks, size = [[]], 0
    for r in items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).where(not_blank(F.col("t")) & F.col("k").isNotNull()).toLocalIterator():
        n = max(0, len(word_spans(r["t"])) - window + 1)
        if n == 0:
            continue
        if size + n > max_windows and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r["k"], r["t"]))
        size += n
    return [b for b in blocks if b]


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "passage", window: int = 12, max_windows: int = 500_000, kept: int = 3, chunk_chars: int = 64_000_000
) -> DataFrame:
    """``(doc_key, item_key, start_char, end_char, n_words)``: every maximal stretch of at least ``window`` words that a text shares with an item.

    Null and blank texts have no rows; items that share a passage are each reported; repeated documents are reported each; texts are read whole, whatever their
    length; an empty table on either side gives no rows. No shuffle and one scan: the items travel with the tasks. Up to ``kept`` automata stay with a worker; of more, each is built once for every
    ``chunk_chars`` characters of texts, so at most one is held at a time. The result is the same. The items themselves are a benchmark: a fixed table that one worker can hold.
    """
    kind = items.schema[item_key].dataType.simpleString()
    src = spread(docs.select(docs[doc_key].alias(doc_key), docs[text].alias("_text")).where(F.col("_text").isNotNull()))
    schema = f"`{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, `{item_key}` {kind}, start_char int, end_char int, n_words int"
    shared = src.sparkSession.sparkContext.broadcast(item_blocks(items, item_key, item_text, window, max_windows))
    name = uuid.uuid4().hex

    def chunks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[list]:
        """Keys and texts, some batches at once: as many as have ``most`` characters."""
        rows, size = [], 0
        for b in batches:
            rows += zip(b[doc_key], b["_text"], strict=True)
            size += int(b["_text"].str.len().sum())
            if size >= most:
                yield rows
                rows, size = [], 0
        yield rows

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = shared.value
        few = len(blocks) <= kept
        for rows in chunks(batches, 0 if few else chunk_chars):
            spans = [(k, word_spans(t)) for k, t in rows] if few and blocks else []
            for i, block in enumerate(blocks):
                machine = per_worker(f"{name} {i}", lambda block=block: Automaton(block, window)) if few else Automaton(block, window)
                hits = [(k, *h) for k, x in spans for h in machine.find_spans(x)] if few else [(k, *h) for k, t in rows for h in machine.find(t)]
                yield pd.DataFrame(hits, columns=[doc_key, item_key, "start_char", "end_char", "n_words"])

    return src.mapInPandas(scan, schema)
