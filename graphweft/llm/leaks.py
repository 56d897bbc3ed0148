"""Evaluation texts leaking into a corpus: Wu-Manber multi-pattern search over words, then an alignment of passage and item.

Patterns are all runs of ``PATTERN`` words of the evaluation items.  A window slides over the document; the pair of words at its
end gives a shift, and only where the shift is 0 are the patterns of that suffix compared word by word.  Where found patterns
near each other cover enough of an item, passage and item are aligned.

A passage must repeat its share of the item's words twice over: counted, and weighed by how few of the items have each word.
Weights hang on the share of items with the word, not on their number; without them, two sentences of like build about other
things would count as a leak.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.text import bare_words
from graphweft.session import cut

PATTERN = 3
SHARE = 0.4
#: A word in this share of the items weighs half of one that no other item has; one in all items still weighs a tenth.
COMMON = 0.01
#: Part of the share that found patterns must cover before passage and item are aligned: at most half of the words to be
#: repeated may stand in runs shorter than ``PATTERN``.
COVERED = 0.5
#: Evaluation items are held by every worker; with more words they are cut into shards, for each of which the corpus is read.
SHARD_WORDS = 2_000_000
#: Passages aligned at once.
BATCH = 2048


class Search:
    def __init__(self, items: dict[str, list[str]]):
        self.items = items
        self.patterns: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        for item, w in items.items():
            size = min(PATTERN, len(w))  # a shorter item is one pattern
            for k in range(len(w) - size + 1):
                if size:
                    self.patterns[tuple(w[k : k + size])].append((item, k))
        self.short = {size for size in map(len, self.patterns) if size < PATTERN}
        self.ids: dict[str, int] = {}
        self.words = {i: np.array([self.ids.setdefault(x, len(self.ids)) for x in w], dtype=np.int64) for i, w in items.items()}
        having = Counter(x for w in items.values() for x in set(w))
        weigh = {x: 1 / (1 + math.sqrt(n / len(items) / COMMON)) for x, n in having.items()}
        self.weights = {i: (own := np.array([weigh[x] for x in w])) / max(own.sum(), 1e-9) for i, w in items.items()}
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], list[tuple[str, ...]]] = defaultdict(list)
        for p in self.patterns:
            if len(p) == PATTERN:
                for k in range(PATTERN - 1):
                    block, far = p[k : k + 2], PATTERN - 2 - k
                    self.shift[block] = min(self.shift.get(block, PATTERN - 1), far)
                self.bucket[p[-2:]].append(p)

    def hits(self, text: list[str]) -> Iterator[tuple[str, int, int]]:
        """Occurrences of patterns: item, place in the item, place in the text."""
        for size in self.short:
            for begin in range(len(text) - size + 1):
                for item, at in self.patterns.get(tuple(text[begin : begin + size]), ()):
                    yield item, at, begin
        end, n, shift = PATTERN - 1, len(text), self.shift
        while end < n:
            far = shift.get((text[end - 1], text[end]), PATTERN - 1)
            if far:
                end += far
                continue
            begin = end - PATTERN + 1
            for p in self.bucket[text[end - 1], text[end]]:
                if all(text[begin + k] == p[k] for k in range(PATTERN)):
                    for item, at in self.patterns[p]:
                        yield item, at, begin
            end += 1

    def passages(self, text: list[str]) -> Iterator[tuple[str, int, int]]:
        """Item, begin and end of the stretches of a text that may repeat enough of an item: those in which found patterns cover
        ``COVERED`` of the share, counted and weighed.  A stretch holds an item with half as many words again put in, and as much around it."""
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, at, place in self.hits(text):
            found[item].append((place, at))
        for item, places in found.items():
            n = len(self.items[item])
            need, size = COVERED * SHARE, min(PATTERN, n)
            if size * len(places) < need * n:
                continue
            reach, weights = n * 3 // 2, self.weights[item].tolist()
            times = [0] * n
            covered = first = 0
            weight, until = 0.0, -1
            for place, at in places:  # in order of the text; a window of ``reach`` slides over them
                for k in range(at, at + size):
                    if not times[k]:
                        covered += 1
                        weight += weights[k]
                    times[k] += 1
                while places[first][0] < place - reach:
                    for k in range(places[first][1], places[first][1] + size):
                        times[k] -= 1
                        if not times[k]:
                            covered -= 1
                            weight -= weights[k]
                    first += 1
                if covered >= need * n and weight >= need - 1e-9 and place >= until:
                    begin = max(0, place - 2 * n)
                    yield item, begin, min(len(text), place + 2 * n)
                    until = place + n  # what comes before is inside this stretch

    def leaked(self, texts: list[list[str]]) -> list[tuple[int, str, float]]:
        """Number of the text, item and share, where a text repeats ``SHARE`` of an item's words or more."""
        best: dict[tuple[int, str], float] = {}
        waiting: list[tuple[int, str, np.ndarray]] = []

        def flush() -> None:
            waiting.sort(key=lambda x: (len(self.items[x[1]]), len(x[2])))
            for k in range(0, len(waiting), BATCH):
                part = waiting[k : k + BATCH]
                shares = aligned([self.words[i] for _, i, _ in part], [self.weights[i] for _, i, _ in part], [p for _, _, p in part])
                for (t, item, _), share in zip(part, shares.tolist()):
                    best[t, item] = max(best.get((t, item), 0.0), share)
            waiting.clear()

        for t, text in enumerate(texts):
            ids = None
            for item, begin, end in self.passages(text):
                if ids is None:
                    ids = np.fromiter((self.ids.get(w, -1) for w in text), dtype=np.int64, count=len(text))
                waiting.append((t, item, ids[begin:end]))
            if len(waiting) >= 4 * BATCH:
                flush()
        flush()
        return [(t, item, share) for (t, item), share in best.items() if share]


def aligned(items: list[np.ndarray], weights: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Per pair the share of the item's words that the passage repeats in order in one stretch, 0.0 unless both the words and
    their weights come to ``SHARE``: the matches of a best local alignment, in which a changed, missing or added word costs twice
    what a repeated one gains.  Runs of repeated words are thus joined across single changes.

    A cell is the score, the matches and their weight in one number, so that of equal scores the one with more matches stands; a
    row of cells of all pairs is computed at once, the step along the row by a running maximum.
    """
    score, match = 1 << 40, 1 << 20  # weights come to 2 ** 18 and some rounding
    cost = 4 * score
    rows, width = max(map(len, items)), max(map(len, passages))
    item = np.full((len(items), rows), -2, dtype=np.int64)
    gain = np.zeros((len(items), rows), dtype=np.int64)
    text = np.full((len(items), width), -3, dtype=np.int64)
    for k, (i, w, p) in enumerate(zip(items, weights, passages)):
        item[k, : len(i)], text[k, : len(p)] = i, p
        gain[k, : len(i)] = 2 * score + match + np.ceil(w * (1 << 18)).astype(np.int64)
    size = np.array([len(i) for i in items], dtype=np.int64)[:, None]
    slope = np.arange(width + 1, dtype=np.int64) * cost
    cell = np.zeros((len(items), width + 1), dtype=np.int64)
    best = np.zeros(len(items), dtype=np.int64)
    for r in range(rows):
        step = np.where(text == item[:, r : r + 1], gain[:, r : r + 1], -cost)
        new = cell - cost
        np.maximum(new[:, 1:], cell[:, :-1] + step, out=new[:, 1:])
        new = np.maximum.accumulate(np.where(new < score, 0, new) + slope, axis=1) - slope
        cell = np.where(new < score, 0, new)
        matches = cell % score // match
        enough = (matches >= SHARE * size) & (cell % match >= SHARE * (1 << 18))
        np.maximum(best, np.where(enough, matches, 0).max(axis=1), out=best)
    return best / size[:, 0]


def shards(items: DataFrame) -> Iterator[dict[str, list[str]]]:
    """The items' words, at most about ``SHARD_WORDS`` of them at a time."""
    part: dict[str, list[str]] = {}
    size = 0
    for r in items.toLocalIterator():
        part[r.item_id] = bare_words(r.text)
        size += len(part[r.item_id])
        if size >= SHARD_WORDS:
            yield part
            part, size = {}, 0
    yield part


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``share``: documents that repeat at least ``SHARE`` of the words of an item's text, in order
    and in one passage, whatever the case, accents, punctuation, spacing, markup or marks put in, single words changed.

    NULL ids and NULL or empty texts on either side give nothing, items without any word neither; copies of an item id are read as
    the greatest text.  The corpus is read once per shard of items (``SHARD_WORDS``) and never shuffled; a shard goes to every
    worker, and one shard is held at a time.
    """
    rows = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select("doc_id", "text").filter("doc_id is not null and text <> ''")

    def searched(held: dict[str, list[str]]) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = Search(held)
            for batch in batches:
                ids = batch.doc_id.tolist()
                out = [(ids[t], item, share) for t, item, share in s.leaked([bare_words(t) for t in batch.text])]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

        return texts.mapInPandas(search, f"doc_id {kind}, item_id string, share double")

    found: list[DataFrame] = []
    for held in shards(rows):
        if found:
            found[-1] = cut(found[-1])  # done with before the next shard is loaded
        found.append(searched(held))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
