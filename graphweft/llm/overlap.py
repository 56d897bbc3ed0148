"""Questions of evaluation splits that occur in the training split.

Evaluation questions are cut into shards; each shard gets a full-text index over plain words (suffix order, Burrows-Wheeler
transform, rank lists).  Training questions are streamed through the index by backward search, a whole batch in step, which
yields the maximal matches with every evaluation question by itself.  Matches on one evaluation question are merged and
counted; where they cover all names and numbers of both questions, a comparison word by word decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm import questions
from graphweft.session import cut

#: Distinct questions of either side in one shard, on average; a shard with more is cut into several.
SHARD = 20_000


class FullTextIndex:
    """Backward search over texts of integer symbols."""

    def __init__(self, texts: list[list[int]], symbols: int):
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        flat = np.fromiter((s + 1 for t in texts for s in (*t, -1)), dtype=np.int64)  # 0 ends a text
        self.flat = flat
        self.suffixes = _suffix_order(flat)
        last = flat[self.suffixes - 1]
        order = np.argsort(last, kind="stable")
        bounds = np.searchsorted(last[order], np.arange(symbols + 2))
        self.first = bounds  # symbols smaller than each one
        self.ranks = order  # rows of each symbol in the transform, in order
        self.length = len(flat)
        self.keys = last[order] * (self.length + 1) + order  # ascending: where (symbol, row) stands is the row one step on

    def _step(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        begin, end = self.first[symbol + 1], self.first[symbol + 2]
        rows = self.ranks[begin:end]
        return begin + int(np.searchsorted(rows, low)), begin + int(np.searchsorted(rows, high))

    def maximal(self, pattern: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """All maximal matches of ``pattern``: begin, end, and where they occur in the flat text.  Unknown symbols are -1."""
        covered = len(pattern) + 1
        for end in range(len(pattern), 0, -1):
            low, high, begin = 0, self.length, end
            while begin and pattern[begin - 1] >= 0:
                a, b = self._step(pattern[begin - 1], low, high)
                if a >= b:
                    break
                low, high, begin = a, b, begin - 1
            if begin < end and begin < covered:
                covered = begin
                yield begin, end, self.suffixes[low:high]

    def maximal_each(self, pattern: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """As ``maximal``, but maximal for each place by itself: a longer match in one text hides none in another.  Every place
        of a symbol of the pattern is in some match."""
        for end in range(len(pattern), 0, -1):
            low, high, begin = 0, self.length, end
            while low < high:
                known = begin and pattern[begin - 1] >= 0
                a, b = self._step(pattern[begin - 1], low, high) if known else (0, 0)
                if begin < end:
                    stays = np.ones(high - low, dtype=bool)
                    stays[self.ranks[a:b] - low] = False  # these are longer on the left
                    places = self.suffixes[low:high][stays]
                    if end < len(pattern) and pattern[end] >= 0:
                        places = places[self.flat[places + end - begin] != pattern[end] + 1]
                    if len(places):
                        yield begin, end, places
                low, high, begin = a, b, begin - 1

    def steps(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step to the left of many searches at once."""
        base = (symbols + 1) * (self.length + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def telling(self, patterns: list[list[int]], tells: list[list[bool]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """The matches of ``maximal_each`` that hold a telling symbol, for many patterns at once: pattern, begin, end, places.
        Matches of other symbols alone, which may be in any text, are never located."""
        starts = np.cumsum([0, *map(len, patterns)])
        flat = np.fromiter((s for p in patterns for s in p), dtype=np.int64, count=starts[-1])
        told = np.cumsum([0, *(t for own in tells for t in own)])
        which = np.repeat(np.arange(len(patterns)), np.diff(starts))
        end = np.arange(1, len(flat) + 1)
        begin, low, high = end.copy(), np.zeros(len(flat), dtype=np.int64), np.full(len(flat), self.length, dtype=np.int64)
        while len(end):
            first = starts[which]
            symbol = np.where(begin > first, flat[np.maximum(begin - 1, 0)], -1)
            a, b = self.steps(np.maximum(symbol, 0), low, high)
            a, b = np.where(symbol >= 0, a, 0), np.where(symbol >= 0, b, 0)
            for k in np.flatnonzero((b - a < high - low) & (told[end] > told[begin])):
                stays = np.ones(high[k] - low[k], dtype=bool)
                stays[self.ranks[a[k] : b[k]] - low[k]] = False  # these are longer on the left
                places = self.suffixes[low[k] : high[k]][stays]
                if end[k] < starts[which[k] + 1] and flat[end[k]] >= 0:
                    places = places[self.flat[places + end[k] - begin[k]] != flat[end[k]] + 1]
                if len(places):
                    yield int(which[k]), int(begin[k] - first[k]), int(end[k] - first[k]), places
            on = a < b
            which, end, begin, low, high = which[on], end[on], begin[on] - 1, a[on], b[on]

    def located(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and offset of places in the flat text."""
        text = np.searchsorted(self.starts, places, side="right") - 1
        return text, places - self.starts[text]


def _suffix_order(flat: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; a suffix wraps around, which the end symbols make harmless."""
    _, rank = np.unique(flat, return_inverse=True)
    width, n = 1, len(flat)
    while True:
        order = np.lexsort((np.roll(rank, -width), rank))
        a, b = rank[order], np.roll(rank, -width)[order]
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        if new.max() == n - 1 or width >= n:
            return np.argsort(new, kind="stable")
        rank, width = new, width * 2


def names_of(subject: str) -> list[str]:
    """The words a question is about; a question about nothing is told by all of its words."""
    return [w for w in subject.split(" ") if w and w != "|"]


def spans(a: list[str], b: list[str]) -> tuple[int, int]:
    """Words of ``b`` within matches with ``a`` that nothing prolongs, and the longest of them."""
    covered: set[int] = set()
    longest = 0
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = next(n for n in range(1, len(a) + 1) if i + n >= len(a) or j + n >= len(b) or a[i + n] != b[j + n])
                covered.update(range(j, j + n))
                longest = max(longest, n)
    return len(covered), longest


def matches(train: pd.DataFrame, held: pd.DataFrame, same: Callable[[str, str], bool]) -> pd.DataFrame:
    """Pairs of one shard that ask the same, found by the index: a row per training and evaluation question."""
    ids: dict[str, int] = {}
    lines = [x.split(" ") for x in held.line]
    texts = [[ids.setdefault(w, len(ids)) for w in line] for line in lines]
    asked = [x.split(" ") for x in train.line]
    about = [set(names_of(s)) for s in train.subject]
    out: list[tuple[str, str, int, int, int]] = []
    if texts and asked:
        index = FullTextIndex(texts, len(ids))
        patterns = [[ids.get(w, -1) for w in line] for line in asked]
        found: dict[tuple[int, int], set[int]] = {}
        for k, begin, end, places in index.telling(patterns, [[w in own or not own for w in line] for line, own in zip(asked, about)]):
            for text in set(index.located(places)[0].tolist()):
                found.setdefault((k, text), set()).update(range(begin, end))
        for (k, text), covered in found.items():
            # The merged matches must hold every name and number; what else differs is for the comparison.
            if about[k] <= {asked[k][i] for i in covered} and train.subject[k] == held.subject[text] and same(train.kept[k], held.kept[text]):
                out.append((train.folded[k], held.folded[text], *spans(asked[k], lines[text]), len(lines[text])))
    return pd.DataFrame(out, columns=["train", "held", "covered", "longest", "length"])


def text_pairs(train: DataFrame, held: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Pairs of distinct folded questions that ask the same: ``train``, ``held``, ``covered`` (words of the evaluation
    question within merged matches), ``longest``, ``length``.

    A question goes to the shard of its anchor, the one of its names and numbers with the least hash, so that each training
    question is streamed through one index; no name is in more than ``questions.FREQUENT`` of the questions.  A shard with more
    than ``SHARD`` questions on a side (those about nothing, or a small vocabulary) is cut into pieces, and every piece of one
    side meets every piece of the other.
    """
    read = questions.reading(vocabulary)

    def side(df: DataFrame, name: str) -> DataFrame:
        out = df.select("folded").distinct().withColumn("_r", read("folded"))
        about = F.filter(F.split("_r.subject", " "), lambda w: (w != "") & (w != "|"))
        anchor = F.array_min(F.transform(about, lambda w: F.xxhash64(w)))
        return cut(out.select("folded", "_r.subject", "_r.line", "_r.kept", F.coalesce(anchor, F.lit(0)).alias("anchor")))

    train, held = side(train, "train"), side(held, "held")
    shards = max(1, -(-(train.count() + held.count()) // SHARD))
    shard = F.pmod("anchor", F.lit(shards)).cast("int").alias("shard")
    sizes = lambda df, n: df.groupBy(shard).agg(F.ceil(F.count("*") / SHARD).cast("int").alias(n))
    pieces = sizes(train, "_tp").join(sizes(held, "_hp"), "shard")
    own = lambda p: F.pmod(F.hash("folded"), F.col(p))
    every = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    columns = ["shard", "tp", "hp", "folded", "subject", "line", "kept"]
    t = train.withColumn("shard", shard).join(pieces, "shard").withColumn("tp", own("_tp")).withColumn("hp", every("_hp"))
    h = held.withColumn("shard", shard).join(pieces, "shard").withColumn("hp", own("_hp")).withColumn("tp", every("_tp"))
    t, h = (df.select(*columns).toDF(*columns) for df in (t, h))
    keys = ["shard", "tp", "hp"]
    made: list[questions.Reader] = []

    def compared(train: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(questions.Reader(vocabulary))
        return matches(train, held, made[0].same)

    return t.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInPandas(compared, "train string, held string, covered int, longest int, length int")


# How the splits are written.
TRAIN = ("train", "training")
HELD = ("dev", "development", "valid", "validation", "val", "test", "testing")


def cross_split(examples: DataFrame) -> DataFrame:
    """Pairs of examples of the training split and an evaluation split whose questions ask the same: ``train_id``,
    ``held_id``, ``split`` (dev or test, as ``validation`` is dev), ``dataset`` of the evaluation example, ``covered``,
    ``longest``, ``length``.

    Rows with a NULL id, an unknown or NULL split, or a question without any word belong to no pair; an example delivered
    twice counts once.  Copies on either side pair with all copies on the other; the index itself sees each text once.
    """
    split = F.lower(F.trim("split"))
    side = F.when(split.isin(*TRAIN), "train").when(split.isin(*HELD), "held")
    kind = F.when(split.startswith("test"), "test").otherwise("dev")
    rows = examples.select(F.col("example_id").alias("id"), side.alias("side"), kind.alias("split"), "dataset", "question").filter("id is not null and side is not null and question is not null")
    rows = cut(rows.withColumn("folded", questions.folded(F.col("question"))).filter("folded <> ''").select("id", "side", "split", "dataset", "folded").dropDuplicates(["id", "side", "folded"]))
    vocabulary = questions.vocabulary(rows, "folded")
    train, held = rows.filter("side = 'train'"), rows.filter("side = 'held'")
    pairs = text_pairs(train, held, vocabulary)
    out = pairs.join(train.select(F.col("id").alias("train_id"), F.col("folded").alias("train")), "train")
    out = out.join(held.select(F.col("id").alias("held_id"), "split", "dataset", F.col("folded").alias("held")), "held")
    return out.select("train_id", "held_id", "split", "dataset", "covered", "longest", "length")
