"""When two questions ask the same.

A question is cut into words.  Words frequent in the corpus (and a fixed list of plain words) are its form; all others, and
all numbers, are what it is about: its subject.  Two questions ask the same if their subjects are equal, in the same order
but for numbers (a clause such as "in 1741" may stand anywhere), and their forms differ only by function words,
courtesies, words of like meaning, single slips of the pen in words other than names, and at most two words on one side
only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.text import words

# Words of like meaning, function words, courtesies, and plain words known in any corpus.
LIKE = dict(
    pair.split("=")
    for pair in (
        "referred=known entered=listed asserts=claims stated=given noted=recorded connects=links constructed=built bigger=larger "
        "greater=higher start=begin close=near title=name called=named going=according briefest=shortest situated=located "
        "lower=smaller via=through started=began commenced=began film=movie purchased=bought wed=married"
    ).split()
)
FUNCTION = frozenset("the a an of in to as at by for on with from and into onto upon it its".split())
COURTESY = frozenset(
    "hi hello hey dear please kindly thanks thank you q quick question rephrased said answer one be brief could can would".split()
)
# What is said before and after a question.
BEFORE = re.compile(
    r"^(?:(?:hi|hello|hey|dear all|q|quick question|question \d+|rephrased|(?:please |kindly |can you |could you |would you )+tell me"
    r"|tell me(?= (?:what|which|who|when|where|how|does|is|in|for|among|whether|if)\b)|i (?:would|want to|wish to) (?:like to )?know|please|kindly) )+"
)
AFTER = re.compile(r"(?: (?:please be brief|be brief|please|answer with the label only|one answer|thanks|thank you|many thanks))+$")
PLAIN = frozenset(
    "what which who whom whose when where why how many much does did is was were are has have had that this than after before "
    "between among tell me name number total first".split()
)
#: A word is frequent in this share of the questions or more; the words of a question are few, so such words are at most some
#: tens of thousands at any size.
FREQUENT = 0.001
LEFT_OVER = 2


def vocabulary(questions: DataFrame, column: str) -> dict[str, int]:
    """The frequent words of the distinct questions, and how many have them: at most (words of a question) / ``FREQUENT`` words reach the driver."""
    texts = questions.select(F.col(column).alias("q")).filter("q is not null").distinct()
    tokens = texts.select(F.explode(F.array_distinct(folded_words(F.col("q")))).alias("word"))
    n = texts.count()
    counts = tokens.groupBy("word").count().filter(F.col("count") >= max(3, math.ceil(FREQUENT * n)))
    return {r.word: r["count"] for r in counts.toLocalIterator() if not any(c.isdigit() for c in r.word)}


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_words(text: pd.Series) -> pd.Series:
    return text.map(words)


def one_slip(a: str, b: str) -> bool:
    """Whether a and b differ by one letter added, dropped, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Reader:
    """Reads questions against a vocabulary; one per Python worker."""

    def __init__(self, vocabulary_: Mapping[str, int] | Iterable[str]):
        self.counts = dict(vocabulary_) if isinstance(vocabulary_, Mapping) else {}
        self.known = frozenset(vocabulary_) | PLAIN | FUNCTION | COURTESY | frozenset(LIKE) | frozenset(LIKE.values())
        self.dropped: dict[str, list[str]] = {}
        for w in self.known:
            if len(w) >= 3 and w.isascii():
                for v in {w[:i] + w[i + 1 :] for i in range(len(w))}:
                    self.dropped.setdefault(v, []).append(w)
        self.memo: dict[str, tuple[str, ...]] = {}

    def meant(self, word: str) -> tuple[str, ...]:
        """The known words of which ``word`` may be a slip; itself if known; none for a name or number."""
        if word in self.known:
            return (word,)
        if len(word) < 2 or any(c.isdigit() for c in word):
            return ()
        got = self.memo.get(word)
        if got is None:
            shorter = {word[:i] + word[i + 1 :] for i in range(len(word))}
            near = set(self.dropped.get(word, ())) | {v for v in shorter if v in self.known and len(v) >= 3}
            for v in shorter:
                near.update(self.dropped.get(v, ()))
            got = tuple(sorted(w for w in near if one_slip(word, w)))
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def read(self, text: str) -> tuple[str, str, str]:
        """Subject (names in order, then sorted numbers), form (likeliest known words in order), and the words kept for
        comparison, each joined by blanks."""
        return self.read_whole(text)[:3]

    def read_whole(self, text: str) -> tuple[str, str, str, str, int]:
        """As ``read``, then the line: names, numbers and the known words meant, in order; and how many words may be slips of
        several, which the line leaves out.  Lines of questions that ask the same have the same subject words and differ by at
        most ``LEFT_OVER`` other words and one for each such word."""
        names, numbers, form, kept, line, doubts = [], [], [], [], [], 0
        for w in AFTER.sub("", BEFORE.sub("", text)).split(" "):
            if not w or w in COURTESY or w in FUNCTION:
                continue
            if any(c.isdigit() for c in w):
                numbers.append(w)
                line.append(w)
                continue
            meant = self.meant(w)
            if not meant:
                names.append(w)
                line.append(w)
                continue
            likely = max(meant, key=lambda m: (self.counts.get(m, 0), m))
            if w not in self.known and all(m in COURTESY or m in FUNCTION for m in meant):
                continue
            kept.append(LIKE.get(w, w))
            form.append(LIKE.get(likely, likely))
            meanings = {LIKE.get(m, m) for m in meant}
            if len(meanings) == 1:
                line.extend(meanings)
            else:
                doubts += 1
        return " ".join([*names, "|", *sorted(numbers)]), " ".join(form), " ".join(kept), " ".join(line), doubts

    def same(self, a: str, b: str) -> bool:
        """Whether two questions of one subject ask the same, given the words kept for comparison."""
        x, y = Counter(a.split(" ") if a else []), Counter(b.split(" ") if b else [])
        left, right = list((x - y).elements()), list((y - x).elements())
        for w in left[:]:
            for v in right:
                if w in self.known and v in self.known:
                    continue
                mw, mv = {LIKE.get(m, m) for m in self.meant(w)}, {LIKE.get(m, m) for m in self.meant(v)}
                if mw & mv:
                    left.remove(w)
                    right.remove(v)
                    break
        left, right = ([w for w in s if w in self.known or not any(m in FUNCTION or m in COURTESY for m in self.meant(w))] for s in (left, right))
        return not (left and right) and len(left) + len(right) <= LEFT_OVER


def reading(vocabulary_: Mapping[str, int]) -> Callable[[Column], Column]:
    """A column function: folded words joined by blanks to a struct of ``subject``, ``kept``, ``line`` and ``doubts``."""
    made: list[Reader] = []

    @F.pandas_udf("subject string, kept string, line string, doubts int")
    def read(text: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Reader(vocabulary_))
        rows = [made[0].read_whole(t or "") for t in text]
        return pd.DataFrame([(r[0], r[2], r[3], r[4]) for r in rows], columns=["subject", "kept", "line", "doubts"])

    return read


def sameness(vocabulary_: Mapping[str, int]) -> Callable[[Column, Column], Column]:
    made: list[Reader] = []

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        if not made:
            made.append(Reader(vocabulary_))
        return pd.Series([made[0].same(x or "", y or "") for x, y in zip(a, b)], dtype=bool)

    return same


def folded(text: Column) -> Column:
    """The question as folded words joined by blanks: equal for questions that differ by case, accents, punctuation or
    spacing only."""
    return F.array_join(folded_words(text), " ")
