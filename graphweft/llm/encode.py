"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is one last token with which the encoding of that prefix ends.  Storing it per byte gives
the encoding of any prefix by walking back, makes an append exact without looking at what came before, and an edit costs
only the bytes from its place on.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A fixed value: the pattern that cuts a text into pieces before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000


def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: a line per token, base64 and id."""
    return {base64.b64decode(token): int(i) for token, i in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                left, right = self._halves(token, i)
                self.parts[i] = left, right
                self.merged[left, right] = i
        self.agrees: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes, i: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``: what merges of lower rank leave of it."""
        have = [token[k : k + 1] for k in range(len(token))]
        while len(have) > 2:
            best = min(range(len(have) - 1), key=lambda k: self.ranks.get(have[k] + have[k + 1], i))
            if self.ranks.get(have[best] + have[best + 1], i) >= i:
                raise ValueError("no sequence of merges gives this token")
            have[best : best + 2] = [have[best] + have[best + 1]]
        return self.ranks[have[0]], self.ranks[have[1]]

    def follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens: no merge across the border comes before the merges
        that made them.  Merges are undone from the latest on, on the side where the latest is."""
        key = left, right
        got = self.agrees.get(key)
        if got is None:
            got = self.agrees[key] = self._follow(left, right)
        return got

    def _follow(self, left: int, right: int) -> bool:
        bound = len(self.ranks) + 256
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            ahead, behind = left in self.parts, right in self.parts
            if not ahead and not behind:
                return True
            # Undo the later of the two latest merges at the border; on equal tokens the left one was made first.
            if ahead and (not behind or left > right):
                bound, left = left, self.parts[left][1]
            elif behind:
                bound, right = right + 1, self.parts[right][0]


class Prefixes:
    """The last tokens of all prefixes of one piece; ``append`` and ``replace`` keep them exact."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.bytes, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        done, self.bytes = len(self.bytes), self.bytes + more
        v, last, data = self.vocabulary, self.last, self.bytes
        for end in range(done + 1, len(data) + 1):
            for begin in range(max(0, end - v.longest), end):
                token = v.ranks.get(data[begin:end])
                if token is not None and (begin == 0 or v.follow(last[begin - 1], token)):
                    last.append(token)
                    break

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Bytes ``begin`` to ``end`` become ``new``.  Prefixes before are kept; behind the edit, last tokens are the old ones
        again as soon as those of a whole token's length agree."""
        old_last, old_tail, v = self.last, self.bytes[end:], self.vocabulary
        self.last, self.bytes = self.last[:begin], self.bytes[:begin]
        self.append(new)
        agreed = 0
        for k in range(len(old_tail)):
            if agreed >= v.longest:
                self.last.extend(old_last[end + k :])
                self.bytes += old_tail[k:]
                return
            self.append(old_tail[k : k + 1])
            agreed = agreed + 1 if self.last[-1] == old_last[end + k] else 0

    def ids(self) -> list[int]:
        out, at = [], len(self.bytes)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Texts to ids; pieces seen before are remembered."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(ranks_of(path))
        self.cut = regex.compile(PIECES).findall
        self.seen: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        got = self.seen.get(piece)
        if got is None:
            data = piece.encode("utf-8", "surrogatepass")
            one = self.vocabulary.ranks.get(data)
            got = Prefixes(self.vocabulary, data).ids() if one is None else [one]
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece in self.cut(text or ""):
            out += self.piece(piece)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``documents`` with ``ids``, an ARRAY<INT> in place of ``text``: the ids of the text by the rank file at ``path``, which
    all workers can read.  NULL and empty texts give an empty list.  Each worker reads the file once."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for batch in batches:
            yield batch.map(e.encode)

    kept = [c for c in documents.columns if c not in (text, "ids")]
    return documents.select(*kept, ids(F.coalesce(text, F.lit(""))).alias("ids"))
