"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_words(text: Column) -> Column:
    """The words, in lower case, joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), " ")


def normal_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trigrams(text: Column) -> Column:
    """Distinct word triples over [a-z0-9_.]+; fewer than three words are one short gram, none is no gram."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_.]+"), F.lit(0))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    ))[0]


def between_tags(text: Column, tag: str) -> Column:
    """What stands between the first pair of tags, or NULL."""
    return F.nullif(F.regexp_extract(text, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))


def mids(text: Column) -> Column:
    """The machine ids (m.… and g.…) named in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([mg]\.[0-9a-z_]+)"), F.lit(1)))


def stable_hash(*columns: Column) -> Column:
    """SHA-256 of a compact JSON array of the columns."""
    return F.sha2(F.to_json(F.array(*(c.cast("string") for c in columns))), 256)


def seed_of(*columns: Column) -> Column:
    """A non-negative integer seed from a hash prefix."""
    return F.conv(F.substring(stable_hash(*columns), 1, 8), 16, 10).cast("long")
