"""BM25 over passages: postings by token, statistics and scores as joins and aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


#: Letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"


#: The same of plain English.
PLAIN = r"[a-z0-9]+"


def tokens(text: Column, token: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0))


def terms_of(query: str, token: str = TOKEN) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+" if token == TOKEN else token, query.lower())))


def postings(passages: DataFrame) -> DataFrame:
    """page_id, paragraph_id, token, tf, dl: how often each token stands in title and text, and how long both are.  Written
    once per corpus, this is the index."""
    all_tokens = F.concat(tokens(F.coalesce("title", F.lit(""))), tokens(F.coalesce("text", F.lit(""))))
    rows = passages.select("page_id", "paragraph_id", all_tokens.alias("t")).select("page_id", "paragraph_id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return rows.groupBy("page_id", "paragraph_id", "token", "dl").agg(F.count("*").alias("tf"))


def scores(passages: DataFrame, query: str, token: str = TOKEN) -> DataFrame:
    """page_id, paragraph_id, score (greater is better) of the passages with any token of the query.

    Only the passages' lengths and the query's own tokens are aggregated; tokens of the query reach the driver's plan as
    constants.
    """
    terms = terms_of(query, token)
    all_tokens = F.concat(tokens(F.coalesce("title", F.lit("")), token), tokens(F.coalesce("text", F.lit("")), token))
    rows = passages.select("page_id", "paragraph_id", all_tokens.alias("t")).withColumn("dl", F.size("t"))
    counts = [(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    rows = rows.select("page_id", "paragraph_id", "dl", *counts)
    names = [f"tf{i}" for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(c) > 0).alias(f"df{i}") for i, c in enumerate(names)))
    score = F.lit(0.0)
    for i, c in enumerate(names):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = F.lit(False)
    for c in names:
        hit = hit | (F.col(c) > 0)
    return rows.filter(hit).join(F.broadcast(stats)).select("page_id", "paragraph_id", score.alias("score"))


def index_scores(index: DataFrame, query: str) -> DataFrame:
    """As ``scores``, from written ``postings``: only the postings of the query's tokens are read beside the lengths."""
    terms = terms_of(query)
    stats = index.select("page_id", "paragraph_id", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = index.filter(F.col("token").isin(terms))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as the query has tokens
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = hits.join(F.broadcast(df), "token").join(F.broadcast(stats))
    return rows.groupBy("page_id", "paragraph_id").agg(F.sum(part).alias("score"))


def resolve(entities: DataFrame, passages: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """entity_id, label of entities by label or alias, or, where there are none, of the pages of the best passages, in order."""
    low = text.strip().lower()
    hit = (F.lower("label") == low) | F.exists("aliases", lambda a: F.lower(a) == low)
    exact = entities.filter(hit).select("entity_id", "label").orderBy("entity_id").limit(limit)
    if not exact.isEmpty() or not terms_of(text):
        return exact
    best = scores(passages, text).orderBy(F.desc("score"), "page_id", "paragraph_id").limit(min(limit, 100))
    pages = best.groupBy("page_id").agg(F.max("score").alias("score")).select(F.col("page_id").alias("entity_id"), "score")
    return entities.select("entity_id", "label").join(F.broadcast(pages), "entity_id", "right").orderBy(F.desc("score"), "entity_id").select("entity_id", F.coalesce("label", "entity_id").alias("label"))


def search(passages: DataFrame, query: str, limit: int = 10, max_chars: int = 4000, token: str = TOKEN) -> DataFrame:
    """page_id, paragraph_id, title, text (its first ``max_chars``), score: the best passages; ties by page and paragraph.  A
    query without tokens finds nothing."""
    if not query.strip() or not 1 <= limit <= 100 or not 1 <= max_chars <= 20_000:
        raise ValueError("LIMIT_EXCEEDED")
    top = scores(passages, query, token).orderBy(F.desc("score"), "page_id", "paragraph_id").limit(limit)
    out = passages.join(F.broadcast(top), ["page_id", "paragraph_id"])
    return out.select("page_id", "paragraph_id", "title", F.substring("text", 1, max_chars).alias("text"), "score").orderBy(F.desc("score"), "page_id", "paragraph_id")
