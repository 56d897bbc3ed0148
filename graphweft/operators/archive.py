"""The task archive: novelty by word triples and program structure, and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.text import trigrams


def grams(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram: the inverted index rows of texts."""
    return texts.select(key, F.explode(trigrams(F.col(text))).alias("gram"))


def similarities(new: DataFrame, old: DataFrame) -> DataFrame:
    """id, other, similarity: Jaccard of gram sets for all pairs that share a gram, by an inverted index join; a text is not
    held against itself.

    ``new`` has id, gram; ``old`` other, gram; each gram once per id.
    """
    sizes = lambda df, k: df.groupBy(k).agg(F.count("*").alias(f"_{k}"))
    shared = new.join(old, "gram").filter("id <> other").groupBy("id", "other").agg(F.count("*").alias("both"))
    out = shared.join(sizes(new, "id"), "id").join(sizes(old, "other"), "other")
    return out.select("id", "other", (F.col("both") / (F.col("_id") + F.col("_other") - F.col("both"))).alias("similarity"))


def novelty(new: DataFrame, old: DataFrame) -> DataFrame:
    """id, novelty = 1 - greatest similarity to anything archived; 1 where nothing is shared."""
    best = similarities(new, old).groupBy("id").agg(F.max("similarity").alias("s"))
    return new.select("id").distinct().join(best, "id", "left").select("id", (1 - F.coalesce("s", F.lit(0.0))).alias("novelty"))


def admit(candidates: DataFrame, archived_signatures: DataFrame, low: float = 0.25, high: float = 0.75, least_novelty: float = 0.0) -> DataFrame:
    """Candidates (task_id, signature, pass_rate, structural, textual) with ``reason``: TOO_HARD, TOO_EASY,
    DUPLICATE_SIGNATURE, LOW_NOVELTY, or NULL if accepted.  Of candidates with one signature the first by task_id stands."""
    from pyspark.sql import Window as W

    known = archived_signatures.select("signature").distinct().withColumn("_known", F.lit(True))
    rate = F.col("pass_rate")
    window = F.when(rate < low, "TOO_HARD").when(rate > high, "TOO_EASY")
    rows = candidates.join(known, "signature", "left").withColumn("_window", window)
    rank = F.row_number().over(W.partitionBy("signature", F.col("_window").isNull()).orderBy("task_id"))
    mean = (F.col("structural") + F.col("textual")) / 2
    reason = F.when(F.col("_window").isNotNull(), F.col("_window")).when(F.col("_known") | (rank > 1), "DUPLICATE_SIGNATURE").when(mean < least_novelty, "LOW_NOVELTY")
    return rows.withColumn("reason", reason).drop("_known", "_window")


def upsert(archive: DataFrame, tasks: DataFrame) -> DataFrame:
    """The archive with the tasks whose signature and id it lacks; of several with one signature, the least id."""
    fresh = tasks.groupBy("signature").agg(F.min_by(F.struct(*tasks.columns), "task_id").alias("t")).select("t.*")
    fresh = fresh.join(archive.select("signature"), "signature", "left_anti").join(archive.select("task_id"), "task_id", "left_anti")
    return archive.unionByName(fresh.select(*archive.columns))
