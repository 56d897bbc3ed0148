"""A mixture of sources at target weights.

The mixture is a sequence of slots.  A slot's source is given by a golden-ratio point put through the cumulative weights, so
that every stretch of the sequence is close to the target; the points form a lattice whose order is a permutation, so that
each slot's rank within its source follows from its number alone, without a window over the source.  Shuffled rows of each
source, repeated where it is small, take the slots by rank.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.sample import random_key

#: Rows that one task ranks at once, on average.
BUCKET = 50_000


def apportioned(total: int, weights: dict[str, Fraction]) -> dict[str, int]:
    """``total`` slots in ratio of the weights: whole shares first, the rest to the largest remainders (then by name)."""
    whole = sum(weights.values())
    exact = {s: w * total / whole for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def quotas(sizes: dict[str, int], weights: dict[str, Fraction], repeats: int) -> dict[str, int]:
    """Slots per source: the largest mixture, in ratio of the weights to within one slot, that uses no row more than
    ``repeats`` times and is not larger than all distinct rows together.

    A weighted source without rows cannot have its share of anything: the others then get what they can give of one group, the
    least whole numbers in ratio of the weights.
    """
    active = {s: w for s, w in weights.items() if w > 0}
    if not active:
        return {}
    if not all(sizes.get(s, 0) for s in active):
        scale = math.lcm(*(w.denominator for w in active.values()))
        group = {s: int(w * scale) for s, w in active.items()}
        least = math.gcd(*group.values())
        return {s: min(n // least, sizes.get(s, 0) * repeats) for s, n in group.items()}
    share = {s: w / sum(active.values()) for s, w in active.items()}
    total = min([sum(sizes[s] for s in active), *(int((sizes[s] * repeats + 1) / w) for s, w in share.items())])
    while any(n > sizes[s] * repeats for s, n in apportioned(total, share).items()):
        total -= 1  # a few times at most: a quota is less than one slot above its exact share
    return apportioned(total, share)


def ranked(rows: DataFrame, source: str, row: str, seed: int, counts: dict[str, int]) -> DataFrame:
    """Distinct rows with ``rank``, a random order from 0 within each source.  The order is cut into ranges of the random
    key; ranges are counted, and each is sorted by itself."""
    from pyspark.sql import Window as W

    ranges = max(1, max(counts.values(), default=1) // BUCKET)
    keyed = rows.withColumn("_key", random_key(seed, F.col(source), F.col(row))).withColumn("_range", F.floor(F.col("_key") * ranges).cast("int"))
    sizes = keyed.groupBy(source, "_range").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.partitionBy(source).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy(source, "_range").orderBy("_key", row)) - 1
    out = keyed.withColumn("_within", within).join(before.select(source, "_range", "_before"), [source, "_range"])
    return out.withColumn("rank", F.col("_before") + F.col("_within")).drop("_key", "_range", "_within", "_before")


def mix(rows: DataFrame, source: str, row: str, weights: dict[str, Fraction], repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The mixture (``slot``, ``source``, row id, ``copy``) and the report (``source``, ``rows``, ``slots``, ``target``,
    ``share``, ``most_copies``).

    ``source`` is read trimmed and in lower case; rows of no weighted source, or with a NULL row id, are left out; a row
    delivered several times is one row (of its least source).  A source without rows stops the mixture at what one group of the
    others allows (see ``quotas``), which the report shows.  The shares are shares of rows, so blocks of equal size are single rows.
    """
    spark = rows.sparkSession
    name = F.lower(F.trim(F.col(source)))
    own = rows.select(name.alias("source"), F.col(row).alias("row_id")).filter(F.col("source").isin(*weights) & F.col("row_id").isNotNull()).groupBy("row_id").agg(F.min("source").alias("source"))
    counts = {r.source: r["count"] for r in own.groupBy("source").count().collect()}
    slots = quotas(counts, weights, repeats)
    total = sum(slots.values())
    step = next((m for m in range(max(1, round(total * (math.sqrt(5) - 1) / 2)), total + 2) if math.gcd(m, total) == 1), 1)
    point = F.expr(f"(id * {step}L) % {max(1, total)}L") if total * step < 2**62 else (F.col("id").cast("decimal(38,0)") * step % total).cast("long")
    schedule = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"))
    begin, which, first, size = 0, F.lit(None).cast("string"), F.lit(0), F.lit(1)
    for s in sorted(slots):
        here = (F.col("point") >= begin) & (F.col("point") < begin + slots[s])
        which, first, size = F.when(here, s).otherwise(which), F.when(here, begin).otherwise(first), F.when(here, counts.get(s, 0)).otherwise(size)
        begin += slots[s]
    schedule = schedule.select("slot", which.alias("source"), (F.col("point") - first).alias("_i"), size.cast("long").alias("_n"))
    schedule = schedule.select("slot", "source", F.pmod("_i", "_n").alias("rank"), F.expr("_i div _n").alias("copy"))
    mixture = schedule.join(ranked(own, "source", "row_id", seed, counts), ["source", "rank"]).select("slot", "source", "row_id", "copy")
    wanted = sum(weights.values()) or Fraction(1)
    facts = spark.createDataFrame([(s, counts.get(s, 0), float(w / wanted)) for s, w in sorted(weights.items())], "source string, rows long, target double")
    reached = mixture.groupBy("source").agg(F.count("*").alias("slots"), (F.max("copy") + 1).alias("most_copies"))
    report = facts.join(reached, "source", "left").select(
        "source", "rows", F.coalesce("slots", F.lit(0)).alias("slots"), "target", F.coalesce(F.col("slots") / F.lit(max(1, total)), F.lit(0.0)).alias("share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
    return mixture, report
