"""A uniform sample of fixed size from data of unknown length that arrives in pieces.

Every row has a random key, a hash of seed and row.  Once the rows are counted, two concentration bounds accept or reject
almost all keys at once; only the narrow range between them, the waitlist, is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.session import cut

#: Probability that the bounds fail for a source and wider ones are tried.
FAILURE = 1e-4


def random_key(seed: int, *columns: Column) -> Column:
    """Uniform in [0, 1), the same for the same row wherever and however often it arrives."""
    return F.conv(F.substring(F.sha2(F.concat_ws("", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256), 1, 13), 16, 10).cast("double") / float(16**13)


def bounds(n: int, k: int, failure: float) -> tuple[float, float]:
    """Keys below the first are accepted, keys from the second on rejected; both hold but with probability ``failure``."""
    if n <= k:
        return 1.0, 1.0
    p, wide = k / n, -math.log(failure) / n
    below = max(0.0, p + 2 * wide / 3 - math.sqrt(4 * wide * wide / 9 + 2 * wide * p))
    return below, min(1.0, p + wide + math.sqrt(wide * wide + 2 * wide * p))


def draw(rows: DataFrame, source: str, row: str, k: int, seed: int) -> DataFrame:
    """``k`` distinct rows per source (all, if it has fewer), every distinct row equally likely.

    Rows with a NULL source or row id are no candidates; a row that arrives several times is one candidate, and one copy of it
    (the least by the remaining columns) comes out.  The same seed gives the same sample, however the rows are cut into pieces.
    The number of sources is that of a configuration: their counts are collected.
    """
    rest = [c for c in rows.columns if c not in (source, row)]
    rows = rows.filter(F.col(source).isNotNull() & F.col(row).isNotNull()).select(source, row, F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    counts = {r[0]: r[1] for r in rows.select(source, row).distinct().groupBy(source).count().collect()}
    keyed = rows.withColumn("_key", random_key(seed, F.col(source), F.col(row)))
    done, failure = None, FAILURE
    wanted = dict(counts)
    while wanted:
        limits = {s: bounds(n, k, failure) for s, n in wanted.items()}
        keep = F.lit(False)
        accept = F.lit(False)
        for s, (low, high) in limits.items():
            keep = keep | ((F.col(source) == s) & (F.col("_key") < high))
            accept = accept | ((F.col(source) == s) & (F.col("_key") < low))
        near = keyed.filter(keep).groupBy(source, row).agg(F.min("_key").alias("_key"), F.min("_rest").alias("_rest"))
        near = cut(near.withColumn("_sure", accept))
        sizes = {r[0]: (r[1], r[2]) for r in near.groupBy(source).agg(F.count_if("_sure"), F.count("*")).collect()}
        failed = {s: n for s, n in wanted.items() if sizes.get(s, (0, 0))[0] > k or sizes.get(s, (0, 0))[1] < min(k, n)}
        fine = [s for s in wanted if s not in failed]
        for s in fine:
            sure = near.filter((F.col(source) == s) & F.col("_sure"))
            waiting = near.filter((F.col(source) == s) & ~F.col("_sure")).orderBy("_key", row).limit(max(0, k - sizes[s][0]))
            part = sure.unionByName(waiting)
            done = part if done is None else done.unionByName(part)
        wanted, failure = failed, failure * failure
        if failure < 1e-300:
            raise RuntimeError("keys are not random")
    if done is None:
        done = keyed.limit(0)
    return done.select(source, row, *([F.col("_rest").getField(c).alias(c) for c in rest]))
