"""Deterministic sampling: ranks by a hash of seed and id, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def priority(seed: int | str, *columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns)), 256)


def top_per_stratum(df: DataFrame, stratum: str, key: str, quota: int | Column, seed: int | str) -> DataFrame:
    """The first ``quota`` rows of each stratum by hash priority; the rank is limited before rows are shuffled in full."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(priority(seed, F.col(key)), key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= quota).drop("_rank")


def largest_remainder(sizes: dict[str, int], total: int) -> dict[str, int]:
    """``total`` places over strata in proportion to size, none above its size, every stratum at least one where there are
    enough places; remainders decide, then size, then name."""
    total = min(total, sum(sizes.values()))
    out = dict.fromkeys(sizes, 0)
    if total >= len([s for s in sizes.values() if s]):
        out = {k: min(1, n) for k, n in sizes.items()}
    while (left := total - sum(out.values())) > 0:
        room = {k: n - out[k] for k, n in sizes.items() if n > out[k]}
        share = {k: left * n / sum(room.values()) for k, n in room.items()}
        given = 0
        for k, s in share.items():
            add = min(int(s), room[k])
            out[k] += add
            given += add
        if given < left:
            for k in sorted(room, key=lambda k: (-(share[k] - int(share[k])), -room[k], k)):
                if given < left and out[k] < sizes[k]:
                    out[k] += 1
                    given += 1
        if not given:
            break
    return out


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: int | str) -> DataFrame:
    """A sample of ``total`` rows that covers all strata; the strata's sizes, few by nature, are counted first."""
    sizes = {r[0]: r[1] for r in df.filter(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    quota = largest_remainder(sizes, total)
    places = df.sparkSession.createDataFrame(list(quota.items()), f"{stratum} string, _quota int")
    return top_per_stratum(df.join(F.broadcast(places), stratum), stratum, key, F.col("_quota"), seed).drop("_quota")


def split(df: DataFrame, key: str, validation: int, seed: int | str) -> DataFrame:
    """Adds ``split``: the first ``validation`` of a thousand parts of the hash range are validation; a row's split depends
    on its key alone, so that it never moves."""
    part = F.conv(F.substring(priority(seed, F.col(key)), 1, 8), 16, 10).cast("long") % 1000
    return df.withColumn("split", F.when(part < validation, "validation").otherwise("train"))


def oversample(df: DataFrame, key: str, total: int, size: int, seed: int | str) -> DataFrame:
    """``total`` rows from ``size``: all rows as often as fits, the rest by hash priority; ``copy`` numbers them."""
    whole, rest = divmod(total, size)
    full = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))) if whole else df.limit(0).withColumn("copy", F.lit(0))
    return full.unionByName(df.orderBy(priority(seed, F.col(key)), key).limit(rest).withColumn("copy", F.lit(whole + 1)))
