"""Answer metrics, evaluation summaries, training roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def set_scores(predicted: Column, gold: Column) -> Column:
    """precision, recall, f1, em of two arrays read as sets; two empty sets agree."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both, n, m = F.size(F.array_intersect(p, g)), F.size(p), F.size(g)
    precision = F.when((n == 0) & (m == 0), 1.0).when(n == 0, 0.0).otherwise(both / n)
    recall = F.when((n == 0) & (m == 0), 1.0).when(m == 0, 0.0).otherwise(both / m)
    f1 = F.when((n == 0) & (m == 0), 1.0).when(n + m == 0, 0.0).otherwise(2 * both / (n + m))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ((both == n) & (both == m)).cast("double").alias("em"))


def alias_scores(predicted: Column, groups: Column) -> Column:
    """The same for gold answers that are groups of aliases: a group is found if any alias is predicted."""
    p = F.array_distinct(predicted)
    hit = F.size(F.filter(groups, lambda g: F.arrays_overlap(g, p)))
    right = F.size(F.filter(p, lambda x: F.exists(groups, lambda g: F.array_contains(g, x))))
    n, m = F.size(p), F.size(groups)
    precision = F.when((n == 0) & (m == 0), 1.0).when(n == 0, 0.0).otherwise(right / n)
    recall = F.when((n == 0) & (m == 0), 1.0).when(m == 0, 0.0).otherwise(hit / m)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ((right == n) & (hit == m)).cast("double").alias("em"))


def summary(df: DataFrame, group: str, flags: list[str], values: list[str]) -> DataFrame:
    """Per group and over all (group NULL): n, rates of flags, means of values, in one pass."""
    return df.rollup(group).agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags), *(F.avg(v).alias(f"{v}_mean") for v in values))


def by_tag(df: DataFrame, tags: str, value: str) -> DataFrame:
    """tag, n, mean: a row counts for each of its tags, for ``untagged`` where it has none."""
    own = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) == 0, F.array(F.lit("untagged"))).otherwise(F.col(tags))
    return df.select(F.explode(F.array_distinct(own)).alias("tag"), value).groupBy("tag").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def weighted_means(partial: DataFrame, by: list[str], mean: str, n: str) -> DataFrame:
    """Means of partial means: sum(mean * n) / sum(n), 0 where nothing was counted."""
    return partial.groupBy(*by).agg(F.sum(n).alias(n), F.coalesce(F.try_divide(F.sum(F.col(mean) * F.col(n)), F.sum(n)), F.lit(0.0)).alias(mean))


def sparse_means(components: DataFrame, samples: DataFrame, group: str, dense: list[str]) -> DataFrame:
    """group, name, mean: of ``components`` (group, name, value) over all samples of the group (group, n) for names in
    ``dense``, over the samples that report it for others."""
    sums = components.groupBy(group, "name").agg(F.sum("value").alias("s"), F.count("*").alias("k"))
    return sums.join(samples, group).select(group, "name", (F.col("s") / F.when(F.col("name").isin(dense), F.col("n")).otherwise(F.col("k"))).alias("mean"))


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Half the sum of absolute differences of two distributions given as counts (key, n)."""
    share = lambda df, name: df.join(F.broadcast(df.agg(F.sum("n").alias("_t")))).select(key, (F.col("n") / F.col("_t")).alias(name))
    return share(a, "p").join(share(b, "q"), key, "full").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def marginals(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n over several dimensions in one pass; array dimensions count each element."""
    kinds = dict(df.dtypes)

    def values_of(d: str) -> Column:
        own = F.col(d) if kinds[d].startswith("array") else F.array(F.col(d))
        return F.transform(own, lambda v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")))

    arrays = [values_of(d) for d in dimensions]
    return df.select(F.explode(F.concat(*arrays)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def statistics(df: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, step).alias("last"))


def standardized(value: str, group: str) -> Column:
    """z-score within the group; 0 where the group does not vary."""
    w = W.partitionBy(group)
    return F.when(F.var_pop(value).over(w) <= 1e-12, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w))


def stitched(df: DataFrame, phase: str, step: str, partition: str | None = None) -> DataFrame:
    """Adds ``global_step``: steps of later phases go on where earlier ones ended."""
    keys = [partition] if partition else []
    ends = df.groupBy(*keys, phase).agg(F.max(step).alias("_end"))
    w = W.partitionBy(*keys).orderBy(phase).rowsBetween(W.unboundedPreceding, -1)
    before = ends.withColumn("_offset", F.coalesce(F.sum("_end").over(w), F.lit(0))).drop("_end")
    return df.join(before, [*keys, phase]).withColumn("global_step", F.col("_offset") + F.col(step)).drop("_offset")


def compared(runs: DataFrame, baseline: str, metric: str) -> DataFrame:
    """run, metric, delta against the baseline run."""
    base = runs.filter(F.col("run") == baseline).agg(F.first(metric).alias("_base"))
    return runs.join(F.broadcast(base)).select("run", metric, (F.col(metric) - F.col("_base")).alias("delta"))
