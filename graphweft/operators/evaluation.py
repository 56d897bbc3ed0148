"""Evaluation and training logs: summaries per split, role and task, checks between runs, selection and curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.functions.text import normal_words, stable_hash
from graphweft.operators.metrics import set_scores
from graphweft.operators.sampling import priority

# What a benchmark summary averages, and under which name.
BENCHMARK_MEANS = {
    "entity_f1": "mean_f1",
    "exact_match": "pass_rate",
    "mean_tool_calls": "mean_tool_calls",
    "mean_edge_visits": "mean_edge_visits",
    "mean_latency_ms": "mean_latency_ms",
    "program_parse_rate": "program_parse_rate",
    "program_execution_rate": "program_execution_rate",
    "mean_program_operators": "mean_program_operators",
    "mean_passage_searches": "mean_passage_searches",
}
# What a roll-up of a task's rollouts averages, and under which name.
ROLLOUT_MEANS = {
    "pass_rate": "passed",
    "mean_f1": "f1",
    "mean_tool_calls": "tool_calls",
    "mean_invalid_tool_calls": "invalid_tool_calls",
    "mean_edge_visits": "edge_visits",
    "program_parse_rate": "program_parse",
    "program_execution_rate": "program_executable",
    "mean_program_operators": "program_operators",
    "mean_passage_searches": "passage_searches",
}
STAGES = range(7)


def _value(df: DataFrame, name: str) -> Column:
    """A column as DOUBLE, 0 where it is NULL or the rows lack it."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Per split, and over all (split NULL): count and nine means; one pass.  Columns the results lack count as 0; no
    results give no rows."""
    means = [F.coalesce(F.avg(_value(results, c)), F.lit(0.0)).alias(name) for name, c in BENCHMARK_MEANS.items()]
    return results.rollup("split").agg(F.grouping("split").alias("_all"), F.count("*").alias("count"), *means).filter("_all = 1 or split is not null").drop("_all")


def prediction_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Means of scores, and rates on condition: success among rows that tried a tool, exact match among fallbacks."""
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    tried, fallback = true("tool_attempted"), true("fallback_used")
    means = {c: c for c in ("exact_match", "precision", "recall", "f1")} | {"mean_latency_ms": "latency_ms", "mean_completion_tokens": "completion_tokens"}
    return rows.groupBy(*by).agg(
        F.count("*").alias("count"),
        *(F.avg(_value(rows, c)).alias(name) for name, c in means.items()),
        _rate(F.count_if(tried & true("tool_succeeded")), F.count_if(tried)).alias("tool_success_rate"),
        _rate(F.count_if(fallback), F.count("*")).alias("fallback_rate"),
        _rate(F.sum(F.when(fallback, _value(rows, "exact_match"))), F.count_if(fallback)).alias("fallback_exact_match"),
        _rate(F.count_if(F.col("rejection_reason").isNotNull()), F.count("*")).alias("primary_failure_rate"),
        _rate(F.count_if(F.coalesce(F.size("predicted_answers"), F.lit(0)) <= 0), F.count("*")).alias("terminal_failure_rate"),
    )


def rollout_summary(rollouts: DataFrame, by: str = "task_id") -> DataFrame:
    """Per task: means over its rollouts, and rates on condition, 0 where the condition never holds: executable given parsed, F1
    given executable."""
    parsed, ran = _value(rollouts, "program_parse"), _value(rollouts, "program_executable")
    return rollouts.groupBy(by).agg(
        F.count("*").alias("samples"),
        *(F.avg(_value(rollouts, c)).alias(name) for name, c in ROLLOUT_MEANS.items()),
        _rate(F.sum(ran), F.sum(parsed)).alias("execution_rate_given_parse"),
        _rate(F.sum(_value(rollouts, "f1") * ran), F.sum(ran)).alias("semantic_success_given_execution"),
    )


def capability_summary(probes: DataFrame) -> DataFrame:
    """Per role (questioner, solver): candidates, mean scores, the role's own means, how many reached each stage (an array of
    seven), and how often each reason was given.  Rows: role, score, raw_score, certified, f1, exact_match, reward_stage,
    reason_codes.  A role without rows has no row."""
    asks = F.col("role") == "questioner"
    stage = F.when(asks, F.floor(F.coalesce(F.col("reward_stage").cast("double"), F.lit(-1.0))))
    rows = probes.filter(F.col("role").isin("questioner", "solver"))
    means = rows.groupBy("role").agg(
        F.count("*").alias("candidates"), F.avg(_value(rows, "score")).alias("mean_score"), F.avg(_value(rows, "raw_score")).alias("mean_raw_score"),
        F.avg(F.when(asks, _value(rows, "certified"))).alias("certified_rate"), F.avg(F.when(~asks, _value(rows, "f1"))).alias("f1"), F.avg(F.when(~asks, _value(rows, "exact_match"))).alias("exact_match"),
        F.when(F.first(asks), F.array(*(F.count_if(stage == s) for s in STAGES))).alias("stage_counts"),
    )
    reasons = rows.select("role", F.explode("reason_codes").alias("reason")).groupBy("role", "reason").agg(F.count("*").alias("n"))
    reasons = reasons.groupBy("role").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejection_reasons"))
    return means.join(reasons, "role", "left")


def reward_means(components: DataFrame) -> DataFrame:
    """Means of reward components (role, name, value) by role and over all (role NULL), each with how many reported it."""
    rows = components.filter("value is not null")
    out = rows.cube("role", "name").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.filter(F.col("_g").isin(0, 2)).select("role", "name", "n", "mean")


def bottleneck(left: Column, right: Column) -> Column:
    """The least of two means; NULL unless both are known."""
    return F.when(left.isNotNull() & right.isNotNull(), F.least(left, right))


def compare_runs(runs: DataFrame, baseline: str, metrics: Sequence[str], invariants: Sequence[str]) -> DataFrame:
    """run, then per metric its delta against the baseline run.  Runs that differ in an invariant (dataset, number of tasks and
    the like) cannot be compared and are refused, as are runs without the baseline and runs named twice."""
    checks = runs.agg(F.count("*").alias("n"), F.count_distinct("run").alias("names"), F.count_if(F.col("run") == baseline).alias("base"), *(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"_{c}") for c in invariants)).first()
    if checks["base"] != 1 or checks["names"] != checks["n"]:
        raise ValueError("the baseline must be there, and each run once")
    if odd := [c for c in invariants if checks[f"_{c}"] > 1]:
        raise ValueError(f"runs differ in {', '.join(odd)}")
    base = runs.filter(F.col("run") == baseline).select(*(F.col(m).alias(f"_{m}") for m in metrics))
    return runs.join(F.broadcast(base)).select("run", *metrics, *((F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics))


def inferred_steps(rows: DataFrame, order: str, step: str, partition: str | None = None) -> DataFrame:
    """Adds ``step_filled``: the step given (``7`` or ``7/100``), else one more than the greatest seen so far, whether given or
    inferred."""
    given = F.split_part(F.col(step).cast("string"), F.lit("/"), F.lit(1)).try_cast("double")
    w = W.partitionBy(*([partition] if partition else [F.lit(0)])).orderBy(order)
    rows = rows.withColumn("_given", given).withColumn("_missing", F.count_if(F.col("_given").isNull()).over(w))
    # A given step lifts the counter to itself; every missing one before it would have been counted already.
    lift = F.coalesce(F.max(F.floor("_given") - F.col("_missing")).over(w), F.lit(0))
    return rows.withColumn("step_filled", F.coalesce("_given", (F.greatest(lift, F.lit(0)) + F.col("_missing")).cast("double"))).drop("_given", "_missing")


def valid_prefix(flags: Column) -> Column:
    """How many flags are true before the first that is not."""
    bad = F.array_position(F.transform(flags, lambda f: F.coalesce(f, F.lit(False))), F.lit(False))
    return F.when(bad == 0, F.size(flags)).otherwise(bad - 1)


def labelled_scores(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """task_id and scores of answers compared as a reader sees them: predicted and gold ids as labels (the id where unknown),
    as normal words.  ``answers``: task_id, predicted, gold (arrays); ``labels``: entity_id, label."""
    rows = answers.select("task_id", F.explode_outer(F.concat(F.transform("predicted", lambda v: F.struct(F.lit("p").alias("side"), v.alias("entity_id"))), F.transform("gold", lambda v: F.struct(F.lit("g").alias("side"), v.alias("entity_id"))))).alias("a"))
    rows = rows.select("task_id", "a.side", "a.entity_id").join(labels.select("entity_id", "label").dropDuplicates(["entity_id"]), "entity_id", "left")
    said = normal_words(F.coalesce("label", "entity_id"))
    sets = rows.groupBy("task_id").agg(F.collect_set(F.when(F.col("side") == "p", said)).alias("p"), F.collect_set(F.when(F.col("side") == "g", said)).alias("g"))
    return sets.select("task_id", set_scores(F.col("p"), F.col("g")).alias("s")).select("task_id", "s.*")


# selection


def sampled(df: DataFrame, key: str, count: int, seed: int | str) -> DataFrame:
    """``count`` rows by hash priority; where there are fewer, draws with replacement (``draw`` numbers them).  Empty stays
    empty.  Only the number of rows reaches the driver."""
    n = df.count()
    if n == 0 or count <= 0:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    if count <= n:
        return df.orderBy(priority(seed, F.col(key)), key).limit(count).withColumn("draw", F.lit(0).cast("long"))
    ranked = df.withColumn("_rank", F.row_number().over(W.orderBy(priority(seed, F.col(key)), key)) - 1)  # fewer rows than are asked for
    picks = df.sparkSession.range(count).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(str(seed)), "id"), F.lit(n)).cast("int").alias("_rank"))
    return picks.join(ranked, "_rank").drop("_rank").select(*df.columns, "draw")


def interesting_first(df: DataFrame, interesting: Column, key: str, count: int, seed: int) -> DataFrame:
    """The first ``count`` rows: interesting ones before others, each in order of a hash."""
    return df.orderBy(F.when(interesting, 0).otherwise(1), stable_hash(F.lit(seed), F.col(key)), key).limit(count)


def preferred_first(df: DataFrame, preferred: DataFrame, key: str, count: int) -> DataFrame:
    """A bounded preview: rows among ``preferred`` first, then the others, in order of the key."""
    wanted = preferred.select(key).distinct().withColumn("_first", F.lit(0))
    return df.join(wanted, key, "left").orderBy(F.coalesce("_first", F.lit(1)), key).limit(count).select(*df.columns)


def visible(df: DataFrame, difficulty: Sequence[str], fraction: float) -> DataFrame:
    """The easier ``fraction`` of the rows (at least one), with ``half``: replay for the easier half of them, frontier for the
    rest (all, if there is only one).  Ranks are taken range by range, so that no task sorts all rows."""
    ordered = ranked(df, difficulty)
    n = ordered.count()
    shown = max(1, math.ceil(n * fraction)) if n else 0
    split = max(1, shown // 2)
    half = F.when(F.col("rank") < split, "replay").otherwise("frontier") if shown > 1 else F.lit("frontier")
    return ordered.filter(F.col("rank") < shown).withColumn("half", half)


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``rank`` from 0 in the order given: rows are sorted by range, ranges counted, and counts added up."""
    from graphweft.session import cut

    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    starts = sizes.select("_part", "_low", before.alias("_before"))
    return ordered.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_before")


def round_mixture(base: DataFrame, archived: DataFrame, new: DataFrame, key: str, episodes: int, base_ratio: float, archive_ratio: float, seed: int) -> DataFrame:
    """The tasks of a round: base, archived and new tasks by ratio, with ``origin``.  What an empty archive, or no new tasks,
    leave over goes to the base.  Shares are rounded half to even; too small a source is drawn from with replacement."""
    counts = {"base": round(episodes * base_ratio), "archive": round(episodes * archive_ratio)}
    counts["new"] = max(0, episodes - sum(counts.values()))
    if new.isEmpty():
        counts["base"], counts["new"] = counts["base"] + counts["new"], 0
    if archived.isEmpty():
        counts["base"], counts["archive"] = counts["base"] + counts["archive"], 0
    parts = [sampled(df, key, counts[o], f"{seed}|{o}").withColumn("origin", F.lit(o)) for o, df in (("base", base), ("archive", archived), ("new", new))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split_both(df: DataFrame, key: str, share: float, seed: int | str) -> DataFrame:
    """Adds ``split`` by hash rank: the first ``share`` of the rows are validation, at least one row on either side where there
    are two."""
    ordered = ranked(df.withColumn("_key", priority(seed, F.col(key))), ["_key", key])
    n = ordered.count()
    held = min(max(1, int(n * share)), max(0, n - 1))
    return ordered.withColumn("split", F.when(F.col("rank") < held, "val").otherwise("train")).drop("_key", "rank")


def validation_subset(df: DataFrame, key: str, most: int, seed: int | str) -> DataFrame:
    """At most ``most`` rows by hash priority, with ``index``, their place in order of the key among all rows."""
    ordered = ranked(df, [key]).withColumnRenamed("rank", "index")
    return ordered.orderBy(priority(seed, F.col(key)), key).limit(most).orderBy("index")


def schedule(rounds: int, production: int, grounding: int, start: float, end: float, fraction_start: float) -> list[dict[str, object]]:
    """Per round its phase, frontier target and visible fraction, which move in a line from the first round to the last."""
    out: list[dict[str, object]] = []
    for r in range(1, rounds + 1):
        progress = 1.0 if rounds == 1 else (r - 1) / (rounds - 1)
        phase = "production" if r <= production else "grounding" if r <= production + grounding else "frontier"
        out.append({"round": r, "phase": phase, "target": start + progress * (end - start), "visible_fraction": fraction_start + progress * (1 - fraction_start)})
    return out


def by_length(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Adds ``reason``: TOO_LONG for rows above ``most`` tokens, ENCODING_ERROR where no length is known, NULL for accepted rows.
    ``length`` comes from any tokenizer."""
    return df.withColumn("length", length).withColumn("reason", F.when(F.col("length").isNull(), "SFT_ENCODING_ERROR").when(F.col("length") > most, "SFT_MAX_LENGTH_EXCEEDED"))


def tasks_at(df: DataFrame, split: str, snapshot: str, key: str, indices: Sequence[int]) -> DataFrame:
    """The tasks of a split at the given places in order of the key; rows of another snapshot are refused."""
    rows = df.filter(F.col("split") == split)
    if not rows.filter(~F.col("snapshot").eqNullSafe(snapshot)).isEmpty():
        raise ValueError("SNAPSHOT_MISMATCH")
    return ranked(rows, [key]).filter(F.col("rank").isin(list(indices))).withColumnRenamed("rank", "index")


def audit(records: DataFrame, required: Sequence[str], key: str, split: str) -> DataFrame:
    """check, value, n: rows without a required field, ids given twice, and rows per split."""
    lacking = records.select(F.explode(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required))).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    twice = records.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n")).filter("n > 1")
    splits = records.groupBy(F.col(split).alias("value")).agg(F.count("*").alias("n"))
    parts = [df.select(F.lit(name).alias("check"), "value", "n") for name, df in (("missing", lacking), ("duplicate", twice), ("split", splits))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def matches_source(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """task_id, matched: whether an answer (value, label) is a source answer of the task, by value or by label."""
    met = answers.join(sources.select("task_id", F.col("answer").alias("_a")).distinct(), "task_id", "left")
    hit = (F.col("value") == F.col("_a")) | (F.col("label") == F.col("_a"))
    return met.groupBy("task_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("matched"))


def interaction_reason() -> Column:
    """Why a task cannot be played step by step, the first of the ladder, or NULL: topics, answers, their kind, a shortcut, then
    what replay gave (columns topics, answers, answer_kind, shortcut_found, replay: seed, gold, bounded)."""
    return (
        F.when(F.col("topics") != 1, "MULTIPLE_TOPICS").when(F.col("answers") != 1, "NON_UNIQUE_RESULT").when(F.col("answer_kind") != "entity", "NON_ENTITY_ANSWER").when(F.col("shortcut_found"), "SHORTCUT_FOUND")
        .when(F.col("replay") == "seed", "SEED_MISMATCH").when(F.col("replay") == "gold", "GOLD_MISMATCH").when(F.col("replay") == "bounded", "BOUNDED_UNBOUNDED_MISMATCH")
    )


def prevalence(source: DataFrame, selected: DataFrame) -> DataFrame:
    """dimension, value, source, source_prevalence, selected, selected_prevalence of marginals (dimension, value, n); shares are
    of the rows each side has, given as dimension ``rows``."""
    side = lambda df, name: df.filter("dimension <> 'rows'").join(F.broadcast(df.filter("dimension = 'rows'").select(F.col("n").alias("_t")))).select("dimension", "value", F.col("n").alias(name), (F.col("n") / F.col("_t")).alias(f"{name}_prevalence"))
    return side(source, "source").join(side(selected, "selected"), ["dimension", "value"], "full").fillna(0)
