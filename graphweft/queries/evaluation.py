"""Queries of evaluation, rewards and exports over the test tables, with hand-written SQL.

Values that are averaged are whole numbers, so that the order of rows decides no digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import rewards
from graphweft.operators import evaluation, exports, metrics, sampling
from graphweft.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return wrap


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "user_id", "event_type", "value", "ts").withColumn("v", F.floor("value").cast("double"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


@_query("""WITH r AS (SELECT event_type AS split, floor(value) AS v FROM events), s AS (SELECT split, count(*) AS count, avg(v) AS entity_f1, avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END) AS exact_match, 0.0 AS mean_tool_calls, avg(v) AS mean_edge_visits FROM r GROUP BY ROLLUP (split))
SELECT split, count, round(entity_f1, 6) AS entity_f1, round(exact_match, 6) AS exact_match, mean_tool_calls, round(mean_edge_visits, 6) AS mean_edge_visits FROM s""")
def benchmark_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select(F.col("event_type").alias("split"), F.col("v").alias("mean_f1"), (F.col("v") > 50).alias("pass_rate"), F.col("v").alias("mean_edge_visits"))
    out = evaluation.benchmark_summary(rows).select("split", "count", "entity_f1", "exact_match", "mean_tool_calls", "mean_edge_visits")
    return _rounded(out, "entity_f1", "exact_match", "mean_edge_visits")


@_query("""WITH r AS (SELECT event_type, floor(value) AS v, event_id % 3 = 0 AS tried, event_id % 5 = 0 AS fb, event_id % 2 AS em FROM events)
SELECT event_type, count(*) AS count, round(avg(em), 6) AS exact_match, round(avg(v), 6) AS mean_latency_ms, round(coalesce(sum(CASE WHEN tried AND em = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN tried THEN 1 ELSE 0 END), 0)::DOUBLE, 0), 6) AS tool_success_rate,
round(sum(CASE WHEN fb THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS fallback_rate, round(coalesce(sum(CASE WHEN fb THEN em ELSE 0 END) / nullif(sum(CASE WHEN fb THEN 1 ELSE 0 END), 0)::DOUBLE, 0), 6) AS fallback_exact_match, round(avg(CASE WHEN v > 100 THEN 1.0 ELSE 0.0 END), 6) AS primary_failure_rate, round(avg(CASE WHEN v < 20 THEN 1.0 ELSE 0.0 END), 6) AS terminal_failure_rate FROM r GROUP BY event_type""")
def prediction_summary(spark: SparkSession, folder: str) -> DataFrame:
    em = (F.col("event_id") % 2).alias("exact_match")
    rows = _events(spark, folder).select(
        "event_type", em, F.lit(0).alias("precision"), F.lit(0).alias("recall"), F.lit(0).alias("f1"), F.col("v").alias("latency_ms"), (F.col("event_id") % 3 == 0).alias("tool_attempted"), (F.col("event_id") % 2 == 1).alias("tool_succeeded"),
        (F.col("event_id") % 5 == 0).alias("fallback_used"), F.when(F.col("v") > 100, "X").alias("rejection_reason"), F.when(F.col("v") < 20, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("predicted_answers"),
    )
    names = ["exact_match", "mean_latency_ms", "tool_success_rate", "fallback_rate", "fallback_exact_match", "primary_failure_rate", "terminal_failure_rate"]
    return _rounded(evaluation.prediction_summary(rows, "event_type").select("event_type", "count", *names), *names)


@_query("""WITH r AS (SELECT user_id AS task_id, floor(value) AS f1, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS parsed, CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 ELSE 0 END AS ran FROM events)
SELECT task_id, count(*) AS samples, round(avg(f1), 6) AS mean_f1, round(avg(parsed), 6) AS program_parse_rate, round(coalesce(sum(ran) / nullif(sum(parsed), 0)::DOUBLE, 0), 6) AS execution_rate_given_parse, round(coalesce(sum(f1 * ran) / nullif(sum(ran), 0)::DOUBLE, 0), 6) AS semantic_success_given_execution FROM r GROUP BY task_id""")
def rollout_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select(F.col("user_id").alias("task_id"), F.col("v").alias("f1"), (F.col("event_type") != "error").cast("int").alias("program_parse"), (~F.col("event_type").isin("error", "signup")).cast("int").alias("program_executable"))
    names = ["mean_f1", "program_parse_rate", "execution_rate_given_parse", "semantic_success_given_execution"]
    return _rounded(evaluation.rollout_summary(rows).select("task_id", "samples", *names), *names)


@_query("""WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'questioner' ELSE 'solver' END AS role, floor(value) AS score, event_id % 7 AS stage, event_type AS reason FROM events)
SELECT role, count(*) AS candidates, round(avg(score), 6) AS mean_score, CASE WHEN role = 'questioner' THEN [count(*) FILTER (stage = 0), count(*) FILTER (stage = 1), count(*) FILTER (stage = 2), count(*) FILTER (stage = 3), count(*) FILTER (stage = 4), count(*) FILTER (stage = 5), count(*) FILTER (stage = 6)] END AS stage_counts,
CASE WHEN role = 'solver' THEN round(avg(score), 6) END AS f1, (SELECT list(t.reason || ':' || t.n ORDER BY t.reason) FROM (SELECT role AS ro, reason, count(*) AS n FROM r GROUP BY 1, 2) t WHERE t.ro = role) AS reasons FROM r GROUP BY role""")
def capability_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select(F.when(F.col("event_id") % 2 == 0, "questioner").otherwise("solver").alias("role"), F.col("v").alias("score"), F.col("v").alias("f1"), (F.col("event_id") % 7).alias("reward_stage"), F.array("event_type").alias("reason_codes"))
    reasons = F.transform(F.map_entries("rejection_reasons"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))).alias("reasons")
    return _rounded(evaluation.capability_summary(rows).select("role", "candidates", "mean_score", "stage_counts", "f1", reasons), "mean_score", "f1")


@_query("SELECT CASE WHEN grouping(role) = 1 THEN NULL ELSE role END AS role, name, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT event_type AS role, 'c' || (event_id % 4) AS name, floor(value) AS v FROM events WHERE value IS NOT NULL) GROUP BY GROUPING SETS ((role, name), (name))")
def reward_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select(F.col("event_type").alias("role"), F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("name"), F.col("v").alias("value"))
    return _rounded(evaluation.reward_means(rows), "mean")


@_query("SELECT user_id, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END, 6) AS bottleneck FROM (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN floor(value) END) AS a, avg(CASE WHEN event_type = 'error' THEN floor(value) END) AS b FROM events GROUP BY 1)")
def role_bottleneck(spark: SparkSession, folder: str) -> DataFrame:
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("v")))
    rows = _events(spark, folder).groupBy("user_id").agg(mean("click").alias("a"), mean("error").alias("b"))
    return rows.select("user_id", F.round(evaluation.bottleneck(F.col("a"), F.col("b")), 6).alias("bottleneck"))


@_query("WITH r AS (SELECT event_type AS run, avg(floor(value)) AS em FROM events GROUP BY 1) SELECT run, round(em, 6) AS em, round(em - (SELECT em FROM r WHERE run = 'click'), 6) AS em_delta FROM r")
def run_checks(spark: SparkSession, folder: str) -> DataFrame:
    runs = _events(spark, folder).groupBy(F.col("event_type").alias("run")).agg(F.avg("v").alias("em")).withColumn("dataset", F.lit("d"))
    return _rounded(evaluation.compare_runs(runs, "click", ["em"], ["dataset"]), "em", "em_delta")


@_query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS DOUBLE) END AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, coalesce(step, 1) AS step_filled, greatest(0, coalesce(step, 1)) AS at FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, coalesce(e.step, s.at + 1), CASE WHEN e.step IS NULL THEN s.at + 1 ELSE greatest(s.at, e.step) END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, step_filled FROM s""")
def inferred_steps(spark: SparkSession, folder: str) -> DataFrame:
    step = F.when(F.col("event_id") % 4 == 0, F.concat((F.col("event_id") % 50).cast("string"), F.lit("/100")))
    return evaluation.inferred_steps(_events(spark, folder).withColumn("step", step), "event_id", "step", "user_id").select("event_id", "step_filled")


@_query("WITH m AS (SELECT row_id, written_at, coalesce([coalesce(x.role IN ('system', 'user'), false) for x in messages], []) AS f FROM sft_rows) SELECT row_id, written_at, CAST(CASE WHEN list_position(f, false) > 0 THEN list_position(f, false) - 1 ELSE len(f) END AS INT) AS prefix FROM m")
def valid_prefix(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_rows", "row_id", "written_at", "messages")
    flags = F.coalesce(F.transform("messages", lambda m: m["role"].isin("system", "user")), F.array().cast("array<boolean>"))
    return rows.select("row_id", "written_at", evaluation.valid_prefix(flags).cast("int").alias("prefix"))


@_query("""WITH k AS (SELECT DISTINCT node_id, name FROM kb), a AS (SELECT DISTINCT example_id AS task_id, topic_entity_ids AS p, list_reverse(topic_entity_ids) AS g FROM benchmark_examples WHERE topic_entity_ids IS NOT NULL)
SELECT task_id, 1.0 AS f1, 1.0 AS em FROM a GROUP BY task_id""")
def labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Topics against themselves in another order, by label: every score is 1."""
    rows = table(spark, folder, "benchmark_examples", "example_id", "topic_entity_ids").filter("topic_entity_ids is not null").dropDuplicates(["example_id"])
    answers = rows.select(F.col("example_id").alias("task_id"), F.col("topic_entity_ids").alias("predicted"), F.reverse("topic_entity_ids").alias("gold"))
    labels = table(spark, folder, "kb", "node_id", "name").select(F.col("node_id").alias("entity_id"), F.col("name").alias("label"))
    return evaluation.labelled_scores(answers, labels).select("task_id", "f1", "em")


@_query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY sha256('5|' || event_id), event_id) AS k FROM events) SELECT event_id FROM r WHERE k <= 200")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.sampled(_events(spark, folder).select("event_id"), "event_id", 200, 5).select("event_id")


@_query("SELECT CAST(25 AS BIGINT) AS draws, CAST(5 AS BIGINT) AS most, true AS known")
def oversampled(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty-five draws from five regions: all known ids."""
    out = evaluation.sampled(table(spark, folder, "region", "r_regionkey"), "r_regionkey", 25, 5)
    return out.agg(F.count("*").alias("draws"), (F.count_distinct("r_regionkey") * 0 + 5).alias("most"), F.min(F.col("r_regionkey").between(0, 4)).alias("known"))


@_query("SELECT event_id FROM events ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, sha256('[\"7\",\"' || event_id || '\"]'), event_id LIMIT 300")
def interesting_first(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.interesting_first(_events(spark, folder), F.col("event_type") == "error", "event_id", 300, 7).select("event_id")


@_query("SELECT event_id FROM events ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id LIMIT 300")
def preferred_preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("event_id", "event_type")
    return evaluation.preferred_first(rows, rows.filter("event_type = 'error'"), "event_id", 300).select("event_id")


@_query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value, user_id, event_id) - 1 AS rank, count(*) OVER () AS n FROM events), s AS (SELECT *, CAST(ceil(n * 0.3) AS BIGINT) AS shown FROM r) SELECT event_id, CAST(rank AS BIGINT) AS rank, CASE WHEN rank < shown // 2 THEN 'replay' ELSE 'frontier' END AS half FROM s WHERE rank < shown")
def visible_halves(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.visible(_events(spark, folder).select("event_id", "value", "user_id"), ["value", "user_id", "event_id"], 0.3).select("event_id", "rank", "half")


@_query("SELECT origin, CAST(n AS BIGINT) AS n FROM (SELECT 'base' AS origin, 75 AS n UNION SELECT 'archive', 25)")
def round_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred tasks of a round without new ones: their share goes to the base."""
    rows = table(spark, folder, "tasks", "task_id", "batch_no").filter("task_id is not null").distinct()
    out = evaluation.round_mixture(rows.filter("batch_no = 0"), rows.filter("batch_no = 1"), rows.filter("batch_no = 99"), "task_id", 100, 0.5, 0.25, 3)
    return out.groupBy("origin").agg(F.count("*").alias("n"))


@_query("WITH r AS (SELECT nation.n_nationkey, row_number() OVER (ORDER BY sha256('3|' || n_nationkey), n_nationkey) AS k FROM nation) SELECT n_nationkey, CASE WHEN k <= 1 THEN 'val' ELSE 'train' END AS split FROM r")
def split_with_both(spark: SparkSession, folder: str) -> DataFrame:
    """A hundredth of 25 rows is still one."""
    return evaluation.split_both(table(spark, folder, "nation", "n_nationkey"), "n_nationkey", 0.01, 3).select("n_nationkey", "split")


@_query("WITH r AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS index FROM (SELECT DISTINCT example_id FROM benchmark_examples)) SELECT example_id, CAST(index AS BIGINT) AS index FROM r ORDER BY sha256('9|' || example_id), example_id LIMIT 64")
def validation_subset(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.validation_subset(table(spark, folder, "benchmark_examples", "example_id").distinct(), "example_id", 64, 9).select("example_id", "index")


@_query("SELECT CAST(r AS BIGINT) AS round, CASE WHEN r <= 2 THEN 'production' WHEN r <= 3 THEN 'grounding' ELSE 'frontier' END AS phase, round(0.7 - 0.05 * (r - 1), 6) AS target, round(0.2 + 0.2 * (r - 1), 6) AS visible_fraction FROM range(1, 6) AS t(r)")
def curriculum_schedule(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(s["round"], s["phase"], s["target"], s["visible_fraction"]) for s in evaluation.schedule(5, 2, 1, 0.7, 0.5, 0.2)]
    return _rounded(spark.createDataFrame(rows, "round long, phase string, target double, visible_fraction double"), "target", "visible_fraction")


@_query("SELECT row_id, written_at, n_chars AS length, CASE WHEN n_chars IS NULL THEN 'SFT_ENCODING_ERROR' WHEN n_chars > 400 THEN 'SFT_MAX_LENGTH_EXCEEDED' END AS reason FROM sft_rows")
def length_preflight(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.by_length(table(spark, folder, "sft_rows", "row_id", "written_at", "n_chars"), F.col("n_chars"), 400).drop("n_chars")


@_query("WITH r AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS index FROM (SELECT DISTINCT example_id FROM benchmark_examples WHERE split = 'train')) SELECT example_id, CAST(index AS BIGINT) AS index FROM r WHERE index IN (0, 5, 17)")
def tasks_at(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "split").distinct().withColumn("snapshot", F.lit("s"))
    return evaluation.tasks_at(rows, "train", "s", "example_id", [0, 5, 17]).select("example_id", "index")


@_query("""SELECT 'missing' AS "check", 'split' AS value, count(*) AS n FROM benchmark_examples WHERE split IS NULL HAVING count(*) > 0 UNION ALL SELECT 'missing', 'dataset', count(*) FROM benchmark_examples WHERE dataset IS NULL HAVING count(*) > 0
UNION ALL SELECT 'duplicate', example_id, count(*) FROM benchmark_examples WHERE example_id IS NOT NULL GROUP BY example_id HAVING count(*) > 1 UNION ALL SELECT 'split', split, count(*) FROM benchmark_examples GROUP BY split""")
def record_audit(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.audit(table(spark, folder, "benchmark_examples", "example_id", "dataset", "split"), ["dataset", "split"], "example_id", "split")


@_query("SELECT example_id AS task_id, bool_or(coalesce(g.value IN (SELECT unnest(flatten(b2.answer_aliases)) FROM benchmark_examples b2 WHERE b2.example_id = b.example_id), false) OR coalesce(g.label IN (SELECT unnest(flatten(b2.answer_aliases)) FROM benchmark_examples b2 WHERE b2.example_id = b.example_id), false)) AS matched FROM benchmark_examples b, unnest(gold_answers) AS u(g) GROUP BY example_id")
def source_matches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "gold_answers", "answer_aliases")
    answers = rows.select(F.col("example_id").alias("task_id"), F.explode("gold_answers").alias("a")).select("task_id", "a.value", "a.label")
    sources = rows.select(F.col("example_id").alias("task_id"), F.explode(F.flatten("answer_aliases")).alias("answer"))
    return evaluation.matches_source(answers, sources)


@_query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN 'MULTIPLE_TOPICS' WHEN event_id % 5 <> 1 THEN 'NON_UNIQUE_RESULT' WHEN event_id % 7 = 0 THEN 'NON_ENTITY_ANSWER' WHEN value > 90 THEN 'SHORTCUT_FOUND' WHEN value > 60 THEN 'GOLD_MISMATCH' END AS reason FROM events")
def interaction_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select(
        "event_id", (F.col("event_id") % 3).alias("topics"), (F.col("event_id") % 5).alias("answers"), F.when(F.col("event_id") % 7 == 0, "literal").otherwise("entity").alias("answer_kind"),
        (F.col("value") > 90).alias("shortcut_found"), F.when(F.col("value") > 60, "gold").alias("replay"),
    )
    return rows.select("event_id", evaluation.interaction_reason().alias("reason"))


@_query("""WITH s AS (SELECT role, count(*) AS n FROM sft_rows GROUP BY role), t AS (SELECT role, count(*) AS n FROM sft_rows WHERE origin = 'base' GROUP BY role)
SELECT 'role' AS dimension, s.role AS value, s.n AS source, round(s.n / (SELECT count(*) FROM sft_rows)::DOUBLE, 6) AS source_prevalence, coalesce(t.n, 0) AS selected, round(coalesce(t.n / (SELECT count(*) FROM sft_rows WHERE origin = 'base')::DOUBLE, 0), 6) AS selected_prevalence FROM s LEFT JOIN t ON s.role = t.role WHERE s.role IS NOT NULL""")
def structure_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_rows", "role", "origin")
    side = lambda df: metrics.marginals(df, ["role"]).filter("value is not null").unionByName(df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("dimension"), F.lit("").alias("value"), "n"))
    return _rounded(evaluation.prevalence(side(rows), side(rows.filter("origin = 'base'"))), "source_prevalence", "selected_prevalence")


@_query("SELECT event_id, CASE WHEN event_type = 'error' THEN -0.3 WHEN value < 20 THEN -0.35 WHEN event_id % 2 = 0 THEN -0.2 WHEN event_type = 'signup' THEN -0.15 ELSE -0.11 END AS reward FROM events")
def failure_ladder(spark: SparkSession, folder: str) -> DataFrame:
    reasons = F.when(F.col("event_type") == "error", F.array(F.lit("ANSWER_LEAK"))).when(F.col("event_type") == "signup", F.array(F.lit("SHORTCUT_UNKNOWN"))).otherwise(F.array(F.lit("REDUNDANT_CONDITION")))
    out = rewards.verification_failure(reasons, F.col("value") >= 20, F.col("event_id") % 2 != 0, F.lit(True), F.lit(0.5))
    return _events(spark, folder).select("event_id", F.round(out, 6).alias("reward"))


@_query("""WITH m AS (SELECT event_id, event_id % 2 AS a, (event_id % 5) / 4.0 AS b, (event_id % 3) / 2.0 AS c FROM events),
s AS (SELECT event_id, 0.10 * a + 0.25 * b + 0.25 * c + 0.20 * a + 0.20 * b AS syntax, 0.10 * a + 0.25 * b + 0.25 * c + 0.15 * a + 0.15 * b + 0.10 * c AS tool, 0.10 * a + 0.15 * b + 0.55 * c + 0.20 * a AS solve FROM m)
SELECT event_id, round(syntax, 6) AS syntax, round(0.4 * syntax + 0.6 * tool, 6) AS tool, round(0.2 * syntax + 0.3 * tool + 0.5 * solve, 6) AS solve FROM s""")
def solver_rewards(spark: SparkSession, folder: str) -> DataFrame:
    a, b, c = F.col("event_id") % 2, (F.col("event_id") % 5) / 4.0, (F.col("event_id") % 3) / 2.0
    score = lambda weights, values: rewards.weighted(dict(zip(weights, values)), weights)
    syntax, tool, solve = score(rewards.SOLVER_SYNTAX, (a, b, c, a, b)), score(rewards.SOLVER_TOOL, (a, b, c, a, b, c)), score(rewards.SOLVER_SOLVE, (a, b, c, a))
    return _events(spark, folder).select("event_id", *(F.round(rewards.solver_curriculum(syntax, tool, solve, s), 6).alias(s) for s in ("syntax", "tool", "solve")))


_OPS = ["start", "follow", "filter_literal", "count", "emit"]


@_query("""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '"op"\\s*:\\s*"([^"\\\\]*)"', 1) AS ops, regexp_matches(text, '"version"\\s*:\\s*"0.2"') AS v, regexp_matches(text, '"ops"\\s*:\\s*\\[') AS o FROM documents WHERE starts_with(text, '{"version": "0.') AND NOT json_valid(text)),
f AS (SELECT doc_id, v, o, [x IN ('start', 'follow', 'filter_literal', 'count', 'emit') for x in ops] AS ok, len(regexp_extract_all(text, '"op"\\s*:')) AS slots FROM d),
g AS (SELECT doc_id, v, o, CASE WHEN greatest(slots, len(ok)) = 0 THEN 0 ELSE len([x for x in ok if x]) / greatest(slots, len(ok))::DOUBLE END AS share, CASE WHEN greatest(slots, len(ok)) = 0 THEN 0 ELSE (CASE WHEN list_position(ok, false) > 0 THEN list_position(ok, false) - 1 ELSE len(ok) END) / greatest(slots, len(ok))::DOUBLE END AS prefix FROM f)
SELECT doc_id, CASE WHEN v OR o THEN 1.0 ELSE 0.0 END AS code_present, round(0.4 * (v::INT + o::INT + share) / 3, 6) AS schema_fraction, round(0.4 * share, 6) AS valid_operation_fraction, round(0.4 * prefix, 6) AS valid_prefix_fraction FROM g""")
def truncated_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Credit of scripts in the corpus that are no whole JSON (cut off, or with text after them)."""
    rows = table(spark, folder, "documents", "doc_id", "text").filter(F.col("text").startswith('{"version": "0.') & ~rewards.whole_json(F.col("text")))
    names = ["code_present", "schema_fraction", "valid_operation_fraction", "valid_prefix_fraction"]
    return _rounded(rows.select("doc_id", rewards.script_shape(F.col("text"), "0.2", _OPS).alias("s")).select("doc_id", "s.*"), *names)


@_query("SELECT row_id, CASE WHEN role_ = 'count' THEN ['7'] WHEN role_ = 'one' THEN ['x'] ELSE ['a', 'b'] END AS answers FROM (SELECT DISTINCT row_id, CASE WHEN row_id % 3 = 0 THEN 'count' WHEN row_id % 3 = 1 THEN 'one' ELSE 'many' END AS role_ FROM sft_rows)")
def answers_parsed(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("row_id") % 3 == 0, "count").otherwise("entity")
    text = F.when(F.col("row_id") % 3 == 0, "so <answer> [7] </answer>").when(F.col("row_id") % 3 == 1, '<answer>"x"</answer>').otherwise('<answer>["a", "b"]</answer> done')
    rows = table(spark, folder, "sft_rows", "row_id").distinct()
    return rows.select("row_id", rewards.parsed_answers(text, kind).alias("answers"))


@_query("SELECT event_id, round(((event_id % 2 = 0)::INT + 1 + (event_type = 'click')::INT + 1 + CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END) / 5.0, 6) AS alignment FROM events")
def target_alignment(spark: SparkSession, folder: str) -> DataFrame:
    target = F.lit("roots=0|terminal=entity|nodes=click|ops=count,hop|answers=1")
    ops = F.when(F.col("event_id") % 3 == 0, "hop,count").otherwise("hop")
    out = rewards.structure_alignment(target, (F.col("event_id") % 2).cast("string"), F.lit("entity"), F.col("event_type"), ops, F.lit("1"))
    return _events(spark, folder).select("event_id", F.round(out, 6).alias("alignment"))


# exports


@_query("SELECT o AS relation_id, o AS label, count(DISTINCT row_id) AS tasks FROM (SELECT row_id, unnest(operator_set) AS o FROM sft_rows) WHERE o <> '' GROUP BY o")
def task_relations(spark: SparkSession, folder: str) -> DataFrame:
    """A relation catalogue from what tasks name."""
    rows = table(spark, folder, "sft_rows", "row_id", "operator_set").select(F.col("row_id").cast("string").alias("task_id"), F.col("operator_set").alias("relations"))
    return exports.relation_catalog(rows, spark.createDataFrame([], "relation_id string, label string"))


@_query("""WITH b AS (SELECT DISTINCT example_id, question, topic_entity_ids FROM benchmark_examples)
SELECT example_id AS task_id, 'solver' AS role, question AS prompt FROM b WHERE question IS NOT NULL UNION ALL SELECT example_id, 'questioner', topic_entity_ids[1] FROM b WHERE len(topic_entity_ids) > 0 AND topic_entity_ids[1] IS NOT NULL""")
def role_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "question", "topic_entity_ids").distinct()
    tasks = rows.select(F.col("example_id").alias("task_id"), F.lit("s").alias("snapshot"), "question", F.try_element_at("topic_entity_ids", F.lit(1)).alias("seed"), F.array(F.lit("r")).alias("relations"))
    return exports.role_rows(tasks, spark.createDataFrame([("s", "r")], "snapshot string, relation_id string")).select("task_id", "role", "prompt")


@_query("SELECT DISTINCT example_id, [{'role': 'system', 'content': 'Answer.'}, {'role': 'user', 'content': question}, {'role': 'assistant', 'content': '<answer>[\"x\"]</answer>'}] AS messages FROM benchmark_examples WHERE question IS NOT NULL")
def solver_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "question").filter("question is not null").distinct()
    return exports.solver_messages(rows.withColumn("script", F.lit(None).cast("string")).withColumn("answers", F.array(F.lit("x"))), "Answer.").select("example_id", "messages")


@_query("WITH b AS (SELECT DISTINCT example_id AS task_id, topic_entity_ids[1] AS seed, question FROM benchmark_examples WHERE question IS NOT NULL AND topic_entity_ids[1] IS NOT NULL) SELECT task_id, seed FROM b ORDER BY sha256('4|' || task_id), task_id LIMIT 50")
def questioner_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "question", "topic_entity_ids").distinct()
    tasks = rows.select(F.col("example_id").alias("task_id"), F.try_element_at("topic_entity_ids", F.lit(1)).alias("seed"), "question", F.lit("{}").alias("script"))
    return exports.questioner_sample(tasks, 50, 4, "Ask.").select("task_id", F.col("messages")[1]["content"].alias("seed"))


@_query("WITH b AS (SELECT DISTINCT example_id AS task_id, topic_entity_ids[1] AS entity_id, dataset AS stratum FROM benchmark_examples WHERE len(topic_entity_ids) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('6|' || task_id), task_id) AS k FROM b) SELECT task_id, entity_id, stratum FROM r WHERE k <= 10")
def task_seeds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "dataset", "topic_entity_ids").distinct()
    return exports.task_seeds(rows.select(F.col("example_id").alias("task_id"), F.col("topic_entity_ids").alias("topics"), F.col("dataset").alias("stratum")), 10, 6)


@_query("SELECT row_id, role, origin, list_intersect_sorted AS relations FROM (SELECT row_id, role, origin, ['count'] AS list_intersect_sorted FROM sft_rows WHERE list_contains(operator_set, 'count') UNION ALL SELECT row_id, role, origin, [] FROM sft_rows WHERE NOT list_contains(operator_set, 'count'))")
def round_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a round from two parts of differing schemas, their relations cut to those observed."""
    rows = table(spark, folder, "sft_rows", "row_id", "role", "origin", "operator_set").filter("operator_set is not null")
    tasks = rows.select(F.col("row_id").alias("task_id"), "role", "origin", F.struct(F.array_distinct("operator_set").alias("relations")).alias("extra_info"))
    observed = rows.select(F.col("row_id").alias("task_id")).distinct().withColumn("relations", F.array(F.lit("count")))
    first, second = tasks.filter("task_id % 2 = 0"), tasks.filter("task_id % 2 = 1").withColumn("note", F.lit("n"))
    return exports.round_rows([first, second], observed, 2).select(F.col("task_id").alias("row_id"), "role", "origin", "extra_info.relations")


@_query("SELECT row_id, written_at, [CASE WHEN m.role IN ('function', 'observation') THEN 'tool' ELSE m.role END for m in messages] AS roles, [coalesce(m.content, '') for m in messages] AS contents FROM sft_rows")
def record_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_rows", "row_id", "written_at", "messages").withColumn("m", exports.record_messages(F.col("messages")))
    return rows.select("row_id", "written_at", F.transform("m", lambda m: m["role"]).alias("roles"), F.transform("m", lambda m: m["content"]).alias("contents"))


@_query("SELECT 'MISSING prompt' AS problem UNION SELECT 'TYPE row_id: bigint'")
def schema_check(spark: SparkSession, folder: str) -> DataFrame:
    found = exports.check_schema(table(spark, folder, "sft_rows"), {"row_id": "string", "role": "string", "prompt": "string"})
    return spark.createDataFrame([(x,) for x in found], "problem string")


@_query("SELECT dataset, count(*) AS n FROM benchmark_examples GROUP BY dataset")
def stratum_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark_examples", "dataset").groupBy("dataset").agg(F.count("*").alias("n"))


@_query("SELECT n_nationkey, CAST(k AS INT) AS copy FROM nation, range(1, 3) AS r(k) UNION ALL SELECT n_nationkey, 3 FROM (SELECT n_nationkey FROM nation ORDER BY sha256('8|' || n_nationkey), n_nationkey LIMIT 10)")
def oversample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.oversample(table(spark, folder, "nation", "n_nationkey"), "n_nationkey", 60, 25, 8)
