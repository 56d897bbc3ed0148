"""Queries of sampling, archive, metrics, rewards, exports and streams over the test tables, with hand-written SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import rewards, text
from graphweft.operators import archive, metrics, sampling
from graphweft.session import ship, table
from graphweft.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


@_query("SELECT row_id, role FROM (SELECT row_id, role, row_number() OVER (PARTITION BY role ORDER BY sha256('7|' || row_id), row_id) AS n FROM (SELECT DISTINCT row_id, lower(trim(role)) AS role FROM sft_rows WHERE role IS NOT NULL)) WHERE n <= 20")
def stratified_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_rows", "row_id", "role").filter("role is not null").select("row_id", F.lower(F.trim("role")).alias("role")).distinct()
    return sampling.top_per_stratum(rows, "role", "row_id", 20, 7)


@_query("""WITH s AS (SELECT dataset, count(*) AS n FROM benchmark_examples WHERE dataset IS NOT NULL GROUP BY 1), t AS (SELECT least(100, sum(n)) AS total FROM s),
b AS (SELECT dataset, n, 1 AS base FROM s), r AS (SELECT dataset, n - 1 AS room, (total - (SELECT count(*) FROM s)) AS rest, n FROM b, t), e AS (SELECT *, rest * room / (SELECT sum(room) FROM r)::DOUBLE AS share FROM r),
w AS (SELECT *, least(CAST(floor(share) AS BIGINT), room) AS given FROM e), k AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, room DESC, dataset) AS place, rest - sum(given) OVER () AS over FROM w)
SELECT dataset, CAST(1 + given + CASE WHEN place <= over AND given < room THEN 1 ELSE 0 END AS BIGINT) AS n FROM k""")
def stratified_quota(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "dataset")
    return sampling.stratified(rows, "dataset", "example_id", 100, 42).groupBy("dataset").agg(F.count("*").alias("n"))


@_query("SELECT example_id, CASE WHEN CAST('0x' || substr(sha256('13|' || example_id), 1, 8) AS BIGINT) % 1000 < 50 THEN 'validation' ELSE 'train' END AS split FROM benchmark_examples")
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split(table(spark, folder, "benchmark_examples", "example_id"), "example_id", 50, 13)


GRAMS_SQL = """WITH w AS (SELECT DISTINCT example_id AS id, split, regexp_extract_all(lower(question), '[a-z0-9_.]+') AS t FROM benchmark_examples WHERE question IS NOT NULL),
g AS (SELECT DISTINCT id, split, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE [array_to_string(t[i:i+2], ' ') for i in generate_series(1, len(t) - 2)] END) AS gram FROM w)
"""


@_query(GRAMS_SQL + """, a AS (SELECT id, gram FROM g WHERE CAST(substr(id, 7) AS INT) % 100 = 0), b AS (SELECT id, gram FROM g WHERE CAST(substr(id, 7) AS INT) % 100 <> 0),
s AS (SELECT a.id, b.id AS other, count(*) AS k FROM a JOIN b USING (gram) GROUP BY 1, 2), n AS (SELECT id, count(*) AS n FROM g GROUP BY id)
SELECT x.id, round(1 - coalesce(max(k / (n1.n + n2.n - k)::DOUBLE), 0), 6) AS novelty FROM (SELECT DISTINCT id FROM a) x LEFT JOIN s ON s.id = x.id LEFT JOIN n n1 ON n1.id = s.id LEFT JOIN n n2 ON n2.id = s.other GROUP BY x.id""")
def trigram_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Novelty of the stated query set, examples whose number is divisible by 100, against all others."""
    rows = table(spark, folder, "benchmark_examples", "example_id", "question").filter("question is not null").distinct()
    grams = archive.grams(rows, "example_id", "question").withColumnRenamed("example_id", "id")
    mine = F.substring("id", 7, 100).cast("int") % 100 == 0
    out = archive.novelty(grams.filter(mine), grams.select(F.col("id").alias("other"), "gram"))
    return out.select("id", F.round("novelty", 6).alias("novelty"))


@_query("""SELECT task_id, batch_no, signature FROM tasks WHERE batch_no = 0 AND task_id IS NOT NULL UNION
SELECT min(task_id), min_by(batch_no, task_id), signature FROM tasks t WHERE batch_no > 0 AND signature NOT IN (SELECT signature FROM tasks WHERE batch_no = 0) AND task_id NOT IN (SELECT task_id FROM tasks WHERE batch_no = 0) GROUP BY signature""")
def archive_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "tasks", "task_id", "batch_no", "signature").distinct()
    return archive.upsert(rows.filter("batch_no = 0"), rows.filter("batch_no > 0"))


@_query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS high_rate, round(avg(value), 6) AS value_mean FROM events GROUP BY ROLLUP (event_type)")
def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "event_type", "value").withColumn("high", F.col("value") > 50)
    return metrics.summary(rows, "event_type", ["high"], ["value"]).select("event_type", "n", F.round("high_rate", 6).alias("high_rate"), F.round("value_mean", 6).alias("value_mean"))


@_query("SELECT tag, count(*) AS n, round(avg(n_chars), 6) AS mean FROM (SELECT row_id, written_at, n_chars, unnest(CASE WHEN len(coalesce(operator_set, [])) = 0 THEN ['untagged'] ELSE list_distinct(operator_set) END) AS tag FROM sft_rows) GROUP BY tag")
def eval_by_operator(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.by_tag(table(spark, folder, "sft_rows", "operator_set", "n_chars"), "operator_set", "n_chars").select("tag", "n", F.round("mean", 6).alias("mean"))


@_query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def role_weighted_means(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "events", "event_type", "user_id", "value").groupBy("event_type", "user_id").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return metrics.weighted_means(part, ["event_type"], "mean", "n").select("event_type", "n", F.round("mean", 4).alias("mean"))


@_query("""WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, event_type AS name, round(CASE WHEN event_type = 'click' THEN sum(value) / any_value(n) ELSE sum(value) / count(*) END, 6) AS mean FROM events JOIN s USING (user_id) WHERE value IS NOT NULL GROUP BY user_id, event_type""")
def sparse_component_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "user_id", "event_type", "value")
    samples = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    out = metrics.sparse_means(rows.filter("value is not null").withColumnRenamed("event_type", "name"), samples, "user_id", ["click"])
    return out.select("user_id", "name", F.round("mean", 6).alias("mean"))


@_query("""WITH a AS (SELECT source AS k, count(*)::DOUBLE / (SELECT count(*) FROM documents WHERE lang = 'en' AND source IS NOT NULL) AS p FROM documents WHERE lang = 'en' AND source IS NOT NULL GROUP BY 1),
b AS (SELECT source AS k, count(*)::DOUBLE / (SELECT count(*) FROM documents WHERE lang = 'de' AND source IS NOT NULL) AS q FROM documents WHERE lang = 'de' AND source IS NOT NULL GROUP BY 1)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS distance FROM a FULL JOIN b USING (k)""")
def tv_distance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "lang", "source").filter("source is not null")
    counts = lambda lang: rows.filter(F.col("lang") == lang).groupBy("source").agg(F.count("*").alias("n"))
    return metrics.total_variation(counts("en"), counts("de"), "source").select(F.round("distance", 6).alias("distance"))


@_query("SELECT 'role' AS dimension, role AS value, count(*) AS n FROM sft_rows GROUP BY role UNION ALL SELECT 'operator_set', o, count(*) FROM (SELECT unnest(operator_set) AS o FROM sft_rows) GROUP BY o")
def structure_marginals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_rows", "role", "operator_set").withColumn("operator_set", F.coalesce("operator_set", F.array().cast("array<string>")))
    return metrics.marginals(rows, ["role", "operator_set"])


@_query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, max_by(value, event_id) AS last FROM events GROUP BY event_type")
def metric_stats(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.statistics(table(spark, folder, "events", "event_type", "event_id", "value"), ["event_type"], "event_id", "value").withColumn("mean", F.round("mean", 6))


@_query("SELECT event_id, round(CASE WHEN var_pop(value) OVER w <= 1e-12 THEN 0.0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def zscore_group(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "user_id", "value").select("event_id", F.round(metrics.standardized("value", "user_id"), 6).alias("z"))


@_query("""WITH e AS (SELECT month(o_orderdate) AS phase, max(day(o_orderdate)) AS top FROM orders GROUP BY 1)
SELECT o_orderkey, CAST(coalesce((SELECT sum(top) FROM e WHERE e.phase < month(o_orderdate)), 0) + day(o_orderdate) AS BIGINT) AS global_step FROM orders""")
def stitched_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.month("o_orderdate").alias("phase"), F.dayofmonth("o_orderdate").alias("step"))
    return metrics.stitched(rows, "phase", "step").select("o_orderkey", F.col("global_step").cast("long").alias("global_step"))


@_query("WITH r AS (SELECT event_type AS run, round(avg(value), 6) AS em FROM events GROUP BY 1) SELECT run, em, round(em - (SELECT em FROM r WHERE run = 'click'), 6) AS delta FROM r")
def run_compare(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "events", "event_type", "value").groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 6).alias("em"))
    return metrics.compared(runs, "click", "em").withColumn("delta", F.round("delta", 6))


@_query("""WITH m AS (SELECT user_id, least(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) / 100, 1.0) AS rate, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, round(exp(-(rate - 0.5) * (rate - 0.5) / 0.08), 6) AS frontier, round((rate * n + 1) / (n + 2), 6) AS smoothed, round(0.2 + 0.8 * (0.35 * exp(-(rate - 0.5) * (rate - 0.5) / 0.08) + 0.25 + 0.25 * 0.5 + 0.15 * exp(-0.05 * 3.0)), 6) AS quality FROM m""")
def reward_frontier(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "user_id", "value")
    mean = F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")  # exact sums: the order of rows decides no digit
    rows = rows.groupBy("user_id").agg(F.least(mean / 100, F.lit(1.0)).alias("rate"), F.count("*").alias("n"))
    rate = F.col("rate")
    return rows.select(
        "user_id", F.round(rewards.frontier(rate), 6).alias("frontier"), F.round(rewards.smoothed(rate, F.col("n")), 6).alias("smoothed"),
        F.round(rewards.quality(rate, F.lit(1.0), F.lit(0.5), F.lit(3.0)), 6).alias("quality"),
    )


@_query("""WITH x AS (SELECT example_id, [a.value for a in gold_answers] AS gold, CASE WHEN len(gold_answers) > 1 THEN [a.value for a in gold_answers[1:1]] || ['other'] ELSE [a.value for a in gold_answers] END AS pred FROM benchmark_examples WHERE gold_answers IS NOT NULL),
y AS (SELECT DISTINCT example_id, len(list_distinct(gold)) AS m, len(list_distinct(pred)) AS n, len(list_intersect(list_distinct(gold), list_distinct(pred))) AS b FROM x)
SELECT example_id, round(CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n + m = 0 THEN 0.0 ELSE 2.0 * b / (n + m) END, 6) AS f1, CASE WHEN b = n AND b = m THEN 1.0 ELSE 0.0 END AS em FROM y""")
def set_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "example_id", "gold_answers").filter("gold_answers is not null")
    gold = F.transform("gold_answers", lambda a: a["value"])
    pred = F.when(F.size(gold) > 1, F.concat(F.slice(gold, 1, 1), F.array(F.lit("other")))).otherwise(gold)
    scored = rows.select("example_id", metrics.set_scores(pred, gold).alias("s"))
    return scored.select("example_id", F.round("s.f1", 6).alias("f1"), F.col("s.em").alias("em")).distinct()


@_query("SELECT row_id, written_at, len(messages) AS turns, len([m for m in messages if m.role = 'assistant']) AS assistant_turns, len([m for m in messages if m.tool_calls IS NOT NULL AND len(m.tool_calls) > 0]) AS calling_turns FROM sft_rows")
def message_shapes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_rows", "row_id", "written_at", "messages")
    having = lambda test: F.size(F.filter("messages", test)).cast("long")
    calls = lambda m: F.coalesce(F.size(m["tool_calls"]) > 0, F.lit(False))
    return rows.select("row_id", "written_at", F.size("messages").cast("long").alias("turns"), having(lambda m: m["role"] == "assistant").alias("assistant_turns"), having(calls).alias("calling_turns"))


@_query("SELECT row_id, [{'role': m.role, 'content': coalesce(m.content, ''), 'tool_calls': len(m.tool_calls)} for m in messages] AS messages FROM sft_rows")
def messages_shaped(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as training records, tool calls counted."""
    shape = lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), F.size(F.from_json(F.to_json(m["tool_calls"]), "array<struct<id:string>>")).cast("long").alias("tool_calls"))
    out = table(spark, folder, "sft_rows", "row_id", "messages").select("row_id", F.transform("messages", shape).alias("messages"))
    fixed = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(m["tool_calls"] >= 0, m["tool_calls"]).alias("tool_calls"))
    return out.select("row_id", F.transform("messages", fixed).alias("messages"))


@_query("SELECT row_id, [{'role': m.role, 'content': coalesce(m.content, ''), 'tool_calls': CASE WHEN m.tool_calls IS NULL THEN NULL ELSE '[' || array_to_string(['{' || array_to_string([p for p in ['\"id\":' || to_json(c.id), '\"type\":' || to_json(c.type), CASE WHEN c.function IS NOT NULL THEN '\"function\":{' || array_to_string([q for q in ['\"name\":' || to_json(c.function.name), '\"arguments\":' || to_json(c.function.arguments)] if q IS NOT NULL], ',') || '}' END] if p IS NOT NULL], ',') || '}' for c in m.tool_calls], ',') || ']' END} for m in messages] AS messages FROM sft_rows")
def messages_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as training records: empty contents for NULL, tool calls packed as JSON."""
    shape = lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), F.to_json(m["tool_calls"]).alias("tool_calls"))
    return table(spark, folder, "sft_rows", "row_id", "messages").select("row_id", F.transform("messages", shape).alias("messages"))


@_query("SELECT task_id, count(*) AS n FROM tasks GROUP BY task_id HAVING count(*) > 1")
def audit_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tasks", "task_id").groupBy("task_id").agg(F.count("*").alias("n")).filter("n > 1")


@_query("SELECT DISTINCT unnest(topic_entity_ids) AS entity_id FROM benchmark_examples WHERE lower(trim(split)) IN ('dev', 'val', 'validation', 'test')")
def denylist_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_examples", "split", "topic_entity_ids").filter(F.lower(F.trim("split")).isin("dev", "val", "validation", "test"))
    return rows.select(F.explode("topic_entity_ids").alias("entity_id")).distinct()


@_query("SELECT doc_id, regexp_extract(text, '<answer>\\s*([^<]*?)\\s*</answer>', 1) AS answer FROM documents WHERE text LIKE '%<answer>%</answer>%' AND regexp_extract(text, '<answer>\\s*([^<]*?)\\s*</answer>', 1) <> ''")
def answer_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "doc_id", "text").filter(F.col("text").like("%<answer>%</answer>%"))
    return rows.select("doc_id", text.between_tags(F.col("text"), "answer").alias("answer")).filter("answer is not null")


@_query("SELECT DISTINCT example_id, trim(gold_answers[1].value) AS answer FROM benchmark_examples WHERE trim(gold_answers[1].value) <> ''")
def answer_tags_written(spark: SparkSession, folder: str) -> DataFrame:
    """Answers written between tags and read back."""
    first = F.try_element_at("gold_answers", F.lit(1))["value"]
    said = F.concat(F.lit("so <answer> "), first, F.lit("\n</answer> and <answer>other</answer>"))
    rows = table(spark, folder, "benchmark_examples", "example_id", "gold_answers").select("example_id", text.between_tags(said, "answer").alias("answer"))
    return rows.filter("answer is not null").select("example_id", F.trim("answer").alias("answer")).distinct()


@_query("SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(title), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS answer FROM documents WHERE title IS NOT NULL AND regexp_full_match(title, '[ -~]*')")
def normal_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles normalised as open-question answers are."""
    rows = table(spark, folder, "documents", "doc_id", "title").filter("title is not null and title rlike '^[ -~]*$'")
    return rows.select("doc_id", text.normal_answer(F.col("title")).alias("answer"))


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS role, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def role_rollup(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.role_rollup(table(spark, folder, "events", "ts", "event_type", "value"), "ts", "event_type", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "role", "n", F.round("total", 4).alias("total"), "least", "most")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return ship(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS role, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_role_rollup(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.drain(streams.role_rollup(_stream(spark, folder), "ts", "event_type", "value"), "graphweft_rollup", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "role", "n", F.round("total", 4).alias("total"))


@_query("SELECT user_id, count(*) AS calls, CAST(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS DOUBLE) AS used, sum(CAST(value AS DECIMAL(18,2))) > 1000 AS spent FROM events GROUP BY user_id")
def stream_budget_final(spark: SparkSession, folder: str) -> DataFrame:
    """What each key has used up when the stream has been read, to the cent."""
    out = streams.drain(streams.running_budget(_stream(spark, folder).select("user_id", "value"), "user_id", "value", 1000.0), "graphweft_budget_final", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("calls", "used", "spent"), "calls").alias("x")).select("user_id", "x.*")
    return last.withColumn("used", F.round("used", 2))


@_query()
def stream_budget(spark: SparkSession, folder: str) -> DataFrame:
    return streams.drain(streams.running_budget(_stream(spark, folder).select("user_id", "value"), "user_id", "value", 1000.0), "graphweft_budget", "update")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    out = streams.sessions(table(spark, folder, "events", "ts", "user_id"), "ts", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")
