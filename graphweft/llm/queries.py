"""Queries of the training-text problems, and their SQL where there is any."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import encode, history, leaks, mixture, overlap, residue, sample
from graphweft.session import table

TOKENIZERS = "byte_bpe_50k.tiktoken"


def _config(spark: SparkSession, folder: str, name: str) -> dict[str, tuple[str, str]]:
    """Field to value and what it applies to; a configuration of some ten rows."""
    rows = table(spark, folder, "run_config").filter(F.lower("config_name") == name).collect()
    return {r.field_name.strip().lower(): (r.field_value.strip(), (r.applies_to or "").strip()) for r in rows}


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    config = _config(spark, folder, "sftcapabilityconfig")
    rows = table(spark, folder, "probe_rows", "row_id", "input_name", "data_source", "task_id", "prompt", "extra_info")
    own = F.lit(False)
    for field, (value, applies) in config.items():
        if field.endswith("_input"):
            source = applies.split(" ")[-1]
            own = own | ((F.lower(F.trim("input_name")) == field) & (F.lower(F.trim("data_source")) == source.lower()))
    rows = rows.filter(own).withColumn("input_name", F.lower(F.trim("input_name")))
    return sample.draw(rows, "input_name", "row_id", int(config["groups"][0]), int(config["seed"][0]))


def _mix(spark: SparkSession, folder: str, name: str, column: str) -> tuple[DataFrame, DataFrame]:
    config = _config(spark, folder, name)
    weights = {f.removesuffix("_ratio"): Fraction(v) for f, (v, _) in config.items() if f.endswith("_ratio")}
    return mixture.mix(table(spark, folder, "sft_rows", "row_id", column), column, "row_id", weights, int(config["max_repeats"][0]), seed=0)


def p6_by_role(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder, "prepare_mixed_sft_data", "role")[0]


def p6_by_origin(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder, "selfplayconfig", "origin")[0]


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    reports = [_mix(spark, folder, n, c)[1].withColumn("mixture", F.lit(c)) for n, c in (("prepare_mixed_sft_data", "role"), ("selfplayconfig", "origin"))]
    return reports[0].unionByName(reports[1])


def _ordered(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias(f"{out}_a"), F.greatest(a, b).alias(f"{out}_b")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = history.check_batches(table(spark, folder, "tasks", "task_id", "signature", "payload", "batch_no"))[1]
    return _ordered(pairs, "task", "accepted", "task")


def p5_accepted(spark: SparkSession, folder: str) -> DataFrame:
    store = history.check_batches(table(spark, folder, "tasks", "task_id", "signature", "payload", "batch_no"))[0]
    return store.tasks().select("task_id", "batch_no", "signature")


def _cross(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split(table(spark, folder, "benchmark_examples", "example_id", "dataset", "split", "question"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _ordered(_cross(spark, folder), "train_id", "held_id", "example")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _cross(spark, folder).groupBy("split", "dataset").agg(
        F.count_distinct("held_id").alias("held_examples"), F.count_distinct("train_id").alias("train_examples"), F.count_distinct("held_id", "train_id").alias("pairs"), F.max("longest").cast("long").alias("longest_match")
    )


def tokenizer_path(spark: SparkSession) -> str:
    """The rank file: ``graphweft.tokenizer`` of the session, else that of the installed public tokenizers."""
    given = spark.conf.get("graphweft.tokenizer", None)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(TOKENIZERS)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path(spark))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(table(spark, folder, "documents", "doc_id", "text")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_sample, p5_found, p5_accepted, p6_by_role, p6_by_origin, p6_shares, p7_found, p7_report, p8_ids, p9_found, p10_found)}


def _mixture_sql(config: str, column: str) -> str:
    """Quotas by largest remainder, slots by the golden-ratio lattice, rows ranked by their hash: the mixture in SQL."""
    return f"""WITH c AS (SELECT lower(trim(field_name)) AS f, trim(field_value) AS v FROM run_config WHERE lower(config_name) = '{config}'),
w AS (SELECT replace(f, '_ratio', '') AS source, CAST(CAST(v AS DECIMAL(18,6)) * 1000000 AS HUGEINT) AS w FROM c WHERE f LIKE '%_ratio'), rep AS (SELECT CAST(v AS BIGINT) AS rep FROM c WHERE f = 'max_repeats'),
own AS (SELECT row_id, min(lower(trim({column}))) AS source FROM sft_rows WHERE lower(trim({column})) IN (SELECT source FROM w) AND row_id IS NOT NULL GROUP BY row_id),
sizes AS (SELECT w.source, w.w, count(own.row_id) AS size, (SELECT sum(w) FROM w) AS ws FROM w LEFT JOIN own USING (source) GROUP BY 1, 2),
most AS (SELECT least(sum(size), min((size * rep + 1) * ws // w)) AS t FROM sizes, rep),
tries AS (SELECT t - k AS t FROM most, range(0, 10) AS g(k)),
exact AS (SELECT t, source, size, w * t // ws AS whole, w * t % ws AS over FROM sizes, tries),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY over DESC, source) <= t - sum(whole) OVER (PARTITION BY t) AS more FROM exact),
quota AS (SELECT t, source, size, CAST(whole + CASE WHEN more THEN 1 ELSE 0 END AS BIGINT) AS slots FROM placed),
best AS (SELECT max(t) AS t FROM (SELECT t FROM quota, rep GROUP BY t HAVING max(CASE WHEN slots > size * rep THEN 1 ELSE 0 END) = 0)),
final AS (SELECT source, size, slots, CAST(coalesce(sum(slots) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins, CAST(t AS BIGINT) AS total FROM quota WHERE t = (SELECT t FROM best)),
step AS (SELECT min(m) AS step FROM (SELECT unnest(range(greatest(1, CAST(round_even(total * (sqrt(5) - 1) / 2, 0) AS BIGINT)), total + 2)) AS m, total FROM (SELECT DISTINCT total FROM final)) WHERE gcd(m, total) = 1),
slot AS (SELECT s AS slot, (CAST(s AS HUGEINT) * step) % total AS point FROM (SELECT unnest(range(total)) AS s, total FROM (SELECT DISTINCT total FROM final)), step),
filled AS (SELECT slot, source, (point - begins) % size AS rank, (point - begins) // size AS copy FROM slot JOIN final ON point >= begins AND point < begins + slots),
ranked AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(sha256('0' || source || row_id), 1, 13) AS BIGINT), row_id) - 1 AS rank FROM own)
SELECT CAST(slot AS BIGINT) AS slot, source, row_id, CAST(copy AS BIGINT) AS copy FROM filled JOIN ranked USING (source, rank)"""


def _shares_sql(config: str, column: str) -> str:
    """The report of a mixture: rows and slots per source, the share asked for and reached, and how often a row stands at most."""
    return f"""SELECT w.source, (SELECT count(*) FROM (SELECT row_id, min(lower(trim({column}))) AS s FROM sft_rows WHERE row_id IS NOT NULL AND lower(trim({column})) IN (SELECT replace(lower(trim(field_name)), '_ratio', '') FROM run_config WHERE lower(config_name) = '{config}') GROUP BY row_id) WHERE s = w.source) AS rows,
coalesce(m.slots, 0) AS slots, w.w / (sum(w.w) OVER ()) AS target, coalesce(m.slots / (sum(m.slots) OVER ())::DOUBLE, 0.0) AS share, coalesce(m.most_copies, 0) AS most_copies, '{column}' AS mixture
FROM (SELECT replace(lower(trim(field_name)), '_ratio', '') AS source, CAST(trim(field_value) AS DOUBLE) * 100 AS w FROM run_config WHERE lower(config_name) = '{config}' AND lower(field_name) LIKE '%_ratio') w
LEFT JOIN (SELECT source, count(*) AS slots, max(copy) + 1 AS most_copies FROM ({_mixture_sql(config, column)}) GROUP BY source) m USING (source)"""


ORACLES: dict[str, str] = {
    "p1_sample": """WITH c AS (SELECT lower(trim(field_name)) AS f, trim(field_value) AS v, trim(coalesce(applies_to, '')) AS a FROM run_config WHERE lower(config_name) = 'sftcapabilityconfig'),
own AS (SELECT DISTINCT f AS input_name, row_id, data_source, task_id, prompt, extra_info FROM probe_rows JOIN c ON f LIKE '%_input' AND lower(trim(input_name)) = f AND lower(trim(data_source)) = lower(string_split(a, ' ')[-1]) WHERE row_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY input_name ORDER BY CAST('0x' || substr(sha256((SELECT v FROM c WHERE f = 'seed') || input_name || row_id), 1, 13) AS BIGINT), row_id) AS n FROM own)
SELECT input_name, row_id, data_source, task_id, prompt, extra_info FROM ranked WHERE n <= (SELECT CAST(v AS INT) FROM c WHERE f = 'groups')""",
    "p6_by_role": _mixture_sql("prepare_mixed_sft_data", "role"),
    "p6_by_origin": _mixture_sql("selfplayconfig", "origin"),
    "p6_shares": f"{_shares_sql('prepare_mixed_sft_data', 'role')} UNION ALL {_shares_sql('selfplayconfig', 'origin')}",
}
