"""Loaders: knowledge-base JSON, page JSON lines, benchmark files, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.operators import hierarchy
from graphweft.sources.catalog import GraphCatalog, build

SCALAR = "struct<type string, value string, unit string>"
QUALIFIERS = f"map<string, array<{SCALAR}>>"
KB = (
    "concepts map<string, struct<name string, instanceOf array<string>>>, entities map<string, struct<name string, instanceOf array<string>, aliases array<string>, "
    f"attributes array<struct<key string, value {SCALAR}, qualifiers {QUALIFIERS}>>, relations array<struct<predicate string, direction string, object string, qualifiers {QUALIFIERS}>>>>"
)
PAGE = "_id string, wikipedia_id string, wikipedia_title string, text array<string>, anchors array<struct<text string, wikipedia_id string>>, categories string, history struct<revid string>, wikidata_info struct<wikidata_id string>"


def knowledge_base(spark: SparkSession, path: str) -> GraphCatalog:
    """A graph from a JSON file of concepts and entities.  Backward relations are turned around, types are closed over the
    hierarchy (loops do no harm), a fact listed at both ends is two facts of one edge."""
    raw = spark.read.schema(KB).json(path, multiLine=True)
    concepts = raw.select(F.explode("concepts").alias("id", "c")).select("id", "c.*")
    entities = raw.select(F.explode("entities").alias("id", "e")).select("id", "e.*")
    nodes = concepts.select(F.col("id").alias("node_id"), F.col("instanceOf").alias("instanceof")).unionByName(entities.select(F.col("id").alias("node_id"), F.col("instanceOf").alias("instanceof")))
    above = hierarchy.ancestors(hierarchy.links(nodes)).select(F.col("node_id").alias("entity_id"), F.col("ancestor").alias("type_id"))
    attributes = entities.select("id", F.posexplode("attributes").alias("k", "a")).select(F.concat_ws("#a", "id", "k").alias("fact_id"), "id", "a.key", F.col("a.value.value").alias("value"), F.col("a.value.type").alias("datatype"), F.col("a.value.unit").alias("unit"), "a.qualifiers")
    relations = entities.select("id", F.posexplode("relations").alias("k", "r")).select(F.concat_ws("#r", "id", "k").alias("fact_id"), "id", "r.*")
    forward = F.col("direction") == "forward"
    relations = relations.select("fact_id", F.when(forward, F.col("id")).otherwise(F.col("object")).alias("subject"), "predicate", F.when(forward, F.col("object")).otherwise(F.col("id")).alias("object_entity"), "qualifiers")
    null = F.lit(None).cast("string")
    facts = relations.select("fact_id", F.lit("relation").alias("kind"), "subject", "predicate", "object_entity", null.alias("value"), null.alias("datatype"), null.alias("unit"))
    facts = facts.unionByName(attributes.select("fact_id", F.lit("attribute").alias("kind"), F.col("id").alias("subject"), F.col("key").alias("predicate"), null.alias("object_entity"), "value", "datatype", "unit"))
    flat = relations.select("fact_id", "qualifiers").unionByName(attributes.select("fact_id", "qualifiers"))
    qualifiers = flat.select("fact_id", F.explode("qualifiers").alias("key", "v")).select("fact_id", "key", F.explode("v").alias("v")).select("fact_id", "key", "v.value", F.col("v.type").alias("datatype"), "v.unit")
    names = relations.select(F.col("predicate").alias("relation_id")).unionByName(attributes.select(F.col("key").alias("relation_id"))).unionByName(qualifiers.select(F.col("key").alias("relation_id"))).distinct()
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return build(
        spark,
        entities=entities.select(F.col("id").alias("entity_id"), F.col("name").alias("label"), aliases.alias("aliases")),
        entity_types=above.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").distinct(),
        edges=relations.select("subject", F.col("predicate").alias("relation"), F.col("object_entity").alias("object")).distinct(),
        attributes=attributes.select(F.col("id").alias("entity_id"), "key", "value", "datatype", "unit").distinct(),
        facts=facts,
        qualifiers=qualifiers,
        relation_labels=names.select("relation_id", F.col("relation_id").alias("label")),
    )


def pages(spark: SparkSession, path: str) -> tuple[GraphCatalog, DataFrame]:
    """A graph of linked pages from JSON lines, and the rows refused: path, reason (INVALID_JSON, MISSING_PAGE_ID_OR_TITLE,
    MISSING_ANCHOR_TARGET with its count per page).  Of pages delivered twice, the last by the order of their text stands."""
    raw = spark.read.text(path).filter(F.trim("value") != "").withColumn("p", F.from_json("value", PAGE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = raw.filter(F.col("p._bad").isNotNull())
    rows = raw.filter(F.col("p._bad").isNull()).select("p.*").withColumn("page_id", F.coalesce("wikipedia_id", "_id"))
    incomplete = F.coalesce("page_id", F.lit("")).eqNullSafe("") | F.coalesce("wikipedia_title", F.lit("")).eqNullSafe("")
    good = rows.filter(~incomplete)
    last = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("history.revid"), F.desc(F.to_json("text"))))
    good = good.withColumn("_n", last).filter("_n = 1")
    anchors = good.select("page_id", F.explode("anchors").alias("a")).select("page_id", F.col("a.wikipedia_id").alias("target"))
    missing = anchors.filter("target is null").groupBy("page_id").agg(F.count("*").alias("count"))
    rejections = bad.select(F.lit("INVALID_JSON").alias("reason"), F.lit(None).cast("string").alias("page_id"), F.lit(1).cast("long").alias("count"))
    rejections = rejections.unionByName(rows.filter(incomplete).select(F.lit("MISSING_PAGE_ID_OR_TITLE").alias("reason"), "page_id", F.lit(1).cast("long").alias("count")))
    rejections = rejections.unionByName(missing.select(F.lit("MISSING_ANCHOR_TARGET").alias("reason"), "page_id", "count"))
    kinds = good.select("page_id", F.explode(F.split("categories", ",")).alias("type_id")).select(F.col("page_id").alias("entity_id"), F.trim("type_id").alias("type_id")).filter("type_id <> ''").distinct()
    paragraphs = good.select("page_id", F.posexplode("text").alias("paragraph_id", "text"), F.col("wikipedia_title").alias("title"))
    catalog = build(
        spark,
        entities=good.select(F.col("page_id").alias("entity_id"), F.col("wikipedia_title").alias("label"), F.array().cast("array<string>").alias("aliases")),
        entity_types=kinds,
        edges=anchors.filter("target is not null").select(F.col("page_id").alias("subject"), F.lit("links_to").alias("relation"), F.col("target").alias("object")).distinct(),
        relation_labels=spark.createDataFrame([("links_to", "links to")], "relation_id string, label string"),
        passages=paragraphs.filter(F.trim("text") != "").select("page_id", F.col("paragraph_id").cast("long").alias("paragraph_id"), "title", "text"),
    )
    return catalog, rejections


ALIASES = "array<array<string>>"


def webqsp(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Examples of a question file with parses: topics and gold answers of all parses together."""
    schema = "Questions array<struct<QuestionId string, RawQuestion string, Parses array<struct<TopicEntityMid string, Sparql string, Answers array<struct<AnswerArgument string, EntityName string>>>>>>"
    q = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("Questions").alias("q")).select("q.*")
    answers = F.array_distinct(F.flatten(F.transform("Parses", lambda p: p["Answers"])))
    return q.select(
        F.col("QuestionId").alias("example_id"), F.lit("webqsp").alias("dataset"), F.lit(split).alias("split"), F.col("RawQuestion").alias("question"),
        F.array_distinct(F.filter(F.transform("Parses", lambda p: p["TopicEntityMid"]), lambda m: m.isNotNull())).alias("topic_entity_ids"),
        F.transform(answers, lambda a: F.struct(a["AnswerArgument"].alias("value"), F.when(a["EntityName"].isNotNull(), "entity").otherwise("literal").alias("kind"), a["EntityName"].alias("label"))).alias("gold_answers"),
        F.array().cast(ALIASES).alias("answer_aliases"),
    )


def open_qa(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """Examples of JSON lines with ``input`` and ``output``: one alias group of all answers, topics from provenance."""
    schema = "id string, input string, output array<struct<answer string, provenance array<struct<wikipedia_id string>>>>"
    rows = spark.read.schema(schema).json(path)
    given = F.array_distinct(F.filter(F.transform("output", lambda o: o["answer"]), lambda a: a.isNotNull() & (F.trim(a) != "")))
    topics = F.array_distinct(F.filter(F.flatten(F.transform("output", lambda o: F.transform(F.coalesce(o["provenance"], F.array().cast("array<struct<wikipedia_id:string>>")), lambda p: p["wikipedia_id"]))), lambda x: x.isNotNull()))
    return rows.filter(F.size(given) > 0).select(
        F.col("id").alias("example_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.col("input").alias("question"), topics.alias("topic_entity_ids"),
        F.transform(given, lambda a: F.struct(a.alias("value"), F.lit("literal").alias("kind"), a.alias("label"))).alias("gold_answers"), F.array(given).alias("answer_aliases"),
    )


def record_sink(df: DataFrame, path: str, index: tuple[str, ...] = ("task_id", "index", "round", "role", "reason_code", "program_signature")) -> None:
    """Rows as ``record_json`` beside their index columns (NULL where the rows lack them)."""
    own = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in index]
    df.select(F.to_json(F.struct(*df.columns)).alias("record_json"), *own).write.mode("overwrite").parquet(path)


def read_records(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Records decoded by a schema; only ``record_json`` is read, and a limit comes before decoding."""
    raw = spark.read.parquet(path).select("record_json")
    raw = raw if limit is None else raw.limit(limit)
    return raw.select(F.from_json("record_json", schema).alias("r")).select("r.*")
