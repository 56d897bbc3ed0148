"""Question-answering benchmarks as examples: example_id, dataset, split, question, topic_entity_ids, gold_answers
(value, kind, label), answer_aliases.

Files are JSON arrays, objects that hold one, or JSON lines; each is read whole, as benchmark files are small.  Field names
differ between releases: the first that is there counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.text import mids

ANSWER = "array<struct<value string, kind string, label string>>"
# Where question sets of one file come from, and how many examples the fixed release has of each.
BUCKETS = {
    "nq": 500,
    "triviaqa": 500,
    "popqa": 500,
    "hotpotqa": 500,
    "2wikimultihopqa": 500,
    "bamboogle": 125,
    "musique": 500,
}


def split_of(file_name: Column) -> Column:
    """The split a file's name says: train, dev (val too), test, else unknown."""
    low = F.lower(file_name)
    return F.when(low.contains("train"), "train").when(low.contains("dev") | low.contains("val"), "dev").when(low.contains("test"), "test").otherwise("unknown")


def records(spark: SparkSession, path: str, *holders: str) -> DataFrame:
    """``v``, ``file``, ``split``, ``index``: the records of a file or of all files below a folder (*.json, *.jsonl), with their
    place in their file.  ``holders`` are the fields under which an object may hold the array."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    by_line = raw.filter(F.col("file").endswith(".jsonl")).select("file", F.posexplode(lines).alias("index", "line")).select("file", "index", F.parse_json("line").alias("v"))
    whole = raw.filter(~F.col("file").endswith(".jsonl")).select("file", F.parse_json("value").alias("v"))
    held = F.coalesce(*(F.try_variant_get("v", f"$.{h}", "array<variant>") for h in holders), F.try_variant_get("v", "$", "array<variant>"))
    out = whole.select("file", F.posexplode(held).alias("index", "v")).unionByName(by_line)
    return out.select("v", "file", split_of(F.col("file")).alias("split"), "index")


def _first(v: str, kind: str, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"$.{p}", kind) for p in paths))


def _given(texts: Column) -> Column:
    """Texts trimmed of blanks, each once, in order; none that are empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))


def _literals(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("value"), F.lit("literal").alias("kind"), t.alias("label")))


def _answers(v: str, *paths: str) -> Column:
    """Answers in any of their forms: objects with an id and a name, or texts; machine ids are entities, all else literals."""
    objects = _first(v, "array<variant>", *paths)
    get = lambda x, *names: F.coalesce(*(F.try_variant_get(x, f"$.{n}", "string") for n in names))
    one = lambda x: F.coalesce(get(x, "answer_id", "answer_argument", "AnswerArgument", "kb_id", "answer"), F.try_variant_get(x, "$", "string"))
    name = lambda x: get(x, "entity_name", "EntityName", "text", "answer")
    entity = lambda x: one(x).rlike(r"^[mg]\.[0-9a-z_]+$") | F.coalesce(get(x, "answer_type"), F.lit("")).eqNullSafe("Entity")
    made = F.transform(objects, lambda x: F.struct(one(x).alias("value"), F.when(entity(x), "entity").otherwise("literal").alias("kind"), name(x).alias("label")))
    single = F.when(objects.isNull() & _first(v, "string", *paths).isNotNull(), _literals(F.array(_first(v, "string", *paths))))
    return F.coalesce(F.array_distinct(F.filter(made, lambda a: a["value"].isNotNull())), single, F.array().cast(ANSWER))


def _examples(rows: DataFrame, dataset: Column, example_id: Column, question: Column, topics: Column, answers: Column, aliases: Column | None = None) -> DataFrame:
    none = F.array().cast("array<array<string>>")
    return rows.select(
        F.coalesce(example_id, F.col("index").cast("string")).alias("example_id"), dataset.alias("dataset"), F.coalesce(_first("v", "string", "split"), F.col("split")).alias("split"), F.coalesce(question, F.lit("")).alias("question"),
        F.array_distinct(F.filter(F.coalesce(topics, F.array().cast("array<string>")), lambda t: t.isNotNull())).alias("topic_entity_ids"), answers.cast(ANSWER).alias("gold_answers"), (none if aliases is None else aliases).alias("answer_aliases"),
    )


def cwq(spark: SparkSession, path: str) -> DataFrame:
    """Complex web questions: topics as given, else the machine ids of the query."""
    rows = records(spark, path, "questions")
    topics = F.coalesce(F.try_variant_get("v", "$.topic_entities", "array<string>"), mids(_first("v", "string", "sparql", "SPARQL")))
    return _examples(rows, F.lit("cwq"), _first("v", "string", "ID", "id"), _first("v", "string", "question", "machine_question"), topics, _answers("v", "answers", "answer"))


def grailqa(spark: SparkSession, path: str) -> DataFrame:
    """Questions over a graph query: topics are its entity nodes that are not asked for."""
    rows = records(spark, path, "questions")
    nodes = F.coalesce(F.try_variant_get("v", "$.graph_query.nodes", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda x, name, kind="string": F.try_variant_get(x, f"$.{name}", kind)
    asked = lambda x: F.coalesce(get(x, "question_node", "boolean"), get(x, "question_node", "int") > 0, F.lit(False))
    topics = F.transform(F.filter(nodes, lambda x: (get(x, "node_type") == "entity") & ~asked(x)), lambda x: get(x, "id"))
    return _examples(rows, F.lit("grailqa"), _first("v", "string", "qid", "id"), _first("v", "string", "question"), topics, _answers("v", "answer", "answers"))


def open_qa(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Open questions in any of three forms: ``input`` with ``output`` (answers and provenance), an ``Answer`` object with aliases,
    or ``question`` with ``answers``.  All answers of an example are one group of aliases; without any it is left out."""
    rows = records(spark, path, "Data", "data", "questions")
    output = F.try_variant_get("v", "$.output", "array<variant>")
    input_ = _first("v", "string", "input")
    by_output = F.transform(output, lambda o: F.try_variant_get(o, "$.answer", "string"))
    pages = F.flatten(F.transform(output, lambda o: F.transform(F.coalesce(F.try_variant_get(o, "$.provenance", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, "$.wikipedia_id", "string"))))
    official = F.coalesce(*(F.when(F.size(F.try_variant_get("v", f"$.Answer.{a}", "array<string>")) > 0, F.try_variant_get("v", f"$.Answer.{a}", "array<string>")) for a in ("Aliases", "NormalizedAliases")), F.when(_first("v", "string", "Answer.Value").isNotNull(), F.array(_first("v", "string", "Answer.Value"))))
    plain = F.coalesce(_first("v", "array<string>", "answers", "answer"), F.when(_first("v", "string", "answers", "answer").isNotNull(), F.array(_first("v", "string", "answers", "answer"))))
    kilt = input_.isNotNull() & output.isNotNull()
    given = _given(F.when(kilt, by_output).otherwise(F.coalesce(official, plain)))
    topics = F.when(kilt, pages).otherwise(F.try_variant_get("v", "$.topic_entity_ids", "array<string>"))
    out = _examples(rows, F.lit(dataset), _first("v", "string", "id", "_id", "QuestionId"), F.coalesce(input_, _first("v", "string", "question", "Question")), topics, _literals(given), F.array(given))
    return out.filter(F.size("gold_answers") > 0)


def buckets(spark: SparkSession, path: str, include: list[str] | None = None, fixed: bool = False) -> DataFrame:
    """Examples of a file that holds several question sets, told by ``data_source`` (the known name in it); others are left out.
    With ``fixed``, each bucket must have just the number of examples of the fixed release, else COUNT_MISMATCH."""
    wanted = list(BUCKETS) if include is None else include
    rows = records(spark, path)
    source = _first("v", "string", "data_source")
    last = F.element_at(F.split(F.lower(source), "[/_ ]"), -1)
    rows = rows.withColumn("_dataset", last).filter(F.col("_dataset").isin(wanted))
    given = _given(F.coalesce(F.try_variant_get("v", "$.reward_model.ground_truth.target", "array<string>"), F.when(_first("v", "string", "reward_model.ground_truth.target").isNotNull(), F.array(_first("v", "string", "reward_model.ground_truth.target")))))
    split = F.coalesce(_first("v", "string", "extra_info.split"), F.when(F.col("split") == "unknown", "test").otherwise(F.col("split")))
    example_id = F.concat_ws(":", F.lit("ssp"), source, F.coalesce(_first("v", "string", "extra_info.index"), F.col("index").cast("string")))
    out = _examples(rows.withColumn("split", split), F.col("_dataset"), example_id, _first("v", "string", "extra_info.question"), F.array().cast("array<string>"), _literals(given), F.array(given))
    if fixed:
        counts = {r.dataset: r["count"] for r in out.groupBy("dataset").count().collect()}  # a row per bucket
        wrong = {d: counts.get(d, 0) for d in wanted if counts.get(d, 0) != BUCKETS[d]}
        if wrong:
            raise ValueError(f"COUNT_MISMATCH: {wrong}")
    return out
