"""Datasets for training from certified tasks: role rows, messages, seeds, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.operators import primitives
from graphweft.operators.sampling import priority
from graphweft.session import cut
from graphweft.sources.catalog import GraphCatalog

TURN = "struct<role: string, content: string>"


def relation_catalog(dependencies: DataFrame, labels: DataFrame) -> DataFrame:
    """relation_id, label, tasks: the relations that tasks name (task_id, relations), each with how many do; the id stands in for
    an unknown label."""
    named = dependencies.select("task_id", F.explode(F.array_distinct("relations")).alias("relation_id")).filter("relation_id <> ''")
    used = named.groupBy("relation_id").agg(F.count_distinct("task_id").alias("tasks"))
    return used.join(labels.groupBy("relation_id").agg(F.min("label").alias("label")), "relation_id", "left").select("relation_id", F.coalesce("label", "relation_id").alias("label"), "tasks")


def graph_relations(catalog: GraphCatalog) -> DataFrame:
    """relation_id, label of every relation, attribute and qualifier of a graph."""
    parts = [catalog.edges.select(F.col("relation").alias("relation_id")), catalog.attributes.select(F.col("key").alias("relation_id")), catalog.qualifiers.select(F.col("key").alias("relation_id"))]
    return primitives.relation_infos(catalog, parts[0].distinct().unionByName(parts[1].distinct()).unionByName(parts[2].distinct()).distinct())


def load_relations(rows: DataFrame) -> DataFrame:
    """relation_id, label in order; an id given twice is refused."""
    twice = rows.groupBy("relation_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"DUPLICATE_RELATION: {twice[0].relation_id}")
    return rows.select("relation_id", "label").orderBy("relation_id")


def references(entities: DataFrame) -> DataFrame:
    """entity_id, reference: the label where it names this entity alone, whatever its case, else the id."""
    names = entities.select("entity_id", "label", F.lower("label").alias("_l"))
    alone = names.filter("_l is not null").groupBy("_l").agg(F.count_distinct("entity_id").alias("_n"))
    out = names.join(alone, "_l", "left")
    return out.select("entity_id", F.when(F.col("_n") == 1, F.col("label")).otherwise(F.col("entity_id")).alias("reference"))


def turns(*said: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.cast("string").alias("content")) for role, content in said))


def solver_messages(tasks: DataFrame, system: str) -> DataFrame:
    """Adds ``messages``: the instruction, the question, the script (where there is one) and the answers in their tag."""
    answer = F.concat(F.lit("<answer>"), F.to_json("answers"), F.lit("</answer>"))
    script = F.when(F.col("script").isNotNull(), turns(("assistant", F.concat(F.lit("<script>"), F.col("script"), F.lit("</script>"))))).otherwise(F.array().cast(f"array<{TURN}>"))
    return tasks.withColumn("messages", F.concat(turns(("system", F.lit(system)), ("user", F.col("question"))), script, turns(("assistant", answer))))


def questioner_messages(tasks: DataFrame, system: str) -> DataFrame:
    """Adds ``messages``: the instruction, the seed, and the question with its script as one JSON object."""
    made = F.to_json(F.struct("question", F.col("script").alias("program")))
    return tasks.withColumn("messages", turns(("system", F.lit(system)), ("user", F.col("seed")), ("assistant", made)))


def seed_payload(contexts: DataFrame, catalogue: Column | None = None) -> DataFrame:
    """entity_id, seed: what is known about a starting entity as JSON text (label, types, relations out and in), the relations
    limited to ``catalogue`` where one is given."""
    allowed = lambda c: F.col(c) if catalogue is None else F.array_intersect(F.col(c), catalogue)
    shown = F.struct("entity_id", "label", "type_ids", allowed("out_relations").alias("out_relations"), allowed("in_relations").alias("in_relations"))
    return contexts.select("entity_id", F.to_json(shown).alias("seed"))


def catalog_text(relations: DataFrame, most: int = 2000) -> DataFrame:
    """One row, ``text``: a line per relation (id, label) in order, the first ``most`` of them."""
    return relations.orderBy("relation_id").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relation_id", "label"))), lambda r: F.concat_ws("\t", r["relation_id"], r["label"])), "\n").alias("text"))


def role_rows(tasks: DataFrame, catalogs: DataFrame) -> DataFrame:
    """A row per role of a task: task_id, role, prompt, snapshot, relations.

    A task asks for a solver row if it has a question, for a questioner row if it has a seed.  ``tasks``: task_id, snapshot,
    question, seed, relations; ``catalogs``: snapshot, relation_id.  A task that names a relation its snapshot's catalogue
    lacks is refused: MISSING_RELATION.
    """
    known = catalogs.groupBy("snapshot").agg(F.collect_set("relation_id").alias("_known"))  # a row per snapshot
    rows = tasks.join(F.broadcast(known), "snapshot", "left")
    lacking = F.array_except(F.coalesce("relations", F.array().cast("array<string>")), F.coalesce("_known", F.array().cast("array<string>")))
    checked = F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("MISSING_RELATION: "), F.col("task_id"), F.lit(" "), F.array_join(lacking, ",")))).otherwise(F.col("relations"))
    roles = F.array_compact(F.array(
        F.when(F.col("seed").isNotNull(), F.struct(F.lit("questioner").alias("role"), F.col("seed").alias("prompt"))), F.when(F.col("question").isNotNull(), F.struct(F.lit("solver").alias("role"), F.col("question").alias("prompt"))),
    ))
    return rows.select("task_id", "snapshot", checked.alias("relations"), F.explode(roles).alias("r")).select("task_id", "r.role", "r.prompt", "snapshot", "relations")


def questioner_sample(tasks: DataFrame, count: int, seed: int, system: str) -> DataFrame:
    """Questioner messages of ``count`` tasks with a seed, drawn without replacement."""
    rows = tasks.filter("seed is not null and question is not null")
    return questioner_messages(rows.orderBy(priority(seed, F.col("task_id")), "task_id").limit(count), system)


def graph_seeds(catalog: GraphCatalog, count: int, seed: int, least: int = 1, most: int = 1000, denied: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """entity_id, degree: ``count`` entities whose number of edges lies between ``least`` and ``most``, none of them denied, all
    with ids of the prefix, by hash priority."""
    ids = catalog.entities.select("entity_id").distinct()
    if prefix:
        ids = ids.filter(F.col("entity_id").startswith(prefix))
    if denied is not None:
        ids = ids.join(denied.select("entity_id").distinct(), "entity_id", "left_anti")
    fit = primitives.degrees(catalog, ids).filter(F.col("degree").between(least, most))
    return fit.orderBy(priority(seed, F.col("entity_id")), "entity_id").limit(count)


def task_seeds(tasks: DataFrame, per_stratum: int, seed: int) -> DataFrame:
    """task_id, entity_id, stratum: starting entities of tasks (topics, stratum), at most ``per_stratum`` tasks of each, the first
    topic of each."""
    first = tasks.filter(F.size("topics") > 0).select("task_id", F.element_at("topics", 1).alias("entity_id"), "stratum").dropDuplicates(["task_id"])
    rank = F.row_number().over(W.partitionBy("stratum").orderBy(priority(seed, F.col("task_id")), "task_id"))
    return first.withColumn("_r", rank).filter(F.col("_r") <= per_stratum).drop("_r")


def round_rows(parts: list[DataFrame], observed: DataFrame, round_number: int) -> DataFrame:
    """The rows of a round from parts of differing schemas: ``extra_info`` (a struct with ``relations``) is completed by the round,
    its relations cut to those observed for the task (task_id, relations); columns a part lacks are NULL."""
    out = None
    for part in parts:
        joined = part.join(observed.select("task_id", F.col("relations").alias("_seen")), "task_id", "left")
        local = F.when(F.col("_seen").isNull(), F.col("extra_info.relations")).otherwise(F.array_intersect(F.col("extra_info.relations"), F.col("_seen")))
        rows = joined.withColumn("extra_info", F.col("extra_info").withField("relations", local).withField("round", F.lit(round_number))).drop("_seen")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("a round needs a part")
    return out


def record_messages(messages: Column) -> Column:
    """Messages as a trainer reads them: the roles function and observation become tool, NULL contents empty, tool calls JSON
    text (NULL without any)."""
    role = lambda m: F.when(m["role"].isin("function", "observation"), "tool").otherwise(m["role"])
    calls = lambda m: F.when(F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0, F.to_json(m["tool_calls"]))
    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), calls(m).alias("tool_calls")))


def check_schema(df: DataFrame, needed: dict[str, str]) -> list[str]:
    """What is wrong with the columns of a dataset: those it lacks and those of another type, sorted."""
    have = dict(df.dtypes)
    return sorted([f"MISSING {c}" for c in needed if c not in have] + [f"TYPE {c}: {have[c]}" for c, t in needed.items() if c in have and have[c] != t])


def candidates(catalog: GraphCatalog, seeds: DataFrame, relation: str, types: bool = True) -> DataFrame:
    """Tasks about seeds (entity_id) by family: ``hop1`` (one step along the relation), ``hop2`` (two), ``count`` (how many one
    step leads to) and ``type_filter`` (one step, of one type).  family, entity_id, type_id, answers (sorted), size; families without
    answers have no row."""
    ids = cut(seeds.select("entity_id").distinct())
    edges = catalog.edges.filter(F.col("relation") == relation).select("subject", "object")
    one = cut(edges.join(ids.withColumnRenamed("entity_id", "subject"), "subject", "left_semi").distinct())
    two = one.select("subject", F.col("object").alias("_via")).join(edges.select(F.col("subject").alias("_via"), "object"), "_via").select("subject", "object").distinct()
    null = F.lit(None).cast("string")
    rows = one.select(F.lit("hop1").alias("family"), "subject", null.alias("type_id"), "object").unionByName(two.select(F.lit("hop2").alias("family"), "subject", null.alias("type_id"), "object"))
    if types:
        kinds = catalog.entity_types.select(F.col("entity_id").alias("object"), "type_id").distinct()
        rows = rows.unionByName(one.join(kinds, "object").select(F.lit("type_filter").alias("family"), "subject", "type_id", "object"))
    out = rows.groupBy("family", F.col("subject").alias("entity_id"), "type_id").agg(F.array_sort(F.collect_set("object")).alias("answers")).withColumn("size", F.size("answers"))
    counts = out.filter("family = 'hop1'").select(F.lit("count").alias("family"), "entity_id", "type_id", F.array(F.col("size").cast("string")).alias("answers"), F.lit(1).alias("size"))
    return out.unionByName(counts)
