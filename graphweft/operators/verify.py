"""Whether a program is a good task: no condition idle, no shorter way, no answer in the question."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.text import normal_words
from graphweft.operators.algebra import Compiler
from graphweft.plans import model as M
from graphweft.plans import rewrite
from graphweft.session import cut
from graphweft.sources.catalog import GraphCatalog


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\x1f", "kind", "value").alias("a"))


def necessity(catalog: GraphCatalog, program: M.Node) -> DataFrame:
    """ablation, similarity (Jaccard of answers with and without the condition), necessity = 1 - similarity; an ablation that
    is no program any more counts as necessary.  One aggregation over all ablations."""
    c = Compiler(catalog)
    gold = _keyed(c.answers(program)).withColumn("g", F.lit(1))
    cut_down = rewrite.ablations(program)
    parts, broken = None, []
    for k, p in enumerate(cut_down):
        try:
            rows = _keyed(c.answers(p)).withColumn("ablation", F.lit(k))
        except (ValueError, TypeError):
            broken.append(k)
            continue
        parts = rows if parts is None else parts.unionByName(rows)
    spark = catalog.spark
    all_of = spark.createDataFrame([(k,) for k in range(len(cut_down))], "ablation int")
    if parts is None:
        return all_of.select("ablation", F.lit(0.0).alias("similarity"), F.lit(1.0).alias("necessity"))
    shared = parts.join(gold, "a", "left").groupBy("ablation").agg(F.count("*").alias("n"), F.sum(F.coalesce("g", F.lit(0))).alias("both"))
    size = gold.agg(F.count("*").alias("size"))
    out = all_of.join(shared, "ablation", "left").join(F.broadcast(size))
    both, n = F.coalesce("both", F.lit(0)), F.coalesce("n", F.lit(0))
    similarity = F.when(F.col("ablation").isin(broken), 0.0).when(n + F.col("size") == 0, 1.0).otherwise(both / (n + F.col("size") - both))
    return out.select("ablation", similarity.alias("similarity")).withColumn("necessity", 1 - F.col("similarity"))


def shortcut(catalog: GraphCatalog, program: M.Node, max_candidates: int = 1000) -> M.Node | None | bool:
    """A cheaper chain of hops from one of the program's entities with the same answers; False if there is none, None if the
    search ended at its budget.

    Breadth first, a level at a time: all paths of a level are one DataFrame of (path, entity), compared with the answers by a
    hash of each path's sorted set; of paths with equal sets only the first goes on.  No path is dropped otherwise: the only
    bound is ``max_candidates``.
    """
    gold = Compiler(catalog).answers(program).filter("kind = 'entity'").select(F.col("value").alias("entity_id"))
    digest = lambda df, by: df.groupBy(*by).agg(F.sha2(F.concat_ws("\x1f", F.array_sort(F.collect_set("entity_id"))), 256).alias("set"))
    target = digest(gold, []).first()["set"]
    most = rewrite.cost(program)
    if max_candidates <= 0:
        return None
    tried = 0
    nodes: dict[int, M.Node] = {k: M.Entity(e) for k, e in enumerate(rewrite.topic_roots(program))}
    if not nodes:
        return False
    roots = [n.entity_id for n in nodes.values()]  # constants reach the scans, what a join does not do
    level = catalog.spark.createDataFrame([(k, n.entity_id) for k, n in nodes.items()], "path int, entity_id string")
    seen: set[str] = set()
    while nodes and rewrite.cost(next(iter(nodes.values()))) + 1 < most:
        steps = []
        for near, far, direction in (("subject", "object", "out"), ("object", "subject", "in")):
            edges = catalog.edges.filter(F.col(near).isin(roots)) if roots else catalog.edges
            rows = edges.join(level.withColumnRenamed("entity_id", near), near)
            steps.append(rows.select("path", F.lit(direction).alias("direction"), "relation", F.col(far).alias("entity_id")))
        grown = cut(steps[0].unionByName(steps[1]).distinct())
        found = digest(grown, ["path", "direction", "relation"]).orderBy("path", "direction", "relation").limit(max_candidates - tried + 1).collect()
        kept: dict[tuple[int, str, str], int] = {}
        following: dict[int, M.Node] = {}
        for r in found:
            if tried >= max_candidates:
                return None
            tried += 1
            node = M.Hop(nodes[r.path], r.relation, r.direction)
            if r.set == target:
                return node
            if r.set not in seen:
                seen.add(r.set)
                kept[r.path, r.direction, r.relation] = len(following)
                following[len(following)] = node
        if not kept:
            return False
        renamed = catalog.spark.createDataFrame([(*key, k) for key, k in kept.items()], "path int, direction string, relation string, next int")
        level = grown.join(F.broadcast(renamed), ["path", "direction", "relation"]).select(F.col("next").alias("path"), "entity_id")
        nodes, roots = following, []
    return False


def leaks(question: Column, label: Column, aliases: Column) -> Column:
    """Whether the label or an alias stands in the question as whole words."""
    text = F.concat(F.lit(" "), normal_words(question), F.lit(" "))
    inside = lambda name: (normal_words(name) != "") & F.contains(text, F.concat(F.lit(" "), normal_words(name), F.lit(" ")))
    return F.coalesce(inside(label), F.lit(False)) | F.exists(F.coalesce(aliases, F.array().cast("array<string>")), inside)


def answer_leak(catalog: GraphCatalog, program: M.Node, question: str) -> bool:
    answers = Compiler(catalog).answers(program)
    named = answers.join(catalog.entities.withColumnRenamed("entity_id", "value"), "value", "left").select(F.coalesce("label", "value").alias("label"), "aliases")
    return not named.filter(leaks(F.lit(question), F.col("label"), F.col("aliases"))).isEmpty()


def certify(catalog: GraphCatalog, program: M.Node, question: str, most_answers: int = 20) -> dict[str, object]:
    """The certificate of a task: answers, signature, cost, necessity, shortcut, leak, and what speaks against it."""
    try:
        answers = [(r.kind, r.value) for r in Compiler(catalog).answers(program).orderBy("kind", "value").limit(most_answers + 1).collect()]
    except (ValueError, TypeError, AnalysisException) as problem:  # a program that cannot run; a lost executor is no verdict
        return {"reasons": ["EXECUTION_ERROR"], "detail": str(problem)[:200]}
    reasons = [] if answers else ["EMPTY_ANSWER"]
    if len(answers) > most_answers:
        reasons.append("INVALID_CARDINALITY")
    needs = [r.necessity for r in necessity(catalog, program).collect()]
    if needs and min(needs) <= 0:
        reasons.append("REDUNDANT_CONDITION")
    shorter: object = False
    leak = False
    if not isinstance(program, M.SelectBetween):
        if isinstance(program, (M.Hop, M.Intersect, M.Union, M.FilterType, M.FilterLiteral, M.FilterQualifier, M.SelectAmong)):
            shorter = shortcut(catalog, program)
            reasons += ["SHORTCUT_FOUND"] if isinstance(shorter, M.Node) else ["SHORTCUT_UNKNOWN"] if shorter is None else []
        leak = answer_leak(catalog, program, question)
        reasons += ["ANSWER_LEAK"] if leak else []
    return {
        "answers": answers, "signature": rewrite.signature(program), "cost": rewrite.cost(program), "operators": rewrite.operators(program),
        "minimum_necessity": min(needs, default=None), "shortcut": M.dumps(shorter) if isinstance(shorter, M.Node) else shorter, "leak": leak, "reasons": reasons,
    }


