"""Graph primitives below the algebra: neighbourhoods, facts, degrees, resolution, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.functions import values
from graphweft.operators.algebra import Compiler
from graphweft.plans import model as M
from graphweft.session import cut
from graphweft.sources.catalog import GraphCatalog

ORDER = ["subject", "relation", "object"]


def neighbors(catalog: GraphCatalog, ids: DataFrame, direction: str = "out", relations: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Distinct triples at the given entities, the first ``limit`` in order of (subject, relation, object)."""
    triples = catalog.triples if relations is None else catalog.triples.filter(F.col("relation").isin(relations))
    near = {"out": ["subject"], "in": ["object"], "both": ["subject", "object"]}[direction]
    parts = [triples.join(ids.select(F.col("entity_id").alias(c)), c, "left_semi").select(*ORDER) for c in near]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.distinct()
    return out if limit is None else out.orderBy(*ORDER).limit(limit)


def attribute_facts(catalog: GraphCatalog, ids: DataFrame, keys: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """subject, relation, formatted object of attributes, in order."""
    rows = catalog.attributes if keys is None else catalog.attributes.filter(F.col("key").isin(keys))
    out = rows.join(ids, "entity_id", "left_semi").select(F.col("entity_id").alias("subject"), F.col("key").alias("relation"), values.formatted().alias("object")).distinct()
    return out if limit is None else out.orderBy(*ORDER).limit(limit)


def degrees(catalog: GraphCatalog, ids: DataFrame) -> DataFrame:
    """entity_id, degree: in and out edges, 0 for entities without any.  Only edges at the entities are counted, map-side first."""
    at = [catalog.edges.select(F.col(c).alias("entity_id")).join(ids, "entity_id", "left_semi") for c in ("subject", "object")]
    ends = at[0].unionByName(at[1]).groupBy("entity_id").count()
    return ids.join(ends, "entity_id", "left").select("entity_id", F.coalesce("count", F.lit(0)).alias("degree"))


def relation_frontier(catalog: GraphCatalog, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct (relation, direction) leading on from the entities.  Without a limit on edges, only names are made distinct."""
    if limit is not None:
        out = [neighbors(catalog, ids, d, limit=limit).select("relation", F.lit(d).alias("direction")) for d in ("out", "in")]
        return out[0].unionByName(out[1]).distinct()
    at = lambda df, c, d: df.join(ids.select(F.col("entity_id").alias(c)), c, "left_semi").select("relation", F.lit(d).alias("direction")).distinct()
    return at(catalog.triples, "subject", "out").unionByName(at(catalog.triples, "object", "in"))


def resolve(catalog: GraphCatalog, text: str, match: str = "exact", limit: int = 20) -> DataFrame:
    """Entities by id, by label or alias without regard to case, or (``search``) where none is named so, by passages."""
    if match == "search":
        from graphweft.operators import search

        return search.resolve(catalog.entities, catalog.passages, text, limit)
    if match == "id":
        return catalog.entities.filter(F.col("entity_id") == text).select("entity_id", "label")
    low = text.lower()
    hit = (F.lower("label") == low) | F.exists("aliases", lambda a: F.lower(a) == low)
    return catalog.entities.filter(hit).select("entity_id", "label").orderBy("entity_id").limit(limit)


def infos(catalog: GraphCatalog, ids: DataFrame) -> DataFrame:
    """entity_id, label (the id where unknown), type_ids (sorted)."""
    types = catalog.entity_types.join(ids, "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_set("type_id")).alias("type_ids"))
    out = ids.join(catalog.entities.select("entity_id", "label"), "entity_id", "left").join(types, "entity_id", "left")
    return out.select("entity_id", F.coalesce("label", "entity_id").alias("label"), F.coalesce("type_ids", F.array().cast("array<string>")).alias("type_ids"))


def relation_infos(catalog: GraphCatalog, relations: DataFrame) -> DataFrame:
    return relations.join(catalog.relation_labels, "relation_id", "left").select("relation_id", F.coalesce("label", "relation_id").alias("label"))


def evidence(catalog: GraphCatalog, program: M.Node) -> DataFrame:
    """Distinct triples a program rests on: those its hops pass, its filters accept and its queries read."""
    c = Compiler(catalog)
    out = catalog.edges.limit(0).select(*ORDER)

    def visit(node: M.Node) -> None:
        nonlocal out
        for child in node.children():
            visit(child)
        if isinstance(node, M.Hop):
            near = "subject" if node.direction == "out" else "object"
            rows = c._within(catalog.triples.filter(F.col("relation") == node.relation), near, node.input).select(*ORDER)
        elif isinstance(node, M.FilterLiteral):
            own = catalog.attributes.filter((F.col("key") == node.relation) & values.compare(node.comparator, node.value))
            rows = _as_triples(c._within(own, "entity_id", node.input))
        elif isinstance(node, M.FilterType):
            rows = c.entities(node).select(F.col("entity_id").alias("subject"), F.lit("type").alias("relation"), F.lit(node.type_id).alias("object"))
        elif isinstance(node, (M.QueryAttribute, M.QueryAttributeUnderCondition, M.QueryAttributeQualifier, M.SelectAmong)):
            rows = _as_triples(c._within(catalog.attributes.filter(F.col("key") == node.attribute), "entity_id", node.input))
        elif isinstance(node, M.SelectBetween):
            rows = _as_triples(c._within(catalog.attributes.filter(F.col("key") == node.attribute), "entity_id", M.Union((node.left, node.right))))
        elif isinstance(node, (M.QueryRelation, M.QueryRelationQualifier)):
            edges = catalog.edges.filter(F.col("relation") == node.relation) if isinstance(node, M.QueryRelationQualifier) else catalog.edges
            rows = c._within(c._within(edges, "subject", node.subject), "object", node.object).select(*ORDER)
        else:
            return
        out = out.unionByName(rows)

    visit(program)
    return out.distinct()


def _as_triples(attributes: DataFrame) -> DataFrame:
    return attributes.select(F.col("entity_id").alias("subject"), F.col("key").alias("relation"), values.formatted().alias("object"))


def materialize(catalog: GraphCatalog, program: M.Node, max_nodes: int = 10_000, max_edges: int = 50_000, around: bool = False) -> DataFrame:
    """The evidence of a program (and the edges around its entities), cut to the first ``max_edges`` triples in order and to
    those whose ends are among the first ``max_nodes`` nodes; ``truncated`` says whether anything was cut."""
    edges = evidence(catalog, program)
    if around:
        ids = edges.select(F.explode(F.array("subject", "object")).alias("entity_id")).distinct()
        edges = edges.unionByName(neighbors(catalog, ids, "both", limit=None)).distinct()
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    kept = nodes.orderBy("node").limit(max_nodes)
    out = edges.join(kept.withColumnRenamed("node", "subject"), "subject", "left_semi").join(kept.withColumnRenamed("node", "object"), "object", "left_semi")
    sizes = edges.agg(F.count("*").alias("_e")).join(nodes.agg(F.count("*").alias("_n")))
    out = out.select(*ORDER).orderBy(*ORDER).limit(max_edges)
    return out.join(F.broadcast(sizes)).select(*ORDER, ((F.col("_e") > max_edges) | (F.col("_n") > max_nodes)).alias("truncated"))


def seed_context(catalog: GraphCatalog, ids: DataFrame, edges_each: int = 200, relations_each: int = 64, allowed: list[str] | None = None) -> DataFrame:
    """Per entity its label and the relations leading out and in, from its first edges only; of these, the ``allowed`` ones."""
    if allowed is not None:
        some = seed_context(catalog, ids, edges_each, 1 << 30)
        keep = lambda c: F.slice(F.array_intersect(F.col(c), F.array(*map(F.lit, allowed))), 1, relations_each).alias(c)
        return some.select("entity_id", "label", "type_ids", keep("out_relations"), keep("in_relations"))
    ids = cut(ids.select("entity_id").distinct())

    def side(near: str) -> DataFrame:
        rows = catalog.edges.withColumnRenamed(near, "entity_id").join(ids, "entity_id", "left_semi")
        far = "object" if near == "subject" else "subject"
        # The relations among the first edges in order: a relation counts if fewer than ``edges_each`` edges come before its first.
        sizes = rows.select("entity_id", "relation", far).distinct().groupBy("entity_id", "relation").count()
        before = F.coalesce(F.sum("count").over(W.partitionBy("entity_id").orderBy("relation").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        kept = sizes.withColumn("_b", before).filter(F.col("_b") < edges_each)  # a row per entity and relation, no longer per edge
        return kept.groupBy("entity_id").agg(F.slice(F.array_sort(F.collect_set("relation")), 1, relations_each).alias("out_relations" if near == "subject" else "in_relations"))

    none: Column = F.array().cast("array<string>")
    out = infos(catalog, ids).join(side("subject"), "entity_id", "left").join(side("object"), "entity_id", "left")
    return out.select("entity_id", "label", "type_ids", F.coalesce("out_relations", none).alias("out_relations"), F.coalesce("in_relations", none).alias("in_relations"))
