"""Programs to lazy DataFrames: Catalyst does the rest.

Entity sets are DataFrames of distinct ``entity_id``; answers are ``kind``, ``value``.  Common subtrees are compiled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions import values
from graphweft.plans import model as M
from graphweft.sources.catalog import GraphCatalog


class Compiler:
    def __init__(self, catalog: GraphCatalog):
        self.catalog = catalog
        self.memo: dict[M.Node, DataFrame] = {}

    # entity sets

    def entities(self, node: M.Node) -> DataFrame:
        """``entity_id`` of the entities a node denotes, each once."""
        if node not in self.memo:
            self.memo[node] = self._entities(node)
        return self.memo[node]

    def _entities(self, node: M.Node) -> DataFrame:
        c = self.catalog
        if isinstance(node, M.Entity):
            return c.spark.createDataFrame([(node.entity_id,)], "entity_id string")
        if isinstance(node, M.AllEntities):
            ids = c.entities.select("entity_id").distinct()
            return ids if node.max_results >= 1_000_000 else ids.orderBy("entity_id").limit(node.max_results)
        if isinstance(node, M.Hop):
            near, far = ("subject", "object") if node.direction == "out" else ("object", "subject")
            edges = c.triples.filter(F.col("relation") == node.relation)
            return self._within(edges, near, node.input).select(F.col(far).alias("entity_id")).distinct()
        if isinstance(node, M.Intersect):
            out = self.entities(node.inputs[0])
            for other in node.inputs[1:]:
                out = out.join(self.entities(other), "entity_id", "left_semi")
            return out
        if isinstance(node, M.Union):
            constants = [n.entity_id for n in node.inputs if isinstance(n, M.Entity)]
            parts = [self.entities(n) for n in node.inputs if not isinstance(n, M.Entity)]
            if constants:
                parts.append(c.spark.createDataFrame([(i,) for i in sorted(set(constants))], "entity_id string"))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out.distinct()
        if isinstance(node, M.FilterType):
            return self._members(node.input, c.entity_types.filter(F.col("type_id") == node.type_id).select("entity_id"))
        if isinstance(node, M.FilterLiteral):
            rows = c.attributes.filter((F.col("key") == node.relation) & values.compare(node.comparator, node.value))
            return self._members(node.input, rows.select("entity_id"))
        if isinstance(node, M.FilterQualifier):
            good = c.qualifiers.filter((F.col("key") == node.qualifier) & values.compare(node.comparator, node.value)).select("fact_id")
            return self.lineage(node.input).join(good, "fact_id", "left_semi").select("entity_id").distinct()
        if isinstance(node, (M.SelectAmong, M.SelectBetween)):
            return self._selected(node).select("entity_id")
        raise TypeError(f"TYPE_MISMATCH: {node.op} gives no entities")

    def _within(self, df: DataFrame, column: str, node: M.Node) -> DataFrame:
        """Rows of ``df`` whose ``column`` is among the node's entities; a single constant becomes a filter, which reaches the
        scan, and all entities no join at all if it can be helped."""
        if isinstance(node, M.Entity):
            return df.filter(F.col(column) == node.entity_id)
        ids = self.entities(node).withColumnRenamed("entity_id", "_id")
        return df.join(ids, df[column] == ids["_id"], "left_semi")

    def _members(self, node: M.Node, found: DataFrame) -> DataFrame:
        return self.entities(node).join(found, "entity_id", "left_semi")

    def lineage(self, node: M.Node) -> DataFrame:
        """``fact_id``, ``entity_id`` of the facts behind a hop or literal filter, for filters on their qualifiers."""
        facts = self.catalog.facts
        if isinstance(node, M.Hop):
            near, far = ("subject", "object_entity") if node.direction == "out" else ("object_entity", "subject")
            rows = facts.filter((F.col("kind") == "relation") & (F.col("predicate") == node.relation))
            return self._within(rows, near, node.input).select("fact_id", F.col(far).alias("entity_id"))
        if isinstance(node, M.FilterLiteral):
            rows = facts.filter((F.col("kind") == "attribute") & (F.col("predicate") == node.relation) & values.compare(node.comparator, node.value))
            return self._within(rows, "subject", node.input).select("fact_id", F.col("subject").alias("entity_id"))
        raise ValueError("a qualifier filter needs a hop or a literal filter below it")

    def _selected(self, node: M.Node) -> DataFrame:
        """The entity with the greatest or least value; among equals, the greatest id for max and the least for min."""
        source = M.Union((node.left, node.right)) if isinstance(node, M.SelectBetween) else node.input
        rows = self._within(self.catalog.attributes.filter(F.col("key") == node.attribute), "entity_id", source)
        key = values.sort_key()
        rows = rows.select("entity_id", F.struct(F.coalesce(key, F.raise_error(F.lit("values of this type cannot be ordered"))).alias("k"), "entity_id").alias("rank"))
        best = F.max_by("entity_id", "rank") if node.mode == "max" else F.min_by("entity_id", "rank")
        return rows.agg(best.alias("entity_id")).filter("entity_id is not null")

    # answers

    def literals(self, node: M.Node) -> DataFrame:
        """The typed values behind a query node: ``value``, ``datatype``, ``unit`` and typed columns."""
        c, typed = self.catalog, ["value", "datatype", "unit", "num", "y", "m", "d"]
        if isinstance(node, M.QueryAttribute):
            return self._within(c.attributes.filter(F.col("key") == node.attribute), "entity_id", node.input).select(*typed)
        if isinstance(node, (M.QueryAttributeUnderCondition, M.QueryAttributeQualifier)):
            facts = c.facts.filter((F.col("kind") == "attribute") & (F.col("predicate") == node.attribute))
            facts = self._within(facts, "subject", node.input)
            q = c.qualifiers.filter(F.col("key") == node.qualifier)
            if isinstance(node, M.QueryAttributeUnderCondition):
                return facts.join(q.filter(values.compare("eq", node.qualifier_value)).select("fact_id"), "fact_id", "left_semi").select(*typed)
            facts = facts.filter(values.compare("eq", node.attribute_value)).select("fact_id")
            return q.join(facts, "fact_id", "left_semi").select(*typed)
        if isinstance(node, M.QueryRelationQualifier):
            facts = c.facts.filter((F.col("kind") == "relation") & (F.col("predicate") == node.relation))
            facts = self._within(self._within(facts, "subject", node.subject), "object_entity", node.object).select("fact_id")
            return c.qualifiers.filter(F.col("key") == node.qualifier).join(facts, "fact_id", "left_semi").select(*typed)
        if isinstance(node, (M.Count, M.Verify, M.QueryRelation)):
            text = self.answers(node).select("value")
        else:
            text = self.entities(node).select(F.col("entity_id").alias("value"))
        return values.typed(text.withColumn("datatype", F.lit("string")).withColumn("unit", F.lit(None).cast("string")))

    def answers(self, node: M.Node) -> DataFrame:
        """``kind`` (entity, literal, count) and ``value`` of a program, each answer once."""
        c = self.catalog
        if isinstance(node, M.Count):
            return self.entities(node.input).agg(F.count("*").cast("string").alias("value")).select(F.lit("count").alias("kind"), "value")
        if isinstance(node, M.Verify):
            truth = self.literals(node.input).select(values.compare(node.comparator, node.value).alias("t")).agg(F.coalesce(F.bool_or("t"), F.lit(False)).alias("t"))
            return truth.select(F.lit("literal").alias("kind"), F.when(F.col("t"), "yes").otherwise("no").alias("value"))
        if isinstance(node, M.QueryRelation):
            rows = self._within(self._within(c.edges, "subject", node.subject), "object", node.object)
            return rows.select(F.lit("literal").alias("kind"), F.col("relation").alias("value")).distinct()
        if isinstance(node, (M.QueryAttribute, M.QueryAttributeUnderCondition, M.QueryAttributeQualifier, M.QueryRelationQualifier)):
            return self.literals(node).select(F.lit("literal").alias("kind"), values.formatted().alias("value")).distinct()
        return self.entities(node).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("value"))


def execute(catalog: GraphCatalog, program: M.Node | str | dict) -> DataFrame:
    """The answers of a program as a lazy DataFrame."""
    return Compiler(catalog).answers(program if isinstance(program, M.Node) else M.parse(program))
