"""The pipeline surface: a root and up to 32 steps, lowered to a program."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.operators.algebra import Compiler
from graphweft.plans import model as M
from graphweft.sources.catalog import GraphCatalog

STEPS, IDS, TYPES, LIMIT = 32, 4096, 32, 200
LAST = ("query_attribute", "query_attribute_under_condition", "query_attribute_qualifier", "query_relation", "query_relation_qualifier", "select_attribute", "verify")


def _entities(ids: list[str]) -> M.Node:
    ids = sorted(set(ids))
    if not 1 <= len(ids) <= IDS:
        raise ValueError("INVALID_SCHEMA: entities")
    return M.Entity(ids[0]) if len(ids) == 1 else M.Union(tuple(map(M.Entity, ids)))


def lower(query: dict[str, Any]) -> M.Node:
    """The program of ``{"root": {"entities": [...]} | {"all_entities": n}, "steps": [...], "return_count": bool}``."""
    root, steps = query["root"], list(query.get("steps", []))
    if len(steps) > STEPS:
        raise ValueError("LIMIT_EXCEEDED: steps")
    if "all_entities" in root:
        if not steps:
            raise ValueError("INVALID_SCHEMA: a global root needs a step")
        node: M.Node = M.AllEntities(int(root["all_entities"]))
    else:
        node = _entities(root["entities"])
    for k, step in enumerate(steps):
        op, last = step["op"], k == len(steps) - 1
        if op in LAST and not last and not (k == len(steps) - 2 and steps[-1]["op"] == "verify" and op.startswith("query_")):
            raise ValueError(f"INVALID_SCHEMA: {op} ends a query")
        if op == "verify" and (k == 0 or not steps[k - 1]["op"].startswith("query_")):
            raise ValueError("INVALID_SCHEMA: verify follows one literal query")
        node = _step(node, op, step)
    if query.get("return_count"):
        if steps and steps[-1]["op"] in LAST:
            raise ValueError("INVALID_SCHEMA: return_count")
        node = M.Count(node)
    return node


def _step(node: M.Node, op: str, s: dict[str, Any]) -> M.Node:
    literal = lambda k: M.Literal.of(s[k])
    match op:
        case "hop":
            return M.Hop(node, s["relation"], s.get("direction", "out"))
        case "filter_type":
            kinds = s["type_ids"]
            if not 1 <= len(kinds) <= TYPES:
                raise ValueError("INVALID_SCHEMA: type_ids")
            parts = tuple(M.FilterType(node, t) for t in sorted(set(kinds)))
            return parts[0] if len(parts) == 1 else M.Union(parts)
        case "filter_literal":
            return M.FilterLiteral(node, s["relation"], s["comparator"], literal("value"))
        case "filter_qualifier":
            return M.FilterQualifier(node, s["qualifier"], s["comparator"], literal("value"))
        case "query_attribute":
            return M.QueryAttribute(node, s["attribute"])
        case "query_attribute_under_condition":
            return M.QueryAttributeUnderCondition(node, s["attribute"], s["qualifier"], literal("qualifier_value"))
        case "query_attribute_qualifier":
            return M.QueryAttributeQualifier(node, s["attribute"], literal("attribute_value"), s["qualifier"])
        case "query_relation":
            return M.QueryRelation(node, _entities(s["object_ids"]))
        case "query_relation_qualifier":
            return M.QueryRelationQualifier(node, _entities(s["object_ids"]), s["relation"], s["qualifier"])
        case "verify":
            return M.Verify(node, s["comparator"], literal("value"))
        case "select_attribute":
            return M.SelectAmong(node, s["attribute"], s.get("mode", "max"))
    raise ValueError(f"UNKNOWN_OP: {op}")


def execute(catalog: GraphCatalog, query: dict[str, Any], limit: int = LIMIT) -> DataFrame:
    """``kind``, ``value``, ``total``, ``truncated``: the first answers in order, and how many there are."""
    answers = Compiler(catalog).answers(lower(query))
    total = answers.agg(F.count("*").alias("total"))
    return answers.orderBy("kind", "value").limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def raise_program(node: M.Node) -> dict[str, Any]:
    """The pipeline of a program, where it is one: chains collapse, unions of constants are a root, unions of type filters
    over one input are one step."""
    steps: list[dict[str, Any]] = []
    out: dict[str, Any] = {}
    if isinstance(node, M.Count):
        out["return_count"], node = True, node.input
    plain = lambda v: {"value": v.value, "datatype": v.datatype, "unit": v.unit}
    while True:
        if isinstance(node, M.Entity):
            return {"root": {"entities": [node.entity_id]}, "steps": steps[::-1], **out}
        if isinstance(node, M.AllEntities):
            return {"root": {"all_entities": node.max_results}, "steps": steps[::-1], **out}
        if isinstance(node, M.Union):
            if all(isinstance(n, M.Entity) for n in node.inputs):
                return {"root": {"entities": sorted({n.entity_id for n in node.inputs})}, "steps": steps[::-1], **out}
            if all(isinstance(n, M.FilterType) for n in node.inputs) and len({n.input for n in node.inputs}) == 1:
                steps.append({"op": "filter_type", "type_ids": sorted({n.type_id for n in node.inputs})})
                node = node.inputs[0].input
                continue
            raise ValueError("TRACE_QUERY_MISMATCH: no pipeline")
        fields = {k: plain(v) if isinstance(v, M.Literal) else v for k, v in node.__dict__.items() if not isinstance(v, M.Node)}
        match node:
            case M.FilterType():
                steps.append({"op": "filter_type", "type_ids": [node.type_id]})
            case M.SelectAmong():
                steps.append({"op": "select_attribute", **fields})
            case M.QueryRelation() | M.QueryRelationQualifier():
                objects = node.object.inputs if isinstance(node.object, M.Union) else (node.object,)
                if not all(isinstance(o, M.Entity) for o in objects):
                    raise ValueError("TRACE_QUERY_MISMATCH: no pipeline")
                steps.append({"op": node.op, "object_ids": [o.entity_id for o in objects], **fields})
                node = node.subject
                continue
            case M.Intersect() | M.SelectBetween():
                raise ValueError("TRACE_QUERY_MISMATCH: no pipeline")
            case _:
                steps.append({"op": node.op, **fields})
        node = node.input
