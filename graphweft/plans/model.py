"""The query algebra as frozen, hashable trees, with JSON in and out."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import Any, get_type_hints

COMPARATORS = ("eq", "ne", "lt", "le", "gt", "ge", "contains")
DIRECTIONS = ("out", "in")


@dataclass(frozen=True)
class Literal:
    value: str | int | float
    datatype: str = "string"
    unit: str | None = None

    @staticmethod
    def of(value: Any) -> Literal:
        """A literal, a mapping, or a bare scalar, whose type is then number or string."""
        if isinstance(value, Literal):
            return value
        if isinstance(value, dict):
            return Literal(value["value"], value.get("datatype", "string"), value.get("unit"))
        return Literal(value, "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else "string")


class Node:
    op: str = ""

    def children(self) -> tuple[Node, ...]:
        out: list[Node] = []
        for f in fields(self):
            v = getattr(self, f.name)
            out += [v] if isinstance(v, Node) else [x for x in v if isinstance(x, Node)] if isinstance(v, tuple) else []
        return tuple(out)

    def replace(self, **changes: Any) -> Node:
        return type(self)(**{f.name: changes.get(f.name, getattr(self, f.name)) for f in fields(self)})

    def to_dict(self) -> dict[str, Any]:
        def plain(v: Any) -> Any:
            if isinstance(v, Node):
                return v.to_dict()
            if isinstance(v, Literal):
                return {"value": v.value, "datatype": v.datatype, "unit": v.unit}
            return [plain(x) for x in v] if isinstance(v, tuple) else v

        return {"op": self.op} | {f.name: plain(getattr(self, f.name)) for f in fields(self)}


OPS: dict[str, type[Node]] = {}


def _node(op: str):
    def wrap(cls: type) -> type:
        cls = dataclass(frozen=True)(cls)
        cls.op = op
        OPS[op] = cls
        return cls

    return wrap


@_node("entity")
class Entity(Node):
    entity_id: str


@_node("all_entities")
class AllEntities(Node):
    max_results: int = 1_000_000


@_node("hop")
class Hop(Node):
    input: Node
    relation: str
    direction: str = "out"


@_node("intersect")
class Intersect(Node):
    inputs: tuple[Node, ...]


@_node("union")
class Union(Node):
    inputs: tuple[Node, ...]


@_node("filter_type")
class FilterType(Node):
    input: Node
    type_id: str


@_node("filter_literal")
class FilterLiteral(Node):
    input: Node
    relation: str
    comparator: str
    value: Literal


@_node("filter_qualifier")
class FilterQualifier(Node):
    input: Node
    qualifier: str
    comparator: str
    value: Literal


@_node("count")
class Count(Node):
    input: Node


@_node("query_attribute")
class QueryAttribute(Node):
    input: Node
    attribute: str


@_node("query_attribute_under_condition")
class QueryAttributeUnderCondition(Node):
    input: Node
    attribute: str
    qualifier: str
    qualifier_value: Literal


@_node("query_attribute_qualifier")
class QueryAttributeQualifier(Node):
    input: Node
    attribute: str
    attribute_value: Literal
    qualifier: str


@_node("query_relation")
class QueryRelation(Node):
    subject: Node
    object: Node


@_node("query_relation_qualifier")
class QueryRelationQualifier(Node):
    subject: Node
    object: Node
    relation: str
    qualifier: str


@_node("verify")
class Verify(Node):
    input: Node
    comparator: str
    value: Literal


@_node("select_between")
class SelectBetween(Node):
    left: Node
    right: Node
    attribute: str
    mode: str = "max"


@_node("select_among")
class SelectAmong(Node):
    input: Node
    attribute: str
    mode: str = "max"


def parse(data: str | dict[str, Any]) -> Node:
    """A program from JSON or a mapping; unknown operators, fields and values are refused."""
    if isinstance(data, str):
        data = json.loads(data)
    data = dict(data)
    cls = OPS.get(data.pop("op", None))
    if cls is None:
        raise ValueError("UNKNOWN_OP")
    hints, known = get_type_hints(cls), {f.name for f in fields(cls)}
    if extra := set(data) - known:
        raise ValueError(f"EXTRA_FIELD: {sorted(extra)}")
    values: dict[str, Any] = {}
    for name, v in data.items():
        hint = hints[name]
        if hint is Node:
            v = parse(v)
        elif hint is Literal:
            v = Literal.of(v)
        elif isinstance(v, list):
            v = tuple(parse(x) for x in v)
        values[name] = v
    node = cls(**values)
    if getattr(node, "comparator", "eq") not in COMPARATORS or getattr(node, "direction", "out") not in DIRECTIONS or getattr(node, "mode", "max") not in ("max", "min"):
        raise ValueError("INVALID_SCHEMA")
    if isinstance(node, (Union, Intersect)) and len(node.inputs) < 2:
        raise ValueError("INVALID_SCHEMA")
    return node


def dumps(node: Node) -> str:
    return json.dumps(node.to_dict(), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
