"""The handle language: a JSON list of steps, each naming its result once.

Checked on the driver, lowered step by step to lazy DataFrames; the only actions are those that budgets and uniqueness need.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.operators import primitives, search
from graphweft.operators.algebra import Compiler
from graphweft.plans import model as M
from graphweft.sources.catalog import GraphCatalog

MAX_OPS = 64
HANDLE = re.compile(r"h([0-9]|[1-5][0-9]|6[0-3])")
E, P, A = "entity", "passage", "answer"
# Per step its inputs with their kinds, its other fields, the kind it makes, and the versions that have it.
STEPS: dict[str, tuple[dict[str, str], tuple[str, ...], str | None, str]] = {
    "start": ({}, (), E, "0.1 0.2"),
    "all_entities": ({}, ("max_results",), E, "0.2 0.3"),
    "resolve_entity": ({}, ("query", "match", "limit"), E, "0.2 0.3"),
    "search_passage": ({}, ("query", "limit", "max_chars"), P, "0.2"),
    "passage_pages": ({"in": P}, (), E, "0.2"),
    "follow": ({"in": E}, ("relation", "direction", "limit"), E, "0.1 0.2 0.3"),
    "intersect": ({"inputs": E}, (), E, "0.2 0.3"),
    "union": ({"inputs": E}, (), E, "0.2 0.3"),
    "filter_type": ({"in": E}, ("type_id",), E, "0.2 0.3"),
    "filter_literal": ({"in": E}, ("relation", "comparator", "value"), E, "0.2 0.3"),
    "filter_qualifier": ({"in": E}, ("qualifier", "comparator", "value"), E, "0.3"),
    "count": ({"in": E}, (), A, "0.2 0.3"),
    "query_attribute": ({"in": E}, ("attribute",), A, "0.2 0.3"),
    "query_attribute_under_condition": ({"in": E}, ("attribute", "qualifier", "qualifier_value"), A, "0.3"),
    "query_attribute_qualifier": ({"in": E}, ("attribute", "attribute_value", "qualifier"), A, "0.3"),
    "query_relation": ({"subject": E, "object": E}, (), A, "0.2 0.3"),
    "query_relation_qualifier": ({"subject": E, "object": E}, ("relation", "qualifier"), A, "0.3"),
    "verify": ({"in": A}, ("comparator", "value"), A, "0.3"),
    "select_between": ({"left": E, "right": E}, ("attribute", "mode"), E, "0.2 0.3"),
    "select_among": ({"in": E}, ("attribute", "mode"), E, "0.2 0.3"),
    "require_unique": ({"in": E}, (), None, "0.1 0.2"),
    "emit": ({"in": ""}, (), None, "0.1 0.2 0.3"),
}
OPTIONAL = {"max_results", "match", "limit", "max_chars", "mode", "direction"}


class ScriptError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Script:
    version: str
    ops: tuple[dict[str, Any], ...]


def parse(text: str) -> Script:
    """A checked script from text that is exactly one JSON value."""
    try:
        value, end = json.JSONDecoder().raw_decode(text.lstrip())
    except ValueError:
        raise ScriptError("NON_JSON") from None
    if text.lstrip()[end:].strip():
        raise ScriptError("EXTRA_TEXT")
    return check(value)


def check(value: Any) -> Script:
    if not isinstance(value, dict) or not isinstance(value.get("ops"), list):
        raise ScriptError("INVALID_SCHEMA")
    if set(value) - {"version", "ops"}:
        raise ScriptError("EXTRA_FIELD")
    version = value.get("version")
    if version not in ("0.1", "0.2", "0.3"):
        raise ScriptError("UNSUPPORTED_VERSION")
    ops = value["ops"]
    if not 1 <= len(ops) <= MAX_OPS:
        raise ScriptError("LIMIT_EXCEEDED")
    kinds: dict[str, str] = {}
    for k, op in enumerate(ops):
        name = op.get("op") if isinstance(op, dict) else None
        if name not in STEPS:
            raise ScriptError("UNKNOWN_OP", str(name))
        inputs, others, makes, versions = STEPS[name]
        if version not in versions.split():
            raise ScriptError("UNKNOWN_OP", f"{name} is not in {version}")
        allowed = {"op", *inputs, *others} | ({"out"} if makes else set()) | ({"in"} if name == "start" else set())
        if extra := set(op) - allowed:
            raise ScriptError("EXTRA_FIELD", ", ".join(sorted(extra)))
        needed = allowed - OPTIONAL - ({"in"} if name == "start" else set())
        if missing := needed - set(op):
            raise ScriptError("INVALID_SCHEMA", f"{name} lacks {', '.join(sorted(missing))}")
        if op.get("direction", "out") not in M.DIRECTIONS:
            raise ScriptError("INVALID_DIRECTION")
        if op.get("comparator", "eq") not in M.COMPARATORS or op.get("mode", "max") not in ("max", "min"):
            raise ScriptError("INVALID_SCHEMA")
        for bound, most in (("max_results", 1_000_000), ("max_chars", 4000), ("limit", {"resolve_entity": 20, "search_passage": 10}.get(name, 1_000_000))):
            if bound in op and not 1 <= op[bound] <= most:
                raise ScriptError("LIMIT_EXCEEDED", bound)
        for slot, kind in inputs.items():
            given = op[slot] if slot == "inputs" else [op[slot]]
            if slot == "inputs" and (not isinstance(given, list) or len(given) < 2):
                raise ScriptError("INVALID_SCHEMA", "a set operation needs two inputs")
            for h in given:
                if h not in kinds:
                    raise ScriptError("INVALID_SCHEMA", f"{h} is used before it is made")
                if kind and kinds[h] != kind:
                    raise ScriptError("TYPE_MISMATCH", f"{h} is no {kind}")
        if makes:
            out = op["out"]
            if not isinstance(out, str) or not HANDLE.fullmatch(out) or out in kinds:
                raise ScriptError("INVALID_SCHEMA", f"{out} cannot be made here")
            kinds[out] = makes
        if (name == "emit") != (k == len(ops) - 1):
            raise ScriptError("INVALID_SCHEMA", "emit comes once, at the end")
    if version == "0.1" and [o["op"] for o in ops] != ["start", "follow", "follow", "require_unique", "emit"]:
        raise ScriptError("INVALID_SCHEMA", "a 0.1 script follows twice")
    return Script(version, tuple(ops))


@dataclass
class Handle:
    kind: str
    df: DataFrame
    program: M.Node | None = None
    bounded: bool = False


@dataclass(frozen=True)
class Step:
    """A step as it ran: its inputs, what it made, the first of its values in order and how many there are, and what had been
    used by then.  A handle over all entities is deferred: its values are not looked at."""

    index: int
    op: str
    inputs: tuple[str, ...]
    output: str | None
    kind: str | None
    values: tuple[str, ...]
    total: int | None
    usage: dict[str, int]
    relevant: bool = True


@dataclass
class Result:
    answers: DataFrame
    program: M.Node | None
    usage: dict[str, int] = field(default_factory=dict)
    relation_path: tuple[str, ...] = ()
    steps: tuple[Step, ...] = ()


class Executor:
    """Runs scripts over a catalog.  ``follow`` looks at most at its limit of edges in order, and every edge is charged; the
    budgets stop a script with ``BUDGET_EXCEEDED``."""

    def __init__(self, catalog: GraphCatalog, relations: Iterable[str] | None = None, max_edge_visits: int = 1_000_000, max_returned: int = 1000, max_follow: int = 1_000_000):
        self.catalog, self.allowed = catalog, None if relations is None else set(relations)
        self.budget = {"edge_visits": max_edge_visits, "returned_entities": max_returned, "follow_limit": max_follow}

    def _may(self, name: str) -> None:
        if self.allowed is not None and name not in self.allowed:
            raise ScriptError("RELATION_NOT_ALLOWED", name)

    def run(self, script: Script, seed: str | None = None, trace: int | None = None) -> Result:
        """The answers of a script; with ``trace``, also its steps, each with that many values (which costs jobs)."""
        self.compiler = Compiler(self.catalog)
        steps: list[Step] = []
        self.usage = {"edge_visits": 0, "graph_calls": 0, "returned_entities": 0, "passages": 0}
        self.path: list[str] = []
        handles: dict[str, Handle] = {}
        for op in script.ops:
            if op["op"] == "emit":
                h = handles[op["in"]]
                answers = h.df if h.kind == A else h.df.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("value"))
                n = answers.limit(self.budget["returned_entities"] + 1).count()
                if n == 0:
                    raise ScriptError("EMPTY_RESULT")
                if n > self.budget["returned_entities"]:
                    raise ScriptError("BUDGET_EXCEEDED", "returned_entities")
                self.usage["returned_entities"] = n
                return Result(answers, h.program, dict(self.usage), tuple(self.path), _relevant(steps, op["in"]))
            made = self._step(op, handles, seed)
            if made is not None:
                handles[op["out"]] = made
            if trace is not None:
                steps.append(self._traced(len(steps), op, made, trace))
        raise ScriptError("INVALID_SCHEMA")

    def _traced(self, index: int, op: dict[str, Any], made: Handle | None, most: int) -> Step:
        from graphweft.plans import trace

        deferred = made is None or isinstance(made.program, M.AllEntities)
        values, total = ((), None) if deferred else trace.preview(made.df, most)
        return Step(index, op["op"], _inputs(op), op.get("out"), made.kind if made else None, values, total, dict(self.usage))

    def _lazy(self, node: M.Node) -> Handle:
        self.usage["graph_calls"] += 1
        return Handle(E, self.compiler.entities(node), node)

    def _filtered(self, h: Handle, node: M.Node) -> Handle:
        """A filter on a handle: of its program where nothing bounded it, else of its rows."""
        self.usage["graph_calls"] += 1
        df = self.compiler.entities(node)
        return Handle(E, df.join(h.df, "entity_id", "left_semi") if h.bounded else df, node, h.bounded)

    def _step(self, op: dict[str, Any], handles: dict[str, Handle], seed: str | None) -> Handle | None:
        name = op["op"]
        get = lambda slot="in": handles[op[slot]]
        literal = lambda slot="value": M.Literal.of(op[slot])
        match name:
            case "start":
                if seed is None:
                    raise ScriptError("MISSING_SEED")
                return Handle(E, self.compiler.entities(M.Entity(seed)), M.Entity(seed))
            case "all_entities":
                node = M.AllEntities(op.get("max_results", 1_000_000))
                return Handle(E, self.compiler.entities(node), node)
            case "resolve_entity":
                rows = primitives.resolve(self.catalog, op["query"], op.get("match", "exact"), op.get("limit", 20)).select("entity_id")
                ids = [r.entity_id for r in rows.collect()]  # at most 20
                self.usage["graph_calls"] += 1
                if not ids:
                    raise ScriptError("ENTITY_NOT_FOUND", op["query"])
                node = M.Entity(ids[0]) if len(ids) == 1 else M.Union(tuple(map(M.Entity, ids)))
                return Handle(E, self.compiler.entities(node), node)
            case "search_passage":
                df = search.search(self.catalog.passages, op["query"], op.get("limit", 10), op.get("max_chars", 4000))
                n = df.count()
                if n == 0:
                    raise ScriptError("EMPTY_RESULT")
                self.usage["passages"] += n
                return Handle(P, df)
            case "passage_pages":
                ids = sorted({r.page_id for r in get().df.select("page_id").collect()})  # at most as many as a search gives
                node = M.Entity(ids[0]) if len(ids) == 1 else M.Union(tuple(map(M.Entity, ids)))
                return Handle(E, self.compiler.entities(node), node)
            case "follow":
                self._may(op["relation"])
                h, direction = get(), op.get("direction", "out")
                if isinstance(h.program, M.AllEntities):
                    raise ScriptError("TYPE_MISMATCH", "follow on all entities")
                left = self.budget["edge_visits"] - self.usage["edge_visits"]
                limit = min(op.get("limit", 1_000_000), self.budget["follow_limit"], left + 1)
                edges = primitives.neighbors(self.catalog, h.df, direction, [op["relation"]], limit)
                seen = edges.count()
                self.usage["edge_visits"] += seen
                self.usage["graph_calls"] += 1
                if seen > left:
                    raise ScriptError("BUDGET_EXCEEDED", "edge_visits")
                self.path.append(op["relation"])
                far = "object" if direction == "out" else "subject"
                bounded = h.bounded or seen >= limit
                return Handle(E, edges.select(F.col(far).alias("entity_id")).distinct(), h.program and M.Hop(h.program, op["relation"], direction), bounded)
            case "intersect" | "union":
                parts = [handles[i] for i in op["inputs"]]
                if any(isinstance(p.program, M.AllEntities) for p in parts):
                    raise ScriptError("TYPE_MISMATCH", f"{name} on all entities")
                df = parts[0].df
                for p in parts[1:]:
                    df = df.join(p.df, "entity_id", "left_semi") if name == "intersect" else df.unionByName(p.df)
                known = all(p.program is not None for p in parts)
                cls = M.Intersect if name == "intersect" else M.Union
                return Handle(E, df if name == "intersect" else df.distinct(), cls(tuple(p.program for p in parts)) if known else None, any(p.bounded for p in parts))
            case "require_unique":
                n = get().df.limit(2).count()
                if n != 1:
                    raise ScriptError("EMPTY_RESULT" if n == 0 else "NON_UNIQUE_RESULT")
                return None
        h = get() if "in" in op else get("subject") if "subject" in op else get("left")
        if h.program is None:
            raise ScriptError("TYPE_MISMATCH", f"{name} needs a handle with a program")
        match name:
            case "filter_type":
                return self._filtered(h, M.FilterType(h.program, op["type_id"]))
            case "filter_literal":
                self._may(op["relation"])
                return self._filtered(h, M.FilterLiteral(h.program, op["relation"], op["comparator"], literal()))
            case "filter_qualifier":
                self._may(op["qualifier"])
                return self._filtered(h, M.FilterQualifier(h.program, op["qualifier"], op["comparator"], literal()))
            case "count":
                df = h.df.agg(F.count("*").cast("string").alias("value")).select(F.lit("count").alias("kind"), "value")
                return Handle(A, df, M.Count(h.program))
            case "query_attribute":
                self._may(op["attribute"])
                node: M.Node = M.QueryAttribute(h.program, op["attribute"])
            case "query_attribute_under_condition":
                self._may(op["attribute"])
                node = M.QueryAttributeUnderCondition(h.program, op["attribute"], op["qualifier"], literal("qualifier_value"))
            case "query_attribute_qualifier":
                self._may(op["attribute"])
                node = M.QueryAttributeQualifier(h.program, op["attribute"], literal("attribute_value"), op["qualifier"])
            case "query_relation":
                node = M.QueryRelation(h.program, get("object").program)
            case "query_relation_qualifier":
                node = M.QueryRelationQualifier(h.program, get("object").program, op["relation"], op["qualifier"])
            case "verify":
                node = M.Verify(h.program, op["comparator"], literal())
            case "select_between":
                return self._lazy(M.SelectBetween(h.program, get("right").program, op["attribute"], op.get("mode", "max")))
            case "select_among":
                return self._lazy(M.SelectAmong(h.program, op["attribute"], op.get("mode", "max")))
        self.usage["graph_calls"] += 1
        return Handle(A, self.compiler.answers(node), node)


def _inputs(op: dict[str, Any]) -> tuple[str, ...]:
    names, *_ = STEPS[op["op"]]
    return tuple(h for slot in names for h in (op[slot] if slot == "inputs" else [op[slot]]))


def _relevant(steps: list[Step], emitted: str) -> tuple[Step, ...]:
    """The steps, from the last back marked by whether what is emitted rests on them."""
    needed, out = {emitted}, []
    for s in reversed(steps):
        relevant = s.output in needed or (s.output is None and bool(needed & set(s.inputs)))
        needed |= set(s.inputs) if relevant else set()
        out.append(replace(s, relevant=relevant))
    return tuple(out[::-1])


def execute(catalog: GraphCatalog, script: str | dict | Script, seed: str | None = None, **budgets: Any) -> Result:
    checked = script if isinstance(script, Script) else parse(script) if isinstance(script, str) else check(script)
    return Executor(catalog, **budgets).run(checked, seed)


def raise_program(node: M.Node, version: str = "0.3") -> Script:
    """A script for a program: post-order, each distinct subtree once."""
    ops: list[dict[str, Any]] = []
    made: dict[M.Node, str] = {}

    def visit(n: M.Node) -> str:
        if n in made:
            return made[n]
        slots = {"input": "in"}
        fields: dict[str, Any] = {}
        for name, v in n.__dict__.items():
            if isinstance(v, M.Node):
                fields[slots.get(name, name)] = visit(v)
            elif isinstance(v, tuple):
                fields["inputs"] = [visit(x) for x in v]
            elif isinstance(v, M.Literal):
                fields[name] = {"value": v.value, "datatype": v.datatype, "unit": v.unit}
            else:
                fields[name] = v
        if isinstance(n, M.Entity):
            step = {"op": "resolve_entity", "query": n.entity_id, "match": "id"}
        else:
            step = {"op": "follow" if isinstance(n, M.Hop) else n.op, **fields}
        if len(made) >= MAX_OPS:
            raise ScriptError("LIMIT_EXCEEDED")
        made[n] = f"h{len(made)}"
        ops.append(step | {"out": made[n]})
        return made[n]

    last = visit(node)
    return check({"version": version, "ops": [*ops, {"op": "emit", "in": last}]})
