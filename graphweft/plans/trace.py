"""Programs as calls of a tool and back, steps of a script with what they gave, and random programs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.operators import primitives
from graphweft.operators.algebra import Compiler
from graphweft.plans import compact, rewrite
from graphweft.plans import model as M
from graphweft.sources.catalog import GraphCatalog


@dataclass
class Call:
    """One call of the query tool, and what it gave; ``uses`` are the calls whose results are its entities."""

    query: dict[str, Any]
    answers: tuple[tuple[str, str], ...]
    uses: tuple[int, ...] = ()


@dataclass
class Trace:
    calls: list[Call]
    answers: tuple[tuple[str, str], ...]
    #: How the results of calls give the answers: the number of a call, or ("intersect" or "union", parts).
    result: Any
    reasons: list[str] = field(default_factory=list)


def _run(catalog: GraphCatalog, node: M.Node, most: int) -> tuple[tuple[str, str], ...]:
    rows = Compiler(catalog).answers(node).orderBy("kind", "value").limit(most + 1).collect()  # at most the budget
    return tuple((r.kind, r.value) for r in rows)


def compile_trace(catalog: GraphCatalog, program: M.Node, calls: int = 16, entities: int = 200) -> Trace:
    """A program as calls that a pipeline query can express: chains are one call; where branches meet, each branch is called by
    itself and the results are combined, and what comes after starts from the entities found.

    ``reasons`` says why a program has no trace: TRACE_UNBOUNDED_ALL_ENTITIES, TRACE_EMPTY_INTERMEDIATE,
    TRACE_ENTITY_BUDGET_EXCEEDED, TRACE_ANSWER_BUDGET_EXCEEDED, TRACE_TOOL_BUDGET_EXCEEDED, TRACE_QUERY_MISMATCH (the calls give
    other answers than the program).
    """
    made: list[Call] = []

    def call(node: M.Node, uses: tuple[int, ...], last: bool) -> int:
        if len(made) >= calls:
            raise ValueError("TRACE_TOOL_BUDGET_EXCEEDED")
        answers = _run(catalog, node, entities)
        if not answers and not last:
            raise ValueError("TRACE_EMPTY_INTERMEDIATE")
        if len(answers) > entities:
            raise ValueError("TRACE_ANSWER_BUDGET_EXCEEDED" if last else "TRACE_ENTITY_BUDGET_EXCEEDED")
        made.append(Call(compact.raise_program(node), answers, uses))
        return len(made) - 1

    def values(result: Any) -> list[str]:
        if isinstance(result, int):
            return [v for _, v in made[result].answers]
        parts = [set(values(r)) for r in result[1]]
        return sorted(set.intersection(*parts) if result[0] == "intersect" else set.union(*parts))

    def leaves(result: Any) -> tuple[int, ...]:
        return (result,) if isinstance(result, int) else tuple(k for r in result[1] for k in leaves(r))

    def constants(ids: list[str]) -> M.Node:
        if not ids:
            raise ValueError("TRACE_EMPTY_INTERMEDIATE")
        return M.Entity(ids[0]) if len(ids) == 1 else M.Union(tuple(map(M.Entity, ids)))

    def expressible(node: M.Node) -> bool:
        try:
            compact.lower(compact.raise_program(node))
        except ValueError:
            return False
        return True

    def visit(node: M.Node, last: bool) -> Any:
        if isinstance(node, M.AllEntities):
            raise ValueError("TRACE_UNBOUNDED_ALL_ENTITIES")
        if expressible(node):
            return call(node, (), last)
        if isinstance(node, (M.Intersect, M.Union)):
            return ("intersect" if isinstance(node, M.Intersect) else "union", [visit(n, False) for n in node.inputs])
        known: dict[M.Node, tuple[M.Node, tuple[int, ...]]] = {}
        for child in node.children():  # branches inside become the entities they gave
            if not expressible(child) or isinstance(node, (M.SelectBetween, M.QueryRelation, M.QueryRelationQualifier)):
                got = visit(child, False)
                known[child] = constants(values(got)), leaves(got)
        if isinstance(node, M.SelectBetween):
            both = M.Union((known[node.left][0], known[node.right][0]))
            ids = sorted({n.entity_id for n in rewrite.walk(both) if isinstance(n, M.Entity)})
            return call(M.SelectAmong(constants(ids), node.attribute, node.mode), known[node.left][1] + known[node.right][1], last)
        changed = node.replace(**{name: known[v][0] for name, v in node.__dict__.items() if isinstance(v, M.Node) and v in known})
        if not expressible(changed):
            raise ValueError("TRACE_QUERY_MISMATCH")
        return call(changed, tuple(k for _, uses in known.values() for k in uses), last)

    want = _run(catalog, program, entities)
    try:
        if len(want) > entities:
            raise ValueError("TRACE_ANSWER_BUDGET_EXCEEDED")
        result = visit(program, True)
        got = made[result].answers if isinstance(result, int) else tuple(("entity", v) for v in values(result))
        return Trace(made, got, result, [] if got == want else ["TRACE_QUERY_MISMATCH"])
    except ValueError as problem:
        return Trace(made, want, None, [str(problem).split(":")[0]])


def replay(catalog: GraphCatalog, trace: Trace, limit: int = compact.LIMIT) -> list[str]:
    """Calls a trace again: TRACE_REPLAY_TRUNCATED where a call gives more than ``limit`` answers, TRACE_REPLAY_MISMATCH where it
    gives others than recorded; empty if all is as it was."""
    out: list[str] = []
    for call in trace.calls:
        rows = compact.execute(catalog, call.query, limit).collect()  # at most the limit
        if any(r.truncated for r in rows):
            out.append("TRACE_REPLAY_TRUNCATED")
        elif tuple(sorted((r.kind, r.value) for r in rows)) != call.answers:
            out.append("TRACE_REPLAY_MISMATCH")
    return sorted(set(out))


def preview(df: DataFrame, most: int = 8, preferred: frozenset[str] = frozenset()) -> tuple[tuple[str, ...], int]:
    """The first values of a handle, preferred ones before others, and how many there are."""
    column = next(c for c in ("entity_id", "value", "page_id") if c in df.columns)
    rows = df.select(F.col(column).cast("string").alias("v")).distinct()
    first = rows.orderBy(F.col("v").isin(list(preferred)).cast("int").desc(), "v").limit(most)
    return tuple(r.v for r in first.collect()), rows.count()


def pick(seed: int, *about: object) -> int:
    """A number that hangs on the seed and what it is for; no generator with a state."""
    return int(hashlib.sha256(json.dumps([seed, *map(str, about)]).encode()).hexdigest()[:12], 16)


# The families of random programs, in turn.
FAMILIES = ("hop1", "hop2", "filter_type", "filter_literal", "intersect", "count")


def sample(catalog: GraphCatalog, count: int, seed: int, frontier: int = 100) -> list[tuple[str, M.Node | None, str | None]]:
    """Random programs: family, program, and why there is none (NO_VALID_EXTENSION, EMPTY_PARTIAL_PROGRAM).

    Each program starts from an entity chosen by hash and grows along its neighbours, of which the first ``frontier`` in order
    are looked at; nothing else reaches the driver.
    """
    c = Compiler(catalog)
    ids = catalog.entities.select("entity_id").distinct()

    # Roots and what is around each of them, in one job each: ``count`` roots, ``frontier`` edges of each at most.
    roots = [r.entity_id for r in ids.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "entity_id"), 256), "entity_id").limit(count).collect()]
    near = [catalog.triples.filter(F.col(side).isin(roots)).select(F.col(side).alias("root"), *primitives.ORDER) for side in ("subject", "object")]
    rank = F.row_number().over(W.partitionBy("root").orderBy(*primitives.ORDER))
    around: dict[str, list] = {}
    if roots:
        for t in near[0].unionByName(near[1]).distinct().withColumn("_n", rank).filter(F.col("_n") <= frontier).orderBy("root", "_n").collect():
            around.setdefault(t.root, []).append(t)

    def one_of(rows: list, *about: object) -> Any:
        return rows[pick(seed, *about) % len(rows)] if rows else None

    def first(root: str, k: int) -> M.Node | None:
        t = one_of(around.get(root, []), k, "step", 1)
        return M.Hop(M.Entity(root), t.relation, "out" if t.subject == root else "in") if t else None

    def step(node: M.Node, k: int) -> M.Node | None:
        near = c.entities(node)
        t = one_of(primitives.neighbors(catalog, near, "both", limit=frontier).collect(), k, "step", 2)
        if t is None:
            return None
        return M.Hop(node, t.relation, "in" if near.filter(F.col("entity_id") == t.subject).isEmpty() else "out")

    out: list[tuple[str, M.Node | None, str | None]] = []
    for k in range(count):
        family = FAMILIES[k % len(FAMILIES)]
        root = roots[k % len(roots)] if roots else None
        program: M.Node | None = first(root, k) if root is not None else None
        if family == "hop2" and program is not None:
            program = step(program, k)
        elif family == "filter_type" and program is not None:
            kinds = catalog.entity_types.join(c.entities(program), "entity_id", "left_semi").select("type_id").distinct().orderBy("type_id").limit(frontier).collect()
            kind = one_of(kinds, k, "type")
            program = M.FilterType(program, kind.type_id) if kind else None
        elif family == "filter_literal" and program is not None:
            numbers = primitives.attribute_facts(catalog, c.entities(program), limit=frontier).filter(F.col("object").try_cast("double").isNotNull()).collect()
            fact = one_of(numbers, k, "fact")
            program = M.FilterLiteral(program, fact.relation, "ge", M.Literal(float(fact.object), "number")) if fact else None
        elif family == "intersect" and program is not None:
            # A second way into what the first leads to.
            other = [t for t in primitives.neighbors(catalog, c.entities(program), "in", limit=frontier).collect() if t.subject != root]
            t = one_of(other, k, "other")
            program = M.Intersect((program, M.Hop(M.Entity(t.subject), t.relation))) if t else None
        elif family == "count" and program is not None:
            program = M.Count(program)
        reason = None
        if program is None:
            reason = "NO_VALID_EXTENSION"
        elif c.answers(program).isEmpty():
            program, reason = None, "EMPTY_PARTIAL_PROGRAM"
        out.append((family, program, reason))
    return out


def removed(catalog: GraphCatalog, program: M.Node, triples: DataFrame) -> DataFrame:
    """The answers of a program over the graph without the given edges."""
    return Compiler(catalog.overlay(removed=triples)).answers(program)


class Tools:
    """What a model may call: search (neighbours, or a pipeline query), text_search, inspect_entity, execute_program and
    final_answer.  Each gives plain values, at most ``limit`` of them."""

    # The tools of each role.
    ROLES = {
        "questioner": ("search", "inspect_entity", "execute_program"),
        "solver": ("search", "text_search", "inspect_entity", "final_answer"),
    }

    def __init__(self, catalog: GraphCatalog, role: str = "solver", limit: int = 100):
        self.catalog, self.role, self.limit = catalog, role, limit

    def call(self, name: str, **arguments: Any) -> Any:
        if name not in self.ROLES[self.role]:
            raise ValueError(f"UNKNOWN_TOOL: {name}")
        return getattr(self, f"_{name}")(**arguments)

    def _search(self, entity_id: str | None = None, query: dict[str, Any] | None = None, direction: str = "both") -> list[dict[str, Any]]:
        if (entity_id is None) == (query is None):
            raise ValueError("INVALID_SCHEMA: an entity or a query")
        if query is not None:
            return [r.asDict() for r in compact.execute(self.catalog, query, self.limit).collect()]
        ids = self.catalog.spark.createDataFrame([(entity_id,)], "entity_id string")
        return [r.asDict() for r in primitives.neighbors(self.catalog, ids, direction, limit=self.limit).collect()]

    def _text_search(self, query: str, limit: int = 10, max_chars: int = 4000) -> list[dict[str, Any]]:
        from graphweft.operators import search

        return [r.asDict() for r in search.search(self.catalog.passages, query, min(limit, self.limit), max_chars).collect()]

    def _inspect_entity(self, entity_id: str) -> dict[str, Any]:
        ids = self.catalog.spark.createDataFrame([(entity_id,)], "entity_id string")
        return primitives.infos(self.catalog, ids).first().asDict()

    def _execute_program(self, program: dict[str, Any] | str) -> list[tuple[str, str]]:
        return list(_run(self.catalog, M.parse(program), self.limit)[: self.limit])

    @staticmethod
    def _final_answer(answers: Any, kind: str = "entity") -> list[tuple[str, str]]:
        """Answers of a kind: texts for entities and literals, one whole number for a count."""
        given = answers if isinstance(answers, list) else [answers]
        if kind == "count":
            if len(given) != 1:
                raise ValueError("a count is one number")
            return [("count", str(int(given[0])))]
        return sorted({(kind, str(a)) for a in given})
