"""Analyses and rewrites of programs; all on the driver, before any DataFrame exists."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Mapping

from graphweft.plans import model as M

# What each operator costs.
COST = {
    "entity": 0.0,
    "all_entities": 0.5,
    "hop": 1.0,
    "filter_type": 0.5,
    "filter_literal": 1.0,
    "filter_qualifier": 1.0,
    "intersect": 1.5,
    "union": 1.5,
    "count": 1.0,
    "query_attribute": 1.0,
    "query_attribute_under_condition": 1.5,
    "query_attribute_qualifier": 1.5,
    "query_relation": 1.0,
    "query_relation_qualifier": 1.5,
    "verify": 0.5,
    "select_among": 1.5,
    "select_between": 1.5,
}
UNSAFE = re.compile(r'[\x00-\x20<>"{}|\\^`\x7f]')
MARK = "# program:"


def walk(node: M.Node):
    yield node
    for child in node.children():
        yield from walk(child)


def cost(node: M.Node) -> float:
    return sum(COST[n.op] for n in walk(node))


def operators(node: M.Node) -> list[str]:
    return sorted({n.op for n in walk(node)})


def topic_roots(node: M.Node) -> list[str]:
    """The entities a program starts from."""
    return sorted({n.entity_id for n in walk(node) if isinstance(n, M.Entity)})


def relations(node: M.Node) -> list[str]:
    """Everything a program names that a relation catalogue must list."""
    names = ("relation", "attribute", "qualifier")
    return sorted({getattr(n, a) for n in walk(node) for a in names if hasattr(n, a)})


def covered(node: M.Node, catalogue: set[str]) -> bool:
    return set(relations(node)) <= catalogue


def canonical(node: M.Node) -> M.Node:
    """Branches of unions and intersections in order; idempotent."""

    def changed(value: object) -> object:
        if isinstance(value, M.Node):
            return canonical(value)
        if isinstance(value, tuple) and value and isinstance(value[0], M.Node):
            return tuple(sorted(map(canonical, value), key=M.dumps))
        return value

    return node.replace(**{name: changed(value) for name, value in node.__dict__.items()})


def renamed(node: M.Node, change: Callable[[str], str]) -> M.Node:
    """A program with its ids (entities, types, relations, attributes, qualifiers) put through ``change``."""
    names = ("entity_id", "type_id", "relation", "attribute", "qualifier")

    def changed(name: str, value: object) -> object:
        if isinstance(value, M.Node):
            return renamed(value, change)
        if isinstance(value, tuple) and value and isinstance(value[0], M.Node):
            return tuple(renamed(v, change) for v in value)
        return change(value) if name in names else value

    return node.replace(**{name: changed(name, value) for name, value in node.__dict__.items()})


def expanded(node: M.Node, prefixes: Mapping[str, str]) -> M.Node:
    """Ids written ``prefix:name`` as whole IRIs; the longest prefix counts, others stay."""
    def full(name: str) -> str:
        for prefix in sorted(prefixes, key=len, reverse=True):
            if name.startswith(f"{prefix}:"):
                return prefixes[prefix] + name[len(prefix) + 1 :]
        return name

    return renamed(node, full)


def compacted(node: M.Node, prefixes: Mapping[str, str]) -> M.Node:
    """The reverse of ``expanded``: the longest IRI counts."""
    def short(name: str) -> str:
        for prefix, iri in sorted(prefixes.items(), key=lambda x: -len(x[1])):
            if name.startswith(iri):
                return f"{prefix}:{name[len(iri) :]}"
        return name

    return renamed(node, short)


def signature(node: M.Node) -> str:
    """One digest for programs that differ only by the order of branches."""
    return hashlib.sha256(M.dumps(canonical(node)).encode()).hexdigest()


def ablations(node: M.Node) -> list[M.Node]:
    """Programs with one condition less: a filter or hop passed over, or one branch of a set operation dropped."""
    out: list[M.Node] = []
    if isinstance(node, (M.FilterType, M.FilterLiteral, M.FilterQualifier, M.Hop)):
        out.append(node.input)
    if isinstance(node, (M.Union, M.Intersect)):
        for k in range(len(node.inputs)):
            rest = node.inputs[:k] + node.inputs[k + 1 :]
            out.append(rest[0] if len(rest) == 1 else node.replace(inputs=rest))
    for name, value in node.__dict__.items():
        if isinstance(value, M.Node):
            out += [node.replace(**{name: x}) for x in ablations(value)]
        elif isinstance(value, tuple) and value and isinstance(value[0], M.Node):
            for k, branch in enumerate(value):
                out += [node.replace(**{name: (*value[:k], x, *value[k + 1 :])}) for x in ablations(branch)]
    return out


def stratum(functions: list[str]) -> str:
    """Length class and functions of a functional query, by which samples are stratified."""
    n = len(functions)
    size = "01-03" if n <= 3 else "04-06" if n <= 6 else "07-10" if n <= 10 else "11+"
    return f"{size}|{'+'.join(sorted(set(functions)))}"


def verbalize(node: M.Node) -> str:
    """A program in words."""
    said = [verbalize(c) for c in node.children()]
    d = {k: v for k, v in node.__dict__.items() if not isinstance(v, (M.Node, tuple))}
    value = lambda v: " ".join(str(x) for x in (v.value, v.unit) if x is not None)
    words = {"eq": "equal to", "ne": "other than", "lt": "below", "le": "at most", "gt": "above", "ge": "at least", "contains": "containing"}
    match node:
        case M.Entity():
            return node.entity_id
        case M.AllEntities():
            return "all entities"
        case M.Hop():
            return f"what {said[0]} leads to by {node.relation}" if node.direction == "out" else f"what leads to {said[0]} by {node.relation}"
        case M.Intersect():
            return "both " + " and ".join(said)
        case M.Union():
            return " or ".join(said)
        case M.FilterType():
            return f"{said[0]} of type {node.type_id}"
        case M.FilterLiteral() | M.FilterQualifier():
            return f"{said[0]} with {d.get('relation', d.get('qualifier'))} {words[node.comparator]} {value(node.value)}"
        case M.Count():
            return f"the number of {said[0]}"
        case M.Verify():
            return f"whether {said[0]} is {words[node.comparator]} {value(node.value)}"
        case M.SelectAmong() | M.SelectBetween():
            return f"the one of {' or '.join(said)} with the {'largest' if node.mode == 'max' else 'smallest'} {node.attribute}"
        case M.QueryRelation():
            return f"the relation from {said[0]} to {said[1]}"
    return f"{json.dumps({k: value(v) if isinstance(v, M.Literal) else v for k, v in d.items()}, sort_keys=True)} of {' and '.join(said)}"


def sparql(node: M.Node) -> str:
    """SPARQL 1.1 text of a program.  Facts with qualifiers are nodes with urn:fact:subject, predicate, object or value, and
    urn:qualifier:<name>.  Ids that cannot stand in an IRI are refused: UNSAFE_IRI."""
    lines: list[str] = []
    fresh = iter(f"?v{i}" for i in range(10_000))

    def iri(name: str) -> str:
        if not name or UNSAFE.search(name):
            raise ValueError(f"UNSAFE_IRI: {name!r}")
        return f"<{name}>"

    def qualifier(name: str) -> str:
        return iri(f"urn:qualifier:{name}")

    def test(x: str, comparator: str, v: M.Literal) -> str:
        sign = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
        return f"CONTAINS(LCASE(STR({x})), LCASE({json.dumps(str(v.value), ensure_ascii=False)}))" if comparator == "contains" else f"{x} {sign[comparator]} {text(v)}"

    def text(v: M.Literal) -> str:
        return str(v.value) if v.datatype in ("quantity", "number", "year") else json.dumps(str(v.value), ensure_ascii=False)

    def emit(n: M.Node, var: str, into: list[str]) -> None:
        match n:
            case M.Entity():
                into.append(f"VALUES {var} {{ {iri(n.entity_id)} }}")
            case M.AllEntities():
                into.append(f"{{ SELECT DISTINCT {var} WHERE {{ {var} ?p{var[1:]} ?o{var[1:]} . }} ORDER BY {var} LIMIT {n.max_results} }}")
            case M.Hop():
                inner = next(fresh)
                emit(n.input, inner, into)
                into.append(f"{inner} {iri(n.relation)} {var} ." if n.direction == "out" else f"{var} {iri(n.relation)} {inner} .")
            case M.Intersect():
                for branch in n.inputs:
                    emit(branch, var, into)
            case M.Union():
                groups = []
                for branch in n.inputs:
                    part: list[str] = []
                    emit(branch, var, part)
                    groups.append("{ " + " ".join(part) + " }")
                into.append(" UNION ".join(groups))
            case M.FilterType():
                emit(n.input, var, into)
                into.append(f"{var} a {iri(n.type_id)} .")
            case M.FilterLiteral():
                emit(n.input, var, into)
                x = next(fresh)
                into.append(f"{var} {iri(n.relation)} {x} . FILTER({test(x, n.comparator, n.value)})")
            case M.FilterQualifier():
                emit(n.input, var, into)
                fact, x = next(fresh), next(fresh)
                place = "<urn:fact:object>" if isinstance(n.input, M.Hop) and n.input.direction == "out" else "<urn:fact:subject>"
                into.append(f"{fact} {place} {var} . {fact} {qualifier(n.qualifier)} {x} . FILTER({test(x, n.comparator, n.value)})")
            case M.SelectAmong() | M.SelectBetween():
                inner: list[str] = []
                source = M.Union((n.left, n.right)) if isinstance(n, M.SelectBetween) else n.input
                emit(source, var, inner)
                x = next(fresh)
                order = "DESC" if n.mode == "max" else "ASC"
                into.append(f"{{ SELECT {var} WHERE {{ {' '.join(inner)} {var} {iri(n.attribute)} {x} . }} ORDER BY {order}({x}) {order}({var}) LIMIT 1 }}")
            case _:
                raise ValueError(f"no SPARQL for {n.op}")

    def value(n: M.Node, var: str) -> None:
        match n:
            case M.QueryAttribute():
                emit(n.input, "?e", lines)
                lines.append(f"?e {iri(n.attribute)} {var} .")
            case M.QueryAttributeUnderCondition():
                emit(n.input, "?e", lines)
                lines.append(f"?f <urn:fact:subject> ?e . ?f <urn:fact:predicate> {iri(n.attribute)} . ?f <urn:fact:value> {var} . ?f {qualifier(n.qualifier)} ?q . FILTER({test('?q', 'eq', n.qualifier_value)})")
            case M.QueryAttributeQualifier():
                emit(n.input, "?e", lines)
                lines.append(f"?f <urn:fact:subject> ?e . ?f <urn:fact:predicate> {iri(n.attribute)} . ?f <urn:fact:value> ?w . FILTER({test('?w', 'eq', n.attribute_value)}) ?f {qualifier(n.qualifier)} {var} .")
            case M.QueryRelation():
                emit(n.subject, "?e", lines)
                emit(n.object, "?o", lines)
                lines.append(f"?e {var} ?o .")
            case M.QueryRelationQualifier():
                emit(n.subject, "?e", lines)
                emit(n.object, "?o", lines)
                lines.append(f"?f <urn:fact:subject> ?e . ?f <urn:fact:predicate> {iri(n.relation)} . ?f <urn:fact:object> ?o . ?f {qualifier(n.qualifier)} {var} .")
            case _:
                emit(n, var, lines)

    if isinstance(node, M.Count):
        emit(node.input, "?x", lines)
        return f"SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE {{ {' '.join(lines)} }}"
    if isinstance(node, M.Verify):
        value(node.input, "?x")
        return f'SELECT (IF(COUNT(?x) > 0, "yes", "no") AS ?v) WHERE {{ {" ".join(lines)} FILTER({test("?x", node.comparator, node.value)}) }}'
    value(node, "?x")
    return f"SELECT DISTINCT ?x WHERE {{ {' '.join(lines)} }}"


def marked(node: M.Node) -> str:
    """SPARQL text that carries its program in a comment, so that an engine of programs can run it."""
    return f"{MARK}{base64.urlsafe_b64encode(M.dumps(node).encode()).decode()}\n{sparql(node)}"


def unmarked(text: str) -> M.Node:
    """The program a marked text carries."""
    first = text.split("\n", 1)[0]
    if not first.startswith(MARK):
        raise ValueError("NO_PROGRAM")
    return M.parse(base64.urlsafe_b64decode(first[len(MARK) :]).decode())
