"""The engine on the example graph: exact answers, three surfaces that agree, random programs against plain sets."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphweft.functions import text, values
from graphweft.operators import archive, metrics, primitives, sampling, search, verify
from graphweft.operators.algebra import Compiler, execute
from graphweft.plans import compact, kopl, rewrite, script
from graphweft.plans import model as M
from graphweft.plans.model import AllEntities, Count, Entity, FilterLiteral, FilterType, Hop, Intersect, Literal, QueryAttribute, QueryRelation, SelectAmong, SelectBetween, Union, Verify
from graphweft.sources import catalog as C
from graphweft.sources import knowledge


@pytest.fixture(scope="module")
def toy(spark):
    return C.toy(spark)


def answers(toy, program):
    return sorted(r.value for r in execute(toy, program).collect())


PERSONS = FilterType(AllEntities(), "person")
PROGRAMS = [
    (Hop(Hop(Entity("alice"), "works_at"), "located_in"), ["paris"]),
    (QueryAttribute(Entity("alice"), "age"), ["34"]),
    (QueryRelation(Entity("alice"), Entity("acme")), ["works_at"]),
    (SelectBetween(Entity("alice"), Entity("bob"), "age", "max"), ["alice"]),
    (SelectAmong(PERSONS, "age", "min"), ["bob"]),
    (Count(PERSONS), ["3"]),
    (Hop(Entity("acme"), "works_at", "in"), ["alice", "bob"]),
    (Intersect((Hop(Entity("acme"), "works_at", "in"), PERSONS)), ["alice", "bob"]),
    (Union((Entity("alice"), Entity("alice"), Hop(Entity("bob"), "friend"))), ["alice", "cara"]),
    (FilterLiteral(PERSONS, "age", "ge", Literal(34)), ["alice", "cara"]),
    (FilterLiteral(PERSONS, "age", "contains", Literal("4")), ["alice", "cara"]),
    (Verify(QueryAttribute(Entity("bob"), "age"), "lt", Literal(30)), ["yes"]),
    (Verify(QueryAttribute(Entity("paris"), "age"), "lt", Literal(30)), ["no"]),
    (Hop(Entity("alice"), "age"), ["34"]),
    (AllEntities(2), ["acme", "alice"]),
]


@pytest.mark.parametrize("program,want", PROGRAMS)
def test_programs_and_surfaces(toy, program, want):
    assert answers(toy, program) == want
    assert M.parse(M.dumps(program)) == program
    if not isinstance(program, (Intersect, SelectBetween, Union, AllEntities)):
        assert [r.value for r in compact.execute(toy, compact.raise_program(program)).collect()] == want
    try:
        raised = script.raise_program(program)
        assert sorted(r.value for r in script.execute(toy, json.dumps({"version": raised.version, "ops": list(raised.ops)})).answers.collect()) == want
    except script.ScriptError as problem:
        assert problem.code == "TYPE_MISMATCH"  # what a script cannot do on all entities


def follow(direction="out", relation="located_in", limit=5):
    ops = [
        {"op": "start", "in": "$seed", "out": "h0"}, {"op": "follow", "in": "h0", "relation": "works_at", "direction": "out", "limit": limit, "out": "h1"},
        {"op": "follow", "in": "h1", "relation": relation, "direction": direction, "limit": limit, "out": "h2"}, {"op": "require_unique", "in": "h2"}, {"op": "emit", "in": "h2"},
    ]
    return {"version": "0.1", "ops": ops}


def test_script_runs_and_budgets(toy):
    got = script.execute(toy, follow(), seed="alice")
    assert [r.value for r in got.answers.collect()] == ["paris"] and got.usage["edge_visits"] == 2 and got.usage["graph_calls"] == 2 and got.relation_path == ("works_at", "located_in")
    for code, call in {
        "BUDGET_EXCEEDED": lambda: script.execute(toy, follow(), seed="alice", max_edge_visits=1),
        "RELATION_NOT_ALLOWED": lambda: script.execute(toy, follow(), seed="alice", relations=["works_at"]),
        "NON_UNIQUE_RESULT": lambda: script.execute(toy, follow("in", "works_at"), seed="alice"),
        "MISSING_SEED": lambda: script.execute(toy, follow()),
    }.items():
        with pytest.raises(script.ScriptError) as problem:
            call()
        assert problem.value.code == code


@pytest.mark.parametrize("given,code", [
    ("no", "NON_JSON"), ("{} {}", "EXTRA_TEXT"), ('{"ops": [], "x": 1}', "EXTRA_FIELD"), ('{"version": "9", "ops": [1]}', "UNSUPPORTED_VERSION"), ('{"version": "0.2", "ops": []}', "LIMIT_EXCEEDED"),
    ('{"version": "0.2", "ops": [{"op": "fly"}]}', "UNKNOWN_OP"), ('{"version": "0.3", "ops": [{"op": "emit", "in": "h1"}]}', "INVALID_SCHEMA"),
    ('{"version": "0.2", "ops": [{"op": "start", "in": "$seed", "out": "h0"}, {"op": "follow", "in": "h0", "relation": "r", "direction": "up", "out": "h1"}]}', "INVALID_DIRECTION"),
])
def test_script_refusals(given, code):
    with pytest.raises(script.ScriptError) as problem:
        script.parse(given)
    assert problem.value.code == code


def test_compact_limit(toy):
    rows = compact.execute(toy, {"root": {"all_entities": 1000}, "steps": [{"op": "filter_type", "type_ids": ["person"]}]}, 2).collect()
    assert [r.value for r in rows] == ["alice", "bob"] and rows[0].total == 3 and rows[0].truncated
    with pytest.raises(ValueError):
        compact.lower({"root": {"all_entities": 5}})


COMPARE = [
    (("1906/2/5", "date", None), "eq", Literal(1906, "year"), True), (("1829/1/1", "date", None), "gt", Literal(1829, "year"), False), (("1830/1/1", "date", None), "gt", Literal(1829, "year"), True),
    (("100", "quantity", "square kilometre"), "gt", Literal(50, "quantity", "square mile"), False), (("5", "quantity", "m"), "ne", Literal(5, "quantity", "km"), False), (("5", "quantity", None), "eq", Literal(5, "quantity", "1"), True),
    (("30", "quantity", "year"), "eq", Literal("30 year"), True), (("-50", "year", None), "lt", Literal(-10, "year"), True), (("1906-02-05", "date", None), "lt", Literal("1906/2/6", "date"), True), (("abc", "string", None), "lt", Literal("abd"), True),
    (("x", "quantity", None), "eq", Literal("x"), True), (("Grüße", "string", None), "contains", Literal("GRÜSS"), False), (("Hello", "string", None), "contains", Literal("ELL"), True), (("1999", "year", None), "eq", Literal("1999"), True),
    (("1999", "year", None), "ne", Literal("1999/1/1", "date"), True), ((None, "string", None), "eq", Literal("x"), False),
]


def test_comparisons(spark):
    for (value, kind, unit), comparator, target, want in COMPARE:
        df = values.typed(spark.createDataFrame([(value, kind, unit)], "value string, datatype string, unit string"))
        assert df.select(values.compare(comparator, target)).first()[0] is want, (value, kind, comparator, target)


def test_formatting(spark):
    given = [("30", "quantity", "year", "30 year"), ("30", "quantity", "1", "30"), ("1999.0", "year", None, "1999"), ("-50/3/4", "date", None, "-0050-03-04"), ("1999/3/4", "date", None, "1999-03-04"), ("x", "string", None, "x")]
    df = values.typed(spark.createDataFrame([g[:3] for g in given], "value string, datatype string, unit string")).select(values.formatted().alias("f"))
    assert [r.f for r in df.collect()] == [g[3] for g in given]


def test_random_programs_against_sets(toy):
    edges = {tuple(e.split(" ")) for e in C.TOY_EDGES.split("|")} | {(i, "age", v) for i, v in C.TOY_AGES.items()}
    kinds = {i: t for i, (_, t, _) in C.TOY_ENTITIES.items()}
    rng = random.Random(4)

    def make(depth):
        if depth == 0:
            return Entity(rng.choice(list(kinds))) if rng.random() < 0.7 else AllEntities()
        pick = rng.randrange(5)
        if pick == 0:
            return Hop(make(depth - 1), rng.choice(["works_at", "friend", "located_in", "country", "age"]), rng.choice(["in", "out"]))
        if pick == 1:
            return Union((make(depth - 1), make(depth - 1)))
        if pick == 2:
            return Intersect((make(depth - 1), make(depth - 1)))
        if pick == 3:
            return FilterType(make(depth - 1), rng.choice(["person", "city"]))
        return FilterLiteral(make(depth - 1), "age", rng.choice(["lt", "ge", "eq"]), Literal(34))

    def plain(n):
        match n:
            case Entity():
                return {n.entity_id}
            case AllEntities():
                return set(kinds)
            case Hop():
                return {o for s, r, o in edges if r == n.relation and s in plain(n.input)} if n.direction == "out" else {s for s, r, o in edges if r == n.relation and o in plain(n.input)}
            case Union():
                return set().union(*map(plain, n.inputs))
            case Intersect():
                return set.intersection(*map(plain, n.inputs))
            case FilterType():
                return {x for x in plain(n.input) if kinds.get(x) == n.type_id}
        test = {"lt": float.__lt__, "ge": float.__ge__, "eq": float.__eq__}[n.comparator]
        return {x for x in plain(n.input) if x in C.TOY_AGES and test(float(C.TOY_AGES[x]), 34.0)}

    for _ in range(12):
        p = make(3)
        assert {r.value for r in execute(toy, p).collect()} == plain(p)
        assert rewrite.signature(rewrite.canonical(p)) == rewrite.signature(p)


def test_analytics(toy):
    two = Intersect((Hop(Entity("alice"), "works_at"), Hop(Entity("bob"), "works_at")))
    assert rewrite.cost(two) == 3.5 and rewrite.topic_roots(two) == ["alice", "bob"]
    assert rewrite.signature(two) == rewrite.signature(Intersect(two.inputs[::-1]))
    assert min(r.necessity for r in verify.necessity(toy, two).collect()) == 0.0
    assert verify.shortcut(toy, Hop(Hop(Entity("alice"), "friend"), "friend")) == Hop(Entity("alice"), "friend_of_friend")
    assert verify.shortcut(toy, Hop(Hop(Entity("alice"), "works_at"), "located_in")) is False
    assert verify.shortcut(toy, Hop(Hop(Entity("alice"), "friend"), "friend"), max_candidates=0) is None
    assert verify.answer_leak(toy, Hop(Entity("alice"), "friend"), "Is Bob the answer?") and not verify.answer_leak(toy, Hop(Entity("alice"), "friend"), "Is Bobby the answer?")
    report = verify.certify(toy, Hop(Entity("alice"), "friend"), "Is Bob the answer?")
    assert report["reasons"] == ["ANSWER_LEAK"] and report["answers"] == [("entity", "bob")]


def test_evidence_of_qualifier_queries(toy):
    facts = lambda p: {tuple(r) for r in primitives.evidence(toy, p).collect()}
    age = {("alice", "age", "34")}
    assert facts(M.QueryAttributeUnderCondition(Entity("alice"), "age", "since", Literal(1))) == age
    assert facts(M.QueryAttributeQualifier(Entity("alice"), "age", Literal(34), "since")) == age
    assert facts(M.QueryRelationQualifier(Entity("alice"), Entity("bob"), "friend", "since")) == {("alice", "friend", "bob")}


def test_novelty_counts_the_query_set(spark, tmp_path):
    from graphweft.queries import tables

    rows = [("exampl100", "a b c d e"), ("exampl200", "a b c d e"), ("exampl201", "a b c x y")]
    spark.createDataFrame(rows, "example_id string, question string").write.parquet(str(tmp_path / "benchmark_examples.parquet"))
    assert {r.id[6:]: r.novelty for r in tables.trigram_novelty(spark, str(tmp_path)).collect()} == {"100": 0.0, "200": 0.0}


def test_no_path_of_a_shortcut_is_dropped(toy, spark):
    from dataclasses import replace

    edges = [("r", f"a{k:03}", f"e{k:03}") for k in range(150)] + [("e149", "z", "t"), ("r", "p", "u"), ("u", "q", "v"), ("v", "s", "t")]
    graph = replace(toy, edges=spark.createDataFrame(edges, "subject string, relation string, object string"))
    program = Hop(Hop(Hop(Entity("r"), "p"), "q"), "s")
    assert verify.shortcut(graph, program) == Hop(Hop(Entity("r"), "a149"), "z")
    assert verify.shortcut(graph, program, max_candidates=120) is None


def test_shortcut_search_sees_the_whole_graph(spark, tiny, monkeypatch):
    from graphweft.queries import graph

    seen, search_ = [], verify.shortcut
    monkeypatch.setattr(verify, "shortcut", lambda c, p: seen.append(c) or search_(c, p))
    assert [tuple(r) for r in graph.shortcut_search(spark, tiny).collect()] == [(True, "False")]
    assert {r.relation for r in seen[0].edges.select("relation").distinct().collect()} == set("in_region lives_in located_in placed_by contains shipped_by supplies".split())


def test_primitives(toy, spark):
    ids = spark.createDataFrame([("alice",), ("nobody",)], "entity_id string")
    assert {tuple(r) for r in primitives.neighbors(toy, ids, "out", ["friend"]).collect()} == {("alice", "friend", "bob")}
    assert {r.entity_id: r.degree for r in primitives.degrees(toy, ids).collect()} == {"alice": 3, "nobody": 0}
    assert {r.entity_id: r.label for r in primitives.infos(toy, ids).collect()} == {"alice": "Alice", "nobody": "nobody"}
    assert [r.entity_id for r in primitives.resolve(toy, "uk").collect()] == ["uk"]
    seen = {tuple(r) for r in primitives.materialize(toy, PROGRAMS[0][0]).collect()}
    assert seen == {("alice", "works_at", "acme", False), ("acme", "located_in", "paris", False)}
    assert [r.truncated for r in primitives.materialize(toy, PROGRAMS[0][0], max_edges=1).collect()] == [True]
    schema = "subject string, relation string, object string"
    changed = toy.overlay(spark.createDataFrame([("alice", "friend", "uk")], schema), spark.createDataFrame([("alice", "friend", "bob")], schema))
    assert answers(changed, Hop(Entity("alice"), "friend")) == ["uk"]


KB = {
    "concepts": {"c_person": {"name": "person", "instanceOf": ["c_being"]}, "c_being": {"name": "being", "instanceOf": []}},
    "entities": {
        "e_alice": {"name": "Alice", "instanceOf": ["c_person"], "attributes": [], "relations": [{"predicate": "friend", "direction": "forward", "object": "e_bob", "qualifiers": {"since": [{"type": "year", "value": 2020}]}}]},
        "e_bob": {"name": "Bob", "instanceOf": ["c_person"], "relations": [], "attributes": [{"key": "age", "value": {"type": "quantity", "value": 30, "unit": "year"}, "qualifiers": {"point in time": [{"type": "year", "value": 2020}], "source": [{"type": "string", "value": "census"}]}}]},
    },
}


def test_knowledge_base(spark, tmp_path):
    path = tmp_path / "kb.json"
    path.write_text(json.dumps(KB))
    graph = knowledge.knowledge_base(spark, str(path))
    run = kopl.Importer({"Alice": ["e_alice"], "Bob": ["e_bob"]}, {"person": ["c_person"]})
    find = lambda n: {"function": "Find", "dependencies": [], "inputs": [n]}
    step = lambda f, d, *i: {"function": f, "dependencies": d, "inputs": list(i)}
    cases = [
        ([find("Alice"), step("Relate", [0], "friend", "forward"), step("What", [1])], ["e_bob"]),
        ([find("Alice"), step("Relate", [0], "friend", "forward"), step("QFilterYear", [1], "since", "2020", "=")], ["e_bob"]),
        ([find("Alice"), step("Relate", [0], "friend", "forward"), step("QFilterYear", [1], "since", "2019", "=")], []),
        ([find("Bob"), step("QueryAttrUnderCondition", [0], "age", "point in time", "2020")], ["30 year"]),
        ([find("Bob"), step("QueryAttrQualifier", [0], "age", "30 year", "source")], ["census"]),
        ([find("Alice"), find("Bob"), step("QueryRelationQualifier", [0, 1], "friend", "since")], ["2020"]),
        ([find("Bob"), step("QueryAttr", [0], "age"), step("VerifyNum", [1], "20 year", ">")], ["yes"]),
        ([step("FindAll", []), step("FilterNum", [0], "age", "18 year", ">=")], ["e_bob"]),
    ]
    for program, want in cases:
        assert answers(graph, run.convert(program)) == want
    assert {r.type_id for r in graph.entity_types.filter("entity_id = 'e_bob'").collect()} == {"c_person", "c_being"}
    assert {r.relation_id for r in graph.relation_labels.collect()} == {"age", "friend", "point in time", "since", "source"}
    for bad, code in (([step("Find", [], "Zoe")], "UNKNOWN_ENTITY"), ([step("Fly", [])], "UNSUPPORTED_KOPL_OPERATOR"), ([], "EMPTY_KOPL_PROGRAM"), ([step("Count", [3])], "INVALID_KOPL_DEPENDENCY")):
        with pytest.raises(ValueError, match=code):
            run.convert(bad)
    with pytest.raises(ValueError):
        execute(graph, M.FilterQualifier(Entity("e_bob"), "since", "eq", Literal(2020, "year")))
    folder = str(tmp_path / "saved")
    C.save(graph, folder)
    assert answers(C.from_parquet(spark, folder), Hop(Entity("e_alice"), "friend")) == ["e_bob"]


def test_pages_and_search(spark, tmp_path):
    rows = [
        {"_id": "1", "wikipedia_id": "1", "wikipedia_title": "Alpha", "text": ["Alpha is a town.", "See Beta."], "anchors": [{"text": "Beta", "wikipedia_id": "2"}], "categories": "Towns,Places"},
        {"_id": "2", "wikipedia_id": "2", "wikipedia_title": "Beta City", "text": ["The expected answer stands here."], "anchors": [{"text": "?"}], "categories": ""},
        {"_id": "3", "wikipedia_id": "3", "text": []},
    ]
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    graph, refused = knowledge.pages(spark, str(path))
    assert {(r.reason, r.page_id) for r in refused.collect()} == {("INVALID_JSON", None), ("MISSING_PAGE_ID_OR_TITLE", "3"), ("MISSING_ANCHOR_TARGET", "2")}
    assert answers(graph, Hop(Entity("1"), "links_to")) == ["2"]
    assert search.search(graph.passages, "expected answer").first().page_id == "2"
    assert search.search(graph.passages, "...").count() == 0
    with pytest.raises(ValueError):
        search.search(graph.passages, " ")


def test_metrics_and_text(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    lit = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    assert one(text.normal_answer(F.lit("  The, City-of Paris! "))) == "cityof paris"
    assert one(text.trigrams(F.lit("a b c d"))) == ["a b c", "b c d"] and one(text.trigrams(F.lit("a b"))) == ["a b"] and one(text.trigrams(F.lit(" "))) == []
    assert tuple(one(metrics.set_scores(lit("a", "a"), lit("a", "b")))) == (1.0, 0.5, pytest.approx(2 / 3), 0.0) and one(metrics.set_scores(lit(), lit())).em == 1.0
    assert tuple(one(metrics.alias_scores(lit("x"), F.array(lit("x", "y"))))) == (1.0, 1.0, 1.0, 1.0)
    quota = sampling.largest_remainder({"a": 100, "b": 10, "c": 1}, 12)
    assert sum(quota.values()) == 12 and quota["c"] == 1 and quota["a"] > quota["b"] and sampling.largest_remainder({"a": 2}, 9) == {"a": 2}
    new = archive.grams(spark.createDataFrame([("n", "one two three four")], "id string, t string"), "id", "t")
    old = archive.grams(spark.createDataFrame([("o", "one two three four")], "other string, t string"), "other", "t")
    assert archive.novelty(new, old).first().novelty == 0.0 and archive.novelty(new, old.limit(0)).first().novelty == 1.0
    rows = [("t1", "s1", 0.0), ("t2", "s2", 0.5), ("t3", "s3", 1.0), ("t4", "s2", 0.5), ("t5", "known", 0.5)]
    candidates = spark.createDataFrame([(*r, 1.0, 1.0) for r in rows], "task_id string, signature string, pass_rate double, structural double, textual double")
    got = {r.task_id: r.reason for r in archive.admit(candidates, spark.createDataFrame([("known",)], "signature string")).collect()}
    assert got == {"t1": "TOO_HARD", "t2": None, "t3": "TOO_EASY", "t4": "DUPLICATE_SIGNATURE", "t5": "DUPLICATE_SIGNATURE"}


def test_sparql():
    assert rewrite.sparql(Count(Hop(Entity("a"), "r"))) == "SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { VALUES ?v0 { <a> } ?v0 <r> ?x . }"
    assert "ORDER BY DESC" in rewrite.sparql(SelectAmong(Entity("a"), "size"))


def test_plan_reads_only_what_it_needs(spark, tiny):
    plan = Compiler(C.star_schema(spark, tiny)).answers(Hop(Entity("supplier:7"), "supplies"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "l_suppkey" in plan and "l_quantity" not in plan


def test_entry(spark, tiny):
    import __spark_entry__

    assert __spark_entry__.entry(spark).collect()[0].kind == "count"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
