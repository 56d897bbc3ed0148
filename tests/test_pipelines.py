"""Evaluation, exports, readers, adapters, traces: small cases with known results, NULLs, ties, empty tables."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from graphweft.functions import rewards
from graphweft.operators import evaluation, exports, search
from graphweft.operators.algebra import execute
from graphweft.plans import compact, rewrite, script, trace
from graphweft.plans.model import AllEntities, Count, Entity, FilterQualifier, Hop, Intersect, Literal, QueryAttribute, QueryRelation, SelectBetween, Union, Verify
from graphweft.sources import benchmarks, catalog, readers


@pytest.fixture(scope="module")
def toy(spark):
    return catalog.snapshot(spark, "toy-v1")


def test_triples_are_distinct_and_ordered(spark):
    c = catalog.from_triples(spark, [("b", "r", "a"), ("a", "r", "b"), ("b", "r", "a")], [("a", "A", [])])
    assert [tuple(r) for r in c.edges.collect()] == [("a", "r", "b"), ("b", "r", "a")]
    assert {(r.entity_id, r.label) for r in c.entities.collect()} == {("a", "A"), ("b", "b")}
    with pytest.raises(KeyError):
        catalog.snapshot(spark, "nowhere:x")


def test_sqlite(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE edges (subject, relation, object)")
        db.executemany("INSERT INTO edges VALUES (?, ?, ?)", [("a", "r", f"b{k}") for k in range(25)] * 2)
        db.execute("CREATE TABLE entities (entity_id, label, aliases)")
        db.execute("INSERT INTO entities VALUES ('a', 'A', '[\"x\"]'), ('n', NULL, NULL)")
    monkeypatch.setattr(readers, "SLICE", 10)
    c = catalog.snapshot(spark, f"sqlite:{path}")
    assert c.edges.count() == 25 and c.passages.count() == 0 and {r.entity_id: r.aliases for r in c.entities.collect()} == {"a": ["x"], "n": []}
    facts = readers.preflight(c)
    assert (facts["entities"], facts["edges"], facts["neighbours"]) == (2, 25, 10)


def test_remote(spark, tmp_path):
    sent = []

    def send(endpoint, query):
        sent.append(query)
        if len(sent) < 3:
            raise OSError
        return json.dumps({"head": {"vars": ["x"]}, "results": {"bindings": [{"x": {"value": "v"}}, {}]}})

    ask = lambda q="q": readers.remote(spark, "http://h", q, "s", str(tmp_path), send, 0)
    assert [r.x for r in ask().collect()] == ["v", None] and len(sent) == 3
    assert ask().count() == 2 and len(sent) == 3 and ask("other").count() == 2 and len(sent) == 4

    def never(endpoint, query):
        raise OSError

    with pytest.raises(OSError):
        readers.remote(spark, "http://h", "none", "s", str(tmp_path), never, 0)
    assert readers.remote(spark, "http://h", "ask", "s", str(tmp_path), lambda e, q: '{"boolean": true}').first().answer is True


@pytest.mark.parametrize("chars", [1, 3, 1000])
def test_json_array(spark, tmp_path, chars):
    path = tmp_path / "a.json"
    path.write_text('[ {"a": 1, "b": "x,]\\""} , {"a": 22}, {"a": 3} ]\n')
    rows = readers.json_array(spark, str(path), "a int, b string", chars=chars)
    assert [(r.a, r.b) for r in rows.collect()] == [(1, 'x,]"'), (22, None), (3, None)]
    assert readers.json_array(spark, str(path), "a int", 2, chars).count() == 2
    for text, ok in (("[]", True), ("[1, 23]", True), ('[{"a": 1}', False), ("[1] x", False), ('{"a": 1}', False)):
        path.write_text(text)
        if ok:
            assert list(readers.elements(str(path), None, chars)) == json.loads(text)
        else:
            with pytest.raises(ValueError):
                list(readers.elements(str(path), None, chars))


def test_logs_tasks_and_sinks(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"step": 1}\n\n{"step": 2}\n')
    assert [r.step for r in readers.log_lines(spark, str(log), "step int").collect()] == [1, 2]
    log.write_text('{"step": 1}\n{"st\n')
    with pytest.raises(Exception, match="BAD_LINE"):
        readers.log_lines(spark, str(log), "step int").collect()
    one, two, none = (str(tmp_path / n) for n in ("one", "two", "none"))
    readers.typed_sink(spark.createDataFrame([(1, "a")], "id int, x string"), one, "id long, y string")
    readers.typed_sink(spark.createDataFrame([], "id int"), none, "id long")
    readers.compact_view(spark.createDataFrame([(2, "b", 0)], "id long, y string, z int"), two, ["id", "y"])
    assert spark.read.parquet(none).dtypes == [("id", "bigint")] and readers.row_count(spark, one) == 1
    assert [tuple(r) for r in readers.tasks(spark, [two, one], 1).collect()] == [(2, "b")] and readers.tasks(spark, [two, one, none]).count() == 2
    readers.split_sink(spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=test", "split=train"]
    made = readers.manifest(str(tmp_path / "m.json"), {"b": 1, "a": 2}, "c0ffee", ["y", "x"])
    assert made["artifacts"] == ["x", "y"] and json.loads((tmp_path / "m.json").read_text()) == made == readers.manifest(str(tmp_path / "n.json"), {"a": 2, "b": 1}, "c0ffee", ["x", "y"])
    assert readers.file_digest(str(tmp_path / "m.json")) == readers.file_digest(str(tmp_path / "n.json"))
    assert readers.report(spark.createDataFrame([(2, None), (1, "x")], "a int, b string"), str(tmp_path / "r.jsonl")) == 2
    assert (tmp_path / "r.jsonl").read_text() == '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n'
    assert readers.export(spark.createDataFrame([("b",), ("a",)], "task_id string"), str(tmp_path / "e")) == 2


def test_benchmarks(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data)) and str(tmp_path / name)
    rows = benchmarks.cwq(spark, put("cwq_val.json", {"questions": [{"ID": "a", "question": "Q?", "sparql": "ns:m.01x ns:r ?x . ns:m.01x", "answers": [{"answer_id": "m.02", "answer": "Two"}]}, {"machine_question": "M"}]})).collect()
    assert [(r.example_id, r.split, r.question, r.topic_entity_ids) for r in rows] == [("a", "dev", "Q?", ["m.01x"]), ("1", "dev", "M", [])]
    assert [tuple(a) for a in rows[0].gold_answers] == [("m.02", "entity", "Two")] and rows[1].gold_answers == []
    graph = {"nodes": [{"node_type": "entity", "id": "m.1", "question_node": 0}, {"node_type": "entity", "id": "m.2", "question_node": 1}, {"node_type": "class", "id": "c"}]}
    row = benchmarks.grailqa(spark, put("grail_train.json", [{"qid": 5, "question": "G", "graph_query": graph, "answer": [{"answer_type": "Value", "answer_argument": "9"}]}])).first()
    assert (row.example_id, row.split, row.topic_entity_ids, [tuple(a) for a in row.gold_answers]) == ("5", "train", ["m.1"], [("9", "literal", None)])
    data = [{"QuestionId": "t", "Question": "T?", "Answer": {"Aliases": ["A ", "B", "A"], "Value": "A"}}, {"id": "k", "input": "K?", "output": [{"answer": "x", "provenance": [{"wikipedia_id": "12"}]}]}, {"question": "P", "answers": "z"}, {"question": "none"}]
    rows = benchmarks.open_qa(spark, put("trivia_test.json", {"Data": data}), "triviaqa").collect()
    assert [(r.example_id, r.answer_aliases, r.topic_entity_ids) for r in rows] == [("t", [["A", "B"]], []), ("k", [["x"]], ["12"]), ("2", [["z"]], [])]
    line = lambda source, k: json.dumps({"data_source": source, "extra_info": {"index": k, "question": "S"}, "reward_model": {"ground_truth": {"target": ["u"]}}})
    path = put("many.jsonl", "\n".join([line("set/nq", 3), "", line("other", 4), line("popqa", 5)]))
    assert [(r.example_id, r.dataset, r.split) for r in benchmarks.buckets(spark, path).collect()] == [("ssp:set/nq:3", "nq", "test"), ("ssp:popqa:5", "popqa", "test")]
    assert benchmarks.buckets(spark, path, ["nq"]).count() == 1
    with pytest.raises(ValueError, match="COUNT_MISMATCH"):
        benchmarks.buckets(spark, path, ["nq"], fixed=True)


def test_traces(spark, toy):
    works = Hop(Entity("acme"), "works_at", "in")
    asked = Intersect((works, Hop(Hop(Entity("cara"), "friend", "in"), "friend", "in")))
    made = trace.compile_trace(toy, asked)
    assert made.reasons == [] and made.answers == (("entity", "alice"),) and made.result == ("intersect", [0, 1]) and trace.replay(toy, made) == []
    deep = Count(Hop(Intersect((works, Hop(Entity("bob"), "friend", "in"))), "friend"))
    assert trace.compile_trace(toy, deep).answers == (("count", "1"),)
    assert trace.compile_trace(toy, SelectBetween(works, Entity("cara"), "age")).answers == (("entity", "cara"),)
    assert trace.compile_trace(toy, Intersect((AllEntities(), Entity("bob")))).reasons == ["TRACE_UNBOUNDED_ALL_ENTITIES"]
    assert trace.compile_trace(toy, Intersect((Hop(Entity("x"), "r"), Entity("bob")))).reasons == ["TRACE_EMPTY_INTERMEDIATE"]
    assert trace.compile_trace(toy, asked, calls=1).reasons == ["TRACE_TOOL_BUDGET_EXCEEDED"] and trace.compile_trace(toy, works, entities=1).reasons == ["TRACE_ANSWER_BUDGET_EXCEEDED"]
    assert trace.replay(toy, made, 1) == ["TRACE_REPLAY_TRUNCATED"]
    made.calls[1].answers = (("entity", "bob"),)
    assert trace.replay(toy, made) == ["TRACE_REPLAY_MISMATCH"]


def test_steps_of_a_script(toy):
    run = script.Executor(toy).run(script.raise_program(Intersect((Hop(Entity("acme"), "works_at", "in"), Entity("bob")))), trace=1)
    assert [(s.op, s.values, s.total) for s in run.steps] == [("resolve_entity", ("acme",), 1), ("follow", ("alice",), 2), ("resolve_entity", ("bob",), 1), ("intersect", ("bob",), 1)]
    assert all(s.relevant for s in run.steps) and run.steps[1].usage["edge_visits"] == 2
    ops = [{"op": "resolve_entity", "query": "bob", "match": "id", "out": "h0"}, {"op": "all_entities", "out": "h1"}, {"op": "emit", "in": "h0"}]
    run = script.Executor(toy).run(script.check({"version": "0.2", "ops": ops}), trace=8)
    assert [(s.total, s.relevant) for s in run.steps] == [(1, True), (None, False)]


def test_pages_can_be_filtered(spark):
    c = catalog.build(spark, entities=spark.createDataFrame([("p", "P", [])], "entity_id string, label string, aliases array<string>"), entity_types=spark.createDataFrame([("p", "page")], "entity_id string, type_id string"), passages=spark.createDataFrame([("p", 0, "P", "Straße über Wasser"), ("q", 0, "Q", "nothing")], "page_id string, paragraph_id long, title string, text string"))
    ops = [{"op": "search_passage", "query": "über", "out": "h0"}, {"op": "passage_pages", "in": "h0", "out": "h1"}, {"op": "filter_type", "in": "h1", "type_id": "page", "out": "h2"}, {"op": "count", "in": "h2", "out": "h3"}, {"op": "emit", "in": "h3"}]
    assert script.execute(c, {"version": "0.2", "ops": ops}).answers.first().value == "1"
    index = search.postings(c.passages)
    whole, kept = ({(r.page_id, round(r.score, 9)) for r in df.collect()} for df in (search.scores(c.passages, "über wasser"), search.index_scores(index, "über wasser")))
    assert whole == kept and len(whole) == 1
    ask = lambda q: [r.entity_id for r in search.resolve(c.entities, c.passages, q).collect()]
    assert ask("p") == ["p"] and ask("wasser") == ["p"] and ask("nothing") == ["q"] and ask("??") == []


def test_samples_and_tools(toy):
    made = trace.sample(toy, 6, 42)
    assert [f for f, _, _ in made] == list(trace.FAMILIES) and made == trace.sample(toy, 6, 42)
    assert all((p is None) != (r is None) for _, p, r in made) and all(not execute(toy, p).isEmpty() for _, p, _ in made if p)
    tools = trace.Tools(toy)
    assert tools.call("inspect_entity", entity_id="bob")["type_ids"] == ["person"] and tools.call("final_answer", answers=["b", "a", "b"]) == [("entity", "a"), ("entity", "b")]
    assert [r["value"] for r in tools.call("search", query=compact.raise_program(Hop(Entity("acme"), "works_at", "in")))] == ["alice", "bob"]
    with pytest.raises(ValueError):
        tools.call("execute_program", program={})
    assert trace.Tools(toy, "questioner").call("execute_program", program=Hop(Entity("bob"), "friend").to_dict()) == [("entity", "cara")]


def test_rewrites():
    nested = Union((Union((Entity("b"), Entity("a"))), Entity("a"), Entity("a")))
    assert rewrite.canonical(nested).inputs[-1] == Union((Entity("a"), Entity("b"))) and rewrite.signature(nested) != rewrite.signature(Union((Entity("a"), Entity("b"))))
    node = Hop(Entity("wd:Q1"), "wdt:P1")
    prefixes = {"wd": "http://e/", "wdt": "http://e/p/"}
    assert rewrite.expanded(node, prefixes) == Hop(Entity("http://e/Q1"), "http://e/p/P1") and rewrite.compacted(rewrite.expanded(node, prefixes), prefixes) == node
    assert rewrite.unmarked(rewrite.marked(node)) == node
    for bad in ("a b", "a>b", ""):
        with pytest.raises(ValueError, match="UNSAFE_IRI"):
            rewrite.sparql(Entity(bad))
    assert "<urn:qualifier:q>" in rewrite.sparql(FilterQualifier(Hop(Entity("a"), "r"), "q", "eq", Literal("x"))) and rewrite.sparql(QueryRelation(Entity("a"), Entity("b"))).endswith("?e ?x ?o . }")
    assert '"yes", "no"' in rewrite.sparql(Verify(QueryAttribute(Entity("a"), "k"), "gt", Literal(3)))


def test_evaluation_of_nothing(spark):
    none = spark.createDataFrame([], "split string, mean_f1 double")
    assert evaluation.benchmark_summary(none).collect() == []
    rollouts = spark.createDataFrame([("t", 0.0, 0.0, 0.5), ("t", None, 0.0, None)], "task_id string, program_parse double, program_executable double, f1 double")
    r = evaluation.rollout_summary(rollouts).first()
    assert (r.samples, r.mean_f1, r.execution_rate_given_parse, r.semantic_success_given_execution) == (2, 0.25, 0.0, 0.0)
    assert evaluation.sampled(none, "split", 5, 1).count() == 0 and evaluation.visible(none, ["split"], 0.5).count() == 0 and evaluation.split_both(none, "split", 0.5, 1).count() == 0


def test_runs_must_be_alike(spark):
    runs = spark.createDataFrame([("a", 0.5, "d", 3), ("b", 0.75, "d", 3), ("c", 0.1, None, 3)], "run string, em double, dataset string, n int")
    assert {r.run: r.em_delta for r in evaluation.compare_runs(runs.filter("run <> 'c'"), "a", ["em"], ["dataset", "n"]).collect()} == {"a": 0.0, "b": 0.25}
    for bad, base in ((runs, "a"), (runs.filter("run <> 'c'"), "z"), (runs.filter("run = 'a'").union(runs.filter("run = 'a'")), "a")):
        with pytest.raises(ValueError):
            evaluation.compare_runs(bad, base, ["em"], ["dataset"])


def test_selection(spark):
    rows = spark.createDataFrame([(f"t{k}", k) for k in range(10)], "task_id string, cost int")
    assert evaluation.sampled(rows, "task_id", 25, 1).count() == 25 and evaluation.sampled(rows, "task_id", 4, 1).select("task_id").distinct().count() == 4
    seen = {r.task_id: (r.rank, r.half) for r in evaluation.visible(rows, ["cost", "task_id"], 0.45).collect()}
    assert seen == {"t0": (0, "replay"), "t1": (1, "replay"), "t2": (2, "frontier"), "t3": (3, "frontier"), "t4": (4, "frontier")}
    assert evaluation.visible(rows.limit(1), ["cost"], 0.1).first().half == "frontier"
    assert {r.split: r["count"] for r in evaluation.split_both(rows, "task_id", 0.999, 1).groupBy("split").count().collect()} == {"val": 9, "train": 1}
    parts = evaluation.round_mixture(rows.filter("cost < 3"), rows.filter("cost between 3 and 5"), rows.filter("cost > 5"), "task_id", 10, 0.5, 0.25, 7)
    assert {r.origin: r["count"] for r in parts.groupBy("origin").count().collect()} == {"base": 5, "archive": 2, "new": 3}
    with pytest.raises(ValueError, match="SNAPSHOT_MISMATCH"):
        evaluation.tasks_at(spark.createDataFrame([("a", "train", "x")], "id string, split string, snapshot string"), "train", "s", "id", [0])
    assert [s["phase"] for s in evaluation.schedule(1, 0, 0, 0.4, 0.6, 0.2)] == ["frontier"]


def test_rewards_on_texts(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    ops = ["start", "emit"]
    whole = one(rewards.script_shape(F.lit('{"version": "0.2", "ops": [{"op": "start"}, {"op": "zap"}, {"op": "emit"}]}'), "0.2", ops))
    assert (whole.code_present, round(whole.schema_fraction, 6), round(whole.valid_operation_fraction, 6), round(whole.valid_prefix_fraction, 6)) == (1.0, round((2 + 2 / 3) / 3, 6), 0.666667, 0.333333)
    cut = one(rewards.script_shape(F.lit('{"version": "0.2", "ops": [{"op": "start"}, {"op": "em'), "0.2", ops))
    assert tuple(round(x, 6) for x in cut) == (1.0, round(0.4 * 2.5 / 3, 6), 0.2, 0.2)
    assert tuple(one(rewards.script_shape(F.lit("hello"), "0.2", ops))) == (0.0, 0.0, 0.0, 0.0)
    answers = lambda t, k="entity": one(rewards.parsed_answers(F.lit(t), F.lit(k)))
    assert answers('<answer>["a", 2]</answer>') == ["a", "2"] and answers('<answer>"a"</answer>') == ["a"] and answers("<answer>[7]</answer>", "count") == ["7"]
    assert answers("none") is None and answers("<answer>[1</answer>") is None and answers("<answer>[1, 2]</answer>", "count") is None
    assert one(rewards.question_present(F.lit('{"question": "a\\"b'))) == 0.0 and one(rewards.question_present(F.lit('{"question": "a\\"b", "x'))) == 1.0
    assert one(rewards.relation_share(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 0.5
    assert round(sum(rewards.SOLVER_SYNTAX.values()), 9) == round(sum(rewards.SOLVER_TOOL.values()), 9) == round(sum(rewards.SOLVER_SOLVE.values()), 9) == round(sum(rewards.PRODUCTION.values()), 9) == round(sum(rewards.GROUNDING.values()), 9) == 1.0


def test_exports(spark, toy):
    people = spark.createDataFrame([("a", "Ann"), ("b", "ANN"), ("c", "Cid"), ("d", None)], "entity_id string, label string")
    assert {r.entity_id: r.reference for r in exports.references(people).collect()} == {"a": "a", "b": "b", "c": "Cid", "d": "d"}
    tasks = spark.createDataFrame([("t", "s", "Q", None, ["r"]), ("u", "s", None, "e", None), ("v", "s", None, None, [])], "task_id string, snapshot string, question string, seed string, relations array<string>")
    known = spark.createDataFrame([("s", "r")], "snapshot string, relation_id string")
    assert {(r.task_id, r.role, r.prompt) for r in exports.role_rows(tasks, known).collect()} == {("t", "solver", "Q"), ("u", "questioner", "e")}
    with pytest.raises(Exception, match="MISSING_RELATION"):
        exports.role_rows(tasks, known.withColumn("relation_id", F.lit("x"))).collect()
    with pytest.raises(ValueError, match="DUPLICATE_RELATION"):
        exports.load_relations(spark.createDataFrame([("r", "x"), ("r", "y")], "relation_id string, label string"))
    said = exports.solver_messages(spark.createDataFrame([("Q", "S", ["a"])], "question string, script string, answers array<string>"), "sys").first().messages
    assert [m.role for m in said] == ["system", "user", "assistant", "assistant"] and said[-1].content == '<answer>["a"]</answer>'
    got = exports.candidates(toy, toy.entities.select("entity_id"), "friend").collect()
    assert {(r.family, r.entity_id, r.type_id, tuple(r.answers)) for r in got if r.entity_id == "alice"} == {("hop1", "alice", None, ("bob",)), ("hop2", "alice", None, ("cara",)), ("type_filter", "alice", "person", ("bob",)), ("count", "alice", None, ("1",))}
    assert {r.entity_id for r in exports.graph_seeds(toy, 10, 1, 1, 1).collect()} == {"france", "uk"}
    assert exports.catalog_text(spark.createDataFrame([("b", "B"), ("a", "A")], "relation_id string, label string")).first().text == "a\tA\nb\tB"


def test_queries_of_the_core_have_sql():
    from graphweft.queries import registry

    assert set(registry.queries()) - set(registry.oracles()) <= {"shortcut_search", "program_analytics", "stream_budget", "p2_wide"}
