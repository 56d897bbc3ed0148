"""The surfaces beside the algebra (handle scripts, pipelines, functional programs), step by step over the star-schema graph."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators import exports, primitives
from graphweft.operators.algebra import Compiler, execute
from graphweft.plans import compact, kopl, rewrite, script, trace
from graphweft.plans.model import (
    AllEntities, Entity, FilterLiteral, FilterQualifier, FilterType, Hop, Intersect, Literal, Node, QueryAttribute,
    QueryAttributeQualifier, QueryAttributeUnderCondition, QueryRelation, QueryRelationQualifier, SelectAmong, SelectBetween, Union, Verify,
)
from graphweft.session import table
from graphweft.sources.catalog import star_schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ALL = AllEntities()
CUSTOMERS = Hop(Entity("nation:3"), "lives_in", "in")
ORDERS = FilterType(ALL, "order")
MONEY = "quantity", "USD"
MANY = 10_000_000


def _entities(ids: str) -> str:
    return f"SELECT 'entity' AS kind, v AS value FROM (SELECT DISTINCT {ids})"


def _literals(values: str) -> str:
    return f"SELECT 'literal' AS kind, v AS value FROM (SELECT DISTINCT {values})"


USD = "CAST(CAST({0} AS DECIMAL(18,2)) AS VARCHAR) || ' USD'"
#: What is asked, as a program and as SQL over the base tables.
ASKED: dict[str, tuple[Node, str]] = {
    "union": (Union((Hop(Entity("supplier:1"), "supplies"), Hop(Entity("supplier:2"), "supplies"))), _entities("'part:' || l_partkey AS v FROM lineitem WHERE l_suppkey IN (1, 2)")),
    "intersect": (Intersect((Hop(Entity("supplier:1"), "supplies"), Hop(Entity("supplier:2"), "supplies"))), _entities("'part:' || a.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = 1 AND b.l_suppkey = 2")),
    "filter_type": (FilterType(CUSTOMERS, "segment:BUILDING"), _entities("'customer:' || c_custkey AS v FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")),
    "filter_literal": (FilterLiteral(CUSTOMERS, "acctbal", "lt", Literal(1000, *MONEY)), _entities("'customer:' || c_custkey AS v FROM customer WHERE c_nationkey = 3 AND CAST(c_acctbal AS DECIMAL(18,2)) < 1000")),
    "filter_qualifier": (FilterQualifier(Hop(ORDERS, "contains"), "returnflag", "eq", Literal("R")), _entities("'part:' || l_partkey AS v FROM lineitem WHERE l_returnflag = 'R'")),
    "query_attribute": (QueryAttribute(CUSTOMERS, "acctbal"), _literals(f"{USD.format('c_acctbal')} AS v FROM customer WHERE c_nationkey = 3")),
    "under_condition": (QueryAttributeUnderCondition(ORDERS, "totalprice", "status", Literal("P")), _literals(f"{USD.format('o_totalprice')} AS v FROM orders WHERE o_orderstatus = 'P'")),
    "query_relation": (QueryRelation(Hop(Entity("customer:1"), "placed_by", "in"), Entity("customer:1")), _literals("'placed_by' AS v FROM orders WHERE o_custkey = 1")),
    "relation_qualifier": (QueryRelationQualifier(ORDERS, Entity("part:7"), "contains", "linestatus"), _literals("l_linestatus AS v FROM lineitem WHERE l_partkey = 7")),
    "verify": (Verify(QueryAttribute(CUSTOMERS, "acctbal"), "lt", Literal(-900, *MONEY)), "SELECT 'literal' AS kind, CASE WHEN min(CAST(c_acctbal AS DECIMAL(18,2))) < -900 THEN 'yes' ELSE 'no' END AS value FROM customer WHERE c_nationkey = 3"),
    "select_between": (SelectBetween(Entity("customer:5"), Entity("customer:6"), "acctbal", "min"), "SELECT 'entity' AS kind, 'customer:' || c_custkey AS value FROM customer WHERE c_custkey IN (5, 6) ORDER BY c_acctbal, 'customer:' || c_custkey LIMIT 1"),
    "select_among": (SelectAmong(CUSTOMERS, "acctbal", "max"), "SELECT 'entity' AS kind, 'customer:' || c_custkey AS value FROM customer WHERE c_nationkey = 3 ORDER BY CAST(c_acctbal AS DECIMAL(18,2)) DESC, 'customer:' || c_custkey DESC LIMIT 1"),
    "all_entities": (FilterType(AllEntities(MANY // 10), "region"), _entities("'region:' || r_regionkey AS v FROM region")),
}
#: Programs that no single pipeline says.
NO_PIPELINE = {"union", "intersect", "select_between"}


def _cheapest(spark: SparkSession, folder: str) -> Node:
    price = table(spark, folder, "orders").agg(F.min(F.col("o_totalprice").cast("decimal(18,2)"))).first()[0]
    return QueryAttributeQualifier(ORDERS, "totalprice", Literal(f"{price} USD"), "status")


def _script(node: Node) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: script.execute(star_schema(spark, folder), script.raise_program(node), max_returned=MANY, max_edge_visits=MANY, max_follow=MANY).answers


def _pipeline(node: Node) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: compact.execute(star_schema(spark, folder), compact.raise_program(node), MANY).select("kind", "value")


for _name, (_node, _sql) in ASKED.items():
    QUERIES[f"script_{_name}"], ORACLES[f"script_{_name}"] = _script(_node), _sql
    if _name not in NO_PIPELINE:
        QUERIES[f"pipeline_{_name}"], ORACLES[f"pipeline_{_name}"] = _pipeline(_node), _sql

CHEAPEST = _literals("o_orderstatus AS v FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) = (SELECT min(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)")
QUERIES["script_attribute_qualifier"] = lambda spark, folder: _script(_cheapest(spark, folder))(spark, folder)
QUERIES["pipeline_attribute_qualifier"] = lambda spark, folder: _pipeline(_cheapest(spark, folder))(spark, folder)
ORACLES["script_attribute_qualifier"] = ORACLES["pipeline_attribute_qualifier"] = CHEAPEST

NAMES = {"three": ["nation:3"], "one": ["customer:1"], "five": ["customer:5"], "six": ["customer:6"], "seven": ["part:7"], "supplier one": ["supplier:1"], "supplier two": ["supplier:2"]}
KINDS = {"order": ["order"], "building": ["segment:BUILDING"], "part": ["part"]}
THREE = [("Find", [], ["three"]), ("Relate", [0], ["lives_in", "backward"])]
SUPPLIED = [("Find", [], ["supplier one"]), ("Relate", [0], ["supplies", "forward"]), ("Find", [], ["supplier two"]), ("Relate", [2], ["supplies", "forward"])]
ORDERED = [("FindAll", [], []), ("FilterConcept", [0], ["order"])]
#: Functional programs: function, what it depends on, inputs.
FUNCTIONAL: dict[str, tuple[list[tuple[str, list[int], list[str]]], str]] = {
    "and": ([*SUPPLIED, ("And", [1, 3], [])], ASKED["intersect"][1]),
    "or": ([*SUPPLIED, ("Or", [1, 3], [])], ASKED["union"][1]),
    "concept": ([*THREE, ("FilterConcept", [1], ["building"])], ASKED["filter_type"][1]),
    "filter_str": ([*ORDERED, ("FilterStr", [1], ["status", "P"])], _entities("'order:' || o_orderkey AS v FROM orders WHERE o_orderstatus = 'P'")),
    "filter_date": ([*ORDERED, ("FilterDate", [1], ["orderdate", "1996-01-02", "="])], _entities("'order:' || o_orderkey AS v FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-01-02'")),
    "qfilter_str": ([*ORDERED, ("Relate", [1], ["contains", "forward"]), ("QFilterStr", [2], ["returnflag", "R"])], ASKED["filter_qualifier"][1]),
    "qfilter_num": ([*ORDERED, ("Relate", [1], ["contains", "forward"]), ("QFilterNum", [2], ["quantity", "49", ">"])], _entities("'part:' || l_partkey AS v FROM lineitem WHERE CAST(l_quantity AS DECIMAL(18,2)) > 49")),
    "qfilter_year": ([*ORDERED, ("Relate", [1], ["contains", "forward"]), ("QFilterYear", [2], ["shipdate", "1998", "="])], _entities("'part:' || l_partkey AS v FROM lineitem WHERE year(l_shipdate) = 1998")),
    "query_attr": ([*THREE, ("QueryAttr", [1], ["acctbal"])], ASKED["query_attribute"][1]),
    "query_attr_condition": ([*ORDERED, ("QueryAttrUnderCondition", [1], ["totalprice", "status", "P"])], ASKED["under_condition"][1]),
    "query_relation": ([("Find", [], ["one"]), ("Relate", [0], ["placed_by", "backward"]), ("QueryRelation", [1, 0], [])], ASKED["query_relation"][1]),
    "query_relation_qualifier": ([*ORDERED, ("Find", [], ["seven"]), ("QueryRelationQualifier", [1, 2], ["contains", "linestatus"])], ASKED["relation_qualifier"][1]),
    "verify_num": ([*THREE, ("QueryAttr", [1], ["acctbal"]), ("VerifyNum", [2], ["-900 USD", "<"])], ASKED["verify"][1]),
    "select_between": ([("Find", [], ["five"]), ("Find", [], ["six"]), ("SelectBetween", [0, 1], ["acctbal", "less"])], ASKED["select_between"][1]),
    "select_among": ([*THREE, ("SelectAmong", [1], ["acctbal", "largest"])], ASKED["select_among"][1]),
    "what": ([*THREE, ("What", [1], [])], _entities("'customer:' || c_custkey AS v FROM customer WHERE c_nationkey = 3")),
}


def _functional(steps: list[tuple[str, list[int], list[str]]]) -> Callable[[SparkSession, str], DataFrame]:
    given = [{"function": f, "dependencies": d, "inputs": i} for f, d, i in steps]
    return lambda spark, folder: execute(star_schema(spark, folder), kopl.Importer(NAMES, KINDS).convert(given))


for _name, (_steps, _sql) in FUNCTIONAL.items():
    QUERIES[f"kopl_{_name}"], ORACLES[f"kopl_{_name}"] = _functional(_steps), _sql


def _query(sql: str):
    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return wrap


def _rows(spark: SparkSession, rows: list[tuple[Any, ...]], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@_query("SELECT 'count' AS kind, CAST(count(*) AS VARCHAR) AS value FROM (SELECT DISTINCT doc_id FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE trim(line, ' ') <> '' AND list_contains(regexp_extract_all(lower(coalesce(source, '') || ' ' || line), '[\\p{L}\\p{N}]+'), 'lighthouse') AND doc_id = -1)")
def script_passage_count(spark: SparkSession, folder: str) -> DataFrame:
    """A filter and a count on the pages of a passage search: no page is an entity of this graph with that type."""
    ops = [
        {"op": "search_passage", "query": "lighthouse", "limit": 5, "out": "h0"}, {"op": "passage_pages", "in": "h0", "out": "h1"},
        {"op": "filter_type", "in": "h1", "type_id": "region", "out": "h2"}, {"op": "count", "in": "h2", "out": "h3"}, {"op": "emit", "in": "h3"},
    ]
    return script.execute(star_schema(spark, folder), {"version": "0.2", "ops": ops}).answers


@_query("SELECT 'in_region' AS relation_id, 'in region' AS label UNION SELECT 'lives_in', 'lives in' UNION SELECT 'nothing', 'nothing'")
def kg_relation_info(spark: SparkSession, folder: str) -> DataFrame:
    ids = spark.createDataFrame([("in_region",), ("lives_in",), ("nothing",)], "relation_id string")
    return primitives.relation_infos(star_schema(spark, folder), ids)


@_query("SELECT 'entity' AS kind, 'customer:' || c_custkey AS value FROM (SELECT c_custkey FROM customer UNION ALL SELECT NULL LIMIT 0) UNION SELECT 'entity', v FROM (SELECT v FROM (SELECT 'customer:' || c_custkey AS v FROM customer UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'order:' || o_orderkey FROM orders UNION SELECT 'part:' || p_partkey FROM part UNION SELECT 'region:' || r_regionkey FROM region UNION SELECT 'supplier:' || s_suppkey FROM supplier) ORDER BY v LIMIT 50) WHERE v IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def kg_filter_of_first_entities(spark: SparkSession, folder: str) -> DataFrame:
    """A filter over the ordered, limited universe."""
    return execute(star_schema(spark, folder), FilterType(AllEntities(50), "segment:BUILDING"))


@_query("SELECT 'entity' AS kind, 'nation:' || n_nationkey AS value FROM nation WHERE n_regionkey = 2 AND n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)")
def kg_removal_what_if(spark: SparkSession, folder: str) -> DataFrame:
    c = star_schema(spark, folder)
    first = Compiler(c).entities(Hop(Entity("region:2"), "in_region", "in")).select(F.col("entity_id").alias("subject"), F.lit("in_region").alias("relation"), F.lit("region:2").alias("object"), F.split_part("entity_id", F.lit(":"), F.lit(2)).cast("int").alias("k")).orderBy("k").limit(1)
    return trace.removed(c, Hop(Entity("region:2"), "in_region", "in"), first)


@_query("SELECT 'entity' AS kind, 'nation:' || n_nationkey AS value FROM nation WHERE n_regionkey = 2")
def kg_marked_program(spark: SparkSession, folder: str) -> DataFrame:
    """A program carried by SPARQL text, with ids as IRIs and back."""
    prefixes = {"r": "urn:rel:"}
    whole = rewrite.expanded(Hop(Entity("region:2"), "r:in_region", "in"), prefixes)
    node = rewrite.compacted(rewrite.unmarked(rewrite.marked(whole)), prefixes)
    return execute(star_schema(spark, folder), rewrite.renamed(node, lambda i: i.removeprefix("r:")))


@_query("SELECT CAST(k AS INT) AS index, op, CAST(total AS BIGINT) AS total, first FROM (SELECT 0 AS k, 'resolve_entity' AS op, 1 AS total, 'region:2' AS first UNION SELECT 1, 'follow', count(*), min('nation:' || n_nationkey) FROM nation WHERE n_regionkey = 2 UNION SELECT 2, 'follow', count(*), min('customer:' || c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)")
def script_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The steps of a script, how many values each made and the first of them."""
    asked = script.raise_program(Hop(Hop(Entity("region:2"), "in_region", "in"), "lives_in", "in"))
    run = script.Executor(star_schema(spark, folder), max_returned=MANY, max_edge_visits=MANY).run(asked, trace=8)
    return _rows(spark, [(s.index, s.op, s.total, s.values[0]) for s in run.steps], "index int, op string, total long, first string")


@_query("SELECT CAST(k AS INT) AS call, CAST(n AS BIGINT) AS answers, '' AS reasons FROM (SELECT 0 AS k, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_suppkey = 1 UNION SELECT 1, count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = 2)")
def program_trace(spark: SparkSession, folder: str) -> DataFrame:
    """A program with two branches as calls of the query tool, called again."""
    c = star_schema(spark, folder)
    made = trace.compile_trace(c, ASKED["intersect"][0], entities=MANY)
    reasons = ",".join(made.reasons + trace.replay(c, made, MANY))
    return _rows(spark, [(k, len(call.answers), reasons) for k, call in enumerate(made.calls)], "call int, answers long, reasons string")


@_query("SELECT 'hop1' AS family, CAST(1 AS BIGINT) AS programs UNION SELECT 'hop2', 1 UNION SELECT 'count', 1 UNION SELECT 'intersect', 1 UNION SELECT 'filter_type', 1 UNION SELECT 'filter_literal', 1")
def program_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Random programs, one per family (a program or the reason why there is none)."""
    rows = trace.sample(star_schema(spark, folder), 6, 42)
    return _rows(spark, [(f, int((p is None) != (r is None))) for f, p, r in rows], "family string, programs long")


@_query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), h1 AS (SELECT 'hop1' AS family, 'order:' || o AS entity_id, NULL AS type_id, count(*) AS size FROM l GROUP BY o)
SELECT family, entity_id, type_id, CAST(size AS INT) AS size FROM h1 UNION ALL SELECT 'count', entity_id, NULL, 1 FROM h1
UNION ALL SELECT 'type_filter', 'order:' || o, t, CAST(count(*) AS INT) FROM (SELECT o, p_partkey, unnest(['part', 'brand:' || p_brand, 'ptype:' || p_type]) AS t FROM l JOIN part ON p = p_partkey) GROUP BY o, t""")
def candidate_families(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks about all orders along one relation; parts lead nowhere by it, so there are no two steps."""
    c = star_schema(spark, folder)
    return exports.candidates(c, Compiler(c).entities(ORDERS), "contains").select("family", "entity_id", "type_id", "size")


@_query("WITH d AS (SELECT 'supplier:' || s_suppkey AS entity_id, 1 + (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) + (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS degree FROM supplier WHERE s_nationkey <> 3) SELECT entity_id, CAST(degree AS BIGINT) AS degree FROM d WHERE degree BETWEEN 2 AND 100000 ORDER BY sha256('11|' || entity_id), entity_id LIMIT 20")
def graph_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty suppliers outside one nation by hash priority, within a window of degrees."""
    c = star_schema(spark, folder)
    return exports.graph_seeds(c, 20, 11, 2, 100_000, Compiler(c).entities(Hop(Entity("nation:3"), "located_in", "in")), "supplier:")


@_query("SELECT relation_id, label FROM (SELECT unnest(['in_region', 'lives_in', 'located_in', 'placed_by', 'contains', 'shipped_by', 'supplies']) AS relation_id, unnest(['in region', 'lives in', 'located in', 'placed by', 'contains', 'shipped by', 'supplies']) AS label) UNION SELECT r, r FROM (SELECT unnest(['acctbal', 'size', 'retailprice', 'brand', 'ptype', 'segment', 'totalprice', 'status', 'priority', 'orderdate', 'quantity', 'discount', 'shipdate', 'returnflag', 'linestatus']) AS r)")
def graph_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The relation catalogue of a whole graph: edges, attributes and qualifiers, each once."""
    return exports.graph_relations(star_schema(spark, folder))


@_query("SELECT 'customer:' || c_custkey AS entity_id, c_name AS reference FROM customer UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region")
def unique_references(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that name one entity alone."""
    entities = star_schema(spark, folder).entities.filter(F.split_part("entity_id", F.lit(":"), F.lit(1)).isin("customer", "nation", "region"))
    return exports.references(entities)


@_query("SELECT 'supplier:' || s_suppkey AS entity_id, '{\"entity_id\":\"supplier:' || s_suppkey || '\",\"label\":\"' || s_name || '\",\"type_ids\":[\"supplier\"],\"out_relations\":[\"supplies\"],\"in_relations\":[\"shipped_by\"]}' AS seed FROM supplier WHERE s_nationkey = 3 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def seed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What is known about starting entities as JSON text, relations limited to a catalogue."""
    c = star_schema(spark, folder)
    ids = Compiler(c).entities(Intersect((Hop(Entity("nation:3"), "located_in", "in"), Hop(ORDERS, "shipped_by"))))
    return exports.seed_payload(primitives.seed_context(c, ids, 1_000_000, allowed=["shipped_by", "supplies"]))

