"""Queries of the graph engine over the star-schema graph, each with hand-written SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators import primitives, search, verify
from graphweft.operators.algebra import Compiler, execute
from graphweft.plans import compact, kopl, rewrite, script
from graphweft.plans.model import (
    AllEntities, Count, Entity, FilterLiteral, FilterQualifier, FilterType, Hop, Intersect, Literal, Node, QueryAttribute,
    QueryAttributeQualifier, QueryAttributeUnderCondition, QueryRelation, QueryRelationQualifier, SelectAmong, SelectBetween, Union, Verify,
)
from graphweft.sources.catalog import star_schema
from graphweft.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ALL = AllEntities()


def _program(name: str, program: Node | Callable[[SparkSession, str], Node], sql: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        node = program if isinstance(program, Node) else program(spark, folder)
        return execute(star_schema(spark, folder), node)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _ids(expression: str) -> str:
    return f"SELECT 'entity' AS kind, entity_id AS value FROM (SELECT DISTINCT {expression})"


def _query(sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


ASIA = Count(Hop(Hop(Entity("region:2"), "in_region", "in"), "lives_in", "in"))
ASIA_SQL = "SELECT 'count' AS kind, CAST(count(*) AS VARCHAR) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"
USD = "quantity", "USD"
_program("kg_hop2_count", ASIA, ASIA_SQL)
_program("kg_hop1_out", Hop(Entity("supplier:7"), "supplies"), _ids("'part:' || l_partkey AS entity_id FROM lineitem WHERE l_suppkey = 7"))
_program("kg_hop1_in", Hop(Entity("nation:3"), "lives_in", "in"), _ids("'customer:' || c_custkey AS entity_id FROM customer WHERE c_nationkey = 3"))
_program("kg_hop_attribute", Hop(FilterType(ALL, "customer"), "segment"), _ids("c_mktsegment AS entity_id FROM customer"))
_program(
    "kg_intersect", Intersect((Hop(Entity("supplier:1"), "supplies"), Hop(Entity("supplier:2"), "supplies"))),
    _ids("'part:' || a.l_partkey AS entity_id FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = 1 AND b.l_suppkey = 2"),
)
_program("kg_union", Union((Hop(Entity("supplier:1"), "supplies"), Hop(Entity("supplier:2"), "supplies"), Entity("part:1"))), _ids("'part:' || k AS entity_id FROM (SELECT l_partkey AS k FROM lineitem WHERE l_suppkey IN (1, 2) UNION SELECT 1)"))
_program("kg_all_entities_limited", AllEntities(10), "SELECT 'entity' AS kind, id AS value FROM (SELECT 'region:' || r_regionkey AS id FROM region UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'customer:' || c_custkey FROM customer UNION SELECT 'supplier:' || s_suppkey FROM supplier UNION SELECT 'part:' || p_partkey FROM part UNION SELECT 'order:' || o_orderkey FROM orders) ORDER BY id LIMIT 10")
_program("kg_filter_type", FilterType(ALL, "segment:BUILDING"), _ids("'customer:' || c_custkey AS entity_id FROM customer WHERE c_mktsegment = 'BUILDING'"))
_program("kg_filter_literal_qty", FilterLiteral(ALL, "acctbal", "gt", Literal(5000, *USD)), _ids("i AS entity_id FROM (SELECT 'customer:' || c_custkey AS i FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 5000 UNION SELECT 'supplier:' || s_suppkey FROM supplier WHERE CAST(s_acctbal AS DECIMAL(18,2)) > 5000)"))
_program("kg_filter_literal_date", FilterLiteral(ALL, "orderdate", "ge", Literal("1996/06/15", "date")), _ids("'order:' || o_orderkey AS entity_id FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-06-15'"))
_program("kg_filter_literal_year", FilterLiteral(ALL, "orderdate", "eq", Literal(1995, "year")), _ids("'order:' || o_orderkey AS entity_id FROM orders WHERE year(o_orderdate) = 1995"))
_program("kg_filter_literal_contains", FilterLiteral(ALL, "ptype", "contains", Literal("prom")), _ids("'part:' || p_partkey AS entity_id FROM part WHERE contains(lower(p_type), 'prom')"))
_program("kg_filter_literal_text_target", FilterLiteral(ALL, "acctbal", "le", Literal("100 USD")), _ids("i AS entity_id FROM (SELECT 'customer:' || c_custkey AS i FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) <= 100 UNION SELECT 'supplier:' || s_suppkey FROM supplier WHERE CAST(s_acctbal AS DECIMAL(18,2)) <= 100)"))
_program("kg_filter_literal_ne_unit_mismatch", FilterLiteral(ALL, "acctbal", "ne", Literal(1, "quantity", "EUR")), _ids("'customer:' || c_custkey AS entity_id FROM customer WHERE false"))
_program("kg_filter_literal_ne", FilterLiteral(ALL, "segment", "ne", Literal("BUILDING")), _ids("'customer:' || c_custkey AS entity_id FROM customer WHERE c_mktsegment <> 'BUILDING'"))
_program(
    "kg_filter_unit_mismatch_or_match", Union((FilterLiteral(ALL, "acctbal", "ne", Literal(1, "quantity", "EUR")), FilterLiteral(ALL, "acctbal", "lt", Literal(0, *USD)))),
    _ids("i AS entity_id FROM (SELECT 'customer:' || c_custkey AS i FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0 UNION SELECT 'supplier:' || s_suppkey FROM supplier WHERE CAST(s_acctbal AS DECIMAL(18,2)) < 0)"),
)
_program("kg_relation_of_order", QueryRelation(FilterType(ALL, "order"), Union((Entity("part:1"), Entity("customer:1"), Entity("supplier:1")))), "SELECT DISTINCT 'literal' AS kind, r AS value FROM (SELECT 'contains' AS r FROM lineitem WHERE l_partkey = 1 UNION SELECT 'placed_by' FROM orders WHERE o_custkey = 1 UNION SELECT 'shipped_by' FROM lineitem WHERE l_suppkey = 1)")
_program("kg_filter_qualifier_qty", FilterQualifier(Hop(FilterType(ALL, "order"), "contains"), "quantity", "ge", Literal(50, "quantity")), _ids("'part:' || l_partkey AS entity_id FROM lineitem WHERE CAST(l_quantity AS DECIMAL(18,2)) >= 50"))
_program("kg_filter_qualifier_date", FilterQualifier(Hop(FilterType(ALL, "part"), "contains", "in"), "shipdate", "lt", Literal("1995/03/01", "date")), _ids("'order:' || l_orderkey AS entity_id FROM lineitem WHERE CAST(l_shipdate AS DATE) < DATE '1995-03-01'"))
_program("kg_filter_qualifier_literal", FilterQualifier(FilterLiteral(ALL, "totalprice", "gt", Literal(200000, *USD)), "status", "eq", Literal("F")), _ids("'order:' || o_orderkey AS entity_id FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 200000 AND o_orderstatus = 'F'"))
_program("kg_attr", QueryAttribute(Hop(Entity("nation:3"), "lives_in", "in"), "acctbal"), "SELECT DISTINCT 'literal' AS kind, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || ' USD' AS value FROM customer WHERE c_nationkey = 3")
_program("kg_attr_date", QueryAttribute(Hop(Entity("customer:1"), "placed_by", "in"), "orderdate"), "SELECT DISTINCT 'literal' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders WHERE o_custkey = 1")
_program("kg_attr_under_cond", QueryAttributeUnderCondition(FilterType(ALL, "order"), "totalprice", "orderdate", Literal(1997, "year")), "SELECT DISTINCT 'literal' AS kind, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' USD' AS value FROM orders WHERE year(o_orderdate) = 1997")


def _dearest(spark: SparkSession, folder: str) -> Node:
    price = table(spark, folder, "orders").agg(F.max(F.col("o_totalprice").cast("decimal(18,2)"))).first()[0]
    return QueryAttributeQualifier(FilterType(ALL, "order"), "totalprice", Literal(f"{price} USD"), "status")


_program("kg_attr_qualifier", _dearest, "SELECT DISTINCT 'literal' AS kind, o_orderstatus AS value FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) = (SELECT max(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)")
_program("kg_relation", QueryRelation(FilterType(ALL, "order"), FilterType(ALL, "part")), "SELECT DISTINCT 'literal' AS kind, 'contains' AS value FROM lineitem")
_program("kg_relation_qualifier", QueryRelationQualifier(FilterType(ALL, "order"), Entity("part:1"), "contains", "returnflag"), "SELECT DISTINCT 'literal' AS kind, l_returnflag AS value FROM lineitem WHERE l_partkey = 1")
_program("kg_verify_num", Verify(QueryAttribute(FilterType(ALL, "customer"), "acctbal"), "gt", Literal(9000, *USD)), "SELECT 'literal' AS kind, CASE WHEN max(CAST(c_acctbal AS DECIMAL(18,2))) > 9000 THEN 'yes' ELSE 'no' END AS value FROM customer")
_program("kg_verify_empty", Verify(QueryAttribute(Entity("region:0"), "acctbal"), "gt", Literal(0, *USD)), "SELECT 'literal' AS kind, 'no' AS value")
_program("kg_select_among_max", SelectAmong(FilterType(ALL, "part"), "size", "max"), "SELECT 'entity' AS kind, 'part:' || p_partkey AS value FROM part ORDER BY p_size DESC, 'part:' || p_partkey DESC LIMIT 1")
_program("kg_select_among_min", SelectAmong(FilterType(ALL, "part"), "size", "min"), "SELECT 'entity' AS kind, 'part:' || p_partkey AS value FROM part ORDER BY p_size, 'part:' || p_partkey LIMIT 1")
_program("kg_select_between", SelectBetween(Entity("customer:1"), Entity("customer:2"), "acctbal", "max"), "SELECT 'entity' AS kind, 'customer:' || c_custkey AS value FROM customer WHERE c_custkey IN (1, 2) ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1")


@_query("SELECT 'entity' AS kind, 'nation:' || n_nationkey AS value FROM nation WHERE n_regionkey = 2 AND n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) UNION SELECT 'entity', 'nation:new'")
def kg_overlay_diff(spark: SparkSession, folder: str) -> DataFrame:
    c = star_schema(spark, folder)
    first = table(spark, folder, "nation").filter("n_regionkey = 2").agg(F.min("n_nationkey")).first()[0]
    schema = "subject string, relation string, object string"
    changed = c.overlay(spark.createDataFrame([("nation:new", "in_region", "region:2")], schema), spark.createDataFrame([(f"nation:{first}", "in_region", "region:2")], schema))
    return execute(changed, Hop(Entity("region:2"), "in_region", "in"))


def _ids_of(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "entity_id string")


EDGES_SQL = """WITH edges AS (SELECT 'nation:' || n_nationkey AS subject, 'in_region' AS relation, 'region:' || n_regionkey AS object FROM nation
  UNION SELECT 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
  UNION SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
  UNION SELECT 'order:' || l_orderkey, 'shipped_by', 'supplier:' || l_suppkey FROM lineitem
  UNION SELECT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey FROM lineitem)
"""


@_query(EDGES_SQL + "SELECT subject, relation, object FROM edges WHERE (subject = 'nation:3' OR object = 'nation:3') ORDER BY ALL LIMIT 40")
def kg_neighbors_both(spark: SparkSession, folder: str) -> DataFrame:
    names = "in_region lives_in located_in placed_by contains shipped_by supplies".split()
    return primitives.neighbors(star_schema(spark, folder), _ids_of(spark, "nation:3"), "both", names, 40)


@_query("SELECT 'customer:' || c_custkey AS subject, 'segment' AS relation, c_mktsegment AS object FROM customer WHERE c_nationkey = 3 ORDER BY ALL LIMIT 25")
def kg_attribute_facts(spark: SparkSession, folder: str) -> DataFrame:
    c = star_schema(spark, folder)
    return primitives.attribute_facts(c, Compiler(c).entities(Hop(Entity("nation:3"), "lives_in", "in")), ["segment"], 25)


@_query(EDGES_SQL + "SELECT 'supplier:' || s_suppkey AS entity_id, (SELECT count(*) FROM edges WHERE subject = 'supplier:' || s_suppkey) + (SELECT count(*) FROM edges WHERE object = 'supplier:' || s_suppkey) AS degree FROM supplier")
def kg_degrees(spark: SparkSession, folder: str) -> DataFrame:
    c = star_schema(spark, folder)
    return primitives.degrees(c, Compiler(c).entities(FilterType(ALL, "supplier")))


@_query(EDGES_SQL + "SELECT DISTINCT relation, 'out' AS direction FROM edges WHERE subject = 'supplier:1' UNION SELECT 'acctbal', 'out' UNION SELECT DISTINCT relation, 'in' FROM edges WHERE object = 'supplier:1'")
def kg_relation_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return primitives.relation_frontier(star_schema(spark, folder), _ids_of(spark, "supplier:1"))


@_query("SELECT 'customer:' || c_custkey AS entity_id, c_name AS label, 'customer,segment:' || c_mktsegment AS type_ids FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'nobody', 'nobody', ''")
def kg_entity_info(spark: SparkSession, folder: str) -> DataFrame:
    c = star_schema(spark, folder)
    ids = Compiler(c).entities(Hop(Entity("nation:3"), "lives_in", "in")).unionByName(_ids_of(spark, "nobody"))
    return primitives.infos(c, ids).withColumn("type_ids", F.array_join("type_ids", ","))


@_query("SELECT 'nation:' || n_nationkey AS entity_id, n_name AS label FROM nation WHERE lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3)")
def kg_resolve_exact(spark: SparkSession, folder: str) -> DataFrame:
    name = table(spark, folder, "nation").filter("n_nationkey = 3").first().n_name
    return primitives.resolve(star_schema(spark, folder), name.swapcase())


@_query("SELECT 'nation:' || n_nationkey AS subject, 'in_region' AS relation, 'region:2' AS object FROM nation WHERE n_regionkey = 2 UNION SELECT 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def kg_witness(spark: SparkSession, folder: str) -> DataFrame:
    return primitives.evidence(star_schema(spark, folder), ASIA)


@_query("SELECT 'nation:' || n_nationkey AS subject, 'in_region' AS relation, 'region:2' AS object, false AS truncated FROM nation WHERE n_regionkey = 2")
def kg_materialize_slice(spark: SparkSession, folder: str) -> DataFrame:
    return primitives.materialize(star_schema(spark, folder), Hop(Entity("region:2"), "in_region", "in"))


@_query("SELECT 'supplier:' || s_suppkey AS entity_id, s_name AS label, 'located_in,supplies' AS out_relations, 'shipped_by' AS in_relations FROM supplier WHERE s_nationkey = 3 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def kg_seed_context(spark: SparkSession, folder: str) -> DataFrame:
    c = star_schema(spark, folder)
    ids = Compiler(c).entities(Intersect((Hop(Entity("nation:3"), "located_in", "in"), Hop(FilterType(ALL, "order"), "shipped_by"))))
    out = primitives.seed_context(c, ids, edges_each=1_000_000)
    return out.select("entity_id", "label", F.array_join("out_relations", ",").alias("out_relations"), F.array_join("in_relations", ",").alias("in_relations"))


@_query("SELECT 'entity' AS kind, 'region:' || n_regionkey AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def script_v01_two_hops(spark: SparkSession, folder: str) -> DataFrame:
    text = '{"version": "0.1", "ops": [{"op": "start", "in": "$seed", "out": "h0"}, {"op": "follow", "in": "h0", "relation": "lives_in", "direction": "out", "limit": 5, "out": "h1"}, {"op": "follow", "in": "h1", "relation": "in_region", "direction": "out", "limit": 5, "out": "h2"}, {"op": "require_unique", "in": "h2"}, {"op": "emit", "in": "h2"}]}'
    return script.execute(star_schema(spark, folder), text, seed="customer:1").answers


@_query(ASIA_SQL)
def script_v03_count(spark: SparkSession, folder: str) -> DataFrame:
    return script.execute(star_schema(spark, folder), script.raise_program(ASIA)).answers


@_query("SELECT 'entity' AS kind, 'customer:' || c_custkey AS value FROM customer WHERE c_nationkey = 3 AND CAST(c_acctbal AS DECIMAL(18,2)) > -999")
def script_v02_filters(spark: SparkSession, folder: str) -> DataFrame:
    ops = [
        {"op": "resolve_entity", "query": "nation:3", "match": "id", "out": "h0"},
        {"op": "follow", "in": "h0", "relation": "lives_in", "direction": "in", "out": "h1"},
        {"op": "filter_type", "in": "h1", "type_id": "customer", "out": "h2"},
        {"op": "filter_literal", "in": "h2", "relation": "acctbal", "comparator": "gt", "value": {"value": -999, "datatype": "quantity", "unit": "USD"}, "out": "h3"},
        {"op": "emit", "in": "h3"},
    ]
    return script.execute(star_schema(spark, folder), {"version": "0.2", "ops": ops}, max_returned=1_000_000).answers


@_query("WITH a AS (SELECT 'customer:' || c_custkey AS value FROM customer WHERE c_nationkey = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) SELECT 'entity' AS kind, value, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a) > 5 AS truncated FROM a ORDER BY value LIMIT 5")
def compact_filter_types(spark: SparkSession, folder: str) -> DataFrame:
    steps = [{"op": "hop", "relation": "lives_in", "direction": "in"}, {"op": "filter_type", "type_ids": ["segment:BUILDING", "segment:MACHINERY"]}]
    return compact.execute(star_schema(spark, folder), {"root": {"entities": ["nation:3"]}, "steps": steps}, 5)


@_query("SELECT 'literal' AS kind, CASE WHEN max(CAST(c_acctbal AS DECIMAL(18,2))) > 9000 THEN 'yes' ELSE 'no' END AS value, CAST(1 AS BIGINT) AS total, false AS truncated FROM customer WHERE c_nationkey = 3")
def compact_verify(spark: SparkSession, folder: str) -> DataFrame:
    steps = [{"op": "hop", "relation": "lives_in", "direction": "in"}, {"op": "query_attribute", "attribute": "acctbal"}, {"op": "verify", "comparator": "gt", "value": {"value": 9000, "datatype": "quantity", "unit": "USD"}}]
    return compact.execute(star_schema(spark, folder), {"root": {"entities": ["nation:3"]}, "steps": steps})


@_query(ASIA_SQL)
def kopl_count(spark: SparkSession, folder: str) -> DataFrame:
    names = {r.r_name: [f"region:{r.r_regionkey}"] for r in table(spark, folder, "region").collect()}
    name = next(n for n, i in names.items() if i == ["region:2"])
    steps = [
        {"function": "Find", "dependencies": [], "inputs": [name]},
        {"function": "Relate", "dependencies": [0], "inputs": ["in_region", "backward"]},
        {"function": "Relate", "dependencies": [1], "inputs": ["lives_in", "backward"]},
        {"function": "Count", "dependencies": [2], "inputs": []},
    ]
    return execute(star_schema(spark, folder), kopl.Importer(names, {}).convert(steps))


@_query("SELECT 'entity' AS kind, 'order:' || o_orderkey AS value FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 300000 AND year(o_orderdate) < 1998")
def kopl_filters(spark: SparkSession, folder: str) -> DataFrame:
    steps = [
        {"function": "FindAll", "dependencies": [], "inputs": []},
        {"function": "FilterConcept", "dependencies": [0], "inputs": ["order"]},
        {"function": "FilterNum", "dependencies": [1], "inputs": ["totalprice", "300000 USD", ">"]},
        {"function": "FilterYear", "dependencies": [2], "inputs": ["orderdate", "1998", "<"]},
        {"function": "What", "dependencies": [3], "inputs": []},
    ]
    return execute(star_schema(spark, folder), kopl.Importer({}, {"order": ["order"]}).convert(steps))


CONDITIONS = Intersect((Hop(Entity("nation:3"), "lives_in", "in"), FilterType(ALL, "segment:BUILDING")))


@_query("""WITH n AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3), s AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'),
g AS (SELECT k FROM n INTERSECT SELECT k FROM s), a AS (SELECT 0 AS ablation, (SELECT count(*) FROM s) AS m UNION ALL SELECT 1, (SELECT count(*) FROM n) UNION ALL SELECT 2, 0
UNION ALL SELECT 3, (SELECT count(*) FROM n))
SELECT ablation, CASE WHEN ablation = 2 THEN (SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE 0.0 END FROM g) ELSE round((SELECT count(*) FROM g) / greatest(m, 1)::DOUBLE, 6) END AS similarity FROM a""")
def necessity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return verify.necessity(star_schema(spark, folder), CONDITIONS).select("ablation", F.round("similarity", 6).alias("similarity"))


@_query()
def shortcut_search(spark: SparkSession, folder: str) -> DataFrame:
    found = verify.shortcut(star_schema(spark, folder), Hop(Hop(Entity("customer:1"), "lives_in"), "in_region"))
    return spark.createDataFrame([(found is False, str(found))], "none boolean, program string")


@_query("SELECT 'nation:' || n_nationkey AS entity_id, strpos(' which customers live in canada or in the united kingdom ', ' ' || trim(regexp_replace(lower(n_name), '[^a-z0-9_]+', ' ', 'g')) || ' ') > 0 AS leaked FROM nation")
def answer_leak(spark: SparkSession, folder: str) -> DataFrame:
    nations = star_schema(spark, folder).entities.filter(F.col("entity_id").startswith("nation:"))
    return nations.select("entity_id", verify.leaks(F.lit("Which customers live in Canada, or in the United Kingdom?"), F.col("label"), F.col("aliases")).alias("leaked"))


@_query("""WITH k AS (SELECT node_id, min(name) AS label FROM kb WHERE regexp_full_match(name, '[ -~]*[a-z][ -~]*') GROUP BY node_id), b AS (SELECT DISTINCT example_id, question, topic_entity_ids[1] AS node_id FROM benchmark_examples WHERE regexp_full_match(question, '[ -~]*'))
SELECT example_id, strpos(' ' || trim(regexp_replace(lower(question), '[^a-z0-9_]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(label), '[^a-z0-9_]+', ' ', 'g')) || ' ') > 0 AS leaked FROM b JOIN k USING (node_id)""")
def names_in_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the name of its first topic stands in a question, for questions and names in plain letters."""
    names = table(spark, folder, "kb", "node_id", "name").filter("name rlike '^[ -~]*[a-z][ -~]*$'").groupBy("node_id").agg(F.min("name").alias("label"))
    rows = table(spark, folder, "benchmark_examples", "example_id", "question", "topic_entity_ids").filter("question rlike '^[ -~]*$'").distinct()
    rows = rows.select("example_id", "question", F.try_element_at("topic_entity_ids", F.lit(1)).alias("node_id")).join(names, "node_id")
    return rows.select("example_id", verify.leaks(F.col("question"), F.col("label"), F.lit(None).cast("array<string>")).alias("leaked"))


QUERY = "access denied lighthouse saffron"
SPOKEN = "menschen über habitants впервые музей"


@_query(f"""WITH lines AS (SELECT doc_id, u.i - 1 AS paragraph_id, s[u.i] AS text, source FROM (SELECT doc_id, string_split(text, chr(10)) AS s, source FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(s))) AS u(i)),
p AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, paragraph_id, list_concat(regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9]+'), regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM lines WHERE trim(text, ' ') <> ''),
q AS (SELECT DISTINCT unnest(string_split('{QUERY}', ' ')) AS w), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM p),
tf AS (SELECT page_id, paragraph_id, w, len([x for x in t if x = w]) AS tf, len(t) AS dl FROM p, q),
df AS (SELECT w, count(*) AS df FROM tf WHERE tf > 0 GROUP BY w)
SELECT page_id, CAST(paragraph_id AS BIGINT) AS paragraph_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (w), st WHERE tf > 0 GROUP BY page_id, paragraph_id ORDER BY score DESC, page_id, paragraph_id LIMIT 10""")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(star_schema(spark, folder).passages, QUERY, token=search.PLAIN).select("page_id", "paragraph_id", F.round("score", 6).alias("score"))


@_query(f"""WITH lines AS (SELECT doc_id, u.i - 1 AS paragraph_id, s[u.i] AS text, source FROM (SELECT doc_id, string_split(text, chr(10)) AS s, source FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(s))) AS u(i)),
p AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, paragraph_id, list_concat(regexp_extract_all(lower(coalesce(source, '')), '[\\p{{L}}\\p{{N}}]+'), regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM lines WHERE trim(text, ' ') <> ''),
q AS (SELECT DISTINCT unnest(string_split('{SPOKEN}', ' ')) AS w), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM p),
tf AS (SELECT page_id, paragraph_id, w, len([x for x in t if x = w]) AS tf, len(t) AS dl FROM p, q),
df AS (SELECT w, count(*) AS df FROM tf WHERE tf > 0 GROUP BY w)
SELECT page_id, CAST(paragraph_id AS BIGINT) AS paragraph_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (w), st WHERE tf > 0 GROUP BY page_id, paragraph_id ORDER BY score DESC, page_id, paragraph_id LIMIT 10""")
def bm25_topk_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """The best passages for words of several scripts."""
    return search.search(star_schema(spark, folder).passages, SPOKEN).select("page_id", "paragraph_id", F.round("score", 6).alias("score"))


@_query()
def program_analytics(spark: SparkSession, folder: str) -> DataFrame:
    """Signature, cost, operators, roots, words and SPARQL of programs: text about plans, no data."""
    programs = [ASIA, CONDITIONS, SelectAmong(FilterType(ALL, "part"), "size")]
    rows = [(rewrite.signature(p), rewrite.cost(p), ",".join(rewrite.operators(p)), ",".join(rewrite.topic_roots(p)), rewrite.verbalize(p), rewrite.sparql(p)) for p in programs]
    return spark.createDataFrame(rows, "signature string, cost double, operators string, roots string, words string, sparql string")
