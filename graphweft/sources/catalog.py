"""A graph as named DataFrames, and where graphs come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.values import formatted, typed
from graphweft.session import table

VALUE = "value string, datatype string, unit string"


@dataclass(frozen=True)
class GraphCatalog:
    """``entities`` (entity_id, label, aliases), ``entity_types`` (entity_id, type_id), ``edges`` (subject, relation, object),
    ``attributes`` (entity_id, key, value, datatype, unit and typed columns), ``facts`` (fact_id, kind, subject, predicate,
    object_entity, value ...), ``qualifiers`` (fact_id, key, value ...), ``relation_labels`` (relation_id, label), ``passages``
    (page_id, paragraph_id, title, text).  Graphs without qualified facts have empty ``facts`` and ``qualifiers``."""

    spark: SparkSession
    entities: DataFrame
    entity_types: DataFrame
    edges: DataFrame
    attributes: DataFrame
    facts: DataFrame
    qualifiers: DataFrame
    relation_labels: DataFrame
    passages: DataFrame

    @property
    def triples(self) -> DataFrame:
        """Edges, and attributes as edges to their formatted value; repeats are left in."""
        own = self.attributes.select(F.col("entity_id").alias("subject"), F.col("key").alias("relation"), formatted().alias("object"))
        return self.edges.unionByName(own)

    def overlay(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> GraphCatalog:
        """The graph as it would be: edges without ``removed`` and with ``added``."""
        edges = self.edges
        if removed is not None:
            edges = edges.join(removed, ["subject", "relation", "object"], "left_anti")
        if added is not None:
            edges = edges.unionByName(added.select("subject", "relation", "object")).distinct()
        return GraphCatalog(**{**self.__dict__, "edges": edges})


def build(spark: SparkSession, **frames: DataFrame) -> GraphCatalog:
    """A catalog from what there is; missing frames are empty."""
    empty = {
        "entities": "entity_id string, label string, aliases array<string>",
        "entity_types": "entity_id string, type_id string",
        "edges": "subject string, relation string, object string",
        "attributes": f"entity_id string, key string, {VALUE}",
        "facts": f"fact_id string, kind string, subject string, predicate string, object_entity string, {VALUE}",
        "qualifiers": f"fact_id string, key string, {VALUE}",
        "relation_labels": "relation_id string, label string",
        "passages": "page_id string, paragraph_id long, title string, text string",
    }
    out = {name: frames.get(name) if frames.get(name) is not None else spark.createDataFrame([], schema) for name, schema in empty.items()}
    for name in ("attributes", "facts", "qualifiers"):
        out[name] = typed(out[name])
    return GraphCatalog(spark=spark, **out)


# The nine-entity example graph.
EXAMPLE_ENTITIES = [
    ("alice", "Alice", []),
    ("bob", "Bob", []),
    ("cara", "Cara", []),
    ("acme", "Acme", []),
    ("globex", "Globex", []),
    ("paris", "Paris", []),
    ("london", "London", []),
    ("france", "France", []),
    ("uk", "United Kingdom", ["UK"]),
]
EXAMPLE_TYPES = [
    ("alice", "person"),
    ("bob", "person"),
    ("cara", "person"),
    ("acme", "company"),
    ("globex", "company"),
    ("paris", "city"),
    ("london", "city"),
    ("france", "country"),
    ("uk", "country"),
]
EXAMPLE_EDGES = [
    ("alice", "works_at", "acme"),
    ("bob", "works_at", "acme"),
    ("cara", "works_at", "globex"),
    ("alice", "friend", "bob"),
    ("bob", "friend", "cara"),
    ("alice", "friend_of_friend", "cara"),
    ("acme", "located_in", "paris"),
    ("globex", "located_in", "london"),
    ("paris", "country", "france"),
    ("london", "country", "uk"),
]
EXAMPLE_AGES = [("alice", "34"), ("bob", "29"), ("cara", "41")]
# The same, keyed by entity and as text, for callers that look things up.
TOY_ENTITIES = {i: (label, dict(EXAMPLE_TYPES)[i], *aliases) if aliases else (label, dict(EXAMPLE_TYPES)[i], "") for i, label, aliases in EXAMPLE_ENTITIES}
TOY_EDGES = "|".join(" ".join(e) for e in EXAMPLE_EDGES)
TOY_AGES = dict(EXAMPLE_AGES)


def toy(spark: SparkSession) -> GraphCatalog:
    return from_triples(spark, EXAMPLE_EDGES, EXAMPLE_ENTITIES, EXAMPLE_TYPES, [(i, "age", v, "number", None) for i, v in EXAMPLE_AGES])


def from_triples(spark: SparkSession, triples: list, entities: list = (), types: list = (), attributes: list = ()) -> GraphCatalog:
    """A graph held in memory: triples each once and in order; entities (id, label, aliases) that only triples name have their id
    as label."""
    rows = sorted(set(map(tuple, triples)))
    named = {e[0] for e in entities}
    others = sorted({x for s, _, o in rows for x in (s, o)} - named)
    return build(
        spark,
        entities=spark.createDataFrame([*map(tuple, entities), *((i, i, []) for i in others)], "entity_id string, label string, aliases array<string>"),
        entity_types=spark.createDataFrame(sorted(set(map(tuple, types))), "entity_id string, type_id string"),
        edges=spark.createDataFrame(rows, "subject string, relation string, object string"),
        attributes=spark.createDataFrame(list(map(tuple, attributes)), f"entity_id string, key string, {VALUE}"),
    )


def _id(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


_STARS: dict[tuple[str, str], GraphCatalog] = {}


def star_schema(spark: SparkSession, folder: str) -> GraphCatalog:
    """The graph of ``folder``; its plans, not its rows, are kept for the session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STARS:
        _STARS[key] = _star_schema(spark, folder)
    return _STARS[key]


def _star_schema(spark: SparkSession, folder: str) -> GraphCatalog:
    """The graph of an order-processing star schema: regions, nations, customers, suppliers, parts and orders as entities,
    keys as edges, measures as attributes, line items as qualified facts.  Every branch carries its relation, key or kind as a
    constant, so that a filter on it leaves a scan of one table with the columns needed."""
    t = {n: table(spark, folder, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")}
    keys = {"region": ("region", "r_regionkey", "r_name"), "nation": ("nation", "n_nationkey", "n_name"), "customer": ("customer", "c_custkey", "c_name"), "supplier": ("supplier", "s_suppkey", "s_name"), "part": ("part", "p_partkey", "p_name"), "order": ("orders", "o_orderkey", "o_orderkey")}

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    entities = union([t[n].select(_id(k, key).alias("entity_id"), F.col(label).cast("string").alias("label"), F.array().cast("array<string>").alias("aliases")) for k, (n, key, label) in keys.items()])
    types = [t[n].select(_id(k, key).alias("entity_id"), F.lit(k).alias("type_id")) for k, (n, key, _) in keys.items()]
    for prefix, kind, n, key, col in (("segment", "customer", "customer", "c_custkey", "c_mktsegment"), ("brand", "part", "part", "p_partkey", "p_brand"), ("ptype", "part", "part", "p_partkey", "p_type")):
        types.append(t[n].select(_id(kind, key).alias("entity_id"), F.concat(F.lit(f"{prefix}:"), F.col(col)).alias("type_id")))
    edge = lambda n, a, ak, rel, b, bk: t[n].select(_id(a, ak).alias("subject"), F.lit(rel).alias("relation"), _id(b, bk).alias("object"))
    edges = union([
        edge("nation", "nation", "n_nationkey", "in_region", "region", "n_regionkey"),
        edge("customer", "customer", "c_custkey", "lives_in", "nation", "c_nationkey"),
        edge("supplier", "supplier", "s_suppkey", "located_in", "nation", "s_nationkey"),
        edge("orders", "order", "o_orderkey", "placed_by", "customer", "o_custkey"),
        edge("lineitem", "order", "l_orderkey", "contains", "part", "l_partkey").distinct(),
        edge("lineitem", "order", "l_orderkey", "shipped_by", "supplier", "l_suppkey").distinct(),
        edge("lineitem", "supplier", "l_suppkey", "supplies", "part", "l_partkey").distinct(),
    ])
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    day = lambda c: F.date_format(c, "yyyy/MM/dd")
    attribute = lambda n, k, key, name, value, kind, unit=None: t[n].select(_id(k, key).alias("entity_id"), F.lit(name).alias("key"), value.alias("value"), F.lit(kind).alias("datatype"), F.lit(unit).cast("string").alias("unit"))
    attributes = union([
        attribute("customer", "customer", "c_custkey", "acctbal", money("c_acctbal"), "quantity", "USD"),
        attribute("supplier", "supplier", "s_suppkey", "acctbal", money("s_acctbal"), "quantity", "USD"),
        attribute("part", "part", "p_partkey", "size", F.col("p_size").cast("string"), "quantity"),
        attribute("part", "part", "p_partkey", "retailprice", money("p_retailprice"), "quantity", "USD"),
        attribute("part", "part", "p_partkey", "brand", F.col("p_brand"), "string"),
        attribute("part", "part", "p_partkey", "ptype", F.col("p_type"), "string"),
        attribute("customer", "customer", "c_custkey", "segment", F.col("c_mktsegment"), "string"),
        attribute("orders", "order", "o_orderkey", "totalprice", money("o_totalprice"), "quantity", "USD"),
        attribute("orders", "order", "o_orderkey", "status", F.col("o_orderstatus"), "string"),
        attribute("orders", "order", "o_orderkey", "priority", F.col("o_orderpriority"), "string"),
        attribute("orders", "order", "o_orderkey", "orderdate", day("o_orderdate"), "date"),
    ])
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    fact_id = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)
    items = t["lineitem"].withColumn("fact_id", fact_id)
    facts = union([
        items.select("fact_id", F.lit("relation").alias("kind"), _id("order", "l_orderkey").alias("subject"), F.lit("contains").alias("predicate"), _id("part", "l_partkey").alias("object_entity"), *(F.lit(None).cast("string").alias(c) for c in ("value", "datatype", "unit"))),
        t["orders"].select(_id("fact", "o_orderkey").alias("fact_id"), F.lit("attribute").alias("kind"), _id("order", "o_orderkey").alias("subject"), F.lit("totalprice").alias("predicate"), F.lit(None).cast("string").alias("object_entity"), money("o_totalprice").alias("value"), F.lit("quantity").alias("datatype"), F.lit("USD").alias("unit")),
    ])
    qualifier = lambda df, i, name, value, kind: df.select(i.alias("fact_id"), F.lit(name).alias("key"), value.alias("value"), F.lit(kind).alias("datatype"), F.lit(None).cast("string").alias("unit"))
    own = F.col("fact_id")
    qualifiers = union([
        qualifier(items, own, "quantity", money("l_quantity"), "quantity"),
        qualifier(items, own, "discount", money("l_discount"), "quantity"),
        qualifier(items, own, "shipdate", day("l_shipdate"), "date"),
        qualifier(items, own, "returnflag", F.col("l_returnflag"), "string"),
        qualifier(items, own, "linestatus", F.col("l_linestatus"), "string"),
        qualifier(t["orders"], _id("fact", "o_orderkey"), "orderdate", day("o_orderdate"), "date"),
        qualifier(t["orders"], _id("fact", "o_orderkey"), "status", F.col("o_orderstatus"), "string"),
    ])
    lines = t["documents"].select(F.col("doc_id").cast("string").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("paragraph_id", "text"), F.col("source").alias("title"))
    names = "in_region lives_in located_in placed_by contains shipped_by supplies".split()
    labels = spark.createDataFrame([(n, n.replace("_", " ")) for n in names], "relation_id string, label string")
    passages = lines.filter(F.trim("text") != "").select("page_id", F.col("paragraph_id").cast("long").alias("paragraph_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
    return build(spark, entities=entities, entity_types=union(types), edges=edges, attributes=attributes, facts=facts, qualifiers=qualifiers, relation_labels=labels, passages=passages)


_SNAPSHOTS: dict[str, Callable[[SparkSession], GraphCatalog]] = {"toy-v1": toy}


def register(name: str, load: Callable[[SparkSession], GraphCatalog]) -> None:
    _SNAPSHOTS[name] = load


def snapshot(spark: SparkSession, name: str) -> GraphCatalog:
    """A graph by name: a registered one, or ``star:<folder>``, ``parquet:<folder>``, ``kb:<file>``, ``pages:<file>`` and
    ``sqlite:<file>``."""
    kind, _, folder = name.partition(":")
    if folder:
        from graphweft.sources import knowledge, readers

        loaders = {
            "star": star_schema,
            "parquet": from_parquet,
            "kb": knowledge.knowledge_base,
            "pages": lambda s, path: knowledge.pages(s, path)[0],
            "sqlite": readers.sqlite_catalog,
        }
        if kind not in loaders:
            raise KeyError(f"no kind of snapshot named {kind}")
        return loaders[kind](spark, folder)
    if name not in _SNAPSHOTS:
        raise KeyError(f"no snapshot named {name}")
    return _SNAPSHOTS[name](spark)


def save(catalog: GraphCatalog, folder: str) -> None:
    """Writes a graph, laid out for its queries: edges by relation, attributes by key, facts and qualifiers by predicate and key."""
    layout = {"edges": "relation", "attributes": "key", "facts": "predicate", "qualifiers": "key"}
    for name in ("entities", "entity_types", "edges", "attributes", "facts", "qualifiers", "relation_labels", "passages"):
        writer = getattr(catalog, name).write.mode("overwrite")
        (writer.partitionBy(layout[name]) if name in layout else writer).parquet(f"{folder}/{name}.parquet")


def from_parquet(spark: SparkSession, folder: str) -> GraphCatalog:
    names = ("entities", "entity_types", "edges", "attributes", "facts", "qualifiers", "relation_labels", "passages")
    return GraphCatalog(spark=spark, **{n: table(spark, folder, n) for n in names})
