"""Attribute-value rows to one wide row per entity with one typed column per attribute.

Rows are first reduced to one cell per entity and attribute (partial aggregation before any shuffle, so that an entity with
a third of all rows is no hot spot).  The cells are written once, partitioned by attribute and bucketed by entity: each
attribute's part is a typed narrow table, all of them co-partitioned.  Outer joins then combine them without a further
shuffle, ``FAN_IN`` at a time, in a balanced tree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.operators import units
from graphweft.session import cut, fresh_path, keep, partitions

FAN_IN = 6
#: A wide table has a column per attribute; more than this are put into several wide tables (see ``widen_all``).
MAX_ATTRIBUTES = 2000
#: Names of columns in between: no attribute has it, as keys are trimmed.
MARK = " conflicts"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def year_of(value: Column) -> Column:
    """A year as an integer, negative before the era; NULL for anything but one full year."""

    def read(text: Column) -> Column:
        before = text.rlike(r"^\d{1,6} ?(bc|bce|b\.c\.|b\.c\.e\.)$")
        after = text.rlike(r"^([+-]?\d{1,6}|\d{1,6} ?(ad|ce|a\.d\.|c\.e\.)|ad ?\d{1,6})$")
        digits = F.regexp_extract(text, r"([+-]?\d{1,6})", 1).try_cast("int")
        return F.when(before, -digits).when(after, digits)

    return units.let(F.regexp_replace(units.plain(value), r"\.0+$", ""), read)


def date_of(value: Column) -> Column:
    """A calendar day as the year, month and day written; NULL unless all three are there and the day exists."""
    forms = (
        (r"^([+-]?\d{1,4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[t ]\d{1,2}:.*)?$", 1, 2, 3),
        (r"^(\d{4})(\d\d)(\d\d)$", 1, 2, 3),
        (r"^(\d{1,2})\.? ([a-z]{3})[a-z]*\.?,? (\d{1,4})$", 3, 2, 1),
        (r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{1,4})$", 3, 1, 2),
    )

    def read(text: Column) -> Column:
        def parts(pattern: str, y: int, m: int, d: int) -> Column:
            month = F.regexp_extract(text, pattern, m)
            name = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int")
            number = units.let(month, lambda x: F.coalesce(x.try_cast("int"), F.nullif(name, F.lit(0)))).cast("string")
            return F.concat_ws("-", F.lpad(F.regexp_extract(text, pattern, y), 4, "0"), F.lpad(number, 2, "0"), F.lpad(F.regexp_extract(text, pattern, d), 2, "0"))

        return F.coalesce(*(F.when(text.rlike(form[0]), parts(*form)) for form in forms))

    iso = units.let(units.plain(value), read)
    return units.let(iso, lambda x: F.when(F.length(x) == 10, x.try_cast("date")))


def prevailing_types(rows: DataFrame) -> DataFrame:
    """``attribute``, ``type``: the datatype most rows of the key have (the greater name on a tie), string where none has any."""
    kind = F.nullif(units.plain(F.col("datatype")), F.lit(""))
    counts = rows.groupBy(units.plain_key(F.col("key")).alias("attribute"), kind.alias("kind")).count()
    rank = F.struct(F.col("kind").isNotNull(), F.col("count"), F.col("kind"))
    return counts.groupBy("attribute").agg(F.coalesce(F.max_by("kind", rank), F.lit("string")).alias("type")).filter("attribute <> ''")


def cells(rows: DataFrame, common_units: DataFrame, types: DataFrame) -> DataFrame:
    """One row per entity and attribute: ``entity_id``, ``attribute``, ``number``, ``day``, ``text`` (the value last
    recorded, in the column of its type), ``stated`` (rows that state a value), ``conflict`` (they state different ones).

    Values are read by the attribute's prevailing type (``types``: attribute, type).  Quantities are compared in the common unit with a tolerance of 1 %,
    all else exactly, strings trimmed and without regard to case.  Cells whose rows state nothing are left out, as are rows
    with NULL or blank entity or key.  Rows are expected once each (``units.distinct_rows``).
    """
    typed = rows.select("row_id", F.col("entity_id"), "key", "value", "unit", "source", "recorded_at", units.plain_key(F.col("key")).alias("attribute")).filter("trim(entity_id) <> ''")
    typed = typed.join(F.broadcast(types), "attribute")  # as many rows as the wide table has columns
    measured = common_units.select(units.plain_key(F.col("key")).alias("attribute")).distinct()
    quantity = F.col("type") == "quantity"
    of_unit = units.convert(typed.filter(quantity), common_units)
    plain = typed.filter(~quantity).unionByName(typed.filter(quantity).join(F.broadcast(measured), "attribute", "left_anti"))
    number = units.number_and_unit(F.col("value")).getField("number")
    none = lambda kind: F.lit(None).cast(kind)
    read = plain.select(
        "row_id", "entity_id", "attribute", "type", "recorded_at",
        F.when(F.col("type") == "year", year_of(F.col("value")).cast("double")).when(F.col("type").isin("number", "quantity"), number).alias("number"),
        F.when(F.col("type") == "date", date_of(F.col("value"))).alias("day"),
        F.when(~F.col("type").isin("year", "number", "quantity", "date"), F.nullif(F.trim(F.regexp_replace("value", r"^[\s ]+|[\s ]+$", "")), F.lit(""))).alias("text"),
    )
    of_unit = of_unit.select("row_id", "entity_id", "attribute", "type", "recorded_at", F.col("common_value").alias("number"), none("date").alias("day"), none("string").alias("text"))
    stated = read.unionByName(of_unit).filter(F.coalesce(F.col("number").isNotNull(), F.lit(False)) | F.col("day").isNotNull() | F.col("text").isNotNull())
    latest = F.struct(F.col("recorded_at"), F.col("row_id"), F.col("number"), F.col("day"), F.col("text"))
    folded = F.lower("text")
    out = stated.groupBy("entity_id", "attribute", "type").agg(
        F.max(latest).alias("_last"), F.count("*").alias("stated"),
        F.min("number").alias("_n0"), F.max("number").alias("_n1"), F.min("day").alias("_d0"), F.max("day").alias("_d1"),
        F.min(folded).alias("_t0"), F.max(folded).alias("_t1"),
    )
    conflict = F.when(quantity, ~units.alike(F.col("_n0"), F.col("_n1"))).when(F.col("_n0").isNotNull(), F.col("_n0") != F.col("_n1")).when(F.col("_d0").isNotNull(), F.col("_d0") != F.col("_d1")).otherwise(F.col("_t0") != F.col("_t1"))
    return out.select("entity_id", "attribute", "type", F.col("_last.number").alias("number"), F.col("_last.day").alias("day"), F.col("_last.text").alias("text"), "stated", conflict.alias("conflict"))


def widen(rows: DataFrame, common_units: DataFrame) -> DataFrame:
    """One row per entity: ``entity_id``, a typed column per attribute, and ``conflicts``, the attributes for which the
    entity's rows disagree (sorted; empty if none).

    Columns: quantities and numbers DOUBLE (quantities in the common unit), years INT, dates DATE, all else STRING; named
    after the attribute, with as many "_" appended as it takes where that is ``entity_id`` or ``conflicts``.  NULL where the
    entity states nothing for the attribute.  Entities that state nothing at all have no row.  No attribute at all gives just
    ``entity_id`` and ``conflicts``.  More than ``MAX_ATTRIBUTES`` attributes do not fit one table: ``widen_all`` takes them.
    """
    tables = widen_all(rows, common_units)
    if len(tables) > 1:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes: widen_all gives several tables")
    return tables[0]


def widen_all(rows: DataFrame, common_units: DataFrame) -> list[DataFrame]:
    """As ``widen``, for any number of attributes: tables of ``MAX_ATTRIBUTES`` columns each, in order of the attributes' names,
    all with the same entities and bucketed alike, so that any of them join without a shuffle."""
    spark = rows.sparkSession
    rows = cut(units.distinct_rows(rows))
    types = [(r.attribute, r.type) for r in prevailing_types(rows).orderBy("attribute").collect()]  # one row per attribute
    known = spark.createDataFrame([(a, t, i) for i, (a, t) in enumerate(types)], "attribute string, type string, part int")
    found = cells(rows, common_units, known.select("attribute", "type")).join(F.broadcast(known.select("attribute", "part")), "attribute")
    n = partitions(spark)
    narrow = _bucketed(found.select("part", "entity_id", "number", "day", "text", "conflict"), n, "part")
    spine = _bucketed(narrow.select("entity_id").distinct(), n)
    names = _names([a for a, _ in types])
    out = []
    for first in range(0, max(1, len(types)), MAX_ATTRIBUTES):
        last = min(first + MAX_ATTRIBUTES, len(types))
        level = []
        for start in range(first, last, FAN_IN):
            level.append(_joined(spine, [_narrow(narrow, i, *types[i], names[types[i][0]]) for i in range(start, min(start + FAN_IN, last))]))
        while len(level) > 1:
            level = [_bucketed(x, n) for x in level]
            level = [_joined(level[i], level[i + 1 : i + FAN_IN]) for i in range(0, len(level), FAN_IN)]
        wide = level[0] if level else spine.withColumn("conflicts", F.array().cast("array<string>"))
        out.append(wide.withColumn("conflicts", F.sort_array("conflicts")))
    return out


def _names(attributes: list[str]) -> dict[str, str]:
    """A column name for each attribute, distinct from each other and from the table's own."""
    taken = {"entity_id", "conflicts", *attributes} - {a for a in attributes if a not in ("entity_id", "conflicts")}
    names = {a: a for a in attributes if a not in ("entity_id", "conflicts")}
    for a in ("entity_id", "conflicts"):
        if a in attributes:
            name = a + "_"
            while name in taken or name in names.values():
                name += "_"
            names[a] = name
    return names


def _narrow(cells_: DataFrame, part: int, attribute: str, kind: str, name: str) -> DataFrame:
    """A typed narrow table: entity, value, and the attribute's name in an array where its rows disagree."""
    value = {"year": F.col("number").cast("int"), "number": F.col("number"), "quantity": F.col("number"), "date": F.col("day")}.get(kind, F.col("text"))
    flag = F.when(F.col("conflict"), F.array(F.lit(attribute))).otherwise(F.array().cast("array<string>"))
    return cells_.filter(F.col("part") == part).select("entity_id", value.alias(name), flag.alias("conflicts"))


def _joined(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Outer joins on the entity; all sides are bucketed alike, so that merge joins need no shuffle, and none is broadcast,
    however small.  The spine of all entities comes first, so that no key has to be coalesced, which would lose the partitioning."""
    gathered = [F.col("conflicts")] if "conflicts" in first.columns else []
    out = first.withColumnRenamed("conflicts", MARK)
    gathered = [F.col(MARK)] if gathered else []
    for i, other in enumerate(others):
        out = out.join(other.withColumnRenamed("conflicts", f"{MARK}{i}").hint("merge"), "entity_id", "left")
        gathered.append(F.coalesce(F.col(f"{MARK}{i}"), F.array().cast("array<string>")))
    own = [c for c in out.columns if not c.startswith(MARK)]
    return out.select(*(F.col(f"`{c}`") for c in own), F.concat(*gathered).alias("conflicts"))


def _bucketed(df: DataFrame, n: int, *parts: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by entity: written once, read by any number of joins without a
    shuffle, and no lineage to recompute."""
    spark = df.sparkSession
    name = f"graphweft_{uuid.uuid4().hex}"
    writer = df.repartition(n, "entity_id").write.format("parquet").bucketBy(n, "entity_id").sortBy("entity_id").option("path", fresh_path(spark, "wide"))
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    keep(spark, name)
    return spark.table(name)


def conflicts(wide: DataFrame) -> DataFrame:
    """The cells of a wide table whose rows disagree: ``entity_id``, ``key``."""
    return wide.select("entity_id", F.explode("conflicts").alias("key"))
