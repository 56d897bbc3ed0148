"""Queries of the general data problems: wide tables, hierarchies, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators import hierarchy, units, widen
from graphweft.session import table


def p2_wide(spark: SparkSession, folder: str) -> DataFrame:
    return widen.widen(table(spark, folder, "attributes"), table(spark, folder, "common_units"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return widen.conflicts(p2_wide(spark, folder))


def _links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    kb = table(spark, folder, "kb", "node_id", "instanceof")
    return kb, hierarchy.links(kb)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.on_loops(_links(spark, folder)[1])


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.paths(*_links(spark, folder))


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    above = hierarchy.ancestors(_links(spark, folder)[1])
    return above.select(F.col("ancestor").alias("node_id"), F.col("node_id").alias("descendant"), F.col("distance").cast("long").alias("distance"))


def p4_converted(spark: SparkSession, folder: str) -> DataFrame:
    rows = units.convert(units.distinct_rows(table(spark, folder, "attributes")), table(spark, folder, "common_units"))
    return rows.select("row_id", "entity_id", units.plain_key(F.col("key")).alias("key"), "source", "number", "unit", "unit_from", "common_value", "common_unit")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.agreeing_pairs(units.convert(units.distinct_rows(table(spark, folder, "attributes")), table(spark, folder, "common_units")))


def _plain(column: str) -> str:
    """Lower case, plain digits and signs, single blanks, as ``units.plain`` reads."""
    quote = lambda x: x.replace("'", "''")
    given, plain = units.WIDE_DIGITS + units.BLANKS + "²³−’＋．，", "0123456789" + " " * len(units.BLANKS) + "23-'+.,"
    return f"trim(regexp_replace(lower(translate({column}, '{quote(given)}', '{quote(plain)}')), '\\s+', ' ', 'g'))"


def _units_sql(every: bool = False) -> str:
    """Reading of numbers and units in SQL, of measured keys or of every row; the table of units is the operator's."""
    rows = ", ".join(f"('{d}', '{a}', '{u}', {f!r}::DOUBLE, {o!r}::DOUBLE)" for u, (d, f, o, names) in units.UNITS.items() for a in names.split("|"))
    clock, colon = r"^(\d+) ?(?:h|hrs?|hours?) ?(\d+) ?(?:m|min|mins|minutes?)$", r"^(\d+):(\d\d) ?(?:h|hrs?|hours?)$"
    feet = r"^(\d+) ?(?:''|ft\.?|feet|foot) ?(\d+(?:[.,]\d+)?) ?(?:\"|in\.?|inch|inches)$"
    simple = r"^([+-]?\d[\d.,'' ]*?(?:e[+-]?\d+)?) ?([^\d\s.,''+:-][^+:]*)?$"
    split = r"^([+-]?)(\d[\d.,'' ]*?)(e[+-]?\d+)?$"
    number = lambda t, p, g: f"TRY_CAST(replace(regexp_extract({t}, '{p}', {g}), ',', '.') AS DOUBLE)"
    return f"""WITH alias(dimension, alias, unit, factor, shift) AS (VALUES {rows}),
k AS (SELECT DISTINCT ON (key) {_plain('key')} AS key, dimension, common_unit FROM common_units), base AS (SELECT DISTINCT dimension, lower(unit) AS l, factor AS cf, shift AS co FROM alias),
keys AS (SELECT k.key, k.dimension, common_unit, cf, co FROM k JOIN base ON k.dimension = base.dimension AND lower(common_unit) = l),
rows AS (SELECT DISTINCT row_id, entity_id, key AS raw_key, value, datatype, unit AS raw_unit, source, recorded_at FROM attributes),
texts AS (SELECT row_id, entity_id, source, {_plain('raw_key')} AS attribute, value, recorded_at, keys.*, nullif({_plain('raw_unit')}, '') AS field, regexp_replace({_plain('value')}, '^(about|around|roughly|approximately|approx\\.?|circa|ca\\.?|~|≈)\\s*', '') AS t FROM rows {"LEFT " if every else ""}JOIN keys ON {_plain('raw_key')} = keys.key),
bits AS (SELECT *, regexp_extract(t, '{simple}', 1) AS n, regexp_matches(t, '{clock}') AS is_clock, regexp_matches(t, '{colon}') AS is_colon, regexp_matches(t, '{feet}') AS is_feet, regexp_matches(t, '{simple}') AS is_simple FROM texts),
body AS (SELECT *, regexp_extract(n, '{split}', 1) AS sign, regexp_extract(n, '{split}', 2) AS b, regexp_extract(n, '{split}', 3) AS e FROM bits),
plain AS (SELECT *, CASE WHEN regexp_matches(b, '^[1-9]\\d{{0,2}}([,'' ]\\d{{3}})+(\\.\\d+)?$') THEN regexp_replace(b, '[,'' ]', '', 'g') WHEN regexp_matches(b, '^[1-9]\\d{{0,2}}(\\.\\d{{3}})+,\\d+$') THEN replace(replace(b, '.', ''), ',', '.')
  WHEN regexp_matches(b, '^[1-9]\\d{{0,2}}(\\.\\d{{3}}){{2,}}$') THEN replace(b, '.', '') WHEN regexp_matches(b, '^\\d+([.,]\\d+)?$') THEN replace(b, ',', '.') END AS digits FROM body),
read AS (SELECT *, CASE WHEN is_clock THEN {number('t', clock, 1)} + {number('t', clock, 2)} / 60 WHEN is_colon THEN {number('t', colon, 1)} + {number('t', colon, 2)} / 60 WHEN is_feet THEN {number('t', feet, 1)} + {number('t', feet, 2)} / 12 WHEN is_simple THEN TRY_CAST(sign || digits || e AS DOUBLE) END AS number,
  CASE WHEN is_clock OR is_colon THEN 'hour and minute' WHEN is_feet THEN 'foot and inch' WHEN is_simple AND TRY_CAST(sign || digits || e AS DOUBLE) IS NOT NULL THEN nullif(trim(regexp_extract(t, '{simple}', 2)), '') END AS said FROM plain),
named AS (SELECT *, coalesce(nullif(field, '1'), said, CASE WHEN dimension = 'count' AND coalesce(nullif(field, '1'), said) IS NULL THEN '1' END) AS alias,
  CASE WHEN nullif(field, '1') IS NOT NULL OR (dimension = 'count' AND coalesce(nullif(field, '1'), said) IS NULL) THEN 'field' WHEN said IS NOT NULL THEN 'text' END AS origin FROM read),
met AS (SELECT n.*, a.unit AS u, a.factor AS f, a.shift AS o FROM named n LEFT JOIN alias a ON n.dimension = a.dimension AND n.alias = a.alias),
habit AS (SELECT source, key, max(struct_pack(c := c, u := u, f := f, o := o)) AS h FROM (SELECT source, key, u, f, o, count(*) AS c FROM met WHERE u IS NOT NULL AND u NOT IN ('hour and minute', 'foot and inch') GROUP BY ALL) GROUP BY source, key),
whole AS (SELECT m.row_id, m.entity_id, m.key, m.source, m.number, m.common_unit, m.cf, m.co, m.origin, CASE WHEN m.alias IS NULL THEN h.h.u ELSE m.u END AS unit, CASE WHEN m.alias IS NULL THEN h.h.f ELSE m.f END AS f, CASE WHEN m.alias IS NULL THEN h.h.o ELSE m.o END AS o
  FROM met m LEFT JOIN habit h ON m.source IS NOT DISTINCT FROM h.source AND m.key = h.key),
converted AS (SELECT row_id, entity_id, key, source, number, CASE WHEN number IS NOT NULL THEN unit END AS unit, CASE WHEN number IS NOT NULL AND unit IS NOT NULL THEN coalesce(origin, 'source') END AS unit_from,
  CASE WHEN unit = common_unit THEN number ELSE (number * f + o - co) / cf END AS common_value, common_unit FROM whole)"""


def _conflicts_sql() -> str:
    """Cells whose rows disagree: values read by the key's prevailing datatype, quantities in the common unit."""
    months = " ".join(f"WHEN '{m}' THEN '{k:02}'" for k, m in enumerate(widen.MONTHS, 1))
    part = lambda pattern, y, m, d: f"concat_ws('-', lpad(regexp_extract(t, '{pattern}', {y}), 4, '0'), lpad(CASE regexp_extract(t, '{pattern}', {m}) {months} ELSE regexp_extract(t, '{pattern}', {m}) END, 2, '0'), lpad(regexp_extract(t, '{pattern}', {d}), 2, '0'))"
    forms = [
        (r"^([+-]?\d{1,4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[t ]\d{1,2}:.*)?$", 1, 2, 3), (r"^(\d{4})(\d\d)(\d\d)$", 1, 2, 3),
        (r"^(\d{1,2})\.? ([a-z]{3})[a-z]*\.?,? (\d{1,4})$", 3, 2, 1), (r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{1,4})$", 3, 1, 2),
    ]
    day = "CASE " + " ".join(f"WHEN regexp_matches(t, '{f[0]}') THEN {part(*f)}" for f in forms) + " END"
    return f"""{_units_sql(every=True)}, kinds AS (SELECT attribute, kind, count(*) AS c FROM (SELECT {_plain('raw_key')} AS attribute, nullif({_plain('datatype')}, '') AS kind FROM rows) GROUP BY ALL),
types AS (SELECT attribute, coalesce(arg_max(kind, struct_pack(given := kind IS NOT NULL, c := c, kind := coalesce(kind, ''))), 'string') AS type FROM kinds WHERE attribute <> '' GROUP BY attribute),
plain_values AS (SELECT r.row_id, r.entity_id, r.attribute, type, r.number, regexp_replace({_plain('r.value')}, '\\.0+$', '') AS y, {_plain('r.value')} AS t, nullif(trim(regexp_replace(r.value, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')), '') AS s, r.key
  FROM read r JOIN types ON r.attribute = types.attribute WHERE trim(r.entity_id) <> ''),
stated AS (SELECT p.entity_id, p.attribute, type,
  CASE WHEN type = 'quantity' AND p.key IS NOT NULL THEN c.common_value WHEN type IN ('number', 'quantity') THEN p.number WHEN type = 'year' THEN CASE WHEN regexp_matches(y, '^\\d{{1,6}} ?(bc|bce|b\\.c\\.|b\\.c\\.e\\.)$') THEN -TRY_CAST(regexp_extract(y, '([+-]?\\d{{1,6}})', 1) AS DOUBLE) WHEN regexp_matches(y, '^([+-]?\\d{{1,6}}|\\d{{1,6}} ?(ad|ce|a\\.d\\.|c\\.e\\.)|ad ?\\d{{1,6}})$') THEN TRY_CAST(regexp_extract(y, '([+-]?\\d{{1,6}})', 1) AS DOUBLE) END END AS n,
  CASE WHEN type = 'date' AND length({day}) = 10 THEN TRY_CAST({day} AS DATE) END AS d, CASE WHEN type NOT IN ('year', 'number', 'quantity', 'date') THEN lower(s) END AS s FROM plain_values p LEFT JOIN converted c ON p.row_id = c.row_id AND p.key = c.key AND c.entity_id = p.entity_id)
SELECT entity_id, attribute AS key FROM stated GROUP BY entity_id, attribute, type HAVING CASE WHEN type = 'quantity' THEN NOT (max(n) - min(n) <= greatest(abs(min(n)), abs(max(n))) * {units.TOLERANCE * (1 + 1e-9)!r}) ELSE coalesce(max(n) <> min(n), max(d) <> min(d), max(s) <> min(s)) END"""


QUERIES = {f.__name__: f for f in (p2_found, p2_wide, p3_found, p3_paths, p3_descendants, p4_found, p4_converted)}
_LINKS = """WITH RECURSIVE ids AS (SELECT DISTINCT trim(node_id) AS node_id FROM kb WHERE trim(node_id) <> ''),
edges AS (SELECT DISTINCT trim(k.node_id) AS child, trim(p.p) AS parent FROM kb k, unnest(k.instanceof) AS p(p)
  WHERE trim(p.p) IN (SELECT node_id FROM ids) AND trim(k.node_id) <> ''),
reach AS (SELECT child AS node_id, parent AS ancestor FROM edges
  UNION SELECT r.node_id, e.parent FROM reach r JOIN edges e ON e.child = r.ancestor)"""
ORACLES = {
    "p2_found": _conflicts_sql(),
    "p4_converted": f"{_units_sql()} SELECT * FROM converted",
    "p4_found": f"""{_units_sql()} SELECT DISTINCT a.row_id AS row_a, b.row_id AS row_b FROM converted a JOIN converted b ON a.entity_id = b.entity_id AND a.key = b.key AND a.row_id < b.row_id AND a.unit <> b.unit
WHERE a.unit_from <> 'source' AND b.unit_from <> 'source' AND abs(a.common_value - b.common_value) <= greatest(abs(a.common_value), abs(b.common_value)) * {units.TOLERANCE * (1 + 1e-9)!r}""",
    "p3_descendants": """WITH RECURSIVE ids AS (SELECT DISTINCT trim(node_id) AS node_id FROM kb WHERE trim(node_id) <> ''),
edges AS (SELECT DISTINCT trim(k.node_id) AS child, trim(p.p) AS parent FROM kb k, unnest(k.instanceof) AS p(p)
  WHERE trim(p.p) IN (SELECT node_id FROM ids) AND trim(k.node_id) <> ''),
walk AS (SELECT child AS node_id, parent AS ancestor, 1 AS distance, [child, parent] AS seen FROM edges
  UNION ALL SELECT w.node_id, e.parent, w.distance + 1, list_append(w.seen, e.parent) FROM walk w JOIN edges e ON e.child = w.ancestor
  WHERE w.ancestor <> w.node_id AND (e.parent = w.node_id OR NOT list_contains(w.seen, e.parent)))
SELECT ancestor AS node_id, node_id AS descendant, CAST(min(distance) AS BIGINT) AS distance FROM walk GROUP BY 1, 2""",
    "p3_paths": """WITH RECURSIVE ids AS (SELECT DISTINCT trim(node_id) AS node_id FROM kb WHERE trim(node_id) <> ''),
edges AS (SELECT DISTINCT trim(k.node_id) AS child, trim(p.p) AS parent FROM kb k, unnest(k.instanceof) AS p(p)
  WHERE trim(p.p) IN (SELECT node_id FROM ids) AND trim(k.node_id) <> ''),
reach AS (SELECT child AS node_id, parent AS ancestor FROM edges UNION SELECT r.node_id, e.parent FROM reach r JOIN edges e ON e.child = r.ancestor),
loops AS (SELECT DISTINCT node_id FROM reach WHERE node_id = ancestor),
up AS (SELECT node_id, node_id AS tip, node_id AS path, CAST(0 AS BIGINT) AS depth FROM ids
  UNION ALL SELECT u.node_id, e.parent, e.parent || ' > ' || u.path, u.depth + 1 FROM up u JOIN edges e ON e.child = u.tip WHERE u.tip NOT IN (SELECT node_id FROM loops))
SELECT node_id, CASE WHEN tip IN (SELECT node_id FROM loops) THEN NULL ELSE tip END AS root, depth, path, tip IN (SELECT node_id FROM loops) AS looped
FROM up WHERE tip IN (SELECT node_id FROM loops) OR tip NOT IN (SELECT child FROM edges)""",
    "p3_found": f"{_LINKS} SELECT DISTINCT node_id FROM reach WHERE node_id = ancestor",
}
