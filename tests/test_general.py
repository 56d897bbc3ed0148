"""Units, wide tables, hierarchies: fixtures with known answers and brute force over the small tables."""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphweft.operators import hierarchy, units, widen
from graphweft.session import table

ROW = "row_id long, entity_id string, key string, value string, datatype string, unit string, source string, recorded_at timestamp, loaded_at timestamp"
COMMON = "key string, dimension string, common_unit string"
KEYS = [("population", "count", "1"), ("length", "length", "kilometre"), ("height", "length", "metre"), ("melting point", "temperature", "degree Celsius"), ("running time", "duration", "minute")]


def rows(spark, *given):
    return spark.createDataFrame([(i, e, k, v, d, u, s, None, None) for i, (e, k, v, d, u, s) in enumerate(given)], ROW)


def common(spark):
    return spark.createDataFrame(KEYS, COMMON)


NUMBERS = {
    "1,234": 1234, "1,5784": 1.5784, "0,345": 0.345, "1.152,4": 1152.4, "8,781.0": 8781, "1'198'314": 1198314, "2 495.6": 2495.6, "1 180": 1180,
    "１２３": 123, "+5.2": 5.2, "-3": -3, "1.5e3": 1500, "2.1e-1": 0.21, "12..5": None, "1-2-3": None, "nan": None, "": None, "see note": None, "1.2.3": None,
}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS] + [(None,)], "value string").select("value", units.number_and_unit(F.col("value")).alias("r"))
    got = {r.value: r.r.number if r.r else None for r in df.collect()}
    assert got == {**NUMBERS, None: None}


UNITS = {
    "about 2211.8 m": (2211.8, "m"), "~3,2211Metre": (3.2211, "metre"), "ca. 84 km²": (84, "km2"), "4h02m": (4 + 2 / 60, "hour and minute"), "1:37 h": (1 + 37 / 60, "hour and minute"),
    "14' 10.0\"": (14 + 10 / 12, "foot and inch"), "6 feet 7.5 inches": (6 + 7.5 / 12, "foot and inch"), "339.81 km/h": (339.81, "km/h"), "12 gallon (US)": (12, "gallon (us)"), "5.0 °C": (5, "°c"),
}


def test_units_in_text(spark):
    df = spark.createDataFrame([(k,) for k in UNITS], "value string").select("value", units.number_and_unit(F.col("value")).alias("r"))
    for r in df.collect():
        number, unit = UNITS[r.value]
        assert math.isclose(r.r.number, number) and r.r.unit == unit


def test_convert(spark):
    given = rows(
        spark,
        ("e", "Length ", "5 km", "string", None, "s"), ("e", "length", "5000", "quantity", "METERS", "s"), ("e", "length", "3.1", "quantity", "mi", "t"),
        ("e", "population", "4.2", "quantity", "thousand", "s"), ("e", "population", "4200", "quantity", None, "s"), ("e", "melting point", "212", "quantity", "F", "s"),
        ("e", "length", "7000", "quantity", None, "s"), ("e", "length", "junk", "quantity", "km", "s"), ("e", "length", "3", "quantity", "furlongs", "s"), ("e", None, "3", "quantity", "km", "s"), ("e", "colour", "3", "quantity", "km", "s"),
    )
    out = {r.row_id: r for r in units.convert(given, common(spark)).collect()}
    assert set(out) == set(range(9))
    assert [round(out[i].common_value, 6) for i in range(6)] == [5.0, 5.0, 4.988966, 4200.0, 4200.0, 100.0]
    assert out[6].unit_from == "source" and out[6].unit == "kilometre" and out[6].common_value == 7000.0  # two rows of the source say km, one m
    assert out[7].common_value is None and out[7].number is None
    assert out[8].number == 3 and out[8].common_value is None


def test_pairs_and_edges(spark):
    given = rows(
        spark, ("e", "length", "5 km", None, None, "s"), ("e", "length", "5000", None, "m", "s"), ("e", "length", "5.049", None, "km", "s"), ("e", "length", "5100", None, "m", "s"),
        ("f", "length", "5000", None, "m", "s"), ("e", "length", "5", None, None, "s"), (None, "length", "5", None, "km", "s"), ("e", "length", "0", None, "m", "s"), ("e", "length", "0", None, "km", "s"),
        ("e", "melting point", "-10", None, "C", "s"), ("e", "melting point", "14", None, "F", "s"),
    )
    pairs = {tuple(r) for r in units.agreeing_pairs(units.convert(given, common(spark))).collect()}
    assert pairs == {(0, 1), (1, 2), (2, 3), (7, 8), (9, 10)}
    assert units.agreeing_pairs(units.convert(given.limit(0), common(spark))).count() == 0


def test_extra_columns_and_repeats(spark):
    given = rows(spark, ("e", "length", "5 km", None, None, "s")).withColumn("number", F.lit("clash")).withColumn("factor", F.lit("mine")).withColumn("_unit", F.lit("mine too"))
    out = units.convert(given.unionByName(given), common(spark)).collect()
    assert len(out) == 2 and out[0].number == 5.0
    assert units.distinct_rows(given.unionByName(given)).count() == 1


YEARS = {"1999": 1999, "+918": 918, "32 BC": -32, "1 BCE": -1, "-95": -95, "AD 670": 670, "1198 CE": 1198, "1365.0": 1365, "19xx": None, "12th": None, "undated": None, "": None}
DATES = {
    "1999-02-28": dt.date(1999, 2, 28), "1999-02-30": None, "1894/10/4": dt.date(1894, 10, 4), "19??/05/01": None, "1865/11": None, "18770601": dt.date(1877, 6, 1),
    "Jun 1, 1877": dt.date(1877, 6, 1), "12 March 1877": dt.date(1877, 3, 12), "1877.06.01": dt.date(1877, 6, 1), "1877-06-01T23:59:00Z": dt.date(1877, 6, 1), "unknown": None,
}


def test_years_and_dates(spark):
    df = spark.createDataFrame([(k,) for k in [*YEARS, *DATES]], "v string").select("v", widen.year_of(F.col("v")).alias("y"), widen.date_of(F.col("v")).alias("d"))
    got = {r.v: r for r in df.collect()}
    assert {k: got[k].y for k in YEARS} == YEARS
    assert {k: got[k].d for k in DATES} == DATES


def test_wide(spark):
    given = rows(
        spark, ("e", "length", "5 km", "quantity", None, "s"), ("e", "length", "5040", "quantity", "m", "t"), ("e", "length", "x", "quantity", "m", "t"), ("e", "born", "1999", "year", None, "s"), ("e", "born", "2000", "number", None, "s"),
        ("f", "Born", "1999-01-01", "year", None, "s"), ("f", "entity_id", "A ", "string", None, "s"), ("f", "entity_id", "a", "string", None, "s"), ("g", "born", "junk", "year", None, "s"), (None, "born", "1", "year", None, "s"), ("g", None, "1", "year", None, "s"),
    )
    wide = widen.widen(given, common(spark))
    assert dict(wide.dtypes) == {"entity_id": "string", "born": "int", "entity_id_": "string", "length": "double", "conflicts": "array<string>"}
    out = {r.entity_id: r for r in wide.collect()}
    assert set(out) == {"e", "f"}
    assert out["e"].conflicts == ["born"] and round(out["e"].length, 2) in (5.0, 5.04) and out["f"].born is None and out["f"].conflicts == []
    assert {tuple(r) for r in widen.conflicts(wide).collect()} == {("e", "born")}


def test_wide_of_nothing(spark):
    wide = widen.widen(rows(spark, ("e", "length", "5", None, None, "s")).limit(0), common(spark))
    assert wide.columns == ["entity_id", "conflicts"] and wide.count() == 0


def test_wide_against_brute_force(spark, tiny):
    from graphweft.queries.general import p2_found

    attributes, measured = table(spark, tiny, "attributes"), table(spark, tiny, "common_units")
    once = units.distinct_rows(attributes)
    types = {r.attribute: r.type for r in widen.prevailing_types(once).collect()}
    converted = {r.row_id: r.common_value for r in units.convert(once, measured).collect()}
    plain = once.select("row_id", "entity_id", units.plain_key(F.col("key")).alias("key"), "value", widen.year_of(F.col("value")).alias("y"), widen.date_of(F.col("value")).alias("d"), units.number_and_unit(F.col("value"))["number"].alias("n"))
    values = defaultdict(list)
    for r in plain.collect():
        kind = types[r.key]
        v = converted.get(r.row_id) if kind == "quantity" else {"year": r.y, "date": r.d, "number": r.n}.get(kind, (r.value or "").strip().lower() or None)
        if v is not None:
            values[r.entity_id, r.key].append((kind, v))
    want = set()
    for cell, found in values.items():
        differ = any(abs(a - b) > 0.01 * max(abs(a), abs(b)) if k == "quantity" else a != b for k, a in found for _, b in found)
        if differ:
            want.add(cell)
    assert want and {tuple(r) for r in p2_found(spark, tiny).collect()} == want


def test_pairs_against_brute_force(spark, tiny):
    from graphweft.queries.general import p4_found

    out = units.convert(units.distinct_rows(table(spark, tiny, "attributes")), table(spark, tiny, "common_units")).filter("common_value is not null and unit_from <> 'source'").collect()
    by = defaultdict(list)
    for r in out:
        by[r.entity_id, r.key.strip().lower()].append(r)
    want = {(a.row_id, b.row_id) for g in by.values() for a in g for b in g if a.row_id < b.row_id and a.unit != b.unit and abs(a.common_value - b.common_value) <= 0.01 * max(abs(a.common_value), abs(b.common_value))}
    assert want and {tuple(r) for r in p4_found(spark, tiny).collect()} == want


def kb(spark, **parents):
    return spark.createDataFrame([(n, p) for n, p in parents.items()], "node_id string, instanceof array<string>")


def test_hierarchy(spark):
    nodes = kb(spark, a=None, b=["a"], c=["b", "a", "b"], d=[" c ", "nowhere", None], x=["y"], y=["x"], z=["x"], s=["s"], lone=[])
    nodes = nodes.unionByName(nodes.filter("node_id = 'd'"))
    edges = hierarchy.links(nodes)
    assert {r.node_id for r in hierarchy.on_loops(edges).collect()} == {"x", "y", "s"}
    above = {(r.node_id, r.ancestor): r.distance for r in hierarchy.ancestors(edges).collect()}
    assert above[("d", "a")] == 2 and above[("c", "a")] == 1 and above[("x", "x")] == 2 and above[("z", "y")] == 2 and ("a", "a") not in above
    paths = {tuple(r) for r in hierarchy.paths(nodes, edges).collect()}
    assert ("d", "a", 3, "a > b > c > d", False) in paths and ("d", "a", 2, "a > c > d", False) in paths
    assert ("z", None, 1, "x > z", True) in paths and ("x", None, 0, "x", True) in paths and ("lone", "lone", 0, "lone", False) in paths
    assert len(paths) == 1 + 1 + 2 + 2 + 2 + 1 + 1 + 1


def test_deep_chain_and_long_loop(spark):
    n = 70
    chain = {f"n{i:03}": [f"n{i + 1:03}"] for i in range(n)} | {f"n{n:03}": []}
    loop = {f"l{i:03}": [f"l{(i + 1) % n:03}"] for i in range(n)}
    nodes = kb(spark, **chain, **loop)
    edges = hierarchy.links(nodes)
    assert hierarchy.on_loops(edges).count() == n
    first = hierarchy.paths(nodes, edges).filter("node_id = 'n000'").first()
    assert first.depth == n and first.root == f"n{n:03}"


def test_empty_hierarchy(spark):
    nodes = kb(spark, a=None).limit(0)
    edges = hierarchy.links(nodes)
    assert hierarchy.on_loops(edges).count() == hierarchy.ancestors(edges).count() == hierarchy.paths(nodes, edges).count() == 0


@pytest.mark.parametrize("name", ["p3_found"])
def test_loops_against_search(spark, tiny, name):
    from graphweft.queries.general import QUERIES

    parents = defaultdict(set)
    for r in hierarchy.links(table(spark, tiny, "kb", "node_id", "instanceof")).collect():
        parents[r.child].add(r.parent)

    def reached(v):
        seen, todo = set(), list(parents[v])
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += parents[w]
        return seen

    assert {r.node_id for r in QUERIES[name](spark, tiny).collect()} == {v for v in list(parents) if v in reached(v)}
