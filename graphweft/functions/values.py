"""Typed values: derived columns, formatting, ordering and comparison, all as column expressions.

A stored value is text with a datatype (string, quantity, number, year, date) and a unit; ``typed`` adds ``num``, ``y``,
``m`` and ``d``, on which comparisons run inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.plans.model import Literal

DATE = r"^([+-]?\d+)[-/](\d{1,2})[-/](\d{1,2})"


def typed(df: DataFrame) -> DataFrame:
    """Adds ``num`` (quantity, number, year), ``y`` (year, date) and ``m``, ``d`` (date), NULL where the text does not parse."""
    value, kind = F.col("value"), F.col("datatype")
    part = lambda i: F.regexp_extract(value, DATE, i).try_cast("int")
    return df.withColumns({
        "num": F.when(kind.isin("quantity", "number", "year"), value.try_cast("double")),
        "y": F.when(kind == "year", value.try_cast("double").cast("int")).when(kind == "date", part(1)),
        "m": F.when(kind == "date", part(2)),
        "d": F.when(kind == "date", part(3)),
    })


def bare(unit: Column) -> Column:
    """NULL, empty and "1" are one unit."""
    return F.coalesce(F.nullif(unit, F.lit("")), F.lit("1"))


def formatted(value: str = "value", datatype: str = "datatype", unit: str = "unit", y: str = "y", m: str = "m", d: str = "d") -> Column:
    """A value as an answer shows it: a quantity with its unit, a year as an integer, a date as YYYY-MM-DD (years before
    the era with sign and five places)."""
    year = F.col(y)
    date = F.concat(F.when(year < 0, F.format_string("%05d", year)).otherwise(F.lpad(year.cast("string"), 4, "0")), F.format_string("-%02d-%02d", F.col(m), F.col(d)))
    return (
        F.when((F.col(datatype) == "quantity") & (bare(F.col(unit)) != "1"), F.concat_ws(" ", F.col(value), F.col(unit)))
        .when((F.col(datatype) == "year") & year.isNotNull(), year.cast("string"))
        .when((F.col(datatype) == "date") & F.col(d).isNotNull(), date)
        .otherwise(F.col(value))
    )


def sort_key() -> Column:
    """Quantities before times; units before magnitudes; other values cannot be ordered."""
    kind = F.col("datatype")
    return F.when(kind.isin("quantity", "number"), F.struct(F.lit(0).alias("c"), bare(F.col("unit")).alias("u"), F.col("num").alias("n"), F.lit(0).alias("m"), F.lit(0).alias("d"))).when(
        kind.isin("year", "date"), F.struct(F.lit(1).alias("c"), F.lit("").alias("u"), F.col("y").cast("double").alias("n"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("d", F.lit(0)).alias("d"))
    )


def _apply(comparator: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[comparator]


def _float(text: object) -> float | None:
    try:
        return float(str(text))
    except ValueError:
        return None


def _parts(value: object, datatype: str) -> tuple[int, int | None, int | None] | None:
    if m := re.match(DATE, str(value)):
        return int(m[1]), int(m[2]), int(m[3])
    number = _float(value)
    return None if number is None else (int(number), None, None)


def compare(comparator: str, target: Literal) -> Column:
    """Whether the row's value stands in the relation ``comparator`` to ``target``; never NULL.

    What depends on the target alone is decided here; the rest is one boolean expression.  A target of datatype string is
    read by the type of the stored value.  Quantities of different units are in no relation, not even ``ne``.
    """
    value, kind = F.col("value"), F.col("datatype")
    if comparator == "contains":
        return F.coalesce(F.contains(F.lower(value), F.lit(str(target.value).lower())), F.lit(False))
    if target.datatype != "string":
        return F.coalesce(_typed(comparator, target), F.lit(False))
    text = str(target.value)
    number, _, unit = text.partition(" ")
    out = _typed(comparator, target)
    if _float(number) is not None:
        out = F.when(kind == "quantity", _typed(comparator, Literal(float(number), "quantity", unit.strip() or None))).otherwise(out)
    if re.fullmatch(r"[+-]?\d+", text):
        out = F.when(kind == "year", _typed(comparator, Literal(int(text), "year"))).otherwise(out)
    if re.match(DATE + "$", text):
        out = F.when(kind == "date", _typed(comparator, Literal(text, "date"))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _typed(comparator: str, target: Literal) -> Column:
    value, kind, unit = F.col("value"), F.col("datatype"), bare(F.col("unit"))
    number, parts = _float(target.value), _parts(target.value, target.datatype)
    text = _apply(comparator, value, F.lit(str(target.value)))
    numeric = text if number is None else F.when(F.col("num").isNotNull(), _apply(comparator, F.col("num"), F.lit(number))).otherwise(text)
    out = F.when(kind.isin("quantity", "number", "year"), numeric).otherwise(text)
    if target.datatype in ("year", "date", "number") and parts:
        y = F.coalesce("y", F.lit(None).cast("int"))
        if target.datatype == "date" and parts[1] is not None:
            own, other = F.struct(F.col("y"), F.col("m"), F.col("d")), F.struct(F.lit(parts[0]).alias("y"), F.lit(parts[1]).alias("m"), F.lit(parts[2]).alias("d"))
            equal = (kind == "date") & (own == other)
            time = {"eq": equal, "ne": ~equal}.get(comparator)
            if time is None:
                time = F.when(kind == "date", _apply(comparator, own, other)).otherwise(_apply(comparator, y, F.lit(parts[0])))
        else:
            time = _apply(comparator, y, F.lit(parts[0]))
        out = F.when(kind.isin("year", "date"), time).otherwise(out)
    if target.datatype in ("quantity", "number"):
        out = F.when((kind == "quantity") & (unit != (target.unit or "1")), F.lit(False)).otherwise(out)
    return out
