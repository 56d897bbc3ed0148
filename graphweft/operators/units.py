"""Quantities in mixed units brought to one unit per key: a pure column pipeline, no Python in the hot path.

number and unit are cut out of ``value`` by regular expressions, unit spellings are resolved by a join with a fixed
alias table, the unit is the first of (unit field, unit in the text, habitual unit of the source for the key), and a
factor and an offset give the value in the key's common unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.session import cut

# Per unit its dimension, factor and offset to the dimension's base (base = number * factor + offset),
# and its spellings in lower case with plain digits.
UNITS: dict[str, tuple[str, float, float, str]] = {
    "1": ("count", 1.0, 0.0, "1"),
    "thousand": ("count", 1e3, 0.0, "thousand|thousands"),
    "million": ("count", 1e6, 0.0, "million|millions|mln"),
    "metre": ("length", 1.0, 0.0, "metre|metres|meter|meters|m|m."),
    "kilometre": ("length", 1000.0, 0.0, "kilometre|kilometres|kilometer|kilometers|km"),
    "centimetre": ("length", 0.01, 0.0, "centimetre|centimetres|centimeter|centimeters|cm"),
    "foot": ("length", 0.3048, 0.0, "foot|feet|ft|ft."),
    "foot and inch": ("length", 0.3048, 0.0, "foot and inch"),
    "yard": ("length", 0.9144, 0.0, "yard|yards|yd"),
    "mile": ("length", 1609.344, 0.0, "mile|miles|mi"),
    "kilogram": ("mass", 1.0, 0.0, "kilogram|kilograms|kg"),
    "gram": ("mass", 0.001, 0.0, "gram|grams|g"),
    "tonne": ("mass", 1000.0, 0.0, "tonne|tonnes|metric ton|metric tons|t"),
    "pound": ("mass", 0.45359237, 0.0, "pound|pounds|lb|lbs"),
    "ounce": ("mass", 0.028349523125, 0.0, "ounce|ounces|oz"),
    "square metre": ("area", 1.0, 0.0, "square metre|square metres|square meter|square meters|m2|sq m"),
    "square kilometre": ("area", 1e6, 0.0, "square kilometre|square kilometres|square kilometer|square kilometers|km2|sq km"),
    "hectare": ("area", 1e4, 0.0, "hectare|hectares|ha"),
    "acre": ("area", 4046.8564224, 0.0, "acre|acres|ac"),
    "square mile": ("area", 2589988.110336, 0.0, "square mile|square miles|sq mi|mi2"),
    "cubic metre": ("volume", 1.0, 0.0, "cubic metre|cubic metres|cubic meter|cubic meters|m3"),
    "litre": ("volume", 0.001, 0.0, "litre|litres|liter|liters|l"),
    "cubic foot": ("volume", 0.028316846592, 0.0, "cubic foot|cubic feet|cu ft|ft3"),
    "US gallon": ("volume", 0.003785411784, 0.0, "us gallon|us gallons|gallon (us)|us gal"),
    "second": ("duration", 1.0, 0.0, "second|seconds|sec|s"),
    "minute": ("duration", 60.0, 0.0, "minute|minutes|mins|min"),
    "hour": ("duration", 3600.0, 0.0, "hour|hours|hrs|h"),
    "hour and minute": ("duration", 3600.0, 0.0, "hour and minute"),
    "month": ("age", 1.0, 0.0, "month|months|mo"),
    "year": ("age", 12.0, 0.0, "year|years|yr|y"),
    "kelvin": ("temperature", 1.0, 0.0, "kelvin|k"),
    "degree Celsius": ("temperature", 1.0, 273.15, "degree celsius|celsius|°c|c"),
    "degree Fahrenheit": ("temperature", 5 / 9, 459.67 * 5 / 9, "degree fahrenheit|fahrenheit|°f|f"),
    "metre per second": ("speed", 1.0, 0.0, "metre per second|metres per second|meter per second|meters per second|m/s"),
    "kilometre per hour": ("speed", 1 / 3.6, 0.0, "kilometre per hour|kilometres per hour|km/h|kmh|kph"),
    "mile per hour": ("speed", 0.44704, 0.0, "mile per hour|miles per hour|mph|mi/h"),
    "knot": ("speed", 1852 / 3600, 0.0, "knot|knots|kn"),
    "watt": ("power", 1.0, 0.0, "watt|watts|w"),
    "kilowatt": ("power", 1e3, 0.0, "kilowatt|kilowatts|kw"),
    "megawatt": ("power", 1e6, 0.0, "megawatt|megawatts|mw"),
    "pascal": ("pressure", 1.0, 0.0, "pascal|pa"),
    "kilopascal": ("pressure", 1e3, 0.0, "kilopascal|kilopascals|kpa"),
    "bar": ("pressure", 1e5, 0.0, "bar|bars"),
    "psi": ("pressure", 6894.757293168, 0.0, "psi|pound per square inch|pounds per square inch"),
}
WIDE_DIGITS = "０１２３４５６７８９"
BLANKS = "    　\t\n\r"

TOLERANCE = 0.01


def alias_table(spark: SparkSession) -> DataFrame:
    """dimension, alias, unit, factor, offset: a constant of some 150 rows."""
    rows = [(d, a, u, f, o) for u, (d, f, o, names) in UNITS.items() for a in names.split("|")]
    return spark.createDataFrame(rows, "dimension string, alias string, unit string, factor double, offset double")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def plain(text: Column) -> Column:
    """Lower case, plain digits, single plain blanks, none at the ends."""
    plain_chars = F.translate(text, WIDE_DIGITS + BLANKS + "²³−’＋．，", "0123456789" + " " * len(BLANKS) + "23-'+.,")
    return F.trim(F.regexp_replace(F.lower(plain_chars), r"\s+", " "))


def _number(text: Column) -> Column:
    """A number as people write it: signs, grouping by comma, blank, apostrophe or dot, decimal point or comma, powers of
    ten.  A comma before exactly three digits groups (unless it follows a lone 0).  NULL for anything else."""
    sign, power = (F.regexp_extract(text, r"^([+-]?)(\d[\d.,' ]*?)(e[+-]?\d+)?$", i) for i in (1, 3))
    digits = lambda body: (
        F.when(body.rlike(r"^[1-9]\d{0,2}([,' ]\d{3})+(\.\d+)?$"), F.regexp_replace(body, r"[,' ]", ""))
        .when(body.rlike(r"^[1-9]\d{0,2}(\.\d{3})+,\d+$"), F.regexp_replace(F.regexp_replace(body, r"\.", ""), ",", "."))
        .when(body.rlike(r"^[1-9]\d{0,2}(\.\d{3}){2,}$"), F.regexp_replace(body, r"\.", ""))
        .when(body.rlike(r"^\d+([.,]\d+)?$"), F.regexp_replace(body, ",", "."))
    )
    body = F.regexp_extract(text, r"^([+-]?)(\d[\d.,' ]*?)(e[+-]?\d+)?$", 2)
    return F.concat(sign, let(body, digits), power).try_cast("double")


def number_and_unit(value: Column) -> Column:
    """``number`` and ``unit`` of a text as a struct: the number in it and the unit written with it (NULL without one).
    Hours with minutes and feet with inches are units of their own.  Both are NULL where the text is not one number with at
    most one unit."""
    clock = r"^(\d+) ?(?:h|hrs?|hours?) ?(\d+) ?(?:m|min|mins|minutes?)$"
    colon = r"^(\d+):(\d\d) ?(?:h|hrs?|hours?)$"
    feet = r"^(\d+) ?(?:'|ft\.?|feet|foot) ?(\d+(?:[.,]\d+)?) ?(?:\"|in\.?|inch|inches)$"
    simple = r"^([+-]?\d[\d.,' ]*?(?:e[+-]?\d+)?) ?([^\d\s.,'+:-][^+:]*)?$"

    def read(text: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.regexp_replace(F.regexp_extract(text, pattern, group), ",", ".").try_cast("double")

        def pair(number: Column, unit: Column) -> Column:
            return F.struct(number.alias("number"), unit.alias("unit"))

        number = _number(F.regexp_extract(text, simple, 1))
        return (
            F.when(text.rlike(clock), pair(part(clock, 1) + part(clock, 2) / 60, F.lit("hour and minute")))
            .when(text.rlike(colon), pair(part(colon, 1) + part(colon, 2) / 60, F.lit("hour and minute")))
            .when(text.rlike(feet), pair(part(feet, 1) + part(feet, 2) / 12, F.lit("foot and inch")))
            .when(text.rlike(simple), let(number, lambda n: pair(n, F.when(n.isNotNull(), F.nullif(F.trim(F.regexp_extract(text, simple, 2)), F.lit(""))))))
        )

    return let(F.regexp_replace(plain(value), r"^(about|around|roughly|approximately|approx\.?|circa|ca\.?|~|≈)\s*", ""), read)


def plain_key(key: Column) -> Column:
    return plain(key)


def distinct_rows(attributes: DataFrame) -> DataFrame:
    """Each delivered row once: a row sent again differs in ``loaded_at`` only."""
    columns = ["row_id", "entity_id", "key", "value", "datatype", "unit", "source", "recorded_at"]
    return attributes.select(*columns).dropDuplicates(columns)


def convert(rows: DataFrame, common_units: DataFrame) -> DataFrame:
    """Every row of a measured key, with ``number``, ``unit``, ``unit_from`` (field, text, source) and ``common_value`` in
    ``common_unit``; all of these but ``common_unit`` are NULL where ``value`` gives no number, and ``common_value`` is NULL
    for a unit of another dimension or an unknown one.

    Rows with a NULL or unmeasured key are left out; other columns pass through; the names added replace columns of the
    same name.  An empty table gives an empty result.  Repeated rows stay repeated (see ``distinct_rows``).
    """
    spark = rows.sparkSession
    aliases = alias_table(spark)
    keys = common_units.select(plain_key(F.col("key")).alias("_key"), "dimension", F.col("common_unit").alias("_common")).dropDuplicates(["_key"])
    base = aliases.select("dimension", F.lower("unit").alias("_l"), F.col("factor").alias("_cf"), F.col("offset").alias("_co")).distinct()
    # Both tables are constants of this project's data model, a row per measured key.
    keys = keys.join(base, (keys.dimension == base.dimension) & (F.lower("_common") == base["_l"])).select(keys.dimension, "_key", "_common", "_cf", "_co")
    added = ["number", "unit", "unit_from", "common_value", "common_unit"]
    kept = [c for c in rows.columns if c not in added]
    # What passes through travels as one struct, so that no name of it can clash.
    out = (
        rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), plain_key(F.col("key")).alias("_key"), F.col("source").alias("_source"), number_and_unit(F.col("value")).alias("_read"), F.nullif(plain(F.col("unit")), F.lit("")).alias("_field"))
        .join(F.broadcast(keys), "_key")
        .withColumn("_number", F.col("_read.number"))
        .withColumn("_text", F.col("_read.unit"))
    )
    one = F.col("_field") == "1"
    field = F.when(one, None).otherwise(F.col("_field"))
    counted = (F.col("dimension") == "count") & F.coalesce(field, F.col("_text")).isNull()
    out = out.withColumn("_alias", F.coalesce(field, F.col("_text"), F.when(counted, "1")))
    origin = F.when(field.isNotNull() | counted, "field").when(F.col("_text").isNotNull(), "text")
    out = out.withColumn("_from", origin)
    own = aliases.withColumnRenamed("dimension", "_d")
    out = out.join(F.broadcast(own), (F.col("dimension") == F.col("_d")) & (F.col("_alias") == F.col("alias")), "left").withColumnsRenamed({"unit": "_unit", "factor": "_factor", "offset": "_offset"})
    out = cut(out)  # what is read from the texts is written once: habits and rows below both start from it
    simple = F.col("_unit").isNotNull() & ~F.col("_unit").isin("hour and minute", "foot and inch")
    habit = out.filter(simple).groupBy(F.col("_source").alias("_hsource"), F.col("_key").alias("_hkey"), "_unit", "_factor", "_offset").count()
    habit = habit.groupBy("_hsource", "_hkey").agg(F.max(F.struct("count", F.col("_unit").alias("u"), F.col("_factor").alias("f"), F.col("_offset").alias("o"))).alias("_h"))
    out = out.join(habit, F.col("_source").eqNullSafe(F.col("_hsource")) & (F.col("_key") == F.col("_hkey")), "left")
    habitual = F.col("_alias").isNull()
    unit, factor, offset = (F.when(habitual, F.col(f"_h.{h}")).otherwise(F.col(c)) for h, c in (("u", "_unit"), ("f", "_factor"), ("o", "_offset")))
    given = F.col("_number").isNotNull()
    return out.select(
        *(F.col("_row").getField(c).alias(c) for c in kept),
        F.col("_number").alias("number"),
        F.when(given, unit).alias("unit"),
        F.when(given & unit.isNotNull(), F.coalesce("_from", F.lit("source"))).alias("unit_from"),
        F.when(unit == F.col("_common"), F.col("_number")).otherwise((F.col("_number") * factor + offset - F.col("_co")) / F.col("_cf")).alias("common_value"),
        F.col("_common").alias("common_unit"),
    )


def alike(a: Column, b: Column) -> Column:
    """Whether two quantities differ by at most 1 % of the larger; nine digits decide, so that rounding of the conversion
    does not."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * (TOLERANCE * (1 + 1e-9))


def agreeing_pairs(converted: DataFrame) -> DataFrame:
    """Pairs of rows of one entity and key that state the same quantity in different units: ``row_a``, ``row_b``.

    Values are put into cells of a logarithmic scale as wide as the tolerance, and a row meets only rows of its own cell and
    the two beside it: a hot entity or key is split by value, and no pair of unlike values is ever formed.  Rows whose unit
    is only the habit of their source belong to no pair, nor do rows with a NULL entity or row_id.
    """
    width = -math.log(1 - TOLERANCE) * (1 + 1e-6)
    rows = converted.filter(F.col("common_value").isNotNull() & (F.col("unit_from") != "source") & F.col("entity_id").isNotNull() & F.col("row_id").isNotNull())
    v = F.col("common_value")
    rows = rows.select(
        "row_id", "entity_id", plain_key(F.col("key")).alias("key"), "unit", v.alias("value"), F.signum(v).cast("int").alias("sign"),
        F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(v)) / width)).alias("cell"),
    )
    rows = cut(rows)  # both sides of the join start from it
    left = rows.select("entity_id", "key", "sign", "cell", F.col("row_id").alias("a"), F.col("unit").alias("ua"), F.col("value").alias("va"))
    right = rows.select("entity_id", "key", "sign", F.explode(F.array(*(F.col("cell") + i for i in (-1, 0, 1)))).alias("cell"), F.col("row_id").alias("b"), F.col("unit").alias("ub"), F.col("value").alias("vb"))
    met = left.join(right, ["entity_id", "key", "sign", "cell"]).filter((F.col("a") < F.col("b")) & (F.col("ua") != F.col("ub")) & alike(F.col("va"), F.col("vb")))
    return met.select(F.col("a").alias("row_a"), F.col("b").alias("row_b")).distinct()
