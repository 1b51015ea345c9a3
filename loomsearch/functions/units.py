"""Unit conversions asked for in a query, and their answers as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit, dimension, factor to the dimension's base unit, and the names people type.
UNITS = [
    ("bytes", "data", 1.0, "b byte bytes"), ("kilobytes", "data", 1e3, "kb kilobyte kilobytes"), ("megabytes", "data", 1e6, "mb megabyte megabytes"),
    ("gigabytes", "data", 1e9, "gb gigabyte gigabytes"), ("terabytes", "data", 1e12, "tb terabyte terabytes"), ("petabytes", "data", 1e15, "pb petabyte petabytes"),
    ("kibibytes", "data", 1024.0, "kib kibibyte kibibytes"), ("mebibytes", "data", 1024.0**2, "mib mebibyte mebibytes"),
    ("gibibytes", "data", 1024.0**3, "gib gibibyte gibibytes"), ("tebibytes", "data", 1024.0**4, "tib tebibyte tebibytes"),
    ("millimetres", "length", 0.001, "mm millimetre millimetres millimeter millimeters"), ("centimetres", "length", 0.01, "cm centimetre centimetres centimeter centimeters"),
    ("metres", "length", 1.0, "m metre metres meter meters"), ("kilometres", "length", 1000.0, "km kilometre kilometres kilometer kilometers"),
    ("inches", "length", 0.0254, "in inch inches"), ("feet", "length", 0.3048, "ft foot feet"), ("yards", "length", 0.9144, "yd yard yards"), ("miles", "length", 1609.344, "mi mile miles"),
    ("grams", "mass", 1.0, "g gram grams"), ("kilograms", "mass", 1000.0, "kg kilo kilos kilogram kilograms"), ("tonnes", "mass", 1e6, "t tonne tonnes"),
    ("ounces", "mass", 28.349523125, "oz ounce ounces"), ("pounds", "mass", 453.59237, "lb lbs pound pounds"), ("stone", "mass", 6350.29318, "st stone stones"),
    ("milliseconds", "time", 0.001, "ms millisecond milliseconds"), ("seconds", "time", 1.0, "s sec secs second seconds"), ("minutes", "time", 60.0, "min mins minute minutes"),
    ("hours", "time", 3600.0, "h hr hrs hour hours"), ("days", "time", 86400.0, "d day days"), ("weeks", "time", 604800.0, "wk week weeks"),
    ("Celsius", "temperature", 1.0, "c °c celsius centigrade"), ("Fahrenheit", "temperature", 1.0, "f °f fahrenheit"), ("Kelvin", "temperature", 1.0, "k kelvin"),
]
ASK = r"^\s*([0-9.,-]+)\s*([A-Za-z°]+)\s+(?:to|in|as|into)\s+([A-Za-z°]+)\s*$"
AMOUNT = r"^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def shown(x: Column) -> Column:
    """A number for reading: thousands marked, more decimals the smaller it is, no zeros at the end."""
    plain = lambda d: F.regexp_replace(F.format_number(F.round(x, d), d), r"[.]?0+$", "")
    size = F.abs(x)
    out = F.when(size == 0, "0").when(size < 1, plain(6)).when(size < 1000, plain(4)).otherwise(plain(2))
    return F.when(out.isin("", "-", "-0"), "0").otherwise(out)


def sentence(amount: Column, unit_from: Column, converted: Column, unit_to: Column) -> Column:
    """The conversion in words; a unit of which there is one loses its last s."""
    one = lambda x, u: F.when(F.abs(x) == 1, F.regexp_replace(u, "s$", "")).otherwise(u)
    return F.concat(shown(amount), F.lit(" "), one(amount, unit_from), F.lit(" is "), shown(converted), F.lit(" "), one(converted, unit_to), F.lit("."))


def convert(queries: DataFrame, id_col: str, query_col: str) -> DataFrame:
    """(id_col, amount, unit_from, unit_to, converted, answer) of queries that ask for a conversion.

    The whole query must be an amount, a known unit, a joining word and another known unit of
    the same dimension. Two spellings of one unit, null queries and amounts that are no number give
    no row. The unit table is fixed, so its broadcast is bounded.
    """
    spark = queries.sparkSession
    table = spark.createDataFrame([(n, u, k, f) for u, k, f, names in UNITS for n in names.split()], "name string, unit string, dimension string, factor double")
    part = lambda n: F.regexp_extract(query_col, ASK, n)
    number = F.regexp_replace(part(1), ",", "")
    asked = queries.where(F.col(query_col).rlike(ASK)).select(F.col(id_col), F.when(number.rlike(AMOUNT), number).cast("double").alias("amount"), F.lower(part(2)).alias("a"), F.lower(part(3)).alias("b"))
    a = F.broadcast(table.select(F.col("name").alias("a"), "dimension", F.col("unit").alias("unit_from"), F.col("factor").alias("f_from")))
    b = F.broadcast(table.select(F.col("name").alias("b"), "dimension", F.col("unit").alias("unit_to"), F.col("factor").alias("f_to")))
    both = asked.where("amount is not null").join(a, "a").join(b, ["b", "dimension"]).where("unit_from <> unit_to")
    is_ = lambda c, u: F.col(c) == u
    celsius = F.when(is_("unit_from", "Fahrenheit"), (F.col("amount") - 32) * 5 / 9).when(is_("unit_from", "Kelvin"), F.col("amount") - 273.15).otherwise(F.col("amount"))
    out = F.when(is_("unit_to", "Fahrenheit"), celsius * 9 / 5 + 32).when(is_("unit_to", "Kelvin"), celsius + 273.15).otherwise(celsius)
    value = F.when(is_("dimension", "temperature"), out).otherwise(F.col("amount") * F.col("f_from") / F.col("f_to"))
    done = both.select(id_col, "amount", "unit_from", "unit_to", value.alias("converted"))
    return done.withColumn("answer", sentence(F.col("amount"), F.col("unit_from"), F.col("converted"), F.col("unit_to")))
