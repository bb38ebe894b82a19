"""Lenient number reading and C-style formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as the numeric start of a text.
INTEGER = r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)"
REAL = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"

PLAIN = r"^[+-]?[0-9]+(?:\.[0-9]*)?\z"

HEXADECIMAL = r"^[ \t\n\x0B\f\r]*([+-]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?[0-9]+))?"


def leading_long(text: Column) -> Column:
    """Leading integer, 0 where there is none; the nearest 64-bit number where it does not fit. A text that is a number as Spark writes it is read without a regular expression."""
    own = text.try_cast("bigint")
    digits = F.regexp_extract(text, INTEGER, 1)
    bound = F.when(digits.startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    return F.when(own.cast("string") == text, own).otherwise(F.coalesce(digits.try_cast("bigint"), F.when(digits != "", bound), F.lit(0).cast("bigint")))


def leading_int(text: Column) -> Column:
    """The low 32 bits of leading_long, as a signed number."""
    own = text.try_cast("int")
    low = leading_long(text).bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(own.cast("string") == text, own).otherwise(F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int"))


def leading_float(text: Column) -> Column:
    """Leading real number as a 32-bit float, 0 where there is none; inf, nan and hexadecimal numbers are read too."""
    low = F.lower(F.trim(text))
    part = lambda g: F.regexp_extract(text, HEXADECIMAL, g)
    whole = lambda hexa: F.coalesce(F.conv(F.substring(hexa, 1, 15), 16, 10).cast("double"), F.lit(0.0)) * F.pow(F.lit(16.0), F.greatest(F.length(hexa) - 15, F.lit(0)))
    after = F.substring(part(3), 1, 15)
    size = (whole(part(2)) + F.coalesce(F.conv(after, 16, 10).cast("double"), F.lit(0.0)) / F.pow(F.lit(16.0), F.length(after))) * F.pow(F.lit(2.0), F.coalesce(part(4).try_cast("double"), F.lit(0.0)))
    hexadecimal = F.when(text.rlike(HEXADECIMAL), F.when(part(1) == "-", -size).otherwise(size))
    special = F.when(low.rlike("^[+-]?nan"), F.lit(float("nan"))).when(low.rlike("^-inf"), F.lit(float("-inf"))).when(low.rlike("^[+]?inf"), F.lit(float("inf")))
    lenient = F.coalesce(special, hexadecimal, F.regexp_extract(text, REAL, 1).try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(PLAIN), text.try_cast("double")).otherwise(lenient).cast("float")


def six_digits(x: Column | str) -> Column:
    """`%g` of a 32-bit float: six significant digits, no trailing zeros, halves to even; null stays null.

    The JVM rounds halves up, from the shortest digits that tell a double from its neighbours. Those digits are the value itself where it is a half, so halves are
    seen by them and cut off after an even digit.

    A number whose shortest digits are at most six, and which the JVM writes without an exponent, has these digits: six of them tell 32-bit floats apart. The others are formatted
    once, and the parts of that text are bound by lambdas, as column expressions that repeat would be evaluated each time."""
    own = F.col(x) if isinstance(x, str) else x
    d = own.cast("double")
    size, shortest = F.abs(d), F.abs(own).cast("string")
    plain = (size >= 0.001) & (size < 1e6) & (F.length(shortest) <= 7) & F.contains(shortest, F.lit("."))
    rest = F.transform(F.array(F.struct(F.format_string("%.16e", size).alias("long"), F.format_string("%.5e", size).alias("short"))), lambda f: _six_of(f["long"], f["short"]))
    far = F.get(F.transform(rest, _pointed), F.lit(0))
    number = F.when(plain, F.rtrim(F.rtrim(shortest, F.lit("0")), F.lit("."))).when(size == 0, "0").when(size == float("inf"), "inf").otherwise(far)
    minus = (d < 0) | ((d == 0) & d.cast("string").startswith("-"))
    return F.when(d.isNull(), None).when(F.isnan(d), "nan").otherwise(F.concat(F.when(minus, "-").otherwise(""), number))


def _six_of(long: Column, short: Column) -> Column:
    """Six digits with a point after the first, then the exponent."""
    half = long.rlike(r"^[0-9]\.[0-9]{4}[02468]50*e")
    return F.when(half, F.concat(F.substring(long, 1, 7), F.substring_index(long, "e", -1))).otherwise(F.concat(F.substring(short, 1, 7), F.substring_index(short, "e", -1)))


def _pointed(text: Column) -> Column:
    """The text of _six_of as %g writes it."""
    digits, exponent = F.concat(F.substring(text, 1, 1), F.substring(text, 3, 5)), F.substr(text, F.lit(8)).cast("int")
    trim = lambda c: F.rtrim(c, F.lit("0"))
    pointed = lambda whole, part: F.concat(whole, F.when(trim(part) == "", "").otherwise(F.concat(F.lit("."), trim(part))))
    far = F.concat(pointed(F.substring(digits, 1, 1), F.substr(digits, F.lit(2))), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    near = F.when(exponent >= 0, pointed(F.substr(digits, F.lit(1), exponent + 1), F.substr(digits, exponent + 2))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), trim(digits)))
    return F.when((exponent < -4) | (exponent >= 6), far).otherwise(near)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0.0 where whole is 0."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
