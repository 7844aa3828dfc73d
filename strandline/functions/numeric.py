"""The numbers that values can be read as, and how results are written.

A value is text; these rules say which texts are 64-bit floats and integers.  The casts of Spark
accept more (blanks, suffixes, hexadecimal), so a pattern stands before each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

F64 = r"\A[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"
I64 = r"\A[+-]?[0-9]+\z"
#: Values that a decimal sum takes exactly.
PLAIN = r"\A[+-]?[0-9]{1,18}(?:\.[0-9]{1,6})?\z"
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


def parse_f64(value: Column) -> Column:
    """The float that a text stands for, null if none: sign, digits, point and exponent, or inf, infinity, nan."""
    bare = F.regexp_replace(F.lower(value), r"\A[+-]", "")
    negative = value.startswith("-")
    inf = F.when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    named = F.when(bare == "nan", F.lit(float("nan"))).when(bare.isin("inf", "infinity"), inf)
    return F.when(value.rlike(F64), F.coalesce(named, value.try_cast("double")))


def parse_i64(value: Column) -> Column:
    """The integer that a text stands for, null if none or out of range."""
    return F.when(value.rlike(I64), value.try_cast("bigint"))


def integer_of(text: str) -> int:
    """As parse_i64, on the driver; raises ValueError with the reason."""
    digits = text[1:] if text[:1] in ("+", "-") else text
    if not text:
        raise ValueError("cannot parse integer from empty string")
    if not digits or not all("0" <= c <= "9" for c in digits):
        raise ValueError("invalid digit found in string")
    n = int(text)
    if n > INT_MAX:
        raise ValueError("number too large to fit in target type")
    if n < INT_MIN:
        raise ValueError("number too small to fit in target type")
    return n


def format_f64(x: float) -> str:
    """Shortest text that reads back as ``x``: with a point from 1e-4 to below 1e16, else with an exponent."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    return f"{mantissa.removesuffix('.0')}e{int(exponent)}"
