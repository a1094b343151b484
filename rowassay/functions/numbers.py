"""Number and boolean parsing of text, without a cast that could raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from rowassay.functions.text import strip

# Texts read as booleans after trimming and lower-casing.
TRUE_TOKENS = ["true", "yes", "1", "t", "y", "on"]
FALSE_TOKENS = ["false", "no", "0", "f", "n", "off"]

_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
INTEGER = rf"^[+-]?{_DIGITS}$"
FLOAT = (
    rf"(?i)^[+-]?(?:inf|infinity|nan|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
    rf"(?:e[+-]?{_DIGITS})?)$"
)

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*WHOLE, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dtype: T.DataType | None) -> bool:
    return isinstance(dtype, NUMERIC)


def looks_integer(text: Column) -> Column:
    """An integer literal once commas are gone."""
    return strip(F.translate(text, ",", "")).rlike(INTEGER)


def looks_float(text: Column) -> Column:
    """A float literal once commas and dollar signs are gone."""
    return strip(F.translate(text, ",$", "")).rlike(FLOAT)


def looks_boolean(text: Column) -> Column:
    return F.lower(strip(text)).isin(TRUE_TOKENS + FALSE_TOKENS)


def to_double(text: Column, ignore: str = "") -> Column:
    """The text as a double, or null. ``ignore`` lists characters removed beforehand.

    The pattern guards the cast: Spark would also accept suffixes such as ``1.5f``.
    """
    clean = strip(F.translate(text, ignore, "") if ignore else text)
    return F.when(clean.rlike(FLOAT), F.translate(clean, "_", "").try_cast("double"))


def number(c: Column, dtype: T.DataType | None, ignore: str = "") -> Column:
    """A typed numeric column as is, anything else parsed; NaN counts as null."""
    if is_numeric(dtype):
        x = c.cast("double")
    elif isinstance(dtype, T.BooleanType):
        x = c.cast("int").cast("double")
    else:
        x = to_double(c if isinstance(dtype, T.StringType) else c.cast("string"), ignore)
    return F.when(~F.isnan(x), x)


def integer_text(clean: Column) -> Column:
    """Canonical digits of an integer literal of any length."""
    plain = F.regexp_replace(F.translate(clean, "_+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)
