"""Text expressions. Everything here is a built-in Spark expression and stays in whole-stage codegen."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Every character Python's str.strip() treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Unicode "other" and "separator" characters, keeping space, tab, LF and CR.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \t\n\r]]"
_WORDS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def col(name: str) -> Column:
    """A column reference that is safe for names holding dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(c: Column, dtype: T.DataType | None = None) -> Column:
    """Null, or NaN for floating columns."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """The value as text; a floating NaN is missing, so it becomes null. Decimals end without zeros."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), float_text(c))
    if isinstance(dtype, T.DecimalType) and dtype.scale:
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def float_text(x: Column) -> Column:
    """A float in plain notation between 1e-4 and 1e16, else with a short exponent."""
    raw = x.cast("string")
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    short = F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E(?<s>-?)(?<d>\d)$", "E${s}0${d}")
    short = F.regexp_replace(F.regexp_replace(short, r"E(\d)", "e+$1"), "E", "e")
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~raw.contains("E"), raw)
        .when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain)
        .otherwise(short)
    )


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def printable(c: Column) -> Column:
    return F.regexp_replace(c, _UNPRINTABLE, "")


def title_case(c: Column) -> Column:
    """Capital after every non-letter, unlike initcap, which only looks at spaces."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(_WORDS), F.lit(0))
    cased = F.transform(
        parts,
        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1)),
    )
    return F.array_join(cased, "")


def change_case(c: Column, case: str | None) -> Column:
    if case == "lower":
        return F.lower(c)
    if case == "upper":
        return F.upper(c)
    if case == "title":
        return title_case(c)
    return c


def drop_punctuation(c: Column, keep: str = "") -> Column:
    gone = "".join(ch for ch in string.punctuation if ch not in set(keep))
    return F.translate(c, gone, "") if gone else c


def escape_formula(c: Column) -> Column:
    """Quote text a spreadsheet would run as a formula."""
    return F.when(
        F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)
    ).otherwise(c)


def null_if_token(c: Column, tokens: list[str]) -> Column:
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c) if tokens else c
