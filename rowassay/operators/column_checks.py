"""Column checks that look at one value. Each builds a Column that is true where the value fails.

All skip nulls except ``not_null``. A registry maps the rule name to its builder, and further
checks, also vectorized Python ones, can be added with ``register``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from rowassay.functions import dates, numbers, presets
from rowassay.functions.patterns import OnlyPython, java_regex
from rowassay.functions.text import as_text, col, is_missing, strip

Builder = Callable[[Column, T.DataType, dict, str], Column]
ROW_CHECKS: dict[str, Builder] = {}


def register(name: str):
    def add(builder: Builder) -> Builder:
        ROW_CHECKS[name] = builder
        return builder

    return add


def fails(name: str, c: Column, dtype: T.DataType, params: dict | None = None, declared: str = "text") -> Column:
    """True where the value fails the check, false elsewhere, never null."""
    bad = F.coalesce(ROW_CHECKS[name](c, dtype, params or {}, declared), F.lit(False))
    return bad if name == "not_null" else bad & ~is_missing(c, dtype)


@register("not_null")
def not_null(c, dtype, params, declared):
    return is_missing(c, dtype)


@register("type_conformance")
def type_conformance(c, dtype, params, declared):
    if numbers.is_numeric(dtype) and declared in ("integer", "float"):
        # a typed number conforms, but the text of a fraction is no integer literal
        return F.lit(declared == "integer" and not isinstance(dtype, numbers.WHOLE))
    text = as_text(c, dtype)
    if declared == "integer":
        return ~numbers.looks_integer(text)
    if declared == "float":
        return ~numbers.looks_float(text)
    if declared == "boolean":
        return ~numbers.looks_boolean(text)
    if declared in ("date", "timestamp"):
        return text.isNotNull() & dates.moment(c, dtype).isNull()
    return F.lit(False)


@register("range")
def in_range(c, dtype, params, declared):
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    x = numbers.number(c, dtype, ",$%")
    return _outside(x, params.get("min"), params.get("max"), lambda b: F.lit(float(b)))


@register("length")
def length(c, dtype, params, declared):
    size = F.length(as_text(c, dtype))
    return _outside(size, params.get("min"), params.get("max"), lambda b: F.lit(int(b)))


def _outside(x: Column, low, high, literal) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (x < literal(low))
    if high is not None:
        bad = bad | (x > literal(high))
    return bad


#: Allowed values that stay in the plan; more of them become a table.
LISTED = 1000


def allowed_values(params: dict) -> list | DataFrame:
    values = params.get("allowed_values")
    if params.get("preset"):
        values = presets.value_list(params["preset"]) or values
    return values if isinstance(values, DataFrame) else values or []


def compared(c: Column, dtype: T.DataType, params: dict) -> Column:
    """A value as the list is asked for it: trimmed text, in upper case where case is ignored."""
    text = strip(as_text(c, dtype))
    return F.upper(text) if params.get("case_insensitive", True) else text


def listed(values: list, params: dict) -> list[str]:
    texts = [str(v) for v in values]
    return [v.strip() for v in (map(str.upper, texts) if params.get("case_insensitive", True) else texts)]


def value_table(spark: SparkSession, values: list | DataFrame, params: dict) -> DataFrame:
    """The allowed values as a table of one column, ``value``: of a list, or of a table's first column."""
    if isinstance(values, DataFrame):
        first = values.schema[0]
        return values.select(compared(col(first.name), first.dataType, params).alias("value")).where("value IS NOT NULL")
    return spark.createDataFrame(pd.DataFrame({"value": list(dict.fromkeys(listed(values, params)))}), "value string")


@register("enum")
def allowed(c, dtype, params, declared):
    values = allowed_values(params)
    if isinstance(values, DataFrame):
        raise ValueError("a table of allowed values is no expression; check it with validate()")
    text = compared(c, dtype, params)
    return ~text.isin(listed(values, params)) if values else text.isNotNull()


def pattern_of(params: dict) -> str | None:
    """The pattern a rule asks for: a preset, builder settings, or its own text."""
    tier = params.get("tier", "preset")
    if tier == "preset":
        return presets.PATTERNS.get(params.get("preset_name"))
    if tier == "builder":
        spec = params.get("builder") or {k: v for k, v in params.items() if k != "tier"}
        if spec.get("contains"):
            return "[\\s\\S]*" + re.escape(spec["contains"])
        return presets.built_pattern(spec)
    return params.get("pattern")


@register("pattern")
def pattern(c, dtype, params, declared):
    text = as_text(c, dtype)
    wanted = pattern_of(params)
    if not wanted:
        return F.lit(False)
    try:
        java = java_regex(wanted)
    except OnlyPython:
        return text.isNotNull() & ~_python_match(wanted)(text)
    return text.isNotNull() if java is None else ~text.rlike(java)


def _python_match(wanted: str):
    """For patterns only Python understands: matched in Arrow batches."""

    @F.pandas_udf("boolean")
    def match(values: pd.Series) -> pd.Series:
        found = re.compile(wanted)
        return values.map(lambda v: bool(found.match(v)), na_action="ignore").astype("boolean")

    return match


def date_formats(params: dict) -> list[str]:
    target = params.get("target_format") or "YYYY-MM-DD"
    if params.get("mode", "simple") == "simple":
        return [target]
    return params.get("accepted_input_formats") or [target]


@register("date_rule")
def date_rule(c, dtype, params, declared):
    text = as_text(c, dtype)
    read = dates.parse_any(text, date_formats(params), bool(params.get("excel_serial_enabled")))
    bad = text.isNotNull() & read.isNull()
    printed = _prints_as_asked(c, dtype, date_formats(params))
    return bad if printed is None else F.when(printed, False).otherwise(bad)


def _prints_as_asked(c: Column, dtype: T.DataType, formats: list[str]) -> Column | None:
    """True where a date or a time in whole seconds prints in one of the formats, so that its text need not be read."""
    if isinstance(dtype, T.DateType):
        return c.between(F.lit(date(1000, 1, 1)), F.lit(date(9999, 12, 31))) if "YYYY-MM-DD" in formats else None
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and "YYYY-MM-DD HH:mm:ss" in formats:
        first, last = (F.lit(t).cast("timestamp_ntz") for t in ("1000-01-01 00:00:00", "9999-12-31 23:59:59"))
        return (F.unix_micros(c.cast("timestamp")) % 1_000_000 == 0) & c.cast("timestamp_ntz").between(first, last)
    return None


@register("date_window")
def date_window(c, dtype, params, declared):
    at = dates.moment(c, dtype)
    low = params.get("min_date") or params.get("not_before")
    high = params.get("max_date") or params.get("not_after")
    return _outside(at, low, high, _moment_literal)


def _moment_literal(bound) -> Column:
    if isinstance(bound, (date, datetime)):
        bound = bound.isoformat(sep=" ") if isinstance(bound, datetime) else bound.isoformat()
    return dates.guess(F.lit(str(bound)))
