"""Checks over several columns or the whole table.

``*_report`` functions return one row of counts. The flags and key tables they rest on are also
used by ``rowassay.plans.report`` to label rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions import dates, numbers
from rowassay.functions.text import as_text, col, is_missing
from rowassay.operators import keys
from rowassay.operators.quantiles import exact_quantiles

IQR_MULTIPLIER = 1.5
ZSCORE_THRESHOLD = 3.0
#: One over the part of all rows by which the rank of an approximate quartile may be off.
SKETCH_ACCURACY = 10_000


def duplicate_report(df: DataFrame, subset: list[str] | None = None, hash_first: bool | None = None) -> DataFrame:
    """All copies of repeated rows, the number of groups, and the copies after the first."""
    groups = keys.repeated(df, subset or df.columns, hash_first)
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("surplus_rows"),
    ).withColumn("passed", F.col("duplicate_rows") == 0)


def duplicate_examples(df: DataFrame, key_columns: list[str], limit: int = 10) -> DataFrame:
    """A few repeated keys, lowest first."""
    return keys.repeated(df, key_columns).drop("__n").orderBy(*[col(k) for k in key_columns]).limit(limit)


def key_null_flag(df: DataFrame, key_columns: list[str]) -> Column:
    present = [k for k in key_columns if k in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    return reduce(Column.__or__, [is_missing(col(k), types[k]) for k in present], F.lit(False))


def key_completeness_report(df: DataFrame, key_columns: list[str]) -> DataFrame:
    """Nulls summed over the key columns, and rows holding any."""
    present = [k for k in key_columns if k in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    nulls = reduce(
        Column.__add__, [F.count_if(is_missing(col(k), types[k])) for k in present], F.lit(0)
    )
    out = df.agg(
        nulls.cast("bigint").alias("null_values"),
        F.count_if(key_null_flag(df, key_columns)).alias("affected_rows"),
    )
    return out.withColumn("passed", (F.col("null_values") == 0) & F.lit(bool(key_columns)))


# --- cross-field rules -------------------------------------------------------------------------

_OPERATORS = ["<=", ">=", "==", "!=", "<", ">", "="]


class Operand:
    """One side of a comparison: a column with its declared type, or a literal."""

    def __init__(self, text: str, df: DataFrame, view: dict[str, str], declared: dict[str, str]):
        self.name = text if text in view else None
        self.text = text
        if self.name:
            self.column = col(view[text])
            self.dtype = df.schema[view[text]].dataType
            self.kind = self._column_kind(declared.get(text, "text"))
        else:
            self.kind = self._literal_kind()

    def _column_kind(self, declared: str) -> str:
        if numbers.is_numeric(self.dtype) or declared in ("integer", "float"):
            return "number"
        if isinstance(self.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "moment"
        if declared in ("date", "timestamp"):
            return "moment"
        if isinstance(self.dtype, T.BooleanType) or declared == "boolean":
            return "flag"
        return "text"

    def _literal_kind(self) -> str:
        if re.fullmatch(r"[+-]?\d+(\.\d*)?|[+-]?\.\d+", self.text):
            return "number"
        if self.text.lower() in ("true", "false"):
            return "flag"
        return "text"

    def as_kind(self, kind: str) -> Column:
        if not self.name:
            if kind == "number":
                return numbers.to_double(F.lit(self.text))
            plain = self.text
            if len(plain) > 1 and plain[0] == plain[-1] and plain[0] in "\"'":
                plain = plain[1:-1]
            if kind == "moment":
                return dates.guess(F.lit(plain))
            return F.lit(plain.lower() == "true") if kind == "flag" else F.lit(plain)
        if kind == "number":
            whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
            return self.column if isinstance(self.dtype, whole) else numbers.number(self.column, self.dtype)
        if kind == "moment":
            return dates.moment(self.column, self.dtype)
        if kind == "flag":
            if isinstance(self.dtype, T.BooleanType):
                return self.column
            low = F.lower(as_text(self.column, self.dtype))
            return F.when(low.isin(numbers.TRUE_TOKENS), True).when(low.isin(numbers.FALSE_TOKENS), False)
        return as_text(self.column, self.dtype)


def comparison(expression: str, df: DataFrame, view: dict[str, str], declared: dict[str, str]) -> Column:
    """``left op right`` as a boolean that is never null: a null side only satisfies ``!=``."""
    op = next((o for o in _OPERATORS if o in expression), None)
    if op is None:
        raise ValueError(f"no comparison in {expression!r}")
    left, right = (Operand(p.strip(), df, view, declared) for p in expression.split(op, 1))
    kinds = {left.kind, right.kind}
    kind = next((k for k in ("moment", "number", "flag") if k in kinds), "text")
    a, b = left.as_kind(kind), right.as_kind(kind)
    result = {
        "<=": a <= b, ">=": a >= b, "==": a == b, "=": a == b, "!=": a != b, "<": a < b, ">": a > b,
    }[op]
    return F.coalesce(result, F.lit(op == "!="))


def cross_field_flags(
    df: DataFrame, params: dict, declared: dict[str, str] | None = None, view: dict[str, str] | None = None
) -> tuple[Column, Column]:
    """(rows the rule looks at, rows that fail it). Several expressions must all hold."""
    view = view or {c: c for c in df.columns}
    wanted = (params.get("if") or {}).get("all_not_null") or []
    types = {f.name: f.dataType for f in df.schema.fields}
    looked = reduce(
        Column.__and__,
        [~is_missing(col(view[w]), types[view[w]]) for w in wanted if w in view],
        F.lit(True),
    )
    expressions = (params.get("assert") or {}).get("expression")
    if not expressions:
        raise ValueError("no expression")
    if isinstance(expressions, str):
        expressions = [expressions]
    holds = reduce(Column.__and__, [comparison(e, df, view, declared or {}) for e in expressions])
    return looked, looked & ~holds


def cross_field_report(df: DataFrame, params: dict, declared: dict[str, str] | None = None) -> DataFrame:
    looked, failed = cross_field_flags(df, params, declared)
    out = df.agg(F.count_if(looked).alias("rows_checked"), F.count_if(failed).alias("rows_failed"))
    return out.withColumn("passed", F.col("rows_failed") == 0)


# --- outliers ----------------------------------------------------------------------------------


def outlier_value(df: DataFrame, column: str) -> Column:
    return numbers.number(col(column), df.schema[column].dataType)


def iqr_bounds(df: DataFrame, column: str, multiplier: float = IQR_MULTIPLIER) -> dict[str, float | None]:
    return bounds_of(exact_quantiles(df, outlier_value(df, column), [0.25, 0.75]), multiplier)


def bounds_of(quartiles: list[float | None], multiplier: float) -> dict[str, float | None]:
    q1, q3 = quartiles
    if q1 is None:
        return dict(q1=None, q3=None, iqr=None, lower_bound=None, upper_bound=None)
    iqr = q3 - q1
    return dict(q1=q1, q3=q3, iqr=iqr, lower_bound=q1 - multiplier * iqr, upper_bound=q3 + multiplier * iqr)


def iqr_flag(df: DataFrame, column: str, bounds: dict) -> Column:
    if bounds["q1"] is None:
        return F.lit(False)
    x = outlier_value(df, column)
    return F.coalesce((x < bounds["lower_bound"]) | (x > bounds["upper_bound"]), F.lit(False))


def outliers_iqr_report(df: DataFrame, column: str, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Informational: it always passes. The bounds are five scalars, the count one more pass."""
    b = iqr_bounds(df, column, multiplier)
    shown = [F.lit(v).cast("double").alias(k) for k, v in b.items()]
    return df.agg(F.count_if(iqr_flag(df, column, b)).alias("outlier_count")).select(
        *shown, "outlier_count", F.lit(True).alias("passed")
    )


def zscore_stats(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    x = outlier_value(df, column)
    return tuple(df.agg(F.avg(x), F.stddev_samp(x)).first())


def zscore_flag(df: DataFrame, column: str, mean, std, threshold: float = ZSCORE_THRESHOLD) -> Column:
    """False everywhere when the column has no variance."""
    if not std:
        return F.lit(False)
    x = outlier_value(df, column)
    return F.coalesce(F.abs((x - mean) / std) > threshold, F.lit(False))


def outliers_zscore_report(df: DataFrame, column: str, threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    mean, std = zscore_stats(df, column)
    return df.agg(F.count_if(zscore_flag(df, column, mean, std, threshold)).alias("outlier_count")).select(
        F.lit(mean).cast("double").alias("mean"),
        F.lit(std).cast("double").alias("std"),
        "outlier_count",
        F.lit(True).alias("passed"),
    )
