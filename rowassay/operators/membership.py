"""Reference-key checks: every value must be held by a reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions.text import as_text, change_case, col, null_if_token, strip
from rowassay.operators import keys


def key_text(c: Column, dtype: T.DataType, spec: dict | None) -> Column:
    """Both sides of the check as the column's normalization sees them: text, if there is one."""
    if spec is None:
        return c
    text = as_text(c, dtype)
    if spec.get("trim_whitespace", True):
        text = strip(text)
    return change_case(null_if_token(text, spec.get("null_tokens") or []), spec.get("case"))


def bad_reference_keys(
    df: DataFrame,
    column: str,
    reference: DataFrame,
    reference_column: str,
    allow_nulls: bool = False,
    spec: dict | None = None,
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """Distinct failing keys with their row counts; a disallowed null is one of them.

    Without normalization the two sides must have the same kind of type: text never equals a
    number.
    """
    kind, held_kind = df.schema[column].dataType, reference.schema[reference_column].dataType
    side = df.select(key_text(col(column), kind, spec).alias("__key"))
    known = reference.select(key_text(col(reference_column), held_kind, spec).alias("__key"))
    if spec is None and isinstance(kind, T.StringType) != isinstance(held_kind, T.StringType):
        bad = keys.group_sizes(side.where("__key IS NOT NULL"), ["__key"])
    else:
        bad = keys.missing_keys(side, "__key", known, "__key", held)
    if not allow_nulls:
        nulls = side.where(F.col("__key").isNull()).groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
        bad = bad.unionByName(nulls)
    return bad


def reference_report(df, column, reference, reference_column, allow_nulls=False, spec=None) -> DataFrame:
    bad = bad_reference_keys(df, column, reference, reference_column, allow_nulls, spec)
    out = bad.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("missing_count"),
        F.count("__key").alias("missing_distinct"),
    )
    return out.withColumn("passed", F.col("missing_count") == 0)


def missing_values(df, column, reference, reference_column, allow_nulls=False, spec=None, limit=100) -> DataFrame:
    """The most frequent missing values."""
    bad = bad_reference_keys(df, column, reference, reference_column, allow_nulls, spec)
    return bad.select(F.col("__key").alias("value"), F.col("__n").alias("row_count")).orderBy(
        F.desc("row_count"), F.asc("value")
    ).limit(limit)


def failing_rows(df, column, reference, reference_column, allow_nulls=False, spec=None) -> DataFrame:
    """Rows that fail the check, whole."""
    bad = bad_reference_keys(df, column, reference, reference_column, allow_nulls, spec)
    keyed = df.withColumn("__lookup", key_text(col(column), df.schema[column].dataType, spec))
    return keys.mark(keyed, ["__lookup"], bad, "__bad", ["__key"]).where("__bad").drop("__bad", "__lookup")


def failing_examples(
    df, column, reference, reference_column, order_by: list[str], limit: int = 10, allow_nulls=False, spec=None
) -> DataFrame:
    """The first failing rows in the given order, whole."""
    rows = failing_rows(df, column, reference, reference_column, allow_nulls, spec)
    return rows.orderBy(*[col(o) for o in order_by]).limit(limit)
