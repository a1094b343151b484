"""Header and row shaping, and checks of a table's shape."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowassay.functions.text import as_text, col


def tidy_name(
    name: str,
    trim: bool = False,
    remove_punctuation: bool = False,
    spaces_to_underscores: bool = False,
    case: str | None = None,
) -> str:
    if trim:
        name = name.strip()
    if remove_punctuation:
        name = name.translate({ord(c): None for c in string.punctuation})
    if spaces_to_underscores:
        name = re.sub(r"\s+", "_", name)
    return {"lower": str.lower, "upper": str.upper, "title": str.title}.get(case, str)(name)


def tidy_header(df: DataFrame, **actions) -> DataFrame:
    """Apply name actions to every column: trim, punctuation, spaces, then case."""
    names = [tidy_name(n, **actions) for n in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"columns would share a name: {', '.join(clash)}")
    return df.toDF(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old != new})


def drop_ignored(df: DataFrame, ignored: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Drop columns given by their old or new name."""
    renames = renames or {}
    return df.drop(*{n for i in ignored for n in (i, renames.get(i, i)) if n in df.columns})


def drop_total_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which any cell holds the word total, in any case."""
    hits = [
        F.coalesce(F.lower(as_text(col(f.name), f.dataType)).contains("total"), F.lit(False))
        for f in df.schema.fields
    ]
    return df.where(~reduce(Column.__or__, hits, F.lit(False)))


def head(df: DataFrame, order_by: list[str], rows: int = 10) -> DataFrame:
    return df.orderBy(*[col(o) for o in order_by]).limit(rows)


def shape_issues(df: DataFrame) -> list[str]:
    """No rows, no columns, or repeated names. Reads at most one row."""
    issues = []
    if not df.columns:
        issues.append("no columns")
    repeats = sorted({n for n in df.columns if df.columns.count(n) > 1})
    if repeats:
        issues.append(f"duplicate column names: {', '.join(repeats)}")
    elif df.columns and df.isEmpty():
        issues.append("no rows")
    return issues


def size_report(
    df: DataFrame,
    min_rows: int | None = None,
    max_rows: int | None = None,
    max_columns: int | None = None,
) -> DataFrame:
    """Row and column counts against bounds the caller sets; there is no built-in cap."""
    width = len(df.columns)
    rows = F.col("row_count")
    too_few = F.lit(False) if min_rows is None else rows < min_rows
    too_many = F.lit(False) if max_rows is None else rows > max_rows
    too_wide = F.lit(max_columns is not None and width > max_columns)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(width).cast("bigint").alias("column_count"),
        too_few.alias("too_few_rows"),
        too_many.alias("too_many_rows"),
        too_wide.alias("too_many_columns"),
        (~too_few & ~too_many & ~too_wide).alias("passed"),
    )


def shape(df: DataFrame, settings: dict) -> DataFrame:
    """Apply import settings: name actions, renames, ignored columns."""
    quick = settings.get("quick_actions") or {}
    case = next(
        (c for c, k in (("lower", "to_lowercase"), ("upper", "to_uppercase"), ("title", "to_titlecase")) if quick.get(k)),
        None,
    )
    df = tidy_header(
        df,
        trim=bool(quick.get("trim_whitespace")),
        remove_punctuation=bool(quick.get("remove_punctuation")),
        spaces_to_underscores=bool(quick.get("replace_spaces_with_underscores")),
        case=case,
    )
    renames = settings.get("column_renames") or {}
    return rename(df, renames)


def shape_report(df: DataFrame) -> DataFrame:
    """The shape checks as one row; at most one input row is read."""
    repeats = len(df.columns) - len(set(df.columns))
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(
        "has_rows",
        F.lit(len(df.columns) > 0).alias("has_columns"),
        F.lit(repeats == 0).alias("names_differ"),
    )
