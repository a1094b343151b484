"""Cleaning treatments. Value treatments are expressions; a table keeps its input values beside
the treated ones, so differences need no join."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions import dates, numbers, text as tx
from rowassay.functions.text import as_text, col, strip
from rowassay.operators import keys, order
from rowassay.plans.rules import LONG_NULL_TOKENS

# A mapping longer than this is joined as a table instead of being written into the expression.
MAPPING_LITERALS = 200

# Of integer columns after numeric_cleanup.
WIDE = "decimal(38,9)"

Treatment = Callable[[Column, T.DataType, dict, str], Column]
VALUE_TREATMENTS: dict[str, Treatment] = {}


def register(name: str):
    def add(f: Treatment) -> Treatment:
        VALUE_TREATMENTS[name] = f
        return f

    return add


def treated(name: str, c: Column, dtype: T.DataType, params: dict | None = None, declared: str = "text") -> Column:
    return VALUE_TREATMENTS[name](c, dtype, params or {}, declared)


@register("trim_whitespace")
def trim_whitespace(c, dtype, params, declared):
    return strip(as_text(c, dtype))


@register("standardize_nulls")
def standardize_nulls(c, dtype, params, declared):
    tokens = list(params.get("null_tokens", LONG_NULL_TOKENS))
    clean = strip(as_text(c, dtype))
    return F.when(~clean.isin(tokens), c) if tokens else F.when(clean.isNotNull(), c)


@register("normalize_case")
def normalize_case(c, dtype, params, declared):
    return tx.change_case(as_text(c, dtype), params.get("case", "lower"))


@register("remove_non_printable")
def remove_non_printable(c, dtype, params, declared):
    return tx.printable(as_text(c, dtype))


@register("remove_punctuation")
def remove_punctuation(c, dtype, params, declared):
    return tx.drop_punctuation(as_text(c, dtype), params.get("keep_chars", ""))


@register("numeric_cleanup")
def numeric_cleanup(c, dtype, params, declared):
    """Text of a plain number. With ``set_null`` the column becomes numeric: double, or for a
    declared integer a decimal that keeps fractions and 29 digits before the point."""
    given = as_text(c, dtype)
    clean = strip(given)
    if params.get("parentheses_as_negative", True):
        clean = F.regexp_replace(clean, r"(?s)^\((.*)\)$", r"-$1")
    if params.get("remove_currency_symbols", True):
        clean = F.translate(clean, "$£€¥", "")
    if params.get("remove_commas", True):
        clean = F.translate(clean, ",", "")
    clean = strip(clean)
    whole = F.when(~clean.contains(".") & clean.rlike(numbers.INTEGER), numbers.integer_text(clean))
    part = F.when(clean.contains("."), numbers.to_double(clean))
    if params.get("on_parse_error", "keep") == "set_null":
        if declared == "integer":
            return F.coalesce(whole, F.when(part.isNotNull(), F.translate(clean, "_", ""))).try_cast(WIDE)
        return F.coalesce(whole.try_cast("double"), part)
    return F.coalesce(whole, tx.float_text(part), given)


@register("boolean_normalization")
def boolean_normalization(c, dtype, params, declared):
    if isinstance(dtype, T.BooleanType):
        return c
    given = as_text(c, dtype)
    clean = F.lower(strip(given))
    yes = list(params.get("true_tokens", numbers.TRUE_TOKENS))
    no = list(params.get("false_tokens", numbers.FALSE_TOKENS))
    return F.when(clean.isin(yes), "true").when(clean.isin(no), "false").otherwise(given)


@register("date_coerce")
def date_coerce(c, dtype, params, declared):
    given = as_text(c, dtype)
    read = dates.parse_any(
        given, params.get("accepted_input_formats", dates.COERCE_FORMATS), bool(params.get("excel_serial_enabled"))
    )
    shown = dates.render(read, params.get("target_format", "YYYY-MM-DD"))
    return shown if params.get("on_parse_error", "keep") == "set_null" else F.coalesce(shown, given)


def _mapping(params: dict) -> dict[str, str]:
    loose = params.get("case_insensitive", True)
    pairs = {}
    for k, v in (params.get("mapping") or {}).items():
        k = str(k).strip()
        pairs[k.lower() if loose else k] = None if v is None else str(v)
    return pairs


def _looked_up(c: Column, dtype: T.DataType, params: dict) -> tuple[Column, Column]:
    """The text that stays where the mapping is silent, and the key it is looked up by."""
    given = as_text(c, dtype)
    if params.get("zip_left_pad_zeros"):
        short = strip(given).rlike(r"^\d{1,4}$")
        given = F.when(short, F.lpad(strip(given), 5, "0")).otherwise(given)
    loose = params.get("case_insensitive", True)
    return given, F.lower(strip(given)) if loose else strip(given)


@register("categorical_standardize")
def categorical_standardize(c, dtype, params, declared):
    given, key = _looked_up(c, dtype, params)
    pairs = _mapping(params)
    if not pairs:
        return given
    literal = F.create_map(*[F.lit(x).cast("string") for pair in pairs.items() for x in pair])
    return F.when(F.map_contains_key(literal, key), F.element_at(literal, key)).otherwise(given)


# --- treatments of the table -------------------------------------------------------------------


def map_by_table(df: DataFrame, column: str, params: dict) -> DataFrame:
    """``categorical_standardize`` for long mappings: one left join on the distinct key."""
    given, key = _looked_up(col(column), df.schema[column].dataType, params)
    table = df.sparkSession.createDataFrame(list(_mapping(params).items()), "__from string, __to string")
    keyed = df.withColumn("__from", key)
    joined = keys.attach(
        keyed, ["__from"], table.withColumn("__hit", F.lit(True)), ["__to", "__hit"], weight=None
    )
    out = F.when(F.col("__hit"), F.col("__to")).otherwise(given)
    return joined.withColumn(column, out).drop("__from", "__to", "__hit")


def split_parts(c: Column, params: dict) -> Column:
    """The value cut at a literal delimiter, or at a pattern with ``regex``."""
    mark = params.get("delimiter", ",")
    cut = params.get("max_splits") or -1
    pattern = mark if params.get("regex") else re.escape(mark)
    return F.split(c, pattern, cut + 1 if cut > 0 else -1)


def split_width(df: DataFrame, column: str, params: dict) -> int:
    """Parts of the widest value: one aggregation over the one column."""
    return df.agg(F.max(F.size(split_parts(col(column), params)))).first()[0] or 1


def split_column(df: DataFrame, column: str, params: dict, width: int | None = None) -> DataFrame:
    """Add one column per part. Short values are padded with nulls."""
    if width is None:
        width = split_width(df, column, params)
    names = list(params.get("new_column_names") or [])
    parts = split_parts(col(column), params)
    new = {}
    for i in range(width):
        name = names[i] if i < len(names) else f"{column}_part_{i + 1}"
        new[name] = F.get(parts, F.lit(i))
    return df.withColumns(new)


def calculation(operands: list[tuple[Column, T.DataType]], params: dict) -> Column | None:
    """Joined text, or arithmetic on numbers; division by zero gives null."""
    op = params.get("operation", "concat")
    if op == "concat":
        # concat_ws would also drop the separator of a null part
        texts = [F.coalesce(as_text(c, t), F.lit("")) for c, t in operands]
        return F.concat_ws(params.get("separator", " "), *texts)
    xs = [numbers.number(c, t) for c, t in operands]
    if op not in ("add", "subtract", "multiply", "divide"):
        return None
    out = xs[0]
    for x in xs[1:]:
        out = {
            "add": lambda: out + x,
            "subtract": lambda: out - x,
            "multiply": lambda: out * x,
            "divide": lambda: F.try_divide(out, x),
        }[op]()
    return out


def deduplicate(
    df: DataFrame,
    subset: list[str] | None = None,
    keep: str | bool = "first",
    order_by: list[str] | None = None,
    hash_first: bool | None = None,
    stable_input: bool = False,
) -> DataFrame:
    """Remove repeated rows; ``keep`` is "first", "last" or False for none.

    Whole-row copies are all alike, so without an order any one stays. Otherwise only keys that
    repeat are looked up, each with the position to keep: unique rows pass through and no group
    is sorted in one task. Long texts of the key go by their digests, so none is shuffled to be
    compared. Without ``order_by`` rows are numbered in scan order; unless
    ``stable_input`` promises the same order on every read, the numbered rows are checkpointed.
    """
    if keep not in ("first", "last", False):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    if keep is False:
        df, names, stood = keys.short(df, subset or df.columns)
        bad = keys.repeated(df, names, hash_first)
        return keys.mark(df, names, bad, "__dup").where("NOT __dup").drop("__dup", *stood)
    if subset is None and order_by is None:
        return df.dropDuplicates()
    subset = subset or df.columns
    numbered = order_by is None
    if numbered:
        df = order.with_row_id(df, settle=not stable_input)
        order_by = [order.ROW_ID]
    at = F.struct(*[col(o) for o in order_by])
    df, subset, stood = keys.short(df, subset)
    rows = df.select(*[col(c) for c in dict.fromkeys([*subset, *order_by])])
    group = rows
    if hash_first is not False:
        bad = keys.measure([keys.repeated(df, subset, hash_first)])[0]
        if bad.small:
            # positions are gathered only for keys known to repeat
            group = keys.mark(rows, subset, bad, "__dup").where("__dup")
    pick = F.min if keep == "first" else F.max
    names = [col(s) for s in subset]
    # copies are counted by position first, so the kept position comes with the rows that share it
    spots = group.groupBy(*names, at.alias("__at")).agg(F.count(F.lit(1)).alias("__c"))
    kept = spots.groupBy(*names).agg(F.sum("__c").alias("__n"), pick(F.struct("__at", "__c")).alias("__k")).where("__n > 1")
    seen = keys.measure([kept.select(*names, "__n", F.col("__k.__at").alias("__keep"), F.col("__k.__c").alias("__same"))])[0]
    found = keys.attach(df, subset, seen, ["__keep", "__same"])
    chosen = F.col("__keep") == at
    out = found.where(F.col("__keep").isNull() | chosen)
    if seen.table.where("__same > 1").limit(1).count():
        # copies share a position: those rows are thinned out among themselves
        tied = out.where("__same > 1").dropDuplicates(list(dict.fromkeys([*subset, *order_by])))
        out = out.where("__keep IS NULL OR __same = 1").unionByName(tied)
    out = out.drop("__keep", "__same", *stood)
    return out.drop(order.ROW_ID) if numbered else out
