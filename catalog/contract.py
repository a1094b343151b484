"""Every kind of check, reference checks, treatments and differences on lineitem in one run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalog.base import DUCK_LINES, dirty_lines, query, table
from rowassay import clean, validate

LABEL = {"action": "label_failure", "label_column_name": "__dq_errors__"}

RULES = {
    "columns": [
        {
            "name": "l_orderkey",
            "data_type": "integer",
            "tests": [{"type": "not_null"}, {"type": "uniqueness"}, {"type": "cardinality_warning", "params": {"max": 10}}],
            "failure_handling": LABEL,
        },
        {
            "name": "l_quantity",
            "data_type": "float",
            "tests": [{"type": "range", "params": {"min": 5, "max": 45}}, {"type": "monotonic"}],
            "failure_handling": LABEL,
        },
        {
            "name": "l_returnflag",
            "normalization": {"case": "lower"},
            "tests": [
                {"type": "enum", "params": {"allowed_values": ["A", "N"]}},
                {"type": "length", "params": {"min": 1, "max": 1}},
                {"type": "pattern", "params": {"tier": "builder", "builder": {"allowed_characters": ["lowercase"]}}},
            ],
            "failure_handling": LABEL,
        },
        {
            "name": "l_shipdate",
            "data_type": "timestamp",
            "tests": [
                {"type": "date_rule", "params": {"target_format": "YYYY-MM-DD HH:mm:ss"}},
                {"type": "date_window", "params": {"min_date": "1996-01-01"}},
            ],
            "failure_handling": LABEL,
        },
        {
            "name": "price_text",
            "data_type": "float",
            "tests": [{"type": "type_conformance"}],
            "remediation": [{"type": "numeric_cleanup", "params": {"on_parse_error": "set_null"}}],
            "failure_handling": LABEL,
        },
        {
            "name": "discount_text",
            "data_type": "integer",
            "remediation": [{"type": "remove_punctuation"}, {"type": "trim_whitespace"}],
        },
    ],
    "dataset_tests": [
        {"type": "duplicate_rows", "severity": "warning", "on_fail": LABEL},
        {"type": "primary_key_completeness", "params": {"key_columns": ["l_orderkey"]}, "on_fail": LABEL},
        {"type": "primary_key_uniqueness", "params": {"key_columns": ["l_orderkey"]}, "on_fail": LABEL},
        {"type": "composite_key_uniqueness", "params": {"key_columns": ["l_orderkey", "l_quantity"]}, "on_fail": LABEL},
        {"type": "cross_field_rule", "params": {"rule_name": "price", "assert": {"expression": "l_extendedprice >= l_quantity"}}, "on_fail": LABEL},
        {"type": "outliers_iqr", "params": {"column": "l_extendedprice"}},
        {"type": "outliers_zscore", "params": {"column": "l_extendedprice"}},
    ],
    "foreign_key_checks": [
        {"name": "order", "dataset_column": "l_orderkey", "fk_column": "o_orderkey", "on_fail": LABEL}
    ],
}


def _repeats(columns: str) -> str:
    return f"(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM {DUCK_LINES} GROUP BY {columns} HAVING count(*) > 1))"


# Tells the rows of the test tables apart.
ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
_FALLS = f"l_quantity < lag(l_quantity) OVER (ORDER BY {', '.join(ORDER)})"
_ALL = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_returnflag, price_text, quantity_text, discount_text"
_COUNTS = {
    "cells changed": f"""(SELECT (count(*) + count(*) FILTER (WHERE l_linenumber <> 1 AND l_linenumber <> 2 AND l_linenumber <> 3
        AND price_text IS DISTINCT FROM CAST(TRY_CAST(price_text AS DOUBLE) AS VARCHAR)) + count(*) FILTER (WHERE l_linenumber <= 3))::BIGINT FROM {DUCK_LINES})""",
    "rows with errors": f"""(SELECT count(*) FROM (SELECT *, {_FALLS} AS falls, count(*) OVER (PARTITION BY l_orderkey) AS same FROM {DUCK_LINES})
        WHERE same > 1 OR coalesce(falls, false) OR l_quantity < 5 OR l_quantity > 45 OR l_returnflag NOT IN ('A', 'N') OR l_shipdate < TIMESTAMP '1996-01-01'
          OR l_linenumber IN (2, 3) OR NOT l_extendedprice >= l_quantity OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0))""",
    "l_quantity:monotonic": f"(SELECT count(*) FROM (SELECT {_FALLS} AS falls FROM {DUCK_LINES}) WHERE falls)",
    "l_orderkey:not_null": "0",
    "l_orderkey:uniqueness": _repeats("l_orderkey"),
    "l_orderkey:cardinality_warning": "1",
    "l_quantity:range": f"(SELECT count(*) FROM {DUCK_LINES} WHERE l_quantity < 5 OR l_quantity > 45)",
    "l_returnflag:enum": f"(SELECT count(*) FROM {DUCK_LINES} WHERE l_returnflag NOT IN ('A', 'N'))",
    "l_returnflag:length": "0",
    "l_returnflag:pattern": "0",
    "l_shipdate:date_rule": "0",
    "l_shipdate:date_window": f"(SELECT count(*) FROM {DUCK_LINES} WHERE l_shipdate < TIMESTAMP '1996-01-01')",
    "price_text:type_conformance": f"(SELECT count(*) FROM {DUCK_LINES} WHERE l_linenumber IN (2, 3))",
    ":duplicate_rows": _repeats(_ALL),
    "l_orderkey:primary_key_completeness": "0",
    "l_orderkey:primary_key_uniqueness": _repeats("l_orderkey"),
    "l_orderkey,l_quantity:composite_key_uniqueness": _repeats("l_orderkey, l_quantity"),
    "price:cross_field_rule": f"(SELECT count(*) FROM {DUCK_LINES} WHERE NOT l_extendedprice >= l_quantity)",
    "l_extendedprice:outliers_iqr": "0",
    "l_extendedprice:outliers_zscore": "0",
    "order:foreign_key": f"(SELECT count(*) FROM {DUCK_LINES} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0))",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS what, {v}::BIGINT AS n" for k, v in _COUNTS.items()))
def full_contract_lineitem(spark, sf) -> DataFrame:
    lines = dirty_lines(spark, sf)
    held = table(spark, sf, "orders").where("o_orderkey % 9 <> 0")
    report = validate(lines, RULES, held, order_by=ORDER, cache_input=True)
    summary = report.summary().select(
        F.lit("rows with errors").alias("what"), F.col("rows_with_errors").alias("n")
    )
    checks = report.test_results().select(F.concat_ws(":", "target", "test").alias("what"), F.col("failed_count").alias("n"))
    diff = clean(lines, RULES, stable_input=True).diff()
    changed = diff.select(F.lit("cells changed").alias("what"), F.col("cells_changed").alias("n"))
    return reduce(DataFrame.unionByName, [summary, checks, changed])
