"""Whole rule sets, row results, actions, treatments and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DUCK_CUSTOMER, DUCK_DOUBLED, DUCK_LINES, DUCK_ORDERS, dirty_customer, dirty_lines, dirty_orders,
    doubled_orders, query, rounded, table,
)
from rowassay import clean, preview, validate
from rowassay.operators import treatments as tr
from rowassay.plans import cleaning

LABEL = {"action": "label_failure", "label_column_name": "__dq_errors__"}

ORDER_RULES = {
    "columns": [
        {
            "name": "o_orderkey",
            "data_type": "integer",
            "tests": [{"type": "uniqueness"}, {"type": "not_null"}],
            "failure_handling": LABEL,
        },
        {
            "name": "custkey",
            "data_type": "integer",
            "tests": [
                {"type": "not_null"},
                {"type": "range", "severity": "warning", "params": {"min": 10}},
            ],
            "failure_handling": LABEL,
        },
        {
            "name": "priority",
            "data_type": "text",
            "normalization": {"null_tokens": [""], "case": "lower"},
            "tests": [
                {"type": "not_null"},
                {"type": "enum", "params": {"allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}},
                {"type": "pattern", "params": {"tier": "advanced", "pattern": r"\d-[a-z]+$"}},
            ],
            "failure_handling": LABEL,
        },
        {
            "name": "day_text",
            "data_type": "date",
            "tests": [{"type": "date_rule", "params": {"target_format": "YYYY-MM-DD"}}],
            "failure_handling": {"action": "strict_fail"},
        },
        {"name": "o_totalprice", "data_type": "float", "tests": [{"type": "range", "params": {"max": 400000}}], "failure_handling": LABEL},
    ],
    "dataset_tests": [
        {
            "type": "cross_field_rule",
            "params": {"rule_name": "key order", "assert": {"expression": "o_custkey <= o_orderkey"}},
            "on_fail": LABEL,
        },
        {"type": "primary_key_uniqueness", "params": {"key_columns": ["o_orderkey"]}, "on_fail": LABEL},
    ],
    "foreign_key_checks": [
        {"name": "customer", "dataset_column": "custkey", "fk_column": "c_custkey", "on_fail": LABEL}
    ],
}

# The same rules as conditions, in check order.
_CONDITIONS = [
    ("column", "o_orderkey", "uniqueness", "error", "false"),
    ("column", "o_orderkey", "not_null", "error", "o_orderkey IS NULL"),
    ("column", "custkey", "not_null", "error", "custkey IS NULL"),
    ("column", "custkey", "range", "warning", "coalesce(custkey < 10, false)"),
    ("column", "priority", "not_null", "error", "priority IS NULL"),
    ("column", "priority", "enum", "error", "coalesce(priority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM'), false)"),
    ("column", "priority", "pattern", "error", "coalesce(priority = '4-NOT SPECIFIED', false)"),
    ("column", "day_text", "date_rule", "error", "o_orderkey % 3 <> 0"),
    ("column", "o_totalprice", "range", "error", "o_totalprice > 400000"),
    ("dataset", "key order", "cross_field_rule", "error", "NOT o_custkey <= o_orderkey"),
    ("dataset", "o_orderkey", "primary_key_uniqueness", "error", "false"),
    ("reference", "customer", "foreign_key", "error",
     "(custkey IS NULL OR custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0))"),
]
_FLAGS = ", ".join(f"{c[4]} AS f{i}" for i, c in enumerate(_CONDITIONS))
_FLAGGED = f"(SELECT *, {_FLAGS} FROM {DUCK_ORDERS})"
_ALL = range(len(_CONDITIONS))
_ERRORS = " OR ".join(f"f{i}" for i in _ALL if _CONDITIONS[i][3] == "error")
_ANY = " OR ".join(f"f{i}" for i in _ALL)
_LABEL_OF = {
    "not_null": "value is null", "uniqueness": "duplicate value", "range": "out of range",
    "enum": "not in allowed values", "pattern": "does not match pattern", "date_rule": "wrong date format",
    "cross_field_rule": "cross field rule", "primary_key_uniqueness": "primary key uniqueness",
    "foreign_key": "foreign key",
}


def order_report(spark, sf, **options):
    held = table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    return validate(dirty_orders(spark, sf), ORDER_RULES, held, row_key=["o_orderkey"], **options)


@query(" UNION ALL ".join(
    f"""SELECT '{s}' AS scope, '{t}' AS target, '{k}' AS test, '{v}' AS severity,
        count(*) FILTER (WHERE f{i}) = 0 AS passed, count(*) FILTER (WHERE f{i}) AS failed_count FROM {_FLAGGED}"""
    for i, (s, t, k, v, _) in enumerate(_CONDITIONS)))
def validate_orders(spark, sf):
    return order_report(spark, sf).test_results().select(
        "scope", "target", "test", "severity", "passed", "failed_count"
    )


_CELLS = [i for i in _ALL if _CONDITIONS[i][0] == "column"]


def _sum(ids):
    return " + ".join(f"count(*) FILTER (WHERE f{i})" for i in ids) or "0"


@query(f"""SELECT column_name, count(*) AS total_tests, count(*) FILTER (WHERE n > 0 AND severity = 'error') AS error_count,
   count(*) FILTER (WHERE n > 0 AND severity = 'warning') AS warning_count,
   CASE WHEN bool_or(n > 0 AND severity = 'error') THEN 'FAIL' WHEN bool_or(n > 0) THEN 'WARNING' ELSE 'PASS' END AS status
   FROM ({" UNION ALL ".join(f"SELECT '{_CONDITIONS[i][1]}' AS column_name, '{_CONDITIONS[i][3]}' AS severity, count(*) FILTER (WHERE f{i}) AS n FROM {_FLAGGED}" for i in _CELLS)})
   GROUP BY column_name""")
def column_results_orders(spark, sf):
    return order_report(spark, sf).column_results().select(
        "column_name", "total_tests", "error_count", "warning_count", "status"
    )


_TESTS_FAILED = " + ".join(f"CASE WHEN count(*) FILTER (WHERE f{i}) > 0 THEN 1 ELSE 0 END" for i in _ALL)
_SET_FAILED = " + ".join(f"CASE WHEN count(*) FILTER (WHERE f{i}) > 0 THEN 1 ELSE 0 END" for i in _ALL if i not in _CELLS)


@query(f"""SELECT count(*) AS total_rows, 8::BIGINT AS total_columns, {len(_CONDITIONS)}::BIGINT AS tests_run,
   ({_TESTS_FAILED})::BIGINT AS tests_failed,
   (count(*) FILTER (WHERE f3) + 1)::BIGINT AS warnings,
   ({_sum([i for i in _CELLS if i != 3])} + {_SET_FAILED})::BIGINT AS errors,
   count(*) FILTER (WHERE {_ERRORS}) AS rows_with_errors, count(*) FILTER (WHERE NOT ({_ERRORS})) AS clean_rows,
   round(count(*) FILTER (WHERE {_ERRORS}) * 100.0 / count(*), 2) AS error_rate_percent, false AS is_valid
   FROM {_FLAGGED}""")
def summary_orders(spark, sf):
    return order_report(spark, sf).summary().select(
        "total_rows", "total_columns", "tests_run", "tests_failed", "warnings", "errors", "rows_with_errors",
        "clean_rows", "error_rate_percent", "is_valid",
    )


@query("SELECT 'column' AS scope, 'day_text' AS target, 'date_rule' AS test UNION ALL SELECT 'table', 'gone', 'missing column'")
def blocking_errors_orders(spark, sf):
    rules = dict(ORDER_RULES, columns=[*ORDER_RULES["columns"], {"name": "gone", "tests": [{"type": "not_null"}]}])
    held = table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    return validate(dirty_orders(spark, sf), rules, held, row_key=["o_orderkey"]).blocking_errors()


def _duck_label():
    groups = {}
    for i, (scope, target, test, _, _) in enumerate(_CONDITIONS):
        groups.setdefault("custkey" if scope == "reference" else target, []).append((i, _LABEL_OF[test]))
    # a set check on o_orderkey has its own entry under the key's name
    parts = []
    for name, tests in groups.items():
        texts = ", ".join(f"CASE WHEN f{i} THEN '{label}' END" for i, label in tests)
        some = " OR ".join(f"f{i}" for i, _ in tests)
        parts.append(f"CASE WHEN {some} THEN '[{name}: ' || concat_ws(', ', {texts}) || ']' ELSE '' END")
    return " || ".join(parts)


@query(f"""SELECT o_orderkey, {_duck_label()} AS label, ({" + ".join(f"f{i}::INT" for i in _ALL)})::BIGINT AS failures,
   CASE WHEN {_ANY} THEN 'FAIL' ELSE 'PASS' END AS status FROM {_FLAGGED}""")
def labels_orders(spark, sf):
    out = order_report(spark, sf).labeled(names=("label", "failures", "status"))
    return out.select("o_orderkey", "label", F.col("failures").cast("bigint").alias("failures"), "status")


_PIPE = ", ".join(f"CASE WHEN f{i} THEN '{_CONDITIONS[i][2]}' END" for i in _CELLS)


@query(f"SELECT label, count(*) AS n FROM (SELECT concat_ws('|', {_PIPE}) AS label FROM {_FLAGGED}) GROUP BY label")
def labels_orders_pipe_columns_only(spark, sf):
    out = order_report(spark, sf, row_effects="column_only").labeled("pipe", ("label", "failures", "status"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_CELL_ROWS = " UNION ALL ".join(
    f"SELECT o_orderkey, '{_CONDITIONS[i][1]}' AS column_name, '{_CONDITIONS[i][2]}' AS test, '{_CONDITIONS[i][3]}' AS severity, "
    + ("lower(trim(priority))" if _CONDITIONS[i][1] == "priority" else "NULL") + f" AS text FROM {_FLAGGED} WHERE f{i}"
    for i in _CELLS)


@query(f"SELECT o_orderkey, column_name, test, severity FROM ({_CELL_ROWS})")
def cell_errors_orders(spark, sf):
    out = order_report(spark, sf).cell_errors().where("scope = 'column'")
    return out.select("o_orderkey", "column_name", "test", "severity")


@query(f"SELECT column_name, test, count(*) AS cells FROM ({_CELL_ROWS}) GROUP BY ALL")
def error_counts_orders(spark, sf):
    return order_report(spark, sf).error_counts()


@query(" UNION ALL ".join(f"SELECT '{name}' AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM {_FLAGGED} WHERE {cond}" for name, cond in
   (("fail", f"({_ERRORS})"), ("warning", f"f3 AND NOT ({_ERRORS})"), ("pass", f"NOT ({_ANY})"))))
def rows_by_status_orders(spark, sf):
    report = order_report(spark, sf)
    parts = [
        report.rows(s).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(s).alias("status"), "n", "keys")
        for s in ("fail", "warning", "pass")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT o_orderkey FROM {_FLAGGED} WHERE {_ERRORS}")
def failed_row_keys_orders(spark, sf):
    return order_report(spark, sf).failed_row_keys()


@query(f"""SELECT o_orderkey, column_name, test, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name, test ORDER BY o_orderkey) AS rank
   FROM ({_CELL_ROWS})) WHERE rank <= 5""")
def examples_orders(spark, sf):
    out = order_report(spark, sf, row_effects="column_only").examples(5)
    return out.select("o_orderkey", "column_name", "test", F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT column_name, test, text AS value, count(*) AS cells FROM ({_CELL_ROWS}) WHERE column_name = 'priority' GROUP BY ALL""")
def top_invalid_orders(spark, sf):
    out = order_report(spark, sf).top_invalid(10).where("column_name = 'priority'")
    return out.select("column_name", "test", "value", "cells")


# --- actions -----------------------------------------------------------------------------------

ACTION_RULES = {
    "columns": [
        {
            "name": "custkey",
            "data_type": "integer",
            "tests": [{"type": "range", "params": {"max": 1200}}],
            "failure_handling": {"action": "set_null"},
        },
        {
            "name": "priority",
            "tests": [
                {"type": "not_null", "on_fail": {"action": "drop_row"}},
                {"type": "enum", "params": {"allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}},
            ],
            "failure_handling": {"action": "quarantine_row", "quarantine_export_name": "low"},
        },
        {
            "name": "day_text",
            "data_type": "date",
            "rename_to": "order_day",
            "tests": [{"type": "date_rule", "params": {"target_format": "YYYY-MM-DD", "mode": "robust", "accepted_input_formats": ["YYYY-MM-DD", "MM/DD/YYYY"]}}],
            "failure_handling": LABEL,
        },
    ],
    "foreign_key_checks": [
        {
            "name": "customer",
            "dataset_column": "custkey",
            "fk_column": "c_custkey",
            "null_policy": {"allow_nulls": True},
            "on_fail": {"action": "quarantine_row", "quarantine_export_name": "orphans"},
        }
    ],
}
_LOW = "coalesce(priority = '5-LOW', false)"
_ORPHAN = "coalesce(custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0), false)"


def action_outputs(spark, sf):
    held = table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    return validate(dirty_orders(spark, sf), ACTION_RULES, held, row_key=["o_orderkey"]).split()


@query(f"""SELECT o_orderkey, CASE WHEN custkey <= 1200 THEN custkey END AS custkey, priority, day_text AS order_day FROM {DUCK_ORDERS}
   WHERE priority IS NOT NULL AND NOT {_LOW} AND NOT {_ORPHAN}""")
def clean_rows_orders(spark, sf):
    return action_outputs(spark, sf).clean.select("o_orderkey", "custkey", "priority", "order_day")


@query(f"SELECT o_orderkey, custkey, priority FROM {DUCK_ORDERS} WHERE {_LOW} OR {_ORPHAN}")
def quarantined_rows_orders(spark, sf):
    return action_outputs(spark, sf).quarantine.select("o_orderkey", "custkey", "priority")


@query(f"""SELECT 'low' AS name, count(*) AS n FROM {DUCK_ORDERS} WHERE {_LOW}
   UNION ALL SELECT 'orphans', count(*) FROM {DUCK_ORDERS} WHERE {_ORPHAN}""")
def named_quarantines_orders(spark, sf):
    named = action_outputs(spark, sf).named
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, d in named.items()]
    return parts[0].unionByName(parts[1])


# --- treatments --------------------------------------------------------------------------------


def treat(df, column, kind, params=None, declared="text"):
    rules = {"columns": [{"name": column, "data_type": declared, "remediation": [{"type": kind, "params": params or {}}]}]}
    return clean(df, rules, order_by=[df.columns[0]]).rows


def counted(df, column):
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT trim(segment) AS segment, count(*) AS n FROM {DUCK_CUSTOMER} GROUP BY 1")
def trim_whitespace_segment(spark, sf):
    return counted(treat(dirty_customer(spark, sf), "segment", "trim_whitespace"), "segment")


@query(f"SELECT CASE WHEN trim(segment) = 'N/A' THEN NULL ELSE segment END AS segment, count(*) AS n FROM {DUCK_CUSTOMER} GROUP BY 1")
def standardize_nulls_segment(spark, sf):
    return counted(treat(dirty_customer(spark, sf), "segment", "standardize_nulls"), "segment")


@query(f"SELECT lower(segment) AS segment, count(*) AS n FROM {DUCK_CUSTOMER} GROUP BY 1")
def normalize_case_segment(spark, sf):
    return counted(treat(dirty_customer(spark, sf), "segment", "normalize_case"), "segment")


@query(r"""SELECT lang, sum(length(regexp_replace(text, '[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g'))
   + length(regexp_replace(text, '[^\t\n\r]', '', 'g')))::BIGINT AS kept FROM documents GROUP BY lang""")
def remove_non_printable_documents(spark, sf):
    out = treat(table(spark, sf, "documents"), "text", "remove_non_printable")
    return out.groupBy("lang").agg(F.sum(F.length("text")).alias("kept"))


@query("SELECT c_custkey, replace(c_name, '#', '') AS c_name FROM customer")
def remove_punctuation_customer(spark, sf):
    return treat(table(spark, sf, "customer"), "c_name", "remove_punctuation").select("c_custkey", "c_name")


@query(f"SELECT replace(email, '@', '') AS email, count(*) AS n FROM {DUCK_CUSTOMER} GROUP BY 1")
def remove_punctuation_keep_dots(spark, sf):
    out = treat(dirty_customer(spark, sf), "email", "remove_punctuation", {"keep_chars": "."})
    return counted(out, "email")


@query(f"""SELECT count(*) AS n, count(price_text) AS kept, round(sum(price_text), 2) AS total, count(*) FILTER (WHERE price_text < 0) AS negative
   FROM (SELECT TRY_CAST(replace(CASE WHEN price_text LIKE '(%)' THEN '-' || price_text[2:-2] ELSE price_text END, '$', '') AS DOUBLE) AS price_text FROM {DUCK_LINES})""")
def numeric_cleanup_lineitem_price(spark, sf):
    out = treat(dirty_lines(spark, sf), "price_text", "numeric_cleanup", {"on_parse_error": "set_null"}, "float")
    return out.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("price_text").alias("kept"),
        F.round(F.sum("price_text"), 2).alias("total"),
        F.count_if(F.col("price_text") < 0).alias("negative"),
    )


@query(f"""SELECT replace(quantity_text, ',', '') AS quantity_text, count(*) AS n FROM {DUCK_LINES} GROUP BY 1""")
def numeric_cleanup_lineitem_quantity_kept(spark, sf):
    return counted(treat(dirty_lines(spark, sf), "quantity_text", "numeric_cleanup"), "quantity_text")


@query(f"""SELECT CASE lower(trim(flag_text)) WHEN 'y' THEN 'true' WHEN 'true' THEN 'true' WHEN 'no' THEN 'false' ELSE flag_text END AS flag_text,
   count(*) AS n FROM {DUCK_ORDERS} GROUP BY 1""")
def boolean_normalization_orders(spark, sf):
    return counted(treat(dirty_orders(spark, sf), "flag_text", "boolean_normalization"), "flag_text")


@query(f"""SELECT CASE WHEN day_text = 'not-a-date' THEN day_text ELSE strftime(o_orderdate, '%d-%b-%Y') END AS day_text, count(*) AS n
   FROM {DUCK_ORDERS} GROUP BY 1""")
def date_coerce_orders(spark, sf):
    return counted(treat(dirty_orders(spark, sf), "day_text", "date_coerce", {"target_format": "DD-MMM-YYYY"}), "day_text")


@query(f"SELECT CASE WHEN day_text = 'not-a-date' THEN NULL ELSE strftime(o_orderdate, '%m/%d/%y') END AS day_text, count(*) AS n FROM {DUCK_ORDERS} GROUP BY 1")
def date_coerce_orders_set_null(spark, sf):
    params = {"target_format": "MM/DD/YY", "on_parse_error": "set_null"}
    return counted(treat(dirty_orders(spark, sf), "day_text", "date_coerce", params), "day_text")


_MAP = {"1-urgent": "URGENT", " 5-Low ": "LOW", "4-NOT SPECIFIED": "NONE"}


@query(f"""SELECT CASE priority WHEN '1-URGENT' THEN 'URGENT' WHEN '5-LOW' THEN 'LOW' WHEN '4-NOT SPECIFIED' THEN 'NONE' ELSE priority END AS priority,
   count(*) AS n FROM {DUCK_ORDERS} GROUP BY 1""")
def categorical_standardize_orders(spark, sf):
    return counted(treat(dirty_orders(spark, sf), "priority", "categorical_standardize", {"mapping": _MAP}), "priority")


@query(f"""SELECT CASE priority WHEN '1-URGENT' THEN 'URGENT' WHEN '5-LOW' THEN 'LOW' WHEN '4-NOT SPECIFIED' THEN 'NONE' ELSE priority END AS priority,
   count(*) AS n FROM {DUCK_ORDERS} GROUP BY 1""")
def categorical_standardize_by_join(spark, sf):
    long = {**_MAP, **{f"unused {i}": str(i) for i in range(tr.MAPPING_LITERALS)}}
    return counted(treat(dirty_orders(spark, sf), "priority", "categorical_standardize", {"mapping": long}), "priority")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS shade, string_split(p_name, ' ')[2] AS p_name_part_2 FROM part")
def split_column_part_name(spark, sf):
    out = treat(table(spark, sf, "part"), "p_name", "split_column", {"delimiter": " ", "new_column_names": ["shade"]})
    return out.select("p_partkey", "shade", "p_name_part_2")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS l_tax, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def custom_calculation_multiply(spark, sf):
    params = {"operation": "multiply", "operand_columns": ["l_extendedprice", "l_discount"]}
    out = rounded(treat(table(spark, sf, "lineitem"), "l_tax", "custom_calculation", params), "l_tax")
    return out.groupBy("l_orderkey", "l_linenumber", "l_tax").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(ratio) AS filled, round(sum(ratio) / 1e6, 2) AS total FROM (SELECT l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem)")
def custom_calculation_divide(spark, sf):
    params = {"operation": "divide", "operand_columns": ["l_extendedprice", "l_discount"]}
    out = treat(table(spark, sf, "lineitem"), "l_tax", "custom_calculation", params)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("filled"), F.round(F.sum("l_tax") / 1e6, 2).alias("total"))


@query("SELECT s_suppkey, s_name || '/' || CAST(s_nationkey AS VARCHAR) AS s_name FROM supplier")
def custom_calculation_concat(spark, sf):
    params = {"operation": "concat", "operand_columns": ["s_name", "s_nationkey"], "separator": "/"}
    return treat(table(spark, sf, "supplier"), "s_name", "custom_calculation", params).select("s_suppkey", "s_name")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def deduplicate_documents_first(spark, sf):
    return tr.deduplicate(table(spark, sf, "documents"), ["text"], "first", ["doc_id"], hash_first=True).select("doc_id")


@query("SELECT max(doc_id) AS doc_id FROM documents GROUP BY text")
def deduplicate_documents_last(spark, sf):
    return tr.deduplicate(table(spark, sf, "documents"), ["text"], "last", ["doc_id"]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1")
def deduplicate_documents_none(spark, sf):
    return tr.deduplicate(table(spark, sf, "documents"), ["text"], False, ["doc_id"]).select("doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def deduplicate_doubled_orders(spark, sf):
    return tr.deduplicate(doubled_orders(spark, sf)).select("o_orderkey", "o_orderstatus")


@query(f"SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip, count(*) AS n FROM customer GROUP BY 1")
def zip_left_pad(spark, sf):
    zips = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("zip"))
    return counted(treat(zips, "zip", "categorical_standardize", {"zip_left_pad_zeros": True}), "zip")


CLEAN_RULES = {
    "columns": [
        {
            "name": "segment",
            "remediation": [
                {"type": "trim_whitespace"},
                {"type": "standardize_nulls"},
                {"type": "normalize_case", "params": {"case": "upper"}},
            ],
        },
        {"name": "email", "remediation": [{"type": "remove_punctuation", "params": {"keep_chars": "@."}}]},
        {"name": "c_name", "remediation": [{"type": "custom_calculation", "params": {"operand_columns": ["segment", "c_custkey"], "separator": ":"}}]},
    ]
}
_SEG = "CASE WHEN trim(segment) = 'N/A' THEN NULL ELSE upper(trim(segment)) END"
_NAME = f"coalesce({_SEG}, '') || ':' || CAST(c_custkey AS VARCHAR)"


@query(f"SELECT c_custkey, {_SEG} AS segment, {_NAME} AS c_name, email FROM {DUCK_CUSTOMER}")
def clean_customer(spark, sf):
    out = clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"]).rows
    return out.select("c_custkey", "segment", "c_name", "email")


_SEG_CHANGED = f"segment IS DISTINCT FROM {_SEG}"


@query(f"""SELECT count(*) AS total_rows, 6::BIGINT AS total_columns, count(*) AS rows_changed, 0::BIGINT AS rows_unchanged, 0::BIGINT AS rows_removed,
   (count(*) + count(*) FILTER (WHERE {_SEG_CHANGED}))::BIGINT AS cells_changed, 2::BIGINT AS columns_affected, 4::BIGINT AS columns_unaffected,
   100.0::DOUBLE AS row_change_rate_percent, round((count(*) + count(*) FILTER (WHERE {_SEG_CHANGED})) * 100.0 / (count(*) * 6), 2) AS cell_change_rate_percent
   FROM {DUCK_CUSTOMER}""")
def diff_customer(spark, sf):
    return clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"]).diff()


@query(f"""SELECT 'segment' AS column_name, count(*) AS total_values, count(*) FILTER (WHERE {_SEG_CHANGED}) AS changed_count,
   round(count(*) FILTER (WHERE {_SEG_CHANGED}) * 100.0 / count(*), 2) AS change_rate_percent FROM {DUCK_CUSTOMER}
   UNION ALL SELECT 'c_name', count(*), count(*), 100.0 FROM {DUCK_CUSTOMER}""")
def column_diffs_customer(spark, sf):
    out = clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"]).column_diffs()
    return out.drop("treatments")


_CHANGES = f"""SELECT c_custkey, 'segment' AS column_name, segment AS before, {_SEG} AS after FROM {DUCK_CUSTOMER} WHERE {_SEG_CHANGED}
  UNION ALL SELECT c_custkey, 'c_name', c_name, {_NAME} FROM {DUCK_CUSTOMER}"""


@query(_CHANGES)
def changes_customer(spark, sf):
    return clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"]).changes()


@query(f"""SELECT c_custkey, column_name, before, after FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY c_custkey) AS r
   FROM ({_CHANGES})) WHERE r <= 20""")
def sample_changes_customer(spark, sf):
    return clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"]).sample_changes(20).drop("rank")


@query(f"""SELECT c_custkey, CASE WHEN {_SEG_CHANGED} THEN segment END AS "segment (before)",
   CASE WHEN {_SEG_CHANGED} THEN coalesce({_SEG}, '(null)') END AS "segment (after)" FROM {DUCK_CUSTOMER} ORDER BY c_custkey LIMIT 100""")
def changed_rows_customer(spark, sf):
    out = clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"]).changed_rows(100)
    return out.select("c_custkey", "segment (before)", "segment (after)")


@query(f"SELECT c_custkey, (1 + CASE WHEN {_SEG_CHANGED} THEN 1 ELSE 0 END)::BIGINT AS changes FROM {DUCK_CUSTOMER}")
def row_change_counts_customer(spark, sf):
    out = clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"]).row_change_counts()
    return out.withColumn("changes", F.col("changes").cast("bigint"))


@query("""SELECT (15000 * 0 + total + doubled)::BIGINT AS total_rows, doubled AS rows_removed, low AS rows_changed FROM (
   SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS doubled, count(*) FILTER (WHERE o_orderpriority <> lower(o_orderpriority)) AS low FROM orders)""".replace("15000 * 0 + ", ""))
def diff_after_deduplication(spark, sf):
    rules = {"columns": [{"name": "o_orderpriority", "remediation": [{"type": "normalize_case"}, {"type": "deduplicate_rows"}]}]}
    return clean(doubled_orders(spark, sf), rules).diff().select("total_rows", "rows_removed", "rows_changed")


@query(f"""SELECT 100::BIGINT AS sample_size, (count(*) + count(*) FILTER (WHERE {_SEG_CHANGED}))::BIGINT AS sample_changes,
   100::BIGINT AS sample_rows_changed, (floor((count(*) + count(*) FILTER (WHERE {_SEG_CHANGED})) * (SELECT count(*) FROM customer) / 100))::BIGINT AS estimated_total_changes,
   2::BIGINT AS columns_affected FROM (SELECT * FROM {DUCK_CUSTOMER} ORDER BY c_custkey LIMIT 100)""")
def preview_customer(spark, sf):
    return preview(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"], 100)


@query("""SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, lower(o_orderpriority) AS o_orderpriority, strftime(o_orderdate, '%Y/%m/%d') AS o_orderdate FROM orders""")
def bulk_treatments_orders(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    types = {"o_orderkey": "integer", "o_orderstatus": "text", "o_orderpriority": "text", "o_orderdate": "date"}
    rules = {"columns": [{"name": n, "data_type": t} for n, t in types.items()]}
    rules = cleaning.add_to_columns(rules, "normalize_case", {"case": "lower"}, "non_numeric")
    rules = cleaning.add_to_columns(rules, "numeric_cleanup", {"on_parse_error": "set_null"}, "numeric")
    rules = cleaning.add_date_format(rules, "YYYY/MM/DD")
    return clean(orders, rules, ["o_orderkey"]).rows.select(*types)
