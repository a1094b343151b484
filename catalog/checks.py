"""Column, dataset and reference checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DUCK_CUSTOMER, DUCK_DOUBLED, DUCK_LINES, DUCK_ORDERS, dirty_customer, dirty_lines, dirty_orders,
    doubled_orders, query, rounded, table,
)
from rowassay import validate
from rowassay.operators import column_checks, dataset_checks as dc, membership, order
from rowassay.operators.normalize import normalize

RESULT = ["target", "test", "passed", "failed_count", "total_values"]


def tested(df, column, test, params=None, declared="text", normalization=None, **options):
    rules = {
        "columns": [
            {
                "name": column,
                "data_type": declared,
                "normalization": normalization,
                "tests": [{"type": test, "params": params or {}}],
            }
        ]
    }
    return validate(df, rules, check_rules=False, **options).test_results().select(*RESULT)


def outcome(target, test, fails, source):
    """Oracle for ``tested``: ``fails`` is a condition, or an expression holding count()."""
    count = fails if "count(" in fails else f"count(*) FILTER (WHERE {fails})"
    return f"""SELECT '{target}' AS target, '{test}' AS test, n = 0 AS passed, n AS failed_count, total AS total_values
      FROM (SELECT {count} AS n, count(*) AS total FROM {source} s)"""


# --- normalization -----------------------------------------------------------------------------


@query(f"""SELECT segment, count(*) AS n FROM (
  SELECT CASE WHEN trim(segment) IN ('', 'N/A') THEN NULL ELSE upper(trim(segment)) END AS segment
  FROM {DUCK_CUSTOMER}) GROUP BY segment""")
def normalize_customer_segment(spark, sf):
    spec = {"trim_whitespace": True, "null_tokens": ["", "N/A"], "case": "upper"}
    return normalize(dirty_customer(spark, sf), {"segment": spec}).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_name, count(*) AS n FROM part GROUP BY 1""")
def normalize_part_title_case(spark, sf):
    spec = {"trim_whitespace": True, "remove_non_printable": True, "null_tokens": [], "case": "title"}
    return normalize(table(spark, sf, "part"), {"p_name": spec}).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT lang, sum(length(regexp_replace(text, '[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g'))
   + length(regexp_replace(text, '[^\t\n\r]', '', 'g')))::BIGINT AS kept FROM documents GROUP BY lang""")
def normalize_document_printable(spark, sf):
    spec = {"trim_whitespace": False, "remove_non_printable": True, "null_tokens": [], "case": "none"}
    out = normalize(table(spark, sf, "documents"), {"text": spec})
    return out.groupBy("lang").agg(F.sum(F.length("text")).alias("kept"))


# --- column checks -----------------------------------------------------------------------------


@query(outcome("priority", "not_null", "priority IS NULL", DUCK_ORDERS))
def not_null_orders_priority(spark, sf):
    return tested(dirty_orders(spark, sf), "priority", "not_null")


@query(outcome("quantity_text", "type_conformance",
               r"NOT regexp_matches(replace(quantity_text, ',', ''), '^[+-]?\d+$')", DUCK_LINES))
def type_integer_lineitem_quantity(spark, sf):
    return tested(dirty_lines(spark, sf), "quantity_text", "type_conformance", declared="integer")


@query(outcome("price_text", "type_conformance",
               "TRY_CAST(replace(replace(price_text, ',', ''), '$', '') AS DOUBLE) IS NULL", DUCK_LINES))
def type_float_lineitem_price(spark, sf):
    return tested(dirty_lines(spark, sf), "price_text", "type_conformance", declared="float")


@query(outcome("flag_text", "type_conformance",
               "lower(trim(flag_text)) NOT IN ('true','yes','1','t','y','on','false','no','0','f','n','off')", DUCK_ORDERS))
def type_boolean_orders_flag(spark, sf):
    return tested(dirty_orders(spark, sf), "flag_text", "type_conformance", declared="boolean")


@query(outcome("day_text", "type_conformance", "day_text = 'not-a-date'", DUCK_ORDERS))
def type_date_orders_day(spark, sf):
    return tested(dirty_orders(spark, sf), "day_text", "type_conformance", declared="date")


@query(outcome("l_quantity", "range", "l_quantity < 5 OR l_quantity > 45", "lineitem"))
def range_lineitem_quantity(spark, sf):
    return tested(table(spark, sf, "lineitem"), "l_quantity", "range", {"min": 5, "max": 45}, "float")


@query(outcome("price_text", "range",
               "TRY_CAST(replace(price_text, '$', '') AS DOUBLE) NOT BETWEEN 1000 AND 60000", DUCK_LINES))
def range_lineitem_price_text(spark, sf):
    return tested(dirty_lines(spark, sf), "price_text", "range", {"min": 1000, "max": 60000}, "float")


@query(outcome("p_name", "length", "length(p_name) < 9 OR length(p_name) > 11", "part"))
def length_part_name(spark, sf):
    return tested(table(spark, sf, "part"), "p_name", "length", {"min": 9, "max": 11})


@query(outcome("text", "length", "length(text) < 50 OR length(text) > 5000", "documents"))
def length_document_text(spark, sf):
    return tested(table(spark, sf, "documents"), "text", "length", {"min": 50, "max": 5000})


@query(outcome("priority", "enum", "upper(trim(priority)) NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", DUCK_ORDERS))
def enum_orders_priority(spark, sf):
    allowed = ["1-urgent", " 2-High", "3-MEDIUM"]
    return tested(dirty_orders(spark, sf), "priority", "enum", {"allowed_values": allowed})


@query(outcome("segment", "enum", "trim(segment) NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')", DUCK_CUSTOMER))
def enum_customer_segment_exact_case(spark, sf):
    params = {"allowed_values": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "case_insensitive": False}
    return tested(dirty_customer(spark, sf), "segment", "enum", params)


@query(f"""SELECT count(*) FILTER (WHERE o_custkey % 2 = 1 OR o_custkey > 100000) AS by_list, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS by_table,
   count(*) FILTER (WHERE o_custkey % 2 = 1 OR o_custkey > 100000 OR o_orderkey % 9 = 0) AS flagged FROM {DUCK_ORDERS}""")
def enum_long_list(spark, sf):
    """A list of 50 000 values, and a table of them."""
    orders = dirty_orders(spark, sf).withColumn("name", F.concat(F.lit(" cust "), "o_custkey"))
    known = table(spark, sf, "orders").where("o_orderkey % 9 <> 0").select("o_orderkey")
    lists = {"name": [f"Cust {i}" for i in range(0, 100_001, 2)], "o_orderkey": known}
    label = {"action": "label_failure"}
    rules = {"columns": [{"name": n, "tests": [{"type": "enum", "params": {"allowed_values": v}}], "failure_handling": label} for n, v in lists.items()]}
    report = validate(orders, rules, row_key=["o_orderkey"])
    found = report.test_results().agg(*[F.max(F.when(F.col("target") == n, F.col("failed_count"))).alias(a) for n, a in (("name", "by_list"), ("o_orderkey", "by_table"))])
    return found.join(F.broadcast(report.labeled().agg(F.count_if(F.col("__dq_status__") == "FAIL").alias("flagged"))))


@query(outcome("lang", "enum", "lower(lang) NOT IN ('de','es','fr','it','in','no','sv')", "documents"))
def enum_documents_country_preset(spark, sf):
    # of the language codes in the table, de, es and fr are also country codes
    return tested(table(spark, sf, "documents"), "lang", "enum", {"preset": "country_iso3166_alpha2"})


@query(outcome("text", "uniqueness",
               "(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1))", "documents"))
def uniqueness_documents_text(spark, sf):
    return tested(table(spark, sf, "documents"), "text", "uniqueness", order_by=["doc_id"], row_key=["doc_id"])


@query(outcome("l_orderkey", "uniqueness",
               "(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))", "lineitem"))
def uniqueness_lineitem_orderkey(spark, sf):
    return tested(table(spark, sf, "lineitem"), "l_orderkey", "uniqueness", declared="integer")


@query(outcome("custkey", "uniqueness",
               f"(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM {DUCK_ORDERS} GROUP BY custkey HAVING count(*) > 1))", DUCK_ORDERS))
def uniqueness_orders_custkey_with_nulls(spark, sf):
    return tested(dirty_orders(spark, sf), "custkey", "uniqueness", {"allow_nulls": False}, "integer")


_LAG = "SELECT {v} AS v, lag({v}) OVER (ORDER BY {o}) AS p FROM {t} WHERE {v} IS NOT NULL"


def _steps(target, value, key, source, test):
    inner = _LAG.format(v=value, o=key, t=source)
    return outcome(target, "monotonic", f"(SELECT count(*) FROM ({inner}) WHERE {test})", source)


@query(_steps("value", "value", "event_id", "events", "v < p"))
def monotonic_events_value(spark, sf):
    return tested(table(spark, sf, "events"), "value", "monotonic", {}, "float", order_by=["event_id"])


@query(_steps("ts", "ts", "event_id", "events", "v < p"))
def monotonic_events_ts(spark, sf):
    return tested(table(spark, sf, "events"), "ts", "monotonic", {}, "timestamp", order_by=["event_id"])


@query(_steps("o_totalprice", "o_totalprice", "o_orderkey", "orders", "v >= p"))
def monotonic_orders_strictly_decreasing(spark, sf):
    params = {"direction": "descending", "strict": True}
    return tested(table(spark, sf, "orders"), "o_totalprice", "monotonic", params, "float", order_by=["o_orderkey"])


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice,
   lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE o_totalprice < p""")
def monotonic_break_rows(spark, sf):
    return order.monotonic_breaks(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"])


@query("""SELECT 'lang' AS target, 'cardinality_warning' AS test,
   count(DISTINCT lang) <= 3 AS passed, CASE WHEN count(DISTINCT lang) <= 3 THEN 0 ELSE 1 END::BIGINT AS failed_count,
   count(*) AS total_values FROM documents""")
def cardinality_documents_lang(spark, sf):
    return tested(table(spark, sf, "documents"), "lang", "cardinality_warning", {"max": 3})


@query(outcome("url", "pattern", r"NOT regexp_matches(url, '^https?://[^\s/$.?#].[^\s]*$')", "pages"))
def pattern_pages_url_preset(spark, sf):
    return tested(table(spark, sf, "pages"), "url", "pattern", {"tier": "preset", "preset_name": "url"})


@query(outcome("email", "pattern", r"NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')", DUCK_CUSTOMER))
def pattern_customer_email_preset(spark, sf):
    return tested(dirty_customer(spark, sf), "email", "pattern", {"preset_name": "email"})


@query(outcome("p_brand", "pattern", r"NOT regexp_matches(p_brand, '^Brand#[0-9]{2}$')", "part"))
def pattern_part_brand_builder(spark, sf):
    builder = {"allowed_characters": ["digits"], "length": {"exact": 2}, "starts_with": "Brand#"}
    return tested(table(spark, sf, "part"), "p_brand", "pattern", {"tier": "builder", "builder": builder})


@query(outcome("c_name", "pattern", r"NOT regexp_matches(c_name, '^(?:Customer#0+(\d)[0-4])')", "customer"))
def pattern_customer_name_advanced(spark, sf):
    params = {"tier": "advanced", "pattern": r"Customer#0+(?P<tens>\d)[0-4]"}
    return tested(table(spark, sf, "customer"), "c_name", "pattern", params)


@query(outcome("text", "pattern", "NOT contains(text, 'the')", "documents"))
def pattern_documents_contains(spark, sf):
    return tested(table(spark, sf, "documents"), "text", "pattern", {"tier": "builder", "contains": "the"})


@query(outcome("day_text", "date_rule", "o_orderkey % 3 <> 0", DUCK_ORDERS))
def date_rule_orders_simple(spark, sf):
    return tested(dirty_orders(spark, sf), "day_text", "date_rule", {"target_format": "YYYY-MM-DD"}, "date")


@query(outcome("day_text", "date_rule", "o_orderkey % 3 = 2", DUCK_ORDERS))
def date_rule_orders_robust(spark, sf):
    params = {"target_format": "YYYYMMDD", "mode": "robust", "accepted_input_formats": ["YYYY-MM-DD", "MM/DD/YYYY"]}
    return tested(dirty_orders(spark, sf), "day_text", "date_rule", params, "date")


@query(outcome("p_retailprice", "date_rule", "p_retailprice < 1 OR p_retailprice > 2958465", "part"))
def date_rule_part_excel_serial(spark, sf):
    params = {"target_format": "YYYY-MM-DD", "excel_serial_enabled": True}
    return tested(table(spark, sf, "part"), "p_retailprice", "date_rule", params, "date")


@query(outcome("o_orderdate", "date_window",
               "o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '1998-06-30'", "orders"))
def date_window_orders(spark, sf):
    params = {"min_date": "1996-01-01", "max_date": "1998-06-30"}
    return tested(table(spark, sf, "orders"), "o_orderdate", "date_window", params, "date")


@query(outcome("day_text", "date_window",
               "day_text <> 'not-a-date' AND (o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '1998-06-30')", DUCK_ORDERS))
def date_window_orders_text(spark, sf):
    params = {"not_before": "1996-01-01", "not_after": "06/30/1998"}
    return tested(dirty_orders(spark, sf), "day_text", "date_window", params, "date")


@query(outcome("l_returnflag", "no_such_test", "(SELECT 0 * count(*) FROM lineitem)", "lineitem").replace("n = 0 AS passed", "false AS passed"))
def unknown_test_fails(spark, sf):
    return tested(table(spark, sf, "lineitem"), "l_returnflag", "no_such_test")


@query("""SELECT count(*) FILTER (WHERE l_quantity < 5) AS low, count(*) FILTER (WHERE l_tax > 0.05) AS taxed,
    count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS flagged FROM lineitem""")
def column_checks_as_expressions(spark, sf):
    lines = table(spark, sf, "lineitem")
    types = {f.name: f.dataType for f in lines.schema.fields}

    def failing(test, name, params):
        return F.count_if(column_checks.fails(test, F.col(name), types[name], params))

    return lines.agg(
        failing("range", "l_quantity", {"min": 5}).alias("low"),
        failing("range", "l_tax", {"max": 0.05}).alias("taxed"),
        failing("enum", "l_returnflag", {"allowed_values": ["A", "N"]}).alias("flagged"),
    )


# --- dataset checks ----------------------------------------------------------------------------


def repeats(source, columns):
    return f"""SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_rows, count(*) AS duplicate_groups,
      coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows, count(*) = 0 AS passed
      FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns} HAVING count(*) > 1)"""


@query(repeats(DUCK_DOUBLED, "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"))
def duplicate_rows_doubled_orders(spark, sf):
    return dc.duplicate_report(doubled_orders(spark, sf))


@query(repeats("documents", "text"))
def duplicate_rows_documents_text(spark, sf):
    return dc.duplicate_report(table(spark, sf, "documents"), ["text"], hash_first=True)


@query(repeats(DUCK_ORDERS, "priority, custkey"))
def duplicate_rows_with_nulls(spark, sf):
    return dc.duplicate_report(dirty_orders(spark, sf), ["priority", "custkey"])


@query(f"""SELECT (count(*) FILTER (WHERE custkey IS NULL) + count(*) FILTER (WHERE priority IS NULL))::BIGINT AS null_values,
   count(*) FILTER (WHERE custkey IS NULL OR priority IS NULL) AS affected_rows,
   count(*) FILTER (WHERE custkey IS NULL OR priority IS NULL) = 0 AS passed FROM {DUCK_ORDERS}""")
def key_completeness_orders(spark, sf):
    return dc.key_completeness_report(dirty_orders(spark, sf), ["custkey", "priority", "absent"])


@query(repeats("lineitem", "l_orderkey"))
def primary_key_uniqueness_lineitem(spark, sf):
    return dc.duplicate_report(table(spark, sf, "lineitem"), ["l_orderkey"])


@query(repeats("lineitem", "l_orderkey, l_linenumber"))
def composite_key_uniqueness_lineitem(spark, sf):
    return dc.duplicate_report(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 10""")
def composite_key_samples_lineitem(spark, sf):
    return dc.duplicate_examples(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _shipped(spark, sf):
    return table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )


@query("""SELECT count(*) AS rows_checked, count(*) FILTER (WHERE NOT l_shipdate >= o_orderdate) AS rows_failed,
   count(*) FILTER (WHERE NOT l_shipdate >= o_orderdate) = 0 AS passed
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def cross_field_ship_after_order(spark, sf):
    rule = {"if": {"all_not_null": ["l_shipdate", "o_orderdate"]}, "assert": {"expression": "l_shipdate >= o_orderdate"}}
    return dc.cross_field_report(_shipped(spark, sf), rule)


@query(f"""SELECT count(*) AS rows_checked, count(*) FILTER (WHERE coalesce(custkey < o_orderkey, false) = false) AS rows_failed,
   count(*) FILTER (WHERE coalesce(custkey < o_orderkey, false) = false) = 0 AS passed FROM {DUCK_ORDERS}""")
def cross_field_null_fails_order(spark, sf):
    return dc.cross_field_report(dirty_orders(spark, sf), {"assert": {"expression": "custkey < o_orderkey"}})


@query(f"""SELECT count(*) AS rows_checked, count(*) FILTER (WHERE priority = '5-LOW') AS rows_failed,
   count(*) FILTER (WHERE priority = '5-LOW') = 0 AS passed FROM {DUCK_ORDERS}""")
def cross_field_null_passes_inequality(spark, sf):
    return dc.cross_field_report(dirty_orders(spark, sf), {"assert": {"expression": "priority != '5-LOW'"}})


@query("""SELECT count(*) AS rows_checked, count(*) FILTER (WHERE NOT (o_totalprice >= 1000.5 AND o_orderdate < TIMESTAMP '1998-01-01')) AS rows_failed,
   false AS passed FROM orders""")
def cross_field_literals(spark, sf):
    rule = {"assert": {"expression": ["o_totalprice >= 1000.5", "o_orderdate < 1998-01-01"]}}
    return dc.cross_field_report(table(spark, sf, "orders"), rule)


def _iqr(value, source):
    return f"""WITH b AS (SELECT quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3 FROM {source})
    SELECT round(q1, 3) AS q1, round(q3, 3) AS q3, round(q3 - q1, 3) AS iqr,
      round(q1 - 1.5 * (q3 - q1), 3) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 3) AS upper_bound,
      (SELECT count(*) FROM {source} s WHERE {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
      true AS passed FROM b"""


_BOUNDS = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]


@query(_iqr("l_extendedprice", "lineitem"))
def outliers_iqr_lineitem_price(spark, sf):
    return rounded(dc.outliers_iqr_report(table(spark, sf, "lineitem"), "l_extendedprice"), *_BOUNDS, digits=3)


@query(_iqr("value", "events"))
def outliers_iqr_events_value(spark, sf):
    return rounded(dc.outliers_iqr_report(table(spark, sf, "events"), "value"), *_BOUNDS, digits=3)


@query("""WITH b AS (SELECT quantile_disc(l_extendedprice, 0.25) AS q1, quantile_disc(l_extendedprice, 0.75) AS q3 FROM lineitem)
   SELECT round(q1, 3) AS q1, round(q3, 3) AS q3, 1e-6 AS rank_error,
     (SELECT count(*) FROM lineitem WHERE l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1))::BIGINT AS outlier_count FROM b""")
def outliers_iqr_sketch(spark, sf):
    """Quartiles from a sketch in the same pass as all others; so accurate that the ranks are right here."""
    rules = {"columns": [], "dataset_tests": [{"type": "outliers_iqr", "params": {"column": "l_extendedprice", "multiplier": 0.5, "approximate": True, "accuracy": 1_000_000}}]}
    details = validate(table(spark, sf, "lineitem"), rules).test_results().select("details")
    value = lambda k: F.col("details")[k].cast("double")
    return details.select(F.round(value("q1"), 3).alias("q1"), F.round(value("q3"), 3).alias("q3"), value("rank_error").alias("rank_error"), F.col("details")["outlier_count"].cast("bigint").alias("outlier_count"))


def _z(value, source, t):
    return f"""WITH b AS (SELECT avg({value}) AS m, stddev_samp({value}) AS s FROM {source})
    SELECT round(m, 4) AS mean, round(s, 4) AS std,
     (SELECT count(*) FROM {source} x WHERE abs(({value} - m) / s) > {t}) AS outlier_count, true AS passed FROM b"""


@query(_z("value", "events", 3.0))
def outliers_zscore_events_value(spark, sf):
    return rounded(dc.outliers_zscore_report(table(spark, sf, "events"), "value"), "mean", "std")


@query(_z("c_acctbal", "customer", 1.5))
def outliers_zscore_customer_balance(spark, sf):
    return rounded(dc.outliers_zscore_report(table(spark, sf, "customer"), "c_acctbal", 1.5), "mean", "std")


# --- reference checks --------------------------------------------------------------------------

_HELD = "(SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)"


def _held(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 5 <> 0")


@query(f"""SELECT count(*) FILTER (WHERE NOT ok) AS missing_count, count(DISTINCT o_custkey) FILTER (WHERE NOT ok) AS missing_distinct,
   false AS passed FROM (SELECT o_custkey, o_custkey IN {_HELD} AS ok FROM orders)""")
def reference_orders_customer(spark, sf):
    return membership.reference_report(table(spark, sf, "orders"), "o_custkey", _held(spark, sf), "c_custkey")


@query(f"""SELECT count(*) FILTER (WHERE custkey IS NULL OR custkey NOT IN {_HELD}) AS missing_count,
   count(DISTINCT custkey) FILTER (WHERE custkey NOT IN {_HELD}) AS missing_distinct, false AS passed FROM {DUCK_ORDERS}""")
def reference_orders_nulls_fail(spark, sf):
    return membership.reference_report(dirty_orders(spark, sf), "custkey", _held(spark, sf), "c_custkey")


@query(f"""SELECT count(*) FILTER (WHERE custkey NOT IN {_HELD}) AS missing_count,
   count(DISTINCT custkey) FILTER (WHERE custkey NOT IN {_HELD}) AS missing_distinct, false AS passed FROM {DUCK_ORDERS}""")
def reference_orders_nulls_allowed(spark, sf):
    spec = {"trim_whitespace": True, "null_tokens": [], "case": "none"}
    return membership.reference_report(dirty_orders(spark, sf), "custkey", _held(spark, sf), "c_custkey", True, spec)


@query("""SELECT l_partkey AS value, count(*) AS row_count FROM lineitem
   WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 1 ORDER BY row_count DESC, value LIMIT 100""")
def reference_lineitem_part_missing_values(spark, sf):
    return membership.missing_values(
        table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size < 40"), "p_partkey"
    )


@query(f"""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN {_HELD}
   ORDER BY o_orderkey LIMIT 10""")
def reference_failing_examples(spark, sf):
    rows = membership.failing_examples(
        table(spark, sf, "orders"), "o_custkey", _held(spark, sf), "c_custkey", ["o_orderkey"]
    )
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus")
