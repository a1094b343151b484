"""Queries on corners of the rules: rule checks, blocking policies, valid tables, files, long mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DUCK_LINES, dirty_lines, query, table
from catalog.outputs import counted, treat
from rowassay import find_issues, validate
from rowassay.functions import dates
from rowassay.operators import treatments
from rowassay.session import scratch_path
from rowassay.sources import csv as csv_source, sinks

LABEL = {"action": "label_failure"}

@query("""SELECT 'columns[' || n_name || ']: unknown data type ''region ' || n_regionkey || '''' AS issue FROM nation WHERE n_regionkey > 2
   UNION ALL SELECT 'columns[' || n_name || ']: quarantine_row needs quarantine_export_name' FROM nation WHERE n_nationkey % 4 = 0
   UNION ALL SELECT 'columns[' || n_name || '].range: unknown severity ''' || lower(n_name) || '''' FROM nation WHERE n_nationkey % 3 = 0
   UNION ALL SELECT 'columns[' || n_name || ']: listed twice' FROM nation WHERE n_nationkey % 10 = 5
   UNION ALL SELECT 'columns[' || n_name || ']: unknown data type ''region ' || n_regionkey || '''' FROM nation WHERE n_nationkey % 10 = 5 AND n_regionkey > 2
   UNION ALL SELECT 'columns[' || n_name || ']: quarantine_row needs quarantine_export_name' FROM nation WHERE n_nationkey % 10 = 5 AND n_nationkey % 4 = 0
   UNION ALL SELECT 'columns[' || n_name || '].range: unknown severity ''' || lower(n_name) || '''' FROM nation WHERE n_nationkey % 10 = 5 AND n_nationkey % 3 = 0
   UNION ALL SELECT 'dataset_tests[' || (row_number() OVER (ORDER BY n_nationkey) - 1) || ']: column ''no ' || n_name || ''' is not listed' FROM nation
   UNION ALL SELECT (SELECT count(*) FROM orders)::VARCHAR || ' orders'""")
def rule_issues_orders(spark, sf):
    """Faulty rules, one column and one key check per nation, looked at with the schema of the orders."""
    nations = table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows at every size
    columns = [
        {
            "name": n["n_name"],
            "data_type": f"region {n['n_regionkey']}" if n["n_regionkey"] > 2 else "text",
            "tests": [{"type": "range", "severity": n["n_name"].lower() if n["n_nationkey"] % 3 == 0 else "error"}],
            "failure_handling": {"action": "quarantine_row" if n["n_nationkey"] % 4 == 0 else "drop_row"},
        }
        for n in [*nations, *[n for n in nations if n["n_nationkey"] % 10 == 5]]
    ]
    tests = [{"type": "primary_key_uniqueness", "params": {"key_columns": ["no " + n["n_name"]]}} for n in nations]
    orders = table(spark, sf, "orders")
    found = find_issues({"columns": columns, "dataset_tests": tests}, orders.schema)
    count = orders.agg(F.concat(F.count(F.lit(1)), F.lit(" orders")).alias("issue"))
    return spark.createDataFrame([(i,) for i in found], "issue string").unionByName(count)


VALID_RULES = {
    "columns": [
        {"name": "o_orderkey", "data_type": "integer", "tests": [{"type": "not_null"}, {"type": "uniqueness"}]},
        {"name": "o_totalprice", "data_type": "float", "tests": [{"type": "range", "params": {"min": 0}}]},
    ]
}


@query("SELECT count(*) AS total_rows, 4::BIGINT AS tests_run, 0::BIGINT AS errors, false AS has_blocking_errors, true AS is_valid FROM orders")
def summary_valid_orders(spark, sf):
    rules = {**VALID_RULES, "dataset_tests": [{"type": "primary_key_uniqueness", "params": {"key_columns": ["o_orderkey"]}}]}
    report = validate(table(spark, sf, "orders"), rules, row_key=["o_orderkey"])
    report.require_valid()
    return report.summary().select("total_rows", "tests_run", "errors", "has_blocking_errors", "is_valid")


@query("""SELECT count(*) FILTER (WHERE o_totalprice > 200000) AS failing, count(*) AS total_rows, 'o_totalprice:FAIL,o_orderkey:PASS' AS statuses,
   true AS raised FROM orders""")
def strict_failure_orders(spark, sf):
    """The summary for a caller, and the error that a strict policy raises."""
    rules = {
        "columns": [
            {"name": "o_totalprice", "data_type": "float", "tests": [{"type": "range", "params": {"max": 200000}}], "failure_handling": {"action": "strict_fail"}},
            {"name": "o_orderkey", "data_type": "integer", "tests": [{"type": "uniqueness"}], "failure_handling": LABEL},
        ]
    }
    report = validate(table(spark, sf, "orders"), rules, row_key=["o_orderkey"])
    seen = report.summary_dict()
    try:
        report.require_valid()
        raised = False
    except RuntimeError:
        raised = True
    statuses = ",".join(f"{c}:{seen['column_statuses'][c]}" for c in ("o_totalprice", "o_orderkey"))
    return report.summary().select(
        F.col("rows_with_errors").alias("failing"), "total_rows", F.lit(statuses).alias("statuses"), F.lit(raised).alias("raised")
    )


@query("""SELECT CASE WHEN p_size + 40 >= 69 THEN 1900 ELSE 2000 END + p_size + 40 AS year, count(*) AS n FROM part GROUP BY 1""")
def two_digit_years_part(spark, sf):
    """Sizes 1 to 50 written as years 41 to 90 around the pivot."""
    text = F.concat(F.lit("03/04/"), F.lpad((F.col("p_size") + 40).cast("string"), 2, "0"))
    read = dates.parse_any(text, ["MM/DD/YY"], False)
    return counted(table(spark, sf, "part").select(F.year(read).cast("int").alias("year")), "year")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def runs_of_spaces_orders(spark, sf):
    """Between the parts of a date any number of spaces counts as one."""
    gap = F.expr("repeat(' ', CAST(1 + o_orderkey % 4 AS INT))")
    text = F.concat(F.date_format("o_orderdate", "MMM"), gap, F.date_format("o_orderdate", "dd"), F.lit(","), gap, F.date_format("o_orderdate", "yyyy"))
    read = dates.parse_any(text, ["MMM DD, YYYY"], False)
    return counted(table(spark, sf, "orders").select(F.date_format(read, "yyyy-MM-dd").alias("day")), "day")


@query(r"""SELECT count(*) FILTER (WHERE t NOT SIMILAR TO '\[[0-9]+\] \[[a-z]+\].*') AS failed_count, count(*) AS n FROM
   (SELECT CASE WHEN page_id % 3 = 0 THEN '(' || page_id || ') [x]' ELSE '[' || page_id || '] [' || split_part(url, ':', 1) || '] ' || url END AS t FROM pages)""")
def pattern_pages_bracketed(spark, sf):
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("("), "page_id", F.lit(") [x]")))
    text = text.otherwise(F.concat(F.lit("["), "page_id", F.lit("] ["), F.split("url", ":")[0], F.lit("] "), "url"))
    rules = {"columns": [{"name": "t", "tests": [{"type": "pattern", "params": {"tier": "advanced", "pattern": r"\[[0-9]+\] \[[a-z]+\]"}}], "failure_handling": LABEL}]}
    report = validate(table(spark, sf, "pages").select("page_id", text.alias("t")), rules, row_key=["page_id"])
    return report.summary().select(F.col("error_cells").alias("failed_count"), F.col("total_rows").alias("n"))


@query("""SELECT CASE WHEN z % 3 = 0 AND z < 1200 THEN 'area ' || z ELSE lpad(z::VARCHAR, greatest(5, length(z::VARCHAR))::INTEGER, '0') END AS v, count(*) AS n
   FROM (SELECT c_custkey AS z FROM customer) GROUP BY 1""")
def zip_left_pad_long_mapping(spark, sf):
    """A mapping of 400 entries is joined; keys are padded as they are with a short one."""
    params = {"zip_left_pad_zeros": True, "mapping": {f"{z:05d}": f"area {z}" for z in range(0, 1200, 3)}}
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("v"))
    return counted(treatments.map_by_table(rows, "v", params), "v")


@query(f"""SELECT (CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN l_extendedprice ELSE CAST(l_quantity AS INTEGER) END)::DOUBLE AS v,
   CASE WHEN l_linenumber = 5 THEN '99999999999999999999' END AS wide, count(*) AS n FROM {DUCK_LINES} GROUP BY ALL""")
def numeric_cleanup_fractions_integer_column(spark, sf):
    """Fractions and twenty digits stay in a column that is declared as integer."""
    lines = dirty_lines(spark, sf)
    number = F.col("l_linenumber")
    text = F.when(number == 3, "none").when(number == 4, F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)"))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    wide = F.when(number == 5, "99,999,999,999,999,999,999")
    rows = lines.select("l_orderkey", text.alias("v"), wide.alias("wide"))
    got = treat(treat(rows, "v", "numeric_cleanup", {"on_parse_error": "set_null"}, "integer"), "wide", "numeric_cleanup", {"on_parse_error": "set_null"}, "integer")
    return got.groupBy(F.col("v").cast("double").alias("v"), F.col("wide").cast("decimal(38,0)").cast("string").alias("wide")).agg(F.count(F.lit(1)).alias("n"))


def _sizes(spark, path, names):
    out = None
    for name in names:
        one = csv_source.read_csv(spark, f"{path}/{name}", encoding="utf-8").rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'clean' AS name, count(*) FILTER (WHERE NOT (p_size > 40 OR p_retailprice > 1500)) AS n FROM part
   UNION ALL SELECT 'quarantine', count(*) FILTER (WHERE p_size > 40 OR p_retailprice > 1500) FROM part
   UNION ALL SELECT 'named/quarantine', count(*) FILTER (WHERE p_size > 40) FROM part
   UNION ALL SELECT 'named/clean', count(*) FILTER (WHERE p_retailprice > 1500) FROM part HAVING count(*) FILTER (WHERE p_retailprice > 1500) > 0""")
def written_outputs_named_quarantine(spark, sf):
    """Named sets that are called like the outputs themselves."""
    def rule(name, most, to):
        return {"name": name, "data_type": "float", "tests": [{"type": "range", "params": {"max": most}}], "failure_handling": {"action": "quarantine_row", "quarantine_export_name": to}}

    rules = {"columns": [rule("p_size", 40, "quarantine"), rule("p_retailprice", 1500, "clean")]}
    path = scratch_path(spark, "named")
    report = validate(table(spark, sf, "part"), rules, row_key=["p_partkey"])
    return _sizes(spark, path, sinks.write_outputs(report.split(), path))


@query("""SELECT 'summary' AS name, 1::BIGINT AS n, (SELECT count(*) FROM documents) AS total_rows UNION ALL SELECT 'test_results', 1, NULL
   UNION ALL SELECT 'column_results', 1, NULL UNION ALL SELECT 'blocking_errors', 0, NULL UNION ALL SELECT 'cell_errors', 0, NULL""")
def written_report_without_flags(spark, sf):
    """A rule set whose only check flags no rows."""
    rules = {"columns": [{"name": "lang", "tests": [{"type": "cardinality_warning", "params": {"max": 2}}], "failure_handling": LABEL}]}
    path = scratch_path(spark, "no-flags")
    report = validate(table(spark, sf, "documents").select("lang"), rules)
    names = sinks.write_report(report, path)
    out = None
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}")
        total = F.max("total_rows") if name == "summary" else F.lit(None).cast("bigint")
        one = rows.agg(F.count(F.lit(1)).alias("n"), total.alias("total_rows")).select(F.lit(name).alias("name"), "n", "total_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS brand FROM part")
def csv_reordered_headers(spark, sf):
    """Two files with the same columns in another order."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    path = scratch_path(spark, "reordered")
    part.where("id % 2 = 0").select("id", "name", "brand").coalesce(1).write.options(header=True).csv(f"{path}/a")
    part.where("id % 2 = 1").select("brand", "id", "name").coalesce(1).write.options(header=True).csv(f"{path}/b")
    return csv_source.read_csv(spark, [f"{path}/a", f"{path}/b"]).rows.select("id", "name", "brand")


@query("""SELECT count(*) FILTER (WHERE falls) AS failed_count, count(*) FILTER (WHERE falls) AS labeled FROM
   (SELECT value < lag(value) OVER (ORDER BY date_trunc('hour', ts), event_id) AS falls FROM events)""")
def monotonic_events_hour_and_id(spark, sf):
    """Order by the hour and the id: many rows share the first position."""
    events = table(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"), "value")
    rules = {"columns": [{"name": "value", "data_type": "float", "tests": [{"type": "monotonic"}], "failure_handling": LABEL}]}
    report = validate(events, rules, row_key=["event_id"], order_by=["hour", "event_id"])
    labeled = report.labeled().agg(F.count_if(F.col("__dq_status__") == "FAIL").alias("labeled"))
    return report.test_results().select("failed_count").join(F.broadcast(labeled), F.col("failed_count") >= 0)


@query("SELECT count(*) AS total_rows, true AS counts_equal_labels, true AS any_failed FROM events")
def monotonic_events_shared_position(spark, sf):
    """Order by the hour alone: what follows what inside an hour is not said, but counts and labels agree."""
    events = table(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"), "value")
    rules = {"columns": [{"name": "value", "data_type": "float", "tests": [{"type": "monotonic"}], "failure_handling": LABEL}]}
    report = validate(events, rules, row_key=["event_id"], order_by=["hour"])
    labeled = report.labeled().agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("__dq_status__") == "FAIL").alias("labeled"))
    both = report.test_results().select("failed_count").join(F.broadcast(labeled), F.col("failed_count") >= 0)
    return both.select("total_rows", (F.col("failed_count") == F.col("labeled")).alias("counts_equal_labels"), (F.col("failed_count") > 0).alias("any_failed"))


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || p_type || ', "' || p_brand || '"' WHEN p_partkey % 3 = 1 THEN chr(10) || p_name ELSE p_name END AS name,
   (p_partkey % 5)::VARCHAR AS file FROM part""")
def csv_multiline_skip(spark, sf):
    """Five files, read in splits, with line breaks inside quotes, two skipped rows of title and one of totals."""
    part = table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("\n"), "p_type", F.lit(', "'), "p_brand", F.lit('"')))
    name = name.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("\n"), "p_name")).otherwise(F.col("p_name"))
    cell = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    body = part.select((F.col("p_partkey") % 5).alias("n"), F.col("p_partkey").alias("at"), F.concat_ws(",", "p_partkey", cell, (F.col("p_partkey") % 5)).alias("value"))
    lead = [(-3, "a report"), (-2, '"made\ntoday, ""early""",x'), (-1, "id,name,file"), (2**62, '"the\nend"')]
    extra = body.select("n").distinct().select("n", F.inline(F.array(*[F.struct(F.lit(at).cast("bigint").alias("at"), F.lit(v).alias("value")) for at, v in lead])))
    path = scratch_path(spark, "multiline")
    rows = body.unionByName(extra).repartition("n").sortWithinPartitions("n", "at")
    rows.select("n", "value").write.partitionBy("n").text(path)
    return csv_source.read_csv(spark, path, encoding="utf-8", skip_rows=2, skip_footer_rows=1, multiline=True).rows


@query("""SELECT s_suppkey::VARCHAR AS key, s_name || ' é' AS name, 'mixed' AS encoding FROM supplier WHERE s_suppkey % 2 = 0
   UNION ALL SELECT s_suppkey::VARCHAR, s_name || ' naïve', 'mixed' FROM supplier WHERE s_suppkey % 2 = 1""")
def csv_mixed_encodings(spark, sf):
    """UTF-8 and Latin-1 files in one folder; each is read with its own charset."""
    supplier = table(spark, sf, "supplier")
    path = scratch_path(spark, "mixed")
    for i, (charset, word) in enumerate([("UTF-8", " é"), ("ISO-8859-1", " naïve")]):
        rows = supplier.where(F.col("s_suppkey") % 2 == i).select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(word)).alias("name"))
        rows.write.options(header=True, encoding=charset).csv(f"{path}/{i}")
    read = csv_source.read_csv(spark, [f"{path}/0", f"{path}/1"])
    return read.rows.withColumn("encoding", F.lit(read.encoding))


@query(r"""SELECT count(*) FILTER (WHERE p_partkey % 3 <> 0) AS line_breaks, count(*) FILTER (WHERE p_partkey % 4 = 0) AS classes,
   count(*) FILTER (WHERE NOT regexp_matches(p_name, '^[^\x00-\x40\x5B-\x60\x7B-\x7F]+ ?[a-z]*')) AS words, count(*) FILTER (WHERE p_partkey % 2 = 1) AS references_ FROM part""")
def pattern_vertical_tab(spark, sf):
    """Patterns whose escapes, classes and references mean other things in Java, as Python reads them."""
    part = table(spark, sf, "part")
    mark = F.element_at(F.array(F.lit("\v"), F.lit("\n"), F.lit("\x85")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = part.select(
        F.concat("p_name", mark, "p_brand").alias("line_breaks"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("[x]\t")).otherwise("[x&&y]").alias("classes"),
        F.col("p_name").alias("words"),
        F.concat(F.lit("k"), F.when(F.col("p_partkey") % 2 == 1, F.lit("K")).otherwise("\u212a"), F.lit("..")).alias("references_"),
    )
    patterns = {"line_breaks": r"[^\v]*\v[^\v]+\Z", "classes": r"\[[x&&[y]+\]$", "words": r"[^\W\d_]+ ?[a-z]*", "references_": r"k\u212a(?P<dot>\.)(?P=dot)$"}
    rules = {"columns": [{"name": n, "tests": [{"type": "pattern", "params": {"tier": "custom", "pattern": p}}]} for n, p in patterns.items()]}
    found = validate(rows, rules).test_results()
    return found.agg(*[F.max(F.when(F.col("target") == n, F.col("failed_count"))).alias(n) for n in patterns])
