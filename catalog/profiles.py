"""Sources, shaping, profiles, sinks, row ids and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DUCK_CUSTOMER, DUCK_DOUBLED, DUCK_LINES, DUCK_ORDERS, dirty_customer, dirty_lines, dirty_orders,
    doubled_orders, query, table,
)
from catalog.outputs import _CONDITIONS, _FLAGGED, _SEG_CHANGED, ACTION_RULES, CLEAN_RULES, order_report
from rowassay import clean, validate
from rowassay.operators import order, profile
from rowassay.session import scratch_path
from rowassay.sources import csv as csv_source, shaping, sinks
from rowassay.streaming.labels import label_stream

# --- sources -----------------------------------------------------------------------------------


@query("SELECT p_type, count(*) AS n, round(sum(p_retailprice), 2) AS total, min(p_name) AS first_name FROM part GROUP BY p_type")
def csv_round_trip_part(spark, sf):
    path = scratch_path(spark, "part")
    sinks.write_csv(table(spark, sf, "part"), path)
    back = csv_source.read_csv(spark, path).rows
    return back.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("p_retailprice").try_cast("double")), 2).alias("total"),
        F.min("p_name").alias("first_name"),
    )


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment || 'é' AS segment, 'latin-1' AS encoding FROM customer")
def csv_latin1_fallback(spark, sf):
    path = scratch_path(spark, "latin1")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("é")).alias("segment"))
    rows.write.options(header=True, encoding="ISO-8859-1").csv(path)
    read = csv_source.read_csv(spark, path)
    return read.rows.withColumn("encoding", F.lit(read.encoding))


def _lines_by_file(df, path):
    """Text files, one per value of ``file``, holding the lines in order of ``at``."""
    rows = df.repartition("file").sortWithinPartitions("file", "at").select("file", "value")
    rows.write.partitionBy("file").text(path)


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part")
def csv_skip_head_and_foot(spark, sf):
    part = table(spark, sf, "part").withColumn("file", F.pmod(F.hash("p_partkey"), F.lit(6)))
    body = part.select("file", F.col("p_partkey").alias("at"), F.concat_ws(",", "p_partkey", "p_name").alias("value"))
    files = part.select("file").distinct()
    extra = files.select(
        "file",
        F.inline(
            F.array(
                F.struct(F.lit(-3).cast("bigint").alias("at"), F.lit("a report").alias("value")),
                F.struct(F.lit(-2).cast("bigint").alias("at"), F.lit("made today").alias("value")),
                F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit("id,name").alias("value")),
                F.struct(F.lit(2**62).alias("at"), F.lit("end of report").alias("value")),
            )
        ),
    )
    path = scratch_path(spark, "skips")
    _lines_by_file(body.unionByName(extra), path)
    return csv_source.read_csv(spark, path, encoding="utf-8", skip_rows=2, skip_footer_rows=1).rows


@query("""SELECT count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS kept, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS rejected,
   count(*) FILTER (WHERE s_suppkey % 3 = 1) AS padded FROM supplier""")
def csv_uneven_rows(spark, sf):
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", F.lit("more")))
    line = line.when(F.col("s_suppkey") % 3 == 1, F.concat_ws(",", "s_suppkey", "s_name"))
    line = line.otherwise(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey"))
    supplier = table(spark, sf, "supplier")
    body = supplier.select(F.pmod(F.hash("s_suppkey"), F.lit(3)).alias("file"), F.col("s_suppkey").alias("at"), line.alias("value"))
    heads = body.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("at"), F.lit("key,name,nation").alias("value"))
    path = scratch_path(spark, "uneven")
    _lines_by_file(body.unionByName(heads), path)
    read = csv_source.read_csv(spark, path, encoding="utf-8")
    tagged = read.rows.select(F.lit(True).alias("kept"), F.col("nation").isNull().alias("padded")).unionByName(
        read.rejects.select(F.lit(False).alias("kept"), F.lit(False).alias("padded"))
    )
    return tagged.agg(
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if("padded").alias("padded")
    )


@query(f"SELECT CASE WHEN segment = 'N/A' THEN NULL ELSE segment END AS segment, count(*) AS n FROM {DUCK_CUSTOMER} GROUP BY 1")
def null_tokens_on_read(spark, sf):
    rows = dirty_customer(spark, sf).select(csv_source.null_tokens(F.col("segment")).alias("segment"))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) > 0 AS has_rows, true AS has_columns, true AS names_differ FROM orders")
def shape_orders(spark, sf):
    return shaping.shape_report(table(spark, sf, "orders"))


@query("""SELECT count(*) AS row_count, 11::BIGINT AS column_count, count(*) < 10 AS too_few_rows, count(*) > 50000 AS too_many_rows,
   true AS too_many_columns, false AS passed FROM lineitem""")
def size_bounds_lineitem(spark, sf):
    return shaping.size_report(table(spark, sf, "lineitem"), min_rows=10, max_rows=50_000, max_columns=10)


@query('SELECT o_orderstatus AS "STATUS", count(*) AS n, round(sum(o_totalprice), 2) AS "OTOTALPRICE" FROM orders GROUP BY 1')
def tidy_header_orders(spark, sf):
    settings = {
        "quick_actions": {"trim_whitespace": True, "remove_punctuation": True, "to_uppercase": True},
        "column_renames": {"OORDERSTATUS": "STATUS"},
    }
    out = shaping.shape(table(spark, sf, "orders"), settings)
    return out.groupBy("STATUS").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("OTOTALPRICE"), 2).alias("OTOTALPRICE"))


@query("SELECT c_custkey AS id, c_name, c_nationkey, c_mktsegment FROM customer")
def rename_and_drop_ignored(spark, sf):
    renames = {"c_custkey": "id", "c_acctbal": "balance"}
    out = shaping.rename(table(spark, sf, "customer"), renames)
    return shaping.drop_ignored(out, ["c_acctbal"], renames)


@query("""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents
   WHERE NOT (contains(lower(text), 'total') OR contains(lower(lang), 'total') OR contains(lower(source), 'total')) GROUP BY lang""")
def drop_total_rows_documents(spark, sf):
    kept = shaping.drop_total_rows(table(spark, sf, "documents"))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT count(*) AS n FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'Sub-Total' ELSE p_name END AS p_name FROM part) WHERE lower(p_name) NOT LIKE '%total%'""")
def drop_total_rows_part(spark, sf):
    name = F.when(F.col("p_partkey") % 9 == 0, "Sub-Total").otherwise(F.col("p_name"))
    return shaping.drop_total_rows(table(spark, sf, "part").withColumn("p_name", name)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10")
def head_orders(spark, sf):
    return shaping.head(table(spark, sf, "orders"), ["o_orderkey"], 10).select("o_orderkey", "o_custkey", "o_orderpriority")


# --- profiles ----------------------------------------------------------------------------------


@query(f"""SELECT (SELECT count(*) FROM {DUCK_DOUBLED}) AS row_count, 6::BIGINT AS column_count, (SELECT count(*) * 6 FROM {DUCK_DOUBLED}) AS total_cells,
   0::BIGINT AS null_count, 0.0::DOUBLE AS null_percent, (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS duplicate_row_count""")
def table_summary_doubled_orders(spark, sf):
    return profile.table_summary(doubled_orders(spark, sf))


_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "priority", "custkey", "day_text", "flag_text"]


def _stats(c):
    return f"""SELECT '{c}' AS column_name, count(*) AS total_values, count(*) - count({c}) AS null_count,
      round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percent, count(DISTINCT {c}) AS unique_count,
      round(count(DISTINCT {c}) * 100.0 / count({c}), 2) AS cardinality_percent,
      min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM {DUCK_ORDERS}"""


@query(" UNION ALL ".join(_stats(c) for c in _COLS))
def column_stats_orders(spark, sf):
    return profile.column_stats(dirty_orders(spark, sf).select(*_COLS)).drop("position", "data_type", "warnings", "health")


def _mixed(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("sparse"),
        F.when(F.col("o_orderkey") % 10 > 2, F.lit("x")).alias("constant"),
    )


_MIXED = """(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS sparse,
   CASE WHEN o_orderkey % 10 > 2 THEN 'x' END AS constant FROM orders)"""


def _health(c):
    return f"""SELECT '{c}' AS column_name, nulls, uniq, filled, nulls * 100.0 / total AS np, uniq * 100.0 / nullif(filled, 0) AS cp FROM
     (SELECT count(*) AS total, count(*) - count({c}) AS nulls, count({c}) AS filled, count(DISTINCT {c}) AS uniq FROM {_MIXED})"""


@query(f"""SELECT column_name, warnings::BIGINT AS warnings, CASE WHEN np > 50 OR warnings >= 2 THEN 'critical' WHEN np > 20 OR warnings >= 1 THEN 'warning' ELSE 'good' END AS health
  FROM (SELECT *, (np > 20)::INT + (filled > 10 AND ((cp > 95 AND uniq > 100) OR (cp < 1 AND uniq < 5)))::INT + (uniq = 1)::INT AS warnings
  FROM ({" UNION ALL ".join(_health(c) for c in ("o_orderkey", "o_orderstatus", "sparse", "constant"))}))""")
def column_health_orders(spark, sf):
    out = profile.column_stats(_mixed(spark, sf))
    return out.select("column_name", F.size("warnings").cast("bigint").alias("warnings"), "health")


def _complete(c):
    return f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, round(count({c}) * 100.0 / count(*), 4) AS completeness FROM {_MIXED}"


@query(" UNION ALL ".join(_complete(c) for c in ("o_orderkey", "o_orderstatus", "sparse", "constant")) + f"""
  UNION ALL SELECT '*', filled, 4 * total - filled, round(filled * 100.0 / (4 * total), 4) FROM
  (SELECT count(*) AS total, count(o_orderkey) + count(o_orderstatus) + count(sparse) + count(constant) AS filled FROM {_MIXED})""")
def completeness_orders(spark, sf):
    return profile.completeness(_mixed(spark, sf)).withColumn("completeness", F.round("completeness", 4))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count FROM {_MIXED}" for c in ("o_orderkey", "o_orderstatus", "sparse", "constant")))
def null_counts_orders(spark, sf):
    return profile.null_counts(_mixed(spark, sf))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def distinct_counts_documents(spark, sf):
    return profile.distinct_counts(table(spark, sf, "documents"))


def _first(c, size, source, key):
    return f"(SELECT {c} AS v FROM {source} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT {size})"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, array_to_string(list_sort(list(DISTINCT v)), '|') AS samples FROM {_first(c, 5, 'part', 'p_partkey')}" for c in ("p_name", "p_brand", "p_type")))
def sample_values_part(spark, sf):
    part = table(spark, sf, "part").select("p_name", "p_brand", "p_type", F.col("p_partkey").alias("k"))
    out = profile.sample_values(part, ["k"]).where("column_name != 'k'")
    return out.withColumn("samples", F.array_join(F.array_sort("samples"), "|"))


# What values say, in SQL: conditions on all of a column's first values.
_BOOLEAN = "lower(trim(v)) IN ('true', 'false', 'yes', 'no', '1', '0', 't', 'f', 'y', 'n'{more})"
_DATE = "regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?$') OR regexp_matches(v, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$')"
_TYPED = "regexp_extract(typeof(any_value({c})), '[A-Z]+')"
_PHYSICAL = """CASE WHEN {t} IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer' WHEN {t} IN ('DOUBLE', 'FLOAT', 'DECIMAL') THEN 'float'
   WHEN {t} IN ('DATE', 'TIMESTAMP') THEN '{moment}' WHEN {t} = 'BOOLEAN' THEN 'boolean' ELSE 'text' END"""


def _guess_of(column, size, source, order):
    """What the first values of a text column look like."""
    return f"""SELECT '{column}' AS column_name, CASE WHEN count(*) = 0 THEN 'unknown' WHEN bool_and({_BOOLEAN.format(more="")}) THEN 'boolean' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'numeric'
      WHEN bool_and({_DATE}) THEN 'date/datetime' ELSE 'string' END AS guessed FROM {_first(column, size, source, order)}"""


def _physical_of(column, source, moment):
    return f"SELECT '{column}' AS column_name, {_PHYSICAL.format(t=_TYPED.format(c=column), moment=moment)} AS guessed FROM {source}"


_LOOKS = f"""(SELECT *, CAST(o_orderkey AS VARCHAR) || '.50' AS number_text, CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE ' n' END AS yes_no, CASE WHEN o_orderkey < 0 THEN 'x' END AS nothing,
   strftime(o_orderdate, '%Y-%m-%d') AS iso_day FROM {DUCK_ORDERS})"""


@query(" UNION ALL ".join([_physical_of(c, _LOOKS, "datetime") for c in ("o_orderkey", "o_totalprice", "o_orderdate")]
       + [_guess_of(c, 100, _LOOKS, "o_orderkey") for c in ("priority", "day_text", "flag_text", "number_text", "yes_no", "nothing", "iso_day")]))
def semantic_types_orders(spark, sf):
    cols = ["o_orderkey", "o_totalprice", "priority", "day_text", "flag_text", "o_orderdate", "number_text", "yes_no", "nothing", "iso_day"]
    rows = dirty_orders(spark, sf).withColumns({
        "number_text": F.concat("o_orderkey", F.lit(".50")), "yes_no": F.when(F.col("o_orderkey") % 3 == 0, "Yes").otherwise(" n"),
        "nothing": F.when(F.col("o_orderkey") < 0, "x"), "iso_day": F.date_format("o_orderdate", "yyyy-MM-dd"),
    })
    return profile.semantic_types(rows.select(*cols), ["o_orderkey"])


def _rule_type_of(column, size, source, order):
    """The declared type the first values of a text column ask for."""
    return f"""SELECT CASE WHEN count(*) = 0 THEN 'text' WHEN bool_and({_BOOLEAN.format(more=", 'on', 'off'")}) THEN 'boolean'
      WHEN bool_and(regexp_matches(trim(translate(v, ',$%', '')), '^-?[0-9]+$')) THEN 'integer' WHEN bool_and(TRY_CAST(translate(v, ',$', '') AS DOUBLE) IS NOT NULL) THEN 'float'
      WHEN bool_and({_DATE}) THEN 'date' ELSE 'text' END AS guessed, '{column}' AS column_name FROM {_first(column, size, source, order)}"""


_LINE_ORDER = "l_orderkey, l_linenumber, l_extendedprice, l_shipdate"


@query(" UNION ALL ".join([_rule_type_of(c, 20, DUCK_LINES, _LINE_ORDER) for c in ("discount_text", "l_returnflag", "price_text", "quantity_text")]
       + [f"SELECT guessed, column_name FROM ({_physical_of('l_linenumber', DUCK_LINES, 'timestamp')})",
          f"SELECT CASE WHEN contains(column_name, 'date') THEN 'date' ELSE guessed END, column_name FROM ({_physical_of('l_shipdate', DUCK_LINES, 'timestamp')})"]))
def rule_types_lineitem(spark, sf):
    lines = dirty_lines(spark, sf)
    by = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    names = ["discount_text", "l_shipdate", "l_linenumber", "l_returnflag", "price_text", "quantity_text"]
    return profile.rule_types(lines.select(*dict.fromkeys(names + by)), by).where(F.col("column_name").isin(names))


def _percentage_of(column, source, order):
    return f"""SELECT '{column}' AS column_name, is_percentage, is_percentage AND dotted AS has_decimal, CASE WHEN NOT is_percentage THEN 'text' WHEN dotted THEN 'float' ELSE 'integer' END AS suggested_type
      FROM (SELECT avg(contains(v, '%')::INTEGER) >= 0.5 AS is_percentage, bool_or(contains(replace(v, '%', ''), '.')) AS dotted FROM {_first(column, 20, source, order)})"""


_SHARES = f"""(SELECT *, CAST(l_quantity AS DECIMAL(18,2))::VARCHAR || '%' AS share_text,
   CASE WHEN l_linenumber % 2 = 0 THEN discount_text ELSE quantity_text END AS half_text FROM {DUCK_LINES})"""


@query(" UNION ALL ".join(_percentage_of(c, _SHARES, _LINE_ORDER) for c in ("discount_text", "price_text", "share_text", "half_text")))
def percentage_columns_lineitem(spark, sf):
    by = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    share = F.concat(F.col("l_quantity").cast("decimal(18,2)"), F.lit("%")).alias("share_text")
    half = F.when(F.col("l_linenumber") % 2 == 0, F.col("discount_text")).otherwise(F.col("quantity_text")).alias("half_text")
    out = profile.percentage_columns(dirty_lines(spark, sf).select("discount_text", "price_text", share, half, *by), by)
    return out.where(~F.col("column_name").isin(by))


def _format_of(column, source, order):
    spellings = [("true/false (text)", "lower(trim(v)) IN ('true', 'false')"), ("t/f (text)", "lower(trim(v)) IN ('t', 'f')"), ("1/0 (numeric)", "trim(v) IN ('1', '0')"),
                 ("yes/no (text)", "lower(trim(v)) IN ('yes', 'no')"), ("Y/N (text)", "trim(v) IN ('Y', 'N', 'y', 'n')")]
    cases = " ".join(f"WHEN bool_and({test}) THEN '{label}'" for label, test in spellings)
    return f"SELECT '{column}' AS column_name, CASE {cases} ELSE 'Any standard format' END AS boolean_format FROM {_first(column, 20, source, order)}"


_FLAGS = """(SELECT o_orderkey AS k, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'n' END AS yn, CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'f' END AS tf,
   CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS words, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS bits FROM orders)"""


@query(" UNION ALL ".join(_format_of(c, _FLAGS, "k") for c in ("yn", "tf", "words", "bits", "o_orderpriority")))
def boolean_formats_orders(spark, sf):
    even = F.col("o_orderkey") % 2 == 0
    rows = table(spark, sf, "orders").select(
        F.when(even, "Y").otherwise("n").alias("yn"),
        F.when(even, "T").otherwise("f").alias("tf"),
        F.when(even, "Yes").otherwise("no").alias("words"),
        F.when(even, "1").otherwise("0").alias("bits"),
        "o_orderpriority",
        F.col("o_orderkey").alias("k"),
    )
    return profile.boolean_formats(rows, ["k"]).where("column_name != 'k'")


_DEFAULTS = " UNION ALL ".join([f"SELECT guessed, column_name FROM ({_physical_of(c, 'customer', 'timestamp')})" for c in ("c_custkey", "c_acctbal")]
                                + [_rule_type_of(c, 20, "customer", "c_custkey") for c in ("c_name", "c_mktsegment")])


@query(f"SELECT column_name, guessed AS data_type, 'label_failure' AS action FROM ({_DEFAULTS})")
def default_rules_customer(spark, sf):
    rules = profile.default_rules(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"])
    rows = [(c["name"], c["data_type"], c["failure_handling"]["action"]) for c in rules["columns"]]
    return spark.createDataFrame(rows, "column_name string, data_type string, action string")


# --- sinks -------------------------------------------------------------------------------------


@query(f"""SELECT CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS t, amount FROM
   (SELECT CASE c_custkey % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN '-5' WHEN 2 THEN '@x' WHEN 3 THEN '+1' ELSE c_name END AS t, c_acctbal AS amount FROM customer)""")
def escape_formulas_customer(spark, sf):
    text = F.expr("CASE c_custkey % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN '-5' WHEN 2 THEN '@x' WHEN 3 THEN '+1' ELSE c_name END")
    return sinks.escaped(table(spark, sf, "customer").select(text.alias("t"), F.col("c_acctbal").alias("amount")))


_LOW = "coalesce(priority = '5-LOW', false)"
_ORPHAN = "coalesce(custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0), false)"


@query(f"""SELECT 'clean' AS name, count(*) AS n FROM {DUCK_ORDERS} WHERE priority IS NOT NULL AND NOT {_LOW} AND NOT {_ORPHAN}
   UNION ALL SELECT 'quarantine', count(*) FROM {DUCK_ORDERS} WHERE {_LOW} OR {_ORPHAN}
   UNION ALL SELECT 'low', count(*) FROM {DUCK_ORDERS} WHERE {_LOW} UNION ALL SELECT 'orphans', count(*) FROM {DUCK_ORDERS} WHERE {_ORPHAN}""")
def written_outputs_orders(spark, sf):
    held = table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    report = validate(dirty_orders(spark, sf), ACTION_RULES, held, row_key=["o_orderkey"])
    path = scratch_path(spark, "outputs")
    parts = [
        csv_source.read_csv(spark, f"{path}/{name}", encoding="utf-8").rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name.removeprefix("named/")).alias("name"), "n")
        for name in sinks.write_outputs(report.split(), path)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN priority IS NULL OR {_LOW} OR {_ORPHAN} OR coalesce(custkey > 1200, false) OR o_orderkey % 3 = 2
   THEN 'FAIL' ELSE 'PASS' END AS status FROM {DUCK_ORDERS}) GROUP BY status""")
def written_labels_orders(spark, sf):
    held = table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    report = validate(dirty_orders(spark, sf), ACTION_RULES, held, row_key=["o_orderkey"])
    path = scratch_path(spark, "labels")
    sinks.write_labeled(report, path)
    back = csv_source.read_csv(spark, f"{path}/labeled", encoding="utf-8").rows
    return back.groupBy(F.col("__dq_status__").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 'summary' AS name, 1::BIGINT AS n UNION ALL SELECT 'test_results', {len(_CONDITIONS)} UNION ALL SELECT 'column_results', 5
   UNION ALL SELECT 'blocking_errors', 1 UNION ALL SELECT 'diff', 1 UNION ALL SELECT 'column_diffs', 2
   UNION ALL SELECT 'cell_errors', ({" + ".join(f"count(*) FILTER (WHERE f{i})" for i in range(len(_CONDITIONS)))})::BIGINT FROM {_FLAGGED}
   UNION ALL SELECT 'sample_changes', least(100, count(*)) + least(100, count(*) FILTER (WHERE {_SEG_CHANGED})) FROM {DUCK_CUSTOMER}""")
def written_report_orders(spark, sf):
    path = scratch_path(spark, "report")
    cleaning = clean(dirty_customer(spark, sf), CLEAN_RULES, ["c_custkey"])
    names = sinks.write_report(order_report(spark, sf), path, cleaning)
    out = None
    for n in names:
        one = spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- row ids and streams -----------------------------------------------------------------------


@query("SELECT count(*) AS n, count(*) AS distinct_positions, 0::BIGINT AS first, count(*) - 1 AS last FROM lineitem")
def dense_row_ids_lineitem(spark, sf):
    rows = order.dense_row_id(order.with_row_id(table(spark, sf, "lineitem").select("l_orderkey")))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("__row_no").alias("distinct_positions"),
        F.min("__row_no").alias("first"),
        F.max("__row_no").alias("last"),
    )


@query("""SELECT event_type, count(*) FILTER (WHERE value > 50 OR value < 1 OR event_type NOT IN ('click', 'view', 'purchase')) AS failing,
   count(*) AS n FROM events GROUP BY event_type""")
def label_stream_events(spark, sf):
    rules = {
        "columns": [
            {"name": "value", "data_type": "float", "tests": [{"type": "range", "params": {"min": 1, "max": 50}}], "failure_handling": {"action": "label_failure"}},
            {"name": "event_type", "tests": [{"type": "enum", "params": {"allowed_values": ["click", "view", "purchase"]}}], "failure_handling": {"action": "label_failure"}},
        ]
    }
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    job = label_stream(stream, rules, ["event_id"]).writeStream.format("parquet").option("checkpointLocation", state)
    job.trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("event_type").agg(F.count_if(F.col("__dq_status__") == "FAIL").alias("failing"), F.count(F.lit(1)).alias("n"))
