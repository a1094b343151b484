"""Registry of the driver's queries. Each has a Spark form and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowassay.operators.order import ROW_ID, with_row_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Views with injected faults, in SQL both dialects read alike.
DIRTY_ORDERS = """
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS custkey,
    CASE WHEN o_orderkey % 3 = 0 THEN {iso}
         WHEN o_orderkey % 3 = 1 THEN {us}
         ELSE 'not-a-date' END AS day_text,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Y' WHEN o_orderkey % 4 = 1 THEN ' no '
         WHEN o_orderkey % 4 = 2 THEN 'TRUE' ELSE 'maybe' END AS flag_text
  FROM orders"""
DIRTY_CUSTOMER = """
  SELECT c_custkey, c_name, c_nationkey, c_acctbal,
    CASE WHEN c_custkey % 11 = 0 THEN 'N/A'
         WHEN c_custkey % 7 = 0 THEN '  ' || c_mktsegment || ' '
         WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment)
         ELSE c_mktsegment END AS segment,
    CASE WHEN c_custkey % 6 = 0 THEN 'x@' WHEN c_custkey % 6 = 1 THEN 'a b@c.org'
         ELSE 'user' || CAST(c_custkey AS {text}) || '@mail.example.org' END AS email
  FROM customer"""
DIRTY_LINES = """
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_returnflag,
    CASE WHEN l_linenumber = 1 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {text})
         WHEN l_linenumber = 2 THEN '(' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {text}) || ')'
         WHEN l_linenumber = 3 THEN 'n.a.'
         ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {text}) END AS price_text,
    CASE WHEN l_linenumber = 4 THEN CAST(CAST(l_quantity AS INTEGER) AS {text}) || '.0'
         WHEN l_linenumber = 5 THEN '1,' || CAST(CAST(l_quantity AS INTEGER) AS {text})
         ELSE CAST(CAST(l_quantity AS INTEGER) AS {text}) END AS quantity_text,
    CAST(CAST(l_discount * 100 AS INTEGER) AS {text}) || '%' AS discount_text
  FROM lineitem"""

_SPARK = {"iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "us": "date_format(o_orderdate, 'MM/dd/yyyy')", "text": "STRING"}
_DUCK = {"iso": "strftime(o_orderdate, '%Y-%m-%d')", "us": "strftime(o_orderdate, '%m/%d/%Y')", "text": "VARCHAR"}

DUCK_ORDERS = f"({DIRTY_ORDERS.format(**_DUCK)})"
DUCK_CUSTOMER = f"({DIRTY_CUSTOMER.format(**_DUCK)})"
DUCK_LINES = f"({DIRTY_LINES.format(**_DUCK)})"


def _view(sql: str, name: str):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(
            sql.format(**_SPARK).replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf, name)
        )

    return build


dirty_orders = _view(DIRTY_ORDERS, "orders")
dirty_customer = _view(DIRTY_CUSTOMER, "customer")
dirty_lines = _view(DIRTY_LINES, "lineitem")


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty lines with row numbers from the scan itself."""
    source = with_row_id(table(spark, sf, "lineitem"))
    sql = DIRTY_LINES.format(**_SPARK).replace("SELECT l_orderkey", f"SELECT {ROW_ID}, l_orderkey")
    return spark.sql(sql.replace("FROM lineitem", "FROM {source}"), source=source)


def doubled_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with every seventh order twice."""
    o = table(spark, sf, "orders")
    return o.unionByName(o.where("o_orderkey % 7 = 0"))


DUCK_DOUBLED = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 7 = 0)"


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
