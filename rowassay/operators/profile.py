"""Profiles of a table and its columns, and type proposals from a small ordered sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions import dates, numbers
from rowassay.functions.text import as_text, col, is_missing, strip
from rowassay.operators import keys, order
from rowassay.plans.rules import LONG_NULL_TOKENS

# Tokens the two type guesses read as booleans.
PROFILE_BOOLEANS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]
RULE_BOOLEANS = PROFILE_BOOLEANS + ["on", "off"]

# Boolean spellings in the order they are tried.
BOOLEAN_FORMATS = [
    ("true/false (text)", ["true", "false"], True),
    ("t/f (text)", ["t", "f"], True),
    ("1/0 (numeric)", ["1", "0"], True),
    ("yes/no (text)", ["yes", "no"], True),
    ("Y/N (text)", ["Y", "N", "y", "n"], False),
]
ANY_BOOLEAN = "Any standard format"

# At least so many first rows of a table are searched for samples of all columns at once.
HEAD_ROWS = 200


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(part * 100.0 / F.nullif(whole, F.lit(0)), F.lit(empty)).cast("double")


def _missing(df: DataFrame) -> dict[str, Column]:
    types = _types(df)
    return {n: is_missing(col(n), types[n]) for n in df.columns}


def table_summary(df: DataFrame, hash_first: bool | None = None) -> DataFrame:
    """Rows, columns, cells, nulls, and copies of rows after the first."""
    nulls = reduce(Column.__add__, [F.count_if(m) for m in _missing(df).values()], F.lit(0))
    surplus = keys.repeated(df, df.columns, hash_first).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("s"))
    extra = surplus.first()[0]
    width = F.lit(len(df.columns)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), nulls.cast("bigint").alias("nulls")).select(
        F.col("rows").alias("row_count"),
        width.alias("column_count"),
        (F.col("rows") * width).alias("total_cells"),
        F.col("nulls").alias("null_count"),
        F.round(_percent(F.col("nulls"), F.col("rows") * width), 2).alias("null_percent"),
        F.lit(extra).cast("bigint").alias("duplicate_row_count"),
    )


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, as rows (column_name, unique_count).

    One scan and one grouping serve all columns: values are told apart by 128 bits of hash, so
    long texts cost no more than numbers.
    """
    types, missing = _types(df), _missing(df)
    if approximate:
        parts = [
            F.struct(F.lit(n).alias("column_name"), F.approx_count_distinct(F.when(~m, col(n)), 0.01).alias("unique_count"))
            for n, m in missing.items()
        ]
        return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    cells = []
    for i, (n, m) in enumerate(missing.items()):
        value = col(n) + F.lit(0.0) if isinstance(types[n], (T.DoubleType, T.FloatType)) else col(n)  # -0.0 is 0.0
        halves = (F.xxhash64(value).alias("h"), F.xxhash64(F.lit(i), value).alias("g"))
        cells.append(F.when(~m, F.struct(F.lit(i).alias("i"), *halves)))
    long = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    counted = long.groupBy("i", "h", "g").agg(F.count(F.lit(1))).groupBy("i").agg(F.count(F.lit(1)).alias("unique_count"))
    names = df.sparkSession.createDataFrame(list(enumerate(missing)), "i int, column_name string")
    return names.join(counted, "i", "left").select("column_name", F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count"))


def column_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Null share, distinct values, min and max, warnings and health, one row per column."""
    types, missing = _types(df), _missing(df)
    numbered = list(enumerate(df.columns))
    asks = []
    for i, n in numbered:
        value = F.when(~missing[n], col(n))
        asks += [
            F.count_if(missing[n]).alias(f"n{i}"),
            as_text(F.min(value), types[n]).alias(f"lo{i}") if _sortable(types[n]) else F.lit(None).cast("string").alias(f"lo{i}"),
            as_text(F.max(value), types[n]).alias(f"hi{i}") if _sortable(types[n]) else F.lit(None).cast("string").alias(f"hi{i}"),
        ]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *asks).first()
    facts = [
        (i, n, types[n].simpleString(), seen["rows"], seen[f"n{i}"], seen[f"lo{i}"], seen[f"hi{i}"])
        for i, n in numbered
    ]
    schema = (
        "position int, column_name string, data_type string, total_values bigint, null_count bigint, "
        "min_value string, max_value string"
    )
    base = df.sparkSession.createDataFrame(facts, schema)
    filled = F.col("total_values") - F.col("null_count")
    stats = base.join(distinct_counts(df, approximate), "column_name").select(
        "position",
        "column_name",
        "data_type",
        "total_values",
        "null_count",
        _percent(F.col("null_count"), F.col("total_values")).alias("null_percent"),
        "unique_count",
        _percent(F.col("unique_count"), filled).alias("cardinality_percent"),
        "min_value",
        "max_value",
    )
    return _with_health(stats)


def _sortable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def _with_health(stats: DataFrame) -> DataFrame:
    null_share, unique, share = F.col("null_percent"), F.col("unique_count"), F.col("cardinality_percent")
    filled = F.col("total_values") - F.col("null_count")
    warnings = F.array_compact(
        F.array(
            F.when(null_share > 50, "high null rate").when(null_share > 20, "moderate null rate"),
            F.when((filled > 10) & (share > 95) & (unique > 100), "very high cardinality").when(
                (filled > 10) & (share < 1) & (unique < 5), "very low cardinality"
            ),
            F.when((unique == 1) & (filled > 0), "single value"),
        )
    )
    count = F.size("warnings")
    return (
        stats.withColumn("warnings", warnings)
        .withColumn(
            "health",
            F.when((F.round(null_share, 2) > 50) | (count >= 2), "critical")
            .when((F.round(null_share, 2) > 20) | (count >= 1), "warning")
            .otherwise("good"),
        )
        .withColumn("null_percent", F.round("null_percent", 2))
        .withColumn("cardinality_percent", F.round("cardinality_percent", 2))
    )


def completeness(df: DataFrame) -> DataFrame:
    """Filled share of every column, and of the table as column ``*``. An empty table is complete."""
    missing = _missing(df)
    got = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(m).alias(f"n{i}") for i, m in enumerate(missing.values())])
    rows = F.col("rows")

    def line(name, nulls, whole):
        return F.struct(
            F.lit(name).alias("column_name"),
            (whole - nulls).alias("non_null_count"),
            nulls.alias("null_count"),
            _percent(whole - nulls, whole, 100.0).alias("completeness"),
        )

    all_nulls = reduce(Column.__add__, [F.col(f"n{i}") for i in range(len(missing))], F.lit(0).cast("bigint"))
    lines = [line(n, F.col(f"n{i}"), rows) for i, n in enumerate(missing)]
    lines.append(line("*", all_nulls, rows * len(missing)))
    return got.select(F.inline(F.array(*lines)))


def null_counts(df: DataFrame) -> DataFrame:
    """Rows, columns and nulls per column, long form."""
    return completeness(df).where("column_name != '*'").select("column_name", "non_null_count", "null_count")


# --- guesses from a sample ---------------------------------------------------------------------


def _samples(df: DataFrame, names: list[str], order_by: list[str], size: int) -> DataFrame:
    """The first non-null values of every column as text, with rank: rows (column_name, rank, v).

    One pass finds the first rows of the table, which hold enough values of most columns. Each other
    column is gone through by itself. Tasks hold the first rows only, so nothing is sorted as a whole.
    """
    types, missing = _types(df), _missing(df)
    by, at = [col(o) for o in order_by], [f"__o{i}" for i in range(len(order_by))]
    spots = [c.alias(a) for c, a in zip(by, at)]
    texts = [F.when(~missing[n], as_text(col(n), types[n])).alias(f"__v{i}") for i, n in enumerate(names)]
    first = max(HEAD_ROWS, 2 * size)
    head = keys.measure([df.orderBy(*by).limit(first).select(*spots, *texts)], None)[0]
    enough = [True] * len(names)
    if head.rows == first:
        held = head.table.agg(*[F.count(f"__v{i}").alias(f"n{i}") for i in range(len(names))]).first()
        enough = [n >= size for n in held]
    cells = [F.struct(F.lit(n).alias("column_name"), F.col(f"__v{i}").alias("v")) for i, n in enumerate(names) if enough[i]]
    parts = []
    if cells:
        parts.append(head.table.select(*at, F.explode(F.array(*cells)).alias("__c")).select(*at, "__c.*").where("v IS NOT NULL"))
    for i, n in enumerate(names):
        if not enough[i]:
            filled = df.where(~missing[n]).orderBy(*by).limit(size)
            parts.append(filled.select(*spots, F.lit(n).alias("column_name"), as_text(col(n), types[n]).alias("v")))
    rows = reduce(DataFrame.unionByName, parts)
    return order.first_of(rows, ["column_name"], [F.col(a) for a in at], size).select("column_name", "rank", "v")


def _for_all(df: DataFrame, names: list[str], found: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """A row for every column, also for those without any value."""
    all_ = df.sparkSession.createDataFrame([(n,) for n in names], "column_name string")
    filled = [F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()]
    return all_.join(found, "column_name", "left").select("column_name", *filled)


def _ordered(df: DataFrame, order_by: list[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    names = list(df.columns)
    return (df, names, order_by) if order_by else (order.with_row_id(df), names, [order.ROW_ID])


def sample_values(df: DataFrame, order_by: list[str] | None = None, size: int = 5) -> DataFrame:
    """Distinct values among the first few of each column."""
    df, names, by = _ordered(df, order_by)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "v")))
    found = _samples(df, names, by, size).groupBy("column_name").agg(F.array_distinct(ranked["v"]).alias("samples"))
    none = df.sparkSession.createDataFrame([(n,) for n in names], "column_name string")
    return none.join(found, "column_name", "left").select(
        "column_name", F.coalesce("samples", F.array().cast("array<string>")).alias("samples")
    )


def _every(test: Column) -> Column:
    return F.coalesce(F.every(F.coalesce(test, F.lit(False))), F.lit(False))


def semantic_types(df: DataFrame, order_by: list[str] | None = None, size: int = 100) -> DataFrame:
    """The physical type, or for text what the first values look like."""
    return _guessed(df, order_by, size, _profile_guess, "unknown")


def rule_types(df: DataFrame, order_by: list[str] | None = None, size: int = 20) -> DataFrame:
    """The declared type to propose for each column."""
    return _guessed(df, order_by, size, _rule_guess, "text")


def _guessed(df, order_by, size, guess, nothing) -> DataFrame:
    """``guess`` gives the type a name and a physical type settle, None where values decide, or ""
    where any value confirms the physical type."""
    df, names, by = _ordered(df, order_by)
    types = _types(df)
    settled = {n: guess(n, types[n], None) for n in names}
    asked = [n for n in names if not settled[n]]
    if not asked:
        return df.sparkSession.createDataFrame(list(settled.items()), "column_name string, guessed string")
    seen = _samples(df, asked, by, size).groupBy("column_name").agg(guess("", T.StringType(), F.col("v")).alias("guessed"))
    confirmed = F.col("guessed")
    for n in asked:
        if settled[n] == "":
            confirmed = F.when(F.col("column_name") == n, F.lit(guess(n, types[n], "physical"))).otherwise(confirmed)
    found = _for_all(df, asked, seen.withColumn("guessed", confirmed), {"guessed": nothing})
    rest = [(n, t) for n, t in settled.items() if t]
    return found.unionByName(df.sparkSession.createDataFrame(rest, "column_name string, guessed string")) if rest else found


def _profile_guess(name: str, dtype: T.DataType, v):
    physical = _physical(dtype, decimal="float", moment="datetime")
    if v is None:
        return physical
    return (
        F.when(_every(F.lower(strip(v)).isin(PROFILE_BOOLEANS)), "boolean")
        .when(_every(numbers.to_double(v).isNotNull()), "numeric")
        .when(_every(dates.guess(v).isNotNull()), "date/datetime")
        .otherwise("string")
    )


def _rule_guess(name: str, dtype: T.DataType, v):
    if v is None:
        if "date" in name.lower():
            return "date"
        return "" if _physical(dtype, "float", "timestamp") else None
    if isinstance(v, str):
        return _physical(dtype, "float", "timestamp")
    whole = strip(F.translate(v, ",$%€£", "")).rlike(r"^-?\p{Nd}+$")
    return (
        F.when(_every(F.lower(strip(v)).isin(RULE_BOOLEANS)), "boolean")
        .when(_every(whole), "integer")
        .when(_every(numbers.to_double(v, ",$").isNotNull()), "float")
        .when(_every(dates.guess(v).isNotNull()), "date")
        .otherwise("text")
    )


def _physical(dtype: T.DataType, decimal: str, moment: str) -> str | None:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return decimal
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return moment
    return None


def percentage_columns(df: DataFrame, order_by: list[str] | None = None, size: int = 20) -> DataFrame:
    """Columns at least half of whose first values hold a percent sign."""
    df, names, by = _ordered(df, order_by)
    seen = _samples(df, names, by, size).groupBy("column_name").agg(
        (F.avg(F.col("v").contains("%").cast("int")) >= 0.5).alias("is_percentage"),
        F.bool_or(F.translate("v", "%", "").contains(".")).alias("dotted"),
    )
    return _for_all(df, names, seen, {"is_percentage": False, "dotted": False}).select(
        "column_name",
        "is_percentage",
        (F.col("is_percentage") & F.col("dotted")).alias("has_decimal"),
        F.when(~F.col("is_percentage"), "text").when(F.col("dotted"), "float").otherwise("integer").alias("suggested_type"),
    )


def boolean_formats(df: DataFrame, order_by: list[str] | None = None, size: int = 20) -> DataFrame:
    """The first boolean spelling that covers the first values of each column."""
    df, names, by = _ordered(df, order_by)
    text, out = strip(F.col("v")), None
    for label, tokens, loose in BOOLEAN_FORMATS:
        all_ = _every((F.lower(text) if loose else text).isin(tokens))
        out = F.when(all_, label) if out is None else out.when(all_, label)
    seen = _samples(df, names, by, size).groupBy("column_name").agg(out.alias("boolean_format"))
    return _for_all(df, names, seen, {"boolean_format": ANY_BOOLEAN})


def default_rules(df: DataFrame, ignored: list[str] = (), order_by: list[str] | None = None) -> dict:
    """A rule set with proposed types, default normalization and labels on failure."""
    kept = [c for c in df.columns if c not in set(ignored)]
    frame = df.select(*[col(c) for c in dict.fromkeys([*kept, *(order_by or [])])])
    guessed = {r["column_name"]: r["guessed"] for r in rule_types(frame, order_by).collect()}
    return {
        "columns": [
            {
                "name": n,
                "data_type": guessed[n],
                "required": False,
                "normalization": {
                    "trim_whitespace": True,
                    "null_tokens": list(LONG_NULL_TOKENS),
                    "case": "none",
                    "remove_non_printable": True,
                },
                "failure_handling": {"action": "label_failure", "label_column_name": "__dq_errors__"},
            }
            for n in kept
        ]
    }
