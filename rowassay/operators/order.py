"""Row identity and order-sensitive work without a one-task window."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from rowassay.functions.numbers import is_numeric, to_double
from rowassay.functions.text import col, is_missing
from rowassay.session import durable

ROW_ID = "__row_id"
# 2**18 rows per slice
_SLICE_BITS = 18


def with_row_id(df: DataFrame, name: str = ROW_ID, settle: bool = False) -> DataFrame:
    """A unique id that rises in scan order.

    An id that is there already stays. It repeats exactly when the input is a plain file scan. ``settle`` writes the numbered rows
    to the checkpoint folder, for inputs whose rows may move between partitions on a retry.
    """
    if name in df.columns:
        return df
    numbered = df.withColumn(name, F.monotonically_increasing_id())
    return durable(numbered) if settle else numbered


def dense_row_id(df: DataFrame, row_id: str = ROW_ID, name: str = "__row_no") -> DataFrame:
    """Positions 0..n-1 from ``with_row_id``. One row per input partition is summed up."""
    part = F.shiftright(col(row_id), 33)
    sizes = df.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = col(row_id).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        df.withColumn("__p", part)
        .join(starts, "__p")
        .withColumn(name, F.col("__start") + inside)
        .drop("__p", "__start")
    )


def first_of(df: DataFrame, groups: list[str], by: list[Column], limit: int) -> DataFrame:
    """The first rows of each group with their ``rank``.

    Spark applies a rank limit of up to 1000 (spark.sql.optimizer.windowGroupLimitThreshold) inside
    each task before the shuffle, so a group of any size sends only its candidates. A higher limit
    needs that setting raised to stay as cheap.
    """
    window = W.partitionBy(*groups).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def _sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``__slice``: slices follow the order, and no slice holds a large share of the rows."""
    if order == [ROW_ID]:
        # ids count up within an input partition, so their upper bits are runs of rows in order
        return df.withColumn("__slice", F.shiftright(col(ROW_ID), _SLICE_BITS))
    # Range bounds come from a sample, so the split is written down before it is used twice.
    return durable(
        df.repartitionByRange(*[col(o) for o in order]).withColumn("__slice", F.spark_partition_id())
    )


def _breaks(prev: Column, cur: Column, dtype: T.DataType, rising: bool, strict: bool) -> Column:
    """True when ``cur`` may not follow ``prev``; numbers if both parse, else text order."""

    def bad(a, b):
        worse = b < a if rising else b > a
        return (worse | (a == b)) if strict else worse

    if is_numeric(dtype):
        return bad(prev, cur)
    a, b = to_double(prev.cast("string"), ","), to_double(cur.cast("string"), ",")
    numeric = a.isNotNull() & b.isNotNull()
    return F.when(numeric, ~F.isnan(a) & ~F.isnan(b) & bad(a, b)).otherwise(
        bad(prev.cast("string"), cur.cast("string"))
    )


def monotonic_breaks(
    df: DataFrame, value: str, order: list[str], direction: str = "increasing", strict: bool = False, same: str | None = None
) -> DataFrame:
    """Rows (order columns and value) that break the order against the previous non-null value.

    Neighbours inside a slice are compared by a window over the slice. Each slice also gives its
    first and last row; those few rows are compared across the slice edges. ``same`` names one more
    column: the rows with a value at that position, which all lie in one slice.
    """
    rising = direction in ("increasing", "ascending")
    dtype = df.schema[value].dataType
    rows = df.select(*[col(o) for o in order], col(value).alias("__v"))
    rows = _sliced(rows.where(~is_missing(F.col("__v"), dtype)), order)
    by = [col(o) for o in order]
    prev = F.lag("__v").over(W.partitionBy("__slice").orderBy(*by))
    rows, kept = rows.withColumn("__prev", prev), []
    if same:
        # sorted by position already: no shuffle and no sort of its own
        rows, kept = rows.withColumn(same, F.count(F.lit(1)).over(W.partitionBy("__slice", *by))), [F.col(same)]
    inner = rows.where(
        F.col("__prev").isNotNull() & _breaks(F.col("__prev"), F.col("__v"), dtype, rising, strict)
    )
    whole = F.struct(*by, F.col("__v"), *kept)
    edges = rows.groupBy("__slice").agg(F.min(whole).alias("__first"), F.max(whole).alias("__last"))
    # one row per slice
    edges = edges.withColumn("__prev", F.lag("__last").over(W.orderBy("__slice"))).where("__prev IS NOT NULL")
    outer = edges.where(
        _breaks(F.col("__prev.__v"), F.col("__first.__v"), dtype, rising, strict)
    ).select("__first.*")
    keep = by if value in order else [*by, F.col("__v").alias(value)]
    return inner.select(*by, "__v", *kept).unionByName(outer).select(*keep, *kept)


def rows_at_breaks(
    df: DataFrame, value: str, order: list[str], flag: str, direction: str, strict: bool, held: list[DataFrame]
) -> tuple[DataFrame, int]:
    """The rows with a boolean: true at positions where ``monotonic_breaks`` finds a row; and how many are true.

    The value may not be missing, and equal positions are equal rows. Rows are sorted once and kept with
    what was found; slice edges are compared afterwards. ``held`` gets what to release: the rows are
    not to be read after that, since other slices would then be cut.
    """
    rising = direction in ("increasing", "ascending")
    dtype = df.schema[value].dataType
    by = [col(o) for o in order]
    inside, here = W.partitionBy("__slice").orderBy(*by), W.partitionBy("__slice", *by)
    rows = df.repartitionByRange(*by).withColumn("__slice", F.spark_partition_id())
    rows = rows.withColumns({"__prev": F.lag(col(value)).over(inside), "__last": F.lead(F.lit(1)).over(inside).isNull()})
    bad = F.col("__prev").isNotNull() & _breaks(F.col("__prev"), col(value), dtype, rising, strict)
    rows = rows.withColumns({flag: F.coalesce(bad, F.lit(False)), "__first": F.col("__prev").isNull()}).drop("__prev")
    # sorted by position already: no shuffle and no sort of its own
    rows = rows.withColumns({flag: F.max(flag).over(here), "__first": F.max("__first").over(here)})
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    held.append(rows)
    first, last = F.col("__first"), F.col("__last")
    counts = rows.groupBy("__slice").agg(F.count_if(flag).alias("inside"), F.count_if(first & ~col(flag)).alias("edge")).collect()  # a row per slice
    edges = rows.where(first | last).groupBy("__slice").agg(
        F.first(F.when(first, col(value)), True).alias("__v"), F.first(F.when(last, col(value)), True).alias("__end")
    )
    # one row per slice
    edges = edges.withColumn("__prev", F.lag("__end").over(W.orderBy("__slice"))).where("__prev IS NOT NULL")
    cut = {r[0] for r in edges.where(_breaks(F.col("__prev"), F.col("__v"), dtype, rising, strict)).select("__slice").collect()}
    marked = rows.withColumn(flag, col(flag) | (first & F.col("__slice").isin(sorted(cut)))) if cut else rows
    found = sum(r["inside"] + (r["edge"] if r["__slice"] in cut else 0) for r in counts)
    return marked.drop("__slice", "__first", "__last"), found
