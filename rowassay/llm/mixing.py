"""Mix sources to target weights with hash thresholds.

A document's place is a hash of its id. Tokens are summed by source and hash bucket, the bucket
in which a source's budget ends is split again and again until it holds one hash value, and the
documents below that value are taken. Nothing is sorted; every pass after the first reads a
narrow table of (source, hash, size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowassay.llm.shared import WORD, measured, partitions
from rowassay.session import durable

HASH_BITS = 60
STEP_BITS = 10
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def place(id_column: str) -> Column:
    """60 bits of the MD5 of the id as text; of the empty text for a null id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def words(text_column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Weights repeat over the sources in code point order, null last. A target above most times
    its source's size stops there and the others share the excess by weight.
    """
    count = partitions(sizes.sparkSession)
    dealt = durable(sizes.repartitionByRange(count, F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last()))
    before = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, total = [], 0
    for part in sorted(before):
        starts.append((part, total))
        total += before[part]
    spark = sizes.sparkSession
    starts = spark.createDataFrame(starts, "__part int, __start long")
    rank = F.col("__start") + own - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    named = durable(dealt.join(F.broadcast(starts), "__part").select("source", "source_size", weight.alias("weight")))
    budget = share * (named.agg(F.sum("source_size")).first()[0] or 0)
    capped, level = F.lit(False), 0.0
    while True:
        row = named.select(capped.alias("c"), "weight", "source_size").agg(
            F.sum(F.when(~F.col("c"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("c"), F.col("source_size"))).alias("s")
        ).first()
        if not row["w"]:
            break
        reached = (budget - most * (row["s"] or 0)) / row["w"]
        if reached == level:
            break
        level = reached
        capped = F.lit(level) * F.col("weight") > most * F.col("source_size")
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return named.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per source: source, source_size, target, whole, bound.

    Every document is taken `whole` times, and once more if its place is below bound. Of the two
    prefixes around the rest of the budget the nearer one is chosen, the shorter if both are as near.
    """
    spark = docs.sparkSession
    narrow = durable(docs.select(F.col(source_column).cast("string").alias("source"), place(id_column).alias("h"), words(text_column).alias("size")))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = durable(state)
    open_ = sources.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    bounds = spark.createDataFrame([], "source string, bound long")
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        mark = measured(durable(open_.select(F.col("source").alias("__s"), "rest", "low", "before")))
        step = F.shiftright(F.col("h") - F.col("low"), bits)
        sums = (
            narrow.join(mark, F.col("source").eqNullSafe(F.col("__s")) & (F.col("h") >= F.col("low")) & (step < (1 << STEP_BITS)))
            .groupBy("source", "rest", "low", "before", step.alias("step"))
            .agg(F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))
        )
        running = F.sum("n").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        edge = sums.withColumn("upto", F.col("before") + running).where("upto > rest AND upto - n <= rest")
        edge = durable(edge.select("source", "rest", (F.col("low") + F.shiftleft("step", bits)).alias("low"), (F.col("upto") - F.col("n")).alias("before"), "upto", "first", "last"))
        nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
        bounds = bounds.unionByName(edge.where("first = last").select("source", (F.col("first") + nearer.cast("long")).alias("bound")))
        open_ = edge.where("first < last").select("source", "rest", "low", "before")
        if open_.isEmpty():
            break
    found = bounds.select(F.col("source").alias("__s"), "bound")
    return durable(
        sources.join(found, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "target", "whole", F.coalesce("bound", F.lit(0)).alias("bound"))
    )


def copies(docs: DataFrame, plan: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """The documents with __copies (0, 1, …), __source_size and __target of their source.

    A null source is a source; null ids share one place, and rows with one id are taken together.
    Documents without words have copies like others. An empty table stays empty.
    """
    marks = measured(plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("bound").alias("__bound")))
    joined = docs.join(marks, F.col(source_column).cast("string").eqNullSafe(F.col("__source")), "left")
    return joined.withColumn("__copies", F.col("__whole") + (place(id_column) < F.col("__bound")).cast("int")).drop("__source", "__whole", "__bound")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null texts have no words, null sources are one source and null ids share one place. Rows with
    the same id have the same place and are taken together. An empty table gives no rows.
    """
    plan = mix_plan(docs, **options)
    id_column = options.get("id_column", "doc_id")
    source_column = options.get("source_column", "source")
    narrow = docs.select(F.col(id_column), F.col(source_column).alias("source"), words(options.get("text_column", "text")).alias("size"))
    return copies(narrow, plan, id_column, "source").select(
        id_column, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("size")).alias("taken")
    )


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5 AS budget,
    COALESCE(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under,
    sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over,
    row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS turn
  FROM w),
l AS (SELECT arg_min((budget - under)::DOUBLE / over::DOUBLE, turn) FILTER (WHERE (budget - under)::DOUBLE / over::DOUBLE * weight <= 2 * source_size) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * weight > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target FROM r, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own < rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
