"""Helpers of the corpus operators: cut lineage, measured broadcasts, components, ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowassay.session import durable, scratch_path

#: A side with at most this many rows of two numbers (about 32 MB in memory) may be broadcast.
BROADCAST_ROWS = 500_000

#: Python's bytes.split() and this class agree: words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows a Python task works on at once, …
SLICE = 1000
#: … and their bytes, unless one row alone is larger.
SLICE_BYTES = 4 << 20
#: Rows Spark hands to a Python worker at once, while a pipeline writes its stages.
BATCH_ROWS = 1000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so what a task builds from them stays small.

    Workers outlive their tasks: memory that a task has freed goes back to the system at its end.
    """
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from _halved(batch.slice(at, rows))
    finally:
        released()


def _halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > SLICE_BYTES:
        half = batch.num_rows // 2
        yield from _halved(batch.slice(0, half))
        yield from _halved(batch.slice(half))
    else:
        yield batch


def released() -> None:
    """Give freed memory back, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Spark cuts its Arrow batches at so many rows inside the block; the setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a compressed table in the shared folder, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def emptied(spark: SparkSession, *paths: str) -> None:
    """Free the disk of written tables that nothing reads any more."""
    for path in paths:
        spark.createDataFrame([], "dropped int").write.mode("overwrite").parquet(path)


def measured(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed narrow table, marked for broadcast if its counted rows stay within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): one row (node, component).

    component is the smallest node reachable. Alternates large-star and small-star steps; each
    step is one grouping and one join, its result a checkpoint. The number of rounds grows with
    the logarithm of the longest chain. Nodes without edges, and null ends, give no row.
    """
    pairs = durable(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        pairs = durable(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def ranked(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds __rank: 0, 1, … within each key, in the given order, without one task for a hot key.

    Rows are dealt by key and hash of the order columns; each share is ranked by itself and moved
    by the counts of the shares before it, so a rank is unique and gapless, and stable as long as
    the order columns tell rows apart.
    """
    shares = partitions(df.sparkSession)
    dealt = df.withColumn("__share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    counts = dealt.groupBy(key, "__share").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("__k"), F.col("__share").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(key, "__share").orderBy(*order))
    local = dealt.withColumn("__own", own)
    return (
        local.join(starts, (F.col(key).eqNullSafe(F.col("__k"))) & (F.col("__share") == F.col("__s")), "left")
        .withColumn("__rank", F.col("__start") + F.col("__own") - 1)
        .drop("__share", "__own", "__k", "__s", "__start")
    )


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as bytes, the bytes of one weight side by side, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)
