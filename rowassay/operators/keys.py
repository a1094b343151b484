"""Work on groups of equal keys that holds when one key owns a large share of the rows.

Groups are always counted first. A count combines on the map side, so a hot key costs one row
per map task. Facts about keys are then attached to rows by ``attach``, which broadcasts a
measured small table and otherwise joins with hot keys salted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions.text import col

BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 48 << 20
ROWS_PER_SALT = 1_000_000
# Rows are counted by slots of the key's hash; their number bounds what is broadcast.
SLOTS = 1 << 16


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its row count ``__n``; nulls are keys like any other."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))


def short(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The rows with a column for each text of the key, the key's names with those, and their names.

    They hold texts under 32 bytes as they are and the SHA-256 digest of longer ones, so equal
    entries are equal texts. Texts of other collations keep their own equality and stay.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    new, names = {}, []
    for k in keys:
        if types[k] in (T.StringType(), T.BinaryType()):
            raw = col(k).cast("binary")
            name = f"__d{len(new)}"
            new[name] = F.when(F.octet_length(raw) < 32, raw).otherwise(F.unhex(F.sha2(raw, 256)))
            names.append(name)
        else:
            names.append(k)
    return df.withColumns(new) if new else df, names, list(new)


def repeated(
    df: DataFrame, keys: list[str], hash_first: bool | None = None, held: list[DataFrame] | None = None
) -> DataFrame:
    """Keys that occur more than once.

    Wide keys (text, or more than four columns) are counted by a 64-bit hash first. If few hashes
    repeat they are broadcast, and only rows under them are shuffled whole and counted by the keys
    themselves, so hash clashes do no harm. If many repeat, all keys are counted directly.
    """
    frame = df.select(*[col(k) for k in keys])
    if hash_first is None:
        text = (T.StringType, T.BinaryType)
        hash_first = len(keys) > 4 or any(isinstance(f.dataType, text) for f in frame.schema.fields)
    if hash_first:
        hashed = frame.withColumn("__h", F.xxhash64(*[col(k) for k in keys]))
        suspects = (
            hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h")
        )
        seen = measure([suspects], None, held)[0]
        if seen.small:
            frame = hashed.join(F.broadcast(seen.table), "__h", "left_semi").drop("__h")
        else:
            seen.table.unpersist()
    return group_sizes(frame, keys).where("__n > 1")


@dataclass
class Measured:
    """A table with one row per key, kept for reuse, and what one pass over it found."""

    table: DataFrame
    rows: int
    size: int
    top: int  # rows of the data under the most frequent key
    total: int  # rows of the data under any key
    most: int | None = None  # rows of the data under its most frequent key, listed here or not; None if not known

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.size <= BROADCAST_BYTES


_unowned: list[DataFrame] = []


def release(tables: list[DataFrame] | None = None) -> None:
    """Drop persisted key tables: the given ones, or those of operators used without a report."""
    for t in _unowned if tables is None else tables:
        t.unpersist()
    if tables is None:
        _unowned.clear()


def measure(
    tables: list[DataFrame], weight: str | None = "__n", held: list[DataFrame] | None = None
) -> list[Measured]:
    """Persist key tables and measure all of them in a single job.

    Each is needed again by the join that follows, so the grouping behind it runs once. ``held``
    is the owner's list of what to release.
    """
    if not tables:
        return []
    kept = [t.persist(StorageLevel.MEMORY_AND_DISK) for t in tables]
    (_unowned if held is None else held).extend(kept)
    parts = []
    for i, t in enumerate(kept):
        width = sum(
            (F.coalesce(F.octet_length(col(f.name)), F.lit(0)) + 16
             if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16))
            for f in t.schema.fields
        )
        top, total = (F.max(col(weight)), F.sum(col(weight))) if weight else (F.lit(0), F.lit(0))
        parts.append(
            t.agg(
                F.lit(i).alias("i"),
                F.count(F.lit(1)).alias("rows"),
                F.coalesce(F.sum(width), F.lit(0)).cast("bigint").alias("size"),
                F.coalesce(top, F.lit(0)).cast("bigint").alias("top"),
                F.coalesce(total, F.lit(0)).cast("bigint").alias("total"),
            )
        )
    found = {r["i"]: r for r in reduce(DataFrame.unionByName, parts).collect()}
    return [Measured(t, *found[i][1:]) for i, t in enumerate(kept)]


def hot_slots(df: DataFrame, keys: list[str]) -> DataFrame:
    """(__slot, __salts) of hash slots that hold far more rows than the mean one: at most SLOTS rows.

    Any key of the table counts, matched or not, and nulls like any other value.
    """
    sizes = df.groupBy(slot_of([col(k) for k in keys]).alias("__slot")).agg(F.count(F.lit(1)).alias("__c"))
    total = sizes.agg(F.sum("__c")).first()[0] or 0
    surplus = F.col("__c") - F.lit(total // SLOTS)
    return sizes.where(surplus > ROWS_PER_SALT).select("__slot", F.ceil(surplus / ROWS_PER_SALT).cast("int").alias("__salts"))


def slot_of(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def attach(
    df: DataFrame,
    keys: list[str],
    table: DataFrame | Measured,
    payload: list[str],
    table_keys: list[str] | None = None,
    weight: str | None = "__n",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left-join ``payload`` of a table with one row per key; null keys match null keys.

    ``weight`` names the table column that says how many rows of ``df`` carry the key. ``counted``
    has the same rows, or more, with the keys and fewer joins behind it; hot keys are looked for there, so
    that a chain of joins is not run again at each link, and not at all where ``most`` says there are none.
    """
    seen = table if isinstance(table, Measured) else measure([table], weight)[0]
    types = {f.name: f.dataType for f in seen.table.schema.fields}
    if seen.rows == 0:
        return df.select("*", *[F.lit(None).cast(types[p]).alias(p) for p in payload])
    names = [f"__k{i}" for i in range(len(keys))]
    side = seen.table.select(
        *[col(t).alias(n) for t, n in zip(table_keys or keys, names)],
        *[col(p) for p in payload],
        *([F.col(weight).alias("__w")] if weight else []),
    )
    match = [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    spare = [*names, "__w"]
    if seen.small:
        side = F.broadcast(side)
    elif seen.most is None or seen.most > ROWS_PER_SALT:
        hot = F.broadcast(hot_slots(df if counted is None else counted, keys))
        salts = F.coalesce(F.col("__salts"), F.lit(1))
        side = (
            side.withColumn("__slot", slot_of([F.col(n) for n in names]))
            .join(hot, "__slot", "left")
            .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            .drop("__slot", "__salts")
        )
        # a salt follows from the row and its partition, so a task that runs again deals alike
        deal = F.xxhash64(*[col(c) for c in df.columns if _hashable(df.schema[c].dataType)], F.spark_partition_id())
        df = (
            df.withColumn("__slot", slot_of([col(k) for k in keys]))
            .join(hot, "__slot", "left")
            .withColumn("__rowsalt", F.pmod(deal, salts).cast("int"))
            .drop("__slot", "__salts")
        )
        match.append(F.col("__rowsalt") == F.col("__salt"))
        spare += ["__rowsalt", "__salt"]
    return df.join(side, reduce(Column.__and__, match), "left").drop(*spare)


def _hashable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def mark(
    df: DataFrame, keys: list[str], bad: DataFrame | Measured, flag: str, table_keys: list[str] | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Add a boolean that is true on rows whose key is listed in ``bad``."""
    seen = bad if isinstance(bad, Measured) else measure([bad])[0]
    seen = replace(seen, table=seen.table.withColumn(flag, F.lit(True)))
    marked = attach(df, keys, seen, [flag], table_keys, counted=counted)
    return marked.withColumn(flag, F.coalesce(col(flag), F.lit(False)))


def missing_keys(
    df: DataFrame, key: str, reference: DataFrame, reference_key: str, owner: list[DataFrame] | None = None
) -> DataFrame:
    """Non-null keys of ``df``, with their row counts, that the reference does not hold.

    A small reference is broadcast and only the missing rows are grouped. Otherwise both sides are
    reduced to one row per key before they meet, so no key can be hot.
    """
    held = reference.select(col(reference_key).alias("__r")).where("__r IS NOT NULL").distinct()
    seen = measure([held], None, owner)[0]
    present = df.where(col(key).isNotNull()).select(col(key))
    absent = col(key) == F.col("__r")
    if seen.small:
        return group_sizes(present.join(F.broadcast(seen.table), absent, "left_anti"), [key])
    return group_sizes(present, [key]).join(seen.table, absent, "left_anti")
