"""Repeated keys of any number of key lists, counted in one shuffle.

Every row gives one entry per list: the list's number and 128 bits that stand for the key. One
whole number, date or time is kept as it is, and one or two columns of 64 bits at most are scrambled
without loss; other keys are hashed. Entries are counted together. Keys whose hashes repeat are then compared as they are, all lists in one more grouping that reads only
rows under repeated hashes; a list in which two keys share a hash is counted again by its columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions.text import col
from rowassay.operators import keys

LIST, FIRST, SECOND, MISSING = "__list", "__h1", "__h2", "__m"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
# 64 bits at most, which xxhash64 of one value maps to 64 bits one to one
_FIXED = (*_WHOLE, T.DateType, T.TimestampType, T.TimestampNTZType, T.FloatType, T.DoubleType)


@dataclass
class Repeated:
    """The keys of one list that occur more than once."""

    names: list[str]
    seen: keys.Measured  # keyed by the numbers, or by the columns
    stand_in: dict[str, Column] | None  # the numbers of a row by their names; None where keyed by the columns
    missing: int  # rows under repeated keys that are missing values

    def mark(self, frame: DataFrame, flag: str, counted: DataFrame | None = None) -> DataFrame:
        """Add a boolean that is true on rows with a repeated key; ``counted``: the rows before any joins."""
        if self.seen.rows == 0:
            return frame.withColumn(flag, F.lit(False))
        if self.stand_in is None:
            return keys.mark(frame, self.names, self.seen, flag, counted=counted)
        names = list(self.stand_in)
        counted = None if counted is None else counted.withColumns(self.stand_in)
        return keys.mark(frame.withColumns(self.stand_in), names, self.seen, flag, names, counted).drop(*names)

    def filled(self) -> DataFrame:
        """Repeated keys that are no missing value, with their row counts."""
        return self.seen.table.where(~F.col(MISSING))


def fixed(df: DataFrame, names: list[str]) -> bool:
    """Whether the values of one or two columns take 64 bits each at most."""
    return len(names) <= 2 and all(isinstance(df.schema[n].dataType, _FIXED) for n in names)


def stand_in(df: DataFrame, names: list[str]) -> tuple[Column, Column, bool]:
    """Two numbers for a key, and whether they are the key itself; of two columns, that is for keys with the same nulls."""
    kind = df.schema[names[0]].dataType if len(names) == 1 else None
    c = col(names[0])
    number = c.cast("bigint") if isinstance(kind, _WHOLE) else F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c) if isinstance(kind, T.TimestampType) else None
    if number is not None:
        return F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint")), c.isNull().cast("bigint"), True
    if fixed(df, names):
        return F.xxhash64(c), c.isNull().cast("bigint") if len(names) == 1 else F.xxhash64(col(names[1])), True
    return *hashes([col(n) for n in names]), False


def hashes(key: list[Column]) -> tuple[Column, Column]:
    # a null leaves a hash as it is, so which columns are null is hashed as well
    whole = [*key, *[c.isNull() for c in key]]
    return F.xxhash64(*whole), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - 2**64), *whole)


def _entries(df: DataFrame, entries: list[list[Column]]) -> DataFrame:
    if len(entries) == 1:
        return df.select(*entries[0])
    return df.select(F.explode(F.array(*[F.struct(*e) for e in entries])).alias("e")).select("e.*")


def repeated_lists(df: DataFrame, lists: list[tuple[list[str], Column | None]], held: list[DataFrame]) -> list[Repeated]:
    """Repeated keys of each list of columns; nulls are keys like any other.

    The second part of a list says which keys are missing values. ``held`` gets what to release.
    """
    if not lists:
        return []
    known = [stand_in(df, names) for names, _ in lists]
    # where two columns stand for themselves, which of them are null makes lists of their own
    paired = [len(names) == 2 and exact for (names, _), (*_, exact) in zip(lists, known, strict=True)]
    nulls = [col(names[0]).isNull().cast("int") + 2 * col(names[1]).isNull().cast("int") if pair else None for (names, _), pair in zip(lists, paired, strict=True)]
    number = [F.lit(i) if n is None else F.lit(i) + n * len(lists) for i, n in enumerate(nulls)]
    own_list = F.col(LIST) % len(lists)
    entries = [
        [number[i].alias(LIST), first.alias(FIRST), second.alias(SECOND), (F.lit(False) if missing is None else missing).alias(MISSING)]
        for i, ((first, second, _), (_, missing)) in enumerate(zip(known, lists, strict=True))
    ]
    # rows that are kept are read once per list, so that a task holds the keys of one list only
    every = reduce(DataFrame.unionByName, [df.select(*e) for e in entries]) if df.is_cached else _entries(df, entries)
    groups = every.groupBy(LIST, FIRST, SECOND).agg(F.count(F.lit(1)).alias("__n"), F.max(MISSING).alias(MISSING)).where("__n > 1")
    table = groups.persist(StorageLevel.MEMORY_AND_DISK)
    held.append(table)
    found = {
        r[LIST]: r
        for r in table.groupBy(own_list.alias(LIST)).agg(
            F.count(F.lit(1)).alias("rows"), F.max("__n").alias("top"), F.sum("__n").alias("total"), F.sum(F.when(F.col(MISSING), F.col("__n")).otherwise(0)).alias("missing")
        ).collect()
    }  # a row per list
    shared = _shared_hashes(df, table, {i: names for i, ((names, _), k) in enumerate(zip(lists, known, strict=True)) if i in found and not k[2]}, known, found)
    out = []
    for i, ((names, missing), (first, second, _)) in enumerate(zip(lists, known, strict=True)):
        if i in shared:
            own = keys.repeated(df, names, hash_first=False).withColumn(MISSING, F.lit(False) if missing is None else missing)
            seen = keys.measure([own], held=held)[0]
            gone = seen.table.where(F.col(MISSING)).agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
            out.append(Repeated(names, seen, None, gone))
        else:
            r = found.get(i)
            rows, top, total, gone = (r["rows"], r["top"], r["total"], r["missing"]) if r else (0, 0, 0, 0)
            part = table.where(own_list == i) if paired[i] else table.where(F.col(LIST) == i).drop(LIST)
            numbers = {**({LIST: number[i]} if paired[i] else {}), FIRST: first, SECOND: second}
            out.append(Repeated(names, keys.Measured(part, rows, (9 + 8 * len(numbers)) * rows, top, total, max(top, 1)), numbers, gone))
    return out


def _shared_hashes(df: DataFrame, table: DataFrame, hashed: dict[int, list[str]], known: list, found: dict) -> set[int]:
    """Lists in which keys that differ have the same hashes."""
    if not hashed:
        return set()
    slots = [(i, n) for i, names in hashed.items() for n in names]
    entries = []
    for i in hashed:
        own = [(col(n) if j == i else F.lit(None).cast(df.schema[n].dataType)).alias(f"s{k}") for k, (j, n) in enumerate(slots)]
        entries.append([F.lit(i).alias(LIST), known[i][0].alias(FIRST), known[i][1].alias(SECOND), *own])
    rows = _entries(df, entries)
    if sum(found[i]["rows"] for i in hashed) <= keys.BROADCAST_ROWS:
        rows = rows.join(F.broadcast(table.select(LIST, FIRST, SECOND)), [LIST, FIRST, SECOND], "left_semi")
    # by column: numbers are then compared in hash tables, and only texts are sorted
    each = [(F.col(f"s{k}"), F.count(f"s{k}")) for k in range(len(slots))]
    differ = reduce(Column.__or__, [~F.min(c).eqNullSafe(F.max(c)) | ((n > 0) & (n < F.count(F.lit(1)))) for c, n in each])
    clashes = rows.groupBy(LIST, FIRST, SECOND).agg(differ.alias("differ")).where("differ").select(LIST).distinct()
    return {r[LIST] for r in clashes.collect()}
