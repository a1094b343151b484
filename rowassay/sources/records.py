"""Records of delimited files whose quoted fields hold line breaks, read in splits.

Whether a line begins a record depends on all lines before it, but only through one bit: is a quoted
field open? Each line is a function of that bit. Every file block is read as if it began outside and
as if it began inside quotes, which gives one such function per block; functions are chained over the
blocks of a file, and then each block is cut into records by itself. A record that crosses the edge of
a block is put together from its fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rowassay.operators import keys
from rowassay.session import durable

BLOCK = "file string, block long, lines long, end0 boolean, end1 boolean, starts0 long, starts1 long"
PIECE = "file string, block long, at long, record string, whole boolean"


def opening(sep: str) -> tuple[str, str]:
    """Patterns of lines that end inside quotes, if they begin outside and if they begin inside.

    A quote opens a field at its start only, two quotes inside are one, and what follows the closing
    quote up to the separator is plain. The patterns never go back, so long lines cost no stack.
    """
    if len(sep) != 1:
        raise ValueError("line breaks inside quotes need a separator of one character")
    if sep in '"\r\n':
        raise ValueError(f"{sep!r} is no separator")
    mark = "\\" + sep if re.match(r"[^\w\s]", sep) else sep
    other, inside = f"[^{mark}]*+", '[^"]*+(?:""[^"]*+)*+'
    fields = f'(?:(?:"{inside}"{other}|(?!"){other}){mark})*+'
    return rf'\A{fields}"{inside}\z', rf'\A{inside}(?:\z|"{other}{mark}{fields}"{inside}\z)'


def states(out: np.ndarray, in_: np.ndarray, start: bool) -> np.ndarray:
    """The bit before each line and after the last, from each line's bits after beginning outside and inside."""
    constant, swap = out == in_, out & ~in_
    place = np.arange(len(out))
    last = np.maximum.accumulate(np.where(constant, place, -1))
    swaps = np.cumsum(swap)
    base = np.where(last >= 0, out[last], start)
    return np.concatenate([[start], base ^ ((swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1)]).astype(bool)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, slice]]:
    """Lines of one file block after the other."""
    block = batch.column("block").to_numpy()
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
        if low < high:
            yield batch.column("file")[low].as_py(), int(block[low]), slice(low, high)


def _bits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out", "in_"))


def _block_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in BLOCK.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    held: list | None = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held, kinds, strict=True)], names=names)

    for batch in batches:
        out, in_ = _bits(batch)
        for file, block, part in _runs(batch):
            if held is None or held[:2] != [file, block]:
                if held is not None:
                    yield row()
                held = [file, block, 0, False, True, 0, 0]
            held[2] += part.stop - part.start
            for begun in (0, 1):
                found = states(out[part], in_[part], held[3 + begun])
                held[3 + begun] = bool(found[-1])
                held[5 + begun] += int((~found[:-1]).sum())
    if held is not None:
        yield row()


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block in order; `at` counts its records, -1 is the rest of one begun before.

    `whole` is false for such a rest and for a record that the block's end cuts.
    """
    place: tuple | None = None
    inside, at, lines = False, -1, []
    rows: list[tuple] = []

    def flush(whole: bool) -> None:
        if lines:
            rows.append((*place, at, "\n".join(lines), whole and at >= 0))

    def ready() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "block", "at", "record", "whole"])

    for batch in batches:
        out, in_ = _bits(batch)
        for file, block, part in _runs(batch):
            if place != (file, block):
                flush(not inside)
                place, inside, at, lines = (file, block), bool(batch.column("begun")[part.start].as_py()), -1, []
            found = states(out[part], in_[part], inside)
            for line, continued in zip(batch.column("line").slice(part.start, part.stop - part.start).to_pylist(), found[:-1].tolist(), strict=True):
                if continued:
                    lines.append(line)
                else:
                    flush(True)
                    at, lines = at + 1, [line]
            inside = bool(found[-1])
        yield ready()
        rows = []
    flush(not inside)
    yield ready()


class Records:
    """The records of some files, numbered in each file from 0; decoded adds the `line` to rows with its raw `value`."""

    def __init__(self, spark: SparkSession, path, sep: str, decoded):
        out, in_ = opening(sep)
        quoted = F.contains("line", F.lit('"'))
        lines = spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
        )
        lines = decoded(lines)
        # a line without a quote leaves the bit as it is
        self.lines = lines.select(
            "file", "block", "id", "line", (quoted & F.col("line").rlike(out)).alias("out"), (~quoted | F.col("line").rlike(in_)).alias("in_")
        )
        functions = self.lines.select("file", "block", "out", "in_").mapInArrow(_block_functions, BLOCK)
        before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        swap = (F.col("end0") & ~F.col("end1")).cast("int")
        swaps = F.coalesce(F.sum(swap).over(before), F.lit(0))
        chained = functions.withColumn("swaps", swaps)
        constant = F.when(F.col("end0") == F.col("end1"), F.struct("end0", "swaps"))
        chained = chained.withColumn("last", F.last(constant, ignorenulls=True).over(before))
        flips = (F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
        chained = chained.withColumn("begun", F.coalesce(F.col("last.end0"), F.lit(False)) != flips)
        chained = chained.withColumn("starts", F.when(F.col("begun"), F.col("starts1")).otherwise(F.col("starts0")))
        chained = chained.select(
            "file", "block", "begun", "starts",
            F.when(F.col("begun"), F.col("end1")).otherwise(F.col("end0")).alias("open"),
            F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("before"),
            F.sum("starts").over(W.partitionBy("file")).alias("records"),
            F.last(F.when(F.col("starts") > 0, F.col("block")), ignorenulls=True).over(before).alias("owner"),
        )
        # a checkpoint, since a cached table would be met again by a later read of the same, changed path
        self.blocks = keys.measure([durable(chained)], None)[0]
        found = self.blocks.table.agg(F.count_if("begun").alias("cut"), F.count_distinct("file").alias("files")).first()
        self.cut, self.files = found["cut"] > 0, found["files"]

    def select(self, wanted: Column | None = None) -> DataFrame:
        """(file, number, records, record); `wanted` is a condition on blocks that holds what is asked for.

        number counts a file's records and `records` is how many it has. Line ends inside quotes stay
        as they are; a carriage return at the end of a record goes.
        """
        blocks = self.blocks.table.select("file", "block", "begun")
        lines = self.lines
        if wanted is not None:
            blocks = self.blocks.table.where(wanted | F.col("begun") | F.col("open")).select("file", "block", "begun")
        if self.blocks.small:
            lines = lines.join(F.broadcast(blocks), ["file", "block"])
        else:  # the join loses the order of the lines
            lines = lines.join(blocks, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "id")
        pieces = lines.select("file", "block", "line", "out", "in_", "begun").mapInArrow(_assembled, PIECE)
        known = self.blocks.table.select("file", "block", "before", "records", "owner")
        pieces = pieces.join(F.broadcast(known) if self.blocks.small else known, ["file", "block"])
        numbered = pieces.withColumn("number", F.col("before") + F.col("at"))
        record = F.regexp_replace("record", "\r\\z", "")
        whole = numbered if not self.cut else numbered.where("whole")
        parts = [whole.select("file", "number", "records", record.alias("record"))]
        if self.cut:
            owner = F.when(F.col("at") < 0, F.col("owner")).otherwise(F.col("block"))
            torn = numbered.where("NOT whole").groupBy("file", owner.alias("block")).agg(
                F.max("number").alias("number"), F.first("records").alias("records"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts")
            )
            joined = torn.withColumn("record", F.array_join(F.col("parts.record"), "\n"))
            parts.append(joined.select("file", "number", "records", record.alias("record")))
        return reduce(DataFrame.unionByName, parts)
