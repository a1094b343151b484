"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Shingles are ordered by an estimate of how many documents hold them, rarest first; documents that
link must share one of their first shingles. The estimate is a histogram of hash slots of fixed
size over all documents. Any order is right, a rarer one only meets less often.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowassay.llm.links import LEAST, connect, parts_of, shingles
from rowassay.llm.shared import components, measured, named, sliced, written
from rowassay.session import durable

SLOT_BITS = 20
BLOCK = 1 << 14
#: A bucket whose slot holds so many more documents than the mean slot is dealt to salted shares.
FREQUENT = 50_000
SALTS = 64


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space."""
    return (text or b"").lower().split()


def scan(docs: DataFrame) -> DataFrame:
    """First pass over id, text: rows (id, digest, n), and per task blocks of the slot histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
        for batch in sliced(batches):
            ids, digests, sizes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                items = shingles(words_of(text))
                np.add.at(slots, (items >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
                ids.append(key)
                digests.append(hashlib.md5(text or b"").hexdigest())
                sizes.append(len(items))
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        blocks = range(len(slots) // BLOCK)
        packed = [zlib.compress(slots[b * BLOCK : (b + 1) * BLOCK].tobytes(), 1) for b in blocks]
        none, share = [None] * len(packed), uuid.uuid4().int % 256
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.string()), pa.array(none, pa.int64()), pa.array([share] * len(packed), pa.int32()), pa.array(list(blocks), pa.int32()), pa.array(packed, pa.binary())], names=names)

    names = ["id", "digest", "n", "share", "block", "counts"]
    return docs.select("id", "text").mapInArrow(run, "id long, digest string, n long, share int, block int, counts binary")


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, dtype=np.uint64)
    for packed in rows["counts"]:
        total += np.frombuffer(zlib.decompress(packed), dtype=np.uint32)
    capped = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pd.DataFrame({"share": [rows["share"].iloc[0]], "block": [rows["block"].iloc[0]], "counts": [zlib.compress(capped.tobytes(), 1)]})


def histogram(scanned: DataFrame) -> np.ndarray:
    """Documents per hash slot; 4 MB, whatever the input. Summed in shares first, then by block."""
    blocks = scanned.where("block IS NOT NULL").select("share", "block", "counts")
    kind = "share int, block int, counts binary"
    shares = blocks.groupBy("share", "block").applyInPandas(_summed, kind)
    out = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
    for row in shares.groupBy("block").applyInPandas(_summed, kind).collect():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
    return out


def prefixes(docs: DataFrame, slots, least: int) -> DataFrame:
    """Second pass: the first |x| - ceil(least / 100 * |x|) + 1 shingles of each document, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = slots.value
        frequent = counts.mean() + FREQUENT
        for batch in sliced(batches):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                items = shingles(words_of(text))
                n = len(items)
                if not n:
                    continue
                held = counts[(items >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                first = np.argsort(held, kind="stable")[: n + 1 + (-least * n) // 100]
                salt = np.where(held[first] > frequent, 1 + key % SALTS, 0)
                for to, x in zip(columns, (items[first].view(np.int64), salt, np.full(len(first), key), np.full(len(first), n), np.arange(1, len(first) + 1)), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "salt", "node", "size", "pos"])

    return docs.select("id", "text").mapInArrow(run, "bucket long, salt int, node long, size int, pos int")


def sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(words_of(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([parts_of(x) for x in found], pa.list_(pa.int32()))], names=["node", "items", "parts"]
            )

    return docs.select("id", "text").mapInArrow(run, "node long, items array<long>, parts array<int>")


def join_documents(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links).

    Documents without words have no shingles and link with nothing. Equal texts are one text, joined
    by its smallest id. Rows that share an id are one vertex, each with the size of its own text;
    rows with a null id take no part and have a null component_id. An empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    scanned, _ = written(scan(source), "jaccard-scan")
    slots = docs.sparkSession.sparkContext.broadcast(histogram(scanned))
    rows = scanned.where("block IS NULL")
    full = rows.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("id").alias("low"))
    copies = durable(full.join(classes, "digest").where("id > low").select("id", "digest", "low").distinct())
    away = measured(copies.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
    distinct = source.where("id IS NOT NULL").join(away, (F.col("id") == F.col("__id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("__digest")), "left_anti")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return sets(distinct.join(measured(nodes.withColumnRenamed("node", "id")), "id", "left_semi"))

    found = connect(prefixes(distinct, slots, least), sets_of, least, "jaccard")
    joined = components(found.unionByName(copies.select(F.col("id").alias("a"), F.col("low").alias("b"))))
    out = rows.select("id", "n").join(joined, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(a) < 5 THEN array_to_string(a, ' ') ELSE array_to_string(a[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.node WHERE r.low < l.a),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.node = w.doc_id
"""


def one_of_each(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, without those that a smaller id of their group stands for.

    Rows that share an id are one document, of which the row with the smallest text stays. Rows with
    a null id stay, and so do documents without words. Texts move only for ids that are there more
    than once. An empty table stays empty.
    """
    found = durable(join_documents(docs, least, id_column, text_column))
    away = found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("__id")).distinct()
    own = F.col(id_column).cast("long")
    kept = docs.join(measured(durable(away)), own == F.col("__id"), "left_anti")
    twice = measured(durable(found.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id")))
    rows = kept.join(twice, own == F.col("__id"), "left_semi")
    first = rows.groupBy(own.alias("__id")).agg(F.min_by(F.struct(*named(docs.columns)), F.struct(F.col(text_column), F.xxhash64(*named(docs.columns)))).alias("r")).select("r.*")
    return kept.join(twice, own == F.col("__id"), "left_anti").unionByName(first)
