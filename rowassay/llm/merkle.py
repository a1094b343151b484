"""Merkle manifest of a table: a postorder log of nodes, and proofs read from it by address.

Every source is a tree of arity 3 over its rows in order; the roots of the sources are the leaves of
one more tree. A tree is cut into aligned blocks of 3^6 leaves. The builder of a block hashes a node
as soon as its last child is there and appends it to the block's segment of the log, so nodes stand
in postorder. Where a node stands follows from its level and index alone: the sizes of the complete
subtrees before it are known in closed form. Proofs are read from the segments by such addresses.
The roots of the blocks are the leaves of the next blocks, until one node is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowassay.llm.shared import measured, partitions
from rowassay.session import durable

ARITY = 3
#: Levels of a block; of 3^6 leaves the log is about 35 KB.
LEVELS = 6
#: Bytes of a digest.
DIGEST = 32
#: Rows with a path of digests, at most about 2 KB each, that may be broadcast once they are counted.
PATHS = 20_000


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of the digests' lowercase hex texts, one after the other."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def levels(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    n, count = leaves, 0
    while n > 1:
        n, count = -(-n // ARITY), count + 1
    return count


def subtree(level: int, index: int, leaves: int) -> int:
    """Nodes of the subtree of a node: ceil(m / 3^t) on each level t, m its leaves."""
    m = min((index + 1) * ARITY**level, leaves) - index * ARITY**level
    return sum(-(-m // ARITY**t) for t in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder of its tree: complete subtrees before it, then its own nodes."""
    first = index * ARITY**level
    before, size = 0, 1
    while size <= first:
        before += first // size
        size *= ARITY
    return before + subtree(level, index, leaves) - 1


def appended(leaves: list[bytes], height: int) -> list[bytes]:
    """The nodes of one block in completion order."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(height + 1)]

    def complete(level: int, node: bytes) -> None:
        log.append(node)
        if level < height:
            open_[level].append(node)
            if len(open_[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        complete(level + 1, digest(run))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(height):  # runs that the end of the leaves cuts short
        if open_[level]:
            close(level)
    return log


def run_of(index: int, count: int) -> range:
    """The nodes that are hashed together with this one, itself included; count nodes on the level."""
    first = index - index % ARITY
    return range(first, min(first + ARITY, count))


def siblings(log: bytes, index: int, leaves: int, height: int) -> list[bytes]:
    """Digests beside the way from a leaf to the block's root, each found by its address."""
    found = []
    for level in range(height):
        count = -(-leaves // ARITY**level)
        for other in run_of(index, count):
            if other != index:
                at = DIGEST * position(level, other, leaves)
                found.append(log[at : at + DIGEST])
        index //= ARITY
    return found


def folded(node: bytes, index: int, count: int, beside: Iterator[bytes]) -> bytes:
    """The root of a tree of count leaves, from one leaf and its siblings."""
    while count > 1:
        node = digest([node if i == index else next(beside) for i in run_of(index, count)])
        index, count = index // ARITY, -(-count // ARITY)
    return node


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns: `-` for null, else byte count, `:`, value. As 32 bytes."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(part(c) for c in columns)), 256))


def tree_key(source: Column) -> Column:
    """Text without nulls in the order of the sources: null first, then UTF-8 bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds __index and __count: place and number of rows in each __tree, by the order, gapless.

    Rows are dealt into ranges of tree and order, so a large tree is split over many tasks, and
    numbered by the counts of the ranges before them. The ranges are a checkpoint.
    """
    count = partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(count, "__tree", *order).sortWithinPartitions("__tree", *order)
    dealt = durable(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy("__tree", part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(
        counts.select(
            F.col("__tree").alias("__t"), F.col("__part"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
            F.sum("__n").over(Window.partitionBy("__tree")).alias("__count"),
        )
    )
    met = dealt.join(measured(starts), (F.col("__tree") == F.col("__t")) & (part == F.col("__part")))
    return met.withColumn("__index", F.col("__start") + F.col("__at") - F.col("__first")).drop("__at", "__t", "__part", "__first", "__start")


def built(rows: DataFrame, carried: list[str], per: int = LEVELS) -> DataFrame:
    """One row per block: __tree, __block, __count, __log, __root, and lists of the carried columns in leaf order.

    rows: __tree, __index, __count (leaves of the tree), __digest. per: levels of a block.
    """
    spec = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "__tree string, __block long, __count long, __log binary, __root binary" + "".join(f", `{c}` array<{spec[c]}>" for c in carried)

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("__index")
        total = table.column("__count")[0].as_py()
        log = appended(table.column("__digest").to_pylist(), min(per, levels(total)))
        lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in carried]
        columns = [pa.array([k.as_py()], t) for k, t in zip(key, (pa.string(), pa.int64()), strict=True)]
        columns += [pa.array([total], pa.int64()), pa.array([b"".join(log)], pa.binary()), pa.array([log[-1]], pa.binary()), *lists]
        return pa.Table.from_arrays(columns, names=["__tree", "__block", "__count", "__log", "__root", *carried])

    blocks = rows.withColumn("__block", F.floor(F.col("__index") / F.lit(ARITY**per)).cast("long"))
    read = dict.fromkeys(["__tree", "__block", "__index", "__count", "__digest", *carried])
    return durable(blocks.select(*read).groupBy("__tree", "__block").applyInArrow(build, schema))


def grown(blocks: DataFrame, per: int = LEVELS) -> list[DataFrame]:
    """All storeys of blocks, the given ones first, until every tree has one root."""
    storeys = [blocks]
    while True:
        higher = storeys[-1].where(F.col("__count") > ARITY**per)
        if higher.isEmpty():
            return storeys
        above = (F.floor((F.col("__count") - 1) / F.lit(ARITY**per)) + 1).cast("long")
        storeys.append(built(higher.select("__tree", F.col("__block").alias("__index"), above.alias("__count"), F.col("__root").alias("__digest")), [], per))


def roots(storeys: list[DataFrame], per: int = LEVELS) -> DataFrame:
    """(__tree, __root) of every tree."""
    found = [s.where(F.col("__count") <= ARITY**per).select("__tree", "__root") for s in storeys]
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def _split(raw: bytes) -> list[bytes]:
    return [raw[i : i + DIGEST] for i in range(0, len(raw), DIGEST)]


def extracted(blocks: DataFrame, above: DataFrame, per: int = LEVELS) -> DataFrame:
    """(__tree, __index, __path) of every leaf of the blocks; above: __tree, __block, __over, the siblings beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, count, log, over in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leaves = min(ARITY**per, count - block * ARITY**per)
                height = min(per, levels(count))
                paths = [b"".join(siblings(log, i, leaves, height)) + over for i in range(leaves)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * leaves, pa.string()), pa.array(range(block * ARITY**per, block * ARITY**per + leaves), pa.int64()), pa.array(paths, pa.binary())],
                    names=["__tree", "__index", "__path"],
                )

    met = blocks.select("__tree", "__block", "__count", "__log").join(measured(above, PATHS), ["__tree", "__block"])
    return met.select("__tree", "__block", "__count", "__log", "__over").mapInArrow(run, "__tree string, __index long, __path binary")


def beyond(storeys: list[DataFrame], over: DataFrame, per: int = LEVELS) -> DataFrame:
    """(__tree, __block, __over) of the lowest blocks, from over: __tree, __over of whole trees."""
    top = None
    for k in range(len(storeys) - 1, -1, -1):
        whole = storeys[k].where(F.col("__count") <= ARITY**per).select("__tree", "__block").join(measured(over, PATHS), "__tree")
        found = whole.select("__tree", "__block", "__over")
        if top is not None:
            paths = extracted(storeys[k + 1], top, per)
            found = found.unionByName(paths.select("__tree", F.col("__index").alias("__block"), F.col("__path").alias("__over")))
        top = durable(found)
    return top


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, id_column: str = "doc_id", columns: tuple[str, ...] = ("source", "lang", "n_chars", "text"), source_column: str = "source", per: int = LEVELS) -> DataFrame:
    """The lowest storey of a table's log: a row per block of rows, in `__tree`s by source.

    A block holds its segment of nodes, and the ids, leaves and changed leaves of its rows. tampered
    says how changed rows would read, as expressions by column name; rows that stay have null there.
    """
    changes = tampered or {}
    now = [F.col(id_column), *(F.col(c) for c in columns)]
    then = [changes.get(id_column, F.col(id_column)), *(changes.get(c, F.col(c)) for c in columns)]
    differs = F.lit(False)
    for before, after in zip(now, then, strict=True):
        differs = differs | ~before.eqNullSafe(after)
    other = F.when(differs, leaf_digest(*then))
    # digests are a checkpoint, so the texts are read once; dealing into ranges reads its input twice
    rows = durable(docs.select(F.col(id_column).alias("__id"), tree_key(F.col(source_column)).alias("__tree"), leaf_digest(*now).alias("__digest"), other.alias("__other")))
    return built(numbered(rows, "__id", "__digest"), ["__id", "__digest", "__other"], per)


def proofs(log: DataFrame, per: int = LEVELS) -> DataFrame:
    """One row per row of the table: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A proof holds the siblings from the leaf to the source's root and on to the table's. It is folded
    with the changed leaf where the row has one, with its own leaf otherwise.
    """
    kind = log.schema["__id"].dataType.elementType.simpleString()
    storeys = grown(log, per)
    subroots = durable(roots(storeys, per).select(F.lit("").alias("__tree"), F.col("__tree").alias("__name"), F.col("__root").alias("__digest")))
    sources = durable(numbered(subroots, "__name"))
    top = grown(built(sources, ["__name"], per), per)
    root = [r["__root"] for r in roots(top, per).collect()]  # one row, none if the table is empty
    paths = extracted(top[0], beyond(top, top[0].select("__tree", F.lit(b"").alias("__over")).distinct(), per), per)
    named = sources.select("__index", "__name", F.col("__digest").alias("__subroot"), F.col("__count").alias("__sources"))
    named = durable(named.join(paths.select("__index", F.col("__path").alias("__over")), "__index").withColumnRenamed("__index", "__source"))
    over = beyond(storeys, named.select(F.col("__name").alias("__tree"), "__over"), per)
    over = durable(over.join(measured(named.withColumnRenamed("__name", "__tree").drop("__over"), PATHS), "__tree"))
    whole = root[0] if root else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                block, count, log, over, subroot, source, sources = (row.column(c)[0].as_py() for c in ("__block", "__count", "__log", "__over", "__subroot", "__source", "__sources"))
                leaves, others = (row.column(c)[0].as_py() for c in ("__digest", "__other"))
                height = min(per, levels(count))
                rest = _split(over)
                out: list[tuple] = []
                for i, (leaf, other) in enumerate(zip(leaves, others, strict=True)):
                    way = siblings(log, i, len(leaves), height) + rest
                    beside = iter(way)
                    found = folded(other or leaf, block * ARITY**per + i, count, beside)
                    found = folded(found, source, sources, beside)
                    out.append((leaf.hex(), subroot.hex(), whole.hex(), digest(way).hex(), found.hex(), found == whole))
                columns = [pa.array(c, pa.bool_() if n == "verified" else pa.string()) for n, c in zip(names[1:], zip(*out, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([row.column("__id").flatten(), *columns], names=names)

    met = log.join(measured(over, PATHS), ["__tree", "__block"])
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return met.select("__block", "__count", "__log", "__over", "__subroot", "__source", "__sources", "__id", "__digest", "__other").mapInArrow(run, schema)


def tampering(id_column: str = "doc_id", text_column: str = "text") -> dict[str, Column]:
    """Line ends gone from the text of rows whose decimal id has an even CRC-32; null ids stay."""
    even = F.crc32(F.col(id_column).cast("string").cast("binary")) % 2 == 0
    return {text_column: F.when(even, F.replace(F.col(text_column), F.lit("\n"), F.lit(""))).otherwise(F.col(text_column))}


def audit(docs: DataFrame, per: int = LEVELS) -> DataFrame:
    """Leaf, roots, proof and check of every document, some of them tampered with.

    Null ids come first in a source and are never tampered with; null sources are one source, the
    first. Repeated ids are ordered by their leaves, repeated rows have equal leaves and places of
    their own. Any text, however long, is one leaf. An empty table gives no rows.
    """
    return proofs(manifest(docs, tampering(), per=per), per).withColumnRenamed("id", "doc_id")


MANIFEST_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1 AS even
  FROM documents),
h AS (SELECT doc_id, source, even, sha256(a || b || c || e || t) AS leaf, sha256(a || b || c || e || u) AS other FROM (
  SELECT doc_id, source, even,
    COALESCE(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS a, COALESCE(strlen(source) || ':' || source, '-') AS b,
    COALESCE(strlen(lang) || ':' || lang, '-') AS c, COALESCE(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS e,
    COALESCE(strlen(text) || ':' || text, '-') AS t,
    COALESCE(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS u FROM d)),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM l GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM tree WHERE len(nodes) > 1),
s AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS i FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM s HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM top WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
runs AS (
  SELECT l.source, l.i AS leaf_i, t.level, l.i // (3 ** t.level)::BIGINT AS j, t.nodes FROM l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
  UNION ALL
  SELECT l.source, l.i, 1000 + t.level, s.i // (3 ** t.level)::BIGINT, t.nodes FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source, top t WHERE len(t.nodes) > 1),
way AS (SELECT source, leaf_i, level, array_to_string(nodes[j - j % 3 + 1:j], '') AS before, array_to_string(nodes[j + 2:j - j % 3 + 3], '') AS after FROM runs),
proof AS (SELECT source, leaf_i, sha256(string_agg(before || after, '' ORDER BY level)) AS proof, list({'b': before, 'a': after} ORDER BY level) AS steps FROM way GROUP BY ALL),
fold AS (
  SELECT l.source, l.i, CASE WHEN even THEN other ELSE leaf END AS node, 1 AS step, COALESCE(steps, []) AS steps FROM l LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf_i = l.i
  UNION ALL
  SELECT source, i, sha256(steps[step].b || node || steps[step].a), step + 1, steps FROM fold WHERE step <= len(steps))
SELECT l.doc_id, l.leaf, s.subroot, r.root, COALESCE(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN fold f ON f.source IS NOT DISTINCT FROM l.source AND f.i = l.i AND f.step > len(f.steps)
LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf_i = l.i, r
"""
