"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors are one vector with a weight. In each table the vectors of a bucket are compared by
matrix products of bounded blocks: a large bucket is cut into blocks, and each pair of blocks is a
unit of its own. A pair that meets in several tables counts in the first. Units return counts of
links and at most one edge per vector, so a group of near copies never becomes a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowassay.llm.shared import components
from rowassay.session import durable

#: A pair at cosine 0.95 agrees in a table with probability (1 - acos(0.95) / pi) ** BITS = 0.28,
#: and meets in none of the tables with probability 0.0004.
TABLES = 24
BITS = 12
LEAST = 0.95
BLOCK = 1024
#: Rows of small buckets that are gathered into one unit.
UNIT_ROWS = 20_000


def hyperplanes(size: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TABLES * BITS, size))


def _usable(vector: list | None) -> bool:
    return bool(vector) and all(x is not None for x in vector) and bool(np.isfinite(v := np.array(vector, dtype=np.float64)).all()) and bool((v != 0).any())


def signatures(vectors: DataFrame) -> DataFrame:
    """id, vector -> id, data (the components as doubles), signs (a bucket number per table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(BITS)
        for batch in batches:
            ids, data, signs = [], [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not _usable(vector):
                    continue
                v = np.array(vector, dtype=np.float64)
                v = v / np.abs(v).max()  # squares of very large or small components stay finite
                if len(v) not in planes:
                    planes[len(v)] = hyperplanes(len(v))
                bits = (planes[len(v)] @ v >= 0).reshape(TABLES, BITS)
                ids.append(key)
                data.append(v.tobytes())
                signs.append((bits @ powers).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(signs, pa.binary())], names=["id", "data", "signs"])

    return vectors.mapInArrow(run, "id long, data binary, signs binary")


def compare(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links inside the buckets of one unit: node, links (weights of linked vectors), low (the smallest node reached)."""
    signs = np.frombuffer(b"".join(rows["signs"]), dtype="<i2").reshape(len(rows), TABLES)
    ids, weights = rows["node"].to_numpy(), rows["weight"].to_numpy()
    tables, side = rows["table"].to_numpy(), rows["side"].to_numpy()
    size = np.array([len(x) for x in rows["data"]])
    bucket = signs[np.arange(len(rows)), tables].astype(np.int64)
    order = np.lexsort((ids, bucket, tables, size))
    change = np.flatnonzero(np.diff(size[order]) | np.diff(tables[order]) | np.diff(bucket[order])) + 1
    links = np.zeros(len(rows), dtype=np.int64)
    low = ids.copy()
    for group in np.split(order, change):
        if len(group) < 2:
            continue
        x = np.frombuffer(b"".join(rows["data"].iloc[group]), dtype=np.float64).reshape(len(group), -1)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        near = x @ x.T >= least
        for before in range(int(tables[group[0]])):
            if near.any():
                near &= signs[group, before][:, None] != signs[group, before][None, :]
        np.fill_diagonal(near, False)
        if side[group].any():  # two blocks of one bucket: only pairs across them
            near &= side[group][:, None] != side[group][None, :]
        linked = near.any(axis=1)
        if not linked.any():
            continue
        near, group = near[linked][:, linked], group[linked]
        links[group] = near @ weights[group]
        label = ids[group]
        while True:  # the smallest node reachable inside the unit
            reached = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (reached == label).all():
                break
            label = reached
        low[group] = label
    found = links > 0
    return pd.DataFrame({"node": ids[found], "links": links[found], "low": low[found], "table": tables[found]})


def near_vectors(vectors: DataFrame, least: float = LEAST, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing,
    nor do vectors of different lengths. Equal vectors link with each other. Rows that share an id
    are one vertex of the graph, each with the links of its own vector; a null id takes no part: its
    n_links is 0, its component_id null and kept false.
    """
    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    signed = durable(signatures(source.where("id IS NOT NULL")).withColumn("class", F.xxhash64("data")))
    distinct = durable(signed.groupBy("class", "data", "signs").agg(F.min("id").alias("node"), F.count("*").alias("weight")))
    number = distinct.count()
    tabled = distinct.select("class", "node", "weight", "data", "signs", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("table"))
    at = F.col("table") * 2 + 1
    tabled = tabled.withColumn("bucket", F.hex(F.substring(F.col("signs"), at, F.lit(2))))
    sizes = tabled.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = durable(sizes.select(F.col("table").alias("__t"), F.col("bucket").alias("__b"), blocks.alias("blocks")))
    met = tabled.join(sizes, (F.col("table") == F.col("__t")) & (F.col("bucket") == F.col("__b"))).drop("__t", "__b")
    units = max(1, number * TABLES // UNIT_ROWS)
    own = F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks").cast("long")).cast("int")
    small = met.where("blocks = 1").withColumn("unit", F.concat(F.lit("p"), F.pmod(F.xxhash64("table", "bucket"), F.lit(units)))).withColumn("side", F.lit(0))
    large = met.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws("-", "table", "bucket", F.least("own", "other"), F.greatest("own", "other"))
    large = large.withColumn("unit", pair).withColumn("side", (F.col("own") > F.col("other")).cast("int") + 2 * (F.col("own") < F.col("other")).cast("int"))
    rows = small.select("unit", "class", "weight", "data", "signs", "table", "side").unionByName(large.select("unit", "class", "weight", "data", "signs", "table", "side"))
    rows = rows.withColumnRenamed("class", "node")
    found = durable(rows.groupBy("unit").applyInPandas(lambda x: compare(x, least), "node long, links long, low long, table int"))
    degree = found.groupBy(F.col("node").alias("class")).agg(F.sum("links").alias("near"))
    representative = distinct.select("class", "node", "weight")
    other = representative.select(F.col("class").alias("low"), F.col("node").alias("b"))
    edges = found.select(F.col("node").alias("class"), "low").where("class <> low").distinct().join(representative, "class").join(other, "low").select(F.col("node").alias("a"), "b")
    members = signed.join(representative, "class")
    joined = components(edges.unionByName(members.select(F.col("id").alias("a"), F.col("node").alias("b"))))
    per_id = members.join(degree, "class", "left").select("id", "class", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    good = per_id.join(joined, F.col("id") == F.col("node"), "left").select("id", "n_links", F.coalesce("component", "id").alias("component_id"))
    rest = source.join(signed.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = good.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return both.select(F.col("id").alias(id_column), "n_links", "component_id", "kept")


NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings),
g AS (SELECT * FROM v WHERE isfinite(n) AND n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(a.n) / sqrt(b.n) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.node WHERE r.low < l.a),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""
