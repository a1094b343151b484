"""Links between sets that meet in buckets, without listing all pairs of a group.

Sets meet where they share a bucket (a prefix shingle, a MinHash band). In each round every bucket
offers one pivot and only pairs with the pivot are verified; sets that are connected by then need
no further test among themselves. The last round verifies every pair that still meets in a bucket
and is neither connected nor tested, so the components are those of all links.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowassay.llm.shared import components, emptied, measured, written
from rowassay.session import durable

#: Two sets link if LEAST * |union| <= 100 * |intersection|.
LEAST = 75
PARTS = 16
#: Rounds with pivots; all that is left is verified after them.
ROUNDS = 1
#: Sets of a bucket that are compared at once, and postings of small buckets in one unit.
BLOCK = 512
UNIT_ROWS = 20_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that any bits of a hash can be used as a bucket."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole list if it is shorter."""
    import xxhash

    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    value = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(value)]
    value = mixed(value)
    value.sort()
    return value[np.concatenate([[True], value[1:] != value[:-1]])]


def parts_of(items: np.ndarray) -> list[int]:
    """How many items fall in each of PARTS ranges of the hash."""
    return np.bincount((items >> np.uint64(60)).astype(np.int64), minlength=PARTS).tolist()


def needed(a: Column, b: Column, least: int) -> Column:
    """The smallest intersection with which sets of these sizes link."""
    return F.ceil(least * (a + b) / (100 + least))


def meeting(postings: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Keeps the postings of buckets with two nodes or more. salt > 0 marks buckets of very frequent items.

    Frequent buckets are counted in salted shares and kept anyway, so no task holds all of one.
    """
    share = Window.partitionBy("bucket", "salt")
    met = postings.withColumns({"__low": F.min("node").over(share), "__high": F.max("node").over(share)})
    return written(met.where("__low < __high OR salt > 0").select("bucket", "node", "size", "pos"), name)


def fits(least: int) -> Column:
    """Length and positional filter of a pair a, b that meets in a bucket."""
    small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    reach = 1 + F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    return (100 * small >= least * large) & (reach >= needed(F.col("a_size"), F.col("b_size"), least))


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that link. Suffix filter first: ranges of the hash bound the intersection."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = sets.join(measured(durable(ids)), "node", "left_semi")
    narrow = own.select("node", F.size("items").alias("n"), "parts")
    a = narrow.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("parts").alias("ap"))
    b = narrow.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("parts").alias("bp"))
    both = pairs.join(a, "a").join(b, "b")
    apart = F.aggregate(F.zip_with("ap", "bp", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    open_ = durable(both.where(apart <= F.col("an") + F.col("bn") - 2 * needed(F.col("an"), F.col("bn"), least)).select("a", "b"))
    items_a = own.select(F.col("node").alias("a"), F.col("items").alias("ai"))
    items_b = own.select(F.col("node").alias("b"), F.col("items").alias("bi"))
    met = open_.join(items_a, "a").join(items_b, "b")
    common = F.size(F.array_intersect("ai", "bi"))
    return durable(met.select("a", "b", common.alias("c"), (F.size("ai") + F.size("bi")).alias("s")).where(100 * F.col("c") >= least * (F.col("s") - F.col("c"))).select("a", "b"))


def _ends(side: str, row: str | None = None) -> list[Column]:
    return [F.col(f"{row}.{c}" if row else c).alias(f"{side}_{c}") for c in ("node", "size", "pos")]


def _pairs(met: DataFrame, least: int, tested: DataFrame | None) -> DataFrame:
    found = met.where(fits(least)).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    return durable(found if tested is None else found.join(tested, ["a", "b"], "left_anti"))


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a block, by products of membership matrices."""
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, [at, at + columns])
        member = np.zeros((len(sets), columns), dtype=np.float32)
        member[row[lo:hi], place[lo:hi] - at] = 1
        out += member @ member.T
    return out


def linked(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """Links inside the buckets of one unit: of each node one edge to the smallest node reached."""
    nodes, comps, side = rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["side"].to_numpy()
    items = rows["items"].tolist()
    bucket = rows["bucket"].to_numpy()
    order = np.lexsort((nodes, bucket))
    edges: list[tuple[int, int]] = []
    for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(group) < 2:
            continue
        sizes = np.array([len(items[i]) for i in group])
        common = overlaps([items[i] for i in group])
        near = (100 * common >= least * (sizes[:, None] + sizes[None, :] - common)) & (comps[group][:, None] != comps[group][None, :])
        if side[group].any():  # two blocks of one bucket: only pairs across them
            near &= side[group][:, None] != side[group][None, :]
        if not near.any():
            continue
        label = nodes[group]
        while True:
            reached = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (reached == label).all():
                break
            label = reached
        edges += [(a, b) for a, b in zip(nodes[group].tolist(), label.tolist(), strict=True) if a != b]
    return pd.DataFrame(sorted(set(edges)), columns=["a", "b"])


def linked_in_blocks(state: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """All links between components inside the buckets, without a row per pair.

    Buckets of up to BLOCK nodes are gathered into units; a larger one is cut into blocks, and each
    pair of blocks is a unit, so a task holds two blocks at most.
    """
    sizes = state.groupBy("bucket").agg(F.count("*").alias("n"))
    cut = sizes.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = state.join(cut, "bucket").join(sets.select("node", "items"), "node")
    units = max(1, state.count() // UNIT_ROWS)
    small = rows.where("blocks = 1").select(F.concat(F.lit("p"), F.pmod(F.xxhash64("bucket"), F.lit(units))).alias("unit"), "bucket", "node", "comp", "items", F.lit(0).alias("side"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks").cast("long")).cast("int")
    large = rows.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.concat_ws("-", "bucket", F.least("own", "other"), F.greatest("own", "other"))
    side = (F.col("own") > F.col("other")).cast("int") + 2 * (F.col("own") < F.col("other")).cast("int")
    both = small.unionByName(large.select(unit.alias("unit"), "bucket", "node", "comp", "items", side.alias("side")))
    return durable(both.groupBy("unit").applyInPandas(lambda x: linked(x, least), "a long, b long").distinct())


def connect(postings: DataFrame, sets_of, least: int = LEAST, name: str = "links", blocks: bool = False) -> DataFrame:
    """Links that span the components of all linked sets: rows (a, b).

    postings: bucket, salt, node, size, pos (from 1). sets_of(nodes) returns node, items, parts of
    the given nodes. blocks: the last round compares the sets of each bucket in blocks instead of
    listing the pairs first; better where buckets are few and sets small.
    """
    shared, shared_path = meeting(postings, f"{name}-meeting")
    sets, sets_path = written(sets_of(durable(shared.select("node").distinct())), f"{name}-sets")
    links: list[DataFrame] = []
    tested: DataFrame | None = None
    state = shared.withColumn("comp", F.col("node"))
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        member = state.select("bucket", "comp", *_ends("b"))
        if last and blocks:
            links.append(linked_in_blocks(state, sets, least))
            break
        if last:
            other = state.select("bucket", F.col("comp").alias("a_comp"), *_ends("a"))
            met = member.join(other, "bucket").where("a_node < b_node AND a_comp <> comp")
        else:
            turned = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
            pivot = state.groupBy("bucket").agg(F.min_by(F.struct("node", "size", "pos", "comp"), F.struct(turned.alias("t"), "node", "pos")).alias("p"))
            pivot = pivot.select("bucket", F.col("p.comp").alias("a_comp"), *_ends("a", "p"))
            met = member.join(pivot, "bucket").where("a_node <> b_node AND a_comp <> comp")
        pairs = _pairs(met, least, tested)
        links.append(verified(pairs, sets, least))
        if last:
            break
        tested = pairs if tested is None else durable(tested.unionByName(pairs))
        groups = measured(durable(components(reduce(DataFrame.unionByName, links))))
        labelled = shared.join(groups, "node", "left").select("bucket", "node", "size", "pos", F.coalesce("component", "node").alias("comp"))
        open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l < h").select("bucket")
        state = durable(labelled.join(open_, "bucket", "left_semi"))
        if state.isEmpty():
            break
    found = durable(reduce(DataFrame.unionByName, links))
    emptied(shared.sparkSession, shared_path, sets_path)
    return found
