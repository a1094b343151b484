"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, removal by components.

Equal paragraphs are one node. Nodes that share a band meet, every link is verified on the whole
shingle sets, and of each connected group the first paragraph stays in place. Passages inside a
line or across short lines are runs of whole sentences, one from each sentence on; equal ones are
one node. They overlap, so links by similarity would chain a text to its own neighbours.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowassay.llm.links import LEAST, connect, mixed, parts_of, shingles
from rowassay.llm.shared import SLICE, WORD, components, emptied, measured, packed, packed_sorted, partitions, sliced, unpacked, unpacked_sorted, written
from rowassay.session import durable

#: A pair at Jaccard 0.75 shares a band with probability 1 - (1 - 0.75 ** ROWS) ** BANDS = 0.998.
BANDS = 16
ROWS = 4
#: Shorter paragraphs are left alone: they recur by chance or are formulas.
MIN_WORDS = 20
#: Paragraphs a task remembers to send each only once; more are sent again, to the same end.
REMEMBERED = 1_000_000
#: A line that begins inside a sentence begins a window of at most so many times the least words.
NEAR = 4
WORDS = re.compile(WORD)
#: The end of a word that ends a sentence, with closing quotes and brackets of ASCII, Latin-1 and U+2019, U+201D.
ENDING = re.compile(rb"[.!?](?:[\"')\]}]|\xc2\xbb|\xe2\x80[\x99\x9d])*\Z")
#: Bytes that are white space, that end a sentence, and that may close a word that does.
SPACE, SENTENCE, CLOSING = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", b".!?", b"\"')]}\xbb\x99\x9d"))
#: Words of a shingle, and words that are hashed as one array.
SHINGLE, TOGETHER = 5, 1 << 15
#: Texts whose passages are found at once; their arrays take some fifty times the texts' bytes.
PART_ROWS = 200
#: Low bits of a band that are cut off; equal bands stay equal, and links are verified anyway.
CUT = np.uint64(16)
#: Hashes a group of the count is planned for, and bytes of text that make one.
GROUP_HASHES, HASH_BYTES = 1_000_000, 16


def paragraphs(text: bytes | None, least_words: int) -> Iterator[tuple[int, list[bytes]]]:
    """(line number, words in lower case) of the lines long enough."""
    for at, line in enumerate((text or b"").split(b"\n")):
        words = line.lower().split()
        if len(words) >= least_words:
            yield at, words


class Passages:
    """The words of a batch of texts, and the passages they make, as arrays.

    Paragraphs are lines with enough words. Windows begin at each sentence of the text between blank
    lines, where a line break is any white space, and are the shortest run of whole sentences with
    enough words; those that are a paragraph are left out. A line that begins inside a sentence, as
    after a heading, counts as a sentence if its run is not longer than NEAR times the least words,
    so the work stays linear.

    Passages are rows: first word, end, whether it is a paragraph.
    """

    def __init__(self, texts: list[bytes], least_words: int):
        data = b"\n\n".join(texts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        space = SPACE[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        self.starts, self.ends = edges[0::2], edges[1::2]
        n = len(self.starts)
        kept = ~space
        kept[self.ends] = True
        lower = np.frombuffer(data.lower(), np.uint8).copy()
        lower[self.ends] = 32
        self.text = lower[kept].tobytes()  # words in lower case, a blank after each
        size = self.ends - self.starts
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        self.begins = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        self.holder = np.searchsorted(self.begins, self.starts, side="right") - 1
        later = (raw & 0xC0) == 0x80
        self.shift = np.concatenate([[0], np.cumsum(later)]) if later.any() else None
        line = np.searchsorted(np.flatnonzero(raw == 10), self.starts)
        step = np.diff(line, prepend=-2)
        firsts = np.flatnonzero(step > 0)
        line_end = np.append(firsts[1:], n)
        long = line_end - firsts >= least_words
        stretch = np.flatnonzero(step > 1)
        closing = np.zeros(n, bool)
        last = raw[self.ends - 1]
        closing[SENTENCE[last]] = True
        for i in np.flatnonzero(CLOSING[last]).tolist():
            closing[i] = ENDING.search(data[self.starts[i] : self.ends[i]]) is not None
        closing[np.append(stretch[1:], n)[: len(stretch)] - 1] = True
        ends = np.flatnonzero(closing) + 1
        begin = np.zeros(n + 1, bool)
        begin[ends] = True
        begin[:1] = True
        some = begin[:n].copy()
        some[firsts] = True
        first = np.flatnonzero(some)
        which = np.searchsorted(ends, first + least_words)
        inside = which < len(ends)
        first, end = first[inside], ends[which[inside]]
        limit = np.append(stretch[1:], n)[np.searchsorted(stretch, first, side="right") - 1] if n else first
        own = np.full(n + 1, -1)
        own[firsts[long]] = line_end[long]
        use = (end <= limit) & (begin[first] | (end - first <= NEAR * least_words)) & (own[first] != end)
        self.first = np.concatenate([firsts[long], first[use]])
        self.end = np.concatenate([line_end[long], end[use]])
        self.line = np.arange(len(self.first)) < long.sum()

    def nodes(self) -> np.ndarray:
        """What node_of gives for the words of each passage."""
        import xxhash

        digest, text = xxhash.xxh3_64_intdigest, self.text
        values = [digest(text[a:b]) for a, b in zip(self.at[self.first].tolist(), (self.at[self.end] - 1).tolist(), strict=True)]
        return (np.array(values, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each passage its text, and the first character and the end in it."""
        holder = self.holder[self.first]
        begin, start, end = self.begins[holder], self.starts[self.first], self.ends[self.end - 1]
        if self.shift is not None:
            begin, start, end = (x - self.shift[x] for x in (begin, start, end))
        return holder, start - begin, end - begin

    def words(self, which: int) -> list[bytes]:
        return self.text[self.at[self.first[which]] : self.at[self.end[which]] - 1].split(b" ")


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without these characters, and how many separate spans that were.

    White space after a span goes with it, up to the end of its line. Lines of which a span leaves
    no word go whole.
    """
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    out, at, k = [], 0, 0
    for line in text.split("\n"):
        end, place, kept, cut = at + len(line), at, [], False
        while k < len(merged) and merged[k][0] < end:
            cut = True
            kept.append(text[place : max(place, merged[k][0])])
            place = min(end, merged[k][1])
            if merged[k][1] > end:
                break
            k += 1
            after = WORDS.search(text, place, end)
            place = after.start() if after else end
        rest = "".join(kept) + text[place:end]
        if not cut or WORDS.search(rest):
            out.append(rest)
        at = end + 1
    return "\n".join(out), len(merged)


def node_of(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _seeds() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def bands(items: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One number per band: the mixed minima of ROWS hash functions."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), 4096):  # very long paragraphs in parts
        low = np.minimum(low, ((items[None, at : at + 4096] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    value = (low * (seeds | np.uint64(1))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mixed(value + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def banded(words: list[list[bytes]], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands and number of shingles of each list of words, as bands and shingles give them."""
    import xxhash

    size = np.array([len(w) for w in words])
    if not len(size) or size.min() < SHINGLE or size.max() > TOGETHER:
        items = [shingles(w) for w in words]
        return np.array([bands(x, seeds) for x in items], dtype=np.int64).reshape(len(items), BANDS), np.array([len(x) for x in items], dtype=np.int32)
    codes = np.fromiter((xxhash.xxh64_intdigest(w) for own in words for w in own), dtype=np.uint64, count=int(size.sum()))
    value = np.full(len(codes) - SHINGLE + 1, SHINGLE, dtype=np.uint64)
    for i in range(SHINGLE):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(value)]
    owner = np.repeat(np.arange(len(size)), size)
    own = owner[: len(value)] == owner[SHINGLE - 1 :]
    value, owner = mixed(value[own]), owner[: len(value)][own]
    count = size - SHINGLE + 1
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    told = value + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ordered = np.sort(told)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    for i in np.unique(owner[np.isin(told, twice)]) if len(twice) else ():
        count[i] = len(np.unique(value[begin[i] : begin[i] + size[i] - SHINGLE + 1]))
    low = np.empty((len(size), len(seeds)), dtype=np.uint64)
    for i, seed in enumerate(seeds):
        low[:, i] = np.minimum.reduceat((value ^ seed) * np.uint64(0x9E3779B97F4A7C15), begin)
    out = (low * (seeds | np.uint64(1))).reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return mixed(out + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64), count.astype(np.int32)


def gathered(words: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """The same lists, some at a time: about TOGETHER words, unless one list is longer."""
    few, held = [], 0
    for own in words:
        few.append(own)
        held += len(own)
        if held >= TOGETHER:
            yield few
            few, held = [], 0
    if few:
        yield few


def numbered(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch that are worked on at once, each with the number of its first row."""
    at = 0
    for part in sliced(iter([batch]), PART_ROWS):
        yield at, part
        at += part.num_rows


def scanned(docs: DataFrame, groups: int, least_words: int) -> DataFrame:
    """One pass over id, digest, text, by batches of texts, that sends hashes to be counted.

    Rows (batch, group, values, marks): a range of the hashes of one batch, ascending. Groups from 0
    on hold each node of the batch once, marked by its rank among them, twice, plus one if it counts
    anyway (a paragraph, or met twice in the batch). Groups from `groups` on hold the bands of the
    paragraphs that the task has not met yet, cut by CUT bits, marked by twice their paragraph.
    A row (batch, -1, …): all places of the batch, by rank. A row (batch, -2, …): node and size of
    each of those paragraphs.
    """

    def dealt(values: np.ndarray, marks: np.ndarray, least: int) -> Iterator[tuple]:
        order = np.argsort(values, kind="stable")
        values, marks = values[order], marks[order].astype("<u4")
        group = ((values >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(group)) + 1
        for at, v, m in zip([0, *cuts.tolist()], np.split(values, cuts), np.split(marks, cuts), strict=True):
            if len(v):
                yield least + int(group[at]), packed_sorted(v), packed(m), *[None] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, seen = _seeds(), set()
        for batch in sliced(batches, 2 * SLICE):
            told, new, parts = [], [], []
            for at, part in numbered(batch):
                found = Passages([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()], least_words)
                node = found.nodes()
                holder, start, end = found.places()
                told.append((node, holder + at, start.astype("<i4"), (end - start).astype("<i4"), found.line))
                own = []
                for i in np.flatnonzero(found.line).tolist():
                    if (one := int(node[i])) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(one)
                        new.append(one)
                        own.append(found.words(i))
                for few in gathered(own):
                    parts.append(banded(few, seeds))
            nodes, holder, start, size, line = (np.concatenate(x) for x in zip(*told, strict=True))
            if not len(nodes):
                continue
            distinct, rank, count = np.unique(nodes.view(np.uint64), return_inverse=True, return_counts=True)
            flag = count > 1
            flag[rank[line]] = True
            rows = list(dealt(distinct, 2 * np.arange(len(distinct)) + flag, 0))
            order = np.argsort(holder, kind="stable")
            ids, absent, digests = (packed(c.to_numpy(zero_copy_only=False)) for c in (batch.column(0).fill_null(0), batch.column(0).is_null().cast(pa.uint8()), batch.column(1)))
            rows.append((-1, packed(rank[order].astype("<u4")), packed(line[order].astype("<u1")), ids, absent, digests, packed(holder[order].astype("<u2")), packed(start[order]), packed(size[order])))
            if new:
                value = np.concatenate([b for b, _ in parts]).view(np.uint64) >> CUT << CUT
                rows += dealt(value.ravel(), 2 * np.repeat(np.arange(len(new)), BANDS), groups)
                rows.append((-2, packed(np.array(new, dtype="<i8")), packed(np.concatenate([n for _, n in parts]).astype("<i4")), *[None] * 6))
            name = uuid.uuid4().int >> 65
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["batch", "group", "values", "marks", "ids", "absent", "digests", "holders", "starts", "sizes"])

    kinds = (pa.int32(), *[pa.binary()] * 8)
    return docs.select("id", "digest", "text").mapInArrow(run, "batch long, `group` int, `values` binary, marks binary, ids binary, absent binary, digests binary, holders binary, starts binary, sizes binary")


def recurring(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one group: the hashes that come more than once, or count anyway, in one row per batch. The
    lowest bit of a mark now says whether it comes more than once in the group."""
    values = [unpacked_sorted(v) for v in rows["values"]]
    marks = [unpacked(m, "<u4") for m in rows["marks"]]
    _, which, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    mark = np.concatenate(marks)
    again = (counts > 1)[which]
    keep, mark = again | (mark & 1 > 0), mark >> 1 << 1 | again
    cuts = np.cumsum([len(v) for v in values])[:-1]
    out = []
    for batch, value, own, told in zip(rows["batch"], values, np.split(keep, cuts), np.split(mark, cuts), strict=True):
        if own.any():
            out.append((batch, packed_sorted(value[own]), packed(told[own].astype("<u4"))))
    return pd.DataFrame(out, columns=["batch", "values", "marks"])


def _returned(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    some = rows[rows["group"] == 0]
    values = [unpacked_sorted(v) for v in some["values"]]
    return np.concatenate([np.zeros(0, np.uint64), *values]), np.concatenate([np.zeros(0, np.uint32), *[unpacked(m, "<u4") for m in some["marks"]]])


def recurring_places(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: (id, digest, start, end, line, node, again) of the places whose nodes have come back."""
    told = rows[rows["group"] == -1].iloc[0]
    rank = unpacked(told["values"], "<u4")
    value, mark = _returned(rows)
    node, wanted = np.zeros(int(rank.max()) + 1, np.uint64), np.zeros(int(rank.max()) + 1, bool)
    node[mark >> 1], wanted[mark >> 1] = value, True
    again = np.bincount(rank) > 1
    again[mark >> 1] |= mark & 1 > 0
    own = wanted[rank]
    holder, start = unpacked(told["holders"], "<u2")[own], unpacked(told["starts"], "<i4")[own]
    ids = pd.arrays.IntegerArray(unpacked(told["ids"], "<i8"), unpacked(told["absent"], "<u1") > 0)
    return pd.DataFrame({
        "id": ids[holder], "digest": unpacked(told["digests"], "<i8")[holder], "start": start, "end": start + unpacked(told["sizes"], "<i4")[own],
        "line": unpacked(told["marks"], "<u1")[own] > 0, "node": node[rank[own]].view(np.int64), "again": again[rank[own]],
    })


def recurring_bands(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: the postings of the bands that have come back."""
    value, mark = _returned(rows)
    told = rows[rows["group"] == -2]
    if not len(told) or not len(value):
        return pd.DataFrame([], columns=["bucket", "salt", "node", "size", "pos"])
    node, size = unpacked(told.iloc[0]["values"], "<i8"), unpacked(told.iloc[0]["marks"], "<i4")
    return pd.DataFrame({"bucket": value.view(np.int64), "salt": 0, "node": node[mark >> 1], "size": size[mark >> 1], "pos": 1})


def places_and_postings(docs: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame, str]:
    """(id, digest, start, end, line, node, again) of every paragraph, and of every window whose node
    comes more than once (again); the postings of every band that comes more than once; the written table they read."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(partitions(docs.sparkSession), total // HASH_BYTES // GROUP_HASHES)
    table, path = written(scanned(docs, groups, least_words), "paragraph-hashes")

    def counted(first: int) -> DataFrame:
        sent = table.where((F.col("group") >= first) & (F.col("group") < first + groups)).select("batch", "group", "values", "marks")
        return sent.groupBy("group").applyInPandas(recurring, "batch long, `values` binary, marks binary").withColumn("group", F.lit(0))

    def joined(first: int, kind: int, build, schema: str) -> DataFrame:
        both = counted(first).unionByName(table.where(F.col("group") == kind), allowMissingColumns=True)
        return both.groupBy("batch").applyInPandas(build, schema)

    places = joined(0, -1, recurring_places, "id long, digest long, start int, end int, line boolean, node long, again boolean")
    return places, joined(groups, -2, recurring_bands, "bucket long, salt int, node long, size int, pos int"), path


def sets(docs: DataFrame, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = {node_of(words): shingles(words) for text in batch.column(0).cast(pa.binary()).to_pylist() for _, words in paragraphs(text, least_words)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array([x.view(np.int64) for x in found.values()], pa.list_(pa.int64())), pa.array([parts_of(x) for x in found.values()], pa.list_(pa.int32()))],
                names=["node", "items", "parts"],
            )

    return docs.select("text").mapInArrow(run, "node long, items array<long>, parts array<int>")


def removals(source: DataFrame, least_words: int, least: int) -> DataFrame:
    """(id, digest, gone): the spans of characters to remove of each document that loses any."""
    places, postings, hashes = places_and_postings(source, least_words)
    found, _ = written(places, "paragraph-places")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = measured(wanted)
        holder = found.where("line").join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "digest")).alias("holder"))
        holders = durable(holder.select("holder.id", "holder.digest").distinct())
        own = source.join(measured(holders.select(F.col("id").alias("__id"), F.col("digest").alias("__d"))), F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__d")), "left_semi")
        return sets(own, least_words).join(wanted, "node", "left_semi").dropDuplicates(["node"])

    links = connect(postings, sets_of, least, "paragraphs", blocks=True)
    emptied(source.sparkSession, hashes)
    groups = measured(durable(components(links)))
    # a passage that comes once and links with nothing is no repeat; only linked nodes are gathered by component
    some = found.where("again").unionByName(found.where("NOT again").join(groups, "node", "left_semi"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "start", "end"))
    nodes = durable(some.groupBy("node").agg(first.alias("keep")).join(groups, "node", "left"))
    linked = nodes.where("component IS NOT NULL")
    kept = linked.groupBy("component").agg(F.min("keep").alias("keep"))
    repeated = nodes.where("component IS NULL").select("node", "keep").unionByName(linked.select("node", "component").join(kept, "component").select("node", "keep"))
    repeated = durable(repeated)
    # what overlaps the passage that stays is no repeat of it
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("digest") == F.col("keep.digest")) & (F.col("start") < F.col("keep.end"))
    return durable(
        some.join(measured(repeated), "node").where(~stays).groupBy("id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone"))
    )


def prepared(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), digest_of(text_column).alias("digest"), F.col(text_column).cast("string").alias("text"))


def digest_of(text_column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def _cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = [(None, 0) if a is None else without(t, list(zip(a.tolist(), b.tolist(), strict=True))) for t, a, b in zip(texts, starts, ends, strict=True)]
    return pd.DataFrame(rows, columns=["text", "cuts"])


def without_repeats(docs: DataFrame, least_words: int = MIN_WORDS, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, with the repeated passages cut out of text, and __gone, the count.

    The first passage of a group, by id, text hash and place, stays; ids that are null come last.
    Rows equal in id and text are one document and lose the same passages. Null texts stay null.
    """
    gone = measured(removals(prepared(docs, id_column, text_column), least_words, least).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("gone").alias("__spans")))
    joined = docs.join(gone, F.col(id_column).cast("long").eqNullSafe(F.col("__id")) & (digest_of(text_column) == F.col("__digest")), "left")
    own = F.when(F.col("__spans").isNotNull(), F.col(text_column).cast("string"))
    cut = joined.withColumn("__cut", F.pandas_udf(_cut, "text string, cuts int")(own, F.col("__spans.start"), F.col("__spans.end")))
    text = F.when(F.col("__spans").isNull(), F.col(text_column)).otherwise(F.col("__cut.text"))
    return cut.withColumns({text_column: text, "__gone": F.coalesce("__cut.cuts", F.lit(0))}).drop("__id", "__digest", "__spans", "__cut")


def dedup(docs: DataFrame, least_words: int = MIN_WORDS, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_paragraphs (lines), n_removed (passages cut out), text (what is left).

    Paragraphs are lines of at least least_words words; two link at a Jaccard similarity of their
    five-word shingles of least percent. Runs of whole sentences with as many words repeat if they
    are equal but for case and white space, inside a line or across lines. Empty tables give no rows, null texts have no paragraphs.
    """
    narrow = docs.select(F.col(id_column), F.col(text_column), F.when(F.length(text_column) > 0, F.size(F.split(F.col(text_column), "\n"))).otherwise(0).alias("n_paragraphs"))
    out = without_repeats(narrow, least_words, least, id_column, text_column)
    return out.select(id_column, "n_paragraphs", F.col("__gone").alias("n_removed"), text_column)
