"""How the sources of a language differ in their words: in-mapper stripes.

Each task folds whole documents into stripes, a hash table from term to its document frequency and
its count in every source, and hands them on whenever they reach a budget. Stripes of one term are
merged by key. A merged stripe holds the term's counts in all sources of its language, so the
differences between the sources are summed straight from it, term by term.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rowassay.llm.shared import partitions, sliced
from rowassay.session import durable

#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 30
#: Added to every count.
PRIOR = 5
#: One whole, in the integers that stand for shares.
ONE = 1_000_000_000
#: Terms listed per group.
TOP = 50
#: Cells (term, source) a task folds before it hands its stripes on; 64 bytes of a term count as one more.
CELLS = 200_000
#: Numbers of a task's matrices of differences, and of one block of terms by sources.
NUMBERS = 4_000_000
#: Cells that come to the differences as one row, about; and rows of a language's sources that are broadcast.
CHUNK, BROADCAST = 20_000, 500_000

#: ASCII letters become lower case, other ASCII characters end a term, all else stays.
FOLDED = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))

CELL = "lang string, term string, source string, n long, df long"


def stripes(docs: DataFrame, least: int = LEAST_DOCUMENTS, cells: int = CELLS, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """One row per language and kept term: lang, term, cells (source, n).

    The empty term has one cell for every source of the language, with n = 0.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, dict[bytes, dict[str, list[int]]]] = {}
        held = 0
        for batch in sliced(batches):
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = table.setdefault(lang, {})
                found = Counter(text.encode().translate(FOLDED).split())
                found[b""] = 0
                for term, n in found.items():
                    stripe = terms.get(term)
                    if stripe is None:
                        stripe = terms[term] = {}
                        held += len(term) // 64
                    cell = stripe.get(source)
                    if cell is None:
                        stripe[source] = [n, 1]
                        held += 1
                    else:
                        cell[0] += n
                        cell[1] += 1
                if held >= cells:
                    yield from handed_on(table)
                    table, held = {}, 0
        yield from handed_on(table)

    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_column, "text"), (lang_column, "lang"), (source_column, "source"))))
    dealt = whole.mapInArrow(fold, CELL).repartition(partitions(docs.sparkSession), "lang", "term")
    merged = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    found = merged.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return found.where((F.col("term") == "") | (F.col("df") >= least)).select("lang", "term", "cells")


def handed_on(table: dict) -> Iterator[pa.RecordBatch]:
    """The folded stripes as rows, one per cell."""
    for lang, terms in table.items():
        columns: tuple[list, ...] = ([], [], [], [])
        for term, stripe in terms.items():
            for source, (n, df) in stripe.items():
                for column, value in zip(columns, (term, source, n, df), strict=True):
                    column.append(value)
        term, source, n, df = columns
        for at in range(0, len(n), 50_000):
            to = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n[to]), pa.string()), pa.array(term[to], pa.binary()).cast(pa.string()), pa.array(source[to], pa.string()), pa.array(n[to], pa.int64()), pa.array(df[to], pa.int64())],
                names=["lang", "term", "source", "n", "df"],
            )


def shares(counts: np.ndarray, totals: np.ndarray, terms: int, prior: int) -> np.ndarray:
    """1 + floor(ONE * (count + prior) / (total + prior * terms)), exact below 9.2e15 words a total."""
    under = totals + prior * terms
    result, rest = np.divmod(counts + prior, under)
    for _ in range(3):  # three decimal digits a step
        digits, rest = np.divmod(rest * 1000, under)
        result = result * 1000 + digits
    return 1 + result


def differences(block: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sums over terms (rows) of the absolute differences of sources first to last to all later sources (columns)."""
    result = np.zeros((last - first, block.shape[1]), dtype=np.int64)
    for i in range(first, last):
        result[i - first, i + 1 :] = np.abs(block[:, i + 1 :] - block[:, i : i + 1]).sum(axis=0)
    return result


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, prior: int = PRIOR, top: int = TOP, cells: int = CELLS, numbers: int = NUMBERS, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """One row per group (language, source) and item: lang, source, part, item, value, rank.

    Part pair: every other source of the language, by the summed difference of the shares of all
    kept terms. Part term: the group's terms whose share is above the language's, the top ones.
    Shares and sums are exact integers. Null text, language and source are empty text and make groups
    of their own; documents without terms make groups too. Repeated rows count again; ties rank by
    item. Very long texts are folded like any. An empty table gives no rows.
    """
    kept = durable(stripes(docs, least, cells, **columns))
    flat = kept.select("lang", "term", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"), F.count("*").alias("held"))
    languages = flat.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"), F.sum("held").alias("held"))
    sizes = kept.where("term <> ''").groupBy("lang").agg(F.count("*").alias("terms"))
    languages = durable(
        languages.join(sizes, "lang", "left").select(
            "lang", F.col("sources.source").alias("sources"), "sources.total", F.coalesce("terms", F.lit(0)).alias("terms"), F.floor(F.col("held") / chunk + 1).cast("long").alias("chunks")
        )
    )
    # beyond the counted bound the languages meet their stripes by a shuffle
    few = (languages.agg(F.sum(F.size("sources"))).first()[0] or 0) <= BROADCAST
    wide = F.broadcast(languages) if few else languages
    dealt = kept.where("term <> ''").join(wide.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    chunks = dealt.groupBy("lang", "chunk").agg(F.collect_list("term").alias("names"), F.collect_list("cells").alias("cells")).join(wide, "lang")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}
        best: dict[tuple[str, str], list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                lang, names, stripe, sources, totals, terms = (c[at] for c in batch.columns)
                lang, names, terms, listed, sources = lang.as_py(), names.as_py(), terms.as_py(), sources.values, sources.as_py()
                width = len(sources)
                totals = totals.values.to_numpy()
                totals = np.append(totals, totals.sum())
                if lang not in sums and width * (width + sum(m.shape[0] for _, m in sums.values())) > numbers:
                    yield from summed(sums)
                    sums = {}
                inner = stripe.values
                edges = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy())])
                cell = inner.flatten()
                place = pc.index_in(cell.field(0), value_set=listed).to_numpy()
                count = cell.field(1).to_numpy()
                step = max(1, numbers // (width + 1))
                for low in range(0, len(names), step):
                    high = min(low + step, len(names))
                    lengths = np.diff(edges[low : high + 1])
                    counts = np.zeros((high - low, width + 1), dtype=np.int64)
                    counts[np.repeat(np.arange(high - low), lengths), place[edges[low] : edges[high]]] = count[edges[low] : edges[high]]
                    counts[:, width] = counts.sum(axis=1)
                    p = shares(counts, totals, terms, prior)
                    lines = max(1, numbers // width)
                    for first in range(0, width, lines):
                        found = differences(p[:, :width], first, min(first + lines, width))
                        if lines < width:  # too many sources for a matrix: hand on at once
                            yield from pair_rows(lang, sources, first, found)
                        elif lang in sums:
                            sums[lang][1][:] += found
                        else:
                            sums[lang] = sources, found
                    above = p[:, :width] - p[:, width:]
                    for i, j in zip(*np.nonzero((above > 0) & (counts[:, :width] > 0)), strict=True):
                        _offer(best.setdefault((lang, sources[j]), []), int(above[i, j]), names[low + i], top)
        yield from summed(sums)
        yield from _rows([(lang, source, "term", x[1].raw.decode(), x[0]) for (lang, source), found in best.items() for x in found])

    parts = chunks.select("lang", "names", "cells", "sources", "total", "terms").mapInArrow(emit, "lang string, source string, part string, item string, value long")
    # every pair once, also where no term is kept
    each = languages.select("lang", F.posexplode("sources").alias("__i", "source"), F.col("sources").alias("__all"))
    nothing = each.select("lang", "source", F.lit("pair").alias("part"), F.explode(F.expr("slice(__all, __i + 2, size(__all))")).alias("item"), F.lit(0).cast("long").alias("value"))
    merged = parts.unionByName(nothing).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    there, back = F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    ways = merged.select("lang", "part", "value", F.explode(F.when(F.col("part") == "pair", F.array(there, back)).otherwise(F.array(there))).alias("w"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = ways.select("lang", "w.source", "part", "w.item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def _offer(found: list, value: int, term: str, top: int) -> None:
    """Keep the largest values; of equal ones the terms that come first."""
    item = (value, _Later(term.encode()))
    if len(found) < top:
        heapq.heappush(found, item)
    elif item > found[0]:
        heapq.heapreplace(found, item)


class _Later:
    """Bytes in reverse order."""

    __slots__ = ("raw",)

    def __init__(self, raw: bytes):
        self.raw = raw

    def __lt__(self, other: _Later) -> bool:
        return self.raw > other.raw

    def __gt__(self, other: _Later) -> bool:
        return self.raw < other.raw

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Later) and self.raw == other.raw


def summed(sums: dict[str, tuple[list[str], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (sources, matrix) in sums.items():
        yield from pair_rows(lang, sources, 0, matrix)


def pair_rows(lang: str, sources: list[str], first: int, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, line in enumerate(matrix, first):
        yield from _rows([(lang, sources[i], "pair", sources[j], int(line[j])) for j in range(i + 1, len(sources))])


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "part", "item", "value"]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "value" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


DIVERGENCE_SQL = r"""
WITH d AS (SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
w AS (SELECT lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0)::HUGEINT AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p
  FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term' AS part, item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50
"""
