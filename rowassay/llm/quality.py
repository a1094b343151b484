"""Quality rules: gradient-boosted trees over statistics of whole documents.

Statistics are taken in one pass over the texts and kept as a narrow table. Trees are fitted on a
bounded sample of labelled rows, flattened into numpy node arrays, and score that table in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowassay.llm.shared import measured, sliced
from rowassay.session import durable

#: Labelled rows the trees are fitted on: those with the smallest hash of the id.
SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stops", "n_distinct")
#: Feature and the direction in which quality may move as it grows (0: free).
FEATURES = (
    ("log_words", 0),
    ("mean_word", 0),
    ("symbol_share", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("upper_share", -1),
    ("mark_share", -1),
    ("stop_share", 0),
    ("distinct_share", 0),
    ("words_per_line", 0),
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more in the list, the first find included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        value = value * np.uint64(0x9E3779B97F4A7C15) + (codes[i : i + n] ^ (codes[i : i + n] >> np.uint64(29)))
    order = np.sort(value)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, counts = np.unique(value, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    spaces = len(text) - len(text.translate(None, SPACE))
    points = len(text.decode())
    return (
        len(words),
        points - spaces,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        text.count(b"!") + text.count(b"?"),
        text.count(b"."),
        len(set(words)),
    )


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id and COUNTS, over the whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            columns = list(zip(*[counts_of(t or b"") for t in texts], strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=[id_column, *COUNTS])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_marks"] / words, c["n_stops"] / words, c["n_distinct"] / words, c["n_words"] / lines,
    ])


@dataclass
class Trees:
    """Nodes of all trees side by side; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, directions: tuple[int, ...], rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for log loss on histograms of the features.

    A split on a directed feature must keep its two values in that direction, and what lies below
    each side stays on its side of their middle; so the score is monotonic in such a feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-gs / (hs + ridge), low, high))
        nodes.append([0, 0.0, at, at, own * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + ridge) * vr**2) + (gs * own + 0.5 * (hs + ridge) * own**2)
                bad = (nl < least) | (len(rows) - nl < least) | (directions[j] * (vr - vl) < 0)
                gain[bad] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            total[rows] += own * rate
            return at
        j, k, vl, vr = best[1]
        middle = (vl + vr) / 2
        lows, highs = (low, low), (high, high)
        if directions[j] > 0:
            lows, highs = (low, middle), (middle, high)
        elif directions[j] < 0:
            lows, highs = (middle, low), (high, middle)
        goes = binned[rows, j] <= k
        nodes[at][:2] = [j, float(edges[j][k])]
        nodes[at][2] = grow(rows[goes], g, h, level + 1, lows[0], highs[0])
        nodes[at][3] = grow(rows[~goes], g, h, level + 1, lows[1], highs[1])
        nodes[at][4] = 0.0
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    table = np.array(nodes)
    return Trees(np.array(roots), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], depth, base)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def train(stats: DataFrame, labels: DataFrame, id_column: str, label_column: str, sample: int) -> Trees | None:
    """Fits on the labelled rows with the smallest id hash; None without examples of both kinds.

    Labels that are null, or differ for one id, count as none.
    """
    agreed = (
        labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("__id"))
        .agg(F.min(label_column).alias("__y"), F.max(label_column).alias("__z")).where("__y = __z").drop("__z")
    )
    rows = stats.join(agreed, F.col(id_column) == F.col("__id")).select("__id", "__y", *COUNTS)
    rows = rows.orderBy(F.xxhash64("__id"), "__id", *COUNTS).limit(sample).toPandas()
    y = (rows["__y"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return None
    return fit(features({c: rows[c].to_numpy() for c in COUNTS}), y, tuple(d for _, d in FEATURES))


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, COUNTS, base_failed, score (log odds), kept.

    kept is false where base_failed, else whether the score is at least 0. Without labels of both
    kinds, or in an empty table, the score is null and only the base rules decide. Null texts are
    empty, repeated rows are judged each, a null id is kept as it is and never matches a label.
    """
    stats = durable(statistics(docs, id_column, text_column))
    trees = train(stats, labels, id_column, label_column, sample)
    marked = stats.withColumn("base_failed", base_failed())
    if trees is None:
        return marked.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    scored = marked.mapInArrow(scorer(trees, id_column), marked.schema.simpleString()[7:-1].replace(f"{id_column}:", f"`{id_column}`:", 1) + ",score:double")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0))


def scorer(trees: Trees, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.score(x), pa.float64())], names=[*batch.schema.names, "score"])

    return run


def keep(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, all their columns as they are: texts are judged where they lie.

    Only texts go to Python. Null and empty texts have no words and go; repeated rows are judged
    each; a null id matches no label. Without labels of both kinds only the base rules decide. An
    empty table stays empty.
    """
    labelled = measured(durable(labels.select(F.col(label_column).alias("__y"), F.col(id_column).alias("__id")).select("__id").distinct()))
    examples = docs.join(labelled, F.col(id_column) == F.col("__id"), "left_semi")
    trees = train(statistics(examples, id_column, text_column), labels, id_column, label_column, sample)

    def good(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            batch = pa.RecordBatch.from_arrays([array], names=["text"])
            yield pa.concat_arrays([pa.array([], pa.bool_()), *map(verdicts, sliced(iter([batch])))])

    def verdicts(batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        found = np.array([counts_of(t or b"") for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
        counts = dict(zip(COUNTS, found.T, strict=True))
        passed = (counts["n_words"] >= MIN_WORDS) & (100 * counts["n_repeat_words"] <= MAX_REPEAT * counts["n_words"])
        if trees is not None and len(texts):
            passed &= trees.score(features(counts)) >= 0
        return pa.array(passed)

    return docs.where(F.arrow_udf(good, "boolean")(F.col(text_column).cast("string")))
