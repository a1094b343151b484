"""Pack documents into sequences: best-fit planned over a histogram of lengths.

The plan is made over counts of lengths, so its work and size depend on the sequence length and
not on the number of documents. Each document then finds its planned slot by its rank among the
pieces of the same length.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import threading
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rowassay.llm.shared import WORD, ranked, released, sliced
from rowassay.session import durable

LENGTH = 2048
END = np.array([0], dtype="<u4").tobytes()
#: Bytes of words and ids a worker remembers, twice (those met since the last turn-over, and those
#: before): of plain words and their parts in lower case, and of other texts' words as they are.
LOWER_BYTES, WORD_BYTES = 32 << 20, 8 << 20
#: What an entry takes beside its key and ids.
ENTRY = 200
#: Unknown words that are encoded as one text, parted by a special token.
TOGETHER = 200
#: Texts of these characters only are lower-cased and split here as SPLITTING tokenizers do it.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile(WORD)
PARTS = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zà-öø-ÿß0-9]+")
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: The character that stands for a byte in the vocabulary of a ByteLevel tokenizer.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
LETTERS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


class Remembered(dict):
    """Ids by key; make() gives those of an unknown one. Beyond so many bytes the older half goes, but for what is met again."""

    def __init__(self, most: int, make: Callable[[str], bytes] | None = None):
        self.most, self.make, self.held = most, make, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            if self.make is None:
                raise KeyError(key)
            ids = self.make(key)
        self[key] = ids
        self.held += len(key) + len(ids) + ENTRY
        return ids

    def put(self, key: str, ids: bytes) -> None:
        self[key] = ids
        self.held += len(key) + len(ids) + ENTRY

    def turned(self) -> Remembered:
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        return self


class WordEncoder:
    """Ids of a text, word by word: the vocabulary drops white space, so words encode alone.

    Words end at ASCII white space only; the tokenizer itself deals with any other. Where it splits
    words as SPLITTING does, plain ones are remembered in lower case, and what is between their
    signs is encoded alone. Ids are kept as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # of these two parts alone: the whole file as Python objects takes more memory than the tokenizer
        self.splitting = all((part := getattr(self.tokenizer, k)) is not None and json.loads(part.__getstate__()) == v for k, v in SPLITTING.items())
        self.model = self.tokenizer.model
        self.lower, self.words = Remembered(LOWER_BYTES, self.made), Remembered(WORD_BYTES)

    def plain(self, text: str) -> bool:
        return self.splitting and PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def made(self, word: str) -> bytes:
        """Ids of a plain word in lower case."""
        parts = PARTS.findall(word)
        if len(parts) > 1:
            return b"".join(map(self.lower.__getitem__, parts))
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[str]) -> None:
        """Words by the tokenizer, those that hold no token of its own many at once."""
        alone: list[str] = []
        some: list[str] = []
        for word in words:
            (alone if self.mark is None or any(a in word for a in self.added) else some).append(word)
        for word in alone:
            self.words.put(word, np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes())
        for at in range(0, len(some), TOGETHER):
            part = some[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            raw = ids.tobytes()
            for word, first, end in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                self.words.put(word, raw[4 * first : 4 * end])

    def ids(self, text: str) -> bytes:
        lower = self.lower.turned()
        if self.plain(text):
            return b"".join(map(lower.__getitem__, text.lower().split())) + END
        words, known = WORDS.findall(text), self.words.turned()
        new = {w for w in words if w not in known and w not in known.old}
        plain = {w for w in new if self.plain(w)}
        for word in plain:
            known.put(word, lower[word.lower()])
        self.learn(list(new - plain))
        return b"".join(map(known.__getitem__, words)) + END


#: Seconds a worker without packing tasks keeps its encoder.
KEPT_SECONDS = 3.0


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One per Python worker, so a task starts with the words that earlier tasks have met."""
    return WordEncoder(path)


@contextmanager
def lent(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder for one task. Workers live on with other work, so an unused one is given up."""
    for timer in _waiting:
        timer.cancel()
    _waiting.clear()
    try:
        yield encoder_of(path)
    finally:
        timer = threading.Timer(KEPT_SECONDS, given_up)
        timer.daemon = True
        _waiting.append(timer)
        timer.start()


_waiting: list[threading.Timer] = []


def given_up() -> None:
    encoder_of.cache_clear()
    released()


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A null text is empty: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(tokenizer) as encoder:
            for batch in sliced(batches):
                rows: list[tuple] = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encoder.ids(text or "")
                    for piece, start in enumerate(range(0, len(ids) // 4, length)):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((key, piece, start, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    key_type = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "piece", "start", "length", "ids_crc32"]
    kinds = [to_arrow_type(docs.schema[id_column].dataType), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {key_type}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Best-fit over a histogram, longest first: (repeats, lengths in one sequence).

    Open sequences are groups of equal content, kept by free space. A length goes to the group with
    the least space that fits it, and fills one sequence before the next; a group is split where the
    pieces do not fill all its sequences.
    """
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    free: list[int] = []

    def put(space: int, repeats: int, content: list[int]) -> None:
        if space not in open_:
            open_[space] = []
            bisect.insort(free, space)
        open_[space].append((repeats, content))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(free, size)
            if at == len(free):
                each = length // size
                full, rest = divmod(left, each)
                if full:
                    put(length - each * size, full, [size] * each)
                if rest:
                    put(length - rest * size, 1, [size] * rest)
                break
            space = free[at]
            repeats, content = open_[space].pop()
            if not open_[space]:
                del open_[space]
                free.pop(at)
            each = space // size
            full, rest = divmod(left, each)
            if full >= repeats:
                full, rest = repeats, 0
            if full:
                put(space - each * size, full, content + [size] * each)
            if rest:
                put(space - rest * size, 1, content + [size] * rest)
            if untouched := repeats - full - bool(rest):
                put(space, untouched, content)
            left -= full * each + rest
    return [group for space in free for group in open_[space]]


def slots(planned: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks take sequences in turn."""
    out, sequence = [], 0
    used: Counter[int] = Counter()
    for repeats, content in planned:
        offset = 0
        for size in content:
            out.append((size, used[size], used[size] + repeats, sequence, offset))
            used[size] += repeats
            offset += size
        sequence += repeats
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts are packed as their end id. Repeated rows are packed each; which of two
    equal pieces takes which slot is left to the ranks, any choice gives the same set of rows.
    Null ids stay null. An empty table gives no rows.
    """
    cut = durable(pieces(docs, tokenizer, length, id_column, text_column))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    found = slots(plan(counts, length))
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, first, _, sequence, offset in found:
        by_length.setdefault(size, []).append((first, sequence, offset))
    placed = {size: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows), strict=True)) for size, rows in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast(placed)  # grows with the histogram's size only

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in sliced(batches):
            sizes = batch.column("length").to_numpy()
            ranks = batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                first, begin, at = table[int(size)]
                own = sizes == size
                slot = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own] = begin[slot] + ranks[own] - first[slot]
                offset[own] = at[slot]
            keep = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [id_column, "piece", "start", "length", "ids_crc32"]
    key_type = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {key_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    order = (id_column, "piece", "ids_crc32")
    return ranked(cut, "length", *order).select(*names, "__rank").mapInArrow(seat, schema)
