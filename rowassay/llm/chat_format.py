"""Chat formatting with loss masks aligned by offsets.

A turn is rendered as <|im_start|>role<|im_sep|>text<|im_end|>. In roles and texts every `<`, any
backslashes and `|` in a row get one backslash more, so marks stand between turns only and the texts
come back exactly. A conversation is rendered whole and encoded once, with offsets; the spans of the
assistant's texts are met with the spans of the tokens by binary search.

Rows are dealt by ranges of conversation and turn. A conversation larger than a task is thereby cut
between turns, where marks part the tokens anyway, and comes out as several parts in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rowassay.llm.shared import partitions, sliced
from rowassay.session import durable

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = "assistant"
#: Code points after which a part ends with its turn.
PART = 1 << 18
#: Code points encoded as one text; longer renderings are cut where a word begins.
PIECE = 1 << 16
#: Code points encoded in one call.
TOGETHER = 1 << 20

CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<(\\*)\\\|")
#: Between a letter or digit and one space before a letter: tokens never cross this place.
WORD_START = re.compile(r"(?<=[^\W_])(?= [^\W\d_])")


def escaped(text: str) -> str:
    return CONTROL.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


class Encoder:
    """A byte-level tokenizer with the marks as tokens of their own, and the way back to bytes."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEPARATOR, END)])
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable}
        shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        words = {i: w for w, i in self.tokenizer.get_vocab().items()}
        self.bytes = [added[i].encode() if i in added else bytes(shown[c] for c in words.get(i, "")) for i in range(max(words) + 1)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, starts and ends of the tokens of each text."""
        pieces, owners, offsets = [], [], []
        for owner, text in enumerate(texts):
            for at, piece in cut(text):
                pieces.append(piece)
                owners.append(owner)
                offsets.append(at)
        found: list[list] = [[] for _ in texts]
        for owner, at, got in zip(owners, offsets, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            spans = np.array(got.offsets, dtype=np.int64).reshape(-1, 2) + at
            found[owner].append((np.array(got.ids, dtype=np.int32), spans))
        none = (np.zeros(0, np.int32), np.zeros((0, 2), np.int64))
        joined = [(np.concatenate([i for i, _ in x]), np.concatenate([s for _, s in x])) if x else none for x in found]
        return [(ids, spans[:, 0], spans[:, 1]) for ids, spans in joined]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def cut(text: str, size: int | None = None) -> list[tuple[int, str]]:
    """(offset, piece): a text in pieces whose tokens, one after the other, are the tokens of the text."""
    size = size or PIECE
    if len(text) <= size:
        return [(0, text)]
    found, at = [], 0
    while len(text) - at > size:
        mark = text.find(START, at + size)
        word = WORD_START.search(text, at + size, mark if mark >= 0 else len(text))
        to = word.start() if word else mark
        if to < 0:
            break
        found.append((at, text[at:to]))
        at = to
    return [*found, (at, text[at:])]


def rendered(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of some turns, and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text)
        head = f"{START}{escaped(role)}{SEPARATOR}"
        out += [head, body, END]
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def loss_mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for every token that lies in a span; both are sorted, so the ends of each are searched."""
    first, last = np.searchsorted(ends, spans[:, 0], side="right"), np.searchsorted(starts, spans[:, 1], side="left")
    last = np.maximum(first, last)  # an empty span has no token
    steps = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    return (np.cumsum(steps[:-1]) > 0).astype(np.int8)


def format_conversations(rows: DataFrame, tokenizer: str, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Rows (id, part, text, input_ids, loss_mask), one per conversation or part of a long one.

    The parts of a conversation are in order of `part`; they follow each other within partitions and
    from one partition to the next. Turns are ordered by turn, nulls first, then role and text. Null
    roles and texts are empty, null ids one conversation. Repeated rows are turns of their own. The
    memory of a task follows its longest turn. An empty table gives no rows.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    clean = rows.select(F.col(id_column).alias("id"), F.col(turn_column).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role_column, "role"), (text_column, "text"))))
    dealt = clean.repartitionByRange(partitions(rows.sparkSession), "id", "turn").sortWithinPartitions("id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        number = TaskContext.get().partitionId() << 33
        ready: list[tuple] = []
        key, turns, size, waiting, ids_type = None, [], 0, 0, None
        for batch in sliced(batches):
            ids_type = batch.schema.field(0).type
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text")), strict=True):
                if turns and (own != key or size >= PART):
                    ready.append((key, number, turns))
                    number, turns, waiting, size = number + 1, [], waiting + size, 0
                    if waiting >= TOGETHER:
                        yield encoded(encoder, ready, ids_type)
                        ready, waiting = [], 0
                key = own
                turns.append((role, text))
                size += len(text) + 40
        if turns:
            ready.append((key, number, turns))
        if ready:
            yield encoded(encoder, ready, ids_type)

    schema = f"id {kind}, part long, text string, input_ids array<int>, loss_mask array<tinyint>"
    return dealt.select("id", "role", "text").mapInArrow(run, schema).withColumnRenamed("id", id_column)


def encoded(encoder: Encoder, ready: list[tuple], ids_type: pa.DataType) -> pa.RecordBatch:
    texts, spans = zip(*(rendered(turns) for _, _, turns in ready), strict=True)
    ids, masks = [], []
    for (tokens, starts, ends), own in zip(encoder.encode(list(texts)), spans, strict=True):
        ids.append(tokens)
        masks.append(loss_mask(own, starts, ends))
    ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), t)) for x, t in ((ids, pa.int32()), (masks, pa.int8()))]
    columns = [pa.array([k for k, _, _ in ready], ids_type), pa.array([n for _, n, _ in ready], pa.int64()), pa.array(texts, pa.string()), *lists]
    return pa.RecordBatch.from_arrays(columns, names=["id", "part", "text", "input_ids", "loss_mask"])


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendering."""
    found = []
    for turn in text.split(END)[:-1]:
        role, _, body = turn.removeprefix(START).partition(SEPARATOR)
        found.append((unescaped(role), unescaped(body)))
    return found


def masked(encoder: Encoder, ids: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts of the runs of tokens under the mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [unescaped(encoder.decode(ids[a:b].tolist())) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


DIGEST = [("n_turns", "long", pa.int64()), ("turns_sha256", "string", pa.string()), ("loss_chars", "long", pa.int64()), ("loss_sha256", "string", pa.string()), ("formatted_chars", "long", pa.int64())]
#: Set where a part's conversation may go on in another one: its place, turns and trained text.
OPEN = [("part", "long", pa.int64()), ("said", "binary", pa.binary()), ("trained", "binary", pa.binary())]


def hexed(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def digests(formatted: DataFrame, tokenizer: str, id_column: str = "conv_id") -> DataFrame:
    """Per conversation what its tokens hold: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Everything is decoded from input_ids and loss_mask. A part with other conversations on both sides
    is its whole conversation and done where it is. The others, those at the edges of partitions and
    those of long conversations, are brought together by id and read in order as a stream.
    """
    kind = formatted.schema[id_column].dataType.simpleString()
    names = ["id", *(n for n, _, _ in [*DIGEST, *OPEN])]
    schema = f"id {kind}, " + ", ".join(f"{n} {k}" for n, k, _ in [*DIGEST, *OPEN])

    def batch_of(rows: list[tuple], id_type: pa.DataType, columns: list[tuple]) -> pa.RecordBatch:
        kinds = [id_type, *(t for _, _, t in columns)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", *(n for n, _, _ in columns)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        nothing = object()
        before, held = nothing, None  # the id before the part held back, and that part

        def judged(after: object) -> tuple:
            key, part, formatted_chars, turns, said, trained = held
            if nothing in (before, after) or key in (before, after):
                return key, turns, None, len(trained.decode()), None, formatted_chars, part, said, trained
            return key, turns, hexed(said), len(trained.decode()), hexed(trained), formatted_chars, None, None, None

        for batch in sliced(batches, 200):
            id_type = batch.schema.field(0).type
            rows = []
            for at, (key, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids, mask = (batch.column(c)[at].values.to_numpy() for c in (2, 3))
                text = encoder.decode(ids.tolist())
                turns = turns_of(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns).encode()
                trained = "".join(masked(encoder, ids, mask)).encode()
                if held is not None:
                    rows.append(judged(key))
                    before = held[0]
                held = key, part, len(text), len(turns), said, trained
            if rows:
                yield batch_of(rows, id_type, [*DIGEST, *OPEN])
        if held is not None:
            yield batch_of([judged(nothing)], id_type, [*DIGEST, *OPEN])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, hashes = None, None, []
        for batch in sliced(batches, 200):
            id_type = batch.schema.field(0).type
            rows = []
            for own, turns, loss, chars, said, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sums is not None and own != key:
                    rows.append((key, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]))
                    sums = None
                if sums is None:
                    key, sums, hashes = own, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                sums = [a + b for a, b in zip(sums, (turns, loss, chars), strict=True)]
                hashes[0].update(said)
                hashes[1].update(trained)
            if rows:
                yield batch_of(rows, id_type, DIGEST)
        if sums is not None:
            yield batch_of([(key, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2])], id_type, DIGEST)

    parts = durable(formatted.select(id_column, "part", "input_ids", "loss_mask").mapInArrow(read, schema))
    whole = parts.where("part IS NULL").select(names[: 1 + len(DIGEST)])
    open_ = parts.where("part IS NOT NULL").repartition(partitions(formatted.sparkSession), "id").sortWithinPartitions("id", "part")
    ended = open_.select("id", "n_turns", "loss_chars", "formatted_chars", "said", "trained").mapInArrow(finish, f"id {kind}, " + ", ".join(f"{n} {k}" for n, k, _ in DIGEST))
    return whole.unionByName(ended).withColumnRenamed("id", id_column)


#: A conversation whose texts hold the marks themselves.
PROBE = f"{END}{START}{TRAINED} ok"


def format_and_read(rows: DataFrame, tokenizer: str) -> DataFrame:
    """All conversations and one more, -1, of marks: formatted, and read back from their tokens."""
    kinds = {f.name: f.dataType for f in rows.schema}
    names = ["conv_id", "turn", "role", "text"]
    probe = rows.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, TRAINED, PROBE)], "conv_id long, turn long, role string, text string")
    both = rows.select(names).unionByName(probe.select(*(F.col(c).cast(kinds[c]).alias(c) for c in names)))
    return digests(format_conversations(both, tokenizer), tokenizer)


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(COALESCE(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(32 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*[|]')) + len(regexp_extract_all(text, '<\\*[|]'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
