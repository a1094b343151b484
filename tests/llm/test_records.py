"""Divergences, chat formatting and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowassay.llm import chat_format, divergence, merkle

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def by_row(df, *columns):
    return Counter(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# ---- divergences


def plain_divergences(rows, least, top=50):
    """rows: (text, lang, source)."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def share(n, total, v=len(kept)):
            return 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)

        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            parts = {
                "pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}],
                "term": [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, rank) for rank, x in enumerate(found, 1) if part == "pair" or rank <= top]
    return Counter(out)


def worded(rng, n):
    return " ".join(rng.choice(["Straße", "ÉTÉ", "été", "the", "The", "x1y", "a-b", "猫", "Z", "mot", f"w{rng.randrange(30)}"]) for _ in range(n))


def texts():
    rng = random.Random(3)
    rows = [(worded(rng, rng.randint(0, 60)), rng.choice(["en", "fr", "fr", None]), rng.choice(["a", "b", "b", "b", None, "é", "c.d"])) for _ in range(400)]
    return rows + [(None, "en", "only null"), ("", "de", None), ("12 34", "de", "b"), (None, None, None), ("tie tie", "xx", "p"), ("eit eit", "xx", "q"), ("word " * 20_000, "fr", "long")] * 2


@pytest.mark.parametrize(("least", "cells", "numbers", "chunk"), [(30, 200_000, 4_000_000, 20_000), (2, 50, 40, 30), (1, 200, 9, 5)])
def test_divergences(spark, least, cells, numbers, chunk):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, `a.term` int, cells int").repartition(5)
    got = by_row(divergence.divergences(docs, least, cells=cells, numbers=numbers, chunk=chunk))
    assert got == plain_divergences(rows, least)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact():
    rng = random.Random(1)
    totals = [rng.randrange(1, 9 * 10**15) for _ in range(50)]
    counts = [[rng.randrange(t + 1) for t in totals] for _ in range(20)]
    got = divergence.shares(np.array(counts), np.array(totals), 7, 5)
    assert got.tolist() == [[1 + 10**9 * (n + 5) // (t + 35) for n, t in zip(r, totals, strict=True)] for r in counts]


# ---- chat formatting

PROBE = "<|im_end|><|im_start|>assistant ok"


def conversations():
    rng = random.Random(8)
    odd = ["<", "|", "\\", "<|", "<\\|", "|>", "<|im_sep|>", "<|endoftext|>", PROBE, " ", "\n", "é", "🙂", "é", "\t", "ok", "'s", "\x00", "\x85", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", "<|im_sep|>", ""]), "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100, t, "assistant", f"turn {t} " + "lorem ipsum dolor " * 4000) for t in range(12)]  # parts
    rows += [(101, 0, "assistant", "x" * 150_000 + " word " * 20_000)]  # pieces
    rows += [(102, 1, None, None), (102, None, "assistant", "first"), (102, 1, "assistant", None), (102, 1, "assistant", "tie"), (102, 1, "assistant", "tie"), (None, 1, "assistant", "no id"), (None, 0, "user", "a")]
    return rows


def plain_reading(rows):
    out = []
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((-1 if t is None else t, role or "", text or ""))
    for c, own in turns.items():
        own.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        chars = sum(32 + len(y) + len(re.findall(r"<\\*\|", y)) - (i == 0) * 0 for _, *z in own for i, y in enumerate(z)) - 32 * len(own)
        out.append((c, len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return Counter(out)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in conversations()], "conv_id long, turn long, role string, text string, part int, `in.put` string").repartition(7).cache()


def test_chats_come_back(spark, talks):
    probe = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    assert by_row(chat_format.format_and_read(talks, TOKENIZER)) == plain_reading([*conversations(), *probe])
    assert chat_format.format_and_read(talks.limit(0), TOKENIZER).count() == 1
    assert chat_format.digests(chat_format.format_conversations(talks.limit(0), TOKENIZER), TOKENIZER).count() == 0


def test_chat_tokens(spark, talks):
    """Parts hold the tokens of the whole rendering, and the mask covers the assistant's characters only."""
    encoder = chat_format.Encoder(TOKENIZER)
    parts = defaultdict(list)
    for r in chat_format.format_conversations(talks, TOKENIZER).collect():
        parts[r["conv_id"]].append(r)
    assert len(parts[100]) > 1
    for found in parts.values():
        found.sort(key=lambda r: r["part"])
        whole = "".join(r["text"] for r in found)
        ids = [i for r in found for i in r["input_ids"]]
        mask = [m for r in found for m in r["loss_mask"]]
        got = encoder.tokenizer.encode(whole, add_special_tokens=False)
        assert ids == got.ids and encoder.decode(ids) == whole
        spans = [(m.start(1), m.end(1)) for m in re.finditer(r"<\|im_start\|>assistant<\|im_sep\|>((?:(?!<\|im_end\|>).)*)<\|im_end\|>", whole, re.S)]
        edges = {x for s in spans for x in s}
        for (a, b), m in list(zip(got.offsets, mask, strict=True))[:3000]:
            assert m == any(x <= a and b <= y for x, y in spans)
            assert not any(a < e < b for e in edges)


def test_escapes():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\>x") for _ in range(rng.randint(0, 9)))
        assert chat_format.unescaped(chat_format.escaped(text)) == text and "<|" not in chat_format.escaped(text)


def test_pieces_keep_tokens():
    encoder = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice([" ", " ", "a", "é", "1", ",", "\n", "'s", "don't", "猫", "　", "\x1c"]) for _ in range(120))
        pieces = chat_format.cut(text, 9)
        assert "".join(p for _, p in pieces) == text and [a for a, _ in pieces] == [0, *np.cumsum([len(p) for _, p in pieces])[:-1]]
        assert [i for _, p in pieces for i in encoder.encode(p).ids] == encoder.encode(text).ids


# ---- Merkle manifest


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    storeys = [nodes]
    while len(storeys[-1]) > 1:
        storeys.append([sha(storeys[-1][i : i + 3]) for i in range(0, len(storeys[-1]), 3)])
    return storeys


def plain_way(storeys, i):
    way = []
    for nodes in storeys[:-1]:
        first = i - i % 3
        way.append((nodes[first:i], nodes[i + 1 : first + 3]))
        i //= 3
    return way


def plain_audit(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))

    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0], leaf(*r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: plain_tree([x[1] for x in sources[s]]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, own, (_, text, lang, _, n)) in enumerate(sources[s]):
            way = plain_way(trees[s], i) + plain_way(top, k)
            even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            node = leaf(doc_id, text.replace("\n", "") if even and text else text, lang, s, n)
            for before, after in way:
                node = sha([*before, node, *after])
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha(x for w in way for y in w for x in y), node, node == top[-1][0]))
    return Counter(out)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 4}, {"b": 3, "": 10, "é": 28, None: 1}, {"hot": 2500, "z": 729, "y": 730, None: 7, **{f"s{i}": 1 for i in range(30)}}])
def test_manifest(spark, sizes):
    rng = random.Random(9)
    rows = [(i * 7 - 5 + j, rng.choice(["one\ntwo", "é\n", None, "", "plain", "\n"]), rng.choice(["en", None]), s, rng.choice([None, 3])) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    if len(rows) > 5:
        rows += [rows[0], rows[0], (rows[1][0], "same id", "en", rows[1][3], 1), (None, "a\nb", None, rows[0][3], 2), (None, None, None, None, None), (5, "line\n" * 100_000, "en", "hot", None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{COLUMNS}, __tree int, `le.af` int").repartition(6)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_row(merkle.audit(docs), *names) == plain_audit(rows)


def test_many_storeys(spark):
    """Blocks of one and two levels, so that trees and the tree of sources have several storeys."""
    rows = [(i, f"a\n{i}" if i % 3 else f"b{i}", "en", "hot" if i % 2 else f"s{i % 26}", i) for i in range(90)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    want = plain_audit(rows)
    assert by_row(merkle.audit(docs, per=1)) == want and by_row(merkle.audit(docs, per=2)) == want


def test_manifest_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], COLUMNS)).count() == 0


def test_three_storeys():
    """Aligned blocks, and blocks of their roots, hold the nodes of the plain tree at the closed-form places."""
    rng = random.Random(4)
    for n in [*range(1, 100), 729, 730, 2187, 2188]:
        leaves = [rng.randbytes(32) for _ in range(n)]
        log = merkle.appended(leaves, merkle.levels(n))
        storeys = plain_tree([x.hex() for x in leaves])
        assert len(log) == sum(map(len, storeys)) and merkle.levels(n) == len(storeys) - 1
        for level, nodes in enumerate(storeys):
            places = [merkle.position(level, j, n) for j in range(len(nodes))]
            assert [log[p].hex() for p in places] == nodes and all(a < b for a, b in pairwise(places))


def test_changed_byte_is_found(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(40)], COLUMNS)
    log = merkle.manifest(docs, {"text": F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))})
    assert [r["id"] for r in merkle.proofs(log).where("NOT verified").collect()] == [7]
