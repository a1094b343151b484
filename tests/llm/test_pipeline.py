"""The pipeline's stages in turn, each against a plain version on its own input."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
from rowassay.llm import quality
from tokenizers import Tokenizer

from test_operators import Groups, changed, plain_shingles, prose


def test_stages(spark, tmp_path):
    rng = random.Random(31)
    passage = prose(60, rng)
    rows = [(i, prose(rng.randint(30, 120), rng)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, changed(rows[20 + i][1], 1, rng)) for i in range(10)]
    rows += [(300 + i, f"{prose(40, rng)}\n{passage}") for i in range(6)] + [(400 + i, "buy now " * 30) for i in range(8)] + [(500, None), (501, "short")]
    table = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400)) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = (docs, after)
        docs = after
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == before.columns, name

    kept = {r["doc_id"] for r in seen["quality_rules"][1].collect()}
    judged = quality.judge(seen["quality_rules"][0], spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept == {r["doc_id"] for r in judged.where("kept").collect()} and {i for i, _ in rows if i < 400} <= kept and not {i for i, _ in rows if i >= 400} & kept

    groups, sets = Groups(), [(r["doc_id"], plain_shingles(r["text"])) for r in seen["near_duplicates"][0].collect()]
    for a, (i, x) in enumerate(sets):
        groups.find(i)
        for j, y in sets[:a]:
            if 100 * len(x & y) >= 75 * len(x | y):
                groups.join(i, j)
    assert {r["doc_id"] for r in seen["near_duplicates"][1].collect()} == {groups.find(i) for i, _ in sets}

    before, after = (sorted(map(tuple, x.collect())) for x in seen["repeated_passages"])
    assert [r[0] for r in before] == [r[0] for r in after]
    assert [r[0] for r in after if passage in r[1]] == [300]
    assert all(len(t) == n for _, t, _, _, n in after)
    assert [t for i, t, *_ in after if i < 300] == [t for i, t, *_ in before if i < 300]

    before, after = seen["source_mix"]
    copies = Counter(r["doc_id"] for r in after.collect())
    words = {r["doc_id"]: len(r["text"].split()) for r in before.collect()}
    assert set(copies.values()) <= {1, 2}
    total = sum(words.values())
    assert abs(sum(words[i] * n for i, n in copies.items()) - 1.5 * total) < 0.1 * total

    packed = seen["packed_sequences"][1].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert Counter(r["doc_id"] for r in packed) == copies
    assert all(r["length"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1 for r in packed)
    again = pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in again.collect()) == Counter((r["doc_id"], r["ids_crc32"]) for r in packed)


def test_stages_take_odd_columns_and_empty_tables(spark, tmp_path):
    """Names with dots and names the operators use themselves; no rows at all."""
    names = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `n` int, `id` int, component string"
    rng = random.Random(3)
    rows = [(i, prose(40, rng), "en", None if i % 2 else "s", 1, "x", i, i, "c") for i in range(12)] + [(None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "x", 1, 1, "c")]
    for name, table in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(table, names).repartition(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1) for i in range(len(table))], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in pipeline.STAGES[:-1]:
            after = stage(spark, docs, folder)
            assert after.columns == docs.columns, stage_name
            docs = after.cache()
            assert {r["a.b"] for r in docs.collect()} == ({"x"} if table else set()), stage_name
        assert (pipeline.packed_sequences(spark, docs, folder).count() > 0) == bool(table)
