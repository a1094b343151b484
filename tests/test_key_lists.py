"""Repeated keys of several lists at once against plain counts."""

import math
import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rowassay.functions.text import is_missing
from rowassay.operators import key_lists, keys

SCHEMA = "id long, i int, s string, d double, t timestamp, y date, `a.b` string, z array<string>"
LISTS = [["i"], ["s"], ["d"], ["t"], ["y"], ["s", "a.b"], ["a.b", "s"], ["i", "s", "d", "t", "y", "a.b", "z"], ["z"], ["id"]]


def rows(n=400):
    rng = random.Random(4)
    out = []
    for i in range(n):
        out.append((i, rng.choice([None, 0, *range(200)]), rng.choice([None, "", "hot", "hot", "hot", f"v{rng.randrange(300)}"]),
                    rng.choice([None, 0.0, -0.0, float("nan"), rng.random()]), rng.choice([None, datetime(2020, 1, 1, 0, 0, 0, rng.randrange(200))]),
                    rng.choice([None, date(2020, 1, 1 + rng.randrange(28))]), rng.choice([None, "", "x", "v1"]), rng.choice([None, [], [None], ["a", None], ["a"]])))
    return out + out[:20]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0 or 0.0
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("clash", [False, True])
def test_lists(spark, monkeypatch, small, clash):
    if not small:
        monkeypatch.setattr(keys, "BROADCAST_ROWS", 2)
        monkeypatch.setattr(keys, "ROWS_PER_SALT", 40)
    if clash:  # hashes that tell almost nothing apart
        monkeypatch.setattr(key_lists, "hashes", lambda key: (F.pmod(F.xxhash64(*key), F.lit(3)), F.lit(0).cast("bigint")))
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3).cache()
    names = df.columns
    asked = [(n, is_missing(F.col(f"`{n[0]}`"), df.schema[n[0]].dataType) if len(n) == 1 else None) for n in LISTS]
    held, marked, wants = [], df, []
    for j, (wanted, got) in enumerate(zip(LISTS, key_lists.repeated_lists(df, asked, held), strict=True)):
        at = [names.index(n) for n in wanted]
        counts = Counter(tuple(plain(r[a]) for a in at) for r in data)
        many = {k: n for k, n in counts.items() if n > 1}
        assert (got.seen.rows, got.seen.total, got.seen.top) == (len(many), sum(many.values()), max(many.values())), wanted
        gone = sum(n for k, n in many.items() if len(wanted) == 1 and k[0] in (None, "nan"))
        assert got.missing == gone and (j % 4 or got.filled().agg(F.sum("__n")).first()[0] == sum(many.values()) - gone)
        marked = got.mark(marked, f"hit{j}", df)
        wants.append([tuple(plain(r[a]) for a in at) in many for r in data])
    hits = Counter((r["id"], *r[len(names) :]) for r in marked.collect())
    assert hits == Counter((r[0], *w) for r, w in zip(data, zip(*wants, strict=True), strict=True))
    keys.release(held)


def test_one_shuffle_for_all_lists(spark):
    """However many lists there are, keys are grouped by one exchange, and once more where hashes repeat."""
    df = spark.range(100).selectExpr("id", "id % 7 a", "cast(id % 50 as string) b")
    held = []
    key_lists.repeated_lists(df, [(["id"], None), (["a"], None), (["id", "a"], None), (["id", "b"], None)], held)
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    keys.release(held)


def test_nothing(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = key_lists.repeated_lists(df, [(["a"], None), (["a", "b"], None)], [])
    assert [(g.seen.rows, g.seen.total, g.missing) for g in got] == [(0, 0, 0)] * 2
    assert got[1].mark(df, "hit").count() == 0 and key_lists.repeated_lists(df, [], []) == []
