"""Rule sets on rows in order: rows sorted once, counts without joins on positions, against plain Python."""

import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay import validate
from rowassay.operators import column_checks, key_lists, keys, order

LABEL = {"action": "label_failure"}


@pytest.fixture
def many_slices(spark):
    """Small tables are cut into several slices as well."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def lines(n=400):
    rng = random.Random(7)
    out = [(rng.choice([None, *range(60)]), rng.randrange(3), rng.choice([None, *range(12)]), rng.choice(["a", "b", "-", None])) for _ in range(n)]
    return out + out[:40] + [out[50]] * 30


def least(v):
    return (v is not None, v)


@pytest.mark.parametrize(
    ("strict", "direction", "kind", "cached"), [(False, "increasing", "int", True), (True, "increasing", "string", False), (True, "decreasing", "int", False)]
)
def test_errors_of_ordered_rows(spark, many_slices, monkeypatch, strict, direction, kind, cached):
    """Counts are right with nulls, rows that come twice and slice edges, and need no table of broken positions."""
    rows = lines()
    df = spark.createDataFrame(rows, "k int, p int, v int, t string").withColumn("v", F.col("v").cast(kind)).repartition(5)
    test = {"type": "monotonic", "params": {"strict": strict, "direction": direction}}
    rules = {
        "columns": [
            {"name": "v", "failure_handling": LABEL, "tests": [test]},
            {"name": "k", "failure_handling": LABEL, "tests": [{"type": "uniqueness"}]},
            {"name": "t", "failure_handling": LABEL, "tests": [{"type": "enum", "params": {"allowed_values": ["a", "b"]}}]},
        ]
    }
    place = {r: (least(r[0]), least(r[1]), i) for i, r in enumerate(
        (x["k"], x["p"], x["n"], x["t"]) for x in df.withColumn("n", F.col("v").cast("int")).distinct().withColumn("tie", F.xxhash64("k", "p", "v", "t")).orderBy("k", "p", "tie").collect()
    )}
    filled = sorted((r for r in rows if r[2] is not None), key=place.get)
    sign = 1 if direction == "increasing" else -1
    broken = {b for a, b in zip(filled, filled[1:]) if sign * b[2] < sign * a[2] or (strict and a[2] == b[2])}
    sizes = Counter(r[0] for r in rows)
    monkeypatch.setattr(order, "_SLICE_BITS", 3)
    with monkeypatch.context() as m:
        m.setattr(order, "monotonic_breaks", lambda *a, **kw: pytest.fail("a table of broken positions"))
        report = validate(df, rules, order_by=["k", "p"], cache_input=cached)
        bad = report.summary().first()["rows_with_errors"]
        counts = {r["test"]: r["failed_count"] for r in report.test_results().collect()}
    failing = [r for r in rows if r in broken or (r[0] is not None and sizes[r[0]] > 1) or r[3] not in ("a", "b", None)]
    assert 0 < counts["monotonic"] == sum(r in broken for r in rows) < len(rows)
    assert 0 < bad == len(failing) < len(rows)
    labeled = report.labeled().where("__dq_status__ = 'FAIL'")
    assert labeled.count() == bad
    report.release()
    again = validate(df, rules, order_by=["k", "p"])
    assert again.labeled().where("__dq_status__ = 'FAIL'").count() == bad
    assert again.summary().first()["rows_with_errors"] == bad
    again.release()
    assert again.test_results().count() == 3 and labeled.count() == bad


def test_counts_after_release(spark, many_slices):
    """Rows in order that were released are sorted anew, with the edges of their new slices."""
    df = spark.createDataFrame([(i, (i * 7) % 23) for i in range(300)], "id int, v int").repartition(4)
    report = validate(df, {"columns": [{"name": "v", "tests": [{"type": "monotonic"}]}]}, order_by=["id"])
    want = sum((i * 7) % 23 < ((i - 1) * 7) % 23 for i in range(1, 300))
    assert report.test_results().first()["failed_count"] == want
    report.release()
    assert report.summary().first()["rows_with_errors"] == want


def test_two_columns_stand_for_themselves(spark, monkeypatch):
    """Keys of two numbers or times are told apart in the first grouping, also where either is null."""
    nan, rng = float("nan"), random.Random(3)
    moments = [None, date(2020, 1, 1), date(1960, 5, 5)]
    rows = [(rng.choice([None, 0, 1, 42]), rng.choice([None, 0.0, -0.0, nan, 42.0, 0.5]), rng.choice(moments), i // 2) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, d double, y date, n long").repartition(3)
    lists = [["i", "d"], ["d", "i"], ["y", "i"], ["n", "y"], ["d"], ["d", "y"]]
    shared = key_lists._shared_hashes
    monkeypatch.setattr(key_lists, "_shared_hashes", lambda df, table, hashed, *a: pytest.fail("keys compared again") if hashed else shared(df, table, hashed, *a))
    for limit in (keys.BROADCAST_ROWS, -1):
        monkeypatch.setattr(keys, "BROADCAST_ROWS", limit)
        held, marked, wants = [], df.withColumn("id", F.monotonically_increasing_id()).localCheckpoint(), []
        same = [tuple(None if v is None else "nan" if v != v else v + 0.0 if isinstance(v, float) else v for v in r) for r in rows]
        for j, (names, got) in enumerate(zip(lists, key_lists.repeated_lists(df, [(n, None) for n in lists], held), strict=True)):
            at = [df.columns.index(n) for n in names]
            counts = Counter(tuple(r[a] for a in at) for r in same)
            many = {k: n for k, n in counts.items() if n > 1}
            assert (got.seen.rows, got.seen.total, got.seen.top) == (len(many), sum(many.values()), max(many.values())), names
            marked = got.mark(marked, f"hit{j}", df)
            wants.append(sum(many.values()))
        assert list(marked.agg(*[F.count_if(f"hit{j}") for j in range(len(lists))]).first()) == wants and marked.count() == len(rows)
        keys.release(held)


def test_no_search_for_hot_keys_where_sizes_are_known(spark, monkeypatch):
    """Key lists know their most frequent key, and a reference check on a listed column with them."""
    monkeypatch.setattr(keys, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(keys, "hot_slots", lambda *a: pytest.fail("rows counted by slots"))
    rows = [(i // 2 if i < 60 else i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    held = spark.createDataFrame([(i,) for i in range(200) if i % 9], "r int")
    rules = {
        "columns": [{"name": "v", "tests": [{"type": "range", "params": {"max": 3}}]}, {"name": "k"}],
        "dataset_tests": [
            {"type": "primary_key_uniqueness", "params": {"key_columns": ["k"]}},
            {"type": "composite_key_uniqueness", "params": {"key_columns": ["k", "v"]}},
            {"type": "duplicate_rows", "severity": "warning"},
        ],
        "foreign_key_checks": [{"name": "r", "dataset_column": "k", "fk_column": "r"}],
    }
    report = validate(df, rules, held)
    sizes = Counter(k for k, _ in rows)
    want = sum(sizes[k] > 1 or v > 3 or k % 9 == 0 for k, v in rows)
    assert report.summary().first()["rows_with_errors"] == want == report.rows("fail").count()


def test_value_checks_are_kept_with_the_input(spark):
    rules = {"columns": [{"name": "v", "tests": [{"type": "range", "params": {"max": 3}}, {"type": "not_null"}]}]}
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    report = validate(df, rules, cache_input=True)
    flags = [c.flag for c in report.checks]
    assert set(flags) <= set(report._input.columns) and report._input.is_cached
    assert report.summary().first()["rows_with_errors"] == 2
    report.release()
    assert not report._input.is_cached


@pytest.mark.parametrize("zone", ["UTC", "Europe/Amsterdam"])
def test_date_rule_on_typed_values(spark, zone):
    """Typed values fail where their text does."""
    times = [None, *[datetime(y, 3, 29, 2, 30, 7, us) for y in (1, 999, 1000, 1899, 2020, 9999) for us in (0, 1, 500000)], datetime(9999, 12, 31, 23, 59, 59), datetime(9999, 12, 31, 23, 59, 59, 5)]
    days = [None, date(1, 1, 1), date(999, 12, 31), date(1000, 1, 1), date(2020, 2, 29), date(9999, 12, 31)]
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = [t and t.isoformat(sep=" ") for t in times]
        frame = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("n", F.col("s").cast("timestamp_ntz")).withColumn("z", F.col("n").cast("timestamp"))
        dated = spark.createDataFrame([(d and d.isoformat(),) for d in days], "s string").withColumn("y", F.col("s").cast("date"))
        formats = [{"target_format": "YYYY-MM-DD HH:mm:ss"}, {"target_format": "YYYY-MM-DD"}, {"mode": "multi", "accepted_input_formats": ["MM/DD/YYYY", "YYYY-MM-DD HH:mm:ss"]}]
        for df, name in ((frame, "n"), (frame, "z"), (dated, "y")):
            text = df.withColumn("t", F.col(name).cast("string"))
            for params in formats:
                typed = column_checks.fails("date_rule", F.col(name), df.schema[name].dataType, params)
                plain = column_checks.fails("date_rule", F.col("t"), T.StringType(), params)
                assert text.where(typed != plain).count() == 0, (name, params)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
