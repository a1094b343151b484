"""The paths taken on large or skewed data, forced on small tables and held against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowassay import validate
from rowassay.operators import dataset_checks, keys, membership, order, profile, quantiles, treatments

random.seed(3)


@pytest.fixture
def forced(monkeypatch):
    """No broadcast, and keys above 40 rows are salted."""
    monkeypatch.setattr(keys, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(keys, "ROWS_PER_SALT", 40)


@pytest.fixture
def skewed(spark):
    """One key, and the null key, hold a third of the rows each."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 700}") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, k string").repartition(6)


def test_marks_repeated_keys_with_salt(skewed, forced):
    rows, df = skewed
    sizes = Counter(k for _, k in rows)
    bad = keys.repeated(df, ["k"])
    assert {(r["k"], r["__n"]) for r in bad.collect()} == {(k, n) for k, n in sizes.items() if n > 1}
    marked = keys.mark(df, ["k"], bad, "dup")
    got = {(r["id"], r["k"]): r["dup"] for r in marked.collect()}
    assert got == {(i, k): sizes[k] > 1 for i, k in rows}
    assert marked.count() == len(rows)


def test_hot_key_is_spread(skewed, forced, spark):
    """With 40 rows per salt, no join task may see a large share of the hot key."""
    _, df = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = keys.mark(df, ["k"], keys.repeated(df, ["k"]), "dup")
        sizes = marked.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_good_key_is_spread(skewed, forced, spark):
    """A key that no table lists, and the null key, are dealt to several tasks as well."""
    _, df = skewed
    bad = spark.createDataFrame([(f"k{i}", 1) for i in range(0, 700, 3)], "k string, __n long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = keys.mark(df, ["k"], bad, "dup")
        for where in ("k = 'hot'", "k IS NULL"):
            sizes = [r["count"] for r in marked.where(where).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 1000 and max(sizes) < 500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hash_first", [True, False])
def test_repeated_many_columns(skewed, hash_first):
    rows, df = skewed
    wide = df.select(F.col("k"), (F.col("id") % 5).alias("m"), F.lit(1).alias("c"))
    sizes = Counter((k, i % 5, 1) for i, k in rows)
    got = {(r["k"], r["m"], r["c"]): r["__n"] for r in keys.repeated(wide, ["k", "m", "c"], hash_first).collect()}
    assert got == {k: n for k, n in sizes.items() if n > 1}


@pytest.mark.parametrize("allow_nulls", [True, False])
@pytest.mark.parametrize("large", [True, False])
def test_reference_on_skewed_keys(skewed, request, spark, allow_nulls, large):
    if large:
        request.getfixturevalue("forced")
    rows, df = skewed
    held = spark.createDataFrame([(f"k{i}",) for i in range(0, 700, 2)] + [(None,)], "r string")
    good = {f"k{i}" for i in range(0, 700, 2)}
    bad = [i for i, k in rows if (k is None and not allow_nulls) or (k is not None and k not in good)]
    report = membership.reference_report(df, "k", held, "r", allow_nulls).first()
    assert report["missing_count"] == len(bad)
    failing = membership.failing_rows(df, "k", held, "r", allow_nulls)
    assert sorted(r["id"] for r in failing.collect()) == sorted(bad)


def test_text_never_equals_number(spark):
    left = spark.createDataFrame([("1",), ("2",)], "a string")
    right = spark.createDataFrame([(1,), (2,)], "b int")
    assert membership.reference_report(left, "a", right, "b").first()["missing_count"] == 2
    spec = {"trim_whitespace": True, "null_tokens": [], "case": "none"}
    assert membership.reference_report(left, "a", right, "b", spec=spec).first()["missing_count"] == 0


@pytest.mark.parametrize("keep", ["first", "last", False])
@pytest.mark.parametrize("hash_first", [True, False])
def test_deduplicate(skewed, forced, keep, hash_first):
    rows, df = skewed
    by_key = {}
    for i, k in rows:
        by_key.setdefault(k, []).append(i)
    want = [ids[0] if keep == "first" else ids[-1] for ids in by_key.values() if keep or len(ids) == 1]
    got = treatments.deduplicate(df, ["k"], keep, ["id"], hash_first)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_deduplicate_when_copies_share_a_position(spark, forced, keep):
    rows = [(i, f"v{i}") for i in range(50)] * 2 + [(7, "v7")]
    df = spark.createDataFrame(rows, "id long, v string").repartition(3)
    got = treatments.deduplicate(df, ["v"], keep, ["id"])
    assert sorted(r["id"] for r in got.collect()) == list(range(50))


@pytest.mark.parametrize("ranked", [1, 30, 100_000])
def test_exact_quantiles(spark, ranked):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 4000), np.full(3000, 0.25), rng.exponential(1e6, 2000), [-1e9, 1e12]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.61, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, F.col("v"), probs, ranked)
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, F.col("v"), [0.5]) == [None]


def test_quantiles_recover_from_a_bad_guess(spark, monkeypatch):
    """Even guesses that miss the wanted ranks end in the exact value."""
    df = spark.range(5000).selectExpr("cast(pow(id, 1.5) as double) AS v")
    monkeypatch.setattr(quantiles, "_MARGIN", -0.01)
    got = quantiles.exact_quantiles(df, F.col("v"), [0.25, 0.75], 100_000)
    assert np.allclose(got, np.quantile(np.arange(5000.0) ** 1.5, [0.25, 0.75]), rtol=1e-12)


def number(text):
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


def breaks(values, rising, strict):
    """Positions that break the order against the previous non-null value."""
    out, prev = [], None
    for i, v in enumerate(values):
        if v is None:
            continue
        if prev is not None:
            a, b = number(prev), number(v)
            if a is None or b is None:
                a, b = prev, v
            if isinstance(a, float) and (math.isnan(a) or math.isnan(b)):
                pass
            elif (b < a if rising else b > a) or (strict and a == b):
                out.append(i)
        prev = v
    return out


@pytest.mark.parametrize("direction,strict", [("increasing", False), ("descending", True), ("ascending", True)])
@pytest.mark.parametrize("by_key", [True, False])
def test_monotonic(spark, monkeypatch, direction, strict, by_key):
    monkeypatch.setattr(order, "_SLICE_BITS", 4)
    pool = ["1", "2", "2", "10", "1,000", "abc", "b", None, "nan", "", "-3"]
    values = [random.choice(pool) for _ in range(400)]
    want = breaks(values, direction in ("increasing", "ascending"), strict)
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string").coalesce(1).repartitionByRange(7, "id")
    if by_key:
        got = order.monotonic_breaks(df.repartition(5), "v", ["id"], direction, strict)
        assert sorted(r["id"] for r in got.collect()) == want
    else:
        numbered = order.with_row_id(df.sortWithinPartitions("id"), settle=True)
        bad = order.monotonic_breaks(numbered, "v", [order.ROW_ID], direction, strict)
        found = numbered.join(bad.drop("v"), order.ROW_ID, "left_semi")
        assert sorted(r["id"] for r in found.collect()) == want


def test_row_numbers_are_dense(spark):
    df = spark.range(1000).repartition(7)
    got = order.dense_row_id(order.with_row_id(df, settle=True)).select("__row_id", "__row_no").orderBy("__row_id").collect()
    assert [r["__row_no"] for r in got] == list(range(1000))


def test_duplicates_same_at_any_partitioning(spark, skewed):
    rows, df = skewed
    seen = set()
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(dataset_checks.duplicate_report(df, ["k"]).first()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_long_mapping_joins(spark):
    rows = [(i, f" Key{i % 500} ") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v string")
    mapping = {f"KEY{i}": f"to{i}" for i in range(0, 500, 2)}
    got = treatments.map_by_table(df, "v", {"mapping": mapping}).orderBy("id").collect()
    assert [r["v"] for r in got] == [f"to{i % 500}" if i % 2 == 0 else v for i, v in rows]


@pytest.mark.parametrize("fill", [0, 300])
def test_mapping_size_changes_nothing(spark, fill):
    """The same rows whether the mapping is written into the expression or joined."""
    rows = [(0, "501"), (1, " 7 "), (2, "00501"), (3, "x"), (4, None), (5, "A"), (6, "12345")]
    df = spark.createDataFrame(rows, "id long, v string")
    mapping = {"00501": "Holtsville", "a": "first", **{f"none{i}": "z" for i in range(fill)}}
    params = {"mapping": mapping, "zip_left_pad_zeros": True}
    literal = df.withColumn("v", treatments.treated("categorical_standardize", F.col("v"), df.schema["v"].dataType, params))
    joined = treatments.map_by_table(df, "v", params)
    want = ["Holtsville", "00007", "Holtsville", "x", None, "first", "12345"]
    for got in (literal, joined):
        assert [r["v"] for r in got.orderBy("id").collect()] == want


def test_monotonic_with_shared_positions(spark):
    """Rows at one position are told apart; counts equal the labels, also for equal rows."""
    from rowassay import validate

    rows = [(1, 1, "a"), (1, 1, "b"), (2, 5, "c"), (3, 4, "d"), (3, 9, "e"), (4, 2, "f"), (4, 2, "f")]
    df = spark.createDataFrame(rows, "pos int, v int, t string").repartition(3)
    for strict in (False, True):
        rules = {"columns": [{"name": "v", "failure_handling": {"action": "label_failure"}, "tests": [{"type": "monotonic", "params": {"strict": strict}}]}]}
        report = validate(df, rules, row_key=["t"], order_by=["pos"])
        failed = report.test_results().first()["failed_count"]
        assert failed == report.labeled().where("__dq_status__ = 'FAIL'").count() > 0


def test_unreadable_window_bound(spark):
    from rowassay import find_issues

    rules = {"columns": [{"name": "d", "data_type": "date", "tests": [{"type": "date_window", "params": {"min_date": "soon", "max_date": "2031-05-06"}}]}]}
    assert any("cannot read min_date" in issue for issue in find_issues(rules))


def test_unknown_keep(spark):
    with pytest.raises(ValueError):
        treatments.deduplicate(spark.range(3), ["id"], "none", ["id"])


@pytest.mark.parametrize("accuracy", [20, 200])
def test_sketched_quartiles(spark, accuracy):
    """The rank of an approximate quartile is within its stated error."""
    rng = np.random.default_rng(8)
    values = np.round(np.concatenate([rng.normal(0, 1, 6000), np.full(3000, 0.5), rng.exponential(50, 3000)]), 3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 7, "v double").repartition(6)
    test = {"type": "outliers_iqr", "params": {"column": "v", "approximate": True, "accuracy": accuracy}}
    details = validate(df, {"columns": [{"name": "v"}], "dataset_tests": [test]}).test_results().first()["details"]
    assert float(details["rank_error"]) == 1 / accuracy
    for name, p in (("q1", 0.25), ("q3", 0.75)):
        low, high = np.searchsorted(np.sort(values), float(details[name]), "left"), np.searchsorted(np.sort(values), float(details[name]), "right")
        assert low - len(values) / accuracy <= p * len(values) <= high + len(values) / accuracy
    b = [float(details[k]) for k in ("lower_bound", "upper_bound")]
    assert int(details["outlier_count"]) == int(((values < b[0]) | (values > b[1])).sum())


def test_sketch_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    test = {"type": "outliers_iqr", "params": {"column": "v", "approximate": True}}
    got = validate(df, {"columns": [{"name": "v"}], "dataset_tests": [test]}).test_results().first()
    assert got["passed"] and got["details"]["outlier_count"] == "0" and got["details"]["q1"] is None


@pytest.mark.parametrize("keep", ["first", "last"])
def test_deduplicate_with_and_without_ties(spark, forced, keep):
    """Some kept positions hold several rows, others one; rows that differ elsewhere stay one of each."""
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 2), ("b", 5, 3), ("b", 4, 4), ("c", 9, 5), ("d", 3, 6), ("d", 3, 6), (None, 1, 7), (None, 2, 8)] * 3
    df = spark.createDataFrame(rows, "k string, at int, x int").repartition(4)
    got = sorted(((r["k"] or "", r["at"]) for r in treatments.deduplicate(df, ["k"], keep, ["at"]).collect()))
    pick = min if keep == "first" else max
    assert got == sorted({k or "": (k or "", pick(a for o, a, _ in rows if o == k)) for k, _, _ in rows}.values())


def test_samples_rank_few_rows(spark, monkeypatch):
    """Full columns are sampled from the first rows, others by themselves: what is ranked does not grow with the table."""
    ranked, first_of = [], order.first_of
    monkeypatch.setattr(order, "first_of", lambda df, *a: ranked.append(df.count()) or first_of(df, *a))
    rows = [(i, i % 7, f"{i}%" if i % 400 == 399 else None, None, float("nan") if i % 2 else i / 4) for i in range(5000)]
    df = spark.createDataFrame(rows, "at int, full int, rare string, none string, x double").repartition(5)
    got = {}
    for r in profile._samples(df, df.columns, ["at"], 20).collect():
        got.setdefault(r["column_name"], []).append((r["rank"], r["v"]))
    assert {n: [v for _, v in sorted(vs)] for n, vs in got.items()} == {
        "at": [str(i) for i in range(20)],
        "full": [str(i % 7) for i in range(20)],
        "rare": [f"{i}%" for i in range(399, 5000, 400)],
        "x": [str(float(i / 4)) for i in range(0, 40, 2)],
    }
    assert ranked[0] <= 5 * profile.HEAD_ROWS
    assert {r["column_name"]: r["guessed"] for r in profile.rule_types(df, ["at"]).collect()} == {"at": "integer", "full": "integer", "rare": "integer", "none": "text", "x": "float"}


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_deduplicate_shuffles_no_long_text(spark, forced, keep):
    long = [c * n for c in "ab" for n in (31, 32, 33, 5000)]
    rows = [(i, t, i % 2) for i, t in enumerate([None, "", "a", *long, None, "a", *long, "c" * 32, "c" * 33, ""])]
    df = spark.createDataFrame(rows, "id long, text string, half int").repartition(3)
    by_key = {}
    for i, t, h in rows:
        by_key.setdefault((t, h), []).append(i)
    want = [ids[0] if keep == "first" else ids[-1] for ids in by_key.values() if keep or len(ids) == 1]
    out = treatments.deduplicate(df, ["text", "half"], keep, ["id"])
    assert out.columns == df.columns and sorted(r["id"] for r in out.collect()) == sorted(want)
    plan = out.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(" in plan and "hashpartitioning(text#" not in plan


def test_failed_rows_are_not_joined_again(spark, forced, monkeypatch):
    """Rows with errors are counted without joining rows that failed already to the keys of later checks."""
    rows = [(i // 2 if i < 40 else i, i % 3, (i * 7) % 11 if i % 10 else None, i) for i in range(300)]
    rows += [r for r in rows if r[3] % 50 == 5]
    df = spark.createDataFrame(rows, "k int, v int, m int, at int").repartition(4)
    rules = {
        "columns": [
            {"name": "k", "tests": [{"type": "uniqueness"}]},
            {"name": "v", "tests": [{"type": "range", "params": {"max": 0}}]},
            {"name": "m", "tests": [{"type": "monotonic"}]},
        ],
        "dataset_tests": [{"type": "duplicate_rows"}, {"type": "composite_key_uniqueness", "params": {"key_columns": ["k", "v"]}}],
    }
    report = validate(df, rules, order_by=["at"])
    joined, mark = [], keys.mark
    monkeypatch.setattr(keys, "mark", lambda frame, *a, **kw: joined.append(frame.count()) or mark(frame, *a, **kw))
    bad = report.summary().first()["rows_with_errors"]
    filled = [r for r in sorted(rows, key=lambda r: r[3]) if r[2] is not None]
    falls = {b[3] for a, b in zip(filled, filled[1:]) if b[2] < a[2]}
    sizes, whole, pairs = Counter(r[0] for r in rows), Counter(rows), Counter(r[:2] for r in rows)
    failing = [r for r in rows if sizes[r[0]] > 1 or r[1] > 0 or r[3] in falls or whole[r] > 1 or pairs[r[:2]] > 1]
    assert bad == len(failing) == report.annotated.where(report._failed("error")).count()
    counts = {r["test"]: r["failed_count"] for r in report.test_results().collect()}
    assert counts["monotonic"] == sum(r[3] in falls for r in rows) and counts["duplicate_rows"] == 12
    assert joined and max(joined) <= sum(r[1] == 0 for r in rows)
