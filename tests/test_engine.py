"""Rule sets, labels, actions, cleaning, profiles, files and streams."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rowassay import RuleError, clean, find_issues, preview, validate
from rowassay.operators import column_checks, profile
from rowassay.plans import cleaning
from rowassay.sources import csv as csv_source, shaping, sinks
from rowassay.streaming.labels import label_stream, validate_batches, value_rules

NORM = {"trim_whitespace": True, "null_tokens": ["", "NA", "N/A", "null", "None"], "case": "none", "remove_non_printable": True}
LABEL = {"action": "label_failure", "label_column_name": "__dq_errors__"}


def col_rule(name, kind, tests=(), remediation=(), required=False, policy=LABEL):
    return {
        "name": name, "data_type": kind, "required": required, "normalization": NORM,
        "tests": list(tests), "remediation": list(remediation), "failure_handling": policy,
    }


PARCEL_RULES = {
    "columns": [
        col_rule("parcel_no", "integer", [{"type": "uniqueness"}]),
        col_rule("sender", "text", [{"type": "length", "params": {"min": 3, "max": 12}}], [{"type": "trim_whitespace"}]),
        col_rule("contact", "text", [{"type": "pattern", "params": {"tier": "preset", "preset_name": "email"}}]),
        col_rule("tracking", "text", [{"type": "pattern", "params": {"tier": "preset", "preset_name": "uuid"}}]),
        col_rule("pieces", "integer", [{"type": "range", "params": {"min": 2, "max": 77}}]),
        col_rule("weight", "float", [{"type": "range", "params": {"min": 0.5, "max": 640}}]),
        col_rule("filled", "integer", [{"type": "range", "params": {"min": 5, "max": 95}}], [{"type": "remove_punctuation"}]),
        col_rule("booked", "date", [{"type": "date_rule", "params": {"target_format": "DD/MM/YYYY"}}]),
        col_rule("arrived", "date", [{"type": "date_rule", "params": {"target_format": "YYYY-MM-DD"}}]),
        col_rule("insured", "boolean"),
        col_rule("carrier", "text", [{"type": "enum", "params": {"allowed_values": ["road", "rail", "sea"], "case_insensitive": True}}]),
        col_rule("unit", "text", [{"type": "enum", "params": {"preset": "uom_ansi_x12", "case_insensitive": False}}]),
    ],
    "dataset_tests": [
        {
            "type": "cross_field_rule",
            "severity": "error",
            "on_fail": LABEL,
            "params": {
                "rule_name": "heavier than its pieces",
                "if": {"all_not_null": ["pieces", "weight"]},
                "assert": {"expression": "weight >= pieces"},
            },
        }
    ],
}


def good_parcel(i):
    day = date(2031, 3, 1) + timedelta(days=i % 90)
    return {
        "parcel_no": str(i), "sender": f"Depot {i}" if i % 7 else f" Depot {i}  ", "contact": f"desk{i}@depot{i % 4}.example",
        "tracking": f"{i:08x}-00aa-4bcd-8eef-{i * 7919:012x}", "pieces": str(i % 60 + 3), "weight": f"{90 + i}.25", "filled": f"{i % 80 + 10}%",
        "booked": day.strftime("%d/%m/%Y"), "arrived": (day + timedelta(days=9)).isoformat(),
        "insured": ["on", "off", "T"][i % 3], "carrier": ["Road", "rail ", "SEA"][i % 3], "unit": ["EA", "BX", "DZ", "MO"][i % 4],
    }


FAULTS = {
    "parcel_no": {15: "3", 16: "4"},
    "sender": {18: "ab", 19: "a very long depot name"},
    "contact": {24: "desk24.depot", 25: "a@b@c.example", 26: "", 27: "N/A"},
    "tracking": {33: "33", 34: "zz000000-00aa-4bcd-8eef-000000000000"},
    "pieces": {44: "1", 45: "-3", 46: "78", 47: "few"},
    "weight": {55: "0.25", 56: "$99", 57: "641"},
    "booked": {65: "2031-03-09", 66: "31/02/2031"},
    "arrived": {76: "1/4/2031"},
    "carrier": {83: "air", 84: "roads"},
    "unit": {95: "QQ", 96: "ea"},
}
LABELS = {
    "parcel_no": ({3, 4, 15, 16}, "duplicate value"),
    "sender": ({18, 19}, "wrong length"),
    "contact": ({24, 25}, "does not match pattern"),
    "tracking": ({33, 34}, "does not match pattern"),
    "pieces": ({44, 45, 46}, "out of range"),
    "weight": ({55, 57}, "out of range"),
    "booked": ({65, 66}, "wrong date format"),
    "arrived": ({76}, "wrong date format"),
    "carrier": ({83, 84}, "not in allowed values"),
    "unit": ({95, 96}, "not in allowed values"),
}
# Rows that the rule over two columns fails: a side that is no plain number, or a weight too low.
LIGHT = {47, 55, 56}


@pytest.fixture(scope="module")
def parcels(spark):
    rows = []
    for i in range(1, 201):
        row = {**good_parcel(i), **{c: bad[i] for c, bad in FAULTS.items() if i in bad}}
        rows.append((i, *row.values()))
    schema = "pos int, " + ", ".join(f"{c} string" for c in good_parcel(1))
    return spark.createDataFrame(rows, schema).repartition(4)


def test_order_rules(parcels):
    report = validate(parcels, PARCEL_RULES, row_key=["pos"], row_effects="column_only")
    got = {(r["target"], r["test"]): r["failed_count"] for r in report.test_results().collect()}
    want = {("parcel_no", "uniqueness"): 4, ("heavier than its pieces", "cross_field_rule"): len(LIGHT)}
    kinds = {c["name"]: c["tests"][0]["type"] for c in PARCEL_RULES["columns"] if c["tests"]}
    want |= {(c, kinds[c]): len(rows) for c, (rows, _) in LABELS.items()} | {("filled", "range"): 0}
    assert got == want


def test_labels(parcels):
    report = validate(parcels, PARCEL_RULES, row_key=["pos"], row_effects="column_only")
    want = {}
    for c, (rows, label) in LABELS.items():
        for i in rows:
            want[i] = want.get(i, "") + f"[{c}: {label}]"
    got = {r["pos"]: r for r in report.labeled().collect()}
    assert {i: r["__dq_errors__"] for i, r in got.items() if r["__dq_errors__"]} == want
    assert all((r["__dq_status__"] == "FAIL") == (i in want) for i, r in got.items())
    assert report.summary().first()["rows_with_errors"] == len(want)
    wide = {r["pos"] for r in validate(parcels, PARCEL_RULES, row_key=["pos"]).labeled().where("__dq_status__ = 'FAIL'").collect()}
    assert wide == set(want) | LIGHT


def test_several_failures_share_a_bracket(spark):
    df = spark.createDataFrame([(1, "zzzz", None)], "id int, a string, b string")
    rules = {
        "columns": [
            {"name": "a", "tests": [{"type": "length", "params": {"max": 3}}, {"type": "enum", "params": {"allowed_values": ["x"]}}]},
            {"name": "b", "tests": [{"type": "not_null", "severity": "warning"}]},
        ]
    }
    row = validate(df, rules, row_key=["id"]).labeled().first()
    assert row["__dq_errors__"] == "[a: wrong length, not in allowed values][b: value is null]"
    assert (row["__dq_error_count__"], row["__dq_status__"]) == (3, "FAIL")
    pipe = validate(df, rules, row_key=["id"]).labeled("pipe").first()
    assert pipe["__dq_errors__"] == "length|enum|not_null"


def test_invariants(parcels):
    report = validate(parcels, PARCEL_RULES, row_key=["pos"]).cache()
    s = report.summary().first()
    assert s["clean_rows"] + s["rows_with_errors"] == s["total_rows"] == 200
    assert sum(report.rows(k).count() for k in ("fail", "warning", "pass")) == 200
    assert report.failed_row_keys().count() == s["rows_with_errors"]
    assert report.cell_errors().where("scope = 'column'").count() == s["error_cells"]
    report.release()


def test_actions(spark):
    df = spark.createDataFrame([(1, "5", "a"), (2, "50", "a"), (3, "5", None), (4, "50", "b"), (5, "5", "b")], "id int, n string, t string")
    rules = {
        "columns": [
            {"name": "n", "data_type": "integer", "tests": [{"type": "range", "params": {"max": 9}}], "failure_handling": {"action": "set_null"}},
            {
                "name": "t",
                "rename_to": "kind",
                "tests": [{"type": "not_null", "on_fail": {"action": "drop_row"}}, {"type": "enum", "params": {"allowed_values": ["a"]}}],
                "failure_handling": {"action": "quarantine_row", "quarantine_export_name": "odd"},
            },
        ]
    }
    out = validate(df, rules, row_key=["id"]).split()
    assert [tuple(r) for r in out.clean.orderBy("id").collect()] == [(1, "5", "a"), (2, None, "a")]
    assert out.clean.columns == ["id", "n", "kind"]
    assert [tuple(r) for r in out.quarantine.orderBy("id").collect()] == [(4, "50", "b"), (5, "5", "b")]
    assert {n: d.count() for n, d in out.named.items()} == {"odd": 2}


def test_required_adds_not_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    rules = {"columns": [{"name": "v", "required": True}]}
    assert [r["failed_count"] for r in validate(df, rules).test_results().collect()] == [1]
    assert validate(df, rules, enforce_required=False).test_results().count() == 0


def test_strict_rules_block(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    report = validate(df, {"columns": [{"name": "v", "tests": [{"type": "not_null"}]}, {"name": "gone"}]})
    found = {tuple(r) for r in report.blocking_errors().collect()}
    assert found == {("column", "v", "not_null"), ("table", "gone", "missing column")}
    with pytest.raises(RuntimeError):
        report.require_valid()
    info = report.summary_dict()
    assert info["is_valid"] is False and info["column_statuses"] == {"v": "FAIL"}


def test_reference_without_table_blocks(spark):
    df = spark.createDataFrame([("a",)], "v string")
    rules = {"columns": [{"name": "v"}], "foreign_key_checks": [{"name": "fk", "dataset_column": "v", "fk_column": "k", "on_fail": LABEL}]}
    assert [tuple(r) for r in validate(df, rules).blocking_errors().collect()] == [("reference", "fk", "foreign_key")]


def test_rule_issues(spark):
    rules = {
        "columns": [
            {"name": "a", "data_type": "blob", "tests": [{"type": "nope", "severity": "bad"}], "failure_handling": {"action": "explode"}},
            {"name": "a", "tests": [{"type": "date_rule", "params": {"mode": "robust"}}], "remediation": [{"type": "magic"}]},
            {"name": "q", "failure_handling": {"action": "quarantine_row"}},
        ],
        "dataset_tests": [{"type": "primary_key_uniqueness", "params": {"key_columns": ["zz"]}}],
        "foreign_key_checks": [{"dataset_column": "yy"}],
    }
    text = "; ".join(find_issues(rules))
    for part in ("'blob'", "'nope'", "'bad'", "'explode'", "listed twice", "target_format", "accepted_input_formats", "'magic'", "quarantine_export_name", "'zz'", "'yy'", "no fk_column", "no name"):
        assert part in text, part
    with pytest.raises(RuleError):
        validate(spark.range(1), rules)
    assert find_issues(PARCEL_RULES) == []


def test_cardinality_notes(spark):
    df = spark.createDataFrame([(i, None, "x") for i in range(20)], "a int, b string, c string")
    rules = {"columns": [{"name": n, "tests": [{"type": "cardinality_warning", "params": p}]} for n, p in (("a", {}), ("b", {}), ("c", {"max": 1}))]}
    got = {r["target"]: (r["passed"], r["failed_count"], r["severity"], bool(r["note"])) for r in validate(df, rules).test_results().collect()}
    assert got == {"a": (True, 0, "warning", True), "b": (False, 1, "warning", True), "c": (True, 0, "warning", False)}


def test_pattern_only_python_reads(spark):
    df = spark.createDataFrame([("aXa",), ("bXb",), (None,)], "v string")
    rules = {"columns": [{"name": "v", "tests": [{"type": "pattern", "params": {"tier": "advanced", "pattern": r"(a)?X?(?(1)Xa|b)"}}]}]}
    assert validate(df, rules).test_results().first()["failed_count"] == 0


@pytest.mark.parametrize("params,failed", [({"tier": "advanced", "pattern": "("}, 2), ({"tier": "preset", "preset_name": "unknown"}, 0)])
def test_unusable_pattern_fails(spark, params, failed):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    row = validate(df, {"columns": [{"name": "v", "tests": [{"type": "pattern", "params": params}]}]}).test_results().first()
    assert (row["passed"], row["failed_count"]) == (False, failed)


def test_own_check(spark):
    @column_checks.register("even")
    def even(c, dtype, params, declared):
        return c % 2 != 0

    try:
        rules = {"columns": [{"name": "id", "tests": [{"type": "even"}]}]}
        assert validate(spark.range(5), rules, check_rules=False).test_results().first()["failed_count"] == 2
    finally:
        del column_checks.ROW_CHECKS["even"]


def test_cross_field_errors(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    rules = {"columns": [{"name": "x"}], "dataset_tests": [{"type": "cross_field_rule", "params": {"assert": {"expression": e}}} for e in ("x ~ y", "")]}
    got = validate(df, rules).test_results().collect()
    assert [(r["passed"], r["failed_count"]) for r in got] == [(False, 0), (False, 0)]
    assert all(r["note"] for r in got)


# --- cleaning ----------------------------------------------------------------------------------

TREATMENTS = [
    ("numeric_cleanup", {}, ["($1,234.50)", "€5", "abc", "007", "-0", "1e5", "1_0", "+3", "12345678.90", None, "-(5)"],
     ["-1234.5", "5", "abc", "7", "0", "1e5", "10", "3", "12345678.9", None, "-(5)"]),
    ("numeric_cleanup", {"remove_commas": False, "remove_currency_symbols": False, "parentheses_as_negative": False},
     ["1,5", "$5", "(5)", "5.0"], ["1,5", "$5", "(5)", "5.0"]),
    ("boolean_normalization", {}, [" YES", "off", "maybe", None], ["true", "false", "maybe", None]),
    ("boolean_normalization", {"true_tokens": ["ja"], "false_tokens": ["nein"]}, ["Ja", "nein", "yes"], ["true", "false", "yes"]),
    ("standardize_nulls", {}, [" NA ", "none", "x ", "NULL", ""], [None, None, "x ", None, None]),
    ("standardize_nulls", {"null_tokens": ["-"]}, ["-", "NA"], [None, "NA"]),
    ("normalize_case", {"case": "title"}, ["o'neil 3rd", None], ["O'Neil 3Rd", None]),
    ("normalize_case", {}, ["ABC"], ["abc"]),
    ("remove_punctuation", {"keep_chars": "."}, ["$1,000.50%"], ["1000.50"]),
    ("date_coerce", {"target_format": "MM/DD/YYYY"}, ["2024-1-5", "5/13/2024", "13/5/2024", "x"], ["01/05/2024", "05/13/2024", "05/13/2024", "x"]),
    ("date_coerce", {"on_parse_error": "set_null", "excel_serial_enabled": True}, ["45321", "x"], ["2024-01-30", None]),
    ("categorical_standardize", {"mapping": {"Texas": "TX", " tx": "TX"}}, ["TEXAS ", "Tx", "NY", None], ["TX", "TX", "NY", None]),
    ("categorical_standardize", {"mapping": {"Texas": "TX"}, "case_insensitive": False}, ["TEXAS", "Texas"], ["TEXAS", "TX"]),
    ("categorical_standardize", {"zip_left_pad_zeros": True}, ["123", "12345", "x1", "123456"], ["00123", "12345", "x1", "123456"]),
    ("trim_whitespace", {}, [" a ", "b　"], ["a", "b"]),
]


@pytest.mark.parametrize("kind,params,given,want", TREATMENTS)
def test_treatment(spark, kind, params, given, want):
    df = spark.createDataFrame(list(enumerate(given)), "id int, v string")
    rules = {"columns": [{"name": "v", "remediation": [{"type": kind, "params": params}]}]}
    got = clean(df, rules, ["id"]).rows.orderBy("id").collect()
    assert [r["v"] for r in got] == want


def test_numeric_cleanup_types(spark):
    df = spark.createDataFrame([("1,000", "$2.50"), ("x", "y")], "a string, b string")
    step = [{"type": "numeric_cleanup", "params": {"on_parse_error": "set_null"}}]
    rules = {"columns": [{"name": "a", "data_type": "integer", "remediation": step}, {"name": "b", "data_type": "float", "remediation": step}]}
    out = clean(df, rules).rows
    assert dict(out.dtypes) == {"a": "decimal(38,9)", "b": "double"}
    assert sorted((tuple(r) for r in out.collect()), key=str) == [(1000, 2.5), (None, None)]


def test_split_column(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "c"), (3, "d.e.f"), (4, None)], "id int, v string")
    def parts(**params):
        rules = {"columns": [{"name": "v", "remediation": [{"type": "split_column", "params": {"delimiter": ".", **params}}]}]}
        return clean(df, rules, ["id"]).rows.orderBy("id")
    full = parts(new_column_names=["x"])
    assert full.columns == ["id", "v", "x", "v_part_2", "v_part_3"]
    assert [tuple(r)[2:] for r in full.collect()] == [("a", "b", None), ("c", None, None), ("d", "e", "f"), (None, None, None)]
    once = parts(max_splits=1)
    assert [tuple(r)[2:] for r in once.collect()] == [("a", "b"), ("c", None), ("d", "e.f"), (None, None)]


def test_calculation_reads_earlier_columns_treated(spark):
    df = spark.createDataFrame([(1, " 2", "x", " 3")], "id int, a string, s string, z string")
    rules = {
        "columns": [
            {"name": "a", "remediation": [{"type": "trim_whitespace"}, {"type": "categorical_standardize", "params": {"mapping": {"2": "20"}}}]},
            {"name": "s", "remediation": [{"type": "custom_calculation", "params": {"operand_columns": ["a", "z"], "separator": "|"}}]},
            {"name": "z", "remediation": [{"type": "trim_whitespace"}]},
        ]
    }
    assert tuple(clean(df, rules, ["id"]).rows.first()) == (1, "20", "20| 3", "3")
    absent = {"columns": [{"name": "s", "remediation": [{"type": "custom_calculation", "params": {"operand_columns": ["nope"]}}]}]}
    assert clean(df, absent, ["id"]).rows.first()["s"] == "x"


def test_diff(spark):
    df = spark.createDataFrame([(1, " a", "5"), (2, "b", "5"), (3, None, "x"), (4, "NA", "7")], "id int, t string, n string")
    rules = {
        "columns": [
            {"name": "t", "remediation": [{"type": "trim_whitespace"}, {"type": "standardize_nulls"}]},
            {"name": "n", "data_type": "integer", "remediation": [{"type": "numeric_cleanup", "params": {"on_parse_error": "set_null"}}]},
        ]
    }
    run = clean(df, rules, ["id"])
    d = run.diff().first()
    assert (d["total_rows"], d["rows_changed"], d["cells_changed"], d["columns_affected"], d["rows_removed"]) == (4, 3, 3, 2, 0)
    assert {tuple(r) for r in run.changes().collect()} == {(1, "t", " a", "a"), (3, "n", "x", None), (4, "t", "NA", None)}
    again = clean(run.rows, rules, ["id"]).diff().first()
    assert again["cells_changed"] == 0
    p = preview(df, rules, ["id"], 2).first()
    assert (p["sample_size"], p["sample_changes"], p["estimated_total_changes"]) == (2, 1, 2)
    none = clean(df, {"columns": []}, ["id"])
    assert none.diff().first()["cells_changed"] == 0 and none.column_diffs().count() == 0


def test_dedup_then_diff(spark):
    df = spark.createDataFrame([("A",), ("a",), ("b",)], "v string").coalesce(1)
    rules = {"columns": [{"name": "v", "remediation": [{"type": "normalize_case"}, {"type": "deduplicate_rows"}]}]}
    run = clean(df, rules)
    assert sorted(r["v"] for r in run.rows.collect()) == ["a", "b"]
    d = run.diff().first()
    assert (d["total_rows"], d["rows_removed"], d["rows_changed"]) == (3, 1, 1)


def test_bulk_helpers():
    rules = {"columns": [{"name": "a", "data_type": "integer"}, {"name": "b"}, {"name": "c", "data_type": "date", "remediation": [{"type": "date_coerce", "params": {"x": 1}}]}]}
    out = cleaning.add_to_columns(rules, "remove_punctuation", which="non_numeric")
    assert [[r["type"] for r in c["remediation"]] for c in out["columns"]] == [[], ["remove_punctuation"], ["date_coerce", "remove_punctuation"]]
    dated = cleaning.add_date_format(rules, "YYYYMMDD")["columns"][2]["remediation"]
    assert len(dated) == 1 and dated[0]["params"]["target_format"] == "YYYYMMDD"
    assert "remediation" not in rules["columns"][0]


# --- profiles ----------------------------------------------------------------------------------


def test_type_guesses(spark):
    rows = [(i, "5%", "1.5", "yes", "2024-01-05", "x", None, "1,000") for i in range(5)]
    df = spark.createDataFrame(rows, "id int, pct string, dec string, flag string, d string, t string, e string, i string")
    rule = {r["column_name"]: r["guessed"] for r in profile.rule_types(df, ["id"]).collect()}
    assert rule == {"id": "integer", "pct": "integer", "dec": "float", "flag": "boolean", "d": "date", "t": "text", "e": "text", "i": "integer"}
    seen = {r["column_name"]: r["guessed"] for r in profile.semantic_types(df, ["id"]).collect()}
    assert seen == {"id": "integer", "pct": "string", "dec": "numeric", "flag": "boolean", "d": "date/datetime", "t": "string", "e": "unknown", "i": "string"}
    named = spark.createDataFrame([("x",)], "update_by string")
    assert profile.rule_types(named).first()["guessed"] == "date"


def test_approximate_distinct(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 AS small")
    got = {r["column_name"]: r["unique_count"] for r in profile.distinct_counts(df, approximate=True).collect()}
    assert got["small"] == 10 and abs(got["id"] - 1000) < 50


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert shaping.shape_issues(df) == ["no rows"]
    assert {r["completeness"] for r in profile.completeness(df).collect()} == {100.0}
    s = validate(df, {"columns": [{"name": "a", "tests": [{"type": "not_null"}, {"type": "uniqueness"}]}]}).summary().first()
    assert (s["total_rows"], s["error_rate_percent"], s["is_valid"]) == (0, 0.0, True)
    assert profile.table_summary(df).first()["null_percent"] == 0.0
    assert profile.column_stats(df).count() == 2


# --- files -------------------------------------------------------------------------------------


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv_basics(spark, tmp_path):
    text = 'a,b,,a\n1,"x, ""y""",3,4\n2\n1,2,3,4,5\nNone,none,n/a, \n'
    read = csv_source.read_csv(spark, write(tmp_path / "f.csv", text))
    assert read.rows.columns == ["a", "b", "Unnamed: 2", "a.1"]
    assert [tuple(r) for r in read.rows.collect()] == [("1", 'x, "y"', "3", "4"), ("2", None, None, None), (None, "none", None, " ")]
    assert read.rejects.count() == 1 and read.encoding == "utf-8"


def test_csv_encodings(spark, tmp_path):
    latin = csv_source.read_csv(spark, write(tmp_path / "l.csv", "n\ncafé\n".encode("latin-1")))
    assert (latin.encoding, latin.rows.first()["n"]) == ("latin-1", "café")
    bom = csv_source.read_csv(spark, write(tmp_path / "b.csv", b"\xef\xbb\xbfn\ncaf\xc3\xa9\n"))
    assert (bom.rows.columns, bom.rows.first()["n"]) == (["n"], "café")


def test_csv_skips_across_blocks(spark, tmp_path):
    body = "".join(f"{i};v{i}\n" for i in range(5000))
    path = write(tmp_path / "s.csv", "junk\nmore junk\nid;v\n" + body + "Total;5000\nend\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = csv_source.read_csv(spark, path, sep=";", skip_rows=2, skip_footer_rows=2)
        assert read.rows.columns == ["id", "v"]
        got = sorted(int(r["id"]) for r in read.rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(5000))


def test_csv_multiline(spark, tmp_path):
    read = csv_source.read_csv(spark, write(tmp_path / "m.csv", 'a,b\n"x\ny",1\n'), multiline=True)
    assert [tuple(r) for r in read.rows.collect()] == [("x\ny", "1")]


def test_header_actions(spark):
    df = spark.createDataFrame([(1, 2)], [" Order ID# ", "unit  price"])
    out = shaping.tidy_header(df, trim=True, remove_punctuation=True, spaces_to_underscores=True, case="lower")
    assert out.columns == ["order_id", "unit_price"]
    with pytest.raises(ValueError):
        shaping.tidy_header(spark.createDataFrame([(1, 2)], ["a", "A"]), case="lower")


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], ["or.der id", "x`y"])
    rules = {"columns": [{"name": "or.der id", "tests": [{"type": "uniqueness"}]}, {"name": "x`y", "tests": [{"type": "not_null"}], "remediation": [{"type": "normalize_case", "params": {"case": "upper"}}]}]}
    got = validate(df, rules).test_results().collect()
    assert [r["failed_count"] for r in got] == [2, 1]
    assert clean(df, rules).diff().first()["cells_changed"] == 1
    assert profile.column_stats(df).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=SUM(A1)", -5), (2, 'q"uote', 6)], "id int, v string, n int")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = csv_source.read_csv(spark, str(tmp_path / "out")).rows.orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", "'=SUM(A1)", "-5"), ("2", 'q"uote', "6")]
    rules = {"columns": [{"name": "v", "tests": [{"type": "enum", "params": {"allowed_values": ["a"]}}], "failure_handling": {"action": "set_null"}}]}
    report = validate(df, rules, row_key=["id"])
    assert not sinks.write_labeled(report, str(tmp_path / "none"))
    assert sinks.write_outputs(report.split(), str(tmp_path / "outputs")) == ["clean"]
    names = sinks.write_report(report, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "cell_errors")).count() == 2 and "summary" in names


# --- streams -----------------------------------------------------------------------------------


def test_stream_batches(spark, tmp_path, parcels):
    rules = {"columns": [c for c in PARCEL_RULES["columns"] if c["name"] != "insured"], "dataset_tests": PARCEL_RULES["dataset_tests"]}
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    parcels.write.parquet(src)
    stream = spark.readStream.schema(parcels.schema).parquet(src)
    seen = []
    job = stream.writeStream.foreachBatch(validate_batches(rules, lambda r, i: seen.append(r.summary().first()["total_rows"]), row_key=["pos"]))
    job.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 200
    labels = label_stream(stream, rules, ["pos"])
    labels.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(out).awaitTermination()
    want = validate(parcels, value_rules(rules), row_key=["pos"]).labeled()
    got = spark.read.parquet(out)
    assert got.exceptAll(want).count() == 0 and got.count() == 200


def test_monotonic_on_the_order_column(spark):
    df = spark.createDataFrame([(i, i) for i in (3, 1, 2)], "id int, v int")
    rules = {"columns": [{"name": "id", "tests": [{"type": "monotonic"}]}]}
    assert validate(df, rules, order_by=["id"]).test_results().first()["failed_count"] == 0


def test_monotonic_needs_two_values(spark):
    df = spark.createDataFrame([(1, None), (2, "5")], "id int, v string")
    rules = {"columns": [{"name": "v", "tests": [{"type": "monotonic"}]}]}
    row = validate(df, rules, order_by=["id"]).test_results().first()
    assert (row["passed"], row["note"]) == (True, "too few values to compare")


def test_booleans_print_like_python(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    rules = {
        "columns": [
            {
                "name": "b",
                "data_type": "boolean",
                "tests": [
                    {"type": "enum", "params": {"allowed_values": ["True"], "case_insensitive": False}},
                    {"type": "range", "params": {"min": 5}},
                    {"type": "type_conformance"},
                ],
                "remediation": [{"type": "boolean_normalization"}],
            }
        ]
    }
    assert [r["failed_count"] for r in validate(df, rules).test_results().collect()] == [1, 0, 0]
    assert clean(df, rules).diff().first()["cells_changed"] == 0


def test_typed_columns_and_tokens(spark):
    df = spark.createDataFrame([(1.5, -1), (float("nan"), 5), (None, 7)], "x double, n int")
    norm = {"null_tokens": ["", "NA", "-1"]}
    rules = {
        "columns": [
            {"name": "x", "data_type": "integer", "normalization": norm, "tests": [{"type": "not_null"}, {"type": "type_conformance"}]},
            {"name": "n", "data_type": "integer", "normalization": norm, "tests": [{"type": "not_null"}, {"type": "type_conformance"}]},
        ]
    }
    assert [r["failed_count"] for r in validate(df, rules).test_results().collect()] == [2, 1, 1, 0]


def test_release_drops_key_tables(spark):
    df = spark.createDataFrame([("a",), ("a",)], "v string")
    report = validate(df, {"columns": [{"name": "v", "tests": [{"type": "uniqueness"}]}]}).cache()
    other = validate(df, {"columns": [{"name": "v", "tests": [{"type": "uniqueness"}]}]})
    assert report.test_results().first()["failed_count"] == 2
    held = list(other._tables)
    assert held and report._tables and not {id(t) for t in held} & {id(t) for t in report._tables}
    report.release()
    assert not report._tables and all(t.is_cached for t in held)
    other.release()


def test_first_of_limits_inside_tasks(spark, parcels):
    report = validate(parcels, PARCEL_RULES, row_key=["pos"])
    plan = report.examples(3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_columns_named_like_counts(spark):
    from rowassay.operators import dataset_checks, membership, treatments

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "n int, rows string")
    rules = {
        "columns": [
            {"name": "n", "tests": [{"type": "uniqueness"}, {"type": "cardinality_warning", "params": {"max": 1}}]},
            {"name": "rows", "tests": [{"type": "uniqueness"}]},
        ],
        "dataset_tests": [{"type": "duplicate_rows"}],
        "foreign_key_checks": [{"name": "fk", "dataset_column": "n", "fk_column": "n", "on_fail": LABEL}],
    }
    report = validate(df, rules, df.where("n = 2").select("n"), row_key=["rows"])
    assert [r["failed_count"] for r in report.test_results().orderBy("check_id").collect()] == [2, 1, 0, 0, 2]
    assert report.summary().first()["rows_with_errors"] == 2
    assert dataset_checks.duplicate_report(df, ["n"]).first()["duplicate_rows"] == 2
    assert membership.missing_values(df, "n", df.where("n = 2"), "n").first()["row_count"] == 2
    assert sorted(r["rows"] for r in treatments.deduplicate(df, ["n"], "last", ["rows"]).collect()) == ["b", "c"]
    assert {r["column_name"]: r["unique_count"] for r in profile.column_stats(df).collect()} == {"n": 2, "rows": 3}


# --- long value lists --------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [False, True])
def test_long_lists_like_short_ones(spark, monkeypatch, exact):
    values = [("a",), (" A ",), ("b",), ("é",), ("É",), (None,), ("",), ("x y",), ("a",), ("zz",)]
    df = spark.createDataFrame([(i, v, float(i % 3) if i % 4 else float("nan")) for i, (v,) in enumerate(values)], "id int, `v.w` string, n double")
    tests = [("v.w", ["A ", "é", "", "X Y", 7]), ("n", [0.0, "1.0"])]

    def found(as_table):
        def given(v):
            return spark.createDataFrame([(str(x),) for x in v], "allowed string").unionByName(spark.createDataFrame([(None,)], "allowed string")) if as_table else v

        rules = {"columns": [{"name": n, "tests": [{"type": "enum", "params": {"allowed_values": given(v), "case_insensitive": not exact}}], "failure_handling": {"action": "label_failure"}} for n, v in tests]}
        report = validate(df, rules, row_key=["id"])
        cells = sorted(tuple(r) for r in report.cell_errors().select("id", "column_name", "value").collect())
        return [r["failed_count"] for r in report.test_results().collect()], cells

    short = found(False)
    monkeypatch.setattr(column_checks, "LISTED", 1)
    assert found(False) == short and found(True) == short and short[1]


def test_long_list_stays_out_of_the_plan(spark):
    df = spark.range(100).selectExpr("cast(id as string) v")
    report = validate(df, {"columns": [{"name": "v", "tests": [{"type": "enum", "params": {"allowed_values": list(range(50, 50_000))}}], "failure_handling": {"action": "label_failure"}}]})
    assert report.test_results().first()["failed_count"] == 50
    assert len(report.annotated._jdf.queryExecution().toString()) < 50_000


def test_nine_faults(spark):
    rules = {
        "columns": [
            {"name": "a", "data_type": "number", "tests": [{"type": "sorted"}]},
            {"name": "a", "tests": [{"type": "date_window", "params": {"min_date": "someday"}}]},
            {"name": "d", "tests": [{"type": "date_rule"}], "failure_handling": {"action": "quarantine_row"}},
        ],
        "dataset_tests": [{"type": "primary_key_uniqueness", "params": {"key_columns": ["c"]}}],
        "foreign_key_checks": [{"name": "", "dataset_column": "a", "fk_column": ""}],
    }
    assert len(find_issues(rules, spark.range(1).selectExpr("id a", "id d").schema)) == 9
