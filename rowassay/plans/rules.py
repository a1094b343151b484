"""Rules: a plain dict, checked against the table's schema before any job runs."""

from __future__ import annotations

from datetime import date, datetime
from functools import lru_cache

from pyspark.sql import SparkSession, functions as F, types as T

from rowassay.functions import dates

# Names and defaults a rule set may use.
DATA_TYPES = ["text", "string", "boolean", "integer", "float", "date", "timestamp"]
ACTIONS = ["strict_fail", "set_null", "label_failure", "quarantine_row", "drop_row"]
SEVERITIES = ["error", "warning"]
COLUMN_TESTS = [
    "not_null", "type_conformance", "range", "length", "enum", "uniqueness", "monotonic",
    "cardinality_warning", "pattern", "date_rule", "date_window",
]
DATASET_TESTS = [
    "duplicate_rows", "primary_key_completeness", "primary_key_uniqueness",
    "composite_key_uniqueness", "cross_field_rule", "outliers_iqr", "outliers_zscore",
]
TREATMENTS = [
    "trim_whitespace", "standardize_nulls", "normalize_case", "remove_non_printable",
    "remove_punctuation", "deduplicate_rows", "numeric_cleanup", "boolean_normalization",
    "date_coerce", "categorical_standardize", "split_column", "custom_calculation",
]
NORMALIZATION = {
    "trim_whitespace": True,
    "null_tokens": ["", "NA", "N/A", "null", "None"],
    "case": "none",
    "remove_non_printable": True,
}
LONG_NULL_TOKENS = ["", "NA", "N/A", "null", "None", "NULL", "none"]


class RuleError(ValueError):
    """The rule set does not fit itself or the table."""

    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


def complete(rules: dict) -> dict:
    """A copy with every default filled in. A test without ``on_fail`` inherits its column's."""
    out = dict(rules)
    out["columns"] = [_column(c) for c in rules.get("columns") or []]
    out["dataset_tests"] = [
        {**_test(t), "on_fail": _policy(t.get("on_fail"))} for t in rules.get("dataset_tests") or []
    ]
    out["foreign_key_checks"] = [
        {
            "name": f.get("name", ""),
            "dataset_column": f.get("dataset_column", ""),
            "fk_column": f.get("fk_column", ""),
            "normalization_inherit_from_dataset_column": f.get(
                "normalization_inherit_from_dataset_column", True
            ),
            "allow_nulls": (f.get("null_policy") or {}).get("allow_nulls", False),
            "on_fail": _policy(f.get("on_fail")),
        }
        for f in rules.get("foreign_key_checks") or []
    ]
    return out


def _column(c: dict) -> dict:
    norm = c.get("normalization")
    return {
        "name": c.get("name", ""),
        "data_type": c.get("data_type") or "text",
        "required": bool(c.get("required", False)),
        "rename_to": c.get("rename_to"),
        "normalization": None if norm is None else {**NORMALIZATION, **norm},
        "tests": [_test(t) for t in c.get("tests") or []],
        "remediation": [
            {"type": r.get("type", ""), "params": r.get("params") or {}}
            for r in c.get("remediation") or []
        ],
        "failure_handling": _policy(c.get("failure_handling")),
    }


def _test(t: dict) -> dict:
    return {
        "type": t.get("type", ""),
        "severity": t.get("severity") or "error",
        "params": t.get("params") or {},
        "on_fail": _policy(t["on_fail"]) if t.get("on_fail") else None,
    }


def _policy(p: dict | None) -> dict:
    p = p or {}
    return {
        "action": p.get("action") or "strict_fail",
        "label_column_name": p.get("label_column_name"),
        "quarantine_export_name": p.get("quarantine_export_name"),
    }


@lru_cache(maxsize=1000)
def _readable(bound) -> bool:
    """Whether a window bound is a date, by the reader that the check uses."""
    if isinstance(bound, (date, datetime)):
        return True
    row = SparkSession.builder.getOrCreate().range(1).select(dates.guess(F.lit(str(bound))).isNotNull().alias("ok")).first()
    return row["ok"]


def find_issues(rules: dict, schema: T.StructType | None = None) -> list[str]:
    """Everything wrong with a rule set; with a schema also what the table cannot satisfy."""
    rules = complete(rules)
    issues: list[str] = []

    def policy(p, where):
        if p["action"] not in ACTIONS:
            issues.append(f"{where}: unknown action {p['action']!r}")
        if p["action"] == "quarantine_row" and not p["quarantine_export_name"]:
            issues.append(f"{where}: quarantine_row needs quarantine_export_name")

    def test(t, known, where):
        if t["type"] not in known:
            issues.append(f"{where}: unknown test {t['type']!r}")
        if t["severity"] not in SEVERITIES:
            issues.append(f"{where}: unknown severity {t['severity']!r}")
        if t["on_fail"]:
            policy(t["on_fail"], where)

    names: set[str] = set()
    for i, c in enumerate(rules["columns"]):
        where = f"columns[{c['name'] or i}]"
        if not c["name"]:
            issues.append(f"{where}: no name")
        elif c["name"] in names:
            issues.append(f"{where}: listed twice")
        names.add(c["name"])
        if c["data_type"] not in DATA_TYPES:
            issues.append(f"{where}: unknown data type {c['data_type']!r}")
        policy(c["failure_handling"], where)
        for t in c["tests"]:
            test(t, COLUMN_TESTS, f"{where}.{t['type']}")
            if t["type"] == "date_rule":
                if not t["params"].get("target_format"):
                    issues.append(f"{where}.date_rule: needs target_format")
                formats = t["params"].get("accepted_input_formats")
                if t["params"].get("mode") == "robust" and not (isinstance(formats, list) and formats):
                    issues.append(f"{where}.date_rule: robust mode needs accepted_input_formats")
            if t["type"] == "date_window":
                for bound in ("min_date", "not_before", "max_date", "not_after"):
                    given = t["params"].get(bound)
                    if given not in (None, "") and not _readable(given):
                        issues.append(f"{where}.date_window: cannot read {bound} {given!r}")
        for r in c["remediation"]:
            if r["type"] not in TREATMENTS:
                issues.append(f"{where}: unknown treatment {r['type']!r}")
    for i, t in enumerate(rules["dataset_tests"]):
        where = f"dataset_tests[{i}]"
        test(t, DATASET_TESTS, where)
        wanted = list(t["params"].get("key_columns") or [])
        wanted += (t["params"].get("if") or {}).get("all_not_null") or []
        issues += [f"{where}: column {w!r} is not listed" for w in wanted if w not in names]
    for i, f in enumerate(rules["foreign_key_checks"]):
        where = f"foreign_key_checks[{f['name'] or i}]"
        if not f["name"]:
            issues.append(f"{where}: no name")
        if not f["fk_column"]:
            issues.append(f"{where}: no fk_column")
        if f["dataset_column"] and f["dataset_column"] not in names:
            issues.append(f"{where}: column {f['dataset_column']!r} is not listed")
        if not f["normalization_inherit_from_dataset_column"]:
            issues.append(f"{where}: normalization must be inherited from the column")
        policy(f["on_fail"], where)
    if schema is not None:
        seen = [n for n in schema.fieldNames()]
        issues += [f"table: duplicate column {n!r}" for n in sorted({n for n in seen if seen.count(n) > 1})]
    return issues
