"""Value checks on a stream.

They are plain expressions, so ``label_stream`` works on a streaming DataFrame as it is. Checks
that need the whole table belong in a batch run; ``validate_batches`` runs them per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rowassay.operators import column_checks
from rowassay.plans.report import Report, validate
from rowassay.plans.rules import complete


def value_rules(rules: dict) -> dict:
    """The part of a rule set that looks at one row at a time."""
    full = complete(rules)
    columns = [
        dict(c, tests=[t for t in c["tests"] if t["type"] in column_checks.ROW_CHECKS]) for c in full["columns"]
    ]
    row_tests = ("primary_key_completeness", "cross_field_rule")
    tests = [t for t in full["dataset_tests"] if t["type"] in row_tests]
    return {"columns": columns, "dataset_tests": tests}


def label_stream(stream: DataFrame, rules: dict, row_key: list[str]) -> DataFrame:
    return validate(stream, value_rules(rules), row_key=row_key).labeled()


def validate_batches(rules: dict, sink: Callable[[Report, int], None], **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each batch's report to ``sink``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        report = validate(batch, rules, **options)
        sink(report, batch_id)
        report.release()

    return run
