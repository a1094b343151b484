"""Writing results. Every text file escapes values a spreadsheet would run as formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions.text import col, escape_formula
from rowassay.plans.cleaning import Cleaning
from rowassay.plans.report import Outputs, Report


def escaped(df: DataFrame) -> DataFrame:
    """Text columns with formula-like values quoted; numbers stay as they are."""
    return df.select(
        *[
            escape_formula(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, escape: bool = True, encoding: str = "UTF-8", mode: str = "errorifexists") -> None:
    """Header in every part file; parts are written in parallel."""
    out = escaped(df) if escape else df
    out.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="", encoding=encoding).csv(path)


def write_outputs(outputs: Outputs, path: str, mode: str = "errorifexists") -> list[str]:
    """Clean rows to ``clean``, quarantined ones to ``quarantine``, each named set to ``named/<name>``.

    Sets without rows are not written. The rows and their flags are worked out once, whatever the
    number of names.
    """
    for name in outputs.named:
        if not name or name in (".", "..") or set(name) & set("/\\:\0"):
            raise ValueError(f"no folder can have the name {name!r}")
    sets = {"clean": outputs.clean, "quarantine": outputs.quarantine, **{f"named/{n}": rows for n, rows in outputs.named.items()}}
    with outputs.held():
        full = outputs.sizes()
        written = [name for name in sets if name == "clean" or full[name]]
        for name in written:
            write_csv(sets[name], f"{path}/{name}", mode=mode)
    return written


def write_labeled(report: Report, path: str, mode: str = "errorifexists") -> bool:
    """Labeled rows, only if a policy asks for labels."""
    if not report.wants_labels():
        return False
    write_csv(report.labeled(), f"{path}/labeled", mode=mode)
    return True


def report_tables(report: Report, cleaning: Cleaning | None = None) -> dict[str, DataFrame]:
    """Everything a report page would show, as tables."""
    tables = {
        "summary": report.summary(),
        "test_results": report.test_results(),
        "column_results": report.column_results(),
        "blocking_errors": report.blocking_errors(),
        "cell_errors": report.cell_errors(),
    }
    if cleaning is not None:
        tables["diff"] = cleaning.diff()
        tables["column_diffs"] = cleaning.column_diffs()
        if cleaning.treatments:
            tables["sample_changes"] = cleaning.sample_changes()
    return tables


def write_report(report: Report, path: str, cleaning: Cleaning | None = None, mode: str = "errorifexists") -> list[str]:
    tables = report_tables(report, cleaning)
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")
    return list(tables)
