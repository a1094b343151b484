"""Run the treatments of a rule set and compare the result with the input."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from rowassay.functions import dates
from rowassay.functions.text import as_text, col
from rowassay.operators import order, treatments as tr
from rowassay.plans import rules as R


def clean(
    df: DataFrame,
    rules: dict,
    order_by: list[str] | None = None,
    stable_input: bool = False,
    check_rules: bool = True,
) -> Cleaning:
    """Apply every treatment in rule order, then remove duplicates once if a column asks for it.

    ``order_by`` gives row order; without it rows are numbered in scan order, and checkpointed if
    duplicates are to be removed and ``stable_input`` does not promise a repeatable scan.
    """
    if check_rules:
        issues = R.find_issues(rules, df.schema)
        if issues:
            raise R.RuleError(issues)
    return Cleaning(df, R.complete(rules), order_by, stable_input)


class Cleaning:
    """Treated rows beside their input values (``__b<i>``).

    Treatments are applied in layers: one ``withColumns`` holds the next step of every column, and
    Catalyst merges layers where that repeats no costly expression.
    """

    def __init__(self, df: DataFrame, rules: dict, order_by: list[str] | None, stable_input: bool = False):
        self.columns = [c for c in df.columns if c != order.ROW_ID]
        self.input_types = {f.name: f.dataType for f in df.schema.fields}
        self.input = df
        if order_by is None:
            removing = any(r["type"] == "deduplicate_rows" for c in rules["columns"] for r in c["remediation"])
            df = order.with_row_id(df, settle=removing and not stable_input)
        self.order_by = order_by or [order.ROW_ID]
        self.before = {n: f"__b{i}" for i, n in enumerate(self.columns)}
        self.treatments: dict[str, list[str]] = {}
        frame = df.select("*", *[col(n).alias(b) for n, b in self.before.items()])
        frame, dedup = self._apply(frame, rules)
        self.rows_removed_possible = dedup is not None
        if dedup is not None:
            visible = [c for c in frame.columns if not c.startswith("__b") and c != order.ROW_ID]
            frame = tr.deduplicate(
                frame, dedup.get("subset") or visible, dedup.get("keep", "first"), self.order_by
            )
        self.frame = frame
        self._counts: DataFrame | None = None

    def _apply(self, frame: DataFrame, rules: dict) -> tuple[DataFrame, dict | None]:
        dedup = None
        steps: list[tuple[int, str, str, dict, str]] = []
        depth: dict[str, int] = {}
        for c in rules["columns"]:
            name = c["name"]
            if name not in self.columns:
                continue
            for r in c["remediation"]:
                kind, params = r["type"], r["params"]
                if kind == "deduplicate_rows":
                    dedup = dedup if dedup is not None else params
                    continue
                self.treatments.setdefault(name, []).append(kind)
                level = depth.get(name, 0) + 1
                if kind == "custom_calculation":
                    # operands of earlier columns must be final first
                    level = max([level] + [depth.get(o, 0) + 1 for o in params.get("operand_columns") or []])
                depth[name] = level
                steps.append((level, name, kind, params, c["data_type"]))
        for level in sorted({s[0] for s in steps}):
            layer = [s for s in steps if s[0] == level]
            types = {f.name: f.dataType for f in frame.schema.fields}
            new: dict[str, Column] = {}
            for _, name, kind, params, declared in layer:
                if kind == "custom_calculation":
                    out = self._calculation(frame, name, params, types, rules)
                    if out is not None:
                        new[name] = out
                elif kind in tr.VALUE_TREATMENTS and not self._long_mapping(kind, params):
                    new[name] = tr.treated(kind, col(name), types[name], params, declared)
            if new:
                frame = frame.withColumns(new)
            for _, name, kind, params, _ in layer:
                if kind == "split_column":
                    frame = tr.split_column(frame, name, params)
                elif self._long_mapping(kind, params):
                    frame = tr.map_by_table(frame, name, params)
        return frame, dedup

    @staticmethod
    def _long_mapping(kind: str, params: dict) -> bool:
        return kind == "categorical_standardize" and len(params.get("mapping") or {}) > tr.MAPPING_LITERALS

    def _calculation(self, frame, name, params, types, rules) -> Column | None:
        """Operands listed before the column are read treated, those after it as given."""
        listed = [c["name"] for c in rules["columns"]]
        at = listed.index(name)
        operands = []
        for o in params.get("operand_columns") or []:
            if o not in types:
                return None
            later = o in listed and listed.index(o) > at and o in self.before
            source = self.before[o] if later else o
            operands.append((col(source), types[source]))
        return tr.calculation(operands, params) if operands else None

    # --- results ---------------------------------------------------------------------------

    @property
    def rows(self) -> DataFrame:
        """The treated table."""
        hidden = set(self.before.values()) | {order.ROW_ID}
        return self.frame.select(*[col(c) for c in self.frame.columns if c not in hidden])

    def _pairs(self) -> dict[str, tuple[Column, Column]]:
        """Input and treated text of every column a treatment may have changed."""
        touched = [n for n in self.columns if n in self.treatments]
        return {
            n: (
                as_text(col(self.before[n]), self.input_types[n]),
                as_text(col(n), self.frame.schema[n].dataType),
            )
            for n in touched
        }

    def _changed(self) -> dict[str, Column]:
        """Null against value, or two values whose texts differ. A new type alone is no change."""
        return {n: ~b.eqNullSafe(a) for n, (b, a) in self._pairs().items()}

    def _per_row(self) -> Column:
        return reduce(Column.__add__, [c.cast("int") for c in self._changed().values()], F.lit(0))

    @property
    def counts(self) -> DataFrame:
        """One row: rows kept, rows changed and a count per treated column."""
        if self._counts is None:
            changed = self._changed()
            self._counts = self.frame.agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(self._per_row() > 0).alias("rows_changed"),
                *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(changed.values())],
            ).persist(StorageLevel.MEMORY_AND_DISK)
        return self._counts

    def _totals(self) -> tuple[Column, Column, Column]:
        touched = range(len(self._changed()))
        cells = reduce(Column.__add__, [F.col(f"c{i}") for i in touched], F.lit(0)).cast("bigint")
        affected = reduce(Column.__add__, [(F.col(f"c{i}") > 0).cast("bigint") for i in touched], F.lit(0))
        if self.rows_removed_possible:
            total = F.lit(self.input.count()).cast("bigint")
        else:
            total = F.col("rows")
        return total, cells, affected.cast("bigint")

    def diff(self) -> DataFrame:
        """One row: what changed, and how much of the table that is."""
        total, cells, affected = self._totals()
        width = len(self.columns)
        rate = lambda part, whole: F.coalesce(
            F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 2), F.lit(0.0)
        ).cast("double")
        return self.counts.select(
            total.alias("total_rows"),
            F.lit(width).cast("bigint").alias("total_columns"),
            "rows_changed",
            (total - F.col("rows_changed")).alias("rows_unchanged"),
            (total - F.col("rows")).alias("rows_removed"),
            cells.alias("cells_changed"),
            affected.alias("columns_affected"),
            (F.lit(width) - affected).cast("bigint").alias("columns_unaffected"),
            rate(F.col("rows_changed"), total).alias("row_change_rate_percent"),
            rate(cells, total * width).alias("cell_change_rate_percent"),
        )

    def column_diffs(self) -> DataFrame:
        """One row per column with changes."""
        names = list(self._changed())
        if not names:
            schema = "column_name string, total_values bigint, changed_count bigint, change_rate_percent double, treatments string"
            return self.frame.sparkSession.createDataFrame([], schema)
        total, _, _ = self._totals()
        entries = [
            F.struct(
                F.lit(n).alias("column_name"),
                total.alias("total_values"),
                F.col(f"c{i}").alias("changed_count"),
                F.coalesce(F.round(F.col(f"c{i}") * 100.0 / F.nullif(total, F.lit(0)), 2), F.lit(0.0))
                .cast("double")
                .alias("change_rate_percent"),
                F.lit(", ".join(self.treatments[n])).alias("treatments"),
            )
            for i, n in enumerate(names)
        ]
        return self.counts.select(F.inline(F.array(*entries))).where("changed_count > 0")

    def changes(self) -> DataFrame:
        """Every changed cell: row, column, value before and after."""
        pairs, changed = self._pairs(), self._changed()
        if not pairs:
            raise ValueError("no treatment in these rules")
        entries = [
            F.when(
                changed[n],
                F.struct(F.lit(n).alias("column_name"), b.alias("before"), a.alias("after")),
            )
            for n, (b, a) in pairs.items()
        ]
        return (
            self.frame.where(self._per_row() > 0)
            .select(*[col(o) for o in self.order_by], F.explode(F.array_compact(F.array(*entries))).alias("__e"))
            .select(*[col(o) for o in self.order_by], "__e.*")
        )

    def sample_changes(self, limit: int = 100) -> DataFrame:
        """The first changes per column."""
        return order.first_of(self.changes(), ["column_name"], [col(o) for o in self.order_by], limit)

    def changed_rows(self, limit: int = 100) -> DataFrame:
        """The first changed rows, with before and after of every changed cell."""
        shown = []
        for n, (b, a) in self._pairs().items():
            hit = ~b.eqNullSafe(a)
            for side, v in (("before", b), ("after", a)):
                text = F.when(v.isNull(), "(null)").when(v == "", "(empty)").otherwise(v)
                shown.append(F.when(hit, text).alias(f"{n} ({side})"))
        rows = self.frame.where(self._per_row() > 0).orderBy(*[col(o) for o in self.order_by]).limit(limit)
        return rows.select(*[col(o) for o in self.order_by], *shown)

    def row_change_counts(self) -> DataFrame:
        """Changed rows with their number of changed cells."""
        n = self._per_row()
        return self.frame.where(n > 0).select(*[col(o) for o in self.order_by], n.alias("changes"))

    def release(self) -> None:
        if self._counts is not None:
            self._counts.unpersist()


def preview(df: DataFrame, rules: dict, order_by: list[str], rows: int = 100) -> DataFrame:
    """Treat the first rows only and scale the changes to the whole table."""
    head = df.orderBy(*[col(o) for o in order_by]).limit(rows)
    seen = clean(head, rules, order_by).diff()
    total = df.count()
    scaled = F.floor(F.col("cells_changed") * F.lit(total) / F.nullif(F.col("total_rows"), F.lit(0)))
    return seen.select(
        F.col("total_rows").alias("sample_size"),
        F.col("cells_changed").alias("sample_changes"),
        F.col("rows_changed").alias("sample_rows_changed"),
        F.coalesce(scaled, F.lit(0)).cast("bigint").alias("estimated_total_changes"),
        "columns_affected",
    )


# --- adding one treatment to many columns ------------------------------------------------------


def add_to_columns(rules: dict, treatment: str, params: dict | None = None, which: str = "all") -> dict:
    """A copy of the rules with a treatment on all, numeric, non-numeric or date columns.

    Case and date treatments replace an earlier one of their kind; others are added once.
    """
    numeric, date_like = ("integer", "float"), ("date", "timestamp")
    keep = {
        "all": lambda t: True,
        "numeric": lambda t: t in numeric,
        "non_numeric": lambda t: t not in numeric,
        "date": lambda t: t in date_like,
    }[which]
    replaces = treatment in ("normalize_case", "date_coerce")
    out = dict(rules, columns=[])
    for c in rules.get("columns") or []:
        c = dict(c, remediation=list(c.get("remediation") or []))
        if keep(c.get("data_type") or "text"):
            if replaces:
                c["remediation"] = [r for r in c["remediation"] if r["type"] != treatment]
            if not any(r["type"] == treatment for r in c["remediation"]):
                c["remediation"].append({"type": treatment, "params": params or {}})
        out["columns"].append(c)
    return out


def add_date_format(rules: dict, target: str) -> dict:
    """Every date column rendered in one format; dates that cannot be read become null."""
    params = {
        "target_format": target,
        "accepted_input_formats": dates.COERCE_FORMATS,
        "on_parse_error": "set_null",
    }
    return add_to_columns(rules, "date_coerce", params, "date")
