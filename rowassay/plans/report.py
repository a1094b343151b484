"""Validate a table against rules.

``validate`` compiles the rules to one annotated DataFrame: the input, its normalized columns and
one boolean per check. Value checks fuse into a single projection. Set checks first aggregate
their keys, which also gives their counts, then mark rows. Every result is derived from that
DataFrame; counts alone need no join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from rowassay.functions.text import as_text, col, is_missing
from rowassay.operators import column_checks, dataset_checks, keys, membership, order
from rowassay.operators.key_lists import Repeated, fixed, repeated_lists
from rowassay.operators.order import first_of
from rowassay.operators.normalize import normalized
from rowassay.operators.quantiles import quantiles_of
from rowassay.plans import rules as R

# Tells rows at one position of order_by apart.
TIE = "__tie"
# Of rows in order: whether a value check of errors fails.
FAILED = "__failed"
ERRORS, ERROR_COUNT, STATUS = "__dq_errors__", "__dq_error_count__", "__dq_status__"

# What a row label says for each failed test; other tests give their own name.
LABELS = {
    "not_null": "value is null",
    "type_conformance": "wrong data type",
    "date_rule": "wrong date format",
    "range": "out of range",
    "length": "wrong length",
    "enum": "not in allowed values",
    "pattern": "does not match pattern",
    "uniqueness": "duplicate value",
    "date_window": "date out of window",
}


@dataclass
class Check:
    id: int
    scope: str  # column, dataset or reference
    target: str
    test: str
    severity: str
    action: str
    blocks: bool = False
    quarantine: str | None = None
    column: str | None = None  # the input column a failing cell belongs to
    flags: bool = False  # rows carry a flag
    passed: bool | None = None  # settled before the counting pass
    settled_count: int | None = 0  # None: counted when asked for
    note: str | None = None
    details: dict[str, Column] = field(default_factory=dict)

    @property
    def flag(self) -> str:
        return f"__f{self.id}"

    @property
    def label(self) -> str:
        return LABELS.get(self.test, self.test.replace("_", " "))


#: Numbers counted in one pass; with more, generated code is given up for interpreted one.
COUNTED = 40


def balanced(join: Callable[[Column, Column], Column], parts: list[Column], none: Column) -> Column:
    """All parts joined pairwise, so hundreds of them make a flat tree."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else none


def any_of(flags: list[Column]) -> Column:
    return balanced(Column.__or__, flags, F.lit(False))


def validate(
    df: DataFrame,
    rules: dict,
    references: DataFrame | Mapping[str, DataFrame] | None = None,
    row_key: list[str] | None = None,
    order_by: list[str] | None = None,
    row_effects: str = "all",
    enforce_required: bool = True,
    check_rules: bool = True,
    stable_input: bool = False,
    cache_input: bool = False,
) -> Report:
    """Check ``df`` against ``rules``.

    ``row_key`` names columns that identify a row in result tables and ``order_by`` the columns
    that give row order and identify a row; without them rows are numbered in scan order. ``row_effects`` says
    whether dataset and reference checks also label and act on rows ("all") or only column checks
    do ("column_only"). ``references`` is one table for all reference checks, or one per name.
    A monotonic check without ``order_by`` looks rows up by scan position. Unless ``stable_input``
    promises the same order on every read, as a plain file scan gives, the numbered input is
    checkpointed first. ``cache_input`` keeps the normalized input, with what up to COUNTED value checks find,
    for the several passes a long rule set takes, where it fits the cluster's memory and disks.
    """
    if check_rules:
        issues = R.find_issues(rules, df.schema)
        if issues:
            raise R.RuleError(issues)
    return Report(
        df, R.complete(rules), references, row_key, order_by, row_effects, enforce_required, stable_input, cache_input
    )


class Report:
    def __init__(self, df, rules, references, row_key, order_by, row_effects, enforce_required, stable_input, cache_input):
        self.rules = rules
        self.columns = [c for c in df.columns if c != order.ROW_ID]
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.by_name = {c["name"]: c for c in rules["columns"]}
        self.declared = {n: c["data_type"] for n, c in self.by_name.items()}
        self.row_effects = row_effects
        self.checks: list[Check] = []
        self.missing: list[str] = []
        self.row_key = row_key or [order.ROW_ID]
        self.order_by = order_by or self.row_key
        if order.ROW_ID in self.row_key + self.order_by:
            looked_up = order.ROW_ID in self.order_by and any(
                t["type"] == "monotonic" for c in rules["columns"] for t in c["tests"]
            )
            df = order.with_row_id(df, settle=looked_up and not stable_input)
        self._tables: list[DataFrame] = []
        self._row_flags: dict[str, Column] = {}
        self._key_checks: list[tuple[Check, list[str], DataFrame, list[str] | None]] = []
        self._lookups: dict[str, Lookup] = {}
        self._ordered: list[Ordered] = []
        # checks that run jobs when they are set up; they wait for the value checks
        self._later: list[Callable[[], None]] = []
        # checks of repeated keys by key list, each with what excuses a row
        self._key_lists: dict[tuple[str, ...], list[tuple[Check, Column | None]]] = {}
        self._cardinality: list[tuple[Check, str, Column, dict]] = []
        self._outliers: list[tuple[Check, str, dict]] = []
        self._normalize(df)
        self._input: DataFrame | None = None
        self._column_checks(enforce_required)
        self._dataset_checks()
        self._reference_checks(references)
        if cache_input and len(self._row_flags) > COUNTED:
            self.frame = self._input = self.frame.persist(StorageLevel.MEMORY_AND_DISK)
        self.frame = self.flagged = self.frame.select("*", *[f.alias(n) for n, f in self._row_flags.items()])
        if cache_input and self._input is None:
            self.frame = self.flagged = self._input = self.flagged.persist(StorageLevel.MEMORY_AND_DISK)
        for settle in self._later:
            settle()
        self._measure_keys()
        self._settle_cardinality()
        self._settle_outliers()
        self._marked = self._mark_keys(self.flagged)
        self._annotated: DataFrame | None = None
        self._numbers: dict[str, int | str | None] = {}

    @property
    def annotated(self) -> DataFrame:
        """The rows with a boolean per check; breaks of order are looked for when this is first asked for."""
        if self._annotated is None:
            self._annotated = reduce(lambda frame, o: self._mark_breaks(frame, o), self._ordered, self._marked)
        return self._annotated

    # --- compiling -------------------------------------------------------------------------

    def _normalize(self, df: DataFrame) -> None:
        """Input columns stay; columns that change get a normalized copy. ``view`` maps to it."""
        self.view = {n: n for n in self.columns}
        copies = []
        for i, n in enumerate(self.columns):
            spec = (self.by_name.get(n) or {}).get("normalization")
            if spec:
                self.view[n] = f"__n{i}"
                copies.append(normalized(col(n), self.types[n], spec).alias(f"__n{i}"))
        self.frame = df.select("*", *copies)
        self.view_types = {n: self.frame.schema[v].dataType for n, v in self.view.items()}

    def _add(self, **kw) -> Check:
        check = Check(id=len(self.checks), **kw)
        self.checks.append(check)
        return check

    def _column_checks(self, enforce_required: bool) -> None:
        for c in self.rules["columns"]:
            name = c["name"]
            if name not in self.view:
                self.missing.append(name)
                continue
            tests = list(c["tests"])
            if enforce_required and c["required"] and not any(t["type"] == "not_null" for t in tests):
                tests.insert(0, {"type": "not_null", "severity": "error", "params": {}, "on_fail": None})
            for t in tests:
                own = next((o["on_fail"] for o in tests if o["type"] == t["type"] and o["on_fail"]), None)
                policy = own or c["failure_handling"]
                check = self._add(
                    scope="column",
                    target=name,
                    column=name,
                    test=t["type"],
                    severity="warning" if t["type"] == "cardinality_warning" else t["severity"],
                    action=policy["action"],
                    blocks=c["failure_handling"]["action"] == "strict_fail",
                    quarantine=policy["quarantine_export_name"]
                    or c["failure_handling"]["quarantine_export_name"],
                )
                self._column_check(check, t["params"], c["data_type"])

    def _column_check(self, check: Check, params: dict, declared: str) -> None:
        value, dtype = self.view[check.target], self.view_types[check.target]
        missing = is_missing(col(value), dtype)
        values = column_checks.allowed_values(params) if check.test == "enum" else []
        if isinstance(values, DataFrame) or (len(values) > column_checks.LISTED and not self.frame.isStreaming):
            self._value_list(check, value, values, params)
        elif check.test in column_checks.ROW_CHECKS:
            if check.test == "pattern" and not column_checks.pattern_of(params):
                check.passed, check.note = False, "no pattern given"
                return
            check.flags = True
            fails = column_checks.fails(check.test, col(value), dtype, params, declared)
            self._row_flags[check.flag] = fails
        elif check.test == "uniqueness":
            self._repeated(check, [value], missing if params.get("allow_nulls", True) else None)
        elif check.test == "monotonic":
            check.flags = True
            at = self.order_by if order.ROW_ID in self.order_by else [*self.order_by, TIE]
            if TIE in at and TIE not in self.frame.columns:
                self.frame = self.frame.withColumn(TIE, F.xxhash64(*[col(c) for c in self.columns]))
            check.details = {"values": F.count_if(~missing)}
            asked = Ordered(check, value, missing, at, params.get("direction", "increasing"), bool(params.get("strict", False)))
            if TIE in at:
                check.settled_count = None
                self._ordered.append(asked)
            else:
                self._later.append(lambda: self._key_checks.append((check, at, keys.group_sizes(self._breaks(asked), at), None)))
        elif check.test == "cardinality_warning":
            self._cardinality.append((check, value, missing, params))
        else:
            check.passed, check.note = False, f"unknown test {check.test}"

    def _value_list(self, check: Check, value: str, values: list | DataFrame, params: dict) -> None:
        """A long list of allowed values is a table; failing values are those it does not hold."""
        check.flags = True
        asked = f"__l{check.id}"
        self._lookups[asked] = Lookup(value, column_checks.compared(col(value), self.view_types[check.target], params), False)

        def settle() -> None:
            table = column_checks.value_table(self.frame.sparkSession, values, params)
            bad = keys.missing_keys(self.frame.withColumn(asked, self._lookups[asked].value), asked, table, "value", self._tables)
            self._key_checks.append((check, [asked], bad, None))

        self._later.append(settle)

    def _breaks(self, o: Ordered, same: str | None = None) -> DataFrame:
        return order.monotonic_breaks(self.frame.where(~o.missing), o.value, o.at, o.direction, o.strict, same)

    def _dataset_checks(self) -> None:
        for t in self.rules["dataset_tests"]:
            params, test = t["params"], t["type"]
            target = params.get("rule_name") or params.get("column") or ",".join(
                params.get("key_columns") or params.get("subset") or []
            )
            check = self._add(
                scope="dataset",
                target=target,
                test=test,
                severity="warning" if test.startswith("outliers") else t["severity"],
                action=t["on_fail"]["action"],
                blocks=t["on_fail"]["action"] == "strict_fail",
                quarantine=t["on_fail"]["quarantine_export_name"],
            )
            wanted = params.get("key_columns") or []
            if test in ("primary_key_completeness", "primary_key_uniqueness", "composite_key_uniqueness"):
                absent = [k for k in wanted if k not in self.view]
                if not wanted:
                    check.passed, check.note = False, "no key columns given"
                elif test == "primary_key_completeness":
                    check.flags = True
                    nulls = {
                        k: is_missing(col(self.view[k]), self.view_types[k]) for k in wanted if k in self.view
                    }
                    self._row_flags[check.flag] = any_of(list(nulls.values()))
                    check.details = {f"nulls:{k}": F.count_if(v) for k, v in nulls.items()}
                elif absent:
                    check.passed, check.note = False, f"no such columns: {', '.join(absent)}"
                else:
                    self._repeated(check, [self.view[k] for k in wanted])
            elif test == "duplicate_rows":
                self._repeated(check, [self.view[k] for k in params.get("subset") or self.columns])
            elif test == "cross_field_rule":
                try:
                    looked, failed = dataset_checks.cross_field_flags(
                        self.frame, params, self.declared, self.view
                    )
                    self.frame.select(failed)  # resolves the expression, runs nothing
                except Exception as e:
                    check.passed, check.note = False, f"cannot evaluate: {str(e).splitlines()[0]}"
                    continue
                check.flags = True
                self._row_flags[check.flag] = failed
                check.details = {"rows_checked": F.count_if(looked)}
            elif test in ("outliers_iqr", "outliers_zscore"):
                check.passed = True
                if params.get("column") in self.view:
                    self._outliers.append((check, self.view[params["column"]], params))
                else:
                    check.note = "no such column"
            else:
                check.passed, check.note = False, f"unknown test {test}"

    def _repeated(self, check: Check, names: list[str], excused: Column | None = None) -> None:
        """All checks of one list of keys share a grouping and a join."""
        check.flags = True
        self._key_lists.setdefault(tuple(names), []).append((check, excused))

    def _reference_checks(self, references) -> None:
        for f in self.rules["foreign_key_checks"]:
            policy = f["on_fail"]
            name, column = f["name"], f["dataset_column"]
            table = references.get(name) if isinstance(references, Mapping) else references
            if table is not None and column not in self.view:
                self.missing.append(column)
                continue
            if table is not None and f["fk_column"] not in table.columns:
                self.missing.append(f"{name}: {f['fk_column']}")
                continue
            check = self._add(
                scope="reference",
                target=name,
                test="foreign_key",
                severity="error",
                action=policy["action"],
                blocks=policy["action"] == "strict_fail" or table is None,
                quarantine=policy["quarantine_export_name"],
                column=column,
            )
            if table is None:
                check.passed, check.note = False, "no reference table"
                continue
            check.flags = True
            spec = (self.by_name.get(column) or {}).get("normalization")
            value = self.view[column]
            lookup = f"__l{check.id}"
            self._lookups[lookup] = Lookup(value, membership.key_text(col(value), self.view_types[column], spec), spec is None)

            def settle(check=check, value=value, table=table, f=f, spec=spec, lookup=lookup) -> None:
                bad = membership.bad_reference_keys(
                    self.frame, value, table, f["fk_column"], f["allow_nulls"], spec, self._tables
                )
                self._key_checks.append((check, [lookup], bad, ["__key"]))

            self._later.append(settle)

    # --- settling what needs the whole table -------------------------------------------------

    def _settle_cardinality(self) -> None:
        """Distinct counts of all such checks, in one job, or from the repeated keys where those
        are known: the values that are there, less the surplus of each repeated one."""
        if not self._cardinality:
            return
        parts = []
        for i, (_, value, missing, params) in enumerate(self._cardinality):
            filled = self.frame.where(~missing)
            if params.get("approximate"):
                distinct = F.approx_count_distinct(col(value), 0.01)
                got = filled.agg(F.lit(i).alias("i"), distinct.alias("distinct"), F.count(F.lit(1)).alias("filled"))
            elif (value,) in self._shared:
                more = self._shared[value,].filled().select((F.lit(1) - F.col("__n")).alias("d"), F.lit(0).cast("bigint").alias("f"))
                one = F.lit(1).cast("bigint")
                got = filled.select(one.alias("d"), one.alias("f")).unionByName(more)
                got = got.agg(F.lit(i).alias("i"), F.coalesce(F.sum("d"), F.lit(0)).alias("distinct"), F.coalesce(F.sum("f"), F.lit(0)).alias("filled"))
            else:
                got = keys.group_sizes(filled, [value]).agg(
                    F.lit(i).alias("i"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("__n"), F.lit(0)).alias("filled")
                )
            parts.append(got)
        for r in reduce(DataFrame.unionByName, parts).collect():
            check, _, _, params = self._cardinality[r["i"]]
            check.passed, check.note = cardinality_verdict(r["distinct"], r["filled"], params)
            check.settled_count = 0 if check.passed else 1

    def _settle_outliers(self) -> None:
        """Bounds of all outlier checks: one pass for spreads and sketches, one count and one for exact quartiles.

        With ``approximate`` quartiles come from a mergeable sketch: the rank of each is off by one
        part in ``accuracy`` of the rows at most, and the details say so.
        """
        spreads = [o for o in self._outliers if o[0].test == "outliers_zscore"]
        sketched = [o for o in self._outliers if o[0].test == "outliers_iqr" and o[2].get("approximate")]
        ranges = [o for o in self._outliers if o[0].test == "outliers_iqr" and not o[2].get("approximate")]
        if spreads or sketched:
            asks = []
            for _, value, _ in spreads:
                x = dataset_checks.outlier_value(self.frame, value)
                asks.append(F.struct(F.avg(x), F.stddev_samp(x)))
            for _, value, params in sketched:
                x = dataset_checks.outlier_value(self.frame, value)
                asks.append(F.percentile_approx(x, [0.25, 0.75], int(params.get("accuracy", dataset_checks.SKETCH_ACCURACY))))
            got = self.frame.agg(*[a.alias(f"a{i}") for i, a in enumerate(asks)]).first()
            for (check, value, params), quartiles in zip(sketched, got[len(spreads):]):
                bounds = dataset_checks.bounds_of(quartiles or [None, None], params.get("multiplier", dataset_checks.IQR_MULTIPLIER))
                error = 1 / int(params.get("accuracy", dataset_checks.SKETCH_ACCURACY))
                self._outlier_details(check, {**bounds, "rank_error": error}, dataset_checks.iqr_flag(self.frame, value, bounds))
            for i, (check, value, params) in enumerate(spreads):
                mean, std = got[i]
                check.note = None if std else "no variance"
                flag = dataset_checks.zscore_flag(
                    self.frame, value, mean, std, params.get("threshold", dataset_checks.ZSCORE_THRESHOLD)
                )
                self._outlier_details(check, {"mean": mean, "std": std}, flag)
        if ranges:
            values = [dataset_checks.outlier_value(self.frame, v) for _, v, _ in ranges]
            for (check, value, params), quartiles in zip(ranges, quantiles_of(self.frame, values, [0.25, 0.75])):
                multiplier = params.get("multiplier", dataset_checks.IQR_MULTIPLIER)
                bounds = dataset_checks.bounds_of(quartiles, multiplier)
                self._outlier_details(check, bounds, dataset_checks.iqr_flag(self.frame, value, bounds))

    @staticmethod
    def _outlier_details(check: Check, shown: dict, flag: Column) -> None:
        check.details = {k: F.lit(v).cast("double") for k, v in shown.items()}
        check.details["outlier_count"] = F.count_if(flag)

    def _measure_keys(self) -> None:
        """Failing keys of all set checks: one grouping for all key lists, all others measured in one job.

        The counts are known from here on; a check without failing keys adds no join.
        """
        types = self.frame.schema
        lists = [(list(n), is_missing(col(n[0]), types[n[0]].dataType) if len(n) == 1 else None) for n in self._key_lists]
        self._shared = dict(zip(self._key_lists, repeated_lists(self.frame, lists, self._tables)))
        for names, checks in self._key_lists.items():
            for check, excused in checks:
                check.settled_count = self._shared[names].seen.total - (0 if excused is None else self._shared[names].missing)
        self._seen = keys.measure([bad for _, _, bad, _ in self._key_checks], held=self._tables)
        for i, (check, names, *_) in enumerate(self._key_checks):
            check.settled_count = self._seen[i].total
            lookup = self._lookups.get(names[0])
            if lookup and lookup.plain and (lookup.source,) in self._shared:  # the list tells how often any value occurs
                self._seen[i] = replace(self._seen[i], most=self._shared[lookup.source,].seen.most)

    def _mark_keys(self, frame: DataFrame) -> DataFrame:
        """Mark the rows of failing keys, once per key list."""
        rows = frame
        for i, (names, checks) in enumerate(self._key_lists.items()):
            shared = f"__r{i}"
            frame = self._shared[names].mark(frame, shared, rows)
            frame = frame.withColumns({check.flag: col(shared) if x is None else col(shared) & ~x for check, x in checks}).drop(shared)
        for (check, names, _, table_keys), seen in zip(self._key_checks, self._seen):
            frame = self._mark_key(frame, rows, check, names, table_keys, seen)
        return frame

    def _mark_key(self, frame: DataFrame, rows: DataFrame, check: Check, names: list[str], table_keys: list[str] | None, seen: keys.Measured) -> DataFrame:
        given = {n: self._lookups[n].value for n in names if n in self._lookups}
        if given:
            frame = frame.withColumns({n: v for n, v in given.items() if n not in frame.columns})
            rows = rows.withColumns(given)
        return keys.mark(frame, names, seen, check.flag, table_keys, rows).drop(*given)

    def _mark_breaks(self, frame: DataFrame, o: Ordered) -> DataFrame:
        """Mark rows at positions where the order breaks; rows equal in every column are marked alike, and all of them count."""
        flag = o.check.flag
        if o.broken is None:
            bad = self._breaks(o, "__same").groupBy(*[col(a) for a in o.at]).agg(F.max("__same").alias("__n"))
            o.broken = keys.measure([bad.withColumn(flag, F.lit(True))], held=self._tables)[0]
            o.check.settled_count = o.broken.total
        frame = keys.attach(frame, o.at, o.broken, [flag], counted=self.flagged)
        return frame.withColumn(flag, F.coalesce(col(flag), F.lit(False)))

    def _sorted(self, o: Ordered) -> DataFrame:
        """The rows with a value in order, and whether they are at a break. The first such check of errors also
        keeps by what else rows are told to fail, so that rows with errors are counted from there."""
        if o.rows is None:
            filled = self.frame.where(~o.missing)
            more = self._carried() if o is self._leading() else {}
            at = list(dict.fromkeys([*o.at, o.value]))
            rows = filled.select(*[col(a) for a in at], *[c.alias(n) for n, c in more.items() if n not in at])
            o.rows, o.check.settled_count = order.rows_at_breaks(rows, o.value, o.at, o.check.flag, o.direction, o.strict, self._tables)
        return o.rows

    def _leading(self) -> Ordered | None:
        acting = {c.id for c in self._acting("error")}
        return next((o for o in self._ordered if o.check.id in acting), None)

    def _error_lists(self) -> list[tuple[int, list[str], Repeated, list[tuple[Check, Column | None]]]]:
        """Key lists with repeated keys by which rows have errors. A list that holds all columns of another adds
        none: rows repeated in it are repeated in the other, unless that one excuses some."""
        acting = {c.id for c in self._acting("error")}
        found: list[tuple[int, list[str], Repeated, list[tuple[Check, Column | None]]]] = []
        for i, (names, checks) in enumerate(self._key_lists.items()):
            own = [(c, x) for c, x in checks if c.id in acting]
            if own and self._shared[names].seen.rows:
                found.append((i, list(names), self._shared[names], own))
        plain = [(i, set(names)) for i, names, _, own in found if any(x is None for _, x in own)]
        return [f for f in found if not any(n < set(f[1]) or (n == set(f[1]) and i < f[0]) for i, n in plain)]

    def _carried(self) -> dict[str, Column]:
        """What tells whether a row fails checks of errors, other than by order."""
        out = {FAILED: any_of([F.coalesce(col(c.flag), F.lit(False)) for c in self._acting("error") if c.flag in self._row_flags])}
        for i, names, seen, checks in self._error_lists():
            if seen.stand_in is None or fixed(self.frame, names):
                out |= {n: col(n) for n in names}
            else:
                out |= {f"__s{i}{n}": c for n, c in seen.stand_in.items()}
                out |= {f"__x{c.id}": x for c, x in checks if x is not None}
        acting = {c.id for c in self._acting("error")}
        for (check, names, _, _), seen in zip(self._key_checks, self._seen):
            if check.id in acting and seen.rows:
                for n in names:
                    lookup = self._lookups.get(n) or Lookup(n, col(n), True)
                    out |= {lookup.source: col(lookup.source)} if fixed(self.frame, [lookup.source]) else {n: lookup.value}
        for o in self._ordered:
            if o.check.id in acting:
                out |= {n: col(n) for n in o.at}
        return out

    def _passing(self) -> DataFrame:
        """The rows that pass all checks of errors: a row goes at its first failure, so that few are joined to the
        failing keys of the later checks. Rows in order are known to break it without a join."""
        carried, lead = self._carried(), self._leading()
        rows = self.frame if lead is None else self.frame.where(lead.missing)
        rows = rows.select(*[c.alias(n) for n, c in carried.items()]).where(~col(FAILED))
        if lead is not None:
            filled = self._sorted(lead).where(~col(FAILED) & ~col(lead.check.flag))
            rows = filled.select(*[col(n) for n in carried]).unionByName(rows)
        for i, names, seen, checks in self._error_lists():
            here = seen
            if f"__s{i}{next(iter(seen.stand_in or {}), '')}" in carried:
                here = replace(seen, stand_in={n: col(f"__s{i}{n}") for n in seen.stand_in})
            excused = [col(f"__x{c.id}") if f"__x{c.id}" in carried else x for c, x in checks]
            hit = any_of([col("__r") if x is None else col("__r") & ~x for x in excused])
            counted = self.frame.select(*[c.alias(n) for n, c in carried.items()])
            rows = here.mark(rows, "__r", counted).where(~F.coalesce(hit, F.lit(False))).drop("__r")
        acting = {c.id for c in self._acting("error")}
        for (check, names, _, table_keys), seen in zip(self._key_checks, self._seen):
            if check.id in acting and seen.rows:
                rows = self._mark_key(rows, self.frame, check, names, table_keys, seen).where(~col(check.flag)).drop(check.flag)
        for o in self._ordered:
            if o is not lead and o.check.id in acting:
                rows = self._mark_breaks(rows, o).where(~col(o.check.flag)).drop(o.check.flag)
        return rows

    # --- counts ----------------------------------------------------------------------------

    def cache(self) -> Report:
        """Keep the annotated rows for several outputs; ``release`` drops them."""
        self._annotated = self.annotated.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        """Drop everything this report keeps in memory or on disk."""
        keys.release(self._tables)
        self._tables.clear()
        for o in self._ordered:
            o.rows = None
        if self._annotated is not None:
            self._annotated.unpersist()
        if self._input is not None:
            self._input.unpersist()

    def _acting(self, severity: str | None = None) -> list[Check]:
        """Checks whose flags count for rows."""
        scopes = ("column",) if self.row_effects == "column_only" else ("column", "dataset", "reference")
        return [
            c for c in self.checks
            if c.flags and c.scope in scopes and (severity is None or c.severity == severity)
        ]

    def _failed(self, severity: str | None = None) -> Column:
        return any_of([col(c.flag) for c in self._acting(severity)])

    def _known(self, error_rows: bool = False) -> dict:
        """What passes over the table count: rows, failures and details of value checks, and rows with errors.

        Up to COUNTED numbers come from one pass. More are shared out to several, each of which reads its
        own columns only; all run as one job. Rows with errors are all but those that pass every check.
        """
        if "rows" in self._numbers and (not error_rows or "error_rows" in self._numbers):
            return self._numbers
        asks = {f"c{n}": F.count_if(col(n)) for n in self._row_flags}
        asks |= {f"d{c.id}:{k}": d.cast("string") for c in self.checks for k, d in c.details.items()}
        passes: list[tuple[DataFrame, dict[str, Column]]] = []
        if "rows" not in self._numbers:
            first = {"rows": F.count(F.lit(1))}
            names = list(asks)
            passes = [(self.flagged, {n: asks[n] for n in names[i : i + COUNTED]}) for i in range(0, len(names), COUNTED)] or [(self.flagged, {})]
            passes[0] = (passes[0][0], {**first, **passes[0][1]})
        if error_rows and "error_rows" not in self._numbers:
            marked = bool(self._key_lists or self._key_checks or self._ordered)
            if not marked or (self._annotated is not None and self._annotated.is_cached):
                errors = {"error_rows": F.count_if(self._failed("error"))}
                if len(passes) == 1:
                    passes = [(self.annotated, {**passes[0][1], **errors})]
                else:
                    passes.append((self.annotated, errors))
            else:
                passes.append((self._passing(), {"passing": F.count(F.lit(1))}))
        if passes:
            texts = [frame.agg(F.array(*[a.cast("string") for a in own.values()]).alias("v")).select(F.lit(i).alias("i"), "v") for i, (frame, own) in enumerate(passes)]
            for r in reduce(DataFrame.unionByName, texts).collect():  # a row per pass
                for name, text in zip(passes[r["i"]][1], r["v"], strict=True):
                    self._numbers[name] = text if name.startswith("d") else int(text)
            if "passing" in self._numbers:
                self._numbers["error_rows"] = self._numbers["rows"] - self._numbers["passing"]
        return self._numbers

    def _count(self, c: Check) -> int:
        if c.settled_count is None:
            for o in self._ordered:
                if o.check is c:
                    self._sorted(o)
        return self._known()[f"c{c.flag}"] if c.flag in self._row_flags else c.settled_count

    def _passed(self, c: Check) -> bool:
        return c.passed if c.passed is not None else self._count(c) == 0

    def _note(self, c: Check) -> str | None:
        if c.test == "monotonic":
            return "too few values to compare" if int(self._known()[f"d{c.id}:values"]) < 2 else None
        return c.note

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(rows, schema)

    def test_results(self) -> DataFrame:
        """One row per check."""
        known = self._known()
        rows = [
            (
                c.id, c.scope, c.target, c.test, c.severity, c.action, self._passed(c), self._count(c), known["rows"], self._note(c),
                {k: known[f"d{c.id}:{k}"] for k in c.details} or None,
                not self._passed(c) and c.blocks and c.severity == "error",
            )
            for c in self.checks
        ]
        schema = "check_id int, scope string, target string, test string, severity string, action string, passed boolean, failed_count bigint, total_values bigint, note string, details map<string,string>, blocking boolean"
        return self._table(rows, schema)

    def column_results(self) -> DataFrame:
        """Tests passed and failed per column, and its status."""
        rows = []
        for n in self.by_name:
            own = [c for c in self.checks if c.scope == "column" and c.target == n]
            if n not in self.view:
                continue
            failed = [c for c in own if not self._passed(c)]
            errors, warnings = (sum(c.severity == s for c in failed) for s in ("error", "warning"))
            status = "FAIL" if errors else "WARNING" if warnings else "PASS"
            rows.append((n, len(own), len(own) - len(failed), len(failed), errors, warnings, status))
        return self._table(rows, "column_name string, total_tests bigint, passed_tests bigint, failed_tests bigint, error_count bigint, warning_count bigint, status string")

    def blocking_errors(self) -> DataFrame:
        """What keeps the table from being valid outright."""
        rows = [(c.scope, c.target, c.test) for c in self.checks if not self._passed(c) and c.blocks and c.severity == "error"]
        rows += [("table", m, "missing column") for m in self.missing]
        return self._table(rows, "scope string, target string, test string")

    def summary(self) -> DataFrame:
        """One row of totals.

        ``warnings`` and ``errors`` add failed tests and failing cells together; the two
        ``*_cells`` columns hold failing cells alone.
        """
        known = self._known(error_rows=True)

        def cells(severity):
            return sum(self._count(c) for c in self.checks if c.scope == "column" and c.flags and c.severity == severity)

        def tests(keep):
            return sum(not self._passed(c) for c in self.checks if keep(c))

        passed = sum(self._passed(c) for c in self.checks)
        warnings = tests(lambda c: c.scope in ("column", "dataset") and c.severity == "warning") + cells("warning")
        errors = tests(lambda c: (c.scope == "dataset" and c.severity != "warning") or c.scope == "reference") + cells("error")
        blocked = bool(self.missing) or any(not self._passed(c) for c in self.checks if c.blocks and c.severity == "error")
        rows, bad = known["rows"], known["error_rows"]
        share = float(Decimal(repr(bad * 100.0 / rows)).quantize(Decimal("0.01"), ROUND_HALF_UP)) if rows else 0.0
        return self._table(
            [(rows, len(self.columns), len(self.checks), passed, len(self.checks) - passed, warnings, errors, cells("warning"), cells("error"), bad, rows - bad, share, errors > 0, not blocked and errors == 0)],
            "total_rows bigint, total_columns bigint, tests_run bigint, tests_passed bigint, tests_failed bigint, warnings bigint, errors bigint, warning_cells bigint, error_cells bigint, "
            "rows_with_errors bigint, clean_rows bigint, error_rate_percent double, has_blocking_errors boolean, is_valid boolean",
        )

    def summary_dict(self) -> dict:
        """The summary, blocking errors and column statuses, for a caller on the driver."""
        out = self.summary().first().asDict()
        out["blocking_errors"] = [tuple(r) for r in self.blocking_errors().collect()]
        out["column_statuses"] = {
            r["column_name"]: r["status"] for r in self.column_results().collect()
        }
        return out

    # --- rows ------------------------------------------------------------------------------

    def _renamed(self, names: list[str]) -> list[Column]:
        new = {n: (self.by_name.get(n) or {}).get("rename_to") or n for n in names}
        return [col(n).alias(new[n]) for n in names]

    def labeled(self, style: str = "brackets", names: tuple[str, str, str] = (ERRORS, ERROR_COUNT, STATUS)) -> DataFrame:
        """Input rows with a label, a failure count and PASS or FAIL.

        Labels read ``[column: detail, detail][column: detail]``, or ``test|test`` in pipe style.
        Nothing is shuffled for value checks.
        """
        acting = self._acting()
        if style == "pipe":
            label = F.concat_ws("|", *[F.when(col(c.flag), F.lit(c.test)) for c in acting])
        else:
            label = F.concat_ws("", *self._label_parts(acting))
        count = balanced(Column.__add__, [col(c.flag).cast("int") for c in acting], F.lit(0))
        return self.annotated.select(
            *self._renamed(self.columns),
            label.alias(names[0]),
            count.alias(names[1]),
            F.when(self._failed(), "FAIL").otherwise("PASS").alias(names[2]),
        )

    def _label_parts(self, acting: list[Check]) -> list[Column]:
        groups: dict[str, list[Check]] = {}
        for c in acting:
            groups.setdefault(c.column or c.target or c.test, []).append(c)
        return [
            F.when(
                any_of([col(c.flag) for c in checks]),
                F.concat(
                    F.lit(f"[{name}: "),
                    F.concat_ws(", ", *[F.when(col(c.flag), F.lit(c.label)) for c in checks]),
                    F.lit("]"),
                ),
            )
            for name, checks in groups.items()
        ]

    def cell_errors(self) -> DataFrame:
        """One row per failing cell and check, uncapped."""
        def entry(c: Check) -> Column:
            if c.column:
                value = as_text(col(self.view[c.column]), self.view_types[c.column])
            else:
                value = F.lit(None).cast("string")
            return F.when(
                col(c.flag),
                F.struct(
                    F.lit(c.scope).alias("scope"),
                    F.lit(c.column or c.target or c.test).alias("column_name"),
                    value.alias("value"),
                    F.lit(c.test).alias("test"),
                    F.lit(c.label).alias("message"),
                    F.lit(c.severity).alias("severity"),
                ),
            )

        kind = "array<struct<scope: string, column_name: string, value: string, test: string, message: string, severity: string>>"
        found = F.array_compact(F.array(*[entry(c) for c in self._acting()])).cast(kind)
        return (
            self.annotated.where(self._failed())
            .select(*[col(k) for k in self.row_key], F.explode(found).alias("__e"))
            .select(*[col(k) for k in self.row_key], "__e.*")
        )

    def error_counts(self) -> DataFrame:
        """Failing cells per column and test."""
        return (
            self.test_results()
            .where("scope = 'column' AND failed_count > 0 AND test != 'cardinality_warning'")
            .groupBy(F.col("target").alias("column_name"), "test")
            .agg(F.sum("failed_count").alias("cells"))
        )

    def rows(self, status: str = "fail") -> DataFrame:
        """Input rows that fail (any error), only warn, or pass."""
        error, flagged = self._failed("error"), self._failed()
        keep = {"fail": error, "warning": flagged & ~error, "pass": ~flagged}[status]
        return self.annotated.where(keep).select(*[col(n) for n in self.columns])

    def failed_row_keys(self) -> DataFrame:
        return self.annotated.where(self._failed("error")).select(*[col(k) for k in self.row_key])

    def examples(self, limit: int = 100, width: int = 50) -> DataFrame:
        """The first failing cells per column and test, values cut for display."""
        cells = self.cell_errors().withColumn("value", F.substring("value", 1, width))
        return first_of(cells, ["column_name", "test"], [col(k) for k in self.row_key], limit)

    def top_invalid(self, limit: int = 10) -> DataFrame:
        """The most frequent failing values per column, with their share of all rows."""
        counts = (
            self.cell_errors()
            .where("scope = 'column'")
            .groupBy("column_name", "test", "value")
            .agg(F.count(F.lit(1)).alias("cells"))
        )
        return first_of(counts, ["column_name", "test"], [F.desc("cells"), F.asc_nulls_first("value")], limit)

    def split(self) -> Outputs:
        """Clean rows, quarantined rows and named quarantines, as the policies ask.

        A failing cell may be nulled; a row with any dropping or quarantining failure leaves the
        clean rows; quarantined rows keep their input values.
        """
        acting = self._acting()

        def having(*actions):
            return any_of([col(c.flag) for c in acting if c.action in actions])

        nulled = {}
        for c in acting:
            if c.action == "set_null" and c.column:
                nulled.setdefault(c.column, []).append(col(c.flag))
        clean = self.annotated.where(~having("drop_row", "quarantine_row")).select(
            *[
                (F.when(~any_of(nulled[n]), col(n)) if n in nulled else col(n)).alias(
                    (self.by_name.get(n) or {}).get("rename_to") or n
                )
                for n in self.columns
            ]
        )
        names = [col(n) for n in self.columns]
        hits = {"quarantine": having("quarantine_row")}
        quarantine = self.annotated.where(hits["quarantine"]).select(*names)
        named = {}
        for name in dict.fromkeys(c.quarantine for c in acting if c.action == "quarantine_row" and c.quarantine):
            hit = any_of([col(c.flag) for c in acting if c.action == "quarantine_row" and c.quarantine == name])
            named[name] = self.annotated.where(hit).select(*names)
            hits[f"named/{name}"] = hit
        return Outputs(clean, quarantine, named, self.annotated, hits)

    def wants_labels(self) -> bool:
        """Whether any policy asks for labeled output."""
        policies = [c["failure_handling"] for c in self.rules["columns"]]
        policies += [t["on_fail"] for c in self.rules["columns"] for t in c["tests"] if t["on_fail"]]
        policies += [t["on_fail"] for t in self.rules["dataset_tests"]]
        policies += [f["on_fail"] for f in self.rules["foreign_key_checks"]]
        return any(p["action"] == "label_failure" for p in policies)

    def require_valid(self) -> None:
        """Raise when a strict policy blocks the table."""
        blocked = self.blocking_errors().collect()
        if blocked:
            raise RuntimeError("blocked: " + "; ".join(f"{b['target']} ({b['test']})" for b in blocked))


@dataclass
class Lookup:
    """A value that rows are looked up by: the column it is taken from, how, and whether it is that column itself."""

    source: str
    value: Column
    plain: bool


@dataclass
class Ordered:
    """A check of order whose rows are told apart by position."""

    check: Check
    value: str
    missing: Column
    at: list[str]
    direction: str
    strict: bool
    rows: DataFrame | None = None  # kept in order, until they are released
    broken: keys.Measured | None = None


@dataclass
class Outputs:
    clean: DataFrame
    quarantine: DataFrame
    named: dict[str, DataFrame]
    flagged: DataFrame  # the rows all sets are taken from
    hits: dict[str, Column]  # which of them go to a set

    @contextmanager
    def held(self) -> Iterator[None]:
        """Keeps the flagged rows while several sets are taken from them."""
        kept = self.flagged.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield
        finally:
            kept.unpersist()

    def sizes(self) -> dict[str, int]:
        """Rows of every quarantine, in one pass."""
        if not self.hits:
            return {}
        return self.flagged.agg(*[F.count_if(hit).alias(name) for name, hit in self.hits.items()]).first().asDict()


def cardinality_verdict(distinct: int, filled: int, params: dict) -> tuple[bool, str | None]:
    low, high = params.get("min", 1), params.get("max")
    if distinct < low:
        return False, f"{distinct} distinct values, at least {low} expected"
    if high is not None and distinct > high:
        return False, f"{distinct} distinct values, at most {high} expected"
    if distinct == filled > 10:
        return True, f"all {distinct} values differ: an id or free text"
    return True, None
