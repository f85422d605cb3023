"""Q1: domain-rule report; Q3: input-contract check.

Q1 turns the source's argument validators into data checks: every row of a
table is tested against the same rules (id range, department, leave status,
review period, office location). As in the validators, a null or '' value
passes a domain rule, while a null id fails the range rule. Each table is
read once; all its rules are evaluated in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import (
    BENEFITS, DEPARTMENTS, EMPLOYEE_ID_RANGE, EMPLOYEES, EXPECTED_SCHEMAS, KEYS, LEAVE,
    LEAVE_STATUSES, OFFICE_LOCATIONS, REVIEW_PERIODS, REVIEWS,
)


@dataclass(frozen=True)
class Rule:
    table: str
    rule: str
    column: str
    kind: str  # "range" or "domain"
    bounds: tuple = ()

    def violated(self) -> Column:
        c = F.col(self.column)
        if self.kind == "range":
            lo, hi = self.bounds
            return c.isNull() | ~c.between(lo, hi)
        return c.isNotNull() & (c != "") & ~c.isin(list(self.bounds))


def default_rules(
    id_range: tuple[int, int] = EMPLOYEE_ID_RANGE,
    departments: Iterable[str] = DEPARTMENTS,
    statuses: Iterable[str] = LEAVE_STATUSES,
    periods: Iterable[str] = REVIEW_PERIODS,
    offices: Iterable[str] = OFFICE_LOCATIONS,
) -> list[Rule]:
    """The source's rules, with every domain a parameter."""
    rng = tuple(id_range)
    return [
        Rule(EMPLOYEES, "employee_id_range", "employee_id", "range", rng),
        Rule(EMPLOYEES, "department_domain", "department", "domain", tuple(departments)),
        Rule(EMPLOYEES, "office_location_domain", "office_location", "domain", tuple(offices)),
        Rule(BENEFITS, "employee_id_range", "employee_id", "range", rng),
        Rule(LEAVE, "employee_id_range", "employee_id", "range", rng),
        Rule(LEAVE, "status_domain", "status", "domain", tuple(statuses)),
        Rule(REVIEWS, "employee_id_range", "employee_id", "range", rng),
        Rule(REVIEWS, "review_period_domain", "review_period", "domain", tuple(periods)),
    ]


def _by_table(tables: dict[str, DataFrame], rules: Iterable[Rule] | None) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """The rules to check by table, and the default rules whose table is absent. A rule that the caller names for an
    absent table raises ``ValueError``: a report that leaves it out would look whole."""
    named = rules is not None
    rules = list(rules) if named else default_rules()
    absent = [r for r in rules if r.table not in tables]
    if named and absent:
        raise ValueError(f"no table for the rules {[(r.table, r.rule) for r in absent]}")
    if not tables or not rules:
        raise ValueError("no rule applies to the given tables")
    found: dict[str, list[Rule]] = {}
    for r in rules:
        if r.table in tables:
            found.setdefault(r.table, []).append(r)
    return found, absent


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def domain_rule_report(tables: dict[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    """``(table_name, rule, column_name, n_rows, n_violations)``: one global aggregate per
    table (a single scan with one conditional count per rule). With the default rules, those of a table that is not given
    have null counts; a rule given in ``rules`` for such a table raises ``ValueError``."""
    by_table, absent = _by_table(tables, rules)
    parts = []
    for table, table_rules in by_table.items():
        df = tables[table]
        agg = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count_if(r.violated()).alias(f"v{i}") for i, r in enumerate(table_rules)],
        )
        entries = F.array(*[
            F.struct(F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column_name"),
                     F.col(f"v{i}").alias("n_violations"))
            for i, r in enumerate(table_rules)
        ])
        parts.append(agg.select(F.lit(table).alias("table_name"), "n_rows", F.inline(entries))
                     .select("table_name", "rule", "column_name", "n_rows", "n_violations"))
    if absent:
        spark = next(iter(tables.values())).sparkSession
        parts.append(spark.createDataFrame(
            [(r.table, r.rule, r.column, None, None) for r in absent],
            "table_name string, rule string, column_name string, n_rows bigint, n_violations bigint"))
    return _union(parts)


def domain_rule_rows(tables: dict[str, DataFrame], rules: Iterable[Rule] | None = None) -> DataFrame:
    """Row-level variant: ``(table_name, rule, column_name, row_key, value)`` for every
    violating row, ``row_key`` being the table's key. Narrow: no shuffle, and only violations become rows. A default rule
    whose table is not given is one row with a null key and the value ``table is missing``; a rule given in ``rules`` for such
    a table raises ``ValueError``."""
    by_table, absent = _by_table(tables, rules)
    parts = []
    for table, table_rules in by_table.items():
        key = KEYS[table]
        entries = F.array(*[
            F.when(r.violated(), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column_name"),
                                          F.col(r.column).cast("string").alias("value")))
            for r in table_rules
        ])
        rows = tables[table].select(F.col(key).alias("row_key"), F.inline(F.array_compact(entries)))
        parts.append(rows.select(F.lit(table).alias("table_name"), "rule", "column_name", "row_key", "value"))
    if absent:
        spark = next(iter(tables.values())).sparkSession
        parts.append(spark.createDataFrame(
            [(r.table, r.rule, r.column, None, "table is missing") for r in absent],
            "table_name string, rule string, column_name string, row_key bigint, value string"))
    return _union(parts)


def table_contract(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    expected: dict[str, T.StructType] | None = None,
    check_types: bool = True,
) -> DataFrame:
    """Q3: compare each table's schema with its contract.

    ``(table_name, column_name, expected_type, actual_type, status)`` with status one of
    ``ok``, ``missing_table``, ``missing_column``, ``type_mismatch`` or
    ``extra_column`` (extra columns are allowed and only reported). Only schema
    metadata is read, never data.
    """
    expected = EXPECTED_SCHEMAS if expected is None else expected
    rows = []
    for table, schema in expected.items():
        if table not in tables:
            rows.append((table, None, None, None, "missing_table"))
            continue
        actual = {f.name: f.dataType for f in tables[table].schema.fields}
        for f in schema.fields:
            got = actual.get(f.name)
            if got is None:
                status = "missing_column"
            elif check_types and got != f.dataType:
                status = "type_mismatch"
            else:
                status = "ok"
            rows.append((table, f.name, f.dataType.simpleString(),
                         got.simpleString() if got is not None else None, status))
        for name, got in actual.items():
            if name not in schema.fieldNames():
                rows.append((table, name, None, got.simpleString(), "extra_column"))
    return spark.createDataFrame(
        rows, "table_name string, column_name string, expected_type string, actual_type string, status string")


def tables_exist(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """Q3 for catalog names: ``(table_name, table_exists)`` via the session catalog."""
    return spark.createDataFrame(
        [(n, bool(spark.catalog.tableExists(n))) for n in names], "table_name string, table_exists boolean")
