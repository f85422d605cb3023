"""Reports on small random tables against plain SQL run by DuckDB on the same
rows: the profile by counting triples, the lists by looking names up, one query per summary
metric. Random data brings ties, nulls, '' keys, duplicate benefit rows and
unknown ids that the fixed fixture lacks."""

import datetime as dt
import math

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from staffline import (
    domain_rule_report, employee_benefits, employee_profile, employee_profile_exact, hr_summary,
    leave_requests, performance_reviews, search_employees,
)
from staffline.plans.registry import _flat_benefits
from staffline.plans import oracle as O
from staffline.schemas import (
    BENEFITS, EMPLOYEES, EXPECTED_SCHEMAS, LEAVE, LEAVE_STATUSES, OFFICE_LOCATIONS, REVIEW_PERIODS, REVIEWS,
)

from .conftest import LEAVE_SCHEMA

AS_OF = "2024-01-31 00:00:00"
IDS = st.integers(0, 7)
MAYBE_ID = st.one_of(st.none(), IDS)
NAMES = st.sampled_from(["Ann", "Bob", "Cid", None])
DEPTS = st.sampled_from(["Engineering", "HR", "", None, "Space"])
PLANS = st.sampled_from(["PPO", "HMO", "", None])
STATUS = st.sampled_from(["Pending", "Approved", "Denied", None, "Lost"])
PERIODS = st.sampled_from(["Q1 2024", "Annual 2024", None])
TIMES = st.sampled_from([dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 10), dt.datetime(2023, 5, 1), None])
DATES = st.sampled_from([dt.date(2024, 1, 30), dt.date(2024, 1, 20), dt.date(2023, 5, 1), None])
SCORES = st.one_of(st.none(), st.integers(0, 5))


@st.composite
def hr_tables(draw):
    emp_ids = draw(st.lists(st.integers(0, 9), unique=True, max_size=6))
    employees = [(i, draw(NAMES), draw(DEPTS), draw(st.sampled_from(["Eng", "Ops"])), None, 1.0, 3,
                  draw(st.sampled_from(["Austin", "Mars", None])), "Active", dt.date(2020, 1, 1))
                 for i in emp_ids]
    benefit_rows = draw(st.lists(st.tuples(IDS, PLANS, PLANS, st.sampled_from([None, 1.0, 2.0])), max_size=8))
    benefits = [(e, h, r, m, 10, 5, True, False, 1, "Monthly") for e, h, r, m in benefit_rows]
    # duplicate some benefit rows exactly
    benefits += benefits[: draw(st.integers(0, 2))]
    leave = [(rid, draw(MAYBE_ID), draw(MAYBE_ID), "1-URGENT", draw(STATUS), draw(TIMES))
             for rid in range(draw(st.integers(0, 12)))]
    reviews = [(rid, draw(MAYBE_ID), draw(MAYBE_ID), draw(PERIODS), draw(DATES), draw(SCORES), draw(SCORES),
                draw(SCORES), draw(SCORES)) for rid in range(draw(st.integers(0, 12)))]
    return employees, benefits, leave, reviews


def _frames(spark, data):
    employees, benefits, leave, reviews = data
    return {
        EMPLOYEES: spark.createDataFrame(employees, EXPECTED_SCHEMAS[EMPLOYEES]),
        BENEFITS: spark.createDataFrame(benefits, EXPECTED_SCHEMAS[BENEFITS]),
        LEAVE: spark.createDataFrame(leave, LEAVE_SCHEMA),
        REVIEWS: spark.createDataFrame(reviews, EXPECTED_SCHEMAS[REVIEWS]),
    }


def _duck(tables, data):
    """The same rows as DuckDB views with the same column types."""
    con = duckdb.connect()
    for (name, df), rows in zip(tables.items(), data):
        fields = df.schema.fields
        pdf = pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype="object")
                            for i, f in enumerate(fields)})
        con.register(f"{name}_src", pdf)
        casts = ", ".join(f"CAST({f.name} AS {_SQL_TYPES[f.dataType.simpleString()]}) AS {f.name}"
                          for f in fields)
        con.execute(f"CREATE VIEW {name} AS SELECT {casts} FROM {name}_src")
    return con


_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR"}


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9))
        return repr(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def _same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got = _canon([tuple(r) for r in df.collect()], df.columns)
    want = _canon(rel.fetchall(), rel.columns)
    assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(hr_tables())
def test_random_reports_match_plain_sql(spark, data):
    t = _frames(spark, data)
    con = _duck(t, data)
    _same(employee_profile(t), con, O._profile_fanout(O.EMP_NO_SALARY, True))
    _same(employee_profile(t, include_benefits=False), con, O._profile_fanout(O.EMP_NO_SALARY, False))
    _same(employee_profile_exact(t), con, O._profile_exact())
    _same(employee_benefits(t), con, O._benefits())
    _same(_flat_benefits(employee_benefits(t, benefit_type="Medical")), con,
          O._benefits(view=("health_plan", "dental_coverage", "vision_coverage")))
    _same(search_employees(t, limit=3), con, O._search("TRUE", 3))
    _same(search_employees(t, department="Engineering", role="Op", limit=2), con,
          O._search("department = 'Engineering' AND contains(role, 'Op')", 2))
    _same(leave_requests(t, limit=3), con, O._leave("TRUE", 3))
    _same(leave_requests(t, limit=4, days_back=30, as_of=AS_OF), con,
          O._leave(O._leave_window(30), 4))
    _same(performance_reviews(t, limit=3), con, O._reviews("TRUE", 3))
    _same(hr_summary(t, 30, as_of=AS_OF), con, O._summary(30))
    _same(domain_rule_report(t), con, O._rule_report(O._rules(
        ["Engineering", "HR"], LEAVE_STATUSES, REVIEW_PERIODS, OFFICE_LOCATIONS)))
