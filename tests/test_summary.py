"""R6: summary metrics, null/'' rules, empty windows, invariants."""

import datetime as dt

import pytest

from staffline import (
    average_company_match, headcount_by_department, headcount_total, health_plan_distribution,
    hr_summary, leave_status_breakdown, leave_window_total, retirement_plan_distribution,
    review_score_averages, review_window_total,
)
from staffline.schemas import LEAVE

from .conftest import SF_ORACLE, benefit, leave_row, make_tables, review_row

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture
def tables(spark):
    return make_tables(
        spark,
        employees=[(1, "A", "Engineering"), (2, "B", None), (3, "C", "Engineering")],
        benefits=[benefit(1, health=None, retirement="", match=None), benefit(2, health="", match=2.0),
                  benefit(3, health="PPO", retirement="Roth 401k", match=4.0)],
        leave=[leave_row(1, 1, "Pending", ts=dt.datetime(2024, 1, 30)),
               leave_row(2, 1, None, ts=dt.datetime(2024, 1, 20)),
               leave_row(3, 2, "Approved", ts=dt.datetime(2023, 6, 1)),
               leave_row(4, 2, "Approved", ts=None)],
        reviews=[review_row(1, 1, goals=10, tech=2, comm=4, date=dt.date(2024, 1, 30)),
                 review_row(2, 1, goals=None, tech=4, comm=2, date=dt.date(2024, 1, 17)),
                 review_row(3, 1, goals=90, tech=5, comm=5, date=dt.date(2024, 1, 16))],
    )


def _pairs(df, key):
    return {r[key]: r["count"] for r in df.collect()}


def test_employee_metrics(tables):
    assert headcount_total(tables).first()["total_employees"] == 3
    assert _pairs(headcount_by_department(tables), "department") == {"Engineering": 2, None: 1}


def test_plan_distributions_drop_null_and_blank(tables):
    assert _pairs(health_plan_distribution(tables), "health_plan") == {"PPO": 1}
    assert _pairs(retirement_plan_distribution(tables), "retirement_plan") == {"401k": 1, "Roth 401k": 1}
    assert average_company_match(tables).first()[0] == 3.0


def test_windows(tables):
    assert leave_window_total(tables, 30, as_of=AS_OF).first()[0] == 2
    assert _pairs(leave_status_breakdown(tables, 30, as_of=AS_OF), "status") == {"Pending": 1, None: 1}
    assert review_window_total(tables, 14, as_of=AS_OF).first()[0] == 2
    avg = review_score_averages(tables, 14, as_of=AS_OF).first().asDict()
    assert avg == {"goals_achievement": 10.0, "technical_skills": 3.0, "communication": 3.0}


def test_empty_window_gives_zeros(tables):
    far = "2030-01-01 00:00:00"
    assert leave_window_total(tables, 30, as_of=far).first()[0] == 0
    assert leave_status_breakdown(tables, 30, as_of=far).count() == 0
    avg = review_score_averages(tables, 30, as_of=far).first().asDict()
    assert avg == {"goals_achievement": 0.0, "technical_skills": 0.0, "communication": 0.0}


def test_empty_benefits_average_is_zero(spark):
    t = make_tables(spark, employees=[(1, "A")])
    assert average_company_match(t).first()[0] == 0.0


def test_long_form(tables):
    rows = {(r["section"], r["metric"], r["key"]): r["value"]
            for r in hr_summary(tables, 30, as_of=AS_OF).collect()}
    assert rows[("employees", "total_employees", None)] == 3.0
    assert rows[("employees", "department_breakdown", None)] == 1.0
    assert rows[("benefits", "health_plan_distribution", "PPO")] == 1.0
    assert ("benefits", "health_plan_distribution", "") not in rows
    assert rows[("benefits", "average_company_match_percent", None)] == 3.0
    assert rows[("leave_requests", "total_requests", None)] == 2.0
    assert rows[("leave_requests", "status_breakdown", None)] == 1.0
    assert rows[("performance_reviews", "total_reviews", None)] == 3.0
    assert rows[("performance_reviews", "average_scores", "goals_achievement")] == 50.0


def test_missing_table_leaves_the_other_sections(tables):
    partial = {k: v for k, v in tables.items() if k != LEAVE}
    rows = hr_summary(partial, 30, as_of=AS_OF).collect()
    assert {r["section"] for r in rows if r["metric"] != "error"} == {"employees", "benefits", "performance_reviews"}
    only = hr_summary(tables, 30, as_of=AS_OF, sections=["benefits"])
    assert {r["section"] for r in only.collect()} == {"benefits"}


@pytest.mark.parametrize("days", [0, 366])
def test_days_bounds(tables, days):
    with pytest.raises(ValueError):
        hr_summary(tables, days)


def test_invariants_on_fixture(spark):
    from staffline.sources import fixture_tables
    t = fixture_tables(spark, SF_ORACLE)
    rows = hr_summary(t, 30, as_of=AS_OF).collect()

    def total(metric):
        return sum(r["value"] for r in rows if r["metric"] == metric)
    assert total("department_breakdown") == total("total_employees")
    assert total("status_breakdown") == total("total_requests")
    # spot checks written down in the survey for this fixture
    status = {r["key"]: r["value"] for r in rows if r["metric"] == "status_breakdown"}
    assert status == {"Approved": 61.0, "Cancelled": 38.0, "Denied": 36.0, "Pending": 63.0}
    assert review_window_total(t, 14, as_of=AS_OF).first()[0] == 4680


def test_long_form_on_empty_inputs(spark):
    t = make_tables(spark, employees=[(1, "A")], leave=[leave_row(1, 1, ts=dt.datetime(2020, 1, 1))])
    rows = {(r["section"], r["metric"], r["key"]): r["value"]
            for r in hr_summary(t, 30, as_of=AS_OF).collect()}
    assert rows[("leave_requests", "total_requests", None)] == 0.0
    assert rows[("performance_reviews", "total_reviews", None)] == 0.0
    assert rows[("benefits", "average_company_match_percent", None)] == 0.0
    for c in ("goals_achievement", "technical_skills", "communication"):
        assert rows[("performance_reviews", "average_scores", c)] == 0.0
    assert not any(m == "status_breakdown" or m.endswith("_distribution") for _, m, _ in rows)
    assert len(rows) == 8  # 7 scalar metrics + one department


def test_long_form_is_one_aggregation(tables):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        hr_summary(tables, 30, as_of=AS_OF).explain()
    physical = buf.getvalue()
    assert physical.count("HashAggregate(keys=[section") == 2  # partial + final, once
