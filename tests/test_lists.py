"""R2-R5: benefits list, search, leave and review lists."""

import datetime as dt

import pytest

from staffline import employee_benefits, leave_requests, performance_reviews, search_employees
from staffline.operators.benefits import benefit_view

from .conftest import benefit, leave_row, make_tables, review_row

T0 = dt.datetime(2024, 1, 10)


@pytest.fixture
def tables(spark):
    return make_tables(
        spark,
        employees=[(1, "Ann", "Engineering", "Austin"), (2, "Bob", "Sales", "Remote"),
                   (3, None, "Engineering", "Austin"), (4, "Dee", "HR", "Chicago")],
        benefits=[benefit(1), benefit(2, health=None), benefit(9)],
        leave=[leave_row(5, 1, ts=T0, approver=2), leave_row(4, 1, ts=T0, approver=77),
               leave_row(3, 2, ts=T0), leave_row(2, 99, ts=dt.datetime(2024, 1, 20)),
               leave_row(1, 2, "Pending", ts=dt.datetime(2023, 1, 1)),
               leave_row(6, 1, ts=None)],
        reviews=[review_row(1, 1, date=dt.date(2024, 1, 5), reviewer=4),
                 review_row(2, 2, date=dt.date(2024, 1, 5), period="Q2 2024"),
                 review_row(3, 99, date=dt.date(2024, 1, 9))],
    )


def test_benefits_inner_join_and_order(tables):
    rows = employee_benefits(tables).collect()
    assert [r["employee_id"] for r in rows] == [1, 2]  # 9 has no employee
    assert rows[0]["name"] == "Ann" and rows[0]["department"] == "Engineering"


@pytest.mark.parametrize("arg,view", [
    ("health", ("health_plan", "dental_coverage", "vision_coverage")),
    ("MEDICAL", ("health_plan", "dental_coverage", "vision_coverage")),
    ("401k", ("retirement_plan", "company_match_percent")),
    ("'retirement'", ("retirement_plan", "company_match_percent")),
    ("dental", None), (None, None), ("", None),
])
def test_benefit_view(arg, view):
    assert benefit_view(arg) == view


def test_benefit_subrecord_keeps_rows(tables):
    df = employee_benefits(tables, benefit_type="health")
    rows = df.collect()
    assert len(rows) == 2
    assert rows[1]["filtered_benefits"]["health_plan"] is None
    assert "filtered_benefits" not in employee_benefits(tables, benefit_type="vision").columns


def test_search_filters_and_null_name_first(tables):
    rows = search_employees(tables, department="Engineering").collect()
    assert [r["employee_id"] for r in rows] == [3, 1]
    assert search_employees(tables, role="Eng", office_location="Remote").count() == 1
    assert search_employees(tables, role="'").count() == 4  # sanitised to '' -> every non-null role
    assert search_employees(tables, limit=2).count() == 2
    assert len(search_employees(tables).columns) == 6


@pytest.mark.parametrize("kwargs", [dict(limit=0), dict(limit=1001), dict(department="Space")])
def test_search_arguments(tables, kwargs):
    with pytest.raises(ValueError):
        search_employees(tables, **kwargs)


def test_leave_tie_break_and_names(tables):
    rows = leave_requests(tables, limit=2).collect()
    # 99 is unknown -> dropped; ties at T0 broken by request_id
    assert [r["request_id"] for r in rows] == [3, 4]
    by_id = {r["request_id"]: r for r in leave_requests(tables).collect()}
    assert by_id[4]["approver_name"] is None  # approver 77 unknown: kept, name null
    assert by_id[5]["approver_name"] == "Bob"
    assert by_id[5]["employee_name"] == "Ann"
    assert 2 not in by_id
    assert list(by_id)[-1] == 6  # null timestamp last


def test_leave_filters(tables):
    assert [r["request_id"] for r in leave_requests(tables, status="Pending").collect()] == [1]
    recent = leave_requests(tables, days_back=30, as_of="2024-01-31 00:00:00").collect()
    assert sorted(r["request_id"] for r in recent) == [3, 4, 5]
    # a non-positive look-back is ignored, as in the source
    assert leave_requests(tables, days_back=0).count() == 5
    assert [r["request_id"] for r in leave_requests(tables, ids=[2]).collect()] == [3, 1]


@pytest.mark.parametrize("kwargs", [dict(status="Lost"), dict(limit=0)])
def test_leave_arguments(tables, kwargs):
    with pytest.raises(ValueError):
        leave_requests(tables, **kwargs)


def test_reviews(tables):
    rows = performance_reviews(tables).collect()
    assert [r["review_id"] for r in rows] == [1, 2]
    assert rows[0]["reviewer_name"] == "Dee" and rows[1]["reviewer_name"] is None
    assert [r["review_id"] for r in performance_reviews(tables, review_period="Q2 2024").collect()] == [2]
    with pytest.raises(ValueError):
        performance_reviews(tables, review_period="Q5 2024")
