"""Report arguments and the cases that a report must not pass over: ids, clock, ceiling, duplicates, absent tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline import (
    domain_rule_report, domain_rule_rows, employee_benefits, employee_profile, employee_profile_exact, headcount_by_department,
    hr_summary, leave_requests, leave_status_breakdown, leave_window_total, performance_reviews, review_window_total,
    search_employees,
)
from staffline.functions import as_ids, json_lines, parse_as_of
from staffline.functions.text import sanitize_column
from staffline.operators.benefits import benefit_view
from staffline.operators.quality import Rule
from staffline.schemas import BENEFIT_VIEWS, BENEFITS, EMPLOYEES, LEAVE, REVIEWS, SANITIZE_TOKENS
from staffline.sources import catalog_tables, qualified_name

from .conftest import benefit, leave_row, make_tables, review_row

REPORTS = [employee_profile, employee_profile_exact, employee_benefits, leave_requests, performance_reviews]


@pytest.fixture
def tables(spark):
    return make_tables(
        spark,
        employees=[(i, f"N{i}") for i in range(200, 210)],
        benefits=[benefit(i) for i in range(200, 210)],
        leave=[leave_row(i, 200 + i % 10) for i in range(30)],
        reviews=[review_row(i, 200 + i % 10) for i in range(20)],
    )


@pytest.mark.parametrize("report", REPORTS)
def test_ids_given_in_any_way_give_the_same_rows(spark, tables, report):
    frame = spark.createDataFrame([(205,), (206,), (205,)], "employee_id bigint")
    want = sorted(map(str, report(tables, ids=[205, 206]).collect()))
    assert len(want) >= 2
    for ids in ((i for i in (205, 206)), {205, 206}, (206, 205, 206), iter([205, 206]), frame, map(int, "205 206".split())):
        assert sorted(map(str, report(tables, ids=ids).collect())) == want
    assert sorted(map(str, report(tables, ids=(i for i in (205, 206)), id_range=(201, 300)).collect())) == want


@pytest.mark.parametrize("report", REPORTS)
@pytest.mark.parametrize("ids", ["205", b"205", 205.0, [205.9], [True], True, ["205"], [None], object()])
def test_other_ids_are_refused_before_any_job(tables, report, ids):
    for id_range in (None, (201, 300)):
        with pytest.raises(ValueError):
            report(tables, ids=ids, id_range=id_range)


def test_long_lists_of_ids_are_one_filter():
    assert len(as_ids(range(50_000))) == 50_000


def test_equal_rows_stay_separate_rows(spark, tables):
    doubled = {**tables, LEAVE: tables[LEAVE].unionByName(tables[LEAVE].where("request_id < 5")), REVIEWS: tables[REVIEWS].unionByName(tables[REVIEWS])}
    assert leave_requests(doubled).count() == 35
    assert performance_reviews(doubled, limit=33).count() == 33
    rows = leave_requests(doubled, limit=3).collect()
    assert [r.request_id for r in rows] == [0, 0, 1] and rows[0] == rows[1]


def test_keys_that_repeat_with_other_owners(spark):
    t = make_tables(spark, employees=[(1, "A"), (2, "B")],
                    leave=[leave_row(7, 1), leave_row(7, 2), leave_row(7, 9), leave_row(8, None), leave_row(9, 2, ts=None)])
    got = [(r.request_id, r.employee_name) for r in leave_requests(t).collect()]
    assert sorted(got[:2]) == [(7, "A"), (7, "B")] and got[2:] == [(9, "B")]


def test_ceiling_is_a_parameter(spark):
    n = 1500
    t = make_tables(spark, employees=[(i, f"N{i:05}") for i in range(n)],
                    leave=[leave_row(i, i) for i in range(n)], reviews=[review_row(i, i) for i in range(n)])
    for report in (search_employees, leave_requests, performance_reviews):
        with pytest.raises(ValueError):
            report(t, limit=5000)
        assert report(t, limit=5000, max_records=5000).count() == n


# ------------------------------------------------------------------ clock

def with_type(t, table, column, kind):
    return {**t, table: t[table].withColumn(column, F.col(column).cast(kind))}


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_both_clocks_on_every_column_type(spark, kind):
    day = dt.datetime(2024, 1, 1)
    hours = [0, 5, 12, 18]
    t = make_tables(spark, employees=[(1, "A")], leave=[leave_row(h, 1, ts=day + dt.timedelta(hours=h)) for h in hours],
                    reviews=[review_row(h, 1, date=None) for h in hours])
    t[REVIEWS] = t[REVIEWS].withColumn("review_date", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("review_id").cast("int")))
    t = with_type(with_type(t, LEAVE, "submitted_timestamp", kind), REVIEWS, "review_date", kind)
    as_of = "2024-01-31 12:00:00"
    assert review_window_total(t, 30, as_of=as_of).first()[0] == 4  # from midnight on
    assert leave_window_total(t, 30, as_of=as_of).first()[0] == (0 if kind == "date" else 2)  # from noon on
    assert leave_requests(t, days_back=30, as_of=as_of).count() == (0 if kind == "date" else 2)
    assert leave_window_total(t, 30, as_of="2024-01-31").first()[0] == 4


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("as_of", ["31/01/2024", "now", "", 20240131, "2024-13-01"])
def test_a_bad_clock_is_refused(spark, tables, ansi, as_of):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for call in (lambda: leave_requests(tables, days_back=3, as_of=as_of), lambda: hr_summary(tables, as_of=as_of)):
            with pytest.raises(ValueError):
                call()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_a_zoned_clock_is_moved_to_the_session_zone(spark):
    zoned = dt.datetime(2024, 1, 31, 1, tzinfo=dt.timezone(dt.timedelta(hours=5)))
    assert parse_as_of(zoned, "UTC") == parse_as_of("2024-01-31T01:00:00+05:00", "UTC") == dt.datetime(2024, 1, 30, 20)
    assert parse_as_of(dt.date(2024, 1, 31), "UTC") == dt.datetime(2024, 1, 31)
    t = make_tables(spark, employees=[(1, "A")], leave=[leave_row(h, 1, ts=dt.datetime(2024, 1, 30, h)) for h in range(24)])
    wall = parse_as_of(zoned, spark.conf.get("spark.sql.session.timeZone"))
    first = wall - dt.timedelta(days=1)
    kept = sum(dt.datetime(2024, 1, 30, h) >= first for h in range(24))
    assert leave_window_total(t, 1, as_of=zoned).first()[0] == kept


def test_the_session_clock(spark):
    now = dt.datetime.now()
    t = make_tables(spark, employees=[(1, "A")],
                    leave=[leave_row(1, 1, ts=now - dt.timedelta(days=2)), leave_row(2, 1, ts=now - dt.timedelta(days=9))],
                    reviews=[review_row(1, 1, date=now.date() - dt.timedelta(days=2)), review_row(2, 1, date=now.date() - dt.timedelta(days=9))])
    assert leave_window_total(t, 5).first()[0] == review_window_total(t, 5).first()[0] == 1
    assert leave_requests(t, days_back=5).count() == 1


# ------------------------------------------------------------------ absent tables and columns

def test_summary_marks_what_it_cannot_build(tables):
    partial = {k: v for k, v in tables.items() if k != LEAVE}
    partial[EMPLOYEES] = partial[EMPLOYEES].drop("department")
    rows = hr_summary(partial, 30, as_of="2024-01-31").collect()
    errors = {r.section: (r.key, r.value) for r in rows if r.metric == "error"}
    assert errors == {"employees": ("employees has no column department", None), "leave_requests": ("table leave_requests is missing", None)}
    assert {r.section for r in rows if r.metric != "error"} == {"benefits", "performance_reviews"}
    with pytest.raises(ValueError):
        hr_summary(partial, sections=["benefits", "leave_requests"])
    with pytest.raises(ValueError):
        hr_summary({}, 30)


def test_rules_of_absent_tables_are_not_passed_over(tables):
    only = {EMPLOYEES: tables[EMPLOYEES]}
    report = domain_rule_report(only).collect()
    assert len(report) == 8 and sum(r.n_rows is None and r.n_violations is None for r in report) == 5
    rows = domain_rule_rows(only).collect()
    assert sum(r.value == "table is missing" and r.row_key is None for r in rows) == 5
    named = [Rule(LEAVE, "status_domain", "status", "domain", ("Pending",))]
    for check in (domain_rule_report, domain_rule_rows):
        with pytest.raises(ValueError):
            check(only, named)


# ------------------------------------------------------------------ JSON, order, catalog

def test_json_keeps_nulls_but_in_the_sparse_parts(spark):
    t = make_tables(spark, employees=[(1, None)], benefits=[benefit(1, health=None)])
    text = json_lines(employee_profile(t, nested=True)).first()["json"]
    got = json.loads(text)
    assert got["basic_info"]["name"] is None and "name" in got["basic_info"]
    assert "health_plan" not in got["benefits"] and got["benefits"]["retirement_plan"] == "401k"
    assert got["performance_summary"] == {"total_leave_requests": 0, "pending_leave_requests": 0}
    assert list(got) == ["employee_id", "basic_info", "benefits", "performance_summary"]
    flat = json.loads(json_lines(search_employees(t)).first()["json"])
    assert flat["name"] is None and flat["employee_id"] == 1
    assert json.loads(json_lines(spark.createDataFrame([(None,)], "benefits struct<a: int>")).first()["json"]) == {}


def test_nested_profile_values(spark):
    t = make_tables(spark, employees=[(1, "A")], benefits=[benefit(1, match=4.5)], leave=[leave_row(1, 1, "Pending")], reviews=[review_row(1, 1, goals=80)])
    row = employee_profile(t, nested=True, include_salary=True).first()
    assert (row.basic_info.name, row.basic_info.salary, row.benefits.company_match_percent) == ("A", 1000.0, 4.5)
    assert tuple(row.performance_summary) == (1, 1, 80.0, 3.0, 4)


def test_grouped_counts_are_ordered_largest_first(spark):
    t = make_tables(spark, employees=[(i, f"N{i}", d) for i, d in enumerate(["HR", "Legal", "HR", None, "Finance", "Legal", "HR", None])],
                    leave=[leave_row(i, 1, s) for i, s in enumerate(["Denied", "Pending", "Pending", None])])
    assert [tuple(r) for r in headcount_by_department(t).collect()] == [("HR", 3), (None, 2), ("Legal", 2), ("Finance", 1)]
    assert [tuple(r) for r in leave_status_breakdown(t, 30, as_of="2024-01-31").collect()] == [("Pending", 2), (None, 1), ("Denied", 1)]


def test_catalog_tables(spark, tables):
    assert [qualified_name("t"), qualified_name("t", schema="s"), qualified_name("t", "c", "s")] == ["t", "s.t", "c.s.t"]
    spark.sql("CREATE DATABASE IF NOT EXISTS staffline_hr")
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"staffline_hr.{name}")
    found = catalog_tables(spark, "spark_catalog", "staffline_hr")
    assert set(found) == set(tables) and isinstance(found[BENEFITS].schema, T.StructType)
    assert sorted(employee_profile(found).collect()) == sorted(employee_profile(tables).collect())
    assert leave_requests(found, ids=203).count() == 3


def test_benefit_type_is_cleaned_like_a_column(spark):
    """Random arguments made of view names and the sanitiser's tokens: the view is that of the argument cleaned as a column is."""
    rng = random.Random(8)
    pieces = [*SANITIZE_TOKENS, *SANITIZE_TOKENS, "-", "/", "*", " ", "\t", " ", "x"]
    given = ["he-;-alth", "health/'*", "he/%*alth", "-\\-health", " Medical;", "40\"1k", "", "  ", "';", "health" + " " * 120, "x" * 100 + "health"]
    for _ in range(400):
        name = list(rng.choice(["health", "Medical", "RETIREMENT", "401k"]))
        for _ in range(rng.randint(0, 4)):
            name.insert(rng.randint(0, len(name)), rng.choice(pieces))
        given.append("".join(name))
    cleaned = spark.createDataFrame([(g,) for g in given], "g string").select("g", sanitize_column(F.lower("g")).alias("c")).collect()
    assert [benefit_view(r.g) for r in cleaned] == [BENEFIT_VIEWS.get(r.c) for r in cleaned]
    assert [benefit_view(g) is not None for g in given[:6]] == [True, True, False, False, True, True]
