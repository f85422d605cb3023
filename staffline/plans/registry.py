"""The registered queries: each report with fixed parameters over the fixture
tables of one scale-factor folder. Every query reads whole tables; id sets are
derived from the data by Spark. The ``*_one`` queries are the look-up of one employee by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import json_lines
from ..schemas import BENEFITS, EMPLOYEES, LEAVE, REVIEWS, TABLE_NAMES
from ..sources.fixtures import AS_OF, fixture_tables
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]


def _flat_benefits(df: DataFrame) -> DataFrame:
    """Oracle-friendly form of R2: the sub-record as ``filtered_*`` columns."""
    if "filtered_benefits" not in df.columns:
        return df
    inner = df.schema["filtered_benefits"].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != "filtered_benefits"],
                     *[F.col(f"filtered_benefits.{c}").alias(f"filtered_{c}") for c in inner])


def _flat_profile(df: DataFrame) -> DataFrame:
    """Every field of the nested profile as a column named after its part."""
    parts = [f.name for f in df.schema if f.name != "employee_id"]
    return df.select("employee_id", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in parts for c in df.schema[p].dataType.fieldNames()))


def _q(build: Callable[[dict[str, DataFrame]], DataFrame], *names: str) -> Query:
    """A report over the fixture tables ``names`` (all of them if none is given)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(fixture_tables(spark, sf_dir, names or TABLE_NAMES))
    run.__doc__ = build.__doc__
    return run


def _approvers(t):
    return t[LEAVE].select(F.col("approver_id").alias("employee_id"))


def _pending_requesters(t):
    return t[LEAVE].filter(F.col("status") == "Pending").select("employee_id")


def _inactive(t):
    return t[EMPLOYEES].filter(F.col("employment_status") == "Inactive").select("employee_id")


def _remote(t):
    return t[EMPLOYEES].filter(F.col("office_location") == "Remote").select("employee_id")


def queries() -> dict[str, Query]:
    sd, rw = P.SUMMARY_DAYS, P.REVIEW_WINDOW_DAYS
    return {
        # R1 / R1x
        "employee_profile": _q(lambda t: ops.employee_profile(t)),
        "employee_profile_salary": _q(lambda t: ops.employee_profile(t, include_salary=True)),
        "employee_profile_no_benefits": _q(lambda t: ops.employee_profile(t, include_benefits=False)),
        "employee_profile_ids": _q(lambda t: ops.employee_profile(t, ids=_approvers(t))),
        "employee_profile_exact": _q(lambda t: ops.employee_profile_exact(t)),
        "employee_profile_exact_no_benefits": _q(lambda t: ops.employee_profile_exact(t, include_benefits=False)),
        "employee_profile_exact_ids": _q(lambda t: ops.employee_profile_exact(t, ids=_approvers(t))),
        "employee_profile_one": _q(lambda t: ops.employee_profile(t, ids=P.ONE_EMPLOYEE)),
        "employee_profile_exact_one": _q(lambda t: ops.employee_profile_exact(t, ids=[P.ONE_EMPLOYEE])),
        # The nested form, field by field, and as JSON text
        "employee_profile_nested": _q(lambda t: _flat_profile(ops.employee_profile(t, include_salary=True, nested=True))),
        "employee_profile_exact_nested": _q(lambda t: _flat_profile(ops.employee_profile_exact(t, nested=True))),
        "employee_profile_json": _q(lambda t: json_lines(ops.employee_profile(t, nested=True))),
        "employee_profile_json_salary": _q(lambda t: json_lines(ops.employee_profile(t, include_salary=True, include_benefits=False, nested=True))),
        "leave_json": _q(lambda t: json_lines(ops.leave_requests(t, limit=P.LEAVE_LIMIT)), EMPLOYEES, LEAVE),
        "reviews_json": _q(lambda t: json_lines(ops.performance_reviews(t, limit=P.REVIEW_LIMIT)), EMPLOYEES, REVIEWS),
        # R2
        "benefits_all": _q(lambda t: ops.employee_benefits(t), EMPLOYEES, BENEFITS),
        "benefits_by_id": _q(lambda t: ops.employee_benefits(t, ids=_pending_requesters(t)), EMPLOYEES, BENEFITS, LEAVE),
        "benefits_health": _q(lambda t: _flat_benefits(ops.employee_benefits(t, benefit_type="health")), EMPLOYEES, BENEFITS),
        "benefits_retirement": _q(lambda t: _flat_benefits(ops.employee_benefits(t, benefit_type="401k")), EMPLOYEES, BENEFITS),
        "benefits_by_id_retirement": _q(lambda t: _flat_benefits(ops.employee_benefits(
            t, ids=_pending_requesters(t), benefit_type="retirement")), EMPLOYEES, BENEFITS, LEAVE),
        "benefits_cleaned_health": _q(lambda t: _flat_benefits(ops.employee_benefits(
            t, benefit_type=P.UNCLEAN_HEALTH)), EMPLOYEES, BENEFITS),
        "benefits_cleaned_retirement": _q(lambda t: _flat_benefits(ops.employee_benefits(
            t, ids=_pending_requesters(t), benefit_type=P.UNCLEAN_RETIREMENT)), EMPLOYEES, BENEFITS, LEAVE),
        "benefits_one": _q(lambda t: ops.employee_benefits(t, ids=P.ONE_EMPLOYEE), EMPLOYEES, BENEFITS),
        # R3
        "search_department": _q(lambda t: ops.search_employees(
            t, department=P.SEARCH_DEPARTMENT, limit=P.SEARCH_LIMIT), EMPLOYEES),
        "search_role": _q(lambda t: ops.search_employees(t, role=P.SEARCH_ROLE, limit=P.SEARCH_LIMIT), EMPLOYEES),
        "search_office": _q(lambda t: ops.search_employees(
            t, office_location=P.SEARCH_OFFICE, limit=P.SEARCH_LIMIT), EMPLOYEES),
        "search_combined": _q(lambda t: ops.search_employees(
            t, department=P.SEARCH_DEPARTMENT, role=P.SEARCH_ROLE, office_location=P.SEARCH_OFFICE,
            limit=P.SEARCH_LIMIT), EMPLOYEES),
        "search_top_limit": _q(lambda t: ops.search_employees(t, limit=P.WIDE_LIMIT), EMPLOYEES),
        # R4
        "leave_recent": _q(lambda t: ops.leave_requests(t, limit=P.LEAVE_LIMIT), EMPLOYEES, LEAVE),
        "leave_by_status": _q(lambda t: ops.leave_requests(t, status=P.LEAVE_STATUS, limit=P.LEAVE_LIMIT), EMPLOYEES, LEAVE),
        "leave_by_employee": _q(lambda t: ops.leave_requests(t, ids=_inactive(t), limit=P.LEAVE_LIMIT), EMPLOYEES, LEAVE),
        "leave_days_back": _q(lambda t: ops.leave_requests(
            t, days_back=P.LEAVE_DAYS_BACK, as_of=AS_OF, limit=P.LEAVE_LIMIT), EMPLOYEES, LEAVE),
        "leave_combined": _q(lambda t: ops.leave_requests(
            t, ids=_inactive(t), status=P.COMBINED_STATUS, days_back=P.SUMMARY_DAYS_LONG, as_of=AS_OF,
            limit=P.WIDE_LIMIT), EMPLOYEES, LEAVE),
        "leave_one": _q(lambda t: ops.leave_requests(t, ids=P.ONE_EMPLOYEE, limit=P.LEAVE_LIMIT), EMPLOYEES, LEAVE),
        # R5
        "reviews_recent": _q(lambda t: ops.performance_reviews(t, limit=P.REVIEW_LIMIT), EMPLOYEES, REVIEWS),
        "reviews_by_period": _q(lambda t: ops.performance_reviews(
            t, review_period=P.REVIEW_PERIOD, limit=P.REVIEW_LIMIT), EMPLOYEES, REVIEWS),
        "reviews_by_employee": _q(lambda t: ops.performance_reviews(t, ids=_remote(t), limit=P.REVIEW_LIMIT), EMPLOYEES, REVIEWS),
        "reviews_combined": _q(lambda t: ops.performance_reviews(
            t, ids=_remote(t), review_period=P.COMBINED_PERIOD, limit=P.WIDE_LIMIT), EMPLOYEES, REVIEWS),
        "reviews_one": _q(lambda t: ops.performance_reviews(t, ids=P.ONE_EMPLOYEE, limit=P.REVIEW_LIMIT), EMPLOYEES, REVIEWS),
        # R6
        "headcount_total": _q(ops.headcount_total, EMPLOYEES),
        "headcount_by_department": _q(ops.headcount_by_department, EMPLOYEES),
        "health_plan_distribution": _q(ops.health_plan_distribution, BENEFITS),
        "retirement_plan_distribution": _q(ops.retirement_plan_distribution, BENEFITS),
        "avg_company_match": _q(ops.average_company_match, BENEFITS),
        "leave_window_total": _q(lambda t: ops.leave_window_total(t, sd, as_of=AS_OF), LEAVE),
        "leave_status_breakdown": _q(lambda t: ops.leave_status_breakdown(t, sd, as_of=AS_OF), LEAVE),
        "review_window_total": _q(lambda t: ops.review_window_total(t, rw, as_of=AS_OF), REVIEWS),
        "review_score_averages": _q(lambda t: ops.review_score_averages(t, rw, as_of=AS_OF), REVIEWS),
        "hr_summary": _q(lambda t: ops.hr_summary(t, sd, as_of=AS_OF)),
        "hr_summary_week": _q(lambda t: ops.hr_summary(t, P.SUMMARY_DAYS_SHORT, as_of=AS_OF)),
        "hr_summary_year": _q(lambda t: ops.hr_summary(t, P.SUMMARY_DAYS_LONG, as_of=AS_OF)),
        "hr_summary_without_reviews": _q(lambda t: ops.hr_summary({k: v for k, v in t.items() if k != REVIEWS}, sd, as_of=AS_OF)),
        "leave_status_breakdown_year": _q(lambda t: ops.leave_status_breakdown(
            t, P.SUMMARY_DAYS_LONG, as_of=AS_OF), LEAVE),
        # Q1
        "domain_rule_report": _q(lambda t: ops.domain_rule_report(t)),
        "domain_rule_report_narrow": _q(lambda t: ops.domain_rule_report(
            t, ops.default_rules(**P.NARROW_DOMAINS))),
        "domain_rule_rows": _q(lambda t: ops.domain_rule_rows(t, ops.default_rules(**P.NARROW_DOMAINS))),
        "domain_rule_rows_default": _q(lambda t: ops.domain_rule_rows(t)),
        # Q2 (driver text tables): cleaned in the scan's own stage
        "sanitize_documents": lambda spark, d: ops.sanitize_text(
            _read(spark, d, "documents"), {"text": "clean_text"}, keep=["doc_id"]),
        "sanitize_conversations": lambda spark, d: ops.sanitize_text(
            _read(spark, d, "conversations"), {"text": "clean_text"}, keep=["conv_id", "turn"]),
        "sanitize_pages": lambda spark, d: ops.sanitize_text(
            _read(spark, d, "pages"), {"html": "clean_html"}, keep=["page_id"]),
    }


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
