"""Table contracts, value domains and report constants.

The four HR tables are addressed by the names below everywhere in the
library: every operator takes ``tables: dict[str, DataFrame]`` keyed by them.
"""

from __future__ import annotations

from pyspark.sql import types as T

EMPLOYEES = "employees"
BENEFITS = "employee_benefits"
LEAVE = "leave_requests"
REVIEWS = "performance_reviews"
TABLE_NAMES = (EMPLOYEES, BENEFITS, LEAVE, REVIEWS)

# Unique key of each table (the tie-breaker for every ordered report).
KEYS = {
    EMPLOYEES: "employee_id",
    BENEFITS: "employee_id",
    LEAVE: "request_id",
    REVIEWS: "review_id",
}

# ---------------------------------------------------------------------------
# These must equal the source system's domains and limits.
# ---------------------------------------------------------------------------
DEPARTMENTS = ("Engineering", "Marketing", "Finance", "HR", "Sales", "Operations", "Support", "Legal")
LEAVE_STATUSES = ("Pending", "Approved", "Denied", "Cancelled")
REVIEW_PERIODS = ("Q1 2024", "Q2 2024", "Q3 2024", "Q4 2024", "Annual 2024")
OFFICE_LOCATIONS = ("New York", "San Francisco", "Austin", "Remote", "Chicago")
EMPLOYEE_ID_RANGE = (201, 300)
MAX_RECORDS = 1000
SUMMARY_MAX_DAYS = 365
# benefit_type argument -> columns of the benefit sub-record
BENEFIT_VIEWS = {
    "health": ("health_plan", "dental_coverage", "vision_coverage"),
    "medical": ("health_plan", "dental_coverage", "vision_coverage"),
    "retirement": ("retirement_plan", "company_match_percent"),
    "401k": ("retirement_plan", "company_match_percent"),
}
# Sanitiser: tokens removed one after the other, in this order, then the
# white-space strip, then the cut to the first 100 characters.
SANITIZE_TOKENS = ("'", '"', ";", "--", "/*", "*/", "\\", "%", "<", ">", "&", "|")
SANITIZE_MAX_LENGTH = 100
EMPLOYEE_COLUMNS = (
    "employee_id", "name", "department", "role", "email", "salary",
    "leave_balance", "office_location", "employment_status", "hire_date",
)
BENEFIT_COLUMNS = (
    "health_plan", "retirement_plan", "company_match_percent", "pto_days_annual",
    "sick_days_annual", "dental_coverage", "vision_coverage", "life_insurance", "pay_frequency",
)
SEARCH_COLUMNS = ("employee_id", "name", "department", "role", "office_location", "employment_status")
# Output names of the profile.
PERFORMANCE_FIELDS = (
    "total_leave_requests", "pending_leave_requests", "avg_goals_score",
    "avg_technical_score", "latest_performance_rating",
)
# ---------------------------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


EXPECTED_SCHEMAS: dict[str, T.StructType] = {
    EMPLOYEES: _struct(
        ("employee_id", T.LongType()), ("name", T.StringType()), ("department", T.StringType()),
        ("role", T.StringType()), ("email", T.StringType()), ("salary", T.DoubleType()),
        ("leave_balance", T.IntegerType()), ("office_location", T.StringType()),
        ("employment_status", T.StringType()), ("hire_date", T.DateType()),
    ),
    BENEFITS: _struct(
        ("employee_id", T.LongType()), ("health_plan", T.StringType()), ("retirement_plan", T.StringType()),
        ("company_match_percent", T.DoubleType()), ("pto_days_annual", T.IntegerType()),
        ("sick_days_annual", T.IntegerType()), ("dental_coverage", T.BooleanType()),
        ("vision_coverage", T.BooleanType()), ("life_insurance", T.IntegerType()),
        ("pay_frequency", T.StringType()),
    ),
    LEAVE: _struct(
        ("request_id", T.LongType()), ("employee_id", T.LongType()), ("approver_id", T.LongType()),
        ("status", T.StringType()), ("submitted_timestamp", T.TimestampNTZType()),
    ),
    REVIEWS: _struct(
        ("review_id", T.LongType()), ("employee_id", T.LongType()), ("reviewer_id", T.LongType()), ("review_period", T.StringType()),
        ("review_date", T.DateType()), ("goals_achievement", T.IntegerType()),
        ("technical_skills", T.IntegerType()), ("communication", T.IntegerType()),
        ("overall_rating", T.IntegerType()),
    ),
}
