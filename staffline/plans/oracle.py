"""DuckDB oracle SQL for every registered query (tests and the driver's
correctness gate). Each statement starts with the fixture views as CTEs over
the driver tables (the SQL twin of ``staffline.sources.fixtures``) and then
computes the report from its definition: the profile by counting triples, lists by testing each row's owner and
looking its two names up, the summary by one query per metric.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions.text import STRIP_CHARS
from ..schemas import (
    BENEFIT_COLUMNS, DEPARTMENTS, EMPLOYEE_COLUMNS, EMPLOYEE_ID_RANGE, LEAVE_STATUSES, OFFICE_LOCATIONS, PERFORMANCE_FIELDS, REVIEW_PERIODS,
    SANITIZE_TOKENS,
)
from ..sources.fixtures import AS_OF, LEAVE_DATE_SHIFT_DAYS
from . import params as P

FIXTURE_CTES = f"""
WITH employees AS (
  SELECT c_custkey AS employee_id, c_name AS name,
    CASE c_custkey % 8 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Marketing' WHEN 2 THEN 'Finance' WHEN 3 THEN 'HR'
      WHEN 4 THEN 'Sales' WHEN 5 THEN 'Operations' WHEN 6 THEN 'Support' ELSE 'Legal' END AS department,
    c_mktsegment AS role, concat(lower(c_name), '@example.com') AS email, c_acctbal AS salary,
    CAST(c_custkey % 31 AS INT) AS leave_balance,
    CASE c_nationkey % 5 WHEN 0 THEN 'New York' WHEN 1 THEN 'San Francisco' WHEN 2 THEN 'Austin'
      WHEN 3 THEN 'Remote' ELSE 'Chicago' END AS office_location,
    CASE WHEN c_custkey % 17 = 0 THEN 'Inactive' ELSE 'Active' END AS employment_status,
    DATE '2015-01-01' + CAST(c_custkey % 3000 AS INT) AS hire_date
  FROM customer
), employee_benefits AS (
  SELECT c_custkey AS employee_id,
    CASE c_custkey % 4 WHEN 0 THEN 'PPO' WHEN 1 THEN 'HMO' WHEN 2 THEN 'HDHP' END AS health_plan,
    CASE c_custkey % 3 WHEN 0 THEN '401k' WHEN 1 THEN 'Roth 401k' ELSE '' END AS retirement_plan,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 7 AS DOUBLE) END AS company_match_percent,
    CAST(10 + c_custkey % 16 AS INT) AS pto_days_annual, CAST(5 + c_custkey % 6 AS INT) AS sick_days_annual,
    c_custkey % 2 = 0 AS dental_coverage, c_custkey % 3 = 0 AS vision_coverage,
    CAST(c_custkey % 4 AS INT) AS life_insurance,
    CASE WHEN c_custkey % 2 = 0 THEN 'Biweekly' ELSE 'Monthly' END AS pay_frequency
  FROM customer
), leave_requests AS (
  SELECT o_orderkey AS request_id, o_custkey AS employee_id,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey - o_custkey % 10 END AS approver_id,
    o_orderpriority AS leave_type,
    CASE WHEN o_orderstatus = 'O' THEN 'Pending' WHEN o_orderstatus = 'F' THEN 'Approved'
      WHEN o_orderkey % 2 = 0 THEN 'Denied' ELSE 'Cancelled' END AS status,
    o_orderdate + INTERVAL '{LEAVE_DATE_SHIFT_DAYS}' DAY AS submitted_timestamp
  FROM orders
), performance_reviews AS (
  SELECT event_id AS review_id, user_id AS employee_id,
    CASE WHEN event_id % 6 <> 0 THEN user_id - user_id % 10 END AS reviewer_id,
    CASE event_type WHEN 'click' THEN 'Q1 2024' WHEN 'error' THEN 'Q2 2024' WHEN 'purchase' THEN 'Q3 2024'
      WHEN 'signup' THEN 'Q4 2024' ELSE 'Annual 2024' END AS review_period,
    CAST(ts AS DATE) AS review_date,
    CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 101 AS INT) END AS goals_achievement,
    CAST(event_id % 5 + 1 AS INT) AS technical_skills, CAST(event_id % 4 + 1 AS INT) AS communication,
    CAST(event_id * 7 % 5 + 1 AS INT) AS overall_rating
  FROM events
)"""

NOW = f"TIMESTAMP '{AS_OF}'"
TODAY = f"CAST({NOW} AS DATE)"

EMP, BEN = EMPLOYEE_COLUMNS, BENEFIT_COLUMNS
# The lists' columns in the order of their JSON text.
LEAVE_JSON = ("request_id", "employee_id", "approver_id", "leave_type", "status", "submitted_timestamp", "employee_name", "department", "approver_name")
REVIEWS_JSON = ("review_id", "employee_id", "reviewer_id", "review_period", "review_date", "goals_achievement", "technical_skills", "communication",
                "overall_rating", "employee_name", "department", "reviewer_name")
EMP_NO_SALARY = tuple(c for c in EMP if c != "salary")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _sql(body: str) -> str:
    """A report body over the HR tables by name (it may open with its own WITH)."""
    return body.strip()


def with_fixture(body: str) -> str:
    """Prefix a report body with the fixture views, merging WITH clauses."""
    if body.startswith("WITH "):
        return FIXTURE_CTES + ",\n" + body[len("WITH "):]
    return FIXTURE_CTES + "\n" + body


# --- R1 / R1x ---------------------------------------------------------------

def _profile_fanout(emp_cols, with_benefit_cols: bool, where: str = "") -> str:
    """R1's counts are of triples: a leave request, a review (or none, where there are no reviews) and one of the copies of
    the employee's benefit record (or none). ``where`` is over ``who``."""
    shown = [f"who.{c}" for c in emp_cols] + [f"record.{c}" for c in (BEN if with_benefit_cols else ())]
    return _sql(f"""
WITH record AS (
  SELECT employee_id, {", ".join(BEN)}, COUNT(*) AS copies FROM employee_benefits GROUP BY ALL
), review_or_none AS (
  SELECT employee_id, TRUE AS reviewed FROM performance_reviews
  UNION ALL
  SELECT employee_id, FALSE FROM employees WHERE employee_id NOT IN (
    SELECT employee_id FROM performance_reviews WHERE employee_id IS NOT NULL)
), paired AS (
  SELECT r.employee_id, COUNT(request_id) AS requests, COUNT(*) FILTER (status = 'Pending') AS pending
  FROM review_or_none r, leave_requests l WHERE l.employee_id = r.employee_id GROUP BY r.employee_id
), scores AS (
  SELECT employee_id, AVG(goals_achievement) AS goals, AVG(technical_skills) AS technical, MAX(overall_rating) AS best
  FROM performance_reviews GROUP BY employee_id
)
SELECT {", ".join(shown)},
  COALESCE(requests * COALESCE(copies, 1), 0) AS total_leave_requests,
  COALESCE(pending * COALESCE(copies, 1), 0) AS pending_leave_requests,
  goals AS avg_goals_score, technical AS avg_technical_score, best AS latest_performance_rating
FROM employees who
LEFT JOIN record USING (employee_id) LEFT JOIN paired USING (employee_id) LEFT JOIN scores USING (employee_id)
{where}
""")


def _profile_exact(with_benefits: bool = True, where: str = "") -> str:
    e = ", ".join(f"e.{c}" for c in EMP_NO_SALARY)
    b = ", ".join(f"b.{c}" for c in BEN) if with_benefits else ""
    benefit_cols = f"{b}," if with_benefits else ""
    benefit_join = (f"LEFT JOIN (SELECT DISTINCT employee_id, {', '.join(BEN)} FROM employee_benefits) b "
                    "ON e.employee_id = b.employee_id") if with_benefits else ""
    return _sql(f"""
WITH lv AS (
  SELECT employee_id, COUNT(request_id) AS n, COUNT(CASE WHEN status = 'Pending' THEN 1 END) AS p
  FROM leave_requests GROUP BY employee_id
), rv AS (
  SELECT employee_id, AVG(goals_achievement) AS g, AVG(technical_skills) AS t, MAX(overall_rating) AS m
  FROM performance_reviews GROUP BY employee_id
), nw AS (
  SELECT employee_id, overall_rating AS r FROM (
    SELECT employee_id, overall_rating, ROW_NUMBER() OVER (
      PARTITION BY employee_id ORDER BY review_date DESC NULLS LAST, review_id DESC NULLS LAST) AS rn
    FROM performance_reviews) WHERE rn = 1
)
SELECT {e}, {benefit_cols}
  COALESCE(lv.n, 0) AS total_leave_requests, COALESCE(lv.p, 0) AS pending_leave_requests,
  rv.g AS avg_goals_score, rv.t AS avg_technical_score, rv.m AS latest_performance_rating,
  nw.r AS newest_review_rating
FROM employees e
{benefit_join}
LEFT JOIN lv ON e.employee_id = lv.employee_id
LEFT JOIN rv ON e.employee_id = rv.employee_id
LEFT JOIN nw ON e.employee_id = nw.employee_id
{where}
""")


def _renamed(inner: str, parts: dict[str, tuple[str, ...]]) -> str:
    """The columns of ``inner`` under the names that they have in the nested form."""
    shown = ", ".join(f"{c} AS {part}_{c}" for part, columns in parts.items() for c in columns)
    return f"SELECT employee_id, {shown} FROM ({inner})"


def _json_text(column: str, kind: str = "") -> str:
    value = f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%g')" if kind == "timestamp" else column
    return f"""'"{column}":' || to_json({value})::VARCHAR"""


def _json_object(columns: Iterable[str], sparse: bool = False, timestamps: tuple[str, ...] = ()) -> str:
    members = [_json_text(c, "timestamp" if c in timestamps else "") for c in columns]
    if not sparse:
        members = [f"""coalesce({m}, '"{c}":null')""" for c, m in zip(columns, members, strict=True)]
    return f"'{{' || array_to_string(list_filter([{', '.join(members)}], lambda m: m IS NOT NULL), ',') || '}}'"


def _profile_json(inner: str, basic: tuple[str, ...], with_benefits: bool = True) -> str:
    """The profile as JSON text: null fields are kept in the employee's part only."""
    parts = [f"""'"employee_id":' || employee_id""", f"""'"basic_info":' || {_json_object(basic)}"""]
    if with_benefits:
        parts.append(f"""'"benefits":' || {_json_object(BEN, sparse=True)}""")
    parts.append(f"""'"performance_summary":' || {_json_object(PERFORMANCE_FIELDS, sparse=True)}""")
    return f"SELECT '{{' || concat_ws(',', {', '.join(parts)}) || '}}' AS json FROM ({inner})"


def _rows_json(inner: str, columns: Iterable[str], timestamps: tuple[str, ...] = ()) -> str:
    return f"SELECT {_json_object(list(columns), timestamps=timestamps)} AS json FROM ({inner})"


# --- R2 ---------------------------------------------------------------------

def _looked_up(column: str, person: str) -> str:
    """One column of the employee with the id ``person``; null if there is none."""
    return f"(SELECT ANY_VALUE({column}) FROM employees WHERE employees.employee_id = {person})"


def _known(person: str) -> str:
    return f"{person} IN (SELECT employee_id FROM employees)"


def _benefits(where: str = "TRUE", view: tuple[str, ...] = ()) -> str:
    """``where`` is over ``employee_benefits``."""
    names = ", ".join(f"{_looked_up(c, 'employee_benefits.employee_id')} AS {c}" for c in ("name", "department", "role"))
    extra = "".join(f", {c} AS filtered_{c}" for c in view)
    return _sql(f"""
SELECT *, {names}{extra} FROM employee_benefits
WHERE {_known("employee_benefits.employee_id")} AND {where}
""")


# --- R3 ---------------------------------------------------------------------

def _search(where: str, limit: int) -> str:
    return _sql(f"""
SELECT employee_id, name, department, role, office_location, employment_status
FROM employees WHERE {where}
ORDER BY name ASC NULLS FIRST, employee_id
LIMIT {limit}
""")


# --- R4 / R5 ----------------------------------------------------------------

def _listed(table: str, date: str, key: str, other: str, where: str, limit: int) -> str:
    """The newest rows of ``table`` whose owner is known and that meet ``where``, with the two names looked up."""
    own = f"{table}.employee_id"
    return _sql(f"""
SELECT *, {_looked_up("name", own)} AS employee_name, {_looked_up("department", own)} AS department,
  {_looked_up("name", f"{table}.{other}_id")} AS {other}_name
FROM {table} WHERE {_known(own)} AND {where}
ORDER BY {date} DESC NULLS LAST, {key} LIMIT {limit}
""")


def _leave(where: str, limit: int) -> str:
    return _listed("leave_requests", "submitted_timestamp", "request_id", "approver", where, limit)


def _reviews(where: str, limit: int) -> str:
    return _listed("performance_reviews", "review_date", "review_id", "reviewer", where, limit)


# --- R6 ---------------------------------------------------------------------

def _leave_window(days: int) -> str:
    return f"submitted_timestamp >= {NOW} - INTERVAL '{days}' DAY"


def _review_window(days: int) -> str:
    return f"review_date >= {TODAY} - CAST({days} AS INT)"


def _summary(days: int) -> str:
    lw, rw = _leave_window(days), _review_window(days)
    avg0 = "CAST(COALESCE(AVG({c}), 0.0) AS DOUBLE)"
    scores = "\nUNION ALL ".join(
        f"SELECT 'performance_reviews', 'average_scores', '{c}', {avg0.format(c=c)} "
        f"FROM performance_reviews WHERE {rw}"
        for c in ("goals_achievement", "technical_skills", "communication"))
    return _sql(f"""
SELECT 'employees' AS section, 'total_employees' AS metric, CAST(NULL AS VARCHAR) AS key,
  CAST(COUNT(*) AS DOUBLE) AS value FROM employees
UNION ALL SELECT 'employees', 'department_breakdown', department, CAST(COUNT(*) AS DOUBLE)
  FROM employees GROUP BY department
UNION ALL SELECT 'benefits', 'health_plan_distribution', health_plan, CAST(COUNT(*) AS DOUBLE)
  FROM employee_benefits WHERE health_plan <> '' GROUP BY health_plan
UNION ALL SELECT 'benefits', 'retirement_plan_distribution', retirement_plan, CAST(COUNT(*) AS DOUBLE)
  FROM employee_benefits WHERE retirement_plan <> '' GROUP BY retirement_plan
UNION ALL SELECT 'benefits', 'average_company_match_percent', NULL, {avg0.format(c="company_match_percent")}
  FROM employee_benefits
UNION ALL SELECT 'leave_requests', 'total_requests', NULL, CAST(COUNT(*) AS DOUBLE)
  FROM leave_requests WHERE {lw}
UNION ALL SELECT 'leave_requests', 'status_breakdown', status, CAST(COUNT(*) AS DOUBLE)
  FROM leave_requests WHERE {lw} GROUP BY status
UNION ALL SELECT 'performance_reviews', 'total_reviews', NULL, CAST(COUNT(*) AS DOUBLE)
  FROM performance_reviews WHERE {rw}
UNION ALL {scores}
""")


# --- Q1 ---------------------------------------------------------------------

def _rules(departments, statuses, periods, offices):
    lo, hi = EMPLOYEE_ID_RANGE
    rng = f"employee_id IS NULL OR employee_id NOT BETWEEN {lo} AND {hi}"

    def dom(c, values):
        return f"{c} IS NOT NULL AND {c} <> '' AND {c} NOT IN {_in(values)}"

    return [
        ("employees", "employee_id", "employee_id_range", "employee_id", rng),
        ("employees", "employee_id", "department_domain", "department", dom("department", departments)),
        ("employees", "employee_id", "office_location_domain", "office_location",
         dom("office_location", offices)),
        ("employee_benefits", "employee_id", "employee_id_range", "employee_id", rng),
        ("leave_requests", "request_id", "employee_id_range", "employee_id", rng),
        ("leave_requests", "request_id", "status_domain", "status", dom("status", statuses)),
        ("performance_reviews", "review_id", "employee_id_range", "employee_id", rng),
        ("performance_reviews", "review_id", "review_period_domain", "review_period",
         dom("review_period", periods)),
    ]


def _rule_report(rules) -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{r}' AS rule, '{c}' AS column_name, COUNT(*) AS n_rows, "
        f"COUNT(CASE WHEN {cond} THEN 1 END) AS n_violations FROM {t}"
        for t, _k, r, c, cond in rules
    ]
    return _sql("\nUNION ALL ".join(parts))


def _rule_rows(rules) -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{r}' AS rule, '{c}' AS column_name, {k} AS row_key, "
        f"CAST({c} AS VARCHAR) AS value FROM {t} WHERE {cond}"
        for t, k, r, c, cond in rules
    ]
    return _sql("\nUNION ALL ".join(parts))


# --- Q2 ---------------------------------------------------------------------

def sanitize_sql(column: str) -> str:
    """DuckDB twin of ``sanitize_column``."""
    expr = f"COALESCE({column}, '')"
    for token in SANITIZE_TOKENS:
        expr = f"replace({expr}, {_q(token)}, '')"
    chars = " || ".join(f"chr({ord(c)})" for c in STRIP_CHARS)
    return f"substring(trim({expr}, {chars}), 1, 100)"


def oracle_sql() -> dict[str, str]:
    """The registered queries' SQL, each over the fixture views."""
    return {name: with_fixture(body) for name, body in report_sql().items()}


def report_sql() -> dict[str, str]:
    """The registered queries' SQL over the HR tables by name."""
    narrow = P.NARROW_DOMAINS
    return {
        "employee_profile": _profile_fanout(EMP_NO_SALARY, True),
        "employee_profile_salary": _profile_fanout(EMP, True),
        "employee_profile_no_benefits": _profile_fanout(EMP_NO_SALARY, False),
        "employee_profile_ids": _profile_fanout(
            EMP_NO_SALARY, True, "WHERE who.employee_id IN (SELECT approver_id FROM leave_requests)"),
        "employee_profile_exact": _profile_exact(),
        "employee_profile_exact_no_benefits": _profile_exact(with_benefits=False),
        "employee_profile_exact_ids": _profile_exact(
            where="WHERE e.employee_id IN (SELECT approver_id FROM leave_requests)"),
        "employee_profile_one": _profile_fanout(EMP_NO_SALARY, True, f"WHERE who.employee_id = {P.ONE_EMPLOYEE}"),
        "employee_profile_exact_one": _profile_exact(where=f"WHERE e.employee_id = {P.ONE_EMPLOYEE}"),
        "employee_profile_nested": _renamed(_profile_fanout(EMP, True), {
            "basic_info": (*EMP_NO_SALARY, "salary"), "benefits": tuple(BEN), "performance_summary": PERFORMANCE_FIELDS}),
        "employee_profile_exact_nested": _renamed(_profile_exact(), {
            "basic_info": tuple(EMP_NO_SALARY), "benefits": tuple(BEN), "performance_summary": (*PERFORMANCE_FIELDS, "newest_review_rating")}),
        "employee_profile_json": _profile_json(_profile_fanout(EMP_NO_SALARY, True), tuple(EMP_NO_SALARY)),
        "employee_profile_json_salary": _profile_json(_profile_fanout(EMP, False), (*EMP_NO_SALARY, "salary"), with_benefits=False),
        "leave_json": _rows_json(
            _leave("TRUE", P.LEAVE_LIMIT), LEAVE_JSON, timestamps=("submitted_timestamp",)),
        "reviews_json": _rows_json(_reviews("TRUE", P.REVIEW_LIMIT), REVIEWS_JSON),
        "benefits_cleaned_health": _benefits(view=("health_plan", "dental_coverage", "vision_coverage")),
        "benefits_cleaned_retirement": _benefits(
            "employee_benefits.employee_id IN (SELECT employee_id FROM leave_requests WHERE status = 'Pending')",
            view=("retirement_plan", "company_match_percent")),
        "hr_summary_without_reviews": f"SELECT * FROM ({_summary(P.SUMMARY_DAYS)}) WHERE section <> 'performance_reviews' UNION ALL "
            "SELECT 'performance_reviews', 'error', 'table performance_reviews is missing', NULL",
        "benefits_one": _benefits(f"employee_benefits.employee_id = {P.ONE_EMPLOYEE}"),
        "leave_one": _leave(f"leave_requests.employee_id = {P.ONE_EMPLOYEE}", P.LEAVE_LIMIT),
        "reviews_one": _reviews(f"performance_reviews.employee_id = {P.ONE_EMPLOYEE}", P.REVIEW_LIMIT),
        "benefits_all": _benefits(),
        "benefits_by_id": _benefits(
            "employee_benefits.employee_id IN (SELECT employee_id FROM leave_requests WHERE status = 'Pending')"),
        "benefits_health": _benefits(view=("health_plan", "dental_coverage", "vision_coverage")),
        "benefits_retirement": _benefits(view=("retirement_plan", "company_match_percent")),
        "benefits_by_id_retirement": _benefits(
            "employee_benefits.employee_id IN (SELECT employee_id FROM leave_requests WHERE status = 'Pending')",
            view=("retirement_plan", "company_match_percent")),
        "search_top_limit": _search("TRUE", P.WIDE_LIMIT),
        "search_department": _search(f"department = {_q(P.SEARCH_DEPARTMENT)}", P.SEARCH_LIMIT),
        "search_role": _search(f"contains(role, {_q(P.SEARCH_ROLE)})", P.SEARCH_LIMIT),
        "search_office": _search(f"office_location = {_q(P.SEARCH_OFFICE)}", P.SEARCH_LIMIT),
        "search_combined": _search(
            f"department = {_q(P.SEARCH_DEPARTMENT)} AND contains(role, {_q(P.SEARCH_ROLE)}) "
            f"AND office_location = {_q(P.SEARCH_OFFICE)}", P.SEARCH_LIMIT),
        "leave_recent": _leave("TRUE", P.LEAVE_LIMIT),
        "leave_by_status": _leave(f"status = {_q(P.LEAVE_STATUS)}", P.LEAVE_LIMIT),
        "leave_by_employee": _leave(
            "leave_requests.employee_id IN (SELECT employee_id FROM employees WHERE employment_status = 'Inactive')",
            P.LEAVE_LIMIT),
        "leave_days_back": _leave(_leave_window(P.LEAVE_DAYS_BACK), P.LEAVE_LIMIT),
        "leave_combined": _leave(
            "leave_requests.employee_id IN (SELECT employee_id FROM employees WHERE employment_status = 'Inactive') "
            f"AND status = {_q(P.COMBINED_STATUS)} AND "
            + _leave_window(P.SUMMARY_DAYS_LONG),
            P.WIDE_LIMIT),
        "reviews_combined": _reviews(
            "performance_reviews.employee_id IN (SELECT employee_id FROM employees WHERE office_location = 'Remote') "
            f"AND review_period = {_q(P.COMBINED_PERIOD)}", P.WIDE_LIMIT),
        "reviews_recent": _reviews("TRUE", P.REVIEW_LIMIT),
        "reviews_by_period": _reviews(f"review_period = {_q(P.REVIEW_PERIOD)}", P.REVIEW_LIMIT),
        "reviews_by_employee": _reviews(
            "performance_reviews.employee_id IN (SELECT employee_id FROM employees WHERE office_location = 'Remote')",
            P.REVIEW_LIMIT),
        "headcount_total": _sql("SELECT COUNT(*) AS total_employees FROM employees"),
        "headcount_by_department": _sql(
            "SELECT department, COUNT(*) AS count FROM employees GROUP BY department "
            "ORDER BY count DESC, department NULLS FIRST"),
        "health_plan_distribution": _sql(
            "SELECT health_plan, COUNT(*) AS count FROM employee_benefits WHERE health_plan <> '' "
            "GROUP BY health_plan ORDER BY count DESC, health_plan"),
        "retirement_plan_distribution": _sql(
            "SELECT retirement_plan, COUNT(*) AS count FROM employee_benefits WHERE retirement_plan <> '' "
            "GROUP BY retirement_plan ORDER BY count DESC, retirement_plan"),
        "avg_company_match": _sql(
            "SELECT CAST(COALESCE(AVG(company_match_percent), 0.0) AS DOUBLE) "
            "AS average_company_match_percent FROM employee_benefits"),
        "leave_window_total": _sql(
            f"SELECT COUNT(*) AS total_requests FROM leave_requests WHERE {_leave_window(P.SUMMARY_DAYS)}"),
        "leave_status_breakdown": _sql(
            f"SELECT status, COUNT(*) AS count FROM leave_requests WHERE {_leave_window(P.SUMMARY_DAYS)} "
            "GROUP BY status ORDER BY count DESC, status NULLS FIRST"),
        "review_window_total": _sql(
            f"SELECT COUNT(*) AS total_reviews FROM performance_reviews "
            f"WHERE {_review_window(P.REVIEW_WINDOW_DAYS)}"),
        "review_score_averages": _sql(
            "SELECT " + ", ".join(
                f"CAST(COALESCE(AVG({c}), 0.0) AS DOUBLE) AS {c}"
                for c in ("goals_achievement", "technical_skills", "communication"))
            + f" FROM performance_reviews WHERE {_review_window(P.REVIEW_WINDOW_DAYS)}"),
        "hr_summary": _summary(P.SUMMARY_DAYS),
        "hr_summary_week": _summary(P.SUMMARY_DAYS_SHORT),
        "hr_summary_year": _summary(P.SUMMARY_DAYS_LONG),
        "leave_status_breakdown_year": _sql(
            f"SELECT status, COUNT(*) AS count FROM leave_requests WHERE {_leave_window(P.SUMMARY_DAYS_LONG)} "
            "GROUP BY status"),
        "domain_rule_report": _rule_report(_rules(DEPARTMENTS, LEAVE_STATUSES, REVIEW_PERIODS, OFFICE_LOCATIONS)),
        "domain_rule_report_narrow": _rule_report(_rules(**narrow)),
        "domain_rule_rows": _rule_rows(_rules(**narrow)),
        "domain_rule_rows_default": _rule_rows(_rules(DEPARTMENTS, LEAVE_STATUSES, REVIEW_PERIODS, OFFICE_LOCATIONS)),
        "sanitize_documents": _sql(f"SELECT doc_id, {sanitize_sql('text')} AS clean_text FROM documents"),
        "sanitize_conversations": _sql(
            f"SELECT conv_id, turn, {sanitize_sql('text')} AS clean_text FROM conversations"),
        "sanitize_pages": _sql(f"SELECT page_id, {sanitize_sql('html')} AS clean_html FROM pages"),
    }
