"""The reports. Each takes ``tables: dict[str, DataFrame]`` (keyed by the names
in ``staffline.schemas``) plus parameters and returns a lazy DataFrame; none
runs a Spark action."""

from .benefits import benefit_view, employee_benefits
from .lists import leave_requests, performance_reviews
from .profile import employee_profile, employee_profile_exact
from .quality import Rule, default_rules, domain_rule_report, domain_rule_rows, table_contract, tables_exist
from .search import search_employees
from .summary import (
    average_company_match, headcount_by_department, headcount_total, health_plan_distribution,
    hr_summary, leave_status_breakdown, leave_window_total, plan_distribution,
    retirement_plan_distribution, review_score_averages, review_window_total,
)
from .text import sanitize_text

__all__ = [
    "benefit_view", "employee_benefits", "leave_requests", "performance_reviews",
    "employee_profile", "employee_profile_exact", "Rule", "default_rules",
    "domain_rule_report", "domain_rule_rows", "table_contract", "tables_exist",
    "search_employees", "average_company_match", "headcount_by_department", "headcount_total",
    "health_plan_distribution", "hr_summary", "leave_status_breakdown", "leave_window_total",
    "plan_distribution", "retirement_plan_distribution", "review_score_averages",
    "review_window_total", "sanitize_text",
]
