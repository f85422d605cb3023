"""Argument checks. They run on the driver before any job is built and raise
``ValueError``; the reports never start a Spark job to validate."""

from __future__ import annotations

from collections.abc import Iterable

from .schemas import (
    DEPARTMENTS, LEAVE_STATUSES, MAX_RECORDS, REVIEW_PERIODS, SUMMARY_MAX_DAYS,
)


def present(value) -> bool:
    """A string argument counts as given when it is neither None nor ''."""
    return value is not None and value != ""


def check_limit(limit: int, max_records: int = MAX_RECORDS) -> int:
    """``max_records`` is the ceiling that the operator of the reports sets; a limit above it raises, nothing is cut silently."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= max_records:
        raise ValueError(f"limit must be between 1 and {max_records}, got {limit!r}")
    return limit


def check_domain(name: str, value, domain: Iterable[str]):
    """Membership check; an absent value passes."""
    domain = tuple(domain)
    if present(value) and value not in domain:
        raise ValueError(f"invalid {name} {value!r}; must be one of: {', '.join(domain)}")
    return value


def check_department(value):
    return check_domain("department", value, DEPARTMENTS)


def check_status(value):
    return check_domain("status", value, LEAVE_STATUSES)


def check_period(value):
    return check_domain("review period", value, REVIEW_PERIODS)


def check_summary_days(days: int) -> int:
    if isinstance(days, bool) or not isinstance(days, int) or not 1 <= days <= SUMMARY_MAX_DAYS:
        raise ValueError(f"days_back must be between 1 and {SUMMARY_MAX_DAYS}, got {days!r}")
    return days


def lookback_days(days) -> int | None:
    """Leave-list look-back: only a positive int applies; anything else means
    no look-back (the source ignores it silently)."""
    if isinstance(days, int) and not isinstance(days, bool) and days > 0:
        return days
    return None
