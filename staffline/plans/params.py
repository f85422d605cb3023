"""Parameters of the registered queries (shared by the Spark side and the
oracle SQL so that both always ask the same question)."""

from ..schemas import DEPARTMENTS, LEAVE_STATUSES, OFFICE_LOCATIONS, REVIEW_PERIODS

# An employee with leave requests and reviews at every scale factor.
ONE_EMPLOYEE = 10

# Benefit views that only show once the sanitiser's tokens are removed, one after the other.
UNCLEAN_HEALTH = " He-;-al/'*th "
UNCLEAN_RETIREMENT = "401<>k'"

SEARCH_DEPARTMENT = "Engineering"
SEARCH_ROLE = "MACH"
SEARCH_OFFICE = "Austin"
SEARCH_LIMIT = 50

LEAVE_STATUS = "Pending"
LEAVE_DAYS_BACK = 30
LEAVE_LIMIT = 100

REVIEW_PERIOD = "Q4 2024"
REVIEW_LIMIT = 50

SUMMARY_DAYS = 30
REVIEW_WINDOW_DAYS = 14
SUMMARY_DAYS_SHORT = 7
SUMMARY_DAYS_LONG = 365

COMBINED_STATUS = "Approved"
COMBINED_PERIOD = "Annual 2024"
WIDE_LIMIT = 1000

# Domains with one allowed value taken out of each, so that every rule of the
# rule report finds violations in the fixture.
NARROW_DOMAINS = dict(
    departments=tuple(d for d in DEPARTMENTS if d != "Legal"),
    statuses=tuple(s for s in LEAVE_STATUSES if s != "Cancelled"),
    periods=tuple(p for p in REVIEW_PERIODS if p != "Annual 2024"),
    offices=tuple(o for o in OFFICE_LOCATIONS if o != "Remote"),
)
