"""R6: workforce summary.

``hr_summary`` reads each table once, with one aggregate for it: employees by department, benefits by both plans,
leave requests by status, reviews as a whole. The totals, the distributions and the means are derived from those
few grouped rows, as ``(section, metric, key, n, value)`` entries that a last small aggregate adds up, together with a
fixed skeleton of the scalar metrics (at most seven rows, so that totals are 0 and means 0.0 on empty input, as
in the source). What is shuffled is a row for each group and task; a hot key costs nothing extra. The
result is the long form ``(section, metric, key, value double)``.

The single-metric functions (R6a-R6i) are the plain aggregations, one result
each.

Null and '' rules (as in the source): a null department or status is kept
as its own group; null and '' plan names are dropped from the distributions
(but the rows still count for the other metrics); an empty average is 0.0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import non_blank
from ..functions.time import AsOf, since_now, since_today
from ..schemas import BENEFITS, EMPLOYEES, LEAVE, REVIEWS
from ..validate import check_summary_days

SECTIONS = ("employees", "benefits", "leave_requests", "performance_reviews")
SCORE_COLUMNS = ("goals_achievement", "technical_skills", "communication")
_SECTION_TABLE = {
    "employees": EMPLOYEES,
    "benefits": BENEFITS,
    "leave_requests": LEAVE,
    "performance_reviews": REVIEWS,
}


def _by_count(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col("count").desc(), F.col(key).asc_nulls_first())


def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _leave_window(tables, days_back: int, as_of: AsOf) -> DataFrame:
    leave = tables[LEAVE]
    return leave.filter(since_now(leave, "submitted_timestamp", days_back, as_of))


def _review_window(tables, days_back: int, as_of: AsOf) -> DataFrame:
    reviews = tables[REVIEWS]
    return reviews.filter(since_today(reviews, "review_date", days_back, as_of))


# --- single metrics (R6a-R6i) ----------------------------------------------

def headcount_total(tables: dict[str, DataFrame]) -> DataFrame:
    """R6a: ``total_employees``."""
    return tables[EMPLOYEES].agg(F.count(F.lit(1)).alias("total_employees"))


def headcount_by_department(tables: dict[str, DataFrame]) -> DataFrame:
    """R6b: ``(department, count)``, largest first."""
    return _by_count(tables[EMPLOYEES].groupBy("department").count(), "department")


def plan_distribution(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """R6c / R6d: ``(<plan column>, count)`` without null or '' plans."""
    benefits = tables[BENEFITS].select(column).filter(non_blank(column))
    return _by_count(benefits.groupBy(column).count(), column)


def health_plan_distribution(tables: dict[str, DataFrame]) -> DataFrame:
    return plan_distribution(tables, "health_plan")


def retirement_plan_distribution(tables: dict[str, DataFrame]) -> DataFrame:
    return plan_distribution(tables, "retirement_plan")


def average_company_match(tables: dict[str, DataFrame]) -> DataFrame:
    """R6e: ``average_company_match_percent`` (0.0 when there is no value)."""
    return tables[BENEFITS].agg(
        _zero_if_null(F.avg("company_match_percent")).alias("average_company_match_percent"))


def leave_window_total(tables: dict[str, DataFrame], days_back: int = 30, as_of: AsOf = None) -> DataFrame:
    """R6f: ``total_requests`` submitted in the look-back window."""
    check_summary_days(days_back)
    return _leave_window(tables, days_back, as_of).agg(F.count(F.lit(1)).alias("total_requests"))


def leave_status_breakdown(tables: dict[str, DataFrame], days_back: int = 30, as_of: AsOf = None) -> DataFrame:
    """R6g: ``(status, count)`` in the window, largest first."""
    check_summary_days(days_back)
    return _by_count(_leave_window(tables, days_back, as_of).groupBy("status").count(), "status")


def review_window_total(tables: dict[str, DataFrame], days_back: int = 30, as_of: AsOf = None) -> DataFrame:
    """R6h: ``total_reviews`` dated in the window."""
    check_summary_days(days_back)
    return _review_window(tables, days_back, as_of).agg(F.count(F.lit(1)).alias("total_reviews"))


def review_score_averages(tables: dict[str, DataFrame], days_back: int = 30, as_of: AsOf = None) -> DataFrame:
    """R6i: mean goals / technical / communication scores in the window (0.0
    when empty), one row."""
    check_summary_days(days_back)
    return _review_window(tables, days_back, as_of).agg(
        *[_zero_if_null(F.avg(c)).alias(c) for c in SCORE_COLUMNS])


# --- the combined summary (R6, R6j) -----------------------------------------

COUNT_METRICS = (
    "total_employees", "department_breakdown", "health_plan_distribution",
    "retirement_plan_distribution", "total_requests", "status_breakdown", "total_reviews",
)
# Metrics that exist even when their table (or window) is empty: 0 / 0.0.
SCALAR_METRICS = {
    "employees": [("total_employees", None)],
    "benefits": [("average_company_match_percent", None)],
    "leave_requests": [("total_requests", None)],
    "performance_reviews": [("total_reviews", None)] + [("average_scores", c) for c in SCORE_COLUMNS],
}


#: The columns that a section reads; without one of them the section is reported as an error.
SECTION_COLUMNS = {
    "employees": ("department",),
    "benefits": ("health_plan", "retirement_plan", "company_match_percent"),
    "leave_requests": ("submitted_timestamp", "status"),
    "performance_reviews": ("review_date", *SCORE_COLUMNS),
}
ENTRY = "section string, metric string, key string, n bigint, total double"


def _entry(metric: str, key: Column | None, n: Column, total: Column | None = None) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        n.cast("bigint").alias("n"),
        (F.lit(None) if total is None else total).cast("double").alias("total"),
    )


def _section_entries(tables, section: str, days_back: int, as_of: AsOf) -> DataFrame:
    """One aggregate over the section's table; each of its rows gives the entries it adds to."""
    n = F.col("n")
    if section == "employees":
        groups = tables[EMPLOYEES].groupBy("department").agg(F.count(F.lit(1)).alias("n"))
        entries = [_entry("total_employees", None, n), _entry("department_breakdown", F.col("department"), n)]
    elif section == "benefits":
        groups = tables[BENEFITS].groupBy("health_plan", "retirement_plan").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("company_match_percent").alias("matches"),
            F.sum(F.col("company_match_percent").cast("double")).alias("match_sum"),
        )
        entries = [
            F.when(non_blank("health_plan"), _entry("health_plan_distribution", F.col("health_plan"), n)),
            F.when(non_blank("retirement_plan"), _entry("retirement_plan_distribution", F.col("retirement_plan"), n)),
            _entry("average_company_match_percent", None, F.col("matches"), F.col("match_sum")),
        ]
    elif section == "leave_requests":
        groups = _leave_window(tables, days_back, as_of).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        entries = [_entry("total_requests", None, n), _entry("status_breakdown", F.col("status"), n)]
    else:
        groups = _review_window(tables, days_back, as_of).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(c).alias(f"n_{c}") for c in SCORE_COLUMNS],
            *[F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in SCORE_COLUMNS],
        )
        entries = [_entry("total_reviews", None, n)]
        entries += [_entry("average_scores", F.lit(c), F.col(f"n_{c}"), F.col(f"sum_{c}")) for c in SCORE_COLUMNS]
    return groups.select(F.lit(section).alias("section"), F.inline(F.array_compact(F.array(*entries))))


def _problem(tables: dict[str, DataFrame], section: str) -> str | None:
    table = _SECTION_TABLE[section]
    if table not in tables:
        return f"table {table} is missing"
    absent = [c for c in SECTION_COLUMNS[section] if c not in tables[table].columns]
    return f"{table} has no column {', '.join(absent)}" if absent else None


def hr_summary(
    tables: dict[str, DataFrame],
    days_back: int = 30,
    as_of: AsOf = None,
    sections: Iterable[str] | None = None,
) -> DataFrame:
    """R6: the summary as ``(section, metric, key, value)``.

    ``sections`` picks sections (default: all). A section that cannot be built never hides or fails the others (R6j): it
    gives one row with metric ``error``, the reason as key and a null value. A section asked for by name whose table is not
    in ``tables`` raises ``ValueError`` instead. Breakdown rows come largest first within their metric.
    """
    check_summary_days(days_back)
    wanted = list(SECTIONS if sections is None else sections)
    unknown = set(wanted) - set(SECTIONS)
    if unknown or not wanted:
        raise ValueError(f"unknown sections {sorted(unknown)}; known: {', '.join(SECTIONS)}")
    if not tables:
        raise ValueError("no tables are given")
    absent = [] if sections is None else [s for s in wanted if _SECTION_TABLE[s] not in tables]
    if absent:
        raise ValueError(f"no table for the sections {absent}")
    problems = {s: _problem(tables, s) for s in SECTIONS if s in wanted}
    built = [s for s, problem in problems.items() if problem is None]

    # A fixed skeleton (at most 7 rows) makes the scalar metrics exist on empty input; errors are rows of it.
    skeleton = [(s, metric, key, 0, None) for s in built for metric, key in SCALAR_METRICS[s]]
    skeleton += [(s, "error", problem, None, None) for s, problem in problems.items() if problem is not None]
    spark = next(iter(tables.values())).sparkSession
    rows = spark.createDataFrame(skeleton, ENTRY)
    for s in built:
        rows = rows.unionByName(_section_entries(tables, s, days_back, as_of))
    # Keys are free text, so there may be many grouped rows; Spark makes one partition of them where they are few.
    added = rows.groupBy("section", "metric", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    value = (
        F.when(F.col("metric") == "error", F.lit(None).cast("double"))
        .when(F.col("metric").isin(*COUNT_METRICS), F.col("n").cast("double"))
        .otherwise(_zero_if_null(F.try_divide(F.col("total"), F.col("n"))))
    )
    out = added.select("section", "metric", "key", value.alias("value"))
    rank = F.array_position(F.array(*[F.lit(sec) for sec in SECTIONS]), F.col("section"))
    return out.orderBy(rank, F.col("metric"), F.col("value").desc(), F.col("key").asc_nulls_first())
