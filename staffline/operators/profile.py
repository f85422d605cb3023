"""R1 / R1x: employee profile.

The source builds the profile by left-joining employees to benefits, leave
requests and reviews, then grouping by the 19 employee + benefit columns. Two
independent 1:N joins under one GROUP BY multiply each other, so the source's
counts are inflated (the "fan-out"):

    total_leave_requests   = L * max(V, 1) * B
    pending_leave_requests = P * max(V, 1) * B

with L leave rows carrying a request id, P pending ones, V reviews and B
benefit rows in the employee's benefit group (1 when there are none). The
averages and the maximum are unaffected by the repetition.

``employee_profile`` (R1) reproduces those numbers exactly but never
materialises the product: each side is pre-aggregated by ``employee_id``
(partial aggregation on the map side, so a hot employee collapses to one row
per task before the shuffle) and the counts are multiplied afterwards. Every
table is scanned once and the joins are 1:1 on ``employee_id``. A DataFrame of
ids restricts the employees, so no raw leave or review row is joined to it;
literal ids filter every scan.

``employee_profile_exact`` (R1x) reports the true L and P and adds the rating
of the newest review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Ids, IdSet, as_ids, restrict_ids, restrict_literal_ids
from ..schemas import BENEFIT_COLUMNS, BENEFITS, EMPLOYEE_COLUMNS, EMPLOYEES, LEAVE, PERFORMANCE_FIELDS, REVIEWS

BASIC_FIELDS = tuple(c for c in EMPLOYEE_COLUMNS if c != "salary")


def _leave_counts(tables: dict[str, DataFrame], ids: IdSet) -> DataFrame:
    leave = restrict_literal_ids(tables[LEAVE].select("employee_id", "request_id", "status"), ids)
    return leave.groupBy("employee_id").agg(
        F.count("request_id").alias("_leave_n"),
        F.count_if(F.col("status") == "Pending").alias("_pending_n"),
    )


def _review_stats(tables: dict[str, DataFrame], ids: IdSet, latest: bool) -> DataFrame:
    cols = ["employee_id", "goals_achievement", "technical_skills", "overall_rating"]
    if latest:
        cols += ["review_date", "review_id"]
    reviews = restrict_literal_ids(tables[REVIEWS].select(*cols), ids)
    aggs = [
        F.count(F.lit(1)).alias("_review_n"),
        F.avg("goals_achievement").alias("avg_goals_score"),
        F.avg("technical_skills").alias("avg_technical_score"),
        F.max("overall_rating").alias("latest_performance_rating"),
    ]
    if latest:
        newest = F.struct(F.col("review_date"), F.col("review_id"))
        aggs.append(F.max_by("overall_rating", newest).alias("newest_review_rating"))
    return reviews.groupBy("employee_id").agg(*aggs)


def _benefit_groups(tables: dict[str, DataFrame], ids: IdSet) -> DataFrame:
    """One row per employee and distinct benefit record, with its multiplicity."""
    benefits = restrict_literal_ids(tables[BENEFITS].select("employee_id", *BENEFIT_COLUMNS), ids)
    return benefits.groupBy("employee_id", *BENEFIT_COLUMNS).agg(F.count(F.lit(1)).alias("_benefit_n"))


def _employees(tables: dict[str, DataFrame], ids: IdSet, include_salary: bool) -> DataFrame:
    cols = EMPLOYEE_COLUMNS if include_salary else BASIC_FIELDS
    # Dropping salary here, before any join, prunes it from the scan.
    return restrict_ids(tables[EMPLOYEES].select(*cols), ids)


def _nest(df: DataFrame, include_salary: bool, include_benefits: bool, extra: tuple[str, ...]) -> DataFrame:
    basic = list(BASIC_FIELDS) + (["salary"] if include_salary else [])
    parts: list[Column] = [F.col("employee_id"), F.struct(*basic).alias("basic_info")]
    if include_benefits:
        parts.append(F.struct(*BENEFIT_COLUMNS).alias("benefits"))
    parts.append(F.struct(*PERFORMANCE_FIELDS, *extra).alias("performance_summary"))
    return df.select(*parts)


def employee_profile(
    tables: dict[str, DataFrame],
    ids: Ids = None,
    include_salary: bool = False,
    include_benefits: bool = True,
    nested: bool = False,
    id_range: tuple[int, int] | None = None,
) -> DataFrame:
    """R1: the profile with the source's (fan-out) counts, for all employees or
    for ``ids`` (an int, a list, or a DataFrame with ``employee_id``).

    One row per employee and distinct benefit record (the source keeps only the
    first of several). Benefit groups always take part in the counts, as in the
    source; ``include_benefits=False`` only leaves their columns out. Columns:
    the employee columns (salary only when asked), the nine benefit columns,
    then the five performance columns. ``id_range`` (e.g. ``EMPLOYEE_ID_RANGE``)
    rejects literal ids outside it, as the source's id check does.
    """
    ids = as_ids(ids, id_range)
    emp = _employees(tables, ids, include_salary)
    benefits = _benefit_groups(tables, ids)
    leave = _leave_counts(tables, ids)
    reviews = _review_stats(tables, ids, latest=False)

    joined = emp.join(benefits, "employee_id", "left").join(leave, "employee_id", "left") \
        .join(reviews, "employee_id", "left")
    factor = F.greatest(F.coalesce(F.col("_review_n"), F.lit(0)), F.lit(1)) \
        * F.coalesce(F.col("_benefit_n"), F.lit(1))
    out = joined.select(
        *emp.columns,
        *(BENEFIT_COLUMNS if include_benefits else ()),
        (F.coalesce(F.col("_leave_n"), F.lit(0)) * factor).alias("total_leave_requests"),
        (F.coalesce(F.col("_pending_n"), F.lit(0)) * factor).alias("pending_leave_requests"),
        "avg_goals_score", "avg_technical_score", "latest_performance_rating",
    )
    return _nest(out, include_salary, include_benefits, ()) if nested else out


def employee_profile_exact(
    tables: dict[str, DataFrame],
    ids: Ids = None,
    include_salary: bool = False,
    include_benefits: bool = True,
    nested: bool = False,
    id_range: tuple[int, int] | None = None,
) -> DataFrame:
    """R1x: the profile with true counts (L and P), plus ``newest_review_rating``,
    the rating of the latest review by (review_date, review_id).

    Without benefits there is exactly one row per employee; with benefits one
    row per distinct benefit record (one in a clean source).
    """
    ids = as_ids(ids, id_range)
    emp = _employees(tables, ids, include_salary)
    joined = emp
    if include_benefits:
        benefits = restrict_literal_ids(tables[BENEFITS].select("employee_id", *BENEFIT_COLUMNS), ids).distinct()
        joined = joined.join(benefits, "employee_id", "left")
    joined = joined.join(_leave_counts(tables, ids), "employee_id", "left") \
        .join(_review_stats(tables, ids, latest=True), "employee_id", "left")
    out = joined.select(
        *emp.columns,
        *(BENEFIT_COLUMNS if include_benefits else ()),
        F.coalesce(F.col("_leave_n"), F.lit(0)).alias("total_leave_requests"),
        F.coalesce(F.col("_pending_n"), F.lit(0)).alias("pending_leave_requests"),
        "avg_goals_score", "avg_technical_score", "latest_performance_rating", "newest_review_rating",
    )
    return _nest(out, include_salary, include_benefits, ("newest_review_rating",)) if nested else out
