"""R4 / R5: leave-request and review lists, newest first, top-k.

Both add the owner's name and department (inner-join semantics: rows of
unknown employees are dropped) and a second person's name from the same
employees table (left-join semantics: approver / reviewer, null when unknown).

Plan: the filters reach the scan. Which rows are listed is decided on three columns (key, owner, date): they are
semi-joined with the known owners and cut to the top-k. Only those places, at most ``limit``, go back to the
table for the whole rows, which are therefore never in a shuffle by a key, and look up names: both people of
every row in one broadcast join probed by a single scan of employees. With employees unique on ``employee_id``
(its key) this equals joining first and limiting after. Equal rows of the table stay separate rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Ids, IdSet, all_of, as_ids, restrict_ids, restrict_literal_ids
from ..functions.time import AsOf, since_now
from ..schemas import EMPLOYEES, LEAVE, MAX_RECORDS, REVIEWS
from ..validate import check_limit, check_period, check_status, lookback_days, present

#: Above these limits, which only a raised ``max_records`` allows, the sides of ``limit`` rows are not marked for
#: broadcast; Spark then decides by their size. Places have three short columns, asks hold whole rows, twice.
BROADCAST_PLACES, BROADCAST_ASKS = 100_000, 10_000


def _top_rows(facts: DataFrame, owners: DataFrame, key: str, date: str, limit: int) -> DataFrame:
    """The first ``limit`` whole rows of known owners, newest first, then by key."""
    order = [F.col(date).desc_nulls_last(), F.col(key).asc_nulls_first()]
    places = facts.select(key, "employee_id", date).join(owners, "employee_id", "left_semi")
    chosen = places.orderBy(*order).limit(limit).distinct().select(
        *[F.col(c).alias(f"_{c}") for c in (key, "employee_id", date)])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (key, "employee_id", date)])
    return facts.join(F.broadcast(chosen) if limit <= BROADCAST_PLACES else chosen, same, "left_semi").orderBy(*order).limit(limit)


def _with_names(facts: DataFrame, employees: DataFrame, ids: IdSet, key: str, date: str, other_id: str, other_name: str,
                limit: int) -> DataFrame:
    owners = employees.select("employee_id")
    if isinstance(ids, DataFrame):
        owners = restrict_ids(owners, ids)
    # The top-k numbered, so that equal rows are not taken for one when they are put together again.
    top = _top_rows(facts, owners, key, date, limit).select(
        F.struct(*facts.columns).alias("_row"), F.monotonically_increasing_id().alias("_no"))
    # Each row asks for two people: its owner and its approver or reviewer. Only these <= 2 * limit asks are
    # broadcast; one scan of employees probes them, so employees is never shuffled, whatever its size. An ask with
    # no match (null or unknown id) simply finds nothing; the owner always exists.
    asks = top.select(
        "_row", "_no",
        F.inline(F.array(
            F.struct(F.lit(True).alias("_owner"), F.col("_row.employee_id").alias("_who")),
            F.struct(F.lit(False).alias("_owner"), F.col(f"_row.{other_id}").alias("_who")),
        )),
    )
    people = employees.select(F.col("employee_id").alias("_who"), "name", "department")
    found = (F.broadcast(asks) if limit <= BROADCAST_ASKS else asks).join(people, "_who", "inner")
    named = found.groupBy("_no").agg(
        F.first("_row").alias("_row"),
        F.max(F.when(F.col("_owner"), F.col("name"))).alias("employee_name"),
        F.max(F.when(F.col("_owner"), F.col("department"))).alias("department"),
        F.max(F.when(~F.col("_owner"), F.col("name"))).alias(other_name),
    )
    # The regrouping does not keep order: sort the (bounded) rows again.
    order = [F.col(date).desc_nulls_last(), F.col(key).asc_nulls_first()]
    return named.select("_row.*", "employee_name", "department", other_name).orderBy(*order).limit(limit)


def leave_requests(
    tables: dict[str, DataFrame],
    ids: Ids = None,
    status: str | None = None,
    limit: int = 100,
    days_back: int | None = None,
    as_of: AsOf = None,
    id_range: tuple[int, int] | None = None,
    max_records: int = MAX_RECORDS,
) -> DataFrame:
    """R4: ``leave_requests.*`` + employee_name, department, approver_name;
    newest ``submitted_timestamp`` first (nulls last), then ``request_id``.
    ``days_back`` keeps requests submitted at or after ``as_of - days``. ``max_records`` is the ceiling of ``limit``."""
    ids = as_ids(ids, id_range)
    check_status(status)
    check_limit(limit, max_records)
    facts = restrict_literal_ids(tables[LEAVE], ids)
    conditions = []
    if present(status):
        conditions.append(F.col("status") == F.lit(status))
    days = lookback_days(days_back)
    if days is not None:
        conditions.append(since_now(facts, "submitted_timestamp", days, as_of))
    cond = all_of(conditions)
    if cond is not None:
        facts = facts.filter(cond)
    return _with_names(facts, tables[EMPLOYEES], ids, "request_id", "submitted_timestamp", "approver_id", "approver_name", limit)


def performance_reviews(
    tables: dict[str, DataFrame],
    ids: Ids = None,
    review_period: str | None = None,
    limit: int = 50,
    id_range: tuple[int, int] | None = None,
    max_records: int = MAX_RECORDS,
) -> DataFrame:
    """R5: ``performance_reviews.*`` + employee_name, department, reviewer_name;
    newest ``review_date`` first (nulls last), then ``review_id``. ``max_records`` is the ceiling of ``limit``."""
    ids = as_ids(ids, id_range)
    check_period(review_period)
    check_limit(limit, max_records)
    facts = restrict_literal_ids(tables[REVIEWS], ids)
    if present(review_period):
        facts = facts.filter(F.col("review_period") == F.lit(review_period))
    return _with_names(facts, tables[EMPLOYEES], ids, "review_id", "review_date", "reviewer_id", "reviewer_name", limit)
