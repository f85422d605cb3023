"""Test fixture: the HR tables as views over the driver's TPC-H-ish tables.

The driver tables hold no HR data, so each HR table is a deterministic
projection of one of them (customer -> employees and employee_benefits,
orders -> leave_requests, events -> performance_reviews). The same mapping is
written in SQL for the DuckDB oracle (``staffline.plans.oracle``); both must
stay in step.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import (
    BENEFITS, DEPARTMENTS, EMPLOYEES, LEAVE, LEAVE_STATUSES, OFFICE_LOCATIONS, REVIEW_PERIODS, REVIEWS,
    TABLE_NAMES,
)

# Fixed clock of the fixture: the last leave request is dated this day.
AS_OF = "2024-01-31 00:00:00"
# Shift that moves the order dates so that the last one falls on AS_OF.
LEAVE_DATE_SHIFT_DAYS = 8218


def _case(key: Column, values: Sequence[str | None], default: str | None = None) -> Column:
    """``CASE key WHEN 0 THEN values[0] WHEN 1 THEN values[1] ... ELSE default``."""
    out = None
    for i, v in enumerate(values):
        out = (F.when(key == i, F.lit(v)) if out is None else out.when(key == i, F.lit(v)))
    return out.otherwise(F.lit(default))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def employees(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("employee_id"),
        F.col("c_name").alias("name"),
        _case(k % 8, DEPARTMENTS[:-1], DEPARTMENTS[-1]).alias("department"),
        F.col("c_mktsegment").alias("role"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_acctbal").alias("salary"),
        (k % 31).cast("int").alias("leave_balance"),
        _case(F.col("c_nationkey") % 5, OFFICE_LOCATIONS[:-1], OFFICE_LOCATIONS[-1]).alias("office_location"),
        F.when(k % 17 == 0, "Inactive").otherwise("Active").alias("employment_status"),
        F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int")).alias("hire_date"),
    )


def employee_benefits(customer: DataFrame) -> DataFrame:
    """One benefit row per employee."""
    k = F.col("c_custkey")
    return customer.select(
        k.alias("employee_id"),
        _case(k % 4, ["PPO", "HMO", "HDHP"], None).alias("health_plan"),
        _case(k % 3, ["401k", "Roth 401k"], "").alias("retirement_plan"),
        F.when(k % 11 != 0, (k % 7).cast("double")).alias("company_match_percent"),
        (10 + k % 16).cast("int").alias("pto_days_annual"),
        (5 + k % 6).cast("int").alias("sick_days_annual"),
        (k % 2 == 0).alias("dental_coverage"),
        (k % 3 == 0).alias("vision_coverage"),
        (k % 4).cast("int").alias("life_insurance"),
        F.when(k % 2 == 0, "Biweekly").otherwise("Monthly").alias("pay_frequency"),
    )


def leave_requests(orders: DataFrame) -> DataFrame:
    k, cust, st = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    pending, approved, denied, cancelled = LEAVE_STATUSES
    return orders.select(
        k.alias("request_id"),
        cust.alias("employee_id"),
        F.when(k % 5 != 0, cust - cust % 10).alias("approver_id"),
        F.col("o_orderpriority").alias("leave_type"),
        F.when(st == "O", pending).when(st == "F", approved)
         .when(k % 2 == 0, denied).otherwise(cancelled).alias("status"),
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(LEAVE_DATE_SHIFT_DAYS)))
        .alias("submitted_timestamp"),
    )


def performance_reviews(events: DataFrame) -> DataFrame:
    k, user, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    q1, q2, q3, q4, annual = REVIEW_PERIODS
    return events.select(
        k.alias("review_id"),
        user.alias("employee_id"),
        F.when(k % 6 != 0, user - user % 10).alias("reviewer_id"),
        F.when(et == "click", q1).when(et == "error", q2).when(et == "purchase", q3).when(et == "signup", q4)
         .otherwise(annual).alias("review_period"),
        F.col("ts").cast("date").alias("review_date"),
        F.when(k % 13 != 0, (k % 101).cast("int")).alias("goals_achievement"),
        (k % 5 + 1).cast("int").alias("technical_skills"),
        (k % 4 + 1).cast("int").alias("communication"),
        (k * 7 % 5 + 1).cast("int").alias("overall_rating"),
    )


#: Each HR table: the driver table it is made of, and how.
_MADE_OF = {
    EMPLOYEES: ("customer", employees),
    BENEFITS: ("customer", employee_benefits),
    LEAVE: ("orders", leave_requests),
    REVIEWS: ("events", performance_reviews),
}


def fixture_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLE_NAMES) -> dict[str, DataFrame]:
    """The HR tables ``names`` for one scale-factor folder of driver tables; only the driver tables they need are opened."""
    names = list(names)
    opened = {source: _read(spark, sf_dir, source) for source in dict.fromkeys(_MADE_OF[n][0] for n in names)}
    return {n: _MADE_OF[n][1](opened[_MADE_OF[n][0]]) for n in names}
