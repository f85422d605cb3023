import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from staffline.schemas import BENEFITS, EMPLOYEES, EXPECTED_SCHEMAS, LEAVE, REVIEWS  # noqa: E402
from staffline.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"
SF_SMALL = f"{TESTDATA}/sf0.001"
SF_ORACLE = f"{TESTDATA}/sf0.01"
DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
                 "pages benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    import tempfile
    warehouse = tempfile.mkdtemp(prefix="staffline-warehouse-", dir="/tmp")
    return local_session("*", shuffle_partitions=8, app="staffline-tests",
                         conf={"spark.sql.warehouse.dir": warehouse})


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


LEAVE_SCHEMA = "request_id bigint, employee_id bigint, approver_id bigint, leave_type string, " \
               "status string, submitted_timestamp timestamp_ntz"


def make_tables(spark, employees=(), benefits=(), leave=(), reviews=()):
    """In-memory HR tables. Employees may be given as (id, name[, department])
    tuples; other columns are filled in."""
    emp_rows = []
    for e in employees:
        eid, name = e[0], e[1]
        dept = e[2] if len(e) > 2 else "Engineering"
        office = e[3] if len(e) > 3 else "Austin"
        emp_rows.append((eid, name, dept, "Engineer", f"{name}@x", 1000.0, 10, office, "Active",
                         dt.date(2020, 1, 1)))
    return {
        EMPLOYEES: spark.createDataFrame(emp_rows, EXPECTED_SCHEMAS[EMPLOYEES]),
        BENEFITS: spark.createDataFrame(list(benefits), EXPECTED_SCHEMAS[BENEFITS]),
        LEAVE: spark.createDataFrame(list(leave), LEAVE_SCHEMA),
        REVIEWS: spark.createDataFrame(list(reviews), EXPECTED_SCHEMAS[REVIEWS]),
    }


def benefit(eid, health="PPO", retirement="401k", match=3.0):
    return (eid, health, retirement, match, 15, 5, True, False, 1, "Monthly")


def leave_row(rid, eid, status="Approved", ts=dt.datetime(2024, 1, 10), approver=None):
    return (rid, eid, approver, "1-URGENT", status, ts)


def review_row(rid, eid, goals=50, tech=3, comm=2, rating=4, date=dt.date(2024, 1, 10),
               period="Q1 2024", reviewer=None):
    return (rid, eid, reviewer, period, date, goals, tech, comm, rating)
