"""Q1 domain rules and Q3 contract check."""

import pytest

from staffline import default_rules, domain_rule_report, domain_rule_rows, table_contract, tables_exist
from staffline.schemas import EMPLOYEES, LEAVE

from .conftest import leave_row, make_tables


@pytest.fixture
def tables(spark):
    return make_tables(
        spark,
        employees=[(201, "A", "Engineering", "Austin"), (300, "B", "Space", "Mars"),
                   (5, "C", "", None), (250, "D", None, "Remote")],
        leave=[leave_row(1, 201, "Pending"), leave_row(2, 999, "Lost"), leave_row(3, 202, None),
               leave_row(4, None, "")],
    )


def test_report_counts(tables):
    got = {(r["table_name"], r["rule"]): (r["n_rows"], r["n_violations"])
           for r in domain_rule_report(tables).collect()}
    assert got[(EMPLOYEES, "employee_id_range")] == (4, 1)
    assert got[(EMPLOYEES, "department_domain")] == (4, 1)  # '' and null pass
    assert got[(EMPLOYEES, "office_location_domain")] == (4, 1)
    assert got[(LEAVE, "employee_id_range")] == (4, 2)  # 999 and null id fail
    assert got[(LEAVE, "status_domain")] == (4, 1)


def test_rows(tables):
    rows = {(r["table_name"], r["rule"], r["row_key"]): r["value"] for r in domain_rule_rows(tables).collect()}
    assert rows[(EMPLOYEES, "department_domain", 300)] == "Space"
    assert rows[(LEAVE, "employee_id_range", 4)] is None
    assert (LEAVE, "status_domain", 3) not in rows


def test_custom_domains(tables):
    rules = default_rules(id_range=(0, 1000), departments=["Engineering", "Space"])
    got = {(r["table_name"], r["rule"]): r["n_violations"] for r in domain_rule_report(tables, rules).collect()}
    assert got[(EMPLOYEES, "department_domain")] == 0
    assert got[(EMPLOYEES, "employee_id_range")] == 0


def test_contract(spark, tables):
    rows = {(r["table_name"], r["column_name"]): r["status"] for r in table_contract(spark, tables).collect()}
    assert rows[(EMPLOYEES, "employee_id")] == "ok"
    assert rows[(LEAVE, "leave_type")] == "extra_column"
    broken = dict(tables)
    broken[EMPLOYEES] = tables[EMPLOYEES].drop("email").withColumn("salary", tables[EMPLOYEES]["salary"].cast("string"))
    del broken[LEAVE]
    rows = {(r["table_name"], r["column_name"]): r["status"] for r in table_contract(spark, broken).collect()}
    assert rows[(EMPLOYEES, "email")] == "missing_column"
    assert rows[(EMPLOYEES, "salary")] == "type_mismatch"
    assert rows[(LEAVE, None)] == "missing_table"


def test_tables_exist(spark):
    spark.range(1).createOrReplaceTempView("staffline_probe")
    got = {r["table_name"]: r["table_exists"] for r in tables_exist(spark, ["staffline_probe", "nope"]).collect()}
    assert got == {"staffline_probe": True, "nope": False}
