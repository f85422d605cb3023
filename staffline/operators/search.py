"""R3: employee search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import all_of
from ..functions.text import sanitize_column
from ..schemas import EMPLOYEES, MAX_RECORDS, SEARCH_COLUMNS
from ..validate import check_department, check_limit, present


def search_employees(
    tables: dict[str, DataFrame],
    department: str | None = None,
    role: str | None = None,
    office_location: str | None = None,
    limit: int = 50,
    max_records: int = MAX_RECORDS,
) -> DataFrame:
    """Department equals, role contains (case-sensitive), office equals; each
    filter only when given. Six columns, ordered by name then employee id,
    first ``limit`` rows (at most ``max_records``, a ceiling the caller may set).

    The department must be of its domain; role and office are matched sanitised. The filters are plain
    comparisons, so they reach the parquet scan, and sort + limit becomes a
    top-k (``TakeOrderedAndProject``): each task keeps ``limit`` rows, one
    final merge of ``limit x tasks`` rows, no full sort.
    """
    check_limit(limit, max_records)
    check_department(department)
    conditions = []
    if present(department):
        conditions.append(F.col("department") == F.lit(department))
    if present(role):
        conditions.append(F.col("role").contains(sanitize_column(F.lit(role))))
    if present(office_location):
        conditions.append(F.col("office_location") == sanitize_column(F.lit(office_location)))
    df = tables[EMPLOYEES]
    cond = all_of(conditions)
    if cond is not None:
        df = df.filter(cond)
    return df.select(*SEARCH_COLUMNS) \
        .orderBy(F.col("name").asc_nulls_first(), F.col("employee_id")).limit(limit)
