"""R2: benefits list with the employee's name, department and role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Ids, as_ids, restrict_ids
from ..schemas import BENEFIT_VIEWS, BENEFITS, EMPLOYEES, SANITIZE_MAX_LENGTH, SANITIZE_TOKENS
from ..validate import present

def benefit_view(benefit_type: str | None) -> tuple[str, ...] | None:
    """Columns of the benefit sub-record for a ``benefit_type`` argument: it names a view in any case, after the sanitiser's tokens
    are removed from it one after the other, as ``sanitize_column`` does; any other value gives no sub-record (and never
    changes the row count)."""
    if not present(benefit_type):
        return None
    bare = reduce(lambda text, token: "".join(text.split(token)), SANITIZE_TOKENS, str(benefit_type).lower())
    return BENEFIT_VIEWS.get(bare.strip()[:SANITIZE_MAX_LENGTH])


def employee_benefits(
    tables: dict[str, DataFrame],
    ids: Ids = None,
    benefit_type: str | None = None,
    ordered: bool = True,
    id_range: tuple[int, int] | None = None,
) -> DataFrame:
    """All benefit columns plus ``name``, ``department`` and ``role``; benefit
    rows of unknown employees are dropped (inner join). With a known
    ``benefit_type`` a ``filtered_benefits`` struct is added. Ordered by name
    (nulls first), then employee id.

    The join is on ``employee_id`` with only the four needed employee columns,
    so Catalyst/AQE broadcast that side when its measured size allows and fall
    back to a sort-merge join otherwise. ``ids`` restrict the benefits; the join carries that over to the employees.
    """
    ids = as_ids(ids, id_range)
    benefits = restrict_ids(tables[BENEFITS], ids)
    people = tables[EMPLOYEES].select("employee_id", "name", "department", "role")
    clash = {"name", "department", "role"} & set(benefits.columns)
    if clash:
        raise ValueError(f"benefit table already has columns {sorted(clash)}")
    out = benefits.join(people, "employee_id", "inner")
    view = benefit_view(benefit_type)
    if view:
        out = out.withColumn("filtered_benefits", F.struct(*view))
    if ordered:
        out = out.orderBy(F.col("name").asc_nulls_first(), F.col("employee_id"))
    return out
