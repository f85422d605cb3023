"""Filter helpers: optional conjuncts and id-set restriction."""

from __future__ import annotations

import numbers
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ids = DataFrame | Iterable[int] | int | None
#: What ``as_ids`` makes of them.
IdSet = DataFrame | list[int] | None


def all_of(conditions: Iterable[Column]) -> Column | None:
    """AND of the given predicates, or None when there are none."""
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def non_blank(col: str) -> Column:
    """Truthy key: drops both null and '' (``'' != x`` is null for null)."""
    return F.col(col) != F.lit("")


def as_ids(ids: Ids, id_range: tuple[int, int] | None = None) -> IdSet:
    """The ids of a report argument, read once: every report calls this first and passes the result on.

    None stays None (all employees). A DataFrame becomes its distinct ``employee_id`` values. An integer, or an iterable of
    them (also one that can be read only once), becomes a list without repeats. Anything else, such as text,
    floats or booleans, raises ``ValueError`` before any job, and so does a literal id outside ``id_range``.
    Literal ids are for lists that a caller writes down; a set that comes from data is a DataFrame.
    """
    if ids is None:
        return None
    if isinstance(ids, DataFrame):
        return ids.select("employee_id").distinct()
    if isinstance(ids, numbers.Number):
        ids = [ids]
    if isinstance(ids, (str, bytes)) or not isinstance(ids, Iterable):
        raise ValueError(f"ids must be integers or a DataFrame, got {ids!r}")
    values = list(ids)
    bad = [i for i in values if isinstance(i, bool) or not isinstance(i, numbers.Integral)]
    if bad:
        raise ValueError(f"employee ids must be integers, got {bad[:5]}")
    values = list(dict.fromkeys(int(i) for i in values))
    if id_range is not None:
        lo, hi = id_range
        outside = [i for i in values if not lo <= i <= hi]
        if outside:
            raise ValueError(f"invalid employee id(s) {outside[:5]}; must be between {lo} and {hi}")
    return values


def restrict_ids(df: DataFrame, ids: IdSet, column: str = "employee_id") -> DataFrame:
    """Keep rows whose ``column`` is in ``ids`` (as made by ``as_ids``): literal ids are an IN filter that reaches the scan,
    a DataFrame is a ``left_semi`` join."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col("employee_id").alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(ids))


def restrict_literal_ids(df: DataFrame, ids: IdSet) -> DataFrame:
    """The filter of literal ids alone. For the sides of a join whose other side is restricted by any ids: they are
    aggregated before anything is joined to them, so a hot employee is one row for each task."""
    return df if isinstance(ids, DataFrame) else restrict_ids(df, ids)
