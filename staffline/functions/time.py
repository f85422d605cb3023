"""Look-back predicates relative to a report clock.

``as_of`` is the report's "now": a datetime, a date or ISO text. ``None`` means the session clock, as in the source;
tests and the registered queries pin it so that results are reproducible. Leave requests look back from the
timestamp now, reviews from today's date at midnight, whatever the type of the column.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = dt.datetime | dt.date | str | None


def parse_as_of(as_of: AsOf, zone: str) -> dt.datetime | None:
    """The clock as wall time of the session zone. Text that is not an ISO date or timestamp raises ``ValueError`` here, on the
    driver; a value with an offset is converted to the session zone first."""
    if as_of is None:
        return None
    if isinstance(as_of, str):
        try:
            as_of = dt.datetime.fromisoformat(as_of.strip())
        except ValueError:
            raise ValueError(f"as_of is not an ISO date or timestamp: {as_of!r}") from None
    if not isinstance(as_of, dt.date):
        raise ValueError(f"as_of must be a datetime, a date or ISO text, got {as_of!r}")
    if not isinstance(as_of, dt.datetime):
        return dt.datetime.combine(as_of, dt.time())
    if as_of.tzinfo is not None:
        return as_of.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    return as_of


def _zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def _comparable(df: DataFrame, column: str) -> tuple[Column, T.DataType]:
    """The column as a timestamp; a DATE counts as its midnight."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(column), kind
    return F.col(column).cast(T.TimestampNTZType()), T.TimestampNTZType()


def since_now(df: DataFrame, column: str, days: int, as_of: AsOf = None) -> Column:
    """``column >= now - days``, to the moment (leave requests). Null values never pass."""
    now = parse_as_of(as_of, _zone(df))
    value, kind = _comparable(df, column)
    clock = F.current_timestamp() if now is None else F.lit(now.isoformat(sep=" "))
    return value >= clock.cast(kind) - F.make_dt_interval(days=F.lit(int(days)))


def since_today(df: DataFrame, column: str, days: int, as_of: AsOf = None) -> Column:
    """``column >= today - days``, from midnight on (reviews). Null values never pass."""
    now = parse_as_of(as_of, _zone(df))
    today = F.current_date() if now is None else F.lit(now.date())
    first = F.date_sub(today, int(days))
    if isinstance(df.schema[column].dataType, T.DateType):
        return F.col(column) >= first
    value, kind = _comparable(df, column)
    return value >= first.cast(kind)
