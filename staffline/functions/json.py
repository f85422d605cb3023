"""Rows as JSON text, built on the executors (the caller decides where the
lines go: a file sink, a message bus, or a bounded ``take``)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of the nested profile that leave null fields out.
SPARSE_PARTS = ("benefits", "performance_summary")


def _member(name: str, keep_nulls: bool) -> Column:
    """``"name":value`` without the braces; '' where a null is left out."""
    text = F.to_json(F.struct(F.col(name)), {"ignoreNullFields": str(not keep_nulls).lower()})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def json_lines(df: DataFrame, column: str = "json", sparse: Iterable[str] = SPARSE_PARTS) -> DataFrame:
    """One JSON object per row; nested structs become nested objects, dates and timestamps ISO text.

    Null fields are kept as null. Only inside the columns named in ``sparse`` (by default those of the nested profile) are they
    left out, as in the source; such a column that is null itself is left out as well.
    """
    sparse = set(sparse)
    members = [F.nullif(_member(c, c not in sparse), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias(column))
