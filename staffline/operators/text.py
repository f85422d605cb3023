"""Q2: the string sanitiser applied to text columns of a table.

A pure projection (``replace`` x 12, ``trim`` with a character set,
``substring``): one narrow pass over whole texts, and the scan reads only the
key and text columns.

Parquet splits at row-group boundaries, so a source that arrives as a few
very large row groups (or one big file written as a single group) is read by
a few tasks only, and those tasks do all the text work. ``spread=n`` hash-
partitions the key and text columns into ``n`` partitions first (by the
``keep`` columns, so a retried task sees the same rows; round-robin when there
are none). It costs one shuffle of those columns, so it is off by default:
with ordinary row groups the scan is already split evenly.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions.text import sanitize_column
from ..schemas import SANITIZE_MAX_LENGTH


def sanitize_text(
    df: DataFrame,
    columns: Iterable[str] | dict[str, str],
    keep: Iterable[str] = (),
    max_length: int = SANITIZE_MAX_LENGTH,
    spread: int | None = None,
) -> DataFrame:
    """``keep`` columns followed by the sanitised ``columns``; pass a dict
    ``{source: output_name}`` to rename the cleaned columns."""
    names = dict(columns) if isinstance(columns, dict) else {c: c for c in columns}
    keep = list(keep)
    source = df.select(*dict.fromkeys([*keep, *names]))
    if spread:
        source = source.repartition(int(spread), *keep) if keep else source.repartition(int(spread))
    return source.select(*keep, *[sanitize_column(src, max_length).alias(out) for src, out in names.items()])
