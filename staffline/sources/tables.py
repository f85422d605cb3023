"""Loading the HR tables as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLE_NAMES


def qualified_name(table: str, catalog: str | None = None, schema: str | None = None) -> str:
    """``catalog.schema.table`` with the absent parts left out."""
    return ".".join(p for p in (catalog, schema, table) if p)


def catalog_tables(
    spark: SparkSession,
    catalog: str | None = None,
    schema: str | None = None,
    names: Iterable[str] = TABLE_NAMES,
) -> dict[str, DataFrame]:
    """The tables of a catalog namespace (Delta, parquet, Hive ... whatever the
    session's catalog serves); nothing is read until an action runs."""
    return {n: spark.read.table(qualified_name(n, catalog, schema)) for n in names}


def parquet_tables(
    spark: SparkSession, directory: str, names: Iterable[str] = TABLE_NAMES
) -> dict[str, DataFrame]:
    """One parquet dataset per table under ``directory`` (``<dir>/<name>.parquet``
    or a partitioned folder of that name)."""
    return {n: spark.read.parquet(f"{directory.rstrip('/')}/{n}.parquet") for n in names}
