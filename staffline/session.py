"""Session helper for tests and the bench (a cluster passes its own session)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "staffline",
    codegen_cache_entries: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A local session: UTC clock, AQE on, no UI.

    ``codegen_cache_entries`` raises Spark's compiled-code cache (default
    100 classes): an application that runs many different reports in turn
    otherwise recompiles its generated code on every round."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    if codegen_cache_entries:
        builder = builder.config("spark.sql.codegen.cache.maxEntries", str(codegen_cache_entries))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
