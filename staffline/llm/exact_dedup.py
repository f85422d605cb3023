"""Exact deduplication with disk-backed streaming state (DataFrame operations only).

Documents arrive as a stream. The state, kept in RocksDB and never expired, has one entry for each
digest: the stable identifier and content locator of the row that stays, and how many rows had it.
Equal digests are hits; their full texts are compared byte by byte, and texts that differ in spite of
equal digests are separated by their bytes.

The arrivals reach the state through a partial aggregate, so a text that a third of all rows share is
one row for each task before the shuffle. The same holds for the comparison of full bytes, which reads the texts of hits alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm.common import asked_rows, file_locator, shared_folder, small_side, stored

#: Keyed state on disk. Without preallocation, as a partition of the state may be far smaller than the
#: 4 MB that RocksDB would set aside for each one's manifest.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text. Single spaces are left as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    spark: SparkSession,
    docs: DataFrame,
    locator: Column | None = None,
    digest: Callable[[Column], Column] = sha256_hex,
    files_per_batch: int = 1000,
) -> DataFrame:
    """One row for each row of ``docs`` (columns ``doc_id``, ``text``; others are ignored).

    Returns doc_id, locator, keep_id, keep_locator, group_size, kept and text_sha256 (lower-case hex of
    the normalised text). ``locator`` names each row's place; without it, ``docs`` is first written to the
    shared folder. ``digest`` keys the state; results do not depend on it, as full bytes decide.

    Defined cases: a null text is the empty text, and empty texts are equal to each other. Of equal texts
    the smallest doc_id stays; a null doc_id comes last; rows that also share the doc_id are told apart by
    locator, so exactly one row of each group stays. An empty table gives an empty result. Very long texts
    are digested and compared whole.
    """
    folder = shared_folder(spark)
    if locator is None:
        docs = stored(docs.select("doc_id", "text"), f"{folder}/staged")
        locator = file_locator(docs)
    texts = docs.select("doc_id", locator.alias("locator"), normalised(F.col("text")).alias("norm"))
    texts = texts.withColumn("digest", digest(F.col("norm")))
    rank = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "locator")

    arrivals = stored(texts.select("doc_id", "locator", "digest", sha256_hex(F.col("norm")).alias("text_sha256")), f"{folder}/arrivals")
    with _state_settings(spark):
        _absorb(spark, arrivals, folder, rank, files_per_batch)
        state = spark.read.format("statestore").load(f"{folder}/state")
        entries = state.select("key.digest", F.col("value.min").alias("keep"), F.col("value.count").alias("group_size"))
        register = stored(entries, f"{folder}/register")

    # Hits: rows that share a digest. Only their texts are read again; grouping by the text itself compares full bytes.
    hits = stored(register.where("group_size > 1").select("digest"), f"{folder}/hits")
    suspects = stored(arrivals.join(small_side(hits), "digest").select("locator", "digest"), f"{folder}/suspects")
    placed = docs.select("doc_id", locator.alias("locator"), "text")
    texts = asked_rows(placed, suspects).select("doc_id", "locator", "digest", normalised(F.col("text")).alias("norm"))
    by_bytes = texts.groupBy("digest", "norm").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    contents = by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    collided = stored(contents.where("texts > 1").select("digest"), f"{folder}/collided")

    decided = arrivals.join(register, "digest")
    if not collided.isEmpty():
        collided_texts = texts.join(collided, "digest", "left_semi").withColumn("text_sha256", sha256_hex(F.col("norm")))
        exact = collided_texts.join(by_bytes.join(collided, "digest", "left_semi"), ["digest", "norm"]).drop("norm")
        decided = decided.join(collided, "digest", "left_anti").unionByName(exact)
    return decided.select(
        "doc_id",
        "locator",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("keep.locator").alias("keep_locator"),
        "group_size",
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        "text_sha256",
    )


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _absorb(spark: SparkSession, arrivals: DataFrame, folder: str, rank: Column, files_per_batch: int) -> None:
    """Run the arrivals through the keyed state until all are in it; a restart resumes at the last batch."""
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/arrivals")
    grouped = stream.groupBy("digest").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    query = (
        grouped.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start()
    )
    query.awaitTermination()
