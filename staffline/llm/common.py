"""Shared helpers: scratch tables in the cluster's shared folder, word rules."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and Spark runs in one process (tests) is a
    folder of this machine used instead; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/staffline-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package: Spark hands them a small zip of it, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends at a table that a lost executor cannot take away."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join is broadcast: some 15 MB, for rows that hold little more than a locator.
FEW = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a stored table, to be broadcast if it has at most FEW rows and else never. The size of its files says
    little: locators compress to a small part of what they take in memory."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


#: Bits of a bitmap at least and at most; at most 1,048,576 rows of two numbers are broadcast.
LEAST_BITS, MOST_BITS = 16, 26


def bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """(word, set): 64-bit words of a bitmap of 2 ** ``bits`` bits, in which two places are set for each hash (the one column, a long)."""
    low = F.lit((1 << bits) - 1)
    value = F.col(hashes.columns[0])
    place = F.explode(F.array(value.bitwiseAND(low), F.shiftrightunsigned(value, bits).bitwiseAND(low)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    return hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("set"))


def in_bitmap(rows: DataFrame, hashed: Column, hashes: DataFrame, bits: int | None = None) -> DataFrame:
    """The ``rows`` whose ``hashed`` (a long) may be in ``hashes`` (one long column, a stored table): all that are, and others by chance. Nothing of
    ``rows`` is shuffled. The bitmap is broadcast; it grows with the hashes up to a fixed size, beyond which more pass by chance."""
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * hashes.count()).bit_length()))
    words = bitmap(hashes, bits)
    low = F.lit((1 << bits) - 1)
    rows = rows.withColumns({"_p": hashed.bitwiseAND(low), "_q": F.shiftrightunsigned(hashed, bits).bitwiseAND(low)})
    for place in ("_p", "_q"):
        one = words.select(F.col("word").alias("_word"), F.col("set").alias("_set"))
        bit = F.call_function("shiftrightunsigned", F.col("_set"), F.col(place).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        rows = rows.join(F.broadcast(one), (F.shiftright(place, 6) == F.col("_word")) & (bit == 1), "left_semi")
    return rows.drop("_p", "_q")


def asked_rows(rows: DataFrame, asked: DataFrame, bits: int | None = None) -> DataFrame:
    """``rows`` (locator and others) joined with ``asked`` (locator and others, a stored table), by a broadcast of few rows or else by a shuffle
    of what may be asked for and little more."""
    if asked.count() <= FEW // 6:  # a row of these names a file and may hold a list
        return rows.join(F.broadcast(asked), "locator")
    hashed = F.xxhash64("locator.file", "locator.row")
    return in_bitmap(rows, hashed, asked.select(hashed.alias("hash")), bits).join(asked.hint("merge"), "locator")


def file_locator(df: DataFrame) -> Column:
    """Where a row of a file-based DataFrame lies: its file and its place in it. Unique, and the same on every read. A column of the table's own
    that is called ``_metadata`` does no harm."""
    place = df.metadataColumn("_metadata")
    return F.struct(place["file_path"].alias("file"), place["row_index"].alias("row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, as lists that each come from about ``size`` bytes.

    ``bytes.split`` cuts at space and U+0009 to U+000D, the rule of the contracts. A block ends at
    white space, so no word is cut; a single word may exceed the size.
    """
    start, end = 0, len(data)
    while start < end:
        stop = min(end, start + size)
        while stop < end and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        yield data[start:stop].split()
        start = stop
