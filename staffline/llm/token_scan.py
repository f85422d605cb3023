"""Token counts of documents in flat token files without an index.

A token file is nothing but token ids of a fixed width, documents ended by a separator id. Files are cut into
blocks of bytes, which many tasks read and search for separators with one vectorised comparison. A prefix scan over the blocks of a
file (the last separator before each block, and how many there were) stitches the documents that run over block boundaries;
it sees two numbers a block, the places found stay where they are.

The files are written by Spark's text sink with the separator's bytes as its line end, so its commit
protocol keeps them whole when executors are lost. The same tasks write the documents' names, in the same order and in files of the same
names, so which document a count belongs to is recorded when it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staffline.llm.common import shared_folder, ship_package, small_side, stored
from staffline.llm.tokens import encoder, tokenizer_path

#: The id of ``<|endoftext|>`` in the default tokenizer. Ordinary text never encodes to it.
SEPARATOR = 49407
WIDTH = 2
#: Bytes searched at a time, and bytes that a task is given.
BLOCK_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: What a task writes: token ids, and the documents' names. Two writers are open at the same time, so rows are not sorted for them.
IDS, NAMES = "ids", "names"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: File systems whose files are opened at an offset. A file of another one is read as one value, of 2 GB at most.
SEEKABLE = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def separator_bytes(separator: int, width: int) -> bytes:
    return separator.to_bytes(width, "little")


# ---------------------------------------------------------------- writing


def write_token_files(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, separator: int = SEPARATOR, width: int = WIDTH, name: Column | str | None = None
) -> None:
    """Write the token ids of ``docs``'s ``text``, each followed by the separator, one flat file for each partition.

    Documents keep the order they have in their partition; nothing is shuffled. A null or blank text is a
    separator alone. Ids must be below 256 ** ``width``; the separator's bytes must not be all zero. ``name`` (an
    integer, or null) is written beside the ids, for ``named_counts``.
    """
    ship_package(spark)
    path_of = tokenizer or tokenizer_path()
    line_end = separator_bytes(separator, width)
    key = F.lit(None).cast("long") if name is None else (F.col(name) if isinstance(name, str) else name)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path_of, ordinary_specials=True)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # the ids of a few documents at a time
                texts = batch.column("text").slice(start, 256)
                ids = [b"".join(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in own.blocks(t.as_py() or b"")) for t in texts]
                yield pa.RecordBatch.from_pydict({"value": pa.array(ids, pa.binary()), "kind": pa.array([IDS] * len(ids))})
                if name is not None:
                    names = [packed_name(n) for n in batch.column("name").slice(start, 256).to_pylist()]
                    yield pa.RecordBatch.from_pydict({"value": pa.array(names, pa.binary()), "kind": pa.array([NAMES] * len(names))})

    rows = docs.select(key.cast("long").alias("name"), F.col("text").cast("binary").alias("text")).mapInArrow(encode, "value binary, kind string")
    with _setting(spark, WRITERS, "2"):
        rows.select(F.col("value").cast("string").alias("value"), "kind").write.partitionBy("kind").option("lineSep", line_end.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def packed_name(name: int | None) -> bytes:
    """Nine bytes, of which the first tells whether there is a name."""
    return bytes(9) if name is None else b"\1" + name.to_bytes(8, "little", signed=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# ---------------------------------------------------------------- byte ranges


def open_file(path: str) -> BinaryIO:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    system, inside = pyarrow.fs.FileSystem.from_uri(f"{SEEKABLE[scheme]}:{rest}")
    return system.open_input_file(inside)


def byte_ranges(spark: SparkSession, path: str, unit: int, kind: str = IDS, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, bool]:
    """(file, length, block, content of the files below ``path``, whether content is left out): a row for each block of ``block_bytes`` bytes. Spark lists
    the files; blocks are dealt out over tasks, also those of one file. ``content`` is left out where tasks can open the file at the
    block's place, else it is the whole file. A file that does not hold whole units of ``unit`` bytes raises an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "kind" in files.columns:
        files = files.where(F.col("kind") == kind)
    seekable = files.where(~F.split("path", ":")[0].isin(*SEEKABLE)).select("path").isEmpty()
    size = files.agg(F.sum("length")).first()[0] or 0
    whole = F.when(F.col("length") % unit != 0, F.raise_error(F.concat(F.lit("ends inside a token: "), "path"))).otherwise(F.col("length"))
    last = F.ceil(whole / F.lit(block_bytes)).cast("long") - 1
    content = F.lit(None).cast("binary") if seekable else F.col("content")
    blocks = files.where("length > 0").select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), content.alias("content"))
    return (blocks.repartition(min(100_000, 1 + size // task_bytes), "file", "block") if seekable else blocks), seekable


def read_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, int, int, memoryview]]:
    """(file, length, block, bytes) of each row of ``byte_ranges``."""
    source, opened = None, None
    for batch in batches:
        for file, length, block, content in zip(*batch.columns, strict=True):
            start, size = block.as_py() * block_bytes, min(block_bytes, length.as_py() - block.as_py() * block_bytes)
            if content.is_valid:
                data = memoryview(content.as_buffer())[start : start + size]
            else:
                if file.as_py() != opened:
                    if source:
                        source.close()
                    source, opened = open_file(file.as_py()), file.as_py()
                source.seek(start)
                data = memoryview(source.read(size))
                if len(data) != size:
                    raise OSError(f"{opened} is shorter than it was when it was listed")
            yield file.as_py(), length.as_py(), block.as_py(), data
    if source:
        source.close()


# ---------------------------------------------------------------- scanning


def scan_token_files(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, doc_no, start, n_tokens, ended for each document in the token files below ``path``.

    doc_no counts from 0 in each file; ``start`` is the document's first token; n_tokens leaves the separator
    out, and two separators in a row enclose a document of 0 tokens. Tokens after the last separator are a
    document with ``ended`` false. A file without bytes has no documents; a file that ends inside a token raises an error.
    Files may have any size where tasks can open them at an offset (``SEEKABLE``), else up to 2 GB each.
    """
    ship_package(spark)
    folder = shared_folder(spark)
    block_bytes -= block_bytes % width
    blocks, _ = byte_ranges(spark, path, width, IDS, block_bytes, task_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, length, block, data in read_blocks(batches, block_bytes):
            found = np.flatnonzero(np.frombuffer(data, f"<u{width}") == separator) + block * (block_bytes // width)
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([file]), "tokens": pa.array([length // width], pa.int64()), "block": pa.array([block], pa.int64()), "at": pa.array([found], pa.list_(pa.int64()))}
            )

    marks = stored(blocks.mapInArrow(search, "file string, tokens long, block long, at array<long>"), f"{folder}/marks")

    # The prefix scan. The last block also closes what stands after the last separator.
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.select("file", "block", "tokens", F.array_max("at").alias("last"), F.size("at").alias("n"))
    carried = sums.select(
        "file",
        "block",
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carried"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"),
        F.when(F.lead("block").over(in_order).isNull(), F.col("tokens")).alias("file_end"),
    )
    carried = stored(carried, f"{folder}/carried")
    scanned = marks.select("file", "block", "at").join(small_side(carried), ["file", "block"])
    previous = F.concat(F.array("carried"), "at")
    open_end = (F.col("file_end") - 1) > F.element_at(previous, -1)
    ends = F.when(open_end, F.concat("at", F.array("file_end"))).otherwise(F.col("at"))
    docs = scanned.select("file", "docs_before", "file_end", previous.alias("previous"), F.posexplode(ends).alias("i", "end"))
    start = F.expr("previous[i]") + 1
    return docs.select(
        "file",
        (F.col("docs_before") + F.col("i")).alias("doc_no"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        (F.col("file_end").isNull() | (F.col("end") < F.col("file_end"))).alias("ended"),
    )


def names_of(spark: SparkSession, path: str, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, doc_no and name of each document, as ``write_token_files`` wrote them below ``path``."""
    ship_package(spark)
    record = np.dtype([("given", "u1"), ("name", "<i8"), ("end", f"V{width}")])
    block_bytes = max(block_bytes // record.itemsize, 1) * record.itemsize
    blocks, _ = byte_ranges(spark, path, record.itemsize, NAMES, block_bytes, task_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _, block, data in read_blocks(batches, block_bytes):
            found = np.frombuffer(data, record)
            for first in range(0, len(found), 10_000):
                some = found[first : first + 10_000]
                number = np.arange(len(some)) + first + block * (block_bytes // record.itemsize)
                yield pa.RecordBatch.from_pydict(
                    {"file": pa.array([file] * len(some)), "doc_no": pa.array(number), "name": pa.array(some["name"].copy(), mask=some["given"] == 0)}
                )

    return blocks.mapInArrow(read, "file string, doc_no long, name long")


def named_counts(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """name, file, doc_no, start and n_tokens of each document that ``write_token_files`` wrote, with names, below ``path``. A
    document without its name, or a name without its document, raises an error."""
    base = F.regexp_extract("file", "[^/]+$", 0)
    counts = scan_token_files(spark, path, separator, width).where("ended").withColumn("file", base)
    names = names_of(spark, path, width).select(base.alias("of"), F.col("doc_no").alias("no"), "name")
    both = counts.join(names, (F.col("file") == F.col("of")) & (F.col("doc_no") == F.col("no")), "full")
    odd = F.col("file").isNull() | F.col("of").isNull()
    lost = F.raise_error(F.concat_ws(" ", F.lit("document and name do not meet:"), F.coalesce("file", "of"), F.coalesce("doc_no", "no").cast("string")))
    return both.select("name", F.when(odd, lost).otherwise(F.col("file")).alias("file"), "doc_no", "start", "n_tokens")
