"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Tokenising and cutting run over the documents; what remains is a bin-packing instance with integer sizes of at most
the sequence length, so its histogram has that many entries however large the corpus. The plan is made from
the histogram alone: the reduction fixes sets of sizes that provably dominate all alternatives, best-fit
decreasing packs the remainder, both for all copies of a size at once. The plan says which ranks within a
size go where; ranks come from counts by bucket, so a size that a third of all pieces share is split as well.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import shared_folder, ship_package, stored
from staffline.llm.tokens import encoder, tokenizer_path

#: ((size, how many of it), ...) of one sequence, and how many sequences look like this.
Pattern = tuple[tuple[int, int], ...]


# ---------------------------------------------------------------- the plan


class Sizes:
    """How many items of each size are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.order.pop(bisect_left(self.order, size))

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest items besides one of size ``without`` (fewer, if there aren't so many)."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(n - len(out), self.left[s] - (s == without))
            if len(out) == n:
                break
        return out

    def largest_within(self, room: int, without: tuple[int, ...]) -> int | None:
        """The largest item of at most ``room`` besides one of each size in ``without``."""
        for i in range(bisect_right(self.order, room) - 1, -1, -1):
            s = self.order[i]
            if self.left[s] > without.count(s):
                return s
        return None


def dominating(sizes: Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes to put with an item of size ``j`` such that no other set with it can be better, or None.

    A set dominates another if the other's items can be dealt to its items so that none overflows (they can
    then change places). {j, k} with the largest k that fits dominates if it fills the sequence, if no two further
    items fit beside j, or if at most two fit and no two of them together exceed k. {j, k, b} dominates
    if at most two fit and every pair's smaller item is at most b.
    """
    room = capacity - j
    k = sizes.largest_within(room, (j,))
    if k is None:
        return ()
    few = sizes.smallest(3, j)
    if k == room or len(few) < 2 or few[0] + few[1] > room:
        return (k,)
    if len(few) == 3 and sum(few) <= room:
        return None
    pairs = []
    for x in reversed(sizes.order[: bisect_right(sizes.order, room)]):
        if sizes.left[x] > (x == j):
            y = sizes.largest_within(min(x, room - x), (j, x))
            if y is not None:
                pairs.append((x, y))
    if max(x + y for x, y in pairs) <= k:
        return (k,)
    b = sizes.largest_within(room - k, (j, k))
    return (k, b) if b is not None and max(y for _, y in pairs) <= b else None


def reduce_by_dominance(sizes: Sizes, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets, all copies at once, until none is found; ``sizes`` keeps the rest."""
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(sizes.left, reverse=True):
            while j in sizes.left and (partners := dominating(sizes, j, capacity)) is not None:
                chosen = defaultdict(int)
                for s in (j, *partners):
                    chosen[s] += 1
                times = min(sizes.left[s] // n for s, n in chosen.items())
                if any(n > 1 for n in chosen.values()) or len(partners) == 2:
                    times = 1 if len(partners) == 2 else times
                for s, n in chosen.items():
                    sizes.take(s, n * times)
                fixed.append((tuple(sorted(chosen.items(), reverse=True)), times))
                changed = True
    return fixed


def best_fit(sizes: Sizes, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over the histogram: each size goes, bin by bin, to the fullest open bins that take it."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((pattern, times))

    for s in sorted(sizes.left, reverse=True):
        n = sizes.left[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, (), n
            each = room // s
            full = min(times, n // each)
            put(room - each * s, (*pattern, (s, each)), full)
            n -= full * each
            used = full
            if n and full < times:  # fewer than ``each`` are left for the next bin
                put(room - n * s, (*pattern, (s, n)), 1)
                n, used = 0, full + 1
            if pattern:
                put(room, pattern, times - used)
    return [p for found in open_.values() for p in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    sizes = Sizes(counts)
    return reduce_by_dominance(sizes, capacity) + best_fit(sizes, capacity)


@dataclass
class Runs:
    """For one size: from rank ``first`` on, sequences from ``base`` on take ``each`` items from ``offset`` on."""

    first: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray


def runs_by_size(patterns: list[tuple[Pattern, int]]) -> dict[int, Runs]:
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            found[size].append((used[size], base, each, offset))
            used[size] += each * times
            offset += each * size
        base += times
    return {s: Runs(*np.array(rows, np.int64).T) for s, rows in found.items()}


# ---------------------------------------------------------------- Spark jobs


def pieces(spark: SparkSession, docs: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row of ``docs`` (doc_id, text)."""
    ship_package(spark)
    key = docs.schema["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        width = 4 * capacity
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held, piece = b"", 0
                for block in (*own.blocks(text.as_py() or b""), np.array([end_id], "<u4").tobytes()):
                    held += block
                    whole = len(held) - len(held) % width
                    for at in range(0, whole, width):
                        ids.append(doc_id)
                        rows.append((piece, piece * capacity, capacity, zlib.crc32(held[at : at + width])))
                        piece += 1
                    held = held[whole:]
                if held:
                    ids.append(doc_id)
                    rows.append((piece, piece * capacity, len(held) // 4, zlib.crc32(held)))
            piece_, start, length, crc = (pa.array(x) for x in (np.array(rows, np.int64).reshape(-1, 4).T))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), piece_.cast(pa.int32()), start, length, crc],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType([key]).add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, schema)


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a place for each piece of each document.

    A document is its token ids and ``end_id``; a null, empty or blank text is ``end_id`` alone. Documents longer
    than ``capacity`` are cut into full pieces and a last one. Repeated rows and rows without doc_id are
    documents like others. Sequences are gapless from offset 0. An empty table gives an empty result.
    """
    folder = shared_folder(spark)
    cut = stored(pieces(spark, docs, capacity, end_id, tokenizer or tokenizer_path()), f"{folder}/pieces")
    histogram = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(runs_by_size(plan(histogram, capacity)))

    # The rank of a piece within its size: places within a bucket, after the sizes of the buckets before.
    buckets = 16 + sum(histogram.values()) // 100_000
    row = (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    dealt = cut.select("*", row[0].alias("__file"), row[1].alias("__row")).withColumn("__bucket", F.pmod(F.xxhash64("__file", "__row"), F.lit(buckets)))
    counts = dealt.groupBy("length", "__bucket").count()
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__bucket").orderBy("__file", "__row")
    ranked = dealt.withColumn("__place", F.row_number().over(within) - 1).join(firsts, ["length", "__bucket"])
    names = cut.columns
    ranked = ranked.select(*names, (F.col("__first") + F.col("__place")).alias("__rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "__rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                own, at = runs.value[int(size)], np.flatnonzero(length == size)
                run = np.searchsorted(own.first, rank[at], "right") - 1
                later = rank[at] - own.first[run]
                sequence[at] = own.base[run] + later // own.each[run]
                offset[at] = own.offset[run] + later % own.each[run] * size
            columns = {k: batch.column(k) for k in names}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    schema = T.StructType(list(cut.schema.fields)).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return ranked.mapInArrow(assign, schema)
