"""Passages that repeat across documents, by content-defined chunking with a gear rolling hash.

The gear hash of a place depends on the 16 bytes that end there. A chunk ends where the hash is the smallest within
``RADIUS`` bytes on either side, so a boundary depends on its surroundings alone: text inserted or removed elsewhere
shifts chunks without changing them, and equal passages are cut alike from a few bytes after they begin. Text with a short period has equally
small hashes, one a period; it is cut at every so many of them, so all its chunks hold the same bytes wherever the text stands. Chunks are
deduplicated by digest (with length); runs of neighbouring repeated chunks are the seeds of passages. A passage's edges lie
outside its seed. Each chunk carries hashes of the 32 bytes on either side of it, by which an end of a seed finds documents that go on
alike; only then, or where the seed is nearly long enough already, are the bytes beside it fetched and compared, and what is equal
belongs to the passage.

What is shuffled is a digest and two numbers a chunk, once, to find which digests repeat; of the chunks themselves only those that a
bitmap of these digests lets through, and of the texts those that seeds ask for, by another bitmap. The bitmaps have a fixed size; what they let
through by mistake is found out by joins. Digests are reduced in each task before their shuffle. The reduced side of every join is a table, so Spark's skew handling
can split the other side: a passage that a third of all documents share makes no task large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from staffline.llm.common import asked_rows, bitmap, file_locator, shared_folder, ship_package, small_side, stored

WINDOW = 16
RADIUS = 20
#: Text with a period of up to RADIUS bytes is cut every so many periods that this many bytes are reached.
PERIODS = 32
#: A chunk without any smallest place is cut every so many bytes.
LONGEST = 1024
SLICE = 1 << 20
#: Bytes beside a chunk that its side hashes stand for, a multiple of 8.
SIDE = 32
#: Bytes beside a seed that are compared. A chunk's cuts depend on less than that.
REACH = 128
#: Bits of the bitmap that says which digests repeat: 8 MB, collected and broadcast.
DIGEST_BITS = 26
BLANK = b" \t\n\r\x0b\x0c"
GEAR = np.random.default_rng(23).integers(0, 1 << 32, 256, dtype=np.uint32)
_FACTORS = np.random.default_rng(24).integers(0, 1 << 64, SIDE // 8, dtype=np.uint64) | np.uint64(1)


def gear_hashes(data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last WINDOW bytes (fewer at the start), by doubling. Bytes that are not ``inside`` count as none."""
    h = GEAR[data] if inside is None else np.where(inside, GEAR[data], np.uint32(0))
    reach = 1
    while reach < WINDOW:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, 2 * reach
    return h


def _least_before(h: np.ndarray, radius: int) -> np.ndarray:
    """The smallest of the ``radius`` values before each place (the largest number where there are none)."""
    top = np.uint32(0xFFFFFFFF)
    shifted = np.concatenate([[top], h[:-1]]).astype(np.uint32)
    out, reach = shifted, 1  # out covers ``reach`` values
    while reach < radius:
        step = min(reach, radius - reach)
        moved = np.full(len(out), top, np.uint32)
        moved[step:] = out[:-step] if step < len(out) else out[:0]
        out, reach = np.minimum(out, moved), reach + step
    return out


class _Thinned:
    """Smallest places in order, slice by slice, less those that only repeat a short period. Where one follows another of the same hash,
    within RADIUS, every so many stay, counted from the first; a new period counts anew."""

    def __init__(self):
        self.place, self.gap, self.number = -(1 << 40), 0, 0

    def __call__(self, places: np.ndarray) -> np.ndarray:
        if not len(places):
            return places
        gaps = np.diff(places, prepend=self.place)
        before = np.concatenate([[self.gap], gaps[:-1]])
        fresh = (gaps > RADIUS) | ((before <= RADIUS) & (gaps != before))
        at = np.arange(len(places))
        number = at - np.maximum.accumulate(np.where(fresh, at, -1 - self.number))
        self.place, self.gap, self.number = int(places[-1]), int(gaps[-1]), int(number[-1])
        return places[fresh | (number % -(-PERIODS // np.maximum(gaps, 1)) == 0)]


def cuts(data: bytes) -> np.ndarray:
    """Where chunks end, in order; the last is the length of ``data``. No cut is inside a UTF-8 character."""
    whole, size = np.frombuffer(data, np.uint8), len(data)
    found, thinned = [], _Thinned()
    for a in range(0, size, SLICE):
        b, start = min(size, a + SLICE), max(0, a - RADIUS - WINDOW + 1)
        h = gear_hashes(whole[start : min(size, b + RADIUS)])
        smallest = (h <= _least_before(h, RADIUS)) & (h <= _least_before(h[::-1], RADIUS)[::-1])
        places = np.flatnonzero(smallest) + start
        found.append(thinned(places[(places >= a) & (places < b)]) + 1)
    return _bounded(np.append(np.concatenate(found or [np.empty(0, np.int64)]), size), np.zeros(1, np.int64), np.append(whole, np.uint8(0))) if size else np.zeros(0, np.int64)


def _bounded(ends: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``ends`` in order, with cuts in chunks over LONGEST, and moved to the end of a UTF-8 character. ``starts``: where texts begin in ``whole``, which has a
    zero after each."""
    ends = np.unique(ends)
    begins = np.maximum(np.append(0, ends[:-1]), starts[np.searchsorted(starts, ends - 1, "right") - 1]) if len(ends) else ends
    long = np.flatnonzero(ends - begins > LONGEST)
    if len(long):
        ends = np.sort(np.concatenate([ends, *(np.arange(begins[i] + LONGEST, ends[i], LONGEST) for i in long)]))
    for _ in range(3):
        ends = ends + ((whole[ends] & 0xC0) == 0x80)
    return np.unique(ends)


def side_hashes(padded: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the SIDE bytes before and of those after each place."""
    windows = np.lib.stride_tricks.sliding_window_view(padded, SIDE)

    def hashes(at: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(windows[at]).view("<u8")
        mixed = ((words ^ (words >> np.uint64(29))) * _FACTORS).sum(axis=1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)

    return hashes(places - SIDE), hashes(places)


def cut_together(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``cuts`` of each text, and the side hashes before and after all chunks, with zeros beyond a text's ends. Texts of some megabytes
    are cut at once, with zeros between them that count as no bytes; a longer one is cut slice by slice."""
    gap = bytes(SIDE)
    whole = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = SIDE + np.cumsum(sizes + SIDE) - sizes - SIDE
    if len(texts) == 1:
        ends = cuts(texts[0]) + SIDE
    else:
        inside = np.zeros(len(whole) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + sizes, -1)
        inside = np.cumsum(inside[:-1]) > 0
        h = gear_hashes(whole, inside)
        h[~inside] = 0xFFFFFFFF
        smallest = inside & (h <= _least_before(h, RADIUS)) & (h <= _least_before(h[::-1], RADIUS)[::-1])
        ends = _bounded(np.concatenate([_Thinned()(np.flatnonzero(smallest)) + 1, (starts + sizes)[sizes > 0]]), starts[sizes > 0], whole)
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, starts + sizes, "right")
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    begins[first[sizes > 0]] = starts[sizes > 0]
    return [ends[a:b] - s for a, b, s in zip(first, last, starts, strict=True)], side_hashes(whole, begins)[0], side_hashes(whole, ends)[1]


def together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in order, in groups of about SLICE bytes; one that is longer is alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > SLICE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def chunks(docs: DataFrame) -> DataFrame:
    """uid, doc_id, locator, n_bytes and arrays with an entry for each chunk: ends, digests, before and after (side hashes), of each row of
    ``docs`` (doc_id, locator, text)."""
    key, place = docs.schema["doc_id"], docs.schema["locator"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [t.as_py() or b"" for t in part.column("text")]
                ends, digests, before, after = [], [], [], []
                for group in together(texts):
                    own, *sides = cut_together(group)
                    ends += own
                    before.append(sides[0])
                    after.append(sides[1])
                    for text, places in zip(group, own, strict=True):
                        digests += [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in pairwise([0, *places.tolist()])]
                offsets = pa.array(np.cumsum([0, *map(len, ends)]), pa.int32())
                each = {"ends": np.concatenate(ends), "digests": np.array(digests, np.uint64).view(np.int64), "before": np.concatenate(before), "after": np.concatenate(after)}
                lists = {k: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32() if k in ("before", "after") else pa.int64())) for k, v in each.items()}
                kept = {"doc_id": part.column("doc_id"), "locator": part.column("locator"), "n_bytes": pa.array(map(len, texts), pa.int64())}
                yield pa.RecordBatch.from_pydict(kept | lists)

    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([key, place]).add("n_bytes", T.LongType()).add("ends", longs).add("digests", longs).add("before", ints).add("after", ints)
    rows = docs.select("doc_id", "locator", F.col("text").cast("binary").alias("text")).mapInArrow(cut, schema)
    return rows.withColumn("uid", F.monotonically_increasing_id())


def _repeated_chunks(rows: DataFrame, again: DataFrame) -> DataFrame:
    """uid, doc_id, digest, start, length, before and after of the chunks whose digest is in a bitmap of ``again`` (digest)."""
    words = bitmap(again.select("digest"), DIGEST_BITS).toArrow()
    bits = np.zeros(1 << (DIGEST_BITS - 6), np.uint64)
    bits[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    packed = rows.sparkSession.sparkContext.broadcast(bits)
    key, low = rows.schema["doc_id"], np.uint64((1 << DIGEST_BITS) - 1)

    def told(digests: np.ndarray) -> np.ndarray:
        found = np.ones(len(digests), bool)
        for place in (digests & low, digests >> np.uint64(DIGEST_BITS) & low):
            found &= (packed.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                digests, sizes = part.column("digests").flatten(), pa.compute.list_value_length(part.column("digests")).to_numpy()
                kept = np.flatnonzero(told(digests.to_numpy().view(np.uint64)))
                ends = part.column("ends").flatten().to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes)[kept])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(owner),
                        "uid": part.column("uid").take(owner),
                        "digest": digests.take(pa.array(kept)),
                        "start": pa.array(starts[kept]),
                        "length": pa.array((ends - starts)[kept].astype(np.int32)),
                        "before": part.column("before").flatten().take(pa.array(kept)),
                        "after": part.column("after").flatten().take(pa.array(kept)),
                    }
                )

    schema = T.StructType([key]).add("uid", T.LongType()).add("digest", T.LongType()).add("start", T.LongType()).add("length", T.IntegerType())
    schema = schema.add("before", T.IntegerType()).add("after", T.IntegerType())
    return rows.select("doc_id", "uid", "ends", "digests", "before", "after").mapInArrow(pick, schema)


def repeated_passages(spark: SparkSession, docs: DataFrame, least_bytes: int = 128, locator: Column | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, repeated (whether it has a passage that occurs elsewhere), first_doc_ids
    (the documents that keep passages dropped here), spans, n_bytes, n_chunks, repeated_bytes, dropped_bytes.

    ``spans`` are the document's passages (start, end in bytes of the UTF-8 text): runs of chunks that all occur in another
    document too, which make up at least ``least_bytes`` with the equal bytes beside them (a passage without a whole chunk
    inside is not seen). A span is the run and the whole words of those bytes. ``first_doc_id`` is the document in which the passage's
    first chunk comes first (smallest doc_id, null last); ``drop`` is false in that document, which keeps the passage, and true
    elsewhere. A passage ends where that changes. Repetition inside one document alone is left as it is. A null text is empty;
    empty and short texts have no spans. Repeated rows are documents that repeat each other. Whole texts are cut, however long.
    ``locator`` names each row's place; without it, ``docs`` is first written to the shared folder.
    """
    ship_package(spark)
    folder = shared_folder(spark)
    if locator is None:
        docs = stored(docs.select("doc_id", "text"), f"{folder}/docs")
        locator = file_locator(docs)
    docs = docs.select("doc_id", "text", locator.alias("locator"))
    rows = stored(chunks(docs), f"{folder}/chunks")
    key = docs.schema["doc_id"].dataType.simpleString()

    # Which digests are in more than one document, and all chunks with these.
    spread = rows.select("uid", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("uid").alias("a"), F.max("uid").alias("b"))
    again = stored(spread.where("a != b").select("digest"), f"{folder}/again")
    shared = stored(_repeated_chunks(rows, again).join(small_side(again), "digest"), f"{folder}/shared")

    place = F.struct("uid", "start")
    rank = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "uid", "start")
    groups = shared.groupBy("digest", "length").agg(F.min(rank).alias("first"), F.min(place).alias("a"), F.max(place).alias("b"))
    groups = stored(groups.where("a.uid != b.uid"), f"{folder}/groups")
    hits = shared.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "digest", "before", "after")).alias("hits"))  # a document's own chunks, no more
    seeds = stored(_seeds(hits), f"{folder}/seeds")

    # Documents that go on alike beside the ends of a seed: up to two that have the chunk and its side hash.
    ends = seeds.drop("chunks")
    for which in ("before", "after"):
        alike = shared.groupBy("digest", "length", F.col(which).alias("side")).agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a.uid != b.uid")
        alike = stored(alike, f"{folder}/alike-{which}")
        ends = ends.withColumns({k: F.col(f"{which}.{k}") for k in ("digest", "length", "side")}).join(small_side(alike), ["digest", "length", "side"], "left")
        ends = ends.withColumn(f"like_{which}", F.filter(F.array("a", "b"), lambda p: p["uid"] != F.col("uid"))).drop("digest", "length", "side", "a", "b")
    near = (F.col("end") - F.col("start") >= least_bytes - 2 * (SIDE - 1)) | (F.size("like_before") > 0) | (F.size("like_after") > 0)
    ends = stored(ends.where(near), f"{folder}/ends")

    def sides(which: str) -> DataFrame:
        """The place of this end of the near seeds, and the same place in documents to compare with; where none goes on alike, in another that has the chunk."""
        one = ends.select("uid", F.col("end" if which == "after" else "start").alias("at"), F.col(f"{which}.digest").alias("digest"), F.col(f"{which}.length").alias("length"), F.col(f"like_{which}").alias("like"))
        other = one.where("size(like) = 0").join(small_side(groups.select("digest", "length", "a", "b")), ["digest", "length"])
        other = other.withColumn("like", F.slice(F.filter(F.array("a", "b"), lambda p: p["uid"] != F.col("uid")), 1, 1)).select(one.columns)
        each = one.where("size(like) > 0").unionByName(other).select("uid", "at", "length", F.explode(F.array_distinct("like")).alias("p"))
        shift = F.col("length") if which == "after" else F.lit(0)
        return each.select("uid", "at", F.lit(which == "after").alias("after"), F.col("p.uid").alias("other"), (F.col("p.start") + shift).alias("place"))

    edges = stored(sides("before").unionByName(sides("after")), f"{folder}/edges")
    asked = edges.select("uid", "at", "after").union(edges.select("other", "place", "after")).distinct()
    asked = asked.join(rows.select("uid", "locator", "n_bytes"), "uid").where("if(after, at < n_bytes, at > 0)")
    asked = stored(asked.groupBy("uid", "locator").agg(F.collect_list(F.struct("at", "after")).alias("asked")), f"{folder}/asked")
    texts = asked_rows(docs.select("locator", F.col("text").cast("binary").alias("text")), asked)
    read = stored(_sides(texts.select("uid", "asked", "text")), f"{folder}/sides")
    theirs = read.select(F.col("uid").alias("other"), F.col("at").alias("place"), "after", F.col("side").alias("their_side"))
    both = edges.join(read, ["uid", "at", "after"]).join(theirs, ["other", "place", "after"]).select("uid", "at", "after", "side", "their_side")
    grown = _by_row(both, lambda row: [row["at"], row["after"], *common(row["side"], row["their_side"], row["after"])], "uid long, at long, after boolean, same int, words int")
    growth = grown.groupBy("uid").agg(F.collect_list(F.struct("at", "after", "same", "words")).alias("growth"))

    # Seeds that make a passage; only of their chunks it is asked who had them first.
    candidates = ends.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("runs")).join(growth, "uid", "left")
    made = _by_row(candidates, lambda row: [passages(row["runs"], row["growth"] or [], least_bytes)], "uid long, passages array<struct<run: long, start: long, end: long>>")
    made = stored(made.select("uid", F.explode("passages").alias("p")).select("uid", F.col("p.run").alias("run"), F.col("p.start").alias("from"), F.col("p.end").alias("to")), f"{folder}/passages")
    chunk = seeds.select("uid", F.col("start").alias("run"), "chunks").join(small_side(made), ["uid", "run"]).select("uid", "run", "from", "to", F.explode("chunks").alias("c"))
    drop = F.col("uid") != F.col("first.uid")
    owned = chunk.select("uid", "run", "from", "to", "c.start", "c.length", "c.digest").join(small_side(groups.select("digest", "length", "first")), ["digest", "length"])
    owned = owned.groupBy("uid").agg(F.collect_list(F.struct("run", "from", "to", "start", "length", F.col("first.doc_id").alias("first_doc_id"), drop.alias("drop"))).alias("chunks"))
    spans = _spans(owned, key)

    whole = rows.select("uid", "doc_id", "n_bytes", F.size("ends").alias("n_chunks")).join(spans, "uid", "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    dropped = F.filter("spans", lambda s: s["drop"])
    return whole.select("doc_id", "n_bytes", "n_chunks", F.coalesce("spans", none).alias("spans")).select(
        "doc_id",
        (F.size("spans") > 0).alias("repeated"),
        F.array_distinct(F.transform(dropped, lambda s: s["first_doc_id"])).alias("first_doc_ids"),
        "spans",
        "n_bytes",
        "n_chunks",
        _bytes_in(F.col("spans")).alias("repeated_bytes"),
        _bytes_in(dropped).alias("dropped_bytes"),
    )


def _spans(owned: DataFrame, key: str) -> DataFrame:
    """(uid, spans): the passages of each document from their chunks, divided where ``first_doc_id`` or ``drop`` changes. A batch of documents at once."""
    span = f"struct<start: long, end: long, first_doc_id: {key}, drop: boolean>"
    kinds = to_arrow_schema(T._parse_datatype_string(f"uid long, spans array<{span}>"))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                chunk = part.column("chunks").flatten()
                row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column("chunks")).to_numpy())
                field = {k: chunk.field(k).to_numpy(zero_copy_only=False) for k in ("run", "from", "to", "start", "length", "drop")}
                field["who"] = chunk.field("first_doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
                order = np.lexsort((field["start"], row))
                row, field = row[order], {k: v[order] for k, v in field.items()}
                begins = np.append(True, (row[1:] != row[:-1]) | (field["run"][1:] != field["run"][:-1]))
                heads = np.flatnonzero(begins | np.append(True, (field["who"][1:] != field["who"][:-1]) | (field["drop"][1:] != field["drop"][:-1])))
                tails = np.append(heads[1:], len(row)) - 1
                start = np.where(begins[heads], field["from"][heads], field["start"][heads])
                end = np.where(np.append(begins[heads[1:]], True), field["to"][heads], field["start"][tails] + field["length"][tails])
                who = chunk.field("first_doc_id").take(pa.array(order[heads]))
                made = pa.StructArray.from_arrays([pa.array(start), pa.array(end), who, pa.array(field["drop"][heads])], fields=list(kinds.field("spans").type.value_type))
                offsets = pa.array(np.searchsorted(row[heads], np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.ListArray.from_arrays(offsets, made, type=kinds.field("spans").type)], schema=kinds)

    return owned.mapInArrow(divide, f"uid long, spans array<{span}>")


def _by_row(df: DataFrame, made: Callable[[dict], list], schema: str) -> DataFrame:
    """uid of each row, and what ``made`` makes of the row for the other columns of ``schema``."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000).to_pylist()
                columns = zip(*([row["uid"], *made(row)] for row in rows), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)

    return df.mapInArrow(make, schema)


def _sides(texts: DataFrame) -> DataFrame:
    """(uid, at, after, side): up to ``REACH`` bytes after or before each place asked for in ``texts`` (uid, asked, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                places, found = part.column("asked").flatten(), []
                at, after = places.field("at").to_pylist(), places.field("after").to_pylist()
                sizes = pa.compute.list_value_length(part.column("asked")).to_numpy()
                i = 0
                for text, n in zip(part.column("text"), sizes.tolist(), strict=True):
                    data = text.as_buffer()
                    for p, forth in zip(at[i : i + n], after[i : i + n], strict=True):
                        found.append(bytes(data[p : p + REACH] if forth else data[max(0, p - REACH) : p]))
                    i += n
                uid = np.repeat(part.column("uid").to_numpy(), sizes)
                yield pa.RecordBatch.from_pydict({"uid": pa.array(uid), "at": places.field("at"), "after": places.field("after"), "side": pa.array(found, pa.binary())})

    return texts.mapInArrow(read, "uid long, at long, after boolean, side binary")


def _bytes_in(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _seeds(hits: DataFrame) -> DataFrame:
    """One row for each run of neighbouring chunks of a document (uid, hits): uid, start, end, the chunk at either end (before, after) with its side
    hash, and all its chunks. A batch of documents is cut into runs at once."""
    end = "struct<digest: long, length: int, side: int>"
    schema = f"uid long, start long, end long, before {end}, after {end}, chunks array<struct<start: long, length: int, digest: long>>"
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                hit = part.column("hits").flatten()
                row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column("hits")).to_numpy())
                field = {f.name: hit.field(f.name).to_numpy() for f in hit.type}
                order = np.lexsort((field["start"], row))
                row, field = row[order], {k: v[order] for k, v in field.items()}
                ends = field["start"] + field["length"]
                fresh = np.append(True, (row[1:] != row[:-1]) | (field["start"][1:] != ends[:-1])) if len(row) else np.zeros(0, bool)
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(row)) - 1 if len(heads) else heads
                offsets = pa.array(np.append(heads, len(row)).astype(np.int32))
                inner = kinds.field("chunks").type.value_type
                chunks = pa.StructArray.from_arrays([pa.array(field[f.name], f.type) for f in inner], fields=list(inner))
                sides = [
                    pa.StructArray.from_arrays([pa.array(field["digest"][at]), pa.array(field["length"][at]), pa.array(field[name][at])], fields=list(kinds.field(name).type))
                    for name, at in (("before", heads), ("after", tails))
                ]
                uid = part.column("uid").take(pa.array(row[heads]))
                yield pa.RecordBatch.from_arrays(
                    [uid, pa.array(field["start"][heads]), pa.array(ends[tails]), *sides, pa.ListArray.from_arrays(offsets, chunks, type=kinds.field("chunks").type)], schema=kinds
                )

    return hits.mapInArrow(find, schema)


def common(own: bytes, other: bytes, after: bool) -> tuple[int, int]:
    """How many bytes are equal from the seed on, and how many of them are whole words."""
    if not after:
        own, other = own[::-1], other[::-1]
    n = min(len(own), len(other))
    differ = int.from_bytes(own[:n]) ^ int.from_bytes(other[:n])
    same = n - (differ.bit_length() + 7) // 8
    if same < REACH and all(same == len(x) or x[same] in BLANK for x in (own, other)):
        return same, same
    return same, next((i for i in range(same - 1, 0, -1) if own[i] in BLANK), 0)


def passages(runs: list[dict], growth: list[dict], least_bytes: int) -> list[dict]:
    """The ``runs`` (start, end) that make up at least ``least_bytes`` with the equal bytes beside them, grown by whole words. Runs that meet so are one
    passage."""
    growth = sorted(growth, key=lambda g: (g["same"], g["words"]))  # of two documents compared, the one that goes on longer
    same = {(g["at"], g["after"]): g["same"] for g in growth}
    words = {(g["at"], g["after"]): g["words"] for g in growth}
    met: list[list] = []  # start, end, runs
    for run in sorted(runs, key=lambda r: r["start"]):
        start, end = run["start"] - same.get((run["start"], False), 0), run["end"] + same.get((run["end"], True), 0)
        if met and start <= met[-1][1]:
            met[-1][1] = max(end, met[-1][1])
            met[-1][2].append(run)
        else:
            met.append([start, end, [run]])
    kept = [run for start, end, own in met if end - start >= least_bytes for run in own]
    found, at = [], 0
    for i, run in enumerate(kept):
        stop = kept[i + 1]["start"] if i + 1 < len(kept) else run["end"] + REACH
        start = max(at, run["start"] - words.get((run["start"], False), 0))
        at = min(stop, run["end"] + words.get((run["end"], True), 0))
        found.append({"run": run["start"], "start": start, "end": at})
    return found


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the passages to drop."""
    at, parts = 0, []
    for span in sorted((s for s in spans if s["drop"]), key=lambda s: s["start"]):
        parts.append(text[at : span["start"]])
        at = span["end"]
    return b"".join([*parts, text[at:]])
