"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Fingerprints that differ in at most two bits are linked. A 64-bit fingerprint is cut into segments of 22, 21
and 21 bits, each read as a word of the perfect binary Golay code [23, 12, 7], in which every word
decodes to exactly one codeword within three bits. A segment's near keys are the indices of the codewords that
it and the words one bit away decode to (1 or 6 of them). Segments at most one bit apart share one: the index of the
one is a near key of the other.

Pigeonhole: two errors over three segments always leave, in the cyclic order of segments, an error-free
segment followed by one with at most one error. So a fingerprint is stored under three keys (a whole
segment, the codeword index of the next) and looked up under about sixteen (a whole segment, the near keys of the
next); candidates are joined on the key and verified by counting differing bits.

Fingerprints are reduced to distinct ones first. A key under which many of them are stored is not joined;
all fingerprints on it go the exact way of ``_by_midpoint`` instead, where no group exceeds 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import file_locator, shared_folder, ship_package, small_side, stored, word_blocks
from staffline.llm.components import roots

SEED = 42
MAX_BITS = 2
#: (shift, width) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0xAE3
#: A key with more stored fingerprints than this takes the exact other way.
BUSY = 64


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64; 0 without words, one shingle if there are too few."""
    ones, count, held = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.lower()):
        held = held + words
        n = len(held) - shingle + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(held[i : i + n] for i in range(shingle)), strict=True))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
            ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            count += n
            held = held[n:]
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int((2 * ones > count) @ (1 << np.arange(64, dtype=np.uint64)))


def fingerprints(spark: SparkSession, docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint of ``text`` as a signed long. A null text is empty."""
    ship_package(spark)
    kept = docs.select(*keep).schema.fields

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column("__text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {"fp": pa.array(values.view(np.int64))})

    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return docs.select(*keep, F.col("text").cast("binary").alias("__text")).mapInArrow(compute, schema)


# ---------------------------------------------------------------- the code


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and lower 11 bits, and the error (at most 3 bits) that each syndrome stands for."""
    errors = np.zeros(1 << 11, np.int64)
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], np.int64)
    errors[syndrome(patterns)] = patterns
    return syndrome(np.arange(1 << 12, dtype=np.int64) << 11), np.arange(1 << 11, dtype=np.int64), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the one codeword within three bits of each 23-bit word."""
    upper, lower, errors = _tables()
    return (words ^ errors[upper[words >> 11] ^ lower[words & 0x7FF]]) >> 11


def near_indices(segments: np.ndarray, width: int) -> np.ndarray:
    """(segments, 1 + width): codeword indices of each segment and of all words one bit away, repeats included."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    return codeword_index(segments[:, None] ^ flips[None, :])


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position in ``values``, whether stored) for fingerprints given as unsigned 64-bit numbers."""
    parts = [((values >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    found = []
    for family in range(3):
        after = (family + 1) % 3
        base = np.int64(family) << 40 | parts[family] << 12
        found.append((base | codeword_index(parts[after]), np.arange(len(values)), True))
        near = np.sort(near_indices(parts[after], SEGMENTS[after][1]), axis=1)
        fresh = np.concatenate([np.ones((len(values), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, column = np.nonzero(fresh)
        found.append((base[row] | near[row, column], row, False))
    return (
        np.concatenate([k for k, _, _ in found]),
        np.concatenate([r for _, r, _ in found]),
        np.concatenate([np.full(len(k), s) for k, _, s in found]),
    )


# ---------------------------------------------------------------- links and classes


def links(spark: SparkSession, distinct: DataFrame, folder: str, busy: int = BUSY) -> DataFrame:
    """Links (a, b) between different fingerprints of ``distinct`` (fp), enough to join all that are linked."""
    ship_package(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            key, row, is_stored = keys_of(signed.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(signed[row]), "is_stored": pa.array(is_stored)})

    keys = stored(distinct.mapInArrow(keyed, "key long, fp long, is_stored boolean"), f"{folder}/keys")
    crowd = keys.where("is_stored").groupBy("key").count().where(F.col("count") > busy).select("key")
    crowd = stored(crowd, f"{folder}/busy")
    calm = keys.join(crowd, "key", "left_anti")
    probe = calm.where("NOT is_stored").select("key", F.col("fp").alias("a"))
    store = calm.where("is_stored").select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    found = probe.join(store, "key").where((F.col("a") < F.col("b")) & close).select("a", "b")
    return found.unionByName(_by_midpoint(keys.join(crowd, "key", "left_semi").select("fp").distinct()))


def _by_midpoint(members: DataFrame) -> DataFrame:
    """Links by shared neighbours: fingerprints are at most two bits apart exactly if a word is within one
    bit of both. All of the at most 65 members around a word are linked, so a star to the smallest is enough."""
    around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = members.select("fp", F.explode(F.concat(F.array("fp"), around)).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return near.join(least, "word").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, locator: Column | None = None, shingle: int = 3, busy: int = BUSY) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, locator, fingerprint (16 hex digits), component_id, kept.

    component_id is the smallest doc_id reachable over links of at most two differing bits; exactly one row of
    each component is kept, by doc_id (null last), then locator. Without ``locator``, ``docs`` is first written to the
    shared folder. Null and empty texts, and texts of white space, have the fingerprint zero and are linked like others.
    Texts with fewer words than a shingle hash their whole word sequence. Rows without doc_id take part; a component of
    such rows alone has a null component_id. An empty table gives an empty result.
    """
    folder = shared_folder(spark)
    if locator is None:
        docs = stored(docs.select("doc_id", "text"), f"{folder}/staged")
        locator = file_locator(docs)
    placed = docs.select("doc_id", locator.alias("locator"), "text")
    prints = stored(fingerprints(spark, placed, ["doc_id", "locator"], shingle), f"{folder}/fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "locator")
    distinct = stored(prints.groupBy("fp").agg(F.min(rank).alias("first")), f"{folder}/distinct")
    root = roots(spark, links(spark, distinct.select("fp"), folder, busy), folder)
    linked = distinct.join(small_side(root.withColumnRenamed("node", "fp")), "fp", "left")
    member = stored(linked.select("fp", "first", F.coalesce("root", "fp").alias("root")), f"{folder}/members")
    first = stored(member.groupBy("root").agg(F.min("first").alias("first")), f"{folder}/roots")
    classes = stored(member.drop("first").join(small_side(first), "root").select("fp", "first"), f"{folder}/classes")
    return prints.join(small_side(classes), "fp").select(
        "doc_id",
        "locator",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("locator") == F.col("first.locator")).alias("kept"),
    )
