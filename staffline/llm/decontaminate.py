"""Benchmark decontamination: containment search by size-partitioned MinHash, verified exactly (DataFrame operations only).

An item is found in a document if at least ``threshold`` of its distinct word shingles occur there. Documents are
far larger than items, so similarity of whole sets says nothing and hashing into bands would miss items; the
signatures are used for containment instead. Items are partitioned by their number of shingles, at powers of two. In
a partition whose sizes go up to u, the signature is the bottom-k MinHash: the k smallest shingle hashes with
k = u - ceil(threshold * u) + 1. An item may lack at most k - 1 shingles and still be contained, so a document that
contains it holds at least one hash of its signature: the search loses nothing. Candidates are then checked by
their shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm import common as limits
from staffline.llm.common import asked_rows, file_locator, in_bitmap, shared_folder, small_side, stored

SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of the items' shingles up to which they are broadcast.
ITEM_BYTES = 32 << 20
#: Anything but letters and digits separates words.
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _shingles(words: Column, of: str, size: int) -> Column:
    """``of`` (a function of several strings) of every ``size`` words in a row; an empty array if there are fewer.

    The words are bound by the outer lambda, so a text is split once and not once for each shingle.
    """

    def of_one(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - size)
        each = F.transform(places, lambda i: F.xxhash64(*(w[i + k] for k in range(size))) if of == "hash" else F.concat_ws(" ", *(w[i + k] for k in range(size))))
        return F.when(F.size(w) >= size, each)

    return F.coalesce(F.transform(F.array(words), of_one)[0], F.array().cast("array<bigint>" if of == "hash" else "array<string>"))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    return _shingles(words_of(text), "hash", size)


def shingle_texts(text: Column, size: int = SHINGLE) -> Column:
    return F.array_distinct(_shingles(words_of(text), "text", size))


def signatures(items: DataFrame, threshold: float) -> DataFrame:
    """(hash, item) for each value of each item's signature. ``items``: item, hashes (distinct)."""
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes"))))
    k = largest - F.ceil(largest * threshold - 1e-9) + 1
    smallest = F.slice(F.array_sort("hashes"), F.lit(1), F.least(k, F.size("hashes")).cast("int"))
    return items.where(F.size("hashes") > 0).select("item", F.explode(smallest).alias("hash"))


def contained_items(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, locator: Column | None = None, threshold: float = THRESHOLD, shingle: int = SHINGLE
) -> DataFrame:
    """doc_id, locator, item_id, n_shingles, n_common, containment for each document and item contained in it.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. Words are runs of letters and digits in lower case.
    Null and empty texts, and texts with fewer words than a shingle, contain nothing and are contained in
    nothing. Repeated rows on either side are reported each. Without ``locator``, ``docs`` is first written to the
    shared folder. The whole of every text is searched. Signatures and candidates are broadcast up to a number of
    rows; more are joined by a shuffle of the shingles and texts that a bitmap lets through, where Spark's skew handling splits hashes that
    many documents share.
    """
    folder = shared_folder(spark)
    if locator is None:
        docs = stored(docs.select("doc_id", "text"), f"{folder}/staged")
        locator = file_locator(docs)
    placed = docs.select("doc_id", locator.alias("locator"), "text")
    items = stored(benchmark.select("item_id", shingle_texts(F.col("text"), shingle).alias("wanted"), F.array_distinct(shingle_hashes(F.col("text"), shingle)).alias("hashes")), f"{folder}/items")
    items = items.select("item_id", "wanted", "hashes", file_locator(items).alias("item"))
    index = stored(signatures(items.select("item", "hashes"), threshold), f"{folder}/signatures")

    # Above FEW rows the signatures' hashes alone, as a bitmap, decide which shingles are shuffled.
    hashes = placed.select("locator", F.explode(shingle_hashes(F.col("text"), shingle)).alias("hash"))
    if index.count() > limits.FEW:
        hashes = in_bitmap(hashes, F.col("hash"), index.select("hash"))
    candidates = stored(hashes.join(small_side(index), "hash").select("locator", "item").distinct(), f"{folder}/candidates")

    # Items are broadcast by the bytes of their shingles, as one item may have many.
    held = items.agg(F.sum(F.octet_length(F.array_join("wanted", "")) + 24 * F.size("wanted"))).first()[0] or 0
    wanted = items.select("item", "item_id", "wanted")
    paired = asked_rows(placed, candidates).join(F.broadcast(wanted) if held <= ITEM_BYTES else wanted.hint("merge"), "item")
    common = F.size(F.array_intersect("wanted", shingle_texts(F.col("text"), shingle)))
    counted = paired.select("doc_id", "locator", "item_id", F.size("wanted").alias("n_shingles"), common.alias("n_common"))
    return counted.withColumn("containment", F.col("n_common") / F.col("n_shingles")).where(F.col("containment") >= threshold)
