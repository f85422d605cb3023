"""A Merkle manifest of a dataset, with incremental witnesses.

Each row is a leaf. Leaves of a source are appended in order to a tree of fixed arity, the sources' roots to one more. An
append is aligned: the leaves of a source are cut into blocks of ``arity ** BLOCK_HEIGHT``, each a whole subtree, and a task
streams a block's leaves into its ``OpenSubtrees``. A node's partial witness, the siblings to its left, is attached when it is
appended; every later sibling that is completed extends it; a full run closes into its parent, which is appended one level up.
The blocks' roots are then appended in the same way, round by round, until one node is left, and what a block's root
learns there extends the witnesses of all its leaves.

Texts are hashed where they are read. What is shuffled is one narrow row a leaf, dealt out by ranges of (source, doc_id), so a
source that holds a third of all rows is spread over many tasks, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from staffline.llm.common import shared_folder, ship_package, small_side, stored

ARITY = 3
#: A block holds ARITY to this power of leaves (2187): some hundred kilobytes with their witnesses.
BLOCK_HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before: array<binary>, after: array<binary>>>"


# ---------------------------------------------------------------- hashes


def digest_of(*parts: str) -> bytes:
    return hashlib.sha256("".join(parts).encode()).digest()


def field_text(c: Column) -> Column:
    """A value with its length in front; ``-`` for null, so no two rows give the same text."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def folded_root(leaf: Column, witness: Column) -> Column:
    """The root that ``leaf`` (hex) and its ``witness`` lead to: of the dataset if the leaf is in it."""
    return F.aggregate(witness, leaf, lambda node, step: F.sha2(F.concat(_hex(step["before"]), node, _hex(step["after"])), 256))


def witness_hash(witness: Column) -> Column:
    """One hash of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)


# ---------------------------------------------------------------- appending


class Node:
    """A node and what is known of its witness: the siblings before and after it, and the parent once its run is closed."""

    __slots__ = ("digest", "before", "after", "parent")

    def __init__(self, digest: bytes):
        self.digest, self.before, self.after, self.parent = digest, [], [], None

    def witness(self) -> list[dict]:
        """From here to the root of the subtree this node is in by now."""
        steps, node = [], self
        while node.parent is not None:
            steps.append({"before": node.before, "after": node.after})
            node = node.parent
        return steps


class OpenSubtrees:
    """The open runs of one block, one a level, while its nodes are appended."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.levels = arity, [[]]

    def append(self, digest: bytes) -> Node:
        node = Node(digest)
        self._add(0, node)
        return node

    def _add(self, level: int, node: Node) -> None:
        if level == len(self.levels):
            self.levels.append([])
        run = self.levels[level]
        node.before = [other.digest for other in run]
        for other in run:
            other.after.append(node.digest)
        run.append(node)
        if len(run) == self.arity:
            self._close_run(level)

    def _close_run(self, level: int) -> None:
        run, self.levels[level] = self.levels[level], []
        parent = Node(digest_of(*(node.digest.hex() for node in run)))
        for node in run:
            node.parent = parent
        self._add(level + 1, parent)

    def close(self, height: int | None) -> bytes:
        """The root, with the last runs closed as they are: at ``height`` levels above the leaves, or where one node is left."""
        level = 0
        while True:
            if height is None and sum(map(len, self.levels[level:])) == 1 and self.levels[level]:
                return self.levels[level][0].digest
            if level == height:
                return self.levels[level][0].digest
            if self.levels[level]:
                self._close_run(level)
            level += 1


# ---------------------------------------------------------------- Spark jobs


def _ranked(nodes: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``nodes`` with rank (from 0, by ``order``) and n (how many) within their ``tree``. Dealt out by ranges, so equal trees may
    lie in many partitions; each partition's rows are counted, and ranks are sums of counts."""
    placed = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("part", F.shiftright("at", 33)), f"{folder}/placed")
    spans = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("count").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stored(spans.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("count").over(tree).alias("n")), f"{folder}/spans")
    return placed.join(small_side(spans), ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _append_blocks(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """``nodes`` (tree, rank, n, digest and others) with their block, their ``steps`` (witness within the block) and, in each block's
    first row, the block's ``root``. A task streams through its blocks in order and holds one at a time."""
    size = arity**height
    block = F.floor(F.col("rank") / F.lit(size)).cast("long")
    dealt = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "rank")
    schema = T.StructType([*dealt.schema.fields, T.StructField("root", T.BinaryType()), T.StructField("steps", T._parse_datatype_string(STEPS))])
    kinds = to_arrow_schema(schema)

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, own, rows, key = OpenSubtrees(arity), [], [], None

        def finished() -> Iterator[pa.RecordBatch]:
            root = trees.close(height if rows[0].column("n")[0].as_py() > size else None)
            steps = pa.array([node.witness() for node in own], kinds.field("steps").type)
            table = pa.Table.from_batches(rows).append_column("root", pa.array([root] + [None] * (len(own) - 1), pa.binary())).append_column("steps", steps)
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
            digests = batch.column("digest").to_pylist()
            at = 0
            while at < len(keys):
                if keys[at] != key:
                    if own:
                        yield from finished()
                    trees, own, rows, key = OpenSubtrees(arity), [], [], keys[at]
                stop = at + 1
                while stop < len(keys) and keys[stop] == key:
                    stop += 1
                own += [trees.append(d) for d in digests[at:stop]]
                rows.append(batch.slice(at, stop - at))
                at = stop
        if own:
            yield from finished()

    return dealt.mapInArrow(append, schema)


def _forest(nodes: DataFrame, folder: str, arity: int, height: int) -> DataFrame:
    """``nodes`` (tree, rank, n, digest and others) with the ``root`` of their tree and their ``witness`` up to there. One round of blocks
    for each ``height`` levels; the blocks' roots are the next round's nodes."""
    rounds = []
    while True:
        rounds.append(stored(_append_blocks(nodes, arity, height), f"{folder}/blocks-{len(rounds)}"))
        left = F.ceil(F.col("n") / F.lit(arity**height)).cast("long")
        nodes = rounds[-1].where("root IS NOT NULL").select("tree", F.col("block").alias("rank"), left.alias("n"), F.col("root").alias("digest"))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            break
    upper = stored(nodes.select("tree", F.col("rank").alias("block"), F.col("digest").alias("top"), F.array().cast(STEPS).alias("above")), f"{folder}/upper")
    for i in reversed(range(len(rounds))):
        found = rounds[i].drop("root").join(small_side(upper), ["tree", "block"])
        found = found.withColumn("witness", F.concat("steps", "above")).withColumnRenamed("top", "root").drop("steps", "above", "block")
        if i:
            next_up = found.select("tree", F.col("rank").alias("block"), F.col("root").alias("top"), F.col("witness").alias("above"))
            upper = stored(next_up, f"{folder}/upper-{i}")
    return found


def manifest(spark: SparkSession, docs: DataFrame, keep: dict[str, Column] | None = None, arity: int = ARITY, height: int = BLOCK_HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root (lower-case hex), witness and the columns ``keep`` (name: Column over ``docs``) of each row of
    ``docs`` (doc_id, source, lang, n_chars, text).

    The leaf is a hash of the five columns. Leaves of a source ascend by doc_id, null first; rows that share it ascend by
    leaf, so repeated rows are leaves of their own and it does not matter which is which. While more than one node of a source
    remains, every ``arity`` neighbours (the last fewer, even one) become the hash of their hashes; what remains is the subroot. The
    subroots, by source (null first, bytewise), give the root likewise. ``witness`` has a step for each level from the leaf to the
    root: the siblings ``before`` and ``after`` (digests); ``folded_root`` checks it. A null source is a source of its own; null
    and empty texts give different leaves; texts are hashed whole. An empty table gives an empty result. ``height`` is the height of
    the blocks in which nodes are appended, and does not change results.
    """
    ship_package(spark)
    folder = shared_folder(spark)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null sorts before all others
    held = {f"_{i}": c for i, c in enumerate((keep or {}).values())}
    leaves = docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf_hash(*map(F.col, FIELDS))).alias("digest"), *(c.alias(n) for n, c in held.items()))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), f"{folder}/leaves")
    sources = _forest(_ranked(leaves, ["doc_id", "digest", "row"], f"{folder}/leaves-by"), f"{folder}/sources", arity, height)

    subroots = stored(sources.where("rank = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), f"{folder}/subroots")
    dataset = _forest(_ranked(subroots, ["of"], f"{folder}/subroots-by"), f"{folder}/dataset", arity, height)
    top = stored(dataset.select(F.col("of").alias("tree"), F.col("root").alias("dataset"), F.col("witness").alias("above")), f"{folder}/top")
    return sources.join(small_side(top), "tree").select(
        "doc_id",
        F.lower(F.hex("digest")).alias("leaf"),
        F.lower(F.hex("root")).alias("subroot"),
        F.lower(F.hex("dataset")).alias("root"),
        F.concat("witness", "above").alias("witness"),
        *(F.col(n).alias(name) for n, name in zip(held, keep or {}, strict=True)),
    )
