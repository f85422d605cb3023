"""Connected components of a distributed graph by alternating large and small stars.

Each round replaces every neighbourhood by a star around its smallest node, with one grouped minimum and
one join for either star. The minima are reduced in each task before their shuffle and written as a table, which is broadcast if it is small; else
the join is one whose other side Spark's skew handling can split, so the links of a hub are dealt over many tasks. The number of
rounds is logarithmic in the longest path. Each round's links are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm.common import small_side, stored


def roots(spark: SparkSession, links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b) that is not the smallest of its component.

    Loops and repeated links are allowed; no links give no rows.
    """
    links = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{folder}/links-0")
    mark, turn = _mark(links), 0
    while True:
        turn += 1
        wide = stored(_large_star(links, f"{folder}/large-{turn}"), f"{folder}/wide-{turn}")
        links = stored(_small_star(wide, f"{folder}/small-{turn}").distinct(), f"{folder}/links-{turn}")
        before, mark = mark, _mark(links)
        if mark == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame, path: str) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), path)
    return both.where("b > a").join(small_side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, path: str) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (links point from large to small)."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), path)
    moved = links.join(small_side(least), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))
