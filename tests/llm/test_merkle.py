"""Merkle manifest: a plain version, awkward rows, and blocks of different heights."""

import hashlib

import pytest
from pyspark.sql import functions as F

from staffline.llm.merkle import OpenSubtrees, folded_root, manifest, witness_hash
from tests.llm.helpers import CLASHING, DOCS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """(root, [(siblings before, siblings after) for each level] for each digest)."""
    paths, level = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for n, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append(("".join(d for d, _ in run[:n]), "".join(d for d, _ in run[n + 1 :])))
            above.append((h(*(d for d, _ in run)), [m for _, members in run for m in members]))
        level = above
    return level[0][0], paths


def plain_manifest(rows):
    """[(doc_id, leaf, subroot, root, hash of the siblings)], sorted."""
    def leaf(row):
        doc_id, text, lang, source, n_chars = row
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in rows if r[3] == s))
        trees[s] = (own, *plain_tree([x[2] for x in own]))
    root, above = plain_tree([trees[s][1] for s in sources])
    found = []
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        found += [(x[1] if x[0] else None, x[2], subroot, root, h(*(b + a for b, a in p + up))) for x, p in zip(own, paths, strict=True)]
    return sorted(found, key=repr)


ROWS = (
    [(i * 7 % 100, f"text {i}\nline é", "en", f"s{i % 4 if i % 3 else 0}", i) for i in range(60)]
    + [(1, "same", "en", "dup", 4)] * 11
    + [(None, None, None, None, None), (None, "", None, None, 0), (5, "x" * 300_000, None, "", 1), (6, "x", "de", "ü", 1), (6, "x", "de", "ö", 1)]
)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_plain_version(spark, height):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = manifest(spark, docs, height=height)
    rows = got.withColumn("folded", folded_root(F.col("leaf"), F.col("witness"))).withColumn("siblings", witness_hash(F.col("witness"))).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.siblings) for r in rows), key=repr) == plain_manifest(ROWS)
    assert all(r.folded == r.root for r in rows)


def test_columns_that_clash_and_carried_columns(spark):
    named = [(*r, "x", 1, 1, "r", "s", 1, 1, 1, 1) for r in ROWS[:9]]
    docs = spark.createDataFrame(named, CLASHING).withColumn("tree", F.lit("t")).withColumn("digest", F.lit(3)).withColumn("_0", F.lit(1)).withColumn("rank", F.lit(0))
    rows = manifest(spark, docs, {"leaf of another text": F.upper("text")}).collect()
    assert sorted((r.doc_id, r.leaf) for r in rows) == sorted((x[0], x[1]) for x in plain_manifest(ROWS[:9]))
    assert {r["leaf of another text"] for r in rows} == {r[1].upper() for r in ROWS[:9]}


def test_empty_table_and_single_row(spark):
    assert manifest(spark, spark.createDataFrame([], DOCS)).collect() == []
    (row,) = manifest(spark, spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)).collect()
    assert row.leaf == row.subroot == row.root and row.witness == []


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = manifest(spark, spark.createDataFrame(ROWS[:20], DOCS), {"other": F.sha2("text", 256)})
    assert rows.where(folded_root(F.col("other"), F.col("witness")) == F.col("root")).count() == 0


def test_witnesses_grow_with_each_append():
    """A witness is right for the subtree that is closed by then, after every append."""
    trees, nodes, digests = OpenSubtrees(3), [], [bytes([i]) * 32 for i in range(27)]
    for i, d in enumerate(digests):
        nodes.append(trees.append(d))
        closed = 1
        while (i + 1) % (closed * 3) == 0:
            closed *= 3
        first = i + 1 - closed
        root, paths = plain_tree([x.hex() for x in digests[first : i + 1]])
        for node, path in zip(nodes[first:], paths, strict=True):
            steps = [("".join(b.hex() for b in s["before"]), "".join(a.hex() for a in s["after"])) for s in node.witness()]
            assert steps == path
    assert trees.close(None).hex() == plain_tree([d.hex() for d in digests])[0]
