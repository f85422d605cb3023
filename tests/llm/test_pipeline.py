import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from staffline.llm.common import shared_folder, stored
from tests.conftest import SF_SMALL

from .helpers import check_packing, components, fingerprint, frame, normalised, saved, shingles5
from .test_packing import expected_pieces


def plain(documents, benchmark):
    """What the stages must keep, one after the other, and the pieces of the last."""
    docs = {d: t for d, t in documents.items() if t and re.search(r"[^\W\d_]", t)}
    seen = {}
    for d in sorted(docs):
        seen.setdefault(normalised(docs[d]), d)
    docs = {d: docs[d] for d in seen.values()}
    prints = {d: fingerprint(t) for d, t in docs.items()}
    smallest = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    docs = {d: t for d, t in docs.items() if smallest[d] == d}
    items = [s for s in map(shingles5, benchmark) if s]
    return {d: t for d, t in docs.items() if not any(len(s & shingles5(t)) / len(s) >= 0.8 for s in items)}


def test_against_plain_version(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    kept = plain(documents, benchmark)
    assert len(kept) < len(documents)
    rows = P.run(spark, SF_SMALL).collect()
    want = sorted((d, *piece) for d, t in kept.items() for piece in expected_pieces(t, 4096))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_packing(rows) == -(-sum(r.length for r in rows) // 4096)


def test_columns_stay_and_odd_rows_do_not_break_a_stage(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(30))
    words = " ".join(f"word{i}" for i in range(200))
    rows = [
        (1, words), (2, words + " "), (3, words.replace("word7 ", "other ")), (4, "text with " + item), (5, None), (6, ""), (7, "12 34"),
        (8, "a clean document that stays"), (8, "a clean document that stays"), (None, "another clean one without an id"), (9, "x"),
    ]
    docs = frame(spark, rows, clashing=True).withColumn("_metadata", F.lit("x"))
    sf = saved(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))
    folder, names = shared_folder(spark), docs.columns
    docs = docs  # not from files: the stages store it themselves
    for number, (_, stage) in enumerate(P.STAGES[:-1]):
        docs = stored(stage(spark, docs, sf), f"{folder}/{number}")
        assert docs.columns == names
    left = [r.doc_id for r in docs.collect()]
    assert sorted(map(str, left)) in (["1", "8", "9", "None"], ["1", "3", "8", "9", "None"])
    assert len(P.run(spark, sf).collect()) == len(left)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    assert P.run(spark, saved(spark, tmp_path, documents=frame(spark, []), benchmark=none)).collect() == []


def test_stages():
    assert [n for n, _ in P.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
