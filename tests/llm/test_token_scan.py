import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffline.llm import token_scan as S
from staffline.llm.common import shared_folder
from staffline.llm.tokens import tokenizer_path
from staffline.llm import queries

from .helpers import frame, saved

TEXTS = ["Hello, \"world\"!", None, "", "a <|endoftext|> b", "x" * 3000, "one two three " * 500, "é ü", " \n"]


def plain_count(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return len(t.encode(text or "", add_special_tokens=False).ids)


def test_query_against_plain_counts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "a b"), (7, "a b")]
    sf = saved(spark, tmp_path, documents=frame(spark, rows, clashing=True).repartition(3))
    got = queries.op6_token_counts(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), plain_count(t)) for d, t in rows)


@pytest.mark.parametrize("block", [2, 4, 6, 62, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for name in ("part-0", "part-1", "part-2", "part-3"):
        ids = rng.integers(0, 6, {"part-0": 400, "part-1": 1, "part-2": 0, "part-3": 90}[name])
        if name == "part-3":
            ids = np.append(ids, 5)
        ids.astype("<u2").tofile(tmp_path / name)
        start = 0
        for n, end in enumerate([*np.flatnonzero(ids == 5), *([len(ids)] if len(ids) and ids[-1] != 5 else [])]):
            want.append((name, n, start, end - start, end < len(ids)))
            start = end + 1
    got = S.scan_token_files(spark, str(tmp_path), separator=5, block_bytes=block).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.doc_no, r.start, r.n_tokens, r.ended) for r in got) == sorted(want)


@pytest.mark.parametrize("setting", [("spark.sql.files.maxRecordsPerFile", "7"), ("spark.sql.files.maxPartitionBytes", "2000"), ("spark.sql.files.minPartitionNum", "29")])
def test_counts_meet_their_documents_whatever_is_set(spark, tmp_path, setting):
    """Records a file, and partitions that differ between the writing scan and all later ones."""
    rows = [(i, "a " * (i % 97)) for i in range(600)]
    sf = saved(spark, tmp_path, documents=frame(spark, rows).repartition(4))
    spark.conf.set(*setting)
    try:
        result = queries.op6_token_counts(spark, sf)
        if "Records" not in setting[0]:
            spark.conf.unset(setting[0])
        assert sorted((r.doc_id, r.n_tokens) for r in result.collect()) == [(i, i % 97) for i in range(600)]
    finally:
        spark.conf.unset(setting[0])


def test_lost_and_doubled_files_raise(spark):
    for change in ("lose", "double"):
        folder = shared_folder(spark)
        S.write_token_files(spark, frame(spark, [(i, "a b") for i in range(9)]).coalesce(1), folder, name="doc_id")
        (names,) = [f for f in os.scandir(f"{folder}/kind=names") if f.name.startswith("part-")]
        data = open(names.path, "rb").read()
        assert len(data) == 9 * 11
        with open(names.path, "wb") as out:
            out.write(data[:-11] if change == "lose" else data + data[:11])
        os.path.exists(crc := f"{folder}/kind=names/.{names.name}.crc") and os.remove(crc)
        with pytest.raises(Exception, match="do not meet"):
            S.named_counts(spark, folder).collect()


def test_a_file_above_two_gigabytes_is_searched_by_many_tasks(spark, tmp_path):
    """A sparse file: zeros are tokens, and separators stand before, at and after block and 2 GB boundaries."""
    places = [3, S.BLOCK_BYTES // 2 - 1, S.BLOCK_BYTES // 2, (1 << 30) - 1, 1 << 30, (5 << 28) - 1]
    with open(tmp_path / "part-0", "wb") as out:
        for p in places:
            out.seek(2 * p)
            out.write(S.separator_bytes(S.SEPARATOR, 2))
    blocks, seekable = S.byte_ranges(spark, str(tmp_path), 2)
    assert seekable and blocks.select(F.spark_partition_id()).distinct().count() > 20
    got = S.scan_token_files(spark, str(tmp_path)).orderBy("doc_no").collect()
    starts = [0, *(p + 1 for p in places)]
    assert [(r.start, r.n_tokens, r.ended) for r in got] == [(s, p - s, True) for s, p in zip(starts, places)]


def test_files_that_tasks_cannot_open_are_read_whole(spark, tmp_path, monkeypatch):
    ids = np.array([1, 2, 5, 5, 3, 5, 4], "<u2")
    ids.tofile(tmp_path / "part-0")
    monkeypatch.setattr(S, "SEEKABLE", {"hdfs": "hdfs"})
    blocks, seekable = S.byte_ranges(spark, str(tmp_path), 2, block_bytes=4)
    assert not seekable and blocks.where("content IS NULL").isEmpty()
    got = S.scan_token_files(spark, str(tmp_path), separator=5, block_bytes=4).orderBy("doc_no").collect()
    assert [(r.n_tokens, r.ended) for r in got] == [(2, True), (0, True), (1, True), (1, False)]


def test_a_cut_token_is_an_error_and_an_empty_table_is_not(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends inside a token"):
        S.scan_token_files(spark, str(tmp_path)).collect()
    folder = shared_folder(spark)
    S.write_token_files(spark, frame(spark, []), folder)
    assert S.scan_token_files(spark, folder).collect() == []


def test_wide_ids(spark):
    folder = shared_folder(spark)
    S.write_token_files(spark, frame(spark, [(1, "a b c"), (2, "d")]).coalesce(1), folder, width=4)
    assert [r.n_tokens for r in S.scan_token_files(spark, folder, width=4).orderBy("doc_no").collect()] == [3, 1]
