"""Q2: the sanitiser, against listed cases and against the same expression in DuckDB."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staffline.functions.text import STRIP_CHARS, sanitize_column
from staffline.operators.text import sanitize_text
from staffline.plans.oracle import sanitize_sql

CASES = [
    ("-;-", ""), ("-\\-", "--"), ("/'*", ""), ("/%*", "/*"), ("---", "-"),
    ("\x1cq\x1f\n", "q"), (None, ""), ("", ""), ("  a<b>&c|d  ", "abcd"),
    ("　 x y ", "x y"), ("😀" * 120, "😀" * 100),
    ("O'Brien; DROP--", "OBrien DROP"),
]


def in_duckdb(texts):
    con = duckdb.connect()
    return [con.execute(f"SELECT {sanitize_sql('t')} FROM (SELECT CAST(? AS VARCHAR) AS t)", [t]).fetchone()[0] for t in texts]


def test_column_matches_cases(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "id int, s string")
    got = {r["id"]: r["c"] for r in df.select("id", sanitize_column("s").alias("c")).collect()}
    assert got == {i: clean for i, (_, clean) in enumerate(CASES)}


def test_strip_chars_are_python_whitespace():
    assert len(STRIP_CHARS) == 29
    assert all(c.isspace() for c in STRIP_CHARS)


ALPHABET = st.sampled_from(list("ab -;/*'\"\\%<>&|") + list(STRIP_CHARS) + ["é", "😀"])


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=130), min_size=50, max_size=50))
def test_column_equals_duckdb_on_random_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")
    got = {r["id"]: r["c"] for r in df.select("id", sanitize_column("s").alias("c")).collect()}
    assert got == dict(enumerate(in_duckdb(texts)))


def test_sanitize_text_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = sanitize_text(docs, {"text": "clean"}, keep=["doc_id"])
    assert out.columns == ["doc_id", "clean"]
    src = docs.select("doc_id", "text").collect()
    assert dict(map(tuple, out.collect())) == dict(zip([r["doc_id"] for r in src], in_duckdb([r["text"] for r in src])))


def test_a_literal_folds(spark):
    plan = spark.range(1).where(sanitize_column(F.lit(" a;b ")) == F.lit("ab"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_spread_keeps_rows_and_adds_one_exchange(spark):
    import contextlib
    import io
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = sanitize_text(docs, {"text": "clean"}, keep=["doc_id"])
    spread = sanitize_text(docs, {"text": "clean"}, keep=["doc_id"], spread=4)
    assert sorted(plain.collect()) == sorted(spread.collect())
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        spread.explain()
        plain.explain()
    spread_plan, plain_plan = buf.getvalue().split("== Physical Plan ==")[1:]
    assert "Exchange hashpartitioning(doc_id" in spread_plan and "Exchange" not in plain_plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in spread_plan  # only key and text cross the shuffle
