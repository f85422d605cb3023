import random

from staffline.llm import decontaminate as D

from .helpers import frame, shingles5

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(300)]
ITEMS = [(i, " ".join(RNG.choices(VOCABULARY, k=k))) for i, k in enumerate((5, 6, 9, 10, 14, 20, 21, 40, 57, 120))]
ITEMS += [(50, None), (51, ""), (52, "too few words here"), (53, ITEMS[5][1]), (53, ITEMS[6][1]), (None, ITEMS[7][1])]


def text(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def damaged(item, changes):
    words = item.split()
    for _ in range(changes):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY)
    return " ".join(words)


def documents():
    docs, n = [(900, None), (901, ""), (902, "a b")], 0
    for _, item in ITEMS:
        for changes in (0, 1, 2, 4):
            if item:
                n += 1
                words = damaged(item, changes).split()
                half = len(words) // 2
                docs += [
                    (n, f"{text(30)}  {' '.join(words).upper()}; {text(400)}"),
                    (n + 200, f"{' '.join(words[half:])} {text(50)} {' '.join(words[:half])}"),
                ]
    return [*docs, docs[3], (None, docs[3][1]), (950, text(3000) + " " + ITEMS[9][1] + " " + text(3000))]


def test_against_all_pairs(spark):
    docs = documents()
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, wanted string, hashes int")
    got = D.contained_items(spark, frame(spark, docs, clashing=True), benchmark).collect()
    want = []
    for doc_id, t in docs:
        own = shingles5(t)
        for item_id, item in ITEMS:
            n, common = len(shingles5(item)), len(shingles5(item) & own)
            if n and common / n >= 0.8:
                want.append((doc_id, item_id, n, common))
    assert len(want) > 40
    assert sorted(map(str, ((r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in got))) == sorted(map(str, want))


def test_signatures_lose_nothing():
    """An item of n shingles may lack n - ceil(0.8 n) of them; the signature of its partition is longer than that."""
    for n in range(1, 2000):
        upper = 1
        while upper < n:
            upper *= 2
        least = -(-8 * n // 10)
        assert min(n, upper - -(-8 * upper // 10) + 1) > n - least


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(spark, frame(spark, [(1, text(20))]), none).collect() == []
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contained_items(spark, frame(spark, []), some).collect() == []


def test_no_python_in_the_plan(spark):
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = D.contained_items(spark, frame(spark, [(1, "a")]), some)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_sides_are_joined_by_a_shuffle(spark, monkeypatch):
    from staffline.llm import common

    docs, some = frame(spark, documents()), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(str, D.contained_items(spark, docs, some).drop("locator").collect()))
    monkeypatch.setattr(common, "FEW", 0)
    found = D.contained_items(spark, docs, some).drop("locator")
    assert sorted(map(str, found.collect())) == want
    assert "SortMergeJoin" in found._jdf.queryExecution().toString()


def test_only_what_a_bitmap_lets_through_is_shuffled(spark, tmp_path, monkeypatch):
    """Above FEW signature rows, shingles pass the bitmap before any exchange."""
    from staffline.llm import common

    frame(spark, [(i, text(400)) for i in range(60)] + [(99, text(50) + " " + ITEMS[3][1])]).write.parquet(f"{tmp_path}/d")
    docs, some = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(common, "FEW", 0)
    passed = []
    monkeypatch.setattr(D, "in_bitmap", lambda *a: passed.append(common.in_bitmap(*a)) or passed[0])
    assert {(r.doc_id, r.item_id) for r in D.contained_items(spark, docs, some, common.file_locator(docs)).collect()} >= {(99, ITEMS[3][0])}
    assert passed[0].count() < 60 * 396 / 10
    plan = passed[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "hashpartitioning(hash" not in plan


def test_columns_called_metadata(spark):
    some = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, _metadata string")
    plain = documents()
    docs = frame(spark, plain).selectExpr("*", "'x' AS _metadata")
    got = D.contained_items(spark, docs, some).select("doc_id", "item_id").collect()
    assert sorted(map(str, got)) == sorted(map(str, D.contained_items(spark, frame(spark, plain), some.drop("_metadata")).select("doc_id", "item_id").collect()))
