"""Plan checks: pushdown, pruning, top-k, single pass, no Python in the plan."""

import contextlib
import io
import re

import pytest

from staffline import (
    employee_profile, employee_profile_exact, hr_summary, leave_requests, performance_reviews, search_employees,
)
from staffline import plans
from staffline.sources import fixture_tables, parquet_tables

from .conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def tree(text: str) -> str:
    """The operator tree at the top of a formatted plan (no node details)."""
    return text.split("\n\n")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The fixture written once as plain parquet tables (stored columns, as in
    production), so that scan-level pushdown can be checked."""
    out = tmp_path_factory.mktemp("hr")
    for name, df in fixture_tables(spark, SF_SMALL).items():
        df.write.parquet(str(out / f"{name}.parquet"))
    return parquet_tables(spark, str(out))


def test_search_pushdown_and_topk(stored):
    p = plan(search_employees(stored, role="MACH", office_location="Austin", limit=10))
    assert "StringContains(role,MACH)" in p
    assert "EqualTo(office_location,Austin)" in p
    assert "TakeOrderedAndProject" in p
    assert "ReadSchema: struct<employee_id:bigint,name:string,department:string,role:string," \
           "office_location:string,employment_status:string>" in p


def test_summary_keys_are_not_forced_into_one_task(stored):
    p = plan(hr_summary(stored, 30, as_of="2024-01-31 00:00:00"))
    assert "REPARTITION_BY_NUM" not in p and "rangepartitioning" in p


def test_leave_lookback_reaches_scan(stored):
    p = plan(leave_requests(stored, days_back=30, status="Pending", as_of="2024-01-31 00:00:00"))
    assert "GreaterThanOrEqual(submitted_timestamp,2024-01-01T00:00)" in p
    assert "EqualTo(status,Pending)" in p
    assert tree(p).count("TakeOrderedAndProject") == 3
    assert "LeftSemi" in p


def test_profile_aggregates_before_joining(stored):
    p = plan(employee_profile(stored))
    top = [ln for ln in tree(p).splitlines() if ln.strip() and "AdaptiveSparkPlan" not in ln][1]
    assert "HashAggregate" not in top  # no aggregate above the joins
    assert tree(p).count("Scan parquet") == 4  # each table once
    assert "salary" not in p


def test_summary_one_scan_per_table(stored):
    p = plan(hr_summary(stored, 30, as_of="2024-01-31 00:00:00"))
    assert tree(p).count("Scan parquet") == 4
    assert "GreaterThanOrEqual(review_date,2024-01-01)" in p
    lines = tree(p).splitlines()
    depth = {i: len(x) - len(x.lstrip(" :+-*|")) for i, x in enumerate(lines)}
    for i, line in enumerate(lines):
        if "Generate" in line:  # only grouped rows are turned into entries
            below = [x for j, x in enumerate(lines[i + 1:], i + 1) if depth[j] > depth[i]]
            assert "HashAggregate" in "".join(below[:2])


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_no_python_in_plans(spark, name):
    p = plan(plans.queries()[name](spark, SF_SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert marker not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_list_names_never_shuffle_employees(spark, stored):
    """With employees too big to broadcast, only the bounded asks are
    broadcast and employees is scanned, never shuffled, for names."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        p = tree(plan(leave_requests(stored, limit=10)))
    finally:
        spark.conf.set(key, old)
    assert p.count("BroadcastExchange") == 2  # the places of the top rows, and the people they ask for
    assert "BroadcastHashJoin Inner BuildLeft" in p
    assert "LeftOuter" not in p
    assert "SortMergeJoin LeftSemi" in p  # the owner-exists test falls back to sort-merge


def exchanged(df) -> list[str]:
    """The output columns of each hash exchange."""
    nodes = plan(df).split("\n\n")
    return [re.search(r"Input \[\d+\]: \[(.*?)\]", n)[1] for n in nodes if ") Exchange" in n and "Arguments: hashpartitioning" in n]


def test_lists_never_shuffle_whole_rows_by_a_key(spark, stored, no_broadcast):
    for report, wide in ((leave_requests, "status"), (performance_reviews, "goals_achievement")):
        for ids in (None, stored["employees"].select("employee_id")):
            shuffled = exchanged(report(stored, ids=ids, limit=10))
            assert any("employee_id" in columns for columns in shuffled)
            # Above the top-k, the bounded rows are regrouped by their number; nothing else holds a wide column.
            assert all(wide not in columns or "_no" in columns for columns in shuffled)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_id_frames_meet_aggregates_only(spark, stored, no_broadcast):
    """Ids as a DataFrame: every leave and review row is aggregated in its task before it is exchanged."""
    ids = stored["employees"].select("employee_id")
    for report in (employee_profile, employee_profile_exact):
        p = plan(report(stored, ids=ids))
        nodes = {int(n.strip()[1:].split(")")[0]): n for n in p.split("\n\n") if re.match(r"\s*\(\d+\) ", n)}
        path: list[str] = []  # what lies between an exchange and the scan below it
        for line in tree(p).splitlines():
            name, number = re.match(r"[\s:+\-*|]*(.*?) ?\((\d+)\)$", line).groups() if line.endswith(")") else ("", "0")
            path = [] if name.startswith("Exchange") else [*path, name]
            if name.startswith("Scan parquet") and "/employees.parquet" not in nodes[int(number)]:
                assert any("Aggregate" in x for x in path)


def test_text_is_cleaned_without_a_shuffle(spark):
    for name in ("sanitize_documents", "sanitize_conversations", "sanitize_pages"):
        assert "Exchange" not in plan(plans.queries()[name](spark, SF_SMALL))


def test_review_list_is_top_k(stored):
    p = tree(plan(performance_reviews(stored, review_period="Q1 2024", limit=5)))
    assert p.count("TakeOrderedAndProject") == 3  # places, whole rows, result
    assert "EqualTo(review_period,Q1 2024)" in plan(performance_reviews(stored, review_period="Q1 2024", limit=5))


def test_search_without_filters_returns_everyone(spark, stored):
    n = stored["employees"].count()
    assert n <= 1000
    assert search_employees(stored, limit=1000).count() == n


def test_reports_on_tables_bucketed_by_employee_need_no_big_shuffle(spark, tmp_path):
    """Stored bucketed (and sorted) by ``employee_id``, the four tables feed the
    profile's aggregations and joins with no exchange at all, and the lists
    never shuffle the fact table."""
    src = fixture_tables(spark, SF_SMALL)
    bucketed = {}
    for name, df in src.items():
        table = f"staffline_bucketed_{name}"
        (df.write.mode("overwrite").bucketBy(4, "employee_id").sortBy("employee_id")
         .option("path", str(tmp_path / name)).saveAsTable(table))
        bucketed[name] = spark.table(table)
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for report in (employee_profile, employee_profile_exact):
            df = report(bucketed)
            p = plan(df)
            assert "Exchange" not in p
            assert tree(p).count("SortMergeJoin") == 3
            assert sorted(df.collect()) == sorted(report(src).collect())
        # The lists: the owner-exists semi join stays inside the buckets too; the only
        # exchanges move the <= 2 * limit name lookups.
        for report in (leave_requests, performance_reviews):
            df = report(bucketed, limit=20)
            p = tree(plan(df))
            assert "SortMergeJoin LeftSemi" in p
            # Two broadcasts of at most 2 * limit rows (places, asks) and their regrouping.
            assert p.count("BroadcastExchange") == 2 and p.count("Exchange") == 3
            assert sorted(df.collect()) == sorted(report(src, limit=20).collect())
    finally:
        spark.conf.set(key, old)
