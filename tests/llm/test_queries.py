"""The registered queries: which there are, and those that SQL can express against DuckDB."""

import re

import pytest

import __spark_entry__ as entry
from staffline import plans
from staffline.llm import queries as llm
from tests.conftest import SF_ORACLE


def test_one_query_for_each_operator():
    names = sorted(llm.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(entry.queries()) == set(plans.queries()) | set(names) | {"pipeline"}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = llm.queries()[name](spark, SF_ORACLE)
    theirs = duck.sql(llm.oracle_sql()[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    expected = [tuple(r[theirs.columns.index(c)] for c in order) for r in theirs.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in ours.collect()))) == sorted(map(repr, expected))
