"""Queries of the corpus operators against their SQL."""

import pytest

from crawlframe.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, check_sql, name):
    check_sql(spark, QUERIES[name], ORACLE[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
