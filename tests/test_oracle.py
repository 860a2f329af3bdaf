"""Every registered query with SQL against DuckDB on the same tables; the others must run."""

import pytest
from conftest import same

import __spark_entry__ as entry
from arborlens.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, data, name):
    same(QUERIES[name](spark, data), duck.execute(ORACLE_SQL[name]))


def test_queries_without_sql_have_tests_of_their_own():
    """Each is compared with a plain version in test_fixtures.py."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"fn_parse_common_names", "fn_top_common_names", "fn_name_from_url", "str_tx_ledger", "vec_cluster", "geo_simplify"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
