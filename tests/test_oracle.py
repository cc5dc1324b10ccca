"""Every registered query against its SQL in DuckDB, over whole tables of the smallest scale."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# The corpus operators, where present, have tests of their own.
QUERIES, ORACLE = ({k: v for k, v in found.items() if k != "pipeline" and not re.match(r"op\d+_", k)} for found in (entry.queries(), entry.oracle_sql()))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    text, fine = compare(spark, duck, SF, name, QUERIES[name], ORACLE[name])
    assert fine, text


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_queries_without_sql_are_few():
    """only what SQL cannot express: learners."""
    assert set(QUERIES) - set(ORACLE) == {
        "yield_model", "alert_model", "price_forecast", "seasonal_forecast", "anomaly_forest"}


def test_queries_read_whole_tables():
    """No registered SQL takes a modulo slice of ids or a prefix of the input to stay cheap."""
    for name, sql in ORACLE.items():
        assert "TABLESAMPLE" not in sql.upper() and "USING SAMPLE" not in sql.upper(), name


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns[0] == "market_id"
