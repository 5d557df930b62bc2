"""Every registered query against its DuckDB oracle on the smallest data set."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from conftest import SF001  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF001).toPandas()
    dd = con.execute(ORACLE[name]).df()
    ok, msg, _ = compare(sp, dd)
    assert ok, msg


def test_every_query_has_docstring_and_runs_rows_only(spark):
    for name, fn in QUERIES.items():
        assert fn.__doc__, name
        if name not in ORACLE and name != "m15_tournament":  # the tournament has its own test
            assert fn(spark, SF001).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "user_7d_msg_count" in df.columns
