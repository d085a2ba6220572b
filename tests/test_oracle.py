"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as contract  # noqa: E402
import check_oracle  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    ok, message, _ = check_oracle.compare(spark, con, SF, name)
    assert ok, message


def test_entry_has_a_stable_schema(spark):
    if os.path.isdir(SF):
        assert contract.entry(spark).columns == ["user_id", "runs", "attack_rows", "longest", "attack_seconds", "captures"]
