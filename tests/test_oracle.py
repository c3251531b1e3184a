"""Every registered query against its independent DuckDB SQL (the driver's
correctness gate), on the small driver tables. Set QUADRAT_ORACLE_SF to check
another folder (e.g. /root/testdata/sf0.01)."""

import os

import pytest

from quadrat.queries import QUERIES
from tests.oracle_check import compare

SF = os.environ.get("QUADRAT_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def results(spark):
    if not os.path.exists(SF):
        pytest.skip("driver tables not available")
    return compare(spark, SF, keys=list(QUERIES), verbose=False)


def test_every_query_has_an_oracle():
    """All survey queries; the training-data operators bring their own tests."""
    import __spark_entry__ as E
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns[:5] == ["SY", "Site", "Height", "Basal_Area", "Density"]


def test_queries_match_oracle(results):
    bad = {k: v for k, v in results.items() if not v.startswith("OK")}
    assert not bad, bad
