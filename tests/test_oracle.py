"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


# the split plans need cells of every kind, which the smallest grid does not have
LARGER_ONLY = {"I5_split_plan", "I6_split_report", "build_splits", "build_splits_declustered"}
# iterative operators without SQL, compared with brute force in test_spatial.py
BRUTE_FORCE = {"I3_split_decluster", "I4_components", "A39_component_sizes"}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    if name in LARGER_ONLY:
        pytest.skip("checked at sf0.01 by tools/check_oracle.py")
    if name in BRUTE_FORCE:
        pytest.skip("checked in test_spatial.py")
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    result, _n = compare(df, con, sql, tol=2e-6)
    assert result == "ok", result


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 4 and "pearson_r" in df.columns
