"""Every registered query of the engine runs; those with an oracle give its rows."""

import pytest

import __spark_entry__ as entry
from lexforge.plans.registry import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 20 and df.columns == ["chunk_id", "document_id", "rrf_score", "score", "rank", "snippet"]
