"""Every registered query of the library against its oracle SQL."""

from __future__ import annotations

import pytest

from chronogrid.plans import registry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(registry.oracle_sql()[name]).fetchdf()
    assert difference(got, want) is None


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
