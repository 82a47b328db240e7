"""The queries that have SQL against it in DuckDB, on the smallest tables."""

import os

import pytest
from parity import compare, connection

pytest.importorskip("tokenizers")

from orbweave.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, name):
    assert not compare(spark, connection(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF)
