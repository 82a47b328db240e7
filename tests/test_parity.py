"""A part of the catalogue against its SQL at the smallest scale (``parity.py`` runs all)."""

import os

import pytest
from parity import compare, connection

from orbweave.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["edges_distinct", "organisation_type", "reply_counts_masked", "common_interests", "bit_expand", "least_interaction", "q1_x0", "bit_ops", "parse_query_text", "result_text"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, name):
    assert not compare(spark, connection(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
