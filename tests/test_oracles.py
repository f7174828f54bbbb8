"""A sample of registered queries against their SQL oracles; the whole set is oracle_check.py."""

import os

import pytest
from oracle_check import DATA, compare, connect

SAMPLE = ("sentence_counts_by_language h6_read_number g1_search_union c5_missing_audio e1_elapsed"
          " i1_upsert j5_fold_jobs e9_reading_order").split()
DIRECTORY = f"{DATA}/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    from lectern.plans.catalog import ORACLES, QUERIES

    assert compare(QUERIES[name](spark, DIRECTORY), connect(DIRECTORY), ORACLES[name]) is None
