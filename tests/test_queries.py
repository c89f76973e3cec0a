"""The registered queries: names, and some of them against their oracle SQL on the smallest data."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidyledger.plans import catalog
from compare import difference, duck

SMALLEST = "/root/testdata/sf0.001"


def test_every_query_of_the_library_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SMALLEST).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [
    "clean_currency", "clean_dates", "silver_stats", "top_k", "keep_last", "upsert", "similar_names_small_blocks",
    "redact", "mask", "conversation_tail", "nearest_filtered", "bronze_row_numbers"])
def test_query_equals_oracle(spark, name):
    assert difference(entry.queries()[name](spark, SMALLEST), duck(SMALLEST), entry.oracle_sql()[name]) is None
