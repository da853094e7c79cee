import json

import pytest
from make_expected import PLACE, rows

import oracle
from sievestone.plans import ORACLES, QUERIES

with open(PLACE, encoding="utf-8") as f:
    EXPECTED = json.load(f)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert oracle.compare(spark, name, QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_rows(spark, name):
    """Queries over inline sources give exactly the rows that were looked at and kept."""
    assert EXPECTED[name]["rows"] and rows(QUERIES[name](spark, oracle.SF)) == EXPECTED[name]


def test_every_query_is_held_to_rows():
    """What has neither SQL nor kept rows has a plain version in test_duplicates.py."""
    assert set(QUERIES) - set(ORACLES) - set(EXPECTED) == {"minhash_estimate_96"}
