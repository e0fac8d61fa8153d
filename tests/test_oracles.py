"""Every registered query against its oracle text over whole tables."""

import os

import oracle
import pytest

from logspark.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        same, message, _ = oracle.compare(frame, con, ORACLES[name])
        assert same, message
    else:
        assert frame.count() >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
