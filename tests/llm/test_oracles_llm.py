"""Queries of the training-data operators against their oracle texts."""

import os

import oracle
import pytest

from logspark.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    same, message, _ = oracle.compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert same, message


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
