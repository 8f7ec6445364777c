"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from podium.plans.queries import REGISTRY
from tests.oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, connection, name):
    frame = __spark_entry__.queries()[name](spark, SF_DIR)
    assert differences(frame, connection, __spark_entry__.oracle_sql()[name]) == []


def test_every_query_is_offered():
    assert set(REGISTRY) <= set(__spark_entry__.queries())
    assert set(REGISTRY) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() == 21
    assert frame.columns[:3] == ["y", "o_orderstatus", "n"]
