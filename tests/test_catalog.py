"""Every registered query at the smallest scale, against its SQL where it has one."""

from __future__ import annotations

import os
import sys

import pytest

from cohortry.catalog import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.count() > 0 and "total_genetic_variants" in df.columns
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.integration
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, FOLDER, name)
    assert ok, note
    assert "TYPES" not in note, note
