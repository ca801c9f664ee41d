"""Every query against its SQL twin on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402
from eventledger.plans import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.all_queries()))
def test_query(spark, con, name):
    verdict, _, _, detail = check_queries.compare(
        spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR
    )
    assert verdict == "ok", detail


def test_entry(spark):
    assert {r.status for r in entry.entry(spark).collect()} == {"persisted", "duplicate", "dead_letter"}
