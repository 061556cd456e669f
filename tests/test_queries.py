"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# The classifier grids without SQL are run by test_evaluate.
SLOW = {"m6_multiclass_logreg", "m7_multiclass_mlp", "m12_grid", "m13_task_suite"}


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, name):
    difference, _ = compare(spark, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert not difference
