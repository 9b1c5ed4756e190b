"""Physical plans: no loops over two large sides, no Python where built-ins serve, columns and filters pushed to the scan."""

from __future__ import annotations

import re

import pytest
from support import DATA

from penumbra.plans import catalogue

#: Queries whose plan may pair all rows: a one-row side.
LOOPS = {"impute_group_median", "knee_point"}
#: Queries with Python in tasks: state by key, and text encodings.
PYTHON = {"rate_limit_accepts", "polyline_round_trip"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_loops_and_no_python(spark, name):
    text = plan(catalogue.QUERIES[name](spark, DATA))
    if name not in LOOPS:
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text), text
    if name not in PYTHON:
        assert not re.search(r"Python|Pandas|MapInArrow", text), text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(catalogue.QUERIES["reject_cascade"](spark, DATA))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert set(re.findall(r"(\w+):", schema)) == {"o_orderstatus", "o_totalprice", "o_orderdate"}


def test_filters_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["service_calendar_active"](spark, DATA))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
