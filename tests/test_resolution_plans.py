"""Queries over resolved figures keep plans that a small driver can hold."""

import re

import pytest

import __spark_entry__ as entry
from tests.support import DATA

#: Exchanges that a plan may have; with the figures of all filings planned anew wherever they were used there were over 200.
MOST = 40


@pytest.mark.parametrize("name", ["resolve_requests", "built_gold", "compare_answers", "computed_answers", "numeric_answers", "resolve_coverage", "resolve_validation", "trend_answers", "operand_pairs"])
def test_plan_is_small(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(re.findall(r"\bExchange\b", plan)) <= MOST
