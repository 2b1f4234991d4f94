"""What is registered, and the queries that SQL can express."""

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from cohortlink.llm.oracle import ORACLE
from cohortlink.llm.queries import QUERIES
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan and "NestedLoop" not in plan
