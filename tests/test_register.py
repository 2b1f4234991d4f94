"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from cohortlink.plans.oracle import ORACLE
from cohortlink.plans.register import QUERIES

from .check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", ["q_batch_ids", "q_fuzzy_batch", "q_group_report", "q_link_left"])
def test_results_do_not_depend_on_partitions(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLE[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
