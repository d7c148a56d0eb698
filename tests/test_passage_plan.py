"""Passages of a few hits shuffle no texts."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_texts_are_not_shuffled(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as if the tables were large
    try:
        got = E.queries()["passage_windows"](spark, SF)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("documents.parquet") <= 1
        assert got.count() == 20 and got.filter("passage is null").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
