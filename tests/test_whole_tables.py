"""Queries that read a table read all of its rows and columns."""

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sentiment_features", "review_predictions"])
def test_all_documents_are_scored(spark, name):
    every = sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in entry.queries()[name](spark, SMALL).collect()) == every


def test_all_columns_are_profiled(spark):
    got = {r.column: r for r in entry.queries()["column_profile"](spark, SMALL).collect()}
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    n = events.count()
    assert set(got) == set(events.columns)
    assert all(r.non_null_count + r.null_count == n and r.sample_values for r in got.values())
    for c in ("ts", "props"):
        values = {str(r[0]) for r in events.select(events[c].cast("string")).distinct().collect()}
        assert got[c].unique_count == len(values) and got[c].sample_values == ", ".join(sorted(values)[:3])
