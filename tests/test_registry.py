"""Every registered query has rows; a set of them is compared with its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SMALL = "/root/testdata/sf0.001"
COMPARED = (
    "review_signals", "hash_split", "listing_kind", "review_prep", "quota_assignment", "trust_summary", "annotation_parse",
    "product_inputs", "retrieval_profile", "total_price", "listing_normalised", "labelled_source", "column_profile",
    "prepared_review_source", "truth_file_source", "product_file_source", "csv_source_rejects", "sentiment_features", "annotate_pending",
)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toArrow()
    want = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted((tuple(check.plain(r[c]) for c in cols) for r in t.to_pylist()), key=repr)
    assert rows(got) == rows(want)
