"""Comparison of listings: what a listing needs is made once, before it meets its pairs."""

from pyspark.sql import functions as F

from meritlens.operators import compare as P
from meritlens.workload import listing_queries as Q

SIDE = (
    "title string, currency string, base_price double, shipping_fee double, platform_discount double, seller_discount double, "
    "voucher_discount double, total_price double, delivery_days double, warranty_months double, return_window_days double, specs map<string,string>"
)
ONE = ("Red Ring, 12 mm!", "usd", 10.0, 2.0, None, 1.0, None, None, 3.0, 12.0, None, {"size": "12", "brand": "Ab-C", "note": "", " ": "x", "none": None})
TWO = ("ring red gold", "", None, None, None, None, None, 9.5, None, 24.0, 30.0, {"size": "10", "brand": "ab c", "type": "z"})
EMPTY = (None, None, None, None, None, None, None, None, None, None, None, None)


def test_made_sides_compare_like_raw_ones(spark):
    rows = [(1, ONE, TWO), (2, TWO, ONE), (3, ONE, ONE), (4, EMPTY, TWO), (5, EMPTY, EMPTY)]
    pairs = spark.createDataFrame(rows, f"pair_id int, a struct<{SIDE.replace(' ', ':').replace(',:', ', ')}>, b struct<{SIDE.replace(' ', ':').replace(',:', ', ')}>")
    made = pairs.withColumns({s: P.compared_side(F.col(s)) for s in "ab"})
    raw = {r.pair_id: r for r in P.compare_listings(pairs).collect()}
    assert raw == {r.pair_id: r for r in P.compare_listings(made).collect()}
    # size, brand and note, none, type: both have size and brand, the first none of the others.
    assert raw[1].missing_fields == sorted(["a.return_window_days", "a.specs.none", "a.specs.note", "a.specs.type", "a.total_price_estimated", "b.delivery_days", "b.specs.none", "b.specs.note"])
    assert raw[1].spec_a == round(100 * (0.7 * 2 / 5 + 0.3 * 1.0), 2) and raw[1].spec_b == round(100 * (0.7 * 3 / 5 + 0.3 * (1000 / 12 + 100) / 200), 2)
    assert raw[5].comparability_score == 0.5 and raw[3].comparability_score == 1.0


def test_pairs_are_made_in_one_shuffle(spark, tmp_path):
    lines = [(1, 5), (1, 3), (1, 3), (1, 9), (2, 4), (2, 4), (3, None), (3, 8), (3, 2), (None, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = Q._pairs(spark, str(tmp_path))
    got = sorted(tuple(r) for r in pairs.where("id_a IS NOT NULL").collect())
    assert got == [(9, "3", "5"), (10, "5", "9"), (26, "2", "8")]
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
