"""Pinned values of the value model, fusion and listing rules."""

import math

import pytest
from pyspark.sql import functions as F

from meritlens.functions import money
from meritlens.functions.text import match_key
from meritlens.operators import catalog as C
from meritlens.operators import compare as P
from meritlens.operators import fusion as U
from meritlens.operators import listings as L
from meritlens.operators import value as V

INPUTS = (
    "trust_probability double, ewom_score_0_to_100 double, ewom_magnitude_0_to_100 double, average_rating double, "
    "rating_count double, verified_purchase_rate double, price double, peer_price double, warranty_months double, "
    "return_window_days double"
)


def posterior(spark, *rows, default=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {INPUTS}")
    out = V.good_value_posterior(V.value_evidence(df, default)).orderBy("i").collect()
    return [r["good_value_probability"] for r in out]


def test_posterior_pinned(spark):
    got = posterior(
        spark,
        (0.88, 74.0, 68.0, 4.5, 420.0, 0.91, 79.0, 99.0, 12.0, 30.0),
        (0.22, 28.0, 70.0, 2.9, 35.0, 0.41, 129.0, 99.0, 0.0, 7.0),
        (0.82, 71.0, 64.0, 4.4, 356.0, 0.87, 79.0, 96.0, 12.0, 30.0),
        (None, None, None, 4.2, 120.0, None, 95.0, 100.0, None, None),
        (None,) * 10,
    )
    assert got == pytest.approx([0.7856297576, 0.2440650549, 0.7384904553, 0.5319959130, 0.5383907087], abs=1e-9)


def test_posterior_tables_are_small_and_normalised(spark):
    quality, value = V.posterior_tables(spark)
    assert (quality.count(), value.count()) == (9216, 128)
    off = quality.where("abs(q_low + q_medium + q_high - 1) > 1e-12").count()
    assert off == 0


@pytest.mark.parametrize(
    "price,peer,bucket",
    [(80.0, 100.0, "cheaper"), (109.0, 207.10, "extreme_cheaper"), (153.58, 204.93, "much_cheaper")],
)
def test_price_bucket(spark, price, peer, bucket):
    df = spark.createDataFrame([(None,) * 6 + (price, peer, None, None)], INPUTS)
    assert V.value_evidence(df).first()["relative_price_bucket"] == bucket


def test_fusion_support_gate(spark):
    rows = [("p", 0.9, 0.9, 0.1, 0.9, 0.05)] * 20
    df = spark.createDataFrame(rows, "product_id string, usefulness_probability double, positive_probability double, negative_probability double, helpfulness_gate double, informative_gate double")
    df = df.withColumns({"sentiment_polarity": F.lit(0.8), "sentiment_strength": F.lit(0.8)})
    row = U.review_set_scores(df, ["product_id"]).first()
    assert row["informative_review_weight"] == pytest.approx(1.0)
    assert row["review_set_gate"] == pytest.approx(1 - math.exp(-1 / 3))
    assert row["mean_deception_probability"] is None and row["mean_deception_weight"] == 1.0


def test_fusion_deception_weight(spark):
    df = spark.createDataFrame(
        [(0.9, 0.9, 0.1, 0.8)], "usefulness_probability double, positive_probability double, negative_probability double, deception_probability double"
    )
    assert U.review_fusion(df).first()["deception_weight"] == pytest.approx(0.2)


def test_money_and_durations(spark):
    m = "struct<value:string,currency:string,convertedFromValue:string,convertedFromCurrency:string>"
    df = spark.createDataFrame(
        [
            (("199.99", "SGD", None, None), [("FIXED", ("12.50", "SGD", None, None)), ("FREE", None)], '{"returnPeriod": {"value": 30, "unit": "DAY"}}', {"Manufacturer Warranty": ["2 years"]}),
            (("140.0", "SGD", "109.00", "USD"), [("FIXED", ("90", "SGD", "71.92", "USD"))], None, None),
        ],
        f"price {m}, shipping array<struct<shippingCostType:string,shippingCost:{m}>>, returns_json string, item_specifics map<string,array<string>>",
    )
    a, b = df.select(
        money.total_price(F.col("price"), F.col("shipping")).alias("t"),
        money.total_price(F.col("price"), F.col("shipping"), True, True).alias("u"),
        money.total_currency(F.col("price"), F.col("shipping"), True).alias("c"),
        L.return_days(F.col("returns_json")).alias("r"),
        money.warranty_months(F.col("item_specifics")).alias("w"),
    ).collect()
    assert (a.t, a.r) == (199.99, 30.0) and a.w == pytest.approx(24.3333333333)
    assert b.u == pytest.approx(180.92) and b.c == "USD"


def test_accessory_reading(spark):
    texts = ["Airpods Pro 2nd Generation with MagSafe Charging Case NIB", "AirPods Pro Case with Silicone Lanyard Protective Cover with Keychain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(L.accessory_like(match_key(F.col("t")))).collect()] == [False, True]


def test_retrieval_title(spark):
    spec = {"Model": ["Apple AirPods Pro (2nd generation)"], "Type": ["Earbud (In Ear)"], "Brand": ["Apple"]}
    df = spark.createDataFrame(
        [("Apple AirPods Pro sealed", "New", spec)], "title string, condition string, item_specifics map<string,array<string>>"
    )
    assert L.retrieval_profile(df).first()["retrieval_title"] == "Apple AirPods Pro (2nd generation) Earbud (In Ear)"


def test_listing_kinds(spark):
    df = spark.createDataFrame([("Wireless Earbuds", "Electronics Audio"), ("HDMI Cable", "Electronics Cables")], "t string, c string")
    out = C.with_listing_kind(df, F.col("t"), F.col("c"), F.concat_ws(" ", "t", "c"))
    assert [r["listing_kind"] for r in out.collect()] == ["device", "cable"]


def _context(spark, price, neighbours, accessory=False):
    ranked = spark.createDataFrame(
        [("q", str(i), p, s, i + 1) for i, (p, s) in enumerate(neighbours)],
        "query_id string, parent_asin string, price double, similarity double, place int",
    )
    prof = spark.createDataFrame([("q", price, accessory)], "query_id string, listing_price double, is_accessory boolean")
    return L.listing_context(prof, ranked).first()


def test_peer_price_rules(spark):
    row = _context(spark, 24.99, [(29.99, 0.81), (31.99, 0.69), (27.99, 0.63)])
    assert row["peer_price"] == pytest.approx(30.046338028169016) and row["retrieval_status"] == "usable"
    assert _context(spark, 24.99, [(29.99, 0.81)])["retrieval_status"] == "insufficient_peer_neighbors"
    low = _context(spark, 1000.0, [(80.0, 0.9)] * 3)
    assert low["peer_price"] is None and low["retrieval_status"] == "implausibly_low_peer_price"


def test_k_sweep(spark):
    ranked = spark.createDataFrame(
        [("q", "a", 28.0, 0.78, 1), ("q", "b", 29.0, 0.74, 2), ("q", "c", 30.0, 0.70, 3)],
        "query_id string, parent_asin string, price double, similarity double, place int",
    ).withColumn("rejection_reason", F.lit(None).cast("string"))
    got = {r["k"]: r["peer_price"] for r in L.k_sweep(ranked, [3, 1]).collect()}
    assert got[1] == pytest.approx(28.0) and got[3] == pytest.approx(28.963963963963966)


def _pair(spark, a, b):
    cols = "pair_id int, " + ", ".join(
        f"{s}_title string, {s}_source_url string, {s}_good_value_probability double, {s}_neutral_probability double, {s}_prediction string, "
        f"{s}_prediction_reason string, {s}_price_gap_vs_peer double, {s}_peer_price_source string, {s}_retrieval_status string"
        for s in "ab"
    )
    side = lambda p, n, gap, src, st: ("t", "u", p, n, "good_value", "r", gap, src, st)
    return P.pair_verdicts(spark.createDataFrame([(1, *side(*a), *side(*b))], cols)).first()


def test_pair_verdicts(spark):
    row = _pair(spark, (0.61, 0.5, 0.1, "manual", None), (0.42, 0.5, 0.1, "retrieval", "usable"))
    assert row["verdict"] == "better_A" and row["good_value_probability_delta"] == pytest.approx(0.19)
    row = _pair(spark, (0.3, 0.7, 0.1, "none", None), (0.9, 0.4, 0.1, "manual", None))
    assert (row["price_comparison_mode"], row["verdict"]) == ("neutral_fallback", "better_A")
    row = _pair(spark, (0.8892, 0.5, 0.4737, "manual", None), (0.8892, 0.5, 0.2506, "manual", None))
    assert (row["verdict"], row["basis"]) == ("better_A", "price_gap")
