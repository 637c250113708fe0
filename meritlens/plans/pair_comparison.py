"""Listings to pair verdicts: profile, peers, market context, posterior, verdict, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..operators import compare as P
from ..operators import explain as X
from ..operators import fusion as U
from ..operators import listings as L
from ..operators import retrieval as R
from ..session import materialise

# Candidate pool and similarity floor used for single listings.
LISTING_RETRIEVAL = R.RetrievalConfig(top_k=500, min_similarity=0.02)


def valued_listings(
    listings: DataFrame,
    index: R.RetrievalIndex,
    trust: DataFrame | None = None,
    review_sets: DataFrame | None = None,
    include_shipping: bool = True,
    prefer_converted_usd: bool = False,
    market: L.MarketConfig = L.MarketConfig(),
    retrieval: R.RetrievalConfig = LISTING_RETRIEVAL,
) -> DataFrame:
    """Candidate rows to valued listings keyed by query_id.

    trust: query_id and the columns of ``normalised_trust``, all of which reach the summary. review_sets: query_id and review-set scores.
    """
    profiles = materialise(
        L.retrieval_profile(listings).withColumns(
            {
                "listing_price": money.total_price(F.col("price"), F.col("shipping"), include_shipping, prefer_converted_usd),
                "total_price_currency": money.total_currency(F.col("price"), F.col("shipping"), prefer_converted_usd),
            }
        )
    )
    rows = L.query_rows(profiles, include_shipping, prefer_converted_usd, ("query_id",))
    found = R.neighbours(rows, index, retrieval, "query_id")
    context = materialise(L.listing_context(profiles, L.reranked(found, profiles, market), market))
    base = profiles.select(
        "query_id", "source_url", "title", F.col("listing_price").alias("price"), "total_price_currency",
        F.col("product_average_rating").alias("average_rating"),
        F.col("product_rating_count").cast("double").alias("rating_count"),
        *[F.lit(None).cast("double").alias(c) for c in
          ("verified_purchase_rate", "trust_probability", "ewom_score_0_to_100", "ewom_magnitude_0_to_100", "manual_peer_price")],
        money.warranty_months(F.col("item_specifics")).alias("warranty_months"),
        L.return_days(F.col("returns_json")).alias("return_window_days"),
    )
    base = base.join(
        context.select(
            "query_id", F.col("peer_price").alias("retrieved_peer_price"), "retrieval_status",
            F.col("neighbor_count").alias("retrieved_neighbor_count"),
        ),
        "query_id",
        "left",
    )
    if trust is not None:
        base = L.with_listing_trust(base, trust)
    else:
        base = base.withColumn("listing_trust_probability", F.lit(None).cast("double"))
    if review_sets is not None:
        base = U.fuse_signals(base, U.value_signals(review_sets), "query_id", include_trust=False)
    return L.listing_value(base)


def explained_pairs(pairs: DataFrame, valued: DataFrame) -> DataFrame:
    """Verdict and explanation per pair (pair_id, id_a, id_b)."""
    shown = tuple(
        c for c in ("price", "peer_price", "total_price_currency", "trust_probability", "ewom_score_0_to_100",
                    "seller_feedback_review_count", "retrieved_neighbor_count") if c in valued.columns
    )
    sides = P.pair_sides(pairs, valued, "query_id", shown)
    for side in "ab":
        for c in ("seller_feedback_review_count", "retrieved_neighbor_count"):
            if f"{side}_{c}" not in sides.columns:
                sides = sides.withColumn(f"{side}_{c}", F.lit(None).cast("bigint"))
    return X.explanations(P.pair_verdicts(sides))
