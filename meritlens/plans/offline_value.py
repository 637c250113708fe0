"""Offline value scoring: prepared splits, retrieval index, scores and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import retrieval as R
from ..operators import value as V


def prepare_catalog(
    meta: DataFrame, reviews: DataFrame, seed: int = 42, validation_ratio: float = 0.10, test_ratio: float = 0.10
) -> DataFrame:
    """Products with review signals and their split; write it before use (``write_splits``)."""
    if not 0 < validation_ratio < 1 or not 0 < test_ratio < 1 or validation_ratio + test_ratio >= 1:
        raise ValueError("split ratios must be positive and leave room for training rows")
    products = C.product_records(meta, C.review_signals(reviews))
    return products.withColumn("split", C.hash_split(F.col("parent_asin"), seed, validation_ratio, test_ratio))


def worth_scores(queries: DataFrame, index: R.RetrievalIndex, worth: V.WorthConfig = V.WorthConfig()) -> DataFrame:
    context = R.market_context(queries, R.neighbours(queries, index))
    return V.worth_buying(context, index.rating_mean, worth)


def combined_predictions(queries: DataFrame, index: R.RetrievalIndex, probability_threshold: float = 0.50) -> DataFrame:
    """Final table, best value first."""
    out = V.combined_value(queries, worth_scores(queries, index), probability_threshold)
    return V.ordered_scores(out, "combined_good_value_probability", "retrieval_confidence_score")
