"""Worth-buying score and the good-value posterior."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, terms
from ..functions.numbers import clamp, finite, saturating
from .ordering import exact_quantiles

EVIDENCE = (
    "trust_signal", "review_polarity", "review_strength", "rating_signal", "review_volume",
    "verified_signal", "relative_price_bucket", "warranty_signal", "return_signal",
)
VALUE_INPUTS = (
    "trust_probability", "ewom_score_0_to_100", "ewom_magnitude_0_to_100", "average_rating",
    "rating_count", "verified_purchase_rate", "price", "peer_price", "warranty_months",
    "return_window_days",
)
_QUALITY_PARTS = (
    ("trust_signal", buckets.TRUST_STATES),
    ("review_polarity", buckets.POLARITY_STATES),
    ("review_strength", buckets.STRENGTH_STATES),
    ("review_volume", buckets.THREE),
    ("rating_signal", buckets.THREE),
    ("verified_signal", buckets.THREE),
)
_VALUE_PARTS = (
    ("relative_price_bucket", buckets.PRICE_STATES),
    ("warranty_signal", buckets.THREE),
    ("return_signal", buckets.THREE),
)


@dataclass(frozen=True)
class WorthConfig:
    top_k: int = 20
    price_scale: float = 0.20
    rating_prior_weight: float = 20.0
    volume_scale: float = 50.0
    vote_scale: float = 5.0
    penalty_start: float = 3.6
    penalty_per_star: float = 0.22
    price_weight: float = 0.45
    review_weight: float = 0.40
    confidence_weight: float = 0.15
    worth_threshold: float = 0.62
    consider_threshold: float = 0.48
    min_confidence: float = 0.35


def worth_buying(scored: DataFrame, rating_mean: DataFrame, cfg: WorthConfig = WorthConfig()) -> DataFrame:
    """Component scores and verdict for rows that already carry their peer columns.

    ``rating_mean`` is a one-row frame; it is read as a scalar.
    """
    mean = rating_mean.scalar()
    df = scored.withColumn("_mean", mean)
    gap = buckets.price_gap(F.col("price"), F.col("peer_price"))
    avg, n_rated = F.col("average_rating"), F.greatest(F.coalesce("rating_number", F.lit(0.0)), F.lit(0.0))
    prior = cfg.rating_prior_weight
    rating_score = clamp(
        F.coalesce((prior * F.col("_mean") + n_rated * avg) / (prior + n_rated), F.col("_mean")) / 5.0
    )
    quality = clamp(
        0.45 * clamp(F.coalesce(F.col("avg_review_rating"), avg, F.col("_mean")) / 5.0)
        + 0.25 * clamp(F.coalesce("verified_purchase_rate", F.lit(0.5)))
        + 0.15 * saturating(F.coalesce("helpful_vote_total", F.lit(0.0)), cfg.vote_scale)
        + 0.15 * saturating(F.col("review_count"), cfg.volume_scale)
    )
    confidence = clamp(
        0.45 * clamp(F.col("neighbor_count") / F.lit(float(cfg.top_k)))
        + 0.35 * clamp(F.col("average_neighbor_similarity"))
        + 0.20 * saturating(F.col("review_count"), cfg.volume_scale)
    )
    df = df.withColumns(
        {
            "price_gap_vs_peer": gap,
            "price_alignment_score": F.coalesce(
                clamp(0.5 * (1.0 + F.tanh(gap / cfg.price_scale))), F.lit(0.5)
            ),
            "bayesian_rating_score": rating_score,
            "review_quality_score": quality,
            "confidence_score": confidence,
        }
    ).drop("_mean")
    penalty = F.coalesce(
        F.greatest(F.lit(cfg.penalty_start) - avg, F.lit(0.0)) * cfg.penalty_per_star, F.lit(0.0)
    )
    score = clamp(
        cfg.price_weight * F.col("price_alignment_score")
        + cfg.review_weight * (0.55 * F.col("bayesian_rating_score") + 0.45 * F.col("review_quality_score"))
        + cfg.confidence_weight * F.col("confidence_score")
        - penalty
    )
    return df.withColumn("worth_buying_score", score).withColumn(
        "verdict",
        F.when(F.col("confidence_score") < cfg.min_confidence, "insufficient_evidence")
        .when(F.col("worth_buying_score") >= cfg.worth_threshold, "worth_buying")
        .when(F.col("worth_buying_score") >= cfg.consider_threshold, "consider")
        .otherwise("skip"),
    )


def value_evidence(df: DataFrame, default_price_bucket: Column | str | None = None) -> DataFrame:
    """Add the nine evidence buckets and the price-gap columns to rows of value inputs."""
    default = F.lit(default_price_bucket) if not isinstance(default_price_bucket, Column) else default_price_bucket
    gap = buckets.price_gap(F.col("price"), F.col("peer_price"))
    priced = buckets.price_bucket(gap)
    return df.withColumns(
        {
            "trust_signal": buckets.trust_bucket(F.col("trust_probability")),
            "review_polarity": buckets.polarity_bucket(F.col("ewom_score_0_to_100")),
            "review_strength": buckets.strength_bucket(F.col("ewom_magnitude_0_to_100")),
            "rating_signal": buckets.rating_bucket(F.col("average_rating")),
            "review_volume": buckets.volume_bucket(F.col("rating_count")),
            "verified_signal": buckets.verified_bucket(F.col("verified_purchase_rate")),
            "price_gap_vs_peer": gap,
            "relative_price_bucket": F.coalesce(priced, default.cast("string")),
            "relative_price_bucket_source": F.when(priced.isNotNull(), "peer_price").when(
                default.isNotNull(), "default"
            ),
            "warranty_signal": buckets.warranty_bucket(F.col("warranty_months")),
            "return_signal": buckets.return_bucket(F.col("return_window_days")),
        }
    )


def _kernel(x: np.ndarray) -> np.ndarray:
    """Three-state distribution around positions x on [0, 2]."""
    at = np.clip(np.asarray(x, dtype=float), 0.0, 2.0)[..., None]
    w = np.exp(-terms.KERNEL_SHARPNESS * (at - np.arange(3.0)) ** 2)
    return w / w.sum(axis=-1, keepdims=True)


def _choices(prior: tuple[float, ...]) -> np.ndarray:
    """Rows: one-hot per observed state, then the prior for 'not observed'."""
    return np.vstack([np.eye(len(prior)), np.asarray(prior)])


def posterior_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Quality table (9,216 evidence keys) and value table (128 keys) of the value network.

    Evidence is only ever observed on root nodes and the latent parents have disjoint
    ancestors, so each posterior is a product of independent marginals and can be tabulated.
    Both sizes are fixed by the network, not by the data.
    """
    p, half = terms.PRIORS, np.array([0.0, 0.5, 1.0])
    five = np.linspace(0.0, 1.0, 5)
    trust = _choices(p["trust"]) @ _kernel(2 * five)
    rw = terms.REVIEW_WEIGHTS
    review_cpt = _kernel(
        2
        * (
            rw["polarity"] * five[:, None, None]
            + rw["strength"] * half[None, :, None]
            + rw["volume"] * half[None, None, :]
        )
    )
    review = np.einsum(
        "ap,bs,cv,psvr->abcr", _choices(p["polarity"]), _choices(p["strength"]), _choices(p["volume"]), review_cpt
    )
    qw = terms.QUALITY_WEIGHTS
    quality_cpt = _kernel(
        2
        * (
            qw["trust"] * half[:, None, None, None]
            + qw["review"] * half[None, :, None, None]
            + qw["rating"] * half[None, None, :, None]
            + qw["verified"] * half[None, None, None, :]
        )
    )
    rated = np.einsum("ix,jy,trxyq->ijtrq", _choices(p["rating"]), _choices(p["verified"]), quality_cpt)
    quality = np.einsum("at,bcdr,ijtrq->abcdijq", trust, review, rated)
    rows = []
    for key, idx in enumerate(itertools.product(range(6), range(6), range(4), range(4), range(4), range(4))):
        a, b, c, d, i, j = idx
        t, r, q = trust[a], review[b, c, d], quality[idx]
        rows.append(
            (key, *q, *t, *r, *[buckets.THREE[int(np.argmax(v))] for v in (t, r, q)])
        )
    quality_df = pd.DataFrame(
        rows,
        columns=[
            "quality_key", "q_low", "q_medium", "q_high", "trustworthiness_low",
            "trustworthiness_medium", "trustworthiness_high", "review_evidence_low",
            "review_evidence_medium", "review_evidence_high", "trustworthiness_state",
            "review_evidence_state", "product_quality_state",
        ],
    )
    sw, vw = terms.SERVICE_WEIGHTS, terms.VALUE_WEIGHTS
    service = np.einsum(
        "aw,br,wrs->abs",
        _choices(p["warranty"]),
        _choices(p["returns"]),
        _kernel(2 * (sw["warranty"] * half[:, None] + sw["returns"] * half[None, :])),
    )
    level = (
        vw["quality"] * half[:, None, None]
        + vw["price"] * np.asarray(terms.PRICE_LEVELS)[None, :, None]
        + vw["service"] * half[None, None, :]
    )
    yes = 1.0 / (1.0 + np.exp(-(level - 0.5) * terms.VALUE_STEEPNESS))
    value = np.einsum("cp,abs,qps->cabq", _choices(p["price"]), service, yes)
    vrows = []
    for key, (c, a, b) in enumerate(itertools.product(range(8), range(4), range(4))):
        s = service[a, b]
        vrows.append((key, *value[c, a, b], *s, buckets.THREE[int(np.argmax(s))]))
    value_df = pd.DataFrame(
        vrows,
        columns=[
            "value_key", "g_low", "g_medium", "g_high", "service_support_low",
            "service_support_medium", "service_support_high", "service_support_state",
        ],
    )
    return spark.createDataFrame(quality_df), spark.createDataFrame(value_df)


def _state_key(parts) -> Column:
    key = F.lit(0)
    for name, states in parts:
        known = F.lit(len(states))
        code = F.coalesce(*[F.when(F.col(name) == s, F.lit(i)) for i, s in enumerate(states)], known)
        key = key * (len(states) + 1) + code
    return key.cast("bigint")


def good_value_posterior(evidence: DataFrame) -> DataFrame:
    """Posterior of good value plus the component posteriors, from the evidence buckets."""
    quality, value = posterior_tables(evidence.sparkSession)
    keyed = evidence.withColumn("quality_key", _state_key(_QUALITY_PARTS)).withColumn(
        "value_key", _state_key(_VALUE_PARTS)
    )
    out = keyed.join(F.broadcast(quality), "quality_key").join(F.broadcast(value), "value_key")
    yes = (
        F.col("q_low") * F.col("g_low")
        + F.col("q_medium") * F.col("g_medium")
        + F.col("q_high") * F.col("g_high")
    )
    return (
        out.withColumn("good_value_probability", yes)
        .withColumnsRenamed(
            {"q_low": "product_quality_low", "q_medium": "product_quality_medium", "q_high": "product_quality_high"}
        )
        .drop("quality_key", "value_key", "g_low", "g_medium", "g_high")
    )


def combined_value(
    catalog: DataFrame,
    worth: DataFrame,
    probability_threshold: float = 0.50,
    min_confidence: float = 0.35,
) -> DataFrame:
    """Retrieval scores and posterior joined on the product id, with one prediction per row."""
    peers = worth.select(
        "parent_asin", "peer_price", "confidence_score", "worth_buying_score", F.col("verdict").alias("retrieval_verdict")
    )
    joined = catalog.join(peers, "parent_asin")
    inputs = joined.withColumns(
        {
            "rating_count": F.coalesce(finite(F.col("rating_number")), F.col("review_count").cast("double")),
            "warranty_months": _optional(joined, "warranty_months"),
            "return_window_days": _optional(joined, "return_window_days"),
        }
    )
    scored = good_value_posterior(value_evidence(inputs))
    return scored.select(
        "parent_asin", "title", "price", "peer_price", "price_gap_vs_peer", "average_rating",
        "rating_number", "review_count", "verified_purchase_rate", "trust_probability",
        "ewom_score_0_to_100", "ewom_magnitude_0_to_100",
        F.col("confidence_score").alias("retrieval_confidence_score"),
        F.col("worth_buying_score").alias("retrieval_worth_buying_score"),
        "retrieval_verdict",
        F.col("good_value_probability").alias("combined_good_value_probability"),
        F.when(F.col("confidence_score") < min_confidence, "insufficient_evidence")
        .when(F.col("good_value_probability") >= probability_threshold, "good_value")
        .otherwise("not_good_value")
        .alias("combined_prediction"),
        F.col("trust_signal").alias("bayesian_evidence_trust_signal"),
        F.col("review_polarity").alias("bayesian_evidence_review_polarity"),
        F.col("review_strength").alias("bayesian_evidence_review_strength"),
        F.col("rating_signal").alias("bayesian_evidence_rating_signal"),
        F.col("review_volume").alias("bayesian_evidence_review_volume"),
        F.col("verified_signal").alias("bayesian_evidence_verified_signal"),
        F.col("relative_price_bucket").alias("bayesian_evidence_relative_price_bucket"),
        F.col("trustworthiness_state").alias("bayesian_component_trustworthiness"),
        F.col("review_evidence_state").alias("bayesian_component_review_evidence"),
        F.col("product_quality_state").alias("bayesian_component_product_quality"),
        F.col("service_support_state").alias("bayesian_component_service_support"),
    )


def _optional(df: DataFrame, name: str) -> Column:
    return finite(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def ordered_scores(df: DataFrame, first: str, second: str, key: str = "parent_asin") -> DataFrame:
    """Final order of a scored table; ties broken by id."""
    return df.orderBy(F.desc(first), F.desc(second), F.asc(key))


def verdict_summary(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))


def combined_summary(scored: DataFrame) -> DataFrame:
    """One row for a combined run: rows, rows of each prediction as a map, exact quantiles of the probability."""
    p = "combined_good_value_probability"
    kinds = scored.groupBy("combined_prediction").agg(F.count("*").alias("n"))
    counts = kinds.agg(F.sum("n").alias("rows_scored"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("combined_prediction", "n")))).alias("prediction_counts"))
    quantiles = exact_quantiles(scored.select(p), p, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(quantiles.select("*", one), "_one", "left").drop("_one")
