"""Review fusion: helpfulness, sentiment and deception of single reviews to a product signal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, ratio, sigmoid


@dataclass(frozen=True)
class FusionConfig:
    gate_center: float = 0.5
    gate_sharpness: float = 8.0
    set_gate_scale: float = 3.0


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def review_fusion(reviews: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Score every review; an unknown deception probability counts as fully trusted."""
    pos = F.greatest(F.col("positive_probability"), F.lit(0.0))
    neg = F.greatest(F.col("negative_probability"), F.lit(0.0))
    both = pos + neg
    step = reviews.withColumns(
        {
            "usefulness_probability": clamp(F.col("usefulness_probability")),
            "deception_probability": clamp(_optional(reviews, "deception_probability")),
            "positive_probability": F.when(both > 0, clamp(pos / F.nullif(both, F.lit(0.0)))).otherwise(0.5),
            "negative_probability": F.when(both > 0, clamp(neg / F.nullif(both, F.lit(0.0)))).otherwise(0.5),
        }
    )
    step = step.withColumns(
        {
            "helpfulness_gate": sigmoid(cfg.gate_sharpness * (F.col("usefulness_probability") - cfg.gate_center)),
            "deception_weight": F.coalesce(1.0 - F.col("deception_probability"), F.lit(1.0)),
            "sentiment_polarity": F.col("positive_probability") - F.col("negative_probability"),
        }
    )
    step = step.withColumns(
        {
            "informative_gate": F.col("helpfulness_gate") * F.col("deception_weight"),
            "sentiment_strength": F.abs("sentiment_polarity"),
        }
    )
    return step.withColumns(
        {
            "signed_ewom_score": F.col("informative_gate") * F.col("sentiment_polarity"),
            "magnitude_ewom_score": F.col("informative_gate") * F.col("sentiment_strength"),
            "ewom_score_0_to_100": 50.0 * (F.col("informative_gate") * F.col("sentiment_polarity") + 1.0),
            "ewom_magnitude_0_to_100": 100.0 * F.col("informative_gate") * F.col("sentiment_strength"),
        }
    )


def review_set_scores(scored: DataFrame, keys: list[str], cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Fuse scored reviews per product; weak reviews cannot add up to false confidence."""
    deception = clamp(_optional(scored, "deception_probability"))
    weight = clamp(
        F.coalesce(_optional(scored, "deception_weight"), 1.0 - deception, F.lit(1.0))
    )
    gate = clamp(F.coalesce(_optional(scored, "informative_gate"), clamp(F.col("helpfulness_gate")) * weight))
    rows = scored.select(
        *keys,
        clamp(F.col("usefulness_probability")).alias("u"),
        clamp(F.col("helpfulness_gate")).alias("h"),
        deception.alias("d"),
        weight.alias("w"),
        gate.alias("g"),
        clamp(F.col("positive_probability")).alias("pos"),
        clamp(F.col("negative_probability")).alias("neg"),
        clamp(F.col("sentiment_polarity"), -1.0, 1.0).alias("pol"),
        clamp(F.col("sentiment_strength")).alias("strength"),
    )

    def weighted(name: str) -> Column:
        return F.sum(F.col("g") * F.col(name)).alias(f"_{name}")

    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("review_count"),
        F.sum("g").alias("informative_review_weight"),
        F.avg("u").alias("mean_usefulness_probability"),
        F.avg("h").alias("mean_helpfulness_gate"),
        F.avg("d").alias("mean_deception_probability"),
        F.avg("w").alias("mean_deception_weight"),
        F.avg("g").alias("mean_informative_gate"),
        *[weighted(n) for n in ("pos", "neg", "pol", "strength")],
    )
    total = F.col("informative_review_weight")
    names = {"pos": ("positive_probability", 0.5), "neg": ("negative_probability", 0.5),
             "pol": ("sentiment_polarity", 0.0), "strength": ("sentiment_strength", 0.0)}
    agg = agg.withColumns(
        {
            f"weighted_{name}": F.when(total > 0, ratio(F.col(f"_{k}"), total)).otherwise(empty)
            for k, (name, empty) in names.items()
        }
    ).drop(*[f"_{k}" for k in names])
    set_gate = 1.0 - F.exp(-total / cfg.set_gate_scale)
    agg = agg.withColumn("review_set_gate", set_gate)
    agg = agg.withColumns(
        {
            "final_signed_ewom_score": F.col("review_set_gate") * F.col("weighted_sentiment_polarity"),
            "final_magnitude_ewom_score": F.col("review_set_gate") * F.col("weighted_sentiment_strength"),
        }
    )
    return agg.withColumns(
        {
            "final_ewom_score_0_to_100": 50.0 * (F.col("final_signed_ewom_score") + 1.0),
            "final_ewom_magnitude_0_to_100": 100.0 * F.col("final_magnitude_ewom_score"),
        }
    )


def value_signals(review_sets: DataFrame, review_trust: Column | None = None) -> DataFrame:
    """Review-set scores as value-model inputs; trust stays null when nothing is known.

    ``review_trust`` is an optional fallback column: the mean trust of the single reviews.
    """
    fallback = review_trust if review_trust is not None else F.lit(None).cast("double")
    return review_sets.withColumns(
        {
            "trust_probability": F.coalesce(clamp(1.0 - F.col("mean_deception_probability")), fallback),
            "ewom_score_0_to_100": F.col("final_ewom_score_0_to_100"),
            "ewom_magnitude_0_to_100": F.col("final_ewom_magnitude_0_to_100"),
        }
    )


def fuse_signals(base: DataFrame, signals: DataFrame, key: str, include_trust: bool = True) -> DataFrame:
    """Overlay review signals on value inputs where the signal is known."""
    names = ["ewom_score_0_to_100", "ewom_magnitude_0_to_100"] + (["trust_probability"] if include_trust else [])
    side = signals.select(key, F.col("review_count").alias("seller_feedback_review_count"),
                          *[F.col(n).alias(f"_{n}") for n in names])
    joined = base.join(side, key, "left")
    return joined.withColumns({n: F.coalesce(F.col(f"_{n}"), F.col(n)) for n in names}).drop(
        *[f"_{n}" for n in names]
    )
