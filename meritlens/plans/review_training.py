"""Review classifiers: prepare, split by quota, fit candidates, select, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reviews as W
from ..operators import sampling as S
from ..operators import textmodels as M
from ..operators.evaluate import auc_ap, binary_metrics
from ..session import materialise


def prepared_splits(
    reviews: DataFrame, key: str, positive_threshold: int = 1, validation_size: float = 0.1, test_size: float = 0.1,
    balance: bool = True, balanced_total: int | None = None, seed: int = 42,
) -> DataFrame:
    rows = materialise(W.prepare_reviews(reviews, positive_threshold))
    plan = S.quota_plan(S.label_counts(rows, "label"), validation_size, test_size, balance, balanced_total)
    return S.quota_assignment(rows, "label", key, plan, seed)


def train_helpfulness(splits: DataFrame, key: str, cfg: M.TextFeatureConfig | None = None) -> dict:
    """Fitted features and best candidate with its threshold; metrics of the validation and test split."""
    cfg = cfg or M.TextFeatureConfig(numeric=M.LENGTHS)
    docs = materialise(
        W.review_features(splits).select(
            F.col(key).alias("doc_id"), F.col("combined_text").alias("text"), "label", "split", *M.LENGTHS
        )
    )
    features = M.TextFeatures.fit(docs.where("split = 'train'"), cfg)
    rows = materialise(features.transform(docs))
    models = M.fit_candidates(rows.where("split = 'train'"))
    tuned = materialise(M.compare_candidates(materialise(M.predictions(models, rows.where("split = 'val'")))))
    best = M.select_candidate(tuned).select("model", "threshold").first()
    held = M.predictions({best["model"]: models[best["model"]]}, rows.where("split = 'test'"))
    test = binary_metrics(held, "label", "p", best["threshold"], ["model"]).join(
        auc_ap(held, "label", "p", ["model"]), "model"
    )
    return {
        "features": features, "model": models[best["model"]], "name": best["model"], "threshold": best["threshold"],
        "candidates": tuned, "test_metrics": test,
    }
