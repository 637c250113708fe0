"""Trust labels: annotate what is pending, log it, train on truth, apply to products."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import textmodels as M
from ..operators import trust as T
from ..sources import writers as K


def annotate_and_log(
    frame: DataFrame, log_path: str, batch_seq: int, annotator: Callable[[Sequence[str]], Sequence[str]],
    key: str, text: str, domain: str, max_calls: int | None = None,
) -> DataFrame:
    """Annotate rows without a valid label, append the answers, and return the labelled rows."""
    spark = frame.sparkSession
    todo = T.pending_rows(frame, K.read_labels(spark, log_path), key, text, max_calls)
    K.append_labels(T.annotate(todo, annotator, key, text).withColumn("domain", F.lit(domain)), log_path, batch_seq)
    return T.labelled_rows(frame, K.read_labels(spark, log_path), key)


def applied(models: M.TrustModels, products: DataFrame) -> DataFrame:
    """Scores of fitted trust models on labelled products, in consumer-facing form."""
    logistic = models.logistic
    scored = T.trust_scores(products, models.graph, list(logistic.coefficients), logistic.intercept)
    return T.normalised_trust(scored.withColumn("status", F.lit("ok")))
