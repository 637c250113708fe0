"""Review sums and the label log over unbounded input.

Both keep state that is associative per key. The batch operators are the reference; a stream
that has read the same rows ends with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.catalog import review_signals
from ..operators.trust import latest_labels


def streaming_review_signals(reviews: DataFrame) -> DataFrame:
    """Running sums per product; write in update or complete mode."""
    return review_signals(reviews)


def streaming_latest_labels(log: DataFrame) -> DataFrame:
    """Last valid label per id so far; write in update or complete mode."""
    return latest_labels(log)
