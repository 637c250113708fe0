"""Evidence bucketing: each numeric input of the value model to a named state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

THREE = ("low", "medium", "high")
TRUST_STATES = ("very_low", "low", "medium", "high", "very_high")
POLARITY_STATES = ("very_negative", "negative", "mixed", "positive", "very_positive")
STRENGTH_STATES = ("weak", "medium", "strong")
PRICE_STATES = (
    "extreme_pricier",
    "much_pricier",
    "pricier",
    "fair",
    "cheaper",
    "much_cheaper",
    "extreme_cheaper",
)


def _steps(c: Column, edges: Sequence[float], states: Sequence[str], inclusive: bool = False) -> Column:
    out = None
    for edge, state in zip(edges, states):
        test = (c <= edge) if inclusive else (c < edge)
        out = F.when(test, state) if out is None else out.when(test, state)
    return out.when(c.isNotNull(), states[-1])


def trust_bucket(c: Column) -> Column:
    return _steps(c, (0.20, 0.40, 0.60, 0.82), TRUST_STATES)


def polarity_bucket(c: Column) -> Column:
    return _steps(c, (20.0, 40.0, 60.0, 80.0), POLARITY_STATES)


def strength_bucket(c: Column) -> Column:
    return _steps(c, (25.0, 60.0), STRENGTH_STATES)


def rating_bucket(c: Column) -> Column:
    return _steps(c, (3.6, 4.3), THREE)


def volume_bucket(c: Column) -> Column:
    return _steps(c, (20.0, 200.0), THREE)


def verified_bucket(c: Column) -> Column:
    return _steps(c, (0.50, 0.80), THREE)


def warranty_bucket(c: Column) -> Column:
    return _steps(c, (0.0, 12.0), THREE, inclusive=True)


def return_bucket(c: Column) -> Column:
    return _steps(c, (7.0, 30.0), THREE, inclusive=True)


def price_gap(price: Column, peer_price: Column) -> Column:
    """Relative saving against the peer price; null unless both known and peer positive."""
    return F.when(peer_price > 0, (peer_price - price) / peer_price)


def price_bucket(gap: Column) -> Column:
    return (
        F.when(gap > 0.40, "extreme_cheaper")
        .when(gap > 0.20, "much_cheaper")
        .when(gap > 0.05, "cheaper")
        .when(gap >= -0.05, "fair")
        .when(gap >= -0.20, "pricier")
        .when(gap >= -0.40, "much_pricier")
        .when(gap.isNotNull(), "extreme_pricier")
    )
