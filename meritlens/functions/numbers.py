"""Numeric coercion, bounded maths and hashing to the unit interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_64 = 18446744073709551616.0


def finite(c: Column) -> Column:
    """Double with NaN and infinities turned to null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def to_int(c: Column) -> Column:
    """Integer by truncation of a finite number, else null."""
    return finite(c).try_cast("bigint")


def to_bool(c: Column) -> Column:
    """Truth of a flag given as text; unknown non-blank text counts as true, null as false."""
    key = F.lower(F.trim(c.cast("string")))
    return (
        F.when(key.isNull(), F.lit(False))
        .when(key.isin("true", "1", "yes", "y"), F.lit(True))
        .when(key.isin("false", "0", "no", "n", ""), F.lit(False))
        .otherwise(F.lit(True))
    )


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bound a value; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def saturating(c: Column, scale: float) -> Column:
    """1 - exp(-c / scale) on the non-negative part of c."""
    return F.lit(1.0) - F.exp(-F.greatest(c.cast("double"), F.lit(0.0)) / F.lit(scale))


def sigmoid(c: Column) -> Column:
    e = F.exp(-F.abs(c))
    return F.when(c >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def entropy_bits(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def hash_unit(seed: int | str, key: Column) -> Column:
    """Deterministic number in [0, 1) from sha256('seed:key'); independent of partitioning."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.trim(key.cast("string"))), 256)
    return F.conv(F.substr(digest, F.lit(1), F.lit(16)), 16, 10).cast("double") / F.lit(TWO_POW_64)


def three_way(c: Column) -> Column:
    """Score bucket low / medium / high at one and two thirds."""
    return F.when(c < 1.0 / 3.0, "low").when(c < 2.0 / 3.0, "medium").when(c.isNotNull(), "high")
