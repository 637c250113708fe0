"""Global order statistics without a one-task window.

Each helper cuts the order into pieces of about PIECE_ROWS rows, sums the pieces, and only orders
rows inside a piece, so no task ever holds more than one piece of one group. The number of pieces
follows the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: About so many rows are ordered by one task.
PIECE_ROWS = 100_000


def with_piece(df: DataFrame, *order: str, piece_rows: int = PIECE_ROWS, into: str = "_piece") -> DataFrame:
    """Add the number of the range that a row falls into, of as many ranges of ``order`` as the rows need.

    Spark samples the bounds. Rows equal in all order columns share a piece, so name a key behind a
    value that many rows share. The frame is written once and, if it needs several pieces, once more.
    """
    stored = materialise(df)
    pieces = -(-stored.count() // piece_rows)
    if pieces <= 1:
        return stored.withColumn(into, F.lit(0))
    return materialise(stored.repartitionByRange(pieces, *order).withColumn(into, F.spark_partition_id()))


def with_hash_piece(df: DataFrame, unit: str, pieces: int | None = None, piece_rows: int = PIECE_ROWS, into: str = "_piece") -> DataFrame:
    """Same cut for a column uniform on [0, 1), by arithmetic; without ``pieces`` their number comes from a count."""
    if pieces is None:
        pieces = max(1, -(-df.count() // piece_rows))
    return df.withColumn(into, F.floor(F.col(unit) * pieces).cast("int"))


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    groups: Sequence[str] = (),
    piece: str = "_piece",
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums in ``order`` inside each group.

    ``piece`` must be monotone in the leading order expression. ``totals`` names extra columns
    holding the group total of a sum (``{"n": "running_n"}``).
    """
    groups = list(groups)
    parts = df.groupBy(*groups, piece).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*groups).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    keep = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    for name, source in (totals or {}).items():
        keep.append(F.sum(f"_s_{source}").over(whole).alias(name))
    offsets = parts.select(*groups, piece, *keep)
    inside = (
        Window.partitionBy(*groups, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = df.join(offsets, groups + [piece], "inner")
    for name, expr in sums.items():
        joined = joined.withColumn(name, F.sum(expr).over(inside) + F.col(f"_o_{name}"))
    return joined.drop(piece, *[f"_o_{n}" for n in sums])


def hash_ranked(
    df: DataFrame,
    unit: str,
    key: str,
    groups: Sequence[str] = (),
    into: str = "rank",
    total: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Row number by (unit, key) inside each group, for a hash column uniform on [0, 1)."""
    cut = with_hash_piece(df, unit, pieces)
    return running_totals(
        cut,
        [F.col(unit), F.col(key)],
        {into: F.lit(1).cast("bigint")},
        groups,
        totals={total: into} if total else None,
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    names: dict[str, float],
    groups: Sequence[str] = (),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact, from counts of distinct values."""
    groups = list(groups)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c"))
    cum = running_totals(
        with_piece(counts, value, *groups, piece_rows=piece_rows),
        [F.col(value)],
        {"_cum": F.col("_c")},
        groups,
        totals={"_n": "_cum"},
    )
    aggs = []
    v = F.col(value).cast("double")
    for name, q in names.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        for side, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            covers = (F.col("_cum") - F.col("_c") <= pos) & (pos < F.col("_cum"))
            aggs.append(F.max(F.when(covers, v)).alias(f"_{side}_{name}"))
    aggs.append(F.max("_n").alias("_n"))
    wide = cum.groupBy(*groups).agg(*aggs)
    out = list(groups)
    for name, q in names.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        out.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))).alias(name)
        )
    return wide.select(*out)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, into: str = "rank") -> DataFrame:
    """First n rows per group; Spark applies the limit before the shuffle as well."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(into, F.row_number().over(w)).where(F.col(into) <= n)
