"""Column profiles and class-wise term lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import WORD
from .ordering import exact_quantiles, top_per_group

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Type, null counts, distinct values, sample values and number statistics per column.

    Values are counted per (column, value) first, so wide columns spread over all tasks.
    """
    types = dict(df.dtypes)
    names = [c for c in df.columns if not types[c].startswith(("array", "map", "struct"))]
    text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    counts = text.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    base = counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
    )
    shown = top_per_group(counts.where(F.col("value").isNotNull()), ["column"], [F.asc("value")], samples)
    shown = shown.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("sample_values"))
    dtype = F.coalesce(*[F.when(F.col("column") == c, F.lit(types[c])) for c in names])
    out = base.join(shown, "column", "left").withColumns(
        {
            "dtype": dtype,
            "null_pct": F.round(100.0 * F.col("null_count") / (F.col("null_count") + F.col("non_null_count")), 2),
        }
    )
    numbers = [c for c in names if types[c].startswith(NUMERIC)]
    if not numbers:
        return out
    long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column", "number")
    stats = long.groupBy("column").agg(
        F.avg("number").alias("mean"), F.stddev_samp("number").alias("std"), F.min("number").alias("min"), F.max("number").alias("max")
    )
    quartiles = exact_quantiles(long, "number", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"])
    return out.join(stats.join(quartiles, "column"), "column", "left")


def top_terms(rows: DataFrame, label: str, text: str, n: int = 1, min_df: int = 5, top: int = 15,
              stop_words: Sequence[str] = terms.ENGLISH_STOP) -> DataFrame:
    """Most frequent n-grams (n = 1 or 2) per class that occur in min_df texts or more."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*stop_words))
    if n == 2:
        m = F.greatest(F.size(words) - 1, F.lit(0))
        words = F.zip_with(F.slice(words, F.lit(1), m), F.slice(words, F.lit(2), m), lambda a, b: F.concat_ws(" ", a, b))
    # Terms of a text in order: where one differs from the term before it, the text counts as a document of it.
    ordered = rows.select(label, F.array_sort(words).alias("_terms"))
    new = lambda i: (i == 0) | (F.col("_terms")[i - 1] != F.col("_terms")[i])
    marked = ordered.select(label, F.explode(F.transform("_terms", lambda w, i: F.struct(w.alias("term"), new(i).cast("int").alias("text")))).alias("x"))
    kept = marked.groupBy(label, F.col("x.term").alias("term")).agg(F.count("*").alias("count"), F.sum("x.text").alias("df")).where(F.col("df") >= min_df)
    return top_per_group(kept, [label], [F.desc("count"), F.asc("term")], top).select(label, "term", "count", "rank")
