"""Review preparation, text features and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite, to_bool, to_int
from ..functions.text import clean, strip, word_count
from .ordering import top_per_group


def prepare_reviews(
    reviews: DataFrame, positive_threshold: int = 1, drop_middle: bool = False, min_review_words: int = 0
) -> DataFrame:
    """Coerced fields, word count and the helpful label; short or undecided rows dropped."""
    votes = F.coalesce(to_int(F.col("helpful_votes")), F.lit(0))
    out = reviews.withColumns(
        {
            "rating": finite(F.col("rating")),
            "title": F.coalesce("title", F.lit("")),
            "text": F.coalesce("text", F.lit("")),
            "verified_purchase": to_bool(F.col("verified_purchase")),
            "helpful_votes": votes,
            "review_len_words": word_count(F.col("text")),
        }
    )
    if drop_middle:
        out = out.where(~((F.col("helpful_votes") > 0) & (F.col("helpful_votes") < positive_threshold)))
    return out.where(F.col("review_len_words") >= min_review_words).withColumn(
        "label", (F.col("helpful_votes") >= positive_threshold).cast("int")
    )


def relabel(rows: DataFrame, positive_threshold: int) -> DataFrame:
    """Label from the raw votes where a row has them, else its stored label.

    A row with neither fails the job, as an unlabelled row would poison every later count.
    """
    votes = F.coalesce(to_int(F.col("helpful_votes")), to_int(F.col("helpful_vote")))
    label = F.coalesce((votes >= positive_threshold).cast("int"), F.col("label").cast("int"))
    return rows.withColumn("helpful_votes", votes).withColumn(
        "label",
        F.coalesce(label, F.raise_error(F.lit("a prepared review has neither votes nor a label")).cast("int")),
    )


def review_features(rows: DataFrame) -> DataFrame:
    """Cleaned text columns and the length features of the helpfulness model."""
    title, text = clean(F.col("title")), clean(F.col("text"))
    out = rows.withColumns({"title": title, "text": text})
    return out.withColumns(
        {
            "combined_text": F.trim(F.concat_ws(" ", "title", "text")),
            "rating": F.coalesce(finite(F.col("rating")), F.lit(0.0)),
            "verified_purchase": to_bool(F.col("verified_purchase")),
            "review_len_words": word_count(F.col("text")).cast("double"),
            "title_len_chars": F.length("title").cast("double"),
            "text_len_chars": F.length("text").cast("double"),
        }
    )


def sentiment_text(c: Column) -> Column:
    return F.lower(clean(c))


def validated_reviews(rows: DataFrame) -> DataFrame:
    """Trimmed payload columns plus ``reject_reason`` (null for a valid review)."""
    text = strip(F.coalesce("text", F.lit("")))
    rating = F.coalesce("rating", F.lit("0.0")).try_cast("double")
    flag_key = F.lower(F.trim(F.coalesce("verified_purchase", F.lit("false"))))
    flag = F.when(flag_key.isin("true", "1", "yes"), F.lit(True)).when(
        flag_key.isin("false", "0", "no"), F.lit(False)
    )
    return rows.withColumns(
        {
            "text": text,
            "title": F.coalesce("title", F.lit("")),
            "rating_value": rating,
            "verified_flag": flag,
            "reject_reason": F.when(text == "", "empty_text")
            .when(rating.isNull(), "rating_not_numeric")
            .when(flag.isNull(), "flag_not_boolean"),
        }
    )


def accepted_and_rejected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validated_reviews(rows)
    return checked.where(F.col("reject_reason").isNull()), checked.where(F.col("reject_reason").isNotNull())


def first_examples(rows: DataFrame, label: str, order: str, n: int = 3) -> DataFrame:
    return top_per_group(rows, [label], [F.asc(order)], n)


def feedback_texts(entries: DataFrame, limit: int = 10) -> DataFrame:
    """First buyer comments per seller in feed order, as one short list."""
    kept = entries.where(
        (F.col("provider_role").isNull() | (F.col("provider_role") == "BUYER"))
        & ~F.coalesce("removed", F.lit(False))
        & (F.coalesce("comment_text", F.lit("")) != "")
    )
    ranked = top_per_group(kept, ["seller_id"], [F.asc("seq")], limit)
    return ranked.groupBy("seller_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "comment_text"))), lambda e: e["comment_text"]
        ).alias("seller_feedback_texts")
    )


def seller_case_texts(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested case file to one row per text, and the cases that have no text."""
    rows = cases.select(F.explode("cases").alias("c")).select("c.*")
    empty = F.coalesce(F.size("seller_feedback_texts"), F.lit(0)) <= 0
    texts = rows.where(~empty).select(
        "case_id", "seller_id", F.posexplode("seller_feedback_texts").alias("seq", "text")
    )
    return texts, rows.where(empty).select("case_id", "seller_id")


def length_columns(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumns({"word_len": word_count(F.col(text)), "char_len": F.length(text)})


def label_balance(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.round(F.avg((F.col(label) == 1).cast("double")) * 100, 2).alias("positive_pct"),
        F.round(F.avg((F.col(label) == 0).cast("double")) * 100, 2).alias("negative_pct"),
    )
