"""Record schemas and schema helpers (metadata only, nothing reads data here)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column name -> Spark type, in file order; ``ddl`` turns one into a reader schema.
META = {
    "parent_asin": "STRING", "title": "STRING", "store": "STRING", "main_category": "STRING",
    "categories": "ARRAY<STRING>", "features": "ARRAY<STRING>", "description": "ARRAY<STRING>",
    "details": "MAP<STRING,STRING>", "price": "STRING", "average_rating": "STRING",
    "rating_number": "STRING",
}
RAW_REVIEW = {
    "rating": "STRING", "title": "STRING", "text": "STRING", "verified_purchase": "STRING",
    "helpful_votes": "STRING", "helpful_vote": "STRING", "asin": "STRING", "parent_asin": "STRING",
    "user_id": "STRING", "timestamp": "LONG", "sort_timestamp": "LONG",
}
PREPARED_REVIEW = {
    "rating": "DOUBLE", "title": "STRING", "text": "STRING", "verified_purchase": "BOOLEAN",
    "helpful_votes": "STRING", "helpful_vote": "STRING", "label": "INT", "review_len_words": "INT",
    "asin": "STRING", "parent_asin": "STRING", "user_id": "STRING", "timestamp": "LONG",
}
PREPARED_PRODUCT = {
    "parent_asin": "STRING", "title": "STRING", "store": "STRING", "main_category": "STRING",
    "categories": "ARRAY<STRING>", "listing_kind": "STRING", "price": "STRING",
    "average_rating": "STRING", "rating_number": "STRING", "review_count": "STRING",
    "verified_purchase_rate": "STRING", "helpful_vote_total": "STRING", "helpful_vote_avg": "STRING",
    "avg_review_rating": "STRING", "trust_probability": "STRING", "ewom_score_0_to_100": "STRING",
    "ewom_magnitude_0_to_100": "STRING", "product_document": "STRING",
}
SELLER_CASES = {
    "field_name": "STRING",
    "cases": "ARRAY<STRUCT<case_id: STRING, seller_id: STRING, seller_feedback_texts: ARRAY<STRING>>>",
}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())


def with_missing_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Add each absent schema column as a typed null."""
    have = set(df.columns)
    return df.select(
        "*", *[F.lit(None).cast(kind).alias(name) for name, kind in schema.items() if name not in have]
    )


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate present in the frame, compared without case."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise ValueError(f"none of {list(candidates)} in {df.columns}")
