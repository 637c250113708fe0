"""Catalog preparation: review aggregates, proxy signals, documents, listing kinds, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.numbers import clamp, finite, hash_unit, ratio, saturating, to_bool, to_int
from ..functions.text import contains_any, join_nonblank, match_key, text_or_blank
from ..sources.schemas import PREPARED_PRODUCT, with_missing_columns

REVIEW_VOLUME_SCALE = 50.0
HELPFUL_VOTE_SCALE = 2.0
DEFAULT_RATING_MEAN = 3.8


def review_signals(reviews: DataFrame) -> DataFrame:
    """Per product: reviews, verified reviews, non-negative votes and the sum of ratings.

    A null rating adds nothing to the sum but its row still counts.
    """
    key = F.coalesce(F.nullif(text_or_blank(F.col("parent_asin")), F.lit("")), _asin(reviews))
    rows = reviews.select(
        key.alias("parent_asin"),
        to_bool(F.col("verified_purchase")).cast("int").alias("verified"),
        F.greatest(F.coalesce(finite(F.col("helpful_vote")), F.lit(0.0)), F.lit(0.0)).alias("votes"),
        F.coalesce(finite(F.col("rating")), F.lit(0.0)).alias("rating"),
    ).where(F.col("parent_asin") != "")
    return rows.groupBy("parent_asin").agg(
        F.count("*").alias("review_count"),
        F.sum("verified").alias("verified_count"),
        F.sum("votes").alias("helpful_vote_total"),
        F.sum("rating").alias("rating_sum"),
    )


def _asin(reviews: DataFrame) -> Column:
    return text_or_blank(F.col("asin")) if "asin" in reviews.columns else F.lit("")


def proxy_signals(n: Column, verified: Column, votes: Column, rating_sum: Column) -> dict[str, Column]:
    """Trust, score and magnitude proxies from the per-product review sums."""
    rate = clamp(ratio(verified, n))
    avg_rating = ratio(rating_sum, n)
    avg_votes = ratio(votes, n)
    volume = saturating(n, REVIEW_VOLUME_SCALE)
    return {
        "verified_purchase_rate": rate,
        "helpful_vote_avg": avg_votes,
        "avg_review_rating": avg_rating,
        "trust_probability": clamp(0.70 * rate + 0.30 * volume),
        "ewom_score_0_to_100": clamp((avg_rating - 1.0) / 4.0 * 100.0, 0.0, 100.0),
        "ewom_magnitude_0_to_100": F.when(
            n > 0,
            clamp(100.0 * (0.70 * volume + 0.30 * saturating(avg_votes, HELPFUL_VOTE_SCALE)), 0.0, 100.0),
        ),
    }


def product_document() -> Column:
    """Title, store, category, lists and details as one text, blank parts left out."""
    def listed(name: str) -> Column:
        return F.array_join(
            F.filter(F.transform(F.col(name), text_or_blank), lambda v: v != ""), " "
        )

    return F.trim(
        join_nonblank(
            " ",
            text_or_blank(F.col("title")),
            text_or_blank(F.col("store")),
            text_or_blank(F.col("main_category")),
            listed("categories"),
            listed("features"),
            listed("description"),
            details_text(),
        )
    )


def details_text(name: str = "details") -> Column:
    pairs = F.transform(
        F.map_entries(F.col(name)),
        lambda e: F.trim(F.concat_ws(" ", text_or_blank(e["key"]), text_or_blank(e["value"]))),
    )
    return F.coalesce(F.array_join(F.filter(pairs, lambda v: v != ""), " "), F.lit(""))


def _kind_match(text: Column, kind: str) -> Column:
    hit = contains_any(text, terms.KIND_PHRASES[kind])
    if kind == "charger":
        others = [p for p in terms.KIND_PHRASES["charger"] if p != "charger"]
        return hit & ~(text.contains("charging case") & ~contains_any(text, others))
    if kind == "case":
        return hit | text.contains("charging case")
    return hit


def with_listing_kind(
    df: DataFrame, title: Column, category_text: Column, combined_text: Column, into: str = "listing_kind"
) -> DataFrame:
    """Add the kind of a listing from its title, its categories and all of its text.

    The arguments are raw text; containment is tested on normalised text, computed once.
    """
    keyed = df.withColumns(
        {"_title": match_key(title), "_category": match_key(category_text), "_all": match_key(combined_text)}
    )
    any_other = F.lit(False)
    for kind in terms.KIND_RULE_ORDER:
        any_other = any_other | _kind_match(F.col("_title"), kind)
    out = F.when(
        ~F.concat(F.lit(" "), "_title", F.lit(" ")).contains(" for ")
        & _kind_match(F.col("_title"), "device")
        & ~any_other,
        "device",
    )
    for kind in (*terms.KIND_RULE_ORDER, "device"):
        hint = contains_any(F.col("_category"), terms.KIND_CATEGORY_HINTS.get(kind, ()))
        out = out.when(hint | _kind_match(F.col("_all"), kind), kind)
    return keyed.withColumn(into, out.otherwise("other")).drop("_title", "_category", "_all")


def with_meta_listing_kind(meta: DataFrame, into: str = "listing_kind") -> DataFrame:
    def joined(name: str) -> Column:
        return F.coalesce(F.array_join(F.col(name), " "), F.lit(""))

    combined = join_nonblank(
        " ",
        F.coalesce(F.col("title"), F.lit("")),
        F.coalesce(F.col("main_category"), F.lit("")),
        joined("categories"),
        joined("features"),
        joined("description"),
        details_text(),
    )
    return with_listing_kind(meta, F.col("title"), joined("categories"), combined, into)


def normalized_kind(kind: Column) -> Column:
    key = match_key(kind)
    return F.when(key.isin(*terms.LISTING_KINDS), key).otherwise("other")


def product_records(meta: DataFrame, signals: DataFrame) -> DataFrame:
    """Catalog rows with review aggregates and proxies; products without reviews get zeros."""
    if "listing_kind" not in meta.columns:
        meta = with_meta_listing_kind(meta)
    left = meta.withColumn("parent_asin", text_or_blank(F.col("parent_asin"))).where(
        F.col("parent_asin") != ""
    )
    joined = left.join(signals, "parent_asin", "left")
    n = F.coalesce(F.col("review_count"), F.lit(0))
    votes = F.coalesce(F.col("helpful_vote_total"), F.lit(0.0))
    proxies = proxy_signals(n, F.coalesce("verified_count", F.lit(0)), votes, F.coalesce("rating_sum", F.lit(0.0)))
    return joined.select(
        "parent_asin",
        text_or_blank(F.col("title")).alias("title"),
        text_or_blank(F.col("store")).alias("store"),
        text_or_blank(F.col("main_category")).alias("main_category"),
        "categories",
        "listing_kind",
        finite(F.col("price")).alias("price"),
        finite(F.col("average_rating")).alias("average_rating"),
        finite(F.col("rating_number")).alias("rating_number"),
        n.cast("bigint").alias("review_count"),
        proxies["verified_purchase_rate"].alias("verified_purchase_rate"),
        votes.cast("bigint").alias("helpful_vote_total"),
        *[proxies[c].alias(c) for c in list(proxies)[1:]],
        (F.col("product_document") if "product_document" in meta.columns else product_document()).alias(
            "product_document"
        ),
    )


def hash_split(key: Column, seed: int = 42, validation_ratio: float = 0.10, test_ratio: float = 0.10) -> Column:
    """test, then val, then train, by the key's position in the unit interval."""
    u = hash_unit(seed, key)
    return F.when(u < test_ratio, "test").when(u < test_ratio + validation_ratio, "val").otherwise("train")


def split_summary(products: DataFrame) -> DataFrame:
    """Rows, priced rows and reviewed rows per split, with a total row."""
    return (
        products.rollup("split")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("price").isNotNull()).alias("rows_with_price"),
            F.count_if(F.col("review_count") > 0).alias("rows_with_reviews"),
        )
        .withColumn("split", F.coalesce("split", F.lit("all")))
    )


def normalise_catalog(frame: DataFrame) -> DataFrame:
    """Fixed text and number columns; kinds outside the vocabulary are inferred again."""
    df = with_missing_columns(frame, PREPARED_PRODUCT)
    texts = ("parent_asin", "title", "store", "main_category", "product_document")
    numbers = (
        "price", "average_rating", "rating_number", "verified_purchase_rate", "helpful_vote_total",
        "helpful_vote_avg", "avg_review_rating", "trust_probability", "ewom_score_0_to_100",
        "ewom_magnitude_0_to_100",
    )
    categories = F.coalesce(F.array_join("categories", " "), F.lit(""))
    combined = join_nonblank(
        " ",
        F.coalesce("title", F.lit("")),
        F.coalesce("main_category", F.lit("")),
        categories,
        F.coalesce("product_document", F.lit("")),
    )
    df = df.withColumn("_given", normalized_kind(F.col("listing_kind")))
    df = with_listing_kind(df, F.col("title"), categories, combined, "_inferred")
    return df.select(
        *[text_or_blank(F.col(c)).alias(c) for c in texts],
        F.when(F.col("_given") == "other", F.col("_inferred")).otherwise(F.col("_given")).alias("listing_kind"),
        *[finite(F.col(c)).alias(c) for c in numbers],
        F.coalesce(to_int(F.col("review_count")), F.lit(0)).alias("review_count"),
    )


def allowed_kinds(value: str | Sequence[str] | None) -> list[str] | None:
    """Known kinds other than 'other' from a comma list or a sequence; None means no filter."""
    if value is None:
        return None
    raw = value.split(",") if isinstance(value, str) else value
    wanted = [" ".join(str(v).lower().replace("-", " ").split()) for v in raw]
    return [k for k in dict.fromkeys(wanted) if k in terms.LISTING_KINDS and k != "other"] or None


def priced_catalog(catalog: DataFrame, kinds: str | Sequence[str] | None = None) -> DataFrame:
    """Rows that can serve as peers: priced and of an allowed kind."""
    out = catalog.where(F.col("price").isNotNull())
    allowed = allowed_kinds(kinds)
    return out if allowed is None else out.where(F.col("listing_kind").isin(*allowed))


def global_rating_mean(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.coalesce(F.avg("average_rating"), F.lit(DEFAULT_RATING_MEAN)).alias("global_rating_mean")
    )


def prepared_summary(products: DataFrame) -> DataFrame:
    """Rows, priced and reviewed rows and their rates by split and kind, by split, by kind and in all, in one pass."""
    priced, reviewed = F.col("price").isNotNull(), F.coalesce(F.col("review_count") > 0, F.lit(False))
    return products.groupingSets([["split", "listing_kind"], ["split"], ["listing_kind"], []], "split", "listing_kind").agg(
        F.when((F.grouping("split") == 0) & (F.grouping("listing_kind") == 0), "split_kind").when(F.grouping("split") == 0, "split")
        .when(F.grouping("listing_kind") == 0, "kind").otherwise("all").alias("level"),
        F.count("*").alias("rows"),
        F.count_if(priced).alias("rows_with_price"),
        F.count_if(reviewed).alias("rows_with_reviews"),
        F.avg(priced.cast("double")).alias("priced_rate"),
        F.avg(reviewed.cast("double")).alias("reviewed_rate"),
    )
