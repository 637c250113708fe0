"""Listing normalisation, retrieval profile, neighbour rerank and listing value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, terms
from ..functions.numbers import finite
from ..functions.text import (
    clean, contains_any, join_nonblank, match_key, string_array, strip, text_or_blank, tokens,
)
from .catalog import with_listing_kind
from .ordering import top_per_group
from .value import good_value_posterior, value_evidence

NEUTRAL_BUCKET = "fair"
USABLE = "usable"
NO_PRICE_NOTE = (
    "Too little trustworthy price data of similar items was found; the score uses a neutral "
    "price and leaves price advantage out."
)


@dataclass(frozen=True)
class MarketConfig:
    top_n: int = 5
    min_match_score: float = 0.24
    min_price_ratio: float = 0.18
    min_neighbours: int = 3
    small_price: float = 40.0


RAW_ITEM = (
    "itemId STRING, title STRING, condition STRING, "
    "price STRUCT<value: STRING, currency: STRING, convertedFromValue: STRING, convertedFromCurrency: STRING>, "
    "seller STRUCT<username: STRING, sellerId: STRING, userId: STRING, feedbackScore: BIGINT, feedbackPercentage: STRING>, "
    "shippingOptions ARRAY<STRUCT<shippingCostType: STRING, shippingCost: STRUCT<value: STRING, currency: STRING, "
    "convertedFromValue: STRING, convertedFromCurrency: STRING>>>, "
    "returnTerms STRING, returns STRING, returnPolicy STRING, averageRating STRING, reviewCount STRING, "
    "shortDescription STRING, subtitle STRING, description STRING, longDescription STRING, productDescription STRING, "
    "localizedAspects ARRAY<STRUCT<name: STRING, value: STRING>>, "
    "product STRUCT<epid: STRING, averageRating: STRING, reviewCount: STRING, description: STRING, "
    "shortDescription: STRING, longDescription: STRING, subtitle: STRING, productDescription: STRING, "
    "aspectGroups: ARRAY<STRUCT<aspects: ARRAY<STRUCT<name: STRING, values: STRING>>>>>"
)


def url_parts(df: DataFrame, url: str) -> DataFrame:
    """Page type and ids of a marketplace URL."""
    shape = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?"
    step = df.withColumns(
        {"_path": F.regexp_extract(url, shape, 1), "_query": F.regexp_extract(url, shape, 2)}
    )
    item = F.nullif(F.regexp_extract("_path", r"/itm/(\d+)", 1), F.lit(""))
    epid = F.nullif(F.regexp_extract("_path", r"/p/(\d+)", 1), F.lit(""))
    iid = F.nullif(F.regexp_extract("_query", r"(?:^|&)iid=([^&]+)", 1), F.lit(""))
    product_page = item.isNull() & epid.isNotNull()
    return step.withColumns(
        {
            "page_type": F.when(item.isNotNull(), "listing").when(product_page, "product_page").otherwise("unknown"),
            "legacy_item_id": F.when(product_page, iid).otherwise(item),
            "epid": F.when(product_page, epid),
        }
    ).drop("_path", "_query")


def _text_list(raw: Column) -> Column:
    """A JSON field that holds one text or a list of texts, as a list."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def _specific_lines(specifics: Column) -> Column:
    """'Name: a, b' per entry with a value, in entry order."""
    lines = F.transform(
        F.map_entries(specifics),
        lambda e: F.concat(
            strip(e["key"]),
            F.lit(": "),
            F.array_join(F.filter(F.transform(e["value"], text_or_blank), lambda v: v != ""), ", "),
        ),
    )
    return F.coalesce(F.filter(lines, lambda v: ~v.endswith(": ")), F.array().cast("array<string>"))


def _deduped(lines: Column) -> Column:
    """Collapsed, non-blank lines; the first of lines equal without case is kept."""
    tidy = F.filter(F.transform(lines, clean), lambda v: v != "")
    return F.filter(
        F.transform(
            tidy,
            lambda v, i: F.when(
                F.exists(F.slice(tidy, F.lit(1), i), lambda earlier: F.lower(earlier) == F.lower(v)), F.lit(None)
            ).otherwise(v),
        ),
        lambda v: v.isNotNull(),
    )


def normalised_listings(raw: DataFrame, payload: str = "payload", url: str = "url") -> DataFrame:
    """Raw marketplace item JSON to candidate rows."""
    step = url_parts(raw, url).withColumn("i", F.from_json(payload, RAW_ITEM))
    local = F.coalesce(F.transform("i.localizedAspects", lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"))), F.array())
    groups = F.coalesce(
        F.flatten(
            F.transform(
                "i.product.aspectGroups",
                lambda g: F.transform(g["aspects"], lambda a: F.struct(a["name"].alias("name"), a["values"].alias("value"))),
            )
        ),
        F.array(),
    )
    step = step.withColumn("_aspects", F.filter(F.concat(local, groups), lambda a: F.coalesce(a["name"], F.lit("")) != ""))
    step = step.withColumn(
        "item_specifics",
        F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform("_aspects", lambda a: a["name"])),
                lambda n: F.struct(
                    n,
                    _text_list(F.element_at(F.filter("_aspects", lambda a: a["name"] == n), -1)["value"]),
                ),
            )
        ),
    )
    lines = _specific_lines(F.col("item_specifics"))
    step = step.withColumn("_lines", lines)
    shown = [strip(F.col(f"i.{n}")) for n in ("shortDescription", "subtitle")]
    texts = [strip(F.col(f"i.{n}")) for n in ("description", "shortDescription", "longDescription", "subtitle", "productDescription")]
    texts += [strip(F.col(f"i.product.{n}")) for n in ("description", "shortDescription", "longDescription", "subtitle", "productDescription")]
    some_text = F.concat_ws("", *texts) != ""
    summary = F.when(
        ~some_text & (F.size("_lines") > 0),
        F.concat(F.lit("Key listing details: "), F.array_join(F.slice("_lines", 1, 6), "; ")),
    )
    condition = F.when(strip(F.col("i.condition")) != "", F.concat(F.lit("Condition: "), strip(F.col("i.condition"))))
    bullets = F.slice(_deduped(F.concat(F.array_compact(F.array(*shown)), F.col("_lines"))), 1, 10)
    described = F.array_join(_deduped(F.array_compact(F.array(*texts, summary, condition))), " ")
    epid = F.coalesce(
        F.nullif(F.col("i.product.epid"), F.lit("")),
        F.nullif(F.get_json_object(payload, "$.product.ePID"), F.lit("")),
        F.col("epid"),
    )
    first = {
        k: F.try_element_at(F.try_element_at(F.col("item_specifics"), F.lit(k)), F.lit(1))
        for k in ("Brand", "MPN", "UPC", "EAN")
    }
    have = {k: F.coalesce(v, F.lit("")) != "" for k, v in first.items()}
    family = (
        F.when(epid.isNotNull(), F.concat(F.lit("epid:"), epid))
        .when(have["UPC"], F.concat(F.lit("upc:"), first["UPC"]))
        .when(have["EAN"], F.concat(F.lit("ean:"), first["EAN"]))
        .when(
            have["Brand"] & have["MPN"],
            F.concat(F.lit("brand_mpn:"), F.lower(strip(first["Brand"])), F.lit("::"), F.lower(strip(first["MPN"]))),
        )
        .when(F.coalesce(F.col("i.title"), F.lit("")) != "", F.concat(F.lit("title:"), match_key(F.col("i.title"))))
    )
    return step.select(
        F.col(url).alias("source_url"), "page_type", "legacy_item_id", F.col("i.itemId").alias("rest_item_id"),
        epid.alias("product_id"), F.col("i.title").alias("title"), F.col("i.price").alias("price"),
        F.coalesce("i.shippingOptions", F.array()).alias("shipping"),
        F.coalesce("i.returnTerms", "i.returns", "i.returnPolicy").alias("returns_json"),
        F.col("i.condition").alias("condition"),
        F.coalesce("i.seller.username", "i.seller.sellerId", "i.seller.userId").alias("seller_id"),
        F.col("i.seller.feedbackScore").alias("seller_feedback_score"),
        finite(F.col("i.seller.feedbackPercentage")).alias("seller_feedback_percentage"),
        finite(F.coalesce("i.reviewCount", "i.product.reviewCount")).cast("bigint").alias("product_rating_count"),
        finite(F.coalesce("i.averageRating", "i.product.averageRating")).alias("product_average_rating"),
        F.when(F.size(bullets) > 0, bullets).alias("listing_bullet_points"),
        F.nullif(described, F.lit("")).alias("listing_description"),
        F.when(F.size("item_specifics") > 0, F.col("item_specifics")).alias("item_specifics"),
        family.alias("product_family_key"),
    )


def return_days(returns_json: Column) -> Column:
    """Return window in days from a returns object: the named period first, then any text in it."""
    as_map = F.from_json(returns_json, "map<string,string>")

    def days(raw: Column) -> Column:
        parsed = F.from_json(raw, "struct<value: string, unit: string, unitType: string>")
        unit = F.coalesce(F.nullif(parsed["unit"], F.lit("")), parsed["unitType"])
        return F.coalesce(F.when(raw.startswith("{"), money.struct_days(parsed["value"], unit)), money.text_days(raw))

    named = [days(F.try_element_at(as_map, F.lit(k))) for k in ("returnPeriod", "returnWindow", "returnPeriodValue")]
    any_value = F.filter(F.transform(F.map_values(as_map), days), lambda v: v.isNotNull())
    return F.coalesce(*named, F.try_element_at(any_value, F.lit(1)))


def group_representatives(items: DataFrame) -> DataFrame:
    """One item per variation group: in stock, then cheap, then long title, then first."""
    stock = F.array_max(
        F.transform(
            "availability",
            lambda s: F.when(F.upper(F.trim(s)) == "IN_STOCK", 2).when(F.upper(F.trim(s)) == "LIMITED_STOCK", 1).otherwise(0),
        )
    )
    cents = F.coalesce(F.bround(finite(F.col("price_value")) * 100, 0).cast("bigint"), F.lit(10**9))
    order = F.struct(
        (-F.coalesce(stock, F.lit(0))).alias("a"), cents.alias("b"),
        (-F.length(F.coalesce("title", F.lit("")))).alias("c"), F.col("seq").alias("d"),
    )
    cols = [c for c in items.columns if c != "group_id"]
    return items.groupBy("group_id").agg(F.min_by(F.struct(*cols), order).alias("r")).select("group_id", "r.*")


def clean_title(title: Column) -> Column:
    """Title without condition noise and without a trailing 'with <accessory>' clause."""
    noise = "|".join(terms.TITLE_NOISE)
    text = F.regexp_replace(strip(F.coalesce(title, F.lit(""))), rf"(?i)\b(?:{noise})\b", " ")
    clause = match_key(F.regexp_extract(text, r"(?i)\bwith\b(.+)$", 1))
    text = F.when(
        contains_any(clause, terms.REMOVABLE_WITH), strip(F.regexp_replace(text, r"(?i)\bwith\b.+$", ""))
    ).otherwise(text)
    return F.regexp_replace(clean(text), r"^[ \-_,;/]+|[ \-_,;/]+$", "")


def accessory_like(key: Column) -> Column:
    """Whether normalised text reads as an accessory."""
    words = tokens(key)
    padded = F.concat(F.lit(" "), key, F.lit(" "))

    def has(listed) -> Column:
        return F.arrays_overlap(words, string_array(listed))

    term, context = has(terms.ACCESSORY_WORDS), has(terms.ACCESSORY_CONTEXT)
    charging = padded.contains(" charging case ")
    return (
        F.when(key == "", False)
        .when(contains_any(key, terms.ACCESSORY_CUES), True)
        .when(~term & ~charging, False)
        .when(context, True)
        .when(padded.contains(" for ") & has(terms.DEVICE_FAMILIES), True)
        .when(charging, False)
        .otherwise(term & ~has(terms.PRIMARY_TYPES))
    )


def retrieval_tokens(key: Column) -> Column:
    return F.filter(
        F.array_except(tokens(key), string_array(terms.RETRIEVAL_STOP)), lambda t: F.length(t) >= 2
    )


def product_kind(words: Column) -> Column:
    """Kind with most alias words; the first defined kind wins ties; null without any."""
    scored = [
        F.struct(
            F.size(F.array_intersect(words, string_array(aliases))).alias("n"),
            F.lit(-i).alias("order"),
            F.lit(kind).alias("kind"),
        )
        for i, (kind, aliases) in enumerate(terms.KIND_ALIASES.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["kind"])


def kinds_compatible(a: Column, b: Column) -> Column:
    same = (a == b) | (a.isin(*terms.AUDIO_KINDS) & b.isin(*terms.AUDIO_KINDS))
    return F.coalesce(same, F.lit(False))


def _brand(specifics: Column) -> Column:
    picks = []
    for wanted in terms.BRAND_KEYS:
        values = F.flatten(
            F.transform(
                F.filter(F.map_entries(specifics), _key_contains(wanted)),
                lambda e: F.transform(e["value"], text_or_blank),
            )
        )
        usable = F.filter(values, lambda v: (match_key(v) != "") & ~match_key(v).isin(*terms.GENERIC_BRANDS))
        picks.append(F.try_element_at(usable, F.lit(1)))
    return F.coalesce(*picks)


def _key_contains(wanted: str):
    def test(e: Column) -> Column:
        return match_key(e["key"]).contains(wanted)

    return test


def _key_is(wanted: str):
    def test(e: Column) -> Column:
        return match_key(e["key"]) == wanted

    return test


def _specific(specifics: Column, keys) -> Column:
    picks = []
    for wanted in keys:
        last = F.try_element_at(F.filter(F.map_entries(specifics), _key_is(wanted)), F.lit(-1))
        values = F.filter(F.transform(last["value"], clean_title), lambda v: v != "")
        picks.append(F.try_element_at(values, F.lit(1)))
    return F.coalesce(*picks)


def specifics_text(specifics: Column) -> Column:
    pairs = F.transform(
        F.map_entries(specifics),
        lambda e: F.trim(
            F.concat_ws(
                " ",
                strip(e["key"]),
                F.array_join(F.filter(F.transform(e["value"], text_or_blank), lambda v: v != ""), " "),
            )
        ),
    )
    return F.coalesce(F.array_join(F.filter(pairs, lambda v: v != ""), " "), F.lit(""))


def retrieval_profile(listings: DataFrame) -> DataFrame:
    """Retrieval title and document, brand, token sets, product kind and accessory flag."""
    step = listings.withColumns(
        {
            "brand": _brand(F.col("item_specifics")),
            "_model": _specific(F.col("item_specifics"), terms.MODEL_KEYS),
            "_type": _specific(F.col("item_specifics"), terms.TYPE_KEYS),
            "_clean": clean_title(F.col("title")),
            "_flat": specifics_text(F.col("item_specifics")),
        }
    )
    step = step.withColumns({"brand_normalized": match_key(F.col("brand")), "_base": F.coalesce("_model", "_clean")})
    with_brand = (F.col("_base") != "") & F.col("brand").isNotNull() & ~match_key(F.col("_base")).contains(F.col("brand_normalized"))
    step = step.withColumn("_lead", F.when(with_brand, F.col("brand")))
    type_key = match_key(F.col("_type"))
    seen = F.array(match_key(F.col("_lead")), match_key(F.col("_base")))
    add_type = F.when((type_key != "") & ~F.array_contains(seen, type_key), clean_title(F.col("_type")))
    title = F.trim(join_nonblank(" ", F.coalesce("_lead", F.lit("")), F.col("_base"), F.coalesce(add_type, F.lit(""))))
    step = step.withColumn(
        "retrieval_title",
        F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.col("_clean"), F.lit("")), text_or_blank(F.col("title"))),
    )
    document = F.trim(
        join_nonblank(
            " ",
            F.col("retrieval_title"),
            F.when(F.col("_clean") != F.col("retrieval_title"), F.col("_clean")).otherwise(""),
            F.coalesce("condition", F.lit("")),
            F.col("_flat"),
        )
    )
    step = step.withColumns(
        {
            "product_document": document,
            "identity_tokens": retrieval_tokens(match_key(F.col("retrieval_title"))),
            "_combined": match_key(join_nonblank(" ", F.coalesce("title", F.lit("")), F.col("_flat"))),
            "_type_key": match_key(
                F.array_join(
                    F.filter(F.transform(F.try_element_at("item_specifics", F.lit("Type")), text_or_blank), lambda v: v != ""), " "
                )
            ),
        }
    )
    own = F.array_except(F.col("identity_tokens"), F.split("brand_normalized", " "))
    core = F.array_except(own, string_array((*terms.CORE_STOP, *terms.PRIMARY_TYPE_WORDS)))
    step = step.withColumn("core_identity_tokens", F.when(F.size(core) > 0, core).otherwise(own))
    required = F.filter(
        "core_identity_tokens",
        lambda t: (F.length(t) >= 4) | t.rlike("[0-9]") | t.isin(*terms.VARIANT_WORDS),
    )
    typed_accessory = F.arrays_overlap(tokens(F.col("_type_key")), string_array(terms.ACCESSORY_WORDS))
    return step.withColumns(
        {
            "required_identity_tokens": required,
            "product_kind": F.coalesce(
                product_kind(F.col("identity_tokens")), product_kind(retrieval_tokens(F.col("_combined")))
            ),
            "is_accessory": F.when(typed_accessory, True)
            .when((F.col("_type_key") != "") & contains_any(F.col("_type_key"), terms.PRIMARY_TYPES), False)
            .otherwise(accessory_like(F.col("_combined"))),
        }
    ).drop("_model", "_type", "_clean", "_base", "_lead", "_combined", "_type_key")


def query_rows(profiles: DataFrame, include_shipping: bool = True, prefer_converted_usd: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listings as worth-buying query rows (catalog columns), and the columns ``keep``.

    parent_asin is the family key or what stands in for it; several listings may share it.
    """
    ident = F.coalesce(
        *[F.nullif(text_or_blank(F.col(c).cast("string")), F.lit("")) for c in
          ("product_family_key", "product_id", "legacy_item_id", "rest_item_id", "source_url")],
        F.lit("listing"),
    )
    kinded = with_listing_kind(
        profiles,
        F.col("retrieval_title"),
        F.lit(""),
        join_nonblank(" ", F.col("retrieval_title"), F.col("_flat")),
        "listing_kind",
    )
    rating = finite(F.col("product_average_rating"))
    count = finite(F.col("product_rating_count"))
    return kinded.select(
        *keep,
        ident.alias("parent_asin"),
        F.col("retrieval_title").alias("title"),
        F.coalesce("brand", F.lit("")).alias("store"),
        F.lit("").alias("main_category"),
        "listing_kind",
        "product_document",
        money.total_price(F.col("price"), F.col("shipping"), include_shipping, prefer_converted_usd).alias("price"),
        rating.alias("average_rating"),
        count.alias("rating_number"),
        F.coalesce(count.cast("bigint"), F.lit(0)).alias("review_count"),
        F.lit(None).cast("double").alias("verified_purchase_rate"),
        F.lit(0.0).alias("helpful_vote_total"),
        rating.alias("avg_review_rating"),
    )


def trust_payloads(listings: DataFrame) -> DataFrame:
    """Title, bullets and description for trust scoring; empty listings become error rows."""
    given = F.array_join(F.filter(F.transform("listing_bullet_points", clean), lambda v: v != ""), "; ")
    entries = F.filter(
        F.transform(
            F.map_entries("item_specifics"),
            lambda e: F.concat(
                clean(e["key"]), F.lit(": "),
                F.array_join(F.filter(F.transform(e["value"], clean), lambda v: v != ""), ", "),
            ),
        ),
        lambda v: ~v.endswith(": "),
    )
    bullets = F.coalesce(F.nullif(given, F.lit("")), F.nullif(F.array_join(F.slice(entries, 1, 8), "; "), F.lit("")))
    period = F.from_json(
        F.try_element_at(F.from_json("returns_json", "map<string,string>"), F.lit("returnPeriod")),
        "struct<value: string, unit: string>",
    )
    unit = clean(F.lower(period["unit"]))
    window = F.when(
        clean(period["value"]) != "",
        F.concat(F.lit("Return window: "), clean(period["value"]), F.lit(" "), F.when(unit != "", unit).otherwise("days")),
    )
    condition = F.when(clean(F.col("condition")) != "", F.concat(F.lit("Condition: "), clean(F.col("condition"))))
    text = F.coalesce(F.nullif(clean(F.col("listing_description")), F.lit("")), F.nullif(F.concat_ws(" ", condition, window), F.lit("")))
    out = listings.select(
        F.coalesce(*[F.nullif(clean(F.col(c).cast("string")), F.lit("")) for c in ("product_id", "legacy_item_id", "source_url")]).alias("product_id"),
        F.nullif(clean(F.col("title")), F.lit("")).alias("title"),
        bullets.alias("bullet_points"),
        text.alias("description"),
    )
    return out.withColumn(
        "error", F.when(F.coalesce("title", "bullet_points", "description").isNull(), "listing has no content")
    )


# ------------------------------------------------------------ market context


def reranked(found: DataFrame, profiles: DataFrame, cfg: MarketConfig = MarketConfig()) -> DataFrame:
    """Match score and rejection reason per (listing, neighbour), and the place among the kept.

    profiles: query_id, brand_normalized, token sets, product_kind, is_accessory.
    """
    text = join_nonblank(" ", *[F.coalesce(c, F.lit("")) for c in (F.col("title"), F.col("store"), F.col("main_category"))])
    side = found.withColumns(
        {
            "_key": match_key(text),
            "_brand_key": match_key(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("store", F.lit("")))),
            "_category": match_key(F.col("main_category")),
        }
    )
    side = side.withColumn("_tokens", retrieval_tokens(F.col("_key")))
    side = side.withColumns({"_kind": product_kind(F.col("_tokens")), "_accessory": accessory_like(F.col("_key"))})
    asks = profiles.select(
        "query_id", "brand_normalized", "identity_tokens", "core_identity_tokens", "required_identity_tokens",
        "product_kind", "is_accessory",
    )
    rows = side.join(asks, "query_id")

    def share(name: str) -> Column:
        return F.size(F.array_intersect(F.col(name), F.col("_tokens"))) / F.greatest(F.size(name), F.lit(1))

    def hits(name: str) -> Column:
        return F.arrays_overlap(F.col(name), F.col("_tokens"))

    compatible = kinds_compatible(F.col("product_kind"), F.col("_kind"))
    conflict = F.col("product_kind").isNotNull() & F.col("_kind").isNotNull() & ~compatible
    plain = ~F.col("is_accessory")
    category_penalty = F.when(plain & F.col("_category").rlike("case|accessories"), 0.15).otherwise(0.0)
    family_penalty = (
        F.when(plain & (F.size("required_identity_tokens") > 0) & ~hits("required_identity_tokens"), 0.30)
        .when(plain & (F.size("core_identity_tokens") > 0) & ~hits("core_identity_tokens"), 0.18)
        .otherwise(0.0)
    )
    brand = (F.col("brand_normalized") != "") & F.col("_brand_key").contains(F.col("brand_normalized"))
    score = F.greatest(
        0.45 * F.col("similarity")
        + 0.17 * share("identity_tokens")
        + 0.28 * share("core_identity_tokens")
        + 0.08 * compatible.cast("double")
        + 0.05 * brand.cast("double")
        - category_penalty
        - family_penalty
        - F.when(conflict, 0.25).otherwise(0.0),
        F.lit(0.0),
    )
    rows = rows.withColumn("match_score", F.round(score, 9))
    reason = (
        F.when(plain & F.col("_accessory"), "accessory_mismatch")
        .when(plain & conflict, "product_type_mismatch")
        .when(F.col("match_score") < cfg.min_match_score, "weak_identity_match")
    )
    rows = rows.withColumn("rejection_reason", reason)
    place = Window.partitionBy("query_id", F.col("rejection_reason").isNull()).orderBy(
        F.desc("match_score"), F.desc("similarity"), F.asc("parent_asin")
    )
    return rows.withColumn("place", F.when(F.col("rejection_reason").isNull(), F.row_number().over(place))).drop(
        "_key", "_brand_key", "_category", "_tokens", "_kind", "_accessory", "brand_normalized", "identity_tokens",
        "core_identity_tokens", "required_identity_tokens",
    )


def rejection_summary(ranked: DataFrame) -> DataFrame:
    """Rejected neighbours per listing and reason, with the first ten of each listing."""
    return (
        ranked.where(F.col("rejection_reason").isNotNull())
        .groupBy("query_id", "rejection_reason")
        .agg(F.count("*").alias("rejected"))
    )


def first_rejected(ranked: DataFrame, n: int = 10) -> DataFrame:
    gone = ranked.where(F.col("rejection_reason").isNotNull()).select(
        "query_id", F.col("rank").alias("retrieval_rank"), "parent_asin", "match_score", "rejection_reason"
    )
    return top_per_group(gone, ["query_id"], [F.asc("retrieval_rank")], n)


#: Statuses of listings whose peer price was thrown out.
PRICE_REASONS = ("insufficient_peer_neighbors", "implausibly_low_peer_price")


def rejections(ranked: DataFrame, context: DataFrame, n: int = 10) -> DataFrame:
    """Per listing: all reasons of rejected neighbours and of a rejected peer price with their counts, and the first n neighbours.

    Reasons are counted before they meet by listing, so a listing sends on a row a reason.
    """
    neighbours = ranked.where(F.col("rejection_reason").isNotNull()).select("query_id", F.col("rejection_reason").alias("reason"))
    prices = context.where(F.col("retrieval_status").isin(*PRICE_REASONS)).select("query_id", F.col("retrieval_status").alias("reason"))
    counted = neighbours.unionByName(prices).groupBy("query_id", "reason").agg(F.count("*").alias("n"))
    out = counted.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejection_summary"), F.sum("n").alias("rejected")
    )
    first = first_rejected(ranked, n).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "parent_asin", "rejection_reason"))).alias("first_rejected")
    )
    return out.join(first, "query_id", "left")


def with_listing_trust(rows: DataFrame, trust: DataFrame) -> DataFrame:
    """Join normalised trust (query_id and the columns of ``normalised_trust``) under the names of the listing summary."""
    carried = F.struct(
        F.col("trust_probability").alias("listing_trust_probability"), F.col("status").alias("listing_trust_status"),
        F.col("score_head").alias("listing_trust_score_head"), F.col("trust_probability_graph").alias("listing_trust_probability_graph"),
        F.col("trust_probability_logistic").alias("listing_trust_probability_logistic"),
        F.col("deception_probability").alias("listing_deception_probability"),
        F.col("deception_probability_graph").alias("listing_deception_probability_graph"),
        F.col("deception_probability_logistic").alias("listing_deception_probability_logistic"),
    )
    return rows.join(trust.select("query_id", carried.alias("_trust")), "query_id", "left").select(*rows.columns, "_trust.*")


def listing_context(profiles: DataFrame, ranked: DataFrame, cfg: MarketConfig = MarketConfig()) -> DataFrame:
    """Accepted peer price and retrieval status per listing.

    profiles: query_id, listing_price, is_accessory.
    """
    kept = F.col("place") <= cfg.top_n
    agg = ranked.groupBy("query_id").agg(
        F.count("*").alias("raw_neighbor_count"),
        F.count_if(kept).alias("neighbor_count"),
        F.try_divide(
            F.sum(F.when(kept, F.col("price") * F.col("similarity"))), F.sum(F.when(kept, F.col("similarity")))
        ).alias("_peer"),
        F.avg(F.when(kept, F.col("similarity"))).alias("_similarity"),
    )
    rows = profiles.select("query_id", "listing_price", "is_accessory").join(agg, "query_id", "left")
    rows = rows.withColumns(
        {
            "raw_neighbor_count": F.coalesce("raw_neighbor_count", F.lit(0)),
            "neighbor_count": F.coalesce("neighbor_count", F.lit(0)),
            "average_neighbor_similarity": F.coalesce("_similarity", F.lit(0.0)),
        }
    )
    checkable = F.col("_peer").isNotNull() & (F.coalesce("listing_price", F.lit(0.0)) > 0) & ~F.col("is_accessory")
    rejected = F.when(
        checkable & (F.col("neighbor_count") < max(1, cfg.min_neighbours)), "insufficient_peer_neighbors"
    ).when(
        checkable
        & (F.col("listing_price") >= cfg.small_price)
        & F.lit(cfg.min_price_ratio > 0)
        & (F.try_divide(F.col("_peer"), F.col("listing_price")) < cfg.min_price_ratio),
        "implausibly_low_peer_price",
    )
    rows = rows.withColumn("_rejected", rejected)
    rows = rows.withColumn("peer_price", F.when(F.col("_rejected").isNull(), F.col("_peer")))
    status = (
        F.when(F.col("_rejected").isNotNull(), F.col("_rejected"))
        .when(
            F.col("peer_price").isNotNull(),
            F.when(
                F.col("neighbor_count") < F.greatest(F.least(F.col("raw_neighbor_count"), F.lit(3)), F.lit(1)),
                "usable_but_thin",
            ).otherwise(USABLE),
        )
        .when(F.col("raw_neighbor_count") <= 0, "no_neighbors")
        .when(F.col("neighbor_count") <= 0, "all_neighbors_filtered")
        .otherwise("insufficient_evidence")
    )
    return rows.withColumn("retrieval_status", status).drop("_peer", "_similarity", "_rejected")


def k_sweep(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Peer price over the first k reranked neighbours, for each k."""
    wanted = sorted(set(ks))
    if not wanted or wanted[0] <= 0:
        raise ValueError("k values must be positive integers")
    kept = ranked.where(F.col("rejection_reason").isNull() & (F.col("place") <= wanted[-1]))
    running = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = Window.partitionBy("query_id")
    rows = kept.select(
        "query_id", "place",
        F.sum(F.col("price") * F.col("similarity")).over(running).alias("_ps"),
        F.sum("similarity").over(running).alias("_s"),
        F.collect_list("price").over(running).alias("neighbor_prices"),
        F.count("*").over(size).alias("_n"),
    )
    each = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in wanted])))
    return each.where(F.col("place") == F.least(F.col("k"), F.col("_n"))).select(
        "query_id", "k",
        F.try_divide(F.col("_ps"), F.col("_s")).alias("peer_price"),
        F.col("place").alias("neighbor_count"),
        (F.col("_s") / F.col("place")).alias("average_neighbor_similarity"),
        "neighbor_prices",
    )


# ------------------------------------------------------------- listing value


def listing_value(listings: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Good-value posterior and decision per listing.

    Needs the value inputs (price, warranty_months, ... ) plus manual_peer_price,
    retrieved_peer_price, retrieval_status and listing_trust_probability (all nullable). Adds
    the neutral-price posterior as well, which pair comparison falls back to.
    """
    status = F.nullif(F.trim(F.coalesce("retrieval_status", F.lit(""))), F.lit(""))
    retrieved = F.coalesce(F.col("retrieved_peer_price").isNotNull() & (status == USABLE), F.lit(False))
    failed = F.coalesce(status != USABLE, F.lit(False))
    manual = F.col("manual_peer_price").isNotNull()
    rows = listings.withColumns(
        {
            "peer_price": F.when(retrieved, F.col("retrieved_peer_price")).otherwise(F.col("manual_peer_price")),
            "peer_price_source": F.when(retrieved, "retrieval").when(manual, "manual").otherwise("none"),
            "price_considered": F.when(retrieved, True).when(failed, False).otherwise(manual),
            "price_note": F.when(failed, NO_PRICE_NOTE),
            "default_relative_price_bucket": F.when(failed, NEUTRAL_BUCKET),
            "trust_probability": F.coalesce("listing_trust_probability", "trust_probability"),
        }
    )
    neutral = _scored(rows.withColumn("_peer", F.lit(None).cast("double")), "_peer", F.lit(NEUTRAL_BUCKET), "neutral_probability")
    scored = _scored(neutral.drop("_peer"), "peer_price", F.col("default_relative_price_bucket"), "good_value_probability", keep_gap=True)
    label = F.when(F.col("good_value_probability") >= threshold, "good_value").otherwise("not_good_value")
    without_price = ~F.col("price_considered") & F.col("price_note").isNotNull()
    source = F.col("peer_price_source")
    not_enough = status.isNotNull() & ((source == "none") | ((source == "retrieval") & (status != USABLE)))
    return scored.withColumns(
        {
            "prediction": F.when(without_price, label).when(not_enough, "insufficient_evidence").otherwise(label),
            "prediction_reason": F.when(without_price, "bayesian_probability_without_price")
            .when(not_enough, status)
            .otherwise("bayesian_probability"),
        }
    )


def _scored(rows: DataFrame, peer: str, default: Column, into: str, keep_gap: bool = False) -> DataFrame:
    base = rows.columns
    given = rows.withColumn("_keep", F.col("peer_price")).withColumn("peer_price", F.col(peer))
    out = good_value_posterior(value_evidence(given, default)).withColumn("peer_price", F.col("_keep"))
    extra = [F.col("price_gap_vs_peer")] if keep_gap else []
    return out.select(*base, *extra, F.col("good_value_probability").alias(into))


SUMMARY = (
    "source_url", "title", "total_price", "total_price_currency", "peer_price", "price_gap_vs_peer",
    "good_value_probability", "prediction", "prediction_reason", "trust_probability",
    "listing_trust_status", "listing_trust_score_head", "listing_trust_probability_graph",
    "listing_trust_probability_logistic", "listing_deception_probability",
    "listing_deception_probability_graph", "listing_deception_probability_logistic",
    "ewom_score_0_to_100", "seller_feedback_review_count", "retrieval_status",
    "retrieved_neighbor_count", "price_considered", "price_note", "peer_price_source",
)


def listing_summary(valued: DataFrame) -> DataFrame:
    """The 24 columns shown for a listing; absent inputs are null."""
    renamed = valued.withColumn("total_price", F.col("price"))
    return renamed.select(
        *[F.col(c) if c in renamed.columns else F.lit(None).alias(c) for c in SUMMARY]
    )
