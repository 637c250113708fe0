"""Listing, pair comparison and explanation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money, terms
from ..functions.text import match_key
from ..operators import compare as P
from ..operators import explain as X
from ..operators import listings as L
from ..operators import retrieval as R
from ..operators import trust as T
from . import views
from .catalog_queries import (
    _matched, any_sql, evidence_sql, key_sql, kind_sql, posterior_ctes, posterior_sql, r6,
)
from .review_queries import clean_sql
from .views import rounded, sql


def listings(spark, sf):
    """One candidate listing per part, with every optional field missing somewhere."""
    p = views.spread(views.table(spark, sf, "part"))
    k = F.col("p_partkey")
    price = F.struct(
        F.when(k % 11 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("value"),
        F.when(k % 10 == 3, "").otherwise("sgd").alias("currency"),
        F.when(k % 2 == 0, F.round(F.col("p_retailprice") * 0.75, 2).cast("string")).alias("convertedFromValue"),
        F.when(k % 2 == 0, "USD").alias("convertedFromCurrency"),
    )

    def option(kind, value):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("shippingCostType"),
            F.struct(
                (F.lit(value) if value is not None else none).alias("value"), F.lit("USD").alias("currency"),
                none.alias("convertedFromValue"), none.alias("convertedFromCurrency"),
            ).alias("shippingCost"),
        )

    shipping = (
        F.when(k % 5 == 1, F.array(option("FREE", None)))
        .when(k % 5 == 2, F.array(option("FIXED", "12.5"), option("FIXED", "4.25")))
        .when(k % 5 == 3, F.array(option("FIXED", "-1")))
        .when(k % 5 == 4, F.array(option("FIXED", "soon")))
    )
    returns = (
        F.when(k % 4 == 0, '{"returnPeriod": {"value": 30, "unit": "DAY"}}')
        .when(k % 4 == 1, '{"refund": "MONEY_BACK", "note": "within 2 weeks"}')
        .when(k % 4 == 3, '{"returnWindow": "1 month"}')
    )
    one = lambda c: F.array(c)
    entries = F.filter(
        F.array(
            F.struct(F.lit("Brand").alias("k"), one(F.when(k % 6 == 0, "Unbranded").otherwise(F.col("p_brand"))).alias("v")),
            F.when(k % 7 == 0, F.struct(F.lit("Type").alias("k"), one(F.lit("Case")).alias("v"))),
            F.when(k % 7 == 1, F.struct(F.lit("Type").alias("k"), one(F.lit("Earbud (In Ear)")).alias("v"))),
            F.when(k % 8 == 0, F.struct(F.lit("Model").alias("k"), one(F.col("p_name")).alias("v"))),
            F.when(k % 3 == 0, F.struct(F.lit("Manufacturer Warranty").alias("k"), one(F.lit("2 years")).alias("v"))),
            F.when(k % 3 == 1, F.struct(F.lit("Manufacturer Warranty").alias("k"), F.array(F.lit("n/a"), F.lit("90 days")).alias("v"))),
        ),
        lambda e: e.isNotNull(),
    )
    return p.select(
        k.alias("k"),
        k.cast("string").alias("query_id"),
        F.concat(F.lit("https://shop.example/itm/"), k).alias("source_url"),
        k.cast("string").alias("legacy_item_id"),
        F.lit(None).cast("string").alias("rest_item_id"),
        F.lit(None).cast("string").alias("product_id"),
        F.when(k % 5 != 0, F.concat(F.lit("key:"), k)).alias("product_family_key"),
        F.concat(views.phrase(k), F.lit(" "), F.col("p_name"), F.when(k % 4 == 0, " with charging cable").otherwise("")).alias("title"),
        price.alias("price"),
        shipping.alias("shipping"),
        returns.alias("returns_json"),
        F.when(k % 2 == 0, "New").otherwise("Used").alias("condition"),
        F.map_from_entries(entries).alias("item_specifics"),
        F.when(k % 9 == 0, F.array(F.lit(" one "), F.lit(""), F.lit("two"))).alias("listing_bullet_points"),
        F.when(k % 9 == 1, "A  described item").alias("listing_description"),
        F.when(k % 13 != 0, (F.lit(10) + (k * 7) % 41) / 10.0).alias("product_average_rating"),
        F.col("p_size").cast("bigint").alias("product_rating_count"),
    )


def url_parts(spark, sf):
    p = views.table(spark, sf, "pages")
    base = F.regexp_replace("url", r"[?#].*$", "")
    i = F.col("page_id")
    shaped = F.when(i % 3 == 0, F.concat(base, F.lit("/itm/"), i, F.lit("?x=1"))).when(
        i % 3 == 1, F.concat(base, F.lit("/p/"), i, F.lit("?k=2&iid="), i * 3)
    ).otherwise(F.col("url"))
    return L.url_parts(p.select("page_id", shaped.alias("link")), "link").select("page_id", "page_type", "legacy_item_id", "epid")


def accessory_flag(spark, sf):
    return views.meta(spark, sf).select("parent_asin", L.accessory_like(match_key(F.col("title"))).alias("accessory"))


def product_kind(spark, sf):
    return views.meta(spark, sf).select(
        "parent_asin", L.product_kind(L.retrieval_tokens(match_key(F.col("title")))).alias("kind")
    )


def clean_title(spark, sf):
    return listings(spark, sf).select("k", L.clean_title(F.col("title")).alias("title"))


def total_price(spark, sf):
    return rounded(
        listings(spark, sf).select(
            "k",
            money.total_price(F.col("price"), F.col("shipping")).alias("total"),
            money.total_price(F.col("price"), F.col("shipping"), True, True).alias("total_usd"),
            money.total_price(F.col("price"), F.col("shipping"), False).alias("item_only"),
            money.total_currency(F.col("price"), F.col("shipping")).alias("currency"),
            money.total_currency(F.col("price"), F.col("shipping"), True).alias("currency_usd"),
        )
    )


def durations(spark, sf):
    return rounded(
        listings(spark, sf).select(
            "k",
            L.return_days(F.col("returns_json")).alias("return_window_days"),
            money.warranty_months(F.col("item_specifics")).alias("warranty_months"),
        )
    )


def listing_normalised(spark, sf):
    p = views.table(spark, sf, "part")
    k = F.col("p_partkey")
    item = F.to_json(
        F.struct(
            F.concat(F.lit("v1|"), k, F.lit("|0")).alias("itemId"),
            F.concat(views.phrase(k), F.lit(" "), F.col("p_name")).alias("title"),
            F.when(k % 2 == 0, "New").alias("condition"),
            F.struct(F.col("p_retailprice").cast("string").alias("value"), F.lit("USD").alias("currency")).alias("price"),
            F.struct(F.when(k % 3 == 0, "u").alias("username"), F.concat(F.lit("s"), F.col("p_size")).alias("sellerId")).alias("seller"),
            F.when(k % 4 == 0, "Short  note").alias("shortDescription"),
            F.array(
                F.struct(F.lit("Brand").alias("name"), F.array("p_brand").alias("value")),
                F.struct(F.when(k % 5 == 0, "MPN").otherwise("Size").alias("name"), F.array(F.concat(F.lit("M"), F.col("p_size"))).alias("value")),
            ).alias("localizedAspects"),
            F.struct(
                F.when(k % 6 == 0, k.cast("string")).alias("epid"),
                F.when(k % 7 != 0, "4.5").alias("averageRating"),
                F.lit("12").alias("reviewCount"),
                F.array(
                    F.struct(F.array(F.struct(F.lit("Size").alias("name"), F.array(F.lit("large"), F.lit("L")).alias("values"))).alias("aspects"))
                ).alias("aspectGroups"),
            ).alias("product"),
        )
    )
    raw = p.select(item.alias("payload"), F.concat(F.lit("https://shop.example/itm/"), k).alias("url"))
    out = L.normalised_listings(raw)
    return out.select(
        "source_url", "page_type", "legacy_item_id", "rest_item_id", "product_id", "title", "seller_id",
        F.col("price.value").alias("price_value"), "product_average_rating", "product_rating_count",
        F.array_join("listing_bullet_points", " / ").alias("bullets"), "listing_description", "product_family_key",
        F.array_join(F.map_keys("item_specifics"), ",").alias("specific_names"),
    )


def _profiles(spark, sf):
    return L.retrieval_profile(listings(spark, sf))


def retrieval_profile(spark, sf):
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return _profiles(spark, sf).select(
        "k", "brand", "retrieval_title", "product_document", joined("identity_tokens"), joined("core_identity_tokens"),
        joined("required_identity_tokens"), "product_kind", "is_accessory",
    )


def query_rows(spark, sf):
    out = L.query_rows(_profiles(spark, sf), True, False)
    return rounded(out.select("parent_asin", "title", "store", "listing_kind", "price", "average_rating", "rating_number", "review_count"))


def trust_payload(spark, sf):
    return L.trust_payloads(listings(spark, sf))


def group_representative(spark, sf):
    li = views.table(spark, sf, "lineitem")
    items = li.select(
        F.col("l_orderkey").alias("group_id"),
        (F.col("l_partkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.concat(F.lit("item "), F.col("l_partkey")).alias("title"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity").cast("string")).otherwise("?").alias("price_value"),
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("limited_stock"), F.lit("IN_STOCK")))
        .when(F.col("l_returnflag") == "N", F.array(F.lit("LIMITED_STOCK"))).alias("availability"),
    )
    return L.group_representatives(items).select("group_id", "seq", "title", "price_value")


def _ranked(spark, sf):
    _, found, _, _ = _matched(spark, sf)
    return L.reranked(found, _profiles(spark, sf))


def neighbor_rerank(spark, sf):
    return _ranked(spark, sf).select(
        "query_id", "parent_asin", F.round("match_score", 6).alias("match_score"), "rejection_reason", "place"
    )


def rejection_summary(spark, sf):
    return L.rejection_summary(_ranked(spark, sf))


def first_rejected(spark, sf):
    return L.first_rejected(_ranked(spark, sf)).select("query_id", "rank", "parent_asin", "rejection_reason")


def _asked(spark, sf, found_ids):
    prof = _profiles(spark, sf).select(
        "query_id", "is_accessory", money.total_price(F.col("price"), F.col("shipping")).alias("listing_price")
    )
    return prof.join(found_ids, "query_id", "left_semi")


def _context(spark, sf):
    test, found, _, _ = _matched(spark, sf)
    ranked = L.reranked(found, _profiles(spark, sf))
    ids = test.select(F.col("parent_asin").alias("query_id"))
    return L.listing_context(_asked(spark, sf, ids), ranked)


def retrieval_status(spark, sf):
    return rounded(
        _context(spark, sf).select(
            "query_id", "listing_price", "raw_neighbor_count", "neighbor_count", "peer_price",
            "average_neighbor_similarity", "retrieval_status",
        ),
        keep=(),
    )


def k_sweep(spark, sf):
    out = L.k_sweep(_ranked(spark, sf), [5, 1, 3, 3])
    return out.select(
        "query_id", "k", F.round("peer_price", 6).alias("peer_price"), "neighbor_count",
        F.round("average_neighbor_similarity", 6).alias("average_neighbor_similarity"),
        F.array_join(F.transform("neighbor_prices", lambda v: F.format_string("%.2f", v)), ",").alias("neighbor_prices"),
    )


def _valued(spark, sf):
    k = F.col("k")
    base = listings(spark, sf).select(
        "k", "query_id", "source_url", "title",
        money.total_price(F.col("price"), F.col("shipping")).alias("price"),
        money.total_currency(F.col("price"), F.col("shipping")).alias("total_price_currency"),
        F.col("product_average_rating").alias("average_rating"),
        F.col("product_rating_count").cast("double").alias("rating_count"),
        F.lit(None).cast("double").alias("verified_purchase_rate"),
        money.warranty_months(F.col("item_specifics")).alias("warranty_months"),
        L.return_days(F.col("returns_json")).alias("return_window_days"),
        F.when(k % 4 != 0, ((k * 13) % 101).cast("double")).alias("ewom_score_0_to_100"),
        F.when(k % 4 != 0, ((k * 29) % 101).cast("double")).alias("ewom_magnitude_0_to_100"),
        F.when(k % 4 != 0, (k % 12) + 1).alias("seller_feedback_review_count"),
        F.lit(None).cast("double").alias("trust_probability"),
        F.when(k % 9 == 0, 700.0 + (k * 31) % 500).alias("manual_peer_price"),
    )
    context = _context(spark, sf).select(
        "query_id", F.col("peer_price").alias("retrieved_peer_price"), "retrieval_status",
        F.col("neighbor_count").alias("retrieved_neighbor_count"),
    )
    base = L.with_listing_trust(base, T.normalised_trust(_trust_results(spark, sf)))
    return L.listing_value(base.join(context, "query_id", "left"))


def _trust_results(spark, sf):
    """What trust scoring gives for the listings: two heads, one head or an error."""
    k = F.col("k")
    none = F.lit(None).cast("double")
    return listings(spark, sf).select(
        "query_id", F.when(k % 3 != 0, "ok").otherwise("error").alias("status"),
        F.when(k % 3 == 1, ((k * 23) % 100) / 99.0).when(k % 3 == 2, ((k * 17) % 100) / 99.0).alias("phase_b_truth_likelihood_graph"),
        F.when(k % 3 == 1, ((k * 17) % 100) / 99.0).alias("phase_b_truth_likelihood_logistic"),
        none.alias("trust_risk_index_graph"), none.alias("trust_risk_index_logistic"), none.alias("graph_uncertainty_entropy"),
    )


def listing_value(spark, sf):
    return rounded(L.listing_summary(_valued(spark, sf)))


def _pairs(spark, sf):
    """All neighbouring parts of an order, by part number; an order has at most seven lines."""
    li = views.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    # Repeated lines of a part share its place, and the last of them leads on to the next part.
    each = li.withColumns({"at": F.dense_rank().over(order), "next": F.lead("l_partkey").over(order)}).where("next <> l_partkey OR (l_partkey IS NULL AND next IS NOT NULL)")
    return each.select(
        (F.col("l_orderkey") * 8 + F.col("at")).alias("pair_id"), F.col("l_partkey").cast("string").alias("id_a"), F.col("next").cast("string").alias("id_b")
    )


_SHOWN = ("price", "peer_price", "total_price_currency", "trust_probability", "ewom_score_0_to_100",
          "seller_feedback_review_count", "retrieved_neighbor_count")


def _verdicts(spark, sf):
    return P.pair_verdicts(P.pair_sides(_pairs(spark, sf), _valued(spark, sf), "query_id", _SHOWN))


def pair_verdict(spark, sf):
    return rounded(
        _verdicts(spark, sf).select(
            "pair_id", "id_a", "id_b", "price_comparison_mode", "good_value_probability_delta", "verdict", "basis", "a_p", "b_p"
        )
    )


def explanations(spark, sf):
    out = X.explanations(_verdicts(spark, sf))
    return out.select(
        "pair_id", F.col("explanation.title").alias("title"), F.size("explanation.paragraphs").alias("paragraphs"),
        F.col("explanation.watchouts")[2].alias("third_watchout"),
        F.col("explanation.paragraphs")[0].contains("%").alias("has_percent"),
    )


def _compare_pairs(spark, sf):
    p = views.table(spark, sf, "part")
    k = F.col("p_partkey")
    one = p.select(
        k.cast("string").alias("id"),
        F.struct(
            F.concat(views.phrase(k), F.lit(" "), F.col("p_name")).alias("title"),
            F.when(k % 10 == 0, "usd").when(k % 10 == 1, "").otherwise("SGD").alias("currency"),
            F.when(k % 6 != 0, F.col("p_retailprice")).alias("base_price"),
            F.when(k % 3 == 0, 5.0).alias("shipping_fee"),
            F.lit(None).cast("double").alias("platform_discount"),
            F.when(k % 7 == 0, 20.0).alias("seller_discount"),
            F.lit(None).cast("double").alias("voucher_discount"),
            F.when(k % 4 == 0, F.col("p_retailprice") * 1.1).alias("total_price"),
            F.when(k % 5 != 0, 1.0 + k % 9).alias("delivery_days"),
            F.when(k % 3 != 0, (k % 3) * 12.0).alias("warranty_months"),
            F.lit(30.0).alias("return_window_days"),
            F.map_from_entries(
                F.filter(
                    F.array(
                        F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")),
                        F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v")),
                        F.when(k % 2 == 0, F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v"))),
                        F.when(k % 5 == 0, F.struct(F.lit("note").alias("k"), F.lit("").alias("v"))),
                    ),
                    lambda e: e.isNotNull(),
                )
            ).alias("specs"),
        ).alias("x"),
    )
    one = one.select("id", P.compared_side(F.col("x")).alias("x"))
    out = _pairs(spark, sf).join(one.select(F.col("id").alias("id_a"), F.col("x").alias("a")), "id_a")
    return out.join(one.select(F.col("id").alias("id_b"), F.col("x").alias("b")), "id_b")


def listing_compare(spark, sf):
    out = P.compare_listings(_compare_pairs(spark, sf))
    return out.select(
        "pair_id", "verdict", *[F.round(c, 1).alias(c) for c in ("value_score_a", "value_score_b", "cost_a", "cost_b", "service_a", "service_b")],
        "confidence", F.array_join("missing_fields", ",").alias("missing_fields"),
    )


def explanation_check(spark, sf):
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id")
    words = F.when(k % 3 == 0, F.array_join(F.array_repeat(F.lit("word"), 40), " ")).otherwise("few words")
    body = F.when(k % 5 == 0, F.array(words, words)).otherwise(F.array(words, F.lit(" "), words, words, words, F.lit("extra")))
    payload = F.when(k % 7 == 0, F.lit("[1]")).otherwise(
        F.to_json(
            F.struct(
                F.when(k % 4 != 0, F.col("source")).alias("Headline"),
                F.lit(" a  summary ").alias("summary"),
                body.alias("paragraphs"),
                F.when(k % 2 == 0, "a\nb\n\nc\nd").otherwise("only one").alias("risks"),
            )
        )
    )
    out = X.checked_explanations(d.select("doc_id", payload.alias("payload")))
    return out.select("doc_id", "reject_reason", F.coalesce("title", F.lit("")).alias("title"), F.size("paragraphs").alias("paragraphs"), "word_count")


QUERIES = {
    f.__name__: f
    for f in (
        url_parts, accessory_flag, product_kind, clean_title, total_price, durations, listing_normalised,
        retrieval_profile, query_rows, trust_payload, group_representative, neighbor_rerank, rejection_summary,
        first_rejected, retrieval_status, k_sweep, listing_value, pair_verdict, explanations, listing_compare,
        explanation_check,
    )
}

# --------------------------------------------------------------- SQL checks


def tokens_sql(key: str) -> str:
    return f"list_distinct(list_filter(string_split({key}, ' '), lambda t: t <> ''))"


def rtokens_sql(key: str) -> str:
    return f"list_filter({tokens_sql(key)}, lambda t: length(t) >= 2 AND NOT list_contains({views.quoted(terms.RETRIEVAL_STOP)}, t))"


def accessory_sql(key: str) -> str:
    has = lambda listed: f"list_has_any({tokens_sql(key)}, {views.quoted(listed)})"
    return f"""CASE WHEN {key} = '' THEN FALSE WHEN {any_sql(key, terms.ACCESSORY_CUES)} THEN TRUE
  WHEN NOT {has(terms.ACCESSORY_WORDS)} AND NOT contains(' ' || {key} || ' ', ' charging case ') THEN FALSE
  WHEN {has(terms.ACCESSORY_CONTEXT)} THEN TRUE
  WHEN contains(' ' || {key} || ' ', ' for ') AND {has(terms.DEVICE_FAMILIES)} THEN TRUE
  WHEN contains(' ' || {key} || ' ', ' charging case ') THEN FALSE
  ELSE {has(terms.ACCESSORY_WORDS)} AND NOT {has(terms.PRIMARY_TYPES)} END"""


def pkind_sql(toks: str) -> str:
    n = {kind: f"len(list_intersect({toks}, {views.quoted(a)}))" for kind, a in terms.KIND_ALIASES.items()}
    best = "greatest(" + ", ".join(n.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {x} = {best} THEN '{kind}'" for kind, x in n.items()) + " END"


def compatible_sql(a: str, b: str) -> str:
    return f"coalesce({a} = {b} OR ({a} IN ('earbud', 'headphone') AND {b} IN ('earbud', 'headphone')), FALSE)"


def ctitle_sql(x: str) -> str:
    noise = "|".join(terms.TITLE_NOISE)
    t = f"regexp_replace(trim({x}), '(?i)\\b(?:{noise})\\b', ' ', 'g')"
    clause = key_sql(f"regexp_extract({t}, '(?i)\\bwith\\b(.+)$', 1)")
    cut = f"CASE WHEN {any_sql(clause, terms.REMOVABLE_WITH)} THEN trim(regexp_replace({t}, '(?i)\\bwith\\b.+$', '')) ELSE {t} END"
    return f"regexp_replace({clean_sql(cut)}, '^[ \\-_,;/]+|[ \\-_,;/]+$', '', 'g')"


V = views.SQL
_plain_title = f"({views.quoted(views.PHRASES)})[CAST(p_partkey % {len(views.PHRASES)} + 1 AS INT)] || ' ' || p_name"
V["cand"] = (
    (),
    f"""SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS query_id, 'https://shop.example/itm/' || p_partkey AS source_url, p_brand, p_size, p_name,
  {_plain_title} || CASE WHEN p_partkey % 4 = 0 THEN ' with charging cable' ELSE '' END AS title,
  CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS item, CASE WHEN p_partkey % 2 = 0 THEN round(p_retailprice * 0.75, 2) END AS usd,
  CASE p_partkey % 5 WHEN 1 THEN 0.0 WHEN 2 THEN 4.25 WHEN 3 THEN 0.0 END AS ship,
  CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE 'SGD' END AS cur, CASE WHEN p_partkey % 5 > 0 THEN 'USD' END AS shipcur,
  CASE p_partkey % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 14.0 WHEN 3 THEN 30.0 END AS return_days,
  CASE p_partkey % 3 WHEN 0 THEN 730 / 30.0 WHEN 1 THEN 3.0 END AS warranty,
  CASE WHEN p_partkey % 6 <> 0 THEN p_brand ELSE '2 years' END AS brand, CASE WHEN p_partkey % 6 = 0 THEN 'Unbranded' ELSE p_brand END AS brand_given,
  CASE p_partkey % 7 WHEN 0 THEN 'Case' WHEN 1 THEN 'Earbud (In Ear)' END AS type, CASE WHEN p_partkey % 8 = 0 THEN p_name END AS model,
  CASE WHEN p_partkey % 2 = 0 THEN 'New' ELSE 'Used' END AS condition,
  CASE WHEN p_partkey % 13 <> 0 THEN (10 + (p_partkey * 7) % 41) / 10.0 END AS rating FROM part""",
)
V["prof"] = (
    ("cand",),
    f"""SELECT *, CASE WHEN list_has_any({tokens_sql('type_key')}, {views.quoted(terms.ACCESSORY_WORDS)}) THEN TRUE
    WHEN type_key <> '' AND {any_sql('type_key', terms.PRIMARY_TYPES)} THEN FALSE ELSE {accessory_sql('combined')} END AS is_accessory,
  list_filter(core, lambda t: length(t) >= 4 OR regexp_matches(t, '[0-9]') OR list_contains({views.quoted(terms.VARIANT_WORDS)}, t)) AS required,
  coalesce({pkind_sql('ident')}, {pkind_sql(rtokens_sql('combined'))}) AS pkind,
  concat_ws(' ', rtitle, CASE WHEN ctitle <> rtitle THEN nullif(ctitle, '') END, condition, flat) AS document
FROM (SELECT *, CASE WHEN len(c1) > 0 THEN c1 ELSE own END AS core FROM (
  SELECT *, list_filter(own, lambda t: NOT list_contains({views.quoted((*terms.CORE_STOP, *terms.PRIMARY_TYPE_WORDS))}, t)) AS c1 FROM (
    SELECT *, list_filter(ident, lambda t: NOT list_contains(string_split(brand_key, ' '), t)) AS own FROM (
      SELECT *, {rtokens_sql(key_sql('rtitle'))} AS ident FROM (
        SELECT *, concat_ws(' ', CASE WHEN brand IS NOT NULL AND NOT contains({key_sql('base')}, brand_key) THEN brand END, base,
            CASE WHEN type IS NOT NULL AND {key_sql('type')} <> {key_sql('base')} AND {key_sql('type')} <> brand_key THEN {ctitle_sql('type')} END) AS rtitle FROM (
          SELECT *, coalesce(model, ctitle) AS base, {key_sql("title || ' ' || flat")} AS combined FROM (
            SELECT *, {ctitle_sql('title')} AS ctitle, {key_sql('brand')} AS brand_key, {key_sql('type')} AS type_key,
              concat_ws(' ', 'Brand ' || brand_given, 'Type ' || type, 'Model ' || model, CASE k % 3 WHEN 0 THEN 'Manufacturer Warranty 2 years' WHEN 1 THEN 'Manufacturer Warranty n/a 90 days' END) AS flat
            FROM cand) a) b) c) d) e) f) g""",
)
V["rerank"] = (
    ("found", "prof"),
    f"""SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY query_id, reason IS NULL ORDER BY match_score DESC, similarity DESC, parent_asin) END AS place FROM (
  SELECT *, CASE WHEN NOT is_accessory AND nacc THEN 'accessory_mismatch' WHEN NOT is_accessory AND conflict THEN 'product_type_mismatch' WHEN match_score < 0.24 THEN 'weak_identity_match' END AS reason FROM (
    SELECT *, round(greatest(0.0, 0.45 * similarity + 0.17 * len(list_intersect(ident, toks)) / greatest(1, len(ident)) + 0.28 * len(list_intersect(core, toks)) / greatest(1, len(core))
        + CASE WHEN compat THEN 0.08 ELSE 0 END + CASE WHEN brand_key <> '' AND contains(nbrand, brand_key) THEN 0.05 ELSE 0 END
        - CASE WHEN NOT is_accessory AND (contains(ncat, 'case') OR contains(ncat, 'accessories')) THEN 0.15 ELSE 0 END
        - CASE WHEN is_accessory THEN 0 WHEN len(required) > 0 AND NOT list_has_any(required, toks) THEN 0.30 WHEN len(core) > 0 AND NOT list_has_any(core, toks) THEN 0.18 ELSE 0 END
        - CASE WHEN conflict THEN 0.25 ELSE 0 END), 9) AS match_score FROM (
      SELECT *, {compatible_sql('pkind', 'nkind')} AS compat, pkind IS NOT NULL AND nkind IS NOT NULL AND NOT {compatible_sql('pkind', 'nkind')} AS conflict FROM (
        SELECT *, {pkind_sql('toks')} AS nkind, {accessory_sql('nkey')} AS nacc FROM (
          SELECT *, {rtokens_sql('nkey')} AS toks FROM (
            SELECT f.query_id, f.rank, f.parent_asin, f.price, f.similarity, {key_sql("concat_ws(' ', f.title, f.store, f.main_category)")} AS nkey, {key_sql("f.title || ' ' || f.store")} AS nbrand,
              {key_sql('f.main_category')} AS ncat, p.ident, p.core, p.required, p.pkind, p.is_accessory, p.brand_key FROM found f JOIN prof p USING (query_id)) a) b) c) d) e) g""",
)
V["lcontext"] = (
    ("rerank", "prof", "asks"),
    """SELECT *, CASE WHEN rejected IS NULL THEN peer END AS peer_price, CASE WHEN rejected IS NOT NULL THEN rejected
  WHEN peer IS NOT NULL THEN CASE WHEN n < greatest(1, least(3, raw)) THEN 'usable_but_thin' ELSE 'usable' END WHEN raw <= 0 THEN 'no_neighbors' WHEN n <= 0 THEN 'all_neighbors_filtered' ELSE 'insufficient_evidence' END AS status
FROM (SELECT *, CASE WHEN peer IS NULL OR coalesce(listing_price, 0) <= 0 OR is_accessory THEN NULL WHEN n < 3 THEN 'insufficient_peer_neighbors' WHEN listing_price >= 40 AND peer / listing_price < 0.18 THEN 'implausibly_low_peer_price' END AS rejected
  FROM (SELECT p.query_id, p.is_accessory, p.item + coalesce(p.ship, 0) AS listing_price, coalesce(r.raw, 0) AS raw, coalesce(r.n, 0) AS n, r.peer, coalesce(r.s, 0.0) AS s
    FROM prof p JOIN asks a ON a.parent_asin = p.query_id LEFT JOIN (SELECT query_id, count(*) AS raw, count(*) FILTER (place <= 5) AS n,
      sum(price * similarity) FILTER (place <= 5) / sum(similarity) FILTER (place <= 5) AS peer, avg(similarity) FILTER (place <= 5) AS s FROM rerank GROUP BY 1) r ON r.query_id = p.query_id) x) y""",
)
V["lbase"] = (
    ("cand", "lcontext"),
    """SELECT *, CASE WHEN got THEN rpeer ELSE manual END AS peer_price, CASE WHEN got THEN 'retrieval' WHEN manual IS NOT NULL THEN 'manual' ELSE 'none' END AS peer_price_source,
  CASE WHEN got THEN TRUE WHEN failed THEN FALSE ELSE manual IS NOT NULL END AS price_considered, CASE WHEN failed THEN 'fair' END AS dflt
FROM (SELECT c.k, c.query_id, c.source_url, c.title, c.item + coalesce(c.ship, 0) AS price, coalesce(c.cur, c.shipcur) AS total_price_currency, c.rating AS average_rating, CAST(c.p_size AS DOUBLE) AS rating_count,
  CAST(NULL AS DOUBLE) AS verified_purchase_rate, c.warranty AS warranty_months, c.return_days AS return_window_days,
  CASE WHEN c.k % 4 <> 0 THEN CAST((c.k * 13) % 101 AS DOUBLE) END AS ewom_score_0_to_100, CASE WHEN c.k % 4 <> 0 THEN CAST((c.k * 29) % 101 AS DOUBLE) END AS ewom_magnitude_0_to_100,
  CASE WHEN c.k % 4 <> 0 THEN c.k % 12 + 1 END AS seller_feedback_review_count, CASE WHEN c.k % 3 <> 0 THEN ((c.k * 17) % 100) / 99.0 END AS trust_probability,
  CASE WHEN c.k % 3 <> 0 THEN 'ok' ELSE 'error' END AS listing_trust_status, CASE c.k % 3 WHEN 1 THEN 'logistic' WHEN 2 THEN 'graph' END AS listing_trust_score_head,
  CASE WHEN c.k % 9 = 0 THEN 700.0 + (c.k * 31) % 500 END AS manual, x.peer_price AS rpeer, x.status, x.n AS retrieved_neighbor_count,
  coalesce(x.peer_price IS NOT NULL AND x.status = 'usable', FALSE) AS got, coalesce(x.status <> 'usable', FALSE) AS failed
FROM cand c LEFT JOIN lcontext x USING (query_id)) q""",
)
VALUED = f"""WITH {posterior_ctes()},
e1 AS MATERIALIZED ({evidence_sql('lbase', 'dflt')}), e2 AS MATERIALIZED ({evidence_sql('(SELECT * REPLACE (CAST(NULL AS DOUBLE) AS peer_price) FROM lbase)', chr(39) + 'fair' + chr(39))}),
{posterior_sql('e1', 'k')}, {posterior_sql('e2', 'k', 'n_')},
valued AS MATERIALIZED (SELECT e.*, p.good_value_probability, q.good_value_probability AS neutral_probability,
  CASE WHEN p.good_value_probability >= 0.5 THEN 'good_value' ELSE 'not_good_value' END AS label,
  CASE WHEN NOT price_considered AND failed THEN 'bayesian_probability_without_price'
    WHEN status IS NOT NULL AND (peer_price_source = 'none' OR (peer_price_source = 'retrieval' AND status <> 'usable')) THEN status ELSE 'bayesian_probability' END AS reason
  FROM e1 e JOIN post p ON p.k = e.k JOIN n_post q ON q.k = e.k),
v AS MATERIALIZED (SELECT *, CASE WHEN reason LIKE 'bayesian%' THEN label ELSE 'insufficient_evidence' END AS prediction FROM valued)"""
V["pairs"] = (
    (),
    """SELECT l_orderkey * 8 + r AS pair_id, CAST(l_partkey AS VARCHAR) AS id_a, CAST(nxt AS VARCHAR) AS id_b FROM (
  SELECT *, row_number() OVER w AS r, lead(l_partkey) OVER w AS nxt FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) d
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey)) q WHERE nxt IS NOT NULL""",
)
VERDICTS = VALUED + """,
sides AS (SELECT *, CASE WHEN neutral THEN an ELSE ap0 END AS a_p, CASE WHEN neutral THEN bn ELSE bp0 END AS b_p, CASE WHEN neutral THEN NULL ELSE ag0 END AS ag, CASE WHEN neutral THEN NULL ELSE bg0 END AS bg
FROM (SELECT p.*, a.neutral_probability AS an, b.neutral_probability AS bn, a.good_value_probability AS ap0, b.good_value_probability AS bp0, a.price_gap_vs_peer AS ag0, b.price_gap_vs_peer AS bg0,
  a.prediction AS apr, b.prediction AS bpr, NOT ((a.peer_price_source = 'manual' OR (a.peer_price_source = 'retrieval' AND a.status = 'usable')) AND (b.peer_price_source = 'manual' OR (b.peer_price_source = 'retrieval' AND b.status = 'usable'))) AS neutral
  FROM pairs p JOIN v a ON a.query_id = p.id_a JOIN v b ON b.query_id = p.id_b) s),
judged AS (SELECT *, CASE WHEN neutral THEN 'neutral_fallback' ELSE 'peer_price' END AS price_comparison_mode, a_p - b_p AS delta,
  CASE WHEN NOT neutral AND (apr = 'insufficient_evidence' OR bpr = 'insufficient_evidence') THEN 'evidence' WHEN abs(a_p - b_p) <= 0.03 AND abs(ag - bg) > 0.02 THEN 'price_gap' WHEN abs(a_p - b_p) <= 0.03 THEN 'tie_margin' ELSE 'probability' END AS basis FROM sides),
verdicts AS (SELECT *, CASE basis WHEN 'evidence' THEN 'insufficient_evidence' WHEN 'price_gap' THEN CASE WHEN ag > bg THEN 'better_A' ELSE 'better_B' END WHEN 'tie_margin' THEN 'tie' ELSE CASE WHEN delta > 0 THEN 'better_A' ELSE 'better_B' END END AS verdict FROM judged)"""


def _rel(a: str, b: str, higher: bool, side: str) -> str:
    mine = a if side == "a" else b
    if higher:
        score = f"least(100.0, greatest(0.0, 100.0 * {mine} / greatest({a}, {b}, 1e-9)))"
    else:
        score = f"100.0 * least(greatest({a}, 1e-9), greatest({b}, 1e-9)) / greatest({mine}, 1e-9)"
    lo_a, lo_b = (45.0, 55.0) if side == "a" else (55.0, 45.0)
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 50.0 WHEN {a} IS NULL THEN {lo_a} WHEN {b} IS NULL THEN {lo_b} ELSE {score} END"


_cstop = views.quoted(terms.COMPARE_STOP)
_cwords = f"list_distinct(list_filter(string_split({key_sql('title')}, ' '), lambda t: length(t) > 1 AND NOT list_contains({_cstop}, t)))"
V["cmp_side"] = (
    (),
    f"""SELECT CAST(p_partkey AS VARCHAR) AS id, {_cwords.replace('title', _plain_title)} AS words, CASE p_partkey % 10 WHEN 0 THEN 'USD' WHEN 1 THEN '' ELSE 'SGD' END AS cur,
  CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 1.1 WHEN p_partkey % 6 <> 0 THEN greatest(0.0, p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 5.0 ELSE 0 END - CASE WHEN p_partkey % 7 = 0 THEN 20.0 ELSE 0 END) END AS total,
  p_partkey % 4 <> 0 AND p_partkey % 6 <> 0 AS est, CASE WHEN p_partkey % 5 <> 0 THEN 1.0 + p_partkey % 9 END AS deliv, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 3) * 12.0 END AS war, 30.0 AS ret,
  lower(p_brand) AS brand, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type, p_partkey % 5 = 0 AS note FROM part""",
)
_miss = lambda s: ", ".join([
    f"CASE WHEN {s}.total IS NULL THEN '{s}.total_price' END", f"CASE WHEN {s}.est THEN '{s}.total_price_estimated' END",
    f"CASE WHEN {s}.deliv IS NULL THEN '{s}.delivery_days' END", f"CASE WHEN {s}.war IS NULL THEN '{s}.warranty_months' END",
    f"CASE WHEN {s}.type IS NULL AND (a.type IS NOT NULL OR b.type IS NOT NULL) THEN '{s}.specs.type' END", f"CASE WHEN a.note OR b.note THEN '{s}.specs.note' END",
])
_bkey = lambda s: f"trim(regexp_replace({s}.brand, '[^a-z0-9 ]+', ' ', 'g'))"
_beq = f"regexp_replace(a.brand, '[^a-z0-9 ]+', ' ', 'g') = regexp_replace(b.brand, '[^a-z0-9 ]+', ' ', 'g')"
COMPARE = f"""WITH c AS (SELECT p.pair_id, a.words AS aw, b.words AS bw, a.cur AS ac, b.cur AS bc, a.est AS ae, b.est AS be, a.total AS ta, b.total AS tb,
  list_sort(list_filter([{_miss('a')}, {_miss('b')}], lambda x: x IS NOT NULL)) AS miss,
  {_rel('a.total', 'b.total', False, 'a')} AS cost_a, {_rel('a.total', 'b.total', False, 'b')} AS cost_b,
  ({_rel('a.deliv', 'b.deliv', False, 'a')} + {_rel('a.war', 'b.war', True, 'a')} + 100.0) / 3 AS service_a, ({_rel('a.deliv', 'b.deliv', False, 'b')} + {_rel('a.war', 'b.war', True, 'b')} + 100.0) / 3 AS service_b,
  2 + CASE WHEN a.type IS NOT NULL OR b.type IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.note OR b.note THEN 1 ELSE 0 END AS nk,
  2 + CASE WHEN a.type IS NOT NULL THEN 1 ELSE 0 END AS pa, 2 + CASE WHEN b.type IS NOT NULL THEN 1 ELSE 0 END AS pb,
  2 + CASE WHEN a.type IS NOT NULL AND b.type IS NOT NULL THEN 1 ELSE 0 END AS nc,
  CASE WHEN {_beq} THEN 100.0 ELSE 50.0 END + CASE WHEN a.type IS NULL OR b.type IS NULL THEN 0.0 WHEN a.type = b.type THEN 100.0 ELSE 50.0 END + 100.0 * a.size / greatest(a.size, b.size) AS ea,
  CASE WHEN {_beq} THEN 100.0 ELSE 50.0 END + CASE WHEN a.type IS NULL OR b.type IS NULL THEN 0.0 WHEN a.type = b.type THEN 100.0 ELSE 50.0 END + 100.0 * b.size / greatest(a.size, b.size) AS eb,
  CASE WHEN {_beq} THEN 1 ELSE 0 END + CASE WHEN a.size = b.size THEN 1 ELSE 0 END + CASE WHEN a.type = b.type THEN 1 ELSE 0 END + CASE WHEN a.note AND b.note THEN 1 ELSE 0 END AS eq,
  2 + CASE WHEN a.type IS NOT NULL AND b.type IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.note AND b.note THEN 1 ELSE 0 END AS sh
  FROM pairs p JOIN cmp_side a ON a.id = p.id_a JOIN cmp_side b ON b.id = p.id_b),
d AS (SELECT *, (pa / nk + pb / nk) / 2 AS cov, 100 * (0.7 * pa / nk + 0.3 * ea / nc / 100) AS sa, 100 * (0.7 * pb / nk + 0.3 * eb / nc / 100) AS sb,
  0.5 * CASE WHEN len(aw) + len(bw) = 0 THEN 0.5 ELSE len(list_intersect(aw, bw)) / len(list_distinct(aw || bw)) END + 0.5 * eq / sh AS cmp FROM c),
e AS (SELECT *, 0.6 * cost_a + 0.25 * sa + 0.15 * service_a AS va, 0.6 * cost_b + 0.25 * sb + 0.15 * service_b AS vb,
  round(least(1.0, greatest(0.0, 1 - least(0.55, 0.03 * len(miss)) - CASE WHEN ta IS NULL THEN 0.12 ELSE 0 END - CASE WHEN tb IS NULL THEN 0.12 ELSE 0 END - CASE WHEN ae THEN 0.06 ELSE 0 END - CASE WHEN be THEN 0.06 ELSE 0 END
    - CASE WHEN ac <> '' AND bc <> '' AND ac <> bc THEN 0.2 ELSE 0 END - CASE WHEN cmp < 0.6 THEN 0.3 * (0.6 - cmp) / 0.6 ELSE 0 END - CASE WHEN cov < 0.8 THEN 0.2 * (0.8 - cov) / 0.8 ELSE 0 END)), 12) AS conf FROM d)
SELECT pair_id, CASE WHEN conf < 0.45 THEN 'insufficient_evidence' WHEN abs(va - vb) <= 3 THEN 'tie' WHEN va > vb THEN 'better_A' ELSE 'better_B' END AS verdict,
  round(round(va, 2), 1) AS value_score_a, round(round(vb, 2), 1) AS value_score_b, round(round(cost_a, 2), 1) AS cost_a, round(round(cost_b, 2), 1) AS cost_b, round(round(service_a, 2), 1) AS service_a,
  round(round(service_b, 2), 1) AS service_b, round(round(conf, 9), 3) AS confidence, array_to_string(miss, ',') AS missing_fields FROM e"""

_toks = lambda c, name: f"array_to_string(list_sort({c}), ',') AS {name}"
ORACLES = {
    "url_parts": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'listing' WHEN 1 THEN 'product_page' ELSE 'unknown' END AS page_type,
CASE page_id % 3 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN CAST(page_id * 3 AS VARCHAR) END AS legacy_item_id, CASE WHEN page_id % 3 = 1 THEN CAST(page_id AS VARCHAR) END AS epid FROM pages""",
    "accessory_flag": sql(["meta"], f"SELECT parent_asin, {accessory_sql('t')} AS accessory FROM (SELECT parent_asin, {key_sql('title')} AS t FROM meta) m"),
    "product_kind": sql(["meta"], f"SELECT parent_asin, {pkind_sql('t')} AS kind FROM (SELECT parent_asin, {rtokens_sql(key_sql('title'))} AS t FROM meta) m"),
    "clean_title": sql(["cand"], f"SELECT k, {ctitle_sql('title')} AS title FROM cand"),
    "total_price": sql(["cand"], "SELECT k, round(item + coalesce(ship, 0), 6) AS total, round(coalesce(usd, item) + coalesce(ship, 0), 6) AS total_usd, round(item, 6) AS item_only, coalesce(cur, shipcur) AS currency, CASE WHEN usd IS NOT NULL THEN 'USD' ELSE coalesce(cur, shipcur) END AS currency_usd FROM cand"),
    "durations": sql(["cand"], "SELECT k, CAST(return_days AS DOUBLE) AS return_window_days, round(CAST(warranty AS DOUBLE), 6) AS warranty_months FROM cand"),
    "listing_normalised": f"""SELECT 'https://shop.example/itm/' || k AS source_url, 'listing' AS page_type, CAST(k AS VARCHAR) AS legacy_item_id, 'v1|' || k || '|0' AS rest_item_id,
CASE WHEN k % 6 = 0 THEN CAST(k AS VARCHAR) END AS product_id, title, CASE WHEN k % 3 = 0 THEN 'u' ELSE 's' || p_size END AS seller_id, CAST(p_retailprice AS VARCHAR) AS price_value,
CASE WHEN k % 7 <> 0 THEN CAST(4.5 AS DOUBLE) END AS product_average_rating, CAST(12 AS BIGINT) AS product_rating_count,
concat_ws(' / ', CASE WHEN k % 4 = 0 THEN 'Short note' END, 'Brand: ' || p_brand, CASE WHEN k % 5 = 0 THEN 'MPN: M' || p_size END, 'Size: large, L') AS bullets,
concat_ws(' ', CASE WHEN k % 4 = 0 THEN 'Short note' ELSE 'Key listing details: ' || concat_ws('; ', 'Brand: ' || p_brand, CASE WHEN k % 5 = 0 THEN 'MPN: M' || p_size END, 'Size: large, L') END, CASE WHEN k % 2 = 0 THEN 'Condition: New' END) AS listing_description,
CASE WHEN k % 6 = 0 THEN 'epid:' || k WHEN k % 5 = 0 THEN 'brand_mpn:' || lower(p_brand) || '::m' || p_size ELSE 'title:' || {key_sql('title')} END AS product_family_key,
CASE WHEN k % 5 = 0 THEN 'Brand,MPN,Size' ELSE 'Brand,Size' END AS specific_names
FROM (SELECT *, p_partkey AS k, {_plain_title} AS title FROM part) p""",
    "retrieval_profile": sql(["prof"], f"SELECT k, brand, rtitle AS retrieval_title, document AS product_document, {_toks('ident', 'identity_tokens')}, {_toks('core', 'core_identity_tokens')}, {_toks('required', 'required_identity_tokens')}, pkind AS product_kind, is_accessory FROM prof"),
    "query_rows": sql(
        ["prof"],
        f"""SELECT CASE WHEN k % 5 <> 0 THEN 'key:' || k ELSE CAST(k AS VARCHAR) END AS parent_asin, rtitle AS title, coalesce(brand, '') AS store, {kind_sql('tk', "''", 'ck')} AS listing_kind,
round(item + coalesce(ship, 0), 6) AS price, round(CAST(rating AS DOUBLE), 6) AS average_rating, CAST(p_size AS DOUBLE) AS rating_number, CAST(p_size AS BIGINT) AS review_count
FROM (SELECT *, {key_sql('rtitle')} AS tk, {key_sql("rtitle || ' ' || flat")} AS ck FROM prof) p""",
    ),
    "trust_payload": sql(
        ["cand"],
        f"""SELECT CAST(k AS VARCHAR) AS product_id, title, CASE WHEN k % 9 = 0 THEN 'one; two' ELSE concat_ws('; ', 'Brand: ' || brand_given, 'Type: ' || type, 'Model: ' || model,
  CASE k % 3 WHEN 0 THEN 'Manufacturer Warranty: 2 years' WHEN 1 THEN 'Manufacturer Warranty: n/a, 90 days' END) END AS bullet_points,
CASE WHEN k % 9 = 1 THEN 'A described item' ELSE 'Condition: ' || condition || CASE WHEN k % 4 = 0 THEN ' Return window: 30 day' ELSE '' END END AS description, CAST(NULL AS VARCHAR) AS error FROM cand""",
    ),
    "group_representative": """SELECT group_id, seq, title, price_value FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY a DESC, c, length(title) DESC, seq) AS r FROM (
SELECT l_orderkey AS group_id, l_partkey * 100000 + l_linenumber * 1000 + l_suppkey AS seq, 'item ' || l_partkey AS title, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_quantity AS VARCHAR) ELSE '?' END AS price_value,
CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS a, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(round_even(l_quantity * 100, 0) AS BIGINT) ELSE 1000000000 END AS c FROM lineitem) i) q WHERE r = 1""",
    "neighbor_rerank": sql(["rerank"], "SELECT query_id, parent_asin, round(match_score, 6) AS match_score, reason AS rejection_reason, CAST(place AS INT) AS place FROM rerank"),
    "rejection_summary": sql(["rerank"], "SELECT query_id, reason AS rejection_reason, count(*) AS rejected FROM rerank WHERE reason IS NOT NULL GROUP BY ALL"),
    "first_rejected": sql(["rerank"], "SELECT query_id, CAST(r AS INT) AS rank, parent_asin, reason AS rejection_reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM rerank WHERE reason IS NOT NULL) q WHERE r <= 10"),
    "retrieval_status": sql(["lcontext"], "SELECT query_id, raw AS raw_neighbor_count, n AS neighbor_count, status AS retrieval_status, round(listing_price, 6) AS listing_price, round(peer_price, 6) AS peer_price, round(s, 6) AS average_neighbor_similarity FROM lcontext"),
    "k_sweep": sql(
        ["rerank"],
        """SELECT query_id, CAST(k AS INT) AS k, round(sum(price * similarity) / sum(similarity), 6) AS peer_price, CAST(count(*) AS INT) AS neighbor_count, round(avg(similarity), 6) AS average_neighbor_similarity,
string_agg(format('{:.2f}', price), ',' ORDER BY place) AS neighbor_prices FROM rerank, (VALUES (1), (3), (5)) v(k) WHERE place <= k GROUP BY query_id, k""",
    ),
    "listing_value": sql(
        ["lbase"],
        VALUED + f""" SELECT source_url, title, round(price, 6) AS total_price, total_price_currency, {r6('peer_price', 'price_gap_vs_peer', 'good_value_probability', 'trust_probability', 'ewom_score_0_to_100')}, prediction,
  reason AS prediction_reason, listing_trust_status, listing_trust_score_head, round(tg, 6) AS listing_trust_probability_graph, round(tl, 6) AS listing_trust_probability_logistic,
  round(1 - coalesce(tl, tg), 6) AS listing_deception_probability, round(1 - tg, 6) AS listing_deception_probability_graph, round(1 - tl, 6) AS listing_deception_probability_logistic, seller_feedback_review_count, status AS retrieval_status, retrieved_neighbor_count, price_considered,
  CASE WHEN failed THEN '{L.NO_PRICE_NOTE}' END AS price_note, peer_price_source
  FROM (SELECT *, CASE k % 3 WHEN 1 THEN ((k * 23) % 100) / 99.0 WHEN 2 THEN ((k * 17) % 100) / 99.0 END AS tg, CASE WHEN k % 3 = 1 THEN ((k * 17) % 100) / 99.0 END AS tl FROM v) v""",
    ),
    "pair_verdict": sql(["lbase", "pairs"], VERDICTS + f" SELECT pair_id, id_a, id_b, price_comparison_mode, round(delta, 6) AS good_value_probability_delta, verdict, basis, {r6('a_p', 'b_p')} FROM verdicts"),
    "explanations": sql(
        ["lbase", "pairs"],
        VERDICTS + """ SELECT pair_id, CASE verdict WHEN 'better_A' THEN 'Listing A is the better buy' WHEN 'better_B' THEN 'Listing B is the better buy' WHEN 'tie' THEN 'Too close to call' ELSE 'Not enough evidence for a verdict' END AS title,
  4 AS paragraphs, CASE WHEN neutral THEN 'Check the price by hand; peers were scarce.' ELSE 'Ask why the cheaper one is cheaper.' END AS third_watchout, TRUE AS has_percent FROM verdicts""",
    ),
    "listing_compare": sql(["pairs", "cmp_side"], COMPARE),
    "explanation_check": """SELECT doc_id, CASE WHEN bad THEN 'not_an_object' WHEN doc_id % 4 = 0 THEN 'no_title' WHEN doc_id % 5 = 0 THEN 'too_few_paragraphs' WHEN doc_id % 3 <> 0 THEN 'too_short' WHEN doc_id % 2 <> 0 THEN 'too_few_watchouts' END AS reject_reason,
CASE WHEN bad OR doc_id % 4 = 0 THEN '' ELSE source END AS title, CAST(CASE WHEN bad THEN 0 WHEN doc_id % 5 = 0 THEN 2 ELSE 4 END AS INT) AS paragraphs,
CAST(CASE WHEN bad THEN 0 WHEN doc_id % 5 = 0 THEN 2 * w ELSE 4 * w + 1 END AS INT) AS word_count FROM (SELECT *, doc_id % 7 = 0 AS bad, CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 2 END AS w FROM documents) d""",
}
