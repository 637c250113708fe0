"""Pairwise verdicts and feature-by-feature listing comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.numbers import clamp, finite
from ..functions.text import string_array, strip, text_or_blank
from .listings import USABLE

PRICE_GAP_MARGIN = 0.02
#: What is counted over the keys of two listings.
COUNTED = ("both", "has_a", "has_b", "shared", "same", "known")
#: Service terms of a listing, and whether more of one is better.
METRICS = (("delivery_days", False), ("warranty_months", True), ("return_window_days", True))
_SIDE = (
    "title", "source_url", "good_value_probability", "neutral_probability", "prediction", "prediction_reason",
    "price_gap_vs_peer", "peer_price_source", "retrieval_status",
)


def pair_sides(pairs: DataFrame, listings: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """pairs(pair_id, id_a, id_b) joined twice with the scored listings; columns a_* and b_*."""
    out = pairs
    for side in ("a", "b"):
        cols = [F.col(c).alias(f"{side}_{c}") for c in (*_SIDE, *extra) if c in listings.columns]
        out = out.join(listings.select(F.col(key).alias(f"id_{side}"), *cols), f"id_{side}")
    return out


def pair_verdicts(sides: DataFrame, threshold: float = 0.50, tie_margin: float = 0.03) -> DataFrame:
    """Which listing of a pair is the better value, with the reason.

    Unless both sides rest on a trusted price, both are compared at the neutral price.
    """
    def trusted(s: str) -> Column:
        source = F.coalesce(F.col(f"{s}_peer_price_source"), F.lit("none"))
        return (source == "manual") | ((source == "retrieval") & (F.coalesce(F.col(f"{s}_retrieval_status"), F.lit("")) == USABLE))

    neutral = ~(trusted("a") & trusted("b"))
    rows = sides.withColumn("_neutral", neutral)
    for s in ("a", "b"):
        p = F.when(F.col("_neutral"), F.col(f"{s}_neutral_probability")).otherwise(F.col(f"{s}_good_value_probability"))
        rows = rows.withColumns(
            {
                f"{s}_p": p,
                f"{s}_gap": F.when(~F.col("_neutral"), F.col(f"{s}_price_gap_vs_peer")),
                f"{s}_pred": F.when(
                    F.col("_neutral"), F.when(p >= threshold, "good_value").when(p.isNotNull(), "not_good_value")
                ).otherwise(F.col(f"{s}_prediction")),
            }
        )
    short_a, short_b = F.col("a_pred") == "insufficient_evidence", F.col("b_pred") == "insufficient_evidence"
    unknown = F.col("a_p").isNull() | F.col("b_p").isNull()
    delta = F.col("a_p") - F.col("b_p")
    close = F.abs(delta) <= max(0.0, tie_margin)
    gap_delta = F.col("a_gap") - F.col("b_gap")
    by_gap = close & (F.abs(gap_delta) > PRICE_GAP_MARGIN)
    insufficient = F.coalesce(short_a, F.lit(False)) | F.coalesce(short_b, F.lit(False)) | unknown
    rows = rows.withColumns(
        {
            "price_comparison_mode": F.when(F.col("_neutral"), "neutral_fallback").otherwise("peer_price"),
            "good_value_probability_delta": delta,
            "verdict": F.when(insufficient, "insufficient_evidence")
            .when(by_gap, F.when(gap_delta > 0, "better_A").otherwise("better_B"))
            .when(close, "tie")
            .when(delta > 0, "better_A")
            .otherwise("better_B"),
            "basis": F.when(insufficient, "evidence").when(by_gap, "price_gap").when(close, "tie_margin").otherwise("probability"),
        }
    )
    name = {s: F.coalesce(F.col(f"{s}_title"), F.col(f"{s}_source_url"), F.lit(f"listing {s.upper()}")) for s in "ab"}
    num = lambda c: F.format_string("%.4f", F.round(c, 4))
    a, b = F.col("a_p"), F.col("b_p")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_neutral"), "No trusted peer price on both sides; compared at a neutral price."),
            F.when((F.col("basis") == "evidence") & short_a, F.concat(F.lit("A: not enough price evidence, "), F.coalesce("a_prediction_reason", F.lit("unknown")))),
            F.when((F.col("basis") == "evidence") & short_b, F.concat(F.lit("B: not enough price evidence, "), F.coalesce("b_prediction_reason", F.lit("unknown")))),
            F.when((F.col("basis") == "evidence") & unknown, "A good-value probability is missing."),
            F.when(F.col("basis") == "price_gap", F.concat(F.lit("Equal probability; price gap decides: "), num(F.col("a_gap")), F.lit(" vs "), num(F.col("b_gap")))),
            F.when(F.col("basis") == "tie_margin", F.concat(name["a"], F.lit(" and "), name["b"], F.lit(" differ by "), num(F.abs(delta)))),
            F.when(F.col("basis") == "probability", F.concat(F.lit("Good-value probability: "), num(a), F.lit(" vs "), num(b))),
        )
    )
    return rows.withColumn("reasons", reasons).drop("_neutral")


@dataclass(frozen=True)
class CompareConfig:
    weight_cost: float = 0.60
    weight_spec: float = 0.25
    weight_service: float = 0.15
    tie_margin: float = 3.0
    min_confidence: float = 0.45
    low_comparability: float = 0.60


def _relative(a: Column, b: Column, higher: bool) -> tuple[Column, Column]:
    """Scores of two values against the better one; an unknown value loses slightly."""
    if higher:
        best = F.greatest(a, b, F.lit(1e-9))
        sa, sb = clamp(100.0 * a / best, 0.0, 100.0), clamp(100.0 * b / best, 0.0, 100.0)
    else:
        pa, pb = F.greatest(a, F.lit(1e-9)), F.greatest(b, F.lit(1e-9))
        low = F.least(pa, pb)
        sa, sb = clamp(100.0 * low / pa, 0.0, 100.0), clamp(100.0 * low / pb, 0.0, 100.0)
    none = a.isNull() & b.isNull()
    return (
        F.when(none, 50.0).when(a.isNull(), 45.0).when(b.isNull(), 55.0).otherwise(sa),
        F.when(none, 50.0).when(a.isNull(), 55.0).when(b.isNull(), 45.0).otherwise(sb),
    )


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " "), " +", " "))


def _title_words(c: Column) -> Column:
    words = F.filter(F.split(_plain(c), " "), lambda t: F.length(t) > 1)
    return F.array_except(words, string_array(terms.COMPARE_STOP))


def compared_side(x: Column) -> Column:
    """What ``compare_listings`` needs of a listing (title, currency, prices, policies, specs map), as a struct.

    A listing of many pairs has it made once, ahead of the join with them.
    """
    num = lambda n: finite(x[n])
    base, given = num("base_price"), num("total_price")
    estimate = F.greatest(
        base + F.coalesce(num("shipping_fee"), F.lit(0.0)) - F.coalesce(num("platform_discount"), F.lit(0.0))
        - F.coalesce(num("seller_discount"), F.lit(0.0)) - F.coalesce(num("voucher_discount"), F.lit(0.0)),
        F.lit(0.0),
    )
    specs = F.coalesce(F.map_filter(x["specs"], lambda k, v: F.trim(k) != ""), F.create_map().cast("map<string,string>"))
    return F.struct(
        F.when(given.isNotNull(), given).when(base.isNotNull(), estimate).alias("total"),
        (given.isNull() & base.isNotNull()).alias("estimated"),
        F.transform_values(
            specs, lambda k, v: F.struct((F.coalesce(v, F.lit("")) != "").alias("filled"), _plain(v).alias("plain"), finite(v).alias("number"))
        ).alias("specs"),
        F.array_join(_title_words(x["title"]), " ").alias("words"),
        F.upper(text_or_blank(x["currency"])).alias("currency"),
        *[num(n).alias(n) for n, _ in METRICS],
    )


def compare_listings(pairs: DataFrame, cfg: CompareConfig = CompareConfig()) -> DataFrame:
    """Cost, specification and service scores of two listings, confidence and verdict.

    pairs: structs ``a`` and ``b`` (title, currency, prices, policies, specs map, or what ``compared_side`` makes of those)
    and an optional ``required_spec_keys`` list.
    """
    rows = pairs
    for s in "ab":
        if "words" not in pairs.schema[s].dataType.names:
            rows = rows.withColumn(s, compared_side(F.col(s)))
        words = F.col(f"{s}.words")
        rows = rows.withColumns(
            {
                **{f"{s}_{n}": F.col(f"{s}.{n}") for n in ("total", "estimated", "specs", "currency")},
                f"{s}_words": F.when(words != "", F.split(words, " ")).otherwise(F.array().cast("array<string>")),
            }
        )
    required = (
        F.array_distinct(F.filter(F.transform("required_spec_keys", strip), lambda k: k != ""))
        if "required_spec_keys" in pairs.columns
        else F.array().cast("array<string>")
    )
    rows = rows.withColumn("_required", F.coalesce(required, F.array().cast("array<string>")))
    union = F.sort_array(F.array_union(F.map_keys("a_specs"), F.map_keys("b_specs")))
    rows = rows.withColumn("_union", union).withColumn(
        "_keys", F.when(F.size("_required") > 0, F.col("_required")).otherwise(F.col("_union"))
    )

    def spec(x: Column) -> Column:
        a, b = x["a"], x["b"]
        has_a, has_b = F.coalesce(a["filled"], F.lit(False)), F.coalesce(b["filled"], F.lit(False))
        pa, pb = F.coalesce(a["plain"], F.lit("")), F.coalesce(b["plain"], F.lit(""))
        na, nb = a["number"], b["number"]
        ra, rb = _relative(na, nb, True)
        same = (pa == pb) & (pa != "")
        both_numbers = na.isNotNull() & nb.isNotNull()
        return F.struct(
            x["key"].alias("key"), has_a.alias("has_a"), has_b.alias("has_b"), (has_a & has_b).alias("both"),
            F.when(both_numbers, ra).when(same, 100.0).otherwise(50.0).alias("score_a"),
            F.when(both_numbers, rb).when(same, 100.0).otherwise(50.0).alias("score_b"),
            (a.isNotNull() & b.isNotNull()).alias("shared"),
            (pa == pb).alias("equal"),
            (a.isNotNull() | b.isNotNull()).alias("known"),
        )

    def found(k: Column) -> Column:
        return F.struct(k.alias("key"), F.try_element_at("a_specs", k).alias("a"), F.try_element_at("b_specs", k).alias("b"))

    rows = rows.withColumn("_spec", F.transform(F.transform("_keys", found), spec))
    # One pass over the keys for all their counts and sums.
    zero = F.struct(*[F.lit(0.0).alias(n) for n in (*COUNTED, "score_a", "score_b")])
    rows = rows.withColumn("_sums", F.aggregate("_spec", zero, _summed))
    n_keys, compared = F.size("_keys"), F.col("_sums.both")
    out = {}
    for s in "ab":
        cover = F.try_divide(F.col(f"_sums.has_{s}"), n_keys)
        edge = F.coalesce(F.try_divide(F.col(f"_sums.score_{s}"), compared), F.lit(50.0))
        out[f"{s}_coverage"] = cover
        out[f"{s}_spec_score"] = F.when(n_keys == 0, 50.0).otherwise(
            clamp(100.0 * (0.7 * cover + 0.3 * edge / 100.0), 0.0, 100.0)
        )
    rows = rows.withColumns(out)
    coverage = F.coalesce((F.col("a_coverage") + F.col("b_coverage")) / 2.0, F.lit(0.0))

    cost = _relative(F.col("a_total"), F.col("b_total"), False)
    service = [F.lit(0.0), F.lit(0.0)]
    for name, higher in METRICS:
        pair = _relative(F.col(f"a.{name}"), F.col(f"b.{name}"), higher)
        service = [service[i] + pair[i] / 3.0 for i in (0, 1)]
    lost = []
    for s in "ab":
        lost += [
            F.when(F.col(f"{s}_total").isNull(), f"{s}.total_price"),
            F.when(F.size(F.map_keys(f"{s}_specs")) == 0, f"{s}.specs"),
            F.when(F.col(f"{s}_estimated"), f"{s}.total_price_estimated"),
            *[F.when(F.col(f"{s}.{n}").isNull(), f"{s}.{n}") for n, _ in METRICS],
        ]
    absent = [
        F.transform(F.filter("_spec", _lacks(s)), _named(s)) for s in "ab"
    ]
    ratio = F.coalesce(F.try_divide(F.col("_sums.same"), F.col("_sums.shared")), F.lit(0.5))
    # Words are distinct, so the size of their union follows from that of what both have.
    rows = rows.withColumn("_both", F.size(F.array_intersect("a_words", "b_words")))
    either = F.size("a_words") + F.size("b_words") - F.col("_both")
    words = F.when(either == 0, F.lit(0.5)).otherwise(F.col("_both") / F.greatest(either, F.lit(1)))
    rows = rows.withColumns(
        {
            "cost_a": cost[0], "cost_b": cost[1], "service_a": service[0], "service_b": service[1],
            "spec_coverage": coverage,
            "missing_fields": F.sort_array(F.array_distinct(F.concat(F.array_compact(F.array(*lost)), *absent))),
            "comparability_score": F.when(F.col("_sums.known") == 0, words).otherwise(clamp(0.5 * words + 0.5 * ratio)),
        }
    )
    c = F.col("comparability_score")
    mismatch = (F.col("a_currency") != "") & (F.col("b_currency") != "") & (F.col("a_currency") != F.col("b_currency"))
    confidence = F.lit(1.0) - F.least(F.lit(0.55), 0.03 * F.size("missing_fields"))
    for s in "ab":
        confidence = confidence - F.when(F.col(f"{s}_total").isNull(), 0.12).otherwise(0.0)
        confidence = confidence - F.when(F.col(f"{s}_estimated"), 0.06).otherwise(0.0)
    confidence = (
        confidence
        - F.when(mismatch, 0.20).otherwise(0.0)
        - F.when(c < cfg.low_comparability, 0.30 * (cfg.low_comparability - c) / cfg.low_comparability).otherwise(0.0)
        - F.when(F.col("spec_coverage") < 0.80, 0.20 * (0.80 - F.col("spec_coverage")) / 0.80).otherwise(0.0)
    )
    rows = rows.withColumns(
        {
            "value_score_a": cfg.weight_cost * F.col("cost_a") + cfg.weight_spec * F.col("a_spec_score") + cfg.weight_service * F.col("service_a"),
            "value_score_b": cfg.weight_cost * F.col("cost_b") + cfg.weight_spec * F.col("b_spec_score") + cfg.weight_service * F.col("service_b"),
            "confidence": F.round(clamp(confidence), 12),
        }
    )
    delta = F.col("value_score_a") - F.col("value_score_b")
    rows = rows.withColumn(
        "verdict",
        F.when(F.col("confidence") < cfg.min_confidence, "insufficient_evidence")
        .when(F.abs(delta) <= cfg.tie_margin, "tie")
        .when(delta > 0, "better_A")
        .otherwise("better_B"),
    )
    pa, pb = F.col("a_total"), F.col("b_total")
    saving = F.format_string("%.1f%%", 100.0 * F.abs(pa - pb) / F.greatest(pa, pb, F.lit(1e-9)))
    spec_gap = F.col("a_spec_score") - F.col("b_spec_score")
    service_gap = F.col("service_a") - F.col("service_b")
    reasons = F.array_compact(
        F.array(
            F.when(pa < pb, F.concat(F.lit("A costs less by "), saving))
            .when(pb < pa, F.concat(F.lit("B costs less by "), saving))
            .when(pa == pb, "Both cost the same"),
            F.when(F.abs(spec_gap) >= 2.0, F.when(spec_gap > 0, "A has the stronger specification").otherwise("B has the stronger specification")),
            F.when(F.abs(service_gap) >= 2.0, F.when(service_gap > 0, "A has the better service terms").otherwise("B has the better service terms")),
            F.when(
                F.size("missing_fields") > 0,
                F.concat(F.lit("Missing: "), F.array_join(F.slice("missing_fields", 1, 4), ", "), F.when(F.size("missing_fields") > 4, ", ...").otherwise("")),
            ),
            F.when(c < cfg.low_comparability, F.concat(F.lit("Low comparability "), F.format_string("%.2f", c))),
            F.when(F.col("verdict") == "insufficient_evidence", F.concat(F.lit("Low confidence "), F.format_string("%.2f", F.col("confidence")))),
        )
    )
    rows = rows.withColumn(
        "reasons", F.when(F.size(reasons) == 0, F.array(F.lit("The listings are close on all known signals"))).otherwise(F.slice(reasons, 1, 5))
    )
    keep = [x for x in pairs.columns if x not in ("a", "b", "required_spec_keys")]
    return rows.select(
        *keep,
        _rounded("value_score_a", 2), _rounded("value_score_b", 2), _rounded("confidence", 3), "verdict", "reasons",
        _rounded("cost_a", 2), _rounded("cost_b", 2), _rounded("a_spec_score", 2, "spec_a"),
        _rounded("b_spec_score", 2, "spec_b"), _rounded("service_a", 2), _rounded("service_b", 2),
        _rounded("comparability_score", 3), "missing_fields",
    )


def _rounded(name: str, digits: int, into: str | None = None) -> Column:
    """Round for show; the inner round takes summation noise off exact halves."""
    return F.round(F.round(name, 9), digits).alias(into or name)


def _lacks(side: str):
    def test(x: Column) -> Column:
        return ~x[f"has_{side}"]

    return test


def _named(side: str):
    def name(x: Column) -> Column:
        return F.concat(F.lit(f"{side}.specs."), x["key"])

    return name


def _summed(sums: Column, x: Column) -> Column:
    """Counts and sums with those of one more key."""
    flags = {n: x["shared"] & x["equal"] if n == "same" else x[n] for n in COUNTED}
    return F.struct(
        *[(sums[n] + flag.cast("double")).alias(n) for n, flag in flags.items()],
        *[(sums[n] + F.when(x["both"], x[n]).otherwise(0.0)).alias(n) for n in ("score_a", "score_b")],
    )
