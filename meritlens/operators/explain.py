"""Explanation rows for compared pairs, and the check of explanations written elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, null_if_blank


def percent(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").otherwise(
        F.concat(F.bround(F.abs(F.round(c, 4)) * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    )


def score_text(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").otherwise(F.format_string("%.1f/100", F.round(c, 1)))


def money_text(value: Column, currency: Column) -> Column:
    amount = F.format_string("%.2f", F.round(value, 2))
    return F.when(value.isNull(), "unknown").otherwise(F.concat_ws(" ", F.nullif(F.trim(currency), F.lit("")), amount))


def gap_text(c: Column) -> Column:
    r = F.round(c, 4)
    return (
        F.when(r.isNull(), "no market gap known")
        .when(F.abs(r) < 0.001, "at market level")
        .when(r > 0, F.concat(percent(r), F.lit(" below market")))
        .otherwise(F.concat(percent(r), F.lit(" above market")))
    )


def explanations(verdicts: DataFrame) -> DataFrame:
    """Title, lead, four paragraphs and three watch-outs per pair, by verdict and price mode.

    Needs the columns of ``pair_verdicts`` plus, per side, price, peer_price, currency, trust,
    review score, review count, neighbour count and retrieval status (a_* and b_*).
    """
    v = F.col("verdict")
    name = {s: F.coalesce(null_if_blank(F.col(f"{s}_title")), F.lit(f"Listing {s.upper()}")) for s in "ab"}
    p = {s: percent(F.col(f"{s}_p")) for s in "ab"}
    winner, loser = F.when(v == "better_A", name["a"]).otherwise(name["b"]), F.when(v == "better_A", name["b"]).otherwise(name["a"])
    wp, lp = F.when(v == "better_A", p["a"]).otherwise(p["b"]), F.when(v == "better_A", p["b"]).otherwise(p["a"])
    won = v.isin("better_A", "better_B")
    both = lambda t: F.concat(name["a"], F.lit(" and "), name["b"], F.lit(t))
    title = (
        F.when(v == "better_A", "Listing A is the better buy")
        .when(v == "better_B", "Listing B is the better buy")
        .when(v == "tie", "Too close to call")
        .otherwise("Not enough evidence for a verdict")
    )
    lead = (
        F.when(won, F.concat(winner, F.lit(" leads once value, trust and market support are weighed together.")))
        .when(v == "tie", both(" rank so close that either can be chosen; look for other differences."))
        .otherwise("The signals point in a direction, yet they do not carry a recommendation.")
    )
    first = (
        F.when(won, F.concat(winner, F.lit(" has a good-value probability of "), wp, F.lit(" against "), lp, F.lit(" for "), loser,
                             F.lit(", a lead of "), percent(F.col("good_value_probability_delta")), F.lit(".")))
        .when(v == "tie", F.concat(F.lit("Good-value probability is "), p["a"], F.lit(" and "), p["b"], F.lit(", a practical draw.")))
        .otherwise(F.concat(F.lit("The scores read "), p["a"], F.lit(" and "), p["b"], F.lit(", but their basis is incomplete.")))
    )
    neutral = F.col("price_comparison_mode") == "neutral_fallback"

    def priced(s: str) -> Column:
        return F.concat(
            name[s], F.lit(" asks "), money_text(F.col(f"{s}_price"), F.col(f"{s}_total_price_currency")), F.lit(" where peers cost "),
            money_text(F.col(f"{s}_peer_price"), F.col(f"{s}_total_price_currency")), F.lit(" ("), gap_text(F.col(f"{s}_gap")), F.lit(")"),
        )

    second = F.when(
        neutral, "One side has no solid peer price, so price was held neutral; check the asking prices yourself."
    ).otherwise(F.concat(priced("a"), F.lit("; "), priced("b"), F.lit(".")))

    def signals(s: str) -> Column:
        return F.concat(
            name[s], F.lit(" has listing trust "), percent(F.col(f"{s}_trust_probability")), F.lit(" and review score "),
            score_text(F.col(f"{s}_ewom_score_0_to_100")), F.lit(" from "),
            F.coalesce(F.col(f"{s}_seller_feedback_review_count").cast("string"), F.lit("0")), F.lit(" reviews"),
        )

    third = F.concat(signals("a"), F.lit("; "), signals("b"), F.lit("."))

    def matches(s: str) -> Column:
        return F.concat(
            F.coalesce(F.col(f"{s}_retrieved_neighbor_count").cast("string"), F.lit("0")), F.lit(" matches ("),
            F.coalesce(null_if_blank(F.col(f"{s}_retrieval_status")), F.lit("limited")), F.lit(")"),
        )

    basis = F.concat(F.lit("Market support: A "), matches("a"), F.lit(", B "), matches("b"), F.lit(". "))
    fourth = F.concat(
        basis,
        F.when(v == "tie", "Let condition, extras or return terms decide.")
        .when(v == "insufficient_evidence", "Use this to narrow the choice, not to settle it.")
        .otherwise("Photos, contents and warranty terms can still change the picture."),
    )
    watchouts = F.array(
        F.lit("Compare photos, condition and what is in the box."),
        F.lit("Read the shipping and return terms."),
        F.when(neutral, "Check the price by hand; peers were scarce.").otherwise("Ask why the cheaper one is cheaper."),
    )
    return verdicts.withColumn(
        "explanation",
        F.struct(
            title.alias("title"), lead.alias("lead"), F.array(first, second, third, fourth).alias("paragraphs"),
            watchouts.alias("watchouts"),
        ),
    )


def checked_explanations(df: DataFrame, payload: str = "payload", min_paragraphs: int = 4, min_words: int = 120, min_watchouts: int = 3) -> DataFrame:
    """Normalise explanation JSON and say whether it is complete enough to show."""
    step = df.withColumn("_m", F.from_json(payload, "map<string,string>")).withColumn("_e", F.map_entries("_m"))

    def pick(*names: str) -> Column:
        found = []
        for n in names:
            found.append(F.try_element_at(F.col("_m"), F.lit(n)))
            found.append(F.try_element_at(F.filter("_e", _named(n)), F.lit(-1))["value"])
        return F.coalesce(*found)

    def listed(raw: Column) -> Column:
        items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, "\n"))
        return F.coalesce(F.filter(F.transform(items, clean), lambda t: t != ""), F.array().cast("array<string>"))

    step = step.withColumns(
        {
            "title": clean(pick("title", "headline", "heading")),
            "lead": clean(pick("lead", "summary", "intro")),
            "paragraphs": listed(pick("paragraphs", "body", "narrative", "sections")),
            "watchouts": listed(pick("watchouts", "cautions", "risks", "checks")),
        }
    )
    words = F.aggregate("paragraphs", F.lit(0), lambda acc, t: acc + F.size(F.split(t, " ")))
    return step.withColumns(
        {
            "word_count": words,
            "reject_reason": F.when(F.col("_m").isNull(), "not_an_object")
            .when(F.col("title") == "", "no_title")
            .when(F.col("lead") == "", "no_lead")
            .when(F.size("paragraphs") < min_paragraphs, "too_few_paragraphs")
            .when(words < min_words, "too_short")
            .when(F.size("watchouts") < min_watchouts, "too_few_watchouts"),
            "paragraphs": F.slice("paragraphs", 1, min_paragraphs),
            "watchouts": F.slice("watchouts", 1, min_watchouts),
        }
    ).drop("_m", "_e")


def _named(name: str):
    def test(e: Column) -> Column:
        return F.lower(F.trim(e["key"])) == name

    return test
