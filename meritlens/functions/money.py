"""Money, shipping and policy durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite
from .text import strip

DURATION = r"(\d+(?:\.\d+)?)\s*(business\s+days?|days?|weeks?|months?|years?)"


def _converted_usd(money: Column) -> Column:
    value = finite(money["convertedFromValue"])
    return F.when(F.upper(F.trim(money["convertedFromCurrency"])) == "USD", value)


def money_value(money: Column, prefer_converted_usd: bool = False) -> Column:
    """Amount of a money struct; the converted US dollar amount first where asked for."""
    own = finite(money["value"])
    return F.coalesce(_converted_usd(money), own) if prefer_converted_usd else own


def money_currency(money: Column, prefer_converted_usd: bool = False) -> Column:
    own = F.nullif(F.upper(F.trim(F.coalesce(money["currency"], F.lit("")))), F.lit(""))
    if prefer_converted_usd:
        return F.when(_converted_usd(money).isNotNull(), "USD").otherwise(own)
    return own


def min_shipping(options: Column, prefer_converted_usd: bool = False) -> Column:
    """Cheapest shipping option; negative costs count as 0 and a priceless FREE option as 0."""
    def cost(option: Column) -> Column:
        amount = money_value(option["shippingCost"], prefer_converted_usd)
        free = F.when(F.lower(F.trim(option["shippingCostType"])) == "free", F.lit(0.0))
        return F.when(amount.isNotNull(), F.greatest(amount, F.lit(0.0))).otherwise(free)

    return F.array_min(F.filter(F.transform(options, cost), lambda v: v.isNotNull()))


def total_price(price: Column, shipping: Column, include_shipping: bool = True, prefer_converted_usd: bool = False) -> Column:
    item = money_value(price, prefer_converted_usd)
    if not include_shipping:
        return item
    return item + F.coalesce(min_shipping(shipping, prefer_converted_usd), F.lit(0.0))


def total_currency(price: Column, shipping: Column, prefer_converted_usd: bool = False) -> Column:
    found = F.filter(
        F.transform(shipping, lambda o: money_currency(o["shippingCost"], prefer_converted_usd)),
        lambda v: v.isNotNull(),
    )
    return F.coalesce(money_currency(price, prefer_converted_usd), F.try_element_at(found, F.lit(1)))


def unit_days(value: Column, unit: Column) -> Column:
    u = F.lower(strip(unit))
    return (
        F.when(u.startswith("business day") | u.startswith("day"), value)
        .when(u.startswith("week"), value * 7.0)
        .when(u.startswith("month"), value * 30.0)
        .when(u.startswith("year"), value * 365.0)
    )


def text_days(text: Column) -> Column:
    """First duration written in a text, in days."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    amount = F.regexp_extract(lowered, DURATION, 1).try_cast("double")
    return unit_days(amount, F.regexp_replace(F.regexp_extract(lowered, DURATION, 2), r"\s+", " "))


def struct_days(value: Column, unit: Column) -> Column:
    return F.when(F.coalesce(F.trim(unit), F.lit("")) != "", unit_days(finite(value), unit))


def first_list_days(values: Column) -> Column:
    """Days of the first entry of a text list that holds a duration."""
    days = F.filter(F.transform(values, text_days), lambda v: v.isNotNull())
    return F.try_element_at(days, F.lit(1))


def warranty_months(specifics: Column) -> Column:
    """Months from the first warranty or guarantee entry that holds a duration."""
    entries = F.filter(
        F.map_entries(specifics),
        lambda e: F.lower(e["key"]).contains("warranty") | F.lower(e["key"]).contains("guarantee"),
    )
    days = F.filter(F.transform(entries, lambda e: first_list_days(e["value"])), lambda v: v.isNotNull())
    return F.try_element_at(days, F.lit(1)) / 30.0
