"""Household attributes from as-of feature values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions.parsing import (
    band_midpoint, known, one_of, parse_days, parse_float,
)
from hearthline.schemas import (
    CHILDREN_BANDS, HOUSEHOLD_FIELDS, PRODUCT_TYPES, PURPOSES, SIZE_BANDS,
)

PROFILE_COLUMNS = (
    "purchase_purpose", "household_size_band", "children_band", "income_midpoint_million",
    "liquid_capital_million", "max_monthly_payment_million", "purchase_horizon_days",
    "workplace_zone", "commute_tolerance_min", "preferred_product_type", "profile_confidence",
)


def profile_confidence(get: Callable[[str], Column]) -> Column:
    """Share of the ten household fields that are known."""
    hits = sum((known(get(f)).cast("int") for f in HOUSEHOLD_FIELDS), F.lit(0))
    return hits / F.lit(float(len(HOUSEHOLD_FIELDS)))


def household_from_features(get: Callable[[str], Column]) -> list[Column]:
    """Typed household columns; `get(name)` yields the raw text of a feature."""

    def domain(name: str, allowed: tuple[str, ...]) -> Column:
        return F.coalesce(one_of(get(name), allowed), F.lit("unknown")).alias(name)

    zone = get("workplace_zone")
    return [
        domain("purchase_purpose", PURPOSES),
        domain("household_size_band", SIZE_BANDS),
        domain("children_band", CHILDREN_BANDS),
        band_midpoint(get("household_income_band")).alias("income_midpoint_million"),
        band_midpoint(get("liquid_capital_band")).alias("liquid_capital_million"),
        band_midpoint(get("max_monthly_payment_band")).alias("max_monthly_payment_million"),
        parse_days(get("purchase_horizon")).alias("purchase_horizon_days"),
        F.when(known(zone), zone).alias("workplace_zone"),
        parse_float(get("stated_max_travel_min")).alias("commute_tolerance_min"),
        one_of(get("preferred_product_type"), PRODUCT_TYPES).alias("preferred_product_type"),
        profile_confidence(get).alias("profile_confidence"),
    ]
