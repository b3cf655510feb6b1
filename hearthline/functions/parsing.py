"""Text to typed values. Nothing here can fail a job: bad text becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE_SUFFIX = r"(Z|z|[+-]\d{2}:?\d{2})$"


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The frame plus columns that are worked out once per row: filters on them are not pushed below the generator, where
    they would repeat the expressions once for each mention."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def clean_null(text: Column) -> Column:
    """Trimmed text; blank, "unknown" and "auto" are missing."""
    t = F.trim(text)
    return F.when((F.length(t) > 0) & ~F.lower(t).isin("unknown", "auto"), t)


def blank_to_null(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > 0, t)


def parse_ts(text: Column) -> Column:
    """ISO-8601 text with a zone -> instant; zone-less or malformed text -> null."""
    t = F.trim(text)
    colon = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    # most text ends in Z and needs no rewriting
    return F.when(F.endswith(t, F.lit("Z")), F.when(t.rlike(r"\d{2}:\d{2}"), F.try_to_timestamp(t))).otherwise(
        F.when(t.rlike(r"\d{2}:\d{2}.*" + ZONE_SUFFIX), F.try_to_timestamp(colon))
    )


def parse_float(text: Column) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_days(text: Column) -> Column:
    """First whole number in the text."""
    t = F.lower(F.trim(text))
    return F.when(t != "unknown", F.nullif(F.regexp_extract(t, r"\d+", 0), F.lit(""))).try_cast(
        "int"
    )


def parse_verified(text: Column) -> Column:
    """One reading of the verified flag everywhere: missing counts as verified."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(True))


def band_midpoint(text: Column) -> Column:
    """Money band in millions: 50-80m, 1-2b, <50m, 100m+, 75m; "b" means thousands."""
    t = F.regexp_replace(F.lower(F.trim(text)), " ", "")
    scale = F.when(F.contains(t, F.lit("b")), 1000.0).otherwise(1.0)
    number = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    first = F.try_element_at(number, F.lit(1)).try_cast("double")
    second = F.try_element_at(number, F.lit(2)).try_cast("double")
    return F.when(
        t != "unknown",
        F.when(second.isNotNull(), (first + second) / 2 * scale)
        .when(F.startswith(t, F.lit("<")), first * 0.8 * scale)
        .when(F.contains(t, F.lit("+")), first * 1.2 * scale)
        .otherwise(first * scale),
    )


def one_of(text: Column, allowed: tuple[str, ...]) -> Column:
    """The text if it belongs to the closed domain, else null."""
    return F.when(text.isin(*allowed), text)


def known(value: Column) -> Column:
    """Present and neither blank nor "unknown"; never null."""
    return F.coalesce(value.isNotNull() & ~value.isin("", "unknown"), F.lit(False))


def filled(value: Column) -> Column:
    """Present and not blank; never null."""
    return F.coalesce(value != "", F.lit(False))
