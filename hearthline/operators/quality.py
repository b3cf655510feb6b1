"""Fail-closed data quality: rules produce violation rows, a gate turns rows into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.parsing import filled
from hearthline.schemas import UNIT

# Issue codes of a choice set.
SET_CODES = ("empty_choice_set", "missing_outside_option", "duplicate_alternative")


class DataQualityError(ValueError):
    """At least one error-severity violation reached a gate."""


def gate(violations: DataFrame, *, sample: int = 20) -> None:
    """Stop if any error exists; the text shows up to `sample` of them and how many there are.

    This is an action over all violations: call it at the border of a stage.
    """
    errors = violations.where(F.col("severity") == "error")
    total = errors.count()
    if total:
        rows = errors.limit(sample).collect()
        text = "; ".join(f"{r['code']}: {r['message']}" for r in rows)
        more = f" (first {len(rows)} of {total})" if total > len(rows) else ""
        raise DataQualityError(text + more)


def _emit(df: DataFrame, key: list[str], checks: list[tuple[str, Column, Column]]) -> DataFrame:
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(bad, F.lit(False)),
                    F.struct(F.lit(code).alias("code"), message.alias("message")),
                )
                for code, bad, message in checks
            ]
        )
    )
    return df.select(*key, F.inline(hits)).withColumn("severity", F.lit("error"))


def validate_choice_sets(sets: DataFrame, *, key: str = "set_id", at: str = "as_of") -> DataFrame:
    """Violations (key, code, message, severity) of packed sets; all checks stay inside a row."""
    alts = F.coalesce(F.col("alts"), F.array())
    ids = F.transform(alts, lambda a: a["alternative_id"])
    whole = _emit(
        sets, [key],
        [
            ("empty_choice_set", F.size(alts) == 0, F.lit("choice set is empty")),
            (
                "missing_outside_option",
                ~F.exists(alts, lambda a: a["outside_option"].isNotNull()),
                F.lit("choice set requires an outside option"),
            ),
            (
                "duplicate_alternative",
                F.size(F.array_distinct(ids)) != F.size(ids),
                F.lit("alternative ids must be unique"),
            ),
        ],
    )
    rows = sets.select(key, at, F.explode("alts").alias("a")).where(
        F.col("a.alternative_type") == UNIT
    )
    name = F.col("a.alternative_id")
    single = _emit(
        rows, [key],
        [
            (
                "unconfirmed_inventory", ~F.col("a.availability_confirmed"),
                F.concat(name, F.lit(" availability not confirmed")),
            ),
            (
                "unavailable_unit", F.col("a.inventory_state") != "available",
                F.concat(name, F.lit(" inventory_state="), F.col("a.inventory_state")),
            ),
            (
                "future_offer", F.col("a.offer_from") > F.col(at),
                F.concat(name, F.lit(" offer not effective yet")),
            ),
            (
                "expired_offer", F.col(at) >= F.col("a.offer_to"),
                F.concat(name, F.lit(" offer expired")),
            ),
            (
                "missing_provenance", ~filled(F.trim("a.offer_source")),
                F.concat(name, F.lit(" offer has no source")),
            ),
        ],
    )
    return whole.unionByName(single)


def _text(name: str) -> tuple[str, Column]:
    return f"{name} is required", ~filled(F.trim(name))


def _range(
    name: str, low: float | None, high: float | None = None, *, strict: bool = False
) -> tuple[str, Column]:
    c = F.col(name)
    bad = F.lit(False)
    if low is not None:
        bad = (c <= low) if strict else (c < low)
    if high is not None:
        bad = bad | (c > high)
    return f"{name} out of range", bad


# Record rules by table, as (message, violated).
def record_rules(table: str) -> list[tuple[str, Column]]:
    ordered = (
        "effective_to must be later than effective_from",
        F.col("effective_to") <= F.col("effective_from"),
    ) if table in ("unit_versions", "offers") else None
    if table == "events":
        return [_text(n) for n in (
            "event_type", "entity_type", "entity_id", "source_id", "source_event_key"
        )]
    if table == "source_snapshots":
        return [_text("source_id"), _text("content_hash"), _range("record_count", 0)]
    if table == "unit_versions":
        return [ordered, _text("source_id"), _range("lot_area_m2", 0, strict=True),
                _range("built_area_m2", 0, strict=True)]
    if table == "offers":
        return [ordered, _range("list_price", 0, strict=True),
                _range("net_price", 0, strict=True), _range("discount_pct", 0, 1),
                _range("incentive_cash", 0), _range("down_payment_pct", 0, 1),
                _range("monthly_payment_est", 0)]
    if table == "households":
        return [_range(n, 0) for n in (
            "income_midpoint_million", "liquid_capital_million", "max_monthly_payment_million",
            "purchase_horizon_days", "commute_tolerance_min",
        )] + [_range("profile_confidence", 0, 1)]
    if table == "feature_observations":
        return [_text("feature_name"), _text("source_id")]
    if table == "reason_observations":
        return [_range("confidence", 0, 1)]
    if table == "household_anchors":
        return [_text("anchor_id"), _text("source_id")]
    if table == "travel_times":
        return [
            ("valid_from must be before valid_to", F.col("valid_from") >= F.col("valid_to")),
            _text("source_id"), _range("travel_time_min", 0, strict=True),
            _range("distance_km", 0), _range("reliability_p90_min", 0, strict=True),
        ]
    if table == "choice_rows":
        unit = F.col("alternative_type") == UNIT
        return [
            ("unit alternatives require both unit and offer",
             unit & (F.col("unit_id").isNull() | F.col("effective_price").isNull())),
            ("a unit cannot also be an outside option",
             unit & F.col("outside_option").isNotNull()),
            ("other alternatives require an outside option",
             ~unit & F.col("outside_option").isNull()),
            _range("commute_min", 0),
        ]
    raise ValueError(f"no rules for table {table}")


def validate_records(df: DataFrame, table: str, *, key: str) -> DataFrame:
    """Violations (table, key, code, message, severity) of the declared record rules."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(bad, F.lit(False)), F.lit(message))
                for message, bad in record_rules(table)
            ]
        )
    )
    return df.select(
        F.lit(table).alias("table"), F.col(key).cast("string").alias("key"),
        F.lit("invalid_record").alias("code"), F.explode(hits).alias("message"),
        F.lit("error").alias("severity"),
    )
