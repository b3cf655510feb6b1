"""Coverage and readiness of an event history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.parsing import filled, known, parse_verified
from hearthline.schemas import COVERAGE_FIELDS, OUTCOME_EVENT_TYPES, OUTCOME_OUTSIDE

# Event types that count as evidence.
SITE_TOUR_TYPES = ("tour_attended", "site_tour_attended", "site_tour_observed")
OFFER_TYPES = ("offer_observed", "offer_version_observed")
INVENTORY_TYPES = ("unit_inventory_observed", "unit_version_observed")
CHECKS = ("price", "payment", "commute", "product", "outside_options")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "source_id").agg(F.count(F.lit(1)).alias("events"))


def _per_household(events: DataFrame, counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per household with its flags and counts, and one row (null household) for all
    other events. A plain aggregate: hot households collapse map-side."""
    p = F.col("payload")
    kind = F.col("event_type")
    household = F.col("entity_type") == "household"
    qualified = household & (kind == "qualification_observed")
    outcome = household & kind.isin(*OUTCOME_EVENT_TYPES)

    def ever(condition: Column) -> Column:
        return F.max(F.coalesce(condition, F.lit(False)))

    def field(name: str) -> Column:
        hit = qualified & known(p[name])
        if name == "outside_option":
            hit = hit | (outcome & known(p[name]))
        return ever(hit)

    return events.groupBy(F.when(household, F.col("entity_id")).alias("household")).agg(
        ever(qualified).alias("qualified"),
        ever(household & (kind == "reason_observed")).alias("reason"),
        *[field(f).alias(f) for f in COVERAGE_FIELDS],
        *[F.count_if(c).alias(n) for n, c in (counts or {}).items()],
    )


def coverage(events: DataFrame) -> DataFrame:
    """Per field: qualified households with a known value, out of all qualified households."""
    names = (*COVERAGE_FIELDS, "reason")
    totals = _per_household(events).where("qualified").agg(
        F.count(F.lit(1)).alias("denominator"), *[F.count_if(n).alias(n) for n in names]
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(n).alias("present")) for n in names]
    )
    return totals.select("denominator", F.inline(cells)).select(
        "field", "present", "denominator",
        F.when(F.col("denominator") > 0, F.col("present") / F.col("denominator"))
        .otherwise(0.0).alias("rate"),
    )


def readiness_audit(events: DataFrame, *, derive_outside: bool = False) -> DataFrame:
    """One row: totals, evidence per check, blockers, warnings and training_ready.

    By default a choice is trainable only with an explicit unit code or outside option;
    `derive_outside` also accepts an outside option implied by the outcome.
    """
    p = F.col("payload")
    kind = F.col("event_type")
    household = F.col("entity_type") == "household"
    outcome = household & kind.isin(*OUTCOME_EVENT_TYPES)
    verified = outcome & parse_verified(p["verified"])
    choice = filled(p["unit_code"]) | filled(p["outside_option"])
    if derive_outside:
        choice = choice | F.coalesce(p["outcome_type"].isin(*OUTCOME_OUTSIDE), F.lit(False))
    offer, stock = kind.isin(*OFFER_TYPES), kind.isin(*INVENTORY_TYPES)
    counts = {
        "total_events": F.lit(True),
        "verified_outcomes": verified,
        "site_tours": household & kind.isin(*SITE_TOUR_TYPES),
        "trainable_choice_events": verified & choice,
        "offer_events": offer,
        "inventory_events": stock,
        "price_evidence": offer & (filled(p["list_price_vnd"]) | filled(p["list_price"])),
        "payment_evidence": offer & (
            filled(p["payment_plan_code"]) | filled(p["monthly_payment_est"])
            | filled(p["down_payment_pct"])
        ),
    }
    one = _per_household(events, counts).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
        F.count("household").alias("households"),
        F.count_if("qualified").alias("qualified_households"),
        F.count_if("workplace_zone").alias("commute_evidence"),
        F.count_if("shortlisted_unit_code").alias("shortlisted"),
        F.count_if("outside_option").alias("outside_options_evidence"),
        F.count_if(F.col("outside_option") & F.col("qualified")).alias("_outside_covered"),
        F.count_if(F.col("reason") & F.col("qualified")).alias("_reason_covered"),
    ).withColumn("product_evidence", F.col("inventory_events") + F.col("shortlisted"))

    def note(bad: Column, text: str) -> Column:
        return F.when(bad, F.lit(text))

    blockers = [
        note(F.col("qualified_households") == 0, "no_structured_qualification_history"),
        note(F.col("verified_outcomes") == 0, "no_verified_decision_outcomes"),
        note(F.col("inventory_events") == 0, "no_temporal_inventory_evidence"),
        note(F.col("offer_events") == 0, "no_temporal_offer_evidence"),
        *[note(F.col(f"{c}_evidence") == 0, f"readiness_missing:{c}") for c in CHECKS],
    ]
    base = F.col("qualified_households")

    def thin(covered: str) -> Column:
        return (base > 0) & (F.col(covered) / F.greatest(base, F.lit(1)) < 0.5)

    warnings = [
        note(thin("_outside_covered"), "outside_option_coverage_below_50_percent"),
        note(thin("commute_evidence"), "workplace_zone_coverage_below_50_percent"),
        note(thin("_reason_covered"), "reason_coverage_below_50_percent"),
        note(F.col("trainable_choice_events") < 30, "fewer_than_30_trainable_choice_events"),
    ]
    return one.select(
        "total_events", "households", "qualified_households", "verified_outcomes", "site_tours",
        "trainable_choice_events",
        *[f"{c}_evidence" for c in CHECKS],
        *[
            F.when(F.col(f"{c}_evidence") > 0, "ready").otherwise("missing").alias(f"{c}_status")
            for c in CHECKS
        ],
        F.array_compact(F.array(*blockers)).alias("blockers"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    ).withColumn(
        "training_ready",
        (F.size("blockers") == 0) & (F.col("trainable_choice_events") >= 30),
    )
