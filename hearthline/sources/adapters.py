"""Source rows -> canonical events: outcomes, sales capture, inventory, offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.hashing import row_map, stable_row_key
from hearthline.functions.parsing import blank_to_null, clean_null, parse_ts, parse_verified
from hearthline.schemas import QUALIFICATION_FIELDS
from hearthline.sources.events import as_events, text_map


def outcomes_to_events(
    raw: DataFrame, *, source_id: str, extra: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from outcome rows; a missing record id falls back to the row hash.

    `extra` names further columns to carry in the payload, such as the project.
    """
    def t(name: str) -> Column:
        return blank_to_null(F.col(name)) if name in raw.columns else F.lit(None).cast("string")

    verified = parse_verified(F.col("verified")) if "verified" in raw.columns else F.lit(True)
    ok = (
        t("household_id").isNotNull() & parse_ts(F.col("occurred_at")).isNotNull()
        & t("outcome_type").isNotNull()
    )
    events = as_events(
        raw.where(ok),
        event_type=F.lit("decision_outcome_observed"),
        entity_type=F.lit("household"),
        entity_id=t("household_id"),
        occurred_at=parse_ts(F.col("occurred_at")),
        source_id=F.lit(source_id),
        source_event_key=F.coalesce(t("source_record_id"), stable_row_key(row_map(raw.columns))),
        payload=text_map(
            {
                "outcome_type": t("outcome_type"),
                "unit_code": t("unit_code"),
                "outside_option": t("outside_option"),
                "stage": t("stage"),
                "verified": verified.cast("string"),
                **{name: t(name) for name in extra},
            }
        ),
    )
    rejects = raw.where(~ok).select(F.to_json(row_map(raw.columns)).alias("row"))
    return events, rejects


def sales_capture_to_events(raw: DataFrame, *, source_id: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): one capture row fans out to up to four events with stable keys."""
    def t(name: str) -> Column:
        return clean_null(F.col(name)) if name in raw.columns else F.lit(None).cast("string")

    at = parse_ts(F.col("captured_at"))
    entity = F.coalesce(t("household_id"), t("party_id"))
    ok = at.isNotNull() & entity.isNotNull()
    qualification = text_map({f: t(f) for f in QUALIFICATION_FIELDS})
    stage = text_map(
        {
            "stage": t("decision_stage"),
            "outside_option": t("outside_option"),
            "next_action": t("next_action"),
            "next_action_date": t("next_action_date"),
        }
    )

    def reason(n: int) -> Column:
        return text_map(
            {
                "reason_code": t(f"reason_{n}"),
                "direction": F.coalesce(t(f"reason_{n}_direction"), F.lit("unknown")),
                "evidence_type": F.lit("explicit"),
            }
        )

    def part(present: Column, event_type: str, suffix: str, payload: Column) -> Column:
        return F.when(
            present,
            F.struct(
                F.lit(event_type).alias("event_type"), F.lit(suffix).alias("suffix"),
                payload.alias("payload"),
            ),
        )

    fan = F.array_compact(
        F.array(
            part(F.size(qualification) > 0, "qualification_observed", "qualification",
                 qualification),
            part(t("decision_stage").isNotNull(), "decision_stage_observed", "stage", stage),
            part(t("reason_1").isNotNull(), "reason_observed", "reason:1", reason(1)),
            part(t("reason_2").isNotNull(), "reason_observed", "reason:2", reason(2)),
        )
    )
    rows = raw.where(ok).select(
        at.alias("at"),
        F.when(t("household_id").isNotNull(), "household").otherwise("party").alias("kind"),
        entity.alias("entity"),
        stable_row_key(row_map(raw.columns)).alias("key"),
        F.explode(fan).alias("p"),
    )
    events = as_events(
        rows,
        event_type=F.col("p.event_type"),
        entity_type=F.col("kind"),
        entity_id=F.col("entity"),
        occurred_at=F.col("at"),
        source_id=F.lit(source_id),
        source_event_key=F.concat_ws(":", "key", "p.suffix"),
        payload=F.col("p.payload"),
    )
    rejects = raw.where(~ok).select(F.to_json(row_map(raw.columns)).alias("row"))
    return events, rejects


def iso(ts: Column) -> Column:
    """ISO text with the zone; microseconds are shown where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.when(F.unix_micros(ts) % 1_000_000 != 0, fine).otherwise(whole)


UNIT_PAYLOAD = (
    "version_id", "project_id", "unit_id", "unit_code", "product_type", "inventory_state",
    "lot_area_m2", "built_area_m2", "corner_flag", "orientation", "park_distance_m",
    "gate_distance_m",
)
OFFER_PAYLOAD = (
    "offer_id", "unit_id", "product_type", "list_price", "net_price", "discount_pct",
    "incentive_cash", "payment_plan_code", "down_payment_pct", "monthly_payment_est", "source_id",
)


def _payload(df: DataFrame, names: tuple[str, ...]) -> Column:
    present = {n: F.col(n).cast("string") for n in names if n in df.columns}
    return text_map(
        {**present, "effective_from": iso(F.col("effective_from")),
         "effective_to": iso(F.col("effective_to"))}
    )


def unit_versions_to_events(versions: DataFrame) -> DataFrame:
    return as_events(
        versions,
        event_type=F.lit("unit_version_observed"),
        entity_type=F.lit("unit"),
        entity_id=F.col("unit_id"),
        occurred_at=F.col("effective_from"),
        source_id=F.col("source_id"),
        source_event_key=F.concat(F.lit("unit-version:"), F.col("version_id")),
        payload=_payload(versions, UNIT_PAYLOAD),
    )


def offers_to_events(offers: DataFrame) -> DataFrame:
    return as_events(
        offers,
        event_type=F.lit("offer_observed"),
        entity_type=F.when(F.col("unit_id").isNotNull(), "unit").otherwise("product_type"),
        entity_id=F.coalesce("unit_id", "product_type"),
        occurred_at=F.col("effective_from"),
        source_id=F.col("source_id"),
        source_event_key=F.concat(F.lit("offer:"), F.col("offer_id")),
        payload=_payload(offers, OFFER_PAYLOAD),
    )
