"""Profile-driven connectors and declarative record mapping, for any DataFrame of raw rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.hashing import pseudonymous_key, row_map, stable_row_key
from hearthline.functions.parsing import blank_to_null, parse_ts
from hearthline.sources.events import as_events, text_map


@dataclass(frozen=True)
class Profile:
    """How one kind of export becomes events."""

    name: str
    event_type: str
    entity_type: str
    entity_id: str
    occurred_at: str
    key: str | None = None
    payload: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    pseudonymize: bool = False
    schema_version: str = "1"


# The declared export layouts.
PROFILES = {
    "crm_leads": Profile(
        name="crm-leads-v1", event_type="lead_created", entity_type="party",
        entity_id="contact_id", occurred_at="created_at", key="lead_id",
        payload=("lead_source", "campaign_id", "content_id", "sales_owner_id", "decision_stage"),
        required=("lead_source",), pseudonymize=True,
    ),
    "crm_qualification": Profile(
        name="crm-qualification-v1", event_type="qualification_observed",
        entity_type="household", entity_id="household_id", occurred_at="captured_at",
        key="qualification_id",
        payload=(
            "purchase_purpose", "household_size_band", "children_band", "household_income_band",
            "liquid_capital_band", "max_monthly_payment_band", "purchase_horizon",
            "workplace_zone", "stated_max_travel_min", "preferred_product_type",
            "shortlisted_unit_code", "competitor_mentioned", "outside_option",
        ),
        pseudonymize=True,
    ),
    "sap_outcomes": Profile(
        name="sap-outcomes-v1", event_type="decision_outcome_verified",
        entity_type="household", entity_id="household_id", occurred_at="occurred_at",
        key="outcome_id",
        payload=("outcome_type", "unit_code", "offer_id", "booking_amount",
                 "cancellation_reason", "verified"),
        required=("outcome_type",), pseudonymize=True,
    ),
    "inventory": Profile(
        name="inventory-v1", event_type="unit_inventory_observed", entity_type="unit",
        entity_id="unit_code", occurred_at="snapshot_at", key="snapshot_row_id",
        payload=("product_type", "inventory_state", "lot_area_m2", "built_area_m2",
                 "corner_flag", "orientation"),
        required=("inventory_state",),
    ),
    "offers": Profile(
        name="offers-v1", event_type="offer_observed", entity_type="unit",
        entity_id="unit_code", occurred_at="effective_from", key="offer_id",
        payload=("list_price_vnd", "net_price_vnd", "discount_pct", "incentive_cash_vnd",
                 "payment_plan_code", "down_payment_pct", "monthly_payment_est", "effective_to"),
        required=("list_price_vnd",),
    ),
    "ads": Profile(
        name="ads-v1", event_type="campaign_performance_observed", entity_type="campaign",
        entity_id="campaign_id", occurred_at="date", key="row_id",
        payload=("platform", "adset_id", "creative_id", "creative_version", "message_angle",
                 "target_segment", "spend_vnd", "impressions", "clicks", "leads",
                 "qualified_leads", "appointments", "site_tours", "bookings", "contracts"),
        required=("platform",),
    ),
    "website": Profile(
        name="website-events-v1", event_type="web_engagement_observed", entity_type="party",
        entity_id="visitor_id", occurred_at="occurred_at", key="event_id",
        payload=("event_name", "utm_source", "utm_campaign", "content_id", "unit_code",
                 "session_id"),
        required=("event_name",), pseudonymize=True,
    ),
}


def get_profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown connector profile: {name}; available: {sorted(PROFILES)}")
    return PROFILES[name]


def connector_to_events(
    raw: DataFrame, profile: Profile, *, source_id: str
) -> tuple[DataFrame, DataFrame]:
    """(events, warnings). Missing columns fail at once; faulty rows become warning rows.

    A warning row is named by its content hash: a file line number has no meaning once a file
    is split between tasks.
    """
    needed = {profile.entity_id, profile.occurred_at, *profile.required}
    if profile.key:
        needed.add(profile.key)
    missing = sorted(needed - set(raw.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")

    row_key = stable_row_key(row_map(raw.columns))
    entity = blank_to_null(F.col(profile.entity_id))
    at = parse_ts(F.col(profile.occurred_at))
    key = blank_to_null(F.col(profile.key)) if profile.key else row_key
    problem = (
        F.when(entity.isNull(), "missing_entity_id")
        .when(at.isNull(), "invalid_timestamp")
        .when(key.isNull(), "missing_source_event_key")
    )
    events = as_events(
        raw.where(problem.isNull()),
        event_type=F.lit(profile.event_type),
        entity_type=F.lit(profile.entity_type),
        entity_id=pseudonymous_key(entity, namespace=source_id) if profile.pseudonymize else entity,
        occurred_at=at,
        source_id=F.lit(source_id),
        source_event_key=key,
        payload=text_map(
            {c: blank_to_null(F.col(c)) for c in profile.payload if c in raw.columns}
        ),
        schema_version=F.lit(profile.schema_version),
    )
    warnings = raw.where(problem.isNotNull()).select(
        row_key.alias("row_key"), problem.alias("warning")
    )
    return events, warnings


@dataclass(frozen=True)
class FieldRule:
    source: str
    target: str
    required: bool = False
    default: str | None = None


@dataclass(frozen=True)
class MappingSpec:
    """Declarative mapping from a raw record to one event."""

    source_id: str
    event_type: str
    entity_type: str
    entity_id: str
    occurred_at: str
    key: str | None = None
    schema_version: str = "1"
    fields: tuple[FieldRule, ...] = field(default_factory=tuple)


def map_records(raw: DataFrame, spec: MappingSpec) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) for one declarative mapping; works on rows of any source."""
    types = dict(raw.dtypes)

    def value(name: str, default: str | None = None) -> Column:
        if name not in raw.columns:
            return F.lit(default).cast("string")
        return F.trim(F.col(name).cast("string"))

    entity = blank_to_null(value(spec.entity_id))
    is_time = types.get(spec.occurred_at, "").startswith("timestamp")
    at = F.col(spec.occurred_at).cast("timestamp") if is_time else parse_ts(
        value(spec.occurred_at)
    )
    key = (
        blank_to_null(value(spec.key)) if spec.key
        else stable_row_key(row_map(raw.columns), compact=False)
    )
    reason = (
        F.when(entity.isNull(), F.lit(f"missing entity id field: {spec.entity_id}"))
        .when(at.isNull(), F.lit(f"invalid timestamp field: {spec.occurred_at}"))
        .when(key.isNull(), F.lit(f"missing source event key field: {spec.key}"))
    )
    for rule in spec.fields:
        if rule.required:
            empty = F.coalesce(F.length(value(rule.source, rule.default)) == 0, F.lit(True))
            reason = reason.when(empty, F.lit(f"missing required source field: {rule.source}"))
    events = as_events(
        raw.where(reason.isNull()),
        event_type=F.lit(spec.event_type),
        entity_type=F.lit(spec.entity_type),
        entity_id=entity,
        occurred_at=at,
        source_id=F.lit(spec.source_id),
        source_event_key=key,
        payload=text_map({r.target: value(r.source, r.default) for r in spec.fields}),
        schema_version=F.lit(spec.schema_version),
    )
    rejects = raw.where(reason.isNotNull()).select(
        F.to_json(row_map(raw.columns)).alias("row"), reason.alias("reason")
    )
    return events, rejects
