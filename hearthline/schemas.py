"""Closed string domains, fixed tables and target schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed domains checked on entry.
PRODUCT_TYPES = ("townhouse", "garden_townhouse", "street_villa", "garden_villa", "shophouse")
INVENTORY_STATES = ("available", "held", "booked", "sold", "blocked")
PURPOSES = ("own_stay", "investment", "mixed", "business", "unknown")
STAGES = (
    "initial_interest", "qualified", "shortlist", "site_tour", "negotiation", "booking", "final",
)
SIZE_BANDS = ("1", "2", "3-4", "5+", "unknown")
CHILDREN_BANDS = ("0", "1", "2+", "unknown")
TRAVEL_MODES = ("motorbike", "car", "transit", "walk")
DEPARTURE_BUCKETS = ("am_peak", "midday", "pm_peak", "offpeak")
REASON_CODES = (
    "price", "monthly_cashflow", "financing", "commute", "location_perception", "product_size",
    "product_layout", "product_type", "park_green_space", "security", "child_amenity", "school",
    "commercial_potential", "rental_yield", "liquidity_resale", "legal_trust", "developer_trust",
    "handover_readiness", "spouse_family", "timing", "competitor", "market_uncertainty",
    "sales_experience", "unknown",
)
ASSIGNMENT_METHODS = (
    "randomized", "hash_randomized", "quasi_experimental", "manual", "observational",
)
CAUSAL_METHODS = ("randomized", "hash_randomized")
MODEL_STATUSES = ("candidate", "validated", "approved", "rejected", "archived")

UNIT = "unit"

# Outside options in set order, (alternative_id, outside_option).
OUTSIDE_OPTIONS = (
    ("OUT-COMPETITOR", "competitor_project"),
    ("OUT-LAND-HOUSE", "land_house"),
    ("OUT-RENT", "continue_renting"),
    ("OUT-POSTPONE", "postponed"),
    ("OUT-NO-PURCHASE", "no_purchase"),
)

# Outcome type -> outside option.
OUTCOME_OUTSIDE = {
    "selected_competitor": "competitor_project",
    "selected_land_house": "land_house",
    "continue_renting": "continue_renting",
    "postponed": "postponed",
    "no_purchase": "no_purchase",
    "lost": "no_purchase",
}
# Outcome type -> stage; every other outcome is final.
OUTCOME_STAGE = {
    "site_tour": "site_tour",
    "revisit": "shortlist",
    "hold": "negotiation",
    "booking": "booking",
}
OUTCOME_EVENT_TYPES = ("decision_outcome_observed", "decision_outcome_verified")
FEATURE_EVENT_TYPES = ("qualification_observed", "decision_stage_observed")
NON_MODEL_FIELDS = ("next_action", "next_action_date")

# Fields a household record is built from.
HOUSEHOLD_FIELDS = (
    "purchase_purpose", "household_size_band", "children_band", "household_income_band",
    "liquid_capital_band", "max_monthly_payment_band", "purchase_horizon", "workplace_zone",
    "stated_max_travel_min", "preferred_product_type",
)
# Fields of one qualification record in the sales capture form.
QUALIFICATION_FIELDS = (
    "purchase_purpose", "household_size_band", "children_band", "household_income_band",
    "liquid_capital_band", "max_monthly_payment_band", "purchase_horizon", "workplace_zone",
    "spouse_workplace_zone", "stated_max_travel_min", "preferred_product_type",
    "shortlisted_unit_code", "competitor_mentioned",
)
# Fields whose coverage is audited.
COVERAGE_FIELDS = (
    "purchase_purpose", "household_size_band", "children_band", "household_income_band",
    "liquid_capital_band", "max_monthly_payment_band", "purchase_horizon", "workplace_zone",
    "stated_max_travel_min", "preferred_product_type", "shortlisted_unit_code",
    "competitor_mentioned", "outside_option",
)

# Model features in vector order with their default weights.
DEFAULT_WEIGHTS = {
    "price_per_billion": -0.58,
    "monthly_payment_per_10m": -0.42,
    "commute_per_10min": -0.28,
    "product_match": 0.85,
    "affordability_breach": -1.10,
    "investor_shophouse_bonus": 0.35,
    "own_stay_garden_bonus": 0.25,
    "outside_option_base": -0.25,
}
FEATURES = tuple(DEFAULT_WEIGHTS)

# Allowed governance transitions.
ALLOWED_TRANSITIONS = {
    "candidate": ("validated", "rejected", "archived"),
    "validated": ("approved", "rejected", "archived"),
    "approved": ("archived",),
    "rejected": ("archived",),
    "archived": (),
}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_event_key", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("schema_version", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT_SCHEMA.fieldNames())
SEMANTIC_COLUMNS = (
    "event_type", "entity_type", "entity_id", "occurred_at", "source_id", "source_event_key",
    "payload", "schema_version",
)
