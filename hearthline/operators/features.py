"""Feature evidence: projections of events and leakage-safe as-of values."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.hashing import analytics_uuid
from hearthline.functions.households import PROFILE_COLUMNS, household_from_features
from hearthline.functions.parsing import one_of, parse_float
from hearthline.operators.temporal import asof_fill, asof_latest, interval_levels, interval_pairs, last_instant
from hearthline.schemas import (
    FEATURE_EVENT_TYPES, HOUSEHOLD_FIELDS, NON_MODEL_FIELDS, REASON_CODES,
)


def _household() -> Column:
    # party identifiers are keyed like households, so both meet under one id
    return analytics_uuid(F.col("entity_id"), namespace="household")


def _source_ref() -> Column:
    return F.concat_ws(":", "source_id", "source_event_key")


def project_features(events: DataFrame) -> DataFrame:
    """Qualification and stage events -> one row per feature value."""
    usable = F.map_filter("payload", lambda k, v: ~k.isin(*NON_MODEL_FIELDS) & v.isNotNull())
    # identifiers are computed per event, before the fan-out
    return events.where(F.col("event_type").isin(*FEATURE_EVENT_TYPES)).select(
        _household().alias("household_id"), usable.alias("_usable"),
        F.col("occurred_at").alias("observed_at"), _source_ref().alias("source_id"),
    ).select(
        "household_id", F.explode("_usable").alias("feature_name", "value"), "observed_at",
        "source_id",
    )


def feature_columns(
    events: DataFrame, features: Sequence[str] | None = None, *, anchor: str | None = None
) -> DataFrame:
    """The same evidence kept wide: one row per event with its source and an `f_<name>` value per feature.

    As-of operators take either form; the wide one moves a tenth of the rows. Without `features`
    all names that occur are kept; they are found by one aggregate, a row per name. `anchor` names one more feature:
    the workplace of `project_anchors`.
    """
    if features is None:
        usable = F.map_filter("payload", lambda k, v: ~k.isin(*NON_MODEL_FIELDS) & v.isNotNull())
        names = events.where(F.col("event_type").isin(*FEATURE_EVENT_TYPES)).select(
            F.explode(F.map_keys(usable)).alias("name")
        ).distinct()
        features = sorted(r["name"] for r in names.collect())
    values = {f: F.col("payload")[f] for f in features}
    if anchor is not None:
        values[anchor] = _workplace()
    return events.where(F.col("event_type").isin(*FEATURE_EVENT_TYPES)).select(
        _household().alias("household_id"), F.col("occurred_at").alias("observed_at"),
        _source_ref().alias("source_id"), *[v.alias(f"f_{f}") for f, v in values.items()],
    )


def _workplace() -> Column:
    """The zone that a qualification event names, else null."""
    zone = F.trim(F.col("payload")["workplace_zone"])
    return F.when(
        (F.col("event_type") == "qualification_observed") & (F.length(zone) > 0) & (F.lower(zone) != "unknown"), zone
    )


def project_reasons(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reason rows, rejects with an unknown reason code)."""
    p = F.col("payload")
    code = F.coalesce(p["reason_code"], F.lit("unknown"))
    rows = events.where(F.col("event_type") == "reason_observed").select(
        _household().alias("household_id"),
        code.alias("reason_code"),
        F.when(p["direction"] == "motivator", "motivator").otherwise("objection").alias(
            "direction"
        ),
        F.coalesce(parse_float(p["confidence"]), F.lit(1.0)).alias("confidence"),
        F.coalesce(p["evidence_type"], F.lit("explicit")).alias("evidence_type"),
        F.col("occurred_at").alias("observed_at"),
        _source_ref().alias("source_ref"),
    )
    valid = one_of(F.col("reason_code"), REASON_CODES).isNotNull()
    return rows.where(valid), rows.where(~valid)


def project_anchors(events: DataFrame) -> DataFrame:
    """Workplace anchors of households over time."""
    return events.where(_workplace().isNotNull()).select(
        _household().alias("household_id"),
        _workplace().alias("anchor_id"),
        F.col("occurred_at").alias("observed_at"),
        _source_ref().alias("source_id"),
    )


def _per_instant(observations: DataFrame, features: Sequence[str]) -> DataFrame:
    """One wide row per (household, instant) of long evidence; ties go to the greatest (source, value)."""
    cell = F.struct("source_id", "value")
    return observations.where(F.col("feature_name").isin(*features)).groupBy("household_id", "observed_at").agg(
        *[F.max(F.when(F.col("feature_name") == f, cell)).alias(f"f_{f}") for f in features]
    )


def asof_features(
    decisions: DataFrame,
    observations: DataFrame,
    *,
    features: Sequence[str] | None = None,
    at: str = "as_of",
    bucket_days: int = 32,
) -> DataFrame:
    """Decisions plus one `f_<name>` struct (source_id, value) per feature, nothing later than
    the decision. All features ride in one pass over (household, time). Without `features` every
    name in the observations is kept."""
    if features is None and "feature_name" in observations.columns:
        names = observations.select("feature_name").where("feature_name is not null").distinct()
        features = sorted(r["feature_name"] for r in names.collect())
    elif features is None:
        features = [c[2:] for c in observations.columns if c.startswith("f_")]
    columns = [f"f_{f}" for f in features]
    long = "feature_name" in observations.columns
    seen = (_per_instant(observations, features) if long else observations).withColumnRenamed("observed_at", at)
    filled = asof_fill(
        decisions, seen if long else seen.withColumnRenamed("source_id", "_source"), on=["household_id"], ts=at,
        columns=columns, tie=[] if long else ["_source"], bucket_days=bucket_days,
    )
    if long:
        return filled
    # the wide form holds a source once per row, the result one per feature
    return filled.select(*decisions.columns, *[
        F.when(F.col(c).isNotNull(), F.struct(F.col(c)["_source"].alias("source_id"), F.col(c)[c].alias("value"))).alias(c)
        for c in columns
    ])


def feature_rows(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form (key, feature_name, value, source_id) of the as-of feature columns."""
    names = [c for c in wide.columns if c.startswith("f_")]
    cells = F.array(
        *[
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    F.lit(c[2:]).alias("feature_name"), F.col(c)["value"].alias("value"),
                    F.col(c)["source_id"].alias("source_id"),
                ),
            )
            for c in names
        ]
    )
    return wide.select(*keys, F.inline(F.array_compact(cells)))


def with_household(wide: DataFrame) -> DataFrame:
    """Replace the as-of feature columns by typed household columns."""
    names = {c for c in wide.columns if c.startswith("f_")}

    def get(name: str) -> Column:
        return F.col(f"f_{name}")["value"] if f"f_{name}" in names else F.lit(None).cast("string")

    keep = [c for c in wide.columns if c not in names]
    return wide.select(*keep, *household_from_features(get))


def household_snapshot(events: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    """Latest typed household records, optionally as known at one time."""
    wide = feature_columns(events, HOUSEHOLD_FIELDS)
    if as_of is not None:
        wide = wide.where(F.col("observed_at") <= F.lit(as_of))
    # any feature event makes a household, even one without a usable field
    latest = wide.groupBy("household_id").agg(
        *[
            F.max(
                F.when(
                    F.col(f"f_{f}").isNotNull(),
                    F.struct("observed_at", "source_id", F.col(f"f_{f}").alias("value")),
                )
            ).alias(f"f_{f}")
            for f in HOUSEHOLD_FIELDS
        ]
    )
    return with_household(latest).select("household_id", *PROFILE_COLUMNS)


def asof_anchor(
    requests: DataFrame,
    anchors: DataFrame,
    *,
    at: str = "as_of",
    static: DataFrame | None = None,
    bucket_days: int = 32,
) -> DataFrame:
    """Requests plus `origin_anchor_id`: the workplace known then, else the static anchor."""
    out = asof_latest(
        requests, anchors, on=["household_id"], left_ts=at, right_ts="observed_at",
        tie=["source_id", "anchor_id"], values={"origin_anchor_id": "anchor_id"},
        bucket_days=bucket_days,
    )
    if static is not None:
        out = out.join(
            static.select("household_id", F.col("anchor_id").alias("_static")), "household_id",
            "left",
        ).withColumn("origin_anchor_id", F.coalesce("origin_anchor_id", "_static")).drop("_static")
    return out


def travel_time_asof(
    requests: DataFrame,
    travel: DataFrame,
    *,
    at: str = "as_of",
    mode: str = "motorbike",
    bucket: str = "am_peak",
    horizon=None,
) -> DataFrame:
    """Distinct (origin, destination, at) requests with the travel time valid at `at` and already
    observed then; the latest observation wins."""
    on = ["origin_anchor_id", "destination_anchor_id"]
    points = requests.select(*on, at).where(
        F.col(on[0]).isNotNull() & F.col(on[1]).isNotNull()
    ).distinct()
    usable = travel.where((F.col("mode") == mode) & (F.col("departure_bucket") == bucket))
    horizon = last_instant(points, at) if horizon is None else horizon
    levels = interval_levels(usable, start="valid_from", end="valid_to", horizon=horizon, bucket_days=32)
    met = interval_pairs(
        points, usable.drop("mode", "departure_bucket"), on=on, at=at, start="valid_from", end="valid_to",
        horizon=horizon, levels=levels,
    ).where(F.col("observed_at") <= F.col(at))
    rank = F.struct("observed_at", "source_id", "travel_time_min")
    return met.groupBy(*on, *(["_bucket"] if levels == 1 else []), at).agg(F.max(rank).alias("_b")).select(
        *on, at, F.col("_b.travel_time_min").alias("travel_time_min"),
        F.col("_b.observed_at").alias("travel_observed_at"),
    )


def commute_lookup(
    requests: DataFrame,
    anchors: DataFrame,
    travel: DataFrame,
    *,
    at: str = "as_of",
    static: DataFrame | None = None,
    mode: str = "motorbike",
    bucket: str = "am_peak",
    horizon=None,
) -> DataFrame:
    """Requests (household, destination_anchor_id, at) plus `commute_min`, null if unknown."""
    placed = asof_anchor(requests, anchors, at=at, static=static)
    known = with_commute(placed, travel, at=at, mode=mode, bucket=bucket, horizon=horizon)
    return known.select(*requests.columns, "origin_anchor_id", "commute_min")


def with_commute(
    placed: DataFrame, travel: DataFrame, *, at: str = "as_of", mode: str = "motorbike", bucket: str = "am_peak",
    horizon=None,
) -> DataFrame:
    """Rows with both anchors plus `commute_min`, null if unknown."""
    times = travel_time_asof(placed, travel, at=at, mode=mode, bucket=bucket, horizon=horizon)
    return placed.join(
        times.select(
            "origin_anchor_id", "destination_anchor_id", at,
            F.col("travel_time_min").alias("commute_min"),
        ),
        ["origin_anchor_id", "destination_anchor_id", at], "left",
    )


def population_commute(
    households: DataFrame, travel: DataFrame, *, destination: Column, as_of: datetime,
    mode: str = "motorbike", bucket: str = "am_peak",
) -> DataFrame:
    """Households plus `commute_min` from their workplace zone at one time."""
    asked = households.withColumn("destination_anchor_id", destination).withColumn(
        "as_of", F.lit(as_of)
    ).withColumn("origin_anchor_id", F.col("workplace_zone"))
    times = travel_time_asof(asked, travel, mode=mode, bucket=bucket, horizon=as_of)
    return asked.join(
        times.select(
            "origin_anchor_id", "destination_anchor_id", "as_of",
            F.col("travel_time_min").alias("commute_min"),
        ),
        ["origin_anchor_id", "destination_anchor_id", "as_of"], "left",
    ).drop("origin_anchor_id")


def confident(households: DataFrame, minimum: float = 0.3) -> DataFrame:
    return households.where(F.col("profile_confidence") >= minimum)

