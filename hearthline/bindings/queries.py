"""One query per operator over the driver tables, each with an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.bindings import market as mk
from hearthline.bindings.market import Market, iso_sql, json_sql, sql, ts_sql
from hearthline.functions import hashing as hs
from hearthline.functions import parsing as ps
from hearthline.functions.households import household_from_features, profile_confidence
from hearthline.functions.parsing import evaluated
from hearthline.operators import audit, choices, experiments, features, governance, logit
from hearthline.operators import population as pop
from hearthline.operators import quality, scenarios, temporal, utility
from hearthline.operators.scenarios import Scenario
from hearthline.plans import calibration, forecast, hash_tree, snapshot
from hearthline.schemas import DEFAULT_WEIGHTS, HOUSEHOLD_FIELDS
from hearthline.session import cut_lineage, shared_dir, stored
from hearthline.sources import adapters, connectors, events, ingest, keyed, tables
from hearthline.streaming.ingest import stream_dedupe, stream_ingest, stream_keyed

QUERIES: dict[str, Callable[[Market], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, doubles: dict[str, int] | None = None):
    """Register a query. `doubles` names the floating columns and the digits they are compared
    to; both sides are rounded the same way."""

    def add(fn: Callable[[Market], DataFrame]):
        def run(m: Market) -> DataFrame:
            return presentable(fn(m), doubles or {})

        QUERIES[name] = run
        if oracle is not None:
            text = oracle
            if doubles:
                swaps = ", ".join(
                    f"round({c}::DOUBLE, {d}) + 0.0::DOUBLE AS {c}" for c, d in doubles.items()
                )
                text = f"SELECT * REPLACE ({swaps}) FROM ({oracle})"
            ORACLES[name] = sql(text if doubles else f"SELECT * FROM ({oracle})")
        return fn

    return add


def presentable(df: DataFrame, doubles: dict[str, int]) -> DataFrame:
    """Engine-neutral columns: instants and lists as text, whole numbers as 64 bits."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in doubles:
            c = F.round(c.cast("double"), doubles[f.name]) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ";")
        columns.append(c.alias(f.name))
    return df.select(*columns)


HH = mk.household_sql

# ---------------------------------------------------------------- sources

UNIT_RAW_SQL = f"""
    SELECT unit_id, project_id, unit_code, product_type,
           CASE WHEN lot_area_m2 = 110.0 THEN 'mystery' ELSE inventory_state END
             AS inventory_state, lot_area_m2, built_area_m2, effective_from, effective_to,
           source_id FROM units"""


def _unit_raw(m: Market) -> DataFrame:
    return m.units.select(
        "unit_id", "project_id", "unit_code", "product_type",
        F.when(F.col("lot_area_m2") == 110.0, "mystery").otherwise(
            F.col("inventory_state")
        ).alias("inventory_state"),
        F.col("lot_area_m2").cast("string").alias("lot_area_m2"),
        F.col("built_area_m2").cast("string").alias("built_area_m2"),
        adapters.iso(F.col("effective_from")).alias("effective_from"),
        F.coalesce(adapters.iso(F.col("effective_to")), F.lit("")).alias("effective_to"),
        "source_id",
    )


@query(
    "read_unit_versions",
    f"""SELECT unit_id, project_id, unit_code, product_type, inventory_state, lot_area_m2,
               built_area_m2, {ts_sql('effective_from')} AS effective_from,
               {ts_sql('effective_to')} AS effective_to, source_id
        FROM ({UNIT_RAW_SQL}) WHERE inventory_state <> 'mystery'""",
)
def _(m):
    return tables.parse_unit_versions(_unit_raw(m))[0].drop("version_id")


@query(
    "read_unit_versions_rejects",
    f"""SELECT 'inventory_state' AS reasons, count(*) AS records FROM ({UNIT_RAW_SQL})
        WHERE inventory_state = 'mystery' HAVING count(*) > 0""",
)
def _(m):
    return tables.parse_unit_versions(_unit_raw(m))[1].groupBy("reasons").agg(
        F.count(F.lit(1)).alias("records")
    )


@query(
    "read_offers",
    f"""SELECT unit_id, list_price, net_price, discount_pct, incentive_cash, payment_plan_code,
               down_payment_pct, monthly_payment_est,
               {ts_sql('effective_from')} AS effective_from,
               {ts_sql('effective_to')} AS effective_to, source_id FROM offers""",
    {"list_price": 2, "net_price": 2, "discount_pct": 4, "incentive_cash": 2,
     "down_payment_pct": 4, "monthly_payment_est": 2},
)
def _(m):
    o = m.offers
    raw = o.select(
        "unit_id", F.lit("").alias("product_type"),
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c in ("list_price", "net_price", "discount_pct", "incentive_cash")
        ],
        "payment_plan_code", F.lit("").alias("down_payment_pct"),
        F.col("monthly_payment_est").cast("string").alias("monthly_payment_est"),
        adapters.iso(F.col("effective_from")).alias("effective_from"),
        adapters.iso(F.col("effective_to")).alias("effective_to"), "source_id",
    )
    return tables.parse_offers(raw)[0].drop("offer_id", "product_type")


@query(
    "read_travel_times",
    f"""SELECT origin_anchor_id, destination_anchor_id, mode, departure_bucket,
               travel_time_min, {ts_sql('observed_at')} AS observed_at,
               {ts_sql('valid_from')} AS valid_from, {ts_sql('valid_to')} AS valid_to, source_id
        FROM travel""",
    {"travel_time_min": 6},
)
def _(m):
    t = m.travel
    raw = t.select(
        "origin_anchor_id", "destination_anchor_id", "mode", "departure_bucket",
        F.col("travel_time_min").cast("string").alias("travel_time_min"),
        *[adapters.iso(F.col(c)).alias(c) for c in ("observed_at", "valid_from", "valid_to")],
        "source_id",
    )
    return tables.parse_travel_times(raw)[0].drop("distance_km", "reliability_p90_min")


def _event_view(df: DataFrame) -> DataFrame:
    return df.select(
        "event_type", "entity_type", "entity_id", "occurred_at", "source_id",
        "source_event_key", hs.canonical_json(F.col("payload")).alias("payload"),
    )


def _outcome_raw(m: Market) -> DataFrame:
    return m.outcomes.select(
        adapters.iso(F.col("occurred_at")).alias("occurred_at"),
        F.concat(F.lit(" "), F.col("household")).alias("household_id"), "outcome_type",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("unit_code", "outside_option", "stage")],
        F.upper("verified").alias("verified"),
        F.when(F.col("ok") % 2 == 0, F.concat(F.lit("O"), F.col("ok"))).otherwise("").alias(
            "source_record_id"
        ),
    )


@query(
    "outcomes_to_events",
    f"""SELECT 'decision_outcome_observed' AS event_type, 'household' AS entity_type,
               household AS entity_id, {ts_sql('occurred_at')} AS occurred_at,
               'orders' AS source_id,
               CASE WHEN ok % 2 = 0 THEN 'O' || ok ELSE sha256({json_sql(
                   "MAP {'household_id': ' ' || household, 'occurred_at': "
                   + iso_sql('occurred_at')
                   + ", 'outcome_type': outcome_type, 'outside_option': "
                   "coalesce(outside_option, ''), 'source_record_id': '', 'stage': "
                   "coalesce(stage, ''), 'unit_code': coalesce(unit_code, ''), "
                   "'verified': upper(verified)}")}) END AS source_event_key,
               {json_sql("MAP {'outcome_type': outcome_type, 'outside_option': outside_option, "
                         "'stage': stage, 'unit_code': unit_code, 'verified': verified}")}
                 AS payload FROM outcomes""",
)
def _(m):
    return _event_view(adapters.outcomes_to_events(_outcome_raw(m), source_id="orders")[0])


def _capture_raw(m: Market) -> DataFrame:
    k = F.col("ok")
    return m.qualification.select(
        adapters.iso(F.col("occurred_at")).alias("captured_at"),
        F.when(k % 3 == 0, "").otherwise(F.col("household")).alias("household_id"),
        F.concat(F.lit("P"), F.col("ck")).alias("party_id"),
        *[
            c for c in HOUSEHOLD_FIELDS
            if c not in ("children_band", "household_size_band", "liquid_capital_band")
        ],
        F.when(k % 5 == 0, "auto").otherwise("qualified").alias("decision_stage"),
        F.when(k % 7 == 0, "price").otherwise("unknown").alias("reason_1"),
        F.when(k % 2 == 0, "objection").otherwise("").alias("reason_1_direction"),
        F.lit("call back").alias("next_action"),
    )


CAPTURE_CTE = f"""
    SELECT {ts_sql('occurred_at')} AS moment, {iso_sql('occurred_at')} AS captured_at,
           CASE WHEN ok % 3 = 0 THEN '' ELSE household END AS household_id,
           'P' || ck AS party_id, CASE WHEN ok % 3 = 0 THEN 'party' ELSE 'household' END AS kind,
           CASE WHEN ok % 3 = 0 THEN 'P' || ck ELSE household END AS entity,
           CASE WHEN ok % 5 = 0 THEN 'auto' ELSE 'qualified' END AS decision_stage,
           CASE WHEN ok % 7 = 0 THEN 'price' ELSE 'unknown' END AS reason_1,
           CASE WHEN ok % 2 = 0 THEN 'objection' ELSE '' END AS dir, * EXCLUDE (occurred_at)
    FROM qual"""


def _un(c: str) -> str:
    return f"nullif({c}, 'unknown')"


CAPTURE_SQL = f"""
    WITH cap AS ({CAPTURE_CTE}), keyed AS (
      SELECT *, sha256({json_sql(
          "MAP {'captured_at': captured_at, 'decision_stage': decision_stage, "
          "'household_id': household_id, 'household_income_band': household_income_band, "
          "'max_monthly_payment_band': max_monthly_payment_band, 'next_action': 'call back', "
          "'party_id': party_id, 'preferred_product_type': preferred_product_type, "
          "'purchase_horizon': purchase_horizon, 'purchase_purpose': purchase_purpose, "
          "'reason_1': reason_1, 'reason_1_direction': dir, "
          "'stated_max_travel_min': stated_max_travel_min, 'workplace_zone': workplace_zone}")})
        AS row_key FROM cap)
    SELECT 'qualification_observed' AS event_type, kind AS entity_type, entity AS entity_id,
           moment AS occurred_at, 'capture' AS source_id,
           row_key || ':qualification' AS source_event_key,
           {json_sql("MAP {'purchase_purpose': " + _un('purchase_purpose')
                     + ", 'household_income_band': household_income_band"
                     + ", 'max_monthly_payment_band': " + _un('max_monthly_payment_band')
                     + ", 'purchase_horizon': " + _un('purchase_horizon')
                     + ", 'workplace_zone': " + _un('workplace_zone')
                     + ", 'stated_max_travel_min': stated_max_travel_min"
                     + ", 'preferred_product_type': " + _un('preferred_product_type') + "}")}
             AS payload FROM keyed
    UNION ALL
    SELECT 'decision_stage_observed', kind, entity, moment, 'capture', row_key || ':stage',
           '{{"next_action":"call back","stage":"qualified"}}'
    FROM keyed WHERE decision_stage <> 'auto'
    UNION ALL
    SELECT 'reason_observed', kind, entity, moment, 'capture', row_key || ':reason:1',
           '{{"direction":"' || CASE WHEN dir = '' THEN 'unknown' ELSE dir END
             || '","evidence_type":"explicit","reason_code":"price"}}'
    FROM keyed WHERE reason_1 = 'price'"""


@query("sales_capture_to_events", f"SELECT * FROM ({CAPTURE_SQL})")
def _(m):
    return _event_view(adapters.sales_capture_to_events(_capture_raw(m), source_id="capture")[0])


@query("iter_capture_rows", "SELECT count(*) AS records FROM qual")
def _(m):
    return _capture_raw(m).agg(F.count(F.lit(1)).alias("records"))


def _lead_raw(m: Market) -> DataFrame:
    log, k = m.log, F.col("k")
    return log.select(
        F.when(k == 13, " ").otherwise(F.concat(F.lit("L"), F.col("event_id"))).alias("lead_id"),
        F.when(k == 7, "").otherwise(F.concat(F.lit("U"), F.col("user_id"))).alias("contact_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created_at"),
        F.col("event_type").alias("lead_source"),
        F.when(k % 2 == 0, F.concat(F.lit(" C"), k)).otherwise("").alias("campaign_id"),
    )


LEADS_SQL = f"""
    SELECT 'lead_created' AS event_type, 'party' AS entity_type,
           'sha256:' || sha256('leads|U' || user_id) AS entity_id,
           {ts_sql('ts')} AS occurred_at, 'leads' AS source_id,
           'L' || event_id AS source_event_key,
           {json_sql("MAP {'campaign_id': CASE WHEN k % 2 = 0 THEN 'C' || k END, "
                     "'lead_source': event_type}")} AS payload
    FROM log WHERE k NOT IN (7, 13)"""


@query("connector_to_events", LEADS_SQL)
def _(m):
    return _event_view(
        connectors.connector_to_events(
            _lead_raw(m), connectors.get_profile("crm_leads"), source_id="leads"
        )[0]
    )


@query(
    "connector_warnings",
    """SELECT CASE WHEN k = 7 THEN 'missing_entity_id' ELSE 'missing_source_event_key' END
              AS warning, count(*) AS records FROM log WHERE k IN (7, 13) GROUP BY 1""",
)
def _(m):
    _, warnings = connectors.connector_to_events(
        _lead_raw(m), connectors.get_profile("crm_leads"), source_id="leads"
    )
    return warnings.groupBy("warning").agg(F.count(F.lit(1)).alias("records"))


def _profile_raw(m: Market, name: str) -> tuple[DataFrame, connectors.Profile]:
    """The event log laid out as an export of the given profile."""
    p = connectors.get_profile(name)
    text = {
        p.entity_id: F.concat(F.lit("E"), F.col("user_id")),
        p.occurred_at: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        p.key: F.concat(F.lit("R"), F.col("event_id")),
    }
    for i, c in enumerate(p.payload):
        text.setdefault(c, F.when(F.col("k") % (i + 2) == 0, "").otherwise(
            F.concat(F.lit(c + "-"), F.col("k"))
        ))
    return m.log.select(*[v.alias(n) for n, v in text.items()]), p


def _profile_sql() -> str:
    parts = []
    for name, p in sorted(connectors.PROFILES.items()):
        entity = (
            f"'sha256:' || sha256('{name}|E' || user_id)" if p.pseudonymize else "'E' || user_id"
        )
        used = {p.entity_id, p.occurred_at, p.key}
        cells = ", ".join(
            f"'{c}': CASE WHEN k % {i + 2} <> 0 THEN '{c}-' || k END"
            for i, c in enumerate(p.payload) if c not in used
        )
        parts.append(
            f"SELECT '{p.name}' AS profile, '{p.event_type}' AS event_type, "
            f"'{p.entity_type}' AS entity_type, {entity} AS entity_id, 'R' || event_id AS "
            f"source_event_key, {json_sql('MAP {' + cells + '}')} AS payload FROM log"
        )
    return " UNION ALL ".join(parts)


@query("connector_profiles", _profile_sql())
def _(m):
    out = None
    for name in sorted(connectors.PROFILES):
        raw, p = _profile_raw(m, name)
        part, _ = connectors.connector_to_events(raw, p, source_id=name)
        part = part.select(
            F.lit(p.name).alias("profile"), "event_type", "entity_type", "entity_id",
            "source_event_key", hs.canonical_json(F.col("payload")).alias("payload"),
        )
        out = part if out is None else out.unionByName(part)
    return out


MAPPING = connectors.MappingSpec(
    source_id="orders-api", event_type="order_seen", entity_type="party",
    entity_id="o_custkey", occurred_at="o_orderdate",
    fields=(
        connectors.FieldRule("o_orderpriority", "priority", required=True),
        connectors.FieldRule("o_orderstatus", "status"),
        connectors.FieldRule("channel", "channel", default="web"),
    ),
)


@query(
    "map_records",
    f"""SELECT 'order_seen' AS event_type, 'party' AS entity_type, o_custkey::VARCHAR
                 AS entity_id, {ts_sql('o_orderdate')} AS occurred_at,
               'orders-api' AS source_id, sha256({json_sql(
                   "MAP {'o_custkey': o_custkey::VARCHAR, 'o_orderdate': "
                   "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'o_orderkey': "
                   "o_orderkey::VARCHAR, 'o_orderpriority': o_orderpriority, "
                   "'o_orderstatus': o_orderstatus}", ', ', ': ')}) AS source_event_key,
               {json_sql("MAP {'priority': o_orderpriority, 'status': o_orderstatus, "
                         "'channel': 'web'}")} AS payload FROM orders""",
)
def _(m):
    return _event_view(connectors.map_records(m.table("orders").drop("o_totalprice"), MAPPING)[0])


CANON_VIEW_SQL = f"""
    SELECT event_type, entity_type, entity_id, {ts_sql('occurred_at')} AS occurred_at, source_id,
           source_event_key, {json_sql('payload')} AS payload FROM"""


def _events_jsonl(m: Market, found: DataFrame) -> DataFrame:
    """The events written as JSON lines below the shared folder and read back from there."""
    path = f"{shared_dir(m.spark)}/events-jsonl-{uuid4().hex}"
    events.write_events_jsonl(found, path, compression="gzip")
    return events.read_events_jsonl(m.spark, path)[0]


@query("read_events_jsonl", f"{CANON_VIEW_SQL} web")
def _(m):
    return _event_view(_events_jsonl(m, m.web_events))


@query("write_events_jsonl", "SELECT count(*) AS records FROM canonical")
def _(m):
    return _events_jsonl(m, m.canonical).agg(F.count(F.lit(1)).alias("records"))


@query("canonical_events", f"{CANON_VIEW_SQL} canonical")
def _(m):
    return _event_view(m.canonical)


@query(
    "unit_versions_to_events",
    f"""SELECT 'unit_version_observed' AS event_type, 'unit' AS entity_type,
               unit_id AS entity_id, {ts_sql('effective_from')} AS occurred_at, source_id,
               'unit-version:' || version_id AS source_event_key,
               {json_sql("MAP {'version_id': version_id, 'project_id': project_id, "
                         "'unit_id': unit_id, 'unit_code': unit_code, 'product_type': "
                         "product_type, 'inventory_state': inventory_state, 'lot_area_m2': "
                         "lot_area_m2::VARCHAR, 'built_area_m2': built_area_m2::VARCHAR, "
                         "'effective_from': " + iso_sql('effective_from')
                         + ", 'effective_to': " + iso_sql('effective_to') + "}")} AS payload
        FROM units""",
)
def _(m):
    return _event_view(adapters.unit_versions_to_events(m.units))


@query(
    "offers_to_events",
    f"""SELECT 'offer_observed' AS event_type, 'unit' AS entity_type,
               unit_id AS entity_id, {ts_sql('effective_from')} AS occurred_at, source_id,
               'offer:' || offer_id AS source_event_key,
               {json_sql("MAP {'offer_id': offer_id, 'unit_id': unit_id, "
                         "'payment_plan_code': payment_plan_code, 'source_id': source_id, "
                         "'effective_from': " + iso_sql('effective_from')
                         + ", 'effective_to': " + iso_sql('effective_to') + "}")} AS payload
        FROM offers""",
)
def _(m):
    plain = m.offers.drop(
        "list_price", "net_price", "discount_pct", "incentive_cash", "down_payment_pct",
        "monthly_payment_est",
    )
    return _event_view(adapters.offers_to_events(plain))


JAN_10 = datetime(2024, 1, 10, tzinfo=timezone.utc)
JAN_20 = datetime(2024, 1, 20, tzinfo=timezone.utc)


@query(
    "scan_events",
    f"""{CANON_VIEW_SQL} canonical WHERE entity_type = 'household'
        AND event_type = 'reason_observed' AND occurred_at >= TIMESTAMP '2024-01-10'
        AND occurred_at < TIMESTAMP '2024-01-20'""",
)
def _(m):
    return _event_view(
        events.scan_events(
            m.canonical, entity_type="household", event_type="reason_observed",
            occurred_from=JAN_10, occurred_to=JAN_20,
        )
    )


@query("count_events", "SELECT count(*) AS events FROM canonical")
def _(m):
    return events.count_events(m.canonical)


# ---------------------------------------------------------------- ingest


def _store_and_batch(m: Market) -> tuple[DataFrame, DataFrame]:
    """A store holding a tenth of the log, and the whole log sent again with repeats."""
    stored = m.web_events.where(F.col("source_event_key").cast("long") % 10 == 0)
    again = m.web_events.where(F.col("source_event_key").cast("long") % 4 == 0)
    return stored, m.web_events.unionByName(again)


@query(
    "ingest_events",
    f"""{CANON_VIEW_SQL} web WHERE source_event_key::BIGINT % 10 <> 0""",
)
def _(m):
    store, batch = _store_and_batch(m)
    return _event_view(ingest.ingest_events(batch, store, source_id="web")[0])


@query(
    "ingestion_result",
    """SELECT 'web' AS source_id, received, inserted, received - inserted AS duplicates,
              inserted / received::DOUBLE AS accepted_ratio, 0::BIGINT AS mismatched
       FROM (SELECT count(*) + count_if(event_id % 4 = 0)::BIGINT AS received,
                    count_if(event_id % 10 <> 0)::BIGINT AS inserted FROM events)""",
    {"accepted_ratio": 8},
)
def _(m):
    store, batch = _store_and_batch(m)
    return ingest.ingest_events(batch, store, source_id="web")[1]


@query("ingest_indexed", f"{CANON_VIEW_SQL} web")
def _(m):
    """The log in two batches, the second with all of the first again, through the key index."""
    path = f"{shared_dir(m.spark)}/table-{uuid4().hex}"
    store, batch = _store_and_batch(m)
    for part in (store, batch):
        keyed.ingest_batch(m.spark, path, part, source_id="web")
    return _event_view(keyed.stored_events(m.spark, path))


def _snapshots(m: Market) -> DataFrame:
    """One source snapshot per ship day and status, content named by its totals."""
    days = m.table("lineitem").groupBy("l_shipdate", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s")
    )
    return ingest.snapshot_rows(
        days, source_id=F.concat(F.lit("ship-"), F.col("l_linestatus")),
        captured_at=F.col("l_shipdate"),
        content_hash=F.sha2(F.concat_ws("|", "n", "s"), 256), record_count=F.col("n"),
        schema_version=F.lit("1"), metadata=F.create_map(F.lit("total"), F.col("s").cast("string")),
    )


SNAP_SQL = f"""
    SELECT source_id, min({ts_sql('captured_at')}) AS captured_at, content_hash, record_count
    FROM (SELECT 'ship-' || l_linestatus AS source_id, l_shipdate AS captured_at,
                 sha256(count(*) || '|' || sum(l_linenumber)) AS content_hash,
                 count(*) AS record_count
          FROM lineitem GROUP BY l_shipdate, l_linestatus)
    WHERE content_hash NOT LIKE '0%' GROUP BY source_id, content_hash, record_count"""


@query("record_source_snapshot", SNAP_SQL)
def _(m):
    new = _snapshots(m)
    stored = new.where(F.startswith("content_hash", F.lit("0")))
    return ingest.record_source_snapshot(new, stored).select(
        "source_id", "captured_at", "content_hash", "record_count"
    )


@query("list_snapshots", f"SELECT * FROM ({SNAP_SQL}) WHERE source_id = 'ship-O'")
def _(m):
    new = _snapshots(m)
    stored = new.where(F.startswith("content_hash", F.lit("0")))
    return ingest.list_snapshots(
        ingest.record_source_snapshot(new, stored), source_id="ship-O"
    ).select("source_id", "captured_at", "content_hash", "record_count")


def _digest_sql(line: str, table: str) -> str:
    lanes = ", ".join(
        f"coalesce(sum(('0x' || substr(h,{1 + 8 * i},8))::BIGINT)::VARCHAR, '0')"
        for i in range(8)
    )
    return f"SELECT count(*) AS records, sha256(concat_ws('|', count(*), {lanes})) AS digest" \
           f" FROM (SELECT sha256({line}) AS h FROM {table})"


EVENT_LINE_SQL = (
    "to_json([event_type, entity_type, entity_id, " + ts_sql("occurred_at")
    + ", source_id, source_event_key, " + json_sql("payload") + ", schema_version])::VARCHAR"
)


@query("semantic_hash", _digest_sql(EVENT_LINE_SQL, "canonical"))
def _(m):
    return snapshot.semantic_hash(m.canonical, snapshot.event_line()).withColumnRenamed(
        "rows", "records"
    )


@query(
    "partition_digests",
    f"""WITH l AS (SELECT event_type, occurred_at::DATE AS event_date, sha256({EVENT_LINE_SQL}) AS h FROM canonical),
          s AS (SELECT event_type, event_date, count(*) AS n, {' + '.join(
              f'(count(*) > {hash_tree.LEAF * 16**k})::INTEGER' for k in range(hash_tree.DEEPEST))} AS digits FROM l GROUP BY 1, 2),
          c AS (SELECT event_type, event_date, h, count(*) AS copies FROM l GROUP BY 1, 2, 3),
          n0 AS (SELECT event_type, event_date, n, digits, left(h, digits) AS pre,
                   sha256(string_agg(h || ':' || copies, '|' ORDER BY h || ':' || copies)) AS digest
                 FROM c JOIN s USING (event_type, event_date) GROUP BY 1, 2, 3, 4, 5),
          n1 AS (SELECT event_type, event_date, n, greatest(digits - 3, 0) AS up, left(pre, greatest(digits - 3, 0)) AS above,
                   CASE WHEN digits = 0 THEN min(digest) ELSE
                     sha256(string_agg(pre || ':' || digest, '|' ORDER BY pre || ':' || digest)) END AS digest
                 FROM n0 GROUP BY 1, 2, 3, digits, 4, 5),
          n2 AS (SELECT event_type, event_date, n, up AS digits, left(above, greatest(up - 3, 0)) AS pre,
                   CASE WHEN up = 0 THEN min(digest) ELSE
                     sha256(string_agg(above || ':' || digest, '|' ORDER BY above || ':' || digest)) END AS digest
                 FROM n1 GROUP BY 1, 2, 3, 4, 5)
        SELECT event_type, event_date::VARCHAR AS event_date, n AS records, digest FROM n2""",
)
def _(m):
    found = hash_tree.partition_digests(m.canonical, snapshot.event_line(), snapshot.event_partition())
    return found.select("event_type", F.col("event_date").cast("string").alias("event_date"), F.col("rows").alias("records"), "digest")


@query(
    "window_filter",
    """SELECT count(*) AS events FROM canonical WHERE occurred_at >= TIMESTAMP '2024-01-10'
       AND occurred_at < TIMESTAMP '2024-01-20'""",
)
def _(m):
    return events.count_events(snapshot.window(m.canonical, JAN_10, JAN_20))


@query(
    "dataset_id",
    f"""SELECT 'sha256:' || sha256(to_json(['bench', '001', '', '', d.digest, s.digest,
               '{{"offers":"' || d.digest || '"}}'])::VARCHAR) AS dataset_snapshot_id
        FROM ({_digest_sql(EVENT_LINE_SQL, 'canonical')}) d,
             ({_digest_sql("source_id || captured_at", f"({SNAP_SQL})")}) s""",
)
def _(m):
    d = snapshot.semantic_hash(m.canonical, snapshot.event_line()).select(
        F.lit(1).alias("one"), F.col("digest").alias("event_digest")
    )
    new = _snapshots(m)
    recorded = ingest.record_source_snapshot(
        new, new.where(F.startswith("content_hash", F.lit("0")))
    )
    line = F.concat(
        "source_id", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    s = snapshot.semantic_hash(recorded, line).select(
        F.lit(1).alias("one"), F.col("digest").alias("snapshot_digest")
    )
    both = d.unionByName(s, allowMissingColumns=True).groupBy("one").agg(
        F.max("event_digest").alias("event_digest"),
        F.max("snapshot_digest").alias("snapshot_digest"),
    )
    manifest = both.withColumns(
        {
            "project_code": F.lit("bench"), "snapshot_version": F.lit("001"),
            "window_from": F.lit(None).cast("timestamp"),
            "window_to": F.lit(None).cast("timestamp"),
            "input_digests": F.create_map(F.lit("offers"), F.col("event_digest")),
        }
    )
    return manifest.select(snapshot.dataset_id(manifest).alias("dataset_snapshot_id"))


# ---------------------------------------------------------------- scalar expressions


@query(
    "dedupe_key",
    "SELECT source_event_key, sha256(source_id || '|' || source_event_key || '|' || "
    "schema_version) AS dedupe_key FROM canonical",
)
def _(m):
    return events.with_keys(m.canonical).select("source_event_key", "dedupe_key")


@query(
    "payload_hash",
    f"SELECT source_event_key, sha256({json_sql('payload', ', ', ': ')}) AS payload_hash "
    "FROM canonical",
)
def _(m):
    return events.with_keys(m.canonical).select("source_event_key", "payload_hash")


@query(
    "stable_row_key",
    f"""SELECT p_partkey, sha256({json_sql(
        "MAP {'p_brand': p_brand, 'p_name': p_name || '\" Ñ', 'p_type': p_type}")}) AS row_key
        FROM part""",
)
def _(m):
    raw = m.table("part").select(
        "p_partkey", "p_brand", F.concat("p_name", F.lit('" Ñ')).alias("p_name"), "p_type"
    )
    return raw.select(
        "p_partkey", hs.stable_row_key(hs.row_map(["p_brand", "p_name", "p_type"])).alias("row_key")
    )


@query(
    "pseudonymous_key",
    "SELECT c_custkey, 'sha256:' || sha256('crm|' || c_name) AS pseudonym FROM customer",
)
def _(m):
    return m.table("customer").select(
        "c_custkey",
        hs.pseudonymous_key(F.concat(F.lit(" "), "c_name"), namespace="crm").alias("pseudonym"),
    )


@query(
    "analytics_uuid",
    f"SELECT c_custkey, {HH('c_name')} AS household_id FROM customer",
)
def _(m):
    first = m.table("customer").select(
        "c_custkey", hs.analytics_uuid(F.col("c_name"), namespace="household").alias("u")
    )
    # an identifier that already is a UUID passes through
    return first.select(
        "c_custkey", hs.analytics_uuid(F.col("u"), namespace="other").alias("household_id")
    )


@query(
    "clean_null",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS cleaned
       FROM orders""",
)
def _(m):
    s = F.col("o_orderstatus")
    raw = F.when(s == "F", F.concat(F.lit("  "), "o_orderpriority")).when(
        s == "O", " UnKnown "
    ).otherwise("auto")
    return m.table("orders").select("o_orderkey", ps.clean_null(raw).alias("cleaned"))


@query(
    "parse_ts",
    f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL
               WHEN 'O' THEN {ts_sql("o_orderdate - INTERVAL 7 HOUR")}
               ELSE {ts_sql('o_orderdate')} END AS instant FROM orders""",
)
def _(m):
    s = F.col("o_orderstatus")
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.concat(text, F.when(s == "P", "").when(s == "O", "+07:00").otherwise("Z"))
    return m.table("orders").select("o_orderkey", ps.parse_ts(raw).alias("instant"))


@query(
    "effective_price",
    """SELECT offer_id, coalesce(net_price, list_price * (1 - discount_pct) - incentive_cash)
              AS price FROM offers""",
    {"price": 2},
)
def _(m):
    return m.offers.select(
        "offer_id",
        choices.effective_price(
            F.col("net_price"), F.col("list_price"), F.col("discount_pct"),
            F.col("incentive_cash"),
        ).alias("price"),
    )


BAND_SQL = """
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN (p_size + p_size + 20) / 2.0
             WHEN 1 THEN (p_size + p_size + 1) / 2.0 * 1000 WHEN 2 THEN p_size * 0.8
             WHEN 3 THEN p_size * 1.2 WHEN 4 THEN p_size * 1.0 WHEN 5 THEN p_size * 1200.0
             END::DOUBLE AS midpoint,
           CASE WHEN p_partkey % 7 < 6 THEN p_size END::BIGINT AS days FROM part"""


@query("band_midpoint", f"SELECT p_partkey, midpoint FROM ({BAND_SQL})", {"midpoint": 6})
def _(m):
    return m.table("part").select("p_partkey", ps.band_midpoint(_band()).alias("midpoint"))


def _band():
    k, s = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    return (
        F.when(k == 0, F.concat(s, F.lit("-"), (F.col("p_size") + 20).cast("string"),
                                F.lit(" M")))
        .when(k == 1, F.concat(s, F.lit(" - "), (F.col("p_size") + 1).cast("string"),
                               F.lit("b")))
        .when(k == 2, F.concat(F.lit("< "), s, F.lit("m")))
        .when(k == 3, F.concat(s, F.lit("m+")))
        .when(k == 4, s)
        .when(k == 5, F.concat(s, F.lit("b+")))
        .otherwise("Unknown")
    )


@query("parse_days", f"SELECT p_partkey, days FROM ({BAND_SQL})")
def _(m):
    return m.table("part").select("p_partkey", ps.parse_days(_band()).alias("days"))


@query(
    "profile_confidence",
    """SELECT ok, (8 - CASE WHEN purchase_purpose = 'unknown' THEN 1 ELSE 0 END
               - CASE WHEN max_monthly_payment_band = 'unknown' THEN 1 ELSE 0 END
               - CASE WHEN purchase_horizon = 'unknown' THEN 1 ELSE 0 END
               - CASE WHEN workplace_zone = 'unknown' THEN 1 ELSE 0 END
               - CASE WHEN preferred_product_type = 'unknown' THEN 1 ELSE 0 END
               + CASE WHEN household_size_band = 'unknown' THEN 0 ELSE 1 END
               + CASE WHEN children_band = 'unknown' THEN 0 ELSE 1 END) / 10.0::DOUBLE
              AS confidence FROM qual""",
    {"confidence": 6},
)
def _(m):
    return m.qualification.select("ok", profile_confidence(F.col).alias("confidence"))


@query(
    "household_from_features",
    """SELECT ok, purchase_purpose, household_size_band, children_band,
              CASE household_income_band WHEN '50-80m' THEN 65.0 WHEN '80-120m' THEN 100.0
                 WHEN '1-2b' THEN 1500.0 WHEN '<50m' THEN 40.0 ELSE 120.0 END::DOUBLE
                 AS income_midpoint_million,
              CASE purchase_horizon WHEN '30d' THEN 30 WHEN '120d' THEN 120 WHEN '200d' THEN 200
                 END::BIGINT AS purchase_horizon_days,
              nullif(workplace_zone, 'unknown') AS workplace_zone,
              stated_max_travel_min::DOUBLE AS commute_tolerance_min,
              nullif(preferred_product_type, 'unknown') AS preferred_product_type FROM qual""",
    {"income_midpoint_million": 6, "commute_tolerance_min": 6},
)
def _(m):
    typed = m.qualification.select("ok", *household_from_features(F.col))
    return typed.drop(
        "liquid_capital_million", "max_monthly_payment_million", "profile_confidence"
    )


@query(
    "project_features",
    f"SELECT household_id, feature_name, value, {ts_sql('observed_at')} AS observed_at, "
    "source_id FROM obs",
)
def _(m):
    return features.project_features(m.canonical)


@query(
    "project_reasons",
    f"""SELECT {HH('entity_id')} AS household_id, payload['reason_code'] AS reason_code,
               CASE WHEN payload['direction'] = 'motivator' THEN 'motivator' ELSE 'objection' END
                 AS direction, 1.0::DOUBLE AS confidence, 'explicit' AS evidence_type,
               {ts_sql('occurred_at')} AS observed_at,
               source_id || ':' || source_event_key AS source_ref
        FROM web WHERE event_type = 'reason_observed'""",
    {"confidence": 4},
)
def _(m):
    return features.project_reasons(m.canonical)[0]


@query(
    "project_anchors",
    f"SELECT household_id, anchor_id, {ts_sql('observed_at')} AS observed_at, source_id "
    "FROM anchors",
)
def _(m):
    return features.project_anchors(m.canonical)


@query("selected_alternative", "SELECT decision_id, selected FROM decisions")
def _(m):
    d = choices.outcome_decisions(m.outcome_events, project=m.PROJECT())
    return d.select("decision_id", F.col("selected_alternative_id").alias("selected"))


@query("decision_stage", "SELECT decision_id, stage FROM decisions")
def _(m):
    return choices.outcome_decisions(m.outcome_events, project=m.PROJECT()).select(
        "decision_id", "stage"
    )


# ---------------------------------------------------------------- choice sets


def _asofs(m: Market) -> DataFrame:
    return choices.outcome_decisions(m.outcome_events, project=m.PROJECT()).select(
        "project_id", "as_of"
    ).distinct()


@query(
    "scd_active_units",
    f"""SELECT project_id, {ts_sql('as_of')} AS as_of, unit_id, version_id, inventory_state,
               false AS ambiguous FROM active_units""",
)
def _(m):
    return choices.scd_active_units(
        _asofs(m), m.units, horizon=m.horizon, values=("version_id", "inventory_state")
    ).select("project_id", "as_of", "unit_id", "version_id", "inventory_state", "ambiguous")


@query(
    "scd_active_offers",
    f"SELECT unit_id, {ts_sql('as_of')} AS as_of, offer_id, false AS ambiguous "
    "FROM active_offers",
)
def _(m):
    units = choices.scd_active_units(
        _asofs(m), m.units, horizon=m.horizon, values=("version_id", "inventory_state")
    )
    points = units.where("inventory_state = 'available'").select("unit_id", "as_of")
    return choices.scd_active_offers(points, m.offers, horizon=m.horizon, values=("offer_id",)).select(
        "unit_id", "as_of", "offer_id", "ambiguous"
    )


@query(
    "choice_set",
    f"""SELECT project_id, {ts_sql('as_of')} AS as_of, alternative_id, alternative_type,
               unit_id, product_type, effective_price, monthly_payment_est, payment_plan_code,
               outside_option FROM alternatives""",
    {"effective_price": 2, "monthly_payment_est": 2},
)
def _(m):
    rows, _ = choices.choice_set(_asofs(m), m.units, m.offers, horizon=m.horizon)
    return rows.select(
        "project_id", "as_of", "alternative_id", "alternative_type", "unit_id", "product_type",
        "effective_price", "monthly_payment_est", "payment_plan_code", "outside_option",
    )


def _decisions(m: Market) -> tuple[DataFrame, DataFrame]:
    return choices.historical_decisions(
        m.outcome_events, m.units, m.offers, project=m.PROJECT(), horizon=m.horizon
    )


@query(
    "historical_decisions",
    f"""SELECT d.decision_id, d.household_id, {ts_sql('d.as_of')} AS as_of, d.stage,
               d.selected AS selected_alternative_id, d.chosen,
               (SELECT count(*) FROM alternatives a WHERE a.project_id = d.project_id
                AND a.as_of = d.as_of) AS alternatives
        FROM open_decisions d""",
)
def _(m):
    good, _ = _decisions(m)
    return good.select(
        "decision_id", "household_id", "as_of", "stage", "selected_alternative_id", "chosen",
        F.size("alts").alias("alternatives"),
    )


@query(
    "historical_decisions_violations",
    """SELECT d.decision_id, 'selected_alternative_unavailable' AS code, d.selected AS message
       FROM decisions d LEFT JOIN alternatives a ON a.project_id = d.project_id
        AND a.as_of = d.as_of AND a.alternative_id = d.selected
       WHERE d.selected IS NOT NULL AND a.alternative_id IS NULL""",
)
def _(m):
    return _decisions(m)[1].select("decision_id", "code", "message")


SPOILED_SQL = """
    SELECT project_id || '@' || strftime(as_of, '%Y-%m-%d') AS set_id, alternative_id, rk,
           CASE WHEN rk = 0 AND ascii(right(alternative_id, 1)) % 5 = 0 THEN 'sold'
                WHEN rk = 0 THEN 'available' END AS state
    FROM (SELECT *, CASE WHEN outside_option IS NULL THEN 0 ELSE 1 END AS rk FROM alternatives)
    WHERE outside_option IS NULL OR substr(project_id, 5)::BIGINT % 3 <> 0"""


@query(
    "validate_choice_sets",
    f"""SELECT set_id, 'missing_outside_option' AS code,
               'choice set requires an outside option' AS message
        FROM ({SPOILED_SQL}) GROUP BY set_id HAVING max(rk) = 0
        UNION ALL
        SELECT set_id, 'unavailable_unit', alternative_id || ' inventory_state=sold'
        FROM ({SPOILED_SQL}) WHERE state = 'sold'""",
)
def _(m):
    whole, _ = choices.choice_sets(_asofs(m), m.units, m.offers, horizon=m.horizon)
    complete = F.substring("project_id", 5, 20).cast("long") % 3 != 0
    sold = lambda a: (a["alternative_type"] == "unit") & (F.ascii(F.substring(a["alternative_id"], -1, 1)) % 5 == 0)
    # spoiled where they lie; what loses all its alternatives is no set
    sets = evaluated(whole, {"kept": F.transform(
        F.filter("alts", lambda a: a["outside_option"].isNull() | complete),
        lambda a: F.when(sold(a), a.withField("inventory_state", F.lit("sold"))).otherwise(a),
    )}).where(F.size("kept") > 0).select(
        "as_of", F.col("kept").alias("alts"),
        F.concat_ws("@", "project_id", F.date_format("as_of", "yyyy-MM-dd")).alias("set_id"),
    )
    return quality.validate_choice_sets(sets).select("set_id", "code", "message")


@query(
    "validate_records",
    """SELECT 'offers' AS "table", offer_id AS key, 'discount_pct out of range' AS message
       FROM offers WHERE discount_pct - 0.05 < 0
       UNION ALL SELECT 'offers', offer_id, 'incentive_cash out of range' FROM offers
       WHERE incentive_cash - 10000 < 0""",
)
def _(m):
    spoiled = m.offers.withColumns(
        {
            "discount_pct": F.col("discount_pct") - 0.05,
            "incentive_cash": F.col("incentive_cash") - 10000,
        }
    )
    return quality.validate_records(spoiled, "offers", key="offer_id").select(
        "table", "key", "message"
    )


@query(
    "validate_records_units",
    """SELECT 'unit_versions' AS "table", version_id AS key, x.message FROM units,
       (VALUES ('effective_to must be later than effective_from', 1), ('lot_area_m2 out of range', 2),
               ('built_area_m2 out of range', 3)) x(message, k)
       WHERE (k = 1 AND effective_to - INTERVAL 60 DAY <= effective_from) OR (k = 2 AND lot_area_m2 - 100 <= 0)
          OR (k = 3 AND built_area_m2 - 40 <= 0)""",
)
def _(m):
    spoiled = m.units.withColumns(
        {
            "effective_to": F.col("effective_to") - F.expr("INTERVAL 60 DAYS"),
            "lot_area_m2": F.col("lot_area_m2") - 100, "built_area_m2": F.col("built_area_m2") - 40,
        }
    )
    return quality.validate_records(spoiled, "unit_versions", key="version_id").select(
        "table", "key", "message"
    )


@query(
    "validate_records_travel",
    """SELECT 'travel_times' AS "table", origin_anchor_id || '>' || destination_anchor_id AS key, x.message FROM travel,
       (VALUES ('valid_from must be before valid_to', 1), ('travel_time_min out of range', 2)) x(message, k)
       WHERE (k = 1 AND valid_from >= valid_to - INTERVAL 61 DAY) OR (k = 2 AND travel_time_min - 30 <= 0)""",
)
def _(m):
    spoiled = m.travel.withColumns(
        {
            "key": F.concat("origin_anchor_id", F.lit(">"), "destination_anchor_id"),
            "valid_to": F.col("valid_to") - F.expr("INTERVAL 61 DAYS"),
            "travel_time_min": F.col("travel_time_min") - 30,
            "distance_km": F.lit(None).cast("double"), "reliability_p90_min": F.lit(None).cast("double"),
        }
    )
    return quality.validate_records(spoiled, "travel_times", key="key").select(
        "table", "key", "message"
    )


# ---------------------------------------------------------------- as-of features


@query(
    "asof_features",
    """SELECT decision_id, feature_name, best[3] AS value, best[2] AS source_id
       FROM latest_obs""",
)
def _(m):
    d = choices.outcome_decisions(m.outcome_events, project=m.PROJECT())
    wide = features.asof_features(d, features.feature_columns(m.household_events))
    return features.feature_rows(wide, ["decision_id"])


@query(
    "latest_per_key",
    """SELECT user_id, max(row(ts, event_id))[2] AS event_id FROM events GROUP BY 1""",
)
def _(m):
    log = m.table("events").select("user_id", "ts", "event_id")
    return temporal.latest_per_key(log, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id"
    )


@query(
    "household_snapshot",
    """SELECT household_id, purchase_purpose, household_size_band, children_band,
              income_midpoint_million, liquid_capital_million, max_monthly_payment_million,
              purchase_horizon_days, workplace_zone, commute_tolerance_min,
              preferred_product_type, profile_confidence FROM households""",
    {"income_midpoint_million": 6, "liquid_capital_million": 6,
     "max_monthly_payment_million": 6, "commute_tolerance_min": 6, "profile_confidence": 6},
)
def _(m):
    return features.household_snapshot(m.household_events, as_of=mk.POPULATION_AS_OF)


@query(
    "confidence_threshold",
    """SELECT count(*) AS candidates, count_if(profile_confidence >= 0.8)::BIGINT AS included
       FROM households""",
)
def _(m):
    h = features.household_snapshot(m.household_events, as_of=mk.POPULATION_AS_OF)
    flag = F.col("profile_confidence") >= 0.8
    return h.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(flag).alias("included"))


def _requests(m: Market) -> DataFrame:
    return choices.outcome_decisions(m.outcome_events, project=m.PROJECT()).select(
        "decision_id", "household_id", "as_of",
        Market.hub(F.col("project_id")).alias("destination_anchor_id"),
    )


@query("asof_anchor", "SELECT decision_id, origin AS origin_anchor_id FROM anchored")
def _(m):
    return features.asof_anchor(
        _requests(m), features.project_anchors(m.qualification_events)
    ).select("decision_id", "origin_anchor_id")


@query(
    "travel_time_asof",
    f"""SELECT o.origin_anchor_id, o.destination_anchor_id, {ts_sql('o.as_of')} AS as_of,
               max(row(t.observed_at, t.source_id, t.travel_time_min))[3] AS travel_time_min
        FROM (SELECT DISTINCT 'NATION_' || c_nationkey AS origin_anchor_id,
                     'HUB-' || substr(o_orderpriority,1,1) AS destination_anchor_id,
                     o_orderdate AS as_of
              FROM orders JOIN customer ON c_custkey = o_custkey) o
        JOIN travel t ON t.origin_anchor_id = o.origin_anchor_id
         AND t.destination_anchor_id = o.destination_anchor_id AND t.valid_from <= o.as_of
         AND o.as_of < t.valid_to AND t.observed_at <= o.as_of
        GROUP BY 1, 2, 3""",
    {"travel_time_min": 6},
)
def _(m):
    customers = m.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    asked = m.table("orders").join(customers, "o_custkey").select(
        F.concat(F.lit("NATION_"), "c_nationkey").alias("origin_anchor_id"),
        F.concat(F.lit("HUB-"), F.substring("o_orderpriority", 1, 1)).alias(
            "destination_anchor_id"
        ),
        F.col("o_orderdate").alias("as_of"),
    )
    return features.travel_time_asof(asked, m.travel, horizon=m.horizon).drop(
        "travel_observed_at"
    )


@query(
    "commute_lookup",
    """SELECT a.decision_id, a.origin AS origin_anchor_id, t.best[3] AS commute_min
       FROM anchored a LEFT JOIN timed t USING (decision_id)""",
    {"commute_min": 6},
)
def _(m):
    return features.commute_lookup(
        _requests(m), features.project_anchors(m.qualification_events), m.travel,
        horizon=m.horizon,
    ).select("decision_id", "origin_anchor_id", "commute_min")


@query(
    "add_commute",
    """SELECT e.decision_id, a.alternative_id,
              CASE WHEN a.alternative_type = 'unit' THEN e.commute_min END AS commute_min
       FROM examples e JOIN alternatives a ON a.project_id = e.project_id
        AND a.as_of = e.as_of""",
    {"commute_min": 6},
)
def _(m):
    good, _ = _decisions(m)
    rows = choices.unpack_choice_sets(good.select("decision_id", "alts")).drop("commute_min")
    known = features.commute_lookup(
        _requests(m), features.project_anchors(m.qualification_events), m.travel,
        horizon=m.horizon,
    ).select("decision_id", "commute_min")
    # units of a project share their place, so a decision has one commute
    return choices.add_commute(rows, known, on=["decision_id"]).select(
        "decision_id", "alternative_id", "commute_min"
    )


@query(
    "population_commute",
    "SELECT household_id, project_id, commute_min FROM people",
    {"commute_min": 6},
)
def _(m):
    return m.people.select("household_id", "project_id", "commute_min")


# ---------------------------------------------------------------- model


def examples(m: Market) -> DataFrame:
    good, _ = calibration.build_examples(
        union_for_model(m), m.units, m.offers, travel=m.travel, project=m.PROJECT(),
        destination=Market.hub(F.col("project_id")), horizon=m.horizon,
    )
    return good


def union_for_model(m: Market) -> DataFrame:
    return events.union_events(m.qualification_events, m.outcome_events)


X_COLUMNS = {f"x{i}": 8 for i in range(8)}


@query(
    "choice_features",
    "SELECT decision_id, alternative_id, " + ", ".join(X_COLUMNS) + " FROM x_rows",
    X_COLUMNS,
)
def _(m):
    rows = choices.unpack_choice_sets(
        examples(m).select(
            "decision_id", "alts", "purchase_purpose", "preferred_product_type",
            "max_monthly_payment_million",
        )
    )
    vector = utility.choice_features(F.col, F.col)
    return rows.select(
        "decision_id", "alternative_id", *[c.alias(f"x{i}") for i, c in enumerate(vector)]
    )


@query(
    "choice_utility",
    """SELECT decision_id, alternative_id, u + CASE outside_option
                WHEN 'continue_renting' THEN CASE WHEN horizon_days > 180 THEN 0.12 ELSE 0 END
                WHEN 'postponed' THEN CASE WHEN horizon_days > 90 THEN 0.18 ELSE -0.05 END
                WHEN 'no_purchase' THEN -0.10 ELSE 0 END AS u FROM u_rows""",
    {"u": 6},
)
def _(m):
    rows = choices.unpack_choice_sets(
        examples(m).select(
            "decision_id", "alts", "purchase_purpose", "preferred_product_type",
            "max_monthly_payment_million", "purchase_horizon_days",
        )
    )
    return rows.select(
        "decision_id", "alternative_id", utility.choice_utility(F.col, F.col).alias("u")
    )


def _scored(m: Market) -> DataFrame:
    return utility.choice_probabilities(examples(m), mode="training")


@query(
    "choice_probabilities",
    "SELECT decision_id, alternative_id, p FROM p_rows",
    {"p": 8},
)
def choice_probabilities_query(m):
    return _scored(m).select(
        "decision_id",
        F.explode(F.arrays_zip(F.col("alts.alternative_id").alias("a"), F.col("p").alias("p")))
        .alias("r"),
    ).select("decision_id", F.col("r.a").alias("alternative_id"), F.col("r.p").alias("p"))


@query(
    "argmax_prediction",
    """SELECT decision_id, arg_max(alternative_id, row(round(p, 10), -alt_order)) AS predicted
       FROM p_rows GROUP BY 1""",
)
def _(m):
    rounded = F.transform("p", lambda x: F.round(x, 10))
    return _scored(m).select(
        "decision_id",
        F.get(F.col("alts.alternative_id"), utility.predicted(rounded)).alias("predicted"),
    )


@query(
    "log_loss",
    """SELECT count(*) AS examples, avg(loss) AS log_loss, avg(hit) AS top1_accuracy
       FROM sets_scored""",
    {"log_loss": 8, "top1_accuracy": 4},
)
def _(m):
    return utility.log_loss(_scored(m))


@query(
    "segment_metrics",
    """SELECT purchase_purpose AS segment, count(*) AS examples, avg(loss) AS log_loss,
              avg(hit) AS top1_accuracy FROM sets_scored GROUP BY 1""",
    {"log_loss": 8, "top1_accuracy": 4},
)
def _(m):
    return utility.segment_metrics(_scored(m))


@query(
    "uniform_baseline",
    """SELECT avg(loss) AS model_log_loss, avg(ln(n)) AS uniform_log_loss,
              (avg(ln(n)) - avg(loss)) / avg(ln(n)) * 100 AS improvement_pct FROM sets_scored""",
    {"model_log_loss": 8, "uniform_log_loss": 8, "improvement_pct": 6},
)
def _(m):
    return utility.uniform_baseline(_scored(m))


_GRADIENT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, sum((CASE WHEN alt_order = chosen THEN 1.0 ELSE 0.0 END - p) "
    f"* x{i}) AS gradient, (SELECT sum(loss) FROM sets_scored) AS loss_sum, "
    f"(SELECT count(*) FROM sets_scored) AS sets FROM p_rows WHERE chosen IS NOT NULL"
    for i, name in enumerate(DEFAULT_WEIGHTS)
)


@query("logit_gradient", _GRADIENT_SQL, {"gradient": 5, "loss_sum": 5})
def _(m):
    return logit.logit_gradient(logit.training_sets(examples(m)))


def _fit_sets(m: Market) -> DataFrame:
    return stored(logit.training_sets(examples(m)))


def _poisson_sql(key: str, replicate: str, seed: int = 42) -> str:
    """The Poisson(1) count of a set in a replicate: splitmix64 over the set's hash, then the inverse distribution."""
    full = "18446744073709551616::UHUGEINT"

    def mix(x: str) -> str:
        z = f"(({x})::UHUGEINT + 11400714819323198485::UHUGEINT) % {full}"
        for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
            z = f"list_transform([{z}], lambda z: (xor(z, z // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {full})[1]"
        return f"list_transform([{z}], lambda z: xor(z, z // {1 << 31}::UHUGEINT))[1]"

    start = mix(f"{seed}::UHUGEINT")
    base = mix(f"xor(('0x' || md5({key})[1:15])::UBIGINT::UHUGEINT, {start})")
    u = f"({mix(f'xor({base}, {mix(replicate)})')} // 2048::UHUGEINT)::DOUBLE / 9007199254740992.0::DOUBLE"
    cdf = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 25.0)])))
    return f"list_transform([{u}], lambda u: " + " + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in map(float, cdf)) + ")[1]"


def _newton_sql(rows: str, replicates: int = 0, l2: float = 0.001, tol: float = 1e-8) -> str:
    """(r, w, loss, epochs): the logit optimum by Newton steps as a recursion, r = -1 for all rows once, 0 and up for
    bootstrap replicates. A step solves its eight equations by Gauss-Jordan elimination over a list of 72 numbers."""
    k = range(8)
    pairs = [(i, j) for i in k for j in k if i <= j]
    start = "[" + ", ".join(f"{w}::DOUBLE" for w in DEFAULT_WEIGHTS.values()) + "]"
    utility_ = " + ".join(f"w[{i + 1}] * x{i}" for i in k)
    at = {(i, j): f"h{min(i, j)}{max(i, j)} / n" + (f" + {l2}::DOUBLE" if i == j else "") for i in k for j in k}
    augmented = ", ".join(", ".join([*(at[i, j] for j in k), f"g[{i + 1}]"]) for i in k)
    solved = f"""list_reduce(list_concat([[{augmented}]], list_transform(range(8), lambda p: [p::DOUBLE])), lambda a, p:
        list_transform(range(72), lambda t: CASE WHEN t // 9 = p[1] THEN a[t + 1] / a[p[1]::INT * 10 + 1]
          ELSE a[t + 1] - a[(t // 9) * 9 + p[1]::INT + 1] * a[p[1]::INT * 9 + t % 9 + 1] / a[p[1]::INT * 10 + 1] END))"""
    draws = "SELECT -1 AS r, decision_id, 1 AS c FROM (SELECT DISTINCT decision_id FROM fit_rows)" if not replicates else (
        f"SELECT * FROM (SELECT r, decision_id, {_poisson_sql('decision_id', 'r')} AS c FROM "
        f"(SELECT DISTINCT decision_id FROM fit_rows), range({replicates}) t(r)) WHERE c > 0"
    )
    return f"""
    WITH RECURSIVE fit_rows AS MATERIALIZED ({rows}), draws AS MATERIALIZED ({draws}),
      newton AS (
        SELECT 0 AS epochs, r, {start} AS w, {start} AS base, 0::DOUBLE AS loss, false AS done FROM (SELECT DISTINCT r FROM draws)
        UNION ALL
        SELECT epochs, r, list_transform(range(1, 9), lambda i: w[i] + solved[9 * i]), w, loss / n,
               list_max(list_transform(g, lambda x: abs(x))) <= {tol}
        FROM (SELECT *, {solved} AS solved FROM (
          SELECT *, [{', '.join(f'g{i} / n - {l2}::DOUBLE * w[{i + 1}]' for i in k)}] AS g FROM (
            SELECT r, any_value(epochs) + 1 AS epochs, any_value(w) AS w, sum(c)::DOUBLE AS n, sum(c * -ln(greatest(eh / z, 1e-15::DOUBLE))) AS loss,
                   {', '.join(f'sum(c * (c{i} - s{i} / z)) AS g{i}' for i in k)},
                   {', '.join(f'sum(c * (s{i}{j} / z - s{i} / z * s{j} / z)) AS h{i}{j}' for i, j in pairs)}
            FROM (SELECT r, decision_id, any_value(epochs) AS epochs, any_value(w) AS w, any_value(c) AS c, sum(e) AS z, max(CASE WHEN hit THEN e END) AS eh,
                         {', '.join(f'max(CASE WHEN hit THEN x{i} END) AS c{i}, sum(e * x{i}) AS s{i}' for i in k)},
                         {', '.join(f'sum(e * x{i} * x{j}) AS s{i}{j}' for i, j in pairs)}
                  FROM (SELECT n.r, n.epochs, n.w, d.c, f.*, exp({utility_}) AS e
                        FROM newton n JOIN draws d ON d.r = n.r JOIN fit_rows f ON f.decision_id = d.decision_id
                        WHERE NOT n.done AND n.epochs < 50)
                  GROUP BY r, decision_id)
            GROUP BY r))))
    SELECT r, base AS w, loss, epochs, done FROM newton QUALIFY row_number() OVER (PARTITION BY r ORDER BY epochs DESC) = 1"""


X_SQL = ", ".join(f"x{i}" for i in range(8))
FIT_ROWS_SQL = f"SELECT decision_id, alt_order = chosen AS hit, {X_SQL} FROM x_rows WHERE chosen IS NOT NULL"
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in DEFAULT_WEIGHTS) + "]"


@query(
    "logit_fit",
    f"""SELECT {NAMES_SQL}[i] AS feature, w[i] AS weight, loss AS log_loss, epochs, done AS converged
        FROM ({_newton_sql(FIT_ROWS_SQL)}), range(1, 9) t(i)""",
    {"weight": 6, "log_loss": 6},
)
def _(m):
    fit = logit.logit_fit(_fit_sets(m))
    return m.spark.createDataFrame(
        [(n, w, fit.loss, fit.epochs, fit.converged) for n, w in fit.weights.items()],
        "feature string, weight double, log_loss double, epochs int, converged boolean",
    )


BOOTSTRAP_SQL = f"""SELECT r AS replicate, {NAMES_SQL}[i] AS feature, w[i] AS weight
    FROM ({_newton_sql(FIT_ROWS_SQL, 100)}), range(1, 9) t(i)"""


@query("bootstrap_fit", BOOTSTRAP_SQL, {"weight": 6})
def _(m):
    samples = logit.bootstrap_fit(_fit_sets(m))
    return logit.parameter_frame(m.spark, samples)


@query(
    "coefficient_intervals",
    f"""SELECT b.feature, any_value(f.weight) AS estimate, quantile_cont(b.weight, 0.025) AS lower,
               quantile_cont(b.weight, 0.975) AS upper, count(*) AS bootstrap_samples,
               quantile_cont(b.weight, 0.025) <= 0 AND quantile_cont(b.weight, 0.975) >= 0 AS crosses_zero
        FROM ({BOOTSTRAP_SQL}) b JOIN (SELECT {NAMES_SQL}[i] AS feature, w[i] AS weight
          FROM ({_newton_sql(FIT_ROWS_SQL)}), range(1, 9) t(i)) f USING (feature) GROUP BY 1""",
    {"estimate": 6, "lower": 6, "upper": 6},
)
def _(m):
    sets = _fit_sets(m)
    fit = logit.logit_fit(sets)
    samples = logit.bootstrap_fit(sets, init=fit.weights)
    return logit.coefficient_intervals(logit.parameter_frame(m.spark, samples), fit.weights)


@query(
    "temporal_holdout",
    """SELECT decision_id, CASE WHEN row_number() OVER (ORDER BY as_of, md5(decision_id))
                <= count(*) OVER () - greatest(1, round_even(count(*) OVER () * 0.2, 0))
              THEN 'train' ELSE 'holdout' END AS split FROM decisions""",
)
def _(m):
    d = choices.outcome_decisions(m.outcome_events, project=m.PROJECT())
    return calibration.temporal_holdout(d).select("decision_id", "split")


# ---------------------------------------------------------------- population


def _prototypes(m: Market) -> DataFrame:
    h = features.household_snapshot(m.household_events, as_of=mk.POPULATION_AS_OF)
    return pop.population_prototypes(h)


@query(
    "population_profile",
    "SELECT key_hash, purchase_purpose, households, lo, hi FROM ranged",
)
def _(m):
    return _prototypes(m).select(
        F.md5("canonical_key").alias("key_hash"), "purchase_purpose", "households", "lo", "hi"
    )


@query("prototype_key", "SELECT key_hash, households FROM protos")
def _(m):
    h = features.household_snapshot(m.household_events, as_of=mk.POPULATION_AS_OF)
    return h.groupBy(F.md5(pop.prototype_key()).alias("key_hash")).agg(
        F.count(F.lit(1)).alias("households")
    )


def _resampled(m: Market) -> tuple[DataFrame, DataFrame]:
    protos = cut_lineage(_prototypes(m))
    total = pop.profile_identity(protos).first()["source_households"]
    drawn = pop.resample_population(
        protos, m.table("customer").count(), seed=42, households=total, version="bench"
    )
    return protos, drawn


@query(
    "resample_population",
    f"""SELECT draw, {mk.uuid5_sql('a2da2908-6a0c-4e3d-ad26-a5b12ccf82d5',
                                   "'bench:42:' || draw")} AS household_id,
               purchase_purpose, workplace_zone, purchase_horizon_days FROM drawn""",
)
def _(m):
    return _resampled(m)[1].select(
        "draw", "household_id", "purchase_purpose", "workplace_zone", "purchase_horizon_days"
    )


def _marginal_sql() -> str:
    parts = []
    for f in pop.CATEGORICAL:
        parts.append(
            f"SELECT '{f}' AS field, 0.5 * sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) AS "
            f"total_variation_distance, count(*) AS categories FROM (SELECT coalesce({f}, "
            f"'unknown') AS c, sum(households) / (SELECT sum(households) FROM protos)::DOUBLE "
            f"AS s FROM protos GROUP BY 1) a FULL JOIN (SELECT coalesce({f}, 'unknown') AS c, "
            f"count(*) / (SELECT count(*) FROM drawn)::DOUBLE AS s FROM drawn GROUP BY 1) b "
            f"ON a.c = b.c"
        )
    return " UNION ALL ".join(parts)


@query(
    "marginal_distance",
    f"SELECT *, total_variation_distance > 0.10 AS mismatch FROM ({_marginal_sql()})",
    {"total_variation_distance": 8},
)
def _(m):
    source, synthetic = _resampled(m)
    return pop.marginal_distance(source, synthetic, weight="households")


@query(
    "numeric_compare",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, a AS source_mean, b AS synthetic_mean, abs(a - b) AS "
        f"absolute_mean_delta FROM (SELECT (SELECT sum({f} * households) / sum(CASE WHEN {f} IS "
        f"NOT NULL THEN households END)::DOUBLE FROM protos) AS a, (SELECT avg({f}) FROM drawn) "
        f"AS b)"
        for f in pop.NUMERIC
    ),
    {"source_mean": 6, "synthetic_mean": 6, "absolute_mean_delta": 6},
)
def _(m):
    source, synthetic = _resampled(m)
    return pop.numeric_compare(source, synthetic, weight="households")


@query(
    "population_fit",
    """SELECT count(*) AS candidates, count_if(profile_confidence >= 0.8)::BIGINT AS included,
              count_if(profile_confidence < 0.8)::BIGINT AS excluded FROM households""",
)
def _(m):
    fit = pop.population_fit(
        m.household_events, as_of=mk.POPULATION_AS_OF, minimum_confidence=0.8
    )
    return m.spark.createDataFrame(
        [(fit.candidates, fit.included, fit.excluded)],
        "candidates long, included long, excluded long",
    )


# ---------------------------------------------------------------- scenarios

SCENARIOS = (
    Scenario("base"),
    Scenario("discount", price_change_pct=-0.10, payment_multiplier=0.9, commute_multiplier=0.85),
    Scenario("villas", eligible_product_types=("street_villa", "garden_villa")),
)
PARAMETERS = tuple(
    {**DEFAULT_WEIGHTS, "price_per_billion": a, "monthly_payment_per_10m": b, "product_match": c}
    for a, b, c in ((-0.58, -0.42, 0.85), (-0.70, -0.30, 0.60), (-0.40, -0.60, 1.10))
)


def _picks(m: Market, mode: str, **options) -> DataFrame:
    return scenarios.scenario_picks(
        m.people, m.market_sets, SCENARIOS, PARAMETERS,
        replications=2 if mode == "sampled" else 1, mode=mode, **options,
    )


EXPECTED_SQL = "SELECT *, 0 AS replication, p AS n FROM sim_p"
SAMPLED_SQL = "SELECT *, 1.0::DOUBLE AS n FROM sim_pick"


def _share_sql(rows: str) -> str:
    return (
        f"SELECT scenario_id, parameter, replication, sum(CASE WHEN alternative_type = 'unit' "
        f"THEN n ELSE 0 END) / sum(n) AS unit_share FROM ({rows}) GROUP BY 1, 2, 3"
    )


SUMMARY_SQL = (
    "avg(v) AS mean, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, "
    "quantile_cont(v, 0.95) AS p95, min(v) AS minimum, max(v) AS maximum, count(*) AS samples"
)
SUMMARY_DOUBLES = {c: 8 for c in ("mean", "p05", "p50", "p95", "minimum", "maximum")}


@query(
    "apply_scenario",
    f"""SELECT s.scenario_id, a.project_id, a.alternative_id,
               CASE WHEN a.alternative_type = 'unit' THEN a.effective_price * (1 + s.price) END
                 AS effective_price,
               CASE WHEN a.alternative_type = 'unit' THEN a.monthly_payment_est * s.pay END
                 AS monthly_payment_est
        FROM market_alts a, scen s
        WHERE a.alternative_type <> 'unit' OR s.eligible IS NULL
           OR list_contains(string_split(s.eligible, ','), a.product_type)""",
    {"effective_price": 2, "monthly_payment_est": 2},
)
def _(m):
    changed = scenarios.apply_scenario(m.market_sets, SCENARIOS)
    return choices.unpack_choice_sets(changed).select(
        "scenario_id", "project_id", "alternative_id", "effective_price", "monthly_payment_est"
    )


@query(
    "population_x_alternatives",
    """SELECT project_id, count(DISTINCT household_id) AS households, count(*) AS pairs
       FROM people JOIN market_alts USING (project_id) GROUP BY 1""",
)
def _(m):
    grouped = scenarios.population_sets(m.people, m.market_sets)
    return grouped.groupBy("project_id").agg(
        F.sum("households").alias("households"),
        F.sum(F.col("households") * F.size("alts")).alias("pairs"),
    )


@query(
    "dropped_alternatives",
    """SELECT s.scenario_id, count_if(a.alternative_type = 'unit' AND s.eligible IS NOT NULL AND
                NOT list_contains(string_split(s.eligible, ','), a.product_type))::BIGINT
                AS dropped_alternatives
       FROM people h JOIN market_alts a USING (project_id), scen s GROUP BY 1""",
)
def _(m):
    return scenarios.dropped_alternatives(m.people, m.market_sets, SCENARIOS)


@query(
    "sampled_choice",
    """SELECT scenario_id, parameter, replication, segment, project_id, alternative_id,
              count(*)::DOUBLE AS n FROM sim_pick GROUP BY ALL""",
    {"n": 4},
)
def _(m):
    return _picks(m, "sampled").drop("alternative_type")


@query(
    "choice_share",
    f"""SELECT scenario_id, parameter, alternative_id,
               sum(n) / (sum(sum(n)) OVER (PARTITION BY scenario_id, parameter)) AS share
        FROM ({EXPECTED_SQL}) GROUP BY 1, 2, 3""",
    {"share": 8},
)
def _(m):
    return scenarios.choice_share(_picks(m, "expected", segments=False, merged=False)).select(
        "scenario_id", "parameter", "alternative_id", "share"
    )


@query(
    "segment_share",
    f"""SELECT scenario_id, parameter, segment, alternative_id,
               sum(n) / (sum(sum(n)) OVER (PARTITION BY scenario_id, parameter, segment)) AS share
        FROM ({EXPECTED_SQL}) GROUP BY 1, 2, 3, 4""",
    {"share": 8},
)
def _(m):
    return scenarios.segment_share(_picks(m, "expected", merged=False)).select(
        "scenario_id", "parameter", "segment", "alternative_id", "share"
    )


@query(
    "quantile_summary",
    f"SELECT scenario_id, {SUMMARY_SQL} FROM (SELECT scenario_id, unit_share AS v FROM "
    f"({_share_sql(EXPECTED_SQL)})) GROUP BY 1",
    SUMMARY_DOUBLES,
)
def _(m):
    return scenarios.quantile_summary(
        scenarios.unit_share(scenarios.expected_mass(m.people, m.market_sets, SCENARIOS, PARAMETERS)),
        "unit_share", by=["scenario_id"],
    )


ENSEMBLE_SQL = f"""
    WITH picks AS ({SAMPLED_SQL}), shares AS (
      SELECT scenario_id, parameter, replication, 'choice_share' AS measure,
             alternative_id AS key, sum(n) / any_value(total) AS v
      FROM picks JOIN (SELECT scenario_id, parameter, replication, sum(n) AS total FROM picks
                       GROUP BY 1, 2, 3) USING (scenario_id, parameter, replication)
      GROUP BY 1, 2, 3, 5
      UNION ALL
      SELECT scenario_id, parameter, replication, 'unit_share', '', unit_share
      FROM ({_share_sql('SELECT * FROM picks')})
      UNION ALL
      SELECT scenario_id, parameter, replication, 'outside_share', '', 1 - unit_share
      FROM ({_share_sql('SELECT * FROM picks')})
      UNION ALL
      SELECT scenario_id, parameter, replication, 'segment_unit_share', segment,
             sum(CASE WHEN alternative_type = 'unit' THEN n ELSE 0 END) / sum(n)
      FROM picks GROUP BY 1, 2, 3, 5),
    keys AS (SELECT DISTINCT scenario_id, measure, key FROM shares),
    runs AS (SELECT DISTINCT parameter, replication FROM picks)
    SELECT scenario_id, measure, key, {SUMMARY_SQL}
    FROM (SELECT k.scenario_id, k.measure, k.key, coalesce(s.v, 0) AS v FROM keys k, runs r
          LEFT JOIN shares s ON s.scenario_id = k.scenario_id AND s.measure = k.measure
           AND s.key = k.key AND s.parameter = r.parameter AND s.replication = r.replication)
    GROUP BY 1, 2, 3"""


@query("scenario_ensemble", f"SELECT * FROM ({ENSEMBLE_SQL})", SUMMARY_DOUBLES)
def _(m):
    return scenarios.scenario_ensemble(_picks(m, "sampled", merged=False), runs=6)


@query(
    "scenario_compare",
    f"""SELECT measure, {SUMMARY_SQL} FROM (
          SELECT unnest(['control', 'treatment', 'effect']) AS measure,
                 unnest([c, t, t - c]) AS v
          FROM (SELECT max(CASE WHEN scenario_id = 'base' THEN unit_share END) AS c,
                       max(CASE WHEN scenario_id = 'discount' THEN unit_share END) AS t
                FROM ({_share_sql(SAMPLED_SQL)}) GROUP BY parameter, replication))
        GROUP BY 1""",
    SUMMARY_DOUBLES,
)
def _(m):
    return scenarios.scenario_compare(
        _picks(m, "sampled"), control="base", treatment="discount"
    )


# ---------------------------------------------------------------- audit


@query(
    "event_counts",
    "SELECT event_type, source_id, count(*) AS events FROM canonical GROUP BY 1, 2",
)
def _(m):
    return audit.event_counts(m.canonical)


HH_FLAGS_SQL = """
    SELECT entity_id, bool_or(event_type = 'qualification_observed') AS q,
           bool_or(event_type = 'reason_observed') AS reason,
           bool_or(coalesce(payload['outside_option'], '') NOT IN ('', 'unknown')
                   AND event_type <> 'decision_stage_observed') AS outside_option, {fields}
    FROM canonical WHERE entity_type = 'household' GROUP BY 1""".format(
    fields=", ".join(
        f"bool_or(event_type = 'qualification_observed' AND coalesce(payload['{f}'], '') "
        f"NOT IN ('', 'unknown')) AS {f}"
        for f in audit.COVERAGE_FIELDS if f != "outside_option"
    )
)


@query(
    "coverage",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, count_if({f})::BIGINT AS present, count(*) AS denominator, "
        f"count_if({f}) / count(*)::DOUBLE AS rate FROM ({HH_FLAGS_SQL}) WHERE q"
        for f in (*audit.COVERAGE_FIELDS, "reason")
    ),
    {"rate": 8},
)
def _(m):
    return audit.coverage(m.canonical)


@query(
    "readiness_audit",
    f"""SELECT * EXCLUDE (oc, rc, sl),
          'ready' AS price_status, 'ready' AS payment_status, 'ready' AS commute_status,
          'ready' AS product_status, 'ready' AS outside_options_status, '' AS blockers,
          CASE WHEN oc / qualified_households::DOUBLE < 0.5
               THEN 'outside_option_coverage_below_50_percent' ELSE '' END
          || CASE WHEN rc / qualified_households::DOUBLE < 0.5 THEN
               CASE WHEN oc / qualified_households::DOUBLE < 0.5 THEN ';' ELSE '' END
               || 'reason_coverage_below_50_percent' ELSE '' END AS warnings,
          true AS training_ready
        FROM (SELECT e.*, h.* FROM (
          SELECT count(*) AS total_events,
            count_if(event_type IN ('decision_outcome_observed', 'decision_outcome_verified')
              AND payload['verified'] = 'true')::BIGINT AS verified_outcomes,
            count_if(event_type = 'site_tour_observed')::BIGINT AS site_tours,
            count_if(event_type IN ('decision_outcome_observed', 'decision_outcome_verified')
              AND payload['verified'] = 'true' AND (coalesce(payload['unit_code'], '') <> ''
              OR coalesce(payload['outside_option'], '') <> ''))::BIGINT
              AS trainable_choice_events,
            count_if(event_type = 'offer_observed')::BIGINT AS price_evidence,
            count_if(event_type = 'offer_observed')::BIGINT AS payment_evidence,
            count_if(event_type = 'unit_version_observed')::BIGINT AS product_evidence
          FROM canonical) e, (
          SELECT count(*) AS households, count_if(q)::BIGINT AS qualified_households,
            count_if(workplace_zone)::BIGINT AS commute_evidence,
            count_if(outside_option)::BIGINT AS outside_options_evidence,
            count_if(outside_option AND q) AS oc, count_if(reason AND q) AS rc,
            count_if(shortlisted_unit_code) AS sl FROM ({HH_FLAGS_SQL})) h)""",
)
def _(m):
    return audit.readiness_audit(m.canonical)


# ---------------------------------------------------------------- experiments


@query(
    "validate_experiments",
    """SELECT experiment_id, 'planned_start_at must be before planned_end_at' AS message
       FROM definitions WHERE extract(day FROM planned_start_at) % 5 = 0""",
)
def _(m):
    day = F.dayofmonth("planned_start_at")
    spoiled = m.definitions.withColumn(
        "planned_end_at",
        F.when(day % 5 == 0, F.col("planned_start_at")).otherwise(F.col("planned_end_at")),
    )
    return experiments.validate_experiments(spoiled).select("experiment_id", "message")


@query(
    "validate_predictions",
    """SELECT p.experiment_id, CASE WHEN extract(day FROM created_at) % 4 = 0 THEN 'rejected'
                WHEN o.experiment_id IS NOT NULL OR later THEN 'rejected' ELSE 'locked' END AS status,
              CASE WHEN extract(day FROM created_at) % 4 = 0 THEN 'metric mismatch'
                WHEN o.experiment_id IS NOT NULL
                THEN 'first observation or assignment precedes the lock'
                WHEN later THEN 'already locked and immutable' END AS reason
       FROM (SELECT *, false AS later FROM predictions
             UNION ALL SELECT *, true FROM predictions) p LEFT JOIN (SELECT DISTINCT experiment_id FROM observations
         WHERE successes >= 4) o USING (experiment_id)""",
)
def _(m):
    spoiled = m.predictions.withColumn(
        "metric_name",
        F.when(F.dayofmonth("created_at") % 4 == 0, "other").otherwise(F.col("metric_name")),
    )
    # a second, different forecast of every experiment a minute later
    second = spoiled.withColumns({
        "created_at": F.col("created_at") + F.expr("INTERVAL 1 MINUTE"),
        "ensemble_samples": F.col("ensemble_samples") + 1,
    })
    seen = m.observations.where(F.col("successes") >= 4)
    return experiments.validate_predictions(
        spoiled.unionByName(second), m.definitions, observations=seen
    ).select("experiment_id", "status", "reason")


@query(
    "validate_assignments",
    """WITH valid AS (
         SELECT r.*, row_number() OVER (PARTITION BY r.experiment_id, r.subject_key
                       ORDER BY assigned_at, source_id, source_event_key) AS pos,
                first_value(variant) OVER (PARTITION BY r.experiment_id, r.subject_key
                       ORDER BY assigned_at, source_id, source_event_key) AS v1
         FROM receipts r JOIN predictions p USING (experiment_id))
       SELECT experiment_id, source_event_key,
              CASE WHEN pos = 1 THEN 'accepted' WHEN variant = v1 THEN 'duplicate'
                   ELSE 'rejected' END AS status,
              CASE WHEN pos = 1 THEN NULL WHEN variant = v1 THEN 'subject already assigned'
                   ELSE 'subject assigned to a conflicting variant' END AS reason FROM valid
       UNION ALL
       SELECT experiment_id, source_event_key, 'rejected', 'no locked prediction'
       FROM receipts WHERE experiment_id NOT IN (SELECT experiment_id FROM predictions)""",
)
def _(m):
    return experiments.validate_assignments(m.receipts, m.definitions, m.predictions).select(
        "experiment_id", "source_event_key", "status", "reason"
    )


@query(
    "validate_observations",
    """WITH sent AS (
         SELECT * FROM observations UNION ALL
         SELECT * REPLACE (observed_at + INTERVAL 1 MINUTE AS observed_at) FROM observations)
       SELECT s.experiment_id, s.source_event_key,
              strftime(s.observed_at, '%Y-%m-%d %H:%M:%S.%f') AS observed_at,
              CASE WHEN p.experiment_id IS NULL THEN 'rejected'
                   WHEN s.observed_at = min(s.observed_at) OVER (PARTITION BY s.experiment_id,
                     s.source_event_key) THEN 'accepted' ELSE 'duplicate' END AS status
       FROM sent s LEFT JOIN predictions p USING (experiment_id)""",
)
def _(m):
    again = m.observations.withColumn(
        "observed_at", F.col("observed_at") + F.expr("INTERVAL 1 MINUTE")
    )
    return experiments.validate_observations(
        m.observations.unionByName(again), m.definitions, m.predictions
    ).select("experiment_id", "source_event_key", "observed_at", "status")


@query(
    "variant_aggregate",
    """SELECT experiment_id, variant, s AS successes, n AS trials, s / n::DOUBLE AS rate
       FROM totals""",
    {"rate": 8},
)
def _(m):
    return experiments.variant_aggregate(m.observations)


EFFECT = {"effect": 8, "ci95_low": 8, "ci95_high": 8}


@query(
    "effect_ci95",
    """SELECT experiment_id, tr - cr AS effect,
         greatest(tr - cr - 1.96 * sqrt(cr * (1 - cr) / cn + tr * (1 - tr) / tn), -1.0)
           AS ci95_low,
         least(tr - cr + 1.96 * sqrt(cr * (1 - cr) / cn + tr * (1 - tr) / tn), 1.0) AS ci95_high
       FROM arms""",
    EFFECT,
)
def _(m):
    effect, low, high = experiments.effect_ci95()
    return experiments._arms(m.definitions, m.observations).select(
        "experiment_id", effect.alias("effect"), low.alias("ci95_low"), high.alias("ci95_high")
    )


@query(
    "direction_sign",
    """SELECT experiment_id, CASE WHEN tr - cr > 1e-12 THEN 1 WHEN tr - cr < -1e-12 THEN -1
              ELSE 0 END::BIGINT AS sign FROM arms""",
)
def _(m):
    gap = F.col("treatment_rate") - F.col("control_rate")
    return experiments._arms(m.definitions, m.observations).select(
        "experiment_id", experiments.direction_sign(gap).alias("sign")
    )


@query(
    "evaluate_experiment",
    """SELECT experiment_id, model_artifact_id, cn AS control_trials, tn AS treatment_trials,
              eff AS observed_effect, greatest(eff - margin, -1.0) AS ci95_low,
              least(eff + margin, 1.0) AS ci95_high, abs(eff - effect_p50) AS absolute_error,
              eff BETWEEN effect_p05 AND effect_p95 AS within_interval, enough
                AS minimum_sample_reached, causal AS causal_allowed,
              array_to_string(list_filter([
                CASE WHEN NOT enough THEN 'minimum_sample_not_reached' END,
                CASE WHEN NOT causal THEN 'non_randomized_assignment:' || assignment_method
                  || ': effect is associative, not causal' END,
                CASE WHEN eff - margin <= 0 AND eff + margin >= 0
                  THEN 'observed_effect_ci_crosses_zero' END,
                CASE WHEN NOT (eff BETWEEN effect_p05 AND effect_p95)
                  THEN 'observed_effect_outside_predicted_interval' END],
                lambda x: x IS NOT NULL), ';') AS warnings
       FROM eval""",
    {"observed_effect": 8, "ci95_low": 8, "ci95_high": 8, "absolute_error": 8},
)
def _(m):
    done, _ = experiments.evaluate_experiment(m.definitions, m.predictions, m.observations)
    return done.select(
        "experiment_id", "model_artifact_id", "control_trials", "treatment_trials",
        "observed_effect", "ci95_low", "ci95_high", "absolute_error", "within_interval",
        "minimum_sample_reached", "causal_allowed", "warnings",
    )


SRM_DOUBLES = {"observed_treatment_share": 8, "sample_ratio_zscore": 6}


@query(
    "srm_check",
    """WITH r AS (SELECT experiment_id, count_if(variant = 'control')::BIGINT AS c,
                         count_if(variant = 'treatment')::BIGINT AS t FROM receipts GROUP BY 1)
       SELECT a.experiment_id, cn + tn AS total_trials, 'assignment_receipts'
                AS allocation_source, c AS control_assignments, t AS treatment_assignments,
              t / (c + t)::DOUBLE AS observed_treatment_share,
              (t - (c + t) * 0.5) / sqrt((c + t) * 0.25) AS sample_ratio_zscore,
              abs((t - (c + t) * 0.5) / sqrt((c + t) * 0.25)) >= 3.29 AS sample_ratio_mismatch
       FROM arms a JOIN r USING (experiment_id)""",
    SRM_DOUBLES,
)
def _(m):
    return experiments.srm_check(m.definitions, m.observations, m.receipts).select(
        "experiment_id", "total_trials", "allocation_source", "control_assignments",
        "treatment_assignments", "observed_treatment_share", "sample_ratio_zscore",
        "sample_ratio_mismatch",
    )


@query(
    "srm_buckets",
    """WITH b AS (
         SELECT experiment_id, variant, 'date' AS bucket_type,
                strftime(assigned_at, '%Y-%m-%d') AS bucket FROM receipts UNION ALL
         SELECT experiment_id, variant, 'channel', channel FROM receipts
         WHERE channel IS NOT NULL UNION ALL
         SELECT experiment_id, variant, 'cohort', cohort FROM receipts),
       g AS (SELECT experiment_id, bucket_type, bucket,
                    count_if(variant = 'control')::BIGINT AS c,
                    count_if(variant = 'treatment')::BIGINT AS t FROM b GROUP BY 1, 2, 3)
       SELECT experiment_id, bucket_type, bucket, c AS control_assignments,
              t AS treatment_assignments, c + t AS total_assignments,
              t / (c + t)::DOUBLE AS observed_treatment_share,
              (t - (c + t) * 0.5) / sqrt((c + t) * 0.25) AS sample_ratio_zscore,
              abs((t - (c + t) * 0.5) / sqrt((c + t) * 0.25)) >= 3.29 AS sample_ratio_mismatch
       FROM g""",
    SRM_DOUBLES,
)
def _(m):
    return experiments.srm_buckets(m.definitions, m.receipts)


CARD_DOUBLES = {
    "mean_absolute_effect_error": 8, "predicted_interval_coverage_rate": 8,
    "direction_accuracy": 8,
}


@query(
    "model_scorecard",
    """SELECT model_artifact_id, n AS evaluated_experiments, causal_n AS causal_experiments,
              enough_n AS minimum_sample_experiments, mae AS mean_absolute_effect_error,
              coverage AS predicted_interval_coverage_rate, direction AS direction_accuracy
       FROM cards""",
    CARD_DOUBLES,
)
def _(m):
    return _scores(m).scorecards.select(
        "model_artifact_id", "evaluated_experiments", "causal_experiments",
        "minimum_sample_experiments", "mean_absolute_effect_error",
        "predicted_interval_coverage_rate", "direction_accuracy",
    )


def _scores(m: Market) -> forecast.ModelScores:
    return forecast.score_models(m.definitions, m.predictions, m.observations)


STATE_SQL = """
    SELECT model_artifact_id, CASE WHEN n < 5 OR causal_n < 3 THEN 'insufficient_evidence'
             WHEN mae > 0.05 OR coverage < 0.8 OR direction < 0.7 THEN 'review_recalibration'
             ELSE 'monitor' END AS state,
           CASE WHEN n < 5 OR causal_n < 3 THEN array_to_string(list_filter([
               CASE WHEN n < 5 THEN 'insufficient_evaluated_experiments' END,
               CASE WHEN causal_n < 3 THEN 'insufficient_causal_experiments' END],
               lambda x: x IS NOT NULL), ';')
             ELSE array_to_string(list_filter([
               CASE WHEN mae > 0.05 THEN 'mean_absolute_effect_error_above_threshold' END,
               CASE WHEN coverage < 0.8
                 THEN 'prediction_interval_coverage_below_threshold' END,
               CASE WHEN direction < 0.7 THEN 'effect_direction_accuracy_below_threshold' END],
               lambda x: x IS NOT NULL), ';') END AS reasons,
           true AS human_review_required, false AS automatic_retraining_allowed FROM cards"""


@query("recalibration_assessment", STATE_SQL)
def _(m):
    return _scores(m).states


@query(
    "score_models",
    f"""SELECT c.model_artifact_id, c.n AS evaluated_experiments, s.state, s.reasons
        FROM cards c JOIN ({STATE_SQL}) s USING (model_artifact_id)""",
)
def _(m):
    scores = _scores(m)
    return scores.scorecards.select("model_artifact_id", "evaluated_experiments").join(
        scores.states.select("model_artifact_id", "state", "reasons"), "model_artifact_id"
    )


@query(
    "experiment_overview",
    """SELECT d.experiment_id, p.experiment_id IS NOT NULL AS prediction_locked,
              (SELECT count(*) FROM observations o WHERE o.experiment_id = d.experiment_id)
                AS observations, cn + tn AS trials
       FROM arms d LEFT JOIN predictions p USING (experiment_id)""",
)
def _(m):
    return experiments.experiment_overview(
        m.definitions, m.predictions, m.observations
    ).drop("created_at")


# ---------------------------------------------------------------- governance


GOV_PATH_SQL = """
    WITH RECURSIVE path AS (
      SELECT DISTINCT artifact_id, -1::BIGINT AS seq, 'candidate' AS status, 0 AS step FROM gov
      UNION ALL
      SELECT artifact_id, best[1], best[2], step + 1 FROM (
        SELECT p.artifact_id, p.step, min(row(g.seq, g.status)) AS best
        FROM path p JOIN gov g ON g.artifact_id = p.artifact_id AND g.seq > p.seq
         AND ((p.status = 'candidate' AND g.status IN ('validated', 'rejected', 'archived'))
           OR (p.status = 'validated' AND g.status IN ('approved', 'rejected', 'archived'))
           OR (p.status IN ('approved', 'rejected') AND g.status = 'archived'))
        GROUP BY 1, 2))
    SELECT g.artifact_id, g.seq, g.status,
           (SELECT max(row(p.seq, p.status)) FROM path p WHERE p.artifact_id = g.artifact_id
             AND p.seq < g.seq)[2] AS from_status,
           EXISTS (SELECT 1 FROM path p WHERE p.artifact_id = g.artifact_id AND p.seq = g.seq)
             AS accepted FROM gov g"""


@query("status_timeline", f"SELECT * FROM ({GOV_PATH_SQL})")
def _(m):
    return governance.status_timeline(m.governance).select(
        "artifact_id", "seq", "status", "from_status", "accepted"
    )


@query(
    "validate_model_decisions",
    f"""SELECT artifact_id, seq, CASE WHEN substr(artifact_id, 2)::BIGINT % 10 = 9
                 THEN 'unregistered_artifact' ELSE 'invalid_transition' END AS code,
               from_status || ' -> ' || status AS message
        FROM ({GOV_PATH_SQL}) WHERE substr(artifact_id, 2)::BIGINT % 10 = 9 OR NOT accepted""",
)
def _(m):
    return governance.validate_model_decisions(m.governance, m.artifacts).drop("severity")


@query(
    "current_model_status",
    f"""SELECT a.artifact_id, coalesce(max(row(g.seq, g.status))[2], 'candidate') AS status,
              max(g.seq) AS last_seq
       FROM (SELECT DISTINCT 'A' || user_id AS artifact_id FROM events
             WHERE user_id % 10 <> 9) a
       LEFT JOIN (SELECT * FROM ({GOV_PATH_SQL}) WHERE accepted) g USING (artifact_id)
       GROUP BY 1""",
)
def _(m):
    return governance.current_model_status(m.artifacts, m.governance).select(
        "artifact_id", "status", "last_seq"
    )


@query(
    "register_artifacts",
    """SELECT 'A' || user_id AS artifact_id,
              CASE WHEN user_id % 3 = 0 THEN 'conflict' WHEN user_id % 3 = 1
                   THEN 'already_registered' ELSE 'registered' END AS status
       FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 9)""",
)
def _(m):
    user = F.substring("artifact_id", 2, 20).cast("long")
    stored = m.artifacts.where(user % 3 != 2).withColumn(
        "model_version",
        F.when(user % 3 == 0, "changed").otherwise(F.col("model_version")),
    )
    return governance.register_artifacts(m.artifacts, stored).select("artifact_id", "status")


@query(
    "artifact_content_hash",
    """SELECT 'A' || user_id AS artifact_id, sha256('{"model_name":"buyer-choice",' ||
              '"model_version":"' || (user_id % 7) || '"}') AS content_hash
       FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 9)""",
)
def _(m):
    return m.artifacts.select(
        "artifact_id", governance.artifact_content_hash(m.artifacts).alias("content_hash")
    )


# ---------------------------------------------------------------- composite plans


def _calibration(m: Market) -> calibration.Calibration:
    return calibration.calibrate(
        examples(m), model_name="buyer-choice", model_version="1", code_version="bench",
        dataset_snapshot_id="bench",
    )


SPLIT_SQL = """SELECT decision_id, row_number() OVER (ORDER BY as_of, md5(decision_id)) <= count(*) OVER ()
    - greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS train FROM examples WHERE chosen IS NOT NULL"""


@query(
    "calibrate",
    f"""WITH split AS MATERIALIZED ({SPLIT_SQL}), fitted AS MATERIALIZED ({_newton_sql(
        f"SELECT decision_id, alt_order = chosen AS hit, {X_SQL} FROM x_rows WHERE decision_id IN (SELECT decision_id FROM split WHERE train)"
    )}), scored AS (
          SELECT decision_id, -ln(greatest(max(CASE WHEN alt_order = chosen THEN e END) / sum(e), 1e-15)) AS loss
          FROM (SELECT x.*, exp({' + '.join(f'w[{i + 1}] * x{i}' for i in range(8))}) AS e FROM x_rows x, fitted
                WHERE chosen IS NOT NULL) GROUP BY 1)
        SELECT count(*) AS historical_choices, count_if(train)::BIGINT AS train_examples,
               count_if(NOT train)::BIGINT AS holdout_examples, avg(loss) FILTER (train) AS train_log_loss,
               avg(loss) FILTER (NOT train) AS holdout_log_loss FROM scored JOIN split USING (decision_id)""",
    {"train_log_loss": 6, "holdout_log_loss": 6},
)
def _(m):
    c = _calibration(m)
    return m.spark.createDataFrame(
        [(c.historical_choices, c.train_examples, c.holdout_examples,
          c.train_metrics["log_loss"], c.holdout_metrics["log_loss"])],
        "historical_choices long, train_examples long, holdout_examples long, "
        "train_log_loss double, holdout_log_loss double",
    )


@query("forecast_experiment", None)
def _(m):
    c = _calibration(m)
    model = forecast.Model("M0", "approved", "bench", c.weights, c.samples)
    return forecast.forecast_experiment(
        m.definitions, model, m.people, m.market_sets, dataset_snapshot_id="bench",
        population_snapshot_id="bench", population_version="empirical:bench",
        created_at=datetime(2024, 1, 1, tzinfo=timezone.utc),
        control=SCENARIOS[0], treatment=SCENARIOS[1], mode="expected",
    )


@query(
    "prediction_from_comparison",
    f"""SELECT d.experiment_id, s.*, p.c AS control_point_estimate,
               p.t AS treatment_point_estimate
        FROM definitions d, (
          SELECT avg(t - c) AS effect_mean, quantile_cont(t - c, 0.05) AS effect_p05,
                 quantile_cont(t - c, 0.5) AS effect_p50, quantile_cont(t - c, 0.95)
                 AS effect_p95, count(*) AS ensemble_samples
          FROM (SELECT parameter, max(CASE WHEN scenario_id = 'base' THEN unit_share END) AS c,
                       max(CASE WHEN scenario_id = 'discount' THEN unit_share END) AS t
                FROM ({_share_sql(EXPECTED_SQL)}) GROUP BY 1)) s, (
          SELECT max(CASE WHEN scenario_id = 'base' THEN unit_share END) AS c,
                 max(CASE WHEN scenario_id = 'discount' THEN unit_share END) AS t
          FROM ({_share_sql(EXPECTED_SQL)}) WHERE parameter = 0) p""",
    {"effect_mean": 8, "effect_p05": 8, "effect_p50": 8, "effect_p95": 8,
     "control_point_estimate": 8, "treatment_point_estimate": 8},
)
def _(m):
    model = forecast.Model("M0", "approved", "bench", PARAMETERS[0], PARAMETERS)
    summary, point, _ = forecast.compare_scenarios(
        model, m.people, m.market_sets, control=SCENARIOS[0], treatment=SCENARIOS[1],
        mode="expected",
    )
    return forecast.prediction_from_comparison(
        m.definitions, model, summary, point, control="base", treatment="discount",
        population_version="empirical:bench", created_at=JAN_10,
    ).select(
        "experiment_id", "effect_mean", "effect_p05", "effect_p50", "effect_p95",
        "ensemble_samples", "control_point_estimate", "treatment_point_estimate",
    )


@query(
    "unit_share",
    f"SELECT scenario_id, parameter, unit_share, 1 - unit_share AS outside_share "
    f"FROM ({_share_sql(EXPECTED_SQL)})",
    {"unit_share": 8, "outside_share": 8},
)
def _(m):
    mass = scenarios.expected_mass(m.people, m.market_sets, SCENARIOS, PARAMETERS)
    return scenarios.unit_share(mass).drop("replication")


@query(
    "active_at",
    f"""SELECT project_id, count(*) AS versions, count_if(inventory_state = 'available')::BIGINT
               AS available FROM units WHERE effective_from <= {mk.AS_OF_SQL}
        AND (effective_to IS NULL OR {mk.AS_OF_SQL} < effective_to) GROUP BY 1""",
)
def _(m):
    at = F.lit(mk.POPULATION_AS_OF)
    active = temporal.active_at(at, F.col("effective_from"), F.col("effective_to"))
    return m.units.where(active).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("versions"),
        F.count_if(F.col("inventory_state") == "available").alias("available"),
    )


@query(
    "ambiguity_detection",
    f"""SELECT project_id, {ts_sql('as_of')} AS as_of, unit_id FROM active_units
        WHERE substr(unit_id, 2)::BIGINT % 50 = 0""",
)
def _(m):
    twin = m.units.where(F.substring("unit_id", 2, 20).cast("long") % 50 == 0).withColumn(
        "version_id", F.concat("version_id", F.lit("-twin"))
    )
    found = choices.scd_active_units(_asofs(m), m.units.unionByName(twin), horizon=m.horizon)
    return found.where("ambiguous").select("project_id", "as_of", "unit_id")


def _frozen(m: Market) -> str:
    path = f"{shared_dir(m.spark)}/frozen-{uuid4().hex}"
    new = _snapshots(m)
    snapshot.freeze_dataset(
        m.canonical, new, {"unit_versions": m.units, "offers": m.offers, "travel_times": m.travel},
        path, version="bench",
    )
    return path


MANIFEST_SQL = f"""
    SELECT d.records AS event_count, d.digest AS event_digest,
           (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_shipdate, l_linestatus))
             AS snapshot_count, true AS training_ready
    FROM ({_digest_sql(EVENT_LINE_SQL, 'canonical')}) d"""
MANIFEST = ("event_count", "event_digest", "snapshot_count", "training_ready")


@query("freeze_dataset", MANIFEST_SQL)
def _(m):
    return m.spark.read.parquet(f"{_frozen(m)}/manifest").select(*MANIFEST)


@query("verify_dataset", MANIFEST_SQL)
def _(m):
    return snapshot.verify_dataset(m.spark, _frozen(m)).select(*MANIFEST)


@query("calibration_run", None)
def _(m):
    listed = mk.ListedMarket(m.spark, m.sf_dir)
    done = calibration.calibration_run(
        m.spark, _frozen(listed), code_version="bench", project=m.PROJECT(),
        destination=Market.hub(F.col("project_id")),
    )
    return done.manifest.select(
        "model_status", "historical_choices", "train_examples", "holdout_examples"
    )


@query(
    "stream_ingest",
    "SELECT event_type, count(*) AS events FROM web GROUP BY 1",
)
def _(m):
    base = f"{shared_dir(m.spark)}/stream-{uuid4().hex}"
    m.web_events.unionByName(m.web_events).write.parquet(f"{base}/in")
    schema = m.spark.read.parquet(f"{base}/in").schema
    stream_ingest(
        m.spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/store",
        source_id="web", checkpoint=f"{base}/checkpoint",
    ).awaitTermination()
    return ingest.event_store(m.spark, f"{base}/store").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events")
    )


@query("stream_ingest_keyed", f"{CANON_VIEW_SQL} web")
def _(m):
    """Four micro-batches and a late repeat of a quarter of the log, each found again by the key index."""
    base = f"{shared_dir(m.spark)}/stream-{uuid4().hex}"
    late = m.web_events.where(F.col("source_event_key").cast("long") % 4 == 0)
    m.web_events.repartition(3, "source_event_key").write.parquet(f"{base}/in")
    late.coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = m.spark.read.parquet(f"{base}/in").schema
    stream_keyed(
        m.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), f"{base}/table",
        source_id="web", checkpoint=f"{base}/checkpoint", name="web",
    ).awaitTermination()
    return _event_view(keyed.stored_events(m.spark, f"{base}/table"))


@query("stream_dedupe", f"{CANON_VIEW_SQL} web")
def _(m):
    """The same log sent twice, with keys kept as streaming state."""
    base = f"{shared_dir(m.spark)}/stream-{uuid4().hex}"
    m.web_events.unionByName(m.web_events).write.parquet(f"{base}/in")
    schema = m.spark.read.parquet(f"{base}/in").schema
    stream_dedupe(
        m.spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/events", checkpoint=f"{base}/checkpoint",
        delay="365 days",
    ).awaitTermination()
    return _event_view(m.spark.read.parquet(f"{base}/events"))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Market(spark, sf_dir))

