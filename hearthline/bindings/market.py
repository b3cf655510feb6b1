"""The canonical tables of this library, derived from the TPC-H-like driver tables.

Every table exists twice: as a DataFrame (class Market) and as SQL (CTES), so that each operator
can be compared with an independent query. A part is a unit, twenty parts are a project, an order
is a decision of its customer, and a project's size does not depend on the scale factor, so all
outputs grow linearly with the data.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.hashing import analytics_uuid
from hearthline.session import configure, cut_lineage
from hearthline.sources.events import as_events, text_map, union_events

POPULATION_AS_OF = datetime(1998, 6, 15, tzinfo=timezone.utc)
AS_OF_SQL = "TIMESTAMP '1998-06-15 00:00:00'"

PRODUCT_BY_TYPE = {
    "ECONOMY": "townhouse", "MEDIUM": "garden_townhouse", "STANDARD": "street_villa",
    "SMALL": "garden_villa", "PROMO": "shophouse", "LARGE": "townhouse",
}
PURPOSE_BY_SEGMENT = {
    "BUILDING": "own_stay", "AUTOMOBILE": "investment", "MACHINERY": "business",
    "HOUSEHOLD": "mixed", "FURNITURE": "unknown",
}
OUTCOME_BY_PRIORITY = {
    "1": "selected_competitor", "2": "selected_land_house", "3": "continue_renting",
    "4": "postponed", "5": "lost",
}
INCOME = ("50-80m", "80-120m", "1-2b", "<50m", "100m+")
CAPITAL = ("1-2b", "2-3b", "500m+")
MAX_PAYMENT = ("5-8m", "8-12m", "10m", "unknown")
HORIZON = ("30d", "120d", "200d", "unknown")
SIZES = ("1", "2", "3-4", "5+", "unknown")
CHILDREN = ("0", "1", "2+", "unknown")
PREFERRED = (
    "townhouse", "garden_townhouse", "street_villa", "garden_villa", "shophouse", "unknown",
)
STAGES = ("qualified", "shortlist", "site_tour")
REASONS = ("price", "commute", "financing", "unknown")
METHODS = ("hash_randomized", "randomized", "observational", "manual")
STATUS_BY_EVENT = {
    "view": "validated", "click": "approved", "error": "rejected", "signup": "archived",
}


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def pick_sql(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index}) + 1]"


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def lookup_sql(pairs: dict[str, str], key: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"(CASE {key} {whens} END)"


def uuid5_sql(namespace: str, name: str) -> str:
    h = f"sha1(from_hex('{namespace.replace('-', '')}') || encode({name}))"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)"
        f"||'-'||substr({h},21,12))"
    )


def household_sql(entity: str) -> str:
    return uuid5_sql("78e92a33-6e3d-4c2c-bada-e56a8663378a", f"'household:' || {entity}")


def uniform_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({text}),1,13))::BIGINT / 4503599627370496.0)"


def json_sql(m: str, comma: str = ",", colon: str = ":") -> str:
    """JSON text with sorted keys of the non-null entries of a MAP(VARCHAR, VARCHAR)."""
    return (
        f"('{{' || coalesce(list_aggregate(list_transform(list_sort(list_filter(map_entries({m}), "
        f"lambda e: e.value IS NOT NULL)), lambda e: to_json(e.key)::VARCHAR || '{colon}' || "
        f"to_json(e.value)::VARCHAR), 'string_agg', '{comma}'), '') || '}}')"
    )


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def iso_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


CTES: dict[str, str] = {
    "supply": """
        SELECT l_partkey AS pk, l_shipdate AS dt, max(l_linestatus) AS st,
               max(l_extendedprice) AS px, max(l_discount) AS disc, max(l_tax) AS tax,
               max(l_quantity) AS qty
        FROM lineitem GROUP BY 1, 2""",
    "units": f"""
        SELECT 'U' || pk || ':' || strftime(dt, '%Y%m%d') AS version_id, 'U' || pk AS unit_id,
               'PRJ-' || (pk // 20) AS project_id, 'K-' || lpad(pk::VARCHAR, 9, '0') AS unit_code,
               {lookup_sql(PRODUCT_BY_TYPE, 'p_type')} AS product_type,
               CASE WHEN st = 'O' THEN 'available' ELSE 'sold' END AS inventory_state,
               p_size * 10.0::DOUBLE AS lot_area_m2, p_size * 8.0::DOUBLE AS built_area_m2,
               dt AS effective_from,
               lead(dt) OVER (PARTITION BY pk ORDER BY dt) AS effective_to,
               'lineitem' AS source_id
        FROM supply JOIN part ON p_partkey = pk""",
    "offers": """
        SELECT 'F' || pk || ':' || strftime(dt, '%Y%m%d') AS offer_id, 'U' || pk AS unit_id,
               NULL::VARCHAR AS product_type, px * 20000.0::DOUBLE AS list_price,
               CASE WHEN qty >= 45 THEN px * 18000.0::DOUBLE END AS net_price,
               disc AS discount_pct, tax * 1000000.0::DOUBLE AS incentive_cash,
               'PLAN-' || (pk % 3) AS payment_plan_code, 0.3::DOUBLE AS down_payment_pct,
               px * 200.0::DOUBLE AS monthly_payment_est, dt AS effective_from,
               dt + INTERVAL 180 DAY AS effective_to, 'lineitem' AS source_id
        FROM supply""",
    "picked": "SELECT l_orderkey AS ok, min(l_partkey) AS pk FROM lineitem GROUP BY 1",
    "outcomes": f"""
        SELECT o_orderkey AS ok, o_orderdate AS occurred_at, 'H' || o_custkey AS household,
               'PRJ-' || (pk // 20) AS project_id,
               CASE o_orderstatus WHEN 'F' THEN 'booking'
                    WHEN 'O' THEN {lookup_sql(OUTCOME_BY_PRIORITY, "substr(o_orderpriority,1,1)")}
                    ELSE CASE WHEN substr(o_orderpriority,1,1) IN ('4','5') THEN 'hold'
                              ELSE 'site_tour' END END AS outcome_type,
               CASE WHEN o_orderstatus = 'F' THEN 'K-' || lpad(pk::VARCHAR, 9, '0') END
                 AS unit_code,
               CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority,1,1) IN ('1','2')
                    THEN 'no_purchase' END AS outside_option,
               CASE WHEN o_orderstatus = 'F' THEN 'booking' END AS stage,
               CASE WHEN o_orderkey % 10 = 0 THEN 'false' ELSE 'true' END AS verified
        FROM orders JOIN picked ON ok = o_orderkey""",
    "qual": f"""
        SELECT o_orderkey AS ok, o_custkey AS ck, 'H' || o_custkey AS household,
               o_orderdate - to_days((1 + o_orderkey % 40)::INTEGER)
                 + to_minutes(o_orderkey % 1440) AS occurred_at,
               {lookup_sql(PURPOSE_BY_SEGMENT, 'c_mktsegment')} AS purchase_purpose,
               {pick_sql(SIZES, 'o_custkey % 5')} AS household_size_band,
               {pick_sql(CHILDREN, 'o_orderkey % 4')} AS children_band,
               {pick_sql(INCOME, 'o_orderkey % 5')} AS household_income_band,
               {pick_sql(CAPITAL, 'o_custkey % 3')} AS liquid_capital_band,
               {pick_sql(MAX_PAYMENT, 'o_orderkey % 4')} AS max_monthly_payment_band,
               {pick_sql(HORIZON, '(o_orderkey // 4) % 4')} AS purchase_horizon,
               CASE WHEN o_orderkey % 11 = 0 THEN 'unknown'
                    ELSE 'NATION_' || ((c_nationkey + o_orderkey % 2) % 25) END AS workplace_zone,
               (20 + o_orderkey % 30)::VARCHAR AS stated_max_travel_min,
               {pick_sql(PREFERRED, 'o_orderkey % 6')} AS preferred_product_type
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "travel": """
        SELECT 'NATION_' || c_nationkey AS origin_anchor_id,
               'HUB-' || substr(o_orderpriority,1,1) AS destination_anchor_id,
               'motorbike' AS mode, 'am_peak' AS departure_bucket,
               max(o_totalprice) / 10000.0::DOUBLE AS travel_time_min,
               date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 27 DAY AS observed_at,
               date_trunc('month', o_orderdate)::TIMESTAMP AS valid_from,
               date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 2 MONTH AS valid_to,
               'routing' AS source_id
        FROM orders JOIN customer ON c_custkey = o_custkey
        GROUP BY c_nationkey, substr(o_orderpriority,1,1), date_trunc('month', o_orderdate)""",
    "log": """
        SELECT event_id, ts, user_id, event_type, value,
               regexp_extract(props, '\\d+')::BIGINT AS k FROM events""",
    "web": f"""
        SELECT CASE event_type WHEN 'view' THEN 'web_engagement_observed'
                    WHEN 'click' THEN 'decision_stage_observed'
                    WHEN 'signup' THEN 'reason_observed'
                    WHEN 'error' THEN 'campaign_performance_observed'
                    ELSE CASE WHEN k % 2 = 0 THEN 'site_tour_observed'
                              ELSE 'decision_outcome_verified' END END AS event_type,
               CASE event_type WHEN 'view' THEN 'party' WHEN 'error' THEN 'campaign'
                    ELSE 'household' END AS entity_type,
               CASE event_type WHEN 'view' THEN 'V' || user_id WHEN 'error' THEN 'C' || k
                    ELSE 'H' || user_id END AS entity_id,
               ts AS occurred_at, 'web' AS source_id, event_id::VARCHAR AS source_event_key,
               CASE event_type
                 WHEN 'click' THEN MAP {{'stage': {pick_sql(STAGES, 'k % 3')},
                                         'next_action': 'call'}}
                 WHEN 'signup' THEN MAP {{'reason_code': {pick_sql(REASONS, 'k % 4')},
                   'direction': CASE WHEN k % 2 = 0 THEN 'motivator' ELSE 'unknown' END,
                   'evidence_type': 'explicit'}}
                 WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN MAP {{'k': k::VARCHAR}}
                   ELSE MAP {{'outcome_type': 'no_purchase',
                     'project_id': 'PRJ-' || (user_id // 15),
                     'verified': CASE WHEN k % 10 = 1 THEN 'false' ELSE 'true' END}} END
                 ELSE MAP {{'k': k::VARCHAR}} END AS payload
        FROM log""",
    "canonical": """
        SELECT *, '1' AS schema_version FROM (
        SELECT 'qualification_observed' AS event_type, 'household' AS entity_type,
               household AS entity_id, occurred_at, 'crm' AS source_id,
               'Q' || ok AS source_event_key,
               MAP {'purchase_purpose': purchase_purpose,
                    'household_size_band': household_size_band, 'children_band': children_band,
                    'household_income_band': household_income_band,
                    'liquid_capital_band': liquid_capital_band,
                    'max_monthly_payment_band': max_monthly_payment_band,
                    'purchase_horizon': purchase_horizon, 'workplace_zone': workplace_zone,
                    'stated_max_travel_min': stated_max_travel_min,
                    'preferred_product_type': preferred_product_type} AS payload FROM qual
        UNION ALL
        SELECT 'decision_outcome_observed', 'household', household, occurred_at, 'outcomes',
               'O' || ok,
               MAP {'outcome_type': outcome_type, 'unit_code': unit_code,
                    'outside_option': outside_option, 'stage': stage, 'verified': verified,
                    'project_id': project_id} FROM outcomes
        UNION ALL
        SELECT 'unit_version_observed', 'unit', unit_id, effective_from, source_id,
               'unit-version:' || version_id,
               MAP {'unit_code': unit_code, 'product_type': product_type,
                    'inventory_state': inventory_state} FROM units
        UNION ALL
        SELECT 'offer_observed', 'unit', unit_id, effective_from, source_id,
               'offer:' || offer_id,
               MAP {'list_price': 'yes', 'payment_plan_code': payment_plan_code} FROM offers
        UNION ALL
        SELECT event_type, entity_type, entity_id, occurred_at, source_id, source_event_key,
               payload FROM web)""",
    "obs": f"""
        SELECT {household_sql('entity_id')} AS household_id, e.key AS feature_name,
               e.value AS value, occurred_at AS observed_at,
               source_id || ':' || source_event_key AS source_id
        FROM (SELECT *, unnest(map_entries(payload)) AS e FROM canonical
              WHERE event_type IN ('qualification_observed', 'decision_stage_observed'))
        WHERE e.value IS NOT NULL AND e.key NOT IN ('next_action', 'next_action_date')""",
    "anchors": f"""
        SELECT {household_sql('household')} AS household_id, workplace_zone AS anchor_id,
               occurred_at AS observed_at, 'crm:Q' || ok AS source_id
        FROM qual WHERE workplace_zone <> 'unknown'""",
    "asofs": "SELECT DISTINCT project_id, occurred_at AS as_of FROM outcomes"
             " WHERE verified = 'true'",
    "active_units": """
        SELECT a.project_id, a.as_of, u.unit_id, u.version_id, u.unit_code, u.product_type,
               u.inventory_state
        FROM asofs a JOIN units u ON u.project_id = a.project_id
         AND u.effective_from <= a.as_of AND (u.effective_to IS NULL OR a.as_of < u.effective_to)
        QUALIFY row_number() OVER (PARTITION BY a.project_id, a.as_of, u.unit_id
                                   ORDER BY u.effective_from DESC) = 1""",
    "active_offers": """
        SELECT p.unit_id, p.as_of, f.* EXCLUDE (unit_id)
        FROM (SELECT DISTINCT unit_id, as_of FROM active_units
              WHERE inventory_state = 'available') p
        JOIN offers f ON f.unit_id = p.unit_id AND f.effective_from <= p.as_of
         AND (f.effective_to IS NULL OR p.as_of < f.effective_to)
        QUALIFY row_number() OVER (PARTITION BY p.unit_id, p.as_of
                                   ORDER BY f.effective_from DESC) = 1""",
    "alternatives": """
        SELECT project_id, as_of, alternative_id, alternative_type, unit_id, product_type,
               effective_price, monthly_payment_est, payment_plan_code, outside_option,
               row_number() OVER (PARTITION BY project_id, as_of ORDER BY rk, alternative_id) - 1
                 AS alt_order
        FROM (
        SELECT u.project_id, u.as_of, u.unit_code AS alternative_id, 'unit' AS alternative_type,
               u.unit_id, u.product_type,
               coalesce(f.net_price, f.list_price * (1 - f.discount_pct) - f.incentive_cash)
                 AS effective_price,
               f.monthly_payment_est, f.payment_plan_code, NULL::VARCHAR AS outside_option,
               0 AS rk
        FROM active_units u JOIN active_offers f USING (unit_id, as_of)
        WHERE u.inventory_state = 'available'
        UNION ALL
        SELECT project_id, as_of, alt, opt, NULL, NULL, NULL, NULL, NULL, opt, rk
        FROM asofs, (VALUES ('OUT-COMPETITOR', 'competitor_project', 1),
                            ('OUT-LAND-HOUSE', 'land_house', 2),
                            ('OUT-RENT', 'continue_renting', 3),
                            ('OUT-POSTPONE', 'postponed', 4),
                            ('OUT-NO-PURCHASE', 'no_purchase', 5)) o(alt, opt, rk))""",
    "decisions": f"""
        SELECT 'outcomes:O' || ok AS decision_id, {household_sql('household')} AS household_id,
               occurred_at AS as_of, project_id,
               coalesce(stage, CASE outcome_type WHEN 'site_tour' THEN 'site_tour'
                 WHEN 'revisit' THEN 'shortlist' WHEN 'hold' THEN 'negotiation'
                 WHEN 'booking' THEN 'booking' ELSE 'final' END) AS stage,
               coalesce(unit_code, CASE coalesce(outside_option, CASE outcome_type
                   WHEN 'selected_competitor' THEN 'competitor_project'
                   WHEN 'selected_land_house' THEN 'land_house'
                   WHEN 'continue_renting' THEN 'continue_renting'
                   WHEN 'postponed' THEN 'postponed' WHEN 'no_purchase' THEN 'no_purchase'
                   WHEN 'lost' THEN 'no_purchase' END)
                 WHEN 'competitor_project' THEN 'OUT-COMPETITOR'
                 WHEN 'land_house' THEN 'OUT-LAND-HOUSE' WHEN 'continue_renting' THEN 'OUT-RENT'
                 WHEN 'postponed' THEN 'OUT-POSTPONE' WHEN 'no_purchase' THEN 'OUT-NO-PURCHASE'
                 END) AS selected
        FROM outcomes WHERE verified = 'true'""",
    "open_decisions": """
        SELECT d.*, a.alt_order AS chosen FROM decisions d
        LEFT JOIN alternatives a ON a.project_id = d.project_id AND a.as_of = d.as_of
         AND a.alternative_id = d.selected
        WHERE d.selected IS NULL OR a.alternative_id IS NOT NULL""",
    "latest_obs": """
        SELECT d.decision_id, o.feature_name,
               max(row(o.observed_at, o.source_id, o.value)) AS best
        FROM decisions d JOIN obs o ON o.household_id = d.household_id
         AND o.observed_at <= d.as_of
        GROUP BY 1, 2""",
    "hub_of": """
        SELECT DISTINCT project_id, 'HUB-' || (1 + substr(project_id, 5)::BIGINT % 5) AS hub
        FROM outcomes""",
    "anchored": """
        SELECT d.decision_id, any_value(d.household_id) AS household_id, any_value(d.as_of) AS as_of,
               any_value(h.hub) AS destination_anchor_id,
               (max(row(x.observed_at, x.source_id, x.anchor_id)) FILTER (x.household_id IS NOT NULL))[3] AS origin
        FROM decisions d JOIN hub_of h USING (project_id)
        LEFT JOIN anchors x ON x.household_id = d.household_id AND x.observed_at <= d.as_of
        GROUP BY d.decision_id""",
    "timed": """
        SELECT a.decision_id, max(row(t.observed_at, t.source_id, t.travel_time_min)) AS best
        FROM anchored a JOIN travel t ON t.origin_anchor_id = a.origin
         AND t.destination_anchor_id = a.destination_anchor_id
         AND t.valid_from <= a.as_of AND a.as_of < t.valid_to AND t.observed_at <= a.as_of
        GROUP BY 1""",
    "wide_obs": """
        SELECT decision_id, map(list(feature_name), list(best[3])) AS f
        FROM latest_obs GROUP BY 1""",
    "examples": """
        SELECT d.*, t.best[3] AS commute_min,
               coalesce(CASE WHEN f['purchase_purpose'] IN ('own_stay', 'investment', 'mixed',
                 'business', 'unknown') THEN f['purchase_purpose'] END, 'unknown')
                 AS purchase_purpose,
               CASE WHEN f['preferred_product_type'] <> 'unknown'
                    THEN f['preferred_product_type'] END AS preferred_product_type,
               CASE f['max_monthly_payment_band'] WHEN '5-8m' THEN 6.5 WHEN '8-12m' THEN 10.0
                    WHEN '10m' THEN 10.0 END::DOUBLE AS max_payment,
               CASE f['purchase_horizon'] WHEN '30d' THEN 30 WHEN '120d' THEN 120
                    WHEN '200d' THEN 200 END AS horizon_days
        FROM open_decisions d LEFT JOIN wide_obs w USING (decision_id)
        LEFT JOIN timed t USING (decision_id)""",
    "x_rows": """
        SELECT e.decision_id, e.household_id, e.as_of, e.purchase_purpose, e.horizon_days,
               e.chosen, a.alt_order, a.alternative_id, a.outside_option,
               coalesce(a.effective_price / 1000000000.0::DOUBLE, 0) AS x0,
               coalesce(a.monthly_payment_est / 10000000.0::DOUBLE, 0) AS x1,
               CASE WHEN a.alternative_type = 'unit' THEN coalesce(e.commute_min / 10.0::DOUBLE, 0)
                    ELSE 0 END AS x2,
               CASE WHEN e.preferred_product_type = a.product_type THEN 1.0 ELSE 0.0 END::DOUBLE
                 AS x3,
               CASE WHEN a.monthly_payment_est > e.max_payment * 1000000.0::DOUBLE THEN 1.0
                    ELSE 0.0 END::DOUBLE AS x4,
               CASE WHEN e.purchase_purpose = 'investment' AND a.product_type = 'shophouse'
                    THEN 1.0 ELSE 0.0 END::DOUBLE AS x5,
               CASE WHEN e.purchase_purpose = 'own_stay'
                     AND a.product_type IN ('garden_townhouse', 'garden_villa')
                    THEN 1.0 ELSE 0.0 END::DOUBLE AS x6,
               CASE WHEN a.outside_option IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS x7
        FROM examples e JOIN alternatives a ON a.project_id = e.project_id
         AND a.as_of = e.as_of""",
    "u_rows": """
        SELECT *, -0.58 * x0 - 0.42 * x1 - 0.28 * x2 + 0.85 * x3 - 1.10 * x4 + 0.35 * x5
                  + 0.25 * x6 - 0.25 * x7 AS u FROM x_rows""",
    "p_rows": """
        SELECT *, exp(u - mx) / sum(exp(u - mx)) OVER (PARTITION BY decision_id) AS p
        FROM (SELECT *, max(u) OVER (PARTITION BY decision_id) AS mx FROM u_rows)""",
    "sets_scored": """
        SELECT decision_id, any_value(purchase_purpose) AS purchase_purpose,
               any_value(chosen) AS chosen, count(*) AS n,
               -ln(greatest(max(CASE WHEN alt_order = chosen THEN p END), 1e-15)) AS loss,
               CASE WHEN arg_max(alt_order, row(p, -alt_order)) = any_value(chosen) THEN 1.0
                    ELSE 0.0 END::DOUBLE AS hit
        FROM p_rows WHERE chosen IS NOT NULL GROUP BY 1""",
    "snap": f"""
        SELECT household_id, map(list(feature_name), list(best[3])) AS f FROM (
          SELECT household_id, feature_name, max(row(observed_at, source_id, value)) AS best
          FROM obs WHERE observed_at <= {AS_OF_SQL} GROUP BY 1, 2) GROUP BY 1""",
    "households": """
        SELECT household_id, coalesce(f['purchase_purpose'], 'unknown') AS purchase_purpose,
               coalesce(f['household_size_band'], 'unknown') AS household_size_band,
               coalesce(f['children_band'], 'unknown') AS children_band,
               CASE f['household_income_band'] WHEN '50-80m' THEN 65.0 WHEN '80-120m' THEN 100.0
                 WHEN '1-2b' THEN 1500.0 WHEN '<50m' THEN 40.0 WHEN '100m+' THEN 120.0 END::DOUBLE
                 AS income_midpoint_million,
               CASE f['liquid_capital_band'] WHEN '1-2b' THEN 1500.0 WHEN '2-3b' THEN 2500.0
                 WHEN '500m+' THEN 600.0 END::DOUBLE AS liquid_capital_million,
               CASE f['max_monthly_payment_band'] WHEN '5-8m' THEN 6.5 WHEN '8-12m' THEN 10.0
                 WHEN '10m' THEN 10.0 END::DOUBLE AS max_monthly_payment_million,
               CASE f['purchase_horizon'] WHEN '30d' THEN 30 WHEN '120d' THEN 120
                 WHEN '200d' THEN 200 END::BIGINT AS purchase_horizon_days,
               nullif(f['workplace_zone'], 'unknown') AS workplace_zone,
               f['stated_max_travel_min']::DOUBLE AS commute_tolerance_min,
               nullif(f['preferred_product_type'], 'unknown') AS preferred_product_type,
               len(list_filter(['purchase_purpose', 'household_size_band', 'children_band',
                 'household_income_band', 'liquid_capital_band', 'max_monthly_payment_band',
                 'purchase_horizon', 'workplace_zone', 'stated_max_travel_min',
                 'preferred_product_type'],
                 lambda n: coalesce(f[n], 'unknown') NOT IN ('', 'unknown'))) / 10.0::DOUBLE
                 AS profile_confidence
        FROM snap""",
    "protos": """
        SELECT *, row_number() OVER (ORDER BY key_hash) AS place FROM (
        SELECT * EXCLUDE (household_id), count(*) AS households,
          md5('{"children_band":"' || children_band || '","commute_tolerance_min":'
            || coalesce(commute_tolerance_min::VARCHAR, 'null') || ',"household_size_band":"'
            || household_size_band || '","income_midpoint_million":'
            || coalesce(income_midpoint_million::VARCHAR, 'null') || ',"liquid_capital_million":'
            || coalesce(liquid_capital_million::VARCHAR, 'null')
            || ',"max_monthly_payment_million":'
            || coalesce(max_monthly_payment_million::VARCHAR, 'null')
            || ',"preferred_product_type":'
            || coalesce('"' || preferred_product_type || '"', 'null') || ',"profile_confidence":'
            || profile_confidence::VARCHAR || ',"purchase_horizon_days":'
            || coalesce(purchase_horizon_days::VARCHAR, 'null') || ',"purchase_purpose":"'
            || purchase_purpose || '","workplace_zone":'
            || coalesce('"' || workplace_zone || '"', 'null') || '}') AS key_hash
        FROM households GROUP BY ALL)""",
    "ranged": """
        SELECT *, coalesce(sum(households) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), 0)::BIGINT AS lo,
               sum(households) OVER (ORDER BY place)::BIGINT AS hi FROM protos""",
    "drawn": f"""
        SELECT d.draw, r.* FROM (
          SELECT i AS draw, floor({uniform_sql("'population'", "42", "i")}
                 * (SELECT sum(households) FROM protos)::DOUBLE)::BIGINT AS idx
          FROM range(0, (SELECT count(*) FROM customer)) t(i)) d
        JOIN ranged r ON d.idx >= r.lo AND d.idx < r.hi""",
    "people": f"""
        SELECT h.*, 'PRJ-' || (c_custkey // 15) AS project_id, t.best[3] AS commute_min
        FROM customer JOIN households h ON h.household_id = {household_sql("('H' || c_custkey)")}
        LEFT JOIN (
          SELECT origin_anchor_id, destination_anchor_id,
                 max(row(observed_at, source_id, travel_time_min)) AS best
          FROM travel WHERE valid_from <= {AS_OF_SQL} AND {AS_OF_SQL} < valid_to
            AND observed_at <= {AS_OF_SQL} GROUP BY 1, 2) t
        ON t.origin_anchor_id = h.workplace_zone
         AND t.destination_anchor_id = 'HUB-' || (1 + (c_custkey // 15) % 5)""",
    "market_units": f"""
        SELECT u.project_id, u.unit_code AS alternative_id, u.product_type,
               coalesce(f.net_price, f.list_price * (1 - f.discount_pct) - f.incentive_cash)
                 AS effective_price, f.monthly_payment_est
        FROM units u JOIN (
          SELECT * FROM offers WHERE effective_from <= {AS_OF_SQL} AND {AS_OF_SQL} < effective_to
          QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY effective_from DESC) = 1) f
          USING (unit_id)
        WHERE u.effective_from <= {AS_OF_SQL}
          AND (u.effective_to IS NULL OR {AS_OF_SQL} < u.effective_to)
          AND u.inventory_state = 'available'""",
    "market_alts": """
        SELECT project_id, alternative_id, 'unit' AS alternative_type, product_type,
               effective_price, monthly_payment_est, NULL::VARCHAR AS outside_option, 0 AS rk
        FROM market_units
        UNION ALL
        SELECT project_id, alt, opt, NULL, NULL, NULL, opt, rk
        FROM (SELECT DISTINCT project_id FROM people),
             (VALUES ('OUT-COMPETITOR', 'competitor_project', 1),
                     ('OUT-LAND-HOUSE', 'land_house', 2), ('OUT-RENT', 'continue_renting', 3),
                     ('OUT-POSTPONE', 'postponed', 4),
                     ('OUT-NO-PURCHASE', 'no_purchase', 5)) o(alt, opt, rk)""",
    "weights": """
        SELECT * FROM (VALUES (0, -0.58::DOUBLE, -0.42::DOUBLE, 0.85::DOUBLE),
                              (1, -0.70::DOUBLE, -0.30::DOUBLE, 0.60::DOUBLE),
                              (2, -0.40::DOUBLE, -0.60::DOUBLE, 1.10::DOUBLE))
        w(parameter, w_price, w_pay, w_match)""",
    "scen": """
        SELECT * FROM (VALUES ('base', 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, NULL),
                              ('discount', -0.10::DOUBLE, 0.9::DOUBLE, 0.85::DOUBLE, NULL),
                              ('villas', 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE,
                               'street_villa,garden_villa'))
        s(scenario_id, price, pay, comm, eligible)""",
    "sim_rows": """
        SELECT s.scenario_id, w.parameter, h.household_id, h.project_id,
               h.purchase_purpose AS segment, a.alternative_id, a.alternative_type, a.rk,
               CASE WHEN a.alternative_type = 'unit' THEN
                 w.w_price * (a.effective_price * (1 + s.price) / 1000000000.0::DOUBLE)
                 + w.w_pay * (a.monthly_payment_est * s.pay / 10000000.0::DOUBLE)
                 - 0.28 * coalesce(h.commute_min * s.comm / 10.0::DOUBLE, 0)
                 + w.w_match * (CASE WHEN h.preferred_product_type = a.product_type THEN 1 ELSE 0
                                END)
                 - 1.10 * (CASE WHEN a.monthly_payment_est * s.pay
                           > h.max_monthly_payment_million * 1000000.0::DOUBLE THEN 1 ELSE 0 END)
                 + 0.35 * (CASE WHEN h.purchase_purpose = 'investment'
                           AND a.product_type = 'shophouse' THEN 1 ELSE 0 END)
                 + 0.25 * (CASE WHEN h.purchase_purpose = 'own_stay' AND a.product_type IN
                           ('garden_townhouse', 'garden_villa') THEN 1 ELSE 0 END)
               ELSE -0.25 + CASE a.outside_option
                 WHEN 'continue_renting' THEN CASE WHEN h.purchase_horizon_days > 180 THEN 0.12
                   ELSE 0 END
                 WHEN 'postponed' THEN CASE WHEN h.purchase_horizon_days > 90 THEN 0.18
                   ELSE -0.05 END
                 WHEN 'no_purchase' THEN -0.10 ELSE 0 END END AS u
        FROM people h JOIN market_alts a USING (project_id), scen s, weights w
        WHERE a.alternative_type <> 'unit' OR s.eligible IS NULL
           OR list_contains(string_split(s.eligible, ','), a.product_type)""",
    "sim_p": """
        SELECT *, exp(u) / sum(exp(u)) OVER (PARTITION BY scenario_id, parameter, household_id)
                    AS p FROM sim_rows""",
    "sim_cum": """
        SELECT *, sum(p) OVER (PARTITION BY scenario_id, parameter, household_id
                               ORDER BY rk, alternative_id) AS cum FROM sim_p""",
    "sim_pick": f"""
        SELECT scenario_id, parameter, rep AS replication, household_id, project_id, segment,
               arg_min(alternative_id, row(rk, alternative_id)) AS alternative_id,
               arg_min(alternative_type, row(rk, alternative_id)) AS alternative_type
        FROM sim_cum, (VALUES (0), (1)) r(rep)
        WHERE cum > {uniform_sql("'choice'", "42 + rep", "household_id")}
        GROUP BY ALL""",
    "arm_of": "SELECT *, CASE WHEN (substr(md5('S' || user_id), 1, 1) IN"
              " ('0','1','2','3','4','5','6','7')) <> (k = 7) THEN 'control'"
              " ELSE 'treatment' END AS variant,"
              " 'EXP-' || strftime(ts, '%Y-%m-%d') AS experiment_id FROM log",
    "definitions": f"""
        SELECT 'EXP-' || strftime(d, '%Y-%m-%d') AS experiment_id, d AS planned_start_at,
               d + INTERVAL 1 DAY AS planned_end_at, d AS created_at,
               {pick_sql(METHODS, "extract(day FROM d)::BIGINT % 4")} AS assignment_method,
               'conversion_rate' AS metric_name, 'control' AS control_variant,
               'treatment' AS treatment_variant, 150 AS minimum_trials_per_variant
        FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events)""",
    "observations": """
        SELECT experiment_id, variant, 'conversion_rate' AS metric_name,
               count_if(event_type = 'purchase')::BIGINT AS successes, count(*)::BIGINT AS trials,
               max(ts) AS observed_at, 'web' AS source_id,
               experiment_id || ':' || variant || ':' || extract(hour FROM ts)
                 AS source_event_key
        FROM arm_of GROUP BY experiment_id, variant, extract(hour FROM ts)""",
    "totals": """
        SELECT experiment_id, variant, sum(successes)::BIGINT AS s, sum(trials)::BIGINT AS n
        FROM observations GROUP BY 1, 2""",
    "arms": """
        SELECT d.*, coalesce(c.s, 0) AS cs, coalesce(c.n, 0) AS cn, coalesce(t.s, 0) AS tsucc,
               coalesce(t.n, 0) AS tn,
               CASE WHEN c.n > 0 THEN c.s / c.n::DOUBLE ELSE 0.0 END::DOUBLE AS cr,
               CASE WHEN t.n > 0 THEN t.s / t.n::DOUBLE ELSE 0.0 END::DOUBLE AS tr
        FROM definitions d
        LEFT JOIN totals c ON c.experiment_id = d.experiment_id AND c.variant = 'control'
        LEFT JOIN totals t ON t.experiment_id = d.experiment_id AND t.variant = 'treatment'""",
    "predictions": """
        SELECT n.experiment_id, 'M' || (extract(day FROM n.planned_start_at)::BIGINT % 3)
                 AS model_artifact_id, 'conversion_rate' AS metric_name,
               p.cr AS control_point_estimate, p.tr AS treatment_point_estimate,
               p.tr - p.cr AS effect_mean, p.tr - p.cr - 0.05::DOUBLE AS effect_p05,
               p.tr - p.cr AS effect_p50, p.tr - p.cr + 0.05::DOUBLE AS effect_p95,
               100 AS ensemble_samples, n.planned_start_at AS created_at
        FROM definitions n JOIN arms p
          ON p.planned_start_at = n.planned_start_at - INTERVAL 1 DAY""",
    "eval": """
        SELECT a.experiment_id, p.model_artifact_id, a.assignment_method, a.cs, a.cn, a.cr,
               a.tsucc, a.tn, a.tr, a.tr - a.cr AS eff, p.effect_p05, p.effect_p50, p.effect_p95,
               1.96 * sqrt(greatest(a.cr * (1 - a.cr) / a.cn + a.tr * (1 - a.tr) / a.tn, 0.0))
                 AS margin,
               a.cn >= a.minimum_trials_per_variant AND a.tn >= a.minimum_trials_per_variant
                 AS enough,
               a.assignment_method IN ('randomized', 'hash_randomized') AS causal
        FROM arms a JOIN predictions p USING (experiment_id) WHERE a.cn > 0 AND a.tn > 0""",
    "cards": """
        SELECT model_artifact_id, count(*) AS n, count_if(causal)::BIGINT AS causal_n,
               count_if(enough)::BIGINT AS enough_n, avg(abs(eff - effect_p50)) AS mae,
               avg(CASE WHEN eff BETWEEN effect_p05 AND effect_p95 THEN 1.0 ELSE 0.0 END::DOUBLE)
                 AS coverage,
               avg(CASE WHEN (CASE WHEN eff > 1e-12 THEN 1 WHEN eff < -1e-12 THEN -1 ELSE 0 END)
                 = (CASE WHEN effect_p50 > 1e-12 THEN 1 WHEN effect_p50 < -1e-12 THEN -1
                    ELSE 0 END) THEN 1.0 ELSE 0.0 END::DOUBLE) AS direction
        FROM eval GROUP BY 1""",
    "receipts": """
        SELECT experiment_id, 'S' || user_id AS subject_key, variant, ts AS assigned_at,
               'web' AS source_id, event_id::VARCHAR AS source_event_key,
               CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS channel,
               'C' || (k % 4) AS cohort
        FROM arm_of""",
    "gov": f"""
        SELECT 'A' || user_id AS artifact_id, event_id AS seq,
               {lookup_sql(STATUS_BY_EVENT, 'event_type')} AS status, ts AS decided_at
        FROM events WHERE event_type <> 'purchase'""",
}


#: Steps that are worked out once, however often later ones read them.
ONCE = {
    "canonical", "obs", "anchors", "outcomes", "asofs", "active_units", "active_offers", "alternatives", "decisions",
    "open_decisions", "latest_obs", "anchored", "timed", "wide_obs", "examples", "x_rows", "p_rows", "sets_scored",
}


def sql(final: str) -> str:
    """A query text with exactly the CTEs it needs, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    kind = {n: "MATERIALIZED " if n in ONCE else "" for n in CTES}
    body = ",\n".join(f"{n} AS {kind[n]}({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {body}\n{final}" if body else final


class Market:
    """The canonical tables as DataFrames over one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # zone-less Parquet timestamps are taken as UTC instants
        return df.select(
            *[
                F.col(f.name).cast("timestamp").alias(f.name)
                if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
                for f in df.schema.fields
            ]
        )

    @cached_property
    def horizon(self) -> datetime:
        """Latest order date: no decision asks about a later time."""
        return self.table("orders").agg(F.max("o_orderdate")).first()[0]

    @cached_property
    def supply(self) -> DataFrame:
        return self.supplied(self.table("lineitem"))

    @staticmethod
    def supplied(lines: DataFrame) -> DataFrame:
        """One row per part and day. Dealt by part alone: what is grouped, joined and ordered by part next needs no
        second shuffle."""
        return lines.repartition("l_partkey").groupBy(
            F.col("l_partkey").alias("pk"), F.col("l_shipdate").alias("dt")
        ).agg(
            F.max("l_linestatus").alias("st"), F.max("l_extendedprice").alias("px"),
            F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax"),
            F.max("l_quantity").alias("qty"),
        )

    @staticmethod
    def unit_code(pk: Column) -> Column:
        return F.concat(F.lit("K-"), F.lpad(pk.cast("string"), 9, "0"))

    @staticmethod
    def project_of(pk: Column) -> Column:
        return F.concat(F.lit("PRJ-"), F.floor(pk / 20).cast("string"))

    @cached_property
    def units(self) -> DataFrame:
        from pyspark.sql import Window

        pk = F.col("pk")
        # a part has one row per ship date, so a window holds at most one row per calendar day
        nxt = F.lead("dt").over(Window.partitionBy("pk").orderBy("dt"))
        parts = self.table("part").select(F.col("p_partkey").alias("pk"), "p_type", "p_size")
        return self.supply.join(parts, "pk").select(
            F.concat(F.lit("U"), pk, F.lit(":"), F.date_format("dt", "yyyyMMdd")).alias(
                "version_id"
            ),
            F.concat(F.lit("U"), pk).alias("unit_id"),
            self.project_of(pk).alias("project_id"),
            self.unit_code(pk).alias("unit_code"),
            lookup(PRODUCT_BY_TYPE, F.col("p_type")).alias("product_type"),
            F.when(F.col("st") == "O", "available").otherwise("sold").alias("inventory_state"),
            (F.col("p_size") * 10.0).alias("lot_area_m2"),
            (F.col("p_size") * 8.0).alias("built_area_m2"),
            F.col("dt").alias("effective_from"),
            nxt.alias("effective_to"),
            F.lit("lineitem").alias("source_id"),
        )

    @cached_property
    def offers(self) -> DataFrame:
        pk, px = F.col("pk"), F.col("px")
        return self.supply.select(
            F.concat(F.lit("F"), pk, F.lit(":"), F.date_format("dt", "yyyyMMdd")).alias(
                "offer_id"
            ),
            F.concat(F.lit("U"), pk).alias("unit_id"),
            F.lit(None).cast("string").alias("product_type"),
            (px * 20000.0).alias("list_price"),
            F.when(F.col("qty") >= 45, px * 18000.0).alias("net_price"),
            F.col("disc").alias("discount_pct"),
            (F.col("tax") * 1000000.0).alias("incentive_cash"),
            F.concat(F.lit("PLAN-"), (pk % 3).cast("string")).alias("payment_plan_code"),
            F.lit(0.3).alias("down_payment_pct"),
            (px * 200.0).alias("monthly_payment_est"),
            F.col("dt").alias("effective_from"),
            (F.col("dt") + F.expr("INTERVAL 180 DAYS")).alias("effective_to"),
            F.lit("lineitem").alias("source_id"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        picked = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_partkey").alias("pk")
        )
        c, digit = F.col, F.substring("o_orderpriority", 1, 1)
        return self.table("orders").join(picked, "o_orderkey").select(
            c("o_orderkey").alias("ok"), c("o_orderdate").alias("occurred_at"),
            F.concat(F.lit("H"), c("o_custkey")).alias("household"),
            self.project_of(c("pk")).alias("project_id"),
            F.when(c("o_orderstatus") == "F", "booking")
            .when(c("o_orderstatus") == "O", lookup(OUTCOME_BY_PRIORITY, digit))
            .when(digit.isin("4", "5"), "hold").otherwise("site_tour").alias("outcome_type"),
            F.when(c("o_orderstatus") == "F", self.unit_code(c("pk"))).alias("unit_code"),
            F.when(
                (c("o_orderstatus") == "P") & digit.isin("1", "2"), "no_purchase"
            ).alias("outside_option"),
            F.when(c("o_orderstatus") == "F", "booking").alias("stage"),
            F.when(c("o_orderkey") % 10 == 0, "false").otherwise("true").alias("verified"),
        )

    @cached_property
    def qualification(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        customers = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"
        )
        return self.table("orders").join(customers, "o_custkey").select(
            k.alias("ok"), c.alias("ck"), F.concat(F.lit("H"), c).alias("household"),
            F.timestamp_micros(
                F.unix_micros("o_orderdate") - (1 + k % 40) * 86400000000
                + (k % 1440) * 60000000
            ).alias("occurred_at"),
            lookup(PURPOSE_BY_SEGMENT, F.col("c_mktsegment")).alias("purchase_purpose"),
            pick(SIZES, c % 5).alias("household_size_band"),
            pick(CHILDREN, k % 4).alias("children_band"),
            pick(INCOME, k % 5).alias("household_income_band"),
            pick(CAPITAL, c % 3).alias("liquid_capital_band"),
            pick(MAX_PAYMENT, k % 4).alias("max_monthly_payment_band"),
            pick(HORIZON, F.floor(k / 4) % 4).alias("purchase_horizon"),
            F.when(k % 11 == 0, "unknown").otherwise(
                F.concat(F.lit("NATION_"), (F.col("c_nationkey") + k % 2) % 25)
            ).alias("workplace_zone"),
            (20 + k % 30).cast("string").alias("stated_max_travel_min"),
            pick(PREFERRED, k % 6).alias("preferred_product_type"),
        )

    @cached_property
    def qualification_events(self) -> DataFrame:
        from hearthline.schemas import HOUSEHOLD_FIELDS

        q = self.qualification
        return as_events(
            q, event_type=F.lit("qualification_observed"), entity_type=F.lit("household"),
            entity_id=F.col("household"), occurred_at=F.col("occurred_at"),
            source_id=F.lit("crm"),
            source_event_key=F.concat(F.lit("Q"), F.col("ok")),
            payload=text_map({f: F.col(f) for f in HOUSEHOLD_FIELDS}),
        )

    @cached_property
    def outcome_events(self) -> DataFrame:
        names = ("outcome_type", "unit_code", "outside_option", "stage", "verified", "project_id")
        return as_events(
            self.outcomes, event_type=F.lit("decision_outcome_observed"),
            entity_type=F.lit("household"), entity_id=F.col("household"),
            occurred_at=F.col("occurred_at"), source_id=F.lit("outcomes"),
            source_event_key=F.concat(F.lit("O"), F.col("ok")),
            payload=text_map({n: F.col(n) for n in names}),
        )

    @cached_property
    def log(self) -> DataFrame:
        return self.table("events").withColumn(
            "k", F.regexp_extract("props", r"\d+", 0).cast("long")
        )

    @cached_property
    def web_events(self) -> DataFrame:
        kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
        only_k = text_map({"k": k})
        return as_events(
            self.log,
            event_type=F.when(kind == "view", "web_engagement_observed")
            .when(kind == "click", "decision_stage_observed")
            .when(kind == "signup", "reason_observed")
            .when(kind == "error", "campaign_performance_observed")
            .when(k % 2 == 0, "site_tour_observed").otherwise("decision_outcome_verified"),
            entity_type=F.when(kind == "view", "party").when(kind == "error", "campaign")
            .otherwise("household"),
            entity_id=F.when(kind == "view", F.concat(F.lit("V"), user))
            .when(kind == "error", F.concat(F.lit("C"), k))
            .otherwise(F.concat(F.lit("H"), user)),
            occurred_at=F.col("ts"), source_id=F.lit("web"),
            source_event_key=F.col("event_id").cast("string"),
            payload=F.when(
                kind == "click",
                text_map({"stage": pick(STAGES, k % 3), "next_action": F.lit("call")}),
            ).when(
                kind == "signup",
                text_map(
                    {
                        "reason_code": pick(REASONS, k % 4),
                        "direction": F.when(k % 2 == 0, "motivator").otherwise("unknown"),
                        "evidence_type": F.lit("explicit"),
                    }
                ),
            ).when(
                (kind == "purchase") & (k % 2 == 1),
                text_map(
                    {
                        "outcome_type": F.lit("no_purchase"),
                        "project_id": F.concat(F.lit("PRJ-"), F.floor(user / 15)),
                        "verified": F.when(k % 10 == 1, "false").otherwise("true"),
                    }
                ),
            ).otherwise(only_k),
        )

    @cached_property
    def inventory_events(self) -> DataFrame:
        u = self.units
        return as_events(
            u, event_type=F.lit("unit_version_observed"), entity_type=F.lit("unit"),
            entity_id=F.col("unit_id"), occurred_at=F.col("effective_from"),
            source_id=F.col("source_id"),
            source_event_key=F.concat(F.lit("unit-version:"), F.col("version_id")),
            payload=text_map(
                {n: F.col(n) for n in ("unit_code", "product_type", "inventory_state")}
            ),
        )

    @cached_property
    def offer_events(self) -> DataFrame:
        return as_events(
            self.offers, event_type=F.lit("offer_observed"), entity_type=F.lit("unit"),
            entity_id=F.col("unit_id"), occurred_at=F.col("effective_from"),
            source_id=F.col("source_id"),
            source_event_key=F.concat(F.lit("offer:"), F.col("offer_id")),
            payload=text_map(
                {"list_price": F.lit("yes"), "payment_plan_code": F.col("payment_plan_code")}
            ),
        )

    @cached_property
    def canonical(self) -> DataFrame:
        return union_events(
            self.qualification_events, self.outcome_events, self.inventory_events,
            self.offer_events, self.web_events,
        )

    @cached_property
    def household_events(self) -> DataFrame:
        """The events that carry household evidence and decisions."""
        return union_events(self.qualification_events, self.outcome_events, self.web_events)

    @cached_property
    def travel(self) -> DataFrame:
        customers = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey"
        )
        month = F.date_trunc("month", "o_orderdate")
        grouped = self.table("orders").join(customers, "o_custkey").groupBy(
            "c_nationkey", F.substring("o_orderpriority", 1, 1).alias("d"), month.alias("m")
        ).agg((F.max("o_totalprice") / 10000.0).alias("travel_time_min"))
        return grouped.select(
            F.concat(F.lit("NATION_"), "c_nationkey").alias("origin_anchor_id"),
            F.concat(F.lit("HUB-"), "d").alias("destination_anchor_id"),
            F.lit("motorbike").alias("mode"), F.lit("am_peak").alias("departure_bucket"),
            "travel_time_min",
            (F.col("m") + F.expr("INTERVAL 27 DAYS")).alias("observed_at"),
            F.col("m").alias("valid_from"),
            F.add_months("m", 2).cast("timestamp").alias("valid_to"),
            F.lit("routing").alias("source_id"),
        )

    @staticmethod
    def hub(project: Column) -> Column:
        number = F.substring(project, 5, 20).cast("long")
        return F.concat(F.lit("HUB-"), (1 + number % 5).cast("string"))

    PROJECT = staticmethod(lambda: F.col("payload")["project_id"])

    @cached_property
    def people(self) -> DataFrame:
        """Households as known at one time, placed in a project, with their commute."""
        from hearthline.operators.features import household_snapshot, population_commute

        snapshot = household_snapshot(self.household_events, as_of=POPULATION_AS_OF)
        placed = self.table("customer").select(
            analytics_uuid(F.concat(F.lit("H"), F.col("c_custkey")), namespace="household").alias(
                "household_id"
            ),
            F.concat(F.lit("PRJ-"), F.floor(F.col("c_custkey") / 15)).alias("project_id"),
        ).join(snapshot, "household_id")
        return cut_lineage(
            population_commute(
                placed, self.travel, destination=self.hub(F.col("project_id")),
                as_of=POPULATION_AS_OF,
            )
        )

    @cached_property
    def market_sets(self) -> DataFrame:
        """Packed choice set of every project at the population's time."""
        from hearthline.operators.choices import choice_sets

        projects = self.people.select("project_id").distinct().withColumn(
            "as_of", F.lit(POPULATION_AS_OF)
        )
        return choice_sets(
            projects, self.units, self.offers, horizon=POPULATION_AS_OF, since=POPULATION_AS_OF
        )[0]

    @cached_property
    def arms(self) -> DataFrame:
        first = F.substring(F.md5(F.concat(F.lit("S"), F.col("user_id"))), 1, 1)
        low = first.isin("0", "1", "2", "3", "4", "5", "6", "7")
        return self.log.withColumn(
            "variant",
            F.when(low != (F.col("k") == 7), "control").otherwise("treatment"),
        ).withColumn(
            "experiment_id", F.concat(F.lit("EXP-"), F.date_format("ts", "yyyy-MM-dd"))
        )

    @cached_property
    def receipts(self) -> DataFrame:
        return self.arms.select(
            "experiment_id", F.concat(F.lit("S"), F.col("user_id")).alias("subject_key"),
            "variant", F.col("ts").alias("assigned_at"), F.lit("web").alias("source_id"),
            F.col("event_id").cast("string").alias("source_event_key"),
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("channel"),
            F.concat(F.lit("C"), F.col("k") % 4).alias("cohort"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        return self.arms.groupBy("experiment_id", "variant", F.hour("ts").alias("h")).agg(
            F.count_if(F.col("event_type") == "purchase").alias("successes"),
            F.count(F.lit(1)).alias("trials"), F.max("ts").alias("observed_at"),
        ).select(
            "experiment_id", "variant", F.lit("conversion_rate").alias("metric_name"),
            "successes", "trials", "observed_at", F.lit("web").alias("source_id"),
            F.concat_ws(":", "experiment_id", "variant", "h").alias("source_event_key"),
        )

    @cached_property
    def definitions(self) -> DataFrame:
        day = F.col("planned_start_at")
        return self.table("events").select(
            F.date_trunc("day", "ts").alias("planned_start_at")
        ).distinct().select(
            F.concat(F.lit("EXP-"), F.date_format(day, "yyyy-MM-dd")).alias("experiment_id"),
            F.lit("daily conversion").alias("name"), F.lit("treatment converts").alias(
                "hypothesis"
            ),
            F.lit("conversion_rate").alias("metric_name"),
            F.lit("control").alias("control_variant"),
            F.lit("treatment").alias("treatment_variant"),
            pick(METHODS, F.dayofmonth(day) % 4).alias("assignment_method"),
            "planned_start_at", (day + F.expr("INTERVAL 1 DAY")).alias("planned_end_at"),
            F.lit(150).alias("minimum_trials_per_variant"), day.alias("created_at"),
            F.lit("bench").alias("created_by"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Yesterday's effect, give or take five points, is the forecast for today."""
        from hearthline.operators.experiments import variant_aggregate

        rates = variant_aggregate(self.observations).groupBy("experiment_id").agg(
            *[
                F.max(F.when(F.col("variant") == v, F.col("rate"))).alias(v)
                for v in ("control", "treatment")
            ]
        )
        before = self.definitions.select(
            (F.col("planned_start_at") + F.expr("INTERVAL 1 DAY")).alias("planned_start_at"),
            "experiment_id",
        ).join(rates, "experiment_id", "left").select(
            "planned_start_at", F.coalesce("control", F.lit(0.0)).alias("c"),
            F.coalesce("treatment", F.lit(0.0)).alias("t"),
        )
        c, t, day = F.col("c"), F.col("t"), F.col("planned_start_at")
        return self.definitions.select("experiment_id", "planned_start_at").join(
            before, "planned_start_at"
        ).select(
            "experiment_id",
            F.concat(F.lit("M"), F.dayofmonth(day) % 3).alias("model_artifact_id"),
            F.lit("conversion_rate").alias("metric_name"),
            c.alias("control_point_estimate"), t.alias("treatment_point_estimate"),
            (t - c).alias("effect_mean"), (t - c - 0.05).alias("effect_p05"),
            (t - c).alias("effect_p50"), (t - c + 0.05).alias("effect_p95"),
            F.lit(100).alias("ensemble_samples"), day.alias("created_at"),
        )

    @cached_property
    def governance(self) -> DataFrame:
        return self.table("events").where(F.col("event_type") != "purchase").select(
            F.concat(F.lit("A"), F.col("user_id")).alias("artifact_id"),
            F.col("event_id").alias("seq"),
            lookup(STATUS_BY_EVENT, F.col("event_type")).alias("status"),
            F.col("ts").alias("decided_at"),
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        return self.table("events").groupBy("user_id").agg(
            F.min("ts").alias("created_at")
        ).where(F.col("user_id") % 10 != 9).select(
            F.concat(F.lit("A"), F.col("user_id")).alias("artifact_id"),
            F.lit("buyer-choice").alias("model_name"),
            (F.col("user_id") % 7).cast("string").alias("model_version"),
            "created_at",
        )


class ListedMarket(Market):
    """The same tables where a booking is evidence too: a part is on offer on the day it is booked, at its line's price.

    Orders name parts that no shipment shows in stock, which the gate of a calibration refuses. No row is left out.
    """

    @cached_property
    def supply(self) -> DataFrame:
        def first(name: str) -> Column:
            return F.min(F.struct("l_partkey", name))[name]

        seen = ("l_extendedprice", "l_discount", "l_tax", "l_quantity")
        booked = self.table("orders").where("o_orderstatus = 'F'").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"
        ).join(
            self.table("lineitem").groupBy("l_orderkey").agg(
                F.min("l_partkey").alias("l_partkey"), *[first(n).alias(n) for n in seen]
            ),
            "l_orderkey",
        ).select("l_partkey", F.col("o_orderdate").alias("l_shipdate"), F.lit("O").alias("l_linestatus"), *seen)
        shipped = self.table("lineitem").select("l_partkey", "l_shipdate", "l_linestatus", *seen)
        return self.supplied(shipped.unionByName(booked))
