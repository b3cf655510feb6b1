"""CSV exports of inventory, offers and travel times -> typed tables plus rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.hashing import canonical_json, row_map, uuid5, ANALYTICS_NAMESPACE
from hearthline.functions.parsing import blank_to_null, evaluated, one_of, parse_float, parse_ts
from hearthline.schemas import (
    DEPARTURE_BUCKETS, INVENTORY_STATES, PRODUCT_TYPES, TRAVEL_MODES,
)


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """All columns as text; a byte-order mark is dropped by the reader."""
    return (
        spark.read.option("header", "true").option("multiLine", str(multi_line).lower())
        .option("escape", '"').option("inferSchema", "false").csv(path)
    )


def _text(raw: DataFrame, name: str) -> Column:
    return blank_to_null(F.col(name)) if name in raw.columns else F.lit(None).cast("string")


def _row_id(raw: DataFrame, kind: str) -> Column:
    content = canonical_json(row_map(raw.columns))
    return uuid5(F.concat(F.lit(kind + ":"), content), ANALYTICS_NAMESPACE)


def _parsed(raw: DataFrame, texts: list[str], values: dict[str, Column]) -> DataFrame:
    """Raw rows plus `t_<name>`, the trimmed texts, and `v_<name>`, values read from them; each is worked out once."""
    rows = evaluated(raw, {f"t_{n}": _text(raw, n) for n in texts})
    return evaluated(rows, {f"v_{n}": c for n, c in values.items()})


def _split(
    raw: DataFrame, rows: DataFrame, columns: dict[str, Column], rules: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Parsed rows that pass every rule, and the others with the names of the rules they fail."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    )
    typed = rows.select(
        *[c.alias(n) for n, c in columns.items()],
        failed.alias("_failed"),
        canonical_json(row_map(raw.columns)).alias("_row"),
    )
    good = typed.where(F.size("_failed") == 0).drop("_failed", "_row")
    bad = typed.where(F.size("_failed") > 0).select(
        F.col("_row").alias("row"), F.array_join("_failed", ",").alias("reasons")
    )
    return good, bad


def _optional(text: Column, value: Column) -> Column:
    """Missing is fine, unreadable is not."""
    return text.isNull() | value.isNotNull()


def parse_unit_versions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = lambda name: F.col(f"t_{name}")
    v = lambda name: F.col(f"v_{name}")
    rows = _parsed(
        raw, ["unit_id", "project_id", "unit_code", "product_type", "inventory_state", "lot_area_m2", "built_area_m2",
              "effective_from", "effective_to", "source_id"],
        {"lot": parse_float(t("lot_area_m2")), "built": parse_float(t("built_area_m2")),
         "start": parse_ts(t("effective_from")), "end": parse_ts(t("effective_to"))},
    )
    lot, built, start, end = v("lot"), v("built"), v("start"), v("end")
    columns = {
        "version_id": _row_id(raw, "unit-version"),
        "unit_id": t("unit_id"),
        "project_id": t("project_id"),
        "unit_code": t("unit_code"),
        "product_type": one_of(t("product_type"), PRODUCT_TYPES),
        "inventory_state": one_of(t("inventory_state"), INVENTORY_STATES),
        "lot_area_m2": lot,
        "built_area_m2": built,
        "effective_from": start,
        "effective_to": end,
        "source_id": t("source_id"),
    }
    rules = {
        "unit_id": columns["unit_id"].isNotNull(),
        "project_id": columns["project_id"].isNotNull(),
        "unit_code": columns["unit_code"].isNotNull(),
        "product_type": columns["product_type"].isNotNull(),
        "inventory_state": columns["inventory_state"].isNotNull(),
        "lot_area_m2": t("lot_area_m2").isNull() | (lot > 0),
        "built_area_m2": t("built_area_m2").isNull() | (built > 0),
        "effective_from": start.isNotNull(),
        "effective_to": _optional(t("effective_to"), end) & (end.isNull() | (end > start)),
        "source_id": columns["source_id"].isNotNull(),
    }
    return _split(raw, rows, columns, rules)


def parse_offers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = lambda name: F.col(f"t_{name}")
    v = lambda name: F.col(f"v_{name}")

    def number(name: str, default: float) -> Column:
        return F.when(t(name).isNull(), F.lit(default)).otherwise(parse_float(t(name)))

    defaults = {"discount_pct": 0.0, "incentive_cash": 0.0, "down_payment_pct": 0.3, "monthly_payment_est": 0.0}
    rows = _parsed(
        raw, ["unit_id", "product_type", "list_price", "net_price", *defaults, "payment_plan_code", "effective_from",
              "effective_to", "source_id"],
        {"list_price": parse_float(t("list_price")), "net_price": parse_float(t("net_price")),
         **{n: number(n, d) for n, d in defaults.items()},
         "start": parse_ts(t("effective_from")), "end": parse_ts(t("effective_to"))},
    )
    start, end = v("start"), v("end")
    columns = {
        "offer_id": _row_id(raw, "offer"),
        "unit_id": t("unit_id"),
        "product_type": one_of(t("product_type"), PRODUCT_TYPES),
        "list_price": v("list_price"),
        "net_price": v("net_price"),
        "discount_pct": v("discount_pct"),
        "incentive_cash": v("incentive_cash"),
        "payment_plan_code": t("payment_plan_code"),
        "down_payment_pct": v("down_payment_pct"),
        "monthly_payment_est": v("monthly_payment_est"),
        "effective_from": start,
        "effective_to": end,
        "source_id": t("source_id"),
    }
    c = columns
    rules = {
        "product_type": _optional(t("product_type"), c["product_type"]),
        "list_price": c["list_price"] > 0,
        "net_price": t("net_price").isNull() | (c["net_price"] > 0),
        "discount_pct": c["discount_pct"].between(0, 1),
        "incentive_cash": c["incentive_cash"] >= 0,
        "payment_plan_code": c["payment_plan_code"].isNotNull(),
        "down_payment_pct": c["down_payment_pct"].between(0, 1),
        "monthly_payment_est": c["monthly_payment_est"] >= 0,
        "effective_from": start.isNotNull(),
        "effective_to": _optional(t("effective_to"), end) & (end.isNull() | (end > start)),
        "source_id": c["source_id"].isNotNull(),
    }
    return _split(raw, rows, columns, rules)


def parse_travel_times(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = lambda name: F.col(f"t_{name}")
    v = lambda name: F.col(f"v_{name}")
    numbers, times = ["travel_time_min", "distance_km", "reliability_p90_min"], ["observed_at", "valid_from", "valid_to"]
    rows = _parsed(
        raw, ["origin_anchor_id", "destination_anchor_id", "mode", "departure_bucket", "source_id", *numbers, *times],
        {n: parse_float(t(n)) for n in numbers} | {n: parse_ts(t(n)) for n in times},
    )
    start, end = v("valid_from"), v("valid_to")
    columns = {
        "origin_anchor_id": t("origin_anchor_id"),
        "destination_anchor_id": t("destination_anchor_id"),
        "mode": one_of(t("mode"), TRAVEL_MODES),
        "departure_bucket": one_of(t("departure_bucket"), DEPARTURE_BUCKETS),
        "travel_time_min": v("travel_time_min"),
        "distance_km": v("distance_km"),
        "reliability_p90_min": v("reliability_p90_min"),
        "observed_at": v("observed_at"),
        "valid_from": start,
        "valid_to": end,
        "source_id": t("source_id"),
    }
    c = columns
    rules = {
        "origin_anchor_id": c["origin_anchor_id"].isNotNull(),
        "destination_anchor_id": c["destination_anchor_id"].isNotNull(),
        "mode": c["mode"].isNotNull(),
        "departure_bucket": c["departure_bucket"].isNotNull(),
        "travel_time_min": c["travel_time_min"] > 0,
        "distance_km": t("distance_km").isNull() | (c["distance_km"] >= 0),
        "reliability_p90_min": t("reliability_p90_min").isNull() | (c["reliability_p90_min"] > 0),
        "observed_at": c["observed_at"].isNotNull(),
        "valid_from": start.isNotNull(),
        "valid_to": _optional(t("valid_to"), end) & (end.isNull() | (end > start)),
        "source_id": c["source_id"].isNotNull(),
    }
    return _split(raw, rows, columns, rules)


def read_unit_versions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_unit_versions(read_csv(spark, path))


def read_offers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_offers(read_csv(spark, path))


def read_travel_times(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_travel_times(read_csv(spark, path))
