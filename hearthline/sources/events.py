"""Building, scanning, reading and writing canonical events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.hashing import dedupe_key, payload_hash, uuid5, ANALYTICS_NAMESPACE
from hearthline.functions.parsing import evaluated
from hearthline.schemas import EVENT_COLUMNS, EVENT_SCHEMA


def text_map(pairs: dict[str, Column]) -> Column:
    """String map of the non-null values."""
    parts: list[Column] = []
    for key, value in pairs.items():
        parts += [F.lit(key), value.cast("string")]
    return F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull())


def as_events(
    df: DataFrame,
    *,
    event_type: Column,
    entity_type: Column,
    entity_id: Column,
    occurred_at: Column,
    source_id: Column,
    source_event_key: Column,
    payload: Column,
    schema_version: Column | None = None,
    ingested_at: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Project any DataFrame to the canonical event columns.

    The event id is derived from the dedupe key, so a retried task yields the same id.
    """
    version = schema_version if schema_version is not None else F.lit("1")
    identity = dedupe_key(source_id, source_event_key, version)
    return df.select(
        uuid5(F.concat(F.lit("event:"), identity), ANALYTICS_NAMESPACE).alias("event_id"),
        event_type.alias("event_type"),
        entity_type.alias("entity_type"),
        entity_id.alias("entity_id"),
        occurred_at.alias("occurred_at"),
        source_id.alias("source_id"),
        source_event_key.alias("source_event_key"),
        payload.alias("payload"),
        version.alias("schema_version"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"),
        *keep,
    )


def with_keys(events: DataFrame) -> DataFrame:
    """Add the derived dedupe_key and payload_hash columns of the event table."""
    return events.withColumn(
        "dedupe_key",
        dedupe_key(F.col("source_id"), F.col("source_event_key"), F.col("schema_version")),
    ).withColumn("payload_hash", payload_hash(F.col("payload")))


def scan_events(
    events: DataFrame,
    *,
    entity_type: str | None = None,
    entity_id: str | None = None,
    event_type: str | None = None,
    occurred_from: datetime | None = None,
    occurred_to: datetime | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Filtered events; every predicate reaches the Parquet scan. Sort only at an output edge."""
    for column, value in (
        ("entity_type", entity_type), ("entity_id", entity_id), ("event_type", event_type),
    ):
        if value is not None:
            events = events.where(F.col(column) == value)
    if occurred_from is not None:
        events = events.where(F.col("occurred_at") >= F.lit(occurred_from))
        if "event_date" in events.columns:
            events = events.where(F.col("event_date") >= F.to_date(F.lit(occurred_from)))
    if occurred_to is not None:
        events = events.where(F.col("occurred_at") < F.lit(occurred_to))
        if "event_date" in events.columns:
            events = events.where(F.col("event_date") <= F.to_date(F.lit(occurred_to)))
    return events.orderBy("occurred_at", "event_id") if ordered else events


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"))


def union_events(*sources: DataFrame) -> DataFrame:
    first, *rest = (s.select(*EVENT_COLUMNS) for s in sources)
    for other in rest:
        first = first.unionByName(other)
    return first


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON text per event."""
    return events.select(
        F.to_json(F.struct(*EVENT_COLUMNS), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        .alias("value")
    )


def write_events_jsonl(events: DataFrame, path: str, *, compression: str = "none") -> int:
    """Write events as JSON lines and return how many lie there afterwards. Lines repeat their field names, so "gzip" takes
    a small part of their disk; a compressed file is read back by one task."""
    event_lines(events).write.mode("errorifexists").text(path, compression=compression)
    return events.sparkSession.read.text(path).count()


def parse_event_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from a `value` column of JSON lines; blank lines are skipped."""
    schema = EVENT_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ")
    # read once: a filter on the parsed fields would repeat the parsing for each of them
    parsed = evaluated(
        lines.where(F.length(F.trim("value")) > 0).select("value"),
        {"e": F.from_json(
            "value", f"{schema}, _bad string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        )},
    )
    required = ("event_type", "entity_type", "entity_id", "source_id", "source_event_key")
    complete = F.col("e._bad").isNull() & F.col("e.occurred_at").isNotNull()
    for name in required:
        complete = complete & F.coalesce(F.length(F.trim(f"e.{name}")) > 0, F.lit(False))
    defaults = {"schema_version": F.lit("1"), "payload": F.create_map().cast("map<string,string>")}
    columns = [
        F.coalesce(F.col(f"e.{c}"), defaults[c]).alias(c) if c in defaults
        else F.col(f"e.{c}").alias(c)
        for c in EVENT_COLUMNS
    ]
    good = parsed.where(complete).select(*columns)
    rejects = parsed.where(~complete).select("value", F.lit("invalid_event").alias("reason"))
    return good, rejects


def read_events_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_event_lines(spark.read.text(path))
