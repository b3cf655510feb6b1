"""Append-only, idempotent ingest of events and source snapshots."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from hearthline.functions.hashing import (
    ANALYTICS_NAMESPACE, dedupe_key, digest_root, multiset_digest, uuid5,
)
from hearthline.schemas import EVENT_COLUMNS, EVENT_SCHEMA


def _key() -> Column:
    return dedupe_key(F.col("source_id"), F.col("source_event_key"), F.col("schema_version"))


def first_per_key(events: DataFrame) -> DataFrame:
    """One event per dedupe key, the earliest by (occurred_at, event_id), with its repeat count.

    An aggregate, not a window: repeats of a hot key collapse inside each map task.
    """
    rest = [c for c in EVENT_COLUMNS if c not in ("occurred_at", "event_id", "payload")]
    # maps cannot be compared, so the payload travels as sorted entries
    pick = F.struct(
        "occurred_at", "event_id", *rest, F.array_sort(F.map_entries("payload")).alias("entries")
    )
    best = events.groupBy(_key().alias("dedupe_key")).agg(
        F.min(pick).alias("e"), F.count(F.lit(1)).alias("copies")
    )
    return best.select(
        "dedupe_key", "copies",
        *[
            F.map_from_entries("e.entries").alias("payload") if c == "payload"
            else F.col(f"e.{c}").alias(c)
            for c in EVENT_COLUMNS
        ],
    )


def ingest_events(
    new: DataFrame, store: DataFrame, *, source_id: str
) -> tuple[DataFrame, DataFrame]:
    """(events to append, one-row result). Rows of another source make the result not accepted.

    The store is only probed for the keys of the batch. A small batch becomes the build side of
    that probe at run time, so the store is read once (key columns only) and not shuffled.
    """
    unique = first_per_key(new)
    probe = store.where(F.col("source_id") == source_id)
    if "dedupe_key" not in probe.columns:
        probe = probe.withColumn("dedupe_key", _key())
    seen = probe.select("dedupe_key").join(unique.select("dedupe_key"), "dedupe_key", "left_semi")
    fresh = unique.join(seen.distinct(), "dedupe_key", "left_anti")
    counted = unique.join(
        seen.distinct().withColumn("is_seen", F.lit(True)), "dedupe_key", "left"
    ).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("received"),
        F.count(F.when(F.col("is_seen").isNull(), 1)).alias("inserted"),
        F.coalesce(
            F.sum(F.when(F.col("source_id") != source_id, F.col("copies")).otherwise(0)), F.lit(0)
        ).alias("mismatched"),
    )
    result = counted.select(
        F.lit(source_id).alias("source_id"),
        "received",
        "inserted",
        (F.col("received") - F.col("inserted")).alias("duplicates"),
        F.when(F.col("received") == 0, 1.0)
        .otherwise(F.col("inserted") / F.col("received")).alias("accepted_ratio"),
        "mismatched",
    )
    return fresh.drop("copies"), result


class SourceMismatch(ValueError):
    """The batch carries events of another source."""


def event_store(spark: SparkSession, path: str) -> DataFrame:
    """The event table, or an empty one before the first append."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("dedupe_key", T.StringType())])
    return spark.createDataFrame([], schema)


def day_files(dated: DataFrame, rows_per_file: int) -> DataFrame:
    """Dealt into one file per `rows_per_file` rows of a (type, day): a busy day is many tasks, a small batch one file."""
    files = dated.groupBy("event_type", "event_date").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files")
    )
    return dated.join(files, ["event_type", "event_date"]).repartition(
        "event_type", "event_date", F.pmod(F.xxhash64("dedupe_key"), F.col("_files"))
    ).drop("_files")


def append_events(
    spark: SparkSession, path: str, new: DataFrame, *, source_id: str, rows_per_file: int = 500_000
) -> dict:
    """Ingest one batch into the Parquet event table. One writer at a time is assumed."""
    from hearthline.session import cut_lineage

    if not new.where(
        F.col("source_id").isNull() | (F.col("source_id") != source_id)
    ).limit(1).isEmpty():
        raise SourceMismatch("all events must match the ingestion source_id")
    # the store is both read and appended to, so the outcome is fixed before the write
    fresh, result = ingest_events(cut_lineage(new), event_store(spark, path), source_id=source_id)
    fixed = cut_lineage(fresh)
    counts = result.first().asDict()
    dated = fixed.withColumn("event_date", F.to_date("occurred_at"))
    (
        day_files(dated, rows_per_file)
        .sortWithinPartitions("entity_id", "occurred_at")
        .write.mode("append").partitionBy("event_type", "event_date").parquet(path)
    )
    return counts


def file_snapshots(
    spark: SparkSession,
    path: str,
    *,
    source_id: str,
    captured_at: datetime | None = None,
    schema_version: str = "1",
    metadata: dict[str, str] | None = None,
    header: bool = True,
    by_line: bool = False,
    quoted: bool = True,
) -> DataFrame:
    """One snapshot row per source file: content hash and record count; empty files have 0 records.

    `by_line` replaces the byte hash by an order-free digest of the lines, for files too large
    to hold in one row. Records are CSV records, so quoted newlines do not count; `quoted=False`
    counts the lines that are not blank.
    """
    # readers and listings write the same local URI with one or with three slashes
    whole = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("file")
    at = whole(F.col("_metadata.file_path"))
    # readers skip empty files, so the list of names comes first
    names = [(x,) for x in spark.read.text(path).inputFiles()]
    files = spark.createDataFrame(names, "file string").select(whole(F.col("file")))
    if by_line:
        parts = multiset_digest(F.sha2("value", 256))
        hashes = spark.read.text(path).select(at, "value").where(
            F.length(F.trim("value")) > 0
        ).groupBy("file").agg(digest_root(parts).alias("content_hash"))
    else:
        content = spark.read.format("binaryFile").load(path)
        hashes = content.select(at, F.sha2("content", 256).alias("content_hash"))
    hashed = files.join(hashes, "file", "left").withColumn(
        "content_hash", F.coalesce("content_hash", F.sha2(F.lit("").cast("binary"), 256))
    )
    if quoted:
        rows = spark.read.schema("c string").option("multiLine", True).option("escape", '"').csv(path)
        rows = rows.select(at, "c")
    else:
        rows = spark.read.text(path).select(at, "value").where(F.length(F.trim("value")) > 0)
    hashed = hashed.join(rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines")), "file", "left")
    extra = [x for kv in (metadata or {}).items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return snapshot_rows(
        hashed,
        source_id=F.lit(source_id),
        captured_at=F.lit(captured_at or datetime.now(timezone.utc)),
        content_hash=F.col("content_hash"),
        record_count=F.greatest(F.coalesce("lines", F.lit(0)) - (1 if header else 0), F.lit(0)),
        schema_version=F.lit(schema_version),
        metadata=F.create_map(
            F.lit("path"), F.regexp_extract("file", "[^/]+$", 0), *extra
        ),
    )


def snapshot_rows(
    df: DataFrame,
    *,
    source_id: Column,
    captured_at: Column,
    content_hash: Column,
    record_count: Column,
    schema_version: Column,
    metadata: Column,
) -> DataFrame:
    return df.select(
        uuid5(
            F.concat_ws("|", F.lit("snapshot"), source_id, content_hash, schema_version),
            ANALYTICS_NAMESPACE,
        ).alias("snapshot_id"),
        source_id.alias("source_id"),
        captured_at.alias("captured_at"),
        content_hash.alias("content_hash"),
        record_count.cast("long").alias("record_count"),
        schema_version.alias("schema_version"),
        metadata.alias("metadata"),
    )


SNAPSHOT_KEY = ["source_id", "content_hash", "schema_version"]


def record_source_snapshot(new: DataFrame, store: DataFrame) -> DataFrame:
    """Snapshots not yet recorded, one per (source, content, schema version)."""
    first = new.groupBy(*SNAPSHOT_KEY).agg(
        F.min(F.struct("captured_at", "snapshot_id", "record_count",
                       F.array_sort(F.map_entries("metadata")).alias("m"))).alias("s")
    ).select(
        F.col("s.snapshot_id").alias("snapshot_id"), "source_id",
        F.col("s.captured_at").alias("captured_at"), "content_hash",
        F.col("s.record_count").alias("record_count"), "schema_version",
        F.map_from_entries("s.m").alias("metadata"),
    )
    return first.join(store.select(*SNAPSHOT_KEY), SNAPSHOT_KEY, "left_anti").select(*new.columns)


def list_snapshots(snapshots: DataFrame, *, source_id: str | None = None) -> DataFrame:
    if source_id is not None:
        snapshots = snapshots.where(F.col("source_id") == source_id)
    return snapshots.orderBy("captured_at", "snapshot_id")
