"""Freezing an evidence set under a content identity, and verifying it later."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.hashing import canonical_json, table_digest
from hearthline.operators.audit import readiness_audit
from hearthline.plans import hash_tree
from hearthline.schemas import EVENT_COLUMNS
from hearthline.session import stored as keep

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


class DatasetMismatch(ValueError):
    """Frozen content no longer matches its manifest."""


def window(events: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Events with start <= occurred_at < end."""
    if start is not None:
        events = events.where(F.col("occurred_at") >= F.lit(start))
    if end is not None:
        events = events.where(F.col("occurred_at") < F.lit(end))
    return events


def event_partition() -> dict[str, Column]:
    """What a seal names: the event type and the day."""
    return {"event_type": F.col("event_type"), "event_date": F.to_date("occurred_at")}


def event_line() -> Column:
    """Meaning of an event as text: no event id, no ingest time, instants in UTC."""
    return F.to_json(
        F.array(
            "event_type", "entity_type", "entity_id", F.date_format("occurred_at", TS),
            "source_id", "source_event_key", canonical_json(F.col("payload")), "schema_version",
        )
    )


def snapshot_line() -> Column:
    return F.to_json(
        F.array(
            "source_id", "content_hash", F.col("record_count").cast("string"), "schema_version",
            canonical_json(F.col("metadata")),
        )
    )


def semantic_hash(df: DataFrame, line: Column) -> DataFrame:
    """One row (rows, digest) of a set of records; order and partitioning do not matter."""
    return table_digest(df.select(F.unhex(F.sha2(line, 256)).alias("h")))


def table_line(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def dataset_id(manifest: DataFrame) -> Column:
    """Identity over the window, the version and every content digest."""
    return F.concat(
        F.lit("sha256:"),
        F.sha2(
            F.to_json(
                F.array(
                    "project_code", "snapshot_version",
                    F.coalesce(F.date_format("window_from", TS), F.lit("")),
                    F.coalesce(F.date_format("window_to", TS), F.lit("")),
                    "event_digest", "snapshot_digest", canonical_json(F.col("input_digests")),
                )
            ),
            256,
        ),
    )


def event_hashes(spark: SparkSession, path: str) -> DataFrame:
    """The line hashes of the frozen events as they lie there now, stored: the identity and the hash tree read them."""
    events = spark.read.parquet(f"{path}/events")
    return keep(hash_tree.line_hashes(events, event_line(), event_partition()))


def _manifest(
    spark: SparkSession,
    path: str,
    inputs: list[str],
    hashes: DataFrame,
    *,
    project_code: str,
    version: str,
    start: datetime | None,
    end: datetime | None,
) -> DataFrame:
    """The identity part of a manifest, computed from what lies under `path` and the hashes of its event lines."""
    snapshots = spark.read.parquet(f"{path}/source_snapshots")
    e = table_digest(hashes.select("h")).first()
    s = semantic_hash(snapshots, snapshot_line()).first()
    digests = {}
    for name in sorted(inputs):
        table = spark.read.parquet(f"{path}/inputs/{name}")
        digests[name] = semantic_hash(table, table_line(table)).first()["digest"]
    rows = [
        (project_code, version, start, end, e["rows"], e["digest"], s["rows"], s["digest"],
         digests)
    ]
    schema = (
        "project_code string, snapshot_version string, window_from timestamp, "
        "window_to timestamp, event_count long, event_digest string, snapshot_count long, "
        "snapshot_digest string, input_digests map<string,string>"
    )
    manifest = spark.createDataFrame(rows, schema)
    return manifest.withColumn("dataset_snapshot_id", dataset_id(manifest))


def freeze_dataset(
    events: DataFrame,
    snapshots: DataFrame,
    inputs: dict[str, DataFrame],
    path: str,
    *,
    window_from: datetime | None = None,
    window_to: datetime | None = None,
    version: str = "001",
    project_code: str = "default",
) -> DataFrame:
    """Write events of the window, snapshots and input tables, and their manifest (one row).

    Existing content is never overwritten, and lies there in zstd, which takes less disk than the default. Digests are taken from the written files; events are also sealed by
    type and day (`hash_tree`), so that damage can be named.
    """
    if window_from and window_to and window_from >= window_to:
        raise ValueError("window_from must be before window_to")
    spark = events.sparkSession
    contents = {"events": window(events, window_from, window_to).select(*EVENT_COLUMNS), "source_snapshots": snapshots}
    for name, table in (contents | {f"inputs/{n}": t for n, t in inputs.items()}).items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}", compression="zstd")
    hashes = event_hashes(spark, path)
    identity = _manifest(
        spark, path, list(inputs), hashes, project_code=project_code, version=version,
        start=window_from, end=window_to,
    )
    frozen = spark.read.parquet(f"{path}/events")
    audit = readiness_audit(frozen).first()
    counts = frozen.groupBy("event_type").count().collect()
    manifest = identity.withColumns(
        {
            "created_at": F.lit(datetime.now(timezone.utc)),
            "event_root": F.lit(
                hash_tree.seal(
                    spark, f"{path}/events", f"{path}/seal", event_line(), event_partition(), hashes
                )
            ),
            "training_ready": F.lit(audit["training_ready"]),
            "blockers": F.array(*[F.lit(b) for b in audit["blockers"]]).cast("array<string>"),
            "warnings": F.array(*[F.lit(w) for w in audit["warnings"]]).cast("array<string>"),
            "event_types": F.create_map(
                *[x for r in sorted(counts) for x in (F.lit(r[0]), F.lit(r[1]))]
            ).cast("map<string,bigint>"),
        }
    )
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def verify_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Recompute every digest and the identity; raise on any difference, naming the days of damaged events."""
    stored = spark.read.parquet(f"{path}/manifest")
    m = stored.first()
    sealed = spark.read.parquet(f"{path}/seal/digests")
    if sealed.agg(hash_tree.root(sealed, list(event_partition())).alias("r")).first()["r"] != m["event_root"]:
        raise DatasetMismatch("the seal does not match the manifest")
    hashes = event_hashes(spark, path)
    now = _manifest(
        spark, path, list(m["input_digests"]), hashes, project_code=m["project_code"],
        version=m["snapshot_version"], start=m["window_from"], end=m["window_to"],
    ).first()
    damaged = hash_tree.damage(
        spark, f"{path}/events", f"{path}/seal", event_line(), event_partition(), hashes=hashes
    )
    differing = damaged.orderBy("event_type", "event_date").limit(20).collect()
    wrong = [n for n in ("event_count", "event_digest") if now[n] != m[n]]
    if differing or wrong:
        named = ", ".join(f"{r.event_type} {r.event_date} {r.state}" for r in differing)
        raise DatasetMismatch(f"{', '.join(wrong) or 'event_root'} does not match the manifest: {named}")
    for name in ("snapshot_count", "snapshot_digest", "input_digests", "dataset_snapshot_id"):
        if now[name] != m[name]:
            raise DatasetMismatch(f"{name} does not match the manifest")
    return stored


def damaged_events(spark: SparkSession, path: str, changed_only: bool = False) -> DataFrame:
    """(event_type, event_date, state) of frozen events that differ from their seal."""
    return hash_tree.damage(
        spark, f"{path}/events", f"{path}/seal", event_line(), event_partition(), changed_only=changed_only
    )


def read_frozen(spark: SparkSession, path: str, name: str) -> DataFrame:
    sub = name if name in ("events", "source_snapshots") else f"inputs/{name}"
    return spark.read.parquet(f"{path}/{sub}")
