"""Streaming twin of ingest: every micro-batch runs the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthline.functions.hashing import dedupe_key
from hearthline.sources.ingest import append_events
from hearthline.sources.keyed import ingest_batch


def stream_ingest(
    stream: DataFrame,
    path: str,
    *,
    source_id: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start appending a stream of canonical events to the event table.

    Deduplication is exact against the whole store and keeps no streaming state: a batch that is
    replayed after a failure finds its own keys in the store and appends nothing twice. Late
    events need no rule because every reader is as-of by occurred_at.
    """

    def run(batch: DataFrame, _: int) -> None:
        append_events(batch.sparkSession, path, batch, source_id=source_id)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_keyed(
    stream: DataFrame, path: str, *, source_id: str, checkpoint: str, name: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start taking a stream into an indexed event table (`sources.keyed`).

    Each micro-batch is one commit that also names the micro-batch, so a replay after a failure is skipped whole. Key
    lookups read the index files of the batch's keys only. Exact against all that the table holds.
    """

    def run(batch: DataFrame, number: int) -> None:
        ingest_batch(batch.sparkSession, path, batch, source_id=source_id, stream=(name, number))

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_dedupe(
    stream: DataFrame, path: str, *, checkpoint: str, delay: str = "1 day", trigger: dict | None = None
) -> StreamingQuery:
    """The cheap variant: keys are kept as streaming state for `delay` of event time after their first arrival.

    No table is probed. The first arrival of a key is kept, not the earliest event; a repeat that comes later than
    `delay` after it is written again, which a later exact ingest removes.
    """
    keyed = stream.withColumn("dedupe_key", dedupe_key(F.col("source_id"), F.col("source_event_key"), F.col("schema_version")))
    once = keyed.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["dedupe_key"])
    return (
        once.withColumn("event_date", F.to_date("occurred_at")).writeStream.format("parquet")
        .partitionBy("event_type", "event_date").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )
