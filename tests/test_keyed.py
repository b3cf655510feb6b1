"""The indexed event table: one commit for all, writers that meet, flat reads, streams."""

import pytest
from pyspark.sql import functions as F

from hearthline.sources import ingest, keyed
from hearthline.streaming.ingest import stream_dedupe, stream_keyed


def some_events(spark, lo, hi, source="crm"):
    return spark.range(lo, hi).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit("visit").alias("event_type"), F.lit("household").alias("entity_type"),
        F.concat(F.lit("h"), F.col("id") % 7).alias("entity_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("occurred_at"),
        F.current_timestamp().alias("ingested_at"), F.lit(source).alias("source_id"),
        F.col("id").cast("string").alias("source_event_key"),
        F.create_map(F.lit("n"), F.col("id").cast("string")).alias("payload"), F.lit("1").alias("schema_version"),
    )


def some_snapshot(spark, content, rows):
    return spark.createDataFrame([(content, "crm", content, rows)], "i string, source_id string, content_hash string, record_count long").select(
        F.col("i").alias("snapshot_id"), "source_id", F.current_timestamp().alias("captured_at"), "content_hash", "record_count",
        F.lit("1").alias("schema_version"), F.create_map(F.lit("path"), F.lit("a.csv")).alias("metadata"),
    )


def held(spark, path):
    return sorted(int(r[0]) for r in keyed.stored_events(spark, path).select("source_event_key").collect())


def test_events_and_snapshot_in_one_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    got = keyed.ingest_batch(
        spark, path, some_events(spark, 0, 30).unionAll(some_events(spark, 0, 10)), source_id="crm", snapshot=some_snapshot(spark, "c1", 40)
    )
    assert (got["received"], got["inserted"], got["duplicates"]) == (40, 30, 10)
    assert keyed.versions(spark, path) == [0] and keyed.stored_snapshots(spark, path).count() == 1
    again = keyed.ingest_batch(spark, path, some_events(spark, 20, 40), source_id="crm", snapshot=some_snapshot(spark, "c1", 40))
    assert (again["inserted"], again["duplicates"]) == (10, 10)
    assert held(spark, path) == list(range(40)) and keyed.stored_snapshots(spark, path).count() == 1
    nothing = keyed.ingest_batch(spark, path, some_events(spark, 0, 0), source_id="crm")
    assert nothing["received"] == 0 and nothing["accepted_ratio"] == 1.0 and keyed.versions(spark, path) == [0, 1]
    with pytest.raises(ingest.SourceMismatch):
        keyed.ingest_batch(spark, path, some_events(spark, 0, 3, source="other"), source_id="crm")
    # a write that never came to its commit is not seen
    some_events(spark, 900, 910).withColumns({"dedupe_key": F.lit("k"), "event_date": F.to_date("occurred_at")}).write.partitionBy(
        "event_type", "event_date").parquet(f"{path}/events/batch=lost")
    assert held(spark, path) == list(range(40))


def test_two_writers_one_is_retried(spark, tmp_path):
    path, tries = str(tmp_path / "t"), []
    keyed.ingest_batch(spark, path, some_events(spark, 0, 5), source_id="crm")

    def other(made):
        if not tries:  # the second writer commits between this one's read and its commit
            keyed.ingest_batch(spark, path, some_events(spark, 3, 12), source_id="crm", snapshot=some_snapshot(spark, "b", 9))
        tries.append(made.version)

    got = keyed.ingest_batch(
        spark, path, some_events(spark, 8, 20), source_id="crm", snapshot=some_snapshot(spark, "a", 12), before_publish=other
    )
    assert tries == [1, 2] and got["inserted"] == 8
    assert held(spark, path) == list(range(20)) and keyed.stored_snapshots(spark, path).count() == 2
    assert keyed.versions(spark, path) == [0, 1, 2]


def test_probe_reads_no_more_as_the_table_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "KEYS_PER_FILE", 50)
    path, read = str(tmp_path / "t"), []
    probe = ingest.first_per_key(some_events(spark, 3, 4))
    for lo, hi in ((0, 400), (400, 4000), (4000, 4010), (4010, 4020)):
        keyed.ingest_batch(spark, path, some_events(spark, lo, hi), source_id="crm")
        keys = keyed.probe_keys(spark, path, keyed.last_commit(spark, path), probe)
        assert keys.join(probe, "dedupe_key", "left_semi").count() == 1
        read.append(keys.count())
    assert max(read) <= 100  # of 4,020 keys
    runs = keyed.last_commit(spark, path).runs
    assert sum(r.rows for r in runs) == 4020 and len(runs) == 2
    assert held(spark, path) == list(range(4020))


def test_streams_with_late_repeats_and_restart(spark, tmp_path):
    src, table, flat = (str(tmp_path / n) for n in ("in", "table", "flat"))
    sent = [some_events(spark, 0, 20), some_events(spark, 15, 30), some_events(spark, 0, 5).unionAll(some_events(spark, 28, 40))]
    schema = sent[0].schema
    for part in sent:  # each round is a restart from the checkpoint
        part.coalesce(1).write.mode("append").parquet(src)
        opened = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_keyed(opened(), table, source_id="crm", checkpoint=str(tmp_path / "a"), name="web").awaitTermination()
        stream_dedupe(opened(), flat, checkpoint=str(tmp_path / "b"), delay="7 days").awaitTermination()
    assert held(spark, table) == list(range(40))
    assert sorted(int(r[0]) for r in spark.read.parquet(flat).select("source_event_key").collect()) == list(range(40))
    state = keyed.last_commit(spark, table).streams
    assert list(state) == ["web"] and state["web"] >= 2
    before = keyed.versions(spark, table)
    assert keyed.ingest_batch(spark, table, some_events(spark, 90, 95), source_id="crm", stream=("web", state["web"])) == {}
    assert keyed.versions(spark, table) == before


def test_a_large_batch_is_dealt_before_its_repeats_collapse(spark, tmp_path, monkeypatch):
    """One read task would sort the whole batch: parts follow from its rows. Repeats, hot ones too, still collapse."""
    monkeypatch.setattr(keyed, "ROWS_PER_TASK", 100)
    hot = some_events(spark, 5, 6).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(256)))).drop("copy")
    many = some_events(spark, 0, 700).unionAll(some_events(spark, 0, 44)).unionAll(hot).coalesce(1)
    assert keyed.dealt(many).rdd.getNumPartitions() == 10 and keyed.dealt(some_events(spark, 0, 100).coalesce(1)).rdd.getNumPartitions() == 1
    plans, first = [], keyed.first_per_key
    monkeypatch.setattr(keyed, "first_per_key", lambda new: (plans.append(new.rdd.getNumPartitions()), first(new))[1])
    path = str(tmp_path / "t")
    got = keyed.ingest_batch(spark, path, many, source_id="crm")
    assert (got["received"], got["inserted"]) == (1000, 700) and held(spark, path) == list(range(700)) and plans == [10]
