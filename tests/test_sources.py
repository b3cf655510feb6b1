import pytest
from pyspark.sql import functions as F

from hearthline.sources import adapters, connectors, events, ingest, tables
from hearthline.streaming.ingest import stream_ingest

UNITS = """﻿unit_id,project_id,unit_code,product_type,inventory_state,lot_area_m2,built_area_m2,effective_from,effective_to,source_id
u1,p,A-1,townhouse,available,80,180,2026-09-01T00:00:00+07:00,,inv
u2,p,A-2,castle,available,80,,2026-09-01T00:00:00+07:00,,inv
u3,p,A-3,townhouse,available,,,2026-09-01T00:00:00,,inv
"""
CAPTURE = (
    "captured_at,party_id,household_id,decision_stage,purchase_purpose,workplace_zone,reason_1,"
    "reason_1_direction,reason_2,reason_2_direction,outside_option,next_action\n"
    "2026-09-09T09:00:00+07:00,p1,h1,qualified,own_stay,Zone A,commute,objection,security,"
    "motivator,unknown,call\n"
    "2026-09-09T09:00:00+07:00,,,qualified,own_stay,Zone A,,,,,,\n"
)
LEADS = (
    "lead_id,contact_id,created_at,lead_source,campaign_id\n"
    "L1,C1,2026-09-16T08:00:00+07:00,web,K1\n"
    "L2,,2026-09-16T08:00:00+07:00,web,K1\n"
    ",C3,2026-09-16T08:00:00+07:00,web,\n"
    "L4,C4,2026-09-16T08:00:00,web,\n"
)


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_unit_versions_csv(spark, tmp_path):
    good, bad = tables.read_unit_versions(spark, write(tmp_path, "u.csv", UNITS))
    rows = good.collect()
    assert [r["unit_code"] for r in rows] == ["A-1"] and rows[0]["lot_area_m2"] == 80.0
    assert {r["reasons"] for r in bad.collect()} == {"product_type", "effective_from"}


def test_offer_defaults(spark, tmp_path):
    text = (
        "unit_id,product_type,list_price,net_price,discount_pct,incentive_cash,"
        "payment_plan_code,down_payment_pct,monthly_payment_est,effective_from,effective_to,"
        "source_id\nu1,,100,,,,P,,,2026-09-01T00:00:00Z,,o\n"
    )
    row = tables.read_offers(spark, write(tmp_path, "o.csv", text))[0].first()
    assert (row["discount_pct"], row["incentive_cash"], row["down_payment_pct"]) == (0, 0, 0.3)
    event = adapters.offers_to_events(
        tables.read_offers(spark, str(tmp_path / "o.csv"))[0]
    ).first()
    assert event["entity_type"] == "unit" and event["event_type"] == "offer_observed"


def test_sales_row_fans_out(spark, tmp_path):
    raw = tables.read_csv(spark, write(tmp_path, "c.csv", CAPTURE))
    good, bad = adapters.sales_capture_to_events(raw, source_id="capture")
    rows = good.orderBy("source_event_key").collect()
    assert [r["event_type"] for r in rows] == [
        "qualification_observed", "reason_observed", "reason_observed", "decision_stage_observed",
    ]
    assert rows[0]["payload"] == {"purchase_purpose": "own_stay", "workplace_zone": "Zone A"}
    assert rows[3]["payload"] == {"stage": "qualified", "next_action": "call"}
    again = adapters.sales_capture_to_events(raw, source_id="capture")[0]
    assert {r["event_id"] for r in again.collect()} == {r["event_id"] for r in rows}
    assert bad.count() == 1


def test_outcomes_fall_back_to_row_hash(spark):
    raw = spark.createDataFrame(
        [("2026-09-10T10:00:00Z", "h1", "booking", "A-1", "true", ""),
         ("2026-09-10T10:00:00Z", "", "booking", "A-1", "true", "")],
        "occurred_at string, household_id string, outcome_type string, unit_code string, "
        "verified string, source_record_id string",
    )
    good, bad = adapters.outcomes_to_events(raw, source_id="o")
    row = good.first()
    assert len(row["source_event_key"]) == 64 and row["payload"]["verified"] == "true"
    assert bad.count() == 1


def test_connector_pseudonymizes_and_warns(spark, tmp_path):
    raw = tables.read_csv(spark, write(tmp_path, "l.csv", LEADS))
    good, warnings = connectors.connector_to_events(
        raw, connectors.get_profile("crm_leads"), source_id="crm"
    )
    rows = good.collect()
    assert len(rows) == 1 and rows[0]["entity_id"].startswith("sha256:")
    assert sorted(r["warning"] for r in warnings.collect()) == [
        "invalid_timestamp", "missing_entity_id", "missing_source_event_key",
    ]
    with pytest.raises(ValueError, match="missing required columns: lead_source"):
        connectors.connector_to_events(
            raw.drop("lead_source"), connectors.get_profile("crm_leads"), source_id="crm"
        )
    with pytest.raises(ValueError, match="unknown connector profile"):
        connectors.get_profile("nope")


def test_map_records_rejects(spark):
    raw = spark.createDataFrame(
        [("1", "2026-01-01T00:00:00Z", "x"), ("2", "2026-01-01T00:00:00Z", ""),
         ("", "2026-01-01T00:00:00Z", "x"), ("4", "nope", "x")],
        "id string, at string, v string",
    )
    spec = connectors.MappingSpec(
        source_id="s", event_type="e", entity_type="t", entity_id="id", occurred_at="at",
        fields=(connectors.FieldRule("v", "value", required=True),
                connectors.FieldRule("w", "w", default="d")),
    )
    good, bad = connectors.map_records(raw, spec)
    assert good.first()["payload"] == {"value": "x", "w": "d"} and good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == [
        "invalid timestamp field: at", "missing entity id field: id",
        "missing required source field: v",
    ]


def sample_events(spark, keys, source="crm"):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    return events.as_events(
        rows, event_type=F.lit("lead_created"), entity_type=F.lit("party"),
        entity_id=F.col("k"), occurred_at=F.timestamp_seconds(F.lit(1767225600) + F.col("i")),
        source_id=F.lit(source), source_event_key=F.col("k"),
        payload=events.text_map({"n": F.col("i")}),
    )


def test_jsonl_round_trip(spark, tmp_path):
    df = sample_events(spark, ["a", "b"])
    path = str(tmp_path / "e")
    assert events.write_events_jsonl(df, path) == 2
    good, bad = events.read_events_jsonl(spark, path)
    assert sorted(r["payload"]["n"] for r in good.collect()) == ["0", "1"] and bad.count() == 0
    lines = spark.createDataFrame([("{bad",), ("",), ('{"event_type":"x"}',)], "value string")
    good, bad = events.parse_event_lines(lines)
    assert good.count() == 0 and bad.count() == 2


def test_the_jsonl_queries_write_files_and_read_them(spark):
    import glob

    from hearthline.bindings.queries import run
    from hearthline.session import shared_dir

    for name, total in (("write_events_jsonl", lambda df: df.first()["records"]), ("read_events_jsonl", lambda df: df.count())):
        before = set(glob.glob(f"{shared_dir(spark)}/events-jsonl-*".replace("file:", "")))
        found = total(run(name, spark, "/root/testdata/sf0.001"))
        new = set(glob.glob(f"{shared_dir(spark)}/events-jsonl-*".replace("file:", ""))) - before
        assert len(new) == 1 and found == spark.read.text(new.pop()).count() > 0


def test_compressed_lines_are_the_same_events(spark, tmp_path):
    df = sample_events(spark, ["a", "b"])
    assert events.write_events_jsonl(df, str(tmp_path / "z"), compression="gzip") == 2
    assert events.write_events_jsonl(df, str(tmp_path / "e")) == 2
    z, e = (events.read_events_jsonl(spark, str(tmp_path / n))[0].drop("ingested_at").collect() for n in "ze")
    assert sorted(map(str, z)) == sorted(map(str, e))


def test_ingest_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = sample_events(spark, ["a", "b", "a"])
    first = ingest.append_events(spark, path, batch, source_id="crm")
    again = ingest.append_events(spark, path, batch, source_id="crm")
    assert (first["received"], first["inserted"], first["duplicates"]) == (3, 2, 1)
    assert (again["inserted"], again["duplicates"]) == (0, 3)
    assert ingest.event_store(spark, path).count() == 2
    kept = ingest.event_store(spark, path).where("entity_id = 'a'").first()
    assert kept["payload"]["n"] == "0"  # the first of a repeated key wins
    with pytest.raises(ingest.SourceMismatch):
        ingest.append_events(spark, path, batch, source_id="other")


def test_ingest_does_not_depend_on_partitioning(spark):
    batch = sample_events(spark, ["a", "b", "a", "c"] * 5)
    store = sample_events(spark, ["c"])
    results = [
        sorted(
            (r["source_event_key"], r["payload"]["n"])
            for r in ingest.ingest_events(batch.repartition(n), store, source_id="crm")[0]
            .collect()
        )
        for n in (1, 7)
    ]
    assert results[0] == results[1] == [("a", "0"), ("b", "1")]


def test_stream_ingest(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    df = sample_events(spark, ["a", "b", "a"])
    for _ in range(2):
        df.write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = stream_ingest(stream, store, source_id="crm", checkpoint=str(tmp_path / "cp"))
        q.awaitTermination()
    assert ingest.event_store(spark, store).count() == 2


def test_file_snapshots(spark, tmp_path):
    import hashlib

    path = write(tmp_path, "l.csv", LEADS)
    snap = ingest.file_snapshots(spark, path, source_id="crm")
    row = snap.first()
    assert row["content_hash"] == hashlib.sha256(LEADS.encode()).hexdigest()
    assert row["record_count"] == 4
    assert ingest.record_source_snapshot(snap, snap).count() == 0


def test_snapshots_of_equal_names_empty_files_and_quoted_newlines(spark, tmp_path):
    import hashlib

    texts = {"a": "k,v\n1,x\n2,y\n", "b": 'k,v\n1,"two\nlines"\n', "c": ""}
    for folder, text in texts.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(text)
    got = ingest.file_snapshots(spark, str(tmp_path / "*"), source_id="crm").collect()
    assert sorted((r["content_hash"], r["record_count"]) for r in got) == sorted(
        (hashlib.sha256(t.encode()).hexdigest(), n) for t, n in zip(texts.values(), (2, 1, 0))
    )
    lines = ingest.file_snapshots(spark, str(tmp_path / "*"), source_id="crm", quoted=False, by_line=True)
    assert sorted(r["record_count"] for r in lines.collect()) == [0, 2, 2]


def test_iso_keeps_microseconds(spark):
    from hearthline.sources.adapters import iso
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.sql("SELECT timestamp'2024-01-02 03:04:05.123456' AS t UNION ALL SELECT timestamp'2024-01-02 03:04:05'")
    assert sorted(r[0] for r in rows.select(iso(F.col("t"))).collect()) == [
        "2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05Z",
    ]
