import hashlib
import json
import uuid

from pyspark.sql import functions as F

from hearthline.functions import hashing as hs
from hearthline.functions import parsing as ps


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_band_midpoints(spark):
    cases = {
        "1-2b": 1500.0, "15-20m": 17.5, "50-80m": 65.0, "<50m": 40.0, "100m+": 120.0, "75": 75.0,
        "2b+": 2400.0, "unknown": None, "": None, "n/a": None,
    }
    for text, want in cases.items():
        got = one(spark, ps.band_midpoint(F.lit(text)))
        assert got == want or abs(got - want) < 1e-9, text
    assert one(spark, ps.band_midpoint(F.lit(None).cast("string"))) is None


def test_days_floats_and_flags(spark):
    assert one(spark, ps.parse_days(F.lit("within 90 days"))) == 90
    assert one(spark, ps.parse_days(F.lit("Unknown"))) is None
    assert one(spark, ps.parse_float(F.lit("abc"))) is None
    assert one(spark, ps.parse_verified(F.lit(" Yes "))) is True
    assert one(spark, ps.parse_verified(F.lit("false"))) is False
    assert one(spark, ps.parse_verified(F.lit(None).cast("string"))) is True
    assert one(spark, ps.clean_null(F.lit(" AUTO "))) is None
    assert one(spark, ps.clean_null(F.lit(" x "))) == "x"


def test_timestamps_need_a_zone(spark):
    a = one(spark, F.unix_seconds(ps.parse_ts(F.lit("2026-09-01T10:00:00+07:00"))))
    b = one(spark, F.unix_seconds(ps.parse_ts(F.lit("2026-09-01T03:00:00Z"))))
    assert a == b
    assert one(spark, ps.parse_ts(F.lit("2026-09-01T10:00:00"))) is None
    assert one(spark, ps.parse_ts(F.lit("garbage"))) is None


def test_uuid5_and_passthrough(spark):
    space = uuid.UUID(hs.ANALYTICS_NAMESPACE)
    for key in ("H1", "khách-hàng", "a|b", "x" * 40):
        want = str(uuid.uuid5(space, f"household:{key}"))
        assert one(spark, hs.analytics_uuid(F.lit(key), namespace="household")) == want
    given = "22222222-2222-2222-2222-222222222222"
    assert one(spark, hs.analytics_uuid(F.lit("{" + given.upper() + "}"))) == given
    assert one(spark, hs.analytics_uuid(F.lit("  "))) is None


def test_hashes_equal_json_dumps(spark):
    row = {"b": 'say "hi"\t', "a": "giá", "c": ""}
    m = F.create_map(*[F.lit(x) for kv in row.items() for x in kv])
    for compact, sep in ((True, (",", ":")), (False, (", ", ": "))):
        text = json.dumps(row, ensure_ascii=False, sort_keys=True, separators=sep)
        want = hashlib.sha256(text.encode()).hexdigest()
        assert one(spark, hs.stable_row_key(m, compact=compact)) == want
    key = hs.dedupe_key(F.lit("crm"), F.lit("1"), F.lit("1"))
    assert one(spark, key) == hashlib.sha256(b"crm|1|1").hexdigest()
    assert one(spark, hs.pseudonymous_key(F.lit("  "), namespace="x")) is None


def test_uniform_is_flat_and_repeatable(spark):
    df = spark.range(20000).select(hs.uniform("s", 1, F.col("id")).alias("u"))
    row = df.agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(row["m"] - 0.5) < 0.01 and row["lo"] >= 0 and row["hi"] < 1
    assert sorted(df.repartition(1).collect()) == sorted(df.repartition(7).collect())


def test_table_digest_equals_the_sum_of_lanes(spark):
    import hashlib

    from hearthline.functions.hashing import canonical_json, digest_root, multiset_digest, table_digest

    df = spark.range(700).select(F.when(F.col("id") % 9 != 0, F.sha2(F.col("id").cast("string"), 256)).alias("h"))
    known = [hashlib.sha256(str(i).encode()).digest() for i in range(700) if i % 9]
    lanes = [sum(int.from_bytes(h[4 * i:4 * i + 4], "big") for h in known) for i in range(8)]
    want = hashlib.sha256("|".join(map(str, [len(known), *lanes])).encode()).hexdigest()
    got = table_digest(df.select(F.unhex("h").alias("h"))).first()
    assert (got["rows"], got["digest"]) == (700, want)
    assert df.agg(digest_root(multiset_digest(F.col("h"))).alias("d")).first()["d"] == want
    assert tuple(table_digest(df.limit(0)).first())[0] == 0
    # a key that JSON holds twice, an escape and a null
    m = F.from_json(F.lit('{"b":"x\\"","a":"1","a":"2","c":null}'), "map<string,string>")
    assert spark.range(1).select(canonical_json(m).alias("j")).first()["j"] == '{"a":"1","a":"2","b":"x\\"","c":null}'


def test_parsed_fields_are_read_once(spark):
    from hearthline.sources import events, tables

    lines = spark.createDataFrame([("{}",)], "value string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(events.parse_event_lines(lines)[0]).count("from_json(") == 1
    raw = spark.createDataFrame([("2026-01-02T03:04:05+0100",)], "effective_from string")
    assert plan(tables.parse_offers(raw)[0]).count("try_to_timestamp") <= 2
    got = raw.select(ps.parse_ts(F.col("effective_from")).alias("t"), ps.parse_ts(F.lit("2026-01-02T02:04:05Z")).alias("u")).first()
    assert got["t"] == got["u"]
