from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from hearthline.operators import choices, features, quality, temporal, utility


def day(n, month=9):
    return datetime(2026, month, n, tzinfo=timezone.utc)


UNIT_SCHEMA = (
    "version_id string, unit_id string, project_id string, unit_code string, "
    "product_type string, inventory_state string, effective_from timestamp, "
    "effective_to timestamp, source_id string"
)
OFFER_SCHEMA = (
    "offer_id string, unit_id string, product_type string, list_price double, net_price double, "
    "discount_pct double, incentive_cash double, payment_plan_code string, "
    "down_payment_pct double, monthly_payment_est double, effective_from timestamp, "
    "effective_to timestamp, source_id string"
)


def units(spark, *rows):
    return spark.createDataFrame(
        [(f"v{i}", u, "p", f"K-{u}", "townhouse", state, a, b, "inv")
         for i, (u, state, a, b) in enumerate(rows)], UNIT_SCHEMA,
    )


def offers(spark, *rows):
    return spark.createDataFrame(
        [(f"o{i}", u, None, price, None, 0.0, 0.0, "P", 0.3, 1e7, a, b, "offers")
         for i, (u, price, a, b) in enumerate(rows)], OFFER_SCHEMA,
    )


def asofs(spark, *days):
    return spark.createDataFrame([("p", d) for d in days], "project_id string, as_of timestamp")


def test_temporal_choice_set(spark):
    u = units(spark, ("u", "available", day(1), day(10)), ("u", "sold", day(10), None))
    o = offers(spark, ("u", 1e9, day(1), day(10)))
    rows, bad = choices.choice_set(asofs(spark, day(5), day(12)), u, o)
    got = {}
    for r in rows.orderBy("as_of", "alt_order").collect():
        got.setdefault(r["as_of"].day, []).append(r["alternative_id"])
    outside = ["OUT-COMPETITOR", "OUT-LAND-HOUSE", "OUT-RENT", "OUT-POSTPONE", "OUT-NO-PURCHASE"]
    assert got == {5: ["K-u", *outside], 12: outside}
    assert bad.count() == 0


def test_latest_start_wins_and_ambiguity_is_reported(spark):
    u = units(
        spark, ("u", "available", day(1), None), ("u", "available", day(3), None),
        ("w", "available", day(2), None), ("w", "sold", day(2), None),
    )
    o = offers(
        spark, ("u", 1e9, day(1), None), ("u", 2e9, day(4), None), ("w", 1e9, day(1), None)
    )
    rows, bad = choices.choice_set(asofs(spark, day(5)), u, o)
    row = rows.where("alternative_id = 'K-u'").first()
    assert row["effective_price"] == 2e9
    assert [r["code"] for r in bad.collect()] == ["ambiguous_unit_version"]
    with pytest.raises(quality.DataQualityError, match="ambiguous_unit_version"):
        quality.gate(bad)


def test_interval_join_matches_brute_force(spark):
    """A hot key, open and overlapping intervals: same winners as comparing everything."""
    rows = [
        (f"v{i}", f"u{i % 3}", "p", f"K{i % 3}", "townhouse", "available",
         day(1 + i % 9), day(10 + i % 15) if i % 4 else None, "s")
        for i in range(40)
    ]
    seen, unique = set(), []
    for r in rows:
        if (r[1], r[6]) not in seen:
            seen.add((r[1], r[6]))
            unique.append(r)
    u = spark.createDataFrame(unique, UNIT_SCHEMA)
    points = asofs(spark, *[day(d) for d in range(1, 28)])
    for width in (1, 5, 90):
        got = {
            (r["as_of"], r["unit_id"]): r["version_id"]
            for r in temporal.interval_latest(
                points, u, on=["project_id"], at="as_of", start="effective_from",
                end="effective_to", entity=["unit_id"], row_id="version_id",
                values=("version_id",), bucket_days=width,
            ).collect()
        }
        want = {}
        for d in range(1, 28):
            at = day(d)
            for r in unique:
                if r[6] <= at and (r[7] is None or at < r[7]):
                    key = (at.replace(tzinfo=None), r[1])
                    if key not in want or r[6] > want[key][0]:
                        want[key] = (r[6], r[0])
        assert got == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("levels", [1, 2, 3, 5])
def test_interval_cells_cover_each_bucket_once(spark, levels):
    spans = [(a, a + n) for a in (-70, -5, -1, 0, 3, 16, 63) for n in (0, 1, 3, 4, 15, 64, 300)]
    frame = spark.createDataFrame(spans, "a long, b long")
    for r in frame.select("a", "b", temporal.interval_cells(F.col("a"), F.col("b"), levels).alias("cells")).collect():
        buckets = []
        for cell in r.cells:
            number, size = cell // levels, 4 ** (cell % levels)
            buckets += range(number * size, (number + 1) * size)
        assert sorted(buckets) == list(range(r.a, r.b + 1))
        assert len(r.cells) <= 6 * (levels - 1) + max(8, (r.b - r.a + 1) // 4 ** (levels - 1) + 1)


def test_long_intervals_are_few_rows_and_meet_the_same_points(spark):
    start = datetime(1990, 1, 1, tzinfo=timezone.utc)
    rows = [("v1", "u1", "p", "K1", "townhouse", "available", start, None, "s"),
            ("v2", "u2", "p", "K2", "townhouse", "available", start, day(3, 10), "s"),
            ("v3", "u3", "p", "K3", "townhouse", "available", day(2), day(4), "s")]
    u = spark.createDataFrame(rows, UNIT_SCHEMA)
    points = asofs(spark, day(1), day(3), day(3, 10), day(20, 10))
    kw = dict(on=["project_id"], at="as_of", start="effective_from", end="effective_to", horizon=day(20, 10), bucket_days=1)
    levels = temporal.interval_levels(u, start="effective_from", end="effective_to", horizon=day(20, 10), bucket_days=1)
    assert levels > 5
    last = temporal.time_bucket(temporal._last_active("effective_to", day(20, 10)), 1)
    cells = temporal.interval_cells(temporal.time_bucket(F.col("effective_from"), 1), last, levels)
    assert max(r.n for r in u.select(F.size(cells).alias("n")).collect()) <= 6 * levels
    met = sorted((r.as_of, r.version_id) for r in temporal.interval_pairs(points, u, **kw).collect())
    plain = sorted((r.as_of, r.version_id) for r in temporal.interval_pairs(points, u, **kw, levels=1).collect())
    assert met == plain and len(met) == 7
    left = temporal.interval_latest(
        points.unionAll(points.withColumn("project_id", F.lit("q"))), u, **kw, entity=["project_id"], row_id="version_id", values=("version_id",), how="left"
    )
    assert left.count() == 8 and left.where("version_id IS NULL").count() == 4


def outcome_events(spark, *rows):
    return spark.createDataFrame(
        [("decision_outcome_observed", h, at, f"k{i}", p)
         for i, (h, at, p) in enumerate(rows)],
        "event_type string, entity_id string, occurred_at timestamp, source_event_key string, "
        "payload map<string,string>",
    ).withColumn("source_id", F.lit("o"))


def test_historical_decisions(spark):
    u = units(spark, ("u", "available", day(1), None))
    o = offers(spark, ("u", 1e9, day(1), None))
    ev = outcome_events(
        spark,
        ("h1", day(5), {"outcome_type": "booking", "unit_code": "K-u", "verified": "true"}),
        ("h2", day(5), {"outcome_type": "lost", "verified": "yes"}),
        ("h3", day(5), {"outcome_type": "booking", "unit_code": "K-x"}),
        ("h4", day(5), {"outcome_type": "site_tour", "verified": "true"}),
        ("h5", day(5), {"outcome_type": "booking", "unit_code": "K-u", "verified": "false"}),
        ("h6", day(5), {"outside_option": "moon"}),
    )
    good, bad = choices.historical_decisions(ev, u, o, project=F.lit("p"))
    got = {
        r["decision_id"]: (r["selected_alternative_id"], r["stage"], r["chosen"])
        for r in good.collect()
    }
    assert got == {
        "o:k0": ("K-u", "booking", 0), "o:k1": ("OUT-NO-PURCHASE", "final", 5),
        "o:k3": (None, "site_tour", None),
    }
    assert {(r["decision_id"], r["code"]) for r in bad.collect()} == {
        ("o:k2", "selected_alternative_unavailable"), ("o:k5", "unknown_outside_option"),
    }


def test_assembly_refuses_repeated_codes_and_offers_without_source(spark):
    u = units(spark, ("u", "available", day(1), None), ("w", "available", day(1), None))
    o = offers(spark, ("u", 1e9, day(1), None), ("w", 1e9, day(1), None))
    twin = u.withColumn("unit_code", F.lit("K-same"))
    blank = o.withColumn(
        "source_id", F.when(F.col("unit_id") == "u", F.lit(" ")).otherwise(F.col("source_id"))
    )
    made = outcome_events(spark, ("h", day(5), {"outside_option": "no_purchase"}))
    for some_units, some_offers, code in (
        (twin, o, "duplicate_alternative"), (u, blank, "missing_provenance"),
    ):
        _, bad = choices.choice_sets(asofs(spark, day(5)), some_units, some_offers)
        assert [r["code"] for r in bad.collect()] == [code]
        good, bad = choices.historical_decisions(made, some_units, some_offers, project=F.lit("p"))
        assert good.count() == 0 and [r["code"] for r in bad.collect()] == [code]


def test_unavailable_unit_is_a_violation(spark):
    u = units(spark, ("u", "available", day(1), None))
    o = offers(spark, ("u", 1e9, day(1), None))
    sets, _ = choices.choice_sets(asofs(spark, day(5)), u, o)
    rows = choices.unpack_choice_sets(sets).withColumn(
        "inventory_state",
        F.when(F.col("alternative_type") == "unit", "held").otherwise(F.col("inventory_state")),
    )
    packed = choices.pack_choice_sets(rows).withColumn("set_id", F.lit("s"))
    assert packed.select(F.size("alts")).first()[0] == 6
    assert packed.first()["alts"][0]["alternative_id"] == "K-u"
    codes = [r["code"] for r in quality.validate_choice_sets(packed).collect()]
    assert codes == ["unavailable_unit"]
    bare = packed.withColumn(
        "alts", F.filter("alts", lambda a: a["alternative_type"] == "nothing")
    )
    assert {r["code"] for r in quality.validate_choice_sets(bare).collect()} == {
        "empty_choice_set", "missing_outside_option",
    }


def observations(spark, *rows):
    return spark.createDataFrame(
        rows, "household_id string, feature_name string, value string, observed_at timestamp, "
        "source_id string",
    )


def test_features_never_come_from_the_future(spark):
    obs = observations(
        spark, ("h", "workplace_zone", "A", day(2), "s1"), ("h", "workplace_zone", "B", day(9), "s2"),
        ("h", "workplace_zone", "C", day(5), "s1"), ("h", "workplace_zone", "D", day(5), "s2"),
    )
    d = spark.createDataFrame(
        [("1", "h", day(1)), ("2", "h", day(4)), ("3", "h", day(5)), ("4", "h", day(20))],
        "decision_id string, household_id string, as_of timestamp",
    )
    for width in (1, 3, 400):
        wide = features.asof_features(d, obs, features=("workplace_zone",), bucket_days=width)
        got = {
            r["decision_id"]: r["f_workplace_zone"] and tuple(r["f_workplace_zone"])
            for r in wide.collect()
        }
        assert got == {"1": None, "2": ("s1", "A"), "3": ("s2", "D"), "4": ("s2", "B")}


def test_asof_matches_range_join_on_a_hot_key(spark):
    left = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).alias("k"),
        F.timestamp_seconds(1767225600 + (F.col("id") * 7919) % 500000).alias("t"), "id",
    )
    right = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).alias("k"),
        F.timestamp_seconds(1767225600 + (F.col("id") * 104729) % 500000).alias("rt"),
        F.concat(F.lit("v"), "id").alias("v"),
    )
    got = temporal.asof_latest(
        left, right, on=["k"], left_ts="t", right_ts="rt", tie=["v"], values={"out": "v"}
    )
    slow = left.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2"))
                     & (F.col("rt") <= F.col("t")), "left")
    want = slow.groupBy("id").agg(
        F.max(F.when(F.col("v").isNotNull(), F.struct("rt", "v"))).alias("b")
    ).select("id", F.col("b.v").alias("out"))
    assert sorted(map(tuple, got.select("id", "out").collect())) == sorted(
        map(tuple, want.collect())
    )


def test_asof_of_hot_keys_in_time_buckets(spark, monkeypatch):
    left = spark.range(300).select(
        F.when(F.col("id") % 50 == 3, None).when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).alias("k"),
        F.when(F.col("id") % 41 != 5, F.timestamp_seconds(1767225600 + (F.col("id") * 7919) % 5000000)).alias("t"), "id",
    )
    right = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).when(F.col("id") % 40 != 1, 0).alias("k"),
        F.timestamp_seconds(1767225600 + F.floor((F.col("id") * 104729) % 5000000 / 100000) * 100000).alias("rt"),
        (F.col("id") % 5).alias("s"), F.concat(F.lit("v"), "id").alias("v"),
    )
    ask = lambda: temporal.asof_latest(
        left, right, on=["k"], left_ts="t", right_ts="rt", tie=["s", "v"], values={"out": "v"}, bucket_days=3
    )
    cold = ask()
    monkeypatch.setattr(temporal, "HOT_ROWS", 1)
    assert temporal.hot_groups(left, on=["k"])
    slow = left.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & (F.col("rt") <= F.col("t")), "left")
    want = slow.groupBy("id").agg(
        F.max(F.when(F.col("v").isNotNull(), F.struct("rt", "s", "v"))).alias("b")
    ).select("id", F.col("b.v").alias("out"))
    want = sorted(map(tuple, want.collect()))
    assert len(want) == 300 and sum(out is None for _, out in want) > 10
    for got in (cold, ask()):
        assert sorted(map(tuple, got.select("id", "out").collect())) == want


def test_asof_features_take_one_shuffle(spark):
    events = spark.createDataFrame(
        [("qualification_observed", "a", day(1), "s", "1", {"workplace_zone": "A"}),
         ("qualification_observed", "a", day(1), "s", "2", {"workplace_zone": "B"})],
        "event_type string, entity_id string, occurred_at timestamp, source_id string, source_event_key string, "
        "payload map<string,string>",
    )
    wide = features.feature_columns(events, ["workplace_zone"], anchor="place")
    d = wide.select("household_id", F.lit(day(3)).alias("as_of"), F.lit("d").alias("decision_id"))
    got = features.asof_features(d, wide)
    # decisions ride along; before, points and observations were shuffled five times
    assert got._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert [(r.decision_id, tuple(r.f_workplace_zone), tuple(r.f_place)) for r in got.collect()] == [
        ("d", ("s:2", "B"), ("s:2", "B"))
    ] * 2


TRAVEL = (
    "origin_anchor_id string, destination_anchor_id string, mode string, "
    "departure_bucket string, travel_time_min double, observed_at timestamp, "
    "valid_from timestamp, valid_to timestamp, source_id string"
)


def test_commute_as_of(spark):
    travel = spark.createDataFrame(
        [("Z", "P", "motorbike", "am_peak", 31.0, day(1), day(1), None, "r"),
         ("Z", "P", "motorbike", "am_peak", 27.0, day(10), day(10), None, "r"),
         ("N", "P", "motorbike", "am_peak", 18.0, day(1), day(1), None, "r")], TRAVEL,
    )
    anchors = spark.createDataFrame(
        [("h", "Z", day(1), "s"), ("m", "Z", day(1), "s"), ("m", "N", day(8), "s")],
        "household_id string, anchor_id string, observed_at timestamp, source_id string",
    )
    asked = spark.createDataFrame(
        [("h", "P", day(5)), ("h", "P", day(12)), ("x", "P", day(5)), ("m", "P", day(5)),
         ("m", "P", day(12))],
        "household_id string, destination_anchor_id string, as_of timestamp",
    )
    got = {
        (r["household_id"], r["as_of"].day): r["commute_min"]
        for r in features.commute_lookup(asked, anchors, travel).collect()
    }
    assert got == {("h", 5): 31.0, ("h", 12): 27.0, ("x", 5): None, ("m", 5): 31.0,
                   ("m", 12): 18.0}
    static = spark.createDataFrame([("x", "N")], "household_id string, anchor_id string")
    got = features.commute_lookup(asked, anchors, travel, static=static)
    assert got.where("household_id = 'x'").first()["commute_min"] == 18.0


def test_softmax_sums_to_one(spark):
    u = units(spark, *[(f"u{i}", "available", day(1), None) for i in range(4)])
    o = offers(spark, *[(f"u{i}", 1e9 * (1 + i), day(1), None) for i in range(4)])
    sets, _ = choices.choice_sets(asofs(spark, day(5)), u, o)
    household = sets.withColumns(
        {
            "purchase_purpose": F.lit("own_stay"), "preferred_product_type": F.lit("townhouse"),
            "max_monthly_payment_million": F.lit(5.0), "purchase_horizon_days": F.lit(200),
        }
    )
    row = utility.choice_probabilities(household).first()
    assert abs(sum(row["p"]) - 1) < 1e-12 and min(row["p"]) > 0
    # match 0.85, breach -1.10, price -0.58 per billion, payment -0.42 per ten million
    assert abs(row["u"][0] - (0.85 - 1.10 - 0.58 - 0.42)) < 1e-12
    assert abs(row["u"][6] - (-0.25 + 0.12)) < 1e-12 and abs(row["u"][7] - (-0.07)) < 1e-12
    train = utility.choice_probabilities(household, mode="training").first()
    assert len(set(train["u"][4:])) == 1


def test_every_feature_name_is_kept(spark):
    obs = observations(
        spark, ("h", "workplace_zone", "A", day(2), "s1"), ("h", "anything_new", "x", day(3), "s2"),
        ("h", "stage", "visit", day(9), "s2"),
    )
    d = spark.createDataFrame([("1", "h", day(4))], "decision_id string, household_id string, as_of timestamp")
    got = features.feature_rows(features.asof_features(d, obs), ["decision_id"]).collect()
    assert {(r["feature_name"], r["value"]) for r in got} == {("workplace_zone", "A"), ("anything_new", "x")}


def test_unit_listed_by_two_projects_stays_in_both_sets(spark):
    u = units(spark, ("u", "available", day(1), None))
    u = u.unionByName(u.withColumns({"project_id": F.lit("q"), "version_id": F.lit("w")}))
    asked = asofs(spark, day(5)).unionAll(asofs(spark, day(5)).withColumn("project_id", F.lit("q")))
    rows, bad = choices.choice_set(asked, u, offers(spark, ("u", 1e9, day(1), None)), outside=False)
    assert sorted((r.project_id, r.alternative_id) for r in rows.collect()) == [("p", "K-u"), ("q", "K-u")]
    assert bad.count() == 0


def test_sets_over_years_match_brute_force(spark):
    """Versions and offers that cross cells, overlap and share starts: the sets of a plain loop."""
    from datetime import timedelta

    zero = datetime(2020, 1, 1, tzinfo=timezone.utc)
    at = lambda n: zero + timedelta(days=n)
    u = [(f"u{i % 4}", "sold" if i % 5 == 0 else "available", at(37 * i), at(37 * i + 90 + 11 * i) if i % 6 else None)
         for i in range(30)]
    o = [(f"u{i % 4}", float(i), at(23 * i), at(23 * i + 40 + i % 7 * 60) if i % 9 else None) for i in range(50)]
    days = list(range(0, 1500, 13))
    sets, bad = choices.choice_sets(
        asofs(spark, *[at(n) for n in days]), units(spark, *u), offers(spark, *o), outside=False
    )
    got = {r.as_of: [(a.alternative_id, a.effective_price) for a in r.alts] for r in sets.collect()}
    live = lambda rows, key, t: max(
        ((r[2], r) for r in rows if r[0] == key and r[2] <= t and (r[3] is None or t < r[3])), default=(None, None)
    )[1]
    for n in days:
        want = []
        for key in ("u0", "u1", "u2", "u3"):
            version, offer = live(u, key, at(n)), live(o, key, at(n))
            if version and version[1] == "available" and offer:
                want.append((f"K-{key}", offer[1]))
        assert got[at(n).replace(tzinfo=None)] == want
    assert bad.count() == 0


def test_winners_after_an_interval_join_are_not_shuffled_again(spark):
    """One long version among short ones keeps one cell size, so only the two sides of the join move."""
    rows = [(f"u{i}", "available", day(1), day(2)) for i in range(30)] + [("u", "available", day(1, 1), None)]
    found = choices.scd_active_units(asofs(spark, day(1), day(20, 12)), units(spark, *rows), horizon=day(20, 12))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "unit_id" in plan
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert not [line for line in moves if "unit_id" in line]
    assert found.count() == 32


def test_commute_can_come_once_per_decision(spark):
    rows = spark.createDataFrame([("d", "K-u", "unit"), ("d", "OUT-RENT", "continue_renting"), ("e", "K-u", "unit")],
                                 "decision_id string, alternative_id string, alternative_type string")
    known = spark.createDataFrame([("d", 12.0)], "decision_id string, commute_min double")
    got = {(r[0], r[1]): r.commute_min for r in choices.add_commute(rows, known, on=["decision_id"]).collect()}
    assert got == {("d", "K-u"): 12.0, ("d", "OUT-RENT"): None, ("e", "K-u"): None}


def optimized(name, spark):
    from hearthline.bindings.queries import run

    return run(name, spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_the_search_through_spells_stands_once_in_a_plan(spark):
    for name in ("historical_decisions", "choice_set"):
        assert optimized(name, spark).count("filter(spells#") == 1, name


def test_unit_versions_are_dealt_by_part_once(spark):
    from hearthline.bindings.market import Market

    plan = Market(spark, "/root/testdata/sf0.001").units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rivals_matter_only_where_they_win(spark):
    """A version that shares its start with one that has ended, and two offers of a sold unit, are no ambiguity."""
    versions = spark.createDataFrame(
        [("a", "U1", "p", "K1", "t", "available", day(1), day(3), "s"),
         ("b", "U1", "p", "K1", "t", "available", day(1), day(9), "s"),
         ("c", "U2", "p", "K2", "t", "sold", day(1), None, "s")], UNIT_SCHEMA,
    )
    priced = spark.createDataFrame(
        [(o, u, None, 1e9, None, 0.0, 0.0, "P", 0.3, 9e6, day(1), None, "s")
         for o, u in (("f1", "U1"), ("f2", "U2"), ("f3", "U2"))], OFFER_SCHEMA,
    )
    asofs = spark.createDataFrame([("p", day(2)), ("p", day(4)), ("p", day(20))], "project_id string, as_of timestamp")
    sets, bad = choices.choice_sets(asofs, versions, priced)
    found = bad.select(F.dayofmonth("as_of").alias("d"), "code").collect()
    assert [tuple(r) for r in found] == [(2, "ambiguous_unit_version")]
    sizes = {r["d"]: r["n"] for r in sets.select(F.dayofmonth("as_of").alias("d"), F.size("alts").alias("n")).collect()}
    assert sizes == {2: 6, 4: 6, 20: 5}


def test_sets_are_checked_as_they_lie(spark):
    assert "posexplode" not in optimized("validate_choice_sets", spark)
