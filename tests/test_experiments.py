from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hearthline.operators import audit, experiments as ex, governance as gov
from hearthline.plans import forecast

T0 = datetime(2026, 9, 20, 8, tzinfo=timezone.utc)


def definitions(spark, method="randomized", minimum=50, **kw):
    base = dict(
        experiment_id="e", name="n", hypothesis="h", metric_name="rate",
        control_variant="control", treatment_variant="treatment", assignment_method=method,
        planned_start_at=None, planned_end_at=None, minimum_trials_per_variant=minimum,
        created_at=T0, created_by="me",
    )
    base.update(kw)
    return spark.createDataFrame(
        [tuple(base.values())],
        "experiment_id string, name string, hypothesis string, metric_name string, "
        "control_variant string, treatment_variant string, assignment_method string, "
        "planned_start_at timestamp, planned_end_at timestamp, "
        "minimum_trials_per_variant int, created_at timestamp, created_by string",
    )


def predictions(spark, p05=0.03, p50=0.08, p95=0.13, metric="rate", exp="e", model="m"):
    return spark.createDataFrame(
        [(exp, model, metric, 0.2, 0.28, p50, p05, p50, p95, 50, T0)],
        "experiment_id string, model_artifact_id string, metric_name string, "
        "control_point_estimate double, treatment_point_estimate double, effect_mean double, "
        "effect_p05 double, effect_p50 double, effect_p95 double, ensemble_samples int, "
        "created_at timestamp",
    )


OBS = ("experiment_id string, variant string, metric_name string, successes long, trials long, "
       "observed_at timestamp, source_id string, source_event_key string")
REC = ("experiment_id string, subject_key string, variant string, assigned_at timestamp, "
       "source_id string, source_event_key string, channel string, cohort string")


def obs(spark, *rows):
    return spark.createDataFrame(
        [("e", v, "rate", s, n, at, "crm", k) for v, s, n, at, k in rows], OBS
    )


def receipts(spark, *rows):
    return spark.createDataFrame(
        [("e", s, v, T0 + timedelta(minutes=m), "crm", k, "meta", "w1") for s, v, m, k in rows],
        REC,
    )


def test_evaluation_with_known_rates(spark):
    o = obs(spark, ("control", 20, 100, T0, "a"), ("treatment", 30, 100, T0, "b"))
    done, pending = ex.evaluate_experiment(definitions(spark), predictions(spark), o)
    r = done.first()
    assert abs(r["observed_effect"] - 0.10) < 1e-12 and r["within_interval"]
    assert r["direction_correct"] and r["causal_allowed"] and r["minimum_sample_reached"]
    assert abs(r["absolute_error"] - 0.02) < 1e-12 and pending.count() == 0
    assert r["warnings"] == ["observed_effect_ci_crosses_zero"]
    one_arm = o.where("variant = 'control'")
    done, pending = ex.evaluate_experiment(definitions(spark), predictions(spark), one_arm)
    assert done.count() == 0 and pending.first()["reason"] == "missing_observations"


def test_receipts_in_append_order(spark):
    new = receipts(
        spark, ("s1", "control", 1, "a1"), ("s1", "control", 2, "a1"),
        ("s1", "control", 3, "a1-again"), ("s1", "treatment", 4, "a2"),
        ("s2", "placebo", 5, "a3"), ("s3", "control", -5, "a4"),
    )
    got = {
        (r["source_event_key"], r["assigned_at"].minute): (r["status"], r["reason"])
        for r in ex.validate_assignments(new, definitions(spark), predictions(spark)).collect()
    }
    assert got[("a1", 1)] == ("accepted", None)
    assert got[("a1", 2)][0] == got[("a1-again", 3)][0] == "duplicate"
    assert got[("a2", 4)] == ("rejected", "subject assigned to a conflicting variant")
    assert got[("a3", 5)] == ("rejected", "unknown variant")
    assert got[("a4", 55)] == ("rejected", "predates the locked prediction")
    none = ex.validate_assignments(
        new, definitions(spark), predictions(spark).where("false")
    )
    assert {r["reason"] for r in none.collect()} == {"no locked prediction"}


def replay(rows):
    """The same rules, one receipt after the other."""
    log, out = [], {}
    for s, v, m, k in sorted(rows, key=lambda r: (r[2], r[3])):
        if any(x[1] == k for x in log):
            out[(s, m, k)] = "duplicate"
        elif any(x[0] == s for x in log):
            out[(s, m, k)] = (
                "duplicate" if all(x[2] == v for x in log if x[0] == s) else "rejected"
            )
        else:
            log.append((s, k, v))
            out[(s, m, k)] = "accepted"
    return out


def test_crossing_keys_settle_like_a_replay(spark):
    rows = [
        (f"s{(i * 7) % 5}", ["control", "treatment"][i % 2], i, f"k{(i * 3) % 8}")
        for i in range(40)
    ]
    got = {
        (r["subject_key"], r["assigned_at"], r["source_event_key"]): r["status"]
        for r in ex.validate_assignments(
            receipts(spark, *rows), definitions(spark), predictions(spark)
        ).collect()
    }
    want = {
        (s, (T0 + timedelta(minutes=m)).replace(tzinfo=None), k): status
        for (s, m, k), status in replay(rows).items()
    }
    assert got == want


def test_stored_receipts_come_first(spark):
    old = receipts(spark, ("s1", "control", 10, "a1"))
    new = receipts(spark, ("s1", "control", 1, "b1"), ("s2", "control", 2, "a1"),
                   ("s3", "control", 3, "b3"))
    got = {
        r["source_event_key"]: r["status"]
        for r in ex.validate_assignments(
            new, definitions(spark), predictions(spark), existing=old
        ).collect()
    }
    assert got == {"b1": "duplicate", "a1": "duplicate", "b3": "accepted"}


def test_observations(spark):
    o = obs(
        spark, ("control", 5, 10, T0, "a"), ("control", 6, 10, T0 + timedelta(hours=1), "a"),
        ("control", 11, 10, T0, "b"), ("control", 1, 10, T0 - timedelta(hours=1), "c"),
    )
    got = {
        (r["source_event_key"], r["successes"]): r["status"]
        for r in ex.validate_observations(o, definitions(spark), predictions(spark)).collect()
    }
    assert got == {("a", 5): "accepted", ("a", 6): "duplicate", ("b", 11): "rejected",
                   ("c", 1): "rejected"}


def test_prediction_lock(spark):
    d, p = definitions(spark), predictions(spark)
    check = lambda *a, **k: ex.validate_predictions(*a, **k).first()
    assert check(p, d)["status"] == "locked"
    assert check(p, d, locked=p)["status"] == "already_locked"
    assert check(predictions(spark, p50=0.09), d, locked=p)["reason"] == (
        "already locked and immutable"
    )
    seen = obs(spark, ("control", 1, 10, T0, "a"))
    assert check(p, d, observations=seen)["status"] == "rejected"
    assert check(predictions(spark, p05=0.5), d)["status"] == "rejected"
    assert check(predictions(spark, metric="x"), d)["reason"] == "metric mismatch"
    assert check(predictions(spark, exp="?"), d)["reason"] == "unknown experiment"


def test_definitions_are_checked(spark):
    bad = definitions(spark, treatment_variant="control", name=" ")
    assert {r["message"] for r in ex.validate_experiments(bad).collect()} == {
        "name is required", "control_variant and treatment_variant must differ",
    }


def test_hidden_channel_imbalance(spark):
    rows = [("e", f"m{i}", "control", T0, "c", f"m{i}", "meta", "w1") for i in range(50)] + [
        ("e", f"z{i}", "treatment", T0, "c", f"z{i}", "zalo", "w1") for i in range(50)
    ]
    r = spark.createDataFrame(rows, REC)
    o = obs(spark, ("control", 20, 100, T0, "a"), ("treatment", 28, 100, T0, "b"))
    row = ex.srm_check(definitions(spark), o, r).first()
    assert row["allocation_source"] == "assignment_receipts" and not row["sample_ratio_mismatch"]
    assert row["warnings"] == [
        "sample_ratio_mismatch:channel:meta", "sample_ratio_mismatch:channel:zalo",
    ]
    without = ex.srm_check(definitions(spark, "manual"), o).first()
    assert without["allocation_source"] == "outcome_trials"
    assert without["warnings"] == ["non_randomized_assignment:manual"]
    half = r.withColumn("channel", F.when(F.col("channel") == "meta", "meta"))
    buckets = ex.srm_buckets(definitions(spark), half)
    assert {(b["bucket_type"], b["bucket"]) for b in buckets.collect()} == {
        ("date", "2026-09-20"), ("channel", "meta"), ("cohort", "w1"),
    }


def cards(spark, n, causal, error, coverage, direction):
    return spark.createDataFrame(
        [("m", n, causal, n, error, coverage, direction)],
        "model_artifact_id string, evaluated_experiments long, causal_experiments long, "
        "minimum_sample_experiments long, mean_absolute_effect_error double, "
        "predicted_interval_coverage_rate double, direction_accuracy double",
    )


@pytest.mark.parametrize(
    "args,state",
    [((2, 2, 0.5, 0.1, 0.1), "insufficient_evidence"), ((6, 4, 0.02, 0.9, 0.9), "monitor"),
     ((6, 4, 0.09, 0.5, 0.5), "review_recalibration")],
)
def test_recalibration_states(spark, args, state):
    row = ex.recalibration_assessment(cards(spark, *args)).first()
    assert row["state"] == state and row["human_review_required"]
    assert not row["automatic_retraining_allowed"]


def test_scorecard(spark):
    o = obs(spark, ("control", 20, 100, T0, "a"), ("treatment", 29, 100, T0, "b"))
    done, _ = ex.evaluate_experiment(definitions(spark), predictions(spark), o)
    models = spark.createDataFrame([("m",), ("idle",)], "model_artifact_id string")
    rows = {r["model_artifact_id"]: r for r in ex.model_scorecard(done, models).collect()}
    assert abs(rows["m"]["mean_absolute_effect_error"] - 0.01) < 1e-12
    assert rows["m"]["direction_accuracy"] == 1.0
    assert rows["m"]["warnings"] == ["small_experiment_history: fewer than 5 evaluated experiments"]
    assert rows["idle"]["warnings"] == ["no_evaluated_experiments"]
    scores = forecast.score_models(definitions(spark), predictions(spark), o)
    assert scores.states.first()["state"] == "insufficient_evidence"
    over = ex.experiment_overview(definitions(spark), predictions(spark), o).first()
    assert (over["prediction_locked"], over["observations"], over["trials"]) == (True, 2, 200)


def decisions(spark, *statuses):
    return spark.createDataFrame(
        [("a", i, s, T0, "me", "why") for i, s in enumerate(statuses)],
        "artifact_id string, seq long, status string, decided_at timestamp, decided_by string, "
        "reason string",
    )


def test_governance_log(spark):
    models = spark.createDataFrame([("a", "m"), ("b", "m")], "artifact_id string, model_name string")
    log = decisions(spark, "validated", "approved", "archived")
    assert gov.validate_model_decisions(log, models).count() == 0
    status = {r["artifact_id"]: r["status"] for r in
              gov.current_model_status(models, log.limit(2)).collect()}
    assert status == {"a": "approved", "b": "candidate"}
    bad = decisions(spark, "approved", "candidate", "validated", "validated", "rejected",
                    "approved", "archived", "validated")
    rows = sorted((r["seq"], r["code"]) for r in
                  gov.validate_model_decisions(bad, models).collect())
    assert rows == [(0, "invalid_transition"), (1, "explicit_candidate"),
                    (3, "invalid_transition"), (5, "invalid_transition"),
                    (7, "invalid_transition")]
    unknown = gov.validate_model_decisions(log, models.where("artifact_id = 'b'"))
    assert {r["code"] for r in unknown.collect()} == {"unregistered_artifact"}


def test_register_artifacts(spark):
    schema = "artifact_id string, created_at timestamp, model_name string, parameters map<string,double>"
    old = spark.createDataFrame([("a", T0, "m", {"x": 1.0}), ("b", T0, "m", {"x": 1.0})], schema)
    new = spark.createDataFrame(
        [("a", T0 + timedelta(days=1), "m", {"x": 1.0}), ("b", T0, "m", {"x": 2.0}),
         ("c", T0, "m", {"x": 3.0})], schema,
    )
    got = {r["artifact_id"]: r["status"] for r in gov.register_artifacts(new, old).collect()}
    assert got == {"a": "already_registered", "b": "conflict", "c": "registered"}


EV = ("event_type string, entity_type string, entity_id string, source_id string, "
      "payload map<string,string>")


def test_audit_of_poor_and_ready_evidence(spark):
    poor = spark.createDataFrame(
        [("qualification_observed", "household", "h", "crm", {"purchase_purpose": "own_stay"})], EV
    )
    row = audit.readiness_audit(poor).first()
    assert not row["training_ready"] and "no_verified_decision_outcomes" in row["blockers"]
    assert "readiness_missing:price" in row["blockers"]
    rows = []
    for i in range(30):
        rows += [
            ("qualification_observed", "household", f"h{i}", "crm",
             {"workplace_zone": "Z", "purchase_purpose": "own_stay"}),
            ("reason_observed", "household", f"h{i}", "crm", {"reason_code": "price"}),
            ("decision_outcome_verified", "household", f"h{i}", "erp",
             {"outside_option": "postponed", "verified": "true"}),
        ]
    rows += [("unit_inventory_observed", "unit", "u", "inv", {}),
             ("offer_observed", "unit", "u", "inv",
              {"list_price_vnd": "1", "payment_plan_code": "P"})]
    row = audit.readiness_audit(spark.createDataFrame(rows, EV)).first()
    assert row["training_ready"] and row["trainable_choice_events"] == 30
    assert row["blockers"] == [] and row["warnings"] == [] and row["households"] == 30
    cover = {r["field"]: r["rate"] for r in
             audit.coverage(spark.createDataFrame(rows, EV)).collect()}
    assert cover["workplace_zone"] == cover["reason"] == cover["outside_option"] == 1.0
    assert cover["purchase_horizon"] == 0.0 and len(cover) == 14


def test_refused_decisions_do_not_change_a_status(spark):
    models = spark.createDataFrame([("a", "m")], "artifact_id string, model_name string")
    log = decisions(spark, "archived", "approved")
    row = gov.current_model_status(models, log).first()
    assert (row["status"], row["last_seq"]) == ("archived", 0)


def test_one_forecast_of_an_experiment_locks(spark):
    first = predictions(spark)
    second = first.withColumn("ensemble_samples", F.col("ensemble_samples") + 1).withColumn(
        "created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    again = first.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 2 HOURS"))
    batch = first.unionByName(second).unionByName(again)
    got = ex.validate_predictions(batch, definitions(spark)).orderBy("created_at").collect()
    assert [r["status"] for r in got] == ["locked", "rejected", "already_locked"]
