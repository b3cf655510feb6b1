"""Decisions -> examples -> fit -> diagnostics -> model artifact."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.hashing import ANALYTICS_NAMESPACE, uuid5
from hearthline.operators.choices import attach_choice_sets, outcome_decisions, set_commute
from hearthline.operators.features import (
    asof_features, feature_columns, with_commute, with_household,
)
from hearthline.operators.governance import artifact_content_hash
from hearthline.operators.logit import (
    bootstrap_fit, coefficient_intervals, fit_warnings, logit_fit, parameter_frame,
    training_sets,
)
from hearthline.operators.population import PopulationFit, population_fit
from hearthline.operators.quality import gate
from hearthline.operators.temporal import first_n_predicate
from hearthline.operators.utility import (
    log_loss, segment_metrics, uniform_baseline, vector_probabilities,
)
from hearthline.schemas import HOUSEHOLD_FIELDS, OUTCOME_EVENT_TYPES
from hearthline.plans.snapshot import read_frozen, verify_dataset
from hearthline.session import stored


# the workplace among the as-of features
ORIGIN = "origin_anchor"


def build_examples(
    events: DataFrame,
    units: DataFrame,
    offers: DataFrame,
    *,
    travel: DataFrame | None = None,
    project: Column | None = None,
    destination: Column | None = None,
    verified_only: bool = True,
    outcome_types: Sequence[str] = OUTCOME_EVENT_TYPES,
    horizon=None,
) -> tuple[DataFrame, DataFrame]:
    """(examples with typed household columns, `alts`, `chosen`; violations).

    As-of features and the workplace ride on the narrow decision rows in one pass; the wide sets join last. The
    narrow tables are stored, because each of them is read by several later steps.
    """
    if project is None:  # no project key: all units are open to every decision
        units = units.withColumn("project_id", F.lit("default"))
    decisions = stored(
        outcome_decisions(
            events, project=project, verified_only=verified_only, outcome_types=outcome_types
        )
    )
    if travel is None:
        known = stored(with_household(asof_features(decisions, feature_columns(events, HOUSEHOLD_FIELDS))))
    else:
        place = destination if destination is not None else F.col("project_id")
        wide = asof_features(decisions, feature_columns(events, HOUSEHOLD_FIELDS, anchor=ORIGIN))
        placed = stored(with_household(
            wide.withColumns({"origin_anchor_id": F.col(f"f_{ORIGIN}.value"), "destination_anchor_id": place})
        ))
        known = with_commute(placed, travel, horizon=horizon).drop("origin_anchor_id", "destination_anchor_id")
    good, violations = attach_choice_sets(known, units, offers, horizon=horizon)
    if travel is not None:
        good = set_commute(good, F.col("commute_min")).drop("commute_min")
    return good, violations


def holdout_size(examples: int, fraction: float) -> int:
    """Rows in the holdout: half-even rounding, at least one, and one left to train on."""
    if not 0 < fraction < 1:
        raise ValueError("holdout fraction must be between 0 and 1")
    if examples < 2:
        raise ValueError("temporal holdout requires at least two examples")
    return examples - max(1, examples - max(1, round(examples * fraction)))


def temporal_holdout(
    examples: DataFrame, *, time: str = "as_of", tie: str = "decision_id", fraction: float = 0.2
) -> DataFrame:
    """Examples with `split`: the last part by time is "holdout", the rest "train"."""
    narrow = examples.select(time, tie)
    n = narrow.count()
    train = n - holdout_size(n, fraction)
    first = first_n_predicate(narrow, ts=time, row_id=tie, n=train)
    return examples.withColumn("split", F.when(first, "train").otherwise("holdout"))


@dataclass
class Calibration:
    artifact: DataFrame
    weights: dict[str, float]
    samples: list[dict[str, float]]
    intervals: DataFrame
    segments: DataFrame
    historical_choices: int
    train_examples: int
    holdout_examples: int
    train_metrics: dict[str, float]
    holdout_metrics: dict[str, float]
    warnings: list[str]


def _metrics(scored: DataFrame) -> dict[str, float]:
    return {k: float(v) for k, v in log_loss(scored).first().asDict().items()}


def calibrate(
    examples: DataFrame,
    *,
    model_name: str,
    model_version: str,
    code_version: str,
    dataset_snapshot_id: str,
    holdout_fraction: float = 0.2,
    bootstrap_samples: int = 100,
    bootstrap_scheme: str = "poisson",
    seed: int = 42,
    feature_schema_version: str = "decision-features-v1",
    created_at: datetime | None = None,
) -> Calibration:
    """Fit on the earlier examples, check on the later ones, bootstrap the weights."""
    if bootstrap_samples <= 0:
        raise ValueError("bootstrap_samples must be positive")
    spark = examples.sparkSession
    # feature vectors alone are kept, and read by every pass; the alternatives are several times as wide
    rows = stored(training_sets(examples, keep=["as_of", "purchase_purpose"]))
    marked = temporal_holdout(rows, tie="set_id", fraction=holdout_fraction)
    train, holdout = (marked.where(F.col("split") == s).drop("split") for s in ("train", "holdout"))
    sets = train
    fit = logit_fit(sets)
    samples = bootstrap_fit(
        sets, replicates=bootstrap_samples, seed=seed, scheme=bootstrap_scheme, init=fit.weights
    )
    scored = vector_probabilities(holdout, fit.weights)
    train_metrics = _metrics(vector_probabilities(train, fit.weights))
    base = uniform_baseline(scored).first()
    holdout_metrics = _metrics(scored) | {
        "uniform_log_loss": base["uniform_log_loss"], "improvement_pct": base["improvement_pct"],
    }
    segments = segment_metrics(scored)
    intervals = coefficient_intervals(parameter_frame(spark, samples), fit.weights)
    span = train.agg(F.min("as_of").alias("a"), F.max("as_of").alias("b")).first()
    n_train, n_holdout = int(train_metrics["examples"]), int(holdout_metrics["examples"])
    warnings = fit_warnings(
        fit_examples=n_train, holdout_examples=n_holdout,
        segments={r["segment"]: r["examples"] for r in segments.collect()},
        uncertain=[r["feature"] for r in intervals.where("crosses_zero").collect()],
    )
    body = [
        (
            model_name, model_version, "multinomial_logit", code_version, dataset_snapshot_id,
            span["a"], span["b"], feature_schema_version, fit.weights, train_metrics,
            holdout_metrics, samples, warnings, created_at or datetime.now(timezone.utc),
        )
    ]
    artifact = spark.createDataFrame(
        body,
        "model_name string, model_version string, model_family string, code_version string, "
        "dataset_snapshot_id string, training_window_start timestamp, "
        "training_window_end timestamp, feature_schema_version string, "
        "parameters map<string,double>, train_metrics map<string,double>, "
        "holdout_metrics map<string,double>, bootstrap_samples array<map<string,double>>, "
        "warnings array<string>, created_at timestamp",
    ).drop("bootstrap_samples").withColumn("bootstrap_samples", F.lit(json.dumps(samples)))
    artifact = artifact.withColumn("content_hash", artifact_content_hash(artifact)).withColumn(
        "artifact_id",
        uuid5(F.concat(F.lit("artifact:"), F.col("content_hash")), ANALYTICS_NAMESPACE),
    )
    return Calibration(
        artifact, fit.weights, samples, intervals, segments, n_train + n_holdout, n_train,
        n_holdout, train_metrics, holdout_metrics, warnings,
    )


def run_id(payload: dict) -> str:
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(text.encode("utf-8")).hexdigest()


@dataclass
class CalibrationRun:
    run_id: str
    dataset_snapshot_id: str
    calibration: Calibration
    population: PopulationFit
    manifest: DataFrame


def calibration_run(
    spark: SparkSession,
    snapshot_path: str,
    *,
    code_version: str,
    model_name: str = "buyer-choice",
    model_version: str = "calibration-001",
    project: Column | None = None,
    destination: Column | None = None,
    holdout_fraction: float = 0.2,
    bootstrap_samples: int = 100,
    seed: int = 42,
    minimum_confidence: float = 0.3,
    diagnostic_size: int = 5000,
    minimum_choices: int = 30,
    fail_closed: bool = True,
) -> CalibrationRun:
    """Verify a frozen dataset, pass its gates, fit population and model, return the run."""
    if not code_version.strip():
        raise ValueError("code_version is required")
    manifest = verify_dataset(spark, snapshot_path).first()
    if not manifest["training_ready"]:
        raise ValueError(f"snapshot is not training-ready: {', '.join(manifest['blockers'])}")
    events = read_frozen(spark, snapshot_path, "events")
    units = read_frozen(spark, snapshot_path, "unit_versions")
    offers = read_frozen(spark, snapshot_path, "offers")
    travel = (
        read_frozen(spark, snapshot_path, "travel_times")
        if "travel_times" in manifest["input_digests"] else None
    )
    people = population_fit(
        events, name=f"snapshot-{manifest['snapshot_version']}", as_of=manifest["window_to"],
        minimum_confidence=minimum_confidence, diagnostic_size=diagnostic_size, seed=seed,
    )
    examples, violations = build_examples(
        events, units, offers, travel=travel, project=project, destination=destination
    )
    if fail_closed:
        gate(violations)
    result = calibrate(
        examples, model_name=model_name, model_version=model_version, code_version=code_version,
        dataset_snapshot_id=manifest["dataset_snapshot_id"], holdout_fraction=holdout_fraction,
        bootstrap_samples=bootstrap_samples, seed=seed,
    )
    if result.historical_choices < minimum_choices:
        raise ValueError(
            f"fewer historical choices than required: {result.historical_choices} < "
            f"{minimum_choices}"
        )
    identity = run_id(
        {
            "dataset_snapshot_id": manifest["dataset_snapshot_id"],
            "code_version": code_version, "holdout_fraction": holdout_fraction,
            "bootstrap_samples": bootstrap_samples, "seed": seed,
            "minimum_confidence": minimum_confidence, "diagnostic_size": diagnostic_size,
            "model_name": model_name, "model_version": model_version, "run_version": "002",
        }
    )
    art = result.artifact.first()
    frame = spark.createDataFrame(
        [
            (
                identity, manifest["dataset_snapshot_id"], code_version, art["artifact_id"],
                art["content_hash"], "candidate", people.population.version,
                people.population.content_hash, result.historical_choices,
                result.train_examples, result.holdout_examples, result.train_metrics,
                result.holdout_metrics, people.population.warnings,
            )
        ],
        "run_id string, dataset_snapshot_id string, code_version string, "
        "model_artifact_id string, model_content_hash string, model_status string, "
        "population_version string, population_content_hash string, historical_choices long, "
        "train_examples long, holdout_examples long, train_metrics map<string,double>, "
        "holdout_metrics map<string,double>, warnings array<string>",
    )
    return CalibrationRun(identity, manifest["dataset_snapshot_id"], result, people, frame)
