"""Forecasting an experiment and scoring models against what was observed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.experiments import (
    RecalibrationPolicy, evaluate_experiment, model_scorecard, recalibration_assessment,
    validate_predictions,
)
from hearthline.operators.scenarios import (
    Scenario, expected_mass, scenario_compare, scenario_picks, unit_share,
)
from hearthline.session import stored


class NotApproved(ValueError):
    """Scoring was asked of a model without approval."""


@dataclass(frozen=True)
class Model:
    """What scoring needs to know of a registered model."""

    artifact_id: str
    status: str
    dataset_snapshot_id: str
    weights: Mapping[str, float]
    samples: Sequence[Mapping[str, float]]
    warnings: tuple[str, ...] = ()


def _require_approval(model: Model, allow_unapproved: bool) -> tuple[str, ...]:
    if model.status != "approved" and not allow_unapproved:
        raise NotApproved("scoring requires an approved model")
    if not model.samples:
        raise ValueError("the model has no bootstrap parameter samples")
    extra = () if model.status == "approved" else (f"unapproved_model:{model.status}",)
    return tuple(dict.fromkeys((*model.warnings, *extra)))


def compare_scenarios(
    model: Model,
    population: DataFrame,
    sets: DataFrame,
    *,
    control: Scenario,
    treatment: Scenario,
    replications: int = 1,
    seed: int = 42,
    mode: str = "sampled",
    allow_unapproved: bool = False,
) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(summaries, point estimates, warnings): both scenarios for every bootstrap vector, with
    the same draws, and once more for the central weights (parameter -1)."""
    warnings = _require_approval(model, allow_unapproved)
    vectors = (model.weights, *model.samples)
    if mode == "expected":  # read twice below, a few rows
        picks = stored(expected_mass(population, sets, (control, treatment), vectors, first_parameter=-1))
    else:
        picks = scenario_picks(
            population, sets, (control, treatment), vectors,
            replications=replications, seed=seed, mode=mode, first_parameter=-1,
        )
    summary = scenario_compare(
        picks.where(F.col("parameter") >= 0), control=control.scenario_id,
        treatment=treatment.scenario_id,
    )
    point = unit_share(
        picks.where((F.col("parameter") == -1) & (F.col("replication") == 0))
    ).select("scenario_id", "unit_share")
    return summary, point, warnings


def prediction_from_comparison(
    definition: DataFrame,
    model: Model,
    summary: DataFrame,
    point: DataFrame,
    *,
    control: str,
    treatment: str,
    population_version: str,
    created_at,
) -> DataFrame:
    """The one-row forecast of an experiment from a scenario comparison."""
    def at(measure: str, name: str):
        return F.max(F.when(F.col("measure") == measure, F.col(name)))

    effect = summary.agg(
        at("effect", "mean").alias("effect_mean"), at("effect", "p05").alias("effect_p05"),
        at("effect", "p50").alias("effect_p50"), at("effect", "p95").alias("effect_p95"),
        at("effect", "samples").alias("ensemble_samples"),
    ).first()
    shares = {r["scenario_id"]: r["unit_share"] for r in point.collect()}
    return definition.select("experiment_id", "metric_name").withColumns(
        {
            "model_artifact_id": F.lit(model.artifact_id),
            "model_status": F.lit(model.status),
            "population_version": F.lit(population_version),
            "control_scenario_id": F.lit(control),
            "treatment_scenario_id": F.lit(treatment),
            "control_point_estimate": F.lit(float(shares[control])),
            "treatment_point_estimate": F.lit(float(shares[treatment])),
            **{k: F.lit(v) for k, v in effect.asDict().items()},
            "source_snapshot_id": F.lit(model.dataset_snapshot_id),
            "created_at": F.lit(created_at).cast("timestamp"),
        }
    )


def forecast_experiment(
    definition: DataFrame,
    model: Model,
    population: DataFrame,
    sets: DataFrame,
    *,
    dataset_snapshot_id: str,
    population_snapshot_id: str,
    population_version: str,
    created_at,
    control: Scenario,
    treatment: Scenario,
    locked: DataFrame | None = None,
    assignments: DataFrame | None = None,
    observations: DataFrame | None = None,
    replications: int = 1,
    seed: int = 42,
    mode: str = "sampled",
    allow_unapproved: bool = False,
) -> DataFrame:
    """Check the lineage, compare the scenarios and judge the resulting lock (status, reason)."""
    if model.dataset_snapshot_id != dataset_snapshot_id:
        raise ValueError("the model was calibrated on a different dataset snapshot")
    if population_snapshot_id != dataset_snapshot_id:
        raise ValueError("the population was fitted from a different dataset snapshot")
    summary, point, _ = compare_scenarios(
        model, population, sets, control=control, treatment=treatment,
        replications=replications, seed=seed, mode=mode, allow_unapproved=allow_unapproved,
    )
    prediction = prediction_from_comparison(
        definition, model, summary, point, control=control.scenario_id,
        treatment=treatment.scenario_id, population_version=population_version,
        created_at=created_at,
    )
    return validate_predictions(
        prediction, definition, locked=locked, assignments=assignments,
        observations=observations,
    )


@dataclass
class ModelScores:
    evaluations: DataFrame
    pending: DataFrame
    scorecards: DataFrame
    states: DataFrame


def score_models(
    definitions: DataFrame,
    predictions: DataFrame,
    observations: DataFrame,
    *,
    models: DataFrame | None = None,
    policy: RecalibrationPolicy | None = None,
) -> ModelScores:
    """Evaluate every locked experiment, then one scorecard and one state per model."""
    evaluated, pending = evaluate_experiment(definitions, predictions, observations)
    cards = model_scorecard(evaluated, models)
    return ModelScores(evaluated, pending, cards, recalibration_assessment(cards, policy))
