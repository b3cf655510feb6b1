"""Experiments: validation, allocation checks, evaluation and model scorecards.

Every operator handles all experiments in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.parsing import filled
from hearthline.schemas import ASSIGNMENT_METHODS, CAUSAL_METHODS
from hearthline.session import cut_lineage


def _first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first violated check, null if none."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks])


def validate_experiments(definitions: DataFrame) -> DataFrame:
    """Violations (experiment_id, code, message, severity) of experiment definitions."""
    checks = [
        *[
            (f"{c} is required", ~filled(F.trim(c)))
            for c in ("name", "hypothesis", "metric_name", "control_variant",
                      "treatment_variant", "created_by")
        ],
        ("control_variant and treatment_variant must differ",
         F.col("control_variant") == F.col("treatment_variant")),
        ("planned_start_at must be before planned_end_at",
         F.col("planned_start_at") >= F.col("planned_end_at")),
        ("minimum_trials_per_variant must be positive",
         F.col("minimum_trials_per_variant") <= 0),
        ("unknown assignment_method", ~F.col("assignment_method").isin(*ASSIGNMENT_METHODS)),
    ]
    hits = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for m, bad in checks])
    )
    return definitions.select(
        "experiment_id", F.lit("invalid_experiment").alias("code"),
        F.explode(hits).alias("message"), F.lit("error").alias("severity"),
    )


PREDICTION_VALUES = (
    "experiment_id", "model_artifact_id", "metric_name", "control_point_estimate",
    "treatment_point_estimate", "effect_mean", "effect_p05", "effect_p50", "effect_p95",
    "ensemble_samples",
)


def validate_predictions(
    new: DataFrame,
    definitions: DataFrame,
    *,
    locked: DataFrame | None = None,
    assignments: DataFrame | None = None,
    observations: DataFrame | None = None,
) -> DataFrame:
    """Predictions with `status` (locked / already_locked / rejected) and `reason`.

    A forecast can only be locked for a known experiment, for its metric, before any receipt or
    observation, and never be replaced by a different one. Within a batch the earliest valid
    forecast of an experiment is the one that locks.
    """
    c = F.col
    rows = new.join(
        definitions.select("experiment_id", c("metric_name").alias("_metric")), "experiment_id",
        "left",
    )
    for name, data in (("_assigned", assignments), ("_observed", observations)):
        if data is None:
            rows = rows.withColumn(name, F.lit(None).cast("boolean"))
        else:
            seen = data.select("experiment_id").distinct().withColumn(name, F.lit(True))
            rows = rows.join(seen, "experiment_id", "left")
    mark = F.to_json(F.struct(*[x for x in PREDICTION_VALUES if x in new.columns]))
    rows = rows.withColumn("_mark", mark)
    if locked is None:
        rows = rows.withColumn("_locked", F.lit(None).cast("string"))
    else:
        rows = rows.join(locked.select("experiment_id", mark.alias("_locked")), "experiment_id",
                         "left")

    def outside(name: str, low: float) -> Column:
        return (c(name) < low) | (c(name) > 1)

    reason = _first_reason(
        [
            ("effect quantiles must satisfy p05 <= p50 <= p95",
             (c("effect_p05") > c("effect_p50")) | (c("effect_p50") > c("effect_p95"))),
            ("point estimate out of range",
             outside("control_point_estimate", 0) | outside("treatment_point_estimate", 0)),
            ("effect out of range",
             outside("effect_mean", -1) | outside("effect_p05", -1) | outside("effect_p50", -1)
             | outside("effect_p95", -1)),
            ("ensemble_samples must be positive", c("ensemble_samples") <= 0),
            ("unknown experiment", c("_metric").isNull()),
            ("metric mismatch", c("metric_name") != c("_metric")),
            ("first observation or assignment precedes the lock",
             c("_assigned").isNotNull() | c("_observed").isNotNull()),
            ("already locked and immutable",
             c("_locked").isNotNull() & (c("_locked") != c("_mark"))),
        ]
    )
    rows = rows.withColumn("reason", reason)
    when = c("created_at") if "created_at" in new.columns else F.lit(None).cast("timestamp")
    entry = F.struct(when.alias("at"), c("_mark").alias("mark"))
    first = rows.where(c("reason").isNull()).groupBy("experiment_id").agg(F.min(entry).alias("_first"))
    rows = rows.join(first, "experiment_id", "left")
    late = c("reason").isNull() & (c("_first.mark") != c("_mark"))
    return rows.withColumn(
        "reason", F.when(late, "already locked and immutable").otherwise(c("reason"))
    ).withColumn(
        "status",
        F.when(c("reason").isNotNull(), "rejected")
        .when(c("_locked").isNotNull() | (c("_first") != entry), "already_locked")
        .otherwise("locked"),
    ).select(*new.columns, "status", "reason")


def _with_rules(new: DataFrame, definitions: DataFrame, predictions: DataFrame) -> DataFrame:
    rules = definitions.select(
        "experiment_id", F.lit(True).alias("_known"), F.col("metric_name").alias("_metric"),
        F.array("control_variant", "treatment_variant").alias("_variants"),
        F.col("planned_start_at").alias("_from"), F.col("planned_end_at").alias("_to"),
    )
    locks = predictions.groupBy("experiment_id").agg(F.min("created_at").alias("_locked_at"))
    return new.join(rules, "experiment_id", "left").join(locks, "experiment_id", "left")


def _accepted_first(valid: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Orders (`_ord`) of the rows an append-in-order log would accept, when a row is refused as
    soon as an earlier accepted row shares one of the key groups.

    A row that comes first in all of its groups is surely accepted and settles everyone else in
    those groups; the rest goes to the next round. One round is the rule, more are only needed
    for keys that cross. Every round settles at least the earliest open row, so it ends.
    """
    taken: DataFrame | None = None
    open_rows = valid
    while True:
        first = open_rows
        for i, group in enumerate(groups):
            best = open_rows.groupBy(*group).agg(F.min("_ord").alias(f"_min{i}"))
            first = first.join(best, list(group))
        winners = first
        for i in range(len(groups)):
            winners = winners.where(F.col("_ord") == F.col(f"_min{i}"))
        winners = winners.select(*valid.columns)
        if len(groups) > 1:
            winners = cut_lineage(winners)
        taken = winners if taken is None else taken.unionByName(winners)
        if len(groups) == 1:
            return taken
        rest = open_rows
        for group in groups:
            rest = rest.join(winners.select(*group).distinct(), list(group), "left_anti")
        open_rows = cut_lineage(rest)
        if open_rows.isEmpty():
            return taken


ASSIGNMENT_KEY = ("experiment_id", "source_id", "source_event_key")
SUBJECT_KEY = ("experiment_id", "subject_key")


def validate_assignments(
    new: DataFrame,
    definitions: DataFrame,
    predictions: DataFrame,
    *,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Receipts with `status` (accepted / duplicate / rejected) and `reason`.

    Receipts count in order of (assigned_at, source_id, source_event_key); already stored ones
    come before all new ones.
    """
    c = F.col
    ord_new = F.struct(
        F.lit(1).alias("g"), "assigned_at", "source_id", "source_event_key", "subject_key",
        "variant",
    )
    rows = _with_rules(new.withColumn("_ord", ord_new), definitions, predictions)
    blank = F.lit(False)
    for name in ("subject_key", "variant", "source_id", "source_event_key"):
        blank = blank | ~filled(F.trim(name))
    for name in ("channel", "cohort"):
        if name in new.columns:
            blank = blank | (F.length(F.trim(name)) == 0)
    rows = rows.withColumn(
        "_reason",
        _first_reason(
            [
                ("missing required text", blank),
                ("unknown experiment", c("_known").isNull()),
                ("no locked prediction", c("_locked_at").isNull()),
                ("predates the locked prediction", c("assigned_at") < c("_locked_at")),
                ("unknown variant", ~F.array_contains("_variants", c("variant"))),
                ("before planned start", c("assigned_at") < c("_from")),
                ("after planned end", c("assigned_at") >= c("_to")),
            ]
        ),
    )
    keys = ["experiment_id", "source_id", "source_event_key", "subject_key", "variant", "_ord"]
    valid = rows.where(c("_reason").isNull()).select(*keys).distinct()
    if existing is not None:
        ord_old = F.struct(
            F.lit(0).alias("g"), "assigned_at", "source_id", "source_event_key", "subject_key",
            "variant",
        )
        stored = existing.withColumn("_ord", ord_old).select(*keys)
        open_rows = valid
        for group in (ASSIGNMENT_KEY, SUBJECT_KEY):
            open_rows = open_rows.join(stored.select(*group).distinct(), list(group), "left_anti")
        taken = stored.unionByName(_accepted_first(open_rows, (ASSIGNMENT_KEY, SUBJECT_KEY)))
    else:
        taken = _accepted_first(valid, (ASSIGNMENT_KEY, SUBJECT_KEY))
    by_key = taken.groupBy(*ASSIGNMENT_KEY).agg(F.min("_ord").alias("_key_ord"))
    by_subject = taken.groupBy(*SUBJECT_KEY).agg(
        F.min("_ord").alias("_sub_ord"), F.min_by("variant", "_ord").alias("_sub_variant")
    )
    # byte-for-byte copies share an order; only one of them is the accepted row
    copies = rows.groupBy(*new.columns, "_ord", "_reason").agg(F.count(F.lit(1)).alias("_n"))
    judged = copies.join(by_key, list(ASSIGNMENT_KEY), "left").join(
        by_subject, list(SUBJECT_KEY), "left"
    )
    accepted = c("_reason").isNull() & (c("_ord") == c("_key_ord"))
    judged = judged.withColumn(
        "status",
        F.when(c("_reason").isNotNull(), "rejected")
        .when(F.coalesce(accepted, F.lit(False)), "accepted")
        .when(c("_key_ord") < c("_ord"), "duplicate")
        .when(c("_sub_variant") == c("variant"), "duplicate")
        .otherwise("rejected"),
    ).withColumn(
        "reason",
        F.when(c("_reason").isNotNull(), c("_reason"))
        .when(c("status") == "accepted", F.lit(None))
        .when(c("_key_ord") < c("_ord"), "source key already recorded")
        .when(c("status") == "duplicate", "subject already assigned")
        .otherwise("subject assigned to a conflicting variant"),
    )
    same = judged.withColumn("_i", F.explode(F.sequence(F.lit(1), c("_n").cast("int"))))
    again = (c("status") == "accepted") & (c("_i") > 1)
    return same.select(
        *new.columns,
        F.when(again, "duplicate").otherwise(c("status")).alias("status"),
        F.when(again, "source key already recorded").otherwise(c("reason")).alias("reason"),
    )


def validate_observations(
    new: DataFrame,
    definitions: DataFrame,
    predictions: DataFrame,
    *,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Observations with `status` (accepted / duplicate / rejected) and `reason`."""
    c = F.col
    key = ["experiment_id", "source_id", "source_event_key"]
    ord_new = F.struct(
        "observed_at", "source_id", "source_event_key", "variant", "successes", "trials"
    )
    rows = _with_rules(new.withColumn("_ord", ord_new), definitions, predictions)
    blank = F.lit(False)
    for name in ("variant", "metric_name", "source_id", "source_event_key"):
        blank = blank | ~filled(F.trim(name))
    rows = rows.withColumn(
        "_reason",
        _first_reason(
            [
                ("missing required text", blank),
                ("counts out of range", (c("successes") < 0) | (c("trials") <= 0)),
                ("successes exceed trials", c("successes") > c("trials")),
                ("unknown experiment", c("_known").isNull()),
                ("no locked prediction", c("_locked_at").isNull()),
                ("predates the locked prediction", c("observed_at") < c("_locked_at")),
                ("metric mismatch", c("metric_name") != c("_metric")),
                ("unknown variant", ~F.array_contains("_variants", c("variant"))),
                ("before planned start", c("observed_at") < c("_from")),
            ]
        ),
    )
    first = rows.where(c("_reason").isNull()).groupBy(*key).agg(F.min("_ord").alias("_first"))
    copies = rows.groupBy(*new.columns, "_ord", "_reason").agg(F.count(F.lit(1)).alias("_n"))
    judged = copies.join(first, key, "left")
    if existing is None:
        judged = judged.withColumn("_stored", F.lit(False))
    else:
        stored = existing.select(*key).distinct().withColumn("_stored", F.lit(True))
        judged = judged.join(stored, key, "left")
    each = judged.withColumn("_i", F.explode(F.sequence(F.lit(1), c("_n").cast("int"))))
    fresh = (c("_ord") == c("_first")) & (c("_i") == 1) & ~F.coalesce("_stored", F.lit(False))
    return each.select(
        *new.columns,
        F.when(c("_reason").isNotNull(), "rejected").when(fresh, "accepted")
        .otherwise("duplicate").alias("status"),
        F.when(c("_reason").isNotNull(), c("_reason"))
        .when(~fresh, "source key already recorded").alias("reason"),
    )


def variant_aggregate(observations: DataFrame) -> DataFrame:
    """Successes, trials and rate per experiment and variant."""
    return observations.groupBy("experiment_id", "variant").agg(
        F.sum("successes").alias("successes"), F.sum("trials").alias("trials")
    ).withColumn(
        "rate",
        F.when(F.col("trials") > 0, F.col("successes") / F.col("trials")).otherwise(0.0),
    )


def _arms(definitions: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per definition with the totals of both arms (zero where nothing was observed)."""
    totals = variant_aggregate(observations)
    arms = definitions
    for arm in ("control", "treatment"):
        side = totals.select(
            "experiment_id", F.col("variant").alias(f"{arm}_variant"),
            F.col("successes").alias(f"{arm}_successes"), F.col("trials").alias(f"{arm}_trials"),
        )
        arms = arms.join(side, ["experiment_id", f"{arm}_variant"], "left").fillna(
            0, [f"{arm}_successes", f"{arm}_trials"]
        ).withColumn(
            f"{arm}_rate",
            F.when(
                F.col(f"{arm}_trials") > 0,
                F.col(f"{arm}_successes") / F.col(f"{arm}_trials"),
            ).otherwise(0.0),
        )
    return arms


def effect_ci95() -> tuple[Column, Column, Column]:
    """(effect, low, high) of the difference in rates between the arm columns."""
    c = F.col
    effect = c("treatment_rate") - c("control_rate")

    def spread(arm: str) -> Column:
        return c(f"{arm}_rate") * (1 - c(f"{arm}_rate")) / c(f"{arm}_trials")

    both = (c("control_trials") > 0) & (c("treatment_trials") > 0)
    margin = F.when(
        both,
        F.lit(1.96) * F.sqrt(F.greatest(spread("control") + spread("treatment"), F.lit(0.0))),
    )
    return (
        effect,
        F.when(both, F.greatest(effect - margin, F.lit(-1.0))).otherwise(effect),
        F.when(both, F.least(effect + margin, F.lit(1.0))).otherwise(effect),
    )


def direction_sign(value: Column, tolerance: float = 1e-12) -> Column:
    return F.when(value > tolerance, 1).when(value < -tolerance, -1).otherwise(0)


def _causal() -> Column:
    return F.col("assignment_method").isin(*CAUSAL_METHODS)


def _enough() -> Column:
    need = F.col("minimum_trials_per_variant")
    return (F.col("control_trials") >= need) & (F.col("treatment_trials") >= need)


def evaluate_experiment(
    definitions: DataFrame, predictions: DataFrame, observations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(evaluated, pending): observed against predicted effect for every locked experiment.

    Pending are those with a missing arm or a forecast for another metric.
    """
    c = F.col
    locked = predictions.select(
        "experiment_id", "model_artifact_id", c("metric_name").alias("_metric"),
        "effect_p05", "effect_p50", "effect_p95",
    )
    rows = _arms(definitions, observations).join(locked, "experiment_id")
    ready = (c("control_trials") > 0) & (c("treatment_trials") > 0)
    same_metric = c("metric_name") == c("_metric")
    effect, low, high = effect_ci95()
    done = rows.where(ready & same_metric).withColumns(
        {"observed_effect": effect, "ci95_low": low, "ci95_high": high}
    ).withColumns(
        {
            "absolute_error": F.abs(c("observed_effect") - c("effect_p50")),
            "within_interval": c("observed_effect").between(c("effect_p05"), c("effect_p95")),
            "direction_correct": direction_sign(c("observed_effect"))
            == direction_sign(c("effect_p50")),
            "causal_allowed": _causal(),
            "minimum_sample_reached": _enough(),
        }
    )
    warnings = F.array_compact(
        F.array(
            F.when(~c("minimum_sample_reached"), F.lit("minimum_sample_not_reached")),
            F.when(
                ~c("causal_allowed"),
                F.concat(
                    F.lit("non_randomized_assignment:"), c("assignment_method"),
                    F.lit(": effect is associative, not causal"),
                ),
            ),
            F.when(
                (c("ci95_low") <= 0) & (c("ci95_high") >= 0),
                F.lit("observed_effect_ci_crosses_zero"),
            ),
            F.when(
                ~c("within_interval"), F.lit("observed_effect_outside_predicted_interval")
            ),
        )
    )
    evaluated = done.select(
        "experiment_id", "model_artifact_id", "metric_name", "control_successes",
        "control_trials", "control_rate", "treatment_successes", "treatment_trials",
        "treatment_rate", "observed_effect", "ci95_low", "ci95_high", "effect_p05", "effect_p50",
        "effect_p95", "absolute_error", "within_interval", "direction_correct",
        "causal_allowed", "minimum_sample_reached", warnings.alias("warnings"),
    )
    pending = rows.where(~(ready & same_metric)).select(
        "experiment_id", "model_artifact_id",
        F.when(~same_metric, "metric_mismatch").otherwise("missing_observations").alias("reason"),
    )
    return evaluated, pending


def _allocation(control: Column, treatment: Column, share: float, z: float) -> dict[str, Column]:
    total = control + treatment
    variance = total * F.lit(share * (1 - share))
    score = F.when(
        variance > 0, (treatment - total * F.lit(share)) / F.sqrt(variance)
    ).otherwise(0.0)
    return {
        "total_assignments": total,
        "observed_treatment_share": F.when(total > 0, treatment / total).otherwise(0.0),
        "sample_ratio_zscore": score,
        "sample_ratio_mismatch": F.abs(score) >= z,
    }


def srm_buckets(
    definitions: DataFrame, assignments: DataFrame, *, share: float = 0.5, z: float = 3.29
) -> DataFrame:
    """Allocation check per experiment and date, channel or cohort; a missing channel or cohort
    is skipped."""
    pairs = F.array(
        F.struct(
            F.lit("date").alias("bucket_type"),
            F.date_format("assigned_at", "yyyy-MM-dd").alias("bucket"),
        ),
        F.struct(F.lit("channel").alias("bucket_type"), F.col("channel").alias("bucket")),
        F.struct(F.lit("cohort").alias("bucket_type"), F.col("cohort").alias("bucket")),
    )
    counts = assignments.select("experiment_id", "variant", F.inline(pairs)).where(
        F.col("bucket").isNotNull()
    ).groupBy("experiment_id", "variant", "bucket_type", "bucket").agg(
        F.count(F.lit(1)).alias("n")
    )
    named = counts.join(
        definitions.select("experiment_id", "control_variant", "treatment_variant"),
        "experiment_id",
    )

    def arm(name: str) -> Column:
        return F.sum(F.when(F.col("variant") == F.col(f"{name}_variant"), F.col("n")).otherwise(0))

    out = named.groupBy("experiment_id", "bucket_type", "bucket").agg(
        arm("control").alias("control_assignments"),
        arm("treatment").alias("treatment_assignments"),
    )
    return out.withColumns(
        _allocation(F.col("control_assignments"), F.col("treatment_assignments"), share, z)
    )


def srm_check(
    definitions: DataFrame,
    observations: DataFrame,
    assignments: DataFrame | None = None,
    *,
    share: float = 0.5,
    z: float = 3.29,
) -> DataFrame:
    """Allocation and sample quality per experiment, with warnings.

    Receipts decide where an experiment has any, else the trials of its observations.
    """
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    if z <= 0:
        raise ValueError("z must be positive")
    c = F.col
    rows = _arms(definitions, observations)
    if assignments is None:
        rows = rows.withColumns(
            {
                "_c": F.lit(None).cast("long"), "_t": F.lit(None).cast("long"),
                "_buckets": F.array().cast("array<string>"),
            }
        )
    else:
        counts = assignments.groupBy("experiment_id", "variant").agg(
            F.count(F.lit(1)).alias("n")
        ).join(
            definitions.select("experiment_id", "control_variant", "treatment_variant"),
            "experiment_id",
        ).groupBy("experiment_id").agg(
            F.sum(F.when(c("variant") == c("control_variant"), c("n")).otherwise(0)).alias("_c"),
            F.sum(F.when(c("variant") == c("treatment_variant"), c("n")).otherwise(0)).alias(
                "_t"
            ),
        )
        flagged = srm_buckets(definitions, assignments, share=share, z=z).where(
            "sample_ratio_mismatch"
        ).groupBy("experiment_id").agg(
            F.array_sort(
                F.collect_list(F.struct("bucket_type", "bucket"))
            ).alias("_flagged")
        ).select(
            "experiment_id",
            F.transform(
                "_flagged",
                lambda b: F.concat_ws(
                    ":", F.lit("sample_ratio_mismatch"), b["bucket_type"], b["bucket"]
                ),
            ).alias("_buckets"),
        )
        rows = rows.join(counts, "experiment_id", "left").join(flagged, "experiment_id", "left")
    receipts = c("_c").isNotNull()
    rows = rows.withColumns(
        {
            "allocation_source": F.when(receipts, "assignment_receipts").otherwise(
                "outcome_trials"
            ),
            "control_assignments": F.coalesce("_c", "control_trials"),
            "treatment_assignments": F.coalesce("_t", "treatment_trials"),
            "total_trials": c("control_trials") + c("treatment_trials"),
            "minimum_sample_reached": _enough(),
            "causal_design_declared": _causal(),
        }
    ).withColumns(
        _allocation(c("control_assignments"), c("treatment_assignments"), share, z)
    )
    head = F.array_compact(
        F.array(
            F.when(c("total_trials") == 0, F.lit("no_observations")),
            F.when(~c("minimum_sample_reached"), F.lit("minimum_sample_not_reached")),
            F.when(c("sample_ratio_mismatch"), F.lit("sample_ratio_mismatch")),
        )
    )
    tail = F.array_compact(
        F.array(
            F.when(
                ~c("causal_design_declared"),
                F.concat(F.lit("non_randomized_assignment:"), c("assignment_method")),
            )
        )
    )
    middle = F.coalesce("_buckets", F.array().cast("array<string>"))
    return rows.select(
        "experiment_id", "total_trials", "allocation_source", "control_assignments",
        "treatment_assignments", "total_assignments", "observed_treatment_share",
        "sample_ratio_zscore", "sample_ratio_mismatch", "minimum_sample_reached",
        "causal_design_declared", F.concat(head, middle, tail).alias("warnings"),
    )


def model_scorecard(evaluations: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Forecast quality per model over its evaluated experiments. `models` adds the models that
    have none yet."""
    c = F.col

    def share(name: str) -> Column:
        return F.avg(c(name).cast("double"))

    cards = evaluations.groupBy("model_artifact_id").agg(
        F.count(F.lit(1)).alias("evaluated_experiments"),
        F.count_if("causal_allowed").alias("causal_experiments"),
        F.count_if("minimum_sample_reached").alias("minimum_sample_experiments"),
        F.avg("absolute_error").alias("mean_absolute_effect_error"),
        share("within_interval").alias("predicted_interval_coverage_rate"),
        share("direction_correct").alias("direction_accuracy"),
        share("minimum_sample_reached").alias("minimum_sample_rate"),
        share("causal_allowed").alias("causal_experiment_rate"),
    )
    if models is not None:
        cards = models.select("model_artifact_id").distinct().join(
            cards, "model_artifact_id", "left"
        ).fillna(
            0, ["evaluated_experiments", "causal_experiments", "minimum_sample_experiments"]
        )
    n = c("evaluated_experiments")
    warnings = F.array_compact(
        F.array(
            F.when(n == 0, F.lit("no_evaluated_experiments")),
            F.when(
                (n > 0) & (n < 5),
                F.lit("small_experiment_history: fewer than 5 evaluated experiments"),
            ),
            F.when(
                c("minimum_sample_experiments") < n,
                F.lit("some_experiments_below_minimum_sample"),
            ),
            F.when(
                (n > 0) & (c("causal_experiments") == 0),
                F.lit("no_randomized_experiments: causal validation unavailable"),
            ),
            F.when(
                (n >= 5) & (c("predicted_interval_coverage_rate") < 0.8),
                F.lit("low_prediction_interval_coverage"),
            ),
            F.when(
                (n >= 5) & (c("direction_accuracy") < 0.7), F.lit("low_effect_direction_accuracy")
            ),
        )
    )
    return cards.withColumn("warnings", warnings)


@dataclass(frozen=True)
class RecalibrationPolicy:
    minimum_evaluated: int = 5
    minimum_causal: int = 3
    maximum_error: float = 0.05
    minimum_coverage: float = 0.80
    minimum_direction: float = 0.70


def recalibration_assessment(
    scorecards: DataFrame, policy: RecalibrationPolicy | None = None
) -> DataFrame:
    """State per model: insufficient_evidence, monitor or review_recalibration, with reasons.

    Retraining is never automatic; missing evidence outranks every other finding.
    """
    p, c = policy or RecalibrationPolicy(), F.col
    thin = F.array_compact(
        F.array(
            F.when(
                c("evaluated_experiments") < p.minimum_evaluated,
                F.lit("insufficient_evaluated_experiments"),
            ),
            F.when(
                c("causal_experiments") < p.minimum_causal,
                F.lit("insufficient_causal_experiments"),
            ),
        )
    )
    weak = F.array_compact(
        F.array(
            F.when(
                c("mean_absolute_effect_error") > p.maximum_error,
                F.lit("mean_absolute_effect_error_above_threshold"),
            ),
            F.when(
                c("predicted_interval_coverage_rate") < p.minimum_coverage,
                F.lit("prediction_interval_coverage_below_threshold"),
            ),
            F.when(
                c("direction_accuracy") < p.minimum_direction,
                F.lit("effect_direction_accuracy_below_threshold"),
            ),
        )
    )
    return scorecards.withColumns({"_thin": thin, "_weak": weak}).select(
        "model_artifact_id",
        F.when(F.size("_thin") > 0, "insufficient_evidence")
        .when(F.size("_weak") > 0, "review_recalibration").otherwise("monitor").alias("state"),
        F.when(F.size("_thin") > 0, c("_thin")).otherwise(c("_weak")).alias("reasons"),
        F.lit(True).alias("human_review_required"),
        F.lit(False).alias("automatic_retraining_allowed"),
    )


def experiment_overview(
    definitions: DataFrame, predictions: DataFrame, observations: DataFrame
) -> DataFrame:
    """Per experiment: is a forecast locked, how many observations and trials exist."""
    seen = observations.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("trials").alias("trials")
    )
    locks = predictions.select("experiment_id").distinct().withColumn("_l", F.lit(True))
    return definitions.select("experiment_id", "created_at").join(
        locks, "experiment_id", "left"
    ).join(seen, "experiment_id", "left").select(
        "experiment_id", "created_at",
        F.coalesce("_l", F.lit(False)).alias("prediction_locked"),
        F.coalesce("observations", F.lit(0)).alias("observations"),
        F.coalesce("trials", F.lit(0)).alias("trials"),
    )
