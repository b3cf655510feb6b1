"""Choice features, utilities and probabilities; every expression stays inside one set row."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.schemas import DEFAULT_WEIGHTS, FEATURES, UNIT

Getter = Callable[[str], Column]

# Constants of outside options in scoring (not in training).
RENT_BONUS, RENT_HORIZON = 0.12, 180
POSTPONE_BONUS, POSTPONE_MALUS, POSTPONE_HORIZON = 0.18, -0.05, 90
NO_PURCHASE_MALUS = -0.10


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def choice_features(alt: Getter, household: Getter) -> list[Column]:
    """The eight model features of an alternative as seen by a household, in vector order."""
    is_unit = alt("alternative_type") == UNIT

    def on_unit(value: Column) -> Column:
        return F.when(is_unit, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))

    limit = household("max_monthly_payment_million") * F.lit(1_000_000.0)
    product, purpose = alt("product_type"), household("purchase_purpose")
    return [
        on_unit(alt("effective_price") / F.lit(1_000_000_000.0)),
        on_unit(alt("monthly_payment_est") / F.lit(10_000_000.0)),
        on_unit(alt("commute_min") / F.lit(10.0)),
        on_unit(_flag(household("preferred_product_type") == product)),
        on_unit(_flag(alt("monthly_payment_est") > limit)),
        on_unit(_flag((purpose == "investment") & (product == "shophouse"))),
        on_unit(
            _flag((purpose == "own_stay") & product.isin("garden_townhouse", "garden_villa"))
        ),
        _flag(alt("outside_option").isNotNull()),
    ]


def outside_constant(alt: Getter, household: Getter) -> Column:
    option, horizon = alt("outside_option"), household("purchase_horizon_days")
    return (
        F.when(
            option == "continue_renting",
            F.when(horizon > RENT_HORIZON, RENT_BONUS).otherwise(0.0),
        )
        .when(
            option == "postponed",
            F.when(horizon > POSTPONE_HORIZON, POSTPONE_BONUS).otherwise(POSTPONE_MALUS),
        )
        .when(option == "no_purchase", NO_PURCHASE_MALUS)
        .otherwise(0.0)
    )


def choice_matrix(alts, people, alt: np.ndarray, person: np.ndarray, commute_factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`choice_features` and `outside_constant` of (person, alternative) pairs given by their positions in two Arrow
    record batches. A known commute of the person, times the factor, replaces the one of a unit."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def numbers(rows, name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column(name)
        return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

    def among(rows, name: str, *values: str) -> np.ndarray:
        return pc.is_in(rows.column(name), value_set=pa.array(values)).to_numpy(zero_copy_only=False)

    unit = among(alts, "alternative_type", UNIT)
    price, _ = numbers(alts, "effective_price")
    payment, paid = numbers(alts, "monthly_payment_est")
    shown, _ = numbers(alts, "commute_min")
    minutes, known = numbers(people, "commute_min")
    limit, limited = numbers(people, "max_monthly_payment_million")
    horizon, _ = numbers(people, "purchase_horizon_days")  # unknown: neither threshold is passed
    wanted = people.column("preferred_product_type")
    kinds = wanted.unique().drop_null()
    like, kind = (
        pc.index_in(c, value_set=kinds).fill_null(missing).to_numpy(zero_copy_only=False)
        for c, missing in ((wanted, -1), (alts.column("product_type"), -2))
    )
    x = np.zeros((len(alt), len(FEATURES)))
    x[:, 0] = (price / 1_000_000_000.0)[alt]
    x[:, 1] = (payment / 10_000_000.0)[alt]
    x[:, 2] = np.where(known[person], minutes[person] * commute_factor, shown[alt]) / 10.0
    x[:, 3] = like[person] == kind[alt]
    x[:, 4] = (payment[alt] > (limit * 1_000_000.0)[person]) & paid[alt] & limited[person]
    x[:, 5] = among(people, "purchase_purpose", "investment")[person] & among(alts, "product_type", "shophouse")[alt]
    garden = among(alts, "product_type", "garden_townhouse", "garden_villa")
    x[:, 6] = among(people, "purchase_purpose", "own_stay")[person] & garden[alt]
    x[:, :7] *= unit[alt][:, None]
    x[:, 7] = alts.column("outside_option").is_valid().to_numpy(zero_copy_only=False)[alt]
    renting, postponed, none = (
        among(alts, "outside_option", o)[alt] for o in ("continue_renting", "postponed", "no_purchase")
    )
    horizon = horizon[person]
    constant = np.where(renting & (horizon > RENT_HORIZON), RENT_BONUS, 0.0)
    constant += np.where(postponed, np.where(horizon > POSTPONE_HORIZON, POSTPONE_BONUS, POSTPONE_MALUS), 0.0)
    return x, constant + np.where(none, NO_PURCHASE_MALUS, 0.0)


def choice_utility(
    alt: Getter,
    household: Getter,
    weights: Mapping[str, float] | Getter | None = None,
    *,
    mode: str = "scoring",
) -> Column:
    """Weighted feature sum; scoring adds the outside-option constants, training does not."""
    if weights is None:
        weights = DEFAULT_WEIGHTS
    weight = weights if callable(weights) else (lambda n: F.lit(float(weights[n])))
    terms = [
        weight(name) * x for name, x in zip(FEATURES, choice_features(alt, household), strict=True)
    ]
    if mode == "scoring":
        terms.append(outside_constant(alt, household))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def softmax(utilities: Column) -> Column:
    """Probabilities of an array of utilities, shifted by their maximum."""
    top = F.array_max(utilities)
    exps = F.transform(utilities, lambda u: F.exp(u - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(exps, lambda e: e / total)


def choice_probabilities(
    sets: DataFrame,
    weights: Mapping[str, float] | Getter | None = None,
    *,
    mode: str = "scoring",
    household: Getter = F.col,
) -> DataFrame:
    """Packed sets plus `u` (utilities) and `p` (probabilities), aligned with `alts`.

    The whole softmax happens inside a row: no shuffle, no window.
    """
    return sets.withColumn(
        "u",
        F.transform(
            "alts",
            lambda a: choice_utility(lambda n: a[n], household, weights, mode=mode),
        ),
    ).withColumn("p", softmax(F.col("u")))


def vector_probabilities(sets: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Sets with flat feature vectors `x` of `n` alternatives plus `p`, as training scores them."""
    k = len(FEATURES)

    def total(i: Column) -> Column:
        terms = [F.lit(float(weights[f])) * F.get("x", i * k + j) for j, f in enumerate(FEATURES)]
        return reduce(lambda a, b: a + b, terms)

    return sets.withColumn("u", F.transform(F.sequence(F.lit(0), F.col("n") - 1), total)).withColumn(
        "p", softmax(F.col("u"))
    )


def predicted(p: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def score_sets(scored: DataFrame) -> DataFrame:
    """Per set: size, loss of the chosen alternative and whether the first maximum was chosen."""
    p_chosen = F.element_at("p", F.col("chosen") + 1)
    return scored.where(F.col("chosen").isNotNull()).withColumns(
        {
            "set_size": F.size("p"),
            "loss": -F.ln(F.greatest(p_chosen, F.lit(1e-15))),
            "hit": (predicted(F.col("p")) == F.col("chosen")).cast("double"),
        }
    )


def _metrics() -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("examples"),
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("log_loss"),
        F.coalesce(F.avg("hit"), F.lit(0.0)).alias("top1_accuracy"),
    ]


def log_loss(scored: DataFrame) -> DataFrame:
    """One row: examples, log_loss, top1_accuracy; zeros for no examples."""
    return score_sets(scored).agg(*_metrics())


def segment_metrics(scored: DataFrame, segment: str = "purchase_purpose") -> DataFrame:
    return score_sets(scored).groupBy(F.col(segment).alias("segment")).agg(*_metrics())


def uniform_baseline(scored: DataFrame) -> DataFrame:
    """Model loss against guessing uniformly inside each set."""
    row = score_sets(scored).agg(
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("model_log_loss"),
        F.coalesce(F.avg(F.ln("set_size")), F.lit(0.0)).alias("uniform_log_loss"),
    )
    base = F.col("uniform_log_loss")
    return row.withColumn(
        "improvement_pct",
        F.when(base > 0, (base - F.col("model_log_loss")) / base * 100).otherwise(0.0),
    )
