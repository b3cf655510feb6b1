"""Empirical population: prototypes, resampling and marginal checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.hashing import (
    POPULATION_NAMESPACE, digest_root, multiset_digest, uniform, uuid5,
)
from hearthline.functions.households import PROFILE_COLUMNS
from hearthline.operators.features import confident, household_snapshot
from hearthline.operators.temporal import dense_index

CATEGORICAL = (
    "purchase_purpose", "household_size_band", "children_band", "workplace_zone",
    "preferred_product_type",
)
NUMERIC = (
    "income_midpoint_million", "liquid_capital_million", "max_monthly_payment_million",
    "purchase_horizon_days", "commute_tolerance_min",
)
# index places per join chunk when draws look up their prototype
CHUNK, FAN = 16, 256


def prototype_key() -> Column:
    """Canonical JSON of a household without its id, keys sorted, nulls kept."""
    return F.to_json(F.struct(*sorted(PROFILE_COLUMNS)), {"ignoreNullFields": "false"})


@dataclass
class Population:
    """Distinct prototypes with their index ranges, and the identity of the whole profile."""

    name: str
    prototypes: DataFrame
    households: int
    content_hash: str
    warnings: list[str] = field(default_factory=list)

    @property
    def version(self) -> str:
        return f"empirical:{self.name}:{self.content_hash[:16]}"


def population_prototypes(households: DataFrame) -> DataFrame:
    """Distinct prototypes, how many households share each, and their index range [lo, hi).

    Equal households collapse first, so one very common profile costs one row.
    """
    distinct = households.groupBy(*PROFILE_COLUMNS).agg(F.count(F.lit(1)).alias("households"))
    keyed = distinct.withColumn("canonical_key", prototype_key())
    return dense_index(keyed, "canonical_key", weight="households")


def profile_identity(prototypes: DataFrame) -> DataFrame:
    """One row: household count and content hash, independent of ids and order."""
    line = F.sha2(F.concat_ws("|", "canonical_key", F.col("households").cast("string")), 256)
    return prototypes.agg(
        F.coalesce(F.sum("households"), F.lit(0)).alias("source_households"),
        digest_root(multiset_digest(line)).alias("content_hash"),
    )


def population_profile(households: DataFrame, *, name: str = "empirical") -> Population:
    prototypes = population_prototypes(households)
    row = profile_identity(prototypes).first()
    n = row["source_households"]
    if n == 0:
        raise ValueError("a population profile requires at least one household")
    warnings = []
    if n < 100:
        warnings.append("small_population_sample: fewer than 100 unique households")
    if n < 30:
        warnings.append("very_small_population_sample: synthetic market is exploratory only")
    return Population(name, prototypes, n, row["content_hash"], warnings)


def _block_sizes(households: int) -> list[int]:
    """Widths of index blocks. The widest is still cut often enough (64 to 16,384 blocks in all)
    to spread the draws of a prototype that holds nearly everyone."""
    sizes = [CHUNK]
    while sizes[-1] * FAN * 64 <= households:
        sizes.append(sizes[-1] * FAN)
    return sizes


def _blocks(sizes: Sequence[int]) -> Column:
    """(level, block) cells of [lo, hi): the widest aligned blocks inside it, narrower ones only
    along its two edges. So a heavy prototype is a few hundred cells on each level."""
    lo, hi = F.col("lo"), F.col("hi")
    none = F.array().cast("array<bigint>")

    def run(a: Column, b: Column) -> Column:
        return F.when(b > a, F.sequence(a, b - 1)).otherwise(none)

    def cell_of(level: int):
        return lambda x: F.struct(F.lit(level).alias("_level"), x.alias("_block"))

    cells = []
    for level, size in enumerate(sizes):
        if level == 0:  # the narrowest may stick out; the join checks the index itself
            a, b = F.floor(lo / size), F.floor((hi - 1) / size) + 1
        else:
            a, b = F.ceil(lo / size), F.floor(hi / size)
        found = run(a, b)
        if level + 1 < len(sizes):
            up = F.ceil(lo / (size * FAN)), F.floor(hi / (size * FAN))
            edges = F.concat(run(a, up[0] * FAN), run(up[1] * FAN, b))
            found = F.when(up[1] > up[0], edges).otherwise(found)
        cells.append(F.transform(found, cell_of(level)))
    return F.concat(*cells)


def resample_population(
    prototypes: DataFrame, size: int, *, seed: int, households: int, version: str
) -> DataFrame:
    """`size` synthetic households drawn with replacement, weight-proportional and repeatable.

    A draw is a hash uniform turned into an index; index ranges are cut into aligned blocks of a
    few widths, so that draws and prototypes meet in an equi join without skew.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    draws = prototypes.sparkSession.range(size).select(
        F.col("id").alias("draw"),
        F.floor(uniform("population", seed, F.col("id")) * F.lit(households)).cast("long").alias(
            "_idx"
        ),
    )
    sizes = _block_sizes(households)
    asked = F.array(
        *[
            F.struct(
                F.lit(k).alias("_level"), F.floor(F.col("_idx") / size).alias("_block")
            )
            for k, size in enumerate(sizes)
        ]
    )
    draws = draws.select("*", F.inline(asked))
    cut = prototypes.select("*", F.inline(_blocks(sizes)))
    met = draws.join(cut, ["_level", "_block"]).where(
        (F.col("_idx") >= F.col("lo")) & (F.col("_idx") < F.col("hi"))
    )
    return met.select(
        uuid5(
            F.concat(F.lit(f"{version}:{seed}:"), F.col("draw").cast("string")),
            POPULATION_NAMESPACE,
        ).alias("household_id"),
        "draw", *PROFILE_COLUMNS,
    )


def _both(source: DataFrame, synthetic: DataFrame, columns: Sequence[str], weight) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return source.select(
        *columns, w.cast("long").alias("_src"), F.lit(0).cast("long").alias("_syn")
    ).unionByName(
        synthetic.select(
            *columns, F.lit(0).cast("long").alias("_src"), F.lit(1).cast("long").alias("_syn")
        )
    )


def marginal_shares(
    source: DataFrame, synthetic: DataFrame, fields: Sequence[str] = CATEGORICAL,
    *, weight: str | None = None,
) -> DataFrame:
    """Shares per (field, category) on both sides; missing values count as "unknown"."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("unknown")).alias(
                    "category"
                ),
            )
            for f in fields
        ]
    )
    counts = _both(source, synthetic, fields, weight).select(
        F.inline(cells), "_src", "_syn"
    ).groupBy("field", "category").agg(F.sum("_src").alias("_src"), F.sum("_syn").alias("_syn"))
    totals = counts.groupBy("field").agg(
        F.sum("_src").alias("_all_src"), F.sum("_syn").alias("_all_syn")
    )
    return counts.join(totals, "field").select(
        "field", "category",
        F.coalesce(F.try_divide("_src", "_all_src"), F.lit(0.0)).alias("source_share"),
        F.coalesce(F.try_divide("_syn", "_all_syn"), F.lit(0.0)).alias("synthetic_share"),
    )


def marginal_distance(
    source: DataFrame, synthetic: DataFrame, fields: Sequence[str] = CATEGORICAL,
    *, weight: str | None = None, limit: float = 0.10,
) -> DataFrame:
    """Total variation distance per field, and whether it is above the limit."""
    gap = F.abs(F.col("source_share") - F.col("synthetic_share"))
    return marginal_shares(source, synthetic, fields, weight=weight).groupBy("field").agg(
        (0.5 * F.sum(gap)).alias("total_variation_distance"),
        F.count(F.lit(1)).alias("categories"),
    ).withColumn("mismatch", F.col("total_variation_distance") > limit)


def numeric_compare(
    source: DataFrame, synthetic: DataFrame, fields: Sequence[str] = NUMERIC,
    *, weight: str | None = None,
) -> DataFrame:
    """Means per field on both sides (missing values skipped) and their absolute difference."""
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"))
            for f in fields
        ]
    )
    rows = _both(source, synthetic, fields, weight).select(F.inline(cells), "_src", "_syn")

    def mean(side: str) -> Column:
        present = F.when(F.col("value").isNotNull(), F.col(side))
        return F.try_divide(F.sum(F.col("value") * F.col(side)), F.sum(present))

    return rows.groupBy("field").agg(
        mean("_src").alias("source_mean"), mean("_syn").alias("synthetic_mean")
    ).withColumn(
        "absolute_mean_delta", F.abs(F.col("source_mean") - F.col("synthetic_mean"))
    )


@dataclass
class PopulationFit:
    population: Population
    candidates: int
    included: int
    excluded: int
    synthetic: DataFrame
    marginals: DataFrame
    numerics: DataFrame


def population_fit(
    events: DataFrame,
    *,
    name: str = "empirical",
    as_of: datetime | None = None,
    minimum_confidence: float = 0.3,
    diagnostic_size: int = 5000,
    seed: int = 42,
) -> PopulationFit:
    """Snapshot -> confidence threshold -> profile -> resample -> compare."""
    if not 0 <= minimum_confidence <= 1:
        raise ValueError("minimum_confidence must be between 0 and 1")
    if diagnostic_size <= 0:
        raise ValueError("diagnostic_size must be positive")
    from hearthline.session import cut_lineage

    snapshot = household_snapshot(events, as_of=as_of)
    candidates = snapshot.count()
    included = confident(snapshot, minimum_confidence)
    profile = population_profile(included, name=name)
    profile.prototypes = cut_lineage(profile.prototypes)
    synthetic = resample_population(
        profile.prototypes, diagnostic_size, seed=seed, households=profile.households,
        version=profile.version,
    )
    marginals = marginal_distance(profile.prototypes, synthetic, weight="households")
    if not marginals.where("mismatch").isEmpty():
        profile.warnings.append(
            "population_mismatch: a categorical marginal has TV distance > 0.10"
        )
    return PopulationFit(
        profile, candidates, profile.households, candidates - profile.households, synthetic,
        marginals, numeric_compare(profile.prototypes, synthetic, weight="households"),
    )
