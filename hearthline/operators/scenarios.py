"""What-if scenarios over a population, for every parameter vector and replication at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.hashing import uniform
from hearthline.operators.utility import choice_features, choice_matrix, outside_constant, softmax
from hearthline.schemas import DEFAULT_WEIGHTS, FEATURES, UNIT
from hearthline.session import stored


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    price_change_pct: float = 0.0
    payment_multiplier: float = 1.0
    payment_plan_code: str | None = None
    commute_multiplier: float = 1.0
    eligible_product_types: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not -0.95 <= self.price_change_pct <= 5.0:
            raise ValueError("price_change_pct must be between -0.95 and 5.0")
        if self.payment_multiplier <= 0 or self.commute_multiplier <= 0:
            raise ValueError("multipliers must be positive")


def _scenario_column(scenarios: Sequence[Scenario]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.scenario_id).alias("scenario_id"),
                F.lit(float(s.price_change_pct)).alias("price"),
                F.lit(float(s.payment_multiplier)).alias("payment"),
                F.lit(s.payment_plan_code).cast("string").alias("plan"),
                F.lit(float(s.commute_multiplier)).alias("commute"),
                (
                    F.array(*[F.lit(t) for t in s.eligible_product_types])
                    if s.eligible_product_types is not None
                    else F.lit(None)
                ).cast("array<string>").alias("eligible"),
            )
            for s in scenarios
        ]
    )


def apply_scenario(sets: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """One row per (set, scenario) with changed unit alternatives; outside options stay as they
    are. `dropped` counts the alternatives an eligibility rule removed."""
    return _each_scenario(sets, scenarios).drop("_s")


def _each_scenario(sets: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """`apply_scenario` with the scenario itself as `_s`."""
    s = F.col("_s")

    def change(a: Column) -> Column:
        changed = (
            a.withField("effective_price", a["effective_price"] * (1 + s["price"]))
            .withField("monthly_payment_est", a["monthly_payment_est"] * s["payment"])
            .withField("payment_plan_code", F.coalesce(s["plan"], a["payment_plan_code"]))
            .withField("commute_min", a["commute_min"] * s["commute"])
        )
        return F.when(a["alternative_type"] == UNIT, changed).otherwise(a)

    def keep(a: Column) -> Column:
        return (
            (a["alternative_type"] != UNIT) | s["eligible"].isNull()
            | F.coalesce(F.array_contains(s["eligible"], a["product_type"]), F.lit(False))
        )

    each = sets.withColumn("_s", F.explode(_scenario_column(scenarios))).withColumn(
        "_n", F.size("alts")
    )
    return each.withColumn("alts", F.transform(F.filter("alts", keep), change)).withColumn(
        "dropped", F.col("_n") - F.size("alts")
    ).withColumn("scenario_id", s["scenario_id"]).drop("_n")


HOUSEHOLD_INPUTS = (
    "purchase_purpose", "preferred_product_type", "max_monthly_payment_million", "commute_min",
    "purchase_horizon_days",
)


def population_classes(population: DataFrame) -> DataFrame:
    """Households that choose alike, with their number.

    A class holds everything the utility reads (the horizon only by the two thresholds it is
    compared with), so grouping is exact and the later work no longer grows with the population.
    """
    horizon = F.col("purchase_horizon_days")
    step = F.when(horizon > 180, 181).when(horizon > 90, 91).otherwise(0)
    inputs = [
        step if c == "purchase_horizon_days" else F.col(c) for c in HOUSEHOLD_INPUTS
    ]
    return population.withColumn(
        "class_id",
        F.md5(F.to_json(F.array("project_id", *[c.cast("string") for c in inputs]))),
    )


def population_sets(population: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per (class of households, packed choice set of its project), `households` wide."""
    classes = population_classes(population).groupBy("class_id", "project_id").agg(
        F.count(F.lit(1)).alias("households"),
        *[F.max(c).alias(c) for c in HOUSEHOLD_INPUTS],
    )
    joined = classes.join(sets.select("project_id", "alts"), "project_id")
    minutes = F.col("commute_min")
    # a missing commute keeps what the set already carries
    return joined.withColumn(
        "alts",
        F.transform(
            "alts",
            lambda a: F.when(
                (a["alternative_type"] == UNIT) & minutes.isNotNull(),
                a.withField("commute_min", minutes),
            ).otherwise(a),
        ),
    )


def _parameter_column(parameters: Sequence[Mapping[str, float]], first: int) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("parameter"),
                *[F.lit(float(w[n])).alias(n) for n in FEATURES],
            )
            for i, w in enumerate(parameters, start=first)
        ]
    )


def score_scenarios(
    grouped: DataFrame,
    scenarios: Sequence[Scenario],
    parameters: Sequence[Mapping[str, float]],
    *,
    first_parameter: int = 0,
) -> DataFrame:
    """`population_sets` x scenarios x parameter vectors with the probabilities `p`.

    Scenarios and parameter vectors are literals unrolled inside each row; each row holds one
    whole set, so the softmax needs no shuffle. Features are taken once per scenario, a parameter
    vector only weighs them. Rows are small in bytes but heavy to score, so they are dealt over
    a fixed number of partitions: by bytes, the runtime would merge them into a single task.
    """
    tasks = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.repartition(tasks, F.xxhash64("class_id", "project_id"))

    def features(a: Column) -> Column:
        values = choice_features(lambda n: a[n], F.col)
        named = [x for n, v in zip(FEATURES, values, strict=True) for x in (F.lit(n), v)]
        return F.named_struct(
            *named, F.lit("_constant"), outside_constant(lambda n: a[n], F.col)
        )

    def weighted(x: Column) -> Column:
        total = F.col("_w")[FEATURES[0]] * x[FEATURES[0]]
        for name in FEATURES[1:]:
            total = total + F.col("_w")[name] * x[name]
        return total + x["_constant"]

    facts = apply_scenario(dealt, scenarios).select(
        "class_id", "project_id", "purchase_purpose", "households", "scenario_id", "dropped",
        F.transform(
            "alts",
            lambda a: F.named_struct(
                F.lit("alternative_id"), a["alternative_id"],
                F.lit("alternative_type"), a["alternative_type"],
            ),
        ).alias("alts"),
        F.transform("alts", features).alias("_x"),
    )
    runs = facts.withColumn("_w", F.explode(_parameter_column(parameters, first_parameter)))
    scored = runs.withColumn("u", F.transform("_x", weighted)).withColumn("p", softmax(F.col("u")))
    return scored.select(
        "class_id", "project_id", "purchase_purpose", "households", "scenario_id", "dropped",
        F.col("_w.parameter").alias("parameter"), "alts", "p",
    )


def sampled_index(p: Column, u: Column) -> Column:
    """Position of a weighted draw: the first alternative whose running sum exceeds u."""
    def state(total: Column, at: Column) -> Column:
        return F.named_struct(F.lit("sum"), total, F.lit("at"), at)

    passed = F.aggregate(
        p, state(F.lit(0.0), F.lit(0)),
        lambda s, x: state(
            s["sum"] + x, s["at"] + F.when(s["sum"] + x <= u, 1).otherwise(0)
        ),
    )["at"]
    return F.least(passed, F.size(p) - 1)


# households of a project scored together, and cells (alternative rows x parameter vectors) worked on at once
BLOCK = 64
BLOCK_CELLS = 2_000_000


def household_blocks(population: DataFrame, draws: Column | None = None) -> DataFrame:
    """(project_id, block, people): households of a project in blocks of about BLOCK, however many a project has.

    Without `draws` a person is a class of households that choose alike, `households` wide; with them (an array of
    uniforms) every household is its own.
    """
    sizes = population.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    # few as a rule; stored, so the planner knows it and does not shuffle the households to meet them
    crowded = stored(sizes.select("project_id", F.ceil(F.col("_n") / BLOCK).alias("blocks")))
    if draws is None:
        one = population_classes(population).groupBy("class_id", "project_id").agg(
            F.count(F.lit(1)).alias("households"), *[F.max(c).alias(c) for c in HOUSEHOLD_INPUTS]
        )
        key, extra = "class_id", []
    else:
        one = population.withColumns({"households": F.lit(1).cast("long"), "draws": draws})
        key, extra = "household_id", ["draws"]
    numbered = one.join(crowded, "project_id", "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64(key), F.col("blocks")), F.lit(0).cast("long"))
    )
    person = [
        F.col("households"), F.col("purchase_purpose"), F.col("preferred_product_type"),
        F.col("max_monthly_payment_million").cast("double").alias("max_monthly_payment_million"),
        F.col("commute_min").cast("double").alias("commute_min"),
        F.col("purchase_horizon_days").cast("double").alias("purchase_horizon_days"), *extra,
    ]
    return numbered.groupBy("project_id", "block").agg(F.collect_list(F.struct(*person)).alias("people"))


def _block_sets(
    population: DataFrame, sets: DataFrame, scenarios: Sequence[Scenario], draws: Column | None = None
) -> DataFrame:
    """(scenario_id, commute_factor, project_id, people, alts): a block of households and its project's set in a scenario.

    Blocks and sets meet narrow: a set travels once a block, not once a household. Rows are small in bytes but heavy to
    score, so they are dealt over a fixed number of partitions: by bytes, the runtime would merge them into a single task.
    """
    tasks = int(population.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = household_blocks(population, draws).join(sets.select("project_id", "alts"), "project_id")
    each = _each_scenario(met.repartition(tasks, "project_id", "block"), scenarios)

    def seen(a: Column) -> Column:
        return F.struct(
            a["alternative_id"].alias("alternative_id"), a["alternative_type"].alias("alternative_type"),
            a["product_type"].alias("product_type"), a["outside_option"].alias("outside_option"),
            a["effective_price"].cast("double").alias("effective_price"),
            a["monthly_payment_est"].cast("double").alias("monthly_payment_est"),
            a["commute_min"].cast("double").alias("commute_min"),
        )

    return each.where(F.size("alts") > 0).select(
        "scenario_id", F.col("_s.commute").alias("commute_factor"), "project_id", "people",
        F.transform("alts", seen).alias("alts"),
    )


@dataclass
class _Scored:
    """Probabilities of some rows of `_block_sets`: `p` has a row for each (person, alternative), persons one after another."""

    rows: object  # the record batch
    people: object  # its persons and alternatives as tables of one record batch
    alts: object
    row: np.ndarray  # of each person
    start: np.ndarray  # of each person in p
    size: np.ndarray
    alt: np.ndarray  # of each row of p
    p: np.ndarray


def _score_blocks(batches: Iterator, weights: np.ndarray) -> Iterator[_Scored]:
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = [pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("people", "alts")]
        ends = np.cumsum(sizes[0] * sizes[1])
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_CELLS // len(weights), "right")))
            part = batch.slice(lo, hi - lo)
            people, alts = (pa.RecordBatch.from_struct_array(part.column(c).flatten()) for c in ("people", "alts"))
            n, wide = sizes[0][lo:hi], sizes[1][lo:hi]
            row = np.repeat(np.arange(hi - lo), n)
            size = wide[row]
            start = np.cumsum(size) - size
            person = np.repeat(np.arange(len(row)), size)
            alt = np.arange(len(person)) - (start - (np.cumsum(wide) - wide)[row])[person]
            factor = part.column("commute_factor").to_numpy(zero_copy_only=False)[row][person]
            x, constant = choice_matrix(alts, people, alt, person, factor)
            u = x @ weights.T + constant[:, None]
            e = np.exp(u - np.repeat(np.maximum.reduceat(u, start), size, axis=0))
            p = e / np.repeat(np.add.reduceat(e, start), size, axis=0)
            yield _Scored(part, people, alts, row, start, size, alt, p)
            lo = hi


def _codes(names) -> np.ndarray:
    """A number for each distinct value, null included."""
    return names.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(weights: np.ndarray, first: int) -> np.ndarray:
    return np.arange(first, first + len(weights), dtype=np.int32)


def _expected(weights: np.ndarray, first: int, segments: bool):
    """A task's blocks to probability mass by row (project and scenario), segment and alternative."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for s in _score_blocks(batches, weights):
            purpose = s.people.column("purchase_purpose")
            code = _codes(purpose) if segments else np.zeros(len(s.row), np.int64)
            _, first_of, group = np.unique(s.row * (code.max() + 1) + code, return_index=True, return_inverse=True)
            wide = s.size[first_of]
            base = np.cumsum(wide) - wide
            cell = base[np.repeat(group, s.size)] + np.arange(len(s.alt)) - np.repeat(s.start, s.size)
            at = np.empty(wide.sum(), np.int64)
            at[cell] = s.alt
            mass = s.p * np.repeat(s.people.column("households").to_numpy(), s.size)[:, None]
            n = np.stack([np.bincount(cell, m, len(at)) for m in mass.T])
            owner = np.repeat(s.row[first_of], wide)
            named = purpose.take(pa.array(np.repeat(first_of, wide)))
            for number, values in zip(_numbered(weights, first), n, strict=True):
                yield _rows(s, owner, at, named, number, 0, values)

    return run


def _drawn(weights: np.ndarray, first: int, replications: int):
    """A task's blocks to picks: a row for each that was drawn, counted by row, segment and alternative."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for s in _score_blocks(batches, weights):
            u = s.people.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(-1, replications)
            passed = np.zeros((len(s.row), len(weights), replications), np.int64)
            total = np.zeros((len(s.row), len(weights)))
            for k in range(int(s.size.max(initial=0))):  # the running sum in the order of the alternatives
                has = np.flatnonzero(s.size > k)
                total[has] += s.p[s.start[has] + k]
                passed[has] += total[has][:, :, None] <= u[has][:, None, :]
            picked = np.minimum(passed, (s.size - 1)[:, None, None])
            purpose = s.people.column("purchase_purpose")
            code = _codes(purpose)
            for j, number in enumerate(_numbered(weights, first)):
                for r in range(replications):
                    at = s.alt[s.start + picked[:, j, r]]
                    key = (s.row * (code.max() + 1) + code) * len(s.alts) + at
                    _, one, n = np.unique(key, return_index=True, return_counts=True)
                    yield _rows(s, s.row[one], at[one], purpose.take(pa.array(one)), number, r, n.astype(float))

    return run


def _rows(s: _Scored, owner, at, segment, number, replication, n):
    import pyarrow as pa

    own, alt, size = pa.array(owner), pa.array(at), len(at)
    return pa.RecordBatch.from_arrays(
        [
            s.rows.column("scenario_id").take(own), pa.array(np.full(size, number, np.int32)),
            pa.array(np.full(size, replication, np.int32)), segment, s.rows.column("project_id").take(own),
            s.alts.column("alternative_id").take(alt), s.alts.column("alternative_type").take(alt), pa.array(n),
        ],
        names=PICKS,
    )


PICKS = [
    "scenario_id", "parameter", "replication", "segment", "project_id", "alternative_id", "alternative_type", "n",
]


def _vectors(parameters: Sequence[Mapping[str, float]]) -> np.ndarray:
    return np.array([[float(w[n]) for n in FEATURES] for w in parameters])


def scenario_picks(
    population: DataFrame,
    sets: DataFrame,
    scenarios: Sequence[Scenario],
    parameters: Sequence[Mapping[str, float]] = (DEFAULT_WEIGHTS,),
    *,
    replications: int = 1,
    seed: int = 42,
    mode: str = "expected",
    first_parameter: int = 0,
    segments: bool = True,
    merged: bool = True,
) -> DataFrame:
    """Picks per run, segment and alternative:
    (scenario_id, parameter, replication, segment, project_id, alternative_id,
    alternative_type, n).

    "expected" gives every alternative its probability mass; "sampled" draws one alternative per
    household with a uniform keyed by (seed + replication, household), hence the same for all
    scenarios and parameter vectors. NumPy scores blocks of households for all vectors at once and
    sums them per alternative, so neither households nor runs are ever rows. A household without
    any alternative picks none.

    Expected picks without `segments` carry any one of a set's segments, for shares that do not ask
    for it. Picks that are not `merged` may name a key several times, once a block of households:
    for readers that sum them anyway.
    """
    weights = _vectors(parameters)
    schema = "scenario_id string, parameter int, replication int, segment string, project_id string, "
    schema += "alternative_id string, alternative_type string, n double"
    if mode == "expected":
        # no sampling noise, so every replication is the same run
        run, draws = _expected(weights, first_parameter, segments), None
    elif mode == "sampled":
        numbers = [F.lit(seed + r) for r in range(replications)]
        run = _drawn(weights, first_parameter, replications)
        draws = F.array(*[uniform("choice", k, F.col("household_id")) for k in numbers])
    else:
        raise ValueError(f"unknown mode: {mode}")
    rows = _block_sets(population, sets, scenarios, draws).mapInArrow(run, schema)
    return rows.groupBy(*PICKS[:-1]).agg(F.sum("n").alias("n")) if merged else rows


def expected_mass(
    population: DataFrame,
    sets: DataFrame,
    scenarios: Sequence[Scenario],
    parameters: Sequence[Mapping[str, float]] = (DEFAULT_WEIGHTS,),
    *,
    first_parameter: int = 0,
) -> DataFrame:
    """Expected picks of units and of outside options per run: (scenario_id, parameter, replication, alternative_type, n).

    What `scenario_picks` gives in "expected" mode, summed over segments, projects and alternatives. NumPy scores blocks
    of households for all parameter vectors at once, and a task returns a row per scenario and vector: neither
    alternatives nor runs are ever rows.
    """
    weights = _vectors(parameters)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        sums: dict[str, np.ndarray] = {}
        for s in _score_blocks(batches, weights):
            units = pc.equal(s.alts.column("alternative_type"), UNIT).to_numpy(zero_copy_only=False).astype(float)
            share = np.add.reduceat(s.p * units[s.alt][:, None], s.start)
            people = s.people.column("households").to_numpy()
            scenario = np.array(s.rows.column("scenario_id").to_pylist(), dtype=object)[s.row]
            for name in set(scenario):
                mine = scenario == name
                found = sums.setdefault(name, np.zeros((2, len(weights))))
                found[0] += people[mine] @ share[mine]
                found[1] += people[mine].sum()
        for name, (inside, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(weights)), pa.array(_numbered(weights, first_parameter)), pa.array(inside), pa.array(total - inside)],
                names=["scenario_id", "parameter", "inside", "outside"],
            )

    parts = _block_sets(population, sets, scenarios).mapInArrow(run, "scenario_id string, parameter int, inside double, outside double")
    totals = parts.groupBy("scenario_id", "parameter").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    return totals.select(
        "scenario_id", "parameter", F.lit(0).alias("replication"),
        F.inline(F.array(
            F.struct(F.lit(UNIT).alias("alternative_type"), F.col("i").alias("n")),
            F.struct(F.lit("outside").alias("alternative_type"), F.col("o").alias("n")),
        )),
    )


def dropped_alternatives(
    population: DataFrame, sets: DataFrame, scenarios: Sequence[Scenario]
) -> DataFrame:
    """How many (household, alternative) offers each scenario's eligibility rule removes."""
    return apply_scenario(population_sets(population, sets), scenarios).groupBy(
        "scenario_id"
    ).agg(F.sum(F.col("dropped") * F.col("households")).alias("dropped_alternatives"))


RUN = ("scenario_id", "parameter", "replication")


def choice_share(picks: DataFrame, *, by: Sequence[str] = ("alternative_id",)) -> DataFrame:
    """Share of each alternative among all picks of a run."""
    counts = stored(picks.groupBy(*RUN, *by).agg(F.sum("n").alias("n")))
    # one row a run; stored, so the planner knows it and does not shuffle the counts by their few runs
    totals = stored(counts.groupBy(*RUN).agg(F.sum("n").alias("total")))
    return counts.join(totals, list(RUN)).select(
        *RUN, *by, "n", (F.col("n") / F.col("total")).alias("share")
    )


def segment_share(picks: DataFrame) -> DataFrame:
    """Share of each alternative among the picks of a segment within a run."""
    counts = stored(picks.groupBy(*RUN, "segment", "alternative_id").agg(F.sum("n").alias("n")))
    totals = stored(counts.groupBy(*RUN, "segment").agg(F.sum("n").alias("total")))
    return counts.join(totals, [*RUN, "segment"]).select(
        *RUN, "segment", "alternative_id", "n", (F.col("n") / F.col("total")).alias("share")
    )


def unit_share(picks: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Unit and outside share per run (and per `by`)."""
    units = F.sum(F.when(F.col("alternative_type") == UNIT, F.col("n")).otherwise(0.0))
    return picks.groupBy(*RUN, *by).agg((units / F.sum("n")).alias("unit_share")).withColumn(
        "outside_share", 1 - F.col("unit_share")
    )


def _at(values: Column, n: Column, q: float) -> Column:
    place = (n - 1) * F.lit(q)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    share = place - low
    return F.get(values, low) * (1 - share) + F.get(values, high) * share


def quantile_summary(
    df: DataFrame, value: str, *, by: Sequence[str] = (), runs: int | None = None
) -> DataFrame:
    """mean, p05, p50, p95, minimum, maximum, samples of the run values of each group.

    With `runs`, values a group is missing count as 0. A group holds one number per run, so its
    list is bounded by the run count.
    """
    lists = df.groupBy(*by).agg(F.collect_list(F.col(value).cast("double")).alias("v"))
    if runs is not None:
        lists = lists.withColumn(
            "v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(runs) - F.size("v")))
        )
    v = F.col("_v")
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return lists.withColumn("_v", F.array_sort("v")).select(
        *by,
        (total / n).alias("mean"), _at(v, n, 0.05).alias("p05"), _at(v, n, 0.50).alias("p50"),
        _at(v, n, 0.95).alias("p95"), F.array_min(v).alias("minimum"),
        F.array_max(v).alias("maximum"), n.cast("long").alias("samples"),
    )


def scenario_ensemble(picks: DataFrame, *, runs: int) -> DataFrame:
    """Summaries per scenario: unit share, outside share, each alternative, each segment.

    Rows (scenario_id, measure, key, mean, p05, ...) over `runs` runs. The picks are stored, because each measure
    reads them.
    """
    picks = stored(picks)
    shares = unit_share(picks)
    by_run = shares.select(
        *RUN, F.inline(
            F.array(
                F.struct(F.lit("unit_share").alias("measure"), F.lit("").alias("key"),
                         F.col("unit_share").alias("v")),
                F.struct(F.lit("outside_share").alias("measure"), F.lit("").alias("key"),
                         F.col("outside_share").alias("v")),
            )
        )
    )
    by_alternative = choice_share(picks).select(
        *RUN, F.lit("choice_share").alias("measure"), F.col("alternative_id").alias("key"),
        F.col("share").alias("v"),
    )
    by_segment = unit_share(picks, by=["segment"]).select(
        *RUN, F.lit("segment_unit_share").alias("measure"), F.col("segment").alias("key"),
        F.col("unit_share").alias("v"),
    )
    rows = by_run.unionByName(by_alternative).unionByName(by_segment)
    return quantile_summary(rows, "v", by=["scenario_id", "measure", "key"], runs=runs)


def scenario_effects(picks: DataFrame, *, control: str, treatment: str) -> DataFrame:
    """Paired unit shares and their difference per (parameter, replication)."""
    shares = unit_share(picks.where(F.col("scenario_id").isin(control, treatment)))

    def of(name: str) -> Column:
        return F.max(F.when(F.col("scenario_id") == name, F.col("unit_share")))

    return shares.groupBy("parameter", "replication").agg(
        of(control).alias("control"), of(treatment).alias("treatment")
    ).withColumn("effect", F.col("treatment") - F.col("control"))


def scenario_compare(picks: DataFrame, *, control: str, treatment: str) -> DataFrame:
    """Summaries of control, treatment and paired effect, one row per measure."""
    pairs = scenario_effects(picks, control=control, treatment=treatment)
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(m).alias("v"))
            for m in ("control", "treatment", "effect")
        ]
    )
    return quantile_summary(pairs.select(F.inline(cells)), "v", by=["measure"])
