import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import logit, population, scenarios, temporal, utility
from hearthline.operators.scenarios import Scenario
from hearthline.plans import calibration
from hearthline.schemas import DEFAULT_WEIGHTS, FEATURES

ALT = (
    "struct<alternative_id:string,alternative_type:string,product_type:string,"
    "effective_price:double,monthly_payment_est:double,payment_plan_code:string,"
    "commute_min:double,outside_option:string>"
)


def alt(name, price=None, pay=None, product="townhouse"):
    if price is None:
        return (name, "no_purchase", None, None, None, None, None, "no_purchase")
    return (name, "unit", product, price, pay, "P", 20.0, None)


def cheap_sets(spark, n=40):
    alts = [alt("cheap", 1e9, 8e6), alt("expensive", 3e9, 25e6), alt("OUT-NO-PURCHASE")]
    return spark.createDataFrame(
        [(f"d{i}", "own_stay", "townhouse", 20.0, alts, 0) for i in range(n)],
        "decision_id string, purchase_purpose string, preferred_product_type string, "
        f"max_monthly_payment_million double, alts array<{ALT}>, chosen int",
    )


def random_sets(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        alts = [
            alt(f"u{j}", float(rng.uniform(0.5e9, 3e9)), float(rng.uniform(5e6, 2e7)),
                ["townhouse", "shophouse", "garden_villa"][j % 3])
            for j in range(int(rng.integers(2, 6)))
        ] + [alt("OUT-NO-PURCHASE")]
        rows.append(
            (f"d{i}", ["own_stay", "investment"][i % 2], "townhouse", 12.0, alts,
             int(rng.integers(0, len(alts))))
        )
    return spark.createDataFrame(
        rows, "decision_id string, purchase_purpose string, preferred_product_type string, "
        f"max_monthly_payment_million double, alts array<{ALT}>, chosen int",
    )


def dense(sets):
    return [
        (np.array(r["x"]).reshape(-1, 8), r["chosen"]) for r in sets.collect()
    ]


def reference_stats(data, w):
    loss, gradient = 0.0, np.zeros(8)
    for x, chosen in data:
        u = x @ w
        p = np.exp(u - u.max())
        p /= p.sum()
        loss -= np.log(p[chosen])
        gradient += x[chosen] - p @ x
    return loss, gradient


def test_statistics_match_a_plain_loop(spark):
    sets = logit.training_sets(random_sets(spark)).repartition(5).cache()
    data = dense(sets)
    w = np.array([DEFAULT_WEIGHTS[n] for n in FEATURES])
    row = logit._pass(sets, w[None, :])[0]
    loss, gradient = reference_stats(data, w)
    assert row[0] == 300 and abs(row[1] - loss) < 1e-8
    assert np.allclose(row[2:10], gradient, atol=1e-8)
    hessian, step = logit._hessian(row), 1e-5
    for k in range(8):
        e = np.eye(8)[k] * step
        numeric = (reference_stats(data, w - e)[1] - reference_stats(data, w + e)[1]) / (2 * step)
        assert np.allclose(hessian[k], numeric, atol=1e-4)


def test_newton_finds_the_optimum(spark):
    sets = logit.training_sets(random_sets(spark)).cache()
    fit = logit.logit_fit(sets)
    w = np.array([fit.weights[n] for n in FEATURES])
    _, gradient = reference_stats(dense(sets), w)
    assert fit.converged and np.abs(gradient / 300 - 0.001 * w).max() < 1e-7
    assert fit.epochs < 15


def test_price_sign_is_learned(spark):
    zero = dict.fromkeys(FEATURES, 0.0)
    sets = cheap_sets(spark)
    fit = logit.logit_fit(logit.training_sets(sets).cache(), init=zero)
    row = utility.log_loss(
        utility.choice_probabilities(sets, fit.weights, mode="training")
    ).first()
    assert fit.weights["price_per_billion"] < 0
    assert row["top1_accuracy"] == 1.0 and row["log_loss"] < 0.5 and row["examples"] == 40
    base = utility.uniform_baseline(
        utility.choice_probabilities(sets, fit.weights, mode="training")
    ).first()
    assert abs(base["uniform_log_loss"] - np.log(3)) < 1e-12 and base["improvement_pct"] > 50


def test_gradient_ascent_follows_the_update_rule(spark):
    sets = logit.training_sets(random_sets(spark, 60)).cache()
    data, w = dense(sets), np.array([DEFAULT_WEIGHTS[n] for n in FEATURES])
    fit = logit.logit_fit(sets, method="gd", max_iter=4)
    for _ in range(4):
        loss, gradient = reference_stats(data, w)
        w = w + 0.03 * (gradient / 60 - 0.001 * w)
    assert np.allclose([fit.weights[n] for n in FEATURES], w, atol=1e-10)
    assert abs(fit.loss - loss / 60) < 1e-10 and not fit.converged


def test_empty_evaluation_gives_zeros(spark):
    none = utility.choice_probabilities(
        cheap_sets(spark, 1).where("false"), mode="training"
    )
    row = utility.log_loss(none).first()
    assert (row["examples"], row["log_loss"], row["top1_accuracy"]) == (0, 0.0, 0.0)


def test_bootstrap_does_not_depend_on_partitions(spark):
    sets = logit.training_sets(random_sets(spark, 120))
    a = logit.bootstrap_fit(sets.repartition(1), replicates=4, max_iter=6)
    b = logit.bootstrap_fit(sets.repartition(7), replicates=4, max_iter=6)
    for x, y in zip(a, b, strict=True):
        assert np.allclose([x[n] for n in FEATURES], [y[n] for n in FEATURES], atol=1e-8)
    assert a[0] != a[1]


def test_bootstrap_passes_are_gradients_and_reach_the_newton_optimum(spark, monkeypatch):
    sets = logit.training_sets(random_sets(spark, 400)).repartition(3).cache()
    start = np.array([DEFAULT_WEIGHTS[n] for n in FEATURES])
    real, wide = logit._pass, []

    def counted(sets, weights, **kwargs):
        if len(np.unique(weights, axis=0)) > 1:
            wide.append(kwargs.get("hessian", True))
        return real(sets, weights, **kwargs)

    monkeypatch.setattr(logit, "_pass", counted)
    samples = logit.bootstrap_fit(sets, replicates=6)
    assert wide and sum(wide) <= 1  # replicates at weights of their own seldom need their Hessians
    w, _, done, _ = logit._newton(
        sets, start, list(range(6)), l2=0.001, tol=1e-12, max_iter=50, scheme="poisson", seed=42
    )
    assert done.all()
    assert np.allclose([[s[n] for n in FEATURES] for s in samples], w, rtol=0, atol=1e-9)


def test_replicates_at_one_point_share_their_sets(spark):
    sets = logit.training_sets(random_sets(spark, 60)).repartition(2).cache()
    w = np.array([DEFAULT_WEIGHTS[n] for n in FEATURES])
    apart = np.vstack([logit._pass(sets, w[None, :], replicates=[r], scheme="poisson") for r in range(5)])
    assert np.allclose(logit._pass(sets, np.tile(w, (5, 1)), scheme="poisson"), apart, rtol=1e-12, atol=1e-9)


def test_exact_bootstrap_draws_n_sets(spark):
    sets = logit.training_sets(random_sets(spark, 50))
    counted = logit.exact_counts(sets, 3, seed=1, n=50)
    totals = counted.select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("s"))
    assert {r["s"] for r in totals.collect()} == {50} and counted.count() == 50
    assert len(logit.bootstrap_fit(sets, replicates=3, scheme="exact", max_iter=5)) == 3


def test_poisson_counts_have_mean_and_variance_one():
    hashes = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 100000)
    c = logit.poisson_counts(hashes, [0, 1], 42)
    assert np.abs(c.mean(axis=0) - 1).max() < 0.02 and np.abs(c.var(axis=0) - 1).max() < 0.03
    assert abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.02


def test_coefficient_intervals(spark):
    samples = [dict.fromkeys(FEATURES, float(i)) for i in range(-1, 10)]
    rows = logit.coefficient_intervals(
        logit.parameter_frame(spark, samples), dict.fromkeys(FEATURES, 1.0)
    ).collect()
    assert len(rows) == 8
    assert abs(rows[0]["lower"] - -0.75) < 1e-9 and abs(rows[0]["upper"] - 8.75) < 1e-9
    assert rows[0]["crosses_zero"] and rows[0]["bootstrap_samples"] == 11


@pytest.mark.parametrize("n,fraction", [(10, 0.2), (5, 0.5), (2, 0.9), (25, 0.1)])
def test_temporal_holdout(spark, n, fraction):
    df = spark.range(n).select(
        F.col("id").cast("string").alias("decision_id"),
        F.timestamp_seconds(1767225600 + (F.col("id") % 3) * 86400).alias("as_of"),
    )
    got = calibration.temporal_holdout(df, fraction=fraction)
    size = max(1, round(n * fraction))
    split = max(1, n - size)
    assert got.where("split = 'train'").count() == split
    last = got.where("split = 'train'").agg(F.max("as_of")).first()[0]
    first = got.where("split = 'holdout'").agg(F.min("as_of")).first()[0]
    assert last <= first


def test_first_n_is_exact_for_one_instant(spark):
    df = spark.range(500).select(
        F.col("id").cast("string").alias("i"), F.timestamp_seconds(F.lit(1767225600)).alias("t")
    )
    for n in (0, 1, 123, 499, 500):
        keep = temporal.first_n_predicate(df, ts="t", row_id="i", n=n)
        assert df.where(keep).count() == n


def test_dense_index_is_dense(spark):
    df = spark.range(1000).select(
        F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 5 + 1).alias("w")
    )
    rows = sorted(
        (r["lo"], r["hi"], r["w"]) for r in temporal.dense_index(df, "k", weight="w").collect()
    )
    assert rows[0][0] == 0 and rows[-1][1] == 3000
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    assert all(hi - lo == w for lo, hi, w in rows)


PEOPLE = (
    "household_id string, purchase_purpose string, household_size_band string, "
    "children_band string, income_midpoint_million double, liquid_capital_million double, "
    "max_monthly_payment_million double, purchase_horizon_days int, workplace_zone string, "
    "commute_tolerance_min double, preferred_product_type string, profile_confidence double"
)


def people(spark, n=2, prefix="h"):
    return spark.createDataFrame(
        [(f"{prefix}{i}", ["own_stay", "investment"][i % 2], "2", "1", 65.0, None, 20.0, 90,
          ["A", "B"][i % 2], 30.0, "townhouse", 0.9) for i in range(n)], PEOPLE,
    )


def test_resampling(spark):
    profile = population.population_profile(people(spark), name="t")
    kwargs = dict(households=profile.households, version=profile.version)
    a = population.resample_population(profile.prototypes, 2000, seed=7, **kwargs)
    b = population.resample_population(profile.prototypes.repartition(7), 2000, seed=7, **kwargs)
    assert a.count() == 2000 and a.select("household_id").distinct().count() == 2000
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    tvd = population.marginal_distance(profile.prototypes, a, weight="households")
    assert tvd.agg(F.max("total_variation_distance")).first()[0] < 0.1
    assert len(profile.warnings) == 2
    means = population.numeric_compare(profile.prototypes, a, weight="households")
    row = means.where("field = 'liquid_capital_million'").first()
    assert row["source_mean"] is None and row["absolute_mean_delta"] is None


def test_population_version_ignores_ids_and_order(spark):
    a = population.population_profile(people(spark, 40), name="t").version
    b = population.population_profile(people(spark, 40, "other").repartition(3), name="t").version
    c = population.population_profile(people(spark, 41), name="t").version
    assert a == b != c


def test_one_prototype_may_hold_almost_everything(spark):
    crowd = people(spark, 2000).withColumn(
        "purchase_purpose", F.when(F.col("household_id") == "h1", "mixed").otherwise("own_stay")
    ).withColumn("workplace_zone", F.lit("A"))
    protos = population.population_prototypes(crowd)
    assert protos.count() == 2
    drawn = population.resample_population(
        protos, 20000, seed=1, households=2000, version="v"
    )
    rare = drawn.where("purchase_purpose = 'mixed'").count()
    assert drawn.count() == 20000 and 1 <= rare <= 30


def test_blocks_cover_every_index_once(spark, monkeypatch):
    monkeypatch.setattr(population, "CHUNK", 2)
    monkeypatch.setattr(population, "FAN", 4)
    total = 3000
    sizes = population._block_sizes(total)
    assert sizes == [2, 8, 32]
    edges = [0, 1, 2, 7, 8, 9, 63, 200, 2900, total]  # one prototype holds 90 %
    ranges = list(zip(edges, edges[1:]))
    df = spark.createDataFrame(ranges, "lo long, hi long")
    cells = df.select("lo", "hi", F.inline(population._blocks(sizes))).collect()
    for i in range(total):
        met = [
            (c["lo"], c["hi"]) for c in cells
            if i // sizes[c["_level"]] == c["_block"] and c["lo"] <= i < c["hi"]
        ]
        assert met == [next(r for r in ranges if r[0] <= i < r[1])], i
    heavy = [c for c in cells if c["lo"] == 200]
    assert len(heavy) < 100  # against 1,350 chunks


def test_statistics_do_not_depend_on_the_block_size(monkeypatch):
    w = np.array([[DEFAULT_WEIGHTS[n] for n in FEATURES]])
    real, calls = logit._statistics, []

    def counted(x, *rest):
        calls.append(len(x))
        return real(x, *rest)

    sizes, chosen = np.array([3, 9, 2, 2, 1]), np.array([0, 4, 1, 0, 0])
    x = np.random.default_rng(3).normal(size=(17, len(FEATURES)))
    starts, ones = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.ones((5, 1))
    one = real(x, starts, sizes, chosen, w, ones, True)
    monkeypatch.setattr(logit, "_statistics", counted)
    parts = logit._blockwise(x, starts, sizes, chosen, w, ones, True, rows=4)
    assert calls == [3, 9, 4, 1]  # whole sets; a larger one stands alone
    assert np.allclose(one, parts, atol=1e-12)


def market(spark):
    alts = [alt("a", 1e9, 1e7), alt("b", 2e9, 2e7, "street_villa"), alt("OUT-NO-PURCHASE")]
    sets = spark.createDataFrame([("p", alts)], f"project_id string, alts array<{ALT}>")
    crowd = people(spark, 400).withColumns(
        {"project_id": F.lit("p"), "commute_min": F.lit(15.0)}
    )
    return crowd, sets


def test_higher_price_never_raises_the_unit_share(spark):
    crowd, sets = market(spark)
    options = tuple(Scenario(f"p{i}", price_change_pct=i / 10) for i in range(4))
    for mode in ("expected", "sampled"):
        picks = scenarios.scenario_picks(crowd, sets, options, mode=mode)
        shares = [
            r["unit_share"]
            for r in scenarios.unit_share(picks).orderBy("scenario_id").collect()
        ]
        assert all(a >= b for a, b in zip(shares, shares[1:]))
        total = picks.groupBy("scenario_id").agg(F.sum("n").alias("n"))
        assert all(abs(r["n"] - 400) < 1e-9 for r in total.collect())


def test_expected_mass_is_the_sum_of_picks(spark, monkeypatch):
    crowd, sets = market(spark)
    options = (Scenario("s"), Scenario("t", price_change_pct=-0.3), Scenario("v", eligible_product_types=("street_villa",)))
    vectors = [{**DEFAULT_WEIGHTS, "price_per_billion": -i / 10} for i in range(5)]
    want = scenarios.unit_share(scenarios.scenario_picks(crowd, sets, options, vectors, first_parameter=-1))
    want = {(r.scenario_id, r.parameter): r.unit_share for r in want.collect()}
    assert len(want) == 15
    for cells in (scenarios.BLOCK_CELLS, 1):  # whole batches, and a set at a time
        monkeypatch.setattr(scenarios, "BLOCK_CELLS", cells)
        mass = scenarios.expected_mass(crowd, sets, options, vectors, first_parameter=-1)
        got = {(r.scenario_id, r.parameter): r.unit_share for r in scenarios.unit_share(mass).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        assert abs(mass.where("scenario_id = 's' and parameter = 0").agg(F.sum("n")).first()[0] - 400) < 1e-9


def test_sampling_agrees_with_expectation_and_repeats(spark):
    crowd, sets = market(spark)
    args = (crowd, sets, (Scenario("s"),))
    want = scenarios.unit_share(scenarios.scenario_picks(*args)).first()["unit_share"]
    got = scenarios.scenario_picks(*args, mode="sampled", replications=10)
    mean = scenarios.unit_share(got).agg(F.avg("unit_share")).first()[0]
    assert abs(mean - want) < 0.03
    again = scenarios.scenario_picks(
        crowd.repartition(5), sets, (Scenario("s"),), mode="sampled", replications=10
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def plain_picks(crowd, sets, options, vectors, mode, replications):
    """Picks by Spark's own expressions, a household and run at a time."""
    scored = scenarios.score_scenarios(scenarios.population_sets(crowd, sets), options, vectors)
    if mode == "expected":
        cells = F.explode(F.arrays_zip(F.col("alts").alias("alts"), F.col("p").alias("p")))
        rows = scored.select("*", F.lit(0).alias("replication"), cells.alias("c")).select(
            "*", "c.alts.alternative_id", (F.col("c.p") * F.col("households")).alias("n")
        )
    else:
        numbers = F.explode(F.sequence(F.lit(0), F.lit(replications - 1)))
        scored = scored.where(F.size("alts") > 0)  # who has no alternative picks none, as in SQL
        draws = scenarios.population_classes(crowd).select("class_id", "household_id", numbers.alias("replication"))
        draws = draws.withColumn("u", scenarios.uniform("choice", F.col("replication") + F.lit(42), F.col("household_id")))
        chosen = F.get("alts", scenarios.sampled_index(F.col("p"), F.col("u")))
        rows = draws.join(scored, "class_id").withColumn("alternative_id", chosen["alternative_id"]).withColumn("n", F.lit(1.0))
    keys = ["scenario_id", "parameter", "replication", "purchase_purpose", "project_id", "alternative_id"]
    return {tuple(r)[:-1]: r["n"] for r in rows.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}


@pytest.mark.parametrize("mode", ["expected", "sampled"])
def test_blocks_give_the_picks_of_plain_expressions(spark, monkeypatch, mode):
    """Two projects of unlike sets, unknown prices, payments and commutes; blocks of every size, a set at a time."""
    alts = [alt("a", 1e9, 1e7), alt("b", 2e9, 2e7, "street_villa"), alt("c", 3e9, None, "shophouse")]
    alts += [(o, o, None, None, None, None, None, o) for o in ("continue_renting", "postponed", "land_house")]
    other = [("d", "unit", "garden_villa", None, 7e7, "P", None, None), alt("OUT-NO-PURCHASE")]
    sets = spark.createDataFrame([("p", alts), ("q", other), ("empty", [])], f"project_id string, alts array<{ALT}>")
    k = F.substring("household_id", 2, 9).cast("int")
    crowd = people(spark, 200).withColumns({
        "project_id": F.when(k % 5 == 0, "q").when(k % 17 == 0, "empty").otherwise("p"),
        "commute_min": F.when(k % 3 > 0, F.lit(15.0) + k % 4),
        "purchase_horizon_days": F.when(k % 4 > 0, k),
        "preferred_product_type": F.when(k % 7 > 0, F.when(k % 2 == 0, "street_villa").otherwise("garden_villa")),
        "max_monthly_payment_million": F.when(k % 6 > 0, F.lit(5.0) + k % 20),
        "purchase_purpose": F.when(k % 11 > 0, F.col("purchase_purpose")),
    })
    assert crowd.where("project_id = 'q'").count() and crowd.where("commute_min is null").count()
    options = (Scenario("s"), Scenario("t", price_change_pct=-0.3, commute_multiplier=0.5), Scenario("v", eligible_product_types=("street_villa",)))
    vectors = [{**DEFAULT_WEIGHTS, "price_per_billion": -i / 10} for i in range(3)]
    want = plain_picks(crowd, sets, options, vectors, mode, 2)
    keys = ["scenario_id", "parameter", "replication", "segment", "project_id", "alternative_id"]
    for block, cells in ((64, 2_000_000), (7, 1)):
        monkeypatch.setattr(scenarios, "BLOCK", block)
        monkeypatch.setattr(scenarios, "BLOCK_CELLS", cells)
        for merged in (True, False):
            picks = scenarios.scenario_picks(crowd, sets, options, vectors, mode=mode, replications=2, merged=merged)
            got = {tuple(r)[:-1]: r["n"] for r in picks.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}
            assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    if mode == "expected":
        share = [
            {tuple(r)[:4]: r["share"] for r in scenarios.choice_share(scenarios.scenario_picks(crowd, sets, options, vectors, segments=s)).collect()}
            for s in (True, False)
        ]
        assert share[0].keys() == share[1].keys() and all(abs(share[0][x] - share[1][x]) < 1e-12 for x in share[0])


def test_a_set_travels_once_a_block_and_counts_are_not_dealt_by_run(spark):
    crowd, sets = market(spark)
    rows = scenarios._block_sets(crowd, sets, (Scenario("s"),))
    assert 2 <= rows.count() <= -(-400 // scenarios.BLOCK)  # not one a household
    assert rows.agg(F.sum(F.aggregate("people", F.lit(0).cast("long"), lambda a, x: a + x["households"]))).first()[0] == 400
    picks = scenarios.scenario_picks(crowd, sets, (Scenario("s"),))
    for share in (scenarios.choice_share(picks), scenarios.segment_share(picks)):
        plan = share._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_sampled_index_follows_the_running_sum(spark):
    p = F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    rows = spark.createDataFrame([(0.0,), (0.19,), (0.2,), (0.49,), (0.51,), (0.9999,)], "u double")
    got = [r[0] for r in rows.select(scenarios.sampled_index(p, F.col("u"))).collect()]
    assert got == [0, 0, 1, 1, 2, 2]


def test_eligibility_drops_units_only(spark):
    crowd, sets = market(spark)
    s = (Scenario("all"), Scenario("v", eligible_product_types=("street_villa",)))
    dropped = {
        r[0]: r[1] for r in scenarios.dropped_alternatives(crowd, sets, s).collect()
    }
    assert dropped == {"all": 0, "v": 400}
    changed = scenarios.apply_scenario(
        sets, (Scenario("x", price_change_pct=0.1, payment_multiplier=2.0,
                        payment_plan_code="Q", commute_multiplier=0.5),)
    ).first()["alts"]
    assert abs(changed[0]["effective_price"] - 1.1e9) < 1 and changed[0]["commute_min"] == 10.0
    assert changed[0]["payment_plan_code"] == "Q" and changed[2]["effective_price"] is None
    with pytest.raises(ValueError):
        Scenario("bad", price_change_pct=-0.99)


def test_quantiles_are_ordered_and_padded(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", 5.0)],
                               "k string, v double")
    rows = {r["k"]: r for r in scenarios.quantile_summary(df, "v", by=["k"], runs=11).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["p05"], a["p50"], a["p95"], a["samples"]) == (0.5, 5.0, 9.5, 11)
    assert b["minimum"] == 0.0 and b["samples"] == 11 and abs(b["mean"] - 5 / 11) < 1e-12


def test_paired_comparison(spark):
    crowd, sets = market(spark)
    params = [{**DEFAULT_WEIGHTS, "price_per_billion": -0.5 - i / 10} for i in range(5)]
    pair = (Scenario("c"), Scenario("t", price_change_pct=-0.2))
    picks = scenarios.scenario_picks(crowd, sets, pair, params, mode="sampled", replications=2)
    out = {r["measure"]: r for r in
           scenarios.scenario_compare(picks, control="c", treatment="t").collect()}
    e = out["effect"]
    assert e["samples"] == 10 and e["mean"] > 0 and e["p05"] <= e["p50"] <= e["p95"]
    assert abs(e["mean"] - (out["treatment"]["mean"] - out["control"]["mean"])) < 1e-12
    ensemble = scenarios.scenario_ensemble(picks, runs=10)
    assert ensemble.where("samples <> 10").count() == 0


def test_unfinished_fit_reports_the_loss_of_its_weights(spark):
    sets = logit.training_sets(random_sets(spark)).cache()
    for steps in (1, 2):
        fit = logit.logit_fit(sets, max_iter=steps, init=dict.fromkeys(FEATURES, 0.5))
        loss, _ = reference_stats(dense(sets), np.array([fit.weights[n] for n in FEATURES]))
        assert not fit.converged and abs(fit.loss - loss / 300) < 1e-8
