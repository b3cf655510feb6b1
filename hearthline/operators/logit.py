"""Conditional logit fit over packed choice sets, with all bootstrap replicates in one pass.

Spark partitions the sets and sums the statistics; inside a task NumPy evaluates a batch of sets
for all parameter vectors at once. A pass is map-only plus one tiny aggregate, and what comes
back to the driver is (replicates x 46) numbers, whatever the size of the data.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.hashing import uniform
from hearthline.operators.temporal import dense_index
from hearthline.operators.utility import choice_features
from hearthline.schemas import DEFAULT_WEIGHTS, FEATURES

K = len(FEATURES)
UPPER = [(i, j) for i in range(K) for j in range(i, K)]
STATS = 2 + K + len(UPPER)
# replicates evaluated together, to bound the memory of one task
GROUP = 16
# alternative rows worked on at once, few enough for a core's cache; a single larger set is one block
BLOCK_ROWS = 16_384
# a bootstrap replicate is done when no weight would move further than this: results of any path agree to nine digits
STEP_TOL = 1e-10
# steps with a kept Hessian must shrink at least so much, else a new Hessian is asked for
SHRINK = 0.1


@dataclass
class FitResult:
    weights: dict[str, float]
    epochs: int
    converged: bool
    loss: float
    history: list[float] = field(default_factory=list)


def training_sets(examples: DataFrame, *, set_id: str = "decision_id", keep: Sequence[str] = ()) -> DataFrame:
    """Chosen examples as flat feature vectors: (set_id, set_hash, x, n, chosen), and the columns of `keep`."""
    vectors = F.transform(
        "alts", lambda a: F.array(*choice_features(lambda n: a[n], F.col))
    )
    return examples.where(F.col("chosen").isNotNull()).select(
        F.col(set_id).alias("set_id"),
        # 60 bits of a hash that other engines have, so they can repeat the bootstrap draws
        F.conv(F.substring(F.md5(F.col(set_id).cast("string")), 1, 15), 16, 10).cast("long").alias("set_hash"),
        F.flatten(vectors).alias("x"),
        F.size("alts").alias("n"),
        "chosen", *keep,
    )


def _mix(values: np.ndarray) -> np.ndarray:
    """64-bit finalizer used to derive replicate uniforms from set hashes."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def poisson_counts(set_hash: np.ndarray, replicates: Sequence[int], seed: int) -> np.ndarray:
    """Poisson(1) draws per (set, replicate), a function of the set's hash only."""
    cdf = np.cumsum(
        np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 25.0)]))
    )
    with np.errstate(over="ignore"):
        base = _mix(set_hash.astype(np.uint64) ^ _mix(np.array([seed], dtype=np.uint64)))
        reps = _mix(np.asarray(replicates, dtype=np.uint64))
        u = (_mix(base[:, None] ^ reps[None, :]) >> np.uint64(11)) / float(2**53)
    return np.searchsorted(cdf, u, side="right").astype(np.float64)


def _set_statistics(x, starts, sizes, chosen, vector, hessian) -> np.ndarray:
    """(1, loss, gradient, upper Hessian) of every set for one parameter vector."""
    out = np.zeros((len(sizes), STATS))
    u = x @ vector
    e = np.exp(u - np.repeat(np.maximum.reduceat(u, starts), sizes))
    p = e / np.repeat(np.add.reduceat(e, starts), sizes)
    at = starts + chosen
    px = p[:, None] * x
    mean = np.add.reduceat(px, starts)
    out[:, 0] = 1.0
    out[:, 1] = -np.log(np.maximum(p[at], 1e-15))
    out[:, 2:2 + K] = x[at] - mean
    if hessian:
        for k, (i, j) in enumerate(UPPER):
            out[:, 2 + K + k] = np.add.reduceat(px[:, i] * x[:, j], starts) - mean[:, i] * mean[:, j]
    return out


def _statistics(x, starts, sizes, chosen, weights, counts, hessian) -> np.ndarray:
    """Sums of (weight, loss, gradient, upper Hessian) per parameter vector for one batch."""
    if len(weights) > 1 and (weights == weights[0]).all():
        # replicates at one point differ in their counts only: each set is evaluated once for all of them
        return counts.T @ _set_statistics(x, starts, sizes, chosen, weights[0], hessian)
    out = np.zeros((len(weights), STATS))
    pairs = np.stack([x[:, i] * x[:, j] for i, j in UPPER], axis=1) if hessian else None
    for lo in range(0, len(weights), GROUP):
        part = slice(lo, lo + GROUP)
        c = counts[:, part]
        u = x @ weights[part].T
        e = np.exp(u - np.repeat(np.maximum.reduceat(u, starts), sizes, axis=0))
        p = e / np.repeat(np.add.reduceat(e, starts), sizes, axis=0)
        at = starts + chosen
        out[part, 0] = c.sum(axis=0)
        out[part, 1] = -(c * np.log(np.maximum(p[at], 1e-15))).sum(axis=0)
        pc = p * np.repeat(c, sizes, axis=0)
        out[part, 2:2 + K] = (x[at].T @ c - x.T @ pc).T
        if hessian:
            second = (pairs.T @ pc).T
            for r in range(c.shape[1]):
                mean = np.add.reduceat(p[:, r, None] * x, starts)
                outer = (mean * c[:, r, None]).T @ mean
                second[r] -= [outer[i, j] for i, j in UPPER]
            out[part, 2 + K:] = second
    return out


def _blockwise(x, starts, sizes, chosen, weights, counts, hessian, rows=BLOCK_ROWS) -> np.ndarray:
    """`_statistics` over blocks of whole sets, so its arrays do not grow with the batch."""
    total, ends, lo = np.zeros((len(weights), STATS)), starts + sizes, 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + rows, "right")))
        first = starts[lo]
        total += _statistics(
            x[first:ends[hi - 1]], starts[lo:hi] - first, sizes[lo:hi], chosen[lo:hi], weights,
            counts[lo:hi], hessian,
        )
        lo = hi
    return total


def sufficient_statistics(
    sets: DataFrame,
    weights: np.ndarray,
    *,
    replicates: Sequence[int] | None = None,
    scheme: str = "none",
    seed: int = 42,
    hessian: bool = True,
) -> DataFrame:
    """One row per parameter vector: n, loss, gradient and Hessian sums over all sets.

    `scheme` weighs the sets: "none" (all 1), "poisson" (hash draws per replicate) or "exact"
    (an array column `counts` indexed by replicate).
    """
    reps = list(replicates) if replicates is not None else list(range(len(weights)))
    columns = ["set_hash", "x", "n", "chosen"] + (["counts"] if scheme == "exact" else [])
    names = [f"s{i}" for i in range(STATS)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((len(weights), STATS))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, K)
            sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            chosen = batch.column("chosen").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            if scheme == "poisson":
                hashes = batch.column("set_hash").to_numpy(zero_copy_only=False)
                counts = poisson_counts(hashes, reps, seed)
            elif scheme == "exact":
                flat = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
                counts = flat.reshape(batch.num_rows, -1)[:, reps].astype(np.float64)
            else:
                counts = np.ones((batch.num_rows, len(weights)))
            total += _blockwise(x, starts, sizes, chosen, weights, counts, hessian)
        data = [pa.array(reps, pa.int32())] + [pa.array(total[:, i]) for i in range(STATS)]
        yield pa.RecordBatch.from_arrays(data, names=["replicate", *names])

    schema = "replicate int, " + ", ".join(f"{n} double" for n in names)
    partial = sets.select(*columns).mapInArrow(run, schema)
    return partial.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def logit_gradient(sets: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Per feature the sum over sets of (chosen - p) * x, with the loss sum and set count."""
    vector = np.array([[float((weights or DEFAULT_WEIGHTS)[n]) for n in FEATURES]])
    row = sufficient_statistics(sets, vector, hessian=False)
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.col(f"s{2 + i}").alias("gradient"))
            for i, n in enumerate(FEATURES)
        ]
    )
    return row.select(
        F.inline(cells), F.col("s1").alias("loss_sum"), F.col("s0").cast("long").alias("sets")
    )


def _pass(sets, weights, **kwargs) -> np.ndarray:
    rows = sufficient_statistics(sets, weights, **kwargs).collect()
    return np.array([list(r)[1:] for r in sorted(rows, key=lambda r: r[0])])


def _hessian(stats: np.ndarray) -> np.ndarray:
    full = np.zeros((K, K))
    for value, (i, j) in zip(stats[2 + K:], UPPER, strict=True):
        full[i, j] = full[j, i] = value
    return full


def _newton(sets, start, reps, *, l2, tol, max_iter, scheme, seed, chord=False):
    """Newton steps for many replicates; a converged one leaves the parameter table.

    The objective is concave; a step that lowers it is halved. With `chord` a replicate keeps its Hessian while its steps
    shrink to a tenth or less, so a pass is a gradient alone, and it is done when its next step would be below STEP_TOL too.
    """
    weights = np.tile(start, (len(reps), 1)).astype(float)
    curvature, renew = np.zeros((len(reps), K, K)), True
    best = np.full(len(reps), -np.inf)
    base, step = weights.copy(), np.zeros_like(weights)
    scale, epochs = np.ones(len(reps)), np.zeros(len(reps), dtype=int)
    done, losses = np.zeros(len(reps), dtype=bool), np.zeros(len(reps))
    for _ in range(max_iter):
        live = np.flatnonzero(~done)
        if live.size == 0:
            break
        hessian, renew = renew or not chord, False
        stats = _pass(
            sets, weights[live], replicates=[reps[i] for i in live], scheme=scheme, seed=seed, hessian=hessian
        )
        for row, i in zip(stats, live, strict=True):
            epochs[i] += 1
            n = max(row[0], 1.0)
            value = -row[1] / n - l2 / 2 * weights[i] @ weights[i]
            if value < best[i] - 1e-12 and scale[i] > 1e-4:
                scale[i] /= 2
                weights[i] = base[i] + scale[i] * step[i]
                renew = True
                continue
            gradient = row[2:2 + K] / n - l2 * weights[i]
            losses[i], best[i], base[i], scale[i] = row[1] / n, value, weights[i].copy(), 1.0
            flat = np.abs(gradient).max() <= tol
            if flat and not chord:
                done[i] = True
                continue
            if hessian:
                curvature[i] = _hessian(row) / n + max(l2, 1e-12) * np.eye(K)
            last, step[i] = np.abs(step[i]).max(), np.linalg.solve(curvature[i], gradient)
            if flat and np.abs(step[i]).max() <= STEP_TOL:
                done[i] = True
                continue
            renew = renew or (not hessian and np.abs(step[i]).max() > SHRINK * last)
            weights[i] = base[i] + step[i]
    # a step that was never evaluated is not returned: the losses are those of `base`
    return base, epochs, done, losses


def logit_fit(
    sets: DataFrame,
    *,
    method: str = "newton",
    init: Mapping[str, float] | None = None,
    l2: float = 0.001,
    tol: float = 1e-8,
    max_iter: int | None = None,
    learning_rate: float = 0.03,
) -> FitResult:
    """Fit the eight weights. `sets` comes from `training_sets` and should be cut from its
    lineage, since every pass reads it.

    "newton" (default) needs a handful of passes; "gd" repeats plain full-batch ascent and stops
    on the change of the mean loss, for parity on small data.
    """
    start = np.array([float((init or DEFAULT_WEIGHTS)[n]) for n in FEATURES])
    if method == "newton":
        w, epochs, done, losses = _newton(
            sets, start, [0], l2=l2, tol=tol, max_iter=max_iter or 50, scheme="none", seed=0
        )
        return FitResult(
            dict(zip(FEATURES, map(float, w[0]), strict=True)), int(epochs[0]), bool(done[0]),
            float(losses[0]),
        )
    if method != "gd":
        raise ValueError(f"unknown method: {method}")
    w, previous, history = start, np.inf, []
    converged = False
    for _ in range(max_iter or 1200):
        row = _pass(sets, w[None, :], hessian=False)[0]
        n, loss = row[0], row[1] / row[0]
        w = w + learning_rate * (row[2:2 + K] / n - l2 * w)
        history.append(loss)
        if abs(previous - loss) <= tol:
            converged = True
            break
        previous = loss
    return FitResult(
        dict(zip(FEATURES, map(float, w), strict=True)), len(history), converged, history[-1],
        history,
    )


def exact_counts(sets: DataFrame, replicates: int, *, seed: int, n: int) -> DataFrame:
    """Sets plus `counts[r]`: how often each is drawn in n draws with replacement per replicate.

    Draws are rows of a range; they meet the sets on a dense index, so no replicate is held by
    one task.
    """
    spark = sets.sparkSession
    indexed = dense_index(sets.select("set_id"), "set_id").select(
        "set_id", F.col("lo").alias("idx")
    )
    draws = spark.range(replicates * n).select(
        F.floor(F.col("id") / n).cast("int").alias("rep"),
        F.floor(uniform("boot", seed, F.col("id")) * n).cast("long").alias("idx"),
    ).groupBy("idx", "rep").agg(F.count(F.lit(1)).cast("int").alias("c"))
    per_set = draws.groupBy("idx").agg(
        F.map_from_entries(F.collect_list(F.struct("rep", "c"))).alias("m")
    )
    counted = indexed.join(per_set, "idx", "left").select(
        "set_id",
        F.transform(
            F.sequence(F.lit(0), F.lit(replicates - 1)),
            lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0)),
        ).alias("counts"),
    )
    return sets.join(counted, "set_id")


def bootstrap_fit(
    sets: DataFrame,
    *,
    replicates: int = 100,
    seed: int = 42,
    scheme: str = "poisson",
    init: Mapping[str, float] | None = None,
    l2: float = 0.001,
    tol: float = 1e-8,
    max_iter: int = 50,
) -> list[dict[str, float]]:
    """Refit every bootstrap replicate; all share each pass.

    They start from `init`, without it from the fit of all sets: near enough that the sets are evaluated once for all
    replicates, and then a few passes of gradients settle each one. The optimum is unique, so the start does not matter.
    "poisson" weighs each set by a Poisson(1) hash draw (no data movement); "exact" draws
    exactly as many sets as there are, with replacement.
    """
    if scheme == "exact":
        from hearthline.session import cut_lineage

        sets = cut_lineage(exact_counts(sets, replicates, seed=seed, n=sets.count()))
    if init is None:
        init = logit_fit(sets, l2=l2, tol=tol, max_iter=max_iter).weights
    start = np.array([float(init[n]) for n in FEATURES])
    w, _, done, _ = _newton(
        sets, start, list(range(replicates)), l2=l2, tol=tol, max_iter=max_iter, scheme=scheme,
        seed=seed, chord=True,
    )
    if not done.all():
        warnings.warn(f"{int((~done).sum())} of {replicates} replicates did not converge", stacklevel=2)
    return [dict(zip(FEATURES, map(float, row), strict=True)) for row in w]


def parameter_frame(spark: SparkSession, samples: Sequence[Mapping[str, float]]) -> DataFrame:
    """Bootstrap vectors as rows (replicate, feature, weight)."""
    rows = [(i, n, float(s[n])) for i, s in enumerate(samples) for n in FEATURES]
    return spark.createDataFrame(rows, "replicate int, feature string, weight double")


def coefficient_intervals(parameters: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Per feature the estimate with the 2.5 % and 97.5 % bootstrap bounds."""
    estimate = F.create_map(*[F.lit(v) for n in FEATURES for v in (n, float(weights[n]))])
    return parameters.groupBy("feature").agg(
        F.percentile("weight", F.lit(0.025)).alias("lower"),
        F.percentile("weight", F.lit(0.975)).alias("upper"),
        F.count(F.lit(1)).alias("bootstrap_samples"),
    ).select(
        "feature", estimate[F.col("feature")].alias("estimate"), "lower", "upper",
        "bootstrap_samples",
        ((F.col("lower") <= 0) & (F.col("upper") >= 0)).alias("crosses_zero"),
    )


def fit_warnings(
    *, fit_examples: int, holdout_examples: int, segments: Mapping[str, int],
    uncertain: Sequence[str],
) -> list[str]:
    out = []
    if fit_examples < 100:
        out.append("small_training_sample: fewer than 100 historical choices")
    if holdout_examples < 50:
        out.append("small_holdout_sample: fewer than 50 historical choices")
    out += [
        f"small_segment:{name}: fewer than 20 holdout examples"
        for name, n in sorted(segments.items()) if n < 20
    ]
    out += [f"uncertain_coefficient:{n}: interval crosses zero" for n in FEATURES if n in uncertain]
    return out
