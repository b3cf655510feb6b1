"""Quality classifier from positive and unlabelled documents: non-negative unbiased risk, trained in numpy."""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import each, free_name, text_udf

FEATURES = 20


def features(text: bytes) -> list[float]:
    """Shares of characters, words and lines that tell running prose from noise; all zero for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    n, m = len(text), len(words)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lower, upper, digits = int(c[97:123].sum()), int(c[65:91].sum()), int(c[48:58].sum())
    symbols = int(sum(c[ord(x)] for x in "#*$%&<>"))
    high = int(c[128:].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    number = dict(zip(counts, range(len(counts))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, m)
    follow = np.unique(ids[:-1] * len(counts) + ids[1:], return_counts=True)[1]
    doubled = sum(map(operator.eq, words, words[1:]))
    return [
        float(np.log1p(m)), sum(map(len, words)) / m, len(counts) / m**0.8, doubled / m,
        counts.most_common(1)[0][1] / m, upper / (upper + lower + 1), digits / n, symbols / m,
        int(c[ord("|")]) / m, int(c[ord("!")]) / m, int(c[ord(".")]) / m, int(c[ord(",")]) / m,
        (int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())) / m, high / n,
        int(c[10]) / m, 1 - len(set(lines)) / len(lines), float(np.log1p(max(map(len, words)))),
        float(np.log1p(m / len(lines))), int(c[ord("_")] + c[ord("=")] + c[ord("{")] + c[ord("}")]) / m,
        int(follow.max(initial=0)) / m,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] | None  # None: nothing to learn from, everything scores 0.5
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, z)[1], -30, 30)))


def _forward(w, z):
    h = np.tanh(z @ w[0] + w[1])
    return h, (h @ w[2] + w[3])[:, 0]


def fit_network(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 400, rate: float = 0.02,
    decay: float = 1e-4, seed: int = 5, apart: bool = False,
) -> Model:
    """Minimise prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss l.

    The second term estimates the risk on negatives without seeing one; where over-fitting drives it below zero, the
    step goes against its gradient instead, which keeps the estimate non-negative. With `apart` the two samples are told
    apart instead: half E_P[l(g)] + half E_U[l(-g)].
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    z = np.clip((both - mean) / scale, -6, 6)
    n, rng = len(positive), np.random.default_rng(seed)
    w = [rng.normal(0, 0.3, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, (hidden, 1)), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    share = np.concatenate([np.full(n, 1 / n), np.full(len(unlabelled), 1 / len(unlabelled))])
    is_p = np.arange(len(z)) < n
    for step in range(1, steps + 1):
        h, g = _forward(w, z)
        g = np.clip(g, -30, 30)
        up = 1 / (1 + np.exp(-g))  # derivative of l(-g); that of l(g) is up - 1
        if apart:
            d = share * np.where(is_p, up - 1, up) / 2
        else:
            loss_minus = np.logaddexp(0, g) * share
            negative = loss_minus[~is_p].sum() - prior * loss_minus[is_p].sum()
            d_negative = share * up * np.where(is_p, -prior, 1.0)
            d = -d_negative if negative < 0 else d_negative + np.where(is_p, prior * share * (up - 1), 0.0)
        dh = d[:, None] @ w[2].T * (1 - h * h)
        grads = [z.T @ dh + decay * w[0], dh.sum(0), h.T @ d[:, None] + decay * w[2], np.array([d.sum()])]
        for k, grad in enumerate(grads):
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.001 * (grad * grad - v[k])
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5, delta: float = 0.1) -> float:
    """The share of positives among unlabelled documents, from positives and unlabelled rows alone.

    If the documents above a score held positives only, the unlabelled share above it over the positive share above it
    would be the class prior; elsewhere it is more. So the prior is that ratio where its upper confidence end is least.
    Scores come from a network that tells the two samples apart, fitted on one half and read on the other, both ways.
    """
    rng = np.random.default_rng(seed)
    deal = [(x, rng.permutation(len(x)) % 2) for x in (positive, unlabelled)]
    found = []
    for half in (0, 1):
        (p, u), (tp, tu) = [x[h != half] for x, h in deal], [x[h == half] for x, h in deal]
        if not min(map(len, (p, u, tp, tu))):
            continue
        model = fit_network(p, u, 0.5, seed=seed, apart=True)
        sp, su = np.sort(model.score(tp)), np.sort(model.score(tu))
        cuts = np.unique(sp)
        above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
        above_u = 1 - np.searchsorted(su, cuts) / len(su)
        slack = np.sqrt(np.log(4 / delta) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
        best = np.argmin((above_u + slack) / above_p)
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def learnable(doc_id) -> object:
    """Rows that may teach: crc32 of the id as text is no multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, max_positive: int = 12_000, max_unlabelled: int = 24_000,
    id_col: str = "doc_id", text: str = "text",
) -> Model:
    """Train on learnable rows: about `max_positive` trusted positives and `max_unlabelled` documents whose labels are
    not looked at, both picked by the hash of their id (all rows when there are fewer).

    The class prior is estimated from the same rows (`estimate_prior`); no negative label is read for it. Ids with
    contradicting labels and null labels teach nothing. Without a trusted positive or without documents every score is 0.5.
    """
    key = F.col("doc_id").cast("long").alias("id")
    known = labels.select(key, F.col("quality").cast("int").alias("q")).where("q is not null").groupBy("id").agg(
        F.min("q").alias("low"), F.max("q").alias("high")
    ).where("low = high").select("id", F.col("low").alias("q"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where(learnable(F.col("id"))).distinct()
    marked = ids.join(known, "id", "left")
    total = marked.agg(F.count("*").alias("n"), F.count_if(F.col("q") == 1).alias("p")).first()
    if not total.p:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, 0.5)
    limit = lambda most, n: int(min(1.0, most / max(n, 1)) * (1 << 30))
    drawn = lambda salt, most, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < limit(most, n)
    as_positive, as_unlabelled = drawn(11, max_positive, total.p), drawn(12, max_unlabelled, total.n)
    picked = marked.select("id", ((F.col("q") == 1) & as_positive).alias("positive"), as_unlabelled.alias("unlabelled"))
    picked = picked.where("positive or unlabelled")
    # the draw depends on the id alone, so texts outside it never reach the shuffle
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    rows = rows.where(learnable(F.col("id")) & (as_positive | as_unlabelled)).join(picked, "id")
    rows = rows.select("id", F.coalesce("positive", F.lit(False)).alias("p"), F.col("unlabelled").alias("u"), _features(F.col("t")).alias("x"))
    found = rows.select("id", "p", "u", "x.x").toArrow().sort_by("id")  # bounded by the two parameters
    x = np.array(found["x"].combine_chunks().flatten()).reshape(-1, FEATURES) if found.num_rows else np.zeros((0, FEATURES))
    p, u = np.array(found["p"].to_pylist(), bool), np.array(found["u"].to_pylist(), bool)
    if not p.any() or not u.any():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, 0.5)
    return fit_network(x[p], x[u], estimate_prior(x[p], x[u]))


def _features(text):
    return text_udf(each(lambda: lambda value: (features(value),)), "x array<double>")(text)


def add_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out`, from 0 to 1, higher: good quality likelier. Null and empty texts get the score of a text without
    features; whole texts are read; repeated rows score alike; an empty table stays empty; other columns pass through, one
    named like `out` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda texts: [(float(s),) for s in known.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES))]

    return docs.withColumn(out, text_udf(make, "score double")(F.col(text)).getField("score"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Documents that score at least the threshold; all columns as they were."""
    name = free_name(docs, "__score")
    return add_score(docs, model, text, name).where(F.col(name) >= threshold).drop(name)
