"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Every word is hashed to one of `tokens` ids. From counts over the whole corpus the most frequent ids become classes of
their own and the rest share classes by how frequent they are. A network reads the two neighbours on either side (the
nearer ones as classes, the farther ones as coarse groups) and predicts the class in the middle; within its class a
token has its corpus share. A document's score is the sum of the conditional log-probabilities of all its tokens.

The network is trained on the counts of all windows of the corpus. There are at most `groups`^2 `classes`^3 different
windows, so tasks send counts, never text, and the table is bounded by these parameters however large the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import each, text_udf


@dataclass(frozen=True)
class Settings:
    tokens: int = 1 << 16
    classes: int = 48  # 0 stands for "outside the text"
    groups: int = 4
    hidden: int = 24
    epochs: int = 6
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    token_class: np.ndarray  # tokens -> class, 1..classes-1
    class_group: np.ndarray  # class -> group, 0..groups-1
    within: np.ndarray  # tokens -> log share inside the class
    log_p: np.ndarray  # (group, class, class, group) context -> class


_IDS: dict[bytes, int] = {}


def token_ids(text: bytes, tokens: int) -> np.ndarray:
    """Hash ids of the white-space separated words; the cache of words is bounded."""
    words = text.split()
    new = set(words).difference(_IDS)
    if new:
        if len(_IDS) + len(new) > 300_000:
            _IDS.clear()
            new = set(words)
        _IDS.update((w, zlib.crc32(w)) for w in new)
    return np.fromiter(map(_IDS.__getitem__, words), np.int64, len(words)) % tokens


def _counted(docs: DataFrame, text: str, size: int, codes_of) -> DataFrame:
    """Corpus counts of integer codes below `size`: one dense array per task, its non-zero cells summed by Spark."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            parts, n = [], 0
            for value in batch.column(0).to_pylist():
                if value:
                    parts.append(codes_of(value))
                    n += len(parts[-1])
                    if n > 1_000_000:
                        total += np.bincount(np.concatenate(parts), minlength=size)
                        parts, n = [], 0
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=size)
        cells = np.flatnonzero(total)
        for i in range(0, len(cells), 50_000):
            part = cells[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"code": pa.array(part, pa.int64()), "n": pa.array(total[part])})

    rows = docs.select(F.col(text).cast("binary")).mapInArrow(count, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, size: int) -> np.ndarray:
    """Bounded: at most `size` rows, a parameter."""
    found = counts.toArrow()
    out = np.zeros(size, np.int64)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out


def classes_of(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes by corpus counts: two thirds of them for single frequent tokens, the rest equal shares of the mass left."""
    own = (s.classes - 1) * 2 // 3
    shared = s.classes - 1 - own
    order = np.lexsort((np.arange(len(counts)), -counts))
    token_class = np.zeros(len(counts), np.int64)
    token_class[order[:own]] = np.arange(1, own + 1)
    rest = counts[order[own:]] + 1.0
    share = (np.cumsum(rest) - rest) / rest.sum()
    token_class[order[own:]] = own + 1 + np.minimum((share * shared).astype(np.int64), shared - 1)
    class_group = np.zeros(s.classes, np.int64)
    class_group[1:] = 1 + np.arange(s.classes - 1) * (s.groups - 1) // (s.classes - 1)
    mass = np.bincount(token_class, weights=counts + 1.0, minlength=s.classes)
    return token_class, class_group, np.log((counts + 1.0) / mass[token_class])


def window_codes(classes: np.ndarray, groups: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each token its context's code and its own class."""
    c = np.zeros(len(classes) + 4, np.int64)
    c[2:-2] = classes
    g = groups[c]
    return ((g[:-4] * s.classes + c[1:-3]) * s.classes + c[3:-1]) * s.groups + g[4:], classes


def train_network(contexts: np.ndarray, targets: np.ndarray, counts: np.ndarray, s: Settings) -> np.ndarray:
    """Fit embeddings of the four neighbours, a tanh layer and a softmax by Adam on weighted windows; returns the log
    probabilities of all classes in all contexts."""
    rng = np.random.default_rng(s.seed)
    sizes = (s.groups, s.classes, s.classes, s.groups)
    p = [rng.normal(0, 0.3, (n, s.hidden)).astype(np.float32) for n in sizes]
    p += [np.zeros(s.hidden, np.float32), rng.normal(0, 0.3, (s.hidden, s.classes)).astype(np.float32), np.zeros(s.classes, np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def split(code):
        code, d = np.divmod(code, s.groups)
        code, c = np.divmod(code, s.classes)
        a, b = np.divmod(code, s.classes)
        return a, b, c, d

    def forward(where):
        h = np.tanh(sum(e[i] for e, i in zip(p, where)) + p[4])
        z = h @ p[5] + p[6]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    weight = counts / max(counts.sum(), 1)
    step, n, size = 0, len(contexts), 8192
    for epoch in range(s.epochs):
        order = rng.permutation(n)
        for i in range(0, n, size):
            pick = order[i : i + size]
            where, w = split(contexts[pick]), (weight[pick] * n / len(pick)).astype(np.float32)
            h, logs = forward(where)
            dz = np.exp(logs) * w[:, None]
            dz[np.arange(len(pick)), targets[pick]] -= w
            dh = (dz @ p[5].T) * (1 - h * h)
            grads = []
            for e, idx in zip(p[:4], where):
                hot = np.zeros((len(pick), len(e)), np.float32)
                hot[np.arange(len(pick)), idx] = 1
                grads.append(hot.T @ dh)
            grads += [dh.sum(0), h.T @ dz, dz.sum(0)]
            step += 1
            rate = s.rate / (1 + epoch) ** 0.5
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    total = s.groups * s.classes * s.classes * s.groups
    return np.concatenate([forward(split(np.arange(i, min(i + 16384, total))))[1] for i in range(0, total, 16384)])


def train(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Model:
    """Three passes: token counts, window counts, then numpy on the bounded table of windows. An empty corpus gives the
    untrained network, which still scores."""
    s = settings
    counts = _dense(_counted(docs, text, s.tokens, lambda x: token_ids(x, s.tokens)), s.tokens)
    token_class, class_group, within = classes_of(counts, s)

    def windows(value: bytes) -> np.ndarray:
        context, target = window_codes(token_class[token_ids(value, s.tokens)], class_group, s)
        return context * s.classes + target

    found = _counted(docs, text, s.groups**2 * s.classes**3, windows).toArrow().sort_by("code")
    code = found["code"].to_numpy()
    log_p = train_network(code // s.classes, code % s.classes, found["n"].to_numpy(), s)
    return Model(s, token_class, class_group, within, log_p)


def score_text(model: Model, text: bytes) -> tuple[int, float, float]:
    s = model.settings
    ids = token_ids(text, s.tokens)
    context, target = window_codes(model.token_class[ids], model.class_group, s)
    total = float((model.log_p[context, target].astype(np.float64) + model.within[ids]).sum())
    return len(ids), total, total / len(ids) if len(ids) else 0.0


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "lm") -> DataFrame:
    """Add the struct `out`: n_tokens, log_prob (sum over all tokens) and mean_log_prob.

    Null and empty texts have no tokens and score 0; texts are scored whole; repeated rows score alike; an empty table
    stays empty; other columns pass through, one named like `out` is replaced. The broadcast model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda value: score_text(known, value)

    scored = text_udf(each(make), "n_tokens long, log_prob double, mean_log_prob double")
    return docs.withColumn(out, scored(F.col(text)))
