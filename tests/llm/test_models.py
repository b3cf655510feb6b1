"""LM scoring and the quality classifier."""

import math
import zlib

import numpy as np

from hearthline.llm import lm, quality, queries

SMALL = lm.Settings(tokens=512, classes=12, groups=3, hidden=8, epochs=3)


def test_lm_counts_and_scores_match_loops(docs, rows, spark):
    model = lm.train(docs, settings=SMALL)
    counts = np.zeros(SMALL.tokens, int)
    for r in rows:
        for w in (r[1] or "").encode().split():
            counts[zlib.crc32(w) % SMALL.tokens] += 1
    token_class, group, within = lm.classes_of(counts, SMALL)
    assert (token_class == model.token_class).all() and np.allclose(within, model.within)
    got = {r.doc_id: r.lm for r in lm.score(docs, model).select("doc_id", "lm").collect()}
    for r in rows[:75]:
        ids = [zlib.crc32(w) % SMALL.tokens for w in (r[1] or "").encode().split()]
        cls = [0, 0] + [token_class[i] for i in ids] + [0, 0]
        total = 0.0
        for k, i in enumerate(ids):
            a, b, c, d = group[cls[k]], cls[k + 1], cls[k + 3], group[cls[k + 4]]
            context = ((a * 12 + b) * 12 + c) * 3 + d
            total += float(model.log_p[context, cls[k + 2]]) + within[i]
        assert got[r[0]].n_tokens == len(ids) and math.isclose(got[r[0]].log_prob, total, rel_tol=1e-6, abs_tol=1e-6)
    assert np.allclose(np.exp(model.log_p).sum(1), 1, atol=1e-4)


def test_lm_learns_both_sides():
    """The middle class is a function of both neighbours: the network finds it."""
    s = lm.Settings(tokens=64, classes=6, groups=2, hidden=24, epochs=400, rate=0.05)
    contexts, targets = [], []
    for a in range(1, 6):
        for b in range(1, 6):
            contexts.append(((1 * 6 + a) * 6 + b) * 2 + 1)
            targets.append(1 + (a + 2 * b) % 5)
    log_p = lm.train_network(np.array(contexts), np.array(targets), np.full(25, 10), s)
    assert (log_p[contexts].argmax(1) == targets).mean() > 0.9


def test_lm_empty(empty):
    model = lm.train(empty, settings=SMALL)
    assert lm.score(empty, model).count() == 0 and lm.score_text(model, b"") == (0, 0.0, 0.0)
    assert lm.score_text(model, b"any word")[0] == 2


def test_prior_needs_no_negative_label():
    rng = np.random.default_rng(3)
    draw = lambda mean, n: rng.normal(mean, 1, (n, quality.FEATURES))
    for prior in (0.3, 0.6, 0.85):
        n = int(4000 * prior)
        mixed = np.concatenate([draw(0, n), draw(1.5, 4000 - n)])
        assert abs(quality.estimate_prior(draw(0, 2000), mixed) - prior) < 0.06
    # labels drawn from positives alone say nothing of the share: it is still found
    assert quality.estimate_prior(draw(0, 2000), draw(0, 4000)) > 0.9
    assert 0 < quality.estimate_prior(draw(0, 1), draw(0, 1)) < 1


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (3000, quality.FEATURES))
    bad = rng.normal(2.5, 1, (600, quality.FEATURES))
    model = quality.fit_network(good[:1500], np.concatenate([good[1500:], bad[:300]]), 0.83, steps=200)
    p, n = model.score(good), model.score(bad)
    assert (p[:, None] > n[None, :600]).mean() > 0.98 and (p >= 0.3).mean() > 0.97


def test_word_pair_share_at_any_length():
    for m in (1, 2, 50, 1998, 2000, 2002, 30_000):
        words = [b"click", b"here"] * (m // 2) if m > 1 else [b"click"]
        words[1 : m // 2] = [b"w%d" % k for k in range(1, m // 2)]  # the first half differs, the rest repeats a phrase
        pairs = {}
        for pair in zip(words, words[1:]):
            pairs[pair] = pairs.get(pair, 0) + 1
        assert quality.features(b" ".join(words))[-1] == max(pairs.values(), default=0) / len(words)


def test_quality_on_held_out_labels(spark):
    import pandas as pd

    folder = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, folder).toPandas()
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    assert len(got) == 1000
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = got[got.held_out].merge(labels, on="doc_id")
    p, n = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (p[:, None] > n[None]).mean() > 0.95 and (p >= 0.3).mean() > 0.95


def test_quality_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.add_score(docs, model).select("score").collect()} == {0.5}
    assert quality.keep_good(docs, model).count() == docs.count() and quality.keep_good(docs, model).columns == docs.columns
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality.add_score(docs, quality.fit(docs, some)).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.add_score(empty, model).count() == 0
