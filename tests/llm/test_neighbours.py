"""Cross-polytope search against comparing every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import cross_polytope as cp, queries


def exact(rows, k):
    size = {}
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((i, v))
            size[len(v)] = size.get(len(v), 0) + 1
    dims = min(size, key=lambda n: (-size[n], n)) if size else 0
    good = [(i, np.float64(v)) for i, v in good if len(v) == dims]
    best = {}
    for q, v in good:
        if q % 20 == 0:
            mine = best.setdefault(q, {})  # an id may stand on several vectors
            for i, w in good:
                if i != q:
                    mine[i] = max(mine.get(i, -math.inf), float((v * w).sum()))
    return {q: sorted((-s, i) for i, s in mine.items())[:k] for q, mine in best.items()}


def held(got, want, k):
    """Ranks and order are right; the share of the true neighbours that was found."""
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() <= {q for q, w in want.items() if w}
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= k
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        assert len({r.vec_id for r in rows}) == len(rows) and q not in {r.vec_id for r in rows}
        hits += len({r.vec_id for r in rows} & {i for _, i in want[q]})
    return hits / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 24))
    rows = [(i, (x * 2.0 ** rng.integers(-3, 3)).tolist()) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # copies, also of queries
    rows += [(2000 + i, (base[9] + rng.normal(size=24) * 1e-3).tolist()) for i in range(150)]
    rows += [(3000 + i, [float(v) for v in rng.integers(-1, 2, 24)]) for i in range(100)]  # many ties
    bad = [None, [], [0.0] * 24, [None] + [1.0] * 23, [math.nan] * 24, [math.inf] + [1.0] * 23, [1.0] * 5]
    return rows + [(4000 + 20 * i, v) for i, v in enumerate(bad)] + [(None, rows[0][1]), rows[3], rows[20], (40, rows[5][1])]


@pytest.mark.parametrize("kind, per_cell", [("double", 512), ("float", 4)])
def test_recall_ranks_and_odd_rows(spark, odd, kind, per_cell):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in odd]
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("clash")).repartition(3)
    got = cp.search(vectors, F.col("vec_id") % 20 == 0, per_cell=per_cell).collect()
    want = exact(rows, 20)
    assert held(got, want, 20) >= 0.9
    scores = {(q, i): -s for q, best in want.items() for s, i in best}
    for r in got:
        if (r.query_id, r.vec_id) in scores:
            assert r.score == pytest.approx(scores[r.query_id, r.vec_id], rel=1e-12, abs=1e-12)


def test_query_recall(spark, tables):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    docs = spark.createDataFrame([], "doc_id long")
    got = queries.op12_neighbours(spark, tables(docs, embeddings=vectors)).collect()
    want = exact([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    assert held(got, want, 20) >= 0.9 and len(got) == 20 * len(want)


def test_all_probes_find_everything(spark, odd):
    vectors = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = cp.search(vectors, F.col("vec_id") % 20 == 0, target=1.0, sample=10_000, tables=3).collect()
    assert held(got, exact(odd, 20), 20) == 1.0


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    ask = F.col("vec_id") % 20 == 0
    assert cp.search(spark.createDataFrame([], kind), ask).count() == 0
    assert cp.search(spark.createDataFrame([(20, [1.0, 2.0])], kind), ask).count() == 0
    assert cp.search(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], kind), ask).count() == 0
    got = cp.search(spark.createDataFrame([(20, [1.0]), (3, [2.0]), (2, [2.0]), (1, [-1.0])], kind), ask, target=1.0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 2, 2.0), (20, 2, 3, 2.0), (20, 3, 1, -1.0)]


def test_hadamard_keeps_products():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(cp.hadamard(x) @ cp.hadamard(x).T, x @ x.T)
    assert np.allclose(cp.hadamard(cp.hadamard(x)), x)
