"""Nearest neighbours by cross-polytope hashing: pseudo-rotations, nearest signed axes, multiprobe tables, exact reranking.

A table turns every direction by three rounds of random signs and a fast Hadamard transform; the signed axis nearest to
the result, and in a large table a second one from another rotation, name the row's cell. A query probes the cells with
the largest coordinates over all tables. How many is read off a sample of the queries whose neighbours are found exactly.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from hearthline.session import cut_lineage


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two wide), scaled to keep lengths."""
    x, width = x.copy(), x.shape[1]
    step = 1
    while step < width:
        pairs = x.reshape(len(x), width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
        step *= 2
    return x / np.sqrt(width)


class Hasher(NamedTuple):
    """`second` is the number of axes of the second rotation, 0 for none; `bands` are the norm bands in use, largest
    first."""

    dims: int
    tables: int
    second: int
    bands: tuple[int, ...]
    seed: int = 12

    @property
    def width(self) -> int:
        return 1 << max(0, self.dims - 1).bit_length()

    @property
    def axes(self) -> tuple[int, int]:
        return 2 * self.width, max(1, 2 * self.second)

    def _turned(self, units: np.ndarray, table: int, which: int) -> np.ndarray:
        rng = np.random.default_rng((self.seed, table, which))
        x = np.zeros((len(units), self.width))
        x[:, : self.dims] = units
        for _ in range(3):
            x = hadamard(x * rng.choice([-1.0, 1.0], self.width))
        return x[:, : self.second] if which else x

    @staticmethod
    def _nearest(x: np.ndarray) -> np.ndarray:
        axis = np.abs(x).argmax(1)
        return 2 * axis + (x[np.arange(len(x)), axis] < 0)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Cell numbers (row, table), without the band."""
        first, second = self.axes
        out = np.empty((len(units), self.tables), np.int64)
        for t in range(self.tables):
            cell = self._nearest(self._turned(units, t, 0))
            if self.second:
                cell = cell * second + self._nearest(self._turned(units, t, 1))
            out[:, t] = cell + t * first * second
        return out

    def scores(self, units: np.ndarray) -> np.ndarray:
        """How promising each (band, cell) is to a query: its coordinate at the cell's axes times the band's norm."""
        signed = lambda x: np.stack([x, -x], 2).reshape(len(x), -1)
        parts = []
        for t in range(self.tables):
            score = signed(self._turned(units, t, 0))
            if self.second:
                score = (score[:, :, None] + signed(self._turned(units, t, 1))[:, None, :]).reshape(len(units), -1)
            parts.append(score)
        one = np.concatenate(parts, 1)
        top = self.bands[0]
        return np.concatenate([one * 2.0 ** ((b - top) / 2) for b in self.bands], 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares of very small or large components finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row inner products, each summed the same way wherever the row stands, so that equal vectors tie."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (queries * rows).sum(1)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query place, row place, score) of each query's k nearest rows of another id, ties to the smaller id."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ rows.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    floor = np.partition(rough, -k, 1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
    slack = 1e-12 * np.sqrt((queries * queries).sum(1) * (rows * rows).sum(1).max(initial=0.0))
    q, r = np.nonzero(rough >= np.where(np.isfinite(floor), floor - slack, -np.inf)[:, None])
    other = query_ids[q] != ids[r]
    q, r = q[other], r[other]
    score = np.concatenate([products(queries[q[i : i + 65536]], rows[r[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.empty(0)])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    start = np.searchsorted(q, q)
    keep = np.arange(len(q)) - start < k
    return q[keep], r[keep], score[keep]


def _bands(x: np.ndarray) -> np.ndarray:
    """Twice the binary logarithm of the norms, rounded; squares of very small or large components stay finite."""
    top = np.abs(x).max(1)
    return np.round(2 * np.log2(top) + np.log2(((x / top[:, None]) ** 2).sum(1))).astype(np.int32)


def usable(vectors: DataFrame, id_col: str, vector: str, is_query: Column) -> DataFrame:
    """(id, v, asks, dims, band): rows with an id and a vector of finite components, not all zero."""

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                x = _matrix(batch.column(1).take(pa.array(at)), n)  # a null component becomes nan
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                rows = batch.take(pa.array(at[good]))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(int(good.sum()), n, np.int32)), pa.array(_bands(x[good]))],
                    names=["id", "v", "asks", "dims", "band"],
                )

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kind = rows.schema["v"].dataType.simpleString()
    return rows.where("id IS NOT NULL").mapInArrow(run, f"id long, v {kind}, asks boolean, dims int, band int")


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Rows without those that k + 1 rows of the very same vector and smaller id stand before: they are nobody's
    neighbours. Each task keeps that many a vector before the shuffle."""
    copy = F.row_number().over(W.partitionBy(F.xxhash64("v"), "v").orderBy("id"))
    return rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")


def exact_nearest(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(q, id, score, v) for each of some given queries: every row is compared. One pass; a task sends k rows a query."""
    if not queries:
        return rows.select(F.col("id").alias("q"), "id", F.lit(0.0).alias("score"), "v").limit(0)
    matrix, numbers = np.array([v for _, v in queries], np.float64), np.array([i for i, _ in queries])

    def run(batches):
        for batch in batches:
            ids, table = batch.column(0).to_numpy(), _matrix(batch.column(1), matrix.shape[1])
            for i in range(0, len(ids), 8192):
                q, r, score = nearest(matrix, numbers, table[i : i + 8192], ids[i : i + 8192], k)
                yield pa.RecordBatch.from_pydict({"q": q, "id": ids[i + r], "score": score, "v": batch.column(1).take(pa.array(i + r))})

    return rows.select("id", "v").mapInArrow(run, f"q long, id long, score double, v {rows.schema['v'].dataType.simpleString()}")


def probes_for(hasher: Hasher, queries: np.ndarray, neighbours: list[np.ndarray], bands: list[np.ndarray], target: float) -> int:
    """The least number of probes that meets a share `target` of the sample's neighbours in a probed cell."""
    first, second = hasher.axes
    cells = hasher.tables * first * second
    needed = []
    for vector, near, band in zip(queries, neighbours, bands):
        if not len(near):
            continue
        score = hasher.scores(_units(vector[None]))[0]
        order = np.sort(-score)
        at = np.array([hasher.bands.index(b) for b in band])[:, None] * cells + hasher.cells(_units(near))
        needed += np.searchsorted(order, -score[at], "right").min(1).tolist()
    if not needed:
        return 1
    needed = np.sort(needed)
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])


def index_rows(rows: DataFrame, hasher: Hasher) -> DataFrame:
    """(cell, id, v) of every row in every table."""
    first, second = hasher.axes
    per_band = hasher.tables * first * second
    place = {b: i for i, b in enumerate(hasher.bands)}

    def run(batches):
        for batch in batches:
            cells = hasher.cells(_units(_matrix(batch.column(1), hasher.dims)))
            cells += np.array([place[b] for b in batch.column(2).to_pylist()], np.int64)[:, None] * per_band
            for t in range(hasher.tables):
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, t]), batch.column(0), batch.column(1)], names=["cell", "id", "v"])

    return rows.select("id", "v", "band").mapInArrow(run, f"cell long, id long, v {rows.schema['v'].dataType.simpleString()}")


def probe_rows(queries: DataFrame, hasher: Hasher, start: int, stop: int) -> DataFrame:
    """(cell, id, v, floor) of every query (id, v, floor) in each of its cells from the `start`-th best to before the
    `stop`-th."""

    def run(batches):
        size = max(1, (1 << 22) // (len(hasher.bands) * hasher.tables * hasher.axes[0] * hasher.axes[1]))
        for batch in batches:
            table = _matrix(batch.column(1), hasher.dims)
            for i in range(0, len(table), size):
                cells = np.argsort(-hasher.scores(_units(table[i : i + size])), 1, kind="stable")[:, start:stop]
                who = pa.array(i + np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *(c.take(who) for c in batch.columns)], names=["cell", "id", "v", "floor"])

    kind = queries.schema["v"].dataType.simpleString()
    return queries.select("id", "v", "floor").mapInArrow(run, f"cell long, id long, v {kind}, floor double")


class _Best:
    """Found neighbours of one task, cut to the k best of a query whenever many have come together."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((q, ids, score))
        self.n += len(q)

    def rows(self) -> pa.RecordBatch:
        q, ids, score = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        new = np.ones(len(q), bool)  # a pair met in several cells has the same score each time
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, score = q[new], ids[new], score[new]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q, ids, score)], names=["q", "id", "score"])


def search_cells(cells: DataFrame, dims: int, k: int) -> DataFrame:
    """Rows (cell, part, role, id, v, floor) sorted by cell, part and role, data before queries, to (q, id, score): the k
    best of a cell part for each query, as far as they reach its floor. A part's data are about a leaf of rows, held once;
    its queries stream by in portions."""

    def run(batches):
        best = _Best(k)
        key, data, asking = None, [], []

        def answer():
            if data and asking:
                ids, table = (np.concatenate(x) for x in zip(*data))
                numbers, vectors, floors = (np.concatenate(x) for x in zip(*asking))
                for i in range(0, len(ids), 8192):  # hashed parts may exceed the leaf a little
                    q, r, score = nearest(vectors, numbers, table[i : i + 8192], ids[i : i + 8192], k)
                    high = ~(score < floors[q])  # no floor is nan
                    best.add(numbers[q[high]], ids[i + r[high]], score[high])
            asking.clear()

        for batch in batches:
            cell, part, role, ids = (batch.column(i).to_numpy() for i in range(4))
            table, floors = _matrix(batch.column(4), dims), batch.column(5).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            edges = [0, *new.tolist(), len(cell)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if (cell[a], part[a]) != key:
                    answer()
                    data.clear()
                    key = (cell[a], part[a])
                if role[a] == 0:
                    data.append((ids[a:b], table[a:b]))
                elif data:
                    for i in range(a, b, 1024):
                        j = min(b, i + 1024)
                        asking.append((ids[i:j], table[i:j], floors[i:j]))
                        if sum(len(x[0]) for x in asking) >= 1024:
                            answer()
                if best.n > 500_000:
                    yield best.rows()
        answer()
        yield best.rows()

    return cells.mapInArrow(run, "q long, id long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best different rows with their rank; a task sends at most k rows a query."""
    once = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, target: float = 0.95,
    tables: int = 8, per_cell: int = 512, sample: int = 200, seed: int = 12,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by inner product, ties to the smaller id.

    Norms matter to an inner product and not to a hash of directions, so rows are hashed within bands of norm (half a
    binary order each) and a probe counts by coordinate times norm. The index covers every row. A second rotation is
    used once cells would hold over `per_cell` rows on average. `sample` queries, those of the least hashed id, are
    compared with all rows; the number of probes is the least that reaches `target` of their neighbours. Cells are split
    into parts of about as many rows as a task handles of the others, and a probing query is sent to each part, so a cell
    with a third of all rows is many tasks. An eighth of the probes goes first; the others answer only with rows that
    reach what those found. Of rows of one vector the k + 1 smallest ids are kept: no other can be found.

    Rows without an id, or whose vector is null, empty, zero, has a null or non-finite component or is not of the
    commonest length, take no part. Repeated ids are compared each and reported once, with the best score; an id is
    never its own neighbour. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector, is_query)
    lengths = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    dims = lengths[0].dims
    rows = rows.where(F.col("dims") == dims).drop("dims")
    wanted = cut_lineage(rows.where("asks").select("id", "v"))
    kept = cut_lineage(first_copies(rows.select("id", "v", "band"), k))
    census = kept.groupBy("band").agg(F.count("*").alias("n")).collect()  # some hundred bands at most
    drawn = wanted.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not drawn:
        return empty
    n = sum(r.n for r in census)
    width = 1 << max(0, dims - 1).bit_length()
    spare = n / per_cell / (2 * width)
    second = 0 if spare < 2 else min(width, 1 << round(np.log2(spare / 2)))
    hasher = Hasher(dims, tables, second, tuple(sorted((r.band for r in census), reverse=True)), seed)

    sample_rows = [(r.id, np.array(r.v, np.float64)) for r in drawn]
    by_score = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = exact_nearest(kept, sample_rows, k).withColumn("at", by_score).where(F.col("at") <= k).select("q", "v").collect()
    near = [[] for _ in drawn]
    for r in found:
        near[r.q].append(r.v)
    near = [np.array(x, np.float64).reshape(-1, dims) for x in near]
    probes = probes_for(hasher, np.array([v for _, v in sample_rows]), near, list(map(_bands, near)), target)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaf = int(min(8192, max(256, n * tables // (4 * tasks))))
    data = index_rows(kept, hasher)
    sizes = data.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    parts = cut_lineage(sizes.select("cell", F.ceil(F.col("n") / leaf).cast("int").alias("parts")))
    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    none = F.lit(None).cast("double")
    placed = data.join(parts, "cell", "left").select("cell", salt.alias("part"), F.lit(0).alias("role"), "id", "v", none.alias("floor"))

    def searched(queries: DataFrame, start: int, stop: int) -> DataFrame:
        probing = probe_rows(queries, hasher, start, stop).join(parts, "cell", "left")
        probing = probing.select("cell", every.alias("part"), F.lit(1).alias("role"), "id", "v", "floor")
        cells = placed.unionAll(probing).repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
        return search_cells(cells, dims, k)

    # the best cells first: what they hold is the floor for all others, which then answer with few rows
    begin = max(1, probes // 8)
    early = cut_lineage(best_of(searched(wanted.withColumn("floor", none), 0, begin), k).drop("rank"))
    floors = early.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asking = wanted.join(floors.withColumnRenamed("q", "id"), "id", "left")
    best = best_of(early.unionAll(searched(asking, begin, probes)) if probes > begin else early, k)
    return best.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
