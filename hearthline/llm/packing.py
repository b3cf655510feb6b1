"""Packing into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import encoder, freeing


def differencing(sizes: list[int], k: int) -> tuple[int, list[list[int]]]:
    """Karmarkar-Karp: partition items into k sets with near-equal sums; the largest sum and the item numbers per set.

    Every item starts as a partial partition of its own. The two partial partitions with the largest imbalance are
    merged, the fullest sets of one with the emptiest of the other, until one is left. Merges are noted and the sets
    read off at the end, from the last merge down.
    """
    n = len(sizes)
    if not n:
        return 0, [[] for _ in range(k)]
    sums = {}
    for i, size in enumerate(sizes):
        sums[i] = np.zeros(k, np.int64)
        sums[i][0] = size
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    for name in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]  # both descend, so imbalances oppose
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[name] = both
        merges.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), name))
    place = {2 * n - 2: np.arange(k)}
    for name in range(2 * n - 2, n - 1, -1):
        a, b, order = merges[name - n]
        at = np.empty(k, np.int64)
        at[order] = place.pop(name)
        place[a], place[b] = at, at[::-1]
    sets = [[] for _ in range(k)]
    for i in range(n):
        sets[int(place[i][0])].append(i)
    return int(sums[2 * n - 2][0]), sets


def windows(sizes: list[int], capacity: int, most: int | None = None) -> list[list[int]] | None:
    """Fewest windows that differencing fills without exceeding the capacity: the count rises until it fits. None if
    that takes more than `most`."""
    k = max(1, -(-sum(sizes) // capacity))
    while most is None or k <= most:
        largest, found = differencing(sizes, k)
        if largest <= capacity:
            return [x for x in found if x]
        k += 1
    return None


def pack_group(lengths: list[int], capacity: int, tolerance: float) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in it, length). Items are whole at first; if padding exceeds the tolerance, they are cut
    at half the size and packed again, down to a sixteenth of the capacity, where any number of windows will do."""
    total, grain = sum(lengths), capacity
    wanted = (total + max(int(tolerance * total), capacity - 1)) // capacity
    while True:
        pieces = [(i, a, min(grain, n - a)) for i, n in enumerate(lengths) for a in range(0, n, grain)]
        finest = grain <= max(1, capacity // 16)
        found = windows([p[2] for p in pieces], capacity, None if finest else wanted)
        if found is not None:
            break
        grain //= 2
    best = [[pieces[j] for j in w] for w in found]
    return [_joined(w) for w in best]


def _joined(window: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring cuts of one item that met in a window become one piece again."""
    out = []
    for i, a, n in sorted(window):
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] == a:
            out[-1] = (i, out[-1][1], out[-1][2] + n)
        else:
            out.append((i, a, n))
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group: int = 256, tolerance: float = 0.01,
    id_col: str = "doc_id", text: str = "text", cache: int = 700_000,
) -> DataFrame:
    """Cut and pack all documents; one row per piece with its ids (little-endian u32).

    Whole multiples of the capacity leave a document as full sequences; what remains of `group` documents at a time is
    packed by differencing. Groups are runs of rows within a task, so nothing is shuffled and memory is bounded by one
    group; the sequence number is the task's number times 2^33 plus a count. A retried task repeats its pieces exactly.
    Null and empty texts are one piece holding the end id; repeated rows are packed each by itself; an empty table gives
    no piece; other columns are left out. `cache` bounds the word pieces that a worker keeps (some 200 bytes each).
    """

    def run(batches):
        from pyspark import TaskContext

        known, number = encoder(tokenizer, cache), TaskContext.get().partitionId() << 33
        rows, waiting = [], []

        def flush():
            nonlocal number
            for window in pack_group([len(x[2]) // 4 - x[1] for x in waiting], capacity, tolerance):
                offset = 0
                for i, a, n in window:
                    doc, start, ids = waiting[i]
                    a += start
                    rows.append((doc, a, n, ids[4 * a : 4 * (a + n)], len(ids) // 4, number, offset))
                    offset += n
                number += 1
            waiting.clear()

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = known.encode(value.as_py() or b"") + int(end_id).to_bytes(4, "little")
                n = len(ids) // 4
                start = n // capacity * capacity
                for a in range(0, start, capacity):
                    rows.append((doc, a, capacity, ids[4 * a : 4 * (a + capacity)], n, number, 0))
                    number += 1
                if start < n:
                    waiting.append((doc, start, ids))
                if len(waiting) == group:
                    flush()
                if len(rows) > 2000:
                    yield _batch(rows)
                    rows = []
        if waiting:
            flush()
        if rows:
            yield _batch(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("binary")).mapInArrow(freeing(run), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=list(names))
