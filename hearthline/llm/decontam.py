"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import free_name, plain_words, text_udf

LANES, TABLE_BITS = 8192, 20


@dataclass
class Searcher:
    """Patterns with as many words each, as byte strings framed by spaces, and their tables."""

    n_words: int
    patterns: list[bytes]
    items: list[list[int]]  # items that hold the pattern
    least: int  # bytes that a search window spans: the shortest pattern
    block: int
    shift: np.ndarray
    buckets: dict[int, list[int]]


def _hash(blocks: np.ndarray, block: int) -> np.ndarray:
    """Hash of the last `block` of eight bytes (little-endian, so they are the upper ones)."""
    kept = blocks >> np.uint64(8 * (8 - block))
    return ((kept * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def searcher(n_words: int, patterns: dict[bytes, set[int]]) -> Searcher:
    """Shift table: how far a window may move when its last block hashes to a cell; 0 only where a pattern's first
    `least` bytes end in that block, and those patterns lie in the block's bucket."""
    texts = sorted(patterns)
    least = min(map(len, texts))
    block = min(8, least)
    far = least - block + 1
    heads = np.frombuffer(b"".join(b"\0" * 8 + t[:least] for t in texts), np.uint8).reshape(len(texts), 8 + least)
    shift = np.full(1 << TABLE_BITS, far, np.int64)
    buckets = defaultdict(list)
    for end in range(block, least + 1):
        code = _hash(np.ascontiguousarray(heads[:, end : end + 8]).view("<u8")[:, 0], block)
        np.minimum.at(shift, code, least - end)
    for k, x in enumerate(code.tolist()):
        buckets[x].append(k)
    return Searcher(n_words, texts, [sorted(patterns[t] - {None}) for t in texts], least, block, shift, dict(buckets))


def item_windows(item_id: int, text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(number of words, framed window): all runs of `size` words, or the whole item if it has fewer but not none."""
    words = plain_words(text)
    size = min(size, len(words))
    for i in range(len(words) - size + 1 if words else 0):
        yield size, b" " + b" ".join(words[i : i + size]) + b" "


def build(items: list[tuple[int, bytes]], size: int) -> list[Searcher]:
    by_length: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        for n, window in item_windows(item_id, text, size):
            by_length[n][window].add(item_id)
    return [searcher(n, found) for n, found in sorted(by_length.items())]


def occurrences(s: Searcher, text: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
    """(end offset, pattern) of every occurrence. The text is cut into lanes that move on together, each by the shift of
    the block under its window's end; where the shift is 0 the bucket's patterns are compared directly."""
    n = len(text)
    if n < s.least:
        return []
    # eight bytes that end at an offset; eight zero bytes stand before the text
    ending = np.ndarray(n + 1, "<u8", np.concatenate([np.zeros(8, np.uint8), text]).data, strides=(1,))
    lane = max(1, -(-(n - s.least + 1) // LANES))
    at = np.arange(s.least, n + 1, lane)
    stop = np.minimum(at + lane, n + 1)
    found = []
    while len(at):
        code = _hash(ending[at], s.block)
        move = s.shift[code]
        for end, x in zip(at[move == 0].tolist(), code[move == 0].tolist()):
            start = end - s.least
            for k in s.buckets.get(x, ()):
                if raw.startswith(s.patterns[k], start):
                    found.append((start + len(s.patterns[k]), k))
        at = at + np.maximum(move, 1)
        alive = at < stop
        at, stop = at[alive], stop[alive]
    return found


def scan_batch(searchers: list[Searcher], texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """Per text: number of words, merged intervals of hit words [first, end), and items with an occurring window."""
    out = []
    for i in range(0, len(texts), 2000):
        out += _scan(searchers, texts[i : i + 2000])
    return out


def _scan(searchers, texts):
    words = [plain_words(t) for t in texts]
    framed = [b" " + b" ".join(w) + b" " for w in words]
    raw = b"\n".join(framed)  # no pattern holds the separator
    starts = np.cumsum([0] + [len(x) + 1 for x in framed])
    text = np.frombuffer(raw, np.uint8)
    hits: dict[int, list[tuple[int, int, int, Searcher]]] = defaultdict(list)
    for s in searchers:
        found = occurrences(s, text, raw)
        for (end, k), d in zip(found, (np.searchsorted(starts, [e - 1 for e, _ in found], "right") - 1).tolist()):
            hits[d].append((end - int(starts[d]), s.n_words, k, s))
    out = [(len(w), [], []) for w in words]
    for d, found in hits.items():
        spans, items, number, last = [], set(), 0, 0
        for end, n, k, s in sorted(found, key=lambda x: x[:3]):
            number += framed[d].count(b" ", last, end)
            last = end
            spans.append((number - 1 - n, number - 1))
            items.update(s.items[k])
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        out[d] = (len(words[d]), merged, sorted(items))
    return out


FOUND = "n_words long, spans array<struct<first_word:long,end_word:long>>, items array<long>"


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", out: str = "contamination", bytes_at_once: int = 16 << 20,
) -> DataFrame:
    """Add the struct `out`: n_words, spans (intervals of words inside any occurring window), items (whose windows occur).

    The benchmark is read in blocks of at most `bytes_at_once` of text; each block's tables are sent to the tasks and
    all documents pass through all blocks; driver and tasks hold the tables of all of them, some ten bytes a benchmark byte,
    so the benchmark has to fit in memory and the documents need not. Null and empty texts
    and items have no words; items shorter than a window are one window; repeated items count once per id; items
    without an id are searched but never named; texts are searched whole; empty tables give no hits; other columns pass
    through, one named like `out` is replaced.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("binary")).toLocalIterator()
    blocks, held, total = [], [], 0
    for key, value in rows:
        if value:
            held.append((key, bytes(value)))
            total += len(value)
        if total > bytes_at_once:
            blocks.append(held)
            held, total = [], 0
    if held or not blocks:
        blocks.append(held)
    previous = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(build(block, size))

        def make(shared=shared):
            known = shared.value

            def scan(texts):
                return [
                    (n, [{"first_word": a, "end_word": b} for a, b in spans], items)
                    for n, spans, items in scan_batch(known, texts)
                ]

            return scan

        name = out if previous is None else free_name(docs, "__more")
        docs = docs.withColumn(name, text_udf(make, FOUND)(F.col(text)))
        if previous is not None:
            docs = docs.withColumn(out, _both(F.col(out), F.col(name))).drop(name)
        previous = name
    return docs


def _both(a, b):
    """Two results for one text: items united, intervals merged."""
    spans = F.array_sort(F.concat(a["spans"], b["spans"]))
    empty = F.expr("cast(array() as array<struct<first_word:long,end_word:long>>)")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end_word"], x["end_word"]).alias("end_word"))
        return F.when((F.size(done) > 0) & (x["first_word"] <= F.try_element_at(done, F.lit(-1))["end_word"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.struct(
        a["n_words"].alias("n_words"), F.aggregate(spans, empty, add).alias("spans"),
        F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
    )
