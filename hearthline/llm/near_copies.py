"""Near copies by the Jaccard similarity of word shingles: the trie self-join of SimHash fingerprints and, for what its
budget cannot reach, MinHash bands find candidates; whole shingle sets confirm them.

A Hamming budget on fingerprints cannot stand in for a similarity of 0.8 alone: such pairs differ in a dozen of 64 bits
and more, and blocks for a budget that wide are 5 bits, so nearly everything meets everything.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import each, free_name, freeing, text_udf
from hearthline.llm.simhash import LOWER, components, fingerprint, near_links
from hearthline.session import cut_lineage

#: Bands and rows a band, by round. A pair of similarity s shares a band of a round with probability 1 - (1 - s^rows)^bands:
#: at 0.8 0.99993, 0.988, 0.967 and 0.94, more above. What is left of a crowded cell after a round meets in narrower ones.
ROUNDS = ((24, 5), (24, 8), (48, 12), (98, 16))


def shingler(width: int) -> Callable[[bytes], np.ndarray]:
    """A function from a text to the sorted set of its shingles' hashes. Words as in the fingerprint; fewer words than
    a shingle: the whole sequence is the one shingle; no words: none."""
    import xxhash

    digest, known = xxhash.xxh64_intdigest, {}

    def shingles(text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > 200_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(width, len(ids))
        out = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            out = (out ^ ids[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)

    return shingles


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bander(number: int) -> Callable[[np.ndarray], list[int]]:
    """A function from a set of shingle hashes to its cells in a round."""
    import xxhash

    bands, rows = ROUNDS[number]
    rng = np.random.default_rng(42 + number)
    factors = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64)

    def cells(found: np.ndarray) -> list[int]:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        step = max(1, (1 << 19) // (bands * rows))
        for i in range(0, len(found), step):  # bounded memory for very long texts
            least = np.minimum(least, (found[i : i + step, None] * factors + shifts).min(0))
        return [_signed(xxhash.xxh64_intdigest(r.tobytes(), i)) for i, r in enumerate(least.reshape(bands, rows))]

    return cells


def _sketcher(width: int):
    def make():
        import xxhash

        shingles, cells = shingler(width), bander(0)

        def one(text: bytes) -> tuple:
            found = shingles(text)
            digest = _signed(xxhash.xxh64_intdigest(found.tobytes()))
            return digest, len(found), _signed(fingerprint(text, width)), cells(found) if len(found) else []

        return one

    return make


def _dealt_again(sets: DataFrame, number: int) -> DataFrame:
    """(digest, id, size, cell) of some sets (digest, id, size, shingles) in a later round."""

    def run(batches):
        cells = bander(number)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [cells(np.frombuffer(x.as_buffer(), np.uint64)) for x in part.column("shingles")]
                who = pa.array(np.repeat(np.arange(part.num_rows), ROUNDS[number][0]))
                named = [part.column(c).take(who) for c in ("digest", "id", "size")]
                yield pa.RecordBatch.from_arrays([*named, pa.array(np.concatenate(found), pa.int64())], names=["digest", "id", "size", "cell"])

    return sets.mapInArrow(freeing(run), "digest long, id long, size long, cell long")


def _set_maker(width: int):
    def make():
        import xxhash

        shingles = shingler(width)

        def one(text: bytes) -> tuple:
            found = shingles(text).tobytes()
            return _signed(xxhash.xxh64_intdigest(found)), found

        return one

    return make


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (small, large) whose whole shingle sets reach the similarity."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            near = [similarity(x.as_buffer(), y.as_buffer()) >= least for x, y in zip(a, b)]
            yield batch.select(["small", "large"]).filter(pa.array(near, pa.bool_()))

    one = sets.select(F.col("digest").alias("large"), F.col("shingles").alias("b"))
    two = sets.select(F.col("digest").alias("small"), F.col("shingles").alias("a"))
    return pairs.join(one, "large").join(two, "small").mapInArrow(freeing(run), "small long, large long")


def _crowded(cells: DataFrame) -> DataFrame:
    several = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    return cut_lineage(cells.join(several, "cell", "left_semi"))


def _trie_cells(sets: DataFrame, budget: int) -> DataFrame:
    """(digest, id, size, cell): a cell for each component of fingerprints that the trie self-join links."""
    some = sets.where("size > 0").select("digest", "id", "size", "bits")
    nodes = components(near_links(some.select("bits"), budget)).withColumnRenamed("node", "bits")
    root = F.coalesce("root", "bits")
    return some.join(nodes, "bits", "left").select("digest", "id", "size", F.xxhash64(F.lit("trie"), root).alias("cell"))


def near_larger(docs: DataFrame, prints: DataFrame, width: int, least: float, budget: int = 3) -> DataFrame:
    """Digests of the sets that are near one of a smaller id.

    The first round's cells are the components of fingerprints within `budget` bits and the first MinHash bands. In every cell of a round the set of the smallest id is held against the others, so a round's pairs are at most one a
    set and band however large a cell is. Sets found near leave. Where two or more others are left in a cell, they go to
    the next round, whose bands have more rows: texts alike in little part there, near ones still meet. So a set makes 24
    rows in the first round and 24, 48 and 98 at most in the others, whatever the size of its cells. A very long text is
    one set of eight bytes a different shingle.
    """
    sets = prints.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.min("bits").alias("bits"), F.first("bands").alias("bands"))
    banded = sets.select("digest", "id", "size", F.explode("bands").alias("cell"))
    cells = _crowded(_trie_cells(cut_lineage(sets.drop("bands")), budget).unionAll(banded))
    named = cells.select("digest", "id").distinct()
    texts = docs.join(named.select("id", F.col("digest").alias("want")), docs["doc_id"] == named["id"])
    made = texts.select("want", text_udf(each(_set_maker(width)), "digest long, shingles binary")(F.col("t")).alias("s"))
    made = made.where(F.col("want") == F.col("s.digest")).select("s.*")  # an id may stand on several texts
    made = cut_lineage(made.dropDuplicates(["digest"]))
    gone = None
    for number in range(len(ROUNDS)):
        hubs = cut_lineage(cells.groupBy("cell").agg(F.min(F.struct("id", "digest", "size")).alias("hub")))
        alike = F.least("size", "hub.size") >= F.greatest("size", "hub.size") * F.lit(least)
        pairs = cells.join(hubs, "cell").where((F.col("digest") != F.col("hub.digest")) & alike)
        pairs = pairs.select(F.col("hub.digest").alias("small"), F.col("digest").alias("large")).distinct()
        near = cut_lineage(confirmed(pairs, made, least).select(F.col("large").alias("digest")).distinct())
        gone = near if gone is None else gone.unionAll(near)
        if number + 1 == len(ROUNDS):
            break
        tested = hubs.select("cell", F.col("hub.digest").alias("digest"))
        left = _crowded(cells.join(tested, ["cell", "digest"], "left_anti").join(near, "digest", "left_anti"))
        if left.isEmpty():
            break
        again = left.select("digest", "id", "size").distinct().join(made, "digest")
        cells = _crowded(cut_lineage(_dealt_again(again, number + 1)))  # read twice, made once
    return gone.distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """The documents that are not found near (`least` or more of their shingles in common) one of a smaller id; all
    columns as they were, also such as clash with those used here.

    Equal shingle sets collapse before the search. Null texts and texts without words count as copies of each other. Of
    rows that repeat an id one stays. Rows without an id stay: nothing names them. An empty table stays empty.
    """
    named = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("t"))
    sketch = text_udf(each(_sketcher(width)), "digest long, size long, bits long, bands array<long>")
    prints = cut_lineage(named.select("doc_id", sketch(F.col("t")).alias("s")).select("doc_id", "s.*"))
    gone = near_larger(named, prints, width, least)
    first = prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(gone, "digest", "left_anti")
    key, n = free_name(docs, "__id"), free_name(docs, "__n")
    rows = prints.groupBy("doc_id").agg(F.count("*").alias(n))
    stay = cut_lineage(rows.join(first.select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias(key), n))
    kept = docs.join(stay, docs[id_col].cast("long") == stay[key])
    once = kept.where(F.col(n) == 1).select(docs.columns)
    repeated = kept.where(F.col(n) > 1).dropDuplicates([key]).select(docs.columns)
    return once.unionAll(repeated).unionAll(docs.where(docs[id_col].isNull()))
