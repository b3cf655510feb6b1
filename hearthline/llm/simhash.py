"""SimHash near-duplicates: a binary trie self-join under a Hamming error budget, then connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import each, free_name, freeing, text_udf
from hearthline.session import cut_lineage

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits: a bit is 1 if it is set in over half the XXH64 hashes of the text's word shingles, repeats included.
    Fewer words than a shingle: the whole sequence is the one shingle; no words: 0."""
    import xxhash

    words = text.translate(LOWER).split()  # bytes.split cuts at space and \t\n\v\f\r, no others
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """Add the fingerprint as a signed 64-bit column (null and empty texts: 0)."""

    def make():
        def one(value: bytes) -> tuple:
            bits = fingerprint(value, width)
            return (bits - (1 << 64) if bits >> 63 else bits,)

        return one

    return docs.withColumn(out, text_udf(each(make), "bits long")(F.col(text)).getField("bits"))


def trie_pairs(keys: np.ndarray, bits: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows with equal key whose bits differ in at most `budget` places.

    Rows are sorted by (key, bits) and distinct, so a trie node is a run of rows. All node pairs of one depth are
    traversed together: both go down by a bit, unequal branches use up one of the budget, and pairs beyond it are
    pruned with everything below them.
    """
    n = len(bits)
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    node = np.cumsum(new) - 1  # node of each row at the present depth
    u = np.arange(node[-1] + 1 if n else 0)
    v, spent = u.copy(), np.zeros(len(u), np.int8)
    size = np.bincount(node)
    keep = size[u] > 1
    u, v, spent = u[keep], v[keep], spent[keep]
    for depth in range(63, -1, -1):
        if not len(u):
            break
        bit = ((bits >> np.uint64(depth)) & np.uint64(1)).astype(np.int64)
        new[1:] |= bit[1:] != bit[:-1]
        child = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        table = np.full((node[-1] + 1, 2), -1, np.int64)
        table[node[first], bit[first]] = child[first]
        a0, a1, b0, b1 = table[u, 0], table[u, 1], table[v, 0], table[v, 1]
        other = u != v  # the cross pair of a node with itself counts once
        u2 = np.concatenate([a0, a1, a0, a1[other]])
        v2 = np.concatenate([b0, b1, b1, b0[other]])
        s2 = np.concatenate([spent, spent, spent + 1, spent[other] + 1]).astype(np.int8)
        alive = (u2 >= 0) & (v2 >= 0) & (s2 <= budget)
        u, v, spent = u2[alive], v2[alive], s2[alive]
        node = child
        size = np.bincount(node)
        alone = (u == v) & (size[u] == 1)
        u, v, spent = u[~alone], v[~alone], spent[~alone]
    return np.minimum(u, v), np.maximum(u, v)  # at the last depth a node is a row


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) for the rows of each connected set of links, without the roots themselves."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _joiner(budget: int, rows_at_once: int = 16_384):
    """A task's rows (cell, bits), sorted by cell, to links that connect what the trie join connects in each cell."""

    def linked(cells, bits):
        order = np.lexsort((bits, cells))
        cells, bits = cells[order], bits[order]
        i, j = trie_pairs(cells, bits, budget)
        if len(i):
            a, b = spanning(i, j, len(bits))
            yield pa.RecordBatch.from_pydict({"a": bits[a].view(np.int64), "b": bits[b].view(np.int64)})

    def run(batches):
        cells, bits = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            bits = np.concatenate([bits, batch.column(1).to_numpy().view(np.uint64)])
            while len(cells) > rows_at_once:
                cut = int(np.searchsorted(cells, cells[rows_at_once]))  # whole cells only; one is at most a leaf
                cut = cut or int(np.searchsorted(cells, cells[0], "right"))
                if cut == len(cells):
                    break
                yield from linked(cells[:cut], bits[:cut])
                cells, bits = cells[cut:], bits[cut:]
        if len(cells):
            yield from linked(cells, bits)

    return run


def near_links(prints: DataFrame, budget: int = 2, leaf: int = 4096) -> DataFrame:
    """Links (a, b) that connect all distinct 64-bit values of `prints.bits` differing in at most `budget` bits.

    Two such values agree in one of budget + 1 blocks of bits, so each value goes to that many cells, and the trie join
    runs inside a cell. A cell with more than `leaf` values is dealt again by blocks of the bits it leaves open, and so
    on: every level leaves fewer bits open, so cells end up bounded by 2^open. No value is dropped at any size. A cell
    gives at most one link a value, never all pairs.
    """
    parts, width = budget + 1, 64
    rows = prints.select(F.col("bits"), F.col("bits").alias("rest"), F.lit(0).cast("long").alias("cell")).distinct()
    found = []
    while True:
        edges = [i * width // parts for i in range(parts + 1)]
        open_ = width - width // parts
        dealt = []
        for i in range(parts):
            low, high = edges[i], edges[i + 1]
            block = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")) if high > low else F.lit(0).cast("long")
            below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1).cast("long"))
            above = F.shiftleft(F.shiftrightunsigned("rest", high), low) if high < 64 else F.lit(0).cast("long")
            dealt.append(F.struct(F.xxhash64("cell", F.lit(i), block).alias("cell"), below.bitwiseOR(above).alias("rest")))
        rows = rows.select("bits", F.explode(F.array(*dealt)).alias("x")).select("bits", "x.cell", "x.rest")
        if 2**open_ <= leaf:
            large = None
        else:
            large = cut_lineage(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("cell"))
            large = None if large.isEmpty() else large
        small = rows if large is None else rows.join(large, "cell", "left_anti")
        small = small.select("cell", "bits").repartition("cell").sortWithinPartitions("cell")
        found.append(small.mapInArrow(freeing(_joiner(budget)), "a long, b long"))
        if large is None:
            break
        rows, width = cut_lineage(rows.join(large, "cell", "left_semi").select("bits", "rest", "cell")), open_
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) for every node, root being its smallest node.

    Alternates large-star and small-star steps: every node points its larger neighbours at the smallest one it knows,
    then its smaller neighbours. Each step is two aggregates with map-side combine; the number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        # large star: all larger neighbours of u go to the least of u and its neighbours
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))
        )
        edges = cut_lineage(small.where("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 2, width: int = 3, leaf: int = 4096
) -> DataFrame:
    """One row per row of `docs`: doc_id, bits (signed 64-bit fingerprint), component_id (smallest id reachable).

    Equal fingerprints collapse before the join, so a group of copies costs one value however large it is; labels come
    back by a join on the fingerprint that skew handling can split. Texts without words share fingerprint 0 and link
    like any other; rows with a null id take the component of their fingerprint but never name one; repeated rows each
    come back; an empty table stays empty; other columns are left out.
    """
    prints = add_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")), "t", "bits", width)
    prints = cut_lineage(prints.select("doc_id", "bits"))
    groups = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    nodes = components(near_links(groups.select("bits"), budget, leaf))
    rooted = groups.join(nodes.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("bits", "component_id")
    return prints.join(labels, "bits").select("doc_id", "bits", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 2, width: int = 3) -> DataFrame:
    """The documents with the smallest id of their group; all columns as they were. Of rows that repeat that id one
    stays. Rows without an id stay: nothing names them."""
    found = near_duplicates(docs, id_col, text, budget, width)
    least = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    key, n = free_name(docs, "__id"), free_name(docs, "__n")
    least = cut_lineage(least.select(F.col("doc_id").alias(key), F.col("n").alias(n)))
    kept = docs.join(least, docs[id_col].cast("long") == least[key])
    once = kept.where(F.col(n) == 1).select(docs.columns)
    repeated = kept.where(F.col(n) > 1).dropDuplicates([key]).select(docs.columns)
    return once.unionAll(repeated).unionAll(docs.where(docs[id_col].isNull()))
