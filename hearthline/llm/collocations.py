"""Phrase collocations by top-order marginalisation.

Only windows of the longest order are counted: every word starts one, padded where its piece ends sooner. One ROLLUP over
the window's columns then sums them to every shorter prefix, and so counts phrases of all lengths (each occurrence of a
phrase is the prefix of exactly one window) and, at its top, all words of a language.

A window is padded earlier where it cannot matter: sketches count hashed words and pairs, then longer runs of pairs that
passed, never too low. A run that even so stays below the least count is no candidate and stands in none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

#: A-Z lower-cased, `[.,;:!?\x0A-\x0D]` made newlines, tabs made blanks.
TABLE = bytes(
    10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b"\t " else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)
_END = re.compile(rb"[.,;:!?\n-\r]")
BLOCK = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _portions(texts: Iterator[tuple[str, bytes]], size: int) -> Iterator[list[tuple[str, bytes]]]:
    """Lists of (lang, text) of about `size` bytes; a longer text is cut where a piece ends, so no phrase is."""
    held, n = [], 0
    for lang, text in texts:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > size and (found := _END.search(text, at + size)):
                end = found.end()
            held.append((lang, text[at:end]))
            n += end - at
            at = end
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


class Words:
    """The words of a portion: `code` numbers them in `names`, `go` says whether the next word follows in the same piece,
    `lang` numbers the languages in `langs`."""

    def __init__(self, portion: list[tuple[str, bytes]]):
        import xxhash

        joined = b"\n".join(text for _, text in portion).translate(TABLE)
        data = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = (data != 32) & (data != 10)
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.n = len(starts)
        piece = np.cumsum(data == 10, dtype=np.int64)[starts] if self.n else np.empty(0, np.int64)
        self.go = np.append(piece[1:] == piece[:-1], False)[: self.n]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        compact = data[inside[1:-1].astype(bool)]
        every = pa.Array.from_buffers(pa.string(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(compact))])
        coded = every.dictionary_encode()
        self.code, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.langs = sorted({lang for lang, _ in portion})
        places = {lang: i for i, lang in enumerate(self.langs)}
        begin = np.cumsum([0] + [len(text) + 1 for _, text in portion[:-1]])
        doc = np.searchsorted(begin, starts, "right") - 1
        self.lang = np.array([places[lang] for lang, _ in portion], np.int64)[doc]
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(x.as_buffer()) for x in self.names] or [0], np.uint64)
        self.salts = np.array([digest(x.encode()) for x in self.langs] or [0], np.uint64)
        self.hash = self.hashes[self.code] * _MIX[0] + self.salts[self.lang]

    def cells(self, bits: int, orders: int) -> Iterator[np.ndarray]:
        """For 1, 2, .. `orders` words, the cell of the run that starts at each word (of no meaning beyond a piece)."""
        shift = np.uint64(64 - bits)
        one = self.hash ^ (self.hash >> np.uint64(31))
        run = one
        for k in range(orders):
            if k:
                after = np.zeros_like(one)
                after[: max(0, self.n - k)] = one[k:]
                run = (run * _MIX[1]) ^ (after * _MIX[2])
                run ^= run >> np.uint64(29)
            yield (run * _MIX[0]) >> shift

    def marks(self, bits: int) -> np.ndarray:
        """Another cell of every word, for words that stand in a pair that passed."""
        return ((self.hash ^ (self.hash >> np.uint64(31))) * _MIX[2]) >> np.uint64(64 - bits)


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    def texts():
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield lang, text.as_py()

    return map(Words, _portions(texts(), size))


class Sketches:
    """Bitmaps of the cells that may stand often enough: `short` for words and pairs, `long` for longer runs."""

    def __init__(self, bits: int, short: bytes, long: bytes | None = None):
        self.bits = bits
        self.flags = [np.frombuffer(x, np.uint8) for x in (short, long) if x is not None]

    def hit(self, k: int, cells: np.ndarray) -> np.ndarray:
        flags = self.flags[0 if k <= 2 else 1]
        return (flags[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _follow(words: Words, k: int) -> np.ndarray:
    """Whether the word k - 2 places on and the one after it stand in one piece; none does beyond the end."""
    out = np.zeros(words.n, bool)
    out[: max(0, words.n - k + 2)] = words.go[k - 2 :]
    return out


def frequent_cells(docs: DataFrame, least: int, bits: int, portion: int, order: int, known=None) -> bytes:
    """A bit a cell: whether runs of words that hash there may stand `least` times. (lang, text) rows. Without `known`
    (a broadcast of the first bitmap) words and pairs are counted, with it runs of three to `order` words whose pairs are
    all known, and the words of known pairs are marked.

    A task counts in one array, up to `least` a cell; the arrays go out in blocks, and whoever gets a block adds its rows
    up as they stream by. What comes back has 2^bits / 8 bytes, whatever the corpus.
    """
    top = min(least, 255)

    def found(words: Words) -> Iterator[tuple[np.ndarray, int]]:
        sketch = Sketches(bits, known.value) if known else None
        alive = np.ones(words.n, bool)
        for k, cells in enumerate(words.cells(bits, order if known else 2), 1):
            if k > 1:
                alive = alive & _follow(words, k)
            if sketch and k == 2:
                pair = np.append(sketch.hit(2, cells), np.zeros(order, bool))
                alive = alive & pair[: words.n]
                at = np.flatnonzero(alive)
                yield words.marks(bits)[np.concatenate([at, at + 1])], top
            elif sketch and k > 2:
                alive = alive & pair[k - 2 : k - 2 + words.n]
            if not sketch or k > 2:
                yield cells[alive], 1

    def count(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        counts = np.zeros(1 << bits, np.uint8)
        for words in _read(batches, portion):
            for cells, each in found(words):
                cells, n = np.unique(cells, return_counts=True)
                counts[cells] = np.minimum(counts[cells] + n * each, top)
        used = np.flatnonzero(counts.reshape(-1, BLOCK).any(1))
        for i in range(0, len(used), 1000):
            some = used[i : i + 1000]
            rows = [pack(counts[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in some.tolist()]
            yield pa.RecordBatch.from_pydict({"block": some.astype(np.int64), "counts": pa.array(rows, pa.binary())})

    def add(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        block, total = -1, None
        done = lambda: pa.RecordBatch.from_pydict(
            {"block": [block], "bits": [np.packbits(total >= top, bitorder="little").tobytes()]}
        )
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != block:
                    if total is not None:
                        yield done()
                    block, total = b, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(unpack(counts.as_buffer()), np.uint8)
        if total is not None:
            yield done()

    parts = docs.mapInArrow(count, "block long, counts binary").repartition("block").sortWithinPartitions("block")
    out = bytearray((1 << bits) // 8)
    width = BLOCK // 8
    for row in parts.mapInArrow(add, "block long, bits binary").toLocalIterator():
        out[row.block * width : (row.block + 1) * width] = row.bits
    return bytes(out)


def _window_rows(words: Words, sketch: Sketches, order: int, blocks: int = 64) -> pa.Table:
    """The windows of one portion with their counts and the block that a window belongs to, the same in every task."""
    langs = pa.array(words.langs, pa.string())
    columns, codes = [], np.full((order, words.n), -1, np.int64)
    alive = np.ones(words.n, bool)
    for k, cells in enumerate(words.cells(sketch.bits, order), 1):
        if k > 1:
            alive = alive & _follow(words, k)
        alive = alive & sketch.hit(k, cells)
        if k == 1:
            alive = alive & sketch.hit(3, words.marks(sketch.bits))
        at = np.flatnonzero(alive)
        codes[k - 1, at] = words.code[at + k - 1]
        if k == 1:
            known = alive
    rare = np.bincount(words.lang[~known], minlength=len(words.langs))
    lang, codes = words.lang[known], codes[:, known]
    keys = words.salts[lang] * _MIX[1]
    for column in codes:
        keys = (keys ^ np.where(column < 0, np.uint64(0), words.hashes[column])) * _MIX[0]
        keys ^= keys >> np.uint64(29)
    block = ((keys >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    _, first, place, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if not ((lang == lang[first][place]).all() and (codes == codes[:, first[place]]).all()):
        first, n = np.arange(len(lang)), np.ones(len(lang), np.int64)  # two windows share a key: count none together
    columns = [words.names.take(pa.array(c[first], pa.int64(), mask=c[first] < 0)) for c in codes]
    rows = np.flatnonzero(rare)
    blank = [pa.nulls(len(rows), pa.string())] * order
    names = ["block", "lang", *(f"w{k + 1}" for k in range(order)), "n"]
    at = pa.array(np.zeros(len(rows), np.int64))
    return pa.concat_tables([
        pa.Table.from_arrays([pa.array(block[first]), langs.take(pa.array(lang[first])), *columns, pa.array(n)], names=names),
        pa.Table.from_arrays([at, langs.take(pa.array(rows)), *blank, pa.array(rare[rows])], names=names),
    ])


def _together(tables: list[pa.Table]) -> pa.Table:
    """Equal windows as one row."""
    table = pa.concat_tables(tables)
    names = [c for c in table.column_names if c != "n"]
    return table.group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"])


def windows(
    docs: DataFrame, order: int, short, long, bits: int, portion: int, rows_at_once: int = 400_000, blocks: int = 64
) -> DataFrame:
    """Rows (lang, w1 .. w<order>, n): the padded longest windows, equal ones counted together. Words too rare for any
    phrase are counted in a window of no words. `short` and `long` are broadcasts of `frequent_cells`.

    Most windows stand in every task, so a row for each task and window would grow with tasks times windows. A task
    sends the windows of a block as one packed row; whoever gets a block adds its windows up as they stream by.
    """
    words_ = [f"w{k + 1}" for k in range(order)]

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        sketch, held, n, limit = Sketches(bits, short.value, long.value), [], 0, rows_at_once

        def packed(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by("block").combine_chunks()
            used, first = np.unique(table.column("block").to_numpy(), return_index=True)
            table, ends = table.drop_columns(["block"]), [*first[1:].tolist(), len(table)]
            rows = [pack(table.slice(a, b - a).to_batches()[0].serialize()) for a, b in zip(first.tolist(), ends)]
            return pa.RecordBatch.from_pydict({"block": used, "windows": pa.array(rows, pa.binary())})

        for words in _read(batches, portion):
            held.append(_window_rows(words, sketch, order, blocks))
            n += len(held[-1])
            if n > limit:
                held = [_together(held)]
                n = len(held[0])
                if n > limit // 2:  # mostly different ones: send them on
                    yield packed(held[0])
                    held, n = [], 0
        if n:
            yield packed(_together(held))

    def add(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.schema([("lang", pa.string()), *((w, pa.string()) for w in words_), ("n", pa.int64())])
        block, held, n, limit = -1, [], 0, rows_at_once
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != block:
                    if held:
                        yield from _together(held).to_batches(50_000)
                    block, held, n, limit = b, [], 0, rows_at_once
                some = pa.ipc.read_record_batch(pa.py_buffer(unpack(data.as_buffer())), kind)
                held.append(pa.Table.from_batches([some]))
                n += len(some)
                if n > limit:
                    held = [_together(held)]
                    n = len(held[0])
                    limit = 2 * n + rows_at_once
        if held:
            yield from _together(held).to_batches(50_000)

    parts = docs.mapInArrow(run, "block long, windows binary").repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(add, ", ".join(["lang string", *(f"{w} string" for w in words_), "n long"]))


def phrase_counts(docs: DataFrame, order: int = 5, least: int = 100, lang: str = "lang", text: str = "text", portion: int = 8 << 20) -> DataFrame:
    """(lang, words, f): every phrase of 2 to `order` words met `least` times or more, every word of one, and per language
    one row without words whose f counts all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(28, max(16, int(size // 32).bit_length()))
    share = spark.sparkContext.broadcast
    short = share(frequent_cells(rows, least, bits, portion, order))
    long = share(frequent_cells(rows, least, bits, portion, order, short))
    columns = [f"w{k + 1}" for k in range(order)]
    blocks = max(64, size >> 29)
    counted = windows(rows, order, short, long, bits, portion, blocks=blocks).rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("summed"))
    # a bit of `summed` is set for each column that is summed over
    level = counted.where("lang IS NOT NULL").withColumn("k", order - F.bit_count("summed"))
    full = F.array(*columns)
    phrases = level.where((F.col("k") == 0) | (F.col("f") >= least)).select("lang", F.slice(full, F.lit(1), F.col("k")).alias("words"), "f", "k")
    padded = F.exists("words", lambda w: w.isNull())
    return phrases.where(~padded).select("lang", "words", "f")


def exact_score() -> Column:
    """floor(1000 a n / (l r)) of four long columns; decimals hold the products up to counts of 10^17."""
    wide = lambda c: f"CAST({c} AS decimal(17, 0))"
    return F.expr(f"(CAST(1000 AS decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")


def collocations(
    docs: DataFrame, order: int = 5, least: int = 100, top: int = 2000, lang: str = "lang", text: str = "text", portion: int = 8 << 20,
) -> DataFrame:
    """Each language's `top` phrases of 2 to `order` words: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and its two parts at the cut with the lowest score, n all words; the score is
    floor(1000 a n / (l r)) in exact decimals. A phrase inside a longer candidate that is met as often is left out. Null
    languages are `und`, null and empty texts have no words; repeated rows count each time; texts of any length are read
    whole, in portions cut where a piece ends; other columns are ignored; an empty table gives no rows. Counting shuffles
    pre-counted windows packed by block; all later steps see phrases that passed `least`, joined by phrase, and the ranking first takes
    `top` from each of many parts of a language.
    """
    found = cut_lineage(phrase_counts(docs, order, least, lang, text, portion))
    totals = found.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    phrases = found.where(F.size("words") > 0)
    candidates = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = candidates.select("lang", "words", "a", cut)
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("right", F.slice("words", F.col("k") + 1, F.size("words")))
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    lowest = cuts.groupBy("lang", "words").agg(F.min(F.struct(exact_score().alias("score"), "k", "a", "l", "r", "n")).alias("x"))
    # parts of a candidate of every length between two words and its own
    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size)),
    ))).alias("words")
    longer = candidates.where(F.size("words") > 2).select("lang", inner, F.col("a").alias("longer"))
    covering = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    left = lowest.join(covering, ["lang", "words"], "left").where("longer IS NULL OR longer < x.a")
    rows = left.select("lang", F.array_join("words", " ").alias("phrase"), "x.a", "x.l", "x.r", "x.n", "x.score")
    order_ = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order_))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order_)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
