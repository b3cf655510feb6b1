"""Fill-in-the-middle: a text is cut at two line ends and written as prefix, suffix, middle with a mark before each.

Lines and code points are counted by content-defined chunks. A rolling hash over sixteen bytes decides where a chunk
ends, so passages that documents share fall into equal chunks; a worker counts each chunk once and keeps the summary
under the chunk's content. The counts of a document's chunks, summed up, tell which chunk holds a cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hearthline.llm.common import struct_array

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_GEAR = np.random.default_rng(13).integers(1 << 32, size=256, dtype=np.uint32)


def chunk_ends(data: np.ndarray, bits: int = 11, longest: int = 1 << 16) -> np.ndarray:
    """Ends of the chunks of some bytes: where the hash of the last 16 bytes has `bits` zero bits, at the end, and
    after every `longest` bytes without such a place."""
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8):  # each step doubles the window; older bytes are shifted further
        rolled[step:] += rolled[:-step].copy() << np.uint32(step)
    found = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1
    edges = np.concatenate([[0], found, [len(data)]])
    wide = np.flatnonzero(np.diff(edges) > longest)
    more = [np.arange(edges[i] + longest, edges[i + 1], longest) for i in wide]
    return np.unique(np.concatenate([edges[1:], *more]).astype(np.int64))


class Summary(NamedTuple):
    content: bytes
    lines: np.ndarray  #: places just after each newline
    chars: int
    marked: bool


def _chars(data: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def summarise(chunk: bytes) -> Summary:
    lines = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + 1
    return Summary(chunk, lines, _chars(chunk), any(m in chunk for m in MARKS))


class ChunkCache:
    """Summaries by chunk content, bounded in bytes and emptied when full. A hit counts only if the content is equal."""

    def __init__(self, most: int = 64 << 20):
        self.known, self.most, self.held = {}, most, 0

    def get(self, chunk: bytes) -> Summary:
        import xxhash

        key = xxhash.xxh64_intdigest(chunk)
        found = self.known.get(key)
        if found is None or found.content != chunk:
            found = summarise(chunk)
            self.held += len(chunk) + found.lines.nbytes + 300
            if self.held > self.most:
                self.known.clear()
                self.held = len(chunk) + found.lines.nbytes + 300
            self.known[key] = found
        return found


class Counted:
    """A text with the summed counts of its chunks."""

    def __init__(self, text: bytes, cache: ChunkCache):
        self.text = text
        ends = chunk_ends(np.frombuffer(text, np.uint8)) if text else np.empty(0, np.int64)
        self.edges = np.concatenate([[0], ends]).astype(np.int64)
        parts = [cache.get(text[a:b]) for a, b in zip(self.edges.tolist(), ends.tolist())]
        self.parts = parts
        self.lines = np.cumsum([0] + [len(p.lines) for p in parts])
        self.chars = np.cumsum([0] + [p.chars for p in parts])
        self.n = int(self.lines[-1]) + (bool(text) and not text.endswith(b"\n"))
        # a mark is three bytes, so one that lies across chunks starts in the two bytes before an edge
        self.marked = any(p.marked for p in parts) or any(
            m in text[max(0, e - 2) : e + 2] for e in self.edges[1:-1].tolist() for m in MARKS
        )

    def end_of(self, line: int) -> tuple[int, int]:
        """Bytes and code points up to the end of the first `line` lines."""
        if line == 0:
            return 0, 0
        if line > self.lines[-1]:
            return len(self.text), int(self.chars[-1])
        k = int(np.searchsorted(self.lines, line)) - 1  # the chunk that holds this newline
        inside = int(self.parts[k].lines[line - int(self.lines[k]) - 1])
        return int(self.edges[k]) + inside, int(self.chars[k]) + _chars(self.parts[k].content[:inside])


def rearranged(text: bytes, draws: tuple[int, int, int, int], rate: int, spm: int, cache: ChunkCache) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    counted = Counted(text, cache)
    n = counted.n
    if not text or counted.marked or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = counted.end_of(low), counted.end_of(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if draws[3] % 100 < spm:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "fim", seed: int = 7, rate: int = 100, spm: int = 50,
) -> DataFrame:
    """Add a struct `out` (n lines, form, prefix_chars, middle_chars, output) to every row; nothing is shuffled.

    The cuts come from the sha256 of `seed:id`, so a retried task and a repeated row give the same output; `rate` in a
    hundred texts are rearranged, `spm` in a hundred of those start with the suffix. Null and empty texts stay empty
    and plain, as does a text that holds a mark. A null id is hashed as no digits. Texts of any length are counted
    chunk by chunk. An empty table stays empty; all columns stay, a column named `out` is replaced.
    """
    kind = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = ChunkCache()
        for texts, keys in batches:
            rows = []
            for value, key in zip(texts, keys.to_pylist()):
                draws = tuple(int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
                row = rearranged(value.as_py() or b"", draws, rate, spm, cache)
                rows.append((*row[:4], row[4].decode("utf-8", "replace")))
            yield struct_array(rows, arrow)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    make = F.arrow_udf(run, kind).asNondeterministic()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return docs.withColumn(out, make(F.col(text).cast("binary"), key))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. A text with marks in it is plain, so the first mark of each
    kind is the one that was put in."""
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring(x, F.length(before(x, mark)) + len(mark) + 1, F.length(x))
    p, s, m = PREFIX, SUFFIX, MIDDLE
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

