"""Helpers shared by the training-data operators: Arrow text UDFs, ASCII words, exact chunk-cached tokenizing."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased, as a byte table: everything else becomes a space.
#: UTF-8 bytes of other scripts are all 0x80 or more and stay.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_uri(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: one without is on the cluster's default file system, as Spark itself reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and all non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def struct_array(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    columns = list(zip(*rows)) if rows else [()] * kind.num_fields
    fields = [kind.field(i) for i in range(kind.num_fields)]
    return pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], fields=fields)


def give_back() -> None:
    """Return memory that this process no longer uses to the system: Spark keeps workers from stage to stage, and what a
    finished task freed counts against the next one's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives back its memory when its task ends."""

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return freed


def text_udf(make: Callable[[], Callable[[list[bytes]], list[tuple]]], ddl: str) -> Callable[[Column], Column]:
    """A scalar Arrow UDF from a text column (null: empty) to a struct. `make()` runs once per task and returns a
    function from a list of UTF-8 texts to as many tuples. Other columns never enter Python."""
    kind = T.StructType.fromDDL(ddl)
    arrow = to_arrow_type(kind)

    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for batch in batches:
            yield struct_array(apply([x or b"" for x in batch.to_pylist()]), arrow)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from freeing(rows)(batches)

    # the kind is passed by name: annotations are strings in this module
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, kind).asNondeterministic()  # evaluated once, never duplicated by the optimizer
    return lambda text: udf(text.cast("binary"))


def each(make: Callable[[], Callable[[bytes], tuple]]) -> Callable[[], Callable[[list[bytes]], list[tuple]]]:
    """Lift a per-text function to lists."""

    def many() -> Callable[[list[bytes]], list[tuple]]:
        one = make()
        return lambda texts: [one(x) for x in texts]

    return many


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not use yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


class Encoder:
    """Byte-level BPE ids of whole texts through the tokenizers library.

    Such a tokenizer never merges across a single space between two non-blank characters, so a text is cut there and
    each distinct piece encoded once. Pieces of plain Latin words, digits and marks are runs that the model tokenizes
    one by one; all others go through the whole tokenizer. Both caches are bounded; a full one is emptied.
    """

    #: white space of any script except the space and \n (a superset of what the tokenizer's pattern calls \s)
    ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    CUT = re.compile(r"(?<=\S)(?= \S)")
    LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "!-&(-/:-@\\[-`{-~"  # marks: ASCII without the apostrophe
    PLAIN = re.compile(f" ?[{LETTERS}0-9{MARKS}]+(?:\n[{LETTERS}0-9{MARKS}]+)*")
    RUNS = re.compile(f" ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n")

    def __init__(self, path: str, entries: int = 200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the strings of special tokens are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        # the library's own letters for bytes, found by asking it
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        ascii_ = {chr(b): level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        high = {chr(b): level.pre_tokenize_str(chr(b))[0][0] for b in range(128, 256)}
        self.letters = str.maketrans(ascii_ | high)
        self.entries, self.known, self.runs = entries, {}, {}

    def _slow(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not self.PLAIN.fullmatch(piece):
            return self._slow(piece)
        out = []
        for run in self.RUNS.findall(piece):
            ids = self.runs.get(run)
            if ids is None:
                if len(self.runs) >= self.entries:
                    self.runs.clear()
                found = self.model.tokenize(run.translate(self.letters))
                ids = self.runs[run] = array("I", [x.id for x in found]).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        text = text.decode("utf-8", "replace")
        if not text:
            return b""
        pieces = text.split(" ")
        if "" in pieces or "\n " in text or " \n" in text or self.ODD.search(text):
            head, *pieces = self.CUT.split(text)
            pieces = [x[1:] for x in pieces]
        else:
            head, *pieces = pieces
        known = self.known
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > self.entries:
                known.clear()
                new = set(pieces)
            known.update((x, self._piece(" " + x)) for x in new)
        return self._piece(head) + b"".join(map(known.__getitem__, pieces))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, entries: int) -> Encoder:
    """One encoder per worker process, vocabulary file and cache size, so that reused workers keep their cache."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, entries) not in _ENCODERS:
        _ENCODERS[path, entries] = Encoder(path, entries)
    return _ENCODERS[path, entries]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
