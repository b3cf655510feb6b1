"""Token files: independent zstandard frames of ids, a document index and a trailing seek table with checksums.

Layout of one file, all integers little-endian:
  frames      each the ids of a fixed number of tokens (the last may hold fewer), compressed on its own
  index       a skippable frame: format version, bytes per id, number of documents, then a zstandard frame holding the
              document ids, a null mark each, and their token counts
  seek table  a skippable frame as in the public seekable format: compressed size, size and checksum of every frame,
              then the number of frames, a descriptor byte and the magic number
A reader takes the last bytes, finds the seek table, and decompresses only the frames that hold the ids it wants.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import encoder
from hearthline.session import cut_lineage

#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS, VERSION = 1 << 16, 1


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes ids of documents one after the other; holds one frame and the index."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.out, self.width, self.limit = out, width, 4 * frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.waiting, self.held, self.frames, self.ids, self.null, self.counts = [], 0, [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray | bytes) -> None:
        """`ids` as numbers, or as the bytes of little-endian unsigned 32-bit ones."""
        if not isinstance(ids, bytes):
            ids = ids.astype("<u4").tobytes()
        self.ids.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.limit:
            data, start = memoryview(b"".join(self.waiting)), 0
            while len(data) - start >= self.limit:
                self._frame(data[start : start + self.limit])
                start += self.limit
            self.waiting, self.held = [bytes(data[start:])], len(data) - start

    def _frame(self, data) -> None:
        data = np.frombuffer(data, "<u4").astype(f"<u{self.width}").tobytes()
        packed = self.pack(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), _checksum(data)))

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.waiting))
        columns = np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.counts, "<u8").tobytes()
        body = struct.pack("<BBQ", VERSION, self.width, len(self.ids)) + self.pack(columns)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        table += struct.pack("<QIBI", 8 + len(body), len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class Reader:
    """Random access to a token file given as a seekable binary file."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(0, 2)
        end = file.tell()
        index_size, n, flag, magic = struct.unpack("<QIBI", self._at(end - 17, 17))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file, or a truncated one")
        at = end - 17 - 12 * n
        table = np.frombuffer(self._at(at, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.lengths, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.places = np.cumsum(self.sizes) - self.sizes
        body = self._at(at - 8 - index_size, index_size)[8:]
        version, self.width, docs = struct.unpack("<BBQ", body[:10])
        if version != VERSION:
            raise ValueError(f"format version {version} is not known")
        columns = self.unpack(body[10:], max_output_size=17 * docs)
        self.doc_ids = np.frombuffer(columns, "<i8", docs)
        self.null = np.frombuffer(columns, "u1", docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(columns, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.ends = np.cumsum(self.lengths) // self.width
        self.last = (-1, np.empty(0, np.uint32))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def _frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            data = self.unpack(self._at(int(self.places[k]), int(self.sizes[k])), max_output_size=int(self.lengths[k]))
            if _checksum(data) != self.sums[k]:
                raise ValueError(f"checksum of frame {k} does not fit")
            self.last = (k, np.frombuffer(data, f"<u{self.width}").astype("<u4"))
        return self.last[1]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; touches the frames that hold them and no others."""
        start, end = int(self.starts[k]), int(self.starts[k] + self.counts[k])
        parts, at = [], int(np.searchsorted(self.ends, start, "right"))
        while start < end:
            first = int(self.ends[at - 1]) if at else 0
            stop = min(end, int(self.ends[at]))
            parts.append(self._frame(at)[start - first : stop - first])
            start, at = stop, at + 1
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of all documents with that id (they lie next to each other, ids ascend)."""
        return [self.ids(k) for k in np.flatnonzero((self.doc_ids == doc_id) & ~self.null)]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text",
    frame_ids: int = FRAME_IDS, cache: int = 700_000,
) -> DataFrame:
    """Encode every whole text, append `end_id`, and write one file per range of ids, ascending.

    Returns the manifest (file, part, n_docs, n_tokens, bytes), checkpointed: it names only files of finished tasks, so
    a repeated attempt after a lost executor leaves an unnamed file behind and nothing twice. `folder` is a URI that
    all executors can write. Null and empty texts become the end id alone; null ids come first; repeated ids keep all
    their rows, ordered by the text's hash; an empty table gives no file. One id with very many rows is still
    split over files, since the ranges are cut on (id, hash).
    """
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def write(batches):
        known, writer, stream = encoder(tokenizer, cache), None, None
        width = 2 if known.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4
        end = int(end_id).to_bytes(4, "little")
        name = f"{folder}/{uuid.uuid4().hex}.tok"
        n = 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    store, at = _open(name)
                    stream = store.open_output_stream(at)
                    writer = Writer(stream, width, frame_ids)
                ids = known.encode(value.as_py() or b"") + end
                writer.add(doc_id, ids)
                n += len(ids) // 4
        if writer is not None:
            from pyspark import TaskContext

            writer.close()
            size = stream.tell()
            stream.close()
            row = {"file": [name], "part": [TaskContext.get().partitionId()], "n_docs": [len(writer.ids)], "n_tokens": [n], "bytes": [size]}
            yield pa.RecordBatch.from_pydict(row)

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), F.col(text).cast("binary").alias("t"), F.xxhash64(F.col(text)).alias("h"))
    ranged = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "t")
    return cut_lineage(ranged.mapInArrow(write, "file string, part long, n_docs long, n_tokens long, bytes long"))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32) and
    ids_crc32 (of those bytes); `with_ids=False` leaves the ids where they are read.

    Reads the files back, one per task. The driver sees one small row per file to add up the starts.
    """
    totals = sorted(((r.part, r.file, r.n_tokens) for r in manifest.select("part", "file", "n_tokens").collect()))
    base, at = {}, 0
    for _, file, n in totals:
        base[file], at = at, at + n

    def read(batches):
        from zlib import crc32

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _open(name)
                with fs.open_input_file(path) as file:
                    reader, rows, held = Reader(file), [], 0
                    for k in range(len(reader.counts)):
                        doc, ids = None if reader.null[k] else int(reader.doc_ids[k]), np.ascontiguousarray(reader.ids(k))
                        rows.append((doc, base[name] + int(reader.starts[k]), len(ids), crc32(ids), ids.tobytes() if with_ids else None))
                        held += ids.nbytes if with_ids else 256
                        if held > 8 << 20:
                            yield _rows(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, with_ids)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return manifest.select("file").mapInArrow(read, kinds + (", ids binary" if with_ids else ""))


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names, columns = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"], list(zip(*rows))
    kinds = [pa.int64()] * 4 + [pa.binary()]
    n = 5 if with_ids else 4
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns[:n], kinds)], names=names[:n])
