"""Token files and packing: exact round trips."""

import io
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hearthline.llm import packing, queries, token_files
from hearthline.llm.common import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def whole():
    known = Encoder(tokenizer_path()).tokenizer
    return lambda text: known.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_equals_the_library(rows, whole):
    known = Encoder(tokenizer_path(), entries=50)  # the caches are emptied again and again
    extra = ["  a  b ", " \n x", "it's 'll d'", "a\t b", "x 　 y", "汉字 a1²b <|endoftext|>.\n\nß", " ", "\n", "a\nb c.\nD"]
    for text in [r[1] for r in rows if len(r[1] or "") < 10_000] + extra:
        got = np.frombuffer(known.encode((text or "").encode()), "<u4").tolist()
        assert got + [0] == whole(text), text


def test_token_files_give_back_all_ids(tables, rows, whole, spark):
    found = queries.op3_token_files(spark, tables()).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for r in order:
        ids = whole(r[1])
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([tuple(r) for r in found], key=key) == sorted(want, key=key)


def test_reader_touches_only_wanted_frames():
    out = io.BytesIO()
    writer = token_files.Writer(out, 2, frame_ids=100)
    docs = [(7, np.arange(950)), (8, np.array([], int)), (9, np.arange(30)), (9, np.arange(5)), (None, np.arange(3))]
    for key, ids in docs:
        writer.add(key, ids)
    writer.close()
    data = bytearray(out.getvalue())
    reader = token_files.Reader(io.BytesIO(bytes(data)))
    assert len(reader.sizes) == 10 and [x.tolist() for x in reader.find(9)] == [list(range(30)), list(range(5))]
    assert [reader.ids(k).tolist() for k in range(5)] == [x.tolist() for _, x in docs]
    data[int(reader.places[2]) + 20] ^= 255  # damage to one frame
    damaged = token_files.Reader(io.BytesIO(bytes(data)))
    assert damaged.ids(2).tolist() == list(range(30))
    with pytest.raises(Exception):
        damaged.ids(0)
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(bytes(data[:-1])))


def test_packing_covers_every_id_once(tables, rows, whole, spark):
    found = queries.op6_packing(spark, tables()).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_window[r.sequence_id].append((r.offset, r.length))
    for key, text in {r[0]: r[1] for r in rows}.items():
        times = sum(r[0] == key for r in rows)
        ids = whole(text)
        covered = np.zeros(len(ids), int)
        for start, n, check, total in by_doc[key]:
            assert check == crc(ids[start : start + n]) and total == len(ids) and n > 0
            covered[start : start + n] += 1
        assert (covered == times).all()
    full = 0
    for pieces in by_window.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
        full += at
    assert full == sum(len(whole(r[1])) for r in rows)


def test_differencing_is_balanced():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (3, 5), (40, 7), (200, 60)):
        sizes = rng.integers(1, 1000, n).tolist()
        largest, sets = packing.differencing(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(n)) and len(sets) == k
        sums = [sum(sizes[i] for i in s) for s in sets]
        assert max(sums) - min(sums) <= max(sizes) and max(sums) == largest
    assert packing.differencing([8, 7, 6, 5, 4], 2)[0] == 16  # the textbook case: 16 and 14
    assert packing.differencing([], 3)[1] == [[], [], []]
    for _ in range(5):
        lengths = rng.integers(1, 1024, 256).tolist()
        found = packing.pack_group(lengths, 1024, 0.01)
        assert all(sum(p[2] for p in w) <= 1024 for w in found)
        assert len(found) * 1024 <= 1.03 * sum(lengths) + 1024


def test_packing_an_empty_table(empty, tmp_path):
    assert packing.pack(empty, tokenizer_path()).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(empty, f"file://{tmp_path}/tokens", tokenizer_path())).count() == 0
