"""Fill-in-the-middle against a plain line loop."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import fim, queries


def plain(doc_id, text):
    text = text or ""
    parts = text.split("\n")
    units = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    key = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def many(rows):
    rng = random.Random(3)
    line = lambda: rng.choice(["", "é", "ab", "ñ" * 50, "x <P", "S> y", "  z", "🙂🙂", "\r"])
    texts = ["\n".join(line() for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts += ["\n" * 70_000, "word " * 60_000, "<P>", "a\n<M>\nb", "<S", "a<", "\n", "".join(f"{line()}\n" for _ in range(30_000))]
    big = "\n".join("shared passage number %d of a long text" % i for i in range(9000))
    texts += [big, "start\n" + big, big + "\nend", big]
    return [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(texts)]


def test_query_against_plain_loop(spark, rows, tables):
    given = many(rows)
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    got = queries.op13_fill_in_middle(spark, tables(docs)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(*x)) for x in given)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_columns_stay_and_rates(docs, empty):
    made = fim.fill_in_middle(docs, out="made", rate=0)
    assert made.columns == [*docs.columns, "made"]
    assert {r.form for r in made.select("made.form").collect()} == {"plain"}
    assert fim.fill_in_middle(empty).count() == 0


def test_chunks_are_shared_and_bounded():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 200_000, dtype=np.uint8)
    one = np.concatenate([rng.integers(97, 123, 5001, dtype=np.uint8), shared])
    pieces = lambda x: {bytes(c) for c in np.split(x, fim.chunk_ends(x)[:-1])}
    assert len(pieces(one) & pieces(shared)) > 0.9 * len(pieces(shared))
    flat = np.zeros(300_000, np.uint8)
    for data in (one, flat):
        ends = fim.chunk_ends(data)
        assert ends[-1] == len(data) and np.diff(np.concatenate([[0], ends])).max() <= 1 << 16


def test_cache_checks_content_and_stays_bounded(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *_: 1)  # everything collides
    cache = fim.ChunkCache(most=5000)
    for text in (b"a\nb", b"\n\n\n", b"a\nb", "é\n".encode() * 1000, b"x"):
        assert fim.Counted(text, cache).n == len(text.splitlines()) and cache.held < 20_000


def test_mark_across_a_chunk_edge():
    text = bytes(np.random.default_rng(2).integers(97, 123, 60_000, dtype=np.uint8))
    edge = int(fim.chunk_ends(np.frombuffer(text, np.uint8))[3])
    for shift in (-2, -1, 0):  # same bytes before the edge would move it, so the edges are forced
        at = edge + shift
        marked = text[:at] + b"<M>" + text[at + 3 :]
        counted = fim.Counted(marked, fim.ChunkCache())
        assert counted.marked
