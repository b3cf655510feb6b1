"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import collocations as co


def plain(rows, order, least, top):
    counts, total, seen = Counter(), Counter(), set()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in counts.items() if a >= least and len(x[1]) > 1}
    covered = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if found[lang, w[i : i + size]] <= a:
                    covered.add((lang, w[i : i + size]))
    out = []
    for lang in total:
        rows_ = []
        for (x, w), a in found.items():
            if x == lang and (x, w) not in covered:
                cuts = [(1000 * a * total[x] // (counts[x, w[:k]] * counts[x, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                rows_.append((-score, -a, " ".join(w).encode(), counts[x, w[:k]], counts[x, w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    words = ["the", "THE", "é", "new", "york", "a-b", "ß", "日本", "x#", " ", "of", "in"]
    texts = []
    for _ in range(250):
        parts = [rng.choice(words) if rng.random() < 0.7 else "New York City of" for _ in range(rng.randint(0, 40))]
        texts.append("".join(p + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  ", ";", " \r"]) for p in parts))
    rare = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(60)) for _ in range(20)]
    texts += [None, "", " ", "...", "la " * 5000, "one two three four five six " * 40, "x" * 3000, *rare, *rare[:3]]
    return [(rng.choice(["en", "en", "fr", None, "und"]), t) for t in texts]


@pytest.mark.parametrize("least, top, portion", [(3, 2000, 8 << 20), (10, 7, 500), (300, 5, 100)])
def test_against_counting_everything(spark, made, least, top, portion):
    docs = spark.createDataFrame([(*r, 1, "w") for r in made], "lang string, text string, n long, w1 string").repartition(3)
    got = co.collocations(docs, least=least, top=top, portion=portion).collect()
    want = plain(made, 5, least, top)
    assert sorted(map(tuple, got)) == want
    assert want or least == 300


def test_shorter_orders_and_products_beyond_64_bits(spark, made):
    docs = spark.createDataFrame(made, "lang string, text string")
    for order in (2, 3):
        assert sorted(map(tuple, co.collocations(docs, order=order, least=20).collect())) == plain(made, order, 20, 2000)
    big = spark.sql("SELECT CAST(4e15 AS bigint) a, CAST(9e15 AS bigint) n, CAST(7e15 AS bigint) l, CAST(8e15 AS bigint) r")
    assert big.select(co.exact_score().alias("s")).first().s == 1000 * 4 * 10**15 * 9 * 10**15 // (7 * 8 * 10**30)


def test_words_of_a_portion():
    words = co.Words([("en", b"a b c. b c d. a b c"), ("fr", b"a b c")])
    assert words.n == 12 and words.langs == ["en", "fr"]
    assert [bool(x) for x in words.go] == [True, True, False] * 4


def full(spark, bits=16):
    return spark.sparkContext.broadcast(b"\xff" * ((1 << bits) // 8))


def test_equal_windows_of_a_task_are_one_row(spark):
    docs = spark.createDataFrame([(x, b"a b c. " * 200) for x in ("de", "en", "es", "fr")], "lang string, text binary").coalesce(1)
    got = co.windows(docs, 5, full(spark), full(spark), 16, 100).where("w1 IS NOT NULL")
    assert got.count() == 12 and {r.n for r in got.collect()} == {200}


def test_windows_do_not_grow_with_the_tasks(spark, made):
    """A window that stands in every task is one row, with all its occurrences."""
    rows = [(lang or "und", (text or "").encode()) for lang, text in made] * 8
    docs = spark.createDataFrame(rows, "lang string, text binary")
    few, many = (co.windows(docs.repartition(n), 5, full(spark), full(spark), 16, 1000).collect() for n in (1, 8))
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == len({r[:-1] for r in few}) > 1000


def test_colliding_window_keys_change_nothing(monkeypatch):
    monkeypatch.setattr(co, "_MIX", (np.uint64(0),) * 3)  # all keys and all cells are equal
    words = co.Words([("en", b"a b c. b c"), ("fr", b"a b")])
    got = co._window_rows(words, co.Sketches(6, b"\xff" * 8, b"\xff" * 8), 3)
    assert got.num_rows == 7 and got.column("n").to_pylist() == [1] * 7
    assert {(r["lang"], r["w1"], r["w2"], r["w3"]) for r in got.to_pylist()} == {
        ("en", "a", "b", "c"), ("en", "b", "c", None), ("en", "c", None, None), ("fr", "a", "b", None), ("fr", "b", None, None)
    }


def test_a_full_sketch_only_prunes_less(spark, made):
    docs = spark.createDataFrame(made, "lang string, text string")
    rows = docs.selectExpr("coalesce(lang, 'und') lang", "cast(coalesce(text, '') as binary) text")
    short = spark.sparkContext.broadcast(co.frequent_cells(rows, 50, 16, 1000, 5))
    long = spark.sparkContext.broadcast(co.frequent_cells(rows, 50, 16, 1000, 5, short))
    every, kept = (co.windows(rows, 5, a, b, 16, 1000, 40) for a, b in ((full(spark), full(spark)), (short, long)))
    total = lambda df: sorted(df.groupBy("lang").sum("n").collect())
    assert total(every) == total(kept)
    often = lambda df, k: sorted(map(str, df.where(f"w{k} IS NOT NULL").groupBy("lang", *[f"w{i + 1}" for i in range(k)]).sum("n").where("`sum(n)` >= 50").collect()))
    assert all(often(every, k) == often(kept, k) for k in range(2, 6)) and often(kept, 3)
    words = {w for r in kept.where("w2 IS NOT NULL").select("w1", "w2").collect() for w in r}
    single = lambda df: {(r.lang, r.w1): r["sum(n)"] for r in df.where("w1 IS NOT NULL").groupBy("lang", "w1").sum("n").collect() if r["sum(n)"] >= 50}
    assert set(single(kept).items()) <= set(single(every).items()) and {w for _, w in single(kept)} <= words


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
