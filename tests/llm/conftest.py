import random

import pytest

SCHEMA = "doc_id long, text string, source string, x string, n_words long"  # the last two clash with results


def texts():
    rng = random.Random(4)
    parts = ["the", "and", "ing", "ou", "tion", "éa", "wh", "st", "er", "ñó"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    out = [prose(rng.randint(1, 120)) + "\n" + prose(rng.randint(1, 60)) for _ in range(60)]
    out += [None, "", " \n\t ", "a", "one two", "Under the MIT License", prose(20_000)]
    out += [out[3], out[3], out[3].replace(" ", "  ", 2), out[4] + " more"]
    out += [
        prose(30) + " Licensed under the Apache License, Version 2.0. cc by nc cc by nc\tCC-BY-NC 4.0 " + prose(9),
        prose(30) + " GNU Lesser General Public License v2.1 or later; SPDX-License-Identifier: BSD-3-Clause " + prose(5),
        prose(20) + " mail a.b+c@x-y.example.org, bad@host 1.2.3.4 999.1.1.1 1.2.3.4.5 4387513035237269 +1 (988) 555-2485 " + prose(20),
        "a@b@c.de @x.y 4111 1111 1111 1111 4111-1111-1111-1112 +12 345 " + "9" * 3000 + " ++33 1 23 45 67 89-",
        "x" * 5000 + "@" + "y" * 10 + ".z  é@é.com",
        " ".join(["same", "five", "words", "go", "round"] * 9), "line a b\nline a b\n\n \nline a b\nother", "### $$$ %% a&b <x> | y",
    ]
    for k in range(4):  # a term that keeps company with one address only
        out.append(prose(12) + " contact zorblax at boss@corp.example.com soon " + prose(12))
    return out


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, f"src{i % 3}" if i % 7 else None, "clash", -1) for i, t in enumerate(texts())]
    return out + [out[5], out[5], (None, "text without a number " * 4, "src0", None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def tables(spark, docs, tmp_path):
    """A folder of tables as the queries read them; a function makes one from any documents."""

    def make(documents=docs, **others):
        documents.write.parquet(str(tmp_path / "documents.parquet"))
        for name, frame in others.items():
            frame.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
