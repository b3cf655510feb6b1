"""Near copies of the pipeline stage against exact Jaccard similarity of all pairs."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_changed_words_are_found_and_others_stay(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        base = words(rng.randint(150, 400))
        rows.append((len(rows), " ".join(base)))
        for changes in (1, 3, 5, 8, 14):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "other"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, rows[0][1]), (1001, "a b"), (1002, "A  b"), (1003, ""), (1004, None), (None, rows[0][1]), (1005, "c d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    stay = corpus_pipeline.near_dedup(spark, docs, "").collect()
    ids = {r.doc_id for r in stay}
    sets = {i: shingles(t or "") for i, t in rows if i is not None}
    near = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(near) > 150
    assert not [p for p in near if set(p) <= ids]  # never both of a pair
    small = {b for _, b in near}
    assert set(sets) - small <= ids  # what is near nothing smaller stays
    assert {1001, 1003, 1005, None} <= ids and not {1000, 1002, 1004} & ids


def test_a_cell_of_unlike_texts_takes_several_rounds(spark):
    """Texts that share most shingles but not 0.8 of them meet in cells: none may go, and no copy of any may stay."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(300)]
    rows = [(k, " ".join(common + [f"t{k}x{i}" for i in range(60)])) for k in range(30)]
    rows += [(100 + k, t + f" end{rng.random()}") for k, t in rows[:30]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert jaccard(shingles(rows[0][1]), shingles(rows[1][1])) < 0.8 <= jaccard(shingles(rows[0][1]), shingles(rows[30][1]))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(30))


def test_pairs_grow_with_the_texts_and_not_their_square(spark, monkeypatch):
    """Texts alike by about 0.7 share many cells: the pairs held against each other stay in proportion."""
    from hearthline.llm import near_copies

    rng = random.Random(10)
    made, confirmed = [], near_copies.confirmed
    monkeypatch.setattr(near_copies, "confirmed", lambda pairs, *rest: (made.append(pairs.count()), confirmed(pairs, *rest))[1])
    common, counts = [f"c{i}" for i in range(200)], []
    for n in (100, 400):
        rows = [(k, " ".join(common + [f"t{rng.random()}" for _ in range(40)]), "en", "s", 0) for k in range(n)]
        made.clear()
        assert near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).count() == n
        counts.append(sum(made))
    assert counts[1] < 6 * counts[0]


def test_rows_of_later_rounds_are_made_once(spark, monkeypatch):
    """A set left in a crowded cell makes one row a band in the next round, and no step makes them anew."""
    from hearthline.llm import near_copies

    rng = random.Random(12)
    made, sets, dealt = spark.sparkContext.accumulator(0), [], near_copies._dealt_again

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def watched(some, number):
        sets.append((some.count(), number))
        out = dealt(some, number)
        return out.mapInArrow(counted, out.schema)

    monkeypatch.setattr(near_copies, "_dealt_again", watched)
    common = [f"c{i}" for i in range(200)]
    rows = [(k, " ".join(common + [f"t{rng.random()}" for _ in range(40)]), "en", "s", 0) for k in range(100)]
    assert near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).count() == 100
    assert sum(n for n, _ in sets) > 100
    assert made.value == sum(n * near_copies.ROUNDS[number][0] for n, number in sets)


def test_null_repeated_and_clashing_rows(spark):
    from hearthline.llm import near_copies

    kind = "doc_id long, text string, digest string, cell string, id long, bands string"
    rows = [(2, None, "a", "b", 1, "c"), (1, None, "a", "b", 1, "c"), (3, "x", "a", "b", 1, "c"), (3, "x", "d", "b", 1, "c"), (None, None, None, None, None, None)]
    got = near_copies.keep_one(spark.createDataFrame(rows, kind))
    assert got.columns == ["doc_id", "text", "digest", "cell", "id", "bands"]
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]
    assert near_copies.keep_one(spark.createDataFrame([], kind)).count() == 0


def test_the_trie_join_alone_finds_close_copies(spark, monkeypatch):
    """With MinHash bands that meet nothing, copies within the fingerprint budget still go, and unlike texts stay."""
    from hearthline.llm import near_copies

    rng = random.Random(11)
    base = [[f"v{rng.randrange(9000)}" for _ in range(900)] for _ in range(20)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)] + [(100 + k, " ".join(b + ["end"])) for k, b in enumerate(base)]
    prints = {i: near_copies.fingerprint(t.encode(), 5) for i, t in rows}
    close = {100 + k for k in range(20) if (prints[k] ^ prints[100 + k]).bit_count() <= 3}
    assert len(close) > 10
    plain = near_copies._sketcher

    def blind(width):
        def make():
            one = plain(width)()
            return lambda text: (*one(text)[:3], [])

        return make

    monkeypatch.setattr(near_copies, "_sketcher", blind)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    stay = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert set(range(20)) <= stay and not close & stay
