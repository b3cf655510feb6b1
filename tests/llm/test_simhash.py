"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash

from hearthline.llm import queries, simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_groups_match_all_pairs(tables, rows, spark):
    ids, prints = [r[0] for r in rows], [brute_print(r[1]) for r in rows]
    want = sorted(map(str, zip(ids, [f"{p:016x}" for p in prints], brute_components(ids, prints))))
    got = queries.op9_simhash(spark, tables()).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert len(set(brute_components(ids, prints))) < len(rows)


def clustered(seed, n):
    """Values in tight clusters and chains, so that cells are large."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    out = {int(centres[0])}
    while len(out) < n:
        x = int(rng.choice(centres)) if rng.random() < 0.5 else list(out)[int(rng.integers(len(out)))]
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


def test_trie_join_finds_every_pair():
    values = clustered(1, 400)
    keys = np.array([v % 2 for v in values])
    order = np.lexsort((np.array(values, np.uint64), keys))
    keys, bits = keys[order], np.array(values, np.uint64)[order]
    for budget in (0, 1, 2, 3):
        i, j = simhash.trie_pairs(keys, bits, budget)
        want = {
            (a, b) for a in range(400) for b in range(a + 1, 400)
            if keys[a] == keys[b] and bin(int(bits[a]) ^ int(bits[b])).count("1") <= budget
        }
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


@pytest.mark.parametrize("leaf", [4096, 24])
def test_links_connect_what_all_pairs_connect(spark, leaf):
    values = clustered(2, 500)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "bits long")
    links = simhash.near_links(frame, 2, leaf)
    nodes = {r.node: r.root for r in simhash.components(links).collect()}
    got = {}
    for v in signed:
        got.setdefault(nodes.get(v, v), set()).add(v)
    want = {}
    for v, c in zip(signed, brute_components(list(range(500)), values)):
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and got[100] == got[101] == 100
    assert simhash.components(links.limit(0)).count() == 0


def test_one_of_each_group_stays(docs, empty, rows):
    kept = simhash.keep_one(docs)
    ids = [r[0] for r in rows]
    groups = brute_components(ids, [brute_print(r[1]) for r in rows])
    want = sorted({c for c in groups if c is not None})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want and kept.columns == docs.columns
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
