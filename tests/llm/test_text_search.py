"""License scan, decontamination and personal data against plain loops."""

import hashlib
import re
from collections import Counter

from hearthline.llm import decontam, licenses, pii, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: WORD.findall((t or "").translate(LOWER))
keyed = lambda rows: Counter(tuple(sorted(r.items(), key=lambda x: x[0])) for r in rows)


def same(frame, want):
    got = Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items() if k in want[0])) for r in frame.collect())
    assert got == Counter(tuple(sorted((k, str(v)) for k, v in w.items())) for w in want)


def test_license_base_places(tables, rows, spark):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = []
    for doc_id, text, *_ in rows:
        w = words(text)
        places = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append({
            "doc_id": doc_id, "n_words": len(w), "n_base": len(places), "first_word": min(places)[0] if places else None,
            "last_word": max(places)[0] if places else None, "base_labels": ",".join(sorted({x for _, x in places})),
        })
    found = queries.op1_license_scan(spark, tables())
    same(found, want)
    for r in found.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert sum("lgpl-2.1" in r.labels and "bsd-3-clause" in r.labels for r in found.collect()) == 1


def test_rules_gate_and_containment():
    rules = licenses.signature_rules()
    assert len(rules) >= 300 and len({r.name for r in rules}) == len(rules)
    found = [(20, 3, 0, 3), (40, 5, 0, 5), (20, 3, 4, 7), (20, 5, 0, 5), (60, 2, 1, 3)]
    slow = []
    order = sorted(range(5), key=lambda i: (-found[i][0], -found[i][1], found[i][2], i))
    gone, accepted = [False] * 5, []
    for i in order:
        gone[i] = any(s <= found[i][2] and found[i][3] <= e for s, e in accepted)
        if not gone[i]:
            accepted.append(found[i][2:])
    assert licenses.resolve(found) == gone and not slow
    scan = licenses._scanner()
    for rule in rules:  # a gate never hides what its rule would find
        n, got = scan(b"licensed under the mit license")
        assert all(g["rule"] != rule.name or rule.gate <= {b"licensed", b"under", b"the", b"mit", b"license"} for g in got)


def test_license_alternatives_open_their_own_gate():
    scan = licenses._scanner()
    for phrase, label in (
        ("Creative Commons Attribution 4.0 International", "cc-by"), ("Expat License", "mit"), ("FreeBSD license", "bsd-2-clause"),
        ("zero clause BSD", "bsd-0"), ("PSF license", "psf-2"), ("Creative Commons Attribution Share-Alike", "cc-by-sa"),
        ("Creative Commons Attribution Non-Commercial", "cc-by-nc"), ("Creative Commons Attribution No-Derivs", "cc-by-nd"),
        ("Creative Commons Attribution NoDerivs", "cc-by-nd"), ("open rail", "openrail"), ("licenced under", "generic"),
    ):
        assert label in {g["label"] for g in scan(phrase.encode())[1]}, phrase
    for rule in licenses.signature_rules():  # a text that a body matches opens the gate
        shape = rule.pattern.pattern.decode().removeprefix("(?<= )(?:").removesuffix(")(?= )")
        if rule.name.startswith("name:"):
            for text in licenses._spelled(licenses.re._parser.parse(shape)):
                assert any(set(text.encode().split()) >= s for s in rule.gates), text


def brute_windows(items, texts, size):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    for text in texts:
        w, hit, found = words(text), set(), set()
        for p, who in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= who
        yield len(w), len(hit), sorted(map(str, found))


def benchmark_rows(rows):
    long = words(rows[2][1])
    return [
        (1, " ".join(words(rows[0][1])[:25])), (2, "Ou"), (30, " ".join(long[:7])), (4, None), (5, ""), (6, "never-seen words"),
        (7, " ".join(long[3:40])), (7, " ".join(long[:12])), (100, rows[8][1]), (8, "the the the"),
    ]


def test_decontamination_matches_loops(tables, rows, spark):
    items = benchmark_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    short = [(r[0], r[1] if len(r[1] or "") < 50_000 else r[1][:4000]) for r in rows]
    documents = spark.createDataFrame(short, "doc_id long, text string")
    for (doc_id, _), (n, hit, found) in zip(short, brute_windows(items, [t for _, t in short], 10)):
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        want.append({"doc_id": doc_id, "n_words": n, "n_hit": hit, "n_items": len(found), "items_sha256": digest, "contaminated": hit > 0})
    assert any(w["contaminated"] for w in want) and not all(w["contaminated"] for w in want)
    same(queries.op7_decontamination(spark, tables(documents, benchmark=bench)), want)


def test_decontamination_in_blocks_and_empty(docs, empty, rows, spark):
    bench = spark.createDataFrame(benchmark_rows(rows), "item_id long, text string")
    key = lambda f: sorted(str(r.asDict()) for r in f.select("doc_id", "found").collect())
    whole = decontam.find_benchmark(docs, bench, out="found")
    assert key(whole) == key(decontam.find_benchmark(docs, bench, out="found", bytes_at_once=30))
    assert decontam.find_benchmark(empty, bench, out="found").count() == 0
    nothing = decontam.find_benchmark(docs, bench.limit(0), out="found").where("size(found.spans) > 0")
    assert nothing.count() == 0 and set(whole.columns) == {*docs.columns, "found"}


def brute_entities(text):
    text, out = text or "", []
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(
            int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for kind, pattern, good in rules:
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


def brute_terms(docs):
    """{doc_id: [(start, end, letters)]} of revealing terms, by loops over all documents (one row per id is kept)."""
    forms = lambda w: [w] + [w[:d] + "*" for d in (5, 3, 2) if d < len(w)]
    share = lambda k, n: (k + 1.645**2 / 2 - 1.645 * (k * (n - k) / n + 1.645**2 / 4) ** 0.5) / (n + 1.645**2)
    level, has, per = Counter(), Counter(), []
    for _, text in docs:
        text = text or ""
        found = brute_entities(text)
        who = set()
        for kind, a, b in found:
            value = text[a:b]
            digits = re.sub("[^0-9]", "", value)
            group = {"email": value[value.rfind("@"):].lower(), "ip": value[: value.rfind(".")], "card": digits[:6], "phone": digits[:4]}[kind]
            who.add(((kind, group, value), (kind, group), (kind,)))
        level.update({x for chain in who for x in chain})
        every = {f for w in pii.TERM.findall(text.lower()) for f in forms(w)}
        has.update(every)
        places = [m for m in pii.TERM.finditer(text) if all(m.end() <= a or b <= m.start() for _, a, b in found)] if found else []
        per.append((who, places, {f for m in places for f in forms(m[0].lower())}))
    classes = [{next((x for x in c[:2] if level[x] >= 3), c[2]) for c in who} for who, _, _ in per]
    both = Counter((c, f) for cs, (_, _, fs) in zip(classes, per) for c in cs for f in fs)
    told = {x for x, k in both.items() if share(k, has[x[1]]) >= (level[x[0]] / len(docs)) ** 0.2}
    out = {}
    for (doc_id, _), cs, (_, places, fs) in zip(docs, classes, per):
        bad = {f for f in fs if any((c, f) in told for c in cs)}
        out[doc_id] = [
            (m.start(), m.end(), max([len(f) - 1 for f in forms(m[0].lower())[1:] if f not in bad], default=0))
            for m in places if m[0].lower() in bad
        ]
    return out


def test_personal_data_base(tables, rows, spark):
    want = []
    for doc_id, text, *_ in rows:
        found = brute_entities(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        count = Counter(k for k, *_ in found)
        want.append({"doc_id": doc_id, "base_sha256": digest} | {f"n_{k}": count[k] for k in pii.KINDS})
    assert sum(w["n_email"] + w["n_ip"] + w["n_card"] + w["n_phone"] for w in want) >= 8
    found = queries.op8_pii(spark, tables())
    same(found, want)
    told = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term:")] for r in found.collect() if r.doc_id is not None}
    expect = brute_terms([(r[0], r[1]) for r in rows])
    assert told == {k: [f"term:{a}:{b}" for a, b, _ in x] for k, x in expect.items() if k is not None}
    assert sum(map(bool, expect.values())) >= 4
    for text in ("a@b@c.de", "..@a.b@c.d.", "a@b..c@d.e", "x@y.z@w.v.u", "1.1.1.1.1.1.1.1", "0001.2.3.256 1.2.3.0255", "+1 (2) 3-4.5 67890-"):
        assert pii.entities(text) == brute_entities(text), text


def test_disclosing_terms_and_redaction(docs, empty, spark):
    found = pii.sanitise(docs, out="pii", keep_text=True)
    clean = {r.doc_id: r for r in found.select("doc_id", "text", pii.redact(found.text, found.pii).alias("new"), "pii").collect()}
    told = [r for r in clean.values() if r["text"] and "zorblax" in r["text"]]
    assert len(told) == 4 and all("zorblax" not in r["new"] and "<EMAIL>" in r["new"] and "boss@" not in r["new"] for r in told)
    assert all(r["new"] == r["text"] for r in clean.values() if not r["pii"]["entities"])
    assert found.count() == docs.count() and pii.sanitise(empty).count() == 0
    assert set(found.columns) == {*docs.columns, "pii"}


def test_revealing_terms_far_from_the_entity(spark):
    fill = lambda k, n: " ".join(f"f{(k * 7 + i) % 50}" for i in range(n))
    rows = [(k, f"Quibblor {fill(k, 80)} mail me@far.example.org {fill(k, 80)} said quibblor.") for k in range(4)]
    rows += [(k, fill(k, 90)) for k in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs, keep_text=True, redacted=True).collect()}
    assert all("uibblor" not in got[k] and "<EMAIL>" in got[k] for k in range(4))
    assert all(got[k] == t for k, t in rows[4:])


def test_rare_entities_are_judged_by_group_and_kind(spark):
    """Every address stands in one document: a word that follows one domain, or one kind, is treated all the same."""
    fill = lambda k: " ".join(f"w{(k * 3 + i) % 9}" for i in range(9))
    rows = [(k, f"{fill(k)} Brimblecot p{k}@corp.example.org") for k in range(6)]
    rows += [(k, f"{fill(k)} Ferndyke 10.{k}.0.1") for k in range(6, 14)] + [(k, f"{fill(k)} bright") for k in range(14, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(docs, keep_text=True).collect()}
    expect = brute_terms(rows)
    assert {k: [(t["start"], t["end"], t["letters"]) for t in r.pii["terms"]] for k, r in got.items()} == expect
    text = {r.doc_id: r.text for r in pii.sanitise(docs, keep_text=True, redacted=True).collect()}
    assert all("rimblecot" not in text[k] and "w3" in text[k] for k in range(6)) and all("erndyke" not in text[k] for k in range(6, 14))
    assert text[0] == f"{fill(0)} Bri* <EMAIL>"  # other words begin with these letters
    assert all(text[k] == t for k, t in rows[14:])


def test_term_frequencies_match_loops(docs, rows, spark):
    vocabulary = sorted({w for r in rows for w in pii.TERM.findall((r[1] or "").lower())})[::7] + ["absent"]
    terms = spark.createDataFrame([(pii.key_of(w),) for w in vocabulary], "term long")
    got = {r.term: r.n_docs for r in pii.term_frequencies(docs, "text", terms).collect()}
    want = {pii.key_of(w): sum(w in set(pii.TERM.findall((r[1] or "").lower())) for r in rows) for w in vocabulary}
    assert got == {k: n for k, n in want.items() if n}


def test_items_without_an_id_are_searched_and_not_named(spark):
    docs = spark.createDataFrame([(1, "say one two three now"), (2, "four five six"), (3, "seven")], "doc_id long, text string")
    items = [(None, "one two three"), (7, "one two three"), (None, "four five six"), (8, None), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.x for r in decontam.find_benchmark(docs, bench, out="x").collect()}
    assert {k: list(x["items"]) for k, x in got.items()} == {1: [7], 2: [], 3: []}
    assert [len(got[k].spans) for k in (1, 2, 3)] == [1, 1, 0]
