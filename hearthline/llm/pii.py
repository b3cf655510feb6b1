"""Personal data: fixed patterns for direct identifiers, and information-theoretic sanitisation of revealing terms.

The patterns find protected entities (e-mail and IP addresses, card and phone numbers). A term t of a text with an
entity e gives away its information when p(e|t) is high: PMI(t;e) = log2(p(e|t) / p(e)), compared with the entity's own
information IC(e) = -log2 p(e). Probabilities are shares of documents, counted over the whole corpus; p(e|t) is the lower
end of its Wilson interval, so few documents tell little. A rare entity is judged through its group (the domain of an
address, the network of an IP address, the first digits of a number), a rare group through its kind.

A term with PMI >= IC / alpha is replaced by its longest general form (the words of the corpus that share its first
letters) that stays below the threshold for all that the document holds, and removed if there is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import each, free_name, freeing, text_udf
from hearthline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DEPTHS = (5, 3, 2)  # letters that general forms keep, longest first


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. The local part can only end at an @ and holds none, so each @ is tried once
    with the longest run before it; this is what the pattern matches, without its square cost on long runs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start. Matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        # matches are capped in digits by their checks, so very long runs of digits are dropped cheaply
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def key_of(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)


def group_of(kind: str, value: str) -> str:
    """The class between an entity and its kind."""
    if kind == "email":
        return value[value.rindex("@") :].lower()
    if kind == "ip":
        return value[: value.rindex(".")]
    digits = "".join(DIGIT.findall(value))
    return digits[: 6 if kind == "card" else 4]


def forms_of(word: str) -> list[str]:
    """The word and its general forms, longest first."""
    return [word] + [word[:d] + "*" for d in DEPTHS if d < len(word)]


def outside(text: str, found: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """All terms of the text that do not touch an entity."""
    taken: list[tuple[int, int]] = []  # entities, merged
    for a, b in sorted((a, b) for _, a, b in found):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    begins = [a for a, _ in taken]
    for m in TERM.finditer(text):
        k = bisect_left(begins, m.end())
        if not (k and taken[k - 1][1] > m.start()):
            yield m


def find_entities(text):
    """Struct column: the entities of a text and the distinct keys of each, of its group and of its kind."""

    def one(value: bytes) -> tuple:
        known = value.decode("utf-8", "replace")
        found = entities(known)
        values = sorted({(k, known[a:b]) for k, a, b in found})
        keys = [{"entity": key_of(f"{k}:{v}"), "family": key_of(f"{k}/{group_of(k, v)}"), "kind": key_of(k)} for k, v in values]
        return [{"kind": k, "start": a, "end": b} for k, a, b in found], keys

    ddl = "entities array<struct<kind:string,start:long,end:long>>, keys array<struct<entity:long,family:long,kind:long>>"
    return text_udf(each(lambda: one), ddl)(text)


def find_terms(text):
    """Struct column: the distinct keys of all terms of a text outside its entities, and of their general forms."""

    def one(value: bytes) -> tuple:
        known = value.decode("utf-8", "replace")
        words = {m[0].lower() for m in outside(known, entities(known))}
        return (sorted({key_of(f) for w in words for f in forms_of(w)}),)

    return text_udf(each(lambda: one), "terms array<long>")(text)


def find_places(text, told):
    """Column: (start, end, action, letters) of every occurrence of a told term in the whole text, with the number of
    letters that its longest general form keeps which is not told itself (0: removed)."""

    def one(value: str, keys: list) -> list:
        bad, out, acts = set(keys), [], {}
        for m in outside(value, entities(value)):
            word = m[0].lower()
            if word not in acts:
                first, *more = forms_of(word)
                free = [len(f) - 1 for f in more if key_of(f) not in bad] if key_of(first) in bad else None
                acts[word] = None if free is None else max(free, default=0)
            if acts[word] is not None:
                action = "generalise" if acts[word] else "remove"
                out.append({"start": m.start(), "end": m.end(), "action": action, "letters": acts[word]})
        return out

    def run(texts: pa.Array, told: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), told.to_pylist())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("action", pa.string()), ("letters", pa.int64())]))
        return pa.array([one((t or b"").decode("utf-8", "replace"), p) if p else [] for t, p in rows], kind)

    run.__annotations__ = {"texts": pa.Array, "told": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, PLACES).asNondeterministic()(text.cast("binary"), told)


PLACES = "array<struct<start:long,end:long,action:string,letters:long>>"
FILTER_BITS = 1 << 23  # one megabyte, whatever the corpus


def _filter(terms: DataFrame) -> np.ndarray:
    """Bloom filter (two hashes) over the term keys. Its size is fixed; a full one only lets more terms through to the
    exact join. At most FILTER_BITS / 64 rows reach the driver."""
    bits = terms.select(F.explode(F.array(*[
        F.pmod(F.shiftrightunsigned("term", s), F.lit(FILTER_BITS)) for s in (0, 30)
    ])).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def term_frequencies(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, n_docs): in how many of all documents each of the given term keys occurs, as a word or as a general form of one.

    One pass over the texts; a task counts what passes the filter and sends one row per term it met, in bounded runs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def count(batches):
        bits, counts, keys, heads = shared.value.astype("<i8").tobytes(), {}, {}, {}

        def passes(k: int) -> bool:
            u = k & 0xFFFFFFFFFFFFFFFF
            a, b = u % FILTER_BITS, (u >> 30) % FILTER_BITS
            return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)

        def looked_for(form: str) -> int | None:
            k = key_of(form)
            return k if passes(k) else None

        def wanted(word: str) -> tuple:
            first, *more = forms_of(word)
            out = [looked_for(first)]
            for form in more:  # words share their general forms
                if form not in heads:
                    if len(heads) >= 200_000:
                        heads.clear()
                    heads[form] = looked_for(form)
                out.append(heads[form])
            return tuple(k for k in out if k is not None)

        def rows():
            return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for value in batch.column(0):
                # per distinct word: the keys of it and of its general form that pass the filter, kept for the task
                met = set()
                for word in set(TERM.findall((value.as_py() or b"").decode("utf-8", "replace").lower())):
                    got = keys.get(word)
                    if got is None:
                        if len(keys) >= 200_000:
                            keys.clear()
                        got = keys[word] = wanted(word)
                    met.update(got)
                for k in met:
                    counts[k] = counts.get(k, 0) + 1
            if len(counts) > 200_000:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    found = docs.select(F.col(text).cast("binary")).mapInArrow(freeing(count), "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n_docs")).join(terms, "term", "left_semi")


def lower_share(hits, of, z: float):
    """Column: lower end of the Wilson interval of a share of `hits` in `of` trials."""
    hits, of = hits.cast("double"), of.cast("double")
    spread = F.sqrt(hits * (of - hits) / of + z * z / 4)
    return (hits + z * z / 2 - z * spread) / (of + z * z)


def disclosing(seen: DataFrame, held: DataFrame, docs: DataFrame, text: str, total: int, alpha: float, z: float) -> DataFrame:
    """(class, term): terms that give away at least 1/alpha of the information of a class of entities. `seen` has a row
    per document, class (with `n_class`, its documents) and term of it, `held` one per document with an entity and term."""
    pairs = seen.groupBy("class", "n_class", "term").agg(F.count("*").alias("n_pair"))
    # log2(share / p) >= -log2(p) / alpha, with the logarithms gone
    bar = F.pow(F.col("n_class") / F.lit(float(max(total, 1))), F.lit(1 - 1 / alpha))
    # a term stands in n_pair documents at least, and in those that hold any entity: what fails even then need not be
    # looked up in all documents
    pairs = pairs.where(lower_share(F.col("n_pair"), F.col("n_pair"), z) >= bar)
    pairs = pairs.join(held.groupBy("term").agg(F.count("*").alias("n_held")), "term")
    pairs = cut_lineage(pairs.where(lower_share(F.col("n_pair"), F.col("n_held"), z) >= bar).drop("n_held"))
    frequencies = term_frequencies(docs, text, pairs.select("term").distinct())
    joined = pairs.join(frequencies, "term")
    return joined.where(lower_share(F.col("n_pair"), F.col("n_docs"), z) >= bar).select("class", "term")


def sanitise(
    docs: DataFrame, text: str = "text", alpha: float = 1.25, support: int = 3, z: float = 1.645, out: str = "pii",
    keep_text: bool = False, redacted: bool = False,
) -> DataFrame:
    """All columns of `docs` but the text (unless `keep_text`; then `redacted` cleans it), and the struct `out` with entities and terms: (start,
    end, action, letters) of revealing terms, action being generalise (to so many letters) or remove.

    An entity in fewer than `support` documents is judged as its group, a group in fewer as its kind, so every entity is
    judged at one level. `z` sets the Wilson bound of what documents prove. All terms of a document that holds an entity
    are judged, wherever they stand, and a revealing one is treated at every place of the text. Null and empty texts have
    no spans; texts are read whole; a repeated row counts as a document of its own; an empty table stays empty; a column
    named like `out` is replaced. Only rows that hold an entity are joined; all others pass through. Counts cover all
    documents.
    """
    row, terms, body = free_name(docs, "__row"), free_name(docs, "__terms"), free_name(docs, "__body")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out and (keep_text or c != text)]
    total = docs.count()
    marked = docs.withColumn(body, F.col(text)).withColumn(out, find_entities(F.col(text))).select(*kept, body, out)
    none = F.expr(f"cast(array() as {PLACES})")
    clean = marked.where(F.size(f"{out}.entities") == 0).drop(body)
    clean = clean.withColumn(out, F.struct(F.col(f"{out}.entities").alias("entities"), none.alias("terms")))
    held = cut_lineage(marked.where(F.size(f"{out}.entities") > 0).withColumn(row, F.expr("uuid()")))  # row names hold
    keys = held.select(row, F.explode(f"{out}.keys").alias("k")).select(row, "k.*")
    level = lambda name: held.select(F.explode(F.array_distinct(F.transform(f"{out}.keys", lambda k: k[name]))).alias(name))
    count = lambda name: level(name).groupBy(name).agg(F.count("*").alias(f"n_{name}"))
    enough = lambda name: count(name).where(F.col(f"n_{name}") >= support)
    judged = keys.join(enough("entity"), "entity", "left").join(enough("family"), "family", "left").join(count("kind"), "kind")
    pick = lambda *a: F.when(F.col("n_entity").isNotNull(), a[0]).when(F.col("n_family").isNotNull(), a[1]).otherwise(a[2])
    named = F.struct(
        pick(*map(F.col, ("entity", "family", "kind"))).alias("class"), pick(*map(F.col, ("n_entity", "n_family", "n_kind"))).alias("n_class")
    )
    who = judged.groupBy(row).agg(F.collect_set(named).alias("who"))  # no more than the entities of one text
    seen = held.select(row, body).join(who, row).select(row, "who", find_terms(F.col(body))["terms"].alias("t"))
    seen = cut_lineage(seen)
    every = seen.select(F.explode("t").alias("term"))
    seen = seen.select(row, F.explode("who").alias("w"), "t").select(row, "w.*", F.explode("t").alias("term"))
    told = cut_lineage(disclosing(seen, every, docs, text, total, alpha, z))
    named = seen.join(told, ["class", "term"]).groupBy(row).agg(F.collect_set("term").alias(terms))  # terms of one text
    marked = held.join(named, row, "left").withColumn(terms, find_places(F.col(body), F.col(terms)))
    result = F.struct(F.col(f"{out}.entities").alias("entities"), F.coalesce(terms, none).alias("terms"))
    marked = marked.withColumn(out, result).drop(row, terms, body)
    if keep_text and redacted:  # only these rows have anything to clean
        marked = marked.withColumn(text, redact(F.col(text), F.col(out)))
    return clean.unionAll(marked)


def redact(text, spans):
    """Column: the text with entities replaced by their kind in angle brackets, general terms by their first letters
    and removed terms left out. Where spans overlap, the one that starts first (then the longer) wins."""

    def apply(value: str, entity: list, term: list) -> str:
        marks = [(x["start"], -x["end"], f"<{x['kind'].upper()}>") for x in entity]
        marks += [(x["start"], -x["end"], value[x["start"] : x["start"] + x["letters"]] + "*" if x["letters"] else "") for x in term]
        parts, at = [], 0
        for start, end, new in sorted(marks):
            if start >= at:
                parts += [value[at:start], new]
                at = -end
        return "".join(parts) + value[at:]

    def run(texts: pa.Array, entity: pa.Array, term: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), entity.to_pylist(), term.to_pylist())
        return pa.array([t if t is None or not (e or m) else apply(t, e, m) for t, e, m in rows], pa.string())

    run.__annotations__ = {"texts": pa.Array, "entity": pa.Array, "term": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string").asNondeterministic()(text, spans["entities"], spans["terms"])
