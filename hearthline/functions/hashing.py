"""Keys, content hashes and hash uniforms. Every function maps Columns to one Column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name spaces that make identifiers agree between systems.
ANALYTICS_NAMESPACE = "78e92a33-6e3d-4c2c-bada-e56a8663378a"
POPULATION_NAMESPACE = "a2da2908-6a0c-4e3d-ad26-a5b12ccf82d5"

UUID_TEXT = "^[0-9a-fA-F]{32}$"
TWO_POW_52 = 4503599627370496.0


def dedupe_key(source_id: Column, source_event_key: Column, schema_version: Column) -> Column:
    return F.sha2(F.concat_ws("|", source_id, source_event_key, schema_version), 256)


def sorted_entries(m: Column) -> Column:
    return F.sort_array(F.map_entries(m))


# printable ASCII without quote and backslash: what JSON writes as it stands
PLAIN = r"\A[ !#-\[\]-~]*\z"


def quoted(text: Column) -> Column:
    """JSON string literal of a text value."""
    body = F.to_json(F.array(text))
    return F.when(text.rlike(PLAIN), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.substring(body, F.lit(2), F.length(body) - 2)
    )


def canonical_json(m: Column, *, compact: bool = True) -> Column:
    """JSON text of a string map with sorted keys."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    pairs = F.transform(
        sorted_entries(m), lambda e: F.concat(quoted(e["key"]), F.lit(colon), quoted(e["value"]))
    )
    text = F.concat(F.lit("{"), F.array_join(pairs, comma), F.lit("}"))
    if not compact:
        return text
    # one JSON call for the whole map; a map read from JSON may hold a key twice, which no new map may
    distinct = F.size(F.array_distinct(F.map_keys(m))) == F.size(m)
    return F.when(distinct, F.to_json(F.map_from_entries(sorted_entries(m)))).otherwise(text)


def payload_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload, compact=False), 256)


def row_map(columns: Iterable[str]) -> Column:
    """All given columns as one string map, nulls as empty text (how a CSV row is keyed)."""
    parts: list[Column] = []
    for name in sorted(columns):
        parts += [F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.create_map(*parts)


def stable_row_key(m: Column, *, compact: bool = True) -> Column:
    return F.sha2(canonical_json(m, compact=compact), 256)


def pseudonymous_key(value: Column, *, namespace: str) -> Column:
    """Irreversible identifier; null for a blank one."""
    text = F.trim(value)
    return F.when(
        F.length(text) > 0,
        F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(namespace + "|"), text), 256)),
    )


def _dashed(h: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, start, n) for start, n in cuts])


def uuid5(name: Column, namespace: str) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def analytics_uuid(value: Column, *, namespace: str = "default") -> Column:
    """A UUID given as text passes through; any other key becomes a stable name-based UUID."""
    text = F.trim(value)
    bare = F.regexp_replace(text, "urn:|uuid:|[{}-]", "")
    # a UUID takes at least 32 characters, so short keys skip the pattern
    is_uuid = (F.length(text) >= 32) & bare.rlike(UUID_TEXT)
    named = uuid5(F.concat(F.lit(namespace + ":"), text), ANALYTICS_NAMESPACE)
    # both candidates stand in an array: what is always evaluated shares one digest
    pair = F.array(named, F.when(is_uuid, _dashed(F.lower(bare))))
    at = F.when(F.length(text) > 0, F.when(is_uuid, 1).otherwise(0))
    return F.get(pair, at)


def uniform(*parts: Column | str | int) -> Column:
    """A uniform in [0, 1) that depends only on the given key parts, so retries repeat it."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(TWO_POW_52)


def multiset_digest(line_hash: Column) -> list[Column]:
    """Order-free digest parts of a set of sha256 line hashes.

    Eight 32-bit lanes are summed exactly: as 16-bit halves, which overflow after 2^47 rows. The state is
    constant per task and combines map-side: no ordering, no group is ever collected.
    """
    lanes = []
    for i in range(4):
        word = F.conv(F.substring(line_hash, 1 + 16 * i, 16), 16, -10).cast("long")
        high, *rest = (
            F.sum(F.shiftrightunsigned(word, s).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("decimal(20,0)")
            for s in (48, 32, 16, 0)
        )
        lanes += [high * 65536 + rest[0], rest[1] * 65536 + rest[2]]
    return [F.count(line_hash).cast("string")] + [
        F.coalesce(lane.cast("decimal(38,0)").cast("string"), F.lit("0")) for lane in lanes
    ]


def digest_root(parts: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def table_digest(hashes: DataFrame) -> DataFrame:
    """One row (rows, digest) of the only column, sha256 in binary: `multiset_digest` of a whole table, its lanes summed
    by NumPy in Arrow batches. A task returns one row."""

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        rows, found, sums = 0, 0, [0] * 8
        for batch in batches:
            known = batch.column(0).drop_null().cast(pa.binary(32))
            rows, found = rows + batch.num_rows, found + len(known)
            if len(known):
                at = known.offset * 32
                words = np.frombuffer(known.buffers()[1], ">u4", len(known) * 8, at).reshape(-1, 8)
                sums = [s + int(x) for s, x in zip(sums, words.sum(axis=0, dtype=np.uint64), strict=True)]
        data = [pa.array([rows], pa.int64()), pa.array([found], pa.int64())]
        data += [pa.array([Decimal(s)], pa.decimal128(38, 0)) for s in sums]
        yield pa.RecordBatch.from_arrays(data, names=names)

    names = ["rows", "found", *[f"s{i}" for i in range(8)]]
    parts = hashes.mapInArrow(run, "rows long, found long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(8)))
    text = lambda n: F.coalesce(F.sum(n).cast("decimal(38,0)").cast("string"), F.lit("0"))
    return parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        digest_root([text(n) for n in names[1:]]).alias("digest"),
    )
