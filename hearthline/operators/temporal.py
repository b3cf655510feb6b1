"""Interval and as-of joins, latest-per-key, dense indexing and order cuts.

None of these puts a whole key into one task: winners are chosen by aggregates that combine
map-side, and ordered work is done inside (key, time bucket) groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def active_at(at: Column, start: Column, end: Column) -> Column:
    """Validity interval [start, end) with an open end."""
    return (start <= at) & (end.isNull() | (at < end))


def time_bucket(ts: Column, days: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(days * MICROS_PER_DAY)).cast("long")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, where: Column | None = None
) -> DataFrame:
    """The row with the greatest `order` per key; `order` must make rows distinguishable."""
    if where is not None:
        df = df.where(where)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (*order, *rest)])


def last_instant(df: DataFrame, column: str):
    """The greatest value of a time column (one narrow scan); None for no rows."""
    return df.agg(F.max(column)).first()[0]


FAN = 4


def _last_active(end: str, horizon) -> Column:
    limit = F.lit(horizon).cast("timestamp")
    return F.least(F.coalesce(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), limit), limit)


def interval_levels(intervals: DataFrame, *, start: str, end: str, horizon, bucket_days: int) -> int:
    """How many cell sizes the intervals need: 1 while they fill a few buckets on average (one narrow scan). With one
    size no more rows are cut than with several, and the aggregate after the join needs no shuffle of its own."""
    length = time_bucket(_last_active(end, horizon), bucket_days) - time_bucket(F.col(start), bucket_days) + 1
    seen = intervals.agg(F.max(length), F.avg(F.when(length > 0, length))).first()
    longest, levels = seen[0] or 1, 1
    while (seen[1] or 1) > FAN and FAN**levels < longest:
        levels += 1
    return levels


def _numbered(cells: Column, levels: int, level: int) -> Column:
    return F.transform(cells, lambda c: c * levels + level)


def interval_cells(first: Column, last: Column, levels: int) -> Column:
    """The buckets `first` to `last` as few aligned cells of 1, 4, 16, .. buckets: at most 6 a level and 8 of the widest.
    A cell is its number times `levels` plus its level."""
    below = lambda x, y: F.when(y > x, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = lambda x: x.cast("long")
    parts = []
    for level in range(levels):
        size, wide = FAN**level, FAN ** (level + 1)
        low, high = whole(F.ceil(first / size)), whole(F.floor((last + 1) / size))
        if level + 1 == levels:
            cells = below(low, high)
        else:  # what wider cells cover is left to them
            up, down = whole(F.ceil(first / wide)) * FAN, whole(F.floor((last + 1) / wide)) * FAN
            cells = F.when(up < down, F.concat(below(low, up), below(down, high))).otherwise(below(low, high))
        parts.append(_numbered(cells, levels, level))
    return F.concat(*parts)


def interval_pairs(
    points: DataFrame,
    intervals: DataFrame,
    *,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    horizon,
    bucket_days: int = 32,
    how: str = "inner",
    levels: int | None = None,
) -> DataFrame:
    """Every point with each interval of its key that is active at the point.

    Intervals are cut into aligned cells of time, so the join key is (on, cell): a hot key spreads over the cells and only
    near-matching intervals meet. Cells grow by powers of four inside an interval, so one of years is a dozen rows; a
    point probes the cell of each size in use. Open intervals end at `horizon`, the greatest instant anyone asks about.
    With how="left" and several sizes a point comes once for each size in which it meets nothing.
    """
    if levels is None:
        levels = interval_levels(intervals, start=start, end=end, horizon=horizon, bucket_days=bucket_days)
    last = _last_active(end, horizon)
    cells = interval_cells(time_bucket(F.col(start), bucket_days), time_bucket(last, bucket_days), levels)
    cut = intervals.where(last >= F.col(start)).withColumn("_bucket", F.explode(cells))
    keys = [*on, "_bucket"]
    if levels == 1:
        cut = cut.repartition(*keys)
    bucket = time_bucket(F.col(at), bucket_days)
    own = [F.floor(bucket / FAN**k).cast("long") * levels + k for k in range(levels)]
    probe = points.withColumn("_bucket", F.explode(F.array(*own)) if levels > 1 else own[0])
    if levels == 1:
        probe = probe.repartition(*keys)
    right = cut.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                       *[c for c in cut.columns if c not in keys])
    meet = active_at(F.col(at), F.col(start), F.col(end))
    for k in keys:
        meet = (F.col(k) == F.col(f"_r_{k}")) & meet
    return probe.join(right, meet, how).drop(*[f"_r_{k}" for k in keys])


def interval_latest(
    points: DataFrame,
    intervals: DataFrame,
    *,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    entity: Sequence[str],
    row_id: str,
    values: Sequence[str],
    horizon=None,
    bucket_days: int = 32,
    carry: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """For every point and entity the interval row active at the point with the latest start.

    `points` holds each (on, at) once, plus `carry` columns that go through unchanged; with
    how="left" points without an interval stay, with null values. `ambiguous` marks points where two different rows
    share the winning start; they are told apart by two opposite maxima, not by a ranking window.
    """
    if horizon is None:
        horizon = last_instant(points, at)
    needed = dict.fromkeys([*on, start, end, *entity, row_id, *values])
    levels = interval_levels(intervals, start=start, end=end, horizon=horizon, bucket_days=bucket_days)
    joined = interval_pairs(
        points.select(*on, at, *carry), intervals.select(*needed), on=on, at=at, start=start,
        end=end, horizon=horizon, bucket_days=bucket_days, how=how, levels=levels,
    )
    extras = [e for e in entity if e not in on]
    rank = F.xxhash64(row_id)
    # with one cell size the join's partitioning serves the aggregate too, whichever side Spark broadcasts
    best = joined.groupBy(*on, *(["_bucket"] if levels == 1 else []), at, *extras).agg(
        F.max(
            F.when(
                F.col(start).isNotNull(),
                F.struct(start, rank.alias("_h"), *[v for v in values if v != start]),
            )
        ).alias("_b"),
        F.max(
            F.when(
                F.col(start).isNotNull(), F.struct(start, F.bitwise_not(rank).alias("_h"))
            )
        ).alias("_c"),
        *[F.max(c).alias(c) for c in carry],
    )
    return best.select(
        *on, at, *extras, *carry,
        *[F.col(f"_b.{v}").alias(v) for v in values],
        F.coalesce(
            F.col("_b._h") != F.bitwise_not(F.col("_c._h")), F.lit(False)
        ).alias("ambiguous"),
    )


# keys fall into this many hash groups; a group is hot above HOT_ROWS rows and a thousandth of all
HASH_GROUPS = 65_536
HOT_ROWS = 100_000


def _hash_group(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(HASH_GROUPS))


def hot_groups(*tables: DataFrame, on: Sequence[str]) -> list[int]:
    """Hash groups of `on` that hold very many rows of the tables: a narrow scan, counts of at most HASH_GROUPS groups.
    A thousand at most, so a list of them fits a predicate."""
    keys = tables[0].select(*on)
    for other in tables[1:]:
        keys = keys.unionByName(other.select(*on))
    sizes = keys.groupBy(_hash_group(on).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    total, large = sizes.agg(
        F.sum("n"), F.collect_list(F.when(F.col("n") > HOT_ROWS, F.struct("g", "n")))
    ).first()
    return sorted(r["g"] for r in large if r["n"] * 1000 > total)


def asof_fill(
    points: DataFrame,
    observations: DataFrame,
    *,
    on: Sequence[str],
    ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    bucket_days: int = 1,
) -> DataFrame:
    """Points plus the last non-null value of each column at or before them; of one instant the greatest.

    `points` keep their columns and may repeat; `observations` have (on, ts), the nullable `columns` and `tie` columns,
    which decide before the value and come with it, as a struct. One shuffle and one running window per key. Only keys of
    hot hash groups are cut into time buckets, and what earlier buckets left behind comes from a per-bucket summary, so
    no window spans a hot key.
    """
    seen = observations.where(F.col(ts).isNotNull())
    for k in on:
        seen = seen.where(F.col(k).isNotNull())
    hot = hot_groups(points, seen, on=on)
    is_hot = _hash_group(on).isin(hot) if hot else F.lit(False)
    keys = [*on, "_bucket"]
    placed = seen.select(*on, ts, F.lit(0).alias("_side"), *tie, *columns).unionByName(
        points.withColumn("_side", F.lit(1)), allowMissingColumns=True
    ).withColumn("_bucket", F.when(is_hot, time_bucket(F.col(ts), bucket_days))).repartition(
        *[F.col(k) for k in (keys if hot else on)]
    )
    running = Window.partitionBy(*(keys if hot else on)).orderBy(ts, "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    best = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(ts, *tie, c))) for c in columns}
    inside = placed.select(
        *points.columns, "_side", "_bucket", *[b.over(running).alias(f"_at_{c}") for c, b in best.items()]
    ).where(F.col("_side") == 1)
    found = {c: F.col(f"_at_{c}") for c in columns}
    if hot:
        closing = placed.where(is_hot & (F.col("_side") == 0)).groupBy(*keys).agg(
            *[b.alias(c) for c, b in best.items()], F.lit(0).alias("_asked")
        ).unionByName(
            # a bucket of points alone asks too
            placed.where(is_hot & (F.col("_side") == 1)).select(*keys).distinct().withColumn("_asked", F.lit(1)),
            allowMissingColumns=True,
        )
        before = Window.partitionBy(*on).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
        carried = closing.select(
            *keys, "_asked", *[F.max(c).over(before).alias(f"_in_{c}") for c in columns]
        ).where("_asked = 1").drop("_asked")
        inside = inside.join(carried, keys, "left")
        found = {c: F.coalesce(f"_at_{c}", f"_in_{c}") for c in columns}
    value = lambda c: F.struct(*[found[c][n].alias(n) for n in (*tie, c)]) if tie else found[c][c]
    return inside.select(
        *points.columns, *[(F.when(found[c].isNotNull(), value(c)) if tie else value(c)).alias(c) for c in columns]
    )


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    tie: Sequence[str],
    values: dict[str, str],
    bucket_days: int = 1,
) -> DataFrame:
    """Left rows plus the latest right values observed at or before `left_ts`.

    `values` maps output names to right columns; equal times are decided by the greatest `tie`.
    """
    pick = [c for c in dict.fromkeys([*tie, *values.values()])]
    observed = right.select(*on, F.col(right_ts).alias(left_ts), F.struct(*pick).alias("_o"))
    return asof_fill(
        left, observed, on=on, ts=left_ts, columns=["_o"], bucket_days=bucket_days
    ).select(*left.columns, *[F.col(f"_o.{src}").alias(name) for name, src in values.items()])


def dense_index(df: DataFrame, key: str, *, weight: str | None = None) -> DataFrame:
    """Give each distinct `key` a dense range [lo, hi) in md5 order, `weight` places wide.

    Ranks are taken inside 4,096 hash buckets; the bucket offsets come from a summary of at most
    4,096 rows. `key` must be unique.
    """
    size = F.col(weight) if weight else F.lit(1)
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn(
        "_p", F.substring("_h", 1, 3)
    ).withColumn("_w", size.cast("long"))
    sums = hashed.groupBy("_p").agg(F.sum("_w").alias("_n"))
    offsets = sums.select(
        "_p",
        (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"),
    )
    inside = Window.partitionBy("_p").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumn("_hi", F.sum("_w").over(inside)).join(offsets, "_p")
        .withColumn("lo", F.col("_off") + F.col("_hi") - F.col("_w"))
        .withColumn("hi", F.col("_off") + F.col("_hi"))
        .drop("_h", "_p", "_w", "_hi", "_off")
    )


def first_n_predicate(df: DataFrame, *, ts: str, row_id: str, n: int) -> Column:
    """A predicate that is true for exactly the first `n` rows by (ts, md5(id)).

    The cut is found by counting ever finer time slices and, among rows of one instant, ever
    longer hash prefixes; each step collects at most a few thousand counts. The caller then only
    filters: nothing is sorted or ranked. Row ids must be unique.
    """
    micros = F.unix_micros(F.col(ts))
    digest = F.md5(F.col(row_id).cast("string"))
    steps = [
        F.floor(micros / F.lit(4096 * MICROS_PER_DAY)),
        F.floor(micros / F.lit(MICROS_PER_DAY)),
        F.floor(micros / F.lit(30_000_000)),
        F.floor(micros / F.lit(10_000)),
        micros,
        *[F.substring(digest, 1, 3 * i) for i in range(1, 11)],
        digest,
    ]
    rest, narrowed, taken = n, df, F.lit(False)
    same = F.lit(True)
    for step in steps:
        counts = sorted(
            (r[0], r[1]) for r in narrowed.groupBy(step.alias("s")).count().collect()
        )
        cut = None
        for value, count in counts:
            if rest < count:
                cut = value
                break
            rest -= count
        if cut is None:
            return taken | same
        taken = taken | (same & (step < F.lit(cut)))
        if rest == 0:
            return taken
        same = same & (step == F.lit(cut))
        narrowed = narrowed.where(step == F.lit(cut))
    return taken
