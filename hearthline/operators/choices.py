"""Choice sets: what was open to a household at a decision's exact time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.hashing import analytics_uuid
from hearthline.functions.parsing import evaluated, filled, parse_verified
from hearthline.operators.temporal import (
    MICROS_PER_DAY, interval_latest, _last_active, last_instant, time_bucket,
)
from hearthline.schemas import (
    OUTCOME_EVENT_TYPES, OUTCOME_OUTSIDE, OUTCOME_STAGE, OUTSIDE_OPTIONS, UNIT,
)

OFFER_VALUES = (
    "offer_id", "list_price", "net_price", "discount_pct", "incentive_cash", "payment_plan_code",
    "monthly_payment_est", "offer_from", "offer_to", "offer_source",
)
# width of the time buckets of versions and offers: about the length of a typical interval
BUCKET_DAYS = 90
# width of the cells in which a unit's versions meet its offers: a few intervals
YEAR_DAYS = 360
ALTERNATIVE_TYPES = {
    "alternative_id": "string", "alternative_type": "string", "unit_id": "string",
    "product_type": "string", "inventory_state": "string", "effective_price": "double",
    "monthly_payment_est": "double", "payment_plan_code": "string", "commute_min": "double",
    "outside_option": "string", "availability_confirmed": "boolean", "offer_from": "timestamp",
    "offer_to": "timestamp", "offer_source": "string",
}


def effective_price(
    net_price: Column, list_price: Column, discount_pct: Column, incentive_cash: Column
) -> Column:
    return F.coalesce(net_price, list_price * (1 - discount_pct) - incentive_cash)


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def selected_alternative(payload: Column) -> Column:
    """Chosen alternative: unit code, else stated outside option, else the one implied by the
    outcome. An outside option outside the closed domain yields "?<value>"."""
    unit = payload["unit_code"]
    outside = F.when(filled(payload["outside_option"]), payload["outside_option"]).otherwise(
        F.try_element_at(_literal_map(OUTCOME_OUTSIDE), payload["outcome_type"])
    )
    ids = _literal_map({option: alt for alt, option in OUTSIDE_OPTIONS})
    return F.when(filled(unit), unit).when(
        filled(outside),
        F.coalesce(F.try_element_at(ids, outside), F.concat(F.lit("?"), outside)),
    )


def decision_stage(payload: Column) -> Column:
    return F.when(filled(payload["stage"]), payload["stage"]).otherwise(
        F.coalesce(
            F.try_element_at(_literal_map(OUTCOME_STAGE), payload["outcome_type"]),
            F.lit("final"),
        )
    )


UNIT_VALUES = ("effective_from", "version_id", "unit_code", "product_type", "inventory_state")


def scd_active_units(
    asofs: DataFrame, units: DataFrame, *, horizon=None, values: Sequence[str] = UNIT_VALUES
) -> DataFrame:
    """Per (project, as_of) the version of every unit active then, with an `ambiguous` flag."""
    return interval_latest(
        asofs, units, on=["project_id"], at="as_of", start="effective_from", end="effective_to",
        entity=["unit_id"], row_id="version_id", horizon=horizon, bucket_days=BUCKET_DAYS,
        values=values,
    )


def _unit_offers(offers: DataFrame) -> DataFrame:
    """Offers for single units; offers made for a product type do not apply to choice sets."""
    return offers.where(F.col("unit_id").isNotNull()).withColumns(
        {
            "offer_from": F.col("effective_from"),
            "offer_to": F.col("effective_to"),
            "offer_source": F.col("source_id"),
        }
    )


def scd_active_offers(
    points: DataFrame,
    offers: DataFrame,
    *,
    horizon=None,
    carry: Sequence[str] = (),
    how: str = "inner",
    values: Sequence[str] = ("effective_from", *OFFER_VALUES),
) -> DataFrame:
    """Per (unit, as_of) the unit offer active then, with an `ambiguous` flag; equal points come once."""
    return interval_latest(
        points, _unit_offers(offers), on=["unit_id"], at="as_of", start="effective_from",
        end="effective_to", entity=["unit_id"], row_id="offer_id", horizon=horizon, bucket_days=BUCKET_DAYS,
        values=values, carry=carry, how=how,
    )


def _spell_item() -> Column:
    """The alternative that the columns `v` (a version) and `o` (an offer) of a spell make."""
    return F.struct(
        F.col("v.unit_code").alias("alternative_id"),
        F.lit(UNIT).alias("alternative_type"),
        "unit_id", F.col("v.product_type").alias("product_type"),
        F.col("v.inventory_state").alias("inventory_state"),
        effective_price(
            F.col("o.net_price"), F.col("o.list_price"), F.col("o.discount_pct"), F.col("o.incentive_cash"),
        ).alias("effective_price"),
        F.col("o.monthly_payment_est").alias("monthly_payment_est"),
        F.col("o.payment_plan_code").alias("payment_plan_code"),
        F.lit(None).cast("double").alias("commute_min"),
        F.lit(None).cast("string").alias("outside_option"),
        F.lit(True).alias("availability_confirmed"),
        F.timestamp_micros("o.s").alias("offer_from"), F.timestamp_micros("o.e").alias("offer_to"),
        F.col("o.source_id").alias("offer_source"),
    )


def _valid(df: DataFrame, horizon, since) -> DataFrame:
    """Rows valid at some time from `since` to `horizon`."""
    start, last = F.col("effective_from"), _last_active("effective_to", horizon)
    return df.where(last >= (start if since is None else F.greatest(start, F.lit(since).cast("timestamp"))))


def _years(start: Column, end: Column, floor, top) -> Column:
    """The year cells that [start, end) touches between the instants `floor` and `top`, all in microseconds."""
    width = YEAR_DAYS * MICROS_PER_DAY
    first = start if floor is None else F.greatest(start, floor)
    number = lambda t: F.floor(t / F.lit(width)).cast("long")
    return F.sequence(number(first), number(F.least(F.coalesce(end - 1, top), top)))


def _let(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _winner(rows: Column, t: Column) -> Column:
    """(best, rival): of the rows live at `t` the one with the latest start, and whether another one has that start."""
    return _let(
        F.filter(rows, lambda x: (x["s"] <= t) & (x["e"].isNull() | (t < x["e"]))),
        lambda live: _let(
            F.array_max(live),
            lambda best: F.struct(
                best.alias("best"),
                F.exists(live, lambda x: (x["s"] == best["s"]) & (x["h"] != best["h"])).alias("rival"),
            ),
        ),
    )


def _stretches(vs: str, os: str, times: str, hi: str) -> Column:
    """The stretches [a, z) between neighbouring `times` in which a version is open or has a rival, each with the version
    `v` and the offer `o` that win in it. An offer matters only where the version is open."""
    found = F.transform(
        times,
        lambda t, i: F.struct(
            t.alias("a"), F.coalesce(F.get(F.col(times), i + 1), F.col(hi)).alias("z"), _winner(F.col(vs), t).alias("v")
        ),
    )
    shown = F.filter(
        found, lambda w: w["v"]["best"].isNotNull() & ((w["v"]["best"]["inventory_state"] == "available") | w["v"]["rival"])
    )
    return F.transform(
        shown,
        lambda w: F.struct(
            w["a"].alias("a"), w["z"].alias("z"), w["v"]["best"].alias("v"), w["v"]["rival"].alias("v_rival"),
            F.when(w["v"]["best"]["inventory_state"] == "available", _winner(F.col(os), w["a"])).alias("_o"),
        ),
    )


def open_spells(units: DataFrame, offers: DataFrame, *, horizon, since=None) -> DataFrame:
    """Per (project_id, _bucket) the `spells` [a, z) in which a unit is open with one version and one offer, or has an
    `issue`: an ambiguous version or offer, an offer without source.

    Spells do not depend on who asks: their number is that of versions and offers, not of questions times units. Versions
    and offers travel once, by unit, and meet in each year cell there; the latest start wins, rows of one start are told
    apart by hash.
    """
    v = _valid(units.where(F.col("project_id").isNotNull()), horizon, since).select(
        "unit_id",
        F.struct(
            F.unix_micros("effective_from").alias("s"), F.xxhash64("version_id").alias("h"), "unit_code",
            "product_type", "inventory_state", "project_id", F.unix_micros("effective_to").alias("e"),
        ).alias("v"),
    )
    o = _valid(offers.where(F.col("unit_id").isNotNull()), horizon, since).select(
        "unit_id",
        F.struct(
            F.unix_micros("effective_from").alias("s"), F.xxhash64("offer_id").alias("h"),
            F.col("offer_id").isNotNull().alias("named"), "list_price", "net_price", "discount_pct", "incentive_cash",
            "payment_plan_code", "monthly_payment_est", F.unix_micros("effective_to").alias("e"), "source_id",
        ).alias("o"),
    )
    year = YEAR_DAYS * MICROS_PER_DAY
    bottom = None if since is None else F.unix_micros(F.lit(since).cast("timestamp"))
    top = F.unix_micros(F.lit(horizon).cast("timestamp"))
    floor = F.col("_cell") * year
    if since is not None:
        floor = F.greatest(floor, bottom)
    start, end = (F.coalesce(F.col(f"v.{n}"), F.col(f"o.{n}")) for n in ("s", "e"))
    met = v.unionByName(o, allowMissingColumns=True).repartition("unit_id").withColumn(
        "_cell", F.explode(_years(start, end, bottom, top))
    ).groupBy("unit_id", "_cell").agg(
        F.collect_list("v").alias("vs"), F.collect_list("o").alias("os")
    ).where(F.size("vs") > 0).withColumns(
        {"_lo": floor, "_hi": F.least((F.col("_cell") + 1) * year, top + 1)}
    ).withColumn("project_id", F.explode(F.array_distinct("vs.project_id"))).withColumn(
        "vs", F.filter("vs", lambda x: x["project_id"] == F.col("project_id"))
    ).withColumn(
        "_times",
        F.sort_array(F.array_distinct(F.filter(
            F.concat(F.array("_lo"), F.col("vs.s"), F.col("vs.e"), F.col("os.s"), F.col("os.e")),
            lambda t: (t >= F.col("_lo")) & (t < F.col("_hi")),
        ))),
    )
    cut = met.select("project_id", "unit_id", F.inline(_stretches("vs", "os", "_times", "_hi"))).select(
        "project_id", "unit_id", "a", "z", "v", "v_rival", F.col("_o.best").alias("o"), F.col("_o.rival").alias("o_rival")
    )
    is_open = F.coalesce((F.col("v.inventory_state") == "available") & F.col("o.named"), F.lit(False))
    issue = F.when(F.col("v_rival"), "ambiguous_unit_version").when(F.col("o_rival"), "ambiguous_offer").when(
        is_open & ~filled(F.trim("o.source_id")), "missing_provenance"
    )
    spells = cut.select(
        "project_id", "a", "z", F.when(is_open, _spell_item()).alias("item"), issue.alias("issue")
    ).where(F.col("item").isNotNull() | F.col("issue").isNotNull())
    width = BUCKET_DAYS * MICROS_PER_DAY
    number = lambda t: F.floor(t / F.lit(width)).cast("long")
    return spells.withColumn(
        "_bucket", F.explode(F.sequence(number(F.col("a")), number(F.col("z") - 1)))
    ).repartition("project_id", "_bucket").groupBy("project_id", "_bucket").agg(
        F.sort_array(F.collect_list(F.struct("item", "a", "z", "issue"))).alias("spells")
    )


def _outside_items() -> Column:
    typed = {n: F.lit(None).cast(t) for n, t in ALTERNATIVE_TYPES.items()}
    return F.array(
        *[
            F.struct(
                *[
                    c.alias(n)
                    for n, c in {
                        **typed,
                        "alternative_id": F.lit(alt),
                        "alternative_type": F.lit(option),
                        "outside_option": F.lit(option),
                        "availability_confirmed": F.lit(True),
                    }.items()
                ]
            )
            for alt, option in OUTSIDE_OPTIONS
        ]
    )


def _attach_sets(
    rows: DataFrame, units: DataFrame, offers: DataFrame, *, outside: bool = True, horizon=None, since=None
) -> DataFrame:
    """Rows with the packed set `alts` of their (project_id, as_of), and an `issue` where an open version or offer is
    ambiguous, an offer has no source, or two open units share a code. All other set rules hold by construction."""
    if horizon is None:
        horizon = last_instant(rows, "as_of")
    spells = open_spells(units, offers, horizon=horizon, since=since)
    at = F.unix_micros("as_of")
    met = rows.withColumn("_bucket", time_bucket(F.col("as_of"), BUCKET_DAYS)).join(
        spells, ["project_id", "_bucket"], "left"
    )
    # worked out once: later filters and generators would repeat the search through the spells for each mention
    live = evaluated(
        met, {"_live": F.filter("spells", lambda x: (x["a"] <= at) & (at < x["z"]))}
    ).drop("spells", "_bucket")
    own = F.transform(F.filter("_live", lambda x: x["item"].isNotNull()), lambda x: x["item"])
    sets = evaluated(live, {
        "alts": F.coalesce(own, F.slice(_outside_items(), 1, 0)),
        "issue": F.array_min(F.transform("_live", lambda x: x["issue"])),
    }).drop("_live")
    codes = F.transform("alts", lambda x: x["alternative_id"])
    repeated = _let(codes, lambda c: F.size(F.array_distinct(c)) != F.size(c))
    whole = F.concat("alts", _outside_items()) if outside else F.col("alts")
    checked = evaluated(
        sets,
        {"_alts": whole, "_issue": F.coalesce("issue", F.when(repeated, "duplicate_alternative"))},
    ).drop("alts", "issue")
    return checked.withColumnsRenamed({"_alts": "alts", "_issue": "issue"})


def choice_sets(
    asofs: DataFrame, units: DataFrame, offers: DataFrame, *, outside: bool = True, horizon=None, since=None
) -> tuple[DataFrame, DataFrame]:
    """(packed choice sets, ambiguity violations) of every distinct (project_id, as_of).

    `since` and `horizon` are the earliest and the latest instant asked about; what is not valid between them is not
    read further. Work grows with distinct questions, not with decisions. The alternatives of a set are an
    array: units by code, then the outside options. A set is what one project offers at one
    instant, so its size is bounded by a project's inventory.
    """
    full = _attach_sets(
        asofs.select("project_id", "as_of").distinct(), units, offers, outside=outside,
        horizon=horizon, since=since,
    )
    bad = full.where(F.col("issue").isNotNull()).select(
        "project_id", "as_of", F.col("issue").alias("code"),
        F.col("project_id").alias("message"), F.lit("error").alias("severity"),
    )
    return full.drop("issue"), bad


def choice_set(
    asofs: DataFrame, units: DataFrame, offers: DataFrame, *, outside: bool = True, horizon=None
) -> tuple[DataFrame, DataFrame]:
    """(one row per alternative, ambiguity violations) of every distinct (project_id, as_of)."""
    sets, bad = choice_sets(asofs, units, offers, outside=outside, horizon=horizon)
    return unpack_choice_sets(sets), bad


def pack_choice_sets(rows: DataFrame, keys: Sequence[str] = ("project_id", "as_of")) -> DataFrame:
    """Long choice rows back to one row per set: units by code, then the outside options."""
    columns = [c for c in ALTERNATIVE_TYPES if c in rows.columns]
    rank = F.lit(0)
    for position, (alt, _) in enumerate(OUTSIDE_OPTIONS, start=1):
        rank = F.when(F.col("alternative_id") == alt, F.lit(position)).otherwise(rank)
    ranked = F.array_sort(F.collect_list(F.struct(rank.alias("_rank"), *columns)))
    return rows.groupBy(*keys).agg(
        F.transform(
            ranked, lambda a: F.named_struct(*[x for c in columns for x in (F.lit(c), a[c])])
        ).alias("alts")
    )


def unpack_choice_sets(sets: DataFrame) -> DataFrame:
    """One row per alternative with its position in the set."""
    keep = [c for c in sets.columns if c != "alts"]
    return sets.select(*keep, F.posexplode("alts").alias("alt_order", "alt")).select(
        *keep, "alt_order", "alt.*"
    )


def outcome_decisions(
    events: DataFrame,
    *,
    project: Column | None = None,
    verified_only: bool = True,
    outcome_types: Sequence[str] = OUTCOME_EVENT_TYPES,
) -> DataFrame:
    """One row per accepted outcome event, without its choice set."""
    chosen = events.where(F.col("event_type").isin(*outcome_types))
    if verified_only:
        chosen = chosen.where(parse_verified(F.col("payload")["verified"]))
    payload = F.col("payload")
    return chosen.select(
        F.concat_ws(":", "source_id", "source_event_key").alias("decision_id"),
        analytics_uuid(F.col("entity_id"), namespace="household").alias("household_id"),
        F.col("occurred_at").alias("as_of"),
        (project if project is not None else F.lit("default")).alias("project_id"),
        decision_stage(payload).alias("stage"),
        selected_alternative(payload).alias("selected_alternative_id"),
    )


def attach_choice_sets(
    decisions: DataFrame, units: DataFrame, offers: DataFrame, *, horizon=None
) -> tuple[DataFrame, DataFrame]:
    """(decisions with `alts` and the `chosen` position, violations).

    A violation is a decision whose selected alternative was not open at its time, or a set that
    could not be built unambiguously. Violating decisions are not among the decisions. Sets are
    packed before they meet decisions, so alternatives are never multiplied in a shuffle.
    """
    checked = _attach_sets(decisions, units, offers, horizon=horizon).withColumnRenamed(
        "issue", "_code"
    )
    selected = F.col("selected_alternative_id")
    position = F.array_position(F.transform("alts", lambda a: a["alternative_id"]), selected)
    checked = evaluated(checked, {"_position": position}).withColumns(
        {
            "chosen": F.when(F.col("_position") > 0, (F.col("_position") - 1).cast("int")),
            "_code": F.coalesce(
                "_code",
                F.when(
                    F.startswith(selected, F.lit("?")), F.lit("unknown_outside_option")
                ).when(F.col("_position") == 0, F.lit("selected_alternative_unavailable")),
            ),
        }
    ).drop("_position")
    good = checked.where(F.col("_code").isNull()).drop("_code")
    violations = checked.where(F.col("_code").isNotNull()).select(
        "decision_id", "as_of", F.col("_code").alias("code"),
        F.coalesce(selected, F.lit("")).alias("message"), F.lit("error").alias("severity"),
    )
    return good, violations


def historical_decisions(
    events: DataFrame,
    units: DataFrame,
    offers: DataFrame,
    *,
    project: Column | None = None,
    verified_only: bool = True,
    outcome_types: Sequence[str] = OUTCOME_EVENT_TYPES,
    horizon=None,
) -> tuple[DataFrame, DataFrame]:
    """Outcome events -> (decisions with their choice sets, violations).

    Without `project` there is no project key: every decision may choose among all units.
    """
    if project is None:
        units = units.withColumn("project_id", F.lit("default"))
    decisions = outcome_decisions(
        events, project=project, verified_only=verified_only, outcome_types=outcome_types
    )
    return attach_choice_sets(decisions, units, offers, horizon=horizon)


def add_commute(
    rows: DataFrame, commute: DataFrame, on: Sequence[str] = ("household_id", "unit_id", "as_of")
) -> DataFrame:
    """Commute minutes per `on` (each once in `commute`) on unit rows of long choice rows."""
    known = commute.select(*on, F.col("commute_min").alias("_commute"))
    return rows.join(known, list(on), "left").withColumn(
        "commute_min", F.when(F.col("alternative_type") == UNIT, F.col("_commute"))
    ).drop("_commute")


def set_commute(sets: DataFrame, minutes: Column) -> DataFrame:
    """The same commute for every unit of a packed set (units of a project share its place)."""
    return sets.withColumn("_minutes", minutes).withColumn(
        "alts",
        F.transform(
            "alts",
            lambda a: F.when(
                a["alternative_type"] == UNIT, a.withField("commute_min", F.col("_minutes"))
            ).otherwise(a),
        ),
    ).drop("_minutes")
