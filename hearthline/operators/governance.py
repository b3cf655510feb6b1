"""Model artifacts and their governance log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.parsing import filled
from hearthline.schemas import ALLOWED_TRANSITIONS


def _longest(status: str) -> int:
    """Decisions on the longest path of the transition table from a status on."""
    return max((1 + _longest(nxt) for nxt in ALLOWED_TRANSITIONS.get(status, ())), default=0)


MAX_STEPS = _longest("candidate")


def artifact_content_hash(artifacts: DataFrame) -> Column:
    """Hash of an artifact row without its id and creation time."""
    names = sorted(c for c in artifacts.columns if c not in ("artifact_id", "created_at", "content_hash"))
    kinds = dict(artifacts.dtypes)
    fields = []
    for n in names:
        is_map = kinds[n].startswith("map")
        fields += [F.lit(n), F.array_sort(F.map_entries(n)) if is_map else F.col(n)]
    return F.sha2(F.to_json(F.named_struct(*fields), {"ignoreNullFields": "false"}), 256)


def register_artifacts(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(artifact_id, content_hash, status): registered, already_registered or conflict."""
    hashes = new.select("artifact_id", artifact_content_hash(new).alias("content_hash"))
    if existing is None:
        stored = None
    else:
        stored = existing.select(
            "artifact_id", artifact_content_hash(existing).alias("_stored")
        ).groupBy("artifact_id").agg(F.min("_stored").alias("_stored"))
    kinds = hashes.groupBy("artifact_id", "content_hash").agg(F.count(F.lit(1)).alias("copies"))
    variants = kinds.groupBy("artifact_id").agg(F.min("content_hash").alias("_first"))
    rows = kinds.join(variants, "artifact_id")
    rows = rows.join(stored, "artifact_id", "left") if stored is not None else rows.withColumn(
        "_stored", F.lit(None).cast("string")
    )
    reference = F.coalesce("_stored", "_first")
    return rows.select(
        "artifact_id", "content_hash",
        F.when(F.col("content_hash") != reference, "conflict")
        .when(F.col("_stored").isNotNull(), "already_registered")
        .otherwise("registered").alias("status"),
    )


def _allowed(current: Column, nxt: Column) -> Column:
    ok = F.lit(False)
    for status, targets in ALLOWED_TRANSITIONS.items():
        if targets:
            ok = ok | ((current == status) & nxt.isin(*targets))
    return ok


def accepted_path(decisions: DataFrame) -> DataFrame:
    """Per artifact the decisions an append-only log accepts: columns seq1/status1 .. seq3.

    Transitions form a short acyclic graph, so three rounds of "earliest allowed decision after
    the current one" replay any log, however long, with aggregates only.
    """
    path = decisions.where(
        F.col("status").isin(*ALLOWED_TRANSITIONS["candidate"])
    ).groupBy("artifact_id").agg(F.min(F.struct("seq", "status")).alias("s1"))
    for step in range(2, MAX_STEPS + 1):
        prior = f"s{step - 1}"
        nxt = decisions.join(path.select("artifact_id", prior), "artifact_id").where(
            (F.col("seq") > F.col(f"{prior}.seq"))
            & _allowed(F.col(f"{prior}.status"), F.col("status"))
        ).groupBy("artifact_id").agg(F.min(F.struct("seq", "status")).alias(f"s{step}"))
        path = path.join(nxt, "artifact_id", "left")
    return path


def status_timeline(decisions: DataFrame) -> DataFrame:
    """Every decision with the status it met and whether that transition was allowed."""
    rows = decisions.join(accepted_path(decisions), "artifact_id", "left")
    seq = F.col("seq")
    before = F.lit("candidate")
    for step in range(1, MAX_STEPS + 1):
        s = F.col(f"s{step}")
        before = F.when(s.isNotNull() & (s["seq"] < seq), s["status"]).otherwise(before)
    taken = F.lit(False)
    for step in range(1, MAX_STEPS + 1):
        taken = taken | F.coalesce(F.col(f"s{step}.seq") == seq, F.lit(False))
    return rows.select(
        *decisions.columns, before.alias("from_status"), taken.alias("accepted")
    )


def validate_model_decisions(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Violations (artifact_id, seq, code, message, severity) of a governance log."""
    known = artifacts.select("artifact_id").distinct().withColumn("_known", F.lit(True))
    rows = status_timeline(decisions).join(known, "artifact_id", "left")
    text_bad = F.lit(False)
    for name in ("decided_by", "reason"):
        if name in decisions.columns:
            text_bad = text_bad | ~filled(F.trim(name))
    code = (
        F.when(text_bad, "missing_text")
        .when(F.col("_known").isNull(), "unregistered_artifact")
        .when(F.col("status") == "candidate", "explicit_candidate")
        .when(~F.col("accepted"), "invalid_transition")
    )
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select(
        "artifact_id", "seq", "code",
        F.concat(F.col("from_status"), F.lit(" -> "), F.col("status")).alias("message"),
        F.lit("error").alias("severity"),
    )


def current_model_status(artifacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Artifacts with the status of their last accepted decision, else candidate; refused
    decisions change nothing."""
    steps = [F.col(f"s{step}") for step in range(MAX_STEPS, 0, -1)]
    last = accepted_path(decisions).select("artifact_id", F.coalesce(*steps).alias("_last"))
    return artifacts.join(last, "artifact_id", "left").select(
        *artifacts.columns,
        F.coalesce("_last.status", F.lit("candidate")).alias("status"),
        F.col("_last.seq").alias("last_seq"),
    )
