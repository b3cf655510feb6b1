"""An event table with an index of its keys: ingest reads a few index files, and one commit covers all it writes.

Layout below the table's folder:

- ``events/batch=../event_type=../event_date=..``: the events of each commit;
- ``snapshots/batch=..``: the source snapshots of each commit;
- ``keys/<run>/p=..``: runs of the key index, each cut by key prefix into files of a bounded number of keys;
- ``commits/<version>.json``: one small file per commit. What no commit names does not exist to a reader.

A commit's file is written once and never over another. Writers therefore need no lock: the one that comes second finds
its version taken, reads what the first added and starts over from the same batch.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.schemas import EVENT_SCHEMA
from hearthline.session import cut_lineage
from hearthline.sources.ingest import SourceMismatch, day_files, first_per_key, record_source_snapshot

SNAPSHOT_SCHEMA = (
    T.StructType().add("snapshot_id", "string").add("source_id", "string").add("captured_at", "timestamp")
    .add("content_hash", "string").add("record_count", "long").add("schema_version", "string")
    .add("metadata", T.MapType(T.StringType(), T.StringType()))
)
KEYS_PER_FILE = 200_000
ROWS_PER_TASK = 250_000
STORED = (
    T.StructType(list(EVENT_SCHEMA.fields)).add("dedupe_key", "string").add("batch", "string").add("event_date", "date")
)


@dataclass(frozen=True)
class Run:
    """One part of the key index; `digits` is the length of its key prefixes in hexadecimal digits."""

    name: str
    rows: int
    digits: int


@dataclass(frozen=True)
class Commit:
    version: int = -1
    batch: str = ""
    runs: tuple[Run, ...] = ()
    events: int = 0
    snapshots: int = 0
    #: for each stream, the last micro-batch taken
    streams: dict = field(default_factory=dict)
    result: dict = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer took the version."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    folder = at(f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def last_commit(spark: SparkSession, path: str) -> Commit:
    """The newest commit, or an empty one before the first."""
    known = versions(spark, path)
    if not known:
        return Commit()
    fs, at = _files(spark, path)
    stream = fs.open(at(f"{path}/commits/{known[-1]:012d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    values = json.loads(text)
    values["runs"] = tuple(Run(**r) for r in values["runs"])
    return Commit(**values)


def publish(spark: SparkSession, path: str, commit: Commit) -> None:
    """Write the commit's file under a name of its own, then move it to its version unless that is taken."""
    fs, at = _files(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(at(f"{path}/commits"))
    draft, final = at(f"{path}/commits/.{uuid4().hex}"), at(f"{path}/commits/{commit.version:012d}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(asdict(commit)).encode()))
    stream.close()
    # without the overwrite option the move fails if the name exists
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(error):
            raise Conflict(f"version {commit.version} is taken") from error
        raise


def _committed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("batch string").json(f"{path}/commits/*.json").distinct()


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of all commits, with the batch that brought them; rows of unfinished writes are left out."""
    if not last_commit(spark, path).events:
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(f"{path}/events")
    return rows.join(_committed(spark, path), "batch", "left_semi")


def stored_snapshots(spark: SparkSession, path: str) -> DataFrame:
    if not last_commit(spark, path).snapshots:
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)
    schema = T.StructType([*SNAPSHOT_SCHEMA.fields, T.StructField("batch", T.StringType())])
    rows = spark.read.schema(schema).parquet(f"{path}/snapshots")
    return rows.join(_committed(spark, path), "batch", "left_semi").drop("batch")


def _prefix(digits: int):
    return F.concat(F.lit("_"), F.substring(F.sha1("dedupe_key"), 1, digits))


def probe_keys(spark: SparkSession, path: str, commit: Commit, keys: DataFrame) -> DataFrame:
    """(source_id, dedupe_key) of the index files that can hold one of `keys`.

    A file holds about KEYS_PER_FILE keys of one prefix however large the table is, so a batch of few keys reads few
    files; only folder names that the batch touches are opened, none is listed. At most one name per file of the index
    reaches the driver.
    """
    schema = "source_id string, dedupe_key string"
    parts = []
    for run in commit.runs:
        touched = [r.p for r in keys.select(_prefix(run.digits).alias("p")).distinct().collect()]
        fs, at = _files(spark, path)
        folders = [f for p in touched if fs.exists(at(f := f"{path}/keys/{run.name}/p={p}"))]
        if folders:
            parts.append(spark.read.schema(schema).parquet(*folders))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _write_run(path: str, keys: DataFrame, rows: int) -> Run:
    digits = max(0, math.ceil(math.log(max(rows, 1) / KEYS_PER_FILE, 16)))
    name = uuid4().hex
    keys = keys.select("source_id", "dedupe_key", _prefix(digits).alias("p"))
    keys.repartition("p").write.partitionBy("p").parquet(f"{path}/keys/{name}")
    return Run(name, rows, digits)


def _merged(spark: SparkSession, path: str, runs: tuple[Run, ...]) -> tuple[Run, ...]:
    """Neighbours of like size become one run, so n commits leave about log(n) runs and a key is rewritten about
    log(n) times."""
    runs, last = list(runs), []
    while runs and (not last or runs[-1].rows <= 2 * sum(r.rows for r in last)):
        last.append(runs.pop())
    if len(last) < 2:
        return (*runs, *last)
    parts = [spark.read.schema("source_id string, dedupe_key string").parquet(f"{path}/keys/{r.name}") for r in last]
    return (*runs, _write_run(path, reduce(DataFrame.unionByName, parts), sum(r.rows for r in last)))


def dealt(new: DataFrame) -> DataFrame:
    """A large batch in parts of about ROWS_PER_TASK rows, before its repeats collapse: each task sorts all it has read,
    and a task reads whole row groups, which may hold millions of rows. 200 parts at most are written without a sort."""
    parts = min(200, math.ceil(new.count() / ROWS_PER_TASK))
    if parts < 2:
        return new
    return new.repartition(parts, "source_event_key", "occurred_at", "event_id", "event_type", "entity_id")


def ingest_batch(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    *,
    source_id: str,
    snapshot: DataFrame | None = None,
    stream: tuple[str, int] | None = None,
    retries: int = 10,
    before_publish=None,
) -> dict:
    """Append the events that the table does not hold, and the snapshots of the source they came from, in one commit.

    Repeats inside the batch collapse to the earliest; an empty batch makes a commit only for its snapshot or stream.
    Rows of another source (null included) are refused as a whole. `stream` names a stream and its micro-batch: one
    that was taken before is not taken again, and its result is empty. `before_publish` is called with the commit
    that is about to be made (tests).
    """
    batch = cut_lineage(first_per_key(dealt(new)))
    total = batch.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("received"),
        F.count_if(F.col("source_id").isNull() | (F.col("source_id") != source_id)).alias("foreign"),
    ).first()
    if total["foreign"]:
        raise SourceMismatch(f"{total['foreign']} keys of the batch are not of source {source_id}")
    if snapshot is not None:
        snapshot = cut_lineage(snapshot)
    for _ in range(retries):
        base = last_commit(spark, path)
        if stream and base.streams.get(stream[0], -1) >= stream[1]:
            return {}
        made = _attempt(spark, path, base, batch, total["received"], source_id, snapshot, stream)
        if made is base:
            return _result(source_id, total["received"], 0)
        if before_publish is not None:
            before_publish(made)
        try:
            publish(spark, path, made)
            return made.result
        except Conflict:
            continue  # the files of this attempt stay unnamed
    raise Conflict(f"no free version in {retries} attempts")


def _result(source_id: str, received: int, inserted: int) -> dict:
    return {
        "source_id": source_id, "received": received, "inserted": inserted, "duplicates": received - inserted,
        "accepted_ratio": inserted / received if received else 1.0,
    }


def _attempt(spark, path, base, batch, received, source_id, snapshot, stream) -> Commit:
    known = probe_keys(spark, path, base, batch)
    known = known.where(F.col("source_id") == source_id).select("dedupe_key")
    fresh = cut_lineage(batch.drop("copies").join(known, "dedupe_key", "left_anti"))
    inserted, name, runs = fresh.count(), uuid4().hex, base.runs
    if inserted:
        dated = fresh.withColumn("event_date", F.to_date("occurred_at"))
        day_files(dated, 500_000).sortWithinPartitions("entity_id", "occurred_at").write.partitionBy(
            "event_type", "event_date"
        ).parquet(f"{path}/events/batch={name}")
        runs = _merged(spark, path, (*runs, _write_run(path, fresh, inserted)))
    added = 0
    if snapshot is not None:
        first = cut_lineage(record_source_snapshot(snapshot, stored_snapshots(spark, path)))
        added = first.count()
        if added:
            first.write.parquet(f"{path}/snapshots/batch={name}")
    if not (inserted or added or stream):
        return base
    streams = {**base.streams, **({stream[0]: stream[1]} if stream else {})}
    return Commit(
        base.version + 1, name, runs, base.events + inserted, base.snapshots + added, streams,
        _result(source_id, received, inserted),
    )
