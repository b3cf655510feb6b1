"""Session settings and the one place that knows where intermediate tables may live."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options every operator relies on (all changeable on a live session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # the JVM never compiles methods above 8,000 bytes, so operators that would generate one run
    # with split methods instead
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # rows here are heavy to compute (hashes, sets), so keep many small partitions over few
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
    # joins whose measured build partitions are small need no sort
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `cut_lineage`, but compressed Parquet: a fraction of the disk for wide or repetitive rows, and later steps
    read only the columns that they use."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
