"""A tree of hashes over a table's records, cut by partition keys, so that a check can name what differs.

Line hashes fall into leaves by their first hexadecimal digits, about LEAF lines each; a leaf is the hash of its
sorted lines and their counts, a node the hash of its sorted children (4,096 at most), a partition the top node.
The depth follows from a partition's own row count, so equal content gives equal digests whatever the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.session import stored

LEAF = 1024
DEEPEST = 6
FOLD = 3


def _joined(name: str, digest: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", name, digest)))
    return F.sha2(F.array_join(pairs, "|"), 256)


def line_hashes(df: DataFrame, line: Column, keys: dict[str, Column]) -> DataFrame:
    """(*keys, h): the sha256 of every line in binary. Hashing long lines is most of the work of a digest, so whoever
    takes several digests of a table stores these first."""
    return df.select(*[c.alias(k) for k, c in keys.items()], F.unhex(F.sha2(line, 256)).alias("h"))


def partition_digests(
    df: DataFrame, line: Column, keys: dict[str, Column], hashes: DataFrame | None = None
) -> DataFrame:
    """(*keys, rows, digest) of every partition. Lines are shuffled once, as binary hashes dealt by leaf; repeated ones are
    counted there before anything is collected, so neither a hot partition nor a line that stands a million times makes
    a large group. Null keys form a partition of their own; an empty table has no partition. `hashes` are stored
    `line_hashes` of the table, which then are not made again."""
    names = list(keys)
    if hashes is None:
        lines = df.select(*[c.alias(k) for k, c in keys.items()], F.sha2(line, 256).alias("h"))
    else:
        lines = hashes.select(*names, F.lower(F.hex("h")).alias("h"))
    # sizes come from the keys alone: a column-pruned scan, not a second pass over the lines; stored, so the planner
    # knows how few they are and does not shuffle the lines to meet them
    keyed = df.select(*[c.alias(k) for k, c in keys.items()]) if hashes is None else hashes.select(*names)
    sizes = stored(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("rows")))
    digits = sum((F.col("rows") > LEAF * 16**k).cast("int") for k in range(DEEPEST))
    sizes = sizes.withColumn("digits", digits).select(*[F.col(k).alias(f"_{k}") for k in names], "rows", "digits")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
    leaf = [*names, "rows", "digits", "at"]
    placed = lines.join(sizes, same).select(
        *names, "rows", "digits", F.expr("left(h, digits)").alias("at"), F.unhex("h").alias("h")
    ).repartition(*leaf)
    counted = placed.groupBy(*leaf, "h").agg(F.count(F.lit(1)).alias("copies"))
    nodes = counted.withColumn("h", F.lower(F.hex("h"))).groupBy(*leaf).agg(_joined("h", "copies").alias("digest"))
    for _ in range(-(-DEEPEST // FOLD)):
        up = F.greatest(F.col("digits") - FOLD, F.lit(0))
        parent = nodes.select(*names, "rows", up.alias("up"), "digits", "at", "digest").withColumn("above", F.expr("left(at, up)"))
        nodes = parent.groupBy(*names, "rows", "digits", F.col("up"), "above").agg(
            F.when(F.col("digits") == 0, F.min("digest")).otherwise(_joined("at", "digest")).alias("digest")
        ).select(*names, "rows", F.col("up").alias("digits"), F.col("above").alias("at"), "digest")
    return nodes.select(*names, "rows", "digest")


def root(digests: DataFrame, keys: list[str]) -> Column:
    """Aggregate over `partition_digests`: one hash for the table."""
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", name, "digest"))), "|"), 256)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, modified) of the data files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return found.select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.col("modificationTime").alias("modified")
    )


def seal(
    spark: SparkSession, data: str, at: str, line: Column, keys: dict[str, Column], hashes: DataFrame | None = None
) -> str:
    """Write below `at` the partition digests of the Parquet table `data`, and which files hold which partitions with
    their length and time. Returns the root."""
    df = spark.read.parquet(data)
    partition_digests(df, line, keys, hashes).write.mode("errorifexists").parquet(f"{at}/digests")
    held = df.select(F.col("_metadata.file_name").alias("file"), *[c.alias(k) for k, c in keys.items()]).distinct()
    held.join(file_list(spark, data), "file").write.mode("errorifexists").parquet(f"{at}/files")
    stored = spark.read.parquet(f"{at}/digests")
    return stored.agg(root(stored, list(keys)).alias("r")).first()["r"]


def damage(
    spark: SparkSession, data: str, at: str, line: Column, keys: dict[str, Column], changed_only: bool = False,
    hashes: DataFrame | None = None,
) -> DataFrame:
    """(*keys, state) of every partition that differs from its seal: changed, missing or added. `hashes` are stored
    `line_hashes` of the whole table as it is now.

    `changed_only` trusts a file whose length and time are as sealed, and hashes only the partitions that other files
    hold or held, reading no file without one of them.
    """
    names = list(keys)
    df, stored = spark.read.parquet(data), spark.read.parquet(f"{at}/digests")
    if changed_only:
        hashes = None  # of the whole table; only a part is read here
        sealed = spark.read.parquet(f"{at}/files")
        now = file_list(spark, data)
        like = now.join(sealed.select("file", "length", "modified").distinct(), ["file", "length", "modified"], "left_semi")
        moved = [r.file for r in now.join(like, "file", "left_anti").select("file").collect()]
        gone = sealed.join(like.select("file"), "file", "left_anti").select(*names)
        base = data.rstrip("/")
        touched = gone
        if moved:
            touched = gone.unionByName(spark.read.parquet(*[f"{base}/{f}" for f in moved]).select(*[c.alias(k) for k, c in keys.items()]))
        touched = touched.distinct()
        mine = lambda a, b: [a[k].eqNullSafe(b[k]) for k in names]
        stored = stored.join(touched, mine(stored, touched), "left_semi")
        still = sealed.join(like.select("file"), "file", "left_semi")
        wanted = [r.file for r in still.join(touched, mine(still, touched), "left_semi").select("file").distinct().collect()]
        files = [f"{base}/{f}" for f in (*wanted, *moved)]
        df = spark.read.schema(df.schema).parquet(*files) if files else df.limit(0)
        cut = df.select("*", *[c.alias(f"_{k}") for k, c in keys.items()])
        df = cut.join(touched, [cut[f"_{k}"].eqNullSafe(touched[k]) for k in names], "left_semi").select(df.columns)
    found = partition_digests(df, line, keys, hashes)
    old = stored.select(*names, F.col("digest").alias("was"), F.lit(None).cast("string").alias("now"))
    new = found.select(*names, F.lit(None).cast("string").alias("was"), F.col("digest").alias("now"))
    both = old.unionByName(new).groupBy(*names).agg(F.max("was").alias("was"), F.max("now").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(*names, state.alias("state"))
