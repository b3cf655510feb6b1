"""Partition digests against a plain loop, and damage named by partition."""

import glob
import hashlib
import os
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hearthline.plans import hash_tree

keys = lambda: {"kind": F.col("kind")}
line = lambda: F.col("line")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(rows, leaf):
    """kind -> digest, node by node."""
    out = {}
    for kind in {k for k, _ in rows}:
        count = Counter(sha(x) for k, x in rows if k == kind)
        digits = sum(sum(count.values()) > leaf * 16**i for i in range(hash_tree.DEEPEST))
        below = defaultdict(list)
        for h, n in count.items():
            below[h[:digits]].append(f"{h}:{n}")
        nodes = {at: sha("|".join(sorted(v))) for at, v in below.items()}
        while digits:
            digits = max(digits - 3, 0)
            above = defaultdict(list)
            for at, d in nodes.items():
                above[at[:digits]].append(f"{at}:{d}")
            nodes = {at: sha("|".join(sorted(v))) for at, v in above.items()}
        out[kind] = nodes[""]
    return out


def test_digests_match_a_loop(spark, monkeypatch):
    rows = [("a", f"x{i}") for i in range(3000)] + [("b", "same")] * 500 + [(None, "n"), ("c", "one"), ("c", "two")]
    df = spark.createDataFrame(rows, "kind string, line string")
    for leaf in (hash_tree.LEAF, 2, 1):  # one level, several, and deep ones
        monkeypatch.setattr(hash_tree, "LEAF", leaf)
        got = hash_tree.partition_digests(df.repartition(5), line(), keys()).collect()
        assert {r.kind: r.digest for r in got} == brute(rows, leaf)
        assert {r.kind: r["rows"] for r in got} == {"a": 3000, "b": 500, None: 1, "c": 2}
    assert hash_tree.partition_digests(df.limit(0), line(), keys()).count() == 0


def test_damage_names_the_partition(spark, tmp_path):
    data, at = str(tmp_path / "t"), str(tmp_path / "seal")
    df = spark.range(400).select(F.concat(F.lit("k"), F.col("id") % 4).alias("kind"), F.concat(F.lit("v"), "id").alias("line"))
    df.repartition(4, "kind").sortWithinPartitions("kind").write.option("maxRecordsPerFile", 60).parquet(data)
    top = hash_tree.seal(spark, data, at, line(), keys())
    assert len(top) == 64
    state = lambda **kw: {r.kind: r.state for r in hash_tree.damage(spark, data, at, line(), keys(), **kw).collect()}
    assert state() == state(changed_only=True) == {}
    # one file is written anew with one line changed
    held = spark.read.parquet(data).select(F.col("_metadata.file_name").alias("f"), "kind", "line").where("line = 'v1'").first()
    rows = spark.read.parquet(f"{data}/{held.f}").withColumn("line", F.when(F.col("line") == "v1", "other").otherwise(F.col("line")))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "new"))
    os.replace(glob.glob(str(tmp_path / "new" / "*.parquet"))[0], f"{data}/{held.f}")
    for crc in glob.glob(f"{data}/.{held.f}.crc"):
        os.replace(crc, str(tmp_path / "old.crc"))
    spark.catalog.refreshByPath(data)
    assert state() == state(changed_only=True) == {"k1": "changed"}
    spark.createDataFrame([("k9", "new")], "kind string, line string").coalesce(1).write.mode("append").parquet(data)
    assert state() == state(changed_only=True) == {"k1": "changed", "k9": "added"}
