"""A training-data pipeline over `documents`: good quality, one of each group of near copies, no benchmark text, no
personal data, packed windows. Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import decontam, near_copies, packing, pii, quality
from hearthline.llm.common import free_name, table, tokenizer_path
from hearthline.session import shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no near copy (0.8 of five-word shingles) of one with a smaller id: the trie self-join of their
    SimHash fingerprints and MinHash bands name candidates, whole shingle sets confirm them."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    name = free_name(docs, "__found")
    found = decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark"), out=name)
    return found.where(F.size(f"{name}.spans") == 0).drop(name)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities replaced by their kind and revealing terms generalised or removed; n_chars is renewed."""
    name = free_name(docs, "__pii")
    clean = pii.sanitise(docs, out=name, keep_text=True, redacted=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of at most 1024 ids."""
    # workers of the earlier stages still hold memory, so this stage keeps a smaller cache
    ids = packing.pack(docs, tokenizer_path(), cache=100_000)
    return ids.select("doc_id", "sequence_id", "offset", "start", "length", "doc_tokens", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", remove_personal_data),
    ("packing", pack_windows),
]

#: Not expressible in SQL: a trained classifier, XXH64 fingerprints, corpus disclosure and tokenization.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
