"""Quality rules per document and per host, in Spark expressions only.

Every document is measured and held against rules; failures are added up by host, rates are shrunk with a beta prior
estimated from all hosts, and the hosts' verdicts are joined back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def repeated_words(word: Column) -> Column:
    """Words inside windows of five that occur twice or more: windows are hashed and sorted with their places, those
    with an equal neighbour are kept, and the words they cover are counted from the gaps between their places."""

    def windows(codes: Column) -> Column:
        return F.transform(
            F.slice(codes, 1, F.size(codes) - (WINDOW - 1)),
            lambda c, i: F.xxhash64(c, *[F.get(codes, i + k) for k in range(1, WINDOW)]),
        )

    def covered(places: Column) -> Column:
        def step(done, p):
            return F.struct(
                (done["n"] + F.least(F.lit(WINDOW), p + WINDOW - done["end"])).alias("n"), (p + WINDOW).alias("end")
            )

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, step, lambda done: done["n"])

    def count(hashes: Column) -> Column:
        def places(order: Column) -> Column:
            same = F.filter(
                order,
                lambda x, k: ((k > 0) & (F.get(order, k - 1)["h"] == x["h"])).eqNullSafe(True)
                | (F.get(order, k + 1)["h"] == x["h"]).eqNullSafe(True),
            )
            return covered(F.array_sort(F.transform(same, lambda x: x["i"])))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # most texts repeat no window, and a set of hashes tells so at once
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, places))

    codes = F.transform(word, lambda w: F.xxhash64(w))
    return F.when(F.size(word) < WINDOW, F.lit(0)).otherwise(let(codes, lambda c: let(windows(c), count)))


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the document's counts, all long."""
    value = F.coalesce(F.col(text), F.lit(""))
    # words cut once: they are used several times
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), value.alias("t"), let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
    )).alias("m"))
    return cut.select(
        "doc_id", "host", "m.n_words", "m.word_chars",
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(
            F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
        )).alias("l"),
        "m.n_repeat_words",
    ).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", F.col("l.lines").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"),
        "n_repeat_words",
    )


def failures() -> dict[str, Column]:
    """Rules by name, over the columns of measure(); integer arithmetic, so every engine agrees."""
    return {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 30 * F.col("n_words"),
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words")),
    }


BASE = ("few_words", "repeated_words")


def host_verdicts(measured: DataFrame, reject: float = 0.5, most_weight: float = 1000.0) -> DataFrame:
    """Per host: n_docs, n_failed, the shrunk failure rate and whether the host is rejected.

    The prior's mean and weight come from the mean and variance of all hosts' rates (moments; the weight lies between 2
    and `most_weight`; one host alone or equal rates give the largest weight). One row reaches the driver.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    hosts = cut_lineage(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("noise")).first()
    mean = min(max(m.mean if m.mean is not None else 0.5, 1e-3), 1 - 1e-3)
    spread = max((m["var"] or 0.0) - mean * (1 - mean) * (m.noise or 0.0), 0.0)  # beyond what sampling explains
    weight = most_weight if spread <= 0 else min(max(mean * (1 - mean) / spread - 1, 2.0), most_weight)
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk >= reject).alias("rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", reject: float = 0.5) -> DataFrame:
    """One row per row of `docs`: doc_id, counts, failed rules by name, base_failed, host_rate, host_rejected, kept.

    A document stays if it fails no rule and its host is not rejected. Null and empty texts have no words and fail;
    a null host is a host of its own; repeated rows are judged each by itself; an empty table stays empty; other columns
    are left out. The narrow measurements are written once to the shared folder; hosts are pre-aggregated, and the join
    back is one that skew handling can split.
    """
    rules = failures()
    measured = measure(docs, id_col, text, host).withColumn(
        "failed_rules", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    )
    measured = cut_lineage(measured.withColumn("failed", F.size("failed_rules") > 0))
    hosts = host_verdicts(measured, reject).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "rejected")
    joined = measured.join(hosts, measured.host.eqNullSafe(F.col("h")), "left").drop("h")
    base_failed = F.array_contains("failed_rules", BASE[0]) | F.array_contains("failed_rules", BASE[1])
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed_rules",
        base_failed.alias("base_failed"), "host_rate", F.col("rejected").alias("host_rejected"),
        (~F.col("failed") & ~F.col("rejected")).alias("kept"),
    )
