"""URL filter: host and path rules first, then a tree of path templates per host with smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

#: (verdict, host, path) of the fixed rules.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (as text) that fits, as struct(rule, verdict); null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def shape(path: Column) -> Column:
    """The path with every run of digits as `*`: numbers are variable wherever they stand."""
    return F.regexp_replace(path, "[0-9]+", "*")


def segments(shaped: Column, depth: int) -> Column:
    """Segments of the path; what lies deeper than `depth` is the last one."""
    return F.split(F.regexp_replace(shaped, "^/", ""), "/", depth)


def similar(bad: Column, good: Column, bad2: Column, good2: Column, z2: float) -> Column:
    """Two proportions differ by no more than chance (pooled z test); without labels there is nothing to tell apart
    unless both have none."""
    n, n2 = bad + good, bad2 + good2
    pooled = (bad + bad2) / (n + n2)
    gap = bad / n - bad2 / n2
    return F.when((n == 0) & (n2 == 0), F.lit(True)).when((n == 0) | (n2 == 0), F.lit(False)).otherwise(
        gap * gap <= z2 * pooled * (1 - pooled) * (1 / n + 1 / n2)
    )


def template_verdicts(
    shapes: DataFrame, depth: int = 4, fan_out: int = 20, per_child: int = 3, z2: float = 3.84, weight: float = 4.0,
    reject: float = 0.8,
) -> DataFrame:
    """Per (host, shape) the template, its smoothed bad share and verdict.

    Level by level from the host down: a node with at least `fan_out` different children of fewer than `per_child` pages
    each on average has one wildcard child instead; then children whose bad shares are alike are merged, in order of
    the share, each with its neighbour. A branch's bad share is smoothed towards that of the node above with `weight`
    pseudo-pages, the host's towards the corpus share; so a template without labels goes by the nearest node that has
    some. Nodes and branches are aggregates over shapes, which are far fewer than pages; a window sees the children of
    one node only, fewer than `fan_out` or well filled.
    """
    rates = shapes.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    bad, good = rates.bad or 0, rates.good or 0
    prior = (bad + 1) / (bad + good + 2)
    hosts = shapes.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    of_host = (F.col("bad") + weight * prior) / (F.col("bad") + F.col("good") + weight)
    tree = shapes.withColumn("parts", segments(F.col("shape"), depth)).withColumn("node", F.lit(""))
    tree = tree.join(hosts.select("host", of_host.alias("bad_share")), "host")
    for level in range(depth):
        part = F.coalesce(F.get("parts", F.lit(level)), F.lit(""))
        deep = F.size("parts") > level
        rows = tree.withColumn("part", part).withColumn("deep", deep)
        child = rows.where("deep").groupBy("host", "node", "part").agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
        )
        fan = child.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"))
        wide = fan.where((F.col("kinds") >= fan_out) & (F.col("pages") < per_child * F.col("kinds"))).select(
            "host", "node", F.lit(True).alias("wide")
        )
        child = child.join(wide, ["host", "node"], "left").withColumn("name", F.when(F.col("wide"), "*").otherwise(F.col("part")))
        named = child.groupBy("host", "node", "name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        share = F.when(F.col("bad") + F.col("good") > 0, F.col("bad") / (F.col("bad") + F.col("good"))).otherwise(-1.0)
        order = "PARTITION BY host, node ORDER BY share, name"
        named = named.withColumn("share", share).withColumns({
            "bad0": F.expr(f"lag(bad) OVER ({order})"), "good0": F.expr(f"lag(good) OVER ({order})")
        })
        joins = F.col("bad0").isNotNull() & similar(F.col("bad"), F.col("good"), F.col("bad0"), F.col("good0"), z2)
        named = named.withColumn("start", F.when(joins, 0).otherwise(1))
        named = named.withColumn("branch", F.expr(f"sum(start) OVER ({order} ROWS UNBOUNDED PRECEDING)"))
        branch = child.select("host", "node", "part", "name").join(named.select("host", "node", "name", "branch"), ["host", "node", "name"])
        # the branch's name: its first member by name stands for all
        label = named.groupBy("host", "node", "branch").agg(
            F.min("name").alias("label"), F.count("*").alias("members"), F.sum("bad").alias("b_bad"), F.sum("good").alias("b_good")
        )
        branch = branch.join(label, ["host", "node", "branch"]).select(
            "host", "node", "part",
            F.when(F.col("members") > 1, F.concat("label", F.lit("+"), F.col("members") - 1)).otherwise(F.col("label")).alias("label"), "b_bad", "b_good",
        )
        own = (F.col("b_bad") + weight * F.col("bad_share")) / (F.col("b_bad") + F.col("b_good") + weight)
        tree = rows.join(branch, ["host", "node", "part"], "left").withColumns({
            "node": F.when(F.col("deep"), F.concat("node", F.lit("/"), "label")).otherwise(F.col("node")),
            "bad_share": F.when(F.col("deep"), own).otherwise(F.col("bad_share")),
        }).drop("part", "label", "deep", "b_bad", "b_good")
        tree = cut_lineage(tree)
    return tree.select(
        "host", "shape", F.col("node").alias("template"), "bad_share",
        F.when(F.col("bad_share") >= reject, "block").otherwise("allow").alias("template_verdict"),
    )


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, depth: int = 4, reject: float = 0.8
) -> DataFrame:
    """One row per page: page_id, host, path, rule, template, bad_share, verdict.

    The rules' verdict stands where one fits; such pages are also the labels from which templates learn. Null urls and
    urls without :// have an empty host and path and form a template of their own; an empty path has one empty segment;
    repeated rows count each; an empty table stays empty; other columns are left out. Pages are aggregated by
    (host, shape) before any shuffle, so a host with a third of all pages is a few rows a task.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    shapes = parsed.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count_if(F.col("hit.verdict") == "block").alias("bad"),
        F.count_if(F.col("hit.verdict") == "allow").alias("good"),
    )
    found = template_verdicts(cut_lineage(shapes), depth=depth, reject=reject)
    return parsed.join(found, ["host", "shape"]).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), "template", "bad_share",
        F.coalesce("hit.verdict", "template_verdict").alias("verdict"),
    )
