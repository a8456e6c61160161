"""URL filters by trust and distrust on the host graph.

Rules (host, path) settle the urls they fit, the longest rule first. Hosts with a page that an allow rule settles are
trusted seeds, hosts with a page that a block rule settles are blocked seeds. Personalised PageRank spreads trust
along host edges and distrust against them; a url that no rule fits is judged by its host's two scores.
Host edges are links in the pages that name a host, plus a lighter edge each way between a host and its parent domain. Both scores
are on one scale: a seed's own share of either counts alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import saved

# Fixed values: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host, path, rules=RULES):
    """struct(rule, verdict) of the longest fitting rule; null if none fits. Longest: host and path together."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, family: float = 0.25) -> DataFrame:
    """src, dst, weight: links in html that name a host (with or without a scheme) weigh 1; host <-> parent domain, where that has two labels or more, weighs `family`.

    Links are made distinct inside a page first; a host with very many pages sends partial results only.
    """
    link = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    linked = pages.select("host", F.explode(F.array_distinct(F.transform(link, lambda x: F.translate(x, UPPER, LOWER)))).alias("to")).distinct()
    hosts = pages.select("host").union(linked.select("to")).where("host <> ''").distinct()
    parent = lambda c: F.regexp_extract(c, r"^[^.]+\.(.+\..+)$", 1).alias("to")
    near = hosts.select("host", parent("host")).where("to <> ''")
    near = near.union(near.select(F.col("to").alias("host"), parent("to")).where("to <> ''"))
    every = linked.withColumn("weight", F.lit(1.0)).union(near.union(near.select("to", "host")).withColumn("weight", F.lit(family)))
    return every.where("host <> '' and to <> '' and host <> to").groupBy(F.col("host").alias("src"), F.col("to").alias("dst")).agg(F.max("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, name: str) -> DataFrame:
    """Personalised PageRank of each kind over edges(kind, src, dst, weight) from seeds(kind, host): (kind, host, score). The scores of a kind sum to its number of seeds, so
    that a seed of either kind counts alike; mass at hosts without outgoing edges goes back to the seeds.

    Rounds go on until no score rises by more than its tolerance-th part in four of them, so every host that a seed reaches
    has one. Scores add up from below; mass lost meanwhile at hosts without outgoing edges would start from the seeds
    again, which multiplies every score of a kind by the same number: one division by the total at the end gives it back.
    Scores are rounded to 6 significant digits then, so the order of sums cannot show.
    """
    degree = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    out = saved(edges.join(degree, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all") * damping).alias("share")), f"{name}-edges")
    start = saved(seeds.select("kind", "host").distinct(), f"{name}-seeds")
    base = start.withColumn("score", F.lit(1 - damping))
    rank, rising = base, True
    while rising:
        was = rank.withColumnRenamed("score", "before")
        for _ in range(4):
            moved = out.join(rank, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
            rank = moved.union(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        rank = saved(rank, name)
        rising = rank.join(was, ["kind", "host"], "left").where(F.col("score") - F.coalesce("before", F.lit(0.0)) > F.col("score") * tolerance).limit(1).count()
    total = rank.groupBy("kind").agg(F.sum("score").alias("total")).join(start.groupBy("kind").agg(F.count("*").alias("n")), "kind")
    # total: a row for each of two kinds
    return rank.join(F.broadcast(total), "kind").select("kind", "host", F.format_string("%.5e", F.col("score") * F.col("n") / F.col("total")).cast("double").alias("score"))


def judge_urls(pages: DataFrame, rules=RULES, damping: float = 0.6, tolerance: float = 1e-4, margin: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages(page_id, url, html).

    A url without rule is blocked where its host's distrust exceeds its trust by more than margin, else allowed (so
    a host that neither reaches is allowed). Null urls and urls without '://' have empty host and path, no rule and are
    allowed. Repeated rows are each judged; other columns are not carried; null html has no links. Empty in, empty out.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    fit = best_rule(F.col("host"), F.col("path"), rules)
    judged = p.select("page_id", "host", "path", fit.alias("fit"))
    edges = saved(host_edges(p), "host-edges")
    kinds = F.when(F.col("fit.verdict") == "allow", "trust").when(F.col("fit.verdict") == "block", "distrust")
    seeds = judged.select(kinds.alias("kind"), "host").where("kind is not null and host <> ''")
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score"))).alias(kind)
    scores = saved(spread(ways, seeds, damping, tolerance, "host-ranks").groupBy("host").agg(of("trust"), of("distrust")), "host-scores")
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(
            F.col("fit.verdict"),
            F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) + margin, "block").otherwise("allow"),
        ).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
