"""Line dedup: cross-site boilerplate by distinct-site spread.

A line (spaces at its ends aside) is known by a 64-bit hash. For every hash that occurs often enough, HyperLogLog sketches of the
sites it stands on and of the texts it stands in are built per task and merged by aggregation. Where an estimate is near the
threshold, exact distinct counts decide. A line is boilerplate if it stands on min_sites sites or more, in as many different
texts: exact copies of a whole document are one text and are left to document dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 64
DEALT = 16  # shares of a line's occurrences in joins: a line that a third of all documents have is a hot key
LG_K = 12  # sketches of 4096 registers: a standard error of 1.6 %
NEAR = 0.1  # estimates within a tenth of a threshold are counted exactly: six standard errors


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc, site, body, line: a row for each line that isn't blank; doc, body and line are hashes."""
    d = docs.select(
        F.xxhash64("doc_id", "text").alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce("source", F.lit("")).alias("site"),
        F.explode(F.transform(_lines(F.col("text")), lambda x: F.trim(x))).alias("line"),
    )
    return d.where("line <> ''").withColumn("line", F.xxhash64("line"))


def _of_lines(seen: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of seen whose line is one of lines: joined by line and share, each line repeated over the shares."""
    every = lines.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return seen.withColumn("dealt", F.pmod("doc", F.lit(DEALT)).cast("int")).join(every, ["line", "dealt"], "left_semi").drop("dealt")


def boilerplate_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """line: hashes of boilerplate lines."""
    seen = _occurrences(docs)
    # A line on min_sites sites occurs that often at least.
    often = seen.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line")
    some = _of_lines(seen, often)
    # Sketches of shares of a line's occurrences, then their union: a line that a third of all documents have is many shares.
    shares = some.groupBy("line", F.pmod("body", F.lit(SHARES)).alias("share")).agg(*[F.hll_sketch_agg(c, F.lit(LG_K)).alias(c) for c in ("site", "body")])
    sketched = shares.groupBy("line").agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(n) for c, n in (("site", "sites"), ("body", "texts"))])
    around = lambda x: F.abs(x - min_sites) <= max(1.0, min_sites * NEAR)
    wide = (F.col("sites") >= min_sites) & (F.col("texts") >= min_sites)
    unsure = around(F.col("sites")) | around(F.col("texts"))
    hopeless = F.least("sites", "texts") < min_sites * (1 - NEAR) - 1
    clear = sketched.where(wide & ~unsure).select("line")
    doubt = sketched.where(unsure & ~hopeless).select("line")
    exact = (
        _of_lines(some, doubt)
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"), F.count_distinct("body").alias("texts"))
    )
    return clear.union(exact.where(wide).select("line"))


def dedup_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """docs with boilerplate lines cut out of text; adds n_lines and n_removed. Every row stays, in whatever it has left.

    docs has doc_id, text and source (the site); other columns are kept as they are, but for any named n_lines or n_removed, whose place the
    new ones take. Null text stays null, with
    0 lines; blank lines are neither counted nor removed. A null source is a site of its own. Repeated rows count
    once as texts, and each loses the same lines. An empty table gives an empty one.
    """
    bad = boilerplate_lines(docs, min_sites)
    cut = _of_lines(_occurrences(docs).select("doc", "line"), bad).groupBy("doc").agg(F.collect_set("line").alias("bad"))
    # The row as one column: no name in it can meet one of ours.
    d = docs.select(F.struct(*docs.columns).alias("row")).withColumn("id", F.xxhash64("row.doc_id", "row.text"))
    d = d.join(cut, F.col("id") == F.col("doc"), "left").select("row", "bad", _lines(F.col("row.text")).alias("parts"))
    drop = lambda x: (F.trim(x) != "") & F.array_contains("bad", F.xxhash64(F.trim(x)))
    text = F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter("parts", lambda x: ~drop(x)), "\n"))
    n_lines = F.size(F.filter("parts", lambda x: F.trim(x) != "")).cast("long")
    n_removed = F.when(F.col("bad").isNull(), F.lit(0)).otherwise(F.size(F.filter("parts", drop))).cast("long")
    new = {"text": text, "n_lines": n_lines, "n_removed": n_removed}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return d.select(F.struct(*kept, *[v.alias(c) for c, v in new.items()]).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]])


#: The same by exact counts alone.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, text, site, trim(unnest(parts)) AS line, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw FROM d),
bad AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10 AND count(DISTINCT text) >= 10),
k AS (SELECT rid, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE line IN (SELECT line FROM bad)) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE line NOT IN (SELECT line FROM bad)), '') AS kept FROM l GROUP BY rid)
SELECT d.doc_id, k.n_lines, k.n_removed, CASE WHEN d.text IS NOT NULL THEN k.kept END AS text FROM d JOIN k USING (rid)
"""
