"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is target share / present share. Each document draws its count by inverting
the Poisson distribution of that mean at a uniform number hashed from seed and doc_id, is exploded by the
count and shuffled globally by a second hash. A large mean is split into several draws of bounded mean, as sums of Poisson
numbers are Poisson.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import saved

BROADCAST = 10_000  # sources whose rates go to all tasks: some kilobytes each


def hash_unit(*parts):
    """A number in [0, 1) from the first 32 bits of an MD5: the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def source_rates(docs: DataFrame, targets: dict[str, float] | None, size: float) -> DataFrame:
    """source, rate: mean repetitions. Null sources are one source of their own."""
    # Partial counts by source, then a total over the few sources: a hot source costs a row a task.
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    if targets is None:
        weight = 1.0 / F.col("sources")
    else:
        weight = F.coalesce(*[F.when(F.col("source") == F.lit(s), F.lit(float(w))) for s, w in targets.items()], F.lit(0.0)) / float(sum(targets.values()))
    rate = weight * F.col("total") * F.lit(float(size)) / F.col("n")
    return sizes.join(F.broadcast(total)).select("source", rate.alias("rate"))  # total is one row


def poisson_cdf(rate, highest: float):
    """P(X <= k) for k = 0, 1, ... of a Poisson mean <= highest, as an array; it runs to where double precision ends."""
    last = int(highest + 12 * highest**0.5 + 20)
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(a, k):
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.get(a["cdf"], k - 1) + p)).alias("cdf"))

    return F.reduce(F.sequence(F.lit(1), F.lit(last)), start, step, lambda a: a["cdf"])


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, seed: int = 7, size: float = 1.0, highest: float = 20.0, shuffle: bool = True) -> DataFrame:
    """Rows of docs repeated by Poisson draws so that sources reach their target shares; adds copy and mix_key, in the place of any columns so named.

    targets: weights by source (None: equal); sources not named get 0. size: expected rows out / rows in.
    highest: greatest mean of one draw; a document of a source with a greater one has several. copy counts from 0 within a
    draw, and each further draw begins at a fixed number of its own, so a document's copies have different numbers.
    Null source: a source of its own (targets cannot name it). Null doc_id hashes as 'null'; repeated rows draw
    alike. Null or empty texts count like others. Rows come in the order of mix_key within range partitions, ties by doc_id and copy.
    """
    # The row as one column: no name in it can meet one of ours.
    names = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rates = source_rates(docs.select("source"), targets, size)
    # Draws of mean highest, and one of the rest (not 0 unless the rate is).
    whole = F.greatest(F.ceil(F.col("rate") / F.lit(float(highest))) - 1, F.lit(0)).cast("long")
    full = F.when(F.col("whole") > 0, poisson_cdf(F.lit(float(highest)), highest))
    rates = rates.withColumn("whole", whole).select("source", "whole", full.alias("full"), poisson_cdf(F.col("rate") - F.col("whole") * F.lit(float(highest)), highest).alias("cdf"))
    rates = saved(rates, "rates")
    if rates.count() <= BROADCAST:  # else the hot sources of a shuffle join are for Spark to split
        rates = F.broadcast(rates)
    d = docs.select(F.struct(*names).alias("row")).join(rates, F.col("row.source").eqNullSafe(F.col("source"))).drop("source")
    # Most documents have one draw; the others become a row for each.
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    ident = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))
    # Inversion: as many repetitions as values of the distribution function that the uniform number reaches.
    first = F.col("draw") == 0
    unit = F.array(hash_unit(F.lit(f"count{seed}"), ident, F.when(~first, F.col("draw").cast("string"))))
    d = d.withColumn("n", F.get(F.transform(unit, lambda u: F.size(F.filter(F.when(first, F.col("cdf")).otherwise(F.col("full")), lambda c: c <= u))), 0)).where("n > 0")
    # No draw has more than the values that a distribution function lists.
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    d = d.withColumn("copy", (F.col("draw") * F.size("cdf") + F.col("copy")).cast("int"))
    d = d.select("row", "copy", hash_unit(F.lit(f"order{seed}"), ident, F.col("copy").cast("string")).alias("mix_key"))
    d = d.select(*[F.col("row").getField(c).alias(c) for c in names], "copy", "mix_key")
    return d.orderBy("mix_key", "doc_id", "copy") if shuffle else d
