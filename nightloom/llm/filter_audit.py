"""What filters cost in every order they may be applied in, from one pass over the documents.

Each document becomes a word of 32 bits, its truth table of survival: bit S is set if the document survives the set S of filters, that is, if it fails none
of them. How many words have bit S is how many documents survive S, whatever the order. The words are added in the tasks by positions: full adders over
whole arrays of words, which save their carries for the next power of two; so a task holds a batch and hands on 32 counts for each part and labels it has met.
All figures of all 120 orders are differences of these counts.
"""

from __future__ import annotations

import math
import string
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import saved

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
SPACE = r"[\x20\x09-\x0D]+"

#: The word of a document by the mask of the filters that it fails.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & fails) for fails in range(SUBSETS)], dtype=np.uint32)


def positional_counts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many words have bit 0, 1, ..., 31; word i counts times[i].

    A column holds words of one power of two. Three of its words become one sum in it and one carry in the next column, all thirds at once, until one is left.
    """
    columns = [words[times >> b & 1 == 1] for b in range(int(times.max(initial=0)).bit_length())]
    counts = np.zeros(32, dtype=np.int64)
    for power, column in enumerate(columns):
        carries = []
        while len(column) > 1:
            if len(column) == 2:
                column = np.append(column, np.uint32(0))
            third = len(column) // 3
            a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
            carries.append(a & b | (a ^ b) & c)
            column = np.append(a ^ b ^ c, column[3 * third :])
        if carries:
            if power + 1 == len(columns):
                columns.append(np.zeros(0, dtype=np.uint32))
            columns[power + 1] = np.concatenate([columns[power + 1], *carries])
        if len(column):
            counts += (column[0] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64) << power
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """part, n: how many of rows(part string, good, toxic, fails int, times long) survive each set of filters, as 32 structs (s, every, good, toxic) by s."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            words = WORDS[batch.column("fails").to_numpy()]
            times = batch.column("times").to_numpy()
            labels = batch.column("good").to_numpy(zero_copy_only=False) + 2 * batch.column("toxic").to_numpy(zero_copy_only=False)
            group = part.indices.to_numpy().astype(np.int64) * 4 + labels
            order = np.argsort(group, kind="stable")
            kinds, first = np.unique(group[order], return_index=True)
            sets = [positional_counts(words[at], times[at]) for at in np.split(order, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.dictionary.take(pa.array(kinds // 4)), pa.array(kinds % 2 == 1), pa.array(kinds // 2 % 2 == 1), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))],
                names=["part", "good", "toxic", "sets"],
            )

    made = rows.select("part", "good", "toxic", "fails", "times").mapInArrow(counted, "part string, good boolean, toxic boolean, sets array<long>")
    of = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    by_set = made.select("part", "good", "toxic", F.posexplode("sets").alias("s", "n")).groupBy("part", "s").agg(F.sum("n").alias("every"), of(F.col("good"), "good"), of(F.col("toxic"), "toxic"))
    return by_set.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "every", "good", "toxic"))).alias("n"))  # 32 structs


def all_orders(counts: DataFrame) -> DataFrame:
    """From survivors(): part, filter_order, step and the counts of what the filter of that step does there, for all orders."""
    steps = []
    for order in permutations(LETTERS):
        for k in range(len(LETTERS)):
            before = sum(1 << LETTERS.index(x) for x in order[:k])
            steps.append(f"struct('{''.join(order)}' filter_order, {k + 1} step, {before} before, {1 << LETTERS.index(order[k])} filter)")
    table = F.expr(f"inline(array({', '.join(steps)}))")  # 600 fixed rows for every part

    def n(s: Column, of: str = "every") -> Column:
        return F.element_at("n", s.cast("int") + 1)[of]

    before, one, whole = F.col("before"), F.col("filter"), SUBSETS - 1
    after = before.bitwiseOR(one)
    removed = n(before) - n(after)
    # A set of s filters stands before a filter in s! * (the others)! orders.
    weight = [math.factorial(s) * math.factorial(len(LETTERS) - 1 - s) for s in range(len(LETTERS))]
    gained = [F.when(one.bitwiseAND(s) == 0, (n(F.lit(s)) - n(one.bitwiseOR(s))) * weight[s.bit_count()]).otherwise(0) for s in range(SUBSETS - 1)]
    return counts.select("part", "n", table).select(
        "part",
        "filter_order",
        "step",
        n(after).alias("kept"),
        removed.alias("removed"),
        (n(F.lit(0)) - n(one) - removed).alias("redundant"),
        (n(F.lit(whole) - one) - n(F.lit(whole))).alias("unique_fails"),
        (n(before, "good") - n(after, "good")).alias("good_lost"),
        (n(before, "toxic") - n(after, "toxic")).alias("toxic_lost"),
        sum(gained, F.lit(0).cast("long")).alias("shapley"),
    )


def failed_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, good, toxic, fails, times: rows of docs alike in all this, and in id and text, are one row with their number in times.

    Null text is empty, null part an empty string. Texts are identical if their SHA-256 are. A row with a null id has no smaller one and is smaller than none: it never fails E,
    nor does another because of it; it has no labels. Rows with one id and one text are identical to none smaller by each other. Of several labels of an id any 1 counts.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    found = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"), words.alias("words"))
    t = F.col("t")
    capitals = F.length(t) - F.length(F.translate(t, string.ascii_uppercase, ""))
    fails = [F.size("words") < 200, 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"), 100 * capitals > 3 * F.length(t), t.rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    # The texts are read once; what goes on is a digest and a mask.
    found = saved(found.select("id", "part", F.unhex(F.sha2(t, 256)).alias("digest"), mask.cast("int").alias("mask")), "filter-masks")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.select(F.col(key).alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(one("quality").alias("good"), one("toxic").alias("bad"))
    known = found.where("id is not null").groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("times")).join(marks, "id", "left")
    first = found.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    no = F.lit(False)
    # Both keys: the copies of a text are dealt by their ids.
    known = known.join(first, ["digest", "id"], "left").select(
        "part", F.coalesce("good", no).alias("good"), F.coalesce("bad", no).alias("toxic"), (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).cast("int").alias("fails"), "times"
    )
    nameless = found.where("id is null").select("part", no.alias("good"), no.alias("toxic"), F.col("mask").alias("fails"), F.lit(1).cast("long").alias("times"))
    return known.union(nameless)


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part of docs; see failed_filters for odd rows. No rows for an empty table."""
    return all_orders(survivors(failed_filters(docs, labels, key, text, part)))


SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND length(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, k AS step, bits[k] AS one, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n,
    CASE WHEN length(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * length(list_distinct(words)) < 50 * length(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN marks USING (doc_id) GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, one,
    CAST(sum(CASE WHEN fails & (before | one) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails & before = 0 AND fails & one > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails & before > 0 AND fails & one > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = one THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN good AND fails & before = 0 AND fails & one > 0 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN toxic AND fails & before = 0 AND fails & one > 0 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, one) AS BIGINT) AS shapley
FROM r
"""
